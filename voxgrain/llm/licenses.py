"""Licence scans by a positional rare-token index.

Templates of licence notices are indexed by word and position. How rare a word is comes from the
documents: one pass counts, for every word of the templates, the documents that have it. A file then
looks up, per template, the rarest template words it has; each occurrence votes for the place where
the template would start, and places on which enough of the words agree are verified: the share of
the template's words found there, and key phrases that must stand there word by word. Files that
lack a word of a template's key phrases cannot match it and are not looked at further.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxgrain.llm.common import byte_values, small

# Phrases that give a label wherever they stand.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Label, notice, key phrases that must be in it. Shortened public notices.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction including without limitation the rights to use "
     "copy modify merge publish distribute sublicense and or sell copies of the software",
     ("permission is hereby granted free of charge", "without restriction")),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at "
     "http www apache org licenses license 2 0", ("in compliance with the license", "apache org licenses")),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
     ("creative commons attribution", "noncommercial")),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license",
     ("creative commons attribution 4 0",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
     "license as published by the free software foundation either version 3 of the license or at your option any later version",
     ("gnu general public license", "version 3 of the license")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ("with or without fee is hereby granted",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("released into the public domain",)),
)
ANCHORS = 8
"""The rarest template words of a file that vote for a template's place; all their occurrences do."""

SLACK = 3
"""Words by which votes for one place, and its window, may be off."""

LEAST_SHARE = 0.75

# Bytes of words keep their value, A-Z in lower case; all others separate.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(WORD_BYTES).split()


@dataclass
class Template:
    label: str
    words: list[bytes]
    phrases: list[bytes]
    places: dict[bytes, np.ndarray] = field(default_factory=dict)
    needed: frozenset = frozenset()

    @classmethod
    def of(cls, label: str, text: str, phrases: Sequence[str]) -> Template:
        words = text.encode().split()
        places = defaultdict(list)
        for i, word in enumerate(words):
            places[word].append(i)
        keys = [p.encode() for p in phrases]
        return cls(label, words, keys, {w: np.array(p) for w, p in places.items()}, frozenset(w for k in keys for w in k.split()))


class Scanner:
    """Phrases and templates against the words of one text."""

    def __init__(self, phrases: Sequence, templates: Sequence, rarity: dict[bytes, float]):
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in phrases]
        self.templates = [Template.of(*t) for t in templates]
        self.vocabulary = frozenset(w for t in self.templates for w in t.words) | {w for p, _ in self.phrases for w in p.split()}
        self.rarity = rarity

    def base(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """Where the phrases start, and their labels."""
        line = b" " + b" ".join(words) + b" "
        starts, labels = [], set()
        for phrase, label in self.phrases:
            at = line.find(phrase)
            while at >= 0:
                starts.append(line.count(b" ", 0, at))
                labels.add(label)
                at = line.find(phrase, at + 1)
        return starts, labels

    def matches(self, words: list[bytes]) -> dict[str, float]:
        """Best share of template words per label of the templates that are found."""
        present = self.vocabulary.intersection(words)
        possible = [t for t in self.templates if t.needed <= present]
        if not possible:
            return {}
        wanted = present.intersection(*[frozenset().union(*(t.words for t in possible))])
        at = defaultdict(list)
        for i, word in enumerate(words):
            if word in wanted:
                at[word].append(i)
        found: dict[str, float] = {}
        for t in possible:
            rarest = sorted((w for w in t.places if w in at), key=lambda w: (-self.rarity.get(w, 0.0), w))[:ANCHORS]
            votes = [np.unique((np.array(at[w])[:, None] - t.places[w]).ravel()) for w in rarest]
            starts, counts = np.unique(np.concatenate(votes), return_counts=True)
            # Votes within the slack after a place count for it.
            total = np.cumsum(counts)
            last = np.searchsorted(starts, starts + SLACK, side="right") - 1
            near = total[last] - total + counts
            for start in starts[near >= max(1, (len(rarest) + 1) // 2)].tolist():
                share = self._verified(words, t, start)
                if share > found.get(t.label, 0.0):
                    found[t.label] = share
        return {label: share for label, share in found.items() if share >= LEAST_SHARE}

    @staticmethod
    def _verified(words: list[bytes], t: Template, start: int) -> float:
        window = words[max(0, start - SLACK):max(0, start) + len(t.words) + 2 * SLACK]
        line = b" " + b" ".join(window) + b" "
        if not all(b" " + p + b" " in line for p in t.phrases):
            return 0.0
        return sum((Counter(window) & Counter(t.words)).values()) / len(t.words)


def rarity(docs: DataFrame, vocabulary: Sequence[bytes], text: str = "text") -> dict[bytes, float]:
    """Inverse document frequency of the given words over all rows; their number bounds the result."""
    words = frozenset(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = Counter(), 0
        for batch in small(batches):
            rows += batch.num_rows
            for data in byte_values(batch.column(0)):
                seen.update(words.intersection(words_of(data)))
        seen[b""] = rows
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    counted = docs.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {bytes(row["word"]): row["n"] for row in counted.collect()}
    rows = found.pop(b"", 0)
    return {w: float(np.log((rows + 1) / (found.get(w, 0) + 1))) for w in words}


def scan(
    docs: DataFrame, phrases: Sequence = PHRASES, templates: Sequence = TEMPLATES, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) per row of ``docs``.

    ``base_labels`` are those of the phrases found, ``labels`` also those of templates; both are
    distinct, sorted and joined by commas, empty without any. ``score`` is the best template's share
    of words found, 1 where a phrase is, else 0. Null texts are empty. Repeated rows and null keys
    stay. Other columns are not read. Texts of any length are held by one task at a time; an empty
    table gives no rows.
    """
    vocabulary = Scanner(phrases, templates, {}).vocabulary
    weights = rarity(docs, sorted(vocabulary), text)
    schema = T.StructType([
        T.StructField(key, docs.schema[key].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()),
    ])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates, weights)
        for batch in small(batches):
            rows = []
            for data in byte_values(batch.column(1)):
                words = words_of(data)
                starts, labels = scanner.base(words)
                more = scanner.matches(words)
                rows.append((
                    len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)),
                    ",".join(sorted(labels | more.keys())), 1.0 if labels else min(1.0, max(more.values(), default=0.0)),
                ))
            columns = [pa.array(c, pa.int64() if i < 4 else pa.string() if i < 6 else pa.float64()) for i, c in enumerate(zip(*rows))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.fieldNames())

    return docs.select(key, text).mapInArrow(look, schema)
