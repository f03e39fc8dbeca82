"""Long word lists: all words looked for in one reading of a text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MANY_WORDS = 64
"""Longer lists are one automaton; shorter ones are an expression per word, with the same result."""


def found_words(text: Column, words: Sequence[str], names: Sequence[str] | None = None) -> Column:
    """The ``words`` found in the text as substrings, by their ``names``, in given order.

    An automaton over all words reads a text once, however many words there are. It is made once
    per task. A null text has none of them.
    """
    words, names = list(words), list(names or words)

    @F.pandas_udf("array<string>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        places: dict[str, list[int]] = {}
        for place, word in enumerate(words):
            places.setdefault(word, []).append(place)
        always = places.pop("", [])
        automaton = ahocorasick.Automaton()
        for word, found in places.items():
            automaton.add_word(word, found)
        if places:
            automaton.make_automaton()
        for batch in batches:
            rows = []
            for content in batch:
                hit = set(always if content is not None else ())
                if content and places:
                    hit.update(i for _, found in automaton.iter(content) for i in found)
                rows.append([names[i] for i in sorted(hit)])
            yield pd.Series(rows, dtype=object)

    return search(text)
