"""Personal data by patterns and a linear-chain conditional random field.

Patterns give the base spans. The field then labels the tokens of every line that has a digit or an
at sign, from the shapes of a token and its neighbours, and adds spans the patterns miss: telephone
numbers without a plus, written-out addresses, cards with other separators. It is trained from a
small labelled table by gradient ascent on the exact likelihood and decoded by Viterbi over many
lines at once.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxgrain.llm.common import small, text_values

KINDS = ("email", "ip", "card", "phone")

# The base patterns.
# Addresses are found from their at sign: LOCAL before it, DOMAIN after it.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails from its first digit fails from all, so only the first is tried.
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TRIGGER = re.compile(r"[0-9@]|[(\[]at[)\]]")
TOKEN = re.compile(r"\S+")

LABELS = ["O", *[f"{b}-{k}" for k in KINDS for b in "BI"]]
REACH = 3
"""Tokens around one with a digit or an at sign, also a written-out one, that are labelled with it; all others are outside by definition."""


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid(kind: str, text: str) -> bool:
    """What a match must hold besides its pattern."""
    digits = _digits(text)
    if kind == "ip":
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in text.split(".")))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans (start, end) of every kind, leftmost and not overlapping within a kind."""
    found = {kind: [] for kind in KINDS}
    if "@" in text:
        found["email"] = list(_emails(text))
    if DIGIT.search(text):
        for kind, pattern, needs in (("ip", IP, "."), ("card", CARD, ""), ("phone", PHONE, "+")):
            if needs in text:
                found[kind] = [m.span() for m in pattern.finditer(text) if valid(kind, m[0])]
    return found


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at) if start < at else None
        if match:
            done = match.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def shape(token: str) -> str:
    """Letters as X and x, digits as 9, others as they are; letters' runs shortened, digits' runs counted up to 5."""
    kinds = "".join("9" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c for c in token[:40])
    return re.sub(r"9+", lambda m: "9" * min(5, len(m[0])), re.sub(r"(X|x)\1+", r"\1", kinds))


CUES = frozenset("tel phone call fax mobile mail e-mail email contact card visa credit ip host server at dot (at) [at] (dot) [dot] on from".split())


def own_features(token: str) -> list[str]:
    s, word = shape(token), token.lower().strip(".,;:")
    return [
        "s=" + s, "core=" + s.strip(".,;:!?()"), "n=" + str(min(6, len(_digits(token)))), "a=" + str("@" in token), "first=" + s[:1], "last=" + s[-1:],
        "cue=" + (word if word in CUES else ""), "dots=" + str(min(4, token.count("."))),
    ]


def side_features(token: str | None) -> list[str]:
    if token is None:
        return ["edge"]
    word = token.lower().strip(".,;:")
    return ["s=" + shape(token), "cue=" + (word if word in CUES else "")]


def token_features(tokens: Sequence[str]) -> list[list[str]]:
    """Names of the features of each token: its own, and those of its neighbours."""
    padded = [None, *tokens, None]
    return [
        [*own_features(t), *["<" + f for f in side_features(padded[i])], *[">" + f for f in side_features(padded[i + 2])]]
        for i, t in enumerate(tokens)
    ]


def labelled_table(lines: int = 600, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """(tokens, labels) of example lines, made by rule: what each kind looks like, and what only looks alike."""
    r = random.Random(seed)
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ou", "é", "ch"]) for _ in range(r.randint(1, 4)))

    def card() -> str:
        body = r.choice("456") + n(14)
        return body + next(d for d in "0123456789" if luhn(body + d))

    def grouped(sign: str) -> str:
        c = card()
        return sign.join(c[i:i + 4] for i in range(0, 16, 4))

    makers = {
        "email": [lambda: f"{word()}.{n(2)}@mail{n(1)}.example.com", lambda: f"{word()}@{word()}.org", lambda: f"{word()} (at) {word()} (dot) com",
                  lambda: f"{word()} [at] {word()} [dot] org"],
        "ip": [lambda: ".".join(str(r.randint(1, 255)) for _ in range(4)), lambda: "[.]".join(str(r.randint(1, 255)) for _ in range(4))],
        "card": [card, lambda: grouped(" "), lambda: grouped("-"), lambda: grouped(".")],
        "phone": [lambda: f"+1 ({n(3)}) 555-{n(4)}", lambda: f"({n(3)}) 555-{n(4)}", lambda: f"({n(3)}) {n(3)}-{n(4)}", lambda: f"+{n(2)} {n(3)} {n(6)}",
                  lambda: f"{n(3)}-{n(3)}-{n(4)}"],
        "O": [lambda: n(r.randint(1, 6)), lambda: f"20{n(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"{n(1)}.{n(1)}.{n(1)}", lambda: f"${n(2)}.{n(2)}",
              lambda: '"' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"', lambda: f"{word()}{n(2)}", lambda: f"@{word()}", lambda: f"({n(4)})",
              lambda: f"{n(2)}:{n(2)}", lambda: f"{n(3)}%", lambda: f"v{n(1)}.{n(1)}", lambda: f"{n(1)}/{n(2)}", lambda: f"{n(12)}", lambda: f"{n(3)}-{n(2)}",
              lambda: f"{n(1)},{n(3)},{n(3)}", lambda: f"{word()} {n(4)} {n(3)}"],
    }
    table = []
    for i in range(lines):
        tokens, labels = [], []
        for part in range(r.randint(1, 2)):
            before = [word() for _ in range(r.randint(0, 3))]
            kind = (*KINDS, "O", "O", "O")[(i + part) % 7]
            things = r.choice(makers[kind])().split()
            if r.random() < 0.4:
                things[-1] += r.choice([".", ",", "!", ";", "###", "$$$", "!!", "***"])
            tokens += before + things
            labels += ["O"] * len(before) + (["O"] * len(things) if kind == "O" else ["B-" + kind] + ["I-" + kind] * (len(things) - 1))
        after = [word() for _ in range(r.randint(0, 3))]
        table.append((tokens + after, labels + ["O"] * len(after)))
    return table


class Field:
    """Weights of a linear-chain conditional random field."""

    def __init__(self, names: dict[str, int]):
        self.names = names
        self.emit = np.zeros((len(names) + 1, len(LABELS)))  # the last row is for unknown features and stays zero
        self.move = np.zeros((len(LABELS), len(LABELS)))
        self.start = np.zeros(len(LABELS))

    def indexed(self, tokens: Sequence[str]) -> list[list[int]]:
        none = len(self.names)
        return [[self.names.get(f, none) for f in features] for features in token_features(tokens)]


# A label I-k follows only B-k or I-k.
FORBIDDEN = np.array([[b[0] == "I" and a[1:] != b[1:] for b in LABELS] for a in LABELS])
FORBIDDEN_START = np.array([b[0] == "I" for b in LABELS])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(table: Sequence[tuple[Sequence[str], Sequence[str]]], rounds: int = 80, rate: float = 0.15, decay: float = 1e-3) -> Field:
    """Exact maximum likelihood with a quadratic penalty, by Adam over the whole table at once."""
    names: dict[str, int] = {}
    for tokens, _ in table:
        for features in token_features(tokens):
            for f in features:
                names.setdefault(f, len(names))
    field = Field(names)
    b, length, width = len(table), max(len(t) for t, _ in table), len(token_features(["x"])[0])
    ids = np.full((b, length, width + 4), len(names))
    gold, mask = np.zeros((b, length), int), np.zeros((b, length), bool)
    for i, (tokens, labels) in enumerate(table):
        for j, found in enumerate(field.indexed(tokens)):
            ids[i, j, :len(found)] = found
        gold[i, :len(labels)] = [LABELS.index(x) for x in labels]
        mask[i, :len(labels)] = True
    k = len(LABELS)
    wall, wall_start = np.where(FORBIDDEN, -1e4, 0.0), np.where(FORBIDDEN_START, -1e4, 0.0)
    seen = np.zeros_like(field.emit)
    one = np.eye(k)
    np.add.at(seen, ids[mask], one[gold[mask]][:, None, :])
    seen_move = np.zeros((k, k))
    follows = mask[:, 1:]
    np.add.at(seen_move, (gold[:, :-1][follows], gold[:, 1:][follows]), 1)
    seen_start = one[gold[:, 0]].sum(axis=0)
    weights = [field.emit, field.move, field.start]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, rounds + 1):
        scores = field.emit[ids].sum(axis=2)
        move = field.move + wall
        forward = np.zeros((b, length, k))
        backward = np.zeros((b, length, k))
        forward[:, 0] = scores[:, 0] + field.start + wall_start
        for t in range(1, length):
            new = _log_sum(forward[:, t - 1][:, :, None] + move, 1) + scores[:, t]
            forward[:, t] = np.where(mask[:, t][:, None], new, forward[:, t - 1])
        for t in range(length - 2, -1, -1):
            new = _log_sum(move + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(mask[:, t + 1][:, None], new, 0)
        norm = _log_sum(forward[:, -1], 1)
        single = np.exp(np.minimum(0, forward + backward - norm[:, None, None])) * mask[:, :, None]
        expected = np.zeros_like(field.emit)
        np.add.at(expected, ids[mask], single[mask][:, None, :])
        pairs = forward[:, :-1, :, None] + move + (scores + backward)[:, 1:, None, :] - norm[:, None, None, None]
        expected_move = (np.exp(np.minimum(0, pairs)) * follows[:, :, None, None]).sum(axis=(0, 1))
        slopes = [seen - expected, seen_move - expected_move, seen_start - single[:, 0].sum(axis=0)]
        for i, (w, slope) in enumerate(zip(weights, slopes)):
            slope = slope / b - decay * w
            first[i] = 0.9 * first[i] + 0.1 * slope
            second[i] = 0.99 * second[i] + 0.01 * slope ** 2
            w += rate * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.99 ** step)) + 1e-8)
        field.emit[-1] = 0
    return field


class Decoder:
    """Viterbi over many token sequences at once; what a token adds to the scores is remembered."""

    KNOWN = 50_000

    def __init__(self, field: Field):
        self.field = field
        self.move = field.move + np.where(FORBIDDEN, -1e9, 0.0)
        self.start = field.start + np.where(FORBIDDEN_START, -1e9, 0.0)
        self.parts: dict[str | None, np.ndarray] = {}

    def _part(self, token: str | None) -> np.ndarray:
        """Rows: what the token gives itself, the token after it, the token before it."""
        found = self.parts.get(token)
        if found is None:
            if len(self.parts) > self.KNOWN:
                self.parts.clear()
            look = lambda names: sum((self.field.emit[self.field.names[f]] for f in names if f in self.field.names), np.zeros(len(LABELS)))
            sides = side_features(token)
            own = look(own_features(token)) if token is not None else np.zeros(len(LABELS))
            found = np.stack([own, look(["<" + f for f in sides]), look([">" + f for f in sides])])
            self.parts[token] = found
        return found

    def decode(self, sequences: Sequence[Sequence[str]], together: int = 256) -> list[np.ndarray]:
        """Best label numbers of every sequence."""
        answer: list[np.ndarray] = [np.zeros(0, int)] * len(sequences)
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
        for at in range(0, len(order), together):
            some = order[at:at + together]
            length = len(sequences[some[-1]])
            scores = np.zeros((len(some), length, len(LABELS)))
            ends = np.array([len(sequences[i]) for i in some])
            for row, i in enumerate(some):
                parts = np.stack([self._part(t) for t in (None, *sequences[i], None)])
                scores[row, :len(parts) - 2] = parts[1:-1, 0] + parts[:-2, 1] + parts[2:, 2]
            best = scores[:, 0] + self.start
            back = np.zeros((len(some), length, len(LABELS)), np.int8)
            final = best.copy()
            for t in range(1, length):
                ways = best[:, :, None] + self.move
                back[:, t] = ways.argmax(axis=1)
                best = ways.max(axis=1) + scores[:, t]
                final[ends == t + 1] = best[ends == t + 1]
            for row, i in enumerate(some):
                labels = np.zeros(ends[row], int)
                labels[-1] = final[row].argmax()
                for t in range(ends[row] - 1, 0, -1):
                    labels[t - 1] = back[row, t, labels[t]]
                answer[i] = labels
        return answer


def windows(text: str) -> Iterator[list[tuple[int, int]]]:
    """Token spans of the pieces of each line that lie within REACH of a token with a digit or at sign."""
    at = 0
    for line in text.split("\n"):
        if TRIGGER.search(line):
            tokens = [m.span() for m in TOKEN.finditer(line)]
            near, last = [], -1
            for i, (a, b) in enumerate(tokens):
                if TRIGGER.search(line, a, b):
                    if near and i - REACH > last:
                        yield [(at + x, at + y) for x, y in near]
                        near = []
                    near += tokens[max(last, i - REACH, 0) if near else max(0, i - REACH):i + REACH + 1]
                    last = min(len(tokens), i + REACH + 1)
            if near:
                yield [(at + x, at + y) for x, y in near]
        at += len(line) + 1


def _acceptable(kind: str, text: str) -> bool:
    """What a span of the field must hold; stricter than its labels."""
    digits = _digits(text)
    if kind == "email":
        return bool(re.fullmatch(r"[\w.%+-]+ ?(?:@|\(at\)|\[at\]) ?[\w-]+(?:(?: ?(?:\.|\(dot\)|\[dot\]) ?)[\w-]+)+", text))
    if kind == "ip":
        parts = re.split(r"\[?\.\]?", text)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return bool(re.fullmatch(r"[0-9 .-]+", text)) and valid("card", digits)
    return bool(re.fullmatch(r"\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}", text)) and 9 <= len(digits) <= 11


def added_spans(texts: Sequence[str], base: Sequence[dict], decoder: Decoder) -> list[dict[str, list[tuple[int, int]]]]:
    """Spans of the field that touch no base span, per text."""
    places, sequences = [], []
    for row, text in enumerate(texts):
        for spans in windows(text):
            places.append((row, spans))
            sequences.append([text[a:b] for a, b in spans])
    added = [{kind: [] for kind in KINDS} for _ in texts]
    for (row, spans), labels in zip(places, decoder.decode(sequences)):
        i = 0
        while i < len(labels):
            kind = LABELS[labels[i]][2:]
            j = i + 1
            while j < len(labels) and kind and LABELS[labels[j]] == "I-" + kind:
                j += 1
            if kind:
                text, a, b = texts[row], spans[i][0], spans[j - 1][1]
                while b > a and not (text[b - 1].isalnum() or text[b - 1] in "])" and text[a] in "[("):
                    b -= 1
                while a < b and not (text[a].isalnum() or text[a] in "(+"):
                    a += 1
                taken = [s for k in KINDS for s in base[row][k]]
                if b > a and _acceptable(kind, text[a:b]) and not any(x < b and a < y for x, y in taken):
                    added[row][kind].append((a, b))
            i = j
    return added


def _listed(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def _finder(weights: Field):
    def find(texts: Sequence[str]) -> tuple[list[dict], list[dict]]:
        base = [base_spans(t) for t in texts]
        added = added_spans(texts, base, decoder)
        return base, [{k: b[k] + a[k] for k in KINDS} for b, a in zip(base, added)]

    decoder = Decoder(weights)
    return find


def detect(docs: DataFrame, table: Sequence | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base, spans) per row of ``docs``.

    Counts and ``base`` are of the patterns' spans, ``spans`` are all; spans are kind:start:end in
    code points, joined by commas. ``table`` holds (tokens, labels) rows to learn from instead of the
    built-in ones. Null texts are empty. Repeated rows and null keys stay. Other columns are not
    read. Texts of any length are held by one task at a time; an empty table gives no rows.
    """
    weights = train(table or labelled_table())
    schema = T.StructType([
        T.StructField(key, docs.schema[key].dataType), *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS],
        T.StructField("base", T.StringType()), T.StructField("spans", T.StringType()),
    ])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(weights)
        for batch in small(batches):
            base, both = find(text_values(batch.column(1)))
            counts = [pa.array([len(b[k]) for b in base], pa.int64()) for k in KINDS]
            lists = [pa.array([_listed(s) for s in spans], pa.string()) for spans in (base, both)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, *lists], names=schema.fieldNames())

    return docs.select(key, text).mapInArrow(look, schema)


def redact(docs: DataFrame, table: Sequence | None = None, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets, and ``length`` set anew.

    Spans that overlap are replaced as one, by the kind that starts first. Null texts stay null.
    """
    weights = train(table or labelled_table())
    place = docs.columns.index(text)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(weights)
        for batch in small(batches):
            texts = text_values(batch.column(place))
            nulls = batch.column(place).is_null().to_pylist()
            new = []
            for content, spans, null in zip(texts, find(texts)[1], nulls):
                found = sorted((a, b, k) for k in KINDS for a, b in spans[k])
                parts, at = [], 0
                for a, b, k in found:
                    if a >= at:
                        parts += [content[at:a], f"<{k}>"]
                    at = max(at, b)
                new.append(None if null else "".join([*parts, content[at:]]) if found else content)
            columns = batch.columns
            columns[place] = pa.array(new, batch.schema.types[place])
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    done = docs.mapInArrow(replace, docs.schema)
    if length in docs.columns:
        done = done.withColumn(length, F.length(text).cast(docs.schema[length].dataType))
    return done.select(*docs.columns)
