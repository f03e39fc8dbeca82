"""Long word lists against a search word by word."""

import random

from voxgrain.functions import text as tx
from voxgrain.functions import word_lists
from voxgrain.operators import labels as la

LETTERS = "abcdeéñ "


def test_ten_thousand_words_in_one_reading(spark):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    words = [make(rng.randrange(3, 8)).title() for _ in range(9_998)] + ["", "ABC"]
    texts = [make(rng.randrange(0, 400)).upper() for _ in range(60)] + [None, "", "abc"]
    df = spark.createDataFrame(enumerate(texts), "id long, t string")
    found = df.select("id", tx.matched_keywords("t", words).alias("w"), tx.has_keyword("t", words).alias("has"), la.word_hits("t", [w.lower() for w in words]).alias("n"))
    for r in found.collect():
        text = texts[r["id"]]
        wanted = [w for w in words if text is not None and w.lower() in text.lower()]
        assert r["w"] == wanted
        assert (r["has"], r["n"]) == ((None, None) if text is None else (bool(wanted), len(wanted)))


def test_short_and_long_lists_agree(spark, monkeypatch):
    df = spark.createDataFrame([("O dólar e o EURO subiram",), ("nada",), (None,)], "t string")
    words = ["dólar", "Euro", "euro", "libra", "sub"]
    columns = lambda: [tx.matched_keywords("t", words).alias("a"), tx.has_keyword("t", words).alias("b"), la.word_hits("t", words).alias("c")]
    short = df.select(*columns()).collect()
    for module in (tx, la):
        monkeypatch.setattr(module, "MANY_WORDS", 2)
    assert df.select(*columns()).collect() == short
    assert word_lists.MANY_WORDS == 64
