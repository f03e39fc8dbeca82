import hashlib

import pytest
from pyspark.sql import functions as F

from voxgrain.functions import privacy as pv
from voxgrain.functions import sampling as sa
from voxgrain.functions import stats
from voxgrain.functions import text as tx
from voxgrain.operators import labels as la


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column).first()[0]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Olá @ana! Veja HTTP://x.com/a?b=1 #brasil  É ótimo…", "olá veja é ótimo"),
        (None, ""), ("", ""), ("http://" + "a" * 20000, ""), ("http://a.com/x~y", "y"), ("http://a.com/x#y", ""), ("a  b\u001cc", "a b c"),
    ],
)
def test_clean_text(spark, text, expected):
    assert one(spark, tx.clean_text("t"), text) == expected


@pytest.mark.parametrize("text", ["Olá, @x mundo!", "a  b\tc", "É #tag ½ dia", "x_y-z"])
def test_cleaning_twice_changes_nothing(spark, text):
    once = one(spark, tx.clean_text("t"), text)
    assert one(spark, tx.clean_text("t"), once) == once


@pytest.mark.parametrize(
    "text, expected",
    [
        ("a@b.co", "[EMAIL]"), ("(11) 98765-4321", "([TELEFONE]"), ("+55 11 98765-4321", "+55 [TELEFONE]"),
        ("123.456.789-09", "[CPF]"), ("12345678909", "[CPF]"), ("12945678909", "[TELEFONE]"),
        ("nota 20250101", "nota [TELEFONE]"), ("é12345678", "é12345678"),
        ("ver https://www.Instagram.com/ana_1 hoje", "ver [PERFIL_SOCIAL] hoje"), (None, None),
    ],
)
def test_redact(spark, text, expected):
    assert one(spark, pv.redact("t"), text) == expected


def test_hits_count_replacements(spark):
    text = "a@b.co c@d.org 123.456.789-09"
    counts = spark.createDataFrame([(text,)], "t string").select(*[c.alias(k) for k, c in pv.hit_counts("t").items()]).first()
    assert counts.asDict() == {"email": 2, "phone": 0, "cpf": 1, "social_profile": 0}


def test_hashes(spark):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert one(spark, pv.salted_pseudonym("t", F.lit("reddit"), "s"), "ana") == digest("reddit:ana:s")[:16]
    assert one(spark, pv.full_hash("t"), "ana") == digest("ana")
    assert one(spark, pv.short_hash("t"), None) == digest("deleted")[:12]
    assert one(spark, pv.salted_pseudonym("t", F.lit("reddit"), "s"), None) is None
    assert one(spark, pv.full_hash("t"), None) is None
    with pytest.raises(ValueError):
        pv.salted_pseudonym("t", F.lit("reddit"), "")


def test_full_text_and_keywords(spark):
    df = spark.createDataFrame([("a", "b"), ("a", ""), ("a", None)], "t string, s string")
    assert [r[0] for r in df.select(tx.full_text("t", "s")).collect()] == ["a b", "a", "a"]
    assert one(spark, tx.matched_keywords("t", ["EUA", "taxa"]), "Taxas dos eua") == ["EUA", "taxa"]
    assert one(spark, tx.occurrences("t", F.lit("aa")), "aAaab") == 2


def test_terms_and_display(spark):
    assert one(spark, tx.words_and_bigrams(tx.tokens("t")), "Um dia é bom") == ["um", "dia", "bom", "um dia", "dia bom"]
    assert one(spark, tx.words_and_bigrams(tx.tokens("t")), "") == []
    assert one(spark, tx.shorten("t"), "x" * 101) == "x" * 100 + "..."
    assert one(spark, tx.shorten("t"), "x" * 100) == "x" * 100
    assert one(spark, tx.slug("t"), "Taxas A-B") == "taxas_a_b"


def test_draw_depends_on_key_alone(spark):
    expected = int(hashlib.md5(b"42:7").hexdigest()[:8], 16)
    assert spark.range(7, 8).select(sa.draw("id")).first()[0] == expected


def test_percent(spark):
    df = spark.createDataFrame([(1, 3), (0, 0), (1241, 2000)], "a long, b long")
    assert [r[0] for r in df.select(stats.percent("a", "b")).collect()] == [33.3333, 0.0, 62.05]
    assert [r[0] for r in df.select(stats.percent_tenths("a", "b")).collect()] == [33.3, 0.0, 62.1]


def test_weak_label_and_codes(spark):
    assert one(spark, la.weak_label("t", F.lit(1)), "Bom e ÓTIMO, mas ruim") == "positive"
    assert one(spark, la.weak_label("t", F.lit(1)), "um erro e um problema") == "negative"
    assert one(spark, la.word_hits("t", ["bom"]), "bombom bom") == 1
    assert one(spark, la.word_hits("t", ["bom"], whole_words=True), "bombom") == 0
    assert one(spark, la.label_code("t"), "neutral") == 1
    assert one(spark, la.label_code("t", strict=False), "other") is None
    with pytest.raises(Exception, match="unknown label"):
        one(spark, la.label_code("t"), "other")


def test_tie_odds(spark):
    drawn = spark.range(20000).select(la.weak_label(F.lit("x"), "id").alias("s")).groupBy("s").count().collect()
    shares = {r["s"]: r["count"] / 20000 for r in drawn}
    assert abs(shares["neutral"] - 0.6) < 0.02 and abs(shares["positive"] - 0.2) < 0.02


def test_cleaning_is_the_same_in_fewer_steps(spark):
    texts = ["a@b #c d http://x.y/z e", "  A\u00a0-- b_c\t\n!", "h\u00e9 \u0130 \u4e2d,\u6587", "#", "", None, "x@http://q r", "...", "a \x1c b\x85c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    lowered = F.lower(F.coalesce("t", F.lit("")))
    steps = tx.squeeze_spaces(F.regexp_replace(tx.remove_hashtags(tx.remove_mentions(tx.remove_urls(lowered))), tx.NON_WORD_PATTERN, " "))
    for r in df.select(tx.clean_text("t").alias("a"), steps.alias("b")).collect():
        assert r["a"] == r["b"]
