"""Rules for forms a lexicon lacks: how they are learned, which one counts, and how well they tell held-out forms."""

from pyspark.sql import functions as F

from voxgrain.operators import lemmas as lm

FORMS = {"livros": "livro", "carros": "carro", "casas": "casa", "ruas": "rua", "cantando": "cantar", "falando": "falar", "ônibus": "ônibus", "bus": "bus", "é": "ser"}


def lexicon(spark, forms):
    return spark.createDataFrame(list(forms.items()), "form string, lemma string")


def test_longest_known_ending_counts(spark):
    rules = lm.ending_rules(lexicon(spark, FORMS))
    got = {r["ending"]: (r["cut"], r["put"], r["forms"]) for r in rules.collect()}
    assert got["s"] == (1, "", 4) and got["os"] == (1, "", 2) and got["as"] == (1, "", 2)
    assert got["us"] == (0, "", 2) and got["ando"] == (3, "r", 2) and got["ndo"] == (3, "r", 2) and "do" not in got
    asked = spark.createDataFrame([(w,) for w in ("pratos", "status", "andando", "os", "s", "rei", "pratos")], "form string")
    assert {r["form"]: r["lemma"] for r in lm.lemmas_by_rule(asked, rules).collect()} == {"pratos": "prato", "status": "status", "andando": "andar"}


def test_texts_with_unseen_words(spark):
    df = spark.createDataFrame([(1, "livros e pratos"), (2, None), (3, "")], "id long, text string")
    table = lexicon(spark, FORMS)
    whole = lm.completed(df, "text", table, lm.ending_rules(table))
    found = lm.lemmatize(df, "text", "lemmas", "id", whole)
    assert {r["id"]: r["lemmas"] for r in found.collect()} == {1: "livro e prato", 2: None, 3: ""}


def test_held_out_forms(spark):
    """Regular plurals and gerunds learned from half of the forms tell the other half."""
    stems = [f"{a}{b}{c}" for a in ("cas", "port", "mes", "livr", "carr") for b in "aeio" for c in ("l", "n", "t", "d")]
    forms = {f"{s}o{e}": f"{s}o" for s in stems for e in ("s",)} | {f"{s}ando": f"{s}ar" for s in stems} | {f"{s}idade": f"{s}idade" for s in stems}
    items = sorted(forms.items(), key=lambda f: f[0][::-1])
    known, held = dict(items[::2]), dict(items[1::2])
    rules = lm.ending_rules(lexicon(spark, known))
    found = {r["form"]: r["lemma"] for r in lm.lemmas_by_rule(lexicon(spark, held).select("form"), rules).collect()}
    right = sum(found.get(f) == lemma for f, lemma in held.items())
    assert right / len(held) >= 0.95


def test_empty_lexicon(spark):
    none = lexicon(spark, FORMS).where("false")
    assert lm.ending_rules(none).collect() == []
    df = spark.createDataFrame([("a b",)], "text string")
    assert lm.completed(df, "text", none, lm.ending_rules(none)).where(F.col("form") == "a").collect() == []
