"""Small tables for the edge cases, and plain versions of what the operators share."""

from __future__ import annotations

from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
CLASHING = (
    "ids n part place start length sequence_id offset fp least label component class kept key size draw slot rate copies amount "
    "extra taken target stats score predicted y fold word bucket halo order first also to rep links tree v leaf found tokens verdict base "
    "_row _kept _part _copies _extra _key _draw _source _doc _hash _id _from _place _found _first _at _sum met near own"
).split()

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
MESSY = [
    (1, "One fine text about the river and the hills beyond it, told twice.", "s1"),
    (2, "One fine text about the river and the hills beyond it, told twice.", "s1"),
    (2, "One fine text about the river and the hills beyond it, told twice.", "s1"),
    (3, None, "s1"), (4, "", None), (5, " \n\t ", None), (6, LONG, "s2"), (7, LONG + " end", "s2"),
    (8, "short", "s3"), (9, "é ß ñ 😀 " * 30, "s3"), (10, "Call (743) 555-3824 or write a.b@c.example.org now", "s1"), (None, "no key here", "s2"),
]


def messy(spark, rows=MESSY):
    """Documents with every edge case and many columns whose names operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df = df.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"))
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHING])


def no_rows(spark):
    return messy(spark).where("false")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def texts_of(spark, folder=SMALL):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}


def joined(links, nodes):
    """Smallest node of each node's component, by plain union."""
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}
