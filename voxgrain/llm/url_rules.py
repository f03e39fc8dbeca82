"""URL filtering by association rules.

A URL is a set of tokens from its host and path. FP-growth mines the token combinations that are
frequent in labelled URLs; a combination's share of blocked URLs is the confidence of the rule
"these tokens, so block" and one minus it that of "allow". Rules that a shorter rule with at least
the same confidence already covers are pruned. An inverted index lists each rule under its rarest
token; a URL looks its tokens up there and a rule found this way holds if the URL has all of its
tokens. Everything is done once per distinct set of tokens.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from voxgrain.llm.common import stored

MOST_TOKENS = 4
"""Tokens of a rule at most."""

RULE_BYTES = 64 << 20
"""A rule index of more bytes than this is joined by shuffling, not sent to all tasks."""


def host_of(url: str) -> Column:
    """After the first :// up to a slash, question or hash mark, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    """After the host up to a question or hash mark; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: str, path: str, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest of the given (verdict, "host/path") rules that fits, as a struct, else null.

    A rule fits its host and all subdomains if the path starts with the rule's. Rules of one length
    count in the order given.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, start = rule.partition("/")
        here = (F.col(host) == domain) | F.col(host).endswith("." + domain)
        fits = here & F.col(path).startswith(slash + start)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens(host: str, path: str) -> Column:
    """Sorted distinct tokens: host labels and endings by place, path parts with digits as one kind."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    ending = F.concat(F.lit("tld:"), F.regexp_extract(host, r"([^.]*)$", 1))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    kinds = F.transform(parts, lambda x, i: F.concat(F.lit("p"), F.least(i, F.lit(3)).cast("string"), F.lit(":"), F.regexp_replace(F.lower(x), "[0-9]+", "0")))
    named = F.transform(labels, lambda x: F.concat(F.lit("h:"), x))
    return F.array_sort(F.array_distinct(F.concat(F.array(ending), named, kinds)))


def held(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Each row of ``sets`` (tokens, ...) with each of the ``rules`` (rule_id, items, ...) whose items it has all."""
    listed = rules.select("rule_id", F.explode("items").alias("token"))
    times = listed.groupBy("token").agg(F.count(F.lit(1)).alias("times"))
    rarest = listed.join(times, "token").groupBy("rule_id").agg(F.min(F.struct("times", "token")).getField("token").alias("token"))
    index = stored(rarest.join(rules, "rule_id"), "rule-index")
    size = index.select(F.sum(F.length(F.concat_ws(" ", "items")) + 100)).first()[0] or 0
    looked = F.broadcast(index) if size <= RULE_BYTES else index
    return sets.withColumn("token", F.explode("tokens")).join(looked, "token").where(F.size(F.array_except("items", "tokens")) == 0)


def mine(
    labelled: DataFrame, support: float = 0.005, confidence: float = 0.6, blocked: str = "block"
) -> DataFrame:
    """(rule_id, items, verdict, confidence, support) from (tokens, verdict) rows.

    A rule's support is its share of the labelled rows. Rows without tokens or verdict are passed
    over; no rows give no rules.
    """
    rows = stored(
        labelled.where((F.size("tokens") > 0) & F.col("verdict").isNotNull())
        .select("tokens", (F.col("verdict") == blocked).cast("long").alias("blocked")), "labelled-urls"
    )
    total = rows.count()
    if not total:
        return rows.select(F.lit(0).alias("rule_id"), F.col("tokens").alias("items"), F.lit("").alias("verdict"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support")).limit(0)

    model = FPGrowth(itemsCol="tokens", minSupport=min(1.0, support), minConfidence=1.0).fit(rows)
    every = stored(
        model.freqItemsets.where(F.size("items") <= MOST_TOKENS)
        .select(F.xxhash64(F.array_sort("items")).alias("rule_id"), F.array_sort("items").alias("items"), F.col("freq").alias("n")), "frequent-items"
    )
    # Blocked rows are counted for every item set, however rare the verdict is.
    sets = rows.where("blocked = 1").groupBy("tokens").agg(F.count(F.lit(1)).alias("times_blocked"))
    bad = held(sets, every.select("rule_id", "items")).groupBy("rule_id").agg(F.sum("times_blocked").alias("bad"))
    both = every.join(bad, "rule_id", "left").withColumn("share", F.coalesce("bad", F.lit(0)) / F.col("n"))
    verdict = F.when(F.col("share") >= 0.5, F.lit(blocked)).otherwise(F.lit("allow"))
    sure = F.greatest("share", 1 - F.col("share"))
    rules = stored(
        both.select("items", verdict.alias("verdict"), sure.alias("confidence"), (F.col("n") / F.lit(total)).alias("support"), "rule_id")
        .where(F.col("confidence") >= confidence), "rules"
    )
    # A rule goes if dropping tokens gives a rule of the same verdict that is at least as sure.
    smaller = rules.select(F.col("items").alias("part"), F.col("verdict").alias("same"), F.col("confidence").alias("sure"))
    parts = F.array_compact(F.flatten(F.array(
        F.transform(F.col("items"), lambda x: F.array(x)), F.transform(F.col("items"), lambda x: F.array_remove(F.col("items"), x))
    )))
    covered = rules.where(F.size("items") > 1).select("rule_id", "verdict", "confidence", F.explode(F.array_distinct(parts)).alias("part"))
    covered = covered.join(smaller, "part").where((F.col("verdict") == F.col("same")) & (F.col("sure") >= F.col("confidence")))
    return stored(rules.join(covered, "rule_id", "left_anti").select("rule_id", "items", "verdict", "confidence", "support"), "pruned-rules")


def apply_rules(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(tokens, verdict, rule_items) per distinct token set of ``urls``.

    Of the rules that hold, the surest counts, then the one with more tokens, then more support.
    Token sets without a rule get ``default``.
    """
    sets = urls.select("tokens").distinct().withColumn("set_id", F.xxhash64("tokens"))
    hits = held(sets, rules)
    best = hits.groupBy("set_id").agg(F.max(F.struct("confidence", F.size("items").alias("size"), "support", "items", "verdict")).alias("best"))
    return sets.join(best, "set_id", "left").select(
        "tokens", F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.col("best.items").alias("rule_items")
    )


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str]], labels: DataFrame | None = None, support: float = 0.005,
    confidence: float = 0.6, default: str = "allow", key: str = "page_id", url: str = "url",
) -> DataFrame:
    """(key, host, path, rule, verdict, mined): given rules first, mined ones for the rest.

    Rules are mined from ``labels`` (url, verdict), or from the pages that a given rule decides.
    Null URLs and those without :// have empty host and path and one token, the empty ending.
    Repeated rows and null keys stay. Other columns are not read. An empty table gives no rows.
    """
    parts = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"))
    seen = parts.select("_key", host_of("_url").alias("host"), path_of("_url").alias("path"))
    seen = seen.withColumn("found", longest_rule("host", "path", rules)).withColumn("tokens", tokens("host", "path"))
    if labels is None:
        known = seen.select("tokens", F.col("found.verdict").alias("verdict"))
    else:
        known = labels.select(host_of("url").alias("host"), path_of("url").alias("path"), "verdict").select(tokens("host", "path").alias("tokens"), "verdict")
    mined = mine(known, support, confidence)
    unruled = seen.where(F.col("found").isNull())
    verdicts = apply_rules(unruled, mined, default).select(F.col("tokens").alias("_tokens"), F.col("verdict").alias("_verdict"), "rule_items")
    open_rows = unruled.join(verdicts, unruled["tokens"] == verdicts["_tokens"]).select(
        F.col("_key").alias(key), "host", "path", F.lit(None).cast("string").alias("rule"), F.col("_verdict").alias("verdict"),
        F.array_join("rule_items", " ").alias("mined"),
    )
    ruled = seen.where(F.col("found").isNotNull()).select(
        F.col("_key").alias(key), "host", "path", "found.rule", "found.verdict", F.lit(None).cast("string").alias("mined")
    )
    return ruled.union(open_rows)
