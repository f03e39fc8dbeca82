"""Time the headline queries: prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from voxgrain.plans import registry
from voxgrain.plans.session import get_session

HEADLINE = (
    "hourly_sentiment", "clean_text", "clean_valid", "dedup_lemmatized", "redact_pii", "pii_hits", "candidate_fanout",
    "relevance_topk", "describe_length", "term_top100", "duplicate_counts", "quality_scores", "weak_label", "strat_folds",
    "vocab", "tfidf_long", "classification_report", "platform_matrix", "lang_id", "prediction_stats",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    spark.read.parquet(f"{folder}/documents.parquet").count()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
