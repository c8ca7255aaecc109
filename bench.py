"""Headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from lexgrid import catalogue

HEADLINE = (
    "tokenize", "term_frequency", "document_frequency", "vocab_first_appearance", "index_bm25_v1", "index_tf_ldp", "index_dlite",
    "search_tfidf", "search_bm25_v1", "search_bm25_plus", "search_dlite", "search_tf_ldp", "search_padded", "search_best_by_lang", "recall_overall", "grid_search_bm25",
)


def main() -> None:
    cpus, folder = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "2m")  # the table is one small file; its row groups are dealt to the cores
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    todo = catalogue.queries()
    todo["search_bm25_v1"](spark, folder).write.format("noop").mode("overwrite").save()  # start-up is not measured
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        todo[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
