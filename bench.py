"""Seconds per headline query over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import tempfile
import time

from bibliospark.plans import QUERIES
from bibliospark.session import build_session

HEADLINES = [
    "duplicate_groups", "duplicate_resolve", "incoming_duplicate", "build_term_index", "bm25_search", "fts_page_search", "knn_search", "similar_items",
    "hybrid_search", "rrf_term_search", "anchor_tier_a", "coauthor_network", "msc_prefix_counts", "queue_view", "merge_upsert", "assemble_book_doc",
    "note_relations_view", "verify_by_identifier", "context_window", "contiguous_blocks", "page_offset_align", "cross_page_patterns", "locate_passage_exact",
    "classify_pages", "latex_lint_counts", "index_audit", "match_exact", "match_fuzzy", "near_dup_pairs", "stream_queue_state",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINES)).split(",")
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp")})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
