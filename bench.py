"""Benchmark the headline queries; prints one JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_QUERIES (comma list, default the headline set below).
Each query is executed in full into Spark's ``noop`` sink (no driver collect)
and timed once.  Before timing, the flagship and summary queries run once on
the sf0.001 tables (untimed) so JIT and code generation are warm.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docweave.plans.registry import QUERIES  # noqa: E402
from docweave.plans.sizing import remove_staged  # noqa: E402
from docweave.session import build_session  # noqa: E402

WARM_DIR = "/root/testdata/sf0.001"
HEADLINE = [
    "answer_context", "summary_context", "top_k_inner_product", "top_k_cosine",
    "extract_keywords", "hashing_embedder", "split_fragments", "pack_batches", "batch_totals",
    "html_fragments", "reflow_lines", "new_documents", "document_frequency", "sif_mean_vector",
    "central_fragments", "detect_language", "chat_cost", "chat_pairs",
    "cut_to_budget", "detected_documents", "embed_fragments", "hashing_embedder_wide", "html_fallback",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=cpus)
    for warm in ("answer_context", "summary_context", "detect_language"):
        QUERIES[warm](spark, WARM_DIR).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
        remove_staged(spark)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
