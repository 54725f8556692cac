"""Time the headline queries; prints one JSON line.

Every query is run in full into Spark's no-op sink, so nothing is pruned away
and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from lendlane.catalog.queries import QUERIES
from lendlane.session import local_session

HEADLINE = [
    "eligibility_verdict", "reasons_and_steps", "required_income", "strict_eligibility", "terms_range_join",
    "validate_required", "validate_preflight", "input_guard", "guard_json_batch", "output_guard",
    "policy_lines", "chunk_fixed_stride", "chunk_recursive", "keyword_policy", "knn_exact", "knn_blocked",
    "tfidf_retrieval", "policy_retrieval", "report_short", "report_full", "assess_batch", "audit_log",
    "audit_latest", "kpi_summary", "recent_transactions", "directory_lookup", "chat_history", "chat_fallback",
    "followup_prompt_table", "json_tool", "kpi_refresh_stream", "chunk_sync_stream",
    "terms_interval_join", "orders_in_bands", "audit_upsert", "kpi_from_days", "kpi_latest_stream", "knn_indexed",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "*"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
