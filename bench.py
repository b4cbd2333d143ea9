"""Times the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES=all to time every registered query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from goldpan.plans import load  # noqa: E402
from goldpan.session import local_session  # noqa: E402

HEADLINE = [
    "a01_jsonl_scan", "a08_verified_publish",
    "b07_primary_keys", "b11_name_matching", "b15_object_counts", "b19_integrity", "b20_schema_text",
    "b08_foreign_keys", "b21_description_files", "b22_column_descriptions", "d01_audited_run",
    "d02_batch_audit", "e11_column_rollup", "e12_top_columns", "h06_screening_summary",
    "c02_unique_key", "c04_positional_order", "c07_reference_match", "c13_message_shape",
    "d05_read_only_guard", "d11_exclusion_cascade", "d12_reward_manifest",
    "e02_bounded_scan", "e07_index_build", "e10_bm25", "e13_grounding_lines",
    "f02_extract_reasoning_sql", "f06_plain_dataset", "f07_grounded_dataset", "f15_completion_labels",
    "g01_execution_match", "g05_partial_score", "g06_prediction_scoring",
    "h01_result_vote", "h02_cluster_support", "h04_prompt_screening", "h09_group_advantage",
    "i03_system_metrics", "i05_transitions", "i09_length_distribution", "i12_truncation",
    "i15_latency_report", "j04_seeded_order",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "goldpan-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    names = list(queries) if os.environ.get("BENCH_QUERIES") == "all" else HEADLINE
    # One pass over the data first, so that no query pays for starting the JVM and workers.
    queries["i02_evaluation_metrics"](spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": f"{len(times)} registered queries, total wall-clock",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").rsplit("/", 1)[-1].removeprefix("sf"),
            }
        ),
        flush=True,
    )


if __name__ == "__main__":
    main()
