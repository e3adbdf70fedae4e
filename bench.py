"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries": {...}, "sf"}.
Each query is fully computed through the no-op sink (no collect to the
driver).  Every query runs once untimed (JIT, code generation) and once
timed; the timed run includes building the DataFrame (planning).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from coverlens.plans import registry  # noqa: E402
from coverlens.session import local_session  # noqa: E402

HEADLINE = [
    "pass_at_k_by_run",      # flagship: extract -> normalise -> grade -> pass@k per run
    "extract_answers",       # per-row extraction + normalisation + grading, all rows out
    "grade_generations",     # grading cascade on every answer shape
    "pass_at_k_outcomes",    # estimator on pre-graded samples
    "group_advantages",      # rollout advantages (window per group)
    "padded_batches",        # padded batch layout
    "token_loss_metrics",    # loss diagnostics over the token table (lineitem)
    "forward_trace",         # synthetic chain traces
    "first_token_fanout",    # top-k + cyclic fan-out (lineitem)
    "response_length",       # whole-document token counts
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="coverlens-bench")
    qs = registry.queries()
    times = {}
    for key in HEADLINE:
        qs[key](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        t0 = time.perf_counter()
        qs[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
