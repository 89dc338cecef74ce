"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Each query is executed to completion with the ``noop`` sink (no collect).
"""
from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "word_idf", "term_freq", "bigram_freq", "gram_freq", "cohesion", "pmi",
    "diff_candidates", "candidate_features", "final_terms", "threshold_diff", "rank_boost", "classify",
    "char_right_entropy", "keywords", "label_conflicts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from termspark.plans import catalog
    from termspark.session import local_session

    spark = local_session(cpus, int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")),
                          checkpoint_dir=tempfile.mkdtemp(prefix="termspark-bench-"))
    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for n in names:
        t0 = time.time()
        try:
            catalog.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[n] = round(time.time() - t0, 3)
        except Exception as e:  # noqa: BLE001
            errors[n] = f"{type(e).__name__}: {str(e)[:200]}"
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_query_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
