"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; one JSON line."""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time

from kymora import local_session
from kymora.plans import catalog

HEADLINE = (
    "quality_levels", "mixing_accuracy", "error_structure_accuracy", "window_kappa", "burst_windows", "stitched_windows",
    "epoch_cut", "artifact_overlap", "latest_after_latency", "evidence_accumulation", "shared_command", "direction_reversals",
    "continuous_dwell", "episode_summary", "outcome_counts", "time_to_target", "moving_standardise", "condition_estimates",
    "score_blocks", "interaction_model", "trade_off_bootstrap", "report_quality_sweep", "bursts_drawn", "grid_coverage",
    "synthetic_posteriors", "spatial_covariance", "band_log_power", "stream_sliding_windows", "stream_evidence",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    queries = catalog.queries()
    times: dict[str, float] = {}
    with contextlib.redirect_stdout(sys.stderr):
        spark = local_session(cpus, "kymora-bench", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
        spark.sparkContext.setLogLevel("ERROR")
        queries["effective_accuracy"](spark, folder).write.format("noop").mode("overwrite").save()  # start the engine
        for name in only or HEADLINE:
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
            print(name, times[name], flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
