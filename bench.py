"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from cellfleet.catalog import QUERIES
from cellfleet.session import local_session

# One query per phase the reference publishes a time for, and the heavier ones of each family.
HEADLINE = (
    "features", "labelled_windows", "rul_anchors", "warning_lead_times", "directionality", "timescale",
    "ordinal_slopes", "threshold_sensitivity", "telemetry_envelope", "macro_metrics", "family_half_widths",
    "outer_evaluation", "eleven_feature_protocol", "golden_replay", "coverage_report", "mission_span_rul",
    "fleet_prediction", "prognostic_records", "fault_records", "fault_errors", "scenario_summary",
)


def timed(spark, sf_dir: str, names: list[str]) -> dict[str, float]:
    """Seconds per query, after one untimed pass: compiled code is part of a running engine, not of a query."""
    times = {}
    for timing in (False, True):
        for name in names:
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if timing:
                times[name] = round(time.perf_counter() - start, 3)
    return times


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    times = timed(spark, sf_dir, names)
    # The size nearest to the published phases, beside the main one.
    small = os.environ.get("BENCH_SMALL_DIR", os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01"))
    extra = timed(spark, small, names) if small and small != sf_dir and os.path.isdir(small) else {}
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "queries_small": extra,
    }))


if __name__ == "__main__":
    main()
