"""Headline timings as one JSON line.

`build_*` go from raw extracts to silver or gold, `read_*` are warm queries
over the gold tables. The JVM is warmed on the smallest tables first; every
figure is one complete run over the whole tables.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from rotaspark.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=max(cpus, 4), memory=os.environ.get("BENCH_MEMORY", "12g"))
    import testbed.queries_more  # noqa: F401
    from rotaspark.plans import attendance, evidence
    from testbed import queries as q
    from testbed import shape

    done = lambda df: df.write.format("noop").mode("overwrite").save()
    day, scope = "2024-01-10", ("Alpha FR", "Alpha")

    def operate(sf: str) -> None:
        intervals, model = q._intervals(spark, sf), q._model(spark, sf)
        parts = evidence.operate_evidence(
            intervals, attendance.agent_days(model), attendance.attendance_gaps(model), day, *scope
        )
        for part in parts.values():
            part.collect()

    steps = {
        "build_roster": lambda sf: q._roster(spark, sf),
        "build_time_off": lambda sf: q._time_off(spark, sf),
        "build_schedule": lambda sf: q._schedule(spark, sf),
        "build_agent_status": lambda sf: q._status(spark, sf),
        "build_lilo": lambda sf: q._lilo(spark, sf),
        "build_call_legs": lambda sf: q._legs(spark, sf),
        "build_service_intervals": lambda sf: q._intervals(spark, sf),
        "build_attendance": lambda sf: q._model(spark, sf),
        "service_interval_15m": lambda sf: done(q.QUERIES["service_interval_15m"](spark, sf)),
        "bulk_service_intervals": lambda sf: done(q.QUERIES["bulk_service_intervals"](spark, sf)),
        "call_dedup_latest": lambda sf: done(q.QUERIES["call_dedup_latest"](spark, sf)),
        "status_flatten": lambda sf: done(q.QUERIES["status_flatten"](spark, sf)),
        "interval_merge": lambda sf: done(q.QUERIES["interval_merge"](spark, sf)),
        "attendance_day": lambda sf: done(q.QUERIES["attendance_day"](spark, sf)),
        "attendance_gaps": lambda sf: done(q.QUERIES["attendance_gaps"](spark, sf)),
        "staffing_ladder": lambda sf: done(q.QUERIES["staffing_ladder"](spark, sf)),
        "rolling_origin": lambda sf: done(q.QUERIES["rolling_origin"](spark, sf)),
        "read_operate_evidence": operate,
        "read_scope_intervals": lambda sf: evidence.scope_intervals(
            q._intervals(spark, sf), evidence.business_day(day), scope
        ).collect(),
        "read_flash_hours": lambda sf: evidence.flash_hours(
            q._intervals(spark, sf), shape.PROFILES[0], evidence.business_day(day)
        ).collect(),
    }
    small = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    for step in steps.values():
        step(small)
    timings = {}
    for name, step in steps.items():
        begin = time.perf_counter()
        step(sf_dir)
        timings[name] = round(time.perf_counter() - begin, 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "workforce pipeline and read queries",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
