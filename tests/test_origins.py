"""All origins in one pass against the scores at explicit origins."""

import random
from datetime import date, datetime, timedelta

from rotaspark.plans import forecasting


def test_all_origins_equal_explicit_ones(spark):
    rng, rows = random.Random(2), []
    for scope in ("North", None):
        for d in range(40):
            for clock in (9, 10):
                if rng.random() < 0.8:
                    start = datetime(2026, 3, 1, clock) + timedelta(days=d)
                    rows.append((scope, start.date(), start, float(rng.randrange(50)) if rng.random() < 0.95 else None))
    history = spark.createDataFrame(rows, "s string, business_date date, interval_start timestamp_ntz, actual_volume double").where("s IS NOT NULL")
    days = [r[1] for r in rows if r[0]]
    for horizon, window, season in ((7, 7, 7), (10, 5, 7), (3, 14, 2)):
        origins = [date.fromordinal(o) for o in range(min(days).toordinal() + window, max(days).toordinal() - horizon + 2)]
        got = forecasting.rolling_origins(history, ["s"], horizon, window_days=window, season_days=season)
        want = forecasting.rolling_origin(history, ["s"], origins, horizon, window_days=window, season_days=season)
        columns = ["origin", "s", "business_date", "interval_start", "model_id", "forecast_volume", "actual_volume", "signed_error"]
        rounded = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in df.where("forecast_volume IS NOT NULL").select(columns).collect())
        assert rounded(got) == rounded(want) and len(got.select("origin").distinct().collect()) == len(origins)
    plan = forecasting.rolling_origins(history, ["s"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(s") == 1
