"""Forecast baselines, accuracy, vintages and selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rotaspark.functions.temporal import NTZ


def _ratio(top, bottom):
    return top / F.nullif(bottom, F.lit(0))


def interval_errors(forecast: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """DX-01: signed and absolute error where both sides are known."""
    joined = forecast.join(actual, list(keys))
    return joined.withColumn(
        "signed_error", F.col("forecast_volume") - F.col("actual_volume")
    ).withColumn("absolute_error", F.abs("signed_error"))


def accuracy(errors: DataFrame, by: Sequence[str]) -> DataFrame:
    """DX-02: bias, WAPE, MAE, RMSE and MAPE.

    WAPE is total absolute error over total actual; bias is total signed error
    over total actual. MAPE averages over rows with a non-zero actual. A zero
    denominator gives NULL.
    """
    actual, absolute = F.col("actual_volume"), F.col("absolute_error")
    return errors.groupBy(*by).agg(
        F.count("*").alias("interval_count"),
        _ratio(F.sum("signed_error"), F.sum("actual_volume")).alias("bias"),
        _ratio(F.sum("absolute_error"), F.sum("actual_volume")).alias("wape"),
        F.avg("absolute_error").alias("mae"),
        F.sqrt(F.avg(F.pow("signed_error", F.lit(2.0)))).alias("rmse"),
        F.avg(_ratio(absolute, actual)).alias("mape"),
    )


def seasonal_naive(history: DataFrame, keys: Sequence[str], value: str = "actual_volume", days: int = 7) -> DataFrame:
    """DX-03: the value of the same weekday and interval `days` days before.

    The history is moved forward and re-keyed; no self join is needed, and a
    target without history has no forecast row.
    """
    step = F.make_dt_interval(F.lit(days))
    return history.select(
        *keys,
        F.date_add("business_date", days).alias("business_date"),
        (F.col("interval_start") + step).alias("interval_start"),
        F.col(value).cast("double").alias("forecast_volume"),
    ).withColumn("model_id", F.lit("seasonal_naive"))


def recent_mean(history: DataFrame, keys: Sequence[str], value: str = "actual_volume", window_days: int = 7) -> DataFrame:
    """DX-03: mean of the same interval-of-day over the `window_days` days before.

    Each observation is sent to the days it informs and averaged there, so the
    aggregation combines before the shuffle and no series is sorted whole.
    """
    offset = F.explode(F.sequence(F.lit(1), F.lit(window_days)))
    moved = history.select(
        *keys, "business_date", "interval_start", F.col(value).cast("double").alias("_v"), offset.alias("_d")
    )
    target = moved.select(
        *keys,
        F.date_add("business_date", F.col("_d")).alias("business_date"),
        (F.col("interval_start") + F.make_dt_interval(F.col("_d"))).alias("interval_start"),
        "_v",
    )
    means = target.groupBy(*keys, "business_date", "interval_start").agg(F.avg("_v").alias("forecast_volume"))
    # Days after the last observed one stay: they are the forecast proper.
    return means.withColumn("model_id", F.lit("recent_mean"))


def last_value(history: DataFrame, keys: Sequence[str], value: str = "actual_volume") -> DataFrame:
    """DX-08: the latest known value per series."""
    return history.groupBy(*keys).agg(
        F.max_by(F.col(value).cast("double"), "interval_start").alias("forecast_volume"),
        F.max("interval_start").alias("last_observed"),
    ).withColumn("model_id", F.lit("last_value"))


def vintage_asof(forecasts: DataFrame, keys: Sequence[str], as_of) -> DataFrame:
    """DX-05: latest vintage created at or before a moment, per target."""
    moment = F.lit(as_of).cast(NTZ) if not hasattr(as_of, "_jc") else as_of
    known = forecasts.filter(F.col("forecast_created_at") <= moment)
    return known.groupBy(*keys).agg(
        F.max("forecast_created_at").alias("forecast_created_at"),
        F.max_by("forecast_volume", F.struct("forecast_created_at", "model_id")).alias("forecast_volume"),
        F.max_by("model_id", F.struct("forecast_created_at", "model_id")).alias("model_id"),
    )


def select_model(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """SL-04 / PR-11: least (WAPE, |bias|, MAE, model id) per group."""
    order = F.struct("wape", F.abs("bias").alias("abs_bias"), "mae", "model_id")
    rows = scores.filter("wape IS NOT NULL")
    best = rows.groupBy(*by).agg(
        F.min_by(F.struct("model_id", "wape", "bias", "mae"), order).alias("best")
    )
    return best.filter("best IS NOT NULL").select(*by, "best.*")


def rolling_origin(
    history: DataFrame,
    keys: Sequence[str],
    origins: Sequence,
    horizon_days: int = 7,
    value: str = "actual_volume",
    window_days: int = 7,
    season_days: int = 7,
) -> DataFrame:
    """DX-04: errors of the baselines at each origin, over the days after it.

    A model at an origin sees only days before it. Origins are a short
    driver-side list, and a row is sent only to those it may inform or test.
    The mean is taken over `window_days`. The seasonal value of a test day is
    the latest day before the origin that lies whole seasons back.
    """
    day = F.col("business_date")
    seasons = -(-horizon_days // season_days)
    back = max(window_days, seasons * season_days)
    dates = F.filter(
        F.array(*[F.lit(o).cast("date") for o in origins]),
        lambda o: F.datediff(day, o).between(-back, horizon_days - 1),
    )
    aged = history.select(
        *keys, "business_date", "interval_start", F.col(value).cast("double").alias("actual_volume"),
        F.explode(dates).alias("origin"),
    ).withColumn("_age", F.datediff(day, F.col("origin")))
    clock = F.date_format("interval_start", "HH:mm")
    aged = aged.withColumn("_clock", clock)
    train = aged.filter((F.col("_age") < 0) & (F.col("_age") >= -window_days))
    test = aged.filter(F.col("_age") >= 0)
    mean = train.groupBy("origin", *keys, "_clock").agg(F.avg("actual_volume").alias("forecast_volume"))
    mean = mean.withColumn("model_id", F.lit("recent_mean"))
    scored_mean = test.join(mean, ["origin", *keys, "_clock"])
    last_season = aged.filter((F.col("_age") < 0) & (F.col("_age") >= -season_days))
    ahead = F.explode(F.sequence(F.lit(season_days), F.lit(seasons * season_days), F.lit(season_days)))
    naive = last_season.select(
        "origin", *keys, "_clock", "business_date", F.col("actual_volume").alias("forecast_volume"), ahead.alias("_ahead")
    ).select(
        "origin", *keys, "_clock", F.date_add("business_date", F.col("_ahead")).alias("business_date"), "forecast_volume",
        F.lit("seasonal_naive").alias("model_id"),
    )
    scored_naive = test.join(naive, ["origin", *keys, "_clock", "business_date"])
    columns = ["origin", *keys, "business_date", "interval_start", "model_id", "forecast_volume", "actual_volume"]
    both = scored_mean.select(columns).unionByName(scored_naive.select(columns))
    return both.withColumn("signed_error", F.col("forecast_volume") - F.col("actual_volume")).withColumn(
        "absolute_error", F.abs("signed_error")
    )


def rolling_origins(
    history: DataFrame,
    keys: Sequence[str],
    horizon_days: int = 7,
    value: str = "actual_volume",
    window_days: int = 7,
    season_days: int = 7,
) -> DataFrame:
    """DX-04 for every origin of the data: each day with a whole window before it and a whole horizon from it on.

    Rows are not copied to the origins they inform. Per series and interval of
    day, running counts and sums up to each earlier day are kept beside a row,
    and the mean at any origin is a difference of two of them; so one ordering
    of each series serves all origins. Only the results are a row per origin.
    """
    day = F.datediff("business_date", F.lit("1970-01-01").cast("date"))
    rows = history.select(
        *keys, "business_date", "interval_start", F.col(value).cast("double").alias("actual_volume"),
        F.date_format("interval_start", "HH:mm").alias("_clock"), day.alias("_day"), F.lit(1).alias("_one"),
    )
    series = Window.partitionBy(*keys, "_clock").orderBy("_day")

    def until(days: int) -> Window:
        return series.rangeBetween(Window.unboundedPreceding, -days)

    steps = sorted({k + 1 for k in range(horizon_days)} | {k + 1 + window_days for k in range(horizon_days)})
    seasons = sorted({season_days * (k // season_days + 1) for k in range(horizon_days)})
    sums = [F.struct(F.count("actual_volume").over(until(j)).alias("n"), F.coalesce(F.sum("actual_volume").over(until(j)), F.lit(0.0)).alias("s")).alias(f"_p{j}") for j in steps]
    past = [F.max("actual_volume").over(series.rangeBetween(-j, -j)).alias(f"_v{j}") for j in seasons]
    summed = rows.select("*", *sums, *past)

    def models(k: int) -> list:
        near, far = F.col(f"_p{k + 1}"), F.col(f"_p{k + 1 + window_days}")
        mean = (near["s"] - far["s"]) / F.nullif(near["n"] - far["n"], F.lit(0))
        naive = F.col(f"_v{season_days * (k // season_days + 1)}")
        origin = F.date_sub("business_date", k)
        return [
            F.struct(origin.alias("origin"), F.lit(name).alias("model_id"), volume.alias("forecast_volume"))
            for name, volume in (("recent_mean", mean), ("seasonal_naive", naive))
        ]

    made = F.array(*[m for k in range(horizon_days) for m in models(k)])
    ends = history.agg(
        F.date_add(F.min("business_date"), window_days).alias("_first"),
        F.date_sub(F.max("business_date"), horizon_days - 1).alias("_last"), F.lit(1).alias("_one"),
    )
    errors = summed.select(*keys, "business_date", "interval_start", "actual_volume", "_one", F.explode(made).alias("m"))
    errors = errors.where("m.forecast_volume IS NOT NULL").join(F.broadcast(ends), "_one")
    errors = errors.where(F.col("m.origin").between(F.col("_first"), F.col("_last")))
    return errors.select("m.origin", *keys, "business_date", "interval_start", "m.model_id", "m.forecast_volume", "actual_volume").withColumn(
        "signed_error", F.col("forecast_volume") - F.col("actual_volume")
    ).withColumn("absolute_error", F.abs("signed_error"))


def bottom_up(volumes: DataFrame, levels: Sequence[str], value: str = "actual_volume", *also: str) -> DataFrame:
    """DX-06: totals of every level of a hierarchy; `level` counts the fixed levels."""
    rolled = volumes.rollup(*levels).agg(F.sum(value).alias(value), F.grouping_id().alias("_gid"))
    depth = sum(
        (F.when((F.shiftright(F.col("_gid"), i) % 2) == 0, 1).otherwise(0) for i in range(len(levels))), F.lit(0)
    )
    return rolled.withColumn("level", depth).drop("_gid")


def lag_features(history: DataFrame, keys: Sequence[str], value: str = "actual_volume", minutes: int = 15) -> DataFrame:
    """DX-07: the values one and two intervals before, matched on time, not on row order."""
    base = history.select(*keys, "interval_start", F.col(value).cast("double").alias("y"))

    def shifted(n: int) -> DataFrame:
        step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes * n))
        return base.select(*keys, (F.col("interval_start") + step).alias("interval_start"), F.col("y").alias(f"lag_{n}"))

    on = [*keys, "interval_start"]
    return base.join(shifted(1), on).join(shifted(2), on)


def linear_lag_model(features: DataFrame, by: Sequence[str]) -> DataFrame:
    """DX-07: least-squares fit of y on its two lags per series, from summed moments.

    One aggregate collects the sums; the 2x2 normal equations on centred
    moments are then solved in columns. Collinear lags give NULL coefficients.
    """
    y, a, b = F.col("y"), F.col("lag_1"), F.col("lag_2")
    s = features.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(y).alias("my"), F.avg(a).alias("ma"), F.avg(b).alias("mb"),
        F.covar_pop(a, a).alias("saa"), F.covar_pop(b, b).alias("sbb"), F.covar_pop(a, b).alias("sab"),
        F.covar_pop(a, y).alias("say"), F.covar_pop(b, y).alias("sby"),
    )
    det = F.col("saa") * F.col("sbb") - F.col("sab") * F.col("sab")
    safe = F.when(F.abs(det) > 1e-9, det)
    fit = s.withColumn("coef_lag_1", (F.col("say") * F.col("sbb") - F.col("sby") * F.col("sab")) / safe).withColumn(
        "coef_lag_2", (F.col("sby") * F.col("saa") - F.col("say") * F.col("sab")) / safe
    )
    return fit.withColumn(
        "intercept", F.col("my") - F.col("coef_lag_1") * F.col("ma") - F.col("coef_lag_2") * F.col("mb")
    ).select(*by, "n", "intercept", "coef_lag_1", "coef_lag_2")


def error_pattern(errors: DataFrame, by: Sequence[str] = ("service_scope",)) -> DataFrame:
    """DX-19: mean signed and absolute error per weekday and interval of day."""
    return (
        errors.withColumn("weekday", F.dayofweek("business_date"))
        .withColumn("interval_of_day", F.date_format("interval_start", "HH:mm"))
        .groupBy(*by, "weekday", "interval_of_day")
        .agg(
            F.count("*").alias("interval_count"),
            F.avg("signed_error").alias("mean_signed_error"),
            F.avg("absolute_error").alias("mean_absolute_error"),
        )
    )
