"""Technical features over the last 21 sessions of each series, for every session at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .pit import SERIES

PRICE_FEATURES = (
    "one_day_return", "five_day_return", "twenty_day_return", "latest_gap_return", "latest_intraday_return",
    "latest_range_rate", "close_vs_sma5", "close_vs_sma10", "close_vs_sma20", "realized_volatility_20d", "atr14_rate",
    "distance_from_prior_20d_high", "distance_from_prior_20d_low",
)
VOLUME_FEATURES = ("volume_ratio_5_to_20", "latest_volume_to_avg20", "average_dollar_volume_20")


def technical_features(bars: DataFrame) -> DataFrame:
    """bars with the features of each session and (completed_bar_count, quality_status, quality_reason).

    Needs one revision of each session. With fewer than 21 sessions the row is DATA_INSUFFICIENT and has no features;
    a null among the 21 volumes, or 20 that are zero, makes it DEGRADED, without volume features. Bars should be sound; a
    rate to a price of zero is null. All windows share one partitioning and order, so a series is shuffled and sorted once.
    """
    w = Window.partitionBy(*SERIES).orderBy("session_date")
    last = lambda n: w.rowsBetween(1 - n, 0)
    prior = w.rowsBetween(-20, -1)
    close = F.col("close_price")
    rate = lambda x, y: F.try_divide(x, F.col(y)) - 1
    made = bars.withColumn("_before", F.lag("close_price").over(w))
    made = made.withColumns({
        "_return": rate(close, "_before"),
        "_range": F.greatest(F.col("high_price") - F.col("low_price"), F.abs(F.col("high_price") - F.col("_before")), F.abs(F.col("low_price") - F.col("_before"))),
        "_dollars": close * F.col("volume"),
    })
    made = made.withColumns({
        "_n": F.count(F.lit(1)).over(last(21)), "_volumes": F.count("volume").over(last(21)), "_mean20": F.avg("volume").over(last(20)),
        "_five": F.lag("close_price", 5).over(w), "_twenty": F.lag("close_price", 20).over(w),
        "_sma5": F.avg("close_price").over(last(5)), "_sma10": F.avg("close_price").over(last(10)), "_sma20": F.avg("close_price").over(last(20)),
        "_deviation": F.stddev_pop("_return").over(last(20)), "_true": F.avg("_range").over(last(14)),
        "_high": F.max("high_price").over(prior), "_low": F.min("low_price").over(prior), "_mean5": F.avg("volume").over(last(5)),
        "_dollars20": F.avg("_dollars").over(last(20)),
    })
    full = F.col("_n") >= 21
    sound = full & (F.col("_volumes") >= 21) & (F.col("_mean20") != 0)
    price = {
        "one_day_return": rate(close, "_before"), "five_day_return": rate(close, "_five"), "twenty_day_return": rate(close, "_twenty"),
        "latest_gap_return": rate(F.col("open_price"), "_before"), "latest_intraday_return": rate(close, "open_price"),
        "latest_range_rate": F.try_divide(F.col("high_price") - F.col("low_price"), F.col("_before")),
        "close_vs_sma5": rate(close, "_sma5"), "close_vs_sma10": rate(close, "_sma10"), "close_vs_sma20": rate(close, "_sma20"),
        "realized_volatility_20d": F.col("_deviation"), "atr14_rate": F.try_divide(F.col("_true"), close),
        "distance_from_prior_20d_high": rate(close, "_high"), "distance_from_prior_20d_low": rate(close, "_low"),
    }
    volume = {
        "volume_ratio_5_to_20": F.try_divide(F.col("_mean5"), F.col("_mean20")),
        "latest_volume_to_avg20": F.try_divide(F.col("volume").cast("double"), F.col("_mean20")), "average_dollar_volume_20": F.col("_dollars20"),
    }
    status = F.when(~full, "DATA_INSUFFICIENT").when(sound, "READY").otherwise("DEGRADED")
    reason = F.when(~full, F.lit(None)).when(F.col("_volumes") < 21, "VOLUME_DATA_INCOMPLETE").when(F.col("_mean20") == 0, "VOLUME_DATA_UNUSABLE")
    return made.select(
        *bars.columns, F.least(F.col("_n"), F.lit(21)).cast("int").alias("completed_bar_count"), status.alias("quality_status"), reason.alias("quality_reason"),
        F.when(full, close).alias("last_close"), *(F.when(full, x).alias(k) for k, x in price.items()), *(F.when(sound, x).alias(k) for k, x in volume.items()),
    )


def price_features(bars: DataFrame) -> DataFrame:
    """The second feature set: prices alone, READY wherever 21 sessions are complete."""
    made = technical_features(bars).where("quality_status <> 'DATA_INSUFFICIENT'").drop("quality_reason", *VOLUME_FEATURES)
    return made.withColumn("quality_status", F.lit("READY"))


def day_windows(bars: DataFrame, days: tuple[int, ...] = (7, 30)) -> DataFrame:
    """bars with features over the last days of the calendar, not the last sessions, for each of ``days``.

    sessions_{n}d and mean_close_{n}d are over the days from n - 1 days back to the session itself; prior_high_{n}d and
    prior_low_{n}d over the n days before it. Days without a session, holidays and gaps, take no place: a window may hold
    fewer sessions, or none before the session, which gives null highs and lows. gap_days is the number of days since the
    session before, null for the first. Needs one revision of each session. All windows share one shuffle and one sort.
    """
    series = f"partition by {', '.join(SERIES)} order by session_date"
    made = {"gap_days": F.expr(f"datediff(session_date, lag(session_date) over ({series}))")}
    for n in days:
        here = f"over ({series} range between interval {n - 1} days preceding and current row)"
        before = f"over ({series} range between interval {n} days preceding and interval 1 days preceding)"
        made |= {f"sessions_{n}d": F.expr(f"count(*) {here}"), f"mean_close_{n}d": F.expr(f"avg(close_price) {here}"), f"prior_high_{n}d": F.expr(f"max(high_price) {before}"), f"prior_low_{n}d": F.expr(f"min(low_price) {before}")}
    return bars.withColumns(made)
