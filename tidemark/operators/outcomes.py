"""Forward outcomes over the next sessions of a calendar, and their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pit import known_bars


def future_sessions(sources: DataFrame, calendar: DataFrame, horizon: int) -> DataFrame:
    """sources (session_date) with (known, covered, first_open, terminal_date, terminal_close, expected).

    The next ``horizon`` sessions count by place in the calendar, not by days. ``calendar`` (seq, session_date, open_at,
    close_at) is one family's, some thousand rows, and goes to every task.
    """
    here = calendar.select("seq", "session_date")
    ahead = calendar.select("seq", F.col("session_date").alias("d"), "open_at", "close_at")
    steps = here.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("to", F.col("seq") + F.col("step"))
    paths = steps.join(ahead.withColumnRenamed("seq", "to"), "to").groupBy("session_date").agg(
        F.min("open_at").alias("first_open"), F.max("d").alias("terminal_date"), F.max("close_at").alias("terminal_close"), F.array_sort(F.collect_list("d")).alias("expected")
    )
    known = here.select("session_date", F.lit(True).alias("_known"))
    joined = sources.join(F.broadcast(known), "session_date", "left").join(F.broadcast(paths), "session_date", "left")
    whole = F.size("expected") == horizon
    return joined.withColumn("known", F.col("_known").isNotNull()).withColumn("covered", F.coalesce(whole, F.lit(False))).drop("_known")


def forward_outcomes(items: DataFrame, bars: DataFrame, calendar: DataFrame, horizon: int, as_of: Column, grace_seconds: int = 0) -> DataFrame:
    """items (item_id, source_code, symbol, adjustment_basis, session_date, reference_close, eligible, chain_valid, scored_at) with their outcome.

    The ladder, first match: SOURCE_ITEM_NOT_ELIGIBLE, SOURCE_CHAIN_INVALID (also for a day that is no session),
    CALENDAR_OUT_OF_COVERAGE, NOT_MATURED (before the last close and its grace), FUTURE_BARS_INCOMPLETE,
    FUTURE_BAR_CONTRACT_INVALID (a price or the reference not above zero, or the return outside the excursions),
    OUTCOME_CREATED. Bars that no item looks ahead to are left out before revisions are compared.
    """
    items = future_sessions(items, calendar, horizon)
    matured = as_of >= F.col("terminal_close") + F.make_dt_interval(secs=F.lit(grace_seconds))
    wanted = items.where("eligible and chain_valid and known and covered").where(matured).select(
        "item_id", "source_code", "symbol", "adjustment_basis", "reference_close", F.explode("expected").alias("session_date")
    )
    key = ["source_code", "symbol", "adjustment_basis", "session_date"]
    paths = wanted.join(known_bars(bars.join(wanted.select(*key), key, "left_semi"), as_of), key)
    return outcomes_of_paths(items, paths, horizon, matured)


def outcomes_of_paths(items: DataFrame, paths: DataFrame, horizon: int, matured: Column) -> DataFrame:
    """The outcomes of items as ``future_sessions`` gives them, from their paths (item_id, reference_close, a known bar a session)."""
    rate = lambda x: F.when((F.min("low_price") > 0) & (F.max("reference_close") > 0), F.try_divide(x, F.max("reference_close")) - 1)
    rates = paths.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("bar_count"),
        rate(F.max_by("close_price", "session_date")).alias("return_rate"), rate(F.max("high_price")).alias("mfe_rate"), rate(F.min("low_price")).alias("mae_rate"),
        F.max("available_at").alias("latest_input_available_at"),
    )
    joined = items.join(rates, "item_id", "left")
    n = F.coalesce("bar_count", F.lit(0))
    ordered = (F.col("mae_rate") <= F.col("return_rate")) & (F.col("return_rate") <= F.col("mfe_rate"))
    outcome = (
        F.when(~F.col("eligible"), "SOURCE_ITEM_NOT_ELIGIBLE").when(~F.col("chain_valid") | ~F.col("known"), "SOURCE_CHAIN_INVALID")
        .when(~F.col("covered"), "CALENDAR_OUT_OF_COVERAGE").when(~matured, "NOT_MATURED").when(n < horizon, "FUTURE_BARS_INCOMPLETE")
        .when(~F.coalesce(ordered, F.lit(False)), "FUTURE_BAR_CONTRACT_INVALID").otherwise("OUTCOME_CREATED")
    )
    made = joined.withColumn("outcome", outcome)
    created = F.col("outcome") == "OUTCOME_CREATED"
    mode = F.when(F.col("scored_at") <= F.col("first_open"), "PROSPECTIVE").otherwise("RETROSPECTIVE_REPLAY")
    rate = lambda c: F.when(created, F.col(c)).alias(c)
    return made.select(
        "item_id", "source_code", "symbol", "session_date", "terminal_date", "outcome", rate("return_rate"), rate("mfe_rate"), rate("mae_rate"),
        F.when(created, F.lit(horizon)).alias("bar_count"), F.when(created, mode).alias("observation_mode"), rate("latest_input_available_at"),
    )


def label(return_rate: Column) -> Column:
    """POSITIVE above zero, else NOT_POSITIVE; null without a return."""
    return F.when(return_rate > 0, "POSITIVE").when(return_rate.isNotNull(), "NOT_POSITIVE")


def observation_summary(outcomes: DataFrame, run: str) -> DataFrame:
    """(run, six counts, status) of a run's outcomes."""
    n = lambda *codes: F.count_if(F.col("outcome").isin(*codes))
    gaps = ("SOURCE_CHAIN_INVALID", "FUTURE_BAR_CONTRACT_INVALID")
    status = (
        F.when(n("SOURCE_ITEM_NOT_ELIGIBLE") == F.count(F.lit(1)), "NO_ELIGIBLE_ITEMS").when(n("CALENDAR_OUT_OF_COVERAGE") > 0, "CALENDAR_OUT_OF_COVERAGE")
        .when(n(*gaps) > 0, "COMPLETED_WITH_GAPS").when(n("NOT_MATURED", "FUTURE_BARS_INCOMPLETE") > 0, "COMPLETED_WITH_PENDING").otherwise("COMPLETED")
    )
    return outcomes.groupBy(run).agg(
        n("OUTCOME_CREATED").alias("created_count"), n("OUTCOME_ALREADY_EXISTS").alias("existing_count"), n("NOT_MATURED").alias("not_matured_count"),
        n("FUTURE_BARS_INCOMPLETE").alias("incomplete_count"), n("SOURCE_ITEM_NOT_ELIGIBLE").alias("not_eligible_count"),
        n(*gaps, "CALENDAR_OUT_OF_COVERAGE").alias("invalid_count"), status.alias("status"),
    )
