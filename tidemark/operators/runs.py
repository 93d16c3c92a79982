"""Runs of the daily pipeline: outcomes, status, budget, and the circuit that opens after transient failures."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .datasets import content_digest
from pyspark.sql.window import Window


def run_counts(items: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, seven counts, status) of the items' outcomes, the most severe first."""
    n = lambda *codes: F.count_if(F.col("item_outcome").isin(*codes))
    failed, warned = n("PROVIDER_ERROR", "CALENDAR_ERROR", "NOT_ATTEMPTED_BUDGET", "NOT_ATTEMPTED_ABORTED"), n("DATA_INSUFFICIENT", "NO_DATA")
    status = F.when(failed > 0, "COMPLETED_WITH_PARTIAL_FAILURES").when(warned > 0, "COMPLETED_WITH_WARNINGS").otherwise("COMPLETED")
    names = {"ready": ("READY",), "degraded": ("DEGRADED",), "data_insufficient": ("DATA_INSUFFICIENT",), "no_data": ("NO_DATA",), "provider_error": ("PROVIDER_ERROR",), "calendar_error": ("CALENDAR_ERROR",), "not_attempted": ("NOT_ATTEMPTED_BUDGET", "NOT_ATTEMPTED_ABORTED")}
    return items.groupBy(run).agg(*(n(*codes).alias(f"{k}_count") for k, codes in names.items()), status.alias("status"))


def attempted(items: DataFrame, limit: int = 3, run: str = "run_id") -> DataFrame:
    """items (ordinal, raw) with (item_outcome, reason): a replay of a run that stops.

    ``raw`` is what an attempt of the member gives: TRANSIENT, FATAL, BUDGET, NO_CALENDAR, NO_DATA, READY, DEGRADED or
    DATA_INSUFFICIENT. The run stops after a FATAL, a BUDGET or the ``limit``-th transient failure in a row; a member
    without calendar neither counts nor resets, all others reset. Window sums find the first stop: transient failures
    are numbered since the last reset.
    """
    w = Window.partitionBy(run).orderBy("ordinal")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    made = items.withColumn("_streak", F.sum(F.when(F.col("raw").isin("TRANSIENT", "NO_CALENDAR"), 0).otherwise(1)).over(upto))
    since = Window.partitionBy(run, "_streak").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    made = made.withColumn("_failures", F.sum(F.when(F.col("raw") == "TRANSIENT", 1).otherwise(0)).over(since))
    stop = F.when(F.col("raw") == "BUDGET", "BUDGET").when(F.col("raw") == "FATAL", "FATAL").when((F.col("raw") == "TRANSIENT") & (F.col("_failures") >= limit), "CIRCUIT")
    made = made.withColumn("_stop", stop)
    halted = F.first("_stop", ignorenulls=True).over(before)
    outcome = (
        F.when(F.col("_halted") == "BUDGET", "NOT_ATTEMPTED_BUDGET").when(F.col("_halted").isNotNull(), "NOT_ATTEMPTED_ABORTED").when(F.col("raw") == "NO_CALENDAR", "CALENDAR_ERROR")
        .when(F.col("raw") == "BUDGET", "NOT_ATTEMPTED_BUDGET").when(F.col("raw").isin("TRANSIENT", "FATAL"), "PROVIDER_ERROR").otherwise(F.col("raw"))
    )
    reason = F.when(F.col("_halted") == "CIRCUIT", "TRANSIENT_FAILURE_CIRCUIT_OPEN").otherwise(F.col("_halted"))
    return made.withColumn("_halted", halted).withColumns({"item_outcome": outcome, "reason": reason}).drop("_streak", "_failures", "_stop", "_halted")


def budget_known(members: Column, attempts: Column, available: Column) -> Column:
    """(estimated, known, can_start): a run starts if its greatest cost is known and within what is left of the day."""
    cost = members * attempts
    return F.struct(cost.alias("estimated"), (cost.isNotNull() & available.isNotNull()).alias("known"), F.coalesce(cost <= available, F.lit(False)).alias("can_start"))


def aggregate_violations(runs: DataFrame, items: DataFrame, run: str, counts: Mapping[str, Column], digested: tuple[str, ...], total: str = "total_count", ordinal: str = "ordinal", stored: str = "content_digest") -> DataFrame:
    """(run, problem) for every run and every parent that items name: the first thing in which a run is not what its items add up to, or null.

    RUN_MISSING, ITEMS_MISSING, TOTAL_MISMATCH, ORDINALS_NOT_1_TO_N, COUNT_MISMATCH:<column> in the order of ``counts`` (a
    stored column and which items it counts), DIGEST_MISMATCH of the items' columns ``digested`` in the order of ordinals. A
    run of no items with a total of 0 is sound. Items are summed by run in each task; no run is gathered whole.
    """
    n, o = F.count(F.lit(1)), F.col(ordinal)
    sums = items.groupBy(run).agg(n.alias("_n"), F.min(o).alias("_first"), F.max(o).alias("_last"), F.countDistinct(o).alias("_places"), *(F.count_if(F.coalesce(x, F.lit(False))).alias(f"_{c}") for c, x in counts.items()))
    found = sums.join(content_digest(items, digested, ordinal, (run,)).withColumnRenamed("digest", "_digest"), run)
    made = runs.withColumn("_run", F.lit(True)).join(found, run, "full")
    held = F.coalesce("_n", F.lit(0))
    problem = (
        F.when(F.col("_run").isNull(), "RUN_MISSING").when((held == 0) & (F.col(total) > 0), "ITEMS_MISSING").when(~held.eqNullSafe(F.col(total)), "TOTAL_MISMATCH")
        .when((held > 0) & ~((F.col("_first") == 1) & (F.col("_last") == held) & (F.col("_places") == held)), "ORDINALS_NOT_1_TO_N")
    )
    for c in counts:
        problem = problem.when(~F.coalesce(f"_{c}", F.lit(0)).eqNullSafe(F.col(c)), f"COUNT_MISMATCH:{c}")
    return made.select(run, problem.when((held > 0) & ~F.col("_digest").eqNullSafe(F.col(stored)), "DIGEST_MISMATCH").alias("problem"))
