"""Point-in-time selection: what was known at a time, and what is new to a store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.session import written

SERIES = ("source_code", "symbol", "adjustment_basis")


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a total order. Spark keeps the first rows of a task before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def known_bars(bars: DataFrame, as_of: Column) -> DataFrame:
    """The latest revision of each session that was available at ``as_of``; the bound stays below the window."""
    return first_of(bars.where(F.col("available_at") <= as_of), [*SERIES, "session_date"], F.desc("available_at"), F.desc("bar_key"))


def latest_sessions(bars: DataFrame, as_of: Column, limit: int) -> DataFrame:
    """The last ``limit`` sessions of each series known at ``as_of``, numbered from 1 in time order."""
    series = Window.partitionBy(*SERIES)
    back = F.row_number().over(series.orderBy(F.desc("session_date")))
    kept = known_bars(bars, as_of).withColumn("_back", back).where(F.col("_back") <= limit)
    return kept.withColumn("position", F.row_number().over(series.orderBy("session_date"))).drop("_back")


def named_sessions(bars: DataFrame, as_of: Column, wanted: DataFrame) -> DataFrame:
    """Known bars of the sessions of ``wanted`` (position, session_date), at most a handful, with the caller's position."""
    return known_bars(bars.join(F.broadcast(wanted), "session_date"), as_of)


def best_outcomes(outcomes: DataFrame) -> DataFrame:
    """The best revision for each scored item: latest input, then latest recorded, then the larger key."""
    return first_of(outcomes, ["scoring_item_id"], F.desc("latest_input_available_at"), F.desc("recorded_at"), F.desc("outcome_key"))


def latest_outcomes(outcomes: DataFrame, as_of: Column) -> DataFrame:
    """The revision of each item that was available at a time: latest input, then the larger key."""
    known = outcomes.where(F.col("latest_input_available_at") <= as_of)
    return first_of(known, ["scoring_item_id"], F.desc("latest_input_available_at"), F.desc("outcome_key"))


def create_or_get(incoming: DataFrame, stored: DataFrame, key: str, content: str) -> DataFrame:
    """incoming with (status): CREATED, ALREADY_EXISTS, or CONFLICT where the key is stored with other content."""
    have = stored.select(F.col(key), F.col(content).alias("_stored")).dropDuplicates([key])
    status = F.when(F.col("_stored").isNull(), "CREATED").when(F.col("_stored") == F.col(content), "ALREADY_EXISTS").otherwise("CONFLICT")
    return incoming.join(have, key, "left").withColumn("status", status).drop("_stored")


def new_rows(incoming: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of keys that the store lacks, one for each key."""
    return incoming.join(stored.select(*keys), keys, "left_anti").dropDuplicates(keys)


def current_state(events: DataFrame, key: str) -> DataFrame:
    """The latest version of each key of an append-only log of states."""
    return first_of(events, [key], F.desc("version"))


def guarded_transition(state: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """requests (key, expected_status, expected_version, to_status) with (result, version): an update that only holds if nothing moved.

    A key without state is NOT_FOUND, one with another status or version is an OPTIMISTIC_CONFLICT, and of several
    requests for a version the first by ``to_status`` is APPLIED. APPLIED rows are the events to append.
    """
    have = state.select(key, F.col("status").alias("_status"), F.col("version").alias("_version"))
    holds = (F.col("_status") == F.col("expected_status")) & (F.col("_version") == F.col("expected_version"))
    turn = F.row_number().over(Window.partitionBy(key, "expected_status", "expected_version").orderBy("to_status"))
    result = F.when(F.col("_status").isNull(), "NOT_FOUND").when(holds & (F.col("_turn") == 1), "APPLIED").otherwise("OPTIMISTIC_CONFLICT")
    joined = requests.withColumn("_turn", turn).join(have, key, "left").withColumn("result", result)
    return joined.withColumn("version", F.when(F.col("result") == "APPLIED", F.col("_version") + 1)).drop("_status", "_version", "_turn")


#: Listing orders of the stores.
LISTINGS = {
    "universe": ("mic_code", "symbol"),
    "dataset": ("source_session_date", "scoring_run_id", "source_rank", "mic_code", "symbol", "outcome_id"),
    "lineage": ("source_session_date", "scoring_run_id", "ordinal", "scoring_item_id"),
    "candidates": ("selected_at", "candidate_id"),
    "evaluations": ("evaluated_at", "evaluation_id"),
    "decisions": ("decided_at", "strategy_id", "decision_id"),
    "fills": ("fill_sequence", "fill_id"),
    "recommendations": ("generated_at", "recommendation_id"),
    "outcomes": ("latest_input_available_at", "outcome_key"),
    "labels": ("generated_at", "label_key"),
    "items": ("ordinal",),
}


def numbered(df: DataFrame, listing: str, within: list[str], small: bool = False) -> DataFrame:
    """df with (ordinal): places from 1 within each parent, or, without ``within``, over the whole table.

    With ``small`` parents have a few rows by nature, as a candidate has its strategies: one window orders them, and df is read once.

    A parent may be large, so no task orders it whole: rows are ordered within each value of the listing's first column,
    and start behind the counts of the values before it. Only those counts, one row for each value, are summed in order.
    """
    first, *rest = LISTINGS[listing]
    if not rest or (small and within):
        return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(*within).orderBy(first, *rest)))
    part = [*within, first]
    here = Window.partitionBy(*within).orderBy(F.col(first).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(here), F.lit(0)))
    starts = starts.select(*(F.col(c).alias(f"_{c}") for c in part), "_start")
    placed = df.withColumn("_place", F.row_number().over(Window.partitionBy(*part).orderBy(*(F.col(c) for c in rest))))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in part]
    joined = placed.join(starts, same)
    return joined.withColumn("ordinal", (F.col("_start") + F.col("_place")).cast("int")).drop("_start", "_place", *(f"_{c}" for c in part))


def summed_before(df: DataFrame, keys: list[str], order: list[str], amount: str) -> DataFrame:
    """df with (before, whole): the sum of ``amount`` over the rows of the same keys that come earlier in ``order``, and over all of them.

    Rows are dealt out by ranges of (keys, order), so that keys that hold most of the rows lie on many tasks; sums within a
    range start behind those of the ranges before it, of which there is one row a range and key. The order should be total.
    """
    ranged = written(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy(*keys, "_range").agg(F.sum(amount).alias("_sum"))
    own, earlier = Window.partitionBy(*keys), (Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_sum").over(own.orderBy("_range").rowsBetween(*earlier)), F.lit(0))
    starts = sums.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_range").alias("_of"), before.alias("_start"), F.sum("_sum").over(own).alias("whole"))
    inside = F.coalesce(F.sum(amount).over(Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(*earlier)), F.lit(0))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = ranged.withColumn("_inside", inside).join(starts, [*same, F.col("_range") == F.col("_of")])
    return joined.withColumn("before", F.col("_start") + F.col("_inside")).drop("_range", "_of", "_start", "_inside", *(f"_{k}" for k in keys))


#: Into so many ranges of values a population is cut, beside the values that are ends of ranges; larger tables of them are not sent to every task.
CUTS, MOST_SENT = 32, 200_000


def sent(df: DataFrame) -> DataFrame:
    """df, written, and marked to be sent to every task where it is small."""
    kept = written(df)
    return F.broadcast(kept) if kept.count() <= MOST_SENT else kept


def cut(df: DataFrame, keys: list[str], value: str, share: float = 0.1) -> DataFrame:
    """df with (_cut): the range of ``value`` in its population (``keys``), in the order of values, null for null.

    Ends of ranges are quantiles of a share of the rows, written once. They only decide how even the ranges are, so any
    share gives the same results. An even range lies between two ends, an odd one holds the rows of a single value, that
    of an end, so a value that makes up a good part of a population is alone in its range.
    """
    ends = F.array_sort(F.array_distinct(F.percentile_approx(value, [k / CUTS for k in range(1, CUTS)], 1_000)))
    drawn = df.where(F.col(value).isNotNull()).select(*keys, value).sample(share, 7)
    found = sent(drawn.groupBy(*keys).agg(ends.alias("_ends")).select(*(F.col(c).alias(f"_of_{c}") for c in keys), "_ends"))
    joined = df.join(found, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys], "left")
    v, ends = F.col(value), F.coalesce("_ends", F.slice(F.array(value), 1, 0))
    place = 2 * F.size(F.filter(ends, lambda end: end < v)) + F.array_contains(ends, v).cast("int")
    return joined.withColumn("_cut", F.when(v.isNotNull(), place)).drop("_ends", *(f"_of_{c}" for c in keys))


def cut_starts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(_of_<keys>, _of_cut, _start, _rows, whole): the rows before each range of ``cut`` in its population, in it, and in all."""
    own = Window.partitionBy(*keys)
    counts = rows.where(F.col("_cut").isNotNull()).groupBy(*keys, "_cut").agg(F.count(F.lit(1)).alias("_rows"))
    start = F.coalesce(F.sum("_rows").over(own.orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sent(counts.select(*(F.col(c).alias(f"_of_{c}") for c in keys), F.col("_cut").alias("_of_cut"), start.alias("_start"), "_rows", F.sum("_rows").over(own).alias("whole")))


def in_cuts(rows: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """rows with (_start, _rows, whole) of their range."""
    same = [*(F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys), F.col("_cut") == F.col("_of_cut")]
    return rows.join(starts, same, "left").drop("_of_cut", *(f"_of_{c}" for c in keys))
