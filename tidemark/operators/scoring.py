"""Relative scores: tie-aware percentiles in a run, components, a weighted whole and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .features import PRICE_FEATURES, VOLUME_FEATURES
from .pit import CUTS, cut, cut_starts, in_cuts, sent

#: The features of each component, and the weights of components (fixed values).
GROUPS = {
    "momentum": ("one_day_return", "five_day_return", "twenty_day_return"),
    "trend": ("close_vs_sma5", "close_vs_sma10", "close_vs_sma20"),
    "breakout": ("distance_from_prior_20d_high", "distance_from_prior_20d_low"),
    "price_action": ("latest_gap_return", "latest_intraday_return"),
    "stability": ("latest_range_rate", "realized_volatility_20d", "atr14_rate"),
    "volume": VOLUME_FEATURES,
}
WEIGHTS = {"momentum": 25, "trend": 25, "breakout": 20, "price_action": 10, "stability": 10, "volume": 10}


def midrank_percentile(items: DataFrame, value: str, population: list[str], into: str = "percentile") -> DataFrame:
    """items with ((mean rank) - 1) / (n - 1) of ``value`` in its population: ties share, and one value alone is at 0.5.

    Null for null. Rows are shuffled once, by ranges of values (``pit.cut``), and places within a range start behind the
    rows before it. A value that fills a range of its own needs no order, so its rows are dealt out over tasks, and
    neither ties nor a large population gather in one. items are read three times: write them first if they are costly.
    """
    ranged = cut(items, population, value)
    starts = cut_starts(ranged, population)
    alone = F.col("_cut") % 2 == 1
    w = Window.partitionBy(*population, "_cut", "_deal").orderBy(value)
    dealt = ranged.withColumn("_deal", F.when(alone | F.col("_cut").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(1_024))).otherwise(-1).cast("int"))
    ranked_ = dealt.withColumns({"_rank": F.rank().over(w), "_ties": F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))})
    before = F.col("_start") + F.when(alone, 0).otherwise(F.col("_rank") - 1)
    ties = F.when(alone, F.col("_rows")).otherwise(F.col("_ties"))
    place = F.when(F.col("whole") == 1, F.lit(0.5)).otherwise(F.try_divide(before + (ties - 1) / F.lit(2.0), F.col("whole") - 1))
    return in_cuts(ranked_, starts, population).withColumn(into, place).drop("_cut", "_deal", "_rank", "_ties", "_start", "_rows", "whole")


def feature_percentiles(items: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, symbol, feature, percentile): prices among READY and DEGRADED items, volumes among READY ones alone.

    Features are rows here, so all are ranked at once, however large a run is.
    """
    usable = items.where(F.col("quality_status").isin("READY", "DEGRADED"))
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in (*PRICE_FEATURES, *VOLUME_FEATURES)))).alias("x")
    long = usable.select(run, "symbol", "quality_status", pairs).select(run, "symbol", "quality_status", "x.*")
    volume = F.col("feature").isin(*VOLUME_FEATURES)
    long = long.where(F.col("value").isNotNull() & (~volume | (F.col("quality_status") == "READY")))
    return midrank_percentile(long, "value", [run, "feature"]).select(run, "symbol", "feature", "percentile")


def component_scores(items: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, symbol, mic_code, quality_status, a score of each group, overall): 0 to 100, six places, half to even.

    A component is the mean percentile of its group; stability counts 1 - p. Without a volume score the other weights
    make up the whole.
    """
    long = feature_percentiles(items, run)
    mean = lambda group: F.avg(F.when(F.col("feature").isin(*GROUPS[group]), F.col("percentile")))
    wide = long.groupBy(run, "symbol").agg(*(((1 - mean(g)) if g == "stability" else mean(g)).alias(f"_{g}") for g in GROUPS))
    whole = sum((WEIGHTS[g] * F.coalesce(F.col(f"_{g}"), F.lit(0.0)) for g in GROUPS), F.lit(0.0))
    weight = F.when(F.col("_volume").isNull(), F.lit(90.0)).otherwise(F.lit(100.0))
    score = lambda x: F.bround(100 * x, 6)
    base = items.select(run, "symbol", "mic_code", "quality_status")
    return base.join(wide, [run, "symbol"]).select(
        run, "symbol", "mic_code", "quality_status", *(score(F.col(f"_{g}")).alias(f"{g}_score") for g in GROUPS), score(whole / weight).alias("overall_score")
    )


def ranked(scores: DataFrame, run: str = "run_id") -> DataFrame:
    """scores with (rank): READY before DEGRADED, then overall, momentum and trend from the top, then exchange and symbol.

    Ranks are of the rounded scores. A run is ordered by ranges of the overall score of either quality, so that none
    gathers in a task. scores are read three times: write them first if they are costly.
    """
    order = [F.desc("overall_score"), F.desc("momentum_score"), F.desc("trend_score"), F.asc("mic_code"), F.asc("symbol")]
    first = (F.coalesce(F.col("quality_status") == "READY", F.lit(False))).cast("int")
    keyed = scores.withColumns({"_behind": 1 - first, "_down": -F.col("overall_score")})
    ranged = cut(keyed, [run, "_behind"], "_down").withColumn("_cut", F.coalesce("_cut", F.lit(2 * CUTS)))
    starts = cut_starts(ranged, [run, "_behind"])
    ahead = starts.where("_of__behind = 0").groupBy(f"_of_{run}").agg(F.max("whole").alias("_ahead")).withColumnRenamed(f"_of_{run}", "_run")
    place = F.row_number().over(Window.partitionBy(run, "_behind", "_cut").orderBy(*order))
    placed = in_cuts(ranged.withColumn("_place", place), starts, [run, "_behind"]).join(sent(ahead), F.col(run).eqNullSafe(F.col("_run")), "left")
    before = F.when(F.col("_behind") == 1, F.coalesce("_ahead", F.lit(0))).otherwise(0)
    return placed.withColumn("rank", before + F.col("_start") + F.col("_place")).drop("_behind", "_down", "_cut", "_place", "_start", "_rows", "whole", "_run", "_ahead")


#: Names that the values of a snapshot have to have, and no others; reasons for which a snapshot may be degraded; the form of a number (fixed values).
SNAPSHOT_VALUES = ("adjustment_basis", "completed_bar_count", "last_close", *PRICE_FEATURES, *VOLUME_FEATURES)
DEGRADED_REASONS = ("VOLUME_DATA_INCOMPLETE", "VOLUME_DATA_UNUSABLE")
NUMBER = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?\z"


def snapshot_problem(get=F.col) -> Column:
    """The first rule that a snapshot breaks, or null, from its feature_set_code, feature_set_version, quality_status, quality_reason_codes and feature_values.

    Values are texts by name. The set's code and version come first, then the names, the basis, the number of bars, the
    volumes and the reasons that go with the quality, and the form of all numbers. Volumes of a degraded one are null.
    """
    values, quality, reasons = get("feature_values"), get("quality_status"), get("quality_reason_codes")
    value = lambda k: F.try_element_at(values, F.lit(k))
    any_of = lambda tests: F.exists(F.array(*tests), lambda x: x)
    names = F.map_keys(values)
    whole = (F.size(names) == len(SNAPSHOT_VALUES)) & (F.size(F.array_except(F.array(*map(F.lit, SNAPSHOT_VALUES)), names)) == 0)
    is_ = lambda x: F.coalesce(x, F.lit(False))
    numbers = [x for x in SNAPSHOT_VALUES if x not in ("adjustment_basis", "completed_bar_count")]
    odd = any_of([~is_(value(k).rlike(NUMBER)) & ~(F.lit(k in VOLUME_FEATURES) & value(k).isNull()) for k in numbers])
    one_reason = (F.size(reasons) == 1) & is_(F.get(reasons, F.lit(0)).isin(*DEGRADED_REASONS))
    ready, degraded = is_(quality == "READY"), is_(quality == "DEGRADED")
    return (
        F.when(~is_(get("feature_set_code") == "US_EQUITY_DAILY_TECHNICAL"), "FEATURE_SET_CODE_MISMATCH").when(~is_(get("feature_set_version") == "v1"), "FEATURE_SET_VERSION_MISMATCH")
        .when(~is_(whole), "FEATURE_KEY_CONTRACT_INVALID").when(~is_(value("adjustment_basis") == "SPLIT_ADJUSTED"), "FEATURE_ADJUSTMENT_BASIS_INVALID")
        .when(~is_(value("completed_bar_count") == "21"), "FEATURE_COMPLETED_BAR_COUNT_INVALID").when(ready & any_of([value(k).isNull() for k in VOLUME_FEATURES]), "FEATURE_READY_VOLUME_INCOMPLETE")
        .when(~ready & ~(degraded & is_(one_reason)), "FEATURE_QUALITY_UNSUPPORTED").when(degraded & any_of([value(k).isNotNull() for k in VOLUME_FEATURES]), "FEATURE_DEGRADED_VOLUME_SHAPE_INVALID")
        .when(odd, "FEATURE_NUMERIC_VALUE_INVALID")
    )


def prepared_items(items: DataFrame, snapshots: DataFrame) -> DataFrame:
    """items with (scoring_outcome, reason): each item's snapshot has to be there, to be the one that the run asked for, and to be sound.

    items: (feature_snapshot_id, symbol, item_outcome, feature_quality, horizon, as_of, provider_code, ...); snapshots:
    (feature_snapshot_id, symbol, horizon, as_of, source_codes and what ``snapshot_problem`` reads). The first failure
    decides; a null never agrees. reason is null for what is scored.
    """
    names = ("symbol", "horizon", "as_of", "source_codes", "feature_set_code", "feature_set_version", "quality_status", "quality_reason_codes", "feature_values")
    theirs = snapshots.select("feature_snapshot_id", *(F.col(c).alias(f"_{c}") for c in names), F.lit(True).alias("_there"))
    made = items.join(theirs, "feature_snapshot_id", "left")
    same = [F.col("_symbol") == F.col("symbol"), F.col("_horizon") == F.col("horizon"), F.col("_as_of") == F.col("as_of"), F.col("_quality_status") == F.col("feature_quality"), F.forall("_source_codes", lambda c: c == F.col("provider_code"))]
    matches = F.lit(True)
    for x in same:
        matches = matches & F.coalesce(x, F.lit(False))
    scorable = F.coalesce(F.col("item_outcome").isin("READY", "DEGRADED"), F.lit(False))
    problem = snapshot_problem(lambda c: F.col(f"_{c}"))
    reason = (
        F.when(~scorable, F.concat(F.lit("SOURCE_ITEM_"), F.coalesce("item_outcome", F.lit("UNKNOWN")))).when(F.col("_there").isNull(), "FEATURE_SNAPSHOT_MISSING")
        .when(~matches, "FEATURE_SOURCE_MISMATCH").otherwise(problem)
    )
    made = made.withColumn("reason", reason)
    reason = F.col("reason")
    outcome = (
        F.when(reason.isNull(), F.concat(F.lit("SCORED_"), "_quality_status")).when(~scorable, "SOURCE_ITEM_NOT_SCORABLE")
        .when(reason.isin("FEATURE_SNAPSHOT_MISSING", "FEATURE_SOURCE_MISMATCH", "FEATURE_QUALITY_UNSUPPORTED"), reason).otherwise("FEATURE_CONTRACT_INVALID")
    )
    return made.withColumn("scoring_outcome", outcome).drop("_there", *(f"_{c}" for c in names))


def run_status(items: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, items, scored, skipped, status) from the outcomes of a run's items."""
    scored = F.count_if(F.col("scoring_outcome").isin("SCORED_READY", "SCORED_DEGRADED"))
    n = F.count(F.lit(1))
    status = F.when(scored == 0, "NO_SCORABLE_ITEMS").when(scored < n, "COMPLETED_WITH_UNSCORABLE").otherwise("COMPLETED")
    return items.groupBy(run).agg(n.alias("items"), scored.alias("scored"), (n - scored).alias("skipped"), status.alias("status"))
