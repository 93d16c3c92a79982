"""Calibration datasets as of a time, and the audit of whether they are ready for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json, digest

from .features import PRICE_FEATURES
from .outcomes import label
from .pit import LISTINGS, best_outcomes, numbered

#: Reasons for leaving an item out, in report order (fixed values).
EXCLUSIONS = (
    "SCORE_NOT_READY", "FEATURE_QUALITY_NOT_READY", "VOLUME_DATA_INCOMPLETE", "OUTCOME_NOT_FOUND", "OUTCOME_NOT_AVAILABLE_AS_OF",
    "LABEL_NOT_FOUND", "LABEL_POLICY_MISMATCH", "OUTCOME_POLICY_MISMATCH", "PROVIDER_MISMATCH", "CALENDAR_MISMATCH",
    "MISSING_SCORE", "DUPLICATE_SOURCE", "OTHER_CONTRACT_FAILURE",
)
NOT_DERIVABLE = "NOT_DERIVABLE_FROM_CURRENT_SCHEMA"
FLAGS = ("has_any_outcome", "has_as_of_outcome", "has_provider_outcome", "has_calendar_outcome", "has_policy_outcome")


def calibration_dataset(items: DataFrame, outcomes: DataFrame, as_of: Column, **policy: str) -> DataFrame:
    """The dataset's rows with their places from 1 over the whole dataset: scored-ready items with their best outcome known at ``as_of``, labelled.

    ``policy`` holds equalities on outcome columns (provider_code and so on). Bounds and policies apply before the best
    revision is chosen.
    """
    known = outcomes.where((F.col("latest_input_available_at") <= as_of) & (F.col("recorded_at") <= as_of))
    for column, value in policy.items():
        known = known.where(F.col(column) == value)
    ready = items.where("scoring_outcome = 'SCORED_READY' and overall_score is not null and source_rank is not null")
    rows = best_outcomes(known).join(ready, "scoring_item_id").withColumn("label", label(F.col("return_rate")))
    return numbered(rows, "dataset", [])


def dataset_summary(rows: DataFrame) -> DataFrame:
    """One row: totals by label and mode, sessions and their span; EMPTY without rows."""
    n = F.count(F.lit(1))
    return rows.agg(
        n.alias("total"), F.count_if(F.col("label") == "POSITIVE").alias("positive"), F.count_if(F.col("label") == "NOT_POSITIVE").alias("not_positive"),
        F.count_if(F.col("observation_mode") == "PROSPECTIVE").alias("prospective"), F.count_if(F.col("observation_mode") == "RETROSPECTIVE_REPLAY").alias("replay"),
        F.countDistinct("source_session_date").alias("sessions"), F.min("source_session_date").alias("first_session"), F.max("source_session_date").alias("last_session"),
        F.when(n == 0, "EMPTY").otherwise("READY").alias("status"),
    )


def included_facts(rows: DataFrame) -> DataFrame:
    """One row of counts over a dataset's rows (mic_code, symbol, source_session_date, observation_mode, label, overall_score, scoring_item_id)."""
    replay, prospective = F.col("observation_mode") == "RETROSPECTIVE_REPLAY", F.col("observation_mode") == "PROSPECTIVE"
    positive, not_positive = F.col("label") == "POSITIVE", F.col("label") == "NOT_POSITIVE"
    n, day, item = F.count(F.lit(1)), F.col("source_session_date"), F.col("scoring_item_id")
    return rows.agg(
        n.alias("items"), F.countDistinct(day).alias("sessions"), F.countDistinct("mic_code", "symbol").alias("symbols"),
        F.min(day).alias("first_session"), F.max(day).alias("last_session"), F.coalesce(F.datediff(F.max(day), F.min(day)), F.lit(0)).alias("span_days"),
        F.count_if(replay).alias("replay_items"), F.countDistinct(F.when(replay, day)).alias("replay_sessions"),
        F.count_if(prospective).alias("prospective_items"), F.countDistinct(F.when(prospective, day)).alias("prospective_sessions"),
        F.count_if(positive).alias("positive"), F.count_if(not_positive).alias("not_positive"),
        F.count_if(replay & positive).alias("replay_positive"), F.count_if(replay & not_positive).alias("replay_not_positive"),
        F.count_if(prospective & positive).alias("prospective_positive"), F.count_if(prospective & not_positive).alias("prospective_not_positive"),
        F.count_if(F.col("overall_score").isNull()).alias("null_scores"), F.count_if(~F.col("overall_score").between(0, 100)).alias("invalid_scores"),
        (n - F.countDistinct(item)).alias("duplicates"),
    )


#: The least counts of each tier of readiness (fixed values).
TIERS = {
    "DATA_INSUFFICIENT": {"items": 300, "sessions": 60, "replay_items": 150, "replay_sessions": 20},
    "CLASS_IMBALANCED": {"positive": 60, "not_positive": 60, "replay_positive": 30, "replay_not_positive": 30},
    "PROSPECTIVE_INSUFFICIENT": {"prospective_items": 100, "prospective_sessions": 20, "prospective_positive": 20, "prospective_not_positive": 20},
}


def readiness(facts: DataFrame, contract_valid: Column | None = None) -> DataFrame:
    """facts with (readiness): the first tier that fails, else DATA_READY."""
    valid = F.lit(True) if contract_valid is None else contract_valid
    status = F.when(~valid | (F.col("null_scores") > 0) | (F.col("invalid_scores") > 0) | (F.col("duplicates") > 0), "SOURCE_INELIGIBLE")
    for tier, least in TIERS.items():
        status = status.when(F.expr(" or ".join(f"{k} < {v}" for k, v in least.items())), tier)
    status = status.otherwise("DATA_READY")
    return facts.withColumn("readiness", status)


def lineage_flags(items: DataFrame, outcomes: DataFrame, labels: DataFrame, as_of: Column, provider: str, calendar: str, policy: str, label_policy: str) -> DataFrame:
    """items with seven flags, each narrower than the one before: outcomes found, known, of the provider, calendar and policy; labels of those.

    Seven EXISTS are one aggregation by item and one join.
    """
    steps = [F.lit(True), (F.col("latest_input_available_at") <= as_of) & (F.col("recorded_at") <= as_of), F.col("provider_code") == provider, F.col("calendar_code") == calendar, F.col("policy_code") == policy]
    named, holds = [], None
    for name, step in zip(FLAGS, steps):
        holds = step if holds is None else holds & step
        named.append((name, holds))
    have = labels.select("outcome_id", F.col("scoring_item_id").alias("label_item"), "label_policy_code")
    both = outcomes.join(have, "outcome_id", "left")
    any_label = holds & (F.col("label_item") == F.col("scoring_item_id"))
    named += [("has_any_label", any_label), ("has_matching_label", any_label & (F.col("label_policy_code") == label_policy))]
    flags = both.groupBy("scoring_item_id").agg(*(F.max(F.coalesce(x, F.lit(False))).alias(k) for k, x in named))
    joined = items.join(flags, "scoring_item_id", "left")
    return joined.withColumns({k: F.coalesce(F.col(k), F.lit(False)) for k, _ in named})


def exclusion_reason(included: Column, policy_matches: Column) -> Column:
    """Why an item is not in the dataset, first match; null if it is."""
    incomplete = F.array_contains("quality_reason_codes", "VOLUME_DATA_INCOMPLETE")
    unready = (F.col("source_quality_status") != "READY") | F.coalesce(F.col("feature_quality_status") != "READY", F.lit(True))
    not_ready = F.when(incomplete, "VOLUME_DATA_INCOMPLETE").when(unready, "FEATURE_QUALITY_NOT_READY").otherwise("SCORE_NOT_READY")
    return (
        F.when(included, F.lit(None).cast("string")).when(~policy_matches, "OTHER_CONTRACT_FAILURE")
        .when(F.col("scoring_outcome") != "SCORED_READY", not_ready).when(F.col("overall_score").isNull() | F.col("source_rank").isNull(), "MISSING_SCORE")
        .when(~F.col("has_any_outcome"), "OUTCOME_NOT_FOUND").when(~F.col("has_as_of_outcome"), "OUTCOME_NOT_AVAILABLE_AS_OF")
        .when(~F.col("has_provider_outcome"), "PROVIDER_MISMATCH").when(~F.col("has_calendar_outcome"), "CALENDAR_MISMATCH")
        .when(~F.col("has_policy_outcome"), "OUTCOME_POLICY_MISMATCH").when(~F.col("has_any_label"), "LABEL_NOT_FOUND")
        .when(~F.col("has_matching_label"), "LABEL_POLICY_MISMATCH").otherwise("OTHER_CONTRACT_FAILURE")
    )


def exclusion_funnel(records: DataFrame) -> DataFrame:
    """(position, reason, items) of all reasons, those without items too. records has exclusion_reason."""
    spark = records.sparkSession
    order = spark.createDataFrame(list(enumerate(EXCLUSIONS, 1)), "position int, reason string")
    counts = records.where("exclusion_reason is not null").groupBy(F.col("exclusion_reason").alias("reason")).agg(F.count(F.lit(1)).alias("items"))
    return order.join(counts, "reason", "left").select("position", "reason", F.coalesce("items", F.lit(0)).cast("long").alias("items"))


def upstream_facts(records: DataFrame) -> DataFrame:
    """One row of counts over the lineage of a dataset."""
    has = lambda c: F.col(c)
    incomplete = F.array_contains("quality_reason_codes", "VOLUME_DATA_INCOMPLETE")
    scored = F.col("scoring_outcome").isin("SCORED_READY", "SCORED_DEGRADED")
    n = F.count(F.lit(1))
    return records.agg(
        n.alias("items"), F.count_if(F.col("scoring_outcome") == "SCORED_READY").alias("scored_ready"), F.count_if(F.col("scoring_outcome") == "SCORED_DEGRADED").alias("scored_degraded"),
        F.count_if(~scored).alias("skipped_failed"), F.count_if(F.col("feature_quality_status") == "READY").alias("feature_ready"),
        F.count_if(F.col("feature_quality_status") == "DEGRADED").alias("feature_degraded"), F.count_if(incomplete).alias("volume_incomplete"),
        F.count_if(~has("has_any_outcome")).alias("missing_outcome"), F.count_if(has("has_any_outcome") & ~has("has_as_of_outcome")).alias("missing_as_of"),
        F.count_if(has("has_as_of_outcome") & ~has("has_provider_outcome")).alias("provider_mismatch"), F.count_if(has("has_provider_outcome") & ~has("has_calendar_outcome")).alias("calendar_mismatch"),
        (F.count_if(~has("policy_matches")) + F.count_if(has("has_calendar_outcome") & ~has("has_policy_outcome"))).alias("policy_mismatch"),
        F.count_if(has("has_policy_outcome") & ~has("has_any_label")).alias("missing_label"),
        F.countDistinct("source_session_date").alias("sessions"), F.countDistinct("mic_code", "symbol").alias("symbols"),
    )


def provider_distribution(records: DataFrame) -> DataFrame:
    """(provider_code, six counts) of the lineage: items, their feature quality, incomplete volumes, and what is included."""
    return records.groupBy("provider_code").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("feature_quality_status") == "READY").alias("ready"), F.count_if(F.col("feature_quality_status") == "DEGRADED").alias("degraded"),
        F.count_if(F.col("pipeline_outcome") == "DATA_INSUFFICIENT").alias("insufficient"), F.count_if(F.array_contains("quality_reason_codes", "VOLUME_DATA_INCOMPLETE")).alias("volume_incomplete"),
        F.count_if(F.col("exclusion_reason").isNull()).alias("included"),
    )


def price_only_reason(values: str = "feature_values") -> Column:
    """Why an item could not be used for its prices alone, first match; null if it could. ``values`` is a map of texts.

    Prices are judged in one pass over the map: a look-up for each would make a task's code too long to be compiled.
    """
    one = lambda k: F.try_element_at(F.col(values), F.lit(k))
    prices = F.map_values(F.map_filter(values, lambda k, _: k.isin(*PRICE_FEATURES)))
    lacking = F.size(prices) < len(PRICE_FEATURES)
    invalid = F.exists(prices, lambda v: ~F.coalesce(v.rlike(r"^(0|-?(0|[1-9][0-9]*)(\.[0-9]*[1-9])?)$") & (v != "-0"), F.lit(False)))
    reasons = F.col("quality_reason_codes")
    volume_only = (F.size(reasons) > 0) & (F.size(F.array_except(reasons, F.array(F.lit("VOLUME_DATA_INCOMPLETE"), F.lit("VOLUME_DATA_UNUSABLE")))) == 0)
    quality = F.col("feature_quality_status")
    return (
        F.when(F.col("feature_set").isNull() | quality.isNull() | F.col(values).isNull() & (F.col("feature_set") == "v1"), "FEATURE_LINEAGE_UNAVAILABLE")
        .when(F.col("feature_set") != "v1", "FEATURE_POLICY_NOT_V1").when(lacking, "PRICE_FEATURE_MISSING").when(invalid, "PRICE_FEATURE_INVALID")
        .when(F.coalesce(one("adjustment_basis") != "SPLIT_ADJUSTED", F.lit(True)), "ADJUSTMENT_BASIS_INVALID")
        .when(F.coalesce(one("completed_bar_count") != "21", F.lit(True)), "COMPLETED_BAR_COUNT_INVALID")
        .when((quality == "READY") & (F.size(reasons) > 0), "QUALITY_REASON_INELIGIBLE").when(quality == "READY", F.lit(None).cast("string"))
        .when(quality != "DEGRADED", "QUALITY_STATUS_INELIGIBLE").when(~volume_only, "QUALITY_REASON_INELIGIBLE")
    )


def price_only_eligibility(records: DataFrame) -> DataFrame:
    """One row; where any lineage is unavailable, no derived count can be given and all are NOT_DERIVABLE."""
    reason = F.col("reason")
    judged = records.withColumn("reason", price_only_reason())
    gate = F.bool_or(F.coalesce(reason == "FEATURE_LINEAGE_UNAVAILABLE", F.lit(False)))
    derived = lambda x: F.when(F.coalesce(gate, F.lit(False)), NOT_DERIVABLE).otherwise(x.cast("string"))
    complete = reason.isNull() | ~reason.isin("FEATURE_LINEAGE_UNAVAILABLE", "FEATURE_POLICY_NOT_V1", "PRICE_FEATURE_MISSING", "PRICE_FEATURE_INVALID")
    return judged.agg(
        F.count(F.lit(1)).alias("items"), derived(F.count_if(complete)).alias("price_complete"), derived(F.count_if(reason.isNull())).alias("eligible"),
        derived(F.count_if(reason.isNotNull())).alias("ineligible"), derived(F.count_if(reason.isNull() & (F.col("feature_quality_status") == "DEGRADED"))).alias("volume_only_degraded"),
    )


def percentage(count: Column, whole: Column) -> Column:
    """A percentage with six places, half to even, as text; ZERO_DENOMINATOR for an empty whole."""
    exact = F.bround((count * 100).cast("decimal(20,0)") / F.nullif(whole, F.lit(0)).cast("decimal(18,0)"), 6).cast("decimal(20,6)")
    return F.when(whole == 0, "ZERO_DENOMINATOR").otherwise(exact.cast("string"))


def horizon_groups(datasets: DataFrame) -> DataFrame:
    """(horizon, datasets, items, dataset_ids): sums and sorted ids of each horizon."""
    return datasets.groupBy("horizon").agg(F.count(F.lit(1)).alias("datasets"), F.sum("items").alias("items"), F.array_join(F.sort_array(F.collect_list("dataset_id")), ",").alias("dataset_ids"))


def order_violations(rows: DataFrame, listing: str = "dataset", ordinal: str = "ordinal") -> DataFrame:
    """(rule, rows) of a numbered table: none in a sound one.

    Ordinals run from 1 to the number of rows, each comes once, and each row stands behind the one before it in the
    listing's order. Neighbours are found by a join on the ordinal, not by numbering anew.
    """
    key = F.struct(*LISTINGS[listing])
    here = rows.select(F.col(ordinal).alias("o"), key.alias("k"))
    facts = here.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o").alias("d"), F.min("o").alias("lo"), F.max("o").alias("hi"))
    gaps = F.when(F.col("n") == 0, 0).when((F.col("lo") == 1) & (F.col("hi") == F.col("n")), F.lit(0)).otherwise(1).cast("long")
    told = facts.select(F.explode(F.array(F.struct(F.lit("REPEATED_ORDINAL").alias("rule"), (F.col("n") - F.col("d")).alias("rows")), F.struct(F.lit("NOT_FROM_1_TO_N").alias("rule"), gaps.alias("rows")))).alias("x")).select("x.*")
    after = here.select((F.col("o") - 1).alias("o"), F.col("k").alias("next"))
    wrong = here.join(after, "o").where(F.col("k") >= F.col("next")).agg(F.lit("OUT_OF_ORDER").alias("rule"), F.count(F.lit(1)).alias("rows"))
    return told.unionByName(wrong).where("rows > 0")


#: Levels of an audit, from the grouping of (provider_code, source_session_date, horizon): a bit is 1 where a column is summed over.
AUDIT_LEVELS = {3: "PROVIDER", 5: "SESSION", 6: "HORIZON", 1: "PROVIDER_SESSION", 7: "TOTAL"}


def audit_levels(records: DataFrame) -> DataFrame:
    """(level, provider_code, source_session_date, horizon, counts) of the lineage, for all levels in one pass.

    A column is null where its level sums over it; a value that is null itself is told from that by ``level``. Each record
    is read once, and its partial sums for all levels are made before anything is shuffled. An empty lineage has no
    rows, no TOTAL either.
    """
    p, s, h = "provider_code", "source_session_date", "horizon"
    level = F.create_map(*(x for k, v in AUDIT_LEVELS.items() for x in (F.lit(k), F.lit(v))))
    counts = records.groupingSets([[p], [s], [h], [p, s], []], p, s, h).agg(
        F.grouping_id(p, s, h).cast("int").alias("_level"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("feature_quality_status") == "READY").alias("ready"), F.count_if(F.col("feature_quality_status") == "DEGRADED").alias("degraded"),
        F.count_if(F.array_contains("quality_reason_codes", "VOLUME_DATA_INCOMPLETE")).alias("volume_incomplete"), F.count_if(F.col("exclusion_reason").isNull()).alias("included"), F.countDistinct("symbol").alias("symbols"),
    )
    return counts.select(level[F.col("_level")].alias("level"), p, s, h, "total", "ready", "degraded", "volume_incomplete", "included", "symbols")


#: What of a dataset's rows its digest covers, and how many digests become one.
DIGESTED, BLOCK = ("label", "observation_mode", "ordinal", "outcome_id", "overall_score", "scoring_item_id"), 4096


def content_digest(rows: DataFrame, columns: tuple[str, ...] = DIGESTED, ordinal: str = "ordinal", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, digest): for a dataset, or for each parent of ``by``, a digest of its rows in the order of their ordinals.

    Each row's canonical JSON is digested; then, three times over, up to BLOCK digests that follow each other by ordinal
    become one, which orders 6.8e10 rows without a task that holds them all. Scores have six places. Rows that share an
    ordinal are ordered by their digests; an empty dataset has the digest of nothing, a parent without rows none.
    """
    text = {c: (F.col(c).cast("decimal(20,6)").cast("string") if c == "overall_score" else F.col(c)) for c in columns}
    made = rows.select(*by, (F.col(ordinal).cast("long") - 1).alias("i"), digest(canonical_json(**text)).alias("d"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("i", "d"))), lambda x: x["d"])
    for _ in range(3):
        made = made.groupBy(*by, F.expr(f"i div {BLOCK}").alias("i")).agg(digest(F.array_join(ordered, "")).alias("d"))
    last = F.when(F.count(F.lit(1)) == 1, F.max("d")).otherwise(digest(F.array_join(ordered, "")))  # one, unless ordinals are out of range
    return made.groupBy(*by).agg(last.alias("digest")) if by else made.agg(last.alias("digest"))


def dataset_validity(rows: DataFrame, stored_digest: str, listing: str = "dataset") -> DataFrame:
    """(canonical_order_valid, content_digest_valid): whether a dataset's rows stand in their order from 1 to n, and are those that its digest was made of."""
    order = order_violations(rows, listing).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("broken")).withColumn("digest", F.lit(None).cast("string"))
    both = order.unionByName(content_digest(rows).withColumn("broken", F.lit(None).cast("long")))
    return both.agg((F.max("broken") == 0).alias("canonical_order_valid"), (F.max("digest") == stored_digest).alias("content_digest_valid"))
