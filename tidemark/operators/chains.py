"""Chains of records: joins along keys, with the first link or rule that does not hold as a named problem."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import snapshot_problem


@dataclass(frozen=True)
class Hop:
    """The step from a column of what is joined so far to the key of a table, whose columns get a prefix."""

    table: DataFrame
    prefix: str
    key: str
    of: str
    missing: str


def _failed(problem: Column, rules: Mapping[str, Column]) -> Column:
    """problem, else the first rule that does not hold; one that is null does not."""
    for name, holds in rules.items():
        problem = F.coalesce(problem, F.when(~F.coalesce(holds, F.lit(False)), name))
    return problem


def followed(rows: DataFrame, hops: list[Hop], rules: Mapping[str, Column], before: Mapping[str, Column] | None = None) -> DataFrame:
    """rows with the columns of each hop (prefix_column) and (problem): the first rule of ``before`` that fails, else the first hop without a row, else the first rule that fails.

    Keys are unique in their tables, so each row stays one row. A rule that is null fails.
    """
    made, missing = rows, _failed(F.lit(None).cast("string"), before or {})
    for hop in hops:
        theirs = hop.table.select(*(F.col(c).alias(f"{hop.prefix}_{c}") for c in hop.table.columns), F.lit(True).alias(f"_{hop.prefix}"))
        made = made.join(theirs, F.col(hop.of) == F.col(f"{hop.prefix}_{hop.key}"), "left")
        missing = F.coalesce(missing, F.when(F.col(f"_{hop.prefix}").isNull(), hop.missing))
    return made.withColumn("problem", _failed(missing, rules)).drop(*(f"_{hop.prefix}" for hop in hops))


def _entry_hops(intents: DataFrame, decisions: DataFrame, intent_of: str) -> list[Hop]:
    return [Hop(intents, "intent", "intent_id", intent_of, "trade_intent_missing"), Hop(decisions, "decision", "decision_id", "intent_decision_id", "strategy_decision_missing")]


def _market_hops(candidates: DataFrame, snapshots: DataFrame) -> list[Hop]:
    return [Hop(candidates, "candidate", "candidate_id", "decision_candidate_id", "candidate_missing"), Hop(snapshots, "snapshot", "snapshot_id", "candidate_snapshot_id", "market_snapshot_missing")]


def projection_sources(fills: DataFrame, orders: DataFrame, intents: DataFrame, decisions: DataFrame, candidates: DataFrame, snapshots: DataFrame) -> DataFrame:
    """fills (order_id, quantity, price, fee, fee_currency, executed_at) with (problem): back to the snapshot, and whether all of it agrees.

    orders: (order_id, intent_id, broker_code, status, accepted_at); intents: (intent_id, decision_id, side, symbol,
    currency); decisions: (decision_id, candidate_id, action); candidates: (candidate_id, snapshot_id); snapshots:
    (snapshot_id, symbol, last_price).
    """
    hops = [Hop(orders, "order", "order_id", "order_id", "paper_order_missing"), *_entry_hops(intents, decisions, "order_intent_id"), *_market_hops(candidates, snapshots)]
    c = F.col
    return followed(fills, hops, {
        "unsupported_side": c("intent_side") == "BUY", "nonpositive_fill": (c("quantity") > 0) & (c("price") > 0),
        "order_state_mismatch": (c("order_broker_code") == "INTERNAL_PAPER") & c("order_status").isin("PARTIALLY_FILLED", "FILLED") & c("order_accepted_at").isNotNull(),
        "source_value_mismatch": (c("intent_symbol") == c("snapshot_symbol")) & (c("price") == c("snapshot_last_price")) & (c("fee_currency") == c("intent_currency"))
        & (c("fee") == 0) & (c("decision_action") == "ENTER_LONG") & (c("executed_at") >= c("order_accepted_at")),
    })


def fill_sources(orders: DataFrame, intents: DataFrame, decisions: DataFrame, candidates: DataFrame, snapshots: DataFrame) -> DataFrame:
    """orders (order_id, intent_id, broker_code, status, accepted_at) with (problem): whether a next fill can be made from their snapshots.

    The order itself comes first, its broker and status; then what it came from, the snapshot's symbol, the shape of what
    was asked for, and its acceptance. intents: (intent_id, decision_id, symbol, currency, side, order_type, limit_price,
    time_in_force, requested_quantity).
    """
    c = F.col
    shape = (
        (c("intent_currency") == "USD") & (c("intent_side") == "BUY") & (c("intent_order_type") == "MARKET") & c("intent_limit_price").isNull() & (c("intent_time_in_force") == "DAY") & (c("intent_requested_quantity") > 0)
    )
    return followed(orders, [*_entry_hops(intents, decisions, "intent_id"), *_market_hops(candidates, snapshots)], {
        "symbol_mismatch": c("intent_symbol") == c("snapshot_symbol"), "accepted_request_shape_mismatch": shape, "acceptance_missing": c("accepted_at").isNotNull(),
    }, {"unsupported_broker": c("broker_code") == "INTERNAL_PAPER", "order_not_fillable": c("status").isin("ACCEPTED", "PARTIALLY_FILLED")})


#: How old a snapshot may be when an exit is asked for, and how far ahead of the clock (fixed values).
OLDEST, AHEAD = "interval 5 minutes", "interval 30 seconds"


def exit_sources(asked: DataFrame, positions: DataFrame, events: DataFrame, fills: DataFrame, orders: DataFrame, intents: DataFrame, decisions: DataFrame, snapshots: DataFrame, currency: str = "USD", strategies: Mapping[str, str] | None = None) -> DataFrame:
    """asked (position_id, snapshot_id, asked_at) with (problem): the event of a position's version, back to its entry decision.

    positions: (position_id, strategy_id, symbol, currency, status, quantity, average_cost, realized_pnl, version,
    updated_at, closed_at); events: (position_id, sequence_no, fill_id, event_type, quantity_after, average_cost_after,
    realized_pnl_after, occurred_at); fills: (fill_id, order_id, executed_at); decisions: (decision_id, strategy_id,
    strategy_version, action). ``strategies`` names the version of each strategy that has a policy for exits.
    """
    c = F.col
    keyed = events.withColumn("key", F.struct("position_id", F.col("sequence_no").cast("long")))
    rows = asked
    hops = [Hop(positions, "position", "position_id", "position_id", "position_missing"), Hop(snapshots, "snapshot", "snapshot_id", "snapshot_id", "snapshot_missing")]
    rows = followed(rows, hops, {}).withColumnRenamed("problem", "_first").withColumn("_event_key", F.struct("position_id", c("position_version").cast("long").alias("sequence_no")))
    hops = [
        Hop(keyed, "event", "key", "_event_key", "position_event_missing"), Hop(fills, "fill", "fill_id", "event_fill_id", "paper_fill_missing"), Hop(orders, "order", "order_id", "fill_order_id", "paper_order_missing"),
        Hop(intents, "intent", "intent_id", "order_intent_id", "trade_intent_missing"), Hop(decisions, "decision", "decision_id", "intent_decision_id", "entry_decision_missing"),
    ]
    known = F.lit(strategies is None)
    for strategy, version in (strategies or {}).items():
        known = known | (c("decision_strategy_id") == strategy) & (c("decision_strategy_version") == version)
    rules = {
        "unsupported_strategy_version": known,
        "position_not_open": (c("position_status") == "OPEN") & (c("position_quantity") > 0) & c("position_closed_at").isNull() & (c("position_version") > 0),
        "position_event_mismatch": (c("event_quantity_after") == c("position_quantity")) & (c("event_average_cost_after") == c("position_average_cost")) & (c("event_realized_pnl_after") == c("position_realized_pnl")) & (c("event_occurred_at") <= c("position_updated_at")) & c("event_event_type").isin("OPENED", "INCREASED"),
        "source_identity_mismatch": c("event_occurred_at") == c("fill_executed_at"),
        "strategy_source_mismatch": (c("decision_action") == "ENTER_LONG") & (c("decision_strategy_id") == c("position_strategy_id")) & (c("intent_symbol") == c("position_symbol")) & (c("intent_currency") == c("position_currency")),
        "unsupported_currency": c("position_currency") == currency, "symbol_mismatch": c("snapshot_symbol") == c("position_symbol"),
        "snapshot_precedes_position": (c("snapshot_observed_at") >= c("position_updated_at")) & (c("snapshot_observed_at") >= c("event_occurred_at")),
        "snapshot_too_far_in_future": c("snapshot_observed_at") <= c("asked_at") + F.expr(AHEAD), "snapshot_stale": c("asked_at") - c("snapshot_observed_at") <= F.expr(OLDEST),
    }
    made = followed(rows, hops, rules)
    return made.withColumn("problem", F.coalesce("_first", "problem")).drop("_first", "_event_key", "event_key")


def decision_sources(candidates: DataFrame, evaluations: DataFrame, strategies: Mapping[str, tuple[str, str]]) -> DataFrame:
    """(candidate_id, strategy_id, problem) for each candidate and strategy: its filter set's evaluation of the right version has to be there once.

    ``strategies``: strategy -> (filter set, version), a handful. evaluations: (candidate_id, filter_set, version, score).
    """
    wanted = F.explode(F.array(*(F.struct(F.lit(k).alias("strategy_id"), F.lit(s).alias("filter_set"), F.lit(v).alias("version")) for k, (s, v) in strategies.items()))).alias("w")
    asked = candidates.select("candidate_id", wanted).select("candidate_id", "w.*")
    found = evaluations.groupBy("candidate_id", "filter_set", "version").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("scores"))
    problem = F.when(F.col("n").isNull(), "evaluation_missing").when(F.col("n") != 1, "duplicate_source").when(F.col("scores") == 0, "invalid_score")
    return asked.join(found, ["candidate_id", "filter_set", "version"], "left").select("candidate_id", "strategy_id", problem.alias("problem"))


def outcome_sources(outcomes: DataFrame, items: DataFrame, runs: DataFrame) -> DataFrame:
    """outcomes joined with their scored item and its run, where all five records of the chain are the same ones for both.

    outcomes and items have scoring_item_id, scoring_run_id, pipeline_item_id and feature_snapshot_id; outcomes and runs
    pipeline_run_id too.
    """
    r = runs.select("scoring_run_id", "pipeline_run_id", *(c for c in runs.columns if c not in ("scoring_run_id", "pipeline_run_id")))
    return outcomes.join(items, ["scoring_item_id", "scoring_run_id", "pipeline_item_id", "feature_snapshot_id"]).join(r, ["scoring_run_id", "pipeline_run_id"])


def lineage_records(items: DataFrame, runs: DataFrame, pipeline_items: DataFrame, pipeline_runs: DataFrame, snapshots: DataFrame, as_of: Column, horizon: int) -> DataFrame:
    """Scored items known at ``as_of`` with their run, their pipeline's item and run, and, if it is there, their snapshot.

    items: (scoring_item_id, scoring_run_id, pipeline_item_id, feature_snapshot_id, recorded_at); runs: (scoring_run_id,
    pipeline_run_id, generated_at); pipeline_items: (pipeline_item_id, pipeline_run_id); pipeline_runs:
    (pipeline_run_id, horizon); snapshots: (feature_snapshot_id). Filters stand before the joins.
    """
    known = items.where(F.col("recorded_at") <= as_of).join(runs.where(F.col("generated_at") <= as_of), "scoring_run_id")
    members = pipeline_items.join(pipeline_runs.where(F.col("horizon") == horizon), "pipeline_run_id")
    return known.join(members, ["pipeline_item_id", "pipeline_run_id"]).join(snapshots, "feature_snapshot_id", "left")


def with_chain(items: DataFrame, pipeline_items: DataFrame, snapshots: DataFrame) -> DataFrame:
    """items with (chain_valid): whether pipeline item and snapshot are there and agree on identity, symbol, quality, horizon and session.

    items: (pipeline_item_id, feature_snapshot_id, symbol, quality, horizon, session_date, reference_close).
    """
    p = pipeline_items.select("pipeline_item_id", *(F.col(c).alias(f"_p_{c}") for c in ("feature_snapshot_id", "symbol", "session_date")))
    s = snapshots.select("feature_snapshot_id", *(F.col(c).alias(f"_s_{c}") for c in ("symbol", "quality", "horizon")))
    c = F.col
    same = (
        c("_p_feature_snapshot_id").eqNullSafe(c("feature_snapshot_id")) & c("_p_symbol").eqNullSafe(c("symbol")) & c("_p_session_date").eqNullSafe(c("session_date"))
        & c("_s_symbol").eqNullSafe(c("symbol")) & c("_s_quality").eqNullSafe(c("quality")) & c("_s_horizon").eqNullSafe(c("horizon"))
    )
    made = items.join(p, "pipeline_item_id", "left").join(s, "feature_snapshot_id", "left")
    return made.withColumn("chain_valid", same & F.coalesce(c("reference_close") > 0, F.lit(False))).drop(*(x for x in made.columns if x.startswith(("_p_", "_s_"))))


#: What a pipeline run has to be for outcomes to be measured on it (fixed values).
OUTCOME_PIPELINE = {
    "pipeline_code": "US_EQUITY_DAILY_FEATURE_BATCH", "pipeline_version": "v1", "feature_set_code": "US_EQUITY_DAILY_TECHNICAL", "feature_set_version": "v1", "provider_code": "TWELVE_DATA_TIME_SERIES",
    "calendar_code": "US_EQUITY_CORE", "calendar_version": "2026.v1", "adjustment_basis": "SPLIT_ADJUSTED",
}


def outcome_source_chain(items: DataFrame, runs: DataFrame, pipelines: DataFrame, pipeline_items: DataFrame, snapshots: DataFrame, identity: Mapping[str, str] = OUTCOME_PIPELINE) -> DataFrame:
    """items with (problem, reference_close): whether all records that an outcome is measured on belong together, and the close that it is measured from.

    items: (scoring_run_id, pipeline_run_id, pipeline_item_id, feature_snapshot_id, symbol, mic_code, scoring_outcome,
    source_quality_status); runs: (scoring_run_id, pipeline_run_id); pipelines: (pipeline_run_id, the columns of
    ``identity``, horizon, as_of, completed_session_date); pipeline_items: (pipeline_item_id, pipeline_run_id, outcome,
    feature_quality_status, feature_snapshot_id, symbol, mic_code, completed_session_date); snapshots:
    (feature_snapshot_id, symbol, horizon, as_of and what ``scoring.snapshot_problem`` reads). Items outside SCORED_READY
    and SCORED_DEGRADED have no chain. The first link or equality that does not hold is named; a null never agrees.
    """
    c = F.col
    hops = [
        Hop(pipelines, "pipeline", "pipeline_run_id", "pipeline_run_id", "pipeline_run_missing"), Hop(snapshots, "snapshot", "feature_snapshot_id", "feature_snapshot_id", "feature_snapshot_missing"),
        Hop(runs, "run", "scoring_run_id", "scoring_run_id", "scoring_run_missing"), Hop(pipeline_items, "item", "pipeline_item_id", "pipeline_item_id", "pipeline_item_missing"),
    ]
    same = F.lit(True)
    for column, value in identity.items():
        same = same & (c(f"pipeline_{column}") == value)
    expected = F.when(c("scoring_outcome") == "SCORED_READY", "READY").when(c("scoring_outcome") == "SCORED_DEGRADED", "DEGRADED")
    reference = F.try_element_at(c("snapshot_feature_values"), F.lit("last_close")).try_cast("decimal(38,18)")
    rules = {
        "pipeline_identity_mismatch": same, "completed_session_missing": c("pipeline_completed_session_date").isNotNull(), "run_link_mismatch": c("run_pipeline_run_id") == c("pipeline_pipeline_run_id"),
        "pipeline_item_of_another_run": c("item_pipeline_run_id") == c("pipeline_pipeline_run_id"), "item_outcome_mismatch": c("item_outcome") == expected, "item_quality_mismatch": c("item_feature_quality_status") == expected,
        "item_snapshot_mismatch": c("item_feature_snapshot_id") == c("feature_snapshot_id"), "item_symbol_mismatch": c("item_symbol") == c("symbol"), "item_mic_mismatch": c("item_mic_code") == c("mic_code"),
        "source_quality_mismatch": c("item_feature_quality_status") == c("source_quality_status"), "item_session_missing": c("item_completed_session_date").isNotNull(),
        "feature_set_mismatch": (c("snapshot_feature_set_code") == c("pipeline_feature_set_code")) & (c("snapshot_feature_set_version") == c("pipeline_feature_set_version")), "horizon_mismatch": c("snapshot_horizon") == c("pipeline_horizon"),
        "as_of_mismatch": c("snapshot_as_of") == c("pipeline_as_of"), "snapshot_symbol_mismatch": c("snapshot_symbol") == c("symbol"), "snapshot_quality_mismatch": c("snapshot_quality_status") == c("source_quality_status"),
        "completed_session_mismatch": c("item_completed_session_date") == c("pipeline_completed_session_date"), "snapshot_contract_invalid": snapshot_problem(lambda x: c(f"snapshot_{x}")).isNull(), "reference_close_invalid": reference > 0,
    }
    made = followed(items, hops, rules)
    return made.select(*items.columns, "problem", F.when(c("problem").isNull(), reference).alias("reference_close"))


#: Forms of the keys and digests of dataset sources, and the exchanges they may come from (fixed values).
OUTCOME_KEY, DIGEST, MICS = "^daily-feature-outcome:v1:[0-9a-f]{64}$", "^[0-9a-f]{64}$", ("XNGS", "XNGM", "XNCM", "XNYS", "XASE")


def source_violations(sources: DataFrame, as_of: Column, horizon: int, policy: Mapping[str, str]) -> DataFrame:
    """sources with (problem): the first reason why a dataset may not take a row, or null.

    ``policy`` holds the value of each policy column. sources: (horizon, source_quality_status, source_rank, mic_code,
    source_session_date, terminal_session_date, outcome_key, content_digest, path_digest, scoring_generated_at,
    scoring_recorded_at, latest_input_available_at, recorded_at).
    """
    c = F.col
    agreed = F.lit(True)
    for column, value in policy.items():
        agreed = agreed & (c(column) == value)
    times = ("scoring_generated_at", "scoring_recorded_at", "latest_input_available_at", "recorded_at")
    rules = {
        "POLICY_MISMATCH": agreed, "HORIZON_MISMATCH": c("horizon") == horizon, "QUALITY_NOT_READY": c("source_quality_status") == "READY", "RANK_OUT_OF_RANGE": c("source_rank").between(1, 100),
        "UNSUPPORTED_MIC": c("mic_code").isin(*MICS), "SESSIONS_OUT_OF_ORDER": c("source_session_date") < c("terminal_session_date"), "KEY_MALFORMED": c("outcome_key").rlike(OUTCOME_KEY),
        "DIGEST_MALFORMED": c("content_digest").rlike(DIGEST) & c("path_digest").rlike(DIGEST), "GENERATED_AFTER_RECORDED": c("scoring_generated_at") <= c("scoring_recorded_at"),
        "AVAILABLE_AFTER_RECORDED": c("latest_input_available_at") <= c("recorded_at"), "AFTER_CUTOFF": F.greatest(*times) <= as_of,
    }
    return followed(sources, [], rules)


def input_violations(bars: DataFrame, asked: DataFrame, as_of: Column, run: str = "run") -> DataFrame:
    """(run, problem) for each run of ``asked`` (run, symbol, source_code): the first rule that its bars break, or null.

    Bars are of the symbol and the source that were asked for, in USD, adjusted for splits, known at ``as_of``, and one a
    session. A run without bars breaks none of these.
    """
    wanted = asked.select(run, F.col("symbol").alias("_symbol"), F.col("source_code").alias("_source"))
    joined = wanted.join(bars.withColumn("_bar", F.lit(True)), run, "left")
    broken = lambda ok: F.count_if(F.col("_bar") & ~F.coalesce(ok, F.lit(False))) > 0
    problem = (
        F.when(broken(F.col("symbol") == F.col("_symbol")), "MIXED_SYMBOLS").when(broken(F.col("source_code") == F.col("_source")), "MIXED_SOURCES").when(broken(F.col("currency") == "USD"), "CURRENCY_NOT_USD")
        .when(broken(F.col("adjustment_basis") == "SPLIT_ADJUSTED"), "BASIS_NOT_SPLIT_ADJUSTED").when(broken(F.col("available_at") <= as_of), "BAR_NOT_KNOWN")
        .when(F.countDistinct("session_date") < F.count("_bar"), "DUPLICATE_SESSION")
    )
    return joined.groupBy(run).agg(problem.alias("problem"))


def answered(requests: DataFrame, stored: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(requests still to be worked on, stored records that answer the others): looked up by key before any work is planned."""
    return requests.join(stored.select(key), key, "left_anti"), stored.join(requests.select(key).distinct(), key, "left_semi")
