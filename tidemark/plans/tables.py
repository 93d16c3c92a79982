"""Tables of the store: columns, natural keys, and rules that rows have to meet, which Parquet does not enforce."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Table:
    columns: str
    keys: tuple[tuple[str, ...], ...]
    checks: tuple[str, ...] = ()

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.columns)


_P = "decimal(38,18)"

TABLES: dict[str, Table] = {
    "market_snapshots": Table(f"snapshot_id string, source_code string, symbol string, observed_at timestamp, open_price {_P}, high_price {_P}, low_price {_P}, last_price {_P}, previous_close_price {_P}, volume bigint", (("source_code", "symbol", "observed_at"),), ("low_price <= least(open_price, last_price)", "high_price >= greatest(open_price, last_price)", "volume is null or volume >= 0")),
    "candidates": Table("candidate_id string, run_id string, snapshot_id string, candidate_source string, selected_at timestamp, rank int", (("run_id", "snapshot_id", "candidate_source"),), ("rank is null or rank > 0",)),
    "filter_evaluations": Table("evaluation_id string, candidate_id string, filter_set string, filter_version string, score int, passed boolean, details string, evaluated_at timestamp", (("candidate_id", "filter_set", "filter_version"),), ("score between 0 and 100", "get_json_object(details, '$') is not null")),
    "strategy_decisions": Table("decision_id string, decision_key string, candidate_id string, position_id string, strategy_id string, action string, reason_codes array<string>, decided_at timestamp", (("decision_key",),), ("(candidate_id is null) <> (position_id is null)", "candidate_id is null or action in ('ENTER_LONG', 'SKIP', 'OBSERVE')", "position_id is null or action in ('EXIT_LONG', 'HOLD')")),
    "trade_intents": Table(f"intent_id string, decision_id string, idempotency_key string, symbol string, side string, order_type string, time_in_force string, quantity bigint, limit_price {_P}, status string", (("decision_id",), ("idempotency_key",)), ("time_in_force = 'DAY'", "order_type <> 'MARKET' or limit_price is null", "status = 'REJECTED' or quantity > 0")),
    "paper_orders": Table("order_id string, intent_id string, client_order_id string, status string, version int, accepted_at timestamp", (("intent_id",), ("client_order_id",)), ("version > 0", "status in ('ACCEPTED', 'PARTIALLY_FILLED', 'FILLED', 'REJECTED')")),
    "paper_fills": Table(f"fill_id string, order_id string, execution_key string, fill_sequence int, quantity bigint, price {_P}, fee {_P}, executed_at timestamp", (("execution_key",), ("order_id", "fill_sequence")), ("quantity > 0", "price > 0", "fee = 0")),
    "paper_positions": Table(f"position_id string, strategy_id string, symbol string, currency string, status string, quantity bigint, average_cost_price {_P}, realized_pnl {_P}, version int, opened_at timestamp, closed_at timestamp", (("position_id",),), ("(status = 'OPEN') = (quantity > 0 and closed_at is null)", "version > 1 or (status = 'OPEN' and realized_pnl = 0)")),
    "position_events": Table(f"event_id string, position_id string, fill_id string, sequence_no int, quantity_delta bigint, price {_P}, occurred_at timestamp", (("fill_id",), ("position_id", "sequence_no")), ("quantity_delta <> 0", "sequence_no > 0")),
    "equity_snapshots": Table(f"snapshot_key string, observed_at timestamp, cash {_P}, equity {_P}, currency string", (("snapshot_key",),)),
    "trading_events": Table("dedup_key string, event_type string, occurred_at timestamp, payload string", (("dedup_key",),)),
    "feature_snapshots": Table("feature_snapshot_id string, snapshot_key string, content_digest string, symbol string, as_of timestamp, generated_at timestamp, horizon int, feature_set_code string, feature_set_version string, quality_status string, quality_reason_codes array<string>, feature_values map<string,string>, provenance array<struct<source:string,key:string,available_at:timestamp>>", (("snapshot_key",),), ("generated_at >= as_of", "horizon between 1 and 5", "forall(provenance, p -> p.available_at <= as_of)")),
    "recommendations": Table(f"recommendation_id string, recommendation_key string, feature_snapshot_id string, disposition string, entry_low {_P}, entry_high {_P}, target {_P}, stop {_P}, generated_at timestamp", (("recommendation_key",),), ("entry_low is null or (stop < entry_low and entry_low <= entry_high and entry_high < target)",)),
    "daily_market_bars": Table(f"daily_market_bar_id string, bar_key string, content_digest string, source_code string, source_record_key string, source_version string, symbol string, currency string, adjustment_basis string, session_date date, observed_at timestamp, available_at timestamp, open_price {_P}, high_price {_P}, low_price {_P}, close_price {_P}, volume bigint, recorded_at timestamp", (("source_code", "source_record_key", "source_version"), ("source_code", "symbol", "adjustment_basis", "session_date", "available_at")), ("currency = 'USD'", "observed_at <= available_at", "low_price > 0", "low_price <= least(open_price, close_price)", "high_price >= greatest(open_price, close_price)", "volume is null or volume >= 0")),
    "universe_snapshots": Table("universe_id string, universe_key string, universe_code string, universe_version string, members array<struct<mic:string,symbol:string>>", (("universe_key",),), ("size(members) between 1 and 100", "size(array_distinct(members)) = size(members)")),
    "feature_pipeline_runs": Table("run_id string, run_key string, total_count int, ready_count int, degraded_count int, data_insufficient_count int, no_data_count int, provider_error_count int, calendar_error_count int, not_attempted_count int, status string", (("run_key",),), ("total_count = ready_count + degraded_count + data_insufficient_count + no_data_count + provider_error_count + calendar_error_count + not_attempted_count",)),
    "feature_pipeline_items": Table("run_id string, ordinal int, mic_code string, symbol string, outcome string, completed_session_date date, feature_snapshot_id string", (("run_id", "ordinal"), ("run_id", "mic_code", "symbol")), ("ordinal between 1 and 100", "(outcome in ('READY', 'DEGRADED')) = (feature_snapshot_id is not null)")),
    "feature_scoring_runs": Table("scoring_run_id string, scoring_run_key string, source_run_id string, scored_count int, unscorable_count int, status string, generated_at timestamp", (("scoring_run_key",),), ("scored_count > 0 or status = 'NO_SCORABLE_ITEMS'",)),
    "feature_scoring_items": Table("scoring_item_id string, scoring_run_id string, symbol string, mic_code string, outcome string, overall_score decimal(9,6), rank int", (("scoring_run_id", "mic_code", "symbol"),), ("(outcome like 'SCORED%') = (overall_score is not null and rank is not null)", "overall_score is null or overall_score between 0 and 100")),
    "feature_outcomes": Table("outcome_id string, outcome_key string, scoring_item_id string, horizon_trading_days int, bar_count int, return_rate decimal(38,18), mfe_rate decimal(38,18), mae_rate decimal(38,18), latest_input_available_at timestamp, recorded_at timestamp", (("outcome_key",),), ("bar_count = horizon_trading_days", "mae_rate <= return_rate and return_rate <= mfe_rate")),
    "outcome_observation_runs": Table("observation_run_id string, observation_run_key string, scoring_run_id string, grace_seconds int, status string", (("observation_run_key",),), ("grace_seconds between 0 and 86400",)),
    "outcome_observation_items": Table("observation_run_id string, ordinal int, scoring_item_id string, outcome string, outcome_id string", (("observation_run_id", "ordinal"),), ("(outcome like 'OUTCOME%') = (outcome_id is not null)",)),
    "outcome_labels": Table("label_id string, label_key string, outcome_id string, label_value string, generated_at timestamp", (("label_key",),), ("label_value in ('POSITIVE', 'NOT_POSITIVE')",)),
    "calibration_datasets": Table("dataset_id string, dataset_key string, total_count int, positive_count int, not_positive_count int, prospective_count int, replay_count int, status string", (("dataset_key",),), ("total_count = positive_count + not_positive_count", "total_count = prospective_count + replay_count", "(status = 'EMPTY') = (total_count = 0)")),
    "calibration_dataset_items": Table("dataset_id string, ordinal int, scoring_item_id string, outcome_id string, label_value string, observation_mode string", (("dataset_id", "ordinal"), ("dataset_id", "scoring_item_id")), ("ordinal > 0",)),
}


def violations(df: DataFrame, name: str) -> DataFrame:
    """(rule, rows): how many rows break each rule of a table, and how many are more than their key allows; sound tables give none."""
    table = TABLES[name]
    checks = df.agg(*(F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias(f"c{i}") for i, c in enumerate(table.checks)), F.count(F.lit(1)).alias("n"))
    found = checks.select(F.explode(F.array(*(F.struct(F.lit(c).alias("rule"), F.col(f"c{i}").alias("rows")) for i, c in enumerate(table.checks)), F.struct(F.lit("").alias("rule"), F.lit(0).cast("long").alias("rows")))).alias("x")).select("x.*")
    for key in table.keys:
        again = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        found = found.unionByName(again.agg(F.lit(f"unique ({', '.join(key)})").alias("rule"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows")))
    return found.where("rows > 0")


def orphans(df: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose parent is not there."""
    return df.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def changed_since_written(df: DataFrame, recomputed: str, stored: str) -> DataFrame:
    """Rows whose stored key or digest is not that of their content: verification on reading."""
    return df.where(~F.col(recomputed).eqNullSafe(F.col(stored)))
