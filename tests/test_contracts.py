"""Every named problem of scoring and of chains occurs in a query, and of two faults the first one is named."""

from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.operators import chains, datasets, scoring
from tidemark.operators.runs import aggregate_violations
from tidemark.plans.tables import TABLES

SF = "/root/testdata/sf0.01"
CODES = {
    "prepared_scoring_items": ("reason", {
        "SOURCE_ITEM_DATA_INSUFFICIENT", "FEATURE_SNAPSHOT_MISSING", "FEATURE_SOURCE_MISMATCH", "FEATURE_SET_CODE_MISMATCH", "FEATURE_SET_VERSION_MISMATCH", "FEATURE_KEY_CONTRACT_INVALID", "FEATURE_ADJUSTMENT_BASIS_INVALID",
        "FEATURE_COMPLETED_BAR_COUNT_INVALID", "FEATURE_READY_VOLUME_INCOMPLETE", "FEATURE_QUALITY_UNSUPPORTED", "FEATURE_DEGRADED_VOLUME_SHAPE_INVALID", "FEATURE_NUMERIC_VALUE_INVALID", None}),
    "fill_sources": ("problem", {
        "unsupported_broker", "order_not_fillable", "trade_intent_missing", "strategy_decision_missing", "candidate_missing", "market_snapshot_missing", "symbol_mismatch", "accepted_request_shape_mismatch", "acceptance_missing", "NONE"}),
    "exit_sources": ("problem", {
        "position_missing", "snapshot_missing", "position_event_missing", "paper_fill_missing", "paper_order_missing", "trade_intent_missing", "entry_decision_missing", "unsupported_strategy_version", "position_not_open",
        "position_event_mismatch", "source_identity_mismatch", "strategy_source_mismatch", "unsupported_currency", "symbol_mismatch", "snapshot_precedes_position", "snapshot_too_far_in_future", "snapshot_stale", "NONE"}),
    "outcome_chain": ("problem", {
        "pipeline_run_missing", "feature_snapshot_missing", "scoring_run_missing", "pipeline_item_missing", "pipeline_identity_mismatch", "completed_session_missing", "run_link_mismatch", "pipeline_item_of_another_run",
        "item_outcome_mismatch", "item_quality_mismatch", "item_snapshot_mismatch", "item_symbol_mismatch", "item_mic_mismatch", "source_quality_mismatch", "item_session_missing", "feature_set_mismatch", "horizon_mismatch",
        "as_of_mismatch", "snapshot_symbol_mismatch", "snapshot_quality_mismatch", "completed_session_mismatch", "snapshot_contract_invalid", "reference_close_invalid", "NONE"}),
    "input_violations": ("problem", {"MIXED_SYMBOLS", "MIXED_SOURCES", "CURRENCY_NOT_USD", "BASIS_NOT_SPLIT_ADJUSTED", "BAR_NOT_KNOWN", "DUPLICATE_SESSION", "NONE"}),
    "aggregate_contracts": ("problem", {"RUN_MISSING", "ITEMS_MISSING", "TOTAL_MISMATCH", "ORDINALS_NOT_1_TO_N", "COUNT_MISMATCH:scored_count", "COUNT_MISMATCH:unscorable_count", "DIGEST_MISMATCH", "NONE"}),
    "all_record_violations": ("table_name", set(TABLES)),
}


@pytest.mark.parametrize("name", CODES)
def test_every_code_occurs(name):
    """The SQL, which tests/test_oracle.py holds the query to, names each of them on the tables of the gate."""
    duck = duckdb.connect()
    for t in ("lineitem", "events", "orders"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    column, codes = CODES[name]
    assert {r[0] for r in duck.execute(f"SELECT DISTINCT {column} FROM ({catalog.ORACLE_SQL[name]})").fetchall()} == codes


SNAPSHOT = "id string, feature_set_code string, feature_set_version string, quality_status string, quality_reason_codes array<string>, feature_values map<string,string>"
GOOD = {c: "0.5" for c in scoring.SNAPSHOT_VALUES} | {"adjustment_basis": "SPLIT_ADJUSTED", "completed_bar_count": "21"}
DEGRADED = GOOD | dict.fromkeys(scoring.VOLUME_FEATURES)


def test_faults_of_snapshots_in_their_order(spark):
    code, odd = "US_EQUITY_DAILY_TECHNICAL", GOOD | {"one_day_return": "1e5"}
    rows = [
        ("ok", code, "v1", "READY", [], GOOD), ("ok degraded", code, "v1", "DEGRADED", ["VOLUME_DATA_UNUSABLE"], DEGRADED), ("FEATURE_SET_CODE_MISMATCH", "X", "v2", "READY", [], {}), ("FEATURE_SET_VERSION_MISMATCH", code, "v2", "OTHER", [], {}),
        ("FEATURE_KEY_CONTRACT_INVALID", code, "v1", "READY", [], {k: v for k, v in (odd | {"adjustment_basis": "RAW"}).items() if k != "last_close"}), ("FEATURE_KEY_CONTRACT_INVALID 2", code, "v1", "READY", [], GOOD | {"more": "1"}), ("FEATURE_KEY_CONTRACT_INVALID 3", code, "v1", "READY", [], None),
        ("FEATURE_ADJUSTMENT_BASIS_INVALID", code, "v1", "READY", [], GOOD | {"adjustment_basis": "RAW", "completed_bar_count": "20"}), ("FEATURE_COMPLETED_BAR_COUNT_INVALID", code, "v1", "OTHER", [], GOOD | {"completed_bar_count": "20"}),
        ("FEATURE_READY_VOLUME_INCOMPLETE", code, "v1", "READY", [], odd | {"volume_ratio_5_to_20": None}), ("FEATURE_QUALITY_UNSUPPORTED", code, "v1", "OTHER", [], odd), ("FEATURE_QUALITY_UNSUPPORTED 2", code, "v1", "DEGRADED", [], GOOD), ("FEATURE_QUALITY_UNSUPPORTED 3", code, "v1", None, None, GOOD),
        ("FEATURE_QUALITY_UNSUPPORTED 4", code, "v1", "DEGRADED", ["VOLUME_DATA_UNUSABLE", "VOLUME_DATA_INCOMPLETE"], DEGRADED), ("FEATURE_QUALITY_UNSUPPORTED 5", code, "v1", "DEGRADED", ["OTHER"], DEGRADED), ("FEATURE_QUALITY_UNSUPPORTED 6", code, "v1", "DEGRADED", None, DEGRADED),
        ("FEATURE_DEGRADED_VOLUME_SHAPE_INVALID", code, "v1", "DEGRADED", ["VOLUME_DATA_INCOMPLETE"], DEGRADED | {"volume_ratio_5_to_20": "x", "one_day_return": "x"}), ("FEATURE_NUMERIC_VALUE_INVALID", code, "v1", "READY", [], odd),
        ("FEATURE_NUMERIC_VALUE_INVALID 2", code, "v1", "DEGRADED", ["VOLUME_DATA_INCOMPLETE"], DEGRADED | {"last_close": None}), ("FEATURE_NUMERIC_VALUE_INVALID 3", code, "v1", "READY", [], GOOD | {"atr14_rate": "1.5\n"}), ("FEATURE_NUMERIC_VALUE_INVALID 4", code, "v1", "READY", [], GOOD | {"atr14_rate": "01"}),
    ]
    found = {r.id: r.p for r in spark.createDataFrame(rows, SNAPSHOT).withColumn("p", scoring.snapshot_problem()).collect()}
    assert found == {k: None if k.startswith("ok") else k.split()[0] for k in found} and len(found) == len(rows)


def test_of_two_faults_of_a_fill_the_first_is_named(spark):
    orders = [("o1", "i1", "LIVE", "FILLED", None), ("o2", "none", "INTERNAL_PAPER", "FILLED", None), ("o3", "none", "INTERNAL_PAPER", "ACCEPTED", None), ("o4", "i4", "INTERNAL_PAPER", "ACCEPTED", None), ("o5", "i5", "INTERNAL_PAPER", "PARTIALLY_FILLED", None), ("o6", "i6", "INTERNAL_PAPER", "ACCEPTED", None), ("o7", None, None, None, None)]
    intent = lambda k, symbol="A", price=None, side="BUY": (k, f"d{k}", symbol, "USD", side, "MARKET", price, "DAY", 1)
    intents = [intent("i1"), intent("i4", "B", 5.0), intent("i5", price=5.0), intent("i6")]
    made = chains.fill_sources(
        spark.createDataFrame(orders, "order_id string, intent_id string, broker_code string, status string, accepted_at timestamp"),
        spark.createDataFrame(intents, "intent_id string, decision_id string, symbol string, currency string, side string, order_type string, limit_price double, time_in_force string, requested_quantity long"),
        spark.createDataFrame([(f"di{k}", "c") for k in (1, 4, 5, 6)], "decision_id string, candidate_id string"), spark.createDataFrame([("c", "s")], "candidate_id string, snapshot_id string"), spark.createDataFrame([("s", "A")], "snapshot_id string, symbol string"))
    assert {r.order_id: r.problem for r in made.collect()} == {"o1": "unsupported_broker", "o2": "order_not_fillable", "o3": "trade_intent_missing", "o4": "symbol_mismatch", "o5": "accepted_request_shape_mismatch", "o6": "acceptance_missing", "o7": "unsupported_broker"}


def test_bars_have_to_be_those_that_were_asked_for(spark):
    bar = lambda run, symbol, source="S", day="2024-01-02", currency="USD": (run, symbol, source, currency, "SPLIT_ADJUSTED", datetime(2024, 1, 2), day)
    bars = [bar("r1", "OTHER"), bar("r1", "OTHER", day="2024-01-03"), bar("r2", "A", "T"), bar("r3", "A"), bar("r3", "A"), bar("r4", "A", currency=None), bar("r5", None), bar("unasked", "A")]
    asked = [(r, "A", "S") for r in ("r1", "r2", "r3", "r4", "r5", "r6")]
    made = chains.input_violations(
        spark.createDataFrame(bars, "run string, symbol string, source_code string, currency string, adjustment_basis string, available_at timestamp, session_date string"),
        spark.createDataFrame(asked, "run string, symbol string, source_code string"), F.lit(datetime(2024, 2, 1)))
    assert {r.run: r.problem for r in made.collect()} == {"r1": "MIXED_SYMBOLS", "r2": "MIXED_SOURCES", "r3": "DUPLICATE_SESSION", "r4": "CURRENCY_NOT_USD", "r5": "MIXED_SYMBOLS", "r6": None}


ITEMS = "run string, place int, outcome string"
STORED = "run string, total_count long, good long, content_digest string"


def broken(spark, stored, items):
    made = aggregate_violations(spark.createDataFrame(stored, STORED), spark.createDataFrame(items, ITEMS), "run", {"good": F.col("outcome") == "GOOD"}, ("outcome", "place"), ordinal="place")
    return {r.run: r.problem for r in made.collect()}


def test_aggregates_are_what_their_items_add_up_to(spark):
    items = [("a", 1, "GOOD"), ("a", 2, None)]
    of = lambda rows: datasets.content_digest(spark.createDataFrame(rows, ITEMS), ("outcome", "place"), "place", ("run",)).first().digest
    d = of(items)
    assert d == of(items[::-1]) != of([("a", 1, None), ("a", 2, "GOOD")])
    more = [("lost", 1, "GOOD"), ("twice", 1, "GOOD"), ("twice", 1, "GOOD"), ("from 2", 2, "GOOD"), ("from 2", 3, "GOOD"), ("off", 1, "BAD"), ("null", 1, "GOOD")]
    stored = [("a", 2, 1, d), ("twice", 2, 9, "x"), ("from 2", 2, 2, "x"), ("off", 1, 1, "x"), ("null", None, 1, "x"), ("none", 3, 0, "x"), ("empty", 0, 0, None)]
    assert broken(spark, stored, items + more) == {
        "a": None, "lost": "RUN_MISSING", "twice": "ORDINALS_NOT_1_TO_N", "from 2": "ORDINALS_NOT_1_TO_N", "off": "COUNT_MISMATCH:good", "null": "TOTAL_MISMATCH", "none": "ITEMS_MISSING", "empty": None}
    assert broken(spark, [("a", 2, 1, d)], [("a", 1, "GOOD"), ("a", 2, "BAD")]) == {"a": "DIGEST_MISMATCH"}
    assert broken(spark, [], []) == {}


def test_digests_do_not_depend_on_how_rows_lie(spark):
    rows = spark.range(1, 10_001).select(F.lit("a").alias("run"), F.col("id").cast("int").alias("place"), F.concat(F.lit("o"), "id").alias("outcome"))
    one, many = (datasets.content_digest(x, ("outcome", "place"), "place").first()[0] for x in (rows.coalesce(1), rows.orderBy(F.desc("outcome")).repartition(7)))
    assert one == many and datasets.content_digest(rows.limit(0), ("outcome", "place"), "place").first()[0]
