"""Queries over chains of records, listings, keys and rules of records, each with its SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import calendar as cal
from ..functions import canonical
from ..operators import chains, exact, filters, pit, scoring, trading
from ..sources import bars as sources
from . import tables
from .research import HORIZON, dataset_labels, dataset_rows, outcome_items, outcome_revisions, read, revisions, scored_items, ts
from .research_sql import _BARS, _CAL, _DATASET, _EARLY, _EVENTS, _FEATURES, _with
from .session import new_path, written
from .trading_queries import SNAPSHOT_SQL, decisions, evaluations, fills, orders, snapshots


def _day(c: str = "session_date"):
    return F.dayofmonth(c)


def _counts(df, *by: str, count: str = "rows"):
    return df.groupBy(*by, F.coalesce("problem", F.lit("NONE")).alias("problem")).agg(F.count(F.lit(1)).alias(count))


def _number(c: str = "symbol"):
    return F.substring(c, 2, 20).cast("int")


# --- chains of trades


def _trade_tables(spark, d):
    """Orders with what they came from, written once: intents, decisions, candidates and snapshots are read from them."""
    base = written(orders(spark, d).select("order_id", "intent_id", "candidate_id", "symbol", "session_date", "filter_set", "price", "quantity", "accepted_at"))
    intents = base.where(_day() != 9).select("intent_id", F.concat(F.lit("d"), "intent_id").alias("decision_id"), F.when(_day() == 13, "SELL").otherwise("BUY").alias("side"), "symbol", F.lit("USD").alias("currency"), "session_date")
    decided = base.where(_day() != 14).select(F.concat(F.lit("d"), "intent_id").alias("decision_id"), "candidate_id", F.lit("ENTER_LONG").alias("action"), F.col("filter_set").alias("strategy_id"))
    candidates = base.where(_day() != 15).select("candidate_id", F.concat(F.lit("s"), "candidate_id").alias("snapshot_id")).distinct()
    shots = base.where(_day() != 16).groupBy(F.concat(F.lit("s"), "candidate_id").alias("snapshot_id")).agg(F.min(F.when(_day() == 17, "OTHER").otherwise(F.col("symbol"))).alias("symbol"), F.min("price").alias("last_price"))
    return base, intents, decided, candidates, shots


def projection_sources(spark, d):
    """Fills whose chain back to the snapshot was broken on certain days, by what is wrong with it."""
    base, intents, decided, candidates, shots = _trade_tables(spark, d)
    made = trading.split_fills(base.select("order_id", "quantity", "price", "session_date", "accepted_at")).select(
        "order_id", "quantity", F.when(_day() == 10, F.col("price") + 1).otherwise(F.col("price")).alias("price"), F.lit(0.0).alias("fee"), F.lit("USD").alias("fee_currency"), (F.col("accepted_at") + F.expr("interval 1 minute")).alias("executed_at")
    )
    state = base.where(_day() != 8).select("order_id", "intent_id", F.lit("INTERNAL_PAPER").alias("broker_code"), F.when(_day() == 12, "ACCEPTED").otherwise("FILLED").alias("status"), "accepted_at")
    return _counts(chains.projection_sources(made, state, intents.drop("session_date"), decided, candidates, shots), count="fills")


def fill_sources(spark, d):
    """Orders that wait for their next fill, by what keeps them from it; many have two faults."""
    base = written(orders(spark, d).select("intent_id", "candidate_id", "symbol", "session_date", "quantity", "accepted_at").withColumns({"order_id": F.col("intent_id"), "d": _day(), "n": _number()}))
    day, n = F.col("d"), F.col("n")
    state = base.select(
        "order_id", "intent_id", F.when(n % 7 == 3, "LIVE").otherwise("INTERNAL_PAPER").alias("broker_code"), F.when(~day.isin(9, 19), F.col("accepted_at")).alias("accepted_at"),
        F.when(day == 18, "FILLED").when((day == 20) | (n % 10 == 9), "REJECTED").when(n % 5 == 0, "PARTIALLY_FILLED").otherwise("ACCEPTED").alias("status"),
    )
    intents = base.where(day != 9).select(
        "intent_id", F.concat(F.lit("d"), "intent_id").alias("decision_id"), "symbol", F.when(day == 22, "EUR").otherwise("USD").alias("currency"), F.when(day == 13, "SELL").otherwise("BUY").alias("side"), F.when(day == 23, "LIMIT").otherwise("MARKET").alias("order_type"),
        F.when(day == 24, 10.0).alias("limit_price"), F.when(day == 25, "GTC").otherwise("DAY").alias("time_in_force"), F.when(day == 26, 0).otherwise(F.col("quantity")).alias("requested_quantity"),
    )
    decided = base.where(day != 14).select(F.concat(F.lit("d"), "intent_id").alias("decision_id"), "candidate_id")
    candidates = base.where(day != 15).select("candidate_id", F.concat(F.lit("s"), "candidate_id").alias("snapshot_id")).distinct()
    shots = base.where(day != 16).select(F.concat(F.lit("s"), "candidate_id").alias("snapshot_id"), F.when((day == 17) | (day.isin(13, 22) & (n % 2 == 0)), "OTHER").otherwise(F.col("symbol")).alias("symbol")).distinct()
    return _counts(chains.fill_sources(state, intents, decided, candidates, shots), count="orders")


def exit_sources(spark, d):
    """Positions whose exit is asked for, by what is wrong with the chain back to their entry; many have two faults."""
    f = written(fills(spark, d).select("order_id", "intent_id", "symbol", "filter_set", "session_date", "fill_sequence", "quantity", "price", "executed_at", "execution_key"))
    run = written(trading.running_positions(f, ["filter_set", "symbol"], "session_date", "fill_sequence").withColumn("position_id", F.concat_ws("|", "filter_set", "symbol")))
    n = _number()
    last = written(run.groupBy("position_id", "filter_set", "symbol").agg(
        F.max("position_version").alias("version"), F.max_by("position_quantity", "position_version").alias("quantity"), F.max_by("average_cost", "position_version").alias("average_cost"), F.max_by("executed_at", "position_version").alias("updated_at")
    ))
    currency = F.when(n % 31 == 9, "EUR").otherwise("USD").alias("currency")
    positions = last.where(n % 31 != 11).select("position_id", F.col("filter_set").alias("strategy_id"), "symbol", currency, F.when(n % 13 == 0, "CLOSED").otherwise("OPEN").alias("status"), "quantity", "average_cost", F.lit(0.0).alias("realized_pnl"), "version", "updated_at", F.lit(None).cast("timestamp").alias("closed_at"))
    events = run.join(last.select("position_id", F.col("version").alias("position_version"), F.lit(True).alias("is_last")), ["position_id", "position_version"], "left").where(~((n % 7 == 0) & F.coalesce("is_last", F.lit(False)))).select(
        "position_id", F.col("position_version").alias("sequence_no"), F.col("execution_key").alias("fill_id"), F.lit("INCREASED").alias("event_type"), (F.col("position_quantity") + F.when(n % 11 == 0, 1).otherwise(0)).alias("quantity_after"), F.col("average_cost").alias("average_cost_after"),
        F.when(n % 31 == 6, 1.0).otherwise(0.0).alias("realized_pnl_after"), F.col("executed_at").alias("occurred_at"),
    )
    made = f.where(n % 31 != 1).select(F.col("execution_key").alias("fill_id"), "order_id", F.when(n % 31 == 7, F.col("executed_at") + F.expr("interval 1 minute")).otherwise(F.col("executed_at")).alias("executed_at"))
    ordered = f.where(n % 31 != 2).select("order_id", "intent_id").distinct()
    intents = f.where(n % 31 != 3).select("intent_id", F.concat(F.lit("d"), "intent_id").alias("decision_id"), "symbol", currency).distinct()
    decided = f.where(n % 31 != 4).select(F.concat(F.lit("d"), "intent_id").alias("decision_id"), F.col("filter_set").alias("strategy_id"), F.when(n % 31 == 5, "v9").otherwise("v1").alias("strategy_version"), F.when(n % 31 == 8, "OBSERVE").otherwise("ENTER_LONG").alias("action")).distinct()
    asked = last.select("position_id", F.when(n % 29 == 0, "lost").otherwise(F.col("position_id")).alias("snapshot_id"), (F.col("updated_at") + F.when(n % 23 == 0, F.expr("interval 2 hours")).otherwise(F.expr("interval 2 minutes"))).alias("asked_at"))
    seen = F.col("updated_at") + F.when(n % 19 == 0, F.expr("interval -1 hour")).when(n % 31 == 10, F.expr("interval 3 hours")).otherwise(F.expr("interval 1 minute"))
    shots = last.select(F.col("position_id").alias("snapshot_id"), F.when(n % 17 == 0, "OTHER").otherwise(F.col("symbol")).alias("symbol"), seen.alias("observed_at"))
    return _counts(chains.exit_sources(asked, positions, events, made, ordered, intents, decided, shots, strategies=dict.fromkeys(filters.FILTER_SETS, "v1")), count="positions")


def decision_sources(spark, d):
    """Candidates and strategies whose evaluation is missing, comes twice or has no score."""
    checked = written(filters.filter_checks(snapshots(spark, d)).select("candidate_id", "session_date", *(c.lower() for c in filters.CHECKS)))
    shots = checked.select("candidate_id", "session_date")
    e = filters.filter_evaluations(checked).select("candidate_id", "filter_set", F.lit("v1").alias("version"), F.when(_day() != 5, F.col("score")).alias("score"), "session_date")
    bent = e.where(~((_day() == 3) & (F.col("filter_set") == "STRICT"))).unionByName(e.where(_day() == 4))
    strategies = {f"{name}_V1": (name, "v1") for name in filters.FILTER_SETS} | {"STRICT_V2": ("STRICT", "v2")}
    return _counts(chains.decision_sources(shots, bent, strategies), "strategy_id", count="candidates")


# --- chains of the research records


def _scored_chain(spark, d):
    """Scored items and the records that they came from, as tables of their own; some outcomes were made for other ones."""
    items = written(scored_items(spark, d).select("scoring_item_id", "scoring_run_id", "symbol", "number", "source_session_date", "source_rank", "overall_score", "source_quality_status"))
    pid, sid = F.concat(F.lit("p"), "scoring_item_id"), F.concat(F.lit("s"), "scoring_item_id")
    own = items.select("scoring_item_id", "scoring_run_id", pid.alias("pipeline_item_id"), sid.alias("feature_snapshot_id"), "symbol", "number", "source_rank", (F.col("source_session_date").cast("timestamp") + F.expr("interval 30 hours")).alias("recorded_at"))
    runs = items.select("scoring_run_id", F.concat(F.lit("r"), "scoring_run_id").alias("pipeline_run_id"), (F.col("source_session_date").cast("timestamp") + F.expr("interval 29 hours")).alias("generated_at")).distinct()
    return items, own, runs


def outcome_sources(spark, d):
    """Outcomes that belong to their scored item and its run in all links, by session."""
    _, own, runs = _scored_chain(spark, d)
    bent = lambda n, c: F.when(F.col("number") % n == 0, F.concat(F.lit("x"), c)).otherwise(F.col(c)).alias(c)
    made = own.join(runs.drop("generated_at"), "scoring_run_id").select("scoring_item_id", "number", bent(7, "scoring_run_id"), bent(11, "pipeline_item_id"), bent(13, "feature_snapshot_id"), bent(17, "pipeline_run_id"))
    joined = chains.outcome_sources(made.drop("number"), own.drop("recorded_at"), runs)
    return joined.groupBy("scoring_run_id").agg(F.count(F.lit(1)).alias("outcomes"), F.sum("source_rank").alias("ranks"))


def lineage_records(spark, d):
    """Scored items with run, pipeline item, pipeline run and, where it is there, snapshot, known at a time, by session."""
    _, own, runs = _scored_chain(spark, d)
    members = own.where("number % 5 <> 0").select("pipeline_item_id", F.concat(F.lit("r"), "scoring_run_id").alias("pipeline_run_id"))
    whole = runs.select("pipeline_run_id", F.when(F.dayofmonth("generated_at") % 6 == 0, 5).otherwise(HORIZON).alias("horizon"))
    shots = own.where("number % 3 <> 0").select("feature_snapshot_id", F.lit("READY").alias("snapshot_quality"))
    made = chains.lineage_records(own, runs, members, whole, shots, ts("2024-01-20 05:30:00"), HORIZON)
    return made.groupBy("scoring_run_id").agg(F.count(F.lit(1)).alias("items"), F.count("snapshot_quality").alias("snapshots"))


def _own_values():
    """The values of a sound snapshot, made from the reference close and the quality of an item."""
    n = F.col("number")
    given = {c: F.lit("0.5") for c in scoring.SNAPSHOT_VALUES} | {c: F.when(F.col("quality") == "READY", "1.5") for c in scoring.VOLUME_FEATURES}
    close = F.when(n % 59 == 0, "0").otherwise(F.col("reference_close").cast("decimal(20,2)").cast("string"))
    given |= {"adjustment_basis": F.lit("SPLIT_ADJUSTED"), "completed_bar_count": F.when(n % 53 == 0, "20").otherwise("21"), "last_close": close}
    return F.create_map(*(x for c, v in given.items() for x in (F.lit(c), v)))


def outcome_chain(spark, d):
    """Scored items by the first link or equality of their chain that does not hold; many have two faults."""
    items = outcome_items(spark, d).select(F.col("item_id").alias("key"), "symbol", "session_date", "reference_close", "number", F.when(F.col("volume") >= 2, "READY").otherwise("DEGRADED").alias("quality"))
    items = written(items)
    n, run = F.col("number"), F.col("session_date").cast("string")
    bent = lambda prime, wrong, right: F.when(n % prime == 0, F.lit(wrong)).otherwise(right)
    scored = items.select(
        run.alias("scoring_run_id"), F.concat(F.lit("r"), F.when(n % 3 == 0, "B").otherwise("A"), run).alias("pipeline_run_id"), F.concat(F.lit("p"), "key").alias("pipeline_item_id"), F.concat(F.lit("s"), "key").alias("feature_snapshot_id"), "symbol", F.lit("XNYS").alias("mic_code"),
        F.concat(F.lit("SCORED_"), "quality").alias("scoring_outcome"), "session_date", bent(47, "OTHER", F.col("quality")).alias("source_quality_status"),
    )
    days = written(items.select("session_date").distinct())
    day = _day()
    runs = days.where(~day.isin(4, 5)).select(run.alias("scoring_run_id"), F.concat(F.lit("r"), F.when(day % 2 == 0, "A").otherwise("B"), run).alias("pipeline_run_id"))
    pipelines = days.select("session_date", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("feed")).where(~((day == 6) & (F.col("feed") == "B")))
    pipelines = pipelines.select(
        F.concat(F.lit("r"), "feed", run).alias("pipeline_run_id"), *(F.when((day == 7 + k) & (F.col("feed") == "A"), "OTHER").otherwise(v).alias(c) for k, (c, v) in enumerate(chains.OUTCOME_PIPELINE.items())), F.when(day == 15, 5).otherwise(HORIZON).alias("horizon"), run.alias("as_of"),
        F.when(day != 16, F.when(day == 17, F.date_sub("session_date", 1)).otherwise(F.col("session_date"))).alias("completed_session_date"),
    )
    members = items.where("number % 7 <> 0").select(
        F.concat(F.lit("p"), "key").alias("pipeline_item_id"), F.concat(F.lit("r"), F.when((n % 3 == 0) & (n % 5 != 0), "B").otherwise("A"), run).alias("pipeline_run_id"), bent(11, "DATA_INSUFFICIENT", F.col("quality")).alias("outcome"), bent(13, "OTHER", F.col("quality")).alias("feature_quality_status"),
        bent(17, "another", F.concat(F.lit("s"), "key")).alias("feature_snapshot_id"), bent(19, "OTHER", F.col("symbol")).alias("symbol"), bent(23, "XNGS", F.lit("XNYS")).alias("mic_code"), F.when(n % 29 != 0, F.col("session_date")).alias("completed_session_date"),
    )
    shots = items.where("number % 31 <> 0").select(
        F.concat(F.lit("s"), "key").alias("feature_snapshot_id"), bent(37, "OTHER", F.col("symbol")).alias("symbol"), F.when(n % 41 == 0, 1).otherwise(HORIZON).alias("horizon"), bent(43, "another", run).alias("as_of"), bent(61, "UNKNOWN", F.col("quality")).alias("quality_status"),
        F.when(F.col("quality") == "DEGRADED", F.array(F.lit("VOLUME_DATA_INCOMPLETE"))).otherwise(F.array().cast("array<string>")).alias("quality_reason_codes"), F.lit("US_EQUITY_DAILY_TECHNICAL").alias("feature_set_code"), bent(67, "v2", F.lit("v1")).alias("feature_set_version"), _own_values().alias("feature_values"),
    )
    made = chains.outcome_source_chain(scored, runs, pipelines, members, shots)
    return made.groupBy("session_date", F.coalesce("problem", F.lit("NONE")).alias("problem")).agg(F.count(F.lit(1)).alias("items"), F.round(F.sum("reference_close").cast("double"), 2).alias("reference"))


def source_violations(spark, d):
    """Rows that a dataset may not take, by the first reason."""
    items, *_ = _scored_chain(spark, d)
    n, day = F.col("number"), F.col("source_session_date").cast("timestamp")
    text = F.sha2(F.col("scoring_item_id").cast("binary"), 256)
    at = lambda hours: day + F.expr(f"interval {hours} hours")
    rows = items.select(
        "number", F.when(n % 29 == 0, 2).otherwise(3).alias("horizon"), "source_quality_status", F.when(n % 31 == 0, 101).otherwise(1).alias("source_rank"), F.when(n % 37 == 0, "XLON").otherwise("XNYS").alias("mic_code"), "source_session_date",
        F.when(n % 41 == 0, F.col("source_session_date")).otherwise(F.date_add("source_session_date", 3)).alias("terminal_session_date"), F.concat(F.lit("daily-feature-outcome:v1:"), F.when(n % 43 == 0, F.upper(text)).otherwise(text)).alias("outcome_key"), text.alias("content_digest"),
        F.when(n % 47 == 0, "").otherwise(text).alias("path_digest"), at(29).alias("scoring_generated_at"), F.when(n % 53 == 0, at(28)).otherwise(at(30)).alias("scoring_recorded_at"), at(90).alias("latest_input_available_at"), F.when(n % 59 == 0, at(80)).otherwise(at(91)).alias("recorded_at"),
        F.when(n % 23 == 0, "P0").otherwise("P1").alias("policy_code"),
    )
    return _counts(chains.source_violations(rows, ts("2024-01-28 00:00:00"), 3, {"policy_code": "P1"}))


def input_violations(spark, d):
    """Runs of bars that features may not be made of, by the first reason; some bars were changed, many runs have two faults."""
    b = sources.event_bars(read(spark, d, "events")).withColumn("number", _number()).withColumn("day", _day())
    n, day = F.col("number"), F.col("day")
    at = lambda prime, days, wrong, right: F.when((n % prime == 0) & day.isin(*days), wrong).otherwise(right)
    bent = b.select(
        F.col("symbol").alias("run"), F.when(n % 7 == 0, "OTHER").otherwise(F.col("symbol")).alias("symbol"), at(11, (10, 20), F.lit("SECOND"), F.col("source_code")).alias("source_code"), at(13, (11, 21), F.lit("EUR"), F.lit("USD")).alias("currency"),
        at(17, (12, 22), F.lit("RAW"), F.col("adjustment_basis")).alias("adjustment_basis"), at(5, (3, 8), F.col("available_at") + F.expr("interval 60 days"), F.col("available_at")).alias("available_at"), "session_date", "day",
    )
    bent = bent.unionByName(bent.where("day = 13 and run like '%4'")).where("not (run like '%8' and day > 15)")
    asked = b.select(F.col("symbol").alias("run"), "symbol", F.lit("EVENTS").alias("source_code")).distinct().unionByName(spark.createDataFrame([("EMPTY", "EMPTY", "EVENTS")], "run string, symbol string, source_code string"))
    return _counts(chains.input_violations(bent, asked, ts("2024-02-10 00:00:00")), count="runs")


def retry_requests(spark, d):
    """Requests of runs: those whose key is stored are answered from the store, the others are left to work on."""
    o = read(spark, d, "orders").select(F.concat(F.lit("k"), F.col("o_orderkey") % 3000).alias("run_key"), "o_orderkey")
    stored = o.where("o_orderkey % 3 = 0").groupBy("run_key").agg(F.min("o_orderkey").alias("run_id"))
    todo, done = chains.answered(o.select("run_key"), stored, "run_key")
    return todo.agg(F.lit("TO_DO").alias("part"), F.count(F.lit(1)).alias("rows")).unionByName(done.agg(F.lit("ANSWERED").alias("part"), F.count(F.lit(1)).alias("rows")))


# --- listings


def lineage_listing(spark, d):
    """Items over all runs, in the order of sessions, runs and their ordinals in the run."""
    rows = scored_items(spark, d).select("scoring_item_id", "scoring_run_id", "source_session_date", F.col("source_rank").alias("ordinal"))
    return pit.numbered(rows, "lineage", []).select("scoring_item_id", "ordinal")


def candidate_listing(spark, d):
    rows = snapshots(spark, d).select("candidate_id", F.date_format("session_date", "yyyy-MM").alias("run_id"), (F.col("session_date").cast("timestamp") + F.make_dt_interval(hours=F.length("symbol"))).alias("selected_at"))
    return pit.numbered(rows, "candidates", ["run_id"]).select("run_id", "candidate_id", "ordinal")


def evaluation_listing(spark, d):
    rows = evaluations(spark, d).select("symbol", "candidate_id", F.concat_ws("|", "candidate_id", "filter_set").alias("evaluation_id"), F.when(F.col("filter_set") == "STRICT", ts("2024-01-02 00:00:00")).otherwise(ts("2024-01-01 00:00:00")).alias("evaluated_at"))
    return pit.numbered(rows, "evaluations", ["symbol", "candidate_id"], small=True).select("evaluation_id", "ordinal")


def decision_listing(spark, d):
    """A candidate's decisions; those that belong to a position are not among them."""
    rows = decisions(spark, d).select(
        "symbol", "candidate_id", F.concat_ws("|", "candidate_id", "filter_set").alias("decision_id"), F.col("filter_set").alias("strategy_id"), F.when(F.col("action") == "SKIP", ts("2024-01-01 00:00:00")).otherwise(ts("2024-01-02 00:00:00")).alias("decided_at"),
        F.when((_day() % 5 == 0) & (F.col("filter_set") == "OBSERVATION"), F.col("symbol")).alias("position_id"),
    )
    return pit.numbered(rows.where("position_id is null"), "decisions", ["symbol", "candidate_id"], small=True).select("decision_id", "ordinal")


def fill_listing(spark, d):
    rows = fills(spark, d).select("order_id", "fill_sequence", F.col("execution_key").alias("fill_id"))
    return pit.numbered(rows, "fills", ["order_id"]).select("fill_id", "ordinal")


def recommendation_listing(spark, d):
    rows = read(spark, d, "part").select(F.col("p_brand").alias("feature_snapshot_id"), F.col("p_partkey").alias("recommendation_id"), (ts("2024-01-01 00:00:00") + F.make_dt_interval(days=F.col("p_size"))).alias("generated_at"))
    return pit.numbered(rows, "recommendations", ["feature_snapshot_id"]).select("recommendation_id", "ordinal")


def outcome_listing(spark, d):
    return pit.numbered(outcome_revisions(spark, d), "outcomes", ["scoring_item_id"]).select("outcome_key", "ordinal")


def label_listing(spark, d):
    rows = dataset_labels(spark, d).select("scoring_item_id", F.concat(F.lit("l"), "outcome_id").alias("label_key"), F.when(F.substring_index("outcome_id", "|", -1) == "2", ts("2024-02-01 00:00:00")).otherwise(ts("2024-02-02 00:00:00")).alias("generated_at"))
    return pit.numbered(rows, "labels", ["scoring_item_id"]).select("label_key", "ordinal")


def item_listing(spark, d):
    """The items of runs by their ordinals, with the place of each."""
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate").alias("k"))
    w = Window.partitionBy("run_id").orderBy("k")
    rows = rows.withColumn("ordinal", 10 * F.row_number().over(w)).select("run_id", "ordinal", F.col("k.l_partkey").alias("item"))
    placed = pit.numbered(rows.withColumnRenamed("ordinal", "stored").withColumn("ordinal", F.col("stored")), "items", ["run_id"])
    return placed.select("run_id", "item", F.col("stored").alias("stored_ordinal"), F.col("ordinal").cast("int").alias("place"))


# --- keys and texts


def record_keys(spark, d):
    """The keys of records of every kind, over the same identity."""
    rows = read(spark, d, "nation")
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), canonical.record_key(k, code=F.col("n_name"), number=F.col("n_nationkey")).alias("key")) for k in canonical.RECORD_KINDS))).alias("x")
    return rows.select("n_nationkey", kinds).select("n_nationkey", "x.*")


def readable_keys(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("k"), F.col("o_custkey").cast("string").alias("c"))
    client = canonical.client_order_id(F.col("k"), "tidemark")
    return o.select(
        "k", canonical.intent_key(F.col("k")).alias("intent_key"), canonical.position_decision_key(F.col("k"), F.col("c"), F.lit("EXIT"), F.lit("v1")).alias("position_key"), client.alias("client_order_id"), canonical.broker_reference(client).alias("broker_reference"),
    )


def decimal_texts(spark, d):
    """The four forms of a decimal as text: plain, with 18 and with 6 places, and as the exact lane writes it."""
    p = read(spark, d, "part").select("p_partkey", (F.col("p_retailprice").cast("decimal(20,2)") / 8).cast("decimal(30,10)").alias("x"))
    return p.select("p_partkey", canonical.plain_decimal(F.col("x")).alias("plain"), canonical.fixed_decimal(F.col("x"), 18).alias("places18"), canonical.fixed_decimal(F.col("x"), 6).alias("places6"), canonical.plain_decimal(F.col("x") - F.col("x")).alias("zero"))


def normal_codes(spark, d):
    """Symbols and currencies brought to their form, null where they have none, and codes sorted without repeats."""
    s = read(spark, d, "supplier")
    name = F.concat(F.lit(" s"), F.col("s_suppkey") % 50, F.when(F.col("s_suppkey") % 3 == 0, "!").when(F.col("s_suppkey") % 3 == 1, ".b ").otherwise(""))
    money = F.element_at(F.array(*map(F.lit, ("usd", " EUR ", "us", "Us1"))), (F.col("s_nationkey") % 4 + 1).cast("int"))
    codes = F.array(F.concat(F.lit(" c"), F.col("s_nationkey").cast("string")), F.lit("B "), F.lit("b"), F.lit("a1"))
    return s.select("s_suppkey", canonical.normal_symbol(name).alias("symbol"), canonical.normal_currency(money).alias("currency"), F.array_join(canonical.canonical_codes(codes), ",").alias("codes"))


def redacted_texts(spark, d):
    """Maps and nested JSON with the values of telling keys masked, and the columns that would leak the future."""
    c = read(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    made = canonical.redacted(F.create_map(F.lit("API-Token"), F.col("c_name"), F.lit("name"), F.col("c_name"), F.lit("My Account"), F.lit("x")))
    nested = F.to_json(F.struct(F.struct(F.col("c_name").alias("app secret"), F.array(F.struct(F.lit("y").alias("Chat-Id"), "c_mktsegment")).alias("list")).alias("outer")))
    return c.select("c_custkey", F.to_json(made).alias("flat"), canonical.redacted_json(nested).alias("nested"))


def leaking_names(spark, d):
    """Names of columns, made of parts, that would leak the future into features, and how often each comes."""
    k = F.col("p_partkey") % 7
    name = F.when(k == 0, "Label").when(k == 1, "future_return").when(k == 2, "TARGET").when(k == 3, "Virtual_Result").when(k == 4, "close_price").otherwise(F.lower("p_brand"))
    names = read(spark, d, "part").select(name.alias("name"))
    return names.where(canonical.is_leaking(F.col("name"))).groupBy("name").agg(F.count(F.lit(1)).alias("columns"))


def exact_snapshots(spark, d):
    """Exact snapshots of every symbol with 21 known sessions: their keys, their quality, and what the exact values come to."""
    b = pit.latest_sessions(revisions(spark, d), ts("2001-06-15 12:00:00"), 21)
    price = lambda c: F.col(c).cast("decimal(38,18)").alias(c)
    b = b.select(
        "source_code", F.concat_ws("|", "symbol", F.col("session_date").cast("string")).alias("source_record_key"), F.substring_index("bar_key", "|", -1).alias("source_version"), "symbol", F.lit("USD").alias("currency"), "adjustment_basis", "session_date",
        F.col("available_at").alias("observed_at"), "available_at", *map(price, ("open_price", "high_price", "low_price", "close_price")), "volume",
    )
    made = exact.feature_snapshots(sources.content_digest(b), datetime(2001, 6, 15, 12), HORIZON)
    number = lambda c: F.round(F.get_json_object("feature_values", f"$.{c}").cast("double"), 6).alias(c)
    return made.select("symbol", "snapshot_key", "quality_status", F.length("content_digest").alias("digest_chars"), *map(number, ("one_day_return", "realized_volatility_20d", "atr14_rate", "volume_ratio_5_to_20")))


# --- calendar, stores and rules


def calendar_guard(spark, d):
    """Years whose sessions are not as many as they have to be, in a calendar that lost the event days 5, 10, 15, 20, 25 and 30."""
    lost = read(spark, d, "events").select(F.to_date("ts").alias("session_date")).distinct().where(_day() % 5 == 0)
    sessions = cal.sessions_between(spark, *cal.resolve("US_EQUITY_CORE", "2018-2026.v1"))
    return cal.count_violations(sessions.join(lost, "session_date", "left_anti"))


def sessions_between(spark, d):
    """The sessions from the first event to the last one."""
    first, last = read(spark, d, "events").agg(F.to_date(F.min("ts")), F.to_date(F.max("ts"))).first()
    made = cal.sessions_between(spark, first, last)
    return made.where("family = 'NASDAQ_CORE'").select("session_date", "kind", (F.unix_timestamp("close_at") - F.unix_timestamp("open_at")).alias("seconds"), F.hour("open_at").alias("open_hour"))


def calendar_versions(spark, d):
    """Which calendars that nations ask for are known; no other stands in for one that is not."""
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    asked = read(spark, d, "nation").select("n_nationkey", F.when(k % 3 == 0, "UK_EQUITY_CORE").otherwise("US_EQUITY_CORE").alias("code"), F.when(r % 3 == 0, "2026.v1").when(r % 3 == 1, "2018-2026.v1").otherwise("2027.v1").alias("version"))
    return cal.coverage(asked)


def stored_lookup(spark, d):
    """Bars that were appended to a store in two runs, read again by key."""
    b = written(sources.event_bars(read(spark, d, "events")))
    path = new_path(spark, "bars")
    sources.append(b.where(_day() <= 15), path)
    fresh, _ = sources.ingest(b, spark.read.parquet(path), ["bar_key"])
    sources.append(fresh.select(*b.columns), path)
    return sources.lookup(spark, path, source_code="EVENTS", symbol="U7").select("bar_key", "session_date", "close_price")


def changed_records(spark, d):
    """Stored bars whose key is not that of their content: those that were tampered with."""
    rows = revisions(spark, d)
    key = lambda version: sources.bar_key(F.col("source_code"), F.concat_ws("|", "symbol", F.col("session_date").cast("string")), version)
    stored = rows.select("source_code", "symbol", "session_date", "bar_key", key(F.substring_index("bar_key", "|", -1)).alias("stored_key"))
    read_again = stored.withColumn("now", key(F.when(_day() == 7, "9").otherwise(F.substring_index("bar_key", "|", -1))))
    return tables.changed_since_written(read_again, "now", "stored_key").groupBy("session_date").agg(F.count(F.lit(1)).alias("rows"))


def record_violations(spark, d):
    """Positions and events that break the rules of their tables, by rule."""
    o = read(spark, d, "orders")
    k = F.col("o_orderkey")
    price = lambda c: F.lit(c).cast("decimal(38,18)")
    positions = o.select(
        k.cast("string").alias("position_id"), F.lit("S").alias("strategy_id"), F.lit("A").alias("symbol"), F.lit("USD").alias("currency"), F.when(k % 7 == 0, "CLOSED").otherwise("OPEN").alias("status"), F.lit(1).cast("long").alias("quantity"),
        price(1).alias("average_cost_price"), F.when(k % 11 == 0, price(1)).otherwise(price(0)).alias("realized_pnl"), F.lit(1).alias("version"), F.lit(None).cast("timestamp").alias("opened_at"), F.lit(None).cast("timestamp").alias("closed_at"),
    )
    events = o.select(k.cast("string").alias("event_id"), F.lit("P").alias("position_id"), (k - k % 2).cast("string").alias("fill_id"), k.cast("int").alias("sequence_no"), F.when(k % 13 == 0, 0).otherwise(1).cast("long").alias("quantity_delta"), price(1).alias("price"), F.lit(None).cast("timestamp").alias("occurred_at"))
    named = lambda df, name: tables.violations(df, name).select(F.lit(name).alias("table_name"), "rule", "rows")
    return named(positions, "paper_positions").unionByName(named(events, "position_events"))


QUERIES: dict = {
    f.__name__: f
    for f in (
        projection_sources, fill_sources, exit_sources, decision_sources, outcome_sources, lineage_records, outcome_chain, source_violations, input_violations, retry_requests, lineage_listing, candidate_listing,
        evaluation_listing, decision_listing, fill_listing, recommendation_listing, outcome_listing, label_listing, item_listing, record_keys, readable_keys, decimal_texts, normal_codes, redacted_texts, leaking_names,
        calendar_guard, sessions_between, calendar_versions, stored_lookup, changed_records, record_violations, exact_snapshots,
    )
}

_KINDS = ", ".join(f"('{k}')" for k in canonical.RECORD_KINDS)

ORACLE_SQL: dict[str, str] = {
    "projection_sources": _with(SNAPSHOT_SQL, """
SELECT CASE day(session_date) WHEN 8 THEN 'paper_order_missing' WHEN 9 THEN 'trade_intent_missing' WHEN 14 THEN 'strategy_decision_missing' WHEN 15 THEN 'candidate_missing' WHEN 16 THEN 'market_snapshot_missing' WHEN 13 THEN 'unsupported_side'
  WHEN 12 THEN 'order_state_mismatch' WHEN 10 THEN 'source_value_mismatch' WHEN 17 THEN 'source_value_mismatch' ELSE 'NONE' END AS problem, count(*) AS fills FROM fills GROUP BY 1"""),
    "fill_sources": _with(SNAPSHOT_SQL, """
, o AS (SELECT intent_id, candidate_id, symbol, quantity, day(session_date) AS d, CAST(substr(symbol, 2) AS INTEGER) AS n FROM intents WHERE quantity >= 1),
state AS (SELECT intent_id, n % 7 = 3 AS live, d NOT IN (9, 19) AS accepted, CASE WHEN d = 18 THEN 'FILLED' WHEN d = 20 OR n % 10 = 9 THEN 'REJECTED' WHEN n % 5 = 0 THEN 'PARTIALLY_FILLED' ELSE 'ACCEPTED' END AS status FROM o),
ti AS (SELECT intent_id, 'd' || intent_id AS decision_id, symbol, CASE d WHEN 22 THEN 'EUR' ELSE 'USD' END AS currency, CASE d WHEN 13 THEN 'SELL' ELSE 'BUY' END AS side, CASE d WHEN 23 THEN 'LIMIT' ELSE 'MARKET' END AS kind, CASE d WHEN 24 THEN 10 END AS limit_price,
  CASE d WHEN 25 THEN 'GTC' ELSE 'DAY' END AS tif, CASE d WHEN 26 THEN 0 ELSE quantity END AS requested FROM o WHERE d <> 9),
td AS (SELECT 'd' || intent_id AS decision_id, candidate_id FROM o WHERE d <> 14), tc AS (SELECT DISTINCT candidate_id, 's' || candidate_id AS snapshot_id FROM o WHERE d <> 15),
tm AS (SELECT DISTINCT 's' || candidate_id AS snapshot_id, CASE WHEN d = 17 OR d IN (13, 22) AND n % 2 = 0 THEN 'OTHER' ELSE symbol END AS symbol FROM o WHERE d <> 16)
SELECT CASE WHEN live THEN 'unsupported_broker' WHEN status NOT IN ('ACCEPTED', 'PARTIALLY_FILLED') THEN 'order_not_fillable' WHEN ti.intent_id IS NULL THEN 'trade_intent_missing' WHEN td.decision_id IS NULL THEN 'strategy_decision_missing' WHEN tc.candidate_id IS NULL THEN 'candidate_missing'
  WHEN tm.snapshot_id IS NULL THEN 'market_snapshot_missing' WHEN ti.symbol <> tm.symbol THEN 'symbol_mismatch' WHEN currency <> 'USD' OR side <> 'BUY' OR kind <> 'MARKET' OR limit_price IS NOT NULL OR tif <> 'DAY' OR requested <= 0 THEN 'accepted_request_shape_mismatch'
  WHEN NOT accepted THEN 'acceptance_missing' ELSE 'NONE' END AS problem, count(*) AS orders
FROM state LEFT JOIN ti USING (intent_id) LEFT JOIN td USING (decision_id) LEFT JOIN tc ON tc.candidate_id = td.candidate_id LEFT JOIN tm ON tm.snapshot_id = tc.snapshot_id GROUP BY 1"""),
    "exit_sources": _with(SNAPSHOT_SQL, """
, f AS (SELECT *, CAST(substr(symbol, 2) AS INTEGER) AS n, filter_set || '|' || symbol AS pid, row_number() OVER (PARTITION BY filter_set, symbol ORDER BY session_date, fill_sequence) AS version, sum(quantity) OVER (PARTITION BY filter_set, symbol ORDER BY session_date, fill_sequence) AS held FROM fills),
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY pid ORDER BY version DESC) = 1),
p AS (SELECT pid, symbol, filter_set, n, version, held, CASE WHEN n % 31 = 9 THEN 'EUR' ELSE 'USD' END AS currency, n % 13 <> 0 AS opened FROM l WHERE n % 31 <> 11),
e AS (SELECT pid, version, order_id || '|' || fill_sequence AS fill_id, held + CASE WHEN n % 11 = 0 THEN 1 ELSE 0 END AS held, CASE WHEN n % 31 = 6 THEN 1 ELSE 0 END AS pnl FROM f WHERE NOT (n % 7 = 0 AND (pid, version) IN (SELECT pid, version FROM l))),
pf AS (SELECT order_id || '|' || fill_sequence AS fill_id, order_id, n % 31 = 7 AS moved FROM f WHERE n % 31 <> 1), po AS (SELECT DISTINCT order_id, order_id AS intent_id FROM f WHERE n % 31 <> 2),
ti AS (SELECT DISTINCT order_id AS intent_id, 'd' || order_id AS decision_id, symbol, CASE WHEN n % 31 = 9 THEN 'EUR' ELSE 'USD' END AS currency FROM f WHERE n % 31 <> 3),
sd AS (SELECT DISTINCT 'd' || order_id AS decision_id, filter_set, CASE WHEN n % 31 = 5 THEN 'v9' ELSE 'v1' END AS version, CASE WHEN n % 31 = 8 THEN 'OBSERVE' ELSE 'ENTER_LONG' END AS action FROM f WHERE n % 31 <> 4),
ask AS (SELECT pid, CASE WHEN n % 29 = 0 THEN 'lost' ELSE pid END AS sid, CASE WHEN n % 23 = 0 THEN 120 ELSE 2 END AS asked FROM l),
ms AS (SELECT pid AS sid, CASE WHEN n % 17 = 0 THEN 'OTHER' ELSE symbol END AS symbol, CASE WHEN n % 19 = 0 THEN -60 WHEN n % 31 = 10 THEN 180 ELSE 1 END AS seen FROM l)
SELECT CASE WHEN p.pid IS NULL THEN 'position_missing' WHEN ms.sid IS NULL THEN 'snapshot_missing' WHEN e.pid IS NULL THEN 'position_event_missing' WHEN pf.fill_id IS NULL THEN 'paper_fill_missing' WHEN po.order_id IS NULL THEN 'paper_order_missing' WHEN ti.intent_id IS NULL THEN 'trade_intent_missing'
  WHEN sd.decision_id IS NULL THEN 'entry_decision_missing' WHEN sd.version <> 'v1' THEN 'unsupported_strategy_version' WHEN NOT opened THEN 'position_not_open' WHEN e.held <> p.held OR pnl <> 0 THEN 'position_event_mismatch' WHEN moved THEN 'source_identity_mismatch'
  WHEN action <> 'ENTER_LONG' OR sd.filter_set <> p.filter_set OR ti.symbol <> p.symbol OR ti.currency <> p.currency THEN 'strategy_source_mismatch' WHEN p.currency <> 'USD' THEN 'unsupported_currency' WHEN ms.symbol <> p.symbol THEN 'symbol_mismatch'
  WHEN seen < 0 THEN 'snapshot_precedes_position' WHEN seen > asked + 0.5 THEN 'snapshot_too_far_in_future' WHEN asked - seen > 5 THEN 'snapshot_stale' ELSE 'NONE' END AS problem, count(*) AS positions
FROM ask LEFT JOIN p ON p.pid = ask.pid LEFT JOIN ms ON ms.sid = ask.sid LEFT JOIN e ON e.pid = p.pid AND e.version = p.version LEFT JOIN pf ON pf.fill_id = e.fill_id LEFT JOIN po ON po.order_id = pf.order_id LEFT JOIN ti ON ti.intent_id = po.intent_id LEFT JOIN sd ON sd.decision_id = ti.decision_id GROUP BY 1"""),
    "decision_sources": _with(SNAPSHOT_SQL, """
SELECT strategy_id, CASE WHEN strategy_id = 'STRICT_V2' OR (strategy_id = 'STRICT_V1' AND day(session_date) = 3) THEN 'evaluation_missing' WHEN day(session_date) = 4 THEN 'duplicate_source' WHEN day(session_date) = 5 THEN 'invalid_score' ELSE 'NONE' END AS problem,
  count(*) AS candidates FROM snapshots, (VALUES ('STRICT_V1'), ('BALANCED_V1'), ('SCORE_ONLY_V1'), ('OBSERVATION_V1'), ('STRICT_V2')) s(strategy_id) GROUP BY ALL"""),
    "outcome_sources": _with(_DATASET, """
SELECT CAST(source_session_date AS VARCHAR) AS scoring_run_id, count(*) AS outcomes, CAST(sum(source_rank) AS BIGINT) AS ranks FROM sitems WHERE number % 7 <> 0 AND number % 11 <> 0 AND number % 13 <> 0 AND number % 17 <> 0 GROUP BY 1"""),
    "lineage_records": _with(_DATASET, """
SELECT CAST(source_session_date AS VARCHAR) AS scoring_run_id, count(*) AS items, count(*) FILTER (number % 3 <> 0) AS snapshots FROM sitems
WHERE number % 5 <> 0 AND day(source_session_date + INTERVAL 29 HOUR) % 6 <> 0 AND source_session_date + INTERVAL 30 HOUR <= TIMESTAMP '2024-01-20 05:30:00' GROUP BY 1"""),
    "outcome_chain": _with(_DATASET, """
, it AS (SELECT item_id AS key, symbol, session_date, CAST(session_date AS VARCHAR) AS run, reference_close, number AS n, CASE WHEN v >= 2 THEN 'READY' ELSE 'DEGRADED' END AS quality FROM items),
si AS (SELECT *, 'r' || CASE WHEN n % 3 = 0 THEN 'B' ELSE 'A' END || run AS prun, CASE WHEN n % 47 = 0 THEN 'OTHER' ELSE quality END AS sq FROM it), ds AS (SELECT DISTINCT session_date, CAST(session_date AS VARCHAR) AS run, day(session_date) AS d FROM it),
sr AS (SELECT run, 'r' || CASE WHEN d % 2 = 0 THEN 'A' ELSE 'B' END || run AS prun FROM ds WHERE d NOT IN (4, 5)),
pr AS (SELECT 'r' || feed || run AS prun, feed = 'A' AND d BETWEEN 7 AND 14 AS odd, CASE WHEN d = 15 THEN 5 ELSE 3 END AS horizon, run AS asof, CASE d WHEN 16 THEN NULL WHEN 17 THEN session_date - 1 ELSE session_date END AS done FROM ds, (VALUES ('A'), ('B')) x(feed) WHERE NOT (d = 6 AND feed = 'B')),
pi AS (SELECT key, 'r' || CASE WHEN n % 3 = 0 AND n % 5 <> 0 THEN 'B' ELSE 'A' END || run AS prun, CASE WHEN n % 11 = 0 THEN 'DATA_INSUFFICIENT' ELSE quality END AS outcome, CASE WHEN n % 13 = 0 THEN 'OTHER' ELSE quality END AS q, n % 17 = 0 AS other_shot, CASE WHEN n % 19 = 0 THEN 'OTHER' ELSE symbol END AS symbol,
  n % 23 = 0 AS other_mic, CASE WHEN n % 29 <> 0 THEN session_date END AS done FROM it WHERE n % 7 <> 0),
fs AS (SELECT key, CASE WHEN n % 37 = 0 THEN 'OTHER' ELSE symbol END AS symbol, CASE WHEN n % 41 = 0 THEN 1 ELSE 3 END AS horizon, CASE WHEN n % 43 = 0 THEN 'another' ELSE run END AS asof, CASE WHEN n % 61 = 0 THEN 'UNKNOWN' ELSE quality END AS q, CASE WHEN n % 67 = 0 THEN 'v2' ELSE 'v1' END AS version,
  n % 53 = 0 AS short, CASE WHEN n % 59 = 0 THEN 0 ELSE reference_close END AS close FROM it WHERE n % 31 <> 0),
judged AS (
  SELECT si.session_date, fs.close, CASE WHEN pr.prun IS NULL THEN 'pipeline_run_missing' WHEN fs.key IS NULL THEN 'feature_snapshot_missing' WHEN sr.run IS NULL THEN 'scoring_run_missing' WHEN pi.key IS NULL THEN 'pipeline_item_missing' WHEN odd THEN 'pipeline_identity_mismatch' WHEN pr.done IS NULL THEN 'completed_session_missing'
    WHEN sr.prun <> pr.prun THEN 'run_link_mismatch' WHEN pi.prun <> pr.prun THEN 'pipeline_item_of_another_run' WHEN pi.outcome <> quality THEN 'item_outcome_mismatch' WHEN pi.q <> quality THEN 'item_quality_mismatch' WHEN other_shot THEN 'item_snapshot_mismatch' WHEN pi.symbol <> si.symbol THEN 'item_symbol_mismatch'
    WHEN other_mic THEN 'item_mic_mismatch' WHEN pi.q <> sq THEN 'source_quality_mismatch' WHEN pi.done IS NULL THEN 'item_session_missing' WHEN fs.version <> 'v1' THEN 'feature_set_mismatch' WHEN fs.horizon <> pr.horizon THEN 'horizon_mismatch' WHEN fs.asof <> pr.asof THEN 'as_of_mismatch'
    WHEN fs.symbol <> si.symbol THEN 'snapshot_symbol_mismatch' WHEN fs.q <> sq THEN 'snapshot_quality_mismatch' WHEN pi.done <> pr.done THEN 'completed_session_mismatch' WHEN short THEN 'snapshot_contract_invalid' WHEN close <= 0 THEN 'reference_close_invalid' ELSE 'NONE' END AS problem
  FROM si LEFT JOIN pr ON pr.prun = si.prun LEFT JOIN fs ON fs.key = si.key LEFT JOIN sr ON sr.run = si.run LEFT JOIN pi ON pi.key = si.key
)
SELECT session_date, problem, count(*) AS items, round(sum(CASE WHEN problem = 'NONE' THEN CAST(close AS DECIMAL(20, 2)) END)::DOUBLE, 2) AS reference FROM judged GROUP BY ALL"""),
    "source_violations": _with(_DATASET, """
SELECT CASE WHEN number % 23 = 0 THEN 'POLICY_MISMATCH' WHEN number % 29 = 0 THEN 'HORIZON_MISMATCH' WHEN quality <> 'READY' THEN 'QUALITY_NOT_READY' WHEN number % 31 = 0 THEN 'RANK_OUT_OF_RANGE' WHEN number % 37 = 0 THEN 'UNSUPPORTED_MIC'
  WHEN number % 41 = 0 THEN 'SESSIONS_OUT_OF_ORDER' WHEN number % 43 = 0 THEN 'KEY_MALFORMED' WHEN number % 47 = 0 THEN 'DIGEST_MALFORMED' WHEN number % 53 = 0 THEN 'GENERATED_AFTER_RECORDED' WHEN number % 59 = 0 THEN 'AVAILABLE_AFTER_RECORDED'
  WHEN source_session_date + INTERVAL 91 HOUR > TIMESTAMP '2024-01-28' THEN 'AFTER_CUTOFF' ELSE 'NONE' END AS problem, count(*) AS rows FROM sitems GROUP BY 1"""),
    "input_violations": _with(_EVENTS, """
, b AS (SELECT symbol AS run, number AS n, day(session_date) AS d, session_date FROM ebars),
bent AS (
  SELECT run, CASE WHEN n % 7 = 0 THEN 'OTHER' ELSE run END AS symbol, CASE WHEN n % 11 = 0 AND d IN (10, 20) THEN 'SECOND' ELSE 'EVENTS' END AS source, CASE WHEN n % 13 = 0 AND d IN (11, 21) THEN 'EUR' ELSE 'USD' END AS currency, CASE WHEN n % 17 = 0 AND d IN (12, 22) THEN 'RAW' ELSE 'SPLIT_ADJUSTED' END AS basis,
    session_date + INTERVAL 23 HOUR + CASE WHEN n % 5 = 0 AND d IN (3, 8) THEN INTERVAL 60 DAY ELSE INTERVAL 0 DAY END AS known_at, session_date, d FROM b
),
given AS (SELECT * FROM (SELECT * FROM bent UNION ALL SELECT * FROM bent WHERE d = 13 AND run LIKE '%4') WHERE NOT (run LIKE '%8' AND d > 15)),
asked AS (SELECT DISTINCT run FROM b UNION ALL SELECT 'EMPTY'),
r AS (SELECT a.run, bool_or(g.symbol <> a.run) AS f1, bool_or(source <> 'EVENTS') AS f2, bool_or(currency <> 'USD') AS f3, bool_or(basis <> 'SPLIT_ADJUSTED') AS f4, bool_or(known_at > TIMESTAMP '2024-02-10') AS f5, count(session_date) > count(DISTINCT session_date) AS f6 FROM asked a LEFT JOIN given g ON g.run = a.run GROUP BY a.run)
SELECT CASE WHEN f1 THEN 'MIXED_SYMBOLS' WHEN f2 THEN 'MIXED_SOURCES' WHEN f3 THEN 'CURRENCY_NOT_USD' WHEN f4 THEN 'BASIS_NOT_SPLIT_ADJUSTED' WHEN f5 THEN 'BAR_NOT_KNOWN' WHEN f6 THEN 'DUPLICATE_SESSION' ELSE 'NONE' END AS problem, count(*) AS runs FROM r GROUP BY 1"""),
    "retry_requests": """
WITH o AS (SELECT 'k' || (o_orderkey % 3000) AS k, o_orderkey FROM orders), s AS (SELECT DISTINCT k FROM o WHERE o_orderkey % 3 = 0)
SELECT 'TO_DO' AS part, count(*) AS rows FROM o WHERE k NOT IN (SELECT k FROM s) UNION ALL SELECT 'ANSWERED', count(*) FROM s""",
    "lineage_listing": _with(_DATASET, """
SELECT scoring_item_id, CAST(row_number() OVER (ORDER BY source_session_date, source_rank, scoring_item_id) AS INTEGER) AS ordinal FROM sitems"""),
    "candidate_listing": _with(SNAPSHOT_SQL, """
SELECT strftime(session_date, '%Y-%m') AS run_id, candidate_id, CAST(row_number() OVER (PARTITION BY strftime(session_date, '%Y-%m') ORDER BY session_date + to_hours(length(symbol)), candidate_id) AS INTEGER) AS ordinal FROM snapshots"""),
    "evaluation_listing": _with(SNAPSHOT_SQL, """
SELECT candidate_id || '|' || filter_set AS evaluation_id, CAST(row_number() OVER (PARTITION BY candidate_id ORDER BY filter_set = 'STRICT', filter_set) AS INTEGER) AS ordinal FROM evaluations"""),
    "decision_listing": _with(SNAPSHOT_SQL, """
SELECT candidate_id || '|' || filter_set AS decision_id, CAST(row_number() OVER (PARTITION BY candidate_id ORDER BY action <> 'SKIP', filter_set) AS INTEGER) AS ordinal FROM decisions WHERE NOT (day(session_date) % 5 = 0 AND filter_set = 'OBSERVATION')"""),
    "fill_listing": _with(SNAPSHOT_SQL, """
SELECT 'order:' || order_id || '|fill-policy:internal-paper-split-fill|version:v1|sequence:' || fill_sequence AS fill_id, CAST(row_number() OVER (PARTITION BY order_id ORDER BY fill_sequence) AS INTEGER) AS ordinal FROM fills"""),
    "recommendation_listing": """
SELECT p_partkey AS recommendation_id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS INTEGER) AS ordinal FROM part""",
    "outcome_listing": _with(_DATASET, """
SELECT outcome_id AS outcome_key, CAST(row_number() OVER (PARTITION BY scoring_item_id ORDER BY li, outcome_id) AS INTEGER) AS ordinal FROM orev"""),
    "label_listing": _with(_DATASET, """
SELECT 'l' || outcome_id AS label_key, CAST(row_number() OVER (PARTITION BY scoring_item_id ORDER BY CASE WHEN outcome_id LIKE '%|2' THEN 1 ELSE 2 END, outcome_id) AS INTEGER) AS ordinal FROM labels_made"""),
    "item_listing": """
SELECT l_orderkey AS run_id, l_partkey AS item, CAST(10 * row_number() OVER w AS INTEGER) AS stored_ordinal, CAST(row_number() OVER w AS INTEGER) AS place FROM lineitem
WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)""",
    "record_keys": f"""
SELECT n_nationkey, kind, kind || ':v1:' || sha256('{{"code":"' || n_name || '","number":' || n_nationkey || '}}') AS key FROM nation, (VALUES {_KINDS}) k(kind)""",
    "readable_keys": """
WITH h AS (SELECT o_orderkey AS k, o_custkey AS c, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('urn:tidemark:client-order:v1:' || o_orderkey)) AS h FROM orders),
u AS (SELECT *, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS u FROM h)
SELECT CAST(k AS VARCHAR) AS k, 'decision:' || k || '|intent-policy:initial-fixed-usd-notional|version:v1' AS intent_key, 'position:' || k || '|snapshot:' || c || '|strategy:EXIT|version:v1' AS position_key, u AS client_order_id, 'internal-paper:v1:' || u AS broker_reference FROM u""",
    "decimal_texts": r"""
WITH x AS (SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(20, 2)) * 100 AS BIGINT) * 125 AS n FROM part), s AS (SELECT p_partkey, (n // 100000) || '.' || lpad(CAST(n % 100000 AS VARCHAR), 5, '0') AS t FROM x)
SELECT p_partkey, regexp_replace(regexp_replace(t, '0+$', ''), '\.$', '') AS plain, t || '0000000000000' AS places18, t || '0' AS places6, '0' AS zero FROM s""",
    "normal_codes": r"""
SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN 'S' || (s_suppkey % 50) || CASE WHEN s_suppkey % 3 = 1 THEN '.B' ELSE '' END END AS symbol, CASE s_nationkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' END AS currency,
  'A1,B,C' || s_nationkey AS codes FROM supplier""",
    "redacted_texts": """
SELECT c_custkey, '{"API-Token":"<redacted>","name":"' || c_name || '","My Account":"<redacted>"}' AS flat, '{"outer":{"app secret":"<redacted>","list":[{"Chat-Id":"<redacted>","c_mktsegment":"' || c_mktsegment || '"}]}}' AS nested FROM customer""",
    "leaking_names": """
WITH n AS (SELECT CASE p_partkey % 7 WHEN 0 THEN 'Label' WHEN 1 THEN 'future_return' WHEN 2 THEN 'TARGET' WHEN 3 THEN 'Virtual_Result' WHEN 4 THEN 'close_price' ELSE lower(p_brand) END AS name FROM part)
SELECT name, count(*) AS columns FROM n WHERE lower(name) IN ('label', 'future_return', 'target', 'virtual_result', 'outcome', 'prediction') GROUP BY name""",
    "calendar_guard": _with(_CAL, """
, lost AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events WHERE day(ts) % 5 = 0), y AS (SELECT CAST(year(d) AS INTEGER) AS year, count(*) FILTER (d NOT IN (SELECT d FROM lost)) AS sessions, count(*) AS expected FROM cal GROUP BY 1)
SELECT family, year, sessions, expected FROM y, (VALUES ('NYSE_CORE'), ('NASDAQ_CORE')) f(family) WHERE sessions <> expected"""),
    "sessions_between": _with(_CAL, f"""
SELECT d AS session_date, CASE WHEN d IN ({_EARLY}) THEN 'EARLY_CLOSE' ELSE 'REGULAR' END AS kind, CAST(epoch(close_at) - epoch(open_at) AS BIGINT) AS seconds, CAST(hour(open_at) AS INTEGER) AS open_hour FROM cal
WHERE d BETWEEN (SELECT CAST(min(ts) AS DATE) FROM events) AND (SELECT CAST(max(ts) AS DATE) FROM events)"""),
    "calendar_versions": """
WITH a AS (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'UK_EQUITY_CORE' ELSE 'US_EQUITY_CORE' END AS code, CASE n_regionkey % 3 WHEN 0 THEN '2026.v1' WHEN 1 THEN '2018-2026.v1' ELSE '2027.v1' END AS version FROM nation)
SELECT a.*, first, last FROM a LEFT JOIN (VALUES ('US_EQUITY_CORE', '2018-2026.v1', DATE '2018-01-01', DATE '2026-12-31'), ('US_EQUITY_CORE', '2026.v1', DATE '2026-01-01', DATE '2026-12-31')) v(code, version, first, last) USING (code, version)""",
    "stored_lookup": _with(_EVENTS, "SELECT symbol || '|' || session_date AS bar_key, session_date, c AS close_price FROM ebars WHERE symbol = 'U7'"),
    "changed_records": _with(_BARS, "SELECT session_date, count(*) AS rows FROM revisions WHERE day(session_date) = 7 GROUP BY 1"),
    "exact_snapshots": _with(_FEATURES, """
SELECT symbol, 'feature-snapshot:v1:' || sha256('{"as_of":"2001-06-15T12:00:00Z","feature_set_code":"US_EQUITY_DAILY_TECHNICAL","feature_set_version":"v1","horizon_trading_days":3,"symbol":"' || symbol || '"}') AS snapshot_key, quality_status,
  64::INTEGER AS digest_chars, round(one_day_return, 6) AS one_day_return, round(realized_volatility_20d, 6) AS realized_volatility_20d, round(atr14_rate, 6) AS atr14_rate, round(volume_ratio_5_to_20, 6) AS volume_ratio_5_to_20
FROM featured WHERE completed_bar_count = 21 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY session_date DESC) = 1"""),
    "record_violations": """
SELECT * FROM (
  SELECT 'paper_positions' AS table_name, '(status = ''OPEN'') = (quantity > 0 and closed_at is null)' AS rule, count(*) FILTER (o_orderkey % 7 = 0) AS rows FROM orders
  UNION ALL SELECT 'paper_positions', 'version > 1 or (status = ''OPEN'' and realized_pnl = 0)', count(*) FILTER (o_orderkey % 7 = 0 OR o_orderkey % 11 = 0) FROM orders
  UNION ALL SELECT 'paper_positions', 'unique (position_id)', count(*) - count(DISTINCT o_orderkey) FROM orders
  UNION ALL SELECT 'position_events', 'quantity_delta <> 0', count(*) FILTER (o_orderkey % 13 = 0) FROM orders
  UNION ALL SELECT 'position_events', 'sequence_no > 0', count(*) FILTER (o_orderkey <= 0) FROM orders
  UNION ALL SELECT 'position_events', 'unique (fill_id)', count(*) - count(DISTINCT o_orderkey - o_orderkey % 2) FROM orders
  UNION ALL SELECT 'position_events', 'unique (position_id, sequence_no)', count(*) - count(DISTINCT o_orderkey) FROM orders
) WHERE rows > 0""",
}
