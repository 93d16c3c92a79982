"""Queries of the trading chain, of providers and ingestion, over the relational tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import canonical
from ..operators import compare, exact, filters, pit, runs, trading
from ..sources import bars as sources
from .research import known, read, rounded, ts
from .research_sql import _BARS, _EVENTS, _with
from .session import written

SNAPSHOT_SQL = (
    _BARS
    + """,
snapshots AS (
  SELECT symbol, symbol || '|' || session_date AS candidate_id, session_date, o AS open_price, c AS last_price, lag(h) OVER w AS previous_high_price, lag(l) OVER w AS previous_low_price,
    CASE WHEN day(session_date) % 7 <> 0 THEN lag(c) OVER w END AS previous_close_price, CASE WHEN v % 9 = 0 THEN NULL ELSE v END AS volume
  FROM known WINDOW w AS (PARTITION BY symbol ORDER BY session_date) QUALIFY lag(h) OVER w IS NOT NULL
),
checks AS (
  SELECT *, CASE WHEN last_price BETWEEN 10 AND 300 THEN 'PASS' ELSE 'FAIL' END AS price_range,
    CASE WHEN previous_close_price IS NULL THEN 'NOT_EVALUABLE' WHEN open_price - previous_close_price >= 0.03::DOUBLE * previous_close_price THEN 'PASS' ELSE 'FAIL' END AS opening_change_min,
    CASE WHEN previous_close_price IS NULL THEN 'NOT_EVALUABLE' WHEN last_price - previous_close_price <= 0.15::DOUBLE * previous_close_price THEN 'PASS' ELSE 'FAIL' END AS entry_change_max,
    CASE WHEN last_price >= previous_high_price + (previous_high_price - previous_low_price) * 0.5::DOUBLE THEN 'PASS' ELSE 'FAIL' END AS breakout_triggered,
    CASE WHEN coalesce(volume, 0) > 0 THEN 'PASS' ELSE 'FAIL' END AS volume_present,
    CASE WHEN last_price < 10 THEN 'PRICE_BELOW_MINIMUM' WHEN last_price > 300 THEN 'PRICE_ABOVE_MAXIMUM' ELSE 'PRICE_WITHIN_RANGE' END AS price_reason FROM snapshots
),
rated AS (
  SELECT *, CAST((CASE WHEN price_range = 'PASS' THEN 20 ELSE 0 END) + (CASE WHEN opening_change_min = 'PASS' THEN 20 ELSE 0 END) + (CASE WHEN entry_change_max = 'PASS' THEN 20 ELSE 0 END)
    + (CASE WHEN breakout_triggered = 'PASS' THEN 30 ELSE 0 END) + (CASE WHEN volume_present = 'PASS' THEN 10 ELSE 0 END) AS INTEGER) AS score FROM checks
),
evaluations AS (
  SELECT *, CASE WHEN filter_set = 'OBSERVATION' THEN '' ELSE array_to_string(list_filter([
    CASE WHEN h1 AND price_range = 'FAIL' THEN 'HARD_FAIL_PRICE_RANGE' END, CASE WHEN h2 AND opening_change_min = 'FAIL' THEN 'HARD_FAIL_OPENING_CHANGE_MIN' END, CASE WHEN h1 AND entry_change_max = 'FAIL' THEN 'HARD_FAIL_ENTRY_CHANGE_MAX' END,
    CASE WHEN h2 AND breakout_triggered = 'FAIL' THEN 'HARD_FAIL_BREAKOUT_TRIGGERED' END, CASE WHEN h2 AND volume_present = 'FAIL' THEN 'HARD_FAIL_VOLUME_PRESENT' END,
    CASE WHEN h2 AND opening_change_min = 'NOT_EVALUABLE' THEN 'HARD_NOT_EVALUABLE_OPENING_CHANGE_MIN' END, CASE WHEN h1 AND entry_change_max = 'NOT_EVALUABLE' THEN 'HARD_NOT_EVALUABLE_ENTRY_CHANGE_MAX' END,
    CASE WHEN score < least_score THEN 'SCORE_BELOW_MINIMUM' END], lambda x: x IS NOT NULL), ',') END AS blocking
  FROM rated, (VALUES ('STRICT', true, true, 100), ('BALANCED', true, false, 70), ('SCORE_ONLY', false, false, 60), ('OBSERVATION', false, false, 0)) s(filter_set, h1, h2, least_score)
),
decisions AS (
  SELECT *, CASE WHEN filter_set = 'OBSERVATION' THEN 'OBSERVE' WHEN blocking = '' THEN 'ENTER_LONG' ELSE 'SKIP' END AS action FROM evaluations
),
intents AS (
  SELECT candidate_id || '|' || filter_set AS intent_id, candidate_id, symbol, session_date, filter_set, last_price AS price, CAST(floor(1000 / last_price) AS BIGINT) AS quantity FROM decisions WHERE action = 'ENTER_LONG'
),
fills AS (
  SELECT intent_id AS order_id, symbol, session_date, filter_set, price, s AS fill_sequence, CASE WHEN quantity = 1 THEN 1 WHEN s = 1 THEN quantity // 2 ELSE quantity - quantity // 2 END AS quantity
  FROM intents, (VALUES (1), (2)) f(s) WHERE quantity >= 1 AND (s = 1 OR quantity > 1)
)"""
)


def snapshots(spark, d):
    """Candidates: each session of a symbol with the one before."""
    w = Window.partitionBy("symbol").orderBy("session_date")
    before = lambda c: F.lag(c).over(w)
    made = known(spark, d).select(
        "symbol", F.concat_ws("|", "symbol", F.col("session_date").cast("string")).alias("candidate_id"), "session_date", "open_price", F.col("close_price").alias("last_price"), before("high_price").alias("previous_high_price"), before("low_price").alias("previous_low_price"),
        F.when(F.dayofmonth("session_date") % 7 != 0, before("close_price")).alias("previous_close_price"), F.when(F.col("volume") % 9 != 0, F.col("volume")).alias("volume"),
    )
    return made.where("previous_high_price is not null")


def evaluations(spark, d):
    return filters.filter_evaluations(filters.filter_checks(snapshots(spark, d)))


def filter_checks(spark, d):
    return filters.filter_checks(snapshots(spark, d)).select("candidate_id", *(c.lower() for c in filters.CHECKS), "price_reason")


def filter_evaluations(spark, d):
    return evaluations(spark, d).select("candidate_id", "filter_set", "score", F.array_join("blocking_codes", ",").alias("blocking"), "passed", "details")


def filter_pass_summary(spark, d):
    return evaluations(spark, d).groupBy("filter_set").agg(F.count(F.lit(1)).alias("candidates"), F.count_if("passed").alias("passed"), F.sum("score").alias("score_sum"))


def decisions(spark, d):
    return filters.entry_decisions(evaluations(spark, d))


def entry_decisions(spark, d):
    key = canonical.candidate_decision_key(F.col("candidate_id"), F.col("filter_set"), F.lit("v1"))
    return decisions(spark, d).select("candidate_id", "filter_set", "action", key.alias("decision_key"))


def intents(spark, d):
    made = decisions(spark, d).where("action = 'ENTER_LONG'").withColumnsRenamed({"last_price": "price"})
    return trading.sized(made).withColumn("intent_id", F.concat_ws("|", "candidate_id", "filter_set"))


def trade_intents(spark, d):
    return intents(spark, d).select("intent_id", "quantity", "intent_status", "notional")


def orders(spark, d):
    made = intents(spark, d).where("intent_status = 'CREATED'")
    return made.select(F.col("intent_id").alias("order_id"), "intent_id", "candidate_id", "symbol", "session_date", "filter_set", "price", "quantity", (F.col("session_date").cast("timestamp") + F.expr("interval 22 hours")).alias("accepted_at"))


def paper_orders(spark, d):
    """What the paper broker says to orders of mixed currencies, sides and kinds."""
    made = read(spark, d, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.when(F.col("o_custkey") % 7 == 0, "EUR").otherwise("USD").alias("currency"), F.when(F.col("o_orderstatus") == "F", "SELL").otherwise("BUY").alias("side"),
        F.when(F.col("o_orderpriority").startswith("5"), "LIMIT").otherwise("MARKET").alias("kind"),
    )
    result = trading.broker_result(F.col("currency"), F.col("side"), F.col("kind"))
    return made.select("order_id", result.alias("result"))


def fills(spark, d):
    return trading.split_fills(orders(spark, d)).withColumns({"fee": F.lit(0.0), "executed_at": F.col("accepted_at") + F.expr("interval 1 minute")})


def paper_fills(spark, d):
    return fills(spark, d).select("order_id", "fill_sequence", "quantity", "price", "execution_key")


def fill_violations(spark, d):
    """Fills that were changed on purpose, by what is wrong with them."""
    asked = written(orders(spark, d).select("order_id", "session_date", "price", "quantity", "accepted_at"))  # made into fills, and their plan
    made = trading.split_fills(asked).withColumns({"fee": F.lit(0.0), "executed_at": F.col("accepted_at") + F.expr("interval 1 minute")})
    day = F.dayofmonth("session_date")
    bent = made.withColumns({
        "quantity": F.when((day == 3) & (F.col("fill_sequence") == 2), F.col("quantity") + 1).otherwise(F.col("quantity")), "fee": F.when(day == 4, 0.5).otherwise(F.col("fee")),
        "executed_at": F.when(day == 6, F.col("accepted_at") - F.expr("interval 1 second")).otherwise(F.col("executed_at")),
    })
    found = trading.fill_violations(bent, asked)
    return found.groupBy(F.coalesce("violation", F.lit("none")).alias("violation")).agg(F.count(F.lit(1)).alias("fills"))


def positions_running_avg(spark, d):
    made = trading.running_positions(fills(spark, d), ["filter_set", "symbol"], "session_date", "fill_sequence")
    return rounded(made.select("order_id", "fill_sequence", "position_version", "position_quantity", "average_cost"), 6, "average_cost", nudge=3.14159e-10)


def position_exits(spark, d):
    """Positions of a cost at the open, judged at the close, opened some hours before."""
    b = sources.event_bars(read(spark, d, "events"))
    hours = F.make_dt_interval(hours=(F.col("volume") % 8).cast("int"))
    made = b.select(F.col("bar_key").alias("position_id"), F.col("open_price").alias("average_cost_price"), F.col("close_price").alias("current_price"), (F.col("available_at") - hours).alias("opened_at"), F.col("available_at").alias("snapshot_observed_at"))
    found = trading.position_exits(made)
    return rounded(found.select("position_id", "exits", F.array_join("reasons", ",").alias("reasons"), "return_rate"), 9, "return_rate")


def trade_lineage(spark, d):
    """How far fills can be traced back when some orders and intents are lost."""
    o = written(orders(spark, d))  # read by each side of the chain
    decided = F.concat_ws("|", "candidate_id", "filter_set").alias("decision_id")
    i = o.where(F.dayofmonth("session_date") != 9).select("intent_id", decided)
    made = trading.split_fills(o.select("order_id", "quantity")).select("order_id", "fill_sequence")
    found = trading.traced(made, o.where(F.dayofmonth("session_date") != 8), i, o.select(decided, "candidate_id"), o.select("candidate_id", "symbol").distinct())
    return found.groupBy(F.coalesce("missing", F.lit("COMPLETE")).alias("missing")).agg(F.count(F.lit(1)).alias("fills"), F.count("symbol").alias("symbols"))


def position_events_currency(spark, d):
    """Position events with the currency of their position."""
    made = trading.running_positions(fills(spark, d), ["filter_set", "symbol"], "session_date", "fill_sequence")
    events = made.select(F.concat_ws("|", "filter_set", "symbol").alias("position_id"), F.col("position_version").alias("sequence_no"), F.col("quantity").alias("quantity_delta"))
    positions = snapshots(spark, d).select("symbol").distinct().select("symbol", F.explode(F.array(*(F.lit(x) for x in filters.FILTER_SETS))).alias("filter_set"))
    positions = positions.select(F.concat_ws("|", "filter_set", "symbol").alias("position_id"), F.when(F.length("symbol") == 2, "EUR").otherwise("USD").alias("currency"))
    return events.join(positions, "position_id").groupBy("currency").agg(F.count(F.lit(1)).alias("events"), F.sum("quantity_delta").alias("quantity"))


def provider_comparison(spark, d):
    """Users' bars of two providers: each lacks a third of the events, and every event is one's at least."""
    e = read(spark, d, "events")
    first, second = sources.event_bars(e.where("event_id % 3 <> 0")), sources.event_bars(e.where("event_id % 3 <> 1"), "SECOND")
    made = compare.provider_comparison(first, second, 8)
    return rounded(made, 9, "median_difference", "largest_difference", "agreement_rate")


def session_sets(spark, d):
    e = read(spark, d, "events")
    parts = compare.session_sets(sources.event_bars(e.where("event_id % 3 <> 0")), sources.event_bars(e.where("event_id % 3 <> 1")))
    made = None
    for name, df in zip(("common", "first_only", "second_only"), parts):
        one = df.agg(F.count(F.lit(1)).alias("sessions")).select(F.lit(name).alias("part"), "sessions")
        made = one if made is None else made.unionByName(one)
    return made


def _attempts(spark, d):
    raw = F.when(F.col("value") > 300, "TRANSIENT").when(F.col("event_id") % 29 == 0, "NO_CALENDAR").when(F.col("event_id") % 97 == 0, "FATAL").when(F.col("event_id") % 89 == 0, "BUDGET").when(F.col("event_type") == "view", "DEGRADED").when(F.col("event_type") == "error", "NO_DATA").otherwise("READY")
    made = read(spark, d, "events").select(F.concat_ws("|", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("run_id"), "ts", raw.alias("raw"))
    return made.withColumn("ordinal", F.row_number().over(Window.partitionBy("run_id").orderBy("ts"))).drop("ts")


def pipeline_attempts(spark, d):
    return runs.attempted(_attempts(spark, d)).select("run_id", "ordinal", "item_outcome", "reason")


def pipeline_run_status(spark, d):
    return runs.run_counts(runs.attempted(_attempts(spark, d)))


def budget_assessment(spark, d):
    made = read(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 100 + 1).alias("members"), F.when(F.col("c_nationkey") != 3, (F.col("c_acctbal") / 20).cast("long")).alias("left"))
    b = runs.budget_known(F.col("members"), F.lit(3), F.col("left"))
    return made.select("c_custkey", b.alias("b")).select("c_custkey", "b.*")


def create_or_get_status(spark, d):
    o = read(spark, d, "orders")
    key = F.concat(F.lit("k"), F.col("o_orderkey") % 5000)
    stored = pit.first_of(o.where("o_orderkey % 2 = 0").select(key.alias("key"), "o_orderkey", F.col("o_orderstatus").alias("content")), ["key"], F.asc("o_orderkey")).drop("o_orderkey")
    made = pit.create_or_get(o.select(key.alias("key"), F.col("o_orderstatus").alias("content")), stored, "key", "content")
    return made.groupBy("status").agg(F.count(F.lit(1)).alias("rows"))


def ingest_counts(spark, d):
    b = sources.event_bars(read(spark, d, "events"))
    rows, counts = sources.ingest(b, b.where(F.dayofmonth("session_date") % 3 == 0), ["bar_key"])
    new = rows.agg(F.count(F.lit(1)).alias("bars")).select(F.lit("APPENDED").alias("status"), "bars")
    return counts.unionByName(new)


def current_orders(spark, d):
    """The state of orders after a log of moves."""
    o = read(spark, d, "orders")
    steps = F.explode(F.when(F.col("o_orderstatus") == "F", F.array(F.struct(F.lit(1).alias("version"), F.lit("ACCEPTED").alias("status")), F.struct(F.lit(2).alias("version"), F.lit("FILLED").alias("status")))).otherwise(F.array(F.struct(F.lit(1).alias("version"), F.lit("ACCEPTED").alias("status")))))
    log = o.select(F.col("o_orderkey").alias("order_id"), steps.alias("s")).select("order_id", "s.*")
    asked = o.select((F.col("o_orderkey") + F.when(F.col("o_orderkey") % 1000 == 0, 10_000_000).otherwise(0)).alias("order_id"), F.lit("ACCEPTED").alias("expected_status"), F.lit(1).alias("expected_version"), F.lit("PARTIALLY_FILLED").alias("to_status"))
    made = pit.guarded_transition(pit.current_state(log, "order_id"), asked, "order_id")
    return made.groupBy("result").agg(F.count(F.lit(1)).alias("orders"), F.sum("version").alias("versions"))


def order_moves(spark, d):
    o = read(spark, d, "orders")
    state = lambda c: F.element_at(F.array(*(F.lit(x) for x in ("ACCEPTED", "PARTIALLY_FILLED", "FILLED"))), (c % 3 + 1).cast("int"))
    made = o.select(state(F.col("o_orderkey")).alias("old"), state(F.col("o_custkey")).alias("new"))
    return made.groupBy("old", "new", trading.legal_move(F.col("old"), F.col("new")).alias("legal")).agg(F.count(F.lit(1)).alias("orders"))


def recommendation_violations(spark, d):
    p = read(spark, d, "part")
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    act = k % 3 != 0
    plan = lambda x: F.when(act & (k % 31 != 0), x)
    codes = lambda n, c: F.when(k % n != 0, F.array(F.lit(c))).otherwise(F.array().cast("array<string>"))
    rows = p.select(
        k.alias("recommendation_id"), F.when(act, "BUY").when(k % 2 == 0, "MARKET_RISK").otherwise("HOLD").alias("disposition"), codes(41, "R").alias("reasons"), codes(5, "K").alias("risks"),
        F.when(act & (k % 37 != 0), F.array(F.lit("I"))).otherwise(F.array().cast("array<string>")).alias("invalidations"), plan(price * 0.98).alias("entry_low"), plan(price).alias("entry_high"),
        plan(price * F.when(k % 17 == 0, 0.99).otherwise(1.1)).alias("target"), plan(price * 0.9).alias("stop"), plan((k % 10) / 10.0).alias("p_target"), plan((k % 7) / 10.0).alias("p_stop"), plan(F.lit(0.5)).alias("p_up"),
        plan(F.when(k % 43 == 0, 1.5).otherwise(0.6)).alias("confidence"), plan(F.when(k % 29 == 0, 0.0).otherwise(0.1)).alias("expected_value"), plan(F.lit(2.0)).alias("reward_risk"), plan((k % 6 + 1).cast("int")).alias("holding_days"), F.lit(5).alias("horizon_days"),
        F.when(k % 47 == 0, "DEGRADED").otherwise("READY").alias("source_quality"),
    )
    made = trading.recommendation_violations(rows).withColumn("violation", F.explode_outer("violations"))
    return made.groupBy(F.coalesce("violation", F.lit("NONE")).alias("violation")).agg(F.count(F.lit(1)).alias("rows"))


def time_series_answers(spark, d):
    """Answers of a provider that are made of users' days; some were refused, some are not what was asked for or repeat a day."""
    b = sources.event_days(read(spark, d, "events"))
    text = lambda c: F.col(c).cast("decimal(20,2)").cast("string").alias(c.split("_")[0])
    value = F.struct(F.col("session_date").cast("string").alias("datetime"), text("open_price"), text("high_price"), text("low_price"), text("close_price"), F.col("volume").cast("string").alias("volume"))
    made = b.groupBy("symbol").agg(F.collect_list(value).alias("values"))
    ends = lambda x: F.col("symbol").endswith(x)
    meta = F.struct(
        F.when(ends("7"), "X").otherwise(F.col("symbol")).alias("symbol"), F.when(ends("9"), "1week").otherwise("1day").alias("interval"), F.lit("USD").alias("currency"),
        F.lit("XNYS").alias("mic_code"), F.lit("NYSE").alias("exchange"), F.lit("America/New_York").alias("exchange_timezone"),
    ).alias("meta")
    values = F.when(ends("5"), F.concat("values", F.slice("values", 1, 1))).otherwise(F.col("values")).alias("values")
    body = F.to_json(F.struct(F.when(ends("3"), "error").otherwise("ok").alias("status"), meta, values))
    return made.select("symbol", F.lit("XNYS").alias("mic_code"), F.to_date(F.lit("2024-01-26")).alias("cutoff"), ts("2024-01-27 00:00:00").alias("observed_at"), body.alias("body"))


def ingest_time_series(spark, d):
    """Bars parsed from the answers that can be used."""
    found = sources.parse_time_series(time_series_answers(spark, d), 10)
    return found.select("symbol", "session_date", *(F.col(c).cast("double").alias(c) for c in ("open_price", "high_price", "low_price", "close_price")), F.col("volume"))


def source_versions(spark, d):
    """Record keys and versions of the parsed bars: the version is a digest of what was mapped."""
    return sources.parse_time_series(time_series_answers(spark, d), 10).select("symbol", "session_date", "source_record_key", "source_version")


def page_answers(spark, d):
    """Pages whose instants lie in the night of New York; some hold a bar whose prices do not fit."""
    b = sources.event_days(read(spark, d, "events"))
    at = F.concat(F.col("session_date").cast("string"), F.lit("T03:00:00Z"))
    high = F.when((F.dayofmonth("session_date") == 9) & F.col("symbol").endswith("4"), F.col("low_price") / 2).otherwise(F.col("high_price"))
    bar = F.struct(at.alias("t"), F.col("open_price").alias("o"), high.alias("h"), F.col("low_price").alias("l"), F.col("close_price").alias("c"), F.col("volume").alias("v"))
    return b.groupBy("symbol").agg(F.collect_list(bar).alias("bars")).select(
        "symbol", F.lit("XNYS").alias("mic_code"), F.to_date(F.lit("2024-01-27")).alias("cutoff"), ts("2024-02-01 00:00:00").alias("observed_at"), F.to_json(F.struct("symbol", "bars")).alias("body")
    )


def ingest_pages(spark, d):
    """Bars parsed from the pages that can be used."""
    return sources.parse_pages(page_answers(spark, d), 12).select("symbol", "session_date", F.col("close_price").cast("double").alias("close_price"), "volume")


def ingest_problems(spark, d):
    """How many answers of either provider are refused, and for what."""
    read_ = {"series": sources.read_time_series(time_series_answers(spark, d)), "pages": sources.read_pages(page_answers(spark, d))}
    made = None
    for name, df in read_.items():
        one = df.groupBy(F.lit(name).alias("provider"), F.coalesce("problem", F.lit("NONE")).alias("problem")).agg(F.count(F.lit(1)).alias("answers"))
        made = one if made is None else made.unionByName(one)
    return made


def bar_rejections(spark, d):
    """Days that make no bar, by the rule they break."""
    days = sources.event_days(read(spark, d, "events"))
    return days.groupBy(F.coalesce(sources.bar_problem(), F.lit("NONE")).alias("problem")).agg(F.count(F.lit(1)).alias("days"))


def universe_listing(spark, d):
    made = read(spark, d, "supplier").select(F.concat(F.lit("N"), "s_nationkey").alias("mic_code"), F.concat(F.lit("S"), "s_suppkey").alias("symbol"), (F.col("s_nationkey") % 5).alias("universe"))
    return pit.numbered(made, "universe", ["universe"])


def position_folds(spark, d):
    """Average costs with 18 places, rounded at every fill, of each position's last fill; six places of them are given."""
    f = fills(spark, d).select("filter_set", "symbol", "session_date", "fill_sequence", "quantity", F.col("price").cast("decimal(38,18)").alias("price"))
    made = exact.fold_positions(f, ["filter_set", "symbol"], ["session_date", "fill_sequence"])
    made = made.groupBy("filter_set", "symbol").agg(F.max("position_version").alias("fills"), F.max("position_quantity").alias("quantity"), F.max_by("average_cost", "position_version").cast("double").alias("average_cost"))
    return rounded(made, 6, "average_cost", nudge=3.14159e-10)


QUERIES: dict = {
    f.__name__: f
    for f in (
        filter_checks, filter_evaluations, filter_pass_summary, entry_decisions, trade_intents, paper_orders, paper_fills, fill_violations, positions_running_avg, position_exits, trade_lineage,
        position_events_currency, provider_comparison, session_sets, pipeline_attempts, pipeline_run_status, budget_assessment, create_or_get_status, ingest_counts, current_orders, order_moves,
        recommendation_violations, ingest_time_series, source_versions, ingest_pages, ingest_problems, bar_rejections, universe_listing, position_folds,
    )
}

_TWO = """
p AS (SELECT 'U' || user_id AS symbol, CAST(ts AS DATE) AS d, arg_max(value, ts) AS c FROM events WHERE event_id % 3 <> 0 GROUP BY user_id, CAST(ts AS DATE) HAVING min(value) > 0),
v AS (SELECT 'U' || user_id AS symbol, CAST(ts AS DATE) AS d, arg_max(value, ts) AS c FROM events WHERE event_id % 3 <> 1 GROUP BY user_id, CAST(ts AS DATE) HAVING min(value) > 0)"""

_ANSWERS = """,
rated AS (SELECT *, CAST(o AS DECIMAL(20, 2)) AS o2, CAST(h AS DECIMAL(20, 2)) AS h2, CAST(l AS DECIMAL(20, 2)) AS l2, CAST(c AS DECIMAL(20, 2)) AS c2 FROM edays),
answers AS (
  SELECT symbol, CASE WHEN symbol LIKE '%3' THEN 'PROVIDER_REJECTED_REQUEST' WHEN symbol LIKE '%7' OR symbol LIKE '%9' THEN 'RESPONSE_SCHEMA_INVALID' WHEN symbol LIKE '%5' OR min(l2) <= 0 THEN 'RESPONSE_VALUE_INVALID' ELSE 'NONE' END AS problem
  FROM rated GROUP BY symbol
),
series AS (
  SELECT r.* FROM rated r JOIN answers a USING (symbol) WHERE a.problem = 'NONE' AND session_date <= DATE '2024-01-26' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY session_date DESC) <= 10
)"""

_RUNS = """
raw AS (
  SELECT user_id || '|' || CAST(ts AS DATE) AS run_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts) AS ordinal,
    CASE WHEN value > 300 THEN 'TRANSIENT' WHEN event_id % 29 = 0 THEN 'NO_CALENDAR' WHEN event_id % 97 = 0 THEN 'FATAL' WHEN event_id % 89 = 0 THEN 'BUDGET' WHEN event_type = 'view' THEN 'DEGRADED' WHEN event_type = 'error' THEN 'NO_DATA' ELSE 'READY' END AS raw
  FROM events
),
streaks AS (SELECT *, sum(CASE WHEN raw IN ('TRANSIENT', 'NO_CALENDAR') THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY ordinal) AS streak FROM raw),
failing AS (SELECT *, sum(CASE WHEN raw = 'TRANSIENT' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, streak ORDER BY ordinal) AS failures FROM streaks),
stops AS (SELECT *, CASE WHEN raw IN ('BUDGET', 'FATAL') THEN raw WHEN raw = 'TRANSIENT' AND failures >= 3 THEN 'CIRCUIT' END AS stop FROM failing),
first_stop AS (SELECT run_id, min(ordinal) AS at, arg_min(stop, ordinal) AS stop FROM stops WHERE stop IS NOT NULL GROUP BY run_id),
attempted AS (
  SELECT s.run_id, CAST(s.ordinal AS INTEGER) AS ordinal, CASE WHEN s.ordinal > f.at THEN f.stop END AS halted, raw,
    CASE WHEN s.ordinal > f.at THEN CASE WHEN f.stop = 'BUDGET' THEN 'NOT_ATTEMPTED_BUDGET' ELSE 'NOT_ATTEMPTED_ABORTED' END WHEN raw = 'NO_CALENDAR' THEN 'CALENDAR_ERROR' WHEN raw = 'BUDGET' THEN 'NOT_ATTEMPTED_BUDGET'
      WHEN raw IN ('TRANSIENT', 'FATAL') THEN 'PROVIDER_ERROR' ELSE raw END AS item_outcome
  FROM stops s LEFT JOIN first_stop f USING (run_id)
)"""



def _plain(x: str) -> str:
    """A decimal as text without zeros at the end."""
    return rf"regexp_replace(regexp_replace(CAST({x} AS VARCHAR), '0+$', ''), '\.$', '')"


ORACLE_SQL: dict[str, str] = {
    "filter_checks": _with(SNAPSHOT_SQL, "SELECT candidate_id, price_range, opening_change_min, entry_change_max, breakout_triggered, volume_present, price_reason FROM checks"),
    "filter_evaluations": _with(SNAPSHOT_SQL, """
, n AS (SELECT *, len(list_filter([price_range, opening_change_min, entry_change_max, breakout_triggered, volume_present], lambda x: x = 'FAIL')) AS nf, len(list_filter([opening_change_min, entry_change_max], lambda x: x = 'NOT_EVALUABLE')) AS nn FROM evaluations)
SELECT candidate_id, filter_set, score, blocking, blocking = '' AS passed, '{"blocking_reason_codes":[' || CASE WHEN blocking = '' THEN '' ELSE '"' || replace(blocking, ',', '","') || '"' END || '],"counts":{"fail":' || nf || ',"not_evaluable":' || nn
  || ',"pass":' || (5 - nf - nn) || '},"filter_set_name":"' || filter_set || '"}' AS details FROM n"""),
    "filter_pass_summary": _with(SNAPSHOT_SQL, "SELECT filter_set, count(*) AS candidates, count(*) FILTER (blocking = '') AS passed, CAST(sum(score) AS BIGINT) AS score_sum FROM evaluations GROUP BY filter_set"),
    "entry_decisions": _with(SNAPSHOT_SQL, "SELECT candidate_id, filter_set, action, 'candidate:' || candidate_id || '|strategy:' || filter_set || '|version:v1' AS decision_key FROM decisions"),
    "trade_intents": _with(SNAPSHOT_SQL, "SELECT intent_id, quantity, CASE WHEN quantity < 1 THEN 'REJECTED' ELSE 'CREATED' END AS intent_status, price * quantity AS notional FROM intents"),
    "paper_orders": """
SELECT o_orderkey AS order_id, CASE WHEN o_custkey % 7 = 0 THEN 'REJECTED_CURRENCY' WHEN o_orderstatus = 'F' THEN 'REJECTED_SIDE' WHEN starts_with(o_orderpriority, '5') THEN 'REJECTED_ORDER_TYPE' ELSE 'ACCEPTED' END AS result FROM orders""",
    "paper_fills": _with(SNAPSHOT_SQL, "SELECT order_id, CAST(fill_sequence AS INTEGER) AS fill_sequence, CAST(quantity AS BIGINT) AS quantity, price, 'order:' || order_id || '|fill-policy:internal-paper-split-fill|version:v1|sequence:' || fill_sequence AS execution_key FROM fills"),
    "fill_violations": _with(SNAPSHOT_SQL, """
SELECT CASE WHEN day(session_date) = 3 AND fill_sequence = 2 THEN 'quantity_mismatch' WHEN day(session_date) = 4 THEN 'nonzero_fee' WHEN day(session_date) = 6 THEN 'execution_precedes_acceptance' ELSE 'none' END AS violation, count(*) AS fills FROM fills GROUP BY 1"""),
    "positions_running_avg": _with(SNAPSHOT_SQL, """
SELECT order_id, CAST(fill_sequence AS INTEGER) AS fill_sequence, CAST(row_number() OVER w AS INTEGER) AS position_version, CAST(sum(quantity) OVER w AS BIGINT) AS position_quantity, round(sum(price * quantity) OVER w / sum(quantity) OVER w + 3.14159e-10::DOUBLE, 6) AS average_cost
FROM fills WINDOW w AS (PARTITION BY filter_set, symbol ORDER BY session_date, fill_sequence)"""),
    "position_exits": _with(_EVENTS, """
, x AS (SELECT symbol || '|' || session_date AS position_id, array_to_string(list_filter([CASE WHEN c - o <= -0.05::DOUBLE * o THEN 'STOP_LOSS' END, CASE WHEN c - o >= 0.10::DOUBLE * o THEN 'TAKE_PROFIT' END, CASE WHEN v % 8 >= 6 THEN 'TIME_EXIT' END], lambda y: y IS NOT NULL), ',') AS reasons, c / o - 1 AS r FROM ebars)
SELECT position_id, reasons <> '' AS exits, reasons, round(r, 9) AS return_rate FROM x"""),
    "trade_lineage": _with(SNAPSHOT_SQL, """
SELECT CASE WHEN day(session_date) = 8 THEN 'MISSING_AFTER_ORDER_ID' WHEN day(session_date) = 9 THEN 'MISSING_AFTER_INTENT_ID' ELSE 'COMPLETE' END AS missing, count(*) AS fills, count(*) FILTER (day(session_date) NOT IN (8, 9)) AS symbols FROM fills GROUP BY 1"""),
    "position_events_currency": _with(SNAPSHOT_SQL, "SELECT CASE WHEN length(symbol) = 2 THEN 'EUR' ELSE 'USD' END AS currency, count(*) AS events, CAST(sum(quantity) AS BIGINT) AS quantity FROM fills GROUP BY 1"),
    "provider_comparison": _with(_TWO, """
, b AS (SELECT symbol, d, p.c AS a, v.c AS z, p.c IS NOT NULL AND v.c IS NOT NULL AS common FROM p FULL JOIN v USING (symbol, d)),
s AS (SELECT *, CASE WHEN common THEN sign(a - lag(a) OVER w) = sign(z - lag(z) OVER w) END AS agrees, CASE WHEN common THEN abs(z / a - 1) END AS diff FROM b WINDOW w AS (PARTITION BY symbol, common ORDER BY d)),
g AS (SELECT symbol, count(a) AS primary_bars, count(z) AS validation_bars, count(*) FILTER (common) AS overlap, count(*) FILTER (z IS NULL) AS primary_only, count(*) FILTER (a IS NULL) AS validation_only,
  median(diff) AS m, max(diff) AS x, count(*) FILTER (agrees) AS ag, count(agrees) AS ob FROM s GROUP BY symbol),
o AS (SELECT *, CASE WHEN primary_bars = 0 THEN 'PRIMARY_DATA_MISSING' WHEN validation_bars = 0 THEN 'VALIDATION_DATA_MISSING' WHEN overlap < 8 THEN 'INSUFFICIENT_OVERLAP' ELSE 'COMPARABLE' END AS outcome FROM g)
SELECT symbol, primary_bars, validation_bars, overlap, primary_only, validation_only, outcome, CASE WHEN outcome = 'COMPARABLE' THEN round(m, 9) END AS median_difference, CASE WHEN outcome = 'COMPARABLE' THEN round(x, 9) END AS largest_difference,
  CASE WHEN outcome = 'COMPARABLE' THEN ag ELSE 0 END AS agreeing, CASE WHEN outcome = 'COMPARABLE' THEN ob ELSE 0 END AS observed, CASE WHEN outcome = 'COMPARABLE' THEN round(ag / ob, 9) END AS agreement_rate FROM o"""),
    "session_sets": _with(_TWO, """
SELECT 'common' AS part, count(*) AS sessions FROM (SELECT symbol, d FROM p INTERSECT SELECT symbol, d FROM v) UNION ALL SELECT 'first_only', count(*) FROM (SELECT symbol, d FROM p EXCEPT SELECT symbol, d FROM v)
UNION ALL SELECT 'second_only', count(*) FROM (SELECT symbol, d FROM v EXCEPT SELECT symbol, d FROM p)"""),
    "pipeline_attempts": _with(_RUNS, "SELECT run_id, ordinal, item_outcome, CASE WHEN halted = 'CIRCUIT' THEN 'TRANSIENT_FAILURE_CIRCUIT_OPEN' ELSE halted END AS reason FROM attempted"),
    "pipeline_run_status": _with(_RUNS, """
SELECT run_id, count(*) FILTER (item_outcome = 'READY') AS ready_count, count(*) FILTER (item_outcome = 'DEGRADED') AS degraded_count, count(*) FILTER (item_outcome = 'DATA_INSUFFICIENT') AS data_insufficient_count, count(*) FILTER (item_outcome = 'NO_DATA') AS no_data_count,
  count(*) FILTER (item_outcome = 'PROVIDER_ERROR') AS provider_error_count, count(*) FILTER (item_outcome = 'CALENDAR_ERROR') AS calendar_error_count, count(*) FILTER (starts_with(item_outcome, 'NOT_ATTEMPTED')) AS not_attempted_count,
  CASE WHEN bool_or(item_outcome IN ('PROVIDER_ERROR', 'CALENDAR_ERROR', 'NOT_ATTEMPTED_BUDGET', 'NOT_ATTEMPTED_ABORTED')) THEN 'COMPLETED_WITH_PARTIAL_FAILURES' WHEN bool_or(item_outcome IN ('DATA_INSUFFICIENT', 'NO_DATA')) THEN 'COMPLETED_WITH_WARNINGS' ELSE 'COMPLETED' END AS status
FROM attempted GROUP BY run_id"""),
    "budget_assessment": """
SELECT c_custkey, (c_custkey % 100 + 1) * 3 AS estimated, c_nationkey <> 3 AS known, CASE WHEN c_nationkey <> 3 THEN (c_custkey % 100 + 1) * 3 <= CAST(trunc(c_acctbal / 20) AS BIGINT) ELSE false END AS can_start FROM customer""",
    "create_or_get_status": """
WITH k AS (SELECT 'k' || (o_orderkey % 5000) AS key, o_orderkey, o_orderstatus AS content FROM orders), s AS (SELECT key, arg_min(content, o_orderkey) AS stored FROM k WHERE o_orderkey % 2 = 0 GROUP BY key)
SELECT CASE WHEN stored IS NULL THEN 'CREATED' WHEN stored = content THEN 'ALREADY_EXISTS' ELSE 'CONFLICT' END AS status, count(*) AS rows FROM k LEFT JOIN s USING (key) GROUP BY 1""",
    "ingest_counts": _with(_EVENTS, """
SELECT CASE WHEN day(session_date) % 3 = 0 THEN 'ALREADY_EXISTS' ELSE 'CREATED' END AS status, count(*) AS bars FROM ebars GROUP BY 1 UNION ALL SELECT 'APPENDED', count(*) FROM ebars WHERE day(session_date) % 3 <> 0"""),
    "current_orders": """
WITH q AS (SELECT o_orderkey % 1000 = 0 AS gone, o_orderstatus = 'F' AS filled FROM orders)
SELECT CASE WHEN gone THEN 'NOT_FOUND' WHEN filled THEN 'OPTIMISTIC_CONFLICT' ELSE 'APPLIED' END AS result, count(*) AS orders, CAST(sum(CASE WHEN NOT gone AND NOT filled THEN 2 END) AS BIGINT) AS versions FROM q GROUP BY 1""",
    "order_moves": """
WITH s AS (SELECT ['ACCEPTED', 'PARTIALLY_FILLED', 'FILLED'][CAST(o_orderkey % 3 + 1 AS BIGINT)] AS old, ['ACCEPTED', 'PARTIALLY_FILLED', 'FILLED'][CAST(o_custkey % 3 + 1 AS BIGINT)] AS new FROM orders)
SELECT old, new, (old = 'ACCEPTED' AND new <> 'ACCEPTED') OR (old = 'PARTIALLY_FILLED' AND new = 'FILLED') AS legal, count(*) AS orders FROM s GROUP BY ALL""",
    "recommendation_violations": """
WITH r AS (SELECT p_partkey AS k, p_partkey % 3 <> 0 AS act, p_partkey % 3 <> 0 AND p_partkey % 31 <> 0 AS plan FROM part),
v AS (SELECT unnest(CASE WHEN len(f) = 0 THEN ['NONE'] ELSE f END) AS violation FROM (SELECT list_filter([
  CASE WHEN plan <> act THEN 'PLAN_PRESENCE' END, CASE WHEN k % 41 = 0 THEN 'REASONS_EMPTY' END, CASE WHEN (act OR k % 2 = 0) AND k % 5 = 0 THEN 'RISKS_MISSING' END, CASE WHEN act AND k % 37 = 0 THEN 'INVALIDATIONS' END,
  CASE WHEN plan AND k % 17 = 0 THEN 'PRICE_ORDER' END, CASE WHEN plan AND k % 43 = 0 THEN 'PROBABILITY' END, CASE WHEN plan AND (k % 10) / 10.0::DOUBLE + (k % 7) / 10.0::DOUBLE > 1 THEN 'PROBABILITY_SUM' END,
  CASE WHEN plan AND k % 29 = 0 THEN 'EXPECTED_VALUE' END, CASE WHEN plan AND k % 6 + 1 > 5 THEN 'HOLDING' END, CASE WHEN act AND k % 47 = 0 THEN 'SOURCE_NOT_READY' END], lambda x: x IS NOT NULL) AS f FROM r))
SELECT violation, count(*) AS rows FROM v GROUP BY violation""",
    "ingest_time_series": _with(_EVENTS + _ANSWERS, """
SELECT symbol, session_date, CAST(o2 AS DOUBLE) AS open_price, CAST(h2 AS DOUBLE) AS high_price, CAST(l2 AS DOUBLE) AS low_price, CAST(c2 AS DOUBLE) AS close_price, CAST(NULL AS BIGINT) AS volume FROM series"""),
    "source_versions": _with(_EVENTS + _ANSWERS, f"""
, t AS (SELECT symbol, session_date, {", ".join(f"{_plain(f'{x}2')} AS {x}" for x in "ohlc")} FROM (SELECT symbol, session_date, o2, h2, l2, c2 FROM series))
SELECT symbol, session_date, 'XNYS.' || symbol || '.' || strftime(session_date, '%Y%m%d') || '.SPLITS' AS source_record_key, sha256('{{"adjustment_mode":"SPLITS","close":"' || c || '","high":"' || h || '","low":"' || l
  || '","mapping_version":"twelve-data-time-series-v1","mic_code":"XNYS","open":"' || o || '","session_date":"' || session_date || '","symbol":"' || symbol || '","volume":null}}') AS source_version FROM t"""),
    "ingest_pages": _with(_EVENTS, """
SELECT symbol, session_date - 1 AS session_date, c AS close_price, v AS volume FROM edays
WHERE symbol NOT IN (SELECT symbol FROM edays WHERE l <= 0 OR (symbol LIKE '%4' AND day(session_date) = 9)) AND session_date - 1 <= DATE '2024-01-27' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY session_date DESC) <= 12"""),
    "ingest_problems": _with(_EVENTS + _ANSWERS, """
, p AS (SELECT symbol, bool_or(l <= 0 OR (symbol LIKE '%4' AND day(session_date) = 9)) AS bad FROM edays GROUP BY symbol)
SELECT 'series' AS provider, problem, count(*) AS answers FROM answers GROUP BY problem UNION ALL SELECT 'pages', CASE WHEN bad THEN 'RESPONSE_VALUE_INVALID' ELSE 'NONE' END, count(*) FROM p GROUP BY 2"""),
    "bar_rejections": _with(_EVENTS, "SELECT CASE WHEN l > 0 THEN 'NONE' ELSE 'NONPOSITIVE_PRICE' END AS problem, count(*) AS days FROM edays GROUP BY 1"),
    "universe_listing": """
SELECT 'N' || s_nationkey AS mic_code, 'S' || s_suppkey AS symbol, s_nationkey % 5 AS universe, CAST(row_number() OVER (PARTITION BY s_nationkey % 5 ORDER BY 'N' || s_nationkey, 'S' || s_suppkey) AS INTEGER) AS ordinal FROM supplier""",
    "position_folds": _with(SNAPSHOT_SQL, "SELECT filter_set, symbol, CAST(count(*) AS INTEGER) AS fills, CAST(sum(quantity) AS BIGINT) AS quantity, round(sum(price * quantity) / sum(quantity) + 3.14159e-10::DOUBLE, 6) AS average_cost FROM fills GROUP BY ALL"),
}
