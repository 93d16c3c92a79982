"""Boundary tables, ties, point-in-time and exact decimals of the relational operators."""

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.functions import canonical
from tidemark.operators import datasets, exact, filters, outcomes, pit, runs, scoring, trading
from tidemark.operators.features import technical_features
from tidemark.sources import bars as sources

D = Decimal


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def bars(spark, n, volume=lambda i: 1000 + 10 * i):
    day = date(2026, 1, 1)
    made = []
    for i in range(n):
        close = 100.0 + i
        made.append(("UNIT_SOURCE", "AAPL", "SPLIT_ADJUSTED", day + timedelta(i), close - 0.5, close + 2, close - 2, close, volume(i), datetime(2026, 1, 1, 23) + timedelta(i), f"bar-{i:03d}"))
    return spark.createDataFrame(made, "source_code string, symbol string, adjustment_basis string, session_date date, open_price double, high_price double, low_price double, close_price double, volume long, available_at timestamp, bar_key string")


def snapshot(spark, **change):
    base = {"open_price": D("22.66"), "last_price": D(25), "previous_high_price": D(20), "previous_low_price": D(10), "previous_close_price": D(22), "volume": 100} | change
    prices = ", ".join(f"{k} decimal(30,18)" for k in base if k != "volume")
    return spark.createDataFrame([tuple(base.values())], f"{prices}, volume long")


@pytest.mark.parametrize(
    ("check", "change", "expected"),
    [
        ("price_range", {"last_price": D(10)}, "PASS"), ("price_range", {"last_price": D(300)}, "PASS"),
        ("price_range", {"last_price": D("9.999999999999999999")}, "FAIL"), ("price_range", {"last_price": D("300.000000000000000001")}, "FAIL"),
        ("opening_change_min", {"open_price": D(103), "previous_close_price": D(100)}, "PASS"), ("opening_change_min", {"open_price": D("102.999"), "previous_close_price": D(100)}, "FAIL"),
        ("opening_change_min", {"previous_close_price": None}, "NOT_EVALUABLE"), ("entry_change_max", {"last_price": D(115), "previous_close_price": D(100)}, "PASS"),
        ("entry_change_max", {"last_price": D("115.0001"), "previous_close_price": D(100)}, "FAIL"), ("breakout_triggered", {"last_price": D(25)}, "PASS"),
        ("breakout_triggered", {"last_price": D("24.999999999999999999")}, "FAIL"), ("volume_present", {"volume": 1}, "PASS"), ("volume_present", {"volume": 0}, "FAIL"), ("volume_present", {"volume": None}, "FAIL"),
    ],
)
def test_filter_boundaries(spark, check, change, expected):
    assert filters.filter_checks(snapshot(spark, **change)).first()[check] == expected


def test_filter_sets(spark):
    found = {r.filter_set: (r.score, r.passed, r.blocking_codes) for r in filters.filter_evaluations(filters.filter_checks(snapshot(spark, previous_close_price=None))).collect()}
    assert found["STRICT"][1] is False and found["STRICT"][2][-1] == "SCORE_BELOW_MINIMUM"
    assert found["SCORE_ONLY"] == (60, True, []) and found["OBSERVATION"] == (60, True, [])


def test_twenty_bars_are_too_few_and_21_are_ready(spark):
    assert {r.quality_status for r in technical_features(bars(spark, 20)).collect()} == {"DATA_INSUFFICIENT"}
    last = technical_features(bars(spark, 21)).orderBy(F.desc("session_date")).first()
    assert (last.quality_status, last.completed_bar_count, last.last_close) == ("READY", 21, 120.0)
    assert last.one_day_return == pytest.approx(120 / 119 - 1) and last.twenty_day_return == pytest.approx(0.2)
    assert last.distance_from_prior_20d_high == pytest.approx(120 / 121 - 1) and last.distance_from_prior_20d_low == pytest.approx(120 / 98 - 1)
    assert last.volume_ratio_5_to_20 == pytest.approx(1180 / 1105)


def test_a_null_volume_degrades_and_zero_volumes_are_unusable(spark):
    last = lambda v: technical_features(bars(spark, 21, v)).orderBy(F.desc("session_date")).first()
    assert last(lambda i: None if i == 0 else 5).quality_reason == "VOLUME_DATA_INCOMPLETE"
    assert last(lambda i: 0).quality_reason == "VOLUME_DATA_UNUSABLE" and last(lambda i: 0).volume_ratio_5_to_20 is None


def test_a_later_revision_changes_nothing_before_it_is_known(spark):
    b = bars(spark, 3)
    late = b.withColumn("close_price", F.col("close_price") * 2).withColumn("available_at", F.col("available_at") + F.expr("interval 10 days")).withColumn("bar_key", F.concat("bar_key", F.lit("r")))
    as_of = F.lit("2026-01-05 00:00:00").cast("timestamp")
    assert rows(pit.known_bars(b.unionByName(late), as_of), "session_date") == rows(pit.known_bars(b, as_of), "session_date")
    after = pit.latest_sessions(b.unionByName(late), F.lit("2027-01-01").cast("timestamp"), 2)
    assert [(r.position, r.close_price) for r in after.orderBy("position").collect()] == [(1, 202.0), (2, 204.0)]


def test_midranks_share_ties_and_one_value_is_in_the_middle(spark):
    df = spark.createDataFrame([("a", "A", 2.0), ("a", "B", 2.0), ("a", "C", 3.0), ("a", "D", 4.0), ("b", "A", 9.0), ("b", "N", None)], "run string, s string, v double")
    found = {(r.run, r.s): r.p for r in scoring.midrank_percentile(df, "v", ["run"], "p").collect()}
    assert found[("a", "A")] == found[("a", "B")] == pytest.approx(1 / 6) and found[("a", "C")] == pytest.approx(2 / 3)
    assert (found[("a", "D")], found[("b", "A")], found[("b", "N")]) == (1.0, 0.5, None)


def test_sessions_of_each_year(spark):
    found = cal.trading_sessions(spark).where("family = 'NYSE_CORE'").groupBy(F.year("session_date").alias("y")).count().orderBy("y").collect()
    assert tuple(r["count"] for r in found) == cal.SESSIONS_PER_YEAR and sum(cal.SESSIONS_PER_YEAR) == 2262
    one = cal.trading_sessions(spark).where("session_date = '2024-11-29' and family = 'NASDAQ_CORE'").first()
    assert (one.kind, one.close_at) == ("EARLY_CLOSE", datetime(2024, 11, 29, 18)) and str(cal.early_closes(2021)) == "[(datetime.date(2021, 11, 26), 'DAY_AFTER_THANKSGIVING')]"


def test_a_session_is_complete_at_its_close_and_grace(spark):
    asked = spark.createDataFrame([("XNYS", datetime(2024, 1, 3, 21, 1), 60), ("XNYS", datetime(2024, 1, 3, 21, 0, 59), 60), ("XLON", datetime(2024, 1, 3), 0), ("XASE", datetime(2030, 1, 1), 0), ("XNGS", datetime(2018, 1, 2, 5), 0)], "mic_code string, as_of timestamp, grace_seconds int")
    found = [(r.outcome, r.session_date) for r in cal.completed_session(asked, cal.trading_sessions(spark)).orderBy("as_of").collect()]
    assert found == [("NO_COMPLETED_SESSION", None), ("UNSUPPORTED_MIC", None), ("RESOLVED", date(2024, 1, 2)), ("RESOLVED", date(2024, 1, 3)), ("CALENDAR_OUT_OF_COVERAGE", None)]


def test_lookups_by_day(spark):
    days = spark.createDataFrame([(date(2024, 1, 15),), (date(2024, 1, 16),), (date(2018, 1, 1),), (date(2026, 12, 31),), (date(2027, 3, 1),), (None,)], "day date")
    found = {r.day: (r.is_session, r.latest) for r in cal.session_lookup(days, cal.trading_sessions(spark)).collect()}
    assert found == {date(2024, 1, 15): (False, date(2024, 1, 12)), date(2024, 1, 16): (True, date(2024, 1, 16)), date(2018, 1, 1): (False, None), date(2026, 12, 31): (True, date(2026, 12, 31)), date(2027, 3, 1): (False, None), None: (False, None)}
    assert {r.latest for r in cal.session_lookup(days, cal.trading_sessions(spark), checked=False).where("day = '2027-03-01'").collect()} == {date(2026, 12, 31)}


def test_a_day_of_grace_reaches_back_two_sessions(spark):
    asked = spark.createDataFrame([("XNYS", datetime(2024, 1, 5, 15), 86400), ("XNYS", datetime(2024, 1, 5, 21), 86400)], "mic_code string, as_of timestamp, grace_seconds int")
    assert [r.session_date for r in cal.completed_session(asked, cal.trading_sessions(spark)).orderBy("as_of").collect()] == [date(2024, 1, 3), date(2024, 1, 4)]


@pytest.mark.parametrize("h", [1, 2, 3, 4, 5])
def test_horizons_count_sessions_and_run_off_the_calendar(spark, h):
    c = cal.trading_sessions(spark).where("family = 'NYSE_CORE'")
    days = spark.createDataFrame([(date(2024, 1, 12),), (date(2024, 1, 13),), (date(2026, 12, 31),)], "session_date date")
    found = {r.session_date: r for r in outcomes.future_sessions(days, c, h).collect()}
    friday = found[date(2024, 1, 12)]
    assert friday.covered and friday.terminal_date == date(2024, 1, 15 + h if h < 5 else 22)  # the 15th is a holiday
    assert not found[date(2024, 1, 13)].known and found[date(2026, 12, 31)].known and not found[date(2026, 12, 31)].covered


def test_labels(spark):
    df = spark.createDataFrame([(0.1,), (0.0,), (-0.1,), (None,)], "r double")
    assert [r.l for r in df.select(outcomes.label(F.col("r")).alias("l")).collect()] == ["POSITIVE", "NOT_POSITIVE", "NOT_POSITIVE", None]


FACTS = dict(items=300, sessions=60, replay_items=150, replay_sessions=20, positive=150, not_positive=150, replay_positive=75, replay_not_positive=75, prospective_items=150, prospective_sessions=20, prospective_positive=75, prospective_not_positive=75, null_scores=0, invalid_scores=0, duplicates=0)


@pytest.mark.parametrize(("change", "expected"), [({}, "DATA_READY"), ({"items": 299}, "DATA_INSUFFICIENT"), ({"sessions": 59}, "DATA_INSUFFICIENT"), ({"replay_items": 149}, "DATA_INSUFFICIENT"), ({"positive": 59}, "CLASS_IMBALANCED"), ({"replay_positive": 29}, "CLASS_IMBALANCED"), ({"prospective_items": 99}, "PROSPECTIVE_INSUFFICIENT"), ({"prospective_sessions": 19}, "PROSPECTIVE_INSUFFICIENT"), ({"duplicates": 1}, "SOURCE_INELIGIBLE")])
def test_readiness_tiers(spark, change, expected):
    df = spark.createDataFrame([tuple((FACTS | change).values())], ", ".join(f"{k} long" for k in FACTS))
    assert datasets.readiness(df).first().readiness == expected


@pytest.mark.parametrize(("price", "quantity"), [("25", 40), ("300", 3), ("1000", 1), ("333.333333333333333333", 3), ("1001", 0)])
def test_sizing(spark, price, quantity):
    r = trading.sized(spark.createDataFrame([(D(price),)], "price decimal(38,18)")).first()
    assert (r.quantity, r.intent_status) == (quantity, "CREATED" if quantity else "REJECTED")


def test_fills_and_average_costs(spark):
    o = spark.createDataFrame([(str(n), n) for n in (1, 2, 3, 40, 41)], "order_id string, quantity long")
    found = {}
    for r in trading.split_fills(o).orderBy("fill_sequence").collect():
        found.setdefault(int(r.order_id), []).append(r.quantity)
    assert found == {1: [1], 2: [1, 1], 3: [1, 2], 40: [20, 20], 41: [20, 21]}
    f = spark.createDataFrame([("k", 1, 10, D(100)), ("k", 2, 5, D(130))], "k string, n int, quantity long, price decimal(38,18)")
    assert [r.average_cost for r in exact.fold_positions(f, ["k"], ["n"]).orderBy("position_version").collect()] == [D(100), D(110)]
    assert trading.running_positions(f.withColumn("price", F.col("price").cast("double")), ["k"], "n").orderBy("n").collect()[1].average_cost == 110.0


@pytest.mark.parametrize(("price", "hours", "reasons"), [("95", 1, ["STOP_LOSS"]), ("95.000000000000000001", 1, []), ("110", 1, ["TAKE_PROFIT"]), ("109.999999999999999999", 5, []), ("100", 6, ["TIME_EXIT"]), ("94.99", 7, ["STOP_LOSS", "TIME_EXIT"])])
def test_exits(spark, price, hours, reasons):
    df = spark.createDataFrame([(D(100), D(price), datetime(2026, 1, 1), datetime(2026, 1, 1, hours))], "average_cost_price decimal(30,18), current_price decimal(30,18), opened_at timestamp, snapshot_observed_at timestamp")
    assert trading.position_exits(df).first().reasons == reasons


def test_three_transient_failures_open_the_circuit(spark):
    raw = ["TRANSIENT", "TRANSIENT", "READY", "TRANSIENT", "NO_CALENDAR", "TRANSIENT", "TRANSIENT", "READY"]
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(raw, 1)], "run_id string, ordinal int, raw string")
    found = [(r.item_outcome, r.reason) for r in runs.attempted(df).orderBy("ordinal").collect()]
    assert found[-1] == ("NOT_ATTEMPTED_ABORTED", "TRANSIENT_FAILURE_CIRCUIT_OPEN") and [x for x, _ in found[:-1]] == ["PROVIDER_ERROR", "PROVIDER_ERROR", "READY", "PROVIDER_ERROR", "CALENDAR_ERROR", "PROVIDER_ERROR", "PROVIDER_ERROR"]


def test_canonical_texts(spark):
    df = spark.createDataFrame([(D("100.500000000000000000"), D("0E-18"), datetime(2026, 1, 1, 23), datetime(2026, 1, 1, 23, 0, 0, 5), " aapl ")], "a decimal(38,18), z decimal(38,18), t timestamp, u timestamp, s string")
    r = df.select(canonical.plain_decimal(F.col("a")).alias("a"), canonical.plain_decimal(F.col("z")).alias("z"), canonical.rfc3339(F.col("t")).alias("t"), canonical.rfc3339(F.col("u")).alias("u"), canonical.normal_symbol(F.col("s")).alias("s"), canonical.fixed_decimal(F.col("a"), 2).alias("f")).first()
    assert tuple(r) == ("100.5", "0", "2026-01-01T23:00:00Z", "2026-01-01T23:00:00.000005Z", "AAPL", "100.50")
    assert canonical.leaking_columns(["close", "Label", "Future_Return"]) == ["Label", "Future_Return"]
    m = spark.createDataFrame([({"API-Token": "x", "n": "1"},)], "m map<string,string>").select(canonical.redacted(F.col("m")).alias("m")).first().m
    assert m == {"API-Token": "<redacted>", "n": "1"}


def test_percentages(spark):
    df = spark.createDataFrame([(1, 3), (0, 0), (3, 3)], "a long, b long").select(datasets.percentage(F.col("a"), F.col("b")).alias("p"))
    assert [r.p for r in df.collect()] == ["33.333333", "ZERO_DENOMINATOR", "100.000000"]


def test_create_or_get_and_guarded_moves(spark):
    kd = "key string, content string"
    found = pit.create_or_get(spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], kd), spark.createDataFrame([("a", "1"), ("b", "2")], kd), "key", "content")
    assert {r.key: r.status for r in found.collect()} == {"a": "ALREADY_EXISTS", "b": "CONFLICT", "c": "CREATED"}
    state = spark.createDataFrame([(1, 1, "ACCEPTED")], "order_id int, version int, status string")
    asked = spark.createDataFrame([(1, "ACCEPTED", 1, "FILLED"), (1, "ACCEPTED", 1, "PARTIALLY_FILLED"), (2, "ACCEPTED", 1, "FILLED")], "order_id int, expected_status string, expected_version int, to_status string")
    assert rows(pit.guarded_transition(state, asked, "order_id").select("order_id", "to_status", "result", "version"), "order_id", "to_status") == [(1, "FILLED", "APPLIED", 2), (1, "PARTIALLY_FILLED", "OPTIMISTIC_CONFLICT", None), (2, "FILLED", "NOT_FOUND", None)]


def test_pages_end_and_do_not_repeat():
    assert list(sources.fetch_pages(lambda t: ("b", None if t else "x"))) == ["b", "b"]
    with pytest.raises(ValueError):
        list(sources.fetch_pages(lambda t: ("b", "x")))


def test_a_store_appends_and_looks_up(spark, tmp_path):
    path = str(tmp_path / "bars")
    sources.append(bars(spark, 3), path)
    new, counts = sources.ingest(bars(spark, 5), spark.read.parquet(path), ["bar_key"])
    assert {r.status: r.bars for r in counts.collect()} == {"ALREADY_EXISTS": 3, "CREATED": 2}
    sources.append(new.select(*bars(spark, 1).columns), path)
    assert sources.lookup(spark, path, symbol="AAPL").count() == 5


def test_zero_prices_make_classified_rows_and_no_failure(spark):
    day = datetime(2026, 1, 5)
    bar = lambda i, low, close: ("S", "A", "SPLIT_ADJUSTED", (day + timedelta(i)).date(), close, max(close, 1.0), low, close, 5, day + timedelta(i, hours=23), f"b{i}")
    names = "source_code string, symbol string, adjustment_basis string, session_date date, open_price double, high_price double, low_price double, close_price double, volume long, available_at timestamp, bar_key string"
    b = spark.createDataFrame([bar(0, 1.0, 1.0), bar(1, 0.0, 0.0), bar(2, 1.0, 2.0), bar(3, 1.0, 3.0)], names)
    problems = {r.bar_key: r.p for r in b.select("bar_key", sources.bar_problem().alias("p")).collect()}
    assert problems == {"b0": None, "b1": "NONPOSITIVE_PRICE", "b2": None, "b3": None} and sources.sound_bars(b).count() == 3
    item = lambda k, i, close: (k, "S", "A", "SPLIT_ADJUSTED", (day + timedelta(i)).date(), close, True, True, day)
    items = spark.createDataFrame([item("zero", 1, 0.0), item("over a zero", 0, 1.0), item("fine", 2, 2.0)], "item_id string, source_code string, symbol string, adjustment_basis string, session_date date, reference_close double, eligible boolean, chain_valid boolean, scored_at timestamp")
    c = cal.trading_sessions(spark).where("family = 'NYSE_CORE'")
    found = {r.item_id: (r.outcome, r.return_rate) for r in outcomes.forward_outcomes(items, b, c, 1, F.lit("2026-02-01").cast("timestamp")).collect()}
    assert found == {"zero": ("FUTURE_BAR_CONTRACT_INVALID", None), "over a zero": ("FUTURE_BAR_CONTRACT_INVALID", None), "fine": ("OUTCOME_CREATED", 0.5)}
    sized = trading.sized(spark.createDataFrame([(0.0,), (None,), (-1.0,), (10.0,)], "price double")).collect()
    assert [(r.quantity, r.intent_status) for r in sized] == [(0, "REJECTED")] * 3 + [(100, "CREATED")]
    p = spark.createDataFrame([(0.0, 1.0, day, day)], "average_cost_price double, current_price double, opened_at timestamp, snapshot_observed_at timestamp")
    assert trading.position_exits(p).first().return_rate is None
    flat = bars(spark, 21).withColumn("close_price", F.lit(0.0)).withColumn("open_price", F.lit(0.0)).withColumn("low_price", F.lit(0.0))
    last = technical_features(flat).orderBy(F.desc("session_date")).first()
    assert last.one_day_return is None and last.atr14_rate is None and last.quality_status == "READY"


def test_answers_are_refused_by_name(spark):
    import json

    meta = {"symbol": "a ", "interval": "1day", "currency": "USD", "mic_code": "XNYS", "exchange": "NYSE", "exchange_timezone": "America/New_York"}
    value = {"datetime": "2024-01-03", "open": "1.5", "high": "2", "low": "1", "close": "2", "volume": "7"}
    good = {"status": "ok", "meta": meta, "values": [value, value | {"datetime": "2024-01-02"}, value | {"datetime": "2024-01-09"}]}
    cases = {
        "good": (good, None), "status": (good | {"status": "error"}, "PROVIDER_REJECTED_REQUEST"), "no json": ("x", "PROVIDER_REJECTED_REQUEST"), "meta": (good | {"meta": meta | {"interval": "1h"}}, "RESPONSE_SCHEMA_INVALID"),
        "currency": (good | {"meta": meta | {"currency": "EUR"}}, "RESPONSE_SCHEMA_INVALID"), "values": (good | {"values": None}, "RESPONSE_SCHEMA_INVALID"), "twice": (good | {"values": [value, value]}, "RESPONSE_VALUE_INVALID"),
        "date": (good | {"values": [value | {"datetime": "2024-1-3"}]}, "RESPONSE_VALUE_INVALID"), "zero": (good | {"values": [value | {"low": "0"}]}, "RESPONSE_VALUE_INVALID"), "word": (good | {"values": [value | {"open": "x"}]}, "RESPONSE_VALUE_INVALID"),
        "order": (good | {"values": [value | {"high": "1.4"}]}, "RESPONSE_VALUE_INVALID"), "volume": (good | {"values": [value | {"volume": "-1"}]}, "RESPONSE_VALUE_INVALID"), "none": (good | {"values": []}, None),
    }
    rows = [(k, "A", "XNYS", date(2024, 1, 5), datetime(2024, 1, 6), json.dumps(body) if isinstance(body, dict) else body) for k, (body, _) in cases.items()]
    asked = spark.createDataFrame(rows, "name string, symbol string, mic_code string, cutoff date, observed_at timestamp, body string")
    assert {r.name: r.problem for r in sources.read_time_series(asked).collect()} == {k: p for k, (_, p) in cases.items()}
    found = sources.parse_time_series(asked, 1).collect()
    assert [(r.session_date, r.close_price, r.volume, r.source_record_key) for r in found] == [(date(2024, 1, 3), D(2), None, "XNYS.A.20240103.SPLITS")]
    raw = sources.parse_time_series(asked.where("name = 'good'"), 5, "RAW").orderBy("session_date").collect()
    assert [(r.session_date.day, r.volume) for r in raw] == [(2, 7), (3, 7)]
    with pytest.raises(ValueError):
        sources.parse_time_series(asked, 5001)
    page = {"symbol": "A", "bars": [{"t": "2024-01-03T05:00:00Z", "o": 1.5, "h": 2, "l": 1, "c": 2, "v": 3}, {"t": "2024-01-04T04:59:59Z", "o": 1.5, "h": 2, "l": 1, "c": 2, "v": 3}]}
    later = page | {"bars": [page["bars"][0], page["bars"][1] | {"t": "2024-01-04T05:00:00Z"}]}
    rows = [(k, "A", "XNYS", date(2024, 1, 5), datetime(2024, 1, 6), json.dumps(p)) for k, p in {"twice": page, "good": later, "other": later | {"symbol": "B"}}.items()]
    pages = spark.createDataFrame(rows, asked.schema)
    assert {r.name: r.problem for r in sources.read_pages(pages).collect()} == {"twice": "RESPONSE_VALUE_INVALID", "good": None, "other": "RESPONSE_SCHEMA_INVALID"}
    assert [r.session_date.day for r in sources.parse_pages(pages).orderBy("session_date").collect()] == [3, 4]


def test_places_run_over_the_whole_table_and_disorder_is_found(spark):
    data = [(date(2024, 1, d), "r", k, "XNYS", s, f"{d}{k}{s}") for d in (3, 2, 9) for k in (2, 1) for s in "ba"]
    df = spark.createDataFrame(data, "source_session_date date, scoring_run_id string, source_rank int, mic_code string, symbol string, outcome_id string").repartition(3)
    made = pit.numbered(df, "dataset", [])
    assert [r.outcome_id for r in made.orderBy("ordinal").collect()] == [x[-1] for x in sorted(data)] and [r.ordinal for r in made.orderBy("ordinal").collect()] == list(range(1, 13))
    assert datasets.order_violations(made).count() == 0 and datasets.order_violations(made.limit(0)).count() == 0
    o = F.col("ordinal")
    assert {r.rule: r.rows for r in datasets.order_violations(made.withColumn("ordinal", F.when(o == 5, 6).when(o == 6, 5).otherwise(o))).collect()} == {"OUT_OF_ORDER": 1}
    assert {r.rule for r in datasets.order_violations(made.withColumn("ordinal", F.when(o == 12, 11).otherwise(o))).collect()} == {"REPEATED_ORDINAL", "NOT_FROM_1_TO_N"}


def test_uuids_calendars_and_nested_texts(spark):
    import uuid

    names = ["urn:a:client-order:v1:1", "", "é", None]
    found = [r.u for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(canonical.uuid5_url(F.col("n")).alias("u")).collect()]
    assert found == [None if n is None else str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    with pytest.raises(ValueError):
        cal.resolve("US_EQUITY_CORE", "latest")
    with pytest.raises(ValueError):
        cal.sessions_between(spark, date(2025, 12, 31), date(2026, 1, 5), version="2026.v1")
    assert cal.count_violations(cal.trading_sessions(spark)).count() == 0
    assert canonical.redact({"a": [{"Bearer-x": 1, "b": ({"dsn": 2},)}], "CANO": None}) == {"a": [{"Bearer-x": "<redacted>", "b": [{"dsn": "<redacted>"}]}], "CANO": "<redacted>"}
    texts = spark.createDataFrame([('{"token": 1, "x": [1]}',), ("no json",), (None,)], "t string").select(canonical.redacted_json(F.col("t")).alias("r")).collect()
    assert [r.r for r in texts] == ['{"token":"<redacted>","x":[1]}', None, None]
    with pytest.raises(ValueError):
        canonical.record_key("bar", x=F.lit(1))
