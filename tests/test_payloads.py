"""Payloads of open shape, sketches that merge, and operators as SQL."""

import json
import random
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.functions import payloads
from tidemark.operators import outcomes, pit, sketches
from tidemark.plans.sql_functions import register

SHAPE = {"a": "STRING", "b?": {"c": "BIGINT", "d": ["STRING"]}, "e": [{"f": "BIGINT|DOUBLE|DECIMAL"}]}


def kind(x):
    return {str: "STRING", bool: "BOOLEAN", int: "BIGINT", float: "DECIMAL", type(None): "VOID", dict: "OBJECT", list: "ARRAY"}[type(x)]


def plain(x, shape, path="$"):
    if isinstance(shape, str):
        return [] if kind(x) in shape.split("|") else [(path, "WRONG_KIND", kind(x))]
    if not isinstance(x, type(shape)):
        return [(path, "WRONG_KIND", kind(x))]
    if isinstance(shape, list):
        return [y for v in x for y in plain(v, shape[0], path + "[]")]
    names = {k.removesuffix("?"): k for k in shape}
    found = [(f"{path}.{k}", "UNKNOWN_MEMBER", kind(v)) for k, v in x.items() if k not in names]
    for name, key in names.items():
        if name in x:
            found += plain(x[name], shape[key], f"{path}.{name}")
        elif not key.endswith("?"):
            found.append((f"{path}.{name}", "MISSING_MEMBER", None))
    return found


def test_findings_are_those_of_a_walk(spark):
    r = random.Random(1)

    def any_value(depth=0):
        pick = r.randrange(8 if depth < 3 else 5)
        if pick == 5 or pick == 6:
            return {k: any_value(depth + 1) for k in r.sample("abcdef", r.randrange(4))}
        return [any_value(depth + 1) for _ in range(r.randrange(3))] if pick == 7 else ["x", 3, 2.5, None, True][pick]

    def near():
        return {"a": r.choice(["x", 1]), "b": r.choice([{"c": 1, "d": ["s", r.choice(["t", 4])]}, [], {"d": None}]), "e": [{"f": r.choice([1, 2.5, "x"])} for _ in range(3)] + r.choice([[], [7], [{}]])}

    values = [r.choice([any_value, near])() for _ in range(300)] + [{"a": "x", "e": []}]
    bodies = [(json.dumps(v),) for v in values] + [("{broken",), (None,), ("",)]
    df = spark.createDataFrame(bodies, "body string")
    found = [plain(v, SHAPE) for v in values] + [[("$", "NOT_JSON", None)]] * 3
    assert Counter(tuple(sorted(map(str, (tuple(f) for f in row.findings)))) for row in payloads.with_findings(df, SHAPE).collect()) == Counter(tuple(sorted(map(str, f))) for f in found)
    places, holders = Counter(x for f in found for x in f), Counter(x for f in found for x in set(f))
    assert {(x.path, x.finding, x.kind): (x.bodies, x.places) for x in payloads.drift_report(df, SHAPE).collect()} == {k: (holders[k], places[k]) for k in places}
    assert payloads.drift_report(df.limit(0), SHAPE).count() == 0


def test_a_series_answer_with_members_that_were_not_agreed(spark):
    good = {"status": "ok", "meta": dict.fromkeys(["symbol", "interval", "currency", "mic_code", "exchange", "exchange_timezone", "type"], "x"), "values": [{"datetime": "d", "open": "1", "high": "1", "low": "1", "close": "1", "volume": "1"}]}
    odd = json.loads(json.dumps(good)) | {"paging": {"next": 1}}
    odd["values"] += [{"datetime": "d", "open": 1, "high": "1", "low": "1", "vwap": "1"}]
    df = spark.createDataFrame([(json.dumps(good),), (json.dumps(odd),)], "body string")
    assert {(r.path, r.finding, r.kind) for r in payloads.drift_report(df, payloads.SERIES_SHAPE).collect()} == {
        ("$.paging", "UNKNOWN_MEMBER", "OBJECT"), ("$.values[].open", "WRONG_KIND", "BIGINT"), ("$.values[].close", "MISSING_MEMBER", None), ("$.values[].vwap", "UNKNOWN_MEMBER", "STRING")}


def test_sketches_merge_to_those_of_the_union(spark):
    rows = spark.range(60_000).select((F.col("id") % 7).alias("run"), (F.col("id") % 20_000).alias("k"), F.when(F.col("id") % 10 != 0, F.pmod(F.xxhash64("id"), F.lit(1000)) / 10).alias("x"))
    distinct, quantiles, at = {"keys": "k"}, {"xs": "x"}, {"xs": (0.0, 0.25, 0.5, 0.99)}
    by_run = sketches.run_sketches(rows, ["run"], distinct, quantiles)
    merged = sketches.estimates(sketches.merged(by_run, [], ["keys"], ["xs"]), [], ["keys"], at)
    union = sketches.estimates(sketches.merged(sketches.run_sketches(rows.withColumn("run", F.lit(0)), ["run"], distinct, quantiles), [], ["keys"], ["xs"]), [], ["keys"], at)
    get = lambda df: {(r.name, r.at): r.estimate for r in df.collect()}
    a, b = get(merged), get(union)
    assert a["keys", None] == b["keys", None]  # the registers of the union are those of all rows
    assert abs(a["keys", None] - 20_000) <= 20_000 * sketches.DISTINCT_BOUND and all(abs(a["xs", q] - 100 * q) <= 4 for q in at["xs"])
    judged = sketches.within_bound(rows, merged, [], distinct, quantiles).collect()
    assert len(judged) == 5 and all(r.within for r in judged)
    judged = sketches.within_bound(rows, sketches.estimates(by_run, ["run"], ["keys"], at), ["run"], distinct, quantiles).collect()
    assert len(judged) == 35 and all(r.within for r in judged)
    wrong = merged.withColumn("estimate", F.col("estimate") * 1.5 + 3)
    assert not any(r.within for r in sketches.within_bound(rows, wrong, [], distinct, quantiles).where("name = 'keys' or at between 0.1 and 0.6").collect())


def test_sketches_of_nulls_and_nothing(spark):
    rows = spark.createDataFrame([("a", None, None), ("b", 1, 2.0), (None, 1, 2.0)], "run string, k long, x double")
    made = sketches.estimates(sketches.run_sketches(rows, ["run"], {"keys": "k"}, {"xs": "x"}), ["run"], ["keys"], {})
    assert {r.run: r.estimate for r in made.collect()} == {"a": 0.0, "b": 1.0, None: 1.0}
    assert sketches.run_sketches(rows.limit(0), ["run"], {"keys": "k"}, {"xs": "x"}).count() == 0


def test_sql_functions_are_the_operators(spark):
    r = random.Random(9)
    sessions = cal.trading_sessions(spark, date(2024, 1, 1), date(2024, 3, 31)).where("family = 'NYSE_CORE'")
    days = [x[0] for x in sessions.orderBy("session_date").select("session_date").collect()]
    bars = []
    for s in ("A", "B", None):
        for n, d in enumerate(days[:30]):
            for k in range(r.choice([0, 1, 1, 2])):
                c = r.uniform(5, 15)
                bars.append(("S", s, "X", d, datetime(d.year, d.month, d.day) + timedelta(hours=r.choice([23, 23, 500])), f"{s}{n}{k}", c, c + 1, c - 1, c))
    bars = spark.createDataFrame(bars, "source_code string, symbol string, adjustment_basis string, session_date date, available_at timestamp, bar_key string, open_price double, high_price double, low_price double, close_price double")
    items = [("S", s, "X", f"{s}{n}", d, r.choice([10.0, 0.0, 10.0]), r.random() < 0.9, r.random() < 0.9, datetime(2024, 1, 1)) for s in ("A", "B") for n, d in enumerate([*days[:28], date(2024, 1, 6)])]
    items = spark.createDataFrame(items, "source_code string, symbol string, adjustment_basis string, item_id string, session_date date, reference_close double, eligible boolean, chain_valid boolean, scored_at timestamp")
    register(spark, bars, items, sessions, "t_")
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    for text in ("2024-01-10 12:00:00", "2024-02-20 00:00:00", "2020-01-01 00:00:00"):
        at = F.lit(text).cast("timestamp")
        known = pit.known_bars(bars, at)
        assert same(spark.sql(f"SELECT * FROM t_bars_known_at(TIMESTAMP '{text}')"), known.select(*bars.columns))
        last = pit.latest_sessions(bars, at, 3)
        assert same(spark.sql(f"SELECT * FROM t_last_sessions(TIMESTAMP '{text}', 3)"), last.select(*bars.columns, "position"))
        for horizon in (1, 3):
            made = outcomes.forward_outcomes(items, bars, sessions, horizon, at, 900).where("outcome = 'OUTCOME_CREATED'").select("item_id", "terminal_date", "return_rate", "mfe_rate", "mae_rate", "latest_input_available_at")
            assert same(spark.sql(f"SELECT * FROM t_outcomes_of_horizon(TIMESTAMP '{text}', {horizon}, 900)"), made)
    assert spark.sql("SELECT * FROM t_bars_known_at(NULL)").count() == 0


@pytest.mark.parametrize("text", ["2024-01-10 12:00:00"])
def test_filters_on_a_function_reach_below_it(spark, text):
    plan = spark.sql(f"SELECT close_price FROM t_bars_known_at(TIMESTAMP '{text}') WHERE symbol = 'A'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("symbol") and "LateralJoin" not in plan and "lateral" not in plan.lower()
