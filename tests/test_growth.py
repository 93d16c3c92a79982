"""Steps that large tables go through: what is read once stays read once, and no run or parent gathers in a task."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.operators import datasets, scoring
from tidemark.sources.bars import line_order

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_listings_of_a_candidate_read_their_rows_once(spark):
    for name in ("decision_listing", "evaluation_listing"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution()
        assert plan.optimizedPlan().toString().count("Relation [") == 1 and "Join" not in plan.optimizedPlan().toString(), name


def test_fills_and_decisions_come_from_one_written_table(spark):
    for name in ("fill_violations", "decision_sources"):
        assert scans(catalog.QUERIES[name](spark, SF)) == 0, name


def test_midranks_of_many_ties_and_runs_as_by_hand(spark):
    r = random.Random(5)
    given = [(run, k, r.choice([None, 0.0, -0.0, 0.0, 0.5, r.random(), r.random()])) for run in ("a", "b", None) for k in range(700)]
    df = spark.createDataFrame(given, "run string, k int, v double")
    found = {(x.run, x.k): x.p for x in scoring.midrank_percentile(df, "v", ["run"], "p").collect()}
    assert len(found) == len(given)
    for run in ("a", "b", None):
        values = [v for g, _, v in given if g == run and v is not None]
        for g, k, v in given:
            if g == run:
                want = None if v is None else (sum(x < v for x in values) + (values.count(v) - 1) / 2) / (len(values) - 1)
                assert found[(g, k)] == (want if want is None else pytest.approx(want, abs=1e-12))


def test_ranks_of_a_run_lie_on_several_tasks(spark):
    r = random.Random(6)
    given = [("a", f"S{k}", r.choice(["XNYS", "XNGS"]), r.choice(["READY", "DEGRADED"]), *(float(r.randrange(40)) for _ in range(3))) for k in range(900)]
    df = spark.createDataFrame(given, "run_id string, symbol string, mic_code string, quality_status string, overall_score double, momentum_score double, trend_score double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = scoring.ranked(df).select("symbol", "rank", F.spark_partition_id().alias("at")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = sorted(given, key=lambda x: (x[3] != "READY", -x[4], -x[5], -x[6], x[2], x[1]))
    assert [x.symbol for x in sorted(found, key=lambda x: x.rank)] == [x[1] for x in order] and {x.rank for x in found} == set(range(1, 901))
    assert len({x.at for x in found}) > 1


def test_passing_is_told_without_the_codes_that_block(spark):
    for name in ("position_events_currency", "trade_intents"):
        assert "HARD_FAIL" not in catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString(), name
    made = catalog.QUERIES["filter_evaluations"](spark, SF)
    assert made.where("passed <> (blocking = '')").count() == 0 and made.where("not passed").count() > 0


def test_items_and_their_snapshots_share_one_pass_of_features(spark):
    for name in ("prepared_scoring_items", "scoring_run_status"):
        assert scans(catalog.QUERIES[name](spark, SF)) == 0, name


def test_records_for_prices_alone_make_and_judge_their_values_once(spark):
    for name in ("price_only_reasons", "price_only_eligibility"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("map(one_day_return") == 1 and plan.count("RLIKE") == 1, name


def test_reasons_against_prices_alone_as_by_hand(spark):
    r = random.Random(9)
    texts = ["0", "-0", "1.5", "-2", "1.50", "01", "1e3", "", None, "0.001", "-0.5", "7."]
    sound = re.compile(r"(0|-?(0|[1-9][0-9]*)(\.[0-9]*[1-9])?)")
    given = []
    for k in range(400):
        values = {c: r.choice(texts) if r.random() < 0.04 else "1.25" for c in datasets.PRICE_FEATURES if r.random() > 0.02}
        values |= {"other": "x"} if r.random() < 0.3 else {}
        given.append((k, "v1", "READY", [], None if k % 50 == 0 else values | {"adjustment_basis": "SPLIT_ADJUSTED", "completed_bar_count": "21"}))
    df = spark.createDataFrame(given, "k int, feature_set string, feature_quality_status string, quality_reason_codes array<string>, feature_values map<string,string>")
    found = {x.k: x.reason for x in df.select("k", datasets.price_only_reason().alias("reason")).collect()}
    for k, _, _, _, values in given:
        prices = None if values is None else [values[c] for c in datasets.PRICE_FEATURES if c in values]
        want = "FEATURE_LINEAGE_UNAVAILABLE" if values is None else "PRICE_FEATURE_MISSING" if len(prices) < len(datasets.PRICE_FEATURES) else None
        if want is None and not all(v is not None and v != "-0" and sound.fullmatch(v) for v in prices):
            want = "PRICE_FEATURE_INVALID"
        assert found[k] == want, values
    assert len(set(found.values())) == 4


def test_lines_are_in_the_order_of_their_columns(spark):
    given = [(o, n, p, q, c) for o in (1, 2, 10**11) for n in (1, 7, 10, 12) for p in (1, 2, 10**10) for q in (1.0, 50.0, 999.0) for c in (0.29, 1.15, 99_999.99)]
    random.Random(1).shuffle(given)
    df = spark.createDataFrame(given, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double")
    assert [tuple(x) for x in df.orderBy(line_order()).collect()] == sorted(given)
