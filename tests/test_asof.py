"""As-of joins by row, the store by month, windows of days and audits of levels against plain computations."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, datasets
from tidemark.operators.features import day_windows
from tidemark.sources.store import MONTH, append_months, ingest_months, stored_months, with_month
from tidemark.streaming.bars import append_new, read_bars

BARS = "source_code string, symbol string, adjustment_basis string, session_date date, available_at timestamp, bar_key string, close_price double"
ASKED = "request_id long, source_code string, symbol string, adjustment_basis string, asked_at timestamp, session_date date"
START = datetime(2024, 1, 1)


def bar(symbol, day, hours, key, close=1.0):
    return ("S", symbol, "A", None if day is None else (START + timedelta(days=day)).date(), None if hours is None else START + timedelta(hours=hours), key, close)


def asked(k, symbol, hours, day=None):
    return (k, "S", symbol, "A", None if hours is None else START + timedelta(hours=hours), None if day is None else (START + timedelta(days=day)).date())


def plain(requests, bars, same_session=False):
    made = {}
    for k, s, symbol, a, at, day in requests:
        seen = [b for b in bars if at and symbol is not None and b[1] == symbol and b[4] is not None and b[4] <= at and (not same_session or (day is not None and b[3] == day))]
        made[k] = max(seen, key=lambda b: (b[3], b[4], b[5]))[5] if seen else None
    return made


def found(spark, requests, bars, **more):
    made = asof.known_at(spark.createDataFrame(requests, ASKED), spark.createDataFrame(bars, BARS), columns=("close_price",), **more)
    rows = made.collect()
    assert len(rows) == len(requests)
    return {r.request_id: r.known.bar_key if r.known else None for r in rows}


@pytest.mark.parametrize("period", ["day", "month", "year"])
def test_random_series_with_a_hot_one_and_late_revisions(spark, period):
    r = random.Random(8)
    pick = lambda: "HOT" if r.random() < 0.4 else f"S{r.randrange(5)}"
    bars = [bar(pick(), d := r.randrange(120), 24 * d + r.choice([23, 23, 71, 2000]), f"k{n}") for n in range(500)]
    requests = [asked(n, pick(), r.randrange(-100, 5000), r.randrange(120)) for n in range(400)]
    requests += [asked(1000 + n, b[1], (b[4] - START).total_seconds() / 3600, (b[3] - START.date()).days) for n, b in enumerate(bars[:100])]  # at the very time
    assert found(spark, requests, bars, period=period) == plain(requests, bars)
    assert found(spark, requests, bars, period=period, keys=(*asof.SERIES, "session_date")) == plain(requests, bars, True)


def test_nulls_ties_and_empty_tables(spark):
    bars = [bar("A", 1, 30, "a1"), bar("A", 1, 30, "a2"), bar("A", 0, 40, "late"), bar(None, 1, 30, "n"), bar("A", 2, None, "never"), bar("B", None, 30, "b")]
    requests = [asked(1, "A", 30), asked(2, "A", 29), asked(3, None, 50), asked(4, "A", None), asked(5, "C", 50), asked(6, "A", 5000)]
    assert found(spark, requests, bars) == {1: "a2", 2: None, 3: None, 4: None, 5: None, 6: "a2"}
    assert found(spark, [], bars) == {}
    assert found(spark, requests[:1], []) == {1: None}
    twice = asof.known_at(spark.createDataFrame([requests[0]] * 3, ASKED), spark.createDataFrame(bars + bars, BARS), columns=("close_price",))
    assert [r.known.bar_key for r in twice.collect()] == ["a2"] * 3


def test_last_sessions(spark):
    r = random.Random(2)
    bars = [bar(f"S{r.randrange(3)}", d := r.randrange(60), 24 * d + r.choice([23, 71, 900]), f"k{n}", float(n)) for n in range(300)]
    requests = [asked(n, f"S{r.randrange(4)}", r.randrange(2500)) for n in range(200)] + [asked(900, None, 5), asked(901, "S1", None)]
    made = asof.sessions_known_at(spark.createDataFrame(requests, ASKED).drop("session_date"), spark.createDataFrame(bars, BARS), 4, columns=("close_price",), period="week")
    theirs = sorted((x.request_id, x.position, x.session_date, x.bar_key) for x in made.collect())
    expected = []
    for k, _, symbol, _, at, _ in requests:
        known = {}
        for b in sorted((b for b in bars if at and b[1] == symbol and b[4] <= at), key=lambda b: (b[4], b[5])):
            known[b[3]] = b[5]
        expected += [(k, n, day, known[day]) for n, day in enumerate(sorted(known)[-4:], 1)]
    assert theirs == sorted(expected)


def test_no_range_join_and_one_row_a_request(spark):
    bars, requests = spark.createDataFrame([bar("A", 1, 30, "a")], BARS), spark.createDataFrame([asked(1, "A", 30)], ASKED)
    plan = asof.known_at(requests, bars, columns=("close_price",))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


STORED = "bar_key string, source_code string, symbol string, session_date date, available_at timestamp, close_price double"


def rows(*given):
    return [(k, "S", k[0], None if m is None else date(2026, m, d), datetime(2026, m or 1, d, h), p) for k, m, d, h, p in given]


def counts(df):
    return {(r[MONTH], r.status): r.bars for r in df.collect()}


def test_ingest_reads_the_months_of_its_batch_alone(spark, tmp_path):
    path = str(tmp_path / "store")
    first = spark.createDataFrame(rows(("a1", 1, 1, 1, 1.0), ("a2", 2, 1, 1, 2.0), ("a1", 1, 1, 2, 9.0), ("a9", None, 1, 1, 0.0)), STORED)
    assert counts(ingest_months(first, path)) == {("2026-01", "CREATED"): 1, ("2026-01", "ALREADY_EXISTS"): 1, ("2026-02", "CREATED"): 1, (None, "NO_SESSION_DATE"): 1}
    again = spark.createDataFrame(rows(("a2", 2, 1, 1, 7.0), ("b1", 2, 3, 1, 3.0)), STORED)
    assert counts(ingest_months(again, path)) == {("2026-02", "ALREADY_EXISTS"): 1, ("2026-02", "CREATED"): 1}
    assert counts(ingest_months(again, path)) == {("2026-02", "ALREADY_EXISTS"): 2}
    assert sorted((r.bar_key, r.close_price) for r in spark.read.parquet(path).collect()) == [("a1", 1.0), ("a2", 2.0), ("b1", 3.0)]
    plan = stored_months(spark, path, with_month(again))._jdf.queryExecution().executedPlan().toString()
    pushed = next(x for x in plan.split("\n") if "PartitionFilters" in x)
    assert "2026-02" in pushed[pushed.index("PartitionFilters") :]
    assert stored_months(spark, path, with_month(again)).select("symbol").inputFiles() and {r[MONTH] for r in stored_months(spark, path, with_month(again)).collect()} == {"2026-02"}


def test_many_months_and_an_empty_batch(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    monkeypatch.setattr("tidemark.sources.store.MOST_NAMED", 2)
    many = spark.createDataFrame(rows(*((f"k{m}", m, 1, 1, 1.0) for m in range(1, 8))), STORED)
    append_months(many.where("bar_key <> 'k4'"), path)
    assert sum(n for (_, s), n in counts(ingest_months(many, path)).items() if s == "CREATED") == 1
    assert counts(ingest_months(many.limit(0), path)) == {}


def test_a_stream_into_the_store_by_month(spark, tmp_path):
    inbox, store, state = (str(tmp_path / x) for x in ("inbox", "store", "state"))
    for batch in (rows(("a1", 1, 1, 1, 1.0), ("a2", 2, 1, 1, 2.0)), rows(("a2", 2, 1, 1, 9.0), ("b1", 3, 3, 1, 3.0))):
        spark.createDataFrame(batch, STORED).coalesce(1).write.mode("append").parquet(inbox)
        append_new(read_bars(spark, inbox, STORED), store, state).awaitTermination()
    append_new(read_bars(spark, inbox, STORED), store, str(tmp_path / "lost")).awaitTermination()  # all of it once more
    assert sorted((r.bar_key, r.close_price) for r in spark.read.parquet(store).collect()) == [("a1", 1.0), ("a2", 2.0), ("b1", 3.0)]
    assert (tmp_path / "store" / "source_code=S" / "session_month=2026-03").exists()


def test_windows_of_days_over_gaps(spark):
    days = {1: (10.0, 12.0, 8.0), 2: (20.0, 30.0, 15.0), 9: (None, 50.0, 40.0), 40: (5.0, 6.0, 4.0)}
    bars = [("S", s, "A", date(2024, 1, 1) + timedelta(days=d), h, low, c) for s in ("X", "Y") for d, (c, h, low) in days.items()]
    made = day_windows(spark.createDataFrame(bars, "source_code string, symbol string, adjustment_basis string, session_date date, high_price double, low_price double, close_price double"), (7, 30))
    got = {(r.symbol, (r.session_date - date(2024, 1, 1)).days): r for r in made.collect()}
    for s in ("X", "Y"):
        assert [(got[s, d].gap_days, got[s, d].sessions_7d, got[s, d].mean_close_7d, got[s, d].prior_high_7d, got[s, d].prior_low_7d) for d in days] == [
            (None, 1, 10.0, None, None), (1, 2, 15.0, 12.0, 8.0), (7, 1, None, 30.0, 15.0), (31, 1, 5.0, None, None)]
        assert [(got[s, d].sessions_30d, got[s, d].prior_high_30d) for d in days] == [(1, None), (2, 12.0), (3, 30.0), (1, None)]
    assert day_windows(made.select("source_code", "symbol", "adjustment_basis", "session_date", "high_price", "low_price", "close_price").limit(0)).count() == 0


LINEAGE = "provider_code string, source_session_date date, horizon int, feature_quality_status string, quality_reason_codes array<string>, exclusion_reason string, symbol string, pipeline_outcome string"


def test_levels_of_an_audit(spark):
    r = random.Random(1)
    given = [(r.choice(["A", "B", None]), r.choice([date(2024, 1, 1), date(2024, 1, 2), None]), r.choice([1, 3]), r.choice(["READY", "DEGRADED"]), r.choice([[], ["VOLUME_DATA_INCOMPLETE"], None]), r.choice([None, "X"]), f"S{r.randrange(9)}", "READY") for _ in range(300)]
    records = spark.createDataFrame(given, LINEAGE)
    made = datasets.audit_levels(records).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    by = lambda level: sorted([x for x in made if x.level == level], key=lambda x: key((x.provider_code, x.source_session_date, x.horizon)))
    providers = {x.provider_code: x for x in datasets.provider_distribution(records).collect()}
    assert {(x.provider_code, x.total, x.ready, x.degraded, x.volume_incomplete, x.included) for x in by("PROVIDER")} == {(p, x.total, x.ready, x.degraded, x.volume_incomplete, x.included) for p, x in providers.items()}
    for level, columns in (("SESSION", ["source_session_date"]), ("HORIZON", ["horizon"]), ("PROVIDER_SESSION", ["provider_code", "source_session_date"]), ("TOTAL", [])):
        alone = records.groupBy(*columns).agg(F.count(F.lit(1)).alias("total"), F.countDistinct("symbol").alias("symbols")).collect()
        assert sorted(((*(x[c] for c in columns), x.total, x.symbols) for x in by(level)), key=key) == sorted(((*(x[c] for c in columns), x.total, x.symbols) for x in alone), key=key)
    assert datasets.audit_levels(records.limit(0)).collect() == []


def test_sums_before_over_ranges_and_hot_keys(spark):
    from tidemark.operators.pit import summed_before

    r = random.Random(3)
    given = [("hot" if r.random() < 0.5 else r.choice(["a", "b", None]), n, r.randrange(5)) for n in range(3000)]
    df = spark.createDataFrame(given, "k string, n int, x long").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # all ranges, so that keys span them
    try:
        found = {(x.k, x.n): (x.before, x.whole) for x in summed_before(df, ["k"], ["n"], "x").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total, whole = {}, {}
    for k, _, x in given:
        whole[k] = whole.get(k, 0) + x
    for k, n, x in given:
        assert found[k, n] == (total.get(k, 0), whole[k])
        total[k] = total.get(k, 0) + x
    assert len(found) == len(given) and summed_before(df.limit(0), ["k"], ["n"], "x").count() == 0


def test_last_sessions_of_a_series_on_many_ranges(spark):
    r = random.Random(4)
    bars = [bar("HOT" if r.random() < 0.9 else "B", d := r.randrange(200), 24 * d + r.choice([23, 71, 900, 3000]), f"k{n}", float(n)) for n in range(1500)]
    requests = [asked(n, r.choice(["HOT", "HOT", "B", "NONE"]), r.randrange(8000)) for n in range(900)]
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16", "spark.sql.execution.arrow.maxRecordsPerBatch": "40"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        made = asof.sessions_known_at(spark.createDataFrame(requests, ASKED).drop("session_date"), spark.createDataFrame(bars, BARS), 5, columns=("close_price",))
        rows = made.select("request_id", "position", "session_date", "available_at", "bar_key", "close_price", F.spark_partition_id().alias("at")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    expected = []
    for k, _, symbol, _, at, _ in requests:
        known = {}
        for b in sorted((b for b in bars if b[1] == symbol and b[4] <= at), key=lambda b: (b[4], b[5])):
            known[b[3]] = (b[4], b[5], b[6])
        expected += [(k, n, day, *known[day]) for n, day in enumerate(sorted(known)[-5:], 1)]
    assert sorted(x[:6] for x in rows) == sorted(expected)
    hot = {x[0] for x in requests if x[2] == "HOT"}
    assert len({x["at"] for x in rows if x.request_id in hot}) > 4  # before, one month of a series lay in one task


def test_last_sessions_read_their_rows_once(spark):
    made = asof.sessions_known_at(spark.createDataFrame([asked(1, "A", 40)], ASKED), spark.createDataFrame([bar("A", 1, 30, "a"), bar("A", None, 31, "none")], BARS), 5, columns=("close_price",))
    assert [(x.position, x.bar_key) for x in made.collect()] == [(1, "a")]
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "Exchange" not in plan
