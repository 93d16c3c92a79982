"""Streams, table rules, reports, and a store of bars."""

import json
from datetime import date, datetime

from pyspark.sql import functions as F

from tidemark.plans.tables import TABLES, changed_since_written, orphans, violations
from tidemark.sources import bars as sources
from tidemark.sources.reports import write_reports
from tidemark.streaming.bars import append_new, daily_counts, read_bars

SCHEMA = "bar_key string, source_code string, symbol string, available_at timestamp, close_price double"


def some(spark, *rows):
    return spark.createDataFrame([(k, "S", k[0], datetime(2026, 1, day, 23), price) for k, day, price in rows], SCHEMA)


def test_a_stream_of_revisions_appends_each_identity_once(spark, tmp_path):
    inbox, store, state = (str(tmp_path / x) for x in ("inbox", "store", "state"))
    some(spark, ("a1", 1, 1.0), ("a2", 2, 2.0), ("a1", 1, 1.0)).coalesce(1).write.parquet(inbox)
    append_new(read_bars(spark, inbox, SCHEMA), store, state).awaitTermination()
    some(spark, ("a2", 2, 9.0), ("b1", 3, 3.0)).coalesce(1).write.mode("append").parquet(inbox)
    append_new(read_bars(spark, inbox, SCHEMA), store, state).awaitTermination()
    assert sorted((r.bar_key, r.close_price) for r in spark.read.parquet(store).collect()) == [("a1", 1.0), ("a2", 2.0), ("b1", 3.0)]


def test_days_are_counted_behind_the_watermark(spark, tmp_path):
    inbox = str(tmp_path / "inbox")
    some(spark, ("a1", 1, 1.0), ("b1", 1, 1.0), ("a2", 20, 2.0)).coalesce(1).write.parquet(inbox)
    query = daily_counts(read_bars(spark, inbox, SCHEMA)).writeStream.format("memory").queryName("days").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.bars, r.symbols) for r in spark.table("days").collect()] == [(2, 2)]


def test_tables_name_what_their_rows_break(spark):
    assert len(TABLES) == 25 and all(t.schema.fields and all(set(k) <= set(t.schema.fieldNames()) for k in t.keys) for t in TABLES.values())
    bad = spark.createDataFrame([("o1", "i1", "c1", "ACCEPTED", 0, None), ("o2", "i1", "c2", "LOST", 1, None)], TABLES["paper_orders"].schema)
    assert {r.rule: r.rows for r in violations(bad, "paper_orders").collect()} == {"version > 0": 1, "status in ('ACCEPTED', 'PARTIALLY_FILLED', 'FILLED', 'REJECTED')": 1, "unique (intent_id)": 1}
    for name, table in TABLES.items():
        assert violations(spark.createDataFrame([], table.schema), name).count() == 0
    assert [r.order_id for r in orphans(bad, spark.createDataFrame([("i2",)], "intent string"), "intent_id", "intent").collect()] == ["o1", "o2"]


def test_keys_and_digests_are_verified_on_reading(spark):
    rows = [("UNIT_SOURCE", "bar-000", "v1", "AAPL", "USD", "SPLIT_ADJUSTED", date(2026, 1, 1), datetime(2026, 1, 1, 22), datetime(2026, 1, 1, 23), 99.5, 102.0, 98.0, 100.0, 1000)]
    names = "source_code string, record string, version string, symbol string, currency string, adjustment_basis string, session_date date, observed_at timestamp, available_at timestamp, open_price double, high_price double, low_price double, close_price double, volume long"
    df = sources.content_digest(spark.createDataFrame(rows, names)).withColumn("key", sources.bar_key(F.col("source_code"), F.col("record"), F.col("version")))
    import hashlib

    text = '{"adjustment_basis":"SPLIT_ADJUSTED","available_at":"2026-01-01T23:00:00Z","close":"100","currency":"USD","high":"102","low":"98","observed_at":"2026-01-01T22:00:00Z","open":"99.5","session_date":"2026-01-01","symbol":"AAPL","volume":1000}'
    row = df.first()
    assert row.content_digest == hashlib.sha256(text.encode()).hexdigest()
    assert row.key == "daily-market-bar:v1:" + hashlib.sha256(b'{"source_code":"UNIT_SOURCE","source_record_key":"bar-000","source_version":"v1"}').hexdigest()
    later = sources.content_digest(df.withColumnRenamed("content_digest", "stored").withColumn("close_price", F.lit(101.0)))
    assert changed_since_written(later, "content_digest", "stored").count() == 1


def test_reports_are_replaced_whole(tmp_path):
    first = write_reports(str(tmp_path), "Readiness", {"facts": {"items": 3}, "blockers": ["A"]})
    assert first == write_reports(str(tmp_path), "Readiness", {"blockers": ["A"], "facts": {"items": 3}})
    assert json.loads((tmp_path / "report.json").read_text())["facts"]["items"] == 3 and "| items | 3 |" in (tmp_path / "report.md").read_text()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["SHA256SUMS", "report.json", "report.md"]


def test_exact_snapshots_have_the_known_key_and_digest(spark):
    from datetime import timedelta
    from decimal import Decimal

    from tidemark.operators.exact import feature_snapshots

    rows = []
    for i in range(21):
        close, at = Decimal(100 + i), datetime(2026, 1, 1, 23) + timedelta(i)
        rows.append(("UNIT_SOURCE", f"bar-{i:03d}", "v1", "AAPL", "USD", "SPLIT_ADJUSTED", date(2026, 1, 1) + timedelta(i), at - timedelta(hours=1), at, close - Decimal("0.5"), close + 2, close - 2, close, 1000 + 10 * i))
    names = "source_code string, source_record_key string, source_version string, symbol string, currency string, adjustment_basis string, session_date date, observed_at timestamp, available_at timestamp, open_price decimal(38,18), high_price decimal(38,18), low_price decimal(38,18), close_price decimal(38,18), volume long"
    bars = sources.content_digest(spark.createDataFrame(rows, names).repartition(3))
    found = feature_snapshots(bars, datetime(2027, 1, 1, 23), 3).first()
    assert found.snapshot_key == "feature-snapshot:v1:e71831fdd8f47692183dc623651999be70458e4d19fe50415af2d4118f5e60d0"
    assert found.content_digest == "fccd188eb3200bc40113f77f0056d8b78335653ca02af769df507e3dbd94155a"
    assert feature_snapshots(bars.limit(20), datetime(2027, 1, 1, 23), 3).count() == 0


def test_a_batch_is_written_and_shuffled_by_identity_once(spark, tmp_path, monkeypatch):
    from tidemark.sources import store

    kept = []
    monkeypatch.setattr(store, "written", lambda df: kept.append(df) or df.localCheckpoint())
    rows = spark.createDataFrame([("S", f"A|{k}", f"2024-0{1 + k % 3}-0{1 + k % 9}", k) for k in range(40)], "source_code string, bar_key string, day string, available_at int")
    rows = rows.selectExpr("source_code", "'A' AS symbol", "bar_key", "to_date(day) AS session_date", "available_at").localCheckpoint()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for n, batch in enumerate((rows.where("available_at < 20"), rows), 1):
            made = store.ingest_months(batch, str(tmp_path / "months")).groupBy("status").agg({"bars": "sum"}).collect()
            assert len(kept) == n and dict(map(tuple, made)) == ({"CREATED": 20} if n == 1 else {"CREATED": 20, "ALREADY_EXISTS": 20})
        assert kept[-1]._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # the batch's and the store's
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def _bars(spark, n=400):
    rows = spark.range(n).selectExpr("'S' AS source_code", "'A' AS symbol", "concat('A|', id) AS bar_key", "date_add(date'2024-01-01', cast(id % 90 as int)) AS session_date", "cast(id as int) AS available_at")
    return rows.localCheckpoint()


def test_an_ingest_writes_no_row_besides_the_store_and_keeps_no_shuffle(spark, tmp_path, monkeypatch):
    from tidemark.sources import store

    rows, path, setting = _bars(spark), str(tmp_path / "months"), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept, plans, append, before = [], [], store.append_months, spark.conf.get(setting)
    monkeypatch.setattr(store, "written", lambda df: kept.append(df.localCheckpoint()) or kept[-1])
    monkeypatch.setattr(store, "append_months", lambda df, path: plans.append((df._jdf.queryExecution().executedPlan().toString(), spark.conf.get(setting))) or append(df, path))
    for batch, found in ((rows.where("available_at < 100"), {"CREATED": 100}), (rows, {"CREATED": 300, "ALREADY_EXISTS": 100}), (rows, {"ALREADY_EXISTS": 400})):
        assert dict(map(tuple, store.ingest_months(batch, path).groupBy("status").agg({"bars": "sum"}).collect())) == found
    assert len(kept) == 3 and max(k.count() for k in kept) <= 6  # months and statuses alone, no bars
    assert all(p.count("Exchange hashpartitioning") == 1 and "Join" not in p and on == "true" for p, on in plans)  # batch and store together
    assert len(plans) == 3 and spark.conf.get(setting) == before
    assert sorted(r.bar_key for r in spark.read.parquet(path).collect()) == sorted(r.bar_key for r in rows.collect())


def test_an_ingest_by_parts_stores_the_same(spark, tmp_path, monkeypatch):
    from tidemark.sources import store

    jobs, append = [], store.append_months
    monkeypatch.setattr(store, "append_months", lambda df, path: jobs.append(df.rdd.getNumPartitions()) or append(df, path))
    monkeypatch.setattr(store, "MOST_SHUFFLED", 150)
    monkeypatch.setattr(store, "MOST_COMPARED", 10)
    rows = _bars(spark)
    # an identity in two months, one without a date and one without a key: the first by order of each stays
    odd = spark.sql("select * from values ('S', 'A', 'B|1', date'2024-02-01', 2), ('S', 'A', 'B|1', date'2024-01-01', 1), ('S', 'A', 'B|2', cast(null as date), 1), ('S', 'A', 'B|2', date'2024-01-01', 2), ('S', 'A', null, date'2024-01-01', 5) t(source_code, symbol, bar_key, session_date, available_at)")
    path, batch = str(tmp_path / "months"), rows.unionByName(rows.where("available_at < 50")).unionByName(odd)
    total = lambda made: {r.status: r.bars for r in made.groupBy("status").agg(F.sum("bars").alias("bars")).collect()}
    assert total(store.ingest_months(batch, path)) == {"CREATED": 403, "ALREADY_EXISTS": 51, "NO_SESSION_DATE": 1}
    assert jobs == [12] * 4  # 455 rows, of which 150 at once and 10 a task
    assert total(store.ingest_months(batch, path)) == {"ALREADY_EXISTS": 454, "NO_SESSION_DATE": 1}
    stored = {(r.bar_key, str(r.session_date)) for r in spark.read.parquet(path).where("bar_key is null or bar_key like 'B%'").collect()}
    assert stored == {("B|1", "2024-01-01"), ("B|2", "2024-01-01"), (None, "2024-01-01")}
    assert spark.read.parquet(path).count() == 403


def test_an_empty_first_batch_leaves_a_store_that_takes_the_next(spark, tmp_path):
    from tidemark.sources.store import ingest_months

    rows, path = _bars(spark), str(tmp_path / "months")
    assert ingest_months(rows.limit(0), path).collect() == []
    assert {r.status for r in ingest_months(rows, path).collect()} == {"CREATED"} and spark.read.parquet(path).count() == 400


def test_monthly_ingest_makes_bars_by_parts_of_suppliers(spark, monkeypatch):
    import duckdb

    from tidemark.plans import market_queries

    made, revisions = [], sources.lineitem_revisions
    monkeypatch.setattr(market_queries, "MOST_LINES", 500)
    monkeypatch.setattr(market_queries.sources, "lineitem_revisions", lambda lines: made.append(lines.count()) or revisions(lines))
    d = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{d}/lineitem.parquet'")
    theirs = sorted(map(tuple, duck.execute(market_queries.ORACLE_SQL["monthly_ingest"]).fetchall()))
    assert sorted(map(tuple, market_queries.monthly_ingest(spark, d).collect())) == theirs
    assert len(made) > 1 and sum(made) == spark.read.parquet(f"{d}/lineitem.parquet").count()
