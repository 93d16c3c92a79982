"""Paged services read on executors: pages in order, tokens that come twice, sessions that repeat, what is not there."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import bars as sources
from tidemark.sources.pages import FolderService, PagedSource, read_service, write_service

PAGES = "symbol string, token string, body string"


def page(symbol, token, following, *days, named=None, high=3.0):
    bars = [{"t": f"2024-01-{d:02d}T12:00:00Z", "o": 2.0, "h": high, "l": 1.0, "c": 2.5, "v": d} for d in days]
    return (symbol, token, json.dumps({"symbol": named or symbol, "bars": bars, "next_page_token": following}))


def asked(df):
    return df.select("*", F.lit("XNYS").alias("mic_code"), F.to_date(F.lit("2024-01-20")).alias("cutoff"), F.lit("2024-02-01").cast("timestamp").alias("observed_at"))


def answers(spark, path, **more):
    return {r.symbol: (r.problem, [str(b.session_date)[-2:] for b in r._bars]) for r in sources.read_paged(asked(read_service(spark, path, **more))).collect()}


@pytest.fixture
def service(spark, tmp_path):
    rows = [
        page("GOOD", None, "b", 2, 3), page("GOOD", "b", "c", 4, 5), page("GOOD", "c", None, 8, 25), page("ONE", None, None, 2), page("NONE", None, None),
        page("LOOP", None, "b", 2), page("LOOP", "b", "b", 3), page("TWICE", None, "b", 2, 3), page("TWICE", "b", None, 3, 4), page("WITHIN", None, None, 2, 2), page("LOST", None, "x", 2),
        page("OTHER", None, "b", 2), page("OTHER", "b", None, 3, named="X"), page("FIRST", None, "b", 2, 3), page("FIRST", "b", "c", 3), page("FIRST", "c", "b", 4, named="X"), ("BROKEN", None, "{no json"), page("PRICE", None, "b", 2), page("PRICE", "b", "b", 3, high=0.5),
    ]
    path = str(tmp_path / "service")
    write_service(spark.createDataFrame(rows, PAGES), path)
    return path


def test_answers_of_symbols(spark, service):
    found = answers(spark, service)
    assert found["GOOD"] == (None, ["02", "03", "04", "05", "08", "25"]) and found["ONE"] == (None, ["02"]) and found["NONE"] == (None, [])
    assert {k: v[0] for k, v in found.items() if v[0]} == {
        "LOOP": "PAGINATION_INVALID", "TWICE": "RESPONSE_VALUE_INVALID", "WITHIN": "RESPONSE_VALUE_INVALID", "LOST": "NO_DATA", "OTHER": "RESPONSE_SCHEMA_INVALID", "FIRST": "RESPONSE_VALUE_INVALID",
        "BROKEN": "RESPONSE_SCHEMA_INVALID", "PRICE": "RESPONSE_VALUE_INVALID"}  # of two faults the one of the earlier page


def test_bars_are_the_last_up_to_the_cutoff(spark, service):
    made = sources.parse_paged(asked(read_service(spark, service)), keep=3)
    assert sorted((r.symbol, r.session_date.day) for r in made.collect()) == [("GOOD", 4), ("GOOD", 5), ("GOOD", 8), ("ONE", 2)]


def test_symbols_asked_for_and_too_many_pages(spark, service):
    pages = read_service(spark, service, ["GOOD", "GOOD", "UNKNOWN"])
    assert pages.rdd.getNumPartitions() == 2
    few = read_service(spark, service, symbols_per_task=5)
    assert few.rdd.getNumPartitions() == 3 and sorted(map(str, few.collect())) == sorted(map(str, read_service(spark, service).collect()))
    assert sorted((r.symbol, r.page, r.problem) for r in pages.collect()) == [("GOOD", 0, None), ("GOOD", 1, None), ("GOOD", 2, None), ("UNKNOWN", 0, "NO_DATA")]
    assert answers(spark, service, symbols=["GOOD", "ONE"], most_pages=2) == {"GOOD": ("PAGINATION_INVALID", ["02", "03", "04", "05"]), "ONE": (None, ["02"])}
    assert read_service(spark, service + "-not-there").count() == 0
    assert FolderService("file:" + service).symbols() == FolderService("file://" + service).symbols() != []


def test_another_service(spark):
    class Counted(PagedSource):
        @classmethod
        def name(cls):
            return "counted_pages"

        def service(self):
            class Answers:
                def symbols(self):
                    return ["A", "B"]

                def fetch(self, symbol, token):
                    at = int(token or 0)
                    return f"{symbol}{at}", str(at + 1) if at < 2 else None

            return Answers()

    assert sorted((r.symbol, r.page, r.body) for r in read_service(spark, "", source=Counted).collect()) == [(s, k, f"{s}{k}") for s in "AB" for k in range(3)]


def test_a_service_of_many_symbols_makes_few_folders_and_tasks(spark, tmp_path):
    import os

    path, n = str(tmp_path / "many"), 5_000
    ids = spark.range(n).select(F.concat(F.lit("é/"), "id").alias("symbol"), F.lit(None).cast("string").alias("token"), F.lit('{"bars": []}').alias("body"))
    write_service(ids.unionByName(ids.limit(1).withColumn("symbol", F.lit(None).cast("string"))), path)
    pages = read_service(spark, path)
    assert sum(len(folders) for _, folders, _ in os.walk(path)) < 10 and pages.rdd.getNumPartitions() < 10
    assert {r.symbol for r in pages.collect()} == {f"é/{k}" for k in range(n)} | {None} and pages.where("problem is not null").count() == 0
    asked_for = read_service(spark, path, ["é/7", "é/4999", "lost"])
    assert sorted((r.symbol, r.problem) for r in asked_for.collect()) == [("lost", "NO_DATA"), ("é/4999", None), ("é/7", None)]
