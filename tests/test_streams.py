"""Outcome streams against the answer at once: late corrections, replays, expiry and a bounded state."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators import outcomes
from tidemark.streaming import outcomes as streams

ITEMS = "source_code string, symbol string, adjustment_basis string, item_id string, session_date date, reference_close double, made_at timestamp, eligible boolean, chain_valid boolean, scored_at timestamp"
BARS = "source_code string, symbol string, adjustment_basis string, session_date date, available_at timestamp, bar_key string, open_price double, high_price double, low_price double, close_price double"


def at(day, hours=0):
    return datetime(day.year, day.month, day.day) + timedelta(hours=hours)


def item(symbol, day, close=10.0):
    return ("S", symbol, "A", f"{symbol}|{day}", day, close, at(day, 22), True, True, at(day, 22))


def bar(symbol, day, hours=23, close=11.0, mark=""):
    return ("S", symbol, "A", day, at(day, hours), f"{symbol}|{day}{mark}", close, None if close is None else close + 1, None if close is None else close - 1, close)


class Feed:
    """Rows that come batch by batch to one stream, which starts anew for each."""

    def __init__(self, spark, tmp_path, make):
        self.spark, self.make = spark, make
        self.items, self.bars, self.out, self.state = (str(tmp_path / x) for x in ("items", "bars", "out", "state"))
        self.query = None

    def send(self, items=(), bars=()):
        for rows, schema, path in ((items, ITEMS, self.items), (bars, BARS, self.bars)):
            self.spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(path)
        read = lambda path, schema: self.spark.readStream.schema(schema).parquet(path)
        self.query = streams.run(self.make(read(self.items, ITEMS), read(self.bars, BARS)), self.out, self.state)
        self.query.awaitTermination()

    def rows(self):
        return self.spark.read.parquet(self.out)

    def held(self):
        return sum(x["numRowsTotal"] for x in self.query.lastProgress["stateOperators"])


@pytest.fixture
def calendar(spark):
    return cal.trading_sessions(spark, date(2024, 1, 1), date(2024, 12, 31)).where("family = 'NYSE_CORE'")


def sessions(spark, first, last):
    return [r[0] for r in cal.trading_sessions(spark, first, last).where("family = 'NYSE_CORE'").orderBy("session_date").select("session_date").collect()]


def test_corrections_make_revisions_and_replays_make_none(spark, tmp_path, calendar):
    feed = Feed(spark, tmp_path, lambda i, b: streams.outcome_revisions(streams.feed(i, b, calendar, 2), late="30 days", keep_days=90))
    d = sessions(spark, date(2024, 1, 2), date(2024, 1, 12))
    first = [bar("A", d[1]), bar("A", d[2], close=12.0)]
    feed.send([item("A", d[0]), item("A", date(2024, 1, 6)), item("B", d[0], 0.0), item("A", d[3])], [*first, bar("B", d[1]), bar("B", d[2])])
    feed.send([item("A", d[0])], first)  # all of it again
    feed.send([], [bar("A", d[1], 70, 5.0, "|2"), bar("A", d[1], 60, 7.0, "|late"), bar("A", d[2], 90, 20.0, "|2")])
    feed.send([], [bar("A", d[1], 65, 6.0, "|older")])  # older than what is known
    got = sorted((r.item_id, r.revision, r.outcome, None if r.return_rate is None else round(r.return_rate, 6), r.latest_input_available_at) for r in feed.rows().collect())
    a, b = f"A|{d[0]}", f"B|{d[0]}"
    assert got == [
        (a, 1, "OUTCOME_CREATED", 0.2, at(d[2], 23)), (a, 2, "OUTCOME_CREATED", 0.2, at(d[1], 60)), (a, 3, "OUTCOME_CREATED", 0.2, at(d[1], 70)), (a, 4, "OUTCOME_CREATED", 1.0, at(d[2], 90)),
        (b, 1, "FUTURE_BAR_CONTRACT_INVALID", None, at(d[2], 23)),
    ]


def test_last_revisions_are_the_answer_at_once_in_any_order(spark, tmp_path, calendar):
    r = random.Random(4)
    d = sessions(spark, date(2024, 2, 1), date(2024, 3, 15))
    items = [item(s, day, r.uniform(5, 15)) for s in "ABC" for day in d[:-5] if r.random() < 0.8]
    bars = [bar(s, day, 23, r.uniform(5, 15)) for s in "ABC" for day in d if r.random() < 0.9]
    bars += [(*b[:4], b[4] + timedelta(hours=r.choice([30, 60])), b[5] + "|2", *(x * 1.1 for x in b[6:])) for b in bars if r.random() < 0.3]
    r.shuffle(bars)
    feed = Feed(spark, tmp_path, lambda i, b: streams.outcome_revisions(streams.feed(i, b, calendar, 3), late="90 days", keep_days=200))
    half = len(bars) // 2
    feed.send(items[::2], bars[:half])
    feed.send(items[1::2], bars[half:])
    last = feed.rows().groupBy("item_id").agg(F.max_by(F.struct("return_rate", "mfe_rate", "mae_rate", "latest_input_available_at"), "revision").alias("x")).select("item_id", "x.*")
    whole = outcomes.forward_outcomes(spark.createDataFrame(items, ITEMS), spark.createDataFrame(bars, BARS), calendar, 3, F.lit(datetime(2024, 6, 1)))
    rows = lambda df: sorted((x.item_id, round(x.return_rate, 9), round(x.mfe_rate, 9), round(x.mae_rate, 9), x.latest_input_available_at) for x in df.collect())
    assert rows(last) == rows(whole.where("outcome = 'OUTCOME_CREATED'")) and feed.rows().where("revision > 1").count() > 0


def test_items_and_bars_expire(spark, tmp_path, calendar):
    feed = Feed(spark, tmp_path, lambda i, b: streams.outcome_revisions(streams.feed(i, b, calendar, 2), late="1 day", keep_days=5))
    d = sessions(spark, date(2024, 3, 4), date(2024, 4, 30))
    feed.send([item("A", d[0]), item("B", d[0])], [bar("A", d[1]), bar("A", d[2]), bar("B", d[1])])
    feed.send([], [bar("A", d[20])])
    feed.send([], [bar("A", d[21])])
    feed.send([], [bar("A", d[1], 30, 9.0, "|2")])  # behind the watermark
    got = sorted((r.item_id, r.revision, r.outcome) for r in feed.rows().collect())
    assert got == [(f"A|{d[0]}", 1, "OUTCOME_CREATED"), (f"B|{d[0]}", 0, "FUTURE_BARS_INCOMPLETE")]


def test_a_series_is_one_row_of_state_and_lets_go_of_all_that_is_past(spark, tmp_path, calendar):
    feed = Feed(spark, tmp_path, lambda i, b: streams.outcome_revisions(streams.feed(i, b, calendar, 2), late="1 day", keep_days=5))
    d = sessions(spark, date(2024, 3, 4), date(2024, 4, 30))
    feed.send([item("A", day) for day in d[:9]] + [item("B", day) for day in d[:9]], [bar("A", day) for day in d[:9]])
    assert feed.held() <= 6  # not a row for each item, bar and session
    feed.send([], [bar("C", d[35])])
    feed.send([], [bar("C", d[36])])  # one batch behind a watermark that passed all sessions at once
    got = [(r.item_id, r.revision) for r in feed.rows().collect()]
    assert sorted(k for k, n in got if n == 0) == sorted([f"A|{d[7]}", f"A|{d[8]}", *(f"B|{day}" for day in d[:9])])
    assert sorted(k for k, n in got if n == 1) == [f"A|{day}" for day in d[:7]]


def test_paths_of_two_streams_and_their_state(spark, tmp_path, calendar):
    d = sessions(spark, date(2024, 1, 2), date(2024, 7, 31))
    items, bars = [item(s, day) for s in "AB" for day in d[:-4]], [bar(s, day, 23, 10.0 + n % 3) for s in "AB" for n, day in enumerate(d)]
    bars += [bar("A", d[5], 40, 99.0, "|2"), bar(None, d[5]), bar("C", d[5])]
    feed, held = Feed(spark, tmp_path, lambda i, b: streams.paths(i, b, calendar, 3, late="2 days", reach_days=10)), []
    for k in range(4):
        part = lambda rows, n: [x for x in rows if d.index(x[4] if n else x[3]) * 4 // len(d) == k]  # noqa: E731, B023
        feed.send(part(items, True), part(bars, False))
        held.append(feed.held())
    from tidemark.operators.pit import first_of

    asked = outcomes.future_sessions(spark.createDataFrame(items, ITEMS), calendar, 3)
    paths = first_of(feed.rows(), ["item_id", "session_date"], F.desc("available_at"), F.desc("bar_key"))
    made = outcomes.outcomes_of_paths(asked, paths, 3, F.lit(True))
    whole = outcomes.forward_outcomes(spark.createDataFrame(items, ITEMS), spark.createDataFrame(bars, BARS), calendar, 3, F.lit(datetime(2025, 1, 1)))
    assert sorted(map(str, made.collect())) == sorted(map(str, whole.collect()))
    assert made.where("outcome = 'OUTCOME_CREATED'").count() == len(items)
    assert held[-1] < 4 * len(items) * 0.6 and held[-1] < 1.5 * held[0]  # it does not grow with what has passed


def test_empty_streams(spark, tmp_path, calendar):
    feed = Feed(spark, tmp_path, lambda i, b: streams.outcome_revisions(streams.feed(i, b, calendar, 2)))
    feed.send()
    assert spark.read.schema("item_id string").parquet(feed.out).count() == 0


def test_a_join_keeps_one_store_a_partition_and_writes_what_changed(spark, tmp_path, calendar):
    d = sessions(spark, date(2024, 1, 2), date(2024, 2, 15))
    feed = Feed(spark, tmp_path, lambda i, b: streams.paths(i, b, calendar, 3))
    feed.send([item("A", day) for day in d[:6]], [bar("A", day) for day in d[:3]])
    feed.send([], [bar("A", day) for day in d[3:9]])
    assert feed.rows().count() == 18
    stores = [p for p in (tmp_path / "state" / "state" / "0").iterdir() if p.name.isdigit()]
    assert stores and not [x for p in stores for x in p.iterdir() if x.is_dir() and "keyTo" in x.name]
    assert [x for p in stores for x in p.glob("*.changelog")]
