"""Forward outcomes of streams: revisions as late bars come in, and paths as a join of scored items with their later bars."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from datetime import date

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.outcomes import future_sessions

SERIES = ("source_code", "symbol", "adjustment_basis")
_REVISION = "source_code string, symbol string, adjustment_basis string, item_id string, revision int, outcome string, path_digest string, return_rate double, mfe_rate double, mae_rate double, latest_input long"
_MADE = Row(*(c.split()[0] for c in _REVISION.split(", ")))
_EPOCH = date(1970, 1, 1).toordinal()


def feed(items: DataFrame, bars: DataFrame, calendar: DataFrame, horizon: int, made_at: str = "made_at") -> DataFrame:
    """One stream of items (with the sessions that they look ahead to) and bars, by the time at which each became known.

    Items of a day that is no session, or that look past the calendar's end, are left out.
    """
    ahead = future_sessions(items, calendar, horizon).where("known and covered")
    asked = ahead.select(*SERIES, F.col(made_at).alias("at"), "item_id", "session_date", "reference_close", F.to_json("expected").alias("expected"))
    came = bars.select(*SERIES, F.col("available_at").alias("at"), "session_date", "bar_key", *(F.col(f"{c}_price").alias(c) for c in ("high", "low", "close")))
    return asked.unionByName(came, allowMissingColumns=True)


class PathRevisions(StatefulProcessor):
    """State of a series: its open items with their last path, and the latest revision of each of its recent bars.

    A call needs all of it, so it is one text: it is read and written once a call, however many items and bars it holds. One
    timer a series waits for what expires first.
    """

    def __init__(self, keep_days: int):
        self.keep_days = keep_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.series = handle.getValueState("series", "held string")

    def close(self) -> None:
        pass

    def _gone(self, session: str) -> int:
        """When what belongs to a session expires, in milliseconds."""
        return (date.fromisoformat(session).toordinal() - _EPOCH + self.keep_days) * 86_400_000

    def _held(self) -> tuple[dict, dict, int | None]:
        """Items (reference_close, expected sessions, digest, revision), bars (at, bar_key, high, low, close), and the time of the timer."""
        held = self.series.get()
        return tuple(json.loads(held[0])) if held else ({}, {}, None)

    def _hold(self, items: dict, bars: dict, timer: int | None) -> None:
        if not items and not bars:
            self.series.clear()
            return
        first = min(self._gone(day) for day in (*(x[1][-1] for x in items.values()), *bars))
        if timer is None or first < timer:
            self.handle.registerTimer(first)
            timer = first
        self.series.update((json.dumps([items, bars, timer], separators=(",", ":"), ensure_ascii=False),))

    def _revised(self, key, item_id: str, item: list, bars: dict) -> Row | None:
        """The next revision of an item, if its path is whole and not the one that it had."""
        reference, expected, digest, revision = item
        path = [bars.get(day) for day in expected]
        if None in path:
            return None
        now = hashlib.sha256(json.dumps([b[1] for b in path], separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
        if now == digest:
            return None
        item[2:] = [now, revision + 1]
        sound = reference is not None and reference > 0 and all(x is not None and x > 0 for b in path for x in b[2:])
        rates = [path[-1][4] / reference - 1, max(b[2] for b in path) / reference - 1, min(b[3] for b in path) / reference - 1] if sound else [None] * 3
        ordered = sound and rates[2] <= rates[0] <= rates[1]
        return _MADE(*key, item_id, revision + 1, "OUTCOME_CREATED" if ordered else "FUTURE_BAR_CONTRACT_INVALID", now, *(rates if ordered else [None] * 3), max(b[0] for b in path))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        came = sorted(rows, key=lambda r: (r.at, r.item_id is None, r.bar_key is None, r.bar_key or ""))  # of one series in one batch
        items, bars, timer = self._held()
        wanting: dict[str, list[str]] = {}
        for k, item in items.items():
            for day in item[1]:
                wanting.setdefault(day, []).append(k)
        moved = False
        for row in came:
            if row.item_id is None:
                new = [row.at, row.bar_key, row.high, row.low, row.close]
                session = row.session_date
                if session in bars and bars[session][:2] >= new[:2]:
                    continue  # it came before, or a later revision did
                bars[session] = new
                asked = wanting.get(session, ())
            else:
                if row.item_id in items:
                    continue
                items[row.item_id] = [row.reference_close, json.loads(row.expected), "", 0]
                for day in items[row.item_id][1]:
                    wanting.setdefault(day, []).append(row.item_id)
                asked = (row.item_id,)
            moved = True
            for k in asked:
                if revised := self._revised(key, k, items[k], bars):
                    yield revised
        if moved:
            self._hold(items, bars, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # All that is behind the watermark goes at once, for a timer in the past would wait for the next batch.
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        items, bars, _ = self._held()
        for k in [k for k, item in items.items() if self._gone(item[1][-1]) <= now]:
            if not items.pop(k)[3]:
                yield _MADE(*key, k, 0, "FUTURE_BARS_INCOMPLETE", None, None, None, None, None)
        for day in [day for day in bars if self._gone(day) <= now]:
            del bars[day]
        self._hold(items, bars, None)


def outcome_revisions(stream: DataFrame, late: str = "10 days", keep_days: int = 60) -> DataFrame:
    """Revisions of outcomes from a stream of ``feed``: a new one whenever the path of an item gets whole or is corrected.

    (series, item_id, revision from 1, outcome, path_digest, rates, latest_input_available_at). Rows of one batch are
    taken in the order of their times, so a bar that is corrected twice makes two revisions; a row that comes again makes
    none, and one that is older than what is known of its session changes nothing. The greatest revision of an item is the
    outcome that all rows so far would give at once. Rows more than ``late`` behind the latest one are dropped. Items and
    bars go ``keep_days`` after their (last) session, which bounds the state; an item that never had a whole path leaves a
    row of revision 0, FUTURE_BARS_INCOMPLETE. The state needs the session's state store to be RocksDB: see ``run``.
    """
    keyed = stream.withWatermark("at", late).withColumn("_us", F.unix_micros("at"))
    rows = keyed.select(*SERIES, F.col("at").alias("_event"), F.col("_us").alias("at"), "item_id", F.col("session_date").cast("string").alias("session_date"), "reference_close", "expected", "bar_key", "high", "low", "close")
    made = rows.groupBy(*SERIES).transformWithState(PathRevisions(keep_days), _REVISION, "append", "eventtime")
    return made.withColumn("latest_input", F.timestamp_micros("latest_input")).withColumnRenamed("latest_input", "latest_input_available_at")


def paths(items: DataFrame, bars: DataFrame, calendar: DataFrame, horizon: int, late: str = "5 days", reach_days: int = 20, made_at: str = "made_at") -> DataFrame:
    """The bars that each item looks ahead to, as a join of two streams: a row for each revision of each expected session.

    Items count by ``made_at``, bars by available_at; both may come ``late``. A bar joins an item that was made at most
    ``reach_days`` before it, so rows of either side leave the state when the slower watermark has passed that time, and
    an item waits for its bars no longer. ``operators.outcomes.outcomes_of_paths`` takes the latest revision a session.
    """
    ahead = future_sessions(items, calendar, horizon).where("eligible and chain_valid and known and covered")
    wanted = ahead.select("item_id", *SERIES, "reference_close", F.col(made_at).alias("_made_at"), F.explode("expected").alias("session_date")).withWatermark("_made_at", late)
    came = bars.select(*(F.col(c).alias(f"_{c}") for c in (*SERIES, "session_date")), "available_at", "bar_key", "open_price", "high_price", "low_price", "close_price").withWatermark("available_at", late)
    same = (F.col("available_at") >= F.col("_made_at")) & (F.col("available_at") <= F.col("_made_at") + F.make_dt_interval(days=F.lit(reach_days)))
    for c in (*SERIES, "session_date"):
        same = same & (F.col(c) == F.col(f"_{c}"))
    return wanted.join(came, same).drop(*(f"_{c}" for c in (*SERIES, "session_date")), "_made_at")


_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


def run(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts the stream into a Parquet folder, each row once, with a state that lies on disk beside the checkpoint.

    A batch writes what it changed in the state and not all of it, and a join keeps one store a partition instead of four.
    A checkpoint that an earlier stream began keeps the form of its join.
    """
    spark: SparkSession = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
