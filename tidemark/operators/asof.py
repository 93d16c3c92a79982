"""As-of joins with a time per row: what each request could know of a series at its own time.

Bars and requests are united, dealt out by series and period of time, sorted by time, and each request takes the greatest
bar so far. A series that holds most of the rows is cut into its periods; what was known when a period began is carried
into it as one row. No range join is made, so nothing grows with the product of bars and requests.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from ..plans.session import written
from .pit import SERIES

PRICES = ("open_price", "high_price", "low_price", "close_price", "volume")


def _carried(rows: DataFrame, keys: list[str], last: Column) -> DataFrame:
    """(keys, _period, _bar): for each period of a series what ``last`` comes to over all periods before it."""
    ends = rows.groupBy(*keys, "_period").agg(last.alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)  # a row a period
    return ends.withColumn("_bar", F.max("_last").over(before)).where("_bar is not null").select(*keys, "_period", "_bar")


def known_at(requests: DataFrame, bars: DataFrame, keys: tuple[str, ...] = SERIES, at: str = "asked_at", columns: tuple[str, ...] = PRICES, period: str = "month") -> DataFrame:
    """requests with (known): the bar that was known of their series at their own time, as a struct, or null.

    It is that of the latest session, then the latest revision of it, then the larger key, among the bars available at
    the time or before; a late revision of an old session does not hide a newer one. With session_date among ``keys`` it
    is the latest revision of the request's own session. Every request stays one row. A request without a time or with a
    null among its keys knows nothing, and bars without them are known to nobody. ``period`` (as of ``date_trunc``) should
    be so short that the bars and requests of one series and period fit a task.
    """
    keys = list(keys)
    bar = F.struct("session_date", "available_at", "bar_key", *(c for c in columns if c not in ("session_date", "available_at", "bar_key")))
    whole = F.col("available_at").isNotNull()
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    given = bars.where(whole).select(*keys, F.col("available_at").alias("_time"), F.lit(0).alias("_kind"), bar.alias("_bar"))
    asked = requests.select(*keys, F.col(at).alias("_time"), F.lit(1).alias("_kind"), F.struct(*(F.col(c) for c in requests.columns)).alias("_request"))
    rows = given.unionByName(asked, allowMissingColumns=True).withColumn("_period", F.date_trunc(period, "_time"))
    starts = _carried(rows, keys, F.max("_bar")).select(*keys, F.col("_period").alias("_time"), F.lit(-1).alias("_kind"), "_bar", "_period")
    so_far = Window.partitionBy(*keys, "_period").orderBy("_time", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.unionByName(starts, allowMissingColumns=True).withColumn("known", F.max("_bar").over(so_far))
    return seen.where("_kind = 1").select("_request.*", "known")


def sessions_known_at(requests: DataFrame, bars: DataFrame, limit: int, id_col: str = "request_id", keys: tuple[str, ...] = SERIES, at: str = "asked_at", columns: tuple[str, ...] = PRICES, period: str = "month") -> DataFrame:
    """(id_col, position, session_date, ...): the last ``limit`` sessions that each request knew, in time order from 1.

    A session is known from its first revision on, in the revision of the request's own time. Bars and requests are dealt
    out once, by ranges of series and time, written, and passed in order with the last sessions so far in hand; a series
    that fills several ranges begins each with what the ranges before it came to, which is ``limit`` bars a range. So no
    row is compared with more than ``limit`` others, however many a series or a ``period`` has; the latter changes nothing.
    A request that knew nothing has no rows, and bars without a session, a time or a key are known to nobody. Ids of
    requests should be unique: those that share one also share positions.
    """
    keys, columns = list(keys), [c for c in columns if c not in ("session_date", "available_at", "bar_key")]
    whole = lambda df, *names: df.where(" and ".join(f"`{c}` is not null" for c in (*keys, *names)))
    given = whole(bars, "available_at", "session_date").select(*keys, F.col("available_at").alias("_time"), F.lit(0).alias("_kind"), "session_date", "bar_key", *columns)
    asked = whole(requests, at).select(*keys, F.col(at).alias("_time"), F.lit(1).alias("_kind"), F.col(id_col).alias("_id"))
    rows = given.unionByName(asked, allowMissingColumns=True)
    ranged = rows.repartitionByRange(*keys, "_time", "_kind").sortWithinPartitions(*keys, "_time", "_kind", "bar_key", *columns)
    ranged = written(ranged.withColumn("_range", F.spark_partition_id()))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = []
        for batch in batches:
            rows = pa.Table.from_batches([*kept, batch])
            rows = rows.slice(int(np.flatnonzero(_starts(rows, keys))[-1]))
            kept = rows.take(_passed(rows, keys, limit)[3]).to_batches()
        yield from kept

    before = ranged.mapInArrow(ends, ranged.schema).toArrow().sort_by("_range")  # at most ``limit`` rows a range
    before = ranged.sparkSession.sparkContext.broadcast(before)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if kept is None:
                kept = before.value.cast(rows.schema)
                same = pc.less(kept["_range"], rows["_range"][0])
                for k in keys:
                    same = pc.and_(same, pc.equal(kept[k], rows[k][0]))
                kept = kept.filter(same)
            rows = pa.concat_tables([kept, rows]).combine_chunks()
            by, position, bar, last = _passed(rows, keys, limit)
            kept, bars = rows.take(last), rows.take(bar)
            yield from pa.table([rows["_id"].take(by), position, *(bars[c] for c in ("session_date", "_time", "bar_key", *columns))], names=names).to_batches()

    kinds = ranged.schema
    made = [(id_col, kinds["_id"]), ("position", None), ("session_date", kinds["session_date"]), ("available_at", kinds["_time"]), ("bar_key", kinds["bar_key"]), *((c, kinds[c]) for c in columns)]
    names = [name for name, _ in made]
    return ranged.mapInArrow(known, StructType([StructField(name, kind.dataType if kind else IntegerType()) for name, kind in made]))


def _starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the rows of another series begin."""
    starts = np.zeros(rows.num_rows, bool)
    starts[:1] = True
    for k in keys:
        starts[1:] |= pc.not_equal(rows[k].combine_chunks()[1:], rows[k].combine_chunks()[:-1]).to_numpy(zero_copy_only=False)
    return starts


def _passed(rows: pa.Table, keys: list[str], limit: int) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """Places of requests, positions and places of the bars that they know; and places of the bars known at the end.

    A session that has left the last ones never comes back to them, for sessions only get more.
    """
    day = rows["session_date"]
    day = (day.cast(pa.int32()) if pa.types.is_date32(day.type) else day).to_pylist()
    by, position, found = [], [], []
    days, bars = [], {}
    for i, (start, kind, session) in enumerate(zip(_starts(rows, keys).tolist(), rows["_kind"].to_pylist(), day)):
        if start:
            days, bars = [], {}
        if kind:
            by.extend([i] * len(days))
            position.extend(range(1, len(days) + 1))
            found.extend([bars[x] for x in days])
        elif session in bars:
            bars[session] = i
        elif len(days) < limit or session > days[0]:
            if len(days) == limit:
                del bars[days.pop(0)]
            insort(days, session)
            bars[session] = i
    return pa.array(by, pa.int64()), pa.array(position, pa.int32()), pa.array(found, pa.int64()), pa.array([bars[x] for x in days], pa.int64())
