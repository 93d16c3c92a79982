"""Repeated lines: every line of a corpus stays in the smallest document that holds it and goes from all others.

Hashes of lines are dealt out by ranges of (hash, document, position) and sorted in that order; a task streams through
its range and marks what comes after the first document of a hash. A hash that fills several ranges is told its first
document, so that no line is too frequent. Marks become one compressed bitmap a document; texts are not shuffled for them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .common import forget, lasting

BLANKS = " \t\n\x0b\x0c\r"
_FLUSH = 50_000


def line_key(line: str) -> str:
    """A line without blanks at its ends, A-Z lower-cased."""
    return line.strip(BLANKS).encode().lower().decode()


def _text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def line_hashes(docs: DataFrame, least_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(hi, lo, id, text_key, place, spread): the 128-bit hash of the key of each line with ``least_chars`` code points or more."""

    def hashes(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        def table(found, ids, keys, rows, places):
            pairs = np.frombuffer(b"".join(found), ">i8").astype("int64").reshape(-1, 2)
            at = pa.array(rows, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), ids.take(at), keys.take(at), pa.array(places, pa.int32()), pa.array(np.arange(len(rows), dtype="int32"))], ["hi", "lo", "id", "text_key", "place", "spread"])

        for batch in batches:
            ids, keys, texts = batch.column(0), batch.column(1), batch.column(2)
            found, rows, places = [], [], []
            for row in range(batch.num_rows):
                for place, line in enumerate(texts[row].as_py().split("\n")):
                    if len(key := line.strip(BLANKS)) >= least_chars:
                        found.append(xxhash.xxh3_128_digest(key.encode().lower()))
                        rows.append(row)
                        places.append(place)
                        if len(found) >= _FLUSH:
                            yield table(found, ids, keys, rows, places)
                            found, rows, places = [], [], []
            if found:
                yield table(found, ids, keys, rows, places)

    asked = _text(docs, id_col, text_col)
    whole, small = LongType(), IntegerType()
    fields = [("hi", whole), ("lo", whole), ("id", asked.schema["id"].dataType), ("text_key", whole), ("place", small), ("spread", small)]
    return asked.mapInArrow(hashes, StructType([StructField(n, t) for n, t in fields]))


def _starts(batch, before):
    """For each row of a sorted batch the id of the first row of its hash; before: (hash, that id) of the last row so far."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    hi, lo, ids = batch.column("hi").to_numpy(), batch.column("lo").to_numpy(), batch.column("id")
    new = np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]
    at = np.maximum.accumulate(np.where(new, np.arange(len(hi)), 0))
    first = ids.take(pa.array(at))
    if before is not None and before[0] == (hi[0], lo[0]):
        first = pc.if_else(pa.array(at == 0), before[1], first)
    return first, ((hi[0], lo[0]), first[0]), ((hi[-1], lo[-1]), first[len(hi) - 1])


def _ends(batches: Iterator) -> Iterator:
    """The first and the last hash of a range, each with the first id that it has there."""
    import pyarrow as pa

    one = last = None
    for batch in batches:
        if batch.num_rows:
            _, here, last = _starts(batch, last)
            one = one or here
            kinds = batch.schema
    if one is not None:
        both = [one, last]
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(h[k]) for h, _ in both], pa.int64()) for k in (0, 1)] + [pa.array([i.as_py() for _, i in both], kinds.field("id").type)], ["hi", "lo", "id"]
        )


def _repeats(batches: Iterator) -> Iterator:
    """The rows of a range whose document is not the first one of their hash."""
    import pyarrow as pa
    import pyarrow.compute as pc

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        first, _, last = _starts(batch, last)
        first = pc.if_else(pc.fill_null(batch.column("spans"), False), batch.column("first_id"), first)
        ids = batch.column("id")
        same = pc.or_(pc.fill_null(pc.equal(ids, first), False), pc.and_(ids.is_null(), first.is_null()))
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "text_key", "place")], ["id", "text_key", "place"]).filter(pc.invert(same))


def pack(places) -> bytes:
    """The keep bitmap of a document that loses the lines at ``places``: a bit a line, 1 where it stays, up to the last one that goes."""
    import numpy as np

    places = np.asarray(places)
    keep = np.ones((int(places.max()) // 8 + 1) * 8, "uint8")
    keep[places] = 0
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes())


def unpack(bitmap: bytes | None, n_lines: int) -> list[bool]:
    """Whether each line stays; lines behind the bitmap do, all of them where there is none."""
    import numpy as np

    keep = np.ones(n_lines, bool)
    if bitmap is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), "uint8"), bitorder="little")[:n_lines]
        keep[: len(bits)] = bits
    return keep.tolist()


def _bitmaps(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        made = [pack(x.values.to_numpy()) for x in batch.column("places")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_key"), pa.array(made, pa.binary())], ["id", "text_key", "keep"])


def keep_bitmaps(docs: DataFrame, least_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, keep): the keep bitmap of every document that loses lines; text_key is Spark's xxhash64 of its text.

    Rows of one id count as one document, whose lines all stay if it is the smallest that holds them; rows that repeat
    an id and its text share one bitmap. A null id is an id of its own that comes after all others. Null and empty texts
    have one empty line, which is too short to go. Lines are compared by 128-bit hashes of their keys.
    """
    lines = lasting(line_hashes(docs, least_chars, id_col, text_col))
    order = ["hi", "lo", F.col("id").asc_nulls_last(), "text_key", "place", "spread"]
    ranged = lasting(lines.repartitionByRange(*order).sortWithinPartitions(*order).drop("spread"))
    forget(lines)
    kind, key = ranged.schema["id"].dataType, StructField("text_key", LongType())
    ends = ranged.mapInArrow(_ends, StructType([StructField("hi", LongType()), StructField("lo", LongType()), StructField("id", kind)]))
    # two rows a range at most: only hashes that end one range and begin the next are kept, with the first of their ids
    spanning = ends.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1").select("hi", "lo", "first_id", F.lit(True).alias("spans"))
    told = ranged.join(F.broadcast(lasting(spanning)), ["hi", "lo"], "left")
    marks = told.mapInArrow(_repeats, StructType([StructField("id", kind), key, StructField("place", IntegerType())]))
    places = lasting(marks.groupBy("id", "text_key").agg(F.collect_set("place").alias("places")))
    forget(ranged)
    return places.mapInArrow(_bitmaps, StructType([StructField("id", kind), key, StructField("keep", BinaryType())]))


def without_repeats(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_dropped, kept) for each row of docs: its lines where its bitmap keeps them, joined by newlines."""

    def apply(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, texts, keeps = batch.column("id"), batch.column("text"), batch.column("keep")
            n, dropped, kept = [], [], []
            for row in range(batch.num_rows):
                lines = texts[row].as_py().split("\n")
                stays = unpack(keeps[row].as_py(), len(lines))
                n.append(len(lines))
                dropped.append(len(lines) - sum(stays))
                kept.append("\n".join(line for line, stay in zip(lines, stays) if stay))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], ["id", "n_lines", "n_dropped", "kept"])

    rows = _text(docs, id_col, text_col)
    theirs = bitmaps.select(F.col("id").alias("_id"), F.col("text_key").alias("_key"), "keep")
    joined = rows.join(theirs, rows["id"].eqNullSafe(F.col("_id")) & (rows["text_key"] == F.col("_key")), "left").select("id", "text", "keep")
    fields = [("id", rows.schema["id"].dataType), ("n_lines", LongType()), ("n_dropped", LongType()), ("kept", StringType())]
    return joined.mapInArrow(apply, StructType([StructField(n, t) for n, t in fields]))
