"""Divergence of sources: how far the word shares of each source of a language lie from those of the others and of the whole.

Two-dimensional tiling: the sources of a language fall into blocks, its kept terms into chunks. The packed counts of a
source and a chunk (places and counts of the terms it has) are copied to the tile of its block and every block of its
language; a tile streams through its chunks in order and adds up the divergence of each of its pairs, exactly, in whole
numbers. Long vocabularies are cut into segments of chunks, tiles of their own whose sums are added. Terms that no source of a tile has
are counted, not stored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lasting

#: Shares are counted in parts of this whole (fixed value).
WHOLE = 1_000_000_000
_A_TO_Z = range(ord("A"), ord("Z") + 1)
_LETTER = bytes(b + 32 if b in _A_TO_Z else b if b >= 0x80 or b - 32 in _A_TO_Z else 32 for b in range(256))
_FLUSH = 400_000


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8: runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_LETTER).split()


def _counted(batches: Iterator) -> Iterator:
    """(lang, source, term, n, docs): terms of the documents read so far, and one row of no term for each group."""
    import pyarrow as pa

    def rows(groups: dict):
        langs, sources, words, n, docs = [], [], [], [], []
        for (lang, source), (times, seen) in groups.items():
            langs += [lang] * (len(times) + 1)
            sources += [source] * (len(times) + 1)
            words += [*times, b""]
            n += [*times.values(), 0]
            docs += [*(seen[w] for w in times), 0]
        columns = [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    groups: dict = {}
    size = 0
    for batch in batches:
        langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        for row, group in enumerate(zip(langs, sources)):
            times, seen = groups.setdefault(group, (Counter(), Counter()))
            before, words = len(times), terms(texts[row].as_py())
            times.update(words)
            seen.update(set(words))
            size += len(times) - before
            if size >= _FLUSH:
                yield rows(groups)
                groups, size = {}, 0
    if groups:
        yield rows(groups)


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term; every group has a row for the term ''.

    Nulls count as ''. Each task sums what it reads before anything is shuffled.
    """
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    read = docs.select(given(lang_col).alias("lang"), given(source_col).alias("source"), given(text_col).cast("binary").alias("text"))
    found = read.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, size: str):
    """1 + floor(WHOLE * (n + 2) / (total + 2 * size)) of whole numbers of any size."""
    return F.expr(f"1 + (cast({WHOLE} as decimal(10, 0)) * cast({n} + 2 as decimal(19, 0))) div cast({total} + 2 * {size} as decimal(19, 0))")


def gap(p: str, q: str):
    """floor((p - q)^2 / (p + q))"""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _shares(counts, total: int, size: int):
    """``share`` of an array: the quotient is taken three digits at a time, so nothing passes 64 bits under 9e15 words a group."""
    import numpy as np

    whole, rest, made = total + 2 * size, np.asarray(counts, "int64") + 2, 0
    for _ in range(3):
        rest = rest * 1000
        made = made * 1000 + rest // whole
        rest = rest % whole
    return 1 + made


class _Tile:
    """The sums of the pairs of a tile, as chunks pass by."""

    def __init__(self, a: int, b: int, size: int):
        self.a, self.b, self.size = a, b, size
        self.members: dict = {}  # source: (block, words)
        self.sums: dict = {}
        self.covered = 0
        self.chunk: dict = {}

    def close_chunk(self) -> None:
        import numpy as np

        if not self.chunk:
            return
        used = np.unique(np.concatenate([places for places, _ in self.chunk.values()]))
        nothing, made = (np.empty(0, "int64"), np.empty(0, "int64")), {}
        for source, (_, total) in self.members.items():
            counts = np.zeros(len(used), "int64")
            places, n = self.chunk.get(source, nothing)
            counts[np.searchsorted(used, places)] = n
            made[source] = _shares(counts, total, self.size)
        self.covered += len(used)
        for x, y in self.pairs():
            p, q = made[x], made[y]
            self.sums[x, y] = self.sums.get((x, y), 0) + int(((p - q) ** 2 // (p + q)).sum())
        self.chunk = {}

    def pairs(self) -> Iterator:
        first = [s for s, (block, _) in self.members.items() if block == self.a]
        if self.a != self.b:
            second = [s for s, (block, _) in self.members.items() if block == self.b]
            return ((x, y) for x in first for y in second)
        return ((x, y) for i, x in enumerate(first) for y in first[:i])


def _tiles(frames: Iterator) -> Iterator:
    import pandas as pd

    def close(key, tile):
        tile.close_chunk()
        rows = [(key[0], x, y, tile.sums.get((x, y), 0), tile.covered, tile.members[x][1], tile.members[y][1], tile.size) for x, y in tile.pairs()]
        return pd.DataFrame(rows, columns=["lang", "x", "y", "part", "covered", "x_total", "y_total", "size"])

    key, tile, chunk = None, None, None
    for frame in frames:
        for lang, a, b, segment, number, source, block, total, size, places, counts in frame.itertuples(index=False):
            if (lang, a, b, segment) != key:
                if tile:
                    yield close(key, tile)
                key, tile, chunk = (lang, a, b, segment), _Tile(a, b, size), None
            if number != chunk:
                tile.close_chunk()
                chunk = number
            if number < 0:  # the members of a tile come first
                tile.members[source] = (block, total)
            else:
                tile.chunk[source] = (places, counts)
    if tile:
        yield close(key, tile)


def source_divergence(docs: DataFrame, least_docs: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", block: int = 16, chunk: int = 1024, segment: int = 16) -> DataFrame:
    """(lang, source, part, item, value, rank) for each source of each language.

    Part ``pair``: the divergence from every other source of the language, largest first. Part ``term``: the ``top`` terms
    that the source has more of than its language. A language keeps the terms of at least ``least_docs`` of its documents;
    one that keeps none has pairs of value 0 and no terms. Null languages, sources and texts count as ''; a source whose
    documents hold no term takes part; rows that repeat count each; an empty table gives no rows; equal values are ranked
    by the item's UTF-8 bytes. ``block`` sources, ``chunk`` terms and ``segment`` chunks are the sizes of a tile.
    """
    counts = lasting(term_counts(docs, lang_col, source_col, text_col))
    found = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("whole_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = lasting(found.select("lang", "term", "whole_n"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("size"), F.sum("whole_n").alias("whole_total"))
    chunks = F.expr(f"cast(pmod(xxhash64(term), (size + {chunk - 1}) div {chunk}) as int)")  # dealt out evenly, without an order over the language
    placed = kept.join(langs, "lang").withColumn("chunk", chunks).repartition("lang", "chunk")  # a join's partitioning by language would do for the window
    placed = placed.withColumn("place", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")))
    used = lasting(counts.where("n > 0").select("lang", "source", "term", "n").join(placed, ["lang", "term"]))

    members = counts.where("term = ''").select("lang", "source")
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sources = members.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    groups = members.join(totals, ["lang", "source"], "left").join(sources, "lang").join(langs, "lang", "left")
    blocks = F.expr(f"(sources + {block - 1}) div {block}")
    groups = lasting(groups.select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("size", F.lit(0)).alias("size"), blocks.alias("blocks"), F.pmod(F.xxhash64("source"), blocks).cast("int").alias("block"),
    ))

    pairs = _pairs(used, groups, chunk, segment)
    more = used.join(groups.select("lang", "source", "total"), ["lang", "source"]).withColumns({"p": share("n", "total", "size"), "q": share("whole_n", "whole_total", "size")})
    more = more.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)  # cut in each task before the shuffle
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(ranked)


def _pairs(used: DataFrame, groups: DataFrame, chunk: int, segment: int) -> DataFrame:
    packed = used.groupBy("lang", "source", "chunk").agg(F.sort_array(F.collect_list(F.struct("place", "n"))).alias("v"))
    packed = packed.select("lang", "source", "chunk", F.col("v.place").alias("places"), F.col("v.n").alias("counts"))
    none = [F.array().cast("array<int>").alias("places"), F.array().cast("array<long>").alias("counts")]
    segments = F.expr(f"explode(sequence(0L, greatest((size + {chunk - 1}) div {chunk} - 1, 0L) div {segment}))").alias("segment")
    heads = groups.select("lang", "source", segments, F.lit(-1).alias("chunk"), *none, "total", "size", "blocks", "block")
    vectors = packed.join(groups, ["lang", "source"]).withColumn("segment", F.expr(f"cast(chunk as long) div {segment}"))
    both = heads.unionByName(vectors).withColumn("other", F.explode(F.expr("sequence(0, cast(blocks as int) - 1)")))
    key = ["lang", "a", "b", "segment"]
    tiles = both.select("lang", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "segment", "chunk", "source", "block", "total", "size", "places", "counts")
    sums = tiles.repartition(*key).sortWithinPartitions(*key, "chunk", "source").mapInPandas(_tiles, "lang string, x string, y string, part long, covered long, x_total long, y_total long, size long")
    whole = sums.groupBy("lang", "x", "y", "x_total", "y_total", "size").agg(F.sum("part").alias("part"), F.sum("covered").alias("covered"))
    whole = whole.withColumns({"p": F.when(F.col("size") > 0, share("0L", "x_total", "greatest(size, 1L)")), "q": F.when(F.col("size") > 0, share("0L", "y_total", "greatest(size, 1L)"))})
    value = F.coalesce(F.col("part") + (F.col("size") - F.col("covered")) * gap("p", "q"), F.lit(0)).cast("long").alias("value")
    ways = F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item")))).alias("w")
    return lasting(whole.select("lang", value, ways)).select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")
