"""Exact set-similarity join of documents on word shingles, by prefixes of groups.

Shingles are put in one order for the whole corpus, rare ones first. Two sets that are similar enough must share a
shingle among the first few (the prefix) of both. Documents with equal sets become one class; classes with the same
prefix and size become one group, and only groups enter the index of prefix shingles. Pairs of groups that meet there are
filtered by size, by the places of what they share and by how many prefix shingles they share; those that are left are
expanded to their member classes and verified on whole sets.

Rarity comes from a sketch of fixed size over all documents (any order gives a whole join; the order only decides how
few candidates there are). Where the sketch is too small for the corpus, common shingles pass for rare ones and crowd the
index. Such shingles are found there by exact counts, go to the end of the order, and only documents whose prefix holds
one get a new prefix; this is repeated for as long as it halves the pairs to come and these are more than the entries.

Large clusters of near copies are not compared pair by pair: members of an index entry are first compared with one
leader, the links found make components, and then only members of different components are.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, components, forget, lasting, map_whole
from .shingles import shingle_hashes, word_hashes

_SKETCH_BITS, _BLOCK_BITS = 25, 18
#: The shares of all occurrences that lie below the levels of the sketch from 1 on.
_CUTS = [0.01, 0.02, 0.04, 0.07, 0.11, 0.16, 0.22, 0.3, 0.45, 0.65, 0.8, 0.9, 0.95, 0.98, 0.995]
_MARK_BITS = 1 << 24
#: An index entry with more components than this is crowded; at most this many shingles go to the end of the order a round.
_CROWD, _MOST_LATE = 64, 1 << 20


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _pack(counts: np.ndarray) -> bytes:
    """The counts of a block in a byte each; where few are not 0, their gaps and values instead."""
    at = np.flatnonzero(counts)
    if 5 * len(at) >= len(counts):
        return b"d" + zlib.compress(counts.tobytes(), 1)
    gaps = np.diff(at, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return b"s" + zlib.compress(gaps.tobytes() + counts[at].tobytes(), 1)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(packed[1:]), np.uint8)
    if packed[:1] == b"d":
        return raw
    found = len(raw) // 5
    counts = np.zeros(n, np.uint8)
    counts[np.cumsum(np.ascontiguousarray(raw[: 4 * found].reshape(4, found).T).view("<u4").ravel())] = raw[4 * found :]
    return counts


def _sketch(texts: DataFrame, k: int, bits: int) -> np.ndarray:
    """How often shingles of each of 2**bits hash buckets occur, as a level of 0 to 15, two to a byte; one array whatever the corpus.

    The levels are cut where given shares of all occurrences lie below, so that they tell rare buckets apart under any load.
    """
    size = 1 << bits
    block = min(size, 1 << _BLOCK_BITS)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.uint8)  # a count stops at 255 in a task, which changes no more than the order
        for frame in batches(frames, "text"):
            for words in word_hashes(list(frame["text"]), True):
                at, n = np.unique(shingle_hashes(words, k) >> np.uint64(64 - bits), return_counts=True)
                at = at.astype(np.int64)
                total[at] = np.minimum(total[at] + n, 255)
        parts = [(i, total[i * block : (i + 1) * block]) for i in range(size // block)]
        parts = [(i, _pack(x)) for i, x in parts if x.any()]
        if parts:
            yield pd.DataFrame(parts, columns=["block", "counts"])

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for i, x in zip(frame["block"], frame["counts"]):
                part = _unpack(x, block).astype(np.uint32)
                sums[i] = sums[i] + part if i in sums else part
        for i, x in sums.items():
            fine = np.minimum(255, np.round(8 * np.log2(1.0 + x))).astype(np.uint8)
            yield pd.DataFrame({"block": [i], "fine": [zlib.compress(fine.tobytes(), 1)]})

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(256, np.int64)
        for frame in frames:
            for x in frame["fine"]:
                seen += np.bincount(np.frombuffer(zlib.decompress(x), np.uint8), minlength=256)
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"level": at, "n": seen[at] * (2.0 ** (at / 8) - 1)})

    parts = texts.select("text").mapInPandas(count, "block int, counts binary").repartition("block").mapInPandas(add, "block int, fine binary")
    parts = lasting(parts)
    share = np.zeros(257)
    for row in parts.mapInPandas(weigh, "level int, n double").groupBy("level").agg(F.sum("n").alias("n")).collect():  # at most 256 rows
        share[row.level + 1] = row.n
    of = np.searchsorted(_CUTS, np.cumsum(share)[:256] / max(share.sum(), 1.0), side="right").astype(np.uint8)

    def level(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i, x in zip(frame["block"], frame["fine"]):
                two = of[np.frombuffer(zlib.decompress(x), np.uint8)].reshape(-1, 2)
                yield pd.DataFrame({"block": [i], "levels": [zlib.compress((two[:, 0] | two[:, 1] << 4).tobytes(), 1)]})

    levels = np.zeros(size // 2, np.uint8)
    for row in parts.mapInPandas(level, "block int, levels binary").toLocalIterator():  # at most 128 rows of 128 KB
        levels[row.block * block // 2 : (row.block + 1) * block // 2] = np.frombuffer(zlib.decompress(row.levels), np.uint8)
    forget(parts)
    return levels


def _keys(values: pd.Series) -> np.ndarray:
    """64 evenly spread bits of each value: a digest's first ones, or a shingle's hash."""
    if not len(values):
        return np.zeros(0, np.uint64)
    return np.frombuffer(b"".join(values), "<u8")[::2] if isinstance(values.iloc[0], (bytes, bytearray)) else values.to_numpy(np.int64).view(np.uint64)


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    most = np.uint64(_MARK_BITS - 1)
    return (keys & most).astype(np.int64), ((keys >> np.uint64(32)) & most).astype(np.int64)


def _marked(marks: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys are marked; a key that is not may be taken for one that is."""
    found = np.ones(len(keys), bool)
    for at in _places(keys):
        found &= (marks[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return found


def _marks(values: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size (2 MB) over the one column of ``values``."""

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(_MARK_BITS // 8, np.uint8)
        for frame in frames:
            for at in _places(_keys(frame.iloc[:, 0])):
                np.bitwise_or.at(seen, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        if seen.any():
            yield pd.DataFrame({"bits": [seen.tobytes()]})

    marks = np.zeros(_MARK_BITS // 8, np.uint8)
    for row in values.coalesce(16).mapInPandas(mark, "bits binary").toLocalIterator():
        marks |= np.frombuffer(row.bits, np.uint8)
    return marks


def _cut(docs: DataFrame, keys: DataFrame, text_col: str, k: int, make: Callable[[np.ndarray], tuple], columns: str) -> DataFrame:
    """(text_key, ...): what ``make`` gives for the distinct shingles of the texts whose digests are in ``keys`` (text_key).

    A filter of fixed size keeps most other texts from being cut into words; the join behind it is exact.
    """
    held = docs.sparkSession.sparkContext.broadcast(_marks(keys.select("text_key")))
    names = [c.split()[0] for c in columns.split(", ")]

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: set[bytes] = set()
        for frame in batches(frames, "text"):
            texts = {_digest(t.encode("utf-8", "surrogatepass")): t for t in frame["text"] if isinstance(t, str)}
            own = pd.Series([x for x in texts if x not in done], dtype=object)
            own = own[_marked(held.value, _keys(own))].tolist()
            done.update(own)
            made = list(zip(*(make(np.unique(shingle_hashes(w, k))) for w in word_hashes([texts[x] for x in own], True)))) or [()] * len(names)
            yield pd.DataFrame({"text_key": pd.Series(own, dtype=object)} | {c: pd.Series(list(v), dtype="int64" if f"{c} long" in columns else object) for c, v in zip(names, made)})

    whole = docs.select(F.col(text_col).alias("text")).mapInPandas(sets, f"text_key binary, {columns}")
    found = lasting(whole.dropDuplicates(["text_key"]).join(keys.select("text_key").distinct(), "text_key"))
    held.destroy()
    return found


class _Order:
    """The order of shingles and the prefix that a set has in it. late: marks of shingles that go to the end."""

    def __init__(self, levels, late, bits: int, threshold: int) -> None:
        self.levels, self.late, self.bits, self.threshold = levels, late, bits, threshold

    def prefix(self, found: np.ndarray) -> tuple[int, np.ndarray]:
        """(group, prefix) of a set's distinct shingles."""
        n = len(found)
        at = (found >> np.uint64(64 - self.bits)).astype(np.int64)
        level = (self.levels.value[at >> 1] >> ((at & 1) << 2).astype(np.uint8) & 15).astype(np.uint64)
        if self.late is not None:
            level |= _marked(self.late.value, found).astype(np.uint64) << np.uint64(8)
        order = np.argsort((level << np.uint64(55)) | (found >> np.uint64(9)), kind="stable")[: n - (n * self.threshold + 99) // 100 + 1]
        prefix = found[order].astype(np.int64)
        # A group goes by 64 bits of the digest of its size and prefix.
        return int.from_bytes(_digest(n.to_bytes(8, "little") + prefix.tobytes())[:8], "little", signed=True), prefix


def _needs(n1: str, n2: str, threshold: int):
    """The least overlap of two sets of these sizes that are similar enough: 100 o >= t (n1 + n2 - o)."""
    return F.expr(f"({threshold} * ({n1} + {n2}) + {99 + threshold}) div {100 + threshold}")


def near_duplicates(docs: DataFrame, threshold: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text", sketch_bits: int = _SKETCH_BITS, crowd: int = _CROWD) -> DataFrame:
    """(id, n_shingles, set_key, component_id) for each row of ``docs``: groups of near copies by exact Jaccard similarity.

    Words are lower-cased in A-Z. A document's set holds its distinct runs of ``k`` words; with fewer words, the whole
    sequence. Two documents link when 100 * |A and B| >= threshold * |A or B|; ``component_id`` is the smallest id that
    links reach. Null and blank texts have an empty set and link with nothing, not even with each other. Rows with equal
    ids and texts are kept, each with the same component; a null id never names a component unless all its ids are
    null. An empty table gives an empty table. Only the id and text columns are read, so others may have any names.

    ``sketch_bits`` (buckets of the sketch, as a power of two) and ``crowd`` (components in an index entry from which its
    shingle goes to the end of the order) decide how many pairs are compared and never which links are found.
    """
    spark = docs.sparkSession
    levels = spark.sparkContext.broadcast(_sketch(docs.select(F.col(text_col).alias("text")), k, sketch_bits))
    order = _Order(levels, None, sketch_bits, threshold)

    def describe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for frame in batches(frames, "text"):
            rows = []
            for text, words in zip(frame["text"], word_hashes(list(frame["text"]), True)):
                found = np.unique(shingle_hashes(words, k))
                n = len(found)
                key = _digest(found.tobytes()) if n else None
                if not n or key in seen:
                    rows.append((n, key, 0, None, None))
                    continue
                seen.add(key)
                rows.append((n, key, *order.prefix(found), _digest(text.encode("utf-8", "surrogatepass"))))
            made = pd.DataFrame(rows, columns=["n_shingles", "set_key", "grp", "prefix", "text_key"])
            made.insert(0, "doc", frame["doc"].to_numpy())
            yield made

    # The wide columns stand in the first row of a set in each task only, so copies are folded before any shuffle.
    made = map_whole(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), describe, "n_shingles long, set_key binary, grp long, prefix array<long>, text_key binary", "doc")
    made = lasting(made)
    rows = lasting(made.select("doc", "n_shingles", "set_key"))
    # One row for each class of equal sets. Sets under the least size can only link with equal ones.
    least = next(n for n in range(2, 10_000) if 100 * (n - 1) >= threshold * n) - 1 if threshold < 100 else 1 << 62
    wide = made.where(F.col("prefix").isNotNull() & (F.col("n_shingles") >= least)).groupBy(F.col("set_key").alias("cls")).agg(F.first("n_shingles").alias("n"), F.min(F.struct("text_key", "grp", "prefix")).alias("of"))
    wide = lasting(wide.select("cls", "n", "of.*"))
    forget(made)
    members = lasting(wide.select("cls", "n", "grp", "text_key"))
    groups = lasting(wide.select("grp", "n", "prefix").dropDuplicates(["grp"]))
    forget(wide)
    index = _index(groups, threshold)

    # First comparisons: of groups with the leader of each index entry, which has the entry nearest to its front as a text
    # that others are copies of has, and of members with the head of their group.
    heads = lasting(members.groupBy("grp").agg(F.min("cls").alias("head"), F.count(F.lit(1)).alias("size")))
    leaders = lasting(index.where(f"most >= {threshold} * n").groupBy("token").agg(F.min(F.struct("at", "n", "grp", "most")).alias("leader")))
    fits = f"grp <> leader.grp and most >= {threshold} * leader.n and leader.most >= {threshold} * n"
    stars = _alike(index.join(leaders, "token").where(fits).select(F.col("grp").alias("g1"), F.col("leader.grp").alias("g2")).distinct(), groups, threshold)
    head = heads.select("grp", "head")
    stars = (
        stars.join(head.select(F.col("grp").alias("g1"), "head"), "g1").join(head.select(F.col("grp").alias("g2"), F.col("head").alias("to")), "g2")
        .select(F.least("head", "to").alias("a"), F.greatest("head", "to").alias("b"))
    )
    inner = members.join(heads.where("size > 1").select("grp", "head"), "grp").where("cls <> head").select(F.least("cls", "head").alias("a"), F.greatest("cls", "head").alias("b"))
    links = _verified(docs, members, stars.unionByName(inner).distinct(), threshold, k, text_col)
    found = components(links, "a", "b")
    forget(links, leaders, heads)

    # Crowded shingles go to the end of the order while more pairs would meet at them than the index has entries, and that
    # halves them: pairs in proportion to the entries cost less than a new order.
    late, last = None, None
    while True:
        placed = lasting(members.join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls")))
        spread, sides, parts = _entries(index, placed, threshold)
        crowded = parts.where("not own").groupBy("entry").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > crowd)
        crowded = lasting(crowded.select(F.col("entry").cast("string").cast("long").alias("token"), "c", F.floor(F.log2("c")).alias("scale")))
        scales = crowded.groupBy("scale").agg(F.count(F.lit(1)).alias("tokens"), F.expr("sum(double(c) * c)").alias("pairs")).orderBy(F.desc("scale")).collect()  # a row for each power of two
        total = sum(r.pairs for r in scales)
        if not scales or (last is not None and 2 * total > last) or total <= parts.count():
            forget(crowded)
            break
        last, lowest, tokens = total, scales[0].scale, 0
        for r in scales:
            tokens += r.tokens
            lowest = r.scale if tokens <= _MOST_LATE else lowest
        marks = _marks(crowded.where(F.col("scale") >= lowest).select("token"))
        if late is not None:
            marks |= late.value
            late.destroy()
        late = spark.sparkContext.broadcast(marks)
        forget(crowded, parts, sides, placed)
        members, groups = _reordered(docs, members, groups, _Order(levels, late, sketch_bits, threshold), k, text_col)
        forget(index)
        index = _index(groups, threshold)
    levels.destroy()

    # The rest: groups of the same entry, or members of the same group, that are still in different components. Pairs of
    # groups are filtered and then expanded to their members.
    left, right = (parts.select("entry", "strong", *(F.col(c).alias(f"{c}{i}") for c in ("component", "lo", "hi", "most"))) for i in (1, 2))
    apart = f"component1 <> component2 and 100 * hi1 >= {threshold} * lo2 and 100 * hi2 >= {threshold} * lo1 and most1 >= {threshold} * lo2 and most2 >= {threshold} * lo1"
    meet = lasting(left.where("strong").join(right.drop("strong"), "entry").where(apart).select("entry", "component1", "component2"))
    one, two = (spread.select("entry", "own", *(F.col(c).alias(f"{c}{i}") for c in ("grp", "n", "component", "most"))) for i in (1, 2))
    side = lambda i: F.struct(F.col(f"grp{i}").alias("grp"), F.col(f"component{i}").alias("component"))
    met = (
        meet.join(one, ["entry", "component1"]).join(two.drop("own"), ["entry", "component2"])
        .where(f"100 * least(n1, n2) >= {threshold} * greatest(n1, n2) and most1 >= {threshold} * n2 and most2 >= {threshold} * n1 and (own or grp1 <> grp2)")
        .select(F.least(side(1), side(2)).alias("x"), F.greatest(side(1), side(2)).alias("y")).distinct()
        .select(F.col("x.grp").alias("g1"), F.col("x.component").alias("c1"), F.col("y.grp").alias("g2"), F.col("y.component").alias("c2"))
    )
    met = lasting(met)
    others = _alike(met.where("g1 <> g2").select("g1", "g2").distinct(), groups, threshold)
    met_pairs = met.where("g1 <> g2").join(others, ["g1", "g2"]).unionByName(met.where("g1 = g2"))
    a, b = (placed.select(F.col("grp").alias(f"g{i}"), F.col("component").alias(f"c{i}"), F.col("cls").alias(f"m{i}")) for i in (1, 2))
    pairs = met_pairs.join(a, ["g1", "c1"]).join(b, ["g2", "c2"]).select(F.least("m1", "m2").alias("a"), F.greatest("m1", "m2").alias("b")).distinct()
    more = _verified(docs, members, pairs, threshold, k, text_col)
    if late is not None:
        late.destroy()
    forget(index, placed, sides, parts, meet, met, members, groups)
    joined = (
        more.join(found.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
        .join(found.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    )
    joined = lasting(joined)
    forget(more)
    above = components(joined, "a", "b").select(F.col("node").alias("component"), F.col("component").alias("top"))
    of_class = found.join(above, "component", "left").select(F.col("node").alias("set_key"), F.coalesce("top", "component").alias("cc"))
    lone = above.select(F.col("component").alias("set_key"), F.col("top").alias("cc")).join(found.select(F.col("node").alias("set_key")), "set_key", "left_anti")

    lows = rows.where("set_key is not null").groupBy("set_key").agg(F.min("doc").alias("low"))
    lows = lows.join(of_class.unionByName(lone), "set_key", "left").withColumn("cc", F.coalesce("cc", "set_key"))
    lows = lasting(lows)
    forget(joined)
    smallest = lasting(lows.groupBy("cc").agg(F.min("low").alias("component_id")))
    ids = lows.join(smallest, "cc").select("set_key", "component_id")
    return rows.join(ids, "set_key", "left").select(F.col("doc").alias(id_col), "n_shingles", "set_key", F.coalesce("component_id", "doc").alias("component_id"))


def _index(groups: DataFrame, threshold: int) -> DataFrame:
    """(token, at, grp, n, most): the prefix shingles that several groups hold, with those groups.

    The first prefix shingle that two sets share stands at places i and j with n1 - i and n2 - j of the least overlap at
    least. ``most`` is the largest n2, times the threshold, that the place i allows; an entry is strong if it allows a set
    of its own size. The smaller set of a pair is strong, so weak entries never meet each other.
    """
    most = F.expr(f"{100 + threshold}L * (n - at) - {threshold} * n")
    index = groups.select(F.posexplode("prefix").alias("at", "token"), "grp", F.col("n").cast("int").alias("n"))
    often = index.groupBy("token").agg(F.count(F.lit(1)).alias("groups"), F.max(most >= threshold * F.col("n")).alias("strong")).where("groups > 1 and strong").select("token")
    often = lasting(often)  # on its own, so that the entries of a frequent token can be split in the join
    kept = lasting(index.join(often, "token").withColumn("n", F.col("n").cast("long")).withColumn("most", most))
    forget(often)
    return kept


def _alike(pairs: DataFrame, groups: DataFrame, threshold: int) -> DataFrame:
    """The pairs (g1, g2) of groups whose members can be similar enough.

    Two sets overlap by at most what their prefixes share and all that stands behind a prefix.
    """
    a, b = (groups.select(F.col("grp").alias(f"g{i}"), F.col("n").alias(f"n{i}"), F.col("prefix").alias(f"p{i}")) for i in (1, 2))
    both = F.size(F.array_intersect("p1", "p2")) + F.expr("greatest(n1 - size(p1), n2 - size(p2))")
    return pairs.join(a, "g1").join(b, "g2").where(both >= _needs("n1", "n2", threshold)).select("g1", "g2")


def _entries(index: DataFrame, placed: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What meets: (entry, own, grp, n, component, most), the written table under it, and one written row for each entry
    and component of it.

    An entry is a shingle of the index or, where ``own`` is true, a group with several members. Only entries with several
    components, one of them strong, are in the second table.
    """
    sides = lasting(placed.groupBy("grp", "component").agg(F.first("n").alias("n")))
    by_token = index.select(F.col("token").cast("string").cast("binary").alias("entry"), F.lit(False).alias("own"), "grp", "most").join(sides, "grp")
    several = sides.groupBy("grp").agg(F.count(F.lit(1)).alias("components")).where("components > 1").select("grp")
    by_group = sides.join(several, "grp").select(F.concat(F.lit("g"), F.col("grp").cast("string")).cast("binary").alias("entry"), F.lit(True).alias("own"), "grp", "n", "component", F.expr("100 * n").alias("most"))
    spread = by_token.select("entry", "own", "grp", "n", "component", "most").unionByName(by_group)
    all_parts = spread.groupBy("entry", "own", "component").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("most").alias("most"), F.max(F.expr(f"most >= {threshold} * n")).alias("strong")
    )
    all_parts = lasting(all_parts)
    mixed = lasting(all_parts.groupBy("entry").agg(F.count(F.lit(1)).alias("c"), F.max("strong").alias("s")).where("c > 1 and s").select("entry"))
    parts = lasting(all_parts.join(mixed, "entry"))
    forget(all_parts, mixed)
    return spread, sides, parts


def _reordered(docs: DataFrame, members: DataFrame, groups: DataFrame, order: _Order, k: int, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``members`` and ``groups`` in a new order; the given tables are deleted.

    A prefix without a late shingle stays as it is, for all that stands behind it stands behind it in the new order too.
    The texts of the other classes are cut again.
    """

    def touched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes = frame["prefix"].map(len).to_numpy()
            if len(sizes):
                hit = _marked(order.late.value, np.concatenate(list(frame["prefix"])).astype(np.int64).view(np.uint64))
                yield frame.loc[np.logical_or.reduceat(hit, np.cumsum(sizes) - sizes), ["grp"]]

    changed = lasting(groups.select("grp", "prefix").mapInPandas(touched, "grp long"))
    moved = lasting(members.join(changed, "grp", "left_semi").select("cls", "n", "text_key"))
    new = _cut(docs, moved, text_col, k, order.prefix, "grp long, prefix array<long>")
    wide = lasting(moved.join(new, "text_key").select("cls", "n", "grp", "text_key", "prefix"))
    made = lasting(members.join(changed, "grp", "left_anti").select("cls", "n", "grp", "text_key").unionByName(wide.drop("prefix")))
    fresh = groups.join(changed, "grp", "left_anti").select("grp", "n", "prefix").unionByName(wide.select("grp", "n", "prefix"))
    fresh = lasting(fresh.dropDuplicates(["grp"]))
    forget(changed, moved, new, wide, members, groups)
    return made, fresh


def _verified(docs: DataFrame, members: DataFrame, pairs: DataFrame, threshold: int, k: int, text_col: str) -> DataFrame:
    """(a, b): the pairs of classes that are similar enough, by their whole sets; one text of each class is read again."""
    pairs = lasting(pairs)
    needed = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    keys = lasting(members.select("cls", "text_key").join(needed, "cls"))
    cut = _cut(docs, keys, text_col, k, lambda found: (found.astype(np.int64),), "shingles array<long>")
    whole = cut.join(keys, "text_key")
    a, b = (whole.select(F.col("cls").alias(c), F.col("shingles").alias(f"{c}_set")) for c in "ab")
    both = pairs.join(a, "a").join(b, "b").withColumn("o", F.size(F.array_intersect("a_set", "b_set")).cast("long"))
    ok = both.where(F.expr(f"100 * o >= {threshold} * (size(a_set) + size(b_set) - o)"))
    ok = lasting(ok.select("a", "b"))
    forget(pairs, keys, cut)
    return ok
