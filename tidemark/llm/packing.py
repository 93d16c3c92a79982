"""Packing tokenized documents into sequences with a grouping genetic algorithm.

A document's ids end with a separator. Only documents longer than a sequence are cut, into full pieces behind a first
one that may be shorter. Full pieces are sequences already. The others are dealt into blocks of bounded size; for each
block several islands evolve packings: crossover puts whole well-filled bins of one parent into the other, drops the
bins that would hold a document twice, and best-fits the displaced documents. Islands hand their best packings on in a
ring through a shuffle. Bins that stay poorly filled are opened and packed once more across blocks.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, lasting, map_whole

#: How the byte-level vocabulary splits a text before it merges bytes (fixed value of the public vocabulary).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters on whose classes all Unicode versions agree. Texts of these alone are encoded by the faster library.
_PLAIN = re.compile("[^\\x20-\\x7e\\n\\t\\u00a1-\\u024f]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> list of ids, the same as tokenizers gives without special tokens.

    The same vocabulary is loaded into tiktoken, which is about four times as fast; it gets texts of plain characters
    without a special token's string, and tokenizers gets all others. ``unequal`` counts the texts of a table for which
    the two differ.
    """
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    special = [x["content"] for x in made.get("added_tokens", [])]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    ranks = {bytes(byte[c] for c in word): i for word, i in made["model"]["vocab"].items() if word not in special}
    fast = tiktoken.Encoding("plain", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(text: str) -> list[int]:
        if _PLAIN.search(text) or any(x in text for x in special):
            return whole.encode(text, add_special_tokens=False).ids
        return fast(text)

    return encode


def unequal(docs: DataFrame, tokenizer: str | None = None, text_col: str = "text") -> int:
    """How many texts get other ids than tokenizers gives, over all texts of a table; it has to be 0."""
    path = tokenizer or default_tokenizer()

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        encode, whole = encoder(path), Tokenizer.from_file(path)
        for frame in batches(frames, "text"):
            texts = [t for t in frame["text"] if isinstance(t, str)]
            yield pd.DataFrame({"n": [sum(encode(t) != whole.encode(t, add_special_tokens=False).ids for t in texts)]})

    return docs.select(F.col(text_col).alias("text")).mapInPandas(compare, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def token_pieces(docs: DataFrame, size: int = 1024, end_id: int = 2, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): the pieces of each document. A null text is an empty one.

    Ids of any value and null ids pass unchanged, rows that repeat are each cut for themselves, and an empty table gives
    an empty table.
    """
    path = tokenizer or default_tokenizer()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for frame in batches(frames, "text"):
            at, rows = [], []
            for i, text in enumerate(frame["text"]):
                ids = np.array([*encode(text if isinstance(text, str) else ""), end_id], dtype="<u4")
                first = (len(ids) - 1) % size + 1
                for piece, stop in enumerate(range(first, len(ids) + 1, size)):
                    start = max(0, stop - size) if piece else 0
                    part = ids[start:stop]
                    at.append(i)
                    rows.append((piece, start, len(part), zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if with_ids else [])))
            made = pd.DataFrame(rows, columns=["piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])
            made.insert(0, "id", frame["id"].to_numpy()[at])
            yield made

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_whole(texts, cut, "piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


Bins = list[tuple[int, ...]]


def best_fit(lengths: list[int], bins: Bins, size: int) -> Bins:
    """``bins`` and new ones, with each length put where it leaves the least room, in the order given."""
    held = [list(b) for b in bins]
    room: dict[int, list[int]] = {}
    open_rooms = 0
    for i, b in enumerate(held):
        if left := size - sum(b):
            room.setdefault(left, []).append(i)
            open_rooms |= 1 << left
    for n in lengths:
        fits = open_rooms >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            at = room[left].pop()
            if not room[left]:
                open_rooms ^= 1 << left
            held[at].append(n)
            left -= n
        else:
            at, left = len(held), size - n
            held.append([n])
        if left:
            room.setdefault(left, []).append(at)
            open_rooms |= 1 << left
    return [tuple(b) for b in held]


def fitness(bins: Bins, size: int) -> tuple[int, float]:
    """Fewer bins are better, and among as many, unevenly filled ones, which leave room that can be used."""
    return -len(bins), sum((sum(b) / size) ** 2 for b in bins)


def crossover(into: Bins, of: Bins, size: int, rng: random.Random) -> Bins:
    """A packing with well-filled bins of ``of``, those of ``into`` that hold none of their documents, and the rest best-fitted."""
    full = [b for b in of if sum(b) >= size - 2]
    share = rng.uniform(0.3, 0.9)
    given = [b for b in full if rng.random() < share]
    left: dict[int, int] = {}
    for b in into:
        for n in b:
            left[n] = left.get(n, 0) + 1
    for b in given:
        for n in b:
            left[n] -= 1
    kept = list(given)
    for b in sorted(into, key=sum, reverse=True):
        if sum(b) < size - 8 and rng.random() < 0.5:  # poorly filled bins are often opened
            continue
        for i, n in enumerate(b):
            if left[n] <= 0:
                for m in b[:i]:
                    left[m] += 1
                break
            left[n] -= 1
        else:
            kept.append(b)
    loose = sorted((n for n, c in left.items() for _ in range(c)), reverse=True)
    return best_fit(loose, kept, size)


def evolve(lengths: list[int], population: list[Bins], size: int, generations: int, members: int, rng: random.Random) -> list[Bins]:
    """The population after some generations, best first. It stops when the least possible number of bins is reached."""
    least = -(-sum(lengths) // size)
    order = sorted(lengths, reverse=True)
    if not population:
        population.append(best_fit(order, [], size))
    while len(population) < members and len(population[0]) > least:
        spread = rng.choice((8, 32, 128, 512))
        population.append(best_fit(sorted(order, key=lambda n: n + rng.uniform(0, spread), reverse=True), [], size))
    population.sort(key=lambda b: fitness(b, size), reverse=True)
    for _ in range(generations):
        if len(population[0]) <= least:
            break
        a, b = sorted(rng.sample(range(len(population)), 2)) if len(population) > 1 else (0, 0)
        population.append(crossover(population[a], population[b], size, rng))
        population.append(crossover(population[b], population[a], size, rng))
        population.sort(key=lambda b: fitness(b, size), reverse=True)
        del population[members:]
    return population


def _numbered(lengths: list[int], bins: Bins) -> list[int]:
    """For each place in ``lengths`` the number of its bin."""
    places: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        places.setdefault(n, []).append(i)
    out = [0] * len(lengths)
    for at, b in enumerate(bins):
        for n in b:
            out[places[n].pop()] = at
    return out


def _bins(lengths: list[int], numbers) -> Bins:
    held: dict[int, list[int]] = {}
    for n, at in zip(lengths, numbers):
        held.setdefault(int(at), []).append(n)
    return [tuple(b) for b in held.values()]


def _round(pieces: DataFrame, n: int, size: int, islands: int, epochs: int, generations: int, members: int, block: int, seed: int) -> DataFrame:
    """pieces with (blk, slot, bin, offset, fill): one packing over blocks of at most ``block`` pieces."""
    dealt = pieces.repartition(max(1, min(-(-n // block), 20_000)))
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = dealt.withColumn("at", at).withColumn("blk", F.spark_partition_id().cast("long") * (1 << 31) + F.floor(F.col("at") / block))
    dealt = lasting(dealt.withColumn("slot", (F.col("at") % block).cast("int")).drop("at"))
    each = dealt.groupBy("blk").agg(F.sort_array(F.collect_list(F.struct("slot", F.col("length").cast("int").alias("length")))).alias("x"))
    state = each.select("blk", F.col("x.length").alias("lengths"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.array().cast("array<array<int>>").alias("packings"))
    # An island is one row; dealing them out to a fixed number of tasks lets all cores evolve.
    tasks = max(1, min(-(-n // block) * islands, 4000))
    state = state.repartition(tasks, "blk", "island")
    schema = "blk long, lengths array<int>, island int, packings array<array<int>>, bins int, fit double"

    def epoch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for blk, lengths, island, packings in zip(frame["blk"], frame["lengths"], frame["island"], frame["packings"]):
                lengths = [int(x) for x in lengths]
                rng = random.Random(f"{seed} {blk} {island} {len(packings)}")
                found = evolve(lengths, [_bins(lengths, p) for p in packings], size, generations, members, rng)
                count, fit = fitness(found[0], size)
                rows.append((blk, lengths, island, [_numbered(lengths, b) for b in found[:members]], -count, fit))
            yield pd.DataFrame(rows, columns=["blk", "lengths", "island", "packings", "bins", "fit"])

    state = lasting(state.mapInPandas(epoch, schema))
    for _ in range(epochs - 1):
        elite = state.select("blk", ((F.col("island") + 1) % islands).alias("island"), F.slice("packings", 1, 2).alias("elite"))
        state = state.join(elite, ["blk", "island"]).select("blk", "lengths", "island", F.concat(F.slice("packings", 1, max(1, members - 2)), "elite").alias("packings"))
        state = lasting(state.repartition(tasks, "blk", "island").mapInPandas(epoch, schema))
    best = state.groupBy("blk").agg(F.min_by(F.struct("lengths", F.element_at("packings", 1).alias("numbers")), F.struct("bins", -F.col("fit"), "island")).alias("b")).select("blk", "b.*")

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for blk, lengths, numbers in zip(frame["blk"], frame["lengths"], frame["numbers"]):
                offset, used = [], np.zeros(len(lengths), np.int64)
                for n, b in zip(lengths, numbers):
                    offset.append(used[b])
                    used[b] += n
                yield pd.DataFrame({"blk": blk, "slot": np.arange(len(lengths), dtype=np.int32), "bin": numbers, "offset": offset, "fill": used[numbers]})

    placed = best.mapInPandas(place, "blk long, slot int, bin long, offset long, fill long")
    return dealt.join(placed, ["blk", "slot"])


def pack(pieces: DataFrame, size: int = 1024, islands: int = 2, epochs: int = 2, generations: int = 6, members: int = 4, block: int = 4096, reopen: float = 0.985, seed: int = 11) -> DataFrame:
    """``pieces`` with (sequence_id, offset): each piece's place in a sequence of at most ``size``, without gaps.

    ``pieces`` has ``length`` from 1 to ``size``; its other columns pass unchanged. Equal rows are packed each for
    itself. An empty table gives an empty table. Blocks are dealt out evenly whatever the keys, so no group is large.
    Bins that a block leaves poorly filled are opened and packed across blocks; with a single block there is nothing to
    pack them with.
    """
    pieces = lasting(pieces.drop("sequence_id", "offset"))
    names = pieces.columns
    full = pieces.where(F.col("length") >= size).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    loose = pieces.where(F.col("length") < size)
    n = loose.count()
    if not n:
        return full
    how = {"size": size, "islands": islands, "epochs": epochs, "generations": generations, "members": members, "block": block}
    first = lasting(_round(loose, n, seed=seed, **how))
    here = F.col("blk") * block + F.col("bin")
    poor = first.where(F.col("fill") < reopen * size) if n > block else first.limit(0)
    m = poor.count()
    if not m:
        return full.unionByName(first.select(*names, (here * 2).alias("sequence_id"), "offset"))
    kept = first.where(F.col("fill") >= reopen * size).select(*names, (here * 2).alias("sequence_id"), "offset")
    again = _round(poor.select(*names), m, seed=seed + 1, **how).select(*names, (here * 2 + 1).alias("sequence_id"), "offset")
    return full.unionByName(kept).unionByName(again)


def pack_documents(docs: DataFrame, size: int = 1024, end_id: int = 2, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): each document's pieces and their places."""
    made = pack(token_pieces(docs, size, end_id, tokenizer, id_col, text_col), size, **how)
    return made.withColumnRenamed("id", id_col)
