"""Mixing sources to target weights by fitting whole documents to word budgets.

A source takes every document as often as its target covers it whole. What remains of the budget is filled from a
histogram of exact lengths: the same share of every length first, then a bounded-knapsack dynamic programme over the
documents left at each length closes the gap. Which documents of a length are taken follows a seeded hash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, lasting

_SLICES = 4096


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) for each source of (source, size).

    Sources stand in code-point order, null last, and weigh ``weights``, repeating. Together they get ``share`` of all
    words. A target stops at ``most`` times its source's words; what is over goes to the others by weight until none is
    above. Only one row for each source is handled in one place.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    at = F.expr(f"element_at(array({', '.join(f'{float(w)}D' for w in weights)}), cast((row_number - 1) % {len(weights)} as int) + 1)")
    made = sums.withColumn("row_number", F.row_number().over(order)).withColumn("weight", at)
    # A source stops at its cap when capital per weight up to it is short of its own cap per weight: in order of cap per
    # weight, the first k stop where (budget - caps of the first k - 1) / (weights from k on) >= cap_k / weight_k.
    made = made.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "row_number")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    budget = F.lit(float(share)) * F.sum("source_size").over(everything)
    made = (
        made.withColumn("budget", budget)
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(after))
        .withColumn("stops", F.col("left") >= F.col("ratio") * F.col("rest"))
    )
    free = F.min(F.when(~F.col("stops"), F.struct("ratio", "row_number", "left", "rest"))).over(everything)
    return made.withColumn("free", free).select(
        "source", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(F.least("cap", F.col("free.left") / F.col("free.rest") * F.col("weight"))).alias("target")
    )


def fit_budget(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take, so that their words come as near to ``budget`` as they can.

    First the same share of each length, rounded down. Of these, short documents are given back, about two of the longest or
    50,000 words, and long ones added while there is ample room, so that an exact bounded knapsack closes a gap of some
    four of the longest documents with short ones at hand. A budget of less is met as nearly as any choice can.
    """
    whole = sum(n * c for n, c in zip(lengths, counts))
    if budget >= whole:
        return list(counts)
    taken = [c * budget // whole for c in counts]
    gap = budget - sum(n * t for n, t in zip(lengths, taken))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    longest = lengths[order[0]] if order else 0
    slack = max(longest, 25_000)
    spare = 2 * slack
    for i in reversed(order):
        if lengths[i] and spare > 0:
            back = min(taken[i], -(-spare // lengths[i]))
            taken[i] -= back
            spare -= back * lengths[i]
            gap += back * lengths[i]
    for i in order:
        if lengths[i] and gap > 4 * slack:
            more = min(counts[i] - taken[i], (gap - 3 * slack) // lengths[i])
            taken[i] += more
            gap -= more * lengths[i]
    # Sums that can be reached, as the bits of one number; each step adds a power of two of equal documents. Of each sum
    # only the step that first reached it is kept: the sum without that step was reached before.
    reach, steps = 1, []
    first = np.full(gap + longest + 1, -1, np.int32)
    room = (1 << gap + longest + 1) - 1
    for i in order:
        n, left, block = lengths[i], counts[i] - taken[i], 1
        if not n or n > gap + longest:
            continue
        left = min(left, (gap + longest) // n)
        while left > 0:
            block = min(block, left)
            moved = reach << n * block & room
            new = moved ^ (moved & reach)
            if new:
                first[_ones(new)] = len(steps)
                steps.append((i, block))
                reach |= new
            left -= block
            block *= 2
        if reach >> gap & 1:
            break
    below = (reach & (1 << gap + 1) - 1).bit_length() - 1
    above = reach >> gap + 1
    best = gap + 1 + ((above & -above).bit_length() - 1) if above else None
    at = best if best is not None and best - gap < gap - below else below
    while at:
        i, block = steps[first[at]]
        taken[i] += block
        at -= lengths[i] * block
    return taken


def _ones(number: int) -> np.ndarray:
    """The places of the ones in a number's bits."""
    raw = np.frombuffer(number.to_bytes((number.bit_length() + 7) // 8, "little"), np.uint8)
    at = np.flatnonzero(raw)
    bits = np.unpackbits(raw[at][:, None], axis=1, bitorder="little").astype(bool)
    return (at[:, None] * 8 + np.arange(8))[bits]


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, taken) for each row: how many words of it the mix takes, repeats counted.

    A document's size is its number of words (null text: 0). ``taken`` is 0, the size or a multiple of it up to ``most``
    times. A null source is a source of its own. Rows with equal id and size are taken in any order, so the result is
    the same for every run. An empty table gives an empty table; only the three named columns are read.
    """
    sizes = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    rank = F.xxhash64(F.lit(seed), F.col("id").cast("string"), F.col("size"))
    sizes = lasting(sizes.withColumn("rank", rank).withColumn("slice", F.pmod("rank", F.lit(_SLICES)).cast("int")))
    targets = source_targets(sizes, weights, share, most)
    counts = sizes.groupBy("source", "size", "slice").agg(F.count(F.lit(1)).alias("n"))
    counts = lasting(counts)
    lengths = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        size, target = int(frame["source_size"].iloc[0]), float(frame["target"].iloc[0])
        frame = frame.sort_values("size", kind="stable")
        times = min(int(target // size), int(most)) if size else 0
        n, c = frame["size"].tolist(), frame["n"].tolist()
        extra = fit_budget(n, c, round(target - times * size)) if size and times < most else [0] * len(n)
        return pd.DataFrame({"source": frame["source"], "size": n, "times": times, "extra": extra})

    l, t = lengths.alias("l"), targets.alias("t")
    fits = l.join(t, F.col("l.source").eqNullSafe(F.col("t.source"))).select("l.source", "size", "n", "source_size", "target")
    kind = sizes.schema["source"].dataType.simpleString()
    fits = lasting(fits.groupBy("source", "source_size", "target").applyInPandas(
        lambda f: fit(f).assign(source_size=f["source_size"].iloc[0], target=f["target"].iloc[0]), f"source {kind}, size long, times long, extra long, source_size long, target double"
    ))

    # The extra ones of a length are the first by rank: slices of the rank that lie wholly before the last one are taken
    # whole, and only the documents of one slice are put in order.
    run = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = counts.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0)))
    c, f = slices.alias("c"), fits.alias("f")
    slices = c.join(f, F.col("c.source").eqNullSafe(F.col("f.source")) & (F.col("c.size") == F.col("f.size"))).select(
        F.col("c.source").alias("s"), F.col("c.size").alias("z"), F.col("c.slice").alias("l"), "times", "source_size", "target",
        F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - F.col("before"))).alias("more"), (F.col("n") > F.col("extra") - F.col("before")).alias("cut"),
    )
    each = sizes.join(slices, sizes["source"].eqNullSafe(slices["s"]) & (F.col("size") == F.col("z")) & (F.col("slice") == F.col("l")))
    keep = ["id", "source", "size", "source_size", "target"]
    plain = each.where("not cut or more <= 0").select(*keep, (F.col("size") * (F.col("times") + (F.col("more") > 0).cast("long"))).alias("taken"))
    first = F.row_number().over(Window.partitionBy("source", "size", "slice").orderBy("rank", "id")) <= F.col("more")
    cut = each.where("cut and more > 0").withColumn("first", first).select(*keep, (F.col("size") * (F.col("times") + F.col("first").cast("long"))).alias("taken"))
    return plain.unionByName(cut).withColumnsRenamed({"id": id_col, "source": source_col})
