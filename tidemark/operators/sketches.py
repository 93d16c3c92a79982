"""Mergeable summaries: distinct counts and quantiles as sketches of runs, stored, merged later, and held to the exact values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2^LG_K registers of a distinct count, with a standard error of 1.04 / sqrt(2^LG_K), and the size of a quantile sketch.
LG_K, K = 12, 400
#: What is allowed: five standard errors of a distinct count, and two percent of the ranks of a quantile.
DISTINCT_BOUND, RANK_BOUND = 5 * 1.04 / 2 ** (LG_K / 2), 0.02


def run_sketches(rows: DataFrame, by: list[str], distinct: Mapping[str, str | Column], quantiles: Mapping[str, str]) -> DataFrame:
    """(by, rows, one sketch a name): for each run a summary of fixed size, binary columns that can be stored and merged.

    Nulls are in no sketch; a run without other values has an empty one, or null for quantiles.
    """
    counts = [F.hll_sketch_agg(c, F.lit(LG_K)).alias(name) for name, c in distinct.items()]
    ranks = [F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(K)).alias(name) for name, c in quantiles.items()]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *counts, *ranks)


def merged(sketches: DataFrame, by: list[str], distinct: list[str], quantiles: list[str]) -> DataFrame:
    """The sketches of many runs as one for each of ``by``; the rows behind them are not read again."""
    counts = [F.hll_union_agg(c).alias(c) for c in distinct]
    ranks = [F.kll_merge_agg_double(c).alias(c) for c in quantiles]
    return sketches.groupBy(*by).agg(F.sum("rows").alias("rows"), *counts, *ranks)


def estimates(sketches: DataFrame, by: list[str], distinct: list[str], quantiles: Mapping[str, tuple[float, ...]]) -> DataFrame:
    """(by, name, at, estimate): a row a distinct count (at null) and a row a quantile."""
    rows = [F.struct(F.lit(c).alias("name"), F.lit(None).cast("double").alias("at"), F.hll_sketch_estimate(c).cast("double").alias("estimate")) for c in distinct]
    rows += [F.struct(F.lit(c).alias("name"), F.lit(q).cast("double").alias("at"), F.kll_sketch_get_quantile_double(c, F.lit(q)).alias("estimate")) for c, at in quantiles.items() for q in at]
    return sketches.select(*by, F.explode(F.array(*rows)).alias("e")).select(*by, "e.*")


def within_bound(rows: DataFrame, estimated: DataFrame, by: list[str], distinct: Mapping[str, str | Column], quantiles: Mapping[str, str]) -> DataFrame:
    """estimated with (error, within): measured against the rows, each read once.

    The error of a count is relative to the exact one. That of a quantile is how far its rank lies from the one asked for,
    where a value that comes often has all the ranks that it takes up.
    """
    exact = rows.groupBy(*by).agg(*(F.countDistinct(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in distinct.items()))
    counts = exact.select(*by, F.explode(F.map_from_arrays(F.array(*map(F.lit, distinct)), F.array(*(F.col(c) for c in distinct)))).alias("name", "exact"))
    key = lambda df: [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in df]
    asked = estimated.where("at is not null").groupBy(*by, "name").agg(F.collect_list(F.struct("at", "estimate")).alias("asked"))
    ranks = None
    for name, c in quantiles.items():
        own = asked.where(F.col("name") == name)
        joined = rows.where(F.col(c).isNotNull()).alias("a").join(F.broadcast(own).alias("b"), key(by) or F.lit(True)) if not by else rows.where(F.col(c).isNotNull()).alias("a").join(own.alias("b"), key(by))
        each = joined.select(*(F.col(f"a.{x}").alias(x) for x in by), "name", F.col(f"a.{c}").cast("double").alias("_v"), F.explode("asked").alias("q"))
        one = each.groupBy(*by, "name", F.col("q.at").alias("at"), F.col("q.estimate").alias("estimate")).agg((F.count_if(F.col("_v") < F.col("q.estimate")) / F.count(F.lit(1))).alias("low"), (F.count_if(F.col("_v") <= F.col("q.estimate")) / F.count(F.lit(1))).alias("high"))
        ranks = one if ranks is None else ranks.unionByName(one)
    error = F.greatest(F.lit(0.0), F.col("low") - F.col("at"), F.col("at") - F.col("high"))
    made = estimated.where("at is null").alias("a").join(counts.alias("b"), [F.col("a.name") == F.col("b.name"), *key(by)]).select(*(F.col(f"a.{x}").alias(x) for x in by), "a.name", "a.at", "a.estimate", (F.abs(F.col("estimate") - F.col("exact")) / F.greatest("exact", F.lit(1))).alias("error"))
    made = made.withColumn("within", F.col("error") <= DISTINCT_BOUND)
    if ranks is None:
        return made
    return made.unionByName(ranks.select(*by, "name", "at", "estimate", error.alias("error"), (error <= RANK_BOUND).alias("within")))
