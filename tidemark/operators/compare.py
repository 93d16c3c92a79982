"""Comparison of two providers' bars over the same sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def provider_comparison(primary: DataFrame, validation: DataFrame, least_overlap: int = 20) -> DataFrame:
    """(symbol, outcome, counts, median and largest close difference, direction agreement) for each symbol of either.

    Both have one bar for each (symbol, session_date). Differences and agreement are given only for COMPARABLE symbols;
    the median is exact. Directions are those between neighbouring common sessions.
    """
    p, v = (df.select("symbol", "session_date", F.col("close_price").alias(c)) for df, c in ((primary, "p"), (validation, "v")))
    both = p.join(v, ["symbol", "session_date"], "full_outer").withColumn("common", F.col("p").isNotNull() & F.col("v").isNotNull())
    w = Window.partitionBy("symbol", "common").orderBy("session_date")
    step = lambda c: F.signum(F.col(c) - F.lag(c).over(w))
    both = both.withColumn("agrees", F.when(F.col("common"), step("p") == step("v")))
    difference = F.when(F.col("common"), F.abs(F.try_divide(F.col("v"), F.col("p")) - 1))
    n = F.count_if("common")
    agree, seen = F.count_if("agrees"), F.count("agrees")
    outcome = (
        F.when(F.count("p") == 0, "PRIMARY_DATA_MISSING").when(F.count("v") == 0, "VALIDATION_DATA_MISSING")
        .when(n < least_overlap, "INSUFFICIENT_OVERLAP").otherwise("COMPARABLE")
    )
    made = both.groupBy("symbol").agg(
        F.count("p").alias("primary_bars"), F.count("v").alias("validation_bars"), n.alias("overlap"), F.count_if(F.col("v").isNull()).alias("primary_only"),
        F.count_if(F.col("p").isNull()).alias("validation_only"), outcome.alias("outcome"), F.median(difference).alias("median_difference"),
        F.max(difference).alias("largest_difference"), agree.alias("agreeing"), seen.alias("observed"),
    )
    told = lambda x, other=None: F.when(F.col("outcome") == "COMPARABLE", x).otherwise(other)
    return made.withColumns({
        "median_difference": told(F.col("median_difference")), "largest_difference": told(F.col("largest_difference")),
        "agreeing": told(F.col("agreeing"), F.lit(0)), "observed": told(F.col("observed"), F.lit(0)),
        "agreement_rate": told(F.try_divide(F.col("agreeing").cast("double"), F.col("observed"))),
    })


def session_sets(primary: DataFrame, validation: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(common, only in the first, only in the second): keys of sessions as set algebra."""
    a, b = (df.select("symbol", "session_date") for df in (primary, validation))
    return a.intersect(b), a.subtract(b), b.subtract(a)
