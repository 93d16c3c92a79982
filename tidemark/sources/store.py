"""An append-only store of bars by session month, whose ingests read the months of their batch alone."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from ..plans.session import brief_shuffles, written

MONTH = "session_month"
#: Up to so many months a batch names its months one by one; beyond, the first and the last one. Both lose nothing.
MOST_NAMED = 240
#: About so many rows, of a batch and of the store, are compared in a task: they are sorted, and more would go to disk.
MOST_COMPARED = 1_000_000
#: About so many rows are shuffled at once. A larger ingest goes by parts of its identities, a job each, for what a job
#: shuffles lies on disk until it ends.
MOST_SHUFFLED = 128_000_000


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def with_month(bars: DataFrame) -> DataFrame:
    return bars.withColumn(MONTH, F.date_format("session_date", "yyyy-MM"))


def append_months(bars: DataFrame, path: str) -> None:
    """Appends bars under folders of source and month. Large folders get several files, small ones share a task."""
    made = with_month(bars).hint("rebalance", "source_code", MONTH)
    made.sortWithinPartitions("source_code", MONTH, "symbol", "session_date").write.mode("append").partitionBy("source_code", MONTH).parquet(path)


def of_months(batch: DataFrame) -> Column:
    """Whether a row's month is one of a batch (session_month).

    The driver sees the distinct months, a few hundred at most in a store of decades, or their ends where there are more.
    """
    months = sorted(r[0] for r in batch.select(MONTH).where(F.col(MONTH).isNotNull()).distinct().limit(MOST_NAMED + 1).collect())
    if len(months) <= MOST_NAMED:
        return F.col(MONTH).isin(months)
    first, last = batch.agg(F.min(MONTH), F.max(MONTH)).first()
    return F.col(MONTH).between(first, last)


def stored_months(spark: SparkSession, path: str, batch: DataFrame) -> DataFrame:
    """The rows of the store in the months of a batch (session_month): the months are filters on folders."""
    stored = spark.read.option("mergeSchema", "false").parquet(path).withColumn(MONTH, F.col(MONTH).cast("string"))
    return stored.where(of_months(batch))


def stored_fields(spark: SparkSession, path: str, *fields: StructField) -> DataFrame:
    """Some fields of the store and session_month, of the files that are there now: later ones are not in it.

    Months and sources alone are counted from the files' footers. A store without rows gives none.
    """
    schema = StructType([*fields, StructField(MONTH, StringType())])
    return spark.read.schema(schema).parquet(path)


def ingest_months(bars: DataFrame, path: str, keys: tuple[str, ...] = ("bar_key",), order: tuple[str, ...] = ("available_at",)) -> DataFrame:
    """Appends what the store lacks and returns (session_month, status, bars): CREATED, ALREADY_EXISTS or NO_SESSION_DATE.

    The first row of an identity stays for good: of rows of one batch the first by ``order``. An identity has one session
    date, so it can only be stored in the month of its row. A batch that comes again finds itself in the store and adds
    nothing; rows without a session date are counted and left out.

    The batch is shuffled by identity once, together with the identities that the store has in its months, and goes from
    there into the store; only the counts are written besides. A batch of more rows than MOST_SHUFFLED goes in by parts: if
    it fails between two, the next ingest of it adds the rest. CREATED is what the months' rows in the store grew by, so a
    store takes one ingest at a time. bars are read once for their months alone and once by each part: write them first if
    they are costly or may change.
    """
    spark = bars.sparkSession
    totals = with_month(bars).groupBy(MONTH).agg(F.count(F.lit(1)).alias("bars"))
    few = totals.limit(MOST_NAMED + 2).collect()  # bars without a month are one more
    if len(few) < MOST_NAMED + 2:
        totals = spark.createDataFrame(pa.Table.from_pylist([r.asDict() for r in few], pa.schema({MONTH: pa.string(), "bars": pa.int64()})))
        here, compared = F.col(MONTH).isin(sorted(r[MONTH] for r in few if r[MONTH])), sum(r["bars"] for r in few)
    else:
        here, compared = of_months(totals), totals.agg(F.sum("bars")).first()[0]
    source = bars.schema["source_code"]
    batch, grown = bars.where("session_date is not null").withColumn("_stored", F.lit(None).cast("string")), None
    if exists(spark, path):
        before = stored_fields(spark, path, *(bars.schema[k] for k in keys if k != "source_code"), source).where(here)
        batch = batch.unionByName(before.select(*keys, F.col(MONTH).alias("_stored")), allowMissingColumns=True)
        grown = before.select(MONTH, F.lit(-1).alias("n"))
        compared += before.count()
    parts = max(1, math.ceil(compared / MOST_SHUFFLED))
    tasks = math.ceil(compared / parts / MOST_COMPARED)
    seen = Window.partitionBy(*keys).orderBy(F.col("_stored").asc_nulls_last(), *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    with brief_shuffles(spark):
        for n in range(parts):
            part = batch.where(F.pmod(F.xxhash64(*keys), F.lit(parts)) == n) if parts > 1 else batch
            if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
                part = part.repartition(tasks, *keys)
            judged = part.withColumns({"_months": F.collect_set("_stored").over(seen), "_turn": F.count_if(F.col("_stored").isNull()).over(seen)})
            created = with_month(judged.where("_stored is null and _turn = 1")).where(~F.array_contains("_months", F.col(MONTH)))
            append_months(created.select(*bars.columns), path)
        after = stored_fields(spark, path, source).where(here).select(MONTH, F.lit(1).alias("n"))
        grown = after if grown is None else after.unionAll(grown)
        rows = totals.join(grown.groupBy(MONTH).agg(F.sum("n").alias("n")), MONTH, "left").withColumn("n", F.coalesce("n", F.lit(0)))
        left = F.when(F.col(MONTH).isNull(), "NO_SESSION_DATE").otherwise("ALREADY_EXISTS")
        counts = F.inline(F.array(F.struct(F.lit("CREATED").alias("status"), F.col("n").alias("bars")), F.struct(left.alias("status"), (F.col("bars") - F.col("n")).alias("bars"))))
        return written(rows.select(MONTH, counts).where("bars > 0"))
