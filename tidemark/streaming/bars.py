"""Bars as a stream: revisions arrive in any order, a store grows by appends, and the latest known bar is kept as state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.pit import new_rows
from ..sources.store import exists, ingest_months


def read_bars(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def append_new(stream: DataFrame, store: str, checkpoint: str, keys: tuple[str, ...] = ("bar_key",), trigger: dict | None = None) -> StreamingQuery:
    """Appends each batch's rows of identities that the store lacks; the first row of an identity stays.

    Bars with a session date and a source go to a store by month, of which a batch reads its own months; other rows are
    compared with the whole store. A batch that is run again after a failure finds its rows in the store and adds nothing.
    """
    by_month = {"session_date", "source_code", "available_at"} <= set(stream.columns)

    def append(batch: DataFrame, _: int) -> None:
        if by_month:
            ingest_months(batch, store, keys, ("available_at",))
            return
        spark = batch.sparkSession
        fresh = new_rows(batch, spark.read.parquet(store), list(keys)) if exists(spark, store) else batch.dropDuplicates(list(keys))
        fresh.write.mode("append").parquet(store)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def daily_counts(stream: DataFrame, late: str = "3 days") -> DataFrame:
    """Bars and revisions of each day of availability and source; a day closes when the watermark passes it."""
    return stream.withWatermark("available_at", late).groupBy(F.window("available_at", "1 day"), "source_code").agg(F.count(F.lit(1)).alias("bars"), F.approx_count_distinct("symbol").alias("symbols"))
