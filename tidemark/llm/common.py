"""What the corpus operators share: lasting intermediate tables, readers, word rules and components."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space and the five ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one that the session names in ``spark.checkpoint.dir``.

    Where none is named, a local master gets a temporary one; a cluster has to name one, for a folder of one machine
    would not outlive it.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return sc._jsc.sc().getCheckpointDir().get()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Settings of Arrow batches, and the most that ``lasting`` lets a batch hold.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def lasting(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written to the shared folder, with a lineage that ends there.

    The shuffle files of that job go as soon as its rows are written, for nothing reads them again. Python tasks of the
    job get 2,000 rows or 8 MB at a time at most, a longer row alone, which keeps the texts that a worker holds few;
    lower settings of the session stay. The settings are the session's while the job is planned and run: threads that
    share one session may run with each other's, which changes sizes of batches and no result.
    """
    spark = df.sparkSession
    shared_folder(spark)
    wanted = {_CLEANUP: "true"}
    for name, most in _BATCH.items():
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name, None) or "0")
        wanted[name] = str(min(now, most) if now > 0 else most)
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        return df.select("*").checkpoint(eager=True)  # a plan made under the settings
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def forget(*tables: DataFrame) -> None:
    """Deletes the files of ``lasting`` tables that nothing reads any more."""
    for df in tables:
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def map_whole(df: DataFrame, make: Callable[[Iterator], Iterator], columns: str, key: str = "id") -> DataFrame:
    """mapInPandas with ``key`` as the first column of what it gives, then ``columns``.

    A numeric key goes through pandas as a text, for beside a null pandas would hold long integers as doubles and round
    them. Its values come back in their own type.
    """
    kind = df.schema[key].dataType.simpleString()
    if kind not in _NUMBERS:
        return df.mapInPandas(make, f"{key} {kind}, {columns}")
    made = df.withColumn(key, F.col(key).cast("string")).mapInPandas(make, f"{key} string, {columns}")
    return made.withColumn(key, F.col(key).cast(kind))


def held_out(column: str, parts: int, part: int):
    """True where crc32 of the id as text leaves ``part`` when divided by ``parts``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts == part


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label): one row for each labelled id; where an id has several labels the largest counts."""
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max(F.col(column)).cast("int").alias("label"))
    )


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): connected components of undirected edges; the component is the smallest node in it.

    Each round takes the smallest label among a node's neighbours and then the label of that label, so a chain of
    length d needs about log d rounds. All state stays in shared tables; the driver sees one count a round.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v")))
    both = lasting(both.where("u <> v").distinct())
    labels = lasting(both.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("node"), F.least("u", "least").alias("component"), F.lit(None).alias("was")))
    while True:
        here = labels.select("node", "component")
        near = (
            both.join(here.select(F.col("node").alias("v"), "component"), "v")
            .groupBy("u").agg(F.min("component").alias("near"))
        )
        nearer = here.join(near, here.node == near.u, "left").select(
            "node", F.least("component", "near").alias("to"), F.col("component").alias("was")
        )
        jump = here.select(F.col("node").alias("to"), F.col("component").alias("on"))
        new = lasting(nearer.join(jump, "to", "left").select("node", F.least("to", "on").alias("component"), "was"))
        forget(labels)
        labels = new
        if not labels.where("component <> was").take(1):
            forget(both)
            return labels.select("node", "component")


def batches(frames: Iterator, column: str, most_chars: int = 2_000_000) -> Iterator:
    """The pandas frames of a mapInPandas call, cut so that the texts of each hold about ``most_chars`` at most."""
    for frame in frames:
        size, lo = 0, 0
        for i, text in enumerate(frame[column]):
            size += len(text) if isinstance(text, str) else 0
            if size >= most_chars:
                yield frame.iloc[lo : i + 1]
                size, lo = 0, i + 1
        if lo < len(frame):
            yield frame.iloc[lo:]


def vector_sums(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, n, total): the number and the sum of the vectors of each key.

    Each task sums what it reads, keys are then dealt out and summed as they stream in; no task holds a key's rows. The
    keys of one task are held at a time, so they should be few (classes, languages).
    """
    def add(frames: Iterator, counted: bool) -> Iterator:
        import numpy as np
        import pandas as pd

        n: dict = {}
        sums: dict = {}
        for frame in frames:
            for k, v, c in zip(frame["k"], frame["v"], frame["n"] if counted else [1] * len(frame)):
                v = np.asarray(v, float)
                sums[k] = sums[k] + v if k in sums else v
                n[k] = n.get(k, 0) + int(c)
        for k, v in sums.items():
            yield pd.DataFrame({"k": pd.Series([k], dtype=object), "n": [n[k]], "v": pd.Series([v], dtype=object)})

    columns = "n long, v array<double>"
    first = map_whole(df.select(F.col(key).alias("k"), F.col(vector).alias("v")), lambda x: add(x, False), columns, "k")
    return map_whole(first.repartition("k"), lambda x: add(x, True), columns, "k").select(F.col("k").alias(key), "n", F.col("v").alias("total"))
