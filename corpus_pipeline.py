"""A corpus pipeline: documents without toxic ones, near copies and secrets, mixed to target weights and packed.

Each stage takes (spark, docs, sf_dir) and returns the next one's documents; the last returns packed pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, held_out, lasting, shared_folder, table
from tidemark.llm.jaccard_join import near_duplicates
from tidemark.llm.mixing import mix
from tidemark.llm.packing import pack_documents
from tidemark.llm.secrets import redact_secrets
from tidemark.llm.toxicity import fit_toxicity, toxicity_score, usable_labels


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the model learns from the labels that are not held out."""
    model = fit_toxicity(docs, usable_labels(table(spark, sf_dir, "labels"), held_out("doc_id", 5, 0)))
    return docs.where(toxicity_score(docs, model) < 0.5)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest id, then text key, of each group of near copies: runs of five words, 80 % alike or more.

    Rows are told apart by their texts, so groups hold rows of one id with other texts, and rows without an id, which
    stand for a group only if it has no others. Texts without words are in no group: rows that repeat an id and its
    text become one, those without an id stay. Extra columns pass.
    """
    blank = F.coalesce(~F.col("text").rlike(WORD), F.lit(True))
    keyed = docs.where(~blank).withColumn("_stage_key", F.unhex(F.md5(F.col("text").cast("binary"))))
    named = near_duplicates(keyed, id_col="_stage_key").select("_stage_key", "component_id").distinct()
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), F.col("_stage_key").alias("key"))
    texts = keyed.groupBy("_stage_key").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"))
    best = texts.join(named, "_stage_key").groupBy("component_id").agg(F.min(F.struct("first", "n")).alias("best"))
    best = best.select(F.col("best.first.key").alias("_stage_of"), F.col("best.first.id").alias("_stage_id"), F.col("best.n").alias("_stage_n"))
    own = (F.col("_stage_key") == F.col("_stage_of")) & F.col("doc_id").eqNullSafe(F.col("_stage_id"))
    kept = keyed.join(best, own).drop("_stage_key", "_stage_of", "_stage_id")
    once = kept.where("_stage_n = 1").drop("_stage_n").unionByName(kept.where("_stage_n > 1").drop("_stage_n").dropDuplicates(["doc_id", "text"]))
    empty = docs.where(blank)
    return once.unionByName(empty.where("doc_id is not null").dropDuplicates(["doc_id", "text"])).unionByName(empty.where("doc_id is null"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked and their characters counted anew."""
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it.

    Rows are told apart by id, text and source, so those that reuse an id with another text or source are taken as often
    as their own row is. Rows that are alike in all three share what the mix takes of them evenly; one of them stands for
    what does not divide.
    """
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    key = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("?")), text, F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    keyed = docs.withColumn("_stage_key", key)
    copies = F.sum(F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(0))
    times = mix(keyed, id_col="_stage_key").groupBy("_stage_key").agg(copies.alias("_stage_taken"), F.count(F.lit(1)).alias("_stage_rows")).where("_stage_taken > 0")
    times = lasting(times.selectExpr("_stage_key", "_stage_taken div _stage_rows AS _stage_each", "_stage_taken % _stage_rows AS _stage_more"))
    again = lambda n: F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))).alias("_stage_copy")
    made = keyed.join(times.where("_stage_each > 0"), "_stage_key").select(*docs.columns, again("_stage_each")).drop("_stage_copy")
    more = times.where("_stage_more > 0")
    if not more.limit(1).count():  # only rows that are alike leave any
        return made
    one = keyed.join(more, "_stage_key").dropDuplicates(["_stage_key"])
    return made.unionByName(one.select(*docs.columns, again("_stage_more")).drop("_stage_copy"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", one_of_each_group),
    ("secret_scans", secret_scans),
    ("source_mixing", mixing),
    ("best_fit_packing", packing),
]

#: The first stage learns a model and the fourth draws by a seeded hash, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again.

    The rows of a stage go when those of the next are written; the last ones stay, for the result is read from them.
    """
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            old = spark._jvm.org.apache.hadoop.fs.Path(before)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        before = path
    return docs
