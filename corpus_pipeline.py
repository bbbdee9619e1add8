"""Documents to training shards: quality rules, near duplicates, decontamination, mixing, sharding."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm import decontamination, jaccard_join, mixing, quality_rules, sharding
from stratum.llm.common import cut, named, shared_folder, table

#: Rows of ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def identified(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and a column that tells its rows apart: doc_id, or a number given once where ids repeat or are null."""
    n = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n[0] == n[1]:
        return docs, "doc_id"
    name = "row"
    while name in docs.columns:
        name += "_"
    return cut(docs.withColumn(name, F.monotonically_increasing_id())), name


def small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it is counted to be small."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null and empty texts are rejected; repeated rows are judged each for itself; other columns stay as they are; an empty
    table stays empty.
    """
    return quality_rules.keep(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by links (5-word shingles, at least 80 % in common) the one with the smallest id stays; of rows alike in id, one.

    Documents without words are linked with nothing and stay. Where ids are null or repeat, rows are told apart by a number
    given once, and of each group the row with the smallest number stays. Other columns stay as they are; an empty table stays empty.
    """
    docs, row = identified(docs)
    found = jaccard_join.join(docs.select(F.col(row).alias("doc_id"), "text"), words=5, least=80)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone"))
    out = docs.join(small(gone), F.col(row) == F.col("gone"), "left_anti")
    return out if row == "doc_id" else out.drop(row)


def no_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay; repeated rows are judged each for itself; null and empty items are held by
    nothing; other columns stay as they are; an empty table stays empty.
    """
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A null source is a source of its own, the last; a text without words counts nothing and is taken once or never. Where ids are
    null or repeat, rows are told apart by a number given once. Other columns stay as they are; an empty table stays empty.
    """
    docs, row = identified(docs)
    taken = mixing.mix(docs.select(F.col(row).alias("doc_id"), "text", "source"))
    taken = small(taken.select(F.col("doc_id").alias("taken"), "copies").where("copies > 0"))
    names = [c for c in docs.columns if c != row or row == "doc_id"]
    out = docs.select(F.struct(*map(named, names)).alias("doc"), F.col(row).alias("id")).join(taken, F.col("id") == F.col("taken"))
    return out.select("doc", F.explode(F.sequence(F.lit(1), "copies"))).select("doc.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes: the rows of ``sharding.assign``.

    Null texts count as empty ones; repeated rows are rows of their own; other columns go; an empty table gives an empty result.
    """
    return sharding.assign(docs)


STAGES = [
    ("quality_rules", good_documents),
    ("jaccard_join", one_of_each),
    ("decontamination", no_test_items),
    ("mixing", mixed),
    ("sharding", shards),
]

#: SQL can't express the quality rules' estimation, the entropy balancing or the propagation; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written to the shared checkpoint folder and read again.

    Whatever the documents are, nulls, empty texts, repeated rows or none at all, the stages' docstrings say what becomes of them.
    """
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
