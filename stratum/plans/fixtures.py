"""A file tree and a history of snapshots derived from the driver's tables by expressions; nothing is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STEPS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, bytes, content): each document a file in folders of its source and language."""
    path = F.concat(F.lit("docs/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    content = F.encode("text", "UTF-8")
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.octet_length("text").cast("long").alias("bytes"), content.alias("content"))


def history(spark: SparkSession, sf_dir: str, steps: list[int] | None = None) -> DataFrame:
    """(space, snapshot_id, k, doc_id, path, bytes, content) of snapshots k = 0 to 4.

    Snapshot k lacks the documents whose id ends in k, and a document whose id modulo 7 is below k ends in a line that names k.
    """
    base = tree(spark, sf_dir)
    k = F.explode(F.array(*map(F.lit, steps if steps is not None else range(STEPS)))).alias("k")
    rows = base.select("doc_id", "path", "content", k).where(F.col("doc_id") % 10 != F.col("k"))
    same = F.col("doc_id") % 7 >= F.col("k")
    content = F.when(same, F.col("content")).otherwise(F.concat("content", F.encode(F.concat(F.lit("\nrev "), F.col("k").cast("string")), "UTF-8")))
    rows = rows.withColumn("content", content)
    return rows.select(F.lit("main").alias("space"), snapshot_id("k").alias("snapshot_id"), "k", "doc_id", "path", F.octet_length("content").cast("long").alias("bytes"), "content")


def snapshot_id(k: str):
    n = F.col(k)
    return F.concat(F.lit("2024010"), (n + 1).cast("string"), F.lit("T000000Z_00000000-0000-7000-8000-00000000000"), n.cast("string"))


def snapshots(spark: SparkSession) -> DataFrame:
    """(space, snapshot_id, created_utc) of the history."""
    ids = spark.range(STEPS).select(F.lit("main").alias("space"), snapshot_id("id").alias("snapshot_id"))
    return ids.withColumn("created_utc", F.to_timestamp(F.substring("snapshot_id", 1, 8), "yyyyMMdd"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(space, snapshot_id, created_utc, status, price) of a long history: each order a snapshot of its day, each priority a space."""
    day = F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss'Z'")
    snapshot_id = F.concat(day, F.lit("_"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    space = F.concat(F.lit("s"), F.substring("o_orderpriority", 1, 1))
    return table(spark, sf_dir, "orders").select(space.alias("space"), snapshot_id.alias("snapshot_id"), F.col("o_orderdate").cast("timestamp").alias("created_utc"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
