"""The file-metadata cache: what need not be read again, and what may be forgotten."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.operators.cas import missing_chunks

#: 100-nanosecond ticks from the year 1 to 1970, and in a day.
EPOCH_TICKS = 621355968000000000
DAY_TICKS = 24 * 60 * 60 * 10_000_000


def ticks(unix_seconds: float) -> int:
    return EPOCH_TICKS + round(unix_seconds * 10_000_000)


def tick_time(column: str):
    """The timestamp of ticks, to the microsecond."""
    return F.timestamp_micros(((F.col(column) - EPOCH_TICKS) / 10).cast("long"))


def probe(files: DataFrame, cache: DataFrame, stored: DataFrame) -> DataFrame:
    """``files`` (path, size, mtime_ticks) with hit and the cached chunk_hashes, file_hash and snapshot_file_hash of hits.

    A hit has a row of equal size and time with chunks, each not blank and stored. Empty files have none, so they never hit,
    nor does a file whose time is not known: an edit may keep the size.
    """
    gone = missing_chunks(cache, stored, ["path"]).withColumn("gone", F.lit(True))
    rows = cache.select("path", F.col("size").alias("c_size"), F.col("mtime_ticks").alias("c_time"), "file_hash", "snapshot_file_hash", "chunk_hashes")
    joined = files.join(rows, "path", "left").join(gone, "path", "left")
    same = (F.col("c_size") == F.col("size")) & (F.col("c_time") == F.col("mtime_ticks")) & (F.size("chunk_hashes") > 0) & F.col("gone").isNull()
    hit = F.coalesce(same, F.lit(False))
    kept = [F.when(F.col("hit"), F.col(c)).alias(c) for c in ("file_hash", "snapshot_file_hash", "chunk_hashes")]
    return joined.withColumn("hit", hit).select(*files.columns, "hit", *kept)


def snapshot_digests(plan: DataFrame, cache: DataFrame) -> tuple[DataFrame, bool]:
    """The plan's files with their cached digests, and whether every one has one; else they must be computed."""
    found = plan.join(cache.select("path", F.col("snapshot_file_hash").alias("digest"), F.col("size").alias("cached_size")), "path", "left")
    ok = found.agg(F.bool_and(F.coalesce((F.length("digest") == 64) & (F.col("cached_size") == F.col("bytes")), F.lit(False)))).first()[0]
    return found.drop("cached_size"), ok is None or ok


def upsert(cache: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``cache`` with ``rows`` in place of those of equal keys, the latest of several; columns that ``rows`` lacks stay as they were."""
    order = Window.partitionBy(*keys).orderBy(F.desc("updated_at_ticks"))
    latest = rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")
    kept = [c for c in cache.columns if c not in latest.columns]
    if kept:
        latest = latest.join(cache.select(*keys, *kept), keys, "left")
    return cache.join(latest.select(*keys), keys, "left_anti").unionByName(latest.select(*cache.columns))


def collectable(cache: DataFrame, alive: DataFrame, cutoff_ticks: int) -> DataFrame:
    """Cache rows that are older than the cutoff and whose (space, path) no snapshot has."""
    return cache.where(F.col("updated_at_ticks") < cutoff_ticks).join(alive.select("space", "path").distinct(), ["space", "path"], "left_anti")
