"""Content-addressed chunks: what is put, what refers to it, what may go, and figures about both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.functions.texts import SIZE_BINS, ratio, size_bin
from stratum.schema import MANIFEST_PREFIX

VALID_HASH = "^[0-9A-Fa-f]{64}$"
STORED_HASH = "^[0-9A-F]{64}$"


def known_version(version: Column | str) -> Column:
    return F.lower(version).startswith(MANIFEST_PREFIX)


def put_if_absent(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks of ``new`` (hash, ...) that are not ``stored``, each hash once. Equal hashes have equal data, so any row does."""
    return new.dropDuplicates(["hash"]).join(stored.select("hash"), "hash", "left_anti")


def references(files: DataFrame) -> DataFrame:
    """(hash) of every reference in the manifests' files (chunk_hashes); hashes that are none are skipped."""
    return files.select(F.explode("chunk_hashes").alias("hash")).where(F.col("hash").rlike(VALID_HASH)).select(F.upper("hash").alias("hash"))


def refcount(files: DataFrame) -> DataFrame:
    """(hash, n): how often each chunk is referred to, the same hash in one file counted as often as it is there."""
    return references(files).groupBy("hash").agg(F.count("*").alias("n"))


def gc_candidates(stored: DataFrame, counts: DataFrame) -> DataFrame:
    """Stored chunks (hash, stored_len) without a reference."""
    return stored.where(F.col("hash").rlike(STORED_HASH)).join(counts.where("n > 0").select("hash"), "hash", "left_anti")


def gc_summary(stored: DataFrame, counts: DataFrame) -> DataFrame:
    """One row: examined, deletable, bytes_freed."""
    live = counts.where("n > 0").select("hash", F.lit(True).alias("live"))
    joined = stored.where(F.col("hash").rlike(STORED_HASH)).join(live, "hash", "left")
    gone = F.col("live").isNull()
    return joined.agg(F.count("*").alias("examined"), F.count_if(gone).alias("deletable"), F.coalesce(F.sum(F.when(gone, F.col("stored_len"))), F.lit(0)).cast("long").alias("bytes_freed"))


def size_histogram(chunks: DataFrame, size: str = "raw_len") -> DataFrame:
    """(bin, n) for all six size bins, empty ones too."""
    counts = chunks.groupBy(size_bin(size).alias("bin")).agg(F.count("*").alias("n"))
    bins = chunks.sparkSession.range(len(SIZE_BINS) + 1).select(F.col("id").cast("int").alias("bin"))
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def statistics(heads: DataFrame, files: DataFrame, stored: DataFrame) -> DataFrame:
    """One row on manifests of a known version: heads (snapshot_id, version), files (snapshot_id, bytes, chunk_hashes), stored (hash, stored_len).

    Ratios without a denominator are 0. The files are read once: a file counts with its first reference, or with none if it is empty.
    """
    known = heads.where(known_version("version")).select("snapshot_id").distinct()
    refs = files.join(known, "snapshot_id", "left_semi").select("bytes", F.posexplode_outer("chunk_hashes").alias("pos", "hash"))
    first = F.coalesce("pos", F.lit(0)) == 0
    valid = F.when(F.col("hash").rlike(VALID_HASH), F.upper("hash"))
    counts = refs.groupBy(valid.alias("hash")).agg(F.count("*").alias("n"), F.count_if(first).alias("files"), F.sum(F.when(first, F.col("bytes"))).alias("bytes"))
    own, there = F.col("hash").isNotNull(), F.col("stored_len").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    one = counts.join(stored.select("hash", "stored_len"), "hash", "left").agg(
        total("files").alias("files"), total("bytes").alias("original_bytes"), total(F.when(own, F.col("n"))).alias("chunk_refs"), F.count_if(own).alias("unique_chunks"),
        F.count_if(own & there).alias("present_chunks"), F.count_if(own & ~there).alias("missing_chunks"), total("stored_len").alias("present_bytes"),
    )
    one = one.select(known.agg(F.count("*")).scalar().alias("manifests"), "*")
    return one.select("*", ratio("chunk_refs", "unique_chunks").alias("dedup_factor"), ratio("original_bytes", "present_bytes").alias("compression_ratio"), ratio("chunk_refs", "files").alias("refs_per_file"))


def missing_chunks(files: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys) of files with a chunk that is blank or not stored."""
    refs = files.select(*keys, F.explode("chunk_hashes").alias("hash")).withColumn("hash", F.upper("hash"))
    return refs.join(stored.select("hash"), "hash", "left_anti").select(*keys).distinct()
