"""What the operators share: reading, word splitting, durable cuts of lineage.

Words are maximal runs of bytes other than space and 0x09-0x0D. ``bytes.split()``
cuts at exactly these six bytes, and ``bytes.lower()`` lowers exactly A-Z, so texts
are handled as UTF-8 bytes throughout.
"""

from __future__ import annotations

import ctypes
import re
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same words for Java regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the checkpoint folder of the session, or what ``spark.checkpoint.dir`` names.

    Where neither is set a temporary one serves in a local session; on a cluster that is an error.
    """
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the cluster's shared checkpoint folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def beside(rows: DataFrame, few: DataFrame, keys: list[str], hot: list[str], most: int = 200_000, salts: int = 64) -> DataFrame:
    """``rows`` joined with ``few`` (which must be cut), a row for each of the ``keys`` and few of them by nature, though any number of rows may have one key.

    ``few`` is counted: up to ``most`` rows are broadcast. More are joined by a shuffle, salted by the columns ``hot`` of ``rows``.
    """
    if few.count() <= most:
        return rows.join(F.broadcast(few), keys)
    salted = rows.withColumn("salt__", F.pmod(F.xxhash64(*hot), F.lit(salts)).cast("int"))
    return salted.join(few.withColumn("salt__", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*keys, "salt__"]).drop("salt__")


def numbered(rows: DataFrame, cols: list[str], limit: int, most: int = 200_000) -> DataFrame:
    """``rows`` (which must be cut) with ``nth``: 0, but where more than ``limit`` rows are alike in ``cols`` a number that tells them apart.

    By a hash of ``cols`` and ``nth`` rows are thus dealt out evenly, however many are alike.
    """
    many = cut(rows.groupBy(*cols).agg(F.count("*").alias("alike__")).where(F.col("alike__") > limit).select(*(F.col(c).alias(f"{c}__") for c in cols)))
    n = many.count()
    if not n:
        return rows.withColumn("nth", F.lit(0).cast("long"))
    same = F.lit(True)
    for c in cols:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}__"))
    found = rows.withColumn("at__", F.monotonically_increasing_id()).join(F.broadcast(many.withColumn("hit__", F.lit(True))) if n <= most else many.withColumn("hit__", F.lit(True)), same, "left")
    return found.withColumn("nth", F.when(F.col("hit__"), F.col("at__")).otherwise(0)).select(*rows.columns, "nth")


def crc_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; null ids count as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % n


def texts(column: pa.Array) -> list[bytes]:
    """The column's values as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def release() -> None:
    """Gives a Python worker's freed memory back to the machine; workers live on and serve later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not this C library
        pass


class WordHashes(dict):
    """word -> 64-bit hash, computed at the first look-up. Emptied when it grows beyond ``most`` words."""

    most = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order, by sorting: much faster on large arrays than numpy's own, which hashes."""
    s = np.sort(x)
    keep = np.ones(len(s), bool)
    keep[1:] = s[1:] != s[:-1]
    return s[keep]


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer for 64-bit hashes (the constants are those of the public splitmix64 generator)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(h: np.ndarray, n: int, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hashes of all windows of ``n`` consecutive words, in order; ``h`` holds the words' hashes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out, b = np.zeros(len(h) - n + 1, np.uint64), np.uint64(seed)
    for i in range(n):
        out = mix(out * b + h[i : len(h) - n + 1 + i])
    return out


def slices(batches, most: int = 4 << 20):
    """Slices of the batches with about ``most`` bytes of text each, one row at least; column 1 holds the texts."""
    for batch in batches:
        column = batch.column(1).cast(pa.large_binary())
        sizes = np.cumsum(np.diff(np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1])) if len(column) else []
        at = 0
        while at < len(column):
            upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most)))
            yield batch.slice(at, upto - at), int(sizes[upto - 1] - (sizes[at - 1] if at else 0))
            at = upto


def chunks(batches, most: int = 4 << 20):
    """(batch slice, its texts as bytes) with about ``most`` bytes of text each; column 1 holds the texts."""
    for part, _ in slices(batches, most):
        yield part, texts(part.column(1))
    release()
