"""Manifests: which chunks make up which file. Built from chunks, taken apart, selected from, and turned back into files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.functions.paths import ancestor_rows, normalize, safe


def build(chunks: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, bytes, chunk_hashes) from chunks (keys, path, idx, hash) and files (keys, path, bytes); empty files have no chunks.

    A file that is not empty must have chunks, none of them blank.
    """
    listed = chunks.groupBy(*keys, "path").agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("x"))
    listed = listed.select(*keys, "path", F.transform("x", lambda x: x["hash"]).alias("chunk_hashes"))
    out = files.select(*keys, "path", "bytes").join(listed, [*keys, "path"], "left")
    return sound(out.withColumn("chunk_hashes", F.coalesce("chunk_hashes", F.array().cast("array<string>"))))


def sound(files: DataFrame) -> DataFrame:
    """``files``, or an error at one that has bytes but no chunks, or a blank chunk."""
    blank = F.exists("chunk_hashes", lambda h: h.isNull() | (F.trim(h) == ""))
    bad = (F.col("bytes") > 0) & (F.coalesce(F.size("chunk_hashes"), F.lit(0)) <= 0) | F.coalesce(blank, F.lit(False))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("no chunks for "), F.col("path")))).otherwise(F.col("chunk_hashes"))
    return files.withColumn("chunk_hashes", checked.cast("array<string>"))


def explode(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, idx, hash) of every reference."""
    return files.select(*keys, "path", F.posexplode("chunk_hashes").alias("idx", "hash"))


def selected(path: Column | str, selectors: list[str]) -> Column:
    """Whether the path is one of the selectors or lies below one; blank selectors don't count."""
    path = F.col(path) if isinstance(path, str) else path
    wanted = sorted({s.replace("\\", "/").strip().strip("/") for s in selectors} - {""})
    out = F.lit(False)
    for s in wanted:
        out = out | (path == s) | path.startswith(f"{s}/")
    return out


def pick(files: DataFrame, selectors: list[str]) -> DataFrame:
    """The files that the selectors mean; an error if there are none."""
    out = files.where(selected(normalize("path"), selectors))
    if out.isEmpty():
        raise LookupError(f"nothing at {', '.join(selectors)}")
    return out


def picked_folders(files: DataFrame, keys: list[str]) -> DataFrame:
    return ancestor_rows(files, keys)


def pieces(files: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, idx, data) of manifest files from stored chunks (hash, data); an empty file is one row without data.

    A chunk that is not stored is an error, as is a path that leaves its root.
    """
    ok = F.when(safe("path"), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("unsafe path "), F.col("path"))))
    files = sound(files).withColumn("path", ok)
    refs = explode(files.where("bytes > 0"), keys).withColumn("hash", F.upper("hash"))
    found = refs.join(stored.select("hash", "data"), "hash", "left")
    data = F.when(F.col("data").isNull(), F.raise_error(F.concat(F.lit("missing chunk "), F.col("hash")))).otherwise(F.col("data"))
    empty = files.where("bytes = 0").select(*keys, "path", F.lit(0).alias("idx"), F.lit(None).cast("binary").alias("data"))
    return found.select(*keys, "path", "idx", data.cast("binary").alias("data")).unionByName(empty)


def rebuild(files: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path, bytes, content) of manifest files from stored chunks (hash, data); the chunks of one file meet in one task."""

    def whole(group: pa.Table) -> pa.Table:
        group = group.sort_by("idx")
        content = b"".join(x.as_py() or b"" for x in group["data"])
        return pa.table({**{k: group[k][:1] for k in (*keys, "path")}, "bytes": pa.array([len(content)], pa.int64()), "content": pa.array([content], pa.binary())})

    found = pieces(files, stored, keys)
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.select(*keys, "path").schema) + ", bytes long, content binary"
    return found.groupBy(*keys, "path").applyInArrow(whole, out)
