"""Digests. Hexadecimal is upper case throughout; paths are ordered by their UTF-8 bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMPTY_SHA256 = "E3B0C44298FC1C149AFBF4C8996FB92427AE41E4649B934CA495991B7852B855"


def sha256(data: Column | str) -> Column:
    return F.upper(F.sha2(data, 256))


def chunk_list_hash(hashes: Column | str) -> Column:
    """One digest for a file from its chunks' digests in order."""
    return sha256(F.unhex(F.array_join(hashes, "")))


def file_digest(path: Column | str, size: Column | str, content: Column | str) -> Column:
    """Digest of the path, its size and the bytes, each of the first two followed by a line feed."""
    path, size, content = (F.col(x) if isinstance(x, str) else x for x in (path, size, content))
    return sha256(F.concat(F.encode(F.concat(path, F.lit("\n"), size.cast("string"), F.lit("\n")), "UTF-8"), content))


def ordered_digest(rows: DataFrame, keys: list[str], order: list[str], data: str, size: str) -> DataFrame:
    """Per ``keys``: digest (of the binary column ``data`` joined in the order given), n (rows) and total (of ``size``); without keys always one row.

    SHA-256 takes its bytes one after another, so one task must see all of a snapshot's; it sorts them, on disk if need be,
    and holds one batch at a time.
    """
    schema = rows.select(*keys).schema

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, n, total, done, kinds = None, None, 0, 0, [], []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            kinds = [batch.schema.field(k).type for k in keys]
            if keys:
                own = list(zip(*(table[k].to_pylist() for k in keys), strict=True))
                starts = [k for k in range(len(own)) if k == 0 or own[k] != own[k - 1]]
            else:
                own, starts = [()] * len(table), [0] if len(table) else []
            for at, end in zip(starts, [*starts[1:], len(table)], strict=True):
                if h is None or own[at] != now:
                    if h is not None:
                        done.append((*now, h.hexdigest().upper(), n, total))
                    now, h, n, total = own[at], hashlib.sha256(), 0, 0
                part = table.slice(at, end - at)
                for x in part[data]:
                    h.update(x.as_buffer() if x.is_valid else b"")
                n += len(part)
                total += sum(x or 0 for x in part[size].to_pylist())
        if h is not None:
            done.append((*now, h.hexdigest().upper(), n, total))
        names = [*keys, "digest", "n", "total"]
        if done:
            kinds += [pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(kinds)], names)

    dealt = rows.select(*keys, *order, data, size)
    dealt = (dealt.repartition(*keys) if keys else dealt.repartition(1)).sortWithinPartitions(*keys, *order).select(*keys, data, size)
    out = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in schema) + "digest string, n long, total long"
    found = dealt.mapInArrow(digest, out)
    return found if keys else found.agg(F.coalesce(F.max("digest"), F.lit(EMPTY_SHA256)).alias("digest"), F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.coalesce(F.max("total"), F.lit(0)).alias("total"))


def manifest_line(path: Column, size: Column, hashes: Column) -> Column:
    """A file's part of the manifest text: path, size and each chunk's digest, a line each."""
    lines = F.concat(path, F.lit("\n"), size.cast("string"), F.lit("\n"))
    return F.concat(lines, F.when(F.size(hashes) > 0, F.concat(F.array_join(hashes, "\n"), F.lit("\n"))).otherwise(""))


def snapshot_hashes(files: DataFrame, keys: list[str], without_meta: bool = False) -> DataFrame:
    """Per snapshot (``keys``): snapshot_hash, file_count, total_bytes; files: keys, path, bytes, content. ``without_meta`` leaves out files named meta.json in any case, in any folder."""
    if without_meta:
        files = files.where(~F.col("path").rlike("(?i)(^|/)meta\\.json$"))
    per_file = files.select(*keys, "path", "bytes", file_digest("path", "bytes", "content").alias("digest"))
    return fold_digests(per_file, keys)


def fold_digests(per_file: DataFrame, keys: list[str]) -> DataFrame:
    """The same from digests that are already known, raw and in path order; files: keys, path, bytes, digest. An empty digest is an error."""
    sound = F.when(F.length("digest") == 64, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("no digest for "), F.col("path"))))
    found = ordered_digest(per_file.withColumn("raw", F.unhex(sound.cast("string"))), keys, ["path"], "raw", "bytes")
    return found.select(*keys, F.col("digest").alias("snapshot_hash"), F.col("n").alias("file_count"), F.col("total").alias("total_bytes"))


def manifest_hashes(files: DataFrame, keys: list[str]) -> DataFrame:
    """Per snapshot: the digest of the manifest text; files: keys, path, bytes, chunk_hashes."""
    line = F.encode(manifest_line(F.col("path"), F.col("bytes"), F.col("chunk_hashes")), "UTF-8")
    found = ordered_digest(files.select(*keys, "path", "bytes", line.alias("line")), keys, ["path"], "line", "bytes")
    return found.select(*keys, F.col("digest").alias("original_sha256"))


def content_concat_hash(files: DataFrame, keys: list[str]) -> DataFrame:
    """Per snapshot: the digest of all bytes in path order; files: keys, path, content, or keys, path, idx, data in pieces."""
    order, data = (["path", "idx"], "data") if "idx" in files.columns else (["path"], "content")
    found = ordered_digest(files.withColumn("bytes", F.octet_length(data).cast("long")), keys, order, data, "bytes")
    return found.select(*keys, F.col("digest").alias("content_sha256"))
