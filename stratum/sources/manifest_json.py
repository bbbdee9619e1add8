"""Manifests, meta and inventories as JSON documents."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.schema import MANIFEST_VERSION

MANIFEST = "Version string, Root string, OriginalSha256 string, TotalBytes bigint, AvgSizeBytes int, MinSizeBytes int, MaxSizeBytes int, Level int, FileCount int, Files array<struct<RelativePath:string,Bytes:bigint,ChunkHashes:array<string>>>, Dirs array<string>"
META = "v int, hashAlg string, snapshotHash string, fileCount bigint, totalBytes bigint"

#: Names that inventories use (fixed values): for a path, a size and a fingerprint.
PATH_NAMES = ("RelativePath", "Path", "relPath", "name", "rel", "relativepath")
SIZE_NAMES = ("Bytes", "Size", "Length", "TotalBytes", "bytes", "size", "length", "totalbytes")
PRINT_NAMES = ("sha256", "hash", "fingerprint")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of one JSON file, or of all below a folder; an error if there are none."""
    reader = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    out = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    if out.isEmpty():
        raise FileNotFoundError(f"no manifest at {path}")
    return out


def manifests(spark: SparkSession, path: str, exact: bool = False) -> DataFrame:
    """(snapshot_id, manifest struct); snapshot_id is the file's name. ``exact`` asks for the version that rebuilding needs."""
    name = F.regexp_extract(F.col("file"), r"([^/]+)\.json$", 1)
    out = documents(spark, path).select(name.alias("snapshot_id"), F.from_json("text", MANIFEST).alias("m"))
    if not exact:
        return out
    ok = F.when(F.col("m.Version") == MANIFEST_VERSION, F.col("m")).otherwise(F.raise_error(F.concat(F.lit("not a manifest of this version: "), F.col("snapshot_id"))))
    return out.select("snapshot_id", ok.cast(out.schema["m"].dataType).alias("m"))


def head(found: DataFrame) -> DataFrame:
    names = (("Version", "version"), ("Root", "root"), ("OriginalSha256", "original_sha256"), ("TotalBytes", "total_bytes"), ("AvgSizeBytes", "avg_size"), ("MinSizeBytes", "min_size"), ("MaxSizeBytes", "max_size"), ("Level", "level"))
    return found.select("snapshot_id", *(F.col(f"m.{a}").alias(b) for a, b in names), F.col("m.FileCount").cast("bigint").alias("file_count"))


def files(found: DataFrame) -> DataFrame:
    return found.select("snapshot_id", F.explode("m.Files").alias("f")).select("snapshot_id", F.col("f.RelativePath").alias("path"), F.col("f.Bytes").alias("bytes"), F.coalesce("f.ChunkHashes", F.array().cast("array<string>")).alias("chunk_hashes"))


def folders(found: DataFrame) -> DataFrame:
    return found.select("snapshot_id", F.explode("m.Dirs").alias("path"))


def to_json(heads: DataFrame, files: DataFrame, folders: DataFrame) -> DataFrame:
    """(snapshot_id, text): the manifest documents."""
    entry = F.struct(F.col("path").alias("RelativePath"), F.col("bytes").alias("Bytes"), F.col("chunk_hashes").alias("ChunkHashes"))
    f = files.groupBy("snapshot_id").agg(F.array_sort(F.collect_list(entry)).alias("Files"))
    d = folders.groupBy("snapshot_id").agg(F.array_sort(F.collect_set("path")).alias("Dirs"))
    names = (("version", "Version"), ("root", "Root"), ("original_sha256", "OriginalSha256"), ("total_bytes", "TotalBytes"), ("avg_size", "AvgSizeBytes"), ("min_size", "MinSizeBytes"), ("max_size", "MaxSizeBytes"), ("level", "Level"), ("file_count", "FileCount"))
    rows = heads.join(f, "snapshot_id", "left").join(d, "snapshot_id", "left")
    empty = F.array().cast("array<string>")
    return rows.select("snapshot_id", F.to_json(F.struct(*(F.col(a).alias(b) for a, b in names), F.coalesce("Files", F.array().cast(rows.schema["Files"].dataType)).alias("Files"), F.coalesce("Dirs", empty).alias("Dirs"))).alias("text"))


def inventory(found: DataFrame) -> DataFrame:
    """(file, path, length, fingerprint, ordinal) from documents (file, text) of unknown layout.

    The array named Files (in any case) at the top if there is one, else the document itself, else the first array one or two levels down,
    whose elements all are objects with a path-like and a size-like field, an empty one too; a negative or missing size rejects
    an array. Documents without one give nothing.
    """

    def text_of(e: dict, names: tuple[str, ...]) -> str | None:
        for kinds in (str, (int, float)):
            for n in names:
                if isinstance(x := e.get(n), kinds) and not isinstance(x, bool):
                    return str(x)
        return None

    def number_of(e: dict) -> int | None:
        whole = lambda x: isinstance(x, int) and not isinstance(x, bool) or isinstance(x, str) and re.fullmatch(r"\s*[+-]?\d+\s*", x)
        return next((int(e[n]) for n in SIZE_NAMES if whole(e.get(n))), None)

    def entries(x: list) -> list[tuple] | None:
        out = []
        for e in x:
            path, size = (text_of(e, PATH_NAMES), number_of(e)) if isinstance(e, dict) else (None, None)
            if not path or size is None or size < 0:
                return None
            out.append((path, size, text_of(e, PRINT_NAMES) or None))
        return out

    def find(x) -> list[tuple] | None:
        if isinstance(x, list):
            return entries(x)
        if not isinstance(x, dict):
            return None
        for name, y in x.items():
            if name.lower() == "files" and isinstance(y, list):
                return entries(y)
        inner = [z for y in x.values() for z in ([y] if isinstance(y, list) else y.values() if isinstance(y, dict) else ()) if isinstance(z, list)]
        return next((r for y in inner if (r := entries(y)) is not None), None)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = find(json.loads(text or "null")) or []
                except ValueError:
                    rows = []
                out = [{"file": file, "path": p, "length": n, "fingerprint": f, "ordinal": i} for i, (p, n, f) in enumerate(rows)]
                yield pa.RecordBatch.from_pylist(out, pa.schema([("file", pa.string()), ("path", pa.string()), ("length", pa.int64()), ("fingerprint", pa.string()), ("ordinal", pa.int64())]))

    return found.select("file", "text").mapInArrow(parse, "file string, path string, length long, fingerprint string, ordinal long")


def without_sidecars(items: DataFrame) -> DataFrame:
    """Inventory rows but for the meta and the note at the root."""
    return items.where(~F.col("path").isin("meta.json", "note.md"))


def meta(spark: SparkSession, path: str) -> DataFrame:
    """(file, meta_v, hash_alg, snapshot_hash, file_count, total_bytes)"""
    m = F.from_json("text", META)
    return documents(spark, path).select("file", m.alias("m")).select("file", F.col("m.v").alias("meta_v"), F.col("m.hashAlg").alias("hash_alg"), F.col("m.snapshotHash").alias("snapshot_hash"), F.col("m.fileCount").alias("file_count"), F.col("m.totalBytes").alias("total_bytes"))


def refcounts(text: str) -> dict[str, int]:
    """A refcount document, keys in upper case; keys that are no digest are left out."""
    return {k.upper(): int(v) for k, v in json.loads(text).items() if re.fullmatch("[0-9A-Fa-f]{64}", k)}


def loose_json(text: str) -> dict:
    """JSON with comments and commas before closing brackets; an empty object if it can't be read."""
    parts = re.findall(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/|[^"/]+|/', text, re.S)
    clean = "".join(x for x in parts if not x.startswith(("//", "/*")))
    tokens = re.findall(r'"(?:\\.|[^"\\])*"|[^"]+', clean, re.S)
    clean = "".join(t if t.startswith('"') else re.sub(r",(\s*[}\]])", r"\1", t) for t in tokens)
    try:
        out = json.loads(clean)
    except ValueError:
        return {}
    return out if isinstance(out, dict) else {}


def ignore_rules(text: str | None):
    """The ignore file's rules with the defaults; names of its three lists in any case."""
    from stratum.functions.globs import Ignore

    found = {k.lower(): v for k, v in loose_json(text or "").items() if isinstance(v, list)}
    lists = [tuple(x for x in found.get(k, ()) if isinstance(x, str)) for k in ("exclude", "excludefiles", "excludedirs")]
    return Ignore(*lists).with_defaults()
