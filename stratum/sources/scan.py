"""A file tree as a Spark data source.

Unlike Spark's binary file source it keeps empty files and names that begin with a dot or an underscore. Folders that are
left out are not entered. The root must be a folder that driver and executors all see.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import regex as re
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stratum.functions.globs import Ignore
from stratum.operators.cache import ticks
from stratum.operators.chunking import check_sizes, pieces_of

if TYPE_CHECKING:
    from pyspark.sql.types import StructType

#: A listed file's content is read whole up to this size; larger files are read as chunks.
MOST_CONTENT = 1 << 30


@dataclass
class Part(InputPartition):
    paths: tuple[str, ...]


class Rules:
    """Ignore rules for a walk on the driver."""

    def __init__(self, ignore: Ignore | None):
        ignore = ignore or Ignore()
        self.folders = [re.compile(p) for p in ignore.folder_patterns()]
        self.files = [re.compile(p) for p in ignore.file_patterns()]

    def folder(self, path: str) -> bool:
        return any(p.search(path + "/") for p in self.folders)

    def file(self, path: str) -> bool:
        return any(p.search(path) for p in self.files)


def walk(root: str, ignore: Ignore | None = None) -> tuple[list[str], list[str]]:
    """Folders and files below ``root``, relative and in order; links to folders are not followed, what can't be read is skipped."""
    rules, folders, files, todo = Rules(ignore), [], [], [""]
    while todo:
        at = todo.pop()
        try:
            entries = list(os.scandir(os.path.join(root, at)))
        except OSError:
            continue
        for e in entries:
            path = f"{at}/{e.name}" if at else e.name
            if e.is_dir():
                if not e.is_symlink() and not rules.folder(path):
                    folders.append(path)
                    todo.append(path)
            elif e.is_file() and not rules.file(path):
                files.append(path)
    by_bytes = lambda p: p.encode("utf-8", "surrogateescape")
    return sorted(folders, key=by_bytes), sorted(files, key=by_bytes)


class FileTree(DataSource):
    """Options: path; chunks (average,least,most) to get chunks instead of whole contents; content=false for a listing."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        if "chunks" in self.options:
            return "path string, idx int, raw_len long, data binary"
        return "path string, bytes long, mtime_ticks long, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FileTreeReader(dict(self.options))


class FileTreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.sizes = tuple(map(int, options["chunks"].split(","))) if "chunks" in options else None
        self.content = options.get("content", "true").lower() != "false"
        self.per_part = int(options.get("bytes_per_partition", 64 << 20))
        lists = [tuple(x for x in options.get(k, "").split("\n") if x) for k in ("exclude", "exclude_files", "exclude_folders")]
        self.ignore = Ignore(*lists)
        if self.sizes:
            check_sizes(*self.sizes)

    def partitions(self) -> list[Part]:
        """Files in order, cut into partitions of about equal bytes."""
        out, own, size = [], [], 0
        for path in walk(self.root, self.ignore)[1]:
            own.append(path)
            size += 4096 + os.lstat(os.path.join(self.root, path)).st_size
            if size >= self.per_part:
                out.append(Part(tuple(own)))
                own, size = [], 0
        return [*out, Part(tuple(own))]

    def read(self, partition: Part) -> Iterator[tuple]:
        for path in partition.paths:
            full = os.path.join(self.root, path)
            if self.sizes:
                yield from ((path, k, len(data), data) for k, data in enumerate(pieces_of(full, *self.sizes)))
                continue
            stat = os.stat(full)
            data = None
            if self.content:
                if stat.st_size > MOST_CONTENT:
                    raise ValueError(f"{path} is too large to be one value; read it as chunks")
                with open(full, "rb") as f:
                    data = f.read()
            yield path, stat.st_size if data is None else len(data), ticks(stat.st_mtime_ns / 1e9), data


def scan(spark: SparkSession, root: str, ignore: Ignore | None = None, content: bool = True, chunks: tuple[int, int, int] | None = None) -> DataFrame:
    """(path, bytes, mtime_ticks, content) of the tree, or (path, idx, raw_len, data) with ``chunks`` sizes."""
    spark.dataSource.register(FileTree)
    reader = spark.read.format("file_tree").option("path", root).option("content", str(content).lower())
    for k, v in zip(("exclude", "exclude_files", "exclude_folders"), (ignore.common, ignore.files, ignore.folders) if ignore else ((), (), ()), strict=True):
        reader = reader.option(k, "\n".join(v))
    return (reader.option("chunks", ",".join(map(str, chunks))) if chunks else reader).load()


def folders(spark: SparkSession, root: str, ignore: Ignore | None = None) -> DataFrame:
    return spark.createDataFrame([(p,) for p in walk(root, ignore)[0]], "path string")


def file_list(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """(path) of the absolute names below ``root``, case ignored in the comparison; others are left out. An empty root: names as they are."""
    top = root.rstrip("/") + "/" if root else ""
    df = spark.createDataFrame([(n,) for n in names], "name string").where(F.lower("name").startswith(top.lower()))
    return df.select(F.substr("name", F.lit(len(top) + 1)).alias("path")).orderBy("path")


def planned_bytes(files: DataFrame) -> DataFrame:
    return files.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
