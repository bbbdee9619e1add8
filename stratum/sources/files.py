"""Files written to a folder that driver and executors share, by the tasks that hold them."""

from __future__ import annotations

import contextlib
import os
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inside(root: str, path: str) -> str:
    full = os.path.normpath(os.path.join(root, path))
    if full == root or os.path.commonpath([root, full]) != root:
        raise ValueError(f"{path} leads out of {root}")
    return full


def make_folder(root: str, path: str) -> str:
    """The folder, and those above it below ``root``; files and links in its way go."""
    root = os.path.realpath(root)
    full = inside(root, path)
    at = root
    for part in os.path.relpath(full, root).split(os.sep):
        at = os.path.join(at, part)
        if os.path.islink(at) or os.path.lexists(at) and not os.path.isdir(at):
            with contextlib.suppress(FileNotFoundError):  # another task was first
                os.unlink(at)
        os.makedirs(at, exist_ok=True)
    return full


class Writer:
    """One file at a time, written aside and put in its place when it is whole."""

    def __init__(self, root: str):
        self.root, self.path, self.file, self.done = os.path.realpath(root), None, None, 0

    def begin(self, path: str) -> None:
        full = inside(self.root, path)
        above = os.path.dirname(full)
        if above != self.root:
            make_folder(self.root, os.path.relpath(above, self.root))
        if os.path.isdir(full) and not os.path.islink(full):
            shutil.rmtree(full)
        self.path, self.temp, self.full = path, f"{full}.{uuid.uuid4().hex}", full
        self.file = open(self.temp, "wb")

    def end(self) -> None:
        if self.file is not None:
            self.file.close()
            os.replace(self.temp, self.full)
            self.path, self.file = None, None
            self.done += 1

    def abandon(self) -> None:
        if self.file is not None:
            self.file.close()
            with contextlib.suppress(FileNotFoundError):
                os.unlink(self.temp)


def write(pieces: DataFrame, root: str) -> int:
    """The number of files written below ``root`` from their pieces (path, idx, data, packed).

    A file's pieces meet in one task in order and are written one after another, so no file need fit in memory; ``packed``
    ones are decompressed first. A task that runs again writes its files again.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, press = Writer(root), zstandard.ZstdDecompressor()
        try:
            for batch in batches:
                for k in range(batch.num_rows):
                    path = batch.column(0)[k].as_py()
                    if path != out.path:
                        out.end()
                        out.begin(path)
                    data = batch.column(2)[k].as_py() or b""
                    out.file.write(press.decompress(data) if batch.column(3)[k].as_py() else data)
            out.end()
        finally:
            out.abandon()
        yield pa.RecordBatch.from_arrays([pa.array([out.done], pa.int64())], ["n"])

    ordered = pieces.select("path", "idx", "data", "packed").repartition("path").sortWithinPartitions("path", "idx")
    return ordered.mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0
