"""Files cut into chunks: fixed blocks in Spark expressions, rolling-hash cuts in Arrow batches."""

from __future__ import annotations

import hashlib
import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.functions.codec import LEVEL
from stratum.functions.hashing import sha256
from stratum.schema import PACKED

#: What one read of a file returns at most; cuts by the rolling hash fall only at the ends of reads.
READ_SIZE = 1 << 20
M64 = (1 << 64) - 1


def gear_table() -> np.ndarray:
    """256 values of the splitmix64 generator whose state starts at its own increment (fixed values, by their rule)."""
    increment, out = 0x9E3779B97F4A7C15, []
    x = increment
    for _ in range(256):
        x = (x + increment) & M64
        z = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & M64
        z = ((z ^ z >> 27) * 0x94D049BB133111EB) & M64
        out.append(z ^ z >> 31 or 1)
    return np.array(out, np.uint64)


GEAR = gear_table()


def check_sizes(average: int, least: int, most: int) -> None:
    if min(average, least, most) <= 0 or not least <= average <= most:
        raise ValueError("sizes must be positive, the average between the least and the most")


def rolled(data: bytes) -> int:
    """h = 2 h + gear[byte] over ``data`` from 0: only the last 64 bytes count, each shifted by its distance from the end."""
    tail = GEAR[np.frombuffer(data[-64:], np.uint8)]
    return int((tail << np.arange(len(tail) - 1, -1, -1, dtype=np.uint64)).sum(dtype=np.uint64))


def cuts(data: bytes, average: int, least: int, most: int, read_size: int = READ_SIZE, lead: int = 0) -> list[int]:
    """Lengths of the chunks of ``data``, which begins ``lead`` bytes into a read.

    Bytes are taken in steps that end where a read ends or a chunk is full. After each step a chunk of ``most`` bytes is cut,
    and one of ``least`` or more if the low bits of its rolling hash are zero: as many as the average has, one less from the
    average on. What remains at the end is a chunk.
    """
    bits = max(1, round(math.log2(average)))
    out, start, at = [], 0, 0
    while at < len(data):
        at = min(start + most, ((lead + at) // read_size + 1) * read_size - lead, len(data))
        n = at - start
        mask = (1 << (max(1, bits - 1) if n >= average else bits)) - 1
        if n >= most or n >= least and rolled(data[max(start, at - 64) : at]) & mask == 0:
            out.append(n)
            start = at
    return [*out, len(data) - start] if start < len(data) else out


def cuts_by_byte(data: bytes, average: int, least: int, most: int) -> list[int]:
    """The same with the hash tested at every byte, so cuts follow the content wherever it moves. A mode of its own."""
    h = np.zeros(len(data) + 63, np.uint64)
    g = GEAR[np.frombuffer(data, np.uint8)]
    for k in range(64):
        h[k : k + len(g)] += g << np.uint64(k)
    bits = max(1, round(math.log2(average)))
    strict, loose = (np.flatnonzero(h[: len(g)] & np.uint64((1 << b) - 1) == 0) + 1 for b in (bits, max(1, bits - 1)))
    out, start = [], 0
    while start < len(data):
        end = min(start + most, len(data))
        for found, lo, hi in ((strict, start + least, min(start + average, end)), (loose, start + average, end)):
            i = np.searchsorted(found, lo)
            if i < len(found) and found[i] < hi:
                end = int(found[i])
                break
        out.append(end - start)
        start = end
    return out


def gear_chunks(files: DataFrame, average: int, least: int, most: int, read_size: int = READ_SIZE, by_byte: bool = False, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """(keys, idx, raw_len, data) for every chunk of the files (keys, content); an empty file has none."""
    check_sizes(average, least, most)
    schema = files.select(*keys).schema

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data = batch.column(len(keys))[row].as_py() or b""
                lengths = cuts_by_byte(data, average, least, most) if by_byte else cuts(data, average, least, most, read_size)
                ends = np.cumsum(lengths)
                for i in range(0, len(lengths), 64):
                    part = range(i, min(i + 64, len(lengths)))
                    own = [pa.array([batch.column(k)[row].as_py()] * len(part), batch.schema.field(k).type) for k in range(len(keys))]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(part, pa.int32()), pa.array([lengths[j] for j in part], pa.int64()), pa.array([data[ends[j] - lengths[j] : ends[j]] for j in part], pa.binary())], [*keys, "idx", "raw_len", "data"])

    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", idx int, raw_len long, data binary"
    return files.select(*keys, "content").mapInArrow(cut_all, out)


def fixed_chunks(files: DataFrame, block: int, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """(keys, idx, raw_len, data): blocks of ``block`` bytes, the last one shorter. Expressions only."""
    n = F.ceil(F.octet_length("content") / block).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    data = F.substring(F.col("content"), F.col("idx") * block + 1, F.lit(block))
    return files.select(*keys, "content", F.explode(starts).alias("idx")).select(*keys, "idx", data.alias("data")).select(*keys, "idx", F.octet_length("data").cast("long").alias("raw_len"), "data")


def with_hashes(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("hash", sha256("data"))


def pieces_of(full: str, average: int, least: int, most: int) -> Iterator[bytes]:
    """A file's chunks, holding little more than one at a time: bytes are read up to a full chunk and cut, the rest is kept."""
    at, held = 0, b""
    with open(full, "rb") as f:
        while True:
            while len(held) < most + READ_SIZE and (data := f.read(READ_SIZE)):
                held += data
            if not held:
                return
            n = cuts(held, average, least, most, READ_SIZE, at % READ_SIZE)[0]
            yield held[:n]
            at, held = at + n, held[n:]


def packed(files: DataFrame, average: int, least: int, most: int, root: str | None = None) -> DataFrame:
    """In one read of each file its chunks, hashed and compressed, and then a row about the file; an empty file has that alone.

    files: (path, bytes, mtime_ticks), and content, or with ``root`` to be read below it, however large, a chunk at a time.
    A chunk's row has idx, hash, raw_len, stored_len and data; the file's has bytes, mtime_ticks, file_hash (of its bytes) and
    snapshot_file_hash (of its path, size and bytes). A file that no longer has the listed size is an error.
    """
    check_sizes(average, least, most)
    names = [c.split()[0] for c in PACKED.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def parts(data: bytes) -> Iterator[bytes]:
        at = 0
        for n in cuts(data, average, least, most):
            yield data[at : at + n]
            at += n

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            for k in range(batch.num_rows):
                path, size, ticks = (batch.column(c)[k].as_py() for c in range(3))
                found = parts(batch.column(3)[k].as_py() or b"") if root is None else pieces_of(os.path.join(root, path), average, least, most)
                own, whole, n = hashlib.sha256(), hashlib.sha256(f"{path}\n{size}\n".encode("utf-8", "surrogateescape")), 0
                for idx, data in enumerate(found):
                    own.update(data)
                    whole.update(data)
                    n += len(data)
                    small = press.compress(data)
                    yield path, idx, hashlib.sha256(data).hexdigest().upper(), len(data), len(small), small, None, None, None, None
                if n != size:
                    raise RuntimeError(f"{path} changed while it was read: {size} bytes listed, {n} read")
                yield path, None, None, None, None, None, size, ticks, own.hexdigest().upper(), whole.hexdigest().upper()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in rows(batches):
            held.append(row)
            size += len(row[5] or b"")
            if size >= 16 << 20 or len(held) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], schema=schema)

    columns = ["path", "bytes", "mtime_ticks"] + ["content"] * (root is None)
    return files.select(*columns).mapInArrow(pack, PACKED)
