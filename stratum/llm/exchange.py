"""Questions from blocks of documents to shards of keys, and the answers back.

Some operators must ask, for each of a great many keys of each document, something about all documents
(how often does this window occur?). A row for each key would shuffle far more than the input. Here the documents
are first packed into numbered blocks (some megabytes of text each, compressed) in the checkpoint folder. A task then
makes of a block's distinct keys one binary for each shard; a shard, a slice of the hash space, sees each key once a
block at most, answers all blocks, and the answers meet their block again by its number. What comes back meets what
asked even if a lost task is run again, for blocks never change. A key that is in every document is one entry a block,
and a block asks only the shards that it has keys for: rows are never more than keys, and they grow
in proportion to the input once a block has fewer keys than there are shards. Memory: one block, or one shard's share, at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import cut, release, slices

ROWS = pa.schema([("dest", pa.int64()), ("block", pa.int64()), ("blob", pa.binary())])


def n_shards(docs: DataFrame, text_per_shard: int = 16 << 20) -> int:
    """Shards in proportion to the text, so that a shard's share stays the same size."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(8, -(-total // text_per_shard))


def pack(slices: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, slices[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as w:
        for s in slices:
            w.write_batch(s)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all().combine_chunks()


def press(x: np.ndarray) -> bytes:
    """Whole numbers of any size, small ones in few bytes: all first bytes, then all second ones."""
    kind = np.min_scalar_type(int(x.max(initial=0)))
    planes = x.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T
    return kind.char.encode() + zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpress(b: bytes) -> np.ndarray:
    kind = np.dtype(chr(b[0]))
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1).astype(np.int64)


def frame(*parts: bytes) -> bytes:
    return np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def parts(b: bytes) -> list[bytes]:
    n = int(np.frombuffer(b, np.int64, 1)[0])
    ends = np.cumsum(np.frombuffer(b, np.int64, n, 8)) + 8 + 8 * n
    return [b[i:j] for i, j in zip([8 + 8 * n, *ends], ends, strict=False)]


def blocks_of(docs: DataFrame, most: int) -> DataFrame:
    """(block, docs): the rows of ``docs`` (doc_id, text) in numbered blocks of about ``most`` bytes of text, kept in the checkpoint folder."""

    def packed(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([pack(held)], pa.binary())], ["block", "docs"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for part, n in slices(batches, most):
            if held and size + n > most:
                yield packed(number, held)
                number, held, size = number + 1, [], 0
            held.append(part)
            size += n
        if held:
            yield packed(number, held)
        release()

    return cut(docs.select("doc_id", "text").mapInArrow(gather, "block long, docs binary"))


def split(keys: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """(shard, begin, end) of each shard's share of sorted 64-bit keys, shards without a share left out."""
    bounds = np.array([(i << 64) // shards for i in range(shards)], np.uint64)
    edges = np.append(np.searchsorted(keys, bounds), len(keys))
    return [(int(k), int(edges[k]), int(edges[k + 1])) for k in np.flatnonzero(edges[1:] > edges[:-1])]


def split_high(x: np.ndarray) -> list[tuple[int, int, int]]:
    """The same for sorted values that have the shard in the bits above 32."""
    shard = (x >> np.uint64(32)).astype(np.int64)
    edges = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(x)).tolist()
    return [(int(shard[a]), a, b) for a, b in zip(edges, edges[1:], strict=False)]


def answers_of(blocks: DataFrame, shards: int, ask: Callable, answer: Callable) -> DataFrame:
    """(dest, block, blob): what the shards answer the blocks (block, docs, and maybe more binary columns).

    ask(table, *more): (shard, blob) for the shards that the block has keys for, in order of shard; table holds its documents.
    answer(blobs): the answers to one shard's blobs, in order, and a blob about the shard or None; that goes to block -1.
    """

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                number, docs, *more = (column[row].as_py() for column in batch.columns)
                blobs = [*ask(unpack(docs), *more)]
                for i in range(0, len(blobs), 64):
                    part = blobs[i : i + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in part]), pa.array([number] * len(part)), pa.array([b for _, b in part], pa.binary())], schema=ROWS)
                release()

    def answers(table: pa.Table) -> pa.Table:
        dest = table["dest"][0].as_py()
        told, about = answer([x.as_py() for x in table["blob"]])
        release()
        numbers = table["block"].to_pylist()
        if about is not None:
            told, numbers = [*told, about], [*numbers, -1]
        return pa.table([pa.array([dest] * len(told)), pa.array(numbers), pa.array(told, pa.binary())], schema=ROWS)

    rows = "dest long, block long, blob binary"
    return blocks.mapInArrow(asks, rows).groupBy("dest").applyInArrow(answers, rows)


def finished(blocks: DataFrame, answers: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """``finish``'s rows for all blocks and the answers to them.

    finish(table, answers, *more): the block's rows, from its documents and the answers of the shards that it asked, in order.
    finish(None, blobs): rows from what the shards told of themselves.
    """
    more = blocks.columns[2:]

    def finishes(table: pa.Table) -> pa.Table:
        table = table.sort_by("dest")
        blobs = table["blob"]
        if table["block"][0].as_py() < 0:
            return finish(None, [x.as_py() for x in blobs])
        out = finish(unpack(blobs[0].as_py()), [x.as_py() for x in blobs.slice(1)], *(table[c][0].as_py() for c in more))
        release()
        return out

    own = blocks.select(F.lit(-1).cast("long").alias("dest"), "block", F.col("docs").alias("blob"), *more)
    told = answers.select("dest", "block", "blob", *(F.lit(None).cast("binary").alias(c) for c in more))
    return own.unionByName(told).groupBy("block").applyInArrow(finishes, schema)


def exchange(docs: DataFrame, block_bytes: int, shards: int, ask: Callable, answer: Callable, finish: Callable, schema: str) -> DataFrame:
    """``finish``'s rows for ``docs`` (doc_id, text) in blocks of ``block_bytes``; see above."""
    blocks = blocks_of(docs, block_bytes)
    return finished(blocks, answers_of(blocks, shards, ask, answer), finish, schema)
