"""Substring dedup: words of passages that occur elsewhere are removed.

A window is ``n`` consecutive words of one document; a word goes if it is covered by a window whose words
also start anywhere else, in the same document or another. Windows are judged on the input.

First pass, a count-min sketch: each block of documents makes a sketch of its own, its cells' counts, up to two; the blocks'
sketches are added up slice by slice, each slice in a shard, and the least that a cell says is never below the number of places
where the window occurs. The sketch is as large as the input asks for, for no task, and not the driver, holds more than a slice.
To count a fourteenth as many things, a window is counted by its anchor, the least hash among its 8-word
grams: equal windows at different places have their anchors at different places, so the anchor's count is
an overestimate too. Second pass: only windows estimated at two or more are grouped, by 96 bits of hash, and
found to be repeated or not exactly; no window is lost.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import WordHashes, cut, distinct, mix, texts
from stratum.llm.exchange import answers_of, blocks_of, finished, frame, n_shards, parts, split, split_high

WINDOW = 35
GRAM = 8
U = np.uint64
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)  # odd numbers; any would do
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(b: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """b^i and b^-i modulo 2^64 for i below n at least."""
    if b not in _powers or len(_powers[b][0]) < n:
        size = 1 << (n - 1).bit_length()
        _powers[b] = tuple(np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, x, U)])) for x in (b, pow(b, -1, 1 << 64)))
    up, down = _powers[b]
    return up[:n], down[:n]


def rolling(h: np.ndarray, n: int, b: int) -> np.ndarray:
    """A 64-bit hash of each n words in a row: sum of h[p + j] b^j, mixed."""
    if len(h) < n:
        return np.empty(0, U)
    up, down = powers(b, len(h))
    sums = np.concatenate([np.zeros(1, U), np.cumsum(h * up, dtype=U)])
    return mix((sums[n:] - sums[:-n]) * down[: len(h) - n + 1])


def sliding(x: np.ndarray, n: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) over each n values in a row."""
    k = 1
    while 2 * k <= n:
        x = least(x[:-k], x[k:])
        k *= 2
    return least(x[: len(x) - (n - k)], x[n - k :]) if n > k else x


class Block:
    """The windows of some documents in a row."""

    def __init__(self, h: np.ndarray, sizes: np.ndarray, n: int, gram: int):
        self.h, self.n = h, n
        self.ends = np.cumsum(sizes)
        self.count = max(0, len(h) - n + 1)
        left = np.repeat(self.ends, sizes)[: self.count] - np.arange(self.count)  # words of the document from here on
        self.valid = left >= n
        if not self.count:
            self.least = np.empty(0, U)
            return
        span = n - gram + 1
        grams = rolling(h, gram, MULTIPLIERS[0])
        self.least = sliding(grams, span, np.minimum)[: self.count]  # each window's anchor
        self.grams, self.span = grams, span

    def anchors(self) -> np.ndarray:
        """Hashes of the grams that are the least of some window, one for each place."""
        if not self.count:
            return self.least
        edge = np.zeros(self.span - 1, U)
        most = sliding(np.concatenate([edge, np.where(self.valid, self.least, U(0)), edge]), self.span, np.maximum)
        return self.grams[(self.grams == most[: len(self.grams)]) & (most[: len(self.grams)] > 0)]

    def keys(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits for the windows at the places ``at``."""
        one = rolling(self.h, self.n, MULTIPLIERS[1])[at]
        return one, (rolling(self.h, self.n, MULTIPLIERS[2])[at] >> U(32)).astype(np.uint32)


def cells(anchors: np.ndarray, shards: int, bits: int) -> np.ndarray:
    """An anchor's cell in the sketch: 2^bits cells in each shard's slice, the shard above them."""
    x = mix(anchors ^ U(MULTIPLIERS[1]))
    shard = ((x >> U(32)) * U(shards)) >> U(32)
    return shard << U(32) | (x & U((1 << bits) - 1))


def read(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in a row; the texts' numbers of words."""
    hashes, h, sizes = WordHashes(), [], []
    for b in found:
        words = b.split()
        sizes.append(len(words))
        h.append(hashes.array(words))
    return np.concatenate(h) if h else np.empty(0, U), np.array(sizes, np.int64)


def sketch(blocks: DataFrame, shards: int, bits: int, window: int, gram: int) -> DataFrame:
    """(block, flags): for each of the block's distinct cells in order a bit, whether all blocks' sketches together count two there, or more."""

    def ask(table):
        block = Block(*read(texts(table["text"].combine_chunks())), window, gram)
        found, n = np.unique(cells(block.anchors(), shards, bits), return_counts=True)
        for k, a, b in split_high(found):
            yield k, frame(found[a:b].astype(np.uint32).tobytes(), np.packbits(n[a:b] > 1).tobytes())

    def add(blobs):
        asked = [parts(b) for b in blobs]
        own = [np.frombuffer(x, np.uint32) for x, _ in asked]
        found, back, n = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        twice = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=len(x)) for x, (_, b) in zip(own, asked, strict=True)])
        total = n + np.bincount(back, twice, len(found))  # two or more count as two in a block's sketch
        return [np.packbits(x).tobytes() for x in np.split((total > 1)[back], np.cumsum([len(x) for x in own])[:-1])], None

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by("dest")
        return pa.table({"block": table["block"][:1], "flags": pa.array([frame(*(x.as_py() for x in table["blob"]))], pa.binary())})

    return answers_of(blocks, shards, ask, add).groupBy("block").applyInArrow(join, "block long, flags binary")


def remove(docs: DataFrame, window: int = WINDOW, cell_bits: int = 32, block_bytes: int = 8 << 20, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, n_words, n_removed and kept (UTF-8, the kept words joined by one space) for every row of ``docs``.

    2^cell_bits: the cells in each slice of the sketch, of which there is one for 16 MB of text. Null and empty texts, and texts
    shorter than a window, keep what they have; equal rows remove each other's words; other columns play no part; an empty table
    gives an empty result. Both the sketch and the second pass cover all windows of all texts whole.
    """
    gram, shards = min(GRAM, window), n_shards(docs)
    blocks = blocks_of(docs, block_bytes)
    flags = cut(sketch(blocks, shards, cell_bits, window, gram))
    small = (flags.agg(F.sum(F.octet_length("flags"))).first()[0] or 0) <= broadcast_bytes
    blocks = blocks.join(F.broadcast(flags) if small else flags, "block", "left")

    def repeated(block: Block, flags: bytes | None) -> np.ndarray:
        """Places of windows that the sketch puts at two or more."""
        at = np.flatnonzero(block.valid)
        if not len(at):
            return at
        mine = distinct(cells(block.anchors(), shards, cell_bits))
        hit = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n - m) for b, (_, m, n) in zip(parts(flags), split_high(mine), strict=True)]).astype(bool)
        return at[hit[np.searchsorted(mine, cells(block.least[at], shards, cell_bits))]]

    def packed(h, sizes, flags):
        """The block's candidates: places, order by key, first place in order of each key, keys."""
        block = Block(h, sizes, window, gram)
        at = repeated(block, flags)
        one, two = block.keys(at)
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        new = np.ones(len(at), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        return at, order, new, one, two

    def ask(table, flags):
        _, _, new, one, two = packed(*read(texts(table["text"].combine_chunks())), flags)
        first = np.flatnonzero(new)
        twice = np.diff(np.append(first, len(new))) > 1
        one, two = one[first], two[first]
        for k, a, b in split(one, shards):
            yield k, np.int64(b - a).tobytes() + one[a:b].tobytes() + two[a:b].tobytes() + np.packbits(twice[a:b]).tobytes()

    def answer(blobs):
        sizes = [int(np.frombuffer(b, np.int64, 1)[0]) for b in blobs]
        one = np.concatenate([np.frombuffer(b, U, m, 8) for b, m in zip(blobs, sizes, strict=True)])
        two = np.concatenate([np.frombuffer(b, np.uint32, m, 8 + 8 * m) for b, m in zip(blobs, sizes, strict=True)])
        hit = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8, -1, 8 + 12 * m), count=m) for b, m in zip(blobs, sizes, strict=True)]).astype(bool)
        order = np.lexsort((two, one))
        same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
        more = np.zeros(len(order), bool)
        more[1:] |= same
        more[:-1] |= same
        hit[order[more]] = True
        # a key counted twice within one block is told so by that block alone, which is enough: others have it in two places
        return [np.packbits(x).tobytes() for x in np.split(hit, np.cumsum(sizes)[:-1])], None

    def finish(table, answers, flags):
        found = texts(table["text"].combine_chunks())
        h, sizes = read(found)
        at, order, new, one, _ = packed(h, sizes, flags)
        asked = split(one[np.flatnonzero(new)], shards)
        hit = np.concatenate([np.empty(0, np.uint8), *(np.unpackbits(np.frombuffer(b, np.uint8), count=n - m) for b, (_, m, n) in zip(answers, asked, strict=True))]).astype(bool)
        gone = np.zeros(len(h) + 1, np.int32)
        places = at[order[hit[np.cumsum(new) - 1]]] if len(at) else at
        np.add.at(gone, places, 1)
        np.add.at(gone, places + window, -1)
        keep = np.cumsum(gone)[:-1] == 0
        ends = np.cumsum(sizes)
        kept, removed = [], []
        for b, start, end in zip(found, ends - sizes, ends, strict=True):
            mine = keep[start:end]
            n = int(mine.sum())
            removed.append(int(end - start) - n)
            words = b.split()
            kept.append(b" ".join(words if n == end - start else compress(words, mine)))
        return pa.table({"doc_id": table["doc_id"], "n_words": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return finished(blocks, answers_of(blocks, shards, ask, answer), finish, f"doc_id {kind}, n_words long, n_removed long, kept binary")


#: The same by counting all windows, for the correctness check.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) k FROM d, unnest(range(1, len(w) - 33)) t(i) WHERE len(w) >= 35),
rep AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM win JOIN rep USING (k), unnest(range(0, 35)) t(j)),
word AS (SELECT doc_id, i, w[i] s FROM d, unnest(range(1, len(w) + 1)) t(i)),
kept AS (SELECT doc_id, count(*) n, string_agg(s, ' ' ORDER BY i) t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT n_words, (len(w) - coalesce(n, 0))::BIGINT n_removed, sha256(coalesce(t, '')) kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
