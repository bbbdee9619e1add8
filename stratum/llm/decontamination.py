"""Benchmark decontamination: short test items found inside long documents.

A document holds an item if at least ``least`` percent of the item's distinct 5-word shingles are
among the document's (words with A-Z lowered; an item of fewer words is one shingle of all its words).
Documents are far longer than items, so resemblance of the whole sets says nothing; the search is for
containment. Items are partitioned by size (powers of two of their shingle counts), and each partition has
an index and a threshold of its own. With at most u shingles an item's MinHash signature is its
floor((1 - least) u) + r smallest shingle hashes: a document that holds the item lacks floor((1 - least) u) of it at
most, so it has r of the signature at least, r growing with the partition's u, and no item is missed while
a few common shingles make no candidate. Candidates are verified on the words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stratum.llm.common import WordHashes, chunks, distinct, named, shingle_hashes

WORDS = 5
BITS = 22


def shingles(words: list[bytes], n: int) -> set[bytes]:
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


class Partition:
    """Items of like size: the hashes of their signatures in order, the items they are of, and how many of its an item asks for."""

    def __init__(self, upper: int, least: int):
        self.upper, self.more = upper, max(1, upper // 16)
        self.length = (100 - least) * upper // 100 + self.more
        self.parts: list[tuple[np.ndarray, int]] = []
        self.needed: dict[int, int] = {}

    def add(self, own: np.ndarray, place: int, least: int) -> None:
        """An item's hashes in order. One with fewer than the signature's length has its whole set there."""
        part = own[: self.length]
        lacking = len(own) - -(-least * len(own) // 100)
        self.needed[place] = max(1, len(part) - lacking)
        self.parts.append((part, place))

    def close(self) -> None:
        keys = np.concatenate([p for p, _ in self.parts])
        places = np.repeat(np.array([k for _, k in self.parts], np.int32), [len(p) for p, _ in self.parts])
        order = np.argsort(keys, kind="stable")
        self.keys, self.places = keys[order], places[order]
        at = np.array(sorted(self.needed), np.int32)
        self.first, self.asked = int(at[0]), np.zeros(int(at[-1]) - int(at[0]) + 1, np.int32)
        self.asked[at - self.first] = [self.needed[k] for k in at.tolist()]
        del self.parts, self.needed

    def candidates(self, h: np.ndarray, docs: np.ndarray) -> Iterator[tuple[int, int]]:
        """(document, item) with enough of the item's signature; h, docs: hashes and whose they are, each pair once."""
        a, b = np.searchsorted(self.keys, h, "left"), np.searchsorted(self.keys, h, "right")
        n = b - a
        if not n.any():
            return
        which = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        pairs, found = np.unique(np.stack([np.repeat(docs, n), self.places[which]], 1), axis=0, return_counts=True)
        ok = found >= self.asked[pairs[:, 1] - self.first]
        yield from map(tuple, pairs[ok].tolist())


class Index:
    """Signatures of one block of items (item, text, how many rows are alike): about three bytes for each byte of text."""

    def __init__(self, items: list[tuple[int, bytes, int]], least: int):
        self.least, self.items, self.partitions = least, [], {}
        hashes = WordHashes()
        for item, text, rows in items:
            words = text.lower().split()
            if not words:
                continue
            n = min(WORDS, len(words))
            own = distinct(shingle_hashes(hashes.array(words), n))
            upper = 1 << (len(own) - 1).bit_length()
            self.partitions.setdefault((n, upper), Partition(upper, least)).add(own, len(self.items), least)
            self.items.append((item, n, b" ".join(words), rows))
        self.bits = {}
        for (n, _), p in self.partitions.items():
            p.close()
            self.bits.setdefault(n, np.zeros(1 << BITS, bool))[(p.keys >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def candidates(self, h: np.ndarray, ends: np.ndarray) -> dict[int, list[int]]:
        """document's place -> places of items with enough of their signature; h: word hashes of all documents in a row."""
        found = defaultdict(list)
        for n, bits in self.bits.items():
            s = shingle_hashes(h, n)
            at = np.flatnonzero(bits[(s >> np.uint64(64 - BITS)).astype(np.int64)])
            docs = np.searchsorted(ends, at, "right")
            ok = at + n <= ends[docs] if len(at) else at.astype(bool)
            pairs = np.unique(np.stack([docs[ok].astype(np.uint64), s[at[ok]]], 1), axis=0)
            for (m, _), p in self.partitions.items():
                if m == n and len(pairs):
                    for d, place in p.candidates(pairs[:, 1], pairs[:, 0].astype(np.int64)):
                        found[d].append(place)
        return found

    def verified(self, words: list[bytes], candidates: list[int]) -> Iterator[tuple[int, int, int]]:
        have = {n: shingles(words, n) for n in {self.items[c][1] for c in candidates}}
        for c in sorted(candidates):
            item, n, text, rows = self.items[c]
            own = shingles(text.split(b" "), n)
            shared = len(own & have[n])
            if 100 * shared >= self.least * len(own):
                yield from [(item, len(own), shared)] * rows


def indexes(items: DataFrame, least: int, block_bytes: int) -> Iterator[Index]:
    """Items in blocks of about ``block_bytes`` of text: more items mean more passes, not a larger broadcast. Equal rows are in a block once, counted."""
    items = items.select("item_id", "text").where(F.col("text").isNotNull()).groupBy("item_id", "text").agg(F.count("*").alias("rows"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        yield Index([(r[0], r[1].encode(), r[2]) for r in part.collect()], least)


def matches(index: Index, found: list[bytes], hashes: WordHashes) -> list[tuple[int, int, int, int]]:
    """(document's place, item, its shingles, those shared)"""
    words = [b.lower().split() for b in found]
    ends = np.cumsum([len(w) for w in words])
    h = np.concatenate([hashes.array(w) for w in words]) if words else np.empty(0, np.uint64)
    return [(d, *x) for d, c in sorted(index.candidates(h, ends).items()) for x in index.verified(words[d], c)]


def find(docs: DataFrame, items: DataFrame, least: int = 80, block_bytes: int = 8 << 20) -> DataFrame:
    """One row for each row of ``docs`` and row of ``items`` it holds: doc_id, item_id, n_item_shingles, n_shared, containment.

    Null or empty texts on either side match nothing; equal items or documents each give their rows; other columns
    play no part; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ids = [docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()]
    schema = f"doc_id {ids[0]}, item_id {ids[1]}, n_item_shingles long, n_shared long, containment double"
    out = None
    for index in indexes(items, least, block_bytes):
        shared_index = spark.sparkContext.broadcast(index)

        def search(batches, index=shared_index):
            hashes = WordHashes()
            for batch, found in chunks(batches):
                if rows := matches(index.value, found, hashes):
                    at, item, n, shared = (list(x) for x in zip(*rows, strict=True))
                    columns = [batch.column(0).take(pa.array(at)), pa.array(item), pa.array(n, pa.int64()), pa.array(shared, pa.int64()), pa.array([s / m for s, m in zip(shared, n, strict=True)])]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"])

        found = docs.select("doc_id", "text").mapInArrow(search, schema)
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, items: DataFrame, least: int = 80, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they are.

    Null and empty texts hold none; null and empty items are held by nothing; repeated rows are judged each for itself; an empty
    table gives an empty result, and without items all rows stay.
    """
    spark = docs.sparkSession
    for index in indexes(items, least, block_bytes):
        shared_index = spark.sparkContext.broadcast(index)

        def search(batches, index=shared_index):
            hashes = WordHashes()
            for batch, found in chunks(batches):
                hit = np.ones(len(found), bool)
                hit[[r[0] for r in matches(index.value, found, hashes)]] = False
                yield pa.RecordBatch.from_arrays([batch.column(0)], ["row"]).filter(pa.array(hit))

        df = docs.select(F.struct(*map(named, docs.columns)).alias("row"), "text")
        docs = df.mapInArrow(search, StructType([df.schema["row"]])).select("row.*")
    return docs


#: The same by plain joins, for the correctness check.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM benchmark WHERE text IS NOT NULL),
bs AS (SELECT DISTINCT item_id, least(5, len(w)) k, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') s FROM b, unnest(range(1, len(w) - least(5, len(w)) + 2)) t(i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM bs),
ds AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') s FROM d, ks, unnest(range(1, len(w) - k + 2)) t(i) WHERE len(w) >= k),
n AS (SELECT item_id, count(*) n FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n.n n_item_shingles, count(*) n_shared, count(*) / n.n::DOUBLE containment
FROM bs JOIN ds USING (k, s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n.n HAVING 100 * count(*) >= 80 * n.n
"""
