"""N-gram Jaccard join: documents whose shingle sets are nearly equal, and their components.

A document's set holds its distinct ``words``-word shingles (A-Z lowered); two documents link when
100 |A and B| >= least |A or B|. Equal sets are one class, searched once. Then:

1. Rare prefixes. Blocks of documents ask shards of the hash space how many documents have each of their shingles. With
   shingles in order of that count, rare ones first, linked sets have one in common among the first |A| - ceil(least |A|) + 1
   of each, whatever the order; passages that many documents share come last. A set whose prefix holds only shingles
   of its own has no partner and is done with.
2. Clusters. Sets that share a prefix shingle and may be partners by size are tied to the smallest among them: within a block
   at once, across blocks in a shard, which gets each shingle once a block. Components of these ties are clusters;
   linked sets are in one cluster, and pairs are never written out.
3. T-occurrence search. A cluster's sets come together - many small clusters at once, a large one as pairs of blocks
   of bounded size - and each set queries an inverted index by DivideSkip: of its shingles' lists the longest are put
   aside, the short ones heap-merged, and what occurs often enough there is probed for in the long ones by binary search.
   Every document that reaches the overlap is a link. Links are counted where they are found: a class's counts are added
   up over its block pairs, and only the links that connect leave their block.
4. The links found join the classes, and the classes their documents.
"""

from __future__ import annotations

from bisect import bisect_left
from heapq import merge
from itertools import groupby
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import WordHashes, beside, cut, distinct, mix, release, shingle_hashes, texts
from stratum.llm.components import components
from stratum.llm.exchange import exchange, frame, n_shards, parts, press, split, split_high, unpress

U = np.uint64
M64 = (1 << 64) - 1
#: A class of more than this part of all rows is joined by a broadcast, so at most as many classes are.
HOT = 10_000
KEY = ["h1", "h2", "n"]


def up(n, least: int):
    """ceil(least % of n)"""
    return -(-n * least // 100)


def intervals(upto: int, least: int) -> list[int]:
    """Last sizes of the intervals 0, 1, ... up to one that has ``upto``: a set's partners are in its own or a neighbour."""
    out, first = [0], 1
    while out[-1] < upto:
        out.append(first * 100 // least)
        first = out[-1] + 1
    return out


def shingle_set(text: bytes, hashes: WordHashes, words: int) -> np.ndarray:
    """The set's hashes in order; a text of fewer words is one shingle of all of them, one of none has none."""
    h = hashes.array(text.lower().split())
    return distinct(shingle_hashes(h, min(words, len(h)))) if len(h) else h


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits of the set's sum, as two signed longs."""
    with np.errstate(over="ignore"):
        return int(mix(s ^ U(0x51)).sum(dtype=U).astype(np.int64)), int(mix(s ^ U(0xA3)).sum(dtype=U).astype(np.int64))


def steps(n: np.ndarray) -> np.ndarray:
    """Counts as one byte each: as they are up to 16, then an eighth of an octave a step."""
    return np.where(n <= 16, n, np.minimum(255, 16 + np.floor(8 * (np.log2(np.maximum(n, 1)) - 4)))).astype(np.uint8)


def prefix_of(s: np.ndarray, counts: np.ndarray, least: int) -> np.ndarray:
    """Of the set's first |s| - ceil(least |s|) + 1 shingles, rare ones first, those that other documents may have too."""
    m = len(s) - up(len(s), least) + 1
    if np.count_nonzero(counts < 2) >= m:
        return s[:0]
    first = np.lexsort((s, counts))[:m]
    return s[first[counts[first] > 1]]


def sets_of(found: list[bytes], words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct texts' sets, and which of them each text has."""
    hashes, place = WordHashes(), {}
    at = np.array([place.setdefault(xxhash.xxh3_128_digest(b), len(place)) for b in found], np.int64)
    first = np.unique(at, return_index=True)[1]
    return [shingle_set(found[i], hashes, words) for i in first.tolist()], at


def prefixes(docs: DataFrame, words: int, least: int, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n (set size), h1, h2 (the set's hash) for every row; for some row at least of a set that may have partners its
    prefix (tokens) and all its shingles (hashes), as bytes.

    Counts are asked for by 32 bits below the shard's: shingles alike in these are ordered by their common count, which
    is as good as any order that is the same everywhere.
    """
    bits = (n_shards(docs) - 1).bit_length()
    low = U(32 - bits)

    def ask(table):
        sets, _ = sets_of(texts(table["text"].combine_chunks()), words)
        k, n = np.unique(np.concatenate([np.empty(0, U), *sets]) >> low, return_counts=True)
        for shard, a, b in split_high(k):
            yield shard, frame(k[a:b].astype(np.uint32).tobytes(), press(n[a:b]))

    def answer(blobs):
        asked = [parts(b) for b in blobs]
        keys = [np.frombuffer(k, np.uint32) for k, _ in asked]
        found, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = steps(np.bincount(back, np.concatenate([unpress(n) for _, n in asked]), len(found)))
        return [press(x) for x in np.split(total[back], np.cumsum([len(k) for k in keys])[:-1])], None

    def finish(table, answers):
        sets, at = sets_of(texts(table["text"].combine_chunks()), words)
        k = distinct(np.concatenate([np.empty(0, U), *sets]) >> low)
        counts = np.concatenate([np.empty(0, np.int64), *map(unpress, answers)])
        short = [prefix_of(s, counts[np.searchsorted(k, s >> low)], least) for s in sets]
        both = [set_hash(s) for s in sets]
        first = np.zeros(len(at), bool)
        first[np.unique(at, return_index=True)[1]] = True
        told = [i if new and len(short[i]) else None for i, new in zip(at.tolist(), first.tolist(), strict=True)]
        blob = lambda x: pa.array([None if i is None else x[i].tobytes() for i in told], pa.binary())
        sizes, h1, h2 = (np.array(x, np.int64)[at] for x in ([len(s) for s in sets], [a for a, _ in both], [b for _, b in both]))
        return pa.table({"doc_id": table["doc_id"], "n": sizes, "h1": h1, "h2": h2, "tokens": blob(short), "hashes": blob(sets)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return exchange(docs, block_bytes, 1 << bits, ask, answer, finish, f"doc_id {kind}, n long, h1 long, h2 long, tokens binary, hashes binary")


def search(sets: list[np.ndarray], order: list[int], indexed: int | None, least: int) -> list[tuple[int, int]]:
    """All links, each once: places of ``sets``, found by DivideSkip.

    order: places by size, equal sizes in any fixed order. indexed: None to join all with all, or the number of places (the first) that
    are indexed, the rest being queries. Each document is looked up among those before it in ``order``.
    """

    def look(place: int, lists: dict, at: list[int], sizes: list[int]) -> None:
        own = sets[place]
        a = len(own)
        t = up(a, least)
        lowest = bisect_left(sizes, t)  # partners have at least t shingles
        if lowest == len(sizes):
            return
        # no larger partner comes before this one in order; lists hold ranks in order
        mine = sorted((x for h in own.tolist() if (x := lists.get(h)) and x[-1] >= lowest), key=len)
        if len(mine) < t:
            return
        aside = min(t - 1, int(t / (0.02 * log2(len(mine[-1]) + 1) + 1)))
        short, long_ = mine[: len(mine) - aside], mine[len(mine) - aside :]
        tails = [x[bisect_left(x, lowest) :] if x[0] < lowest else x for x in short]
        for r, same in groupby(merge(*tails)):
            n = sum(1 for _ in same)
            if n < t - aside:
                continue
            other = at[r]
            most = len(long_)
            asked = -(-least * (a + sizes[r]) // (100 + least))  # the overlap that the two sizes ask for
            for x in long_:
                if n + most < asked or n >= asked:
                    break
                most -= 1
                i = bisect_left(x, r)
                n += i < len(x) and x[i] == r
            if n + most >= asked and 100 * n >= least * (a + sizes[r] - n):
                links.append((place, other))

    links: list[tuple[int, int]] = []
    if indexed is None:
        lists, at, sizes = {}, [], []
        for place in order:
            look(place, lists, at, sizes)
            for h in sets[place].tolist():
                lists.setdefault(h, []).append(len(at))
            at.append(place)
            sizes.append(len(sets[place]))
        return links
    for queries_first in (False, True):  # a smaller query against larger ones, then the other way round
        lists, at, sizes = {}, [], []
        for place in order:
            if (place < indexed) == queries_first:
                look(place, lists, at, sizes)
            else:
                for h in sets[place].tolist():
                    lists.setdefault(h, []).append(len(at))
                at.append(place)
                sizes.append(len(sets[place]))
    return links


def connecting(links: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Those of the links between places 0 to n - 1 that connect what all of them connect."""
    root, out = list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in links:
        if (x := find(a)) != (y := find(b)):
            root[x] = y
            out.append((a, b))
    return out


def forest(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same connections as ``pairs`` by one tie for each id, to the smallest that it reaches."""
    nodes, at = np.unique(pairs, return_inverse=True)
    at, root = at.reshape(-1, 2), np.arange(len(nodes))
    while len(at):
        least = root[at].min(1)
        before = root.copy()
        for k in range(2):
            np.minimum.at(root, root[at[:, k]], least)
            np.minimum.at(root, at[:, k], least)
        root = root[root]
        if (root == before).all():
            break
    tied = root != np.arange(len(nodes))
    return nodes[tied], nodes[root[tied]]


def tied(tokens: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens in order with their smallest id; ties of the other ids to it."""
    order = np.lexsort((ids, tokens))
    tokens, ids = tokens[order], ids[order]
    new = np.ones(len(tokens), bool)
    new[1:] = tokens[1:] != tokens[:-1]
    hub = ids[np.flatnonzero(new)][np.cumsum(new) - 1] if len(ids) else ids
    other = ids != hub
    return tokens[new], ids[new], np.stack([ids[other], hub[other]], 1)


def by_size(tokens: np.ndarray, n: int, ends: list[int]) -> np.ndarray:
    """A set's tokens for its own interval of sizes and for the next: sets that are too unlike in size have none in common."""
    k = bisect_left(ends, n)
    return np.concatenate([mix(tokens ^ U(g * 0x9E3779B97F4A7C15 & M64)) for g in (k, k + 1)])


def ties(sets: DataFrame, least: int, block_tokens: int = 1 << 19, shard_tokens: int = 1 << 21) -> DataFrame:
    """(a, b): ties that connect all sets (node, n, tokens) with a token in common that may be partners by size."""
    total = sets.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    shards = max(8, -(-total // (4 * shard_tokens)))  # 8 bytes a token, each twice

    def send(batches):
        task, ends = TaskContext.get().partitionId(), intervals(1 << 20, least)

        def packed(tokens, ids):
            t, i, pairs = tied(np.concatenate(tokens), np.concatenate(ids))
            a, b = forest(pairs)
            rows = [(k, np.int64(y - x).tobytes() + t[x:y].tobytes() + i[x:y].tobytes()) for k, x, y in split(t, shards)]
            rows += [(shards + task, np.int64(len(a)).tobytes() + a.tobytes() + b.tobytes())] * bool(len(a))
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["dest", "blob"])

        tokens, ids, size = [], [], 0
        for batch in batches:
            for node, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n > ends[-2]:
                    ends = intervals(2 * n, least)
                tokens.append(by_size(np.frombuffer(blob, U), n, ends))
                ids.append(np.full(len(tokens[-1]), node, np.int64))
                size += len(tokens[-1])
                if size >= block_tokens:
                    yield packed(tokens, ids)
                    tokens, ids, size = [], [], 0
        if tokens:
            yield packed(tokens, ids)

    def meet(table: pa.Table) -> pa.Table:
        raw = [x.as_py() for x in table["blob"]]
        n = [int(np.frombuffer(b, np.int64, 1)[0]) for b in raw]
        one = np.concatenate([np.frombuffer(b, U, m, 8) for b, m in zip(raw, n, strict=True)])
        two = np.concatenate([np.frombuffer(b, np.int64, m, 8 + 8 * m) for b, m in zip(raw, n, strict=True)])
        a, b = forest(tied(one, two)[2] if table["dest"][0].as_py() < shards else np.stack([one.view(np.int64), two], 1))
        del raw, one, two
        release()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    sent = sets.select("node", "n", "tokens").mapInArrow(send, "dest long, blob binary")
    return sent.groupBy("dest").applyInArrow(meet, "a long, b long").distinct()


def repeated_ids(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): classes that rows with the same id are in."""
    more = cut(signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"))
    rows = signed.where("n > 0").join(more, "doc_id", "left_semi").select("doc_id", *KEY).distinct().join(classes.select(*KEY, "node"), KEY)
    hubs = rows.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b < most").select("doc_id", "b")
    return rows.join(hubs, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b")


def search_groups(sets: DataFrame, clusters: DataFrame, block_docs: int, block_shingles: int) -> DataFrame:
    """``sets`` (node, n, ...) of ``clusters`` (node, cluster), a row for each group (g, i, j) in which they are searched; own: the set's block.

    Small clusters share groups; a large one is all pairs of its blocks. What is joined by cluster is whole numbers only.
    """
    placed = cut(sets.select("node", "n").join(clusters, "node"))
    sizes = placed.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("docs") / block_docs), F.ceil(F.col("shingles") / block_shingles)).cast("int")
    large = cut(sizes.withColumn("blocks", blocks).where("blocks > 1").select("cluster", "blocks"))
    large = F.broadcast(large) if large.count() <= 200_000 else large
    total = placed.agg(F.count("*"), F.sum("n")).first()
    bins = max(1, (total[1] or 0) * 2 // block_shingles, total[0] * 2 // block_docs)
    placed = placed.select("node", "cluster").join(large, "cluster", "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("node"), F.col("blocks")), F.lit(0)).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.col("cluster").alias("g"), F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    alone = F.array(F.struct((-1 - F.pmod(F.xxhash64("cluster"), F.lit(bins))).alias("g"), F.lit(0).alias("i"), F.lit(0).alias("j")))
    placed = placed.select("node", "own", F.when(F.col("blocks") > 1, pairs).otherwise(alone).alias("groups"))
    return sets.join(placed, "node").withColumn("x", F.explode("groups")).select(*sets.columns, "own", "x.*")


def join(docs: DataFrame, words: int = 5, least: int = 80, block_docs: int = 600, block_shingles: int = 1_000_000, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links, itself included), class_size and n_links (other rows it links with, those of equal sets included) for every row.

    Null and empty texts have no shingles and link with nothing, not even each other. Rows of equal sets are linked; rows
    that repeat an id are one document, linked through it; ids may be of any type that has an order. Rows with a null id
    link like others but do not name a component; where all ids of a component are null, so is its name. Other columns play no part; an
    empty table gives an empty result. No partner or candidate is dropped at any size: clusters beyond ``block_docs`` or
    ``block_shingles`` are searched as all pairs of their blocks.
    """
    signed = cut(prefixes(docs, words, least))
    classes = signed.where("n > 0").groupBy(*KEY).agg(F.min("doc_id").alias("rep"), F.count("*").alias("class_size"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    sets = cut(signed.where("hashes IS NOT NULL").select(*KEY, "tokens", "hashes").dropDuplicates(KEY).join(classes.select(*KEY, "node", "class_size"), KEY).drop("h1", "h2"))
    clusters = cut(components(ties(sets, least)).withColumnRenamed("component", "cluster"))
    grouped = search_groups(sets.drop("tokens"), clusters, block_docs, block_shingles)

    def linked(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        rows = sorted(zip(*(table[c].to_pylist() for c in ("own", "node", "class_size", "hashes")), strict=True), key=lambda r: (r[0] != i, r[1]))
        found = [np.frombuffer(r[3], U) for r in rows]
        order = sorted(range(len(rows)), key=lambda k: (len(found[k]), k))
        links = search(found, order, None if i == j else sum(r[0] == i for r in rows), least)
        counts = [0] * len(rows)
        for x, y in links:
            counts[x] += rows[y][2]
            counts[y] += rows[x][2]
        links, some = connecting(links, len(rows)), [k for k, n in enumerate(counts) if n]
        release()
        node = lambda places: [rows[k][1] for k in places]
        a, b = node(x for x, _ in links) + node(some), node(y for _, y in links) + [None] * len(some)
        n = [None] * len(links) + [counts[k] for k in some]  # a link, or a class and its count
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n_links": pa.array(n, pa.int64())})

    links = cut(grouped.groupBy("g", "i", "j").applyInArrow(linked, "a long, b long, n_links long"))
    counts = links.where("n_links IS NOT NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n_links").alias("others"))
    joined = cut(components(links.where("n_links IS NULL").select("a", "b").unionAll(repeated_ids(signed, classes))))
    names = cut(classes.join(joined, "node").groupBy("component").agg(F.min("rep").alias("name")))
    told = classes.join(counts, "node", "left").join(beside(joined, names, ["component"], ["node"], salts=8), "node", "left")
    told = cut(told.select(*KEY, "class_size", F.coalesce("name", "rep").alias("component_id"), (F.col("class_size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))

    rows, many = signed.select("doc_id", *KEY), max(1, signed.count() // hot)
    large = F.broadcast(told.where(F.col("class_size") > many))  # fewer than ``hot`` rows
    some = rows.where("n > 0").join(told.where(F.col("class_size") > many).select(*KEY).hint("broadcast"), KEY, "left_anti").join(told.where(F.col("class_size") <= many), KEY)
    none = rows.where("n = 0").select(*rows.columns, F.lit(1).cast("long").alias("class_size"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    out = rows.where("n > 0").join(large, KEY).unionByName(some).unionByName(none)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "class_size", "n_links")


#: The query's rows by plain joins, for the correctness check.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') x FROM d, unnest(range(1, len(w) - least(3, len(w)) + 2)) t(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
z AS (SELECT s.doc_id, x, n FROM s JOIN n USING (doc_id)),
p AS (SELECT a.doc_id a, b.doc_id b, a.n na, b.n nb, count(*) m FROM z a JOIN z b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b, na = nb AND m = na same FROM p WHERE 100 * m >= 90 * (na + nb - m)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id),
c AS (SELECT doc_id, min(c) component_id FROM r GROUP BY doc_id),
k AS (SELECT a doc_id, count(*) n_links, count(*) FILTER (same) copies FROM l GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT n_shingles, component_id, 1 + coalesce(copies, 0) class_size, coalesce(n_links, 0) n_links
FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""
