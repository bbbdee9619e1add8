"""Language-model scores by deleted interpolation.

The model mixes maximum-likelihood estimates of bigrams and unigrams with a uniform one:

    P(w | v) = a2 c(v, w) / c(v) + a1 c(w) / N + a0 / (V + 1)

with weights a by bucket of the context's count (its power of two). The weights are learned by
expectation-maximisation on held-out counts, each training token held out in turn: its bigram, context
and word are counted less one, as the deleted estimate asks. A text's tokens are its words (A-Z lowered)
and an end; the context of the first token is a start that is in no vocabulary.

Counts come from all training texts by a block exchange: a block of documents asks the shards for the
totals of its words and bigrams, bringing its own. The answered blocks are written to the checkpoint folder
with each token's and bigram's counts; from them come, in one small table each, N and V, and how many training
tokens share a bucket, a bigram ratio and a word count (to a quarter of an octave), on which the weights
are learned. Nothing is cut off or sampled, and no table of words goes to the driver or to all executors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import crc_mod, cut, mix, texts
from stratum.llm.exchange import exchange, frame, n_shards, pack, parts, press, split, unpack, unpress

U = np.uint64
START = U(0x5374617274)  # stands for the hash of the context before the first word
BUCKETS = 48
#: Steps of a quarter of an octave for ratios (down to 2^-40) and word counts (up to 2^48); 0 stands for none.
STEPS = 200


def octaves(x: np.ndarray) -> np.ndarray:
    """0 for x <= 0, else one more than the nearest quarter octave above zero."""
    out = np.zeros(len(x), np.int64)
    ok = x > 0
    out[ok] = np.minimum(STEPS - 1, 1 + np.rint(4 * np.abs(np.log2(x[ok]))).astype(np.int64))
    return out


def bucket(c: np.ndarray) -> np.ndarray:
    """0 for a context that was not seen, else one more than the power of two in its count."""
    return np.minimum(BUCKETS - 1, np.frexp(c.astype(float))[1])


class Places(dict):
    """word -> its place in a block's vocabulary"""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Block:
    """A block's tokens as places in its vocabulary, and its distinct words and bigrams as hashes."""

    def __init__(self, found: list[bytes]):
        places, parts, sizes = Places({b"": 0}), [], []  # no word is empty: that place is the end's
        for b in found:
            words = b.lower().split()
            sizes.append(len(words) + 1)
            parts.append(np.fromiter(map(places.__getitem__, words), np.int32, len(words)))
            parts.append(np.zeros(1, np.int32))
        self.sizes = np.array(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        self.token = np.concatenate(parts) if parts else np.empty(0, np.int32)
        self.hashes = mix(np.fromiter(map(xxhash.xxh3_64_intdigest, places), U, len(places)))
        before = np.empty(len(self.token), np.int64)
        before[1:] = self.token[:-1]
        before[self.ends - self.sizes] = len(places)  # the start
        self.pairs = before * len(places) + self.token

    def pair_hashes(self, distinct: np.ndarray) -> np.ndarray:
        before, word = np.divmod(distinct, len(self.hashes))
        return mix(np.append(self.hashes, START)[before] * U(0x9E3779B97F4A7C15) + self.hashes[word] * U(0xC2B2AE3D27D4EB4F) + U(1))


def narrow(keys: np.ndarray, shard: int, shards: int) -> bytes:
    """A shard's sorted 64-bit keys as the 48 bits below those that tell the shard."""
    x = (keys - U((shard << 64) // shards)) >> U(max(0, 17 - shards.bit_length()))
    return x.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def widen(b: bytes) -> np.ndarray:
    x = np.zeros((len(b) // 6, 8), np.uint8)
    x[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return x.view(U).reshape(-1)


def contexts(c1: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each token's context's count: that of the token before; for a first token that of the start, as many as ends."""
    ends = np.cumsum(sizes)
    out = np.empty(len(c1), np.int64)
    out[1:] = c1[:-1]
    out[ends - sizes] = c1[ends - 1]
    return out


def fit(held: dict[tuple[int, int, int], int], n: int, v: int, rounds: int = 60) -> np.ndarray:
    """Weights (bucket, 3) of bigram, unigram, uniform by EM; held: (bucket, ratio step, count step) -> tokens."""
    out = np.tile([0.0, 0.5, 0.5], (BUCKETS, 1))
    rows = np.array([(*k, m) for k, m in held.items()], np.float64).reshape(-1, 4)
    for b in range(BUCKETS):
        own = rows[rows[:, 0] == b]
        if not len(own):
            out[b] = out[b - 1] if b else [0.0, 0.5, 0.5]
            continue
        p2 = np.where(own[:, 1] > 0, 2.0 ** (-(own[:, 1] - 1) / 4), 0)
        p1 = np.where(own[:, 2] > 0, 2.0 ** ((own[:, 2] - 1) / 4), 0) / max(1, n - 1)
        p = np.stack([p2, p1, np.full(len(own), 1 / (v + 1))], 1)
        a = np.array([1 / 3, 1 / 3, 1 / 3])
        for _ in range(rounds):
            share = p * a
            share /= share.sum(1, keepdims=True)
            a = (share * own[:, 3:]).sum(0) + 1e-3  # every part keeps some weight, so no token has probability 0
            a /= a.sum()
        out[b] = a
    out[0] = [0.0, *(out[0][1:] / out[0][1:].sum())]
    return out


def score(docs: DataFrame, folds: int = 7, held_out: int = 2, block_bytes: int = 10 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    Rows whose id's crc32 modulo ``folds`` is ``held_out`` are scored but not learned from. ``base_score`` is the add-one
    unigram's log10 probability, ``score`` the model's. A null text counts as an empty one: a single end token. Repeated
    rows each count and are scored. Without training rows N and V are 0 and every token has probability 1. Other columns
    play no part; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.struct("doc_id", (crc_mod("doc_id", folds) == held_out).alias("held_out")).alias("doc_id"), "text")
    kind = docs.schema["doc_id"].dataType["doc_id"].dataType.simpleString()

    def ask(table):
        train = ~table["doc_id"].combine_chunks().field("held_out").to_numpy(zero_copy_only=False)
        block = Block(texts(table["text"].combine_chunks()))
        mine = np.repeat(train, block.sizes)
        words = np.bincount(block.token[mine], minlength=len(block.hashes))
        both = np.sort(2 * block.pairs + mine)
        new = np.flatnonzero(np.diff(both >> 1, prepend=-1))
        pairs = np.add.reduceat(both & 1, new) if len(new) else both
        hashes = block.pair_hashes(both[new] >> 1)
        word_hashes = block.hashes
        del block, both, mine
        i, j = np.argsort(word_hashes), np.argsort(hashes)
        word_hashes, hashes, words, pairs = word_hashes[i], hashes[j], words[i], pairs[j]
        at, to = ({k: slice(a, b) for k, a, b in split(x, shards)} for x in (word_hashes, hashes))
        for k in sorted(at.keys() | to.keys()):
            w, p = at.get(k, slice(0)), to.get(k, slice(0))
            yield k, frame(word_hashes[w].tobytes(), press(words[w]), narrow(hashes[p], k, shards), press(pairs[p]))

    def totals(keys, counts):
        found, back = np.unique(keys, return_inverse=True)
        return np.bincount(back, weights=counts, minlength=len(found)).astype(np.int64), back

    def answer(blobs):
        asked = [parts(b) for b in blobs]
        out = []
        for k, c, read in ((0, 1, lambda b: np.frombuffer(b, U)), (2, 3, widen)):
            keys = [read(x[k]) for x in asked]
            total, back = totals(np.concatenate(keys), np.concatenate([unpress(x[c]) for x in asked]))
            out.append(np.split(total[back], np.cumsum([len(x) for x in keys])[:-1]))
            if k == 0:
                told = np.array([total.sum(), (total > 0).sum()], np.int64).tobytes()
        return [frame(press(w), press(p)) for w, p in zip(*out, strict=True)], told

    def finish(table, answers):
        if table is None:
            nv = np.sum([np.frombuffer(b, np.int64) for b in answers], axis=0)
            return pa.table({"docs": pa.array([None], pa.binary()), "data": pa.array([nv.tobytes()], pa.binary()), "held": pa.array([[]], HELD)})
        ids = table["doc_id"].combine_chunks()
        train = ~ids.field("held_out").to_numpy(zero_copy_only=False)
        block = Block(texts(table["text"].combine_chunks()))
        mine = np.repeat(train, block.sizes)
        distinct, at = np.unique(block.pairs, return_inverse=True)
        answers = [parts(b) for b in answers]
        words, pairs = np.zeros(len(block.hashes), np.int64), np.zeros(len(distinct), np.int64)
        words[np.argsort(block.hashes)] = np.concatenate([unpress(a[0]) for a in answers])
        pairs[np.argsort(block.pair_hashes(distinct))] = np.concatenate([unpress(a[1]) for a in answers])
        c1, c2 = words[block.token], pairs[at]
        # training tokens by bucket of context, bigram ratio and word count, each token itself left out
        n, first = np.bincount(at[mine], minlength=len(pairs)), np.empty(len(pairs), np.int64)
        first[at] = np.arange(len(at))  # any token of each bigram
        own = first[n > 0]
        dc = contexts(c1, block.sizes)[own] - 1
        ratio = np.divide(c2[own] - 1, dc, out=np.zeros(len(dc)), where=dc > 0)
        held, back = np.unique((bucket(dc) * STEPS + octaves(ratio)) * STEPS + octaves(c1[own] - 1), return_inverse=True)
        n = np.bincount(back, weights=n[n > 0], minlength=len(held)).astype(np.int64)
        data = frame(press(block.sizes), press(c1), press(c2))
        return pa.table({"docs": pa.array([pack([pa.RecordBatch.from_struct_array(ids)])], pa.binary()), "data": pa.array([data], pa.binary()), "held": pa.array([[{"k": int(a), "n": int(b)} for a, b in zip(held, n, strict=True)]], HELD)})

    HELD = pa.list_(pa.struct([("k", pa.int64()), ("n", pa.int64())]))
    schema = "docs binary, data binary, held array<struct<k: long, n: long>>"
    shards = n_shards(docs)
    answered = cut(exchange(docs, block_bytes, shards, ask, answer, finish, schema))

    told = [np.frombuffer(r[0], np.int64) for r in answered.where("docs IS NULL").select("data").collect()]  # one row
    n, v = (int(x) for x in np.sum(told, axis=0)) if told else (0, 0)
    held = answered.where("docs IS NOT NULL").select(F.explode("held").alias("x")).groupBy("x.k").agg(F.sum("x.n"))
    found = {(k // STEPS // STEPS, k // STEPS % STEPS, k % STEPS): m for k, m in held.collect()}  # bounded by the steps
    weights = fit(found, n, v)

    def scored(batches):
        for batch in batches:
            for docs_, data in zip(batch.column(0), batch.column(1), strict=True):
                data = data.as_py()
                sizes, c1, c2 = map(unpress, parts(data))
                c = contexts(c1, sizes)
                a = weights[bucket(c)]
                p = a[:, 0] * np.divide(c2, c, out=np.zeros(len(c)), where=c > 0) + a[:, 1] * c1 / max(1, n) + a[:, 2] / (v + 1)
                if not n:
                    p = np.ones(len(c))
                starts = np.cumsum(sizes) - sizes
                add = lambda x: np.add.reduceat(x, starts)  # noqa: E731, B023
                ids = unpack(docs_.as_py())
                yield pa.RecordBatch.from_arrays(
                    [ids["doc_id"].combine_chunks(), ids["held_out"].combine_chunks(), pa.array(sizes), pa.array(add((c1 > 0).astype(np.int64))), pa.array(np.full(len(sizes), n, np.int64)), pa.array(add(np.log10((c1 + 1) / (n + v + 1)))), pa.array(add(np.log10(p)))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return answered.where("docs IS NOT NULL").select("docs", "data").mapInArrow(scored, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
