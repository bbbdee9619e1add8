"""Token counts under a unigram model, by dynamic programming shared over a trie.

A text is cut into pre-tokens: each word with the one space before it, if any; every other white
space character stands alone, so the pre-tokens make up the whole text. A pre-token's tokens are the
best-scoring way to write its bytes as pieces of the vocabulary: the forward score at a byte is the
greatest, over the pieces that end there, of the score where the piece began plus the piece's own.
That score depends only on the bytes before it, so it is held at a trie's node and computed once for
all pre-tokens that share the prefix; the node where a pre-token ends holds its token count.

The vocabulary file is a byte-level rank list; a piece's unigram probability is Zipf's law for a list in
order of frequency, 1 / (r + 2) for rank r over the sum of all, and its score the logarithm. Equal scores prefer
fewer tokens.
"""

from __future__ import annotations

import base64
import gc
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from stratum.llm.common import chunks

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PRE_TOKEN = re.compile(rb" ?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]")


def vocabulary(path: str = VOCABULARY) -> dict[bytes, float]:
    """piece -> log probability; read on the driver, a few megabytes at most."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    total = math.log(sum(1 / (r + 2) for r in ranks.values()) or 1)
    return {piece: -math.log(r + 2) - total for piece, r in ranks.items()}


class Trie:
    """Pre-tokens with shared forward scores.

    A node is a list [score, tokens, children or None]; the node where a pre-token ends holds its count.
    Only the first ``depth`` bytes of a pre-token get nodes; the rest is scored without storing.
    Beyond ``most`` nodes the trie starts anew, which changes no result.
    """

    def __init__(self, pieces: dict[bytes, float], depth: int = 24, most: int = 600_000):
        self.pieces, self.depth, self.most = pieces, depth, most
        self.longest = max(map(len, pieces), default=0)
        self.unknown = min(pieces.values(), default=0.0) - 10.0  # for a byte that no piece covers
        self.ends = {p[i:]: None for p in pieces for i in range(len(p))} | pieces  # every end of a piece
        self.clear()

    def clear(self) -> None:
        self.root, self.nodes = [0.0, 0, None], 1

    def step(self, path: list, token: bytes, end: int) -> list:
        """The node for byte ``end``; path[-k] stands k bytes before it. Longer pieces are tried as long as any can end so."""
        before = path[-1]
        best, n = before[0] + self.unknown, before[1] + 1
        ends, k, at = self.ends, 1, min(end, len(path))
        while k <= at:
            s = ends.get(token[end - k : end], 0)
            if s:
                before = path[-k]
                score = before[0] + s
                if score > best or score == best and before[1] < n - 1:
                    best, n = score, before[1] + 1
            elif s == 0:
                break
            k += 1
        return [best, n, None]

    def count(self, token: bytes) -> int:
        if self.nodes > self.most:
            self.clear()
        node, path = self.root, [self.root]
        for i, b in enumerate(token[: self.depth], 1):
            children = node[2]
            if children is None:
                children = node[2] = {}
            child = children.get(b)
            if child is None:
                child = children[b] = self.step(path, token, i)
                self.nodes += 1
            path.append(node := child)
        for i in range(self.depth + 1, len(token) + 1):
            path.append(self.step(path, token, i))
            if len(path) > 2 * self.longest:
                del path[: self.longest]
        return path[-1][1]


def count_tokens(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_bytes, n_pre_tokens, n_tokens for every row of ``docs``.

    No shuffle: each task has its own trie. Null and empty texts have no tokens; repeated rows are
    counted each for itself; other columns play no part; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    pieces = spark.sparkContext.broadcast(vocabulary(path))  # the size is the file's, not the corpus's
    kind = docs.schema["doc_id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known, cut = Trie(pieces.value), {}, PRE_TOKEN.findall
        gc.disable()  # the trie is a great many small objects without cycles
        for batch, found in chunks(batches):
            tokens = [cut(b) for b in found]
            new = set().union(*tokens).difference(known)
            if len(known) > 400_000:
                known, new = {}, set().union(*tokens)
            for t in sorted(new):  # neighbours share the longest prefixes
                known[t] = trie.count(t)
            rows = [(len(b), len(t), sum(map(known.__getitem__, t))) for b, t in zip(found, tokens, strict=True)]
            columns = [batch.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_pre_tokens", "n_tokens"])
        gc.enable()

    return docs.select("doc_id", "text").mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_pre_tokens long, n_tokens long")
