"""Quality rules combined by weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document. Nothing says which rule to
trust: expectation-maximisation over all documents estimates each rule's accuracies and the share
of good documents, and the posterior probability of "good" decides. The statistic that EM needs is
the number of documents with each vote pattern, at most 3^rules rows, so one aggregation over the
corpus suffices however large it is; no document leaves its executor.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import ne

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stratum.llm.common import chunks, named

SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = (*BASE, "n_lines", "n_bare_words", "n_stops", "n_upper", "n_marked", "n_bangs")
LETTERS = bytes(range(65, 91))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice in the text, the first included."""
    tri = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(tri)) == len(tri):
        return 0
    found, n, upto = Counter(tri), 0, 0
    for i, t in enumerate(tri):
        if found[t] > 1:
            n += i + 3 - max(i, upto)
            upto = i + 3
    return n


def measure(b: bytes) -> tuple[int, ...]:
    words = b.split()
    seen, dup, lines = set(), 0, 0
    for line in b.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    inside = b.translate(None, SPACE)
    chars = len(inside) if inside.isascii() else len(inside.decode("utf-8", "replace"))
    symbols = len(b) - len(b.translate(None, SYMBOLS))
    left = [w.translate(None, SYMBOLS) for w in words] if symbols else words
    bare = left.count(b"")
    marked = sum(map(ne, map(len, words), map(len, left))) if symbols else 0
    stops = sum(w[-1] in b".!?," for w in words)
    return len(words), chars, symbols, dup, repeated_words(words), lines, bare, stops, len(b) - len(b.translate(None, LETTERS)), marked, b.count(b"!")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, found in chunks(batches):
        rows = [measure(b) for b in found]
        columns = [batch.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COUNTS)))]
        yield pa.RecordBatch.from_arrays(columns, ["row", *COUNTS])


def measures(docs: DataFrame, columns: list[str]) -> DataFrame:
    """One row per row of ``docs``: ``row``, a struct of the named columns, and the counts. A null text counts as an empty one."""
    df = docs.select(F.struct(*map(named, columns)).alias("row"), "text")
    schema = StructType([df.schema["row"], *(StructField(c, LongType()) for c in COUNTS)])
    return df.mapInArrow(_measured, schema)


def rules() -> dict:
    """Name -> vote column over the counts."""
    n = F.greatest(F.col("n_words"), F.lit(1))

    def vote(x, good, bad, higher_is_bad=True):
        if higher_is_bad:
            return F.when(x <= good, 1).when(x >= bad, -1).otherwise(0)
        return F.when(x >= good, 1).when(x <= bad, -1).otherwise(0)

    mean = F.col("word_chars") / n
    return {
        "symbols": vote(F.col("n_symbols") / n, 0.05, 0.2),
        "word_length": F.when(F.col("n_words") == 0, -1).when((mean >= 2.5) & (mean <= 12), 1).when((mean < 1.5) | (mean > 20), -1).otherwise(0),
        "marked_words": vote(F.col("n_marked") / n, 0.02, 0.2),
        "repeated_lines": F.when((F.col("n_dup_lines") >= 3) & (F.col("n_dup_lines") >= 0.3 * F.col("n_lines")), -1).when(F.col("n_dup_lines") <= 0.1 * F.col("n_lines"), 1).otherwise(0),
        "repeated_words": vote(F.col("n_repeat_words") / n, 0.1, 0.4),
        "bare_symbols": vote(F.col("n_bare_words") / n, 0.02, 0.1),
        "sentences": vote(F.col("n_stops") / n, 0.06, 0.02, higher_is_bad=False),
        "capitals": vote(F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)), 0.2, 0.5),
        "bangs": vote(F.col("n_bangs") / n, 0.05, 0.3),
        "length": F.when(F.col("n_words") >= 100, 1).when(F.col("n_words") < 10, -1).otherwise(0),
    }


def fit(patterns: dict[tuple[int, ...], int], n_rules: int, rounds: int = 100) -> tuple[float, list[tuple[float, float]]]:
    """EM over vote patterns: the share of good documents, and each rule's accuracy on good and on bad ones.

    A rule has an accuracy for either class because few rules see every fault: one that is right about 999 of 1000 good
    documents and about a third of the bad ones says much by voting bad and little by voting good. Abstaining says nothing.
    A document with a bad vote starts as bad, others as good; counts are smoothed, and a rule is held to be better than
    chance: its two accuracies sum to more than 1. The share of good documents is held within 0.5 and 0.99: votes alone can't
    tell a corpus from its opposite, and where all documents vote alike a lower share could turn all of them over. A corpus in which
    most documents are bad thus counts as half bad; what is then bad still follows from the votes.
    """
    prior, acc = 0.8, [(0.9, 0.5)] * n_rules
    p = {votes: 0.1 if min(votes, default=0) < 0 else 0.95 for votes in patterns}
    total = sum(patterns.values())
    for _ in range(rounds if total else 0):
        prior = min(0.99, max(0.5, (sum(n * p[v] for v, n in patterns.items()) + 1) / (total + 2)))
        for j in range(n_rules):
            right, said = [0.0, 0.0], [0.0, 0.0]
            for votes, n in patterns.items():
                for c, weight in enumerate((p[votes], 1 - p[votes])):
                    said[c] += n * weight * (votes[j] != 0)
                    right[c] += n * weight * (votes[j] == (1, -1)[c])
            good = min(0.999, max(0.5, (right[0] + 0.9) / (said[0] + 1)))
            acc[j] = good, min(0.99, max(1.001 - good, (right[1] + 0.5) / (said[1] + 1)))
        p = {votes: posterior(votes, prior, acc) for votes in patterns}
    return prior, acc


def weights(a: tuple[float, float]) -> tuple[float, float]:
    """What a good and a bad vote add to the log-odds of a good document."""
    return math.log(a[0] / (1 - a[1])), math.log((1 - a[0]) / a[1])


def posterior(votes, prior: float, acc: list[tuple[float, float]]) -> float:
    x = math.log(prior / (1 - prior)) + sum(weights(a)[v < 0] for v, a in zip(votes, acc, strict=True) if v)
    return 1 / (1 + math.exp(-x))


def verdicts(docs: DataFrame, columns: list[str], least: float) -> DataFrame:
    counts, votes = measures(docs, columns), rules()
    voted = counts.select("*", *(v.alias(f"vote_{k}") for k, v in votes.items()))
    names = [f"vote_{k}" for k in votes]
    found = voted.groupBy(*names).count().collect()  # at most 3 ^ rules rows
    prior, acc = fit({tuple(r[:-1]): r[-1] for r in found}, len(names))
    logit = F.lit(math.log(prior / (1 - prior)))
    for n, a in zip(names, acc, strict=True):
        good, bad = weights(a)
        logit = logit + F.when(F.col(n) > 0, good).when(F.col(n) < 0, bad).otherwise(0.0)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = voted.withColumn("base_failed", failed).withColumn("p_good", 1 / (1 + F.exp(-logit)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))


def score(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and p_good for every row of ``docs``.

    ``base_failed``: fewer than 50 words, or over half of the words in repeated 3-word windows.
    ``kept``: not base_failed, and the posterior probability of a good document is ``least`` or more.
    Null and empty texts have zero counts and fail. Repeated rows are scored each for itself. An empty
    table gives an empty result. Columns of ``docs`` other than doc_id and text play no part.
    """
    return verdicts(docs, ["doc_id"], least).select("row.doc_id", *BASE, "base_failed", "kept", "p_good")


def keep(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``score`` keeps, all columns as they are; no join, so rows and names may repeat."""
    return verdicts(docs, docs.columns, least).where("kept").select("row.*")
