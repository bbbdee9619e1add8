"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A rating is a grade 0 < 1 < ... < K. One score, the sum of the weights of the text's hashed features,
is compared with K ordered thresholds: P(grade > k) = sigmoid(score - threshold_k), so all grades share
the weights. Features are the distinct words (A-Z lowered) with and without marks at their ends, their beginnings, their
shapes (letters, digits and marks, runs collapsed) and two ratios of the text in steps. The expected grade is the sum of the tail probabilities.

Ratings of quality and toxicity make three grades: 0 toxic, 1 poor, 2 good. The model is fitted on a bounded
sample of rated documents (about ``sample``, by hash of the id); scoring reads every text whole, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import chunks, cut

BITS = 18
MARKS = bytes(i for i in range(33, 127) if not chr(i).isalnum())
#: Lengths in bytes of the beginnings of words that are features.
HEADS = (4, 5, 6, 7, 8)
RUNS = re.compile(rb"(.)\1+", re.S)
CLASSES = bytes(97 if chr(i).isalpha() or i >= 128 else 48 if chr(i).isdigit() else i for i in range(256))


def place(x: bytes) -> int:
    return xxhash.xxh3_64_intdigest(x) >> (64 - BITS)


class Features(dict):
    """word -> places of its features; emptied beyond ``most`` words."""

    most = 200_000

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        core = word.strip(MARKS)
        shape = RUNS.sub(rb"\1", word.translate(CLASSES))
        heads = (b"p" + core[:k] for k in HEADS if len(core) > k)
        f = self[word] = tuple(map(place, (b"w" + core, b"r" + word, b"s" + shape, *heads)))
        return f

    def of(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        distinct = set(words)
        lines = [x for x in text.split(b"\n") if x.strip()]
        found = {f for w in distinct for f in self[w]}
        n = max(1, len(words))
        found.add(place(b"distinct%d" % (10 * len(distinct) // n)))
        found.add(place(b"lines%d" % (10 * len(set(lines)) // max(1, len(lines)))))
        return np.fromiter(found, np.int32, len(found))


def tails(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade > k), a column for each threshold."""
    return 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds[None], -40, 40)))


def fit(rows: list[tuple[np.ndarray, int]], grades: int, rounds: int = 300, rate: float = 0.05, l1: float = 1e-3, least: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by Adagrad on the sample's mean log-likelihood less l1 times the weights' sizes.

    The penalty leaves most weights at 0, so that the many words that say nothing add no noise to a long text. Features in fewer
    than ``least`` documents of the sample stay at 0. The thresholds are a first one and positive steps.
    """
    weights, first, steps = np.zeros(1 << BITS), -1.0, np.zeros(grades - 2)
    thresholds = lambda: first + np.concatenate([[0.0], np.cumsum(np.exp(steps))])
    if not rows:
        return weights, thresholds()
    ids = np.concatenate([f for f, _ in rows])
    of = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    ok = np.bincount(ids, minlength=1 << BITS)[ids] >= least
    places, ids = np.unique(ids[ok], return_inverse=True)
    of, w, gw = of[ok], np.zeros(len(places)), np.full(len(places), 1e-6)
    grade, at = np.array([g for _, g in rows]), np.arange(len(rows))
    gf, gs = 1e-6, np.full(grades - 2, 1e-6)
    for _ in range(rounds):
        t = np.column_stack([np.ones(len(rows)), tails(np.bincount(of, w[ids], len(rows)), thresholds()), np.zeros(len(rows))])
        p = np.maximum(1e-12, t[at, grade] - t[at, grade + 1])
        slope = t * (1 - t)
        up, down = slope[at, grade] / p, slope[at, grade + 1] / p  # by the score, through the threshold below and above
        g = np.bincount(ids, (up - down)[of], len(places)) / len(rows)
        gw += g * g
        step = rate / np.sqrt(gw)
        w += step * g
        w = np.sign(w) * np.maximum(0, np.abs(w) - step * l1)
        by = np.array([-(up[grade == k + 1].sum()) + down[grade == k].sum() for k in range(grades - 1)]) / len(rows)
        gf += by.sum() ** 2
        first += rate * by.sum() / gf**0.5
        for k in range(grades - 2):
            g = by[k + 1 :].sum() * np.exp(steps[k])
            gs[k] += g * g
            steps[k] += rate * g / gs[k] ** 0.5
    weights[places] = w
    return weights, thresholds()


def train(docs: DataFrame, ratings: DataFrame, grades: int, sample: int = 4000, most_features: int = 20_000_000) -> tuple[np.ndarray, np.ndarray]:
    """The model from ``docs`` (doc_id, text) and ``ratings`` (doc_id, grade), fitted on about ``sample`` rated documents.

    The sample is bounded in documents and in their features together (``most_features``, 4 bytes each): documents come in the order of a
    hash until either is reached. Null grades, unknown ids and null ids are left out; of rows that repeat an id one counts,
    for each grade that it has; null and empty texts count with their ratios alone. Without ratings all weights are 0.
    """
    ratings = ratings.select("doc_id", "grade").where("grade IS NOT NULL AND doc_id IS NOT NULL").distinct()
    part = min(1.0, sample / max(1, ratings.count()))
    chosen = ratings.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(part * (1 << 30)))  # about ``sample`` rows
    found = docs.select("doc_id", "text").join(F.broadcast(chosen.withColumnRenamed("doc_id", "rated")), F.col("doc_id") == F.col("rated"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array([features.of(b).tobytes() for b in texts], pa.binary())], ["doc_id", "grade", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = found.select("doc_id", "text", "grade").mapInArrow(extract, f"doc_id {kind}, grade int, ids binary")
    rows = rows.groupBy("doc_id", "grade").agg(F.min("ids").alias("ids")).withColumn("luck", F.xxhash64("doc_id", "grade"))
    rows = cut(rows)
    upto, left = None, most_features
    for r in sorted((r["luck"], r["n"]) for r in rows.select("luck", (F.octet_length("ids") / 4).cast("int").alias("n")).collect()):  # two numbers a rated document
        left -= r[1]
        if left < 0:
            break
        upto = r[0]
    kept = rows.where(F.col("luck") <= upto).collect() if upto is not None else []
    kept.sort(key=lambda r: (str(r["doc_id"]), r["grade"]))
    return fit([(np.frombuffer(r["ids"], np.int32), r["grade"]) for r in kept], grades)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], grade: int = 2, least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, p_tail (P(grade >= ``grade``)) and kept (p_tail >= ``least``) for every row of ``docs``.

    A null or empty text has no words and is judged by its ratios and the thresholds alone. Repeated rows are judged each
    for itself; other columns play no part; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))  # 2^18 weights
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = shared.value
        features = Features()
        for batch, texts in chunks(batches):
            p = tails(np.array([weights[features.of(b)].sum(dtype=np.float64) for b in texts]), thresholds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.sum(1)), pa.array(p[:, grade - 1])], ["doc_id", "expected_grade", "p_tail"])

    out = docs.select("doc_id", "text").mapInArrow(scored, f"doc_id {kind}, expected_grade double, p_tail double")
    return out.withColumn("kept", F.col("p_tail") >= least)


def grades(labels: DataFrame) -> DataFrame:
    """Ratings from quality and toxicity flags: toxic 0, poor 1, good 2; null if either that decides is null."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("toxic").isNotNull() & F.col("quality").isNotNull(), 1 + F.col("quality"))
    return labels.select("doc_id", grade.cast("int").alias("grade"))
