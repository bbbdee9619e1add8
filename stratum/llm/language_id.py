"""Language of words in code-switched text, by a linear-chain conditional random field.

A text is a sequence of words, each with a hidden language. A word's features are its character 2- and
3-grams with both ends marked, affixes of up to three characters, and the word itself (lexicon), hashed;
each has a learned weight for each language, and so has each transition from one word's language to the
next's. Forward-backward gives every word its probabilities; a document's language is the one with the
largest sum over the words that have a letter, its score that sum's share.

The weights are fitted on a bounded sample of labelled documents (``sample`` in all, evenly by language, by
hash of the text). The sample is joined into one long sequence, so that languages change within it.
Prediction reads nothing but the text. Forward-backward runs over segments of words at once: the product of
a segment's matrices carries the chain across it, so a very long text costs no more a word than others. Memory is
in proportion to words times languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.common import chunks, crc_mod, mix

BITS = 18
SEGMENT = 64
FIRST, LAST = "\x02", "\x03"
U = np.uint64


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features and the places of the words they belong to; whether the word has a letter."""
    text = "".join([FIRST + w + LAST for w in words])
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = ends[owner] - np.arange(len(c))  # characters of the word from here on
    at_start = np.arange(len(c)) == (ends - sizes)[owner]
    ids, of = [], []
    h = c
    for n in (2, 3, 4):
        h = mix(h[: len(c) - n + 1] * U(0x9E3779B97F4A7C15) + c[n - 1 :] + U(n)) if len(c) >= n else np.empty(0, U)
        ok = left[: len(h)] >= n
        if n == 4:
            ok &= at_start[: len(h)] | (left[: len(h)] == 4)
        ids.append(h[ok])
        of.append(owner[: len(h)][ok])
    up = np.cumprod(np.full(int(sizes.max(initial=1)), 0xD6E8FEB86659FD93, U), dtype=U)
    whole = np.add.reduceat(mix(c) * up[np.arange(len(c)) - (ends - sizes)[owner]], ends - sizes) if len(words) else np.empty(0, U)
    ids.append(mix(whole))
    of.append(np.arange(len(words)))
    letters = np.array([any(map(str.isalpha, w)) for w in words], bool)
    ids, of = (np.concatenate(ids) >> U(64 - BITS)).astype(np.int64), np.concatenate(of)
    ok = letters[of]  # a word without a letter says nothing by itself
    return ids[ok], of[ok], letters


def emissions(ids: np.ndarray, of: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(of, minlength=n)))
    return np.stack([np.bincount(of, weights[ids, k], n) * scale for k in range(weights.shape[1])], 1)


def segment_of(L: int) -> int:
    """Words of a segment: with their number growing as L * L the segments' matrices take no more than the words' scores do."""
    return max(SEGMENT, L * L)


def marginals(e: np.ndarray, sizes: np.ndarray, transitions: np.ndarray, pairs: bool = False):
    """Each word's probabilities by forward-backward; e: scores (words, languages), sizes: words of each text (none empty).

    All segments are gone through at once, a word of each at a time; texts of several segments need the matrix that a segment
    makes of what comes in, and only they. ``pairs`` adds the expected number of each transition.
    """
    n, L = e.shape
    A = np.exp(transitions - transitions.max())
    length = segment_of(L)
    segments = -(-sizes // length)
    first = np.cumsum(segments) - segments
    S = int(segments.sum())
    starts = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(n) - starts[doc]
    begin = np.repeat(starts, segments) + (np.arange(S) - np.repeat(first, segments)) * length  # each segment's first word
    size = np.minimum(np.repeat(starts + sizes, segments) - begin, length)
    psi = np.exp(e - e.max(1, keepdims=True))
    by_size = np.argsort(-size, kind="stable")  # longest first: those that have a word t are the first few
    alive = np.searchsorted(-size[by_size], -np.arange(int(size.max(initial=0))), "left")  # segments with more than t words
    opens = np.zeros(S, bool)
    opens[first] = True
    into, back = np.full((S, L), 1 / L), np.ones((S, L))
    most = int(segments.max(initial=0))
    if most > 1:
        inner = np.flatnonzero(np.repeat(segments, segments) > 1)
        P = np.broadcast_to(np.eye(L), (len(inner), L, L)).copy()
        longest = np.argsort(-size[inner], kind="stable")
        some = np.searchsorted(-size[inner][longest], -np.arange(length), "left")
        for t in range(length):
            s = longest[: some[t]]
            if not len(s):
                break
            step = P[s] @ A
            if t == 0:
                o = opens[inner[s]]
                step[o] = 1 / L  # the first word comes from nowhere
            step *= psi[begin[inner[s]] + t][:, None, :]
            P[s] = step / step.max((1, 2), keepdims=True)
        place = np.full(S, -1)
        place[inner] = np.arange(len(inner))
        order = np.argsort(-segments, kind="stable")
        for k in range(1, most):
            s = first[order[: int(np.searchsorted(-segments[order], -k))]] + k
            x = (into[s - 1][:, None, :] @ P[place[s - 1]])[:, 0]
            into[s] = x / x.sum(1, keepdims=True)
        for k in range(most - 1, 0, -1):
            s = first[order[: int(np.searchsorted(-segments[order], -k))]] + k
            x = (P[place[s]] @ back[s][:, :, None])[:, :, 0]
            back[s - 1] = x / x.sum(1, keepdims=True)
    alpha, beta = np.empty((n, L)), np.empty((n, L))
    for t, m in enumerate(alive.tolist()):
        s = by_size[:m]
        x = into[s] @ A
        if t == 0:
            x[opens[s]] = 1 / L
        x *= psi[begin[s] + t]
        into[s] = alpha[begin[s] + t] = x / x.sum(1, keepdims=True)
    for t in range(len(alive) - 1, -1, -1):
        s = by_size[: int(alive[t])]
        beta[begin[s] + t] = back[s]
        x = (psi[begin[s] + t] * back[s]) @ A.T
        back[s] = x / x.sum(1, keepdims=True)
    gamma = alpha * beta
    gamma /= gamma.sum(1, keepdims=True)
    if not pairs:
        return gamma
    later = np.flatnonzero(within > 0)
    xi = np.zeros((L, L))
    for i in range(0, len(later), 1 << 16):
        at = later[i : i + (1 << 16)]
        right = psi[at] * beta[at]
        norm = ((alpha[at - 1] @ A) * right).sum(1, keepdims=True)
        xi += A * ((alpha[at - 1] / norm).T @ right)
    return gamma, xi


def fit(sample: list[tuple[str, int]], n_langs: int, rounds: int = 40, rate: float = 0.5, l2: float = 1e-6, piece: int = 2048):
    """Weights (2^BITS, languages) and transitions from (text, language) by Adagrad on the whole sample's likelihood."""
    place, at, label = {}, [], []
    for text, lang in sample:
        words = [w.decode("utf-8", "replace").lower() for w in text.encode().split()]
        at += [place.setdefault(w, len(place)) for w in words]
        label += [lang] * len(words)
    weights, transitions = np.zeros((1 << BITS, n_langs)), np.zeros((n_langs, n_langs))
    if not at:
        return weights, transitions
    ids, of, _ = features(list(place))
    at, label = np.array(at), np.array(label)
    n = len(at)
    sizes = np.array([min(piece, n - i) for i in range(0, n, piece)])
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(of, minlength=len(place))))
    seen = np.bincount(at * n_langs + label, minlength=len(place) * n_langs).reshape(-1, n_langs)
    inner = np.arange(n) % piece > 0
    moved = np.bincount(label[:-1][inner[1:]] * n_langs + label[1:][inner[1:]], minlength=n_langs**2).reshape(n_langs, n_langs)
    gw, gt = np.full(weights.shape, 1e-8), np.full(transitions.shape, 1e-8)
    for _ in range(rounds):
        gamma, xi = marginals(emissions(ids, of, len(place), weights)[at], sizes, transitions, pairs=True)
        off = (seen - np.stack([np.bincount(at, gamma[:, k], len(place)) for k in range(n_langs)], 1)) * scale[:, None] / n
        g = np.stack([np.bincount(ids, off[of, k], 1 << BITS) for k in range(n_langs)], 1) - l2 * weights
        gw += g * g
        weights += rate * g / np.sqrt(gw)
        g = (moved - xi) / n
        gt += g * g
        transitions += rate * g / np.sqrt(gt)
    return weights, transitions


class Labeller:
    """Word probabilities for texts under fitted weights; each distinct word's scores are computed once (up to ``most``)."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray, most: int = 400_000):
        self.weights, self.transitions, self.most = weights, transitions, most
        self.clear()

    def clear(self) -> None:
        self.place, self.scores, self.letters = {}, np.empty((0, self.weights.shape[1])), np.empty(0, bool)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of all words in a row, whether they have a letter, and the texts' numbers of words."""
        words = [b.split() for b in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        if len(self.place) > self.most:
            self.clear()
        new = list(set().union(*words).difference(self.place)) if words else []
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            parts, letters = [self.scores], [self.letters]
            for i in range(0, len(new), 50_000):
                ids, of, l = features([w.decode("utf-8", "replace").lower() for w in new[i : i + 50_000]])
                parts.append(emissions(ids, of, len(l), self.weights))
                letters.append(l)
            self.scores, self.letters = np.concatenate(parts), np.concatenate(letters)
        at = np.fromiter((self.place[w] for ws in words for w in ws), np.int64, int(sizes.sum()))
        if not len(at):
            return np.empty((0, self.weights.shape[1])), np.empty(0, bool), sizes
        return marginals(self.scores[at], sizes[sizes > 0], self.transitions), self.letters[at], sizes


def train(docs: DataFrame, sample: int = 600) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, weights, transitions from the labelled rows of ``docs`` (text, lang); about ``sample`` of them."""
    labelled = docs.select("text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}  # one row a language
    langs = sorted(counts)
    luck = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    pick = F.lit(False)
    for lang in langs:
        pick = pick | ((F.col("lang") == lang) & (luck < int(min(1.0, sample / len(langs) / counts[lang]) * (1 << 30))))
    rows = sorted((r[0], r[1]) for r in labelled.where(pick).distinct().collect()) if langs else []
    rows.sort(key=lambda r: hash_of(r[0]))
    return langs, *fit([(t, langs.index(x)) for t, x in rows], max(1, len(langs)))


def hash_of(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode())


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` for every row of ``docs``; only the text is read.

    A null or empty text, or one without a letter, is ``und`` with score 0, and so is any text if no language was learned.
    Repeated rows are judged each for itself; an empty table gives an empty result.
    """
    langs, weights, transitions = model
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), transitions))  # 2^18 rows

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = Labeller(*shared.value)
        for batch, found in chunks(batches, 2 << 20):
            gamma, letters, sizes = label(found)
            sums = np.zeros((len(found), max(1, len(langs))))
            at = np.repeat(np.arange(len(found)), sizes)[letters]
            for k in range(len(langs)):
                sums[:, k] = np.bincount(at, gamma[letters, k], len(found))
            total = sums.sum(1)
            best = sums.argmax(1)
            score = np.minimum(1.0, np.divide(sums.max(1), total, out=np.zeros(len(found)), where=total > 0))
            names = [langs[b] if t > 0 else "und" for b, t in zip(best, total, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(predicted, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2, sample: int = 600) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows whose id's crc32 modulo ``folds`` is not ``held_out``.

    Null ids count as the empty text in the choice of folds; rows without a language or a text are not learned from; rows that are
    alike in text and language are learned from once. What ``predict`` says of nulls, empty texts and repeats holds here too.
    """
    model = train(docs.where(crc_mod("doc_id", folds) != held_out), sample)
    return predict(docs, model).select("doc_id", (crc_mod("doc_id", folds) == held_out).alias("held_out"), "lang_pred", "score")
