"""Token counts and quality rules."""

import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from stratum.llm import quality_rules, token_counts
from stratum.llm.queries import QUERIES
from tests.llm.helpers import awkward, frame, words


def best_split(token, pieces, unknown):
    """Tokens of the best split, by dynamic programming without a trie."""
    best = [(0.0, 0)]
    for end in range(1, len(token) + 1):
        found = (best[-1][0] + unknown, best[-1][1] + 1)
        for k in range(1, end + 1):
            s = pieces.get(token[end - k : end])
            if s is not None:
                score, n = best[end - k][0] + s, best[end - k][1] + 1
                if score > found[0] or score == found[0] and n < found[1]:
                    found = (score, n)
        best.append(found)
    return best[-1][1]


PIECES = {b"a": -1.0, b"b": -2.0, b"ab": -2.5, b"aba": -2.0, b"bb": -5.0, b"c": -3.0, b"abcab": -4.0, b" ": -1.5, b" a": -1.0}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=12).map(lambda b: bytes(b"abc d"[x % 5] for x in b)), max_size=20), st.integers(1, 30), st.integers(1, 6))
def test_the_trie_agrees_with_plain_programming(tokens, most, depth):
    trie = token_counts.Trie(PIECES, depth=depth, most=most)
    assert [trie.count(t) for t in tokens] == [best_split(t, PIECES, trie.unknown) for t in tokens]


def test_shared_prefixes_are_scored_once():
    trie = token_counts.Trie(PIECES)
    asked = []
    step = trie.step
    trie.step = lambda path, token, end: asked.append(token[:end]) or step(path, token, end)
    for t in (b"abcab", b"abca", b"abcb", b"abcab"):
        trie.count(t)
    assert sorted(asked) == [b"a", b"ab", b"abc", b"abca", b"abcab", b"abcb"]


def test_token_counts_of_awkward_texts(spark):
    rows = awkward()
    pieces = token_counts.vocabulary()
    unknown = min(pieces.values()) - 10.0
    longest = max(map(len, pieces))
    want = Counter()
    for i, t, _, _ in rows:
        b = (t or "").encode()
        pre = token_counts.PRE_TOKEN.findall(b)
        assert b"".join(pre) == b
        if max(map(len, pre), default=0) < 1000:
            small = {p: best_split(p, pieces, unknown) for p in set(pre)}
            want[i, len(b), len(pre), sum(small[p] for p in pre)] += 1
    got = Counter(tuple(r) for r in token_counts.count_tokens(frame(spark, rows)).collect())
    assert sum(got.values()) == len(rows) and want - got == Counter() and longest
    assert token_counts.count_tokens(frame(spark, rows).limit(0)).count() == 0


def counts(text):
    w = words(text)
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    repeated = {k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
    lines, dup, seen = (text or "").encode().split(b"\n"), 0, set()
    for x in lines:
        if x.split():
            dup += x in seen
            seen.add(x)
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(repeated)


def test_base_counts(spark):
    rows = awkward() + [(900, "a|b <x> # a\na|b\n  \na|b\t\n*", "en", "a")]
    got = quality_rules.score(frame(spark, rows)).collect()
    want = Counter()
    for i, t, _, _ in rows:
        c = counts(t)
        want[(i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
    assert Counter(tuple(r)[:7] for r in got) == want
    assert not any(r["kept"] for r in got if r["base_failed"])
    assert quality_rules.score(frame(spark, rows).limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=30))
def test_repeated_words(w):
    assert quality_rules.repeated_words(w) == counts(b" ".join(w).decode())[4]


def test_estimation_finds_planted_accuracies():
    r, patterns = random.Random(3), Counter()
    acc = [(0.99, 0.6), (0.98, 0.5), (0.97, 0.4), (0.95, 0.7), (0.8, 0.4)]
    for _ in range(30_000):
        c = r.random() > 0.85
        patterns[tuple(0 if r.random() < 0.2 else (1, -1)[c] if r.random() < a[c] else (-1, 1)[c] for a in acc)] += 1
    prior, found = quality_rules.fit(patterns, len(acc))
    assert abs(prior - 0.85) < 0.03 and all(abs(x - y) < 0.05 for a, b in zip(acc, found, strict=True) for x, y in zip(a, b, strict=True))
    assert quality_rules.posterior((1, 1, 1, 1, 1), prior, found) > 0.9 > 0.1 > quality_rules.posterior((-1, -1, 1, 1, 0), prior, found)
    assert quality_rules.fit({}, 2)[0] == 0.8


def plain_votes(text):
    """The rules' votes from their names and limits, in plain Python."""
    t, w = (text or "").encode(), words(text)
    n, chars = max(1, len(w)), sum(len(x.decode()) for x in w)
    _, _, symbols, dup, repeat = counts(text)
    lines = sum(bool(x.split()) for x in t.split(b"\n"))
    marked, bare = sum(any(c in b"#*$%&|<>" for c in x) for x in w), sum(all(c in b"#*$%&|<>" for c in x) for x in w)
    stops, upper, bangs = sum(x[-1:] in (b".", b"!", b"?", b",") for x in w), sum(65 <= c <= 90 for c in t), t.count(b"!")
    low = lambda x, good, bad: 1 if x <= good else -1 if x >= bad else 0
    mean = chars / n
    return (
        low(symbols / n, 0.05, 0.2), -1 if not w else 1 if 2.5 <= mean <= 12 else -1 if mean < 1.5 or mean > 20 else 0, low(marked / n, 0.02, 0.2),
        -1 if dup >= 3 and dup >= 0.3 * lines else 1 if dup <= 0.1 * lines else 0, low(repeat / n, 0.1, 0.4), low(bare / n, 0.02, 0.1),
        1 if stops / n >= 0.06 else -1 if stops / n <= 0.02 else 0, low(upper / max(1, chars), 0.2, 0.5), low(bangs / n, 0.05, 0.3), 1 if len(w) >= 100 else -1 if len(w) < 10 else 0,
    )


def test_verdicts_agree_with_a_plain_version(spark, sf):
    """Whole documents table: votes, estimation one document at a time, posterior."""
    import math

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    votes = [plain_votes(t) for _, t in rows]
    p, acc, prior = [0.1 if min(v) < 0 else 0.95 for v in votes], [(0.9, 0.5)] * 10, 0.8
    for _ in range(100):
        prior = min(0.99, max(0.5, (sum(p) + 1) / (len(p) + 2)))
        for j in range(10):
            good = sum(q for q, v in zip(p, votes, strict=True) if v[j] > 0), sum(q for q, v in zip(p, votes, strict=True) if v[j])
            bad = sum(1 - q for q, v in zip(p, votes, strict=True) if v[j] < 0), sum(1 - q for q, v in zip(p, votes, strict=True) if v[j])
            a = min(0.999, max(0.5, (good[0] + 0.9) / (good[1] + 1)))
            acc[j] = a, min(0.99, max(1.001 - a, (bad[0] + 0.5) / (bad[1] + 1)))
        p = []
        for v in votes:
            x = math.log(prior / (1 - prior)) + sum(math.log(a / (1 - b)) if y > 0 else math.log((1 - a) / b) for y, (a, b) in zip(v, acc, strict=True) if y)
            p.append(1 / (1 + math.exp(-x)))
    got = QUERIES["op5_quality_rules"](spark, sf).collect()
    want = {i: (c[0] >= 50 and 100 * c[4] <= 50 * c[0] and q >= 0.5) for (i, t), q in zip(rows, p, strict=True) for c in [counts(t)]}
    assert {r["doc_id"]: r["kept"] for r in got} == want and len(set(want.values())) == 2


def test_a_mostly_bad_corpus_counts_as_half_bad():
    patterns = Counter({(1, 1, 1): 100, (-1, -1, 1): 300, (-1, 1, -1): 300, (1, -1, -1): 250, (-1, -1, -1): 50})
    prior, acc = quality_rules.fit(patterns, 3)
    assert prior == 0.5 and quality_rules.posterior((-1, -1, -1), prior, acc) < 0.5 < quality_rules.posterior((1, 1, 1), prior, acc)


def test_rules_tell_rated_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("toxic = 0")
    rows = QUERIES["op5_quality_rules"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").collect()
    kept = Counter((r["quality"], r["kept"]) for r in rows if r["n_words"] >= 50)
    assert kept[1, True] >= 0.99 * (kept[1, True] + kept[1, False]) and kept[0, False] >= 0.9 * (kept[0, True] + kept[0, False])


def test_kept_rows_pass_whole(spark):
    df = frame(spark, awkward())
    out = quality_rules.keep(df)
    assert out.columns == df.columns
    want = Counter(r["doc_id"] for r in quality_rules.score(df).where("kept").collect())
    assert Counter(r["doc_id"] for r in out.collect()) == want and want
