"""Substring dedup, Jaccard join, decontamination."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratum.llm import decontamination, exchange, jaccard_join, substring_dedup
from stratum.llm.common import mix
from stratum.llm.components import components
from stratum.llm.exchange import split
from stratum.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import same
from tests.llm import helpers
from tests.llm.helpers import awkward, frame, lower, words


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_agrees_with_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), ORACLE_SQL[name], sf)


def removed(rows, n):
    """(id, words, removed words, kept text) by counting all windows."""
    seen = Counter(tuple(w[i : i + n]) for _, t in rows for w in [words(t)] for i in range(len(w) - n + 1))
    out = Counter()
    for i, t in rows:
        w = words(t)
        gone = {k for j in range(len(w) - n + 1) if seen[tuple(w[j : j + n])] > 1 for k in range(j, j + n)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i, len(w), len(gone), kept] += 1
    return out


@pytest.mark.parametrize("window,bits", [(35, 32), (35, 4), (5, 6), (1, 8), (9, 32)])
def test_removes_what_all_windows_say(spark, window, bits):
    r = random.Random(window)
    rows = [(i, t) for i, t, _, _ in awkward()]
    some = [helpers.prose(r, 40, 9) for _ in range(6)]
    rows += [(200 + i, " ".join([r.choice(some), helpers.prose(r, 30, 400), r.choice(some)][: 1 + i % 3])) for i in range(30)]
    df = frame(spark, [(i, t, None, None) for i, t in rows], parts=4)
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"])) for r in substring_dedup.remove(df, window, cell_bits=bits, block_bytes=50_000, broadcast_bytes=0 if bits == 4 else 1 << 20).collect())
    assert got == removed(rows, window)


def test_the_sketch_filters_alike_at_every_size(spark):
    """Words of unrepeated windows that pass the sketch, and rows of the exchange, as the input grows."""
    r = random.Random(3)
    docs = [(k, " ".join(f"w{r.randrange(50_000)}" for _ in range(400)) + (" same" * 40 if k % 5 == 0 else "")) for k in range(160)]
    passed, rows = [], []
    for n in (40, 80, 160):
        df = frame(spark, [(i, t, None, None) for i, t in docs[:n]], parts=2)
        blocks = exchange.blocks_of(df, 8000)
        shards = 2 * n  # as many as the text asks for at scale
        flags = substring_dedup.sketch(blocks, shards, 32, 35, 8).collect()
        bits = [np.unpackbits(np.frombuffer(b, np.uint8)) for f in flags for b in exchange.parts(bytes(f["flags"]))]
        passed.append(sum(int(b.sum()) for b in bits) / sum(map(len, bits)))
        asked = exchange.answers_of(blocks, shards, lambda t, s=shards: ((k, b"") for k, _, _ in exchange.split_high(np.unique(substring_dedup.cells(substring_dedup.Block(*substring_dedup.read(t["text"].cast("binary").to_pylist()), 35, 8).anchors(), s, 32)))), lambda blobs: (blobs, None))
        rows.append(asked.count())
    assert max(passed) < 0.05 and rows[1] < 2.6 * rows[0] and rows[2] < 2.6 * rows[1]


def test_dedup_of_nothing(spark):
    assert substring_dedup.remove(frame(spark, awkward()).limit(0)).count() == 0
    row = substring_dedup.remove(frame(spark, [(1, None, None, None)])).first()
    assert (row["n_words"], row["n_removed"], bytes(row["kept"])) == (0, 0, b"")


def test_query_digests_the_kept_words(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {(i, n, g, hashlib.sha256(k).hexdigest()) for i, n, g, k in removed(rows, 35)}
    assert {tuple(r) for r in QUERIES["op3_substring_dedup"](spark, sf).collect()} == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=120), st.integers(2, 9), st.integers(1, 9))
def test_anchors_never_count_less_than_windows(tokens, window, gram):
    gram = min(gram, window)
    h = mix(np.array(tokens, np.uint64) + np.uint64(1))
    block = substring_dedup.Block(h, np.array([len(h)]), window, gram)
    anchors = Counter(block.anchors().tolist())
    found = Counter(zip([tuple(tokens[i : i + window]) for i in range(block.count)], block.least.tolist(), strict=True))
    assert all(anchors[least] >= n for (_, least), n in found.items())


def test_joins_what_comparing_all_says(spark):
    r = random.Random(5)
    rows = [(i, t) for i, t, _, _ in awkward() if i is not None]
    for g in range(12):
        base = [f"g{g}w{int(r.paretovariate(1))}x{k % 40}" for k in range(r.choice([8, 30, 60, 200]))]
        for _ in range(r.choice([2, 5, 14])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = f"new{r.randrange(9)}"
            rows.append((1000 + len(rows) * 7 % 997, " ".join(w[: len(w) - r.choice([0, 0, 1, 3])])))
    df = frame(spark, [(i, t, None, None) for i, t in rows], parts=4)
    for n, least, blocks in ((3, 90, {}), (3, 90, {"block_docs": 3}), (5, 80, {"block_shingles": 100, "hot": 50})):
        want, sets = helpers.components(rows, n, least), helpers.shingle_sets(rows, n)
        got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.join(df, n, least, **blocks).collect()}
        assert got == {(i, len(s), want[i]) for i, ss in sets.items() for s in ss}
        assert len(set(want.values())) < len(want)


def test_join_of_any_ids(spark):
    base = [f"w{k}" for k in range(120)]
    far = [*base[:-6], *(f"z{k}" for k in range(6))]
    chain = [("b", base), (None, [*base[:-3], "z0", "z1", "z2"]), ("a", far), ("lone", ["x"] * 9), ("twice", ["p"] * 40), ("twice", ["q", "r"] * 20), ("other", ["q", "r"] * 20), (None, ["no", "one"])]
    rows = [(i, " ".join(w)) for i, w in chain]
    want = {"b": "a", "a": "a", "lone": "lone", "twice": "other", "other": "other"}
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    got = [(r["doc_id"], r["component_id"]) for r in jaccard_join.join(df, 5, 90).collect()]
    assert sorted(got, key=str) == sorted([*((i, want[i]) for i, _ in rows if i), (None, "a"), (None, None)], key=str)
    numbers = {"b": 5, "a": 1, "lone": 7, "twice": 3, "other": 2, None: None}
    df = spark.createDataFrame([(numbers[i], t) for i, t in rows], "doc_id int, text string")
    got = [(r["doc_id"], r["component_id"]) for r in jaccard_join.join(df, 5, 90).collect()]
    assert sorted(got, key=str) == sorted([*((numbers[i], numbers[want[i]]) for i, _ in rows if i), (None, 1), (None, None)], key=str)


def test_a_block_asks_only_shards_that_it_has_keys_for():
    keys = np.sort(mix(np.arange(50, dtype=np.uint64)))
    asked = split(keys, 1 << 20)
    assert len(asked) == 50 and all(b - a == 1 for _, a, b in asked) and [a for _, a, _ in asked] == list(range(50))
    assert sum(b - a for _, a, b in split(keys, 8)) == 50 and split(keys[:0], 8) == [] and exchange.split_high(keys[:0]) == []


def test_counts_every_link(spark):
    r = random.Random(6)
    base = [f"w{k}" for k in range(120)]
    rows = [(1, " ".join(base)), (2, " ".join([*base, "x"])), (3, " ".join([*base, "y"])), (4, " ".join(base).upper()), (90, None), (91, "alone")]
    for i in range(10, 40):  # some link with most, some with few
        w = list(base)
        for k in range(r.choice([0, 1, 1, 2])):
            w[40 * k + r.randrange(40)] = f"new{r.randrange(3)}"
        rows.append((i, " ".join(w)))
    sets = [(i, s) for i, ss in helpers.shingle_sets(rows, 3).items() for s in ss]
    want = {i: sum(bool(a and b) and i != j and 100 * len(a & b) >= 90 * len(a | b) for j, b in sets) for i, a in sets}
    df = frame(spark, [(i, t, None, None) for i, t in rows], parts=4)
    for blocks in ({}, {"block_docs": 3}):
        assert {x["doc_id"]: x["n_links"] for x in jaccard_join.join(df, 3, 90, **blocks).collect()} == want
    assert want[1] >= 3 and want[90] == want[91] == 0 and len(set(want.values())) > 3


def test_join_of_awkward_rows(spark):
    rows = awkward()
    out = jaccard_join.join(frame(spark, rows), 3, 90).collect()
    assert len(out) == len(rows)
    got = {r["doc_id"]: r["component_id"] for r in out}
    assert (got[1], got[2], got[3], got[4], got[5], got[8], got[9]) == (1, 2, 3, 4, 4, 7, 7) and got[None] is None
    assert jaccard_join.join(frame(spark, rows).limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), min_size=1), min_size=1, max_size=14), st.sampled_from([50, 70, 90]), st.integers(0, 14))
def test_search_finds_all_that_is_linked(found, least, indexed):
    sets = [np.array(sorted(s), np.uint64) for s in found]
    order = sorted(range(len(sets)), key=lambda k: (len(sets[k]), k))
    linked = lambda a, b: 100 * len(found[a] & found[b]) >= least * len(found[a] | found[b])
    for upto in (None, min(indexed, len(sets))):
        want, got = helpers.Groups(), helpers.Groups()
        for b in range(len(sets)):
            for a in range(b):
                if (upto is None or a < upto <= b) and linked(a, b):
                    want.join(a, b)
        for a, b in jaccard_join.search(sets, order, upto, least):
            assert linked(a, b)
            got.join(a, b)
        assert [want.find(k) for k in range(len(sets))] == [got.find(k) for k in range(len(sets))]


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 400), st.integers(0, 45), st.integers(0, 45), st.randoms(), st.sampled_from([70, 80, 90]))
def test_linked_sets_share_a_token(common, a, b, r, least):
    x, y = (list(range(1000, 1000 + common)) + [n * 10_000 + k for k in range(m)] for n, m in ((1, a), (2, b)))
    if 100 * common < least * (common + a + b):
        return
    place = {t: r.randrange(1 << 64) for t in x + y}
    counts = {place[t]: r.choice([2, 2, 2, 3, 40]) if t in x and t in y else r.choice([1, 1, 2, 40]) for t in x + y}
    ends = jaccard_join.intervals(2000, least)
    sets = [np.unique(np.array([place[k] for k in z], np.uint64)) for z in (x, y)]
    s, t = (jaccard_join.by_size(jaccard_join.prefix_of(z, np.array([counts[k] for k in z.tolist()]), least), len(z), ends) for z in sets)
    assert set(s.tolist()) & set(t.tolist())


def test_steps_keep_the_order_of_counts():
    n = np.arange(1, 100_000)
    s = jaccard_join.steps(n)
    assert (np.diff(s.astype(int)) >= 0).all() and (s[n < 2] < 2).all() and (s[n > 1] > 1).all()
    assert jaccard_join.steps(np.array([1 << 40]))[0] == 255


@pytest.mark.parametrize("least", [50, 70, 90, 100])
def test_partners_are_in_neighbouring_intervals(least):
    ends = jaccard_join.intervals(3000, least)
    place = lambda n: next(k for k, e in enumerate(ends) if n <= e)
    assert all(place(n * 100 // least) - place(n) <= 1 for n in range(1, 1400))


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100) for i in range(50)] + [(300, 300)] + [(r.randrange(400, 480), r.randrange(400, 480)) for _ in range(50)]
    groups = helpers.Groups()
    for a, b in edges:
        groups.join(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: groups.find(n) for e in edges for n in e}


def test_components_never_end_early(spark):
    with pytest.raises(RuntimeError, match="no fixed point"):
        components(spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long"), rounds=2)


def held(docs, items):
    def shingles(w, n):
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    out = Counter()
    for item, t in items:
        w = lower(t)
        if w:
            n = min(5, len(w))
            own = shingles(w, n)
            for i, text in docs:
                m = len(own & shingles(lower(text), n))
                if 100 * m >= 80 * len(own):
                    out[i, item, len(own), m, round(m / len(own), 9)] += 1
    return out


def test_finds_items_in_documents(spark):
    r = random.Random(9)
    docs = [(i, t) for i, t, _, _ in awkward()]
    items = [(k, helpers.prose(r, n, 4000)) for k, n in enumerate([1, 2, 4, 5, 6, 9, 30, 100, 400])] + [(50, None), (51, ""), (52, "two Words"), (53, "ONE"), (6, "w1 w2")]
    for n, (k, t) in enumerate(items):
        if t:
            w = t.split()
            for cut in (0, len(w) // 8, len(w) // 4):
                docs.append((500 + 10 * n, " ".join([helpers.prose(r, 50, 4000), *w[: len(w) - cut], helpers.prose(r, 50, 4000)]).upper()))
    df, it = frame(spark, [(i, t, None, None) for i, t in docs]), spark.createDataFrame(items, "item_id long, text string")
    want = held(docs, items)
    for block in (32 << 20, 500):
        got = Counter((r["doc_id"], r["item_id"], r["n_item_shingles"], r["n_shared"], round(r["containment"], 9)) for r in decontamination.find(df, it, block_bytes=block).collect())
        assert got == want
    dirty = {i for i, *_ in want}
    kept = decontamination.clean(df, it, block_bytes=500)
    assert kept.columns == df.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, t in docs if not any(held([(i, t)], items)))
    assert dirty and decontamination.find(df, it.limit(0)).count() == 0 and decontamination.find(df.limit(0), it).count() == 0 and decontamination.clean(df, it.limit(0)).count() == len(docs)
