"""Sharding and mixing."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from stratum.llm import mixing, sharding
from stratum.llm.common import beside, cut, numbered, shared_folder
from tests.llm.helpers import awkward, frame, prose, words


def laid_out(out, rows, shards):
    """Checks the law; returns how many groups are in more than one shard, by size."""
    counts, slots = Counter(r["shard"] for r in out), defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert len(out) == len(rows) and set(counts) <= set(range(shards))
    assert max(counts.values()) - min(counts.get(s, 0) for s in range(shards)) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    assert {r["law"] for r in out} == {"rows"} and {r["grown_shard"] for r in out} == {None}
    groups = defaultdict(list)
    for r in out:
        groups[r["size"], r["text_crc32"]].append(r["shard"])
    return [(len(g), len(set(g))) for g in groups.values() if len(g) > 1]


def test_groups_come_together(spark):
    r = random.Random(1)
    rows = [(k, f"text {k if r.random() < 0.5 else r.randrange(40)}", None, None) for k in range(800)]
    groups = laid_out(sharding.assign(frame(spark, rows), 8).collect(), rows, 8)
    assert len(groups) > 30 and sum(n > 1 for _, n in groups) <= 1


def test_a_group_larger_than_a_shard(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE", 20)
    rows = [(k, "the same" if k < 400 else f"text {k // 2 if k < 700 else k}", None, None) for k in range(1000)]
    groups = laid_out(sharding.assign(frame(spark, rows), 10).collect(), rows, 10)
    assert sum(n > 1 for size, n in groups if size == 2) <= 30
    found = Counter(r["shard"] for r in sharding.assign(frame(spark, rows), 10).collect() if r["doc_id"] < 400)
    assert sum(n for _, n in found.most_common(6)) >= 360


def test_full_shards_trade_until_groups_are_whole(spark):
    rows = [(k, f"text {k // 10}", None, None) for k in range(4000)]  # every row is linked: shards have no room to spare
    groups = laid_out(sharding.assign(frame(spark, rows), 40).collect(), rows, 40)
    assert len(groups) == 400 and sum(n > 1 for _, n in groups) <= 4


def test_what_is_beyond_a_quota_moves_by_group(spark):
    held = spark.createDataFrame([(g, 0, 4) for g in range(20)], "grp long, shard int, n long")
    out = sharding.settle(held, [40, 22, 18]).collect()
    assert [sum(r["n"] for r in out if r["shard"] == s) for s in range(3)] == [40, 22, 18]
    assert len(out) <= 22 and {g: sum(r["n"] for r in out if r["grp"] == g) for g in range(20)} == dict.fromkeys(range(20), 4)


def test_reruns_agree(spark):
    rows = awkward()
    one, two = (sorted(map(tuple, sharding.assign(frame(spark, x, parts=p), 7).collect()), key=repr) for x, p in ((rows, 2), (rows[::-1], 5)))
    assert one == two
    laid_out(sharding.assign(frame(spark, rows), 7).collect(), rows, 7)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_fewer_rows_than_shards(spark, n):
    rows = awkward()[:n]
    out = sharding.assign(frame(spark, rows, parts=1), 5).collect()
    assert len(out) == n and (not n or laid_out(out, rows, 5) is not None)


def filled(sizes, weights, share, most):
    """Targets by resharing what is above the caps until nothing is."""
    target, left, open_ = dict.fromkeys(sizes, 0.0), share * sum(sizes.values()), set(sizes)
    while open_ and left > 1e-9:
        total = sum(weights[s] for s in open_)
        part = {s: left * weights[s] / total for s in open_}
        over = {s for s in open_ if target[s] + part[s] > most * sizes[s]}
        if not over:
            return {s: target[s] + part.get(s, 0) for s in sizes}
        for s in over:
            left -= most * sizes[s]
            target[s] = most * sizes[s]
            open_.discard(s)
    return target


def mixed(out, rows):
    sizes, taken, target = Counter(), Counter(), {}
    for i, t, _, s in rows:
        sizes[s] += len(words(t))
    for r in out:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] and r["source_size"] == sizes[r["source"]]
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    want = filled(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5, 2)
    assert all(abs(target[s] - want[s]) <= 1e-6 * (1 + want[s]) for s in sizes)
    return sizes, taken, target


@pytest.mark.parametrize("seed", [1, 2])
def test_sources_meet_their_targets(spark, seed, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE", 60)
    r = random.Random(seed)
    rows = [(k, " ".join(["w"] * min(4000, int(30 * r.paretovariate(1.1)))), None, r.choice(["a"] * 9 + ["B", "é", "z", "𝒳", "", "", None])) for k in range(700)]
    out = mixing.mix(frame(spark, rows)).collect()
    sizes, taken, target = mixed(out, rows)
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-3
    assert all(abs(taken[s] - target[s]) < 0.03 * target[s] + 60 for s in sizes)


def test_rates_solve_the_dual(spark):
    r = random.Random(5)
    rows = [(k, " ".join(["w"] * r.randrange(1, 300)), None, f"s{k % 3}") for k in range(300)]
    by = defaultdict(list)
    for x in mixing.mix(frame(spark, rows)).collect():
        by[x["source"]].append((x["size"], x["rate"], x["target"]))
    for found in by.values():
        assert abs(sum(n * w for n, w, _ in found) - found[0][2]) < 1e-4 * found[0][2]
        rates = [w for _, w, _ in sorted(found)]
        assert rates == sorted(rates) or rates == sorted(rates, reverse=True)  # tilted one way by size


def test_mixing_reruns_agree(spark):
    rows = awkward()
    key = lambda r: repr((r["doc_id"], r["size"], r["source"], r["taken"], round(r["target"], 6)))
    one, two = (sorted(map(key, mixing.mix(frame(spark, x, parts=p)).collect())) for x, p in ((rows, 2), (rows[::-1], 5)))
    assert one == two and len(one) == len(rows)
    mixed(mixing.mix(frame(spark, rows)).collect(), rows)


@pytest.mark.parametrize("ids", [lambda k: 7, lambda k: None, lambda k: k % 3])
def test_rows_of_one_id_are_dealt_out(spark, monkeypatch, ids):
    monkeypatch.setattr(mixing, "PIECE", 100)
    monkeypatch.setattr(sharding, "PIECE", 100)
    rows = [(ids(k), f"text {'same' if k % 2 else k % 900}", None, "a" if k % 4 else "b") for k in range(10_000)]
    df = frame(spark, rows, clash=False)
    base = cut(df.select("doc_id", "text"))
    dealt = numbered(base, ["doc_id", "text"], 100).groupBy(F.pmod(F.xxhash64("doc_id", "text", "nth"), F.lit(100))).count().collect()
    assert sum(r["count"] for r in dealt) == len(rows) and max(r["count"] for r in dealt) < 400
    laid_out(sharding.assign(df, 8).collect(), rows, 8)
    sizes, taken, target = mixed(mixing.mix(df).collect(), rows)
    assert all(abs(taken[s] - target[s]) < 0.01 * target[s] + 60 for s in sizes)


def looked_up(spark, work):
    """Rows that the left joins on groups or on ids made while ``work`` ran, by Spark's own counts."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    last, made = max([-1, *(x.executionId() for x in each(store.executionsList()))]), Counter()
    work()
    bus.waitUntilEmpty()
    for k in (x.executionId() for x in each(store.executionsList()) if x.executionId() > last):
        counts = store.executionMetrics(k)
        for node in each(store.planGraph(k).allNodes()):
            key = re.search(r"(grp|doc_id)#\d+.*LeftOuter", node.desc())
            for m in each(node.metrics()) if key else ():
                if m.name() == "number of output rows" and counts.contains(m.accumulatorId()):
                    made[key[1]] += int(counts.apply(m.accumulatorId()).replace(",", ""))
    return made


def each(seq):
    return (seq.apply(k) for k in range(seq.size()))


def test_group_sizes_are_looked_up_once(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE", 50)
    rows = [(k if k < 800 else 7, "the same" if k % 2 else f"text {k // 4}", None, None) for k in range(2000)]  # a large group, small ones, many rows of one id
    out = []
    made = looked_up(spark, lambda: out.extend(sharding.assign(frame(spark, rows), 8).collect()))
    laid_out(out, rows, 8)
    # a row goes by the large groups and, if it is in none, by the others; and twice by the ids that repeat, as the two are told apart
    assert 2000 < made["grp"] <= 2 * 2000 and 0 < made["doc_id"] <= 2 * 2000


def test_many_sources_are_joined_salted(spark):
    rows = cut(spark.range(1000).selectExpr("id", "CASE WHEN id < 500 THEN 'hot' ELSE 's' || id END key"))
    few = cut(rows.groupBy("key").count())
    for most in (10_000, 5):
        out = beside(rows, few, ["key"], ["id"], most=most)
        assert out.columns == ["key", "id", "count"] and out.count() == 1000 and out.where("key = 'hot'").agg(F.sum("count")).first()[0] == 250_000


def test_an_unsolved_dual_raises(spark):
    rows = [(k, "w " * (1 + k % 40), None, f"s{k % 2}") for k in range(50)]
    sizes = cut(spark.createDataFrame([("0s0", 5, 10), ("0s0", 9, 4)], "key string, size long, n long"))
    sources = cut(spark.createDataFrame([("0s0", 86, 14, 120.0)], "key string, source_size long, docs long, target double"))
    with pytest.raises(RuntimeError, match="not solved"):
        mixing.dual(sources, sizes, 2, 0.5, rounds=1)
    assert mixing.dual(sources, sizes, 2, 0.5).count() == 1 and mixing.mix(frame(spark, rows)).count() == 50


def test_no_local_folder_on_a_cluster():
    class Context:
        def __init__(self, master):
            self.master = master

        def getCheckpointDir(self):
            return None

    class Session:
        def __init__(self, master, folder=None):
            self.sparkContext, self.conf, self.folder = Context(master), self, folder

        def get(self, name, default):
            return self.folder

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_folder(Session(master))
        assert shared_folder(Session(master, "hdfs:///c")) == "hdfs:///c"
    assert all(shared_folder(Session(m)) for m in ("local", "local[*]", "local[4,2]"))


def test_mixing_nothing(spark):
    assert mixing.mix(frame(spark, awkward()).limit(0)).count() == 0
    out = mixing.mix(frame(spark, [(1, None, None, "a"), (2, "", None, None)])).collect()
    assert {(r["size"], r["taken"], r["target"]) for r in out} == {(0, 0, 0.0)}


def test_only_dataframe_operations(spark):
    df = frame(spark, [(k, prose(random.Random(k), 9), None, f"s{k % 2}") for k in range(20)], clash=False)
    for out in (sharding.assign(df, 4), mixing.mix(df)):
        plan = out._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
