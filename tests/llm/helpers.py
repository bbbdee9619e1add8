"""Small tables with everything that is awkward, and plain versions to compare with."""

import random

from pyspark.sql import functions as F

#: Columns whose names the operators use inside.
CLASHING = ("n_words", "kept", "hash", "row", "copies", "shard", "piece", "grp", "size", "n", "h1", "key", "rate", "count", "taken", "rep", "node", "component", "block", "dest", "col", "doc", "id", "label", "prefix", "a.b", "tick`ed", "two words", "nth", "members", "many", "cluster", "tokens", "docs")


def prose(r, n, words=60):
    return " ".join(f"w{int(r.paretovariate(0.6)) % words}" for _ in range(n))


def awkward():
    """(doc_id, text, lang, source): nulls, empty and very long texts, ties, repeated rows, near copies."""
    r = random.Random(7)
    base, shared = prose(r, 200, 5000), prose(r, 60, 5000)
    near = base.split()
    near[100] = "changed"
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\x0b\x0c\r ", "de", "b"), (4, "one", "en", "b"), (5, "One", "en", None), (6, "two words", None, None),
        (7, base, "en", "a"), (8, base, "en", "a"), (9, base.upper(), "de", "b"), (10, " ".join(near), "en", "c"), (10, " ".join(near), "en", "c"),
        (11, prose(r, 60_000, 30_000), "de", "c"), (12, "x" * 300_000, "en", "c"), (13, "a " * 500, "en", "a"), (14, "5 6 7 ... !!! 42", None, "b"),
        (15, prose(r, 300, 5000) + " " + shared, "de", "a"), (16, shared + "\n" + prose(r, 300, 5000), "de", "b"), (17, "é ü   日本語 " * 40, "de", "c"), (18, "l1 a b c\nl1 a b c\n\nl1 a b c " * 9, "en", "a"),
        (None, prose(r, 120, 5000), "en", "a"), (None, None, None, None), (-5, prose(r, 80, 5000), "en", ""), (2**40, "word " * 49, "en", "a"),
    ]
    return rows + [(100 + i, prose(r, 90 + i % 7, 4000), "en" if i % 3 else "de", f"s{i % 4}") for i in range(40)]


def frame(spark, rows, parts=3, clash=True):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(parts)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING}) if clash else df


def words(text):
    return (text or "").encode().split()


def lower(text):
    return (text or "").encode().lower().split()


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingle_sets(rows, n):
    out = {}
    for i, t in rows:
        w = lower(t)
        out.setdefault(i, []).append(frozenset(tuple(w[k : k + min(n, len(w))]) for k in range(len(w) - min(n, len(w)) + 1)) if w else frozenset())
    return out


def components(rows, n, least):
    """id -> smallest id reachable, by comparing all with all."""
    sets, groups = [(i, s) for i, ss in shingle_sets(rows, n).items() if i is not None for s in ss], Groups()
    for k, (i, a) in enumerate(sets):
        groups.find(i)
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= least * len(a | b):
                groups.join(i, j)
    return {i: groups.find(i) for i, _ in sets}
