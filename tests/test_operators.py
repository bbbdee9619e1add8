import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratum.functions import hashing
from stratum.functions.globs import path_glob
from stratum.operators import cache, cas, chunking, diffs, manifests, retention, trees, verify

M64 = (1 << 64) - 1


def naive_cuts(data, average, least, most, read_size):
    """Byte by byte, as the cutter's description says."""
    import math

    k = max(1, round(math.log2(average)))
    out, n, h = [], 0, 0
    for i, b in enumerate(data, 1):
        h = ((h << 1) + int(chunking.GEAR[b])) & M64
        n += 1
        if n == most:
            out.append(n)
            n = h = 0
        elif (i % read_size == 0 or i == len(data)) and n >= least and h & ((1 << (max(1, k - 1) if n >= average else k)) - 1) == 0:
            out.append(n)
            n = h = 0
    return [*out, n] if n else out


def test_gear_table():
    golden = {0: 0x6E789E6AA1B965F4, 1: 0x06C45D188009454F, 2: 0xF88BB8A8724C81EC, 3: 0x1B39896A51A8749B, 255: 0xCBDC6D34B7C7534D}
    assert {i: int(chunking.GEAR[i]) for i in golden} == golden


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=600), st.integers(1, 5), st.integers(0, 20), st.integers(0, 40), st.integers(1, 64))
def test_cuts_agree_with_a_byte_by_byte_version(data, least, more, most, read_size):
    average = least + more
    got = chunking.cuts(data, average, least, average + most, read_size)
    assert got == naive_cuts(data, average, least, average + most, read_size)
    assert sum(got) == len(data) and all(0 < n <= average + most for n in got)


@pytest.mark.parametrize("size,want", [(0, []), (99, [99]), (100, [100]), (101, [100, 1]), (300, [100, 100, 100])])
def test_one_read_gives_fixed_blocks(size, want):
    assert chunking.cuts(b"\1" * size, 50, 10, 100) == want


def test_cuts_by_byte_follow_the_content():
    data = random.Random(1).randbytes(20_000)
    a, b = (chunking.cuts_by_byte(x, 256, 64, 1024) for x in (data, b"new" + data))
    assert sum(a) == len(data) and max(a) <= 1024 and min(a[:-1]) >= 64
    ends = lambda c, n: {sum(c[: i + 1]) - n for i in range(len(c))}
    assert len(ends(a, 0) & ends(b, 3)) > len(a) / 2


@pytest.mark.parametrize("sizes", [(0, 1, 2), (1, 0, 2), (2, 1, 0), (2, 3, 4), (5, 1, 4)])
def test_bad_sizes(sizes):
    with pytest.raises(ValueError):
        chunking.check_sizes(*sizes)


def chunked(spark, contents, block=4):
    files = spark.createDataFrame([(p, len(c), bytearray(c)) for p, c in contents.items()], "path string, bytes long, content binary")
    chunks = chunking.with_hashes(chunking.fixed_chunks(files, block))
    return files, chunks, manifests.build(chunks, files, [])


def test_rebuild_gives_back_what_was_cut(spark):
    contents = {"a": b"hello world", "b/c": b"", "d": b"aaaaaaaaaaaa", "e": bytes(range(256))}
    _, chunks, manifest = chunked(spark, contents)
    stored = chunks.dropDuplicates(["hash"])
    assert {r["path"]: bytes(r["content"]) for r in manifests.rebuild(manifest, stored, []).collect()} == contents
    counts = {r["hash"]: r["n"] for r in cas.refcount(manifest).collect()}
    assert sum(counts.values()) == chunks.count() and max(counts.values()) == 3
    assert cas.put_if_absent(chunks, stored).count() == 0


def test_rebuild_refuses(spark):
    _, chunks, manifest = chunked(spark, {"a": b"hello"})
    with pytest.raises(Exception, match="missing chunk"):
        manifests.rebuild(manifest, chunks.where("idx > 0"), []).collect()
    with pytest.raises(Exception, match="unsafe path"):
        manifests.rebuild(manifest.withColumn("path", F.lit("../x")), chunks, []).collect()
    with pytest.raises(Exception, match="no chunks"):
        manifests.rebuild(manifest.withColumn("chunk_hashes", F.array().cast("array<string>")), chunks, []).collect()


def test_pick_takes_whole_names(spark):
    _, _, manifest = chunked(spark, {"src/a": b"1", "src2/a": b"2", "src": b"3"})
    assert {r["path"] for r in manifests.pick(manifest, ["src/"]).collect()} == {"src/a", "src"}
    with pytest.raises(LookupError):
        manifests.pick(manifest, ["none"])


def test_statistics_of_nothing_are_zero(spark):
    heads = spark.createDataFrame([("s", "x:1")], "snapshot_id string, version string")
    files = spark.createDataFrame([("s", 5, ["00" * 32])], "snapshot_id string, bytes long, chunk_hashes array<string>")
    stored = spark.createDataFrame([], "hash string, stored_len long")
    row = cas.statistics(heads, files, stored).first()
    assert (row["manifests"], row["files"], row["dedup_factor"], row["compression_ratio"], row["refs_per_file"]) == (0, 0, 0.0, 0.0, 0.0)


def test_statistics_count_each_file_once(spark):
    heads = spark.createDataFrame([("s", "cas:2"), ("s", "cas:2"), ("t", "CAS:1"), ("u", "x:1")], "snapshot_id string, version string")
    a, b, c = ("%064X" % k for k in (1, 2, 3))
    files = spark.createDataFrame([("s", 5, [a, b]), ("s", 0, []), ("t", 7, [a.lower(), a, "bad"]), ("t", 0, None), ("u", 9, [c])], "snapshot_id string, bytes long, chunk_hashes array<string>")
    row = cas.statistics(heads, files, spark.createDataFrame([(a, 4), (c, 1)], "hash string, stored_len long")).first()
    assert tuple(row)[:8] == (2, 4, 12, 4, 2, 1, 1, 4) and (row["dedup_factor"], row["compression_ratio"], row["refs_per_file"]) == (2.0, 3.0, 1.0)


def test_hashes_count_without_case(spark):
    h = "ab" * 32
    files = spark.createDataFrame([([h, h.upper(), "bad", None],)], "chunk_hashes array<string>")
    assert [tuple(r) for r in cas.refcount(files).collect()] == [(h.upper(), 2)]


def inventory(spark, rows):
    return spark.createDataFrame(rows, "path string, length long, fingerprint string")


def test_diff_properties(spark):
    a = inventory(spark, [("x", 1, "h1"), ("y", 2, "h2"), ("z", 3, None)])
    b = inventory(spark, [("y", 2, "h3"), ("z", 4, "h4"), ("w", 0, None)])
    assert {r["kind"] for r in diffs.diff(a, a, True).collect()} == {"Unchanged"}
    ab, ba = ({(r["kind"], r["path_a"], r["path_b"]) for r in diffs.diff(*p, True).collect()} for p in ((a, b), (b, a)))
    swap = {"Added": "Removed", "Removed": "Added"}
    assert ba == {(swap.get(k, k), y, x) for k, x, y in ab}
    assert ("Modified", "y", "y") in ab and ("Unchanged", "y", "y") in {tuple(r) for r in diffs.diff(a, b).collect()}
    assert [r["kind"] for r in diffs.ordered(diffs.diff(a, b)).collect()] == ["Added", "Removed", "Modified", "Unchanged"]


def test_a_fingerprint_is_preferred(spark):
    df = spark.createDataFrame([("p", 9, None, 0), ("p", 1, "h", 1), ("q", 1, None, 0), ("q", 2, None, 1), ("q", 2, None, 2)], "path string, length long, fingerprint string, ordinal long")
    assert {(r["path"], r["ordinal"]) for r in diffs.preferred(df, []).collect()} == {("p", 1), ("q", 2)}


def apply_hunks(a, found):
    lines, out, at = a.split("\n"), [], 0
    for h in found:
        start = h["a_start"] - 1
        out += lines[at:start]
        out += [x[1:] for x in h["lines"] if x[0] != "-"]
        assert [x[1:] for x in h["lines"] if x[0] != "+"] == lines[start : start + h["a_count"]]
        at = start + h["a_count"]
    return "\n".join(out + lines[at:])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=25), st.lists(st.sampled_from("abcd"), max_size=25), st.integers(0, 4))
def test_hunks_apply(a, b, context):
    a, b = "\n".join(a), "\n".join(b)
    found = diffs.hunks(diffs.records(a, b), context)
    assert apply_hunks(a, found) == b
    for h in found:
        assert h["b_count"] == sum(x[0] != "-" for x in h["lines"])
        kept = "".join(" " if x[0] == " " else "x" for x in h["lines"])
        assert " " * (context + 1) not in kept.strip() or kept.strip().count("x") == 0


def test_text_diff(spark):
    a = spark.createDataFrame([("x", bytearray(b"one\r\ntwo\nthree")), ("bin", bytearray(b"\0")), ("gone", bytearray(b"g"))], "path string, content binary")
    b = spark.createDataFrame([("x", bytearray(b"one\n2\nthree")), ("bin", bytearray(b"\0\0")), ("new", bytearray(b"n"))], "path string, content binary")
    sides = [df.select("path", F.octet_length("content").cast("long").alias("length"), F.sha2("content", 256).alias("fingerprint")) for df in (a, b)]
    rows = diffs.text_diff(diffs.diff(*sides, by_content=True), a, b).collect()
    assert [(r["kind"], r["path_a"], r["path_b"], r["added"], r["removed"]) for r in rows] == [("Removed", "gone", None, 1, 1), ("Added", None, "new", 1, 1), ("Modified", "x", "x", 1, 1)]
    assert rows[2]["unified"] == "--- x\n+++ x\n@@ -1,3 +1,3 @@\n one\n-two\n+2\n three"
    assert diffs.carets([h.asDict() for h in rows[2]["hunks"]]) == ["L2-", "two", "L2+", "2", "^"]
    globs = [[r["path_b"] or r["path_a"] for r in diffs.text_diff(diffs.diff(*sides, by_content=True), a, b, include=path_glob(g)).collect()] for g in ("*", "n*", "**/x", "y/**")]
    assert globs == [["gone", "new", "x"], ["new"], ["x"], []]


def test_carets_are_by_hunk():
    hunk = lambda a, b, *lines: {"a_start": a, "b_start": b, "lines": list(lines)}
    assert diffs.carets([hunk(5, 5, "-abcXdef", "+abcYYdef")]) == ["L5-", "abcXdef", "L5+", "abcYYdef", "   ^^"]
    assert diffs.carets([hunk(1, 1, " a", "--- x", "-y", "+++ z", " b", "-c"), hunk(9, 7, "+", "+d")]) == ["L2-", "-- x", "L2+", "++ z", "^^^^", "L3-", "y", "L3+", "", "^", "L5-", "c", "L5+", "", "^", "L7-", "", "L7+", "", "^", "L8-", "", "L8+", "d", "^"]
    assert diffs.marks("abab", "ab") == "  ^" and diffs.marks("same", "same") == "    ^"


def test_digests_stream_in_path_order(spark):
    import hashlib

    rows = [(s, f"p{(k * 37) % 100:03d}é", k) for s in "ab" for k in range(100)]
    df = spark.createDataFrame([(s, p, n, bytearray(p.encode() * n)) for s, p, n in rows], "space string, path string, bytes long, content binary").repartition(7)
    want = {s: hashlib.sha256(b"".join(p.encode() * n for t, p, n in sorted(rows) if t == s)).hexdigest().upper() for s in "ab"}
    assert {r["space"]: r["content_sha256"] for r in hashing.content_concat_hash(df, ["space"]).collect()} == want
    pieces = df.select("space", "path", F.posexplode(F.array(F.col("content"), F.lit(b"."))).alias("idx", "data"))
    assert hashing.content_concat_hash(pieces, ["space"]).count() == 2
    more = df.unionByName(spark.createDataFrame([("a", "x/Meta.JSON", 1, bytearray(b"m"))], df.schema))
    assert hashing.snapshot_hashes(more, ["space"], without_meta=True).orderBy("space").collect() == hashing.snapshot_hashes(df, ["space"]).orderBy("space").collect()
    row = hashing.snapshot_hashes(df.limit(0), []).first()
    assert (row["snapshot_hash"], row["file_count"], row["total_bytes"]) == (hashing.EMPTY_SHA256, 0, 0) and hashing.snapshot_hashes(df.limit(0), ["space"]).count() == 0


def test_merges(spark):
    rows = lambda *p: spark.createDataFrame([(x, n) for x, n in p], "path string, priority int")
    got = trees.recompose(rows(("a", 0), ("a", 1), ("b/c", 1), (".Stratum/x", 0)))
    assert {tuple(r) for r in got.collect()} == {("a", 0), ("b/c", 1)}
    assert {tuple(r) for r in trees.recompose(rows(("x/y", 0), ("x", 1))).collect()} == {("x/y", 0)}
    with pytest.raises(ValueError, match="x is a file in source 0"):
        trees.recompose(rows(("x", 0), ("x/y", 1)))


def test_overlay_moves_what_is_in_the_way(spark):
    df = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    got = {tuple(r) for r in trees.overlay(df("a/b", "c"), df("a", "c/d", "c2", "e")).collect()}
    assert got == {("a/b", "restored"), ("c", "restored"), ("a", "moved"), ("c/d", "moved"), ("c2", "kept"), ("e", "kept")}


def test_tree_has_empty_folders_and_sums(spark):
    files = spark.createDataFrame([("a/b/x", 1), ("a/y", 2), ("z", 4)], "path string, bytes long")
    nodes = {r["path"]: r for r in trees.tree(files, spark.createDataFrame([("e/f",)], "path string")).collect()}
    assert {p: (n["bytes"], n["files"], n["is_dir"]) for p, n in nodes.items()} == {"": (7, 3, True), "a": (3, 2, True), "a/b": (1, 1, True), "a/b/x": (1, 1, False), "a/y": (2, 1, False), "z": (4, 1, False), "e": (0, 0, True), "e/f": (0, 0, True)}
    assert [r["path"] for r in trees.tree_order(trees.tree(files)).where("parent = '' and path <> ''").collect()] == ["a", "z"]


def test_retention_rules(spark):
    from stratum.plans.fixtures import snapshots

    n = lambda **k: retention.targets(snapshots(spark), **k).count()
    assert (n(keep=0), n(keep=2), n(keep=9), n(latest=0), n(latest=2), n(match=["*1", "*2"])) == (5, 3, 0, 0, 2, 0)
    with pytest.raises(ValueError):
        n(keep=1, latest=1)
    assert retention.history(snapshots(spark), take=-1).count() == 5


def test_cache_rows_must_be_old_and_gone(spark):
    rows = spark.createDataFrame([("m", "old-gone", 1), ("m", "old-alive", 1), ("m", "new-gone", 9)], "space string, path string, updated_at_ticks long")
    alive = spark.createDataFrame([("m", "old-alive"), ("n", "old-gone")], "space string, path string")
    assert [r["path"] for r in cache.collectable(rows, alive, 5).collect()] == ["old-gone"]


def test_empty_files_never_hit(spark):
    files = spark.createDataFrame([("e", 0, 1), ("f", 1, 1), ("g", 1, 2)], "path string, size long, mtime_ticks long")
    rows = spark.createDataFrame([("e", 0, 1, "h", "s", []), ("f", 1, 1, "h", "s", ["H"]), ("g", 1, 1, "h", "s", ["H"])], "path string, size long, mtime_ticks long, file_hash string, snapshot_file_hash string, chunk_hashes array<string>")
    stored = spark.createDataFrame([("H",)], "hash string")
    assert {r["path"]: r["hit"] for r in cache.probe(files, rows, stored).collect()} == {"e": False, "f": True, "g": False}


@pytest.mark.parametrize("policy,want", [("error", "PAYLOAD-MISSING"), ("skip", "SKIP-MISSING"), ("hydrate", "MISMATCH"), ("temp", "TEMP-HYDRATE-FAIL")])
def test_policies(spark, policy, want):
    meta = spark.createDataFrame([("m", "a", False, 1, "sha256", "H", 1, 1), ("m", "b", True, 1, "sha256", "h", 1, 1), ("m", "c", True, 1, "skip", "SKIP", 1, 1), ("m", "d", True, None, None, None, None, None)], "space string, snapshot_id string, has_payload boolean, meta_v int, hash_alg string, snapshot_hash string, file_count long, total_bytes long")
    computed = spark.createDataFrame([("m", "a", "X", 1, 1), ("m", "b", "H", 1, 1)], "space string, snapshot_id string, hash string, files long, bytes long")
    got = verify.statuses(meta, computed, policy)
    assert {r["snapshot_id"]: r["status"] for r in got.collect()} == {"a": want, "b": "OK", "c": "ERROR", "d": "META-NOT-FOUND"}
    row = verify.counters(got).first()
    assert (row["total"], row["ok"], row["error"]) == (4, 1, 1)
