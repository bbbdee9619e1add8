import itertools
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from stratum.functions import hashing, ids, paths, texts
from stratum.functions.globs import Ignore, matches_all
from stratum.operators.cache import EPOCH_TICKS, ticks
from stratum.sources import manifest_json

FILES = [("a.txt", b"hello"), ("b/two.txt", b"two"), ("empty", b"")]


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def test_golden_hashes(spark):
    files = frame(spark, [(p, len(c), bytearray(c)) for p, c in FILES], "path string, bytes long, content binary")
    got = {r["path"]: r["d"] for r in files.select("path", hashing.file_digest("path", "bytes", "content").alias("d")).collect()}
    assert got["a.txt"] == "5F12E775A1F29C25A5AB449AFA7A61D89B90B3C3E910DE1D89EE8C6B244DC4D1"
    assert got["b/two.txt"] == "7E7DD4750C36E89E3C68ACF7A1F23480CCB4185E755CD7608F404C91EB94ECF0"
    assert got["empty"] == "1CA56F1E9B3454B8276AF24EA4A2502EDFD3E4217DC40CDED1E95B8E59DF0E44"
    row = hashing.snapshot_hashes(files, []).first()
    assert row["snapshot_hash"] == "D8EE40281CEFAF4563D2AA08BE48307752189810B02C4610D7C25333E6A2D702"
    assert (row["file_count"], row["total_bytes"]) == (3, 8)
    assert hashing.snapshot_hashes(files.limit(0), []).first()["snapshot_hash"] == hashing.EMPTY_SHA256
    listed = files.withColumn("chunk_hashes", F.when(F.col("bytes") > 0, F.array(hashing.sha256("content"))).otherwise(F.array().cast("array<string>")))
    assert hashing.manifest_hashes(listed, []).first()[0] == "243BC0FABEA2F027C288042F36E72BD91D33E98001A4CD91A126B4DBEF24299A"


def test_a_missing_digest_is_an_error(spark):
    rows = frame(spark, [("a", 1, "")], "path string, bytes long, digest string")
    with pytest.raises(Exception, match="no digest"):
        hashing.fold_digests(rows, []).collect()


def test_ignore_rules(spark):
    rules = Ignore((".stratum/**", ".git/**", "bin/**", "obj/**", "/top.txt"), ("*.tmp", "*.log", "*.user", "a?.txt"), ("cache/",))
    out = ["bin/a.dll", "src/bin/x.c", "obj/deep/z", "x/cache/y.c", "foo.tmp/bar.txt", "A.TMP", "ab.txt", "s/ab.txt", "top.txt"]
    kept = ["cabin/x.c", "bin", "cache", "s/top.txt", "a.txt", "log", "x.log.txt"]
    got = {r[0]: r[1] for r in frame(spark, [(p,) for p in out + kept], "p string").select("p", rules.excluded("p")).collect()}
    assert [p for p in out if not got[p]] == [] and [p for p in kept if got[p]] == []
    folder = frame(spark, [("foo.tmp",), ("bin",), ("x/cache",)], "p string").select("p", rules.folder("p"))
    assert {r[0]: r[1] for r in folder.collect()} == {"foo.tmp": False, "bin": True, "x/cache": True}


def test_defaults_are_a_union_without_case():
    rules = Ignore(("BIN/**", " "), ("*.TMP",)).with_defaults()
    assert rules.common == ("BIN/**", ".stratum/**", ".git/**", "obj/**") and rules.files == ("*.TMP", "*.log", "*.user")


def test_globs_must_all_match(spark):
    df = frame(spark, [("Abc",), ("abd",), ("a.c",)], "i string")
    assert [r[0] for r in df.where(matches_all("i", ["a*", "*C"])).collect()] == ["Abc", "a.c"]
    assert [r[0] for r in df.where(matches_all("i", ["a.?"])).collect()] == ["a.c"]


def test_uuid7_layout():
    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    u = ids.uuid7(now, lambda n: b"\xff" * n)
    assert u[14] == "7" and u[19] in "89ab" and int(u.replace("-", "")[:12], 16) == int(now.timestamp() * 1000)
    assert ids.new_id(lambda: now, lambda n: b"\0" * n) == "20240101T000000Z_018cc251-f400-7000-8000-000000000000"


@pytest.mark.parametrize("age,want", [("30d", (2024, 3, 1)), ("2w", (2024, 3, 17)), ("1MO", (2024, 2, 29)), ("13mo", (2023, 2, 28)), ("1y", (2023, 3, 31))])
def test_ages(age, want):
    assert ids.ago(age, datetime(2024, 3, 31)) == datetime(*want)


def test_bad_age():
    with pytest.raises(ValueError):
        ids.ago("3 days", datetime(2024, 1, 1))


def test_times():
    assert ids.parse_time("2025-01-01") == datetime(2025, 1, 1, tzinfo=timezone.utc)
    assert ids.local_midnight("2025-01-01", timezone(timedelta(hours=9))) == datetime(2024, 12, 31, 15, tzinfo=timezone.utc)
    assert ticks(0) == EPOCH_TICKS


def test_selectors(spark):
    rows = [("main", f"2024010{k}T000000Z_{k}", datetime(2024, 1, k)) for k in (1, 2, 3)] + [("main", "20240102X", datetime(2023, 1, 1))]
    df = frame(spark, rows, "space string, snapshot_id string, created_utc timestamp")
    assert ids.resolve(df, "@0") == "20240103T000000Z_3" and ids.resolve(df, "@3") == "20240102X"
    assert ids.resolve(df, "20240103t") == "20240103T000000Z_3" and ids.resolve(df, "20240102x") == "20240102X"
    assert ids.resolve(df, "@1", "verify") == "20240103T000000Z_3" and ids.resolve(df, "@0", "textdiff") == "20240102X"
    with pytest.raises(LookupError, match="4 snapshots"):
        ids.resolve(df, "2024")
    with pytest.raises(LookupError):
        ids.resolve(df, "20240103t", "export")
    with pytest.raises(LookupError):
        ids.resolve(df, "@9")
    with pytest.raises(ValueError):
        ids.resolve(df, "2024", "diff")


def test_created_times(spark):
    none = datetime(2020, 5, 6)
    want = {
        "20240101T000000Z_x": datetime(2024, 1, 1), "20240101T000000Z": none, "backup_20240203": datetime(2024, 2, 3), "a_b_20240203": none, "20241301T000000Z_x": none,
        "20240229T235959Z_a": datetime(2024, 2, 29, 23, 59, 59), "_20230101": datetime(2023, 1, 1), "x_20230230": none, "": none,
    }
    df = frame(spark, [(i,) for i in want], "id string")
    assert {r[0]: r[1] for r in df.select("id", ids.created_utc("id", F.to_timestamp(F.lit("2020-05-06")))).collect()} == want


def test_canonical_paths(spark):
    want = {"20240101T000000Z_a": "20240101T000000Z_a", " /x/20240101t000000z_A/snapshots/a/b.txt": "a/b.txt", "snapshots/c.txt": "c.txt", "/d.txt": "d.txt", "Snapshots/e/e\u0301.txt": "e/\u00e9.txt", "x/20240101T000000Z_ab/f": "x/20240101T000000Z_ab/f", "20240101T000000Z_a/g": "g", "a\\b": "a/b", "//g": "/g"}
    df = frame(spark, [(i,) for i in want], "raw string")
    assert {r[0]: r[1] for r in df.select("raw", paths.canonical("raw", F.lit("20240101T000000Z_a"))).collect()} == want


def test_spaces_and_specs(spark):
    assert ids.effective_space(None, " ", "x") == "x" and ids.effective_space() == "main"
    assert ids.source_spec("a:@1", "main") == ("a", "@1") and ids.source_spec("@1", "main") == ("main", "@1")
    assert ids.space_and_selector([]) == (None, None) and ids.space_and_selector(["work", "@1"], "main") == ("work", "@1") and ids.space_and_selector(["@1"], "main") == ("main", "@1")
    for words in (["Bad"], ["@1", "@2"], ["work", "@1", "x"]):
        with pytest.raises(ValueError):
            ids.space_and_selector(words)
    df = frame(spark, [("@1",), ("2024",), ("work_a",), ("main",)], "t string")
    assert [r[0] for r in df.select(ids.looks_like_id("t")).collect()] == [True, True, True, False]


def test_path_functions(spark):
    df = frame(spark, [("a/b/c.txt",), ("x",), ("/l\\m",)], "p string")
    assert [r[0] for r in df.select(paths.ancestors("p")).collect()] == [["a", "a/b"], [], ["l"]]
    assert [r[0] for r in df.select(paths.normalize("p")).collect()] == ["a/b/c.txt", "x", "l/m"]
    assert [r[0] for r in df.select(paths.stem("p")).collect()][:2] == ["c", "x"]
    safe = frame(spark, [("a/b",), ("../x",), ("a/../b",), ("/x",), ("",), ("C:/x",), ("a..b",)], "p string").select(paths.safe("p"))
    assert [r[0] for r in safe.collect()] == [True, False, False, False, False, False, True]


def test_size_bins_and_figures(spark):
    sizes = [65535, 65536, 262144, 1048576, 4194304, 16777216]
    df = frame(spark, [(s,) for s in sizes], "n long")
    assert [r[0] for r in df.select(texts.size_bin("n")).collect()] == list(range(6))
    shown = frame(spark, [(0,), (1023,), (1536,), (5 << 20,), (3 << 40,)], "n long").select(texts.humanize("n"))
    assert [r[0] for r in shown.collect()] == ["0 B", "1023 B", "1.5 KB", "5 MB", "3 TB"]
    assert [r[0] for r in frame(spark, [(1, 0), (1, 2), (1, None)], "a long, b long").select(texts.ratio("a", "b")).collect()] == [0.0, 0.5, 0.0]


def test_binary_sniff(spark):
    cases = [(b"plain", False), (b"a\0b", True), (b"", False), (b"a" * 4096 + b"\0", False), (b"\x01" + b"a" * 8, True), (b"\x01" + b"a" * 9, False), (b"\x01\x02" + b"a" * 17, True), (b"\t\n\r" * 9, False)]
    df = frame(spark, [(i, bytearray(c)) for i, (c, _) in enumerate(cases)], "i int, c binary").orderBy("i")
    assert [r[0] for r in df.select(texts.is_binary("c")).collect()] == [w for _, w in cases]


def test_notes_and_lines(spark):
    df = frame(spark, [("a", "b"), ("a\n", "b"), ("a\r", "b"), ("", "b"), (None, "b")], "o string, m string")
    assert [r[0] for r in df.select(texts.note_append("o", "m")).collect()] == ["a\nb", "a\nb", "a\rb", "b", "b"]
    line = frame(spark, [("a \r\nb\t\rc",)], "t string")
    assert line.select(texts.normalize_lines("t", True)).first()[0] == "a\nb\nc" and line.select(texts.to_crlf("t")).first()[0] == "a \r\nb\t\r\nc"


def test_loose_json():
    text = '{ // a comment\n "Exclude": ["x", "a//b", /* no */ ], "excludefiles": ["*.z",],}'
    assert manifest_json.loose_json(text) == {"Exclude": ["x", "a//b"], "excludefiles": ["*.z"]}
    assert manifest_json.ignore_rules(text).files[0] == "*.z" and manifest_json.ignore_rules("broken {").common[0] == ".stratum/**"
    h = "ab" * 32
    assert manifest_json.refcounts(f'{{"{h}": 2, "x": 1}}') == {h.upper(): 2}


def test_inventories_of_any_layout(spark):
    docs = ['{"Files":[{"RelativePath":"a","Bytes":1,"sha256":"h"},{"Path":"b","size":"2"}]}', '[{"name":"c","length":3}]', '{"x":{"y":[{"rel":"d","Size":-1}]}}', "broken", '{"x":{"y":[{"rel":"d","Size":4}]}}']
    df = frame(spark, [(str(i), d) for i, d in enumerate(docs)], "file string, text string")
    got = {(r["file"], r["path"], r["length"], r["fingerprint"]) for r in manifest_json.inventory(df).collect()}
    assert got == {("0", "a", 1, "h"), ("0", "b", 2, None), ("1", "c", 3, None), ("4", "d", 4, None)}
    docs = ['{"other":[{"name":"x","size":1}],"files":[{"name":"y","size":2}]}', '{"Files":[{"name":"x"}],"other":[{"name":"z","size":3}]}', '{"a":[],"b":[{"name":"x","size":1}]}', '{"a":[1],"b":[{"name":7,"size":" 5 "}]}', '{"a":{"b":{"c":[{"name":"x","size":1}]}}}']
    df = frame(spark, [(str(i), d) for i, d in enumerate(docs)], "file string, text string")
    assert {(r["file"], r["path"], r["length"]) for r in manifest_json.inventory(df).collect()} == {("0", "y", 2), ("3", "7", 5)}


def test_every_id_is_new():
    assert len({ids.new_id() for _ in itertools.repeat(None, 100)}) == 100
