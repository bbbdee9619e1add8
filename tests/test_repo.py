import os
import random
from datetime import datetime, timedelta, timezone

import pytest

from stratum import cli
from stratum.functions.globs import Ignore
from stratum.repo import Repo
from stratum.sources import files as out_files
from stratum.sources import manifest_json
from stratum.sources.scan import scan, walk
from stratum.sources.store import Conflict, Store


class Clock:
    def __init__(self):
        self.now = datetime(2024, 1, 1, tzinfo=timezone.utc)

    def __call__(self):
        self.now += timedelta(days=1)
        return self.now


@pytest.fixture
def repo(spark, tmp_path):
    return Repo(spark, str(tmp_path / "repo"), Clock(), random.Random(1).randbytes).init()


def write(root, files):
    for p, c in files.items():
        full = os.path.join(root, p)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "wb") as f:
            f.write(c)
    return str(root)


def read(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(root) for f in fs}


TREE = {"a.txt": b"hello\nworld\n", "sub/zero.txt": b"", "sub/.dot": b"d", "sub/_under": b"u", "big.bin": bytes(range(256)) * 40}


def test_scan_keeps_what_spark_drops(spark, tmp_path):
    root = write(tmp_path / "t", TREE | {"bin/x": b"1", "k.log": b"2"})
    os.makedirs(os.path.join(root, "empty"))
    os.symlink(root, os.path.join(root, "loop"))
    got = {r["path"]: bytes(r["content"]) for r in scan(spark, root, Ignore().with_defaults()).collect()}
    assert got == TREE
    assert walk(root, Ignore().with_defaults())[0] == ["empty", "sub"]
    assert scan(spark, root, content=False).where("path = 'a.txt'").first()["bytes"] == 12
    chunks = scan(spark, root, chunks=(50, 10, 100)).where("path = 'big.bin'").orderBy("idx").collect()
    assert b"".join(bytes(r["data"]) for r in chunks) == TREE["big.bin"] and {r["raw_len"] for r in chunks[:-1]} == {100}


def test_save_and_restore(repo, tmp_path):
    root = write(tmp_path / "w", TREE)
    os.makedirs(os.path.join(root, "empty"))
    full = repo.save(root, message="first")
    small = repo.save(root, mode="compact", sizes=(1024, 256, 4096))
    before = repo.store.read("chunks").count()
    again = repo.save(root, mode="compact", sizes=(1024, 256, 4096))
    assert repo.store.read("chunks").count() == before
    hashes = {r["snapshot_id"]: r["snapshot_hash"] for r in repo.snapshots().collect()}
    assert len({hashes[i] for i in (full, small, again)}) == 1
    assert {r["kind"] for r in repo.diff("@0", "@1").collect()} == {r["kind"] for r in repo.diff("@0", "@2", use_content_hash=True).collect()} == {"Unchanged"}
    assert {r["status"] for r in repo.verify(policy="temp").collect()} == {"OK"}
    for n, i in enumerate((full, small)):
        out = str(tmp_path / f"out{n}")
        write(out, {"a.txt/inner": b"x", "other": b"o", ".stratum/own": b"s"})
        repo.restore(i, out)
        assert read(out) == TREE | {"other": b"o", ".stratum/own": b"s"} and os.path.isdir(os.path.join(out, "empty"))
        repo.restore(i, out, purge=True)
        assert read(out) == TREE | {".stratum/own": b"s"}
    text = manifest_json.to_json(*(repo.store.read(t).where(f"snapshot_id = '{small}'") for t in ("manifest_head", "manifest_files", "manifest_dirs")))
    write(tmp_path / "m", {f"{small}.json": text.first()["text"].encode()})
    found = manifest_json.manifests(repo.spark, str(tmp_path / "m"), exact=True)
    assert {tuple(r)[:3] for r in manifest_json.files(found).collect()} == {(small, p, len(c)) for p, c in TREE.items()}


def test_commands_on_history(repo, tmp_path):
    root = write(tmp_path / "w", TREE)
    ids = [repo.save(root, message="one")]
    write(root, {"a.txt": b"hello\nthere\n", "new": b"n"})
    os.remove(os.path.join(root, "sub/_under"))
    ids.append(repo.save(root, mode="compact", sizes=(1024, 256, 4096)))
    assert [r["snapshot_id"] for r in repo.history(take=1, size=True).collect()] == [ids[1]]
    assert {(r["kind"], r["path_a"] or r["path_b"]) for r in repo.diff("@1", "@0").collect() if r["kind"] != "Unchanged"} == {("Added", "new"), ("Removed", "sub/_under")}
    assert [r["path_b"] for r in repo.textdiff("@1", "@0").collect() if r["kind"] == "Modified"] == ["a.txt"]
    assert repo.note("@1") == "one" and repo.note("@1", append="two") == "one\ntwo" and repo.note("@1", clear=True) == ""
    mixed = repo.recompose(["@1", "@0"], message="mix")
    assert {r["path"]: bytes(r["content"]) for r in repo.payload("main", mixed).collect()} == TREE | {"new": b"n"}
    assert [r["status"] for r in repo.compact(keep=1).collect()] == ["SKIPPED", "OK"]
    assert {r["status"] for r in repo.verify().collect()} == {"OK", "PAYLOAD-MISSING"}
    assert [r["status"] for r in repo.hydrate(match=["*"]).collect()] == ["SKIPPED", "OK", "OK"]
    assert {r["status"] for r in repo.verify().collect()} == {"OK"}
    out = str(tmp_path / "out")
    assert [r["status"] for r in repo.export(["@1"], out).collect()] == ["OK"] and read(os.path.join(out, ids[1]))["new"] == b"n"
    assert [r["status"] for r in repo.export(["@1"], out).collect()] == ["SKIPPED"]
    assert repo.pick("@1", "sub", str(tmp_path / "p")) == 2 and repo.pick("@1", "new", str(tmp_path / "p")) == 1
    stats = repo.statistics().first()
    assert stats["manifests"] == 2 and stats["missing_chunks"] == 0 and stats["dedup_factor"] > 1
    assert {r["path"]: r["files"] for r in repo.tree(ids[1]).collect()}[""] == 5
    assert repo.import_(root, dry_run=True) is None and repo.import_(root)
    dry = repo.tidy(keep=1, dry_run=True).first()
    assert dry["snapshots"] == 3 and dry["deletable"] == dry["examined"] and repo.snapshots().count() == 4
    assert repo.tidy(keep=1).first() == dry and repo.store.read("chunks").count() == 0 and repo.snapshots().count() == 1
    repo.clock.now += timedelta(days=60)
    assert repo.cache_meta_gc().first()["deleted"] == 5
    assert repo.store.vacuum() > 0 and {r["status"] for r in repo.verify().collect()} == {"OK"}


def contents(repo, snapshot_id):
    return {r["path"]: bytes(r["content"]) for r in repo.payload("main", snapshot_id).collect()}


def table(spark, files):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in files.items()], "path string, content binary")


@pytest.mark.parametrize("kind", ["folder", "table"])
def test_edits_that_keep_the_size_are_kept(repo, tmp_path, kind):
    """In compact, in compact saves and in compact-full: what was saved is what comes back."""
    states = [{"a.txt": b"AAAA", "b": b"same"}, {"a.txt": b"BBBB", "b": b"same"}, {"a.txt": b"CCCC", "b": b"same"}]
    found = []
    for k, files in enumerate(states):
        source = table(repo.spark, files) if kind == "table" else write(tmp_path / "w", files)
        if kind == "folder":  # a time of its own, as edits have
            os.utime(tmp_path / "w" / "a.txt", (1000 + k, 1000 + k))
        found += [(repo.save(source), files), (repo.save(source, mode="compact"), files)]
    assert {r["status"] for r in repo.compact(keep=0).collect()} == {"OK", "SKIPPED"}
    repo.store.vacuum()
    assert repo.store.read("payload_files").count() == 0
    for snapshot_id, files in found:
        assert contents(repo, snapshot_id) == files
    assert {r["status"] for r in repo.verify(policy="temp").collect()} == {"OK"}


def test_compact_full_sees_what_size_and_time_hide(repo, tmp_path):
    root = write(tmp_path / "w", {"a": b"AAAA"})
    os.utime(tmp_path / "w" / "a", (1000, 1000))
    repo.save(root, mode="compact")
    write(root, {"a": b"BBBB"})
    os.utime(tmp_path / "w" / "a", (1000, 1000))
    assert contents(repo, repo.save(root, mode="compact")) == {"a": b"AAAA"}
    assert contents(repo, repo.save(root, mode="compact-full")) == {"a": b"BBBB"}
    assert contents(repo, repo.save(root, mode="compact")) == {"a": b"BBBB"}
    with pytest.raises(ValueError):
        repo.save(root, mode="other")


def test_files_above_what_a_cell_holds(repo, tmp_path):
    root, size = write(tmp_path / "w", {"small": b"s", "empty": b""}), (1 << 30) + (3 << 20) + 5
    with open(os.path.join(root, "sparse"), "wb") as f:
        f.truncate(size)
        f.seek(12345)
        f.write(b"here")
    with pytest.raises(Exception, match="too large"):
        repo.save(root)
    repo.save(root, mode="compact")
    row = repo.snapshots().first()
    assert row["file_count"] == 3 and row["total_bytes"] == size + 1
    listed = {r["path"]: r for r in repo.store.read("manifest_files").collect()}
    lengths = {r["hash"]: r["raw_len"] for r in repo.store.read("chunks").select("hash", "raw_len").collect()}
    assert sum(lengths[h] for h in listed["sparse"]["chunk_hashes"]) == size and len(lengths) < 10 and not listed["empty"]["chunk_hashes"]


def test_files_are_written_in_pieces(repo, tmp_path, monkeypatch):
    files = {"big/file": bytes(range(256)) * 4000, "empty": b"", "x/y/z": b"z"}
    root = write(tmp_path / "w", files)
    saved = repo.save(root, mode="compact", sizes=(1024, 256, 4096))
    out = write(tmp_path / "out", {"x": b"a file in the way", "empty/folder": b"and a folder"})
    os.symlink(str(tmp_path / "w"), os.path.join(out, "big"))
    assert repo.restore(saved, out) == 3 and read(out) == files and read(root) == files
    with pytest.raises(ValueError, match="leads out"):
        out_files.inside(out, "../x")


def test_each_file_is_opened_once(spark, tmp_path):
    from stratum.operators import chunking

    root = write(tmp_path / "w", {f"f{k}": bytes([k]) * 5000 for k in range(5)})
    opened = tmp_path / "opened"
    real = chunking.pieces_of

    def counted(full, *sizes):
        with open(opened, "a") as f:
            f.write(os.path.basename(full) + "\n")
        yield from real(full, *sizes)

    listing = scan(spark, root, content=False).coalesce(1)
    rows = list(listing.toLocalIterator())
    chunking.pieces_of, old = counted, real
    try:
        df = chunking.packed(listing, 1024, 256, 4096, root=root)
        store = Store(spark, str(tmp_path / "s"))
        store.create()
        got = store.load("packed", [store.stage("packed", df)])
        assert got.where("idx IS NULL").count() == 5 and got.where("idx IS NOT NULL").count() > 5 and len(rows) == 5
    finally:
        chunking.pieces_of = old
    write(root, {"f0": b"shorter"})
    with pytest.raises(Exception, match="changed while it was read"):
        chunking.packed(spark.createDataFrame([("f0", 5000, 1)], "path string, bytes long, mtime_ticks long"), 1024, 256, 4096, root=root).collect()


def test_the_ignore_file_counts(repo, tmp_path):
    root = write(tmp_path / "w", {"a": b"1", "b.log": b"2", "own/x": b"3", "cache/y": b"4", "k.bak": b"5"})
    assert set(contents(repo, repo.save(root))) == {"a", "own/x", "k.bak"}
    repo.store.write_text("ignore.json", '{"excludeFiles": ["*.bak",], "EXCLUDEDIRS": ["own/"] // mine\n}')
    assert set(contents(repo, repo.save(root, mode="compact"))) == {"a", "cache/y"}
    repo.store.write_text("ignore.json", "broken")
    assert set(contents(repo, repo.save(root))) == {"a", "own/x", "cache/y", "k.bak"}
    names = [os.path.join(root, "a"), "/elsewhere/b", os.path.join(root, "own/x")]
    assert set(contents(repo, repo.save(root, only=names, mode="compact"))) == {"a", "own/x"}


def test_manifest_hash_of_the_content(repo):
    import hashlib

    files = {"b": b"two", "a": b"one", "c": b""}
    found = repo.save(table(repo.spark, files), mode="compact", manifest_hash="content")
    again = repo.save(table(repo.spark, files), mode="compact")
    heads = {r["snapshot_id"]: r["original_sha256"] for r in repo.store.read("manifest_head").collect()}
    assert heads[found] == hashlib.sha256(b"onetwo").hexdigest().upper() != heads[again]


def test_hydrate_modes(repo, tmp_path):
    small = repo.save(table(repo.spark, {"a": b"1"}), mode="compact")
    with pytest.raises(LookupError, match="no payload"):
        repo.restore(small, str(tmp_path / "o"), hydrate=None)
    with pytest.raises(LookupError):
        repo.recompose(["@0"], hydrate=None)
    with pytest.raises(ValueError):
        repo.restore(small, str(tmp_path / "o"), hydrate="other")
    assert repo.restore(small, str(tmp_path / "o")) == 1 and not repo.snapshots().first()["has_payload"]
    assert repo.restore(small, str(tmp_path / "o"), hydrate="persist") == 1 and repo.snapshots().first()["has_payload"]


def test_references_as_a_document(repo):
    assert manifest_json.refcounts(repo.refcount_json()) == {}
    repo.save(table(repo.spark, {"a": b"1", "b": b"1", "c": b"2"}), mode="compact")
    assert sorted(manifest_json.refcounts(repo.refcount_json()).values()) == [1, 2]
    assert repo.summary(repo.hydrate(latest=1)) == {"OK": 1} and repo.summary(repo.hydrate(latest=1)) == {"SKIPPED": 1}


def test_notes(repo):
    saved = repo.save(table(repo.spark, {"a": b"1"}), message="m")
    assert [tuple(r) for r in repo.notes().collect()] == [(saved, "m")]
    with pytest.raises(FileExistsError):
        repo.note("@0", write="x")
    assert repo.note("@0", delete=True) is None and repo.notes().count() == 0
    assert repo.note("@0", ensure=True) == "" and repo.note("@0", append="x") == "x" and repo.note("@0", ensure=True) == "x"
    assert repo.note("@0", delete=True) is None and repo.note("@0", write="new") == "new"
    with pytest.raises(ValueError):
        repo.note("@0", clear=True, ensure=True)


def test_inventories_are_canonical(repo, tmp_path):
    found = repo.save(table(repo.spark, {"snapshots/e\u0301.txt": b"1", "note.md": b"2", "x": b"3"}), mode="compact")
    assert {r["path"] for r in repo.inventory("main", found).collect()} == {"\u00e9.txt", "x"}
    write(tmp_path / "inv", {"i.json": ('{"files": [{"path": "/base/%s/a", "size": 3}, {"name": "a", "size": 9, "sha256": "h"}, {"rel": "meta.json", "size": 1}]}' % found).replace('"path"', '"Path"').encode()})
    assert [tuple(r) for r in repo.inventory_json(str(tmp_path / "inv"), found).collect()] == [("a", 9, "h")]


def test_only_touched_folders_are_written_anew(repo):
    for k in range(3):
        repo.save(table(repo.spark, {"a": b"%d" % k * 100, "b": b"same"}), mode="compact")
    repo.save(table(repo.spark, {"c": b"full"}))
    before = repo.store.state()[1]["tables"]
    newest = repo.store.read("snapshots").where("has_manifest").orderBy("snapshot_id").collect()[-1]["snapshot_id"]
    assert repo.tidy(match=[newest]).first()["deletable"] == 1
    after = repo.store.state()[1]["tables"]
    assert len(set(before["chunks"]) & set(after["chunks"])) == 3 - 1 and set(before["payload_files"]) == set(after["payload_files"])
    assert {r["status"] for r in repo.verify(policy="temp").collect()} == {"OK"}


def test_a_new_column_is_null_in_old_folders(repo):
    import shutil

    repo.store.stage("snapshots", repo.store.read("snapshots"))
    folder = f"{repo.store.root}/snapshots/" + "0" * 32
    repo.spark.createDataFrame([("main", "20200101T000000Z_a")], "space string, snapshot_id string").write.parquet(folder)
    row = repo.store.load("snapshots", ["snapshots/" + "0" * 32]).first()
    assert row["snapshot_id"] and row["note"] is None and row["file_count"] is None
    shutil.rmtree(folder)


def test_meta_is_computed_anew(repo):
    saved = repo.save(table(repo.spark, {"a": b"1"}), hash_mode="none")
    assert [r["status"] for r in repo.verify().collect()] == ["ERROR"]
    assert repo.refresh_meta("@0") == repo.snapshots().first()["snapshot_hash"] and saved
    assert [r["status"] for r in repo.verify().collect()] == ["OK"]


def test_spaces(repo, tmp_path):
    repo.space_create("work")
    with pytest.raises(ValueError):
        repo.space_create("Bad Name")
    repo.space_use("work")
    repo.save(write(tmp_path / "w", {"x": b"1"}))
    repo.space_rename("work", "play")
    assert repo.space_current() == "play" and repo.snapshots().count() == 1 and {r[0] for r in repo.space_list().collect()} == {"main", "play"}
    repo.space_use("main")
    with pytest.raises(ValueError):
        repo.space_delete("play")
    assert repo.save(repo.spark.createDataFrame([("x", bytearray(b"2"))], "path string, content binary"), hash_mode="none", mode="compact")
    assert repo.recompose(["play:@0"]) and [r["status"] for r in repo.verify(selectors=["@1"], policy="temp").collect()] == ["ERROR"]


def test_a_commit_is_whole_or_not_at_all(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.create()
    one = spark.createDataFrame([("a",)], "space string")
    store.commit(append={"spaces": one})
    number, state = store.state()
    with pytest.raises(Conflict):
        store.log(number, state)
    store.commit(replace={"spaces": store.read("spaces").union(one)})
    assert store.read("spaces").count() == 2


def test_gc_refuses_unknown_manifests(repo, tmp_path):
    repo.save(write(tmp_path / "w", TREE), mode="compact")
    head = repo.store.read("manifest_head")
    repo.store.commit(append={"manifest_head": head.selectExpr("space", "'other' snapshot_id", "'x:1' version", "root", "original_sha256", "total_bytes", "avg_size", "min_size", "max_size", "level", "file_count")})
    with pytest.raises(ValueError, match="unknown version"):
        repo.tidy(keep=1)


def test_stream(spark, tmp_path):
    from stratum.streaming.ingest import ingest

    spark.createDataFrame([("a", bytearray(b"x" * 100)), ("b", bytearray(b"x" * 100))], "path string, content binary").write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "s"))
    store.create()
    stream = spark.readStream.schema("path string, content binary").parquet(str(tmp_path / "in"))
    for n in range(2):
        ingest(stream, store, str(tmp_path / f"c{n}"), (20, 10, 40)).awaitTermination(60)
    assert sorted(r["raw_len"] for r in store.read("chunks").collect()) == [20, 40]


def test_command_line(spark, tmp_path, capsys):
    root, at = write(tmp_path / "w", TREE), ["--root", str(tmp_path / "r")]
    assert cli.main([*at, "save", root]) == 3
    assert cli.main([*at, "init"]) == 0 and cli.main([*at, "save", str(tmp_path / "none"), "--compact", "--compact-full"]) == 2 and cli.main([*at, "s", root, "-c", "-m", "note"]) == 0
    assert cli.main([*at, "hist"]) == 0 and "note" in capsys.readouterr().out
    assert cli.main([*at, "verify", "--policy", "temp"]) == 0 and cli.main([*at, "verify"]) == 1
    assert cli.main([*at, "note"]) == 0 and cli.main([*at, "note", "main"]) == 0 and cli.main([*at, "note", "main", "@0", "--view"]) == 0 and cli.main([*at, "note", "--view"]) == 2 and cli.main([*at, "note", "@0"]) == 0 and cli.main([*at, "hist", "--size"]) == 0
    assert cli.main([*at, "verify", "--show-details", "--policy", "skip"]) == 0 and "skip-missing" in capsys.readouterr().out
    assert cli.main([*at, "restore", "--to", str(tmp_path / "o")]) == 2 and cli.main([*at, "restore", "--to", str(tmp_path / "o"), "--hydrate=tmp"]) == 0
    assert cli.main([*at, "tidy", "--keep", "0", "--dry-run"]) == 0 and cli.main([*at, "space", "use", "none"]) == 2
    assert cli.main([*at, "tidy"]) == 2 and cli.main([*at, "pick", "@7", "x", "y"]) == 2 and cli.main([*at, "space", "create"]) == 2
    assert cli.main([*at, "space", "current"]) == 0 and cli.main([*at, "stats"]) == 0
