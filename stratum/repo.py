"""A repository of snapshots: one method for each command. Reads return DataFrames, writes a one-row summary or an id."""

from __future__ import annotations

import json
import os
import re
import secrets
import shutil
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum import schema
from stratum.functions import codec, hashing, ids
from stratum.functions.globs import DEFAULT_EXCLUDE, DEFAULT_FILES, Ignore, path_glob
from stratum.functions.paths import ancestor_rows, canonical
from stratum.functions.texts import humanize, note_append
from stratum.operators import cache, cas, chunking, diffs, manifests, retention, trees, verify
from stratum.sources import files as out_files
from stratum.sources import manifest_json
from stratum.sources.scan import file_list, planned_bytes, scan
from stratum.sources.scan import folders as folder_rows
from stratum.sources.store import Store

KEYS = ["space", "snapshot_id"]
#: The user's ignore rules, a JSON file in the root of the tables; ``init`` writes one.
IGNORE_FILE = "ignore.json"
#: Folders that a new ignore file leaves out.
INIT_FOLDERS = ("cache/", "temp/")


class Repo:
    """``root``: where the tables are. ``clock`` and ``random`` make ids; tests set them."""

    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc), random: Callable[[int], bytes] = secrets.token_bytes):
        self.spark, self.store, self.clock, self.random = spark, Store(spark, root), clock, random

    # spaces

    def init(self) -> Repo:
        """The tables, the space ``main`` and an ignore file with the defaults."""
        self.store.create()
        self.store.write_text(IGNORE_FILE, json.dumps({"exclude": DEFAULT_EXCLUDE, "excludeFiles": DEFAULT_FILES, "excludeDirs": INIT_FOLDERS}, indent=2))
        self.store.commit(append={"spaces": self.spark.createDataFrame([("main",)], schema.SPACES)})
        return self

    def space_current(self) -> str:
        return ids.effective_space(None, os.environ.get("STRATUM_SPACE"), self.store.state()[1].get("config", {}).get("space"))

    def space_list(self) -> DataFrame:
        return self.store.read("spaces").where(F.col("space").rlike(ids.SPACE_NAME)).distinct().orderBy(F.lower("space"))

    def _has_space(self, name: str) -> bool:
        return not self.store.read("spaces").where(F.col("space") == name).isEmpty()

    def space_create(self, name: str) -> str:
        if not re.match(ids.SPACE_NAME, name):
            raise ValueError(f"not a name for a space: {name}")
        if self._has_space(name):
            raise FileExistsError(f"there is a space {name}")
        self.store.commit(append={"spaces": self.spark.createDataFrame([(name,)], schema.SPACES)})
        return name

    def space_use(self, name: str) -> str:
        if not self._has_space(name):
            raise LookupError(f"no space {name}")
        self.store.commit(config={"space": name})
        return name

    def space_rename(self, old: str, new: str) -> str:
        if not self._has_space(old) or self._has_space(new) or not re.match(ids.SPACE_NAME, new):
            raise ValueError(f"can't rename {old} to {new}")
        named = F.when(F.col("space") == old, new).otherwise(F.col("space"))
        changed = {t: self.store.read(t).withColumn("space", named) for t, ddl in schema.TABLES.items() if ddl.startswith("space ")}
        self.store.commit(replace=changed, config={"space": new} if self.space_current() == old else None)
        return new

    def space_delete(self, name: str) -> None:
        if name == self.space_current() or not self.snapshots(name).isEmpty():
            raise ValueError(f"{name} is the current space or not empty")
        self.store.commit(replace={"spaces": self.store.read("spaces").where(F.col("space") != name)})

    # snapshots

    def snapshots(self, space: str | None = None) -> DataFrame:
        return self.store.read("snapshots").where(F.col("space") == (space or self.space_current()))

    def resolve(self, selector: str, space: str | None = None, dialect: str = "default") -> str:
        return ids.resolve(self.snapshots(space), selector, dialect)

    def _one(self, name: str, space: str, snapshot_id: str) -> DataFrame:
        return self.store.read(name).where((F.col("space") == space) & (F.col("snapshot_id") == snapshot_id))

    def ignore(self) -> Ignore:
        """The rules of the ignore file, and the defaults."""
        return manifest_json.ignore_rules(self.store.read_text(IGNORE_FILE))

    @contextmanager
    def _staged(self):
        """A function that writes a table aside and reads it back; what it wrote goes at the end."""
        folders = []

        def stage(name: str, df: DataFrame) -> DataFrame:
            folders.append(self.store.stage(name, df))
            return self.store.load(name, folders[-1:])

        try:
            yield stage
        finally:
            for f in folders:
                self.store.discard(f)

    def _chunks(self) -> DataFrame:
        return self.store.read("chunks").withColumn("data", codec.decompress("data"))

    def _found(self, space: str, snapshot_id: str):
        row = self._one("snapshots", space, snapshot_id).first()
        if row is None:
            raise LookupError(f"no snapshot {snapshot_id}")
        return row

    def listing(self, space: str, snapshot_id: str) -> DataFrame:
        """(path, bytes) without contents."""
        return self._one("payload_files" if self._found(space, snapshot_id)["has_payload"] else "manifest_files", space, snapshot_id).select("path", "bytes")

    def payload(self, space: str, snapshot_id: str) -> DataFrame:
        """(path, bytes, content): stored as they are, or rebuilt from chunks."""
        if self._found(space, snapshot_id)["has_payload"]:
            return self._one("payload_files", space, snapshot_id).select("path", "bytes", "content")
        return manifests.rebuild(self._one("manifest_files", space, snapshot_id), self._chunks(), KEYS).select("path", "bytes", "content")

    def pieces(self, space: str, snapshot_id: str, paths: DataFrame | None = None) -> DataFrame:
        """(path, idx, data) of all files, or those of ``paths``: whole contents, or chunks still compressed (packed)."""
        if self._found(space, snapshot_id)["has_payload"]:
            files = self._one("payload_files", space, snapshot_id)
            out = files.select("path", F.lit(0).alias("idx"), F.col("content").alias("data"), F.lit(False).alias("packed"))
        else:
            out = manifests.pieces(self._one("manifest_files", space, snapshot_id), self.store.read("chunks"), []).withColumn("packed", F.col("data").isNotNull())
        return out if paths is None else out.join(paths.select("path"), "path", "left_semi")

    def _ready(self, space: str, snapshot_id: str, hydrate: str | None) -> None:
        """``hydrate``: ephemeral rebuilds a snapshot without a payload for this use alone, persist stores the payload first, None refuses it."""
        if hydrate not in (None, "persist", "ephemeral"):
            raise ValueError(f"hydrate is persist or ephemeral, not {hydrate}")
        if hydrate != "ephemeral" and not self._found(space, snapshot_id)["has_payload"]:
            if hydrate is None:
                raise LookupError(f"{snapshot_id} has no payload; hydrate it")
            if self.hydrate(space, id=snapshot_id).first()["status"] != "OK":
                raise RuntimeError(f"{snapshot_id} could not be hydrated")

    def dirs(self, space: str, snapshot_id: str) -> DataFrame:
        return self._one("payload_dirs", space, snapshot_id).select("path").union(self._one("manifest_dirs", space, snapshot_id).select("path")).distinct()

    def _row(self, space: str, snapshot_id: str, files: DataFrame | None, note: str, payload: bool, manifest: bool, hash_mode: str) -> DataFrame:
        """The snapshot's row; files: (path, bytes, digest)."""
        totals = files.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes")).withColumn("snapshot_hash", F.lit("SKIP"))
        if hash_mode != "none":
            totals = hashing.fold_digests(files, [])
        created = ids.created_utc(F.lit(snapshot_id), F.lit(self.clock()))
        return totals.select(
            F.lit(space).alias("space"), F.lit(snapshot_id).alias("snapshot_id"), created.alias("created_utc"), F.lit(payload).alias("has_payload"), F.lit(manifest).alias("has_manifest"),
            F.lit(1).alias("meta_v"), F.lit("skip" if hash_mode == "none" else "sha256").alias("hash_alg"), "snapshot_hash", "file_count", "total_bytes", F.lit(note).alias("note"),
        )

    def _source(self, source: str | DataFrame, ignore: Ignore | None, content: bool = True) -> tuple[DataFrame, DataFrame]:
        """(files, folders). The time of a table's files is null unless it has one."""
        if isinstance(source, str):
            return scan(self.spark, source, ignore, content), folder_rows(self.spark, source, ignore)
        files = source.withColumn("content", F.coalesce("content", F.lit(b"")))
        files = files.withColumn("bytes", F.octet_length("content").cast("long"))
        files = files if "mtime_ticks" in files.columns else files.withColumn("mtime_ticks", F.lit(None).cast("long"))
        return files.select("path", "bytes", "mtime_ticks", "content"), ancestor_rows(files, []).select(F.col("dir").alias("path"))

    def _full(self, space: str, files: DataFrame, dirs: DataFrame, message: str, hash_mode: str) -> str:
        """A snapshot with its payload: contents are written once, and digested as written."""
        snapshot_id = ids.new_id(self.clock, self.random)
        tag = [F.lit(space).alias("space"), F.lit(snapshot_id).alias("snapshot_id")]
        folder = self.store.stage("payload_files", files.select(*tag, "path", "bytes", "content"))
        written = self.store.load("payload_files", [folder])
        digests = written.select("path", "bytes", hashing.file_digest("path", "bytes", "content").alias("digest"))
        self.store.commit(append={"payload_dirs": dirs.select(*tag, "path"), "snapshots": self._row(space, snapshot_id, digests, message, True, False, hash_mode)}, add={"payload_files": folder})
        return snapshot_id

    def save(self, source: str | DataFrame, space: str | None = None, mode: str = "full", hash_mode: str = "sha256", message: str = "", ignore: Ignore | None = None, sizes: tuple[int, int, int] = schema.SAVE_SIZES, only: list[str] | None = None, manifest_hash: str = "manifest") -> str:
        """A snapshot of a folder, or of files (path, content[, mtime_ticks]).

        ``mode``: full keeps the files as they are (up to 1 GiB each); compact keeps chunks and reads only files whose size or time
        changed; compact-full reads them all. Each file is read once, and in the compact modes may be of any size.
        ``ignore`` applies with its defaults to a folder; without it the repository's ignore file does. ``only``: absolute names of
        the folder's files to save. ``hash_mode`` none leaves the snapshot hash out. ``manifest_hash``: what the manifest's own
        digest is of, manifest (its text) or content (all bytes in path order).
        """
        if mode not in ("full", "compact", "compact-full") or manifest_hash not in ("manifest", "content"):
            raise ValueError(f"not a mode: {mode}, {manifest_hash}")
        space = space or self.space_current()
        folder = isinstance(source, str)
        files, dirs = self._source(source, ignore.with_defaults() if ignore else self.ignore() if folder else None, content=mode == "full")
        if only is not None:
            files = files.join(file_list(self.spark, os.path.abspath(source) if folder else "", only), "path", "left_semi")
            dirs = ancestor_rows(files, []).select(F.col("dir").alias("path"))
        if mode == "full":
            return self._full(space, files, dirs, message, hash_mode)
        snapshot_id = ids.new_id(self.clock, self.random)
        self._compact(space, snapshot_id, files, dirs, message, hash_mode, sizes, schema.SAVE_LEVEL, root=source if folder else None, probe=mode == "compact", manifest_hash=manifest_hash)
        return snapshot_id

    def _compact(self, space: str, snapshot_id: str, files: DataFrame, dirs: DataFrame, message: str, hash_mode: str, sizes: tuple[int, int, int], level: int, root: str | None = None, probe: bool = True, payload: bool | None = None, manifest_hash: str = "manifest") -> None:
        """Chunks that are new, the manifest, the cache and the snapshot's row, in one commit.

        files: (path, bytes, mtime_ticks) below ``root``, or with their content. ``payload``: None makes a new snapshot, else one that is
        there gets a manifest, and its payload goes unless true. Files without a time are neither looked up in the cache nor put into it.
        """
        stored = self.store.read("chunks").select("hash", "stored_len")
        own = self.store.read("file_meta").where((F.col("space") == space) & F.lit(probe))
        tag = [F.lit(space).alias("space"), F.lit(snapshot_id).alias("snapshot_id")]
        with self._staged() as stage:
            probed = cache.probe(files.select("path", F.col("bytes").alias("size"), "mtime_ticks"), own, stored)
            plan = stage("plan", probed.withColumn("hit", F.col("hit") & F.coalesce(F.length("snapshot_file_hash") == 64, F.lit(False))))
            todo = plan.where("NOT hit").select("path", F.col("size").alias("bytes"), "mtime_ticks")
            fresh = todo.repartition(self._parts(todo)) if root is not None else files.join(todo.select("path"), "path", "left_semi")
            rows = stage("packed", chunking.packed(fresh, *sizes, root=root))
            read = rows.where("idx IS NULL").select("path", "bytes", "mtime_ticks", "file_hash", "snapshot_file_hash")
            built = manifests.build(rows.where("idx IS NOT NULL"), read, []).join(read.drop("bytes"), "path")
            known = plan.where("hit").select("path", F.col("size").alias("bytes"), "chunk_hashes", "mtime_ticks", "file_hash", "snapshot_file_hash")
            listed = known.unionByName(built)
            now = F.lit(cache.ticks(self.clock().timestamp())).alias("updated_at_ticks")
            meta = listed.select(F.lit(space).alias("space"), "path", F.col("bytes").alias("size"), "mtime_ticks", "file_hash", "snapshot_file_hash", "chunk_hashes", now)
            per_file, whole = cache.snapshot_digests(listed.select("path", "bytes"), meta)
            if not whole:
                raise RuntimeError("a file has no digest")
            totals = listed.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"), F.count("*").alias("file_count")).first()
            text = hashing.manifest_hashes(listed, [])
            if manifest_hash == "content":
                all_chunks = rows.where("idx IS NOT NULL").select("hash", "data").unionByName(self.store.read("chunks").select("hash", "data")).dropDuplicates(["hash"])
                whole_files = manifests.pieces(listed, all_chunks.withColumn("data", codec.decompress("data")), [])
                text = hashing.content_concat_hash(whole_files, []).withColumnRenamed("content_sha256", "original_sha256")
            figures = [F.lit(x).alias(n) for n, x in (("version", schema.MANIFEST_VERSION), ("root", ""), ("total_bytes", totals[0]), ("avg_size", sizes[0]), ("min_size", sizes[1]), ("max_size", sizes[2]), ("level", level), ("file_count", totals[1]))]
            new = cas.put_if_absent(rows.where("idx IS NOT NULL").select("hash", "raw_len", "stored_len", "data"), stored)
            append = {"chunks": new, "manifest_files": listed.select(*tag, "path", "bytes", "chunk_hashes"), "manifest_dirs": dirs.select(*tag, "path"), "manifest_head": text.select(*tag, *figures, "original_sha256")}
            delete, replace = {}, {}
            if payload is None:
                timed = meta.where("mtime_ticks IS NOT NULL")
                append["file_meta"], delete["file_meta"] = timed, (timed, ["space", "path"])
                append["snapshots"] = self._row(space, snapshot_id, per_file, message, False, True, hash_mode)
            else:
                this = (F.col("space") == space) & (F.col("snapshot_id") == snapshot_id)
                replace["snapshots"] = self.store.read("snapshots").withColumn("has_manifest", this | F.col("has_manifest")).withColumn("has_payload", F.when(this, F.lit(payload)).otherwise(F.col("has_payload")))
                if not payload:
                    gone = self.spark.createDataFrame([(space, snapshot_id)], "space string, snapshot_id string")
                    delete = {t: (gone, KEYS) for t in ("payload_files", "payload_dirs")}
            self.store.commit(append=append, replace=replace, delete=delete)

    def _parts(self, files: DataFrame, bytes_each: int = 64 << 20) -> int:
        return max(1, -(-planned_bytes(files).first()[0] // bytes_each))

    def compact(self, space: str | None = None, keep: int | None = None, latest: int | None = None, before: datetime | None = None, full: bool = False) -> DataFrame:
        """Full snapshots turned into chunks; with ``full`` their payload stays too. (snapshot_id, status)"""
        space = space or self.space_current()
        wanted = ids.ranked(retention.targets(self.snapshots(space), keep=keep, latest=latest, before=before)).orderBy("rank").select("snapshot_id", "has_payload", "has_manifest").collect()
        out = []
        for r in wanted:
            if r["has_manifest"] or not r["has_payload"]:
                out.append((r["snapshot_id"], "SKIPPED"))
                continue
            files = self.payload(space, r["snapshot_id"]).withColumn("mtime_ticks", F.lit(None).cast("long"))  # a payload has no times
            self._compact(space, r["snapshot_id"], files, self.dirs(space, r["snapshot_id"]), "", "sha256", schema.COMPACT_SIZES, schema.COMPACT_LEVEL, probe=False, payload=full)
            out.append((r["snapshot_id"], "OK"))
        return self.spark.createDataFrame(out, "snapshot_id string, status string")

    def hydrate(self, space: str | None = None, latest: int | None = None, before: datetime | None = None, id: str | None = None, match: list[str] | None = None, ago: str | None = None, rm_manifest: bool = False) -> DataFrame:
        """Payloads rebuilt for snapshots that lack one. (snapshot_id, status)"""
        space = space or self.space_current()
        if ago is not None:
            before = ids.ago(ago, self.clock())
        rows = self.snapshots(space)
        found = rows.where(F.col("snapshot_id") == self.resolve(id, space, "hydrate")) if id else retention.targets(rows, latest=latest, before=before, match=match)
        out = []
        lacking = {r[0] for r in retention.without_payload(found).select("snapshot_id").collect()}
        for r in ids.ranked(found).orderBy("rank").select("snapshot_id", "has_manifest").collect():
            this = (F.col("space") == space) & (F.col("snapshot_id") == r["snapshot_id"])
            if r["snapshot_id"] not in lacking or not r["has_manifest"]:
                out.append((r["snapshot_id"], "FAILED" if r["snapshot_id"] in lacking else "SKIPPED"))
                continue
            tag = [F.lit(space).alias("space"), F.lit(r["snapshot_id"]).alias("snapshot_id")]
            files, dirs = self.payload(space, r["snapshot_id"]), self.dirs(space, r["snapshot_id"])
            rows = self.store.read("snapshots").withColumn("has_payload", this | F.col("has_payload")).withColumn("has_manifest", F.col("has_manifest") & ~(this & F.lit(rm_manifest)))
            gone = self.spark.createDataFrame([(space, r["snapshot_id"])], "space string, snapshot_id string")
            delete = {t: (gone, KEYS) for t in ("manifest_files", "manifest_dirs", "manifest_head")} if rm_manifest else {}
            self.store.commit(append={"payload_files": files.select(*tag, "path", "bytes", "content"), "payload_dirs": dirs.select(*tag, "path")}, replace={"snapshots": rows}, delete=delete)
            out.append((r["snapshot_id"], "OK"))
        return self.spark.createDataFrame(out, "snapshot_id string, status string")

    def import_(self, source: str | DataFrame, space: str | None = None, dry_run: bool = False, message: str = "") -> str | None:
        """A folder from elsewhere as a full snapshot; nothing is left out but the engine's own folder."""
        own = Ignore(common=("/.stratum/", "/.stratum/**"))
        if isinstance(source, str):
            files, dirs = scan(self.spark, source, own), folder_rows(self.spark, source, own)
        else:
            files, dirs = self._source(source, None)
        if dry_run:
            return None
        return self._full(space or self.space_current(), files, dirs, message, "sha256")

    def recompose(self, sources: list[str], space: str | None = None, message: str = "", hydrate: str | None = "ephemeral") -> str:
        """A new snapshot from several ([space:]selector), the first that has a path wins. ``hydrate``: see ``restore``."""
        space = space or self.space_current()
        files, dirs = None, None
        for n, spec in enumerate(sources):
            s, selector = ids.source_spec(spec, space)
            found = self.resolve(selector, s, "recompose")
            self._ready(s, found, hydrate)
            rows = self.payload(s, found).withColumn("priority", F.lit(n))
            files = rows if files is None else files.unionByName(rows)
            dirs = self.dirs(s, found) if dirs is None else dirs.union(self.dirs(s, found))
        if files is None:
            raise ValueError("no sources")
        merged = trees.recompose(files).drop("priority")
        return self._full(space, merged, dirs.distinct().join(merged.select("path"), "path", "left_anti"), message, "sha256")

    def history(self, space: str | None = None, take: int | None = None, since: datetime | None = None, before: datetime | None = None, match: str | None = None, size: bool = False) -> DataFrame:
        """Newest first; with ``size`` payload_bytes, null without a payload, and the same for reading."""
        files = self.store.read("payload_files").select(*KEYS, "bytes") if size else None
        out = retention.newest_first(retention.history(self.snapshots(space), take, since, before, match, files))
        return out.withColumn("size", humanize("payload_bytes")) if size else out

    def notes(self, space: str | None = None) -> DataFrame:
        """(snapshot_id, note) of all snapshots that have one, an empty one too, newest first."""
        return retention.newest_first(self.snapshots(space).where("note IS NOT NULL")).select("snapshot_id", "note")

    def note(self, selector: str, space: str | None = None, append: str | None = None, overwrite: str | None = None, clear: bool = False, write: str | None = None, ensure: bool = False, delete: bool = False) -> str | None:
        """The note as it is then, None if there is none; exactly one change, or none to read it.

        write: as overwrite, but an error if there is a note. ensure: an empty one if there is none. delete: none from then on.
        """
        changes = {"append": append is not None, "overwrite": overwrite is not None, "clear": clear, "write": write is not None, "ensure": ensure, "delete": delete}
        if sum(changes.values()) > 1:
            raise ValueError("one change at a time")
        space = space or self.space_current()
        found = self.resolve(selector, space, "note")
        this = (F.col("space") == space) & (F.col("snapshot_id") == found)
        if any(changes.values()):
            if write is not None and self._found(space, found)["note"] is not None:
                raise FileExistsError(f"{found} has a note")
            new = {
                "append": lambda: note_append("note", F.lit(append)), "overwrite": lambda: F.lit(overwrite), "write": lambda: F.lit(write), "clear": lambda: F.lit(""),
                "ensure": lambda: F.coalesce("note", F.lit("")), "delete": lambda: F.lit(None).cast("string"),
            }[next(k for k, v in changes.items() if v)]()
            self.store.commit(replace={"snapshots": self.store.read("snapshots").withColumn("note", F.when(this, new).otherwise(F.col("note")))})
        return self._found(space, found)["note"]

    def refresh_meta(self, selector: str, space: str | None = None) -> str:
        """The snapshot's hash and totals computed anew from its files, and stored; the hash."""
        space = space or self.space_current()
        found = self.resolve(selector, space)
        row = hashing.snapshot_hashes(self.payload(space, found), []).first()
        this = (F.col("space") == space) & (F.col("snapshot_id") == found)
        values = {"meta_v": 1, "hash_alg": "sha256", "snapshot_hash": row["snapshot_hash"], "file_count": row["file_count"], "total_bytes": row["total_bytes"] or 0}
        self.store.commit(replace={"snapshots": self.store.read("snapshots").withColumns({k: F.when(this, F.lit(v)).otherwise(F.col(k)) for k, v in values.items()})})
        return row["snapshot_hash"]

    def tidy_targets(self, space: str | None = None, keep: int | None = None, latest: int | None = None, before: datetime | None = None, match: list[str] | None = None) -> DataFrame:
        """(space, snapshot_id) that ``tidy`` with the same rule deletes."""
        return retention.targets(self.snapshots(space), keep=keep, latest=latest, before=before, match=match).select(*KEYS)

    def tidy_chunks(self, space: str | None = None, keep: int | None = None, latest: int | None = None, before: datetime | None = None, match: list[str] | None = None) -> DataFrame:
        """(hash, stored_len) of chunks that ``tidy`` with the same rule deletes."""
        left = retention.remaining(self.store.read("manifest_files"), self.tidy_targets(space, keep, latest, before, match))
        return cas.gc_candidates(self.store.read("chunks").select("hash", "stored_len"), cas.refcount(left))

    def tidy(self, space: str | None = None, keep: int | None = None, latest: int | None = None, before: datetime | None = None, match: list[str] | None = None, dry_run: bool = False, gc: bool = True) -> DataFrame:
        """Snapshots deleted by one rule, then chunks that no manifest of any space refers to. (snapshots, examined, deletable, bytes_freed)

        Refuses to delete chunks while there is a manifest of a version it doesn't know.
        """
        gone = self.tidy_targets(space, keep, latest, before, match).collect()  # a row a snapshot
        gone, n = self.spark.createDataFrame(gone, "space string, snapshot_id string"), len(gone)
        chunks = self.store.read("chunks")
        summary = self.spark.createDataFrame([(0, 0, 0)], "examined long, deletable long, bytes_freed long")
        delete = {t: (gone, KEYS) for t in ("snapshots", "payload_files", "payload_dirs", "manifest_files", "manifest_dirs", "manifest_head")}
        if gc:
            if not retention.remaining(self.store.read("manifest_head"), gone).where(~cas.known_version("version")).isEmpty():
                raise ValueError("a manifest is of an unknown version; chunks it may need can't be told")
            counts = cas.refcount(retention.remaining(self.store.read("manifest_files"), gone))
            summary = self.spark.createDataFrame(cas.gc_summary(chunks, counts).collect(), "examined long, deletable long, bytes_freed long")
            delete["chunks"] = (cas.gc_candidates(chunks.select("hash", "stored_len"), counts), ["hash"])
        if not dry_run:
            self.store.commit(delete=delete)
        return summary.select(F.lit(n).cast("long").alias("snapshots"), "*")

    def cache_meta_gc(self, space: str | None = None, keep: int = 30) -> DataFrame:
        """Cache rows deleted that are older than ``keep`` days and whose file no manifest of the space has. (deleted)"""
        space = space or self.space_current()
        rows = self.store.read("file_meta")
        cutoff = cache.ticks(self.clock().timestamp()) - keep * cache.DAY_TICKS
        gone = cache.collectable(rows.where(F.col("space") == space), self.store.read("manifest_files"), cutoff).select("space", "path")
        n = gone.count()
        if n:
            self.store.commit(delete={"file_meta": (gone, ["space", "path"])})
        return self.spark.createDataFrame([(n,)], "deleted long")

    def verify(self, space: str | None = None, selectors: list[str] | None = None, policy: str = "error") -> DataFrame:
        """(space, snapshot_id, status, hydrated)"""
        space = space or self.space_current()
        meta = self.snapshots(space)
        if selectors:
            meta = meta.where(F.col("snapshot_id").isin([self.resolve(s, space) for s in selectors]))
        files = self.store.read("payload_files").select(*KEYS, "path", "bytes", "content")
        if policy in ("hydrate", "temp"):
            lacking = meta.where(~F.col("has_payload")).select(*KEYS)
            known = self.store.read("manifest_files").join(lacking, KEYS, "left_semi")
            bad = cas.missing_chunks(known, self.store.read("chunks"), KEYS)
            files = files.unionByName(manifests.rebuild(known.join(bad, KEYS, "left_anti"), self._chunks(), KEYS))
        if policy == "hydrate":
            for r in meta.where(~F.col("has_payload") & F.col("has_manifest")).select("snapshot_id").collect():
                if cas.missing_chunks(self._one("manifest_files", space, r[0]), self.store.read("chunks"), KEYS).isEmpty():
                    self.hydrate(space, id=r[0])
        computed = hashing.snapshot_hashes(files, KEYS)
        empty = meta.where("file_count = 0").select(*KEYS, F.lit(hashing.EMPTY_SHA256).alias("snapshot_hash"), F.lit(0).cast("long").alias("file_count"), F.lit(0).cast("long").alias("total_bytes"))
        computed = computed.unionByName(empty.join(computed.select(*KEYS), KEYS, "left_anti"))
        return verify.statuses(meta, computed.select(*KEYS, F.col("snapshot_hash").alias("hash"), F.col("file_count").alias("files"), F.col("total_bytes").alias("bytes")), policy)

    def summary(self, found: DataFrame) -> dict[str, int]:
        """How many snapshots of an export, a hydration or a compaction had which status; a row a status."""
        return {r["status"]: r["count"] for r in found.groupBy("status").count().orderBy("status").collect()}

    def refcount_json(self) -> str:
        """Every chunk's references in all manifests as a JSON document, its digests in order. For stores of a size that a document can hold."""
        rows = cas.refcount(self.store.read("manifest_files")).orderBy("hash").toLocalIterator()
        return json.dumps({r["hash"]: r["n"] for r in rows}, indent=2)

    def verify_counts(self, found: DataFrame) -> DataFrame:
        """One row: how many snapshots of ``verify``'s rows had which outcome."""
        return verify.counters(found)

    def inventory(self, space: str, snapshot_id: str, by_content: bool = False) -> DataFrame:
        """(path, length, fingerprint): from the manifest if there is one, its paths made canonical, root sidecars left out and one row a path; else from the payload."""
        if self._found(space, snapshot_id)["has_manifest"]:
            files = self._one("manifest_files", space, snapshot_id)
            content = F.when(F.col("bytes") == 0, F.lit(hashing.EMPTY_SHA256)).otherwise(hashing.chunk_list_hash("chunk_hashes"))
            path = canonical("path", F.lit(snapshot_id))
        else:
            files, content, path = self._one("payload_files", space, snapshot_id), hashing.sha256("content"), F.col("path")
        rows = files.select(path.alias("path"), F.col("bytes").alias("length"), (content if by_content else F.lit(None).cast("string")).alias("fingerprint"), F.lit(0).alias("ordinal")).where("path <> ''")
        return diffs.preferred(manifest_json.without_sidecars(rows), []).drop("ordinal")

    def inventory_json(self, path: str, snapshot_id: str) -> DataFrame:
        """(path, length, fingerprint) of an inventory that some other tool wrote as JSON, of any layout that is understood."""
        rows = manifest_json.inventory(manifest_json.documents(self.spark, path)).select(canonical("path", F.lit(snapshot_id)).alias("path"), "length", "fingerprint", "ordinal").where("path <> ''")
        return diffs.preferred(manifest_json.without_sidecars(rows), []).drop("ordinal")

    def diff(self, a: str, b: str, space: str | None = None, use_content_hash: bool = False) -> DataFrame:
        """(kind, path_a, path_b) in order. By content, both sides are read as payloads so that the fingerprints are alike."""
        space = space or self.space_current()
        x, y = (self.resolve(s, space) for s in (a, b))
        if use_content_hash:
            sides = [self.payload(space, s).select("path", F.col("bytes").alias("length"), hashing.sha256("content").alias("fingerprint")) for s in (x, y)]
        else:
            sides = [self.inventory(space, s) for s in (x, y)]
        return diffs.ordered(diffs.diff(*sides, by_content=use_content_hash))

    def textdiff(self, a: str, b: str, space: str | None = None, options: diffs.Options = diffs.Options(), include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
        """include, exclude: path globs (``**`` crosses folders), of which any may match."""
        space = space or self.space_current()
        include, exclude = ("|".join(map(path_glob, x)) if x else None for x in (include, exclude))
        x, y = (self.payload(space, self.resolve(s, space)) for s in (a, b))
        sides = [s.select("path", F.col("bytes").alias("length"), hashing.sha256("content").alias("fingerprint")) for s in (x, y)]
        return diffs.text_diff(diffs.diff(*sides, by_content=True), x, y, options, include, exclude)

    def statistics(self) -> DataFrame:
        heads = self.store.read("manifest_head")
        return cas.statistics(heads, self.store.read("manifest_files"), self.store.read("chunks"))

    def size_histogram(self) -> DataFrame:
        return cas.size_histogram(self.store.read("chunks"))

    def tree(self, selector: str, space: str | None = None) -> DataFrame:
        space = space or self.space_current()
        found = self.resolve(selector, space)
        files = self._one("manifest_files", space, found).select("path", "bytes").union(self._one("payload_files", space, found).select("path", "bytes")).distinct()
        return trees.tree_order(trees.tree(files, self.dirs(space, found)))

    # out of the repository

    def _write(self, pieces: DataFrame, dirs: list[str], to: str) -> int:
        """Files written below ``to``, a folder that all machines share, by the tasks that hold them; a path that would leave it is an error."""
        os.makedirs(to, exist_ok=True)
        for d in sorted(dirs):
            out_files.make_folder(to, d)
        return out_files.write(pieces, to)

    def export(self, selectors: list[str], dest: str, space: str | None = None, overwrite: bool = False) -> DataFrame:
        """Each snapshot written to a folder of its name below ``dest``, if its hash still holds. (snapshot_id, status)"""
        space = space or self.space_current()
        out = []
        for found in (self.resolve(s, space) for s in selectors):
            to = os.path.join(dest, found)
            status = self.verify(space, [found], "temp").first()["status"]
            if status != "OK":
                out.append((found, "ERROR"))
            elif os.path.exists(to) and not overwrite:
                out.append((found, "SKIPPED"))
            else:
                temp = f"{to}.{uuid.uuid4().hex}"
                self._write(self.pieces(space, found), [r[0] for r in self.dirs(space, found).collect()], temp)
                shutil.rmtree(to, ignore_errors=True)
                os.replace(temp, to)
                out.append((found, "OK"))
        return self.spark.createDataFrame(out, "snapshot_id string, status string")

    def pick(self, selector: str, path: str, out: str, space: str | None = None) -> int:
        """One file written as ``out`` (below it if it is a folder), or the contents of one folder below ``out``."""
        space = space or self.space_current()
        found = self.resolve(selector, space, "pick")
        files = manifests.pick(self.listing(space, found), [path])
        want = path.replace("\\", "/").strip().strip("/")
        pieces = self.pieces(space, found, files)
        if not files.where(F.col("path") == want).isEmpty():
            to = os.path.join(out, want) if os.path.isdir(out) else out
            if os.path.exists(to):
                raise FileExistsError(to)
            return self._write(pieces.withColumn("path", F.lit(os.path.basename(to))), [], os.path.dirname(os.path.abspath(to)))
        return self._write(pieces.withColumn("path", F.substr("path", F.lit(len(want) + 2))), [], out)

    def restore(self, selector: str, dest: str, space: str | None = None, purge: bool = False, hydrate: str | None = "ephemeral") -> int:
        """The snapshot's files into ``dest``: over what is there, or with ``purge`` in its place. Whatever fails, ``dest`` is as it was.

        ``hydrate``, for a snapshot without a payload: ephemeral rebuilds it for this use, persist stores the payload first, None refuses.
        """
        space = space or self.space_current()
        found = self.resolve(selector, space, "restore")
        self._ready(space, found, hydrate)
        dest = os.path.realpath(dest)
        stage, backup = f"{dest}.stage-{uuid.uuid4().hex}", f"{dest}.backup-{uuid.uuid4().hex}"
        try:
            if os.path.isdir(dest) and not purge:
                shutil.copytree(dest, stage, symlinks=True)
            elif os.path.isdir(os.path.join(dest, ".stratum")):
                shutil.copytree(os.path.join(dest, ".stratum"), os.path.join(stage, ".stratum"), symlinks=True)
            n = self._write(self.pieces(space, found), [r[0] for r in self.dirs(space, found).collect()], stage)
            if os.path.exists(dest):
                os.replace(dest, backup)
            try:
                os.replace(stage, dest)
            except OSError:
                if os.path.exists(backup):
                    os.replace(backup, dest)
                raise
            shutil.rmtree(backup, ignore_errors=True)
            return n
        finally:
            shutil.rmtree(stage, ignore_errors=True)
