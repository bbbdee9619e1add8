"""Schemas of the stored tables, as DDL."""

SNAPSHOTS = "space STRING, snapshot_id STRING, created_utc TIMESTAMP, has_payload BOOLEAN, has_manifest BOOLEAN, meta_v INT, hash_alg STRING, snapshot_hash STRING, file_count BIGINT, total_bytes BIGINT, note STRING"
MANIFEST_HEAD = "space STRING, snapshot_id STRING, version STRING, root STRING, original_sha256 STRING, total_bytes BIGINT, avg_size INT, min_size INT, max_size INT, level INT, file_count BIGINT"
MANIFEST_FILES = "space STRING, snapshot_id STRING, path STRING, bytes BIGINT, chunk_hashes ARRAY<STRING>"
MANIFEST_DIRS = "space STRING, snapshot_id STRING, path STRING"
CHUNKS = "hash STRING, raw_len BIGINT, stored_len BIGINT, data BINARY"
PAYLOAD_FILES = "space STRING, snapshot_id STRING, path STRING, bytes BIGINT, content BINARY"
PAYLOAD_DIRS = "space STRING, snapshot_id STRING, path STRING"
FILE_META = "space STRING, path STRING, size BIGINT, mtime_ticks BIGINT, file_hash STRING, snapshot_file_hash STRING, chunk_hashes ARRAY<STRING>, updated_at_ticks BIGINT"
SPACES = "space STRING"
#: Written aside while a snapshot is made, so that a file is looked at and read once; no commit holds them.
PLAN = "path STRING, size BIGINT, mtime_ticks BIGINT, hit BOOLEAN, file_hash STRING, snapshot_file_hash STRING, chunk_hashes ARRAY<STRING>"
PACKED = "path STRING, idx INT, hash STRING, raw_len BIGINT, stored_len BIGINT, data BINARY, bytes BIGINT, mtime_ticks BIGINT, file_hash STRING, snapshot_file_hash STRING"

TABLES = {
    "snapshots": SNAPSHOTS,
    "manifest_head": MANIFEST_HEAD,
    "manifest_files": MANIFEST_FILES,
    "manifest_dirs": MANIFEST_DIRS,
    "chunks": CHUNKS,
    "payload_files": PAYLOAD_FILES,
    "payload_dirs": PAYLOAD_DIRS,
    "file_meta": FILE_META,
    "spaces": SPACES,
    "plan": PLAN,
    "packed": PACKED,
}

#: Manifest versions: the one that is written, and the prefix that any reader must know.
MANIFEST_VERSION = "cas:2"
MANIFEST_PREFIX = "cas:"
#: Chunk sizes (average, least, most) and the level noted in manifests.
SAVE_SIZES = (4 << 20, 32 << 10, 8 << 20)
SAVE_LEVEL = 4
COMPACT_SIZES = (4 << 20, 1 << 20, 8 << 20)
COMPACT_LEVEL = 5
