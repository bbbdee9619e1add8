"""The query catalogue and the SQL that each query must agree with."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions import codec, hashing, ids, paths, texts
from stratum.functions.globs import Ignore
from stratum.operators import cache, cas, chunking, diffs, manifests, retention, trees, verify
from stratum.plans import fixtures
from stratum.plans.fixtures import history, ledger, snapshots, table, tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
BLOCK = 1024

#: Common tables for the SQL: the tree (t), its digests (d), its blocks (c), the history (h) and its inventories.
T = "t AS (SELECT doc_id, 'docs/' || source || '/' || lang || '/' || doc_id || '.txt' path, encode(text) content FROM documents)"
D = T + ", d AS (SELECT path, octet_length(content)::BIGINT bytes, upper(sha256(encode(path || chr(10) || octet_length(content) || chr(10)) || content)) digest FROM t)"
C = T + f", c AS (SELECT path, i::INTEGER idx, content[i * {BLOCK} + 1 : (i + 1) * {BLOCK}] data FROM t, unnest(range(0, (octet_length(content) + {BLOCK - 1}) // {BLOCK})) u(i)), ch AS (SELECT path, idx, octet_length(data)::BIGINT raw_len, upper(sha256(data)) hash FROM c)"
H = """k AS (SELECT unnest(range(0, 5)) k),
h AS (SELECT 'main' AS space, '2024010' || (k + 1) || 'T000000Z_00000000-0000-7000-8000-00000000000' || k snapshot_id, k, doc_id,
  'docs/' || source || '/' || lang || '/' || doc_id || '.txt' path, encode(CASE WHEN doc_id % 7 >= k THEN text ELSE text || chr(10) || 'rev ' || k END) content
  FROM documents, k WHERE doc_id % 10 <> k),
hs AS (SELECT space, snapshot_id, k, doc_id, path, octet_length(content)::BIGINT bytes, upper(sha256(content)) hash FROM h)"""
L = "sn AS (SELECT 's' || left(o_orderpriority, 1) AS space, strftime(o_orderdate, '%Y%m%dT%H%M%SZ') || '_' || lpad(o_orderkey::VARCHAR, 12, '0') snapshot_id, o_orderdate::TIMESTAMP created_utc, o_orderstatus status, o_totalprice price FROM orders)"
S = """sn AS (SELECT 'main' AS space, '2024010' || (k + 1) || 'T000000Z_00000000-0000-7000-8000-00000000000' || k snapshot_id, make_timestamp(2024, 1, k + 1, 0, 0, 0) created_utc, k FROM (SELECT unnest(range(0, 5)) k))"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def blocks(spark, sf_dir):
    return chunking.with_hashes(chunking.fixed_chunks(tree(spark, sf_dir), BLOCK))


def manifest(spark, sf_dir):
    """The tree as a manifest of fixed blocks."""
    return manifests.build(blocks(spark, sf_dir), tree(spark, sf_dir), [])


def inventory(spark, sf_dir, k):
    files = history(spark, sf_dir, [k])
    return files.select("path", F.col("bytes").alias("length"), hashing.sha256("content").alias("fingerprint"))


def whole(files):
    """Each file as one chunk."""
    return files.select("space", "snapshot_id", "k", "path", "bytes", hashing.sha256("content").alias("hash"))


def stored(files):
    return files.select("hash", F.col("bytes").alias("stored_len")).distinct()


@query(f"WITH {D} SELECT upper(sha256(unhex(string_agg(digest, '' ORDER BY path)))) snapshot_hash, count(*) file_count, sum(bytes)::BIGINT total_bytes FROM d")
def q01_snapshot_hash(spark, sf_dir):
    return hashing.snapshot_hashes(tree(spark, sf_dir), [])


@query(f"WITH {D} SELECT path, bytes, digest FROM d")
def q02_file_digest(spark, sf_dir):
    return tree(spark, sf_dir).select("path", "bytes", hashing.file_digest("path", "bytes", "content").alias("digest"))


@query(f"WITH {C} SELECT path, idx, raw_len, hash FROM ch")
def q03_chunk_fixed(spark, sf_dir):
    return blocks(spark, sf_dir).drop("data")


@query(f"WITH {C} SELECT hash, count(*) n FROM ch GROUP BY hash")
def q04_chunk_refcount(spark, sf_dir):
    return cas.refcount(manifest(spark, sf_dir))


@query(
    f"""WITH {C}, u AS (SELECT hash, raw_len, count(*) n FROM ch GROUP BY ALL)
SELECT 1::BIGINT manifests, (SELECT count(*) FROM t) files, (SELECT sum(octet_length(content))::BIGINT FROM t) original_bytes, sum(n)::BIGINT chunk_refs, count(*) unique_chunks,
count(*) present_chunks, 0::BIGINT missing_chunks, sum(raw_len)::BIGINT present_bytes, sum(n)::DOUBLE / count(*) dedup_factor,
(SELECT sum(octet_length(content)) FROM t)::DOUBLE / sum(raw_len) compression_ratio, sum(n)::DOUBLE / (SELECT count(*) FROM t) refs_per_file FROM u"""
)
def q05_store_stats(spark, sf_dir):
    heads = spark.createDataFrame([("s", "cas:2"), ("other", "x:1")], "snapshot_id string, version string")
    chunks = blocks(spark, sf_dir).groupBy("hash").agg(F.first("raw_len").alias("stored_len"))
    return cas.statistics(heads, manifest(spark, sf_dir).withColumn("snapshot_id", F.lit("s")), chunks)


@query(
    f"""WITH {T}, b AS (SELECT unnest(range(0, 6))::INTEGER bin), s AS (SELECT octet_length(content) * 64 n FROM t),
x AS (SELECT CASE WHEN n < 65536 THEN 0 WHEN n < 262144 THEN 1 WHEN n < 1048576 THEN 2 WHEN n < 4194304 THEN 3 WHEN n < 16777216 THEN 4 ELSE 5 END bin, count(*) n FROM s GROUP BY 1)
SELECT b.bin, coalesce(x.n, 0) n FROM b LEFT JOIN x ON b.bin = x.bin"""
)
def q06_size_histogram(spark, sf_dir):
    return cas.size_histogram(tree(spark, sf_dir).select((F.col("bytes") * 64).alias("raw_len")))


@query(f"WITH {H} SELECT DISTINCT hash, bytes FROM hs WHERE k = 1 AND hash NOT IN (SELECT hash FROM hs WHERE k = 0)")
def q07_put_if_absent(spark, sf_dir):
    new, old = (whole(history(spark, sf_dir, [k])) for k in (1, 0))
    return cas.put_if_absent(new.select("hash", "bytes"), old)


DIFF = "x AS (SELECT path, bytes, hash FROM hs WHERE k = {a}), y AS (SELECT path, bytes, hash FROM hs WHERE k = {b}), f AS (SELECT CASE WHEN x.path IS NULL THEN 'Added' WHEN y.path IS NULL THEN 'Removed' WHEN x.bytes <> y.bytes OR {c} THEN 'Modified' ELSE 'Unchanged' END kind, x.path path_a, y.path path_b FROM x FULL JOIN y ON x.path = y.path)"


@query(f"WITH {H}, {DIFF.format(a=1, b=2, c='false')} SELECT * FROM f")
def q08_diff_length(spark, sf_dir):
    return diffs.ordered(diffs.diff(inventory(spark, sf_dir, 1), inventory(spark, sf_dir, 2)))


@query(f"WITH {H}, {DIFF.format(a=1, b=2, c='x.hash <> y.hash')} SELECT * FROM f")
def q09_diff_content(spark, sf_dir):
    return diffs.ordered(diffs.diff(inventory(spark, sf_dir, 1), inventory(spark, sf_dir, 2), by_content=True))


@query(f"WITH {H}, {DIFF.format(a=0, b=4, c='x.hash <> y.hash')} SELECT kind, count(*) n FROM f GROUP BY kind")
def q10_diff_counts(spark, sf_dir):
    return diffs.counts(diffs.diff(inventory(spark, sf_dir, 0), inventory(spark, sf_dir, 4), by_content=True))


@query(f"WITH {H}, p AS (SELECT path, bytes, hash, CASE k WHEN 4 THEN 0 ELSE 1 END priority FROM hs WHERE k IN (0, 4)) SELECT path, bytes, hash, priority FROM p QUALIFY row_number() OVER (PARTITION BY path ORDER BY priority) = 1")
def q11_recompose_left_wins(spark, sf_dir):
    files = whole(history(spark, sf_dir, [0, 4]))
    return trees.left_wins(files.select("path", "bytes", "hash", F.when(F.col("k") == 4, 0).otherwise(1).alias("priority")))


@query(f"WITH {H}, a AS (SELECT path, bytes FROM hs WHERE k = 1), b AS (SELECT path, bytes FROM hs WHERE k = 3) SELECT path, bytes, 'restored' state FROM a UNION ALL SELECT path, bytes, 'kept' FROM b WHERE path NOT IN (SELECT path FROM a)")
def q12_overlay_restore(spark, sf_dir):
    return trees.overlay(*(history(spark, sf_dir, [k]).select("path", "bytes") for k in (1, 3)))


@query(f"WITH {H}, {S} SELECT sn.snapshot_id, sn.created_utc, (SELECT sum(bytes)::BIGINT FROM hs WHERE hs.snapshot_id = sn.snapshot_id) payload_bytes FROM sn WHERE created_utc >= TIMESTAMP '2024-01-02' AND created_utc < TIMESTAMP '2024-01-05' AND snapshot_id ILIKE '202401%Z\\_%' ESCAPE '\\' ORDER BY created_utc DESC LIMIT 2")
def q13_history_filter_take(spark, sf_dir):
    day = lambda d: datetime(2024, 1, d, tzinfo=timezone.utc)
    return retention.history(snapshots(spark), take=2, since=day(2), before=day(5), match="202401*z_*", files=history(spark, sf_dir)).select("snapshot_id", "created_utc", "payload_bytes")


@query(f"WITH {L} SELECT space, snapshot_id FROM sn QUALIFY row_number() OVER (PARTITION BY space ORDER BY created_utc DESC, snapshot_id DESC) > 20")
def q14_retention_keep(spark, sf_dir):
    return retention.targets(ledger(spark, sf_dir), keep=20).select("space", "snapshot_id")


@query(f"WITH {L} SELECT space, snapshot_id FROM sn QUALIFY row_number() OVER (PARTITION BY space ORDER BY created_utc DESC, snapshot_id DESC) <= 20")
def q15_retention_latest(spark, sf_dir):
    return retention.targets(ledger(spark, sf_dir), latest=20).select("space", "snapshot_id")


@query(f"WITH {L} SELECT space, snapshot_id FROM sn WHERE created_utc < TIMESTAMP '1996-01-03'")
def q16_retention_before(spark, sf_dir):
    return retention.targets(ledger(spark, sf_dir), before=datetime(1996, 1, 3, tzinfo=timezone.utc)).select("space", "snapshot_id")


@query(f"WITH {L} SELECT space, snapshot_id FROM sn WHERE regexp_matches(snapshot_id, '(?i)^199.0.*t.*$') AND regexp_matches(snapshot_id, '(?i)^.*3$')")
def q17_retention_match(spark, sf_dir):
    return retention.targets(ledger(spark, sf_dir), match=["199?0*t*", "*3"]).select("space", "snapshot_id")


@query(f"WITH {L} SELECT space, snapshot_id, created_utc FROM sn QUALIFY row_number() OVER (PARTITION BY space ORDER BY created_utc DESC, snapshot_id DESC) = 2")
def q18_nth_newest(spark, sf_dir):
    return ids.at_index(ledger(spark, sf_dir), 1).select("space", "snapshot_id", "created_utc")


def kept_and_all(spark, sf_dir):
    """Manifest files of the two newest snapshots, and all contents as stored chunks."""
    files = whole(history(spark, sf_dir))
    gone = retention.targets(snapshots(spark), keep=2)
    kept = retention.remaining(files, gone).withColumn("chunk_hashes", F.array("hash"))
    return kept, stored(files)


@query(f"WITH {H} SELECT DISTINCT hash, bytes stored_len FROM hs WHERE hash NOT IN (SELECT hash FROM hs WHERE k >= 3)")
def q19_gc_candidates(spark, sf_dir):
    kept, chunks = kept_and_all(spark, sf_dir)
    return cas.gc_candidates(chunks, cas.refcount(kept))


@query(f"WITH {H}, c AS (SELECT DISTINCT hash, bytes FROM hs), l AS (SELECT DISTINCT hash FROM hs WHERE k >= 3) SELECT count(*) examined, count(*) FILTER (l.hash IS NULL) deletable, coalesce(sum(bytes) FILTER (l.hash IS NULL), 0)::BIGINT bytes_freed FROM c LEFT JOIN l USING (hash)")
def q20_gc_summary(spark, sf_dir):
    kept, chunks = kept_and_all(spark, sf_dir)
    return cas.gc_summary(chunks, cas.refcount(kept))


@query(
    f"""WITH {H}, g AS (SELECT space, snapshot_id, k, count(*) n, sum(octet_length(content))::BIGINT b,
upper(sha256(unhex(string_agg(sha256(encode(path || chr(10) || octet_length(content) || chr(10)) || content), '' ORDER BY path)))) hash FROM h GROUP BY ALL)
SELECT x.space, x.snapshot_id, x.hash, x.n files, CASE WHEN x.k = 4 THEN 'ERROR' WHEN x.k = 3 THEN 'PAYLOAD-MISSING'
WHEN x.hash = y.hash AND x.n = y.n AND x.b = y.b + CASE x.k WHEN 2 THEN 1 ELSE 0 END THEN 'OK' ELSE 'MISMATCH' END status, false hydrated
FROM g x JOIN g y ON y.k = CASE x.k WHEN 1 THEN 0 ELSE x.k END"""
)
def q21_verify_status(spark, sf_dir):
    # what is stored for snapshot 1 is that of snapshot 0, for 2 a byte more; 3 has no payload, 4 no hash
    computed = hashing.snapshot_hashes(history(spark, sf_dir), ["space", "snapshot_id", "k"])
    k = F.col("k")
    stored = computed.select("space", F.explode(F.when(k == 0, F.array(F.lit(0), F.lit(1))).when(k == 1, F.array().cast("array<int>")).otherwise(F.array(k))).alias("k"), F.lower("snapshot_hash").alias("snapshot_hash"), "file_count", "total_bytes")
    meta = stored.select(
        "space", fixtures.snapshot_id("k").alias("snapshot_id"), (k != 3).alias("has_payload"), F.lit(1).alias("meta_v"), F.when(k == 4, "skip").otherwise("sha256").alias("hash_alg"),
        "snapshot_hash", "file_count", (F.col("total_bytes") + F.when(k == 2, 1).otherwise(0)).alias("total_bytes"),
    )
    found = computed.select("space", "snapshot_id", F.col("snapshot_hash").alias("hash"), F.col("file_count").alias("files"), F.col("total_bytes").alias("bytes"))
    return verify.statuses(meta, found).join(found.drop("bytes"), ["space", "snapshot_id"])


@query(f"WITH {H}, o AS (SELECT path, bytes, hash FROM hs WHERE k = 1), n AS (SELECT path, bytes, hash FROM hs WHERE k = 2) SELECT n.path, n.bytes size, coalesce(n.bytes = o.bytes AND n.hash = o.hash AND o.hash NOT LIKE '0%', false) hit FROM n LEFT JOIN o ON n.path = o.path")
def q22_cache_probe(spark, sf_dir):
    # the modification time of a file of the history: a number that changes with its content
    old, new = (history(spark, sf_dir, [k]).select("path", F.col("bytes").alias("size"), F.xxhash64("content").alias("mtime_ticks"), hashing.sha256("content").alias("hash")) for k in (1, 2))
    rows = old.select("path", "size", "mtime_ticks", F.col("hash").alias("file_hash"), F.col("hash").alias("snapshot_file_hash"), F.array("hash").alias("chunk_hashes"))
    return cache.probe(new.drop("hash"), rows, old.where(~F.col("hash").startswith("0"))).select("path", "size", "hit")


@query("WITH d AS (SELECT doc_id, 'docs/' || source || '/' || lang || '/' || doc_id || '.txt' path FROM documents) SELECT 'main' AS space, path, (doc_id % 60) * 864000000000 updated_at_ticks FROM d WHERE doc_id % 10 <> 0 AND doc_id % 10 = 4 AND doc_id % 60 < 30")
def q23_cache_gc(spark, sf_dir):
    old = table(spark, sf_dir, "documents").where("doc_id % 10 <> 0")
    path = tree(spark, sf_dir).select("doc_id", "path")
    rows = old.select("doc_id").join(path, "doc_id").select(F.lit("main").alias("space"), "path", (F.col("doc_id") % 60 * cache.DAY_TICKS).alias("updated_at_ticks"))
    return cache.collectable(rows, history(spark, sf_dir, [4]), 30 * cache.DAY_TICKS)


@query(f"WITH {C} SELECT path, idx, hash FROM ch")
def q24_manifest_explode(spark, sf_dir):
    return manifests.explode(manifest(spark, sf_dir), [])


@query(f"WITH {T} SELECT path, octet_length(content)::BIGINT bytes, upper(sha256(content)) hash FROM t")
def q25_hydrate_roundtrip(spark, sf_dir):
    chunks = blocks(spark, sf_dir).select("hash", "data").dropDuplicates(["hash"])
    out = manifests.rebuild(manifest(spark, sf_dir), chunks, [])
    return out.select("path", "bytes", hashing.sha256("content").alias("hash"))


@query(f"WITH {T} SELECT path, octet_length(content)::BIGINT bytes FROM t WHERE path LIKE 'docs/src1/%' OR path LIKE 'docs/src2/en/%'")
def q26_pick_prefix(spark, sf_dir):
    return manifests.pick(tree(spark, sf_dir).select("path", "bytes"), ["docs/src1", "docs\\src2\\en/", " "])


IGNORED = Ignore(("/http:/**", "blog.*", "?r/"), ("*.html", "*ref=x"), ("m.*/", "es/"))


@query(
    r"""WITH p AS (SELECT url, split(url, '/') s FROM pages), f AS (SELECT url, list_filter(s, lambda x: x <> '') s FROM p),
a AS (SELECT url, array_to_string(s, '/') path, list_transform(range(1, len(s)), lambda i: array_to_string(s[1:i], '/')) up FROM f)
SELECT url, (regexp_matches(path, '^http:/.*$', 'i') OR regexp_matches(path, '(^|/)(blog\.[^/]*)(/|$)', 'i') OR regexp_matches(path, '(^|/)([^/]*\.html)(/|$)', 'i') OR regexp_matches(path, '(^|/)([^/]*ref=x)(/|$)', 'i')
 OR len(list_filter(up, lambda d: regexp_matches(d || '/', '^http:/.*$|(^|/)(blog\.[^/]*)(/|$)|(^|/)([^/]r/?)(/|$)|(^|/)(m\.[^/]*/?)(/|$)|(^|/)(es/?)(/|$)', 'i'))) > 0) excluded FROM a"""
)
def q27_ignore_rules(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("url", IGNORED.excluded(F.array_join(paths.segments("url"), "/")).alias("excluded"))


@query("SELECT DISTINCT unnest(['docs', 'docs/' || source, 'docs/' || source || '/' || lang]) dir FROM documents")
def q28_ancestor_dirs(spark, sf_dir):
    return paths.ancestor_rows(tree(spark, sf_dir), [])


@query(
    f"""WITH {T}, f AS (SELECT path, octet_length(content)::BIGINT bytes, split(path, '/') s FROM t),
up AS (SELECT array_to_string(s[1:i], '/') path, bytes FROM f, unnest(range(0, len(s))) u(i)),
n AS (SELECT path, sum(bytes)::BIGINT bytes, count(*) files, true is_dir FROM up GROUP BY path UNION ALL SELECT path, bytes, 1, false FROM f)
SELECT path, regexp_replace(path, '/?[^/]*$', '') parent, list_last(split(path, '/')) AS name, CASE WHEN path = '' THEN 0 ELSE len(split(path, '/'))::INTEGER END depth, is_dir, bytes, files FROM n"""
)
def q29_tree_rollup(spark, sf_dir):
    return trees.tree_order(trees.tree(tree(spark, sf_dir)))


@query(f"WITH {C}, m AS (SELECT path, string_agg(hash, chr(10) ORDER BY idx) hs, sum(raw_len)::BIGINT bytes FROM ch GROUP BY path) SELECT upper(sha256(string_agg(path || chr(10) || bytes || chr(10) || hs || chr(10), '' ORDER BY path))) original_sha256 FROM m")
def q30_manifest_text_hash(spark, sf_dir):
    return hashing.manifest_hashes(manifest(spark, sf_dir), [])


@query("SELECT tab, hash, count(*) copies FROM (SELECT 'documents' tab, upper(sha256(text)) hash FROM documents UNION ALL SELECT 'conversations', upper(sha256(text)) FROM conversations UNION ALL SELECT 'pages', upper(sha256(html)) FROM pages) GROUP BY ALL HAVING count(*) > 1")
def q31_exact_dup_groups(spark, sf_dir):
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("tab"), hashing.sha256(F.col(c).cast("binary")).alias("hash")) for t, c in (("documents", "text"), ("conversations", "text"), ("pages", "html"))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).groupBy("tab", "hash").agg(F.count("*").alias("copies")).where("copies > 1")


@query(f"WITH {H}, i AS (SELECT path, bytes length, CASE WHEN k % 2 = 0 THEN hash END fingerprint, k ordinal FROM hs) SELECT path, length, fingerprint, ordinal FROM i QUALIFY row_number() OVER (PARTITION BY path ORDER BY fingerprint IS NOT NULL DESC, length DESC, ordinal DESC) = 1")
def q32_inventory_preference(spark, sf_dir):
    items = whole(history(spark, sf_dir)).select("path", F.col("bytes").alias("length"), F.when(F.col("k") % 2 == 0, F.col("hash")).alias("fingerprint"), F.col("k").cast("long").alias("ordinal"))
    return diffs.preferred(items, [])


SNIFFED = "coalesce(contains(x, '00 ') OR len(regexp_extract_all(x, '(0[1-8]|0E|0F|1[0-9A-F]) ')) > (len(x) // 3) // 10, false)"
SNIFF = "SELECT {id} id, " + SNIFFED + " is_binary FROM (SELECT {id}, regexp_replace(hex(b[1:4096]), '(..)', '\\1 ', 'g') x FROM (SELECT {id}, (CASE {id} % 5 WHEN 0 THEN '\\x00'::BLOB WHEN 1 THEN unhex(repeat('01021F', 200)) ELSE ''::BLOB END) || encode({text}) b FROM {tab}))"


@query(SNIFF.format(id="doc_id", text="text", tab="documents") + " UNION ALL " + SNIFF.format(id="page_id", text="html", tab="pages"))
def q33_binary_sniff(spark, sf_dir):
    def sniffed(name, key, text):
        head = F.when(F.col(key) % 5 == 0, F.lit(b"\x00")).when(F.col(key) % 5 == 1, F.lit(b"\x01\x02\x1f" * 200)).otherwise(F.lit(b""))
        return table(spark, sf_dir, name).select(F.col(key).alias("id"), texts.is_binary(F.concat(head, F.encode(text, "UTF-8"))).alias("is_binary"))

    return sniffed("documents", "doc_id", "text").unionAll(sniffed("pages", "page_id", "html"))


@query(
    """WITH i AS (SELECT o_orderkey, o_orderdate t, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y%m%dT%H%M%SZ_') || o_orderkey WHEN 1 THEN strftime(o_orderdate, '%Y%m%dT%H%M%SZ')
WHEN 2 THEN 'backup_' || strftime(o_orderdate, '%Y%m%d') WHEN 3 THEN o_orderkey || '_b_' || strftime(o_orderdate, '%Y%m%d') WHEN 4 THEN strftime(o_orderdate, '%Y13%dT%H%M%SZ_x') ELSE '_' || strftime(o_orderdate, '%Y%m99') END id FROM orders)
SELECT id, CASE WHEN o_orderkey % 6 IN (0, 2) THEN date_trunc('day', t) ELSE TIMESTAMP '2020-05-06' END created_utc FROM i"""
)
def q34_created_utc_parse(spark, sf_dir):
    key, at = F.col("o_orderkey"), lambda f: F.date_format("o_orderdate", f)
    forms = [F.concat(at("yyyyMMdd'T'HHmmss'Z_'"), key.cast("string")), at("yyyyMMdd'T'HHmmss'Z'"), F.concat(F.lit("backup_"), at("yyyyMMdd")), F.concat(key.cast("string"), F.lit("_b_"), at("yyyyMMdd")), at("yyyy'13'dd'T'HHmmss'Z_x'")]
    id_ = F.concat(F.lit("_"), at("yyyyMM'99'"))
    for k, form in enumerate(forms):
        id_ = F.when(key % 6 == k, form).otherwise(id_)
    return table(spark, sf_dir, "orders").select(id_.alias("id")).select("id", ids.created_utc("id", F.to_timestamp(F.lit("2020-05-06"))).alias("created_utc"))


@query(
    f"""WITH {S}, d AS (SELECT unnest(['default', 'restore', 'recompose', 'hydrate', 'export', 'diff', 'verify', 'textdiff', 'pick', 'note']) dialect),
r AS (SELECT snapshot_id, 4 - k AS rank FROM sn) SELECT dialect, '@1' selector, snapshot_id FROM d JOIN r ON rank = CASE dialect WHEN 'verify' THEN 0 WHEN 'textdiff' THEN 2 ELSE 1 END
UNION ALL SELECT dialect, '20240103t', CASE WHEN dialect IN ('export', 'verify', 'textdiff') THEN NULL ELSE '20240103T000000Z_00000000-0000-7000-8000-000000000002' END FROM d WHERE dialect <> 'diff'
UNION ALL SELECT dialect, '202401', CASE dialect WHEN 'note' THEN '20240105T000000Z_00000000-0000-7000-8000-000000000004' END FROM d WHERE dialect <> 'diff'"""
)
def q35_selector_dialects(spark, sf_dir):
    all_ = snapshots(spark)
    out = None
    for d in ids.DIALECTS:
        rows = [ids.at_index(all_, 1, d).select("space", F.lit("@1").alias("selector"), "snapshot_id")]
        if ids.DIALECTS[d].prefix:
            one = all_.select("space").distinct()
            rows += [one.join(ids.prefix_hits(all_, p, d), "space", "left").select("space", F.lit(p).alias("selector"), "snapshot_id") for p in ("20240103t", "202401")]
        for r in rows:
            r = r.select(F.lit(d).alias("dialect"), "selector", "snapshot_id")
            out = r if out is None else out.unionAll(r)
    return out


@query(
    f"""WITH {H}, x AS (SELECT * FROM hs JOIN h USING (space, snapshot_id, k, doc_id, path) WHERE k = 1), y AS (SELECT * FROM hs JOIN h USING (space, snapshot_id, k, doc_id, path) WHERE k = 2),
f AS (SELECT coalesce(x.doc_id, y.doc_id) doc_id, x.path path_a, y.path path_b, x.content ca, y.content cb FROM x FULL JOIN y ON x.path = y.path WHERE x.hash IS DISTINCT FROM y.hash),
l AS (SELECT *, split(regexp_replace(decode(coalesce(cb, ca)), '\r\n|\r', chr(10), 'g'), chr(10)) s, regexp_replace(hex(coalesce(cb, ca)[1:4096]), '(..)', '\1 ', 'g') x FROM f WHERE greatest(coalesce(octet_length(ca), 0), coalesce(octet_length(cb), 0)) <= 2097152)
SELECT CASE WHEN path_a IS NULL THEN 'Added' WHEN path_b IS NULL THEN 'Removed' ELSE 'Modified' END kind, path_a, path_b,
CASE WHEN path_b IS NULL THEN 1 - list_contains(s, '')::INT WHEN path_a IS NULL THEN len(s) - list_contains(s, '')::INT ELSE 1 END::BIGINT added,
CASE WHEN path_a IS NULL THEN 1 - list_contains(s, '')::INT WHEN path_b IS NULL THEN len(s) - list_contains(s, '')::INT WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END::BIGINT removed,
1 n_hunks FROM l WHERE NOT {SNIFFED}"""
)
def q36_text_diff_hunks(spark, sf_dir):
    a, b = (history(spark, sf_dir, [k]) for k in (1, 2))
    changes = diffs.diff(inventory(spark, sf_dir, 1), inventory(spark, sf_dir, 2), by_content=True)
    out = diffs.text_diff(changes, a.select("path", "content"), b.select("path", "content"))
    return out.select("kind", "path_a", "path_b", "added", "removed", F.size("hunks").alias("n_hunks"))


@query()
def q37_gear_chunks(spark, sf_dir):
    found = chunking.gear_chunks(tree(spark, sf_dir), 1024, 256, 4096, read_size=512)
    return chunking.with_hashes(found).drop("data")


@query(
    """WITH u AS (SELECT ts::DATE AS day, user_id AS path, count(*) AS length FROM events GROUP BY ALL), p AS (SELECT DISTINCT day FROM u),
j AS (SELECT a.day, b.path pa, a.path pb, b.length la, a.length lb FROM u a LEFT JOIN u b ON a.path = b.path AND a.day = b.day + INTERVAL 1 DAY
UNION ALL SELECT p.day, b.path, NULL, b.length, NULL FROM u b JOIN p ON p.day = b.day + INTERVAL 1 DAY ANTI JOIN u a ON a.path = b.path AND a.day = p.day)
SELECT strftime(day, '%Y-%m-%d') AS day, CASE WHEN pa IS NULL THEN 'Added' WHEN pb IS NULL THEN 'Removed' WHEN la <> lb THEN 'Modified' ELSE 'Unchanged' END kind, count(*) n FROM j GROUP BY ALL"""
)
def q38_events_daily_diff(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), F.col("user_id").alias("path")).agg(F.count("*").alias("length"))
    today = days.select("day", "path", F.col("length").alias("lb"), F.lit(True).alias("b"))
    before = days.select(F.date_add("day", 1).alias("day"), "path", F.col("length").alias("la"), F.lit(True).alias("a")).join(days.select("day").distinct(), "day", "left_semi")
    both = before.join(today, ["day", "path"], "full_outer")
    kind = F.when(F.col("a").isNull(), "Added").when(F.col("b").isNull(), "Removed").when(F.col("la") != F.col("lb"), "Modified").otherwise("Unchanged")
    return both.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), kind.alias("kind")).agg(F.count("*").alias("n"))


@query(
    """WITH r AS (SELECT year(l_shipdate)::INTEGER AS yr, upper(sha256(l_partkey || '|' || l_suppkey || '|' || l_returnflag || l_linestatus)) hash FROM lineitem)
SELECT yr, count(*) chunk_refs, count(DISTINCT hash) unique_chunks, count(*)::DOUBLE / count(DISTINCT hash) dedup_factor FROM r GROUP BY yr"""
)
def q39_lineitem_yearly_dedup(spark, sf_dir):
    row = F.concat(F.col("l_partkey").cast("string"), F.lit("|"), F.col("l_suppkey").cast("string"), F.lit("|"), "l_returnflag", "l_linestatus")
    rows = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("yr"), hashing.sha256(F.encode(row, "UTF-8")).alias("hash"))
    counts = rows.groupBy("yr", "hash").agg(F.count("*").alias("n"))
    return counts.groupBy("yr").agg(F.sum("n").alias("chunk_refs"), F.count("*").alias("unique_chunks")).select("*", texts.ratio("chunk_refs", "unique_chunks").alias("dedup_factor"))


@query(
    """WITH f AS (SELECT n_regionkey region, n_name || '/' || c_custkey AS path, encode(c_name || c_mktsegment) content FROM customer JOIN nation ON c_nationkey = n_nationkey),
d AS (SELECT region, path, octet_length(content) bytes, sha256(encode(path || chr(10) || octet_length(content) || chr(10)) || content) digest FROM f)
SELECT region, upper(sha256(unhex(string_agg(digest, '' ORDER BY path)))) snapshot_hash, count(*) file_count, sum(bytes)::BIGINT total_bytes FROM d GROUP BY region"""
)
def q40_snapshot_hash_per_region(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    content = F.encode(F.concat("c_name", "c_mktsegment"), "UTF-8")
    path = F.concat("n_name", F.lit("/"), F.col("c_custkey").cast("string"))
    files = customers.select(F.col("n_regionkey").alias("region"), path.alias("path"), content.alias("content")).withColumn("bytes", F.octet_length("content").cast("long"))
    return hashing.snapshot_hashes(files, ["region"])


@query(f"WITH {H} SELECT k::INTEGER k, sha256_all FROM (SELECT k, upper(sha256(string_agg(hex(content), '' ORDER BY path).unhex())) sha256_all FROM h GROUP BY k)")
def q41_content_concat_hash(spark, sf_dir):
    return hashing.content_concat_hash(history(spark, sf_dir), ["k"]).select("k", F.col("content_sha256").alias("sha256_all"))


@query(f"WITH {H} SELECT path, bytes, 'restored' state FROM hs WHERE k = 1 UNION ALL SELECT '.stratum/' || path, bytes, 'kept' FROM hs WHERE k = 3")
def q42_replace_restore(spark, sf_dir):
    a, there = (history(spark, sf_dir, [k]).select("path", "bytes") for k in (1, 3))
    own = there.select(F.concat(F.lit(".stratum/"), "path").alias("path"), "bytes")
    return trees.replaced(a, own.unionByName(there))


@query(f"WITH {H} SELECT path, 0 priority, 1 folder_priority FROM hs WHERE k = 0 AND ((strlen(path) + bytes) & 1) = 0")
def q43_merge_conflicts(spark, sf_dir):
    # each path once more in a later source, as a folder or as a file, and in one later still as a file: only folders of a later source are in the way
    first = history(spark, sf_dir, [0]).select("path", F.lit(0).alias("priority"))
    even = (F.octet_length("path") + F.col("bytes")).bitwiseAND(F.lit(1)) == 0
    later = tree(spark, sf_dir).select(F.when(even, F.concat("path", F.lit("/inner"))).otherwise(F.col("path")).alias("path"), F.lit(1).alias("priority"))
    last = history(spark, sf_dir, [2]).select("path", F.lit(2).alias("priority"))
    return trees.conflicts(first.unionByName(later).unionByName(last))


@query(f"WITH {H} SELECT space, path, max(k) * 10 updated_at_ticks, max_by(hash, k) file_hash, min_by(hash, k) snapshot_file_hash FROM hs WHERE k IN (0, 1) AND path IN (SELECT path FROM hs WHERE k = 0) GROUP BY ALL UNION ALL SELECT space, path, 10, hash, NULL FROM hs WHERE k = 1 AND path NOT IN (SELECT path FROM hs WHERE k = 0)")
def q44_cache_upsert(spark, sf_dir):
    rows = [whole(history(spark, sf_dir, [k])).select("space", "path", F.lit(10 * k).cast("long").alias("updated_at_ticks"), F.col("hash").alias("file_hash"), F.col("hash").alias("snapshot_file_hash")) for k in (0, 1)]
    return cache.upsert(rows[0], rows[1].drop("snapshot_file_hash"), ["space", "path"])


CANON = "20240101T000000Z_a"


@query(
    f"""SELECT page_id, CASE page_id % 7 WHEN 0 THEN ' /x/{CANON.lower()}/snapshots/' || url WHEN 1 THEN 'snapshots/' || url WHEN 2 THEN '/' || url WHEN 3 THEN 'Snapshots/e' || chr(769) || url WHEN 4 THEN 'x/{CANON}b/' || url WHEN 5 THEN '//' || url ELSE url END raw,
CASE page_id % 7 WHEN 3 THEN chr(233) ELSE '' END || CASE page_id % 7 WHEN 4 THEN 'x/{CANON}b/' WHEN 5 THEN '/' ELSE '' END || nfc_normalize(url) path FROM pages"""
)
def q45_canonical_paths(spark, sf_dir):
    heads = {0: f" /x/{CANON.lower()}/snapshots/", 1: "snapshots/", 2: "/", 3: "Snapshots/e\u0301", 4: f"x/{CANON}b/", 5: "//"}
    head = F.lit("")
    for k, x in heads.items():
        head = F.when(F.col("page_id") % 7 == k, x).otherwise(head)
    return table(spark, sf_dir, "pages").select("page_id", F.concat(head, "url").alias("raw")).select("page_id", "raw", paths.canonical("raw", F.lit(CANON)).alias("path"))


@query("SELECT page_id, round(length(html) / 1048576.0, 9) mib, length(html) < 65536 AS small, CASE WHEN page_id % 3 = 0 THEN 0.0 ELSE length(html)::DOUBLE / (page_id % 3) END share FROM pages")
def q46_size_figures(spark, sf_dir):
    n = F.length("html")
    return table(spark, sf_dir, "pages").select("page_id", F.round(texts.mebibytes(n.cast("double")), 9).alias("mib"), (texts.size_bin(n) == 0).alias("small"), texts.ratio(n, F.col("page_id") % 3).alias("share"))


@query(f"WITH {C} SELECT DISTINCT path FROM ch WHERE hash LIKE '0%'")
def q47_missing_chunks(spark, sf_dir):
    chunks = blocks(spark, sf_dir).where(~F.col("hash").startswith("0")).select("hash")
    return cas.missing_chunks(manifest(spark, sf_dir), chunks, ["path"])


@query(f"WITH {C} SELECT DISTINCT hash, substr(hash, 1, 2) || '/' || substr(hash, 3, 2) || '/' || hash || '.zst' stored_at FROM ch")
def q48_store_paths(spark, sf_dir):
    return blocks(spark, sf_dir).select("hash", paths.store_path("hash", 2).alias("stored_at")).distinct()


@query(
    """SELECT conv_id, list_reduce(list(text ORDER BY turn), lambda a, x: CASE WHEN coalesce(a, '') = '' THEN x WHEN a LIKE '%' || chr(10) OR a LIKE '%' || chr(13) THEN a || x ELSE a || chr(10) || x END) note
FROM conversations GROUP BY conv_id"""
)
def q49_note_append(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    return turns.select("conv_id", F.aggregate("turns", F.lit(None).cast("string"), lambda note, t: texts.note_append(note, t["text"])).alias("note"))


@query(f"WITH {L} SELECT space, snapshot_id FROM sn WHERE status = 'P' OR price < 50000")
def q50_incomplete_snapshots(spark, sf_dir):
    rows = ledger(spark, sf_dir).select("space", "snapshot_id", F.when(F.col("status") != "P", "hash").alias("snapshot_hash"), F.when(F.col("price") >= 50000, "note").alias("note"))
    return retention.incomplete(rows).select("space", "snapshot_id")


@query(
    f"""WITH {T}, j AS (SELECT unnest(range(0, 2)) k), e AS (SELECT k::INTEGER k, path, CASE WHEN octet_length(content) > 0 THEN content[1 : octet_length(content) - 1] || encode(k::VARCHAR) ELSE content END content FROM t, j)
SELECT k, path, octet_length(content)::BIGINT bytes, upper(sha256(content)) hash FROM e"""
)
def q51_compact_roundtrip(spark, sf_dir):
    # two states of the tree that differ in each file's last byte but in no size, the second made after the first's chunks and cache are there
    meta = "path string, size long, mtime_ticks long, file_hash string, snapshot_file_hash string, chunk_hashes array<string>"
    known, stored, out = spark.createDataFrame([], meta), spark.createDataFrame([], "hash string, data binary"), None
    for k in (0, 1):
        body = F.substring(F.col("content"), F.lit(1), (F.col("bytes") - 1).cast("int"))
        files = tree(spark, sf_dir).select("path", "bytes", F.lit(None).cast("long").alias("mtime_ticks"), F.when(F.col("bytes") > 0, F.concat(body, F.lit(str(k).encode()))).otherwise(F.col("content")).alias("content"))
        plan = cache.probe(files.select("path", F.col("bytes").alias("size"), "mtime_ticks"), known, stored)
        rows = chunking.packed(files.join(plan.where("NOT hit").select("path"), "path", "left_semi"), 1024, 256, 4096)
        read = rows.where("idx IS NULL").select("path", "bytes", "mtime_ticks", "file_hash", "snapshot_file_hash")
        listed = manifests.build(rows.where("idx IS NOT NULL"), read, []).join(read.drop("bytes"), "path")  # a file that hit would be missing here
        stored = stored.unionByName(cas.put_if_absent(rows.where("idx IS NOT NULL").select("hash", codec.decompress("data").alias("data")), stored))
        known = listed.withColumnRenamed("bytes", "size")
        done = manifests.rebuild(listed, stored, []).select(F.lit(k).alias("k"), "path", "bytes", hashing.sha256("content").alias("hash"))
        out = done if out is None else out.unionByName(done)
    return out


@query(f"WITH {T} SELECT path, octet_length(content)::BIGINT bytes, upper(sha256(content)) hash, true sound FROM t")
def q52_gear_roundtrip(spark, sf_dir):
    files = tree(spark, sf_dir)
    found = chunking.gear_chunks(files, 1024, 256, 4096, read_size=512)
    content = manifests.rebuild(manifests.build(chunking.with_hashes(found), files, []), chunking.with_hashes(found).dropDuplicates(["hash"]), [])
    last = found.groupBy("path").agg(F.max("idx").alias("last"))
    ok = (F.col("raw_len") <= 4096) & ((F.col("raw_len") >= 256) | (F.col("idx") == F.col("last")))
    sound = found.drop("data").join(last, "path").groupBy("path").agg((F.bool_and(ok) & (F.count("*") == F.max("idx") + 1)).alias("sound"))
    return content.join(sound, "path", "left").select("path", "bytes", hashing.sha256("content").alias("hash"), F.coalesce("sound", F.lit(True)).alias("sound"))
