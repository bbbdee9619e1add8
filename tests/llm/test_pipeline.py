"""The pipeline's stages, each against a plain version of its own input."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from stratum.llm import quality_rules
from tests.llm.helpers import Groups, awkward, frame, prose, shingle_sets
from tests.llm.test_dedup_and_join import held
from tests.llm.test_layout import laid_out

STAGES = dict(corpus_pipeline.STAGES)


def folder(spark, path, rows, items, clash=True):
    frame(spark, rows, clash=clash).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def plain(df):
    return [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in df.collect()]


def walk(spark, sf_dir, tmp_path):
    """(name, rows before, rows after, frame after) of each stage, written and read as the tool does."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        df = stage(spark, docs, sf_dir)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert df.columns == docs.columns
        df.write.parquet(str(tmp_path / f"{k}"))
        after = spark.read.parquet(str(tmp_path / f"{k}"))
        out.append((name, docs, after))
        docs = after
    return out


def check_stages(spark, found, items):
    steps = {name: (before, after) for name, before, after in found}
    before, after = steps["quality_rules"]
    scored = quality_rules.score(before).collect()
    assert Counter(r["doc_id"] for r in scored if r["kept"]) == Counter(r[0] for r in plain(after))

    before, after = (plain(x) for x in steps["jaccard_join"])
    sets, groups = [shingle_sets([(0, t)], 5)[0][0] for _, t, *_ in before], Groups()
    first = {}
    for k, (i, *_) in enumerate(before):
        groups.find(k)
        for j in range(k):
            if sets[k] and sets[j] and 100 * len(sets[k] & sets[j]) >= 80 * len(sets[k] | sets[j]):
                groups.join(k, j)
        if i is not None:
            first.setdefault(i, k)
    kept, rows = Counter(after), {}
    for k, r in enumerate(before):
        rows.setdefault(groups.find(k), []).append(r)
    assert len(after) == len(rows) and not kept - Counter(before)
    for members in rows.values():
        assert sum((Counter(members) & kept).values()) >= 1

    before, after = (plain(x) for x in steps["decontamination"])
    clean = [r for r in before if not held([(r[0], r[1])], items)]
    assert Counter(after) == Counter(clean)

    before, after = (plain(x) for x in steps["mixing"])
    copies = Counter(after)
    assert set(copies) <= set(before) and all(copies[r] <= 2 * n for r, n in Counter(before).items())
    words = sum(len((t or "").encode().split()) for _, t, *_ in before)
    assert abs(sum(n * len((r[1] or "").encode().split()) for r, n in copies.items()) - 1.5 * words) <= 0.02 * words + 50
    before, after = steps["sharding"]
    if before.count() >= 40:
        laid_out(after.collect(), plain(before), 40)


def test_stages_on_awkward_documents(spark, tmp_path):
    r = random.Random(3)
    items = [(k, prose(r, n, 4000)) for k, n in enumerate([6, 20, 80])] + [(9, None), (10, "")]
    rows = awkward() + [(300 + k, prose(r, 120, 3000) + ". " + (items[k % 3][1] if k % 4 == 0 else "end"), "en", f"s{k % 5}") for k in range(60)]
    rows += [(rows[-1][0] + 1, rows[-1][1], "de", None), (rows[-1][0], rows[-1][1], "en", "s4")]
    sf_dir = folder(spark, tmp_path / "in", rows, items)
    check_stages(spark, walk(spark, sf_dir, tmp_path), items)


def test_stages_on_the_driver_tables(spark, sf, tmp_path):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = walk(spark, sf, tmp_path)
    check_stages(spark, found, items)
    kept = {r["doc_id"] for r in found[0][2].collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 and toxic = 0").collect()
    assert len([r for r in labels if r["doc_id"] in kept]) > 0.9 * len(labels)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(None, "only one", "en", "a"), (None, "only one", "en", "a")]])
def test_hardly_any_documents(spark, tmp_path, rows):
    sf_dir = folder(spark, tmp_path / "in", rows, [])
    found = walk(spark, sf_dir, tmp_path)
    assert found[-1][2].count() == 0
    for stage in ("jaccard_join", "decontamination", "mixing"):
        df = STAGES[stage](spark, frame(spark, rows), sf_dir)
        assert df.columns == frame(spark, rows).columns and df.count() <= 2 * len(rows)


def test_run_is_the_last_stage(spark, tmp_path):
    rows = [(k, prose(random.Random(k), 90, 3000) + " the end.", "en", f"s{k % 3}") for k in range(80)]
    sf_dir = folder(spark, tmp_path / "in", rows, [(1, prose(random.Random(5), 30, 3000))])
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_are_named_and_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "decontamination", "mixing", "sharding"]
