"""Every stage of the pipeline on small tables, and what the whole keeps."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from .conftest import prose

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(2)
    bad = ["idiotic", "scumbag", "moronic"]
    item = prose(rng, 25)
    rows = []
    for i in range(240):
        w = prose(rng, rng.randint(30, 120)).split()
        if i % 4 == 0:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), "en", f"s{i % 3}", 1))
    rows.append((1001, rows[1][1], "en", "s1", 1))
    rows.append((1002, prose(rng, 40) + " " + item + " " + prose(rng, 30), "en", "s1", 1))
    rows += [(1003, None, None, None, None), (1004, "", "en", "s2", 0), (None, prose(rng, 50), "en", "s0", 1)]
    top = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, DOC).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mix", "shards"]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tables)
        if n < 4:
            assert out.columns == columns
        out = out.cache()
        now = {r["doc_id"] for r in out.collect()}
        if name == "toxicity":
            gone = ids - now
            assert len([i for i in gone if i is not None and i < 240 and i % 4 == 0]) > 50 and len([i for i in gone if i is None or i % 4]) < 8
            assert {1001, 1002, 1003, 1004, None} <= now
        if name == "near_duplicates":
            assert ids - now <= {1001} | set(range(240)) and (1001 not in now or 1 not in ids)
        if name == "decontamination":
            assert ids - now == {1002}
        if name == "mix":
            words = lambda d: d.select(F.sum(F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda x: x != "")))).collect()[0][0]
            assert words(out) == pytest.approx(1.5 * words(docs), rel=0.05)
        if name == "shards":
            assert out.count() == docs.count() and {r["shard"] for r in out.collect()} <= set(range(40))
        docs, ids = out, now


def test_run(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    assert sorted(out.columns) == sorted(["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"])
    rows = out.collect()
    assert len(rows) > 200 and len({(r["shard"], r["slot"]) for r in rows}) == len(rows)


def test_stages_on_empty_tables(spark, tables):
    docs = spark.createDataFrame([], DOC)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        assert out.count() == 0
        docs = out if out.columns == docs.columns else docs
