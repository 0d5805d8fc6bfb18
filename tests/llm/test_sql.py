"""Queries with SQL against it, and the registry."""

import duckdb
import pytest

from meetflow.llm import queries

TABLES = ("documents", "embeddings", "conversations", "benchmark", "labels")


def normal(df):
    df = df[sorted(df.columns)]
    return sorted(map(str, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert normal(queries.QUERIES[name](spark, sf).toPandas()) == normal(c.sql(queries.SQL[name]).fetchdf())


@pytest.mark.parametrize("name,columns", [
    ("op4_mix_sources", ["doc_id", "size", "source_size", "target", "taken"]), ("op5_toxicity", ["doc_id", "held_out", "score", "predicted"]),
    ("op6_kneser_ney", ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]),
    ("op7_shard_bytes", ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]),
    ("op10_secret_formats", ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]),
    ("op11_suffix_repeats", ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]),
    ("op12_align_tokenizers", ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]),
])
def test_contracts(spark, sf, name, columns):
    rows = queries.QUERIES[name](spark, sf)
    assert rows.columns[: len(columns)] == columns
    assert rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))
