"""Corpus pipeline: toxicity, near-duplicates, benchmark decontamination, source mix, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's rows as Parquet in the shared folder and reads them for the next.
Columns of documents pass unchanged through all stages; the last adds where each
row goes.  The mix repeats documents.

In every stage null and empty texts stay (the mix gives a source of nothing but
those no rows), rows are judged by their own text whatever their id (null and
repeated ids too), repeated rows are rows, further columns pass, and an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meetflow.llm import decontam, minhash, mixing, sharding, toxicity
from meetflow.llm.cut import remove, stored
from meetflow.llm.queries import fold


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose most toxic window scores below 0.5; learns from labelled rows of ``docs`` with crc32(doc_id) mod 5 not 0."""
    params = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), allowed=lambda i: fold(i, 5) != 0)
    return toxicity.reject(docs, params)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts whose sets of five-word shingles are similar to 0.8 or more: the one with the smallest id, null last."""
    return minhash.keep_one(docs, shingle=5, num=80, den=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no 13 tokens, 80 % of them equal, with a benchmark item (a whole item, if that is shorter)."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix to weights 5, 2, 1 takes them (0 to 2 times); 150 % of all words."""
    return mixing.mix_documents(docs, size=mixing.word_count(F.col("text")), quality=mixing.quality_weight(F.col("text")))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ``shard`` (0 to 39, nearly equal bytes, equal texts together) and ``slot`` (gapless in a shard)."""
    return sharding.shard_documents(docs, 40)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mix", mix),
    ("shards", shard),
]

#: SQL has no recurrent network; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  A stage's table goes once the next stage's is written; what the result reads stays."""
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs, path = stored(docs)
            remove(spark, *old)
            old = [path]
    return docs
