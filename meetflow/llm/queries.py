"""The registered queries of the operators in this folder, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_spaced_seed_decontamination(spark, sf_dir):
    from .decontam import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_sentence_span_dedup(spark, sf_dir):
    from .spans import repeated_spans

    return repeated_spans(_table(spark, sf_dir, "documents"))


def op2_chat_snapshot_collapse(spark, sf_dir):
    from .chat import collapse_and_render

    return collapse_and_render(_table(spark, sf_dir, "conversations"))


def op4_mix_sources(spark, sf_dir):
    from .mixing import mix_sources, quality_weight, word_count

    return mix_sources(_table(spark, sf_dir, "documents"), size=word_count(F.col("text")), quality=quality_weight(F.col("text")))


def fold(column, n):
    """crc32 of the id as text, modulo n."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.encode(F.coalesce(column.cast("string"), F.lit("")), "UTF-8")) % n


def op5_toxicity(spark, sf_dir):
    from . import toxicity

    docs = _table(spark, sf_dir, "documents")
    params = toxicity.fit(docs, _table(spark, sf_dir, "labels"), allowed=lambda i: fold(i, 5) != 0)
    scored = toxicity.score(docs, params, keep=["doc_id"])
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_kneser_ney(spark, sf_dir):
    from . import ngram

    docs = _table(spark, sf_dir, "documents")
    model = ngram.train(docs.where(fold("doc_id", 10) != 0))
    rows = ngram.score(docs, model, keep=["doc_id"])
    return rows.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def op7_shard_bytes(spark, sf_dir):
    from .sharding import balanced_shards

    rows = balanced_shards(_table(spark, sf_dir, "documents"), 40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_minhash_components(spark, sf_dir):
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, num=80, den=100)


def op9_subspace_embedding_links(spark, sf_dir):
    from .embed import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"), least=0.9)


def op10_secret_formats(spark, sf_dir):
    from .credentials import secrets

    return secrets(_table(spark, sf_dir, "documents"))


def op11_suffix_repeats(spark, sf_dir):
    from .suffix import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op12_align_tokenizers(spark, sf_dir, tokenizers="/opt/tokenizers"):
    from .align import alignment

    return alignment(_table(spark, sf_dir, "documents"), f"{tokenizers}/byte_bpe_50k.json", f"{tokenizers}/piece_bpe_32k.model")


def op13_filter_audit(spark, sf_dir):
    from .audit import audit

    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_spaced_seed_decontamination, op3_sentence_span_dedup, op2_chat_snapshot_collapse, op4_mix_sources, op5_toxicity, op6_kneser_ney, op7_shard_bytes, op8_minhash_components, op9_subspace_embedding_links, op10_secret_formats, op11_suffix_repeats, op12_align_tokenizers, op13_filter_audit)}

SQL: dict[str, str] = {
    "op2_chat_snapshot_collapse": """WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations),
 c AS (SELECT conv_id, count(*) AS n, list(coalesce(role, chr(1)) || chr(2) || coalesce(text, chr(1)) ORDER BY k) AS turns,
 string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY k) AS text FROM t GROUP BY conv_id),
 i AS (SELECT turns, unnest(generate_series(1, n - 1)) AS m FROM c), p AS (SELECT DISTINCT list_slice(turns, 1, m) AS pre FROM i)
 SELECT min(conv_id) AS conv_id, CAST(n AS INT) AS n_turns, text FROM c LEFT JOIN p ON turns = pre WHERE pre IS NULL GROUP BY turns, n, text""",
    "op8_minhash_components": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS v FROM documents),
 i AS (SELECT doc_id, v, unnest(generate_series(1, greatest(len(v) - 1, least(len(v), 1)))) AS k FROM w), s AS (SELECT DISTINCT doc_id, CASE WHEN len(v) = 1 THEN v[1] ELSE v[k] || ' ' || v[k + 1] END AS sh FROM i),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), m AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT x, y FROM m JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)), e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
 r(doc_id, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.y = e.x), g AS (SELECT doc_id, min(y) AS component_id FROM r GROUP BY doc_id)
 SELECT g.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, g.doc_id = component_id AS kept FROM g LEFT JOIN n ON n.doc_id = g.doc_id""",
    "op9_subspace_embedding_links": """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS u FROM embeddings),
 e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.u, b.u) >= 0.9),
 r(vec_id, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, e.y FROM r JOIN e ON r.y = e.x), g AS (SELECT vec_id, min(y) AS component_id FROM r GROUP BY vec_id),
 k AS (SELECT x, count(*) AS n FROM e GROUP BY x) SELECT g.vec_id, coalesce(k.n, 0) AS n_links, component_id, g.vec_id = component_id AS kept FROM g LEFT JOIN k ON k.x = g.vec_id""",
    "op13_filter_audit": r"""WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS x, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT x, min(doc_id) AS d FROM t GROUP BY x), l AS (SELECT doc_id, max(quality) AS g, max(toxic) AS h FROM labels GROUP BY doc_id),
 f AS (SELECT part, g = 1 AS good, h = 1 AS tox, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * length(regexp_replace(t.x, '[^A-Z]', '', 'g')) > 10 * length(t.x))::INT
 + 8 * regexp_matches(t.x, '[#$%&*|]')::INT + 16 * coalesce(s.d < t.doc_id, false)::INT AS m FROM t JOIN s ON s.x = t.x LEFT JOIN l ON l.doc_id = t.doc_id),
 p(o) AS (SELECT '' UNION ALL SELECT o || c FROM p, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) z WHERE length(o) < 5 AND instr(o, c) = 0),
 k AS (SELECT o, step, 1 << (ascii(o[step]) - 65) AS own, list_sum([1 << (ascii(c) - 65) FOR c IN string_split(o[1:step], '')])::INT - (1 << (ascii(o[step]) - 65)) AS before FROM p, (SELECT unnest(generate_series(1, 5)) AS step) z WHERE length(o) = 5),
 n AS (SELECT part, m, count(*) AS n, count_if(good) AS good, count_if(tox) AS tox FROM f GROUP BY part, m),
 r AS (SELECT part, o, step, own, coalesce(sum(n) FILTER (m & (own | before) = 0), 0) AS kept, coalesce(sum(n) FILTER (m & own <> 0 AND m & before = 0), 0) AS removed, coalesce(sum(n) FILTER (m & own <> 0 AND m & before <> 0), 0) AS redundant,
 coalesce(sum(n) FILTER (m = own), 0) AS unique_fails, coalesce(sum(good) FILTER (m & own <> 0 AND m & before = 0), 0) AS good_lost, coalesce(sum(tox) FILTER (m & own <> 0 AND m & before = 0), 0) AS toxic_lost FROM n, k GROUP BY part, o, step, own)
 SELECT part, o AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
 (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r""",
}
