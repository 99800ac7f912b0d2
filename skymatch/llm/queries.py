"""The registered queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, chat, divergence, hnsw, line_dedup, minhash, mixing, packing, quality, sharding, simhash, token_counts, vector_codes
from .common import materialise, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = quality.fit(docs, table(spark, sf_dir, "labels"), where=fold != 1)
    found = quality.scored(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold == 1).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


#: A conversation whose texts hold the template's own control strings.
TRAP = "\\### Assistant: </turn> ok"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRAP).alias("text"))
    return chat.digest(chat.conversations(chat.segments(rows.unionByName(trap))))


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = materialise(audio.encode(table(spark, sf_dir, "documents")), "media")
    found = audio.feature_digest(audio.describe(media))
    return found.drop("tensor", "spans")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("size").cast("long").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_simhash": op2_simhash,
    "op3_line_dedup": op3_line_dedup,
    "op4_packing": op4_packing,
    "op5_chat": op5_chat,
    "op6_quality": op6_quality,
    "op7_hnsw": op7_hnsw,
    "op8_sharding": op8_sharding,
    "op9_audio": op9_audio,
    "op10_token_counts": op10_token_counts,
    "op11_divergence": op11_divergence,
    "op12_minhash": op12_minhash,
    "op13_vector_codes": op13_vector_codes,
}

#: Capital and small letters, for SQL that lower-cases nothing else.
_CASE = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Codebooks by joins of single components, a round after the other."""
    steps = [f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), cells AS MATERIALIZED (
            SELECT r, k // (len(e) // {parts}) AS part, k % (len(e) // {parts}) AS pos, e[k + 1] AS x FROM (SELECT r, e, unnest(range(len(e))) AS k FROM v)
        ), book0 AS MATERIALIZED (SELECT part, r AS entry, pos, x FROM cells WHERE r < {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (
            SELECT r, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d
            FROM (SELECT c.r, part, b.entry, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS d FROM cells c JOIN book{k} b USING (part, pos) GROUP BY ALL) GROUP BY r, part
        )""")
        if k < rounds:
            steps.append(f"""book{k + 1} AS MATERIALIZED (
            SELECT part, entry, pos, coalesce(m.x, b.x) AS x FROM book{k} b
            LEFT JOIN (SELECT part, entry, pos, floor(sum(c.x)::DOUBLE / count(*))::BIGINT AS x FROM near{k} JOIN cells c USING (r, part) GROUP BY ALL) m USING (part, entry, pos)
        )""")
    return ", ".join(steps) + f"""
        , coded AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY r),
        named AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM book{rounds})
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN coded USING (r), named
    """

ORACLE_SQL: dict[str, str] = {
    "op11_divergence": f"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), {_CASE}) AS t FROM documents),
        w AS (SELECT lang, source, r, term, count(*) AS n FROM (SELECT lang, source, r, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d) GROUP BY ALL),
        kept AS (SELECT lang, term, sum(n)::BIGINT AS ln FROM w GROUP BY ALL HAVING count(*) >= 10),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (
            SELECT g.lang, g.source, kept.term, kept.ln, coalesce(s.n, 0)::BIGINT AS n FROM g JOIN kept USING (lang)
            LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM w GROUP BY ALL) s USING (lang, source, term)
        ), priced AS (
            SELECT *, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER own + 2 * count(*) OVER own) AS p, 1 + (1000000000::HUGEINT * (ln + 2)) // (sum(ln) OVER own + 2 * count(*) OVER own) AS q
            FROM c WINDOW own AS (PARTITION BY lang, source)
        ), f AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
        ), terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM priced WHERE n > 0 AND p > q)
        SELECT * FROM (
            SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
        ) WHERE part = 'pair' OR rank <= 10
    """,
    "op12_minhash": f"""
        WITH RECURSIVE d AS MATERIALIZED (
            SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_CASE}), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
        ), s AS MATERIALIZED (
            SELECT DISTINCT r, array_to_string(w[k:k + 4], ' ') AS shingle FROM (SELECT r, w, unnest(range(1, greatest(2, len(w) - 3))) AS k FROM d WHERE len(w) > 0)
        ), n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
        e AS MATERIALIZED (
            SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.r <> y.r GROUP BY ALL)
            JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)
        ), reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
        least AS (SELECT reach.a AS r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY reach.a)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least.component_id, d.doc_id IS NOT DISTINCT FROM least.component_id AS kept FROM d JOIN least USING (r) LEFT JOIN n USING (r)
    """,
    "op13_vector_codes": _codes_sql(),
    "op5_chat": """
        WITH r AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
        ), s AS (
            SELECT *, lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS ahead,
                length(role || text) + length(regexp_replace(role || text, '[^\\\\#<:]', '', 'g')) AS escaped FROM r
        )
        SELECT conv_id, count(*)::BIGINT AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(escaped + 14)::BIGINT AS formatted_chars,
            bool_and((ahead || '>' || role) IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user')) AS valid
        FROM s GROUP BY conv_id
    """,
}
