"""Queries of the llm operators over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontaminate, exact_dedup, jaccard_join, langid, packing, quality, secrets, sharding, token_store, tokens, toxicity, vector_codes, warc
from .common import read
from .samples import remainder

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_digest(read(spark, sf_dir, "documents"), tokens.tokenizer_path("byte_bpe_50k.json"), end_id=0)


def op2_string_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs, fold=3, held=1))
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(read(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_passages(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.train(docs, read(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    found = quality.score(docs, model)
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(read(spark, sf_dir, "documents"), shards=16)


def op7_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(read(spark, sf_dir, "documents"), tokens.tokenizer_path("word_bpe_49k.json"), end_id=1))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"), keep="largest")


def op9_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(read(spark, sf_dir, "documents")))


def op10_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    found = toxicity.score(docs, model)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_conversations(read(spark, sf_dir, "conversations"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(read(spark, sf_dir, "embeddings"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_token_store,
        op2_string_kernels,
        op3_jaccard_join,
        op4_decontaminate,
        op5_attention_quality,
        op6_jump_shards,
        op7_hilbert_packing,
        op8_exact_dedup,
        op9_secret_ownership,
        op10_toxicity_grammar,
        op11_conversation_repair,
        op12_vector_codes,
        op13_warc,
    )
}

# What the secret scan's patterns are in SQL, whose engine folds more than ASCII where case is ignored.
_EITHER_CASE = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_key")).replace("_", "_?")
_PATTERNS = [("assign", rf"""({_EITHER_CASE})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2), ("access", "AKIA[A-Z0-9]+", 0), ("hex", "[0-9a-f]+", 0), ("owned", "[A-Za-z0-9+/_=-]{20,}", 0)]
_MATCHES = " UNION ALL ".join(f"SELECT doc_id, owner, repo, {rank} AS rank, '{kind}' AS kind, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {group}) AS v, string_split_regex(t, '{p}') AS g FROM d" for rank, (kind, p, group) in enumerate(_PATTERNS))

def _lloyd_sql(rounds: int = vector_codes.ROUNDS, entries: int = vector_codes.ENTRIES) -> str:
    """Product codes in SQL: the rounds written out, each over the distinct parts."""
    dist = "list_sum(list_transform(range(1, len(x) + 1), lambda j: (x[j] - c[j]) * (x[j] - c[j])))"
    steps = []
    for k in range(rounds + 1):
        best = f"min((CASE WHEN len(d.x) > 0 THEN {dist} ELSE 0 END) * 16 + e)::BIGINT AS best"
        steps.append(f"near{k} AS (SELECT d.p, d.x, {best} FROM cells d JOIN book{k} b ON d.p = b.p GROUP BY d.p, d.x)")
        if k < rounds:
            each = f"SELECT n.p, n.x, best, w, unnest(range(1, len(n.x) + 1)) AS j FROM near{k} n JOIN cells c ON n.p = c.p AND n.x = c.x"
            steps.append(f"sums{k} AS (SELECT p, best % 16 AS e, j, sum(w * x[j])::BIGINT AS s, sum(w)::BIGINT AS n FROM ({each}) GROUP BY p, best % 16, j)")
            steps.append(f"mean{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM sums{k} GROUP BY p, e)")
            steps.append(f"book{k + 1} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m ON b.p = m.p AND b.e = m.e)")
    return f"""
        WITH kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), parts AS (
            SELECT vec_id, label, p, v[p * len(v) // 8 + 1:(p + 1) * len(v) // 8] AS x FROM (SELECT *, unnest(range(0, 8)) AS p FROM kept)
        ), cells AS (SELECT p, x, count(*) AS w FROM parts GROUP BY p, x),
        book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries})),
        {", ".join(steps)},
        coded AS (
            SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best % 16), '' ORDER BY d.p) AS code, sum(best // 16)::BIGINT AS error
            FROM parts d JOIN near{rounds} n ON d.p = n.p AND d.x = n.x GROUP BY vec_id
        ), flat AS (SELECT p, e, unnest(range(1, len(c) + 1)) AS j, unnest(c) AS c FROM book{rounds})
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
            (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, j)) FROM flat) AS codebooks_sha256 FROM coded
    """


ORACLE_SQL: dict[str, str] = {
    "op3_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
        ), each AS (
            SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
        ), pairs AS (
            SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) + any_value(b.n) AS n, count(*) AS c FROM each a JOIN each b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
        ), links AS (
            SELECT u, v FROM pairs WHERE 100 * c >= 75 * (n - c) UNION ALL SELECT v, u FROM pairs WHERE 100 * c >= 75 * (n - c)
        ), reach AS (
            SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u
        ), least AS (SELECT u, min(v) AS v FROM reach GROUP BY u)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(v, doc_id) AS component_id FROM sets LEFT JOIN least ON u = doc_id
    """,
    "op9_secret_ownership": f"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, coalesce(source, '') || chr(31) || coalesce(lang, '') AS repo FROM documents
        ), matches AS ({_MATCHES}), places AS (
            SELECT *, unnest(range(1, len(m) + 1)) AS i FROM matches
        ), ended AS (
            SELECT doc_id, owner, repo, rank, kind, v[i] AS value, length(m[i]) AS n, (list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))))::BIGINT AS e FROM places
        ), spans AS (
            SELECT *, e - n AS s FROM ended WHERE length(value) >= CASE rank WHEN 0 THEN 6 WHEN 2 THEN 24 ELSE 20 END
        ), kept AS (
            SELECT * FROM spans WHERE rank < 3
            UNION ALL SELECT x.* FROM spans x WHERE rank = 3 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')
                AND NOT EXISTS (SELECT 1 FROM spans b WHERE b.doc_id = x.doc_id AND b.rank < 3 AND b.s < x.e AND x.s < b.e)
        ), owned AS (
            SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repo)) AS repos FROM kept GROUP BY value
        ), judged AS (
            SELECT k.*, owners = 1 OR (owners <= 2 AND repos <= 4) AS live, kind || ':' || s || ':' || e AS shown FROM kept k JOIN owned o ON k.value = o.value
        )
        SELECT d.doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
               sha256(coalesce(string_agg(shown, ',' ORDER BY s, rank) FILTER (rank < 3), '')) AS base_sha256,
               coalesce(string_agg(shown, ',' ORDER BY s, rank) FILTER (rank < 3 OR live), '') AS spans,
               count(*) FILTER (live) AS n_live, count(*) FILTER (rank = 3 AND NOT live) AS n_dropped
        FROM d LEFT JOIN judged j ON j.doc_id = d.doc_id GROUP BY d.doc_id
    """,
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op12_vector_codes": _lloyd_sql(),
    "op13_warc": """
        WITH sized AS (
            SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages
        ), firsts AS (
            SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM sized
        )
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id > first THEN first END AS refers_to
        FROM firsts
    """,
}
