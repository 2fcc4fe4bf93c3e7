"""The operators over the driver's tables, each with the same result in SQL.

Entity, run and text tables are views of the driver's ones: nations are repositories, suppliers modules, parts classes,
market segments packages, customers summaries. A view is one statement that both engines read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical, join_path
from ..operators import context, facts, graph, overlap, resampling, statistics
from ..sources import results, snapshots
from ..sources.staging import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# Views in SQL that both engines read.
VIEWS = {
    "repositories": """
        SELECT n_name AS repo_name, r_name AS detected_framework, concat('4.', CAST(n_regionkey AS STRING)) AS framework_version,
               CASE WHEN n_nationkey % 2 = 0 THEN 'typescript' ELSE 'javascript' END AS detected_language
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "modules": """
        SELECT n_name AS repo_name, concat('mod_', CAST(s_suppkey AS STRING)) AS id, concat('src/', lower(s_name), '.ts') AS path, s_suppkey AS pos
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "steps": """
        SELECT l_suppkey AS a, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS b
        FROM lineitem""",
    "import_edges": """
        SELECT n_name AS repo_name, concat('mod_', CAST(a AS STRING)) AS from_module_id, concat('mod_', CAST(b AS STRING)) AS to_module_id
        FROM steps JOIN supplier ON a = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE b IS NOT NULL""",
    "classes": """
        SELECT DISTINCT n_name AS repo_name, concat('cls_', CAST(p_partkey AS STRING), '_', CAST(s_suppkey AS STRING)) AS id,
               replace(p_brand, '#', '') AS name, concat('mod_', CAST(s_suppkey AS STRING)) AS module_id, p_partkey AS pos
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "functions": """
        SELECT DISTINCT n_name AS repo_name, concat('fn_', c_mktsegment) AS id, concat('handle', c_mktsegment) AS name, concat('mod_', CAST(s AS STRING)) AS module_id
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT s_nationkey, min(s_suppkey) AS s FROM supplier GROUP BY s_nationkey) AS x ON s_nationkey = n_nationkey""",
    "endpoints": """
        SELECT DISTINCT n_name AS repo_name, concat('ep_', o_orderstatus, '_', c_mktsegment) AS id,
               CASE o_orderstatus WHEN 'O' THEN 'GET' WHEN 'F' THEN 'POST' ELSE 'PUT' END AS method, concat('/', lower(c_mktsegment), '/:id') AS path,
               CASE WHEN o_orderstatus = 'O' THEN concat('fn_', c_mktsegment) END AS handler_function_id
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "external_deps": """
        SELECT DISTINCT n_name AS repo_name, concat('@', lower(c_mktsegment), '/core') AS name, c_mktsegment AS pos
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "config_files": "SELECT n_name AS repo_name, 'package.json' AS path FROM nation",
    "db_entities": "SELECT n_name AS repo_name, 'Order' AS name, 1 AS pos FROM nation WHERE n_nationkey % 3 = 0",
    "services": "SELECT n_name AS repo_name, 'OrderService' AS name, 1 AS pos FROM nation",
    "routes": """
        SELECT n_name AS repo_name, 'GET' AS method, '/orders/:id' AS path, 1 AS pos FROM nation
        UNION ALL SELECT n_name, 'POST', '/orders/{id}/items', 2 FROM nation""",
    "summaries": """
        SELECT n_name AS repo_name, c_custkey,
               CASE c_custkey % 7
                 WHEN 0 THEN concat('A ', r_name, ' service in TypeScript with @', lower(c_mktsegment), '/core. GET `/orders/42` returns an Order.')
                 WHEN 1 THEN concat('It uses ', lower(c_mktsegment), ' and core; /orders/:id is served by the order service, in js.')
                 WHEN 2 THEN concat('OrderService (ts) answers POST /orders/', CAST(c_custkey AS STRING), '/items, see Orders; built on ', lower(c_mktsegment), '/core')
                 WHEN 3 THEN concat('orderservice for ', lower(r_name), ' in javascript; routes: /orders/7/ and /orders/{x}/items.')
                 WHEN 4 THEN concat('An `', c_name, '` overview: Node.js, UserController.ts, /api/', lower(c_mktsegment), '/v1 and @acme/tools-lib.')
                 WHEN 5 THEN concat(r_name, 'X and TypeScripts are near misses; GET then nothing; /ordersx/1; @', lower(c_mktsegment), '/corez')
               END AS summary_text
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "runs": """
        SELECT event_type AS variant, concat('m', CAST(user_id % 3 AS STRING)) AS model, user_id, event_id, value, CAST(floor(value * 10) AS BIGINT) AS tokens, props
        FROM events""",
    "spending": """
        SELECT o_custkey, o_orderpriority, max(CAST(floor(o_totalprice) AS BIGINT)) AS v FROM orders GROUP BY o_custkey, o_orderpriority""",
}


def _read_by(text: str) -> set[str]:
    return set(re.findall(r"(?:FROM|JOIN)\s+(\w+)", text))


def statement(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A statement over the driver's tables and VIEWS, which become temporary views under their names."""
    for name in sorted(_read_by(text) & {*TABLES, *VIEWS}):
        view(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS, or a table of the driver."""
    return statement(spark, sf_dir, VIEWS[name]) if name in VIEWS else spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oracle(body: str, *names: str) -> str:
    """body behind the views that it reads, in DuckDB's words."""
    order: list[str] = []

    def add(n: str) -> None:
        text = VIEWS[n]
        for other in sorted(_read_by(text) & {*VIEWS} - {n, *order}):
            add(other)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({VIEWS[n]})" for n in order]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def query(sql: str | None, *names: str) -> Callable[[Query], Query]:
    """Registers a query with its SQL, in front of which the named views are put."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            body = sql.strip()
            if body.startswith("WITH ") and names:
                recursive = body.startswith("WITH RECURSIVE ")
                head = oracle("", *names).strip()
                rest = body[len("WITH RECURSIVE ") :] if recursive else body[len("WITH ") :]
                ORACLE_SQL[f.__name__] = head.replace("WITH ", "WITH RECURSIVE " if recursive else "WITH ", 1) + ", " + rest
            else:
                ORACLE_SQL[f.__name__] = oracle(body, *names)
        return f

    return register


# --- facts and their matching

_WORD = "regexp_matches({0}, '(^|[^A-Za-z0-9_])' || regexp_escape({1}) || '([^A-Za-z0-9_]|$)'{2})"
_any, _exact = (lambda t, v: _WORD.format(t, v, ", 'i'")), (lambda t, v: _WORD.format(t, v, ""))

_FACTS_SQL = """
    facts AS (
        SELECT repo_name, 0 AS section, 1 AS pos, 'Framework: ' || detected_framework || ' ' || framework_version AS fact FROM repositories
        UNION ALL SELECT repo_name, 1, 1, 'Language: ' || detected_language FROM repositories
        UNION ALL SELECT repo_name, 2, row_number() OVER (PARTITION BY repo_name ORDER BY pos), 'Dependency: ' || name FROM external_deps
        UNION ALL SELECT repo_name, 3, row_number() OVER (PARTITION BY repo_name ORDER BY pos), 'Endpoint: ' || method || ' ' || path FROM routes
        UNION ALL SELECT repo_name, 4, row_number() OVER (PARTITION BY repo_name ORDER BY pos), 'Class/Service: ' || name FROM services
        UNION ALL SELECT repo_name, 5, row_number() OVER (PARTITION BY repo_name ORDER BY pos), 'Database entity: ' || name FROM db_entities
    )"""
_FACT_VIEWS = ("repositories", "external_deps", "routes", "services", "db_entities")

_MATCH_SQL = f"""
    valued AS (
        SELECT c_custkey, s.repo_name, fact, split_part(fact, ':', 1) AS category, trim(substr(fact, instr(fact, ':') + 1)) AS v, coalesce(summary_text, '') AS t
        FROM summaries s JOIN facts f ON s.repo_name = f.repo_name
    ), parts AS (
        SELECT *, split_part(v, ' ', 1) AS name, split_part(substr(v, 2), '/', 1) AS owner, substr(v, 2) AS bare, split_part(substr(v, 2), '/', 2) AS sub,
               CASE split_part(v, ' ', 2) WHEN '/orders/:id' THEN regexp_extract(t, '(?i)/orders/[^/\\s`''"]+/?([^A-Za-z0-9_]|$)')
                                          WHEN '/orders/{{id}}/items' THEN regexp_extract(t, '(?i)/orders/[^/\\s`''"]+/items/?([^A-Za-z0-9_]|$)') END AS hit
        FROM valued
    ), matches AS (
        SELECT c_custkey, repo_name, fact, category,
               CASE category
                 WHEN 'Framework' THEN CASE WHEN {_any("t", "name")} THEN 'framework_name' END
                 WHEN 'Language' THEN CASE WHEN {_any("t", "v")} THEN 'language_exact'
                                           WHEN {_any("t", "CASE v WHEN 'typescript' THEN 'ts' ELSE 'js' END")} THEN 'language_abbrev' END
                 WHEN 'Dependency' THEN CASE WHEN {_any("t", "v")} THEN 'dep_exact' WHEN {_any("t", "bare")} THEN 'dep_unprefixed_scope'
                                             WHEN {_any("t", "owner")} AND {_any("t", "sub")} THEN 'dep_scope_and_sub' END
                 WHEN 'Endpoint' THEN CASE WHEN hit <> '' THEN CASE WHEN {_any("substr(t, greatest(strpos(t, hit) - 24, 1), least(strpos(t, hit) - 1, 24))", "name")} THEN 'endpoint_method_path' ELSE 'endpoint_path_only' END END
                 WHEN 'Class/Service' THEN CASE WHEN {_exact("t", "v")} THEN 'class_exact_cs' WHEN {_any("t", "v")} THEN 'class_exact_ci' WHEN {_any("t", "'order service'")} THEN 'class_camel_split' END
                 WHEN 'Database entity' THEN CASE WHEN {_exact("t", "v")} THEN 'entity_exact_cs' WHEN {_exact("t", "v || 's'")} THEN 'entity_plural_cs' END
               END AS rule
        FROM parts
    ), tiers AS (
        SELECT *, rule IS NOT NULL AS lenient,
               coalesce(rule IN ('framework_name', 'language_exact', 'dep_exact', 'dep_unprefixed_scope', 'endpoint_method_path', 'class_exact_cs', 'entity_exact_cs'), false) AS strict
        FROM matches
    )"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.coverable_facts(*(view(spark, sf_dir, n) for n in ("repositories", "external_deps", "routes", "services", "db_entities")))


@query(
    f"WITH {_FACTS_SQL}, {_MATCH_SQL} SELECT category, coalesce(rule, '') AS rule, count(*) AS n, count(*) FILTER (strict) AS n_strict FROM tiers GROUP BY ALL",
    *_FACT_VIEWS,
    "summaries",
)
def fact_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """how often each matching rule decides."""
    m = facts.match_facts(_facts(spark, sf_dir), view(spark, sf_dir, "summaries"))
    return m.groupBy("category", F.coalesce("rule", F.lit("")).alias("rule")).agg(F.count("*").alias("n"), F.count_if("strict").alias("n_strict"))


@query(
    f"WITH {_FACTS_SQL}, {_MATCH_SQL} SELECT c_custkey, count(*) AS total_facts, count(*) FILTER (strict) AS covered_strict, count(*) FILTER (lenient) AS covered_lenient, round(avg(strict::INT), 4) AS coverage_strict, round(avg(lenient::INT), 4) AS coverage_lenient, string_agg(CASE WHEN NOT strict THEN fact END, '|' ORDER BY fact COLLATE C) AS missing FROM tiers GROUP BY c_custkey",
    *_FACT_VIEWS,
    "summaries",
)
def fact_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: coverage of every summary at both tiers, with what it misses."""
    m = facts.match_facts(_facts(spark, sf_dir), view(spark, sf_dir, "summaries"))
    c = facts.coverage(m, ["c_custkey"])
    return c.select(
        "c_custkey",
        "total_facts",
        "covered_strict",
        "covered_lenient",
        F.round("coverage_strict", 4).alias("coverage_strict"),
        F.round("coverage_lenient", 4).alias("coverage_lenient"),
        F.array_join("missing_strict", "|").alias("missing"),
    )


@query(f"WITH {_FACTS_SQL} SELECT repo_name, split_part(fact, ':', 1) AS category, count(*) AS n FROM facts GROUP BY ALL", *_FACT_VIEWS)
def fact_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2."""
    return facts.fact_counts(_facts(spark, sf_dir))


_STOP = ", ".join(f"'{w}'" for w in facts.STOPLIST)
_CANDIDATES_SQL = f"""
    raw AS (
        SELECT c_custkey, summary_text AS t FROM summaries WHERE summary_text IS NOT NULL
    ), found AS (
        SELECT c_custkey, 1 AS k, generate_subscripts(x, 1) AS i, unnest(x) AS r FROM (SELECT c_custkey, regexp_extract_all(t, '`([^`\\n]{{2,60}})`', 1) AS x FROM raw)
        UNION ALL SELECT c_custkey, 2, generate_subscripts(x, 1), unnest(x) FROM (SELECT c_custkey, regexp_extract_all(t, '(?:^|[^A-Za-z0-9_])(/[A-Za-z0-9_\\-{{}}:./]{{2,60}})', 1) AS x FROM raw)
        UNION ALL SELECT c_custkey, 3, generate_subscripts(x, 1), unnest(x) FROM (SELECT c_custkey, regexp_extract_all(t, '(?:^|[^A-Za-z0-9_])(@[A-Za-z0-9_\\-]+/[A-Za-z0-9_\\-.]+)', 1) AS x FROM raw)
        UNION ALL SELECT c_custkey, 4, generate_subscripts(x, 1), unnest(x) FROM (SELECT c_custkey, regexp_extract_all(t, '(?:^|[^A-Za-z0-9_])([A-Za-z0-9_\\-]+\\.(?:ts|js|tsx|jsx|json|yml|yaml))', 1) AS x FROM raw)
        UNION ALL SELECT c_custkey, 5, generate_subscripts(x, 1), unnest(x) FROM (SELECT c_custkey, regexp_extract_all(t, '\\b((?:[A-Z][a-z0-9]+){{2,}})\\b', 1) AS x FROM raw)
    ), bare AS (
        SELECT c_custkey, k, i, regexp_replace(regexp_replace(trim(r), '^[`''"]+|[`''"]+$', '', 'g'), '[.,;:)]+$', '') AS candidate FROM found
    ), candidates AS (
        SELECT c_custkey, lower(candidate) AS low, arg_min(candidate, k * 1000 + i) AS candidate, arg_min(k, k * 1000 + i) AS k FROM bare
        WHERE length(candidate) >= 2 AND lower(candidate) NOT IN ({_STOP}) AND regexp_replace(lower(candidate), '\\.(ts|js|tsx|jsx|json|yml|yaml)$', '') NOT IN ({_STOP})
          AND NOT regexp_matches(candidate, '^[A-Z][a-z]+\\.(js|ts)$')
        GROUP BY ALL
    )"""


@query(
    f"WITH {_CANDIDATES_SQL} SELECT c_custkey, candidate, CASE k WHEN 1 THEN 'backticked' WHEN 2 THEN 'path' WHEN 3 THEN 'scoped_pkg' WHEN 4 THEN 'file' ELSE 'pascal' END AS kind FROM candidates",
    "summaries",
)
def identifier_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F14, F15."""
    return facts.identifier_candidates(view(spark, sf_dir, "summaries"), ["c_custkey"]).select("c_custkey", "candidate", "kind")


@query(
    f"""WITH {_CANDIDATES_SQL}, known AS (
        SELECT DISTINCT repo_name, lower(x) AS name FROM (
            SELECT repo_name, unnest([repo_name, detected_framework, detected_language]) AS x FROM repositories
            UNION ALL SELECT repo_name, unnest([name, ltrim(name, '@'), split_part(substr(name, 2), '/', 1), split_part(substr(name, 2), '/', 2)]) FROM external_deps
            UNION ALL SELECT repo_name, path FROM routes
            UNION ALL SELECT repo_name, unnest([name, 'order service']) FROM services
            UNION ALL SELECT repo_name, name FROM db_entities
            UNION ALL SELECT repo_name, path FROM config_files)
    ), judged AS (
        SELECT c.c_custkey, c.candidate, bool_or(k.name = c.low OR k.name = ltrim(c.low, '@') OR (length(k.name) > 3 AND (contains(k.name, c.low) OR contains(c.low, k.name)))) AS supported
        FROM candidates c JOIN (SELECT DISTINCT c_custkey, repo_name FROM summaries) s ON c.c_custkey = s.c_custkey JOIN known k ON k.repo_name = s.repo_name GROUP BY ALL
    )
    SELECT s.c_custkey, count(candidate) AS total_candidates, count(*) FILTER (supported) AS supported,
           CASE WHEN count(candidate) = 0 THEN 0.0 ELSE round((count(candidate) - count(*) FILTER (supported)) / count(candidate)::DOUBLE, 4) END AS unsupported_identifier_rate
    FROM summaries s LEFT JOIN judged j ON s.c_custkey = j.c_custkey GROUP BY s.c_custkey""",
    *_FACT_VIEWS,
    "config_files",
    "summaries",
)
def unsupported_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16, F17, A9."""
    v = lambda n: view(spark, sf_dir, n)
    none = lambda t, *cs: t.select("repo_name", *(F.lit(None).cast("string").alias(c) for c in cs)).limit(0)
    repos = v("repositories")
    tables = {
        "repositories": repos,
        "modules": none(repos, "path", "id"),
        "classes": v("services"),
        "functions": none(repos, "name"),
        "endpoints": v("routes"),
        "db_entities": v("db_entities").withColumn("source_path", F.lit(None).cast("string")),
        "external_deps": v("external_deps"),
        "config_files": v("config_files"),
    }
    summaries = v("summaries")
    c = facts.identifier_candidates(summaries, ["repo_name", "c_custkey"])
    judged = facts.unsupported(c, facts.known_identifiers(tables))
    return facts.unsupported_rate(judged, summaries, ["repo_name", "c_custkey"]).select(
        "c_custkey",
        "total_candidates",
        "supported",
        F.round("unsupported_identifier_rate", 4).alias("unsupported_identifier_rate"),
    )


_NOISY = """
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat('  "', upper(p_name), '"') WHEN 1 THEN concat('12. ', replace(p_name, ' ', ' !! ')) WHEN 2 THEN concat('`', p_name, '`') ELSE concat('fact ', CAST(p_size AS STRING), '.') END AS item
    FROM part"""


@query(
    f"""WITH noisy AS ({_NOISY}), named AS (
        SELECT item, p_partkey, trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(trim(item), '^[`''" ]+|[`''" ]+$', '', 'g'), '^\\s*\\d+[.)]\\s*', '')), '[^a-z0-9/:@._-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS canon,
               try_cast(nullif(regexp_extract(lower(trim(item)), '^(?:fact|item|no|number|#)?\\s*[#.)]?\\s*(\\d{{1,3}})\\s*[.)]?$', 1), '') AS INT) AS n
        FROM noisy
    ), facts AS (SELECT p_name AS fact, row_number() OVER (ORDER BY p_name) AS n FROM (SELECT DISTINCT p_name FROM part))
    SELECT coalesce(a.fact, b.fact) AS fact, count(*) AS n_items, count(DISTINCT item) AS n_forms FROM named LEFT JOIN facts a ON a.fact = canon LEFT JOIN facts b ON b.n = named.n AND a.fact IS NULL GROUP BY ALL"""
)
def canonical_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy renderings of facts, and positions, resolved to the facts."""
    part = view(spark, sf_dir, "part")
    names = part.select(F.lit("all").alias("repo_name"), F.col("p_name").alias("fact")).distinct().select(
        "repo_name",
        F.lit(0).alias("section"),
        F.lit(0).alias("pos"),
        "fact",
    )
    noisy = statement(spark, sf_dir, _NOISY).select(F.lit("all").alias("repo_name"), "p_partkey", "item")
    got = facts.resolve_verdict(noisy, names, ["repo_name", "p_partkey"])
    return got.groupBy("fact").agg(F.count("*").alias("n_items"), F.count_distinct("item").alias("n_forms"))


_VERDICTS = """
    SELECT c_custkey, CASE c_custkey % 5
        WHEN 0 THEN concat('Sure: {"total_claims": ', CAST(c_nationkey AS STRING), ', "unsupported_claims": ["GET /', lower(c_mktsegment), '", " ", "uses Redis"]} done')
        WHEN 1 THEN '{"total_claims": 1, "unsupported_claims": ["a", "b", "c"]}'
        WHEN 2 THEN 'no json here'
        WHEN 3 THEN '{"total_claims": "many", "unsupported_claims": []}'
        ELSE '{"total_claims": 4, "unsupported_claims": []}' END AS raw_text
    FROM customer"""


@query(
    f"""WITH raw AS ({_VERDICTS}), parsed AS (
        SELECT c_custkey, TRY_CAST(nullif(regexp_extract(raw_text, '(?s)\\{{.*\\}}'), '') AS JSON) AS j FROM raw
    ), lists AS (
        SELECT c_custkey, try_cast(json_extract_string(j, '$.total_claims') AS INT) AS total, list_filter(list_transform(from_json(json_extract(j, '$.unsupported_claims'), '["VARCHAR"]'), lambda c: trim(c)), lambda c: c <> '') AS claims FROM parsed
    )
    SELECT c_custkey, CASE WHEN total IS NOT NULL AND claims IS NOT NULL THEN greatest(total, len(claims)) END::INT AS total, CASE WHEN total IS NOT NULL AND claims IS NOT NULL THEN len(claims) END::INT AS unsupported,
           CASE WHEN total IS NOT NULL AND claims IS NOT NULL THEN round(CASE WHEN greatest(total, len(claims)) > 0 THEN len(claims) / greatest(total, len(claims))::DOUBLE ELSE 0.0 END, 4) END AS score
    FROM lists"""
)
def hallucination_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7, F9, A11."""
    raw = statement(spark, sf_dir, _VERDICTS)
    got = raw.withColumn("v", facts.hallucination_verdict(F.col("raw_text")))
    n = F.size("v.unsupported")
    return got.select(
        "c_custkey",
        "v.total",
        F.when(F.col("v").isNotNull(), n).alias("unsupported"),
        F.when(F.col("v").isNotNull(), F.round(F.coalesce(F.try_divide(n, F.col("v.total")), F.lit(0.0)), 4)).alias("score"),
    )


_TAGGED = """
    SELECT conv_id, turn, role, text, CASE WHEN turn % 3 = 0 THEN 'POST /v1/x' WHEN turn % 3 = 1 THEN 'uses Redis' END AS claim,
           CASE turn % 4 WHEN 0 THEN 'Endpoint: GET /a' WHEN 1 THEN 'Dependency: x' WHEN 2 THEN 'Language: ts' ELSE 'Other: y' END AS missing
    FROM conversations"""


@query(
    f"""WITH t AS ({_TAGGED}), tags AS (
        SELECT role, CASE WHEN claim LIKE 'POST%' THEN 'fabricated_endpoint' ELSE 'fabricated_technology' END AS tag FROM t WHERE claim IS NOT NULL
        UNION ALL SELECT role, CASE WHEN missing LIKE 'Endpoint:%' THEN 'missed_endpoint' WHEN missing LIKE 'Dependency:%' THEN 'missed_dependency' ELSE 'missed_framework_or_language' END FROM t WHERE missing NOT LIKE 'Other%'
        UNION ALL SELECT role, 'over_generic' FROM t WHERE trim(text) <> '' AND (len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')) < 12 OR NOT contains(lower(text), 'the'))
        UNION ALL SELECT role, 'malformed_output' FROM t WHERE turn % 5 = 0
    ) SELECT role, tag, count(*) AS n FROM tags GROUP BY ALL"""
)
def failure_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F18-F20, A12."""
    rows = statement(spark, sf_dir, _TAGGED)
    rows = rows.select(
        "role",
        F.array_compact(F.array("claim")).alias("unsupported_claims"),
        F.array("missing").alias("missing_facts"),
        F.col("text").alias("overview"),
        F.array(F.lit("The")).alias("known_terms"),
        (F.col("turn") % 5 != 0).alias("judged"),
    )
    return facts.tag_frequencies(facts.failure_tags(rows, judged=F.col("judged")), ["role"])


@query("""SELECT CASE WHEN regexp_matches(trim(p_name), '^\\d+[.)]*$') THEN 'index' WHEN regexp_matches(x, '[:/]') THEN 'fact-like' WHEN regexp_matches(x, '^\\d+[.)]*$') THEN 'index' ELSE 'other' END AS kind, count(*) AS n
    FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN '"' || p_size || '.)"' WHEN 1 THEN 'Endpoint: ' || p_name ELSE p_name END AS raw, trim(regexp_replace(trim(raw), '^[`''" ]+|[`''" ]+$', '', 'g')) AS x FROM part) GROUP BY ALL""")
def unmatched_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F21, A22."""
    item = F.when(
        F.col("p_partkey") % 3 == 0,
        F.concat(F.lit('"'), F.col("p_size").cast("string"), F.lit('.)"')),
    ).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("Endpoint: "), F.col("p_name"))).otherwise(F.col("p_name"))
    return view(spark, sf_dir, "part").groupBy(facts.unmatched_class(item).alias("kind")).agg(F.count("*").alias("n"))


# --- the graph and its texts


@query(
    "SELECT DISTINCT e.repo_name, a.path AS from_path, b.path AS to_path FROM import_edges e JOIN modules a ON e.repo_name = a.repo_name AND from_module_id = a.id JOIN modules b ON e.repo_name = b.repo_name AND to_module_id = b.id",
    "import_edges",
    "modules",
)
def import_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edges with both ends in the repository, as paths."""
    return graph.path_edges(view(spark, sf_dir, "import_edges"), view(spark, sf_dir, "modules"))


@query(
    "SELECT a.n_name AS from_repo, count(*) AS n FROM steps JOIN supplier x ON a = x.s_suppkey JOIN supplier y ON b = y.s_suppkey JOIN nation a ON x.s_nationkey = a.n_nationkey JOIN nation c ON y.s_nationkey = c.n_nationkey WHERE a.n_name <> c.n_name GROUP BY ALL".replace("ON a = x", "ON steps.a = x"),
    "steps",
)
def cross_scope_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that leave their repository, by it."""
    e = view(spark, sf_dir, "steps").filter("b is not null")
    s = view(spark, sf_dir, "supplier").join(view(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    a, b = s.withColumnsRenamed({"s_suppkey": "a", "n_name": "from_repo"}), s.withColumnsRenamed({"s_suppkey": "b", "n_name": "to_repo"})
    return graph.cross_scope(e.join(a, "a").join(b, "b").withColumn("kind", F.col("from_repo")), "from_repo", "to_repo", "kind").withColumnRenamed("kind", "from_repo")


@query("""WITH stored AS (SELECT c_custkey, 0 AS gen, c_mktsegment AS state, TIMESTAMP '1990-01-01' AS changed FROM customer),
    news AS (SELECT o_custkey, 1, o_orderstatus || CAST(o_orderkey AS VARCHAR), o_orderdate + o_orderkey * INTERVAL 1 MICROSECOND FROM orders)
    SELECT c_custkey, arg_max(state, changed) AS state FROM (SELECT * FROM stored UNION ALL SELECT * FROM news) GROUP BY c_custkey""")
def merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert by key, the newest of several new rows staying."""
    old = view(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("state"))
    new = view(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"),
        F.concat("o_orderstatus", F.col("o_orderkey").cast("string")).alias("state"),
        "o_orderdate",
        "o_orderkey",
    )
    return graph.upsert(old, new, ["c_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("c_custkey", "state")


@query("""WITH nodes AS (
        SELECT n_name, n_nationkey % 2 = 1 AS again, 'modules' AS kind, s_suppkey AS id, s_acctbal > 0 AS kept FROM supplier JOIN nation ON s_nationkey = n_nationkey
        UNION ALL SELECT n_name, n_nationkey % 2 = 1, 'functions', c_custkey, false FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT n_name AS repo_name, kind, count(*) AS n, sum(id)::BIGINT AS ids FROM nodes WHERE NOT again OR kept GROUP BY ALL""")
def graph_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as repositories of modules and functions, all written; then every other one parsed again, which leaves
    them the modules with a balance and no functions. Both writes are snapshots; the last one is read."""
    v = lambda n: view(spark, sf_dir, n)
    nation = v("nation").select("n_nationkey", F.col("n_name").alias("repo_name"))
    modules = v("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    functions = v("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("repo_name", "n_nationkey", F.col("c_custkey").alias("id"))
    modules = modules.select("repo_name", "n_nationkey", F.col("s_suppkey").alias("id"), "s_acctbal")
    path = scratch_path(spark, "graph")
    snapshots.write_graph({"repositories": nation, "modules": modules, "functions": functions}, path)
    again = F.col("n_nationkey") % 2 == 1
    snapshots.write_graph(
        {"repositories": nation.filter(again), "modules": modules.filter(again & (F.col("s_acctbal") > 0)), "functions": functions.filter(again).limit(0)},
        path,
    )
    tables = snapshots.read_graph(spark, path)
    nodes = reduce(DataFrame.unionByName, (tables[k].select("repo_name", F.lit(k).alias("kind"), "id") for k in ("modules", "functions")))
    return nodes.groupBy("repo_name", "kind").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uniqueness constraint as a check."""
    return graph.duplicates(view(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber <= 3)")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to do after what is done."""
    done = view(spark, sf_dir, "lineitem").filter("l_linenumber <= 3").select(F.col("l_orderkey").alias("o_orderkey"))
    return results.to_do(view(spark, sf_dir, "orders"), done, ["o_orderkey"]).select("o_orderkey", "o_custkey")


_IMPORTS_SQL = """
    pe AS (SELECT DISTINCT e.repo_name, a.path AS from_path, b.path AS to_path FROM import_edges e JOIN modules a ON e.repo_name = a.repo_name AND from_module_id = a.id JOIN modules b ON e.repo_name = b.repo_name AND to_module_id = b.id),
    im AS (SELECT repo_name, from_path AS path, string_agg(to_path, ', ' ORDER BY to_path) AS imports FROM pe GROUP BY ALL)"""


@query(
    f"""WITH {_IMPORTS_SQL}, lines AS (SELECT m.repo_name, m.path, '- ' || m.path || ' imports: ' || coalesce(imports, '(none)') AS line FROM modules m LEFT JOIN im ON m.repo_name = im.repo_name AND m.path = im.path),
    deps AS (SELECT repo_name, string_agg(name, ', ' ORDER BY name) AS d FROM external_deps GROUP BY ALL)
    SELECT l.repo_name, 'Module dependency graph:' || chr(10) || string_agg(line, chr(10) ORDER BY path) || chr(10) || chr(10) || 'External dependencies: ' || coalesce(any_value(d), '(none)') AS context
    FROM lines l LEFT JOIN deps ON l.repo_name = deps.repo_name GROUP BY ALL""",
    "import_edges",
    "modules",
    "external_deps",
)
def dependency_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1, T-1."""
    return context.dependency_text(graph.dependency_view(view(spark, sf_dir, "modules"), view(spark, sf_dir, "import_edges"), view(spark, sf_dir, "external_deps")))


@query(
    f"""WITH {_IMPORTS_SQL}, de AS (SELECT repo_name, module_id, string_agg(DISTINCT name, ', ' ORDER BY name) AS defines FROM classes GROUP BY ALL),
    lines AS (SELECT m.repo_name, m.path, '- ' || m.path || chr(10) || '    imports: ' || coalesce(imports, '(none)') || coalesce(chr(10) || '    defines: ' || defines, '') AS line
              FROM modules m LEFT JOIN im ON m.repo_name = im.repo_name AND m.path = im.path LEFT JOIN de ON m.repo_name = de.repo_name AND m.id = de.module_id),
    mo AS (SELECT repo_name, count(*) AS n, string_agg(line, chr(10) ORDER BY path) AS t FROM lines GROUP BY ALL),
    cl AS (SELECT repo_name, count(DISTINCT name) AS n, string_agg(DISTINCT '- ' || name, chr(10) ORDER BY '- ' || name) AS t FROM classes GROUP BY ALL),
    ep AS (SELECT repo_name, count(*) AS n, string_agg('- ' || method || ' ' || path || ' -> ' || coalesce(h, '(inline handler, no stable function reference)'), chr(10) ORDER BY path, method, h NULLS FIRST) AS t
           FROM (SELECT DISTINCT e.repo_name, method, path, f.name AS h FROM endpoints e LEFT JOIN functions f ON e.repo_name = f.repo_name AND handler_function_id = f.id) GROUP BY ALL),
    dp AS (SELECT repo_name, string_agg(name, ', ' ORDER BY name) AS t FROM external_deps GROUP BY ALL),
    db AS (SELECT repo_name, string_agg(name, ', ' ORDER BY name) AS t FROM db_entities GROUP BY ALL)
    SELECT r.repo_name, concat_ws(chr(10), 'Framework: ' || detected_framework || ' (' || framework_version || ')', '', 'Modules (' || coalesce(mo.n, 0) || '):', coalesce(mo.t, '(none)'), '', 'Classes (' || coalesce(cl.n, 0) || '):', coalesce(cl.t, '(none)'), '',
           'API endpoints (' || coalesce(ep.n, 0) || '):', coalesce(ep.t, '(none)'), '', 'External dependencies: ' || coalesce(dp.t, '(none)'), 'Config files: package.json', 'Database entities: ' || coalesce(db.t, '(none)')) AS context
    FROM repositories r LEFT JOIN mo ON r.repo_name = mo.repo_name LEFT JOIN cl ON r.repo_name = cl.repo_name LEFT JOIN ep ON r.repo_name = ep.repo_name LEFT JOIN dp ON r.repo_name = dp.repo_name LEFT JOIN db ON r.repo_name = db.repo_name""",
    "import_edges",
    "modules",
    "classes",
    "functions",
    "endpoints",
    "external_deps",
    "config_files",
    "db_entities",
    "repositories",
)
def knowledge_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2, T-2."""
    names = ("repositories", "modules", "import_edges", "classes", "endpoints", "functions", "external_deps", "config_files", "db_entities")
    return context.knowledge_text(graph.knowledge_view(*(view(spark, sf_dir, n) for n in names)))


@query(
    """WITH rows AS (
        SELECT repo_name, 1 AS s, id AS a, path AS b, '  ' || id || '["' || path || '"]' AS line FROM modules
        UNION ALL SELECT DISTINCT e.repo_name, 2, from_module_id, to_module_id, '  ' || from_module_id || ' --> ' || to_module_id FROM import_edges e JOIN modules x ON e.repo_name = x.repo_name AND from_module_id = x.id JOIN modules y ON e.repo_name = y.repo_name AND to_module_id = y.id
        UNION ALL SELECT e.repo_name, 3, e.id, method || ' ' || path, '  ' || e.id || '{{"' || method || ' ' || path || '"}}' || coalesce(chr(10) || '  ' || f.module_id || ' -.-> ' || e.id, '') FROM endpoints e LEFT JOIN functions f ON e.repo_name = f.repo_name AND handler_function_id = f.id
    ), d AS (SELECT repo_name, string_agg(line, chr(10) ORDER BY s, a, b, line) AS t, bool_or(s = 1) AS filled FROM rows GROUP BY ALL)
    SELECT r.repo_name, CASE WHEN filled THEN 'graph TD' || chr(10) || t ELSE 'graph TD' || chr(10) || '  empty["No modules found for this repository"]' END AS diagram FROM repositories r LEFT JOIN d ON r.repo_name = d.repo_name""",
    "modules",
    "import_edges",
    "endpoints",
    "functions",
    "repositories",
)
def mermaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R3, T-4."""
    rows = graph.diagram_rows(*(view(spark, sf_dir, n) for n in ("modules", "import_edges", "endpoints", "functions")))
    return context.mermaid(rows, view(spark, sf_dir, "repositories"))


@query("""WITH c AS (SELECT source, doc_id, '// ---- ' || doc_id || ' ----' || chr(10) || text AS chunk FROM documents WHERE text IS NOT NULL),
    b AS (SELECT *, coalesce(sum(length(chunk)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
    SELECT source, md5(string_agg(substr(chunk, 1, (24000 - before)::BIGINT), chr(10) || chr(10) ORDER BY doc_id)) AS digest, count(*) AS n_files FROM b WHERE before < 24000 GROUP BY source""")
def raw_context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-3: documents of a source as its files, within the budget."""
    docs = view(spark, sf_dir, "documents").withColumn("path", F.col("doc_id").cast("string"))
    out = context.raw_text(docs, [F.col("doc_id").isNull(), F.col("doc_id")], scope="source")
    return out.select("source", F.md5("context").alias("digest"), "n_files")


_OWN = "SELECT 'all' AS repo_name, concat('n', CAST(n_nationkey AS STRING)) AS id, concat('own/', CAST(n_nationkey AS STRING), '/') AS own_prefix FROM nation WHERE n_nationkey % 4 = 0"
_MOUNTS = """
    SELECT 'all' AS repo_name, concat('n', CAST(n_nationkey AS STRING)) AS id, concat('r', CAST(n_regionkey AS STRING)) AS mounter, concat('/', lower(n_name), '/') AS local_prefix FROM nation
    UNION ALL SELECT 'all', concat('c', CAST(c_custkey AS STRING)), concat('n', CAST(c_nationkey AS STRING)), concat('c/', CAST(c_custkey AS STRING)) FROM customer
    UNION ALL SELECT 'all', concat('r', CAST(r_regionkey AS STRING)), 'root', lower(r_name) FROM region"""


@query(
    f"""WITH RECURSIVE own AS ({_OWN}), mounts AS ({_MOUNTS}), walk AS (
        SELECT id, id AS at, '' AS tail, true AS live FROM (SELECT id FROM own UNION SELECT id FROM mounts)
        UNION ALL
        SELECT w.id, mounter, '/' || array_to_string(list_filter([trim(coalesce(local_prefix, ''), '/'), trim(coalesce(own_prefix, ''), '/'), trim(tail, '/')], lambda p: p <> ''), '/'), mounter IS NOT NULL
        FROM walk w LEFT JOIN own o ON o.id = w.at LEFT JOIN mounts m ON m.id = w.at WHERE w.live
    ) SELECT 'all' AS repo_name, id, tail AS prefix FROM walk WHERE NOT live"""
)
def mount_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitive prefixes."""
    return graph.mount_prefixes(statement(spark, sf_dir, _OWN), statement(spark, sf_dir, _MOUNTS))


@query(
    "SELECT repo_name, (SELECT count(*) FROM modules m WHERE m.repo_name = r.repo_name) AS modules, (SELECT count(*) FROM classes m WHERE m.repo_name = r.repo_name) AS classes, (SELECT count(*) FROM functions m WHERE m.repo_name = r.repo_name) AS functions, (SELECT count(*) FROM endpoints m WHERE m.repo_name = r.repo_name) AS api_endpoints, (SELECT count(*) FROM db_entities m WHERE m.repo_name = r.repo_name) AS database_entities FROM repositories r",
    "repositories",
    "modules",
    "classes",
    "functions",
    "endpoints",
    "db_entities",
)
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1.1: entities of each kind."""
    return graph.entity_counts({n: view(spark, sf_dir, n) for n in ("repositories", "modules", "classes", "functions", "endpoints", "db_entities")})


# --- statistics


@query(
    "SELECT variant, model, count(*) AS n, round(avg(value), 4) AS mean, round(coalesce(stddev_samp(value), 0), 4) AS sd FROM runs WHERE value IS NOT NULL GROUP BY ALL",
    "runs",
)
def cell_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 without its interval, whose quantile SQL lacks (tests compare it with tables)."""
    return statistics.cell_summary(view(spark, sf_dir, "runs"), "value", ["variant", "model"]).select(
        "variant",
        "model",
        "n",
        F.round("mean", 4).alias("mean"),
        F.round("sd", 4).alias("sd"),
    )


@query("SELECT variant, count(*) AS n, round(avg(CASE WHEN tokens > 0 THEN value * 1000 / tokens END), 3) AS efficiency FROM runs GROUP BY ALL", "runs")
def efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A29."""
    return statistics.efficiency(view(spark, sf_dir, "runs"), "value", "tokens").groupBy("variant").agg(
        F.count("*").alias("n"),
        F.round(F.avg("efficiency"), 3).alias("efficiency"),
    )


@query(
    "SELECT 'k' AS category, sum(k)::BIGINT AS total, sum(lost)::BIGINT AS missing, count(*) AS rows, round((sum(k) - sum(lost)) / sum(k)::DOUBLE, 4) AS coverage FROM (SELECT json_extract(props, '$.k')::BIGINT AS k, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END AS lost FROM runs)",
    "runs",
)
def category_json_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3."""
    runs = view(spark, sf_dir, "runs").withColumn("missing", F.when(F.col("event_id") % 3 == 0, '["k: a", "k: b", "other: c"]').otherwise("[]"))
    return statistics.category_coverage(runs, "props", "missing").withColumn("coverage", F.round("coverage", 4))


_PAIRS_SQL = """
    d AS (SELECT x.o_orderpriority AS a, y.o_orderpriority AS b, x.o_custkey, x.v - y.v AS d FROM spending x JOIN spending y ON x.o_custkey = y.o_custkey AND x.o_orderpriority < y.o_orderpriority),
    r AS (SELECT *, rank() OVER (PARTITION BY a, b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY a, b, abs(d)) - 1) / 2.0 AS r FROM d WHERE d <> 0),
    w AS (SELECT a, b, count(*) AS n_nonzero, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus FROM r GROUP BY ALL)"""


def _level_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.level_pairs(view(spark, sf_dir, "spending"), "v", "o_orderpriority", ["o_custkey"], [])


@query(
    f"WITH {_PAIRS_SQL} SELECT d.a, d.b, count(*) AS n_pairs, round(avg(d), 2) AS mean_diff, any_value(n_nonzero) AS n_nonzero, any_value(w_plus)::DOUBLE AS w_plus, any_value(w_minus)::DOUBLE AS w_minus, round(any_value((w_plus - w_minus) / (w_plus + w_minus))::DOUBLE, 6) AS rank_biserial FROM d LEFT JOIN w ON d.a = w.a AND d.b = w.b GROUP BY ALL",
    "spending",
)
def level_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of levels: differences, signed ranks, rank-biserial."""
    return statistics.signed_ranks(_level_pairs(spark, sf_dir), ["a", "b"]).select(
        "a",
        "b",
        "n_pairs",
        F.round("mean_diff", 2).alias("mean_diff"),
        "n_nonzero",
        "w_plus",
        "w_minus",
        F.round("rank_biserial", 6).alias("rank_biserial"),
    )


@query(None)
def paired_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with signed-rank p and Holm's correction (p has no SQL form)."""
    return statistics.holm(statistics.paired_tests(_level_pairs(spark, sf_dir), ["a", "b"]))


@query("""WITH t AS (SELECT p_brand, avg(p_size) / 1000 AS p_value FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY p_value, p_brand) AS i, count(*) OVER () AS m FROM t)
    SELECT p_brand, round(max(least((m - i + 1) * p_value, 1)) OVER (ORDER BY p_value, p_brand ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM r""")
def holm_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15."""
    tests = view(spark, sf_dir, "part").groupBy("p_brand").agg((F.avg("p_size") / 1000).alias("p_value"))
    return statistics.holm(tests).select("p_brand", F.round("p_holm", 6).alias("p_holm"))


_RANKS = "rank() OVER (PARTITION BY l_returnflag ORDER BY {0}) + (count(*) OVER (PARTITION BY l_returnflag, {0}) - 1) / 2.0"


@query(f"SELECT l_returnflag, count(*) AS n, round(corr(x, y), 5) AS rho FROM (SELECT l_returnflag, {_RANKS.format('l_quantity')} AS x, {_RANKS.format('l_discount')} AS y FROM lineitem) GROUP BY ALL")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20."""
    return statistics.spearman(view(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", ["l_returnflag"]).select("l_returnflag", "n", F.round("rho", 5).alias("rho"))


@query("""WITH p AS (SELECT p_brand, p_partkey, p_size, p_retailprice FROM part), c AS (
        SELECT x.p_brand, sum(sign(x.p_size - y.p_size) * sign(x.p_retailprice - y.p_retailprice)) AS s, count(*) FILTER (x.p_size <> y.p_size) AS nx, count(*) FILTER (x.p_retailprice <> y.p_retailprice) AS ny
        FROM p x JOIN p y ON x.p_brand = y.p_brand AND x.p_partkey < y.p_partkey GROUP BY ALL)
    SELECT p_brand, round(CASE WHEN nx > 0 AND ny > 0 THEN s / (sqrt(nx) * sqrt(ny)) END, 6) AS tau FROM c""")
def kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20."""
    return statistics.kendall(view(spark, sf_dir, "part"), "p_size", "p_retailprice", "p_partkey", ["p_brand"]).select("p_brand", F.round("tau", 6).alias("tau"))


@query("""WITH r AS (SELECT event_type, user_id % 2 = 0 AS f, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS r FROM events)
    SELECT event_type, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2, round((sum(r) FILTER (f) - count(*) FILTER (f) * (count(*) FILTER (f) + 1) / 2.0)::DOUBLE, 1) AS u FROM r GROUP BY ALL""")
def mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21 (its p is compared in tests)."""
    return statistics.mann_whitney(
        view(spark, sf_dir, "events"),
        "value",
        F.col("user_id") % 2 == 0,
        ["event_type"],
    ).select("event_type", "n1", "n2", F.round("u", 1).alias("u"))


@query("""WITH b AS (SELECT DISTINCT n_name, p_brand, p_size % 2 AS odd FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
    j AS (SELECT coalesce(a.n_name, e.n_name) AS n_name, a.p_brand AS x, e.p_brand AS y FROM (SELECT * FROM b WHERE odd = 1) a FULL JOIN (SELECT * FROM b WHERE odd = 0) e ON a.n_name = e.n_name AND a.p_brand = e.p_brand)
    SELECT n_name, count(x) AS n_actual, count(y) AS n_expected, count(*) FILTER (x = y) AS n_common, round(2 * count(*) FILTER (x = y) / (count(x) + count(y))::DOUBLE, 6) AS f1, coalesce(string_agg(y, ',' ORDER BY y) FILTER (x IS NULL), '') AS missing FROM j GROUP BY ALL""")
def graph_diff_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets a nation, of brands of odd and even sizes."""
    v = lambda n: view(spark, sf_dir, n)
    base = v("lineitem").join(v("part"), F.col("l_partkey") == F.col("p_partkey")).join(v("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(v("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", F.col("p_brand").alias("item"), "p_size")
    out = statistics.graph_diff(base.filter("p_size % 2 = 1"), base.filter("p_size % 2 = 0"), ["n_name"])
    return out.select("n_name", "n_actual", "n_expected", "n_common", F.round("f1", 6).alias("f1"), F.array_join("missing", ",").alias("missing"))


@query("""WITH c AS (SELECT count(*) FILTER (t AND s) AS tp, count(*) FILTER (t AND NOT s) AS fn, count(*) FILTER (NOT t AND s) AS fp, count(*) FILTER (NOT t AND NOT s) AS tn FROM (SELECT quality = 1 AS t, n_chars > 1000 AS s FROM labels JOIN documents USING (doc_id)))
    SELECT tp, fn, fp, tn, round(tp / (tp + fn)::DOUBLE, 6) AS sensitivity, round(tn / (tn + fp)::DOUBLE, 6) AS specificity FROM c""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels against a rule on length."""
    rows = view(spark, sf_dir, "labels").join(view(spark, sf_dir, "documents"), "doc_id")
    return statistics.confusion(rows, F.col("quality") == 1, F.col("n_chars") > 1000).select(
        "tp",
        "fn",
        "fp",
        "tn",
        F.round("sensitivity", 6).alias("sensitivity"),
        F.round("specificity", 6).alias("specificity"),
    )


_LEVELS = ["signup", "error", "click", "view", "purchase"]


@query(f"SELECT model, {', '.join(f"round(avg(value) FILTER (variant = '{v}'), 4) AS {v}" for v in _LEVELS)} FROM runs GROUP BY ALL", "runs")
def pivot_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16."""
    out = statistics.pivot_means(view(spark, sf_dir, "runs"), "model", "variant", _LEVELS, "value")
    return out.select("model", *(F.round(v, 4).alias(v) for v in _LEVELS))


@query("SELECT floor(p_size / 3)::BIGINT AS bin, count(*) AS n, floor(p_size / 3)::BIGINT * 3 AS low FROM part GROUP BY ALL")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17."""
    return statistics.histogram(view(spark, sf_dir, "part"), "p_size", 3)


@query(
    "WITH m AS (SELECT model, variant, avg(value) AS m, count(*) AS n FROM runs GROUP BY ALL) SELECT model, variant, round(m, 4) AS mean, n, m = max(m) OVER (PARTITION BY model) AS best FROM m",
    "runs",
)
def best_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18."""
    return statistics.best_levels(view(spark, sf_dir, "runs"), "variant", "value", ["model"]).withColumn("mean", F.round("mean", 4))


@query("SELECT l_returnflag, count(*) AS n, count(DISTINCT l_discount) AS distinct_scores, round(avg((l_discount = 1.0)::INT), 6) AS share_at_one, count(DISTINCT l_discount) > 15 AND avg((l_discount = 1.0)::INT) < 0.6 AS accepted FROM lineitem GROUP BY ALL")
def judge_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23."""
    return statistics.judge_acceptance(view(spark, sf_dir, "lineitem"), "l_discount", ["l_returnflag"]).withColumn("share_at_one", F.round("share_at_one", 6))


def _hash_tree_sql(resamples: int, seed: int) -> str:
    """CTEs `groups` to `drawn` (g, b, pos, w): how often each place of `placed` (g, pos) is drawn in each resample."""
    full = (1 << 32) - 1
    steps = [f"(xor(v, v >> {shift}) * {times}) & {full}" if times else f"xor(v, v >> {shift})" for shift, times in resampling.MIX]

    def mixed(x: str) -> str:
        for step in steps:
            x = f"list_transform({x}, lambda v: {step})"
        return x

    key = mixed(f"[(b + {seed * resampling.STRIDE % (1 << 32)})::UBIGINT & {full}]")
    for part in ("low", "0", "size", "0"):
        key = mixed(f"list_transform({key}, lambda v: xor(v, {part}::UBIGINT))")
    words = lambda n: mixed(f"list_transform(range(0, {n}), lambda k: (key + k * {resampling.STRIDE})::UBIGINT & {full})")
    even = f"list_sum(list_transform({words('(draws + 31) // 32')}, lambda v, i: bit_count(v & ((1::UBIGINT << least(32, draws - 32 * (i - 1))) - 1))))"
    uneven = f"list_sum(list_transform({words('draws')}, lambda v: ((v * size::UBIGINT) >> 32 < half::UBIGINT)::INT))"
    return f"""groups AS (SELECT g, count(*) AS n FROM placed GROUP BY g),
    tree AS (
        SELECT g, b, 0::BIGINT AS low, n AS size, n AS draws FROM groups, range(0, {resamples}) t(b)
        UNION ALL
        SELECT g, b, low + CASE WHEN right_side THEN half ELSE 0 END, CASE WHEN right_side THEN size - half ELSE half END, CASE WHEN right_side THEN draws - gone ELSE gone END
        FROM (SELECT *, (CASE WHEN 2 * half = size THEN {even} ELSE {uneven} END)::BIGINT AS gone
              FROM (SELECT g, b, low, size, draws, (1 << floor(log2(size - 1))::INT)::BIGINT AS half, ({key})[1]::BIGINT AS key FROM tree WHERE size > 1 AND draws > 0)),
             (VALUES (false), (true)) sides(right_side)
    ), drawn AS (SELECT g, b, low AS pos, draws AS w FROM tree WHERE size = 1 AND draws > 0)"""


@query(f"""WITH RECURSIVE placed AS (SELECT s_nationkey AS g, s_acctbal AS v, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) - 1 AS pos FROM supplier),
    {_hash_tree_sql(10_000, 42)},
    means AS (SELECT d.g, b, sum(w * v) / sum(w) AS m FROM drawn d JOIN placed p ON d.g = p.g AND d.pos = p.pos GROUP BY d.g, b)
    SELECT s_nationkey, mean, n, ci_low, ci_high FROM (SELECT g AS s_nationkey, round(avg(v), 6) AS mean, count(*) AS n FROM placed GROUP BY g)
    JOIN (SELECT g, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM means GROUP BY g) ON g = s_nationkey""")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean, 10,000 resamples."""
    out = resampling.bootstrap_mean(view(spark, sf_dir, "supplier"), "s_acctbal", ["s_nationkey"], 10_000)
    return out.select("s_nationkey", "n", *(F.round(c, 6).alias(c) for c in ("mean", "ci_low", "ci_high")))


_PLACED_RANKS = "sum(w) OVER (PARTITION BY g, b ORDER BY {0}) - (sum(w) OVER (PARTITION BY g, b, {0}) - 1) / 2.0"


@query(f"""WITH RECURSIVE placed AS (SELECT s_nationkey AS g, s_suppkey AS x, s_acctbal AS y, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey, s_acctbal) - 1 AS pos FROM supplier),
    {_hash_tree_sql(4000, 7)},
    resampled AS (SELECT d.g, b, w, x, y FROM drawn d JOIN placed p ON d.g = p.g AND d.pos = p.pos UNION ALL SELECT g, -1, 1, x, y FROM placed),
    ranked AS (SELECT g, b, w, {_PLACED_RANKS.format("x")} AS rx, {_PLACED_RANKS.format("y")} AS ry FROM resampled),
    parts AS (SELECT g, b, sum(w) * sum(w * rx * ry) - sum(w * rx) * sum(w * ry) AS xy, sum(w) * sum(w * rx * rx) - sum(w * rx) ** 2 AS xx, sum(w) * sum(w * ry * ry) - sum(w * ry) ** 2 AS yy FROM ranked GROUP BY g, b),
    scored AS (SELECT g, b, CASE WHEN xx > 0 AND yy > 0 THEN xy / (sqrt(xx) * sqrt(yy)) END AS rho FROM parts)
    SELECT s_nationkey, n, rho, ci_low, ci_high, n_resamples FROM (SELECT g AS s_nationkey, count(*) AS n FROM placed GROUP BY g)
    JOIN (SELECT g, round(max(rho) FILTER (b = -1), 6) AS rho, round(quantile_cont(rho, 0.025) FILTER (b >= 0), 6) AS ci_low, round(quantile_cont(rho, 0.975) FILTER (b >= 0), 6) AS ci_high,
          count(rho) FILTER (b >= 0) AS n_resamples FROM scored GROUP BY g) ON g = s_nationkey""")
def bootstrap_rho(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spearman's rho, 4,000 resamples."""
    out = resampling.bootstrap_spearman(view(spark, sf_dir, "supplier"), "s_suppkey", "s_acctbal", ["s_nationkey"])
    return out.select("s_nationkey", "n", "n_resamples", *(F.round(c, 6).alias(c) for c in ("rho", "ci_low", "ci_high")))


# --- judges, overlap, ground truth


@query(
    """WITH d AS (SELECT repo_name, count(*) AS n, string_agg(name, ', ' ORDER BY pos) FILTER (i <= 3) AS t FROM (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY pos) AS i FROM external_deps) GROUP BY ALL),
    m AS (SELECT repo_name, count(*) AS n FROM modules GROUP BY ALL)
    SELECT r.repo_name, concat_ws(chr(10), 'Detected framework: ' || detected_framework || ' (version ' || framework_version || ')', 'Detected language: ' || detected_language,
        'Counts: ' || coalesce(m.n, 0) || ' modules, 1 classes, 0 functions, 2 endpoints, 0 database entities',
        'External dependencies: ' || coalesce(d.t || CASE WHEN d.n > 3 THEN ' (+' || (d.n - 3) || ' more)' ELSE '' END, '(none)'),
        'API endpoints: GET /orders/:id, POST /orders/{id}/items', 'Classes: OrderService', 'Config files: package.json', 'Database entities: (none)') AS truth
    FROM repositories r LEFT JOIN d ON r.repo_name = d.repo_name LEFT JOIN m ON r.repo_name = m.repo_name""",
    "repositories",
    "external_deps",
    "modules",
)
def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-5, with lists capped at three names."""
    v = lambda n: view(spark, sf_dir, n)
    names = lambda t, c, to: t.groupBy("repo_name").agg(F.sort_array(F.collect_list(F.struct("pos", F.col(c).alias("x"))))["x"].alias(to))
    routes = v("routes").withColumn("x", F.concat_ws(" ", "method", "path"))
    rows = v("repositories").select("repo_name", F.col("detected_framework").alias("framework"), "framework_version", F.col("detected_language").alias("language"))
    for part in (
        names(v("external_deps"), "name", "dependencies"),
        names(routes, "x", "endpoints"),
        names(v("services"), "name", "classes"),
        v("config_files").groupBy("repo_name").agg(F.collect_list("path").alias("configs")),
    ):
        rows = rows.join(part, "repo_name", "left")
    rows = rows.withColumn("entities", F.array().cast("array<string>"))
    none = v("modules").limit(0)
    counts = graph.entity_counts({
        "repositories": v("repositories"),
        "modules": v("modules"),
        "classes": v("services"),
        "functions": none,
        "endpoints": v("routes"),
        "db_entities": none,
    })
    return context.ground_truth(rows, counts.withColumnRenamed("classes", "classes_n"), most=3)


@query("""WITH t AS (SELECT event_id, 0.5 + (event_id % 40) / 100.0 AS p4, CASE WHEN event_id % 3 = 0 THEN 0.05 END AS p5, event_id % 4 = 1 AS unweighted, event_id % 5 + 1 AS digit FROM events)
    SELECT CASE WHEN NOT unweighted THEN 'logprob_weighted' WHEN event_id % 8 = 1 THEN 'sample_averaged' ELSE 'unparsed' END AS method, count(*) AS n,
           round(avg(CASE WHEN NOT unweighted THEN (4 * p4 + 5 * coalesce(p5, 0)) / (p4 + coalesce(p5, 0)) WHEN event_id % 8 = 1 THEN digit ELSE 0 END), 6) AS score FROM t GROUP BY ALL""")
def criterion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected digits by token probabilities, else sampled answers."""
    from ..operators import judge

    i = F.col("event_id")
    alt = lambda t, p: F.struct(F.lit(t).alias("token"), F.log(p).alias("logprob"))
    p4 = 0.5 + (i % 40) / 100.0
    top = F.when(i % 3 == 0, F.array(alt("4", p4), alt("5", F.lit(0.05)), alt("x", F.lit(0.2)))).otherwise(F.array(alt("x", F.lit(0.2))))
    tokens = F.when(i % 4 != 1, F.array(F.struct(F.lit(" 4 ").alias("token"), F.log(p4).alias("logprob"), top.alias("top"))))
    samples = F.when(i % 8 == 1, F.array(F.concat(F.lit("Score: "), (i % 5 + 1).cast("string")), F.lit("no digit"))).otherwise(F.array(F.lit("?")))
    rows = view(spark, sf_dir, "events").select(tokens.alias("tokens"), samples.alias("samples"))
    return judge.criterion_score(rows).groupBy("method").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("score"))


def _platt_sql(steps: int = 14) -> str:
    """Newton's steps from (0, 0), written out: CTEs fit0 to fit<steps> over `samples` (lang, s, y)."""
    out = ["fit0 AS (SELECT lang, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM samples GROUP BY lang)"]
    for k in range(steps):
        out.append(f"""sums{k} AS (SELECT lang, any_value(a) AS a, any_value(b) AS b, sum(s * (m - 1 + y)) AS ga, sum(m - 1 + y) AS gb, sum(s * s * m * (1 - m)) AS haa, sum(s * m * (1 - m)) AS hab, sum(m * (1 - m)) AS hbb
            FROM (SELECT x.lang, s, y, a, b, 1 / (1 + exp(-(a * s + b))) AS m FROM samples x JOIN fit{k} f ON x.lang = f.lang) GROUP BY lang)""")
        out.append(f"fit{k + 1} AS (SELECT lang, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM sums{k})")
    return ", ".join(out)


@query(f"""WITH samples AS (SELECT lang, n_chars / (n_chars + 2000.0)::DOUBLE AS s, quality AS y FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND n_chars IS NOT NULL),
    {_platt_sql()},
    able AS (SELECT lang FROM samples GROUP BY lang HAVING count(*) >= 4 AND min(y) = 0 AND max(y) = 1),
    scored AS (SELECT x.lang, CASE WHEN t.lang IS NOT NULL THEN a END AS a, CASE WHEN t.lang IS NOT NULL THEN b END AS b, y, CASE WHEN t.lang IS NOT NULL THEN 1 / (1 + exp(a * s + b)) ELSE s END AS p
               FROM samples x JOIN fit14 f ON x.lang = f.lang LEFT JOIN able t ON x.lang = t.lang),
    binned AS (SELECT lang, a, b, least(floor(p * 5), 4) AS bin, sum(p) AS ps, sum(y) AS ys, sum((p - y) ** 2) AS sq, count(*) AS n FROM scored GROUP BY ALL)
    SELECT lang, round(a, 4) AS a, round(b, 4) AS b, sum(n)::BIGINT AS n, round(sum(sq) / sum(n), 6) AS brier, round(sum(abs(ps - ys)) / sum(n), 6) AS ece, round(sum(ys) / sum(n), 6) AS base_rate,
           round(1 - (sum(sq) / sum(n)) / nullif((sum(ys) / sum(n)) * (1 - sum(ys) / sum(n)), 0), 6) AS skill FROM binned GROUP BY lang, a, b""")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether longer documents are better ones, as a confidence by language."""
    from ..operators import judge

    rows = view(spark, sf_dir, "labels").join(view(spark, sf_dir, "documents"), "doc_id")
    out = judge.calibration(rows.select("lang", (F.col("n_chars") / (F.col("n_chars") + 2000)).alias("confidence"), F.col("quality").alias("correct")), ["lang"])
    return out.select("lang", "n", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), *(F.round(c, 6).alias(c) for c in ("brier", "ece", "base_rate", "skill")))


def _turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, text, reference): each turn of a conversation and the one before."""
    turns = view(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    return turns.join(before, ["conv_id", "turn"])


@query(None)
def text_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against the one before. Stems are more than SQL can follow; tests compare all three scores."""
    return overlap.overlap_scores(_turn_pairs(spark, sf_dir), ["conv_id", "turn"], "text", "reference")


_WORDS_SQL = r"list_filter(string_split_regex({0}, '[\s\p{{Z}}\x{{1c}}-\x{{1f}}\x{{85}}]+'), lambda w: w <> '')"


@query(f"""WITH turns AS (SELECT conv_id, turn, min(text) AS t FROM conversations GROUP BY ALL),
    sides AS (SELECT a.conv_id, a.turn, {_WORDS_SQL.format("a.t")} AS h, {_WORDS_SQL.format("b.t")} AS r FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 WHERE a.t IS NOT NULL AND b.t IS NOT NULL),
    grams AS (
        SELECT conv_id, turn, n, array_to_string(h[i:i + n - 1], ' ') AS g, 1 AS a, 0 AS b FROM (SELECT *, unnest(range(1, len(h) - n + 2)) AS i FROM sides, range(1, 5) t(n))
        UNION ALL SELECT conv_id, turn, n, array_to_string(r[i:i + n - 1], ' '), 0, 1 FROM (SELECT *, unnest(range(1, len(r) - n + 2)) AS i FROM sides, range(1, 5) t(n))
    ), counted AS (SELECT conv_id, turn, n, g, sum(a) AS a, sum(b) AS b FROM grams GROUP BY ALL),
    hits AS (SELECT conv_id, turn, n, sum(least(a, b)) AS hits, sum(a) AS total FROM counted GROUP BY ALL),
    every AS (SELECT s.conv_id, s.turn, n, len(h) AS nh, len(r) AS nr, coalesce(hits, 0) AS hits, greatest(coalesce(total, 0), 1) AS total FROM sides s CROSS JOIN range(1, 5) t(n) LEFT JOIN hits x USING (conv_id, turn, n)),
    graded AS (SELECT *, sum((hits = 0)::INT) OVER (PARTITION BY conv_id, turn ORDER BY n) AS missed, max(CASE WHEN n = 1 THEN hits END) OVER (PARTITION BY conv_id, turn) AS first FROM every),
    logs AS (SELECT *, CASE WHEN hits > 0 THEN ln(hits / total::DOUBLE) WHEN nh > 1 THEN ln(1 / (2.0 ** missed * 5 / ln(nh)) / total) ELSE 0 END / 4 AS part FROM graded),
    nth AS (SELECT conv_id, turn, i, lower(h[i]) AS w, row_number() OVER (PARTITION BY conv_id, turn, lower(h[i]) ORDER BY i DESC) AS k FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM sides)),
    nth_r AS (SELECT conv_id, turn, i, lower(r[i]) AS w, row_number() OVER (PARTITION BY conv_id, turn, lower(r[i]) ORDER BY i DESC) AS k FROM (SELECT *, unnest(range(1, len(r) + 1)) AS i FROM sides)),
    pairs AS (SELECT a.conv_id, a.turn, a.i, b.i AS j FROM nth a JOIN nth_r b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.w = b.w AND a.k = b.k),
    chunks AS (SELECT conv_id, turn, count(*) AS matched, count(*) FILTER (NOT coalesce(i = pi + 1 AND j = pj + 1, false)) AS chunks FROM (SELECT *, lag(i) OVER o AS pi, lag(j) OVER o AS pj FROM pairs WINDOW o AS (PARTITION BY conv_id, turn ORDER BY i)) GROUP BY ALL)
    SELECT l.conv_id, l.turn, sum(hits)::BIGINT AS hits, round(CASE WHEN any_value(first) > 0 THEN CASE WHEN any_value(nh) > any_value(nr) THEN 1 ELSE exp(1 - any_value(nr) / any_value(nh)::DOUBLE) END * exp(sum(part)) ELSE 0 END, 6) AS bleu4,
           coalesce(any_value(c.matched), 0) AS matched, coalesce(any_value(c.chunks), 0) AS chunks
    FROM logs l LEFT JOIN chunks c USING (conv_id, turn) GROUP BY l.conv_id, l.turn""")
def overlap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLEU-4 with its hits, and the matches and chunks of METEOR's exact stage."""
    keys = ["conv_id", "turn"]
    both = _turn_pairs(spark, sf_dir).filter("text IS NOT NULL AND reference IS NOT NULL")
    words = both.select(*keys, overlap.words(F.col("text")).alias("h"), overlap.words(F.col("reference")).alias("r"))
    lowered = [F.transform(c, lambda w: F.lower(w)) for c in ("h", "r")]
    found = words.select(
        *keys,
        F.size("h").alias("nh"),
        F.size("r").alias("nr"),
        overlap.clipped_counts(F.col("h"), F.col("r")).alias("hits"),
        overlap.chunk_counts(overlap.alignment(*lowered)["pairs"]).alias("m"),
    )
    total = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(*keys, F.round(overlap.bleu_score(F.col("hits"), F.col("nh"), F.col("nr")), 6).alias("bleu4"), total.alias("hits"), "m.matched", "m.chunks")
