"""Checkable facts, their matching against summaries at two tiers, identifier candidates, verdict parsing and failure tags."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import camel_words, canonical, category, json_object, position_reference, route_pattern, value
from ..functions.text import mentions as _mentions
from ..sources.staging import written
from .containment import holding, lying_in
from .statistics import hash_sample

#: Facts of each category that count, at most.
MOST = 40

# Generic words that are no evidence of a specific claim.
STOPLIST = """
api apis http https json xml yaml yml html css url urls uri rest restful crud sql nosql orm jwt auth oauth cors csrf xss
ssl tls tcp ip dns cdn cli sdk ide ci cd cicd mvc dto dtos acl rbac uuid id ids get post put patch delete head options
readme license dockerfile docker kubernetes k8s node nodejs npm yarn pnpm javascript typescript js ts python java go rust
database db server client backend frontend middleware controller controllers service services module modules repository
repositories model models schema schemas entity entities config configuration env environment test tests testing spec
build dist src lib app apps main index utils util helpers helper types interfaces interface class classes function
functions method methods endpoint endpoints route routes router routers request response error errors exception logger
logging user users admin login logout register password token tokens session sessions cache queue worker project
application package dependency dependencies library framework structure architecture documentation overview summary
""".split()

# Shapes of identifiers in prose.
CANDIDATES = [
    ("backticked", r"`([^`\n]{2,60})`"),
    ("path", r"(?<![A-Za-z0-9_])(/[A-Za-z0-9_\-{}:./]{2,60})"),
    ("scoped_pkg", r"(?<![A-Za-z0-9_])(@[A-Za-z0-9_\-]+/[A-Za-z0-9_\-.]+)"),
    ("file", r"(?<![A-Za-z0-9_])([A-Za-z0-9_\-]+\.(?:ts|js|tsx|jsx|json|yml|yaml))"),
    ("pascal", r"(?<![A-Za-z0-9_])((?:[A-Z][a-z0-9]+){2,})(?![A-Za-z0-9_])"),
]

# Verbs that make a claim one about an endpoint.
VERBS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"]

# What an unmatched item is by, quotes and blanks around it aside: a bare position, or a mark of a fact.
POSITION, FACT_MARK = r"^\d+[.)]*$", "[:/]"

# Tags of missing facts by category.
MISSED = {
    "Endpoint": "missed_endpoint",
    "Dependency": "missed_dependency",
    "Framework": "missed_framework_or_language",
    "Language": "missed_framework_or_language",
    "Class/Service": "missed_class_or_service",
    "Database entity": "missed_database_entity",
}


def coverable_facts(
    repos: DataFrame,
    deps: DataFrame,
    endpoints: DataFrame,
    classes: DataFrame,
    entities: DataFrame,
    scope: str = "repo_name",
    most: int = MOST,
) -> DataFrame:
    """(scope, section, pos, fact): framework, language, then up to `most` of each category in source order, repeats kept.
    deps, classes and entities have (scope, name, pos); endpoints (scope, method, path, pos)."""
    framework = F.concat_ws(" ", F.concat(F.lit("Framework: "), F.col("detected_framework")), F.when(F.col("framework_version") != "", F.col("framework_version")))
    head = repos.select(
        scope,
        F.posexplode(F.array(
            F.when(F.col("detected_framework") != "", framework),
            F.when(F.col("detected_language") != "", F.concat(F.lit("Language: "), F.col("detected_language"))),
        )).alias("section", "fact"),
    ).filter("fact is not null").select(scope, F.col("section").cast("int"), F.lit(1).alias("pos"), "fact")
    parts = [
        (deps, F.concat(F.lit("Dependency: "), F.col("name"))),
        (endpoints, F.concat(F.lit("Endpoint: "), F.col("method"), F.lit(" "), F.col("path"))),
        (classes, F.concat(F.lit("Class/Service: "), F.col("name"))),
        (entities, F.concat(F.lit("Database entity: "), F.col("name"))),
    ]
    out = head
    for k, (table, fact) in enumerate(parts):
        w = Window.partitionBy(scope).orderBy("pos", fact)
        out = out.unionByName(table.select(scope, F.lit(k + 2).alias("section"), F.row_number().over(w).alias("pos"), fact.alias("fact")).filter(F.col("pos") <= most))
    return out


def fact_counts(facts: DataFrame, scope: str = "repo_name") -> DataFrame:
    return facts.groupBy(scope, category(F.col("fact")).alias("category")).agg(F.count("*").alias("n"))


def match_facts(facts: DataFrame, summaries: DataFrame, scope: str = "repo_name", text: str = "summary_text") -> DataFrame:
    """Every fact of a summary's repository with category, rule (null: not mentioned), strict and lenient.

    An equi-join by repository, then one pattern per row; a null summary mentions nothing. Rules go from exact forms to
    lenient ones, and the first that holds counts.
    """
    f = facts.select(scope, *[c for c in facts.columns if c != scope], F.trim(category(F.col("fact"))).alias("category"), value(F.col("fact")).alias("_v"))
    read = summaries.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumn("_low", F.lower("_t"))
    rows = read.join(f, scope)
    t, v = F.col("_t"), F.col("_v")
    mentions = partial(_mentions, low=F.col("_low"))
    name = F.element_at(F.split(v, r"\s+"), 1)
    scoped = F.startswith(v, F.lit("@")) & F.contains(v, F.lit("/"))
    bare = F.substring(v, F.lit(2), F.length(v))
    owner, sub = F.substring_index(bare, "/", 1), F.regexp_replace(bare, "^[^/]*/", "")
    abbreviated = F.when(F.lower(v) == "typescript", mentions(t, F.lit("ts"))).when(F.lower(v) == "javascript", mentions(t, F.lit("js"))).otherwise(False)
    method, path = F.regexp_extract(v, r"(?s)^(\S+)\s+(.+)$", 1), F.regexp_extract(v, r"(?s)^(\S+)\s+(.+)$", 2)
    at = F.regexp_instr(t, route_pattern(path))
    before = F.substring(t, F.greatest(at - 24, F.lit(1)), F.least(at - 1, F.lit(24)))
    words = camel_words(v)
    of = F.col("category")
    rule = (
        F.when(of == "Framework", F.when(mentions(t, name), "framework_name"))
        .when(of == "Language", F.when(mentions(t, v), "language_exact").when(abbreviated, "language_abbrev"))
        .when(
            of == "Dependency",
            F.when(mentions(t, v), "dep_exact").when(scoped & mentions(t, bare), "dep_unprefixed_scope").when(
                scoped & mentions(t, owner) & mentions(t, sub),
                "dep_scope_and_sub",
            ),
        )
        .when(of == "Endpoint", F.when((path != "") & (at > 0), F.when((at > 1) & _mentions(before, method), "endpoint_method_path").otherwise("endpoint_path_only")))
        .when(
            of == "Class/Service",
            F.when(mentions(t, v, any_case=False), "class_exact_cs").when(mentions(t, v), "class_exact_ci").when(
                (words != F.lower(v)) & mentions(t, words),
                "class_camel_split",
            ),
        )
        .when(
            of == "Database entity",
            F.when(mentions(t, v, any_case=False), "entity_exact_cs").when(mentions(t, F.concat(v, F.lit("s")), any_case=False), "entity_plural_cs"),
        )
    )
    strict = F.col("rule").isin("framework_name", "language_exact", "dep_exact", "dep_unprefixed_scope", "endpoint_method_path", "class_exact_cs", "entity_exact_cs")
    return rows.withColumn("rule", rule).withColumn("lenient", F.col("rule").isNotNull()).withColumn("strict", F.coalesce(strict, F.lit(False))).drop("_t", "_v", "_low")


def coverage(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Facts covered at both tiers for each key."""
    return matches.groupBy(*keys).agg(
        F.count("*").alias("total_facts"),
        F.count_if("strict").alias("covered_strict"),
        F.count_if("lenient").alias("covered_lenient"),
        F.avg(F.col("strict").cast("int")).alias("coverage_strict"),
        F.avg(F.col("lenient").cast("int")).alias("coverage_lenient"),
        F.array_sort(F.collect_list(F.when(~F.col("strict"), F.col("fact")))).alias("missing_strict"),
        F.array_sort(F.collect_list(F.when(~F.col("lenient"), F.col("fact")))).alias("missing_lenient"),
    )


def with_empty(scores: DataFrame, summaries: DataFrame, keys: list[str]) -> DataFrame:
    """coverage() for every summary: one without facts is covered in full."""
    return summaries.select(*keys).join(scores, keys, "left").fillna(0, ["total_facts", "covered_strict", "covered_lenient"]).fillna(1.0, ["coverage_strict", "coverage_lenient"])


def identifier_candidates(summaries: DataFrame, keys: list[str], text: str = "summary_text") -> DataFrame:
    """(keys, kind, candidate): specific-looking identifiers, the first of each in any case, generic words left out."""
    def of_kind(k: int, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(k).alias("kind"), x.alias("raw")))

    found = F.concat(*(of_kind(k, p) for k, (_, p) in enumerate(CANDIDATES)))
    rows = summaries.filter(F.col(text).isNotNull()).select(*keys, F.posexplode(found).alias("pos", "x")).select(
        *keys,
        "pos",
        F.col("x.kind").alias("kind"),
        F.regexp_replace(F.regexp_replace(F.trim(F.col("x.raw")), "^[`'\"]+|[`'\"]+$", ""), "[.,;:)]+$", "").alias("candidate"),
    )
    low = F.lower("candidate")
    stem = F.regexp_replace(low, r"\.(ts|js|tsx|jsx|json|yml|yaml)$", "")
    generic = low.isin(STOPLIST) | stem.isin(STOPLIST) | F.rlike(F.col("candidate"), F.lit(r"^[A-Z][a-z]+\.(js|ts)$"))
    rows = rows.filter((F.length("candidate") >= 2) & ~generic)
    first = rows.groupBy(*keys, low.alias("_low")).agg(F.min_by(F.struct("kind", "candidate", "pos"), "pos").alias("x"))
    names = F.array(*(F.lit(n) for n, _ in CANDIDATES))
    return first.select(*keys, F.element_at(names, F.col("x.kind") + 1).alias("kind"), "x.candidate", "x.pos")


def known_identifiers(tables: dict[str, DataFrame], scope: str = "repo_name") -> DataFrame:
    """(scope, known): names, paths, base names, stems, ids and scope parts of a repository, in lower case, with and
    without a leading @."""
    def some(table: str, *cols: Column) -> DataFrame:
        return tables[table].select(scope, F.explode(F.array(*cols)).alias("known"))

    base = F.element_at(F.split("path", "/"), -1)
    bare = F.substring("name", 2, 1_000_000)
    scoped = F.startswith("name", F.lit("@")) & F.contains("name", F.lit("/"))
    parts = [
        some("repositories", F.col(scope), F.col("detected_framework"), F.col("detected_language")),
        some("modules", F.col("path"), base, F.regexp_replace(base, r"\.[^.]*$", ""), F.col("id")),
        some("classes", F.col("name"), camel_words(F.col("name"))),
        some("functions", F.col("name")),
        some("endpoints", F.col("path"), F.regexp_replace("path", "/+$", "")),
        some("db_entities", F.col("name"), F.col("source_path")),
        some("external_deps", F.col("name"), F.when(scoped, F.substring_index(bare, "/", 1)), F.when(scoped, F.regexp_replace(bare, "^[^/]*/", ""))),
        some("config_files", F.col("path"), base),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    low = F.lower("known")
    return out.filter("known is not null and known <> ''").select(
        scope,
        F.explode(F.array(low, F.regexp_replace(low, "^@+", ""))).alias("known"),
    ).filter("known <> ''").distinct()


def unsupported(candidates: DataFrame, known: DataFrame, scope: str = "repo_name") -> DataFrame:
    """candidates with `supported`: equal to a known identifier (also without @), or one of more than three characters
    contains it or lies in it. Each form is judged once a repository, however many summaries have it. Equality is an
    equi-join; what it leaves is looked up by its rarest n-gram among the names, and names by theirs among what is still
    open, so no join is on the repository alone."""
    low = F.lower("candidate")
    names = written(known.select(scope, F.col("known").alias("_name")).distinct(), "names")
    forms = written(candidates.select(scope, low.alias("_low")).distinct(), "forms").withColumn("_bare", F.regexp_replace("_low", "^@+", ""))
    hit = lambda c: forms.join(names.withColumnRenamed("_name", c), [scope, c], "left_semi").select(scope, "_low")
    sure = hit("_low").unionByName(hit("_bare")).distinct()
    long = names.filter(F.length("_name") > 3)
    left = written(forms.join(sure, [scope, "_low"], "left_anti").select(scope, F.col("_low").alias("s")), "open")
    within = lying_in(left, long.withColumnRenamed("_name", "t"), [scope])
    around = holding(left.withColumnRenamed("s", "t"), long.withColumnRenamed("_name", "s"), [scope], 4)
    some = sure.unionByName(within.withColumnRenamed("s", "_low")).unionByName(around.withColumnRenamed("t", "_low"))
    some = some.distinct().withColumn("supported", F.lit(True))
    return candidates.withColumn("_low", low).join(some, [scope, "_low"], "left").select(*candidates.columns, F.coalesce("supported", F.lit(False)).alias("supported"))


def unsupported_rate(judged: DataFrame, summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates, supported ones and the unsupported share for every summary; 0 without candidates; up to 10 samples."""
    scores = judged.groupBy(*keys).agg(
        F.count("*").alias("total_candidates"),
        F.count_if("supported").alias("supported"),
        F.slice(F.array_sort(F.collect_list(F.when(~F.col("supported"), F.struct("pos", "candidate")))), 1, 10)["candidate"].alias("unsupported_samples"),
    )
    out = summaries.select(*keys).join(scores, keys, "left").fillna(0, ["total_candidates", "supported"])
    return out.withColumn("unsupported_identifier_rate", F.coalesce(F.try_divide(F.col("total_candidates") - F.col("supported"), F.col("total_candidates")), F.lit(0.0)))


def fact_index(facts: DataFrame, scope: str = "repo_name") -> DataFrame:
    """(scope, key, fact): canonical forms of each whole fact and of its value; the first writer keeps a key."""
    ranked = facts.withColumn("_at", F.struct("section", "pos"))
    keys = F.array(
        F.struct(F.lit(0).alias("k"), canonical(F.col("fact")).alias("key")),
        F.struct(F.lit(1).alias("k"), F.when(F.contains("fact", F.lit(":")), canonical(value(F.col("fact")))).alias("key")),
    )
    rows = ranked.select(scope, "fact", "_at", F.explode(keys).alias("x")).filter("x.key is not null")
    return rows.groupBy(scope, F.col("x.key").alias("key")).agg(F.min_by("fact", F.struct("_at", "x.k")).alias("fact"))


def resolve_verdict(items: DataFrame, facts: DataFrame, keys: list[str], scope: str = "repo_name", item: str = "item") -> DataFrame:
    """items (keys, pos, item) with `fact`: by canonical form, else by position in the fact list; null: unmatched."""
    order = Window.partitionBy(scope).orderBy("section", "pos", "fact")
    # a position has three digits at most; the filter lets each task pass on no more than that before rows are sorted
    numbered = facts.select(scope, F.row_number().over(order).alias("_n"), F.col("fact").alias("_by_n")).filter("_n <= 999")
    index = fact_index(facts, scope).select(scope, F.col("key").alias("_key"), F.col("fact").alias("_by_key"))
    rows = items.withColumn("_key", canonical(F.col(item))).withColumn("_n", position_reference(F.col(item)))
    return rows.join(index, [scope, "_key"], "left").join(numbered, [scope, "_n"], "left").withColumn("fact", F.coalesce("_by_key", "_by_n")).drop("_key", "_n", "_by_key", "_by_n")


def missing_facts(verdicts: DataFrame, raw: str = "raw_text") -> Column:
    """The list of a coverage verdict in a raw answer; null where the answer is no such object."""
    got = F.from_json(json_object(F.col(raw)), "missing_facts array<string>")
    return got["missing_facts"]


def hallucination_verdict(raw: Column) -> Column:
    """(total, unsupported) of a verdict in a raw answer: blank claims dropped, total at least their number; null where
    the answer is no such object."""
    got = F.from_json(json_object(raw), "total_claims string, unsupported_claims array<string>")
    total = F.when(F.rlike(got["total_claims"], F.lit(r"^-?\d{1,9}$")), got["total_claims"].cast("int"))
    claims = F.filter(F.transform(got["unsupported_claims"], lambda c: F.trim(c)), lambda c: c != "")
    return F.when(total.isNotNull() & claims.isNotNull(), F.struct(F.greatest(total, F.size(claims)).alias("total"), claims.alias("unsupported")))


def judged_coverage(resolved: DataFrame, facts: DataFrame, verdicts: DataFrame, keys: list[str], scope: str = "repo_name") -> DataFrame:
    """(keys, judged, total_facts, missing, unmatched, score) of every verdict row (keys, judged): score is null where the
    answer was not judged, 1 where there are no facts."""
    totals = facts.groupBy(scope).agg(F.count("*").alias("total_facts"))
    found = resolved.groupBy(*keys).agg(F.count_distinct("fact").alias("missing"), F.count_if(F.col("fact").isNull()).alias("unmatched"))
    out = verdicts.join(totals, scope, "left").join(found, keys, "left").fillna(0, ["total_facts", "missing", "unmatched"])
    score = F.when(F.col("total_facts") == 0, 1.0).otherwise((F.col("total_facts") - F.col("missing")) / F.col("total_facts"))
    return out.withColumn("score", F.when(F.col("judged"), score))


def claim_tag(claim: Column) -> Column:
    endpoint = F.rlike(claim, F.lit(rf"(?i)\b(?:{'|'.join(VERBS)})\b[:\s]*/"))
    return F.when(endpoint, "fabricated_endpoint").otherwise("fabricated_technology")


def missing_tag(fact: Column) -> Column:
    out = F.lit(None).cast("string")
    for prefix, tag in reversed(MISSED.items()):
        out = F.when(F.startswith(fact, F.lit(prefix + ":")), tag).otherwise(out)
    return out


def over_generic(overview: Column, terms: Column, least: int = 12) -> Column:
    """Fewer than `least` words, or none of the repository's own terms in it, in any case."""
    words = F.filter(F.split(F.trim(overview), r"\s+"), lambda w: w != "")
    named = F.exists(F.filter(terms, lambda t: t != ""), lambda t: F.contains(F.lower(overview), F.lower(t)))
    return (F.size(words) < least) | ~F.coalesce(named, F.lit(False))


def failure_tags(
    rows: DataFrame,
    claims: str = "unsupported_claims",
    facts: str = "missing_facts",
    overview: str = "overview",
    terms: str = "known_terms",
    judged: Column | None = None,
) -> DataFrame:
    """rows with `tags`: malformed output, then a tag a claim, a tag a missing fact, then over-generic. Repeats count."""
    none = F.array().cast("array<string>")
    malformed = F.when(~judged, F.array(F.lit("malformed_output"))).otherwise(none) if judged is not None else none
    generic = F.when((F.trim(overview) != "") & over_generic(F.col(overview), F.coalesce(F.col(terms), none)), F.array(F.lit("over_generic"))).otherwise(none)
    missed = F.filter(F.transform(F.coalesce(F.col(facts), none), missing_tag), lambda t: t.isNotNull())
    return rows.withColumn("tags", F.concat(malformed, F.transform(F.coalesce(F.col(claims), none), claim_tag), missed, F.coalesce(generic, none)))


def tag_frequencies(tagged: DataFrame, by: list[str] | None = None) -> DataFrame:
    return tagged.select(*(by or []), F.explode("tags").alias("tag")).groupBy(*(by or []), "tag").agg(F.count("*").alias("n")).orderBy(*(by or []), F.desc("n"), "tag")


def unmatched_totals(rows: DataFrame, items: str = "unmatched", by: list[str] | None = None) -> DataFrame:
    """Over rows with a list of unmatched items: rows, rows with any, items in all."""
    n = F.coalesce(F.size(items), F.lit(0))
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n_rows"), F.count_if(n > 0).alias("rows_with_any"), F.sum(F.greatest(n, F.lit(0))).alias("n_items"))


def unmatched_composition(rows: DataFrame, key: list[str], sample: int, items: str = "unmatched", seed: int = 11) -> DataFrame:
    """(kind, n, share, estimate): kinds of the items in `sample` rows that have any, and what that makes of all items. The
    sample is the first rows in the order of a hash of their key, so it is the same in every run; it is the feature."""
    some = rows.filter(F.size(items) > 0)
    kinds = hash_sample(some, key, sample, seed).select(F.explode(items).alias("x")).groupBy(unmatched_class(F.col("x")).alias("kind")).agg(F.count("*").alias("n"))
    out = kinds.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))
    return out.withColumn("estimate", F.round(F.col("share") * some.agg(F.sum(F.size(items))).scalar()).cast("long"))


def all_index_rows(rows: DataFrame, key: list[str], items: str = "unmatched", most: int = 10) -> DataFrame:
    """The rows whose unmatched items are all positions, those with most items first; `most` of them, a top list."""
    none = ~F.exists(items, lambda x: F.coalesce(unmatched_class(x) != "index", F.lit(True)))
    n = F.size(items)
    return rows.filter((n > 0) & none).select(*key, n.alias("n_items")).orderBy(F.desc("n_items"), *key).limit(most)


def unmatched_class(item: Column) -> Column:
    """index, fact-like or other."""
    bare = F.regexp_replace(F.trim(item), "^[`'\" ]+|[`'\" ]+$", "")
    return F.when(F.rlike(bare, F.lit(POSITION)), "index").when(F.rlike(bare, F.lit(FACT_MARK)), "fact-like").otherwise("other")
