"""Texts rendered from the graph: dependency and knowledge contexts, budgeted raw source, Mermaid diagrams, ground truth.
Where the model leaves an order open, lines are sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RAW_BUDGET = 24_000
#: Parts of a repository's files in which the first ones are looked for.
PARTS = 64


def _listed(items: Column, none: str = "(none)") -> Column:
    return F.when(F.size(items) > 0, F.array_join(items, ", ")).otherwise(none)


def dependency_text(view: DataFrame, scope: str = "repo_name") -> DataFrame:
    """(scope, context) from dependency_view()."""
    line = F.concat(F.lit("- "), F.col("module_path"), F.lit(" imports: "), _listed(F.col("imports")))
    deps = F.array_sort(F.array_distinct(F.flatten(F.collect_list("external_dependencies"))))
    rows = view.groupBy(scope).agg(F.sort_array(F.collect_list(F.struct("module_path", line.alias("line")))).alias("lines"), deps.alias("deps"))
    return rows.select(
        scope,
        F.concat_ws(
            "\n",
            F.lit("Module dependency graph:"),
            F.array_join(F.col("lines.line"), "\n"),
            F.lit(""),
            F.concat(F.lit("External dependencies: "), _listed(F.col("deps"))),
        ).alias("context"),
    )


def knowledge_text(view: DataFrame, scope: str = "repo_name") -> DataFrame:
    """(scope, context) from knowledge_view()."""
    none = F.array().cast("array<string>")
    modules = F.coalesce("modules", F.array().cast("array<struct<path:string,imports:array<string>,classes:array<string>>>"))
    classes = F.array_sort(F.array_distinct(F.flatten(F.transform(modules, lambda m: m["classes"]))))
    endpoints = F.coalesce("endpoints", F.array().cast("array<struct<path:string,method:string,handler:string>>"))
    block = F.transform(modules, lambda m: F.concat(
        F.lit("- "),
        m["path"],
        F.lit("\n    imports: "),
        _listed(m["imports"]),
        F.when(F.size(m["classes"]) > 0, F.concat(F.lit("\n    defines: "), F.array_join(m["classes"], ", "))).otherwise(""),
    ))
    lines = lambda items: F.when(F.size(items) > 0, F.array_join(items, "\n")).otherwise("(none)")
    served = F.transform(endpoints, lambda e: F.concat(
        F.lit("- "),
        e["method"],
        F.lit(" "),
        e["path"],
        F.lit(" -> "),
        F.coalesce(e["handler"], F.lit("(inline handler, no stable function reference)")),
    ))
    count = lambda items: F.size(items).cast("string")
    return view.select(
        scope,
        F.concat_ws(
            "\n",
            F.concat(F.lit("Framework: "), F.coalesce("framework", F.lit("unknown")), F.lit(" ("), F.coalesce("framework_version", F.lit("version unknown")), F.lit(")")),
            F.lit(""),
            F.concat(F.lit("Modules ("), count(modules), F.lit("):")),
            lines(block),
            F.lit(""),
            F.concat(F.lit("Classes ("), count(classes), F.lit("):")),
            lines(F.transform(classes, lambda c: F.concat(F.lit("- "), c))),
            F.lit(""),
            F.concat(F.lit("API endpoints ("), count(endpoints), F.lit("):")),
            lines(served),
            F.lit(""),
            F.concat(F.lit("External dependencies: "), _listed(F.coalesce("external_dependencies", none))),
            F.concat(F.lit("Config files: "), _listed(F.coalesce("config_files", none))),
            F.concat(F.lit("Database entities: "), _listed(F.coalesce("database_entities", none))),
        ).alias("context"),
    )


def raw_text(files: DataFrame, order: list[Column], budget: int = RAW_BUDGET, scope: str = "repo_name", path: str = "path", text: str = "text") -> DataFrame:
    """(scope, context, n_files): files in order, each behind a header line, cut where the chunks reach the budget, and how
    many of them begin within it. Blank lines between chunks are not counted; unreadable files (null text) are skipped. A chunk has 15 characters or more, so only
    that many first files can matter: they are found in parts of a repository first, and no task sorts one as a whole."""
    chunk = F.concat(F.lit("// ---- "), F.col(path), F.lit(" ----\n"), F.col(text))
    w = Window.partitionBy(scope).orderBy(*order)
    part = Window.partitionBy(scope, F.pmod(F.xxhash64(path, *order), F.lit(PARTS))).orderBy(*order)
    first = files.filter(F.col(text).isNotNull()).withColumn("_pos", F.row_number().over(part)).filter(F.col("_pos") <= budget // 15 + 1)
    rows = first.withColumn("_chunk", chunk).withColumn(
        "_before",
        F.coalesce(F.sum(F.length("_chunk")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).withColumn("_pos", F.row_number().over(w))
    kept = rows.filter(F.col("_before") < budget).select(scope, "_pos", F.expr(f"substring(_chunk, 1, cast({budget} - _before as int))").alias("_part"))
    return kept.groupBy(scope).agg(F.sort_array(F.collect_list(F.struct("_pos", "_part"))).alias("_p")).select(
        scope,
        F.array_join(F.col("_p._part"), "\n\n").alias("context"),
        F.size("_p").cast("long").alias("n_files"),
    )


def mermaid(rows: DataFrame, repos: DataFrame, scope: str = "repo_name") -> DataFrame:
    """(scope, diagram) for every repository from diagram_rows()."""
    label = F.replace(F.col("b"), F.lit('"'), F.lit("&quot;"))
    line = (
        F.when(F.col("section") == 1, F.concat(F.lit("  "), F.col("a"), F.lit('["'), label, F.lit('"]')))
        .when(F.col("section") == 2, F.concat(F.lit("  "), F.col("a"), F.lit(" --> "), F.col("b")))
        .otherwise(F.concat(
            F.lit("  "),
            F.col("a"),
            F.lit('{{"'),
            label,
            F.lit('"}}'),
            F.when(F.col("c").isNotNull(), F.concat(F.lit("\n  "), F.col("c"), F.lit(" -.-> "), F.col("a"))).otherwise(""),
        ))
    )
    lines = rows.select(scope, "section", "a", "b", line.alias("line")).groupBy(scope).agg(
        F.sort_array(F.collect_list(F.struct("section", "a", "b", "line"))).alias("lines"),
        F.max((F.col("section") == 1).cast("int")).alias("some"),
    )
    empty = F.lit('graph TD\n  empty["No modules found for this repository"]')
    return repos.select(scope).join(lines, scope, "left").select(
        scope,
        F.when(F.col("some") == 1, F.concat(F.lit("graph TD\n"), F.array_join(F.col("lines.line"), "\n"))).otherwise(empty).alias("diagram"),
    )


def capped(names: Column, most: int = 40) -> Column:
    """The first names, and how many more there are."""
    more = F.when(F.size(names) > most, F.format_string(" (+%d more)", F.size(names) - most)).otherwise("")
    return F.concat(_listed(F.slice(names, 1, most)), more)


def ground_truth(view: DataFrame, counts: DataFrame, scope: str = "repo_name", most: int = 40) -> DataFrame:
    """(scope, truth) from a row a repository with ordered arrays: framework, framework_version, language, dependencies,
    endpoints, classes, configs, entities; and entity_counts()."""
    none = F.array().cast("array<string>")
    names = lambda c: capped(F.coalesce(c, none), most)
    return view.join(counts, scope).select(
        scope,
        F.concat_ws(
            "\n",
            F.concat(
                F.lit("Detected framework: "),
                F.coalesce("framework", F.lit("unknown")),
                F.coalesce(F.concat(F.lit(" (version "), F.col("framework_version"), F.lit(")")), F.lit("")),
            ),
            F.concat(F.lit("Detected language: "), F.coalesce("language", F.lit("None"))),
            F.format_string(
                "Counts: %d modules, %d classes, %d functions, %d endpoints, %d database entities",
                "modules",
                "classes_n",
                "functions",
                "api_endpoints",
                "database_entities",
            ),
            F.concat(F.lit("External dependencies: "), names("dependencies")),
            F.concat(F.lit("API endpoints: "), names("endpoints")),
            F.concat(F.lit("Classes: "), names("classes")),
            F.concat(F.lit("Config files: "), names("configs")),
            F.concat(F.lit("Database entities: "), names("entities")),
        ).alias("truth"),
    )


def build_context(variant: str, dependency: DataFrame, knowledge: DataFrame, scope: str = "repo_name") -> DataFrame:
    """The text of a graph representation; raw text needs the files, see raw_text()."""
    if variant == "dependency_graph":
        return dependency_text(dependency, scope)
    if variant == "knowledge_graph":
        return knowledge_text(knowledge, scope)
    raise ValueError(f"{variant} is not made from the graph")
