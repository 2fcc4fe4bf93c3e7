"""The property graph as tables: keyed upserts, dropped dangling edges, integrity checks, structural views, mount chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import join_path
from ..sources.staging import discard, written

#: Key of each node table; edges are keyed by both ends.
KEYS = {
    "repositories": ["repo_name"],
    "modules": ["repo_name", "id"],
    "classes": ["repo_name", "id"],
    "functions": ["repo_name", "id"],
    "endpoints": ["repo_name", "id"],
    "db_entities": ["repo_name", "id"],
    "external_deps": ["repo_name", "name"],
    "config_files": ["repo_name", "path"],
}


def upsert(old: DataFrame | None, new: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """Rows of both, one a key: those of new replace those of old, and of several in new the first by `newest` stays.
    One shuffle by key: the best row is a struct maximum, combined before the shuffle, so a hot key is a row a task."""
    rank = F.struct(F.lit(1).alias("gen"), *(c.alias(f"o{i}") for i, c in enumerate(newest)))
    rows = new.select("*", rank.alias("_rank"))
    if old is not None:
        blank = F.struct(F.lit(0).alias("gen"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema["_rank"].dataType.fields[1:]))
        rows = rows.unionByName(old.select("*", blank.alias("_rank")), allowMissingColumns=True)
    rest = [c for c in new.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_rank", F.xxhash64(*[F.col(c).cast("string") for c in rest]))).alias("_row"))
    return best.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest))


def duplicates(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one row, and how many: empty if the constraint holds."""
    return table.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def edges_between(
    edges: DataFrame,
    left: DataFrame,
    right: DataFrame,
    from_col: str,
    to_col: str,
    left_id: str = "id",
    right_id: str = "id",
    scope: str = "repo_name",
) -> DataFrame:
    """Distinct edges whose two ends exist within their repository; dangling ones go."""
    a = left.select(scope, F.col(left_id).alias(from_col))
    b = right.select(scope, F.col(right_id).alias(to_col))
    return edges.select(scope, from_col, to_col).distinct().join(a, [scope, from_col], "left_semi").join(b, [scope, to_col], "left_semi")


def cross_scope(edges: DataFrame, from_scope: str, to_scope: str, kind: str) -> DataFrame:
    """How many edges of each kind join nodes of different repositories."""
    return edges.filter(F.col(from_scope) != F.col(to_scope)).groupBy(kind).agg(F.count("*").alias("n"))


def path_edges(edges: DataFrame, modules: DataFrame, scope: str = "repo_name") -> DataFrame:
    """Distinct (scope, from_path, to_path); edges without both modules go."""
    m = modules.select(scope, "id", "path")
    a, b = m.withColumnsRenamed({"id": "from_module_id", "path": "from_path"}), m.withColumnsRenamed({"id": "to_module_id", "path": "to_path"})
    return edges.select(scope, "from_module_id", "to_module_id").distinct().join(a, [scope, "from_module_id"]).join(b, [scope, "to_module_id"]).select(scope, "from_path", "to_path").distinct()


def dependency_view(modules: DataFrame, edges: DataFrame, deps: DataFrame, scope: str = "repo_name") -> DataFrame:
    """(scope, module_path, imports, external_dependencies): distinct, sorted. Each branch is aggregated to its own grain
    before it is joined, so imports and dependencies are never crossed."""
    imports = path_edges(edges, modules, scope).groupBy(scope, F.col("from_path").alias("path")).agg(F.sort_array(F.collect_set("to_path")).alias("imports"))
    names = deps.groupBy(scope).agg(F.sort_array(F.collect_set("name")).alias("external_dependencies"))
    none = F.array().cast("array<string>")
    return modules.select(scope, "path").join(imports, [scope, "path"], "left").join(names, scope, "left").select(
        scope,
        F.col("path").alias("module_path"),
        F.coalesce("imports", none).alias("imports"),
        F.coalesce("external_dependencies", none).alias("external_dependencies"),
    )


def knowledge_view(
    repos: DataFrame,
    modules: DataFrame,
    edges: DataFrame,
    classes: DataFrame,
    endpoints: DataFrame,
    functions: DataFrame,
    deps: DataFrame,
    configs: DataFrame,
    entities: DataFrame,
    scope: str = "repo_name",
) -> DataFrame:
    """One row a repository: framework, version, modules with imports and classes, endpoints with handlers, dependencies,
    config files, database entities; all distinct and sorted. A superset of dependency_view()."""
    imports = path_edges(edges, modules, scope).groupBy(scope, F.col("from_path").alias("path")).agg(F.sort_array(F.collect_set("to_path")).alias("imports"))
    defines = classes.groupBy(scope, F.col("module_id").alias("id")).agg(F.sort_array(F.collect_set("name")).alias("classes"))
    none = F.array().cast("array<string>")
    rows = modules.select(scope, "id", "path").join(imports, [scope, "path"], "left").join(defines, [scope, "id"], "left")
    of_modules = rows.groupBy(scope).agg(F.sort_array(F.collect_list(F.struct(
        "path",
        F.coalesce("imports", none).alias("imports"),
        F.coalesce("classes", none).alias("classes"),
    ))).alias("modules"))
    handlers = functions.select(scope, F.col("id").alias("handler_function_id"), F.col("name").alias("handler"))
    of_endpoints = endpoints.filter("path is not null").join(handlers, [scope, "handler_function_id"], "left").groupBy(scope).agg(F.sort_array(F.collect_set(F.struct("path", "method", "handler"))).alias("endpoints"))
    named = lambda t, c, to: t.filter(F.col(c).isNotNull()).groupBy(scope).agg(F.sort_array(F.collect_set(c)).alias(to))
    out = repos.select(scope, F.col("detected_framework").alias("framework"), "framework_version")
    for part in (
        of_modules,
        of_endpoints,
        named(deps, "name", "external_dependencies"),
        named(configs, "path", "config_files"),
        named(entities, "name", "database_entities"),
    ):
        out = out.join(part, scope, "left")
    return out


def diagram_rows(modules: DataFrame, edges: DataFrame, endpoints: DataFrame, functions: DataFrame, scope: str = "repo_name") -> DataFrame:
    """Lines' contents of a diagram: (scope, section, a, b, c): modules (id, path), imports (from, to), endpoints (id,
    label, defining module of the handler or null)."""
    m = modules.select(scope, F.lit(1).alias("section"), F.col("id").alias("a"), F.col("path").alias("b"), F.lit(None).cast("string").alias("c"))
    kept = edges_between(edges, modules, modules, "from_module_id", "to_module_id", scope=scope)
    e = kept.select(scope, F.lit(2).alias("section"), F.col("from_module_id").alias("a"), F.col("to_module_id").alias("b"), F.lit(None).cast("string").alias("c"))
    handlers = functions.select(scope, F.col("id").alias("handler_function_id"), F.col("module_id").alias("c"))
    p = endpoints.join(handlers, [scope, "handler_function_id"], "left").select(
        scope,
        F.lit(3).alias("section"),
        F.col("id").alias("a"),
        F.concat_ws(" ", "method", "path").alias("b"),
        "c",
    )
    return m.unionByName(e).unionByName(p)


def mount_prefixes(own: DataFrame, mounts: DataFrame, scope: str = "repo_name") -> DataFrame:
    """(scope, id, prefix): the external prefix of every module with a prefix of its own or a mount.

    own: (scope, id, own_prefix); mounts: (scope, id, mounter, local_prefix), one row a mounted module. The prefix of a
    module is its mounter's, the local one and its own, joined; a module that closes a cycle counts as ''. Chains of any
    length are followed by pointer doubling, so a chain of n mounts takes log(n) rounds, each written out, so plans don't
    grow. Modules that run into a cycle are left over; see _round_cycles().
    """
    known = own.select(scope, "id").unionByName(mounts.select(scope, "id")).distinct()
    part = join_path(F.coalesce("local_prefix", F.lit("")), F.coalesce("own_prefix", F.lit("")))
    steps = known.join(own, [scope, "id"], "left").join(mounts, [scope, "id"], "left").select(scope, "id", F.col("mounter").alias("to"), part.alias("prefix"))
    # a mounter that has neither a prefix nor a mount ends its chains
    alone = steps.filter("to is not null").select(scope, F.col("to").alias("id")).distinct().join(known, [scope, "id"], "left_anti")
    steps = written(steps.unionByName(alone.select(scope, "id", F.lit(None).cast(known.schema["id"].dataType).alias("to"), F.lit("").alias("prefix"))), "mounts")
    rows, endless = _follow(steps, scope)
    done = rows.filter("to is null").select(scope, "id", "prefix")
    if endless:
        left = written(steps.join(rows.filter("to is not null").select(scope, "id"), [scope, "id"], "left_semi"), "endless")
        ring = _round_cycles(left, scope)
        ends = ring.select(scope, "id", F.lit(None).cast(left.schema["to"].dataType).alias("to"), "prefix")
        tails = left.join(ring.select(scope, "id"), [scope, "id"], "left_anti")
        done = done.unionByName(_follow(written(tails.unionByName(ends), "tails"), scope)[0].select(scope, "id", "prefix"))
    return known.join(done, [scope, "id"])


def _follow(steps: DataFrame, scope: str) -> tuple[DataFrame, int]:
    """Rows (scope, id, to, prefix) whose pointers have gone on until they ended, and how many never do. Each round joins
    every row with the one its pointer has reached. While some chain is unfinished the chains of its later modules end in
    every round, so a round that ends none has come to those that run into cycles."""
    rows, before = steps, None
    while (live := rows.filter("to is not null").count()) and live != before:
        before = live
        further = rows.select(scope, F.col("id").alias("to"), F.col("to").alias("then"), F.col("prefix").alias("above"))
        prefix = F.when(F.col("to").isNull(), F.col("prefix")).otherwise(join_path(F.col("above"), F.col("prefix")))
        last, rows = rows, written(rows.join(further, [scope, "to"], "left").select(scope, "id", F.col("then").alias("to"), prefix.alias("prefix")), "doubled")
        if last is not steps:
            discard(last)
    return rows, live


def _round_cycles(steps: DataFrame, scope: str) -> DataFrame:
    """(scope, id, prefix) of the modules on cycles: the product of one whole turn, which ends with the module itself.

    steps: (scope, id, to, prefix) of modules whose chains never end. All in log(n) rounds of joins on what pointers have
    reached: pointers are doubled until their targets get no fewer, and those are the modules on cycles; the least id in
    growing distance names a cycle, and its rows are the turn's length n; then products of 1, 2, 4, ... steps are made, and
    a module takes those that the binary digits of n name."""
    hop, targets = steps.select(scope, "id", "to"), None
    while (there := hop.select(scope, "to").distinct().count()) != targets:
        targets = there
        hop = written(
            hop.join(hop.select(scope, F.col("id").alias("to"), F.col("to").alias("then")), [scope, "to"]).select(scope, "id", F.col("then").alias("to")),
            "hops",
        )
    ring = written(steps.join(hop.select(scope, F.col("to").alias("id")).distinct(), [scope, "id"], "left_semi"), "ring")
    least, changed = ring.select(scope, "id", "to", F.least("id", "to").alias("low"), F.lit(True).alias("fell")), True
    while changed:
        ahead = least.select(scope, F.col("id").alias("to"), F.col("to").alias("then"), F.col("low").alias("other"))
        low = F.least("low", "other")
        least = written(least.join(ahead, [scope, "to"]).select(scope, "id", F.col("then").alias("to"), low.alias("low"), (low != F.col("low")).alias("fell")), "least")
        changed = not least.filter("fell").isEmpty()
    turn = least.join(least.groupBy(scope, "low").agg(F.count("*").alias("n")), [scope, "low"]).select(scope, "id", "n")
    walk = written(turn.select(scope, "id", "n", F.col("id").alias("at"), F.lit("").alias("prefix")), "turns")
    most, k, power = walk.agg(F.max("n")).first()[0], 0, ring
    while most >> k:
        reached = power.select(scope, F.col("id").alias("at"), F.col("to").alias("then"), F.col("prefix").alias("above"))
        takes = F.expr(f"(n >> {k}) & 1") == 1
        gone = walk.join(reached, [scope, "at"])
        walk = written(
            gone.select(
                scope,
                "id",
                "n",
                F.when(takes, F.col("then")).otherwise(F.col("at")).alias("at"),
                F.when(takes, join_path(F.col("above"), F.col("prefix"))).otherwise(F.col("prefix")).alias("prefix"),
            ),
            "turns",
        )
        k += 1
        if most >> k:
            further = power.select(scope, F.col("id").alias("to"), F.col("to").alias("then"), F.col("prefix").alias("above"))
            power = written(
                power.join(further, [scope, "to"]).select(scope, "id", F.col("then").alias("to"), join_path(F.col("above"), F.col("prefix")).alias("prefix")),
                "powers",
            )
    return walk.select(scope, "id", "prefix")


def apply_prefixes(endpoints: DataFrame, prefixes: DataFrame, scope: str = "repo_name") -> DataFrame:
    """Paths of `router.` routes behind their module's prefix; routes of `app.` are absolute already."""
    found = prefixes.select(scope, F.col("id").alias("module_id"), "prefix")
    moved = F.col("prefix").isNotNull() & (F.col("prefix") != "") & F.startswith(F.col("framework_annotation"), F.lit("router."))
    return endpoints.join(found, [scope, "module_id"], "left").withColumn(
        "path",
        F.when(moved, join_path(F.col("prefix"), F.col("path"))).otherwise(F.col("path")),
    ).drop("prefix")


def entity_counts(tables: dict[str, DataFrame], scope: str = "repo_name") -> DataFrame:
    """Rows of five entity tables by repository, 0 where there are none."""
    out = tables["repositories"].select(scope)
    names = {"modules": "modules", "classes": "classes", "functions": "functions", "endpoints": "api_endpoints", "db_entities": "database_entities"}
    for table, name in names.items():
        out = out.join(tables[table].groupBy(scope).agg(F.count("*").alias(name)), scope, "left")
    return out.fillna(0, list(names.values()))
