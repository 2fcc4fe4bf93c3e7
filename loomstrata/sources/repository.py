"""Checked-out repositories as tables: files, framework, packages, aliases, and what the lexer finds in each source."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexer
from ..functions.text import join_path
from .staging import written

# What is scanned.
SKIP_DIRS = ["node_modules", ".git", "dist", "build", "coverage", ".next"]
TEST_DIRS = ["test", "tests", "__tests__", "__mocks__", "spec", "e2e", "cypress"]
SUFFIXES = {"express": ["", ".js", "/index.js", ".mjs", ".cjs"], "nestjs": ["", ".ts", "/index.ts"]}
CONFIGS = {
    "express": {
        "package.json": "build",
        ".env": "env",
        ".env.example": "env",
        "Procfile": "framework_config",
        "docker-compose.yml": "framework_config",
        "Dockerfile": "framework_config",
    },
    "nestjs": {
        "package.json": "build",
        "tsconfig.json": "build",
        "nest-cli.json": "framework_config",
        ".env": "env",
        ".env.example": "env",
        "docker-compose.yml": "framework_config",
        "Dockerfile": "framework_config",
    },
}
MOST_FILES = 3000
#: A repository's URL at the hosting site: owner and name.
URL = r"^https://github\.com/([\w.-]+)/([\w.-]+?)(?:\.git)?/?$"

FOUND = "requires array<string>, imports array<string>, functions array<string>, routes array<struct<method:string,path:string,handler:string,annotation:string>>, mounts array<struct<prefix:string,kind:string,target:string>>, classes array<struct<name:string,implements:array<string>,prefix:string,methods:array<struct<name:string,route_method:string,route_path:string,annotation:string>>>>, warning string"


def valid_url(url: Column) -> Column:
    """Whether a URL names a repository of the hosting site, as https://github.com/<owner>/<repo>."""
    return F.rlike(F.trim(url), F.lit(URL))


def url_parts(url: Column) -> Column:
    return F.struct(F.regexp_extract(F.trim(url), URL, 1).alias("owner"), F.regexp_extract(F.trim(url), URL, 2).alias("repo"))


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(repo_name, path, length, content) of all files under root/<repository>/."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1].split(":")[-1]
    inner = F.regexp_extract("path", re.escape(base) + "/(.*)$", 1)
    return files.select(F.substring_index(inner, "/", 1).alias("repo_name"), F.regexp_replace(inner, "^[^/]*/", "").alias("path"), "length", "content")


def sizes_mb(files: DataFrame, most: float = 200) -> DataFrame:
    """Megabytes of each repository and whether it is too large."""
    return files.groupBy("repo_name").agg((F.sum("length") / (1 << 20)).alias("size_mb")).withColumn("too_large", F.col("size_mb") > most)


def detect(files: DataFrame) -> DataFrame:
    """(repo_name, framework, language, version): from the root's package.json, NestJS before Express; Spring by its
    build files, without a parser; null: none."""
    deps = F.from_json(F.col("content").cast("string"), "dependencies map<string,string>, devDependencies map<string,string>")
    pkg = files.filter("path = 'package.json'").select("repo_name", deps.alias("p"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    both = pkg.select(
        "repo_name",
        F.map_concat(
            F.map_filter(F.coalesce("p.devDependencies", none), lambda k, _: ~F.array_contains(F.map_keys(F.coalesce("p.dependencies", none)), k)),
            F.coalesce("p.dependencies", none),
        ).alias("d"),
    )
    version = lambda *names: F.coalesce(*(F.try_element_at("d", F.lit(n)) for n in names))
    nest, express = version("@nestjs/core", "@nestjs/common"), version("express")
    js = both.select("repo_name", F.when(nest.isNotNull(), "nestjs").when(express.isNotNull(), "express").alias("js"), F.coalesce(nest, express).alias("version"))
    spring = files.filter(F.col("path").isin("pom.xml", "build.gradle")).groupBy("repo_name").agg(F.bool_or(F.contains(F.col("content").cast("string"), F.lit("spring-boot"))).alias("spring"))
    out = files.select("repo_name").distinct().join(js, "repo_name", "left").join(spring, "repo_name", "left")
    framework = F.coalesce("js", F.when(F.col("spring"), "spring"))
    return out.select(
        "repo_name",
        framework.alias("framework"),
        F.when(framework == "nestjs", "typescript").when(framework == "express", "javascript").when(framework == "spring", "java").alias("language"),
        "version",
    )


def scan(files: DataFrame, framework: str) -> tuple[DataFrame, DataFrame]:
    """(sources, skipped), all of them: tests (and, for Express, files of other dialects) are recorded as skipped; generated
    and hidden folders are dropped without a record."""
    folders = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    name = F.element_at(F.split("path", "/"), -1)
    seen = files.filter(~F.arrays_overlap(folders, F.array(*map(F.lit, SKIP_DIRS))) & ~F.exists(folders, lambda d: F.startswith(d, F.lit("."))))
    own, other = ("(js|mjs|cjs)", "(ts|tsx|jsx)") if framework == "express" else ("ts", None)
    in_tests = F.arrays_overlap(folders, F.array(*map(F.lit, TEST_DIRS)))
    test = in_tests | F.rlike(name, F.lit(r"\.(test|spec)\.(js|mjs|cjs)$" if framework == "express" else r"\.(spec|e2e-spec)\.ts$"))
    mine = seen.filter(F.rlike(name, F.lit(rf"\.{own}$")))
    skipped = mine.filter(test).select("repo_name", "path")
    if other:
        skipped = skipped.unionByName(seen.filter(F.rlike(name, F.lit(rf"\.{other}$"))).select("repo_name", "path"))
    return mine.filter(~test), skipped


def source_files(files: DataFrame, framework: str, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """scan(), its sources sorted and numbered by repository: the first 3000, or every one."""
    mine, skipped = scan(files, framework)
    # ranked by path alone, and the rank cut as it is, so a task passes on no more than the files that stay; contents come after
    order = Window.partitionBy("repo_name").orderBy("path")
    ranked = mine.select("repo_name", "path").withColumn("rank", F.row_number().over(order))
    first = ranked if every else ranked.filter(F.col("rank") <= MOST_FILES)
    numbered = first.select("repo_name", "path", (F.col("rank") - 1).alias("pos"))
    kept = mine.join(numbered, ["repo_name", "path"])
    return kept.withColumn("module_id", F.concat(F.lit("mod_"), F.col("pos").cast("string"))), skipped


def lex(sources: DataFrame) -> DataFrame:
    """sources without content, with what the lexer found; a file it can't read has a warning and nothing else."""
    keep = [f for f in sources.schema.fields if f.name != "content"]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for content in b["content"]:
                try:
                    s = lexer.Source.of(bytes(content).decode("utf-8", "replace"))
                    rows.append((lexer.requires(s), lexer.imports(s), lexer.functions(s), lexer.routes(s), lexer.mounts(s), lexer.classes(s), None))
                except (IndexError, ValueError, RecursionError) as x:
                    rows.append(([], [], [], [], [], [], f"{type(x).__name__}: {x}"))
            names = ["requires", "imports", "functions", "routes", "mounts", "classes", "warning"]
            yield pd.concat([b[[f.name for f in keep]].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    return sources.mapInPandas(each, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keep) + ", " + FOUND)


@F.pandas_udf(T.StringType())
def _beside(path: pd.Series, imported: pd.Series) -> pd.Series:
    return pd.Series([posixpath.normpath(posixpath.join(posixpath.dirname(p), i)) for p, i in zip(path, imported)])


def resolve(wanted: DataFrame, modules: DataFrame, suffixes: list[str], candidate: Column) -> DataFrame:
    """wanted with `target_id`: the module whose path is the candidate and the first suffix that gives one. wanted has
    repo_name and a unique `wid`."""
    probes = wanted.select("repo_name", "wid", candidate.alias("c")).select(
        "repo_name",
        "wid",
        F.posexplode(F.transform(F.array(*map(F.lit, suffixes)), lambda s: F.concat(F.col("c"), s))).alias("k", "path"),
    )
    hits = probes.join(
        modules.select("repo_name", "path", F.col("module_id").alias("target")),
        ["repo_name", "path"],
    ).groupBy("wid").agg(F.min_by("target", "k").alias("target_id"))
    return wanted.join(hits, "wid", "left")


def import_edges(found: DataFrame, framework: str, aliases: DataFrame | None = None) -> DataFrame:
    """The bag of (repo_name, from_module_id, to_module_id): relative imports and requires, and for NestJS aliased ones."""
    each = F.concat("requires", "imports") if framework == "express" else F.col("imports")
    wanted = found.select("repo_name", "module_id", "path", F.posexplode(each).alias("k", "imported")).withColumn("wid", F.concat_ws("|", "repo_name", "module_id", "k"))
    near = wanted.filter(F.startswith("imported", F.lit(".")))
    out = resolve(near, found, SUFFIXES[framework], _beside("path", "imported"))
    if aliases is not None:
        far = wanted.filter(~F.startswith("imported", F.lit("."))).join(aliases, "repo_name")
        head, tail = F.substring_index("pattern", "*", 1), F.when(F.contains("pattern", F.lit("*")), F.substring_index("pattern", "*", -1))
        exact = tail.isNull() & (F.col("imported") == F.col("pattern"))
        wild = tail.isNotNull() & F.startswith("imported", head) & F.endswith("imported", tail) & (F.length("imported") >= F.length(head) + F.length(tail))
        rest = F.expr("substring(imported, length(substring_index(pattern, '*', 1)) + 1, length(imported) - length(pattern) + 1)")
        best = Window.partitionBy("wid").orderBy(F.desc(F.when(exact, F.length("pattern") + 1).otherwise(F.length(head))), "at")
        hits = far.filter(exact | wild).withColumn("c", F.when(exact, F.col("target")).otherwise(F.replace("target", F.lit("*"), rest)))
        hits = resolve(
            hits.withColumn("alias_wid", F.col("wid")).withColumn("wid", F.concat_ws("|", "wid", "pattern", "at")),
            found,
            SUFFIXES[framework],
            F.col("c"),
        ).filter("target_id is not null")
        hits = hits.withColumn("wid", F.col("alias_wid")).withColumn("_n", F.row_number().over(best)).filter("_n = 1")
        out = out.select("repo_name", "module_id", "target_id").unionByName(hits.select("repo_name", "module_id", "target_id"))
    return out.filter("target_id is not null").select("repo_name", F.col("module_id").alias("from_module_id"), F.col("target_id").alias("to_module_id"))


def function_rows(found: DataFrame, framework: str) -> DataFrame:
    """Free functions and, for NestJS, methods, with stable ids."""
    mark = "_fn_" if framework == "express" else "_freefn_"
    free = found.select("repo_name", "module_id", F.posexplode("functions").alias("k", "name")).select(
        "repo_name",
        F.concat("module_id", F.lit(mark), F.col("k").cast("string")).alias("id"),
        "name",
        "module_id",
        F.lit(None).cast("string").alias("class_id"),
        F.lit(False).alias("is_api_handler"),
    )
    if framework == "express":
        return free
    return method_rows(found).select("repo_name", "id", "name", "module_id", "class_id", F.col("served").alias("is_api_handler")).unionByName(free)


def class_rows(found: DataFrame) -> DataFrame:
    each = found.select("repo_name", "module_id", F.posexplode("classes").alias("k", "c"))
    return each.select(
        "repo_name",
        F.concat("module_id", F.lit("_cls_"), F.col("k").cast("string")).alias("id"),
        "c.name",
        "module_id",
        F.col("c.implements").alias("implements_raw"),
        F.lit(False).alias("is_interface"),
        F.col("c.prefix").alias("prefix"),
        F.col("c.methods").alias("methods"),
    )


def method_rows(found: DataFrame) -> DataFrame:
    """Methods; served: a route decorator in a class with @Controller."""
    each = class_rows(found).select("repo_name", "module_id", F.col("id").alias("class_id"), "prefix", F.posexplode("methods").alias("k", "m"))
    return each.select(
        "repo_name",
        F.concat("class_id", F.lit("_fn_"), F.col("k").cast("string")).alias("id"),
        "m.name",
        "module_id",
        "class_id",
        "prefix",
        "m.route_method",
        "m.route_path",
        "m.annotation",
        (F.col("m.route_method").isNotNull() & F.col("prefix").isNotNull()).alias("served"),
    )


def express_endpoints(found: DataFrame) -> DataFrame:
    """Routes before mounts are applied; a handler is a function of the same file by its name (the last of that name)."""
    each = found.select("repo_name", "module_id", F.posexplode("routes").alias("k", "r"))
    named = function_rows(found, "express").groupBy("repo_name", "module_id", F.col("name").alias("handler")).agg(F.max_by("id", F.struct(F.length("id"), "id")).alias("handler_function_id"))
    rows = each.select(
        "repo_name",
        "module_id",
        F.concat("module_id", F.lit("_ep_"), F.col("k").cast("string")).alias("id"),
        "r.method",
        "r.path",
        "r.handler",
        F.col("r.annotation").alias("framework_annotation"),
    )
    return rows.join(named, ["repo_name", "module_id", "handler"], "left").drop("handler")


def nest_endpoints(found: DataFrame) -> DataFrame:
    """Served methods; unresolved_path marks a decorator whose argument isn't a literal."""
    m = method_rows(found).filter("served")
    return m.select(
        "repo_name",
        "module_id",
        F.concat("id", F.lit("_ep")).alias("id"),
        F.col("route_method").alias("method"),
        join_path(F.col("prefix"), F.col("route_path")).alias("path"),
        F.col("annotation").alias("framework_annotation"),
        F.col("id").alias("handler_function_id"),
        (F.col("prefix") == "").alias("unresolved_path"),
    )


def mount_tables(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(own, mounts) for graph.mount_prefixes(). Several mounts of one target keep the last mounter and join all local
    prefixes in order; several own prefixes of a file are joined as well."""
    each = found.select(
        "repo_name",
        "module_id",
        "path",
        "pos",
        F.posexplode("mounts").alias("k", "m"),
    ).withColumn("wid", F.concat_ws("|", "repo_name", "module_id", "k"))
    bare = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "k", F.col("m.prefix").alias("p")))), lambda x: x["p"]), "/")
    own = each.filter("m.kind = 'own'").groupBy("repo_name", F.col("module_id").alias("id")).agg(bare("p").alias("own_prefix"))
    far = resolve(
        each.filter(F.col("m.kind") == "require").filter(F.startswith("m.target", F.lit("."))),
        found,
        SUFFIXES["express"],
        _beside("path", "m.target"),
    ).filter("target_id is not null")
    mounts = far.groupBy("repo_name", F.col("target_id").alias("id")).agg(F.max_by("module_id", F.struct("pos", "k")).alias("mounter"), bare("p").alias("local_prefix"))
    return own, mounts


def packages(files: DataFrame) -> DataFrame:
    """(repo_name, name, version, dep_type, pos): runtime packages, then development ones."""
    both = F.from_json(F.col("content").cast("string"), "dependencies map<string,string>, devDependencies map<string,string>")
    pkg = files.filter("path = 'package.json'").select("repo_name", both.alias("p"))
    part = lambda c, kind, base: pkg.select("repo_name", F.posexplode(F.map_entries(c)).alias("k", "e")).select(
        "repo_name",
        F.col("e.key").alias("name"),
        F.col("e.value").alias("version"),
        F.lit(kind).alias("dep_type"),
        (F.col("k") + base).cast("long").alias("pos"),
    )
    return part("p.dependencies", "runtime", 0).unionByName(part("p.devDependencies", "dev", 1_000_000))


def config_files(files: DataFrame, framework: str) -> DataFrame:
    known = F.create_map(*(F.lit(x) for pair in CONFIGS[framework].items() for x in pair))
    return files.select("repo_name", "path", F.try_element_at(known, F.col("path")).alias("config_type")).filter("config_type is not null")


def _jsonc(raw: bytes | None) -> dict | None:
    """JSON with comments and trailing commas, outside strings; None where it is no object."""
    if raw is None:
        return None
    text = bytes(raw).decode("utf-8", "replace")
    plain = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*[\s\S]*?\*/', lambda m: m[1] or "", text)
    for t in (text, re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", plain)):
        try:
            got = json.loads(t)
            return got if isinstance(got, dict) else None
        except ValueError:
            continue
    return None


def path_aliases(files: DataFrame) -> DataFrame:
    """(repo_name, pattern, target, at): tsconfig paths under their baseUrl. One `extends` hop is followed, unless it
    names a package; the own file's settings come first."""
    def read(part: pd.DataFrame) -> pd.DataFrame:
        content = dict(zip(part["path"], part["content"]))
        own = _jsonc(content.get("tsconfig.json")) or {}
        base = own.get("extends")
        parent = (_jsonc(content.get(posixpath.normpath(base)) or content.get(posixpath.normpath(base + ".json"))) or {}) if isinstance(base, str) and not base.startswith("@") else {}
        options = {**(parent.get("compilerOptions") or {}), **(own.get("compilerOptions") or {})}
        rows = []
        for pattern, targets in (options.get("paths") or {}).items():
            if pattern.count("*") <= 1 and isinstance(targets, list):
                rows += [(
                    part["repo_name"].iloc[0],
                    pattern,
                    posixpath.normpath(posixpath.join(options.get("baseUrl") or ".", t)),
                    k,
                ) for k, t in enumerate(targets) if isinstance(t, str)]
        return pd.DataFrame(rows, columns=["repo_name", "pattern", "target", "at"])

    configs = files.filter(F.rlike("path", F.lit(r"^[^/]*\.json$")) & F.contains("path", F.lit("tsconfig")))
    return configs.groupBy("repo_name").applyInPandas(read, "repo_name string, pattern string, target string, at int")


def parse(files: DataFrame, framework: str, every: bool = False) -> dict[str, DataFrame]:
    """All entity tables of the repositories of one framework, from the first 3000 sources of each or from every one."""
    from ..operators import graph

    sources, skipped = source_files(files, framework, every)
    found = written(lex(sources), "lexed")
    modules = found.filter("warning is null").select("repo_name", F.col("module_id").alias("id"), "path", F.lit("module").alias("kind"), "pos")
    if framework == "express":
        own, mounts = mount_tables(found)
        endpoints = graph.apply_prefixes(express_endpoints(found), graph.mount_prefixes(own, mounts))
        edges = import_edges(found, framework)
        classes = class_rows(found).limit(0)
    else:
        endpoints = nest_endpoints(found)
        edges = import_edges(found, framework, path_aliases(files))
        classes = class_rows(found)
    repos = detect(files).select(
        "repo_name",
        F.col("language").alias("detected_language"),
        F.col("framework").alias("detected_framework"),
        F.col("version").alias("framework_version"),
    )
    return {
        "repositories": repos,
        "modules": modules,
        "classes": classes.drop("prefix", "methods"),
        "functions": function_rows(found, framework),
        "endpoints": endpoints,
        "import_edges": edges,
        "external_deps": packages(files),
        "config_files": config_files(files, framework),
        "skipped": skipped,
        "parse_warnings": found.filter("warning is not null").select("repo_name", "path", "warning"),
    }
