"""Result tables: JSON documents, CSV and JDBC scans, append and overwrite sinks, the parse cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The shape of a parsed repository as a JSON document.
PARSED = """metadata struct<name:string,source_url:string,commit_sha:string,detected_language:string,detected_framework:string,framework_version:string,files_scanned:int,files_skipped:array<string>,parse_warnings:array<string>>,
modules array<struct<id:string,path:string,kind:string,imports:array<string>,exports:array<string>>>,
classes array<struct<id:string,name:string,module_id:string,interfaces_implemented:array<string>,methods:array<string>,is_interface:boolean>>,
functions array<struct<id:string,name:string,module_id:string,class_id:string,calls:array<string>,is_api_handler:boolean>>,
api_endpoints array<struct<id:string,method:string,path:string,handler_function_id:string,framework_annotation:string>>,
database_entities array<struct<id:string,name:string,source_path:string,fields:array<string>,related_function_ids:array<string>>>,
dependencies struct<internal:array<struct<from_module_id:string,to_module_id:string>>,external:array<struct<name:string,version:string,dep_type:string>>>,
config_files array<struct<path:string,config_type:string>>"""
ANNOTATION = "modules array<string>, imports array<array<string>>, endpoints array<string>"
REFERENCE = "overview string, tech_stack array<string>, services array<string>, dependencies array<string>"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document a file, with its name; a broken file is no row."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path, multiLine=True)
    return rows.withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)).filter("_corrupt is null").drop("_corrupt")


def parsed_tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """Parsed documents as entity tables; positions keep the source's order."""
    repo = F.col("metadata.name").alias("repo_name")
    each = lambda c: parsed.select(repo, F.posexplode(c).alias("pos", "x")).select("repo_name", F.col("pos").cast("long").alias("pos"), "x.*")
    return {
        "repositories": parsed.select(repo, "metadata.*").drop("name"),
        "modules": each("modules"),
        "classes": each("classes").withColumnRenamed("interfaces_implemented", "implements_raw"),
        "functions": each("functions"),
        "endpoints": each("api_endpoints"),
        "db_entities": each("database_entities"),
        "import_edges": each("dependencies.internal").drop("pos"),
        "external_deps": each("dependencies.external"),
        "config_files": each("config_files").drop("pos"),
    }


def read_results(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with quoted line ends; '' and 'None' are null, and what can't be cast is null as well."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    out: list[Column] = []
    for f in schema.fields:
        if f.name in raw.columns:
            text = F.when(~F.col(f.name).isin("", "None"), F.col(f.name))
            out.append((F.lower(text) if isinstance(f.dataType, T.BooleanType) else text).try_cast(f.dataType).alias(f.name))
        else:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
    return raw.select(*out)


def read_database(
    spark: SparkSession,
    url: str,
    table: str,
    columns: list[str],
    where: str | None = None,
    key: str | None = None,
    bounds: tuple[int, int, int] | None = None,
) -> DataFrame:
    """Columns and rows of a database table; the predicate and the columns are pushed to it, and a numeric key with
    (low, high, parts) reads it in parts. The driver's jar has to be on the class path."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", bounds[2])
    out = reader.load().select(*columns)
    return out.filter(where) if where else out


def write_csv(rows: DataFrame, path: str) -> None:
    """Overwrites; nested columns become JSON."""
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name) for f in rows.schema.fields]
    rows.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def text_report(sections: dict[str, DataFrame], most: int = 1000) -> str:
    """Result tables as one text: a heading each, then aligned columns in the order of the table. For reports, so a table
    shows `most` rows and says how many more there are."""
    out = []
    for title, table in sections.items():
        rows = [[_shown(x) for x in r] for r in table.limit(most + 1).collect()]
        cells = [table.columns, *rows[:most]]
        width = [max(len(r[k]) for r in cells) for k in range(len(table.columns))]
        out += [f"== {title}", *("  ".join(x.ljust(w) for x, w in zip(r, width)).rstrip() for r in cells)]
        out += [f"({table.count() - most} more rows)"] * (len(rows) > most) + [""]
    return "\n".join(out)


def _shown(x: object) -> str:
    return "-" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)


def write_report(spark: SparkSession, sections: dict[str, DataFrame], path: str) -> None:
    """text_report() as text under path, on any file system that Spark writes to."""
    lines = spark.createDataFrame([(text_report(sections),)], "value string")
    lines.coalesce(1).write.mode("overwrite").text(path)


def append_runs(rows: DataFrame, path: str, scope: str | None = None) -> None:
    """Appends, with run_at now where it is missing."""
    at = F.coalesce(F.col("run_at"), F.current_timestamp()) if "run_at" in rows.columns else F.current_timestamp()
    writer = rows.withColumn("run_at", at).write.mode("append")
    (writer.partitionBy(scope) if scope else writer).parquet(path)


def to_do(all_rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What has no row in done yet."""
    return all_rows.join(done.select(*keys).distinct(), keys, "left_anti")
