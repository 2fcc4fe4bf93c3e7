"""Schemas of the entity, run and match tables. A missing value means unknown, so columns stay null rather than empty."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(spec: str) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in (_field(x) for x in spec.split(","))])


def _field(spec: str) -> tuple[str, T.DataType]:
    name, kind = spec.split()
    kinds = {
        "s": T.StringType(),
        "i": T.IntegerType(),
        "l": T.LongType(),
        "d": T.DoubleType(),
        "b": T.BooleanType(),
        "t": T.TimestampType(),
        "s[]": T.ArrayType(T.StringType()),
    }
    return name, kinds[kind]


REPOSITORIES = _fields("repo_name s,source_url s,detected_language s,commit_sha s,detected_framework s,framework_version s,files_scanned i,files_skipped s[],parse_warnings s[],parsed_at t")
MODULES = _fields("repo_name s,id s,path s,kind s,pos l")
CLASSES = _fields("repo_name s,id s,name s,module_id s,implements_raw s[],is_interface b,pos l")
FUNCTIONS = _fields("repo_name s,id s,name s,module_id s,class_id s,calls s[],is_api_handler b,pos l")
ENDPOINTS = _fields("repo_name s,id s,method s,path s,handler_function_id s,framework_annotation s,pos l")
DB_ENTITIES = _fields("repo_name s,id s,name s,source_path s,related_function_ids s[],pos l")
IMPORT_EDGES = _fields("repo_name s,from_module_id s,to_module_id s")
EXTERNAL_DEPS = _fields("repo_name s,name s,version s,dep_type s,pos l")
CONFIG_FILES = _fields("repo_name s,path s,config_type s")
RUNS = _fields("repo_name s,model s,context_variant s,status s,raw_text s,summary_text s,latency_ms l,input_tokens l,output_tokens l,cost d,retry_count i,run_at t")

TABLES = {
    "repositories": REPOSITORIES,
    "modules": MODULES,
    "classes": CLASSES,
    "functions": FUNCTIONS,
    "endpoints": ENDPOINTS,
    "db_entities": DB_ENTITIES,
    "import_edges": IMPORT_EDGES,
    "external_deps": EXTERNAL_DEPS,
    "config_files": CONFIG_FILES,
}

# Fixed values of the model.
HTTP_METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "HEAD", "UNKNOWN"]
DEPENDENCY_TYPES = ["runtime", "dev", "peer"]
CONFIG_TYPES = ["build", "env", "framework_config"]
CONTEXT_VARIANTS = ["raw", "dependency_graph", "knowledge_graph"]
FAILURE_TAGS = [
    "fabricated_endpoint",
    "fabricated_technology",
    "missed_endpoint",
    "missed_dependency",
    "missed_framework_or_language",
    "missed_class_or_service",
    "missed_database_entity",
    "over_generic",
    "malformed_output",
]
