"""Tables of a program's aligned views as Spark schemas, and conforming of older shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _schema(ddl: str) -> StructType:
    out = StructType()
    for field in ddl.split(", "):
        name, kind = field.split()
        out = out.add(name, {"bigint": "long", "int": "integer"}.get(kind, kind))
    return out


TABLES: dict[str, StructType] = {
    "tools": _schema("id bigint, name string, version string, extra string"),
    "binaries": _schema("id bigint, filename string, path string, hash_md5 string, hash_sha256 string, arch string, bits int"),
    "binary_views": _schema("id bigint, binary_id bigint, tool_id bigint, output_dir string, image_base bigint, created_at string, config_path string"),
    "segments": _schema("view_id bigint, name string, start_va bigint, end_va bigint, length bigint, perm_r int, perm_w int, perm_x int, raw_perm string"),
    "sections": _schema("view_id bigint, name string, start_va bigint, end_va bigint, length bigint"),
    "symbols": _schema("view_id bigint, name string, address_va bigint, raw_address string, kind string, raw_type string, source string, is_global int, is_primary int, is_external int, namespace string"),
    "strings": _schema("view_id bigint, value string, address_va bigint, length bigint"),
    "functions": _schema("id bigint, view_id bigint, entry_va bigint, name string, raw_file string"),
    "instructions": _schema("view_id bigint, function_id bigint, index_in_function int, address_va bigint, bytes string, mnemonic string, op_str string, raw_line string"),
    "xrefs": _schema("view_id bigint, src_va bigint, dst_va bigint, dst_name string, ref_type_raw string, containing_function string, is_primary int, raw_file string"),
    "pseudo_functions": _schema("view_id bigint, function_id bigint, entry_va bigint, name string, prototype string, body string, raw_file string"),
    "analysis_status": _schema("function_id bigint, analysis_state string, confidence_score int, summary_signature string, semantic_summary string, phase1_pending int, phase2_pending int, lvar_optimized int, annotation_status int, structured_analysis string"),
    "global_vars": _schema("address_va bigint, name string, guessed_type string, analysis_state string, confidence_score int, reasoning string"),
    "graph_nodes": _schema("node_id string, node_type string, entry_va bigint, name string, confidence double"),
    "graph_edges": _schema("source_id string, target_id string, edge_type string, metadata_json string"),
    "predictions": _schema("node_id string, variable string, value string, source string, round int, confidence double"),
    "blackboard": _schema("entry_va bigint, kind string, value string, confidence int, source string, generation int, goal_index int, ts string"),
}
#: Tables that an alignment store has to hold.
REQUIRED = ("tools", "binaries", "binary_views", "symbols", "strings", "functions", "instructions", "xrefs", "pseudo_functions")


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` in the shape of ``table``: columns in order and cast, missing ones null, others dropped."""
    have = set(df.columns)
    return df.select([(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[table]])


def missing_tables(existing: list[str]) -> list[str]:
    """Required tables that aren't among ``existing``."""
    return sorted(set(REQUIRED) - set(existing))
