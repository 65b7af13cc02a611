"""Explicit schemas of the fact tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FACTS = {
    "kv": "key string, seq bigint, value binary",
    "types": "type_id string, kind string, width int, sign boolean, target_id string, elem_count bigint, csu string, varargs boolean, arg_ids array<string>",
    "csus": "csu string, kind string, width int",
    "csu_fields": "csu string, pos int, field string, type_id string, offset int",
    "csu_methods": "csu string, pos int, field string, base string, function string",
    "exps": "exp_id string, kind string, op string, child_ids array<string>, var struct<kind:string,name:string,index:int,function:string>, field string, type_id string, int_val decimal(38,0), bits int, sign boolean, text string",
    "bits": "bit_id string, kind string, exp_id string, child_ids array<string>",
    "blocks": "block_id string, kind string, function string, loop string, version bigint, file string, begin_line int, end_line int, command string, entry_point int, exit_point int",
    "points": "block_id string, point int, file string, line int, loop_isomorphic boolean",
    "edges": "block_id string, edge_idx int, kind string, source int, target int, cond string, nonzero boolean, type_id string, lhs string, rhs string, ret string, instance string, callee string, func_exp string, args array<string>, loop_id string, annot_id string",
    "annotations": "owner string, owner_kind string, name string, kind string, bit_id string",
    "call_edges": "caller string, block_id string, point int, version bigint, callee string, rfld_chain string",
    "escape_edges": "source string, forward boolean, target string, block_id string, point int, version bigint, move_caller boolean, move_callee boolean",
    "escape_accesses": "value string, kind string, target string, block_id string, point int, version bigint, field string",
    "asserts": "block_id string, kind string, cls string, point int, bit_id string, name string",
    "assumes": "block_id string, annot string, point int, bit_id string",
    "files": "file string, source string, preprocessed string",
    "worklist": "stage string, ord bigint, file string, function string",
}


def read_facts(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A fact table from Parquet or line-delimited JSON under root/name, with its schema."""
    reader = spark.read.schema(FACTS[name])
    return reader.json(f"{root}/{name}.json") if root.endswith("json") else reader.parquet(f"{root}/{name}")


def write_facts(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> None:
    df.select(*(c for c in df.sparkSession.createDataFrame([], FACTS[name]).columns)).write.mode(mode).parquet(f"{root}/{name}")
