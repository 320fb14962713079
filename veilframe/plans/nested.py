"""Texts inside structs, arrays, maps and JSON: every one with the path it lies under.

A walk over the schema writes one expression that gathers the (path, text) pairs of a row, so a table is read once and
only columns that can hold texts are read.  JSON, in string columns that the caller names or in VARIANT
columns anywhere, has no schema to walk: its objects and arrays are opened level by level by Spark's own
generator.  What lies deeper than ``max_depth`` levels is kept as one text, so nothing is left out.

Paths: ``column.field`` for structs and objects, ``column[]`` for the items of arrays, ``column{}`` for the values of a map
and ``column{key}`` for its keys.  A string that is no JSON is a text of its column.  NULL is no text.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, CharType, DataType, MapType, StringType, StructType, VarcharType, VariantType

from veilframe.functions.sqltext import ident, lit
from veilframe.plans.jobs import type_counts
from veilframe.plans.protect import with_spans

MAX_DEPTH = 8
_LEAF = "struct<path:string,value:string,json:variant>"
_NONE = f"cast(array() as array<{_LEAF}>)"


def _walk(value: str, kind: DataType, path: str, json: bool, depth: int = 0) -> str | None:
    """The pairs below ``value`` as an array expression, or None if its type holds no text."""
    def leaf(text: str, parsed: str) -> str:
        return f"array(struct({lit(path)} as path, {text} as value, {parsed} as json))"

    if isinstance(kind, VariantType):
        return leaf("cast(null as string)", value)
    if isinstance(kind, (StringType, VarcharType, CharType)):
        if not json:
            return leaf(f"cast({value} as string)", "cast(null as variant)")
        tried = f"try_parse_json(cast({value} as string))"
        return f"transform(array({tried}), v{depth} -> {leaf(f'if(v{depth} is null, cast({value} as string), null)', f'v{depth}')}[0])"
    if isinstance(kind, StructType):
        parts = [_walk(f"{value}.{ident(f.name)}", f.dataType, f"{path}.{f.name}", json, depth) for f in kind.fields]
        parts = [p for p in parts if p]
        if not parts:
            return None
        return parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"
    if isinstance(kind, ArrayType):
        inner = _walk(f"x{depth}", kind.elementType, f"{path}[]", json, depth + 1)
        return inner and f"coalesce(flatten(transform({value}, x{depth} -> {inner})), {_NONE})"
    if isinstance(kind, MapType):
        entry = f"e{depth}"
        parts = [_walk(f"{entry}.key", kind.keyType, f"{path}{{key}}", json, depth + 1),
                 _walk(f"{entry}.value", kind.valueType, f"{path}{{}}", json, depth + 1)]
        parts = [p for p in parts if p]
        if not parts:
            return None
        inner = parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"
        return f"coalesce(flatten(transform(map_entries({value}), {entry} -> {inner})), {_NONE})"
    return None


def text_leaves(
    df: DataFrame, columns: Sequence[str] | None = None, *, json_columns: Sequence[str] = (),
    max_depth: int = MAX_DEPTH, numbers: bool = False, keep: Sequence[str] = (),
) -> DataFrame:
    """One row per text in the named columns (all by default): ``keep``, path, value.

    ``json_columns`` are parsed.  ``numbers`` also gives the numbers in JSON, as texts: account numbers may be
    stored as such.  A kept column may not be named path or value.
    """
    clash = {"path", "value", "json"} & set(keep)
    if clash:
        raise ValueError(f"kept columns have names of results: {', '.join(sorted(clash))}")
    unknown = sorted(set(json_columns) - set(df.columns))
    if unknown:
        raise ValueError(f"no such columns: {', '.join(unknown)}")
    wanted = [f for f in df.schema.fields if (columns is None and f.name not in keep) or f.name in (columns or ())]
    parts = [_walk(ident(f.name), f.dataType, f.name, f.name in json_columns) for f in wanted]
    parts = [p for p in parts if p]
    kept = [F.col(ident(c)) for c in keep]
    every = f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0] if parts else _NONE
    leaves = df.select(*kept, F.expr(f"explode({every})").alias("leaf")).select(*kept, "leaf.path", "leaf.value", "leaf.json")
    parsed = bool(json_columns) or _has_variant(StructType(wanted))
    if not parsed:
        return leaves.where("value is not null").drop("json")
    leaves = leaves.where("value is not null or json is not null")
    opened = df.sparkSession.tvf.variant_explode_outer(F.col("json").outer())
    for _ in range(max_depth):
        leaves = leaves.lateralJoin(opened.toDF("_pos", "_key", "_item")).select(
            *kept,
            F.when(F.col("_pos").isNull(), F.col("path")).when(F.col("_key").isNotNull(), F.concat("path", F.lit("."), "_key"))
            .otherwise(F.concat("path", F.lit("[]"))).alias("path"),
            "value", F.when(F.col("_pos").isNull(), F.col("json")).otherwise(F.col("_item")).alias("json"))
    kind = F.schema_of_variant("json")
    is_number = kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE", "FLOAT")
    scalar = kind == "STRING"
    if numbers:
        scalar |= is_number
    # Containers that are still closed are texts as they are written; empty ones hold none.
    deep = (kind.startswith("OBJECT") | kind.startswith("ARRAY")) & ~kind.isin("OBJECT<>", "ARRAY<VOID>")
    text = F.coalesce("value", F.when(scalar, F.col("json").cast("string")).when(deep, F.to_json("json")))
    return leaves.select(*kept, "path", text.alias("value")).where("value is not null")


def _has_variant(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(_has_variant(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return _has_variant(kind.elementType)
    if isinstance(kind, MapType):
        return _has_variant(kind.keyType) or _has_variant(kind.valueType)
    return isinstance(kind, VariantType)


def path_profile(
    df: DataFrame, columns: Sequence[str] | None = None, *, json_columns: Sequence[str] = (),
    max_depth: int = MAX_DEPTH, numbers: bool = False, **settings: Any,
) -> DataFrame:
    """Which paths of a table hold which entity types: texts affected and spans."""
    leaves = text_leaves(df, columns, json_columns=json_columns, max_depth=max_depth, numbers=numbers)
    counts = type_counts(with_spans(leaves, "value", **settings), ["path"])
    return counts.groupBy("path", "entity_type").agg(
        F.count(F.lit(1)).alias("values_affected"), F.sum("n").alias("entities"))
