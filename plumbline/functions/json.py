"""Nested JSON / struct flattening into (path, value) rows (fn_flatten_path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _or_none(part: Column) -> Column:
    """A missing array or map has no leaves; it must not void its siblings."""
    return F.coalesce(part, F.array().cast("array<struct<path:string,value:string>>"))


def _leaves(col: Column, dtype: T.DataType, prefix: str) -> list[Column]:
    """Driver-side walk of the *schema* only (never the data): returns an
    array-of-struct(path, value) Column per subtree. Struct fields are static
    paths; arrays and maps become ``transform`` over their elements."""
    if isinstance(dtype, T.StructType):
        out = []
        for f in dtype.fields:
            p = f"{prefix}.{f.name}" if prefix else f.name
            out += _leaves(col.getField(f.name), f.dataType, p)
        return out
    if isinstance(dtype, T.ArrayType):
        inner = dtype.elementType
        if isinstance(inner, (T.StructType, T.ArrayType, T.MapType)):
            sub = lambda x, i: F.flatten(F.array(*_leaves(x, inner, "")))
            arr = F.transform(col, lambda x, i: F.transform(
                sub(x, i), lambda s: F.struct(F.concat(F.lit(f"{prefix}["), i.cast("string"), F.lit("]"),
                                                       F.when(s["path"] != "", F.concat(F.lit("."), s["path"]))
                                                       .otherwise(F.lit(""))).alias("path"),
                                              s["value"].alias("value"))))
            return [_or_none(F.flatten(arr))]
        return [_or_none(F.transform(col, lambda x, i: F.struct(
            F.concat(F.lit(f"{prefix}["), i.cast("string"), F.lit("]")).alias("path"),
            x.cast("string").alias("value"))))]
    if isinstance(dtype, T.MapType):
        return [_or_none(F.transform(F.map_entries(col), lambda e: F.struct(
            (F.concat(F.lit(f"{prefix}."), e["key"]) if prefix else e["key"].cast("string")).alias("path"),
            e["value"].cast("string").alias("value"))))]
    return [F.array(F.struct(F.lit(prefix).alias("path"), col.cast("string").alias("value")))]


def flatten_column(col: Column, dtype: T.DataType) -> Column:
    parts = _leaves(col, dtype, "")
    return F.flatten(F.array(*parts)) if len(parts) > 1 else parts[0]


def flatten_json(df: DataFrame, id_col: str, json_col: str, schema: str | T.DataType) -> DataFrame:
    """Parse a JSON text column with a declared schema and explode it into
    one (id, path, value) row per leaf, paths like ``a.b[0].c``."""
    dtype = T.DataType.fromDDL(schema) if isinstance(schema, str) else schema
    parsed = F.from_json(json_col, schema if isinstance(schema, str) else dtype.simpleString())
    return df.select(id_col, F.explode(flatten_column(parsed, dtype)).alias("leaf")) \
        .select(id_col, "leaf.path", "leaf.value")
