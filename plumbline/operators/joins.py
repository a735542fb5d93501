"""Join operators (§2.3) and the size-checked broadcast helper."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import app_cache

#: Bytes of values that :func:`broadcast_bounded` lets a broadcast hold.
MAX_BROADCAST_BYTES = 64 << 20


def row_width(df: DataFrame) -> Column:
    """Bytes of a row's values: strings and binaries by their length, nested
    values by that of their JSON text, others 8 bytes each."""
    def width(f):
        c = F.col("`" + f.name.replace("`", "``") + "`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0))
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        return F.lit(8)
    return reduce(lambda a, b: a + b, [width(f) for f in df.schema.fields], F.lit(0)).cast("long")


def broadcast_bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only after proving it has at most ``max_rows`` rows and
    MAX_BROADCAST_BYTES bytes of values.

    The proof counts rows and sums widths over ``limit(max_rows + 1)``, so it never
    reads more than max_rows + 1 rows. Beyond the bound the frame is returned as is
    and Spark plans a shuffle join (AQE may still convert it at run time from
    measured sizes). Proofs for file-backed frames are remembered per
    canonical plan and input file list (inputs are read-only tables)."""
    files = tuple(sorted(df.inputFiles()))
    key = (df.semanticHash(), files, max_rows) if files else None
    proofs = app_cache(df.sparkSession, "bounds")
    ok = proofs.get(key) if key else None
    if ok is None:
        size = df.select(row_width(df).alias("w")).limit(max_rows + 1).agg(F.count("w"), F.sum("w")).first()
        ok = size[0] <= max_rows and (size[1] or 0) <= MAX_BROADCAST_BYTES
        if key:
            proofs[key] = ok
    return F.broadcast(df) if ok else df


def _keys(on: str | Sequence[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def join_inner(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on=_keys(on), how="inner")


def join_dim(fact: DataFrame, dim: DataFrame, on, max_dim_rows: int = 1_000_000) -> DataFrame:
    """Label lookup against a dimension; broadcast when its size is proven small."""
    return fact.join(broadcast_bounded(dim, max_dim_rows), on=_keys(on), how="inner")


def join_left_flag(left: DataFrame, right: DataFrame, on, flag: str) -> DataFrame:
    """Left join on the *distinct* keys of ``right`` and emit a 0/1 existence
    flag, so duplicate right rows can never fan out the left side."""
    keys = _keys(on)
    marks = right.select(*keys).distinct().withColumn("__hit", F.lit(1))
    return (left.join(marks, on=keys, how="left")
            .withColumn(flag, F.coalesce(F.col("__hit"), F.lit(0)))
            .drop("__hit"))


def join_semi(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on=_keys(on), how="left_semi")


def join_anti(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on=_keys(on), how="left_anti")


def join_matched_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Each id with its side: 'both', 'a_only', 'b_only' (full outer on keys)."""
    ka = a.select(key).distinct().withColumn("__a", F.lit(True))
    kb = b.select(key).distinct().withColumn("__b", F.lit(True))
    j = ka.join(kb, on=key, how="full_outer")
    side = (F.when(F.col("__a") & F.col("__b"), "both")
            .when(F.col("__a"), "a_only").otherwise("b_only"))
    return j.select(key, side.alias("side"))


def join_full_drift(a: DataFrame, b: DataFrame, key: str | Sequence[str], value: str,
                    missing: str = "<missing>") -> DataFrame:
    """Keyed values present on either side whose values differ (null-safe)."""
    keys = _keys(key)
    j = (a.select(*keys, F.col(value).alias("__va"), F.lit(True).alias("__ina"))
         .join(b.select(*keys, F.col(value).alias("__vb"), F.lit(True).alias("__inb")),
               on=keys, how="full_outer"))
    va = F.when(F.col("__ina").isNull(), F.lit(missing)).otherwise(F.col("__va").cast("string"))
    vb = F.when(F.col("__inb").isNull(), F.lit(missing)).otherwise(F.col("__vb").cast("string"))
    return j.where(~va.eqNullSafe(vb)).select(*keys, va.alias("value_a"), vb.alias("value_b"))


def join_asof_dim(fact: DataFrame, dim: DataFrame, keys, fact_date: str, start: str,
                  end: str, attrs: Sequence[str], hot_rows: int = 2_000_000) -> DataFrame:
    """Attach the dimension row in force on ``fact_date`` (start <= d <= end),
    for a dimension whose rows do not overlap within a key.

    A sort-based as-of join, not a range-filtered equi join (which compares
    every fact row with every dimension row of the same key -- quadratic for
    a hot key): dimension and fact rows are unioned, ordered per key by date
    (a dimension row starting that day sorts first), the latest dimension row
    is carried forward (``last(ignorenulls)``), and kept when the fact date
    is within its end. The ordered pass is :func:`keyed_window`, so hot keys
    are split into sub-ranges. Fact rows with no row in force keep null attrs."""
    from plumbline.operators.sequence import keyed_window
    keys = _keys(keys)
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    kc = F.when(known, F.to_json(F.struct(*keys))) if len(keys) > 1 else F.col(keys[0])
    payload = F.struct(F.col(end).alias("__end"), *[F.col(a).alias(a) for a in attrs])
    fcols = fact.columns
    d = dim.where(known).select(kc.alias("__key"), F.col(start).alias("__t"), F.lit(0).alias("__kind"),
                   F.col(end).alias("__e"), payload.alias("__dim"),
                   F.lit(None).cast(fact.select(F.struct(*fcols)).schema[0].dataType).alias("__fact"))
    f = fact.select(kc.alias("__key"), F.col(fact_date).alias("__t"), F.lit(1).alias("__kind"),
                    F.lit(None).cast(dim.select(F.col(end)).schema[0].dataType).alias("__e"),
                    F.lit(None).cast(dim.select(payload).schema[0].dataType).alias("__dim"),
                    F.struct(*fcols).alias("__fact"))
    u = d.unionByName(f)
    # same start day: dimension rows first, shortest first (a zero-length row
    # left by a same-day change never shadows the row in force); the order
    # among fact rows of one day is irrelevant to a forward fill
    filled = keyed_window(u, "__key", ["__t", "__kind", "__e"], ffill=["__dim"], hot_rows=hot_rows)
    r = filled.where(F.col("__kind") == 1)
    inforce = F.col("filled___dim").isNotNull() & (F.col("__t") <= F.col("filled___dim.__end"))
    return r.select("__fact.*", *[F.when(inforce, F.col(f"filled___dim.{a}")).alias(a) for a in attrs])


def explode_list(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    """join_cross_list: pair each row with a literal list via ``explode`` (a
    Generate on the scan, not a nested-loop join)."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def range_spine(df: DataFrame, start: str, end: Column | str, name: str = "month_end") -> DataFrame:
    """join_range_spine: one row per month-end covered by [start, end]."""
    from plumbline.functions.dates import month_end_spine
    return df.withColumn(name, F.explode(month_end_spine(F.col(start),
                                                         F.col(end) if isinstance(end, str) else end)))
