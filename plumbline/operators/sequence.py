"""Skew-safe ordered windows per key.

``keyed_window`` computes, per key in a given order, any of: the next value
(lead), the previous value (lag), the row number, running sums, running minima
and forward fills -- the building blocks of effective-dated history, first-spell
flags, spell linking, ranks and exact quantiles. A plain
``Window.partitionBy(key)`` sorts every row of a key in one task; when one key
holds a large share of the table that task is the job.

The input is computed once, into a written table. If no key holds more than
``hot_rows`` rows the window is the plain one. Otherwise it is a prefix scan
over ranges: the rows are range-partitioned by the key *and the full order*
(plus the row's own number, so that ties may be cut anywhere), and a key that
does not fit one range goes on in the next. The window runs per (key, range),
and what crosses a range's boundary (first and last values, counts, sums) is
carried over from a summary of the keys that lie in several ranges: at most two
rows a range. So no task holds more than one range, whether the hot key is null,
has one date only, or is one of many; there is no cap on keys or ranges. Results
are exact and identical to the plain window."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from plumbline.operators.joins import broadcast_bounded
from plumbline.session import scratch_path

#: Rows of the carry table that may be broadcast; beyond it is joined by shuffle.
MAX_CARRY = 100_000


def stored(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df`` written to the shared scratch folder and read back, with its row
    count, observed while writing."""
    rows, path = Observation(), scratch_path(df.sparkSession, name)
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), rows.get["n"]


def _over(base: DataFrame, by: Sequence[str], order: list[Column], lead, lag, row_number, running_sum,
          running_min, ffill) -> DataFrame:
    """The window results per ``by``, under the names of the result."""
    w = Window.partitionBy(*by).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    new: dict[str, Column] = {f"filled_{c}": F.last(c, ignorenulls=True).over(so_far) for c in ffill}
    new |= {f"next_{c}": F.lead(c).over(w) for c in lead}
    new |= {f"prev_{c}": F.lag(c).over(w) for c in lag}
    if row_number:
        new[row_number] = F.row_number().over(w)
    new |= {name: F.sum(f"__rs_in_{name}").over(so_far) for name in running_sum}
    new |= {name: F.min(f"__rm_in_{name}").over(so_far) for name in running_min}
    return base.withColumns(new)


def keyed_window(df: DataFrame, key: str, order: Sequence[str], lead: Sequence[str] = (),
                 lag: Sequence[str] = (), row_number: str | None = None,
                 running_sum: dict[str, str | Column] | None = None, ffill: Sequence[str] = (),
                 running_min: dict[str, str | Column] | None = None, hot_rows: int = 2_000_000,
                 cheap: bool = False) -> DataFrame:
    """Adds ``next_<c>`` for c in lead, ``prev_<c>`` for c in lag, the row
    number (1-based), running sums and minima (name -> column) and ``filled_<c>``
    (the last non-null value of c so far, i.e. a forward fill), per key in
    ascending ``order`` (nulls first). Null keys form one key. ``hot_rows`` is
    the number of rows that one task may be given of one key. An input that is
    ``cheap`` to compute again (a cached frame) is counted first and written only if
    it has more rows than that."""
    running_sum, running_min = running_sum or {}, running_min or {}
    col = lambda e: F.col(e) if isinstance(e, str) else e
    base = df.withColumns({f"__rs_in_{n}": col(e) for n, e in running_sum.items()}
                          | {f"__rm_in_{n}": col(e) for n, e in running_min.items()})
    asked = (lead, lag, row_number, running_sum, running_min, ffill)
    drop = [c for c in base.columns if c not in df.columns]
    numbered = base.withColumn("__u", F.monotonically_increasing_id())
    by_order = [F.col(c) for c in (*order, "__u")]
    if cheap and base.limit(hot_rows + 1).count() <= hot_rows:
        return _over(numbered, [key], by_order, *asked).drop("__u", *drop)
    src, rows = stored(numbered, "window-input")
    if rows <= hot_rows or src.groupBy(key).count().where(F.col("count") > hot_rows).isEmpty():
        return _over(src, [key], by_order, *asked).drop("__u", *drop)

    # 1. ranges of the full order, each of about hot_rows / 2 rows
    ranges = 2 * math.ceil(rows / hot_rows)
    parts, _ = stored(src.repartitionByRange(ranges, F.col(key), *by_order)
                       .withColumn("__p", F.spark_partition_id()), "window-ranges")

    # 2. keys that lie in several ranges: a range shares its first key and its last
    spans = parts.groupBy(key).agg(F.min("__p").alias("__a"), F.max("__p").alias("__b")).where("__a < __b")
    spans = spans.select(F.col(key).alias("__k"), F.explode(F.sequence("__a", "__b")).alias("__kp"))
    same = F.col(key).eqNullSafe(F.col("__k")) & (F.col("__p") == F.col("__kp"))
    inside = parts.join(broadcast_bounded(spans, MAX_CARRY), same).drop("__k", "__kp")

    # 3. their summary per range, and what each range takes over from those before
    # or, for lead, from the one after; a range of a spanning key is never empty
    place = F.struct(*by_order)
    summary = inside.groupBy(F.col(key).alias("__k"), F.col("__p").alias("__kp")).agg(
        F.count(F.lit(1)).alias("__cnt"), F.min("__u").alias("__any"),
        *[F.min_by(F.col(c), place).alias(f"__first_{c}") for c in lead],
        *[F.max_by(F.col(c), place).alias(f"__last_{c}") for c in lag],
        *[F.sum(f"__rs_in_{n}").alias(f"__sum_{n}") for n in running_sum],
        *[F.min(f"__rm_in_{n}").alias(f"__min_{n}") for n in running_min],
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(f"__fill_{c}") for c in ffill])
    ws = Window.partitionBy("__k").orderBy("__kp")  # one row per (key, range)
    before = ws.rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        "__k", "__kp", "__cnt", F.coalesce(F.sum("__cnt").over(before), F.lit(0)).alias("__off"),
        *[F.lead(f"__first_{c}").over(ws).alias(f"__c_next_{c}") for c in lead],
        *[F.lag(f"__last_{c}").over(ws).alias(f"__c_prev_{c}") for c in lag],
        *[F.sum(f"__sum_{n}").over(before).alias(f"__c_{n}") for n in running_sum],
        *[F.min(f"__min_{n}").over(before).alias(f"__c_{n}") for n in running_min],
        *[F.last(f"__fill_{c}", ignorenulls=True).over(before).alias(f"__c_fill_{c}") for c in ffill])
    carry, n = stored(carry, "window-carry")

    # 4. the window per (key, range), with the carried values at the boundaries
    local = _over(parts, [key, "__p"], by_order, lead, lag, "__pos", running_sum, running_min, ffill)
    out = local.join(F.broadcast(carry) if n <= MAX_CARRY else carry, same, "left")
    new: dict[str, Column] = {}
    for c in lead:  # by position, not by null: a neighbour's own value may be null
        new[f"next_{c}"] = F.when(F.col("__pos") == F.col("__cnt"), F.col(f"__c_next_{c}")).otherwise(F.col(f"next_{c}"))
    for c in lag:
        new[f"prev_{c}"] = F.when((F.col("__pos") == 1) & F.col("__cnt").isNotNull(), F.col(f"__c_prev_{c}")) \
            .otherwise(F.col(f"prev_{c}"))
    if row_number:
        new[row_number] = F.col("__pos") + F.coalesce("__off", F.lit(0))
    for name in running_sum:  # null until the first non-null value of the key
        new[name] = F.when(F.col(name).isNull(), F.col(f"__c_{name}")).otherwise(F.col(name) + F.coalesce(f"__c_{name}", F.lit(0)))
    for name in running_min:
        new[name] = F.least(name, f"__c_{name}")  # the null-free one, if one is null
    for c in ffill:
        new[f"filled_{c}"] = F.coalesce(f"filled_{c}", f"__c_fill_{c}")
    out = out.withColumns(new)
    return out.drop("__u", "__p", "__pos", *[c for c in carry.columns if c not in df.columns], *drop)


def value_ranks(df: DataFrame, value: str, name: str, hot_rows: int = 2_000_000) -> DataFrame:
    """``rank()`` of ``value`` over all rows, largest first and nulls last, without
    a window over all rows: distinct values with their counts, a running sum of
    the counts in order, joined back to the rows."""
    counts = df.groupBy(F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__f")).select(
        "__v", "__f", F.lit(0).alias("__one"), F.col("__v").isNull().alias("__last"), (-F.col("__v")).alias("__desc"))
    cum = keyed_window(counts, "__one", ["__last", "__desc"], running_sum={"__cum": "__f"}, hot_rows=hot_rows, cheap=True)
    ranks = cum.select("__v", (F.col("__cum") - F.col("__f") + 1).cast("long").alias(name))
    return df.join(ranks, F.col(value).eqNullSafe(F.col("__v"))).drop("__v")
