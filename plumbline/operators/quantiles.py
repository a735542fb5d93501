"""Exact grouped quantiles (continuous interpolation, like ``quantile_cont``)
that stay skew-safe.

Values are pre-aggregated to (group, value) -> count map-side, so a value that
holds most of the rows is one row. Groups with at most ``max_band`` distinct
values use ``percentile(value, p, count)``, whose state is that many pairs.
Groups with more (only hot groups) are answered by rank selection on the pairs:
a running sum of the counts in value order, as a prefix scan over ranges
(:func:`plumbline.operators.sequence.keyed_window`), gives each value the ranks
that it holds, and each wanted rank is read from the one value that holds it.
No task and no row ever holds a group, and no number of groups or of equal
values is refused."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.joins import broadcast_bounded
from plumbline.operators.sequence import keyed_window
from plumbline.session import materialize_small

#: Big groups whose row counts may be broadcast; more are joined by shuffle.
MAX_BROADCAST = 100_000


def _small(pairs: DataFrame, probs: Sequence[float]) -> DataFrame:
    return pairs.groupBy("__g").agg(F.percentile("__v", F.array(*[F.lit(float(p)) for p in probs]), F.col("__f")).alias("__q"))


def rank_selected(pairs: DataFrame, sizes: DataFrame, probs: Sequence[float], hot_rows: int) -> DataFrame:
    """(__g, __q) of the (__g, __v, __f) pairs, for the groups of ``sizes`` (__k, __n)."""
    scan = keyed_window(pairs, "__g", ["__v"], running_sum={"__cum": "__f"}, hot_rows=hot_rows)
    held = scan.join(broadcast_bounded(sizes, MAX_BROADCAST), F.col("__g") == F.col("__k"))

    def at(rank: Column) -> Column:
        """The value of the 0-based rank: the one whose counts reach past it."""
        return F.max(F.when((F.col("__cum") - F.col("__f") <= rank) & (rank < F.col("__cum")), F.col("__v")))

    wanted = [F.lit(float(p)) * (F.col("__n") - 1) for p in probs]
    ends = held.groupBy("__g").agg(
        F.max("__n").alias("__n"), *[at(F.floor(pos)).alias(f"__lo{i}") for i, pos in enumerate(wanted)],
        *[at(F.ceil(pos)).alias(f"__hi{i}") for i, pos in enumerate(wanted)])
    between = [F.col(f"__lo{i}") + (pos - F.floor(pos)) * (F.col(f"__hi{i}") - F.col(f"__lo{i}"))
               for i, pos in enumerate(wanted)]
    return ends.select("__g", F.array(*between).alias("__q"))


def exact_quantiles(df: DataFrame, value: str, by: Sequence[str], probs: Sequence[float],
                    max_band: int = 1_000_000, hot_rows: int = 2_000_000) -> DataFrame:
    """(by..., __q: array of quantiles in ``probs`` order) per group; null labels
    are groups of their own. Without grouping columns there is one group. ``max_band``
    is the number of distinct values that one task may hold of one group."""
    d = df.where(F.col(value).isNotNull()).select(
        F.struct(*[F.col(c) for c in by], F.lit(0).alias("__all")).alias("__g"), F.col(value).cast("double").alias("__v"))
    pairs = d.groupBy("__g", "__v").agg(F.count(F.lit(1)).alias("__f"))
    sizes = materialize_small(d.groupBy(F.col("__g").alias("__k")).agg(
        F.count(F.lit(1)).alias("__n"), F.approx_count_distinct("__v").alias("__nd")))
    big = sizes.where(F.col("__nd") > max_band).select("__k", "__n")
    if big.isEmpty():
        out = _small(pairs, probs)
    else:
        some = broadcast_bounded(big, MAX_BROADCAST)
        is_big = F.col("__g") == F.col("__k")
        small = _small(pairs.join(some.select("__k"), is_big, "left_anti"), probs)
        out = small.unionByName(rank_selected(pairs.join(some.select("__k"), is_big, "left_semi"), big, probs, hot_rows))
    return out.select(*[F.col(f"__g.{c}").alias(c) for c in by], "__q")
