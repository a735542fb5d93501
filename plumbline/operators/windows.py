"""Window and set primitives (§2.5, §2.6) that need more than one call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def win_share(df: DataFrame, n: str, period: Sequence[str], name: str = "share") -> DataFrame:
    """Share of the period total: n / sum(n) over (partition by period)."""
    return df.withColumn(name, F.col(n) / F.sum(n).over(Window.partitionBy(*period)))


def win_first_spell(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Rank of each entry within its key; the first is flagged, later ones
    are the re-entries (skew-safe ordered window, ties broken by ``order``)."""
    from plumbline.operators.sequence import keyed_window
    out = keyed_window(df, key, list(order), row_number="entry_no")
    return out.withColumn("entry_no", F.col("entry_no").cast("long")).withColumn("is_first", F.col("entry_no") == 1)


def quantile_cuts(df: DataFrame, value: str, probs: Sequence[float]) -> Column:
    """Exact cut points as one scalar subquery (array) from
    :func:`exact_quantiles` (skew-safe)."""
    from plumbline.operators.quantiles import exact_quantiles
    return exact_quantiles(df, value, [], list(probs)).select("__q").scalar()


def win_quantile_bin(df: DataFrame, value: str, probs: Sequence[float] = (0.15, 0.5, 0.85),
                     name: str = "tier") -> DataFrame:
    """Digitise into len(probs)+1 tiers at the quantiles (right-open bins:
    tier i+1 once value >= cut i). Cut points come from one aggregate, so no
    global ntile (which would sort everything in a single partition)."""
    cuts = quantile_cuts(df, value, probs)
    tier = F.lit(1)
    for i in range(len(probs)):
        tier = tier + F.when(F.col(value) >= cuts[i], 1).otherwise(0)
    return df.withColumn(name, tier)


def set_sample(df: DataFrame, key: str, fraction: float, salt: str = "") -> DataFrame:
    """Deterministic sample without replacement: keep a row when the first
    60 bits of md5(salt || key), as a number, fall below fraction * 2^60. Stable
    under repartitioning and re-execution (unlike a seeded ``df.sample``)."""
    h = F.substring(F.md5(F.concat(F.lit(salt), F.col(key).cast("string"))), 1, 15)
    return df.where(F.conv(h, 16, 10).cast("long") < F.lit(round(fraction * 2**60)))
