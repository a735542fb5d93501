"""Provenance (§2.12): source tier of an answer, tier mix over time, and the
result-level footer record assembled from data and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.stats import safe_div
from plumbline.operators.joins import broadcast_bounded

# Source tiers and their labels; the lowest tier touched wins.
TIER_LABELS = [(1, "semantic layer"), (2, "governed table"), (3, "raw exploration")]
# Confidence follows the process, by tier.
CONFIDENCE_BY_TIER = [(1, "High"), (2, "Medium"), (3, "Low")]


def _label(tier: Column) -> Column:
    e = None
    for t, lab in TIER_LABELS:
        e = F.when(tier == t, lab) if e is None else e.when(tier == t, lab)
    return e


def _confidence(tier: Column) -> Column:
    e = None
    for t, lab in CONFIDENCE_BY_TIER:
        e = F.when(tier == t, lab) if e is None else e.when(tier == t, lab)
    return e


def a_source_tier(answer_sources: DataFrame, answer: Sequence[str], source: str,
                  tiers: DataFrame, tier_source: str, tier_col: str) -> DataFrame:
    """Per answer: the lowest tier (highest tier number) among all sources it
    touched, its label and the confidence that tier allows. Sources missing
    from the tier table count as raw exploration (tier 3)."""
    t = broadcast_bounded(tiers.select(F.col(tier_source).alias(source), F.col(tier_col).alias("__tier")),
                          100_000)
    j = answer_sources.join(t, source, "left").withColumn("__tier", F.coalesce("__tier", F.lit(3)))
    g = j.groupBy(*answer).agg(F.max("__tier").alias("tier"), F.count_distinct(source).alias("n_sources"))
    return g.withColumn("source_label", _label(F.col("tier"))) \
        .withColumn("confidence", _confidence(F.col("tier")))


def a_tier_share(answers: DataFrame, time: str, tier: str = "tier", dp: int = 6) -> DataFrame:
    """Share of answers at each tier per period (counts and percent)."""
    g = answers.groupBy(time).agg(F.count("*").alias("answers"),
                                  *[F.count_if(F.col(tier) == t).alias(f"tier{t}") for t, _ in TIER_LABELS])
    for t, _ in TIER_LABELS:
        g = g.withColumn(f"tier{t}_pct", F.round(safe_div(F.col(f"tier{t}") * 100, "answers"), dp))
    return g


def a_footer(source_label: Column, source_name: str, confidence: Column, reviewed: str,
             freshness: Column, owner: str, population: str, assumptions: str,
             suppressed_cells: Column, base: DataFrame) -> DataFrame:
    """The provenance record of one result as a one-row frame; every data
    field (tier, freshness, suppressed cells) is a scalar computed from the
    data, not typed in."""
    caveats = F.when(suppressed_cells > 0,
                     F.format_string("%d suppressed cell(s) (n < 5)", suppressed_cells)).otherwise("none")
    return base.agg(F.count("*").alias("result_rows")).select(
        F.concat(source_label, F.lit(" - "), F.lit(source_name)).alias("source"),
        confidence.alias("confidence"), F.lit(reviewed).alias("reviewed"),
        F.concat(F.lit("data through "), F.date_format(freshness, "yyyy-MM-dd")).alias("freshness"),
        F.lit(owner).alias("owner"), F.lit(population).alias("population"),
        F.lit(assumptions).alias("open_assumptions"), caveats.alias("caveats"), "result_rows")
