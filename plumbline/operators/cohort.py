"""Cohorts, retention with censoring, Kaplan-Meier, mix/rate decomposition and
ordered funnels (§2.9).

Retention-style operators reduce people to a histogram of follow-up months
first (rows = distinct months, not people x horizons), then evaluate every
horizon on that small frame."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.dates import month_diff
from plumbline.functions.stats import safe_div
from plumbline.operators.joins import broadcast_bounded
from plumbline.operators.sequence import stored
from plumbline.session import cut_lineage, materialize_small


def c_cohort(df: DataFrame, entry: str, key: str, as_of: dt.date) -> DataFrame:
    """Cohort size by entry year, person-distinct; partial = year not over."""
    y = F.year(entry)
    g = df.groupBy(y.cast("long").alias("cohort_year")).agg(F.count_distinct(key).alias("cohort_size"))
    return g.withColumn("partial", F.make_date(F.col("cohort_year").cast("int"), F.lit(12), F.lit(31))
                        > F.lit(as_of))


def first_spell(spells: DataFrame, key: str, entry: str, exit_: str,
                returner_policy: str = "first_spell") -> DataFrame:
    """One row per person: first entry, and the exit that ends observation.

    first_spell: the exit of the first spell (a later return is ignored);
    as_event: the earliest exit of any spell counts as the event."""
    g = spells.groupBy(key).agg(F.min(entry).alias(entry),
                                F.min_by(exit_, F.struct(entry, exit_)).alias("__first_exit"),
                                F.min(exit_).alias("__any_exit"))
    ex = F.col("__first_exit") if returner_policy == "first_spell" else F.col("__any_exit")
    return g.select(key, entry, ex.alias(exit_))


def follow_up(people: DataFrame, entry: str, exit_: str, as_of: dt.date,
              event_type: str | None = None) -> DataFrame:
    """months_observed = month boundaries from entry to exit (or as-of), and
    the separated flag; optional event type carried along."""
    end = F.coalesce(F.col(exit_), F.lit(as_of))
    cols = [month_diff(F.col(entry), end).alias("months"),
            F.col(exit_).isNotNull().cast("int").alias("separated")]
    if event_type:
        cols.append(F.col(event_type).alias("event_type"))
    return people.select(*cols)


def _hist(fu: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    return fu.groupBy("months", "separated", *extra).agg(F.count("*").alias("n"))


def c_retention(people: DataFrame, entry: str, exit_: str, as_of: dt.date,
                horizons: Sequence[int]) -> DataFrame:
    """At-risk (months >= m) and cumulative events (months < m and separated)
    at each horizon. The denominator is the number still observed."""
    h = _hist(follow_up(people, entry, exit_, as_of))
    x = h.withColumn("horizon", F.explode(F.array(*[F.lit(m) for m in horizons])))
    return x.groupBy("horizon").agg(
        F.sum(F.when(F.col("months") >= F.col("horizon"), F.col("n")).otherwise(0)).alias("at_risk"),
        F.sum(F.when((F.col("months") < F.col("horizon")) & (F.col("separated") == 1), F.col("n"))
              .otherwise(0)).alias("cumulative_events"))


def c_censor_flag(people: DataFrame, entry: str, exit_: str, as_of: dt.date,
                  horizons: Sequence[int], drop_ratio: float = 0.8) -> DataFrame:
    """Per horizon: who could reach it at all (as-of minus entry >= m), the
    at-risk count, and flags for censoring and a sharp at-risk drop."""
    base = people.select(month_diff(F.col(entry), F.lit(as_of)).alias("potential"),
                         month_diff(F.col(entry), F.coalesce(F.col(exit_), F.lit(as_of))).alias("months"))
    h = base.groupBy("potential", "months").agg(F.count("*").alias("n"))
    x = h.withColumn("horizon", F.explode(F.array(*[F.lit(m) for m in horizons])))
    g = x.groupBy("horizon").agg(
        F.sum("n").alias("cohort_size"),
        F.sum(F.when(F.col("potential") >= F.col("horizon"), F.col("n")).otherwise(0)).alias("n_could_reach"),
        F.sum(F.when(F.col("months") >= F.col("horizon"), F.col("n")).otherwise(0)).alias("at_risk"))
    prev = F.lag("at_risk").over(Window.orderBy("horizon"))  # one row per horizon
    return g.withColumn("censored", F.col("n_could_reach") < F.col("cohort_size")) \
        .withColumn("sharp_drop", F.coalesce(F.col("at_risk") < prev * drop_ratio, F.lit(False)))


def c_competing(people: DataFrame, entry: str, exit_: str, as_of: dt.date, event_type: str,
                types: Sequence[str], horizons: Sequence[int]) -> DataFrame:
    """Cumulative events split by type; each type censors the others, so all
    share the same at-risk count."""
    h = _hist(follow_up(people, entry, exit_, as_of, event_type), ["event_type"])
    x = h.withColumn("horizon", F.explode(F.array(*[F.lit(m) for m in horizons])))
    ev = (F.col("months") < F.col("horizon")) & (F.col("separated") == 1)
    aggs = [F.sum(F.when(F.col("months") >= F.col("horizon"), F.col("n")).otherwise(0)).alias("at_risk")]
    for t in types:
        aggs.append(F.sum(F.when(ev & (F.col("event_type") == t), F.col("n")).otherwise(0))
                    .alias(f"events_{t.lower()}"))
    return x.groupBy("horizon").agg(*aggs)


def c_km(people: DataFrame, entry: str, exit_: str, as_of: dt.date,
         group: str | None = None) -> DataFrame:
    """Kaplan-Meier survival by month: S(t) = prod over event months u <= t of
    (1 - d_u / n_u), n_u = observed for at least u months. Computed on the
    month histogram with cumulative windows (rows = months per group)."""
    g = [group] if group else []
    cols = [month_diff(F.col(entry), F.coalesce(F.col(exit_), F.lit(as_of))).alias("months"),
            F.col(exit_).isNotNull().cast("int").alias("separated")] + [F.col(c) for c in g]
    h = people.select(*cols).groupBy(*g, "months").agg(
        F.count("*").alias("n_exit_or_censor"), F.sum("separated").alias("events"))
    w_desc = Window.partitionBy(*g).orderBy(F.col("months").desc()) \
        .rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("n_at_risk", F.sum("n_exit_or_censor").over(w_desc))
    w = Window.partitionBy(*g).orderBy("months").rowsBetween(Window.unboundedPreceding, 0)
    q = 1 - F.col("events") / F.col("n_at_risk")
    logs = F.sum(F.when(q > 0, F.log(q)).otherwise(0.0)).over(w)
    zero = F.max(F.when(q <= 0, 1).otherwise(0)).over(w)
    return h.select(*g, F.col("months").cast("long").alias("months"), "n_at_risk",
                    F.col("events").cast("long").alias("events"),
                    F.when(zero == 1, 0.0).otherwise(F.round(F.exp(logs), 6)).alias("survival"))


def c_decompose_frame(df: DataFrame, period: Column, p0, p1, stratum: Column,
                      event: Column) -> DataFrame:
    """Per-stratum n, outcome total, share and rate (or mean) in both periods,
    from one scan with conditional aggregation (no self-join of a CTE).
    ``event`` is a boolean (rates) or a numeric outcome (means). Strata
    present in one period only are kept with n = 0 on the other side."""
    v = event.cast("int") if isinstance(event, Column) and _is_bool(df, event) else event
    g = df.where(period.isin(p0, p1)).groupBy(stratum.alias("stratum")).agg(
        F.count_if(period == p0).alias("n0"), F.sum(F.when(period == p0, v)).alias("e0"),
        F.count_if(period == p1).alias("n1"), F.sum(F.when(period == p1, v)).alias("e1"))
    g = materialize_small(g.fillna(0, ["e0", "e1"]))  # one row per stratum
    t0 = g.select(F.sum("n0")).scalar()
    t1 = g.select(F.sum("n1")).scalar()
    return g.select("stratum", "n0", "e0", "n1", "e1",
                    safe_div("n0", t0).alias("s0"), safe_div("n1", t1).alias("s1"),
                    safe_div("e0", "n0").alias("r0"), safe_div("e1", "n1").alias("r1"))


def _is_bool(df: DataFrame, c: Column) -> bool:
    return dict(df.select(c.alias("__x")).dtypes)["__x"] == "boolean"


def c_decompose(df: DataFrame, period: Column, p0, p1, stratum: Column, event: Column,
                dp: int = 6, scale: float = 100.0) -> DataFrame:
    """Overall change = rate effect + mix effect + interaction.

    base = sum s0 r0, actual = sum s1 r1, rate = sum s0 (r1 - r0),
    mix = sum (s1 - s0) r0, interaction = sum (s1 - s0)(r1 - r0); reported in
    points (``scale`` = 100 for rates, 1 for means). A stratum missing from a
    period contributes 0 there and is counted in ``strata_one_period_only``
    so it never vanishes silently."""
    f = c_decompose_frame(df, period, p0, p1, stratum, event)
    r0, r1 = F.coalesce("r0", F.lit(0.0)), F.coalesce("r1", F.lit(0.0))
    s0, s1 = F.col("s0"), F.col("s1")
    agg = f.agg(F.sum(s0 * r0).alias("b"), F.sum(s1 * r1).alias("a"),
                F.sum(s0 * (r1 - r0)).alias("re"), F.sum((s1 - s0) * r0).alias("me"),
                F.sum((s1 - s0) * (r1 - r0)).alias("ie"), F.count("*").alias("strata"),
                F.count_if((F.col("n0") == 0) | (F.col("n1") == 0)).alias("strata_one_period_only"))
    sc = F.lit(scale)
    return agg.select(F.round(F.col("b") * sc, dp).alias("base_pct"),
                      F.round(F.col("a") * sc, dp).alias("actual_pct"),
                      F.round((F.col("a") - F.col("b")) * sc, dp).alias("change_pts"),
                      F.round(F.col("re") * sc, dp).alias("rate_effect"),
                      F.round(F.col("me") * sc, dp).alias("mix_effect"),
                      F.round(F.col("ie") * sc, dp).alias("interaction"),
                      "strata", "strata_one_period_only")


def c_decompose_strata(df: DataFrame, period: Column, p0, p1, stratum: Column, event: Column,
                       k: int = 5, unstable: int = 30, dp: int = 6) -> DataFrame:
    """The pre-sum frame with each stratum's contributions and a stability
    label on its smaller period n (a mix effect driven by n = 9 is noise); a
    suppressed stratum shows no figure."""
    from plumbline.operators.compare import hide_suppressed
    f = c_decompose_frame(df, period, p0, p1, stratum, event)
    r0, r1 = F.coalesce("r0", F.lit(0.0)), F.coalesce("r1", F.lit(0.0))
    nmin = F.least("n0", "n1")
    stab = F.when(nmin < k, "suppressed").when(nmin < unstable, "unstable").otherwise("stable")
    out = f.select("stratum", "n0", "n1", "e0", "e1",
                    F.round(F.col("s0") * 100, dp).alias("share0_pct"),
                    F.round(F.col("s1") * 100, dp).alias("share1_pct"),
                    F.round(F.col("r0") * 100, dp).alias("rate0_pct"),
                    F.round(F.col("r1") * 100, dp).alias("rate1_pct"),
                    F.round(F.col("s0") * (r1 - r0) * 100, dp).alias("rate_contrib"),
                    F.round((F.col("s1") - F.col("s0")) * r0 * 100, dp).alias("mix_contrib"),
                    stab.alias("stability"))
    return hide_suppressed(out, "stratum")


def _ordered_times(ev: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Per entity the ordered times t_i and whether it has any event of a stage (a_i):
    one shuffle and one sort by time, whatever the number of stages. An event counts
    for its stage if it is later than the least such event of the stage before."""
    so_far = Window.partitionBy("__k").orderBy("__ts").rowsBetween(Window.unboundedPreceding, 0)
    for i, s in enumerate(stages, start=1):
        counts = F.col("__st") == s
        if i > 1:
            counts = counts & (F.col("__ts") > F.min(f"q_{i - 1}").over(so_far))
        ev = ev.withColumn(f"q_{i}", F.when(counts, F.col("__ts")))
    return ev.groupBy("__k").agg(*[F.min(f"q_{i}").alias(f"t_{i}") for i in range(1, len(stages) + 1)], *_any_stage(stages))


def _any_stage(stages: Sequence[str]) -> list[Column]:
    return [F.max((F.col("__st") == s).cast("int")).alias(f"a_{i}") for i, s in enumerate(stages, start=1)]


def _reduced_times(ev: DataFrame, stages: Sequence[str]) -> DataFrame:
    """The same for entities with too many events to sort in one task: one minimum
    per stage, reduced map-side, after the written times of the stage before."""
    reached = cut_lineage(ev.groupBy("__k").agg(
        F.min(F.when(F.col("__st") == stages[0], F.col("__ts"))).alias("t_1"), *_any_stage(stages)))
    for i, s in enumerate(stages[1:], start=2):
        after = ev.where(F.col("__st") == s).join(broadcast_bounded(reached.select("__k", f"t_{i - 1}"), 100_000), "__k")
        nxt = after.where(F.col("__ts") > F.col(f"t_{i - 1}")).groupBy("__k").agg(F.min("__ts").alias(f"t_{i}"))
        reached = cut_lineage(reached.join(nxt, "__k", "left"))
    return reached


def stage_times(events: DataFrame, key: str, ts: str, stage: str, stages: Sequence[str],
                entry_cutoff: Column | None = None, hot_rows: int = 2_000_000) -> DataFrame:
    """Per entity with an event of a stage: the time each stage is reached *in
    order* (t_1 = first occurrence of stage 1, t_k = first occurrence of stage k
    after t_{k-1}; null if not) and whether it has any event of the stage (a_k).

    The stages' events are read once, into a written table. An entity with more than
    ``hot_rows`` of them is reduced stage by stage instead of sorted. ``entry_cutoff``
    keeps the entities whose t_1 is at or before it."""
    ev = events.where(F.col(stage).isin(list(stages)) & F.col(key).isNotNull()) \
        .select(F.col(key).alias("__k"), F.col(ts).alias("__ts"), F.col(stage).alias("__st"))
    ev, rows = stored(ev, "stage-events")
    hot = ev.groupBy("__k").count().where(F.col("count") > hot_rows).select("__k")
    if rows <= hot_rows or hot.isEmpty():
        out = _ordered_times(ev, stages)
    else:
        few = broadcast_bounded(hot, 100_000)
        hot_events, _ = stored(ev.join(few, "__k", "left_semi"), "hot-stage-events")
        names = ["__k", *[f"{c}_{i}" for c in "ta" for i in range(1, len(stages) + 1)]]
        out = _ordered_times(ev.join(few, "__k", "left_anti"), stages).select(names) \
            .union(_reduced_times(hot_events, stages).select(names))
    if entry_cutoff is not None:
        out = out.where(F.col("t_1") <= entry_cutoff)
    return out.withColumnRenamed("__k", key)


def c_funnel(events: DataFrame, key: str, ts: str, stage: str, stages: Sequence[str],
             window_days: int | None = None) -> DataFrame:
    """Ordered funnel on one entering cohort: absolute counts, stage-to-stage
    and cumulative-from-entry rates. With ``window_days`` the cohort is
    truncated to entrants with a full observation window (entry <= max(ts) -
    window)."""
    cutoff = None
    if window_days is not None:
        cutoff = events.select(F.max(ts)).scalar() - F.expr(f"INTERVAL {int(window_days)} DAYS")
    t = stage_times(events, key, ts, stage, stages, cutoff)
    wide = t.agg(*[F.count(f"t_{i}").alias(f"n_{i}") for i in range(1, len(stages) + 1)])
    rows = []
    for i, s in enumerate(stages, start=1):
        prev = F.col(f"n_{i - 1}") if i > 1 else F.col("n_1")
        rows.append(F.struct(F.lit(i).cast("long").alias("stage_order"), F.lit(s).alias("stage"),
                             F.col(f"n_{i}").alias("entered"),
                             F.round(safe_div(F.col(f"n_{i}") * 100, prev), 6).alias("stage_to_stage_pct"),
                             F.round(safe_div(F.col(f"n_{i}") * 100, F.col("n_1")), 6).alias("cumulative_pct")))
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def c_funnel_checks(events: DataFrame, key: str, ts: str, stage: str,
                    stages: Sequence[str]) -> DataFrame:
    """Per stage: entities with any event of the stage, entities reaching it
    in order, the out-of-order remainder (skips / re-entries), and whether
    the ordered counts are monotone non-increasing."""
    t = stage_times(events, key, ts, stage, stages)
    wide = t.agg(*[F.coalesce(F.sum(f"a_{i}"), F.lit(0)).alias(f"a_{i}") for i in range(1, len(stages) + 1)],
                 *[F.count(f"t_{i}").alias(f"n_{i}") for i in range(1, len(stages) + 1)])
    rows = []
    for i, s in enumerate(stages, start=1):
        prev = F.col(f"n_{i - 1}") if i > 1 else F.col("n_1")
        rows.append(F.struct(F.lit(i).cast("long").alias("stage_order"), F.lit(s).alias("stage"),
                             F.col(f"a_{i}").cast("long").alias("with_event"),
                             F.col(f"n_{i}").alias("reached_in_order"),
                             (F.col(f"a_{i}") - F.col(f"n_{i}")).cast("long").alias("out_of_order"),
                             (F.col(f"n_{i}") <= prev).alias("monotone")))
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def c_period_complete(df: DataFrame, date: str, grain: str = "year") -> DataFrame:
    """Rows per period with a completeness flag anchored on the max date
    present (a scalar subquery): the period is complete when its last day is
    on or before that max date."""
    d = F.col(date).cast("date")
    mx = df.select(F.max(date).cast("date")).scalar()
    if grain == "year":
        p = F.year(d).cast("long")
        end = F.make_date(F.year(d), F.lit(12), F.lit(31))
    else:
        p = F.trunc(d, "MM")
        end = F.last_day(d)
    g = df.groupBy(p.alias("period")).agg(F.count("*").alias("n"), F.max(end).alias("period_end"),
                                          F.max(d).alias("last_date"))
    return g.withColumn("complete", F.col("period_end") <= mx)
