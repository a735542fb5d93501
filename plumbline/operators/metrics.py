"""Core metrics (§2.8): headcounts, attrition, distributions, survey waves.

Every metric returns numerator, denominator (where there is one) and the
population text next to the figure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.stats import safe_div
from plumbline.operators.population import Population
from plumbline.operators.quantiles import exact_quantiles
from plumbline.session import materialize_small


def m_headcount(df: DataFrame, pop: Population, by: Sequence[str] = (),
                weight: str | None = None, approx_rsd: float | None = None) -> DataFrame:
    """Distinct units in the population, optionally by dimensions / weighted.

    ``approx_rsd`` opts into ``approx_count_distinct`` (HyperLogLog++, fixed
    memory per group) and states its relative standard deviation in the
    output; the default is the exact count."""
    if approx_rsd is not None:
        aggs = [F.approx_count_distinct(pop.key, approx_rsd).alias("headcount")]
        out = pop.apply(df).groupBy(*by).agg(*aggs, *([F.sum(weight).alias("weighted_headcount")] if weight else []))
        return out.withColumn("population", F.lit(pop.text)).withColumn("approx_rsd", F.lit(approx_rsd))
    aggs = [F.count_distinct(pop.key).alias("headcount")]
    if weight:
        aggs.append(F.sum(weight).alias("weighted_headcount"))
    return pop.apply(df).groupBy(*by).agg(*aggs).withColumn("population", F.lit(pop.text))


def m_headcount_variants(df: DataFrame, key: str, variants: dict[str, Column],
                         weight: str | None = None) -> DataFrame:
    """Several population definitions in one pass (conditional aggregates),
    returned long: (variant, headcount[, weighted])."""
    aggs = []
    for name, pred in variants.items():
        aggs.append(F.count_distinct(F.when(pred, F.col(key))).alias(f"n__{name}"))
        if weight:
            aggs.append(F.sum(F.when(pred, F.col(weight))).alias(f"w__{name}"))
    wide = df.agg(*aggs)
    rows = []
    for name in variants:
        cols = [F.lit(name).alias("variant"), F.col(f"n__{name}").alias("headcount")]
        if weight:
            cols.append(F.col(f"w__{name}").cast("double").alias("weighted_headcount"))
        rows.append(F.struct(*cols))
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def m_headcount_by(df: DataFrame, pop: Population, by: str, dim: DataFrame | None = None,
                   dim_key: str | None = None, label: str | None = None) -> DataFrame:
    """Headcount by a dimension, optional label lookup, and a reconcile column:
    the overall distinct count (a scalar subquery) next to every group."""
    from plumbline.operators.joins import broadcast_bounded
    p = pop.apply(df)
    g = p.groupBy(by).agg(F.count_distinct(pop.key).alias("headcount"))
    total = p.select(F.count_distinct(pop.key)).scalar()
    out = g.withColumn("total_headcount", total)
    if dim is not None:
        d = dim.select(F.col(dim_key).alias(by), F.col(label))
        out = out.join(broadcast_bounded(d, 1_000_000), on=by, how="left")
    return out


def m_headcount_trend(snapshot: DataFrame, date: str, key: str) -> DataFrame:
    return snapshot.groupBy(date).agg(F.count_distinct(key).alias("headcount"))


def m_attrition(df: DataFrame, key: str, event_date: str, period: tuple, begin: Column, end: Column,
                event_pop: Column | None = None) -> DataFrame:
    """Separations in [period) divided by beginning, average and ending counts,
    all from ONE pass over ``df`` (conditional distinct counts).

    ``begin`` / ``end`` select the denominator population at the two dates.
    ``event_pop`` restricts the numerator; pass the denominator's population
    so both sides count the same people (the default mode), or ``None`` to
    replay a numerator that counts every worker type."""
    lo, hi = period
    ev = (F.col(event_date) >= F.lit(lo)) & (F.col(event_date) < F.lit(hi))
    if event_pop is not None:
        ev = ev & event_pop
    out = df.agg(F.count_distinct(F.when(ev, F.col(key))).alias("separations"),
                 F.count_distinct(F.when(begin, F.col(key))).alias("beginning_headcount"),
                 F.count_distinct(F.when(end, F.col(key))).alias("ending_headcount"))
    avg = (F.col("beginning_headcount") + F.col("ending_headcount")) / 2.0
    return out.select(
        "separations", "beginning_headcount", "ending_headcount",
        avg.alias("average_headcount"),
        F.round(safe_div(F.col("separations") * 100, "beginning_headcount"), 6).alias("rate_on_beginning_pct"),
        F.round(safe_div(F.col("separations") * 100, avg), 6).alias("rate_on_average_pct"),
        F.round(safe_div(F.col("separations") * 100, "ending_headcount"), 6).alias("rate_on_ending_pct"))


def m_source_panel(candidates, canonical: str) -> DataFrame:
    """One concept from several candidate sources, side by side with the
    canonical figure, the difference and the reason each source differs.

    ``candidates``: ``[(label, one_row_frame, reason)]``; each frame is a
    one-column global aggregate (so the union has one row per source)."""
    rows = None
    canon = None
    for label, frame, reason in candidates:
        r = frame.select(F.lit(label).alias("source"),
                         F.col(frame.columns[0]).cast("long").alias("value"),
                         F.lit(reason).alias("reason"))
        rows = r if rows is None else rows.unionByName(r)
        if label == canonical:
            canon = frame.select(F.col(frame.columns[0]).cast("long")).scalar()
    return rows.select("source", "value", canon.alias("canonical_value"),
                       (F.col("value") - canon).alias("difference"), "reason")


def m_attrition_defs(df: DataFrame, event_date: str, definitions: dict[str, Column],
                     period: tuple, begin: Column, end: Column) -> DataFrame:
    """Separations under several definitions over one named denominator (the
    average of the beginning and ending counts), as period and annualised
    rates -- one aggregate pass over ``df``."""
    lo, hi = period
    days = (hi - lo).days
    in_p = (F.col(event_date) >= F.lit(lo)) & (F.col(event_date) < F.lit(hi))
    wide = df.agg(F.count_if(begin).alias("__b"), F.count_if(end).alias("__e"),
                  *[F.count_if(in_p & c).alias(f"d__{n}") for n, c in definitions.items()])
    long = wide.select(((F.col("__b") + F.col("__e")) / 2.0).alias("average_headcount"), F.explode(F.array(*[
        F.struct(F.lit(n).alias("definition"), F.col(f"d__{n}").cast("long").alias("separations"))
        for n in definitions])).alias("r")).select("r.*", "average_headcount")
    rate = safe_div(F.col("separations") * 100, F.col("average_headcount"))
    return long.select("definition", "separations", "average_headcount",
                       F.lit(days).cast("long").alias("period_days")) \
        .withColumn("period_rate_pct", F.round(rate, 6)) \
        .withColumn("annualised_rate_pct", F.round(rate * 365.0 / days, 6))


def m_attrition_month(events: DataFrame, event_date: str, snapshot: DataFrame, snap_date: str,
                      dims: Sequence[str]) -> DataFrame:
    """Monthly separations by dims with the denominator the rollup lacks: the
    headcount at the previous month-end."""
    seps = events.groupBy(F.last_day(event_date).alias("month_end"), *dims) \
        .agg(F.count("*").alias("separations"))
    hc = snapshot.groupBy(F.col(snap_date).alias("__prev"), *dims).agg(F.count("*").alias("start_headcount"))
    j = seps.withColumn("__prev", F.last_day(F.add_months("month_end", -1))) \
        .join(hc, on=["__prev", *dims], how="left")
    return j.select("month_end", *dims, "separations", "start_headcount",
                    F.round(safe_div(F.col("separations") * 100, "start_headcount"), 6).alias("rate_pct"))


def m_tenure(linked: DataFrame, person: str, start: str, spell_no: str, as_of) -> DataFrame:
    """Current-spell tenure vs continuous service since the first spell (the
    naive current-spell figure understates returners' service)."""
    p = linked.groupBy(person, spell_no).agg(F.min(start).alias("__s0"))
    d = F.lit(as_of)
    return p.groupBy(person).agg(
        F.max(spell_no).cast("long").alias("n_spells"),
        F.datediff(d, F.max("__s0")).cast("long").alias("current_spell_days"),
        F.datediff(d, F.min("__s0")).cast("long").alias("service_days"),
        (F.max(spell_no) > 1).alias("returner"))


def m_people_ever(df: DataFrame, record: str, person: str) -> DataFrame:
    """Distinct records vs distinct persons; the difference is duplicate humans."""
    return df.agg(F.count_distinct(record).alias("distinct_records"),
                  F.count_distinct(person).alias("distinct_persons")) \
        .withColumn("duplicates", F.col("distinct_records") - F.col("distinct_persons"))


def m_dist(df: DataFrame, value: str, by: Sequence[str] = (), min_n: int = 5,
           dp: int = 6) -> DataFrame:
    """n, mean, median, p25, p75, sd per group; quantiles suppressed when n < min_n.

    Exact quantiles come from :func:`exact_quantiles` (frequency pre-aggregate,
    or rank-band refinement for groups with very many distinct values), so no
    task ever buffers a hot group's raw values."""
    keys = list(by)
    q = exact_quantiles(df, value, keys, [0.25, 0.5, 0.75])
    mom = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                                F.stddev_samp(value).alias("sd"))
    if keys:
        out = mom.join(q, on=keys, how="left")
    else:
        out = mom.withColumn("__q", q.select("__q").scalar())
    small = F.col("n") < min_n
    return out.select(
        *keys, "n", F.round("mean", dp).alias("mean"),
        F.when(~small, F.round(F.col("__q")[1], dp)).alias("median"),
        F.when(~small, F.round(F.col("__q")[0], dp)).alias("p25"),
        F.when(~small, F.round(F.col("__q")[2], dp)).alias("p75"),
        F.round("sd", dp).alias("sd"),
        F.round(F.col("mean") - F.col("__q")[1], dp).alias("mean_minus_median"))


def convert_currency(df: DataFrame, value: str, currency: str, rates: DataFrame, rate_col: str,
                     out: str = "value_base") -> DataFrame:
    """Optional rate-table join for pay in several currencies: ``out`` =
    value x rate of its currency (rates: currency -> rate, a small,
    size-checked frame). A currency missing from the table gives null, so
    the row is kept and cannot be pooled silently."""
    from plumbline.operators.joins import broadcast_bounded
    r = rates.select(F.col(rates.columns[0]).alias("__cur"), F.col(rate_col).alias("__rate"))
    j = df.join(broadcast_bounded(r, 100_000), F.col(currency) == F.col("__cur"), "left")
    return j.withColumn(out, F.col(value) * F.col("__rate")).drop("__cur", "__rate")


def m_share(df: DataFrame, flag_col: Column | str, by: Sequence[str] = ()) -> DataFrame:
    f = F.col(flag_col) if isinstance(flag_col, str) else flag_col
    return df.groupBy(*by).agg(F.sum(f.cast("long")).alias("num"), F.count("*").alias("den")) \
        .withColumn("share_pct", F.round(safe_div(F.col("num") * 100, "den"), 6))


def m_wave(df: DataFrame, item: str, value: str, scale: str, time: Column | str) -> DataFrame:
    """Mean, n and response scale per (item, wave)."""
    t = F.col(time) if isinstance(time, str) else time
    return (df.groupBy(F.col(item).alias("item"), t.alias("wave"), F.col(scale).alias("scale_max"))
            .agg(F.round(F.avg(value), 6).alias("mean"), F.count("*").alias("n")))


def m_wave_rescaled(df: DataFrame, item: str, value: str, scale: str, time: Column | str) -> DataFrame:
    """Scores put on 0-1 via (x-1)/(scale-1); flags items whose waves mix scales,
    where a raw cross-wave trend must be refused."""
    t = F.col(time) if isinstance(time, str) else time
    g = (df.groupBy(F.col(item).alias("item"), t.alias("wave"), F.col(scale).alias("scale_max"))
         .agg(F.round(F.avg(value), 6).alias("raw_mean"),
              F.round(F.avg((F.col(value) - 1) / (F.col(scale) - 1)), 6).alias("rescaled_mean"),
              F.count("*").alias("n")))
    w = Window.partitionBy("item")
    return g.withColumn("scales_in_item", F.size(F.collect_set("scale_max").over(w))) \
        .withColumn("raw_trend_valid", F.col("scales_in_item") == 1)


def m_response_rate(responses: DataFrame, eligible: DataFrame, wave: str, key: str) -> DataFrame:
    """Distinct respondents / distinct eligible per wave (full outer on wave)."""
    r = responses.groupBy(wave).agg(F.count_distinct(key).alias("respondents"))
    e = eligible.groupBy(wave).agg(F.count_distinct(key).alias("eligible"))
    return (e.join(r, on=wave, how="full_outer")
            .select(wave, F.coalesce("respondents", F.lit(0)).alias("respondents"),
                    F.coalesce("eligible", F.lit(0)).alias("eligible"))
            .withColumn("response_rate_pct",
                        F.round(safe_div(F.col("respondents") * 100, "eligible"), 6)))


def m_composite(df: DataFrame, person: str, wave: str, item: str, value: str,
                min_items: int) -> DataFrame:
    """Composite per (person, wave) = mean of the person's item means, so a
    repeatedly answered item does not outweigh the others; null when fewer
    than ``min_items`` distinct items were answered."""
    im = df.groupBy(person, wave, item).agg(F.avg(value).alias("__m"))
    g = im.groupBy(person, wave).agg(F.count("*").alias("n_items"), F.avg("__m").alias("__c"))
    return g.select(person, wave, "n_items",
                    F.when(F.col("n_items") >= min_items, F.round("__c", 6)).alias("composite"))


def m_representativeness(sample: DataFrame, population: DataFrame, dim: str) -> DataFrame:
    """Share of each category in the sample vs the population, and the gap."""
    s = sample.groupBy(dim).agg(F.count("*").alias("n_sample"))
    p = population.groupBy(dim).agg(F.count("*").alias("n_population"))
    j = p.join(s, on=dim, how="full_outer").fillna(0, ["n_sample", "n_population"])
    j = materialize_small(j)  # one row per category
    ss = safe_div(F.col("n_sample"), j.select(F.sum("n_sample")).scalar())
    ps = safe_div(F.col("n_population"), j.select(F.sum("n_population")).scalar())
    return j.select(dim, "n_sample", "n_population",
                    F.round(ss * 100, 6).alias("sample_share_pct"),
                    F.round(ps * 100, 6).alias("population_share_pct"),
                    F.round((ss - ps) * 100, 6).alias("share_gap_pts"))


def m_outliers(df: DataFrame, value: str, by: Sequence[str] = (), k: float = 1.5) -> DataFrame:
    """Tukey fences per group (exact quartiles on a frequency pre-aggregate),
    with the mean including and excluding values outside the fences."""
    keys = list(by)
    q = exact_quantiles(df, value, keys, [0.25, 0.75])
    iqr = F.col("__q")[1] - F.col("__q")[0]
    fences = q.select(*keys, (F.col("__q")[0] - k * iqr).alias("lo_fence"),
                      (F.col("__q")[1] + k * iqr).alias("hi_fence"))
    if keys:
        j = df.join(fences, on=keys)  # one row per group; AQE broadcasts it when small
    else:
        j = df.withColumn("lo_fence", fences.select("lo_fence").scalar()) \
              .withColumn("hi_fence", fences.select("hi_fence").scalar())
    inside = (F.col(value) >= F.col("lo_fence")) & (F.col(value) <= F.col("hi_fence"))
    return j.groupBy(*keys, "lo_fence", "hi_fence").agg(
        F.count(value).alias("n"),
        F.count_if(~inside).alias("n_outside"),
        F.round(F.avg(value), 6).alias("mean_all"),
        F.round(F.avg(F.when(inside, F.col(value))), 6).alias("mean_trimmed")) \
        .withColumn("lo_fence", F.round("lo_fence", 6)).withColumn("hi_fence", F.round("hi_fence", 6))
