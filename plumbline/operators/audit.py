"""Table and query-result audits (§2.12).

Each audit returns findings as a DataFrame; a clean input yields zero finding
rows (or a passing summary), a corrupted one fires. Fan-out is computed
algebraically from per-key counts, never by materialising the join."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.stats import safe_div, wilson_bounds
from plumbline.session import materialize_small


def _keys(on) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def a_fanout(left: DataFrame, right: DataFrame, on, dp: int = 6) -> DataFrame:
    """Rows before and after an inner equi join and the inflation factor:
    joined = sum over keys of nL * nR (null keys never match)."""
    keys = _keys(on)
    nl = left.groupBy(*keys).agg(F.count("*").alias("nl"))
    nr = right.where(F.coalesce(*[F.col(k).isNotNull() for k in keys])).groupBy(*keys) \
        .agg(F.count("*").alias("nr"))
    joined = nl.join(nr, keys).select(F.sum(F.col("nl") * F.col("nr"))).scalar()
    rrows = right.select(F.count("*")).scalar()
    return nl.agg(F.coalesce(F.sum("nl"), F.lit(0)).cast("long").alias("left_rows")) \
        .withColumn("right_rows", rrows) \
        .withColumn("joined_rows", F.coalesce(joined, F.lit(0)).cast("long")) \
        .withColumn("inflation_factor", F.round(safe_div("joined_rows", "left_rows"), dp))


def a_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Is ``keys`` unique at this grain: rows, distinct keys, duplicated keys
    and the worst multiplicity."""
    g = df.groupBy(*keys).agg(F.count("*").alias("c"))
    return g.agg(F.sum("c").alias("rows"), F.count("*").alias("distinct_keys"),
                 F.count_if(F.col("c") > 1).alias("duplicated_keys"), F.max("c").alias("max_rows_per_key")) \
        .withColumn("is_unique", F.col("rows") == F.col("distinct_keys"))


def a_record_person(df: DataFrame, record: str, person: str) -> DataFrame:
    """Persons carrying more than one record key (rehire-style duplicates)."""
    g = df.groupBy(person).agg(F.count_distinct(record).alias("r"))
    return g.agg(F.count("*").alias("persons"), F.sum("r").alias("records"),
                 F.count_if(F.col("r") > 1).alias("persons_with_multiple_records"),
                 F.max("r").alias("max_records_per_person"))


def a_coverage(df: DataFrame, col: str, pop: Column | None = None, by: Sequence[str] = (),
               dp: int = 6) -> DataFrame:
    """Populated share of a column (optionally within a population and by
    groups): total rows, populated, dropped by a cut on it, percent."""
    d = df if pop is None else df.where(pop)
    return d.groupBy(*by).agg(F.count("*").alias("rows_total"), F.count(col).alias("rows_populated")) \
        .withColumn("rows_dropped", F.col("rows_total") - F.col("rows_populated")) \
        .withColumn("pct_populated", F.round(safe_div(F.col("rows_populated") * 100, "rows_total"), dp))


def a_superseded(df: DataFrame, old: str, new: str) -> DataFrame:
    """Cutting by a superseded column vs its replacement: per replacement
    group the rows a cut on the old column loses, and groups that vanish."""
    return df.groupBy(new).agg(F.count("*").alias("rows"), F.count(old).alias("rows_with_old")) \
        .withColumn("rows_lost", F.col("rows") - F.col("rows_with_old")) \
        .withColumn("vanishes", F.col("rows_with_old") == 0)


def a_nulls(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Null count per column in one aggregate, unpivoted to (column, n_null)."""
    wide = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot(["rows"], list(cols), "column", "n_null") \
        .select("column", "rows", "n_null")


def a_null_drop(left: DataFrame, right: DataFrame, on, predicate: Column | None = None) -> DataFrame:
    """What an inner join (and optionally a comparison predicate) silently
    drops: left rows without a match, left rows with a null key, and rows
    where the predicate is unknown (three-valued logic)."""
    keys = _keys(on)
    rk = right.select(*keys).distinct()
    nullkey = F.lit(False)
    for k in keys:
        nullkey = nullkey | F.col(k).isNull()
    aggs = [F.count("*").alias("left_rows"), F.count_if(nullkey).alias("null_key_rows")]
    if predicate is not None:
        aggs.append(F.count_if(predicate.isNull()).alias("predicate_unknown_rows"))
    base = left.agg(*aggs)
    dropped = left.join(rk, keys, "left_anti").select(F.count("*")).scalar()
    return base.withColumn("dropped_by_inner_join", dropped) \
        .withColumn("matched_rows", F.col("left_rows") - F.col("dropped_by_inner_join"))


def a_fresh(tables: dict[str, tuple[DataFrame, str]], max_lag_days: int,
            as_of=None) -> DataFrame:
    """Latest date per table and its lag behind the as-of (default: the
    freshest table), with a stale flag."""
    rows = None
    for name, (df, col) in tables.items():
        r = df.agg(F.max(F.col(col)).cast("date").alias("max_date")).select(F.lit(name).alias("table_name"),
                                                                           "max_date")
        rows = r if rows is None else rows.unionByName(r)
    rows = materialize_small(rows)
    ref = F.lit(as_of) if as_of is not None else rows.select(F.max("max_date")).scalar()
    lag = F.datediff(ref, F.col("max_date")).cast("long")
    return rows.withColumn("lag_days", lag).withColumn("stale", lag > max_lag_days)


def a_value_set(df: DataFrame, filters: dict[str, tuple[str, Sequence]]) -> DataFrame:
    """For each filter (column IN values): the values the column takes with
    counts and whether they pass, plus rows passing all filters and rows
    passing when that one filter is left out. One scan: the input is grouped
    by the combination of filter columns (bounded by their value domains),
    and everything is derived from that small frame."""
    cols = list(dict.fromkeys(c for c, _ in filters.values()))
    combos = materialize_small(df.groupBy(*cols).agg(F.count("*").alias("__n")))
    conds = {n: F.col(c).isin(list(v)) for n, (c, v) in filters.items()}

    def all_but(skip):
        c = F.lit(True)
        for m, cm in conds.items():
            if m != skip:
                c = c & cm
        return c
    n_all = combos.select(F.sum(F.when(all_but(None), F.col("__n")).otherwise(0))).scalar()
    out = None
    for n, (c, vals) in filters.items():
        loo = combos.select(F.sum(F.when(all_but(n), F.col("__n")).otherwise(0))).scalar()
        v = combos.groupBy(F.col(c).cast("string").alias("value")).agg(F.sum("__n").alias("n")) \
            .select(F.lit(n).alias("filter"), "value", F.col("n").cast("long").alias("n"),
                    F.col("value").isin([str(x) for x in vals]).alias("passes"),
                    n_all.cast("long").alias("n_all_filters"), loo.cast("long").alias("n_without_this_filter"))
        out = v if out is None else out.unionByName(v)
    return out


def a_population_match(numerator: DataFrame, denominator: DataFrame, key: str,
                       dp: int = 6) -> DataFrame:
    """Numerator keys absent from the denominator population (a numerator
    counting people the denominator excludes)."""
    nk = numerator.select(key).distinct()
    outside = nk.join(denominator.select(key).distinct(), key, "left_anti")
    n_out = outside.select(F.count("*")).scalar()
    return nk.agg(F.count("*").alias("numerator_keys")) \
        .withColumn("not_in_denominator", n_out) \
        .withColumn("in_denominator", F.col("numerator_keys") - F.col("not_in_denominator")) \
        .withColumn("pct_outside", F.round(safe_div(F.col("not_in_denominator") * 100, "numerator_keys"), dp))


def a_effective(df: DataFrame, key: str, start: str, end: str, current: str,
                order: Sequence[str] = ()) -> DataFrame:
    """Effective-dated integrity: end before start, overlaps with and gaps
    after the previous row of the same key, keys with several or no current
    rows. Skew-safe per-key ordering; summary in one aggregate."""
    from plumbline.operators.sequence import keyed_window
    x0 = keyed_window(df.select(key, start, end, current, *order), key, [start, *order], lag=[end])
    prev_end = F.col(f"prev_{end}")
    x = x0.select(key, start, end, current,
                  (F.col(end) < F.col(start)).alias("bad"),
                  (F.col(start) <= prev_end).alias("ov"),
                  (F.col(start) > F.date_add(prev_end, 1)).alias("gap"))
    per_key = x.groupBy(key).agg(F.count("*").alias("rows"), F.count_if("bad").alias("bad"),
                                 F.count_if("ov").alias("ov"), F.count_if("gap").alias("gap"),
                                 F.count_if(F.col(current)).alias("cur"))
    return per_key.agg(F.sum("rows").alias("rows"), F.count("*").alias("keys"),
                       F.sum("bad").alias("end_before_start"), F.sum("ov").alias("overlaps"),
                       F.sum("gap").alias("gaps"), F.count_if(F.col("cur") > 1).alias("keys_multi_current"),
                       F.count_if(F.col("cur") == 0).alias("keys_no_current"))


def a_orphans(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str) -> DataFrame:
    """Fact rows (and distinct keys) with no dimension row."""
    d = dim.select(F.col(dim_key).alias(fact_key)).distinct()
    o = fact.join(d, fact_key, "left_anti")
    return o.agg(F.count("*").alias("orphan_rows"), F.count_distinct(fact_key).alias("orphan_keys")) \
        .withColumn("fact_rows", fact.select(F.count("*")).scalar())


def a_reconcile(ours: DataFrame, governed: DataFrame, on: str, value: str, tol_pct: float,
                dp: int = 6) -> DataFrame:
    """Our figure vs the governed one per key (full outer, missing sides
    kept), difference, percent difference and pass/fail at the tolerance."""
    j = ours.select(on, F.col(value).alias("ours")).join(
        governed.select(on, F.col(value).alias("governed")), on, "full_outer")
    pct = safe_div((F.col("ours") - F.col("governed")) * 100, "governed")
    return j.select(on, "ours", "governed", (F.col("ours") - F.col("governed")).alias("difference"),
                    F.round(pct, dp).alias("pct_difference"),
                    F.coalesce(F.abs(pct) <= tol_pct, F.lit(False)).alias("passes"))


def a_breakdown_total(parts: DataFrame, value: str, total: DataFrame, total_col: str) -> DataFrame:
    s = parts.agg(F.sum(value).cast("long").alias("sum_of_parts"))
    t = total.select(F.col(total_col).cast("long")).scalar()
    return s.withColumn("total", t).withColumn("difference", F.col("sum_of_parts") - F.col("total")) \
        .withColumn("reconciles", F.col("difference") == 0)


def a_magnitude(df: DataFrame, value: str, expected: Column | str, dp: int = 6) -> DataFrame:
    """Within an order of magnitude of the expectation: |log10(x / e)| < 1."""
    e = F.col(expected) if isinstance(expected, str) else expected
    r = safe_div(F.col(value), e)
    lg = F.when(r > 0, F.log10(r))
    return df.withColumn("log10_ratio", F.round(lg, dp)) \
        .withColumn("within_order_of_magnitude", F.abs(lg) < 1)


def a_trend_break(series: DataFrame, time: str, value: str, break_at, dp: int = 6) -> DataFrame:
    """Level shift at a known date (a migration) rather than a real event:
    mean before/after, the shift, the step at the break and the largest
    period-to-period step. ``series`` has one row per period."""
    s = materialize_small(series.select(time, value))
    w = Window.orderBy(time)  # one row per period
    d = s.withColumn("__d", F.col(value) - F.lag(value).over(w))
    b = F.col(time) >= F.lit(break_at)
    first_after = s.where(b).select(F.min(time)).scalar()
    return d.agg(F.count_if(~b).alias("n_before"), F.count_if(b).alias("n_after"),
                 F.round(F.avg(F.when(~b, F.col(value))), dp).alias("mean_before"),
                 F.round(F.avg(F.when(b, F.col(value))), dp).alias("mean_after"),
                 F.round(F.max(F.abs("__d")), dp).alias("max_abs_step"),
                 F.round(F.max(F.when(F.col(time) == first_after, F.col("__d"))), dp).alias("step_at_break")) \
        .withColumn("shift", F.round(F.col("mean_after") - F.col("mean_before"), dp))


def a_missing_by_group(df: DataFrame, cols: Sequence[str], group: str, dp: int = 6) -> DataFrame:
    """Is missingness related to the group? Null rate of each column by group
    with a Wilson range, and the difference from the rest of the data (all
    other groups) with a Newcombe interval."""
    from plumbline.operators.uncertainty import u_diff_ci
    wide = df.groupBy(group).agg(F.count("*").alias("n"),
                                 *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = wide.unpivot([group, "n"], list(cols), "column", "n_null")
    tot = long.groupBy("column").agg(F.sum("n").alias("__tn"), F.sum("n_null").alias("__tx"))
    j = long.join(F.broadcast(tot), "column")  # one row per audited column (a parameter list)
    lo, hi = wilson_bounds("n_null", "n")
    d, dlo, dhi = u_diff_ci(F.col("n_null"), F.col("n"), F.col("__tx") - F.col("n_null"),
                            F.col("__tn") - F.col("n"))
    return j.select(group, "column", "n", "n_null",
                    F.round(safe_div(F.col("n_null") * 100, "n"), dp).alias("null_rate_pct"),
                    F.round(lo * 100, dp).alias("lower_pct"), F.round(hi * 100, dp).alias("upper_pct"),
                    F.round(d * 100, dp).alias("diff_vs_rest_pts"), F.round(dlo * 100, dp).alias("diff_lower_pts"),
                    F.round(dhi * 100, dp).alias("diff_upper_pts"))


def a_units(df: DataFrame, unit: str, by: Sequence[str]) -> DataFrame:
    """Groups whose aggregate would mix more than one unit/scale/currency: one row
    per group and unit with its rows, and how many units the group has. Rows
    without a unit are listed but are no unit; a null group is a group."""
    listed = df.groupBy(*by, F.col(unit).cast("string").alias("unit")).agg(F.count("*").alias("n_rows"))
    per = listed.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.count("unit").alias("n_units"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    return listed.join(per, same).select(*by, "unit", "n_rows", "n_units", (F.col("n_units") > 1).alias("mixed"))


def a_distinct_mask(df: DataFrame, key: str, dp: int = 6) -> DataFrame:
    """count(*) vs count(DISTINCT key) on a joined result: a ratio above 1
    is a grain error that a DISTINCT would hide."""
    return df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("distinct_keys")) \
        .withColumn("ratio", F.round(safe_div("rows", "distinct_keys"), dp))


def a_distinct_mask_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, dp: int = 6) -> DataFrame:
    """:func:`a_distinct_mask` of the inner join of two tables on the key, from the
    rows per key of either side: the join's rows are never made."""
    a = left.groupBy(F.col(left_key).alias("__k")).agg(F.count("*").alias("__a"))
    b = right.groupBy(F.col(right_key).alias("__k")).agg(F.count("*").alias("__b"))
    met = a.join(b, "__k").agg(F.coalesce(F.sum(F.col("__a") * F.col("__b")), F.lit(0)).cast("long").alias("rows"),
                               F.count("*").alias("distinct_keys"))
    return met.withColumn("ratio", F.round(safe_div("rows", "distinct_keys"), dp))


def type_family(t: Column) -> Column:
    """Engine-neutral type family of a type name."""
    u = F.upper(t)
    return (F.when(u.rlike("^ARRAY|\\[\\]$"), "array").when(u.rlike("^(TINYINT|SMALLINT|INT|INTEGER|BIGINT|LONG|SHORT|BYTE|HUGEINT)"), "integer")
            .when(u.rlike("^(FLOAT|DOUBLE|REAL|DECIMAL)"), "floating")
            .when(u.rlike("^(STRING|VARCHAR|TEXT)"), "string")
            .when(u.rlike("^TIMESTAMP"), "timestamp").when(u.rlike("^DATE"), "date")
            .when(u.rlike("^(BOOLEAN|BOOL)"), "boolean").otherwise("other"))


def column_facts(name: str, df: DataFrame, types: dict[str, str]) -> DataFrame:
    """(table_name, column_name, data_type, n_rows, n_filled, n_castable) from one
    aggregate over the rows; ``types`` are the documented types by column, and
    n_castable is null for a column without one."""
    quoted = lambda c: F.col("`" + c + "`")
    casts = {c: quoted(c).try_cast(t) for c, t in types.items() if c in df.columns}
    g = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(quoted(c)).alias(f"f{i}") for i, c in enumerate(df.columns)],
               *[F.count(casts[c]).alias(f"c{i}") for i, c in enumerate(df.columns) if c in casts])
    rows = [F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.lit(t).alias("data_type"), F.col("n").alias("n_rows"),
                     F.col(f"f{i}").alias("n_filled"), (F.col(f"c{i}") if c in casts else F.lit(None).cast("long")).alias("n_castable"))
            for i, (c, t) in enumerate(df.dtypes)]
    return g.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def a_schema_drift(documented: DataFrame, facts: DataFrame) -> DataFrame:
    """Documented (table, column, type) vs the tables' columns and values (``facts``,
    see :func:`column_facts`): missing and undocumented columns, changes of the
    type family, and values that do not cast to the documented type, with each
    column's rows and share of nulls. From columns and types alone (without
    ``n_rows``) only the columns that drifted come out."""
    known = "n_rows" in facts.columns
    if not known:
        facts = facts.withColumns({c: F.lit(None).cast("long") for c in ("n_rows", "n_filled", "n_castable")})
    d = documented.select("table_name", "column_name", type_family(F.col("data_type")).alias("documented_type"))
    a = facts.withColumn("actual_type", type_family(F.col("data_type"))).drop("data_type")
    j = d.join(a, ["table_name", "column_name"], "full_outer")
    bad = F.col("n_filled") - F.col("n_castable")
    status = (F.when(F.col("actual_type").isNull(), "missing_in_data")
              .when(F.col("documented_type").isNull(), "undocumented")
              .when(bad > 0, "values_do_not_cast")
              .when(F.col("documented_type") != F.col("actual_type"), "type_changed").otherwise("as_documented"))
    out = j.select("table_name", "column_name", "documented_type", "actual_type", status.alias("status"), "n_rows",
                   F.round(safe_div(F.col("n_rows") - F.col("n_filled"), "n_rows"), 6).alias("null_share"), bad.alias("n_not_castable"))
    return out if known else out.where("status != 'as_documented'")


def a_gt_drift(pinned: DataFrame, fresh: DataFrame, ignore_prefix: str = "_meta") -> DataFrame:
    """Pinned vs recomputed (path, value) pairs, ignoring ``ignore_prefix``:
    one row per changed, added or removed path."""
    from plumbline.operators.joins import join_full_drift
    keep = ~F.col("path").startswith(ignore_prefix)
    return join_full_drift(pinned.where(keep), fresh.where(keep), "path", "value") \
        .withColumnRenamed("value_a", "pinned").withColumnRenamed("value_b", "current")
