"""Uncertainty and disclosure control (§2.10).

Suppression runs on the aggregate before any rate, sort or write. Intervals
are closed-form Column expressions; group-level comparisons (multiplicity,
shrinkage, league tables) run on one row per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.stats import (Z95, normal_quantile, normal_tail, poisson_bounds, safe_div,
                                       t_quantile, wilson_bounds)
from plumbline.operators.sequence import keyed_window, value_ranks
from plumbline.session import cut_lineage, materialize_small

SUPPRESSED = "suppressed (n < {k})"


def u_stability(n: str | Column, k: int = 5, unstable: int = 30) -> Column:
    c = F.col(n) if isinstance(n, str) else n
    return F.when(c < k, "suppressed").when(c < unstable, "unstable").otherwise("stable")


def u_suppress(df: DataFrame, n: str, hide: Sequence[str] = (), k: int = 5) -> DataFrame:
    """Null the count and every derived column of cells with n < k, keep the
    row, and label it; nothing that reveals the count survives. The flag is
    computed before any column is nulled."""
    out = df.withColumn("__small", F.col(n) < k)
    for c in [n, *hide]:
        out = out.withColumn(c, F.when(~F.col("__small"), F.col(c)))
    return out.withColumn("disclosure", F.when(F.col("__small"), SUPPRESSED.format(k=k)).otherwise("shown")) \
        .drop("__small")


def u_small_cells(df: DataFrame, dims: Sequence[str], key: str, k: int = 5) -> DataFrame:
    """Cross-tab cells (distinct units) below k."""
    return (df.groupBy(*dims).agg(F.count_distinct(key).alias("n"))
            .where(F.col("n") < k))


def _cells_with_margins(df: DataFrame, d1: str, d2: str, key: str) -> DataFrame:
    """Interior cells, both margins and the grand total via ``cube``; the
    grouping id tells margins apart from a genuine null label."""
    c = df.cube(d1, d2).agg(F.count_distinct(key).alias("n"), F.grouping_id().alias("gid"))
    return c.withColumn("cell_id", F.concat_ws("\u0001", F.col("gid").cast("string"),
                                               F.coalesce(F.col(d1).cast("string"), F.lit("")),
                                               F.coalesce(F.col(d2).cast("string"), F.lit(""))))


def _memberships(cells: DataFrame, d1: str, d2: str) -> DataFrame:
    """Each cell's additive lines: row r (cells of r + row total), column c,
    the row-total line and the column-total line."""
    gid = F.col("gid")
    a1, a2 = F.coalesce(F.col(d1).cast("string"), F.lit("")), F.coalesce(F.col(d2).cast("string"), F.lit(""))
    lines = (F.when(gid == 0, F.array(F.concat(F.lit("r:"), a1), F.concat(F.lit("c:"), a2)))
             .when(gid == 1, F.array(F.concat(F.lit("r:"), a1), F.lit("R")))   # d2 aggregated
             .when(gid == 2, F.array(F.concat(F.lit("c:"), a2), F.lit("C")))   # d1 aggregated
             .otherwise(F.array(F.lit("R"), F.lit("C"))))
    return cells.select("cell_id", "n", "hidden", F.explode(lines).alias("line"))


def u_complementary(df: DataFrame, d1: str, d2: str, key: str, k: int = 5,
                    max_rounds: int | None = None) -> DataFrame:
    """Primary suppression (n < k) plus complementary suppression on a
    two-way table with margins: while some additive line (a row with its
    total, a column with its total, or the margin lines) has exactly one
    hidden member, hide that line's smallest visible member. Repeats until
    stable; each round cuts lineage with a reliable checkpoint. The table is
    the aggregate (cells x margins), never the underlying rows. Hidden counts
    are in no column of the result."""
    cells = _cells_with_margins(df, d1, d2, key)
    cells = cells.withColumn("hidden", F.col("n") < k) \
        .withColumn("reason", F.when(F.col("n") < k, "primary"))
    cells = cut_lineage(cells)
    rounds = 0
    while True:
        m = _memberships(cells, d1, d2)
        per_line = m.groupBy("line").agg(
            F.sum(F.col("hidden").cast("int")).alias("h"),
            F.min_by("cell_id", F.when(~F.col("hidden"), F.struct("n", "cell_id"))).alias("pick"))
        picks = per_line.where((F.col("h") == 1) & F.col("pick").isNotNull()) \
            .select(F.col("pick").alias("cell_id")).distinct().withColumn("__p", F.lit(True))
        nxt = cells.join(picks, "cell_id", "left")
        newly = F.coalesce(F.col("__p"), F.lit(False)) & ~F.col("hidden")
        nxt = nxt.withColumn("reason", F.when(newly, "complementary").otherwise(F.col("reason"))) \
            .withColumn("hidden", F.col("hidden") | newly).drop("__p")
        nxt = cut_lineage(nxt)
        changed = nxt.where(F.col("reason") == "complementary").count() != \
            cells.where(F.col("reason") == "complementary").count()
        cells = nxt
        rounds += 1
        if not changed or (max_rounds is not None and rounds >= max_rounds):
            break
    g = F.col("gid")
    return cells.select(
        d1, d2, F.when(g == 0, "cell").when(g == 1, "row_total").when(g == 2, "column_total")
        .otherwise("grand_total").alias("level"),
        F.when(~F.col("hidden"), F.col("n")).alias("n_shown"),
        "hidden", F.coalesce("reason", F.lit("shown")).alias("reason"))


def _rooted(edges: DataFrame) -> DataFrame:
    """(v, root, level): the least vertex of each vertex's component and the
    distance to it, for edges (e, a, b). Every round a vertex takes the best of
    its neighbours' offers, until none changes."""
    both = cut_lineage(edges.select("e", F.col("a").alias("v"), F.col("b").alias("w"))
                       .union(edges.select("e", F.col("b"), F.col("a"))))
    state = both.select("v").distinct().select("v", F.col("v").alias("root"), F.lit(0).alias("level"))
    while True:
        offers = both.join(state.withColumnsRenamed({"v": "w"}), "w").groupBy("v").agg(
            F.min(F.struct("root", (F.col("level") + 1).alias("level"))).alias("o"))
        best = F.least(F.struct("root", "level"), F.col("o"))
        nxt = cut_lineage(state.join(offers, "v").select(
            "v", best["root"].alias("root"), best["level"].alias("level"), (F.col("o") < F.struct("root", "level")).alias("moved")))
        state = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            return state


def bridges(edges: DataFrame) -> DataFrame:
    """(e) of the edges (e, a, b) that lie on no cycle.

    Every vertex but a component's root has one edge towards the root, in a
    breadth-first forest; all other edges get a 64-bit hash. The exclusive or of the
    hashes at the vertices below a forest edge is that of the edges that go round
    it: 0 if there are none (or with a chance of 2^-64). Rounds: the forest's depth,
    each on one row per vertex."""
    state = _rooted(edges)
    a, b = state.toDF("a", "ra", "la"), state.toDF("b", "rb", "lb")
    placed = cut_lineage(edges.join(a, "a").join(b, "b").select(
        "e", "a", "b", F.col("la").alias("level_a"), F.col("lb").alias("level_b")))
    down = placed.where("level_a != level_b").select(
        "e", F.when(F.col("level_a") > F.col("level_b"), F.col("a")).otherwise(F.col("b")).alias("v"),
        F.when(F.col("level_a") > F.col("level_b"), F.col("b")).otherwise(F.col("a")).alias("up"),
        F.greatest("level_a", "level_b").alias("level"))
    tree = cut_lineage(down.groupBy("v", "level").agg(F.min_by(F.struct("e", "up"), "e").alias("x"))
                       .select("v", "level", "x.e", "x.up"))
    other = placed.join(tree.select("e"), "e", "left_anti")
    marks = other.select(F.explode(F.array("a", "b")).alias("v"), F.xxhash64("e").alias("h"))
    done = None
    depth = tree.agg(F.max("level")).first()[0] or 0  # one number
    for level in range(depth, 0, -1):
        below = marks.groupBy("v").agg(F.bit_xor("h").alias("h"))
        own = cut_lineage(tree.where(F.col("level") == level).join(below, "v", "left").select(
            "e", "up", F.coalesce("h", F.lit(0)).alias("h")))
        done = own.select("e", "h") if done is None else done.union(own.select("e", "h"))
        marks = cut_lineage(marks.union(own.select(F.col("up").alias("v"), "h")))
    return tree.select("e").where("false") if done is None else done.where("h = 0").select("e")


def u_recoverable(published: DataFrame, d1: str, d2: str, n_shown: str) -> DataFrame:
    """Audit a published two-way table with margins (null = hidden; margins
    have null labels): hidden cells that follow from the shown ones by any number of
    subtractions.

    Each cell lies in two additive lines, so the hidden cells are edges of a graph
    whose vertices are the lines, and the lines' sums fix a cell exactly if it lies
    on no cycle (around a cycle, amounts can be moved without changing any sum). A
    cell alone in a line is the simplest case, counted by ``lines_exposing``."""
    lv = (F.when(F.col(d1).isNotNull() & F.col(d2).isNotNull(), 0)
          .when(F.col(d1).isNotNull(), 1).when(F.col(d2).isNotNull(), 2).otherwise(3))
    cells = published.select(d1, d2, lv.alias("gid"), F.col(n_shown).isNull().alias("hidden"),
                             F.col(n_shown).alias("n")) \
        .withColumn("cell_id", F.concat_ws("\u0001", F.col("gid").cast("string"),
                                           F.coalesce(F.col(d1).cast("string"), F.lit("")),
                                           F.coalesce(F.col(d2).cast("string"), F.lit(""))))
    hidden = materialize_small(cells.where("hidden"))
    m = _memberships(hidden, d1, d2)
    edges = m.groupBy("cell_id").agg(F.min("line").alias("a"), F.max("line").alias("b")).withColumnRenamed("cell_id", "e")
    fixed = bridges(cut_lineage(edges)).select(F.col("e").alias("cell_id"), F.lit(True).alias("fixed"))
    alone = m.groupBy("line").agg(F.count(F.lit(1)).alias("h"), F.min("cell_id").alias("cell_id")).where("h = 1")
    lone = alone.groupBy("cell_id").agg(F.count(F.lit(1)).alias("lines_exposing"))
    return hidden.join(lone, "cell_id", "left").join(fixed, "cell_id", "left").select(
        d1, d2, F.when(F.col("gid") == 0, "cell").when(F.col("gid") == 1, "row_total")
        .when(F.col("gid") == 2, "column_total").otherwise("grand_total").alias("level"),
        F.coalesce("lines_exposing", F.lit(0)).cast("long").alias("lines_exposing"),
        F.coalesce("fixed", F.lit(False)).alias("recoverable"))


def u_wilson(df: DataFrame, num: str, den: str, z: float = Z95, dp: int = 6) -> DataFrame:
    lo, hi = wilson_bounds(num, den, z)
    return df.withColumn("rate_pct", F.round(safe_div(F.col(num) * 100, den), dp)) \
        .withColumn("lower_pct", F.round(lo * 100, dp)).withColumn("upper_pct", F.round(hi * 100, dp))


def u_poisson(df: DataFrame, count: str, exposure: str | None = None, z: float = Z95,
              dp: int = 6) -> DataFrame:
    lo, hi = poisson_bounds(count, z)
    out = df.withColumn("count_lower", F.round(lo, dp)).withColumn("count_upper", F.round(hi, dp))
    if exposure:
        out = out.withColumn("rate_per_100", F.round(safe_div(F.col(count) * 100, exposure), dp)) \
            .withColumn("rate_lower", F.round(safe_div(lo * 100, exposure), dp)) \
            .withColumn("rate_upper", F.round(safe_div(hi * 100, exposure), dp))
    return out


def u_rate_block(df: DataFrame, metric: str, num: str, den: str, comparisons: Column,
                 prespecified: bool, limit: Column | None = None, z: float = Z95) -> DataFrame:
    """The standard reporting block per row: metric, rate with numerator and
    denominator, Wilson range, stability, comparisons made and pre-specified
    vs exploratory, and the interpretation limit (smallest detectable gap)."""
    from plumbline.functions.text import ratio_label
    lo, hi = wilson_bounds(num, den, z)
    small = F.col(den) < 5
    shown = [F.when(~small, F.col(c)).alias(c) if c in (num, den) else F.col(c) for c in df.columns]
    out = df.select(
        *shown, F.lit(metric).alias("metric"),
        F.when(~small, ratio_label(num, den)).otherwise(SUPPRESSED.format(k=5)).alias("value_text"),
        F.when(~small, F.round(lo * 100, 6)).alias("lower_pct"),
        F.when(~small, F.round(hi * 100, 6)).alias("upper_pct"),
        F.lit("Wilson score, 95%").alias("method"),
        u_stability(den).alias("stability"),
        comparisons.cast("long").alias("comparisons"),
        F.lit("pre-specified" if prespecified else "exploratory").alias("analysis"))
    # the detectable gap is a function of the denominator, so it goes with it
    return out if limit is None else out.withColumn(
        "detectable_pts", F.when(F.col("value_text") != SUPPRESSED.format(k=5), F.round(limit, 6)))


def u_multiplicity(df: DataFrame, group: str, num: str, den: str, dp: int = 6, hot_rows: int = 2_000_000) -> DataFrame:
    """One-vs-rest two-proportion z test per group, with the number of
    comparisons, Bonferroni and Benjamini-Hochberg adjusted p-values, and
    ``log10_p``, which tells tiny p-values apart. Totals are scalar subqueries; the
    ranks and the running minimum over them are prefix scans over ranges, so the
    number of groups has no bound."""
    df = materialize_small(df.select(group, num, den))
    tx = df.select(F.sum(num)).scalar()
    tn = df.select(F.sum(den)).scalar()
    k = df.select(F.count("*")).scalar()
    p1 = safe_div(num, den)
    rn = tn - F.col(den)
    p0 = safe_div(tx - F.col(num), rn)
    pp = safe_div(F.lit(1.0) * tx, tn)
    se = F.sqrt(pp * (1 - pp) * (1 / F.col(den) + 1 / rn))
    zc = safe_div(p1 - p0, se)
    pv = 2 * normal_tail(F.abs(zc))
    out = df.select(group, num, den, zc.alias("z"), pv.alias("p"), k.alias("comparisons"), F.lit(0).alias("one"),
                    pv.isNull().alias("undefined"))
    out = keyed_window(out, "one", ["undefined", "p", group], row_number="r", hot_rows=hot_rows, cheap=True)
    out = out.withColumn("back", -F.col("r"))
    out = keyed_window(out, "one", ["back"], running_min={"bh": F.col("p") * F.col("comparisons") / F.col("r")},
                       hot_rows=hot_rows, cheap=True)
    return out.select(group, num, den, F.round("z", dp).alias("z"), F.round("p", dp).alias("p_value"),
                      F.round(F.log10(F.nullif("p", F.lit(0.0))), dp).alias("log10_p"), "comparisons",
                      F.round(F.least(F.lit(1.0), F.col("p") * F.col("comparisons")), dp).alias("p_bonferroni"),
                      F.round(F.least(F.lit(1.0), "bh"), dp).alias("p_bh"))


def shrink_params(df: DataFrame, num: str, den: str) -> tuple[Column, Column]:
    """Beta-binomial prior by moments: overall rate m = sum x / sum n; the
    between-group variance tau2 = weighted variance of rates minus the mean
    sampling variance m(1-m) G / sum n; alpha = m(1-m)/tau2 - 1 (>= 0).
    Returns (m, alpha) as scalar-subquery columns; alpha null = full pooling."""
    g = df.agg(F.sum(num).alias("x"), F.sum(den).alias("n"), F.count("*").alias("G"))
    m = F.col("x") / F.col("n")
    stats = g.select(m.alias("m"), "n", "G")
    mm = stats.select("m").scalar()
    wv = df.select((F.sum(F.col(den) * F.pow(F.col(num) / F.col(den) - mm, 2)) / F.sum(den))).scalar()
    tau2 = wv - mm * (1 - mm) * stats.select("G").scalar() / stats.select("n").scalar()
    alpha = F.when(tau2 > 0, F.greatest(F.lit(0.0), mm * (1 - mm) / tau2 - 1))
    return mm, alpha


def u_shrink(df: DataFrame, group: str, num: str, den: str, dp: int = 6) -> DataFrame:
    """Partial pooling toward the overall rate: (x + alpha m) / (n + alpha)."""
    df = materialize_small(df.select(group, num, den))
    m, alpha = shrink_params(df, num, den)
    shrunk = F.when(alpha.isNull(), m).otherwise((F.col(num) + alpha * m) / (F.col(den) + alpha))
    return df.select(group, num, den, F.round(safe_div(F.col(num) * 100, den), dp).alias("raw_pct"),
                     F.round(shrunk * 100, dp).alias("shrunk_pct"),
                     F.round(m * 100, dp).alias("overall_pct"), F.round(alpha, dp).alias("prior_weight"))


def u_league(df: DataFrame, group: str, num: str, den: str, dp: int = 6, hot_rows: int = 2_000_000) -> DataFrame:
    """League table: raw and shrunk rates with Wilson range, n, and how far
    each group moves once shrunk. Ranks come from counts per distinct rate
    (:func:`plumbline.operators.sequence.value_ranks`), not from a window over all."""
    s = u_shrink(df, group, num, den, dp)
    lo, hi = wilson_bounds(num, den)
    s = s.withColumn("lower_pct", F.round(lo * 100, dp)).withColumn("upper_pct", F.round(hi * 100, dp))
    s = value_ranks(materialize_small(s), "raw_pct", "raw_rank", hot_rows)
    s = value_ranks(s, "shrunk_pct", "shrunk_rank", hot_rows)
    return s.withColumn("rank_change", F.col("raw_rank") - F.col("shrunk_rank")) \
        .withColumn("stability", u_stability(den))


def z_values(alpha: float = 0.05, power: float = 0.8) -> tuple[float, float]:
    return normal_quantile(1 - alpha / 2), normal_quantile(power)


def u_mde(n1: Column, n0: Column, p: Column, alpha: float = 0.05, power: float = 0.8) -> Column:
    """Smallest detectable difference in proportions at these group sizes."""
    za, zb = z_values(alpha, power)
    return (za + zb) * F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))


def u_diff_ci(x1: Column, n1: Column, x0: Column, n0: Column, z: float = Z95) -> tuple[Column, Column, Column]:
    """Newcombe hybrid score interval for p1 - p0 from two Wilson intervals."""
    l1, u1 = wilson_bounds(x1, n1, z)
    l0, u0 = wilson_bounds(x0, n0, z)
    p1, p0 = safe_div(x1, n1), safe_div(x0, n0)
    d = p1 - p0
    lo = d - F.sqrt(F.pow(p1 - l1, 2) + F.pow(u0 - p0, 2))
    hi = d + F.sqrt(F.pow(u1 - p1, 2) + F.pow(p0 - l0, 2))
    return d, lo, hi


def welch(m1: Column, v1: Column, n1: Column, m0: Column, v0: Column, n0: Column,
          alpha: float = 0.05) -> tuple[Column, Column, Column, Column]:
    """Difference of means with a Welch (unequal variance) standard error: the
    difference, the bounds of its 1 - ``alpha`` interval by the Student t quantile at
    the Welch-Satterthwaite degrees of freedom, and these. Undefined (null) below
    two values a side or without any variance."""
    e1, e0 = safe_div(v1, n1), safe_div(v0, n0)
    se2 = e1 + e0
    nu = safe_div(se2 * se2, safe_div(e1 * e1, n1 - 1) + safe_div(e0 * e0, n0 - 1))
    half = t_quantile(nu, alpha) * F.sqrt(se2)
    d = m1 - m0
    return d, d - half, d + half, nu


def u_diff_means(df: DataFrame, arm: str, value: str, by: Sequence[str] = (), alpha: float = 0.05, dp: int = 6) -> DataFrame:
    """Mean of ``value`` in both arms (``arm`` is 1 or 0), overall or by group, and
    their difference with its Welch interval; one aggregate."""
    side = lambda x, f: f(F.when(F.col(arm) == x, F.col(value)))
    g = df.groupBy(*by).agg(*[side(x, f).alias(f"{n}{x}") for x in (1, 0)
                              for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    d, lo, hi, nu = welch(*[F.col(f"{c}{x}") for x in (1, 0) for c in ("m", "v", "n")], alpha)
    return g.select(*by, "n1", "n0", F.round("m1", dp).alias("mean1"), F.round("m0", dp).alias("mean0"),
                    F.round(d, dp).alias("diff"), F.round(lo, dp).alias("lower"), F.round(hi, dp).alias("upper"),
                    F.round(nu, dp).alias("degrees"))
