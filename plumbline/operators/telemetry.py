"""Evaluation telemetry (§2.13): eval-run results as data.

Input shape (long): one row per (mode, slice, eval_id, run_no) with
``passed`` = assertions passed in that run (null = lost run / ERROR) and
``total`` = assertions of the eval; plus per-mode metadata. Nested result
documents are exploded into that shape by :func:`e_explode`. A missing or
lost run is missing data, never a zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.stats import Z95, normal_tail, safe_div

RESULT_SCHEMA = ("mode string, agent_model string, skill_loading string, repeats int, slice string, "
                 "id string, negative boolean, trap string, total int, runs array<int>, "
                 "assertions array<struct<assertion:int, verdict:string>>")
NESTED_SCHEMA = ("mode string, agent_model string, skill_loading string, repeats int, "
                 "slices map<string, array<struct<id:string, negative:boolean, trap:string, "
                 "passed:double, total:int, runs:array<int>, "
                 "assertions:array<struct<assertion:int, verdict:string>>>>>")


def _flat(results: DataFrame) -> DataFrame:
    """One record per eval, from the nested document shape (``slices`` map of
    arrays) or from records that already are (JSON lines)."""
    if "slices" not in results.columns:
        return results
    head = ["mode", "agent_model", "skill_loading", "repeats"]
    evals = results.select(*head, F.explode("slices").alias("slice", "evals")).select(*head, "slice", F.explode("evals").alias("e"))
    return evals.select(*head, "slice", "e.id", "e.negative", "e.trap", "e.total", "e.runs", "e.assertions")


def e_explode(results: DataFrame) -> DataFrame:
    """Result records -> one row per (mode, slice, eval, valid run).

    Accepts the nested document shape or one record per eval. Lost runs are absent
    from ``runs``; their count is ``repeats - size(runs)``."""
    return _flat(results).select("mode", "slice", F.col("id").alias("eval_id"), "negative", "trap", "total",
                                 "repeats", F.posexplode_outer("runs").alias("run_no", "passed"))


def e_assertions(results: DataFrame) -> DataFrame:
    """Result records -> one row per (mode, slice, eval, assertion) with its verdict;
    an eval without assertions has one row with a null assertion."""
    each = _flat(results).select("mode", "slice", F.col("id").alias("eval_id"), "negative", "trap",
                                 F.explode_outer("assertions").alias("a"))
    return each.select("mode", "slice", "eval_id", "negative", "trap", "a.assertion", "a.verdict")


def e_score(long: DataFrame) -> DataFrame:
    """Per (mode, slice, eval): mean passes over valid runs; null (excluded)
    when no valid run, never 0; lost runs counted."""
    return long.groupBy("mode", "slice", "eval_id", "negative", "trap", "total", "repeats").agg(
        F.count("passed").alias("n_runs"), F.avg("passed").alias("passed")) \
        .withColumn("n_lost", F.col("repeats") - F.col("n_runs"))


def _matched(sa: DataFrame, sb: DataFrame) -> DataFrame:
    a = sa.where(F.col("passed").isNotNull()).select(
        "slice", "eval_id", F.col("passed").alias("pa"), F.col("total").alias("ta"), F.col("negative").alias("na"))
    b = sb.where(F.col("passed").isNotNull()).select(
        "slice", "eval_id", F.col("passed").alias("pb"), F.col("total").alias("tb"), F.col("negative").alias("nb"))
    return a.join(b, ["slice", "eval_id"], "full_outer")


def e_compare(sa: DataFrame, sb: DataFrame, dp: int = 6) -> DataFrame:
    """Slice pass % on evals scored on *both* sides, the delta, how many evals
    were excluded, and a TOTAL row over matched assertions. A slice with no
    matched eval reports null percentages ('no data'), not 0%."""
    j = _matched(sa, sb)
    both = F.col("pa").isNotNull() & F.col("pb").isNotNull()
    per = j.groupBy("slice").agg(
        F.sum(F.when(both, F.col("pa"))).alias("p_a"), F.sum(F.when(both, F.col("ta"))).alias("t_a"),
        F.sum(F.when(both, F.col("pb"))).alias("p_b"), F.sum(F.when(both, F.col("tb"))).alias("t_b"),
        F.count_if(both).alias("matched_evals"), F.count_if(~both).alias("excluded_evals"))
    tot = per.agg(F.lit("TOTAL").alias("slice"), F.sum("p_a").alias("p_a"), F.sum("t_a").alias("t_a"),
                  F.sum("p_b").alias("p_b"), F.sum("t_b").alias("t_b"),
                  F.sum("matched_evals").alias("matched_evals"), F.sum("excluded_evals").alias("excluded_evals"))
    u = per.unionByName(tot)
    fa = safe_div(F.col("p_a") * 100, "t_a")
    fb = safe_div(F.col("p_b") * 100, "t_b")
    return u.select("slice", F.round(fa, dp).alias("baseline_pct"), F.round(fb, dp).alias("treated_pct"),
                    F.round(fb - fa, dp).alias("delta_pts"), F.col("matched_evals").cast("long").alias("matched_evals"),
                    F.col("excluded_evals").cast("long").alias("excluded_evals"),
                    F.coalesce(F.col("t_a"), F.lit(0)).cast("long").alias("matched_assertions"))


def e_guard(meta_a: DataFrame, meta_b: DataFrame, sa: DataFrame, sb: DataFrame) -> DataFrame:
    """Warnings before trusting a comparison: a side with no evaluated
    assertions, slices on one side only, single-run sides, different agent
    models, different loading strategies. One row per warning. Run metadata
    are one-row frames read as scalar subqueries (no join)."""
    def n_assert(s):
        return s.select(F.coalesce(F.sum(F.when(F.col("passed").isNotNull(), F.col("total"))),
                                   F.lit(0))).scalar()
    base = meta_a.select(F.col("agent_model").alias("am_a"), F.col("skill_loading").alias("sl_a"),
                         F.col("repeats").alias("rp_a")) \
        .withColumn("am_b", meta_b.select("agent_model").scalar()) \
        .withColumn("sl_b", meta_b.select("skill_loading").scalar()) \
        .withColumn("rp_b", meta_b.select("repeats").scalar()) \
        .withColumn("na", n_assert(sa)).withColumn("nb", n_assert(sb))
    checks = [
        (F.col("na") == 0, "empty_run", F.lit("baseline side has no evaluated assertions")),
        (F.col("nb") == 0, "empty_run", F.lit("treated side has no evaluated assertions")),
        ((F.col("rp_a") == 1) & (F.col("rp_b") == 1), "single_run", F.lit("one run per eval on both sides")),
        (~F.col("am_a").eqNullSafe(F.col("am_b")), "different_model", F.concat_ws(" vs ", "am_a", "am_b")),
        (~F.col("sl_a").eqNullSafe(F.col("sl_b")) & (F.col("sl_a") != "n/a") & (F.col("sl_b") != "n/a"),
         "different_loading", F.concat_ws(" vs ", "sl_a", "sl_b")),
    ]
    out = None
    for cond, name, detail in checks:
        w = base.where(cond).select(F.lit(name).alias("check"), detail.alias("detail"))
        out = w if out is None else out.unionByName(w)
    sla = sa.select("slice").distinct().withColumn("__a", F.lit(True))
    slb = sb.select("slice").distinct().withColumn("__b", F.lit(True))
    one = sla.join(slb, "slice", "full_outer").where(F.col("__a").isNull() | F.col("__b").isNull())
    return out.unionByName(one.select(
        F.lit("slice_one_side").alias("check"),
        F.concat(F.col("slice"), F.when(F.col("__a").isNull(), F.lit(" only in treated run"))
                 .otherwise(F.lit(" only in baseline run"))).alias("detail")))


def e_negative(sa: DataFrame, sb: DataFrame, dp: int = 6) -> DataFrame:
    """Pass rate on negative tests (should not over-fire), each side."""
    def side(s, tag):
        r = s.where(F.col("negative") & F.col("passed").isNotNull())
        return r.agg(F.lit(tag).alias("side"), F.coalesce(F.sum("passed"), F.lit(0.0)).alias("passed"),
                     F.coalesce(F.sum("total"), F.lit(0)).cast("long").alias("total"))
    u = side(sa, "baseline").unionByName(side(sb, "treated"))
    return u.withColumn("pass_pct", F.round(safe_div(F.col("passed") * 100, "total"), dp)) \
        .withColumn("passed", F.round("passed", dp))


#: Trials up to which the sign test's tail is summed term by term.
EXACT_TRIALS = 1000


def sign_test(up: Column, down: Column) -> tuple[Column, Column]:
    """Sign test (p = 1/2) as Column expressions: the upper tail
    P(X >= max(up, down)) over n = up + down, and two-sided min(1, 2x).

    Up to EXACT_TRIALS trials the tail is the sum of its terms, each from the one
    before. Beyond, it is the Lugannani-Rice tail with continuity correction, whose
    relative error falls with n everywhere, far into the tail too: nothing in a row
    grows with n."""
    n, k = (up + down).cast("long"), F.greatest(up, down).cast("long")
    ln2 = 0.6931471805599453
    few = F.when((n > 0) & (n <= EXACT_TRIALS), F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>"))
    init = F.struct(F.lit(0.0).alias("lc"), F.lit(0.0).alias("tail"))
    acc = F.aggregate(few, init, lambda a, i: F.struct(
        (a["lc"] + F.log((n - i + 1) / i)).alias("lc"),
        (a["tail"] + F.when(i >= k, F.exp(a["lc"] + F.log((n - i + 1) / i) - n * ln2)).otherwise(0.0)).alias("tail")))
    x, r = k.cast("double"), (n - k).cast("double")
    # n times the divergence of k / n from 1 / 2, by log1p: the terms nearly cancel
    apart = x * F.log1p((x - r) / n) + r * F.log1p((r - x) / n)
    t = F.log(x / r)
    w, u = F.sqrt(2 * apart), (1 - F.exp(-t)) * F.sqrt(x * r / n)
    density = F.exp(-apart) / (2 * 3.141592653589793) ** 0.5
    many = F.when(k == n, F.exp(-n * ln2)).when(2 * k == n, 0.5 + 0.5 * F.sqrt(2 / (3.141592653589793 * n))) \
        .otherwise(normal_tail(w) + density * (1 / u - 1 / w))
    one = F.when(n > EXACT_TRIALS, many).when(n > 0, acc["tail"])
    return one, F.least(F.lit(1.0), one * 2)


def _deltas(sa: DataFrame, sb: DataFrame) -> DataFrame:
    j = _matched(sa, sb).where(F.col("pa").isNotNull() & F.col("pb").isNotNull())
    return j.select("slice", "eval_id", (F.col("pb") * 100 / F.col("tb") - F.col("pa") * 100 / F.col("ta")).alias("d"))


def e_paired(sa: DataFrame, sb: DataFrame, z: float = Z95, dp: int = 6) -> DataFrame:
    """Per-eval delta (treated - baseline pass %): mean, exact median, sd, a
    normal-quantile 95% interval for the mean, up/down/flat and the sign test
    (one- and two-sided, labelled)."""
    from plumbline.operators.quantiles import exact_quantiles
    d = _deltas(sa, sb)
    med = exact_quantiles(d, "d", [], [0.5]).select(F.col("__q")[0]).scalar()
    g = d.agg(F.count("*").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s"),
              F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"),
              F.count_if(F.col("d") == 0).alias("flat"))
    half = F.lit(z) * F.col("s") / F.sqrt("n")
    one, two = sign_test(F.col("up"), F.col("down"))
    return g.select("n", F.round("m", dp).alias("mean_delta"), F.round(med, dp).alias("median_delta"),
                    F.round("s", dp).alias("sd_delta"), F.round(F.col("m") - half, dp).alias("ci_lower"),
                    F.round(F.col("m") + half, dp).alias("ci_upper"), "up", "down", "flat",
                    F.round(one, dp).alias("sign_p_one_sided"), F.round(two, dp).alias("sign_p_two_sided"))


def e_sensitivity(la: DataFrame, lb: DataFrame, dp: int = 6) -> DataFrame:
    """Mean per-eval delta under three treatments of lost runs: excluded (the
    default), evals with any lost run dropped, lost runs scored 0."""
    def scored(long, mode):
        g = long.groupBy("slice", "eval_id", "total", "repeats").agg(
            F.avg("passed").alias("p_excl"), F.count("passed").alias("nr"),
            F.sum(F.coalesce("passed", F.lit(0))).alias("s0"))
        return g.select("slice", "eval_id", F.col("total").alias(f"t{mode}"),
                        (F.col("p_excl") * 100 / F.col("total")).alias(f"excl{mode}"),
                        (F.col("nr") < F.col("repeats")).alias(f"lost{mode}"),
                        (F.col("s0") / F.col("repeats") * 100 / F.col("total")).alias(f"zero{mode}"))
    j = scored(la, "a").join(scored(lb, "b"), ["slice", "eval_id"])
    ok = F.col("excla").isNotNull() & F.col("exclb").isNotNull()
    clean = ok & ~F.col("losta") & ~F.col("lostb")
    g = j.agg(F.avg(F.when(ok, F.col("exclb") - F.col("excla"))).alias("a1"), F.count_if(ok).alias("n1"),
              F.avg(F.when(clean, F.col("exclb") - F.col("excla"))).alias("a2"), F.count_if(clean).alias("n2"),
              F.avg(F.col("zerob") - F.col("zeroa")).alias("a3"), F.count("*").alias("n3"))
    rows = [F.struct(F.lit(lab).alias("treatment"), F.col(n).alias("n_evals"), F.round(a, dp).alias("mean_delta"))
            for lab, a, n in (("lost runs excluded", "a1", "n1"), ("evals with a lost run dropped", "a2", "n2"),
                              ("lost runs scored 0", "a3", "n3"))]
    return g.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def e_informative_loss(long: DataFrame, dp: int = 6) -> DataFrame:
    """Where the lost runs are: lost-run rate by mode and slice."""
    per_eval = long.groupBy("mode", "slice", "eval_id", "repeats").agg(F.count("passed").alias("nr"))
    g = per_eval.groupBy("mode", "slice").agg(F.sum("repeats").alias("expected_runs"),
                                              F.sum("nr").alias("valid_runs"))
    return g.withColumn("lost_runs", F.col("expected_runs") - F.col("valid_runs")) \
        .withColumn("lost_pct", F.round(safe_div(F.col("lost_runs") * 100, "expected_runs"), dp)) \
        .select("mode", "slice", F.col("expected_runs").cast("long"), F.col("valid_runs").cast("long"),
                F.col("lost_runs").cast("long"), "lost_pct")


def e_spec_check(specs: DataFrame, id_col: str, assertions: str, negative: str, dp: int = 6) -> DataFrame:
    """Eval-spec hygiene: duplicate ids, evals without assertions, negative
    share -- one summary row."""
    dup = specs.groupBy(id_col).agg(F.count("*").alias("c")).where(F.col("c") > 1).select(F.count("*")).scalar()
    return specs.agg(F.count("*").alias("n_evals"),
                     F.count_if(F.coalesce(F.size(assertions), F.lit(0)) <= 0).alias("evals_without_assertions"),
                     F.sum(F.greatest(F.size(assertions), F.lit(0))).cast("long").alias("n_assertions"),
                     F.count_if(F.col(negative)).alias("n_negative")) \
        .withColumn("duplicate_ids", dup) \
        .withColumn("negative_pct", F.round(safe_div(F.col("n_negative") * 100, "n_evals"), dp))


def e_orphan_figure(texts: DataFrame, id_col: str, figures: Column, known: DataFrame, value: str) -> DataFrame:
    """Figures quoted in texts that match no pinned value (compared at one
    decimal, and as integers for whole numbers): a left-anti join against the
    distinct known set."""
    k1 = known.select(F.round(F.col(value).cast("double"), 1).alias("f"))
    k2 = known.select(F.col(value).cast("double").alias("f")).where(F.col("f") == F.floor("f"))
    ks = k1.unionByName(k2).distinct()
    from plumbline.session import spread_small_scan
    q = spread_small_scan(texts).select(id_col, F.explode(figures).alias("figure"))
    return q.join(ks, F.round(q["figure"], 1) == ks["f"], "left_anti")


def e_trend(long: DataFrame, dp: int = 6) -> DataFrame:
    """Pass rate over successive runs per slice: the slope of the per-run pass
    rate (decline flagged) and evals that flipped pass -> fail between runs."""
    r = long.where(F.col("passed").isNotNull()).withColumn("__ok", F.col("passed") == F.col("total"))
    w = Window.partitionBy("mode", "slice", "eval_id").orderBy("run_no")
    flips = r.withColumn("__flip", F.lag("__ok").over(w) & ~F.col("__ok"))
    per_run = flips.groupBy("mode", "slice", "run_no").agg(
        (F.sum("passed") / F.sum("total")).alias("__rate"), F.count_if("__flip").alias("__flips"))
    g = per_run.groupBy("mode", "slice").agg(F.regr_slope("__rate", "run_no").alias("slope"),
                                             F.sum("__flips").alias("pass_to_fail_flips"))
    return g.select("mode", "slice", F.round("slope", dp).alias("slope_per_run"),
                    F.col("pass_to_fail_flips").cast("long"), (F.col("slope") < 0).alias("declining"))


def e_trap_rate(scores: DataFrame, dp: int = 6) -> DataFrame:
    """Pass rate by trap per mode."""
    s = scores.where(F.col("passed").isNotNull())
    return s.groupBy("mode", "trap").agg(F.count("*").alias("evals"), F.sum("passed").alias("__p"),
                                         F.sum("total").alias("__t")) \
        .select("mode", "trap", "evals", F.round(safe_div(F.col("__p") * 100, "__t"), dp).alias("pass_pct"))
