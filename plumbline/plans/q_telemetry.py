"""§2.13 evaluation telemetry on eval runs derived from documents x labels.

Rehearsal mapping: an eval = a labelled document, slice = its language,
trap = its source, negative = toxic, 3 assertions. Baseline run: 3 repeats,
passes = quality + (1 - toxic) + [1, 0, 0]. Treated run ('per-slice'
loading, another model): no 'es' slice, documents under 200 characters never
ran, 2 valid runs for documents under 1,000 characters and for the 'de'
slice (one lost run), 3 otherwise; passes = 2 quality + 1 - toxic."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.text import number_figures
from plumbline.operators import telemetry as E
from plumbline.plans.registry import query
from plumbline.plans.sqlfrag import ASCII_WORDS, FIGURE_RE2
from plumbline.sources.tables import Tables


def records(t: Tables):
    """One result record per (mode, slice, eval) with nested runs/assertions."""
    d = t.documents.join(t.labels, "doc_id")
    q, x = F.col("quality"), F.col("toxic")
    common = [F.col("lang").alias("slice"), F.col("doc_id").cast("string").alias("id"),
              (x == 1).alias("negative"), F.col("source").alias("trap"), F.lit(3).alias("total")]

    def assertions(last):
        return F.transform(F.sequence(F.lit(1), F.lit(3)), lambda j: F.struct(
            j.alias("assertion"), F.when(j <= last, "PASS").otherwise("FAIL").alias("verdict")))
    pa = [q + (1 - x) + (1 if r == 0 else 0) for r in range(3)]
    a = d.select(F.lit("baseline").alias("mode"), F.lit("model-a").alias("agent_model"),
                 F.lit("n/a").alias("skill_loading"), F.lit(3).alias("repeats"), *common,
                 F.array(*pa).alias("runs"), assertions(pa[2]).alias("assertions"))
    pb = 2 * q + 1 - x
    nruns = F.when((F.col("n_chars") >= 1000) & (F.col("lang") != "de"), 3).otherwise(2)
    b = d.where((F.col("n_chars") >= 200) & (F.col("lang") != "es")).select(
        F.lit("treated").alias("mode"), F.lit("model-b").alias("agent_model"),
        F.lit("per-slice").alias("skill_loading"), F.lit(3).alias("repeats"), *common,
        F.array_repeat(pb, nruns).alias("runs"), assertions(pb).alias("assertions"))
    return a.unionByName(b)


def meta(spark, mode):
    m = {"baseline": ("model-a", "n/a", 3), "treated": ("model-b", "per-slice", 3)}[mode]
    return spark.createDataFrame([(mode, *m)], "mode string, agent_model string, skill_loading string, repeats int")


def _long(spark, sf):
    return E.e_explode(records(Tables(spark, sf)))


def _scores(spark, sf):
    return E.e_score(_long(spark, sf))


LONG_SQL = """lab AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
               FROM documents d JOIN labels l USING (doc_id)),
lng AS (
  SELECT 'baseline' AS mode, lang AS slice, CAST(doc_id AS VARCHAR) AS eval_id, toxic = 1 AS negative,
         source AS trap, 3 AS total, 3 AS repeats, r AS run_no,
         quality + (1 - toxic) + CASE WHEN r = 0 THEN 1 ELSE 0 END AS passed
  FROM lab, range(0, 3) t(r)
  UNION ALL
  SELECT 'treated', lang, CAST(doc_id AS VARCHAR), toxic = 1, source, 3, 3, r, 2 * quality + 1 - toxic
  FROM lab, range(0, 3) t(r)
  WHERE n_chars >= 200 AND lang <> 'es'
    AND r < CASE WHEN n_chars >= 1000 AND lang <> 'de' THEN 3 ELSE 2 END),
sc AS (SELECT mode, slice, eval_id, negative, trap, total, repeats, count(passed) AS n_runs,
              avg(passed) AS passed, repeats - count(passed) AS n_lost FROM lng
         GROUP BY mode, slice, eval_id, negative, trap, total, repeats)"""


def sql(body: str) -> str:
    return "WITH " + LONG_SQL + "\n" + body


@query("e_explode", sql("SELECT mode, slice, eval_id, negative, trap, total, repeats, CAST(run_no AS INTEGER) AS run_no, passed FROM lng"))
def e_explode(spark, sf):
    """Result records written as JSON lines and read back with an explicit
    schema, then exploded to one row per valid run."""
    from plumbline.session import scratch_path
    from plumbline.sources.tables import read_json, write_json
    path = scratch_path(spark, "eval_results")
    write_json(records(Tables(spark, sf)), path)
    return E.e_explode(read_json(spark, path, E.RESULT_SCHEMA))


@query("e_assertions", sql("""
, v AS (SELECT 'baseline' AS mode, lang AS slice, doc_id, toxic, source, quality + 1 - toxic AS last FROM lab
        UNION ALL
        SELECT 'treated', lang, doc_id, toxic, source, 2 * quality + 1 - toxic FROM lab WHERE n_chars >= 200 AND lang <> 'es')
SELECT mode, slice, CAST(doc_id AS VARCHAR) AS eval_id, toxic = 1 AS negative, source AS trap, j AS assertion,
       CASE WHEN j <= last THEN 'PASS' ELSE 'FAIL' END AS verdict FROM v, (SELECT unnest([1, 2, 3]) AS j) a"""))
def e_assertions(spark, sf):
    """Which assertion of which eval passed, from the nested verdicts of the records."""
    return E.e_assertions(records(Tables(spark, sf)))


@query("e_score", sql("SELECT * FROM sc"))
def e_score(spark, sf):
    return _scores(spark, sf)


MATCH_SQL = """, a AS (SELECT slice, eval_id, passed AS pa, total AS ta FROM sc WHERE mode = 'baseline' AND passed IS NOT NULL),
b AS (SELECT slice, eval_id, passed AS pb, total AS tb FROM sc WHERE mode = 'treated' AND passed IS NOT NULL),
j AS (SELECT coalesce(a.slice, b.slice) AS slice, coalesce(a.eval_id, b.eval_id) AS eval_id, pa, ta, pb, tb
      FROM a FULL OUTER JOIN b ON a.slice = b.slice AND a.eval_id = b.eval_id)"""


@query("e_compare", sql(MATCH_SQL + """
, per AS (SELECT slice, sum(CASE WHEN pa IS NOT NULL AND pb IS NOT NULL THEN pa END) AS p_a,
                 sum(CASE WHEN pa IS NOT NULL AND pb IS NOT NULL THEN ta END) AS t_a,
                 sum(CASE WHEN pa IS NOT NULL AND pb IS NOT NULL THEN pb END) AS p_b,
                 sum(CASE WHEN pa IS NOT NULL AND pb IS NOT NULL THEN tb END) AS t_b,
                 count(CASE WHEN pa IS NOT NULL AND pb IS NOT NULL THEN 1 END) AS m,
                 count(CASE WHEN NOT (pa IS NOT NULL AND pb IS NOT NULL) THEN 1 END) AS x FROM j GROUP BY slice),
u AS (SELECT * FROM per UNION ALL
      SELECT 'TOTAL', sum(p_a), sum(t_a), sum(p_b), sum(t_b), sum(m), sum(x) FROM per)
SELECT slice, round(100.0 * p_a / NULLIF(t_a, 0), 6) AS baseline_pct, round(100.0 * p_b / NULLIF(t_b, 0), 6) AS treated_pct,
       round(100.0 * p_b / NULLIF(t_b, 0) - 100.0 * p_a / NULLIF(t_a, 0), 6) AS delta_pts,
       CAST(m AS BIGINT) AS matched_evals, CAST(x AS BIGINT) AS excluded_evals,
       CAST(coalesce(t_a, 0) AS BIGINT) AS matched_assertions FROM u"""))
def e_compare(spark, sf):
    s = _scores(spark, sf)
    return E.e_compare(s.where(F.col("mode") == "baseline"), s.where(F.col("mode") == "treated"))


@query("e_guard", sql("""
, sl AS (SELECT DISTINCT mode, slice FROM lng)
SELECT 'different_model' AS "check", 'model-a vs model-b' AS detail
UNION ALL
SELECT 'slice_one_side', slice || CASE WHEN count(CASE WHEN mode = 'baseline' THEN 1 END) = 0
                                       THEN ' only in treated run' ELSE ' only in baseline run' END
FROM sl GROUP BY slice HAVING count(*) = 1"""))
def e_guard(spark, sf):
    s = _long(spark, sf)
    return E.e_guard(meta(spark, "baseline"), meta(spark, "treated"),
                     s.where(F.col("mode") == "baseline"), s.where(F.col("mode") == "treated"))


@query("e_negative", sql("""
SELECT side, round(passed, 6) AS passed, total, round(100.0 * passed / NULLIF(total, 0), 6) AS pass_pct FROM (
  SELECT 'baseline' AS side, coalesce(sum(passed), 0.0) AS passed, CAST(coalesce(sum(total), 0) AS BIGINT) AS total
  FROM sc WHERE mode = 'baseline' AND negative AND passed IS NOT NULL
  UNION ALL
  SELECT 'treated', coalesce(sum(passed), 0.0), CAST(coalesce(sum(total), 0) AS BIGINT)
  FROM sc WHERE mode = 'treated' AND negative AND passed IS NOT NULL) x"""))
def e_negative(spark, sf):
    s = _scores(spark, sf)
    return E.e_negative(s.where(F.col("mode") == "baseline"), s.where(F.col("mode") == "treated"))


DELTA_SQL = MATCH_SQL + """
, dd AS (SELECT slice, eval_id, pb * 100 / tb - pa * 100 / ta AS d FROM j WHERE pa IS NOT NULL AND pb IS NOT NULL)"""


@query("e_paired", sql(DELTA_SQL + """
, g AS (SELECT count(*) AS n, avg(d) AS m, stddev_samp(d) AS s, quantile_cont(d, 0.5) AS med,
               count(CASE WHEN d > 0 THEN 1 END) AS up, count(CASE WHEN d < 0 THEN 1 END) AS down,
               count(CASE WHEN d = 0 THEN 1 END) AS flat FROM dd),
t AS (SELECT sum(exp(lgamma(up + down + 1) - lgamma(i + 1) - lgamma(up + down - i + 1) - (up + down) * ln(2)))
             AS tail FROM g, range(0, (SELECT up + down + 1 FROM g)) r(i) WHERE i >= greatest(up, down))
SELECT n, round(m, 6) AS mean_delta, round(med, 6) AS median_delta, round(s, 6) AS sd_delta,
       round(m - 1.959964 * s / sqrt(n), 6) AS ci_lower, round(m + 1.959964 * s / sqrt(n), 6) AS ci_upper,
       up, down, flat, round(CASE WHEN up + down > 0 THEN tail END, 6) AS sign_p_one_sided,
       round(CASE WHEN up + down > 0 THEN least(1.0, 2 * tail) END, 6) AS sign_p_two_sided FROM g, t"""))
def e_paired(spark, sf):
    s = _scores(spark, sf)
    return E.e_paired(s.where(F.col("mode") == "baseline"), s.where(F.col("mode") == "treated"))


@query("e_sensitivity", sql("""
, s AS (SELECT mode, slice, eval_id, total, repeats, avg(passed) * 100 / total AS excl, count(passed) < repeats AS lost,
               sum(coalesce(passed, 0)) / repeats * 100 / total AS zero FROM lng
        GROUP BY mode, slice, eval_id, total, repeats),
j AS (SELECT a.excl AS ea, b.excl AS eb, a.lost AS la, b.lost AS lb, a.zero AS za, b.zero AS zb
      FROM (SELECT * FROM s WHERE mode = 'baseline') a JOIN (SELECT * FROM s WHERE mode = 'treated') b
        ON a.slice = b.slice AND a.eval_id = b.eval_id)
SELECT 'lost runs excluded' AS treatment, count(CASE WHEN ea IS NOT NULL AND eb IS NOT NULL THEN 1 END) AS n_evals,
       round(avg(CASE WHEN ea IS NOT NULL AND eb IS NOT NULL THEN eb - ea END), 6) AS mean_delta FROM j
UNION ALL
SELECT 'evals with a lost run dropped', count(CASE WHEN ea IS NOT NULL AND eb IS NOT NULL AND NOT la AND NOT lb THEN 1 END),
       round(avg(CASE WHEN ea IS NOT NULL AND eb IS NOT NULL AND NOT la AND NOT lb THEN eb - ea END), 6) FROM j
UNION ALL
SELECT 'lost runs scored 0', count(*), round(avg(zb - za), 6) FROM j"""))
def e_sensitivity(spark, sf):
    s = _long(spark, sf)
    return E.e_sensitivity(s.where(F.col("mode") == "baseline"), s.where(F.col("mode") == "treated"))


@query("e_informative_loss", sql("""
, pe AS (SELECT mode, slice, eval_id, repeats, count(passed) AS nr FROM lng GROUP BY ALL)
SELECT mode, slice, CAST(sum(repeats) AS BIGINT) AS expected_runs, CAST(sum(nr) AS BIGINT) AS valid_runs,
       CAST(sum(repeats) - sum(nr) AS BIGINT) AS lost_runs,
       round(100.0 * (sum(repeats) - sum(nr)) / sum(repeats), 6) AS lost_pct FROM pe GROUP BY mode, slice"""))
def e_informative_loss(spark, sf):
    return E.e_informative_loss(_long(spark, sf))


@query("e_spec_check", """
WITH s AS (SELECT item_id, list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0) AS a,
                  contains(text, '?') AS neg FROM benchmark)
SELECT count(*) AS n_evals, count(CASE WHEN len(a) = 0 THEN 1 END) AS evals_without_assertions,
       CAST(sum(len(a)) AS BIGINT) AS n_assertions, count(CASE WHEN neg THEN 1 END) AS n_negative,
       (SELECT count(*) FROM (SELECT item_id FROM benchmark GROUP BY 1 HAVING count(*) > 1)) AS duplicate_ids,
       round(100.0 * count(CASE WHEN neg THEN 1 END) / count(*), 6) AS negative_pct FROM s""")
def e_spec_check(spark, sf):
    """Eval specs = benchmark items; each non-blank line of the prompt text is
    an assertion; an item containing a question mark is a negative test."""
    b = Tables(spark, sf).benchmark
    specs = b.select("item_id", F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0).alias("a"),
                     F.col("text").contains("?").alias("neg"))
    return E.e_spec_check(specs, "item_id", "a", "neg")


@query("e_orphan_figure", f"""
WITH f AS (SELECT doc_id, CAST(replace(x, ',', '') AS DOUBLE) AS figure
           FROM (SELECT doc_id, unnest(regexp_extract_all({ASCII_WORDS}, '{FIGURE_RE2}', 1)) AS x FROM documents) y),
k AS (SELECT DISTINCT round(o_totalprice, 1) AS v FROM orders
      UNION SELECT o_totalprice FROM orders WHERE o_totalprice = floor(o_totalprice))
SELECT doc_id, figure FROM f WHERE round(figure, 1) NOT IN (SELECT v FROM k)""")
def e_orphan_figure(spark, sf):
    """Figures quoted in documents that match no pinned value (order totals)."""
    from plumbline.functions.text import may_hold_figures
    t = Tables(spark, sf)
    docs = t.documents.where(may_hold_figures("text"))
    return E.e_orphan_figure(docs, "doc_id", number_figures("text"), t.orders, "o_totalprice")


@query("e_trend", sql("""
, r AS (SELECT *, passed = total AS ok FROM lng WHERE passed IS NOT NULL),
f AS (SELECT *, lag(ok) OVER (PARTITION BY mode, slice, eval_id ORDER BY run_no) AND NOT ok AS flip FROM r),
pr AS (SELECT mode, slice, run_no, sum(passed) / sum(total) AS rate, count(CASE WHEN flip THEN 1 END) AS flips
       FROM f GROUP BY ALL)
SELECT mode, slice, round(regr_slope(rate, run_no), 6) AS slope_per_run, CAST(sum(flips) AS BIGINT) AS pass_to_fail_flips,
       regr_slope(rate, run_no) < 0 AS declining FROM pr GROUP BY mode, slice"""))
def e_trend(spark, sf):
    return E.e_trend(_long(spark, sf))


@query("e_trap_rate", sql("""
SELECT mode, trap, count(*) AS evals, round(100.0 * sum(passed) / sum(total), 6) AS pass_pct
FROM sc WHERE passed IS NOT NULL GROUP BY mode, trap"""))
def e_trap_rate(spark, sf):
    return E.e_trap_rate(_scores(spark, sf))
