"""§2.10 uncertainty and disclosure on the rehearsal spells."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.stats import safe_div
from plumbline.operators import uncertainty as U
from plumbline.plans.rehearsal import AS_OF, SPELL_SQL, alive_at, spells, with_sql
from plumbline.plans.registry import query
from plumbline.plans.sqlfrag import f, normal_tail_sql, poisson_sql, t_quantile_ctes, wilson_sql
from plumbline.session import materialize_small
from plumbline.sources.tables import Tables


def _by(spark, sf, *dims):
    s = spells(Tables(spark, sf))
    return s.groupBy(*dims).agg(F.count("*").alias("n"),
                                F.count("sep").alias("separated"))


BY_UNIT_SQL = with_sql(SPELL_SQL, "g AS (SELECT unit, count(*) AS n, count(sep) AS separated FROM spell GROUP BY unit)")
LIVE_SQL = with_sql(SPELL_SQL, "live AS (SELECT * FROM spell WHERE hire <= DATE '2001-06-30' AND (sep IS NULL OR sep > DATE '2001-06-30'))")


@query("u_small_cells", LIVE_SQL + """
SELECT unit, wtype, count(DISTINCT k) AS n FROM live GROUP BY unit, wtype HAVING count(DISTINCT k) < 5""")
def u_small_cells(spark, sf):
    live = spells(Tables(spark, sf)).where(alive_at(AS_OF))
    return U.u_small_cells(live, ["unit", "wtype"], "k", 5)


@query("u_suppress", with_sql(SPELL_SQL) + """
, g AS (SELECT unit, wtype, count(*) AS n, count(sep) AS separated,
               round(100.0 * count(sep) / count(*), 6) AS rate_pct FROM spell GROUP BY unit, wtype)
SELECT unit, wtype, CASE WHEN n >= 5 THEN n END AS n, CASE WHEN n >= 5 THEN separated END AS separated,
       CASE WHEN n >= 5 THEN rate_pct END AS rate_pct,
       CASE WHEN n < 5 THEN 'suppressed (n < 5)' ELSE 'shown' END AS disclosure FROM g""")
def u_suppress(spark, sf):
    g = _by(spark, sf, "unit", "wtype").withColumn(
        "rate_pct", F.round(safe_div(F.col("separated") * 100, "n"), 6))
    return U.u_suppress(g, "n", ["separated", "rate_pct"], 5)


def _complementary_sql(rounds: int = 8) -> str:
    """The same fixpoint unrolled for a fixed number of rounds; once stable a
    round changes nothing, so it equals the Spark loop whenever that
    converges within ``rounds`` (and would show a mismatch otherwise)."""
    parts = ["c0 AS (SELECT unit, wtype, GROUPING(unit, wtype) AS gid, count(DISTINCT k) AS n "
             "FROM live GROUP BY CUBE (unit, wtype))",
             "s0 AS (SELECT unit, wtype, gid, n, n < 5 AS hidden, CASE WHEN n < 5 THEN 'primary' END AS reason, "
             "CAST(gid AS VARCHAR) || chr(1) || coalesce(unit, '') || chr(1) || coalesce(wtype, '') AS cell_id "
             "FROM c0)"]
    for i in range(1, rounds + 1):
        prev = f"s{i - 1}"
        parts.append(f"m{i} AS (SELECT cell_id, n, hidden, unnest(CASE gid WHEN 0 THEN ['r:' || unit, 'c:' || wtype] "
                     f"WHEN 1 THEN ['r:' || unit, 'R'] WHEN 2 THEN ['c:' || wtype, 'C'] ELSE ['R', 'C'] END) AS line "
                     f"FROM {prev})")
        parts.append(f"p{i} AS (SELECT line, sum(CASE WHEN hidden THEN 1 ELSE 0 END) AS h, "
                     f"arg_min(cell_id, (n, cell_id)) FILTER (WHERE NOT hidden) AS pick FROM m{i} GROUP BY line)")
        parts.append(f"k{i} AS (SELECT DISTINCT pick AS cell_id FROM p{i} WHERE h = 1 AND pick IS NOT NULL)")
        parts.append(f"s{i} AS (SELECT x.unit, x.wtype, x.gid, x.n, x.cell_id, "
                     f"x.hidden OR k.cell_id IS NOT NULL AS hidden, "
                     f"CASE WHEN k.cell_id IS NOT NULL AND NOT x.hidden THEN 'complementary' ELSE x.reason END AS reason "
                     f"FROM {prev} x LEFT JOIN k{i} k ON k.cell_id = x.cell_id)")
    return (LIVE_SQL + ", " + ",\n".join(parts) + f"""
SELECT unit, wtype, CASE gid WHEN 0 THEN 'cell' WHEN 1 THEN 'row_total' WHEN 2 THEN 'column_total'
                             ELSE 'grand_total' END AS level,
       CASE WHEN NOT hidden THEN n END AS n_shown, hidden, coalesce(reason, 'shown') AS reason
FROM s{rounds}""")


@query("u_complementary", _complementary_sql())
def u_complementary(spark, sf):
    """Primary + complementary suppression of live spells by unit x segment
    (an iterative fixpoint over the cube of cells and margins)."""
    live = spells(Tables(spark, sf)).where(alive_at(AS_OF))
    return U.u_complementary(live, "unit", "wtype", "k", 5)


@query("u_recoverable", LIVE_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + """
, c AS (SELECT unit, wtype, GROUPING(unit, wtype) AS gid, count(DISTINCT k) AS n
        FROM live GROUP BY CUBE (unit, wtype)),
cells AS (SELECT unit, wtype, gid, n < 5 AS hidden,
                 CAST(gid AS VARCHAR) || chr(1) || coalesce(unit, '') || chr(1) || coalesce(wtype, '') AS cell_id
          FROM c),
m AS (SELECT cell_id, hidden, unnest(CASE gid WHEN 0 THEN ['r:' || unit, 'c:' || wtype]
                                              WHEN 1 THEN ['r:' || unit, 'R']
                                              WHEN 2 THEN ['c:' || wtype, 'C'] ELSE ['R', 'C'] END) AS line
      FROM cells),
ed AS (SELECT cell_id AS e, min(line) AS a, max(line) AS b FROM m WHERE hidden GROUP BY cell_id),
nb AS (SELECT e, a AS v, b AS w FROM ed UNION ALL SELECT e, b, a FROM ed),
go AS (SELECT e, a AS v FROM ed UNION SELECT go.e, nb.w FROM go JOIN nb ON nb.v = go.v AND nb.e <> go.e),
pl AS (SELECT line, count(*) AS h FROM m WHERE hidden GROUP BY line),
lone AS (SELECT cell_id, count(*) AS le FROM m JOIN pl USING (line) WHERE hidden AND h = 1 GROUP BY cell_id)
SELECT unit, wtype, CASE gid WHEN 0 THEN 'cell' WHEN 1 THEN 'row_total' WHEN 2 THEN 'column_total'
                             ELSE 'grand_total' END AS level,
       CAST(coalesce(le, 0) AS BIGINT) AS lines_exposing,
       NOT EXISTS (SELECT 1 FROM go JOIN ed ON ed.e = go.e WHERE go.e = cell_id AND go.v = ed.b) AS recoverable
FROM cells LEFT JOIN lone USING (cell_id) WHERE hidden""")
def u_recoverable(spark, sf):
    """Publish with primary suppression only, then audit what subtraction
    would reveal (the complementary-disclosure risk)."""
    live = spells(Tables(spark, sf)).where(alive_at(AS_OF))
    pub = live.cube("unit", "wtype").agg(F.count_distinct("k").alias("n")) \
        .withColumn("n_shown", F.when(F.col("n") >= 5, F.col("n")))
    return U.u_recoverable(pub, "unit", "wtype", "n_shown")


_wlo, _whi = wilson_sql("separated", "n")


@query("u_wilson", BY_UNIT_SQL + f"""
SELECT unit, n, separated, round(100.0 * separated / NULLIF(n, 0), 6) AS rate_pct,
       round({_wlo} * 100, 6) AS lower_pct, round({_whi} * 100, 6) AS upper_pct FROM g""")
def u_wilson(spark, sf):
    return U.u_wilson(_by(spark, sf, "unit"), "separated", "n")


_plo, _phi = poisson_sql("events")


@query("u_poisson", with_sql(SPELL_SQL) + f"""
, g AS (SELECT loc, count(sep) AS events, count(*) AS exposure FROM spell GROUP BY loc)
SELECT loc, events, exposure, round({_plo}, 6) AS count_lower, round({_phi}, 6) AS count_upper,
       round(100.0 * events / NULLIF(exposure, 0), 6) AS rate_per_100,
       round({_plo} * 100 / NULLIF(exposure, 0), 6) AS rate_lower,
       round({_phi} * 100 / NULLIF(exposure, 0), 6) AS rate_upper FROM g""")
def u_poisson(spark, sf):
    g = spells(Tables(spark, sf)).groupBy("loc").agg(F.count("sep").alias("events"),
                                                     F.count("*").alias("exposure"))
    return U.u_poisson(g, "events", "exposure")


@query("u_stability", with_sql(SPELL_SQL) + """
SELECT unit, wtype, count(*) AS n,
       CASE WHEN count(*) < 5 THEN 'suppressed' WHEN count(*) < 30 THEN 'unstable' ELSE 'stable' END AS stability
FROM spell GROUP BY unit, wtype""")
def u_stability(spark, sf):
    g = spells(Tables(spark, sf)).groupBy("unit", "wtype").agg(F.count("*").alias("n"))
    return g.withColumn("stability", U.u_stability("n"))


_za, _zb = U.z_values()


@query("u_rate_block", with_sql(SPELL_SQL) + f"""
, g AS (SELECT loc, count(*) AS n, count(sep) AS separated FROM spell GROUP BY loc),
t AS (SELECT sum(n) AS tn, sum(separated) AS tx, count(*) AS k FROM g)
SELECT loc, CASE WHEN n >= 5 THEN n END AS n, CASE WHEN n >= 5 THEN separated END AS separated, 'separation rate' AS metric,
       CASE WHEN n >= 5 THEN printf('%.1f%% (%d / %d)', round(100.0 * separated / n, 1), separated, n)
            ELSE 'suppressed (n < 5)' END AS value_text,
       CASE WHEN n >= 5 THEN round({wilson_sql('separated', 'n')[0]} * 100, 6) END AS lower_pct,
       CASE WHEN n >= 5 THEN round({wilson_sql('separated', 'n')[1]} * 100, 6) END AS upper_pct,
       'Wilson score, 95%' AS method,
       CASE WHEN n < 5 THEN 'suppressed' WHEN n < 30 THEN 'unstable' ELSE 'stable' END AS stability,
       k AS comparisons, 'exploratory' AS analysis, CASE WHEN n >= 5 THEN
       round(({f(_za)} + {f(_zb)}) * sqrt((tx / tn) * (1 - tx / tn) * (1 / n + 1 / (tn - n))) * 100, 6) END
         AS detectable_pts
FROM g, t""")
def u_rate_block(spark, sf):
    """Separation rate by region in the standard block, with the detectable
    gap of each region against the rest as the interpretation limit."""
    g = materialize_small(_by(spark, sf, "loc"))
    tn = g.select(F.sum("n")).scalar()
    tx = g.select(F.sum("separated")).scalar()
    k = g.select(F.count("*")).scalar()
    p = tx / tn
    mde = U.u_mde(F.col("n"), tn - F.col("n"), p) * 100
    return U.u_rate_block(g, "separation rate", "separated", "n", k, False, limit=mde)


@query("u_multiplicity", BY_UNIT_SQL + f"""
, t AS (SELECT sum(separated) AS tx, sum(n) AS tn, count(*) AS k FROM g),
z AS (SELECT unit, separated, n, k,
             (separated / n - (tx - separated) / (tn - n))
             / NULLIF(sqrt((1.0 * tx / tn) * (1 - 1.0 * tx / tn) * (1 / n + 1 / (tn - n))), 0) AS zc
      FROM g, t),
p AS (SELECT *, 2 * {normal_tail_sql('abs(zc)')} AS pv FROM z),
r AS (SELECT *, row_number() OVER (ORDER BY pv ASC NULLS LAST, unit) AS rn FROM p)
SELECT unit, separated, n, round(zc, 6) AS z, round(pv, 6) AS p_value, round(log10(NULLIF(pv, 0)), 6) AS log10_p, k AS comparisons,
       round(least(1.0, pv * k), 6) AS p_bonferroni,
       round(least(1.0, min(pv * k / rn) OVER (ORDER BY rn DESC ROWS UNBOUNDED PRECEDING)), 6) AS p_bh
FROM r""")
def u_multiplicity(spark, sf):
    return U.u_multiplicity(_by(spark, sf, "unit"), "unit", "separated", "n")


SHRINK_SQL = """
, t AS (SELECT sum(separated) AS x, sum(n) AS tn, count(*) AS gg FROM g),
mm AS (SELECT x / tn AS m, tn, gg FROM t),
wv AS (SELECT sum(n * pow(separated / n - (SELECT m FROM mm), 2)) / sum(n) AS wv FROM g),
tau AS (SELECT wv - m * (1 - m) * gg / tn AS tau2, m FROM wv, mm),
al AS (SELECT m, CASE WHEN tau2 > 0 THEN greatest(0.0, m * (1 - m) / tau2 - 1) END AS alpha FROM tau),
s AS (SELECT unit, separated, n, round(100.0 * separated / NULLIF(n, 0), 6) AS raw_pct,
             round(CASE WHEN alpha IS NULL THEN m ELSE (separated + alpha * m) / (n + alpha) END * 100, 6) AS shrunk_pct,
             round(m * 100, 6) AS overall_pct, round(alpha, 6) AS prior_weight
      FROM g, al)"""


@query("u_shrink", BY_UNIT_SQL + SHRINK_SQL + "\nSELECT * FROM s")
def u_shrink(spark, sf):
    return U.u_shrink(_by(spark, sf, "unit"), "unit", "separated", "n")


@query("u_league", BY_UNIT_SQL + SHRINK_SQL + f"""
, r AS (SELECT s.*, round({_wlo} * 100, 6) AS lower_pct, round({_whi} * 100, 6) AS upper_pct,
               CAST(rank() OVER (ORDER BY raw_pct DESC NULLS LAST) AS BIGINT) AS raw_rank,
               CAST(rank() OVER (ORDER BY shrunk_pct DESC NULLS LAST) AS BIGINT) AS shrunk_rank
        FROM s)
SELECT *, raw_rank - shrunk_rank AS rank_change,
       CASE WHEN n < 5 THEN 'suppressed' WHEN n < 30 THEN 'unstable' ELSE 'stable' END AS stability FROM r""")
def u_league(spark, sf):
    return U.u_league(_by(spark, sf, "unit"), "unit", "separated", "n")


ARMS_SQL = with_sql(SPELL_SQL, """a AS (SELECT count(CASE WHEN treated = 1 THEN 1 END) AS n1,
                  count(CASE WHEN treated = 1 AND sep IS NOT NULL THEN 1 END) AS x1,
                  count(CASE WHEN treated = 0 THEN 1 END) AS n0,
                  count(CASE WHEN treated = 0 AND sep IS NOT NULL THEN 1 END) AS x0 FROM spell)""")


def _arms(spark, sf):
    s = spells(Tables(spark, sf))
    return s.agg(F.count_if(F.col("treated") == 1).alias("n1"),
                 F.count_if((F.col("treated") == 1) & F.col("sep").isNotNull()).alias("x1"),
                 F.count_if(F.col("treated") == 0).alias("n0"),
                 F.count_if((F.col("treated") == 0) & F.col("sep").isNotNull()).alias("x0"))


@query("u_mde", ARMS_SQL + f"""
SELECT n1, n0, round((x1 + x0) * 1.0 / (n1 + n0), 6) AS pooled_rate,
       round(({f(_za)} + {f(_zb)}) * sqrt(((x1 + x0) / (n1 + n0)) * (1 - (x1 + x0) / (n1 + n0))
             * (1 / n1 + 1 / n0)) * 100, 6) AS mde_pts
FROM a""")
def u_mde(spark, sf):
    a = _arms(spark, sf)
    p = (F.col("x1") + F.col("x0")) / (F.col("n1") + F.col("n0"))
    return a.select("n1", "n0", F.round(p, 6).alias("pooled_rate"),
                    F.round(U.u_mde(F.col("n1"), F.col("n0"), p) * 100, 6).alias("mde_pts"))


_l1, _u1 = wilson_sql("x1", "n1")
_l0, _u0 = wilson_sql("x0", "n0")


@query("u_diff_ci", ARMS_SQL + f"""
, q AS (SELECT *, x1 / n1 AS p1, x0 / n0 AS p0 FROM a)
SELECT n1, x1, n0, x0, round((p1 - p0) * 100, 6) AS diff_pts,
       round((p1 - p0 - sqrt(pow(p1 - {_l1}, 2) + pow({_u0} - p0, 2))) * 100, 6) AS lower_pts,
       round((p1 - p0 + sqrt(pow({_u1} - p1, 2) + pow(p0 - {_l0}, 2))) * 100, 6) AS upper_pts
FROM q""")
def u_diff_ci(spark, sf):
    a = _arms(spark, sf)
    d, lo, hi = U.u_diff_ci(F.col("x1"), F.col("n1"), F.col("x0"), F.col("n0"))
    return a.select("n1", "x1", "n0", "x0", F.round(d * 100, 6).alias("diff_pts"),
                    F.round(lo * 100, 6).alias("lower_pts"), F.round(hi * 100, 6).alias("upper_pts"))


@query("u_diff_means", with_sql(SPELL_SQL, """g AS (
  SELECT loc, count(CASE WHEN treated = 1 THEN bal END) AS n1, count(CASE WHEN treated = 0 THEN bal END) AS n0,
         avg(CASE WHEN treated = 1 THEN bal END) AS m1, avg(CASE WHEN treated = 0 THEN bal END) AS m0,
         var_samp(CASE WHEN treated = 1 THEN bal END) AS v1, var_samp(CASE WHEN treated = 0 THEN bal END) AS v0
  FROM spell GROUP BY loc)""", "w AS (SELECT *, v1 / n1 AS e1, v0 / n0 AS e0 FROM g)",
                                t_quantile_ctes("w", "pow(e1 + e0, 2) / (e1 * e1 / (n1 - 1) + e0 * e0 / (n0 - 1))")) + """
SELECT loc, n1, n0, round(m1, 6) AS mean1, round(m0, 6) AS mean0, round(m1 - m0, 6) AS diff,
       round(m1 - m0 - t * sqrt(e1 + e0), 6) AS lower, round(m1 - m0 + t * sqrt(e1 + e0), 6) AS upper,
       round(nu, 6) AS degrees FROM tq""")
def u_diff_means(spark, sf):
    """Mean balance with and without the program, by region, with Welch intervals."""
    return U.u_diff_means(spells(Tables(spark, sf)), "treated", "bal", ["loc"])
