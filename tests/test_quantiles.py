"""Exact quantiles: rank selection on (value, count) pairs (forced with a tiny
band) equals the frequency path and DuckDB's quantile_cont."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators.quantiles import exact_quantiles, rank_selected
from tests.conftest import SF_SMALL

P = [0, 0.1, 0.25, 0.5, 0.75, 0.9, 1]


def _duck(by):
    con = duckdb.connect()
    sel = ", ".join(f"quantile_cont(o_totalprice, {p})" for p in P)
    if by:
        return {r[0]: [round(x, 6) for x in r[1:]] for r in
                con.execute(f"SELECT {by}, {sel} FROM '{SF_SMALL}/orders.parquet' GROUP BY 1").fetchall()}
    return [round(x, 6) for x in con.execute(f"SELECT {sel} FROM '{SF_SMALL}/orders.parquet'").fetchone()]


@pytest.mark.parametrize("hot_rows", [40, 2_000_000])
def test_rank_selection_grouped(spark, hot_rows):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    got = {r["o_orderpriority"]: [round(x, 6) for x in r["__q"]]
           for r in exact_quantiles(o, "o_totalprice", ["o_orderpriority"], P, max_band=20, hot_rows=hot_rows).collect()}
    assert got == _duck("o_orderpriority")


def test_rank_selection_ungrouped(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    got = [round(x, 6) for x in exact_quantiles(o, "o_totalprice", [], P, max_band=30, hot_rows=100).first()["__q"]]
    assert got == _duck(None)


@pytest.mark.parametrize("max_band", [5, 1_000_000])
def test_one_value_holds_most_rows(spark, max_band):
    """A value with 60 % of all rows, small and big groups, a null label, null values."""
    rng = np.random.default_rng(1)
    groups = {"hot": [7.0] * 600 + rng.normal(7, 3, 400).tolist(), None: [1.0, 1.0, 2.0] * 30 + rng.normal(size=50).tolist(),
              "few": [3.0, 4.0], "one": [5.0]}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r.g: r["__q"] for r in exact_quantiles(df, "v", ["g"], P, max_band=max_band, hot_rows=60).collect()}
    assert got.keys() == groups.keys()
    for g, vs in groups.items():
        assert got[g] == pytest.approx(np.quantile(vs, P).tolist())


def test_no_array_over_a_group(spark):
    """Rank selection gathers no values of a group."""
    pairs = spark.range(700).select(F.struct(F.lit(0)).alias("__g"), F.col("id").cast("double").alias("__v"), F.lit(3).alias("__f"))
    sizes = spark.range(1).select(F.struct(F.lit(0)).alias("__k"), F.lit(2100).alias("__n"))
    out = rank_selected(pairs, sizes, P, hot_rows=100)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_" not in plan and "percentile" not in plan
    assert out.first()["__q"] == pytest.approx(np.quantile(np.arange(2100) // 3, P).tolist())
