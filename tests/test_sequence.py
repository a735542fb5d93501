"""Skew-safe keyed windows equal the plain per-key window: hot keys, a hot null
key, a hot key on one day, and ties cut at range boundaries."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import sequence
from plumbline.operators.sequence import keyed_window, value_ranks
from tests.conftest import SF_SMALL


def same_rows(a, b):
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def orders(spark, key):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    return o.select(key.alias("k"), F.col("o_orderdate").cast("date").alias("start"), F.col("o_orderkey").alias("ref"),
                    F.when(F.col("o_totalprice") > 200000, F.lit(1)).alias("flag"))


def keys(name):
    third = F.col("o_orderkey") % 3
    return {"hot": F.when(third == 0, F.lit(7)).otherwise(F.col("o_custkey")), "hot null": F.when(third != 0, F.col("o_custkey")),
            "one key": F.lit(1), "two hot": F.when(third == 0, F.lit(7)).when(third == 1, F.lit(8)).otherwise(F.col("o_custkey"))}[name]


@pytest.mark.parametrize("day", ["as is", "one day", "null day"])
@pytest.mark.parametrize("key", ["hot", "hot null", "one key", "two hot"])
def test_keyed_window_matches_plain(spark, key, day):
    j = orders(spark, keys(key))
    if day != "as is":
        j = j.withColumn("start", F.lit("2020-01-01" if day == "one day" else None).cast("date"))
    got = keyed_window(j, "k", ["start", "ref"], lead=["start", "flag"], lag=["start", "flag"], row_number="rn",
                       running_sum={"cum": "flag"}, running_min={"least": F.col("flag") * F.col("ref")}, ffill=["flag"], hot_rows=50)
    w = Window.partitionBy("k").orderBy("start", "ref")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    want = j.withColumns({
        "filled_flag": F.last("flag", ignorenulls=True).over(so_far), "next_start": F.lead("start").over(w),
        "next_flag": F.lead("flag").over(w), "prev_start": F.lag("start").over(w), "prev_flag": F.lag("flag").over(w),
        "rn": F.row_number().over(w), "cum": F.sum("flag").over(so_far),
        "least": F.min(F.col("flag") * F.col("ref")).over(so_far)})
    same_rows(got.select(want.columns), want)


def test_ties_are_cut_anywhere(spark):
    """One key with one order value: positions are a permutation, sums agree with them."""
    df = spark.range(3000).select(F.lit(None).cast("int").alias("k"), F.lit(0).alias("t"), F.lit(2).alias("x"))
    got = keyed_window(df, "k", ["t"], row_number="rn", running_sum={"cum": "x"}, hot_rows=100)
    assert sorted(r.rn for r in got.collect()) == list(range(1, 3001)) and got.where("cum != 2 * rn").count() == 0


def test_input_runs_once_and_no_task_holds_the_key(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b
    df = spark.range(4000).select(F.lit(1).alias("k"), F.col("id").alias("t")).mapInPandas(count, "k int, t long")
    got = keyed_window(df, "k", ["t"], lag=["t"], hot_rows=400)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert got.where("prev_t != t - 1").count() == 0 and got.where("prev_t is null").count() == 1
    assert seen.value == 4000 and sum(sizes) == 4000


def test_more_spanning_keys_than_may_be_broadcast(spark, monkeypatch):
    monkeypatch.setattr(sequence, "MAX_CARRY", 3)
    df = spark.range(3000).select((F.col("id") % 4).alias("k"), F.col("id").alias("t"))
    got = keyed_window(df, "k", ["t"], row_number="rn", lead=["t"], hot_rows=100)
    assert got.where("rn != floor(t / 4) + 1").count() == 0 and got.where("next_t is null").count() == 4


def test_keyed_window_without_hot_keys_is_plain(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "k int, t int")
    r = sorted(tuple(x) for x in keyed_window(df, "k", ["t"], lead=["t"], row_number="rn").collect())
    assert r == [(1, 1, 2, 1), (1, 2, None, 2), (2, 1, None, 1)]


@pytest.mark.parametrize("hot_rows", [25, 2_000_000])
def test_value_ranks(spark, hot_rows):
    rng = np.random.default_rng(3)
    vs = [None if x == 0 else float(x) for x in rng.integers(0, 90, 400)]
    got = value_ranks(spark.createDataFrame(list(enumerate(vs)), "i int, v double"), "v", "r", hot_rows).collect()
    assert len(got) == 400
    for r in got:
        assert r.r == 1 + sum(x is not None and (r.v is None or x > r.v) for x in vs)


def test_asof_join_matches_range_join_with_hot_key(spark):
    from plumbline.operators.etl import etl_history
    from plumbline.operators.joins import join_asof_dim
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    ch = o.select(keys("hot").alias("k"), F.col("o_orderdate").cast("date").alias("start"), F.col("o_orderkey").alias("ref"),
                  F.col("o_orderpriority").alias("unit_code"))
    h = etl_history(ch, "k", "start", "ref")
    f = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        keys("hot").alias("k"), F.col("l_shipdate").cast("date").alias("ship"), "l_orderkey", "l_linenumber")
    got = join_asof_dim(f, h, "k", "ship", "start", "effective_end", ["unit_code"], hot_rows=40)
    d = h.select(F.col("k").alias("dk"), "start", "effective_end", "unit_code")
    want = f.join(d, (f.k == d.dk) & (f.ship >= d.start) & (f.ship <= d.effective_end), "left") \
        .select("k", "ship", "l_orderkey", "l_linenumber", "unit_code")
    same_rows(got.select(want.columns), want)
