"""Audits that count from groups instead of pairs, one-pass text audits, and
what a broadcast may hold."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import audit as A
from plumbline.operators import compare as K
from plumbline.operators import joins as J
from plumbline.operators import textscan as X
from plumbline.session import app_cache


def test_common_method_counts_equal_the_pairs(spark):
    rng = random.Random(3)
    data = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "w1", "w2"]), rng.choice([5, 7]), rng.choice("abx")) for _ in range(400)]
    df = spark.createDataFrame(data, "person int, wave string, instrument int, item string")
    got = K.k_common_method(df, "person", ["wave", "instrument"], F.col("item") == "a", F.col("item") == "b").first()
    pairs = [(a, b) for a, b in itertools.product([r for r in data if r[3] == "a"], [r for r in data if r[3] == "b"])
             if a[0] is not None and a[0] == b[0]]
    same = sum(a[1:3] == b[1:3] for a, b in pairs)
    assert (got.n_pairs, got.n_same_source) == (len(pairs), same)
    assert got.same_source_pct == pytest.approx(100 * same / len(pairs), abs=1e-6)
    none = K.k_common_method(df.limit(0), "person", ["wave"], F.col("item") == "a", F.col("item") == "b").first()
    assert (none.n_pairs, none.n_same_source, none.same_source_pct) == (0, 0, None)


def test_units_are_rows_and_null_groups_are_groups(spark):
    df = spark.createDataFrame([("a", "EUR"), ("a", "EUR"), ("a", "USD"), ("b", "EUR"), ("b", None), (None, "GBP")], "g string, u string")
    got = {tuple(r) for r in A.a_units(df, "u", ["g"]).collect()}
    assert got == {("a", "EUR", 2, 2, True), ("a", "USD", 1, 2, True), ("b", "EUR", 1, 1, False), ("b", None, 1, 1, False),
                   (None, "GBP", 1, 1, False)}


def test_distinct_mask_of_a_join_equals_the_joined_rows(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "k int")
    right = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,), (4,)], "j int")
    got = A.a_distinct_mask_join(left, right, "k", "j")
    assert got.collect() == A.a_distinct_mask(left.join(right, F.col("k") == F.col("j")), "k").collect()
    assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().toString()


QUERIES = [("q1", "SELECT DISTINCT old_col FROM orders JOIN ghost ON OLD_COL = x"), ("q2", "select 1"), ("q3", None), ("q4", ""),
           ("q1", "SELECT old_col FROM ghost"), (None, "select a from orders join GHOST")]
WANT = sorted([("q1", 2, 1), ("q2", 0, 0), ("q3", 0, 0), ("q4", 0, 0), ("q1", 1, 1), ("", 0, 1)])


@pytest.mark.parametrize("limit", [10_000, 0])
def test_lint_in_the_row_and_by_join_agree(spark, monkeypatch, limit):
    """Long lists are joined instead of compiled; repeated and null ids, null and empty texts keep a row."""
    monkeypatch.setattr(X, "MAX_COMPILED_NAMES", limit)
    q = spark.createDataFrame(QUERIES, "id string, text string")
    old = spark.createDataFrame([("Old_Col",), (None,)], "name string")
    known = spark.createDataFrame([("ORDERS",), ("orders",)], "name string")
    got = X.t_sql_lint(q, "id", "text", old, known)
    assert sorted((r.id or "", r.n_deprecated, r.n_undocumented_tables) for r in got.collect()) == WANT


def test_lint_reads_the_texts_once_without_a_shuffle(spark, tmp_path):
    many = spark.range(0, 1000, 1, 64).select(F.col("id").cast("string").alias("id"), F.lit("select x from y").alias("text"))
    names = spark.createDataFrame([("y",)], "name string")
    plan = X.t_sql_lint(many, "id", "text", names, names)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range") == 1 and "Exchange" not in plan


def test_doc_refs_one_scan(spark):
    docs = spark.createDataFrame([(1, "`orders` `Orders.o_orderkey` `o_orderkey` `nope` `nope.x` `o_orderkey.z`"), (2, None), (None, "`nope` `orders`"),
                                  (1, "`nope`")], "id int, text string")
    catalog = spark.createDataFrame([("orders", "o_orderkey"), ("orders", "o_custkey")], "table_name string, column_name string")
    got = X.t_doc_refs(docs, "id", "text", catalog)
    assert sorted((r.id or 0, r.ref) for r in got.collect()) == [(0, "nope"), (1, "nope"), (1, "nope"), (1, "nope.x"), (1, "o_orderkey.z")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 2  # the generator and its null filter


def test_a_broadcast_is_proven_in_rows_and_bytes(spark, monkeypatch):
    df = spark.createDataFrame([(i, "x" * 100, ["y" * 50]) for i in range(20)], "i int, s string, a array<string>")
    hinted = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(J.broadcast_bounded(df, 20)) and not hinted(J.broadcast_bounded(df, 19))
    monkeypatch.setattr(J, "MAX_BROADCAST_BYTES", 20 * 150)
    assert not hinted(J.broadcast_bounded(df, 20))


def test_caches_end_with_their_application(spark):
    app_cache(spark, "trial")["x"] = 1
    assert app_cache(spark, "trial") == {"x": 1}

    class Later:
        class sparkContext:
            applicationId = "another"
    from plumbline import session
    kept = dict(session._CACHES)
    try:
        assert app_cache(Later, "trial") == {} and list(session._CACHES) == ["another"]
    finally:
        session._CACHES.clear()
        session._CACHES.update(kept)
