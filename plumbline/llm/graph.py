"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import attach, store


def relabelled(edges: DataFrame, labels: DataFrame, end: str) -> DataFrame:
    """``edges`` with one end replaced by its root."""
    other = "b" if end == "a" else "a"
    weight = edges.groupBy(end).agg(F.count(F.lit(1)).alias("_w"))
    roots = weight.join(labels.select(F.col("id").alias(end), "root"), end)
    out = attach(edges, roots, end, other, "_w")
    return out.select(F.coalesce("root", end).alias(end), other).select("a", "b")


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct (a, b) with a < b."""
    return edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def tree_roots(step: DataFrame) -> DataFrame:
    """(id, root) of moves to smaller ids, each followed to its end: every pass
    replaces a root by its own root, so a chain of n moves takes log2(n) passes."""
    while True:
        moving = step.where("id != root")
        ends = moving.groupBy(F.col("root").alias("mid")).agg(F.count(F.lit(1)).alias("w"))
        hop = store(ends.join(moving.select(F.col("id").alias("mid"), F.col("root").alias("next")), "mid"), "hop")
        if hop.isEmpty():
            return step
        on = attach(step.withColumnRenamed("root", "mid"), hop, "mid", "id", "w")
        step = store(on.select("id", F.coalesce("next", "mid").alias("root")), "step")


def components(links: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """(id, root): the least id of each linked id's component, for links (a, b);
    ``old`` is a labelling that the links go on from.

    Each round every vertex moves to its least neighbour, moves are followed to
    their end, and the graph is contracted. A vertex that stays either has another
    moved to it or, in the contracted graph, a neighbour smaller than itself, so two
    rounds at least halve the vertices: rounds grow with the logarithm of the
    component's size, for chains and stars alike. Hot vertices go through
    ``common.attach``; every round's state is a written table."""
    labels, edges = old, links
    if old is not None:
        for end in ("a", "b"):
            edges = relabelled(edges, old, end)
    edges = store(undirected(edges), "edges")
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).toDF("id", "near")
        step = tree_roots(store(both.groupBy("id").agg(F.least("id", F.min("near")).alias("root")), "step"))
        if labels is None:
            labels = step
        else:
            held = labels.groupBy(F.col("root").alias("mid")).agg(F.count(F.lit(1)).alias("w"))
            to = held.join(step.select(F.col("id").alias("mid"), "root"), "mid")
            moved = attach(labels.withColumnRenamed("root", "mid"), to, "mid", "id", "w")
            fresh = step.join(labels.select("id"), "id", "left_anti")
            labels = moved.select("id", F.coalesce("root", "mid").alias("root")).union(fresh)
        labels = store(labels, "labels")
        for end in ("a", "b"):
            edges = relabelled(edges, step, end)
        edges = store(undirected(edges), "edges")
    return labels if labels is not None else links.select(F.col("a").alias("id"), F.col("b").alias("root"))
