"""Connected components of a graph as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genospark.llm.common import joined_by_key
from genospark.plans.tables import collected, removed, written


def _with(rows: DataFrame, on: str, step: DataFrame, name: str) -> DataFrame:
    """rows with the step (k, to) of the node in column `on`, as `name`, null where it has none. Nodes that are in many rows are
    joined apart from the rest, so that the edges of a hub or the members of a large component are no one task's."""
    counts = rows.groupBy(F.col(on).alias("k")).agg(F.count("*").alias("n"))
    groups = step.join(counts, "k").select(F.col("k").alias(on), F.col("to").alias(name), "n")
    return joined_by_key(rows, groups, [on], "n", "left")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of the edges (a, b); root: the least node of its component. Edges with a null end and
    edges from a node to itself count as none; no edges give no rows.

    Each round every node steps to its least neighbour, if that is less than itself, and that
    one's step as well; the edges are then drawn between the nodes stepped to, and those that have
    closed fall away, so that the graph shrinks by half or more each time. Least neighbours are
    partial aggregates: a node may have any number of edges. The tables of a round go with the next."""
    spark = edges.sparkSession
    a, b = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    old: list[str] = []
    with collected() as made:
        edges = written(edges.filter("a <> b").select(a, b).distinct(), "edges")
        labels = written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")), "labels")
        old.extend(made)
    for _ in range(most_rounds):
        if edges.isEmpty():
            return labels
        with collected() as made:
            step = written(edges.groupBy("b").agg(F.min("a").alias("a")).select(F.col("b").alias("k"), F.col("a").alias("to")), "steps")
            step = written(_with(step, "to", step, "to2").select("k", F.coalesce("to2", "to").alias("to")), "steps")
            moved = _with(edges, "b", step, "to").select("a", F.col("to").alias("b")).filter("a <> b").distinct()
            moved = written(moved, "moved")
            moved = _with(moved, "a", step, "to2").select(F.coalesce("to2", "a").alias("a"), "b").filter("a <> b")
            moved = written(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
            labels = written(_with(labels, "root", step, "to").select("node", F.coalesce("to", "root").alias("root")), "labels")
        edges = moved
        removed(spark, old)
        old.extend(made)
    raise RuntimeError("components did not settle")
