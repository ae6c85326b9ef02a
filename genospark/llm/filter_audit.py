"""What each filter of a set removes in every order of them.

Orders form a trie, and a node's survivors depend on the filters above it, not on their order: a state. The trie is
walked depth first; a state is reached once, by filtering its parent's survivors, which stay persisted while its subtree is
walked, and what every further filter removes from it is counted by one pass. Orders are then read off
the counts of states. Survivors are rows of a few numbers, as texts are read once, into a table of failures.

Defined results: a null text counts as empty; a null source is the part of the empty string; a null doc_id is no
copy of a row and has no labels, and rows count as copies of the least doc_id with their text; repeated rows are rows
of their own (not copies of each other, as their doc_id is the same); an empty table gives an empty table; a document with
several labels is good or toxic if one of them says so; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genospark.llm.common import joined_by_key, words
from genospark.plans.tables import tidy, written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, A, B, C, D, E): for each document of docs (doc_id, text, source) whether it fails a filter. A: under 200
    words; B: under half of the words distinct; C: over 2 % of A-Z; D: one of #$%&*|; E: a smaller doc_id has the same text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"), words(text).alias("w"))
    n, others = F.size("w"), F.length(F.translate("text", UPPER, ""))
    measured = rows.select(
        "doc_id",
        "part",
        F.sha2("text", 256).alias("digest"),
        (n < 200).alias("A"),
        (100 * F.size(F.array_distinct("w")) < 50 * n).alias("B"),
        (100 * (F.length("text") - others) > 2 * F.length("text")).alias("C"),
        F.col("text").rlike(r"[#$%&*|]").alias("D"),
    )
    rows = written(measured, "measured")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    rows = joined_by_key(rows, first, ["digest"], "n", "left").withColumn("E", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("digest", "first")
    says = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    says = says.join(rows.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id")
    rows = joined_by_key(rows, says, ["doc_id"], "n", "left")
    return rows.select("part", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")), *"ABCDE")


def _removal(survivors: DataFrame, state: int, filters: Sequence[str]) -> DataFrame:
    """(part, state, filter, left, removed, good_lost, toxic_lost): what each filter not in the state removes from its survivors."""
    rest = [f for k, f in enumerate(filters) if not state >> k & 1]
    total = lambda c: F.sum(c.cast("bigint"))
    sums = [total(F.col(f) & also).alias(f"{f}{k}") for f in rest for k, also in enumerate((F.lit(True), F.col("good"), F.col("toxic")))]
    per = survivors.groupBy("part").agg(F.count("*").alias("left"), *sums)
    edges = [F.struct(F.lit(f).alias("filter"), *(F.col(f"{f}{k}").alias(c) for k, c in enumerate(("removed", "good_lost", "toxic_lost")))) for f in rest]
    return per.select("part", F.lit(state).alias("state"), "left", F.inline(F.array(*edges)))


def removals(rows: DataFrame, filters: Sequence[str]) -> DataFrame:
    """The counts of every edge that leaves a state: one table for each of the 2^n states but the last, read as one."""
    counted: dict[int, DataFrame] = {}

    def walk(survivors: DataFrame, state: int) -> None:
        counted[state] = written(_removal(survivors, state, filters), "removals")
        for k, f in enumerate(filters):
            below = state | 1 << k
            if below != state and below not in counted and below != (1 << len(filters)) - 1:
                kept = survivors.filter(~F.col(f)).persist()
                walk(kept, below)
                kept.unpersist()

    kept = rows.persist()
    walk(kept, 0)
    kept.unpersist()
    out = None
    for df in counted.values():
        out = df if out is None else out.unionByName(df)
    return written(out, "edges")


@tidy
def audited(rows: DataFrame, filters: Sequence[str] = "ABCDE") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from rows of (part, good, toxic
    and a boolean column of each filter's failures), for every part, order and step; zeros are counts like others."""
    spark, n = rows.sparkSession, len(filters)
    rows = written(rows, "failures")
    edges = removals(rows, filters)
    everyone = (1 << n) - 1
    fails = edges.filter("state = 0").select("part", "filter", F.col("left").alias("all"), F.col("removed").alias("fails"))
    alone = [everyone & ~(1 << k) for k in range(n)]  # the states in which all filters but one were applied
    weight: Column = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), F.bit_count("state") + 1)
    sums = edges.groupBy("part", "filter").agg(F.sum(F.col("removed") * weight).alias("shapley"), F.sum(F.when(F.col("state").isin(alone), F.col("removed"))).alias("unique_fails"))
    base = fails.join(sums, ["part", "filter"])
    steps = []
    for order in permutations(range(n)):
        state = 0
        for step, k in enumerate(order):
            steps.append(("".join(filters[i] for i in order), step + 1, filters[k], state))
            state |= 1 << k
    trie = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, filter string, state int"))  # n! n rows
    states = trie.select("filter", "state").distinct()
    full = base.join(F.broadcast(states), "filter").join(edges, ["part", "filter", "state"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    full = full.select("part", "filter", "state", "fails", "shapley", *map(zero, ("unique_fails", "left", "removed", "good_lost", "toxic_lost")))
    out = full.join(trie, ["filter", "state"])
    kept, redundant = (F.col("left") - F.col("removed")).alias("kept"), (F.col("fails") - F.col("removed")).alias("redundant")
    return out.select("part", "filter_order", "step", kept, "removed", redundant, "unique_fails", "good_lost", "toxic_lost", F.col("shapley").cast("bigint").alias("shapley"))
