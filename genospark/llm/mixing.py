"""Mixing sources to target weights by weighted sampling keys, in DataFrame functions only.

Every document draws an exponential key, -ln(u) / quality, with u from a hash of the record.
A source whose target is k times its size and a rest gives every document k times (complete
epochs); for the rest its documents are taken in order of their keys while their words fit.
The order within a source is found by bins: a key falls in one of n_bins by its rank in
the unit exponential law, words are summed by source and bin, and only a bin is sorted at
once, so that a source may hold any share of the rows.

Defined results: a null or blank text has size 0 and is taken for 0 words; null sources are
one source, last in order; rows that agree in doc_id and text draw the same key, and where
only some of them fit, so many are taken; an empty table gives an empty table; a source of
size 0 has target 0; mixed() carries extra columns whatever their names, mixture() reads none.

One row for each source is ranked in one task: a million sources take it a second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genospark.llm.common import hashed, numbered, restored, words
from genospark.plans.tables import tidy, written

MAX_EPOCHS = 3


def quality_of(w: Column) -> Column:
    """Share of distinct words, from 0.05 to 1: repetitive texts come late."""
    return F.greatest(F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1)), F.lit(0.05))


def measured(docs: DataFrame, carry: tuple[str, ...], quality: Column | None = None) -> DataFrame:
    """The numbered columns of those to carry, with __s (a key of the source that is never null), __size, __key and
    __hash. quality: a positive column of docs instead of the share of distinct words."""
    base, at = numbered(docs if quality is None else docs.select("*", quality.cast("double").alias("__quality")))
    text, doc_id, source = (F.col(at[c]) for c in ("text", "doc_id", "source"))
    own = [at[c] for c in carry]
    base = base.select(*own, doc_id.alias("__d"), source.alias("__src"), words(text).alias("__w"), F.coalesce(text, F.lit("")).alias("__text"), *([] if quality is None else [F.col(at["__quality"]).alias("__q")]))
    u = (hashed(48, F.col("__d"), F.col("__text")) + 1) / F.lit(float(2**48 + 1))
    q = quality_of(F.col("__w")) if quality is None else F.greatest(F.coalesce("__q", F.lit(0.05)), F.lit(0.05))
    return base.select(
        *own,
        F.concat(F.when(F.col("__src").isNull(), "1").otherwise("0"), F.coalesce("__src", F.lit(""))).alias("__s"),
        F.size("__w").cast("bigint").alias("__size"),
        (-F.log(u) / q).alias("__key"),
        F.xxhash64("__text").alias("__hash"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MAX_EPOCHS) -> DataFrame:
    """(__s, source_size, target) from (__s, source_size). Sources in order of __s weigh as
    weights say, in turn. Those whose share would pass most times their size stop there: in order
    of most * size / weight they are the first ones, and the rest share what they leave."""
    order = Window.orderBy("__s")
    ranked = sizes.withColumn("__r", F.row_number().over(order))
    ranked = ranked.withColumn("__w", F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.col("__r") - 1, F.lit(len(weights))) + 1).cast("int")))
    level = F.col("source_size") * most / F.col("__w")
    by_level = Window.orderBy(level, "__s")
    upto = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    all_words, all_weight = F.sum("source_size").over(whole), F.sum("__w").over(whole)
    left = (all_words - most * F.coalesce(F.sum("source_size").over(upto), F.lit(0))) / (all_weight - F.coalesce(F.sum("__w").over(upto), F.lit(0)))
    #: If every source before stops at its cap, left is what a weight of 1 gets; the first source that is not above fixes it.
    stepped = ranked.withColumns({"__left": left, "__level": level})
    fits = stepped.withColumn("__share", F.min(F.when(F.col("__left") <= F.col("__level"), F.struct("__level", "__s", "__left"))).over(whole)["__left"])
    target = F.when(F.col("__share").isNull() | (F.col("__level") < F.col("__share")), (most * F.col("source_size")).cast("double")).otherwise(F.col("__share") * F.col("__w"))
    return fits.select("__s", "source_size", target.alias("target"))


def taken(rows: DataFrame, n_bins: int = 4096, weights: tuple[int, ...] = (1, 2, 3), most: int = MAX_EPOCHS) -> DataFrame:
    """rows (of measured(), written) with source_size, target and __times, how often each is taken."""
    rows = rows.withColumn("__bin", F.least(F.floor((1 - F.exp(-F.col("__key"))) * n_bins), F.lit(n_bins - 1)).cast("int"))
    bins = rows.groupBy("__s", "__bin").agg(F.sum("__size").alias("__words"))
    goals = targets(rows.groupBy("__s").agg(F.sum("__size").alias("source_size")), weights, most)
    earlier = Window.partitionBy("__s").orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    starts = bins.withColumn("__start", F.sum("__words").over(earlier) - F.col("__words")).join(goals, "__s")
    inside = Window.partitionBy("__s", "__bin").orderBy("__key", "__hash", "__size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("__upto", F.sum("__size").over(inside)).join(starts.drop("__words"), ["__s", "__bin"])
    epochs = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).cast("bigint")
    rest = F.col("target") - epochs * F.col("source_size")
    more = F.col("__start") + F.col("__upto") - F.col("__size") / 2 <= rest
    times = epochs + F.when((epochs < most) & more & (F.col("__size") > 0), 1).otherwise(0)
    return placed.withColumn("__times", times)


@tidy
def mixture(docs: DataFrame, quality: Column | None = None, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words) of each document."""
    rows = written(measured(docs, ("doc_id",), quality), "mix")
    out = taken(rows, **options)
    words_taken = F.col("__times") * F.col("__size")
    return restored(out, docs, {"size": F.col("__size"), "source_size": F.col("source_size"), "target": F.col("target"), "taken": words_taken}, ("doc_id",))


@tidy
def mixed(docs: DataFrame, quality: Column | None = None, **options) -> DataFrame:
    """The documents that the mix takes, all columns their own, each as often as it is taken."""
    rows = written(measured(docs, tuple(docs.columns), quality), "mix")
    out = taken(rows, **options).filter("__times > 0")
    return restored(out.withColumn("__t", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int")))), docs, {})
