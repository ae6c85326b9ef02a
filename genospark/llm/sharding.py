"""Shards through fixed virtual slots, in DataFrame functions only.

A record's hash gives one of n_slots virtual slots for good. A versioned table maps slots to
shards: version 1 deals the slots out in turn, each later version holds only the slots that
an edit moved. Rebalancing sums bytes by slot, lets every shard keep its largest slots up to
an even share, and gives each slot that was let go, largest first, to the shard with the
fewest bytes; slots of shards beyond the new number of shards all move. Only that table of
n_slots rows is gathered in one place or broadcast.

A record that is repeated takes slots in turn from its own one on, so that its repeats are dealt out
like other rows and no slot gets more than its part of them. Rows stay grouped by record until the
end: nothing sorts or gathers the repeats of one.

Defined results: a null text counts 1 byte and has the checksum of an empty text; a null
doc_id hashes as an empty one; rows that agree in doc_id, size and checksum are one record,
repeated; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genospark.llm.common import hashed
from genospark.plans.tables import tidy, written

N_SLOTS = 4096


def records(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size and text_crc32 of each record, the vslot of some of its rows and how many (m)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    own = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    first = F.pmod(hashed(32, F.col("doc_id"), F.col("text_crc32")), F.lit(n_slots))
    turns = F.explode(F.sequence(F.lit(0).cast("bigint"), F.least("n", F.lit(n_slots)) - 1)).alias("k")
    dealt = own.withColumn("first", first).select("doc_id", "size", "text_crc32", "n", "first", turns)
    m = F.floor((F.col("n") - F.col("k") - 1) / n_slots).cast("bigint") + 1
    return dealt.select("doc_id", "size", "text_crc32", F.pmod(F.col("first") + F.col("k"), F.lit(n_slots)).cast("int").alias("vslot"), m.alias("m"))


def first_map(spark: SparkSession, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Version 1: (version, vslot, shard)."""
    return spark.range(n_slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("vslot"), F.pmod("id", F.lit(n_shards)).cast("int").alias("shard"))


def current(slot_map: DataFrame) -> DataFrame:
    """(vslot, shard) of the latest version."""
    return slot_map.groupBy("vslot").agg(F.max_by("shard", "version").alias("shard"))


def rebalanced(slot_map: DataFrame, slot_bytes: DataFrame, n_shards: int) -> DataFrame:
    """The map with one more version, which holds the slots that move. slot_bytes: (vslot, bytes)."""
    now = current(slot_map).join(slot_bytes, "vslot", "left").fillna(0, ["bytes"])
    w = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot")
    total = now.agg(F.sum("bytes").alias("total"))
    now = now.withColumn("cum", F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0))).join(F.broadcast(total))
    now = now.withColumn("stays", (F.col("shard") < n_shards) & (F.col("cum") * n_shards <= F.col("total")))
    one = now.agg(
        F.sort_array(F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("less"), "vslot", "shard")))).alias("moving"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("stays") & (F.col("shard") == k), F.col("bytes"))), F.lit(0)).cast("bigint") for k in range(n_shards)]).alias("loads"),
    )
    least = "array_position(a.loads, array_min(a.loads)) - 1"
    dealt = one.select(
        F.expr(f"""
        aggregate(moving,
            named_struct('loads', loads, 'moved', cast(array() as array<struct<vslot: int, old: int, shard: int>>)),
            (a, r) -> named_struct(
                'loads', transform(a.loads, (x, i) -> if(i = {least}, x - r.less, x)),
                'moved', concat(a.moved, array(named_struct('vslot', r.vslot, 'old', r.shard, 'shard', cast({least} as int))))),
            a -> a.moved)""").alias("moved")
    )
    latest = slot_map.agg(F.max("version").alias("v"))
    moves = dealt.select(F.inline("moved")).filter("old <> shard").join(F.broadcast(latest))
    return slot_map.unionByName(moves.select((F.col("v") + 1).alias("version"), "vslot", "shard"))


@tidy
def sharded(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS, slot_map: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents with their shard and place in it (slot: gapless from 0 in each shard), and the map after rebalancing,
    which may be given as slot_map next time, for more or fewer shards or other documents. It is a table of this
    application: write it elsewhere to keep it."""
    spark = docs.sparkSession
    rows = written(records(docs, n_slots), "records")
    by_slot = written(rows.groupBy("vslot").agg(F.sum(F.col("size") * F.col("m")).alias("bytes"), F.sum("m").alias("rows")), "slots")
    before = first_map(spark, n_shards, n_slots) if slot_map is None else slot_map
    slot_map = written(rebalanced(before, by_slot.select("vslot", "bytes"), n_shards), "slot_map")
    places = current(slot_map).join(by_slot, "vslot")
    upto = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, 0)
    places = written(places.select("vslot", "shard", (F.sum("rows").over(upto) - F.col("rows")).alias("start")), "places")
    within = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("past", F.sum("m").over(within) - F.col("m")).join(F.broadcast(places), "vslot")
    first = F.col("start") + F.col("past")
    slot = F.explode(F.sequence(first, first + F.col("m") - 1)).alias("slot")
    return placed.select("doc_id", "size", "text_crc32", "shard", slot, "vslot"), slot_map
