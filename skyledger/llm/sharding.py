"""Sharding over fixed virtual slots, in DataFrame functions alone.

Records hash by doc_id into ``SLOTS`` virtual slots, for good. Bytes are summed per slot, and a
versioned table maps slots to shards: the first version fills shards largest slot first,
each into the least loaded shard; growing or rebalancing edits the table by moving few
slots and never rehashes a record. The table has SLOTS rows whatever the corpus, so
it is the one side that is broadcast.

A record's place in its shard is its rank in its virtual slot plus the records of the shard's
earlier slots: gapless from 0 without sorting a whole shard anywhere.

The law is that sizes are near equal: equal texts under different doc_ids are different records
and may lie in different shards.

Defined results: null and empty texts have size 16 and crc 0; a row without a doc_id goes by
its text, so such rows spread over the slots; rows of one doc_id share a slot; ties in a slot are
broken by doc_id, crc and size, and rows alike in all three, which are the same, take the places in
any order; a text of any length is one record; an empty table gives no rows. Only doc_id and text are
read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import store

SLOTS = 4096


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and the virtual slot of every row."""
    text = F.coalesce("text", F.lit(""))
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(F.xxhash64("doc_id"))
    return docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.pmod(key, F.lit(slots)).cast("int").alias("vslot"))


def slot_bytes(found: DataFrame) -> DataFrame:
    return found.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))


def _fill(pool: DataFrame, loads: DataFrame) -> DataFrame:
    """(vslot, shard) for a pool of (vslot, bytes): largest first, each to the least loaded of loads (shard, load).

    A fold over one row of at most SLOTS entries.
    """
    slot = F.struct((-F.col("bytes")).alias("less"), "vslot")
    load = F.struct("load", "shard")
    both = pool.select(slot.alias("slot"), F.lit(None).alias("load")).unionByName(loads.select(F.lit(None).alias("slot"), load.alias("load")))
    gathered = both.groupBy().agg(F.sort_array(F.collect_list("slot")).alias("slots"), F.sort_array(F.collect_list("load")).alias("loads"))

    def step(acc: Column, slot: Column) -> Column:
        def put(least: Column) -> Column:
            grown = F.transform(acc["loads"], lambda x: F.when(x["shard"] == least["shard"], F.struct((x["load"] - slot["less"]).alias("load"), x["shard"].alias("shard"))).otherwise(x))
            return F.struct(grown.alias("loads"), F.concat(acc["put"], F.array(F.struct(slot["vslot"].alias("vslot"), least["shard"].alias("shard")))).alias("put"))

        return F.transform(F.array(F.array_min(acc["loads"])), put)[0]

    start = F.struct(F.col("loads").alias("loads"), F.expr("cast(array() as array<struct<vslot:int,shard:int>>)").alias("put"))
    return gathered.select(F.inline(F.aggregate("slots", start, step)["put"]))


def _empty_loads(like: DataFrame, first: int, stop: int) -> DataFrame:
    return like.sparkSession.range(first, stop).select(F.col("id").cast("int").alias("shard"), F.lit(0).cast("long").alias("load"))


def first_map(sizes: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """(version, vslot, shard) for all slots with records."""
    return _fill(sizes.select("vslot", "bytes"), _empty_loads(sizes, 0, shards)).select(F.lit(version).alias("version"), "vslot", "shard")


def _surplus(placed: DataFrame, target: Column) -> Column:
    """Which slots a shard gives up: in order of size, smallest first, while what is left stays at target or more."""
    load = F.sum("bytes").over(W.partitionBy("shard"))
    gone = F.sum("bytes").over(W.partitionBy("shard").orderBy("bytes", "vslot"))
    return load - gone >= target


def grown_map(current: DataFrame, sizes: DataFrame, shards: int, more: int = 1) -> DataFrame:
    """The next version for ``more`` shards more: slots move only into the new shards."""
    placed = current.join(F.broadcast(sizes), "vslot").withColumn("target", F.sum("bytes").over(W.partitionBy()) / F.lit(shards + more))
    marked = placed.withColumn("moves", _surplus(placed, F.col("target")))
    moved = _fill(marked.filter("moves").select("vslot", "bytes"), _empty_loads(sizes, shards, shards + more)).withColumnRenamed("shard", "new_shard")
    return marked.join(F.broadcast(moved), "vslot", "left").select((F.col("version") + 1).alias("version"), "vslot", F.coalesce("new_shard", "shard").alias("shard"))


def rebalanced_map(current: DataFrame, sizes: DataFrame, shards: int, tolerance: float = 0.02) -> DataFrame:
    """The next version after slots have grown: shards over (1 + tolerance) of the mean give slots to the least loaded."""
    placed = current.join(F.broadcast(sizes), "vslot").withColumn("mean", F.sum("bytes").over(W.partitionBy()) / F.lit(shards))
    over = F.sum("bytes").over(W.partitionBy("shard")) > F.col("mean") * F.lit(1 + tolerance)
    marked = placed.withColumn("over", over).withColumn("moves", F.col("over") & _surplus(placed, F.col("mean")))
    left = marked.filter(~F.col("moves")).groupBy("shard").agg(F.sum("bytes").alias("load"))
    every = sizes.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(F.broadcast(left), "shard", "left")
    loads = every.select("shard", F.coalesce("load", F.lit(0)).cast("long").alias("load"))
    moved = _fill(marked.filter("moves").select("vslot", "bytes"), loads).withColumnRenamed("shard", "new_shard")
    return marked.join(F.broadcast(moved), "vslot", "left").select((F.col("version") + 1).alias("version"), "vslot", F.coalesce("new_shard", "shard").alias("shard"))


def placed_records(found: DataFrame, sizes: DataFrame, slot_map: DataFrame) -> DataFrame:
    """found with its shard and its slot: the place in the shard, gapless from 0."""
    before = W.partitionBy("shard").orderBy("vslot").rowsBetween(W.unboundedPreceding, -1)
    table = slot_map.join(F.broadcast(sizes.select("vslot", "n")), "vslot").select("vslot", "shard", "version", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(W.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return found.withColumn("rank", rank).join(F.broadcast(table), "vslot").withColumn("slot", F.col("base") + F.col("rank") - 1).drop("rank", "base")


def sharded(docs: DataFrame, shards: int = 40, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard, version and slot of every row, by a first map."""
    found, _ = store(records(docs, slots), "records")
    sizes, _ = store(slot_bytes(found), "slot_bytes")
    slot_map, _ = store(first_map(sizes, shards), "slot_map")
    return placed_records(found, sizes, slot_map)
