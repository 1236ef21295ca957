"""Shards by fixed virtual slots: records hash to slots, and a small versioned map says which shard holds a slot. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle

#: Virtual slots. Fixed for the life of a data set; the map has this many rows at any size.
SLOTS = 4096


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a record from its key alone: 52 bits of an md5 digest of the key as text; null is a text of its own."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") % slots).cast("int")


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1 of a map (version, virtual_slot, shard): slots dealt to shards in turn."""
    if not 1 <= shards <= slots:
        raise ValueError(f"need 1 to {slots} shards")
    return spark.range(slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard"))


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, bytes) for every slot, from records with virtual_slot and size; a slot without records has 0."""
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    sums = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"))
    return every.join(sums, "virtual_slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0).cast("bigint")))


def rebalance(slot_map: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version of a map: slots move from shards above the mean to shards below it, the others stay.

    A shard keeps its largest slots while they fit the mean; what is over, its small slots, fills the gaps of the other shards in order of
    shard: prefix sums of gaps and of moving bytes are laid side by side, and a slot goes where its middle falls. Shards then differ from
    the mean by about one small slot. ``shards`` may be more than the map has: new shards start empty. The map has a fixed number of rows, so
    windows over all of it are small. Where there are no bytes at all, nothing moves.
    """
    rows = slot_map.join(loads, "virtual_slot")
    mean = F.sum("bytes").over(W.partitionBy()) / F.lit(shards)
    rows = rows.withColumn("mean", mean)
    held = F.sum("bytes").over(W.partitionBy("shard").orderBy(F.col("bytes").desc(), "virtual_slot").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("stays", (held - F.col("bytes") / 2 <= F.col("mean")) | (F.col("bytes") == 0))
    every = rows.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    kept = rows.groupBy("shard").agg(F.sum(F.when(F.col("stays"), F.col("bytes"))).alias("kept"), F.max("mean").alias("mean"))
    gaps = every.join(kept, "shard", "left").withColumn("mean", F.max("mean").over(W.partitionBy()))
    gaps = gaps.withColumn("gap", F.greatest(F.lit(0.0), F.col("mean") - F.coalesce("kept", F.lit(0)))).where("gap > 0")
    gaps = gaps.withColumn("at", F.sum("gap").over(W.orderBy("shard")) - F.col("gap")).withColumn("total", F.sum("gap").over(W.partitionBy()))
    moving = rows.where(~F.col("stays")).withColumn("moved", F.sum("bytes").over(W.partitionBy()))
    middle = F.sum("bytes").over(W.orderBy(F.col("bytes").desc(), "virtual_slot").rowsBetween(W.unboundedPreceding, 0)) - F.col("bytes") / 2
    # Bytes that stay are cut at middles of slots, so what moves and what is missing differ a little: middles are scaled to the gaps.
    moving = moving.withColumn("share", middle / F.col("moved"))
    line = moving.select("virtual_slot", F.lit(None).cast("int").alias("new_shard"), F.col("share")).unionByName(
        gaps.select(F.lit(None).cast("int").alias("virtual_slot"), F.col("shard").alias("new_shard"), (F.col("at") / F.col("total")).alias("share"))
    )
    gap = F.last("new_shard", ignorenulls=True).over(W.orderBy("share", F.col("new_shard").asc_nulls_last()))
    dealt = line.withColumn("new_shard", gap).where(F.col("virtual_slot").isNotNull())
    return rows.join(dealt.select("virtual_slot", "new_shard"), "virtual_slot", "left").select(
        (F.col("version") + 1).cast("int").alias("version"), "virtual_slot", F.coalesce("new_shard", "shard").cast("int").alias("shard")
    )


def save_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the stored map; earlier versions stay, so that old shards can be read and an edit undone."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the latest if none is named."""
    rows = spark.read.parquet(path).select(F.col("version").cast("int"), "virtual_slot", "shard")
    wanted = version if version is not None else rows.agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == wanted)


def shard_documents(docs: DataFrame, shards: int = 24, slots: int = SLOTS, slot_map: DataFrame | None = None, edits: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version) for every row of ``docs``.

    Law ``bytes``: shards hold nearly equal sizes; a size is the UTF-8 bytes of the text plus 8. The map (version 1 unless one is given) is
    edited ``edits`` times from the bytes per slot. ``slot`` is the row's place in its shard, from 0 without gaps: places count
    the rows of the shard's earlier virtual slots, then the row's own place in its virtual slot, so that no window spans a shard.

    Null text: size 8, no checksum. Null key: hashed like any text. Repeated rows get places of their own. An empty table gives an empty
    result. Other columns are not looked at. The text is read once; narrow rows go to the scratch folder. Only the map, of ``slots``
    rows at any size of data, is broadcast.
    """
    spark = docs.sparkSession
    body = F.col(f"`{text}`")
    size = (F.coalesce(F.octet_length(body), F.lit(0)).cast("bigint") + 8).alias("size")
    records = docs.select(F.col(f"`{key}`").alias("key"), size, F.crc32(body.cast("binary")).alias("text_crc32"), virtual_slot(F.col(f"`{key}`"), slots).alias("virtual_slot"))
    records = settle(records, "shard")
    counted = records.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    counted = settle(counted, "shard-slots")
    edited = first_map(spark, shards, slots) if slot_map is None else slot_map
    loads = slot_bytes(counted, slots)
    for _ in range(edits):
        edited = settle(rebalance(edited, loads, shards), "shard-map")
    before = F.coalesce(F.sum("rows").over(W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    places = edited.join(counted.select("virtual_slot", "rows"), "virtual_slot").withColumn("before", before).select("version", "virtual_slot", "shard", "before")
    own = F.row_number().over(W.partitionBy("virtual_slot").orderBy("key", "text_crc32", "size")) - 1
    return (
        records.withColumn("own", own)
        .join(F.broadcast(places), "virtual_slot")
        .select(
            F.col("key").alias(key),
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("before") + F.col("own")).cast("bigint").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "virtual_slot",
            F.col("version").alias("map_version"),
        )
    )
