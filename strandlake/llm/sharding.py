"""Contiguous shards of near equal bytes: global prefix sums from per-partition totals, cut at equal targets.

Only DataFrame functions run here. Texts are read once for their size and checksum; what is ordered and summed
are narrow rows. Documents are range-partitioned by doc_id, each partition sums its own rows, and one row per
partition (its totals) is summed over all partitions; no task ever holds more than its partition.

A document belongs to the shard in whose part of the total its middle byte lies. So a cut is at most half a
document away from its target, and a shard's bytes differ from the mean by at most one longest document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import fresh, numbered, written


def _assigned(rows: DataFrame, key: str, shards: int) -> DataFrame:
    """(key, doc_id, size, text_crc32, shard, slot) of rows with a unique key."""
    if shards < 1:
        raise ValueError("there must be a shard")
    text, parts = F.coalesce("text", F.lit("")), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = written(rows.select(F.col(key).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")))
    # written, as which partition a row is in depends on how the ranges were sampled
    dealt = written(narrow.repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    totals = totals.select("part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("bytes", "rows")], F.sum("bytes").over(Window.partitionBy()).alias("total"))
    own = Window.partitionBy("part").orderBy("key")
    inside = dealt.withColumn("bytes", F.sum("size").over(own) - F.col("size")).withColumn("row", F.row_number().over(own) - 1)
    placed = inside.join(totals, "part").withColumn("start", F.col("bytes_before") + F.col("bytes"))
    placed = placed.select("key", "doc_id", "size", "text_crc32", (F.col("rows_before") + F.col("row")).alias("row"), F.expr(f"int(((2 * start + size) * {shards}) div (2 * total))").alias("shard"))
    placed = written(placed)
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))  # at most as many rows as shards
    return placed.join(F.broadcast(first), "shard").select("key", "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))


def balanced_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row: shards in ascending doc_id order, slots from 0 without gaps.

    size: UTF-8 bytes of the text and one for its end. Null texts count as empty. Rows that share an id follow
    each other in the order of their texts, null ids come first; extra columns are ignored. One document longer
    than a shard's part leaves neighbouring shards empty. An empty table gives an empty result.
    """
    rows, key, _ = numbered(docs.select("doc_id", "text"))
    return _assigned(rows, key, shards).drop("key")


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """Writes all columns of docs as Parquet below path, a folder for each shard; within one, files and rows follow the slots.

    The folder's column is `shard` and the rows' place `slot`, with a trailing _ if docs has such a column.
    """
    rows, key, _ = numbered(docs)
    at = _assigned(rows, key, shards).select("key", "shard", "slot")
    shard, slot = fresh(docs, "shard"), fresh(docs, "slot")
    at = at.withColumnsRenamed({"key": key, "shard": shard, "slot": slot})
    parts = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.join(at, key).drop(key).repartitionByRange(parts, shard, slot).sortWithinPartitions(shard, slot)
    dealt.write.partitionBy(shard).parquet(path)


def op13(spark, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes; see `balanced_shards`."""
    out = balanced_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
