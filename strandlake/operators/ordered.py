"""Running sums, ranks and minima over one global order, without a task that holds a whole group.

Rows are range-partitioned by the order; partitions work for themselves, and one row of each partition (or of
each partition and group) tells the others what comes before or after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.sources.stored import stored

BEFORE = (Window.unboundedPreceding, -1)


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """df, stored, with `_part`: numbers of ranges of the order. The order should tell rows apart, or equal rows crowd one range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))


def running_total(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Adds `out`, the sum of value over all earlier rows, and `last`, the value of the row before (0 for the first)."""
    rows, here = ranged(df, *order), Window.partitionBy("_part").orderBy(*order)
    sums = rows.groupBy("_part").agg(F.sum(value).alias("_sum"), F.max_by(value, F.struct(*order)).alias("_end"))
    earlier = Window.orderBy("_part").rowsBetween(*BEFORE)
    sums = sums.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"), F.last("_end").over(earlier).alias("_end"))
    rows = rows.withColumn(out, F.coalesce(F.sum(value).over(here.rowsBetween(*BEFORE)), F.lit(0))).withColumn("last", F.lag(value).over(here))
    rows = rows.join(sums, "_part").withColumn(out, F.col(out) + F.col("_before")).withColumn("last", F.coalesce("last", "_end", F.lit(0)))
    return rows.drop("_part", "_before", "_end")


def ranked_in(df: DataFrame, family: list[str], order: list[str]) -> DataFrame:
    """Adds `_part`, `rank` (from 1 in each family, by order) and `size` (of the family)."""
    rows = ranged(df, *family, *order)
    own = rows.groupBy("_part", *family).agg(F.count("*").alias("_n"))
    every = Window.partitionBy(*family)
    own = own.select("_part", *family, F.coalesce(F.sum("_n").over(every.orderBy("_part").rowsBetween(*BEFORE)), F.lit(0)).alias("_before"), F.sum("_n").over(every).alias("size"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("_part", *family).orderBy(*order)))
    on = F.lit(True)
    rows, own = rows.alias("r"), own.alias("o")
    for c in ("_part", *family):
        on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}"))
    return rows.join(own, on).select("r.*", "o._before", "o.size").withColumn("rank", F.col("rank") + F.col("_before")).drop("_before")


def minimum_from(rows: DataFrame, family: list[str], value: Column, out: str) -> DataFrame:
    """Adds `out`: the smallest value from a row on to the end of its family. rows: of ranked_in, stored."""
    rows = rows.withColumn("_v", value)
    own = rows.groupBy("_part", *family).agg(F.min("_v").alias("_least"))
    later = Window.partitionBy(*family).orderBy(F.desc("_part")).rowsBetween(*BEFORE)
    own = own.withColumn("_later", F.min("_least").over(later)).drop("_least")
    here = Window.partitionBy("_part", *family).orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    rows, own = rows.withColumn(out, F.min("_v").over(here)).alias("r"), own.alias("o")
    on = F.lit(True)
    for c in ("_part", *family):
        on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}"))
    # least() passes over nulls: the last range of a family has nothing later
    return rows.join(own, on).select("r.*", "o._later").withColumn(out, F.least(out, "_later")).drop("_v", "_later")
