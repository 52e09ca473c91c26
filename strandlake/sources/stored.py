"""Tables in the folder that the cluster shares: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder's path under spark.checkpoint.dir; only a local master may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = getattr(spark, "_strandlake_shared", None) or "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark._strandlake_shared = base
    return f"{base.rstrip('/')}/strandlake-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: what follows reads it, however often, and never computes it again."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
