"""Snapshots with a manifest: what their files must be, and tables of those that are what they should.

A snapshot is a folder <root>/<provider>/<snapshot_id> with Parquet files in `normalized` and a manifest in JSON:
snapshot_id, provider, organism, schema_version, completeness_status, record_count, files (name, sha256). Files are
hashed where Spark reads them, one task a file, so a store that only Spark reaches will do; a file must be smaller
than 2 GB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stored import stored

SCHEMA_VERSION = "1"
MANIFEST = "snapshot_id string, provider string, organism string, schema_version string, completeness_status string, record_count long, files array<struct<name: string, sha256: string>>"


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(provider, snapshot_id, name, sha256) of the data files below a root, over their bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    at = F.split("path", "/")
    back = lambda i: F.element_at(at, -i)
    return files.where(back(2) == "normalized").select(back(4).alias("provider"), back(3).alias("snapshot_id"), back(1).alias("name"), F.sha2("content", 256).alias("sha256"))


def write_snapshot(df: DataFrame, root: str, provider: str, snapshot_id: str, organism: str = "human", completeness_status: str = "complete", schema_version: str = SCHEMA_VERSION) -> None:
    """A snapshot's table and then its manifest, so that one without a manifest was never finished."""
    spark, path = df.sparkSession, f"{root}/{provider}/{snapshot_id}"
    df.write.parquet(f"{path}/normalized")
    sums = file_checksums(spark, path).agg(F.array_sort(F.collect_list(F.struct("name", "sha256"))).alias("files"))
    count = spark.read.parquet(f"{path}/normalized").agg(F.count("*").alias("record_count"))
    says = sums.join(count).select(*[F.lit(v).alias(n) for n, v in (("snapshot_id", snapshot_id), ("provider", provider), ("organism", organism), ("schema_version", schema_version), ("completeness_status", completeness_status))], "record_count", "files")
    says.coalesce(1).write.json(f"{path}/manifest")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """One row per finished snapshot below the root."""
    return spark.read.schema(MANIFEST).json(f"{root}/*/*/manifest")


def issues(spark: SparkSession, root: str) -> DataFrame:
    """(check, provider, snapshot_id, detail): unsupported_schema, duplicate_snapshot_id, missing_file, surplus_file,
    checksum_mismatch, row_count, incomplete_snapshot, inconsistent_organisms (of the providers that aren't in the majority)."""
    says, key = stored(manifests(spark, root)), ["provider", "snapshot_id"]
    found = stored(file_checksums(spark, root))
    row = lambda df, check, detail: df.select(F.lit(check).alias("check"), *key, detail.cast("string").alias("detail"))
    named = says.select(*key, F.explode("files").alias("f")).select(*key, F.col("f.name").alias("name"), F.col("f.sha256").alias("said"))
    both = named.join(found, [*key, "name"], "full_outer").join(says.select(*key), key, "left_semi")
    file = F.when(F.col("sha256").isNull(), "missing_file").when(F.col("said").isNull(), "surplus_file").when(F.col("said") != F.col("sha256"), "checksum_mismatch")
    files = both.withColumn("check", file).where("check is not null").select("check", *key, F.col("name").alias("detail"))
    # counts come from the files' footers, of files that are whole
    whole = [r.asDict() for r in says.join(files.select(*key).distinct(), key, "left_anti").select(*key).collect()]  # one row for each snapshot
    counts = None
    for s in whole:
        n = spark.read.parquet(f"{root}/{s['provider']}/{s['snapshot_id']}/normalized").agg(F.count("*").alias("found")).select(*[F.lit(s[k]).alias(k) for k in key], "found")
        counts = n if counts is None else counts.unionAll(n)
    out = files
    if counts is not None:
        out = out.unionByName(row(says.join(counts, key).where("record_count <> found"), "row_count", F.col("found")))
    twice = says.groupBy("snapshot_id").agg(F.count("*").alias("n")).where("n > 1").select("snapshot_id")
    out = out.unionByName(row(says.join(twice, "snapshot_id"), "duplicate_snapshot_id", F.col("snapshot_id")))
    out = out.unionByName(row(says.where(f"not (schema_version <=> '{SCHEMA_VERSION}')"), "unsupported_schema", F.col("schema_version")))
    out = out.unionByName(row(says.where("completeness_status is null or startswith(completeness_status, 'incomplete')"), "incomplete_snapshot", F.col("completeness_status")))
    usual = says.groupBy("organism").count().agg(F.max_by("organism", F.struct("count", "organism")).alias("usual"))
    return out.unionByName(row(says.join(usual).where("not (organism <=> usual)"), "inconsistent_organisms", F.col("organism")))


def read_verified(spark: SparkSession, root: str) -> DataFrame:
    """The tables of all snapshots without an issue, with their provider and snapshot_id; ValueError if there is none."""
    key = ["provider", "snapshot_id"]
    good = manifests(spark, root).join(issues(spark, root).select(*key).distinct(), key, "left_anti").select(*key).collect()
    if not good:
        raise ValueError("no verified snapshot")
    out = None
    for provider, snapshot in sorted(map(tuple, good)):
        rows = spark.read.parquet(f"{root}/{provider}/{snapshot}/normalized").withColumns({"provider": F.lit(provider), "snapshot_id": F.lit(snapshot)})
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out
