"""Snapshots with planted faults: each is named, and only whole ones are read."""

import glob
import os

import pytest

from strandlake.sources import snapshots


@pytest.fixture
def root(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.range(60).selectExpr("id", "cast(id % 7 as string) as gene").repartition(3)
    for provider, snapshot, more in (
        ("signor", "s1", {}), ("omnipath", "o1", {}), ("reactome", "r1", {"completeness_status": "incomplete_download"}), ("trrust", "t1", {"schema_version": "0"}),
        ("mouse", "m1", {"organism": "mouse"}), ("copy", "s1", {}), ("short", "x1", {}), ("more", "y1", {}),
    ):
        snapshots.write_snapshot(rows, path, provider, snapshot, **more)
    return path


def test_each_fault_is_named(spark, root):
    parts = sorted(glob.glob(f"{root}/omnipath/o1/normalized/part-*"))
    data = bytearray(open(parts[0], "rb").read())
    data[len(data) // 2] ^= 1  # one bit
    open(parts[0], "wb").write(data)
    os.remove(f"{os.path.dirname(parts[0])}/.{os.path.basename(parts[0])}.crc")  # else the local file system itself refuses the file
    os.remove(sorted(glob.glob(f"{root}/short/x1/normalized/part-*"))[1])
    spark.range(5).selectExpr("id", "'x' as gene").coalesce(1).write.mode("append").parquet(f"{root}/more/y1/normalized")
    got = {(r.check, r.provider, r.snapshot_id) for r in snapshots.issues(spark, root).collect()}
    assert got == {
        ("checksum_mismatch", "omnipath", "o1"), ("missing_file", "short", "x1"), ("surplus_file", "more", "y1"), ("incomplete_snapshot", "reactome", "r1"), ("unsupported_schema", "trrust", "t1"),
        ("inconsistent_organisms", "mouse", "m1"), ("duplicate_snapshot_id", "signor", "s1"), ("duplicate_snapshot_id", "copy", "s1"),
    }
    with pytest.raises(ValueError):
        snapshots.read_verified(spark, root)


def test_whole_snapshots_are_read(spark, tmp_path):
    path = str(tmp_path)
    for provider, n in (("a", 5), ("b", 7)):
        snapshots.write_snapshot(spark.range(n).selectExpr("id"), path, provider, f"{provider}1")
    assert snapshots.issues(spark, path).count() == 0
    assert {tuple(r) for r in snapshots.read_verified(spark, path).groupBy("provider", "snapshot_id").count().collect()} == {("a", "a1", 5), ("b", "b1", 7)}
