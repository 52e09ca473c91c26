"""Shards by global prefix sums against plain loops."""

import random
import zlib

import pytest

from strandlake.llm import sharding


def _expected(rows, shards):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    sizes = [len((t or "").encode()) + 1 for _, t in rows]
    out, start, slots = [], 0, [0] * shards
    for (i, t), size in zip(rows, sizes, strict=True):
        k = (2 * start + size) * shards // (2 * sum(sizes))
        out.append((i, size, zlib.crc32((t or "").encode()), k, slots[k]))
        slots[k] += 1
        start += size
    return out


CASES = {
    "plain": [(3 * i, "ä" * random.Random(i).randint(0, 40)) for i in range(400)],
    "odd": [(None, "x"), (None, None), (None, "x"), (5, "same"), (5, "same"), (5, ""), (-7, "minus"), (2**62, "far")],
    "one long": [(i, "b" * (90_000 if i == 7 else 3)) for i in range(40)],
    "copies": [(i, "copy") for i in range(300)],
    "one": [(1, None)],
    "none": [],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("shards", [1, 8])
def test_shards_against_loops(spark, case, shards):
    rows = CASES[case]
    docs = spark.createDataFrame([(i, t, "a", 1, 2) for i, t in rows], "doc_id long, text string, shard string, size int, key int").repartition(5)
    got = sharding.balanced_shards(docs, shards)
    assert got.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(_expected(rows, shards), key=str)


def test_written_shards_hold_all_rows_in_order(spark, tmp_path):
    rows = CASES["plain"]
    docs = spark.createDataFrame([(i, t, "own", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, shard string, n int").repartition(5)
    sharding.write_shards(docs, f"{tmp_path}/out", 4)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(r.doc_id, r.text, r.shard, r.n) for r in got} == {(i, t, "own", k) for k, (i, t) in enumerate(rows)}
    expected = {i: (k, s) for i, _, _, k, s in _expected(rows, 4)}
    assert all((r.shard_, r.slot) == expected[r.doc_id] for r in got)


def test_plan_is_native(spark):
    docs = spark.createDataFrame(CASES["plain"], "doc_id long, text string")
    plan = sharding.balanced_shards(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_no_shards(spark):
    with pytest.raises(ValueError):
        sharding.balanced_shards(spark.createDataFrame([], "doc_id long, text string"), 0)
