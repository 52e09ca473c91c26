"""Paths are made in their source's task: they are neither stored nor shuffled."""

import re

import pytest

from strandlake.operators import paths
from strandlake.plans import queries as Q
from strandlake.plans import queries_more as M

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["path_conflicts", "ranked_paths", "gene_traces", "path_support", "path_audit", "path_search_results", "beyond_cutoff"])
def test_paths_stay_with_their_source(spark, name, monkeypatch):
    kept, keep = [], paths.stored
    for module in (paths, Q, M):
        monkeypatch.setattr(module, "stored", lambda df: kept.append(df.columns) or keep(df))
    plan = Q.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert kept and not [c for c in kept if "nodes" in c or "n_edges" in c]
    assert [k for k in re.findall(r"Exchange hashpartitioning\(([^\n]*?), \d+\)", plan) if "source#" in k and ("target#" in k or "pair#" in k)] == []


@pytest.mark.parametrize("name", ["path_records", "path_context_conflicts"])
def test_records_store_no_paths(spark, name, monkeypatch):
    kept, keep = [], paths.stored
    for module in (paths, M):
        monkeypatch.setattr(module, "stored", lambda df: kept.append(df.columns) or keep(df))
    Q.QUERIES[name](spark, DIR)
    assert kept and not [c for c in kept if "nodes" in c]


def test_marks_tell_what_dangling_tells(spark):
    found = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("a", "y", 1), ("b", "x", 1)], "source string, target string, n_edges int")
    results = spark.createDataFrame([("a", "x", 2), ("a", "z", 1), ("b", "q", 0)], "source string, target string, kept long")
    want = sorted(map(tuple, paths.dangling(found, results).collect()))
    marks = found.selectExpr("source", "target", "true as path", "0L as kept").unionByName(results.selectExpr("source", "target", "false as path", "kept"))
    assert sorted(map(tuple, paths.dangling_marks(marks).collect())) == want and len(want) == 3


def test_many_nodes_are_joined_by_shuffle_with_the_same_paths(spark, monkeypatch):
    pairs = [(a, b) for a in range(12) for b in range(12) if a != b and (a * 7 + b * 3) % 5 < 2]
    edges = spark.createDataFrame([(f"n{a}", f"n{b}", f"e{a}-{b}", "positive" if (a + b) % 3 else "negative") for a, b in pairs], "source string, target string, edge_id string, sign string")
    starts = spark.createDataFrame([("n1",), ("n10",), ("n4",)], "node string")

    def found():
        best = sorted((r.source, r.target, tuple(r.nodes), r.sign, r["rank"]) for r in paths.best_paths(edges, starts, 4, 3).collect())
        return best, sorted(map(tuple, paths.beyond_pairs(edges, starts, 3).collect()))

    whole = found()
    monkeypatch.setattr(paths, "EDGES", 0)
    monkeypatch.setattr(paths, "NAMES", 0)
    assert found() == whole and whole[0] and whole[1]
