"""The capped path search against a plain search that makes every path."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import paths
from strandlake.sources.stored import stored


def _graph(kind, seed):
    rnd = random.Random(seed)
    n = 9
    if kind == "dense":
        pairs = [(a, b) for a in range(n) for b in range(n) if a != b and rnd.random() < 0.7]
    elif kind == "hub":  # every way leads through 0
        pairs = [(a, 0) for a in range(1, n)] + [(0, b) for b in range(1, n)] + [(1, 2), (2, 3), (8, 1)]
    else:
        pairs = [(a, b) for a in range(n) for b in range(n) if a != b and rnd.random() < 0.2]
    return [(f"n{a}", f"n{b}", f"e{a}-{b}", rnd.choice(["positive", "negative"])) for a, b in pairs]


def _all_paths(edges, source, longest):
    out, nexts = {}, {}
    for a, b, _, _ in edges:
        nexts.setdefault(a, []).append(b)
    front = [(source,)]
    for _ in range(longest):
        front = [(*p, b) for p in front for b in nexts.get(p[-1], []) if b not in p]
        for p in front:
            out.setdefault(p[-1], []).append(p)
    return {t: sorted(ps, key=lambda p: (len(p), p)) for t, ps in out.items()}


CASES = [("dense", 1, 3), ("hub", 2, 2), ("sparse", 3, 1), ("dense", 4, 25)]


@pytest.fixture(scope="module")
def graph(spark):
    def make(kind, seed):
        rows = _graph(kind, seed)
        return rows, spark.createDataFrame(rows, "source string, target string, edge_id string, sign string"), spark.createDataFrame([("n1",), ("n4",)], "node string")

    return make


@pytest.mark.parametrize(("kind", "seed", "cap"), CASES)
def test_best_paths_are_the_first_of_all(graph, kind, seed, cap):
    rows, edges, starts = graph(kind, seed)
    signs = {(a, b): 1 if s == "positive" else -1 for a, b, _, s in rows}
    for longest in (1, 4):
        got = paths.best_paths(edges, starts, longest, cap).collect()
        want = {(s, t, p) for s in ("n1", "n4") for t, ps in _all_paths(rows, s, longest).items() for p in ps[:cap]}
        assert {(r.source, r.target, tuple(r.nodes)) for r in got} == want and len(got) == len(want)
        for r in got:
            sign = 1
            for a, b in itertools.pairwise(r.nodes):
                sign *= signs[a, b]
            assert r.sign == sign and r.n_edges == len(r.nodes) - 1


def test_best_paths_to_targets_and_counts(graph, spark):
    rows, edges, starts = graph("dense", 7)
    goals = spark.createDataFrame([("n2",), ("n1",), ("n7",)], "node string")
    got = {(r.source, r.target, tuple(r.nodes)) for r in paths.best_paths(edges, starts, 3, 4, goals).collect()}
    assert got == {(s, t, p) for s in ("n1", "n4") for t, ps in _all_paths(rows, s, 3).items() if t in ("n2", "n1", "n7") for p in ps[:4]}
    counted = {(r.source, r.target): r.n_paths for r in paths.path_counts(edges, starts, 4, 10).collect()}
    assert counted == {(s, t): min(len(ps), 10) for s in ("n1", "n4") for t, ps in _all_paths(rows, s, 4).items()}


@pytest.mark.parametrize(("kind", "seed"), [("dense", 1), ("hub", 2), ("sparse", 3), ("sparse", 6)])
def test_frontier_beyond_cutoff(graph, kind, seed):
    rows, edges, starts = graph(kind, seed)
    for longest in (1, 2, 4):
        want = {(s, t) for s in ("n1", "n4") for t, ps in _all_paths(rows, s, longest + 1).items() if any(len(p) == longest + 2 for p in ps)}
        assert {tuple(r) for r in paths.beyond_pairs(edges, starts, longest).collect()} == want


def _expected_results(rows, starts, longest, cap, total):
    """The rules of the search, pair by pair."""
    nodes = {x for a, b, _, _ in rows for x in (a, b)}
    out, kept = [], 0
    for s in starts:
        reach = _all_paths(rows, s, len(nodes))
        for t in sorted(reach):
            if total is not None and kept >= total:
                return [*out, (s, t, "maximum_total_paths_reached", 0, 0, 0)]
            found = [p for p in reach[t] if len(p) <= longest + 1]
            status, generated, own, depth = "complete", 0, 0, 0
            if any(len(p) == longest + 2 for p in reach[t]):
                status = "maximum_path_length_reached"
            for p in found:
                generated, depth = generated + 1, max(depth, len(p) - 1)
                if own >= cap:
                    status = "maximum_paths_per_candidate_reached"
                    break
                if total is not None and kept >= total:
                    status = "maximum_total_paths_reached"
                    break
                own, kept = own + 1, kept + 1
            out.append((s, t, status, generated, own, depth))
    return out


@pytest.mark.parametrize("total", [None, 1, 6, 17, 24])
@pytest.mark.parametrize(("kind", "seed", "cap"), [("dense", 1, 3), ("sparse", 3, 2)])
def test_search_results(graph, kind, seed, cap, total):
    rows, edges, starts = graph(kind, seed)
    found, results = paths.search(edges, starts, 3, cap, total)
    got = sorted((r.source, r.target, r.status, r.generated, r.retained, r.max_depth) for r in results.collect())
    want = _expected_results(rows, ["n1", "n4"], 3, cap, total)
    assert got == sorted(want)
    assert found.count() == sum(w[4] for w in want)


def test_search_candidates_and_bad_sources(graph, spark):
    _, edges, _ = graph("hub", 2)
    starts = spark.createDataFrame([("n1",), ("x",)], "node string")
    wanted = spark.createDataFrame([("n3",), ("y",), ("n1",)], "node string")
    got = {(r.source, r.target): r.status for r in paths.search(edges, starts, 4, 25, None, wanted)[1].collect()}
    assert got == {("n1", "n3"): "complete", ("n1", "y"): "candidate_not_in_graph", ("n1", "n1"): "candidate_not_in_graph", ("x", None): "source_not_in_graph"}


def test_reachable_over_many_sources(spark):
    rnd = random.Random(5)
    pairs = {(rnd.randrange(300), rnd.randrange(300)) for _ in range(420)} | {(k, k + 1) for k in range(300, 340)}
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "source string, target string")
    nexts = {}
    for a, b in pairs:
        nexts.setdefault(a, set()).add(b)
    want = set()
    for s in range(0, 340, 2):
        seen, front = {s}, [s]
        while front:
            front = [b for a in front for b in nexts.get(a, ()) if b not in seen and not seen.add(b)]
        want |= {(f"n{s}", f"n{t}") for t in seen - {s}}
    starts = spark.createDataFrame([(f"n{s}",) for s in range(0, 340, 2)], "node string")
    got = paths.reachable(edges, starts, stored).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_empty_graph(spark):
    edges = spark.createDataFrame([], "source string, target string, edge_id string, sign string")
    starts = spark.createDataFrame([("a",)], "node string")
    assert paths.best_paths(edges, starts).collect() == [] and paths.beyond_pairs(edges, starts).collect() == []
    assert paths.reachable(edges.select("source", "target"), starts, stored).where(F.col("node") != "a").collect() == []


def test_frontier_makes_no_paths_as_long_as_the_cutoff(spark, monkeypatch):
    rnd = random.Random(11)
    # a ring of small cycles, so that many nodes lie on all paths to a node with an edge back to them
    pairs = {(k, (k + 1) % 100) for k in range(100)} | {((k + 1) % 100, k) for k in range(0, 100, 3)} | {((k + 2) % 100, k) for k in range(0, 100, 5)} | {((k + 3) % 100, k) for k in range(0, 100, 7)} | {(rnd.randrange(100), rnd.randrange(100)) for _ in range(30)}
    rows = [(f"n{a}", f"n{b}", f"e{a}-{b}", "positive") for a, b in sorted(pairs) if a != b]
    edges = spark.createDataFrame(rows, "source string, target string, edge_id string, sign string")
    starts = spark.createDataFrame([(f"n{k}",) for k in range(101)], "node string")  # more than a word's bits; n100 isn't in the graph
    made, onward = [], paths._onward
    monkeypatch.setattr(paths, "_onward", lambda step, e: made.append(1) or onward(step, e))
    got = paths.beyond_pairs(edges, starts, 4).collect()
    want = {(f"n{s}", t) for s in range(100) for t, ps in _all_paths(rows, f"n{s}", 5).items() if any(len(p) == 6 for p in ps)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert len(made) == 2  # paths of two and three edges


def test_candidates_are_dealt_out_to_many_tasks(spark):
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}", f"e{k}", "positive") for k in range(400)], "source string, target string, edge_id string, sign string")
    nodes = edges.selectExpr("explode(array(source, target)) as node").distinct()
    got = paths.search_targets(edges, nodes.where("node like '%7'"), nodes)
    rows = got.withColumn("task", F.spark_partition_id()).collect()
    starts = {f"n{k}" for k in range(401) if k % 10 == 7}
    assert {(r.source, r.target): r.status for r in rows} == {(s, f"n{k}"): "candidate_not_in_graph" if s == f"n{k}" else "resolved" for s in starts for k in range(401)} and len(rows) == len(starts) * 401
    assert len({r.task for r in rows}) > 1
