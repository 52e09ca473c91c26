"""Bounded path search over consensus edges, reachability, path confidence and conflicts.

edges: (source, target, edge_id, sign). Simple paths grow by one equi-join a step.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.sources.stored import stored

from .ordered import running_total


def simple_edges(edges: DataFrame) -> DataFrame:
    """One edge per (source, target), the smallest edge id; no loops."""
    return edges.where("source <> target").groupBy("source", "target").agg(F.min("edge_id").alias("edge_id"), F.min_by("sign", "edge_id").alias("sign"))


def sources(edges: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """(node, status): requested nodes with out-edges, or why not; without a request the roots, else all with out-edges."""
    out = edges.select(F.col("source").alias("node")).distinct()
    into = edges.select(F.col("target").alias("node")).distinct()
    if requested is not None:
        known = out.unionByName(into).distinct().withColumn("known", F.lit(True))
        rows = requested.select("node").distinct().join(out.withColumn("leads", F.lit(True)), "node", "left").join(known, "node", "left")
        return rows.select("node", F.when(F.col("leads"), "searched").when(F.col("known"), "source_without_out_edges").otherwise("source_not_in_graph").alias("status"))
    roots = out.join(into, "node", "left_anti")
    return (roots if roots.limit(1).count() else out).withColumn("status", F.lit("searched"))


def search_targets(edges: DataFrame, starts: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """(source, target, status, scope) of a search.

    With candidates (node), each source is paired with each: resolved, or candidate_not_in_graph, also where a
    source is its own candidate. Without, every node that a source can reach is a target; sources and nodes
    are never multiplied, as nodes out of reach give no path.
    """
    if candidates is None:
        found = reachable(edges, starts, stored)
        return found.where("source <> node").select("source", F.col("node").alias("target"), F.lit("resolved").alias("status"), F.lit("all_reachable_entities").alias("scope"))
    nodes = edges.select(F.explode(F.array("source", "target")).alias("target")).distinct().withColumn("known", F.lit(True))
    asked = candidates.select(F.col("node").alias("target")).distinct().join(nodes, "target", "left")
    # the request itself is sources times candidates: however few bytes those are, each task gets a part of them
    asked = asked.repartition(2 * int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "target")
    pairs = starts.select(F.col("node").alias("source")).distinct().join(asked)
    ok = F.col("known").isNotNull() & (F.col("source") != F.col("target"))
    return pairs.select("source", "target", F.when(ok, "resolved").otherwise("candidate_not_in_graph").alias("status"), F.lit("explicit_candidate_scope").alias("scope"))


def enumerate_paths(edges: DataFrame, starts: DataFrame, max_length: int = 4, targets: DataFrame | None = None) -> DataFrame:
    """All simple paths of 1 to max_length edges from the nodes of starts (node): source, target, nodes, edge_ids, signs, n_edges.

    targets (node): only paths that end in one. A path then grows only into nodes from which a target is near
    enough, so what can't be finished is never made. Steps are stored: the union reads them, and doesn't walk again.
    """
    e = simple_edges(edges).select(F.col("source").alias("tail"), F.col("target").alias("head"), "edge_id", "sign")
    near = None
    if targets is not None:
        e = stored(e)
        near = [targets.select(F.col("node").alias("head")).distinct()]  # near[k]: nodes with a target at most k edges away
        for _ in range(max_length - 1):
            back = e.join(near[-1], "head", "left_semi").select(F.col("tail").alias("head"))
            near.append(near[-1].unionByName(back).distinct())
    grow = lambda left: e if near is None else e.join(near[left], "head", "left_semi")
    step = grow(max_length - 1).join(starts.select(F.col("node").alias("tail")).distinct(), "tail").select(F.col("tail").alias("source"), F.col("head").alias("target"), F.array("tail", "head").alias("nodes"), F.array("edge_id").alias("edge_ids"), F.array("sign").alias("signs"))
    out = step = stored(step)
    for n in range(1, max_length):
        step = step.join(grow(max_length - 1 - n), F.col("target") == F.col("tail")).where(~F.array_contains("nodes", F.col("head")))
        step = stored(step.select("source", F.col("head").alias("target"), F.array_append("nodes", F.col("head")).alias("nodes"), F.array_append("edge_ids", F.col("edge_id")).alias("edge_ids"), F.array_append("signs", F.col("sign")).alias("signs")))
        out = out.unionByName(step)
    out = out.withColumn("n_edges", F.size("edge_ids"))
    return out if near is None else out.join(targets.select(F.col("node").alias("target")).distinct(), "target", "left_semi").select(*out.columns)


def ranked(paths: DataFrame, per_target: int = 25) -> DataFrame:
    """The first per_target paths of each (source, target), by length, then nodes: the search's own limit."""
    w = Window.partitionBy("source", "target").orderBy("n_edges", "nodes")
    return paths.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_target)


def search_results(paths: DataFrame, per_target: int = 25) -> DataFrame:
    """Per (source, target): how many paths there are, how many are kept, whether some were cut."""
    return paths.groupBy("source", "target").agg(F.count("*").alias("generated"), F.min("n_edges").alias("shortest")).withColumn("kept", F.least("generated", F.lit(per_target))).withColumn("truncated", F.col("generated") > per_target)


def signed(paths: DataFrame) -> DataFrame:
    """Adds is_signed, cumulative sign and the direction expected when the source decreases."""
    ok = F.forall("signs", lambda s: s.isin("positive", "negative"))
    sign = F.when(ok, F.aggregate("signs", F.lit(1), lambda a, s: a * F.when(s == "negative", -1).otherwise(1)))
    out = paths.withColumn("is_signed", ok).withColumn("cumulative_sign", sign)
    return out.withColumn("expected_direction", F.when(F.col("cumulative_sign") == 1, "down").when(F.col("cumulative_sign") == -1, "up"))


def directed(paths: DataFrame) -> DataFrame:
    """As signed, for paths of best_paths, which carry the product of their signs."""
    out = paths.withColumn("is_signed", F.col("sign") != 0).withColumn("cumulative_sign", F.when(F.col("sign") != 0, F.col("sign")))
    return out.withColumn("expected_direction", F.when(F.col("sign") == 1, "down").when(F.col("sign") == -1, "up"))


def consistency(paths: DataFrame, observed: DataFrame) -> DataFrame:
    """Adds direction_consistent against observed (gene, direction); null if either is unknown."""
    out = paths.join(observed.select(F.col("gene").alias("target"), "direction"), "target", "left")
    return out.withColumn("direction_consistent", F.when(F.col("expected_direction").isNull() | ~F.col("direction").isin("up", "down"), F.lit(None).cast("boolean")).otherwise(F.col("expected_direction") == F.col("direction")))


def reachable(edges: DataFrame, starts: DataFrame, written) -> DataFrame:
    """(source, node): everything reachable over any number of edges, the source itself left out. written: stores a step."""
    seen, named = _reach(edges, starts, written)
    return _sources_of(seen, named).where("source <> node").select("source", "node")


def _reach(edges: DataFrame, starts: DataFrame, written) -> tuple[DataFrame, DataFrame]:
    """((node, word, bits): what comes where, (source, word, bit)).

    Sources travel as bits, 64 to a row: a row (node, word) says which of them have come there. A round moves the
    new bits over the edges and ends when none is new, so there are as many rounds as the farthest node is edges
    away, and a hub gets one row a word, however many paths lead there.
    """
    e = written(edges.select(F.col("source").alias("tail"), F.col("target").alias("head")).distinct())
    bits = written(_bits(starts))
    front = written(bits.select("node", "word", F.expr("shiftleft(1L, bit)").alias("bits")))
    seen = front
    while front.limit(1).count():
        moved = front.join(e, F.col("node") == F.col("tail")).groupBy(F.col("head").alias("node"), "word").agg(F.bit_or("bits").alias("bits"))
        front = written(moved.join(seen.withColumnRenamed("bits", "old"), ["node", "word"], "left").select("node", "word", F.expr("bits & ~coalesce(old, 0L)").alias("bits")).where("bits <> 0"))
        seen = written(seen.unionByName(front).groupBy("node", "word").agg(F.bit_or("bits").alias("bits")))
    return seen, bits.withColumnRenamed("node", "source")


def _bits(starts: DataFrame) -> DataFrame:
    """(node, word, bit): each start's word of its partition and bit; to be stored, as they depend on how rows are dealt out."""
    parts = int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = starts.select("node").distinct().repartitionByRange(parts, "node").sortWithinPartitions("node")
    return dealt.withColumn("at", F.monotonically_increasing_id()).select("node", F.shiftright("at", 6).alias("word"), (F.col("at") % 64).cast("int").alias("bit"))


def _sources_of(rows: DataFrame, named: DataFrame) -> DataFrame:
    """A row for each source of each word's bits. named: (source, word, bit)."""
    each = rows.withColumn("bit", F.explode(F.expr("filter(sequence(0, 63), i -> (shiftright(bits, i) & 1) = 1)")))
    return each.join(named, ["word", "bit"])


# --- search with its caps inside -----------------------------------------------------------------


def _enough(inner: int, left: int, keep: int) -> int:
    """How many paths with the same ends suffice, of those that agree in all but `inner` inner nodes, so that the first
    `keep` that avoid any `left` later nodes are among them.

    A node stands in each inner place of at most _enough(inner - 1) of them, so `left` nodes strike out at most
    left * inner * _enough(inner - 1).
    """
    return 1 if inner == 0 else keep + left * inner * _enough(inner - 1, left, keep)


#: Sources whose paths one task makes and tasks at most; edges and names that a search broadcasts at most.
SOURCES, TASKS, EDGES, NAMES = 32, 20_000, 20_000_000, 5_000_000


class _Graph(NamedTuple):
    """A graph for a search. names: (node, id), numbers in the order of names; begin: the sources as paths without an
    edge, dealt out; grow: of how many edges may follow, (tail, heads); goals: (target), numbers, or None."""

    names: DataFrame
    begin: DataFrame
    grow: Callable[[int], DataFrame]
    goals: DataFrame | None


def _graph(edges: DataFrame, starts: DataFrame, length: int = 4, targets: DataFrame | None = None) -> _Graph:
    """Nodes are numbered, and a node's edges are one row (head * 4 + sign + 1), which every task gets: paths then grow where
    their source is and are never shuffled. Of more than EDGES edges the rows are dealt out by tail instead."""
    e = stored(_signed_edges(edges))
    nodes = e.select(F.explode(F.array("tail", "head")).alias("node")).distinct().withColumn("one", F.lit(1))
    names = stored(running_total(nodes, ["node"], "one", "id").select("node", F.col("id").cast("int").alias("id")))
    small = e.count() <= EDGES
    ends = {c: names.select(F.col("node").alias(c), F.col("id").alias(f"_{c}")) for c in ("tail", "head")}

    def ways(some: DataFrame) -> DataFrame:
        rows = some.join(ends["tail"], "tail").join(ends["head"], "head").groupBy(F.col("_tail").alias("tail")).agg(F.collect_list(F.shiftleft("_head", 2) + F.col("s") + 1).alias("heads"))
        rows = stored(rows)
        return F.broadcast(rows) if small else rows

    near = _near(e, targets, length)
    if near is None:
        every = ways(e)
        grow, goals = (lambda left: every), None
    else:
        made: dict[int, DataFrame] = {}

        def grow(left: int) -> DataFrame:
            k = min(left, len(near) - 1)
            if k not in made:
                made[k] = ways(e.join(near[k], "head", "left_semi"))
            return made[k]

        goals = _few(near[0].select(F.col("head").alias("node")).join(names, "node").select(F.col("id").alias("target")), NAMES)
    own = stored(starts.select("node").distinct().join(names, "node").select(F.col("node").alias("source"), "id"))
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-own.count() // SOURCES), TASKS))
    # neighbours in the order of names are in one task, so what it says of a target it says once
    begin = own.repartitionByRange(parts, "source").select("source", F.expr("shiftleft(cast(id as bigint), 32) | id").alias("pair"), F.array("id").alias("nodes"), F.lit(1).alias("sign"), F.lit(True).alias("open"))
    return _Graph(names, begin, grow, goals)


def _few(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= most else df


#: SQL: numbers of a pair's ends.
SOURCE, TARGET = "cast(shiftright(pair, 32) as int)", "cast(pair & 4294967295L as int)"
_NONE = "cast(array() as array<int>)"


def _led(rows: DataFrame, ways: DataFrame, leads: str) -> DataFrame:
    """rows of a pair: one with code -1 for itself and, where `leads`, one for each edge onward."""
    rows = rows.withColumn("_at", F.expr(TARGET)).join(ways, F.col("_at") == F.col("tail"), "left")
    return rows.withColumn("code", F.explode(F.expr(f"concat(array(-1), if({leads}, coalesce(heads, {_NONE}), {_NONE}))"))).drop("_at", "tail", "heads")


_MOVED = "if(code < 0, pair, (pair & ~4294967295L) | shiftright(code, 2))"


def _onward(step: DataFrame, ways: DataFrame) -> DataFrame:
    """step's longest paths (open) with one edge more, and all its paths, closed."""
    rows = _led(step, ways, "open").where("code < 0 or not array_contains(nodes, shiftright(code, 2))")
    return rows.select("source", F.expr(_MOVED).alias("pair"), F.expr("if(code < 0, nodes, array_append(nodes, shiftright(code, 2)))").alias("nodes"), F.expr("if(code < 0, sign, sign * ((code & 3) - 1))").alias("sign"), F.expr("code >= 0").alias("open"))


def _sufficient(step: DataFrame, n: int, left: int, keep: int) -> DataFrame:
    """Of open paths, of n edges, that `left` nodes may follow, those that can be among the first `keep` of any continuation."""
    for free in range(1, n):  # paths that share more inner nodes first
        for fixed in combinations(range(1, n), n - 1 - free):
            same = Window.partitionBy("pair", "source", "open", *[F.get("nodes", F.lit(i)) for i in fixed]).orderBy("nodes")
            step = step.withColumn("_r", F.row_number().over(same)).where(~F.col("open") | (F.col("_r") <= _enough(free, left, keep))).drop("_r")
    return step


def _signed_edges(edges: DataFrame) -> DataFrame:
    sign = F.when(F.col("sign") == "positive", 1).when(F.col("sign") == "negative", -1).otherwise(0)
    return simple_edges(edges).select(F.col("source").alias("tail"), F.col("target").alias("head"), sign.alias("s"))


def _steps(g: _Graph, length: int, further: int, keep: int) -> DataFrame:
    """Paths of 1 to `length` edges (source, pair, nodes, sign, open), of which each end keeps what continuations of
    `further` more edges can need. Nothing is stored: a path is a few numbers, and its source's task makes it again."""
    if length == 0:
        return g.begin
    code = F.explode("heads").alias("code")
    step = g.begin.select("source", "pair", F.get("nodes", F.lit(0)).alias("_at")).join(g.grow(length + further - 1), F.col("_at") == F.col("tail")).select("source", "pair", "_at", code)
    step = step.select("source", F.expr(_MOVED).alias("pair"), F.expr("array(_at, shiftright(code, 2))").alias("nodes"), F.expr("(code & 3) - 1").alias("sign"), F.lit(True).alias("open"))
    for n in range(2, length + 1):
        left = length + further - n
        step = _sufficient(_onward(step, g.grow(left)), n, left, keep)
    return step


def _near(e: DataFrame, targets: DataFrame | None, length: int) -> list[DataFrame] | None:
    """near[k]: nodes (head) from which a target is at most k edges away."""
    if targets is None:
        return None
    near = [stored(targets.select(F.col("node").alias("head")).distinct())]
    for _ in range(length - 1):
        near.append(stored(near[-1].unionByName(e.join(near[-1], "head", "left_semi").select(F.col("tail").alias("head"))).distinct()))
    return near


def _made(g: _Graph, length: int, keep: int) -> DataFrame:
    """As _steps, with the last edge, and only to goals."""
    rows = _onward(_steps(g, length - 1, 1, keep), g.grow(0)) if length > 1 else _steps(g, 1, 0, keep)
    return rows if g.goals is None else rows.withColumn("target", F.expr(TARGET)).join(g.goals, "target", "left_semi").drop("target")


def _named(rows: DataFrame, names: DataFrame) -> DataFrame:
    """target by name, for the pair's number."""
    return rows.withColumn("_at", F.expr(TARGET)).join(_few(names.select(F.col("id").alias("_at"), F.col("node").alias("target")), NAMES), "_at").drop("_at")


def best_paths(edges: DataFrame, starts: DataFrame, max_length: int = 4, per_target: int = 25, targets: DataFrame | None = None, nodes: bool = True) -> DataFrame:
    """The first per_target simple paths of each (source, target), by length, then nodes; exact, without making all paths.

    source, target, nodes, n_edges, sign (product of 1 and -1; 0 if an edge is unsigned), rank. A step keeps for
    each (source, node) only as many paths as can be among the first of any continuation, whatever nodes follow.
    The result is dealt out by source. nodes: False leaves nodes out, which saves looking up their names.
    """
    return _best(_graph(edges, starts, max_length, targets), max_length, per_target, nodes)


def _best(g: _Graph, length: int, per_target: int, nodes: bool = True) -> DataFrame:
    rows = _made(g, length, per_target).withColumn("n_edges", F.size("nodes") - 1)
    w = Window.partitionBy("pair", "source").orderBy("n_edges", "nodes")
    rows = _named(rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_target), g.names)
    if not nodes:
        return rows.select("source", "target", "n_edges", "sign", "rank")
    for i in range(1, length):
        inner = _few(g.names.select(F.col("id").alias("_at"), F.col("node").alias(f"_{i}")), NAMES)
        rows = rows.withColumn("_at", F.when(F.col("n_edges") > i, F.get("nodes", F.lit(i)))).join(inner, "_at", "left").drop("_at")
    named = F.array_compact(F.array("source", *[f"_{i}" for i in range(1, length)], "target"))
    return rows.select("source", "target", named.alias("nodes"), "n_edges", "sign", "rank")


def path_counts(edges: DataFrame, starts: DataFrame, max_length: int = 4, per_target: int = 25, targets: DataFrame | None = None) -> DataFrame:
    """(source, target, n_paths): how many paths best_paths keeps of each pair. The last step is counted, not made."""
    g = _graph(edges, starts, max_length, targets)
    counts = _made(g, max_length, per_target).groupBy("source", "pair").agg(F.least(F.count("*"), F.lit(per_target)).alias("n_paths"))
    return _named(counts, g.names).select("source", "target", "n_paths")


def _ends(g: _Graph, length: int, keep: int, counted: bool = True) -> DataFrame:
    """(source, pair, n1 to n<length>, far): how many paths of each length lead there, exact up to `keep` of a pair, and
    whether a simple path of length + 1 edges does. counted: False gives the far pairs alone (source, pair).

    Only paths of length - 1 edges are made. An edge from their end u to v is a row with the inner nodes that all of the
    source's paths to u which avoid v share; what all ways to v share is what the next edge can't lead to.
    """
    numbers = [f"n{i}" for i in range(1, length + 1)]
    short = {c: F.count_if(F.size("nodes") == i + 2) for i, c in enumerate(numbers[:-1])} if counted else {}
    at = _steps(g, length - 1, 2, keep).groupBy("source", "pair").agg(*[n.alias(c) for c, n in short.items()], F.collect_list(F.when(F.col("open"), F.expr(f"slice(nodes, 2, {length - 1})"))).alias("ways"))
    rows = _led(at, g.grow(1), "size(ways) > 0").where(f"code < 0 or shiftright(code, 2) <> {SOURCE}")
    rows = rows.withColumn("ways", F.expr("if(code < 0, null, filter(ways, p -> not array_contains(p, shiftright(code, 2))))")).where("code < 0 or size(ways) > 0")
    shared = F.expr("if(code < 0, null, if(size(ways) = 1, ways[0], aggregate(ways, ways[0], (a, p) -> array_intersect(a, p))))")
    own = [F.expr(f"if(code < 0, {c}, 0L)").alias(c) for c in short] + ([F.expr("if(code < 0, 0L, cast(size(ways) as bigint))").alias(numbers[-1])] if counted else [])
    rows = rows.select("source", F.expr(_MOVED).alias("pair"), *own, shared.alias("shared"))
    rows = rows.withColumn("one", F.first("shared", ignorenulls=True).over(Window.partitionBy("pair", "source")))
    each = range(length - 1)
    rows = rows.select("*", *[F.get("one", F.lit(i)).alias(f"_{i}") for i in each])
    rows = rows.groupBy("pair", "source").agg(*[F.sum(c).alias(c) for c in (numbers if counted else [])], F.count("shared").alias("n"), *[F.max(f"_{i}").alias(f"_{i}") for i in each], *[F.count_if(F.array_contains("shared", F.col(f"_{i}"))).alias(f"hits{i}") for i in each])
    stops = ", ".join(["-1", *[f"if(hits{i} = n, _{i}, -1)" for i in each]])
    rows = _led(rows.select("source", "pair", *(numbers if counted else []), "n", F.expr(f"array({stops})").alias("stops")), g.grow(0), "n > 0")
    rows = rows.where(f"code < 0 or (shiftright(code, 2) <> {SOURCE} and not array_contains(stops, shiftright(code, 2)))")
    if not counted:
        return rows.where("code >= 0").select("source", F.expr(_MOVED).alias("pair")).distinct()
    rows = rows.select("source", F.expr(_MOVED).alias("pair"), "code", *[F.expr(f"if(code < 0, {c}, 0L)").alias(c) for c in numbers])
    return rows.groupBy("source", "pair").agg(*[F.sum(c).alias(c) for c in numbers], F.bool_or(F.col("code") >= 0).alias("far"))


def beyond_pairs(edges: DataFrame, starts: DataFrame, max_length: int = 4) -> DataFrame:
    """(source, target): pairs with a simple path of max_length + 1 edges. Only paths of max_length - 1 edges are made."""
    g = _graph(edges, starts, max_length)
    return _named(_ends(g, max_length, 1, counted=False), g.names).select("source", "target")


def beyond_cutoff(edges: DataFrame, starts: DataFrame, max_length: int = 4) -> DataFrame:
    """Sources from which a simple path of max_length + 1 edges leads on."""
    return beyond_pairs(edges, starts, max_length).select("source").distinct()


def search(edges: DataFrame, starts: DataFrame, max_length: int = 4, per_target: int = 25, total: int | None = None, candidates: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(paths, results) of a search with its caps.

    paths: as best_paths, at most `total` of them in the order of source, target, rank. results: one row per
    (source, target): status, reason, generated, retained, discarded, discarded_per_candidate, discarded_total,
    max_depth, truncated. Paths of a pair are generated until one is over the cap. Without candidates the pairs are
    those reachable over any number of edges; with candidates (node), each source is paired with each. Sources that
    can't be searched have a row without a target. After the pair at which `total` is used up no pair has a row.
    """
    edges = stored(edges.select("source", "target", "edge_id", "sign"))
    every = stored(sources(edges, starts))
    known = stored(every.where("status = 'searched'").select("node"))
    seen, named = _reach(edges, known, stored)
    key, numbers = ["source", "target"], [f"n{i}" for i in range(1, max_length + 1)]
    g = _graph(edges, known, max_length)
    ends = stored(_named(_ends(g, max_length, per_target + 1), g.names).select(*key, *numbers, "far"))
    if candidates is None:
        # pairs that only longer paths join are told by their sources' bits; the others are in ends
        met = ends.select("source", F.col("target").alias("node")).join(_few(named, NAMES), "source").groupBy("node", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("met"))
        rest = seen.join(met, ["node", "word"], "left").select("node", "word", F.expr("bits & ~coalesce(met, 0L)").alias("bits")).where("bits <> 0")
        rest = _sources_of(rest, named).where("source <> node").select("source", F.col("node").alias("target"), *[F.lit(0).cast("long").alias(c) for c in numbers], F.lit(False).alias("far"))
        rows = ends.unionByName(rest).select(*key, F.lit("resolved").alias("status"), F.lit("all_reachable_entities").alias("scope"), *numbers, "far", F.lit(True).alias("reached"))
    else:
        reach = _sources_of(seen, named).where("source <> node").select("source", F.col("node").alias("target"), F.lit(True).alias("reached"))
        rows = search_targets(edges, known, candidates).join(ends, key, "left").join(reach, key, "left").fillna(dict.fromkeys(numbers, 0))
    rows = rows.withColumn("generated", F.least(sum((F.col(c) for c in numbers), F.lit(0)), F.lit(per_target + 1)))
    over = F.col("generated") > per_target
    status = F.when(F.col("status") != "resolved", F.col("status")).when(F.col("reached").isNull(), "no_path_found").when(over, "maximum_paths_per_candidate_reached").when(F.col("far"), "maximum_path_length_reached").otherwise("complete")
    rows = rows.select(*key, "scope", status.alias("status"), "generated", F.least("generated", F.lit(per_target)).alias("retained"), *numbers)
    if total is not None:
        rows = running_total(rows, key, "retained", "before")
        # a pair has a row as long as something is left, and so has the first one after that
        rows = rows.where((F.col("before") < total) | (F.col("before") - F.col("last") < total))
        room = F.greatest(F.lit(total) - F.col("before"), F.lit(0))
        cut = (room < F.col("generated")) & (room < per_target) | (room == 0)
        rows = stored(rows.withColumns({
            "status": F.when(cut, "maximum_total_paths_reached").otherwise(F.col("status")),
            "generated": F.when(room == 0, 0).when(cut, room + 1).otherwise(F.col("generated")),
            "retained": F.least("retained", room),
        }))
    # shorter paths come first: the last one generated is as long as it takes to count so far
    depth, upto = F.lit(max_length), F.lit(0)
    for n in range(max_length - 1, 0, -1):
        depth = F.when(F.col("generated") <= sum((F.col(c) for c in numbers[:n]), upto), n).otherwise(depth)
    rows = rows.withColumn("max_depth", F.when(F.col("generated") == 0, 0).otherwise(depth))
    found = _best(g if candidates is None else _graph(edges, known, max_length, candidates), max_length, per_target + 1)
    found = found.join(rows.select(*key, F.col("retained").alias("room")), key).where("rank <= room").drop("room")
    rows = rows.withColumn("discarded", F.col("generated") - F.col("retained"))
    rows = rows.withColumn("discarded_total", F.when(F.col("status") == "maximum_total_paths_reached", F.col("discarded")).otherwise(0)).withColumn("discarded_per_candidate", F.col("discarded") - F.col("discarded_total"))
    reason = {"complete": "all_simple_paths_exhausted", "maximum_path_length_reached": "search_cutoff_depth_reached", "no_path_found": "target_not_reachable_in_graph_layer"}
    named = F.coalesce(F.create_map(*[F.lit(x) for kv in reason.items() for x in kv])[F.col("status")], F.col("status"))
    columns = (*key, "scope", "status", "reason", "generated", "retained", "discarded", "discarded_per_candidate", "discarded_total", "max_depth", "truncated")
    bad = every.where("status <> 'searched'").select(F.col("node").alias("source"), F.lit(None).cast("string").alias("target"), F.lit("requested_source").alias("scope"), "status", *[F.lit(0).cast("long").alias(c) for c in ("generated", "retained", "discarded", "discarded_per_candidate", "discarded_total")], F.lit(0).alias("max_depth"))
    rows = rows.select(*bad.columns).unionByName(bad)
    rows = rows.withColumn("reason", named).withColumn("truncated", F.col("status").startswith("maximum_")).select(*columns)
    return found, rows


def confidence(paths: DataFrame, quality: DataFrame) -> DataFrame:
    """Per path: average and weakest edge quality, caps, confidence. quality: (edge_id, quality, predicted_only, functional_only)."""
    key = ["source", "target", "nodes"]
    rows = paths.select(*key, "n_edges", "signs", F.explode("edge_ids").alias("edge_id")).join(quality, "edge_id")
    out = rows.groupBy(*key, "signs").agg(F.avg("quality").alias("avg_quality"), F.min("quality").alias("min_quality"), F.bool_or("predicted_only").alias("any_predicted"), F.bool_and("functional_only").alias("all_indirect"))
    one = lambda t, v: F.when(t, v).otherwise(1.0)
    cap = F.least(one(F.col("any_predicted"), 0.7), one(F.col("all_indirect"), 0.55), one(F.array_contains("signs", "conflicting"), 0.4), one(~F.forall("signs", lambda s: s.isin("positive", "negative")), 0.55))
    return out.withColumn("confidence", F.least("avg_quality", "min_quality", cap)).drop("signs")


def conflicts(paths: DataFrame) -> DataFrame:
    """Targets of a source with signed paths of both signs."""
    return paths.where("is_signed").groupBy("source", "target").agg(F.count_if(F.col("cumulative_sign") == 1).alias("n_positive"), F.count_if(F.col("cumulative_sign") == -1).alias("n_negative"), F.min(F.when(F.col("cumulative_sign") == 1, F.col("n_edges"))).alias("shortest_positive"), F.min(F.when(F.col("cumulative_sign") == -1, F.col("n_edges"))).alias("shortest_negative")).where("n_positive > 0 and n_negative > 0")


def shortest(paths: DataFrame) -> DataFrame:
    """The shortest path of each (source, target); the smallest nodes on ties."""
    return paths.groupBy("source", "target").agg(F.min(F.struct("n_edges", "nodes")).alias("p")).select("source", "target", "p.n_edges", "p.nodes")


def support_rows(paths: DataFrame) -> DataFrame:
    """Paths as support of their target: signed causal or context, and how strong."""
    return paths.select("source", F.col("target").alias("gene"), *_support(), "n_edges", "nodes")


def _support() -> list[Column]:
    strength = F.when(F.col("direction_consistent"), "supports_direction").when(F.col("direction_consistent").isNull(), "context_only").otherwise("contradicts_direction")
    return [F.when(F.col("is_signed"), "signed_causal").otherwise("context").alias("kind"), strength.alias("strength")]


def gene_trace(paths: DataFrame) -> DataFrame:
    """Per target: consistent and contradicting signed paths, coherence."""
    out = paths.where("is_signed").groupBy("target").agg(F.count("*").alias("n_paths"), F.count_if("direction_consistent").alias("n_consistent"), F.count_if(~F.col("direction_consistent")).alias("n_contradicting"))
    return out.withColumn("coherence", F.when(F.col("n_consistent") + F.col("n_contradicting") > 0, F.col("n_consistent") / (F.col("n_consistent") + F.col("n_contradicting"))))


def _counted_by_sign(paths: DataFrame, observed: DataFrame, *by: str) -> DataFrame:
    """Paths of `directed`, counted by target, sign and `by` where they are made, then met with observed as in consistency."""
    counted = paths.groupBy("target", "is_signed", "expected_direction", *by).agg(F.count("*").alias("n"))
    return consistency(counted, observed)


def gene_trace_of(paths: DataFrame, observed: DataFrame) -> DataFrame:
    """As gene_trace of consistency: counts meet what was observed, not paths."""
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    ok = F.col("direction_consistent")
    out = _counted_by_sign(paths.where("is_signed"), observed).groupBy("target").agg(F.sum("n").alias("n_paths"), total(ok).alias("n_consistent"), total(~ok).alias("n_contradicting"))
    return out.withColumn("coherence", F.when(F.col("n_consistent") + F.col("n_contradicting") > 0, F.col("n_consistent") / (F.col("n_consistent") + F.col("n_contradicting"))))


def support_counts(paths: DataFrame, observed: DataFrame) -> DataFrame:
    """(kind, strength, n_edges, n): the rows of support_rows counted, without making them."""
    rows = _counted_by_sign(paths, observed, "n_edges")
    return rows.groupBy(*_support(), "n_edges").agg(F.sum("n").alias("n"))


def dangling_marks(marks: DataFrame) -> DataFrame:
    """As dangling, of one table (source, target, path, kept): what is said of a pair, by a path or (path false) a result
    with `kept` paths. It is told source by source: pairs that are dealt out by source aren't shuffled."""
    out = marks.groupBy("source", "target").agg(F.bool_or("path").alias("path"), F.bool_or(~F.col("path")).alias("result"), F.count_if(~F.col("path") & (F.col("kept") > 0)).alias("n"))
    names = F.concat(F.when(F.col("path") & ~F.col("result"), F.array(F.lit("path_without_result"))).otherwise(F.array().cast("array<string>")), F.when(~F.col("path"), F.array_repeat(F.lit("result_without_path"), F.col("n").cast("int"))).otherwise(F.array().cast("array<string>")))
    return out.select(F.explode(names).alias("check"), "source", "target")


def dangling(paths: DataFrame, results: DataFrame) -> DataFrame:
    """(check, source, target): paths without a search result, and results without a path."""
    k = ["source", "target"]
    a = paths.select(*k).distinct().join(results, k, "left_anti").select(F.lit("path_without_result").alias("check"), *k)
    return a.unionByName(results.where("kept > 0").join(paths, k, "left_anti").select(F.lit("result_without_path").alias("check"), *k))
