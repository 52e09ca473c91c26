"""Periodic run detection in a grammar of the text.

A *run* is a stretch of words with smallest period q (words q apart are identical) that is at least two
periods and `min_words` long and that no neighbouring word extends.

1. Words become ids. A word that occurs once in its document is in no run, so it ends the text for the
   grammar as a document's border does; what is left in stretches of at least `min_words` goes on.
2. Re-Pair: the most frequent pairs of symbols become nonterminals, round by round, in all documents of a
   block at once. A pair is replaced where no neighbouring pair is more frequent, so a round takes every pair
   that the sequential order would take next in its own surroundings. Symbols that no pair repeats are joined
   in twos until each stretch has one root.
3. Each nonterminal's boundary is looked at once, in one of its derivations: a run across it repeats the
   word before or after the boundary one period away, which names the candidate periods; common extensions to
   both sides (by ranks of all substrings of 2**k words, exact) tell how far each one goes.
4. The runs move to all derivation positions of their nonterminal. A run that leaves a nonterminal is whole in
   an ancestor, so intervals of equal period that share a period merge into the maximal one.

Documents are independent: nothing is shuffled, and a task that is lost is computed again.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 150_000  # words whose grammar is built at a time, but for a longer document; bounds a task's memory
CANDIDATES = 1_000_000  # candidate periods that are extended at a time

_FOUND = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number) of each number in the ranges low to high."""
    n = high - low
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + low[owner]


class Grammar:
    """Nonterminals of the stretches of `terms` that share a number in `stretch`.

    start, border, end: one derivation of each; rule, place: every derivation position of every nonterminal.
    Those of fewer than `least` words are left out, as no run fits into them.
    """

    def __init__(self, terms: np.ndarray, stretch: np.ndarray, least: int) -> None:
        self.least, self.n, self._first, self._every = least, 0, [], []
        sym, at, end = self._pairs(terms.astype(np.int64), stretch)
        self._roots(at, end, stretch)
        self.start, self.border, self.end = (np.concatenate(c) for c in zip(*self._first, strict=True))
        self.rule, self.place = (np.concatenate(c) for c in zip(*self._every, strict=True))

    def _add(self, name: np.ndarray, start: np.ndarray, border: np.ndarray, end: np.ndarray) -> None:
        """Notes derivations; equal names are one nonterminal."""
        keep = end - start >= self.least
        _, first, back = np.unique(name[keep], return_index=True, return_inverse=True)
        self._first.append((start[keep][first], border[keep][first], end[keep][first]))
        self._every.append((back + self.n, start[keep]))
        self.n += len(first)

    def _pairs(self, sym: np.ndarray, stretch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, fresh = np.arange(len(sym)), int(sym.max(initial=0)) + 1
        end, live = at + 1, np.ones(len(sym), bool)
        while True:
            # a pair that occurs once will never be frequent, so only pairs that repeated or are new are counted
            i = np.flatnonzero(live[:-1] & (stretch[at[:-1]] == stretch[at[1:]]))
            _, pair, count = np.unique(sym[i] * np.int64(fresh) + sym[i + 1], return_inverse=True, return_counts=True)
            often = count[pair] > 1
            i, pair = i[often], pair[often]
            if not len(i):
                return sym, at, end
            # rank: by frequency; among equals in an order unrelated to the text, so that long repeats fold evenly
            order = np.lexsort((np.arange(len(count)) * 0x9E3779B1 & 0xFFFFFFFF, count))
            rank = np.empty(len(count), np.int64)
            rank[order] = np.arange(len(count))
            prio = np.full(len(sym) + 1, -1)
            prio[i] = rank[pair]
            new = np.concatenate([[True], prio[1:-1] != prio[:-2], [True]])  # equal neighbours: a symbol repeats
            cut = np.flatnonzero(new)
            value = prio[cut]
            top = (value >= 0) & (value > np.concatenate([[-2], value[:-1]])) & (value > np.concatenate([value[1:], [-2]]))
            part = np.cumsum(new) - 1
            here = np.flatnonzero((top[part] & ((np.arange(len(part)) - cut[part]) % 2 == 0))[:-1])
            self._add(prio[here], at[here], at[here + 1], end[here + 1])
            live = np.zeros(len(sym), bool)
            live[i] = True
            sym[here] = fresh + prio[here]
            end[here] = end[here + 1]
            live[here] = True
            live[here[here > 0] - 1] = True
            stay = np.ones(len(sym), bool)
            stay[here + 1] = False
            sym, at, end, live = sym[stay], at[stay], end[stay], live[stay]
            fresh += len(count)
            if fresh > 1 << 30:  # names are given anew before pairs of them pass 63 bits
                used, sym = np.unique(sym, return_inverse=True)
                fresh = len(used)

    def _roots(self, at: np.ndarray, end: np.ndarray, stretch: np.ndarray) -> None:
        while True:
            own = stretch[at]
            new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
            nth = np.arange(len(at)) - np.repeat(new, np.diff(np.append(new, len(at))))
            here = np.flatnonzero((nth[:-1] % 2 == 0) & (own[:-1] == own[1:])) if len(at) else new
            self._add(here, at[here], at[here + 1] if len(here) else here, end[here + 1] if len(here) else here)
            if not len(here):
                return
            end[here] = end[here + 1]
            stay = np.ones(len(at), bool)
            stay[here + 1] = False
            at, end = at[stay], end[stay]


class Extensions:
    """How far two places of a text agree, forwards and backwards, inside stretches; exact."""

    def __init__(self, terms: np.ndarray, ends: np.ndarray) -> None:
        """ends: for each place the end of its stretch."""
        self.ranks, n, places = [terms.astype(np.int64)], len(terms), np.arange(len(terms))
        while True:
            step, last = 1 << len(self.ranks) - 1, self.ranks[-1]
            places = places[places + 2 * step <= ends[places]]
            places = places[(last[places] >= 0) & (last[places + step] >= 0)]
            _, name, count = np.unique(last[places] * np.int64(n + 1) + last[places + step], return_inverse=True, return_counts=True)
            again = count[name] > 1
            if not again.any():
                return
            places = places[again]
            rank = -1 - np.arange(n)  # what stands nowhere else in its document equals nothing
            rank[places] = name[again]
            self.ranks.append(rank)

    def forward(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        done, top = np.zeros(len(i), np.int64), len(self.ranks[0]) - 1
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, more = self.ranks[k], done + (1 << k) <= limit
            done[more & (rank[np.minimum(i + done, top)] == rank[np.minimum(j + done, top)])] += 1 << k
        return done

    def backward(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Before the places i and j."""
        done = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, more = self.ranks[k], done + (1 << k) <= limit
            done[more & (rank[np.maximum(i - done - (1 << k), 0)] == rank[np.maximum(j - done - (1 << k), 0)])] += 1 << k
        return done


def crossing(terms: np.ndarray, ends: np.ndarray, start: np.ndarray, border: np.ndarray, end: np.ndarray, least: int):
    """Yields (nonterminal, start, end, period) arrays: the runs across each border, as far as the nonterminal goes."""
    if not len(start):
        return
    reach, n = Extensions(terms, ends), np.int64(len(terms) + 1)
    places = np.argsort(terms, kind="stable")
    listed = terms[places] * n + places  # places of each word, ascending
    after, before = terms[border] * n, terms[border - 1] * n
    # a run holds a whole period on one side of the border: left of it, the word after the border stands one
    # period earlier; right of it, the word before the border stands one period later
    left = np.searchsorted(listed, after + start), np.searchsorted(listed, after + border)
    right = np.searchsorted(listed, before + border), np.searchsorted(listed, before + end)
    total, at = np.cumsum(left[1] - left[0] + right[1] - right[0]), 0
    while at < len(start):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CANDIDATES, "right")))
        o, k = _spread(left[0][at:upto], left[1][at:upto])
        p, m = _spread(right[0][at:upto], right[1][at:upto])
        rule = np.concatenate([o, p]) + at
        i = np.concatenate([places[k], border[p + at]])
        j = np.concatenate([border[o + at], places[m] + 1])
        s, e = start[rule], end[rule]
        back = reach.backward(i, j, i - s)
        a, b, q = i - back, j + reach.forward(i, j, e - j), j - i
        good = np.flatnonzero((b - a >= 2 * q) & (b - a >= least))
        rule, a, b, q = rule[good], a[good], b[good], q[good]
        order = np.lexsort((q, b, a, rule))  # a stretch with several periods has the smallest one
        rule, a, b, q = rule[order], a[order], b[order], q[order]
        first = np.ones(len(rule), bool)
        first[1:] = (rule[1:] != rule[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        yield rule[first], a[first], b[first], q[first]
        at = upto


def runs_of(words: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs in word ids with ascending document numbers, by start, then period."""
    none = np.zeros(0, np.int64)
    _, term, count = np.unique(doc * (words.max(initial=0) + 1) + words, return_inverse=True, return_counts=True)
    again = count[term] > 1
    parted = np.ones(len(words), bool)
    parted[1:] = ~again[1:] | ~again[:-1] | (doc[1:] != doc[:-1])
    cut = np.flatnonzero(parted)
    size = np.diff(np.append(cut, len(words)))
    whole = (size >= least) & again[cut]
    owner, home = _spread(cut[whole], (cut + size)[whole])
    if not len(home):
        return none, none, none
    _, terms = np.unique(term[home], return_inverse=True)
    ends = np.cumsum(size[whole])[owner]
    grammar = Grammar(terms, owner, least)
    found = [*crossing(terms, ends, grammar.start, grammar.border, grammar.end, least)]
    rule, a, b, q = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (none,) * 4
    if not len(rule):
        return none, none, none
    # every derivation position of the nonterminals that hold runs
    order = np.argsort(grammar.rule, kind="stable")
    low, high = np.searchsorted(grammar.rule[order], rule, "left"), np.searchsorted(grammar.rule[order], rule, "right")
    one, k = _spread(low, high)
    move = grammar.place[order[k]] - grammar.start[rule[one]]
    a, b, q = a[one] + move, b[one] + move, q[one]
    # intervals of one period in one stretch that share at least a period are one run
    order = np.lexsort((a, q, owner[a]))
    a, b, q, own = a[order], b[order], q[order], owner[a[order]]
    group = np.cumsum(np.concatenate([[0], (q[1:] != q[:-1]) | (own[1:] != own[:-1])]))
    far = np.maximum.accumulate(group * (len(home) + 1) + b) - group * (len(home) + 1)
    new = np.ones(len(a), bool)
    new[1:] = (group[1:] != group[:-1]) | (a[1:] + q[1:] > far[:-1])
    last = np.append(np.flatnonzero(new)[1:], len(a)) - 1
    a, b, q = home[a[new]], home[far[last] - 1] + 1, q[new]
    order = np.lexsort((q, a))
    return a[order], b[order], q[order]


def _judged(rows: list, least: int) -> pa.RecordBatch:
    """rows: (doc_id, words)."""
    known: defaultdict = defaultdict()
    known.default_factory = known.__len__
    counts = np.array([len(w) for _, w in rows])
    ids = np.fromiter((known[x] for _, w in rows for x in w), np.int64, int(counts.sum()))
    base = np.cumsum(counts) - counts
    a, b, q = runs_of(ids, np.repeat(np.arange(len(rows)), counts), least)
    own = np.searchsorted(base, a, "right") - 1
    # an empty document has the base of the next one; runs belong to the last of these
    low, high = np.searchsorted(own, np.arange(len(rows)), "left"), np.searchsorted(own, np.arange(len(rows)), "right")
    kept = []
    for k, (_, words) in enumerate(rows):
        if low[k] < high[k]:
            stay = np.ones(len(words), bool)
            for x, y in zip((a + q)[low[k] : high[k]] - base[k], b[low[k] : high[k]] - base[k], strict=True):
                stay[x:y] = False
            words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
        kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
    run = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (a - base[own], b - a, q)], names=["start", "length", "period"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(low, len(a)), pa.int32()), run)
    return pa.record_batch([pa.array([d for d, _ in rows], pa.int64()), pa.array(counts, pa.int64()), lists, pa.array(kept, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def _scan(least: int):
    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.append((doc, text.encode("utf-8", "surrogatepass").split()))  # bytes: only ASCII white space parts words
                size += len(rows[-1][1])
                if size >= BLOCK:
                    yield _judged(rows, least)
                    rows, size = [], 0
        if rows:
            yield _judged(rows, least)

    return run


def find_runs(docs: DataFrame, min_words: int = 12) -> DataFrame:
    """doc_id, n_words, runs (by start, then period), collapsed: the words that stay, joined by one space.

    A word goes if a run contains it after that run's first period. Null or empty texts have no words and no
    runs. Each row is judged alone: repeated or null ids and extra columns change nothing; an empty table
    gives an empty result. min_words is at least 2.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_scan(min_words), _FOUND)


def with_cycles(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth text, by crc32 of its id, gets a cycle as op11's contract asks; a null id gets none."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string"))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", h.alias("h"))
    df = df.withColumn("w", F.expr(r"if(h % 10 = 0, array_remove(split(text, '[\\x20\\x09-\\x0D]+'), ''), null)"))
    df = df.withColumn("n", F.coalesce(F.size("w"), F.lit(0))).withColumn("g", F.expr("h div 10"))
    df = df.withColumn("a", F.expr("g % greatest(n, 1)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    cycle = F.expr("concat_ws(' ', transform(sequence(0, n - 1), i -> get(w, int(if(i < a, i, a + (i - a) % p)))))")
    return df.select("doc_id", F.when(F.col("n") > 0, cycle).otherwise(F.col("text")).alias("text"))


def op11(spark, sf_dir: str) -> DataFrame:
    """Runs of every document's words, some of them planted cycles, as digests; see `find_runs`."""
    df = find_runs(with_cycles(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    best = F.expr("array_max(transform(runs, r -> struct(r.length, -r.start as start, -r.period as period)))")
    text = F.expr(r"concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    df = df.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return df.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
