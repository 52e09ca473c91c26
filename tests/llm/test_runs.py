"""Periodic runs against brute force: every period of every document, word by word."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from strandlake.llm import runs

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(words, least):
    """(start, length, period) of all runs: stretches that agree with themselves q words on; the smallest q of each."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            s = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, 2 * q):
                found.setdefault((s, i + q - s), q)
            i += i == s
    return sorted((s, n, q) for (s, n), q in found.items())


def _words(rnd, kind, n):
    v = rnd.choice([1, 2, 2, 3, 30])
    if kind == "random":
        return [rnd.randrange(v) for _ in range(n)]
    if kind == "cycle":
        w = ([rnd.randrange(v) for _ in range(rnd.randint(1, 9))] * 20)[:n]
        for _ in range(rnd.randint(0, 3) if w else 0):
            w[rnd.randrange(len(w))] = rnd.randrange(v)
        return w
    w, last = [0, 1], [0]
    if kind == "fibonacci":
        while len(w) < n:
            w, last = w + last, w
        return w[:n]
    while len(w) < n:  # Thue-Morse, then again
        w = w + [1 - x for x in w]
    return w[:n] * 2


@pytest.mark.parametrize("kind", ["random", "cycle", "fibonacci", "morse"])
def test_runs_against_brute_force(kind, monkeypatch):
    rnd = random.Random(kind)
    monkeypatch.setattr(runs, "CANDIDATES", 7)
    for _ in range(150):
        docs, least = [_words(rnd, kind, rnd.randint(0, 70)) for _ in range(rnd.randint(1, 4))], rnd.choice([2, 3, 12])
        base = np.cumsum([0, *map(len, docs)])
        a, b, q = runs.runs_of(np.array([x for w in docs for x in w], np.int64), np.repeat(np.arange(len(docs)), np.diff(base)), least)
        assert [*zip(a.tolist(), (b - a).tolist(), q.tolist(), strict=True)] == [(s + k, n, p) for k, w in zip(base.tolist(), docs, strict=False) for s, n, p in brute(w, least)]


def test_a_nonterminal_is_looked_at_once():
    """Sixty-four copies of a passage fold into few nonterminals, whose positions cover all derivations."""
    words = np.array(list(range(40)) * 64)
    g = runs.Grammar(words, np.zeros(len(words), np.int64), 12)
    assert g.n < 60 and len(g.place) > 2 * g.n
    for rule, place in zip(g.rule.tolist(), g.place.tolist(), strict=True):
        a, b = g.start[rule], g.end[rule]
        assert words[a:b].tolist() == words[place : place + b - a].tolist()


def test_long_repetitive_texts():
    a, b, q = runs.runs_of(np.zeros(100_000, np.int64), np.zeros(100_000, np.int64), 12)
    assert (a.tolist(), b.tolist(), q.tolist()) == ([0], [100_000], [1])


def _expected(doc_id, text):
    w = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found, gone = brute(w, 12), set()
    for s, m, q in found:
        gone |= set(range(s + q, s + m))
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op11_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "BLOCK", 500)
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("abcdefgh") + str(rnd.randrange(20)) for _ in range(rnd.randint(1, 150))) for _ in range(60)]
    texts += [None, "", " \n\t", "na " * 40, "a b\x0bc\x0cd e " * 9, "x y z " * 4 + "end", "x y z " * 4]
    rows = [(i, t, "s", 1) for i, t in enumerate(texts)] + [(None, "p q " * 9, None, None), (3, "dup " * 13, "s", 2), (3, "dup " * 13, "s", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, runs string, n int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = runs.op11(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted((_expected(i, t) for i, t, *_ in rows), key=str)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert runs.op11(spark, str(tmp_path)).collect() == []
