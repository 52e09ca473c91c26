"""Collocations against plain counting; tries against dictionaries."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from strandlake.llm import collocations

SPLIT, WORD = re.compile("[.,;:!?\x0a-\x0d]"), re.compile("[^\x20\x09]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _expected(rows, top, least, percent):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in SPLIT.split((text or "").translate(LOWER)):
            w = WORD.findall(piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    longer = Counter()
    for (lang, *w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                key = (lang, *w[i : i + k])
                longer[key] = max(longer[key], a)
    found = {}
    for (lang, *w), a in cand.items():
        if 100 * longer[lang, *w] >= percent * a:
            continue
        _, _, left, right, score = min(((2000000 * a // (l + r)), k, l, r, 2000000 * a // (l + r)) for k in range(1, len(w)) for l, r in [(f[lang, *w[:k]], f[lang, *w[k:]])])
        found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, ps in found.items() for i, (s, a, p, l, r) in enumerate(sorted(ps)[:top]))


def _rows():
    rnd, out = random.Random(8), []
    words = ["De", "la", "ça", "É", "x\x0by", "n-1", "AB", "ab", "-", "q z"]
    for i in range(240):
        lang = rnd.choice(["en", "de", None, "und", ""])
        w = [rnd.choice(words) + rnd.choice(["", "", "", "7", ",", ". "]) for _ in range(rnd.randint(0, 40))]
        if i % 3 == 0:
            w[2:2] = ["as", "far", "As", "eye", "sees"]
        out.append((lang, rnd.choice([" ", "\t", "  "]).join(w) + rnd.choice(["", "\n", " ?"])))
    return [*out, ("en", None), (None, None), ("fr", ""), ("fr", "  "), ("en", "na " * 500), ("en", "na " * 500)]


@pytest.mark.parametrize(("least", "top", "shard", "block"), [(5, 2000, 200_000, 250_000), (8, 6, 25, 300)])
def test_phrases_against_counting(spark, monkeypatch, least, top, shard, block):
    monkeypatch.setattr(collocations, "SHARD", shard)  # several tries
    monkeypatch.setattr(collocations, "BLOCK", block)
    monkeypatch.setattr(collocations, "HELD", 1000)
    rows = _rows()
    docs = spark.createDataFrame([(None, t, lang, "w", 3) for lang, t in rows], "doc_id long, text string, lang string, word string, id int").repartition(3)
    got = collocations.mine_phrases(docs, top, least)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == _expected(rows, top, least, 80)


@pytest.mark.parametrize("rows", [[], [("en", "few words")]])
def test_nothing_frequent(spark, rows):
    assert collocations.mine_phrases(spark.createDataFrame(rows, "lang string, text string")).collect() == []


@pytest.mark.parametrize(("words", "n"), [(3, 60), (40, 3000), (5000, 4000), (9, 0)])
def test_trie_against_dictionary(words, n):
    rnd = random.Random(words)
    pick = lambda: int(words * rnd.random() ** 3) * 7  # noqa: E731  few words are in most phrases
    phrases = sorted({tuple(pick() for _ in range(rnd.randint(2, 4))) for _ in range(n)})
    rows = np.full((len(phrases), 4), -1, np.int64)
    for i, p in enumerate(phrases):
        rows[i, : len(p)] = p
    trie = collocations.Trie.from_bytes(collocations.Trie.of(rows).to_bytes())
    text = np.array([pick() if rnd.random() > 0.05 else -1 for _ in range(5000)], np.int64)
    number, got = {p: i for i, p in enumerate(phrases)}, set()
    for depth, (places, found) in enumerate(trie.walk(trie.symbols(text))):
        got |= {(depth + 1, i, k) for i, k in zip(places.tolist(), found.tolist(), strict=True)}
    assert got == {(k, i, number[p]) for k in range(1, 5) for i in range(len(text) - k + 1) for p in [tuple(text[i : i + k].tolist())] if p in number}
    assert len(trie.check) < 3 * sum(len(p) for p in phrases) + 2 * len(trie.alphabet) + 100
