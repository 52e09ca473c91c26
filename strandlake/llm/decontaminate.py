"""Benchmark decontamination by the q-gram lemma.

If a benchmark item of m characters occurs in a text with at most e edits, at least m + 1 - q - q*e of its
q-grams occur there too, on diagonals (place in text minus place in item) that differ by at most e. So each
document looks up its q-grams in an index of the benchmark's, counts hits by item in overlapping bands of
diagonals, keeps the bands that reach the bound and verifies them by a banded alignment.

Texts are compared as lower-cased words joined by one space; other marks don't count.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Rolling, let_go, mix

Q = 12
EDITS = 0.05  # edits allowed per character of an item
BLOCK_CHARS = 2_000_000  # benchmark characters that one pass sends to the tasks; a larger benchmark takes more passes
PAIRS = 1 << 19  # pairs of equal q-grams that a task holds at once

_TOKEN = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    return " ".join(_TOKEN.findall(text.lower()))


def budget(m: int) -> int:
    """Edits allowed for an item of m characters: as many as still leave the lemma a bound of 1."""
    return max(0, min(int(EDITS * m), (m - Q) // Q))


def _hashes(text: str, roll: Rolling) -> np.ndarray:
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return mix(roll.fixed(roll.sums(mix(x + np.uint64(1))), Q))


def align(item: str, text: str, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of item in text with at most `most` edits.

    A row of the table holds only the diagonals that such a place can use: `most` to either side of those on
    which the item fits into the text.
    """
    at = text.find(item)
    if at >= 0:
        return 0, at, at + len(item)
    a, b = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (item, text))
    m, n = len(a), len(b)
    width = n - m + 2 * most + 1
    if width <= 0:
        return None
    never, big = 1 << 30, m + n + 2
    steps = np.arange(width)
    place = steps - most  # in the text, of each diagonal's cell in the row before the item's first character
    chars = np.full(m + width + most, -1, np.int64)
    chars[most : most + n] = b
    cost, begin = np.where((place >= 0) & (place <= n), 0, never), place.copy()
    for i, c in enumerate(a.tolist()):
        best, begin2 = cost + (chars[i : i + width] != c), begin.copy()
        less = cost[1:] + 1 < best[:-1]  # the character is missing in the text: from the diagonal to the right
        best[:-1][less] = cost[1:][less] + 1
        begin2[:-1][less] = begin[1:][less]
        best[place + i + 1 > n] = never
        # more characters in the text: running minimum along the row
        key = (best - steps) * big + steps
        from_ = np.minimum.accumulate(key) % big
        cost, begin = np.minimum(best[from_] + steps - from_, never), begin2[from_]
        cost[place + i + 1 > n] = never
        if cost.min() > most:
            return None
    end = int(np.argmin(cost))
    return int(cost[end]), int(begin[end]), int(place[end]) + m


class Index:
    """q-grams of the benchmark items: hash -> (item, place)."""

    def __init__(self, items: list[tuple[int | None, str]]) -> None:
        roll = Rolling()
        self.items = [(i, t) for i, t in ((i, plain(t)) for i, t in items) if len(t) >= Q]
        found = [_hashes(t, roll) for _, t in self.items]
        h = np.concatenate(found) if found else np.zeros(0, np.uint64)
        item, place = np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate([np.arange(len(f)) for f in found]) if found else np.zeros(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.item, self.place = item[order].astype(np.int32), place[order].astype(np.int32)
        self.grams, self.first, self.n = np.unique(h[order], return_index=True, return_counts=True)
        self.edits = np.array([budget(len(t)) for _, t in self.items], np.int64)
        self.need = np.array([len(t) + 1 - Q - Q * budget(len(t)) for _, t in self.items], np.int64)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self.grams >> np.uint64(42)] = True

    def regions(self, text: str, roll: Rolling):
        """(item, first place, last place) of the bands of diagonals that reach an item's bound.

        Pairs of equal q-grams are made for at most PAIRS of them at once. An item with more has few different
        q-grams in this text; there each of its places counts the text's places in each band instead.
        """
        h = _hashes(text, roll)
        at = np.flatnonzero(self.seen[h >> np.uint64(42)])
        if not len(at):
            return
        k = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
        hit = self.grams[k] == h[at]
        order = np.argsort(k[hit], kind="stable")
        at, k = at[hit][order], k[hit][order]  # the text's places by q-gram
        if not len(at):
            return
        gram, begin, times = np.unique(k, return_index=True, return_counts=True)
        n = self.n[gram]
        slot = np.repeat(self.first[gram] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        order = np.argsort(self.item[slot], kind="stable")
        slot, which = slot[order], np.repeat(np.arange(len(gram)), n)[order]  # the items' places of those q-grams, by item
        items, starts = np.unique(self.item[slot], return_index=True)
        pairs = np.add.reduceat(times[which], starts)
        ends, done = np.append(starts, len(slot)), 0
        while done < len(items):
            stop = max(done + 1, int(np.searchsorted(np.cumsum(pairs[done:]), PAIRS, "right")) + done)
            part = slice(ends[done], ends[stop])
            if pairs[done] > PAIRS:
                yield from self._bands_by_places(int(items[done]), self.place[slot[part]], which[part], at, np.append(begin, len(at)), len(text))
            else:
                t = times[which[part]]
                mine = np.repeat(begin[which[part]] - (np.cumsum(t) - t), t) + np.arange(t.sum())
                yield from self._bands_by_pairs(np.repeat(self.item[slot[part]].astype(np.int64), t), at[mine] - np.repeat(self.place[slot[part]], t))
            done = stop

    def _bands_by_pairs(self, item: np.ndarray, diagonal: np.ndarray):
        width = 2 * self.edits[item] + 1
        for shift in (0, 1):
            band = (diagonal + shift * (self.edits[item] + 1)) // width
            band -= band.min()
            key = item * (band.max() + 1) + band
            order = np.argsort(key, kind="stable")
            starts = np.flatnonzero(np.diff(key[order], prepend=-1))
            count = np.diff(np.append(starts, len(key)))
            owner, least, most = item[order][starts], np.minimum.reduceat(diagonal[order], starts), np.maximum.reduceat(diagonal[order], starts)
            for g in np.flatnonzero(count >= self.need[owner]).tolist():
                yield int(owner[g]), int(least[g]), int(most[g])

    def _bands_by_places(self, item: int, place: np.ndarray, which: np.ndarray, at: np.ndarray, begin: np.ndarray, size: int):
        """The same for one item: place, which: its places and their q-grams, whose places in the text are at[begin[which] : begin[which + 1]]."""
        e = int(self.edits[item])
        width, far = 2 * e + 1, size + 1
        keys = np.repeat(np.arange(len(begin) - 1), np.diff(begin)) * far + at  # the text's places, ascending within and across q-grams
        low, high = int((at[begin[which]] - place).min()), int((at[begin[which + 1] - 1] - place).max())
        step = max(1, PAIRS // len(place))
        for shift in (0, 1):
            bands = range((low + shift * (e + 1)) // width, (high + shift * (e + 1)) // width + 1)
            for b in bands[::step]:
                edge = width * np.arange(b, min(b + step, bands.stop) + 1) - shift * (e + 1)
                wanted = np.clip(edge[:, None] + place.astype(np.int64), 0, far - 1) + which * far
                cut = np.searchsorted(keys, wanted)
                count = np.diff(cut, axis=0)
                first = np.where(count > 0, at[np.minimum(cut[:-1], len(at) - 1)] - place, far).min(axis=1)
                last = np.where(count > 0, at[cut[1:] - 1] - place, -far - size).max(axis=1)
                for g in np.flatnonzero(count.sum(axis=1) >= self.need[item]).tolist():
                    yield item, int(first[g]), int(last[g])

    def matches(self, text: str, roll: Rolling) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, edits) in the plain text, each place once."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for i, cost, s, end in self.verified(text, roll):
            best[i, end] = min(best.get((i, end), (cost, s)), (cost, s))
        return [(self.items[i][0], s, end, cost) for (i, end), (cost, s) in sorted(best.items())]

    def verified(self, text: str, roll: Rolling):
        """(item, edits, start, end) of the regions that hold their item."""
        for i, low, high in self.regions(text, roll):
            item, e = self.items[i][1], int(self.edits[i])
            a, b = max(0, low - e), min(len(text), high + len(item) + e)
            if found := align(item, text[a:b], e):
                yield i, found[0], a + found[1], a + found[2]


def _search(index: Index):
    def run(batches):
        roll = Rolling()
        for batch in batches:
            out: dict = {k: [] for k in ("doc_id", "item_id", "start", "end", "edits")}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = index.matches(plain(text), roll)
                if found:
                    begin, stop = {}, {}  # from places in the plain text to places in the text
                    n = 0
                    for m in _TOKEN.finditer(text):
                        w = len(m[0].lower())
                        begin[n], stop[n + w] = m.start(), m.end()
                        n += w + 1
                    begins, stops = np.array(sorted(begin)), np.array(sorted(stop))
                for item, s, e, cost in found:
                    s0 = begin[int(begins[max(0, np.searchsorted(begins, s, "right") - 1)])]
                    e0 = stop[int(stops[min(len(stops) - 1, np.searchsorted(stops, e))])]
                    for k, v in zip(out, (doc, item, s0, e0, cost), strict=True):
                        out[k].append(v)
            yield pa.record_batch([pa.array(v, pa.int64()) for v in out.values()], names=list(out))

    return run


def indexes(benchmark: DataFrame):
    """The benchmark's items in as many indexes as bounded parts are needed; each is one pass over the documents."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    passes = -(-int(size) // BLOCK_CHARS) or 1
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == k).orderBy("item_id", "text").toArrow()
        yield Index(list(zip(*(part.column(c).to_pylist() for c in ("item_id", "text")), strict=True)))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per place where a benchmark item occurs in a document: doc_id, item_id, start, end, edits.

    start and end are code points of the text, widened to whole words. Rows are judged one by one: a
    repeated row repeats its matches, a null id is given back as null. Null texts are empty, texts of any
    length are searched whole; of places that end alike the one of fewest edits, then the earliest start,
    stands. Items of fewer than q plain characters, and null items, match nothing; items repeated under other
    ids match under each. An empty table on either side gives none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    out = None
    for index in indexes(benchmark):
        found = docs.mapInArrow(_search(index), "doc_id long, item_id long, start long, end long, edits long")
        out = found if out is None else out.unionByName(found)
    return out


def op4(spark, sf_dir: str) -> DataFrame:
    return find_leaks(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text holds a benchmark item; all columns pass through as they are.

    Rows are judged by their own text, whatever their ids; see `find_leaks` for odd rows.
    """
    at = [c.lower() for c in docs.columns].index("text")

    def clean(index: Index):
        def run(batches):
            let_go()
            roll = Rolling()
            for batch in batches:
                yield batch.filter(pa.array([next(index.verified(plain(t or ""), roll), None) is None for t in batch.column(at).to_pylist()], pa.bool_()))

        return run

    for index in indexes(benchmark):
        docs = docs.mapInArrow(clean(index), docs.schema)
    return docs
