"""Suffix-array dedup: repeated strings of `length` bytes, found by sorting suffixes.

Sorting the suffix at every byte would shuffle a hundred times the corpus, so the suffix array is sparse:

1. Every `length`-byte window picks an *anchor*, its smallest `GRAM`-byte gram by hash (the leftmost on
   ties). Equal windows pick the same anchor at the same offset. Windows in a row with one anchor form a
   *segment*. Copies of a segment inside a task are decided there, byte by byte: all but the earliest are
   repeats. Of the others only a hash of the anchor gram moves, to count it: a gram that occurs once starts no
   suffix worth sorting.
2. The rest fetch their bytes. The suffixes at their anchors are range-partitioned by what they start with
   (then by the bytes before the anchor), with splitters that Spark samples; a gram that fills the corpus is
   cut by the bytes after it. Inside a bucket the suffixes of one gram form a run: equal segments are
   neighbours, and the windows of the different ones are sorted by multikey quicksort, so equal windows
   become neighbours too. All but the earliest are repeats.
3. A bucket's first and last run may go on across its boundary. Their windows meet those of the other
   buckets by 128-bit digests.
4. Repeated windows return to their documents and merge into maximal spans.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Rolling, buckets, by_bucket, by_row, doc_groups, fresh, group_column, let_go, merged, mix, numbered, pack, unpack, with_ids, written
from .substring_dedup import _batch, per_document, spans_out

GRAM = 32  # bytes of an anchor
BLOCK = 250_000  # segments of a block
PIECE = 1 << 20  # bytes hashed at once; a position must fit into 24 bits
SORTED = 1 << 16  # windows sorted at once, but for a run that has more

_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def segments(data: bytes, length: int, roll: Rolling) -> tuple[np.ndarray, ...]:
    """(gram hash, segment hash, first window, windows, bytes from there to the anchor) of each segment of a text."""
    out, w = [], length - GRAM + 1
    for at in range(0, max(1, len(data) - length + 1), PIECE):
        x = np.frombuffer(data, np.uint8, min(PIECE + length - 1, len(data) - at), at)
        if len(x) < length:
            break
        sums = roll.sums(_TABLE[x])
        grams = mix(roll.fixed(sums, GRAM))
        low = (grams & ~np.uint64(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while 2 * width <= w:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < w:
            low = np.minimum(low[: len(low) - (w - width)], low[w - width :])
        anchor = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        start = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
        n = np.diff(start, append=len(anchor))
        whole = mix(roll.ranges(sums, start, start + n - 1 + length) + n.astype(np.uint64))
        out.append((grams[anchor[start]], whole, start + at, n, anchor[start] - start))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    return tuple(map(np.concatenate, zip(*out, strict=True)))


# --- anchors that occur again --------------------------------------------------------------------


def _anchors(length: int, n_buckets: int):
    """Blocks by bucket: segments that were decided, and the grams of the others."""

    def send(found: list, texts: list[bytes]) -> pa.RecordBatch:
        gram, whole, at, n, ahead = (np.concatenate([f[i] for f in found]) for i in range(5))
        ids, text = (np.repeat([f[i] for f in found], [len(f[0]) for f in found]) for i in (5, 6))
        order = np.lexsort((at, ids, whole))
        maybe = np.flatnonzero(np.concatenate([[False], whole[order][1:] == whole[order][:-1]]))
        later = np.zeros(len(order), bool)
        first, source = np.maximum.accumulate(np.where(np.isin(np.arange(len(order)), maybe), 0, np.arange(len(order)))), text.tolist()
        starts, ends = at.tolist(), (at + n - 1 + length).tolist()
        for a, b in zip(order[first[maybe]].tolist(), order[maybe].tolist(), strict=True):
            # equal hashes only propose: the bytes decide
            later[b] = n[a] == n[b] and texts[source[a]][starts[a] : ends[a]] == texts[source[b]][starts[b] : ends[b]]
        rows, place = [], np.lexsort((at, ids))
        keep, done = place[~later[place]], place[later[place]]
        for b, part in by_bucket((gram[keep] >> np.uint64(20)) % np.uint64(n_buckets)):
            k = keep[part]
            rows.append((b, pack(gram[k], *_places(ids[k], at[k], n[k]), ahead[k].astype(np.uint8))))
        for b, part in by_bucket(ids[done] % n_buckets):  # decided: dealt out evenly
            k = done[part]
            rows.append((b, pack(np.zeros(0, np.uint64), *_places(ids[k], at[k], n[k]), np.zeros(0, np.uint8))))
        return _batch(rows)

    def run(batches):
        let_go()
        roll, found, texts, size = Rolling(), [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                s = segments(data, length, roll)
                if len(s[0]):
                    found.append((*s, doc, len(texts)))
                    texts.append(data)
                    size += len(s[0])
                if size >= BLOCK:
                    yield send(found, texts)
                    found, texts, size = [], [], 0
        if found:
            yield send(found, texts)

    return run


def _places(doc: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    return np.diff(doc, prepend=np.int64(0)), at.astype(np.int64), n.astype(np.uint8 if not len(n) or n.max() < 256 else np.uint32)


def _again(groups: int):
    """Of one bucket, by group of documents: decided segments (ahead -1), and those whose gram occurs again."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        parts = [unpack(p) for p in table.column("payload").to_pylist()]
        sure, open_ = [p for p in parts if not len(p[0])], [p for p in parts if len(p[0])]
        doc, at, n = (np.concatenate([p[i].astype(np.int64) if i > 1 else np.cumsum(p[1]) for p in (*sure, *open_)]) for i in (1, 2, 3))
        ahead = np.concatenate([*[np.full(len(p[2]), -1, np.int8) for p in sure], *[p[4].astype(np.int8) for p in open_]])
        keep = np.ones(len(doc), bool)
        if open_:
            gram = np.concatenate([p[0] for p in open_])
            _, back, many = np.unique(gram, return_inverse=True, return_counts=True)
            keep[len(keep) - len(gram) :] = many[back] > 1
        return spans_out(doc[keep], at[keep], groups, n[keep], ahead[keep])

    return run


_SUFFIX = "suffix binary, before binary, doc_id long, start long, n long"


def _fetch(length: int):
    """The bytes of the segments that are to be sorted: from the anchor on, and those before it."""

    def run(key: tuple, blocks: pa.Table, docs: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [], [])
        for doc, text, (start, n, ahead) in per_document(blocks, docs, 4):
            open_ = np.flatnonzero(ahead >= 0)
            if not len(open_):
                continue
            data, start, n, ahead = text.encode("utf-8", "surrogatepass"), start[open_], n[open_], ahead[open_].astype(np.int64)
            for a, p, e in zip(start.tolist(), (start + ahead).tolist(), (start + n - 1 + length).tolist(), strict=True):
                out[0].append(data[p:e])
                out[1].append(data[a:p])
            out[2].append(np.full(len(start), doc))
            out[3].append(start)
            out[4].append(n)
        longs = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out[2:]]
        return pa.Table.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), *longs], names=["suffix", "before", "doc_id", "start", "n"])

    return run


# --- sorting in a bucket -------------------------------------------------------------------------


def multikey_quicksort(word, n: int, depth: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group in that order) of n strings of `depth` words; word(items, j) gives the j-th words.

    group: ascending numbers; only strings of one number are compared. All parts are split in one go, each by
    its own pivot into less, equal and greater; the equal part goes on with the next word.
    """
    order, new = np.arange(n), np.concatenate([[True], group[1:] != group[:-1]]) if n else np.zeros(0, bool)
    level = np.zeros(n, np.int64)  # words that the part at that place has in common
    active = np.arange(n)  # places whose part is still to be split
    while True:
        first = np.flatnonzero(new[active])  # parts start where `new` says so
        size = np.diff(first, append=len(active))
        part = np.repeat(np.arange(len(first)), size)
        live = ((size > 1) & (level[active[first]] < depth))[part]
        if not live.any():
            return order, np.cumsum(new)
        active, part = active[live], part[live]
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        size = np.diff(first, append=len(active))
        part = np.repeat(np.arange(len(first)), size)
        item, at = order[active], level[active]
        value = word(item, at)
        pivot = value[first + size // 2][part]
        side = np.where(value < pivot, 0, np.where(value == pivot, 1, 2))
        # stable split: how many of each side there are, and the rank among them
        where = np.empty(len(active), np.int64)
        begin = first.copy()
        starts = []
        for s in (0, 1, 2):
            mine = side == s
            rank = np.cumsum(mine)
            base = rank[first] - mine[first]
            where[mine] = (begin[part] + rank - 1 - base[part])[mine]
            count = np.add.reduceat(mine, first, dtype=np.int64)
            starts.append(begin[count > 0])
            begin = begin + count
        order[active[where]] = item
        level[active[where]] = at + (side == 1)
        new[active[np.concatenate(starts)]] = True


def _words(data: bytes, length: int) -> np.ndarray:
    """At each byte the next eight as a big-endian number."""
    x = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint64)
    out = np.zeros(len(x) - 7, np.uint64)
    for i in range(8):
        out = out << np.uint64(8) | x[i : len(x) - 7 + i]
    return out


class _Run:
    """Segments of one gram, in order of suffix and bytes before: the different ones, and the earliest place of each."""

    def __init__(self) -> None:
        self.data: list[bytes] = []
        self.ahead: list[int] = []
        self.place: list[tuple[int, int, int]] = []  # doc_id, start, n


def _sorted_windows(runs: list[_Run], length: int) -> tuple[np.ndarray, ...]:
    """(run, doc, start, byte position, equal group) of all windows of the runs, equal ones side by side; and their bytes."""
    data = b"".join(d for r in runs for d in r.data)
    size = np.array([len(d) for r in runs for d in r.data])
    run = np.repeat(np.arange(len(runs)), [len(r.data) for r in runs])
    doc, start, n = np.array([p for r in runs for p in r.place], np.int64).reshape(-1, 3).T
    ahead = np.array([a for r in runs for a in r.ahead])
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    run, doc, start, ahead = np.repeat(run, n), np.repeat(doc, n), np.repeat(start, n) + within, np.repeat(ahead, n) - within
    at = np.repeat(np.cumsum(size) - size, n) + within
    key = run * (2 * length) + ahead  # equal windows have their anchor at one offset
    first = np.argsort(key, kind="stable")
    words = _words(data, length)
    offset = np.minimum(np.arange(-(-length // 8)) * 8, length - 8)
    pos = at[first]
    order, group = multikey_quicksort(lambda item, j: words[pos[item] + offset[j]], len(pos), len(offset), key[first])
    order = first[order]
    return run[order], doc[order], start[order], at[order], group, data


def _compare(length: int, groups: int):
    """Rows come sorted by suffix, then by what is before it. Blocks: repeats by group of documents, edges by digest."""

    def repeats(runs: list[_Run], edges: set[int]):
        run, doc, start, at, group, data = _sorted_windows(runs, length)
        place = np.lexsort((start, doc, group))
        later = np.concatenate([[False], group[place][1:] == group[place][:-1]]) if len(place) else np.zeros(0, bool)
        late = place[later]
        found = [(doc[late], start[late], np.ones(len(late), np.int64))]
        edge = place[~later]
        edge = edge[np.isin(run[edge], list(edges))] if edges else edge[:0]
        digest = np.frombuffer(b"".join(hashlib.blake2b(data[a : a + length], digest_size=16).digest() for a in at[edge].tolist()), np.uint64).reshape(-1, 2)
        return found, (digest[:, 0], digest[:, 1], doc[edge], start[edge])

    def run(batches):
        let_go()
        decided: list[tuple] = []
        edges: list[tuple] = []
        held: list[_Run] = []
        size, gram, last, number, outer = 0, None, None, 0, set()

        def work() -> None:
            nonlocal held, size, outer
            # a run of one segment has nothing to compare, unless it may go on in the next bucket
            chosen = [(i, r) for i, r in enumerate(held) if len(r.data) > 1 or i in outer]
            if chosen:
                found, edge = repeats([r for _, r in chosen], {j for j, (i, _) in enumerate(chosen) if i in outer})
                decided.extend(found)
                edges.append(edge)
            held, size, outer = [], 0, set()

        for batch in batches:
            for suffix, before, doc, start, n in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if suffix[:GRAM] != gram:
                    if size >= SORTED:
                        work()
                    if number == 0:
                        outer.add(0)  # the bucket's first run
                    gram, last, number = suffix[:GRAM], None, number + 1
                    held.append(_Run())
                if (suffix, before) == last:  # a copy of the segment before, which is earlier
                    decided.append((np.array([doc]), np.array([start]), np.array([n])))
                    continue
                last = suffix, before
                held[-1].data.append(before + suffix)
                held[-1].ahead.append(len(before))
                held[-1].place.append((doc, start, n))
                size += n
        if held:
            outer.add(len(held) - 1)
            work()
        rows = []
        if decided:
            doc, start, n = map(np.concatenate, zip(*decided, strict=True))
            rows += [(False, g, p) for g, p in _as_rows(spans_out(doc, start, groups, n, np.full(len(doc), -1, np.int8)))]
        if edges:
            a, b, doc, start = map(np.concatenate, zip(*edges, strict=True))
            for g, part in by_bucket(a % np.uint64(groups)):
                rows.append((True, g, pack(a[part], b[part], doc[part], start[part])))
        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.bool_(), pa.int32(), pa.binary()))], names=["edge", "grp", "payload"])

    return run


def _as_rows(table: pa.Table):
    return zip(*(table.column(i).to_pylist() for i in range(2)), strict=True)


def _across(groups: int):
    """Windows of runs at the edges of buckets: all but the earliest of equal ones."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        a, b, doc, start = map(np.concatenate, zip(*map(unpack, table.column("payload").to_pylist()), strict=True))
        order = np.lexsort((start, doc, b, a))
        a, b = a[order], b[order]
        late = order[np.concatenate([[False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])])]
        return spans_out(doc[late], start[late], groups, np.ones(len(late), np.int64), np.full(len(late), -1, np.int8))

    return run


def _repeats(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(documents with their group, blocks of ranges of repeated windows by group) of (doc_id, text) with unique ids."""
    spark = docs.sparkSession
    groups = doc_groups(spark)
    grouped = docs.withColumn("grp", group_column(groups))
    sent = docs.mapInArrow(_anchors(length, buckets(spark)), "bucket int, payload binary")
    settled = written(sent.groupBy("bucket").applyInArrow(_again(groups), "grp int, payload binary"))
    suffixes = written(settled.groupBy("grp").cogroup(grouped.groupBy("grp")).applyInArrow(_fetch(length), _SUFFIX))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = suffixes.repartitionByRange(parts, "suffix", "before").sortWithinPartitions("suffix", "before", "doc_id", "start")
    compared = written(ranged.mapInArrow(_compare(length, groups), "edge boolean, grp int, payload binary"))
    across = compared.where("edge").groupBy("grp").applyInArrow(_across(groups), "grp int, payload binary")
    return grouped, settled.unionByName(compared.where("not edge").select("grp", "payload")).unionByName(across)


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """Removes every byte that a `length`-byte string covers which also starts earlier.

    Earlier means in a document of smaller id, or before in the same one. Texts count as UTF-8, whole; matches
    don't cross documents and are judged on the input. Returns one row per row of docs: doc_id, n_bytes, spans
    (array of struct start, end: maximal runs of removed bytes), kept (binary). Null texts are empty; texts
    shorter than `length` stay. Rows that share an id, or have none, are documents of their own in the order
    of their texts, null ids first. An empty table gives none.
    """
    if length < 2 * GRAM or length > 128:
        raise ValueError(f"length must be from {2 * GRAM} to 128")
    rows, ids = by_row(docs)
    grouped, blocks = _repeats(rows, length)

    def cut(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict = {"doc_id": [], "n_bytes": [], "spans": [], "kept": []}
        for doc, text, (start, size, ahead) in per_document(left, right, 4):
            data, sure = text.encode("utf-8", "surrogatepass"), ahead < 0
            s, e = merged(start[sure], start[sure] + size[sure] - 1 + length)
            kept, at, spans = [], 0, []
            for a, b in zip(s.tolist(), e.tolist(), strict=True):
                kept.append(data[at:a])
                spans.append({"start": a, "end": b})
                at = b
            for k, v in zip(out, (doc, len(data), spans, b"".join([*kept, data[at:]])), strict=True):
                out[k].append(v)
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        return pa.table(out, schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary())]))

    both = blocks.groupBy("grp").cogroup(grouped.groupBy("grp")).applyInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
    return with_ids(both, ids)


def op3(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """docs with the repeated bytes cut from their texts, whole characters only; n_chars follows.

    A character of which a removed span holds a part stays. Every row stays, if perhaps empty, and keeps its
    other columns; ids that repeat or are null: see `remove_repeats`.
    """
    rows, key, _ = numbered(docs)
    texts = rows.select(F.col(key).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    spans = remove_repeats(texts, length).where("size(spans) > 0").select(F.col("doc_id").alias(key), F.col("spans").alias("_spans"))

    def run(batches):
        let_go()
        for batch in batches:
            cut_texts = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data, at, kept = text.encode("utf-8", "surrogatepass"), 0, []
                for s in spans:
                    a, b = s["start"], s["end"]
                    while a < b and data[a] & 0xC0 == 0x80:
                        a += 1
                    while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                        b -= 1
                    kept.append(data[at:a])
                    at = b
                cut_texts.append(b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass"))
            yield pa.record_batch([batch.column(0), pa.array(cut_texts, pa.string())], names=["_key", "_text"])

    with_spans = texts.withColumnRenamed("doc_id", "_key").join(spans.withColumnRenamed(key, "_key"), "_key", "left").select("_key", "text", F.coalesce("_spans", F.array()).alias("spans"))
    new = with_spans.mapInArrow(run, "_key long, _text string")
    name = fresh(rows, "_text")
    joined = rows.join(new.select(F.col("_key").alias(key), F.col("_text").alias(name)), key)
    values = {"text": F.col(name), "n_chars": F.length(name).cast("long")}
    return joined.select(*[values[c].alias(c) if c in values else F.col(f"`{c}`") for c in docs.columns])
