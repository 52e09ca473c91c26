"""Substring dedup: Rabin-Karp hashes of every window of so many words, counted over the corpus.

1. Each task hashes every window of its documents (a rolling hash over 64-bit word hashes). Windows that
   occur twice among a block of documents are decided there: one *witness* hash goes on instead of all
   occurrences, so a window that fills a third of the corpus costs one entry a block.
2. Hashes are dealt out in blocks by bucket; a bucket sorts its hashes and marks those with two entries or
   a witness.
3. The marks return to their documents, overlapping windows merge into maximal intervals, and the words
   inside them go.

Two different windows are taken for equal only if their 64-bit hashes are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Rolling, WordHashes, buckets, by_bucket, by_row, doc_groups, group_column, group_of, merged, mix, pack, unpack, with_ids

BLOCK = 1_500_000  # words of a block; bounds a task's memory


def _send(rows: list, n_buckets: int, hashes: list, ids: list, counts: list) -> None:
    """Adds one block's rows (bucket, payload): witnesses, open entries, decided starts."""
    if not hashes:
        return
    h, ids, counts = np.concatenate(hashes), np.array(ids, np.int64), np.array(counts)
    doc = np.repeat(np.arange(len(ids)), counts)
    at = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
    order = np.argsort(h, kind="stable")
    same = np.concatenate([[False], h[order][1:] == h[order][:-1]]) if len(h) else np.zeros(0, bool)
    twice = np.zeros(len(h), bool)
    twice[order[same]] = True
    twice[order[:-1][same[1:]]] = True
    first = np.zeros(len(h), bool)
    first[order[~same]] = True
    once, witness = np.flatnonzero(~twice), h[np.flatnonzero(twice & first)]
    to = (h[once] >> np.uint64(20)) % np.uint64(n_buckets)
    wit = dict(by_bucket((witness >> np.uint64(20)) % np.uint64(n_buckets)))
    none = np.zeros(0, np.int64)
    for b, part in by_bucket(to):
        k = once[part]
        w = wit.pop(b, none)
        rows.append((b, _located(ids, doc[k], at[k]) + pack(h[k], witness[w])))
    for b, w in wit.items():
        rows.append((b, _located(ids, none, none) + pack(none.astype(np.uint64), witness[w])))
    k = np.flatnonzero(twice)
    if len(k):  # dealt out evenly: no hash is sent along, so any bucket will do
        for b, part in by_bucket(doc[k] % n_buckets):
            rows.append((b, _located(ids, doc[k[part]], at[k[part]]) + pack(none.astype(np.uint64), none.astype(np.uint64))))


def _located(ids: np.ndarray, doc: np.ndarray, at: np.ndarray) -> bytes:
    """Documents and starts of entries in document order: ids and starts as steps."""
    cut = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1]) if len(doc) else np.zeros(0, np.int64)
    return pack(np.diff(ids[doc[cut]], prepend=np.int64(0)), np.diff(cut, append=len(doc)).astype(np.uint32), np.diff(at, prepend=0).astype(np.int32))


def _entries(arrays: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    ids, counts, at = arrays
    return np.repeat(np.cumsum(ids), counts), np.cumsum(at, dtype=np.int64)


def _windows(width: int, n_buckets: int):
    def run(batches):
        words, roll = WordHashes(), Rolling()
        hashes, ids, counts, size, rows = [], [], [], 0, []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = text.encode("utf-8", "surrogatepass").split()  # bytes: only ASCII white space parts words
                if len(found) >= width:
                    hashes.append(mix(roll.fixed(roll.sums(words.of(found)), width)))
                    ids.append(doc)
                    counts.append(len(hashes[-1]))
                    size += counts[-1]
                if size >= BLOCK:
                    _send(rows, n_buckets, hashes, ids, counts)
                    hashes, ids, counts, size = [], [], [], 0
                    yield _batch(rows)
                    rows = []
        _send(rows, n_buckets, hashes, ids, counts)
        if rows:
            yield _batch(rows)

    return run


def _batch(rows: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "payload"])


def _count(groups: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        parts = [unpack(p) for p in table.column("payload").to_pylist()]
        docs, starts = map(np.concatenate, zip(*(_entries(p[:3]) for p in parts), strict=True))
        h = np.concatenate([p[3] for p in parts])
        owner = np.concatenate([np.full(len(p[3]), len(p[3]) > 0) for p in parts]) if len(h) else np.zeros(0, bool)
        open_ = np.concatenate([np.full(len(p[2]), len(p[3]) > 0) for p in parts])  # the rest was decided
        _, back, n = np.unique(h, return_inverse=True, return_counts=True)
        marked = (n[back] > 1) | np.isin(h, np.concatenate([p[4] for p in parts]))
        keep = ~open_
        keep[np.flatnonzero(open_)] = marked
        assert owner.all()
        return spans_out(docs[keep], starts[keep], groups)

    return run


def spans_out(docs: np.ndarray, starts: np.ndarray, groups: int, *more: np.ndarray) -> pa.Table:
    """Decided ranges as blocks, one for each group of documents."""
    rows = []
    for g, part in by_bucket(group_of(docs, groups)):
        rows.append((g, pack(docs[part], starts[part], *(m[part] for m in more))))
    return pa.Table.from_batches([pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["grp", "payload"])])


def repeated_windows(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame, int]:
    """(documents with their group, blocks of repeated windows by group, number of groups) of (doc_id, text) with unique ids."""
    spark = docs.sparkSession
    n, groups = buckets(spark), doc_groups(spark)
    sent = docs.mapInArrow(_windows(width, n), "bucket int, payload binary")
    marks = sent.groupBy("bucket").applyInArrow(_count(groups), "grp int, payload binary")
    return docs.withColumn("grp", group_column(groups)), marks, groups


def per_document(starts_of: pa.Table, docs: pa.Table, width: int = 2):
    """For each row of docs: (doc_id, text, its arrays of ranges)."""
    parts = [unpack(p) for p in starts_of.column("payload").to_pylist()]
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * width
    order = np.argsort(columns[0], kind="stable")
    columns = [c[order] for c in columns]
    ids = docs.column("doc_id").to_numpy()
    low, high = np.searchsorted(columns[0], ids, "left"), np.searchsorted(columns[0], ids, "right")
    for i, (doc, text) in enumerate(zip(ids.tolist(), docs.column("text").to_pylist(), strict=True)):
        yield doc, text, [c[low[i] : high[i]] for c in columns[1:]]


def remove_repeats(docs: DataFrame, width: int = 35) -> DataFrame:
    """Removes every word that a repeated window of `width` words covers.

    Returns doc_id, n_words, n_removed, spans (array of struct start, end: maximal runs of removed words),
    kept (the words left, joined by one space), one row per row of docs. Null or empty texts have no words.
    Windows are judged on the input; all copies go, the first too. Documents shorter than a window stay
    whole. Rows that share an id are documents of their own; an empty table gives an empty result.
    """
    rows, ids = by_row(docs)
    docs, marks, _ = repeated_windows(rows, width)

    def cut(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"doc_id": [], "n_words": [], "n_removed": [], "spans": [], "kept": []}
        for doc, text, (start, *_) in per_document(right, left):
            words = text.encode("utf-8", "surrogatepass").split()
            s, e = merged(start, start + width)
            kept, at = [], 0
            for a, b in zip(s.tolist(), e.tolist(), strict=True):
                kept += words[at:a]
                at = b
            kept += words[at:]
            out["doc_id"].append(doc)
            out["n_words"].append(len(words))
            out["n_removed"].append(int((e - s).sum()))
            out["spans"].append([{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist(), strict=True)])
            out["kept"].append(b" ".join(kept).decode("utf-8", "surrogatepass"))
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        return pa.table(out, schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.string())]))

    both = docs.groupBy("grp").cogroup(marks.groupBy("grp")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept string")
    return with_ids(both, ids)


def op9(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
