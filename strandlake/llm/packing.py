"""Packing: sequences of at most `window` tokens whose pieces are lexical neighbours.

1. Tasks encode whole texts. Full windows of a long document are sequences of their own; the rest of each
   document is a piece to pack. Token document frequencies are counted over all pieces of the corpus (as
   many numbers as the vocabulary has ids, however large the corpus).
2. Pieces are range-partitioned by their heaviest BM25 terms, then id, with splitters that Spark samples:
   pieces with the same heavy terms meet, and a term that fills the corpus is cut by id.
3. Each partition is worked off in shards. A shard's BM25 inverted index returns the unused neighbours of a
   seed, by all its terms, which fill its window in order of score. The piece that crosses the end is cut; what is left of it
   seeds the next window. Only a partition's last window isn't full: it is cut at powers of two, which
   need no padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import NULL_ID, give_back, let_go, pack, unpack, written
from .tokens import Encoder

SHARD = 1024  # pieces that one inverted index holds
K1, B = 1.2, 0.75

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, ids binary, terms binary, counts binary"
_RESULT = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _encode(path: str, end_id: int, window: int, vocabulary: int):
    def run(batches):
        from pyspark import TaskContext

        coder, n_seq, base = Encoder.kept(path, drops_space=True), 0, 1 << 62 | TaskContext.get().partitionId() << 32
        end, counts = np.array([end_id], "<u2").tobytes(), np.zeros(vocabulary, np.int64)
        names = [c.split()[0] for c in _PIECES.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for doc, data in zip(batch.column(0).to_pylist(), coder.ids(batch.column(1).to_pylist()), strict=True):
                ids = np.frombuffer(data + end, "<u2")
                for at in range(0, len(ids), window):
                    part = ids[at : at + window]
                    term, n = np.unique(part, return_counts=True)
                    counts[term] += 1
                    full = len(part) == window
                    kept = (_crc(part), len(ids), base + n_seq, None, None) if full else (None, len(ids), None, part.tobytes(), term.tobytes() + n.astype("<u2").tobytes())
                    rows.append((doc, at, len(part), *kept, None))
                    n_seq += full
            yield _rows(rows, names)
        used = np.flatnonzero(counts)
        yield _rows([(*[None] * (len(names) - 1), pack(used, counts[used]))], names)

    return run


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.record_batch([pa.array(c, pa.binary() if n in ("ids", "terms", "counts") else pa.int64()) for c, n in zip(columns, names, strict=True)], names=names)


def _spread(batches):
    for batch in batches:
        parts = [unpack(c) for c in batch.column(0).to_pylist()]
        if parts:
            term, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.record_batch([pa.array(term, pa.int32()), pa.array(n, pa.int64())], names=["term", "n"])


def weights(terms: bytes, idf: np.ndarray, average: float) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of a piece and their BM25 weights; terms: the ids, then how often each occurs, in 16 bits."""
    term, n = np.frombuffer(terms, "<u2").reshape(2, -1)
    return term, idf[term] * n * (K1 + 1) / (n + K1 * (1 - B + B * int(n.sum()) / average))


def _heaviest(idf: np.ndarray, average: float):
    def run(batches):
        let_go()
        for batch in batches:
            keys = []
            for terms in batch.column("terms").to_pylist():
                term, w = weights(terms, idf, average)
                first = int(np.argmax(w))
                w[first] = -1
                keys.append((int(term[first]), int(term[np.argmax(w)])))
            k1, k2 = zip(*keys, strict=True) if keys else ((), ())
            yield pa.record_batch([pa.array(k1, pa.int32()), pa.array(k2, pa.int32()), *batch.columns], names=["key1", "key2", *batch.schema.names])

    return run


class Shard:
    """A BM25 inverted index over pieces; used pieces are masked."""

    def __init__(self, pieces: list[bytes], idf: np.ndarray, average: float) -> None:
        self.own = [weights(p, idf, average) for p in pieces]
        term = np.concatenate([t for t, _ in self.own])
        weight = np.concatenate([w for _, w in self.own])
        piece = np.repeat(np.arange(len(pieces)), [len(t) for t, _ in self.own])
        order = np.argsort(term, kind="stable")
        self.piece, self.weight = piece[order], weight[order]
        self.terms, self.first = np.unique(term[order], return_index=True)
        self.last = np.append(self.first[1:], len(term))
        self.slots = np.arange(len(term))
        self.unused = np.ones(len(pieces), bool)

    def neighbours(self, seed: int):
        """Unused pieces, best score first, then in order."""
        k = np.searchsorted(self.terms, self.own[seed][0])
        slots = np.concatenate([self.slots[a:b] for a, b in zip(self.first[k].tolist(), self.last[k].tolist(), strict=True)])
        score = np.bincount(self.piece[slots], self.weight[slots], len(self.unused))
        while True:
            best = int(np.argmax(np.where(self.unused, score, -1.0)))
            if not self.unused[best]:
                return
            yield best


def _fill(idf: np.ndarray, average: float, window: int):
    def run(batches):
        from pyspark import TaskContext

        base, n_seq = TaskContext.get().partitionId() << 32, 0
        open_: list[tuple] = []  # (piece, start in it, ids) of the window that isn't full yet
        room = window

        def close(rows: list, parts: list[tuple]) -> None:
            nonlocal n_seq
            at = 0
            for (doc, start, total), cut, ids in parts:
                rows.append((doc, start + cut, len(ids), _crc(ids), total, base + n_seq, at))
                at += len(ids)
            n_seq += 1

        def work(found: list[tuple]):
            nonlocal open_, room
            rows: list[tuple] = []
            left = [np.frombuffer(f[3], "<u2") for f in found]
            cut = [0] * len(found)
            index, seed = Shard([f[4] for f in found], idf, average), None
            while index.unused.any():
                if seed is None:
                    seed = int(np.argmax(index.unused))
                queue = [seed] if index.unused[seed] else []
                asked = index.neighbours(seed)
                while True:
                    k = queue.pop() if queue else next(asked, None)
                    if k is None:
                        break
                    part, left[k] = left[k][:room], left[k][room:]
                    open_.append((found[k][:3], cut[k], part))
                    cut[k] += len(part)
                    room -= len(part)
                    if not len(left[k]):
                        index.unused[k] = False
                    if not room:
                        close(rows, open_)
                        open_, room = [], window
                        seed = k if len(left[k]) else None
                        break
            return _rows(rows, list(_RESULT)) if rows else None

        held: list[tuple] = []
        for batch in batches:
            held += list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids", "terms")), strict=True))
            while len(held) >= SHARD:
                if (out := work(held[:SHARD])) is not None:
                    yield out
                held = held[SHARD:]
        if held and (out := work(held)) is not None:
            yield out
        rows: list[tuple] = []
        while open_:  # the last window: as sequences whose lengths are powers of two
            size, parts = 1 << (window - room).bit_length() - 1, []
            while size:
                piece, at, ids = open_.pop(0)
                parts.append((piece, at, ids[:size]))
                if len(ids) > size:
                    open_.insert(0, (piece, at + size, ids[size:]))
                size -= len(parts[-1][2])
                room += len(parts[-1][2])
            close(rows, parts)
        if rows:
            yield _rows(rows, list(_RESULT))

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer: path of a tokenizers file that ignores white space. Each document's ids, then end_id, are
    cut into pieces; a sequence's pieces stand without gaps from offset 0 and fill `window` tokens, but for
    lengths that are powers of two at the end of a partition. Null texts are empty: only end_id. Every row
    is a document of its own, also where ids repeat or are null. An empty table gives an empty result.
    """
    from tokenizers import Tokenizer

    vocabulary = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    coded = written(docs.mapInArrow(_encode(tokenizer, end_id, window, vocabulary), _PIECES))
    pieces = coded.where("counts is null")
    df = np.zeros(vocabulary, np.int64)
    for r in coded.where("counts is not null").select("counts").mapInArrow(_spread, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r.term] = r.n
    stats = pieces.agg(F.count("*").alias("n"), F.coalesce(F.avg("length"), F.lit(1.0)).alias("average")).first()
    idf = np.log1p((stats.n - df + 0.5) / (df + 0.5))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = pieces.where("ids is not null").select("doc_id", "start", "doc_tokens", "ids", "terms")
    # stored, as sampling the splitters and dealing out each read it
    keyed_ = written(rest.mapInArrow(_heaviest(idf, stats.average), "key1 int, key2 int, doc_id long, start long, doc_tokens long, ids binary, terms binary"))
    dealt = keyed_.repartitionByRange(parts, "key1", "key2", "doc_id")
    packed = dealt.sortWithinPartitions("key1", "key2", "doc_id", "start", "doc_tokens", "ids").mapInArrow(_fill(idf, stats.average, window), ", ".join(f"{c} long" for c in _RESULT))
    whole = pieces.where("ids is null").select(*_RESULT[:-1], F.lit(0).cast("long").alias("offset"))
    return give_back(whole.unionByName(packed))


def op1(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
