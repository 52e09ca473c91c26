"""Token-id output as wavelet matrices: a shard's ids as succinct bit-planes with rank and select.

A table of token files is a Parquet folder with one row per shard: its documents' ids and lengths, and the
wavelet matrix of all their tokens, each plane compressed. Spark's committer writes the shards, so a lost
task leaves nothing behind; any shard alone supports access, counting and lookup of occurrences.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import NULL_ID, give_back, let_go, pack, shared_dir, unpack
from .tokens import Encoder

SHARD = 2_000_000  # tokens of a shard, but for the document that crosses it
LEVELS = 16
STEP = 512  # bits between rank samples

_FILE = "part long, seq long, n_docs long, n_tokens long, docs binary, matrix binary"


class WaveletMatrix:
    """planes[l]: bit LEVELS-1-l of the ids, in the order that the planes before it have sorted them into."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]) -> None:
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        x, planes, zeros, ranks = ids.astype(np.uint16), [], [], []
        for level in range(LEVELS - 1, -1, -1):
            bit = (x & np.uint16(1 << level)) != 0
            planes.append(np.packbits(bit, bitorder="little"))
            padded = np.zeros(-(-len(x) // STEP) * STEP // 8, np.uint8)
            padded[: len(planes[-1])] = planes[-1]
            sums = np.bitwise_count(padded.view(np.uint64)).reshape(-1, STEP // 64).sum(1)
            ranks.append(np.concatenate([[0], np.cumsum(sums)]).astype(np.uint32))
            zeros.append(len(x) - int(ranks[-1][-1]))
            ones = np.compress(bit, x)
            x = np.concatenate([np.compress(np.logical_not(bit, out=bit), x), ones])
        return cls(len(ids), planes, zeros, ranks)

    def to_bytes(self) -> bytes:
        z, out = zstandard.ZstdCompressor(level=1), [struct.pack("<Q", self.n)]
        for plane, zero, rank in zip(self.planes, self.zeros, self.ranks, strict=True):
            for data in (plane.tobytes(), rank.tobytes()):
                data = z.compress(data)
                out += [struct.pack("<QI", zero, len(data)), data]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        z, (n,), at, parts, zeros = zstandard.ZstdDecompressor(), struct.unpack_from("<Q", data), 8, [], []
        while at < len(data):
            zero, size = struct.unpack_from("<QI", data, at)
            parts.append(z.decompress(data[at + 12 : at + 12 + size]))
            zeros.append(zero)
            at += 12 + size
        return cls(n, [np.frombuffer(p, np.uint8) for p in parts[0::2]], zeros[0::2], [np.frombuffer(p, "<u4") for p in parts[1::2]])

    def _bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level], count=self.n, bitorder="little").astype(bool)

    def _ones(self, level: int, i: int) -> int:
        """Ones before place i."""
        block = i // STEP
        part = np.unpackbits(self.planes[level][block * STEP // 8 : -(-i // 8)], bitorder="little")[: i - block * STEP]
        return int(self.ranks[level][block]) + int(part.sum())

    def ids(self) -> np.ndarray:
        """All ids, by undoing the planes from the last to the first."""
        x = np.zeros(self.n, np.uint16)
        for level in range(LEVELS - 1, -1, -1):
            bit, y = self._bits(level), np.empty(self.n, np.uint16)
            y[~bit] = x[: self.zeros[level]]
            y[bit] = x[self.zeros[level] :] | np.uint16(1 << LEVELS - 1 - level)
            x = y
        return x

    def access(self, i: int) -> int:
        out = 0
        for level in range(LEVELS):
            bit = int(self.planes[level][i >> 3]) >> (i & 7) & 1
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        for level in range(LEVELS):
            a, b = self._ones(level, low), self._ones(level, high)
            low, high = (self.zeros[level] + a, self.zeros[level] + b) if token >> LEVELS - 1 - level & 1 else (low - a, high - b)
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of a token among the places low to high."""
        a, b = self._range(token, low, self.n if high is None else high)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence (from 0); IndexError if there are fewer."""
        low, high = self._range(token, 0, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        i = low + k
        for level in range(LEVELS - 1, -1, -1):
            if token >> LEVELS - 1 - level & 1:
                i = self._place(level, i - self.zeros[level], 1)
            else:
                i = self._place(level, i, 0)
        return i

    def _place(self, level: int, k: int, bit: int) -> int:
        """Place of the k-th such bit of a plane: a search of the rank samples, then of one block."""
        samples = self.ranks[level].astype(np.int64)
        if not bit:
            samples = np.minimum(np.arange(len(samples)) * STEP, self.n) - samples
        block = int(np.searchsorted(samples, k, "right")) - 1
        part = np.unpackbits(self.planes[level][block * STEP // 8 : (block + 1) * STEP // 8], bitorder="little")[: self.n - block * STEP]
        return block * STEP + int(np.flatnonzero(part == bit)[k - int(samples[block])])


def _shards(path: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        coder, part, seq = Encoder.kept(path, drops_space=False), TaskContext.get().partitionId(), 0
        end, docs, lengths, data, size = np.array([end_id], "<u2").tobytes(), [], [], [], 0

        def shard() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(data), "<u2")
            row = (part, seq, len(docs), len(ids), pack(np.array(docs, np.int64), np.array(lengths, np.int64)), WaveletMatrix.of(ids).to_bytes())
            return pa.record_batch([pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for v in row], names=[c.split()[0] for c in _FILE.split(", ")])

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 2048):
                for doc, ids in zip(batch.column(0)[at : at + 2048].to_pylist(), coder.ids(texts[at : at + 2048]), strict=True):
                    docs.append(doc)
                    data.append(ids + end)
                    lengths.append(len(data[-1]) // 2)
                    size += lengths[-1]
                    if size >= SHARD:
                        yield shard()
                        docs, lengths, data, size, seq = [], [], [], 0, seq + 1
        if docs:
            yield shard()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Encodes whole texts, appends end_id to each and writes them in ascending doc_id order as shards.

    Null texts are empty: only end_id. A null doc_id comes first; rows of one doc_id follow each other in
    the order of their texts, each a document of its own. An empty table gives an empty folder. `tokenizer`
    is a file of the tokenizers library whose ids fit into 16 bits.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(_shards(tokenizer, end_id), _FILE).write.option("compression", "none").parquet(path)


def _documents(batches):
    let_go()
    for batch in batches:
        for part, seq, docs, matrix in zip(*(batch.column(c).to_pylist() for c in ("part", "seq", "docs", "matrix")), strict=True):
            ids, (doc, n) = WaveletMatrix.from_bytes(matrix).ids().astype("<u4"), unpack(docs)
            end = np.cumsum(n)
            crc = [zlib.crc32(ids[b - m : b].tobytes()) for b, m in zip(end.tolist(), n.tolist(), strict=True)]
            columns = [np.full(len(doc), part), np.full(len(doc), seq), doc, end - n, n, np.array(crc, np.int64)]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"])


def starts(files: DataFrame) -> DataFrame:
    """(part, seq, before): the number of tokens before each shard; sums by part, then within it."""
    sizes = files.select("part", "seq", "n_tokens")
    whole = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("parts"))
    inside = sizes.select("part", "seq", F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shards"))
    return inside.join(whole, "part").select("part", "seq", (F.col("parts") + F.col("shards")).alias("before"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files; only these rows are shuffled."""
    files = spark.read.schema(_FILE).parquet(path)
    rows = files.select("part", "seq", "docs", "matrix").mapInArrow(_documents, "part long, seq long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    rows = rows.join(starts(files), ["part", "seq"])
    return give_back(rows.select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))


def op5(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark)
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_documents(spark, path)
