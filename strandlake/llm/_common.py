"""What the training-data operators share: keys of documents, shared tables, packed blocks.

Several operators move a few bytes for each window or anchor of the corpus. A Spark row for each would
cost ten times its payload, so tasks send *blocks*: one row per (bucket, task chunk) whose payload holds
numpy arrays. Spark still deals the rows out by bucket; a bucket is sized by the number of buckets.
"""

from __future__ import annotations

import gc
import re
import struct
import sys

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.sources.stored import shared_dir, stored  # noqa: F401

#: Stands for a null doc_id inside the operators; it is given back as null.
NULL_ID = -(2**63)

#: A word of the contracts: a run of anything but ASCII white space.
WORD = re.compile("[^\x20\x09-\x0d]+")

MASK = (1 << 64) - 1


written = stored


def let_go() -> None:
    """Frees what a step before has left in this Python worker: kept encoders, and memory that Arrow holds for later."""
    kept = sys.modules["tokenizers"].__dict__.pop("_kept_encoders", None) if "tokenizers" in sys.modules else None
    if kept:
        for encoder in kept.values():
            encoder.forget()
        kept.clear()
        gc.collect()  # an encoder and its tables know each other
    pa.default_memory_pool().release_unused()


def buckets(spark: SparkSession, factor: int = 2) -> int:
    """Number of buckets: grows with the shuffle partitions that the session was given for its data."""
    return max(8, factor * int(spark.conf.get("spark.sql.shuffle.partitions")))


def numbered(docs: DataFrame) -> tuple[DataFrame, str, bool]:
    """(docs with one more column, its name, whether it differs from doc_id): a key that tells rows apart and sorts as doc_id does.

    doc_id itself where it is unique and never null. Otherwise rows are numbered in the order of doc_id
    (null first), then text: rows that share an id are documents of their own.
    """
    key, rows = fresh(docs, "_key"), docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    if not rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        return docs.withColumn(key, F.col("doc_id").cast("long")), key, False
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id", "text").sortWithinPartitions("doc_id", "text")
    # written, as the numbers depend on how the rows were dealt out
    return written(ordered.withColumn(key, F.monotonically_increasing_id())), key, True


def by_row(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text) with `numbered`'s key as doc_id and null texts as empty ones; and (key, name), if they differ.

    Other columns are left behind, whatever their names. `with_ids` gives the ids back.
    """
    rows, key, differs = numbered(docs.select("doc_id", "text"))
    ids = rows.select(F.col(key).alias("key"), F.col("doc_id").alias("name")) if differs else None
    return rows.select(F.col(key).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), ids


def with_ids(df: DataFrame, ids: DataFrame | None, *names: str) -> DataFrame:
    """df with the ids that keys stand for in the columns `names` (doc_id, if none is given)."""
    columns = df.columns
    for n in (names or ("doc_id",)) if ids is not None else ():
        df = df.withColumnRenamed(n, "key").join(ids, "key").drop("key").withColumnRenamed("name", n)
    return df.select(*columns)




def give_back(df: DataFrame, *names: str) -> DataFrame:
    """The inner stand-in for a null id becomes null again."""
    return df.withColumns({n: F.when(F.col(n) != NULL_ID, F.col(n)) for n in names or ("doc_id",)})


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


# --- packed arrays -------------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of fixed-width numbers as bytes, each compressed."""
    z, out = zstandard.ZstdCompressor(level=1), []
    for a in arrays:
        data = z.compress(np.ascontiguousarray(a).tobytes())
        out += [struct.pack("<2sI", a.dtype.str[1:].encode(), len(data)), data]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    z, at, out = zstandard.ZstdDecompressor(), 0, []
    while at < len(data):
        kind, n = struct.unpack_from("<2sI", data, at)
        out.append(np.frombuffer(z.decompress(data[at + 6 : at + 6 + n]), dtype="<" + kind.decode()))
        at += 6 + n
    return out


def by_bucket(bucket: np.ndarray):
    """(bucket, positions with that bucket, in their order) for each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cut) if len(order) else []:
        yield int(bucket[part[0]]), part


# --- hashing -------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finalizer of a public-domain mixer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Rabin-Karp hashes modulo 2**64 of any range of a sequence, from running sums.

    A range's hash is sum(x[s+j] * base**-j), so it does not depend on where the range stands.
    """

    BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            step = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]), dtype=np.uint64)
            self.up, self.down = step(self.BASE), step(pow(self.BASE, -1, 1 << 64))

    def sums(self, x: np.ndarray) -> np.ndarray:
        self._powers(len(x) + 1)
        out = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * self.down[: len(x)], out=out[1:])
        return out

    def fixed(self, sums: np.ndarray, width: int) -> np.ndarray:
        """Hashes of all windows of that width."""
        n = len(sums) - width
        return (sums[width:] - sums[:n]) * self.up[:n] if n > 0 else np.zeros(0, np.uint64)

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.up[start]


class WordHashes(dict):
    """Word -> 64-bit hash, remembered up to a bound; the bound changes speed only."""

    LIMIT = 500_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of what the half-open ranges cover; ranges that touch become one run."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.concatenate([new[1:], [True]])]


# --- groups of documents -------------------------------------------------------------------------


def _prime(n: int) -> int:
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def doc_groups(spark: SparkSession) -> int:
    """Number of groups that documents and what was decided about them meet in: prime, so ids in steps spread too."""
    return _prime(buckets(spark, 1))


def group_column(groups: int):
    return F.pmod(F.col("doc_id").bitwiseXOR(F.shiftright("doc_id", 21)), F.lit(groups)).cast("int")


def group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    """As group_column, for arrays of ids."""
    return np.mod(ids ^ (ids >> np.int64(21)), np.int64(groups))
