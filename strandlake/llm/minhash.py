"""MinHash near-dedup with min-max hashing: the smallest and the largest value of each permutation are kept.

1. Each document's set of word shingles gives a digest and, from `permutations` hash functions, twice as
   many signature values (a minimum and a maximum each); four values make a band.
2. Documents with equal sets fall into one class; the smallest id represents it from here on.
3. A band's bucket proposes links. A centre is held against all members (as many pairs as members), then one
   more of several; that joins most of what belongs together.
4. Of buckets that still hold several components, the members outside the largest are held, in blocks, against
   all members: a block's inverted index of shingles gives the exact intersections with a text that streams
   by, so links are found inside a task and only those that join something leave it. No bucket is split or
   cut short: each pair that shares a band is compared or already joined, whatever the bucket's size. A pair
   of similarity 0.8 shares no band with a chance of about 3 in a million.
5. Every link is judged on the full shingle sets; connected components follow by label propagation.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Rolling, WordHashes, by_row, let_go, mix, numbered, with_ids, written

STARS = 1  # rounds with more centres after the first
CENTRES = 4  # orders from which buckets choose the further centres
SALTS = 16  # parts in which a centre's partners are dealt out
BLOCK = 512  # members of an inverted index


class Shingles:
    """Sets of word shingles as sorted, distinct 64-bit hashes."""

    def __init__(self, width: int) -> None:
        self.width, self.words, self.roll = width, WordHashes(), Rolling()

    def of(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only ASCII letters and spaces count
        if not words:
            return np.zeros(0, np.uint64)
        sums = self.roll.sums(self.words.of(words))
        return np.unique(mix(self.roll.fixed(sums, min(self.width, len(words))))) if len(words) >= self.width else mix(self.roll.fixed(sums, len(words)))


def _constants(permutations: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * permutations + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:permutations] | np.uint64(1), seeds[permutations:]


def min_max(values: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per permutation the smallest and the largest hash of a set that isn't empty."""
    low, high = np.full(len(scale), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(scale), np.uint64)
    for at in range(0, len(values), 4096):
        hashed = values[at : at + 4096, None] * scale + shift
        np.minimum(low, hashed.min(0), out=low)
        np.maximum(high, hashed.max(0), out=high)
    return low, high


def _signatures(width: int, permutations: int):
    def run(batches):
        let_go()
        shingles, (scale, shift) = Shingles(width), _constants(permutations)
        for batch in batches:
            ids, sizes, digests, bands = batch.column(0), [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles.of(text)
                sizes.append(len(s))
                if not len(s):
                    digests.append(None)
                    bands.append([])
                    continue
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                low, high = min_max(s, scale, shift)
                # a band takes two minima and, of other permutations, two maxima
                rows = np.stack([low[0::2], low[1::2], np.roll(high[0::2], 1), np.roll(high[1::2], 1)])
                key = np.arange(1, rows.shape[1] + 1, dtype=np.uint64)
                for r in rows:
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + r)
                bands.append(key.view(np.int64))
            yield pa.record_batch([ids, pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "bands"])

    return run


def _confirm(width: int, percent: int):
    """Rows come sorted: a centre, then the texts to hold against it."""

    def run(batches):
        let_go()
        shingles, centre, key, own = Shingles(width), None, None, None
        for batch in batches:
            a, b = [], []
            for row in batch.to_pylist():
                s = shingles.of(row["text"])
                if row["centre"]:
                    key, own, centre = (row["a"], row["salt"]), s, row["a"]
                    continue
                assert key == (row["a"], row["salt"])
                common = len(np.intersect1d(own, s, assume_unique=True))
                if 100 * common >= percent * (len(own) + len(s) - common):
                    a.append(centre)
                    b.append(row["id"])
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are as similar as asked.

    A centre meets its partners in SALTS parts; a part is streamed, so no group is held in memory.
    """
    dealt = pairs.distinct().withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    left = dealt.select("a", "salt").distinct().join(texts.withColumnRenamed("id", "a"), "a").select("a", "salt", F.col("a").alias("id"), "text", F.lit(True).alias("centre"))
    right = dealt.join(texts.withColumnRenamed("id", "b"), "b").select("a", "salt", F.col("b").alias("id"), "text", F.lit(False).alias("centre"))
    rows = left.unionByName(right).repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a", "salt")
    return written(rows.sortWithinPartitions("a", "salt", F.desc("centre")).mapInArrow(_confirm(width, percent), "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of undirected links (a, b): label is the component's smallest node."""
    both = written(links.select("a", "b").union(links.select("b", "a")).union(links.select("a", "a")).union(links.select("b", "b")).distinct())
    labels = written(both.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node"))
    while True:
        # a node hears its own label too, so no second join is needed to see whether it changed
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("to"), F.max(F.when(F.col("a") == F.col("b"), F.col("label"))).alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("far"))
        new = written(near.join(jump, "to").select(F.col("a").alias("node"), F.least("to", "far").alias("label"), (F.least("to", "far") < F.col("was")).alias("moved")))
        labels = new.drop("moved")
        if not new.where("moved").limit(1).count():
            return labels


class _Forest(dict):
    """Which components a task has joined: label -> label nearer to the root."""

    def root(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = x = self.get(up, up)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self[max(x, y)] = min(x, y)
        return x != y


class _Index:
    """An inverted index of the shingle sets of some members of a bucket."""

    def __init__(self, members: list[tuple]) -> None:
        self.ids, self.labels, self.sizes, self.bands = ([m[i] for m in members] for i in range(4))
        self.sizes, self.bands = np.array(self.sizes), np.array(self.bands)
        values, self.member = np.concatenate([m[4] for m in members]), np.repeat(np.arange(len(members)), self.sizes)
        order = np.argsort(values, kind="stable")
        self.member = self.member[order]
        self.values, self.first, self.many = np.unique(values[order], return_index=True, return_counts=True)

    def common(self, values: np.ndarray) -> np.ndarray:
        """Shingles that a set shares with each member."""
        at = np.minimum(np.searchsorted(self.values, values), len(self.values) - 1)
        at = at[self.values[at] == values]
        n = self.many[at]
        slots = np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.member[slots], minlength=len(self.ids))


def _block_links(width: int, percent: int):
    """Links (a, b) that join components. Rows come sorted: a salt's held members by block, then all of its bucket."""

    def run(batches):
        let_go()
        shingles, at, held, indexes, joined = Shingles(width), None, [], [], _Forest()
        for batch in batches:
            a, b = [], []
            columns = [batch.column(c).to_pylist() for c in ("key", "salt", "held", "id", "label", "bands", "text")]
            for key, salt, own, id_, label, bands, text in zip(*columns, strict=True):
                if at != (key, salt):
                    at, held, indexes, joined = (key, salt), [], [], _Forest()
                values = shingles.of(text)
                if own:
                    held.append((id_, label, len(values), bands, values))
                    if len(held) == BLOCK:
                        indexes.append(_Index(held))
                        held = []
                    continue
                if held:
                    indexes.append(_Index(held))
                    held = []
                for index in indexes:
                    both = index.common(values)
                    near = np.flatnonzero(100 * both >= percent * (index.sizes + len(values) - both))
                    if len(near):  # a pair is judged in the first bucket that it shares
                        same = index.bands[near] == np.array(bands)
                        near = near[np.array(bands)[same.argmax(1)] == key]
                    for j in near.tolist():
                        if joined.join(index.labels[j], label):
                            a.append(min(id_, index.ids[j]))
                            b.append(max(id_, index.ids[j]))
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _shared(members: DataFrame) -> DataFrame:
    """The members of buckets with more than one."""
    return written(members.join(members.groupBy("key").count().where("count > 1").select("key"), "key"))


class _Search:
    """Links among the members (key, id, n) of buckets, found in rounds."""

    def __init__(self, texts: DataFrame, width: int, percent: int) -> None:
        self.texts, self.width, self.percent = texts, width, percent
        self.labels: DataFrame | None = None
        # else the sizes alone rule a link out
        self.alike = F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m)")

    def named(self, members: DataFrame) -> DataFrame:
        members = members.select("key", "id", "n")
        if self.labels is None:
            return members.withColumn("label", F.col("id"))
        return members.join(self.labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))

    def join(self, links: DataFrame) -> None:
        """Joins the components that the links connect."""
        if self.labels is not None:
            if not links.limit(1).count():
                return
            links = links.unionByName(self.labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
        self.labels = components(links)

    def star(self, members: DataFrame, *seed) -> None:
        """Holds each bucket's centre, its member of smallest hash, against the members of other components."""
        members = self.named(members)
        centre = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", *seed).alias("h"), "id", "n", "label")).alias("c"))
        met = members.join(centre, "key").where("label <> c.label").withColumn("m", F.col("c.n")).where(self.alike)
        pairs = met.select(F.col("c.id").alias("a"), F.col("id").alias("b"))
        self.join(confirmed(pairs, self.texts, self.width, self.percent))

    def open_(self, members: DataFrame) -> DataFrame:
        """(key, id, n, label, major, others) of buckets with members of several components.

        major: the component with most members; others: the number of members outside of it.
        """
        named = self.named(members)
        sizes = named.groupBy("key", "label").agg(F.count("*").alias("c"))
        stats = sizes.groupBy("key").agg(F.count("*").alias("kinds"), (F.sum("c") - F.max("c")).alias("others"), F.max_by("label", F.struct("c", "label")).alias("major")).where("kinds > 1")
        return written(named.join(stats, "key").select("key", "id", "n", "label", "major", "others"))

    def blocks(self, open_: DataFrame, bands: DataFrame) -> None:
        """Links across the components of the open buckets.

        The members outside the largest component are dealt out to as many salts as the root of the number of
        their blocks; each salt meets its whole bucket.
        """
        members = open_.join(bands, "id").join(self.texts, "id").withColumn("salts", F.ceil(F.sqrt(F.col("others") / BLOCK)))
        rest = ["id", "label", "bands", "text"]
        held = members.where("label <> major").select("key", F.expr("pmod(xxhash64(id), salts)").alias("salt"), F.lit(True).alias("held"), *rest)
        met = members.select("key", F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt"), F.lit(False).alias("held"), *rest)
        rows = held.unionByName(met).repartition(int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "salt")
        self.join(written(rows.sortWithinPartitions("key", "salt", F.desc("held")).mapInArrow(_block_links(self.width, self.percent), "a long, b long")))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, permutations: int = 50) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest id reachable over links), kept.

    Two documents are linked if at least `percent` of the union of their sets of `width`-word shingles is
    shared. A text of fewer words is one shingle; null, empty or blank texts have none and are linked with
    nothing. Rows that share an id are documents of their own: the first by text is kept, the others of its
    component aren't; see `by_row`. An empty table gives an empty result.
    """
    rows, ids = by_row(docs)
    found = _near(rows, width, percent, permutations)
    return with_ids(found.withColumn("kept", F.col("doc_id") == F.col("component_id")), ids, "doc_id", "component_id")


def _near(docs: DataFrame, width: int, percent: int, permutations: int) -> DataFrame:
    signed = written(docs.mapInArrow(_signatures(width, permutations), "doc_id long, n_shingles long, digest binary, bands array<long>"))
    classes = written(signed.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep")))
    alone = signed.join(classes, "digest").where("doc_id = rep").withColumnRenamed("doc_id", "id")
    members = _shared(alone.select(F.explode("bands").alias("key"), "id", F.col("n_shingles").alias("n")))
    texts = written(docs.withColumnRenamed("doc_id", "id").join(members.select("id").distinct(), "id"))
    search = _Search(texts, width, percent)
    search.star(members)  # one centre for all the buckets of a group
    for turn in range(STARS + 1):
        members = search.open_(members)
        if not members.limit(1).count():
            break
        if turn < STARS:
            search.star(members, F.pmod("key", F.lit(CENTRES)), F.lit(turn))
        else:
            search.blocks(members, alone.select("id", "bands"))
    named = classes.join(search.labels.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("label"))
    out = signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of linked documents: the one of the smallest id, then of the smallest text.

    Documents without a shingle stay. Ids that repeat or are null don't matter: rows are linked by their texts.
    """
    rows, key, _ = numbered(docs)
    kept = _near(rows.select(F.col(key).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), width, percent, 50).where("doc_id = component_id").select(F.col("doc_id").alias(key))
    return rows.join(kept, key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op10(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)
