"""Document fingerprints from closed syncmers, in DataFrame functions only.

A k-mer is a run of K words; its inner substrings are the runs of S words within it. It is a closed syncmer
if the one with the smallest hash is its first or its last: that depends on the k-mer alone, so equal
passages choose equal anchors whatever stands around them. A fingerprint holds, for each anchor of a text, a
hash of the anchor, the next one and the distance between them: two fingerprints share it only if both texts
have the two anchors at the same relative places, wherever the passage stands in either. Their likeness is
the Jaccard similarity of these sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import by_row, with_ids, written

K, S = 5, 2


def with_syncmers(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`: array of struct(hash, pos), the closed syncmers of a text column in order of place.

    pos counts words. A text of fewer than K words, or without a closed syncmer, has one, all of it; null,
    empty and blank texts have none.
    """
    w, g, p = f"_w_{out}", f"_g_{out}", f"_p_{out}"
    df = df.withColumn(w, F.transform(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), ""), lambda word: F.xxhash64(word)))
    # inner substrings: hashes of S words in a row
    df = df.withColumn(g, F.expr(f"transform(sequence(0, greatest(size(`{w}`) - {S}, 0)), i -> xxhash64({', '.join(f'get(`{w}`, i + {j})' for j in range(S))}))"))
    last = K - S
    inner = ", ".join(f"get(`{g}`, i + {j})" for j in range(1, last))
    df = df.withColumn(p, F.expr(f"filter(sequence(0, greatest(size(`{w}`) - {K}, 0)), i -> least(get(`{g}`, i), get(`{g}`, i + {last})) <= least({inner}))"))
    kmer = ", ".join(f"get(`{w}`, i + {j})" for j in range(K))
    many = F.expr(f"transform(`{p}`, i -> named_struct('hash', xxhash64({kmer}), 'pos', i))")
    one = F.array(F.struct(F.xxhash64(w).alias("hash"), F.lit(0).alias("pos")))
    none = F.array().cast("array<struct<hash: bigint, pos: int>>")
    return df.withColumn(out, F.when((F.size(w) >= K) & (F.size(p) > 0), many).when(F.size(w) > 0, one).otherwise(none)).drop(w, g, p)


def placed(syncmers: str) -> Column:
    """The fingerprint: distinct hashes of neighbouring anchors and their distance, ascending; of a lone anchor its hash."""
    pairs = F.expr(f"zip_with(slice({syncmers}, 1, size({syncmers}) - 1), slice({syncmers}, 2, size({syncmers})), (a, b) -> xxhash64(a.hash, b.hash, b.pos - a.pos))")
    return F.sort_array(F.array_distinct(F.when(F.size(syncmers) > 1, pairs).otherwise(F.col(syncmers)["hash"])))


def likeness(a: Column, b: Column) -> Column:
    """Share of the hashes of both together that are in both; 1 for two empty fingerprints."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def as_text(fingerprint: str) -> Column:
    return F.concat_ws(".", F.transform(fingerprint, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, syncmers, fingerprint as an array of hashes) of every row of docs; ids are given back as they are."""
    rows, ids = by_row(docs)
    df = with_syncmers(rows, "text", "syncmers")
    return with_ids(df.select("doc_id", F.length("text").cast("long").alias("n_chars"), "syncmers", placed("syncmers").alias("fingerprint")), ids)


def _before(docs: DataFrame) -> DataFrame:
    """(doc_id, prev_id, prev_n): the document before each in ascending doc_id and its length; before the first, the last.

    Ids are range-partitioned; windows work inside a partition, and the partitions' edges (one row each)
    tell the rest.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id", F.length("text").cast("long").alias("n"))
    ids = written(ids.repartitionByRange(parts, "doc_id").withColumn("part", F.spark_partition_id()))
    edges = ids.groupBy("part").agg(F.min("doc_id").alias("doc_id"), F.max(F.struct("doc_id", "n")).alias("last"))
    ends = ids.agg(F.max(F.struct("doc_id", "n")).alias("end"))
    edges = edges.select("part", "doc_id", F.lag("last").over(Window.orderBy("part")).alias("edge"))
    edges = edges.join(F.broadcast(ends)).select("doc_id", F.coalesce("edge", "end").alias("edge"))  # ends is one row
    own = Window.partitionBy("part").orderBy("doc_id")
    near = ids.select("doc_id", F.lag(F.struct("doc_id", "n")).over(own).alias("prev"))
    prev = near.join(edges, "doc_id", "left").select("doc_id", F.coalesce("prev", "edge").alias("prev"))
    return prev.select("doc_id", F.col("prev.doc_id").alias("prev_id"), F.col("prev.n").alias("prev_n"))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The edited text has its last quarter (floor of the code points) replaced by as many code points from the
    start of the next document (all of it if shorter). Null texts are empty. Rows that share an id, or
    have none, are documents of their own in the order of their texts, null ids first. Of one document alone the next is itself; an empty table gives an empty result.
    """
    docs, ids = by_row(docs)
    # each document sends its head and its fingerprint to the one before it
    sent = with_syncmers(docs.join(_before(docs), "doc_id"), "text", "syncmers")
    sent = sent.select(F.col("prev_id").alias("doc_id"), F.expr("substring(text, 1, int(prev_n div 4))").alias("head"), placed("syncmers").alias("next_fp"))
    df = docs.join(sent, "doc_id").withColumn("n_chars", F.length("text").cast("long"))
    df = df.withColumn("edited", F.expr("concat(substring(text, 1, int(n_chars - n_chars div 4)), head)"))
    df = with_syncmers(with_syncmers(df, "text", "own"), "edited", "other")
    df = df.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), placed("own").alias("fp"), placed("other").alias("edited_fp"), "next_fp")
    near = {"near_edited": likeness(F.col("fp"), F.col("edited_fp")), "near_next": likeness(F.col("fp"), F.col("next_fp"))}
    out = df.select("doc_id", "n_chars", "edited_sha256", as_text("fp").alias("fingerprint"), as_text("edited_fp").alias("edited_fingerprint"), *[v.alias(k) for k, v in near.items()])
    return with_ids(out, ids)


def op6(spark, sf_dir: str) -> DataFrame:
    return compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
