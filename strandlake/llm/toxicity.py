"""Toxicity: bags of subword embeddings, averaged and fed to a linear softmax, trained jointly in numpy.

A word's vector is the mean of the embeddings of its hashed character n-grams (and of the whole word), so a
misspelling or an unseen ending still lands near its kin. A document is the mean of its distinct words' vectors.

The model is fitted on a bounded sample of labelled rows (`sample`, whole texts, the ones whose hash of
doc_id is smallest); executors turn texts into word hashes and words into embedding rows, so the driver holds
arrays of numbers and no text. As the softmax is linear, a word's part in it is one number: scoring adds up
numbers that each task remembers for the words it meets.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import let_go, written

GRAMS = (3, 4, 5)
_TOKEN = re.compile(r"[^\W_]+")

ROWS = 1 << 17  # embeddings; n-grams share them by hash


def grams(word: str) -> list[int]:
    """Rows of a word's n-grams, with its edges marked."""
    import xxhash

    w = f"<{word}>"
    return [xxhash.xxh3_64_intdigest(g) % ROWS for g in [w, *(w[i : i + n] for n in GRAMS for i in range(len(w) - n + 1))]]


def words_of(text: str) -> set[str]:
    """Distinct runs of letters and digits, lower-cased; other marks only part them."""
    return set(_TOKEN.findall(text.lower()))


class Model:
    def __init__(self, dim: int = 8, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.1, (ROWS, dim)).astype(np.float32)
        self.out = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)

    def fit(self, docs: list[np.ndarray], begin: np.ndarray, flat: np.ndarray, toxic: np.ndarray, steps: int = 600, batch: int = 64, rate: float = 0.08) -> Model:
        """Adam on the cross-entropy; table, softmax and bias move together.

        docs: each document's distinct words as numbers; the rows of word w are flat[begin[w] : begin[w + 1]].
        """
        weights = [np.full(len(d), 1 / max(1, len(d)), np.float32) for d in docs]
        size = np.diff(begin)
        rng = np.random.default_rng(1)
        state = {k: [np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))] for k in ("table", "out", "bias")}
        step, epochs = 0, max(1, round(steps * batch / max(1, len(docs))))
        for epoch in range(epochs):
            order = rng.permutation(len(docs))
            lr = rate * (1 - epoch / epochs)
            for at in range(0, len(order), batch):
                part = [i for i in order[at : at + batch] if len(docs[i])]
                if not part:
                    continue
                step += 1
                word = np.concatenate([docs[i] for i in part])
                of = np.repeat(np.arange(len(part)), [len(docs[i]) for i in part])
                part_share = np.concatenate([weights[i] for i in part])
                n = size[word]
                cell = flat[np.repeat(begin[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                part_of, w = np.repeat(of, n), np.repeat(part_share / n, n)
                used, cell = np.unique(cell, return_inverse=True)
                # weight of each used row in each document, as a dense matrix of this batch
                mat = np.bincount(part_of * len(used) + cell, weights=w, minlength=len(part) * len(used)).reshape(len(part), -1).astype(np.float32)
                mean = mat @ self.table[used]
                p = _softmax(mean @ self.out + self.bias)
                err = (p - np.eye(2, dtype=np.float32)[toxic[part]]) / len(part)
                moves = {"table": (used, mat.T @ (err @ self.out.T)), "out": (slice(None), mean.T @ err), "bias": (slice(None), err.sum(0))}
                for k, (sel, g) in moves.items():
                    m, v = state[k]
                    m[sel] = 0.9 * m[sel] + 0.1 * g
                    v[sel] = 0.99 * v[sel] + 0.01 * g * g
                    t = min(step, 1000)
                    getattr(self, k)[sel] -= lr * (m[sel] / (1 - 0.9**t)) / (np.sqrt(v[sel] / (1 - 0.99**t)) + 1e-7)
        # scores as if both labels were equally common, however rare one is among the sample
        share = np.clip(np.bincount(toxic, minlength=2) / max(1, len(toxic)), 1e-3, 1)
        self.bias -= np.log(share).astype(np.float32)
        return self

    def parts(self) -> tuple[np.ndarray, float]:
        """Per embedding row, what it adds to the log odds of label 1; and their start."""
        return self.table @ (self.out[:, 1] - self.out[:, 0]), float(self.bias[1] - self.bias[0])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _bags(batches):
    """Each labelled text as the hashes of its distinct words; the texts themselves stay on the executors."""
    import xxhash

    for batch in batches:
        bags = [np.array(sorted(xxhash.xxh3_64_intdigest(w) for w in words_of(t)), np.uint64).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), batch.column(2), pa.array(bags, pa.binary())], names=["doc_id", "toxic", "words"])


def _vocabulary(batches):
    """(word, rows) of the words of the texts, each once a batch."""
    import xxhash

    for batch in batches:
        found = set().union(*map(words_of, batch.column(1).to_pylist()))
        rows = [np.array(grams(w), np.int32).tobytes() for w in found]
        yield pa.record_batch([pa.array(np.array([xxhash.xxh3_64_intdigest(w) for w in found], np.uint64).view(np.int64)), pa.array(rows, pa.binary())], names=["word", "rows"])


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> Model | None:
    """Fits the model on at most `sample` labelled documents; None without any label.

    Rows of `labels` (doc_id, toxic) with a null id or label teach nothing; where an id has several labels
    the larger counts, where several rows of docs share an id the smallest text teaches. Null texts are
    empty. The driver gets numbers only: each text's words by hash, and the embedding rows of each word.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chosen = marks.join(docs.select("doc_id"), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = written(docs.join(chosen.distinct(), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic"))
    bags = rows.mapInArrow(_bags, "doc_id long, toxic int, words binary").toArrow().sort_by([("doc_id", "ascending"), ("words", "ascending")])
    if not bags.num_rows:
        return None
    vocabulary = rows.mapInArrow(_vocabulary, "word long, rows binary").groupBy("word").agg(F.min("rows").alias("rows")).toArrow().sort_by("word")
    cells = vocabulary.column("rows").combine_chunks()
    sizes = pc.binary_length(cells).to_numpy() // 4
    flat = np.frombuffer(b"".join(cells.to_pylist()), np.int32)
    words = vocabulary.column("word").to_numpy()
    texts = [np.searchsorted(words, np.sort(np.frombuffer(b, np.int64))) for b in bags.column("words").to_pylist()]
    return Model().fit(texts, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), flat, (bags.column("toxic").to_numpy() != 0).astype(int))


class _Scorer:
    """scores(texts): the chance of label 1, from what each word adds to the log odds."""

    LIMIT = 500_000  # words remembered; bounds memory, not results

    def __init__(self, parts: np.ndarray, bias: float) -> None:
        self.parts, self.bias, self.known = parts, bias, {}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        known, odds = self.known, []
        for text in texts:
            found = words_of(text or "")
            if len(known) > self.LIMIT:
                known.clear()
            for word in found.difference(known):
                known[word] = float(self.parts[grams(word)].mean())
            # added up without rounding, so the order of a set's words doesn't show
            odds.append(math.fsum([known[w] for w in found]) / max(1, len(found)) + self.bias)
        return 1 / (1 + np.exp(-np.clip(np.array(odds, float), -60, 60)))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 6000) -> DataFrame:
    """(doc_id, score): the chance of label 1 for every row of docs, from its text alone.

    Null and empty texts get the score of the bias. Without labels every score is 0. A repeated row gets its
    score again, a null id is given back; texts are scored whole, however long. An empty table gives none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(docs, labels, sample)
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    parts, bias = model.parts()

    def run(batches):
        let_go()
        scorer = _Scorer(parts, bias)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(scorer.scores(batch.column(1).to_pylist()))], names=["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id long, score double")


def held_out():
    """True for the quarter of the rows that never teaches."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


def op8(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_toxicity(docs, labels.where(~held_out()))
    out = scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 6000) -> DataFrame:
    """docs without the rows whose own text scores at least `threshold`; all columns pass through as they are.

    Ids don't matter to the decision: rows that share an id, or have none, are judged one by one. Without
    labels all rows stay.
    """
    model = train(docs, labels, sample)
    if model is None:
        return docs
    parts, bias = model.parts()
    text = [c.lower() for c in docs.columns].index("text")

    def run(batches):
        let_go()
        scorer = _Scorer(parts, bias)
        for batch in batches:
            yield batch.filter(pa.array(scorer.scores(batch.column(text).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
