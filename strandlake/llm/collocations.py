"""Phrase collocations: Apriori over words, counted by double-array tries that numpy walks for all places at once.

1. Tasks cut texts into pieces and words and write *blocks*: up to `BLOCK` words of one language as numbers into
   the block's own word list. Word counts are sums over the blocks' lists; words that are frequent get dense
   ids, which return to each block's list by a join on the word (no vocabulary is broadcast or collected).
2. Candidates of k words are the stretches of a piece whose first k - 1 words are frequent together and whose
   last word is frequent; a task sends each with its number there, sums under `min_count` go. What is left are
   the Apriori-safe candidates of k words.
3. Candidates are dealt by hash into shards of about `SHARD` phrases. Each shard becomes a double-array trie,
   built in a task of its own, and is broadcast alone, so a broadcast is bounded whatever the corpus. Each task
   advances the states of all places of a block level by level, bincounts the accepting states, and the counts of
   all tasks and shards are summed. They give the counts of the result, and the prefixes of step 2.
4. Cuts, scores and the rules on longer candidates are joins on phrases.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import mix, pack, unpack, written

BLOCK = 250_000  # words and piece ends of a block, but for a longer document; bounds a task's memory
HELD = 1_000_000  # occurrences that a task counts at a time
SENT = 65_536  # rows of a batch that a task sends
SHARD = 200_000  # phrases of a trie, on average; bounds a broadcast
TRIED = 500_000  # cells that are looked at together when a trie is laid out
MOST = 4  # words of the longest phrase

_BLOCK = "lang string, block long, n long, words array<string>, counts array<long>, places binary"
#: Marks between pieces become full stops, which are in no word.
_MARKS = bytes(ord(".") if chr(b) in ".,;:!?\n\x0b\x0c\r" else b for b in range(256))


# --- double-array tries --------------------------------------------------------------------------


class Trie:
    """Phrases of ids as a double array: the state after reading id x in state s is base[s] + x, if check there is s.

    A state is a cell of the arrays; 0 is the root. accept[s]: the number of the phrase that ends there, or -1.
    An id is its place in `alphabet`, read as two digits of that many kinds as the square root of its size: so a
    state has few successors close to each other, and the arrays stay dense.
    """

    def __init__(self, alphabet: np.ndarray, base: np.ndarray, check: np.ndarray, accept: np.ndarray) -> None:
        self.alphabet, self.base, self.check, self.accept = alphabet, base, check, accept
        self.kinds = self._kinds(alphabet)

    @staticmethod
    def _kinds(alphabet: np.ndarray) -> int:
        return max(1, math.isqrt(max(len(alphabet) - 1, 0)) + 1)

    @classmethod
    def of(cls, phrases: np.ndarray) -> Trie:
        """phrases: a row of ids each, distinct, shorter ones filled up with -1."""
        alphabet = np.unique(phrases[phrases >= 0])
        at, width = np.searchsorted(alphabet, phrases), cls._kinds(alphabet)
        digits = np.stack([at // width, at % width], 2)
        symbols = np.where((phrases >= 0)[:, :, None], digits, -1).reshape(len(phrases), 2 * phrases.shape[1])
        parent, symbol, ends = [np.array([-1])], [np.array([-1])], []
        node, rows, n = np.zeros(len(phrases), np.int64), np.arange(len(phrases)), 1
        for depth in range(symbols.shape[1]):
            going = symbols[rows, depth] >= 0
            ends.append((node[~going], rows[~going]))
            rows, node = rows[going], node[going]
            code, node = np.unique(node * np.int64(width) + symbols[rows, depth], return_inverse=True)
            parent.append(code // width)
            symbol.append(code % width)
            node, n = node + n, n + len(code)
        ends.append((node, rows))
        parent, symbol = np.concatenate(parent), np.concatenate(symbol)
        cells, base = cls._placed(parent, symbol, width)
        size = int(cells.max()) + 1
        out = [np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)]
        out[0][cells], out[1][cells[1:]] = base, cells[parent[1:]]
        for node, rows in ends:
            out[2][cells[node]] = rows
        return cls(alphabet, *out)

    @staticmethod
    def _placed(parent: np.ndarray, symbol: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(cell, base) of each node. Children of one node are neighbours, by symbol; nodes with most go first."""
        n = len(parent)
        low, high = np.searchsorted(parent, np.arange(n), "left"), np.searchsorted(parent, np.arange(n), "right")
        many, base, cells = high - low, np.zeros(n, np.int64), np.zeros(n, np.int64)
        taken = np.zeros(2 * n + 3 * width + 64, bool)
        taken[0], start, last, size = True, 1, 1, 0  # last: behind all taken cells
        for node in np.argsort(-many, kind="stable")[: int((many > 1).sum())].tolist():
            s = symbol[low[node] : high[node]]
            if len(s) != size:  # where as many children didn't fit before, they needn't be tried again
                size, start, look = len(s), 1, max(1, min(128, TRIED // len(s)))
            fits = some = np.zeros(0, np.int64)
            while start < last:  # the children's first cell goes to a free one where the others fit too, or behind all
                some = start + np.flatnonzero(~taken[start : min(start + look, last)])
                fits = np.flatnonzero(~taken[some[:, None] + (s - s[0])].any(1))
                if len(fits):
                    break
                start += look
            start = first = int(some[fits[0]]) if len(fits) else last
            here = first + s - s[0]
            if here[-1] + 3 * width + 64 >= len(taken):
                taken = np.concatenate([taken, np.zeros(len(taken) + 3 * width, bool)])
            taken[here], cells[low[node] : high[node]], base[node], last = True, here, first - s[0], max(last, int(here[-1]) + 1)
        one = np.flatnonzero(many == 1)  # lone children fill the holes
        child, holes = low[one], np.flatnonzero(~taken[: last + len(one)])[: len(one)]
        cells[child], base[one] = holes, holes - symbol[child]
        return cells, base

    def to_bytes(self) -> bytes:
        return pack(self.alphabet, self.base, self.check, self.accept)

    @classmethod
    def from_bytes(cls, data: bytes) -> Trie:
        return cls(*unpack(data))

    def symbols(self, ids: np.ndarray) -> np.ndarray:
        if not len(self.alphabet):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.alphabet, ids), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == ids, at, -1)

    def walk(self, symbols: np.ndarray):
        """Yields (places, phrases) for 1, 2, ... words: where a phrase of so many words begins, and its number."""
        places, state = np.arange(len(symbols)), np.zeros(len(symbols), np.int64)
        for depth in range(MOST):
            going = places + depth < len(symbols)
            places, state = places[going], state[going]
            x = symbols[places + depth]
            some = np.flatnonzero(x >= 0)
            places, state, x = places[some], state[some], x[some]
            for digit in (np.floor_divide, np.remainder):
                cell = self.base[state] + digit(x, self.kinds)
                ok = np.flatnonzero((cell >= 0) & (cell < len(self.check)))
                ok = ok[self.check[cell[ok]] == state[ok]]
                places, state, x = places[ok], cell[ok], x[ok]
            found = self.accept[state]
            yield places[found >= 0], found[found >= 0]


# --- blocks of words -----------------------------------------------------------------------------


class _Open:
    """A block that is being filled. Word 0 stands for the end of a piece."""

    def __init__(self) -> None:
        self.known: defaultdict = defaultdict()
        self.known.default_factory = self.known.__len__
        self.known[b"."], self.parts, self.size = 0, [], 0

    def add(self, text: str) -> None:
        words = text.encode().lower().translate(_MARKS).replace(b".", b" . ").split()
        self.parts.append(np.fromiter(map(self.known.__getitem__, words), np.int32, len(words)))
        self.parts.append(np.zeros(1, np.int32))
        self.size += len(words) + 1

    def row(self, lang: str, block: int) -> pa.RecordBatch:
        places = np.concatenate(self.parts)
        counts = np.bincount(places, minlength=len(self.known))
        row = (lang, block, int(counts[1:].sum()), [w.decode() for w in self.known], counts.tolist(), pack(places))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary())
        return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in _BLOCK.split(", ")])


def _blocks(batches):
    from pyspark import TaskContext

    number, held, total = TaskContext.get().partitionId() << 32, {}, 0
    for batch in (b.slice(i, 256) for b in batches for i in range(0, len(b), 256)):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            block = held.setdefault(lang, _Open())
            before = block.size
            block.add(text)
            total += block.size - before
            for done in [lang] if block.size >= BLOCK else [*held] if total >= 3 * BLOCK else []:
                total -= held[done].size
                yield held.pop(done).row(done, number)
                number += 1
    for lang, block in held.items():
        yield block.row(lang, number)
        number += 1


def _dense(df: DataFrame, *by: str) -> DataFrame:
    """df, written, with `id`: numbers from 0 without gaps in the order of the columns `by`, unique together."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).count()
    sizes = sizes.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.withColumn("_part", part).join(sizes, "_part").withColumn("id", F.col("_before") + F.col("_at") - F.shiftleft("_part", 33)).drop("_at", "_part", "_before")


# --- scans ---------------------------------------------------------------------------------------


def _each_block(batches):
    """(places as numbers into the block's list, id of each word of the list or -1)."""
    for batch in batches:
        places, n, slots, ids = (batch.column(c) for c in ("places", "n_words", "slots", "ids"))
        for k in range(len(batch)):
            table = np.full(n[k].as_py(), -1, np.int64)
            table[slots[k].values.to_numpy()] = ids[k].values.to_numpy()
            yield unpack(places[k].as_py())[0], table


def _batches(code: np.ndarray, count: np.ndarray):
    for i in range(0, len(code), SENT):
        yield pa.record_batch([pa.array(code[i : i + SENT], pa.int64()), pa.array(count[i : i + SENT], pa.int64())], names=["code", "count"])


def _counted(occurrences):
    """Sums (codes) arrays of a task, so many at a time: yields (code, count) batches."""
    held, size = [], 0
    for codes in occurrences:
        if (codes < 0).any():
            raise OverflowError("ids must fit into 31 bits")
        held.append(codes)
        size += len(codes)
        if size >= HELD:
            yield from _batches(*np.unique(np.concatenate(held), return_counts=True))
            held, size = [], 0
    if size:
        yield from _batches(*np.unique(np.concatenate(held), return_counts=True))


def _pairs(batches):
    """Two frequent words in a row: the first one's id and the second's."""

    def occurrences():
        for places, table in _each_block(batches):
            x = table[places]
            i = np.flatnonzero((x[:-1] >= 0) & (x[1:] >= 0))
            yield x[i] << 32 | x[i + 1]

    yield from _counted(occurrences())


def _longer(trie, names, length: int):
    """A frequent phrase of `length` words and the frequent word after it: the phrase's id and the word's."""

    def run(batches):
        t, name = Trie.from_bytes(trie.value), unpack(names.value)[0]

        def occurrences():
            for places, table in _each_block(batches):
                x = np.append(table[places], -1)
                *_, (at, phrase) = (found for _, found in zip(range(length), t.walk(t.symbols(table)[places]), strict=False))
                going = x[at + length] >= 0
                yield name[phrase[going]] << 32 | x[at[going] + length]

        yield from _counted(occurrences())

    return run


def _accepted(trie, names):
    """How often each phrase of a trie occurs, by a bincount over accepting states."""

    def run(batches):
        t, name = Trie.from_bytes(trie.value), unpack(names.value)[0]
        sums = np.zeros(len(name), np.int64)
        for places, table in _each_block(batches):
            for _, phrase in t.walk(t.symbols(table)[places]):
                sums += np.bincount(phrase, minlength=len(sums))
        some = np.flatnonzero(sums)
        if len(some):
            yield from _batches(name[some], sums[some])

    return run


def _built(key: tuple, rows: pa.Table) -> pa.Table:
    ids = rows.column("ids").combine_chunks()
    n, phrases = np.diff(ids.offsets.to_numpy()), np.full((len(rows), MOST), -1, np.int64)
    phrases[np.repeat(np.arange(len(rows)), n), np.concatenate([np.arange(k) for k in n])] = ids.flatten().to_numpy()
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "trie": pa.array([Trie.of(phrases).to_bytes()], pa.binary()), "names": pa.array([pack(rows.column("id").to_numpy())], pa.binary())})


def _scans(coded: DataFrame, phrases: DataFrame, scan, *more: int) -> DataFrame:
    """(code, count) summed over all blocks and all shards of `phrases` (id, ids); a scan of the blocks for each shard."""
    spark, shards = coded.sparkSession, -(-phrases.count() // SHARD)
    if not shards:
        return spark.createDataFrame([], "code long, count long")
    dealt = phrases.select("id", "ids", F.pmod(F.xxhash64("ids"), F.lit(shards)).cast("int").alias("shard"))
    tries = written(dealt.groupBy("shard").applyInArrow(_built, "shard int, trie binary, names binary"))
    parts = []
    for k in sorted(r.shard for r in tries.select("shard").collect()):  # one number for each shard
        row = tries.where(F.col("shard") == k).first()
        held = [spark.sparkContext.broadcast(bytes(v)) for v in (row.trie, row.names)]  # at most a shard's size
        parts.append(coded.mapInArrow(scan(*held, *more), "code long, count long"))
    return _summed(reduce(DataFrame.unionAll, parts))


def _summed(counts: DataFrame) -> DataFrame:
    """(code, count): sums by code. Tasks have counted their own rows, so these go to their codes as they are."""
    return counts.repartition("code").groupBy("code").agg(F.sum("count").alias("count"))


# --- phrases -------------------------------------------------------------------------------------


def _key(ids: Column) -> Column:
    return F.concat_ws(" ", ids)


def _candidates(coded: DataFrame, words: DataFrame, min_count: int) -> DataFrame:
    """(id, ids, a): the Apriori-safe phrases of two words and more, counted by tries."""
    sums = _summed(coded.mapInArrow(_pairs, "code long, count long"))
    levels, before = [], words.select("id", F.array("id").alias("ids"))
    for length in range(2, MOST + 1):
        code = F.col("code")
        kept = sums.where(F.col("count") >= min_count).select("code", F.shiftright(code, 32).alias("head"), code.bitwiseAND(F.lit((1 << 32) - 1)).alias("tail"))
        kept = kept.join(before.select(F.col("id").alias("head"), "ids"), "head").select("code", F.concat("ids", F.array("tail")).alias("ids"))
        before = written(_dense(kept, "code").drop("code"))
        levels.append(before)
        if length < MOST:
            sums = _scans(coded, before, _longer, length)
    offsets, shift = [], F.lit(0).cast("long")
    for level in levels:
        offsets.append(level.withColumn("id", F.col("id") * MOST + len(offsets)))  # unique over all lengths
    every = written(reduce(DataFrame.unionAll, offsets))
    return every.join(_scans(coded, every, _accepted).withColumnRenamed("code", "id"), "id").select("id", "ids", F.col("count").alias("a"))


def _scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(id, ids, a, l, r, score): each phrase at its lowest-scoring cut."""
    known = phrases.select(_key(F.col("ids")).alias("key"), F.col("a").alias("f")).unionAll(words.select(F.col("id").cast("string"), "f"))
    cuts = phrases.select("id", "ids", "a", F.explode(F.expr("sequence(1, size(ids) - 1)")).alias("k"))
    cuts = cuts.withColumns({"left": _key(F.expr("slice(ids, 1, k)")), "right": _key(F.expr("slice(ids, k + 1, size(ids))"))})
    cuts = cuts.join(known.select(F.col("key").alias("left"), F.col("f").alias("l")), "left")
    cuts = cuts.join(known.select(F.col("key").alias("right"), F.col("f").alias("r")), "right")
    # decimals: products may pass 64 bits
    cuts = cuts.withColumn("score", F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    best = cuts.groupBy("id").agg(F.first("ids").alias("ids"), F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("id", "ids", "a", "cut.l", "cut.r", "cut.score")


def _covered(phrases: DataFrame) -> DataFrame:
    """(key, longer): for phrases inside longer ones, the largest count of such a longer one."""
    inner = "flatten(transform(sequence(2, size(ids) - 1), n -> transform(sequence(1, size(ids) - n + 1), i -> slice(ids, i, n))))"
    inside = phrases.where(F.size("ids") > 2).select("a", F.explode(F.expr(inner)).alias("ids"))
    return inside.groupBy(_key(F.col("ids")).alias("key")).agg(F.max("a").alias("longer"))


def mine_phrases(docs: DataFrame, top: int = 2000, min_count: int = 30, percent: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of two to four words.

    Texts are lower-cased in A-Z and cut into pieces at `.,;:!?` and line ends; words are what spaces and tabs
    part. a, l, r: occurrences of the phrase and of its parts at the lowest-scoring cut (2000000 * a / (l + r),
    floored); n: all words of the language. Phrases that a longer frequent one with at least `percent` % of
    their occurrences contains are left out. Null texts are empty, a null lang is `und`. Ids play no part, so
    repeated rows count again; extra columns are ignored. An empty table, or one in which nothing is frequent,
    gives an empty result.
    """
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = written(rows.mapInArrow(_blocks, _BLOCK))
    # the place 0 of a block's list is the end of a piece, no word
    listed = blocks.select("lang", "block", F.posexplode(F.arrays_zip("words", "counts")).alias("slot", "w")).where("slot > 0")
    listed = listed.select("lang", "block", "slot", F.col("w.words").alias("word"), F.col("w.counts").alias("count"))
    frequent = listed.groupBy("lang", "word").agg(F.sum("count").alias("f")).where(F.col("f") >= min_count)
    words = written(_dense(frequent, "lang", "word"))
    ids = listed.join(words, ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("slot", "id")).alias("ids"))
    coded = blocks.join(ids, "block").select("places", F.size("words").alias("n_words"), F.col("ids.slot").alias("slots"), F.col("ids.id").alias("ids"))
    coded = written(coded)
    phrases = written(_candidates(coded, words, min_count))
    scored = _scored(phrases, words).withColumn("key", _key(F.col("ids"))).join(_covered(phrases), "key", "left")
    scored = scored.where(f"longer is null or 100 * cast(longer as decimal(20,0)) < {int(percent)} * cast(a as decimal(20,0))").drop("longer", "key")
    named = scored.select("id", F.posexplode("ids").alias("at", "word_id")).join(words.select(F.col("id").alias("word_id"), "lang", "word"), "word_id")
    named = named.groupBy("id").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))
    named = named.select("id", "lang", F.concat_ws(" ", F.col("w.word")).alias("phrase"))
    found = scored.join(named, "id").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each salt first, so no task sorts a language
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 best phrases over all documents; see `mine_phrases`."""
    return mine_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))
