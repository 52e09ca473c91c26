"""Column functions on RNA and DNA strings; positions are 1-based."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalized(s: Column) -> Column:
    """Upper case without white space, U as T."""
    return F.translate(F.upper(F.regexp_replace(s, r"\s+", "")), "U", "T")


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(F.upper(s), "ACGTU", "TGCAA"))


def guide_seed(guide: Column, length: int = 7) -> Column:
    """Positions 2 to length + 1 of the guide."""
    return F.substring(guide, 2, length)


def target_seed(guide: Column, length: int = 7) -> Column:
    """What a target holds where the guide's seed pairs."""
    return reverse_complement(guide_seed(guide, length))


def mismatches(a: str, b: str) -> Column:
    """Positions at which two columns' strings differ, over the length of the first."""
    return F.expr(f"filter(sequence(1, length({a})), i -> substring({a}, i, 1) <> substring({b}, i, 1))")


#: Pairs (guide base, base of the complemented window) that wobbling forgives: fixed values. "complemented"
#: compares with the complement, so it forgives G opposite A and U opposite C; "true_gu" forgives G and U.
WOBBLE = {"complemented": ("GT", "TG"), "true_gu": ("GA", "TC")}


def guide_mismatches(guide: str, window: str, wobble: str | None = None) -> Column:
    """Mismatches in guide coordinates of a guide and a target window (both 5' to 3').

    wobble: None counts every mismatch; a name of WOBBLE leaves its pairs out.
    """
    keep = ""
    if wobble:
        pairs = ", ".join(f"'{p}'" for p in WOBBLE[wobble])
        keep = f" and substring(x.g, i, 1) || substring(x.r, i, 1) not in ({pairs})"
    # the one-element array binds both strings once, outside the inner lambda
    both = f"array(named_struct('g', translate(upper({guide}), 'U', 'T'), 'r', reverse(translate(upper({window}), 'ACGTU', 'TGCAA'))))"
    return F.expr(f"transform({both}, x -> filter(sequence(1, length(x.g)), i -> substring(x.g, i, 1) <> substring(x.r, i, 1){keep}))[0]")


def wobble_count(guide: str, window: str, wobble: str = "complemented") -> Column:
    return F.size(guide_mismatches(guide, window)) - F.size(guide_mismatches(guide, window, wobble))


def within(positions: Column, low: int, high: int) -> Column:
    """How many positions lie in low to high."""
    return F.size(F.filter(positions, lambda p: p.between(low, high)))


def region(position: Column, seed=(2, 8), central=(9, 12), last: int = 19) -> Column:
    return F.when(position.between(*seed), "seed").when(position.between(*central), "central").when((position == 1) | (position > last), "terminal").otherwise("nonseed")


def duplex_energy(n_mismatches: Column) -> Column:
    """A stand-in, not a physical model: -24 and 2 for each mismatch."""
    return -24.0 + 2.0 * n_mismatches


def accessibility(region_name: Column) -> Column:
    """A stand-in by region: 0.75 in the 3' UTR, 0.55 elsewhere."""
    return F.when(region_name == "3UTR", 0.75).otherwise(0.55)


def local_context(sequence: Column, start: Column, flank: int = 20) -> Column:
    """The bases around a 0-based start, as far as there are any."""
    low = F.greatest(start - flank, F.lit(0))
    return F.substring(sequence, low + 1, start + flank - low)


def sized(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df for a join with a larger table: broadcast if it is seen to have at most `most` rows, else dealt out by key."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


def met_in_parts(rows: DataFrame, table: DataFrame, key: list[str], most: int) -> DataFrame:
    """rows joined with a table on key, which is broadcast at most `most` rows at a time: rows are never shuffled.

    A table that is longer is dealt out by key into parts of about that size, each of which meets all rows.
    """
    parts = -(-table.count() // most)
    if parts <= 1:
        return rows.join(F.broadcast(table), key)
    at = F.pmod(F.xxhash64(*key), F.lit(parts))
    out = None
    for i in range(parts):
        met = rows.where(at == i).join(F.broadcast(table.where(at == i)), key)
        out = met if out is None else out.unionByName(met)
    return out


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix-<24 hex digits> of the parts; nulls count as empty."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(joined, 256), 1, 24))


# --- packed bases: two bits each, so that one XOR compares up to 31 of them -----------------------

#: One low bit of each pair of bits.
PAIRS = 0x1555555555555555
LONGEST = 31


def digits(bases: str) -> str:
    """SQL: a string of bases as digits 0 to 3; other letters, which `strangers` marks, count as A."""
    return f"translate(regexp_replace({bases}, '[^ACGT]', 'A'), 'ACGT', '0123')"


def strangers(bases: str) -> str:
    """SQL: 1 for each letter that isn't a base, else 0; null where there is none, as nearly always."""
    return f"if({bases} rlike '[^ACGT]', regexp_replace(translate(regexp_replace({bases}, '[^ACGT]', 'N'), 'ACGT', '0000'), 'N', '1'), null)"


def packed(base4: str) -> str:
    """SQL: up to LONGEST digits as a long, the last base in the lowest bits."""
    return f"cast(conv({base4}, 4, 10) as bigint)"


def differing(a: str, b: str) -> str:
    """SQL: for two packed strings of one length, one bit for each position at which they differ."""
    x = f"({a} ^ {b})"
    return f"(({x} | shiftrightunsigned({x}, 1)) & {PAIRS})"


def span_mask(length: str, low: int, high: int) -> str:
    """SQL: the bits that `differing` has for positions low to high of a string of that length."""
    return f"({PAIRS} & (shiftleft(1L, greatest(2 * ({length} - {low} + 1), 0)) - shiftleft(1L, greatest(2 * ({length} - {high}), 0))))"


CHUNK = 256


def cut(column: str, start: str, length: int) -> str:
    """SQL: a part of a column of bytes, as a string."""
    return f"cast(substring({column}, {start}, {length}) as string)"


def starts(sequences: DataFrame, k: int, after: int = 32) -> DataFrame:
    """(transcript_id, gene_id, start, chunk, base4, odd, at): every 0-based start of a k-mer.

    chunk holds the bases from a multiple of CHUNK on, as far as `after` bases from the start need, base4 and
    odd the same as `digits` and `strangers`; the start is their position `at` (1-based). They are bytes, as a
    string's substring costs as much as what lies before it; `cut` makes strings of their parts.
    """
    c = sequences.where(F.length("sequence") >= k).select("transcript_id", "gene_id", "sequence", F.expr(f"length(sequence) - {k}").alias("last"), F.expr(f"explode(sequence(0, (length(sequence) - {k}) div {CHUNK}))").alias("c"))
    c = c.select("transcript_id", "gene_id", (F.col("c") * CHUNK).alias("first"), "last", F.expr(f"substring(sequence, c * {CHUNK} + 1, {CHUNK + after})").alias("chunk"))
    c = c.select("transcript_id", "gene_id", "first", "last", *[F.expr(f"cast({e} as binary) as {n}") for n, e in (("chunk", "chunk"), ("base4", digits("chunk")), ("odd", strangers("chunk")))])
    rows = c.select("transcript_id", "gene_id", "first", "chunk", "base4", "odd", F.expr(f"explode(sequence(0, least({CHUNK - 1}, last - first)))").alias("j"))
    return rows.select("transcript_id", "gene_id", (F.col("first") + F.col("j")).cast("int").alias("start"), "chunk", "base4", "odd", (F.col("j") + 1).cast("int").alias("at"))
