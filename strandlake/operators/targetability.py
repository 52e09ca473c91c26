"""Guide-to-transcript sites: scans, site classes, decisions and their audit.

Tables: sequences (transcript_id, gene_id, sequence), guides (sirna_id, guide, passenger, intended_gene).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import rna
from strandlake.plans.policies import TargetabilityPolicy

P = TargetabilityPolicy()
SITE = ["sirna_id", "transcript_id", "gene_id", "start"]


def validate_guides(guides: DataFrame, policy: TargetabilityPolicy = P) -> DataFrame:
    """Adds normalized, search (its reverse complement) and status: ok, or the first rule that is broken."""
    g = guides.withColumn("normalized", rna.normalized(F.col("guide"))).withColumn("raw", F.upper(F.regexp_replace("guide", r"\s+", "")))
    p = F.upper(F.regexp_replace("passenger", r"\s+", ""))
    bad = lambda c: c.contains("U") & c.contains("T")
    status = (
        F.when(F.col("guide").isNull() | (F.col("raw") == ""), "missing_guide")
        .when(~F.col("raw").rlike("^[ACGTU]+$"), "invalid_alphabet")
        .when(bad(F.col("raw")), "mixed_rna_and_dna")
        .when(~F.length("raw").between(policy.min_length, policy.max_length), "unsupported_length")
        .when(p.isNotNull() & (~p.rlike("^[ACGTU]*$") | bad(p)), "invalid_passenger")
        .otherwise("ok")
    )
    return g.withColumn("status", status).withColumn("search", rna.reverse_complement(F.col("normalized"))).drop("raw")


def windows(sequences: DataFrame, length: int, least: int) -> DataFrame:
    """One row per base where a window of at least `least` bases may start: start (0-based), win, code, strange.

    win: up to `length` bases; code: the same packed (see `rna.packed`); strange: bits of letters that are no
    bases. Only the bases of a window leave this projection, never the whole sequence.
    """
    rows = rna.starts(sequences, least, after=length)
    return rows.select("transcript_id", "gene_id", "start", *[F.expr(f"{e} as {n}") for n, e in window_columns(length).items()])


def window_columns(length: int) -> dict[str, str]:
    """SQL of win, code and strange on the rows of `rna.starts`."""
    return {
        "win": rna.cut("chunk", "at", length),
        "code": rna.packed(rna.cut("base4", "at", length)),
        "strange": f"if(odd is null, 0L, {rna.packed(rna.cut('odd', 'at', length))})",
    }


def _guides(guides: DataFrame, policy: TargetabilityPolicy) -> DataFrame:
    """Validated guides with their packed search string and the masks of its regions."""
    ok = validate_guides(guides, policy).where("status = 'ok'").select("sirna_id", "search", F.length("search").alias("n"))
    masks = {"search_code": rna.packed(rna.digits("search")), "seed_mask": rna.span_mask("n", *policy.seed), "central_mask": rna.span_mask("n", *policy.central)}
    return ok.select("*", *[F.expr(f"{e} as {n}") for n, e in masks.items()])


def _classified(hits: DataFrame, policy: TargetabilityPolicy) -> DataFrame:
    """hits: windows and guides, joined. Mismatches are counted as bits, never position by position."""
    surplus = "2 * (length(win) - n)"
    hits = hits.where("length(win) >= n").withColumn("bits", F.expr(f"{rna.differing(f'shiftright(code, {surplus})', 'search_code')} | shiftright(strange, {surplus})"))
    count = {"n_total_mm": "bits", "n_seed_mm": "bits & seed_mask", "n_central_mm": "bits & central_mask", "n_nonseed_mm": "bits & ~(seed_mask | central_mask)"}
    mm = hits.withColumns({n: F.expr(f"bit_count({e})") for n, e in count.items()})
    length = F.col("n")
    priority = (
        F.when(F.col("n_total_mm") == 0, 0)
        .when((F.col("n_total_mm") <= policy.max_total) & (F.col("n_seed_mm") <= policy.max_seed) & (F.col("n_central_mm") <= policy.max_central) & (F.col("n_nonseed_mm") <= policy.max_nonseed), 1)
        .when((F.col("n_seed_mm") <= policy.max_seed) & (F.col("n_total_mm") <= policy.seed_only_max_total) & (length - F.col("n_total_mm") >= policy.seed_only_min_paired), 3)
        .when(F.col("n_total_mm") < length, 4)
    )
    names = {0: "exact_full_length_complement", 1: "near_full_length_complement", 3: "seed_only_candidate"}
    name = F.when(F.col("priority") == 0, names[0]).when(F.col("priority") == 1, names[1]).when(F.col("priority") == 3, names[3]).otherwise("partial_nonseed_match")
    out = mm.withColumn("priority", priority).where("priority is not null").withColumn("site_class", name).withColumn("cleavage", F.col("priority") <= 1)
    return out.select(*SITE, "n_total_mm", "n_seed_mm", "n_central_mm", "n_nonseed_mm", "priority", "site_class", "cleavage", "search", F.expr("substring(win, 1, n) as win"), "n", "bits")


#: Pairs of a guide and a transcript in one task of a scan, at most, and tasks at most.
PAIRS, TASKS = 4_000_000, 20_000


def dealt(sequences: DataFrame, guides: DataFrame) -> DataFrame:
    """sequences dealt out by gene, so that whatever groups a scan's sites by guide and transcript or gene needs no shuffle.

    A gene's transcripts are in one task. There are as many tasks as hold a task's groups to PAIRS, as far as genes go.
    """
    return sequences.repartition(tasks(sequences, guides), "gene_id")


def tasks(sequences: DataFrame, guides: DataFrame) -> int:
    """How many tasks `dealt` deals out to: what else is dealt out so is met without a shuffle."""
    pairs = sequences.count() * guides.count()
    return max(int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-pairs // PAIRS), TASKS))


def scan(sequences: DataFrame, guides: DataFrame, mode: str = "evidence", policy: TargetabilityPolicy = P, own: bool = False) -> DataFrame:
    """Sites of validated guides, dealt out by gene.

    evidence: the windows of the classes exact, near and seed-only, which allow max_seed mismatches in the
    seed: of max_seed + 1 blocks of the seed one is free of them, and joins exactly. A window whose seed block
    no guide has is left out before its bases are cut. complete: every window against every guide, also
    partial matches; its result is guides times bases, so it suits small inputs and parity tests.
    own: only sites on genes that the guide's sirna_id intends; the gene is a join key then, so no others are made.
    """
    keyed, key = _guides(guides, policy), ["kmer"]
    if mode == "complete":
        return _classified(windows(sequences, policy.max_length, policy.min_length).join(keyed), policy)
    if own:
        aims = guides.where("intended_gene is not null").select("sirna_id", F.col("intended_gene").alias("gene_id")).distinct()
        keyed, key = keyed.join(aims, "sirna_id"), ["gene_id", "kmer"]
        sequences = sequences.join(aims.select("gene_id").distinct(), "gene_id", "left_semi").select(*sequences.columns)
    else:
        sequences = dealt(sequences, guides)
    low, high = policy.seed
    ends = [low + (high - low + 1) * i // (policy.max_seed + 1) for i in range(policy.max_seed + 2)]
    out = None
    for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        block = keyed.withColumn("kmer", F.substring("search", a, b - a))
        # at most 4 ** (b - a) different ones, whatever the number of guides: 16384 for the usual seed
        seeds = F.broadcast(block.select("kmer").distinct())
        rows = rna.starts(sequences, policy.min_length, after=policy.max_length).withColumn("kmer", F.expr(rna.cut("chunk", f"at + {a - 1}", b - a)))
        rows = rows.join(seeds, "kmer", "left_semi").select("kmer", "transcript_id", "gene_id", "start", *[F.expr(f"{e} as {n}") for n, e in window_columns(policy.max_length).items()])
        hits = _classified(rows.join(rna.sized(block, 500_000), key), policy)
        for c, d in list(zip(ends, ends[1:], strict=False))[:i]:  # found by an earlier block
            hits = hits.where(F.expr(f"substring(search, {c}, {d - c}) <> substring(win, {c}, {d - c})"))
        out = hits if out is None else out.unionByName(hits)
    return out.where("priority <> 4") if policy.max_seed else out


def site_ids(sites: DataFrame) -> DataFrame:
    return sites.withColumn("site_id", rna.stable_id("site", *[F.col(c) for c in SITE]))


def mismatch_rows(sites: DataFrame, policy: TargetabilityPolicy = P) -> DataFrame:
    """One row per mismatch of a site: position, bases, region, type."""
    rows = sites.select(*SITE, "search", "win", F.explode(rna.mismatches("search", "win")).alias("position"))
    rows = rows.withColumns({"guide_base": F.expr("substring(search, position, 1)"), "target_base": F.expr("substring(win, position, 1)")})
    return rows.select(*SITE, "position", "guide_base", "target_base", rna.region(F.col("position"), policy.seed, policy.central).alias("region"), F.concat_ws(">", "guide_base", "target_base").alias("mismatch_type"))


def alignment_rows(sites: DataFrame, policy: TargetabilityPolicy = P) -> DataFrame:
    """One row per base of a site."""
    rows = sites.select(*SITE, "search", "win", F.explode(F.sequence(F.lit(1), F.length("search"))).alias("position"))
    g, t = F.expr("substring(search, position, 1)"), F.expr("substring(win, position, 1)")
    return rows.select(*SITE, "position", g.alias("guide_base"), t.alias("target_base"), (g == t).alias("paired"), rna.region(F.col("position"), policy.seed, policy.central).alias("region"))


def alignment_profile(sites: DataFrame, policy: TargetabilityPolicy = P) -> DataFrame:
    """(position, region, paired, n): the rows of alignment_rows counted, without making them.

    Sites are counted by their mismatch bits first: with 21 bases and no mismatch in the seed at most 16,384 patterns.
    """
    patterns = sites.groupBy("n", "bits").agg(F.count("*").alias("times"))
    rows = patterns.select("n", "bits", "times", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("position"))
    paired = F.expr("(shiftrightunsigned(bits, 2 * (n - position)) & 1) = 0")
    return rows.groupBy("position", rna.region(F.col("position"), policy.seed, policy.central).alias("region"), paired.alias("paired")).agg(F.sum("times").alias("n"))


#: A ranking as one long: priority, three counts of mismatches below 64, and a start below 2 ** 31.
RANK = "(((cast(priority as bigint) * 64 + n_total_mm) * 64 + n_seed_mm) * 64 + n_central_mm) * 2147483648L"


def best_sites(sites: DataFrame, mismatches: bool = False) -> DataFrame:
    """Per guide and transcript: counts by class, the best ranking (priority, total, seed, central, start), whether it is tied, decision.

    Only bounded aggregates of longs, which are hashed and never sorted: the best ranking with its first start and
    with its last one, which differ if it is tied. mismatches: adds n_mismatches, those of all its sites.
    """
    out = sites.groupBy("sirna_id", "transcript_id", "gene_id").agg(
        F.count("*").alias("n_sites"),
        F.count_if(F.col("priority") == 0).alias("n_exact"),
        F.count_if(F.col("priority") == 1).alias("n_near"),
        F.count_if(F.col("priority") == 3).alias("n_seed_only"),
        F.count_if(F.col("priority") == 4).alias("n_partial"),
        F.min(F.expr(f"{RANK} + start")).alias("best"),
        F.min(F.expr(f"{RANK} + 2147483647L - start")).alias("last"),
        *([F.sum("n_total_mm").alias("n_mismatches")] if mismatches else []),
    )
    decision = F.when(F.col("n_exact") + F.col("n_near") > 0, "cleavage_candidate_present").when(F.col("n_seed_only") > 0, "seed_only_candidate_present").otherwise("indeterminate")
    start = "cast({} & 2147483647L as int)"
    tied = F.expr(f"{start.format('best')} <> 2147483647 - {start.format('last')}")
    out = out.withColumn("decision", decision).withColumn("tied", tied).withColumn("best_start", F.expr(start.format("best"))).withColumn("best_priority", F.expr("cast(shiftright(best, 49) as int)"))
    return out.select("sirna_id", "transcript_id", "gene_id", "n_sites", "n_exact", "n_near", "n_seed_only", "n_partial", "best_start", "best_priority", "tied", "decision", *(["n_mismatches"] if mismatches else []))


def with_absent(best: DataFrame, wanted: DataFrame, sequences: DataFrame) -> DataFrame:
    """Decisions for all wanted (sirna_id, transcript_id): no_supported_site or sequence_unavailable where nothing was found."""
    known = sequences.where("sequence is not null and sequence <> ''").select("transcript_id", F.lit(True).alias("known"))
    out = wanted.join(known, "transcript_id", "left").join(best.drop("gene_id"), ["sirna_id", "transcript_id"], "left")
    status = F.when(F.col("known").isNull(), "sequence_unavailable").otherwise(F.coalesce("decision", F.lit("no_supported_site")))
    return out.withColumn("decision", status).withColumn("sequence_available", F.col("known").isNotNull()).drop("known")


def missing_sequences(eligible: DataFrame, sequences: DataFrame, policy: str = "record_unavailable") -> tuple[DataFrame, DataFrame]:
    """(eligible transcripts to evaluate, failures). fail_gene takes a gene's other transcripts out with it."""
    missing = eligible.join(sequences.where("sequence is not null and sequence <> ''"), "transcript_id", "left_anti")
    if policy == "fail_stage":
        if missing.limit(1).count():
            raise ValueError("eligible transcripts without a sequence")
        return eligible, missing.withColumn("reason", F.lit("missing_sequence"))
    if policy == "fail_gene":
        failed = missing.groupBy("gene_id").agg(F.count("*").alias("n_missing")).withColumn("reason", F.lit("gene_failed_targetability"))
        return eligible.join(failed, "gene_id", "left_anti"), failed
    return eligible.join(missing, "transcript_id", "left_anti"), missing.withColumn("reason", F.lit("sequence_unavailable"))


def sequence_issues(sequences: DataFrame, annotation: DataFrame) -> DataFrame:
    """(check, transcript_id): duplicates, genes that differ from the annotation's, missing eligible ones, foreign letters."""
    one = lambda df, name: df.select(F.lit(name).alias("check"), "transcript_id")
    twice = sequences.groupBy("transcript_id").count().where("count > 1")
    gene = sequences.join(annotation.select("transcript_id", F.col("gene_id").alias("gene2")), "transcript_id").where("gene_id <> gene2")
    absent = annotation.join(sequences.where("sequence <> ''"), "transcript_id", "left_anti")
    letters = sequences.where(~F.col("sequence").rlike("^[ACGT]*$"))
    return one(twice, "duplicate").unionByName(one(gene, "wrong_gene")).unionByName(one(absent, "missing")).unionByName(one(letters, "alphabet"))


def intended_targets(guides: DataFrame, sites: DataFrame, classes=("exact_full_length_complement", "near_full_length_complement"), max_total: int = 2) -> DataFrame:
    """Per guide: its sites on the intended gene, accepted ones and why others were rejected."""
    own = guides.select("sirna_id", F.col("intended_gene").alias("gene_id"))
    met = sites.join(rna.sized(own), ["sirna_id", "gene_id"])  # of all sites only these go on
    names = {"class": ~F.col("site_class").isin(*classes), "total": F.col("n_total_mm") > max_total, "seed": F.col("n_seed_mm") > 0, "central": F.col("n_central_mm") > 0}
    good = ~(names["class"] | names["total"] | names["seed"] | names["central"])
    met = met.groupBy("sirna_id", "gene_id").agg(F.count("site_class").alias("n_candidates"), F.count_if(good).alias("n_accepted"), *[F.count_if(t).alias(f"no_{k}") for k, t in names.items()])
    out = own.distinct().join(met, ["sirna_id", "gene_id"], "left").fillna({"n_candidates": 0, "n_accepted": 0})
    reasons = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"no_{k}") > 0, F.lit(k)) for k in names])))
    out = out.select("sirna_id", "gene_id", "n_candidates", "n_accepted", reasons.alias("rejection_reasons"))
    return out.withColumn("status", F.when(F.col("n_accepted") > 0, "accepted").when(F.col("n_candidates") > 0, "rejected").otherwise("no_candidate_site"))


def summary(best: DataFrame) -> DataFrame:
    """(metric, value) over all sites and decisions, from best_sites with its mismatches: sites are neither stored nor made twice."""
    decided = lambda s: F.count_if(F.col("decision") == s)
    total = lambda *names: sum((F.coalesce(F.sum(n), F.lit(0)) for n in names[1:]), F.coalesce(F.sum(names[0]), F.lit(0)))
    one = best.agg(
        total("n_sites").alias("sites"), total("n_exact").alias("exact_sites"), total("n_near").alias("near_sites"), total("n_seed_only").alias("seed_only_sites"), total("n_partial").alias("partial_sites"),
        total("n_exact", "n_near").alias("cleavage_sites"), F.count_distinct("sirna_id").alias("guides_with_site"), F.count_distinct("gene_id").alias("genes_with_site"), total("n_mismatches").alias("mismatches"),
        F.count("*").alias("pairs"), decided("cleavage_candidate_present").alias("cleavage_pairs"), decided("seed_only_candidate_present").alias("seed_only_pairs"), F.count_if("tied").alias("tied_pairs"),
    )
    return one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(x) for x in one.columns]), F.array(*[F.col(x).cast("long") for x in one.columns]))).alias("metric", "value"))
