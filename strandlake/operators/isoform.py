"""Transcript eligibility, prior weights and targetable fractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.plans.policies import TranscriptPolicy

#: Biotypes with a switch of their own: fixed values.
NAMED = ("protein_coding", "retained_intron", "nonsense_mediated_decay", "processed_transcript", "readthrough_transcript")


def exclusion_reason(policy: TranscriptPolicy = TranscriptPolicy(), organism: str = "human", assembly: str = "GRCh38") -> Column:
    """The first rule that excludes a transcript, or null; the order of the rules is part of the result."""
    c, bio = F.col, F.col("biotype")
    rules = [
        (~c("organism").eqNullSafe(organism), "organism_mismatch"),
        (~c("assembly").eqNullSafe(assembly), "assembly_mismatch"),
        (c("gene_id").isNull(), "unresolved_gene_mapping"),
        (c("transcript_id").isNull(), "unresolved_transcript_mapping"),
        (c("ambiguous"), "ambiguous_transcript_mapping"),
        (F.lit(policy.require_sequence_reference) & c("sequence_reference").isNull(), "missing_sequence_reference"),
        (F.lit(not policy.allow_deprecated) & c("deprecated"), "deprecated_transcript"),
        (F.lit(not policy.allow_alternative_contigs) & c("alternative_contig"), "alternative_contig"),
    ]
    for name in NAMED[:-1]:
        if not getattr(policy, f"include_{name}"):
            rules.append((bio == name, f"{name}_excluded"))
    if not policy.include_pseudogene:
        rules.append((bio.endswith("pseudogene"), "pseudogene_transcript_excluded"))
    if not policy.include_readthrough:
        rules.append((bio == "readthrough_transcript", "readthrough_transcript_excluded"))
    if not policy.include_noncoding:
        rules.append((~bio.isin(*NAMED) & ~bio.endswith("pseudogene"), "noncoding_transcript_excluded"))
    if policy.support_levels is not None:
        rules.append((~F.coalesce(c("support_level").isin(*policy.support_levels), F.lit(False)), "transcript_support_level_excluded"))
    out = F.lit(None).cast("string")
    for test, name in reversed(rules):
        out = F.when(test, name).otherwise(out)
    return out


def eligibility(annotation: DataFrame, policy: TranscriptPolicy = TranscriptPolicy()) -> DataFrame:
    return annotation.withColumn("exclusion", exclusion_reason(policy)).withColumn("eligible", F.col("exclusion").isNull())


def genes_to_annotation(genes: DataFrame, annotation: DataFrame) -> DataFrame:
    """Genes met by canonical or original gene id: two equi-joins and a distinct instead of an OR."""
    a = genes.select(F.col("gene_id").alias("wanted_gene"))
    one = a.join(annotation, F.col("wanted_gene") == F.col("gene_id"))
    two = a.join(annotation, F.col("wanted_gene") == F.col("original_gene_id"))
    return one.unionByName(two).dropDuplicates(["wanted_gene", "transcript_id"])


def snapshot_issues(annotation: DataFrame, organism: str = "human", assembly: str = "GRCh38") -> DataFrame:
    """One row of counts that validate an annotation."""
    return annotation.agg(
        F.count("*").alias("total_rows"), F.count_distinct("gene_id").alias("unique_genes"), F.count_distinct("transcript_id").alias("unique_transcripts"), F.count_if(~F.col("organism").eqNullSafe(organism)).alias("organism_conflicts"),
        F.count_if(~F.col("assembly").eqNullSafe(assembly)).alias("assembly_conflicts"), F.count_if(F.col("gene_id").isNull()).alias("unresolved_genes"), F.count_if(F.col("sequence_reference").isNull()).alias("missing_sequence_references"),
    )


def equal_weights(eligible: DataFrame) -> DataFrame:
    """1/N for each of a gene's N eligible transcripts: one aggregate and a join, so a gene's rows need not meet in a window."""
    n = eligible.groupBy("gene_id").agg(F.count("*").alias("n_total"))
    return eligible.join(n, "gene_id").withColumn("weight", 1.0 / F.col("n_total"))


def external_issues(external: DataFrame, eligible: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(gene_id, issue) of external proportions (gene_id, transcript_id, proportion) against eligible transcripts."""
    e = external.alias("e")
    twice = external.groupBy("gene_id", "transcript_id").count().where("count > 1").select("gene_id", F.lit("duplicate").alias("issue"))
    known = eligible.select("transcript_id", F.col("gene_id").alias("own_gene"))
    placed = e.join(known, "transcript_id", "left")
    stranger = placed.where("own_gene is null").select("gene_id", F.lit("not_eligible").alias("issue"))
    wrong = placed.where("own_gene <> gene_id").select("gene_id", F.lit("wrong_gene").alias("issue"))
    absent = eligible.join(external, ["gene_id", "transcript_id"], "left_anti").join(external.select("gene_id").distinct(), "gene_id").select("gene_id", F.lit("missing").alias("issue"))
    total = external.groupBy("gene_id").agg(F.sum("proportion").alias("s")).where(F.abs(F.col("s") - 1) > tolerance).select("gene_id", F.lit("sum_not_one").alias("issue"))
    return twice.unionByName(stranger).unionByName(wrong).unionByName(absent).unionByName(total).distinct()


def external_weights(external: DataFrame, eligible: DataFrame, renormalize: bool = True, missing_as_zero: bool = False) -> DataFrame:
    """Weights from external proportions; what is missing is null or 0, the rest is scaled to 1 if asked."""
    out = eligible.join(external.select("gene_id", "transcript_id", "proportion"), ["gene_id", "transcript_id"], "left")
    value = F.coalesce("proportion", F.lit(0.0)) if missing_as_zero else F.col("proportion")
    out = out.withColumn("value", value)
    total = F.sum("value").over(Window.partitionBy("gene_id"))
    return out.withColumn("weight", F.when(total > 0, F.col("value") / total) if renormalize else F.col("value")).drop("value")


def gene_uncertainty(annotation: DataFrame, policy: TranscriptPolicy = TranscriptPolicy(), external: DataFrame | None = None) -> DataFrame:
    """Per gene: counts, mode and status; invalid external proportions fall back to equal priors."""
    e = eligibility(annotation, policy).where("gene_id is not null")
    out = e.groupBy("gene_id").agg(F.count_if("eligible").alias("n_eligible"), F.count_if(~F.col("eligible")).alias("n_excluded"), F.array_sort(F.collect_set("exclusion")).alias("reasons"))
    if external is None:
        out = out.withColumn("bad", F.lit(None).cast("boolean")).withColumn("given", F.lit(False))
    else:
        bad = external_issues(external, e.where("eligible")).select("gene_id").distinct().withColumn("bad", F.lit(True))
        given = external.select("gene_id").distinct().withColumn("given", F.lit(True))
        out = out.join(bad, "gene_id", "left").join(given, "gene_id", "left")
    mode = F.when(F.col("n_eligible") == 0, "no_eligible_transcripts").when(F.coalesce("given", F.lit(False)) & F.col("bad").isNull(), "external_proportions").when(F.col("bad"), "equal_prior_fallback").otherwise("equal_prior")
    return out.withColumn("mode", mode).drop("bad", "given")


def targetable_fraction(control: Column, treated: Column, low: float, high: float) -> Column:
    """struct(lower, upper): the fraction that a knock-down efficiency between low and high would explain, in [0, 1]."""
    drop = 1 - treated / control
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return F.when(control > 0, F.struct(clamp(drop / high).alias("lower"), clamp(drop / low).alias("upper")))


def efficiency_grid(low: float, high: float, step: float) -> Column:
    """array of efficiencies from low to high, rounded to 6 places."""
    n = int(round((high - low) / step))
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.round(low + i * step, 6))


def equal_transcript_prior(m: Column, n: Column) -> Column:
    return F.when((n > 0) & m.between(0, n), m / n)
