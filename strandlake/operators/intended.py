"""Whether a guide meets its intended target: requests judged under many policies in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.plans.policies import IntendedTargetPolicy

# fixed values: names of errors, warnings and reasons
MISSING = "intended_target_input_missing"
IDS_REQUIRED = "intended_target_transcript_ids_required"
GENE_FAILED = "intended_target_gene_failed:"
TRANSCRIPT_MISSING = "intended_target_transcript_missing:"
NO_SEQUENCE = "intended_target_sequence_unavailable:"
GENE_ONLY = "gene_only_intended_target_not_allowed"
NO_SITE = "intended_target_no_acceptable_site"
NO_GENE_SITE = "intended_target_gene_no_acceptable_site:"
UNRESOLVED = "intended target supplied only at gene level; isoform identity unresolved"
ANY = "accept_any_gene_transcript_site"


def _policies(policies: dict[str, IntendedTargetPolicy]) -> Column:
    rows = [
        F.struct(
            F.lit(name).alias("policy"),
            F.lit(p.required).alias("required"),
            F.lit(p.transcripts_required).alias("ids_required"),
            F.lit(p.gene_only).alias("gene_only"),
            F.lit(p.on_failure).alias("on_failure"),
            F.array(*[F.lit(c) for c in p.classes]).cast("array<string>").alias("classes"),
            *[F.lit(getattr(p, n)).alias(n) for n in ("max_total", "max_seed", "max_central")],
        )
        for name, p in policies.items()
    ]
    return F.explode(F.array(*rows)).alias("p")


def _if(test: Column, value: Column | str) -> Column:
    return F.when(test, F.lit(value) if isinstance(value, str) else value)


def named_transcripts(requests: DataFrame, evidence: DataFrame, failed: DataFrame) -> DataFrame:
    """(request_id, sirna_id, transcript_id, gene_id, finding) of each transcript that a request names, each once.

    finding: missing, gene_failed, unavailable or available; the first that holds.
    """
    known = evidence.groupBy("sirna_id", "transcript_id").agg(F.min("gene_id").alias("gene_id"), F.max("sequence_available").alias("ok"), F.lit(True).alias("seen"))
    named = requests.select("request_id", "sirna_id", F.explode(F.array_distinct("transcript_ids")).alias("transcript_id")).where("transcript_id is not null")
    bad = failed.select("gene_id", F.lit(True).alias("bad")).distinct()
    rows = named.join(known, ["sirna_id", "transcript_id"], "left").join(bad, "gene_id", "left")
    finding = F.when(F.col("seen").isNull(), "missing").when(F.col("bad"), "gene_failed").when(F.coalesce("ok", F.lit(False)), "available").otherwise("unavailable")
    return rows.select("request_id", "sirna_id", "transcript_id", "gene_id", finding.alias("finding"))


def judge_sites(found: DataFrame, policies: dict[str, IntendedTargetPolicy], by: str) -> DataFrame:
    """Per `by` and policy: candidate and accepted sites, why others were rejected, and the best accepted one.

    Only bounded aggregates: reasons are four, and of the accepted sites the smallest ranking stays.
    """
    c = F.col
    rows = found.select("*", _policies(policies))
    tests = {
        "evidence_class_not_accepted": ~F.array_contains("p.classes", c("site_class")),
        "total_mismatch_threshold_exceeded": c("n_total_mm") > c("p.max_total"),
        "seed_mismatch_threshold_exceeded": c("n_seed_mm") > c("p.max_seed"),
        "central_mismatch_threshold_exceeded": c("n_central_mm") > c("p.max_central"),
    }
    rows = rows.withColumns({f"no{i}": F.coalesce(t, F.lit(True)) for i, t in enumerate(tests.values())})
    good = ~reduce(lambda a, b: a | b, [c(f"no{i}") for i in range(len(tests))])
    rank = F.struct("priority", "n_total_mm", "n_seed_mm", "n_central_mm", "start", "transcript_id")
    out = rows.groupBy(by, c("p.policy").alias("policy")).agg(
        F.count("*").alias("n_candidates"),
        F.count_if(good).alias("n_accepted"),
        F.min(F.when(good, rank)).alias("best"),
        *[F.count_if(f"no{i}").alias(f"no{i}") for i in range(len(tests))],
    )
    reasons = F.array_compact(F.array(*[F.when(c(f"no{i}") > 0, name) for i, name in enumerate(tests)]))
    return out.select(by, "policy", "n_candidates", "n_accepted", reasons.alias("rejection_reasons"), c("best.transcript_id").alias("best_transcript"), c("best.start").alias("best_start"))


def validate(requests: DataFrame, evidence: DataFrame, sites: DataFrame, failed: DataFrame, policies: dict[str, IntendedTargetPolicy]) -> DataFrame:
    """One row per request and policy: what was supplied, sites, status, behaviour, errors and warnings.

    requests: (request_id, sirna_id, gene_id, transcript_ids), the gene and the transcripts may be null or none;
    request_id is unique. evidence: (sirna_id, transcript_id, gene_id, sequence_available) of the transcripts that
    were looked at; repeated rows are one. sites: of `scan`. failed: (gene_id) that the stage gave up.
    A request that names transcripts is judged by their sites. One that names a gene alone is refused, warned of,
    left uncertain, or judged by all sites of the gene, as the policy says. Errors fail the request, or warn, or keep
    it as invalid. Errors are sorted, each once. Empty tables give no rows.
    """
    c = F.col
    requests = requests.select("request_id", "sirna_id", "gene_id", F.coalesce("transcript_ids", F.array().cast("array<long>")).alias("transcript_ids"))
    named = named_transcripts(requests, evidence, failed)
    told = F.when(c("finding") == "missing", F.concat(F.lit(TRANSCRIPT_MISSING), "transcript_id"))
    told = told.when(c("finding") == "gene_failed", F.concat(F.lit(GENE_FAILED), "gene_id")).when(c("finding") == "unavailable", F.concat(F.lit(NO_SEQUENCE), "transcript_id"))
    findings = named.groupBy("request_id").agg(F.collect_set(told).alias("found_errors"))  # at most as many as a request names

    keys = ["sirna_id", "transcript_id"]
    columns = ["site_class", "priority", "n_total_mm", "n_seed_mm", "n_central_mm", "start"]
    by_name = named.where("finding = 'available'").select("request_id", *keys).join(sites.select(*keys, *columns), keys)
    bad = failed.select("gene_id").distinct()
    whole = requests.where("size(transcript_ids) = 0 and gene_id is not null").select("request_id", "sirna_id", "gene_id")
    usable = evidence.where("sequence_available").select("sirna_id", "gene_id", "transcript_id").distinct().join(bad, "gene_id", "left_anti")
    by_gene = whole.join(usable, ["sirna_id", "gene_id"]).select("request_id", *keys).join(sites.select(*keys, *columns), keys)
    open_gene = {n: p for n, p in policies.items() if p.gene_only == ANY}
    judged = judge_sites(by_name, policies, "request_id")
    if open_gene:
        judged = judged.unionByName(judge_sites(by_gene, open_gene, "request_id"))

    out = requests.select("*", _policies(policies)).withColumn("policy", c("p.policy"))
    out = out.join(judged, ["request_id", "policy"], "left").join(findings, "request_id", "left").join(bad.withColumn("gene_bad", F.lit(True)), "gene_id", "left")
    out = out.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("n_candidates", "n_accepted")})
    ids, gene = F.size("transcript_ids") > 0, c("gene_id").isNotNull()
    supplied = F.when(ids, "transcript_ids_supplied").when(gene, "gene_only").when(c("p.required"), "missing_required").otherwise("not_requested")
    any_site = c("p.gene_only") == ANY
    alone = ~ids & gene
    errors = F.array(
        _if(c("p.required") & ~ids & ~gene, MISSING),
        _if(c("p.ids_required") & ~ids, IDS_REQUIRED),
        _if(c("gene_bad"), F.concat(F.lit(GENE_FAILED), "gene_id")),
        _if(alone & (c("p.gene_only") == "fail_stage"), GENE_ONLY),
        _if((ids | any_site) & (c("n_candidates") > 0) & (c("n_accepted") == 0), NO_SITE),
        _if(any_site & gene & (c("n_candidates") == 0), F.concat(F.lit(NO_GENE_SITE), "gene_id")),
    )
    errors = F.array_sort(F.array_distinct(F.concat(F.array_compact(errors), F.coalesce("found_errors", F.array().cast("array<string>")))))
    out = out.withColumn("supplied", supplied)
    asked = c("supplied") != "not_requested"
    out = out.withColumn("errors", F.when(asked, errors).otherwise(F.array().cast("array<string>")))
    soft = alone & c("p.gene_only").isin("warning", "preserve_uncertainty")
    wrong, accepted = F.size("errors") > 0, c("n_accepted") > 0
    status = F.when(~asked, "not_requested").when(wrong & (c("p.on_failure") == "warning"), "warning").when(wrong & (c("p.on_failure") == "preserve_invalid_with_status"), "invalid_preserved").when(wrong, "failed")
    status = status.when(accepted, "passed").when(alone & (c("p.gene_only") == "warning"), "warning").when(alone & (c("p.gene_only") == "preserve_uncertainty"), "uncertain").otherwise("passed")
    behaviour = F.when(wrong, c("p.on_failure")).when(~accepted & alone & (c("p.gene_only") == "warning"), "warning").otherwise("none")
    return out.select(
        "request_id", "policy", "sirna_id", "gene_id", "supplied", "n_candidates", "n_accepted", (c("n_candidates") - c("n_accepted")).alias("n_rejected"),
        F.coalesce("rejection_reasons", F.array().cast("array<string>")).alias("rejection_reasons"), "best_transcript", "best_start",
        status.alias("status"), behaviour.alias("behaviour"), "errors", F.when(asked & soft, F.array(F.lit(UNRESOLVED))).otherwise(F.array().cast("array<string>")).alias("warnings"),
    )
