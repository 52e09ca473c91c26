"""Calibration, expected direct effects, residuals, integration of evidence and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.plans.policies import EffectPolicy

P = EffectPolicy()
KEY = ["run_key", "gene_id"]


def expression_by_gene(effects: DataFrame) -> DataFrame:
    """(lookup, effect, ...): each row under its canonical id, symbol and original id; the first record, then key, wins."""
    keys = effects.select("*", F.posexplode(F.array_compact(F.array("canonical_gene_id", "symbol", "original_gene_id"))).alias("nth", "lookup"))
    first = F.min_by(F.struct("canonical_gene_id", "original_gene_id", "effect"), F.struct("input_order", "nth"))
    return keys.groupBy("lookup").agg(first.alias("r")).select("lookup", "r.*")


def calibrate(targets: DataFrame, effects: DataFrame, ratios: DataFrame, policy: EffectPolicy = P) -> DataFrame:
    """Per run: k = (1 - 2^lfc) / (M/N) of the intended target, and how sure it is.

    targets: (run_key, gene_id of the intended target); effects: (run_key, gene_id, lfc); ratios:
    (run_key, gene_id, n_total, m_targetable, ratio, ratio_status).
    """
    tol = policy.tolerance
    rows = targets.join(effects.select(*KEY, "lfc", F.lit(True).alias("has_expression")), KEY, "left").join(ratios.select(*KEY, "n_total", "m_targetable", "ratio", "ratio_status"), KEY, "left")
    raw = (1 - F.pow(F.lit(2.0), F.col("lfc"))) / F.col("ratio")
    rows = rows.withColumn("raw_k", F.when((F.col("ratio") > 0) & F.col("lfc").isNotNull(), raw))
    no_ratio = (F.col("ratio_status") != "definitive") | (F.col("n_total") <= 0) | F.col("m_targetable").isNull() | F.col("ratio").isNull() | (F.col("ratio") <= 0)
    status = (
        F.when(F.col("has_expression").isNull(), "unavailable_missing_expression")
        .when(F.col("ratio_status").isNull(), "unavailable_invalid_intended_target")
        .when(no_ratio, "unavailable_intended_target_ratio")
        .when(F.col("lfc").isNull(), "unavailable_missing_expression")
        .when(F.abs("lfc") <= tol, "definitive_zero_no_decrease")
        .when(F.col("lfc") > 0, "unavailable_not_decreased")
        .when((F.col("raw_k") < -tol) | (F.col("raw_k") > 1 + tol), "unavailable_inconsistent_calibration")
        .otherwise("definitive")
    )
    rows = rows.withColumn("calibration_status", status)
    k = F.when(F.col("calibration_status") == "definitive_zero_no_decrease", 0.0).when(F.col("calibration_status") == "definitive", F.when(F.abs(F.col("raw_k")) <= tol, 0.0).when(F.abs(F.col("raw_k") - 1) <= tol, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("raw_k")))))
    return rows.select("run_key", F.col("gene_id").alias("target_gene"), "calibration_status", k.alias("k"))


def expected(ratios: DataFrame, effects: DataFrame, calibration: DataFrame, policy: EffectPolicy = P) -> DataFrame:
    """Per gene with a ratio: log2(1 - k * M/N), -Infinity where nothing would be left, and observed minus expected.

    effects: (gene_id, lfc) for all runs, or with run_key too.
    """
    key = [k for k in KEY if k in effects.columns]
    rows = ratios.join(effects.select(*key, "lfc"), key, "left").join(calibration.select("run_key", "k", "calibration_status"), "run_key", "left")
    rows = rows.withColumn("left", 1 - F.col("k") * F.col("ratio"))
    status = F.when(F.col("lfc").isNull(), "unavailable_missing_expression").when(F.col("ratio_status") != "definitive", "unavailable_ratio").when(F.col("k").isNull() | (F.col("left") < -policy.tolerance), "unavailable_calibration").otherwise("definitive")
    rows = rows.withColumn("effect_status", status)
    value = F.when(F.col("effect_status") == "definitive", F.when(F.col("left") <= 0, float("-inf")).otherwise(F.log2("left")))
    return rows.withColumn("expected", value).withColumn("residual", F.col("lfc") - F.col("expected")).drop("left")


def unresolved(rows: DataFrame, status: str, good: str = "definitive") -> DataFrame:
    return rows.where(f"{status} <> '{good}'").select(*KEY, F.col(status).alias("reason"))


def close(c: Column, to: float, tol: float) -> Column:
    return F.abs(c - to) <= tol


def support(paths: DataFrame) -> DataFrame:
    """Per run and gene: supporting paths, by kind. paths: (run_key, gene_id, path_id, kind)."""
    n = paths.groupBy(*KEY, "kind").agg(F.count_distinct("path_id").alias("n"))
    return n.groupBy(*KEY).agg(F.sum("n").alias("support_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("support_kinds"))


def residuals(rows: DataFrame, supports: DataFrame | None = None, pathway_available: bool | Column = True, policy: EffectPolicy = P) -> DataFrame:
    """Direction, band and pathway support of each residual; rows need effect_status, residual, and support_count without
    supports. pathway_available may be a column of rows."""
    r = F.col("residual")
    out = rows if supports is None else rows.join(supports.select(*KEY, "support_count"), KEY, "left")
    out = out.withColumn("support_count", F.coalesce("support_count", F.lit(0)))
    known = F.col("effect_status") == "definitive"
    direction = F.when(close(r, 0.0, policy.tolerance), "matches_expected_direct_effect").when(r < 0, "more_decreased_than_expected").when(r.isNotNull(), "less_decreased_or_increased_than_expected")
    size = F.abs(r)
    magnitude = F.when(size <= policy.negligible, "negligible_residual").when(size < policy.weak, "weak_residual").when(size < policy.moderate, "moderate_residual").when(size.isNotNull(), "strong_residual")
    out = out.withColumns({"residual_direction": F.when(known, direction), "residual_magnitude": F.when(known, magnitude)})
    n = F.col("support_count")
    status = (
        F.when(~known, "unresolved_upstream_expected_effect")
        .when(F.col("residual_magnitude") == "negligible_residual", "no_residual_to_attribute")
        .when(~(F.lit(pathway_available) if isinstance(pathway_available, bool) else pathway_available), "unresolved_missing_pathway_evidence")
        .when(n <= 0, "residual_without_pathway_support")
        .when(n >= policy.strong_support, "residual_with_strong_pathway_support")
        .when(n >= policy.moderate_support, "residual_with_moderate_pathway_support")
        .otherwise("residual_with_weak_pathway_support")
    )
    return out.withColumn("support_status", status)


def integrate(rows: DataFrame, policy: EffectPolicy = P) -> DataFrame:
    """The four evidence components of a gene and whether they are ready for a label."""
    sequence = F.when(F.col("ratio_status").isNull(), "unavailable_targetability").when((F.col("ratio_status") != "definitive") | F.col("n_total").isNull(), "unresolved_targetability").when((F.col("m_targetable") > 0) | (F.col("ratio") > 0), "definitive_targetable_fraction_present").otherwise("no_cleavage_compatible_targetability")
    direct = F.when(F.col("expected").isNull(), "expected_direct_effect_unavailable").when(close(F.col("expected"), 0.0, policy.tolerance), "expected_direct_effect_zero").otherwise("expected_direct_effect_nonzero")
    m = F.col("residual_magnitude")
    residual = F.when(F.col("residual").isNull() | m.isNull(), "unresolved_residual_evidence").when(m == "negligible_residual", "no_residual_to_integrate").otherwise(F.concat(m, F.lit("_evidence")))
    out = rows.withColumns({"sequence_component": sequence, "expected_component": direct, "residual_component": residual, "pathway_component": F.col("support_status")})
    readiness = (
        F.when(F.col("pathway_component") == "unresolved_upstream_expected_effect", "unresolved_upstream_residual_attribution")
        .when(F.col("expected_component") == "expected_direct_effect_unavailable", "insufficient_expected_effect_evidence")
        .when(F.col("sequence_component").isin("unresolved_targetability", "unavailable_targetability"), "ready_with_unresolved_targetability")
        .when(F.col("residual_component") == "unresolved_residual_evidence", "insufficient_residual_evidence")
        .when((F.col("residual_component") != "no_residual_to_integrate") & (F.col("pathway_component") == "unresolved_missing_pathway_evidence"), "ready_with_unresolved_pathway_context")
        .otherwise("ready_for_final_classification")
    )
    return out.withColumn("readiness", readiness)


def classify(rows: DataFrame, policy: EffectPolicy = P) -> DataFrame:
    """label, reason and confidence; the order of the rules is part of the result."""
    c = F.col
    open_seq = c("sequence_component").isin("unresolved_targetability", "unavailable_targetability")
    targetable = c("sequence_component") == "definitive_targetable_fraction_present"
    negligible = c("residual_component") == "no_residual_to_integrate"
    big = c("residual_component").isin("moderate_residual_evidence", "strong_residual_evidence")
    strong = c("residual_component") == "strong_residual_evidence"
    path = c("pathway_component").isin("residual_with_moderate_pathway_support", "residual_with_strong_pathway_support")
    strong_path = c("pathway_component") == "residual_with_strong_pathway_support"
    nothing = c("expected_component").isin("expected_direct_effect_zero", "expected_direct_effect_unavailable")
    nonzero = c("expected_component") == "expected_direct_effect_nonzero"
    quiet = F.coalesce(F.abs(c("lfc")) <= policy.tolerance, F.lit(True))
    missing_path = c("pathway_component") == "unresolved_missing_pathway_evidence"
    rules = [
        (c("readiness") == "unresolved_upstream_residual_attribution", "unresolved", "unresolved_upstream_secondary_evidence_integration"),
        (c("readiness") == "insufficient_expected_effect_evidence", "unresolved", "insufficient_expected_effect"),
        (open_seq & negligible & nothing & quiet, "no_evidence_for_effect", "unresolved_targetability_with_negligible_no_effect_evidence"),
        (open_seq, "unresolved", "unresolved_targetability"),
        (negligible & nothing, "no_evidence_for_effect", "negligible_residual_and_no_expected_direct_effect"),
        (targetable & big & path, "mixed_supported", "direct_compatible_evidence_with_residual_pathway_support"),
        (big & path & (c("sequence_component") == "no_cleavage_compatible_targetability"), "secondary_supported", "residual_pathway_support_without_cleavage_compatible_targetability"),
        (targetable & nonzero & c("residual_component").isin("no_residual_to_integrate", "weak_residual_evidence") & c("support_status").isin("no_residual_to_attribute", "residual_without_pathway_support"), "direct_compatible", "targetability_and_expected_effect_consistent_with_observed_change"),
        (~negligible & missing_path, "unresolved", "unresolved_pathway_context"),
        (~negligible & (c("pathway_component") == "residual_without_pathway_support"), "unresolved", "residual_without_pathway_support"),
    ]
    decision = F.struct(F.lit("unresolved").alias("label"), F.lit("conservative_unresolved").alias("reason"))
    for test, label, reason in reversed(rules):
        decision = F.when(test, F.struct(F.lit(label).alias("label"), F.lit(reason).alias("reason"))).otherwise(decision)
    out = rows.withColumn("d", decision).withColumns({"label": c("d.label"), "reason": c("d.reason")}).drop("d")
    any_open = open_seq | (c("expected_component") == "expected_direct_effect_unavailable") | (c("residual_component") == "unresolved_residual_evidence") | c("pathway_component").isin("unresolved_missing_pathway_evidence", "unresolved_upstream_expected_effect") | (c("readiness") != "ready_for_final_classification")
    confidence = (
        F.when(c("label") == "unresolved", "unresolved")
        .when(c("label") == "no_evidence_for_effect", F.when(any_open, "low").otherwise("moderate"))
        .when(any_open, "moderate")
        .when((c("label") == "direct_compatible") & nonzero & negligible & targetable, "high")
        .when((c("label") == "secondary_supported") & strong & strong_path, "high")
        .when((c("label") == "mixed_supported") & targetable & strong & strong_path, "high")
        .otherwise("moderate")
    )
    return out.withColumn("confidence", confidence)


def label_summary(labels: DataFrame) -> DataFrame:
    """Genes by label and confidence, with totals by label and over all (null)."""
    return labels.rollup("label", "confidence").agg(F.count("*").alias("genes"))
