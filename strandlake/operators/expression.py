"""From counts, or a precomputed table, to canonical effect rows."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.plans.policies import ExpressionPolicy

P = ExpressionPolicy()

# Status vocabularies of imported tables: fixed values, raw -> canonical; then what an absent status means.
TESTED = ({"tested": "tested", "yes": "tested", "true": "tested", "1": "tested", "not_tested": "not_tested", "untested": "not_tested", "filtered_low_count": "filtered_low_count", "low_count": "filtered_low_count", "false": "not_tested", "0": "not_tested"}, "tested")
FILTER = ({"not_filtered": "not_filtered", "pass": "not_filtered", "passed": "not_filtered", "independent_filtered": "independent_filtered", "independentfilter": "independent_filtered", "outlier_filtered": "outlier_filtered", "cooks_outlier": "outlier_filtered", "unsupported": "unsupported"}, "not_filtered")
LOW_COUNT = ({"passes_count_filter": "passes_count_filter", "pass": "passes_count_filter", "not_low_count": "passes_count_filter", "low_count": "low_count", "filtered_low_count": "low_count", "not_imported": "not_imported"}, "not_imported")
MODEL = ({"estimated": "estimated", "fit": "estimated", "ok": "estimated", "model_not_estimable": "model_not_estimable", "not_estimable": "model_not_estimable", "model_failure": "model_failure", "failed": "model_failure"}, "estimated")


def number(c: Column) -> Column:
    """Text as a double; blanks, NaN and other text are null."""
    x = F.expr(f"try_cast(nullif(trim({c}), '') as double)") if isinstance(c, str) else c.try_cast("double")
    return F.when(~F.isnan(x), x)


def library_size_median(counts: DataFrame) -> DataFrame:
    """(gene_id, sample, n, normalized): counts over the sample's total in units of the median total."""
    totals = counts.groupBy("sample").agg(F.sum("n").alias("total"))
    middle = totals.agg(F.median("total").alias("middle"))  # one row
    return counts.join(totals.join(F.broadcast(middle)), "sample").select("gene_id", "sample", "n", F.when(F.col("total") > 0, F.col("n") / (F.col("total") / F.col("middle"))).otherwise(F.lit(0.0)).alias("normalized"))


def shrink(lfc: Column, policy: ExpressionPolicy = P) -> Column:
    return lfc * F.least(F.abs(lfc) / (F.abs(lfc) + policy.shrinkage), F.lit(1.0))


def contrasts(normalized: DataFrame, samples: DataFrame, policy: ExpressionPolicy = P) -> DataFrame:
    """Per gene: means, log2 fold change, shrunken, direction, consistency of paired replicates, low-count flag."""
    rows = normalized.join(samples, "sample")
    is_ = lambda name: F.col("condition") == name
    pairs = F.collect_list(F.struct("replicate", "condition", "normalized"))
    out = rows.groupBy("gene_id").agg(
        F.coalesce(F.avg(F.when(is_("control"), F.col("normalized"))), F.lit(0.0)).alias("control_mean"),
        F.coalesce(F.avg(F.when(is_("treated"), F.col("normalized"))), F.lit(0.0)).alias("treated_mean"),
        F.count_if(is_("control") & (F.col("n") >= policy.expressed_count)).alias("expressed_controls"),
        pairs.alias("values"),
    )
    out = out.withColumn("lfc", F.log2((F.col("treated_mean") + 1) / (F.col("control_mean") + 1))).withColumn("shrunken", shrink(F.col("lfc"), policy))
    by = "map_from_entries(transform(filter(values, v -> v.condition = '{}'), v -> struct(v.replicate, v.normalized)))"
    out = out.withColumn("c", F.expr(by.format("control"))).withColumn("t", F.expr(by.format("treated")))
    both = "array_intersect(map_keys(c), map_keys(t))"
    # a tie counts as an increase
    out = out.withColumn("consistency", F.expr(f"abs(aggregate({both}, 0, (a, r) -> a + if(t[r] >= c[r], 1, -1))) / nullif(size({both}), 0)"))
    thr = policy.direction_threshold
    out = out.withColumn("direction", F.when(F.col("shrunken") <= -thr, "down").when(F.col("shrunken") >= thr, "up").otherwise("unchanged"))
    out = out.withColumn("demo_q", F.greatest(F.lit(1e-4), F.least(F.lit(1.0), F.exp(-3 * F.abs(F.col("shrunken"))))))
    low = (F.col("control_mean") < policy.min_baseline) | (F.col("expressed_controls") < policy.min_expressed)
    return out.withColumn("low_count", low).drop("values", "c", "t", "expressed_controls")


def replicate_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("condition").agg(F.count("*").alias("replicates"))


def count_issues(counts: DataFrame, samples: DataFrame) -> DataFrame:
    """(check, n) of raw counts: repeated cells, unknown samples, negative, fractional and missing values, absent conditions."""
    checks = [
        counts.groupBy("gene_id", "sample").count().where("count > 1").agg(F.count("*").alias("n")).withColumn("check", F.lit("duplicate_cell")),
        counts.select("sample").distinct().join(samples, "sample", "left_anti").agg(F.count("*").alias("n")).withColumn("check", F.lit("unknown_sample")),
        counts.agg(F.count_if(F.col("n") < 0).alias("n")).withColumn("check", F.lit("negative")),
        counts.agg(F.count_if(F.col("n") != F.floor("n")).alias("n")).withColumn("check", F.lit("fractional")),
        counts.agg(F.count_if(F.col("n").isNull()).alias("n")).withColumn("check", F.lit("missing")),
        samples.agg((2 - F.count_distinct(F.when(F.col("condition").isin("control", "treated"), F.col("condition")))).alias("n")).withColumn("check", F.lit("absent_condition")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out.select("check", F.col("n").cast("long").alias("n"))


def status(raw: Column, vocabulary: tuple[dict[str, str], str]) -> Column:
    """Canonical status; blank counts as absent, an unknown word as imported_unknown."""
    words, absent = vocabulary
    key = F.nullif(F.lower(F.trim(raw)), F.lit(""))
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(words.items())])
    return F.when(key.isNull(), absent).otherwise(F.coalesce(F.try_element_at(known, key), F.lit("imported_unknown")))


def imported_statuses(df: DataFrame) -> DataFrame:
    """Adds tested_status, filter_status, low_count_status, model_status and the warnings for unknown words."""
    named = {"tested_status": ("tested", TESTED), "filter_status": ("filter_raw", FILTER), "low_count_status": ("low_count_raw", LOW_COUNT), "model_status": ("model_raw", MODEL)}
    out = df.withColumns({k: status(F.col(c), v) for k, (c, v) in named.items()})
    return out.withColumn("warnings", F.array_compact(F.array(*[F.when(F.col(k) == "imported_unknown", F.lit(f"unknown {k}")) for k in named])))


def canonical_effects(df: DataFrame, policy: ExpressionPolicy = P) -> DataFrame:
    """Adds the canonical effect and the statuses derived from it; needs lfc, lfc_shrunken, padj and the four statuses."""
    untested = F.col("tested_status").isin("untested", "not_tested", "filtered_low_count")
    failed = F.col("model_status").isin("model_not_estimable", "model_failure")
    e, thr = F.col("effect"), policy.biological_threshold
    out = df.withColumn("effect", F.coalesce("lfc_shrunken", "lfc"))
    out = out.withColumn("effect_source", F.when(F.col("lfc_shrunken").isNotNull(), "imported_shrunken_log2fc").when(F.col("lfc").isNotNull(), "reported_unshrunken_log2fc").otherwise("unavailable"))
    padj = F.when(F.col("padj").isNotNull(), F.lit("adjusted_pvalue_available")).when(F.col("filter_status").isin("independent_filtered", "outlier_filtered"), F.col("filter_status")).when(failed, F.col("model_status")).otherwise("adjusted_pvalue_unavailable")
    direction = F.when(untested, "untested").when(failed, "not_estimable").when(e.isNull(), "uncertain").when(e < 0, "decreased").when(e > 0, "increased").otherwise("exact_zero")
    support = F.when(untested, "not_tested").when(failed, "indeterminate").when(F.col("filter_status") == "unsupported", "unsupported").when(F.col("padj").isNull(), "adjusted_pvalue_unavailable").when(F.col("padj") <= policy.significance, "significant").otherwise("not_significant")
    biology = F.when(e.isNull(), "indeterminate").when(F.lit(thr is None), "threshold_not_configured").when(e <= -(thr or 0), "exceeds_decrease_threshold").when(e >= (thr or 0), "exceeds_increase_threshold").otherwise("below_effect_threshold")
    return out.withColumns({"padj_status": padj, "numerical_direction": direction, "statistical_support": support, "biological_threshold": biology})


def table_issues(df: DataFrame) -> DataFrame:
    """(check, n) of a precomputed table."""
    n = df.agg(F.count_if(F.col("base_mean").isNull()).alias("base_mean_missing"), F.count_if(F.col("lfc").isNull()).alias("lfc_missing"), F.count_if(~F.col("padj").between(0, 1)).alias("padj_out_of_range"), (F.count("*") - F.count_distinct("gene")).alias("duplicate_genes"))
    return n.select(F.expr("stack(4, 'base_mean_missing', base_mean_missing, 'lfc_missing', lfc_missing, 'padj_out_of_range', padj_out_of_range, 'duplicate_genes', duplicate_genes) as (check, n)"))


def exclusion(isoform: bool = False) -> Column:
    """Why a downstream view leaves a row out, or null; the isoform view keeps model_not_estimable."""
    out = F.when(F.col("canonical_gene_id").isNull(), "canonical_gene_id_unavailable").when(F.col("ambiguity_status") == "ambiguous", "ambiguous_identifier_not_allowed").when(F.col("effect").isNull(), "canonical_effect_unavailable")
    if not isoform:
        out = out.when(F.col("model_status") == "model_not_estimable", "model_not_estimable")
    return out.when(F.col("model_status") == "model_failure", "model_failure").when(F.col("filter_status") == "unsupported", "unsupported_expression_state")


def downstream(effects: DataFrame, isoform: bool = False) -> tuple[DataFrame, DataFrame]:
    """(included, excluded with reason)."""
    rows = effects.withColumn("exclusion", exclusion(isoform))
    return rows.where("exclusion is null").drop("exclusion"), rows.where("exclusion is not null")


def filtering_summary(effects: DataFrame) -> DataFrame:
    """(status, value, n): how many rows have each value of each status."""
    kinds = ("tested_status", "filter_status", "low_count_status", "model_status", "statistical_support", "numerical_direction")
    long = effects.select(F.explode(F.array(*[F.struct(F.lit(k).alias("status"), F.col(k).alias("value")) for k in kinds])).alias("x"))
    return long.groupBy("x.status", "x.value").agg(F.count("*").alias("n"))


def recoded_direction(c: Column) -> Column:
    return F.when(c == "decreased", "down").when(c == "increased", "up").otherwise("unchanged")


# --- modes and configuration ---------------------------------------------------------------------

#: What a backend can do (fixed values): level, checks input, runs, for production, inference, describes effects, needs, comes as, fails with.
SUPPORT = {
    "normalized_matrix": ("validation_only", True, False, False, False, False, "not_implemented", "none", "normalized_matrix_execution_not_supported"),
    "synthetic_demo": ("demonstration_only", True, True, False, False, True, "synthetic_demo", "bundled_demo", "executes only as demonstration output"),
    "precomputed": ("validated_import", True, True, True, True, True, "precomputed", "external_results_imported", "fails on schema or value validation errors"),
    "external": ("unsupported", True, False, False, False, False, None, "external_unavailable", "raw_count_production_backend_unavailable"),
    "other": ("unsupported", False, False, False, False, False, "unsupported", "none", "unsupported_expression_backend"),
}
SUPPORT_COLUMNS = ("support_level", "validates", "executes", "production", "inference", "describes", "required_backend", "comes_as", "failure")


def execution_support(configs: DataFrame) -> DataFrame:
    """What can be done with each (input_mode, backend): a lookup by the kind of backend, for any number of configurations."""
    backend = F.regexp_replace(F.lower(F.coalesce("backend", F.lit("unset"))), "-", "_")
    kind = (
        F.when(F.col("input_mode") == "normalized_matrix", "normalized_matrix")
        .when(backend.isin("synthetic", "synthetic_demo"), "synthetic_demo")
        .when(backend == "precomputed", "precomputed")
        .when(backend.isin("pydeseq2", "deseq2_r"), "external")
        .otherwise("other")
    )
    out = configs.withColumn("backend", backend).withColumn("kind", kind)
    for i, name in enumerate(SUPPORT_COLUMNS):
        known = F.create_map(*[F.lit(x) for k, v in SUPPORT.items() if v[i] is not None for x in (k, v[i])])
        value = F.try_element_at(known, F.col("kind"))
        out = out.withColumn(name, F.coalesce(value, F.col("backend")) if name == "required_backend" else value)
    return out.withColumn("input_mode", F.when(F.col("kind") == "precomputed", "precomputed_de").otherwise(F.col("input_mode"))).drop("kind")


# Modes and scales: fixed values.
INPUT_MODES = ("raw_counts", "precomputed_de", "normalized_matrix")
NORMALIZED_SCALES = ("normalized_count", "log2_expression", "vst", "rlog", "voom_log_cpm", "tpm", "fpkm", "rpkm")


def config_issues(configs: DataFrame) -> DataFrame:
    """configs and `issues`: every rule that a configuration breaks, in order.

    configs: (input_mode, value_scale, effect_scale, duplicate_gene_policy, precomputed_table, contrast_id,
    control_condition, treatment_condition).
    """
    c = F.col
    mode, scale = c("input_mode"), c("value_scale")
    rules = {
        "unsupported_input_mode": ~mode.isin(*INPUT_MODES),
        "unsupported_effect_scale": c("effect_scale") != "log2_fold_change",
        "unsupported_duplicate_gene_policy": c("duplicate_gene_policy") != "reject",
        "raw_counts_need_raw_scale": (mode == "raw_counts") & (scale != "raw_count"),
        "precomputed_needs_table": (mode == "precomputed_de") & c("precomputed_table").isNull(),
        "normalized_needs_scale": (mode == "normalized_matrix") & ~scale.isin(*NORMALIZED_SCALES),
        "contrast_id_empty": F.coalesce(c("contrast_id"), F.lit("")) == "",
        "conditions_equal": c("control_condition").eqNullSafe(c("treatment_condition")),
    }
    return configs.withColumn("issues", F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])))


def analyze(mode: str, *, counts: DataFrame | None = None, samples: DataFrame | None = None, table: DataFrame | None = None, policy: ExpressionPolicy = P) -> DataFrame:
    """Effects by input mode: raw counts as a demonstration, an imported table, or an error for what isn't executable."""
    if mode == "raw_counts" and counts is not None and samples is not None:
        return contrasts(library_size_median(counts), samples, policy)
    if mode == "precomputed_de" and table is not None:
        return canonical_effects(imported_statuses(table), policy)
    if mode == "normalized_matrix":
        raise ValueError("a normalized matrix can be validated, not analyzed")
    raise ValueError(f"{mode} is not supported, or lacks its tables")


def backend_effects(results: DataFrame, resolved: DataFrame, policy: ExpressionPolicy = P) -> DataFrame:
    """A backend's rows (gene, lfc, shrunken, padj, low_count, shrinkage) as canonical effects with their identifiers.

    resolved: (id, canonical_gene_id, ambiguity_status, mapping_confidence). Backends estimate every gene.
    """
    known = F.coalesce(~F.col("shrinkage").isin("unavailable", "unspecified"), F.lit(False))
    low, thr = F.col("low_count"), policy.biological_threshold
    out = results.join(resolved.select(F.col("id").alias("gene"), "canonical_gene_id", "ambiguity_status", "mapping_confidence"), "gene", "left")
    out = out.withColumn("effect", F.when(known, F.col("shrunken")).otherwise(F.col("lfc"))).withColumn("effect_source", F.when(known, "backend_shrunken_log2fc").otherwise("reported_unshrunken_log2fc"))
    e = F.col("effect")
    return out.withColumns(
        {
            "tested_status": F.when(low, "filtered_low_count").otherwise("tested"),
            "filter_status": F.when(low, "low_count_filter").otherwise("not_filtered"),
            "low_count_status": F.when(low, "low_count").otherwise("passes_count_filter"),
            "model_status": F.lit("estimated"),
            "numerical_direction": F.when(e.isNull(), "uncertain").when(e < 0, "decreased").when(e > 0, "increased").otherwise("exact_zero"),
            "statistical_support": F.when(F.col("padj").isNull(), "adjusted_pvalue_unavailable").when(F.col("padj") <= policy.significance, "significant").otherwise("not_significant"),
            "biological_threshold": F.when(e.isNull(), "indeterminate").when(F.lit(thr is None), "threshold_not_configured").when(e <= -(thr or 0), "exceeds_decrease_threshold").when(e >= (thr or 0), "exceeds_increase_threshold").otherwise("below_effect_threshold"),
        }
    )


def record_counts(effects: DataFrame) -> DataFrame:
    """(metric, value) of effect rows with canonical_gene_id and ambiguity_status, and of the downstream view made of them."""
    c = F.col
    rows = effects.withColumn("_out", exclusion())
    tests = {
        "total": F.lit(True),
        "with_canonical_gene": c("canonical_gene_id").isNotNull(),
        "unresolved_identifiers": c("ambiguity_status").isin("unresolved", "not_in_snapshot", "unmapped"),
        "ambiguous_identifiers": c("ambiguity_status") == "ambiguous",
        "missing_effects": c("effect").isNull(),
        "tested": c("tested_status") == "tested",
        "not_tested": c("tested_status").isin("not_tested", "untested"),
        "filtered": ~c("filter_status").isin("not_filtered", "imported_missing") | (c("low_count_status") == "low_count"),
        "not_estimable": c("model_status") == "model_not_estimable",
        "model_failures": c("model_status") == "model_failure",
        "included": c("_out").isNull(),
        "excluded": c("_out").isNotNull(),
        "included_without_padj": c("_out").isNull() & c("padj").isNull(),
        "included_shrunken": c("_out").isNull() & c("effect_source").isin("imported_shrunken_log2fc", "backend_shrunken_log2fc"),
    }
    one = rows.agg(*[F.count_if(t).alias(k) for k, t in tests.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), c(k).alias("value")) for k in tests])).alias("x")).select("x.*")


def exclusion_reasons(effects: DataFrame) -> DataFrame:
    """(reason, n) of the rows that the downstream view leaves out."""
    return effects.withColumn("reason", exclusion()).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
