"""Registered queries over the driver's tables, through the adapters, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import rna
from strandlake.sources.stored import stored
from strandlake.operators import audit, edges, effects, enrichment, expression, identifiers, isoform, paths, ratio, sites, targetability

from .adapters import duckdb_with, spark_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, tables: str, sql: str | None = None):
    """Registers a function of the named tables; sql follows their definitions as common table expressions."""
    names = tables.split()

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(*spark_tables(spark, sf_dir, *names))
        if sql:
            ORACLES[name] = duckdb_with(*names) + sql
        return f

    return add


def r6(*names: str):
    return {n: F.round(n, 6) for n in names}


# --- sequences -----------------------------------------------------------------------------------

SITES_SQL = """,
 wins AS (SELECT transcript_id, gene_id, start, substr(sequence, start + 1, 21) AS win, substr(sequence, start + 2, 7) AS kmer
          FROM (SELECT transcript_id, gene_id, sequence, unnest(range(0, length(sequence) - 20)) AS start FROM sequences WHERE length(sequence) >= 21) s),
 g AS (SELECT sirna_id, reverse(translate(guide, 'ACGT', 'TGCA')) AS search FROM guides),
 mm AS (SELECT sirna_id, transcript_id, gene_id, start, list_filter(range(1, 22), lambda i: substr(search, CAST(i AS BIGINT), 1) <> substr(win, CAST(i AS BIGINT), 1)) AS p FROM wins JOIN g ON kmer = substr(search, 2, 7)),
 cnt AS (SELECT sirna_id, transcript_id, gene_id, start, len(p) AS n_total_mm, len(list_filter(p, lambda i: i BETWEEN 2 AND 8)) AS n_seed_mm, len(list_filter(p, lambda i: i BETWEEN 9 AND 12)) AS n_central_mm, p FROM mm),
 sites AS (SELECT *, n_total_mm - n_seed_mm - n_central_mm AS n_nonseed_mm,
   CASE WHEN n_total_mm = 0 THEN 0 WHEN n_total_mm <= 2 AND n_seed_mm = 0 AND n_central_mm = 0 AND n_total_mm - n_central_mm - n_seed_mm <= 2 THEN 1 WHEN n_seed_mm = 0 AND n_total_mm <= 14 AND 21 - n_total_mm >= 7 THEN 3 ELSE 4 END AS priority FROM cnt)"""

CLASS_SQL = "CASE priority WHEN 0 THEN 'exact_full_length_complement' WHEN 1 THEN 'near_full_length_complement' WHEN 3 THEN 'seed_only_candidate' ELSE 'partial_nonseed_match' END"


@query("target_sites", "sequences guides", SITES_SQL + f" SELECT sirna_id, transcript_id, gene_id, start, n_total_mm, n_seed_mm, n_central_mm, n_nonseed_mm, priority, {CLASS_SQL} AS site_class FROM sites")
def _(sequences, guides):
    s = targetability.scan(sequences, guides)
    return s.select(*targetability.SITE, "n_total_mm", "n_seed_mm", "n_central_mm", "n_nonseed_mm", "priority", "site_class")


BEST_SQL = """,
 best AS (SELECT sirna_id, transcript_id, gene_id, count(*) AS n_sites, count(*) FILTER (priority = 0) AS n_exact, count(*) FILTER (priority = 1) AS n_near, count(*) FILTER (priority = 3) AS n_seed_only, count(*) FILTER (priority = 4) AS n_partial,
   arg_min(start, (priority, n_total_mm, n_seed_mm, n_central_mm, start)) AS best_start, min(priority) AS best_priority, min((priority, n_total_mm, n_seed_mm, n_central_mm)) AS k FROM sites GROUP BY ALL),
 ties AS (SELECT sirna_id, transcript_id, gene_id, (priority, n_total_mm, n_seed_mm, n_central_mm) AS k, count(DISTINCT start) AS n FROM sites GROUP BY ALL),
 decided AS (SELECT b.*, t.n > 1 AS tied, CASE WHEN n_exact + n_near > 0 THEN 'cleavage_candidate_present' WHEN n_seed_only > 0 THEN 'seed_only_candidate_present' ELSE 'indeterminate' END AS decision FROM best b JOIN ties t ON b.sirna_id = t.sirna_id AND b.transcript_id = t.transcript_id AND b.k = t.k)"""


@query("best_sites", "sequences guides", SITES_SQL + BEST_SQL + " SELECT sirna_id, transcript_id, gene_id, n_sites, n_exact, n_near, n_seed_only, n_partial, best_start, best_priority, tied, decision FROM decided")
def _(sequences, guides):
    return targetability.best_sites(targetability.scan(sequences, guides))


@query(
    "site_mismatches",
    "sequences guides",
    SITES_SQL
    + """ SELECT s.sirna_id, s.transcript_id, s.gene_id, s.start, s.position, substr(g.search, s.position, 1) AS guide_base, substr(w.win, s.position, 1) AS target_base,
    CASE WHEN s.position BETWEEN 2 AND 8 THEN 'seed' WHEN s.position BETWEEN 9 AND 12 THEN 'central' WHEN s.position = 1 OR s.position > 19 THEN 'terminal' ELSE 'nonseed' END AS region, concat(substr(g.search, s.position, 1), '>', substr(w.win, s.position, 1)) AS mismatch_type
    FROM (SELECT sirna_id, transcript_id, gene_id, start, unnest(p) AS position FROM sites) s JOIN g ON g.sirna_id = s.sirna_id JOIN wins w ON w.transcript_id = s.transcript_id AND w.start = s.start""",
)
def _(sequences, guides):
    return targetability.mismatch_rows(targetability.scan(sequences, guides))


@query("guide_validation", "guides", " SELECT sirna_id, guide AS normalized, reverse(translate(guide, 'ACGT', 'TGCA')) AS search, CASE WHEN length(guide) BETWEEN 19 AND 23 THEN 'ok' ELSE 'unsupported_length' END AS status, substr(guide, 2, 7) AS seed, reverse(translate(substr(guide, 2, 7), 'ACGT', 'TGCA')) AS seed_query FROM guides")
def _(guides):
    return targetability.validate_guides(guides).select("sirna_id", "normalized", "search", "status", rna.guide_seed(F.col("guide")).alias("seed"), rna.target_seed(F.col("guide")).alias("seed_query"))


@query(
    "seed_sites",
    "sequences guides",
    """, strand AS (SELECT sirna_id, 'guide' AS strand, guide AS s FROM guides UNION ALL SELECT sirna_id, 'passenger', passenger FROM guides),
    k AS (SELECT unnest([6, 7, 8]) AS k), q AS (SELECT sirna_id, strand, k, reverse(translate(substr(s, 2, k), 'ACGT', 'TGCA')) AS query FROM strand, k),
    wins AS (SELECT transcript_id, gene_id, start, k, substr(sequence, start + 1, k) AS w FROM (SELECT transcript_id, gene_id, sequence, unnest(range(0, length(sequence) - 5)) AS start FROM sequences WHERE length(sequence) >= 6) s, k)
    SELECT sirna_id, strand, transcript_id, gene_id, start, q.k AS k, concat('seed_', CAST(q.k AS VARCHAR)) AS site_type FROM wins JOIN q ON wins.k = q.k AND wins.w = q.query""",
)
def _(sequences, guides):
    return sites.seed_sites(targetability.dealt(sequences, guides), sites.strands(guides))


FULL_SQL = """, strand AS (SELECT sirna_id, 'guide' AS strand, guide AS s FROM guides UNION ALL SELECT sirna_id, 'passenger', passenger FROM guides),
    q AS (SELECT sirna_id, strand, s, reverse(translate(s, 'ACGT', 'TGCA')) AS search FROM strand),
    wins AS (SELECT transcript_id, gene_id, start, substr(sequence, start + 1, 21) AS win FROM (SELECT transcript_id, gene_id, sequence, unnest(range(0, length(sequence) - 20)) AS start FROM sequences WHERE length(sequence) >= 21) s),
    full_sites AS (SELECT sirna_id, strand, s, transcript_id, gene_id, start, win, list_filter(range(1, 22), lambda i: substr(s, CAST(i AS BIGINT), 1) <> substr(reverse(translate(win, 'ACGT', 'TGCA')), CAST(i AS BIGINT), 1)) AS mm
              FROM wins JOIN q ON hamming(win, search) <= 4),
    scored AS (SELECT sirna_id, strand, transcript_id, gene_id, start, len(mm) AS n_mm, len(list_filter(mm, lambda i: i BETWEEN 9 AND 12)) = 0 AS central_pairing, contains(win, reverse(translate(substr(s, 13, 5), 'ACGT', 'TGCA'))) AS supplementary_pairing FROM full_sites)"""


@query("full_sites", "sequences guides", FULL_SQL + " SELECT sirna_id, strand, transcript_id, gene_id, start, n_mm, central_pairing, n_mm <= 2 AND central_pairing AS cleavage_compatible, supplementary_pairing, greatest(CASE WHEN n_mm = 0 THEN 60 ELSE 42 END + CASE WHEN central_pairing THEN 8 ELSE -12 END - 6 * n_mm, 0) AS score, -24.0 + 2.0 * n_mm AS energy FROM scored")
def _(sequences, guides):
    found = sites.annotate(sites.full_sites(targetability.dealt(sequences, guides), sites.strands(guides)))
    return found.select("sirna_id", "strand", "transcript_id", "gene_id", "start", "n_mm", "central_pairing", "cleavage_compatible", "supplementary_pairing", "score", "energy")


ROLLUP_SQL = """, strand AS (SELECT sirna_id, 'guide' AS strand, guide AS s FROM guides UNION ALL SELECT sirna_id, 'passenger', passenger FROM guides),
    q AS (SELECT sirna_id, strand, reverse(translate(substr(s, 2, 8), 'ACGT', 'TGCA')) AS query FROM strand),
    wins AS (SELECT transcript_id, gene_id, start, substr(sequence, start + 1, 8) AS w FROM (SELECT transcript_id, gene_id, sequence, unnest(range(0, length(sequence) - 7)) AS start FROM sequences WHERE length(sequence) >= 8) s),
    hit AS (SELECT sirna_id, strand, transcript_id, gene_id, start FROM wins JOIN q ON w = query)"""


@query("gene_site_rollup", "sequences guides", ROLLUP_SQL + " SELECT sirna_id, gene_id, count(*) AS multiplicity, count(DISTINCT transcript_id) AS n_transcripts, count(DISTINCT transcript_id) FILTER (strand = 'guide') AS n_guide, count(DISTINCT transcript_id) FILTER (strand = 'passenger') AS n_passenger FROM hit GROUP BY ALL")
def _(sequences, guides):
    return sites.gene_rollup(sites.seed_sites(targetability.dealt(sequences, guides), sites.strands(guides), (8,)), listed=False)


@query("site_coverage", "sequences guides", ROLLUP_SQL + " SELECT s.gene_id, count(h.transcript_id) AS with_site, count(*) - count(h.transcript_id) AS without_site FROM sequences s LEFT JOIN (SELECT DISTINCT transcript_id FROM hit) h ON h.transcript_id = s.transcript_id GROUP BY s.gene_id")
def _(sequences, guides):
    return sites.coverage(sequences, sites.seed_hits(sequences, sites.strands(guides)))


@query("intended_targets", "sequences guides", SITES_SQL + """ SELECT g.sirna_id, g.intended_gene AS gene_id, count(s.start) AS n_candidates, count(*) FILTER (s.priority <= 1) AS n_accepted, CASE WHEN count(*) FILTER (s.priority <= 1) > 0 THEN 'accepted' WHEN count(s.start) > 0 THEN 'rejected' ELSE 'no_candidate_site' END AS status,
      concat_ws(',', CASE WHEN count(*) FILTER (s.n_central_mm > 0) > 0 THEN 'central' END, CASE WHEN count(*) FILTER (s.priority > 1) > 0 THEN 'class' END, CASE WHEN count(*) FILTER (s.n_seed_mm > 0) > 0 THEN 'seed' END, CASE WHEN count(*) FILTER (s.n_total_mm > 2) > 0 THEN 'total' END) AS rejection_reasons
    FROM guides g LEFT JOIN sites s ON s.sirna_id = g.sirna_id AND s.gene_id = g.intended_gene GROUP BY ALL""")
def _(sequences, guides):
    return targetability.intended_targets(guides, targetability.scan(sequences, guides, own=True)).withColumn("rejection_reasons", F.concat_ws(",", "rejection_reasons"))


@query("targetability_summary", "sequences guides", SITES_SQL + BEST_SQL + """, a AS (SELECT count(*) AS sites, count(*) FILTER (priority = 0) AS exact_sites, count(*) FILTER (priority = 1) AS near_sites, count(*) FILTER (priority = 3) AS seed_only_sites, count(*) FILTER (priority = 4) AS partial_sites, count(*) FILTER (priority <= 1) AS cleavage_sites, count(DISTINCT sirna_id) AS guides_with_site, count(DISTINCT gene_id) AS genes_with_site, CAST(sum(n_total_mm) AS BIGINT) AS mismatches FROM sites),
    b AS (SELECT count(*) AS pairs, count(*) FILTER (decision = 'cleavage_candidate_present') AS cleavage_pairs, count(*) FILTER (decision = 'seed_only_candidate_present') AS seed_only_pairs, count(*) FILTER (tied) AS tied_pairs FROM decided)
    SELECT metric, value FROM (UNPIVOT a ON COLUMNS(*) INTO NAME metric VALUE value) UNION ALL SELECT metric, value FROM (UNPIVOT b ON COLUMNS(*) INTO NAME metric VALUE value)""")
def _(sequences, guides):
    return targetability.summary(targetability.best_sites(targetability.scan(sequences, guides), mismatches=True))


# --- isoforms and M/N ----------------------------------------------------------------------------

ELIGIBLE_SQL = """, judged AS (SELECT *, CASE WHEN organism IS DISTINCT FROM 'human' THEN 'organism_mismatch' WHEN assembly IS DISTINCT FROM 'GRCh38' THEN 'assembly_mismatch' WHEN gene_id IS NULL THEN 'unresolved_gene_mapping' WHEN transcript_id IS NULL THEN 'unresolved_transcript_mapping' WHEN ambiguous THEN 'ambiguous_transcript_mapping'
    WHEN sequence_reference IS NULL THEN 'missing_sequence_reference' WHEN deprecated THEN 'deprecated_transcript' WHEN alternative_contig THEN 'alternative_contig' WHEN biotype LIKE '%pseudogene' THEN 'pseudogene_transcript_excluded' WHEN biotype = 'readthrough_transcript' THEN 'readthrough_transcript_excluded' END AS exclusion FROM annotation)"""


@query("transcript_eligibility", "annotation", ELIGIBLE_SQL + " SELECT transcript_id, gene_id, biotype, exclusion, exclusion IS NULL AS eligible FROM judged")
def _(annotation):
    return isoform.eligibility(annotation).select("transcript_id", "gene_id", "biotype", "exclusion", "eligible")


@query("annotation_validation", "annotation", " SELECT count(*) AS total_rows, count(DISTINCT gene_id) AS unique_genes, count(DISTINCT transcript_id) AS unique_transcripts, count(*) FILTER (organism <> 'human') AS organism_conflicts, count(*) FILTER (assembly <> 'GRCh38') AS assembly_conflicts, count(*) FILTER (gene_id IS NULL) AS unresolved_genes, count(*) FILTER (sequence_reference IS NULL) AS missing_sequence_references FROM annotation")
def _(annotation):
    return isoform.snapshot_issues(annotation)


@query("equal_prior_weights", "annotation", ELIGIBLE_SQL + " SELECT transcript_id, gene_id, count(*) OVER (PARTITION BY gene_id) AS n_total, round(1.0 / count(*) OVER (PARTITION BY gene_id), 6) AS weight FROM judged WHERE exclusion IS NULL")
def _(annotation):
    return isoform.equal_weights(isoform.eligibility(annotation).where("eligible")).select("transcript_id", "gene_id", "n_total", F.round("weight", 6).alias("weight"))


@query("gene_annotation_match", "annotation", " SELECT DISTINCT w.gene_id AS wanted_gene, a.transcript_id FROM (SELECT DISTINCT original_gene_id AS gene_id FROM annotation) w JOIN annotation a ON w.gene_id = a.gene_id OR w.gene_id = a.original_gene_id")
def _(annotation):
    genes = annotation.select(F.col("original_gene_id").alias("gene_id")).distinct()
    return isoform.genes_to_annotation(genes, annotation).select("wanted_gene", "transcript_id")


@query("isoform_uncertainty", "annotation", ELIGIBLE_SQL + " SELECT gene_id, count(*) FILTER (exclusion IS NULL) AS n_eligible, count(exclusion) AS n_excluded, coalesce(string_agg(DISTINCT exclusion, ',' ORDER BY exclusion), '') AS reasons, CASE WHEN count(*) FILTER (exclusion IS NULL) = 0 THEN 'no_eligible_transcripts' ELSE 'equal_prior' END AS mode FROM judged WHERE gene_id IS NOT NULL GROUP BY gene_id")
def _(annotation):
    return isoform.gene_uncertainty(annotation).withColumn("reasons", F.concat_ws(",", "reasons"))


PARTS_SQL = (
    SITES_SQL
    + BEST_SQL
    + ELIGIBLE_SQL
    + """, genes AS (SELECT DISTINCT sirna_id, gene_id FROM sites UNION SELECT sirna_id, intended_gene FROM guides),
    pairs AS (SELECT g.sirna_id, j.gene_id, j.transcript_id, j.sequence_available FROM genes g JOIN judged j ON j.gene_id = g.gene_id WHERE j.exclusion IS NULL),
    parts AS (SELECT p.sirna_id, p.gene_id, p.transcript_id, CASE WHEN NOT sequence_available THEN 'unresolved_sequence_unavailable' WHEN n_exact + n_near > 0 THEN NULL WHEN n_seed_only > 0 THEN 'does_not_qualify_seed_only' WHEN n_partial > 0 THEN 'does_not_qualify_partial_match' ELSE 'does_not_qualify_no_supported_site' END AS reason,
      coalesce(n_seed_only, 0) > 0 AS seed_only FROM pairs p LEFT JOIN decided b ON b.sirna_id = p.sirna_id AND b.transcript_id = p.transcript_id),
    m AS (SELECT *, CASE WHEN reason IS NULL THEN 1 WHEN reason LIKE 'does_not%' THEN 0 END AS contribution_to_m FROM parts)"""
)


def _eligible(annotation):
    return isoform.eligibility(annotation).where("eligible").select("gene_id", "transcript_id", "sequence_available")


def _gene_parts(sequences, guides, annotation, own=False, exact=False):
    """Contributions to M, dealt out by gene: nothing is stored, and only genes' own tables are shuffled. own: intended genes
    alone. exact: with whether a transcript has an exact site."""
    aims = guides.select("sirna_id", F.col("intended_gene").alias("gene_id")).distinct()
    mine = targetability.best_sites(targetability.scan(sequences, guides, own=True))
    best = mine if own else targetability.best_sites(targetability.scan(sequences, guides))
    lone = aims.join(mine, ["sirna_id", "gene_id"], "left_anti")
    return ratio.contributions_by_gene(best, lone, _eligible(annotation), exact)


@query("m_contributions", "sequences guides annotation", PARTS_SQL + " SELECT sirna_id, gene_id, transcript_id, contribution_to_m, reason, seed_only FROM m")
def _(sequences, guides, annotation):
    met, lone = _gene_parts(sequences, guides, annotation)
    return met.unionByName(lone).where("transcript_id is not null")


RATIO_SQL = (
    PARTS_SQL
    + """, n AS (SELECT g.sirna_id, g.gene_id, count(DISTINCT transcript_id) AS n_total, coalesce(sum(contribution_to_m), 0) AS q, count(*) FILTER (transcript_id IS NOT NULL AND contribution_to_m IS NULL) AS n_unresolved, count(*) FILTER (seed_only) AS n_seed_only FROM genes g LEFT JOIN m ON m.sirna_id = g.sirna_id AND m.gene_id = g.gene_id GROUP BY ALL),
    st AS (SELECT *, CASE WHEN n_total = 0 THEN 'undefined_zero_denominator' WHEN n_unresolved > 0 THEN 'unavailable_incomplete_evidence' ELSE 'definitive' END AS ratio_status FROM n),
    ratios AS (SELECT sirna_id, gene_id, n_total, CASE WHEN ratio_status = 'definitive' THEN CAST(q AS BIGINT) END AS m_targetable, CASE WHEN ratio_status = 'definitive' THEN q / n_total END AS ratio, ratio_status, n_unresolved, n_seed_only,
      CASE WHEN n_unresolved > 0 AND n_total > 0 THEN q / n_total END AS ratio_low, CASE WHEN n_unresolved > 0 AND n_total > 0 THEN (q + n_unresolved) / n_total END AS ratio_high FROM st)"""
)
RATIO_COLUMNS = "sirna_id, gene_id, n_total, m_targetable, round(ratio, 6) AS ratio, ratio_status, n_unresolved, n_seed_only, round(ratio_low, 6) AS ratio_low, round(ratio_high, 6) AS ratio_high"


def _ratios(sequences, guides, annotation, own=False):
    met, lone = _gene_parts(sequences, guides, annotation, own)
    return ratio.gene_ratios(met).unionByName(ratio.gene_ratios(lone))


@query("m_over_n", "sequences guides annotation", RATIO_SQL + f" SELECT {RATIO_COLUMNS} FROM ratios")
def _(sequences, guides, annotation):
    return _ratios(sequences, guides, annotation).drop("qualifying", "unresolved").withColumns(r6("ratio", "ratio_low", "ratio_high"))


@query("ratio_summary", "sequences guides annotation", RATIO_SQL + " SELECT ratio_status, count(*) AS genes, CAST(sum(n_total) AS BIGINT) AS n_total, CAST(coalesce(sum(m_targetable), 0) AS BIGINT) AS m_targetable, CAST(sum(n_unresolved) AS BIGINT) AS n_unresolved FROM ratios GROUP BY ratio_status")
def _(sequences, guides, annotation):
    return ratio.summary(_ratios(sequences, guides, annotation))


# --- expression ----------------------------------------------------------------------------------

NORM_SQL = """, tot AS (SELECT sample, sum(n) AS total FROM counts GROUP BY sample), mid AS (SELECT median(total) AS middle FROM tot),
    norm AS (SELECT gene_id, c.sample, n, CASE WHEN total > 0 THEN n / (total / middle) ELSE 0.0 END AS normalized FROM counts c JOIN tot ON tot.sample = c.sample CROSS JOIN mid)"""


@query("library_size_normalization", "counts", NORM_SQL + " SELECT gene_id, sample, n, round(normalized, 6) AS normalized FROM norm")
def _(counts):
    return expression.library_size_median(counts).withColumns(r6("normalized"))


CONTRAST_SQL = (
    NORM_SQL
    + """, j AS (SELECT norm.*, s.condition, s.replicate FROM norm JOIN samples s ON s.sample = norm.sample),
    sg AS (SELECT c.gene_id, abs(sum(CASE WHEN t.normalized >= c.normalized THEN 1 ELSE -1 END)) / count(*) AS consistency FROM j c JOIN j t ON c.gene_id = t.gene_id AND c.replicate = t.replicate AND c.condition = 'control' AND t.condition = 'treated' GROUP BY c.gene_id),
    mn AS (SELECT gene_id, avg(normalized) FILTER (condition = 'control') AS control_mean, avg(normalized) FILTER (condition = 'treated') AS treated_mean, count(*) FILTER (condition = 'control' AND n >= 1) AS expressed FROM j GROUP BY gene_id),
    lf AS (SELECT mn.*, log2((treated_mean + 1) / (control_mean + 1)) AS lfc FROM mn), sh AS (SELECT lf.*, lfc * least(abs(lfc) / (abs(lfc) + 0.35), 1.0) AS shrunken FROM lf),
    contrast AS (SELECT sh.gene_id, control_mean, treated_mean, lfc, shrunken, consistency, CASE WHEN shrunken <= -0.25 THEN 'down' WHEN shrunken >= 0.25 THEN 'up' ELSE 'unchanged' END AS direction, greatest(0.0001, least(1.0, exp(-3 * abs(shrunken)))) AS demo_q, control_mean < 10 OR expressed < 2 AS low_count FROM sh LEFT JOIN sg ON sg.gene_id = sh.gene_id)"""
)


@query("expression_contrasts", "counts samples", CONTRAST_SQL + " SELECT gene_id, round(control_mean, 6) AS control_mean, round(treated_mean, 6) AS treated_mean, round(lfc, 6) AS lfc, round(shrunken, 6) AS shrunken, round(consistency, 6) AS consistency, direction, round(demo_q, 6) AS demo_q, low_count FROM contrast")
def _(counts, samples):
    return expression.contrasts(expression.library_size_median(counts), samples).withColumns(r6("control_mean", "treated_mean", "lfc", "shrunken", "consistency", "demo_q"))


STATUS_SQL = """, st AS (SELECT *, CASE WHEN tested IS NULL THEN 'tested' WHEN lower(trim(tested)) = 'yes' THEN 'tested' WHEN tested = 'not_tested' THEN 'not_tested' ELSE 'imported_unknown' END AS tested_status,
      CASE filter_raw WHEN 'independentFilter' THEN 'independent_filtered' WHEN 'unsupported' THEN 'unsupported' ELSE 'not_filtered' END AS filter_status, CASE low_count_raw WHEN 'low_count' THEN 'low_count' WHEN '' THEN 'not_imported' ELSE 'passes_count_filter' END AS low_count_status,
      CASE model_raw WHEN 'failed' THEN 'model_failure' WHEN 'not_estimable' THEN 'model_not_estimable' ELSE 'estimated' END AS model_status, coalesce(lfc_shrunken, lfc) AS effect FROM precomputed),
    eff AS (SELECT *, CASE WHEN lfc_shrunken IS NOT NULL THEN 'imported_shrunken_log2fc' WHEN lfc IS NOT NULL THEN 'reported_unshrunken_log2fc' ELSE 'unavailable' END AS effect_source,
      CASE WHEN padj IS NOT NULL THEN 'adjusted_pvalue_available' WHEN filter_status = 'independent_filtered' THEN filter_status WHEN model_status <> 'estimated' THEN model_status ELSE 'adjusted_pvalue_unavailable' END AS padj_status,
      CASE WHEN tested_status = 'not_tested' THEN 'untested' WHEN model_status <> 'estimated' THEN 'not_estimable' WHEN effect IS NULL THEN 'uncertain' WHEN effect < 0 THEN 'decreased' WHEN effect > 0 THEN 'increased' ELSE 'exact_zero' END AS numerical_direction,
      CASE WHEN tested_status = 'not_tested' THEN 'not_tested' WHEN model_status <> 'estimated' THEN 'indeterminate' WHEN filter_status = 'unsupported' THEN 'unsupported' WHEN padj IS NULL THEN 'adjusted_pvalue_unavailable' WHEN padj <= 0.05 THEN 'significant' ELSE 'not_significant' END AS statistical_support,
      CASE WHEN effect IS NULL THEN 'indeterminate' WHEN effect <= -0.5 THEN 'exceeds_decrease_threshold' WHEN effect >= 0.5 THEN 'exceeds_increase_threshold' ELSE 'below_effect_threshold' END AS biological_threshold FROM st)"""
EFFECT_COLUMNS = ("input_order", "gene", "effect", "effect_source", "tested_status", "filter_status", "low_count_status", "model_status", "padj_status", "numerical_direction", "statistical_support", "biological_threshold")


def _effects(precomputed):
    df = precomputed.withColumns({c: F.col(c).cast("double") for c in ("lfc", "lfc_shrunken", "padj")})
    return expression.canonical_effects(expression.imported_statuses(df))


@query("canonical_effects", "precomputed", STATUS_SQL + " SELECT " + ", ".join("CAST(round(effect, 6) AS DOUBLE) AS effect" if c == "effect" else c for c in EFFECT_COLUMNS) + ", CASE WHEN tested_status = 'imported_unknown' THEN 1 ELSE 0 END AS n_warnings FROM eff")
def _(precomputed):
    return _effects(precomputed).select(*EFFECT_COLUMNS, F.size("warnings").alias("n_warnings")).withColumns(r6("effect"))


@query("filtering_summary", "precomputed", STATUS_SQL + " SELECT status, value, count(*) AS n FROM (SELECT unnest(['tested_status', 'filter_status', 'low_count_status', 'model_status', 'statistical_support', 'numerical_direction']) AS status, unnest([tested_status, filter_status, low_count_status, model_status, statistical_support, numerical_direction]) AS value FROM eff) GROUP BY ALL")
def _(precomputed):
    return expression.filtering_summary(_effects(precomputed))


@query("count_validation", "counts samples", """ SELECT 'duplicate_cell' AS "check", count(*) AS n FROM (SELECT 1 FROM counts GROUP BY gene_id, sample HAVING count(*) > 1) UNION ALL SELECT 'unknown_sample', count(*) FROM (SELECT DISTINCT sample FROM counts WHERE sample NOT IN (SELECT sample FROM samples)) UNION ALL SELECT 'negative', count(*) FROM counts WHERE n < 0
    UNION ALL SELECT 'fractional', count(*) FROM counts WHERE n <> floor(n) UNION ALL SELECT 'missing', count(*) FROM counts WHERE n IS NULL UNION ALL SELECT 'absent_condition', 2 - count(DISTINCT condition) FROM samples""")
def _(counts, samples):
    return expression.count_issues(counts, samples)


@query("precomputed_validation", "precomputed", """ SELECT unnest(['base_mean_missing', 'lfc_missing', 'padj_out_of_range', 'duplicate_genes']) AS "check", unnest([count(*) FILTER (base_mean IS NULL), count(*) FILTER (lfc IS NULL), count(*) FILTER (NOT padj BETWEEN 0 AND 1), count(*) - count(DISTINCT gene)]) AS n FROM precomputed""")
def _(precomputed):
    return expression.table_issues(precomputed)


# --- identifiers ---------------------------------------------------------------------------------

TYPE_SQL = r"""CASE WHEN id IS NULL OR trim(id) = '' THEN 'invalid' WHEN regexp_matches(trim(id), '^ENSG\d+(\.\d+)?$') THEN 'ensembl_gene_id' WHEN regexp_matches(trim(id), '^ENST\d+(\.\d+)?$') THEN 'ensembl_transcript_id' WHEN regexp_matches(upper(trim(id)), '^R-[A-Z]{3}-\d+') THEN 'reactome_stable_id'
    WHEN regexp_matches(upper(trim(id)), '^SIGNOR-[A-Z]*\d+$') THEN 'signor_entity_id' WHEN regexp_matches(trim(id), '^\d+$') THEN 'entrez_gene_id' WHEN regexp_matches(upper(trim(id)), '^([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2})$') THEN 'uniprot_accession' WHEN regexp_matches(upper(trim(id)), '^(COMPLEX|FAMILY|SET):') THEN 'pathway_entity_set' ELSE 'hgnc_symbol' END"""


@query("identifier_types", "lookups", f" SELECT id, {TYPE_SQL} AS identifier_type, CASE WHEN {TYPE_SQL} IN ('hgnc_symbol', 'uniprot_accession') THEN upper(trim(id)) ELSE trim(id) END AS normalized FROM lookups")
def _(lookups):
    return lookups.select("id", identifiers.identifier_type(F.col("id")).alias("identifier_type"), identifiers.normalized_identifier(F.col("id")).alias("normalized"))


RESOLVE_SQL = """, ix AS (SELECT DISTINCT i.*, upper(trim(x)) AS lookup FROM (SELECT *, unnest([input_identifier, canonical_symbol, alias, previous_symbol]) AS x FROM identifiers) i WHERE x IS NOT NULL),
    hits AS (SELECT lookup, arg_min(coalesce(canonical_gene_id, ''), input_order) AS g, arg_min(canonical_symbol, input_order) AS sym, arg_min(confidence, input_order) AS conf, arg_min(upper(previous_symbol), input_order) AS prev, count(DISTINCT canonical_gene_id) AS n, bool_or(ambiguous) AS amb, string_agg(DISTINCT canonical_gene_id, ';' ORDER BY canonical_gene_id) AS candidates FROM ix GROUP BY lookup),
    res AS (SELECT id, h.*, CASE WHEN h.lookup IS NULL THEN 'not_in_snapshot' WHEN n > 1 OR amb THEN 'ambiguous' WHEN g = '' THEN 'unmapped' ELSE 'unambiguous' END AS ambiguity_status FROM lookups LEFT JOIN hits h ON h.lookup = upper(trim(id))),
    resolved AS (SELECT id, ambiguity_status, CASE WHEN ambiguity_status = 'unambiguous' THEN g END AS canonical_gene_id, CASE WHEN ambiguity_status = 'unambiguous' THEN sym END AS symbol, CASE WHEN ambiguity_status <> 'unambiguous' THEN 0.0 WHEN conf = 'unambiguous' THEN 1.0 ELSE 0.5 END AS mapping_confidence,
      CASE WHEN ambiguity_status = 'unambiguous' THEN CASE WHEN prev = lookup THEN 'deprecated' ELSE 'current' END END AS deprecated_status, CASE WHEN ambiguity_status = 'ambiguous' THEN coalesce(candidates, '') ELSE '' END AS candidates FROM res)"""


@query("identifier_resolution", "lookups identifiers", RESOLVE_SQL + " SELECT id, ambiguity_status, canonical_gene_id, symbol, CAST(mapping_confidence AS DOUBLE) AS mapping_confidence, deprecated_status, candidates FROM resolved")
def _(lookups, records):
    return identifiers.resolve(lookups, records).withColumn("candidates", F.concat_ws(";", "candidates"))


DOWN_SQL = (
    RESOLVE_SQL
    + STATUS_SQL
    + """, v AS (SELECT e.*, r.canonical_gene_id, r.ambiguity_status FROM eff e LEFT JOIN resolved r ON r.id = e.gene),
    ex AS (SELECT input_order, gene, CASE WHEN canonical_gene_id IS NULL THEN 'canonical_gene_id_unavailable' WHEN ambiguity_status = 'ambiguous' THEN 'ambiguous_identifier_not_allowed' WHEN effect IS NULL THEN 'canonical_effect_unavailable' WHEN model_status = 'model_not_estimable' THEN 'model_not_estimable' WHEN model_status = 'model_failure' THEN 'model_failure' WHEN filter_status = 'unsupported' THEN 'unsupported_expression_state' END AS exclusion,
      CASE WHEN canonical_gene_id IS NULL THEN 'canonical_gene_id_unavailable' WHEN ambiguity_status = 'ambiguous' THEN 'ambiguous_identifier_not_allowed' WHEN effect IS NULL THEN 'canonical_effect_unavailable' WHEN model_status = 'model_failure' THEN 'model_failure' WHEN filter_status = 'unsupported' THEN 'unsupported_expression_state' END AS isoform_exclusion FROM v)"""
)


@query("downstream_views", "precomputed lookups identifiers", DOWN_SQL + " SELECT input_order, gene, exclusion, isoform_exclusion FROM ex")
def _(precomputed, lookups, records):
    r = identifiers.resolve(lookups, records).select(F.col("id").alias("gene"), "canonical_gene_id", "ambiguity_status")
    return _effects(precomputed).join(r, "gene", "left").select("input_order", "gene", expression.exclusion().alias("exclusion"), expression.exclusion(isoform=True).alias("isoform_exclusion"))


# --- evidence graph: consensus edges, and paths to strongly changed genes -------------------------

LINEAGE_SQL = """, rc AS (SELECT *, CASE WHEN functional_only THEN 'functional' WHEN contextual_only THEN 'contextual' WHEN relation IN ('regulates', 'regulation', 'interaction') THEN 'regulatory' ELSE relation END AS relation_class FROM edges),
    lg AS (SELECT source, target, directed, relation_class, relation, sign, record_id, ref, count(DISTINCT evidence_id) AS members, string_agg(DISTINCT provider, ',' ORDER BY provider) AS providers, count(DISTINCT provider) AS n_dbs, min(evidence_id) AS lineage_id, bool_or(functional_only) AS functional_only, bool_or(predicted_only) AS predicted_only FROM rc GROUP BY ALL),
    lc AS (SELECT *, CASE WHEN members > 1 THEN 'exact_duplicate' WHEN (sign = 'positive' AND count(*) FILTER (sign = 'negative') OVER c > 0) OR (sign = 'negative' AND count(*) FILTER (sign = 'positive') OVER c > 0) THEN 'independent_opposing_edge' WHEN count(*) OVER r > 1 THEN 'publication_duplicate'
        WHEN record_id IS NULL AND count(*) OVER d > 1 THEN 'likely_duplicate' ELSE 'independent_same_edge' END AS lineage_class
      FROM lg WINDOW c AS (PARTITION BY source, target, directed, relation_class, relation), r AS (PARTITION BY source, target, directed, relation_class, relation, ref), d AS (PARTITION BY source, target, directed, relation_class, relation, providers)),
    ql AS (SELECT *, CASE WHEN directed THEN 0.12 ELSE 0 END + CASE WHEN sign <> 'unsigned' THEN 0.14 ELSE 0 END + 0.11 + CASE WHEN functional_only THEN 0 ELSE 0.12 END + CASE WHEN predicted_only THEN 0 ELSE 0.12 END + 0.14 / 3 + 0.10 * least(n_dbs, 2) / 2 + 0.15 AS raw_quality FROM lc),
    qq AS (SELECT *, least(CAST(raw_quality AS DOUBLE), CASE WHEN functional_only THEN 0.55 ELSE 1.0 END, CASE WHEN NOT directed OR sign = 'unsigned' THEN 0.45 ELSE 1.0 END, CASE WHEN predicted_only THEN 0.7 ELSE 1.0 END) AS quality FROM ql),
    co AS (SELECT source, target, CASE WHEN functional_only THEN 'functional' ELSE relation_class END AS kind, count(*) FILTER (lineage_class NOT IN ('publication_duplicate', 'likely_duplicate')) AS independent, count(*) FILTER (lineage_class IN ('publication_duplicate', 'likely_duplicate')) AS duplicates, count(*) FILTER (sign = 'positive') AS n_positive, count(*) FILTER (sign = 'negative') AS n_negative, min(quality) AS min_quality, bool_or(directed) AS directed, bool_and(functional_only) AS functional_only, min(lineage_id) AS edge_id,
      array_to_string(list_sort(list_distinct(flatten(list(string_split(providers, ','))))), ',') AS providers FROM qq GROUP BY 1, 2, 3),
    cs AS (SELECT *, CASE WHEN n_positive > 0 AND n_negative > 0 THEN 'conflicting' WHEN n_positive > 0 THEN 'positive' WHEN n_negative > 0 THEN 'negative' ELSE 'unsigned' END AS sign FROM co),
    ly AS (SELECT source, target, 'provider_evidence' AS layer FROM cs UNION ALL SELECT source, target, 'signed_causal' FROM cs WHERE sign IN ('positive', 'negative') AND NOT functional_only UNION ALL SELECT source, target, 'unsigned_functional' FROM cs WHERE sign = 'unsigned' OR functional_only
      UNION ALL SELECT source, target, 'contextual' FROM cs WHERE kind = 'contextual' UNION ALL SELECT source, target, 'conflicting' FROM cs WHERE sign = 'conflicting')"""


def _consensus(edge):
    return edges.consensus(edges.quality(edges.lineage_classes(edges.lineage_groups(edge))))


def walk_sql(starts: str) -> str:
    """Tables se (simple signed causal edges), every (all paths of up to four edges from the nodes of `starts`) and walk
    (the first 25 of each source and target by length, then nodes); needs cs."""
    step = "list_append(w.nodes, s.target), w.cumulative_sign * CASE s.sign WHEN 'negative' THEN -1 ELSE 1 END"
    return f""", se AS MATERIALIZED (SELECT source, target, min(edge_id) AS edge_id, arg_min(sign, edge_id) AS sign FROM cs WHERE source <> target AND sign IN ('positive', 'negative') AND NOT functional_only GROUP BY source, target),
    starts AS MATERIALIZED ({starts}),
    every AS MATERIALIZED (WITH RECURSIVE w AS (SELECT s.source, s.target, [s.source, s.target] AS nodes, CASE s.sign WHEN 'negative' THEN -1 ELSE 1 END AS cumulative_sign, 1 AS n_edges FROM se s JOIN starts ON node = s.source
      UNION ALL SELECT w.source, s.target, {step}, w.n_edges + 1 FROM w JOIN se s ON s.source = w.target WHERE w.n_edges < 4 AND NOT list_contains(w.nodes, s.target)) SELECT * FROM w),
    first26 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY n_edges, nodes) AS rank FROM every QUALIFY rank <= 26),
    walk AS (SELECT * FROM first26 WHERE rank <= 25)"""


#: How a search ends, pair by pair: see `paths.search`.
RESULT_SQL = """, reach AS (WITH RECURSIVE r AS (SELECT s.source, s.target FROM se s JOIN starts ON node = s.source UNION SELECT r.source, s.target FROM r JOIN se s ON s.source = r.target) SELECT * FROM r WHERE source <> target),
    far AS (SELECT DISTINCT w.source, s.target FROM every w JOIN se s ON s.source = w.target WHERE w.n_edges = 4 AND NOT list_contains(w.nodes, s.target)),
    made AS (SELECT source, target, count(*) AS generated FROM first26 GROUP BY ALL),
    ends AS (SELECT r.source, r.target, CASE WHEN generated > 25 THEN 'maximum_paths_per_candidate_reached' WHEN far.source IS NOT NULL THEN 'maximum_path_length_reached' ELSE 'complete' END AS status, coalesce(generated, 0) AS generated, least(coalesce(generated, 0), 25) AS retained
      FROM reach r LEFT JOIN made ON made.source = r.source AND made.target = r.target LEFT JOIN far ON far.source = r.source AND far.target = r.target)"""

#: The same with at most 20000 paths in all, in the order of source and target.
TOTAL_SQL = RESULT_SQL + """, run AS (SELECT *, sum(retained) OVER w - retained AS before, lag(retained, 1, 0) OVER w AS last FROM ends WINDOW w AS (ORDER BY source, target)),
    capped AS (SELECT source, target, before, greatest(20000 - before, 0) AS room, status, generated, retained FROM run WHERE before < 20000 OR before - last < 20000),
    done AS (SELECT source, target, CASE WHEN room = 0 OR (room < generated AND room < 25) THEN 'maximum_total_paths_reached' ELSE status END AS status, CASE WHEN room = 0 THEN 0 WHEN room < generated AND room < 25 THEN room + 1 ELSE generated END AS generated, least(retained, room) AS retained FROM capped)"""


def _causal(edge):
    return stored(_consensus(edge).where("sign in ('positive', 'negative') and not functional_only"))


def _walks(edge, starts, nodes=True):
    """The first 25 signed causal paths of up to four edges from `starts` (node) to each node."""
    return paths.directed(paths.best_paths(_causal(edge), starts, 4, 25, nodes=nodes))


# --- effects, residuals, labels ------------------------------------------------------------------

# Genes of the ratio table meet those of the counts by number; each guide is a run.
EFFECT_SQL = (
    RATIO_SQL
    + CONTRAST_SQL
    + """, cal0 AS (SELECT g.sirna_id AS run_key, g.intended_gene AS target_gene, c.gene_id IS NOT NULL AS has_expression, c.shrunken AS lfc, r.ratio_status, r.n_total, r.m_targetable, r.ratio, CASE WHEN r.ratio > 0 THEN (1 - pow(2.0, c.shrunken)) / r.ratio END AS raw_k FROM guides g LEFT JOIN contrast c ON c.gene_id = g.intended_gene LEFT JOIN ratios r ON r.sirna_id = g.sirna_id AND r.gene_id = g.intended_gene),
    cal AS (SELECT *, CASE WHEN NOT has_expression THEN 'unavailable_missing_expression' WHEN ratio_status IS NULL THEN 'unavailable_invalid_intended_target' WHEN ratio_status <> 'definitive' OR n_total <= 0 OR m_targetable IS NULL OR ratio IS NULL OR ratio <= 0 THEN 'unavailable_intended_target_ratio' WHEN lfc IS NULL THEN 'unavailable_missing_expression' WHEN abs(lfc) <= 1e-9 THEN 'definitive_zero_no_decrease' WHEN lfc > 0 THEN 'unavailable_not_decreased' WHEN raw_k < -1e-9 OR raw_k > 1 + 1e-9 THEN 'unavailable_inconsistent_calibration' ELSE 'definitive' END AS calibration_status FROM cal0),
    calk AS (SELECT run_key, target_gene, calibration_status, CASE calibration_status WHEN 'definitive_zero_no_decrease' THEN 0.0 WHEN 'definitive' THEN CASE WHEN abs(raw_k) <= 1e-9 THEN 0.0 WHEN abs(raw_k - 1) <= 1e-9 THEN 1.0 ELSE greatest(0.0, least(1.0, raw_k)) END END AS k FROM cal),
    ex0 AS (SELECT r.sirna_id AS run_key, r.gene_id, r.n_total, r.m_targetable, r.ratio, r.ratio_status, c.shrunken AS lfc, k.k, 1 - k.k * r.ratio AS rest FROM ratios r LEFT JOIN contrast c ON c.gene_id = r.gene_id LEFT JOIN calk k ON k.run_key = r.sirna_id),
    ex1 AS (SELECT *, CASE WHEN lfc IS NULL THEN 'unavailable_missing_expression' WHEN ratio_status <> 'definitive' THEN 'unavailable_ratio' WHEN k IS NULL OR rest < -1e-9 THEN 'unavailable_calibration' ELSE 'definitive' END AS effect_status FROM ex0),
    ex2 AS (SELECT *, CASE WHEN effect_status = 'definitive' THEN CASE WHEN rest <= 0 THEN -CAST('Infinity' AS DOUBLE) ELSE log2(rest) END END AS expected FROM ex1),
    fx AS (SELECT *, lfc - expected AS residual FROM ex2)"""
)


def _expected(sequences, guides, annotation, counts, samples, own=False, support=None):
    """(calibration, effects). A guide's k comes from its intended gene alone, so it is known before other genes' ratios
    are made; these meet it and their gene's change where they are made, and are neither stored nor shuffled.

    support: (sirna_id, gene_id, support_count), dealt out as sites are; effects then have support_count.
    """
    con = stored(expression.contrasts(expression.library_size_median(counts), samples).select("gene_id", F.col("shrunken").alias("lfc")))
    runs = guides.select(F.col("sirna_id").alias("run_key"), F.col("intended_gene").alias("gene_id"))
    mine = _ratios(sequences, guides, annotation, own=True).withColumnRenamed("sirna_id", "run_key")
    cal = stored(effects.calibrate(runs, runs.distinct().join(con, "gene_id"), mine))
    parts = _gene_parts(sequences, guides, annotation, own)
    if support is not None:
        met, lone = [p.withColumn("support_count", F.lit(None).cast("long")) for p in parts]
        # all three are dealt out by gene into as many tasks, and stay so together
        parts = [met.unionByName(lone.repartition(targetability.tasks(sequences, guides), "gene_id")).unionByName(support, allowMissingColumns=True)]
    ratios = [ratio.gene_ratios(p).withColumnRenamed("sirna_id", "run_key") for p in parts]
    made = [effects.expected(r, con.hint("shuffle_hash"), rna.sized(cal, 500_000)) for r in ratios]
    return cal, reduce(DataFrame.unionByName, made)


def finite(*names: str):
    """Infinite values as +-1e308 and the rest rounded, for comparison with SQL."""
    return {n: F.when(F.col(n) == float("-inf"), -1e308).when(F.col(n) == float("inf"), 1e308).otherwise(F.round(n, 6)) for n in names}


FINITE_SQL = "CASE WHEN {0} < -1e300 THEN -1e308 WHEN {0} > 1e300 THEN 1e308 ELSE round({0}, 6) END AS {0}"


@query("calibration", "sequences guides annotation counts samples", EFFECT_SQL + " SELECT run_key, target_gene, calibration_status, round(k, 6) AS k FROM calk")
def _(*tables):
    """A guide is calibrated on its intended gene: other genes' ratios aren't made."""
    return _expected(*tables, own=True)[0].withColumns(r6("k"))


@query("expected_effects", "sequences guides annotation counts samples", EFFECT_SQL + f" SELECT run_key, gene_id, effect_status, round(lfc, 6) AS lfc, {FINITE_SQL.format('expected')}, {FINITE_SQL.format('residual')} FROM fx")
def _(*tables):
    return _expected(*tables)[1].select("run_key", "gene_id", "effect_status", "lfc", "expected", "residual").withColumns(r6("lfc") | finite("expected", "residual"))


# support of a gene: paths that lead to it from the run's intended target
LABEL_SQL = (
    EFFECT_SQL
    + LINEAGE_SQL
    + walk_sql("SELECT DISTINCT CAST(intended_gene AS VARCHAR) AS node FROM guides")
    + """, kept AS MATERIALIZED (SELECT source, target, least(count(*), 25) AS n FROM every GROUP BY source, target), sup AS MATERIALIZED (SELECT g.sirna_id AS run_key, CAST(target AS BIGINT) AS gene_id, n AS support_count FROM kept JOIN guides g ON source = CAST(g.intended_gene AS VARCHAR)),
    rs AS (SELECT fx.*, coalesce(support_count, 0) AS n, CASE WHEN effect_status = 'definitive' THEN CASE WHEN abs(residual) <= 0.10 THEN 'negligible_residual' WHEN abs(residual) < 0.5 THEN 'weak_residual' WHEN abs(residual) < 1 THEN 'moderate_residual' ELSE 'strong_residual' END END AS residual_magnitude FROM fx LEFT JOIN sup ON sup.gene_id = fx.gene_id AND sup.run_key = fx.run_key),
    rt AS (SELECT *, CASE WHEN effect_status <> 'definitive' THEN 'unresolved_upstream_expected_effect' WHEN residual_magnitude = 'negligible_residual' THEN 'no_residual_to_attribute' WHEN n <= 0 THEN 'residual_without_pathway_support' WHEN n >= 4 THEN 'residual_with_strong_pathway_support' WHEN n >= 2 THEN 'residual_with_moderate_pathway_support' ELSE 'residual_with_weak_pathway_support' END AS support_status FROM rs),
    ig AS (SELECT *, CASE WHEN ratio_status <> 'definitive' THEN 'unresolved_targetability' WHEN m_targetable > 0 THEN 'definitive_targetable_fraction_present' ELSE 'no_cleavage_compatible_targetability' END AS sequence_component, CASE WHEN expected IS NULL THEN 'expected_direct_effect_unavailable' WHEN abs(expected) <= 1e-9 THEN 'expected_direct_effect_zero' ELSE 'expected_direct_effect_nonzero' END AS expected_component FROM rt),
    lb AS (SELECT *, CASE WHEN support_status = 'unresolved_upstream_expected_effect' THEN 'unresolved' WHEN residual_magnitude = 'negligible_residual' AND expected_component = 'expected_direct_effect_zero' THEN 'no_evidence_for_effect'
       WHEN m_targetable > 0 AND residual_magnitude IN ('moderate_residual', 'strong_residual') AND n >= 2 THEN 'mixed_supported' WHEN m_targetable = 0 AND residual_magnitude IN ('moderate_residual', 'strong_residual') AND n >= 2 THEN 'secondary_supported'
       WHEN m_targetable > 0 AND expected_component = 'expected_direct_effect_nonzero' AND residual_magnitude IN ('negligible_residual', 'weak_residual') AND support_status IN ('no_residual_to_attribute', 'residual_without_pathway_support') THEN 'direct_compatible' ELSE 'unresolved' END AS label FROM ig),
    labels_ AS (SELECT *, CASE label WHEN 'unresolved' THEN 'unresolved' WHEN 'no_evidence_for_effect' THEN 'moderate' WHEN 'direct_compatible' THEN CASE WHEN residual_magnitude = 'negligible_residual' THEN 'high' ELSE 'moderate' END ELSE CASE WHEN residual_magnitude = 'strong_residual' AND n >= 4 THEN 'high' ELSE 'moderate' END END AS confidence FROM lb)"""
)


def _labels(sequences, guides, annotation, counts, samples, edge):
    return effects.classify(effects.integrate(effects.residuals(_supported(sequences, guides, annotation, counts, samples, edge))))


def _supported(sequences, guides, annotation, counts, samples, edge):
    """Expected effects with support_count (null: none). Support is dealt out by gene as sites are and summed with the parts
    of a ratio: nothing of guides times genes is stored, and of it only support is shuffled."""
    runs = guides.select(F.col("sirna_id").alias("run_key"), F.col("intended_gene").cast("string").alias("source"))
    genes = sequences.select(F.col("gene_id").cast("string").alias("node")).where("node is not null").distinct()  # no others have a ratio
    # what the search retains is a gene's support; it is counted, not made
    found = paths.path_counts(_causal(edge), runs.select(F.col("source").alias("node")).distinct(), 4, 25, genes)
    into = found.join(rna.sized(runs, 500_000), "source").select(F.col("run_key").alias("sirna_id"), F.col("target").cast("long").alias("gene_id"), F.col("n_paths").alias("support_count"))
    return _expected(sequences, guides, annotation, counts, samples, support=into.repartition(targetability.tasks(sequences, guides), "gene_id"))[1]


@query("residual_attribution", "sequences guides annotation counts samples edges", LABEL_SQL + " SELECT run_key, gene_id, CASE WHEN effect_status = 'definitive' THEN CASE WHEN abs(residual) <= 1e-9 THEN 'matches_expected_direct_effect' WHEN residual < 0 THEN 'more_decreased_than_expected' ELSE 'less_decreased_or_increased_than_expected' END END AS residual_direction, residual_magnitude, n AS support_count, support_status FROM rt")
def _(*tables):
    return _labels(*tables).select("run_key", "gene_id", "residual_direction", "residual_magnitude", "support_count", "support_status")


@query("evidence_integration", "sequences guides annotation counts samples edges", LABEL_SQL + " SELECT run_key, gene_id, sequence_component, expected_component, support_status AS pathway_component, CASE WHEN support_status = 'unresolved_upstream_expected_effect' THEN 'unresolved_upstream_residual_attribution' ELSE 'ready_for_final_classification' END AS readiness FROM ig")
def _(*tables):
    return _labels(*tables).select("run_key", "gene_id", "sequence_component", "expected_component", "pathway_component", "readiness")


@query("evidence_labels", "sequences guides annotation counts samples edges", LABEL_SQL + " SELECT run_key, gene_id, label, confidence FROM labels_")
def _(*tables):
    return _labels(*tables).select("run_key", "gene_id", "label", "confidence")


@query("label_summary", "sequences guides annotation counts samples edges", LABEL_SQL + " SELECT label, confidence, count(*) AS genes FROM labels_ GROUP BY ROLLUP (label, confidence)")
def _(*tables):
    return effects.label_summary(_labels(*tables))


@query("edge_lineage", "edges", LINEAGE_SQL + " SELECT source, target, directed, relation_class, relation, sign, record_id, ref, members, providers, lineage_class, round(quality, 6) AS quality FROM qq")
def _(edge):
    q = edges.quality(edges.lineage_classes(edges.lineage_groups(edge)))
    return q.select("source", "target", "directed", "relation_class", "relation", "sign", "record_id", "ref", "members", F.concat_ws(",", "providers").alias("providers"), "lineage_class", F.round("quality", 6).alias("quality"))


@query("edge_consensus", "edges", LINEAGE_SQL + " SELECT source, target, kind, independent, duplicates, n_positive, n_negative, round(min_quality, 6) AS min_quality, directed, functional_only, edge_id, sign, providers FROM cs")
def _(edge):
    return _consensus(edge).drop("layers").withColumn("providers", F.concat_ws(",", "providers")).withColumns(r6("min_quality"))


@query("graph_layers", "edges", LINEAGE_SQL + " SELECT e.layer, e.edges, n.nodes FROM (SELECT layer, count(*) AS edges FROM ly GROUP BY layer) e JOIN (SELECT layer, count(DISTINCT x) AS nodes FROM (SELECT layer, source AS x FROM ly UNION ALL SELECT layer, target FROM ly) GROUP BY layer) n ON n.layer = e.layer")
def _(edge):
    return edges.layer_counts(_consensus(edge))


@query("provider_coverage", "edges", LINEAGE_SQL + """ SELECT p.provider, p.edges, p.signed, p.unsigned, p."references", coalesce(c.n, 0) AS consensus_edges FROM (SELECT provider, count(*) AS edges, count(*) FILTER (sign <> 'unsigned') AS signed, count(*) FILTER (sign = 'unsigned') AS unsigned, count(DISTINCT ref) AS "references" FROM edges GROUP BY provider) p
    LEFT JOIN (SELECT provider, count(*) AS n FROM (SELECT DISTINCT provider, source, target, relation_class AS kind FROM rc) GROUP BY provider) c ON c.provider = p.provider""")
def _(edge):
    return edges.provider_coverage(edge, _consensus(edge))


@query("pair_consensus", "edges", """ SELECT source, target, count(*) FILTER (sign = 'positive') AS n_positive, count(*) FILTER (sign = 'negative') AS n_negative, CAST(0 AS BIGINT) AS n_conflicting, count(*) FILTER (sign = 'unsigned') AS n_unsigned, bool_or(directed AND NOT functional_only) AND count(*) FILTER (sign = 'positive') * count(*) FILTER (sign = 'negative') = 0 AND count(*) FILTER (sign <> 'unsigned') > 0 AS causal,
    CASE WHEN count(*) FILTER (sign = 'positive') > 0 AND count(*) FILTER (sign = 'negative') > 0 THEN 'conflicting' WHEN count(*) FILTER (sign = 'positive') > 0 THEN 'positive' WHEN count(*) FILTER (sign = 'negative') > 0 THEN 'negative' ELSE 'unsigned' END AS sign FROM edges GROUP BY source, target""")
def _(edge):
    return edges.pair_consensus(edge)


START_SQL = "SELECT DISTINCT source AS node FROM se WHERE CAST(source AS BIGINT) % 20 = 0"
PATH_SQL = LINEAGE_SQL + walk_sql(START_SQL)


def _starts(edge):
    """Every node whose number is divisible by 20 (the stated query set)."""
    return edge.select(F.col("source").alias("node")).where("cast(node as long) % 20 = 0").distinct()


def _paths(edge, nodes=True):
    return _walks(edge, _starts(edge), nodes)


@query("signed_paths", "edges", PATH_SQL + " SELECT source, target, array_to_string(nodes, '>') AS nodes, n_edges, cumulative_sign, CASE cumulative_sign WHEN 1 THEN 'down' ELSE 'up' END AS expected_direction FROM walk")
def _(edge):
    """A row for each path that the search keeps."""
    return _paths(edge).select("source", "target", F.array_join("nodes", ">").alias("nodes"), "n_edges", "cumulative_sign", "expected_direction")


@query("path_search_results", "edges", PATH_SQL + RESULT_SQL + """ SELECT e.source, e.target, 'all_reachable_entities' AS scope, status, CASE status WHEN 'complete' THEN 'all_simple_paths_exhausted' WHEN 'maximum_path_length_reached' THEN 'search_cutoff_depth_reached' ELSE status END AS reason, generated, retained, generated - retained AS discarded, generated - retained AS discarded_per_candidate, CAST(0 AS BIGINT) AS discarded_total, CAST(coalesce(max_depth, 0) AS BIGINT) AS max_depth, status <> 'complete' AS truncated
    FROM ends e LEFT JOIN (SELECT source, target, max(n_edges) AS max_depth FROM first26 GROUP BY ALL) d ON d.source = e.source AND d.target = e.target""")
def _(edge):
    """How the search ends for each source and each node that it can reach."""
    return paths.search(_causal(edge), _starts(edge), 4, 25)[1].withColumns({c: F.col(c).cast("long") for c in ("discarded_total", "max_depth")})


@query("path_search_total", "edges", PATH_SQL + TOTAL_SQL + " SELECT source, target, status, generated, retained, generated - retained AS discarded, status LIKE 'maximum%' AS truncated FROM done")
def _(edge):
    """The same search with at most 20,000 paths in all: a limit of the search itself."""
    return paths.search(_causal(edge), _starts(edge), 4, 25, 20_000)[1].select("source", "target", "status", "generated", "retained", "discarded", "truncated")


@query("path_conflicts", "edges", PATH_SQL + " SELECT source, target, count(*) FILTER (cumulative_sign = 1) AS n_positive, count(*) FILTER (cumulative_sign = -1) AS n_negative, min(n_edges) FILTER (cumulative_sign = 1) AS shortest_positive, min(n_edges) FILTER (cumulative_sign = -1) AS shortest_negative FROM walk GROUP BY source, target HAVING count(DISTINCT cumulative_sign) = 2")
def _(edge):
    return paths.conflicts(_paths(edge, nodes=False))


@query("shortest_paths", "edges", PATH_SQL + " SELECT source, target, n_edges, array_to_string(nodes, '>') AS nodes FROM walk WHERE rank = 1")
def _(edge):
    return paths.shortest(_paths(edge)).withColumn("nodes", F.array_join("nodes", ">"))


# --- enrichment ----------------------------------------------------------------------------------

GENES_SQL = (
    STATUS_SQL
    + """, ge AS (SELECT gene, effect, padj, CASE numerical_direction WHEN 'decreased' THEN 'down' WHEN 'increased' THEN 'up' ELSE 'unchanged' END AS direction, low_count_status = 'low_count' AS low_count, tested_status <> 'not_tested' AS tested FROM eff),
    ch AS (SELECT *, NOT low_count AND padj <= 0.05 AND abs(effect) >= 0.5 AS changed FROM ge),
    gs AS (SELECT DISTINCT * FROM (SELECT 'up' AS gene_set, gene FROM ch WHERE changed AND effect > 0 AND direction = 'up' UNION ALL SELECT 'down', gene FROM ch WHERE changed AND effect < 0 AND direction = 'down' UNION ALL SELECT 'changed', gene FROM ch WHERE changed UNION ALL SELECT 'low_count', gene FROM ch WHERE low_count)),
    bg AS (SELECT gene, CASE WHEN NOT bool_or(tested) THEN 'not_tested' WHEN bool_and(low_count) THEN 'not_detectable' WHEN gene NOT IN (SELECT gene FROM memberships) THEN 'not_annotatable' END AS exclusion FROM ge GROUP BY gene)"""
)


def _genes(precomputed):
    e = _effects(precomputed)
    return e.select("gene", "effect", "padj", expression.recoded_direction(F.col("numerical_direction")).alias("direction"), (F.col("low_count_status") == "low_count").alias("low_count"), (F.col("tested_status") != "not_tested").alias("tested"), F.lit(True).alias("mapped"))


@query("gene_sets", "precomputed memberships", GENES_SQL + " SELECT gene_set, gene FROM gs")
def _(precomputed, memberships):
    return enrichment.gene_sets(_genes(precomputed))


@query("enrichment_background", "precomputed memberships", GENES_SQL + " SELECT gene, exclusion FROM bg")
def _(precomputed, memberships):
    return enrichment.background(_genes(precomputed), memberships)


ORA_SQL = (
    GENES_SQL
    + """, u AS (SELECT gene FROM bg WHERE exclusion IS NULL), nb AS (SELECT count(*) AS n_bg FROM u),
    mt AS (SELECT DISTINCT dataset, term_id, gene FROM memberships m WHERE gene IN (SELECT gene FROM u) AND NOT EXISTS (SELECT 1 FROM memberships p WHERE p.dataset = m.dataset AND p.term_id = m.term_id AND p.completeness <> 'complete')),
    ss AS (SELECT gene_set, gene FROM gs WHERE gene IN (SELECT gene FROM u)), nt AS (SELECT dataset, term_id, count(*) AS n_term FROM mt GROUP BY ALL), ns AS (SELECT gene_set, count(*) AS n_set FROM ss GROUP BY ALL),
    ov AS (SELECT gene_set, dataset, term_id, count(*) AS a FROM ss JOIN mt ON mt.gene = ss.gene GROUP BY ALL),
    tb AS (SELECT ov.*, n_set, n_term, n_bg, n_set - a AS b, n_term - a AS c, n_bg - n_set - n_term + a AS d FROM ov JOIN nt ON nt.dataset = ov.dataset AND nt.term_id = ov.term_id JOIN ns ON ns.gene_set = ov.gene_set CROSS JOIN nb),
    hy AS (SELECT gene_set, dataset, term_id, a, b, c, d, n_set * n_term / n_bg AS expected, sum(exp(lgamma(n_term + 1) - lgamma(x + 1) - lgamma(n_term - x + 1) + lgamma(n_bg - n_term + 1) - lgamma(n_set - x + 1) - lgamma(n_bg - n_term - n_set + x + 1) - lgamma(n_bg + 1) + lgamma(n_set + 1) + lgamma(n_bg - n_set + 1))) AS p FROM (SELECT *, unnest(range(a, least(n_set, n_term) + 1)) AS x FROM tb) GROUP BY ALL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY gene_set, dataset ORDER BY p) AS r, count(*) OVER (PARTITION BY gene_set, dataset) AS m FROM hy)"""
)


def _ora(precomputed, memberships):
    genes = _genes(precomputed)
    universe = enrichment.background(genes, memberships).where("exclusion is null")
    return enrichment.benjamini_hochberg(enrichment.overrepresentation(enrichment.gene_sets(genes), memberships, universe), "gene_set", "dataset")


@query("overrepresentation", "precomputed memberships", ORA_SQL + " SELECT gene_set, dataset, term_id, a, b, c, d, round(expected, 6) AS expected, round(a / expected, 6) AS fold, round(least(p, 1.0), 6) AS p_value, round(least(1.0, min(p * m / r) OVER (PARTITION BY gene_set, dataset ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 6) AS q_value FROM rk")
def _(precomputed, memberships):
    return _ora(precomputed, memberships).select("gene_set", "dataset", "term_id", "a", "b", "c", "d", "expected", "fold", "p_value", "q_value").withColumns(r6("expected", "fold", "p_value", "q_value"))


@query("membership_coverage", "memberships", " SELECT dataset, term_id, count(*) AS rows, count(DISTINCT gene) AS genes, bool_and(completeness = 'complete') AS complete FROM memberships GROUP BY ALL")
def _(memberships):
    return enrichment.coverage(memberships)


# --- audits --------------------------------------------------------------------------------------


PLANTED_SQL = """, kept AS (SELECT transcript_id, CASE WHEN transcript_id % 37 = 0 THEN gene_id + 1 ELSE gene_id END AS gene_id, CASE WHEN transcript_id % 41 = 0 THEN concat(sequence, 'X') ELSE sequence END AS sequence FROM sequences WHERE transcript_id % 43 <> 0),
    pl AS (SELECT * FROM kept UNION ALL SELECT * FROM kept WHERE transcript_id % 31 = 0)"""


@query("sequence_validation", "sequences annotation", PLANTED_SQL + """ SELECT 'duplicate' AS "check", transcript_id FROM pl GROUP BY transcript_id HAVING count(*) > 1 UNION ALL SELECT 'wrong_gene', p.transcript_id FROM pl p JOIN annotation a ON a.transcript_id = p.transcript_id WHERE p.gene_id <> a.gene_id
    UNION ALL SELECT 'missing', a.transcript_id FROM annotation a WHERE NOT EXISTS (SELECT 1 FROM pl WHERE pl.transcript_id = a.transcript_id AND sequence <> '') UNION ALL SELECT 'alphabet', transcript_id FROM pl WHERE NOT regexp_full_match(sequence, '[ACGT]*')""")
def _(sequences, annotation):
    """Some sequences are left out, some doubled, some say another gene, some hold a foreign letter."""
    at = F.col("transcript_id")
    kept = sequences.select("transcript_id", "gene_id", "sequence").where(at % 43 != 0)
    kept = kept.withColumns({"gene_id": F.when(at % 37 == 0, F.col("gene_id") + 1).otherwise(F.col("gene_id")), "sequence": F.when(at % 41 == 0, F.concat("sequence", F.lit("X"))).otherwise(F.col("sequence"))})
    return targetability.sequence_issues(kept.unionByName(kept.where(at % 31 == 0)), annotation)


FLAGSHIP = "evidence_labels"

# the rest of the registered queries
from . import queries_decisions, queries_io, queries_more  # noqa: E402, F401
