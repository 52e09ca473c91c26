"""Known values, golden tables and edge cases of the evidence engine."""

import math

import pytest
from pyspark.sql import functions as F

from strandlake.functions import rna
from strandlake.operators import audit, edges, effects, enrichment, expression, identifiers, isoform, paths, ratio, sites, targetability
from strandlake.plans.policies import TargetabilityPolicy
from strandlake.sources import files, providers
from strandlake.streaming import stages


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(spark, **columns):
    return spark.range(1).select(*[F.expr(v).alias(k) for k, v in columns.items()])


# --- sequences -----------------------------------------------------------------------------------


def test_reverse_complement_and_seed(spark):
    df = one(spark, s="'aucg'", g="'AACCGGTTAACCGGTTAACCG'").select(rna.reverse_complement(F.col("s")), rna.guide_seed(F.col("g")), rna.target_seed(F.col("g")))
    assert rows(df) == [("CGAT", "ACCGGTT", "AACCGGT")]


def test_guide_mismatches_and_wobble(spark):
    df = one(spark, g="'GAAA'", w="'TTTT'").select(rna.guide_mismatches("g", "w"), rna.guide_mismatches("g", "w", "complemented"), rna.guide_mismatches("g", "w", "true_gu"))
    assert rows(df) == [([1], [1], [])]


GOLD = [("FULL_tx1", "FULL", "CCC" + "T" * 21 + "GGG"), ("SEED_tx1", "SEED", "GGGG" + "CCCCCCCCCCCC" + "TTTTTTTT" + "C" + "GGGG"), ("NONE_tx1", "NONE", "ACAC" * 10), ("SHORT_tx", "NONE", "TTT"), ("EMPTY_tx", "NONE", "")]


@pytest.fixture()
def gold(spark):
    seqs = spark.createDataFrame(GOLD, "transcript_id string, gene_id string, sequence string")
    guides = spark.createDataFrame([("g1", "A" * 21, "T" * 21, "FULL"), ("g2", "A" * 30, None, "X"), ("g3", "AUT" + "A" * 18, None, "X"), ("g4", None, None, "X"), ("g5", "ANA" + "A" * 18, None, None)], "sirna_id string, guide string, passenger string, intended_gene string")
    return seqs, guides


def test_guide_validation(gold):
    got = {r.sirna_id: r.status for r in targetability.validate_guides(gold[1]).collect()}
    assert got == {"g1": "ok", "g2": "unsupported_length", "g3": "mixed_rna_and_dna", "g4": "missing_guide", "g5": "invalid_alphabet"}


def test_evidence_scan_equals_complete_scan_without_partial_sites(gold):
    keep = [*targetability.SITE, "priority", "n_total_mm"]
    some = targetability.scan(*gold).select(*keep)
    full = targetability.scan(*gold, mode="complete").where("n_seed_mm = 0").select(*keep)
    assert sorted(rows(some)) == sorted(rows(full))
    assert ("g1", "FULL_tx1", "FULL", 3, 0, 0) in rows(some)


def test_scan_against_brute_force_over_chunks(spark):
    import random

    rnd = random.Random(3)
    text = "".join(rnd.choice("ACGT") for _ in range(1500))
    guide = text[500:521].translate(str.maketrans("ACGT", "TGCA"))[::-1]
    near = list(text[500:521])
    near[15] = "A" if near[15] != "A" else "C"
    text = text[:900] + "".join(near) + text[921:]
    seqs = spark.createDataFrame([(1, 1, text)], "transcript_id long, gene_id long, sequence string")
    guides = spark.createDataFrame([(7, guide, guide, 1)], "sirna_id long, guide string, passenger string, intended_gene long")
    got = {(r.start, r.n_total_mm) for r in targetability.scan(seqs, guides).collect()}
    search = text[500:521]
    want = {(i, sum(a != b for a, b in zip(search, text[i : i + 21]))) for i in range(len(text) - 20) if text[i + 1 : i + 8] == search[1:8]}
    assert got == want and (500, 0) in got and (900, 1) in got
    found = sites.full_sites(seqs, sites.strands(guides).where("strand = 'guide'"))
    want4 = {i for i in range(len(text) - 20) if sum(a != b for a, b in zip(search, text[i : i + 21])) <= 4}
    assert {r.start for r in found.collect()} == want4


@pytest.mark.parametrize("n", [8, 14, 21, 26, 31, 33, 70])
def test_full_sites_of_any_length(spark, n):
    import random

    rnd = random.Random(n)
    text = "".join(rnd.choice("ACGTN" if i % 97 == 0 else "ACGT") for i in range(900))
    near = [text[300 : 300 + n], text[600 : 600 + n]]
    seqs = spark.createDataFrame([(1, 1, text), (2, 1, ""), (3, 1, None), (4, 1, text[:n])], "transcript_id long, gene_id long, sequence string")
    strand = spark.createDataFrame([(k, "guide", x.translate(str.maketrans("ACGTN", "TGCAA"))[::-1]) for k, x in enumerate(near)], "sirna_id long, strand string, guide string")
    for most in (1, 4):
        got = sorted((r.sirna_id, r.transcript_id, r.start) for r in sites.full_sites(seqs, strand, most).collect())
        search = [r.guide.translate(str.maketrans("ACGT", "TGCA"))[::-1] for r in sorted(strand.collect())]
        want = sorted((k, t, i) for k, q in enumerate(search) for t, s in ((1, text), (4, text[:n])) for i in range(len(s) - n + 1) if sum(a != b for a, b in zip(q, s[i : i + n], strict=True)) <= most)
        assert got == want and got


def test_seed_mismatches_by_blocks(gold):
    policy = targetability.TargetabilityPolicy(max_seed=2)
    keep = [*targetability.SITE, "priority", "n_total_mm", "n_seed_mm"]
    some = targetability.scan(*gold, policy=policy).select(*keep)
    full = targetability.scan(*gold, mode="complete", policy=policy).where("priority <> 4").select(*keep)
    assert sorted(rows(some)) == sorted(rows(full)) and some.count()


def test_decisions_for_absent_and_unavailable(gold, spark):
    seqs, guides = gold
    best = targetability.best_sites(targetability.scan(seqs, guides))
    wanted = spark.createDataFrame([("g1", t) for t in ("FULL_tx1", "NONE_tx1", "EMPTY_tx", "MISSING")], "sirna_id string, transcript_id string")
    got = {r.transcript_id: r.decision for r in targetability.with_absent(best, wanted, seqs).collect()}
    assert got == {"FULL_tx1": "cleavage_candidate_present", "NONE_tx1": "no_supported_site", "EMPTY_tx": "sequence_unavailable", "MISSING": "sequence_unavailable"}


def test_missing_sequence_policies(gold, spark):
    e = spark.createDataFrame([("FULL_tx1", "FULL"), ("FULL_tx2", "FULL"), ("NONE_tx1", "NONE")], "transcript_id string, gene_id string")
    left, gone = targetability.missing_sequences(e, gold[0])
    assert left.count() == 2 and rows(gone.select("transcript_id")) == [("FULL_tx2",)]
    left, failed = targetability.missing_sequences(e, gold[0], "fail_gene")
    assert rows(left.select("gene_id")) == [("NONE",)] and rows(failed.select("gene_id")) == [("FULL",)]
    with pytest.raises(ValueError):
        targetability.missing_sequences(e, gold[0], "fail_stage")


# --- M/N, effects, labels ------------------------------------------------------------------------


def test_m_over_n_statuses(spark):
    parts = spark.createDataFrame([("g", "A", "a1", 1, None, True), ("g", "A", "a2", 0, "does_not_qualify_seed_only", True), ("g", "B", "b1", None, "unresolved_sequence_unavailable", False), ("g", "B", "b2", 1, None, False), ("g", "C", "c1", None, "gene_failed_targetability", False)], "sirna_id string, gene_id string, transcript_id string, contribution_to_m int, reason string, seed_only boolean")
    wanted = spark.createDataFrame([("g", "D")], "sirna_id string, gene_id string")
    got = {r.gene_id: (r.n_total, r.m_targetable, r.ratio, r.ratio_status, r.ratio_low, r.ratio_high) for r in ratio.gene_ratios(parts, wanted).collect()}
    assert got == {"A": (2, 1, 0.5, "definitive", None, None), "B": (2, None, None, "unavailable_incomplete_evidence", 0.5, 1.0), "C": (1, None, None, "unavailable_gene_failure", 0.0, 1.0), "D": (0, None, None, "undefined_zero_denominator", None, None)}
    assert audit.ratio_audit(ratio.gene_ratios(parts, wanted), parts, wanted).count() == 0
    assert audit.ratio_audit(ratio.gene_ratios(parts, wanted).withColumn("m_targetable", F.lit(9).cast("long")), parts, wanted).count() > 0


def run_effects(spark, lfc, n, m):
    r = spark.createDataFrame([("r", "T", n, m, m / n, "definitive")], "run_key string, gene_id string, n_total long, m_targetable long, ratio double, ratio_status string")
    e = spark.createDataFrame([("r", "T", lfc)], "run_key string, gene_id string, lfc double")
    t = r.select("run_key", "gene_id")
    cal = effects.calibrate(t, e, r)
    return cal.first(), effects.expected(r, e, cal).first()


@pytest.mark.parametrize(("lfc", "n", "m", "k", "status"), [(math.log2(0.5), 1, 1, 0.5, "definitive"), (math.log2(0.75), 2, 1, 0.5, "definitive"), (math.log2(0.25), 2, 1, None, "unavailable_inconsistent_calibration"), (0.0, 1, 1, 0.0, "definitive_zero_no_decrease"), (1.0, 1, 1, None, "unavailable_not_decreased"), (None, 1, 1, None, "unavailable_missing_expression")])
def test_calibration_known_values(spark, lfc, n, m, k, status):
    cal, exp = run_effects(spark, lfc, n, m)
    assert cal.calibration_status == status
    assert cal.k == (pytest.approx(k) if k is not None else None)
    if k is not None:
        assert exp.residual == pytest.approx(0, abs=1e-9)


def test_expected_effect_can_be_minus_infinity(spark):
    cal, _ = run_effects(spark, -60.0, 1, 1)
    assert cal.k == pytest.approx(1.0)
    r = spark.createDataFrame([("r", "T", 1, 1, 1.0, "definitive")], "run_key string, gene_id string, n_total long, m_targetable long, ratio double, ratio_status string")
    e = spark.createDataFrame([("r", "T", -1.0)], "run_key string, gene_id string, lfc double")
    c = spark.createDataFrame([("r", 1.0, "definitive")], "run_key string, k double, calibration_status string")
    got = effects.expected(r, e, c).first()
    assert got.expected == float("-inf") and got.residual == float("inf")


def test_residual_bands_and_labels(spark):
    base = [("r", g, 2, m, m / 2, "definitive", res + exp, exp, res, "definitive") for g, m, exp, res in (("a", 1, -0.4, 0.10), ("b", 0, 0.0, 0.7), ("c", 1, -0.4, 1.0), ("d", 0, 0.0, 0.0), ("e", 0, 0.0, 0.3))]
    df = spark.createDataFrame([*base, ("r", "f", 2, None, None, "unavailable_incomplete_evidence", 0.1, None, None, "unavailable_ratio")], "run_key string, gene_id string, n_total long, m_targetable long, ratio double, ratio_status string, lfc double, expected double, residual double, effect_status string")
    sup = spark.createDataFrame([("r", "b", 2), ("r", "c", 4)], "run_key string, gene_id string, support_count long")
    got = {r.gene_id: (r.label, r.confidence) for r in effects.classify(effects.integrate(effects.residuals(df, sup))).collect()}
    assert got == {"a": ("direct_compatible", "high"), "b": ("secondary_supported", "moderate"), "c": ("mixed_supported", "high"), "d": ("no_evidence_for_effect", "moderate"), "e": ("unresolved", "unresolved"), "f": ("unresolved", "unresolved")}
    absent = effects.classify(effects.integrate(effects.residuals(df, sup, pathway_available=False))).where("gene_id = 'b'").first()
    assert (absent.reason, absent.readiness) == ("unresolved_pathway_context", "ready_with_unresolved_pathway_context")


# --- expression, identifiers ---------------------------------------------------------------------


def test_status_words(spark):
    df = spark.createDataFrame([(" YES ",), (None,), ("",), ("weird",)], "x string")
    assert [r[0] for r in df.select(expression.status(F.col("x"), expression.TESTED)).collect()] == ["tested", "tested", "tested", "imported_unknown"]


def test_number_keeps_missing_missing(spark):
    df = spark.createDataFrame([("1.5",), ("nan",), (" ",), ("x",), (None,)], "x string")
    assert [r[0] for r in df.select(expression.number("x")).collect()] == [1.5, None, None, None, None]


def test_library_size(spark):
    c = spark.createDataFrame([("g", "s1", 10.0), ("h", "s1", 10.0), ("g", "s2", 30.0), ("h", "s2", 10.0)], "gene_id string, sample string, n double")
    got = {(r.gene_id, r.sample): r.normalized for r in expression.library_size_median(c).collect()}
    assert got["g", "s1"] == pytest.approx(15) and got["g", "s2"] == pytest.approx(22.5)


def test_identifier_types(spark):
    df = spark.createDataFrame([("ENSG00000141510.5",), ("tp53",), ("P04637",), ("R-HSA-123",), ("7157",), ("complex:x",), ("",)], "id string")
    got = rows(df.select(identifiers.identifier_type(F.col("id")), identifiers.normalized_identifier(F.col("id"))))
    assert got == [("ensembl_gene_id", "ENSG00000141510"), ("hgnc_symbol", "TP53"), ("uniprot_accession", "P04637"), ("reactome_stable_id", "R-HSA-123"), ("entrez_gene_id", "7157"), ("pathway_entity_set", "complex:x"), ("invalid", "")]


def test_resolution(spark):
    rec = spark.createDataFrame([(1, "A1", "G1", "SA", "al", "OLD", False, "unambiguous"), (2, "A2", "G2", "SB", "al", None, False, "probable"), (3, "A3", None, "SC", None, None, False, "x")], "input_order int, input_identifier string, canonical_gene_id string, canonical_symbol string, alias string, previous_symbol string, ambiguous boolean, confidence string")
    ids = spark.createDataFrame([("a1",), ("AL",), ("old",), ("A3",), ("zz",)], "id string")
    got = {r.id: (r.ambiguity_status, r.canonical_gene_id, r.deprecated_status) for r in identifiers.resolve(ids, rec).collect()}
    assert got == {"a1": ("unambiguous", "G1", "current"), "AL": ("ambiguous", None, None), "old": ("unambiguous", "G1", "deprecated"), "A3": ("unmapped", None, None), "zz": ("not_in_snapshot", None, None)}


def test_isoform_helpers(spark):
    df = one(spark, c="100D", t="50D").select(isoform.targetable_fraction(F.col("c"), F.col("t"), 0.5, 0.8), isoform.efficiency_grid(0.5, 0.6, 0.05))
    got = df.first()
    assert got[0].lower == pytest.approx(0.625) and got[0].upper == 1.0 and got[1] == [0.5, 0.55, 0.6]


def test_external_proportions(spark):
    ok = spark.createDataFrame([("A", "a1"), ("A", "a2"), ("B", "b1")], "gene_id string, transcript_id string")
    ext = spark.createDataFrame([("A", "a1", 0.6), ("A", "zz", 0.2), ("B", "b1", 1.0)], "gene_id string, transcript_id string, proportion double")
    assert {(r.gene_id, r.issue) for r in isoform.external_issues(ext, ok).collect()} == {("A", "not_eligible"), ("A", "missing"), ("A", "sum_not_one")}
    w = {r.transcript_id: r.weight for r in isoform.external_weights(ext, ok, missing_as_zero=True).collect()}
    assert w == {"a1": pytest.approx(1.0), "a2": 0.0, "b1": 1.0}


# --- graph, enrichment ---------------------------------------------------------------------------


def test_paths(spark):
    e = spark.createDataFrame([("a", "b", "e1", "positive"), ("a", "b", "e0", "negative"), ("b", "c", "e2", "negative"), ("c", "a", "e3", "positive"), ("c", "d", "e4", "unsigned")], "source string, target string, edge_id string, sign string")
    start = spark.createDataFrame([("a",)], "node string")
    p = paths.signed(paths.enumerate_paths(e, start, 3))
    got = {">".join(r.nodes): (r.is_signed, r.cumulative_sign) for r in p.collect()}
    assert got == {"a>b": (True, -1), "a>b>c": (True, 1), "a>b>c>d": (False, None)}
    assert {r.node for r in paths.reachable(e, start, lambda d: d.cache()).collect()} == {"b", "c", "d"}
    assert rows(paths.sources(e, spark.createDataFrame([("d",), ("x",)], "node string")).orderBy("node")) == [("d", "source_without_out_edges"), ("x", "source_not_in_graph")]
    assert paths.beyond_cutoff(e, start, 2).count() == 1 and paths.beyond_cutoff(e, start, 3).count() == 0


def test_context_comparison(spark):
    df = spark.createDataFrame([("liver,kidney", "Kidney, liver"), ("liver", "liver,lung"), ("a", "b"), (None, "b"), ("a", ""), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(edges.context_comparison(F.col("a"), F.col("b"))).collect()] == ["match", "partial_overlap", "mismatch", "unknown_left", "unknown_right", "unknown_both"]


def test_statistics_known_values(spark):
    t = spark.createDataFrame([(2, 1, 1, 6), (400, 100, 300, 5000)], "a long, b long, c long, d long")
    got = [r.p_value for r in enrichment.hypergeometric_tail(t).collect()]
    assert got[0] == pytest.approx(0.183333, abs=1e-6)
    from math import comb

    want = sum(comb(700, x) * comb(5100, 500 - x) for x in range(400, 501)) / comb(5800, 500)
    assert got[1] == pytest.approx(want, rel=1e-8)
    p = spark.createDataFrame([("f", 0.01), ("f", 0.04), ("f", 0.03)], "family string, p_value double")
    q = enrichment.benjamini_hochberg(p, "family").orderBy("p_value")
    assert [round(r.q_value, 9) for r in q.collect()] == [0.03, 0.04, 0.04]


# --- sources, streams, audits --------------------------------------------------------------------


def test_fasta_gtf_counts(spark, tmp_path):
    (tmp_path / "t.fa").write_text(">tx1.2 gene=G1 region_0=5UTR region_9=CDS\nACGU\nacgt\n>transcript_id=tx2 x\nAAAA\n")
    got = {r.transcript_id: (r.gene_id, r.sequence, r.regions) for r in files.read_fasta(spark, str(tmp_path / "t.fa")).collect()}
    assert got == {"tx1.2": ("G1", "ACGTACGT", {"0": "5UTR", "9": "CDS"}), "tx2": ("tx2", "AAAA", {})}
    (tmp_path / "a.gtf").write_text('# c\n\nchr1\ts\ttranscript\t1\t9\t.\t+\t.\tgene_id "G"; transcript_id "T";\n')
    assert rows(files.read_gtf(spark, str(tmp_path / "a.gtf")).select("start", "gene_id", "transcript_id")) == [(1, "G", "T")]
    (tmp_path / "c.tsv").write_text("gene\tc1\tt1\nA\t3\t\n")
    assert sorted(rows(files.read_counts(spark, str(tmp_path / "c.tsv")))) == [("A", "c1", 3.0), ("A", "t1", None)]
    with pytest.raises(ValueError):
        files.read_table(spark, str(tmp_path / "c.tsv"), ["nope"])


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", [1, 2], {"k": "v"})], "x string, l array<int>, m map<string,string>")
    files.write_tsv(df, str(tmp_path / "o.tsv"))
    assert rows(files.read_table(spark, str(tmp_path / "o.tsv"))) == [("a", "1;2", '{"k":"v"}')]


def test_providers(spark):
    raw = spark.createDataFrame([("1", "tp53", "mdm2", "1", "true", ["PM1", "PM2"])], "id string, source string, target string, sign string, is_directed string, references array<string>")
    got = providers.omnipath(raw).first()
    assert (got.source, got.target, got.sign, got.directed, got.refs) == ("TP53", "MDM2", "positive", True, ["PM1", "PM2"])
    raw = spark.createDataFrame([('{"pathways": [{"stId": "R-1", "name": "n", "expected_count": 1.5, "foundEntities": 2, "entities": {"found": ["A"], "pValue": 0.1, "fdr": 0.2}}]}',)], "value string")
    assert rows(providers.reactome_analysis(raw).select("term_id", "observed", "p_value", "genes")) == [("R-1", 2.0, 0.1, ["A"])]


def test_stage_runs_on_a_stream(spark, tmp_path):
    schema = "gene string, lfc double, lfc_shrunken double, padj double, tested string, filter_raw string, low_count_raw string, model_raw string"
    spark.createDataFrame([("g", -1.0, None, 0.01, None, "pass", "pass", "ok")], schema).write.parquet(str(tmp_path / "in"))
    q = stages.start(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("numerical_direction", "statistical_support")) == [("decreased", "significant")]


def test_differences_and_hash(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (4, "w")], "k int, v string")
    assert {(r.key, r.detail) for r in audit.differences(a, b, ["k"], "c").collect()} == {("2", "v"), ("3", "surplus"), ("4", "missing")}
    assert audit.content_hash(a).first() == audit.content_hash(a.repartition(3)).first()
    assert audit.changed_rows(a, b).count() == 4
    assert {r.check for r in audit.snapshot_issues(a.union(a), "k").collect()} == {"duplicate"}


def test_empty_tables(spark, gold):
    seqs, guides = gold
    assert targetability.scan(seqs.limit(0), guides).count() == 0
    assert targetability.scan(seqs, guides.limit(0)).count() == 0
    assert TargetabilityPolicy().max_seed == 0


def test_audit_finds_a_wrong_scan(spark, gold, monkeypatch):
    """The audit shares nothing with the scan: a fault planted in the scan itself shows."""
    from strandlake.operators import audit

    sequences, guides = gold
    scan = targetability.scan
    best = targetability.best_sites(scan(*gold))
    assert audit.targetability_audit(scan(*gold), best, sequences, guides).count() == 0
    monkeypatch.setattr(targetability, "scan", lambda *a, **k: scan(*a, **k).withColumn("n_total_mm", F.col("n_total_mm") + F.when(F.col("start") % 2 == 0, 1).otherwise(0)))
    wrong = targetability.scan(*gold)
    found = audit.targetability_audit(wrong, best, sequences, guides)
    assert {r.detail for r in found.collect()} == {"n_total_mm"} and found.count() == wrong.where("start % 2 = 0").count()
