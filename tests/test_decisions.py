"""Intended targets and stage summaries on hand-made rows: odd inputs, empty tables, repeated rows."""

import pytest

from strandlake.operators import intended, summaries
from strandlake.plans.policies import IntendedTargetPolicy

REQUEST = "request_id long, sirna_id long, gene_id long, transcript_ids array<long>"
EVIDENCE = "sirna_id long, transcript_id long, gene_id long, sequence_available boolean"
SITE = "sirna_id long, transcript_id long, gene_id long, start int, site_class string, priority int, n_total_mm int, n_seed_mm int, n_central_mm int"
EXACT, SEED = "exact_full_length_complement", "seed_only_candidate"
ANY = "accept_any_gene_transcript_site"


@pytest.fixture(scope="module")
def judged(spark):
    requests = [(1, 7, 10, [100]), (2, 7, 10, None), (3, 7, None, []), (4, 7, 10, [100, 101, 101, 999, None]), (5, 7, 20, [200]), (6, 7, 20, []), (7, 7, 10, [102]), (8, 7, None, [100])]
    evidence = [(7, 100, 10, True), (7, 100, 10, True), (7, 101, 10, False), (7, 102, 10, True), (7, 200, 20, True)]
    sites = [(7, 100, 10, 5, EXACT, 0, 0, 0, 0), (7, 100, 10, 1, SEED, 3, 9, 0, 3), (7, 102, 10, 2, SEED, 3, 1, 0, 0), (7, 200, 20, 3, EXACT, 0, 0, 0, 0)]
    policies = {
        "uncertain": IntendedTargetPolicy(),
        "strict": IntendedTargetPolicy(gene_only="fail_stage"),
        "warned": IntendedTargetPolicy(required=False, gene_only="warning", on_failure="warning"),
        "any": IntendedTargetPolicy(gene_only=ANY, on_failure="preserve_invalid_with_status"),
        "named": IntendedTargetPolicy(transcripts_required=True, gene_only="warning"),
    }
    frames = spark.createDataFrame(requests, REQUEST), spark.createDataFrame(evidence, EVIDENCE), spark.createDataFrame(sites, SITE), spark.createDataFrame([(20,), (20,)], "gene_id long")
    return {(r.request_id, r.policy): r for r in intended.validate(*frames, policies).collect()}


def test_each_request_meets_each_policy_once(judged):
    assert len(judged) == 8 * 5


def test_named_transcripts(judged):
    r = judged[1, "uncertain"]
    assert (r.status, r.n_candidates, r.n_accepted, r.best_transcript, r.best_start, r.errors) == ("passed", 2, 1, 100, 5, [])
    assert r.rejection_reasons == ["evidence_class_not_accepted", "total_mismatch_threshold_exceeded", "central_mismatch_threshold_exceeded"]
    r = judged[4, "uncertain"]  # one without a sequence, named twice, one unknown, one null
    assert r.errors == ["intended_target_sequence_unavailable:101", "intended_target_transcript_missing:999"] and (r.status, r.n_accepted) == ("failed", 1)
    assert judged[7, "any"].errors == ["intended_target_no_acceptable_site"] and judged[7, "any"].status == "invalid_preserved"
    assert judged[5, "warned"].errors == ["intended_target_gene_failed:20"] and judged[5, "warned"].status == "warning"
    assert judged[8, "strict"].status == "passed"


def test_a_gene_alone(judged):
    status = {p: judged[2, p].status for p in ("uncertain", "strict", "warned", "any", "named")}
    assert status == {"uncertain": "uncertain", "strict": "failed", "warned": "warning", "any": "passed", "named": "failed"}
    assert judged[2, "any"].n_candidates == 3 and judged[2, "any"].best_transcript == 100
    assert judged[2, "warned"].behaviour == "warning" and judged[2, "uncertain"].behaviour == "none" and len(judged[2, "uncertain"].warnings) == 1
    assert judged[6, "any"].errors == ["intended_target_gene_failed:20", "intended_target_gene_no_acceptable_site:20"]


def test_nothing_asked(judged):
    assert judged[3, "warned"].status == "not_requested" and judged[3, "warned"].errors == []
    assert judged[3, "named"].errors == ["intended_target_input_missing", "intended_target_transcript_ids_required"]


def test_intended_targets_of_empty_tables(spark):
    empty = [spark.createDataFrame([], s) for s in (REQUEST, EVIDENCE, SITE, "gene_id long")]
    assert intended.validate(*empty, {"any": IntendedTargetPolicy(gene_only=ANY)}).count() == 0
    one = spark.createDataFrame([(1, 7, 10, [100])], REQUEST)
    assert intended.validate(one, *empty[1:], {"p": IntendedTargetPolicy()}).first().errors == ["intended_target_transcript_missing:100"]


ROW = "run_key long, gene_id long, effect_status string, ratio_status string, ratio double, lfc double, expected double, residual double, support_status string, readiness string"


def test_stages_split_and_count(spark):
    rows = [
        (1, 1, "definitive", "definitive", 0.0, 0.2, 0.0, 0.2, "residual_without_pathway_support", "ready_for_final_classification"),
        (1, 2, "definitive", "definitive", 1.0, -1.0, -0.5, -0.5, "unresolved_missing_pathway_evidence", "ready_with_unresolved_pathway_context"),
        (1, 3, "unavailable_ratio", "undefined_zero_denominator", None, 0.1, None, None, "unresolved_upstream_expected_effect", "unresolved_upstream_residual_attribution"),
        (2, 1, "definitive", "definitive", 0.5, 0.1, 0.1, 0.0, "no_residual_to_attribute", "ready_with_unresolved_targetability"),
        (2, 2, "definitive", "definitive", 1.0, -1.0, float("-inf"), None, "residual_without_pathway_support", "insufficient_residual_evidence"),
    ]
    df = spark.createDataFrame(rows, ROW)
    by_run = lambda stage: {r.run_key: r for r in stage.summary.collect()}
    left = lambda stage: sorted(tuple(r) for r in stage.unresolved.collect())
    e = summaries.effect_stage(df, spark.createDataFrame([(1, 0.5, "definitive")], "run_key long, k double, calibration_status string"))
    one, two = by_run(e)[1], by_run(e)[2]
    assert (one.genes_examined, one.unresolved_records, one.genes_with_m_over_n_zero, one.genes_with_m_over_n_one, one.calibration_status, two.calibration_status) == (3, 1, 1, 1, "definitive", None)
    assert left(e) == [(1, 3, "unavailable_ratio", "undefined_zero_denominator")] and e.evidence.count() == 5
    r = summaries.residual_stage(df)
    assert {(x[0], x[1], x[2]) for x in left(r)} == {(1, 2, "unresolved_missing_pathway_evidence"), (1, 3, "unresolved_upstream_expected_effect"), (2, 2, "unresolved_upstream_expected_effect")}
    assert r.evidence.count() == 3 and by_run(r)[1].unresolved_records == 2 and by_run(r)[2].no_residual_to_attribute == 1
    i = summaries.integration_stage(df)
    assert by_run(i)[1].genes_examined == 4 and by_run(i)[1].unresolved_records == 3  # a residual without pathways comes as evidence and as unresolved
    assert by_run(i)[2].ready_with_unresolved_targetability == 1 and by_run(i)[2].insufficient_residual_evidence == 0
    assert (1, 2, "ready_with_unresolved_pathway_context", "unresolved_missing_pathway_evidence") in left(i)


def test_stages_of_empty_tables(spark):
    empty = spark.createDataFrame([], ROW)
    for stage in (summaries.effect_stage(empty, spark.createDataFrame([], "run_key long, k double, calibration_status string")), summaries.residual_stage(empty), summaries.integration_stage(empty)):
        assert not stage.evidence.count() and not stage.unresolved.count() and not stage.summary.count()
