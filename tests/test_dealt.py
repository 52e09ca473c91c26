"""Sites are dealt out by gene once: what groups them afterwards shuffles no rows of guides times transcripts."""

import re

import pytest

from strandlake.operators import sites, targetability
from strandlake.plans import queries as Q

DIR = "/root/testdata/sf0.001"


def shuffled_by(df):
    return re.findall(r"Exchange hashpartitioning\(([^\n]*?), \d+\)", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("name", ["best_sites", "qualifying_sites", "gene_site_rollup", "best_full_sites"])
def test_no_shuffle_by_guide(spark, name):
    assert [k for k in shuffled_by(Q.QUERIES[name](spark, DIR)) if "sirna_id" in k] == []


@pytest.mark.parametrize("name", ["m_contributions", "m_over_n", "ratio_interpretation", "ratio_summary", "targetability_summary"])
def test_nothing_of_guides_times_transcripts_is_stored_or_shuffled(spark, name, monkeypatch):
    def never(df):
        raise AssertionError("stored")

    monkeypatch.setattr(Q, "stored", never)
    # the sites on intended genes alone are met by guide
    assert len([k for k in shuffled_by(Q.QUERIES[name](spark, DIR)) if "sirna_id" in k and "transcript_id" in k]) <= 1


def test_stage_summary_stores_no_sites(spark, monkeypatch):
    from strandlake.plans import queries_decisions as D

    kept = []
    monkeypatch.setattr(D, "stored", lambda df: kept.append(df.columns) or df)
    Q.QUERIES["targetability_stage_summary"](spark, DIR)
    assert kept and all("sirna_id" not in columns for columns in kept)


def test_strands_in_parts(spark, monkeypatch):
    seqs = spark.createDataFrame([(1, 1, "ACGTTGCATTGCAAGGCTTACGATCGATTGCAACCGGTTACGATGCAN"), (2, 1, "TTACGATCGATTGCAACCGGTTACGATGCAACGT")], "transcript_id long, gene_id long, sequence string")
    strand = spark.createDataFrame([(k, "guide", g) for k, g in enumerate(("AACCGGTTGCAATCGATCGTA", "TTGCATCGTAACCGGTTGCAA"))], "sirna_id long, strand string, guide string")

    def found():
        full = sorted((r.sirna_id, r.transcript_id, r.start) for r in sites.full_sites(seqs, strand).collect())
        seed = sorted((r.sirna_id, r.transcript_id, r.start, r.k) for r in sites.seed_sites(seqs, strand).collect())
        return full, seed

    whole = found()
    monkeypatch.setattr(sites, "AT_ONCE", 2)
    assert found() == whole and whole[0] and whole[1]
    assert "SortMerge" not in sites.seed_sites(seqs, strand)._jdf.queryExecution().executedPlan().toString()
    search = [r.guide.translate(str.maketrans("ACGT", "TGCA"))[::-1] for r in sorted(strand.collect())]
    text = {r.transcript_id: r.sequence for r in seqs.collect()}
    want = sorted((q, t, i, k) for k in (6, 7, 8) for q, s in enumerate(search) for t, x in text.items() for i in range(len(x) - k + 1) if x[i : i + k] == s[20 - k : 20])
    assert whole[1] == want


def test_own_sites_are_those_on_the_intended_gene(spark):
    seq = "ACGTTGCATTGCAAGGCTTACGATCGATTGCAACCGGTTACGATGCA"
    seqs = spark.createDataFrame([(1, 1, seq), (2, 2, seq), (3, None, seq)], "transcript_id long, gene_id long, sequence string")
    guide = seq[10:31].translate(str.maketrans("ACGT", "TGCA"))[::-1]
    guides = spark.createDataFrame([(7, guide, guide, 1), (7, guide, guide, 2), (8, guide, guide, None)], "sirna_id long, guide string, passenger string, intended_gene long")
    got = sorted((r.sirna_id, r.gene_id, r.start) for r in targetability.scan(seqs, guides, own=True).collect())
    every = sorted((r.sirna_id, r.gene_id, r.start) for r in targetability.scan(seqs, guides).collect() if (r.sirna_id, r.gene_id) in ((7, 1), (7, 2)))
    assert got == every and len(got) == 4


def test_profile_equals_rows(spark):
    rows = targetability.scan(*[t for t in Q.spark_tables(spark, DIR, "sequences", "guides")])
    want = sorted((r.position, r.region, r.paired, r["count"]) for r in targetability.alignment_rows(rows).groupBy("position", "region", "paired").count().collect())
    assert sorted(targetability.alignment_profile(rows).collect()) == want and want


def test_edges_are_dealt_out_by_their_ends_once(spark):
    """One shuffle for lines of an order, one for edges: lineage and consensus group within their ends."""
    plan = shuffled_by(Q.QUERIES["edge_consensus"](spark, DIR))
    assert len(plan) == 2, plan


def test_signed_paths_has_a_row_for_each_path(spark):
    got = Q.QUERIES["signed_paths"](spark, DIR)
    assert got.columns == ["source", "target", "nodes", "n_edges", "cumulative_sign", "expected_direction"]
    pairs = got.groupBy("source", "target").count()
    assert pairs.where("count > 1").count() and not pairs.where("count > 25").count()
