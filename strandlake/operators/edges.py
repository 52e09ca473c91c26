"""Provider edges: lineage, quality, consensus, contexts.

edges: (evidence_id, provider, source, target, sign, relation, ref, record_id, directed, functional_only, predicted_only).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.sources.stored import stored

CLUSTER = ["source", "target", "directed", "relation_class"]
CONTEXTS = ("organism", "cell_type", "tissue", "compartment", "experimental_system", "disease_state")


def typed(edges: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """Adds resolved ends (canonical ids; null where unknown) and mapping confidences; without a table both ends stand for themselves."""
    if resolved is None:
        return edges.withColumns({"source_id": F.col("source"), "target_id": F.col("target"), "source_confidence": F.lit(1.0), "target_confidence": F.lit(1.0)})
    r = resolved.select("id", "canonical_gene_id", "mapping_confidence")
    out = edges
    for side in ("source", "target"):
        out = out.join(r.select(F.col("id").alias(side), F.col("canonical_gene_id").alias(f"{side}_id"), F.col("mapping_confidence").alias(f"{side}_confidence")), side, "left")
    return out.withColumns({f"{s}_confidence": F.coalesce(f"{s}_confidence", F.lit(0.0)) for s in ("source", "target")})


def relation_class(edges: DataFrame) -> Column:
    """The broad class of a relation: evidence of one class between the same ends can be the same evidence."""
    contextual = F.col("contextual_only") if "contextual_only" in edges.columns else F.lit(False)
    return F.when(F.col("functional_only"), "functional").when(contextual, "contextual").when(F.col("relation").isin("regulates", "regulation", "interaction"), "regulatory").otherwise(F.col("relation"))


def lineage_groups(edges: DataFrame) -> DataFrame:
    """Evidence of one origin (record, reference, sign, relation) between the same ends: members, databases, one row each.

    Evidence without a record and a reference is an origin of its own. Edges are dealt out by their ends once:
    lineage_classes and consensus, which group by these and more, shuffle nothing.
    """
    own = F.when(F.col("record_id").isNull() & F.col("ref").isNull(), F.col("evidence_id"))
    edges = edges.withColumn("relation_class", relation_class(edges)).withColumn("alone", own)
    return edges.repartition("source", "target").groupBy(*CLUSTER, "relation", "sign", "record_id", "ref", "alone").agg(F.count_distinct("evidence_id").alias("members"), F.array_sort(F.collect_set("provider")).alias("providers"), F.min("evidence_id").alias("lineage_id"), F.bool_or("functional_only").alias("functional_only"), F.bool_or("predicted_only").alias("predicted_only"))


def lineage_classes(groups: DataFrame) -> DataFrame:
    """Adds lineage_class. A group's peers are seen through its cluster's counts, so no pairs are made and no tables joined.

    exact_duplicate: several records of one origin; independent_opposing_edge: a peer of the same relation and
    the other sign; publication_duplicate: a peer with the same reference; likely_duplicate: without a record,
    and a peer of the same relation from the same databases; else independent_same_edge.
    """
    peers = [*CLUSTER, "relation"]
    count = lambda test, *by: F.count(F.when(test, 1)).over(Window.partitionBy(*by))
    out = groups.withColumn("same_ref", count(F.col("ref").isNotNull(), *peers, "ref"))
    out = out.withColumns({"n_pos": count(F.col("sign") == "positive", *peers), "n_neg": count(F.col("sign") == "negative", *peers)})
    out = out.withColumn("same_dbs", count(F.lit(True), *peers, "providers"))
    opposing = ((F.col("sign") == "positive") & (F.col("n_neg") > 0)) | ((F.col("sign") == "negative") & (F.col("n_pos") > 0))
    name = F.when(F.col("source").isNull() | F.col("target").isNull(), "unresolved").when(F.col("members") > 1, "exact_duplicate").when(opposing, "independent_opposing_edge").when(F.col("same_ref") > 1, "publication_duplicate")
    name = name.when(F.col("record_id").isNull() & (F.col("same_dbs") > 1), "likely_duplicate").otherwise("independent_same_edge")
    return out.withColumn("lineage_class", name).drop("n_pos", "n_neg", "same_ref", "same_dbs")


def level(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.6, "moderate").when(score >= 0.4, "low").when(score >= 0.25, "contextual").otherwise("insufficient")


def quality(groups: DataFrame, confidence: Column | None = None) -> DataFrame:
    """Adds quality, its level and the caps that held it down. confidence: mapping confidence of the weaker end (1 if not given)."""
    c = F.lit(1.0) if confidence is None else confidence
    signed = F.col("sign").isin("positive", "negative")
    dbs, pubs = F.size("providers"), F.when(F.col("ref").isNotNull(), 1).otherwise(0)
    one = lambda test, w: F.when(test, w).otherwise(0.0)
    score = one(F.col("directed"), 0.12) + one(signed, 0.14) + one(F.col("relation").isNotNull(), 0.11) + one(~F.col("functional_only"), 0.12) + one(~F.col("predicted_only"), 0.12) + 0.14 * F.least(pubs, F.lit(3)) / 3 + 0.10 * F.least(dbs, F.lit(2)) / 2 + 0.15 * c
    caps = {"functional_only": (F.col("functional_only"), 0.55), "no_direction_or_sign": (~F.col("directed") | ~signed, 0.45), "predicted_only": (F.col("predicted_only"), 0.70), "weak_mapping": (c < 0.5, 0.35), "unknown_entity": (F.col("source").isNull() | F.col("target").isNull(), 0.20)}
    cap = F.least(F.lit(1.0), *[F.when(t, v).otherwise(1.0) for t, v in caps.values()])
    reasons = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, (t, _) in caps.items()]))
    out = groups.withColumn("raw_quality", score).withColumn("quality", F.least(score, cap)).withColumn("caps", reasons)
    return out.withColumn("quality_level", level(F.col("quality")))


def consensus(groups: DataFrame) -> DataFrame:
    """One row per (source, target, relation): lineages by kind, sign and conflict, weakest quality, layers."""
    kind = F.when(F.col("functional_only"), F.lit("functional")).otherwise(F.col("relation_class"))
    independent = F.col("lineage_class").isin("independent_same_edge", "independent_opposing_edge", "exact_duplicate")
    out = groups.withColumn("kind", kind).groupBy("source", "target", "kind").agg(
        F.count_if(independent).alias("independent"), F.count_if(~independent).alias("duplicates"), F.count_if(F.col("sign") == "positive").alias("n_positive"), F.count_if(F.col("sign") == "negative").alias("n_negative"),
        F.min("quality").alias("min_quality"), F.bool_or("directed").alias("directed"), F.bool_and("functional_only").alias("functional_only"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("providers")))).alias("providers"), F.min("lineage_id").alias("edge_id"),
    )
    conflict = (F.col("n_positive") > 0) & (F.col("n_negative") > 0)
    sign = F.when(conflict, "conflicting").when(F.col("n_positive") > 0, "positive").when(F.col("n_negative") > 0, "negative").otherwise("unsigned")
    out = out.withColumn("sign", sign)
    layers = F.array_compact(F.array(F.lit("provider_evidence"), F.when(F.col("sign").isin("positive", "negative") & ~F.col("functional_only"), F.lit("signed_causal")), F.when((F.col("sign") == "unsigned") | F.col("functional_only"), F.lit("unsigned_functional")), F.when(F.col("kind") == "contextual", F.lit("contextual")), F.when(F.col("sign") == "conflicting", F.lit("conflicting"))))
    return out.withColumn("layers", layers)


def layer_counts(consensus_edges: DataFrame) -> DataFrame:
    """Per layer: edges and nodes, in one pass: an edge counts at its source."""
    ends = F.array(F.struct(F.col("source").alias("node"), F.lit(1).alias("one")), F.struct(F.col("target").alias("node"), F.lit(0).alias("one")))
    long = consensus_edges.select(F.explode("layers").alias("layer"), ends.alias("ends")).select("layer", F.inline("ends"))
    return long.groupBy("layer", "node").agg(F.sum("one").alias("edges")).groupBy("layer").agg(F.sum("edges").alias("edges"), F.count("node").alias("nodes"))


def provider_coverage(edges: DataFrame, consensus_edges: DataFrame) -> DataFrame:
    """Per provider: edges, signed, unsigned, references, and consensus edges that it takes part in."""
    signed = F.col("sign").isin("positive", "negative")
    a = edges.groupBy("provider").agg(F.count("*").alias("edges"), F.count_if(signed).alias("signed"), F.count_if(~signed).alias("unsigned"), F.count_distinct("ref").alias("references"))
    b = consensus_edges.select(F.explode("providers").alias("provider")).groupBy("provider").agg(F.count("*").alias("consensus_edges"))
    return a.join(b, "provider", "full_outer").na.fill(0)


def lineage_key(edges: DataFrame) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.upper("source"), F.upper("target"), F.lower("relation"), F.lower("sign"), F.coalesce("record_id", F.lit("")), F.coalesce("ref", F.lit(""))), 256), 1, 24)


def deduplicated(edges: DataFrame) -> DataFrame:
    """One row per lineage key, with routes and references merged."""
    return edges.withColumn("lineage_key", lineage_key(edges)).groupBy("lineage_key").agg(F.min("evidence_id").alias("evidence_id"), F.array_sort(F.collect_set("provider")).alias("routes"), F.array_sort(F.collect_set("ref")).alias("refs"))


def pair_consensus(edges: DataFrame) -> DataFrame:
    """Per (source, target): the strongest statement on the sign, and how many support it."""
    n = lambda s: F.count_if(F.col("sign") == s)
    out = edges.groupBy("source", "target").agg(n("positive").alias("n_positive"), n("negative").alias("n_negative"), n("conflicting").alias("n_conflicting"), n("unsigned").alias("n_unsigned"), F.bool_or(F.col("directed") & ~F.col("functional_only")).alias("causal"))
    both = (F.col("n_positive") > 0) & (F.col("n_negative") > 0)
    sign = F.when((F.col("n_conflicting") > 0) | both, "conflicting").when(F.col("n_positive") > 0, "positive").when(F.col("n_negative") > 0, "negative").when(F.col("n_unsigned") > 0, "unsigned").otherwise("unknown")
    return out.withColumn("sign", sign).withColumn("causal", F.col("causal") & F.col("sign").isin("positive", "negative"))


# Words for signs: fixed values.
POSITIVE = ("+", "+1", "1", "positive", "activation", "activates", "stimulation", "stimulates", "up-regulates", "upregulates")
NEGATIVE = ("-", "-1", "negative", "inhibition", "inhibits", "repression", "represses", "down-regulates", "downregulates")


def normalized_sign(value: Column, inhibition: Column | None = None) -> Column:
    """positive, negative, conflicting, unsigned. inhibition: a second flag, as some providers give both."""
    v = F.lower(F.trim(value.cast("string")))
    yes = v.isin(*POSITIVE, "true")
    if inhibition is None:
        return F.when(v == "conflicting", "conflicting").when(yes, "positive").when(v.isin(*NEGATIVE), "negative").otherwise("unsigned")
    no = F.lower(F.trim(inhibition.cast("string"))).isin("true", "1")
    return F.when(yes & no, "conflicting").when(no | v.isin(*NEGATIVE), "negative").when(yes, "positive").otherwise("unsigned")


def sign_number(sign: Column) -> Column:
    return F.when(sign == "positive", 1).when(sign == "negative", -1)


def context_comparison(evidence: Column, experiment: Column) -> Column:
    """match, partial_overlap, mismatch or unknown_*, of comma-separated sets."""
    parts = lambda c: F.array_remove(F.array_distinct(F.transform(F.split(F.lower(c), ","), lambda x: F.trim(x))), "")
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    a, b = parts(evidence), parts(experiment)
    return F.when(blank(evidence) & blank(experiment), "unknown_both").when(blank(evidence), "unknown_left").when(blank(experiment), "unknown_right").when(F.array_sort(a) == F.array_sort(b), "match").when(F.arrays_overlap(a, b), "partial_overlap").otherwise("mismatch")


def context_rows(evidence: DataFrame, dimensions=CONTEXTS) -> DataFrame:
    """(evidence_id, dimension, value): one row per dimension, null where it is missing."""
    return evidence.select("evidence_id", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.nullif(F.trim(F.col(d)), F.lit("")).alias("value")) for d in dimensions])).alias("x")).select("evidence_id", "x.*")


def context_label(columns: list[str]) -> Column:
    return F.concat_ws("|", *[F.nullif(F.trim(F.col(c)), F.lit("")) for c in columns])


# --- static quality and reports ------------------------------------------------------------------

#: Weights of a component in the static quality of one evidence, and caps by what it lacks: fixed values.
STATIC_WEIGHTS = {"directed": 0.15, "signed": 0.15, "mechanism": 0.15, "direct": 0.15, "curated": 0.15, "publication": 0.1, "database": 0.1, "mapping": 0.05}
STATIC_CAPS = {"unsigned_functional": 0.55, "no_direction_or_sign": 0.45, "predicted_only": 0.7, "unknown_entity": 0.2}


def static_quality(evidence: DataFrame) -> DataFrame:
    """Quality of single evidence rows, without their lineage: raw_score, capped_score, cap_reasons, final_level, uncertainty.

    evidence: directed, sign, mechanism, directness, curated, n_refs, provider, snapshot, functional_only,
    predicted_only, source, target (null where unknown).
    """
    c, w = F.col, STATIC_WEIGHTS
    signed = c("sign").isin("positive", "negative")
    one = lambda test, x: F.when(test, x).otherwise(0.0)
    parts = [one(c("directed"), w["directed"]), one(signed, w["signed"]), one(c("mechanism").isNotNull(), w["mechanism"]), one(c("directness") == "direct", w["direct"]), one(c("curated"), w["curated"])]
    parts += [F.least(c("n_refs"), F.lit(3)) / 3 * w["publication"], one(c("provider").isNotNull(), w["database"]), one(c("snapshot").isNotNull(), 0.5 * w["mapping"])]
    raw = sum(parts[1:], parts[0])
    tests = {"unsigned_functional": c("functional_only") & (c("sign") == "unsigned"), "no_direction_or_sign": ~c("directed") | ~signed, "predicted_only": c("predicted_only"), "unknown_entity": c("source").isNull() | c("target").isNull()}
    capped = F.least(raw, *[F.when(t, STATIC_CAPS[k]).otherwise(1.0) for k, t in tests.items()])
    out = evidence.withColumn("raw_score", F.round(raw, 6)).withColumn("capped_score", F.round(capped, 6))
    out = out.withColumn("cap_reasons", F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()])))
    return out.withColumn("final_level", F.when(c("sign") == "conflicting", "conflicting").otherwise(level(capped))).withColumn("uncertainty", F.round(1.0 - capped, 6))


def static_level(evidence: DataFrame) -> DataFrame:
    """The older point score of single evidence rows and its level; evidence: directed, sign, n_refs, n_sources, predicted_only, functional_only."""
    c = F.col
    one = lambda test, x: F.when(test, x).otherwise(0.0)
    score = one(c("directed"), 2.0) + one(c("sign").isin("positive", "negative"), 2.0) + F.least(c("n_refs"), F.lit(3)) + F.least(c("n_sources"), F.lit(3)) - one(c("predicted_only"), 2.0) - one(c("functional_only"), 2.0)
    name = F.when(c("sign") == "conflicting", "conflicting").when(c("functional_only"), "contextual").when(score >= 6, "high").when(score >= 4, "moderate").when(score > 0, "low").otherwise("insufficient")
    return evidence.withColumn("component_score", F.greatest(score, F.lit(0.0))).withColumn("evidence_level", name)


def consensus_report(consensus_edges: DataFrame) -> DataFrame:
    """One display row per consensus edge: level from its weakest quality, names without prefixes, lineages and raw counts by sign."""
    c = F.col
    short = lambda x: F.regexp_replace(x, "^[^:]*:", "")
    total = c("independent") + c("duplicates")
    raw = {f"{s}_raw_evidence": F.when(c("sign") == s, total).otherwise(0) for s in ("positive", "negative", "unsigned")}
    return consensus_edges.select(
        "edge_id", short(c("source")).alias("source"), short(c("target")).alias("target"), "kind", "sign", level(c("min_quality")).alias("evidence_level"), F.array_contains("layers", "unsigned_functional").alias("functional_only"),
        F.array_contains("layers", "signed_causal").alias("causal_eligible"), c("n_positive").alias("positive_lineages"), c("n_negative").alias("negative_lineages"), c("duplicates").alias("duplicate_lineages"), *[v.alias(k) for k, v in raw.items()],
    )


def path_contexts(paths: DataFrame, evidence: DataFrame, dimensions=CONTEXTS) -> DataFrame:
    """Per (source, target, nodes) and dimension: shared_known, conflicting or unknown, and the values.

    evidence: (edge_id, and a column for each dimension). A path's values are those of all its edges.
    """
    key = ["source", "target", "nodes"]
    known = evidence.select("edge_id", *[F.nullif(F.trim(F.col(d)), F.lit("")).alias(d) for d in dimensions])
    rows = paths.select(*key, F.explode("edge_ids").alias("edge_id")).join(known, "edge_id")
    # all dimensions of a path in one row until its values are known
    one = rows.groupBy(*key).agg(*[F.array_sort(F.collect_set(d)).alias(d) for d in dimensions])
    out = one.select(*key, F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("values")) for d in dimensions])).alias("x")).select(*key, "x.*")
    n = F.size("values")
    return out.withColumn("state", F.when(n == 1, "shared_known").when(n > 1, "conflicting").otherwise("unknown"))


def graph_metrics(edges: DataFrame, groups: DataFrame, consensus_edges: DataFrame) -> DataFrame:
    """(metric, value): counts of evidence, lineages and consensus edges, and of nodes and edges by layer."""
    c = F.col
    long = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("long").alias("value")) for k in df.columns])).alias("x")).select("x.*")
    known = c("source").isNotNull() & c("target").isNotNull()
    a = edges.agg(F.count("*").alias("provider_evidence"), F.count_if(known).alias("resolved_evidence"), F.count_if(~known).alias("unresolved_evidence"))
    kinds = {"duplicate_lineages": ("exact_duplicate", "publication_duplicate", "likely_duplicate"), "independent_lineages": ("independent_same_edge", "independent_opposing_edge"), "unresolved_lineages": ("unresolved",)}
    b = groups.agg(F.count("*").alias("lineage_groups"), *[F.count_if(c("lineage_class").isin(*v)).alias(k) for k, v in kinds.items()])
    d = consensus_edges.agg(F.count("*").alias("consensus_edges"), *[F.count_if(F.array_contains("layers", x)).alias(f"{x}_consensus_edges") for x in ("signed_causal", "unsigned_functional", "contextual", "conflicting")])
    layers = stored(layer_counts(consensus_edges))
    e = layers.select(F.concat("layer", F.lit("_graph_edges")).alias("metric"), c("edges").alias("value")).unionByName(layers.select(F.concat("layer", F.lit("_graph_nodes")).alias("metric"), c("nodes").alias("value")))
    return long(a).unionByName(long(b)).unionByName(long(d)).unionByName(e)
