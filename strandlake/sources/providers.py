"""Raw provider records to edges and enrichment rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.edges import normalized_sign

from .files import first_of

EDGE = ("evidence_id", "provider", "source", "target", "sign", "relation", "refs", "record_id", "directed", "functional_only", "predicted_only")


def _refs(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), ",", ";"), ";"), lambda x: F.trim(x)), lambda x: x != "")))


def _edge(df: DataFrame, provider: str, source, target, sign, relation, refs, record, directed, functional) -> DataFrame:
    rows = df.select(F.lit(provider).alias("provider"), F.upper(F.trim(source)).alias("source"), F.upper(F.trim(target)).alias("target"), sign.alias("sign"), relation.alias("relation"), _refs(refs).alias("refs"), record.cast("string").alias("record_id"), directed.alias("directed"), functional.alias("functional_only"), F.lit(False).alias("predicted_only"))
    rows = rows.where("source is not null and target is not null")
    return rows.withColumn("evidence_id", F.concat_ws(":", "provider", F.coalesce("record_id", F.concat_ws(">", "source", "target")))).select(*EDGE)


def omnipath(df: DataFrame) -> DataFrame:
    """A sign, or two flags for stimulation and inhibition."""
    given = first_of(_text(df), "sign")
    flags = normalized_sign(first_of(_text(df), "is_stimulation", "stimulation"), first_of(_text(df), "is_inhibition", "inhibition"))
    sign = F.when(given.isNotNull(), normalized_sign(given)).otherwise(flags)
    directed = F.coalesce(F.lower(first_of(_text(df), "is_directed", "directed")).isin("true", "1"), F.lit(False))
    d = _text(df)
    return _edge(d, "omnipath", first_of(d, "source_genesymbol", "source"), first_of(d, "target_genesymbol", "target"), sign, F.coalesce(first_of(d, "relation_type", "type"), F.lit("interaction")), first_of(d, "references", "refs"), first_of(d, "id"), directed, ~directed)


def signor(df: DataFrame) -> DataFrame:
    d = _text(df)
    return _edge(d, "signor", first_of(d, "ENTITYA", "source"), first_of(d, "ENTITYB", "target"), normalized_sign(first_of(d, "effect", "EFFECT")), F.coalesce(first_of(d, "mechanism", "MECHANISM"), F.lit("interaction")), first_of(d, "PMID", "references"), first_of(d, "SIGNOR_ID", "id"), F.lit(True), F.lit(False))


def reactome_fi(df: DataFrame) -> DataFrame:
    """Functional interactions: no sign, no direction."""
    d = _text(df)
    return _edge(d, "reactome_fi", first_of(d, "source", "Gene1"), first_of(d, "target", "Gene2"), F.lit("unsigned"), F.lit("functional"), first_of(d, "references"), first_of(d, "id"), F.lit(False), F.lit(True))


def reactome_content(df: DataFrame) -> DataFrame:
    """Only explicit regulators are directed and signed."""
    d = _text(df)
    kind = F.lower(first_of(d, "relation_type"))
    positive, negative = kind.isin("positive_regulation", "positiveregulation", "activation"), kind.isin("negative_regulation", "negativeregulation", "inhibition")
    explicit = F.coalesce(positive | negative, F.lit(False))
    sign = F.when(positive, "positive").when(negative, "negative").otherwise("unsigned")
    return _edge(d, "reactome_content", first_of(d, "source"), first_of(d, "target"), sign, F.coalesce(kind, F.lit("functional")), first_of(d, "references"), first_of(d, "event_id", "id"), explicit, ~explicit)


def _text(df: DataFrame) -> DataFrame:
    """Scalars as strings, lists joined with ;."""
    return df.select(*[(F.concat_ws(";", c) if t.startswith("array<string") else F.col(c).cast("string")).alias(c) for c, t in df.dtypes if not t.startswith(("struct", "map", "array<struct"))])


_RESULT = "struct<term: struct<id: string, label: string>, number_in_list: double, expected: double, fold_enrichment: double, pValue: double, fdr: double, mapped_ids: string>"


def panther(raw: DataFrame) -> DataFrame:
    """Enrichment rows of JSON documents (value): {results: {result: [...]}} or a list."""
    item = F.coalesce(F.from_json("value", f"struct<results: struct<result: array<{_RESULT}>>>")["results"]["result"], F.from_json("value", f"array<{_RESULT}>"))
    rows = raw.select(F.explode(item).alias("r"))
    return rows.select(F.lit("panther").alias("provider"), F.col("r.term.id").alias("term_id"), F.coalesce("r.term.label", "r.term.id").alias("term_name"), F.col("r.number_in_list").alias("observed"), F.col("r.expected").alias("expected"), F.col("r.fold_enrichment").alias("fold"), F.col("r.pValue").alias("p_value"), F.col("r.fdr").alias("q_value"))


_PATHWAY = "struct<stId: string, name: string, expected_count: double, foundEntities: double, entities: struct<found: array<string>, pValue: double, fdr: double>>"


def reactome_analysis(raw: DataFrame) -> DataFrame:
    """Enrichment rows of JSON documents (value): {pathways: [...]} or {results: [...]}."""
    doc = F.from_json("value", f"struct<pathways: array<{_PATHWAY}>, results: array<{_PATHWAY}>>")
    rows = raw.select(F.explode(F.coalesce(doc["pathways"], doc["results"])).alias("r"))
    return rows.select(F.lit("reactome").alias("provider"), F.col("r.stId").alias("term_id"), F.col("r.name").alias("term_name"), F.coalesce("r.foundEntities", F.size("r.entities.found").cast("double")).alias("observed"), F.col("r.expected_count").alias("expected"), F.col("r.entities.pValue").alias("p_value"), F.col("r.entities.fdr").alias("q_value"), F.col("r.entities.found").alias("genes"))


def selected(edges: DataFrame, providers: DataFrame, mode: str) -> DataFrame:
    """Edges by mode: disabled none, local all, public_cache those of `providers` (provider)."""
    if mode == "disabled":
        return edges.limit(0)
    return edges.join(providers.select("provider").distinct(), "provider", "left_semi") if mode == "public_cache" else edges


def provider_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")
