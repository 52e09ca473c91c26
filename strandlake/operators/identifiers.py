"""Identifier detection, normalization and resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.rna import stable_id

# Shapes of identifiers: fixed values.
ENSEMBL_GENE = r"^ENSG\d+(\.\d+)?$"
ENSEMBL_TRANSCRIPT = r"^ENST\d+(\.\d+)?$"
REACTOME = r"^R-[A-Z]{3}-\d+"
SIGNOR = r"^SIGNOR-[A-Z]*\d+$"
UNIPROT = r"^([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2})$"


def identifier_type(c: Column, variant: str = "api") -> Column:
    """Type by shape. api looks at upper case and knows entity sets; snapshot is exact and knows provider ids (with a colon)."""
    v = F.trim(c)
    u = F.upper(v) if variant == "api" else v
    out = F.when(v.isNull() | (v == ""), "invalid").when(v.rlike(ENSEMBL_GENE), "ensembl_gene_id").when(v.rlike(ENSEMBL_TRANSCRIPT), "ensembl_transcript_id").when(u.rlike(REACTOME), "reactome_stable_id").when(u.rlike(SIGNOR), "signor_entity_id").when(v.rlike(r"^\d+$"), "entrez_gene_id").when(u.rlike(UNIPROT), "uniprot_accession")
    out = out.when(u.rlike("^(COMPLEX|FAMILY|SET):"), "pathway_entity_set") if variant == "api" else out.when(v.contains(":"), "provider_specific_id")
    return out.otherwise("hgnc_symbol")


def normalized_identifier(c: Column) -> Column:
    """Upper case for symbols and accessions, no version for Ensembl ids."""
    v, kind = F.trim(c), identifier_type(c)
    return F.when(kind.isin("hgnc_symbol", "uniprot_accession", "reactome_stable_id", "signor_entity_id"), F.upper(v)).when(kind.isin("ensembl_gene_id", "ensembl_transcript_id"), F.substring_index(v, ".", 1)).otherwise(v)


def _names(records: DataFrame, many: str, one: str) -> Column:
    """A record's list of names, from a column of lists or of single names; never null."""
    if many in records.columns:
        return F.coalesce(F.col(many), F.array().cast("array<string>"))
    return F.array_compact(F.array(one)) if one in records.columns else F.array().cast("array<string>")


def index(records: DataFrame) -> DataFrame:
    """records and lookup: each record under its identifier, symbol, aliases and previous symbols, upper-cased.

    Names come as lists (aliases, previous_symbols) or one by one (alias, previous_symbol).
    """
    names = F.concat(F.array_compact(F.array("input_identifier", "canonical_symbol")), _names(records, "aliases", "alias"), _names(records, "previous_symbols", "previous_symbol"))
    keys = F.filter(F.array_distinct(F.transform(names, lambda x: F.upper(F.trim(x)))), lambda x: x != "")
    return records.withColumn("former", F.transform(_names(records, "previous_symbols", "previous_symbol"), lambda x: F.upper(F.trim(x)))).withColumn("lookup", F.explode(keys))


def resolve(ids: DataFrame, records: DataFrame, policy: str = "exclude") -> DataFrame:
    """One row per id of `ids` (id): status, gene, symbol, candidates, confidence.

    The matches of a key are aggregated before the join, so a key that many records share stays one row.
    """
    hits = index(records).groupBy("lookup").agg(
        F.min_by(F.struct("canonical_gene_id", "canonical_symbol", "confidence", "former"), "input_order").alias("first"),
        F.array_sort(F.collect_set("canonical_gene_id")).alias("candidates"),
        F.bool_or("ambiguous").alias("any_ambiguous"),
    )
    out = ids.withColumn("lookup", F.upper(F.trim("id"))).join(hits, "lookup", "left")
    ambiguous = (F.size("candidates") > 1) | F.col("any_ambiguous")
    status = F.when(F.col("first").isNull(), "not_in_snapshot").when(ambiguous & F.lit(policy != "expand"), "ambiguous").when(F.col("first.canonical_gene_id").isNull(), "unmapped").when(ambiguous, "expanded").otherwise("unambiguous")
    out = out.withColumn("ambiguity_status", status)
    good = F.col("ambiguity_status").isin("unambiguous", "expanded")
    return out.select(
        "id", "ambiguity_status", F.when(good, F.col("first.canonical_gene_id")).alias("canonical_gene_id"), F.when(good, F.col("first.canonical_symbol")).alias("symbol"),
        F.when(good, F.when(F.col("first.confidence") == "unambiguous", 1.0).otherwise(0.5)).otherwise(0.0).alias("mapping_confidence"),
        F.when(good & F.array_contains("first.former", F.col("lookup")), "deprecated").when(good, "current").alias("deprecated_status"),
        F.when(F.col("ambiguity_status") == "ambiguous", F.col("candidates")).otherwise(F.array().cast("array<string>")).alias("candidates"),
    )


def alias_resolution(ids: DataFrame, aliases: DataFrame) -> DataFrame:
    """ids against (alias, canonical): none keeps itself, one is mapped, more are ambiguous."""
    a = aliases.groupBy(F.upper("alias").alias("lookup")).agg(F.array_sort(F.collect_set("canonical")).alias("c"))
    out = ids.withColumn("lookup", F.upper(F.trim("id"))).join(a, "lookup", "left")
    n = F.when(F.col("c").isNull(), 0).otherwise(F.size("c"))
    return out.select("id", F.when(n == 0, normalized_identifier(F.col("id"))).when(n == 1, F.col("c")[0]).alias("resolved"), F.when(n > 1, "ambiguous").when(n == 1, "mapped").otherwise("self").alias("status"))


def inventory(sequences: DataFrame, resolved: DataFrame) -> DataFrame:
    """Distinct genes and whether they map."""
    return sequences.select(F.col("gene_id").cast("string").alias("id")).distinct().join(resolved, "id", "left").select("id", F.coalesce(F.col("canonical_gene_id").isNotNull(), F.lit(False)).alias("mapped"))


def entity_ids(resolved: DataFrame, organism: str = "human") -> DataFrame:
    return resolved.withColumn("entity_id", F.coalesce(F.concat(F.lit("gene:"), "canonical_gene_id"), stable_id("entity", F.lit(organism), F.upper("id"))))


#: Provider words for entity types: fixed values.
ENTITY_TYPES = {"gene": "gene", "referencegeneproduct": "protein", "protein": "protein", "complex": "complex", "family": "family", "definedset": "family", "candidateset": "family", "simpleentity": "small_molecule", "small_molecule": "small_molecule", "pathway": "pathway"}


def entity_type(c: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in ENTITY_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(c))), F.lit("unknown"))


def registry(entities: DataFrame) -> DataFrame:
    """One row per entity_id: the first row's scalars, the union of its sources and providers."""
    return entities.groupBy("entity_id").agg(F.min_by(F.struct("symbol", "entity_type"), "input_order").alias("f"), F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("provider")).alias("providers")).select("entity_id", "f.symbol", "f.entity_type", "sources", "providers")


def expand_members(entities: DataFrame, memberships: DataFrame, policy: str = "no_expansion") -> DataFrame:
    if policy == "no_expansion":
        return entities.withColumn("member", F.col("entity_id"))
    return entities.join(memberships.select("entity_id", "member"), "entity_id", "left").withColumn("member", F.coalesce("member", "entity_id"))


def display_symbol(symbol: Column, entity_id: Column) -> Column:
    return F.coalesce(symbol, F.substring_index(entity_id, ":", -1))
