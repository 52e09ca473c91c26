"""Readers and writers of the domain's file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.expression import number
from strandlake.operators.identifiers import identifier_type


def _columns(df: DataFrame, required: list[str]) -> DataFrame:
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"columns are missing: {', '.join(absent)}")
    return df


def read_table(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    """TSV, CSV, JSON lines or Parquet by the name's ending; TSV and CSV columns are strings."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("tsv", "csv"):
        df = spark.read.csv(path, sep="\t" if kind == "tsv" else ",", header=True)
    elif kind in ("json", "jsonl"):
        df = spark.read.json(path)
    else:
        df = spark.read.parquet(path)
    return _columns(df, required or [])


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Wide TSV (gene, one column a sample) as (gene_id, sample, n)."""
    wide = read_table(spark, path)
    gene, *samples = wide.columns
    return wide.unpivot(F.col(gene).alias("gene_id"), samples, "sample", "n").select("gene_id", "sample", number("n").alias("n"))


def read_samples(spark: SparkSession, path: str, sample: str = "sample", condition: str = "condition") -> DataFrame:
    """(sample, condition, replicate): replicates are numbered by sample name within a condition."""
    from pyspark.sql import Window

    df = read_table(spark, path, [sample, condition]).select(F.col(sample).alias("sample"), F.col(condition).alias("condition"))
    return df.withColumn("replicate", F.row_number().over(Window.partitionBy("condition").orderBy("sample")))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(transcript_id, gene_id, sequence, regions) of multi-line FASTA; > may stand only at the start of a header.

    Header: key=value fields; without transcript_id the first token, without gene the id before its first dot;
    region_<start>=<label> fields make the map regions.
    """
    raw = spark.read.text(path, lineSep=">").where("trim(value) <> ''")
    lines = raw.select(F.split("value", r"\r?\n").alias("l"))
    fields = F.split(F.trim(F.col("l")[0]), r"\s+")
    pairs = F.map_from_entries(F.transform(F.filter(F.array_distinct(fields), lambda x: x.contains("=")), lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.regexp_extract(x, "^[^=]*=(.*)$", 1).alias("value"))))
    rows = lines.select(fields[0].alias("first"), pairs.alias("f"), F.translate(F.upper(F.array_join(F.slice("l", 2, 1_000_000_000), "")), "U \t", "T").alias("sequence"))
    tx = F.coalesce(F.try_element_at("f", F.lit("transcript_id")), "first")
    gene = F.coalesce(F.try_element_at("f", F.lit("gene")), F.substring_index(tx, ".", 1))
    regions = F.map_from_entries(F.transform(F.filter(F.map_entries("f"), lambda e: e["key"].startswith("region_")), lambda e: F.struct(F.regexp_replace(e["key"], "^region_", ""), e["value"])))
    return rows.select(tx.alias("transcript_id"), gene.alias("gene_id"), "sequence", regions.alias("regions"))


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """The nine columns of an annotation and its gene_id and transcript_id; comments and blank lines are skipped."""
    rows = spark.read.text(path).where("trim(value) <> '' and not startswith(value, '#')").select(F.split("value", "\t").alias("c"))
    names = ("seqname", "source", "feature", "start", "end", "score", "strand", "frame", "attributes")
    out = rows.select(*[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return out.withColumns({"start": F.col("start").try_cast("long"), "end": F.col("end").try_cast("long"), "gene_id": F.nullif(F.regexp_extract("attributes", 'gene_id "([^"]*)"', 1), F.lit("")), "transcript_id": F.nullif(F.regexp_extract("attributes", 'transcript_id "([^"]*)"', 1), F.lit(""))})


def read_network(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, ["source", "target", "sign"])


def read_regulons(spark: SparkSession, path: str) -> DataFrame:
    df = read_table(spark, path)
    return df.withColumnRenamed("regulator", "regulon") if "regulator" in df.columns else df


def read_precomputed(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A differential-expression table under our names; columns: ours -> the file's. Numbers that don't parse are null."""
    df = read_table(spark, path, list(columns.values()))
    text = {"gene", "tested", "filter_raw", "low_count_raw", "model_raw"}
    return df.select(*[(F.col(c) if ours in text else number(f"`{c}`")).alias(ours) for ours, c in columns.items()])


def read_proportions(spark: SparkSession, path: str) -> DataFrame:
    df = read_table(spark, path, ["canonical_gene_id", "canonical_transcript_id", "proportion"])
    return df.select(F.col("canonical_gene_id").alias("gene_id"), F.col("canonical_transcript_id").alias("transcript_id"), F.col("proportion").try_cast("double").alias("proportion"))


def first_of(df: DataFrame, *names: str):
    """The first of these columns that the table has and that isn't blank."""
    found = [F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def read_identifiers(spark: SparkSession, path: str) -> DataFrame:
    """Identifier resource: lists are split at ;, ambiguous is set by flag or by more than one candidate.

    input_order is the file's own column, or else the order of the lines; a blank type is told by shape.
    """
    df = read_table(spark, path)
    df = df.withColumn("input_order", F.col("input_order").cast("long") if "input_order" in df.columns else F.monotonically_increasing_id())
    parts = lambda *n: F.coalesce(F.filter(F.transform(F.split(first_of(df, *n), ";"), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))
    named = first_of(df, "input_identifier", "identifier", "id")
    out = df.select("input_order", named.alias("input_identifier"), F.coalesce(first_of(df, "identifier_type", "type"), identifier_type(named, "snapshot")).alias("identifier_type"), first_of(df, "canonical_gene_id", "gene_id").alias("canonical_gene_id"), first_of(df, "canonical_symbol", "symbol").alias("canonical_symbol"), parts("aliases", "alias").alias("aliases"), parts("previous_symbols").alias("previous_symbols"), parts("candidate_mappings").alias("candidate_mappings"), first_of(df, "confidence").alias("confidence"), first_of(df, "ambiguous").alias("flag"))
    return out.withColumn("ambiguous", F.coalesce(F.lower("flag").isin("true", "1", "yes"), F.lit(False)) | (F.size("candidate_mappings") > 1)).drop("flag")


def identifier_tables(records: DataFrame) -> dict[str, DataFrame]:
    """The four lists of an identifier snapshot: aliases, cross-references, deprecated names, ambiguities."""
    own = ["input_identifier", "canonical_gene_id"]
    return {
        "aliases": records.select(*own, F.explode("aliases").alias("alias")),
        "cross_references": records.where("canonical_gene_id is not null").select("canonical_gene_id", "identifier_type", F.col("input_identifier").alias("reference")).distinct(),
        "deprecated": records.select(*own, F.explode("previous_symbols").alias("previous_symbol")),
        "ambiguities": records.where("ambiguous").select(*own, "candidate_mappings"),
    }


def read_snapshot(spark: SparkSession, path: str, manifest: str, table: str, required: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, check) of a snapshot folder: a manifest in JSON and a table as JSON lines.

    check: one row with the manifest's record_count and content_hash, those of the rows, and whether they agree.
    A hash covers the rows in any order: see `content_hash`.
    """
    from strandlake.operators.audit import content_hash

    rows = _columns(spark.read.json(f"{path}/{table}"), required or [])
    says = spark.read.json(f"{path}/{manifest}", multiLine=True)
    says = says.select(F.col("record_count").cast("long").alias("record_count"), F.col("content_hash").cast("string").alias("content_hash"))
    found = content_hash(rows).select(F.col("rows").alias("found_count"), F.col("digest").alias("found_hash"))
    check = says.join(found)  # a row on each side
    return rows, check.withColumn("valid", F.col("record_count").eqNullSafe(F.col("found_count")) & F.col("content_hash").eqNullSafe(F.col("found_hash")))


def write_snapshot(df: DataFrame, path: str, manifest: str, table: str) -> None:
    """A folder that `read_snapshot` reads."""
    from strandlake.operators.audit import content_hash

    df.write.json(f"{path}/{table}")
    # hashed as read back: JSON has fewer types
    again = df.sparkSession.read.json(f"{path}/{table}")
    content_hash(again).select(F.col("rows").alias("record_count"), F.col("digest").alias("content_hash")).coalesce(1).write.json(f"{path}/{manifest}")


def read_memberships(spark: SparkSession, path: str, provider: str, required: list[str] | None = None) -> DataFrame:
    """Membership resource: one row per term, member and gene; unknown completeness is partial."""
    df = read_table(spark, path, required)
    genes = F.explode_outer(F.filter(F.transform(F.split(first_of(df, "canonical_gene_ids", "genes"), ";"), lambda x: F.trim(x)), lambda x: x != ""))
    out = df.select(F.lit(provider).alias("dataset"), first_of(df, "term_id", "pathway_id", "go_id").alias("term_id"), first_of(df, "term_name", "name").alias("term_name"), first_of(df, "member_entity_id", "member").alias("member"), first_of(df, "completeness_status").alias("c"), genes.alias("gene"))
    return out.withColumn("completeness", F.when(F.col("c").isin("complete", "partial"), F.col("c")).otherwise("partial")).drop("c").distinct()


def read_edges(spark: SparkSession, path: str, providers: list[str] | None = None) -> DataFrame:
    """Normalized edges of the chosen providers; rows without source, target or sign are left out."""
    df = read_table(spark, path).where("source is not null and target is not null and sign is not null")
    return df.where(F.col("provider").isin(providers)) if providers else df


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """Per provider the largest snapshot_id."""
    return snapshots.groupBy("provider").agg(F.max("snapshot_id").alias("snapshot_id"))


def flat(df: DataFrame) -> DataFrame:
    """Arrays joined with ;, structs and maps as JSON, so that text formats can hold them."""
    out = {}
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind == "array":
            out[f.name] = F.concat_ws(";", F.transform(f.name, lambda x: x.cast("string")))
        elif kind in ("struct", "map"):
            out[f.name] = F.to_json(f.name)
    return df.withColumns(out) if out else df


def write_tsv(df: DataFrame, path: str) -> None:
    flat(df).write.csv(path, sep="\t", header=True)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_stage(tables: dict[str, DataFrame], path: str, by: str | None = None) -> None:
    """Each table as Parquet in a folder of its name."""
    for name, df in tables.items():
        w = df.write
        (w.partitionBy(by) if by and by in df.columns else w).parquet(f"{path}/{name}")
