"""Registered queries of readers, writers and provider records: files written from the driver's tables, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import audit, edges, enrichment, identifiers, isoform
from strandlake.sources import files, providers, snapshots
from strandlake.sources.stored import shared_dir, stored

from .queries import LINEAGE_SQL, TYPE_SQL, query

SAMPLES = ("c1", "c2", "c3", "t4", "t5", "t6", "t7")


def _path(df, name: str) -> str:
    return f"{shared_dir(df.sparkSession)}/{name}"


def _csv(df, name: str, tab: bool = True) -> str:
    path = _path(df, name)
    df.write.csv(path, sep="\t" if tab else ",", header=True)
    return path


@query("read_counts", "counts", " SELECT CAST(gene_id AS VARCHAR) AS gene_id, sample, CAST(n AS DOUBLE) AS n FROM counts")
def _(counts):
    path = _csv(counts.groupBy("gene_id").pivot("sample", list(SAMPLES)).agg(F.first("n")), "counts.tsv")
    return files.read_counts(counts.sparkSession, path)


@query("read_samples", "samples", " SELECT sample, condition, replicate FROM samples")
def _(samples):
    return files.read_samples(samples.sparkSession, _csv(samples.select("sample", "condition"), "samples.csv", tab=False)).withColumn("replicate", F.col("replicate").cast("long"))


@query("read_fasta", "sequences", " SELECT concat('T', CAST(transcript_id AS VARCHAR)) AS transcript_id, concat('G', CAST(gene_id AS VARCHAR)) AS gene_id, sequence, '5UTR' AS first_region FROM sequences")
def _(sequences):
    head = F.concat(F.lit(">t transcript_id=T"), "transcript_id", F.lit(" gene=G"), "gene_id", F.lit(" region_0=5UTR region_90=CDS"))
    path = _path(sequences, "sequences.fa")
    # lines of 60 bases, as such files have
    sequences.select(F.concat(head, F.lit("\n"), F.regexp_replace(F.lower(F.translate("sequence", "T", "U")), "(.{60})", "$1\n")).alias("value")).write.text(path)
    return files.read_fasta(sequences.sparkSession, path).select("transcript_id", "gene_id", "sequence", F.col("regions")["0"].alias("first_region"))


@query("read_gtf", "annotation", """ SELECT feature, start, "end", CASE WHEN gene_id IS NOT NULL THEN concat('G', CAST(gene_id AS VARCHAR)) END AS gene_id, concat('T', CAST(transcript_id AS VARCHAR)) AS transcript_id FROM (SELECT *, 'transcript' AS feature, transcript_id * 10 AS start, transcript_id * 10 + 500 AS "end" FROM annotation) a""")
def _(annotation):
    named = F.concat(F.when(F.col("gene_id").isNotNull(), F.concat(F.lit('gene_id "G'), "gene_id", F.lit('"; '))).otherwise(""), F.lit('transcript_id "T'), "transcript_id", F.lit('";'))
    line = F.concat_ws("\t", F.lit("chr1"), F.lit("havana"), F.lit("transcript"), F.col("transcript_id") * 10, F.col("transcript_id") * 10 + 500, F.lit("."), F.lit("+"), F.lit("."), named)
    path = _path(annotation, "annotation.gtf")
    annotation.select(F.concat(F.lit("# a comment\n\n"), line).alias("value")).write.text(path)
    return files.read_gtf(annotation.sparkSession, path).select("feature", "start", "end", "gene_id", "transcript_id")


@query("read_network", "edges", " SELECT source, target, sign, count(*) AS n FROM edges GROUP BY ALL")
def _(edge):
    return files.read_network(edge.sparkSession, _csv(edge.select("source", "target", "sign"), "network.tsv")).groupBy("source", "target", "sign").agg(F.count("*").alias("n"))


@query("read_regulons", "memberships", " SELECT term_id AS regulon, gene FROM memberships WHERE dataset = 'type'")
def _(memberships):
    return files.read_regulons(memberships.sparkSession, _csv(memberships.where("dataset = 'type'").select(F.col("term_id").alias("regulator"), "gene"), "regulons.csv", tab=False)).select("regulon", "gene")


@query("read_precomputed", "precomputed", " SELECT gene, CAST(base_mean AS DOUBLE) AS base_mean, CAST(lfc AS DOUBLE) AS lfc, CASE WHEN input_order % 9 <> 0 THEN CAST(padj AS DOUBLE) END AS padj, filter_raw FROM precomputed")
def _(precomputed):
    text = precomputed.select(F.col("gene").alias("Gene"), F.col("base_mean").alias("baseMean"), F.col("lfc").alias("log2FC"), F.when(F.col("input_order") % 9 == 0, "NA").otherwise(F.col("padj").cast("string")).alias("padj"), F.col("filter_raw").alias("Filter"))
    return files.read_precomputed(precomputed.sparkSession, _csv(text, "results.tsv"), {"gene": "Gene", "base_mean": "baseMean", "lfc": "log2FC", "padj": "padj", "filter_raw": "Filter"})


@query("read_proportions", "annotation", " SELECT CAST(gene_id AS VARCHAR) AS gene_id, CAST(transcript_id AS VARCHAR) AS transcript_id, CASE WHEN transcript_id % 7 <> 0 THEN (transcript_id % 10) / 10.0 END AS proportion FROM annotation")
def _(annotation):
    out = annotation.select(F.col("gene_id").alias("canonical_gene_id"), F.col("transcript_id").alias("canonical_transcript_id"), F.when(F.col("transcript_id") % 7 == 0, "n/a").otherwise((F.col("transcript_id") % 10 / 10).cast("string")).alias("proportion"))
    return files.read_proportions(annotation.sparkSession, _csv(out, "proportions.tsv"))


LISTS_SQL = """, li AS (SELECT *, list_filter([alias, concat('x', alias)], lambda x: input_order % 3 <> 0 OR x NOT LIKE 'x%') AS aliases, CASE WHEN input_order % 5 = 0 THEN [] ELSE [previous_symbol, concat('ELD', CAST(input_order % 700 AS VARCHAR))] END AS previous FROM identifiers),
    ix AS (SELECT DISTINCT input_order, canonical_gene_id, canonical_symbol, confidence, ambiguous, list_transform(previous, lambda x: upper(x)) AS former, upper(trim(x)) AS lookup FROM (SELECT *, unnest(list_concat(list_concat([input_identifier, canonical_symbol], aliases), previous)) AS x FROM li) u WHERE x IS NOT NULL),
    hits AS (SELECT lookup, arg_min(coalesce(canonical_gene_id, ''), input_order) AS g, arg_min(former, input_order) AS former, count(DISTINCT canonical_gene_id) AS n, bool_or(ambiguous) AS amb FROM ix GROUP BY lookup),
    wanted AS (SELECT id FROM lookups UNION SELECT concat('eld', CAST(l AS VARCHAR)) FROM (SELECT unnest(range(0, 40)) AS l) r UNION SELECT concat('XG', CAST(l AS VARCHAR)) FROM (SELECT unnest(range(0, 40)) AS l) r)
    SELECT id, CASE WHEN h.lookup IS NULL THEN 'not_in_snapshot' WHEN n > 1 OR amb THEN 'ambiguous' WHEN g = '' THEN 'unmapped' ELSE 'unambiguous' END AS ambiguity_status, CASE WHEN n <= 1 AND NOT amb AND g <> '' THEN g END AS canonical_gene_id,
      CASE WHEN n <= 1 AND NOT amb AND g <> '' THEN CASE WHEN list_contains(former, h.lookup) THEN 'deprecated' ELSE 'current' END END AS deprecated_status FROM wanted LEFT JOIN hits h ON h.lookup = upper(trim(id))"""


@query("identifier_resource", "identifiers lookups", LISTS_SQL)
def _(records, lookups):
    """A resource with lists, as read from its file, resolves the lookups."""
    c = F.col
    aliases = F.when(c("input_order") % 3 == 0, c("alias")).otherwise(F.concat_ws(" ; ", "alias", F.concat(F.lit("x"), "alias")))
    previous = F.when(c("input_order") % 5 != 0, F.concat_ws(";", "previous_symbol", F.concat(F.lit("ELD"), c("input_order") % 700)))
    table = records.select("input_order", c("input_identifier").alias("identifier"), "canonical_gene_id", c("canonical_symbol").alias("symbol"), aliases.alias("aliases"), previous.alias("previous_symbols"), c("ambiguous").cast("string").alias("ambiguous"), "confidence")
    read = files.read_identifiers(records.sparkSession, _csv(table, "identifiers.tsv"))
    numbers = records.sparkSession.range(40)
    wanted = lookups.select("id").union(numbers.select(F.concat(F.lit("eld"), "id"))).union(numbers.select(F.concat(F.lit("XG"), "id"))).distinct()
    return identifiers.resolve(wanted, read).select("id", "ambiguity_status", "canonical_gene_id", "deprecated_status")


@query("identifier_tables", "identifiers", " SELECT k.kind, count(name) AS n, count(DISTINCT name) AS names FROM (SELECT unnest(['aliases', 'deprecated', 'cross_references', 'ambiguities']) AS kind) k LEFT JOIN (SELECT 'aliases' AS kind, alias AS name FROM identifiers UNION ALL SELECT 'deprecated', previous_symbol FROM identifiers UNION ALL SELECT 'cross_references', input_identifier FROM identifiers WHERE canonical_gene_id IS NOT NULL UNION ALL SELECT 'ambiguities', input_identifier FROM identifiers WHERE ambiguous) u ON u.kind = k.kind GROUP BY k.kind")
def _(records):
    table = records.select("input_order", "input_identifier", F.lit(None).cast("string").alias("identifier_type"), "canonical_gene_id", F.col("alias").alias("aliases"), F.col("previous_symbol").alias("previous_symbols"), F.col("ambiguous").cast("string").alias("ambiguous"))
    tables = files.identifier_tables(files.read_identifiers(records.sparkSession, _csv(table, "identifiers.tsv")))
    name = {"aliases": "alias", "deprecated": "previous_symbol", "cross_references": "reference", "ambiguities": "input_identifier"}
    out = None
    for kind, df in tables.items():
        one = df.agg(F.count("*").alias("n"), F.count_distinct(name[kind]).alias("names")).select(F.lit(kind).alias("kind"), "n", "names")
        out = one if out is None else out.unionByName(one)
    return out


@query("annotation_snapshot", "annotation", " SELECT count(*) AS record_count, count(*) AS found_count, true AS valid, count(DISTINCT gene_id) AS genes FROM annotation")
def _(annotation):
    path = _path(annotation, "snapshot")
    files.write_snapshot(annotation, path, "manifest.json", "transcripts.jsonl")
    rows, check = files.read_snapshot(annotation.sparkSession, path, "manifest.json", "transcripts.jsonl", ["transcript_id", "biotype"])
    return check.select("record_count", "found_count", "valid").join(rows.agg(F.count_distinct("gene_id").alias("genes")))


@query("verified_snapshots", "memberships", " SELECT dataset, completeness, count(*) AS rows FROM memberships WHERE dataset = 'type' GROUP BY ALL")
def _(memberships):
    """Each dataset is written as a snapshot; then a file of `brand` is replaced by other bytes, so only `type` is read."""
    spark, root = memberships.sparkSession, _path(memberships, "verified")
    for name in ("brand", "type"):
        snapshots.write_snapshot(memberships.where(F.col("dataset") == name), root, name, f"{name}-1")
    file = snapshots.file_checksums(spark, f"{root}/brand").first()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/brand/brand-1/normalized/{file.name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.writeBytes("not what was written")
    out.close()
    return snapshots.read_verified(spark, root).groupBy("dataset", "completeness").agg(F.count("*").alias("rows"))


@query("read_memberships", "memberships", " SELECT dataset, term_id, gene, completeness FROM (SELECT DISTINCT * FROM memberships WHERE dataset = 'brand') m")
def _(memberships):
    table = memberships.where("dataset = 'brand'").groupBy("term_id", "completeness").agg(F.concat_ws("; ", F.sort_array(F.collect_set("gene"))).alias("genes"))
    table = table.select(F.col("term_id").alias("pathway_id"), F.col("completeness").alias("completeness_status"), "genes")
    return files.read_memberships(memberships.sparkSession, _csv(table, "members.tsv"), "brand").select("dataset", "term_id", "gene", "completeness")


@query("read_edges", "edges", " SELECT provider, count(*) AS n, count(DISTINCT source) AS sources FROM edges WHERE provider IN ('signor', 'reactome') GROUP BY provider")
def _(edge):
    path = _path(edge, "edges.parquet")
    edge.write.partitionBy("provider").parquet(path)
    return files.read_edges(edge.sparkSession, path, ["signor", "reactome"]).groupBy("provider").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


@query("latest_snapshots", "edges", " SELECT provider, max(ref) AS snapshot_id FROM edges GROUP BY provider")
def _(edge):
    return files.latest_snapshots(edge.select("provider", F.col("ref").alias("snapshot_id")))


@query("written_formats", "memberships", " SELECT format, term_id, genes FROM (SELECT term_id, string_agg(DISTINCT gene, ';' ORDER BY gene) AS genes FROM memberships WHERE dataset = 'type' GROUP BY term_id) t, (SELECT unnest(['tsv', 'jsonl', 'parquet']) AS format) f")
def _(memberships):
    spark, terms = memberships.sparkSession, memberships.where("dataset = 'type'").groupBy("term_id").agg(F.sort_array(F.collect_set("gene")).alias("genes"))
    tsv, json, stage = _path(terms, "terms.tsv"), _path(terms, "terms.jsonl"), _path(terms, "stage")
    files.write_tsv(terms, tsv)
    files.write_jsonl(terms, json)
    files.write_stage({"terms": terms}, stage)
    text = files.read_table(spark, tsv).select(F.lit("tsv").alias("format"), "term_id", "genes")
    back = {"jsonl": spark.read.json(json), "parquet": spark.read.parquet(f"{stage}/terms")}
    for name, df in back.items():
        text = text.unionByName(df.select(F.lit(name).alias("format"), "term_id", F.concat_ws(";", "genes").alias("genes")))
    return text


# --- provider records ----------------------------------------------------------------------------

EDGE_COLUMNS = ("provider", "source", "target", "sign", "relation", "record_id", "directed", "functional_only", "evidence_id")


@query("omnipath_edges", "edges", " SELECT 'omnipath' AS provider, source, target, sign, relation, coalesce(record_id, '') AS record_id, directed, NOT directed AS functional_only, concat('omnipath:', coalesce(record_id, concat(source, '>', target))) AS evidence_id FROM edges WHERE provider = 'omnipath'")
def _(edge):
    raw = edge.where("provider = 'omnipath'").select(F.concat(F.lit(" "), "source").alias("source_genesymbol"), F.col("target").alias("target_genesymbol"), (F.col("sign") == "positive").alias("is_stimulation"), (F.col("sign") == "negative").alias("is_inhibition"), F.col("directed").alias("is_directed"), F.col("relation").alias("type"), F.col("ref").alias("references"), F.col("record_id").alias("id"))
    return providers.omnipath(raw).select(*EDGE_COLUMNS).withColumn("record_id", F.coalesce("record_id", F.lit("")))


@query("signor_edges", "edges", " SELECT 'signor' AS provider, source, target, sign, relation, coalesce(record_id, '') AS record_id, true AS directed, false AS functional_only, concat('signor:', coalesce(record_id, concat(source, '>', target))) AS evidence_id, ref AS refs FROM edges WHERE provider = 'signor'")
def _(edge):
    effect = F.when(F.col("sign") == "positive", "up-regulates").when(F.col("sign") == "negative", "Inhibits").otherwise("unknown")
    raw = edge.where("provider = 'signor'").select(F.col("source").alias("ENTITYA"), F.col("target").alias("ENTITYB"), effect.alias("EFFECT"), F.col("relation").alias("MECHANISM"), F.concat("ref", F.lit("; "), "ref").alias("PMID"), F.col("record_id").alias("SIGNOR_ID"))
    return providers.signor(raw).select(*EDGE_COLUMNS, F.concat_ws(";", "refs").alias("refs")).withColumn("record_id", F.coalesce("record_id", F.lit("")))


@query("reactome_fi_edges", "edges", " SELECT 'reactome_fi' AS provider, source, target, 'unsigned' AS sign, 'functional' AS relation, record_id, false AS directed, true AS functional_only, concat('reactome_fi:', record_id) AS evidence_id FROM edges WHERE provider = 'reactome'")
def _(edge):
    raw = edge.where("provider = 'reactome'").select(F.col("source").alias("Gene1"), F.col("target").alias("Gene2"), F.col("record_id").alias("id"))
    return providers.reactome_fi(raw).select(*EDGE_COLUMNS)


@query("reactome_content_edges", "edges", " SELECT 'reactome_content' AS provider, source, target, sign, CASE sign WHEN 'positive' THEN 'positive_regulation' ELSE 'inhibition' END AS relation, record_id, true AS directed, false AS functional_only, concat('reactome_content:', record_id) AS evidence_id FROM edges WHERE provider = 'reactome'")
def _(edge):
    kind = F.when(F.col("sign") == "positive", "Positive_Regulation").otherwise("INHIBITION")
    raw = edge.where("provider = 'reactome'").select("source", "target", kind.alias("relation_type"), F.col("record_id").alias("event_id"))
    return providers.reactome_content(raw).select(*EDGE_COLUMNS)


DOCS_SQL = " SELECT '{0}' AS provider, term_id, term_id AS term_name, CAST(count(DISTINCT gene) AS DOUBLE) AS observed, count(*) / 10.0 AS expected, CAST(0.01 AS DOUBLE) AS p_value, CAST(0.05 AS DOUBLE) AS q_value FROM memberships WHERE dataset = 'brand' GROUP BY term_id"


@query("panther_rows", "memberships", DOCS_SQL.format("panther"))
def _(memberships):
    one = memberships.where("dataset = 'brand'").groupBy("term_id").agg(F.count_distinct("gene").alias("n"), F.count("*").alias("m"))
    item = F.struct(F.struct(F.col("term_id").alias("id"), F.lit(None).cast("string").alias("label")).alias("term"), F.col("n").alias("number_in_list"), (F.col("m") / 10).alias("expected"), F.lit(0.01).alias("pValue"), F.lit(0.05).alias("fdr"))
    docs = one.select(F.to_json(F.struct(F.struct(F.array(item).alias("result")).alias("results"))).alias("value"))
    return providers.panther(docs).select("provider", "term_id", "term_name", "observed", "expected", "p_value", "q_value")


@query("reactome_rows", "memberships", " SELECT 'reactome' AS provider, term_id, term_id AS term_name, CAST(count(DISTINCT gene) AS DOUBLE) AS observed, string_agg(DISTINCT gene, ';' ORDER BY gene) AS genes FROM memberships WHERE dataset = 'brand' GROUP BY term_id")
def _(memberships):
    one = memberships.where("dataset = 'brand'").groupBy("term_id").agg(F.sort_array(F.collect_set("gene")).alias("genes"))
    item = F.struct(F.col("term_id").alias("stId"), F.col("term_id").alias("name"), F.struct(F.col("genes").alias("found"), F.lit(0.01).alias("pValue")).alias("entities"))
    docs = one.select(F.to_json(F.struct(F.array(item).alias("pathways"))).alias("value"))
    return providers.reactome_analysis(docs).select("provider", "term_id", "term_name", "observed", F.concat_ws(";", "genes").alias("genes"))


@query("hit_memberships", "memberships", " SELECT 'reactome' AS dataset, term_id, gene, concat('gene:', gene) AS member, 'submitted_hit_only' AS completeness FROM (SELECT DISTINCT term_id, upper(gene) AS gene FROM memberships WHERE dataset = 'brand') m")
def _(memberships):
    hits = memberships.where("dataset = 'brand'").groupBy(F.lit("reactome").alias("provider"), "term_id").agg(F.collect_set(F.lower("gene")).alias("genes")).withColumn("term_name", F.lit(None).cast("string"))
    return enrichment.memberships_of_hits(hits).select("dataset", "term_id", "gene", "member", "completeness")


@query("selected_edges", "edges", " SELECT mode, count(evidence_id) AS n FROM (SELECT 'local' AS mode, evidence_id FROM edges UNION ALL SELECT 'public_cache', evidence_id FROM edges WHERE provider IN ('signor', 'omnipath') UNION ALL SELECT 'disabled', NULL) u GROUP BY mode")
def _(edge):
    chosen = edge.where("provider in ('signor', 'omnipath')").select("provider").distinct()
    out = None
    for mode in ("local", "public_cache", "disabled"):
        one = providers.selected(edge, chosen, mode).agg(F.count("*").alias("n")).select(F.lit(mode).alias("mode"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("deduplicated_edges", "edges", " SELECT substr(sha256(concat_ws('|', upper(source), upper(target), lower(relation), lower(sign), coalesce(record_id, ''), coalesce(ref, ''))), 1, 24) AS lineage_key, min(evidence_id) AS evidence_id, string_agg(DISTINCT provider, ';' ORDER BY provider) AS routes, string_agg(DISTINCT ref, ';' ORDER BY ref) AS refs FROM edges GROUP BY 1")
def _(edge):
    return edges.deduplicated(edge).withColumns({"routes": F.concat_ws(";", "routes"), "refs": F.concat_ws(";", "refs")})


@query("sign_words", "edges", " SELECT word, second, CASE WHEN second IS NOT NULL AND second = 'true' AND word IN ('1', 'activation') THEN 'conflicting' WHEN second = 'true' OR word IN ('-1', 'represses') THEN 'negative' WHEN word IN ('1', 'activation') THEN 'positive' ELSE 'unsigned' END AS sign, n FROM (SELECT CASE sign WHEN 'positive' THEN CASE WHEN directed THEN '1' ELSE 'activation' END WHEN 'negative' THEN CASE WHEN predicted_only THEN '-1' ELSE 'represses' END ELSE 'binds' END AS word, CASE WHEN contextual_only THEN 'true' ELSE 'false' END AS second, count(*) AS n FROM edges GROUP BY ALL) w")
def _(edge):
    word = F.when(F.col("sign") == "positive", F.when(F.col("directed"), "1").otherwise("activation")).when(F.col("sign") == "negative", F.when(F.col("predicted_only"), "-1").otherwise("represses")).otherwise("binds")
    rows = edge.select(word.alias("word"), F.when(F.col("contextual_only"), "true").otherwise("false").alias("second")).groupBy("word", "second").agg(F.count("*").alias("n"))
    return rows.select("word", "second", edges.normalized_sign(F.col("word"), F.col("second")).alias("sign"), "n")


# --- identifiers ---------------------------------------------------------------------------------


@query("alias_resolution", "lookups identifiers", f", al AS (SELECT upper(alias) AS lookup, count(DISTINCT canonical_symbol) AS n, min(canonical_symbol) AS c FROM identifiers GROUP BY 1) SELECT id, CASE WHEN n = 1 THEN c WHEN n IS NULL THEN CASE WHEN {TYPE_SQL} IN ('hgnc_symbol', 'uniprot_accession') THEN upper(trim(id)) ELSE trim(id) END END AS resolved, CASE WHEN n IS NULL THEN 'self' WHEN n = 1 THEN 'mapped' ELSE 'ambiguous' END AS status FROM lookups LEFT JOIN al ON al.lookup = upper(trim(id))")
def _(lookups, records):
    return identifiers.alias_resolution(lookups, records.select("alias", F.col("canonical_symbol").alias("canonical")))


@query("entity_registry", "identifiers", """, en AS (SELECT input_order, CASE WHEN canonical_gene_id IS NOT NULL THEN concat('gene:', canonical_gene_id) ELSE concat('entity-', substr(sha256(concat('human|', upper(input_identifier))), 1, 24)) END AS entity_id, canonical_symbol AS symbol, CASE input_order % 4 WHEN 0 THEN 'gene' WHEN 1 THEN 'protein' WHEN 2 THEN 'family' ELSE 'unknown' END AS entity_type, confidence AS source FROM identifiers)
    SELECT entity_id, arg_min(symbol, input_order) AS symbol, arg_min(entity_type, input_order) AS entity_type, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM en GROUP BY entity_id""")
def _(records):
    n = F.col("input_order") % 4
    word = F.when(n == 0, " Gene ").when(n == 1, "ReferenceGeneProduct").when(n == 2, "DefinedSet").otherwise("gizmo")
    rows = identifiers.entity_ids(records.select("input_order", F.col("input_identifier").alias("id"), "canonical_gene_id", F.col("canonical_symbol").alias("symbol"), identifiers.entity_type(word).alias("entity_type"), F.col("confidence").alias("source"), F.lit("hgnc").alias("provider")))
    return identifiers.registry(rows).select("entity_id", "symbol", "entity_type", F.concat_ws(",", "sources").alias("sources"))


@query("gene_inventory", "sequences identifiers", " SELECT DISTINCT CAST(s.gene_id AS VARCHAR) AS id, i.g IS NOT NULL AS mapped FROM sequences s LEFT JOIN (SELECT DISTINCT CAST(input_order AS VARCHAR) AS id, canonical_gene_id AS g FROM identifiers WHERE canonical_gene_id IS NOT NULL) i ON i.id = CAST(s.gene_id AS VARCHAR)")
def _(sequences, records):
    return identifiers.inventory(sequences, records.select(F.col("input_order").cast("string").alias("id"), "canonical_gene_id"))


@query("member_expansion", "memberships", " SELECT DISTINCT e.term_id AS entity_id, coalesce(m.gene, e.term_id) AS member, CASE WHEN m.gene IS NULL THEN e.term_id ELSE m.gene END AS display FROM memberships e LEFT JOIN (SELECT DISTINCT term_id, concat('gene:', gene) AS gene FROM memberships WHERE dataset = 'brand') m ON m.term_id = e.term_id")
def _(memberships):
    entities = memberships.select(F.col("term_id").alias("entity_id")).distinct()
    members = memberships.where("dataset = 'brand'").select(F.col("term_id").alias("entity_id"), F.concat(F.lit("gene:"), "gene").alias("member")).distinct()
    return identifiers.expand_members(entities, members, "expand").withColumn("display", F.col("member"))


@query("display_symbols", "identifiers", " SELECT input_order, CASE WHEN input_order % 2 = 0 THEN canonical_symbol ELSE canonical_gene_id END AS display FROM identifiers WHERE canonical_gene_id IS NOT NULL")
def _(records):
    rows = records.where("canonical_gene_id is not null")
    return rows.select("input_order", identifiers.display_symbol(F.when(F.col("input_order") % 2 == 0, F.col("canonical_symbol")), F.concat(F.lit("gene:"), "canonical_gene_id")).alias("display"))


# --- isoforms and audits on files ----------------------------------------------------------------


@query("external_weights", "annotation", """, el AS (SELECT transcript_id, gene_id FROM annotation WHERE gene_id IS NOT NULL AND NOT ambiguous), ex AS (SELECT gene_id, transcript_id, (transcript_id % 10) / 10.0 AS p FROM el WHERE transcript_id % 7 <> 0)
    SELECT el.transcript_id, el.gene_id, round(CASE WHEN sum(p) OVER (PARTITION BY el.gene_id) > 0 THEN p / sum(p) OVER (PARTITION BY el.gene_id) END, 6) AS weight FROM el LEFT JOIN ex ON ex.transcript_id = el.transcript_id AND ex.gene_id = el.gene_id""")
def _(annotation):
    eligible = annotation.where("gene_id is not null and not ambiguous").select("transcript_id", "gene_id")
    given = eligible.where("transcript_id % 7 <> 0").withColumn("proportion", F.col("transcript_id") % 10 / 10)
    return isoform.external_weights(given, eligible).select("transcript_id", "gene_id", F.round("weight", 6).alias("weight"))


@query("external_issues", "annotation", """, el AS (SELECT transcript_id, gene_id FROM annotation WHERE gene_id IS NOT NULL AND NOT ambiguous), ex AS (SELECT CASE WHEN transcript_id % 11 = 0 THEN gene_id + 1 ELSE gene_id END AS gene_id, CASE WHEN transcript_id % 13 = 0 THEN -transcript_id ELSE transcript_id END AS transcript_id, 0.25 AS p FROM el WHERE transcript_id % 7 <> 0)
    SELECT DISTINCT * FROM (SELECT ex.gene_id, CASE WHEN el.transcript_id IS NULL THEN 'not_eligible' WHEN el.gene_id <> ex.gene_id THEN 'wrong_gene' END AS issue FROM ex LEFT JOIN el ON el.transcript_id = ex.transcript_id UNION ALL SELECT gene_id, 'sum_not_one' FROM ex GROUP BY gene_id HAVING abs(sum(p) - 1) > 1e-6 UNION ALL SELECT gene_id, 'duplicate' FROM ex GROUP BY gene_id, transcript_id HAVING count(*) > 1
      UNION ALL SELECT el.gene_id, 'missing' FROM el WHERE gene_id IN (SELECT gene_id FROM ex) AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.gene_id = el.gene_id AND ex.transcript_id = el.transcript_id)) u WHERE issue IS NOT NULL""")
def _(annotation):
    eligible = annotation.where("gene_id is not null and not ambiguous").select("transcript_id", "gene_id")
    t = F.col("transcript_id")
    given = eligible.where("transcript_id % 7 <> 0").select(F.when(t % 11 == 0, F.col("gene_id") + 1).otherwise(F.col("gene_id")).alias("gene_id"), F.when(t % 13 == 0, -t).otherwise(t).alias("transcript_id"), F.lit(0.25).alias("proportion"))
    return isoform.external_issues(given, eligible)


@query("prior_intervals", "counts samples", """, m AS (SELECT gene_id, avg(n) FILTER (condition = 'control') AS c, avg(n) FILTER (condition = 'treated') AS t FROM counts JOIN samples ON samples.sample = counts.sample GROUP BY gene_id)
    SELECT gene_id, CASE WHEN c > 0 THEN round(greatest(0.0, least(1.0, (1 - t / c) / 0.95)), 6) END AS lower, CASE WHEN c > 0 THEN round(greatest(0.0, least(1.0, (1 - t / c) / 0.7)), 6) END AS upper, 6 AS steps FROM m""")
def _(counts, samples):
    rows = counts.join(samples, "sample").groupBy("gene_id").agg(F.avg(F.when(F.col("condition") == "control", F.col("n").cast("double"))).alias("c"), F.avg(F.when(F.col("condition") == "treated", F.col("n").cast("double"))).alias("t"))
    x = isoform.targetable_fraction(F.col("c"), F.col("t"), 0.7, 0.95)
    return rows.select("gene_id", F.round(x["lower"], 6).alias("lower"), F.round(x["upper"], 6).alias("upper"), F.size(isoform.efficiency_grid(0.7, 0.95, 0.05)).alias("steps"))


@query("table_hash", "annotation", " SELECT count(*) AS rows, true AS order_free, false AS same_if_changed FROM annotation")
def _(annotation):
    a, b, c = (audit.content_hash(x) for x in (annotation, annotation.repartition(7, "biotype").sort("gene_id"), annotation.withColumn("gene_id", F.when(F.col("transcript_id") == 0, -1).otherwise(F.col("gene_id")))))
    both = a.select("rows", F.col("digest").alias("one")).join(b.select(F.col("digest").alias("two"))).join(c.select(F.col("digest").alias("three")))
    return both.select("rows", (F.col("one") == F.col("two")).alias("order_free"), (F.col("one") == F.col("three")).alias("same_if_changed"))


@query("changed_rows", "annotation", " SELECT transcript_id, CASE WHEN side = 'two' THEN 'mouse2' ELSE organism END AS organism, side FROM annotation, (SELECT unnest(['one', 'two']) AS side) s WHERE transcript_id % 50 = 3")
def _(annotation):
    rows = annotation.select("transcript_id", "organism")
    return audit.changed_rows(rows, rows.withColumn("organism", F.when(F.col("transcript_id") % 50 == 3, "mouse2").otherwise(F.col("organism"))))


@query("snapshot_audit", "annotation", """ SELECT 'duplicate' AS "check", CAST(k AS VARCHAR) AS key, CAST(n AS VARCHAR) AS detail FROM (SELECT gene_id AS k, count(*) AS n FROM annotation WHERE gene_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1) d UNION ALL SELECT 'null_key', NULL, CAST(count(*) AS VARCHAR) FROM annotation WHERE gene_id IS NULL HAVING count(*) > 0 UNION ALL SELECT 'mixed_organisms', NULL, CAST(count(DISTINCT organism) AS VARCHAR) FROM annotation HAVING count(DISTINCT organism) > 1""")
def _(annotation):
    return audit.snapshot_issues(annotation, "gene_id", "organism")


@query("consensus_report", "edges", LINEAGE_SQL + """ SELECT edge_id, source, target, kind, sign, CASE WHEN min_quality >= 0.8 THEN 'high' WHEN min_quality >= 0.6 THEN 'moderate' WHEN min_quality >= 0.4 THEN 'low' WHEN min_quality >= 0.25 THEN 'contextual' ELSE 'insufficient' END AS evidence_level, sign = 'unsigned' OR functional_only AS functional_only,
    sign IN ('positive', 'negative') AND NOT functional_only AS causal_eligible, n_positive AS positive_lineages, n_negative AS negative_lineages, duplicates AS duplicate_lineages, CASE WHEN sign = 'positive' THEN independent + duplicates ELSE 0 END AS positive_raw_evidence, CASE WHEN sign = 'negative' THEN independent + duplicates ELSE 0 END AS negative_raw_evidence, CASE WHEN sign = 'unsigned' THEN independent + duplicates ELSE 0 END AS unsigned_raw_evidence FROM cs""")
def _(edge):
    from .queries import _consensus

    return edges.consensus_report(_consensus(edge))


@query("graph_metrics", "edges", LINEAGE_SQL + """, mt AS (SELECT unnest(['provider_evidence', 'resolved_evidence', 'unresolved_evidence']) AS metric, unnest([count(*), count(*), 0]) AS value FROM edges
    UNION ALL SELECT unnest(['lineage_groups', 'duplicate_lineages', 'independent_lineages', 'unresolved_lineages']), unnest([count(*), count(*) FILTER (lineage_class LIKE '%duplicate'), count(*) FILTER (lineage_class LIKE 'independent%'), 0]) FROM qq
    UNION ALL SELECT 'consensus_edges', count(*) FROM cs UNION ALL SELECT concat(l, '_consensus_edges'), count(layer) FROM (SELECT unnest(['signed_causal', 'unsigned_functional', 'contextual', 'conflicting']) AS l) x LEFT JOIN ly ON layer = l GROUP BY l
    UNION ALL SELECT concat(layer, '_graph_edges'), count(*) FROM ly GROUP BY layer UNION ALL SELECT concat(layer, '_graph_nodes'), count(DISTINCT x) FROM (SELECT layer, source AS x FROM ly UNION ALL SELECT layer, target FROM ly) u GROUP BY layer) SELECT metric, value FROM mt""")
def _(edge):
    groups = edges.quality(edges.lineage_classes(edges.lineage_groups(edge)))
    found = stored(edges.consensus(groups).select("source", "target", "layers"))  # two branches read it
    return edges.graph_metrics(edge, groups, found)


STATIC_SQL = """, ev AS (SELECT *, CASE WHEN relation = 'phosphorylation' THEN 'kinase' END AS mechanism, CASE WHEN predicted_only THEN 'indirect' ELSE 'direct' END AS directness, provider = 'signor' AS curated, CASE WHEN contextual_only THEN 4 ELSE 1 END AS n_refs, 2 AS n_sources, CASE WHEN record_id IS NOT NULL THEN 'snap' END AS snapshot FROM edges),
    sc AS (SELECT *, CASE WHEN directed THEN 0.15 ELSE 0 END + CASE WHEN sign <> 'unsigned' THEN 0.15 ELSE 0 END + CASE WHEN mechanism IS NOT NULL THEN 0.15 ELSE 0 END + CASE WHEN directness = 'direct' THEN 0.15 ELSE 0 END + CASE WHEN curated THEN 0.15 ELSE 0 END + least(n_refs, 3) / 3 * 0.1 + 0.1 + CASE WHEN snapshot IS NOT NULL THEN 0.025 ELSE 0 END AS raw FROM ev),
    cp AS (SELECT *, least(raw, CASE WHEN functional_only AND sign = 'unsigned' THEN 0.55 ELSE 1 END, CASE WHEN NOT directed OR sign = 'unsigned' THEN 0.45 ELSE 1 END, CASE WHEN predicted_only THEN 0.7 ELSE 1 END) AS capped, CASE WHEN directed THEN 2 ELSE 0 END + CASE WHEN sign <> 'unsigned' THEN 2 ELSE 0 END + least(n_refs, 3) + 2 - CASE WHEN predicted_only THEN 2 ELSE 0 END - CASE WHEN functional_only THEN 2 ELSE 0 END AS points FROM sc)
    SELECT evidence_id, round(raw, 6) AS raw_score, round(capped, 6) AS capped_score, CASE WHEN capped >= 0.8 THEN 'high' WHEN capped >= 0.6 THEN 'moderate' WHEN capped >= 0.4 THEN 'low' WHEN capped >= 0.25 THEN 'contextual' ELSE 'insufficient' END AS final_level,
      CAST(greatest(points, 0) AS DOUBLE) AS component_score, CASE WHEN functional_only THEN 'contextual' WHEN points >= 6 THEN 'high' WHEN points >= 4 THEN 'moderate' WHEN points > 0 THEN 'low' ELSE 'insufficient' END AS evidence_level FROM cp"""


@query("static_quality", "edges", STATIC_SQL)
def _(edge):
    c = F.col
    rows = edge.withColumns({"mechanism": F.when(c("relation") == "phosphorylation", "kinase"), "directness": F.when(c("predicted_only"), "indirect").otherwise("direct"), "curated": c("provider") == "signor", "n_refs": F.when(c("contextual_only"), 4).otherwise(1), "n_sources": F.lit(2), "snapshot": F.when(c("record_id").isNotNull(), "snap")})
    return edges.static_level(edges.static_quality(rows)).select("evidence_id", "raw_score", "capped_score", "final_level", "component_score", "evidence_level")


@query("edge_contexts", "edges", """, lb AS (SELECT *, CASE WHEN cell_type IS NULL THEN CASE WHEN tissue = '' THEN 'human' ELSE concat('human|', tissue) END ELSE concat('human|', cell_type, CASE WHEN tissue = '' THEN '' ELSE concat('|', tissue) END) END AS label, CASE WHEN cell_type IS NULL THEN 'unknown_left' WHEN cell_type = 'HeLa' THEN 'partial_overlap' ELSE 'mismatch' END AS comparison FROM edges)
    SELECT kind, value, count(*) AS n FROM (SELECT unnest(['organism', 'cell_type', 'tissue', 'label', 'comparison']) AS kind, unnest([organism, cell_type, nullif(tissue, ''), label, comparison]) AS value FROM lb) u GROUP BY ALL""")
def _(edge):
    names = ["organism", "cell_type", "tissue"]
    rows = edges.context_rows(edge, names).select(F.col("dimension").alias("kind"), "value")
    more = {"label": edges.context_label(names), "comparison": edges.context_comparison(F.col("cell_type"), F.lit("HeLa, K562"))}
    for kind, value in more.items():
        rows = rows.unionByName(edge.select(F.lit(kind).alias("kind"), value.alias("value")))
    return rows.groupBy("kind", "value").agg(F.count("*").alias("n"))
