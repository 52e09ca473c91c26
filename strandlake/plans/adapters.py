"""Domain tables derived from the driver's tables, in SQL that Spark and DuckDB both run.

Each entry of TABLES is a query over source tables or other entries. `spark_tables` builds DataFrames,
`duckdb_with` the same tables as common table expressions in front of an oracle query.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")

#: {g}: the flag that makes DuckDB replace every match.
TABLES = {
    "sequences": """
        SELECT doc_id AS transcript_id,
               doc_id % (SELECT CAST(greatest(floor(count(*) / 4), 1) AS BIGINT) FROM documents) AS gene_id,
               translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', ''{g}), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS sequence
        FROM documents WHERE doc_id IS NOT NULL""",
    "guides": """
        SELECT transcript_id AS sirna_id, gene_id AS intended_gene, substr(sequence, 31, 21) AS passenger,
               reverse(translate(substr(sequence, 31, 21), 'ACGT', 'TGCA')) AS guide
        FROM sequences WHERE transcript_id % 20 = 0 AND length(sequence) >= 60""",
    "marks": "SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id",
    "annotation": """
        SELECT d.doc_id AS transcript_id,
               CASE WHEN d.lang = 'es' AND d.source = 'src2' THEN NULL ELSE d.doc_id % (SELECT CAST(greatest(floor(count(*) / 4), 1) AS BIGINT) FROM documents) END AS gene_id,
               d.doc_id % (SELECT CAST(greatest(floor(count(*) / 4), 1) AS BIGINT) FROM documents) AS original_gene_id,
               CASE WHEN d.source = 'src11' THEN 'mouse' ELSE 'human' END AS organism,
               CASE WHEN d.source = 'src13' THEN 'GRCh37' ELSE 'GRCh38' END AS assembly,
               CASE WHEN d.source = 'src4' THEN 'processed_pseudogene' WHEN d.source = 'src6' THEN 'readthrough_transcript' WHEN d.lang = 'en' THEN 'protein_coding' WHEN d.lang = 'fr' THEN 'retained_intron' WHEN d.lang = 'de' THEN 'processed_transcript' ELSE 'lncRNA' END AS biotype,
               CASE WHEN m.quality = 0 THEN NULL ELSE d.doc_id END AS sequence_reference,
               d.source = 'src3' AS deprecated, d.source = 'src5' AS alternative_contig,
               coalesce(m.toxic, 0) = 1 AS ambiguous, CASE WHEN d.n_chars % 5 = 0 THEN NULL ELSE CAST(d.n_chars % 5 AS VARCHAR(9)) END AS support_level,
               coalesce(d.source, '') <> 'src7' AS sequence_available
        FROM documents d LEFT JOIN marks m ON m.doc_id = d.doc_id WHERE d.doc_id IS NOT NULL""",
    "counts": """
        SELECT g.gene_id, s.sample, coalesce(c.n, 0) AS n
        FROM (SELECT DISTINCT l_partkey AS gene_id FROM lineitem) g
        CROSS JOIN (SELECT DISTINCT concat(CASE WHEN l_linenumber <= 3 THEN 'c' ELSE 't' END, CAST(l_linenumber AS VARCHAR(9))) AS sample FROM lineitem) s
        LEFT JOIN (SELECT l_partkey AS gene_id, concat(CASE WHEN l_linenumber <= 3 THEN 'c' ELSE 't' END, CAST(l_linenumber AS VARCHAR(9))) AS sample, sum(l_quantity) AS n FROM lineitem GROUP BY 1, 2) c
          ON c.gene_id = g.gene_id AND c.sample = s.sample""",
    "samples": """
        SELECT sample, CASE WHEN sample < 'd' THEN 'control' ELSE 'treated' END AS condition, row_number() OVER (PARTITION BY CASE WHEN sample < 'd' THEN 1 ELSE 2 END ORDER BY sample) AS replicate
        FROM (SELECT DISTINCT concat(CASE WHEN l_linenumber <= 3 THEN 'c' ELSE 't' END, CAST(l_linenumber AS VARCHAR(9))) AS sample FROM lineitem) s""",
    "precomputed": """
        SELECT p_partkey AS input_order, concat('G', CAST(p_partkey % 1500 AS VARCHAR(20))) AS gene, p_retailprice AS base_mean,
               CASE WHEN p_size % 17 = 0 THEN NULL ELSE (p_size - 25) / 10.0 END AS lfc,
               CASE WHEN p_size % 3 = 0 THEN NULL ELSE (p_size - 25) / 20.0 END AS lfc_shrunken,
               CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size / 500.0 END AS padj,
               CASE WHEN p_size % 11 = 0 THEN 'not_tested' WHEN p_size % 13 = 0 THEN ' Yes ' WHEN p_size % 19 = 0 THEN 'odd' ELSE NULL END AS tested,
               CASE WHEN p_size % 5 = 0 THEN 'independentFilter' WHEN p_size % 23 = 0 THEN 'unsupported' ELSE 'pass' END AS filter_raw,
               CASE WHEN p_size % 29 = 0 THEN 'low_count' WHEN p_size % 31 = 0 THEN '' ELSE 'pass' END AS low_count_raw,
               CASE WHEN p_size % 37 = 0 THEN 'failed' WHEN p_size % 41 = 0 THEN 'not_estimable' ELSE 'ok' END AS model_raw
        FROM part WHERE p_partkey IS NOT NULL""",
    "identifiers": """
        SELECT c_custkey AS input_order, c_name AS input_identifier, 'hgnc_symbol' AS identifier_type,
               CASE WHEN c_custkey % 41 = 0 THEN NULL ELSE concat('G', CAST(c_custkey % 1200 AS VARCHAR(20))) END AS canonical_gene_id,
               concat('SYM', CAST(c_custkey % 1200 AS VARCHAR(20))) AS canonical_symbol,
               concat('g', CAST(c_custkey % 1300 AS VARCHAR(20))) AS alias, concat('OLD', CAST(c_custkey % 900 AS VARCHAR(20))) AS previous_symbol,
               c_acctbal < -900 AS ambiguous, CASE WHEN c_custkey % 2 = 0 THEN 'unambiguous' ELSE 'probable' END AS confidence
        FROM customer WHERE c_custkey IS NOT NULL""",
    "lookups": """
        SELECT DISTINCT id FROM (
          SELECT gene AS id FROM precomputed
          UNION ALL SELECT concat(' old', CAST(s_suppkey AS VARCHAR(20)), ' ') FROM supplier
          UNION ALL SELECT concat('sym', CAST(p_partkey AS VARCHAR(20))) FROM part
          UNION ALL SELECT c_name FROM customer UNION ALL SELECT n_name FROM nation) u WHERE id IS NOT NULL""",
    "memberships": """
        SELECT p_brand AS term_id, concat('G', CAST(p_partkey AS VARCHAR(20))) AS gene, CASE WHEN p_size = 50 THEN 'partial' ELSE 'complete' END AS completeness, 'brand' AS dataset FROM part
        UNION ALL SELECT p_type, concat('G', CAST(p_partkey AS VARCHAR(20))), 'complete', 'type' FROM part""",
    "steps": """
        SELECT l_orderkey, l_linenumber, l_partkey AS source, l_returnflag, l_linestatus, l_quantity,
               lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) AS target
        FROM lineitem""",
    "edges": """
        SELECT evidence_id, provider, CAST(source AS VARCHAR(20)) AS source, CAST(target AS VARCHAR(20)) AS target, sign,
               CASE WHEN l_quantity < 5 THEN 'regulates' WHEN l_quantity < 8 THEN 'interaction' WHEN l_quantity < 25 THEN 'phosphorylation' ELSE 'transcription' END AS relation, ref,
               CASE WHEN l_quantity = 30 THEN NULL ELSE record_id END AS record_id, directed, functional_only, predicted_only, l_quantity BETWEEN 40 AND 41 AS contextual_only,
               CASE WHEN l_quantity < 20 THEN 'HeLa' WHEN l_quantity < 30 THEN 'A549' END AS cell_type, CASE WHEN l_quantity < 45 THEN 'lung' ELSE '' END AS tissue, 'human' AS organism
        FROM (
          SELECT concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(9)), '-a') AS evidence_id, CASE WHEN l_linestatus = 'F' THEN 'signor' ELSE 'omnipath' END AS provider, source, target,
                 CASE l_returnflag WHEN 'A' THEN 'positive' WHEN 'R' THEN 'negative' ELSE 'unsigned' END AS sign, l_quantity,
                 concat('PMID', CAST(l_orderkey AS VARCHAR(20))) AS ref, concat('R', CAST(l_orderkey AS VARCHAR(20)), '.', CAST(l_linenumber AS VARCHAR(9))) AS record_id,
                 l_returnflag <> 'N' AS directed, l_quantity > 48 AS functional_only, l_quantity < 3 AS predicted_only
          FROM steps WHERE target IS NOT NULL AND source <> target
          UNION ALL
          SELECT concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(9)), '-b'), 'omnipath_copy', source, target,
                 CASE l_returnflag WHEN 'A' THEN 'positive' WHEN 'R' THEN 'negative' ELSE 'unsigned' END, l_quantity,
                 concat('PMID', CAST(l_orderkey AS VARCHAR(20))), concat('R', CAST(l_orderkey AS VARCHAR(20)), '.', CAST(l_linenumber AS VARCHAR(9))), l_returnflag <> 'N', l_quantity > 48, l_quantity < 3
          FROM steps WHERE target IS NOT NULL AND source <> target AND l_linenumber IN (1, 3, 5, 7)
          UNION ALL
          SELECT concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(9)), '-c'), 'reactome', source, target, CASE l_returnflag WHEN 'A' THEN 'negative' ELSE 'positive' END,
                 l_quantity, concat('PMID9', CAST(l_orderkey AS VARCHAR(20))), concat('X', CAST(l_orderkey AS VARCHAR(20))), true, false, false
          FROM steps WHERE target IS NOT NULL AND source <> target AND l_quantity > 45) e""",
}

#: The same as TABLES' query, where Spark reads a table once for all branches of a union.
SPARK = {
    "edges": """
        SELECT concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(9)), '-', copy) AS evidence_id,
               CASE copy WHEN 'a' THEN CASE WHEN l_linestatus = 'F' THEN 'signor' ELSE 'omnipath' END WHEN 'b' THEN 'omnipath_copy' ELSE 'reactome' END AS provider,
               CAST(source AS VARCHAR(20)) AS source, CAST(target AS VARCHAR(20)) AS target,
               CASE WHEN copy = 'c' THEN CASE l_returnflag WHEN 'A' THEN 'negative' ELSE 'positive' END ELSE CASE l_returnflag WHEN 'A' THEN 'positive' WHEN 'R' THEN 'negative' ELSE 'unsigned' END END AS sign,
               CASE WHEN l_quantity < 5 THEN 'regulates' WHEN l_quantity < 8 THEN 'interaction' WHEN l_quantity < 25 THEN 'phosphorylation' ELSE 'transcription' END AS relation,
               concat(CASE WHEN copy = 'c' THEN 'PMID9' ELSE 'PMID' END, CAST(l_orderkey AS VARCHAR(20))) AS ref,
               CASE WHEN l_quantity = 30 THEN NULL WHEN copy = 'c' THEN concat('X', CAST(l_orderkey AS VARCHAR(20))) ELSE concat('R', CAST(l_orderkey AS VARCHAR(20)), '.', CAST(l_linenumber AS VARCHAR(9))) END AS record_id,
               copy = 'c' OR l_returnflag <> 'N' AS directed, copy <> 'c' AND l_quantity > 48 AS functional_only, copy <> 'c' AND l_quantity < 3 AS predicted_only, l_quantity BETWEEN 40 AND 41 AS contextual_only,
               CASE WHEN l_quantity < 20 THEN 'HeLa' WHEN l_quantity < 30 THEN 'A549' END AS cell_type, CASE WHEN l_quantity < 45 THEN 'lung' ELSE '' END AS tissue, 'human' AS organism
        FROM (SELECT *, explode(array('a', CASE WHEN l_linenumber IN (1, 3, 5, 7) THEN 'b' END, CASE WHEN l_quantity > 45 THEN 'c' END)) AS copy
              FROM steps WHERE target IS NOT NULL AND source <> target) e WHERE copy IS NOT NULL""",
}


def _needs(name: str) -> list[str]:
    """Entries that a table is built from, before itself."""
    out: list[str] = []
    for other in TABLES:
        if other != name and re.search(rf"\b(FROM|JOIN) {other}\b", TABLES[name]):
            out += [x for x in _needs(other) if x not in out]
    return [*out, name]


def spark_tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    made: dict[str, DataFrame] = {}
    for name in dict.fromkeys(x for n in names for x in _needs(n)):
        sql = SPARK.get(name, TABLES[name]).replace("{g}", "")
        used = {}
        for t in {*SOURCES, *made}:
            if re.search(rf"\b(FROM|JOIN) {t}\b", sql):
                used[t] = made[t] if t in made else spark.read.parquet(f"{sf_dir}/{t}.parquet")
                sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
        made[name] = spark.sql(sql, **used)
    return [made[n] for n in names]


def duckdb_with(*names: str) -> str:
    parts = [f"{n} AS ({TABLES[n].replace('{g}', ", 'g'")})" for n in dict.fromkeys(x for n in names for x in _needs(n))]
    return "WITH " + ",\n".join(parts)
