"""Gene sets, background, over-representation and its correction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.sources.stored import stored

from .ordered import minimum_from, ranked_in

SETS = ("up", "down", "changed", "low_count", "unmapped", "target_related")


def gene_sets(effects: DataFrame, padj: float = 0.05, effect: float = 0.5, targets: DataFrame | None = None) -> DataFrame:
    """(gene_set, gene) of rows (gene, effect, padj, direction, low_count, mapped). targets: (gene), the intended ones."""
    effects = effects.withColumn("_target", F.lit(False)) if targets is None else effects.join(targets.select("gene", F.lit(True).alias("_target")).distinct(), "gene", "left")
    changed = ~F.col("low_count") & (F.col("padj") <= padj) & (F.abs("effect") >= effect)
    tests = {"up": changed & (F.col("effect") > 0) & (F.col("direction") == "up"), "down": changed & (F.col("effect") < 0) & (F.col("direction") == "down"), "changed": changed, "low_count": F.col("low_count"), "unmapped": ~F.col("mapped"), "target_related": F.col("_target")}
    return effects.select(F.explode(F.array_compact(F.array(*[F.when(tests[s], F.lit(s)) for s in SETS]))).alias("gene_set"), "gene").distinct()


def background(effects: DataFrame, annotated: DataFrame, mode: str = "tested_detectable_annotatable") -> DataFrame:
    """(gene, exclusion): why a gene isn't in the background, or null. annotated: (gene)."""
    rows = effects.groupBy("gene").agg(F.bool_or("tested").alias("tested"), F.bool_and("low_count").alias("low_count")).join(annotated.select("gene").distinct().withColumn("a", F.lit(True)), "gene", "left")
    out = F.when(~F.col("tested"), "not_tested")
    if mode == "tested_detectable_annotatable":
        out = out.when(F.col("low_count"), "not_detectable").when(F.col("a").isNull(), "not_annotatable")
    return rows.select("gene", out.alias("exclusion"))


def log_factorial(n: Column) -> Column:
    """ln(n!) for a column: exact sums up to 255, Stirling's series with three terms beyond (relative error below 1e-15)."""
    x = n.cast("double")
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + F.ln(i.cast("double")))
    big = x * F.ln(x) - x + 0.5 * F.ln(2 * 3.141592653589793 * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n < 256, small).otherwise(big)


def hypergeometric_tail(rows: DataFrame, out: str = "p_value") -> DataFrame:
    """Adds P(X >= a) for the table (a, b, c, d); its terms follow from the first by ratios."""
    a, b, c, d = (F.col(x).cast("long") for x in "abcd")
    lf = log_factorial
    first = lf(a + b) + lf(c + d) + lf(a + c) + lf(b + d) - lf(a) - lf(b) - lf(c) - lf(d) - lf(a + b + c + d)
    rows = rows.withColumn("_first", F.exp(first))
    steps = F.sequence(F.lit(0).cast("long"), F.least(b, c))
    # term i + 1 = term i * (b - i)(c - i) / ((a + i + 1)(d + i + 1))
    walk = F.aggregate(
        steps,
        F.struct(F.col("_first").alias("term"), F.lit(0.0).alias("sum")),
        lambda s, i: F.struct((s["term"] * ((b - i) * (c - i)).cast("double") / ((a + i + 1) * (d + i + 1)).cast("double")).alias("term"), (s["sum"] + s["term"]).alias("sum")),
        lambda s: F.least(s["sum"], F.lit(1.0)),
    )
    return rows.withColumn(out, walk).drop("_first")


def overrepresentation(sets: DataFrame, terms: DataFrame, universe: DataFrame) -> DataFrame:
    """Per (gene_set, dataset, term_id) with overlap: contingency a, b, c, d, expected, fold, p_value.

    sets: (gene_set, gene); terms: (dataset, term_id, gene, completeness), of which terms that aren't
    complete are left out; universe: (gene).
    """
    bg = universe.select("gene").distinct()
    size = bg.agg(F.count("*").alias("n_bg"))  # one row
    partial = terms.where("completeness <> 'complete'").select("dataset", "term_id").distinct()
    t = terms.join(partial, ["dataset", "term_id"], "left_anti").select("dataset", "term_id", "gene").distinct().join(bg, "gene")
    s = sets.select("gene_set", "gene").distinct().join(bg, "gene")
    n_t, n_s = t.groupBy("dataset", "term_id").agg(F.count("*").alias("n_term")), s.groupBy("gene_set").agg(F.count("*").alias("n_set"))
    out = s.join(t, "gene").groupBy("gene_set", "dataset", "term_id").agg(F.count("*").alias("a"), F.array_sort(F.collect_list("gene")).alias("genes"))
    out = out.join(n_t, ["dataset", "term_id"]).join(n_s, "gene_set").join(F.broadcast(size))
    out = out.withColumns({"b": F.col("n_set") - F.col("a"), "c": F.col("n_term") - F.col("a"), "d": F.col("n_bg") - F.col("n_set") - F.col("n_term") + F.col("a")})
    out = out.withColumn("expected", F.col("n_set") * F.col("n_term") / F.col("n_bg")).withColumn("fold", F.col("a") / F.col("expected"))
    return hypergeometric_tail(out)


def benjamini_hochberg(rows: DataFrame, *family: str, p: str = "p_value", out: str = "q_value") -> DataFrame:
    """Adds the corrected value within each family.

    Families are sorted together by ranges, so one family, however large, is spread over tasks: ranks come from
    the counts of earlier ranges, the running minimum from the minima of later ones.
    """
    columns = rows.columns
    tied = rows.withColumn("_tie", F.xxhash64(*columns))  # equal p-values may fill many ranges
    ranked = stored(ranked_in(tied, [*family], [p, "_tie"]))
    least = minimum_from(ranked, [*family], F.col(p) * F.col("size") / F.col("rank"), out)
    return least.withColumn(out, F.least(F.lit(1.0), out)).select(*columns, out)


def consensus(results: DataFrame) -> DataFrame:
    """Per (dataset, term): union of genes and how many gene sets agree."""
    return results.groupBy("dataset", "term_id").agg(F.array_sort(F.collect_set("gene_set")).alias("gene_sets"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("genes")))).alias("genes"), F.min("p_value").alias("best_p"), (F.count_distinct("gene_set") > 1).alias("agree"))


def coverage(terms: DataFrame) -> DataFrame:
    """Per term: members, genes, whether it is complete."""
    return terms.groupBy("dataset", "term_id").agg(F.count("*").alias("rows"), F.count_distinct("gene").alias("genes"), F.bool_and(F.col("completeness") == "complete").alias("complete"))


def regulon_coherence(regulons: DataFrame, effects: DataFrame) -> DataFrame:
    """Per regulon: share of its targets that changed. regulons: (regulon, gene); effects: (gene, changed)."""
    return regulons.join(effects.select("gene", "changed"), "gene").groupBy("regulon").agg(F.count("*").alias("targets"), F.avg(F.col("changed").cast("double")).alias("coherence"))


def fraction(part: Column, total: Column) -> Column:
    return F.when(total > 0, part / total).otherwise(0.0)


TESTS = ("fisher_exact_greater", "hypergeometric_upper_tail")


def tested_values(rows: DataFrame, primary: str = TESTS[0], diagnostic: bool = True) -> DataFrame:
    """Adds primary_test, primary_p, diagnostic_test and diagnostic_p to tables a, b, c, d.

    The option alone selects the primary value, never the smaller of the two. Fisher's test sums the chances
    of all tables at least as extreme, the tail those of overlaps of at least a; for one table they agree.
    """
    if primary not in TESTS:
        raise ValueError(f"unsupported primary test: {primary}")
    other = TESTS[1 - TESTS.index(primary)]
    out = hypergeometric_tail(rows, "_tail")
    # the same tail, from the other side: of the genes outside the set, at least d are outside the term
    turned = rows.select(*[c for c in rows.columns if c not in "abcd"], F.col("d").alias("a"), F.col("c").alias("b"), F.col("b").alias("c"), F.col("a").alias("d"))
    keys = [c for c in rows.columns if c not in "abcd"]
    fisher = hypergeometric_tail(turned, "_fisher").select(*keys, "_fisher")
    out = out.join(fisher, keys)
    value = {TESTS[0]: F.col("_fisher"), TESTS[1]: F.col("_tail")}
    out = out.withColumn("primary_test", F.lit(primary)).withColumn("primary_p", value[primary])
    out = out.withColumn("diagnostic_test", F.lit(other if diagnostic else None).cast("string")).withColumn("diagnostic_p", value[other] if diagnostic else F.lit(None).cast("double"))
    return out.drop("_tail", "_fisher")


def memberships_of_hits(results: DataFrame) -> DataFrame:
    """Memberships known only from a provider's enrichment hits (provider, term_id, term_name, genes): never complete."""
    out = results.select(F.col("provider").alias("dataset"), "term_id", F.coalesce("term_name", "term_id").alias("term_name"), F.explode("genes").alias("gene")).withColumn("gene", F.upper("gene"))
    return out.withColumns({"member": F.concat(F.lit("gene:"), "gene"), "completeness": F.lit("submitted_hit_only"), "warning": F.lit("incomplete_membership_from_provider_enrichment_hits_only")})


def context_scores(memberships: DataFrame, changed: DataFrame) -> DataFrame:
    """Per module: coherence, the share of its members that changed (0 without members), and its sources, sorted.

    memberships: (module, gene, source); changed: (gene, changed), the tested background.
    """
    rows = memberships.select("module", "gene", "source").distinct().join(changed.select("gene", "changed"), "gene", "left")
    out = rows.groupBy("module").agg(F.count_if(F.col("changed").isNotNull()).alias("n_tested"), F.coalesce(F.avg(F.col("changed").cast("double")), F.lit(0.0)).alias("coherence"), F.array_sort(F.collect_set("source")).alias("sources"))
    return out


def membership_evidence(genes: DataFrame, memberships: DataFrame) -> DataFrame:
    """(gene, evidence): 1 for members of a signature or regulon, 0 for other genes."""
    member = memberships.select("gene").distinct().withColumn("m", F.lit(1.0))
    return genes.select("gene").distinct().join(member, "gene", "left").select("gene", F.coalesce("m", F.lit(0.0)).alias("evidence"))
