"""URL filters by association rules, in DataFrame and SQL functions with Spark's FP-growth.

Labelled URLs become baskets of tokens, with one more item for the bad label. Tokens that occur in the same
labelled URLs are one item, and tokens of all of them none, as both would only multiply the combinations
without changing one's support or confidence. FP-growth finds the combinations that are frequent enough, rules
whose consequent is the bad label are pruned by confidence and support, and an inverted index (each rule under
its rarest item) finds the rules whose items a URL has. Given host and path rules come first: they decide
wherever one fits.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import written

#: (verdict, host, path): a rule fits its host and all subdomains, if the path starts with the rule's. The operator's
#: own default; its verdicts on net aren't the contract's, which op2 passes.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("allow", "example.net", "/de/8"), ("block", "org", "/es/"))
#: The rules of op2's contract.
CONTRACT = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
BAD = "!bad"


def host_of(url: str) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: str) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(host: str, path: str) -> Column:
    """Distinct tokens of a URL: labels of the host and their parts at hyphens, words of the path; no numbers."""
    labels = F.split(F.col(host), r"\.")
    parts = F.flatten(F.transform(labels, lambda x: F.split(x, "-")))
    named = F.transform(F.array_distinct(F.concat(labels, parts)), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.split(F.lower(F.col(path)), "[^a-z]+"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_remove(F.array_remove(F.array_distinct(F.concat(named, words)), "h:"), "p:")


def fitting_rule(host: str, path: str, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    entries = ", ".join(f"struct({len(h) + len(p)} as size, '{h}{p}' as rule, '{v}' as verdict, '{h}' as host, '{p}' as path)" for v, h, p in rules)
    fits = f"filter(array({entries}), r -> (`{host}` = r.host or endswith(`{host}`, '.' || r.host)) and startswith(`{path}`, r.path))"
    return F.expr(f"array_max({fits})") if rules else F.lit(None).cast("struct<rule: string, verdict: string>")


def token_classes(baskets: DataFrame, least: int) -> DataFrame:
    """(token, item) of the tokens that at least `least` baskets (id, tokens) have, but for those in all of them.

    item: the smallest of the tokens that occur in the same baskets, told by count and two sums of hashes of
    their ids. At most (tokens a basket) / (least / baskets) rows, however large the vocabulary.
    """
    total = baskets.count()
    seen = baskets.select("id", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    seen = written(seen.where(f"n >= {least} and n < {total}"))
    return written(seen.join(seen.groupBy("n", "x", "y").agg(F.min("token").alias("item")), ["n", "x", "y"]).select("token", "item"))


def with_items(rows: DataFrame, classes: DataFrame, *keys: str) -> DataFrame:
    """(keys, items): the distinct items of the tokens of each row; rows without any are left out."""
    # classes is small whatever the input: see token_classes
    return rows.select(*keys, F.explode("tokens").alias("token")).join(F.broadcast(classes), "token").groupBy(*keys).agg(F.array_sort(F.collect_set("item")).alias("items"))


def mine_rules(baskets: DataFrame, least: int, min_confidence: float) -> tuple[DataFrame, DataFrame]:
    """((rule_id, key, tokens, confidence, support) of the rules items -> bad label, the items' token classes).

    baskets: (id, tokens, bad). `tokens` are items, `key` is the one that fewest labelled URLs have. A rule must
    hold in `least` bad URLs. It is left out if a rule on fewer of its items is as confident.
    """
    classes, total = token_classes(baskets, least), baskets.count()
    found = baskets.select("id", "bad").join(with_items(baskets, classes, "id"), "id", "left").select(F.coalesce("items", F.array().cast("array<string>")).alias("items"), "bad")
    items = found.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, (least - 0.5) / total), minConfidence=min_confidence).fit(items)
    found = model.associationRules.where(F.expr(f"size(consequent) = 1 and consequent[0] = '{BAD}'"))
    found = written(found.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support").withColumn("rule_id", F.xxhash64("tokens")))
    few = found.select(F.col("rule_id").alias("few_id"), F.col("tokens").alias("few"), F.col("confidence").alias("few_confidence"))
    shared = found.select("rule_id", "tokens", "confidence", F.explode("tokens").alias("token")).join(few.withColumn("token", F.col("few")[0]), "token")
    weak = shared.where("few_id <> rule_id and size(array_except(few, tokens)) = 0 and few_confidence >= confidence").select("rule_id").distinct()
    kept = found.join(weak, "rule_id", "left_anti")
    counts = model.freqItemsets.where("size(items) = 1").select(F.col("items")[0].alias("token"), "freq")
    rarest = kept.select("rule_id", F.explode("tokens").alias("token")).join(counts, "token").groupBy("rule_id").agg(F.min_by("token", F.struct("freq", "token")).alias("key"))
    return written(kept.join(rarest, "rule_id")), classes


def judge_urls(pages: DataFrame, labels: DataFrame, min_support: float = 0.005, min_confidence: float = 0.6, min_urls: int = 20, rules=RULES) -> DataFrame:
    """One row per row of pages: page_id, url, host, path, rule, verdict, confidence.

    labels (doc_id, quality): a URL whose page_id has the quality 0 is bad. Null urls and urls without ://
    have an empty host and path, fit nothing and are allowed. Ids without or with a null label teach
    nothing; of several labels the smallest counts. A combination must occur in `min_support` of the labelled
    URLs and in `min_urls` of them that are bad. Without bad labels only the given rules decide. Repeated rows
    are judged again; other columns are ignored; an empty table gives an empty result.
    """
    rows = pages.select("page_id", "url").withColumn("host", host_of("url")).withColumn("path", path_of("url"))
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("page_id")).agg((F.min("quality") == 0).alias("bad"))
    baskets = written(rows.where("host <> ''").join(marks, "page_id").select(tokens("host", "path").alias("tokens"), "bad").withColumn("id", F.monotonically_increasing_id()))
    out = rows.withColumn("fit", fitting_rule("host", "path", rules))
    if baskets.where("bad").limit(1).count():
        mined_rules, classes = mine_rules(baskets, max(min_urls, math.ceil(min_support * baskets.count())), min_confidence)
        # rules depend on host and path alone: judged once for each pair, then brought back
        pairs = rows.where("host <> ''").select("host", "path").distinct().withColumn("tokens", tokens("host", "path"))
        index = mined_rules.select("key", F.col("tokens").alias("rule_items"), "confidence")
        met = with_items(pairs, classes, "host", "path").withColumn("key", F.explode("items")).join(index, "key").where("size(array_except(rule_items, items)) = 0")
        bad = met.groupBy("host", "path").agg(F.max("confidence").alias("confidence"))
        out = out.join(bad, ["host", "path"], "left")
    else:
        out = out.withColumn("confidence", F.lit(None).cast("double"))
    mined = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "url", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), mined).alias("verdict"), "confidence")


def op2(spark, sf_dir: str) -> DataFrame:
    out = judge_urls(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels")), rules=CONTRACT)
    return out.select("page_id", "host", "path", "rule", "verdict", "confidence")
