"""op2's own rules against its contract's list, word by word."""

import pytest

pytest.importorskip("pyspark.ml")

from strandlake.llm import url_rules  # noqa: E402


def test_verdicts_of_the_contract(spark, tmp_path):
    urls = ["http://a.com/en/1", "http://x.example.com/en/70", "http://x.net/de/8", "http://x.net/de/1", "http://b.example.net/de/80", "http://example.net/de/7", "http://h.org/es/", "http://h.net/en/"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = [(r.rule, r.verdict) for r in url_rules.op2(spark, str(tmp_path)).orderBy("page_id").collect()]
    assert got == [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("org/es/", "block"), (None, "allow")]
