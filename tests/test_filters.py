"""Filters miss no key, let few others through, and keep rows out of exchanges."""

import re

import pytest
from pyspark.sql import functions as F

from quirelight.operators import filters, lookup


@pytest.mark.parametrize("most_bytes", [1 << 20, 256])
def test_one_filter_in_python_and_in_the_jvm(spark, most_bytes):
    keys = spark.range(5000).select(F.concat(F.lit("título número "), F.col("id").cast("string")).alias("k")).unionAll(spark.createDataFrame([(None,), ("",)], "k string"))
    held = filters.key_filter(keys, "k", most_bytes)
    assert len(held.body) <= most_bytes
    assert all(held.may_have(r.k) for r in keys.collect() if r.k is not None)
    others = [f"another {i}" for i in range(5000)]
    passed = sum(map(held.may_have, others))
    assert passed < 150 if most_bytes > 256 else passed <= 5000
    # The joined form misses none either.
    rows = spark.createDataFrame([(t,) for t in others], "t string").unionAll(keys.select("k"))
    found = {r.t for r in filters.likely_in(rows, "t", keys, "k", 8 * most_bytes).collect()}
    assert found >= {r.k for r in keys.collect() if r.k is not None} and (most_bytes <= 256 or len(found) < 5400)


def test_an_empty_filter_has_nothing(spark):
    none = spark.createDataFrame([], "k string")
    assert not filters.key_filter(none, "k").may_have("x")
    assert filters.likely_in(spark.range(9), "id", spark.range(0), "id").count() == 0


def test_only_texts_with_hits_are_exchanged(spark):
    texts = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat(F.lit("xbrownx"), F.repeat(F.lit("y"), 50)).alias("norm_text"))
    titles = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit(0).alias("cand"), F.concat(F.lit("title"), F.col("id").cast("string")).alias("title_key"))
    registry = spark.range(0, 20000, 100).select(F.concat(F.lit("title"), F.col("id").cast("string")).alias("title_key"), F.lit("brown").alias("author1_key"), F.lit(None).cast("string").alias("author2_key"), F.concat(F.lit("10.1/"), "id").alias("doi"), F.col("id").alias("ord"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = lookup.lookup_titles(titles, registry, texts)
        assert found.count() == 200
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Below the exchange of texts stands the broadcast filter.
    assert "BroadcastHashJoin" in plan and not re.search("NestedLoop|Cartesian", plan)
    kept = filters.likely_in(texts, "doc_id", registry, "ord").count()
    assert 200 <= kept < 600
