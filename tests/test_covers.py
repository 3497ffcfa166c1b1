from pyspark.sql import functions as F

from quirelight.functions import jstor
from quirelight.queries import QUERIES


def test_patterns_of_a_cover_stand_once_in_the_plan(spark):
    """Each field had its own copy of all patterns, which were tried again for it."""
    covers = spark.createDataFrame([("x\n\nOn Y\nSource: Z, Vol. 1, No. 2 (1999), pp. 1-9\nPublished by: P\nStable URL: http://www.jstor.org/stable/7\n",), ("none",), (None,)], "cover string")
    read = covers.select(jstor.parse_cover(F.col("cover")).alias("j")).select("j.*")
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == len(jstor.ARTICLE)
    rows = read.select("title", "container", "volume", "issue", "year", "pages", "publisher", "authors", "doi").collect()
    assert tuple(rows[0]) == ("On Y", "Z", "1", "2", "1999", "1-9", "P", None, "10.2307/7")
    assert all(v is None for row in rows[1:] for v in row)


def test_covers_are_dealt_out(spark, tmp_path):
    from places import DATA

    assert QUERIES["jstor_article"](spark, DATA).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
