"""Words are counted before they are normalised, and once."""

from places import DATA

from quirelight import queries


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_counted_before_they_are_normalised(spark):
    plan = plan_of(queries.word_inputs(spark, DATA))
    # Operators are listed from the last to the first.
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("HashAggregate(keys=[w#")
    assert "pythonUDF" not in plan[plan.index("HashAggregate(keys=[w#") :]


def test_documents_are_counted_once(spark):
    assert "documents.parquet" not in plan_of(queries.word_type(spark, DATA))


def test_words_without_letters_and_missing_texts_have_no_key(spark, tmp_path):
    spark.createDataFrame([(1, "Ab  7\nab Ñu\n\n-- ñu"), (2, None), (3, ""), (4, "Longerword Ab")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(map(tuple, queries.word_type(spark, str(tmp_path)).collect()))
    assert found == [("ab", 2), ("longerword", 1), ("nu", 0)]
