"""Requests as they are composed, and how documents are dealt out."""

import json

import pytest

from quirelight import carriers
from quirelight.operators import document
from quirelight.operators.rows import dealt

STYLES = [{}, {"plain": True, "down": 200.0}, {"pitch": 24, "extra": 0, "style": lambda b: (10.0 + b % 2, 5 + b, b % 2 > 0)}]


@pytest.mark.parametrize("kw", STYLES)
def test_json_of_a_layout(kw):
    tokens = [("ä\"\\" * (i % 7) or "plain") + str(i) for i in range(463)]
    pages = carriers.layout_pages(2, tokens, **kw)
    written = carriers.layout_json(2, tokens, **kw)
    assert [[json.loads(b) for b in page] for page in written] == json.loads(json.dumps(pages))
    assert carriers.request([[blocks] for blocks in written], "T") == carriers.request([[blocks] for blocks in pages], "T")
    assert carriers.layout_json(0, []) == carriers.layout_pages(0, [])


def test_a_word_moved():
    tokens = [f"w{i}" for i in range(60)]
    pages = carriers.layout_pages(0, tokens)
    pages[0][0][4][2][0][0][0] += 5
    assert [[json.loads(b) for b in page] for page in carriers.layout_json(0, tokens, moved={20: 5.0})] == json.loads(json.dumps(pages))


def test_lines_of_usual_and_odd_words_agree():
    """One odd value makes a line leave the path of columns; the other words stay as they are."""
    usual = [72.0, 60.0, 92.0, 70.0, 10.0, 1, 68.0, 0, 0, 1, 0, 0, 3, "Straße"]
    plain = document._line(0, 0, [usual, usual])
    assert plain.words == [document._word(usual)] * 2 and plain.text == "Straße Straße " and plain.all_bytes == 16
    for i, value in ((0, 72), (0, "x"), (5, True), (5, 10**15), (9, None), (12, -(10**16)), (12, 3.0), (13, None), (13, 7)):
        odd = [value if k == i else v for k, v in enumerate(usual)]
        assert document._line(0, 0, [usual, odd]).words == [document._word(usual), document._word(odd)]
    assert document._line(0, 0, [usual, usual[:5], None]).words == [document._word(usual), document._word(usual[:5]), document._word(None)]


def test_parts_grow_with_the_table(spark):
    few = dealt(spark.range(1000), "id").rdd.getNumPartitions()
    many = dealt(spark.range(1000), "id", part_bytes=100).rdd.getNumPartitions()
    assert few == spark.sparkContext.defaultParallelism and many == 80


def test_tables_of_unknown_size_are_dealt_out_by_spark(spark):
    rows = spark.createDataFrame(spark.sparkContext.parallelize([(i,) for i in range(10)]), "id long")
    assert dealt(rows, "id").count() == 10


@pytest.mark.parametrize("name, most", [("lines_bbox", 1), ("line_upper", 1), ("block_text", 1), ("largest_block", 1)])
def test_words_are_not_shuffled(spark, name, most):
    """Texts are dealt out whole; lines, blocks and pages are grouped where their words lie."""
    from places import DATA

    from quirelight.queries import QUERIES

    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == most and "Join" not in plan


def test_ranges_of_dois_grow_with_the_tables(spark, monkeypatch):
    """Adaptive execution would join ranges to parts of 64 MB; a given number stays."""
    from places import DATA

    from quirelight.operators import lookup
    from quirelight.queries import QUERIES

    monkeypatch.setattr(lookup, "parts_of", lambda df: 37)
    plan = QUERIES["doi_longest_prefix"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert ", 37), REPARTITION_BY_NUM" in plan
