"""Page numbers read the words once, and boxes of lines and pages count all words."""

from places import DATA

from quirelight import queries
from quirelight.operators import layout, pages


def test_words_are_read_once_and_not_dealt_out_again(spark, monkeypatch):
    plans = []
    kept = pages.checkpoint
    monkeypatch.setattr(pages, "checkpoint", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    last = queries.page_range(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert len(plans) == 1 and plans[0].count("Generate posexplode") == 1 and plans[0].count("Sort [") <= 3
    assert "posexplode" not in last and "documents.parquet" not in last
    words = plans[0][plans[0].index("HashAggregate(") : plans[0].index("Generate posexplode")]
    assert "Exchange" not in words and "ObjectHash" not in plans[0]


def _words(spark, rows):
    names = "page_no int, flow_no int, block_no int, line_no int, word_no int, x_min double, y_min double, x_max double, y_max double, text string"
    return spark.createDataFrame([(1, *r) for r in rows], f"doc_id long, {names}")


def test_boxes_of_lines_and_pages(spark):
    def page(p, number, tail_bottom=50.0):
        return [(p, 0, 0, 0, 0, 72.0, 40.0, 80.0, 50.0, number), (p, 0, 0, 0, 1, 100.0, 40.0, 140.0, tail_bottom, "tail"), (p, 0, 0, 0, 2, 150.0, 40.0, 160.0, 50.0, "0"), (p, 0, 0, 0, 3, 170.0, 40.0, 400.0, 50.0, "9" * 30)]

    heights = spark.createDataFrame([(1, p, 792.0) for p in range(6)], "doc_id long, page_no int, height double")

    def found(rows):
        w = _words(spark, rows)
        ours = [tuple(r) for r in pages.page_numbers(w, None, heights).collect()]
        assert ours == [tuple(r) for r in pages.page_numbers(w, layout.page_edges(w), heights).collect()]
        return ours

    assert found(page(0, "7") + page(2, "8")) == [(1, 0, 7)]
    # A word that is no number takes the line out of the margin; one to the left of it takes the number from the edge.
    assert found(page(0, "7", 300.0) + page(2, "8")) == []
    assert found(page(0, "7") + page(2, "8", 300.0)) == []
    assert found([*page(0, "7"), (0, 0, 1, 0, 0, 20.0, 400.0, 30.0, 410.0, "left")] + page(2, "8")) == []
    # The first in reading order counts, also of several numbers in a line.
    assert found(page(1, "3") + page(3, "4") + page(0, "7") + page(2, "8")) == [(1, 0, 7)]
