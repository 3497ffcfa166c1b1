"""What the plan computes in one pass agrees with the operators over the words table, on all documents."""

import pytest
from places import DATA
from pyspark.sql import functions as F

from quirelight import recognition_queries as rq
from quirelight.carriers import composed, table
from quirelight.functions import text
from quirelight.operators import document, layout, pages
from quirelight.plans.recognize import load
from quirelight.sources import requests


@pytest.fixture(scope="module")
def decoded(spark):
    """Requests with heads, headers and page numbers: as pages in Python, and as tables."""
    docs = table(spark, DATA, "documents").select("doc_id", "text", "source").where("doc_id % 17 <> 3")
    sent = composed(docs, rq._full_request, "text", "source").persist()
    own = {r.doc_id: document.parse_pages(load(r.body)[1]) for r in sent.collect()}
    parsed = requests.parse(sent)
    words = requests.decode_words(parsed).persist()
    sheets = requests.decode_pages(parsed).select("doc_id", "page_no", "width", "height").persist()
    return own, words, sheets


def test_texts_agree(decoded):
    own, words, _ = decoded
    totals = words.select("doc_id").distinct().withColumn("total_pages", F.lit(9))
    found = dict(layout.doc_text(layout.text_pages(words, totals)).collect())
    assert found == {k: t for k, v in own.items() if (t := document.document_text(v, 9))}


def test_repeated_headers_agree(decoded):
    own, words, sheets = decoded
    found = dict(pages.headfoot_text(pages.headfoot_pairs(words, sheets)).collect())
    assert found == {k: t for k, v in own.items() if (t := document.headfoot_text(v))}


def test_page_numbers_and_first_pages_agree(decoded):
    own, words, sheets = decoded
    found = {r.doc_id: (r.page_no, r.number) for r in pages.page_numbers(words, layout.page_edges(words), sheets).collect()}
    assert found and found == {k: n for k, v in own.items() if (n := document.page_number(v))}
    by_width = dict(pages.first_page_by_width(sheets).collect())
    by_fonts = dict(pages.first_page_by_fonts(words).collect())
    assert {k: by_width[k] or by_fonts[k] for k in own} == {k: document.first_page(v) for k, v in own.items()}


def test_font_thresholds_agree(decoded):
    own, words, _ = decoded
    found = {(r.doc_id, r.page_no): r.threshold for r in layout.font_threshold(words).collect()}
    assert found == {(k, p): document.font_threshold(page.lines) for k, v in own.items() for p, page in enumerate(v) if page.lines}


def test_block_rules_agree(spark, decoded):
    own, _, _ = decoded
    rows = [(k, p, n, b.x_min, b.y_min, b.x_max, b.y_max, float(b.size), b.text()) for k, v in own.items() for p, page in enumerate(v) for n, b in enumerate(page.blocks)]
    blocks = spark.createDataFrame(rows, "doc_id long, page_no int, lb_no int, x_min double, y_min double, x_max double, y_max double, font_size double, text string")
    percent = text.alphabetic_percent(F.col("text"))
    found = {(r.doc_id, r.page_no, r.lb_no): (r.separated, r.skip, r.percent or 0, r.simple, r.kind) for r in layout.skipped(layout.visually_separated(blocks)).select("*", percent.alias("percent"), text.simple_abstract_heading(F.col("text")).alias("simple"), text.structured_abstract_heading(F.col("text")).alias("kind")).collect()}
    for k, v in own.items():
        for p, page in enumerate(v):
            for n, b in enumerate(page.blocks):
                t = b.text()
                assert found[k, p, n] == (document.separated(page.blocks, n), document.shadowed(page.blocks, n), document.alphabetic_percent(t), document._simple_heading(t), document._structured_heading(t))


def _odd_bodies():
    """Bodies on which JSON readers disagree: the rule is the same for tables and for the plan."""
    word = [0, 0, 9, 10, 10, 1, 8, 0, 0, 0, 0, 0, 3, "word"]

    def body(total="9", meta='{"Title": "A title"}', word=word, pages=None, extra=""):
        import json

        page = json.dumps(pages if pages is not None else [[612, 792, [[[[0, 0, 9, 10, [[[word]]]]]]]]])
        return f'{{"metadata": {meta}, "totalPages": {total}, "pages": {page}{extra}}}'

    changed = lambda **at: [at.get(f"w{i}", v) for i, v in enumerate(word)]
    return [
        body(), body() + " \n", body() + "x", body() + " {}", body() + "}", body() + "]}", body() + ', "end": true', body() + ', "end": true, "x": {}', " " + body(), body(extra=', "totalPages": 4'), body(extra=', "pages": []'), body("3.0"), body('"3"'), body("true"), body("null"),
        body(meta='{"Title": 7}'), body(meta="null"), body(meta="7"), body(meta='{"Title": "a", "Title": "b"}'), body(meta='{"Title": "\\ud83d\\ude00"}'), body(meta='{"Title": "\\ud83d"}'), body(meta='{"Title": "NaN }{"}'),
        body(word=changed(w13=5)), body(word=changed(w0="12")), body(word=changed(w12=1.7)), body(word=changed(w5=True)), body(word=changed(w4=None)), body(word=changed(w0=10**20)), body(word=changed(w0=1e20)),
        body(word=[1, 2, 3]), body(word="x"), body(word=changed(w13="a\\n\"b")), body(pages={"0": 1}), body(pages=[7, [1], [1, 2, 3], ["5", None, []]]), body(pages=[]), body().replace("9", "NaN"), body("1e2"), body("-0"), "", "[]", "{}", "null", None,
    ]


def test_odd_bodies_agree(spark):
    from quirelight.plans.recognize import _facts

    sent = spark.createDataFrame(list(enumerate(_odd_bodies())), "doc_id long, body string")
    parsed = requests.parse(sent)
    heads = {r.doc_id: r for r in parsed.drop("pages").collect()}
    sheets = {(r.doc_id, r.page_no): (r.width, r.height) for r in requests.decode_pages(parsed).collect()}
    rows = {}
    for r in requests.decode_words(parsed).collect():
        rows.setdefault((r.doc_id, r.page_no), []).append((r.x_min, r.y_min, r.x_max, r.y_max, r.font_size, r.space, r.baseline, r.bold, r.font, r.text))
    for i, body in enumerate(_odd_bodies()):
        found, raw = load(body)
        facts = _facts(i, body)
        assert heads[i].malformed == facts["malformed"], body
        assert heads[i].complete == (found.get("metadata") is not None and found.get("totalPages") is not None), body
        if raw and heads[i].complete:
            assert heads[i].total_pages == facts["total_pages"] and heads[i].meta_title == facts["meta_title"], body
        own = document.parse_pages(raw)
        assert {p: (x.width, x.height) for p, x in enumerate(own)} == {p: v for (k, p), v in sheets.items() if k == i}, body
        assert {p: [tuple(w) for line in x.lines for w in line.words] for p, x in enumerate(own) if x.lines} == {p: v for (k, p), v in rows.items() if k == i}, body


def test_bodies_are_parsed_once(spark):
    """Filters and selections on decoded values take no copies of the parser (one for all bodies, two for those that the first refuses)."""
    words = requests.decode_words(requests.parse(spark.createDataFrame([], "doc_id long, body string")))
    assert words._jdf.queryExecution().optimizedPlan().toString().lower().count("parse_json") <= 3
