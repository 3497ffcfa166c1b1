"""The fold over the words table gives the line blocks of the rule on lines, on random pages and on whole documents."""

import random

from places import DATA

from quirelight import recognition_queries as rq
from quirelight.carriers import composed, table
from quirelight.operators import document
from quirelight.operators.line_blocks import line_blocks
from quirelight.plans.recognize import load
from quirelight.sources import requests

SCHEMA = "doc_id long, page_no int, flow_no int, block_no int, line_no int, word_no int, x_min double, y_min double, x_max double, y_max double, font_size double, space boolean, baseline double, bold boolean, font int, text string"


def _page(dice, n_lines, wild):
    """Words of a page: mostly the typography of the line before, at times another."""
    rows, y, flow, block, line = [], 50.0, 0, 0, 0
    size, font, bold, upper, left = 10.0, 1, False, False, 72.0
    for _ in range(n_lines):
        if dice.random() < wild:
            kind = dice.randrange(7)
            size = dice.choice([10.0, 10.5, 11.0, 12.0, 13.0, 20.0]) if kind == 0 else size
            font = dice.randrange(3) if kind == 1 else font
            bold = not bold if kind == 2 else bold
            upper = not upper if kind == 3 else upper
            left = dice.choice([72.0, 73.0, 74.0, 90.0]) if kind == 4 else left
            if kind == 5:
                block, line = block + 1, 0
            if kind == 6:
                flow, block, line = flow + 1, 0, 0
        y += dice.choice([size, size + 2, size + 2, size + 2, size + 5, 2.6 * size + size, -30.0])
        x = left
        for w in range(dice.randint(1, 4)):
            text = dice.choice(["word", "Ab", "ünder", "x", "", "ǅ", "12"])
            own_size, own_font = (size, font) if dice.random() < 0.85 else (dice.choice([size, 8.0]), dice.randrange(3))
            rows.append((flow, block, line, w, x, y, x + 30.0, y + own_size, own_size, dice.random() < 0.8, y, bold, own_font, text.upper() if upper else text))
            x += 35.0
        line += 1
    return rows


def _expected(rows):
    lines, last = [], None
    by_line = {}
    for flow, block, line, _, *word in rows:
        by_line.setdefault((flow, block, line), []).append(document.Word(*word))
    for key in sorted(by_line):
        own = document.Line(key[0], key[1], by_line[key])
        if last and (last.flow, last.block) == (own.flow, own.block):
            last.next = own
        lines.append(own)
        last = own
    return document.line_blocks(lines)


def _told(b):
    return (b.x_min, b.y_min, b.x_max, b.y_max, b.size, b.font, b.bold, b.upper, len(b.lines), b.text())


def test_random_pages(spark):
    dice = random.Random(7)
    pages = [(i, i % 3, _page(dice, dice.choice([1, 2, 5, 20, 60]), dice.choice([0.1, 0.5]))) for i in range(150)]
    pages.append((1000, 0, _page(dice, 900, 1.0)))  # more blocks than are kept
    words = spark.createDataFrame([(doc, page, *row) for doc, page, rows in pages for row in rows], SCHEMA).repartition(5)
    found = {}
    for r in sorted(line_blocks(words).collect()):
        found.setdefault((r.doc_id, r.page_no), []).append(tuple(r)[3:])
    expected = {(doc, page): [_told(b) for b in _expected(rows)] for doc, page, rows in pages}
    assert len(expected[1000, 0]) == document.MAX_BLOCKS and sum(len(b) > 1 and b[8] > 1 for v in expected.values() for b in v) > 100
    assert {k: [(*b[:4], float(b[4]), *b[5:]) for b in v] for k, v in expected.items()} == found


def test_whole_documents(spark):
    docs = table(spark, DATA, "documents").select("doc_id", "text", "source").where("doc_id % 17 <> 3")
    sent = composed(docs, rq._full_request, "text", "source").persist()
    expected = {(r.doc_id, p): [_told(b) for b in page.blocks] for r in sent.collect() for p, page in enumerate(document.parse_pages(load(r.body)[1])) if page.lines}
    found = {}
    for r in sorted(line_blocks(requests.decode_words(requests.parse(sent))).collect()):
        found.setdefault((r.doc_id, r.page_no), []).append(tuple(r)[3:])
    assert expected == found


def test_one_exchange_and_no_python(spark):
    words = spark.createDataFrame([], SCHEMA)
    found = line_blocks(words)
    assert found.count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.find("Initial Plan") :] if "Initial Plan" in plan else plan
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "Arrow" not in plan
