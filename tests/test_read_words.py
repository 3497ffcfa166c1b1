"""Words and pages read in one Arrow pass are those of the decoded variants, on documents and on odd bodies, and queries read no variants."""

import json
import random

import pytest
from places import DATA
from test_agreement import _odd_bodies

from quirelight import recognition_queries as rq
from quirelight.carriers import composed, layout_json, layout_pages, pages_json, table
from quirelight.operators import document
from quirelight.operators import line_blocks as folds
from quirelight.plans.recognize import load
from quirelight.registered import QUERIES
from quirelight.sources import requests

PLACES = (0, 1, 2, 3, 4, 5, 6, 9, 12, 13)


def _wild_bodies(*more):
    """Bodies of several flows, blocks and lines, in which some words are short, long or hold values of all kinds."""
    dice = random.Random(11)
    odd = [0, 1, -1, 0.0, 1.0, 2.5, 1e300, 10**15, 10**15 - 1, 2**31, 2**31 - 1, -(2**31), 10**30, True, False, None, "", "7", "ü", [], [1], {}, {"a": 1}, *more]

    def word(kinds):
        own = [dice.choice([10.0, 11.5, 12]) for _ in range(14)]
        own[5], own[9], own[12], own[13] = dice.randrange(2), dice.randrange(2), dice.randrange(3), dice.choice(["Ab", "é", "W", "", "\n"])
        for _ in range(dice.choice(kinds)):
            own[dice.choice(PLACES)] = dice.choice(odd)
        return dice.choice([own] * 8 + [own[: dice.randrange(14)], [*own, 5], dice.choice(odd)]) if kinds != [0] else own

    def part(kinds, most, of):
        return [of() if dice.random() < 0.95 else dice.choice(odd) for _ in range(dice.randrange(most))]

    for n in range(60):
        kinds = [[0], [0, 0, 0, 1], [0, 1, 3]][n % 3]
        line = lambda: [part([0], 6, lambda: word(kinds))]  # noqa: B023, E731
        block = lambda: [0, 0, 9, 9, part(kinds, 5, line)]  # noqa: B023, E731
        pages = part(kinds, 8, lambda: [612.0, dice.choice([792, *odd]), part(kinds, 3, lambda: [part(kinds, 4, block)])])
        yield json.dumps({"metadata": {}, "totalPages": 9, "pages": pages})


@pytest.fixture(scope="module")
def sent(spark):
    docs = table(spark, DATA, "documents").select("doc_id", "text", "source")
    bodies = [*_odd_bodies(), *_wild_bodies()]
    more = spark.createDataFrame([*enumerate(bodies, 10**6), (None, bodies[0])], "doc_id long, body string")
    return composed(docs, rq._full_request, "text", "source").unionByName(more).persist()


def _told(rows):
    return sorted(map(repr, map(tuple, rows.collect())))


@pytest.mark.parametrize("most", [5, None])
def test_words_are_those_of_variants(spark, sent, most):
    found = requests.read_words(sent, most)
    expected = requests.decode_words(requests.parse(sent), most)
    assert found.columns == expected.columns and [f.dataType for f in found.schema] == [f.dataType for f in expected.schema]
    assert len(rows := _told(found)) > 50000 and rows == _told(expected)


def test_words_are_those_of_the_plan(spark):
    """Also with values that variants hold as decimals (-0.0 has no sign there, and 1e15 is whole)."""
    bodies = [*_wild_bodies(-0.0, 1e15, -1e15, 0.1, 10**15 + 1), *_odd_bodies()]
    found = {}
    for r in requests.read_words(spark.createDataFrame(list(enumerate(bodies)), "doc_id long, body string")).collect():
        found.setdefault((r.doc_id, r.page_no), []).append((r.x_min, r.y_min, r.x_max, r.y_max, r.font_size, r.space, r.baseline, r.bold, r.font, r.text))
    pages = {(i, p): page.lines for i, body in enumerate(bodies) for p, page in enumerate(document.parse_pages(load(body)[1]))}
    told = {k: [tuple(w._replace(font=w.font if abs(w.font) < 1 << 31 else 0)) for line in lines for w in line.words] for k, lines in pages.items() if lines}
    assert len(told) > 100 and repr(sorted(found.items())) == repr(sorted(told.items()))


def test_pages_hold_the_same_words(spark, sent):
    pages = requests.read_pages(sent)
    heads = ["doc_id", "page_no", "width", "height"]
    assert _told(pages.select(*heads)) == _told(requests.decode_pages(requests.parse(sent)).select(*heads))
    words = pages.selectExpr("doc_id", "page_no", "inline(lines)").selectExpr("doc_id", "page_no", "flow_no", "block_no", "line_no", "inline(words)")
    assert _told(words) == _told(requests.read_words(sent))


def test_pages_and_rows_of_words_fold_alike(spark, sent):
    found = folds.line_blocks_of_pages(requests.read_pages(sent))
    expected = folds.line_blocks(requests.read_words(sent))
    assert found.columns == expected.columns and _told(found) == _told(expected)


def _plan(spark, name):
    return QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString().lower()


def test_the_query_reads_no_variants(spark):
    plan = _plan(spark, "words")
    assert "variant" not in plan and "parse_json" not in plan and plan.count("exchange") == 1  # documents are dealt out


def test_pages_fold_without_variants_and_are_not_dealt_out(spark):
    plan = _plan(spark, "line_blocks_fold")
    assert "variant" not in plan and "parse_json" not in plan and plan.count("exchange") == 1  # that of the documents


def test_words_with_blanks_and_marks_are_composed_alike():
    dice = random.Random(5)
    for blank in (" ", "_"):
        tokens = ["".join(dice.choices(["a", '"', "\\", "u0020", blank, "\x1f", "é", "漢", "\U0001f600"], k=dice.randrange(1, 5))) for _ in range(431)]
        assert json.loads(pages_json([[b] for b in layout_json(2, tokens)])) == json.loads(pages_json([[b] for b in layout_pages(2, tokens)]))


def test_numbers_of_a_body_are_told_by_their_text():
    assert repr(requests.load('{"a": [0, -0, 0.0, -0.0, 1, 1.0, 1e0, 1E0, 1, 1.0, 123456789012345678901]}')["a"]) == "[0, 0, 0.0, -0.0, 1, 1.0, 1.0, 1.0, 1, 1.0, 123456789012345678901]"
