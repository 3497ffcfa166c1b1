"""Layout fixtures worked out by hand."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from quirelight.functions.text import is_alphabetic, normalize_text
from quirelight.operators import document as d

KNOWN = {"ann": 1, "bob": 1, "the": -5, "study": -5}


def kind(name):
    return KNOWN.get(name.lower(), 0)


def line(text, y=0.0, x=72.0, size=10.0, font=1, bold=False, flow=0, block=0, height=None):
    words, at = [], x
    parts = text.split(" ")
    for k, t in enumerate(parts):
        words.append(d.Word(at, y, at + 5 * len(t), y + (height or size), size, k + 1 < len(parts), y + size - 2, bold, font, t))
        at += 5 * len(t) + 5
    return d.Line(flow, block, words)


def linked(*lines):
    for a, b in zip(lines, lines[1:]):
        if (a.flow, a.block) == (b.flow, b.block):
            a.next = b
    return list(lines)


def names(text, refs=None):
    return [" ".join(n) for n in d.authors_of_line(line(text), refs)]


def test_authors_of_a_line():
    assert names("Ann Brown, Bob Lee and Cy Ray") == ["Ann Brown", "Bob Lee", "Cy Ray"]
    assert names("By Ann M. Brown, PhD und Jörg Groß-Lang") == ["Ann M Brown", "Jörg Groß-Lang"]
    assert names("Ann Brown, Single, Bob Lee") == ["Ann Brown"]
    assert names("Ann de Brown") == []
    assert names("Ann B") == []
    assert names("") == []
    refs = set()
    assert names("Ann Brown*, Bob Lee", refs) == ["Ann Brown", "Bob Lee"] and refs == {0}


def test_superscript_ends_an_author():
    base = line("Ann Brown Bob Lee")
    words = list(base.words)
    words[1] = words[1]._replace(space=False)
    words.insert(2, d.Word(0, 0, 1, 5, 6.0, True, 3.0, False, 1, "a"))
    refs = set()
    found = d.authors_of_line(d.Line(0, 0, words), refs)
    assert [" ".join(n) for n in found] == ["Ann Brown", "Bob Lee"] and 0 in refs


def test_combining_marks_are_composed():
    assert names("José Peña, Ann Brown")[0] == "José Peña"


def judged(text):
    return d.judged_authors(d.author_lines(d.LineBlock([line(text)], 10, 1, False, False)), kind)


def test_confidence_of_blocks():
    assert judged("Ann Brown")[0] == 1
    assert judged("Ann Brown, Bob Lee")[0] == 2
    assert judged("The Study") == (0, [])


def test_a_line_that_ends_in_skipped_characters_leaves_its_author_open():
    assert names("Ann Brown. ") == [] and names("Ann Brown ") == ["Ann Brown"]
    assert names("Bob Lee, Ann Brown~") == ["Bob Lee"]


def test_vowel_signs_belong_to_names():
    assert d.alphabetic_percent("\u0939\u093f") == 100  # a Devanagari letter with its vowel sign


def test_lines_after_the_last_possible_block_are_left_out():
    far = [line("aaaa", 100.0 * k) for k in range(d.MAX_BLOCKS)]
    close = [line("aaaa", 100.0 * (d.MAX_BLOCKS - 1) + 12 * k) for k in range(1, 6)]
    blocks = d.line_blocks(far + close)
    assert len(blocks) == d.MAX_BLOCKS and len(blocks[-1].lines) == 1
    assert len(d.line_blocks(far[:-2] + close)[-1].lines) == 5


def test_two_blocks_are_looked_up_together_up_to_six_lines():
    title = line("a title of one single line", 50, size=20)
    for count, together in ((5, True), (8, False)):
        body = [line("body of the page", 100 + 12 * k) for k in range(count)]
        keys = d.title_candidates([page(title, *body), page(line("end"))])
        assert (("atitleofonesingleline" + "bodyofthepage" * count) in keys) == together


def test_lookups_of_a_document_are_limited():
    lines = [line(f"a title of block {'abcdefghij'[k % 10]}{'abcdefghij'[k // 10 % 10]}{'abcdefghij'[k // 100]}", 400.0 + 100 * k) for k in range(300)]
    keys = d.title_candidates([page(*lines), page(*lines), page(line("end"))])
    assert len(keys) == d.MOST_LOOKUPS + 1 and len(set(keys)) == len(keys)


def test_candidates_are_measured_in_bytes():
    assert d.title_candidates([page(line("\u0436" * 8, 400)), page(line("end"))]) == ["\u0436" * 8]  # 16 bytes
    assert d.title_candidates([page(line("\u0436" * 151, 400)), page(line("end"))]) == []


def test_line_blocks_split_on_gap_case_face_and_size():
    one = linked(line("aaaa bbbb", 0), line("aaaa bbbb", 12), line("aaaa bbbb", 24))
    assert len(d.line_blocks(one)) == 1
    assert len(d.line_blocks([line("aaaa", 0), line("aaaa", 40)])) == 2
    assert len(d.line_blocks([line("aaaa", 0), line("AAAA", 22)])) == 2
    assert len(d.line_blocks([line("aaaa", 0), line("aaaa", 12, bold=True)])) == 2
    assert len(d.line_blocks([line("aaaa", 0), line("aaaa", 12, font=2)])) == 2
    assert len(d.line_blocks([line("aaaa", 0), line("aaaa", 12, size=11)])) == 1
    assert len(d.line_blocks([line("aaaa", 0), line("aaaa", 12, size=12)])) == 2


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["aa bb", "AA", "Ab 1"]), st.integers(0, 30), st.sampled_from([9.0, 10.0, 14.0]), st.integers(1, 2)), max_size=12))
def test_line_blocks_hold_each_line_once(rows):
    y, lines = 0, []
    for text, gap, size, font in rows:
        y += gap
        lines.append(line(text, y, size=size, font=font))
    blocks = d.line_blocks(lines)
    assert [x for b in blocks for x in b.lines] == lines


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_normalize_is_idempotent(text):
    once = normalize_text(text)
    assert normalize_text(once) == once and all(is_alphabetic(c) for c in once)


def page(*lines, width=612, height=792):
    return d.Page(width, height, linked(*lines))


def title_of(own):
    evidence = []
    return d.chosen_title(d.heads_of(own, evidence), evidence, kind)


def test_title_with_authors_below_and_above():
    body = [line("body text of the page that goes on and on " * 3, 300 + 14 * i, block=3) for i in range(10)]
    title = line("A Study of the Long and Printed Page", 100, size=20, block=0)
    found = title_of(page(title, line("Ann Brown, Bob Lee", 140, size=12, block=1), *body))
    assert found[0].strip() == "A Study of the Long and Printed Page" and found[1] == [("Ann", "Brown"), ("Bob", "Lee")]
    found = title_of(page(line("Ann Brown, Bob Lee", 60, size=12, block=1), title, *body))
    assert found[1] == [("Ann", "Brown"), ("Bob", "Lee")]
    assert title_of(page(title, *body)) is None


def test_abstracts():
    flow = [line("Abstract We saw it-", 0), line("self in the field", 12), line("and it is so.", 24)]
    assert d.abstract([page(*flow)]) == "We saw itself in the field and it is so."
    assert d.abstract([page(line("Abstract no stop here", 0))]) is None
    assert d.abstract([page(line("Abstract no stop", 0), line("here Keywords: a", 12))]) == "no stop here"
    assert d.abstract([page(line("Abstract right of its heading only.", 0))]) is None
    structured = [line("Background one two", 0), line("Methods three", 12), line("Conclusions four five.", 24)]
    assert d.abstract([page(*structured)]) == "Background one two\nMethods three\nConclusions four five."
    assert d.abstract([page(line("Background one.", 0))]) is None
    shifted = [structured[0], line("Methods three", 12, x=78.0), structured[2]]
    assert d.abstract([page(*shifted)]) is None
    assert d.abstract([page(line("Abstract " + "x" * 9000 + ".", 0))]) is None


def test_first_page_and_range():
    w = lambda *s: [d.Page(x, 792, [line("a", font=i % 2)]) for i, x in enumerate(s)]
    assert d.first_page(w(500, 612)) == 1
    assert d.first_page(w(500, 612, 612)) == 1
    assert d.first_page(w(500, 612, 612, 612)) == 1
    assert d.first_page(w(612, 612, 612, 612)) == 0
    fonts = [d.Page(612, 792, [line("a", font=f)]) for f in (9, 1, 1, 1)]
    assert d.first_page(fonts) == 1
    numbered = [d.Page(612, 792, [line("left body words", 300), line(str(7 + p // 2), 760, block=1)]) for p in range(4)]
    assert d.page_number(numbered) == (0, 7)
    assert d.page_range(numbered, 10) == (0, "7-16")
    assert d.page_range(numbered[:2], 10) == (0, "10")
    outside = [d.Page(612, 792, [line("left body words", 300), line(str(7 + p // 2), 690, block=1)]) for p in range(4)]
    assert d.page_number(outside) is None


def test_headers_repeat_within_two_pages():
    pages = [d.Page(612, 792, [line("Journal", 30, flow=1), line(f"text {p}", 300)]) for p in range(3)]
    assert d.headfoot_text(pages) == "\nJournal\n"
    assert d.headfoot_text([d.Page(612, 792, [line("Journal", 5)]) for _ in range(3)]) == ""


def test_wrong_kinds_count_as_zero():
    word = [1, 2, 3, 4, 10, True, 5, 0, 0, 1.5, 0, 0, "x", "Word"]
    lines = [[[word]], [[]]]
    pages = d.parse_pages([[612, 792, [[[[0, 0, 1, 1, lines]]]]], None])
    (only,) = pages[0].lines
    assert not only.words[0].space and not only.words[0].bold and only.words[0].font == 0
    assert pages[1].lines == [] and json.dumps(pages[1].width) == "0.0"
