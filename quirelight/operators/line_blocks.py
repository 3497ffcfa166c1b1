"""Typographic line blocks over the ``words`` table: an ordered fold over the lines of a page, in the JVM.

A page is one array of lines, a line one array of words; the fold carries the block that is open (its box and the typography
of its first line) and the places where blocks start, 500 at most. Pages that are read as such are folded where they lie; rows of
words are dealt out by page once, and lines and pages are both grouped where they lie. Results are those of ``document.line_blocks``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelight.functions.text import is_upper
from quirelight.operators.document import MAX_BLOCKS
from quirelight.operators.layout import LINE, PAGE

#: What the fold asks for of a word.
_WORD = ("word_no", "x_min", "y_min", "x_max", "y_max", "font_size", "space", "bold", "font", "text")


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often it is named there."""
    return F.transform(F.array(value), body)[0]


def _alike(values: Column) -> Column:
    return F.array_min(values) == F.array_max(values)


def _heaviest(words: Column, values: Column, field: str) -> Column:
    """Of ``values``, a field of ``words``, the one with most bytes, the first seen on a tie; 0 if there are no bytes. Mostly all are alike."""
    bytes_of = lambda v: F.aggregate(F.filter(words, lambda w: w[field] == v), F.lit(0), lambda n, w: n + F.octet_length(w["text"]))
    weighed = F.transform(F.array_distinct(values), lambda v, i: F.struct(bytes_of(v).alias("n"), (-i).alias("place"), v.alias("v")))
    best = _once(F.array_max(weighed), lambda best: F.when(best["n"] > 0, best["v"]).otherwise(F.lit(0)))
    alone = F.when(F.exists(words, lambda w: F.octet_length(w["text"]) > 0), values[0]).otherwise(F.lit(0))
    return F.when(_alike(values), alone).otherwise(best)


def _faces(words: Column) -> Column:
    return F.transform(words, lambda w: F.struct(w["font"].alias("font"), w["font_size"].alias("size"), (w["y_max"] - w["y_min"]).alias("height")))


def _upper(text: Column) -> Column:
    """``is_upper``; a text of ASCII alone without A-Z has no upper-case letter to count."""
    return F.when(text.rlike(r"[A-Z\x{80}-\x{10FFFF}]"), is_upper(text)).otherwise(False)


def _line(line: Column) -> Column:
    """A line's box, text, and the typography that the rule asks for."""
    words = line["words"]
    box = [f(words[c]).alias(c) for c, f in (("x_min", F.array_min), ("y_min", F.array_min), ("x_max", F.array_max), ("y_max", F.array_max))]
    text = F.array_join(F.transform(words, lambda w: F.concat(w["text"], F.when(w["space"], " ").otherwise(""))), "")
    return _once(F.struct(text.alias("text"), words["font_size"].alias("sizes"), words["font"].alias("fonts")), lambda own: F.struct(
        line["flow_no"].alias("flow_no"), line["block_no"].alias("block_no"), *box, own["text"].alias("text"),
        _heaviest(words, own["sizes"], "font_size").cast("double").alias("size"), _heaviest(words, own["fonts"], "font").alias("font"),
        words[0]["bold"].alias("bold"), F.when(_alike(own["fonts"]), own["fonts"][0]).alias("one_font"), _upper(own["text"]).alias("upper"),
    ))


def _continues(block: Column, line: Column, shares_face: Callable[[Column], Column]) -> Column:
    """Whether ``line`` belongs to the block before it. Whether it shares a face with the line before is asked last and seldom."""
    size, gap = block["size"], line["y_min"] - block["y_max"]
    even = line["next_gap"].isNull() | (F.abs(gap - line["next_gap"]) <= size / 3)
    case = (line["upper"] == block["upper"]) | ((gap < size) & shares_face(line["place"]))
    mixed = (line["font"] == block["font"]) | ((line["size"] == size) & (gap < size))
    font = F.coalesce(line["same_font"], mixed)
    most = F.when((size <= 12) & ~block["upper"], size).otherwise(2.5 * size)
    face = (line["bold"] == block["bold"]) & (F.abs(size - line["size"]) <= 1) & (gap < most)
    left, right = F.abs(line["x_min"] - block["x_min"]) < 2, F.abs(line["x_max"] - block["x_max"]) < 2
    inside = ((line["x_min"] >= block["x_min"]) | left) & ((line["x_max"] <= block["x_max"]) | right)
    around = ((line["x_min"] <= block["x_min"]) | left) & ((line["x_max"] >= block["x_max"]) | right)
    return even & case & font & face & (inside | around)


def _starts(lines: Column, shares_face: Callable[[Column], Column]) -> Column:
    """Places in ``lines`` (from 0) where blocks start."""

    def state(line: Column, starts: Column, last: Column | None = None) -> Column:
        grown = lambda c, f: (f(last[c], line[c]) if last is not None else line[c]).alias(c)
        kept = lambda c: (last if last is not None else line)[c].alias(c)
        return F.struct(*(grown(c, f) for c, f in (("x_min", F.least), ("x_max", F.greatest), ("y_max", F.greatest))), *(kept(c) for c in ("size", "font", "bold", "upper")), starts.alias("starts"))

    def step(block: Column, line: Column) -> Column:
        full = F.size(block["starts"]) == MAX_BLOCKS
        opened = state(line, F.concat(block["starts"], F.array(line["place"])))
        return F.when(full, block).when(_continues(block, line, shares_face), state(line, block["starts"], block)).otherwise(opened)

    first = lines[0]
    return F.aggregate(F.slice(lines, 2, F.size(lines)), state(first, F.array(first["place"])), step, lambda block: block["starts"])


def line_blocks(words: DataFrame) -> DataFrame:
    """``line_blocks_of_pages`` of rows of words."""
    word = F.array_sort(F.collect_list(F.struct(*_WORD))).alias("words")
    own = words.select(*LINE, *_WORD).repartition(*PAGE).groupBy(*LINE).agg(word)
    order = [c for c in LINE if c not in PAGE]
    return line_blocks_of_pages(own.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(*order, "words"))).alias("lines")))


def line_blocks_of_pages(pages: DataFrame) -> DataFrame:
    """``doc_id, page_no, lb_no``, box, ``font_size, font, bold, upper`` of the first line, ``n_lines`` and ``text`` (lines
    with a blank between them) of pages as ``requests.read_pages`` gives them. Lines after the one that opens the last possible
    block are left out, and pages without words have no row."""
    before, after = lambda i: F.get("l", i - 1), lambda i: F.get("l", i + 1)

    def told(line: Column, i: Column) -> Column:
        same_block = (after(i)["flow_no"] == line["flow_no"]) & (after(i)["block_no"] == line["block_no"])
        return F.struct(
            i.alias("place"), *(line[c].alias(c) for c in ("x_min", "y_min", "x_max", "y_max", "text", "size", "font", "bold", "upper")),
            F.when(same_block, after(i)["y_min"] - line["y_max"]).alias("next_gap"), (line["one_font"] == before(i)["one_font"]).alias("same_font"),
        )

    shares_face = lambda place: F.coalesce(F.arrays_overlap(_faces(F.get("lines", place)["words"]), _faces(F.get("lines", place - 1)["words"])), F.lit(False))
    lines = pages.where(F.size("lines") > 0).select(*PAGE, "lines", F.transform("lines", _line).alias("l"))
    folded = lines.select(*PAGE, "lines", F.transform("l", told).alias("l")).select(*PAGE, "l", _starts(F.col("l"), shares_face).alias("starts"))
    end = F.when(F.size("starts") == MAX_BLOCKS, F.element_at("starts", -1) + 1).otherwise(F.size("l"))
    placed = folded.withColumn("ends", F.concat(F.slice("starts", 2, MAX_BLOCKS), F.array(end)))
    own = F.transform(F.arrays_zip("starts", "ends"), lambda at: F.slice("l", at["starts"] + 1, at["ends"] - at["starts"]))
    each = placed.select(*PAGE, F.posexplode(own).alias("lb_no", "own"))
    first = F.col("own")[0]
    return each.select(
        *PAGE, "lb_no", *(f(F.col("own")[c]).alias(c) for c, f in (("x_min", F.array_min), ("y_min", F.array_min), ("x_max", F.array_max), ("y_max", F.array_max))),
        first["size"].alias("font_size"), first["font"].alias("font"), first["bold"].alias("bold"), first["upper"].alias("upper"),
        F.size("own").alias("n_lines"), F.array_join(F.col("own")["text"], " ").alias("text"),
    )
