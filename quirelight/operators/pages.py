"""Joins between the pages of a document: running headers, page numbers, cover pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelight.functions import identifiers
from quirelight.operators import layout
from quirelight.operators.rows import checkpoint

#: Distances of a running header or footer between pages, and to the page's edge.
NEAR, EDGE = 10.0, 15.0


def headfoot_pairs(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks of equal text and place on pages p and p + 1 or p + 2: (doc_id, page_no, flow_no,
    block_no, other_page, text), once per pair. An equi-join on document, text and page distance
    with a band as residual, of texts that stand on several pages of their document; others have no pair."""
    full = layout.block_texts(words, layout.fed(), "").select(*layout.BLOCK, "x_min", "y_min", "x_max", "y_max", "text")
    same_text = Window.partitionBy("doc_id", "text")
    full = full.withColumn("spread", F.max("page_no").over(same_text) - F.min("page_no").over(same_text)).where("spread > 0").drop("spread")
    full = checkpoint(full)  # few of many blocks, asked for by both sides
    inner = full.join(pages.select(*layout.PAGE, "height"), layout.PAGE).where((F.col("y_min") >= EDGE) & (F.col("y_max") <= F.col("height") - EDGE))
    left = inner.withColumn("other_page", F.explode(F.array(F.col("page_no") + 1, F.col("page_no") + 2)))
    right = full.select("doc_id", F.col("page_no").alias("other_page"), "text", *(F.col(c).alias(f"{c}2") for c in ("x_min", "y_min", "x_max", "y_max")))
    near = lambda a, b: F.abs(a - b) < NEAR
    width, height = lambda s: F.col(f"x_max{s}") - F.col(f"x_min{s}"), lambda s: F.col(f"y_max{s}") - F.col(f"y_min{s}")
    same = near(F.col("x_min"), F.col("x_min2")) & near(F.col("y_min"), F.col("y_min2")) & near(width(""), width("2")) & near(height(""), height("2"))
    return left.join(right, ["doc_id", "other_page", "text"]).where(same).select(*layout.BLOCK, "other_page", "text").distinct()


def headfoot_text(pairs: DataFrame, most_bytes: int = 8192) -> DataFrame:
    """``doc_id, text``: texts in reading order, each unless what was collected contains it or it
    no longer fits."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "flow_no", "block_no", "other_page", "text"))), lambda x: x["text"])
    add = lambda acc, x: F.when(acc.contains(x) | (F.octet_length(acc) + F.octet_length(x) >= most_bytes), acc).otherwise(F.concat(acc, x))
    return pairs.groupBy("doc_id").agg(F.aggregate(ordered, F.lit(""), add).alias("text"))


def headfoot_fields(texts: DataFrame, journals: DataFrame) -> DataFrame:
    """``doc_id, volume, issue, year, container`` of header and footer texts."""
    from quirelight.operators.lookup import last_journal

    text = F.col("text")
    found = texts.select("doc_id", identifiers.volume(text).alias("volume"), identifiers.issue(text).alias("issue"), identifiers.year(text).alias("year"))
    return found.join(last_journal(texts, journals), "doc_id", "left").select("doc_id", "volume", "issue", "year", F.col("journal").alias("container"))


def page_numbers(words: DataFrame, edges: DataFrame | None, heights: DataFrame, page_step: int = 2, value_step: int = 1) -> DataFrame:
    """First page number found, per document: (doc_id, page_no, number). A numeric word in a line
    that lies as a whole near the top or bottom, near the left or right edge of the content or its (uncorrected) centre,
    whose value + ``value_step`` stands in about the same place ``page_step`` pages on, in such a line
    too.

    One pass over the words: the numbers of a line and the box of its other words are rows of one aggregation, in which
    all is a number, and boxes of lines and pages (unless ``edges`` are given) are windows over them. Where documents are dealt out by
    ``doc_id``, none of it deals them out again. The few numbers that are left are written, since both sides ask for them."""
    value = F.when(F.col("text").rlike("^[0-9]+$"), F.expr("try_cast(text AS bigint)"))
    number = F.when(value > 0, value)
    parts = words.select(*layout.LINE, "x_min", "y_min", "x_max", "y_max", number.alias("number"), F.when(number.isNotNull(), F.col("word_no")).alias("word_no"))
    boxes = parts.groupBy(*layout.LINE, "word_no", "number").agg(*(f(c).alias(c) for f, c in ((F.min, "x_min"), (F.min, "y_min"), (F.max, "x_max"), (F.max, "y_max"))))
    # Both windows in one order, so that rows are sorted once.
    line, page = Window.partitionBy(*layout.LINE), Window.partitionBy(*layout.PAGE).orderBy(*layout.LINE[2:]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = boxes.withColumn("line_top", F.min("y_min").over(line)).withColumn("line_bottom", F.max("y_max").over(line))
    if edges is None:
        placed = placed.withColumn("content_x_left", F.min("x_min").over(page)).withColumn("content_x_right", F.max("x_max").over(page))
    margin = (F.col("line_bottom") < 100) | (F.col("line_top") > F.col("height") - 100)
    centre = (F.col("content_x_right") - F.col("content_x_left")) / 2
    place = (F.abs(F.col("x_min") - F.col("content_x_left")) < 5) | (F.abs(F.col("x_max") - F.col("content_x_right")) < 5) | (F.abs((F.col("x_min") + F.col("x_max")) / 2 - centre) < 5)
    numeric = placed.where("number IS NOT NULL")
    if edges is not None:
        numeric = numeric.join(edges, layout.PAGE)
    numeric = numeric.join(heights.select(*layout.PAGE, "height"), layout.PAGE).where(margin)
    numeric = checkpoint(numeric.select(*layout.LINE, "word_no", "x_min", "y_min", "number", place.alias("at_edge")))
    left = numeric.where("at_edge").select(*layout.LINE, "word_no", "x_min", "y_min", "number", (F.col("page_no") + page_step).alias("p2"), (F.col("number") + value_step).alias("n2"))
    right = numeric.select("doc_id", F.col("page_no").alias("p2"), F.col("number").alias("n2"), F.col("x_min").alias("x2"), F.col("y_min").alias("y2"))
    hits = left.join(right, ["doc_id", "p2", "n2"]).where((F.abs(F.col("y_min") - F.col("y2")) < 1) & (F.abs(F.col("x_min") - F.col("x2")) < 15))
    first = F.min_by(F.struct("page_no", "number"), F.struct(*layout.LINE[1:], "word_no"))
    return hits.groupBy("doc_id").agg(first.alias("f")).select("doc_id", "f.page_no", "f.number")


def first_page_by_width(pages: DataFrame) -> DataFrame:
    """``doc_id, first_page`` from where page widths change after a cover."""
    w = F.col("w")
    widths = pages.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "width"))), lambda x: x["width"]).alias("w"))
    at = lambda i: F.try_element_at(w, F.lit(i + 1))
    n = F.size(w)
    steps = F.filter(F.sequence(F.lit(0), F.greatest(n - 4, F.lit(0))), lambda i: (F.get(w, i) != F.get(w, i + 1)) & (F.get(w, i + 1) == F.get(w, i + 2)))
    found = (
        F.when(n == 2, F.when(at(0) != at(1), 1).otherwise(0))
        .when(n == 3, F.when((at(0) != at(1)) & (at(1) == at(2)), 1).otherwise(0))
        .when(n < 4, 0)
        .when((at(0) != at(1)) & (at(1) != at(2)), 0)
        .otherwise(F.coalesce(F.array_max(steps) + 1, F.lit(0)))
    )
    return widths.select("doc_id", found.cast("int").alias("first_page"))


def first_page_by_fonts(words: DataFrame) -> DataFrame:
    """``doc_id, first_page`` after the last page none of whose fonts occur on later pages; at
    least two font comparisons with later pages are needed, and two pages after it."""
    fonts = layout.page_fonts(words)
    span = fonts.groupBy("doc_id").agg((F.max("page_no") + 1).alias("n_pages"), F.count("*").alias("n_fonts"))
    last_use = fonts.groupBy("doc_id", "font").agg(F.max("page_no").alias("last"))
    per_page = fonts.join(last_use, ["doc_id", "font"]).groupBy(*layout.PAGE).agg((F.max("last") > F.col("page_no")).alias("shared"), F.count("*").alias("own"))
    later = Window.partitionBy("doc_id").orderBy(F.desc("page_no")).rowsBetween(Window.unboundedPreceding, -1)
    counted = per_page.withColumn("compared", F.col("own") * F.coalesce(F.sum("own").over(later), F.lit(0))).join(span, "doc_id")
    found = F.max(F.when(~F.col("shared") & (F.col("compared") >= 2) & (F.col("n_pages") >= 3) & (F.col("page_no") <= F.col("n_pages") - 3), F.col("page_no") + 1))
    return counted.groupBy("doc_id").agg(F.coalesce(found, F.lit(0)).cast("int").alias("first_page"))


def page_range(numbers: DataFrame, first_pages: DataFrame, totals: DataFrame) -> DataFrame:
    """``doc_id, first_page, pages``: the number found decides on the first page and the range;
    without one ``pages`` is the number of pages."""
    joined = totals.join(first_pages, "doc_id", "left").join(numbers.select("doc_id", F.col("page_no").alias("start"), "number"), "doc_id", "left")
    back = (F.col("number") == 2) & (F.col("start") >= 1)
    first_page = F.when(F.col("number") == 1, F.col("start")).when(back, F.col("start") - 1).otherwise(F.coalesce("first_page", F.lit(0)))
    number = F.when(back, 1).otherwise(F.col("number"))
    j = joined.select("doc_id", "total_pages", first_page.cast("int").alias("first_page"), number.alias("number"))
    last = F.col("number") + F.col("total_pages") - F.col("first_page") - 1
    pages = F.when(F.col("number") > 1, F.concat(F.col("number").cast("string"), F.lit("-"), last.cast("string"))).when(F.col("number") == 1, last.cast("string")).otherwise(F.col("total_pages").cast("string"))
    return j.select("doc_id", "first_page", pages.alias("pages"))
