"""Aggregates of the ``words`` table: lines, blocks, pages, texts, fonts.

All group by a prefix of the reading-order keys; partial aggregation runs before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DOC, PAGE = ["doc_id"], ["doc_id", "page_no"]
BLOCK = [*PAGE, "flow_no", "block_no"]
LINE = [*BLOCK, "line_no"]

MAX_LOOKUP_BYTES = 9999


def _box() -> list[Column]:
    return [F.min("x_min").alias("x_min"), F.min("y_min").alias("y_min"), F.max("x_max").alias("x_max"), F.max("y_max").alias("y_max")]


def _spaced() -> Column:
    return F.concat("text", F.when(F.col("space"), " ").otherwise(""))


def _joined(order: list[str], text: Column, separator: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("t")))), lambda x: x["t"]), separator)


def lines(words: DataFrame) -> DataFrame:
    """Box, code points (a following blank counts) and text of each line."""
    chars = F.sum(F.length("text") + F.col("space").cast("int")).cast("long")
    return words.groupBy(*LINE).agg(*_box(), chars.alias("char_len"), _joined(["word_no"], _spaced(), "").alias("text"))


def block_texts(words: DataFrame, text: Column, separator: str) -> DataFrame:
    """Box, largest font size and text of each block in one aggregation of lines: ``text`` of each line, with ``separator``
    between lines. Words are not grouped a second time, nor are two results joined."""
    own = words.groupBy(*LINE).agg(*_box(), F.max("font_size").alias("font_size_max"), _joined(["word_no"], _spaced(), "").alias("text"))
    return own.groupBy(*BLOCK).agg(*_box(), F.max("font_size_max").alias("font_size_max"), _joined(["line_no"], text, separator).alias("text"))


def blocks(words: DataFrame) -> DataFrame:
    """Box, smallest and largest font size, bytes of text of each layout block."""
    return words.groupBy(*BLOCK).agg(*_box(), F.min("font_size").alias("font_size_min"), F.max("font_size").alias("font_size_max"), F.sum(F.octet_length("text")).cast("long").alias("text_len"))


def page_edges(words: DataFrame) -> DataFrame:
    return words.groupBy(*PAGE).agg(F.min("x_min").alias("content_x_left"), F.max("x_max").alias("content_x_right"))


def block_text(words: DataFrame) -> DataFrame:
    """Text of each block, a line feed before and after each line."""
    return block_texts(words, fed(), "").select(*BLOCK, "text")


def fed() -> Column:
    """The text of a line with a line feed before and after it."""
    return F.concat(F.lit("\n"), "text", F.lit("\n"))


def text_pages(words: DataFrame, total_pages: DataFrame | None = None, limit: int = 2) -> DataFrame:
    """Words of the pages whose text is searched: the first ``limit``, or with more pages decoded
    all but the last, or all if the document has more pages (``doc_id, total_pages``) than decoded."""
    span = words.groupBy("doc_id").agg((F.max("page_no") + 1).alias("n_pages"))
    most = F.when(F.col("n_pages") > limit, F.col("n_pages") - 1).otherwise(F.lit(limit))
    if total_pages is not None:
        span = span.join(total_pages, "doc_id", "left")
        most = F.when(F.coalesce("total_pages", F.lit(0)) > F.col("n_pages"), F.col("n_pages")).otherwise(most)
    return words.join(span.select("doc_id", most.alias("n_text_pages")), "doc_id").where(F.col("page_no") < F.col("n_text_pages")).drop("n_text_pages")


def doc_text(words: DataFrame, most_bytes: int = MAX_LOOKUP_BYTES) -> DataFrame:
    """``doc_id, text``: words with their blanks, a line feed after each line and another after each
    block, whole words while they fit in fewer than ``most_bytes`` bytes."""
    order = [F.col(c) for c in (*LINE[1:], "word_no")]
    same_line = Window.partitionBy(*LINE).orderBy("word_no")
    same_block = Window.partitionBy(*BLOCK).orderBy("line_no", "word_no")
    ends = F.concat(F.when(F.lead("word_no").over(same_line).isNull(), "\n").otherwise(""), F.when(F.lead("word_no").over(same_block).isNull(), "\n").otherwise(""))
    piece = words.withColumn("piece", F.concat(_spaced(), ends))
    running = Window.partitionBy("doc_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A word must fit; the blank or line feeds after it need not.
    before = F.sum(F.octet_length("piece")).over(running) - F.octet_length("piece")
    kept = piece.withColumn("bytes", before + F.octet_length("text")).where(F.col("bytes") < most_bytes)
    return kept.groupBy("doc_id").agg(_joined([*LINE[1:], "word_no"], F.col("piece"), "").alias("text"))


def font_histogram(words: DataFrame) -> DataFrame:
    """Bytes of text per page and whole font size (999 at most)."""
    size = F.floor("font_size").cast("int")
    return words.where(size <= 999).groupBy(*PAGE, size.alias("font_size")).agg(F.sum(F.octet_length("text")).cast("long").alias("n_bytes"))


def font_threshold(words: DataFrame, least_bytes: int = 500) -> DataFrame:
    """One more than the largest size with over ``least_bytes`` bytes on the page (0 if none)."""
    return font_histogram(words).groupBy(*PAGE).agg((F.coalesce(F.max(F.when(F.col("n_bytes") > least_bytes, F.col("font_size"))), F.lit(0)) + 1).alias("threshold"))


def dominating(words: DataFrame, column: str) -> DataFrame:
    """Per line the value of ``column`` with most bytes; the one seen first on a tie."""
    weight = words.groupBy(*LINE, column).agg(F.sum(F.octet_length("text")).alias("n"), F.min("word_no").alias("first"))
    return weight.groupBy(*LINE).agg(F.max_by(column, F.struct("n", -F.col("first"))).alias(column))


def line_upper(words: DataFrame) -> DataFrame:
    from quirelight.functions.text import is_upper

    return lines(words).select(*LINE, is_upper(F.col("text")).alias("upper"))


def line_fonts(words: DataFrame) -> DataFrame:
    """``mono_font`` of lines set in one font (NULL otherwise), largest size, and the (font, size,
    height) triples of a line's words."""
    one = F.when(F.count_distinct("font") == 1, F.min("font"))
    height = F.struct("font", "font_size", (F.col("y_max") - F.col("y_min")).alias("height"))
    return words.groupBy(*LINE).agg(one.alias("mono_font"), F.max("font_size").alias("max_font_size"), F.array_sort(F.collect_set(height)).alias("faces"))


def font_pairs(words: DataFrame) -> DataFrame:
    """For each line and the one before it on the page: ``fonts_equal`` (1 both in one and the same
    font, 2 both in one font but different ones, 0 otherwise), ``shares_face`` and ``shares_font``."""
    order = Window.partitionBy(*PAGE).orderBy("flow_no", "block_no", "line_no")
    own = line_fonts(words).withColumn("before_font", F.lag("mono_font").over(order)).withColumn("before_faces", F.lag("faces").over(order)).where("before_faces IS NOT NULL")
    equal = F.when(F.col("mono_font").isNull() | F.col("before_font").isNull(), 0).when(F.col("mono_font") == F.col("before_font"), 1).otherwise(2)
    font = lambda c: F.transform(c, lambda x: F.struct(x["font"], x["font_size"]))
    return own.select(*LINE, equal.alias("fonts_equal"), F.arrays_overlap("faces", "before_faces").alias("shares_face"), F.arrays_overlap(font("faces"), font("before_faces")).alias("shares_font"))


def fonts_info(words: DataFrame, keys: list[str] = DOC) -> DataFrame:
    return words.groupBy(*keys, "font", "font_size").agg(F.sum(F.octet_length("text")).cast("long").alias("n_bytes"))


def main_font(words: DataFrame) -> DataFrame:
    """Per document the (font, size) with most bytes; the smallest pair on a tie."""
    return fonts_info(words).groupBy("doc_id").agg(F.max_by(F.struct("font", "font_size"), F.struct("n_bytes", -F.col("font"), -F.col("font_size"))).alias("f")).select("doc_id", "f.font", "f.font_size")


def page_fonts(words: DataFrame) -> DataFrame:
    return words.select(*PAGE, "font").distinct()


def visually_separated(blocks: DataFrame) -> DataFrame:
    """Adds ``separated``: the gap to the block before or after is at least the larger font size of
    the two; a missing neighbour passes. ``blocks``: doc_id, page_no, lb_no, y_min, y_max, font_size."""
    order = Window.partitionBy(*PAGE).orderBy("lb_no")
    gap = lambda top, bottom, size: top - bottom >= F.greatest("font_size", size)
    before = gap(F.col("y_min"), F.lag("y_max").over(order), F.lag("font_size").over(order))
    after = gap(F.lead("y_min").over(order), F.col("y_max"), F.lead("font_size").over(order))
    return blocks.withColumn("separated", F.coalesce(before, F.lit(True)) | F.coalesce(after, F.lit(True)))


def skipped(blocks: DataFrame) -> DataFrame:
    """Adds ``skip``: one of the 1-4 blocks before (never the first) overlaps in x and its font size
    exceeds the vertical gap. ``blocks`` as above with x_min and x_max."""
    order = Window.partitionBy(*PAGE).orderBy("lb_no").rowsBetween(-4, -1)
    near = F.collect_list(F.struct("lb_no", "x_min", "x_max", "y_max", "font_size")).over(order)
    hit = lambda b: (b["lb_no"] > 0) & (b["x_min"] <= F.col("x_max")) & (b["x_max"] >= F.col("x_min")) & (b["font_size"] > F.col("y_min") - b["y_max"])
    return blocks.withColumn("near", near).withColumn("skip", F.exists("near", hit)).drop("near")


def by_font_size(blocks: DataFrame) -> DataFrame:
    """Adds ``rank`` from 1: larger fonts first, reading order on ties."""
    return blocks.withColumn("rank", F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("font_size"), "lb_no")))


def largest_block(blocks: DataFrame, least_percent: int = 70) -> DataFrame:
    """The largest block that is mostly letters, the first on a tie."""
    from quirelight.functions.text import alphabetic_percent

    return blocks.where(alphabetic_percent(F.col("text")) >= least_percent).groupBy(*PAGE).agg(F.max_by("lb_no", F.struct("font_size", -F.col("lb_no"))).alias("lb_no"))
