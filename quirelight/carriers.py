"""Test inputs: identifier strings and page layouts composed from the driver's tables.

The layout takes every word of every document: pages of 200 words, lines of 10, blocks of 5 lines.
"""

from __future__ import annotations

import functools
import itertools
import json
import operator
from json.encoder import encode_basestring_ascii

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.operators.rows import dealt, map_rows

WORDS, LINE, BLOCK_LINES = 200, 10, 5
#: Width of a letter.
LETTER = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def layout_words(docs: DataFrame) -> DataFrame:
    """The canonical ``words`` table of the layout of ``docs`` (doc_id, text)."""
    tokens = F.filter(F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), " "), lambda x: x != "")
    w = docs.select("doc_id", F.posexplode(tokens).alias("i", "text"))
    page, line = F.floor(F.col("i") / WORDS).cast("int"), F.floor(F.col("i") % WORDS / LINE).cast("int")
    w = w.select("doc_id", page.alias("page_no"), line.alias("l"), (F.col("i") % LINE).cast("int").alias("word_no"), "text")
    block = F.floor(F.col("l") / BLOCK_LINES).cast("int")
    size = F.when((F.col("page_no") == 0) & (block == 0), 16.0).when(block == 1, 12.0).otherwise(10.0)
    x = F.lit(72.0) + 40 * F.col("word_no") + F.col("doc_id") % 3
    y = F.lit(60.0) + 14 * F.col("l") + 6 * block
    return w.select(
        "doc_id", "page_no", F.lit(0).alias("flow_no"), block.alias("block_no"), (F.col("l") % BLOCK_LINES).cast("int").alias("line_no"), "word_no",
        x.cast("double").alias("x_min"), y.cast("double").alias("y_min"), (x + 5 * F.length("text")).cast("double").alias("x_max"), (y + 10).cast("double").alias("y_max"),
        size.cast("double").alias("font_size"), (F.col("word_no") < LINE - 1).alias("space"), (y + 8).cast("double").alias("baseline"),
        ((block == 0) & (F.col("page_no") == 0)).alias("bold"), (F.col("word_no") % 4 * (F.col("l") % 2) + F.col("page_no") % 2 * 10).cast("int").alias("font"), "text",
    )


def layout_page_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """``doc_id, page_no`` and ``columns`` of each page of ``layout_words``, from the number of words."""
    tokens = F.filter(F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")), " "), lambda x: x != "")
    last = F.floor((F.size(tokens) - 1) / WORDS).cast("int")
    return docs.select("doc_id", *columns, last.alias("last")).where("last >= 0").select("doc_id", *columns, F.explode(F.sequence(F.lit(0), "last")).alias("page_no"))


#: The same table as DuckDB SQL; queries start with WITH words AS (LAYOUT_SQL).
LAYOUT_SQL = """
SELECT doc_id, page_no, 0 AS flow_no, l // 5 AS block_no, l % 5 AS line_no, word_no,
  72.0::DOUBLE + 40 * word_no + doc_id % 3 AS x_min, 60.0::DOUBLE + 14 * l + 6 * (l // 5) AS y_min,
  72.0::DOUBLE + 40 * word_no + doc_id % 3 + 5 * length(text) AS x_max, 60.0::DOUBLE + 14 * l + 6 * (l // 5) + 10 AS y_max,
  CASE WHEN page_no = 0 AND l // 5 = 0 THEN 16.0 WHEN l // 5 = 1 THEN 12.0 ELSE 10.0 END::DOUBLE AS font_size,
  word_no < 9 AS space, 60.0::DOUBLE + 14 * l + 6 * (l // 5) + 8 AS baseline, l // 5 = 0 AND page_no = 0 AS bold,
  (word_no % 4 * (l % 2) + page_no % 2 * 10)::INT AS font, text
FROM (SELECT doc_id, (i // 200)::INT AS page_no, (i % 200 // 10)::INT AS l, (i % 10)::INT AS word_no, text
  FROM (SELECT doc_id, unnest(t) AS text, generate_subscripts(t, 1) - 1 AS i
    FROM (SELECT doc_id, list_filter(string_split(replace(coalesce(text, ''), chr(10), ' '), ' '), lambda x: x <> '') AS t FROM documents)))
"""


def words_of(text: str | None) -> list[str]:
    return [t for t in (text or "").replace("\n", " ").split(" ") if t]


def word(x: float, y: float, text: str, size: float, font: int, space: bool = True, bold: bool = False, height: float = 10, drop: float = 8) -> list:
    """A word of a request: its positional array."""
    return [x, y, x + 5 * len(text), y + height, size, int(space), y + drop, 0, 0, int(bold), 0, 0, font, text]


def block(lines: list[list[list]]) -> list:
    """A block of lines of words."""
    of = [w for line in lines for w in line]
    return [min(w[0] for w in of), min(w[1] for w in of), max(w[2] for w in of), max(w[3] for w in of), [[line] for line in lines]]


def text_block(y: float, text: str, size: float, font: int, x: float = 72.0) -> list:
    """A block of one line, words 50 units apart; a word that starts with ^ is a raised footnote mark
    of the one before it."""
    line: list[list] = []
    for t in text.split(" "):
        if t.startswith("^"):
            line[-1][5] = 0
            line.append(word(line[-1][2], y, t[1:], size / 2, font, height=size / 2, drop=size / 2 - 2))
        else:
            line.append(word(x + 50 * len(line), y, t, size, font, height=size, drop=size - 2))
    return block([line])


def layout_pages(shift: int, tokens: list[str], down: float = 0.0, plain: bool = False, pitch: float = 14.0, extra: float = 6.0, style=None) -> list[list[list]]:
    """Blocks of each page of the layout of ``layout_words``, ``down`` units lower; ``plain`` sets all in one size
    and weight. ``style`` gives (size, font, bold) of a block by its number, for all its words."""
    pages = []
    for first in range(0, len(tokens), WORDS):
        page, own = first // WORDS, tokens[first : first + WORDS]
        blocks: list[list] = []
        for at in range(0, len(own), LINE):
            row = at // LINE
            b = row // BLOCK_LINES
            y = 60.0 + pitch * row + extra * b + down
            title = page == 0 and b == 0 and not plain
            line = []
            for n, t in enumerate(own[at : at + LINE]):
                size, font, bold = style(b) if style else (10.0 if plain else 16.0 if title else 12.0 if b == 1 else 10.0, n % 4 * (row % 2) + page % 2 * 10, title)
                line.append(word(72.0 + 40 * n + shift, y, t, size, font, n < LINE - 1, bold))
            if row % BLOCK_LINES == 0:
                blocks.append([])
            blocks[-1].append(line)
        pages.append([block(lines) for lines in blocks])
    return pages


class _Written(dict):
    """Right ends as JSON, each written once, by their distance from ``start`` in letters."""

    def __init__(self, start: float):
        self.start = start

    def __missing__(self, place: int) -> str:
        self[place] = text = repr(self.start + LETTER * place)
        return text


@functools.lru_cache(maxsize=1 << 14, typed=True)
def _line_form(shift: int, y: float, size: float, bold: bool, face: int | None, odd_row: int, odd_page: int, count: int, moved: tuple[tuple[int, float], ...] = ()) -> tuple[str, ...]:
    """JSON of a line of ``count`` words in pieces: every fourth from the second on is left open for the right end of a word,
    and every fourth from the fourth on for its text, between quotes."""
    farther, pieces = dict(moved), ["[["]
    for n in range(count):
        font = n % 4 * odd_row + odd_page * 10 if face is None else face
        left = 72.0 + 40 * n + shift
        left = left + farther[n] if n in farther else left
        pieces[-1] += f"[{left}, {y}, "
        pieces += ["", f", {y + 10}, {size}, {int(n < LINE - 1)}, {y + 8}, 0, 0, {int(bold)}, 0, 0, {font}, \"", "", "\"], " if n < count - 1 else "\"]]]"]
    return tuple(pieces)


def layout_json(shift: int, tokens: list[str], down: float = 0.0, plain: bool = False, pitch: float = 14.0, extra: float = 6.0, style=None, moved: dict[int, float] | None = None) -> list[list[str]]:
    """The blocks of ``layout_pages`` as JSON, written line by line into forms that lines at the same place share. Words
    named in ``moved`` by their number start so much farther right, and nothing else changes."""
    left = 72.0 + shift
    # Words stand 40 units apart, which is so many letters. What is told of each word alone is told for all at once.
    places = list(map(operator.add, itertools.cycle(range(0, 40 // LETTER * LINE, 40 // LETTER)), map(len, tokens)))
    ends = list(map(_Written(left).__getitem__, places))
    # Words have no blanks, so that all are escaped at once.
    texts = encode_basestring_ascii(" ".join(tokens))[1:-1].split(" ")
    if len(texts) != len(tokens):
        texts = [encode_basestring_ascii(t)[1:-1] for t in tokens]
    pages: list[list[str]] = []
    for first in range(0, len(tokens), WORDS):
        page, blocks = first // WORDS, []
        for start in range(first, min(first + WORDS, len(tokens)), LINE * BLOCK_LINES):
            b = (start - first) // (LINE * BLOCK_LINES)
            title = page == 0 and b == 0 and not plain
            size, face, bold = style(b) if style else (10.0 if plain else 16.0 if title else 12.0 if b == 1 else 10.0, None, title)
            lines, top = [], None
            last = min(start + LINE * BLOCK_LINES, first + WORDS, len(tokens))
            for at in range(start, last, LINE):
                row = (at - first) // LINE
                y = 60.0 + pitch * row + extra * b + down
                top = y if top is None else top
                end = min(at + LINE, last)
                here = tuple((n - at, moved[n]) for n in range(at, end) if n in moved) if moved else ()
                pieces = [*_line_form(shift, y, size, bold, face, row % 2, page % 2, end - at, here)]
                pieces[1::4], pieces[3::4] = ends[at:end], texts[at:end]
                lines.append("".join(pieces))
            blocks.append(f"[{left}, {top}, {left + LETTER * max(places[start:last])}, {y + 10}, [{', '.join(lines)}]]")
        pages.append(blocks)
    return pages


def pages_json(pages: list[list[list]]) -> str:
    """JSON of pages; a page is a list of flows, a flow a list of blocks, a block a list or JSON."""
    flow = lambda blocks: f"[[{', '.join(b if type(b) is str else json.dumps(b) for b in blocks)}]]"
    return f"[{', '.join('[612.0, 792.0, [' + ', '.join(map(flow, flows)) + ']]' for flows in pages)}]"


def request(pages: list[list[list]], title: str | None = None, total: int = 9) -> str:
    """JSON of a request with ``pages_json``."""
    meta = json.dumps({} if title is None else {"Title": title})
    return f'{{"metadata": {meta}, "totalPages": {total}, "pages": {pages_json(pages)}}}'


def composed(docs: DataFrame, row, *columns: str) -> DataFrame:
    """Requests (``doc_id, body``) that ``row`` composes from the columns of each document. The documents
    are dealt out first, since a table of a few row groups would leave most cores without work, in parts that
    stay small when requests are many times as long as texts."""
    own = docs.select("doc_id", *columns)
    return map_rows(dealt(own, "doc_id"), lambda *values: {"doc_id": values[0], "body": row(*values)}, "doc_id long, body string")


def payloads(docs: DataFrame) -> DataFrame:
    """Requests (``doc_id, body``) that hold the layout of ``docs`` (doc_id, text)."""

    return composed(docs, lambda doc_id, text: request([[blocks] for blocks in layout_json((doc_id or 0) % 3, words_of(text))], "T"), "text")
