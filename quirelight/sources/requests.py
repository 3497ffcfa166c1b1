"""Recognition requests and results: JSON payloads to layout tables, results to JSON.

Malformed payloads (no JSON object) keep their row, with ``malformed`` set.
"""

from __future__ import annotations

import gc
import itertools
import json
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

from quirelight.operators.rows import parts

MAX_PAGES = 5
MAX_TITLE_BYTES = 1024
#: Bytes of a body beyond which a gzip stream is refused, and the bytes such a stream starts with (a fixed value).
MOST_UNZIPPED, GZIP = 64 << 20, b"\x1f\x8b"
KEYS = ("page_no", "flow_no", "block_no", "line_no", "word_no")


def _refused(constant: str):
    raise ValueError(constant)


class _Read(dict):
    """Numbers by their text, which layouts repeat: each is made once, up to a fixed number of them."""

    def __init__(self, kind: type):
        self.kind = kind

    def __missing__(self, text: str):
        number = self.kind(text)
        if len(self) < MOST_READ and len(text) <= 20:
            self[text] = number
        return number


MOST_READ = 1 << 16
_DECODER = json.JSONDecoder(parse_float=_Read(float).__getitem__, parse_int=_Read(int).__getitem__, parse_constant=_refused)


def load(body: str | None) -> dict | None:
    """The JSON object of a request; None if there is none. NaN, infinities and halves of surrogate
    pairs are no JSON."""
    try:
        found = _DECODER.decode(body or "")
        if "\\ud" in (body or "").lower():
            json.dumps(found, ensure_ascii=False).encode()
    except (ValueError, RecursionError):  # UnicodeEncodeError is a ValueError
        found = None
    return found if isinstance(found, dict) else None


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One payload a file; gzip is told by the suffix. ``doc_id`` is a hash of the file's name."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.xxhash64(F.col("_metadata.file_path")).alias("doc_id"), F.col("value").alias("body"))


def unzipped(content: bytes) -> str | None:
    """The text of the first gzip member; None if it is broken, incomplete, too long or no UTF-8."""
    stream = zlib.decompressobj(31)
    try:
        body = stream.decompress(content, MOST_UNZIPPED)
        return body.decode() if stream.eof else None
    except (zlib.error, UnicodeDecodeError):
        return None


@F.pandas_udf(StringType())
def _unzipped(contents: pd.Series) -> pd.Series:
    return contents.map(unzipped, na_action="ignore")


def bodies(payloads: DataFrame) -> DataFrame:
    """Payloads with binary ``content`` as ``doc_id, body``. Gzip is told by its first bytes, whatever the name of a file; a
    body that cannot be read keeps its row and is NULL, which is malformed. Others stay in the JVM."""
    content = F.col("content")
    zipped = F.coalesce(F.substring(content, 1, 2) == F.lit(GZIP), F.lit(False))
    plain = F.try_validate_utf8(F.when(~zipped, content).cast("string"))
    return payloads.select("doc_id", F.when(zipped, _unzipped(F.when(zipped, content))).otherwise(plain).alias("body"))


def read_contents(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_payloads``, with gzip told by content. An empty file has no row, as with any file source."""
    files = spark.read.format("binaryFile").load(path)
    return bodies(files.select(F.xxhash64("path").alias("doc_id"), "content"))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _number(v: Column) -> Column:
    """Fractions and integers up to 10**15 either way; others count as 0 (see ``document``)."""
    n, kind = F.try_variant_get(v, "$", "double"), _kind(v)
    decimal = kind.startswith("DECIMAL")
    fraction = kind.isin("DOUBLE", "FLOAT") | (decimal & ~kind.endswith(",0)"))
    return F.coalesce(F.when(((F.abs(n) < 1e15) | fraction) & (kind.isin("BIGINT", "DOUBLE", "FLOAT") | decimal), n), F.lit(0.0))


def _whole(v: Column) -> Column:
    """An integer below 10**15 that is written as one; a fraction, a truth value or a text counts as 0."""
    n = F.try_variant_get(v, "$", "long")
    return F.coalesce(F.when((_kind(v) == "BIGINT") & n.between(1 - 10**15, 10**15 - 1), n), F.lit(0).cast("long"))


def _text(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def parse(payloads: DataFrame) -> DataFrame:
    """``doc_id, total_pages, meta_title, pages`` (a variant), ``complete``, ``malformed``.

    The rules are those of ``plans.recognize.load`` and ``operators.document.parse_pages``: a body is one JSON object
    and white space, of equal keys the last counts, values have the kind they are written in (no number is read
    from a text), and what has another kind counts as 0 or as nothing."""
    parsed = _as_variants(payloads)
    title = _text(_get(F.col("v"), "$.metadata.Title"))
    is_object = F.col("v").isNotNull()
    filled = lambda path: is_object & _get(F.col("v"), path).isNotNull() & ~F.coalesce(F.is_variant_null(_get(F.col("v"), path)), F.lit(True))
    total = _whole(_get(F.col("v"), "$.totalPages"))
    complete = filled("$.metadata") & filled("$.totalPages")
    return parsed.select(
        "doc_id",
        F.when(complete, F.when(F.abs(total) < 1 << 31, total).otherwise(0)).cast("int").alias("total_pages"),
        F.when(F.octet_length(title) <= MAX_TITLE_BYTES, title).alias("meta_title"),
        F.when(is_object, _get(F.col("v"), "$.pages")).alias("pages"),
        complete.alias("complete"),
        (~is_object | (is_object & _get(F.col("v"), "$.pages").isNull())).alias("malformed"),
    )


@F.pandas_udf(StringType())
def _plain(texts: pd.Series) -> pd.Series:
    def one(body):
        found = load(body)
        return None if found is None else json.dumps(found, ensure_ascii=False)

    return texts.map(one, na_action="ignore")


def _once(rows: DataFrame, col: Column, name: str, *keep: str) -> DataFrame:
    """``col`` as a column that later filters and selections read and never compute again: these are not moved below a
    generator, while they would each take a copy of an expression."""
    return rows.select(*keep, F.explode(F.array(col)).alias(name))


def _as_variants(payloads: DataFrame) -> DataFrame:
    """``doc_id`` and ``v``, a body as a variant, NULL if it is no request. The JVM's reader stops at the end of a value, whatever
    follows; inside an object with a mark at its end it reads the whole body or fails. What is no object or what it refuses (a key given
    twice, say, or very deep nesting) and halves of surrogate pairs are left to ``load``, whose objects it reads again."""
    wrapped = lambda c: F.try_parse_json(F.concat(F.lit('{"body":'), c, F.lit(',"end":true}')))
    ended = lambda v: F.coalesce(F.try_variant_get(v, "$.end", "boolean"), F.lit(False))
    read = _once(payloads, wrapped(F.col("body")), "_read", "doc_id", "body")
    is_object = F.col("body").rlike(r"^[ \t\r\n]*\{")
    sure = F.coalesce(is_object & ~F.contains(F.lower("body"), F.lit("\\ud")) & ended(F.col("_read")), F.lit(False))
    read = read.select("doc_id", sure.alias("_sure"), F.when(sure, F.col("_read")).alias("_read"), F.when(~sure, F.col("body")).alias("_rest"))
    again = wrapped(_plain(F.col("_rest")))
    value = F.when(F.col("_sure"), _get(F.col("_read"), "$.body")).otherwise(F.when(ended(again), _get(again, "$.body")))
    return _once(read, value, "v", "doc_id")


def _exploded(rows: DataFrame, array: Column, keep: list[str], position: str) -> DataFrame:
    """One row for each element of a variant that is an array; none for other kinds (fields of an object have a key)."""
    each = rows.withColumn("_array", array).lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_array").outer()))
    return each.where("key IS NULL").select(*keep, F.col("pos").alias(position), F.col("value").alias("_value"))


def decode_pages(parsed: DataFrame, max_pages: int | None = MAX_PAGES) -> DataFrame:
    """``doc_id, page_no, width, height, flows``; pages without words keep their row."""
    pages = _exploded(parsed.select("doc_id", "pages"), F.col("pages"), ["doc_id"], "page_no")
    at = lambda i: _get(F.col("_value"), f"$[{i}]")
    pages = pages.select("doc_id", "page_no", _number(at(0)).alias("width"), _number(at(1)).alias("height"), at(2).alias("flows"))
    return pages.where(F.col("page_no") < max_pages) if max_pages else pages


def decode_words(parsed: DataFrame, max_pages: int | None = MAX_PAGES) -> DataFrame:
    """The canonical ``words`` table: reading-order keys, geometry, typography, text. Values that a word lacks
    count as 0 or as an empty text."""
    keys: list[str] = ["doc_id", "page_no"]
    rows, array = decode_pages(parsed, max_pages).select(*keys, "flows"), F.col("flows")
    for name, path in (("flow_no", "$[0]"), ("block_no", "$[4]"), ("line_no", "$[0]"), ("word_no", None)):
        rows = _exploded(rows, array, keys, name)
        keys = [*keys, name]
        if path:
            array = _get(F.col("_value"), path)
    at = lambda i: _get(F.col("_value"), f"$[{i}]")
    font = _whole(at(12))
    return rows.select(
        *keys, *(_number(at(i)).alias(c) for i, c in enumerate(("x_min", "y_min", "x_max", "y_max", "font_size"))),
        (_whole(at(5)) != 0).alias("space"), _number(at(6)).alias("baseline"), (_whole(at(9)) != 0).alias("bold"), F.when(F.abs(font) < 1 << 31, font).otherwise(0).cast("int").alias("font"), F.coalesce(_text(at(13)), F.lit("")).alias("text"),
    )


#: Columns of a word beside its keys, their types, and their places in its array.
WORD_FIELDS = {
    "x_min": ("double", 0), "y_min": ("double", 1), "x_max": ("double", 2), "y_max": ("double", 3), "font_size": ("double", 4),
    "space": ("boolean", 5), "baseline": ("double", 6), "bold": ("boolean", 9), "font": ("int", 12), "text": ("string", 13),
}
_OF_WORD = ", ".join(f"{name}: {kind}" for name, (kind, _) in WORD_FIELDS.items())
_PAGES = f"doc_id long, page_no int, width double, height double, lines array<struct<flow_no: int, block_no: int, line_no: int, words: array<struct<word_no: int, {_OF_WORD}>>>>"
_WORDS = f"doc_id: long, page_no: int, flow_no: int, block_no: int, line_no: int, word_no: int, {_OF_WORD}"
#: Bytes of bodies that are held as objects at once (one body at least).
HELD_BYTES = 2 << 20


def read_words(payloads: DataFrame, max_pages: int | None = MAX_PAGES) -> DataFrame:
    """The canonical ``words`` table of payloads: what ``decode_words`` tells, by the same rules, from one reading of each body in
    an Arrow pass, whose values are columns before they are rows."""
    return _read(payloads, _WORDS, _word_rows, max_pages)


def read_pages(payloads: DataFrame, max_pages: int | None = MAX_PAGES) -> DataFrame:
    """``doc_id, page_no, width, height, lines`` of each page, with the words of each line as structs, read as ``read_words`` does. Pages
    without words keep their row."""
    return _read(payloads, _PAGES, _page_rows, max_pages)


def _read(payloads: DataFrame, schema: str, rows, max_pages: int | None) -> DataFrame:
    fields = StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, HELD_BYTES):
                with _uncollected():
                    found = _decoded(part, max_pages)
                yield rows(found, arrow)

    return payloads.select(F.col("doc_id").cast("long"), F.col("body").cast("string")).mapInArrow(run, fields)


@contextmanager
def _uncollected():
    """Without the collector of cycles, which values of JSON never form and which would walk all of them over and over."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def _list(value) -> list:
    return value if type(value) is list else []


def _at(value, i: int):
    return value[i] if type(value) is list and len(value) > i else None


def _float(value) -> float:
    return value if type(value) is float else float(value) if type(value) is int and -1e15 < value < 1e15 else 0.0


def _int(value, limit: int) -> int:
    return value if type(value) is int and abs(value) < limit else 0


_TRUTHS = pa.array([0.0, 1.0])


def _inside(numbers: pa.Array, low: float, high: float) -> bool:
    ends = pc.min_max(numbers).as_py()
    return low < ends["min"] and ends["max"] < high


def _field(values: list, kind: str) -> pa.Array:
    """A column of words. If all values are of the usual kind Arrow tells it from them, else they are taken one by one."""
    try:
        sent = pa.array(values)
    except (pa.ArrowException, OverflowError):
        sent = pa.nulls(len(values))
    usual = len(values) > 0 and sent.null_count == 0
    if sent.type == pa.float64() and pc.any(pc.is_in(sent, _TRUTHS)).as_py():  # Arrow takes truth values among fractions
        usual = usual and bool not in map(type, values)
    if kind == "string":
        return sent if usual and sent.type == pa.string() else pa.array([v if type(v) is str else "" for v in values], pa.string())
    if kind == "double":
        usual = usual and sent.type in (pa.float64(), pa.int64()) and _inside(sent, -1e15, 1e15)
        return sent.cast(pa.float64()) if usual else pa.array([_float(v) for v in values], pa.float64())
    limit, whole = (10**15, pa.int64()) if kind == "boolean" else (1 << 31, pa.int32())
    usual = usual and sent.type == pa.int64() and _inside(sent, -limit, limit)
    numbers = sent.cast(whole) if usual else pa.array([_int(v, limit) for v in values], whole)
    return pc.not_equal(numbers, 0) if kind == "boolean" else numbers


class _Decoded(NamedTuple):
    """Pages, lines and words of some bodies as columns, and where the lines of each page and the words of each line end."""

    pages: list[pa.Array]
    lines: list[pa.Array]
    words: list[pa.Array]
    line_ends: np.ndarray
    word_ends: np.ndarray


def _columns(rows: list[tuple], *kinds: pa.DataType) -> list[pa.Array]:
    return [pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [()] * len(kinds), kinds)]


def _decoded(part: pa.RecordBatch, max_pages: int | None) -> _Decoded:
    pages, lines, words, line_ends, word_ends = [], [], [], [0], [0]
    for doc_id, body in zip(*(c.to_pylist() for c in part.columns)):
        for p, page in enumerate(_list((load(body) or {}).get("pages"))[: max_pages or None]):
            for f, flow in enumerate(_list(_at(page, 2))):
                for b, block in enumerate(_list(_at(flow, 0))):
                    for n, line in enumerate(_list(_at(block, 4))):
                        if own := _list(_at(line, 0)):
                            words += own
                            lines.append((f, b, n))
                            word_ends.append(len(words))
            pages.append((doc_id, p, _float(_at(page, 0)), _float(_at(page, 1))))
            line_ends.append(len(lines))
    most = 1 + max(place for _, place in WORD_FIELDS.values())
    if set(map(type, words)) != {list} or set(map(len, words)) != {most}:
        words = [[*_list(w), *[None] * most][:most] for w in words]
    sent, ends = list(itertools.chain.from_iterable(words)), np.array(word_ends)
    numbers = pa.array(np.arange(len(words)) - np.repeat(ends[:-1], np.diff(ends)), pa.int32())
    fields = [numbers, *(_field(sent[place::most], kind) for kind, place in WORD_FIELDS.values())]
    return _Decoded(_columns(pages, pa.int64(), pa.int32(), pa.float64(), pa.float64()), _columns(lines, *[pa.int32()] * 3), fields, np.array(line_ends), ends)


def _word_rows(found: _Decoded, arrow: pa.Schema) -> pa.RecordBatch:
    line = np.repeat(np.arange(len(found.word_ends) - 1), np.diff(found.word_ends))
    page = np.repeat(np.arange(len(found.line_ends) - 1), np.diff(found.line_ends))[line]
    return pa.RecordBatch.from_arrays([*(c.take(pa.array(page)) for c in found.pages[:2]), *(c.take(pa.array(line)) for c in found.lines), *found.words], schema=arrow)


def _page_rows(found: _Decoded, arrow: pa.Schema) -> pa.RecordBatch:
    lists = arrow.field("lines").type
    line, words = lists.value_type, lists.value_type.field("words").type
    own = pa.ListArray.from_arrays(pa.array(found.word_ends, pa.int32()), pa.StructArray.from_arrays(found.words, fields=list(words.value_type)), words)
    lines = pa.ListArray.from_arrays(pa.array(found.line_ends, pa.int32()), pa.StructArray.from_arrays([*found.lines, own], fields=list(line)), lists)
    return pa.RecordBatch.from_arrays([*found.pages, lines], schema=arrow)


def authors_struct(col):
    """ "First Middle<tab>Last" lines to objects; a line without a tab has a last name only."""
    lines = F.filter(F.split(col, "\n"), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.when(F.instr(x, "\t") > 0, F.substring_index(x, "\t", 1)).alias("firstName"), F.substring_index(x, "\t", -1).alias("lastName")))


RESULT_FIELDS = ("type", "title", "authors", "doi", "isbn", "arxiv", "abstract", "year", "container", "publisher", "pages", "volume", "issue", "issn", "url")


def to_result_json(results: DataFrame) -> DataFrame:
    """``doc_id, result``; absent fields are left out, title and authors are always present."""
    fields = [F.coalesce(F.col("title"), F.lit("")).alias("title") if c == "title" else F.coalesce(F.col("authors"), F.array().cast("array<struct<firstName:string,lastName:string>>")).alias("authors") if c == "authors" else F.col(c) for c in RESULT_FIELDS]
    return results.select("doc_id", F.to_json(F.struct(*fields)).alias("result"))


def write_results(results: DataFrame, path: str, form: str = "json", batch: str | None = None) -> dict[str, int]:
    """``form`` text writes one result object a line, others the columns. Returns how many ``rows`` were written, how
    many of them ``malformed`` and how many with a title or a DOI (``titled``, ``with_doi``).

    With a ``batch`` the results become that partition of ``path``: a batch that is run again replaces its own
    results and leaves other batches alone; one without rows leaves what there is."""
    seen, some = Observation(), lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    observed = results.observe(seen, F.count(F.lit(1)).alias("rows"), some(F.col("malformed"), "malformed"), some(F.col("title").isNotNull(), "titled"), some(F.col("doi").isNotNull(), "with_doi"))
    out = to_result_json(observed).select("result") if form == "text" else observed
    if batch is None:
        out.write.format(form).save(path)
    else:
        out.withColumn("batch", F.lit(batch)).write.format(form).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").save(path)
    return seen.get
