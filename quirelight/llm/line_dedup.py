"""Operator 5: line deduplication with keep bitmaps.

Lines are reduced to 128-bit hashes of their keys, range-partitioned and sorted by (hash,
document, position), so that a very common line spreads over several ranges and equal (hash,
document) pairs still meet. Each range is streamed once; it tells in how many documents a hash
occurs and which is the last, and what ranges know of one hash is summed. Documents then get a
compressed bitmap of the lines they keep; the text moves only when bitmaps are applied.

A key is the line without ASCII white space at its ends and with A-Z lower-cased. Keys of at
least ``least_chars`` code points found in at least ``least_docs`` documents lose all their lines
except in the largest doc_id that holds them.

Defined results: a null or empty text is one empty line; rows of equal doc_id are one document
for counting, but each loses only lines of its own text, since bitmaps belong to (doc_id, hash of
the text); null doc_ids count as one document, smaller than any other; an empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.llm.common import WHITE, ascii_lower, checkpoint, dealt_again, map_batches

NO_ID = -(1 << 63)


def _mark(text) -> F.Column:
    """Tells texts under one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _lines(docs: DataFrame, least_chars: int, text: str, key: str) -> DataFrame:
    split = F.split(F.coalesce(docs[text], F.lit("")), "\n", -1)
    lines = docs.select(F.coalesce(docs[key].cast("long"), F.lit(NO_ID)).alias("doc"), _mark(docs[text]).alias("mark"), split.alias("lines")).select("doc", "mark", F.posexplode("lines").alias("pos", "line"))
    line = F.trim(ascii_lower(F.col("line")), F.lit(WHITE))
    keyed = lines.select("doc", "mark", "pos", line.alias("line")).where(F.length("line") >= least_chars)
    return keyed.select(F.xxhash64(F.lit(1), "line").alias("hi"), F.xxhash64(F.lit(2), "line").alias("lo"), "doc", "mark", "pos")


def _stream(least_docs: int):
    """Per range and hash: documents seen and the largest; hashes that other batches or ranges
    may continue are told whatever their count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            hi, lo, doc = (batch.column(i).to_numpy() for i in range(3))
            new_key = np.ones(len(hi), bool)
            new_key[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
            new_doc = new_key.copy()
            new_doc[1:] |= doc[1:] != doc[:-1]
            if last == (hi[0], lo[0], doc[0]):
                new_doc[0] = False  # counted with the batch before
            starts = np.flatnonzero(new_key)
            count = np.add.reduceat(new_doc.astype(np.int64), starts)
            largest = np.maximum.reduceat(doc, starts)
            told = count >= least_docs
            told[[0, -1]] = True
            last = (hi[-1], lo[-1], doc[-1])
            yield pa.RecordBatch.from_arrays([pa.array(hi[starts][told]), pa.array(lo[starts][told]), pa.array(count[told]), pa.array(largest[told])], ["hi", "lo", "n", "largest"])

    return run


def keep_bitmaps(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc, mark, keep_bitmap`` of each text that loses a line: zlib-compressed bits, lowest first,
    1 for lines to keep; lines beyond the last bit are kept. ``doc`` is NO_ID for a null id
    and ``mark`` the hash of the text."""
    lines = checkpoint(_lines(docs, least_chars, text, key))
    ranged = lines.select("hi", "lo", "doc", "pos").repartitionByRange("hi", "lo", "doc").sortWithinPartitions("hi", "lo", "doc", "pos")
    common = (
        ranged.mapInArrow(_stream(least_docs), "hi long, lo long, n long, largest long")
        .groupBy("hi", "lo")
        .agg(F.sum("n").alias("n"), F.max("largest").alias("largest"))
        .where(F.col("n") >= least_docs)
    )
    # Dealt out again, so that a very common line can be split here too.
    lost = lines.join(dealt_again(common, "hi", "lo"), ["hi", "lo"]).where(F.col("doc") != F.col("largest")).groupBy("doc", "mark").agg(F.collect_set("pos").alias("lost"))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = []
        for lost in batch.column(2).to_pylist():
            bits = np.ones(max(lost) // 8 * 8 + 8, np.uint8)
            bits[lost] = 0
            packed.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["doc", "mark", "keep_bitmap"])

    return map_batches(lost, kernel, "doc long, mark long, keep_bitmap binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with the lines that bitmaps drop taken out of ``text``, and n_lines and n_dropped
    in columns of these names with ``_of_lines`` added (a null text stays null)."""
    marks = bitmaps.select(F.col("doc").alias("doc_of_lines"), F.col("mark").alias("mark_of_lines"), "keep_bitmap")
    own = (F.coalesce(docs[key].cast("long"), F.lit(NO_ID)) == F.col("doc_of_lines")) & (_mark(docs[text]) == F.col("mark_of_lines"))
    joined = docs.join(marks, own, "left").drop("doc_of_lines", "mark_of_lines")
    names = docs.columns
    at = names.index(text)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [batch.column(i) for i in range(len(names))]
        marks = batch.column(len(names)).to_pylist()
        # Only texts with a bitmap are taken apart.
        body, counts, dropped = columns[at], [], []
        if any(m is not None for m in marks):
            out = []
            for own, mark in zip(body.to_pylist(), marks):
                lines = (own or "").split("\n")
                lost = 0
                if mark is not None:
                    keep = np.ones(len(lines), bool)
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(mark), np.uint8), bitorder="little")[: len(lines)].astype(bool)
                    keep[: len(bits)] = bits
                    lost = int((~keep).sum())
                    own = "\n".join(x for x, k in zip(lines, keep.tolist()) if k)
                out.append(own)
                counts.append(len(lines))
                dropped.append(lost)
            columns[at] = pa.array(out, body.type)
        else:
            counts = [1 + (own or "").count("\n") for own in body.to_pylist()]
            dropped = [0] * len(counts)
        return pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], [f"c{i}" for i in range(len(names) + 2)])

    from pyspark.sql import types as T

    fields = docs.schema.fields
    flat = joined.toDF(*[f"c{i}" for i in range(len(names) + 1)])
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)] + [T.StructField(f"c{len(names) + i}", T.LongType()) for i in range(2)])
    return map_batches(flat, kernel, schema).toDF(*names, "n_lines_of_lines", "n_dropped_of_lines")


def line_dedup(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without the lines that other documents hold, and their counts of lines."""
    return apply_bitmaps(docs, keep_bitmaps(docs, least_chars, least_docs, text, key), text, key)
