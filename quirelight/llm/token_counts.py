"""Operator 7: token counts of fields and sections by offset-mapped attribution.

A document is encoded once, as one text; the character span of each token follows from the bytes
of its id. Sections are intervals that cover the text (its lines, each with its line feed, or the
given fields, joined by a line feed that belongs to the field before it). Spans are joined to
intervals by binary search, and a token that crosses a boundary is allocated by the rule:

* ``start``: to the section that holds its first character;
* ``end``: to the section that holds its last character;
* ``majority``: to the section that holds most of its characters, the earlier one on a tie;
* ``split``: to all sections it touches, by their share of its characters.

A character whose bytes belong to several tokens is in the span of each. The counts of a document's
sections always add up to its number of tokens.

Defined results: a null field counts as empty; an empty text is one empty section without tokens;
rows that repeat are counted alike; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quirelight.llm.bpe import Codec
from quirelight.llm.common import map_batches


def attribute(text: str, packed: bytes, token_bytes: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section and how many cross a boundary; ``bounds``: first character of each
    section, from 0 on."""
    ids = np.frombuffer(packed, "<u4")
    out = np.zeros(len(bounds))
    if not len(ids):
        return out, 0
    data = np.frombuffer(text.encode(), np.uint8)
    character = np.cumsum((data & 0xC0) != 0x80)
    ends = np.cumsum(token_bytes[ids])
    first = character[ends - token_bytes[ids]] - 1
    last = character[ends - 1] - 1
    a = np.searchsorted(bounds, first, "right") - 1
    b = np.searchsorted(bounds, last, "right") - 1
    crossing = np.flatnonzero(a != b)
    if rule == "start":
        np.add.at(out, a, 1)
    elif rule == "end":
        np.add.at(out, b, 1)
    else:
        inner = a == b
        np.add.at(out, a[inner], 1)
        edge = np.append(bounds, character[-1])
        for i in crossing.tolist():
            sections = np.arange(a[i], b[i] + 1)
            held = np.minimum(edge[sections + 1], last[i] + 1) - np.maximum(edge[sections], first[i])
            if rule == "majority":
                out[sections[held.argmax()]] += 1
            else:
                out[sections] += held / held.sum()
    return out, len(crossing)


def section_counts(docs: DataFrame, path: str, fields: list[str] | None = None, rule: str = "start", text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_tokens, n_sections, n_crossing, section_tokens`` of every row. Sections are the
    lines of ``text``, or ``fields`` if given."""
    if rule not in ("start", "end", "majority", "split"):
        raise ValueError(f"unknown rule {rule!r}")
    columns = fields or [text]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = Codec.load(path)
        token_bytes = np.array([len(b) for b in codec.bytes_of], np.int64)
        parts = list(zip(*(batch.column(i + 1).to_pylist() for i in range(len(columns)))))
        whole = ["\n".join(x or "" for x in row) for row in parts]
        rows = []
        for row, own, packed in zip(parts, whole, codec.pack(whole)):
            pieces = [x or "" for x in row] if fields else own.split("\n")
            bounds = np.cumsum([0] + [len(x) + 1 for x in pieces[:-1]])
            counts, crossing = attribute(own, packed, token_bytes, bounds, rule)
            rows.append((len(packed) // 4, len(pieces), crossing, counts))
        offsets = np.concatenate([[0], np.cumsum([r[1] for r in rows])]).astype(np.int32)
        values = np.concatenate([r[3] for r in rows]) if rows else np.zeros(0)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
            ["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens"],
        )

    wanted = docs.select(docs[key].cast("long").alias("doc_id"), *(docs[c].cast("string").alias(f"f{i}") for i, c in enumerate(columns)))
    return map_batches(wanted, kernel, "doc_id long, n_tokens long, n_sections long, n_crossing long, section_tokens array<double>")
