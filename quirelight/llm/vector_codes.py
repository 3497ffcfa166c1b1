"""Operator 13: product codes of vectors, whose nearest entries are found by VA-file filtering.

Vectors become integers, floor(scale * x), and are cut into equal consecutive parts, each with a
codebook of its own. Entries start as parts of the rows with the smallest ids; each round assigns every
part to its nearest entry and replaces entries by the componentwise floor of their parts' mean.

The nearest entry of a part is found as in a vector approximation file: the coordinates of the
entries are quantised to a few bits, that is, to cells between the quantiles of that coordinate. For a
part, a lookup table gives its least and largest squared distance to each cell of each coordinate;
their sums over an entry's cells bound its distance from below and above. Only entries whose lower
bound does not exceed the smallest upper bound are compared by their integer distance.

Each round is one scan without a shuffle of vectors: tasks add up counts and sums of their parts, and
these are added up by entry, exactly. Only codebooks (entries times length of a vector) reach the driver.

Defined results: rows whose vector is null or holds null or non-finite components are dropped. The
length of vectors is the commonest among the first rows (the longer of two); rows of another length stay, with null code
and error, and take no part. A length that the number of parts does not divide is padded with zeros. Rows
that repeat an id start one entry each, in order of their components, null ids last. With fewer rows
than entries there are as many entries as rows. Integers beyond 2**24 either way count as that, which
keeps distances exact; a sum of errors beyond a long is null. Components of all labels, null included, are coded alike; only the sum of errors is by label.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.llm.common import checkpoint

#: Bits of a cell, rows handled at once, and the largest integer.
BITS, STEP, LARGEST = 4, 2048, 1 << 24


class Approximation:
    """The cells of one codebook of integer entries (entries x width)."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        # Borders in each coordinate are values of entries at even ranks, so that cells hold similar numbers.
        ranks = np.linspace(0, len(entries) - 1, (1 << bits) + 1).round().astype(int)
        borders = np.sort(entries, axis=0)[ranks]
        self.low, self.high = borders[:-1], borders[1:]
        self.cells = np.stack([np.clip(np.searchsorted(borders[:, j], entries[:, j], "right") - 1, 0, (1 << bits) - 1) for j in range(entries.shape[1])], axis=1)

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (rows x entries) of squared distances, from a table of each row."""
        least = np.zeros((len(x), len(self.entries)), np.int64)
        most = np.zeros_like(least)
        for j in range(x.shape[1]):
            below, above = self.low[None, :, j] - x[:, j, None], x[:, j, None] - self.high[None, :, j]
            near = np.maximum(np.maximum(below, above), 0)
            far = np.maximum(np.abs(below), np.abs(above))
            least += (near * near)[:, self.cells[:, j]]
            most += (far * far)[:, self.cells[:, j]]
        return least, most

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest entry of each row (the first of equal ones), its squared distance, and the number of
        distances computed."""
        least, most = self.bounds(x)
        row, entry = np.nonzero(least <= most.min(axis=1)[:, None])
        difference = x[row] - self.entries[entry]
        found = np.full(least.shape, np.iinfo(np.int64).max)
        found[row, entry] = (difference * difference).sum(axis=1)
        best = found.argmin(axis=1)
        return best, found[np.arange(len(x)), best], np.bincount(row, minlength=len(x))


def integers(vectors: pa.Array, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) of vectors of one length, padded to ``width``."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    with np.errstate(over="ignore"):
        out = np.clip(np.floor(flat * scale), -LARGEST, LARGEST).astype(np.int64)
    return np.pad(out, ((0, 0), (0, width - out.shape[1])))


def _assign(x: np.ndarray, books: list[Approximation]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (rows x parts), squared distances of the same shape, distances computed for each row."""
    width = len(books[0].entries[0])
    codes, errors, compared = np.empty((len(x), len(books)), np.int64), np.empty((len(x), len(books)), np.int64), np.zeros(len(x), np.int64)
    for p, book in enumerate(books):
        codes[:, p], errors[:, p], n = book.nearest(x[:, p * width : (p + 1) * width])
        compared += n
    return codes, errors, compared


def usable(v) -> F.Column:
    """Whether a vector is there and all its components are finite."""
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _parts(batches: Iterator[pa.RecordBatch], column: str, scale: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            yield part, integers(part.column(column), scale, width)


def first_entries(rows: DataFrame, entries: int, parts: int, scale: int) -> tuple[int, np.ndarray] | None:
    """The length of vectors, and codebooks (parts x entries x width) of the rows with the smallest ids."""
    order = (F.col("_key").asc_nulls_last(), F.col("_vector"))
    some = rows.where(F.size("_vector") > 0)
    first = some.orderBy(*order).limit(entries).select("_vector").collect()
    if not first:
        return None
    length = max(Counter(len(r[0]) for r in first).items(), key=lambda x: (x[1], x[0]))[0]
    if any(len(r[0]) != length for r in first):
        first = some.where(F.size("_vector") == length).orderBy(*order).limit(entries).select("_vector").collect()
    width = -(-length // parts)
    x = integers(pa.array([r[0] for r in first], pa.list_(pa.float64())), scale, parts * width)
    return length, x.reshape(len(x), parts, width).transpose(1, 0, 2).copy()


def improved(rows: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """Codebooks after one round over all ``rows`` of the right length."""
    parts, entries, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = [Approximation(b) for b in books]
        counts, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for _, x in _parts(batches, "_vector", scale, parts * width):
            codes, _, _ = _assign(x, near)
            for p in range(parts):
                np.add.at(counts, p * entries + codes[:, p], 1)
                np.add.at(sums, p * entries + codes[:, p], x[:, p * width : (p + 1) * width])
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))], ["slot", "count", "sums"])

    told = rows.select("_vector").mapInArrow(add, "slot long, count long, sums array<long>")
    # Sums of all tasks need not fit a long.
    wide = lambda c: F.sum(c.cast("decimal(38,0)"))
    found = told.groupBy("slot").agg(wide(F.col("count")).alias("count"), *(wide(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(width))).collect()
    out = books.copy()
    for r in found:
        out[r["slot"] // entries, r["slot"] % entries] = [int(r[f"s{j}"]) // int(r["count"]) for j in range(width)]
    return out


def encode(vectors: DataFrame, entries: int = 64, parts: int = 16, rounds: int = 2, scale: int = 256, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, np.ndarray | None]:
    """``key, label, code, error, refined`` of each row whose vector is usable, and the codebooks. ``refined`` is the
    number of entries, of entries times parts, that the bounds have left to compare."""
    rows = vectors.select(vectors[key].cast("long").alias("_key"), vectors[label].alias("_label"), vectors[vector].cast("array<double>").alias("_vector")).where(usable(F.col("_vector")))
    blank = [F.lit(None).cast(t).alias(n) for n, t in (("code", "string"), ("error", "long"), ("refined", "int"))]
    started = first_entries(rows, entries, parts, scale)
    if started is None:
        return rows.select(F.col("_key").alias(key), F.col("_label").alias(label), *blank), None
    length, books = started
    fit = rows.where(F.size("_vector") == length)
    for _ in range(rounds):
        books = improved(fit, books, scale)
    width = books.shape[2]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = [Approximation(b) for b in books]
        for part, x in _parts(batches, "_vector", scale, parts * width):
            codes, distances, compared = _assign(x, near)
            texts = pa.array([bytes(c).hex() for c in codes.astype(np.uint8)], pa.string())
            columns = [part.column("_key"), part.column("_label"), texts, pa.array(distances.sum(axis=1)), pa.array(compared.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["_key", "_label", "code", "error", "refined"])

    kind = dict(rows.dtypes)["_label"]
    coded = fit.mapInArrow(code, f"_key long, _label {kind}, code string, error long, refined int")
    other = rows.where(F.size("_vector") != length).select("_key", "_label", *blank)
    return coded.unionAll(other).withColumnsRenamed({"_key": key, "_label": label}), books


def digest(books: np.ndarray | None) -> str:
    """SHA-256 of the decimal components of all entries by part, entry and place, joined by commas."""
    flat = [] if books is None else books.reshape(-1).tolist()
    return hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()


def label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``label_error``, the sum of ``error`` over rows of an equal label (null labels are equal)."""
    # A label may hold a third of all rows: sums are added up in parts, and the join, whose keys are
    # computed anew, deals both sides out, so that adaptive execution can split or broadcast.
    sums = coded.groupBy(F.col(label).alias("_of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    return coded.join(sums, coded[label].eqNullSafe(F.col("_of"))).drop("_of")


def compress(vectors: DataFrame, **options) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of each row with a usable vector."""
    coded, books = encode(vectors, **options)
    key, label = options.get("key", "vec_id"), options.get("label", "label")
    return label_errors(checkpoint(coded), label).select(key, "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
