"""Operator 11: whitening of embeddings by matrix-free block subspace iteration.

Entries c become integers x = floor(64 c) + 1000000. The distinct vectors of these are the fit list; its
count n, its sums S and, from them, the centre S / n are exact. The leading eigenvectors of its
covariance V are found without V: a block Q of orthonormal columns starts at random, each Spark pass over the fit
list computes V Q as the sum of (x - S/n) ((x - S/n)' Q) / n, and the driver, which only ever holds matrices of
length x block, does Rayleigh-Ritz on Q' V Q and takes QR of V Q as the next block. The same pass
gives the residuals |V u - e u| of the Ritz pairs, and the passes go on until those of all wanted components are
at rounding level. If residuals fall slowly, since eigenvalues lie close together, the block
doubles (up to the length of the vectors, when the space is whole and the next pass ends it).

One more pass over the fit list measures the covariance of the whitened vectors themselves; a last scan of
the input whitens every row, copies included.

The fit list is deduplicated by grouping, with copies collapsed in the scan, and checkpointed in blocks of packed rows. Tasks
return one matrix each, row by row, and rows are added up by the executors.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped, and so
are empty vectors and those of another length than the commonest among distinct vectors (of equally common
ones the longer). Repeated rows count once in the fit and are all whitened. Components whose eigenvalue is
below 1e-12 of the trace are not returned, since dividing by them gives noise; there are none if all vectors are equal, and none
of an empty table. Products 64 c beyond 2**40 either way count as that. A deviation beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.llm.common import checkpoint
from quirelight.llm.vector_codes import usable

SCALE, SHIFT, LARGEST = 64, 1_000_000, 1 << 40
#: Rows of a block of the fit list, and rows whitened at once.
ROWS = 4096
#: Residuals over the largest eigenvalue at which the iteration ends, and at which it may end when they fall no more.
TOLERANCE, SETTLED = 1e-14, 1e-11
#: Passes after which the iteration fails rather than return components that are not certified.
PASSES = 200


@dataclass
class Whitening:
    """Everything a row needs to be whitened; matrices of length x components."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float
    passes: int


def _integers(vector) -> F.Column:
    return F.transform(vector, lambda c: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), c.cast("double") * SCALE))).cast("long") + SHIFT)


def _usable_rows(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    rows = vectors.select(vectors[key].cast("long").alias("_key"), vectors[vector].cast("array<double>").alias("_vector"))
    return rows.where(usable(F.col("_vector")) & (F.size("_vector") > 0)).select("_key", _integers("_vector").alias("_x"))


def fit_list(rows: DataFrame) -> DataFrame:
    """``width, rows, body, sums`` of blocks of the distinct vectors, as packed integers without SHIFT."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column(0).offsets.to_numpy())
            for width in np.unique(lengths).tolist():
                own = batch.column(0).take(pa.array(np.flatnonzero(lengths == width)))
                whole = own.flatten().to_numpy().reshape(-1, width) - SHIFT
                for at in range(0, len(whole), ROWS):
                    x = whole[at : at + ROWS]
                    small = x.astype(np.int32) if np.abs(x).max() < 1 << 31 else x
                    body = pa.array([small.tobytes()], pa.binary())
                    sums = pa.array([(x.sum(axis=0) + SHIFT * len(x)).tolist()], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([len(x)], pa.int64()), body, sums], ["width", "rows", "body", "sums"])

    return checkpoint(rows.select("_x").distinct().mapInArrow(pack, "width int, rows long, body binary, sums array<long>"))


def _centred(body: bytes, rows: int, width: int, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x - S/n, with the integer part of S/n taken off before the rest, so that nothing is rounded early."""
    kind = np.int32 if len(body) == 4 * rows * width else np.int64
    return (np.frombuffer(body, kind).reshape(rows, width).astype(np.int64) + SHIFT - whole) - rest


def _added(told: DataFrame, columns: int) -> np.ndarray:
    """The sum of matrices that tasks have told row by row (``i``, ``values``), added up in the executors."""
    found = told.groupBy("i").agg(*(F.sum(F.get("values", F.lit(j))).alias(f"v{j}") for j in range(columns))).collect()
    out = np.zeros((max(r["i"] for r in found) + 1, columns))
    for r in found:
        out[r["i"]] = [r[f"v{j}"] for j in range(columns)]
    return out


def _pass(blocks: DataFrame, width: int, whole: np.ndarray, rest: np.ndarray, product) -> np.ndarray:
    """The sum over the fit list of product(centred rows), a matrix."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for rows, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = product(_centred(body.as_py(), rows, width, whole, rest))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))], ["i", "values"])

    # The number of columns is that of the product of no rows.
    return _added(blocks.select("rows", "body").mapInArrow(add, "i long, values array<double>"), product(np.zeros((0, width))).shape[1])


def fit(blocks: DataFrame, components: int = 16, seed: int = 3) -> Whitening | None:
    """The components of the fit list with their certificate; None without rows."""
    sizes = blocks.groupBy("width").agg(F.sum("rows").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if not sizes:
        return None
    width, n = sizes["width"], sizes["n"]
    blocks = blocks.where(F.col("width") == width)
    places = blocks.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sums = [0] * width
    for r in places:
        sums[r["i"]] = int(r["s"])
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])

    trace = float(_pass(blocks, width, whole, rest, lambda x: np.square(x).sum(axis=0)[:, None]).sum()) / n
    wanted = min(components, width)
    if trace == 0:
        return Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), np.zeros(0), 0.0, 0)
    rng = np.random.default_rng(seed)
    block = np.linalg.qr(rng.standard_normal((width, min(width, 2 * wanted))))[0]
    before = np.inf
    for passes in range(1, PASSES + 1):
        image = _pass(blocks, width, whole, rest, lambda x, q=block: x.T @ (x @ q)) / n
        small = block.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)
        values, turn = values[order], turn[:, order]
        vectors, image = block @ turn, image @ turn
        residual = np.linalg.norm(image[:, :wanted] - vectors[:, :wanted] * values[:wanted], axis=0).max() / values[0]
        if residual <= TOLERANCE or residual <= SETTLED and residual > before / 4:
            break
        # Directions of no variance are replaced by random ones, which QR makes orthogonal to the others.
        image[:, values <= 1e-14 * values[0]] = rng.standard_normal((width, int((values <= 1e-14 * values[0]).sum())))
        image /= np.linalg.norm(image, axis=0)
        if residual > before / 10 and image.shape[1] < width:
            image = np.concatenate([image, rng.standard_normal((width, min(image.shape[1], width - image.shape[1])))], axis=1)
        before = residual
        block = np.linalg.qr(image)[0]
        block = np.linalg.qr(block)[0]
    else:
        raise ArithmeticError(f"residual {residual:.1e} after {PASSES} passes")
    kept = np.flatnonzero(values[:wanted] > 1e-12 * trace)
    vectors, values = np.linalg.qr(vectors[:, kept])[0] * 1.0, values[kept]
    scaled = vectors / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = x @ scaled
        return np.concatenate([w.T @ w, w.sum(axis=0)[None]])

    found = _pass(blocks, width, whole, rest, moments) / n
    error = float(np.abs(found[:-1] - np.outer(found[-1], found[-1]) - np.eye(len(kept))).max())
    return Whitening(n, sums, vectors, values, values / trace, error, passes)


def apply(rows: DataFrame, found: Whitening) -> DataFrame:
    """``_key, deviation, whitened`` (an array) of each row of the right length."""
    width, n = len(found.sums), found.n
    whole = np.array([s // n for s in found.sums], np.int64)
    left = np.array([s % n for s in found.sums], np.int64)
    scaled = found.vectors / np.sqrt(found.values)

    def deviations(x: np.ndarray) -> list[int | None]:
        # n x - S = n (x - floor(S/n)) - (S mod n); in longs if their squares fit, else in Python's integers.
        away = x - whole
        if float(n) * (np.abs(away).max(initial=0) + 1) < 2.0**31 / max(1.0, np.sqrt(width)):
            return np.square(n * away - left).sum(axis=1).tolist()
        exact = (sum((n * a - b) ** 2 for a, b in zip(row, left.tolist())) for row in away.tolist())
        return [d if d < 1 << 63 else None for d in exact]

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, ROWS):
                batch = whole_batch.slice(at, ROWS)
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, width)
                w = ((x - whole) - left / n) @ scaled
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviations(x), pa.int64()), pa.array(list(w), pa.list_(pa.float64()))], ["_key", "deviation", "whitened"])

    return rows.where(F.size("_x") == width).mapInArrow(whiten, "_key long, deviation long, whitened array<double>")


def whiten(vectors: DataFrame, components: int = 16, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per row of ``vectors`` and component: ``key, component`` (from 1), ``n, deviation, whitened,
    explained, identity_error``."""
    rows = _usable_rows(vectors, key, vector)
    found = fit(fit_list(rows), components)
    if found is None or not len(found.values):
        return rows.where("false").selectExpr(f"_key AS `{key}`", "1 AS component", "0L AS n", "0L AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error")
    explained = F.array(*(F.lit(float(e)) for e in found.explained))
    one = apply(rows, found).select("_key", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return one.select(
        F.col("_key").alias(key), (F.col("place") + 1).alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("place")).alias("explained"), F.lit(found.identity_error).alias("identity_error")
    )
