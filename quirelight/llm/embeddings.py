"""Operator 8: near-duplicate embeddings by sorted projection passes.

Equal vectors of a label are collapsed first. Each pass orders the classes by (label, concatenated
random-hyperplane bits) and compares every one with its WINDOW neighbours on each side. Hyperplanes go through
the mean of the label's unit vectors, since vectors with a common direction lie on one side of most others. The rows that
are sorted carry no vectors but their values in one byte each, with the exact error that this makes,
so that a window drops only pairs that cannot reach the threshold. Pairs that remain are collected
over all passes once, fetch their vectors, and are verified in double precision.

How many passes are enough is measured. A first group of passes has as many as vectors without structure would need;
a further group, of hyperplanes of its own, is then a sample of pairs: as long as more than a share of ``fresh`` of its
pairs is new, the next group, twice as large, follows.

A class most of whose window is near, in any pass, stands in a dense group, in which bounded windows
would miss pairs and all pairs would be too many rows. Of such pairs a window tells only a chain;
groups of chained dense classes are compared exactly, in tiles of their vectors, and tell counts and a
forest of links. Verified pairs and these links are united into components.

Defined results: null labels and vectors that are null, zero, or hold null or non-finite components
link with nothing and form their own component; vectors of different lengths never link; rows
that repeat an id link by their own vectors, and equal ones with each other like copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.llm.common import checkpoint, dealt_again
from quirelight.llm.components import components, least_labels

#: Neighbours on each side that a pass compares; a class with as many near ones among both is dense.
WINDOW = 32
#: Bytes of vectors in a tile of a dense group, and rows compared at once.
TILE_BYTES, STEP = 2 << 20, 1024
#: Rows of a window's batch; limits what is held in a task.
BATCH = 8192


def plan_passes(count: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits of a key, and the passes of the first group, for ``count`` vectors of one label: as many as leave a pair
    at the threshold in no common window with probability ``miss``, if vectors have all directions and few neighbours
    (a pair of cosine c then agrees in a bit with probability 1 - arccos(c) / pi)."""
    bits = min(62, max(8, math.ceil(math.log2(max(2, count))) + 8))
    depth = max(0.0, math.log2(max(1, count) / (WINDOW / 2)))
    agree = (1 - math.acos(min(1.0, threshold)) / math.pi) ** depth
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-agree))) if agree < 1 else 1


def near_in_order(values: np.ndarray, factor: np.ndarray, error: np.ndarray, held: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of places (a < b, b not among the first ``held``) to verify, and places of dense rows. A
    row's vector over its length is values * factor but for a difference of length ``error``."""
    n = len(values)
    x = values.astype(np.float32) * factor[:, None]
    near = np.zeros((n, WINDOW + 1), bool)
    chain = np.zeros((n, WINDOW + 1), bool)
    times = np.zeros(n, np.int32)
    after, before = np.zeros(n, bool), np.zeros(n, bool)
    for d in range(1, min(WINDOW, n - 1) + 1):
        a, b = slice(0, n - d), slice(d, n)
        slack = error[a] + error[b] + error[a] * error[b] + 1e-5
        hit = np.einsum("ij,ij->i", x[a], x[b]) + slack >= threshold
        near[a, d] = hit
        times[a] += hit
        times[b] += hit
        chain[a, d] = hit & (~after[a] | ~before[b])
        after[a] |= hit
        before[b] |= hit
    dense = times >= WINDOW
    a, d = np.nonzero(near)
    b = a + d
    told = (b >= held) & (chain[a, d] | ~dense[a] | ~dense[b])
    return a[told], b[told], np.flatnonzero(dense)


def compare_tiles(x: np.ndarray, y: np.ndarray, copies_x: np.ndarray, copies_y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of vectors linked to each row of both tiles (of the first only if they are the ``same``),
    and labels: the smallest place linked within the two."""
    length = lambda m: np.sqrt(np.einsum("ij,ij->i", m, m))
    nx, ny = length(x), length(y)
    shift = 0 if same else len(x)
    labels, counts = np.arange(len(x) + (0 if same else len(y))), np.zeros(len(x) + (0 if same else len(y)), np.int64)
    for at in range(0, len(x), STEP):
        for to in range(at if same else 0, len(y), STEP):
            linked = (x[at : at + STEP] @ y[to : to + STEP].T) / (nx[at : at + STEP, None] * ny[None, to : to + STEP]) >= threshold
            if same and at == to:
                linked = np.triu(linked, 1)
            a, b = np.nonzero(linked)
            a, b = a + at, b + to
            np.add.at(counts, a, copies_y[b])
            np.add.at(counts, b + shift, copies_x[a])
            least_labels(labels, a, b + shift)
    return counts, labels


def _classes(marked: DataFrame) -> DataFrame:
    """``class, first, copies, label, width, body, node``: one row per distinct vector of a label, told
    apart by a number of its own, which the checkpoint fixes."""
    grouped = marked.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, widths = [], []
            for v in batch.column(4).to_pylist():
                x = np.array(v, np.float64)
                largest = np.abs(x).max()
                # Squares stay finite, and single precision as it is; no cosine depends on the scale.
                bodies.append((x if 1e-100 < largest < 1e100 else x / largest).tobytes())
                widths.append(len(x))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(widths, pa.int32()), pa.array(bodies, pa.binary())], ["class", "first", "copies", "label", "width", "body"])

    packed = grouped.mapInArrow(pack, "class string, first long, copies long, label string, width int, body binary")
    return checkpoint(packed.withColumns({"node": F.monotonically_increasing_id(), "room": F.xxhash64("label", "width")}))


def _unit(body: list[bytes], width: int) -> np.ndarray:
    x = np.frombuffer(b"".join(body), np.float64).reshape(-1, width)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _centred(classes: DataFrame) -> DataFrame:
    """``room, node, width, body, centre``: each class with the mean of its label's unit vectors. Tasks add up what
    they have of a label, and a label's sums, one a task, meet by name."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}

        def told() -> pa.RecordBatch:
            rooms, bodies = [k[0] for k in sums], [v.tobytes() for v in sums.values()]
            return pa.RecordBatch.from_arrays([pa.array(rooms, pa.int64()), pa.array(bodies, pa.binary())], ["room", "sums"])

        for batch in batches:
            rooms, widths = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for room, width in set(zip(rooms.tolist(), widths.tolist())):
                own = _unit(batch.column(2).filter(pa.array((rooms == room) & (widths == width))).to_pylist(), width)
                part = np.append(own.sum(axis=0), len(own))
                sums[room, width] = sums[room, width] + part if (room, width) in sums else part
            if len(sums) > 1000:
                yield told()
                sums.clear()
        yield told()

    def mean(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in table.column("sums").to_pylist())
        return pa.table({"room": table.column("room").slice(0, 1), "centre": pa.array([(total[:-1] / total[-1]).tobytes()], pa.binary())})

    told = classes.select("room", "width", "body").mapInArrow(add, "room long, sums binary")
    means = told.groupBy("room").applyInArrow(mean, "room long, centre binary")
    return classes.select("room", "node", "width", "body").join(dealt_again(means, "room"), "room")


def _sorted_rows(centred: DataFrame, bits: int, passes: range, seed: int) -> DataFrame:
    """``pass, room, sort_key, node, q, factor, error`` of each class in each pass, in order."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = np.left_shift(np.int64(1), np.arange(bits - 1, -1, -1))
        for batch in batches:
            widths = batch.column(2).to_numpy()
            for width in np.unique(widths).tolist():
                part = batch.take(pa.array(np.flatnonzero(widths == width)))
                x = np.frombuffer(b"".join(part.column(3).to_pylist()), np.float64).reshape(-1, width)
                away = _unit(part.column(3).to_pylist(), width) - np.frombuffer(b"".join(part.column(4).to_pylist()), np.float64).reshape(-1, width)
                step = np.abs(x).max(1) / 127
                q = np.rint(x / step[:, None])
                length = np.sqrt(np.einsum("ij,ij->i", x, x))
                factor = step / length
                error = np.sqrt(np.square(x / length[:, None] - q * factor[:, None]).sum(1))
                packed = pa.array([r.tobytes() for r in q.astype(np.int8)], pa.binary())
                for k in passes:
                    planes = np.random.default_rng([seed, k, width]).standard_normal((width, bits))
                    keys = ((away @ planes) > 0) @ powers
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), k, np.int32)), part.column(0), pa.array(keys), part.column(1), packed, pa.array(factor.astype(np.float32)), pa.array(error.astype(np.float32))],
                        ["pass", "room", "sort_key", "node", "q", "factor", "error"],
                    )

    order = ["pass", "room", "sort_key", "node"]
    rows = centred.select("room", "node", "width", "body", "centre").mapInArrow(project, "pass int, room long, sort_key long, node long, q binary, factor float, error float")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def _windows(threshold: float):
    """``a, b`` of pairs to verify, and rows with b null for dense classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last rows of the same pass and room
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                number, room, node, factor, error = (batch.column(n).to_numpy() for n in ("pass", "room", "node", "factor", "error"))
                q = batch.column("q").to_pylist()
                widths = np.fromiter(map(len, q), np.int64, len(q))
                edges = np.flatnonzero((np.diff(number) != 0) | (np.diff(room) != 0) | (np.diff(widths) != 0)) + 1
                for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), len(q)]):
                    own = (node[start:stop], np.frombuffer(b"".join(q[start:stop]), np.int8).reshape(stop - start, -1), factor[start:stop], error[start:stop])
                    place = (number[start], room[start], widths[start])
                    before = 0
                    if held and held[0] == place:
                        before = len(held[1][0])
                        own = tuple(np.concatenate(x) for x in zip(held[1], own))
                    a, b, dense = near_in_order(own[1], own[2], own[3], before, threshold)
                    held = (place, tuple(x[-WINDOW:] for x in own))
                    if len(a) or len(dense):
                        nodes = own[0]
                        left = np.concatenate([np.minimum(nodes[a], nodes[b]), nodes[dense]])
                        right = pa.array(np.concatenate([np.maximum(nodes[a], nodes[b]), nodes[dense]]), mask=np.arange(len(left)) >= len(a))
                        yield pa.RecordBatch.from_arrays([pa.array(left), right], ["a", "b"])

    return run


def _verified(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """``a, b, copies_a, copies_b`` of the pairs whose cosine reaches the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                keep = []
                for x, y in zip(part.column("body_a").to_pylist(), part.column("body_b").to_pylist()):
                    u, v = np.frombuffer(x, np.float64), np.frombuffer(y, np.float64)
                    keep.append(len(u) == len(v) and u @ v / (math.sqrt(u @ u) * math.sqrt(v @ v)) >= threshold)
                yield pa.RecordBatch.from_arrays([part.column(n) for n in ("a", "b", "copies_a", "copies_b")], ["a", "b", "copies_a", "copies_b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda n: classes.select(F.col("node").alias(n), F.col("label").alias(f"label_{n}"), F.col("copies").alias(f"copies_{n}"), F.col("body").alias(f"body_{n}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where("label_a = label_b")
    return joined.select("a", "b", "copies_a", "copies_b", "body_a", "body_b").mapInArrow(check, "a long, b long, copies_a long, copies_b long")


def _dense_links(chained: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """``node, links, root`` from exact comparison of all dense classes that ``chained`` (a, b) connects."""
    group = checkpoint(components(chained).join(classes.select("node", "label", "width", "copies", "body"), "node"))
    sizes = group.groupBy("component", "label", "width").agg((F.ceil(F.sum(F.octet_length("body") + 16) / TILE_BYTES)).cast("int").alias("parts"))
    keys = ["component", "label", "width"]
    dealt = group.join(F.broadcast(sizes) if sizes.count() < 100_000 else sizes, keys).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        joined = {n: pa.array([table.column(n).to_numpy().tobytes()], pa.binary()) for n in ("node", "copies")}
        first = {n: table.column(n).slice(0, 1) for n in (*keys, "part", "parts")}
        return pa.table({**first, "nodes": joined["node"], "copies": joined["copies"], "body": pa.array([b"".join(table.column("body").to_pylist())], pa.binary())})

    tiles = checkpoint(
        dealt.select(*keys, "part", "parts", "node", "copies", "body").groupBy(*keys, "part").applyInArrow(pack, "component long, label string, width int, part int, parts int, nodes binary, copies binary, body binary")
    )
    pairs = tiles.select(*keys, F.col("part").alias("i"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("j"))
    side = lambda n: tiles.select(*keys, F.col("part").alias(n), *(F.col(c).alias(f"{c}_{n}") for c in ("nodes", "copies", "body")))
    work = pairs.join(side("i"), [*keys, "i"]).join(side("j"), [*keys, "j"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                same = row["i"] == row["j"]
                nodes, copies = ([np.frombuffer(row[f"{c}_{n}"], np.int64) for n in "ij"] for c in ("nodes", "copies"))
                x, y = (np.frombuffer(row[f"body_{n}"], np.float64).reshape(-1, row["width"]) for n in "ij")
                counts, labels = compare_tiles(x, y, *copies, threshold, same)
                every = nodes[0] if same else np.concatenate(nodes)
                told = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(every[told]), pa.array(counts[told]), pa.array(every[labels[told]])], ["node", "links", "root"])

    dealt_pairs = work.select("width", "i", "j", *(f"{c}_{n}" for c in ("nodes", "copies", "body") for n in "ij"))
    return checkpoint(dealt_pairs.mapInArrow(run, "node long, links long, root long"))


def _collected(classes: DataFrame, threshold: float, miss: float, fresh: float, seed: int) -> DataFrame:
    """``a, b`` of pairs to verify, and rows with b null for dense classes, from as many passes as it takes."""
    bits, first = plan_passes(classes.groupBy("room").count().agg(F.max("count")).first()[0] or 0, threshold, miss)
    centred = checkpoint(_centred(classes))
    group = lambda passes: checkpoint(_sorted_rows(centred, bits, passes, seed).mapInArrow(_windows(threshold), "a long, b long").distinct())
    found, done, size = group(range(first)), first, max(2, first // 3)
    while True:
        more = group(range(done, done + size))
        done, size = done + size, 2 * size
        both = checkpoint(found.unionAll(more).distinct())
        dense = both.where("b IS NULL").select("a").distinct()
        # Pairs of dense classes are told by other means.
        counted = more.where("b IS NOT NULL").join(found.where("b IS NOT NULL").withColumn("seen", F.lit(1)), ["a", "b"], "left")
        for n in "ab":
            counted = counted.join(dense.select(F.col("a").alias(n), F.lit(1).alias(f"dense_{n}")), n, "left")
        total, new = counted.where("dense_a IS NULL OR dense_b IS NULL").agg(F.count("*"), F.count_if(F.col("seen").isNull())).first()
        found = both
        if new <= fresh * total:
            return found


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, miss: float = 1e-2, fresh: float = 2e-3, seed: int = 11, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    raw = vectors.select(vectors[key].cast("long").alias("vec_id"), vectors[label].cast("string").alias("label"), vectors[vector].cast("array<double>").alias("v"))
    fit = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    # -0.0 and 0.0 are one value.
    marked = raw.withColumn("fit", F.coalesce(fit, F.lit(False))).withColumn("v", F.when(F.col("fit"), F.transform("v", lambda x: x + F.lit(0.0))))
    marked = marked.withColumn("class", F.when(F.col("fit"), F.sha2(F.concat_ws("\x00", "label", F.array_join(F.transform("v", lambda x: x.cast("string")), ",")), 256)))
    classes = _classes(marked)
    found = _collected(classes, threshold, miss, fresh, seed)
    dense = found.where("b IS NULL").select(F.col("a").alias("node"))
    pairs = found.where("b IS NOT NULL")
    counted, forest = [], []
    if not dense.isEmpty():
        is_dense = lambda n: dense.select(F.col("node").alias(n), F.lit(True).alias(f"dense_{n}"))
        flagged = pairs.join(is_dense("a"), "a", "left").join(is_dense("b"), "b", "left")
        both = F.coalesce(F.col("dense_a") & F.col("dense_b"), F.lit(False))
        flagged = checkpoint(flagged.select("a", "b", both.alias("both")))
        pairs = flagged.where(~F.col("both")).select("a", "b")
        exact = _dense_links(flagged.where("both").select("a", "b"), classes, threshold)
        counted.append(exact.select("node", "links"))
        forest.append(exact.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = checkpoint(_verified(pairs, classes, threshold))
    counted += [links.select(F.col("a").alias("node"), F.col("copies_b").alias("links")), links.select(F.col("b").alias("node"), F.col("copies_a").alias("links"))]
    forest.append(links.select("a", "b"))
    united = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionAll(united(parts[1:]))
    by_class = (
        classes.select("class", "node", "first", "copies")
        .join(united(counted).groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
        .join(components(united(forest)), "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    least = by_class.groupBy("component").agg(F.min("first").alias("component_id"))
    by_class = by_class.join(dealt_again(least, "component"), "component").select("class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = marked.where(F.col("class").isNotNull()).select("vec_id", "class").join(by_class, "class").select("vec_id", "n_links", "component_id")
    alone = marked.where(F.col("class").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
