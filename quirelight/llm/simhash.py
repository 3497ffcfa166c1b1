"""Operator 9: SimHash near-duplicates by tiled exact comparison.

Fingerprints of whole texts are collapsed to distinct ones and packed into tiles of equal size in
order of their population count. Each pair of tiles whose counts can lie within the radius goes to
one task, which compares all their pairs with numpy exclusive-or and bit counts and returns only a
forest of links: never more rows than a tile pair has fingerprints, however large a group of near
copies is. Components are then found over documents' fingerprints and carried to all documents.

Defined results: null and empty texts and texts without words have fingerprint zero and are linked
like any other; rows of one doc_id are separate documents; a null doc_id takes part but never
names a component unless all its documents are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.llm.common import ASCII_LOWER, checkpoint, dealt_again, map_batches
from quirelight.llm.components import components, least_labels

#: Fingerprints in a tile at least and at most; between, as many tiles as TILES.
LEAST_TILE, MOST_TILE, TILES = 4096, 1 << 17, 12
#: Comparisons held in memory at once.
BLOCK = 1 << 18


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash over all word shingles, repeats included."""
    words = (text or "").encode().translate(ASCII_LOWER).split()
    if not words:
        return 0
    body = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    count = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(body[s:e], seed) for s, e in zip(starts[:count].tolist(), last.tolist())), np.uint64, count)
    votes = np.zeros(64, np.int64)
    for at in range(0, count, 65536):
        votes += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42, text: str = "text", key: str = "doc_id", kind: str = "long") -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long, the id cast to ``kind``."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = np.array([fingerprint(t, width, seed) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(own)], ["doc_id", "fp"])

    return map_batches(docs.select(docs[key].cast(kind).alias("doc_id"), docs[text].alias("text")), kernel, f"doc_id {kind}, fp long")


def compare(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> np.ndarray:
    """Labels over the concatenation of both tiles: smallest index linked within the tile pair."""
    labels = np.arange(len(a) + (0 if same else len(b)))
    shift = 0 if same else len(a)
    step = max(1, BLOCK // max(1, len(b)))
    counts_b = np.bitwise_count(b)
    for at in range(0, len(a), step):
        rows = a[at : at + step]
        counts = np.bitwise_count(rows)
        # Both tiles are in order of their bit counts.
        low = np.searchsorted(counts_b, max(0, int(counts[0]) - radius))
        high = np.searchsorted(counts_b, int(counts[-1]) + radius, "right")
        if same:
            low = max(low, at)
        if low >= high:
            continue
        near = np.bitwise_count(rows[:, None] ^ b[None, low:high]) <= radius
        x, y = np.nonzero(near)
        least_labels(labels, x + at, y + low + shift)
    return labels


def _tiles(distinct: DataFrame) -> DataFrame:
    """``tile, least, most, body``: fingerprints in order of bit count, packed."""
    histogram = sorted((r[0], r[1]) for r in distinct.groupBy(F.bit_count("fp").alias("bits")).count().collect())  # 65 rows at most
    total = sum(n for _, n in histogram)
    size = min(MOST_TILE, max(LEAST_TILE, -(-total // TILES)))
    # Each bit count is cut into as many parts as it takes to stay within a tile, and small
    # neighbours share a tile.
    cuts, tile, room = [], -1, 0
    for bits, n in histogram:
        parts = -(-n // size)
        if parts > 1 or n > room:
            tile, room = tile + 1, size
        cuts.append(F.when(F.bit_count("fp") == bits, F.lit(tile) + F.pmod(F.xxhash64("fp"), F.lit(parts)).cast("int")))
        tile, room = tile + parts - 1, (room - n if parts == 1 else 0)
    number = F.coalesce(*cuts) if cuts else F.lit(0)
    dealt = distinct.select("fp", number.alias("tile")).groupBy("tile")

    def pack(table: pa.Table) -> pa.Table:
        own = table.column("fp").to_numpy().view(np.uint64)
        bits = np.bitwise_count(own)
        own = own[np.lexsort((own, bits))]
        return pa.table({"tile": table.column("tile").slice(0, 1), "least": pa.array([int(bits.min())], pa.int32()), "most": pa.array([int(bits.max())], pa.int32()), "body": pa.array([own.tobytes()], pa.binary())})

    return dealt.applyInArrow(pack, "tile int, least int, most int, body binary")


def tile_pairs(tiles: DataFrame, radius: int) -> DataFrame:
    """``i, j`` (i <= j) of tiles some of whose bit counts can lie within the radius: tiles meet at each
    bit count that one has and the other has or comes near to, 65 at most."""
    left = tiles.select(F.col("tile").alias("i"), F.explode(F.sequence(F.col("least") - radius, F.col("most") + radius)).alias("bits"))
    right = tiles.select(F.col("tile").alias("j"), F.explode(F.sequence("least", "most")).alias("bits"))
    return left.join(right, "bits").where("i <= j").select("i", "j").distinct()


def links(fps: DataFrame, radius: int) -> DataFrame:
    """A forest (a, b) of distinct fingerprints that differ in at most ``radius`` bits."""
    tiles = checkpoint(_tiles(fps.select("fp").distinct()))
    pairs = checkpoint(tile_pairs(tiles, radius))
    number = pairs.count()
    left = tiles.select(F.col("tile").alias("i"), F.col("body").alias("left"))
    right = tiles.select(F.col("tile").alias("j"), F.col("body").alias("right"))
    # About as many tasks as tile pairs, up to many for each core of the cluster.
    tasks = max(1, min(number, max(4096, 64 * fps.sparkSession.sparkContext.defaultParallelism)))
    work = pairs.join(left, "i").join(right, "j").repartition(tasks, "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, x, y in zip(*(batch.column(n).to_pylist() for n in ("i", "j", "left", "right"))):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                labels = compare(a, b, radius, i == j)
                every = a if i == j else np.concatenate([a, b])
                linked = np.flatnonzero(labels != np.arange(len(labels)))
                yield pa.RecordBatch.from_arrays([pa.array(every[linked].view(np.int64)), pa.array(every[labels[linked]].view(np.int64))], ["a", "b"])

    return work.select("i", "j", "left", "right").mapInArrow(run, "a long, b long")


def _named(marked: DataFrame, radius: int) -> DataFrame:
    """``fp, component`` of every fingerprint of ``marked``."""
    found = components(links(marked, radius)).select(F.col("node").alias("fp_of_node"), "component")
    fps = marked.select("fp").distinct()
    return fps.join(found, fps["fp"] == found["fp_of_node"], "left").select("fp", F.coalesce("component", "fp").alias("component"))


def one_of_each(docs: DataFrame, radius: int = 4, width: int = 4, seed: int = 42, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, that of the smallest doc_id (nulls
    last) and then of the smallest hash of the row. Names ending in ``_of_row`` are used inside."""
    first, second = (F.xxhash64(F.lit(i), *[docs[c] for c in docs.columns]) for i in (1, 2))
    own = docs.withColumns({"hi_of_row": first, "lo_of_row": second})
    ids = F.struct(own[key].isNull().alias("none"), own[key].cast("long").alias("id"), F.col("hi_of_row").alias("hi"), F.col("lo_of_row").alias("lo"))
    marked = checkpoint(fingerprints(own.withColumn("id_of_row", ids), width, seed, text, "id_of_row", "struct<none:boolean,id:long,hi:long,lo:long>"))
    # By fingerprint first, so that a large group of copies is a few rows in the join.
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    stay = classes.join(_named(marked, radius), "fp").groupBy("component").agg(F.min("first").alias("first"))
    stay = stay.select(F.col("first.hi").alias("hi_of_row"), F.col("first.lo").alias("lo_of_row"))
    return own.join(stay, ["hi_of_row", "lo_of_row"], "left_semi").dropDuplicates(["hi_of_row", "lo_of_row"]).select(*docs.columns)


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, seed: int = 42, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, fp, component_id`` (smallest doc_id reachable)."""
    marked = checkpoint(fingerprints(docs, width, seed, text, key))
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(links(marked, radius)).select(F.col("node").alias("fp"), "component")
    named = classes.join(found, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    by_fp = named.join(dealt_again(least, "component"), "component").select("fp", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")
