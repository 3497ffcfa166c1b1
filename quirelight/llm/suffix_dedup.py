"""Operator 2: removal of repeated passages with suffix arrays built by difference cover.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Each string has
an anchor, its short gram of least hash, and equal strings have equal ones at the same place, so that

1. anchors' grams are counted over the corpus; a string whose anchor occurs once cannot repeat;
2. what is left is cut into items: the strings of one and the same anchor, as one stretch of text;
   items of equal text are collapsed and counted;
3. different items of one gram meet in a task, which builds the suffix array of their text by the
   difference-cover method (`suffixes.suffix_array`) and compares adjacent suffixes;
4. items of a gram with over ``HOT`` occurrences, too many for one task, are compared by 128-bit
   hashes of their strings instead, summed before they are shuffled; so are, within their task, those
   of a gram with more than ``SORT_BYTES`` of different text;
5. documents get their marks back and drop the covered bytes.

Steps 1 and 2 lose no repeat; they keep the suffix sort, which would take many times the input on
disk, to text that can matter.

Defined results: a null text counts as empty; matches never cross documents; rows that repeat
count as separate documents (their texts repeat each other); texts shorter than ``length`` stay; an
empty table gives an empty result; texts need not be UTF-8 after removal, which is why the kept
text is binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.llm import suffixes
from quirelight.llm.common import checkpoint, dealt_again, map_batches, slices

LENGTH, GRAM_POWER = 200, 5
GRAM = 1 << GRAM_POWER
#: Occurrences of a gram beyond which its items are too many for one task.
HOT = 1 << 15
#: Bytes whose suffixes a task sorts at once; a gram with more compares hashes of its strings.
SORT_BYTES = 2 << 20
NO_ID = -(1 << 63)
#: Bytes of texts hashed together.
TOGETHER = 1 << 15


def _packed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``doc, mark, body``: id, hash of the text (rows of one id are told apart by it), and the
    compressed text, so that less is moved."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        own = [(t or "").encode() for t in batch.column(1).to_pylist()]
        marks = [xxhash.xxh64_intdigest(t) - (1 << 63) for t in own]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64()), pa.array([squeeze(t) for t in own], pa.binary())], ["doc", "mark", "body"])

    return map_batches(docs.select(F.coalesce(docs[key].cast("long"), F.lit(NO_ID)).alias("doc"), docs[text].alias("text")), kernel, "doc long, mark long, body binary")


def _anchors_of(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For each text, places and grams of the anchors of all its strings, and first start and number
    of the strings of each. Short texts are hashed together, as windows never look outside one."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= TOGETHER):
            size += len(texts[stop])
            stop += 1
        part = texts[at:stop]
        data = np.frombuffer(b"".join(part), np.uint8)
        ends = np.cumsum([len(t) for t in part])
        begins = np.concatenate([[0], ends[:-1]])
        hashes = suffixes.gram_hashes(data, GRAM_POWER) if size >= length else np.zeros(0, np.uint64)
        inside = np.ones(max(0, size - length + 1), bool)
        for e in ends[:-1].tolist():
            inside[max(0, e - length + 1) : e] = False
        place, low, starts = suffixes.anchors(hashes, length - GRAM + 1, inside)
        grams = hashes[place].view(np.int64)
        cuts = np.searchsorted(low, ends)
        for b, first, last in zip(begins.tolist(), [0, *cuts[:-1].tolist()], cuts.tolist()):
            yield place[first:last] - b, grams[first:last], low[first:last] - b, starts[first:last]
        at = stop


def _anchors(docs: DataFrame, length: int, text: str, key: str) -> DataFrame:
    """``gram, doc, mark, pos`` of all anchors."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        grams, places, rows, marks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], []
        texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
        for data, (at, gram, _, _) in zip(texts, _anchors_of(texts, length)):
            grams.append(gram)
            places.append(at)
            rows.append(len(at))
            marks.append(xxhash.xxh64_intdigest(data) - (1 << 63) if len(at) else 0)
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams)), pa.array(np.repeat(ids, rows).astype(np.int64)), pa.array(np.repeat(np.array(marks, np.int64), rows)), pa.array(np.concatenate(places).astype(np.int32))], ["gram", "doc", "mark", "pos"])

    return map_batches(docs.select(F.coalesce(docs[key].cast("long"), F.lit(NO_ID)).alias("doc"), docs[text].alias("text")), kernel, "gram long, doc long, mark long, pos int")


def items_of(texts: list[bytes], places: list[list[int]], length: int) -> Iterator[list[tuple[int, bool, int, int]]]:
    """For each text, (gram, hot, first start, number of starts) of the strings whose anchor's gram
    repeats; ``places``: twice the anchor's place, and 1 more if its gram is hot."""
    for own, (at, gram, low, starts) in zip(places, _anchors_of(texts, length)):
        own = np.sort(np.array(own, np.int64))
        rows = np.searchsorted(at, own >> 1)
        yield list(zip(gram[rows].tolist(), (own & 1).astype(bool).tolist(), low[rows].tolist(), starts[rows].tolist()))


def _items(flagged: DataFrame, packed: DataFrame, length: int, with_text: bool) -> DataFrame:
    """One row per item: ``gram, item, hot, doc, mark, low, starts`` and its text."""
    schema = "gram long, item long, hot boolean, doc long, mark long, low int, starts int" + ", body binary" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at, stop in slices(batch, 1 << 18):  # bounds the rows held, as items are longer than their text
                out: list[list] = [[] for _ in range(7 + with_text)]
                docs, marks, bodies, places = (c.to_pylist() for c in batch.slice(at, stop - at).columns)
                texts = [open_(b) for b in bodies]
                for doc, mark, data, found in zip(docs, marks, texts, items_of(texts, places, length)):
                    for g, is_hot, low, starts in found:
                        own = data[low : low + starts + length - 1]
                        for column, v in zip(out, (g, xxhash.xxh64_intdigest(own) - (1 << 63), is_hot, doc, mark, low, starts, own)):
                            column.append(v)
                types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], [x.split()[0] for x in schema.split(", ")])

    joined = packed.join(flagged, ["doc", "mark"]).select("doc", "mark", "body", "places")
    return joined.mapInArrow(run, schema)


def _marks(starts: np.ndarray) -> bytes:
    return np.packbits(starts, bitorder="little").tobytes()


def _compare(length: int):
    """Marks of the different items of each gram, by suffix arrays of a few megabytes at a time.
    Items that occur twice (whole) take part but need no marks; those without marks get no row."""

    def marked(held: list[tuple[int, int, bool, bytes]], found: list[np.ndarray]) -> pa.RecordBatch:
        rows = [(g, item, _marks(f)) for (g, item, whole, _), f in zip(held, found) if not whole and f.any()]
        types = (pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["gram", "item", "found"])

    def flush(held: list[tuple[int, int, bool, bytes]]) -> pa.RecordBatch:
        bodies = [h[3] for h in held]
        sizes = np.array([len(b) for b in bodies])
        data = np.frombuffer(b"".join(b + b"\0" for b in bodies), np.uint8)
        first = np.cumsum(sizes + 1) - sizes - 1
        symbols = data.astype(np.int64) + 2
        symbols[first + sizes] = 1  # between items
        valid = np.ones(len(data), bool)
        for s, n in zip(first.tolist(), sizes.tolist()):
            valid[s + n - length + 1 : s + n + 1] = False
        order = suffixes.suffix_array(symbols)
        found = suffixes.repeats(data, order[valid[order]], length)
        return marked(held, [found[s : s + n - length + 1] for s, n in zip(first.tolist(), sizes.tolist())])

    def by_hash(held: list[tuple[int, int, bool, bytes]]) -> pa.RecordBatch:
        bodies = [h[3] for h in held]
        counts = [len(b) - length + 1 for b in bodies]
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b[k : k + length]) for b, n in zip(bodies, counts) for k in range(n)), "V16")
        _, back, times = np.unique(digests, return_inverse=True, return_counts=True)
        return marked(held, np.split(times[back] > 1, np.cumsum(counts)[:-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[int, int, bool, bytes]] = []
        held: list[tuple[int, int, bool, bytes]] = []
        size = 0

        def ended() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            own = sum(len(g[3]) for g in group)
            if len(group) < 2:  # a single item has nothing to compare with
                return
            if own > SORT_BYTES:
                yield by_hash(group)
                return
            if size + own > SORT_BYTES:
                yield flush(held)
                held, size = [], 0
            held += group
            size += own

        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("gram", "item", "whole", "body"))):
                if group and group[-1][0] != row[0]:
                    yield from ended()
                    group = []
                group.append(row)
        yield from ended()
        if held:
            yield flush(held)

    return run


def _strings(length: int):
    """``w1, w2, gram, item, whole, offset`` of every string of an item."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(6)]
        for g, item, whole, body in zip(*(batch.column(n).to_pylist() for n in ("gram", "item", "whole", "body"))):
            for k in range(len(body) - length + 1):
                h = xxhash.xxh3_128_intdigest(body[k : k + length])
                for column, v in zip(out, ((h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), g, item, whole, k)):
                    column.append(v)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["w1", "w2", "gram", "item", "whole", "offset"])

    return kernel


def repeated(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The packed documents, and ``doc, mark, spans``: lists of (low, starts, found) whose marked
    starts begin strings that occur elsewhere; ``found`` is null if all do."""
    anchors = _anchors(docs, length, text, key)
    grams = anchors.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("gram", (F.col("n") > HOT).cast("int").alias("hot"))
    flagged = checkpoint(anchors.join(dealt_again(grams, "gram"), "gram").groupBy("doc", "mark").agg(F.collect_set(F.col("pos").cast("long") * 2 + F.col("hot")).alias("places")))
    packed = _packed(docs, text, key)
    texts = _items(flagged, packed, length, True)
    distinct = texts.groupBy("gram", "item").agg((F.count("*") > 1).alias("whole"), F.max("hot").alias("hot"), F.first("body").alias("body"))
    cold = distinct.where(~F.col("hot")).select("gram", "item", "whole", "body").repartition("gram").sortWithinPartitions("gram").mapInArrow(_compare(length), "gram long, item long, found binary")
    strings = map_batches(distinct.where("hot").select("gram", "item", "whole", "body"), _strings(length), "w1 long, w2 long, gram long, item long, whole boolean, offset int")
    shared = strings.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2")
    offsets = strings.where(~F.col("whole")).join(dealt_again(shared, "w1", "w2"), ["w1", "w2"]).groupBy("gram", "item").agg(F.sort_array(F.collect_set("offset")).alias("offsets"))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for own in batch.column(2).to_pylist():
            bits = np.zeros(max(own) + 1, bool)
            bits[own] = True
            out.append(_marks(bits))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["gram", "item", "found"])

    hot = map_batches(offsets, kernel, "gram long, item long, found binary")
    copies = distinct.where("whole").select("gram", "item", F.lit(None).cast("binary").alias("found"))
    found = copies.unionAll(cold).unionAll(hot)  # one row an item, as each comes from one of the three
    light = _items(flagged, packed, length, False)
    spans = light.join(found, ["gram", "item"]).select("doc", "mark", F.struct("low", "starts", "found").alias("span"))
    return packed, spans.groupBy("doc", "mark").agg(F.collect_set("span").alias("spans"))


def covered(size: int, spans: list[dict], length: int) -> np.ndarray:
    """Which of ``size`` bytes are in a string that starts at a marked position."""
    change = np.zeros(size + 1, np.int32)
    for s in spans:
        if s["found"] is None:
            change[s["low"]] += 1
            change[s["low"] + s["starts"] - 1 + length] -= 1
        else:
            at = s["low"] + np.flatnonzero(np.unpackbits(np.frombuffer(s["found"], np.uint8), bitorder="little")[: s["starts"]])
            np.add.at(change, at, 1)
            np.add.at(change, at + length, -1)
    return np.cumsum(change[:size]) > 0


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id", with_text: bool = True) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and the kept bytes."""
    packed, spans = repeated(docs, length, text, key)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = []
                for doc, body, spans in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns)):
                    data = open_(body)
                    gone = covered(len(data), spans or [], length)
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if gone.any() else data
                    runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
                    row = {"doc_id": None if doc == NO_ID else doc, "n_bytes": len(data), "n_removed": len(data) - len(kept), "n_spans": runs, "kept_sha256": hashlib.sha256(kept).hexdigest()}
                    rows.append(row | {"kept": kept} if with_text else row)
                fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
                yield pa.RecordBatch.from_pylist(rows, pa.schema(fields + [("kept", pa.binary())] * with_text))

    return packed.join(spans, ["doc", "mark"], "left").select("doc", "body", "spans").mapInArrow(run, schema)
