"""Operator 4: exact deduplication by Patricia tries, owned by length and content hash.

Texts are normalised (A-Z lower-cased), collapsed within each slice of a scan, and sent to the
owner of their length and content hash. Owners read them in that order and insert the full byte
strings into a compressed radix trie whose terminal nodes hold the surviving identifier and the
number of rows; a trie that holds enough bytes, those of its nodes included, is written out and dropped
between two branches (length, hash), so that memory is bounded and Spark's sorter does the spilling,
by subtree: texts of one branch are equal or share a 64-bit hash.

Defined results: a null text counts as empty; rows that repeat count each; a null doc_id never
survives unless all of its group are null, and then keep_id is null and kept false.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.llm.common import ASCII_LOWER, ascii_lower, map_batches

#: Bytes that an owner's trie holds before it is written out at the next branch, and what a node takes
#: beside its label: the object, its label's header, its table of children and its entry in one.
TRIE_BYTES, NODE_BYTES = 64 << 20, 400


class Node:
    __slots__ = ("label", "children", "best", "rows")

    def __init__(self, label: bytes):
        self.label, self.children, self.best, self.rows = label, None, None, 0


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and of ``b`` from ``at`` on, by halving."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if b.startswith(a[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """Compressed radix trie of byte strings; ``better`` chooses between two identifiers. ``bytes`` is
    what it holds in memory, nodes included."""

    def __init__(self, better=max):
        self.root, self.bytes, self.better = Node(b""), 0, better

    def add(self, key: bytes, identifier: int | None, rows: int = 1) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at]) if node.children else None
            if child is None:
                child = Node(key[at:])
                self.bytes += len(child.label) + NODE_BYTES
                node.children = node.children or {}
                node.children[key[at]] = child
                node, at = child, len(key)
            elif key.startswith(child.label, at):
                node, at = child, at + len(child.label)
            else:
                cut = _common(child.label, key, at)
                upper = Node(child.label[:cut])
                child.label = child.label[cut:]
                self.bytes += NODE_BYTES
                upper.children = {child.label[0]: child}
                node.children[upper.label[0]] = upper
                node, at = upper, at + cut
        known = [x for x in (node.best, identifier) if x is not None]
        node.best = self.better(known) if known else None
        node.rows += rows

    def __iter__(self) -> Iterator[tuple[bytes, int | None, int]]:
        stack = [(self.root, b"")]
        while stack:
            node, prefix = stack.pop()
            whole = prefix + node.label
            if node.rows:
                yield whole, node.best, node.rows
            stack += [(c, whole) for c in (node.children or {}).values()]


def owners(docs: DataFrame, keep: str = "largest", text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per distinct normalised text: ``text_sha256, keep_id, group_size``. ``keep`` is
    largest or smallest."""
    better = {"largest": max, "smallest": min}[keep]

    def collapse(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: dict[bytes, list] = {}
        for number, own in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            entry = seen.setdefault((own or b"").translate(ASCII_LOWER), [None, 0])
            if number is not None:
                entry[0] = number if entry[0] is None else better(entry[0], number)
            entry[1] += 1
        return pa.RecordBatch.from_arrays(
            [
                pa.array([len(b) for b in seen], pa.int64()),
                pa.array([xxhash.xxh64_intdigest(b) - (1 << 63) for b in seen], pa.int64()),
                pa.array(list(seen), pa.binary()),
                pa.array([e[0] for e in seen.values()], pa.int64()),
                pa.array([e[1] for e in seen.values()], pa.int64()),
            ],
            ["n_bytes", "content", "body", "best", "group_rows"],
        )

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, branch = Trie(better), None

        def written() -> pa.RecordBatch:
            found = [(hashlib.sha256(b).hexdigest(), best, rows) for b, best, rows in trie]
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())], ["text_sha256", "keep_id", "group_size"])

        for batch in batches:
            for size, content, body, best, rows in zip(*(c.to_pylist() for c in batch.columns)):
                if (size, content) != branch and trie.bytes > TRIE_BYTES:
                    yield written()
                    trie = Trie(better)
                branch = (size, content)
                trie.add(body, best, rows)
        yield written()

    partial = map_batches(docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")), collapse, "n_bytes long, content long, body binary, best long, group_rows long")
    sent = partial.repartition("n_bytes", "content").sortWithinPartitions("n_bytes", "content")
    return sent.mapInArrow(own, "text_sha256 string, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, keep: str = "largest", text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    marked = docs.select(docs[key].cast("long").alias("doc_id"), F.sha2(ascii_lower(F.coalesce(docs[text], F.lit(""))), 256).alias("text_sha256"))
    return marked.join(owners(docs, keep, text, key), "text_sha256").select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")
