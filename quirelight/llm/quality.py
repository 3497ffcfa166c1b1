"""Operator 10: quality classifier, a byte-level convolutional network in numpy.

A text is cut into frames of 8 bytes. Filters over two adjacent frames (16 bytes, half of them
shared with the next filter position) are max-pooled within overlapping chunks that cover the
whole text, 512 bytes each and 256 bytes apart; the mean and the maximum of the chunks' pooled
values are combined into one logit. Training is by Adam on a bounded sample of labelled rows, taken
in order of a hash of their id; only rows whose crc32(doc_id as text) mod 4 is not 2 are learnt from.

Defined results: a null or empty text is one empty frame and gets the score of that; labels other
than 0 and 1 and null ids in labels are ignored; without usable labels of both kinds every score
is 0.5; rows that repeat are scored alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.llm.common import checkpoint, map_batches, slices

#: Labelled rows learnt from at most, and bytes of their texts, epochs over them, rows a step.
TRAIN_ROWS, TRAIN_BYTES, EPOCHS, STEP_ROWS = 2000, 64 << 20, 14, 16
FRAME, DIMS, FILTERS, SEGMENT = 8, 4, 24, 32
#: Frames convolved at once.
BLOCK = 1 << 15


def held_out(key) -> F.Column:
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


def _frames(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each padded with zeros to whole segments, and segments per text."""
    unit = FRAME * SEGMENT
    counts = np.array([max(1, -(-len(t) // unit)) for t in texts], np.int64)
    body = b"".join(t.ljust(int(n) * unit, b"\0") for t, n in zip(texts, counts))
    return np.frombuffer(body, np.uint8), counts


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        scale = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        self.p = {
            "embed": scale(256, DIMS, by=0.5),
            "w1": scale(FRAME * DIMS, FILTERS, by=0.2),
            "w2": scale(FRAME * DIMS, FILTERS, by=0.2),
            "b": np.zeros(FILTERS, np.float32),
            "out": scale(2 * FILTERS, by=0.2),
            "bias": np.zeros(1, np.float32),
        }

    def _pooled(self, body: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Largest value of each filter in each segment; frames of the next text never count."""
        p, unit = self.p, FRAME * SEGMENT
        last = np.zeros(len(body) // unit, bool)
        last[np.cumsum(counts) - 1] = True
        out = np.empty((len(last), FILTERS), np.float32)
        step = BLOCK // SEGMENT
        for at in range(0, len(last), step):
            stop = min(at + step, len(last))
            part = body[at * unit : (stop + 1) * unit]
            x = p["embed"][part].reshape(-1, FRAME * DIMS)
            n = (stop - at) * SEGMENT
            after = np.zeros((n, FILTERS), np.float32)
            right = x @ p["w2"]
            after[: min(n, len(right) - 1)] = right[1 : n + 1]
            ends = np.flatnonzero(last[at:stop]) * SEGMENT + SEGMENT - 1
            after[ends] = p["pad2"] if "pad2" in p else (np.tile(p["embed"][0], FRAME) @ p["w2"])
            values = x[:n] @ p["w1"] + after
            out[at:stop] = values.reshape(-1, SEGMENT, FILTERS).max(1)
        return np.maximum(out + p["b"], 0)

    @staticmethod
    def _chunks(pooled: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Overlapping chunks of two segments each (one if the text has one), and their number."""
        first = np.cumsum(counts) - counts
        last = np.zeros(len(pooled), bool)
        last[first + counts - 1] = True
        single = np.repeat(counts == 1, counts)
        take = np.flatnonzero(~last | single)
        other = np.where(single[take], take, take + 1)
        return np.stack([take, other]), np.maximum(1, counts - 1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        body, counts = _frames(texts)
        pooled = self._pooled(body, counts)
        pair, number = self._chunks(pooled, counts)
        chunks = np.maximum(pooled[pair[0]], pooled[pair[1]])
        starts = np.cumsum(number) - number
        features = np.concatenate([np.add.reduceat(chunks, starts) / number[:, None], np.maximum.reduceat(chunks, starts)], axis=1)
        z = features.astype(np.float64) @ self.p["out"] + self.p["bias"]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def gradients(self, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        body, counts = _frames(texts)
        x = p["embed"][body].reshape(-1, FRAME * DIMS)
        after = np.roll(np.arange(len(x)), -1)
        ends = np.cumsum(counts) * SEGMENT - 1
        x_after = x[after]
        x_after[ends] = np.tile(p["embed"][0], FRAME)
        values = (x @ p["w1"] + x_after @ p["w2"]).reshape(-1, SEGMENT, FILTERS)
        best = values.argmax(1)
        pooled = np.maximum(np.take_along_axis(values, best[:, None], 1)[:, 0] + p["b"], 0)
        pair, number = self._chunks(pooled, counts)
        left = pooled[pair[0]] >= pooled[pair[1]]
        chunks = np.where(left, pooled[pair[0]], pooled[pair[1]])
        starts = np.cumsum(number) - number
        top = np.maximum.reduceat(chunks, starts)
        features = np.concatenate([np.add.reduceat(chunks, starts) / number[:, None], top], axis=1)
        z = features @ p["out"] + p["bias"]
        error = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * weights / weights.sum()).astype(np.float32)
        g = {"out": features.T @ error, "bias": np.array([error.sum()], np.float32)}
        back = error[:, None] * p["out"][None]
        d_chunks = np.repeat(back[:, :FILTERS] / number[:, None], number, axis=0).astype(np.float32)
        owner = np.repeat(np.arange(len(number)), number)
        hit = chunks == top[owner]
        share = hit / np.maximum(1, np.add.reduceat(hit.astype(np.float32), starts))[owner]
        d_chunks += share * back[owner, FILTERS:]
        d_pooled = np.zeros_like(pooled)
        np.add.at(d_pooled, pair[0], d_chunks * left)
        np.add.at(d_pooled, pair[1], d_chunks * ~left)
        d_pooled *= pooled > 0
        g["b"] = d_pooled.sum(0)
        segment, filters = np.nonzero(d_pooled)
        d = d_pooled[segment, filters]
        frame = segment * SEGMENT + best[segment, filters]
        g["w1"], g["w2"], g["embed"] = np.zeros_like(p["w1"]), np.zeros_like(p["w2"]), np.zeros_like(p["embed"])
        np.add.at(g["w1"].T, filters, d[:, None] * x[frame])
        np.add.at(g["w2"].T, filters, d[:, None] * x_after[frame])
        bytes_of = body.reshape(-1, FRAME)
        following = bytes_of[after]
        following[ends] = 0
        for name, rows in (("w1", bytes_of[frame]), ("w2", following[frame])):
            flow = (d[:, None] * p[name].T[filters]).reshape(-1, DIMS)
            flat = rows.reshape(-1)
            for k in range(DIMS):
                g["embed"][:, k] += np.bincount(flat, flow[:, k], 256).astype(np.float32)
        return g

    def train(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 6) -> Network:
        rng = np.random.default_rng(seed)
        share = labels.mean()
        weights = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        steps = epochs * -(-len(texts) // STEP_ROWS)
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), STEP_ROWS):
                rows = order[at : at + STEP_ROWS]
                t += 1
                now = rate * 0.5 * (1 + np.cos(np.pi * t / steps)) + 1e-5
                for k, g in self.gradients([texts[i] for i in rows], labels[rows], weights[rows]).items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.p[k] -= (now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", rows: int = TRAIN_ROWS) -> Network | None:
    """A network trained on at most ``rows`` labelled documents, or None without labels of both kinds."""
    usable = labels.where(labels[key].isNotNull() & labels[label].isin(0, 1) & ~held_out(labels[key]))
    chosen = usable.select(labels[key].cast("long").alias("id"), labels[label].cast("int").alias("y")).groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows)
    # At most ``rows`` short rows are broadcast, so that the documents need not move. An id that several
    # rows share gives the text of least hash.
    bodies = docs.select(docs[key].cast("long").alias("id"), F.coalesce(docs[text], F.lit("")).alias("body"))
    named = bodies.join(F.broadcast(chosen), "id")
    sample = checkpoint(named.groupBy("id", "y").agg(F.min_by("body", F.struct(F.xxhash64("body"), F.length("body"))).alias("body")))
    sizes = sample.select("id", F.octet_length("body").alias("size"), F.xxhash64("id").alias("place")).collect()
    room, taken = TRAIN_BYTES, []
    for row in sorted(sizes, key=lambda r: (r["place"], r["id"])):
        room -= row["size"]
        if room < 0 and taken:
            break
        taken.append(row["id"])
    sample = sample.where(F.col("id").isin(taken)).toArrow()
    texts = [t.encode() for t in sample.column("body").to_pylist()]
    order = np.argsort(np.array(sample.column("id").to_pylist(), np.int64), kind="stable")
    y = np.array(sample.column("y").to_pylist(), np.float32)[order]
    if not len(y) or y.min() == y.max():
        return None
    return Network().train([texts[i] for i in order], y)


def score(docs: DataFrame, network: Network | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, score`` of every row."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.zeros(0)]
        body = batch.column(1)
        for start, stop in slices(batch, 1 << 20):
            part = [(t or "").encode() for t in body.slice(start, stop - start).to_pylist()]
            found.append(network.scores(part) if network else np.full(len(part), 0.5))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found))], ["doc_id", "score"])

    return map_batches(docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")), kernel, "doc_id long, score double")


def keep(docs: DataFrame, network: Network | None, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold`` (all without a network), unmoved."""
    at = docs.columns.index(text)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = [np.zeros(0, bool)]
        for start, stop in slices(batch, 1 << 20):
            kept.append(network.scores([(t or "").encode() for t in batch.column(at).slice(start, stop - start).to_pylist()]) >= threshold)
        return batch.filter(pa.array(np.concatenate(kept)))

    if network is None:
        return docs
    flat = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return map_batches(flat, kernel, flat.schema).toDF(*docs.columns)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, text: str = "text", key: str = "doc_id", label: str = "quality") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    scored = score(docs, fit(docs, labels, text, key, label), text, key)
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
