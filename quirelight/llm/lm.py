"""Operator 6: language-model scores by masked pseudo-likelihood.

Words are told apart by 64-bit hashes. A network in numpy predicts every word from SIDE words to each
side: embeddings of these, for each distance its own, are summed, go through tanh, and give the probability of
the word in two steps, its group and then its place in the group. The most frequent words have places
of their own, in order of frequency, so that a group is a band of it; the others share the last group
by hash, and a word's share in its place there is its share of occurrences. The network is trained on
all documents: tasks train copies on their rows, half of the documents in each of ROUNDS rounds, and
their parameters are averaged by the number of words, in the executors.

The network's probability is the base that smooths exact counts, PRIOR occurrences of it in each
context: the probability of a word is the mean of two estimates, by the counts of (left, word) and of
(word, right) in all other documents. The sum of its logarithms over a document is the document's score. Texts that
are not among the documents counted are scored by all of these.

Documents are dealt by hash into blocks. A block asks once for each of its distinct words and
pairs; equal keys meet in the part of their range, and totals go back to the block, which sums the
log-probabilities. Blocks and parts grow in number with the corpus and hold about BLOCK_BYTES of
text each, so that a common word or pair has one row of a block and never fills a task. Only the
network, the most frequent words and totals by place, all of fixed size, reach the driver.

Defined results: a null or empty text and one without words have no words, log-probability 0 and a
null mean; rows that repeat are counted and scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.llm.common import ASCII_LOWER, WORD_PATTERN, checkpoint, slices

#: Groups of words and places in each; the last group is shared by words without a place.
GROUPS, PLACES = 32, 32
OWN, OUTSIDE = (GROUPS - 1) * PLACES, GROUPS * PLACES
#: Words to each side, and length of an embedding.
SIDE, DIMS = 2, 12
#: Rounds over parts of the documents, words a step, and the rate of steps.
ROUNDS, STEP, RATE = 2, 8192, 0.1
#: Tasks that add up the parameters, or merge the most frequent words, of all others.
ADDERS = 16
#: Occurrences that the network's probability counts for in each context: it decides but for the commonest contexts.
PRIOR = 128.0
#: Bytes of text in a block, and of the corpus in a part of the counts; blocks and parts at least.
BLOCK_BYTES, LEAST_BLOCKS = 8 << 20, 8
#: The id of the outside of a text.
NO_WORD = np.uint64(0)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False


def _mix(value: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        value = (value ^ (value >> np.uint64(shift))) * np.uint64(factor)
    return value ^ (value >> np.uint64(31))


def word_slots(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit id of every word of all texts, and the number of words of each text."""
    body = b"\n".join(texts).translate(ASCII_LOWER)
    data = np.frombuffer(body, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _IS_WORD[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    borders = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], borders])))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    lengths = ends - starts
    letters = data[inside[1:-1].view(bool)].astype(np.uint64) + np.uint64(1)
    first = np.cumsum(lengths) - lengths
    powers = np.cumprod(np.full(int(lengths.max()), _FACTOR), dtype=np.uint64)
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    return _mix(np.add.reduceat(letters * powers[place], first)), counts


def _parts(batch: pa.RecordBatch, column: int = 0) -> Iterator[list[bytes]]:
    for start, stop in slices(batch, 1 << 20):
        yield [(t or "").encode() for t in batch.column(column).slice(start, stop - start).to_pylist()]


def _word_counts(docs: DataFrame, text: str) -> DataFrame:
    """``id, n`` of every distinct word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def told() -> Iterator[pa.RecordBatch]:
            ids, n = np.unique(np.concatenate(kept), return_counts=True)
            for at in range(0, len(ids), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 65536].view(np.int64)), pa.array(n[at : at + 65536])], ["id", "n"])

        for batch in batches:
            for part in _parts(batch):
                kept.append(word_slots(part)[0])
                size += len(kept[-1])
                if size > 1 << 22:
                    yield from told()
                    kept, size = [], 0
        if size:
            yield from told()

    return docs.select(docs[text].alias("text")).mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _vocabulary(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the OWN most frequent words, in order of frequency, and by place (OWN words, then shared
    ones) occurrences and numbers of distinct words."""

    def best_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            own = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            held = own.sort_by([("n", "descending"), ("id", "ascending")]).slice(0, OWN)
        if held is not None:
            yield from held.combine_chunks().to_batches()

    words = checkpoint(words)
    few = words.mapInArrow(best_of, "id long, n long").repartition(ADDERS).mapInArrow(best_of, "id long, n long").toArrow()  # ADDERS * OWN rows
    best = few.sort_by([("n", "descending"), ("id", "ascending")]).slice(0, OWN)
    top = best.column("id").to_numpy().view(np.uint64)
    totals = np.zeros((2, OUTSIDE))
    for row in words.groupBy(F.col("id").bitwiseAND(PLACES - 1).alias("place")).agg(F.sum("n").alias("n"), F.count("*").alias("types")).collect():  # PLACES rows
        totals[:, OWN + row["place"]] = row["n"], row["types"]
    n = best.column("n").to_numpy()
    shared = (top % np.uint64(PLACES)).astype(np.int64) + OWN
    np.subtract.at(totals[0], shared, n)
    np.subtract.at(totals[1], shared, 1)
    totals[0, : len(top)], totals[1, : len(top)] = n, 1
    return top, totals


def places_of(ids: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The place of each word: its rank, or one that it shares."""
    out = (ids % np.uint64(PLACES)).astype(np.int64) + OWN
    if len(top):
        order = np.argsort(top)
        at = order[np.minimum(np.searchsorted(top, ids, sorter=order), len(top) - 1)]
        own = top[at] == ids
        out[own] = at[own]
    return out


def windows(places: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rows of embeddings for each word: those of the SIDE words before and after it, OUTSIDE beyond its
    text. A place has one row for each distance that it may stand at."""
    text = np.repeat(np.arange(len(counts)), counts)
    out = np.full((len(places), 2 * SIDE), OUTSIDE, np.int32)
    for d in range(1, min(SIDE, len(places) - 1) + 1):
        same = text[d:] == text[:-d]
        out[d:, SIDE - d] = np.where(same, places[:-d], OUTSIDE)
        out[:-d, SIDE + d - 1] = np.where(same, places[d:], OUTSIDE)
    return out + np.arange(2 * SIDE, dtype=np.int32) * (OUTSIDE + 1)


def _softmax(z: np.ndarray) -> np.ndarray:
    """In place, of each column."""
    z -= z.max(0)
    np.exp(z, out=z)
    z /= z.sum(0)
    return z


def _log_softmax(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The logarithm of one value of each column's softmax."""
    z -= z.max(0)
    own = z[at, np.arange(len(at))].astype(np.float64)
    return own - np.log(np.exp(z, out=z).sum(0, dtype=np.float64))


class Network:
    """log P(place | places around it)."""

    SHAPES = {"embed": (2 * SIDE * (OUTSIDE + 1), DIMS), "hidden": (DIMS,), "group": (DIMS, GROUPS), "group_bias": (GROUPS,), "place": (GROUPS, DIMS, PLACES), "place_bias": (GROUPS, PLACES)}

    def __init__(self, occurrences: np.ndarray, seed: int = 3):
        """Starts from the frequencies of places, whatever stands around."""
        rng = np.random.default_rng(seed)
        n = (occurrences + 0.1).reshape(GROUPS, PLACES)
        self.p = {k: np.zeros(shape, np.float32) for k, shape in self.SHAPES.items()}
        self.p["embed"] += rng.standard_normal(self.SHAPES["embed"]).astype(np.float32) * 0.25
        self.p["group_bias"] += np.log(n.sum(1) / n.sum()).astype(np.float32)
        self.p["place_bias"] += np.log(n / n.sum(1, keepdims=True)).astype(np.float32)
        #: Sums of squared gradients.
        self.seen = {k: np.full(shape[:1] if k == "embed" else shape, 1e-6, np.float32) for k, shape in self.SHAPES.items()}

    def copy(self) -> Network:
        out = object.__new__(Network)
        out.p, out.seen = ({k: v.copy() for k, v in x.items()} for x in (self.p, self.seen))
        return out

    def packed(self) -> bytes:
        return np.concatenate([self.p[k].ravel() for k in self.SHAPES]).astype("<f4").tobytes()

    def unpack(self, flat: np.ndarray) -> Network:
        at = 0
        for k, shape in self.SHAPES.items():
            size = int(np.prod(shape))
            self.p[k] = flat[at : at + size].reshape(shape).astype(np.float32)
            at += size
        return self

    def _hidden(self, around: np.ndarray) -> np.ndarray:
        total = self.p["hidden"] + self.p["embed"][around[:, 0]]
        for k in range(1, 2 * SIDE):
            total += self.p["embed"][around[:, k]]
        return np.tanh(total, out=total)

    @staticmethod
    def _by_group(group: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        """An order of words in which groups are slices, and these."""
        order = np.argsort(group.astype(np.int16), kind="stable")
        cuts = np.searchsorted(group[order], np.arange(GROUPS + 1)).tolist()
        return order, [(g, slice(cuts[g], cuts[g + 1])) for g in range(GROUPS) if cuts[g + 1] > cuts[g]]

    def _group_logits(self, h: np.ndarray) -> np.ndarray:
        return self.p["group"].T @ h.T + self.p["group_bias"][:, None]

    def _place_logits(self, g: int, h: np.ndarray) -> np.ndarray:
        return self.p["place"][g].T @ h.T + self.p["place_bias"][g][:, None]

    def logs(self, places: np.ndarray, around: np.ndarray) -> np.ndarray:
        """log P of each place."""
        out = np.zeros(len(places))
        for at in range(0, len(places), STEP):
            order, groups = self._by_group(places[at : at + STEP] // PLACES)
            own, h = places[at : at + STEP][order], self._hidden(around[at : at + STEP][order])
            part = _log_softmax(self._group_logits(h), own // PLACES)
            for g, rows in groups:
                part[rows] += _log_softmax(self._place_logits(g, h[rows]), own[rows] % PLACES)
            out[at + order] = part
        return out

    def gradients(self, places: np.ndarray, around: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean of -log P; that of "embed" is (rows, values) of the rows that occur."""
        p, n = self.p, len(places)
        order, groups = self._by_group(places // PLACES)
        places, around = places[order], around[order]
        h = self._hidden(around)
        e = _softmax(self._group_logits(h))
        e[places // PLACES, np.arange(n)] -= 1
        grads = {"group": h.T @ e.T / n, "group_bias": e.sum(1) / n, "place": np.zeros_like(p["place"]), "place_bias": np.zeros_like(p["place_bias"])}
        back = p["group"] @ e
        within = places % PLACES
        for g, rows in groups:
            own = h[rows]
            e = _softmax(self._place_logits(g, own))
            e[within[rows], np.arange(len(own))] -= 1
            grads["place"][g], grads["place_bias"][g] = own.T @ e.T / n, e.sum(1) / n
            back[:, rows] += p["place"][g] @ e
        back = back.T * ((1 - h * h) / n)
        grads["hidden"] = back.sum(0)
        flat = around.ravel()
        order = np.argsort(flat)
        starts = np.flatnonzero(np.diff(flat[order], prepend=-1))
        grads["embed"] = flat[order][starts], np.add.reduceat(back[order // (2 * SIDE)], starts, axis=0)
        return grads

    def step(self, places: np.ndarray, around: np.ndarray) -> None:
        """One step down the gradient, each parameter (of embeddings, each word) at its own rate."""
        for k, g in self.gradients(places, around).items():
            if k == "embed":
                rows, g = g
                self.seen[k][rows] += np.square(g).mean(1)
                self.p[k][rows] -= RATE * g / np.sqrt(self.seen[k][rows])[:, None]
            else:
                self.seen[k] += g * g
                self.p[k] -= RATE * g / np.sqrt(self.seen[k])


def _trained(docs: DataFrame, text: str, top: np.ndarray, network: Network) -> Network:
    """The network after all rounds."""
    context = docs.sparkSession.sparkContext

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            for body, words in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(body, "<f4").astype(np.float64) * words
                total, n = own if total is None else total + own, n + words
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([(total / n).astype("<f4").tobytes()], pa.binary()), pa.array([n], pa.int64())], ["body", "words"])

    for number in range(ROUNDS):
        shared = context.broadcast((top, network))  # of fixed size

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            top, start = shared.value
            own, words = start.copy(), 0  # what is shared serves other tasks of this worker, too
            for batch in batches:
                for part in _parts(batch):
                    ids, counts = word_slots(part)
                    places = places_of(ids, top)
                    around = windows(places, counts)
                    # Words of a text stand apart in steps, which so differ less.
                    mixed = np.random.default_rng(len(ids)).permutation(len(ids))
                    for at in range(0, len(ids), STEP):
                        some = mixed[at : at + STEP]
                        own.step(places[some], around[some])
                    words += len(ids)
            if words:
                yield pa.RecordBatch.from_arrays([pa.array([own.packed()], pa.binary()), pa.array([words], pa.int64())], ["body", "words"])

        rows = docs.where(F.pmod(F.xxhash64(docs[text]), F.lit(ROUNDS)) == number).select(docs[text].alias("text"))
        trained = rows.mapInArrow(run, "body binary, words long").repartition(ADDERS).mapInArrow(add, "body binary, words long")
        found = [r for r in trained.toArrow().to_batches() if r.num_rows]  # ADDERS rows
        if found:
            whole = next(add(iter(found)))
            network.unpack(np.frombuffer(whole.column(0)[0].as_py(), "<f4"))
    return network


def _neighbours(own: np.ndarray, counts: np.ndarray, outside=OUTSIDE) -> tuple[np.ndarray, np.ndarray]:
    edge = np.full(1, outside, own.dtype)
    left = np.concatenate([edge, own[:-1]])
    right = np.concatenate([own[1:], edge])
    counts = counts[counts > 0]
    last = np.cumsum(counts) - 1
    right[last] = outside
    left[(last + 1)[:-1]] = outside
    return left, right


class Block:
    """The words of some texts, and their distinct words and pairs with counts, in order of keys."""

    def __init__(self, texts: list[bytes]):
        self.ids, self.counts = word_slots(texts)
        self.left, self.right = _neighbours(self.ids, self.counts, NO_WORD) if len(self.ids) else (self.ids, self.ids)
        # Pairs of a word and its right neighbour; those of the outside and a first word follow.
        self.first = np.flatnonzero(self.left == NO_WORD)
        self.last = np.flatnonzero(self.right == NO_WORD)
        pairs = np.concatenate([self._pair(self.ids, self.right), self._pair(self.left[self.first], self.ids[self.first])])
        self.pairs, self.pair_at, self.pair_n = np.unique(pairs, return_inverse=True, return_counts=True)
        self.words, self.word_at, n = np.unique(self.ids, return_inverse=True, return_counts=True)
        edges = [np.bincount(self.word_at[x], minlength=len(n)) for x in (self.first, self.last)]
        #: Occurrences, and how many of them begin and end a text.
        self.word_n = np.stack([n, *edges])

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix(a * _FACTOR + _mix(b + _FACTOR))

    def cuts(self, keys: np.ndarray, parts: int) -> np.ndarray:
        """Where each part's range of the sorted keys starts, and the end."""
        part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        return np.searchsorted(part, np.arange(parts + 1).astype(np.uint64))

    def values(self, model: Model, pair_n: np.ndarray, word_n: np.ndarray, counted: bool) -> np.ndarray:
        """log P(word | left, right) of every word, by the corpus' counts of the block's keys. If the block's texts
        are ``counted`` there, the occurrences in a word's own text are left out: what a text alone says of its words
        proves nothing."""
        text = np.repeat(np.arange(len(self.counts)), self.counts)
        own_n = _times(text, self.word_at) * counted
        last_of, first_of = np.zeros(len(self.counts), np.int64), np.zeros(len(self.counts), np.int64)
        last_of[text[self.last]], first_of[text[self.first]] = self.word_at[self.last], self.word_at[self.first]
        n, begins, ends = (x[self.word_at] for x in word_n)
        n, begins, ends = n - own_n, begins - counted * (self.word_at == first_of[text]), ends - counted * (self.word_at == last_of[text])
        places = places_of(self.ids, model.top)
        occurrences, types = model.totals[:, places]
        share = np.where(places < OWN, 1.0, (n + 0.5) / (occurrences + 0.5 * (types + 1)))
        base = np.exp(model.network.logs(places, windows(places, self.counts))) * share
        of_pair = pair_n[self.pair_at] - _times(np.concatenate([text, text[self.first]]), self.pair_at) * counted
        after = of_pair[: len(n)].astype(np.float64)
        before = np.concatenate([[0.0], after[:-1]])
        before[self.first] = of_pair[len(n) :]
        # How often the left neighbour has a word after it, and the right one a word before it.
        outside = model.texts - counted
        of_left = np.concatenate([[0], (n - ends)[:-1]])
        of_left[self.first] = outside
        of_right = np.concatenate([(n - begins)[1:], [0]])
        of_right[self.last] = outside
        return np.log(0.5 * (before + PRIOR * base) / (of_left + PRIOR) + 0.5 * (after + PRIOR * base) / (of_right + PRIOR))


def _times(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often each value occurs in its own text."""
    if not len(at):
        return np.zeros(0, np.int64)
    key = text * (int(at.max()) + 1) + at
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    return times[inverse]


def _number(docs: DataFrame, text: str) -> int:
    size = docs.agg(F.sum(F.octet_length(docs[text]))).first()[0] or 0
    return max(LEAST_BLOCKS, -(-size // BLOCK_BYTES))


def _dealt(docs: DataFrame, text: str, key: str, blocks: int) -> DataFrame:
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block")


def _squeezed(body: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(body)


def _opened(body: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(body)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences: one byte that says in how many bytes each is written, the first key,
    and the lowest bytes of all differences, then the next ones."""
    gaps = np.diff(keys)
    width = (int(gaps.max()).bit_length() + 7) // 8 if len(gaps) else 0
    planes = gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + np.ascontiguousarray(planes.T).tobytes()


def unpack_keys(body: bytes) -> np.ndarray:
    if len(body) < 9:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(body, np.uint8, offset=9).reshape(body[0], -1) if body[0] else np.zeros((0, 0), np.uint8)
    parts = np.zeros((planes.shape[1] + 1, 8), np.uint8)
    parts[1:, : body[0]] = planes.T
    parts[0] = np.frombuffer(body, np.uint8, 8, 1)
    return np.cumsum(parts.view("<u8").ravel(), dtype=np.uint64)


def _texts(table: pa.Table) -> list[bytes]:
    return [(t or "").encode() for t in table.column("text").to_pylist()]


def _packed(dealt: DataFrame, parts: int, counted: bool, asked: bool) -> DataFrame:
    """A row for each block and part: the block's keys of the part's range and their counts."""

    def pack(table: pa.Table) -> pa.Table:
        own = Block(_texts(table))
        pair_cuts, word_cuts = own.cuts(own.pairs, parts), own.cuts(own.words, parts)
        rows = []
        for i in range(parts):
            a, b, c, d = pair_cuts[i], pair_cuts[i + 1], word_cuts[i], word_cuts[i + 1]
            if b > a or d > c:
                pair_n, word_n = own.pair_n[a:b].astype("<i4"), own.word_n[:, c:d].astype("<i4")
                n = _squeezed(pair_n.tobytes() + word_n.tobytes()) if counted else None
                rows.append((i, pack_keys(own.pairs[a:b]), pack_keys(own.words[c:d]), n))
        part, pairs, words, n = zip(*rows) if rows else ((), (), (), ())
        block = table.column("block")[0].as_py()
        return pa.table({"block": pa.array([block] * len(rows), pa.int32()), "part": pa.array(part, pa.int32()), "asked": pa.array([asked] * len(rows), pa.bool_()), "pairs": pa.array(pairs, pa.binary()), "words": pa.array(words, pa.binary()), "n": pa.array(n, pa.binary())})

    return dealt.groupBy("block").applyInArrow(pack, "block int, part int, asked boolean, pairs binary, words binary, n binary")


def _totals(packed: DataFrame, parts: int) -> DataFrame:
    """The corpus' counts of the keys of each row that asks: ``block, part, n``."""

    def total(table: pa.Table) -> pa.Table:
        pairs, words = ([unpack_keys(x) for x in table.column(c).to_pylist()] for c in ("pairs", "words"))
        pair_n, word_n = [], []
        for p, w, n in zip(pairs, words, table.column("n").to_pylist()):
            found = np.frombuffer(_opened(n), "<i4") if n is not None else np.zeros(len(p) + 3 * len(w), "<i4")
            pair_n.append(found[: len(p)])
            word_n.append(found[len(p) :].reshape(3, len(w)))
        of_pair = np.unique(np.concatenate(pairs), return_inverse=True)[1]
        of_word = np.unique(np.concatenate(words), return_inverse=True)[1]
        pair_n = np.bincount(of_pair, np.concatenate(pair_n))[of_pair].astype("<i8") if len(of_pair) else of_pair
        word_n = np.stack([np.bincount(of_word, x)[of_word] for x in np.concatenate(word_n, axis=1)]).astype("<i8") if len(of_word) else np.zeros((3, 0), "<i8")
        out, p, w = [], 0, 0
        for a, b, asked in zip(map(len, pairs), map(len, words), table.column("asked").to_pylist()):
            if asked:
                out.append((a, _squeezed(pair_n[p : p + a].tobytes() + word_n[:, w : w + b].tobytes())))
            p, w = p + a, w + b
        rows = table.filter(table.column("asked"))
        return pa.table({"block": rows.column("block"), "part": rows.column("part"), "pairs": pa.array([a for a, _ in out], pa.int32()), "n": pa.array([n for _, n in out], pa.binary())})

    return packed.repartition(parts, "part").groupBy("part").applyInArrow(total, "block int, part int, pairs int, n binary")


class Model:
    """The documents whose exact counts are asked for, and what has a fixed size: the most frequent
    words, occurrences and distinct words by place, texts with words, and the network."""

    def __init__(self, docs: DataFrame | None, text: str, parts: int, top: np.ndarray, totals: np.ndarray, texts: int, network: Network):
        self.docs, self.text, self.parts = docs, text, parts
        self.top, self.totals, self.texts, self.network = top, totals, texts, network

    def fixed(self) -> Model:
        """The model without its documents, for executors."""
        return Model(None, self.text, self.parts, self.top, self.totals, self.texts, self.network)

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability and number of words of a few texts."""
        rows = self.docs.sparkSession.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
        found = sorted(score(rows, self).select("doc_id", "log_prob", "n_words").collect())
        return np.array([r[1] for r in found]), np.array([r[2] for r in found], np.int64)


def fit(docs: DataFrame, text: str = "text") -> Model:
    """The model of all documents."""
    top, totals = _vocabulary(_word_counts(docs, text))
    texts = docs.where(docs[text].rlike(WORD_PATTERN)).count()
    return Model(docs, text, _number(docs, text), top, totals, texts, _trained(docs, text, top, Network(totals[0])))


def score(docs: DataFrame, model: Model | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_words, log_prob, mean_log_prob`` of every row."""
    model = model or fit(docs, text)
    same = model.docs is docs and model.text == text
    blocks = model.parts if same else _number(docs, text)
    dealt = _dealt(docs, text, key, blocks)
    packed = _packed(dealt, model.parts, same, True)
    if not same:
        corpus = model.docs.select(F.lit(None).cast("long").alias("doc_id"), model.docs[model.text].alias("text"))
        spread = corpus.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(model.parts)).cast("int")).repartition(model.parts, "block")
        packed = packed.unionAll(_packed(spread, model.parts, True, False))
    totals = _totals(packed, model.parts)
    shared = docs.sparkSession.sparkContext.broadcast(model.fixed())  # of fixed size

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        own = Block(_texts(table))
        values = np.zeros(0)
        if len(own.ids):
            pair_n, word_n = [], []
            answers = answers.sort_by("part")
            for pairs, n in zip(answers.column("pairs").to_pylist(), answers.column("n").to_pylist()):
                found = np.frombuffer(_opened(n), "<i8")
                pair_n.append(found[:pairs])
                word_n.append(found[pairs:].reshape(3, -1))
            values = own.values(shared.value, np.concatenate(pair_n), np.concatenate(word_n, axis=1), same)
        ends = np.concatenate([[0.0], np.cumsum(values)])
        stop, n = np.cumsum(own.counts), own.counts
        total = ends[stop] - ends[stop - n]
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(n, pa.int64()), "log_prob": pa.array(total), "mean_log_prob": pa.array(total / np.maximum(n, 1), mask=n == 0)})

    back = totals.repartition(blocks, "block")
    return dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(run, "doc_id long, n_words long, log_prob double, mean_log_prob double")
