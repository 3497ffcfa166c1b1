"""Operator 1: byte-level BPE encoding and decoding by speculation and verification.

A word is first cut greedily into longest vocabulary entries. A proposal equals the
result of the merge procedure exactly when every entry encodes to itself and no merge
would have joined the two sides of any boundary; the latter is a property of the adjacent
pair alone, tested for all distinct pairs of a batch at once in numpy. Only words that
fail are merged step by step.

Defined results: a null or empty text has no tokens and decodes to the empty text;
repeated rows are encoded alike; an input of no rows gives no rows; texts of any length
are encoded whole; other columns of the input do not take part.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quirelight.llm.common import map_batches, texts

#: Distinct words that a Python worker remembers before it starts afresh.
CACHE_WORDS = 100_000
#: Words longer than this are encoded but not remembered.
CACHE_CHARS = 48
SHIFT = 20
#: Bytes by which vocabulary entries are looked up; shorter ones are tried one by one.
HEAD = 4
SHORT = (3, 2, 1)
#: Up to so many bytes a word is merged by scanning, beyond with a heap.
SMALL = 64
NO_MERGE = (1 << 40, -1)
NEVER = np.int64(1) << 40


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: Letters and numbers that Unicode 16 added to 15.1. The tokenizer library knows
#: Unicode 16, Python 3.13's unicodedata 15.1, the regex module later ones.
UNICODE_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C),
    (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
)


def _newer_letters() -> str:
    """Ranges of letters and numbers younger than Unicode 16, which count as neither."""
    pattern = regex.compile(r"[\p{L}\p{N}]")
    ranges: list[list[int]] = []
    for m in pattern.finditer("".join(map(chr, chain(range(0xD800), range(0xE000, sys.maxunicode + 1))))):
        code = ord(m[0])
        if unicodedata.category(m[0])[0] not in "LN" and not any(a <= code <= b for a, b in UNICODE_16):
            if ranges and ranges[-1][1] == code - 1:
                ranges[-1][1] = code
            else:
                ranges.append([code, code])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


class Codec:
    """Encoder and decoder of one vocabulary file; `Codec.load` keeps one per worker."""

    _loaded: dict[str, Codec] = {}

    @classmethod
    def load(cls, path: str) -> Codec:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max(max(vocab.values()), *self.special.values(), 0)
        #: Bytes of each id.
        self.bytes_of: list[bytes] = [b""] * size
        for token, number in vocab.items():
            self.bytes_of[number] = bytes(letters[c] for c in token)
        for token, number in self.special.items():
            self.bytes_of[number] = token.encode()
        self.id_of = {self.bytes_of[n]: n for n in vocab.values()}
        self.byte_id = [self.id_of[bytes([b])] for b in range(256)]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << SHIFT | right
        self.merges = dict(zip(keys.tolist(), zip(range(len(pairs)), made.tolist())))
        order = np.argsort(keys)
        self.merge_keys, self.merge_rank = keys[order], order.astype(np.int64)
        self._spines(left, right, made, size)
        #: Lengths of the entries that begin with these HEAD bytes, longest first.
        self.lengths: dict[bytes, tuple[int, ...]] = {}
        for word in self.id_of:
            if len(word) >= HEAD:
                self.lengths.setdefault(word[:HEAD], set()).add(len(word))
        self.lengths = {head: tuple(sorted(own, reverse=True)) for head, own in self.lengths.items()}
        self.sound: dict[int, bool] = {}
        plain = r"'(?:s|t|re|ve|m|ll|d)| ?(?:\p{L}++|\p{N}++|[^\s\p{L}\p{N}]++)|\s+(?!\S)|\s+"
        newer = _newer_letters()
        self.split = regex.compile(plain).findall
        first_newer = int(newer[2:10], 16) if newer else sys.maxunicode + 1
        self.newer = lambda text: int(np.frombuffer(text.encode("utf-32-le"), "<u4").max(initial=0)) >= first_newer
        strict = plain.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{newer}])").replace(r"\p{L}++", rf"[\p{{L}}--[{newer}]]++").replace(r"\p{N}++", rf"[\p{{N}}--[{newer}]]++")
        self.split_strict = regex.compile("(?V1)" + strict).findall
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.cache: dict[str, bytes] = {}

    def _spines(self, left, right, made, size) -> None:
        """For each token the pieces at its right and left edge, with the rank of the
        merge that consumes them; absent positions are -1."""
        child = {"r": np.full(size, -1, np.int64), "l": np.full(size, -1, np.int64)}
        rank = np.full(size, NEVER, np.int64)
        child["r"][made], child["l"][made] = right, left
        rank[made] = np.arange(len(made))
        self.spine = {}
        for side in "rl":
            node, until = np.arange(size), np.full(size, NEVER, np.int64)
            levels = []
            while (node >= 0).any():
                levels.append((node, until))
                inner = node >= 0
                until = np.where(inner, rank[node], NEVER)
                node = np.where(inner, child[side][node], -1)
            self.spine[side] = (np.stack([n for n, _ in levels]), np.stack([u for _, u in levels]))

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the boundary of tokens a[i] and b[i]."""
        fine = np.ones(len(a), bool)
        (rn, ru), (ln, lu) = self.spine["r"], self.spine["l"]
        for i in range(len(rn)):
            x, ux = rn[i][a], ru[i][a]
            if not (x >= 0).any():
                break
            for j in range(len(ln)):
                y, uy = ln[j][b], lu[j][b]
                rows = np.flatnonzero((x >= 0) & (y >= 0) & fine)
                if not len(rows):
                    continue
                key = x[rows] << SHIFT | y[rows]
                at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
                rank = np.where(self.merge_keys[at] == key, self.merge_rank[at], NEVER)
                # Equal ranks are one and the same pair, which merges from the left.
                fine[rows[(rank < ux[rows]) & (rank <= uy[rows]) & (rank < NEVER)]] = False
        return fine

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        whole = self.id_of.get(word)
        if whole is not None:
            return [whole]
        out, pos, end, get, lengths = [], 0, len(word), self.id_of.get, self.lengths.get
        while pos < end:
            for size in lengths(word[pos : pos + HEAD], SHORT):
                found = get(word[pos : pos + size])
                if found is not None and pos + size <= end:
                    break
            else:
                for size in SHORT:
                    found = get(word[pos : pos + size])
                    if found is not None and pos + size <= end:
                        break
            out.append(found)
            pos += size
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: lowest rank first, then leftmost."""
        byte_id = self.byte_id
        ids = [byte_id[b] for b in word]
        n = len(ids)
        if n <= SMALL:
            get = self.merges.get
            found = [get(a << SHIFT | b, NO_MERGE) for a, b in zip(ids, ids[1:])]
            while found:
                best = min(found)
                if best is NO_MERGE:
                    break
                i = found.index(best)
                ids[i : i + 2] = [best[1]]
                del found[i]
                if i:
                    found[i - 1] = get(ids[i - 1] << SHIFT | best[1], NO_MERGE)
                if i < len(found):
                    found[i] = get(best[1] << SHIFT | ids[i + 1], NO_MERGE)
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = self.merges
        heap = [(merges[k][0], i) for i in range(n - 1) if (k := ids[i] << SHIFT | ids[i + 1]) in merges]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n:
                continue
            found = merges.get(ids[i] << SHIFT | ids[j])
            if found is None or found[0] != rank:
                continue
            ids[i], ids[j] = found[1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (k := ids[i] << SHIFT | ids[after[i]]) in merges:
                    heapq.heappush(heap, (merges[k][0], i))
            if before[i] >= 0 and (k := ids[before[i]] << SHIFT | ids[i]) in merges:
                heapq.heappush(heap, (merges[k][0], before[i]))
        return [t for t in ids if t >= 0]

    def _is_sound(self, token: int) -> bool:
        if token not in self.sound:
            self.sound[token] = self.merge(self.bytes_of[token]) == [token]
        return self.sound[token]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word: proposals, one vectorised test of all pairs, exact merges for the rest."""
        out = [self.propose(w) for w in words]
        several = [i for i, ids in enumerate(out) if len(ids) > 1]
        failed = {i for i, ids in enumerate(out) if len(ids) == 1 and not self._is_sound(ids[0])}
        if several:
            counts = np.fromiter((len(out[i]) for i in several), np.int64, len(several))
            flat = np.fromiter(chain.from_iterable(out[i] for i in several), np.int64, int(counts.sum()))
            owner = np.repeat(np.arange(len(several)), counts)
            inside = owner[1:] == owner[:-1]
            keys, back = np.unique(flat[:-1][inside] << SHIFT | flat[1:][inside], return_inverse=True)
            good = self.compatible(keys >> SHIFT, keys & ((1 << SHIFT) - 1))
            tokens, where = np.unique(flat, return_inverse=True)
            sound = np.fromiter((self._is_sound(t) for t in tokens.tolist()), bool, len(tokens))
            wrong = np.concatenate([owner[1:][inside][~good[back]], owner[~sound[where]]])
            failed |= {several[k] for k in np.unique(wrong).tolist()}
        for i in failed:
            out[i] = self.merge(words[i])
        return out

    def words(self, text: str) -> list[str]:
        return self.split_strict(text) if not text.isascii() and self.newer(text) else self.split(text)

    def pack(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        pieces = []
        for text in batch:
            parts = self.cut_special(text) if self.cut_special and any(s in text for s in self.special) else [text]
            pieces.append([p if k % 2 else self.words(p) for k, p in enumerate(parts)])
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        new = list(set(chain.from_iterable(p for parts in pieces for p in parts[::2])) - cache.keys())
        # Lists of 50,000 bound what the pair test allocates.
        fresh: dict[str, bytes] = {}
        for at in range(0, len(new), 50_000):
            some = new[at : at + 50_000]
            for word, ids in zip(some, self.encode_words([w.encode() for w in some])):
                (cache if len(word) <= CACHE_CHARS else fresh)[word] = np.array(ids, "<u4").tobytes()
        if fresh:
            get = lambda w: cache.get(w) or fresh[w]
        else:
            get = cache.__getitem__
        out = []
        for parts in pieces:
            packed = [np.array([self.special[p]], "<u4").tobytes() if k % 2 else b"".join(map(get, p)) for k, p in enumerate(parts)]
            out.append(packed[0] if len(packed) == 1 else b"".join(packed))
        return out

    def unpack(self, packed: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


def _ids_array(packed: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def encode(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``ids`` (array of int) for every row; the key may be null or repeat."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = Codec.load(path).pack(texts(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), _ids_array(packed)], ["key", "ids"])

    return map_batches(df.select(df[key].cast("long").alias("key"), df[text].alias("text")), kernel, "key long, ids array<int>").withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """``key`` and ``text`` for every row of ids; null ids give the empty text."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = Codec.load(path)
        own = [codec.unpack(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.string())], ["key", "text"])

    return map_batches(df.select(df[key].cast("long").alias("key"), df[ids].alias("ids")), kernel, "key long, text string").withColumnRenamed("key", key)


def round_trip(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Encode and decode in one pass, with digests of both: ``key, n_tokens, ids_sha256,
    decoded_sha256``, and ``ids`` if asked for."""
    names = ["key", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = Codec.load(path)
        packed = codec.pack(texts(batch.column(1)))
        digest = lambda data: hashlib.sha256(data).hexdigest()
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(p) // 4 for p in packed], pa.int64()),
                pa.array([digest(p) for p in packed]),
                pa.array([digest(codec.unpack(p).encode()) for p in packed]),
                *([_ids_array(packed)] if with_ids else []),
            ],
            names,
        )

    return map_batches(df.select(df[key].cast("long").alias("key"), df[text].alias("text")), kernel, "key long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids).withColumnRenamed("key", key)
