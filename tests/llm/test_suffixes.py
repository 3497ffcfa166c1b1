import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirelight.llm import suffix_dedup, suffixes


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=70))
def test_suffix_array(symbols):
    text = np.array(symbols, np.int64)
    assert suffixes.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: symbols[i:])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 1 << 40), max_size=30), st.integers(1, 3))
def test_suffix_array_of_large_symbols(symbols, times):
    text = np.array(symbols * times, np.int64)
    assert suffixes.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def test_anchors_depend_on_their_window_only():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, 400, dtype=np.uint64) >> np.uint64(58) << np.uint64(58)
    at, first, count = suffixes.anchors(hashes, 20)
    for p, low, n in zip(at.tolist(), first.tolist(), count.tolist()):
        for s in range(low, low + n):
            assert s + int(hashes[s : s + 20].argmin()) == p
    assert count.sum() == 381


def by_hand(rows, length):
    data = [(t or "").encode() for t in rows]
    seen = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(x for x, g in zip(d, gone) if not g)
        runs = sum(bool(g) and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1024, 1])
@pytest.mark.parametrize("sort_bytes", [2 << 20, 700])
def test_by_brute_force(spark, monkeypatch, hot, sort_bytes):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", sort_bytes)
    rng = np.random.default_rng(2)
    word = lambda n: " ".join(f"w{i}é" for i in rng.integers(0, 3000, n))
    passages = [word(60) for _ in range(4)]
    rows = [word(rng.integers(0, 50)) + passages[rng.integers(0, 4)][rng.integers(0, 90) :] + word(rng.integers(0, 50)) for _ in range(40)]
    rows += [rows[0], rows[1][1:], "a" * 450, "b" * 199, "c" * 200, "xy" * 300, None, "", passages[0] + passages[0], "\x00" * 210, "\x00" * 205 + "q"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()}
    for i, wanted in enumerate(by_hand(rows, 200)):
        assert got[i] == wanted, i


def test_awkward_rows(spark, awkward, empty):
    rows = suffix_dedup.remove_repeats(awkward).collect()
    assert len(rows) == 9
    long_ = next(r for r in rows if r.doc_id == 3)
    assert long_.n_removed == long_.n_bytes == 100000 and long_.kept == b""
    assert suffix_dedup.remove_repeats(empty).count() == 0
