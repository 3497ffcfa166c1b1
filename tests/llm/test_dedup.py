import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quirelight.llm import embeddings, exact_dedup, line_dedup, simhash
from quirelight.llm.components import components, least_labels

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def roots(n, pairs):
    labels = list(range(n))

    def find(x):
        while labels[x] != x:
            x = labels[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        labels[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 30).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), max_size=40))))
def test_least_labels(case):
    n, pairs = case
    labels = np.arange(n)
    if pairs:
        a, b = np.array(pairs).T
        least_labels(labels, a, b)
    assert labels.tolist() == roots(n, pairs)


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(500, 560)] + [(600, 601 + i) for i in range(50)]
    wanted = {i: r for i, r in enumerate(roots(700, pairs))}
    found = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(wanted[n] == c for n, c in found.items()) and {x for p in pairs if p[0] != p[1] for x in p} == set(found)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6), st.integers(0, 99)), max_size=40))
def test_trie_is_a_map(items):
    trie, wanted = exact_dedup.Trie(max), {}
    for key, number in items:
        trie.add(key, number)
        best, rows = wanted.get(key, (number, 0))
        wanted[key] = (max(best, number), rows + 1)
    assert {k: (b, n) for k, b, n in trie} == wanted


def test_exact_dedup_of_awkward_rows(spark, awkward, empty):
    rows = exact_dedup.exact_dedup(awkward).collect()
    assert len(rows) == 9
    same = [r for r in rows if r.keep_id == 5]
    assert {r.doc_id for r in same} == {4, 5} and all(r.group_size == 3 for r in same) and [r.doc_id for r in same if r.kept] == [5]
    blank = {r.doc_id: r for r in rows if r.text_sha256 == hashlib.sha256(b"").hexdigest()}
    assert set(blank) == {1, 2} and blank[2].kept and blank[1].group_size == 2
    alone = next(r for r in rows if r.doc_id is None)
    assert alone.keep_id is None and not alone.kept
    smallest = {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(awkward, keep="smallest").collect()}
    assert smallest[5] == 4
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_tries_count_their_nodes_and_bear_chains():
    trie = exact_dedup.Trie()
    for n in range(3000):
        trie.add(b"x" * n, n)
    assert {k: b for k, b, _ in trie} == {b"x" * n: n for n in range(3000)}
    trie = exact_dedup.Trie()
    for n in range(100000):
        trie.add(b"one common start of %d" % n, n)
    assert trie.bytes > 100000 * exact_dedup.NODE_BYTES and sum(1 for _ in trie) == 100000


def test_small_tries_agree(spark, monkeypatch, awkward):
    wanted = sorted(map(str, exact_dedup.exact_dedup(awkward).collect()))
    monkeypatch.setattr(exact_dedup, "TRIE_BYTES", 1)
    assert sorted(map(str, exact_dedup.exact_dedup(awkward).collect())) == wanted


def lines_by_hand(rows, least_chars=20, least_docs=3):
    white = " \t\n\x0b\x0c\r"
    key = lambda x: x.strip(white).translate(UP)
    docs = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            docs.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        keep = []
        for x in (t or "").split("\n"):
            k = key(x)
            if len(k) >= least_chars and len(docs[k]) >= least_docs and i != max(docs[k]):
                continue
            keep.append(x)
        out.append((i, "\n".join(keep)))
    return sorted(out)


def test_lines_by_brute_force(spark):
    rng = np.random.default_rng(4)
    pool = ["a common line of over twenty", " A Common LINE of over twenty\t", "short", "", "another line that is long enough", "ünïcode lïne öf twënty cp"] + [f"line number {i} of a long pool of lines" for i in range(20)]
    rows = [(i, "\n".join(rng.choice(pool, rng.integers(1, 9)))) for i in range(60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted((r.doc_id, r.text or "") for r in line_dedup.line_dedup(docs).collect())
    assert got == lines_by_hand(rows)
    marks = {r.doc: r.keep_bitmap for r in line_dedup.keep_bitmaps(docs).collect()}
    bits = np.unpackbits(np.frombuffer(zlib.decompress(next(iter(marks.values()))), np.uint8), bitorder="little")
    assert (bits == 0).any()


def test_lines_of_awkward_rows(spark, awkward, empty):
    rows = line_dedup.line_dedup(awkward).collect()
    assert len(rows) == 9 and rows[0].asDict().keys() >= set(awkward.columns)
    # Two rows of id 4, one of id 5 and the null id are three documents; the largest id keeps its line.
    assert {(r.doc_id, r.text) for r in rows if r.doc_id in (4, 5, None)} == {(4, "x"), (5, "same text HERE for all to see\nx"), (None, "y")}
    assert line_dedup.line_dedup(empty).count() == 0


def fingerprint_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB é\n\t\x85x", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == fingerprint_by_hand(text)


def test_simhash_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAST_TILE", 32)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for g in range(40):
        base = rng.choice(words, 150).tolist()
        for _ in range(rng.integers(1, 6)):
            own = list(base)
            for _ in range(rng.integers(0, 3)):
                own[rng.integers(0, 150)] = rng.choice(words)
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "one"), (len(rows) + 3, "ONE")]
    f = np.array([fingerprint_by_hand(t) for _, t in rows], np.uint64)
    wanted = roots(len(rows), zip(*np.nonzero(np.bitwise_count(f[:, None] ^ f[None]) <= 4)))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(wanted)) and len(set(wanted)) < len(rows) - 10


def test_simhash_of_awkward_rows(spark, awkward, empty):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == 9
    assert {r.component_id for r in rows if r.fp == 0} == {1}
    assert simhash.near_duplicates(empty).count() == 0


def test_embeddings_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE_BYTES", 4096)
    monkeypatch.setattr(embeddings, "WINDOW", 4)
    rng = np.random.default_rng(6)
    vectors, labels = [], []
    for g in range(30):
        base = rng.standard_normal(24)
        for _ in range(rng.integers(1, 25)):
            vectors.append((base + rng.standard_normal(24) * rng.choice([0, 0.02, 0.08, 0.2, 0.35])).astype(np.float32).tolist())
            labels.append(int(g % 3))
    vectors += [vectors[0], [0.0] * 24, [float("nan")] + [1.0] * 23, None, [None] * 24, vectors[1], [1.0, 2.0]]
    labels += [labels[0], 0, 0, 0, 0, None, 0]
    rows = [(i, v, l) for i, (v, l) in enumerate(zip(vectors, labels))]
    usable = [v is not None and len(v) == 24 and None not in v and np.isfinite(v).all() and any(v) and l is not None for _, v, l in rows]
    x = np.array([v if u else [1e-9] * 24 for u, v in zip(usable, vectors)], np.float64)
    n = np.sqrt((x * x).sum(1))
    near = (x @ x.T) / n[:, None] / n[None] >= 0.98
    same = np.array([[usable[i] and usable[j] and labels[i] == labels[j] for j in range(len(rows))] for i in range(len(rows))])
    near &= same
    np.fill_diagonal(near, False)
    comp = roots(len(rows), zip(*np.nonzero(near)))
    got = {r.vec_id: tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert near.sum() > 100
    for i in range(len(rows)):
        assert got[i] == (i, near[i].sum(), comp[i], comp[i] == i)
    doubles = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {r.vec_id: tuple(r) for r in embeddings.near_duplicates(doubles).collect()} == got
    assert embeddings.near_duplicates(doubles.limit(0)).count() == 0


def test_lines_of_rows_that_share_an_id(spark):
    common, own = "a line that many documents hold", "a line that nobody else holds"
    rows = [(None, f"{common}\nx"), (None, f"{own}\nx"), (1, f"{common}\ny"), (1, f"{own} either\ny"), (1, f"{common}\ny"), (2, common), (3, common)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text, r.n_dropped_of_lines) for r in line_dedup.line_dedup(docs).collect())
    assert got == sorted([("None", "x", 1), ("None", f"{own}\nx", 0), ("1", "y", 1), ("1", "y", 1), ("1", f"{own} either\ny", 0), ("2", "", 1), ("3", common, 0)])


def test_vectors_that_share_an_id(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    near = lambda v: [x + 0.01 for x in v]
    rows = [(1, a, 0), (1, b, 0), (2, near(a), 0), (3, near(b), 0), (4, c, 0), (None, near(c), 0), (4, c, 0), (5, a, 1)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in got) == [("1", 1, 1), ("1", 1, 1), ("2", 1, 1), ("3", 1, 1), ("4", 2, 4), ("4", 2, 4), ("5", 0, 5), ("None", 2, 4)]
    assert [r.kept for r in sorted(got, key=lambda r: str(r.vec_id))] == [True, True, False, False, True, True, True, False]


@pytest.mark.parametrize("width, spread", [(8, 0.05), (64, 0.1), (64, 0.02), (300, 0.13)])
def test_recall_of_planted_groups(spark, width, spread):
    """Groups of 2 to 400 among vectors that link with nothing: all links, against brute force."""
    rng = np.random.default_rng(width)
    groups = [rng.standard_normal(width) + rng.standard_normal((n, width)) * spread for n in (2, 2, 2, 3, 5, 8, 40, 150, 400)]
    x = np.concatenate([*groups, rng.standard_normal((3000, width))]).astype(np.float32).astype(np.float64)
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    wanted = (unit @ unit.T >= 0.98).sum(1) - 1
    rows = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.astype(np.float32).tolist())], "vec_id long, embedding array<float>, label int")
    got = np.array([r.n_links for r in sorted(embeddings.near_duplicates(rows).collect())])
    assert wanted.sum() > 1000 and (got <= wanted).all() and got.sum() >= 0.999 * wanted.sum()


def _cap(rng, n, width, radius):
    """Points spread evenly in a ball around one direction."""
    x = rng.standard_normal((n, width - 1))
    x *= (radius * rng.random(n) ** (1 / (width - 1)) / np.linalg.norm(x, axis=1))[:, None]
    return np.column_stack([np.ones(n), x])


def _common_direction(rng, pairs, width, share, cosine):
    """Vectors of mean cosine ``share``, in pairs of the given cosine."""
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    common = unit(rng.standard_normal((1, width)))
    x = unit(np.sqrt(share) * common + np.sqrt(1 - share) * unit(rng.standard_normal((pairs, width))))
    away = rng.standard_normal((pairs, width))
    away = unit(away - (away * x).sum(axis=1, keepdims=True) * x)
    return np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * away])


@pytest.mark.parametrize("kind", ["cap", "low_cap", "common", "half"])
def test_recall_on_shifted_and_smooth_vectors(spark, kind):
    rng = np.random.default_rng(8)
    if kind == "cap":
        x = _cap(rng, 2500, 9, 0.34)
    elif kind == "low_cap":
        x = _cap(rng, 1500, 5, 0.5)
    else:
        x = _common_direction(rng, 4000, 64, 0.9 if kind == "common" else 0.5, 0.983)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.98
    np.fill_diagonal(linked, False)
    true = linked.sum(axis=1)
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect()}
    mine = np.array([got[i] for i in range(len(x))])
    assert (mine <= true).all() and mine.sum() >= 0.99 * true.sum(), (kind, mine.sum() / true.sum(), true.mean())
