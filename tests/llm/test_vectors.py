import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from places import DATA

from quirelight.llm import vector_codes, vector_codes_sql, whitening
from quirelight.llm.common import table
from quirelight.llm.queries import op11_whiten_embeddings, op13_vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], k) for i, v, k in rows], SCHEMA)


# --- codes ---------------------------------------------------------------------------------------


def coded_by_definition(rows, entries=64, parts=16, rounds=2):
    x = {i: np.floor(256 * np.array(v, float)).astype(np.int64).reshape(parts, -1) for i, v, _ in rows}
    ids = sorted(x)
    books = [np.array([x[i][p] for i in ids[:entries]]) for p in range(parts)]
    near = lambda v, book: min((int(((v - e) ** 2).sum()), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for i in ids:
                own[near(x[i][p], books[p])[1]].append(x[i][p])
            for k, vs in own.items():
                books[p][k] = [sum(map(int, c)) // len(vs) for c in zip(*vs)]
    found = {i: [near(x[i][p], books[p]) for p in range(parts)] for i in ids}
    flat = ",".join(str(c) for b in books for e in b for c in e)
    by_label = defaultdict(int)
    for i, _, k in rows:
        by_label[k] += sum(d for d, _ in found[i])
    return sorted((i, "".join(f"{k:02x}" for _, k in found[i]), sum(d for d, _ in found[i]), by_label[l], hashlib.sha256(flat.encode()).hexdigest()) for i, _, l in rows)


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(1)
    entries = rng.integers(-300, 300, (64, 4))
    book = vector_codes.Approximation(entries)
    x = rng.integers(-400, 400, (500, 4))
    exact = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    least, most = book.bounds(x)
    assert (least <= exact).all() and (exact <= most).all()
    best, distance, compared = book.nearest(x)
    assert (best == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert 1 <= compared.min() and compared.mean() < 16  # of 64


@pytest.mark.parametrize("kind", ["random", "ties", "few"])
def test_codes_by_definition(spark, kind):
    rng = np.random.default_rng(2)
    n = {"random": 300, "ties": 200, "few": 9}[kind]
    values = rng.normal(size=(n, 32)) if kind != "ties" else rng.integers(-1, 2, (n, 32)) / 256
    rows = [(i * 3, v.tolist(), [None, 1, 2][i % 3]) for i, v in enumerate(values)]
    got = vector_codes.compress(frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == coded_by_definition(rows)


def test_codes_edge_cases(spark):
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=18).tolist(), 1) for i in range(70)]
    odd = [(100, None, 1), (101, [None] * 18, 1), (102, [float("nan")] * 18, None), (103, [float("inf")] * 18, None), (104, [1.0] * 5, None), (105, [], 2), (None, good[3][1], None), (5, good[3][1], 2), (5, good[4][1], 2), (106, [1e300] * 18, 2)]
    from pyspark.sql import functions as F

    df = frame(spark, good + odd).withColumns({c: F.lit(1) for c in ("code", "_key", "_label", "_vector", "label_error", "_of", "slot")})
    out, books = vector_codes.encode(df)
    assert books.shape == (16, 64, 2) and (books[9:] == 0).all()  # 18 numbers in parts of two, padded with zeros
    rows = {(r.vec_id, r.label): r for r in out.collect()}
    assert len(rows) == 70 + 5 and rows[104, None].code is None is rows[105, 2].code
    assert all(len(r.code) == 32 and 16 <= r.refined <= 1024 for r in rows.values() if r.vec_id not in (104, 105))
    assert vector_codes.compress(df).count() == 70 + 6  # an id and label twice
    assert vector_codes.compress(df.limit(0)).count() == 0
    assert vector_codes.compress(frame(spark, [(1, [], 1), (2, None, 1)])).collect()[0].code is None


def test_codes_against_sql(spark, duck):
    ours = sorted(map(tuple, op13_vector_codes(spark, DATA).collect()))
    assert len(ours) > 100 and ours == sorted(duck.execute(vector_codes_sql.SQL).fetchall())


# --- whitening -----------------------------------------------------------------------------------


def check_whitened(spark, df, out, wanted=16):
    """Against the eigenvectors of the covariance in one place."""
    rows = [(r[0], [int(np.floor(64 * c)) + 10**6 for c in r[1]]) for r in df.collect() if r[1] and all(c is not None and np.isfinite(c) for c in r[1])]
    fit = np.array(sorted({tuple(x) for _, x in rows}), np.int64)
    n, S = len(fit), [int(s) for s in fit.astype(object).sum(axis=0)]
    centred = (fit - 10**6) - np.array([s - n * 10**6 for s in S]) / n
    V = centred.T @ centred / n
    e, U = np.linalg.eigh(V)
    e, U = e[::-1], U[:, ::-1]
    got = defaultdict(list)
    for r in out.collect():
        got[r.vec_id, r.component].append(r)
    k = len({c for _, c in got})
    assert k == min(wanted, (e > 1e-12 * e.sum()).sum()) and sum(map(len, got.values())) == k * len(rows)
    for j in range(k):
        one = [(i, x, got[i, j + 1][0]) for i, x in rows]
        assert all(r.n == n and r.deviation == sum((n * c - s) ** 2 for c, s in zip(x, S)) for _, x, r in one)
        mine = np.array([r.whitened for _, _, r in one])
        true = np.array([(np.array(x) - 10**6) - np.array([s - n * 10**6 for s in S]) / n for _, x, _ in one]) @ U[:, j] / np.sqrt(e[j])
        if np.abs(np.diff(e)[max(0, j - 1) : j + 1]).min() > 1e-6 * e[0]:  # else the component is not one direction
            assert np.abs(mine * np.sign(mine @ true) - true).max() < 1e-7 * max(1, np.abs(true).max())
        assert one[0][2].explained == pytest.approx(e[j] / e.sum(), rel=1e-8)
        assert 0 <= one[0][2].identity_error < 1e-8


@pytest.mark.parametrize("kind", ["decaying", "flat", "flat_wide", "narrow", "rank", "big"])
def test_whitening_by_definition(spark, kind):
    rng = np.random.default_rng(4)
    if kind == "decaying":
        x = rng.normal(size=(400, 48)) * 0.9 ** np.arange(48) + 3
    elif kind == "flat":
        x = rng.normal(size=(600, 40))
    elif kind == "flat_wide":
        x = rng.normal(size=(300, 130))
    elif kind == "narrow":
        x = rng.normal(size=(200, 5))
    elif kind == "rank":
        x = rng.integers(-40, 40, (200, 3)) @ rng.integers(-3, 4, (3, 24)) / 64.0
    else:
        x = rng.normal(size=(200, 20)) * 1e4
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(1000 + i, x[i % 7].tolist(), 0) for i in range(50)]  # copies count once
    df = frame(spark, rows).repartition(5)
    check_whitened(spark, df, whitening.whiten(df))


def test_whitening_edge_cases(spark):
    rng = np.random.default_rng(5)
    from pyspark.sql import functions as F

    rows = [(i, rng.normal(size=6).tolist(), 0) for i in range(60)]
    odd = [(100, None, 1), (101, [None] * 6, 1), (102, [float("nan")] * 6, None), (103, [float("inf")] * 6, None), (105, [], 2)]
    df = frame(spark, rows + odd + [(7, rows[7][1], None), (None, rows[3][1], None)]).withColumns({c: F.lit(1) for c in ("component", "n", "_key", "_x", "i", "values")})
    check_whitened(spark, df, whitening.whiten(df))
    # Another length takes no part.
    longer = df.select("vec_id", "embedding").unionAll(spark.createDataFrame([(500, [1.0] * 9)], "vec_id long, embedding array<double>"))
    assert whitening.whiten(longer).where("vec_id = 500").count() == 0
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1, 2], 0), (2, [1, 2], 0)])).count() == 0
    huge = whitening.whiten(frame(spark, [(1, [1e300, 0], 0), (2, [0, 1e-300], 0), (3, [5, 5], 0)])).collect()
    assert {r.vec_id for r in huge} == {1, 2, 3} and huge[0].deviation is None or huge[0].deviation > 0


def test_iteration_certifies_with_small_blocks(spark):
    """Decaying spectra end while the block is a small part of the space; every pass reads the fit list once."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 160)) * np.r_[8 * 0.8 ** np.arange(20), np.full(140, 0.05)]
    rows = whitening._usable_rows(frame(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]), "vec_id", "embedding")
    found = whitening.fit(whitening.fit_list(rows), components=4)
    assert found.vectors.shape == (160, 4) and 3 <= found.passes < 60 and found.identity_error < 1e-9


def test_whitening_query(spark):
    check_whitened(spark, table(spark, DATA, "embeddings"), op11_whiten_embeddings(spark, DATA))
