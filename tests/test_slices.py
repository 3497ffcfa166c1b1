"""Functions of texts hold little beside the Arrow arrays of a batch, however many rows and bytes it has."""

import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirelight.functions import hashed, text
from quirelight.functions.slices import each

ROWS = 2000
LONG = pa.array([f"Ñandú {i} " * 1000 for i in range(ROWS)])


@pytest.mark.parametrize("name", ["_normalized", "hash_key_of", "signed_hash_of", "has_hashed_author"])
def test_texts_of_a_batch_are_not_held_at_once(name):
    function = getattr(text if name == "_normalized" else hashed, name).func
    rest = [pa.array([None] * ROWS, pa.int64())] * 4 if name == "has_hashed_author" else []
    tracemalloc.start()
    try:
        found = function(LONG, *rest)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(found) == ROWS and LONG.nbytes > 20e6 and peak < 8e6


def test_slices_keep_rows_and_order():
    texts = pa.array(["a", None, "bc" * 40, "", "d"])
    size = lambda t, n: None if t is None else len(t) + n
    for most in (1, 50, 1 << 20):
        assert each(size, pa.int64(), texts, pa.array([1, 2, 3, 4, 5]), most_bytes=most).to_pylist() == [2, None, 83, 4, 6]
    empty = each(size, pa.int64(), pa.array([], pa.string()), pa.array([], pa.int64()))
    assert isinstance(empty, pa.Array) and len(empty) == 0 and empty.type == pa.int64()


def test_missing_authors_and_texts(spark):
    rows = spark.createDataFrame([("xbrownx", 5, 1, None, None), (None, None, None, 5, 1), ("xbrownx", None, None, 5, int(hashed.hash_key("brown")[:8], 16))], "t string, a long, b long, c long, d long")
    assert [r.found for r in rows.select(hashed.has_hashed_author(*(F.col(c) for c in "tabcd")).alias("found")).collect()] == [False, False, True]
