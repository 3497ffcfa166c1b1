"""One Python function a value over Arrow arrays, in slices of bounded size: what Python holds beside the arrays does not
grow with the rows or the lengths of texts in a batch, as it does with series of pandas, which hold all arguments and results at once."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa

from quirelight.operators.rows import parts

SLICE_BYTES = 1 << 20


def each(function: Callable, kind: pa.DataType, *arrays: pa.Array, most_bytes: int = SLICE_BYTES) -> pa.Array:
    """``function`` of the values of ``arrays`` row by row, as an array of ``kind``."""
    batch = pa.RecordBatch.from_arrays(list(arrays), [str(n) for n in range(len(arrays))])
    return pa.chunked_array([pa.array([function(*row) for row in zip(*(c.to_pylist() for c in part.columns))], kind) for part in parts(batch, most_bytes)], kind).combine_chunks()
