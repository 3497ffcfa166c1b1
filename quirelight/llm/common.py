"""Shared plumbing of the training-data operators: Arrow batch maps, lineage cuts, words.

Word rule used throughout: a word is a maximal run of characters other than the six
ASCII white-space characters (space, tab, line feed, vertical tab, form feed, carriage return).
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java / Python character class.
WHITE = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: bytes.translate table that lower-cases A-Z only.
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the session's shared folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a new one on a single machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return folder or tempfile.mkdtemp(prefix="ckpt-")


def dealt_again(grouped: DataFrame, *keys: str) -> DataFrame:
    """The same rows, with the integer ``keys`` computed anew, so that a join on them deals both sides
    out again. Otherwise the join would take over the partitions of the aggregation, and adaptive
    execution could neither split a key that holds many rows of the other side nor broadcast these if few."""
    return grouped.withColumns({k: F.bitwise_not(F.bitwise_not(k)) for k in keys})


def map_batches(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply an Arrow batch function; nothing outlives a batch, so memory stays bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Slices keep a batch of very long texts from being expanded at once.
            for start, stop in slices(batch, 8 << 20):
                yield kernel(batch.slice(start, stop - start))
        # Workers are used again by other stages; what this one no longer needs goes back.
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of strings each (one row at least)."""
    lengths = None
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
            own = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
            lengths = own if lengths is None else lengths + own
    if lengths is None:
        yield 0, batch.num_rows
        return
    start, total = 0, 0
    for row, size in enumerate(lengths.tolist()):
        if row > start and total + size > limit:
            yield start, row
            start, total = row, 0
        total += size
    if batch.num_rows > start:
        yield start, batch.num_rows


def texts(column: pa.Array) -> list[str]:
    """Python strings of a column; null counts as empty."""
    return [x if x is not None else "" for x in column.to_pylist()]
