"""One Python function per row over Arrow batches, and keys that a join deals out again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def parts(batch: pa.RecordBatch, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of at most ``most_bytes`` bytes of strings (one row at least)."""
    sizes = [pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False) for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)]
    start, held = 0, 0
    for row, size in enumerate(sum(sizes).tolist() if sizes else [0] * batch.num_rows):
        if row > start and held + size > most_bytes:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def map_rows(df: DataFrame, row: Callable[..., dict], schema: str, most_bytes: int = 8 << 20) -> DataFrame:
    """``row`` of each row's values as a dict; keys that it lacks are NULL. Parts of a batch bound
    what is held at once when rows are long."""
    fields = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, most_bytes):
                yield pa.RecordBatch.from_pylist([row(*values) for values in zip(*(c.to_pylist() for c in part.columns))], arrow)

    return df.mapInArrow(run, fields)


def dealt_again(grouped: DataFrame, *keys: str) -> DataFrame:
    """The same rows with their text ``keys`` computed anew. A join on keys that an aggregation has just
    dealt out takes over its partitions, and then adaptive execution can neither split a frequent key
    of the other side nor broadcast a small side; with new keys both sides are dealt out by the join."""
    return grouped.withColumns({k: F.concat(F.col(k), F.lit("")) for k in keys})


#: Bytes of a table, as Spark estimates them, that one part holds when rows grow much in the steps after it.
PART_BYTES = 2 << 20
#: An estimate beyond that is none.
MOST_BYTES = 1 << 46


def dealt(df: DataFrame, key: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """The same rows dealt out by ``key`` in parts whose number grows with the table. Adaptive execution would join them to
    parts of 64 MB, which is the size before rows become many words or long requests: few and very uneven tasks,
    whose sorts do not fit in memory. Aggregations by ``key`` and more find their rows together and deal out nothing."""
    parts = parts_of(df, part_bytes)
    return df.repartition(parts, key) if parts else df.repartition(key)


def parts_of(df: DataFrame, part_bytes: int = PART_BYTES) -> int | None:
    """Parts of ``part_bytes`` bytes, one for each core at least; None if Spark cannot tell the size (an RDD, or a product
    of sizes that a join is taken for)."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-size // part_bytes)) if size < MOST_BYTES else None


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a new one on a single machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return folder or tempfile.mkdtemp(prefix="ckpt-")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in a new folder of the session's shared folder, for branches that each read some of its
    columns. ``forget`` removes it when they are done."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Lineage cut through a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def forget(df: DataFrame) -> None:
    """Removes the files of a table made by ``written``."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
