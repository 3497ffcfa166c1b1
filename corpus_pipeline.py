"""From raw documents to token ids: five stages, each one operator of ``quirelight.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. Null and empty texts, repeated rows, null ids and empty tables pass
as the operators define it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.llm import bpe, line_dedup, mixing, quality, simhash
from quirelight.llm.common import shared_folder, table
from quirelight.llm.queries import tokenizer

#: SQL can express neither the classifier nor the mix.
ORACLE_SQL = None


def _same_columns(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The columns of ``docs``, with n_chars brought up to date."""
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    labels = table(spark, sf_dir, "labels")
    return quality.keep(docs, quality.fit(docs, labels))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many documents share."""
    return _same_columns(docs, line_dedup.line_dedup(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the smallest id, ids before nulls, then the
    smallest hash of the row. The rule is that of the SimHash operator's contract, 4-word shingles and
    at most 4 differing bits of 64, which is stricter than a similarity of 0.8."""
    return simhash.one_of_each(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, shuffled within shards."""
    return _same_columns(docs, mixing.mix(docs))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row and digests of them and of the text they decode to."""
    return bpe.round_trip(docs, tokenizer(), with_ids=True)


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mix", mix_stage),
    ("tokens", token_stage),
]


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again. A stage's table
    goes once the next one is written; the last table stays, since the result reads it."""
    docs, base = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            _remove(spark, f"{base}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
