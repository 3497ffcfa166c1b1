"""Queries on registries that hold hashes: they are written as records and databases, read again, and give
the results of the registries of texts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight import queries
from quirelight.functions.hashed import hash_key_of
from quirelight.operators import lookup
from quirelight.operators.rows import shared_folder, written
from quirelight.registered import ORACLES, query
from quirelight.sources import packed


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(ORACLES["extract_journal"])
def extract_journal_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, names = queries.journal_inputs(spark, sf_dir)
    path = _folder(spark, "journals")
    packed.write_journals(names, path)
    return lookup.last_journal(texts, packed.read_journals(spark, path), hashed=True)


@query(ORACLES["word_type"])
def word_type_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    each, path = written(queries.word_inputs(spark, sf_dir), "counted"), _folder(spark, "words")  # counted once
    # As in such files, one word may have several records.
    packed.write_words(each, path)
    asked = each.select("word_key").distinct().select(F.col("word_key").alias("text"), hash_key_of(F.col("word_key")).alias("word_key"))
    return lookup.word_types(asked, packed.read_words(spark, path)).select(F.col("text").alias("word_key"), "word_type")


# The format has lengths of authors in 8 bits.
@query(ORACLES["title_lookup"].replace("_key) >= 4 AND", "_key) BETWEEN 4 AND 255 AND"))
def title_lookup_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, registry = queries.title_inputs(spark, sf_dir)
    path = _folder(spark, "databases")
    packed.write_titles(registry, path)
    asked = texts.select("doc_id", F.lit(0).alias("cand"), hash_key_of(F.col("title_key")).alias("title_key"))
    return lookup.lookup_titles(asked, packed.read_titles(spark, path), texts.select("doc_id", "norm_text"))
