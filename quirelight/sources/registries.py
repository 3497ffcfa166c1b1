"""Lookup tables: registered titles with DOIs, journal names, evidence about words."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.functions.identifiers import LONG_DOI
from quirelight.operators import lookup
from quirelight.operators.filters import KeyFilter, key_filter
from quirelight.operators.rows import dealt_again, shared_folder, written


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """``title_key, author1_key, author2_key, doi, ord``: keys are normalised texts."""
    return spark.read.parquet(path).select("title_key", "author1_key", "author2_key", "doi", "ord")


def read_journals(spark: SparkSession, path: str) -> DataFrame:
    """A set of names."""
    return journal_set(spark.read.parquet(path))


def journal_set(names: DataFrame) -> DataFrame:
    return dealt_again(names.select("name_key").where("name_key IS NOT NULL").dropDuplicates(["name_key"]), "name_key")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    return word_counts(spark.read.parquet(path))


def word_counts(words: DataFrame) -> DataFrame:
    """``word_key, a, b, c``; counts of rows with one key add up."""
    return dealt_again(words.where("word_key IS NOT NULL").groupBy("word_key").agg(*(F.sum(c).cast("long").alias(c) for c in "abc")), "word_key")


@dataclass
class Prepared:
    """Registries as the recognition asks for them.

    ``titles`` has entries of unambiguous titles only, ``journals`` and ``words`` one row a key. ``bucketed`` tables
    are written in the partitions that joins on their key ask for, so that no join moves them: right for many small
    batches against large registries; ``dois`` are then distinct and ``lengths`` theirs. Else joins deal tables out,
    and adaptive execution can split keys that one large batch has very often."""

    titles: DataFrame
    dois: DataFrame
    journals: DataFrame
    words: DataFrame
    lengths: list[int]
    registered: KeyFilter
    bucketed: bool
    #: Keys are hashes, see ``functions.hashed``.
    hashed: bool = False


def _bucketed(df: DataFrame, key: str, name: str, buckets: int) -> DataFrame:
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key)
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", f"{shared_folder(spark)}/{table}").format("parquet").saveAsTable(table)
    return spark.table(table)


def prepare(titles: DataFrame, journals: DataFrame, words: DataFrame, buckets: int | None = None) -> Prepared:
    """``titles`` as of ``read_titles``, ``journals`` a set of names, ``words`` counts by key. With ``buckets`` the
    tables are bucketed; the number should be near the shuffle partitions of the batches. If titles come from databases
    (``sources.packed``), names and words have hashed keys as well: read from records, or by ``hash_keys``."""
    hashed = "author1_hash" in titles.columns
    if hashed:  # databases cannot prune columns, and are read once
        titles = written(titles, "entries")

    if not buckets:
        # Each of the others is read by one join, or by one scan.
        clear = written(lookup.clear_titles(titles), "titles")
        return Prepared(clear, titles.select("doi"), journals, words, [], key_filter(clear, "title_key"), False, hashed)
    put = lambda df, key, name: _bucketed(df, key, name, buckets)
    clear = put(lookup.clear_titles(titles), "title_key", "titles")
    dois = put(titles.select("doi").where(F.octet_length("doi") < LONG_DOI).distinct(), "doi", "dois")
    lengths = [r[0] for r in dois.select(F.length("doi").alias("n")).distinct().collect()]  # 63 at most
    return Prepared(clear, dois, put(journals, "name_key", "journals"), put(words, "word_key", "words"), lengths, key_filter(clear, "title_key"), True, hashed)
