"""Lookups in registries, as equi-joins; adaptive execution broadcasts a side that proves small and
splits keys that are frequent, as a common word, journal or publisher's prefix is."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.functions import identifiers
from quirelight.functions.hashed import has_hashed_author, hash_key_of
from quirelight.functions.text import ascii_lower, normalize
from quirelight.operators.filters import likely_in
from quirelight.operators.rows import checkpoint, dealt_again, parts_of


def registered(dois: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows whose ``doi`` is registered."""
    return dois.join(registry.select("doi"), "doi", "left_semi")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches with the longest DOI before them in order that is their prefix. Rows come in order of their text,
    DOIs before equal matches, so that the DOIs which are prefixes of the row at hand form a stack."""
    open_: list[str] = []
    first = None
    for batch in batches:
        texts, named = batch.column("low").to_pylist(), batch.column("match").is_valid().to_pylist()
        found = []
        for text, is_match in zip(texts, named):
            first = text if first is None else first
            while open_ and not text.startswith(open_[-1]):
                open_.pop()
            if is_match:
                found.append(open_[-1] if open_ else None)
            elif not open_ or open_[-1] != text:
                open_.append(text)
        rows = batch.filter(batch.column("match").is_valid())
        dois = pa.array(found, pa.string())
        yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("doc_id", "match_no", "match")), dois, pa.array([first if d is None else None for d in found], pa.string())], ["doc_id", "match_no", "match", "doi", "first"])


def longest_registered_prefix(matches: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds ``doi``: the longest registered prefix of the lower-cased ``match`` (shorter than 64
    bytes), NULL if none. ``matches``: doc_id, match_no, match.

    Matches and DOIs are dealt out by ranges of their text and merged in order, one row each, so that neither
    the number of prefixes nor a publisher's short DOI, which is one of many matches, multiplies rows. A
    prefix that fell into an earlier range is one of the first text of the range, too; these, one text a range,
    are looked up by all their prefixes."""
    m = matches.select("doc_id", "match_no", "match", ascii_lower(F.col("match")).alias("low"))
    able = F.octet_length("low") < identifiers.LONG_DOI
    dois = registry.select("doi").where(F.octet_length("doi") < identifiers.LONG_DOI)
    kinds = dict(matches.dtypes)
    blank = [F.lit(None).cast(kinds[c]).alias(c) for c in ("doc_id", "match_no", "match")]
    order = [F.col("low"), F.col("match").isNotNull(), F.col("match_no"), F.col("doc_id")]
    both = m.where(able).unionAll(dois.select(*blank, F.col("doi").alias("low")))
    # Parts grow in number with the tables; joined to parts of 64 MB, as adaptive execution does, rows would be sorted in gigabytes a task.
    parts = parts_of(both)
    ranged = (both.repartitionByRange(parts, *order) if parts else both.repartitionByRange(*order)).sortWithinPartitions(*order)
    found = ranged.mapInArrow(_merged, f"doc_id {kinds['doc_id']}, match_no {kinds['match_no']}, match string, doi string, first string")
    firsts = found.where("first IS NOT NULL").select("first").distinct()
    prefixes = firsts.select("first", F.explode(F.transform(F.sequence(F.lit(1), F.length("first")), lambda n: F.substr(F.col("first"), F.lit(1), n))).alias("prefix"))
    earlier = prefixes.join(dois, F.col("prefix") == F.col("doi"), "left_semi").groupBy("first").agg(F.collect_set("prefix").alias("prefixes"))
    joined = found.join(dealt_again(earlier, "first"), "first", "left")
    fitting = F.filter("prefixes", lambda p: F.startswith(ascii_lower(F.col("match")), p))
    before = F.array_max(F.transform(fitting, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    merged = joined.select("doc_id", "match_no", "match", F.coalesce("doi", before).alias("doi"))
    return merged.unionAll(m.where(~able).select("doc_id", "match_no", "match", F.lit(None).cast("string").alias("doi")))


def longest_prefix_by_length(matches: DataFrame, dois: DataFrame, lengths: list[int]) -> DataFrame:
    """``longest_registered_prefix`` by equality, for few matches and a large table of ``dois`` that stays where it
    is: a match asks for each of its prefixes of the ``lengths`` that there are, 63 at most."""
    m = matches.withColumn("low", ascii_lower(F.col("match")))
    able = F.filter(F.array(*map(F.lit, sorted(lengths))).cast("array<int>"), lambda n: n <= F.length("low"))
    prefixes = m.where(F.octet_length("low") < identifiers.LONG_DOI).select("doc_id", "match_no", F.explode(F.transform(able, lambda n: F.substr(F.col("low"), F.lit(1), n))).alias("doi"))
    best = prefixes.join(dois, "doi", "left_semi").groupBy("doc_id", "match_no").agg(F.max_by("doi", F.length("doi")).alias("doi"))
    return m.join(best, ["doc_id", "match_no"], "left").drop("low")


def extract_doi(texts: DataFrame, registry: DataFrame) -> DataFrame:
    """``doc_id, doi`` of texts with a match, see ``doi_of_matches``."""
    return doi_of_matches(longest_registered_prefix(doi_matches(texts), registry))


def doi_matches(texts: DataFrame) -> DataFrame:
    return texts.select("doc_id", F.posexplode(identifiers.raw_dois(F.col("text"))).alias("match_no", "match"))


def doi_of_matches(looked: DataFrame) -> DataFrame:
    """``doc_id, doi`` from matches with their longest registered prefix: the first match with a registered prefix counts, and gives the longest one if
    that has more than 10 bytes, else the match as it stands; without any, the last match as it
    stands, or lower-cased if it is too long to be looked up."""
    long_ = F.octet_length("match") >= identifiers.LONG_DOI
    plain = F.when(long_, ascii_lower(F.col("match"))).otherwise(F.col("match"))
    known = F.when(F.octet_length("doi") > identifiers.SHORT_DOI, F.col("doi")).when(F.col("doi").isNotNull(), F.col("match"))
    return looked.groupBy("doc_id").agg(F.min_by(known, F.when(F.col("doi").isNotNull(), F.col("match_no"))).alias("known"), F.max_by(plain, "match_no").alias("last")).select("doc_id", F.coalesce("known", "last").alias("doi"))


def last_journal(texts: DataFrame, journals: DataFrame, hashed: bool = False) -> DataFrame:
    """``doc_id, journal``: the last run of words in ``text`` whose normalised form is a journal. ``journals`` are taken
    as they lie, bucketed by ``name_key`` or not; their keys may be ``hashed``."""
    runs = texts.select("doc_id", F.posexplode(identifiers.journal_candidates(F.col("text"))).alias("pos", "journal"))
    normal = normalize(F.col("journal"))
    keyed = runs.withColumn("name_key", hash_key_of(normal) if hashed else normal)
    return keyed.join(journals, "name_key", "left_semi").groupBy("doc_id").agg(F.max_by("journal", "pos").alias("journal"))


def clear_titles(registry: DataFrame, most: int = 5) -> DataFrame:
    """Entries of titles that no more than ``most`` entries have; others are ambiguous."""
    named = registry.where("title_key IS NOT NULL")
    few = named.groupBy("title_key").agg(F.count("*").alias("entries")).where(F.col("entries") <= most).select("title_key")
    return named.join(dealt_again(few, "title_key"), "title_key", "left_semi")


def lookup_titles(titles: DataFrame, registry: DataFrame, texts: DataFrame, most: int = 5) -> DataFrame:
    """DOIs of titles (doc_id, cand, title_key) whose first or second author occurs in the
    document's normalised text (doc_id, norm_text): ``doc_id, cand, doi``. Titles with more than
    ``most`` entries are ambiguous; the first entry that is confirmed counts. The author's text must
    end before the document's."""
    return confirmed_titles(titles, clear_titles(registry, most).withColumn("title_key", F.concat("title_key", F.lit(""))), texts)


def confirmed_titles(titles: DataFrame, clear: DataFrame, texts: DataFrame) -> DataFrame:
    """``lookup_titles`` with entries that are ``clear``. Hits are written first; only texts of documents that
    have one take part in the exchange that brings them together. Entries name authors by text, or by length and
    hash (``author1_len, author1_hash`` and so on), which is tried at each place of the text."""
    if "author1_hash" in clear.columns:
        fields = ("author1_len", "author1_hash", "author2_len", "author2_hash")
        able = (F.col("author1_len") >= 4) | (F.col("author2_len") >= 4)
        confirmed = has_hashed_author("norm_text", *fields) & (F.octet_length("doi") <= identifiers.MOST_DOI_BYTES)
    else:
        fields = ("author1_key", "author2_key")
        able = (F.octet_length("author1_key") >= 4) | (F.octet_length("author2_key") >= 4)
        inside = lambda key: F.coalesce((F.octet_length(key) >= 4) & F.expr(f"contains(substr(norm_text, 1, length(norm_text) - 1), {key})"), F.lit(False))
        confirmed = inside("author1_key") | inside("author2_key")
    hits = checkpoint(titles.join(clear, "title_key").where(able).select("doc_id", "cand", *fields, "doi", "ord"))
    joined = hits.join(likely_in(texts, "doc_id", hits, "doc_id"), "doc_id")
    return joined.where(confirmed).groupBy("doc_id", "cand").agg(F.min_by("doi", "ord").alias("doi"))


def word_type(a, b, c):
    """Signed evidence that a word is a name: columns of counts; missing ones count as 0."""
    a, n = F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0)) + F.coalesce(c, F.lit(0))
    div = lambda x, y: F.floor(x / F.nullif(y, F.lit(0))).cast("long")
    return F.when(n == 0, -a).when(a == 0, n).when(n > a, div(n, a)).when(n < a, -div(a, n)).otherwise(F.lit(0)).cast("long")


def word_types(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Adds ``word_type`` to rows with ``word_key``. The ``dictionary`` is taken as it lies, bucketed by ``word_key`` or not."""
    return words.join(dictionary, "word_key", "left").withColumn("word_type", word_type(F.col("a"), F.col("b"), F.col("c"))).drop("a", "b", "c")
