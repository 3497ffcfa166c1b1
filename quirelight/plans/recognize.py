"""The whole recognition: payloads in, one row of metadata per payload out.

One Arrow pass over the payloads does all that is sequential within a document, and the bodies are
never touched again: they are read once, parsed once and not shuffled. The pass also tells where
titles with authors may stand, as small lists; a second pass decides among these when the evidence
about the names in them has been joined. Identifiers are regular expressions in the JVM, and
registries are equi-joins on keys, so that no document meets another.

The facts are written as Parquet, of which each branch reads the columns it needs. Titles that may be
looked up are tested in the pass against a filter of the registry's titles, so that hardly any other is
written or shuffled.

Rows are told apart by a key of their own, which the pass's written result fixes; ``doc_id`` is
carried along, may repeat or be null, and joins nothing. A malformed payload keeps its row, with
``malformed`` set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelight.functions import identifiers, jstor
from quirelight.functions.hashed import hash_key
from quirelight.functions.text import normalize_text, trim_title
from quirelight.operators import document, lookup
from quirelight.operators.filters import KeyFilter
from quirelight.operators.rows import map_rows, written
from quirelight.sources import requests
from quirelight.sources.registries import Prepared, prepare
from quirelight.sources.requests import MAX_PAGES, MAX_TITLE_BYTES, RESULT_FIELDS

_FACTS = """doc_id long, malformed boolean, total_pages int, meta_title string, meta_key string, jstor_text string, text string, norm_text string,
    abstract string, pages string, headfoot string, candidates array<string>, names array<string>,
    heads array<struct<text:string,options:array<struct<in_row:array<int>,in_face:array<int>>>>>,
    evidence array<array<array<struct<names:array<string>,marked:boolean>>>>"""
_AUTHORS = "array<struct<firstName:string,lastName:string>>"


def load(body: str | None) -> tuple[dict, list]:
    """The JSON object of a request and its pages; both empty if there is none."""
    found = requests.load(body) or {}
    pages = found.get("pages")
    return found, pages if isinstance(pages, list) else []


def heads_of_document(pages: list[document.Page], start: int) -> tuple[list[document.Head], list]:
    """Titles to choose from on the first page of the article, then on the second page if that is the
    first of all, and the blocks with authors that they point to."""
    evidence: list = []
    heads = [h for p in dict.fromkeys([start, *([1] if start == 0 else [])]) if p < len(pages) for h in document.heads_of(pages[p], evidence)]
    return heads, evidence


def _key(normal: str, hashed: bool) -> str:
    """The registries' key of a normalised text."""
    return hash_key(normal) if hashed else normal


def _facts(doc_id: int, body: str | None, registered: KeyFilter | None = None, hashed: bool = False) -> dict:
    own_key = lambda normal: _key(normal, hashed) if normal else None
    asked = lambda key: key if key and (not registered or registered.may_have(key)) else None
    found, raw = load(body)
    meta, total = found.get("metadata"), found.get("totalPages")
    row = {"doc_id": doc_id, "malformed": "pages" not in found}
    if meta is None or total is None or not raw:
        return row
    total = total if type(total) is int and abs(total) < 1 << 31 else 0
    pages = document.parse_pages(raw, MAX_PAGES)
    title = meta.get("Title") if isinstance(meta, dict) else None
    title = title if isinstance(title, str) and len(title.encode()) <= MAX_TITLE_BYTES else None
    key = own_key(normalize_text(title)) if title else None
    text = document.document_text(pages, total)
    start, span = document.page_range(pages, total)
    heads, evidence = heads_of_document(pages, start)
    names = {normalize_text(n) for block in evidence for line in block for author in line for n in author.names if len(n.encode()) > 1}
    return row | {
        "total_pages": total,
        "meta_title": title,
        "meta_key": asked(key),
        "jstor_text": document.jstor_text(pages[0], jstor.URL_PREFIX),
        "text": text,
        "norm_text": normalize_text(text),
        "abstract": document.abstract(pages),
        "pages": span,
        "headfoot": document.headfoot_text(pages),
        # Places in the list tell the last hit, so that titles which cannot be registered leave a gap.
        "candidates": [asked(own_key(c)) for c in document.title_candidates(pages)],
        "names": sorted(_key(n, hashed) for n in names - {""}),
        "heads": [{"text": h.text, "options": [{"in_row": a, "in_face": b} for a, b in h.options]} for h in heads],
        "evidence": [[[a._asdict() for a in line] for line in block] for block in evidence],
    }


def facts(payloads: DataFrame, registered: KeyFilter | None = None, hashed: bool = False) -> DataFrame:
    """What a payload (doc_id, body) tells without any registry; titles that ``registered`` cannot have are left out.
    Keys for registries are texts, or ``hashed``."""
    shared = payloads.sparkSession.sparkContext.broadcast(registered)
    return map_rows(payloads.select(F.col("doc_id").cast("long"), F.col("body").cast("string")), lambda doc_id, body: _facts(doc_id, body, shared.value, hashed), _FACTS)


def known_facts(payloads: DataFrame, registered: KeyFilter | None = None, hashed: bool = False) -> DataFrame:
    """``facts`` with a key for each ``row``, written once to the shared folder, so that the keys stay as they are."""
    return written(facts(payloads, registered, hashed).withColumn("row", F.monotonically_increasing_id()), "facts")


def _titled(row: int, heads: list, evidence: list, types: list | None, hashed: bool = False) -> dict:
    known = {t["key"]: t["type"] for t in types or []}
    choices = [(h["text"], [(o["in_row"], o["in_face"]) for o in h["options"]]) for h in heads]
    blocks = [[[(a["names"], a["marked"]) for a in line] for line in block] for block in evidence]
    found = document.chosen_title(choices, blocks, lambda name: known.get(_key(normalize_text(name), hashed), 0))
    if not found:
        return {"row": row}
    return {"row": row, "title": found[0], "authors": [{"firstName": " ".join(a[:-1]) or None, "lastName": a[-1]} for a in found[1]]}


def titles(known: DataFrame, words: DataFrame, hashed: bool = False) -> DataFrame:
    """``row, title, authors`` of the rows of ``known_facts`` that may have a title; ``words`` is the
    dictionary."""
    open_ = known.where(F.size("heads") > 0)
    asked = open_.select("row", F.explode("names").alias("word_key"))
    told = lookup.word_types(asked, words).where("word_type <> 0").groupBy("row").agg(F.collect_list(F.struct(F.col("word_key").alias("key"), F.col("word_type").alias("type"))).alias("types"))
    joined = open_.select("row", "heads", "evidence").join(told, "row", "left")
    return map_rows(joined.select("row", "heads", "evidence", "types"), lambda *values: _titled(*values, hashed), f"row long, title string, authors {_AUTHORS}")


def recognize(payloads: DataFrame, registry: DataFrame, journals: DataFrame, words: DataFrame) -> DataFrame:
    """One row per payload (doc_id, body): ``doc_id, malformed`` and the result fields."""
    return recognize_with(payloads, prepare(registry, journals, words))


def recognize_with(payloads: DataFrame, registries: Prepared) -> DataFrame:
    """``recognize`` with registries that are written already."""
    return recognized(known_facts(payloads, registries.registered, registries.hashed), registries)


def recognized(known: DataFrame, registries: Prepared) -> DataFrame:
    """The results of ``known_facts``."""
    text, head = F.col("text"), F.col("headfoot")
    plain = jstor.parse_cover(F.col("jstor_text")).isNull() & (F.col("norm_text") != "")
    # The lookups name the row they are for doc_id.
    asked = known.where(plain).withColumn("doc_id", F.col("row"))
    matches = lookup.doi_matches(asked.select("doc_id", "text"))
    looked = lookup.longest_prefix_by_length(matches, registries.dois, registries.lengths) if registries.bucketed else lookup.longest_registered_prefix(matches, registries.dois)
    own_doi = lookup.doi_of_matches(looked)
    meta = asked.where("meta_key IS NOT NULL").select("doc_id", F.lit(-1).alias("cand"), F.col("meta_key").alias("title_key"))
    scanned = asked.select("doc_id", F.posexplode("candidates").alias("cand", "title_key")).where("title_key IS NOT NULL")
    hits = lookup.confirmed_titles(meta.unionAll(scanned), registries.titles, asked.select("doc_id", "norm_text"))
    # Of the scanned titles the last hit counts.
    by_title = hits.groupBy("doc_id").agg(F.max(F.when(F.col("cand") < 0, F.col("doi"))).alias("doi_meta"), F.max_by("doi", F.when(F.col("cand") >= 0, F.col("cand"))).alias("doi_title"))
    journal = lookup.last_journal(asked.select("doc_id", head.alias("text")), registries.journals, registries.hashed)
    named = titles(known.where(plain), registries.words, registries.hashed).withColumnRenamed("title", "t_title").withColumnRenamed("authors", "t_authors")

    base = known.select(
        "row", "doc_id", "malformed", "abstract", "pages", "meta_title", F.coalesce(plain, F.lit(False)).alias("plain"), jstor.parse_cover(F.col("jstor_text")).alias("j"),
        identifiers.isbn(text).alias("isbn"), identifiers.arxiv(text).alias("arxiv"), identifiers.issn(text).alias("issn"),
        identifiers.volume(head).alias("volume"), identifiers.issue(head).alias("issue"), identifiers.year(head).alias("year"),
    )
    wide = base
    for found in (own_doi, by_title, journal):
        wide = wide.join(found.withColumnRenamed("doc_id", "row"), "row", "left")
    wide = wide.join(named, "row", "left")
    # A metadata title that is registered counts unless the page gives one.
    meta_title = F.when(F.col("doi").isNull() & F.col("doi_meta").isNotNull(), F.col("meta_title"))
    when = lambda c: F.when(F.col("plain"), c)
    fields = {
        "type": F.coalesce("j.type", F.lit("journal-article")),
        "title": F.coalesce("j.title", when(trim_title(F.coalesce(F.col("t_title"), meta_title)))),
        "authors": F.coalesce("j.authors", when(F.col("t_authors"))),
        "doi": F.coalesce("j.doi", when(F.coalesce("doi", "doi_meta", "doi_title"))),
        "isbn": when(F.col("isbn")),
        "arxiv": when(F.col("arxiv")),
        "abstract": when(F.col("abstract")),
        "year": F.coalesce("j.year", when(F.col("year"))),
        "container": F.coalesce("j.container", when(F.col("journal"))),
        "publisher": F.col("j.publisher"),
        "pages": F.when(F.col("j").isNull(), when(F.col("pages"))).otherwise(F.col("j.pages")),
        "volume": F.coalesce("j.volume", when(F.col("volume"))),
        "issue": F.coalesce("j.issue", when(F.col("issue"))),
        "issn": when(F.col("issn")),
        "url": F.col("j.url"),
    }
    return wide.select("doc_id", "malformed", *(fields[c].alias(c) for c in RESULT_FIELDS))
