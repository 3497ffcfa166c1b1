"""Registered queries of the recognition operators, each with equivalent DuckDB SQL if SQL can say it.

The driver's tables hold no page layouts, so that carriers compose inputs from them, over whole
tables: identifier strings from the order tables, layouts from all words of all documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.carriers import LAYOUT_SQL, layout_page_rows, layout_words, table
from quirelight.functions import identifiers, jstor, text
from quirelight.operators import layout, lookup, pages
from quirelight.operators.rows import dealt, written
from quirelight.registered import ORACLES, QUERIES, query  # noqa: F401
from quirelight.sources import registries

def layout_sql(rest: str) -> str:
    return f"WITH words AS ({LAYOUT_SQL}),\nlines AS ({_LINES}),\nblocks AS ({_BLOCKS})\n{rest}"


_KEYS = "doc_id, page_no, flow_no, block_no"
_LINES = f"""SELECT {_KEYS}, line_no, min(x_min) AS x_min, min(y_min) AS y_min, max(x_max) AS x_max, max(y_max) AS y_max,
  sum(length(text) + space::INT)::BIGINT AS char_len, string_agg(text || CASE WHEN space THEN ' ' ELSE '' END, '' ORDER BY word_no) AS text FROM words GROUP BY ALL"""
_BLOCKS = f"""SELECT {_KEYS}, min(x_min) AS x_min, min(y_min) AS y_min, max(x_max) AS x_max, max(y_max) AS y_max,
  min(font_size) AS font_size_min, max(font_size) AS font_size_max, sum(strlen(text))::BIGINT AS text_len FROM words GROUP BY ALL"""
_NORM = "lower(regexp_replace(strip_accents({}), '[^\\p{{L}}]', '', 'g'))"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout_words(table(spark, sf_dir, "documents"))


def _dealt_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same words, dealt out as whole texts before they become rows, so that what groups lines, blocks or pages
    deals out nothing and sorts small parts."""
    return layout_words(_dealt_docs(spark, sf_dir))


def _dealt_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")


def _dealt_page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout_page_rows(_dealt_docs(spark, sf_dir)).select("doc_id", "page_no", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# Scalar functions


@query(f"SELECT doc_id, {_NORM.format('text')} AS norm FROM documents")
def norm_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.normalize(F.col("text")).alias("norm"))


@query("SELECT doc_id, length(text)::INT AS n_chars, strlen(text)::INT AS n_bytes FROM documents")
def char_byte_len(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.length("text").alias("n_chars"), F.octet_length("text").alias("n_bytes"))


@query("""SELECT doc_id, length(regexp_replace(text, '[^\\p{Lu}]', '', 'g'))::INT AS uppercase, length(regexp_replace(text, '[^\\p{Ll}]', '', 'g'))::INT AS lowercase,
  length(regexp_replace(text, '[^\\p{L}]', '', 'g'))::INT AS alphabetic FROM documents""")
def text_info(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.text_info(F.col("text")).alias("i")).select("doc_id", "i.*")


@query("SELECT doc_id, (100 * length(regexp_replace(text, '[^\\p{L} ‐-‒]', '', 'g')) // nullif(length(text), 0))::INT AS percent FROM documents")
def alphabetic_percent(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.alphabetic_percent(F.col("text")).alias("percent"))


@query("SELECT doc_id, regexp_matches(text, '\\.[ \\n\\r]*$') AS dot_last FROM documents")
def dot_last(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.is_dot_last(F.col("text")).alias("dot_last"))


@query(layout_sql("""SELECT doc_id, page_no, flow_no, block_no, line_no,
  coalesce(100 * length(regexp_replace(text, '[^\\p{Lu}]', '', 'g')) // nullif(length(regexp_replace(text, '[^\\p{Lu}\\p{Ll}]', '', 'g')), 0) >= 90, false) AS upper FROM lines"""))
def line_upper(spark, sf_dir):
    return layout.line_upper(_dealt_words(spark, sf_dir))


_PART_HEADINGS = "CASE p_size % 6 WHEN 0 THEN 'Abstract' WHEN 1 THEN 'SUMMARY' WHEN 2 THEN 'abstract' WHEN 3 THEN 'Methods' WHEN 4 THEN 'CONCLUSIONS' ELSE 'Results' END || ' ' || p_name"


@query(f"""SELECT p_partkey, length(regexp_extract(t, '^(A(?i:bstract)|S(?i:ummary))', 1))::INT AS simple,
  CASE WHEN regexp_matches(t, '^B(?i:ackground)') THEN 1 WHEN regexp_matches(t, '^M(?i:ethod)') THEN 2 WHEN regexp_matches(t, '^C(?i:onclusion)') THEN 3 WHEN regexp_matches(t, '^O(?i:bjective)') THEN 4
  WHEN regexp_matches(t, '^R(?i:esult)') THEN 5 WHEN regexp_matches(t, '^P(?i:urpose)') THEN 6 WHEN regexp_matches(t, '^M(?i:easurements)') THEN 7 ELSE 0 END AS structured
  FROM (SELECT p_partkey, {_PART_HEADINGS} AS t FROM part)""")
def abstract_headings(spark, sf_dir):
    t = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_PART_HEADINGS} AS t")
    return t.select("p_partkey", text.simple_abstract_heading(F.col("t")).alias("simple"), text.structured_abstract_heading(F.col("t")).alias("structured"))


@query("""SELECT word, lower(word) IN ('and', 'und') AS conjunction, lower(word) IN ('by', 'prof', 'bsc', 'dsc', 'phd', 'md', 'mph', 'rd', 'ld', 'bch', 'fccp', 'bao', 'pharmd', 'frcp', 'pa-c', 'rac', 'mba',
  'drph', 'mbchb', 'bm', 'rgn', 'ba', 'ms', 'msc') AS degree, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM conversations) GROUP BY ALL""")
def name_stop_words(spark, sf_dir):
    w = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", " ")).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n")).select("word", text.is_conjunction(F.col("word")).alias("conjunction"), text.is_degree(F.col("word")).alias("degree"), "n")


# Identifiers

_ORDER_TEXT = "'See doi:10.' || CAST(1000 + o_custkey % 9000 AS STRING) || '/A' || CAST(o_custkey AS STRING) || '.' || CAST(o_orderkey AS STRING) || '). Also 10.' || CAST(o_orderkey % 900 + 100 AS STRING) || '/x and doi:10.5555/' || o_orderpriority"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", "o_custkey", f"{_ORDER_TEXT} AS text")


_ORDERS = f"orders_text AS (SELECT o_orderkey AS doc_id, {_ORDER_TEXT} AS text FROM orders)"
_DOI = "10.\\d{4,9}/[-._;()\\[\\]+<>/:A-Za-z0-9]+"
_DOI_REGISTRY = """registry AS (SELECT '10.' || (1000 + c_custkey % 9000) || '/a' || c_custkey AS doi FROM customer
  UNION SELECT '10.' || (1000 + o_custkey % 9000) || '/a' || o_custkey || '.' || (o_orderkey // 10) FROM orders
  UNION SELECT '10.5555/' || CASE r_regionkey WHEN 0 THEN '1' WHEN 1 THEN '2-' ELSE '3-m' END FROM region)"""
_DOI_MATCHES = f"matches AS (SELECT doc_id, unnest(m) AS match, generate_subscripts(m, 1) - 1 AS match_no FROM (SELECT doc_id, regexp_extract_all(text, '{_DOI}') AS m FROM orders_text))"
# The prefixes are spelled out, so that DuckDB too joins on equality.
_DOI_BEST = """best AS (SELECT doc_id, match_no, max_by(r.doi, length(r.doi)) AS doi FROM (SELECT doc_id, match_no, substr(lower(match), 1, unnest(generate_series(1, length(match)))) AS doi FROM matches
  WHERE strlen(match) < 64) p JOIN registry r ON p.doi = r.doi GROUP BY ALL)"""


def _doi_registry(spark, sf_dir):
    own = table(spark, sf_dir, "customer").selectExpr("'10.' || CAST(1000 + c_custkey % 9000 AS STRING) || '/a' || CAST(c_custkey AS STRING) AS doi")
    more = table(spark, sf_dir, "orders").selectExpr("'10.' || CAST(1000 + o_custkey % 9000 AS STRING) || '/a' || CAST(o_custkey AS STRING) || '.' || CAST(o_orderkey div 10 AS STRING) AS doi")
    short = table(spark, sf_dir, "region").selectExpr("'10.5555/' || CASE r_regionkey WHEN 0 THEN '1' WHEN 1 THEN '2-' ELSE '3-m' END AS doi")
    return own.unionAll(more).unionAll(short)


def _doi_matches(spark, sf_dir):
    return _orders(spark, sf_dir).select("doc_id", F.posexplode(identifiers.raw_dois(F.col("text"))).alias("match_no", "match"))


@query(f"WITH {_ORDERS} SELECT doc_id, array_to_string(regexp_extract_all(text, '{_DOI}'), ' ') AS dois FROM orders_text")
def extract_doi_raw(spark, sf_dir):
    return _orders(spark, sf_dir).select("doc_id", F.array_join(identifiers.raw_dois(F.col("text")), " ").alias("dois"))


@query(f"WITH {_ORDERS}, {_DOI_MATCHES}, {_DOI_REGISTRY}, {_DOI_BEST} SELECT m.doc_id, m.match_no::INT AS match_no, m.match, b.doi FROM matches m LEFT JOIN best b ON m.doc_id = b.doc_id AND m.match_no = b.match_no")
def doi_longest_prefix(spark, sf_dir):
    return lookup.longest_registered_prefix(_doi_matches(spark, sf_dir), _doi_registry(spark, sf_dir)).select("doc_id", "match_no", "match", "doi")


@query(f"""WITH {_ORDERS}, {_DOI_MATCHES}, {_DOI_REGISTRY}, {_DOI_BEST}
SELECT m.doc_id, coalesce(min_by(CASE WHEN strlen(b.doi) > 10 THEN b.doi ELSE m.match END, m.match_no) FILTER (WHERE b.doi IS NOT NULL), max_by(CASE WHEN strlen(m.match) >= 64 THEN lower(m.match) ELSE m.match END, m.match_no)) AS doi
FROM matches m LEFT JOIN best b ON m.doc_id = b.doc_id AND m.match_no = b.match_no GROUP BY m.doc_id""")
def extract_doi(spark, sf_dir):
    return lookup.extract_doi(_orders(spark, sf_dir).select("doc_id", "text"), _doi_registry(spark, sf_dir))


@query(f"WITH {_DOI_REGISTRY} SELECT DISTINCT doi FROM registry WHERE doi IN (SELECT '10.' || (1000 + c_custkey % 9000) || '/a' || c_custkey || '.' || c_nationkey FROM customer)")
def doi_registered(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").selectExpr("'10.' || CAST(1000 + c_custkey % 9000 AS STRING) || '/a' || CAST(c_custkey AS STRING) || '.' || CAST(c_nationkey AS STRING) AS doi")
    return lookup.registered(asked, _doi_registry(spark, sf_dir)).distinct()


_ISBN_TEXT = "'Printed. ISBN' || CASE p_size % 3 WHEN 0 THEN '-13: ' WHEN 1 THEN ': ' ELSE ' ' END || CASE p_size % 2 WHEN 0 THEN '978-0-' || lpad(CAST(p_partkey AS STRING), 9, '0') ELSE lpad(CAST(p_partkey AS STRING), 9, '0') || 'X' END || ' by ' || p_brand"


@query(f"SELECT p_partkey, CASE WHEN length(d) IN (10, 13) THEN d END AS isbn FROM (SELECT p_partkey, regexp_replace(regexp_extract({_ISBN_TEXT}, '(SBN|sbn)[ —–‒-]?(10|13)?[: ]*([0-9X][0-9X —–‒-]+)', 3), '[^0-9X]', '', 'g') AS d FROM part)")
def extract_isbn(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_ISBN_TEXT} AS text").select("p_partkey", identifiers.isbn(F.col("text")).alias("isbn"))


_ARXIV_TEXT = "CASE s_nationkey % 3 WHEN 0 THEN s_name ELSE 'at arXiv:' || lpad(CAST(s_suppkey AS STRING), 4, '0') || '.' || CAST(s_nationkey AS STRING) || 'v1 [cs]' END"


@query(f"SELECT s_suppkey, nullif(regexp_extract({_ARXIV_TEXT}, 'arXiv:([a-zA-Z0-9./]+)', 1), '') AS arxiv FROM supplier")
def extract_arxiv(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"{_ARXIV_TEXT} AS text").select("s_suppkey", identifiers.arxiv(F.col("text")).alias("arxiv"))


_ISSN_TEXT = "'ISSN' || CASE s_nationkey % 2 WHEN 0 THEN ': ' ELSE ' ' END || lpad(CAST(s_suppkey % 10000 AS STRING), 4, '0') || '-123' || CASE s_nationkey % 3 WHEN 0 THEN 'X' WHEN 1 THEN '5' ELSE 'Y' END"


@query(f"SELECT s_suppkey, nullif(regexp_extract({_ISSN_TEXT}, 'ISSN:?\\s*(\\d{{4}}-\\d{{3}}[\\dX])', 1), '') AS issn FROM supplier")
def extract_issn(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"{_ISSN_TEXT} AS text").select("s_suppkey", identifiers.issn(F.col("text")).alias("issn"))


_LINE_TEXT = "CASE l_linenumber % 3 WHEN 0 THEN 'Vol. ' WHEN 1 THEN 'volume: ' ELSE 'Band ' END || CAST(CAST(l_quantity AS INT) AS STRING) || CASE l_linenumber % 2 WHEN 0 THEN ', No. ' ELSE '; issue ' END || CAST(l_partkey AS STRING) || ' (' || CAST(1700 + l_suppkey % 400 AS STRING) || ')'"
_YEAR, _VOLUME, _ISSUE = "(?:^|\\(|\\s|,)([0-9]{4})(?:\\)|,|\\s|$)", "\\b(?i:volume|vol|v)\\.?[\\s:-]\\s*(\\d+)", "\\b(?i:issue|num|no|number|n)\\.?[\\s:-]\\s*(\\d+)"


@query(f"""SELECT text, count(*) AS n, any_value(CASE WHEN try_cast(y AS INT) BETWEEN 1800 AND 2030 THEN y END) AS year,
  any_value(CASE WHEN length(v) BETWEEN 1 AND 4 THEN v END) AS volume, any_value(CASE WHEN length(i) BETWEEN 1 AND 4 THEN i END) AS issue
FROM (SELECT text, regexp_extract(text, '{_YEAR}', 1) AS y, regexp_extract(text, '{_VOLUME}', 1) AS v, regexp_extract(text, '{_ISSUE}', 1) AS i FROM (SELECT {_LINE_TEXT} AS text FROM lineitem)) GROUP BY text""")
def extract_year_volume_issue(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").selectExpr(f"{_LINE_TEXT} AS text").groupBy("text").agg(F.count("*").alias("n"))
    return t.select("text", "n", identifiers.year(F.col("text")).alias("year"), identifiers.volume(F.col("text")).alias("volume"), identifiers.issue(F.col("text")).alias("issue"))


_JOURNAL_TEXT = "'Vol. 3, Annals of ' || lower(r_name) || '. 12; Journal of ' || CASE c_nationkey % 3 WHEN 0 THEN 'Nothing' ELSE lower(r_name) END || ' 7 ' || c_mktsegment"


@query(f"""WITH t AS (SELECT c_custkey AS doc_id, {_JOURNAL_TEXT} AS text FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
j AS (SELECT DISTINCT 'journalof' || lower(r_name) AS name_key FROM region UNION SELECT 'annalsof' || lower(r_name) FROM region),
runs AS (SELECT doc_id, unnest(m) AS journal, generate_subscripts(m, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}''.]+(?:\\s[\\p{{L}}''.]+)*') AS m FROM t))
SELECT doc_id, max_by(journal, pos) AS journal FROM runs WHERE contains(journal, ' ') AND {_NORM.format("journal")} IN (SELECT name_key FROM j) GROUP BY doc_id""")
def extract_journal(spark, sf_dir):
    texts, names = journal_inputs(spark, sf_dir)
    return lookup.last_journal(texts, registries.journal_set(names))


def journal_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Texts with journals, and names of journals."""
    region = table(spark, sf_dir, "region")
    names = region.selectExpr("explode(array('journalof' || lower(r_name), 'annalsof' || lower(r_name))) AS name_key")
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey")).join(region, F.expr("n_regionkey = r_regionkey"))
    return joined.selectExpr("c_custkey AS doc_id", f"{_JOURNAL_TEXT} AS text"), names


# Archive covers

_ARTICLE_COVER = "'Cover\\n\\nOn ' || p_name || '\\nAuthor(s): Ann ' || p_type || ', Bob Lee and Cy Ray\\nSource: Annals of ' || p_type || ', Vol. ' || p_size || ', No. ' || p_partkey % 12 || ' (' || (1900 + p_partkey % 100) || '), pp. 1-' || p_size || '\\nPublished by: ' || p_brand || ' Press\\nStable URL: http://www.jstor.org/stable/' || p_partkey || '\\n'"
_BOOK_COVER = "'x\\nChapter Title: ' || p_name || '\\nChapter Author(s): Ann ' || p_type || ' and Bob Lee\\n\\nBook Title: All of ' || p_type || '\\nBook Subtitle: ' || p_brand || '\\nBook Author(s): Q\\nPublished by: U Press. (2001)\\nStable URL: http://www.jstor.org/stable/' || p_partkey || '\\n'"


def _cover(spark, sf_dir, cover):
    parts = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size"), "p_partkey")  # few row groups hold many covers
    t = parts.selectExpr("p_partkey", f"{cover} AS cover").select("p_partkey", jstor.parse_cover(F.col("cover")).alias("j"))
    names = F.array_join(F.transform("j.authors", lambda a: F.concat_ws("/", a["firstName"], a["lastName"])), ";")
    return t.select("p_partkey", *(F.col(f"j.{c}") for c in ("type", "title", "container", "publisher", "volume", "issue", "year", "pages", "doi", "url")), names.alias("authors"))


@query("""SELECT p_partkey, 'journal-article' AS type, 'On ' || p_name AS title, 'Annals of ' || p_type AS container, p_brand || ' Press' AS publisher, p_size::VARCHAR AS volume, (p_partkey % 12)::VARCHAR AS issue,
  (1900 + p_partkey % 100)::VARCHAR AS year, '1-' || p_size AS pages, '10.2307/' || p_partkey AS doi, 'http://www.jstor.org/stable/' || p_partkey AS url, 'Ann/' || p_type || ';Bob/Lee;Cy/Ray' AS authors FROM part""")
def jstor_article(spark, sf_dir):
    return _cover(spark, sf_dir, _ARTICLE_COVER)


@query("""SELECT p_partkey, 'book-chapter' AS type, p_name AS title, 'All of ' || p_type || ': ' || p_brand AS container, 'U Press' AS publisher, NULL::VARCHAR AS volume, NULL::VARCHAR AS issue, '2001' AS year,
  NULL::VARCHAR AS pages, '10.2307/' || p_partkey AS doi, 'http://www.jstor.org/stable/' || p_partkey AS url, 'Ann/' || p_type || ';Bob/Lee' AS authors FROM part""")
def jstor_book(spark, sf_dir):
    return _cover(spark, sf_dir, _BOOK_COVER)


_SOURCE = "'\\nSource: Annals of ' || p_type || ', No. ' || p_partkey % 12 || ' (Spring, ' || (1900 + p_partkey % 100) || '), p. ' || p_size || '\\nPublished by: ' || p_brand || ' Press\\nStable URL: http://www.jstor.org/stable/' || p_partkey || '\\n'"
_OTHER_COVERS = f"""CASE p_partkey % 4 WHEN 0 THEN 'Cover\\n\\n' || p_name || '\\nAuthor(s): Someone Else\\nReview by: Ann Lee and Cy Ray' || {_SOURCE}
  WHEN 1 THEN 'Cover\\n\\n' || p_name || '\\nReview by: Plato' || {_SOURCE} WHEN 2 THEN 'Cover\\n\\n' || p_name || {_SOURCE}
  ELSE 'x\\nChapter Title: ' || p_name || '\\n\\nBook Title: All of ' || p_type || '\\nBook Author(s): Ann Lee, Cy Ray\\nPublished by: U Press. (2001)\\nStable URL: http://www.jstor.org/stable/' || p_partkey || '\\n' END"""


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN 'book-chapter' ELSE 'journal-article' END AS type, p_name AS title, CASE p_partkey % 4 WHEN 3 THEN 'All of ' ELSE 'Annals of ' END || p_type AS container,
  CASE p_partkey % 4 WHEN 3 THEN 'U Press' ELSE p_brand || ' Press' END AS publisher, NULL::VARCHAR AS volume, CASE WHEN p_partkey % 4 < 3 THEN (p_partkey % 12)::VARCHAR END AS issue,
  CASE p_partkey % 4 WHEN 3 THEN '2001' ELSE (1900 + p_partkey % 100)::VARCHAR END AS year, CASE WHEN p_partkey % 4 < 3 THEN p_size::VARCHAR END AS pages, '10.2307/' || p_partkey AS doi,
  'http://www.jstor.org/stable/' || p_partkey AS url, CASE p_partkey % 4 WHEN 1 THEN 'Plato' WHEN 2 THEN NULL ELSE 'Ann/Lee;Cy/Ray' END AS authors FROM part""")
def jstor_other_covers(spark, sf_dir):
    """Reviews with and without authors, articles without authors, and chapters that name the book's."""
    return _cover(spark, sf_dir, _OTHER_COVERS)


# Layout

@query(layout_sql("SELECT * EXCLUDE (text), text AS line_text FROM lines"))
def lines_bbox(spark, sf_dir):
    return layout.lines(_dealt_words(spark, sf_dir)).withColumnRenamed("text", "line_text")


@query(layout_sql("SELECT * FROM blocks"))
def blocks_bbox(spark, sf_dir):
    return layout.blocks(_words(spark, sf_dir))


@query(layout_sql("SELECT doc_id, page_no, min(x_min) AS content_x_left, max(x_max) AS content_x_right FROM words GROUP BY ALL"))
def page_edges(spark, sf_dir):
    return layout.page_edges(_words(spark, sf_dir))


@query(layout_sql("""SELECT doc_id, string_agg(piece, '' ORDER BY page_no, flow_no, block_no, line_no, word_no) AS text FROM (
  SELECT *, sum(strlen(piece)) OVER (PARTITION BY doc_id ORDER BY page_no, flow_no, block_no, line_no, word_no ROWS UNBOUNDED PRECEDING) - strlen(piece) + strlen(text) AS bytes FROM (
    SELECT w.*, text || CASE WHEN space THEN ' ' ELSE '' END
      || CASE WHEN word_no = max(word_no) OVER (PARTITION BY doc_id, page_no, flow_no, block_no, line_no) THEN chr(10) || CASE WHEN line_no = max(line_no) OVER (PARTITION BY doc_id, page_no, flow_no, block_no) THEN chr(10) ELSE '' END ELSE '' END AS piece,
      max(page_no) OVER (PARTITION BY doc_id) + 1 AS n FROM words w) WHERE page_no < CASE WHEN n > 2 THEN n - 1 ELSE 2 END)
WHERE bytes < 9999 GROUP BY doc_id"""))
def doc_text(spark, sf_dir):
    return layout.doc_text(layout.text_pages(_words(spark, sf_dir)))


@query(layout_sql("SELECT doc_id, page_no, flow_no, block_no, string_agg(chr(10) || text || chr(10), '' ORDER BY line_no) AS text FROM lines GROUP BY ALL"))
def block_text(spark, sf_dir):
    return layout.block_text(_dealt_words(spark, sf_dir))


@query(layout_sql("SELECT doc_id, page_no, floor(font_size)::INT AS font_size, sum(strlen(text))::BIGINT AS n_bytes FROM words GROUP BY doc_id, page_no, floor(font_size)::INT"))
def font_size_hist(spark, sf_dir):
    return layout.font_histogram(_words(spark, sf_dir))


@query(layout_sql("SELECT doc_id, page_no, coalesce(max(s) FILTER (WHERE n > 500), 0) + 1 AS threshold FROM (SELECT doc_id, page_no, floor(font_size)::INT AS s, sum(strlen(text)) AS n FROM words GROUP BY ALL) GROUP BY ALL"))
def font_threshold(spark, sf_dir):
    return layout.font_threshold(_words(spark, sf_dir))


def _dominating_sql(column: str) -> str:
    keys = f"{_KEYS}, line_no"
    return layout_sql(f"SELECT {keys}, {column} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, first) AS r FROM (SELECT {keys}, {column}, sum(strlen(text)) AS n, min(word_no) AS first FROM words GROUP BY ALL)) WHERE r = 1")


@query(_dominating_sql("font"))
def dominating_font(spark, sf_dir):
    return layout.dominating(_words(spark, sf_dir), "font")


@query(_dominating_sql("font_size"))
def dominating_size(spark, sf_dir):
    return layout.dominating(_words(spark, sf_dir), "font_size")


@query(layout_sql("SELECT doc_id, font, font_size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, font, font_size) AS r FROM (SELECT doc_id, font, font_size, sum(strlen(text)) AS n FROM words GROUP BY ALL)) WHERE r = 1"))
def main_font(spark, sf_dir):
    return layout.main_font(_words(spark, sf_dir))


@query(layout_sql("""SELECT doc_id, page_no, flow_no, block_no, line_no, CASE WHEN mono IS NULL OR before_mono IS NULL THEN 0 WHEN mono = before_mono THEN 1 ELSE 2 END AS fonts_equal,
  list_has_any(faces, before_faces) AS shares_face, list_has_any(fs, before_fs) AS shares_font FROM (
    SELECT *, lag(mono) OVER w AS before_mono, lag(faces) OVER w AS before_faces, lag(fs) OVER w AS before_fs FROM (
      SELECT doc_id, page_no, flow_no, block_no, line_no, CASE WHEN count(DISTINCT font) = 1 THEN min(font) END AS mono, list(DISTINCT font || '/' || font_size || '/' || (y_max - y_min)) AS faces, list(DISTINCT font || '/' || font_size) AS fs FROM words GROUP BY ALL)
    WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY flow_no, block_no, line_no)) WHERE before_faces IS NOT NULL"""))
def line_font_pairs(spark, sf_dir):
    return layout.font_pairs(_words(spark, sf_dir))


# Blocks of a page in order

_LB = "lb AS (SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY flow_no, block_no) - 1 AS lb_no, x_min, y_min, x_max, y_max, font_size_max AS font_size FROM blocks)"


def _layout_blocks(spark, sf_dir):
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy(*layout.PAGE).orderBy("flow_no", "block_no")) - 1
    return layout.blocks(_words(spark, sf_dir)).select("doc_id", "page_no", number.alias("lb_no"), "x_min", "y_min", "x_max", "y_max", F.col("font_size_max").alias("font_size"))


@query(layout_sql(f"""SELECT doc_id, page_no, lb_no::INT AS lb_no, coalesce(y_min - lag(y_max) OVER w >= greatest(font_size, lag(font_size) OVER w), true) OR coalesce(lead(y_min) OVER w - y_max >= greatest(font_size, lead(font_size) OVER w), true) AS separated
FROM lb WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY lb_no)""").replace("\nSELECT doc_id, page_no, lb_no::INT", f",\n{_LB}\nSELECT doc_id, page_no, lb_no::INT"))
def visually_separated(spark, sf_dir):
    return layout.visually_separated(_layout_blocks(spark, sf_dir)).select("doc_id", "page_no", "lb_no", "separated")


@query(layout_sql("""SELECT a.doc_id, a.page_no, a.lb_no::INT AS lb_no, count(b.lb_no) > 0 AS skip FROM lb a LEFT JOIN lb b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND b.lb_no BETWEEN a.lb_no - 4 AND a.lb_no - 1
  AND b.lb_no > 0 AND b.x_min <= a.x_max AND b.x_max >= a.x_min AND b.font_size > a.y_min - b.y_max GROUP BY ALL""").replace("\nSELECT a.doc_id", f",\n{_LB}\nSELECT a.doc_id"))
def skip_block(spark, sf_dir):
    return layout.skipped(_layout_blocks(spark, sf_dir)).select("doc_id", "page_no", "lb_no", "skip")


@query(layout_sql("SELECT doc_id, page_no, lb_no::INT AS lb_no, font_size, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY font_size DESC, lb_no)::INT AS rank FROM lb").replace("\nSELECT doc_id, page_no, lb_no::INT", f",\n{_LB}\nSELECT doc_id, page_no, lb_no::INT"))
def blocks_by_font(spark, sf_dir):
    return layout.by_font_size(_layout_blocks(spark, sf_dir)).select("doc_id", "page_no", "lb_no", "font_size", "rank")


@query(layout_sql("""SELECT doc_id, page_no, lb_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY font_size_max DESC, lb_no) AS r FROM (
  SELECT b.doc_id, b.page_no, b.block_no AS lb_no, font_size_max, t.text FROM blocks b JOIN (SELECT doc_id, page_no, block_no, string_agg(text, ' ' ORDER BY line_no) AS text FROM lines GROUP BY ALL) t
    ON b.doc_id = t.doc_id AND b.page_no = t.page_no AND b.block_no = t.block_no) WHERE 100 * length(regexp_replace(text, '[^\\p{L} ‐-‒]', '', 'g')) // nullif(length(text), 0) >= 70) WHERE r = 1""").replace("block_no AS lb_no", "block_no::INT AS lb_no"))
def largest_block(spark, sf_dir):
    sized = layout.block_texts(_dealt_words(spark, sf_dir), F.col("text"), " ")
    return layout.largest_block(sized.select("doc_id", "page_no", F.col("block_no").alias("lb_no"), F.col("font_size_max").alias("font_size"), "text"))


# Pages

_HEADER_WORDS = "'Journal of ' || translate(source, '0123456789', 'abcdefghij') || ' Studies, Vol. ' || CAST(doc_id % 90 + 1 AS STRING) || ', No. ' || CAST(doc_id % 12 + 1 AS STRING) || ' (' || CAST(1950 + doc_id % 70 AS STRING) || ')'"


def _page_table(words_df):
    return words_df.select("doc_id", "page_no").distinct().select("doc_id", "page_no", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"))


def _with_headers(spark, sf_dir):
    """The layout with one running header line on every page, in flow 1."""
    w = _dealt_words(spark, sf_dir)
    pages_of = layout_page_rows(_dealt_docs(spark, sf_dir), "source")
    lines = pages_of.select("doc_id", "page_no", F.posexplode(F.expr(f"split({_HEADER_WORDS}, ' ')")).alias("word_no", "text"))
    x = F.lit(72.0) + 40 * F.col("word_no")
    own = lines.select("doc_id", "page_no", F.lit(1).alias("flow_no"), F.lit(0).alias("block_no"), F.lit(0).alias("line_no"), "word_no", x.alias("x_min"), F.lit(30.0).alias("y_min"), (x + 20).alias("x_max"), F.lit(40.0).alias("y_max"),
                       F.lit(8.0).alias("font_size"), F.lit(True).alias("space"), F.lit(38.0).alias("baseline"), F.lit(False).alias("bold"), F.lit(1).alias("font"), "text")
    return w.unionByName(own)


_HEADERS_SQL = f"""SELECT * FROM plain UNION ALL SELECT doc_id, page_no, 1, 0, 0, word_no::INT, 72.0 + 40 * word_no, 30.0, 92.0 + 40 * word_no, 40.0, 8.0, true, 38.0, false, 1, text FROM (
  SELECT doc_id, page_no, unnest(h) AS text, generate_subscripts(h, 1) - 1 AS word_no FROM (SELECT DISTINCT doc_id, page_no FROM plain) p JOIN (SELECT doc_id, string_split({_HEADER_WORDS}, ' ') AS h FROM documents) USING (doc_id))"""
_HEADED = f"WITH plain AS ({LAYOUT_SQL}),\nwords AS ({_HEADERS_SQL}),\nlines AS ({_LINES}),\nblocks AS ({_BLOCKS})"


@query(f"""{_HEADED}, t AS (SELECT doc_id, page_no, flow_no, block_no, string_agg(chr(10) || text || chr(10), '' ORDER BY line_no) AS text FROM lines GROUP BY ALL),
f AS (SELECT blocks.*, t.text FROM blocks JOIN t USING (doc_id, page_no, flow_no, block_no))
SELECT DISTINCT a.doc_id, a.page_no, a.flow_no, a.block_no, b.page_no AS other_page, a.text FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.text = b.text AND b.page_no BETWEEN a.page_no + 1 AND a.page_no + 2
WHERE a.y_min >= 15 AND a.y_max <= 777 AND abs(a.x_min - b.x_min) < 10 AND abs(a.y_min - b.y_min) < 10 AND abs(a.x_max - a.x_min - b.x_max + b.x_min) < 10 AND abs(a.y_max - a.y_min - b.y_max + b.y_min) < 10""")
def headfoot_pairs(spark, sf_dir):
    return pages.headfoot_pairs(_with_headers(spark, sf_dir), _dealt_page_table(spark, sf_dir))


@query(f"""{_HEADED} SELECT doc_id, CAST(doc_id % 90 + 1 AS VARCHAR) AS volume, CAST(doc_id % 12 + 1 AS VARCHAR) AS issue, CAST(1950 + doc_id % 70 AS VARCHAR) AS year,
  CASE WHEN source NOT LIKE '%1%' THEN 'Journal of ' || translate(source, '0123456789', 'abcdefghij') || ' Studies' END AS container
FROM documents JOIN (SELECT DISTINCT doc_id FROM words WHERE page_no = 1) USING (doc_id)""")
def headfoot_fields(spark, sf_dir):
    """All repeated blocks; the header comes before the body on each page. Journals whose source has a
    1 in its name are not registered."""
    w = _with_headers(spark, sf_dir).withColumn("flow_no", 1 - F.col("flow_no"))
    known = _docs(spark, sf_dir).where("source NOT LIKE '%1%'")
    journals = registries.journal_set(known.select(F.concat(F.lit("journalof"), F.translate("source", "0123456789", "abcdefghij"), F.lit("studies")).alias("name_key")))
    return pages.headfoot_fields(pages.headfoot_text(pages.headfoot_pairs(w, _dealt_page_table(spark, sf_dir))), journals)


def _numbered(spark, sf_dir):
    """The layout with a page number at the left edge of every page, in flow 2."""
    w = _dealt_words(spark, sf_dir)
    # A page starts with a word in the first column.
    p = layout_page_rows(_dealt_docs(spark, sf_dir)).select("doc_id", "page_no", (F.lit(72.0) + F.col("doc_id") % 3).cast("double").alias("x"))
    number = (1 + F.col("doc_id") % 50 + F.floor(F.col("page_no") / 2)).cast("string")
    own = p.select("doc_id", "page_no", F.lit(2).alias("flow_no"), F.lit(0).alias("block_no"), F.lit(0).alias("line_no"), F.lit(0).alias("word_no"), F.col("x").alias("x_min"), F.lit(760.0).alias("y_min"), (F.col("x") + 10).alias("x_max"), F.lit(770.0).alias("y_max"),
                   F.lit(8.0).alias("font_size"), F.lit(False).alias("space"), F.lit(768.0).alias("baseline"), F.lit(False).alias("bold"), F.lit(1).alias("font"), number.alias("text"))
    return w.unionByName(own)


_NUMBERED = f"""WITH plain AS ({LAYOUT_SQL}), words AS (SELECT * FROM plain UNION ALL SELECT doc_id, page_no, 2, 0, 0, 0, min(x_min), 760.0, min(x_min) + 10, 770.0, 8.0, false, 768.0, false, 1, CAST(1 + doc_id % 50 + page_no // 2 AS VARCHAR)
  FROM plain GROUP BY doc_id, page_no), lines AS ({_LINES}), blocks AS ({_BLOCKS}),
e AS (SELECT doc_id, page_no, min(x_min) AS l, max(x_max) AS r FROM words GROUP BY ALL),
n AS (SELECT w.*, try_cast(w.text AS BIGINT) AS number FROM words w WHERE regexp_full_match(text, '[0-9]+') AND try_cast(w.text AS BIGINT) > 0),
hits AS (SELECT a.*, row_number() OVER (PARTITION BY a.doc_id ORDER BY a.page_no, a.flow_no, a.block_no, a.line_no, a.word_no) AS k FROM n a JOIN lines USING (doc_id, page_no, flow_no, block_no, line_no) JOIN e USING (doc_id, page_no)
  JOIN n b ON a.doc_id = b.doc_id AND b.page_no = a.page_no + 2 AND b.number = a.number + 1 AND abs(a.y_min - b.y_min) < 1 AND abs(a.x_min - b.x_min) < 15
  JOIN lines other ON b.doc_id = other.doc_id AND b.page_no = other.page_no AND b.flow_no = other.flow_no AND b.block_no = other.block_no AND b.line_no = other.line_no
  WHERE (lines.y_max < 100 OR lines.y_min > 692) AND (other.y_max < 100 OR other.y_min > 692) AND (abs(a.x_min - l) < 5 OR abs(a.x_max - r) < 5 OR abs((a.x_min + a.x_max) / 2 - (r - l) / 2) < 5))"""


@query(f"{_NUMBERED} SELECT doc_id, page_no, number FROM hits WHERE k = 1")
def page_numbers(spark, sf_dir):
    return pages.page_numbers(_numbered(spark, sf_dir), None, _dealt_page_table(spark, sf_dir))


@query(f"""{_NUMBERED}, s AS (SELECT doc_id, max(page_no) + 3 AS total FROM plain GROUP BY doc_id),
r AS (SELECT s.doc_id, total, page_no AS start, number, CASE WHEN number = 1 THEN page_no WHEN number = 2 AND page_no >= 1 THEN page_no - 1 ELSE 0 END AS first_page,
  CASE WHEN number = 2 AND page_no >= 1 THEN 1 ELSE number END AS n FROM s LEFT JOIN (SELECT * FROM hits WHERE k = 1) h USING (doc_id))
SELECT doc_id, first_page::INT AS first_page, CASE WHEN n > 1 THEN n || '-' || (n + total - first_page - 1) WHEN n = 1 THEN CAST(n + total - first_page - 1 AS VARCHAR) ELSE CAST(total AS VARCHAR) END AS pages FROM r""")
def page_range(spark, sf_dir):
    sheets = written(_dealt_page_table(spark, sf_dir), "sheets")  # counted once
    totals = sheets.groupBy("doc_id").agg((F.max("page_no") + 3).alias("total_pages"))
    none = totals.select("doc_id", F.lit(0).alias("first_page"))
    return pages.page_range(pages.page_numbers(_numbered(spark, sf_dir), None, sheets), none, totals)


@query(f"""WITH p AS (SELECT DISTINCT doc_id, page_no, CASE WHEN page_no < doc_id % 4 THEN 500.0 + page_no % 2 ELSE 612.0 END AS width FROM ({LAYOUT_SQL})), w AS (SELECT doc_id, list(width ORDER BY page_no) AS w, count(*) AS n FROM p GROUP BY doc_id)
SELECT doc_id, (CASE WHEN n = 2 THEN (w[1] <> w[2])::INT WHEN n = 3 THEN (w[1] <> w[2] AND w[2] = w[3])::INT WHEN n < 4 THEN 0 WHEN w[1] <> w[2] AND w[2] <> w[3] THEN 0
  ELSE coalesce(list_max(list_filter(generate_series(1, n - 3), lambda i: w[i] <> w[i + 1] AND w[i + 1] = w[i + 2])), 0) END)::INT AS first_page FROM w""")
def first_page_width(spark, sf_dir):
    p = _page_table(_words(spark, sf_dir)).withColumn("width", F.expr("CASE WHEN page_no < doc_id % 4 THEN 500D + page_no % 2 ELSE 612D END"))
    return pages.first_page_by_width(p)


@query(f"""WITH f AS (SELECT DISTINCT doc_id, page_no, CASE WHEN page_no < doc_id % 3 THEN 100 + page_no ELSE font END AS font FROM ({LAYOUT_SQL})), n AS (SELECT doc_id, max(page_no) + 1 AS n FROM f GROUP BY doc_id),
c AS (SELECT a.doc_id, a.page_no, max((a.font = b.font)::INT) AS shared, count(*) AS compared FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.page_no > a.page_no GROUP BY ALL)
SELECT n.doc_id, coalesce(max(page_no + 1) FILTER (WHERE shared = 0 AND compared >= 2 AND n >= 3 AND page_no <= n - 3), 0)::INT AS first_page FROM n LEFT JOIN c USING (doc_id) GROUP BY n.doc_id""")
def first_page_fonts(spark, sf_dir):
    w = _words(spark, sf_dir).withColumn("font", F.expr("CASE WHEN page_no < doc_id % 3 THEN 100 + page_no ELSE font END"))
    return pages.first_page_by_fonts(w)


# Registries


@query(f"""WITH d AS (SELECT doc_id, {_NORM.format("text")} AS norm_text, {_NORM.format("string_split(text, chr(10))[1]")} AS title_key, {_NORM.format("string_split(text, chr(10))[-1]")} AS author1_key, nullif({_NORM.format("coalesce(string_split(text, chr(10))[2], '')")}, '') AS author2_key FROM documents),
r AS (SELECT title_key, author1_key, author2_key, '10.5555/d' || doc_id AS doi, doc_id AS ord, count(*) OVER (PARTITION BY title_key) AS n FROM d),
h AS (SELECT d.doc_id, r.doi, r.ord FROM d JOIN r ON d.title_key = r.title_key AND n <= 5 WHERE (strlen(r.author1_key) >= 4 AND contains(substr(norm_text, 1, length(norm_text) - 1), r.author1_key)) OR (strlen(r.author2_key) >= 4 AND contains(substr(norm_text, 1, length(norm_text) - 1), r.author2_key)))
SELECT doc_id, 0 AS cand, min_by(doi, ord) AS doi FROM h GROUP BY doc_id""")
def title_lookup(spark, sf_dir):
    texts, registry = title_inputs(spark, sf_dir)
    return lookup.lookup_titles(texts.select("doc_id", F.lit(0).alias("cand"), "title_key"), registry, texts.select("doc_id", "norm_text"))


def title_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Normalised texts with their titles, and a registry of these."""
    lines = F.split(F.col("text"), "\n")
    norm = lambda c: text.normalize(c)
    d = _docs(spark, sf_dir).select("doc_id", norm(F.col("text")).alias("norm_text"), norm(F.element_at(lines, 1)).alias("title_key"), norm(F.element_at(lines, -1)).alias("author1_key"), norm(F.try_element_at(lines, F.lit(2))).alias("author2_key"))
    d = written(d, "titles")  # normalised once
    return d, d.select("title_key", "author1_key", "author2_key", F.concat(F.lit("10.5555/d"), F.col("doc_id").cast("string")).alias("doi"), F.col("doc_id").alias("ord"))


@query(f"""WITH w AS (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w FROM documents), k AS (SELECT {_NORM.format("w")} AS word_key, regexp_matches(w, '^\\p{{Lu}}') AS up, length(w) > 6 AS long FROM w),
d AS (SELECT word_key, count(*) FILTER (WHERE NOT up) AS a, count(*) FILTER (WHERE up AND NOT long) AS b, count(*) FILTER (WHERE up AND long) AS c FROM k WHERE word_key <> '' GROUP BY word_key)
SELECT word_key, (CASE WHEN b + c = 0 THEN -a WHEN a = 0 THEN b + c WHEN b + c > a THEN (b + c) // a WHEN b + c < a THEN -(a // (b + c)) ELSE 0 END)::BIGINT AS word_type FROM d""")
def word_type(spark, sf_dir):
    dictionary = written(registries.word_counts(word_inputs(spark, sf_dir)), "dictionary")  # counted once
    return lookup.word_types(dictionary.select("word_key"), dictionary)


def word_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of words in three columns, several rows a key."""
    w = _docs(spark, sf_dir).select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    counted = w.groupBy("w").agg(F.count("*").alias("n"))
    up, long_ = F.col("w").rlike(r"^\p{Lu}"), F.length("w") > 6
    # A filter on the key would be moved below the count and normalise each occurrence of a word; an array that is empty stays here.
    kept = F.explode(F.filter(F.array(text.normalize(F.col("w"))), lambda key: key != ""))
    return counted.select(kept.alias("word_key"), *(F.when(c, F.col("n")).otherwise(0).alias(k) for k, c in (("a", ~up), ("b", up & ~long_), ("c", up & long_))))


from quirelight import packed_queries, recognition_queries  # noqa: E402, F401  (register the queries over hashed registries and over requests)
