"""Queries over requests: decoding, line blocks, titles, abstracts and the whole recognition.

Requests are composed from whole documents, with planted heads, headers, identifiers and registries,
so that SQL can state what the rules must find in each variant of the layout.
"""

from __future__ import annotations

import gzip
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight import carriers
from quirelight.carriers import LAYOUT_SQL, composed, layout_json, layout_words, request, table, text_block, words_of
from quirelight.operators import document
from quirelight.operators import line_blocks as folds
from quirelight.operators.rows import map_rows
from quirelight.plans import recognize as plan
from quirelight.registered import ORACLES, query
from quirelight.sources import registries, requests

#: Words of each document, and the letters that stand for its number.
_COUNTED = "d AS (SELECT doc_id, source, len(list_filter(string_split(replace(coalesce(text, ''), chr(10), ' '), ' '), lambda x: x <> '')) AS n FROM documents)"
_DIGITS, _LETTERS = "0123456789", "abcdefghij"


def _docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _named(number) -> str:
    return "Q" + str(number).translate(str.maketrans(_DIGITS, _LETTERS))


def _listed(authors: Column) -> Column:
    return F.array_join(F.transform(authors, lambda a: F.concat_ws("/", a["firstName"], a["lastName"])), ";")


# Decoding

_WORD_COLUMNS = "doc_id, page_no, flow_no, block_no, line_no, word_no, x_min, y_min, x_max, y_max, font_size, space, baseline, bold, font, text"


@query(f"WITH words AS ({LAYOUT_SQL}) SELECT {_WORD_COLUMNS} FROM words WHERE page_no < 5")
def words(spark, sf_dir):
    decoded = requests.read_words(carriers.payloads(_docs(spark, sf_dir)))
    return decoded.select(*_WORD_COLUMNS.split(", "))


@query("""SELECT doc_id, CASE WHEN doc_id % 12 IN (1, 2, 5, 9) THEN NULL WHEN doc_id % 12 = 6 THEN 4 WHEN doc_id % 12 IN (7, 10) THEN 0 ELSE 9 END::INT AS total_pages,
  CASE WHEN doc_id % 12 IN (1, 2, 4, 5, 8, 9) THEN NULL ELSE 'Title ' || doc_id END AS meta_title,
  doc_id % 12 IN (1, 2, 3, 5) AS malformed, doc_id % 12 NOT IN (1, 2, 5, 9) AS complete FROM documents""")
def parse_requests(spark, sf_dir):
    """Requests cut in half, in a list, without pages, with too long a title, with text after them, with a key
    given twice, and with values of other kinds."""

    def row(doc_id, text):
        kind = doc_id % 12
        title = f"Title {doc_id}" if kind != 4 else "x" * (requests.MAX_TITLE_BYTES + 1)
        sent = {"metadata": {"Title": title}, "totalPages": 9} | {7: {"totalPages": 3.0}, 8: {"metadata": {"Title": 7}}, 9: {"metadata": None}, 10: {"totalPages": "3"}}.get(kind, {})
        pages = carriers.pages_json([[blocks] for blocks in layout_json(doc_id % 3, words_of(text))])
        body = f'{json.dumps(sent)[:-1]}, "{"sheets" if kind == 3 else "pages"}": {pages}}}'
        return {1: body[: len(body) // 2], 2: f"[{body}]", 5: body + " x", 6: body[:-1] + ', "totalPages": 4}', 11: body + " \n"}.get(kind, body)

    return requests.parse(composed(_docs(spark, sf_dir), row, "text")).select("doc_id", "total_pages", "meta_title", "malformed", "complete")


@query("SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 1, 4) THEN sha256(text) END AS body_sha256, CASE WHEN doc_id % 5 IN (0, 1, 4) THEN strlen(text)::INT END AS n_bytes FROM documents")
def payload_bodies(spark, sf_dir):
    """Bodies plain, in gzip, in gzip that is cut off, with a byte that is no UTF-8, and in gzip with bytes after it."""

    def sent(i, text):
        if text is None:
            return {"doc_id": i}
        body = text.encode()
        zipped = gzip.compress(body, mtime=0) if i % 5 in (1, 2, 4) else b""
        return {"doc_id": i, "content": (body, zipped, zipped[: 10 + len(zipped) // 2], b"\xff" + body, zipped + b"more")[i % 5]}

    found = requests.bodies(map_rows(_docs(spark, sf_dir).select("doc_id", "text"), sent, "doc_id long, content binary"))
    return found.select("doc_id", F.sha2("body", 256).alias("body_sha256"), F.octet_length("body").alias("n_bytes"))


# Line blocks

#: By doc_id % 8: pitch of lines, extra distance of blocks, and size, font and weight of a block.
_FACES = (
    (14, 0, lambda b: (10.0, 5, False)),  # one line block a page
    (14, 6, lambda b: (10.0, 5, False)),  # blocks apart
    (14, 0, lambda b: (10.0 + 2 * (b % 2), 5, False)),  # sizes too different
    (14, 0, lambda b: (10.0 + b % 2, 5, False)),  # sizes near enough
    (14, 0, lambda b: (10.0, 5, b % 2 > 0)),  # weights
    (14, 0, lambda b: (10.0, 5 + b % 2, False)),  # fonts
    (24, 0, lambda b: (10.0, 5, False)),  # lines apart
    (24, 0, lambda b: (10.0, 5, False)),  # lines as far apart, but upper-case
)


@query(f"""WITH {_COUNTED}, t AS (SELECT doc_id, unnest(generate_series(0, n - 1)) AS i FROM d WHERE n > 0),
l AS (SELECT doc_id, (i // 200)::INT AS page_no, (i % 200 // 10)::INT AS line, string_agg(CASE WHEN doc_id % 8 = 7 THEN 'W' ELSE 'w' END || i || CASE WHEN i % 10 < 9 THEN ' ' ELSE '' END, '' ORDER BY i) AS text
  FROM t WHERE i < 1000 GROUP BY ALL),
g AS (SELECT *, CASE WHEN doc_id % 8 IN (0, 3, 7) THEN 0 WHEN doc_id % 8 = 6 THEN line ELSE line // 5 END AS own FROM l)
SELECT doc_id, page_no, (dense_rank() OVER (PARTITION BY doc_id, page_no ORDER BY own) - 1)::INT AS block_no, string_agg(text, ' ' ORDER BY line) AS text FROM g GROUP BY doc_id, page_no, own""")
def line_blocks(spark, sf_dir):
    def row(doc_id, body):
        pages = document.parse_pages(plan.load(body)[1])
        return {"doc_id": doc_id, "blocks": [{"page_no": p, "block_no": n, "text": b.text()} for p, page in enumerate(pages) for n, b in enumerate(page.blocks)]}

    found = map_rows(_faced(spark, sf_dir), row, "doc_id long, blocks array<struct<page_no:int,block_no:int,text:string>>")
    return found.select("doc_id", F.explode("blocks").alias("b")).select("doc_id", "b.*")


def _faced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with the layouts of ``_FACES``."""

    def sent(doc_id, text):
        pitch, extra, style = _FACES[doc_id % 8]
        tokens = [f"{'W' if doc_id % 8 == 7 else 'w'}{i}" for i in range(len(words_of(text)))]
        return request([[blocks] for blocks in layout_json(0, tokens, pitch=pitch, extra=extra, style=style)])

    return composed(_docs(spark, sf_dir), sent, "text")


@query(ORACLES["line_blocks"])
def line_blocks_fold(spark, sf_dir):
    """The same blocks, folded in the JVM over the words of each page."""
    found = folds.line_blocks_of_pages(requests.read_pages(_faced(spark, sf_dir)))
    return found.select("doc_id", "page_no", F.col("lb_no").alias("block_no"), "text")


# Titles and authors

_TITLE = "A Longer Study of Everything Printed in "


def _head(variant: int, name: str) -> list[list]:
    """The head of a first page, by variant: blocks in reading order."""
    title = text_block(100, _TITLE + name, 30, 50)
    authors = lambda y, text="Ann Brown, Bob Grey and Cy Stone", font=51, x=72.0: text_block(y, text, 14, font, x)
    return [
        lambda: [title, authors(160)],
        lambda: [text_block(100, (_TITLE + name).upper(), 10, 50), text_block(160, "Ann Brown, Bob Grey and Cy Stone", 10, 51)],  # told by upper case only
        lambda: [title, text_block(145, "with some further notes", 20, 50), authors(200)],  # a subtitle between
        lambda: [authors(70), text_block(120, _TITLE + name, 30, 50)],  # authors above
        lambda: [title, authors(160, "Ann Brown"), authors(160, "Bob Grey", 52, 300.0)],  # in one row, in different faces
        lambda: [title, authors(160, "Ann Brown ^a , Bob Grey")],  # a raised mark ends a name
        lambda: [title, authors(160, "The Study, Big Words")],  # no names, by evidence
    ][variant]()


#: What the dictionary holds: lower-case, and upper-case occurrences.
_EVIDENCE = {"ann": (0, 1), "bob": (0, 1), "cy": (0, 2), "the": (5, 0), "study": (9, 2), "longer": (3, 0), "everything": (4, 0), "grey": (3, 1)}


def _dictionary(spark) -> DataFrame:
    return registries.word_counts(spark.createDataFrame([(k, a, b, 0) for k, (a, b) in _EVIDENCE.items()], "word_key string, a long, b long, c long"))


_TITLE_SQL = f"""CASE doc_id % 7 WHEN 6 THEN NULL WHEN 1 THEN upper('{_TITLE}' || 'Q' || translate(doc_id::VARCHAR, '{_DIGITS}', '{_LETTERS}')) || ' ' ELSE '{_TITLE}Q' || translate(doc_id::VARCHAR, '{_DIGITS}', '{_LETTERS}') || ' ' END"""


def _headed(doc_id: int, text: str | None) -> list[list[list]]:
    """Flows of each page: head, then all words of the document in lower case."""
    pages = layout_json(0, [t.lower() for t in words_of(text)], 200.0, plain=True)
    heads = _head(doc_id % 7, _named(doc_id))
    return [[heads if p == 0 else [], blocks] for p, blocks in enumerate(pages or [[]])]


@query(f"SELECT doc_id, {_TITLE_SQL} AS title, CASE WHEN doc_id % 7 < 4 THEN 'Ann/Brown;Bob/Grey;Cy/Stone' WHEN doc_id % 7 < 6 THEN 'Ann/Brown;Bob/Grey' END AS authors FROM documents")
def title_authors(spark, sf_dir):
    sent = composed(_docs(spark, sf_dir), lambda doc_id, text: request(_headed(doc_id, text)), "text")
    known = plan.known_facts(sent)
    found = plan.titles(known, _dictionary(spark))
    return known.select("row", "doc_id").join(found, "row", "left").select("doc_id", "title", _listed(F.col("authors")).alias("authors"))


_AUTHOR_LINE = "CASE s_nationkey % 3 WHEN 0 THEN 'by Ann ' ELSE 'Ann M. ' END || chr(65 + CAST(s_suppkey % 26 AS INT)) || 'rown, PhD and Bob Lee*; ' || CASE s_nationkey % 2 WHEN 0 THEN 'Cy de Ray' ELSE 'Eva Stone' END"


@query("""SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN 'Ann ' ELSE 'Ann M ' END || chr(65 + CAST(s_suppkey % 26 AS INT)) || 'rown;Bob Lee' || CASE s_nationkey % 2 WHEN 0 THEN '' ELSE ';Eva Stone' END AS authors FROM supplier""")
def authors_from_line(spark, sf_dir):
    t = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"{_AUTHOR_LINE} AS line")

    def row(key, line):
        words_ = [document.Word(0, 0, 1, 1, 10, True, 9, False, 1, w) for w in line.split(" ")]
        return {"s_suppkey": key, "authors": ";".join(" ".join(a) for a in document.authors_of_line(document.Line(0, 0, words_)))}

    return map_rows(t, row, "s_suppkey long, authors string")


@query("""SELECT s_suppkey, '[' || CASE WHEN s_nationkey % 3 = 0 THEN '' ELSE '{"firstName":"Ann M","lastName":"' || s_name || '"},' END || '{"lastName":"Plato"}]' AS authors FROM supplier""")
def authors_json(spark, sf_dir):
    listed = "CASE WHEN s_nationkey % 3 = 0 THEN '' ELSE 'Ann M\\t' || s_name || '\\n' END || 'Plato\\n'"
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.to_json(requests.authors_struct(F.expr(listed))).alias("authors"))


# Abstracts


def _abstract_word(doc_id: int, k: int, n: int) -> str:
    if doc_id % 3 == 1 and k == 31:
        return "Keywords:"
    stop = k % 7 == 6 or (k == n and doc_id % 5 > 0) or (k == 49 and doc_id % 2 == 0)
    return "z." if k == 139 else f"w{k}" + ("." if stop else "-" if k in (19, 29) else "")


@query(f"""WITH {_COUNTED}, k AS (SELECT doc_id, n, unnest(generate_series(0, least(n, 199))) AS k FROM d),
t AS (SELECT *, k // 10 AS l, CASE WHEN k = 0 THEN CASE doc_id % 3 WHEN 0 THEN 'Abstract' WHEN 1 THEN 'SUMMARY' ELSE 'abstract' END WHEN doc_id % 3 = 1 AND k = 31 THEN 'Keywords:' WHEN k = 139 THEN 'z.'
  ELSE 'w' || k || CASE WHEN k % 7 = 6 OR (k = n AND doc_id % 5 > 0) OR (k = 49 AND doc_id % 2 = 0) THEN '.' WHEN k IN (19, 29) THEN '-' ELSE '' END END AS w FROM k WHERE doc_id % 3 < 2),
s AS (SELECT doc_id, n, l, string_agg(CASE WHEN k = 0 THEN '' ELSE w || CASE WHEN k % 10 < 9 THEN ' ' ELSE '' END END, '' ORDER BY k) AS own, max(40 * (k % 10) + 5 * length(w)) AS x FROM t GROUP BY ALL),
r AS (SELECT *, CASE WHEN own = '' THEN '' WHEN own LIKE '%-' THEN left(own, -1) ELSE own || ' ' END AS piece, max(l) OVER (PARTITION BY doc_id) AS last,
  lag(x) OVER w AS x1, lag(x, 2) OVER w AS x2 FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY l)),
e AS (SELECT doc_id, min(l) AS stop FROM r WHERE l = last OR (rtrim(own) LIKE '%.' AND (l % 5 = 4 OR (l % 5 >= 2 AND abs(x2 - x1) < 1 AND x < x1 - 2))) GROUP BY doc_id),
a AS (SELECT r.doc_id, rtrim(string_agg(piece, '' ORDER BY l)) AS text, max(stop) AS stop FROM r JOIN e USING (doc_id) WHERE l <= stop GROUP BY r.doc_id)
SELECT doc_id, CASE WHEN stop = 0 AND doc_id % 3 = 1 THEN NULL WHEN contains(a.text, 'Keywords:') THEN left(a.text, instr(a.text, 'Keywords:') - 2) WHEN a.text LIKE '%.' THEN a.text END AS abstract FROM documents LEFT JOIN a USING (doc_id)""")
def abstract_simple(spark, sf_dir):
    """Headings, keywords, hyphens at the ends of lines, and ends of paragraph, block and page."""

    def row(doc_id, text):
        n = len(words_of(text))
        tokens = [("Abstract", "SUMMARY", "abstract")[doc_id % 3], *(_abstract_word(doc_id, k, n) for k in range(1, n + 1))]
        return request([[blocks] for blocks in layout_json(0, tokens, plain=True)])

    return plan.facts(composed(_docs(spark, sf_dir), row, "text")).select("doc_id", "abstract")


@query(f"""WITH {_COUNTED}, k AS (SELECT doc_id, n, unnest(generate_series(0, least(n, 199))) AS k FROM d),
t AS (SELECT *, k // 10 AS l, CASE WHEN k = 0 THEN 'Background' WHEN k = 20 AND doc_id % 4 < 3 THEN 'Methods' WHEN k = 40 THEN CASE WHEN doc_id % 4 = 1 THEN 'RESULTS' ELSE 'Conclusions' END
  ELSE 'w' || k || CASE WHEN k = least(n, 199) AND doc_id % 5 > 0 THEN '.' ELSE '' END END AS w FROM k WHERE n >= 40 AND doc_id % 4 IN (0, 3)),
s AS (SELECT doc_id, l, string_agg(w || CASE WHEN k % 10 < 9 THEN ' ' ELSE '' END, '' ORDER BY k) AS own FROM t GROUP BY ALL),
a AS (SELECT doc_id, rtrim(string_agg(CASE WHEN l = 4 OR (l = 2 AND doc_id % 4 < 3) THEN chr(10) || own ELSE own END, '' ORDER BY l)) AS text FROM s GROUP BY doc_id)
SELECT doc_id, CASE WHEN a.text LIKE '%.' THEN a.text END AS abstract FROM documents LEFT JOIN a USING (doc_id)""")
def abstract_structured(spark, sf_dir):
    """Headings that end in a conclusion, that do not, that are not aligned, and only two of them."""

    def row(doc_id, text):
        v, n = doc_id % 4, len(words_of(text))
        own = {0: "Background", 20: "Methods" if v < 3 else "w20", 40: "RESULTS" if v == 1 else "Conclusions"}
        tokens = [own.get(k) or f"w{k}" + "." * (k == min(n, 199) and doc_id % 5 > 0) for k in range(n + 1)]
        pages = layout_json(0, tokens, plain=True, moved={20: 5.0} if v == 2 else None)  # the first word of line 2
        return request([[blocks] for blocks in pages])

    return plan.facts(composed(_docs(spark, sf_dir), row, "text")).select("doc_id", "abstract")


# The whole recognition


def _full_request(doc_id: int, text: str | None, source: str | None) -> str:
    """Header and page number on each page, a head and a line of identifiers on the first one, all
    words of the document; some are archive covers, some are broken."""
    name, journal = _named(doc_id), (source or "none").translate(str.maketrans(_DIGITS, _LETTERS))
    doi = (f"doi:10.1234/AB{doc_id}x", f"doi:10.5678/ZZ{doc_id}", "", "")[doc_id % 4]
    more = "ISBN 978-0-306-40615-7 arXiv:1234.5678 ISSN 1234-567X" if doc_id % 3 == 0 else ""
    line = text_block(225, " ".join(filter(None, ("see", doi, more))), 10, 60)
    pages = _headed(doc_id, text)
    pages[0][0].append(line)
    header = text_block(30, f"Journal of {journal} Studies, Vol. {doc_id % 90 + 1}, No. {doc_id % 12 + 1} ({1950 + doc_id % 70})", 8, 1)
    flows = [[[header], *own, [text_block(760, str(1 + doc_id % 50 + p // 2), 8, 1)]] for p, own in enumerate(pages)]
    if doc_id % 13 == 5:
        cover = (f"On Pages of {name}", "Author(s): Ann Brown and Bob Lee", "Source: Annals, Vol. 3, No. 2 (1999), pp. 1-9", "Published by: Press", f"Stable URL: http://www.jstor.org/stable/{doc_id}")
        lines = []
        for i, own in enumerate(cover):
            parts = own.split(" ")
            lines.append([carriers.word(72.0 + 60 * k, 100.0 + 14 * i, t, 10.0, 1, k + 1 < len(parts)) for k, t in enumerate(parts)])
        flows[0] = [[carriers.block(lines)]]
    body = request(flows, f"Meta Title of {name}" if doc_id % 4 == 2 else None)
    return body[: len(body) // 2] if doc_id % 17 == 3 else body


def _registry(docs: DataFrame) -> DataFrame:
    """DOIs of every fourth document, and titles of every second one."""
    letters = F.concat(F.lit("q"), F.translate(F.col("doc_id").cast("string"), _DIGITS, _LETTERS))
    none = F.lit(None).cast("string")
    number = F.col("doc_id").cast("string")
    dois = docs.where("doc_id % 4 = 0").select(none.alias("title_key"), none.alias("author1_key"), none.alias("author2_key"), F.concat(F.lit("10.1234/ab"), number).alias("doi"), F.col("doc_id").alias("ord"))
    meta = docs.where("doc_id % 4 = 2").select(F.concat(F.lit("metatitleof"), letters), F.lit("nobody"), F.lit("brown"), F.concat(F.lit("10.1000/m"), number), "doc_id")
    page = docs.where("doc_id % 4 = 3").select(F.concat(F.lit(_TITLE.replace(" ", "").lower()), letters), F.lit("brown"), none, F.concat(F.lit("10.1000/t"), number), "doc_id")
    return dois.unionAll(meta).unionAll(page)


_PERSON = {k: '{"firstName":"' + k.split(" ")[0] + '","lastName":"' + k.split(" ")[1] + '"}' for k in ("Ann Brown", "Bob Grey", "Cy Stone", "Bob Lee")}
_AUTHORS_SQL = f"""CASE WHEN doc_id % 7 < 4 THEN '[{_PERSON["Ann Brown"]},{_PERSON["Bob Grey"]},{_PERSON["Cy Stone"]}]' WHEN doc_id % 7 < 6 THEN '[{_PERSON["Ann Brown"]},{_PERSON["Bob Grey"]}]' ELSE '[]' END"""


@query(f"""WITH {_COUNTED}, p AS (SELECT *, greatest(1, (n + 199) // 200) AS pages, 'Q' || translate(doc_id::VARCHAR, '{_DIGITS}', '{_LETTERS}') AS name, translate(coalesce(source, 'none'), '{_DIGITS}', '{_LETTERS}') AS journal,
  doc_id % 50 + 1 AS first FROM d)
SELECT doc_id, CASE WHEN doc_id % 17 = 3 THEN '{{"type":"journal-article","title":"","authors":[]}}'
  WHEN doc_id % 13 = 5 THEN '{{"type":"journal-article","title":"On Pages of ' || name || '","authors":[{_PERSON["Ann Brown"]},{_PERSON["Bob Lee"]}],"doi":"10.2307/' || doc_id
    || '","year":"1999","container":"Annals","publisher":"Press","pages":"1-9","volume":"3","issue":"2","url":"http://www.jstor.org/stable/' || doc_id || '"}}'
  ELSE '{{"type":"journal-article","title":"' || coalesce({_TITLE_SQL}, '') || '","authors":' || {_AUTHORS_SQL}
    || CASE doc_id % 4 WHEN 0 THEN ',"doi":"10.1234/ab' || doc_id || '"' WHEN 1 THEN ',"doi":"10.5678/ZZ' || doc_id || '"' WHEN 2 THEN CASE WHEN doc_id % 7 < 6 THEN ',"doi":"10.1000/m' || doc_id || '"' ELSE '' END
         ELSE CASE WHEN doc_id % 7 < 6 AND pages > 1 THEN ',"doi":"10.1000/t' || doc_id || '"' ELSE '' END END
    || CASE WHEN doc_id % 3 = 0 THEN ',"isbn":"9780306406157","arxiv":"1234.5678"' ELSE '' END
    || CASE WHEN pages > 1 THEN ',"year":"' || (1950 + doc_id % 70) || '","container":"Journal of ' || journal || ' Studies"' ELSE '' END
    || ',"pages":"' || CASE WHEN pages < 3 OR first = 1 THEN '9' ELSE first || '-' || (first + 8) END || '"'
    || CASE WHEN pages > 1 THEN ',"volume":"' || (doc_id % 90 + 1) || '","issue":"' || (doc_id % 12 + 1) || '"' ELSE '' END
    || CASE WHEN doc_id % 3 = 0 THEN ',"issn":"1234-567X"' ELSE '' END || '}}' END AS result FROM p""")
def result_json(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "text", "source")
    sent = composed(docs, _full_request, "text", "source")
    source = F.translate(F.coalesce("source", F.lit("none")), _DIGITS, _LETTERS)
    journals = registries.journal_set(docs.select(F.concat(F.lit("journalof"), source, F.lit("studies")).alias("name_key")))
    return requests.to_result_json(plan.recognize(sent, _registry(docs), journals, _dictionary(spark)))


# Small operators of the plan


@query(f"""WITH words AS ({LAYOUT_SQL}), n AS (SELECT doc_id, max(page_no) + 1 AS n FROM words GROUP BY doc_id)
SELECT doc_id, page_no, count(*) AS n_words FROM words JOIN n USING (doc_id) WHERE page_no < CASE WHEN doc_id % 3 = 0 AND doc_id % 40 > n THEN n WHEN n > 2 THEN n - 1 ELSE 2 END GROUP BY ALL""")
def text_pages(spark, sf_dir):
    from quirelight.operators import layout

    docs = _docs(spark, sf_dir)
    totals = docs.where("doc_id % 3 = 0").selectExpr("doc_id", "CAST(doc_id % 40 AS INT) AS total_pages")
    return layout.text_pages(layout_words(docs), totals).groupBy("doc_id", "page_no").agg(F.count("*").alias("n_words"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN p_name || '1' ELSE p_name || ' ' END AS title FROM part""")
def trim_title(spark, sf_dir):
    from quirelight.functions import text

    marked = "CASE p_size % 4 WHEN 0 THEN p_name || '1' WHEN 1 THEN p_name || '*' WHEN 2 THEN p_name || '11' ELSE p_name || ' ' END"
    return table(spark, sf_dir, "part").select("p_partkey", text.trim_title(F.expr(marked)).alias("title"))


@query(f"WITH words AS ({LAYOUT_SQL}) SELECT doc_id, page_no, flow_no, block_no, line_no, max(font_size) AS max_font_size FROM words GROUP BY ALL")
def line_max_size(spark, sf_dir):
    from quirelight.operators import layout

    return layout.line_fonts(layout_words(_docs(spark, sf_dir))).select(*layout.LINE, "max_font_size")
