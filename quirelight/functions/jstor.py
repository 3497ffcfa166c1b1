"""Parser of archive cover pages: a column of cover text to a struct of fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirelight.functions.text import nullif_empty

#: Fixed values of the cover page.
URL_PREFIX = "Stable URL: http://www.jstor.org/stable/"
URL = r"Stable URL: (http://www.jstor\.org/stable/(\S+))"
#: From the start of the text, so that a text without the marks is read once and not from every place.
ANY = r"\A((?s:.*))"
SHORT = r"((?s:.*?))\n(?:Book |Published by: )"
ARTICLE = (
    # pattern, group of the title, of the authors (None: no authors), of the source line
    (ANY + r"\nAuthor\(s\): (.*)\nReview by: (.*)\nSource: (.*)\n", 1, 3, 4),
    (ANY + r"\nAuthor\(s\): (.*)\nSource: (.*)\n", 1, 2, 3),
    (ANY + r"\nReview by: (.*)\nSource: (.*)\n", 1, 2, 3),
    (ANY + r"\nSource: (.*)\n", 1, None, 2),
)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``value``, which is computed once however often ``f`` names it, also within conditions."""
    return F.transform(F.array(value), f)[0]


def split_authors(names: Column) -> Column:
    """Names of a cover: at every ", ", then the last part at every " and "; a name's last word is
    the last name."""
    commas = F.split(names, ", ")
    last = F.split(F.element_at(commas, -1), " and ")
    parts = F.concat(F.slice(commas, 1, F.size(commas) - 1), last)
    return F.transform(
        F.filter(parts, lambda x: x != ""),
        lambda x: F.struct(nullif_empty(F.regexp_extract(x, "^(.*) [^ ]*$", 1)).alias("firstName"), F.regexp_extract(x, "([^ ]*)$", 1).alias("lastName")),
    )


def parse_source(source: Column) -> dict[str, Column]:
    """Container, volume, issue, year and pages of a source line."""
    volume = nullif_empty(F.regexp_extract(source, r", Vol\. (\d+)", 1))
    issue = nullif_empty(F.regexp_extract(source, r", No\. (\d+)", 1))
    before = lambda mark: F.when(F.instr(source, mark) > 0, F.substring_index(source, mark, 1))
    return {
        "container": F.coalesce(before(", Vol. "), before(", No. ")),
        "volume": volume,
        "issue": issue,
        "year": nullif_empty(F.regexp_extract(source, r"(\d{4})\)", 1)),
        "pages": F.coalesce(nullif_empty(F.regexp_extract(source, r", p\. (.*)$", 1)), nullif_empty(F.regexp_extract(source, r", pp\. (.*)$", 1))),
    }


def parse_cover(cover: Column) -> Column:
    """Struct of type, title, authors, container, publisher, volume, issue, year, pages, doi, url;
    NULL without a stable URL. ``cover``: lines of the block joined by line feeds, with one at the end."""
    return bound(cover, lambda own: F.when(F.contains(own, F.lit("Stable URL: ")), bound(_marks(own), lambda marks: F.when(marks["url"].isNotNull(), _fields(own, marks)))))


def _marks(cover: Column) -> Column:
    """What several fields of a cover are told from: URL, kind, parts of a chapter's or an article's text."""
    none = F.lit(None).cast("string")
    url, ident = (nullif_empty(F.regexp_extract(cover, URL, i)) for i in (1, 2))
    book = F.instr(cover, "Chapter Title: ") > 0
    chapter = F.when(book, F.concat(F.lit("Chapter Title: "), F.regexp_extract(cover, "(?s)Chapter Title: (.*)", 1)))
    # An article's fields follow the first blank line.
    start = F.instr(cover, "\n\n")

    def article(body: Column) -> Column:
        found = F.struct(none.alias("title"), none.alias("names"), none.alias("source"))
        for pattern, t, a, s in reversed(ARTICLE):
            part = lambda i: F.regexp_extract(body, pattern, i) if i else none  # noqa: B023, E731
            found = F.when(body.rlike(pattern), F.struct(part(t).alias("title"), part(a).alias("names"), part(s).alias("source"))).otherwise(found)
        return found

    own = F.when(~book, bound(F.when(start > 0, F.substr(cover, start + 2)).otherwise(cover), article))
    raw_publisher = nullif_empty(F.regexp_extract(cover, r"Published by: ((?s:.*?))\nStable URL: ", 1))
    return F.struct(url.alias("url"), ident.alias("ident"), book.alias("book"), chapter.alias("chapter"), own.alias("article"), raw_publisher.alias("publisher"))


def _fields(cover: Column, marks: Column) -> Column:
    url, ident, book, chapter, raw_publisher = (marks[c] for c in ("url", "ident", "book", "chapter", "publisher"))
    with_authors = r"(?s)Chapter Title: (.*)\nChapter Author\(s\): (.*)\n\n"
    book_title = F.coalesce(nullif_empty(F.regexp_extract(chapter, with_authors, 1)), nullif_empty(F.regexp_extract(chapter, r"(?s)Chapter Title: (.*)\n\n", 1)))
    of_book = lambda name: nullif_empty(F.regexp_extract(chapter, f"{name}: {SHORT}", 1))
    subtitle = of_book("Book Subtitle")
    book_container = F.concat(of_book("Book Title"), F.coalesce(F.concat(F.lit(": "), subtitle), F.lit("")))
    book_authors = F.coalesce(nullif_empty(F.regexp_extract(chapter, with_authors, 2)), of_book(r"Book Author\(s\)"))
    title, names = marks["article"]["title"], marks["article"]["names"]
    parsed = parse_source(marks["article"]["source"])
    published = nullif_empty(F.regexp_extract(raw_publisher, r"(\d{4})\)[^\)]*$", 1))
    publisher = nullif_empty(F.regexp_replace(raw_publisher, r"[\x01-\x40]+$", ""))
    authors = bound(F.when(book, book_authors).otherwise(names), split_authors)
    pick = lambda a, b: F.when(book, a).otherwise(b)
    none = F.lit(None).cast("string")
    return F.struct(
        pick(F.lit("book-chapter"), F.lit("journal-article")).alias("type"),
        F.translate(pick(book_title, title), "\n", " ").alias("title"),
        authors.alias("authors"),
        F.translate(pick(book_container, parsed["container"]), "\n", " ").alias("container"),
        publisher.alias("publisher"),
        pick(none, parsed["volume"]).alias("volume"),
        pick(none, parsed["issue"]).alias("issue"),
        F.coalesce(published, pick(none, parsed["year"])).alias("year"),
        pick(none, parsed["pages"]).alias("pages"),
        F.concat(F.lit("10.2307/"), ident).alias("doi"),
        url.alias("url"),
    )
