"""Identifiers and bibliographic fields in running text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirelight.functions.text import nullif_empty

#: The patterns of the fields. Possessive runs keep the matcher's stack flat on long
#: texts; (?U) gives digits, blanks and word borders their Unicode meaning.
DOI = r"10.\d{4,9}/[-._;()\[\]+<>/:A-Za-z0-9]+"
ISBN = "(SBN|sbn)[ —–‒-]?(10|13)?[: ]*([0-9X][0-9X —–‒-]+)"
ARXIV = r"arXiv:([a-zA-Z0-9./]+)"
YEAR = r"(?U)(^|\(|\s|,)([0-9]{4})(\)|,|\s|$)"
VOLUME = r"(?U)\b(?i:volume|vol|v)\.?[\s:-]\s*(\d+)"
ISSUE = r"(?U)\b(?i:issue|num|no|number|n)\.?[\s:-]\s*(\d+)"
ISSN = r"(?U)ISSN:?\s*(\d{4}-\d{3}[\dX])"
JOURNAL = r"(?U)[\p{IsAlphabetic}'.]++(?:\s[\p{IsAlphabetic}'.]++)*+"

#: DOIs from this length on are not looked up; registered ones up to SHORT_DOI are not trusted.
LONG_DOI, SHORT_DOI = 64, 10
#: Bytes of the longest DOI that a registry of hashes gives out.
MOST_DOI_BYTES = 512


def raw_dois(col: Column) -> Column:
    """All matches in text order."""
    return F.regexp_extract_all(col, F.lit(DOI), F.lit(0))


def isbn(col: Column, whole_match: bool = False) -> Column:
    """Digits of the first ISBN if there are 10 or 13. ``whole_match`` counts the digits of a label
    like ISBN-13 too, as the reference behaviour does."""
    digits = F.regexp_replace(F.regexp_extract(col, ISBN, 0 if whole_match else 3), "[^0-9X]", "")
    return F.when(F.length(digits).isin(10, 13), digits)


def arxiv(col: Column) -> Column:
    return nullif_empty(F.regexp_extract(col, ARXIV, 1))


def year(col: Column) -> Column:
    """The first match only, if between 1800 and 2030."""
    found = nullif_empty(F.regexp_extract(col, YEAR, 2))
    return F.when(found.cast("int").between(1800, 2030), found)


def volume(col: Column) -> Column:
    return _short_number(col, VOLUME)


def issue(col: Column) -> Column:
    return _short_number(col, ISSUE)


def _short_number(col: Column, pattern: str) -> Column:
    found = nullif_empty(F.regexp_extract(col, pattern, 1))
    return F.when(F.length(found) <= 4, found)


def issn(col: Column) -> Column:
    return nullif_empty(F.regexp_extract(col, ISSN, 1))


def journal_candidates(col: Column) -> Column:
    """Runs of words joined by single white space, of at least two blank-separated words."""
    return F.filter(F.regexp_extract_all(col, F.lit(JOURNAL), F.lit(0)), lambda x: x.contains(" "))
