"""Scalar text functions: normalisation, counts, predicates. Columns in, columns out."""

from __future__ import annotations

import functools
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelight.functions.slices import each

#: The property that the rules for letters name.
ALPHABETIC = regex.compile(r"\p{Alphabetic}")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def nullif_empty(col: Column) -> Column:
    """Regex functions answer '' for no match; a missing value is NULL here."""
    return F.nullif(col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def count_of(col: Column, char_class: str) -> Column:
    """Code points of ``col`` in a Java character class."""
    return F.length(F.regexp_replace(col, f"[^{char_class}]", ""))


@functools.cache
def is_alphabetic(char: str) -> bool:
    """Unicode property Alphabetic of one code point: letters, and also vowel signs, letter numbers
    and enclosed letters, which str.isalpha leaves out."""
    return char.isalpha() or ALPHABETIC.match(char) is not None


class _Normal(dict):
    """What normalisation leaves of each code point, filled in as code points are met."""

    def __missing__(self, point: int) -> str:
        char = chr(point)
        kept = "".join(x.lower() for x in unicodedata.normalize("NFKD", char) if is_alphabetic(x)) if is_alphabetic(char) else ""
        self[point] = kept
        return kept


_NORMAL = _Normal()
_NO_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())


def normalize_text(text: str) -> str:
    """Alphabetic code points, decomposed (alphabetic parts stay) and lower-cased one by one (a final
    sigma stays an ordinary one); nothing else survives."""
    if text.isascii():
        return text.encode().lower().translate(None, _NO_LETTERS).decode()
    return text.translate(_NORMAL)


@F.arrow_udf(T.StringType())
def _normalized(texts: pa.Array) -> pa.Array:
    return each(lambda t: None if t is None else normalize_text(t), pa.string(), texts)


def normalize(col: Column) -> Column:
    """``normalize_text`` of a column. ASCII texts stay in the JVM, where the rule is that A-Z and
    a-z survive; only the others leave it, so that there is one rule for columns and strings."""
    plain = F.octet_length(col) == F.length(col)
    return F.when(plain, ascii_lower(F.regexp_replace(col, "[^A-Za-z]+", ""))).otherwise(_normalized(F.when(~plain, col)))


def text_info(col: Column) -> Column:
    """Counts of upper-case, lower-case and alphabetic code points."""
    return F.struct(count_of(col, r"\p{IsUppercase}").alias("uppercase"), count_of(col, r"\p{IsLowercase}").alias("lowercase"), count_of(col, r"\p{IsAlphabetic}").alias("alphabetic"))


def alphabetic_percent(col: Column) -> Column:
    """Integer percentage of alphabetic code points, blanks and the dashes U+2010 to U+2012; NULL if empty."""
    return F.floor(100 * count_of(col, "\\p{IsAlphabetic} ‐-‒") / F.nullif(F.length(col), F.lit(0))).cast("int")


def is_upper(col: Column) -> Column:
    """At least 90 % (integer division) of the cased code points are upper-case."""
    upper, lower = count_of(col, r"\p{IsUppercase}"), count_of(col, r"\p{IsLowercase}")
    return F.coalesce(F.floor(100 * upper / F.nullif(upper + lower, F.lit(0))) >= 90, F.lit(False))


def is_dot_last(col: Column) -> Column:
    """The last character but blanks, line feeds and carriage returns is a full stop."""
    return col.rlike(r"\.[ \n\r]*\z")


def simple_abstract_heading(col: Column) -> Column:
    """Length of a leading "Abstract" or "Summary" (first letter upper-case, others any), else 0."""
    return F.length(F.regexp_extract(col, "^(A(?i:bstract)|S(?i:ummary))", 1))


#: Headings of structured abstracts and their types, in order of the test.
STRUCTURED_HEADINGS = (("background", 1), ("methods", 2), ("method", 2), ("conclusions", 3), ("conclusion", 3), ("objectives", 4), ("objective", 4), ("results", 5), ("result", 5), ("purpose", 6), ("measurements", 7))


def structured_abstract_heading(col: Column) -> Column:
    """Type of a leading heading of a structured abstract (first letter upper-case), else 0."""
    out = F.lit(0)
    for name, kind in reversed(STRUCTURED_HEADINGS):
        out = F.when(col.rlike(f"^{name[0].upper()}(?i:{name[1:]})"), kind).otherwise(out)
    return out


#: Words between names, and titles and degrees that are no names.
CONJUNCTIONS = ("and", "und")
DEGREES = (
    "by", "prof", "bsc", "dsc", "phd", "md", "mph", "rd", "ld", "bch", "fccp", "bao", "pharmd", "frcp", "pa-c", "rac", "mba", "drph",
    "mbchb", "bm", "rgn", "ba", "ms", "msc",
)


def is_conjunction(col: Column) -> Column:
    return F.lower(col).isin(*CONJUNCTIONS)


def is_degree(col: Column) -> Column:
    return F.lower(col).isin(*DEGREES)


def trim_title(col: Column) -> Column:
    """Without one trailing footnote mark."""
    return F.regexp_replace(col, "[1*]$", "")
