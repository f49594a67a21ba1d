"""Text expressions. Unicode classes are switched on explicitly, since Java's defaults are ASCII."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Bullet glyphs that become a hyphen. Fixed values.
BULLETS = "•●▪◦‣∙"
ZERO_WIDTH = "​‌‍‎‏‪‫‬‭‮⁠﻿"


@F.pandas_udf(StringType())
def nfc(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Canonical composition, which Spark has no function for. ASCII values pass untouched."""
    for v in values:
        yield v.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFC", s))


@F.pandas_udf(StringType())
def decomposed(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Canonical decomposition: accents apart from their letters."""
    for v in values:
        yield v.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFD", s))


#: Unicode's white space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column, also: str = "") -> Column:
    """Without leading and trailing white space of any kind, and the characters of `also`."""
    return F.btrim(c, F.lit(SPACES + also))


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def lines(c: Column) -> Column:
    """Lines by every separator; a final one adds no empty line."""
    every = F.split(F.regexp_replace(c, "\r\n|[\r\x0b\x0c\x1c-\x1e\x85  ]", "\n"), "\n")
    return bind(every, lambda cut: F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut))


_BLANK = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: A broken e-mail address: blanks around the @ and around the dots of its domain.
BROKEN_EMAIL = rf"[A-Za-z0-9._%+-]++{_BLANK}*+@{_BLANK}*+[A-Za-z0-9-]++(?:{_BLANK}*+\.{_BLANK}*+[A-Za-z0-9-]++)++"


def normalize_layout(c: Column) -> Column:
    """Line ends, bullets, broken e-mail addresses, URLs and domains, runs of blanks and blank lines. Composes nothing: see nfc.

    Each step asks first whether the text holds what it looks for.
    """

    def where(v: Column, mark: str, then) -> Column:
        return bind(v, lambda x: F.when(F.contains(x, F.lit(mark)), then(x)).otherwise(x))

    def joined(v: Column) -> Column:  # whole addresses, however many labels they have
        found = F.transform(F.regexp_extract_all(v, F.lit(BROKEN_EMAIL), F.lit(0)), lambda m: F.regexp_replace(m, _BLANK, ""))
        return F.array_join(F.zip_with(F.split(v, BROKEN_EMAIL, -1), found, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")

    v = F.translate(where(c, "\r", lambda x: F.regexp_replace(x, "\r\n?", "\n")), BULLETS, "-" * len(BULLETS))
    v = where(v, "@", joined)
    v = where(v, "/", lambda x: F.regexp_replace(F.regexp_replace(x, r"(?i)\bhttps\s*:\s*/\s*/\s*", "https://"), r"(?i)\bhttp\s*:\s*/\s*/\s*", "http://"))
    v = bind(v, lambda x: F.when(F.contains(F.lower(x), F.lit("www")), F.regexp_replace(x, r"(?i)\bwww\s*\.\s*", "www.")).otherwise(x))
    v = F.regexp_replace(v, r"(?<=[A-Za-z0-9])\s*\.\s*(?=[A-Za-z]{2,}(?:\b|/))", ".")
    v = F.array_join(F.transform(bind(v, lines), lambda x: strip(F.regexp_replace(x, r"[^\S\n]+", " "))), "\n")
    return strip(where(v, "\n\n\n", lambda x: F.regexp_replace(x, "\n{3,}", "\n\n")))


def bind(value: Column, f) -> Column:
    """f(value), with the value made once however often f uses it: a branch would make it again."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), F.lit(0))


def composed(c: Column) -> Column:
    """nfc, which only texts with characters beyond Latin letters and common signs need: those alone go through Python."""
    plain = F.regexp_like(c, F.lit(r"\A[\x00-\u02ff\u2010-\u2027\u2030-\u205e\u20ac\u2022\u25aa\u25cf\u25e6]*\z"))
    return F.coalesce(nfc(F.when(~plain, c)), c)


def normalized(c: Column) -> Column:
    return normalize_layout(composed(c))


def clean(c: Column) -> Column:
    """Without zero-width and control characters, blanks collapsed; empty is null. Plain words between single blanks stay as they are."""
    return F.when(F.regexp_like(c, F.lit(r"\A[!-~]++(?: [!-~]++)*+\z")), c).otherwise(_cleaned(c))


def _cleaned(c: Column) -> Column:
    return F.nullif(collapse(F.regexp_replace(F.translate(c, ZERO_WIDTH, ""), r"(?!\s)\p{Cntrl}", "")), F.lit(""))


def estimate_tokens(c: Column) -> Column:
    """A token for every four characters begun."""
    return F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4).cast("long")


def fingerprint(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts, joined by the unit separator; null parts are left out."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16)
