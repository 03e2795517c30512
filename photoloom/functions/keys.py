"""Keys under which paths, contents and categories written in different ways agree."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: SHA-256 of empty content. Fixed value.
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
#: White space. Fixed values.
BLANKS = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip_blanks(c: Column) -> Column:
    """``c`` without white space at both ends."""
    return F.trim(c, F.lit(BLANKS))


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


#: Marked so that the optimizer computes it once where a filter and a column both need it.
_composed = _nfc.asNondeterministic()


def nfc(c: Column) -> Column:
    """Unicode composition (NFC) of ``c``.

    Text whose characters are all below U+0300 is composed as it stands. Only other values are handed to
    Python; for the rest the Arrow batch holds nulls.
    """
    odd = c.rlike(r"[^\x{0}-\x{2FF}]")
    return F.coalesce(_composed(F.when(odd, c)), c)


def place_key(path: Column) -> Column:
    """The place that a path names; null for a null or blank path.

    Two paths name the same place if they agree after NFC, stripping white space, reading ``\\`` as ``/``,
    dropping empty and ``.`` segments and lower-casing.
    """
    slashed = F.concat(F.lit("/"), F.translate(strip_blanks(nfc(path)), "\\", "/"), F.lit("/"))
    segments = F.regexp_replace(slashed, r"/(?:\.?/)+", "/")
    return F.nullif(F.lower(F.trim(segments, F.lit("/"))), F.lit(""))


def content_key(sha256: Column) -> Column:
    """The 64 hex digits of a content hash in lower case; null for none and for empty content."""
    digits = F.lower(F.regexp_extract(sha256, r"([0-9a-fA-F]{64})", 1))
    return F.when((digits != "") & (digits != EMPTY_SHA256), digits)


def category_key(category: Column) -> Column:
    """A category without blanks around it and letter case; null for a blank one."""
    return F.nullif(F.lower(strip_blanks(category)), F.lit(""))
