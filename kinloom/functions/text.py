"""Column expressions on keys and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for "not known", compared lower-cased and without outer blanks.
NOT_KNOWN = ("", "-", "?", "??", "n/a", "na", "nan", "nil", "none", "null", "tbd", "und", "undefined", "unknown", "xx")


def bare(col: Column) -> Column:
    """Lower case, without outer white space. Null stays null."""
    return F.lower(F.regexp_replace(col, r"^\s+|\s+$", ""))


def known(col: Column) -> Column:
    """True where the text says something; null, blank and placeholder texts are False."""
    return F.coalesce(~bare(col).isin(*NOT_KNOWN), F.lit(False))


def canonical_path(col: Column) -> Column:
    """One spelling for every spelling of an object path.

    Outer blanks go, percent escapes are decoded once, ``s3a``/``s3n`` and any
    letter case of the scheme become ``s3``, runs of slashes and ``.`` segments
    collapse. A path whose escapes cannot be decoded keeps them.
    """
    p = F.regexp_replace(col, r"^\s+|\s+$", "")
    p = F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p)
    p = F.regexp_replace(p, r"^\s+|\s+$", "")
    scheme = F.regexp_extract(p, r"^([A-Za-z][A-Za-z0-9+.-]*):/+", 1)
    rest = F.regexp_replace(p, r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "")
    rest = F.regexp_replace(rest, r"^(\./+)+", "")
    rest = F.regexp_replace(rest, r"/(\.?/)+", "/")
    scheme = F.regexp_replace(F.lower(scheme), r"^s3[an]$", "s3")
    return F.when(scheme == "", rest).otherwise(F.concat(scheme, F.lit("://"), rest))
