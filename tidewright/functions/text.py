"""Text cleaning expressions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Characters that count as whitespace: Unicode White_Space and the four ASCII separators.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
#: Runs of whitespace other than one plain space; ranges keep the match cheap.
_WHITESPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_UNEVEN_RUN = rf" ?(?! ){_WHITESPACE}{_WHITESPACE}*|  +{_WHITESPACE}*"


def strip(c: Column) -> Column:
    """Remove whitespace of any kind at both ends (``trim`` removes spaces only)."""
    return F.btrim(c, F.lit(WHITESPACE))


def clean_ticker(c: Column) -> Column:
    """Stripped and upper-cased; null where nothing is left."""
    return F.nullif(F.upper(strip(c)), F.lit(""))


def squeeze(c: Column) -> Column:
    """Stripped, each inner run of whitespace one space; null where nothing is left."""
    return F.nullif(strip(F.regexp_replace(c, _UNEVEN_RUN, " ")), F.lit(""))


def strip_html(c: Column) -> Column:
    """Tags become a space, then the ends are stripped."""
    return strip(F.regexp_replace(c, "<[^>]+>", " "))
