"""Small text expressions shared by the operators."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed set of the characters that count as white space: the Unicode ones and the separators U+001C..U+001F.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` alone removes only spaces)."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def is_blank(col: Column) -> Column:
    return strip(col) == ""


def or_default(col: Column, default: str) -> Column:
    """NULL and the empty string both read as ``default``."""
    return F.coalesce(F.nullif(col, F.lit("")), F.lit(default))


def contains_ci(col: Column, needle: str) -> Column:
    """Case-insensitive literal substring test; a NULL text does not match."""
    return F.coalesce(F.contains(F.lower(col), F.lit(needle.lower())), F.lit(False))


def equals_ci(col: Column, value: str) -> Column:
    return F.lower(F.coalesce(col, F.lit(""))) == F.lit(value.lower())


def matches(pred: Column) -> Column:
    """A predicate that is never NULL: unknown counts as no match."""
    return F.coalesce(pred, F.lit(False))


def pad_right(col: Column, width: int) -> Column:
    """Pad with spaces to ``width``; longer text stays whole (``rpad`` alone would cut it)."""
    return F.when(F.length(col) < width, F.rpad(col, width, " ")).otherwise(col)
