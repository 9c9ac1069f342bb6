"""String helpers with Python's truthiness and ``str.strip`` semantics."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters Python's str.strip() removes (str.isspace),
# listed in code-point order.  Spark's trim() without arguments only removes
# spaces, so the validation rules pass this explicit set.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)



def py_strip(col: Column) -> Column:
    """``str.strip()`` of a string column (null stays null): ``btrim`` with
    Python's whitespace set, a plain character scan (no regex)."""
    return F.btrim(col, F.lit(PY_WHITESPACE))


def stripped_length(col: Column) -> Column:
    """``len(s.strip())`` — characters, as Python counts them."""
    return F.char_length(py_strip(col))


def is_truthy(col: Column) -> Column:
    """Python truthiness of an optional string: not null and not empty."""
    return col.isNotNull() & (col != F.lit(""))


def truthy_or(*cols: Column) -> Column:
    """Python ``a or b or c``: first value that is neither null nor ''."""
    *head, last = cols
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in head], last)
