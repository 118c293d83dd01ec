"""Column functions on identifiers."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALNUM = string.ascii_letters + string.digits


def id_key(c: Column | str) -> Column:
    """ASCII letters and digits of an id, in upper case; NULL if there are none.

    Two spellings that differ in case, white space or punctuation have one key.  ``translate`` removes
    what it leaves of the id when letters and digits are removed, many times faster than a pattern.
    """
    c = F.col(c) if isinstance(c, str) else c
    other = F.call_function("translate", c, F.lit(ALNUM), F.lit(""))
    return F.nullif(F.upper(F.call_function("translate", c, other, F.lit(""))), F.lit(""))


def once(df: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """Select ``keep`` and new columns so that later filters don't evaluate their expressions again.

    Catalyst copies an expression to each place that uses it; it doesn't do so across a generator.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def unit_hash(c: Column, salt: int) -> Column:
    """A repeatable number in (0, 1] from a value."""
    return (F.shiftrightunsigned(F.xxhash64(c, F.lit(salt)), 11) + F.lit(1)).cast("double") * F.lit(2.0**-53)
