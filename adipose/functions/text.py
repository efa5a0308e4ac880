"""Column expressions for cells of delimited text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what counts as a number, and white space at both ends
NUMBER = r"(?i)^[+-]?((\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|inf|infinity|nan)$"
ENDS = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """``c`` without white space at both ends, tabs and line ends included."""
    return F.regexp_replace(c, ENDS, "")


def number(c: Column) -> Column:
    """The double that ``c`` spells (1_000, .5, 1e5, inf and nan do; 1d and 0x1 do not), else null."""
    s = strip(c)
    plain = F.regexp_replace(s, "_", "").try_cast("double")
    return F.when(s.rlike(NUMBER), F.when(F.lower(s).endswith("nan"), F.lit(float("nan"))).otherwise(plain))


def filled(c: Column) -> Column:
    """``c`` or null where it is empty."""
    return F.when(c != "", c)


def dashed(c: Column) -> Column:
    """``c`` or null where it is a lone dash."""
    return F.when(c != "-", c)


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*map(filled, columns))
