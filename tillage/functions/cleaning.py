"""Column -> Column cleaning functions; all of them stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that a delimited file uses for a missing value.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

#: Unicode white space, spelled out because engines disagree about \s.
SPACE = (
    r"[\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)


def missing_to_null(c: Column) -> Column:
    """Tokens for a missing value become null; padded tokens stay text, so call this before clean_text."""
    return F.when(~c.isin(NA_TOKENS), c)


def clean_text(c: Column) -> Column:
    """Strip Unicode white space at both ends and turn each run of it into one space; null stays null."""
    collapsed = F.regexp_replace(c.cast("string"), SPACE, " ")
    return F.regexp_replace(collapsed, "^ | $", "")


def to_number(c: Column) -> Column:
    """Lenient parse to double. What doesn't parse is null, NaN too; Java's 1d and 1f suffixes don't parse."""
    text = c.cast("string")
    value = F.when(~text.rlike(r"[0-9.][dDfF]\s*$"), text.try_cast("double"))
    return F.when(~F.isnan(value), value)


def truncate_to_int(c: Column) -> Column:
    """Toward zero, as for the observation year."""
    return c.cast("int")


def exact_to_int(c: Column) -> Column:
    """Like truncate_to_int, but a fraction raises, as for the feature year."""
    bad = c.isNotNull() & (c != F.floor(c))
    return F.when(bad, F.raise_error(F.concat(F.lit("not an integer: "), c.cast("string"))).cast("int")).otherwise(c.cast("int"))
