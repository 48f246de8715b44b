"""Tolerant parsing and small scalar helpers, all as native Column expressions.

ANSI mode raises on bad casts and division by zero, so everything here goes
through the ``try_`` family and yields NULL instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# Date layouts of the exports, tried in this order (day first).
DATE_FORMATS = ("dd-MMM-yyyy", "yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy")

# Words read as true or false.
TRUE_WORDS = ("true", "yes", "y", "t")
FALSE_WORDS = ("false", "no", "n", "f")

# The characters Unicode counts as white space.
WHITE_SPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

MISSING_CATEGORY = "__missing__"


def strip(column: Column) -> Column:
    """Trim every kind of white space, non-breaking spaces included."""
    return F.trim(column, F.lit(WHITE_SPACE))


def clean_text(column: Column) -> Column:
    """Trim, then delete tabs and newlines; text left blank becomes NULL."""
    return blank_to_null(F.translate(strip(column), "\t\n", ""))


def blank_to_null(column: Column) -> Column:
    # Looks as far as the first other character; trimming would walk the whole text.
    return F.when(F.rlike(column.cast("string"), F.lit(f"[^{WHITE_SPACE}]")), column)


def number(column: Column) -> Column:
    """Plain decimal number in text, anything else NULL."""
    # '' where the pattern does not match; the text is named once, so it is made once.
    return F.regexp_extract(strip(column.cast("string")), NUMBER_PATTERN, 0).try_cast("double")


def amount(column: Column) -> Column:
    """Money text with any grouping of thousands (``4,05,67,400``)."""
    return number(F.regexp_replace(column.cast("string"), ",", ""))


def loose_number(column: Column) -> Column:
    """Keep digits, point and minus; blank or unreadable is zero."""
    return F.coalesce(number(F.regexp_replace(column.cast("string"), "[^0-9.-]", "")), F.lit(0.0))


def to_double(column: Column) -> Column:
    """Numeric column as double with NaN turned into NULL."""
    value = column.cast("double")
    return F.when(~F.isnan(value), value)


def parse_date(column: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    text = strip(column)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(layout)).cast("date") for layout in formats])


def to_flag(column: Column) -> Column:
    """Text to boolean: yes/no words, else any non-zero number; never NULL."""
    text = F.lower(strip(column.cast("string")))
    return (
        F.when(text.isin(*TRUE_WORDS), F.lit(True))
        .when(text.isin(*FALSE_WORDS), F.lit(False))
        .otherwise(F.coalesce(number(text) != 0, F.lit(False)))
    )


def flag(condition: Column) -> Column:
    """0/1 flag of a predicate; unknown counts as 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def first_non_blank(*columns: Column) -> Column:
    return F.coalesce(*[blank_to_null(column) for column in columns])


def category(column: Column) -> Column:
    """Category text with one stand-in for NULL and blank."""
    return F.coalesce(blank_to_null(column), F.lit(MISSING_CATEGORY))


def days_between(end: Column, start: Column) -> Column:
    return F.datediff(end.cast("date"), start.cast("date"))


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(numerator, denominator)


def clip(column: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        column = F.greatest(column, F.lit(low))
    if high is not None:
        column = F.least(column, F.lit(high))
    return column


def join_labels(pairs: list[tuple[Column, Column]], separator: str = "; ") -> Column:
    """Text of the labels whose condition holds, in order; '' when none does."""
    return F.concat_ws(separator, *[F.when(condition, label) for condition, label in pairs])


def first_of(array: Column) -> Column:
    """First list element or ''."""
    return F.coalesce(F.try_element_at(array, F.lit(1)), F.lit(""))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda left, right: left | right, conditions)
