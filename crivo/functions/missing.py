"""Missing-value predicates, one named dialect each - never merged into one rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..labels import BUCKET_BLANK

# --- fixed values: texts that mean "no value" in the profiled tables ---
BLANK_TOKENS_8 = ("", "null", "nan", "none", "#", "-", "na", "n/a")
BLANK_TOKENS_6 = ("", "null", "nan", "none", "#", "-")
ZERO_PATTERN = "^0+([.,]0+)?$"
ZERO_LITERALS = ("0", "0.0", "0.00", "0.000", "000", "0000")
# --- end of fixed values ---

# classes returned by value_class
NULL, BLANK, ZERO, USEFUL = 0, 1, 2, 3


def _is_token(trimmed: Column, tokens) -> Column:
    # the size test spares lower-casing whole documents to compare with short words
    longest = max(len(t) for t in tokens)
    return (F.octet_length(trimmed) <= longest) & F.lower(trimmed).isin(*tokens)


def is_blank(c: Column, tokens=BLANK_TOKENS_8) -> Column:
    """Non-null text that stands for "nothing"."""
    return c.isNotNull() & _is_token(F.trim(c), tokens)


def is_zero_text(c: Column) -> Column:
    """Text made of zeros only, with an optional zero decimal part."""
    t = F.trim(c)
    # the prefix test spares the regex for nearly every value
    return t.startswith("0") & t.rlike(ZERO_PATTERN)


def no_value(c: Column) -> Column:
    """Null, or blank once trimmed (the link / key dialect)."""
    return F.trim(F.coalesce(c.cast("string"), F.lit(""))) == ""


def has_value(c: Column) -> Column:
    return ~no_value(c)


def display_bucket(c: Column, label: str = BUCKET_BLANK) -> Column:
    """Value for a report: blank and null share one visible label."""
    return F.coalesce(F.nullif(F.trim(c.cast("string")), F.lit("")), F.lit(label))


def value_class(c: Column, dtype: T.DataType, tokens=BLANK_TOKENS_8) -> Column:
    """NULL / BLANK / ZERO / USEFUL, by the rule that fits the column type.

    Text has blank and zero tests, numbers a zero test, anything else is only
    null or useful. The classes exclude each other, so they add up to the rows.
    """
    out = F.when(c.isNull(), F.lit(NULL))
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        out = out.when(_is_token(F.trim(c), tokens), F.lit(BLANK)).when(is_zero_text(c), F.lit(ZERO))
    elif isinstance(dtype, T.NumericType):
        out = out.when(c == 0, F.lit(ZERO))
    return out.otherwise(F.lit(USEFUL)).cast("tinyint")


def text_class_of(c: Column, dtype: T.DataType, tokens=BLANK_TOKENS_6) -> Column:
    """``text_class`` by the type where that tells the class without making a text."""
    out = F.when(c.isNull(), F.lit(NULL))
    if isinstance(dtype, T.IntegralType) and "0" not in tokens:
        return out.when(c == 0, F.lit(ZERO)).otherwise(F.lit(USEFUL)).cast("tinyint")
    if isinstance(dtype, (T.DoubleType, T.FloatType)) and "nan" in tokens:
        return out.when(F.isnan(c), F.lit(NULL)).when(c == 0, F.lit(ZERO)).otherwise(F.lit(USEFUL)).cast("tinyint")
    if isinstance(dtype, (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return out.otherwise(F.lit(USEFUL)).cast("tinyint")
    if isinstance(dtype, T.StringType):
        t = F.trim(c)
        # the size test spares long texts the comparisons with short words
        short = F.octet_length(t) <= max(map(len, (*tokens, *ZERO_LITERALS)))
        return out.when(short & F.lower(t).isin(*tokens), F.lit(NULL)).when(short & t.isin(*ZERO_LITERALS), F.lit(ZERO)).otherwise(F.lit(USEFUL)).cast("tinyint")
    return text_class(c, tokens)


def text_class(c: Column, tokens=BLANK_TOKENS_6) -> Column:
    """Same classes, every type read through its text; null counts as blank too.

    This is the dialect where "null" means null or blank, and zero is one of a
    literal list rather than a pattern.
    """
    t = F.trim(c.cast("string"))
    return (
        F.when(c.isNull() | _is_token(t, tokens), F.lit(NULL))
        .when(t.isin(*ZERO_LITERALS), F.lit(ZERO))
        .otherwise(F.lit(USEFUL))
        .cast("tinyint")
    )
