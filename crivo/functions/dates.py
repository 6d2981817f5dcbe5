"""Dates kept as text: formats, tolerant parsing and comparison keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: date and time formats found in the profiled tables ---
FMT_COMPACT = "^[0-9]{8}$"
FMT_ISO = "^[0-9]{4}-[0-9]{2}-[0-9]{2}"
FMT_ISO_ONLY = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
FMT_BR = "^[0-9]{2}/[0-9]{2}/[0-9]{4}"
ZERO_DATES = ("00000000", "0000-00-00", "0")
OPEN_END = "9999-12-31"
TIME_COMPACT = "^[0-9]{6}$"
TIME_COLON = "^[0-9]{2}:[0-9]{2}"
# --- end of fixed values ---

COMPACT, ISO, BR = "AAAAMMDD", "ISO", "BR"


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType)


def date_format_of(c: Column) -> Column:
    """Which of the known text formats a value has; null when none."""
    t = F.trim(c)
    return (
        F.when(t.rlike(FMT_COMPACT), COMPACT).when(t.rlike(FMT_ISO), ISO).when(t.rlike(FMT_BR), BR)
    )


def compact_date(c: Column) -> Column:
    """Date of an eight-digit text; zero dates and impossible ones give null."""
    t = F.trim(c)
    return F.when(t.rlike(FMT_COMPACT) & (t != "00000000"), F.try_to_date(t, "yyyyMMdd"))


def parse_date(c: Column, dtype: T.DataType | None = None) -> Column:
    """Date of a text in any known format, or of a native date/timestamp."""
    if isinstance(dtype, T.DateType):
        return c
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return c.cast("date")
    t = F.trim(c.cast("string"))
    return (
        F.when(t.isin(*ZERO_DATES), F.lit(None).cast("date"))
        .when(t.rlike(FMT_COMPACT), F.try_to_date(t, "yyyyMMdd"))
        .when(t.rlike(FMT_ISO), F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd"))
        .when(t.rlike(FMT_BR), F.try_to_date(F.substring(t, 1, 10), "dd/MM/yyyy"))
    )


def date_key(c: Column, dtype: T.DataType | None = None) -> Column:
    """``AAAAMMDD`` text for comparing two systems; unreadable text stays as it is."""
    if dtype is not None and not is_text(dtype):
        return F.date_format(c, "yyyyMMdd")
    t = F.trim(c.cast("string"))
    parsed = F.date_format(parse_date(c), "yyyyMMdd")
    return F.when(t.isin("", *ZERO_DATES), F.lit(None).cast("string")).otherwise(F.coalesce(parsed, t))
