"""Scans: tables, files, parameterised bases, scenarios, tolerant casts, samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import normalize as N


def read_table(spark: SparkSession, source: str, fmt: str | None = None, **options) -> DataFrame:
    """A catalog table or view by name, or files when ``fmt`` is given."""
    if fmt is None:
        return spark.table(source)
    return spark.read.options(**options).format(fmt).load(source)


def optional_filters(df: DataFrame, params: Mapping[str, object | None]) -> DataFrame:
    """Equality per non-empty parameter; an empty one adds no predicate at all.

    Leaving it out of the plan, rather than testing it per row, keeps the
    remaining equalities pushable to the scan.
    """
    given = {c: v for c, v in params.items() if v is not None and v != ""}
    return reduce(lambda d, cv: d.where(d[cv[0]] == cv[1]), given.items(), df)


def base_view(df: DataFrame, params: Mapping[str, object | None], name: str | None = None) -> DataFrame:
    """The filtered base of a profile, registered as a temp view when named."""
    out = optional_filters(df, params)
    if name is not None:
        out.createOrReplaceTempView(name)
    return out


def parameters(spark: SparkSession, params: Mapping[str, str | None]) -> DataFrame:
    """The parameters of a run as one row, to keep beside its reports."""
    return spark.range(1).select(*[F.lit(v or "").alias(k) for k, v in params.items()])


# --- scenario predicates ----------------------------------------------------


def equals(df: DataFrame, column: str, value) -> Column:
    return df[column] == value


def trimmed_equals(df: DataFrame, column: str, value: str) -> Column:
    """Equality on the trimmed text; no pushdown, for columns with padding."""
    return N.text(df[column]) == value


def prefixed(df: DataFrame, column: str, value: str) -> Column:
    """The value itself or anything below it in a hierarchy of codes."""
    return N.text(df[column]).startswith(value)


def in_list(df: DataFrame, column: str, values: Sequence[str], numeric: bool = False) -> Column:
    """IN list; ``numeric`` compares the codes as whole numbers."""
    if numeric:
        return N.numeric_code(df[column]).isin(*[int(v) for v in values])
    return df[column].isin(*values)


def contains(df: DataFrame, column: str, value: str) -> Column:
    return df[column].cast("string").contains(value)


# --- tolerant casts -----------------------------------------------------------


def safe_base(
    df: DataFrame, casts: Mapping[str, str] | None = None, dates: Mapping[str, str] | None = None,
    stamps: Mapping[str, str] | None = None,
) -> DataFrame:
    """Same columns, unreadable values as null instead of a failed job.

    ``casts`` maps a column to its type, ``dates`` a text column to its format,
    ``stamps`` one with date and time; blank and zero dates are null.
    """
    cols = []
    for c in df.columns:
        if casts and c in casts:
            x = N.text(df[c]) if casts[c] != "string" else df[c]
            cols.append(x.try_cast(casts[c]).alias(c))
        elif dates and c in dates:
            t = N.text(df[c])
            cols.append(F.when(~t.isin("", *D.ZERO_DATES), F.try_to_date(t, dates[c])).alias(c))
        elif stamps and c in stamps:
            t = N.text(df[c])
            cols.append(F.when(~t.isin("", *D.ZERO_DATES), F.try_to_timestamp(t, F.lit(stamps[c]))).alias(c))
        else:
            cols.append(df[c])
    return df.select(*cols)


# --- samples ------------------------------------------------------------------


def sample_first(df: DataFrame, n: int = 20, order: Sequence[str] = ()) -> DataFrame:
    """First rows, in key order when one is given."""
    return (df.orderBy(*order) if order else df).limit(n)


def sample_random(df: DataFrame, n: int = 10, seed: int | None = None) -> DataFrame:
    """``n`` random rows; every task keeps its own best ``n`` before they meet."""
    return df.orderBy(F.rand(seed)).limit(n)
