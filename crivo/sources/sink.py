"""Extractions and where they go. Executors write; nothing passes the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators._shape import quoted
from ..session import new_folder


def extract(
    df: DataFrame,
    scope: Column | str | None = None,
    columns: Sequence[str] | None = None,
    order: Sequence[str] = (),
    pii: Sequence[str] = (),
    drop_pii: bool = False,
) -> DataFrame:
    """Full rows of a scope for comparison elsewhere.

    Personal columns leave as a short hash, or not at all. ``order`` sorts
    globally by range partitioning, so the files come out in key order. A hash
    of the row sorts last: it lets Spark cut between rows of one key, so a key
    with very many rows is written by several tasks.
    """
    if scope is not None:
        df = df.where(scope)
    cols = []
    for c in columns if columns is not None else df.columns:
        if c not in pii:
            cols.append(df[quoted(c)])
        elif not drop_pii:
            cols.append(N.mask(df[quoted(c)]).alias(f"{c}_hash"))
    out = df.select(*cols)
    if not order:
        return out
    # map columns cannot be hashed; without one of the others there is nothing to cut by
    types = dict(out.dtypes)
    rest = [c for c in out.columns if c not in order and "map<" not in types[c]]
    return out.orderBy(*map(quoted, order), F.xxhash64(*map(quoted, rest))) if rest else out.orderBy(*map(quoted, order))


def extract_renamed(df: DataFrame, names: Mapping[str, str], trim: bool = True) -> DataFrame:
    """Projection under business names, texts trimmed."""
    types = dict(df.dtypes)
    return df.select(*[
        (F.trim(df[c]) if trim and types[c] == "string" else df[c]).alias(n) for c, n in names.items()
    ])


def extract_scopes(
    df: DataFrame, scopes: Mapping[str, Column | None], **kwargs
) -> dict[str, DataFrame]:
    """The same extraction for several scopes, e.g. all rows and what a screen shows."""
    return {name: extract(df, scope, **kwargs) for name, scope in scopes.items()}


def scope_flag(p: Column) -> Column:
    """``'S'`` when the row is in the narrower scope, else ``'N'``."""
    return F.when(p, "S").otherwise("N")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_parquet(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists"
) -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def save_table(
    df: DataFrame, name: str, cluster: Sequence[str] = (), buckets: int = 0, mode: str = "errorifexists"
) -> None:
    """Keeps an extraction as a table, bucketed by the key it will be joined on."""
    w = df.write.mode(mode).format("parquet")
    if buckets and cluster:
        w = w.bucketBy(buckets, *cluster).sortBy(*cluster)
    w.saveAsTable(name)


def save_bucketed(df: DataFrame, name: str, key: Sequence[str], buckets: int, mode: str = "errorifexists") -> DataFrame:
    """An extraction kept in the shared folder, cut and sorted by its key, under a table name.

    Two that are cut by keys of the same types into equally many buckets join on them without a shuffle, as often as
    they are compared. Each bucket is one file, since rows are brought together by bucket before they are written.
    """
    together = df.repartition(buckets, *[quoted(k) for k in key])
    path = new_folder(df.sparkSession, name)
    together.write.mode(mode).format("parquet").option("path", path).bucketBy(buckets, *key).sortBy(*key).saveAsTable(name)
    return df.sparkSession.table(name)


def write_reports(reports: Mapping[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Each report under its own folder of ``path``, written by as many tasks as it has partitions."""
    for name, df in reports.items():
        df.write.mode(mode).option("header", True).csv(f"{path}/{name}")
