"""Plan shapes shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import quoted

# Report rows whose aggregates share one pass. More would outgrow what the JVM
# compiles as one method; on a columnar table each batch reads its own columns.
PASS_ROWS = 30

# The same for report rows over cells worked out in the pass: a cell is some hundred
# bytes of code, and a method of more than 8,000 is interpreted, not compiled.
BATCH_ROWS = 11


def batches(rows: Sequence, size: int = PASS_ROWS) -> list[Sequence]:
    return [rows[i:i + size] for i in range(0, len(rows), size)]


def _row_structs(rows: Sequence[Mapping[str, Column]]) -> Column:
    return F.array(*[F.struct(*[c.alias(n) for n, c in r.items()]) for r in rows])


def stack_rows(df: DataFrame, rows: Sequence[Mapping[str, Column]], size: int = PASS_ROWS) -> DataFrame:
    """One report row per mapping, from one aggregation pass over ``df`` per batch of rows."""
    parts = [df.agg(_row_structs(part).alias("linhas_relatorio")).select(F.inline("linhas_relatorio")) for part in batches(rows, size)]
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class Section:
    """A column report as parts, so that several can share one pass.

    ``extra`` are cells worked out once per row, ``rows`` the report rows as
    aggregates over them and the table, ``finish`` turns those into the report.
    """

    rows: Sequence[Mapping[str, Column]]
    finish: Callable[[DataFrame], DataFrame]
    extra: Sequence[Column] = field(default=())

    def report(self, df: DataFrame) -> DataFrame:
        if not self.extra:
            return self.finish(stack_rows(df, self.rows))
        return self.finish(stack_rows(df.select("*", *self.extra), self.rows, BATCH_ROWS))


def shared_passes(df: DataFrame, sections: Mapping[str, Section]) -> list[DataFrame]:
    """The raw rows of all sections: one row with an array per section from each pass, a pass for each batch."""
    cells = [c for s in sections.values() for c in s.extra]
    wide = df.select("*", *cells)
    out = []
    for part in batches([(name, r) for name, s in sections.items() for r in s.rows]):
        own: dict[str, list] = {}
        for name, r in part:
            own.setdefault(name, []).append(r)
        out.append(wide.agg(*[_row_structs(rows).alias(name) for name, rows in own.items()]))
    return out


def section_report(passes: Sequence[DataFrame], name: str, section: Section) -> DataFrame:
    """Report of one section from the shared passes."""
    parts = [p.select(F.inline(name)) for p in passes if name in p.columns]
    return section.finish(reduce(DataFrame.unionByName, parts))


def as_text(df: DataFrame, name: str) -> Column:
    """Column as text; -0.0 and 0.0 are one value, as they are for DISTINCT."""
    c = df[quoted(name)]
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        c = c + F.lit(0.0)
    return c.cast("string")


def private_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Stands for a null among hashes that are hashed together.
NULL_HASH = -7046029254386353131


def hash_pair(df: DataFrame, name: str) -> list[Column]:
    """Two independent 64-bit hashes of the typed value, both null for null: 16 bytes stand for any value."""
    c, dtype = df[quoted(name)], df.schema[name].dataType
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        c = c + F.lit(0.0)
    if "map<" in dtype.simpleString():
        c = c.cast("string")
    return [F.when(c.isNotNull(), F.xxhash64(F.lit(seed), c)) for seed in (1, 2)]


def hashed_counts(df: DataFrame, names: Sequence[str], classes: Mapping[str, Column] | None = None) -> DataFrame:
    """(coluna, h1, h2, classe, linhas): frequencies of values that are only counted, never shown.

    ``classes`` gives a class per column that depends on the value alone.
    """
    cells = [
        F.struct(F.lit(i).alias("i"), *[h.alias(f"h{j}") for j, h in enumerate(hash_pair(df, c), 1)],
                 (classes[c] if classes else F.lit(None).cast("tinyint")).alias("classe"))
        for i, c in enumerate(names)
    ]
    freq = df.select(F.inline(F.array(*cells))).groupBy("i", "h1", "h2", "classe").agg(F.count("*").alias("linhas"))
    names_of = F.array(*map(F.lit, names))
    return freq.select(names_of[F.col("i")].alias("coluna"), "h1", "h2", "classe", "linhas")


def unpivot_text(
    df: DataFrame, cols: Mapping[str, Column] | Sequence[str], ids: Sequence[str] = (), hashed: bool = False
) -> DataFrame:
    """(ids…, coluna, valor): one row per cell of the chosen columns.

    ``hashed`` is for callers that only compare values and never show them.
    """
    if not isinstance(cols, Mapping):
        cols = {c: _pair_text(df, c) if hashed else as_text(df, c) for c in cols}
    # ids get neutral names, so a column may be an id and a profiled one at once
    keys = {f"id_{i}": n for i, n in enumerate(ids)}
    wide = df.select(*[df[quoted(n)].alias(a) for a, n in keys.items()], *[c.alias(n) for n, c in cols.items()])
    return wide.unpivot(list(keys), [F.col(f"`{n}`") for n in cols], "coluna", "valor")


def _pair_text(df: DataFrame, name: str) -> Column:
    one, two = hash_pair(df, name)
    return F.concat(F.hex(one), F.lit(":"), F.hex(two))


def value_counts(df: DataFrame, cols: Mapping[str, Column] | Sequence[str]) -> DataFrame:
    """(coluna, valor, linhas) for all columns from one scan and one shuffle.

    Map-side aggregation leaves at most one row per task and value, so a value
    that fills a third of the table does not load one reducer. Whatever is
    derived from a value (pattern, length, stripped code) is worked out on this
    result once per distinct value instead of once per row.
    """
    cells = unpivot_text(df, cols)
    return cells.groupBy("coluna", "valor").agg(F.count("*").alias("linhas"))


def semi_null_safe(df: DataFrame, keys_df: DataFrame, keys: Sequence[str], how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose key is (or is not) in ``keys_df``; null equals null."""
    alias = {k: f"chave_{i}" for i, k in enumerate(keys)}
    right = keys_df.select(*[F.col(quoted(k)).alias(a) for k, a in alias.items()])
    cond = reduce(and_, [df[quoted(k)].eqNullSafe(right[a]) for k, a in alias.items()])
    return df.join(right, cond, how)


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows of each group.

    The rows of each input task are ranked apart first, so one huge group is
    never sorted whole in one task.
    """
    part, rank = private_names(df, "parte", "posicao")
    apart = Window.partitionBy(*group, part).orderBy(*order)
    best = df.withColumn(part, F.spark_partition_id()).withColumn(rank, F.row_number().over(apart))
    best = best.where(F.col(rank) <= k).drop(rank, part)
    w = Window.partitionBy(*group).orderBy(*order)
    return best.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k).drop(rank)


def total_of(groups: DataFrame, rows: str = "linhas") -> Column:
    """Row count as a scalar subquery over groups that carry their counts.

    Spark reuses the shuffle of the groups for it, so the table, or the join
    behind it, is read once.
    """
    return groups.agg(F.sum(rows)).scalar()


def extremes(c: Column, dtype: T.DataType) -> list[Column]:
    """Aggregates in (smallest, largest) pairs; some pair differs when ``c`` has several values.

    Texts enter as two independent 64-bit hashes: their own extremes would make
    Spark sort the rows, fixed-width ones stay in a hash aggregate.
    """
    if isinstance(dtype, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)):
        return [F.min(c), F.max(c)]
    out = []
    for seed in (1, 2):
        h = F.when(c.isNotNull(), F.xxhash64(F.lit(seed), c))
        out += [F.min(h), F.max(h)]
    return out


def wide_sum(c: Column, dtype: T.DataType) -> Column:
    """Sum that no number of rows takes out of range: whole numbers add up as decimals."""
    return F.sum(c.cast("decimal(38,0)")) if isinstance(dtype, T.IntegralType) else F.sum(c)


def type_name(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def join_names(cols: Sequence[str]) -> str:
    return " + ".join(cols)
