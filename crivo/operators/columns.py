"""Column profiles: fill, cardinality, domain, flags, numbers, totals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import labels as L
from ..functions import missing as M
from ..functions.ratios import count_if, pct
from ._shape import (
    Section,
    as_text,
    hashed_counts,
    numeric_columns,
    private_names,
    quoted,
    stack_rows,
    top_k_per_group,
    total_of,
    type_name,
    value_counts,
    wide_sum,
)


def _names(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    return list(columns) if columns is not None else df.columns


def fill_scan(
    df: DataFrame, columns: Sequence[str] | None = None, mode: str = "f1", tokens=None
) -> DataFrame:
    """How filled every column is, from one scan.

    ``f1``     null / blank / zero / useful, with the verdict ladder
    ``f3``     zeros count as filled, verdicts ask to check the comments
    ``dev2``   nulls include blanks, literal zero list, exact distinct count
    ``simple`` null and filled only
    """
    names = _names(df, columns)
    if mode == "simple":
        return _fill_simple(df, names)
    if mode == "dev2":
        return _fill_dev2(df, names, tokens or M.BLANK_TOKENS_6)
    return fill_section(df, names, mode, tokens).report(df)


def fill_section(df: DataFrame, names: Sequence[str], mode: str = "f1", tokens=None) -> Section:
    tokens = tokens or (M.BLANK_TOKENS_6 if mode == "f3" else M.BLANK_TOKENS_8)
    # each cell is classified once; the aggregate only counts classes
    classes = private_names(df, *[f"classe_{i}" for i in range(len(names))])
    cells = [M.value_class(df[quoted(c)], df.schema[c].dataType, tokens).alias(k) for c, k in zip(names, classes)]
    rows = []
    for c, k in zip(names, map(F.col, classes)):
        rows.append({
            "coluna": F.lit(c),
            "tipo": F.lit(type_name(df, c)),
            "total": F.count("*"),
            "nulos": count_if(k == M.NULL),
            "vazios": count_if(k == M.BLANK),
            "zeros": count_if(k == M.ZERO),
        })
    if mode not in ("f1", "f3"):
        raise ValueError(f"unknown fill mode {mode!r}")
    return Section(rows, _fill_f3 if mode == "f3" else _fill_f1, cells)


def _fill_f3(out: DataFrame) -> DataFrame:
    n, v, t = (F.col(x) for x in ("nulos", "vazios", "total"))
    verdict = (
        F.when(t == 0, L.FILL3_NO_ROWS)
        .when(n == t, L.FILL3_ALL_NULL)
        .when(n + v == t, L.FILL3_NO_USEFUL)
        .otherwise(L.FILL3_OK)
    )
    return out.select(
        "coluna", "tipo", "total", "nulos", "vazios", "zeros",
        (t - n - v).alias("preenchidos_nao_vazios"), verdict.alias("veredito"),
    ).orderBy("coluna")


def _fill_f1(out: DataFrame) -> DataFrame:
    n, v, z, t = (F.col(x) for x in ("nulos", "vazios", "zeros", "total"))
    useful = t - n - v - z
    verdict = (
        F.when(n == t, L.FILL_ALL_NULL)
        .when(useful <= 0, L.FILL_NO_USEFUL)
        .when(useful * 100 < t, L.FILL_ALMOST_EMPTY)
        .otherwise(L.FILL_OK)
    )
    return out.select(
        "coluna", "tipo", "nulos", "vazios", "zeros", useful.alias("uteis"),
        pct(useful, t).alias("pct_util"), verdict.alias("veredito"),
    ).orderBy("veredito", "pct_util", "coluna")


def _fill_simple(df: DataFrame, names: Sequence[str]) -> DataFrame:
    rows = [
        {"coluna": F.lit(c), "nulos": count_if(df[quoted(c)].isNull()), "preenchidos": F.count(df[quoted(c)])} for c in names
    ]
    filled, null = F.col("preenchidos"), F.col("nulos")
    return stack_rows(df, rows).withColumn("pct_preenchido", pct(filled, filled + null)).orderBy("coluna")


def _fill_dev2(df: DataFrame, names: Sequence[str], tokens) -> DataFrame:
    # the exact distinct count needs the value frequencies anyway, so the
    # classes are counted from them instead of from a second pass over the rows
    freq = hashed_counts(df, names, {c: M.text_class_of(df[quoted(c)], df.schema[c].dataType, tokens) for c in names})
    k, n = F.col("classe"), F.col("linhas")
    per = freq.groupBy("coluna").agg(
        F.sum(n).alias("total"),
        F.sum(F.when(k == M.NULL, n).otherwise(0)).alias("nulos"),
        F.sum(F.when(k == M.ZERO, n).otherwise(0)).alias("zeros"),
        F.sum(F.when(k == M.USEFUL, n).otherwise(0)).alias("uteis"),
        F.count("h1").alias("distintos"),
    )
    types = F.create_map(*[x for c in names for x in (F.lit(c), F.lit(type_name(df, c)))])
    return per.select(
        "coluna", types[F.col("coluna")].alias("tipo"), "total", "nulos", "zeros", "uteis",
        pct(F.col("nulos"), F.col("total"), 4).alias("pct_nulos"), "distintos",
    ).orderBy("coluna")


def null_pct(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null percentage of critical columns, one wide row."""
    t = F.count("*")
    return df.agg(
        t.alias("total_linhas"), *[pct(count_if(df[quoted(c)].isNull()), t).alias(f"pct_null_{c}") for c in columns]
    )


def declared_empty(df: DataFrame, columns: Sequence[str], tokens=M.BLANK_TOKENS_6) -> DataFrame:
    """Are the columns documented as having no source still empty?"""
    return declared_empty_section(df, columns, tokens).report(df)


def declared_empty_section(df: DataFrame, columns: Sequence[str], tokens=M.BLANK_TOKENS_6) -> Section:
    rows = []
    for c in columns:
        filled = count_if(M.text_class(df[quoted(c)], tokens) != M.NULL)
        rows.append({
            "coluna": F.lit(c), "total": F.count("*"), "nulos": count_if(df[quoted(c)].isNull()), "preenchidos": filled,
        })
    verdict = F.when(F.col("preenchidos") == 0, L.DECLARED_ALL_NULL).otherwise(L.DECLARED_DIVERGES)
    return Section(rows, lambda out: out.withColumn("veredito", verdict).orderBy("coluna"))


def cardinality(
    df: DataFrame, columns: Sequence[str] | None = None, exact: bool = False, mode: str = "f1"
) -> DataFrame:
    """Distinct values per column with a classification.

    The sketch variant keeps one small state per column and task. ``exact``
    counts over the value frequencies, which spread by value over the cluster.
    """
    names = _names(df, columns)
    if not exact:
        return cardinality_section(df, names, mode).report(df)
    return cardinality_of(distinct_counts(df, names), mode)


def distinct_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(coluna, distintos, total, tipo): exact distinct counts over the value frequencies."""
    per = (
        hashed_counts(df, names)
        .groupBy("coluna")
        .agg(F.count("h1").alias("distintos"), F.sum("linhas").alias("total"))
    )
    types = F.create_map(*[x for c in names for x in (F.lit(c), F.lit(type_name(df, c)))])
    return per.withColumn("tipo", types[F.col("coluna")])


def cardinality_of(counts: DataFrame, mode: str = "f1") -> DataFrame:
    """``cardinality`` from distinct counts already at hand."""
    return _cardinality_f3(counts) if mode == "f3" else _cardinality_f1(counts)


def cardinality_section(df: DataFrame, names: Sequence[str], mode: str = "f1") -> Section:
    rows = [
        {
            "coluna": F.lit(c), "tipo": F.lit(type_name(df, c)),
            "distintos": F.approx_count_distinct(df[quoted(c)]), "total": F.count("*"),
        }
        for c in names
    ]
    return Section(rows, _cardinality_f3 if mode == "f3" else _cardinality_f1)


def _cardinality_f3(out: DataFrame) -> DataFrame:
    d, t = F.col("distintos"), F.col("total")
    profile = (
        F.when(d <= 1, L.CARD3_CONSTANT)
        .when(d <= 20, L.CARD3_LOW)
        .when(d * 10 >= t * 9, L.CARD3_IDENTIFIER)
        .otherwise(L.CARD3_NORMAL)
    )
    return out.select("coluna", "distintos", "total", profile.alias("perfil")).orderBy("coluna")


def _cardinality_f1(out: DataFrame) -> DataFrame:
    d, t = F.col("distintos"), F.col("total")
    ladder = (
        F.when(d <= 1, L.CARD_CONSTANT)
        .when(d <= 3, L.CARD_VERY_LOW)
        .when(d * 100 > t * 95, L.CARD_IDENTIFIER)
        .otherwise(L.CARD_NORMAL)
    )
    return out.select(
        "coluna", "tipo", "distintos", pct(d, t, 4).alias("pct_distintos"), ladder.alias("classificacao")
    ).orderBy("distintos", "coluna")


def domain(df: DataFrame, columns: Sequence[str], k: int | None = None) -> DataFrame:
    """Most frequent values of every column, all columns from one scan."""
    return domain_of(value_counts(df, columns), k)


def domain_of(freq: DataFrame, k: int | None = None) -> DataFrame:
    """``domain`` from value frequencies already at hand; those of any one column add up to the table."""
    total = freq.groupBy("coluna").agg(F.sum("linhas").alias("n")).agg(F.max("n")).scalar()
    top = freq
    if k is not None:
        top = top_k_per_group(freq, ["coluna"], [F.desc("linhas"), F.asc_nulls_first("valor")], k)
    return top.select(
        "coluna", "valor", F.col("linhas").alias("qtd"), pct(F.col("linhas"), total).alias("pct")
    ).orderBy("coluna", F.desc("qtd"), "valor")


def flag_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """True / false / null of the boolean columns."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
    return flag_section(df, columns).report(df)


def flag_section(df: DataFrame, columns: Sequence[str]) -> Section:
    rows = [
        {
            "flag": F.lit(c), "verdadeiro": count_if(df[quoted(c)]), "falso": count_if(~df[quoted(c)]),
            "nulo": count_if(df[quoted(c)].isNull()), "pct_verdadeiro": pct(count_if(df[quoted(c)]), F.count("*")),
        }
        for c in columns
    ]
    return Section(rows, lambda out: out.orderBy("flag"))


def string_flag_domain(
    df: DataFrame, columns: Sequence[str], combine: bool = False, label: str = L.BUCKET_BLANK
) -> DataFrame:
    """States of text flags: one list per flag, or their combinations."""
    if combine:
        keys = [M.display_bucket(df[quoted(c)], label).alias(c) for c in columns]
        return df.groupBy(*keys).agg(F.count("*").alias("qtd")).orderBy(F.desc("qtd"), *columns)
    freq = value_counts(df, {c: M.display_bucket(df[quoted(c)], label) for c in columns})
    return freq.orderBy("coluna", F.desc("linhas"), "valor")


def numeric_profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    accuracy: int = 10000,
    places: int = 4,
    mode: str = "f1",
) -> DataFrame:
    """Range, mean, approximate median and p95, negatives and zeros, one scan.

    ``mode='sum'`` is the variant with sum and positives and no percentiles.
    """
    names = list(columns) if columns is not None else numeric_columns(df)
    return numeric_section(df, names, accuracy, places, mode).report(df)


def numeric_section(
    df: DataFrame, names: Sequence[str], accuracy: int = 10000, places: int = 4, mode: str = "f1"
) -> Section:
    rows = []
    for c in names:
        x = df[quoted(c)]
        row = {
            "coluna": F.lit(c), "tipo": F.lit(type_name(df, c)), "preenchidos": F.count(x),
            "minimo": F.min(x).cast("double"), "maximo": F.max(x).cast("double"),
            "media": F.round(F.avg(x).cast("double"), places),
        }
        if mode == "sum":
            row["soma"] = F.round(wide_sum(x, df.schema[c].dataType).cast("double"), places)
            row["positivos"] = count_if(x > 0)
        else:
            q = F.percentile_approx(x, [0.5, 0.95], accuracy)
            row["mediana"] = q[0].cast("double")
            row["p95"] = q[1].cast("double")
        row["negativos"] = count_if(x < 0)
        row["zeros"] = count_if(x == 0)
        rows.append(row)
    return Section(rows, lambda out: out.orderBy("coluna"))


def totals(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    scopes: Mapping[str, Column] | None = None,
    by: Sequence[str | Column] | None = None,
    decimal: bool = False,
    places: int = 2,
) -> DataFrame:
    """Sums to compare with another system's totals.

    Plain: one row per column. ``scopes`` adds one sum per named predicate, all
    in the same pass. ``by`` groups instead, and ``decimal`` adds the sum of the
    values taken as DECIMAL(38,3) beside the plain one.
    """
    names = list(columns) if columns is not None else numeric_columns(df)
    if by is not None:
        aggs = [F.count("*").alias("linhas")]
        for c in names:
            aggs.append(F.round(wide_sum(df[quoted(c)], df.schema[c].dataType).cast("double"), places).alias(f"soma_{c}"))
            if decimal:
                aggs.append(F.sum(F.col(c).cast("decimal(38,3)")).cast("double").alias(f"soma_decimal_{c}"))
        return df.groupBy(*by).agg(*aggs)
    if scopes is not None:
        rows = [
            {
                "coluna": F.lit(c),
                **{f"total_{s}": F.round(wide_sum(F.when(p, df[quoted(c)]), df.schema[c].dataType).cast("double"), places) for s, p in scopes.items()},
            }
            for c in names
        ]
        return stack_rows(df, rows).orderBy("coluna")
    return totals_section(df, names, places).report(df)


def totals_section(df: DataFrame, names: Sequence[str], places: int = 2) -> Section:
    rows = [
        {
            "coluna": F.lit(c),
            "total_numerico": wide_sum(df[quoted(c)], df.schema[c].dataType).cast("double"),
            "linhas_preenchidas": F.count(df[quoted(c)]),
        }
        for c in names
    ]
    rounded = F.round(F.col("total_numerico"), places).alias("total_arredondado")
    return Section(
        rows, lambda out: out.select("coluna", "total_numerico", rounded, "linhas_preenchidas").orderBy("coluna")
    )


def dedup_total(df: DataFrame, key: Sequence[str], columns: Sequence[str], places: int = 2) -> DataFrame:
    """Sum over all rows against the sum of one value per true key.

    A header value repeated on every child row inflates the plain sum. Both
    sums come from the same pass: the plain one adds up the per-key sums.
    """
    per_key = df.groupBy(*map(quoted, key)).agg(
        *[x for i, c in enumerate(columns) for x in (wide_sum(df[quoted(c)], df.schema[c].dataType).alias(f"s{i}"), F.max(quoted(c)).alias(f"m{i}"))]
    )
    rows = [
        {
            "coluna": F.lit(c),
            "soma_ingenua": F.round(F.sum(f"s{i}").cast("double"), places),
            "soma_dedup": F.round(wide_sum(F.col(f"m{i}"), df.schema[c].dataType).cast("double"), places),
        }
        for i, c in enumerate(columns)
    ]
    return (
        stack_rows(per_key, rows)
        .withColumn("diferenca", F.round(F.col("soma_ingenua") - F.col("soma_dedup"), places))
        .orderBy("coluna")
    )


def distribution(
    df: DataFrame,
    dims: Sequence[str],
    k: int | None = None,
    metrics: Mapping[str, Column] | None = None,
    bucket: bool = True,
    label: str = L.BUCKET_BLANK,
) -> DataFrame:
    """Rows and share per value of the dimensions, blanks under one label.

    ``metrics`` adds aggregates per group; ``k`` keeps the largest groups, as a
    top-k report does, and ``None`` keeps all of them.
    """
    keys = [M.display_bucket(df[quoted(c)], label).alias(c) if bucket else df[quoted(c)] for c in dims]
    aggs = [a.alias(n) for n, a in (metrics or {}).items()]
    out = df.groupBy(*keys).agg(F.count("*").alias("linhas"), *aggs)
    out = out.withColumn("pct", pct(F.col("linhas"), total_of(out)))
    out = out.orderBy(F.desc("linhas"), *map(quoted, dims))
    return out if k is None else out.limit(k)
