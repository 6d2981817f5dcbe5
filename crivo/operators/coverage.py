"""Coverage of key lists and tables by one another."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import labels as L
from ..functions import missing as M
from ..functions import normalize as N
from ..functions.ratios import count_if, pct
from ._shape import private_names, quoted


def tag_union(tables: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """One row per key with a 0/1 column per table, from a single shuffle."""
    names = list(tables)
    parts = [
        df.select(*keys, *[F.lit(1 if n == m else 0).cast("tinyint").alias(f"em_{m}") for m in names])
        for n, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(
        *[F.max(f"em_{m}").alias(f"em_{m}") for m in names]
    )


def restrict_to_list(
    df: DataFrame, key_list: DataFrame, column: str, list_key: str = "chave", mode: str = "list", many: bool = False,
) -> DataFrame:
    """Rows whose normalised code is in the list, with the code as ``list_key``.

    A column of the table that already has that name stays; the code then takes
    the next free name. Spark picks the join by the size it finds at run time;
    ``many`` codes, too many to be broadcast, are hashed in each task, so that the
    whole rows of the table are not sorted to meet them.
    """
    code, = private_names(df, list_key)
    keys = key_list.select(F.col(list_key).alias(code)).distinct()
    if many:
        keys = keys.hint("shuffle_hash")
    return df.withColumn(code, N.strip_zeros(df[quoted(column)], mode)).join(keys, code, "left_semi").select(*map(quoted, df.columns), code)


def _list_match(
    key_list: DataFrame, df: DataFrame, column: str, list_key: str, mode: str, extra: Mapping[str, Column],
) -> DataFrame:
    """The list with row count (and extras) of its keys in the table.

    The table is aggregated per key before it meets the list, so a key that
    holds a large part of the table is one row by then.
    """
    code, = private_names(df, "codigo_da_lista")
    per_key = df.withColumn(code, N.strip_zeros(df[quoted(column)], mode)).groupBy(code).agg(
        F.count("*").alias("qtd_linhas"), *[a.alias(n) for n, a in extra.items()]
    )
    return key_list.join(per_key.withColumnRenamed(code, list_key), list_key, "left")


def coverage(
    key_list: DataFrame, df: DataFrame, column: str, list_key: str = "chave", mode: str = "list",
) -> DataFrame:
    """Found and missing keys of a list, rows returned, repeated keys, coverage.

    Entries of the list and rows of the table are counted per code in one shuffle
    of both, so no task sorts the two sides for a join.
    """
    code, e, n = F.col("codigo"), F.col("entradas"), F.col("qtd_linhas")
    entries = key_list.select(F.col(list_key).alias("codigo"), F.lit(1).alias("entrada"), F.lit(0).alias("linha"))
    rows = df.select(N.strip_zeros(df[quoted(column)], mode).alias("codigo"), F.lit(0).alias("entrada"), F.lit(1).alias("linha"))
    both = entries.unionByName(rows).groupBy("codigo").agg(F.sum("entrada").alias("entradas"), F.sum("linha").alias("linhas"))
    # a null code matches nothing
    per = both.where(e > 0).select("entradas", F.when(code.isNotNull() & (F.col("linhas") > 0), F.col("linhas")).alias("qtd_linhas"))
    total = F.coalesce(F.sum(e), F.lit(0))
    found = F.coalesce(F.sum(F.when(n.isNotNull(), e)), F.lit(0))
    return per.agg(
        total.alias("chaves_lista"),
        found.alias("encontradas"),
        (total - found).alias("ausentes"),
        F.coalesce(F.sum(n * e), F.lit(0)).alias("linhas_tabela"),
        F.coalesce(F.sum(F.when(n > 1, e)), F.lit(0)).alias("chaves_repetidas"),
        F.coalesce(F.max(n), F.lit(0)).alias("max_linhas_por_chave"),
        pct(found, total).alias("cobertura_percentual"),
    )


def coverage_summary(
    key_list: DataFrame, df: DataFrame, column: str, items: str, latest: Mapping[str, str],
    list_key: str = "chave", mode: str = "list",
) -> DataFrame:
    """Executive summary: coverage, items not kept as rows, latest loads found."""
    extra = {"adicionais": F.sum(F.greatest(F.coalesce(F.col(items), F.lit(0)) - 1, F.lit(0)))}
    extra.update({name: F.max(c) for name, c in latest.items()})
    m = _list_match(key_list, df, column, list_key, mode, extra)
    # several spellings of one code share its rows: reduce to codes before adding up
    per = m.groupBy(list_key).agg(
        F.count("*").alias("entradas"), *[F.max(c).alias(c) for c in ("qtd_linhas", *extra)]
    )
    n, e = F.col("qtd_linhas"), F.col("entradas")
    total = F.coalesce(F.sum(e), F.lit(0))
    found = F.coalesce(F.sum(F.when(n.isNotNull(), e)), F.lit(0))
    return per.agg(
        total.alias("chaves_lista"),
        found.alias("encontradas"),
        (total - found).alias("ausentes"),
        F.coalesce(F.sum(n * e), F.lit(0)).alias("linhas_tabela"),
        F.coalesce(F.sum(F.when(n > 1, e)), F.lit(0)).alias("chaves_repetidas"),
        pct(found, total).alias("cobertura_percentual"),
        F.coalesce(F.sum("adicionais"), F.lit(0)).cast("bigint").alias("itens_adicionais"),
        *[F.max(name).alias(name) for name in latest],
    )


def missing_keys(
    key_list: DataFrame, df: DataFrame, column: str, list_key: str = "chave", mode: str = "list"
) -> DataFrame:
    """List entries with no row in the table."""
    have = df.select(N.strip_zeros(df[quoted(column)], mode).alias(list_key)).distinct()
    return key_list.join(have, list_key, "left_anti")


def challenge_missing(missing: DataFrame, original: str, df: DataFrame, column: str) -> DataFrame:
    """Second opinion on the missing keys: compare the raw texts directly."""
    raw = df.select(N.text(df[quoted(column)]).alias("valor_tabela")).where(F.col("valor_tabela").isNotNull()).distinct()
    joined = missing.join(raw, F.trim(missing[original]) == raw["valor_tabela"], "left")
    verdict = F.when(F.col("valor_tabela").isNull(), L.CHALLENGE_ABSENT).otherwise(L.CHALLENGE_FOUND)
    return joined.select(missing[original], "valor_tabela", verdict.alias("resultado_teste_direto"))


def _codes(df: DataFrame, column: str, mode: str) -> DataFrame:
    return df.where(M.has_value(df[quoted(column)])).select(N.strip_zeros(df[quoted(column)], mode).alias("codigo"))


def referential_integrity(
    df: DataFrame, column: str, ref: DataFrame, ref_column: str, mode: str = "all"
) -> DataFrame:
    """Distinct codes, codes unknown to the reference table and their share."""
    per = tag_union({"aqui": _codes(df, column, mode), "ref": _codes(ref, ref_column, mode)}, ["codigo"])
    here = F.col("em_aqui") == 1
    orphan = count_if(here & (F.col("em_ref") == 0))
    return per.agg(
        count_if(here).alias("codigos_distintos_aqui"),
        orphan.alias("sem_correspondencia"),
        pct(orphan, count_if(here)).alias("pct_orfao"),
    )


def orphan_codes(df: DataFrame, column: str, ref: DataFrame, ref_column: str, mode: str = "all") -> DataFrame:
    """The codes unknown to the reference table, with their rows."""
    codes = _codes(df, column, mode).groupBy("codigo").agg(F.count("*").alias("linhas"))
    return codes.join(_codes(ref, ref_column, mode).distinct(), "codigo", "left_anti")


def _check_null_keys(null_keys: str) -> None:
    if null_keys not in ("unmatched", "equal"):
        raise ValueError(f"unknown rule for null keys {null_keys!r}")


def _whole_key(keys: Sequence[str]) -> Column:
    return reduce(and_, [F.col(k).isNotNull() for k in keys])


def presence_matrix(tables: Mapping[str, DataFrame], keys: Sequence[str], null_keys: str = "unmatched") -> DataFrame:
    """In which of the tables does each key occur? Keys and share per pattern.

    A key with a null part is found in no table, as ``=`` has it; with
    ``null_keys="equal"`` null is a value like any other.
    """
    _check_null_keys(null_keys)
    per = tag_union(tables, keys)
    known = F.lit(True) if null_keys == "equal" else _whole_key(keys)
    marks = [F.when(known & (F.col(f"em_{n}") == 1), n).otherwise("--") for n in tables]
    out = per.groupBy(F.concat_ws(" ", *marks).alias("presenca")).agg(F.count("*").alias("chaves"))
    # at most 2^n patterns reach this window
    total = F.sum("chaves").over(Window.partitionBy())
    return out.select("presenca", "chaves", pct(F.col("chaves"), total).alias("pct")).orderBy(F.desc("chaves"), "presenca")


def two_way_coverage(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of either table: in both, only in the first, only in the second."""
    per = tag_union({"a": a, "b": b}, keys)
    x, y = F.col("em_a") == 1, F.col("em_b") == 1
    return per.agg(
        F.count("*").alias("chaves_uniao"),
        count_if(x & y).alias("em_ambas"),
        count_if(x & ~y).alias("apenas_primeira"),
        count_if(~x & y).alias("apenas_segunda"),
    )


def attribute_agreement(
    a: DataFrame, b: DataFrame, keys: Sequence[str], attributes: Sequence[str], pair: str = "A x B",
    null_keys: str = "unmatched",
) -> DataFrame:
    """Do two tables agree on attributes of their common keys?

    Keys with a null part have no counterpart, as ``=`` has it; with
    ``null_keys="equal"`` null is a value like any other.

    A key with several versions on a side stands for all version pairs. They
    are counted, not built: pairs are the product of the sizes, agreeing pairs
    the products per value. Each attribute is counted apart over the same
    shuffle of versions, so that no task keeps the values of all of them.
    """
    _check_null_keys(null_keys)
    if null_keys == "unmatched":
        a, b = a.where(_whole_key(keys)), b.where(_whole_key(keys))
    ids, cells = [f"k{i}" for i in range(len(keys))], [f"v{i}" for i in range(len(attributes))]
    side = lambda df, bit: df.select(
        *[F.col(k).alias(i) for i, k in zip(ids, keys)],
        *[F.coalesce(df[quoted(c)].cast("string"), F.lit("")).alias(v) for v, c in zip(cells, attributes)],
        F.lit(bit).cast("tinyint").alias("lados"),
    )
    versions = side(a, 1).unionByName(side(b, 2)).groupBy(*ids, *cells).agg(F.bit_or("lados").alias("lados"))
    na, nb = F.col("lados").bitwiseAND(F.lit(1)), F.shiftright("lados", 1)
    parts = []
    for c, v in zip(attributes, cells):
        by_value = versions.groupBy(*ids, v).agg(F.sum(na).alias("ca"), F.sum(nb).alias("cb"))
        by_key = by_value.groupBy(*ids).agg(
            F.sum("ca").alias("ta"), F.sum("cb").alias("tb"), F.sum(F.col("ca") * F.col("cb")).alias("iguais")
        )
        pairs = F.col("ta") * F.col("tb")
        # no keys, no report rows
        total = by_key.agg(F.sum(pairs).alias("em_comum"), F.sum(pairs - F.col("iguais")).alias("diverge")).where("em_comum IS NOT NULL")
        parts.append(total.select(F.lit(pair).alias("par"), F.lit(c).alias("coluna"), "em_comum", "diverge"))
    return reduce(DataFrame.unionByName, parts).orderBy("coluna")


def compare_tables(sources: Mapping[str, tuple[DataFrame, Mapping[str, Column]]]) -> DataFrame:
    """The same measures over several sources, one row each."""
    parts = [
        df.agg(F.count("*").alias("linhas"), *[m.alias(n) for n, m in metrics.items()]).select(
            F.lit(name).alias("fonte"), "linhas", *metrics
        )
        for name, (df, metrics) in sources.items()
    ]
    return reduce(DataFrame.unionByName, parts).orderBy("fonte")


def compare_bucketed(a: DataFrame, b: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """Keys of two bucketed extractions, unique on each side: on both, on one, and with different values of ``column``.

    Nulls in a key match nothing. Tables cut by the key into equally many buckets are joined as they lie.
    """
    left = a.select(*[F.col(quoted(k)).alias(f"k{i}") for i, k in enumerate(key)], F.col(quoted(column)).alias("x"), F.lit(True).alias("em_a"))
    right = b.select(*[F.col(quoted(k)).alias(f"k{i}") for i, k in enumerate(key)], F.col(quoted(column)).alias("y"), F.lit(True).alias("em_b"))
    j = left.join(right, [f"k{i}" for i in range(len(key))], "full")
    both = F.col("em_a").isNotNull() & F.col("em_b").isNotNull()
    return j.agg(
        F.count("*").alias("chaves"), count_if(both).alias("em_ambas"), count_if(F.col("em_b").isNull()).alias("so_em_a"),
        count_if(F.col("em_a").isNull()).alias("so_em_b"), count_if(both & ~F.col("x").eqNullSafe(F.col("y"))).alias("divergentes"))
