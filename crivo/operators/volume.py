"""Volumes, scenarios, filters and searches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import labels as L
from ..functions import missing as M
from ..functions import normalize as N
from ..functions.ratios import count_if, pct
from ._shape import Section, hashed_counts, private_names, quoted, stack_rows, total_of


def volumetry(df: DataFrame, entities: Mapping[str, Sequence[str] | str]) -> DataFrame:
    """Rows and distinct values of each entity; an entity may span columns.

    A null is no value, but a tuple with a null part counts. Each entity is made
    distinct in a pass over its own columns, so a task keeps the values of one
    entity and not those of all.
    """
    parts = []
    for i, cols in enumerate(entities.values()):
        one = isinstance(cols, str)
        values = df.select(*[df[c].alias(f"c{j}") for j, c in enumerate([cols] if one else cols)])
        if i == 0:  # its groups tell the rows too
            groups = values.groupBy(*values.columns).agg(F.count("*").alias("n"))
            sizes = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("linhas"), (F.count("c0") if one else F.count("*")).alias("valores"))
            parts.append(sizes.select(F.inline(F.array(*[F.struct(F.lit(k).alias("i"), F.col(c).alias("n")) for k, c in ((-1, "linhas"), (0, "valores"))]))))
        else:
            distinct = (values.where("c0 IS NOT NULL") if one else values).distinct()
            parts.append(distinct.agg(F.count("*").alias("n")).select(F.lit(i).alias("i"), "n"))
    if not parts:
        parts = [df.agg(F.count("*").alias("n")).select(F.lit(-1).alias("i"), "n")]
    size = lambda i: F.max(F.when(F.col("i") == i, F.col("n")))
    return reduce(DataFrame.unionByName, parts).agg(
        size(-1).alias("linhas"), *[size(i).alias(name) for i, name in enumerate(entities)])


def scenario_share(df: DataFrame, column: str, value) -> DataFrame:
    """Rows of a scenario against the table, and how many values the filter has.

    The table is reduced to its distinct filter values before anything else.
    """
    return scenario_share_of(df.groupBy(df[quoted(column)].alias("v")).agg(F.count("*").alias("n")), value)


def scenario_share_of(per: DataFrame, value) -> DataFrame:
    """``scenario_share`` from the rows ``n`` per value ``v`` already at hand."""
    total, mine = F.sum("n"), F.coalesce(F.sum(F.when(F.col("v") == value, F.col("n"))), F.lit(0))
    return per.agg(
        total.alias("linhas_tabela_toda"), mine.alias("linhas_cenario"),
        pct(mine, total, 4).alias("pct_do_total"), F.count("v").alias("valores_na_tabela"),
    )


def scenario_candidates(
    df: DataFrame, column: str, low: int = 10_000, high: int = 300_000,
    entity: str | None = None, k: int | None = None,
) -> DataFrame:
    """Rows and share per value; sizes in the preferred band are candidates.

    ``k`` keeps the largest candidates and drops the values that are none.
    """
    key = M.display_bucket(df[quoted(column)]).alias(column)
    aggs = [F.count("*").alias("linhas")]
    if entity is not None:
        aggs.append(F.countDistinct(entity).alias("entidades"))
    return scenario_candidates_of(df.groupBy(key).agg(*aggs), column, low, high, k)


def scenario_candidates_of(
    groups: DataFrame, column: str, low: int = 10_000, high: int = 300_000, k: int | None = None
) -> DataFrame:
    """``scenario_candidates`` from the rows per value already at hand."""
    n = F.col("linhas")
    out = (
        groups.withColumn("pct", pct(n, total_of(groups)))
        .withColumn("sugestao", F.when(n.between(low, high), L.SCENARIO_CANDIDATE).otherwise(""))
        .orderBy(F.desc("linhas"), quoted(column))
    )
    return out if k is None else out.where(n.between(low, high)).limit(k)


def known_scenarios(df: DataFrame, column: str, values: Sequence[str], zeros: bool = False) -> DataFrame:
    """Literal form, length and rows of the values other checks already use."""
    t = N.text(df[quoted(column)])
    wanted = N.strip_zeros(df[quoted(column)]).isin(*values) if zeros else t.isin(*values)
    return (
        df.where(wanted)
        .groupBy(df[quoted(column)].cast("string").alias("literal"))
        .agg(F.count("*").alias("linhas"))
        .withColumn("tamanho", F.length(F.trim("literal")))
        .orderBy("literal")
    )


def scenario_gate(df: DataFrame, column: str) -> DataFrame:
    """Control of a scenario: it must hold exactly one value of the filter column."""
    return scenario_gate_of(df.groupBy(df[quoted(column)].alias("v")).agg(F.count("*").alias("n")))


def scenario_gate_of(per: DataFrame) -> DataFrame:
    """``scenario_gate`` from the rows ``n`` per value ``v`` already at hand."""
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_linhas_cenario"),
        F.count("v").alias("valores_distintos"),
        F.min("v").alias("valor_minimo"),
        F.max("v").alias("valor_maximo"),
    )


def filter_completeness(df: DataFrame, column: str, value: str) -> DataFrame:
    """Forms of the filter value; more than one row means `=` loses rows."""
    return filter_completeness_of(df.groupBy(df[quoted(column)].alias("v")).agg(F.count("*").alias("n")), value)


def filter_completeness_of(per: DataFrame, value: str) -> DataFrame:
    """``filter_completeness`` from the rows ``n`` per value ``v`` already at hand."""
    c = F.col("v").cast("string")
    return (
        per.where((N.strip_zeros(F.col("v")) == value) | (F.trim(c) == value))
        .groupBy(c.alias("valor_bruto"))
        .agg(F.sum("n").alias("linhas"))
        .withColumn("comprimento", F.length("valor_bruto"))
        .orderBy(F.desc("linhas"), "valor_bruto")
    )


def filter_column_discovery(df: DataFrame, column: str, value: str, k: int | None = None) -> DataFrame:
    """Values of a column related to ``value``: equal, prefixed, or containing it."""
    t = N.text(df[quoted(column)])
    kind = F.when(t == value, "exato").when(t.startswith(value), "prefixo").otherwise("contem")
    out = (
        df.where(t.contains(value))
        .groupBy(df[quoted(column)].cast("string").alias("valor"), kind.alias("relacao"))
        .agg(F.count("*").alias("linhas"))
        .withColumn("comprimento", F.length("valor"))
        .orderBy(F.desc("linhas"), "valor")
    )
    return out if k is None else out.limit(k)


def value_search(df: DataFrame, value: str, columns: Sequence[str] | None = None) -> DataFrame:
    """In which text columns does a value occur: exact, zero-padded or partial."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    # 0 exact, 1 zero-padded, 2 partial, null no hit: one test per cell
    kinds, rows = [], []
    for c, name in zip(columns, private_names(df, *[f"acerto_{i}" for i in range(len(columns))])):
        t, k = F.trim(df[c]), F.col(name)
        hit = F.when(t == value, 0).when(N.strip_zeros(df[c]) == value, 1).otherwise(2)
        kinds.append(F.when(df[c].contains(value), hit).alias(name))
        rows.append({
            "coluna": F.lit(c),
            "correspondencias_exatas": count_if(k == 0),
            "correspondencias_com_zeros_esquerda": count_if(k == 1),
            "correspondencias_parciais": count_if(k == 2),
            "exemplo": F.min(F.when(k.isNotNull(), df[c])),
        })
    return stack_rows(df.select("*", *kinds), rows).where(F.col("exemplo").isNotNull()).orderBy("coluna")


def funnel(
    df: DataFrame,
    steps: Mapping[str, Column],
    entity: str,
    reference: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Rows and entities left after each cumulative filter, in one pass.

    Entities are counted after the table is reduced to one row per entity, with
    the rows it has at every step.
    """
    conds: dict[str, Column] = {}
    acc = F.lit(True)
    for name, p in steps.items():
        acc = acc & F.coalesce(p, F.lit(False))
        conds[name] = acc
    for name, p in (reference or {}).items():
        conds[name] = F.coalesce(p, F.lit(False))
    per = df.groupBy(df[entity].alias("entidade")).agg(
        *[count_if(p).alias(f"n{i}") for i, p in enumerate(conds.values())]
    )
    return stack_rows(per, [
        {
            "etapa": F.lit(name),
            "linhas": F.coalesce(F.sum(f"n{i}"), F.lit(0)),
            "entidades": count_if((F.col(f"n{i}") > 0) & F.col("entidade").isNotNull()),
        }
        for i, name in enumerate(conds)
    ]).orderBy("etapa")


def volume_check(df: DataFrame, expected: int) -> DataFrame:
    """Current rows against the volume measured earlier."""
    return volume_check_section(expected).report(df)


def volume_check_section(expected: int) -> Section:
    rows = [{"linhas_atuais": F.count("*"), "linhas_esperadas": F.lit(expected).cast("bigint")}]
    return Section(rows, lambda out: out.withColumn("diferenca", F.col("linhas_atuais") - F.col("linhas_esperadas")))


def group_metrics(
    df: DataFrame, by: Sequence[str | Column], metrics: Mapping[str, Column], k: int | None = None
) -> DataFrame:
    """Any set of aggregates per group, next to the row count."""
    out = df.groupBy(*by).agg(F.count("*").alias("linhas"), *[a.alias(n) for n, a in metrics.items()])
    keys = [c for c in out.columns if c != "linhas" and c not in metrics]
    out = out.orderBy(F.desc("linhas"), *keys)
    return out if k is None else out.limit(k)


def blank_by_group(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows without a value per group and column (completeness by plant)."""
    return group_metrics(df, by, {f"{c}_nulo": count_if(M.no_value(df[c])) for c in columns})


def distinct_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact distinct count per column, as rows."""
    return hashed_counts(df, columns).groupBy("coluna").agg(F.count("h1").alias("distintos")).orderBy("coluna")
