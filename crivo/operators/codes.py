"""Codes: length, leading zeros, collisions, numeric text, normalised keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import labels as L
from ..functions import missing as M
from ..functions import normalize as N
from ..functions.ratios import count_if
from ._shape import quoted, stack_rows, type_name, value_counts

# --- fixed values: number-as-text formats ---
NUMBER_DOT = "^-?[0-9]+([.][0-9]+)?$"
NUMBER_COMMA = "^-?[0-9.]+,[0-9]+$"
# --- end of fixed values ---


def _weighted(p: Column) -> Column:
    """Rows whose value satisfies ``p``, counted from value frequencies."""
    return F.sum(F.when(p, F.col("linhas")).otherwise(0))


def code_format(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Blank, length range, leading zeros, spaces and collisions of code columns."""
    return code_format_of(value_counts(df, columns), {c: type_name(df, c) for c in columns})


def code_format_of(freq: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """``code_format`` from value frequencies already at hand."""
    v = F.col("valor")
    t = F.trim(v)
    per = freq.groupBy("coluna").agg(
        _weighted(M.no_value(v)).alias("vazios"),
        F.min(F.length(t)).alias("len_min"),
        F.max(F.length(t)).alias("len_max"),
        _weighted(N.has_leading_zero(v)).alias("com_zeros_esq"),
        _weighted(N.has_outer_space(v)).alias("com_espacos"),
        F.countDistinct(t).alias("distintos_bruto"),
        F.countDistinct(N.strip_zeros(v)).alias("distintos_sem_zeros"),
    )
    names = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    out = per.withColumn("tipo", names[F.col("coluna")]).withColumn(
        "colisoes_ao_remover_zeros", F.col("distintos_bruto") - F.col("distintos_sem_zeros")
    )
    alerts = F.concat_ws(
        " | ",
        F.when(F.col("com_zeros_esq") > 0, L.ALERT_LEADING_ZEROS),
        F.when(F.col("len_min") != F.col("len_max"), L.ALERT_VARIABLE_LENGTH),
        F.when(F.col("com_espacos") > 0, L.ALERT_SPACES),
        F.when(F.col("colisoes_ao_remover_zeros") > 0, L.ALERT_COLLISION),
        F.when(F.col("tipo").contains("int"), L.ALERT_NUMERIC_TYPE),
    )
    return out.select(
        "coluna", "tipo", "vazios", "len_min", "len_max", "com_zeros_esq", "com_espacos",
        "distintos_bruto", "distintos_sem_zeros", "colisoes_ao_remover_zeros", alerts.alias("alertas"),
    ).orderBy("coluna")


def numeric_code_format(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Collisions among the purely numeric codes, last digit always kept."""
    freq = value_counts(df, columns)
    v = F.col("valor")
    t = F.trim(v)
    numeric = N.is_digits(v)
    per = freq.groupBy("coluna").agg(
        F.sum("linhas").alias("linhas"),
        F.min(F.length(t)).alias("tamanho_min"),
        F.max(F.length(t)).alias("tamanho_max"),
        _weighted(t.rlike("^0+[0-9]+$")).alias("com_zeros_a_esquerda"),
        F.countDistinct(F.when(numeric, t)).alias("codigos_numericos_distintos"),
        F.countDistinct(F.when(numeric, N.strip_zeros(v, "keep_last"))).alias("codigos_normalizados_distintos"),
    )
    return per.withColumn(
        "colisoes_potenciais",
        F.col("codigos_numericos_distintos") - F.col("codigos_normalizados_distintos"),
    ).orderBy("coluna")


def cast_loss(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """What a cast of the code to a number would lose."""
    freq = value_counts(df, columns)
    v = F.col("valor")
    return (
        freq.groupBy("coluna")
        .agg(
            _weighted(N.has_leading_zero(v)).alias("com_zeros_esq"),
            _weighted(v.isNotNull() & ~N.is_digits(v)).alias("nao_numerico"),
            F.countDistinct(F.trim(v)).alias("distintos_string"),
            F.countDistinct(N.strip_zeros(v)).alias("distintos_sem_zeros"),
        )
        .orderBy("coluna")
    )


def code_length(df: DataFrame, column: str, blanks: bool = False) -> DataFrame:
    """Rows and distinct values per code length."""
    t = N.text(df[quoted(column)])
    freq = df.groupBy(df[quoted(column)].alias("valor"), F.length(t).alias("comprimento")).agg(F.count("*").alias("n"))
    if not blanks:
        freq = freq.where(F.col("comprimento") > 0)
    return (
        freq.groupBy("comprimento")
        .agg(F.sum("n").alias("linhas"), F.count("valor").alias("valores_distintos"))
        .orderBy("comprimento")
    )


def literal_lengths(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Every literal as stored, its length and its rows."""
    c = df[quoted(column)].cast("string")
    out = (
        df.groupBy(c.alias("valor"))
        .agg(F.count("*").alias("linhas"))
        .withColumn("tamanho", F.length("valor"))
        .orderBy(F.desc("linhas"), "valor")
    )
    return out if k is None else out.limit(k)


def normalized_keys(
    df: DataFrame, columns: Sequence[str], mode: str = "all", flags: Mapping[str, Column] | None = None
) -> DataFrame:
    """Distinct keys without leading zeros, ready to join with another system.

    ``flags`` adds ``'S'``/``'N'`` columns, for example whether the row would
    also show in the narrower scope of a screen.
    """
    keys = [N.strip_zeros(df[quoted(c)], mode).alias(f"{c}_norm") for c in columns]
    marks = [F.when(p, "S").otherwise("N").alias(n) for n, p in (flags or {}).items()]
    return df.select(*keys, *marks).distinct()


def numeric_string_format(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numbers kept as text: blank, decimal point, decimal comma, anything else."""
    rows = []
    for c in columns:
        t = F.trim(df[quoted(c)])
        kind = F.when(M.no_value(df[quoted(c)]), 0).when(t.rlike(NUMBER_DOT), 1).when(t.rlike(NUMBER_COMMA), 2).otherwise(3)
        rows.append((c, kind))
    kinds = df.select(*[k.alias(f"k{i}") for i, (_, k) in enumerate(rows)])
    return stack_rows(kinds, [
        {
            "coluna": F.lit(c),
            "vazios": count_if(F.col(f"k{i}") == 0),
            "numerico_ponto": count_if(F.col(f"k{i}") == 1),
            "numerico_virgula": count_if(F.col(f"k{i}") == 2),
            "outros": count_if(F.col(f"k{i}") == 3),
        }
        for i, (c, _) in enumerate(rows)
    ]).orderBy("coluna")
