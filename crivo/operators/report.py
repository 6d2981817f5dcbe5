"""Consolidated summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import labels as L
from ..functions.ratios import count_if, ratio
from ._shape import join_names, stack_rows
from .keys import key_histogram, key_ids, key_sizes


def _entry(block: str, item: str, value, verdict="") -> dict:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return {"bloco": F.lit(block), "item": F.lit(item), "valor": as_col(value), "veredito": as_col(verdict)}


def summary(df: DataFrame, keys: Sequence[Sequence[str]], clustering: Sequence[str] = ()) -> DataFrame:
    """Volume and grain of a table as block / item / value / verdict.

    Everything comes from one grouping-sets pass over the candidate keys.
    """
    return summary_of(key_histogram(df, keys), keys, len(df.columns), clustering)


def summary_of(
    hist: DataFrame, keys: Sequence[Sequence[str]], columns: int, clustering: Sequence[str] = ()
) -> DataFrame:
    """``summary`` from a key histogram already at hand."""
    ids = key_ids(keys)
    rows = [
        _entry("VOLUMETRIA", "linhas na base", key_sizes(ids[0])[0].cast("string")),
        _entry("VOLUMETRIA", "colunas", str(columns)),
    ]
    if clustering:
        rows.append(_entry("VOLUMETRIA", "clustering declarado", ", ".join(clustering)))
    for key, gid in zip(keys, ids):
        n, d = key_sizes(gid)
        rows.append(_entry(
            "GRANULARIDADE", join_names(key), F.format_string("%.4f", ratio(n, d)),
            F.when(n == d, L.KEY_UNIQUE).otherwise(L.KEY_NOT_UNIQUE_SHORT),
        ))
    return stack_rows(hist, rows).orderBy("bloco", "item")


def scenario_summary(df: DataFrame, keys: Sequence[Sequence[str]], facts: Mapping[str, str]) -> DataFrame:
    """Scenario facts, grain lines and the suggested key, as block / item / value."""
    return scenario_summary_of(key_histogram(df, keys), keys, len(df.columns), facts)


def scenario_summary_of(
    hist: DataFrame, keys: Sequence[Sequence[str]], columns: int, facts: Mapping[str, str]
) -> DataFrame:
    """``scenario_summary`` from a key histogram already at hand."""
    ids = key_ids(keys)
    entry = lambda block, item, value: {
        "bloco": F.lit(block), "item": F.lit(item), "valor": F.lit(value) if isinstance(value, str) else value,
    }
    rows = [entry("CENARIO", k, v) for k, v in facts.items()]
    rows.append(entry("CENARIO", "linhas no cenario", F.format_number(key_sizes(ids[0])[0], 0)))
    rows.append(entry("CENARIO", "colunas", str(columns)))
    unique = []
    for key, gid in zip(keys, ids):
        n, d = key_sizes(gid)
        unique.append(F.when(n == d, F.lit(join_names(key))))
        rows.append(entry("GRANULARIDADE", join_names(key), F.concat(
            F.format_number(d, 0), F.lit(" distintos | "),
            F.format_string("%.4f", ratio(n, d)), F.lit(" linhas/chave | "),
            F.when(n == d, L.KEY_UNIQUE).otherwise(L.KEY_NOT_UNIQUE_SHORT),
        )))
    first = F.array_min(F.array(*unique))
    rows.append(entry("CHAVE REAL", "sugerida", F.coalesce(first, F.lit(L.KEY_NONE))))
    return stack_rows(hist, rows).orderBy("bloco", "item")


def canary_summary(df: DataFrame, key: Sequence[str], name: str, expected: int | None, scenario: str) -> DataFrame:
    """Short summary: expected and current volume, distinct and repeated keys."""
    per = df.groupBy(*key).agg(F.count("*").alias("n"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("volume_atual"),
        F.count("*").alias("chaves_distintas"),
        count_if(F.col("n") > 1).alias("chaves_repetidas"),
    ).select(
        F.lit(name).alias("objeto"), F.lit(scenario).alias("cenario"),
        F.lit(expected).cast("bigint").alias("volume_esperado"), "volume_atual",
        "chaves_distintas", "chaves_repetidas", F.lit(join_names(key)).alias("chave_observada"),
    )
