"""Profile of one scenario, with totals, normalised keys and the extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import codes, columns, dates, keys, report, volume
from ..sources import metadata, sink
from ..spec import TableSpec
from .explore import _typed, column_sections, rule_sections


def scenario(df: DataFrame, spec: TableSpec, as_of: str | None = None) -> dict[str, DataFrame]:
    """Section name -> lazy report for ``spec.scenario_column = spec.scenario_value``."""
    if spec.scenario_column is None or spec.scenario_value is None:
        raise ValueError("a scenario needs scenario_column and scenario_value")
    col, value = spec.scenario_column, spec.scenario_value
    base = spec.apply(df)
    numbers = _typed(base, spec)["numbers"]
    out = {
        "metadata": metadata.describe_columns(df),
        "volume": volume.scenario_share(df, col, value),
        "filter_impact_forms": volume.filter_completeness(df, col, value),
        "gate": volume.scenario_gate(base, col),
    }
    if spec.keys:
        out["grain"] = keys.grain(base, spec.keys)
        out["duplicate_keys"] = keys.duplicate_keys(base, spec.key, 30)
        out["versions"] = keys.pure_vs_version(base, spec.key)
        safe = [c for c in base.columns if c not in spec.pii]
        out["varying_columns"] = keys.varying_columns(base, spec.key, safe)
    out["fill"] = columns.fill_scan(base)
    out["cardinality"] = columns.cardinality(base)
    out |= column_sections(base, spec, as_of)
    if numbers:
        out["totals"] = columns.totals(base, numbers)
    if spec.keys:
        out["normalized_keys"] = codes.normalized_keys(base, spec.key)
    out["checksum"] = keys.row_checksum(base)
    out["sample"] = sink.extract(base, pii=spec.pii).limit(20)
    for d in spec.dimensions:
        out[f"distribution_{d}"] = columns.distribution(base, [d])
    if spec.ingest:
        out["freshness"] = dates.freshness(base, [spec.ingest], as_of)
    out |= rule_sections(base, spec)
    out["extraction"] = sink.extract(base, order=spec.key, pii=spec.pii)
    if spec.keys:
        facts = {"tabela": spec.name, "filtro": f"{col} = {value}"}
        out["summary"] = report.scenario_summary(base, spec.keys, facts)
    return out
