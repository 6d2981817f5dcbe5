"""Exploratory profile of a table or a filtered base."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from ..operators import codes, columns, dates, keys, report, rules, volume
from ..sources import metadata, scan, sink
from ..spec import TableSpec


def _typed(df: DataFrame, spec: TableSpec) -> dict[str, list[str]]:
    types = dict(df.dtypes)
    times = spec.columns(df, "time")
    return {
        "codes": [c for c in spec.columns(df, "code") if types[c] in ("string", "int", "bigint")],
        "categories": spec.columns(df, "category") + [c for c in spec.columns(df, "flag") if types[c] == "string"],
        "flags": [c for c in df.columns if types[c] == "boolean"],
        "numbers": [c for c in spec.columns(df, "measure") if types[c] != "string"],
        "text_dates": [c for c in times if types[c] == "string" and not c.startswith("hr_")],
        "text_times": [c for c in times if types[c] == "string" and c.startswith("hr_")],
        "native_dates": [c for c in times if types[c] == "date"],
        "stamps": [c for c in times if types[c].startswith("timestamp")],
    }


def column_sections(df: DataFrame, spec: TableSpec, as_of: str | None = None) -> dict[str, DataFrame]:
    """The sections that depend on column roles only."""
    c = _typed(df, spec)
    out: dict[str, DataFrame] = {}
    if c["categories"]:
        out["domain"] = columns.domain(df, c["categories"])
    if c["flags"]:
        out["flags"] = columns.flag_profile(df, c["flags"])
    if c["numbers"]:
        out["numeric_profile"] = columns.numeric_profile(df, c["numbers"])
    if c["text_dates"]:
        out["string_dates"] = dates.string_date_profile(df, c["text_dates"])
        out["valid_date_range"] = dates.valid_date_range(df, c["text_dates"])
    if c["text_times"]:
        out["times"] = dates.time_profile(df, c["text_times"])
    if c["native_dates"]:
        out["native_dates"] = dates.native_date_profile(df, c["native_dates"], as_of)
    if c["stamps"]:
        out["timestamps"] = dates.timestamp_profile(df, c["stamps"])
    if c["codes"]:
        out["codes"] = codes.code_format(df, c["codes"])
    return out


def rule_sections(df: DataFrame, spec: TableSpec) -> dict[str, DataFrame]:
    """Sections from the declared rules, each kind in one pass."""
    out: dict[str, DataFrame] = {}
    if spec.declared_empty:
        out["declared_empty"] = columns.declared_empty(df, spec.declared_empty)
    if spec.rules:
        out["rules"] = rules.rule_counts(df, spec.rules)
    if spec.date_rules:
        out["date_order"] = dates.date_order(df, spec.date_rules)
    if spec.pii:
        out["pii"] = rules.pii_aggregate(df, spec.pii)
    return out


def explore(
    df: DataFrame, spec: TableSpec, params: Mapping[str, object | None] | None = None, as_of: str | None = None
) -> dict[str, DataFrame]:
    """Section name -> lazy report. Nothing runs until a report is read or written."""
    base = scan.base_view(spec.apply(df), params or {})
    out = {"metadata": metadata.describe_columns(base)}
    if spec.keys:
        out["grain"] = keys.grain(base, spec.keys)
        out["duplicates"] = keys.duplicate_summary(base, spec.keys)
    out["fill"] = columns.fill_scan(base)
    out["cardinality"] = columns.cardinality(base)
    out |= column_sections(base, spec, as_of)
    out["sample"] = sink.extract(base, pii=spec.pii).limit(20)
    out["random_sample"] = scan.sample_random(sink.extract(base, pii=spec.pii))
    for d in spec.dimensions:
        out[f"distribution_{d}"] = volume.scenario_candidates(base, d)
    if spec.keys:
        out["duplicate_keys"] = keys.duplicate_keys(base, spec.key)
        safe = [c for c in base.columns if c not in spec.pii]
        out["varying_columns"] = keys.varying_columns(base, spec.key, safe)
    if spec.ingest:
        out["freshness"] = dates.freshness(base, [spec.ingest], as_of)
        out["snapshot"] = dates.snapshot_or_history(base, spec.ingest)
    out |= rule_sections(base, spec)
    if spec.keys:
        out["summary"] = report.summary(base, spec.keys, spec.clustering)
    return out
