"""Short profile with personal columns masked and an expected volume."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import codes, columns, dates, keys, report, volume
from ..sources import metadata, sink
from ..spec import TableSpec
from .explore import _typed, rule_sections


def canary(df: DataFrame, spec: TableSpec, as_of: str | None = None) -> dict[str, DataFrame]:
    """Section name -> lazy report."""
    base = spec.apply(df)
    c = _typed(base, spec)
    out = {"metadata": metadata.describe_columns(base)}
    if spec.entities:
        out["volume"] = volume.volumetry(base, spec.entities)
    if spec.expected_rows is not None:
        out["volume_check"] = volume.volume_check(base, spec.expected_rows)
    for d in spec.dimensions:
        out[f"distribution_{d}"] = volume.scenario_candidates(base, d)
    if spec.keys:
        out["grain"] = keys.grain(base, spec.keys)
        out["versions"] = keys.repeated_versions(base, spec.key)
        safe = [x for x in base.columns if x not in spec.pii]
        out["varying_columns"] = keys.varying_columns(base, spec.key, safe)
    out["fill"] = columns.fill_scan(base, mode="f3")
    named = [*c["codes"], *c["categories"]]
    if named:
        out["cardinality"] = columns.cardinality(base, named, exact=True, mode="f3")
    if c["categories"]:
        out["domain"] = columns.domain(base, c["categories"])
        out["indicators"] = columns.string_flag_domain(base, c["categories"])
    if c["numbers"]:
        out["numeric_profile"] = columns.numeric_profile(base, c["numbers"])
        out["totals"] = columns.totals(base, c["numbers"])
    if c["text_dates"]:
        out["string_dates"] = dates.string_date_profile(base, c["text_dates"])
    text_codes = [x for x in c["codes"] if dict(base.dtypes)[x] == "string"]
    if text_codes:
        out["codes"] = codes.numeric_code_format(base, text_codes)
    out["checksum"] = keys.row_checksum(base)
    out["sample"] = sink.extract(base, pii=spec.pii).limit(20)
    out["wide_sample"] = sink.extract(base, pii=spec.pii).limit(500)
    if spec.ingest:
        out["freshness"] = dates.freshness(base, [spec.ingest], as_of)
    out |= rule_sections(base, spec)
    if spec.keys:
        out["summary"] = report.canary_summary(
            base, spec.key, spec.name, spec.expected_rows, spec.scenario_value or ""
        )
    return out
