"""Declarative description of a table: keys, roles, personal columns, rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

# --- fixed values: meaning of column-name prefixes ---
PREFIX_ROLES = {
    "cod": "code", "num": "code", "nr": "code", "cd": "code",
    "vl": "measure", "qt": "measure", "pct": "measure", "pc": "measure",
    "dt": "time", "dh": "time", "hr": "time",
    "ind": "flag",
    "nm": "text", "desc": "text", "ds": "text",
    "st": "category", "tp": "category", "sg": "category",
}
# --- end of fixed values ---


def role_of(name: str, dtype: T.DataType | None = None) -> str:
    """Role given by the name prefix, else by the type."""
    role = PREFIX_ROLES.get(name.split("_", 1)[0])
    if role or dtype is None:
        return role or "other"
    if isinstance(dtype, T.BooleanType):
        return "flag"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    if isinstance(dtype, (T.DecimalType, T.FractionalType)):
        return "measure"
    return "other"


@dataclass(frozen=True)
class TableSpec:
    """What the reports need to know about one table.

    ``keys`` are candidate keys, each an ordered column list; the first one is
    the declared key. ``scenario`` narrows the table (a Column, or SQL text).
    ``roles`` overrides the prefix rule column by column.
    """

    name: str
    keys: Sequence[Sequence[str]] = ()
    scenario: Column | str | None = None
    scenario_column: str | None = None
    scenario_value: str | None = None
    roles: dict[str, str] = field(default_factory=dict)
    pii: Sequence[str] = ()
    ingest: str | None = None
    entities: dict[str, Sequence[str]] = field(default_factory=dict)
    dimensions: Sequence[str] = ()
    declared_empty: Sequence[str] = ()
    rules: dict[str, Column] = field(default_factory=dict)
    date_rules: dict[str, tuple[str, str]] = field(default_factory=dict)
    expected_rows: int | None = None
    tolerance: float = 0.005
    clustering: Sequence[str] = ()

    @property
    def key(self) -> list[str]:
        return list(self.keys[0]) if self.keys else []

    def columns(self, df: DataFrame, role: str) -> list[str]:
        """Columns of ``df`` that play ``role``, personal ones left out."""
        return [
            f.name
            for f in df.schema.fields
            if f.name not in self.pii and self.roles.get(f.name, role_of(f.name, f.dataType)) == role
        ]

    def apply(self, df: DataFrame) -> DataFrame:
        """Rows of the scenario; a plain equality stays pushable to the scan."""
        if self.scenario is not None:
            df = df.where(self.scenario)
        if self.scenario_column is not None and self.scenario_value is not None:
            df = df.where(df[self.scenario_column] == self.scenario_value)
        return df

    def with_scenario(self, column: str, value: str) -> "TableSpec":
        return replace(self, scenario_column=column, scenario_value=value)
