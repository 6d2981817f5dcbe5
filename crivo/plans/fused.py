"""The exploratory profile from shared passes.

The lazy profiles read the table once per section. On a very large table that adds
up, so here the planner makes each pass that sections have in common once: aggregates
(a pass for each batch of report rows), value frequencies, the key histogram, the
version histogram, what varies inside repeated keys and these keys, and the counts
of personal columns.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from ..spec import TableSpec
from .planner import explore_profile


def fused(
    df: DataFrame,
    spec: TableSpec,
    params: Mapping[str, object | None] | None = None,
    work_dir: str | None = None,
    as_of: str | None = None,
) -> dict[str, DataFrame]:
    """Section name -> report. The shared passes run here; reports read their results."""
    return explore_profile(df, spec, params, as_of).run(work_dir)
