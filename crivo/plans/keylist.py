"""Validation of a key list from another system against a table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import quoted
from ..operators import columns, coverage, keys, rules
from ..session import stored
from ..sources import keylist, sink


#: Codes of a list that Spark may still broadcast.
BROADCAST_CODES = 300_000


def key_list_profile(lines: DataFrame, df: DataFrame, column: str, headers: Sequence[str] = ("chave",), **options) -> dict[str, DataFrame]:
    """``validate_key_list`` over two stored passes: the parsed lines, and the rows of the table that the list asks for.

    A few tasks may have parsed a long list; its lines are dealt out, so that later passes read them in many.
    """
    kept = stored(lines.repartition(*map(quoted, lines.columns)), "linhas_da_lista")
    many = keylist.accepted_keys(kept, headers).select("chave").distinct().count() > BROADCAST_CODES
    return validate_key_list(kept, df, column, headers=headers, many=many, keep=lambda found: stored(found, "encontradas"), **options)


def validate_key_list(
    lines: DataFrame,
    df: DataFrame,
    column: str,
    items: str | None = None,
    latest: Mapping[str, str] | None = None,
    headers: Sequence[str] = ("chave",),
    pii: Sequence[str] = (),
    keep: Callable[[DataFrame], DataFrame] = lambda found: found,
    many: bool = False,
) -> dict[str, DataFrame]:
    """Section name -> lazy report, from the raw lines of the list to the exports."""
    accepted = keylist.accepted_keys(lines, headers)
    found = keep(coverage.restrict_to_list(df, accepted, column, many=many))
    missing = coverage.missing_keys(accepted, df, column)
    out = {
        "input_control": keylist.input_control(lines, headers),
        "rejected_lines": keylist.rejected_lines(lines, headers),
        "coverage": coverage.coverage(accepted, df, column),
        "missing": missing,
        "missing_challenged": coverage.challenge_missing(missing, "chave_original", df, column),
        "repeated_keys": keys.duplicate_keys(found, [column], None),
        "fill": columns.fill_scan(found, df.columns, mode="simple"),
        "extraction": sink.extract(found, columns=df.columns, pii=pii, order=[column] if column not in pii else ()),
    }
    if items is not None:
        out["flattening"] = rules.flattening_loss(found, items)
        out["summary"] = coverage.coverage_summary(accepted, df, column, items, latest or {})
    if latest:
        out["latest_load"] = found.agg(*[F.max(c).alias(n) for n, c in latest.items()])
    return out
