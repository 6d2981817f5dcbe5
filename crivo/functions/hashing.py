"""Row fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import quoted


def row_hash(cols: Sequence[str], mode: str = "json") -> Column:
    """Fingerprint of a whole row.

    ``json``   md5 of the row as JSON with its nulls: null and ``''`` differ
    ``concat`` md5 of the joined texts: null and ``''`` are the same
    ``sha256`` sha-256 of the joined texts with a visible null
    """
    if mode == "json":
        return F.md5(F.to_json(F.struct(*[F.col(quoted(c)) for c in cols]), {"ignoreNullFields": "false"}))
    if mode == "concat":
        return F.md5(F.concat_ws("|", *[F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")) for c in cols]))
    if mode == "sha256":
        parts = [F.coalesce(F.col(quoted(c)).cast("string"), F.lit("<NULL>")) for c in cols]
        return F.sha2(F.concat_ws("§", *parts), 256)
    raise ValueError(f"unknown hash mode {mode!r}")


def fingerprint(df: DataFrame, cols: Sequence[str], mode: str = "pair") -> Column:
    """Fingerprint for counting equal rows; the other modes are those of ``row_hash``.

    ``pair`` is two independent 64-bit hashes over the typed values. It tells
    rows apart as ``json`` does, without formatting every cell as text, and it
    shuffles 16 bytes. A null flag goes in beside each value, since a hash skips
    nulls; nested values enter as JSON for the same reason.
    """
    if mode != "pair":
        return row_hash(cols, mode)
    nested = (T.ArrayType, T.StructType, T.MapType)
    parts: list[Column] = []
    for c in cols:
        x = df[quoted(c)]
        if isinstance(df.schema[c].dataType, nested):
            x = F.to_json(F.struct(x), {"ignoreNullFields": "false"})
        parts += [df[quoted(c)].isNull(), x]
    return F.struct(*[F.xxhash64(F.lit(seed), *parts).alias(f"h{seed}") for seed in (1, 2)])
