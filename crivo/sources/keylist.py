"""Key lists from another system: pasted text or text files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normalize as N


def split_lines(df: DataFrame, text: str, ids: Sequence[str] = ()) -> DataFrame:
    """(ids…, numero_linha, valor_original): the lines of each text, numbered from 1."""
    lines = F.split(F.regexp_replace(df[text], "\r", ""), "\n")
    return df.select(*ids, F.posexplode(lines).alias("pos", "linha")).select(
        *ids, (F.col("pos") + 1).cast("bigint").alias("numero_linha"), F.trim("linha").alias("valor_original")
    )


def parse_text(spark: SparkSession, text: str) -> DataFrame:
    """Lines of one pasted text."""
    return split_lines(spark.range(1).select(F.lit(text).alias("texto")), "texto")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file, or of the files of a folder in the order of their names, numbered from 1 over all of them.

    Each block of a file is read in order by one task, which numbers its lines; only the line counts per block are
    summed up, in the order of file and block start. Tasks take blocks by size, so their own numbers follow no file.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("arquivo"), F.col("_metadata.file_block_start").alias("bloco"),
        F.monotonically_increasing_id().alias("n"), "value")
    # one row per block of the scan
    sizes = raw.groupBy("arquivo", "bloco").agg(F.min("n").alias("primeira"), F.count("*").alias("linhas"))
    before = Window.orderBy("arquivo", "bloco").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("arquivo", "bloco", "primeira", F.coalesce(F.sum("linhas").over(before), F.lit(0)).alias("antes"))
    return raw.join(offsets, ["arquivo", "bloco"]).select(
        (F.col("n") - F.col("primeira") + F.col("antes") + 1).alias("numero_linha"),
        F.trim(F.regexp_replace("value", "\r", "")).alias("valor_original"),
    )


def _candidate(headers: Sequence[str]) -> Column:
    v = F.col("valor_original")
    return v.isNotNull() & (v != "") & ~F.lower(v).isin(*headers)


def accepted_keys(lines: DataFrame, headers: Sequence[str] = ("chave",)) -> DataFrame:
    """Distinct valid keys: as written, and normalised."""
    v = F.col("valor_original")
    good = lines.where(_candidate(headers) & v.rlike(N.LIST_KEY))
    return good.select(v.alias("chave_original"), N.strip_zeros(v, "list").alias("chave")).distinct()


def rejected_lines(lines: DataFrame, headers: Sequence[str] = ("chave",)) -> DataFrame:
    """Lines that are neither blank, nor a header, nor a key."""
    v = F.col("valor_original")
    return lines.where(_candidate(headers) & ~v.rlike(N.LIST_KEY))


def input_control(lines: DataFrame, headers: Sequence[str] = ("chave",)) -> DataFrame:
    """Lines read, distinct valid keys and rejected lines.

    Lines are reduced to their distinct texts before they are judged.
    """
    v = F.col("valor_original")
    freq = lines.groupBy("valor_original").agg(F.count("*").alias("n"))
    key = v.rlike(N.LIST_KEY)
    return freq.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("linhas_lidas"),
        F.count_if(_candidate(headers) & key).alias("chaves_validas_distintas"),
        F.coalesce(F.sum(F.when(_candidate(headers) & ~key, F.col("n"))), F.lit(0)).alias("linhas_rejeitadas"),
    )
