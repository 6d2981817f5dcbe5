"""Table metadata: columns, files, write history, definitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators._shape import quoted
from ..spec import role_of


def describe_columns(df: DataFrame) -> DataFrame:
    """Position, name, type, nullability and role of each column."""
    spark = df.sparkSession
    rows = [
        (i + 1, f.name, f.dataType.simpleString(), f.nullable, role_of(f.name, f.dataType),
         (f.metadata or {}).get("comment"))
        for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(
        rows, "posicao int, coluna string, tipo string, aceita_nulo boolean, papel string, comentario string"
    )


def column_count(df: DataFrame, name: str = "tabela") -> DataFrame:
    """Number of columns as a one-row frame; partition markers do not count."""
    n = len([c for c in df.columns if not c.startswith("#")])
    return df.sparkSession.range(1).select(F.lit(name).alias("objeto"), F.lit(n).cast("bigint").alias("colunas"))


def describe_extended(spark: SparkSession, table: str) -> DataFrame:
    return spark.sql("DESCRIBE TABLE EXTENDED IDENTIFIER(:t)", args={"t": table})


def show_create(spark: SparkSession, table: str) -> DataFrame:
    """Definition text of a table or view, as the catalog keeps it."""
    return spark.sql("SHOW CREATE TABLE IDENTIFIER(:t)", args={"t": table})


def describe_detail(df: DataFrame) -> DataFrame:
    """Files, bytes and modification range behind a file-based DataFrame.

    The file list is metadata of the scan; rows are only counted per file.
    """
    files = df.groupBy(
        F.col("_metadata.file_path").alias("arquivo"),
        F.col("_metadata.file_size").alias("bytes"),
        F.col("_metadata.file_modification_time").alias("modificado_em"),
    ).agg(F.count("*").alias("linhas"))
    return files.agg(
        F.count("*").alias("arquivos"), F.sum("bytes").alias("bytes"), F.sum("linhas").alias("linhas"),
        F.min("modificado_em").alias("primeira_gravacao"), F.max("modificado_em").alias("ultima_gravacao"),
    )


#: Settings under which Spark answers counts and extremes of unfiltered Parquet files from their footers.
FOOTERS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


def footer_volumes(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    """(coluna, linhas, preenchidos, minimo, maximo) of whole Parquet files, from their footers: no data page is read.

    ``columns`` are numbers, dates and booleans, for which footers hold exact extremes; an empty list gives the rows
    alone, under the column ``*``. The answer is worked out at once, as the settings it needs are put back after it.
    """
    before = {k: spark.conf.get(k, None) for k in FOOTERS}
    try:
        for k, v in FOOTERS.items():
            spark.conf.set(k, v)
        row = footer_query(spark, path, columns).first()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    rows = [("*", row["n"], row["n"], None, None)]
    for i, c in enumerate(columns):
        low, high = (None if row[f"{x}{i}"] is None else str(row[f"{x}{i}"]) for x in ("a", "b"))
        rows.append((c, row["n"], row[f"n{i}"], low, high))
    return spark.createDataFrame(rows, "coluna string, linhas bigint, preenchidos bigint, minimo string, maximo string")


def footer_query(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The aggregate that ``footer_volumes`` asks for."""
    aggs = [F.count("*").alias("n")]
    for i, c in enumerate(columns):
        aggs += [F.count(quoted(c)).alias(f"n{i}"), F.min(quoted(c)).alias(f"a{i}"), F.max(quoted(c)).alias(f"b{i}")]
    return spark.read.parquet(path).agg(*aggs)


def write_history(df: DataFrame, n: int = 20) -> DataFrame:
    """Latest writes seen through the file times; the freshness fallback."""
    return (
        df.groupBy(F.col("_metadata.file_modification_time").alias("modificado_em"))
        .agg(F.countDistinct("_metadata.file_path").alias("arquivos"), F.count("*").alias("linhas"))
        .orderBy(F.desc("modificado_em"))
        .limit(n)
    )
