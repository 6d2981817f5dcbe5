"""States per load day, bucketed extractions, volumes from footers, numbered files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from crivo.operators import columns, coverage, history
from crivo.session import new_folder
from crivo.sources import keylist, metadata, sink

from .base import query, table

EVENT_COLS = ("event_id", "user_id", "event_type", "value")


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS coluna, count(DISTINCT CAST(ts AS DATE)) AS dias, count(*) AS linhas, count({c}) AS preenchidos, count(DISTINCT {c}) AS exatos,
        true AS distintos_proximos, {'true' if c == 'value' else 'CAST(NULL AS BOOLEAN)'} AS percentis_proximos FROM events""" for c in EVENT_COLS))
def history_states(spark, d):
    # what sketches say has no SQL twin; that it lies within three standard errors of what is exact has
    e = table(spark, d, "events")
    path, day = new_folder(spark, "estado_por_dia"), F.col("ts").cast("date")
    early = e.where(F.pmod(F.unix_date(day), F.lit(7)) < 7).where(day < F.date_sub(e.agg(F.max(day)).scalar(), 5))
    history.extend(path, early, day, EVENT_COLS, ["value"])
    found = history.merged(history.extend(path, e, day, EVENT_COLS, ["value"]))
    exact = columns.distinct_counts(e, EVENT_COLS).select("coluna", F.col("distintos").alias("exatos"))
    at = lambda i: found.where("coluna = 'value'").select(F.col("percentis")[i]).scalar()
    near = e.agg(*[(F.abs(F.avg((F.col("value") <= at(i)).cast("int")) - r) <= 0.02).alias(f"p{i}") for i, r in enumerate((0.5, 0.95))])
    return found.join(exact, "coluna").select(
        "coluna", "dias", "linhas", "preenchidos", "exatos", (F.abs(F.col("distintos") - F.col("exatos")) <= 0.05 * F.col("exatos")).alias("distintos_proximos"),
        F.when(F.col("percentis").isNotNull(), near.select(F.col("p0") & F.col("p1")).scalar()).alias("percentis_proximos"))


def bucketed_sides(spark, d):
    """Two extractions of the orders, cut by their key; the second lacks some and changes the price of others."""
    o = table(spark, d, "orders")
    urgent = o.o_orderpriority == "1-URGENT"
    run = uuid.uuid4().hex
    a = o.select(F.lpad(o.o_orderkey.cast("string"), 12, "0").alias("num"), o.o_totalprice.alias("preco"))
    b = o.where(o.o_orderpriority != "5-LOW").select(
        F.lpad(o.o_orderkey.cast("string"), 12, "0").alias("num"), (o.o_totalprice + urgent.cast("int")).alias("preco"))
    return sink.save_bucketed(a, f"extracao_a_{run}", ["num"], 8), sink.save_bucketed(b, f"extracao_b_{run}", ["num"], 8)


@query(
    """SELECT count(*) AS chaves, count(*) FILTER (WHERE o_orderpriority <> '5-LOW') AS em_ambas, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS so_em_a,
        CAST(0 AS BIGINT) AS so_em_b, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS divergentes FROM orders"""
)
def bucketed_join(spark, d):
    a, b = bucketed_sides(spark, d)
    return coverage.compare_bucketed(a, b, ["num"], "preco")


FOOTER_COLS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("SELECT '*' AS coluna, count(*) AS linhas, count(*) AS preenchidos, CAST(NULL AS VARCHAR) AS minimo, CAST(NULL AS VARCHAR) AS maximo FROM lineitem UNION ALL " + " UNION ALL ".join(
    f"SELECT '{c}', count(*), count({c}), CAST(min({c}) AS VARCHAR), CAST(max({c}) AS VARCHAR) FROM lineitem" for c in FOOTER_COLS))
def footer_volumes(spark, d):
    return metadata.footer_volumes(spark, f"{d}/lineitem.parquet", FOOTER_COLS)


@query("SELECT row_number() OVER (ORDER BY c_custkey) AS numero_linha, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS valor_original FROM customer")
def file_list(spark, d):
    """The lines of a folder of files, numbered in the order of the files."""
    path = new_folder(spark, "lista")
    c = table(spark, d, "customer")
    c.repartitionByRange(5, "c_custkey").sortWithinPartitions("c_custkey").select(F.lpad(c.c_custkey.cast("string"), 10, "0")).write.text(path)
    return keylist.read_lines(spark, path)
