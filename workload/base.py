"""Registry, table access and the derived views the queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crivo.sources import scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, views: tuple[str, ...] = (), name: str | None = None):
    """Registers a query under its function name, with the SQL that must agree."""

    def add(fn):
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key!r} registered twice")
        QUERIES[key] = fn
        if sql is not None:
            ctes = ", ".join(f"{v} AS ({VIEW_SQL[v]})" for v in views)
            ORACLE[key] = f"WITH {ctes} {_continue(sql)}" if ctes else sql.strip()
        return fn

    return add


def _continue(sql: str) -> str:
    body = sql.strip()
    return ", " + body[len("WITH "):] if body.upper().startswith("WITH ") else body


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return scan.read_table(spark, f"{sf_dir}/{name}.parquet", "parquet")


# --- SQL helpers ----------------------------------------------------------


def pct_sql(n: str, d: str, places: int = 2) -> str:
    """Percentage of two counts, rounded half-up on integers."""
    return ratio_sql(f"100 * ({n})", d, places)


def ratio_sql(n: str, d: str, places: int = 4) -> str:
    scale = 10**places
    num, den = f"CAST({n} AS HUGEINT)", f"CAST({d} AS HUGEINT)"
    return f"(CAST((2 * {scale} * {num} + {den}) // (2 * nullif({den}, 0)) AS DOUBLE) / {scale})"


# --- derived views ----------------------------------------------------------
# Codes, text dates and blanks of the kind the profiled tables hold, derived
# from the supplied tables.

VIEW_SQL = {
    "itens": """
        SELECT lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS num_pedido,
               lpad(CAST(l_linenumber AS VARCHAR), 5, '0') AS num_item,
               lpad(CAST(l_partkey AS VARCHAR), 18, '0') AS cod_material,
               CAST(l_suppkey AS VARCHAR) AS cod_fornecedor,
               l_quantity AS qt_pedido, l_extendedprice AS vl_bruto,
               CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS ind_devolucao,
               l_linestatus AS st_item,
               strftime(l_shipdate, '%Y%m%d') AS dt_remessa
        FROM lineitem""",
    "pedidos": """
        SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS num_pedido,
               CASE o_orderstatus WHEN 'P' THEN NULL
                                  WHEN 'F' THEN lpad(CAST(o_custkey AS VARCHAR), 10, '0')
                                  ELSE CAST(o_custkey AS VARCHAR) END AS cod_cliente,
               CASE o_orderpriority WHEN '1-URGENT' THEN strftime(o_orderdate, '%Y%m%d')
                                    WHEN '2-HIGH' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
                                    WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%d/%m/%Y')
                                    WHEN '5-LOW' THEN '' ELSE '00000000' END AS dt_pedido,
               CASE o_orderpriority WHEN '5-LOW' THEN 'n/a' WHEN '4-NOT SPECIFIED' THEN NULL
                                    WHEN '3-MEDIUM' THEN '0,00' ELSE o_orderpriority END AS tp_prioridade,
               CASE o_orderstatus WHEN 'F' THEN TRUE WHEN 'O' THEN FALSE END AS ind_faturado,
               CASE WHEN o_orderstatus = 'O' THEN 'X' WHEN o_orderstatus = 'F' THEN ' ' END AS ind_aberto,
               o_orderstatus AS st_pedido,
               o_totalprice AS vl_total,
               CASE o_orderstatus
                    WHEN 'F' THEN CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR)
                    WHEN 'O' THEN replace(CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR), '.', ',')
                    ELSE '' END AS vl_texto,
               CAST(NULL AS VARCHAR) AS cod_obsoleto,
               CAST(o_orderdate AS DATE) AS dt_carga
        FROM orders""",
    "eventos": """
        SELECT event_id, user_id, event_type, ts, value,
               CASE event_type WHEN 'click' THEN strftime(ts, '%H%M%S')
                               WHEN 'view' THEN strftime(ts, '%H:%M:%S')
                               WHEN 'error' THEN '' ELSE NULL END AS hr_evento
        FROM events""",
}


def itens(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    return table(spark, d, "lineitem").select(
        F.lpad(text("l_orderkey"), 10, "0").alias("num_pedido"),
        F.lpad(text("l_linenumber"), 5, "0").alias("num_item"),
        F.lpad(text("l_partkey"), 18, "0").alias("cod_material"),
        text("l_suppkey").alias("cod_fornecedor"),
        F.col("l_quantity").alias("qt_pedido"),
        F.col("l_extendedprice").alias("vl_bruto"),
        F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("ind_devolucao"),
        F.col("l_linestatus").alias("st_item"),
        F.date_format("l_shipdate", "yyyyMMdd").alias("dt_remessa"),
    )


def pedidos(spark: SparkSession, d: str) -> DataFrame:
    status, prio, day = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderdate")
    cust = F.col("o_custkey").cast("string")
    money = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return table(spark, d, "orders").select(
        F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("num_pedido"),
        F.when(status == "F", F.lpad(cust, 10, "0")).when(status != "P", cust).alias("cod_cliente"),
        F.when(prio == "1-URGENT", F.date_format(day, "yyyyMMdd"))
        .when(prio == "2-HIGH", F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
        .when(prio == "3-MEDIUM", F.date_format(day, "dd/MM/yyyy"))
        .when(prio == "5-LOW", "")
        .otherwise("00000000")
        .alias("dt_pedido"),
        F.when(prio == "5-LOW", "n/a").when(prio == "3-MEDIUM", "0,00")
        .when(prio != "4-NOT SPECIFIED", prio).alias("tp_prioridade"),
        F.when(status == "F", True).when(status == "O", False).alias("ind_faturado"),
        F.when(status == "O", "X").when(status == "F", " ").alias("ind_aberto"),
        status.alias("st_pedido"),
        F.col("o_totalprice").alias("vl_total"),
        F.when(status == "F", money).when(status == "O", F.replace(money, F.lit("."), F.lit(",")))
        .otherwise("").alias("vl_texto"),
        F.lit(None).cast("string").alias("cod_obsoleto"),
        day.cast("date").alias("dt_carga"),
    )


def eventos(spark: SparkSession, d: str) -> DataFrame:
    kind, ts = F.col("event_type"), F.col("ts")
    return table(spark, d, "events").select(
        "event_id", "user_id", "event_type", "ts", "value",
        F.when(kind == "click", F.date_format(ts, "HHmmss"))
        .when(kind == "view", F.date_format(ts, "HH:mm:ss"))
        .when(kind == "error", "")
        .alias("hr_evento"),
    )
