"""Scan, filter, sample and extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from crivo.sources import metadata, scan, sink

from .base import itens, pedidos, query, table


@query(
    """SELECT o_orderstatus, o_orderpriority, count(*) AS linhas FROM orders
        WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' GROUP BY 1, 2"""
)
def base_view(spark, d):
    params = {"o_orderstatus": "F", "o_orderpriority": "1-URGENT", "o_custkey": ""}
    base = scan.base_view(table(spark, d, "orders"), params, "base")
    return base.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("linhas"))


@query("SELECT source, count(*) AS linhas FROM documents WHERE trim(source) LIKE 'src1%' GROUP BY 1")
def prefix_filter(spark, d):
    x = table(spark, d, "documents")
    return x.where(scan.prefixed(x, "source", "src1")).groupBy("source").agg(F.count("*").alias("linhas"))


@query(
    "SELECT cod_cliente, count(*) AS linhas FROM pedidos WHERE try_cast(cod_cliente AS BIGINT) IN (11, 72, 899) GROUP BY 1",
    ("pedidos",),
)
def numeric_in_list(spark, d):
    p = pedidos(spark, d)
    return p.where(scan.in_list(p, "cod_cliente", ["011", "72", "899"], numeric=True)).groupBy("cod_cliente").agg(
        F.count("*").alias("linhas")
    )


@query("SELECT lang, count(*) AS documentos FROM documents WHERE contains(text, 'the') GROUP BY 1")
def substring_filter(spark, d):
    x = table(spark, d, "documents")
    return x.where(scan.contains(x, "text", "the")).groupBy("lang").agg(F.count("*").alias("documentos"))


@query(
    """SELECT num_pedido, try_cast(cod_cliente AS BIGINT) AS cod_cliente, try_cast(tp_prioridade AS BIGINT) AS tp_prioridade,
        CASE WHEN trim(dt_pedido) NOT IN ('', '00000000', '0000-00-00', '0') THEN CAST(try_strptime(dt_pedido, '%Y%m%d') AS DATE) END AS dt_pedido,
        st_pedido FROM pedidos""",
    ("pedidos",),
)
def safe_base(spark, d):
    p = pedidos(spark, d).select("num_pedido", "cod_cliente", "tp_prioridade", "dt_pedido", "st_pedido")
    return scan.safe_base(p, {"cod_cliente": "bigint", "tp_prioridade": "bigint"}, {"dt_pedido": "yyyyMMdd"})


@query(
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN date_trunc('second', ts) END AS instante FROM events"""
)
def safe_base_stamps(spark, d):
    e = table(spark, d, "events")
    text = F.when(F.col("event_type") == "error", "??").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("instante")
    return scan.safe_base(e.select("event_id", text), stamps={"instante": "yyyy-MM-dd HH:mm:ss"})


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 20")
def sample_ordered(spark, d):
    return scan.sample_first(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), 20, ["o_orderkey"])


@query("SELECT least(count(*), 10) AS linhas, least(count(*), 10) AS da_tabela FROM orders")
def sample_random(spark, d):
    # random rows have no SQL twin; how many there are, all different and all of the table, has
    o = table(spark, d, "orders")
    drawn = scan.sample_random(o, 10, seed=7)
    return drawn.agg(F.count("*").alias("linhas")).crossJoin(
        o.join(drawn.select("o_orderkey").distinct(), "o_orderkey", "left_semi").agg(F.count("*").alias("da_tabela")))


@query(
    """SELECT num_pedido, num_item, cod_material, qt_pedido, vl_bruto, dt_remessa FROM itens WHERE st_item = 'F'""",
    ("itens",),
)
def extract_full(spark, d):
    cols = ["num_pedido", "num_item", "cod_material", "qt_pedido", "vl_bruto", "dt_remessa"]
    return sink.extract(itens(spark, d), "st_item = 'F'", cols, order=["num_pedido", "num_item"])


@query(
    """SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment, substring(md5(c_name), 1, 8) AS c_name_hash FROM customer"""
)
def extract_masked(spark, d):
    return sink.extract(table(spark, d, "customer"), pii=["c_name"], order=["c_custkey"])


@query(
    """SELECT trim(num_pedido) AS pedido, trim(cod_cliente) AS cliente, trim(ind_aberto) AS aberto, vl_total AS valor FROM pedidos""",
    ("pedidos",),
)
def extract_renamed(spark, d):
    return sink.extract_renamed(
        pedidos(spark, d), {"num_pedido": "pedido", "cod_cliente": "cliente", "ind_aberto": "aberto", "vl_total": "valor"}
    )


@query(
    """SELECT num_pedido, cod_cliente, vl_total, CASE WHEN ind_aberto = 'X' AND vl_total > 250000 THEN 'S' ELSE 'N' END AS na_tela, 'completo' AS escopo FROM pedidos
        UNION ALL SELECT num_pedido, cod_cliente, vl_total, 'S', 'tela' FROM pedidos WHERE ind_aberto = 'X' AND vl_total > 250000""",
    ("pedidos",),
)
def extract_scopes(spark, d):
    p = pedidos(spark, d)
    on_screen = (p.ind_aberto == "X") & (p.vl_total > 250000)
    p = p.select("num_pedido", "cod_cliente", "vl_total", sink.scope_flag(on_screen).alias("na_tela"))
    parts = sink.extract_scopes(p, {"completo": None, "tela": F.col("na_tela") == "S"})
    return parts["completo"].withColumn("escopo", F.lit("completo")).unionByName(
        parts["tela"].withColumn("escopo", F.lit("tela"))
    )


@query("SELECT CAST(1 AS BIGINT) AS arquivos, count(*) AS linhas FROM lineitem")
def describe_detail(spark, d):
    # file sizes and times are facts of the storage, not of the data
    return metadata.describe_detail(table(spark, d, "lineitem")).select("arquivos", "linhas")


@query("SELECT CAST(1 AS BIGINT) AS arquivos, count(*) AS linhas FROM orders")
def write_history(spark, d):
    return metadata.write_history(table(spark, d, "orders")).select("arquivos", "linhas")
