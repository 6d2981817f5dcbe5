"""Keys, dependencies and references that are found, with SQL that tries all of them."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from crivo.operators import discovery

from .base import itens, pct_sql, query, table

LINEITEM = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
ITENS = ("num_pedido", "num_item", "cod_material", "cod_fornecedor", "qt_pedido", "ind_devolucao", "st_item", "dt_remessa")


def _keys_sql(src: str, columns, most: int) -> str:
    sets = [s for size in range(1, most + 1) for s in combinations(columns, size)]
    each = " UNION ALL ".join(
        f"SELECT {list(s)} AS c, (SELECT count(*) FROM {src}) AS n, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(s)} FROM {src})) AS d" for s in sets)
    return f"""WITH s AS ({each}), u AS (SELECT * FROM s WHERE n = d AND n > 0)
        SELECT array_to_string(c, ' + ') AS chave, CAST(len(c) AS BIGINT) AS colunas, n AS linhas FROM u
        WHERE NOT EXISTS (SELECT 1 FROM u AS v WHERE len(v.c) < len(u.c) AND list_has_all(u.c, v.c))"""


@query(_keys_sql("lineitem", LINEITEM, 3))
def minimal_keys(spark, d):
    return discovery.minimal_keys(table(spark, d, "lineitem"), LINEITEM, most=3)


@query(_keys_sql("itens", ITENS, 4), ("itens",))
def minimal_keys_items(spark, d):
    return discovery.minimal_keys(itens(spark, d), ITENS, most=4)


DEPENDING = {
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
}


def _dependency_rows(src: str, columns) -> str:
    out = []
    for size in (1, 2):
        for left in combinations(columns, size):
            for right in columns:
                if right not in left:
                    x = ", ".join(left)
                    out.append(f"""SELECT '{src}' AS tabela, {list(left)} AS x, '{right}' AS direita, (SELECT count(*) FROM {src}) AS linhas,
                        (SELECT coalesce(sum(n - m), 0) FROM (SELECT sum(k) AS n, max(k) AS m FROM (SELECT {x}, {right}, count(*) AS k FROM {src} GROUP BY ALL) GROUP BY {x})) AS erro""")
    return " UNION ALL ".join(out)


@query(
    f"""WITH e AS MATERIALIZED ({' UNION ALL '.join(_dependency_rows(t, c) for t, c in DEPENDING.items())}),
        one AS (SELECT tabela, x[1] AS a, direita AS b FROM e WHERE len(x) = 1 AND erro = 0)
        SELECT tabela, array_to_string(x, ' + ') AS esquerda, direita, linhas, CAST(erro AS BIGINT) AS erro, {pct_sql('erro', 'linhas')} AS pct_erro,
            CASE WHEN erro = 0 THEN 'DETERMINA' ELSE 'nao determina' END AS veredito FROM e
        WHERE len(x) = 1 OR NOT EXISTS (SELECT 1 FROM one WHERE one.tabela = e.tabela AND list_contains(e.x, one.a) AND (one.b = e.direita OR list_contains(e.x, one.b)))"""
)
def dependencies(spark, d):
    out = [discovery.dependencies(table(spark, d, t), c).withColumn("tabela", F.lit(t)) for t, c in DEPENDING.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


REFERRED = {
    "region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"), "customer": ("c_custkey", "c_name", "c_nationkey", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey"), "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate"),
    "events": ("event_id", "ts", "user_id", "event_type", "props"),
}


@query(
    f"""WITH v AS ({' UNION ALL '.join(f"SELECT '{t}.{c}' AS c, CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY ALL" for t, cs in REFERRED.items() for c in cs)}),
        d AS (SELECT c, count(*) AS distintos, sum(n) AS linhas FROM v GROUP BY 1),
        j AS (SELECT a.c, b.c AS em, count(*) AS em_comum, sum(a.n) AS linhas_comuns FROM v a JOIN v b ON a.v = b.v AND a.c <> b.c GROUP BY ALL)
        SELECT c AS coluna, em, distintos, em_comum, distintos - em_comum AS orfaos, CAST(linhas - linhas_comuns AS BIGINT) AS linhas_orfas,
            {pct_sql('distintos - em_comum', 'distintos')} AS pct_orfaos, CASE WHEN distintos = em_comum THEN 'REFERENCIA COMPLETA' ELSE 'ha orfaos' END AS veredito FROM j JOIN d USING (c)"""
)
def inclusions(spark, d):
    return discovery.inclusions({t: table(spark, d, t) for t in REFERRED})
