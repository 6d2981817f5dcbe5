"""Grain, duplicate and version queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from crivo.operators import keys, report

from .base import itens, pct_sql, pedidos, query, ratio_sql, table

ITEM_KEYS = [["num_pedido"], ["num_pedido", "num_item"], ["num_pedido", "num_item", "cod_material"],
             ["num_pedido", "num_item", "cod_material", "cod_fornecedor"]]


def _name(key) -> str:
    return " + ".join(key)


def _grain_rows(src: str, cand) -> str:
    return " UNION ALL ".join(
        f"SELECT '{_name(k)}' AS chave, (SELECT count(*) FROM {src}) AS linhas, count(*) AS combinacoes_distintas "
        f"FROM (SELECT DISTINCT {', '.join(k)} FROM {src})"
        for k in cand
    )


def _grain_sql(src: str, cand) -> str:
    return f"""WITH g AS ({_grain_rows(src, cand)})
        SELECT *, {ratio_sql('linhas', 'combinacoes_distintas')} AS linhas_por_chave,
            CASE WHEN linhas = combinacoes_distintas THEN 'CHAVE UNICA'
                 ELSE 'NAO UNICA - ha dimensao adicional' END AS veredito FROM g"""


@query(_grain_sql("itens", ITEM_KEYS), ("itens",))
def grain(spark, d):
    return keys.grain(itens(spark, d), ITEM_KEYS)


PEDIDO_KEYS = [["cod_cliente"], ["cod_cliente", "dt_pedido"], ["num_pedido"]]


@query(_grain_sql("pedidos", PEDIDO_KEYS), ("pedidos",))
def grain_null_keys(spark, d):
    return keys.grain(pedidos(spark, d), PEDIDO_KEYS)


HUNT = [["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber", "l_suppkey"],
        ["l_orderkey", "l_linenumber", "l_shipdate"], ["l_orderkey", "l_partkey", "l_suppkey"],
        ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"]]


@query(_grain_sql("lineitem", HUNT))
def key_hunt(spark, d):
    return keys.grain(table(spark, d, "lineitem"), HUNT)


DECLARED = [["conv_id"], ["conv_id", "turn"]]


@query(_grain_sql("conversations", DECLARED))
def declared_key_vs_clustering(spark, d):
    return keys.grain(table(spark, d, "conversations"), DECLARED)


@query(
    f"""WITH g AS ({_grain_rows('itens', ITEM_KEYS)})
        SELECT coalesce(min(chave) FILTER (WHERE linhas = combinacoes_distintas), 'NENHUMA - investigar') AS sugerida FROM g""",
    ("itens",),
)
def suggest_key(spark, d):
    return keys.suggest_key(itens(spark, d), ITEM_KEYS)


@query(
    f"""WITH g AS ({_grain_rows('pedidos', [["cod_cliente"], ["num_pedido"]])})
        SELECT coalesce(min(chave) FILTER (WHERE linhas = combinacoes_distintas), 'NENHUMA - investigar') AS sugerida FROM g""",
    ("pedidos",),
)
def suggest_key_found(spark, d):
    return keys.suggest_key(pedidos(spark, d), [["cod_cliente"], ["num_pedido"]])


def _dup_sql(src: str, cand) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{_name(k)}' AS chave, count(*) AS chaves_repetidas, CAST(sum(n - 1) AS BIGINT) AS linhas_excedentes,
        max(n) AS pior_caso FROM (SELECT count(*) AS n FROM {src} GROUP BY {', '.join(k)} HAVING count(*) > 1)"""
        for k in cand
    )


@query(_dup_sql("itens", ITEM_KEYS), ("itens",))
def duplicate_summary(spark, d):
    return keys.duplicate_summary(itens(spark, d), ITEM_KEYS)


@query(_dup_sql("pedidos", PEDIDO_KEYS), ("pedidos",))
def duplicate_summary_null_keys(spark, d):
    return keys.duplicate_summary(pedidos(spark, d), PEDIDO_KEYS)


@query(
    """SELECT num_pedido, num_item, count(*) AS qtd FROM itens GROUP BY 1, 2 HAVING count(*) > 1
        ORDER BY qtd DESC, num_pedido, num_item LIMIT 20""",
    ("itens",),
)
def duplicate_keys(spark, d):
    return keys.duplicate_keys(itens(spark, d), ["num_pedido", "num_item"], k=20)


@query(
    """SELECT i.* FROM itens i JOIN (SELECT num_pedido, num_item FROM itens GROUP BY 1, 2 HAVING count(*) > 1) k
        ON i.num_pedido IS NOT DISTINCT FROM k.num_pedido AND i.num_item IS NOT DISTINCT FROM k.num_item""",
    ("itens",),
)
def duplicate_rows(spark, d):
    return keys.duplicate_rows(itens(spark, d), ["num_pedido", "num_item"])


@query(
    """SELECT p.* FROM pedidos p JOIN (SELECT cod_cliente FROM pedidos GROUP BY 1 HAVING count(*) > 1) k USING (cod_cliente)""",
    ("pedidos",),
)
def duplicate_rows_using(spark, d):
    return keys.duplicate_rows(pedidos(spark, d), ["cod_cliente"], null_keys=False)


VARYING = ("qt_pedido", "vl_bruto", "ind_devolucao", "st_item", "dt_remessa", "cod_material", "cod_fornecedor")


def _varying_sql(src: str, key, cols) -> str:
    ks = ", ".join(key)
    dup = f"SELECT {ks} FROM {src} GROUP BY {ks} HAVING count(*) > 1"
    on = " AND ".join(f"s.{k} IS NOT DISTINCT FROM k.{k}" for k in key)
    group = ", ".join(f"s.{k}" for k in key)
    aggs = ", ".join(f"count(DISTINCT s.{c}) AS {c}" for c in cols)
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS coluna, coalesce(max({c}), 0) AS max_valores_distintos FROM a" for c in cols
    )
    return f"""WITH a AS (SELECT {aggs} FROM {src} s JOIN ({dup}) k ON {on} GROUP BY {group}), r AS ({rows})
        SELECT *, CASE WHEN max_valores_distintos > 1 THEN 'VARIA - faz parte da chave real' ELSE 'constante' END AS veredito
        FROM r"""


@query(_varying_sql("itens", ["num_pedido", "num_item"], VARYING), ("itens",))
def varying_columns(spark, d):
    return keys.varying_columns(itens(spark, d), ["num_pedido", "num_item"], VARYING)


@query(_varying_sql("pedidos", ["cod_cliente"], ("dt_pedido", "st_pedido", "ind_faturado", "cod_obsoleto")), ("pedidos",))
def varying_columns_null_key(spark, d):
    return keys.varying_columns(
        pedidos(spark, d), ["cod_cliente"], ["dt_pedido", "st_pedido", "ind_faturado", "cod_obsoleto"]
    )


STATUS_COLS = "num_pedido, ind_devolucao, st_item"


@query(
    f"""WITH k AS (SELECT num_pedido, count(*) AS n, count(DISTINCT ({STATUS_COLS})) AS v FROM itens GROUP BY 1)
        SELECT count(*) AS chaves, CAST(sum(n) AS BIGINT) AS linhas, count(*) FILTER (WHERE n > 1) AS chaves_duplicadas,
            CAST(sum(n - v) AS BIGINT) AS linhas_duplicata_pura, count(*) FILTER (WHERE v > 1) AS chaves_com_mais_de_uma_versao,
            CAST(sum(CASE WHEN v > 1 THEN v - 1 ELSE 0 END) AS BIGINT) AS linhas_versao_excedente FROM k""",
    ("itens",),
)
def pure_vs_version(spark, d):
    return keys.pure_vs_version(itens(spark, d), ["num_pedido"], ["num_pedido", "ind_devolucao", "st_item"])


@query(
    """WITH k AS (SELECT num_pedido, num_item, count(*) AS n, count(DISTINCT i) AS v FROM itens i GROUP BY 1, 2 HAVING count(*) > 1)
        SELECT count(*) AS chaves_repetidas, CAST(coalesce(sum(n - v), 0) AS BIGINT) AS repeticoes_identicas,
            count(*) FILTER (WHERE v > 1) AS chaves_com_versoes FROM k""",
    ("itens",),
)
def repeated_versions(spark, d):
    return keys.repeated_versions(itens(spark, d), ["num_pedido", "num_item"])


def _checksum_sql(distinct: str, src: str) -> str:
    return f"""WITH x AS (SELECT count(*) AS n, count(DISTINCT {distinct}) AS v FROM {src} s)
        SELECT n AS linhas, v AS linhas_unicas, n - v AS linhas_identicas,
            CASE WHEN n = v THEN 'OK - nenhuma linha totalmente identica'
                 ELSE 'ATENCAO - existem linhas identicas em todos os campos' END AS veredito FROM x"""


@query(_checksum_sql("s", "lineitem"))
def row_checksum(spark, d):
    return keys.row_checksum(table(spark, d, "lineitem"))


@query(_checksum_sql("s", "customer"))
def row_checksum_json(spark, d):
    return keys.row_checksum(table(spark, d, "customer"), mode="json")


@query(_checksum_sql("(embedding, label)", "embeddings"))
def row_checksum_nested(spark, d):
    return keys.row_checksum(table(spark, d, "embeddings"), ["embedding", "label"])


@query(_checksum_sql("md5(text)", "documents"))
def row_checksum_text(spark, d):
    return keys.row_checksum(table(spark, d, "documents"), ["text"], mode="sha256")


PEDIDO_TEXTS = ["cod_cliente", "tp_prioridade", "ind_aberto", "st_pedido", "cod_obsoleto"]


@query(
    _checksum_sql("md5(concat_ws('|', " + ", ".join(f"coalesce({c}, '')" for c in PEDIDO_TEXTS) + "))", "pedidos"),
    ("pedidos",),
)
def row_checksum_concat(spark, d):
    return keys.row_checksum(pedidos(spark, d), PEDIDO_TEXTS, mode="concat")


@query(
    """WITH h AS (SELECT CASE WHEN lang <> 'es' THEN md5(text) END AS h FROM documents),
        g AS (SELECT h, count(*) AS n FROM h GROUP BY 1)
        SELECT CAST(sum(n) AS BIGINT) AS linhas, count(h) AS hashes_distintos,
            CAST(coalesce(sum(n) FILTER (WHERE h IS NULL), 0) AS BIGINT) AS hash_nulo,
            CAST(coalesce(sum(n - 1) FILTER (WHERE h IS NOT NULL), 0) AS BIGINT) AS linhas_com_hash_repetido FROM g"""
)
def content_hash_check(spark, d):
    x = table(spark, d, "documents").select(
        F.when(F.col("lang") != "es", F.md5("text")).alias("cod_hash_conteudo")
    )
    return keys.content_hash_check(x, "cod_hash_conteudo")


@query(
    """SELECT itens, count(*) AS pais, CAST(sum(itens - 1) AS BIGINT) AS linhas_excedentes
        FROM (SELECT count(*) AS itens FROM lineitem GROUP BY l_orderkey) GROUP BY 1"""
)
def items_per_parent(spark, d):
    return keys.items_per_parent(table(spark, d, "lineitem"), ["l_orderkey"])


@query(
    """SELECT itens, count(*) AS pais, CAST(sum(n - 1) AS BIGINT) AS linhas_excedentes
        FROM (SELECT count(DISTINCT l_suppkey) AS itens, count(*) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY 1"""
)
def children_per_parent(spark, d):
    return keys.items_per_parent(table(spark, d, "lineitem"), ["l_orderkey"], "l_suppkey")


@query(
    """SELECT itens, count(*) AS pais, CAST(sum(n - 1) AS BIGINT) AS linhas_excedentes,
        CASE WHEN itens > 1 THEN 'CHAVE REAL inclui l_returnflag' ELSE 'chave pai suficiente' END AS veredito
        FROM (SELECT count(DISTINCT l_returnflag) AS itens, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
        GROUP BY 1"""
)
def collapse_measure(spark, d):
    return keys.collapse_measure(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_returnflag")


@query(
    """SELECT l_suppkey, count(DISTINCT l_returnflag) AS itens, string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) AS tipos
        FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1 ORDER BY itens DESC, l_suppkey LIMIT 25"""
)
def collapse_members(spark, d):
    return keys.collapse_members(table(spark, d, "lineitem"), ["l_suppkey"], "l_returnflag", k=25, as_list=True)


@query(
    """SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem WHERE l_orderkey IN (
        SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1)"""
)
def collapse_member_rows(spark, d):
    return keys.collapse_members(table(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag")


@query(
    """SELECT l_orderkey, l_partkey, count(DISTINCT l_linenumber) AS itens FROM lineitem GROUP BY 1, 2
        HAVING count(DISTINCT l_linenumber) > 1 ORDER BY itens DESC, l_orderkey, l_partkey LIMIT 20"""
)
def repeated_child(spark, d):
    return keys.repeated_child(table(spark, d, "lineitem"), ["l_orderkey"], "l_partkey", "l_linenumber", k=20)


@query(
    """WITH k AS (SELECT count(*) AS n FROM orders GROUP BY o_custkey)
        SELECT count(*) AS chaves, CAST(sum(n) AS BIGINT) AS linhas, count(*) FILTER (WHERE n > 1) AS chaves_repetidas,
            CAST(sum(n) FILTER (WHERE n > 1) AS BIGINT) AS linhas_em_chaves_repetidas, max(n) AS maximo_linhas_por_chave,
            count(*) FILTER (WHERE n = 1) AS chaves_com_1, count(*) FILTER (WHERE n BETWEEN 2 AND 4) AS chaves_com_2_a_4,
            count(*) FILTER (WHERE n BETWEEN 5 AND 9) AS chaves_com_5_a_9, count(*) FILTER (WHERE n >= 10) AS chaves_com_10_ou_mais
        FROM k"""
)
def multiplicity(spark, d):
    return keys.multiplicity(table(spark, d, "orders"), ["o_custkey"])


@query(
    f"""WITH k AS (SELECT count(DISTINCT (l_returnflag, l_linestatus)) AS v FROM lineitem GROUP BY l_orderkey)
        SELECT count(*) AS entidades, count(*) FILTER (WHERE v > 1) AS entidades_com_mais_de_uma_versao,
            max(v) AS maximo_versoes, {pct_sql('count(*) FILTER (WHERE v > 1)', 'count(*)')} AS pct_com_versoes FROM k"""
)
def attribute_versions(spark, d):
    return keys.attribute_versions(table(spark, d, "lineitem"), ["l_orderkey"], ["l_returnflag", "l_linestatus"])


@query(
    """SELECT l_orderkey, l_linenumber, count(*) AS linhas, count(DISTINCT l_suppkey) AS distintos_l_suppkey,
        count(DISTINCT l_returnflag) AS distintos_l_returnflag FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"""
)
def split_dimensions(spark, d):
    return keys.split_dimensions(
        table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_suppkey", "l_returnflag"]
    )


@query(
    """SELECT l.* EXCLUDE (l_shipdate), CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem l
        JOIN (SELECT l_orderkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, l_orderkey LIMIT 1) t USING (l_orderkey)"""
)
def largest_document(spark, d):
    li = table(spark, d, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("date"))
    return keys.largest_document(li, "l_orderkey")


@query("SELECT count(DISTINCT num_pedido || '|' || cod_cliente || '|' || tp_prioridade) AS combinacoes FROM pedidos", ("pedidos",))
def legacy_concat_distinct(spark, d):
    p = pedidos(spark, d)
    return p.agg(keys.legacy_concat_distinct(p, ["num_pedido", "cod_cliente", "tp_prioridade"]).alias("combinacoes"))


# --- summaries -----------------------------------------------------------------


def _fmt4(n: str, d: str) -> str:
    return f"format('{{:.4f}}', {ratio_sql(n, d)})"


@query(
    f"""WITH g AS ({_grain_rows('itens', ITEM_KEYS)})
        SELECT 'VOLUMETRIA' AS bloco, 'linhas na base' AS item, CAST(count(*) AS VARCHAR) AS valor, '' AS veredito FROM itens
        UNION ALL SELECT 'VOLUMETRIA', 'colunas', '9', ''
        UNION ALL SELECT 'VOLUMETRIA', 'clustering declarado', 'num_pedido, num_item', ''
        UNION ALL SELECT 'GRANULARIDADE', chave, {_fmt4('linhas', 'combinacoes_distintas')},
            CASE WHEN linhas = combinacoes_distintas THEN 'CHAVE UNICA' ELSE 'nao unica' END FROM g""",
    ("itens",),
)
def summary(spark, d):
    return report.summary(itens(spark, d), ITEM_KEYS, ["num_pedido", "num_item"])


SCEN_KEYS = [["c_nationkey"], ["c_custkey"]]


@query(
    f"""WITH c AS (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'), g AS ({_grain_rows('c', SCEN_KEYS)})
        SELECT 'CENARIO' AS bloco, 'tabela' AS item, 'customer' AS valor
        UNION ALL SELECT 'CENARIO', 'filtro', 'c_mktsegment = BUILDING'
        UNION ALL SELECT 'CENARIO', 'linhas no cenario', format('{{:,}}', count(*)) FROM c
        UNION ALL SELECT 'CENARIO', 'colunas', '5'
        UNION ALL SELECT 'GRANULARIDADE', chave, format('{{:,}}', combinacoes_distintas) || ' distintos | ' ||
            {_fmt4('linhas', 'combinacoes_distintas')} || ' linhas/chave | ' ||
            CASE WHEN linhas = combinacoes_distintas THEN 'CHAVE UNICA' ELSE 'nao unica' END FROM g
        UNION ALL SELECT 'CHAVE REAL', 'sugerida',
            coalesce((SELECT min(chave) FROM g WHERE linhas = combinacoes_distintas), 'NENHUMA - investigar')"""
)
def scenario_summary(spark, d):
    c = table(spark, d, "customer")
    return report.scenario_summary(
        c.where(c.c_mktsegment == "BUILDING"), SCEN_KEYS,
        {"tabela": "customer", "filtro": "c_mktsegment = BUILDING"},
    )


@query(
    """WITH k AS (SELECT count(*) AS n FROM itens GROUP BY num_pedido, num_item)
        SELECT 'itens' AS objeto, '' AS cenario, CAST(60000 AS BIGINT) AS volume_esperado, CAST(sum(n) AS BIGINT) AS volume_atual,
            count(*) AS chaves_distintas, count(*) FILTER (WHERE n > 1) AS chaves_repetidas,
            'num_pedido + num_item' AS chave_observada FROM k""",
    ("itens",),
)
def canary_summary(spark, d):
    return report.canary_summary(itens(spark, d), ["num_pedido", "num_item"], "itens", 60000, "")
