"""Business-rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from crivo.functions.missing import has_value
from crivo.functions.ratios import count_if
from crivo.operators import columns, keys, rules, volume

from .base import itens, pct_sql, pedidos, query, table

NET = "l_extendedprice * (1 - l_discount)"
# a stored net amount that is off by a known slip where the line was returned
STORED = f"CASE WHEN l_returnflag = 'R' THEN {NET} + 0.02 WHEN l_linestatus = 'F' THEN NULL ELSE {NET} END"


def _net(spark, d):
    li = table(spark, d, "lineitem")
    net = li.l_extendedprice * (1 - li.l_discount)
    stored = F.when(li.l_returnflag == "R", net + 0.02).when(li.l_linestatus != "F", net)
    return li.withColumn("vl_liquido", stored), net


@query(
    f"""WITH x AS (SELECT abs({NET} - ({STORED})) AS dif, ({STORED}) IS NULL AS falta FROM lineitem),
        y AS (SELECT count(*) AS linhas, count(*) FILTER (WHERE dif <= 0.005) AS equacao_ok,
            count(*) FILTER (WHERE dif > 0.005) AS divergentes, {pct_sql('count(*) FILTER (WHERE dif > 0.005)', 'count(*)', 4)} AS pct_divergente,
            round(max(dif), 6) AS maior_diferenca, count(*) FILTER (WHERE falta OR dif IS NULL) AS com_campo_nulo FROM x)
        SELECT *, CASE WHEN divergentes = 0 THEN 'OK - equacao fecha'
            ELSE 'ERRO - investigar' END AS veredito FROM y"""
)
def equation_check(spark, d):
    df, net = _net(spark, d)
    return rules.equation_check(df, net, "vl_liquido", 0.005, ["vl_liquido", "l_discount"])


@query(
    """WITH y AS (SELECT count(*) AS linhas, count(*) FILTER (WHERE abs(l_quantity + l_linenumber - l_linenumber - l_quantity) <= 0.001) AS equacao_ok,
            count(*) FILTER (WHERE abs(l_quantity + l_linenumber - l_linenumber - l_quantity) > 0.001) AS divergentes FROM lineitem)
        SELECT linhas, equacao_ok, divergentes, CAST(0 AS DOUBLE) AS pct_divergente, CAST(0 AS DOUBLE) AS maior_diferenca,
            CAST(0 AS BIGINT) AS com_campo_nulo, 'OK - equacao fecha' AS veredito FROM y"""
)
def equation_check_closed(spark, d):
    li = table(spark, d, "lineitem")
    return rules.equation_check(li, li.l_quantity + li.l_linenumber - li.l_linenumber, "l_quantity", 0.001, ["l_quantity"])


@query(
    f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {NET} AS c, {STORED} AS v, abs({NET} - ({STORED})) AS dif FROM lineitem)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(c, 6) AS calculado, v AS informado, round(dif, 6) AS diferenca
        FROM x WHERE dif > 0.005 ORDER BY diferenca DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 20"""
)
def worst_divergences(spark, d):
    df, net = _net(spark, d)
    return rules.worst_divergences(
        df, net, "vl_liquido", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 0.005, k=20
    )


def _tax_sql(name: str, base: str, rate: str, value: str) -> str:
    b, r, v = (f"coalesce({x}, 0)" for x in (base, rate, value))
    return f"""SELECT '{name}' AS tributo, count(*) FILTER (WHERE {b} <> 0) AS com_base, count(*) FILTER (WHERE {v} <> 0) AS com_valor,
        count(*) FILTER (WHERE {b} = 0 AND {v} <> 0) AS valor_sem_base,
        count(*) FILTER (WHERE abs({v} - {b} * {r} / 100) > 0.05) AS formula_diverge FROM lineitem"""


@query(
    _tax_sql("imposto", "l_extendedprice", "l_tax * 100", "l_extendedprice * l_tax")
    + " UNION ALL "
    + _tax_sql("desconto", "CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_extendedprice END", "l_discount * 100", "l_extendedprice * l_discount")
)
def tax_check(spark, d):
    li = table(spark, d, "lineitem")
    price = li.l_extendedprice
    return rules.tax_check(li, {
        "imposto": (price, li.l_tax * 100, price * li.l_tax),
        "desconto": (F.when(li.l_returnflag != "N", price), li.l_discount * 100, price * li.l_discount),
    })


SUSPICIOUS = {
    "faturado MAS em aberto": "ind_faturado AND ind_aberto = 'X'",
    "sem cliente MAS com valor": "cod_cliente IS NULL AND vl_total > 0",
    "em aberto SEM data": "ind_aberto = 'X' AND trim(coalesce(dt_pedido, '')) IN ('', '00000000')",
    "prioridade sem valor util": "tp_prioridade IS NULL OR tp_prioridade IN ('n/a', '0,00')",
}


@query(
    " UNION ALL ".join(
        f"SELECT '{n}' AS situacao, count(*) FILTER (WHERE {p}) AS linhas FROM pedidos" for n, p in SUSPICIOUS.items()
    ),
    ("pedidos",),
)
def suspicious_combinations(spark, d):
    p = pedidos(spark, d)
    opened = p.ind_aberto == "X"
    return rules.suspicious_combinations(p, {
        "faturado MAS em aberto": p.ind_faturado & opened,
        "sem cliente MAS com valor": p.cod_cliente.isNull() & (p.vl_total > 0),
        "em aberto SEM data": opened & F.trim(F.coalesce(p.dt_pedido, F.lit(""))).isin("", "00000000"),
        "prioridade sem valor util": p.tp_prioridade.isNull() | p.tp_prioridade.isin("n/a", "0,00"),
    })


def _redundant_sql(src: str, a: str, b: str, text: bool) -> str:
    x, y = (f"coalesce({a}, '')", f"coalesce({b}, '')") if text else (a, b)
    same = f"{x} IS NOT DISTINCT FROM {y}"
    return f"""SELECT '{a} vs {b}' AS par, count(*) AS linhas, count(*) FILTER (WHERE {same}) AS identicos,
        count(*) FILTER (WHERE NOT ({same})) AS divergentes,
        CASE WHEN count(*) FILTER (WHERE NOT ({same})) = 0 THEN 'REDUNDANCIA CONFIRMADA' ELSE 'colunas divergem' END AS veredito
        FROM {src}"""


@query(
    _redundant_sql("pedidos", "ind_aberto", "st_pedido", True) + " UNION ALL "
    + _redundant_sql("pedidos", "cod_obsoleto", "cod_obsoleto", True) + " UNION ALL "
    + _redundant_sql("pedidos", "vl_total", "vl_total", False),
    ("pedidos",),
)
def redundant_columns(spark, d):
    return rules.redundant_columns(
        pedidos(spark, d), [("ind_aberto", "st_pedido"), ("cod_obsoleto", "cod_obsoleto"), ("vl_total", "vl_total")]
    )


@query(
    """WITH r AS (SELECT 'cod_obsoleto' AS coluna, count(*) - count(cod_obsoleto) AS nulos, count(*) AS total, 'CONFIRMADO - 100% nula' AS ok FROM pedidos
        UNION ALL SELECT 'cod_cliente', count(*) - count(cod_cliente), count(*), 'CONFIRMADO - 100% nula' FROM pedidos
        UNION ALL SELECT 'ind_aberto', count(*) FILTER (WHERE trim(coalesce(ind_aberto, '')) IN ('', '0')), count(*), 'CONFIRMADO - apenas vazio ou 0' FROM pedidos
        UNION ALL SELECT 'cod_cliente + ind_faturado + ind_aberto', count(*) FILTER (WHERE (cod_cliente IS NULL) = (ind_faturado IS NULL)
            AND (cod_cliente IS NULL) = (ind_aberto IS NULL)), count(*), 'CONFIRMADO - 100% nula' FROM pedidos)
        SELECT coluna, nulos, total, CASE WHEN nulos = total THEN ok ELSE 'DIVERGE - ha valores' END AS veredito FROM r""",
    ("pedidos",),
)
def declared_constant(spark, d):
    return rules.declared_constant(
        pedidos(spark, d), all_null=["cod_obsoleto", "cod_cliente"], blank_or_zero=["ind_aberto"],
        null_together=["cod_cliente", "ind_faturado", "ind_aberto"],
    )


@query(
    """SELECT coalesce(nullif(trim(tp_prioridade), ''), '(vazio)') AS tp_prioridade, count(*) AS linhas,
        CASE WHEN trim(tp_prioridade) IN ('1-URGENT', '2-HIGH') THEN 'dominio declarado' ELSE 'FORA DO DOMINIO' END AS veredito
        FROM pedidos GROUP BY ALL""",
    ("pedidos",),
)
def declared_domain(spark, d):
    return rules.declared_domain(pedidos(spark, d), "tp_prioridade", ["1-URGENT", "2-HIGH"])


@query(
    """SELECT source, count(*) AS linhas,
        CASE WHEN regexp_matches(source, '^src([0-9]|1[0-6])$') THEN 'dominio declarado' ELSE 'FORA DO DOMINIO' END AS veredito
        FROM documents GROUP BY source"""
)
def declared_domain_pattern(spark, d):
    return rules.declared_domain(table(spark, d, "documents"), "source", pattern="^src([0-9]|1[0-6])$")


@query(
    """SELECT p_brand, count(DISTINCT p_type) AS qtd_descricoes, string_agg(DISTINCT p_type, ' | ' ORDER BY p_type) AS descricoes,
        count(*) AS linhas, CASE WHEN count(DISTINCT p_type) > 1 THEN 'ERRO - codigo com mais de uma descricao' ELSE 'ok' END AS veredito
        FROM part GROUP BY 1"""
)
def code_description_map(spark, d):
    return rules.code_description_map(table(spark, d, "part"), "p_brand", "p_type", as_list=True)


@query(
    """SELECT source, lang AS descricao, count(*) AS linhas FROM documents
        WHERE source IN (SELECT source FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1) GROUP BY 1, 2"""
)
def code_description_pairs(spark, d):
    return rules.code_description_map(table(spark, d, "documents"), "source", "lang")


@query(
    """SELECT st_pedido, count(*) AS linhas, count(*) FILTER (WHERE trim(coalesce(ind_aberto, '')) = '') AS sem_descricao
        FROM pedidos GROUP BY 1 HAVING count(*) FILTER (WHERE trim(coalesce(ind_aberto, '')) = '') > 0""",
    ("pedidos",),
)
def missing_description(spark, d):
    return rules.missing_description(pedidos(spark, d), "st_pedido", "ind_aberto")


@query(
    """SELECT st_pedido, ind_aberto, count(*) AS linhas,
        CASE WHEN st_pedido = 'O' AND ind_aberto = 'X' THEN 'ok'
             WHEN st_pedido <> 'O' AND trim(ind_aberto) = '' THEN 'ok' ELSE 'DIVERGENTE DA REGRA' END AS veredito
        FROM pedidos GROUP BY 1, 2""",
    ("pedidos",),
)
def derived_column(spark, d):
    st, flag = F.col("st_pedido"), F.col("ind_aberto")
    rule = ((st == "O") & (flag == "X")) | ((st != "O") & (F.trim(flag) == ""))
    return rules.derived_column(pedidos(spark, d), ["st_pedido", "ind_aberto"], rule)


COMPOSITE = "'800' || num_pedido || num_item"
# the projected order number keeps its zeros for one status, which the rule must notice
PROJECTED = "CASE WHEN st_item = 'F' THEN ltrim(num_pedido, '0') ELSE num_pedido END"


def _composite(spark, d):
    i = itens(spark, d)
    return i.select(
        F.concat(F.lit("800"), i.num_pedido, i.num_item).alias("cod_chave"),
        F.when(i.st_item == "F", F.ltrim(i.num_pedido, F.lit("0"))).otherwise(i.num_pedido).alias("num_pedido"),
        F.ltrim(i.num_item, F.lit("0")).alias("num_item"),
        i.cod_material,
    )


@query(
    f"""WITH x AS (SELECT {COMPOSITE} AS k, {PROJECTED} AS p, ltrim(num_item, '0') AS n FROM itens)
        SELECT count(*) AS linhas, count(*) FILTER (WHERE length(trim(k)) = 18) AS chave_com_tamanho_esperado,
            count(*) FILTER (WHERE length(trim(k)) <> 18) AS chave_com_tamanho_diferente,
            count(*) FILTER (WHERE ltrim(substring(k, 4, 10), '0') = p) AS num_pedido_ok,
            count(*) FILTER (WHERE ltrim(substring(k, 4, 10), '0') <> p) AS num_pedido_divergente,
            count(*) FILTER (WHERE ltrim(substring(k, 14, 5), '0') = n) AS num_item_ok,
            count(*) FILTER (WHERE ltrim(substring(k, 14, 5), '0') <> n) AS num_item_divergente FROM x""",
    ("itens",),
)
def key_projection(spark, d):
    return rules.key_projection(_composite(spark, d), "cod_chave", 18, {"num_pedido": (4, 10), "num_item": (14, 5)})


@query(
    f"""WITH x AS (SELECT {COMPOSITE} AS k, {PROJECTED} AS p, ltrim(num_item, '0') AS n FROM itens)
        SELECT k AS cod_chave, CAST(length(k) AS INTEGER) AS tamanho, substring(k, 4, 10) AS num_pedido_bruto,
            ltrim(substring(k, 4, 10), '0') AS num_pedido_sem_zeros, p AS num_pedido, substring(k, 14, 5) AS num_item_bruto,
            ltrim(substring(k, 14, 5), '0') AS num_item_sem_zeros, n AS num_item FROM x
        WHERE ltrim(substring(k, 4, 10), '0') <> p OR ltrim(substring(k, 14, 5), '0') <> n ORDER BY k, p, n LIMIT 20""",
    ("itens",),
)
def key_projection_examples(spark, d):
    return rules.key_projection_examples(_composite(spark, d), "cod_chave", {"num_pedido": (4, 10), "num_item": (14, 5)}, k=20)


PERIOD = "strftime(o_orderdate, '%Y/%m')"


@query(
    f"""WITH x AS (SELECT CASE WHEN o_orderstatus = 'P' THEN '' WHEN o_orderpriority = '5-LOW' THEN replace({PERIOD}, '/', '')
            ELSE {PERIOD} END AS p, CAST(year(o_orderdate) AS VARCHAR) AS ano FROM orders)
        SELECT count(*) AS linhas, count(*) FILTER (WHERE regexp_matches(trim(p), '^[0-9]{{4}}/[0-9]{{2}}$')) AS formato_aaaa_pp,
            count(*) FILTER (WHERE NOT regexp_matches(trim(p), '^[0-9]{{4}}/[0-9]{{2}}$') AND trim(p) <> '') AS fora_do_formato,
            count(*) FILTER (WHERE substring(trim(p), 1, 4) = ano) AS exercicio_bate,
            count(*) FILTER (WHERE substring(trim(p), 1, 4) <> ano) AS exercicio_diverge FROM x"""
)
def period_key_projection(spark, d):
    o = table(spark, d, "orders")
    p = F.date_format(o.o_orderdate, "yyyy/MM")
    x = o.select(
        F.when(o.o_orderstatus == "P", "").when(o.o_orderpriority == "5-LOW", F.date_format(o.o_orderdate, "yyyyMM"))
        .otherwise(p).alias("cod_exercicio_periodo"),
        F.year(o.o_orderdate).cast("string").alias("num_exercicio"),
    )
    t = F.trim(x.cod_exercicio_periodo)
    good = t.rlike("^[0-9]{4}/[0-9]{2}$")
    return rules.comparison_counts(x, {
        "formato_aaaa_pp": good, "fora_do_formato": ~good & (t != ""),
        "exercicio_bate": F.substring(t, 1, 4) == x.num_exercicio,
        "exercicio_diverge": F.substring(t, 1, 4) != x.num_exercicio,
    })


def _pair_sql(q: str, v: str) -> str:
    return f"""SELECT '{q} / {v}' AS par, count(*) FILTER (WHERE {q} <> 0 OR {v} <> 0) AS linhas_com_estoque,
        count(*) FILTER (WHERE {q} = 0 AND {v} <> 0) AS qtd_zero_valor_nao, count(*) FILTER (WHERE {q} <> 0 AND {v} = 0) AS qtd_nao_valor_zero,
        count(*) FILTER (WHERE {q} < 0) AS qtd_negativa FROM lineitem"""


@query(_pair_sql("l_quantity", "l_extendedprice") + " UNION ALL " + _pair_sql("l_discount", "l_tax"))
def quantity_value_coherence(spark, d):
    return rules.quantity_value_coherence(
        table(spark, d, "lineitem"), [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax")]
    )


TRIPLE = """FROM lineitem JOIN part ON l_partkey = p_partkey"""


@query(
    f"""SELECT count(*) AS linhas, count(*) FILTER (WHERE l_quantity = p_size) AS igual, count(*) FILTER (WHERE l_quantity <> p_size) AS diferente,
        count(*) FILTER (WHERE l_quantity < p_size) AS parcial, count(*) FILTER (WHERE l_quantity > p_size) AS a_maior,
        count(*) FILTER (WHERE l_quantity = l_linenumber) AS igual_terceira,
        count(*) FILTER (WHERE l_quantity IS NULL OR l_quantity = 0) AS sem_quantidade {TRIPLE}"""
)
def quantity_triple(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    x = li.join(p, li.l_partkey == p.p_partkey)
    q, s = F.col("l_quantity"), F.col("p_size")
    return rules.comparison_counts(x, {
        "igual": q == s, "diferente": q != s, "parcial": q < s, "a_maior": q > s,
        "igual_terceira": q == F.col("l_linenumber"), "sem_quantidade": q.isNull() | (q == 0),
    })


@query(
    """SELECT count(*) AS linhas, count(*) FILTER (WHERE c_acctbal = s_acctbal) AS moedas_iguais,
        count(*) FILTER (WHERE c_acctbal < 0) AS debito_negativo, count(*) FILTER (WHERE s_acctbal > 0) AS credito_positivo,
        round(sum(c_acctbal), 2) AS soma_clientes FROM customer
        LEFT JOIN (SELECT s_nationkey, max(s_acctbal) AS s_acctbal FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey"""
)
def sign_and_currency(spark, d):
    # every customer beside the best balance among the suppliers of its country
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    x = c.join(s.groupBy("s_nationkey").agg(F.max("s_acctbal").alias("s_acctbal")), c.c_nationkey == F.col("s_nationkey"), "left")
    return rules.comparison_counts(x, {
        "moedas_iguais": F.col("c_acctbal") == F.col("s_acctbal"), "debito_negativo": F.col("c_acctbal") < 0,
        "credito_positivo": F.col("s_acctbal") > 0,
    }, {"soma_clientes": "c_acctbal"})


@query(
    f"""SELECT count(*) AS linhas, count(*) FILTER (WHERE l_extendedprice >= {NET}) AS bruto_maior_ou_igual,
        count(*) FILTER (WHERE l_extendedprice < {NET}) AS bruto_menor, count(*) FILTER (WHERE l_extendedprice = {NET}) AS iguais,
        count(*) FILTER (WHERE l_quantity <= 0) AS quantidade_nao_positiva, round(sum(l_extendedprice), 2) AS soma_bruto FROM lineitem"""
)
def gross_net(spark, d):
    li = table(spark, d, "lineitem")
    g, n = li.l_extendedprice, li.l_extendedprice * (1 - li.l_discount)
    return rules.comparison_counts(li, {
        "bruto_maior_ou_igual": g >= n, "bruto_menor": g < n, "iguais": g == n,
        "quantidade_nao_positiva": li.l_quantity <= 0,
    }, {"soma_bruto": "l_extendedprice"})


@query(
    """WITH x AS (SELECT trim(coalesce(dt_pedido, '')) NOT IN ('', '00000000') AS tem_data, trim(coalesce(cod_cliente, '')) <> '' AS tem_doc FROM pedidos)
        SELECT count(*) AS linhas, count(*) FILTER (WHERE tem_data) AS com_data, count(*) FILTER (WHERE tem_doc) AS com_doc,
            count(*) FILTER (WHERE tem_doc AND NOT tem_data) AS doc_sem_data, count(*) FILTER (WHERE tem_data AND NOT tem_doc) AS data_sem_doc FROM x""",
    ("pedidos",),
)
def paired_fields(spark, d):
    p = pedidos(spark, d)
    date, doc = ~F.trim(F.coalesce(p.dt_pedido, F.lit(""))).isin("", "00000000"), has_value(p.cod_cliente)
    return rules.comparison_counts(p, {
        "com_data": date, "com_doc": doc, "doc_sem_data": doc & ~date, "data_sem_doc": date & ~doc,
    })


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS vinculo, count(*) FILTER (WHERE {c} IS NULL OR trim({c}) = '') AS sem_vinculo,
        count(*) FILTER (WHERE trim(coalesce({c}, '')) <> '') AS com_vinculo,
        {pct_sql(f"count(*) FILTER (WHERE {c} IS NULL OR trim({c}) = '')", 'count(*)')} AS pct_sem_vinculo FROM pedidos"""
        for c in ("cod_cliente", "ind_aberto", "cod_obsoleto", "tp_prioridade")
    ),
    ("pedidos",),
)
def link_completeness(spark, d):
    return rules.link_completeness(pedidos(spark, d), ["cod_cliente", "ind_aberto", "cod_obsoleto", "tp_prioridade"])


FLAT = "SELECT l_orderkey, max(l_linenumber) AS qt_itens FROM lineitem GROUP BY 1"


def _flat(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("qt_itens"))


@query(
    f"""WITH x AS ({FLAT})
        SELECT count(*) AS linhas_na_view, CAST(sum(qt_itens) AS BIGINT) AS itens_na_origem, CAST(sum(qt_itens) - count(*) AS BIGINT) AS itens_descartados,
            CAST(sum(greatest(qt_itens - 1, 0)) AS BIGINT) AS itens_adicionais, {pct_sql('sum(qt_itens) - count(*)', 'sum(qt_itens)')} AS pct_descartado,
            count(*) FILTER (WHERE qt_itens > 1) AS com_varios_itens, count(*) FILTER (WHERE qt_itens = 1) AS com_item_unico,
            CAST(max(qt_itens) AS BIGINT) AS maior_qtd_itens FROM x"""
)
def flattening_loss(spark, d):
    return rules.flattening_loss(_flat(spark, d), "qt_itens")


@query(
    f"""WITH x AS ({FLAT}) SELECT CAST(qt_itens AS BIGINT) AS itens, count(*) AS linhas,
        CAST(qt_itens * count(*) - count(*) AS BIGINT) AS itens_perdidos FROM x GROUP BY qt_itens"""
)
def flattening_histogram(spark, d):
    return rules.flattening_histogram(_flat(spark, d), "qt_itens")


def _replication_sql(c: str) -> str:
    return f"""SELECT '{c}' AS campo, count(*) AS pais_com_valor, count(*) FILTER (WHERE v > 1) AS pais_com_mais_de_um_valor,
        CASE WHEN count(*) FILTER (WHERE v > 1) = 0 THEN 'REPLICACAO CONFIRMADA' ELSE 'ha variacao entre itens' END AS veredito
        FROM (SELECT count(DISTINCT {c}) AS v FROM j WHERE trim(coalesce(CAST({c} AS VARCHAR), '')) <> '' GROUP BY num_pedido)"""


@query(
    """WITH j AS (SELECT i.num_pedido, i.ind_devolucao, i.cod_fornecedor, p.cod_cliente, p.tp_prioridade
            FROM itens i JOIN pedidos p ON i.num_pedido = p.num_pedido) """
    + " UNION ALL ".join(_replication_sql(c) for c in ("cod_cliente", "tp_prioridade", "ind_devolucao", "cod_fornecedor")),
    ("itens", "pedidos"),
)
def header_replication(spark, d):
    j = itens(spark, d).join(pedidos(spark, d).select("num_pedido", "cod_cliente", "tp_prioridade"), "num_pedido")
    return rules.header_replication(j, "num_pedido", ["cod_cliente", "tp_prioridade", "ind_devolucao", "cod_fornecedor"])


@query(
    f"""WITH x AS (SELECT *, cod_cliente IS NULL AND ind_faturado IS NULL AS s FROM pedidos)
        SELECT count(*) AS linhas, count(*) FILTER (WHERE s) AS sem_cabecalho, {pct_sql('count(*) FILTER (WHERE s)', 'count(*)')} AS pct_sem_cabecalho,
            count(DISTINCT num_pedido) FILTER (WHERE s) AS pais_sem_cabecalho,
            count(*) FILTER (WHERE s AND tp_prioridade IS NULL) AS sem_cabecalho_e_sem_tp_prioridade FROM x""",
    ("pedidos",),
)
def orphan_items(spark, d):
    return rules.orphan_items(pedidos(spark, d), ["cod_cliente", "ind_faturado"], "num_pedido", "tp_prioridade")


@query(
    f"""SELECT count(*) AS total_tabela, count(*) FILTER (WHERE trim(coalesce(ind_devolucao, '')) = '') AS sem_valor,
        {pct_sql("count(*) FILTER (WHERE trim(coalesce(ind_devolucao, '')) = '')", 'count(*)')} AS pct_sem_valor,
        count(*) FILTER (WHERE ind_devolucao = 'A') AS linhas_do_cenario, {pct_sql("count(*) FILTER (WHERE ind_devolucao = 'A')", 'count(*)')} AS pct_do_total,
        count(*) FILTER (WHERE trim(coalesce(ind_devolucao, '')) <> '') AS total_com_valor FROM itens""",
    ("itens",),
)
def filter_impact(spark, d):
    return rules.filter_impact(itens(spark, d), "ind_devolucao", "A")


@query(
    """SELECT coalesce(nullif(trim(st_item), ''), '(vazio)') AS st_item, count(*) AS linhas_sem_valor,
        count(*) FILTER (WHERE trim(coalesce(num_pedido, '')) <> '') AS com_num_pedido,
        count(*) FILTER (WHERE trim(coalesce(dt_remessa, '')) <> '') AS com_dt_remessa
        FROM itens WHERE ind_devolucao IS NULL OR trim(ind_devolucao) = '' GROUP BY 1""",
    ("itens",),
)
def filter_impact_profile(spark, d):
    return rules.filter_impact_profile(itens(spark, d), "ind_devolucao", "st_item", ["num_pedido", "dt_remessa"])


CONV = "FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey"


def _requests(spark, d):
    o = table(spark, d, "orders")
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    return o.join(li, o.o_orderkey == li.l_orderkey, "left").withColumn("pedida", F.lit(100.0))


@query(
    f"""SELECT count(*) AS linhas, count(l_orderkey) AS convertidas, count(*) - count(l_orderkey) AS nao_convertidas,
        {pct_sql('count(l_orderkey)', 'count(*)')} AS pct_convertido, count(*) FILTER (WHERE q > 100) AS maior_que_solicitado,
        count(*) FILTER (WHERE q = 100) AS quantidades_iguais, count(*) FILTER (WHERE q < 100) AS menor_que_solicitado,
        count(*) - count(q) AS sem_quantidade {CONV}"""
)
def conversion(spark, d):
    return rules.conversion(_requests(spark, d), "l_orderkey", "q", "pedida")


@query(
    f"""SELECT o_orderstatus, count(*) AS linhas, count(*) FILTER (WHERE q = 0) AS nada_retirado,
        count(*) FILTER (WHERE q > 0 AND q < 100) AS parcial, count(*) FILTER (WHERE q = 100) AS total,
        count(*) FILTER (WHERE q > 100) AS a_maior {CONV} GROUP BY 1"""
)
def fulfilment(spark, d):
    return rules.fulfilment(_requests(spark, d), ["o_orderstatus"], "q", "pedida")


@query(
    f"""SELECT CASE WHEN trim(coalesce(ind_aberto, '')) <> '' THEN 'em aberto' WHEN trim(coalesce(cod_cliente, '')) <> '' THEN 'com cliente'
            WHEN vl_total > 400000 THEN 'valor alto' ELSE 'sem classificacao' END AS classificacao, count(*) AS linhas,
        {pct_sql('count(*)', '(SELECT count(*) FROM pedidos)')} AS pct FROM pedidos GROUP BY 1""",
    ("pedidos",),
)
def classify_first_match(spark, d):
    p = pedidos(spark, d)
    return rules.classify_first_match(
        p, {"em aberto": "ind_aberto", "com cliente": "cod_cliente", "valor alto": p.vl_total > 400000}
    )


@query(
    f"""SELECT o_orderstatus, o_orderpriority, count(*) AS linhas, {pct_sql('count(*)', '(SELECT count(*) FROM orders)')} AS pct
        FROM orders GROUP BY 1, 2"""
)
def status_matrix(spark, d):
    return rules.status_matrix(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


def _precision(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_extendedprice").cast("decimal(20,6)").alias("vl_exato"),
        (F.col("l_extendedprice").cast("decimal(16,4)") * F.col("l_discount").cast("decimal(3,2)")).cast("decimal(20,6)").alias("vl_desconto"),
    )


def _precision_sql(x: str, verdict: str) -> str:
    return f"""WITH x AS (SELECT {x} AS v FROM lineitem)
        SELECT count(*) AS linhas, count(*) - count(v) AS nulos, count(*) FILTER (WHERE v = 0) AS zerados, count(*) FILTER (WHERE v < 0) AS negativos,
            count(*) FILTER (WHERE v = round(v, 2)) AS cabem, count(*) FILTER (WHERE v <> round(v, 2)) AS usam_mais_casas,
            round(CAST(max(v) AS DOUBLE), 6) AS maximo, CASE WHEN count(*) FILTER (WHERE v <> round(v, 2)) = 0 THEN '{verdict}'
            ELSE 'as casas extras tem uso real' END AS veredito FROM x"""


OVER = "decimal(20,6) superdimensionado - 2 casas bastariam"


@query(_precision_sql("CAST(l_extendedprice AS DECIMAL(20, 6))", OVER))
def decimal_precision_use(spark, d):
    return rules.decimal_precision_use(_precision(spark, d), "vl_exato")


@query(_precision_sql("CAST(CAST(l_extendedprice AS DECIMAL(16, 4)) * CAST(l_discount AS DECIMAL(3, 2)) AS DECIMAL(20, 6))", OVER))
def decimal_precision_used(spark, d):
    return rules.decimal_precision_use(_precision(spark, d), "vl_desconto")


@query(
    f"""WITH x AS (SELECT c_acctbal AS v FROM customer)
        SELECT count(*) AS linhas, count(*) FILTER (WHERE v = 0) AS zero, {pct_sql('count(*) FILTER (WHERE v = 0)', 'count(*)')} AS pct_zero,
            count(*) FILTER (WHERE v > 0) AS positivo, {pct_sql('count(*) FILTER (WHERE v > 0)', 'count(*)')} AS pct_positivo,
            count(*) FILTER (WHERE v < 0) AS negativo, {pct_sql('count(*) FILTER (WHERE v < 0)', 'count(*)')} AS pct_negativo,
            count(*) - count(v) AS nulo, {pct_sql('count(*) - count(v)', 'count(*)')} AS pct_nulo, round(min(v), 3) AS menor FROM x"""
)
def sign_share(spark, d):
    return rules.sign_share(table(spark, d, "customer"), "c_acctbal")


@query(
    f"""WITH x AS (SELECT num_pedido, tp_prioridade, cod_cliente FROM pedidos)
        SELECT count(*) AS linhas, count(*) FILTER (WHERE trim(coalesce(tp_prioridade, '')) <> '') AS com_nome,
            count(*) FILTER (WHERE trim(coalesce(tp_prioridade, '')) = '') AS sem_nome,
            {pct_sql("count(*) FILTER (WHERE trim(coalesce(tp_prioridade, '')) <> '')", 'count(*)')} AS pct_cobertura,
            count(DISTINCT cod_cliente) AS codigos_distintos,
            count(DISTINCT cod_cliente) FILTER (WHERE trim(coalesce(tp_prioridade, '')) = '') AS codigos_sem_nome FROM x""",
    ("pedidos",),
)
def enrichment_coverage(spark, d):
    return rules.enrichment_coverage(pedidos(spark, d), "tp_prioridade", "cod_cliente")


@query(
    """SELECT campos AS itens, count(*) AS pais, CAST(sum(campos - 1) AS BIGINT) AS linhas_excedentes FROM
        (SELECT count(*) AS campos FROM conversations GROUP BY conv_id) GROUP BY 1"""
)
def audit_changes_per_document(spark, d):
    return keys.items_per_parent(table(spark, d, "conversations"), ["conv_id"])


@query(
    f"""SELECT event_type, count(*) AS linhas, count(DISTINCT user_id) AS documentos, {pct_sql('count(*)', '(SELECT count(*) FROM events)')} AS pct
        FROM events GROUP BY 1 ORDER BY linhas DESC, event_type LIMIT 20"""
)
def audit_most_changed(spark, d):
    return columns.distribution(
        table(spark, d, "events"), ["event_type"], 20, {"documentos": F.countDistinct("user_id")}
    )


@query(
    """SELECT count(DISTINCT c_name) AS c_name_distintos, count(*) FILTER (WHERE trim(coalesce(c_name, '')) = '') AS sem_c_name,
        count(DISTINCT c_mktsegment) AS c_mktsegment_distintos, count(*) FILTER (WHERE trim(coalesce(c_mktsegment, '')) = '') AS sem_c_mktsegment
        FROM customer"""
)
def pii_aggregate(spark, d):
    return rules.pii_aggregate(table(spark, d, "customer"), ["c_name", "c_mktsegment"])


@query(
    f"""WITH g AS (SELECT c_name, count(*) AS linhas FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
        SELECT substring(md5(c_name), 1, 8) AS c_name_hash, linhas, {pct_sql('linhas', '(SELECT sum(linhas) FROM g)')} AS pct FROM g
        ORDER BY linhas DESC, c_name_hash LIMIT 30"""
)
def masked_distribution(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return rules.masked_distribution(o.join(c, o.o_custkey == c.c_custkey), "c_name", k=30)


@query(
    """WITH g AS (SELECT cod_cliente, count(*) AS n FROM pedidos GROUP BY 1)
        SELECT CAST(sum(n) AS BIGINT) AS linhas, count(cod_cliente) AS pessoas, round(avg(n) FILTER (WHERE cod_cliente IS NOT NULL), 2) AS media_linhas_por_pessoa,
            max(n) FILTER (WHERE cod_cliente IS NOT NULL) AS maximo_linhas_por_pessoa FROM g""",
    ("pedidos",),
)
def rows_per_person(spark, d):
    return rules.rows_per_person(pedidos(spark, d), "cod_cliente")


@query(
    """SELECT count(*) AS linhas, count(DISTINCT l_orderkey) AS pedidos, count(DISTINCT (l_orderkey, l_linenumber)) AS itens,
        count(DISTINCT (l_orderkey, l_linenumber, l_partkey)) AS divisoes, count(DISTINCT l_suppkey) AS fornecedores FROM lineitem"""
)
def hierarchy_counts(spark, d):
    return volume.volumetry(table(spark, d, "lineitem"), {
        "pedidos": "l_orderkey", "itens": ["l_orderkey", "l_linenumber"],
        "divisoes": ["l_orderkey", "l_linenumber", "l_partkey"], "fornecedores": "l_suppkey",
    })


@query(
    """SELECT p_type, count(*) AS linhas, count(*) FILTER (WHERE p_retailprice IS NULL OR p_retailprice = 0) AS sem_preco,
        count(*) FILTER (WHERE p_retailprice < 0) AS preco_negativo, round(avg(p_retailprice), 2) AS preco_medio,
        round(quantile_disc(p_retailprice, 0.5), 2) AS mediana, round(max(p_retailprice), 2) AS maximo FROM part GROUP BY 1"""
)
def price_profile(spark, d):
    return rules.price_profile(table(spark, d, "part"), "p_type", "p_retailprice")


@query(
    """WITH x AS (SELECT l_extendedprice / l_quantity AS v, l_quantity AS q FROM lineitem)
        SELECT count(*) AS linhas, count(*) - count(v) AS nulos, count(*) FILTER (WHERE v = 0) AS zerados, count(*) FILTER (WHERE v < 0) AS negativos,
            round(min(v), 4) AS minimo, round(max(v), 4) AS maximo, round(avg(v), 4) AS media,
            count(*) FILTER (WHERE q IS NULL OR q = 0) AS divisor_zero_ou_nulo FROM x"""
)
def formula_profile(spark, d):
    # the median of a continuous value is a sketch estimate, so it is not compared here; formula_profile_median has it
    x = table(spark, d, "lineitem").select(
        F.try_divide("l_extendedprice", "l_quantity").alias("vl_preco_unitario"), "l_quantity"
    )
    return rules.formula_profile(x, "vl_preco_unitario", "l_quantity").drop("mediana")


@query(
    """WITH x AS (SELECT l_linenumber * 2 AS v, l_quantity AS q FROM lineitem)
        SELECT count(*) AS linhas, count(*) - count(v) AS nulos, count(*) FILTER (WHERE v = 0) AS zerados, count(*) FILTER (WHERE v < 0) AS negativos,
            CAST(min(v) AS DOUBLE) AS minimo, CAST(max(v) AS DOUBLE) AS maximo, round(avg(v), 4) AS media, CAST(quantile_disc(v, 0.5) AS DOUBLE) AS mediana,
            count(*) FILTER (WHERE q IS NULL OR q = 0) AS divisor_zero_ou_nulo FROM x"""
)
def formula_profile_median(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_linenumber") * 2).alias("v"), "l_quantity")
    return rules.formula_profile(x, "v", "l_quantity")


@query(
    """SELECT o_orderstatus, count(*) AS linhas, round(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice ELSE 0 END), 2) AS transporte,
        round(sum(CASE WHEN o_orderpriority BETWEEN '2-HIGH' AND '4-NOT SPECIFIED' THEN o_totalprice ELSE 0 END), 2) AS regulares,
        round(sum(CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice ELSE 0 END), 2) AS outros FROM orders GROUP BY 1"""
)
def split_by_period(spark, d):
    o = table(spark, d, "orders")
    p = o.o_orderpriority
    return rules.split_by_period(o, ["o_orderstatus"], "o_totalprice", {
        "transporte": p == "1-URGENT", "regulares": p.between("2-HIGH", "4-NOT SPECIFIED"), "outros": p == "5-LOW",
    })


@query(
    f"""SELECT st_pedido, count(*) AS linhas, count(*) - count(cod_cliente) AS sem_cod_cliente,
        {pct_sql('count(*) - count(cod_cliente)', 'count(*)', 1)} AS pct_sem_cod_cliente, count(*) - count(tp_prioridade) AS sem_tp_prioridade,
        {pct_sql('count(*) - count(tp_prioridade)', 'count(*)', 1)} AS pct_sem_tp_prioridade FROM pedidos GROUP BY 1""",
    ("pedidos",),
)
def null_share_by(spark, d):
    return rules.null_share_by(pedidos(spark, d), "st_pedido", ["cod_cliente", "tp_prioridade"])


@query(
    f"""SELECT CAST(l_suppkey AS VARCHAR) AS l_suppkey, count(*) AS linhas, count(DISTINCT l_orderkey) AS documentos,
        round(sum(l_extendedprice), 2) AS valor_total, {pct_sql('count(*)', '(SELECT count(*) FROM lineitem)')} AS pct
        FROM lineitem GROUP BY lineitem.l_suppkey ORDER BY linhas DESC, CAST(lineitem.l_suppkey AS VARCHAR) LIMIT 50"""
)
def dimension_ranking(spark, d):
    return rules.dimension_ranking(table(spark, d, "lineitem"), "l_suppkey", "l_orderkey", "l_extendedprice", k=50)


@query(
    """SELECT count(*) AS linhas, count(*) FILTER (WHERE num_pedido IS NULL OR trim(num_pedido) = '') AS num_pedido_ausente,
        count(*) FILTER (WHERE cod_cliente IS NULL OR trim(cod_cliente) = '') AS cod_cliente_ausente,
        count(*) FILTER (WHERE trim(coalesce(dt_pedido, '')) <> '' AND NOT regexp_matches(trim(dt_pedido), '^[0-9]{8}$')) AS dt_pedido_formato_invalido
        FROM pedidos""",
    ("pedidos",),
)
def required_keys(spark, d):
    return rules.required_keys(pedidos(spark, d), ["num_pedido", "cod_cliente"], {"dt_pedido": "^[0-9]{8}$"})


@query(
    f"""SELECT coalesce(nullif(trim(ind_devolucao), ''), '(vazio)') AS ind_devolucao, count(*) AS linhas, round(sum(vl_bruto), 2) AS custo_total,
        {pct_sql('count(*)', '(SELECT count(*) FROM itens)')} AS pct FROM itens GROUP BY 1""",
    ("itens",),
)
def revision_split(spark, d):
    return columns.distribution(
        itens(spark, d), ["ind_devolucao"], 40, {"custo_total": F.round(F.sum(F.coalesce("vl_bruto", F.lit(0))), 2)}
    )


@query(
    """SELECT st_pedido, ind_faturado, count(*) AS linhas, count(DISTINCT cod_cliente) AS clientes,
        count(*) FILTER (WHERE trim(coalesce(ind_aberto, '')) <> '') AS abertos,
        count(*) FILTER (WHERE trim(coalesce(dt_pedido, '')) <> '' AND CAST(try_strptime(dt_pedido, '%d/%m/%Y') AS DATE) IS NULL) AS datas_invalidas
        FROM pedidos GROUP BY 1, 2""",
    ("pedidos",),
)
def master_data_metrics(spark, d):
    p = pedidos(spark, d)
    return volume.group_metrics(p, ["st_pedido", "ind_faturado"], {
        "clientes": F.countDistinct("cod_cliente"),
        "abertos": count_if(has_value(p.ind_aberto)),
        "datas_invalidas": count_if(has_value(p.dt_pedido) & F.try_to_date(p.dt_pedido, "dd/MM/yyyy").isNull()),
    })
