"""Volume, scenario and column-profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from crivo.functions.dates import compact_date
from crivo.functions.missing import no_value
from crivo.functions.ratios import count_if
from crivo.operators import codes, columns, dates, volume
from crivo.sources import scan

from .base import eventos, itens, pct_sql, pedidos, query, table

TOK8 = "('', 'null', 'nan', 'none', '#', '-', 'na', 'n/a')"
TOK6 = "('', 'null', 'nan', 'none', '#', '-')"
ZERO = "'^0+([.,]0+)?$'"


def _fill_part(src: str, c: str, tipo: str, tokens: str = TOK8) -> str:
    if tipo == "string":
        blank = f"count(*) FILTER (WHERE lower(trim({c})) IN {tokens})"
        zero = f"count(*) FILTER (WHERE regexp_matches(trim({c}), {ZERO}))"
    elif tipo in ("double", "int", "bigint"):
        blank, zero = "CAST(0 AS BIGINT)", f"count(*) FILTER (WHERE {c} = 0)"
    else:
        blank = zero = "CAST(0 AS BIGINT)"
    return (
        f"SELECT '{c}' AS coluna, '{tipo}' AS tipo, count(*) AS total, count(*) - count({c}) AS nulos, "
        f"{blank} AS vazios, {zero} AS zeros FROM {src}"
    )


def _fill_sql(src: str, cols: dict[str, str], tokens: str = TOK8) -> str:
    return " UNION ALL ".join(_fill_part(src, c, t, tokens) for c, t in cols.items())


def _fill_f1(src: str, cols: dict[str, str]) -> str:
    u = "total - nulos - vazios - zeros"
    return f"""
        WITH p AS ({_fill_sql(src, cols)})
        SELECT coluna, tipo, nulos, vazios, zeros, {u} AS uteis, {pct_sql(u, 'total')} AS pct_util,
               CASE WHEN nulos = total THEN '1. 100% NULO' WHEN {u} <= 0 THEN '2. SEM VALOR UTIL'
                    WHEN ({u}) * 100 < total THEN '3. QUASE VAZIO (<1%)' ELSE '9. ok' END AS veredito
        FROM p"""


PEDIDO_COLS = {
    "num_pedido": "string", "cod_cliente": "string", "dt_pedido": "string", "tp_prioridade": "string",
    "ind_faturado": "boolean", "ind_aberto": "string", "st_pedido": "string", "vl_total": "double",
    "vl_texto": "string", "cod_obsoleto": "string", "dt_carga": "date",
}
LINEITEM_COLS = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}
DOCUMENT_COLS = {
    "doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint",
}


@query(_fill_f1("pedidos", PEDIDO_COLS), ("pedidos",))
def fill_scan(spark, d):
    return columns.fill_scan(pedidos(spark, d))


@query(_fill_f1("lineitem", LINEITEM_COLS))
def fill_scan_lineitem(spark, d):
    return columns.fill_scan(table(spark, d, "lineitem"))


# As many text columns as the widest profiled table has, derived from the line items.
WIDE = 93


def _wide_sql(i: int) -> str:
    blank = "''" if i % 3 else "CAST(l_quantity AS BIGINT) % 3"
    return f"CASE WHEN l_linenumber = {i % 7 + 1} THEN NULL WHEN l_partkey % {i + 2} = 0 THEN CAST({blank} AS VARCHAR) ELSE l_returnflag || CAST(l_suppkey % {i + 2} AS VARCHAR) END AS ds_{i:02d}"


@query(
    _fill_f1("largo", {f"ds_{i:02d}": "string" for i in range(WIDE)}).replace(
        "WITH p AS", f"WITH largo AS (SELECT {', '.join(_wide_sql(i) for i in range(WIDE))} FROM lineitem), p AS", 1)
)
def fill_scan_wide(spark, d):
    li = table(spark, d, "lineitem")
    cell = lambda i: (
        F.when(li.l_linenumber == i % 7 + 1, F.lit(None).cast("string"))
        .when(li.l_partkey % (i + 2) == 0, F.lit("") if i % 3 else (li.l_quantity.cast("bigint") % 3).cast("string"))
        .otherwise(F.concat(li.l_returnflag, (li.l_suppkey % (i + 2)).cast("string"))))
    return columns.fill_scan(li.select(*[cell(i).alias(f"ds_{i:02d}") for i in range(WIDE)]))


@query(_fill_f1("documents", DOCUMENT_COLS))
def fill_scan_documents(spark, d):
    return columns.fill_scan(table(spark, d, "documents"))


@query(
    f"""WITH p AS ({_fill_sql('pedidos', PEDIDO_COLS, TOK6)})
        SELECT coluna, tipo, total, nulos, vazios, zeros, total - nulos - vazios AS preenchidos_nao_vazios,
               CASE WHEN total = 0 THEN 'SEM LINHAS' WHEN nulos = total THEN '100% NULO - CONFERIR COMENTARIO'
                    WHEN nulos + vazios = total THEN '100% SEM VALOR UTIL - CONFERIR' ELSE 'COM DADOS' END AS veredito
        FROM p""",
    ("pedidos",),
)
def fill_scan_f3(spark, d):
    return columns.fill_scan(pedidos(spark, d), mode="f3")


def _dev2_part(c: str, tipo: str) -> str:
    t = f"trim(CAST({c} AS VARCHAR))"
    null = f"({c} IS NULL OR lower({t}) IN {TOK6})"
    zero = f"{t} IN ('0', '0.0', '0.00', '0.000', '000', '0000')"
    n = f"count(*) FILTER (WHERE {null})"
    return f"""SELECT '{c}' AS coluna, '{tipo}' AS tipo, count(*) AS total, {n} AS nulos,
        count(*) FILTER (WHERE NOT {null} AND {zero}) AS zeros,
        count(*) FILTER (WHERE NOT {null} AND NOT {zero}) AS uteis,
        {pct_sql(n, 'count(*)', 4)} AS pct_nulos, count(DISTINCT {c}) AS distintos FROM pedidos"""


@query(" UNION ALL ".join(_dev2_part(c, t) for c, t in PEDIDO_COLS.items()), ("pedidos",))
def fill_scan_dev2(spark, d):
    return columns.fill_scan(pedidos(spark, d), mode="dev2")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS coluna, count(*) - count({c}) AS nulos, count({c}) AS preenchidos, "
        f"{pct_sql(f'count({c})', 'count(*)')} AS pct_preenchido FROM pedidos"
        for c in PEDIDO_COLS
    ),
    ("pedidos",),
)
def fill_scan_simple(spark, d):
    return columns.fill_scan(pedidos(spark, d), mode="simple")


@query(
    "SELECT count(*) AS total_linhas, " + ", ".join(
        f"{pct_sql(f'count(*) - count({c})', 'count(*)')} AS pct_null_{c}"
        for c in ("cod_cliente", "tp_prioridade", "ind_faturado", "cod_obsoleto")
    ) + " FROM pedidos",
    ("pedidos",),
)
def null_pct(spark, d):
    return columns.null_pct(pedidos(spark, d), ["cod_cliente", "tp_prioridade", "ind_faturado", "cod_obsoleto"])


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS coluna, count(*) AS total, count(*) - count({c}) AS nulos,
        count(*) FILTER (WHERE {c} IS NOT NULL AND lower(trim({c})) NOT IN {TOK6}) AS preenchidos,
        CASE WHEN count(*) FILTER (WHERE {c} IS NOT NULL AND lower(trim({c})) NOT IN {TOK6}) = 0
             THEN 'CONFIRMADO - 100% nula' ELSE 'DIVERGE - ha valores' END AS veredito FROM pedidos"""
        for c in ("cod_obsoleto", "ind_aberto")
    ),
    ("pedidos",),
)
def declared_empty(spark, d):
    return columns.declared_empty(pedidos(spark, d), ["cod_obsoleto", "ind_aberto"])


# --- cardinality and domain ---------------------------------------------------

CARD_LADDER = """CASE WHEN distintos <= 1 THEN '1. CONSTANTE (1 valor)'
    WHEN distintos <= 3 THEN '2. cardinalidade muito baixa'
    WHEN distintos * 100 > total * 95 THEN '3. candidata a identificador' ELSE '9. normal' END"""


@query(
    "WITH c AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS coluna, '{t}' AS tipo, count(DISTINCT {c}) AS distintos, count(*) AS total FROM lineitem"
        for c, t in LINEITEM_COLS.items()
    ) + f""") SELECT coluna, tipo, distintos, {pct_sql('distintos', 'total', 4)} AS pct_distintos,
        {CARD_LADDER} AS classificacao FROM c"""
)
def cardinality_exact(spark, d):
    return columns.cardinality(table(spark, d, "lineitem"), exact=True)


LINE_COLS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
)


@query(
    " UNION ALL ".join(f"SELECT '{c}' AS coluna, count(DISTINCT {c}) AS exatos, true AS estimativa_proxima FROM lineitem" for c in LINE_COLS)
)
def cardinality_approx(spark, d):
    # an estimate has no SQL twin; that it lies within three standard errors (5 % each) of the exact count has
    li = table(spark, d, "lineitem").select(*LINE_COLS)
    exact = columns.cardinality(li, exact=True).select("coluna", F.col("distintos").alias("exatos"))
    near = F.abs(F.col("distintos") - F.col("exatos")) <= 0.15 * F.col("exatos")
    return columns.cardinality(li).join(exact, "coluna").select("coluna", "exatos", near.alias("estimativa_proxima"))


CODE_COLS = ("num_pedido", "cod_cliente", "tp_prioridade", "st_pedido", "ind_aberto", "cod_obsoleto")


@query(
    "WITH c AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS coluna, count(DISTINCT {c}) AS distintos, count(*) AS total FROM pedidos" for c in CODE_COLS
    ) + """) SELECT coluna, distintos, total,
        CASE WHEN distintos <= 1 THEN 'CONSTANTE OU VAZIO' WHEN distintos <= 20 THEN 'BAIXA CARDINALIDADE'
             WHEN distintos * 10 >= total * 9 THEN 'CANDIDATO A IDENTIFICADOR' ELSE 'INTERMEDIARIA' END AS perfil
        FROM c""",
    ("pedidos",),
)
def cardinality_f3(spark, d):
    return columns.cardinality(pedidos(spark, d), list(CODE_COLS), exact=True, mode="f3")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS coluna, count(DISTINCT {c}) AS distintos FROM documents" for c in ("lang", "source", "text")
    )
)
def distinct_values(spark, d):
    return volume.distinct_values(table(spark, d, "documents"), ["lang", "source", "text"])


def _domain_sql(src: str, cols, k: int) -> str:
    freq = " UNION ALL ".join(
        f"SELECT '{c}' AS coluna, CAST({c} AS VARCHAR) AS valor, count(*) AS qtd FROM {src} GROUP BY ALL" for c in cols
    )
    return f"""WITH f AS ({freq}),
        r AS (SELECT *, row_number() OVER (PARTITION BY coluna ORDER BY qtd DESC, valor NULLS FIRST) AS rn FROM f)
        SELECT coluna, valor, qtd, {pct_sql('qtd', f'(SELECT count(*) FROM {src})')} AS pct FROM r WHERE rn <= {k}"""


@query(_domain_sql("pedidos", ("tp_prioridade", "st_pedido", "ind_aberto", "cod_cliente"), 8), ("pedidos",))
def domain(spark, d):
    return columns.domain(pedidos(spark, d), ["tp_prioridade", "st_pedido", "ind_aberto", "cod_cliente"], k=8)


@query(_domain_sql("documents", ("lang", "source"), 20))
def domain_documents(spark, d):
    return columns.domain(table(spark, d, "documents"), ["lang", "source"], k=20)


@query(
    f"""SELECT 'ind_faturado' AS flag, count(*) FILTER (WHERE ind_faturado) AS verdadeiro,
        count(*) FILTER (WHERE NOT ind_faturado) AS falso, count(*) - count(ind_faturado) AS nulo,
        {pct_sql('count(*) FILTER (WHERE ind_faturado)', 'count(*)')} AS pct_verdadeiro FROM pedidos""",
    ("pedidos",),
)
def flag_profile(spark, d):
    return columns.flag_profile(pedidos(spark, d))


BUCKET = "coalesce(nullif(trim(CAST({0} AS VARCHAR)), ''), '(vazio)')"


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS coluna, {BUCKET.format(c)} AS valor, count(*) AS linhas FROM pedidos GROUP BY ALL"
        for c in ("ind_aberto", "st_pedido")
    ),
    ("pedidos",),
)
def string_flag_domain(spark, d):
    return columns.string_flag_domain(pedidos(spark, d), ["ind_aberto", "st_pedido"])


@query(
    f"""SELECT coalesce(nullif(trim(ind_aberto), ''), '<VAZIO>') AS ind_aberto,
        coalesce(nullif(trim(st_pedido), ''), '<VAZIO>') AS st_pedido, count(*) AS qtd FROM pedidos GROUP BY 1, 2""",
    ("pedidos",),
)
def string_flag_combination(spark, d):
    return columns.string_flag_domain(
        pedidos(spark, d), ["ind_aberto", "st_pedido"], combine=True, label="<VAZIO>"
    )


# --- numbers -----------------------------------------------------------------

NUM_COLS = {"l_quantity": "double", "l_discount": "double", "l_tax": "double", "l_linenumber": "int"}


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS coluna, '{t}' AS tipo, count({c}) AS preenchidos, CAST(min({c}) AS DOUBLE) AS minimo,
        CAST(max({c}) AS DOUBLE) AS maximo, round(avg({c}), 4) AS media,
        CAST(quantile_disc({c}, 0.5) AS DOUBLE) AS mediana, CAST(quantile_disc({c}, 0.95) AS DOUBLE) AS p95,
        count(*) FILTER (WHERE {c} < 0) AS negativos, count(*) FILTER (WHERE {c} = 0) AS zeros FROM lineitem"""
        for c, t in NUM_COLS.items()
    )
)
def numeric_profile(spark, d):
    # few distinct values: the rank error of the sketch cannot leave a run of equal values
    return columns.numeric_profile(table(spark, d, "lineitem"), list(NUM_COLS))


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS coluna, 'double' AS tipo, count({c}) AS preenchidos, min({c}) AS minimo,
        max({c}) AS maximo, round(avg({c}), 4) AS media, round(sum({c}), 2) AS soma,
        count(*) FILTER (WHERE {c} > 0) AS positivos, count(*) FILTER (WHERE {c} < 0) AS negativos,
        count(*) FILTER (WHERE {c} = 0) AS zeros FROM lineitem"""
        for c in ("l_extendedprice", "l_quantity")
    )
)
def numeric_profile_sums(spark, d):
    li = table(spark, d, "lineitem")
    out = columns.numeric_profile(li, ["l_extendedprice", "l_quantity"], mode="sum")
    return out.withColumn("soma", F.round("soma", 2))


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS coluna, round(sum({c}), 2) AS total_arredondado, count({c}) AS linhas_preenchidas
        FROM lineitem"""
        for c in ("l_quantity", "l_extendedprice")
    )
)
def totals(spark, d):
    # the unrounded double depends on the order of the additions, so it is left out here; totals_all_columns has it
    return columns.totals(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]).drop("total_numerico")


MONEY = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS coluna, CAST(sum({x}) AS DOUBLE) AS total_numerico, round(CAST(sum({x}) AS DOUBLE), 2) AS total_arredondado,
            count({c}) AS linhas_preenchidas FROM lineitem"""
        for c, x in [(c, f"CAST({c} AS HUGEINT)") for c in LINE_COLS[:4]] + [(c, f"CAST({c} AS DECIMAL(18, 2))") for c in MONEY]
    )
)
def totals_all_columns(spark, d):
    li = table(spark, d, "lineitem")
    return columns.totals(li.withColumns({c: F.col(c).cast("decimal(18,2)") for c in MONEY}))


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS coluna, round(sum({c}), 2) AS total_completo,
        round(sum({c}) FILTER (WHERE l_linestatus = 'O'), 2) AS total_aberto,
        round(sum({c}) FILTER (WHERE l_linestatus = 'O' AND l_returnflag = 'R'), 2) AS total_tela FROM lineitem"""
        for c in ("l_quantity", "l_extendedprice")
    )
)
def totals_scopes(spark, d):
    li = table(spark, d, "lineitem")
    opened = li.l_linestatus == "O"
    return columns.totals(li, ["l_quantity", "l_extendedprice"], scopes={
        "completo": F.lit(True), "aberto": opened, "tela": opened & (li.l_returnflag == "R"),
    })


@query(
    """SELECT o_orderstatus, o_orderpriority, count(*) AS linhas, round(sum(o_totalprice), 2) AS soma_o_totalprice,
        CAST(sum(CAST(o_totalprice AS DECIMAL(18, 3))) AS DOUBLE) AS soma_decimal_o_totalprice
        FROM orders GROUP BY ALL"""
)
def totals_by_decimal(spark, d):
    return columns.totals(table(spark, d, "orders"), ["o_totalprice"], by=["o_orderstatus", "o_orderpriority"], decimal=True)


@query(
    """SELECT c_nationkey, count(*) AS linhas, round(sum(c_acctbal), 2) AS soma_c_acctbal
        FROM customer GROUP BY ALL"""
)
def totals_by_plant(spark, d):
    return columns.totals(table(spark, d, "customer"), ["c_acctbal"], by=["c_nationkey"])


@query(
    """WITH j AS (SELECT o_orderkey, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
        k AS (SELECT o_orderkey, sum(o_totalprice) AS s, max(o_totalprice) AS m FROM j GROUP BY 1)
        SELECT 'o_totalprice' AS coluna, round(sum(s), 2) AS soma_ingenua, round(sum(m), 2) AS soma_dedup,
               round(round(sum(s), 2) - round(sum(m), 2), 2) AS diferenca FROM k"""
)
def dedup_total(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey).select("o_orderkey", "o_totalprice")
    return columns.dedup_total(j, ["o_orderkey"], ["o_totalprice"])


def _distribution_sql(src: str, dims, k: int) -> str:
    keys = ", ".join(f"{BUCKET.format(c)} AS {c}" for c in dims)
    order = ", ".join(dims)
    return f"""WITH g AS (SELECT {keys}, count(*) AS linhas FROM {src} GROUP BY ALL)
        SELECT *, {pct_sql('linhas', f'(SELECT count(*) FROM {src})')} AS pct FROM g
        ORDER BY linhas DESC, {order} LIMIT {k}"""


@query(_distribution_sql("pedidos", ("tp_prioridade",), 40), ("pedidos",))
def distribution(spark, d):
    return columns.distribution(pedidos(spark, d), ["tp_prioridade"], k=40)


@query(_distribution_sql("documents", ("lang", "source"), 25))
def distribution_multi(spark, d):
    return columns.distribution(table(spark, d, "documents"), ["lang", "source"], k=25)


# --- dates and times -----------------------------------------------------------


def _string_date_sql(src: str, c: str) -> str:
    t = f"trim({c})"
    f = {
        "fmt_aaaammdd": f"count(*) FILTER (WHERE regexp_matches({t}, '^[0-9]{{8}}$'))",
        "fmt_iso": f"count(*) FILTER (WHERE regexp_matches({t}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'))",
        "fmt_br": f"count(*) FILTER (WHERE regexp_matches({t}, '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}'))",
    }
    blank = f"count(*) FILTER (WHERE {c} IS NULL OR {t} = '')"
    dated = f"FILTER (WHERE {t} NOT IN ('', '00000000'))"
    used = " + ".join(f"CAST({x} > 0 AS INTEGER)" for x in f.values())
    return f"""SELECT '{c}' AS coluna, {blank} AS vazios, {', '.join(f'{x} AS {n}' for n, x in f.items())},
        count(*) FILTER (WHERE {t} IN ('00000000', '0000-00-00', '0')) AS data_zero,
        count(*) - {blank} - {' - '.join(f.values())} AS nao_reconhecido,
        min({c}) {dated} AS minimo, max({c}) {dated} AS maximo,
        CASE WHEN {used} > 1 THEN 'ALERTA: mais de um formato na mesma coluna' ELSE 'formato unico' END AS veredito
        FROM {src}"""


@query(_string_date_sql("pedidos", "dt_pedido"), ("pedidos",))
def string_date_profile(spark, d):
    return dates.string_date_profile(pedidos(spark, d), ["dt_pedido"])


@query(_string_date_sql("itens", "dt_remessa"), ("itens",))
def string_date_profile_single(spark, d):
    return dates.string_date_profile(itens(spark, d), ["dt_remessa"])


@query(
    """SELECT CASE WHEN dt_pedido IS NULL OR trim(dt_pedido) = '' THEN 'VAZIA' WHEN dt_pedido = '00000000' THEN '00000000'
        WHEN dt_pedido = '9999-12-31' THEN '9999-12-31' WHEN regexp_matches(dt_pedido, '^[0-9]{8}$') THEN 'AAAAMMDD'
        WHEN regexp_matches(dt_pedido, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN 'AAAA-MM-DD' ELSE 'OUTRO' END AS formato,
        count(*) AS linhas, min(dt_pedido) AS exemplo_min, max(dt_pedido) AS exemplo_max FROM pedidos GROUP BY 1""",
    ("pedidos",),
)
def date_format_classes(spark, d):
    return dates.date_format_classes(pedidos(spark, d), "dt_pedido")


@query(
    """WITH x AS (SELECT trim(dt_pedido) AS t,
            CASE WHEN regexp_matches(trim(dt_pedido), '^[0-9]{8}$') AND trim(dt_pedido) <> '00000000'
                 THEN CAST(try_strptime(trim(dt_pedido), '%Y%m%d') AS DATE) END AS dt FROM pedidos)
        SELECT 'dt_pedido' AS coluna, min(dt) AS minima_valida, max(dt) AS maxima_valida,
            count(*) FILTER (WHERE t IS NULL OR t IN ('', '00000000')) AS vazia_ou_zerada,
            count(*) FILTER (WHERE t NOT IN ('', '00000000') AND dt IS NULL) AS invalida FROM x""",
    ("pedidos",),
)
def valid_date_range(spark, d):
    return dates.valid_date_range(pedidos(spark, d), ["dt_pedido"])


@query(
    """SELECT 'o_orderdate' AS coluna, count(*) - count(o_orderdate) AS nulos,
        CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) AS minimo, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS maximo,
        count(DISTINCT CAST(o_orderdate AS DATE)) AS distintas,
        count(*) FILTER (WHERE CAST(o_orderdate AS DATE) > DATE '2000-01-01') AS futuras FROM orders"""
)
def native_date_profile(spark, d):
    return dates.native_date_profile(table(spark, d, "orders"), ["o_orderdate"], as_of="2000-01-01")


@query(
    """SELECT 'ts' AS coluna, count(*) - count(ts) AS nulos, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS minimo,
        strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS maximo, count(DISTINCT ts) AS distintos FROM events"""
)
def timestamp_profile(spark, d):
    return dates.timestamp_profile(table(spark, d, "events"), ["ts"])


@query(
    """SELECT 'hr_evento' AS coluna, count(*) FILTER (WHERE hr_evento IS NULL OR trim(hr_evento) = '') AS vazios,
        count(*) FILTER (WHERE regexp_matches(trim(hr_evento), '^[0-9]{6}$')) AS fmt_hhmmss,
        count(*) FILTER (WHERE regexp_matches(trim(hr_evento), '^[0-9]{2}:[0-9]{2}')) AS fmt_hh_mm,
        count(DISTINCT hr_evento) AS distintos FROM eventos""",
    ("eventos",),
)
def time_profile(spark, d):
    return dates.time_profile(eventos(spark, d), ["hr_evento"])


@query(
    """SELECT 'ts' AS coluna, count(*) AS linhas, CAST(min(ts) AS DATE) AS primeira_carga, CAST(max(ts) AS DATE) AS ultima_carga,
        CAST(date_diff('day', CAST(max(ts) AS DATE), DATE '2024-03-01') AS INTEGER) AS dias_desde_carga,
        count(DISTINCT CAST(ts AS DATE)) AS dias_distintos_carga FROM events"""
)
def freshness(spark, d):
    return dates.freshness(table(spark, d, "events"), ["ts"], as_of="2024-03-01")


@query(
    """SELECT CAST(ts AS DATE) AS data_carga, count(*) AS linhas, count(DISTINCT user_id) AS usuarios
        FROM events GROUP BY 1"""
)
def freshness_by_day(spark, d):
    return dates.freshness_by_day(table(spark, d, "events"), "ts", {"usuarios": F.countDistinct("user_id")})


@query("SELECT CAST('2024-03-01' AS VARCHAR) AS instante, count(*) AS linhas FROM events")
def freshness_as_of(spark, d):
    out = dates.freshness_as_of(table(spark, d, "events"), "2024-03-01")
    return out.withColumn("instante", F.date_format("instante", "yyyy-MM-dd"))


@query(
    """SELECT CAST(min(ts) AS DATE) AS primeira_carga, CAST(max(ts) AS DATE) AS ultima_carga,
        count(DISTINCT CAST(ts AS DATE)) AS cargas_distintas,
        CASE WHEN count(DISTINCT CAST(ts AS DATE)) = 1 THEN 'SNAPSHOT - substitui a cada carga; chave NAO precisa da data'
             ELSE 'HISTORICO - acumula; a chave DEVE incluir ts' END AS veredito FROM events"""
)
def snapshot_or_history(spark, d):
    return dates.snapshot_or_history(table(spark, d, "events"), "ts")


@query(
    """WITH x AS (SELECT CAST(try_strptime(dt_remessa, '%Y%m%d') AS DATE) AS dt FROM itens)
        SELECT min(dt) AS primeira_data, max(dt) AS ultima_data, count(DISTINCT dt) AS dias_com_dado,
            CAST(date_diff('day', min(dt), max(dt)) + 1 AS INTEGER) AS dias_do_periodo,
            date_diff('day', min(dt), max(dt)) + 1 - count(DISTINCT dt) AS dias_sem_dado FROM x""",
    ("itens",),
)
def temporal_coverage(spark, d):
    return dates.temporal_coverage(itens(spark, d), "dt_remessa")


@query(
    """WITH j AS (SELECT CAST(o_orderdate AS DATE) AS a, CAST(try_strptime(dt_remessa, '%Y%m%d') AS DATE) AS b,
            DATE '1998-01-01' AS c FROM itens JOIN orders ON num_pedido = lpad(CAST(o_orderkey AS VARCHAR), 10, '0'))
        SELECT 'pedido <= remessa' AS regra, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS avaliadas,
            count(*) FILTER (WHERE a > b) AS violacoes FROM j
        UNION ALL SELECT 'remessa <= corte', count(*) FILTER (WHERE b IS NOT NULL), count(*) FILTER (WHERE b > c) FROM j""",
    ("itens",),
)
def date_order(spark, d):
    i, o = itens(spark, d), table(spark, d, "orders")
    j = i.join(o, i.num_pedido == F.lpad(o.o_orderkey.cast("string"), 10, "0")).withColumn(
        "dt_corte", F.lit("1998-01-01").cast("date")
    )
    return dates.date_order(j, {
        "pedido <= remessa": ("o_orderdate", "dt_remessa"), "remessa <= corte": ("dt_remessa", "dt_corte"),
    })


@query(
    """WITH j AS (SELECT CAST(o_orderdate AS DATE) AS a, CAST(l_shipdate AS DATE) AS b
            FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
        l AS (SELECT *, date_diff('day', a, b) AS lag FROM j)
        SELECT count(*) AS linhas, count(*) - count(a) AS sem_inicio, count(*) - count(b) AS sem_fim,
            count(*) FILTER (WHERE lag < 0) AS fim_antes_do_inicio, round(avg(lag), 1) AS media_dias,
            CAST(min(lag) AS INTEGER) AS menor_dias, CAST(max(lag) AS INTEGER) AS maior_dias,
            CAST(quantile_disc(lag, 0.5) FILTER (WHERE lag >= 0) AS INTEGER) AS mediana_dias,
            CAST(quantile_disc(lag, 0.95) FILTER (WHERE lag >= 0) AS INTEGER) AS p95_dias FROM l"""
)
def day_lag(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return dates.day_lag(j, "o_orderdate", "l_shipdate")


@query(
    f"""WITH x AS (SELECT CASE WHEN o_orderstatus = 'O' THEN DATE '9999-12-31' WHEN o_orderstatus = 'P' THEN NULL
            ELSE CAST(o_orderdate AS DATE) END AS dt, CAST(o_orderdate AS DATE) AS s FROM orders)
        SELECT count(*) AS linhas, count(*) FILTER (WHERE dt = DATE '9999-12-31') AS sem_prazo_definido,
            {pct_sql("count(*) FILTER (WHERE dt = DATE '9999-12-31')", 'count(*)', 4)} AS pct_sem_prazo,
            count(*) - count(dt) AS data_nula, min(dt) FILTER (WHERE dt <> DATE '9999-12-31') AS mais_antiga,
            max(dt) FILTER (WHERE dt <> DATE '9999-12-31') AS mais_recente,
            count(*) FILTER (WHERE dt < s) AS antes_do_inicio FROM x"""
)
def sentinel_share(spark, d):
    o = table(spark, d, "orders")
    x = o.select(
        F.when(o.o_orderstatus == "O", F.lit("9999-12-31").cast("date"))
        .when(o.o_orderstatus == "F", o.o_orderdate.cast("date")).alias("dt_prazo"),
        o.o_orderdate.cast("date").alias("dt_criacao"),
    )
    return dates.sentinel_share(x, "dt_prazo", "dt_criacao")


@query(
    """SELECT strftime(o_orderdate, '%Y%m') AS periodo, count(*) AS linhas, count(DISTINCT o_custkey) AS entidades,
        CAST(min(o_orderdate) AS DATE) AS data_min, CAST(max(o_orderdate) AS DATE) AS data_max
        FROM orders GROUP BY 1"""
)
def period_windows(spark, d):
    o = table(spark, d, "orders").withColumn("dia", F.col("o_orderdate").cast("date"))
    return dates.period_windows(o, F.date_format("o_orderdate", "yyyyMM"), "o_custkey", "dia")


@query(
    """WITH w AS (SELECT value, CAST(ts AS DATE) AS dt, lag(value) OVER u AS ant, lag(CAST(ts AS DATE)) OVER u AS dt_ant
            FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT count(ant) AS transicoes, count(*) FILTER (WHERE abs(value - ant) <= 10) AS continuas,
            count(*) FILTER (WHERE abs(value - ant) > 10) AS quebradas,
            count(*) FILTER (WHERE date_diff('day', dt_ant, dt) > 1) AS com_lacuna_de_dias,
            CAST(max(date_diff('day', dt_ant, dt)) AS INTEGER) AS maior_lacuna_dias, CAST(0 AS BIGINT) AS sem_data FROM w"""
)
def series_continuity(spark, d):
    return dates.series_continuity(
        table(spark, d, "events"), ["user_id"], "ts", "value", "value", tolerance=10, order=["event_id"]
    )


# --- codes -----------------------------------------------------------------------


def _code_sql(src: str, c: str, tipo: str) -> str:
    s = f"CAST({c} AS VARCHAR)"
    t = f"trim({s})"
    alert_int = "'TIPO NUMERICO - zeros a esquerda JA perdidos'" if "int" in tipo else "NULL"
    return f"""SELECT *, distintos_bruto - distintos_sem_zeros AS colisoes_ao_remover_zeros,
        concat_ws(' | ', CASE WHEN com_zeros_esq > 0 THEN 'tem zeros a esquerda' END,
            CASE WHEN len_min <> len_max THEN 'comprimento variavel' END,
            CASE WHEN com_espacos > 0 THEN 'tem espacos' END,
            CASE WHEN distintos_bruto > distintos_sem_zeros THEN 'COLISAO ao remover zeros' END,
            {alert_int}) AS alertas
        FROM (SELECT '{c}' AS coluna, '{tipo}' AS tipo, count(*) FILTER (WHERE {c} IS NULL OR {t} = '') AS vazios,
            CAST(min(length({t})) AS INTEGER) AS len_min, CAST(max(length({t})) AS INTEGER) AS len_max,
            count(*) FILTER (WHERE regexp_matches({t}, '^0[0-9]')) AS com_zeros_esq,
            count(*) FILTER (WHERE {s} <> {t}) AS com_espacos, count(DISTINCT {t}) AS distintos_bruto,
            count(DISTINCT ltrim({t}, '0')) AS distintos_sem_zeros FROM {src})"""


@query(
    _code_sql("pedidos", "cod_cliente", "string") + " UNION ALL " + _code_sql("pedidos", "num_pedido", "string")
    + " UNION ALL " + _code_sql("pedidos", "ind_aberto", "string"),
    ("pedidos",),
)
def code_format(spark, d):
    return codes.code_format(pedidos(spark, d), ["cod_cliente", "num_pedido", "ind_aberto"])


@query(_code_sql("lineitem", "l_partkey", "bigint") + " UNION ALL " + _code_sql("lineitem", "l_linenumber", "int"))
def code_format_numeric(spark, d):
    return codes.code_format(table(spark, d, "lineitem"), ["l_partkey", "l_linenumber"])


@query(
    """SELECT 'cod_cliente' AS coluna, count(*) AS linhas, CAST(min(length(trim(cod_cliente))) AS INTEGER) AS tamanho_min,
        CAST(max(length(trim(cod_cliente))) AS INTEGER) AS tamanho_max,
        count(*) FILTER (WHERE regexp_matches(trim(cod_cliente), '^0+[0-9]+$')) AS com_zeros_a_esquerda,
        count(DISTINCT trim(cod_cliente)) AS codigos_numericos_distintos,
        count(DISTINCT coalesce(nullif(ltrim(trim(cod_cliente), '0'), ''), CASE WHEN cod_cliente IS NOT NULL THEN '0' END))
            AS codigos_normalizados_distintos,
        count(DISTINCT trim(cod_cliente)) - count(DISTINCT coalesce(nullif(ltrim(trim(cod_cliente), '0'), ''),
            CASE WHEN cod_cliente IS NOT NULL THEN '0' END)) AS colisoes_potenciais
        FROM pedidos""",
    ("pedidos",),
)
def numeric_code_format(spark, d):
    return codes.numeric_code_format(pedidos(spark, d), ["cod_cliente"])


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS coluna, count(*) FILTER (WHERE regexp_matches(trim({c}), '^0[0-9]')) AS com_zeros_esq,
        count(*) FILTER (WHERE {c} IS NOT NULL AND NOT regexp_matches(trim({c}), '^[0-9]+$')) AS nao_numerico,
        count(DISTINCT trim({c})) AS distintos_string, count(DISTINCT ltrim(trim({c}), '0')) AS distintos_sem_zeros
        FROM pedidos"""
        for c in ("num_pedido", "cod_cliente", "tp_prioridade")
    ),
    ("pedidos",),
)
def cast_loss(spark, d):
    return codes.cast_loss(pedidos(spark, d), ["num_pedido", "cod_cliente", "tp_prioridade"])


@query(
    """SELECT CAST(length(trim(cod_cliente)) AS INTEGER) AS comprimento, count(*) AS linhas,
        count(DISTINCT cod_cliente) AS valores_distintos FROM pedidos
        WHERE cod_cliente IS NOT NULL AND trim(cod_cliente) <> '' GROUP BY 1""",
    ("pedidos",),
)
def code_length(spark, d):
    return codes.code_length(pedidos(spark, d), "cod_cliente")


@query(
    """SELECT source AS valor, count(*) AS linhas, CAST(length(source) AS INTEGER) AS tamanho
        FROM documents GROUP BY source"""
)
def literal_lengths(spark, d):
    return codes.literal_lengths(table(spark, d, "documents"), "source")


@query(
    """SELECT DISTINCT ltrim(trim(num_pedido), '0') AS num_pedido_norm, ltrim(trim(cod_material), '0') AS cod_material_norm
        FROM itens""",
    ("itens",),
)
def normalized_keys(spark, d):
    return codes.normalized_keys(itens(spark, d), ["num_pedido", "cod_material"])


@query(
    """SELECT DISTINCT coalesce(nullif(ltrim(trim(cod_cliente), '0'), ''), CASE WHEN cod_cliente IS NOT NULL THEN '0' END)
        AS cod_cliente_norm, CASE WHEN ind_aberto = 'X' AND vl_total > 100000 THEN 'S' ELSE 'N' END AS na_tela
        FROM pedidos""",
    ("pedidos",),
)
def normalized_keys_flagged(spark, d):
    p = pedidos(spark, d)
    return codes.normalized_keys(
        p, ["cod_cliente"], "keep_last", {"na_tela": (p.ind_aberto == "X") & (p.vl_total > 100000)}
    )


@query(
    """SELECT 'vl_texto' AS coluna, count(*) FILTER (WHERE trim(coalesce(vl_texto, '')) = '') AS vazios,
        count(*) FILTER (WHERE regexp_matches(trim(vl_texto), '^-?[0-9]+([.][0-9]+)?$')) AS numerico_ponto,
        count(*) FILTER (WHERE regexp_matches(trim(vl_texto), '^-?[0-9.]+,[0-9]+$')) AS numerico_virgula,
        count(*) FILTER (WHERE trim(coalesce(vl_texto, '')) <> '' AND NOT regexp_matches(trim(vl_texto), '^-?[0-9]+([.][0-9]+)?$')
            AND NOT regexp_matches(trim(vl_texto), '^-?[0-9.]+,[0-9]+$')) AS outros FROM pedidos""",
    ("pedidos",),
)
def numeric_string_format(spark, d):
    return codes.numeric_string_format(pedidos(spark, d), ["vl_texto"])


# --- volume and scenarios ------------------------------------------------------------


@query(
    """SELECT count(*) AS linhas, count(DISTINCT num_pedido) AS pedidos_distintos,
        count(DISTINCT (num_pedido, num_item)) AS itens_distintos, count(DISTINCT cod_material) AS materiais,
        count(DISTINCT cod_fornecedor) AS fornecedores FROM itens""",
    ("itens",),
)
def volumetry(spark, d):
    return volume.volumetry(itens(spark, d), {
        "pedidos_distintos": "num_pedido", "itens_distintos": ["num_pedido", "num_item"],
        "materiais": "cod_material", "fornecedores": "cod_fornecedor",
    })


@query(
    f"""SELECT count(*) AS linhas_tabela_toda, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS linhas_cenario,
        {pct_sql("count(*) FILTER (WHERE c_mktsegment = 'BUILDING')", 'count(*)', 4)} AS pct_do_total,
        count(DISTINCT c_mktsegment) AS valores_na_tabela FROM customer"""
)
def scenario_share(spark, d):
    return volume.scenario_share(table(spark, d, "customer"), "c_mktsegment", "BUILDING")


@query(
    f"""WITH g AS (SELECT {BUCKET.format('l_returnflag')} AS l_returnflag, count(*) AS linhas,
            count(DISTINCT l_orderkey) AS entidades FROM lineitem GROUP BY 1)
        SELECT *, {pct_sql('linhas', '(SELECT count(*) FROM lineitem)')} AS pct,
            CASE WHEN linhas BETWEEN 10000 AND 300000 THEN 'CANDIDATO A CENARIO DE TESTE' ELSE '' END AS sugestao FROM g"""
)
def scenario_candidates(spark, d):
    return volume.scenario_candidates(table(spark, d, "lineitem"), "l_returnflag", entity="l_orderkey")


@query(
    """SELECT cod_cliente AS literal, count(*) AS linhas, CAST(length(trim(cod_cliente)) AS INTEGER) AS tamanho
        FROM pedidos WHERE ltrim(trim(cod_cliente), '0') IN ('11', '72') GROUP BY 1""",
    ("pedidos",),
)
def known_scenarios(spark, d):
    return volume.known_scenarios(pedidos(spark, d), "cod_cliente", ["11", "72"], zeros=True)


@query(
    """SELECT count(*) AS total_linhas_cenario, count(DISTINCT c_mktsegment) AS valores_distintos,
        min(c_mktsegment) AS valor_minimo, max(c_mktsegment) AS valor_maximo
        FROM customer WHERE trim(c_mktsegment) = 'BUILDING'"""
)
def scenario_gate(spark, d):
    c = table(spark, d, "customer")
    return volume.scenario_gate(c.where(scan.trimmed_equals(c, "c_mktsegment", "BUILDING")), "c_mktsegment")


@query(
    """SELECT cod_cliente AS valor_bruto, count(*) AS linhas, CAST(length(cod_cliente) AS INTEGER) AS comprimento
        FROM pedidos WHERE ltrim(trim(cod_cliente), '0') = '11' OR trim(cod_cliente) = '11' GROUP BY 1""",
    ("pedidos",),
)
def filter_completeness(spark, d):
    return volume.filter_completeness(pedidos(spark, d), "cod_cliente", "11")


@query(
    """SELECT source AS valor, CASE WHEN trim(source) = 'src1' THEN 'exato' WHEN trim(source) LIKE 'src1%' THEN 'prefixo'
            ELSE 'contem' END AS relacao, count(*) AS linhas, CAST(length(source) AS INTEGER) AS comprimento
        FROM documents WHERE contains(trim(source), 'src1') GROUP BY ALL"""
)
def filter_column_discovery(spark, d):
    return volume.filter_column_discovery(table(spark, d, "documents"), "source", "src1")


def _search_part(c: str) -> str:
    bare = f"ltrim(trim({c}), '0')"
    return f"""SELECT '{c}' AS coluna, count(*) FILTER (WHERE trim({c}) = '1') AS correspondencias_exatas,
        count(*) FILTER (WHERE trim({c}) <> '1' AND {bare} = '1') AS correspondencias_com_zeros_esquerda,
        count(*) FILTER (WHERE {bare} <> '1') AS correspondencias_parciais, min({c}) AS exemplo
        FROM pedidos WHERE contains({c}, '1') HAVING count(*) > 0"""


@query(
    " UNION ALL ".join(
        _search_part(c) for c, t in PEDIDO_COLS.items() if t == "string"
    ),
    ("pedidos",),
)
def value_search(spark, d):
    return volume.value_search(pedidos(spark, d), "1")


@query(
    """SELECT '1. todos' AS etapa, count(*) AS linhas, count(DISTINCT cod_cliente) AS entidades FROM pedidos
        UNION ALL SELECT '2. + em aberto', count(*), count(DISTINCT cod_cliente) FROM pedidos WHERE ind_aberto = 'X'
        UNION ALL SELECT '3. + valor alto', count(*), count(DISTINCT cod_cliente) FROM pedidos
            WHERE ind_aberto = 'X' AND vl_total > 250000
        UNION ALL SELECT '(ref) so valor alto', count(*), count(DISTINCT cod_cliente) FROM pedidos WHERE vl_total > 250000""",
    ("pedidos",),
)
def funnel(spark, d):
    p = pedidos(spark, d)
    high = p.vl_total > 250000
    return volume.funnel(
        p, {"1. todos": F.lit(True), "2. + em aberto": p.ind_aberto == "X", "3. + valor alto": high},
        "cod_cliente", {"(ref) so valor alto": high},
    )


@query("SELECT count(*) AS linhas_atuais, CAST(60000 AS BIGINT) AS linhas_esperadas, count(*) - 60000 AS diferenca FROM lineitem")
def volume_check(spark, d):
    return volume.volume_check(table(spark, d, "lineitem"), 60000)


@query(
    """SELECT st_pedido, count(*) AS linhas, count(DISTINCT cod_cliente) AS clientes,
        count(*) FILTER (WHERE dt_pedido IS NULL OR trim(dt_pedido) IN ('', '00000000')) AS data_invalida,
        count(*) FILTER (WHERE tp_prioridade IS NULL OR trim(tp_prioridade) = '') AS prioridade_vazia,
        min(CAST(try_strptime(dt_pedido, '%Y%m%d') AS DATE)) FILTER (WHERE regexp_matches(dt_pedido, '^[0-9]{8}$') AND dt_pedido <> '00000000') AS menor_data,
        max(CAST(try_strptime(dt_pedido, '%Y%m%d') AS DATE)) FILTER (WHERE regexp_matches(dt_pedido, '^[0-9]{8}$') AND dt_pedido <> '00000000') AS maior_data
        FROM pedidos GROUP BY 1""",
    ("pedidos",),
)
def group_metrics(spark, d):
    p = pedidos(spark, d)
    day = compact_date(p.dt_pedido)
    return volume.group_metrics(p, ["st_pedido"], {
        "clientes": F.countDistinct("cod_cliente"),
        "data_invalida": count_if(no_value(p.dt_pedido) | (p.dt_pedido == "00000000")),
        "prioridade_vazia": count_if(no_value(p.tp_prioridade)),
        "menor_data": F.min(day), "maior_data": F.max(day),
    })


@query(
    """SELECT st_pedido, count(*) AS linhas, count(*) FILTER (WHERE cod_cliente IS NULL OR trim(cod_cliente) = '') AS cod_cliente_nulo,
        count(*) FILTER (WHERE ind_aberto IS NULL OR trim(ind_aberto) = '') AS ind_aberto_nulo,
        count(*) FILTER (WHERE tp_prioridade IS NULL OR trim(tp_prioridade) = '') AS tp_prioridade_nulo
        FROM pedidos GROUP BY 1""",
    ("pedidos",),
)
def blank_by_group(spark, d):
    return volume.blank_by_group(pedidos(spark, d), ["st_pedido"], ["cod_cliente", "ind_aberto", "tp_prioridade"])


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark, d):
    return volume.distinct_rows(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])
