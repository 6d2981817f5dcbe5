"""Coverage, presence and reconciliation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from crivo.operators import coverage, keys, reconcile
from crivo.sources import keylist

from .base import pct_sql, pedidos, query, table

# A pasted list per customer: padded code, code with a decimal tail, blank, header, junk.
LINES_SQL = """SELECT trim(unnest(string_split(replace(t, chr(13), ''), chr(10)))) AS v, c_custkey FROM (
    SELECT c_custkey, concat_ws(chr(13) || chr(10), lpad(CAST(c_custkey AS VARCHAR), 10, '0'), CAST(c_custkey AS VARCHAR) || '.0',
        '', 'Chave', 'C' || c_custkey, ' ' || c_custkey || 'A ') AS t FROM customer)"""
LIST_NORM = "coalesce(nullif(ltrim(regexp_replace(trim({0}), '\\.0+$', ''), '0'), ''), '0')"
LIST_SQL = f"""SELECT DISTINCT v AS chave_original, {LIST_NORM.format('v')} AS chave FROM linhas
    WHERE v <> '' AND lower(v) <> 'chave' AND regexp_matches(v, '^[0-9]+(\\.0+)?$')"""
LIST_CTES = f"WITH linhas AS ({LINES_SQL}), lista AS ({LIST_SQL})"
TABLE_CTE = f"dl AS (SELECT *, {LIST_NORM.format('cod_cliente')} AS chave FROM pedidos)"


def lines(spark, d):
    c = table(spark, d, "customer")
    code = c.c_custkey.cast("string")
    text = F.concat_ws(
        "\r\n", F.lpad(code, 10, "0"), F.concat(code, F.lit(".0")), F.lit(""), F.lit("Chave"),
        F.concat(F.lit("C"), code), F.concat(F.lit(" "), code, F.lit("A ")),
    )
    return keylist.split_lines(c.select("c_custkey", text.alias("texto")), "texto", ["c_custkey"])


def key_list(spark, d):
    return keylist.accepted_keys(lines(spark, d))


@query(
    f"""WITH linhas AS ({LINES_SQL}) SELECT c_custkey, v AS valor_original FROM linhas"""
)
def parse_key_list(spark, d):
    return lines(spark, d).select("c_custkey", "valor_original")


@query(
    """SELECT doc_id, count(*) AS linhas, max(n) AS ultima_linha, CAST(sum(length(trim(v))) AS BIGINT) AS caracteres FROM (
        SELECT doc_id, unnest(l) AS v, unnest(range(1, len(l) + 1)) AS n FROM (
            SELECT doc_id, string_split(replace(text, chr(13), ''), chr(10)) AS l FROM documents)) GROUP BY 1"""
)
def parse_text_lines(spark, d):
    x = keylist.split_lines(table(spark, d, "documents"), "text", ["doc_id"])
    return x.groupBy("doc_id").agg(
        F.count("*").alias("linhas"), F.max("numero_linha").alias("ultima_linha"),
        F.sum(F.length("valor_original")).alias("caracteres"),
    )


@query(f"{LIST_CTES} SELECT * FROM lista")
def accepted_keys(spark, d):
    return key_list(spark, d)


@query(
    f"""WITH linhas AS ({LINES_SQL}) SELECT c_custkey, v AS valor_original FROM linhas
        WHERE v <> '' AND lower(v) <> 'chave' AND NOT regexp_matches(v, '^[0-9]+(\\.0+)?$')"""
)
def quarantine(spark, d):
    return keylist.rejected_lines(lines(spark, d)).select("c_custkey", "valor_original")


@query(
    f"""WITH linhas AS ({LINES_SQL}) SELECT count(*) AS linhas_lidas,
        count(DISTINCT v) FILTER (WHERE v <> '' AND lower(v) <> 'chave' AND regexp_matches(v, '^[0-9]+(\\.0+)?$')) AS chaves_validas_distintas,
        count(*) FILTER (WHERE v <> '' AND lower(v) <> 'chave' AND NOT regexp_matches(v, '^[0-9]+(\\.0+)?$')) AS linhas_rejeitadas FROM linhas"""
)
def input_control(spark, d):
    return keylist.input_control(lines(spark, d))


@query(
    f"""{LIST_CTES}, {TABLE_CTE}, g AS (SELECT chave, count(*) AS n FROM dl GROUP BY 1)
        SELECT count(*) AS chaves_lista, count(n) AS encontradas, count(*) - count(n) AS ausentes, CAST(coalesce(sum(n), 0) AS BIGINT) AS linhas_tabela,
            count(*) FILTER (WHERE n > 1) AS chaves_repetidas, coalesce(max(n), 0) AS max_linhas_por_chave,
            {pct_sql('count(n)', 'count(*)')} AS cobertura_percentual FROM lista LEFT JOIN g USING (chave)""",
    ("pedidos",),
)
def list_coverage(spark, d):
    return coverage.coverage(key_list(spark, d), pedidos(spark, d), "cod_cliente")


@query(
    f"""{LIST_CTES}, {TABLE_CTE}, i AS (SELECT *, CASE st_pedido WHEN 'F' THEN 3 WHEN 'O' THEN 1 END AS qt FROM dl),
        g AS (SELECT chave, count(*) AS n FROM dl GROUP BY 1), r AS (SELECT * FROM i WHERE chave IN (SELECT chave FROM lista))
        SELECT count(*) AS chaves_lista, count(n) AS encontradas, count(*) - count(n) AS ausentes, CAST(coalesce(sum(n), 0) AS BIGINT) AS linhas_tabela,
            count(*) FILTER (WHERE n > 1) AS chaves_repetidas, {pct_sql('count(n)', 'count(*)')} AS cobertura_percentual,
            (SELECT CAST(sum(greatest(coalesce(qt, 0) - 1, 0)) AS BIGINT) FROM r) AS itens_adicionais,
            (SELECT max(dt_carga) FROM r) AS ultima_carga FROM lista LEFT JOIN g USING (chave)""",
    ("pedidos",),
)
def list_coverage_summary(spark, d):
    p = pedidos(spark, d)
    p = p.withColumn("qt", F.when(p.st_pedido == "F", 3).when(p.st_pedido == "O", 1))
    return coverage.coverage_summary(key_list(spark, d), p, "cod_cliente", "qt", {"ultima_carga": "dt_carga"})


@query(
    f"{LIST_CTES}, {TABLE_CTE} SELECT * FROM lista WHERE chave NOT IN (SELECT chave FROM dl)", ("pedidos",)
)
def missing_keys(spark, d):
    return coverage.missing_keys(key_list(spark, d), pedidos(spark, d), "cod_cliente")


@query(
    f"""{LIST_CTES}, {TABLE_CTE}, f AS (SELECT * FROM lista WHERE chave NOT IN (SELECT chave FROM dl WHERE st_pedido = 'O'))
        SELECT chave_original, r.v AS valor_tabela, CASE WHEN r.v IS NULL THEN 'AUSENTE_MESMO_NA_COMPARACAO_DIRETA'
            ELSE 'ENCONTRADA_NA_COMPARACAO_DIRETA' END AS resultado_teste_direto
        FROM f LEFT JOIN (SELECT DISTINCT trim(cod_cliente) AS v FROM pedidos WHERE cod_cliente IS NOT NULL) r ON trim(f.chave_original) = r.v""",
    ("pedidos",),
)
def challenge_missing(spark, d):
    p = pedidos(spark, d)
    # codes of all but the open orders stand under another name in the table that is looked into first
    renamed = p.withColumn("cod_cliente", F.when(p.st_pedido == "O", p.cod_cliente).otherwise(F.concat(F.lit("X"), p.cod_cliente)))
    gone = coverage.missing_keys(key_list(spark, d), renamed, "cod_cliente")
    return coverage.challenge_missing(gone, "chave_original", p, "cod_cliente")


@query(
    f"""{LIST_CTES}, {TABLE_CTE} SELECT chave, num_pedido, st_pedido, vl_total FROM dl WHERE chave IN (SELECT chave FROM lista)""",
    ("pedidos",),
)
def restrict_to_list(spark, d):
    return coverage.restrict_to_list(pedidos(spark, d), key_list(spark, d), "cod_cliente").select(
        "chave", "num_pedido", "st_pedido", "vl_total"
    )


@query(
    f"""WITH a AS (SELECT DISTINCT ltrim(trim(cod_cliente), '0') AS k FROM pedidos WHERE trim(coalesce(cod_cliente, '')) <> ''),
        r AS (SELECT DISTINCT ltrim(CAST(s_suppkey AS VARCHAR), '0') AS k FROM supplier)
        SELECT count(*) AS codigos_distintos_aqui, count(*) FILTER (WHERE k NOT IN (SELECT k FROM r)) AS sem_correspondencia,
            {pct_sql('count(*) FILTER (WHERE k NOT IN (SELECT k FROM r))', 'count(*)')} AS pct_orfao FROM a""",
    ("pedidos",),
)
def referential_integrity(spark, d):
    return coverage.referential_integrity(pedidos(spark, d), "cod_cliente", table(spark, d, "supplier"), "s_suppkey")


@query(
    """SELECT CAST(l_partkey AS VARCHAR) AS codigo, count(*) AS linhas FROM lineitem WHERE l_partkey <> 0
        AND l_partkey NOT IN (SELECT ps FROM (SELECT s_suppkey AS ps FROM supplier)) GROUP BY 1
        UNION ALL SELECT '' AS codigo, count(*) FROM lineitem WHERE l_partkey = 0 AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = 0) HAVING count(*) > 0"""
)
def orphan_codes(spark, d):
    return coverage.orphan_codes(table(spark, d, "lineitem"), "l_partkey", table(spark, d, "supplier"), "s_suppkey")


PRESENCE = """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT c_custkey * 2 AS k FROM customer),
    c AS (SELECT DISTINCT s_suppkey AS k FROM supplier), u AS (SELECT k FROM a UNION SELECT k FROM b UNION SELECT k FROM c),
    x AS (SELECT concat_ws(' ', CASE WHEN k IN (SELECT k FROM a) THEN 'PED' ELSE '--' END, CASE WHEN k IN (SELECT k FROM b) THEN 'CLI' ELSE '--' END,
        CASE WHEN k IN (SELECT k FROM c) THEN 'FOR' ELSE '--' END) AS presenca FROM u)"""


@query(f"{PRESENCE} SELECT presenca, count(*) AS chaves, {pct_sql('count(*)', '(SELECT count(*) FROM x)')} AS pct FROM x GROUP BY 1")
def presence_matrix(spark, d):
    return coverage.presence_matrix({
        "PED": table(spark, d, "orders").select(F.col("o_custkey").alias("k")),
        "CLI": table(spark, d, "customer").select((F.col("c_custkey") * 2).alias("k")),
        "FOR": table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")),
    }, ["k"])


@query(
    """WITH a AS (SELECT DISTINCT doc_id FROM documents), b AS (SELECT DISTINCT doc_id FROM labels)
        SELECT count(*) AS chaves_uniao, count(*) FILTER (WHERE a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS em_ambas,
            count(*) FILTER (WHERE b.doc_id IS NULL) AS apenas_primeira, count(*) FILTER (WHERE a.doc_id IS NULL) AS apenas_segunda
        FROM a FULL OUTER JOIN b ON a.doc_id IS NOT DISTINCT FROM b.doc_id"""
)
def two_way_coverage(spark, d):
    return coverage.two_way_coverage(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"])


@query(
    """WITH a AS (SELECT DISTINCT l_orderkey AS k, l_returnflag AS f, l_linestatus AS s FROM lineitem),
        b AS (SELECT DISTINCT l_orderkey AS k, CASE WHEN l_linenumber > 3 THEN 'R' ELSE l_returnflag END AS f, l_linestatus AS s FROM lineitem),
        j AS (SELECT a.f AS f1, b.f AS f2, a.s AS s1, b.s AS s2 FROM a JOIN b ON a.k = b.k)
        SELECT 'A x B' AS par, 'f' AS coluna, count(*) AS em_comum, count(*) FILTER (WHERE f1 <> f2) AS diverge FROM j
        UNION ALL SELECT 'A x B', 's', count(*), count(*) FILTER (WHERE s1 <> s2) FROM j"""
)
def attribute_agreement(spark, d):
    li = table(spark, d, "lineitem")
    a = li.select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"))
    flag = F.when(li.l_linenumber > 3, "R").otherwise(li.l_returnflag)
    b = li.select(F.col("l_orderkey").alias("k"), flag.alias("f"), F.col("l_linestatus").alias("s"))
    return coverage.attribute_agreement(a, b, ["k"], ["f", "s"])


@query(
    """SELECT 'base' AS fonte, count(*) AS linhas, count(DISTINCT tp_prioridade) AS codigos FROM pedidos
        UNION ALL SELECT 'view', count(*), count(DISTINCT try_cast(cod_cliente AS BIGINT)) FROM pedidos""",
    ("pedidos",),
)
def compare_tables(spark, d):
    p = pedidos(spark, d)
    return coverage.compare_tables({
        "base": (p, {"codigos": F.countDistinct("tp_prioridade")}),
        "view": (p, {"codigos": F.countDistinct(p.cod_cliente.try_cast("bigint"))}),
    })


# --- reconciliation ---------------------------------------------------------------
# Two extracts of all orders. Keys of some are altered on one side, so that they stand
# alone; amounts are off by less or more than the tolerance, dates come in another
# format, numbers as texts that don't read; some keys repeat, some have versions: the
# same on both sides, one more on one side, or one that differs.

SPEC = reconcile.CompareSpec(
    keys=["num"], columns=["cliente", "data", "preco", "prioridade", "texto", "exato", "medida"],
    kinds={"cliente": "code", "data": "date", "preco": "double", "prioridade": "text", "texto": "double", "exato": "exact", "medida": "double"},
)


def _cents(o):
    return o.o_totalprice.cast("decimal(18,2)")


def _lake(spark, d):
    o = table(spark, d, "orders")
    st, pr = o.o_orderstatus, o.o_orderpriority
    base = o.select(
        F.concat(F.when((st == "F") & (pr == "5-LOW"), "A").otherwise(""), F.lpad(o.o_orderkey.cast("string"), 12, "0")).alias("num"),
        F.lpad(o.o_custkey.cast("string"), 10, "0").alias("cliente"), F.date_format(o.o_orderdate, "yyyyMMdd").alias("data"),
        o.o_totalprice.alias("preco"), pr.alias("prioridade"), F.concat(_cents(o).cast("string"), F.when(st == "P", " BRL").otherwise("")).alias("texto"),
        (_cents(o) + F.lit("0.00000011").cast("decimal(9,8)")).cast("decimal(20,8)").alias("exato"),
        F.when(st == "P", float("nan")).otherwise(1.0).alias("medida"), st.alias("st"), pr.alias("pr"),
    )
    versions = base.where(((base.st == "F") & (base.pr == "3-MEDIUM")) | ((base.st == "P") & (base.pr == "2-HIGH"))).withColumn("preco", F.col("preco") + 1)
    return base.unionByName(versions).drop("st", "pr")


def _erp(spark, d):
    o = table(spark, d, "orders")
    st, pr = o.o_orderstatus, o.o_orderpriority
    shift = F.when((st == "F") & (pr == "1-URGENT"), 0.004).when((st == "O") & (pr == "1-URGENT"), 0.006).otherwise(0.0)
    urgent = pr == "1-URGENT"
    base = o.select(
        F.concat(F.when((st == "P") & (pr == "5-LOW"), "B").otherwise(""), o.o_orderkey.cast("string")).alias("num"),
        F.when((st == "O") & (pr == "4-NOT SPECIFIED"), "").otherwise(o.o_custkey.cast("string")).alias("cliente"),
        F.date_format(o.o_orderdate, "dd/MM/yyyy").alias("data"), (o.o_totalprice + shift).alias("preco"),
        F.concat(F.lit(" "), pr).alias("prioridade"),
        F.concat(_cents(o).cast("string"), F.when((st == "P") & urgent, " USD").when(st == "P", " BRL").otherwise("")).alias("texto"),
        (_cents(o) + F.when(urgent, F.lit("0.00000022").cast("decimal(9,8)")).otherwise(F.lit("0.00000011").cast("decimal(9,8)"))).cast("decimal(22,10)").alias("exato"),
        F.when((st == "P") & ~urgent, float("nan")).otherwise(1.0).alias("medida"), st.alias("st"), pr.alias("pr"),
    )
    repeats = base.where((base.st == "F") & (base.pr == "2-HIGH"))
    versions = base.where((base.pr == "3-MEDIUM") & base.st.isin("F", "O")).withColumn("preco", F.col("preco") + 1)
    others = base.where((base.st == "P") & (base.pr == "2-HIGH")).withColumn("preco", F.col("preco") + 2)
    return base.unionByName(repeats).unionByName(versions).unionByName(others).drop("st", "pr")


_DEC = "CAST(o_totalprice AS DECIMAL(18, 2))"
RECON = f"""WITH a0 AS (
        SELECT CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN 'A' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') ELSE CAST(o_orderkey AS VARCHAR) END AS k,
            nullif(CAST(o_custkey AS VARCHAR), '0') AS cliente, strftime(o_orderdate, '%Y%m%d') AS data, o_totalprice AS preco, o_orderpriority AS prioridade,
            CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST({_DEC} AS DOUBLE) END AS texto, CASE WHEN o_orderstatus = 'P' THEN CAST({_DEC} AS VARCHAR) || ' BRL' END AS texto_t,
            CAST({_DEC} AS DECIMAL(28, 10)) + 0.00000011::DECIMAL(12, 10) AS exato, CASE WHEN o_orderstatus = 'P' THEN 'NaN'::DOUBLE ELSE 1.0::DOUBLE END AS medida, o_orderstatus AS st
        FROM orders),
    b0 AS (
        SELECT CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 'B' ELSE '' END || CAST(o_orderkey AS VARCHAR) AS k,
            CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE nullif(CAST(o_custkey AS VARCHAR), '0') END AS cliente,
            strftime(o_orderdate, '%Y%m%d') AS data, o_totalprice + CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 0.004::DOUBLE
                WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 0.006::DOUBLE ELSE 0.0::DOUBLE END AS preco, o_orderpriority AS prioridade,
            CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST({_DEC} AS DOUBLE) END AS texto,
            CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN CAST({_DEC} AS VARCHAR) || ' USD' WHEN o_orderstatus = 'P' THEN CAST({_DEC} AS VARCHAR) || ' BRL' END AS texto_t,
            CAST({_DEC} AS DECIMAL(28, 10)) + CASE WHEN o_orderpriority = '1-URGENT' THEN 0.00000022::DECIMAL(12, 10) ELSE 0.00000011::DECIMAL(12, 10) END AS exato,
            CASE WHEN o_orderstatus = 'P' AND o_orderpriority <> '1-URGENT' THEN 'NaN'::DOUBLE ELSE 1.0::DOUBLE END AS medida, o_orderstatus AS st
        FROM orders),
    a AS (SELECT * EXCLUDE st FROM a0
        UNION ALL BY NAME SELECT * REPLACE (preco + 1 AS preco) FROM (SELECT * EXCLUDE st FROM a0 WHERE (st = 'F' AND prioridade = '3-MEDIUM') OR (st = 'P' AND prioridade = '2-HIGH'))),
    b AS (SELECT * EXCLUDE st FROM b0
        UNION ALL BY NAME SELECT * EXCLUDE st FROM b0 WHERE st = 'F' AND prioridade = '2-HIGH'
        UNION ALL BY NAME SELECT * REPLACE (preco + 1 AS preco) FROM (SELECT * EXCLUDE st FROM b0 WHERE prioridade = '3-MEDIUM' AND st IN ('F', 'O'))
        UNION ALL BY NAME SELECT * REPLACE (preco + 2 AS preco) FROM (SELECT * EXCLUDE st FROM b0 WHERE st = 'P' AND prioridade = '2-HIGH')),
    u AS (SELECT *, 1 AS na, 0 AS nb FROM a UNION ALL BY NAME SELECT *, 0 AS na, 1 AS nb FROM b),
    c AS (SELECT k, cliente, data, preco, prioridade, texto, texto_t, exato, medida, sum(na) AS na, sum(nb) AS nb FROM u GROUP BY ALL),
    ks AS (SELECT k, CAST(sum(na) AS BIGINT) AS na, CAST(sum(nb) AS BIGINT) AS nb, count(*) FILTER (WHERE nb = 0) AS la, count(*) FILTER (WHERE na = 0) AS lb FROM c GROUP BY 1),
    s AS (SELECT *, CASE WHEN nb = 0 THEN 'SOMENTE A' WHEN na = 0 THEN 'SOMENTE B' WHEN la + lb = 0 OR (la = 1 AND lb = 1) THEN 'EM AMBAS'
        ELSE 'CHAVE COM VERSOES' END AS situacao FROM ks),
    j AS (SELECT k, x.cliente AS c1, x.cliente AS c2, x.data AS d1, x.data AS d2, x.preco AS p1, x.preco AS p2, x.prioridade AS r1, x.prioridade AS r2,
            x.texto AS t1, x.texto AS t2, x.texto_t AS u1, x.texto_t AS u2, x.exato AS e1, x.exato AS e2, x.medida AS m1, x.medida AS m2
        FROM s JOIN c x USING (k) WHERE situacao = 'EM AMBAS' AND x.na > 0 AND x.nb > 0
        UNION ALL SELECT k, x.cliente, y.cliente, x.data, y.data, x.preco, y.preco, x.prioridade, y.prioridade, x.texto, y.texto, x.texto_t, y.texto_t, x.exato, y.exato, x.medida, y.medida
        FROM s JOIN c x USING (k) JOIN c y USING (k) WHERE situacao = 'EM AMBAS' AND la = 1 AND lb = 1 AND x.nb = 0 AND y.na = 0)"""


@query(
    f"""{RECON} SELECT situacao, count(*) AS chaves, CAST(sum(na) AS BIGINT) AS linhas_a, CAST(sum(nb) AS BIGINT) AS linhas_b,
        CAST(sum(CASE WHEN na > 1 THEN na - 1 ELSE 0 END) AS BIGINT) AS repeticoes_a, CAST(sum(CASE WHEN nb > 1 THEN nb - 1 ELSE 0 END) AS BIGINT) AS repeticoes_b
        FROM s GROUP BY 1"""
)
def reconcile_keys(spark, d):
    return reconcile.reconcile_keys(_lake(spark, d), _erp(spark, d), SPEC)


def _cell_row(c: str, rule: str, x: str, y: str, tx: str = "NULL", ty: str = "NULL") -> str:
    same = f"({x} IS NOT DISTINCT FROM {y} AND {tx} IS NOT DISTINCT FROM {ty})"
    near = f"(NOT {same} AND coalesce(abs({x} - {y}) <= 0.005 + 1e-9, false))" if rule == "double" else "false"
    ex, ey = f"({x} IS NULL AND {tx} IS NULL)", f"({y} IS NULL AND {ty} IS NULL)"
    n = lambda p: f"count(*) FILTER (WHERE {p})"
    return f"""SELECT '{c}' AS coluna, '{rule}' AS regra, count(*) AS comparadas, {n(same)} AS identicas, {n(near)} AS dentro_da_tolerancia,
        {n(f'NOT {same} AND NOT {near} AND NOT {ex} AND NOT {ey}')} AS divergentes, {n(f'{ex} AND NOT {ey}')} AS vazio_so_em_a,
        {n(f'NOT {ex} AND {ey}')} AS vazio_so_em_b, {n(f'{tx} IS NOT NULL OR {ty} IS NOT NULL')} AS ilegiveis,
        {pct_sql(f'{n(same)} + {n(near)}', 'count(*)')} AS pct_conforme FROM j"""


@query(
    RECON + " " + " UNION ALL ".join([
        _cell_row("cliente", "code", "c1", "c2"), _cell_row("data", "date", "d1", "d2"), _cell_row("preco", "double", "p1", "p2"),
        _cell_row("prioridade", "text", "r1", "r2"), _cell_row("texto", "double", "t1", "t2", "u1", "u2"),
        _cell_row("exato", "exact", "e1", "e2"), _cell_row("medida", "double", "m1", "m2"),
    ])
)
def reconcile_columns(spark, d):
    return reconcile.reconcile_columns(_lake(spark, d), _erp(spark, d), SPEC)


@query(
    f"""{RECON} SELECT ltrim(k, '0') AS num, 'cliente' AS coluna, c1 AS valor_a, c2 AS valor_b FROM j WHERE c1 IS DISTINCT FROM c2
        UNION ALL SELECT ltrim(k, '0'), 'texto', u1, u2 FROM j WHERE u1 IS DISTINCT FROM u2
        UNION ALL SELECT ltrim(k, '0'), 'exato', CAST(e1 AS VARCHAR), CAST(e2 AS VARCHAR) FROM j WHERE e1 <> e2
        UNION ALL SELECT ltrim(k, '0'), 'medida', 'NaN', '1.0' FROM j WHERE isnan(m1) AND NOT isnan(m2)
        UNION ALL SELECT ltrim(k, '0'), 'preco', 'preco', 'preco' FROM j WHERE NOT abs(p1 - p2) <= 0.005 + 1e-9"""
)
def reconcile_cells(spark, d):
    x = reconcile.reconcile_cells(_lake(spark, d), _erp(spark, d), SPEC)
    # two engines write one double in different ways, so of those columns that are doubles on both sides only the cell is compared
    shown = lambda c: F.when(F.col("coluna") == "preco", "preco").otherwise(F.col(c)).alias(c)
    return x.select("num", "coluna", shown("valor_a"), shown("valor_b"))


@query(
    f"""{RECON} SELECT ltrim(k, '0') AS num, situacao, na AS linhas_a, nb AS linhas_b FROM s WHERE situacao <> 'EM AMBAS'"""
)
def reconcile_unmatched(spark, d):
    return reconcile.reconcile_unmatched(_lake(spark, d), _erp(spark, d), SPEC)


@query(
    f"""{LIST_CTES}, {TABLE_CTE} SELECT cod_cliente, count(*) AS qtd FROM dl WHERE chave IN (SELECT chave FROM lista) GROUP BY 1 HAVING count(*) > 1""",
    ("pedidos",),
)
def list_repeated_keys(spark, d):
    found = coverage.restrict_to_list(pedidos(spark, d), key_list(spark, d), "cod_cliente")
    return keys.duplicate_keys(found, ["cod_cliente"], None)


# --- keys with nulls -------------------------------------------------------------------


@query(
    f"""WITH a AS (SELECT DISTINCT cod_cliente AS k FROM pedidos), b AS (SELECT DISTINCT ltrim(CAST(c_custkey AS VARCHAR), '0') AS k FROM customer),
        u AS (SELECT k FROM a UNION SELECT k FROM b),
        x AS (SELECT concat_ws(' ', CASE WHEN a.k IS NULL THEN '--' ELSE 'PED' END, CASE WHEN b.k IS NULL THEN '--' ELSE 'CLI' END) AS presenca
            FROM u LEFT JOIN a ON a.k = u.k LEFT JOIN b ON b.k = u.k)
        SELECT presenca, count(*) AS chaves, {pct_sql('count(*)', '(SELECT count(*) FROM x)')} AS pct FROM x GROUP BY 1""",
    ("pedidos",),
)
def presence_matrix_null_keys(spark, d):
    return coverage.presence_matrix(_with_null_keys(spark, d), ["k"])


@query(
    f"""WITH a AS (SELECT DISTINCT cod_cliente AS k, 1 AS ia FROM pedidos), b AS (SELECT DISTINCT ltrim(CAST(c_custkey AS VARCHAR), '0') AS k, 1 AS ib FROM customer),
        u AS (SELECT k FROM a UNION SELECT k FROM b),
        x AS (SELECT concat_ws(' ', CASE WHEN ia IS NULL THEN '--' ELSE 'PED' END, CASE WHEN ib IS NULL THEN '--' ELSE 'CLI' END) AS presenca
            FROM u LEFT JOIN a ON a.k IS NOT DISTINCT FROM u.k LEFT JOIN b ON b.k IS NOT DISTINCT FROM u.k)
        SELECT presenca, count(*) AS chaves, {pct_sql('count(*)', '(SELECT count(*) FROM x)')} AS pct FROM x GROUP BY 1""",
    ("pedidos",),
)
def presence_matrix_equal_nulls(spark, d):
    return coverage.presence_matrix(_with_null_keys(spark, d), ["k"], null_keys="equal")


def _with_null_keys(spark, d):
    return {
        "PED": pedidos(spark, d).select(F.col("cod_cliente").alias("k")),
        "CLI": table(spark, d, "customer").select(F.ltrim(F.col("c_custkey").cast("string"), F.lit("0")).alias("k")),
    }


def _agreement_sql(join: str) -> str:
    return f"""WITH a AS (SELECT DISTINCT cod_cliente AS k, coalesce(st_pedido, '') AS s, coalesce(tp_prioridade, '') AS t FROM pedidos),
        b AS (SELECT DISTINCT cod_cliente AS k, CASE WHEN ind_aberto = 'X' THEN 'A' ELSE coalesce(st_pedido, '') END AS s, coalesce(tp_prioridade, '') AS t FROM pedidos),
        j AS (SELECT a.s AS s1, b.s AS s2, a.t AS t1, b.t AS t2 FROM a JOIN b ON a.k {join} b.k)
        SELECT 'A x B' AS par, 's' AS coluna, count(*) AS em_comum, count(*) FILTER (WHERE s1 <> s2) AS diverge FROM j
        UNION ALL SELECT 'A x B', 't', count(*), count(*) FILTER (WHERE t1 <> t2) FROM j"""


def _agreement(spark, d, null_keys):
    p = pedidos(spark, d)
    a = p.select(F.col("cod_cliente").alias("k"), F.col("st_pedido").alias("s"), F.col("tp_prioridade").alias("t"))
    b = p.select(F.col("cod_cliente").alias("k"), F.when(p.ind_aberto == "X", "A").otherwise(p.st_pedido).alias("s"), F.col("tp_prioridade").alias("t"))
    return coverage.attribute_agreement(a, b, ["k"], ["s", "t"], null_keys=null_keys)


@query(_agreement_sql("="), ("pedidos",))
def attribute_agreement_null_keys(spark, d):
    return _agreement(spark, d, "unmatched")


@query(_agreement_sql("IS NOT DISTINCT FROM"), ("pedidos",))
def attribute_agreement_equal_nulls(spark, d):
    return _agreement(spark, d, "equal")


# --- numbers of any width ---------------------------------------------------------------

EXACT = reconcile.CompareSpec(
    keys=["num"], columns=["inteiro", "fino", "longo", "expoente"], kinds=dict.fromkeys(["inteiro", "fino", "longo", "expoente"], "exact"))


def _exact_sides(spark, d):
    o = table(spark, d, "orders")
    code, num = o.o_custkey.cast("string"), o.o_orderkey.cast("string")
    urgent, high = o.o_orderpriority == "1-URGENT", o.o_orderpriority == "2-HIGH"
    fine = lambda last: F.concat(F.lit("3."), F.lpad(num, 24, "0"), last, F.lit("00000")).cast("decimal(38,30)")
    a = o.select(
        num.alias("num"), o.o_custkey.cast("decimal(38,0)").alias("inteiro"), fine(F.lit("1")).alias("fino"),
        F.concat(F.lit("9" * 45), num).alias("longo"), F.concat(code, F.lit("e-2")).alias("expoente"))
    b = o.select(
        num.alias("num"), F.concat(code, F.when(urgent, ".4").otherwise(".000")).alias("inteiro"),
        fine(F.when(urgent, "2").otherwise("1")).alias("fino"),
        F.concat(F.lit("+00" + "9" * 45), num, F.when(high, ".00000000000000000000001").otherwise(".0")).alias("longo"),
        (o.o_custkey.cast("decimal(18,2)") / 100 + F.when(high, 0.01).otherwise(0).cast("decimal(4,2)")).cast("decimal(20,2)").alias("expoente"))
    return a, b


def _same_number(x: str, y: str) -> str:
    plain = lambda v: f"rtrim(regexp_replace(regexp_replace({v}, '^[+]?0*([0-9])', '\\1'), '([.][0-9]*?)0+$', '\\1'), '.')"
    return f"{plain(x)} = {plain(y)}"


_EXACT_ROWS = {
    "inteiro": _same_number("CAST(o_custkey AS VARCHAR)", "o_custkey || CASE WHEN o_orderpriority = '1-URGENT' THEN '.4' ELSE '.000' END"),
    "fino": _same_number("'3.' || lpad(CAST(o_orderkey AS VARCHAR), 24, '0') || '100000'",
                         "'3.' || lpad(CAST(o_orderkey AS VARCHAR), 24, '0') || CASE WHEN o_orderpriority = '1-URGENT' THEN '2' ELSE '1' END || '00000'"),
    "longo": _same_number(f"'{'9' * 45}' || o_orderkey",
                          f"'+00{'9' * 45}' || o_orderkey || CASE WHEN o_orderpriority = '2-HIGH' THEN '.00000000000000000000001' ELSE '.0' END"),
    "expoente": "CAST(o_custkey || 'e-2' AS DOUBLE) = CAST(o_custkey AS DOUBLE) / 100 + CASE WHEN o_orderpriority = '2-HIGH' THEN 0.01 ELSE 0 END",
}


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS coluna, 'exact' AS regra, count(*) AS comparadas, count(*) FILTER (WHERE {same}) AS identicas, CAST(0 AS BIGINT) AS dentro_da_tolerancia,
        count(*) FILTER (WHERE NOT ({same})) AS divergentes, CAST(0 AS BIGINT) AS vazio_so_em_a, CAST(0 AS BIGINT) AS vazio_so_em_b, CAST(0 AS BIGINT) AS ilegiveis,
        {pct_sql(f'count(*) FILTER (WHERE {same})', 'count(*)')} AS pct_conforme FROM orders""" for c, same in _EXACT_ROWS.items()))
def reconcile_exact_digits(spark, d):
    return reconcile.reconcile_columns(*_exact_sides(spark, d), EXACT)


# --- several versions of a key ------------------------------------------------------------

VERSIONED = reconcile.CompareSpec(
    keys=["num", "grupo"], columns=["quantidade", "devolucao", "remessa", "fornecedor", "material"],
    kinds={"quantidade": "exact", "devolucao": "text", "remessa": "date", "fornecedor": "code", "material": "code"}, versions=True)


def _versioned_sides(spark, d):
    i = table(spark, d, "lineitem")
    odd, third = i.l_linenumber % 2 == 1, i.l_partkey % 3 == 0
    base = [i.l_orderkey.cast("string").alias("num"), F.ceil(i.l_linenumber / 3).cast("string").alias("grupo")]
    a = i.select(*base, i.l_quantity.alias("quantidade"), i.l_returnflag.alias("devolucao"), i.l_shipdate.cast("date").alias("remessa"),
                 i.l_suppkey.alias("fornecedor"), F.lpad(i.l_partkey.cast("string"), 12, "0").alias("material"))
    b = i.where(~((i.l_linenumber % 3 == 0) & (i.l_orderkey % 2 == 0))).select(
        *base, (i.l_quantity.cast("int") + odd.cast("int")).cast("string").alias("quantidade"),
        F.when(third, "?").otherwise(i.l_returnflag).alias("devolucao"), F.date_format("l_shipdate", "dd/MM/yyyy").alias("remessa"),
        F.lpad((i.l_suppkey + F.when(third & odd, 1).otherwise(0)).cast("string"), 8, "0").alias("fornecedor"), i.l_partkey.alias("material"))
    return a, b


_VERSION_COLS = ("quantidade", "devolucao", "remessa", "fornecedor", "material")
_VERSION_CELLS = ", ".join(f"coalesce({c}, '')" for c in _VERSION_COLS)


def _code_sql(x: str) -> str:
    return f"nullif(ltrim(CAST({x} AS VARCHAR), '0'), '')"


VERSIONS_SQL = f"""WITH RECURSIVE i AS (
        SELECT ltrim(CAST(l_orderkey AS VARCHAR), '0') AS num, CAST(CAST(ceil(l_linenumber / 3.0) AS INTEGER) AS VARCHAR) AS grupo, l_linenumber % 2 = 1 AS odd, l_partkey % 3 = 0 AS third, * FROM lineitem),
    a AS (SELECT DISTINCT num, grupo, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS quantidade, l_returnflag AS devolucao, strftime(l_shipdate, '%Y%m%d') AS remessa,
            {_code_sql('l_suppkey')} AS fornecedor, {_code_sql('l_partkey')} AS material FROM i),
    b AS (SELECT DISTINCT num, grupo, CAST(CAST(l_quantity AS INTEGER) + CAST(odd AS INTEGER) AS VARCHAR) AS quantidade, CASE WHEN third THEN '?' ELSE l_returnflag END AS devolucao,
            strftime(l_shipdate, '%Y%m%d') AS remessa, {_code_sql('l_suppkey + CASE WHEN third AND odd THEN 1 ELSE 0 END')} AS fornecedor, {_code_sql('l_partkey')} AS material
          FROM i WHERE NOT (l_linenumber % 3 = 0 AND l_orderkey % 2 = 0)),
    la AS (SELECT *, md5(concat_ws(chr(31), num, grupo, {_VERSION_CELLS})) AS id FROM (FROM a EXCEPT FROM b)),
    lb AS (SELECT *, md5(concat_ws(chr(31), num, grupo, {_VERSION_CELLS})) AS id FROM (FROM b EXCEPT FROM a)),
    ks AS (SELECT num, grupo FROM (SELECT num, grupo, count(*) AS na FROM la GROUP BY ALL) JOIN (SELECT num, grupo, count(*) AS nb FROM lb GROUP BY ALL) USING (num, grupo) WHERE na > 1 OR nb > 1),
    p0 AS (SELECT num, grupo, la.id AS ia, lb.id AS ib, [{', '.join(f"la.{c} IS DISTINCT FROM lb.{c}" for c in _VERSION_COLS)}] AS d FROM ks JOIN la USING (num, grupo) JOIN lb USING (num, grupo)),
    p AS (SELECT *, len(list_filter(d, lambda x: x)) AS n, row_number() OVER (PARTITION BY num, grupo ORDER BY len(list_filter(d, lambda x: x)), md5(ia || ib)) AS pos
          FROM p0 WHERE len(list_filter(d, lambda x: x)) < {len(_VERSION_COLS)}),
    walk AS (SELECT num, grupo, CAST(0 AS BIGINT) AS pos, [] :: VARCHAR[] AS used, [] :: VARCHAR[] AS taken FROM ks
        UNION ALL
        SELECT w.num, w.grupo, p.pos, CASE WHEN free THEN w.used || [p.ia, p.ib] ELSE w.used END, CASE WHEN free THEN w.taken || [p.ia || p.ib] ELSE w.taken END
        FROM walk w JOIN p ON p.num = w.num AND p.grupo = w.grupo AND p.pos = w.pos + 1, LATERAL (SELECT NOT list_has_any(w.used, [p.ia, p.ib]) AS free)),
    ends AS (SELECT num, grupo, max_by(taken, pos) AS taken FROM walk GROUP BY ALL),
    pairs AS (SELECT p.* FROM p JOIN ends USING (num, grupo) WHERE list_contains(taken, ia || ib))"""


@query(
    f"""{VERSIONS_SQL}
    SELECT num, grupo, ia AS conteudo_a, ib AS conteudo_b, CAST(n AS BIGINT) AS diferentes,
        array_to_string(list_filter([{', '.join(f"CASE WHEN d[{i + 1}] THEN '{c}' END" for i, c in enumerate(_VERSION_COLS))}], lambda x: x IS NOT NULL), ', ') AS colunas FROM pairs
    UNION ALL SELECT num, grupo, id, NULL, NULL, NULL FROM la JOIN ks USING (num, grupo) WHERE id NOT IN (SELECT ia FROM pairs)
    UNION ALL SELECT num, grupo, NULL, id, NULL, NULL FROM lb JOIN ks USING (num, grupo) WHERE id NOT IN (SELECT ib FROM pairs)""")
def reconcile_versions(spark, d):
    return reconcile.reconcile_versions(*_versioned_sides(spark, d), VERSIONED)


def _version_row(c: str, kind: str) -> str:
    n = lambda p: f"count(*) FILTER (WHERE {p})"
    same, x, y = f"{c}_a IS NOT DISTINCT FROM {c}_b", f"{c}_a IS NULL", f"{c}_b IS NULL"
    return f"""SELECT '{c}' AS coluna, '{kind}' AS regra, count(*) AS comparadas, {n(same)} AS identicas, CAST(0 AS BIGINT) AS dentro_da_tolerancia, {n(f'{c}_a <> {c}_b')} AS divergentes,
        {n(f'{x} AND NOT {y}')} AS vazio_so_em_a, {n(f'NOT {x} AND {y}')} AS vazio_so_em_b, CAST(0 AS BIGINT) AS ilegiveis, {pct_sql(n(same), 'count(*)')} AS pct_conforme FROM compared"""


_BOTH_COLS = ", ".join(f"la.{c} AS {c}_a, lb.{c} AS {c}_b" for c in _VERSION_COLS)


@query(
    f"""{VERSIONS_SQL},
    ones AS (SELECT num, grupo FROM (SELECT num, grupo, count(*) AS na FROM la GROUP BY ALL) JOIN (SELECT num, grupo, count(*) AS nb FROM lb GROUP BY ALL) USING (num, grupo) WHERE na = 1 AND nb = 1),
    compared AS (SELECT {_BOTH_COLS} FROM ones JOIN la USING (num, grupo) JOIN lb USING (num, grupo)
        UNION ALL SELECT {_BOTH_COLS} FROM pairs JOIN la ON la.id = ia JOIN lb ON lb.id = ib
        UNION ALL SELECT {', '.join(f"{c}, {c}" for c in _VERSION_COLS)} FROM (FROM a INTERSECT FROM b))
    """ + " UNION ALL ".join(_version_row(c, k) for c, k in VERSIONED.kinds.items()))
def reconcile_columns_versions(spark, d):
    return reconcile.reconcile_columns(*_versioned_sides(spark, d), VERSIONED)
