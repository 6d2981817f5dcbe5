"""Whole profiles as one long report, with the SQL of all their sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from crivo import TableSpec
from crivo import plans as P

from .base import VIEW_SQL, pct_sql, pedidos, query
from .coverage import LINES_SQL, LIST_CTES, TABLE_CTE, lines
from .keys import _checksum_sql, _dup_sql, _fmt4, _grain_rows, _grain_sql, _varying_sql
from .profile import BUCKET, CARD_LADDER, PEDIDO_COLS, TOK6, _code_sql, _domain_sql, _fill_f1, _fill_sql, _string_date_sql

KEYS = [["cod_cliente"], ["cod_cliente", "dt_pedido"], ["num_pedido"]]
COLS = {**PEDIDO_COLS, "qt_prazo": "bigint"}
AS_OF = "2002-01-01"
SPEC = TableSpec(
    "pedidos", keys=KEYS, roles={"vl_total": "other"}, ingest="dt_carga", dimensions=["st_pedido"], declared_empty=["cod_obsoleto"],
    clustering=["num_pedido"], expected_rows=15_000, entities={"clientes": "cod_cliente", "pedidos": "num_pedido"})
PERFIL = f"perfil AS (SELECT *, CAST(num_pedido AS BIGINT) % 50 AS qt_prazo FROM ({VIEW_SQL['pedidos']}))"


def perfil(spark, d):
    return pedidos(spark, d).withColumn("qt_prazo", F.col("num_pedido").cast("bigint") % 50)


def _long(name: str, sql: str, items: str, measures: str, verdict: str = "CAST(NULL AS VARCHAR)") -> str:
    """Rows of a section; a measure that ends in ``:d`` is written with four places."""
    item = f"concat_ws(' | ', {', '.join(f'''coalesce(CAST({i} AS VARCHAR), '(nulo)')''' for i in items.split())})" if items else "''"
    written = ", ".join(
        f"{{'medida': '{m[:-2]}', 'valor': CAST(CAST({m[:-2]} AS DECIMAL(38, 4)) AS VARCHAR)}}" if m.endswith(":d") else f"{{'medida': '{m}', 'valor': CAST({m} AS VARCHAR)}}"
        for m in measures.split())
    return f"SELECT '{name}' AS secao, item, m.medida, m.valor, veredito FROM (SELECT {item} AS item, {verdict} AS veredito, unnest([{written}]) AS m FROM ({sql}))"


def _cardinality(src: str, cols) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS coluna, '{t}' AS tipo, count(DISTINCT {c}) AS distintos, count(*) AS total FROM {src}" for c, t in cols.items())


def _keys_of(src: str) -> list[str]:
    return [_long("grain", _grain_sql(src, KEYS), "chave", "linhas combinacoes_distintas linhas_por_chave:d", "veredito"),
            _long("duplicates", " UNION ALL ".join(
                f"""SELECT '{" + ".join(k)}' AS chave, count(*) FILTER (WHERE n > 1) AS chaves_repetidas, CAST(sum(n - 1) FILTER (WHERE n > 1) AS BIGINT) AS linhas_excedentes,
                max(n) FILTER (WHERE n > 1) AS pior_caso FROM (SELECT count(*) AS n FROM {src} GROUP BY {', '.join(k)})""" for k in KEYS), "chave", "chaves_repetidas linhas_excedentes pior_caso")]


def _versions_of(src: str, short: bool = False) -> list[str]:
    k = f"WITH k AS (SELECT cod_cliente, count(*) AS n, count(DISTINCT s) AS v FROM {src} s GROUP BY 1)"
    if short:
        rows = _long("versions", f"""{k} SELECT count(*) FILTER (WHERE n > 1) AS chaves_repetidas, CAST(coalesce(sum(n - v) FILTER (WHERE n > 1), 0) AS BIGINT) AS repeticoes_identicas,
            count(*) FILTER (WHERE v > 1) AS chaves_com_versoes FROM k""", "", "chaves_repetidas repeticoes_identicas chaves_com_versoes")
    else:
        rows = _long("versions", f"""{k} SELECT count(*) AS chaves, CAST(sum(n) AS BIGINT) AS linhas, count(*) FILTER (WHERE n > 1) AS chaves_duplicadas,
            CAST(sum(n - v) AS BIGINT) AS linhas_duplicata_pura, count(*) FILTER (WHERE v > 1) AS chaves_com_mais_de_uma_versao,
            CAST(sum(CASE WHEN v > 1 THEN v - 1 ELSE 0 END) AS BIGINT) AS linhas_versao_excedente FROM k""",
            "", "chaves linhas chaves_duplicadas linhas_duplicata_pura chaves_com_mais_de_uma_versao linhas_versao_excedente")
    return [rows, _long("checksum", _checksum_sql("s", src), "", "linhas linhas_unicas linhas_identicas", "veredito")]


def _repeated_of(src: str) -> list[str]:
    return [_long("varying_columns", _varying_sql(src, ["cod_cliente"], [c for c in COLS if c != "cod_cliente"]), "coluna", "max_valores_distintos", "veredito"),
            _long("duplicate_keys", f"SELECT cod_cliente, count(*) AS qtd FROM {src} GROUP BY 1 HAVING count(*) > 1", "cod_cliente", "qtd")]


def _columns_of(src: str) -> list[str]:
    codes = " UNION ALL ".join(_code_sql(src, c, "string") for c in ("num_pedido", "cod_cliente", "cod_obsoleto"))
    return [
        _long("domain", _domain_sql(src, ("tp_prioridade", "st_pedido", "ind_aberto"), 10**9), "coluna valor", "qtd pct:d"),
        _long("flags", f"""SELECT 'ind_faturado' AS flag, count(*) FILTER (WHERE ind_faturado) AS verdadeiro, count(*) FILTER (WHERE NOT ind_faturado) AS falso,
            count(*) - count(ind_faturado) AS nulo, {pct_sql('count(*) FILTER (WHERE ind_faturado)', 'count(*)')} AS pct_verdadeiro FROM {src}""",
            "flag", "verdadeiro falso nulo pct_verdadeiro:d"),
        _long("numeric_profile", f"""SELECT 'qt_prazo' AS coluna, 'bigint' AS tipo, count(qt_prazo) AS preenchidos, min(qt_prazo) AS minimo, max(qt_prazo) AS maximo, round(avg(qt_prazo), 4) AS media,
            quantile_disc(qt_prazo, 0.5) AS mediana, quantile_disc(qt_prazo, 0.95) AS p95, count(*) FILTER (WHERE qt_prazo < 0) AS negativos, count(*) FILTER (WHERE qt_prazo = 0) AS zeros FROM {src}""",
            "coluna", "tipo preenchidos minimo:d maximo:d media:d mediana:d p95:d negativos zeros"),
        _long("totals", f"SELECT 'qt_prazo' AS coluna, sum(qt_prazo) AS total_numerico, sum(qt_prazo) AS total_arredondado, count(qt_prazo) AS linhas_preenchidas FROM {src}",
              "coluna", "total_numerico:d total_arredondado:d linhas_preenchidas"),
        _long("string_dates", _string_date_sql(src, "dt_pedido"), "coluna", "vazios fmt_aaaammdd fmt_iso fmt_br data_zero nao_reconhecido minimo maximo", "veredito"),
        _long("valid_date_range", f"""WITH x AS (SELECT trim(dt_pedido) AS t, CASE WHEN regexp_matches(trim(dt_pedido), '^[0-9]{{8}}$') AND trim(dt_pedido) <> '00000000'
                THEN CAST(try_strptime(trim(dt_pedido), '%Y%m%d') AS DATE) END AS dt FROM {src})
            SELECT 'dt_pedido' AS coluna, min(dt) AS minima_valida, max(dt) AS maxima_valida, count(*) FILTER (WHERE t IS NULL OR t IN ('', '00000000')) AS vazia_ou_zerada,
                count(*) FILTER (WHERE t NOT IN ('', '00000000') AND dt IS NULL) AS invalida FROM x""", "coluna", "minima_valida maxima_valida vazia_ou_zerada invalida"),
        _long("native_dates", f"""SELECT 'dt_carga' AS coluna, count(*) - count(dt_carga) AS nulos, min(dt_carga) AS minimo, max(dt_carga) AS maximo, count(DISTINCT dt_carga) AS distintas,
            count(*) FILTER (WHERE dt_carga > DATE '{AS_OF}') AS futuras FROM {src}""", "coluna", "nulos minimo maximo distintas futuras"),
        _long("codes", codes, "coluna", "tipo vazios len_min len_max com_zeros_esq com_espacos distintos_bruto distintos_sem_zeros colisoes_ao_remover_zeros alertas"),
    ]


def _dimensions_of(src: str) -> list[str]:
    return [_long("distribution_st_pedido", f"""WITH g AS (SELECT {BUCKET.format('st_pedido')} AS st_pedido, count(*) AS linhas FROM {src} GROUP BY 1)
        SELECT *, {pct_sql('linhas', f'(SELECT count(*) FROM {src})')} AS pct, CASE WHEN linhas BETWEEN 10000 AND 300000 THEN '<< candidato a cenario' ELSE '' END AS sugestao FROM g""",
        "st_pedido", "linhas pct:d", "sugestao")]


def _freshness_of(src: str) -> list[str]:
    return [
        _long("freshness", f"""SELECT 'dt_carga' AS coluna, count(*) AS linhas, min(dt_carga) AS primeira_carga, max(dt_carga) AS ultima_carga,
            date_diff('day', max(dt_carga), DATE '{AS_OF}') AS dias_desde_carga, count(DISTINCT dt_carga) AS dias_distintos_carga FROM {src}""",
            "coluna", "linhas primeira_carga ultima_carga dias_desde_carga dias_distintos_carga"),
        _long("snapshot", f"""SELECT min(dt_carga) AS primeira_carga, max(dt_carga) AS ultima_carga, count(DISTINCT dt_carga) AS cargas_distintas,
            CASE WHEN count(DISTINCT dt_carga) = 1 THEN 'SNAPSHOT - substitui a cada carga; chave NAO precisa da data'
                 ELSE 'HISTORICO - acumula; a chave DEVE incluir dt_carga' END AS veredito FROM {src}""", "", "primeira_carga ultima_carga cargas_distintas", "veredito"),
    ]


def _rules_of(src: str) -> list[str]:
    useful = f"count(*) FILTER (WHERE cod_obsoleto IS NOT NULL AND lower(trim(cod_obsoleto)) NOT IN {TOK6})"
    return [_long("declared_empty", f"""SELECT 'cod_obsoleto' AS coluna, count(*) AS total, count(*) - count(cod_obsoleto) AS nulos, {useful} AS preenchidos,
        CASE WHEN {useful} = 0 THEN 'CONFIRMADO - 100% nula' ELSE 'DIVERGE - ha valores' END AS veredito FROM {src}""", "coluna", "total nulos preenchidos", "veredito")]


def _fill_of(src: str) -> list[str]:
    return [_long("fill", _fill_f1(src, COLS), "coluna", "tipo nulos vazios zeros uteis pct_util:d", "veredito"),
            _long("cardinality", f"WITH c AS ({_cardinality(src, COLS)}) SELECT coluna, tipo, distintos, {pct_sql('distintos', 'total', 4)} AS pct_distintos, {CARD_LADDER} AS classificacao FROM c",
                  "coluna", "tipo distintos pct_distintos:d", "classificacao")]


def _summary_of(src: str) -> str:
    return _long("summary", f"""WITH g AS ({_grain_rows(src, KEYS)})
        SELECT 'VOLUMETRIA' AS bloco, 'linhas na base' AS item_, CAST(count(*) AS VARCHAR) AS valor, '' AS veredito FROM {src}
        UNION ALL SELECT 'VOLUMETRIA', 'colunas', '{len(COLS)}', '' UNION ALL SELECT 'VOLUMETRIA', 'clustering declarado', 'num_pedido', ''
        UNION ALL SELECT 'GRANULARIDADE', chave, {_fmt4('linhas', 'combinacoes_distintas')}, CASE WHEN linhas = combinacoes_distintas THEN 'CHAVE UNICA' ELSE 'nao unica' END FROM g""",
        "bloco item_", "valor", "veredito")


def _report(ctes: str, parts) -> str:
    return f"WITH {ctes} {' UNION ALL '.join(parts)}"


@query(_report(PERFIL, [*_keys_of("perfil"), *_fill_of("perfil"), *_columns_of("perfil"), *_dimensions_of("perfil"), *_versions_of("perfil"), *_repeated_of("perfil"),
                        *_freshness_of("perfil"), *_rules_of("perfil"), _summary_of("perfil")]))
def plan_explore(spark, d):
    return P.long_report(P.explore_profile(perfil(spark, d), SPEC, as_of=AS_OF, exact=True).run())


def _scenario_summary(src: str) -> str:
    thousands = lambda n: f"format('{{:,}}', {n})"
    return _long("summary", f"""WITH g AS ({_grain_rows(src, KEYS)})
        SELECT 'CENARIO' AS bloco, 'tabela' AS item_, 'pedidos' AS valor UNION ALL SELECT 'CENARIO', 'filtro', 'st_pedido = F'
        UNION ALL SELECT 'CENARIO', 'linhas no cenario', {thousands('count(*)')} FROM {src} UNION ALL SELECT 'CENARIO', 'colunas', '{len(COLS)}'
        UNION ALL SELECT 'GRANULARIDADE', chave, {thousands('combinacoes_distintas')} || ' distintos | ' || {_fmt4('linhas', 'combinacoes_distintas')} || ' linhas/chave | '
            || CASE WHEN linhas = combinacoes_distintas THEN 'CHAVE UNICA' ELSE 'nao unica' END FROM g
        UNION ALL SELECT 'CHAVE REAL', 'sugerida', coalesce(min(chave) FILTER (WHERE linhas = combinacoes_distintas), 'NENHUMA - investigar') FROM g""", "bloco item_", "valor")


@query(_report(f"{PERFIL}, cenario AS (SELECT * FROM perfil WHERE st_pedido = 'F')", [
    _long("volume", f"""SELECT count(*) AS linhas_tabela_toda, count(*) FILTER (WHERE st_pedido = 'F') AS linhas_cenario,
        {pct_sql("count(*) FILTER (WHERE st_pedido = 'F')", 'count(*)', 4)} AS pct_do_total, count(DISTINCT st_pedido) AS valores_na_tabela FROM perfil""",
        "", "linhas_tabela_toda linhas_cenario pct_do_total:d valores_na_tabela"),
    _long("filter_impact_forms", "SELECT st_pedido AS valor_bruto, count(*) AS linhas, length(st_pedido) AS comprimento FROM perfil WHERE ltrim(trim(st_pedido), '0') = 'F' OR trim(st_pedido) = 'F' GROUP BY 1",
          "valor_bruto", "linhas comprimento"),
    _long("gate", "SELECT count(*) AS total_linhas_cenario, count(DISTINCT st_pedido) AS valores_distintos, min(st_pedido) AS valor_minimo, max(st_pedido) AS valor_maximo FROM cenario",
          "", "total_linhas_cenario valores_distintos valor_minimo valor_maximo"),
    *_keys_of("cenario"), *_versions_of("cenario"), *_repeated_of("cenario"), *_fill_of("cenario"), *_columns_of("cenario"), *_dimensions_of("cenario"),
    *_freshness_of("cenario"), *_rules_of("cenario"), _scenario_summary("cenario")]))
def plan_scenario(spark, d):
    return P.long_report(P.scenario_profile(perfil(spark, d), SPEC.with_scenario("st_pedido", "F"), as_of=AS_OF, exact=True).run())


CANARY_CODES = ("num_pedido", "cod_cliente", "cod_obsoleto", "tp_prioridade", "st_pedido", "ind_aberto")


def _numeric_codes(src: str, c: str) -> str:
    norm = f"coalesce(nullif(ltrim(trim({c}), '0'), ''), CASE WHEN {c} IS NOT NULL THEN '0' END)"
    return f"""SELECT '{c}' AS coluna, count(*) AS linhas, min(length(trim({c}))) AS tamanho_min, max(length(trim({c}))) AS tamanho_max,
        count(*) FILTER (WHERE regexp_matches(trim({c}), '^0+[0-9]+$')) AS com_zeros_a_esquerda, count(DISTINCT trim({c})) AS codigos_numericos_distintos,
        count(DISTINCT {norm}) AS codigos_normalizados_distintos, count(DISTINCT trim({c})) - count(DISTINCT {norm}) AS colisoes_potenciais FROM {src}"""


@query(_report(PERFIL, [
    _long("volume", "SELECT count(*) AS linhas, count(DISTINCT cod_cliente) AS clientes, count(DISTINCT num_pedido) AS pedidos FROM perfil", "", "linhas clientes pedidos"),
    *_dimensions_of("perfil"), *_keys_of("perfil"), *_versions_of("perfil", short=True), *_repeated_of("perfil"),
    _long("fill", f"""WITH p AS ({_fill_sql('perfil', COLS, TOK6)}) SELECT *, total - nulos - vazios AS preenchidos_nao_vazios,
        CASE WHEN total = 0 THEN 'SEM LINHAS' WHEN nulos = total THEN '100% NULO - CONFERIR COMENTARIO' WHEN nulos + vazios = total THEN '100% SEM VALOR UTIL - CONFERIR'
             ELSE 'COM DADOS' END AS veredito FROM p""", "coluna", "tipo total nulos vazios zeros preenchidos_nao_vazios", "veredito"),
    _long("cardinality", f"""WITH c AS ({_cardinality('perfil', {c: COLS[c] for c in CANARY_CODES})}) SELECT coluna, distintos, total,
        CASE WHEN distintos <= 1 THEN 'CONSTANTE OU VAZIO' WHEN distintos <= 20 THEN 'BAIXA CARDINALIDADE' WHEN distintos * 10 >= total * 9 THEN 'CANDIDATO A IDENTIFICADOR'
             ELSE 'INTERMEDIARIA' END AS perfil FROM c""", "coluna", "distintos total", "perfil"),
    *_columns_of("perfil"),
    _long("numeric_codes", " UNION ALL ".join(_numeric_codes("perfil", c) for c in ("num_pedido", "cod_cliente", "cod_obsoleto")), "coluna",
          "linhas tamanho_min tamanho_max com_zeros_a_esquerda codigos_numericos_distintos codigos_normalizados_distintos colisoes_potenciais"),
    *_freshness_of("perfil"), *_rules_of("perfil"),
    _long("volume_check", "SELECT count(*) AS linhas_atuais, 15000 AS linhas_esperadas, count(*) - 15000 AS diferenca FROM perfil", "", "linhas_atuais linhas_esperadas diferenca")]))
def plan_canary(spark, d):
    return P.long_report(P.canary_profile(perfil(spark, d), SPEC, as_of=AS_OF).run())


_LIST_ROWS = "r AS (SELECT * EXCLUDE chave FROM dl WHERE chave IN (SELECT chave FROM lista))"
VALID = "v <> '' AND lower(v) <> 'chave' AND regexp_matches(v, '^[0-9]+(\\.0+)?$')"


@query(_report(f"""pedidos AS ({VIEW_SQL['pedidos']}), {LIST_CTES.removeprefix('WITH ')}, {TABLE_CTE}, g AS (SELECT chave, count(*) AS n FROM dl GROUP BY 1), {_LIST_ROWS}""", [
    _long("input_control", f"""SELECT count(*) AS linhas_lidas, count(DISTINCT v) FILTER (WHERE {VALID}) AS chaves_validas_distintas,
        count(*) FILTER (WHERE v <> '' AND lower(v) <> 'chave' AND NOT regexp_matches(v, '^[0-9]+(\\.0+)?$')) AS linhas_rejeitadas FROM linhas""",
        "", "linhas_lidas chaves_validas_distintas linhas_rejeitadas"),
    _long("coverage", f"""SELECT count(*) AS chaves_lista, count(n) AS encontradas, count(*) - count(n) AS ausentes, CAST(coalesce(sum(n), 0) AS BIGINT) AS linhas_tabela,
        count(*) FILTER (WHERE n > 1) AS chaves_repetidas, coalesce(max(n), 0) AS max_linhas_por_chave, {pct_sql('count(n)', 'count(*)')} AS cobertura_percentual
        FROM lista LEFT JOIN g USING (chave)""", "", "chaves_lista encontradas ausentes linhas_tabela chaves_repetidas max_linhas_por_chave cobertura_percentual:d"),
    _long("repeated_keys", "SELECT cod_cliente, count(*) AS qtd FROM r GROUP BY 1 HAVING count(*) > 1", "cod_cliente", "qtd"),
    _long("fill", " UNION ALL ".join(f"SELECT '{c}' AS coluna, count(*) - count({c}) AS nulos, count({c}) AS preenchidos, {pct_sql(f'count({c})', 'count(*)')} AS pct_preenchido FROM r" for c in PEDIDO_COLS),
          "coluna", "nulos preenchidos pct_preenchido:d"),
    _long("latest_load", "SELECT max(dt_carga) AS ultima_carga FROM r", "", "ultima_carga")]))
def plan_key_list(spark, d):
    out = P.key_list_profile(lines(spark, d), pedidos(spark, d), "cod_cliente", latest={"ultima_carga": "dt_carga"})
    return P.long_report({k: out[k] for k in ("input_control", "coverage", "repeated_keys", "fill", "latest_load")})
