"""Micro-frames, invariants and brute force for the operators."""

import datetime as dt
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from crivo.functions import normalize as N
from crivo.operators import codes, columns, coverage, dates, keys, reconcile, rules, volume
from crivo.operators import _shape as S
from crivo.sources import keylist
from workload.base import itens, pedidos


def rows(df):
    return [r.asDict() for r in df.collect()]


def by(df, key):
    return {r[key]: r for r in rows(df)}


# --- keys ------------------------------------------------------------------


def test_null_is_a_key_value(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "k string, v int")
    g = rows(keys.grain(df, [["k"]]))[0]
    assert (g["linhas"], g["combinacoes_distintas"], g["linhas_por_chave"]) == (3, 2, 1.5)
    assert keys.duplicate_rows(df, ["k"]).count() == 2
    assert keys.duplicate_rows(df, ["k"], null_keys=False).count() == 0


def test_null_outside_and_inside_grouping_set(spark):
    df = spark.createDataFrame([(None, "x"), ("a", None), ("a", "x")], "k string, j string")
    g = by(keys.grain(df, [["k"], ["j"], ["k", "j"], ["j", "k"]]), "chave")
    assert [g[c]["combinacoes_distintas"] for c in ("k", "j", "k + j", "j + k")] == [2, 2, 3, 3]


def test_only_hot_values_go_through_grouping_sets(spark, monkeypatch):
    """Candidates with a common column are counted where its values lie; a value with many rows is not dealt to one task."""
    data = [(k, i % m, i) for k, n, m in ((None, 40, 7), ("a", 5, 2), ("b", 3, 3), ("c", 1, 1)) for i in range(n)] + [("b", None, None)] * 2
    df = spark.createDataFrame(data, "qtd string, gid int, v int")
    cands = [["qtd"], ["qtd", "gid"], ["v", "qtd"], ["qtd", "gid", "v"]]
    seen, plain = [], keys._grouping_sets
    monkeypatch.setattr(keys, "_grouping_sets", lambda r, sets: seen.append(r.count()) or plain(r, sets))
    found = []
    for most in (10, 1000, 0):
        monkeypatch.setattr(keys, "HOT_ROWS", most)
        found.append(sorted(map(tuple, keys.key_histogram(df, cands).collect())))
    assert seen == [40, 0, 51]
    gids = dict(zip(keys.key_ids(cands), cands))
    cols = ["qtd", "gid", "v"]
    expect = []
    for gid, key in gids.items():
        sizes = Counter(Counter(tuple(r[cols.index(c)] for c in key) for r in data).values())
        expect += [(gid, q, n) for q, n in sizes.items()]
    assert found == [sorted(expect)] * 3


def expands(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Expand ")


def test_dimensions_are_counted_per_value_without_expanding_rows(spark):
    data = [(1, "a", 1.0), (1, "b", -0.0), (1, None, 0.0), (2, "a", 1.0), (None, None, None), (None, None, 2.0)]
    df = spark.createDataFrame(data, "n string, linhas string, i double").withColumnRenamed("n", "k0")
    got = keys.split_dimensions(df, ["k0"], ["linhas", "i"])
    assert expands(got) == 0
    assert [tuple(r) for r in got.collect()] == [("1", 3, 2, 2), (None, 2, 0, 1)]
    assert got.columns == ["k0", "linhas", "distintos_linhas", "distintos_i"]
    assert [tuple(r) for r in keys.split_dimensions(df, ["k0"], []).collect()] == [("1", 3), (None, 2)]


def test_entities_are_counted_apart(spark):
    data = [("a", None, 0.0), ("a", "x", -0.0), (None, "x", 1.0), (None, None, None), (None, None, None)]
    df = spark.createDataFrame(data, "n string, i string, v double")
    entities = {"linhas_n": "n", "pares": ["n", "i"], "um": ["n"], "valores": "v"}
    got = volume.volumetry(df, entities)
    assert expands(got) == 0
    assert rows(got) == [{"linhas": 5, "linhas_n": 1, "pares": 4, "um": 2, "valores": 2}]
    assert rows(volume.volumetry(df.where("false"), entities)) == [dict.fromkeys(["linhas", *entities], 0)]
    assert rows(volume.volumetry(df, {})) == [{"linhas": 5}]


def test_attributes_agree_one_by_one(spark):
    a = spark.createDataFrame([(1, "x", "p"), (1, "y", "p"), (1, "y", "p"), (2, None, "q"), (None, "x", "q"), (3, "x", "q")], "k int, na string, coluna string")
    b = spark.createDataFrame([(1, "x", "q"), (1, "x", "p"), (2, "", "q"), (None, "x", "r"), (4, "x", "q")], "k int, na string, coluna string")
    got = coverage.attribute_agreement(a, b, ["k"], ["na", "coluna"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Expand " not in plan
    assert [tuple(r) for r in got.collect()] == [("A x B", "coluna", 5, 2), ("A x B", "na", 5, 2)]
    equal = coverage.attribute_agreement(a, b, ["k"], ["na", "coluna"], null_keys="equal")
    assert [tuple(r) for r in equal.collect()] == [("A x B", "coluna", 6, 3), ("A x B", "na", 6, 2)]
    assert coverage.attribute_agreement(a.where("false"), b.where("false"), ["k"], ["na"]).count() == 0


def test_long_lists_meet_the_table_without_sorting_its_rows(spark):
    entries = spark.createDataFrame([("1",), ("1",), ("2",), (None,), ("9",)], "chave string")
    df = spark.createDataFrame([("001", 1), ("1", 2), (None, 3), (None, 4), ("2", 5), ("5", 6)], "c string, v int")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    got = coverage.coverage(entries, df, "c")
    assert "Join" not in plan(got)
    assert [tuple(r) for r in got.collect()] == [(5, 3, 2, 5, 2, 2, 60.0)]
    assert [tuple(r) for r in coverage.coverage(entries.where("false"), df, "c").collect()] == [(0, 0, 0, 0, 0, 0, None)]
    assert [tuple(r) for r in coverage.coverage(entries, df.where("false"), "c").collect()] == [(5, 0, 5, 0, 0, 0, 0.0)]
    many = coverage.restrict_to_list(df, entries, "c", many=True)
    assert "ShuffledHashJoin" in plan(many) and "SortMergeJoin" not in plan(many)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, coverage.restrict_to_list(df, entries, "c").collect()))


def test_empty_table_still_reports_every_candidate(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert [r["linhas"] for r in rows(keys.grain(df, [["a"], ["a", "b"]]))] == [0, 0]
    assert rows(columns.fill_scan(df, mode="f3"))[0]["veredito"] == "SEM LINHAS"
    assert rows(keys.pure_vs_version(df, ["a"]))[0]["linhas"] == 0
    assert rows(volume.scenario_share(df, "a", "x"))[0]["pct_do_total"] is None


def test_identical_rows_against_versions(spark):
    df = spark.createDataFrame(
        [("a", 1), ("a", 1), ("a", 2), ("b", 1), ("b", 1), (None, 1), (None, 1), ("c", 9)], "k string, v int"
    )
    r = rows(keys.pure_vs_version(df, ["k"]))[0]
    assert r == {
        "chaves": 4, "linhas": 8, "chaves_duplicadas": 3, "linhas_duplicata_pura": 3,
        "chaves_com_mais_de_uma_versao": 1, "linhas_versao_excedente": 1,
    }
    # excess rows are either identical repeats or versions
    assert r["linhas"] - r["chaves"] == r["linhas_duplicata_pura"] + r["linhas_versao_excedente"]


def test_varying_columns_on_null_key(spark):
    df = spark.createDataFrame([(None, 1, "x"), (None, 2, "x"), ("a", 5, None)], "k string, v int, t string")
    r = by(keys.varying_columns(df, ["k"]), "coluna")
    assert r["v"]["max_valores_distintos"] == 2 and r["t"]["max_valores_distintos"] == 1
    assert r["t"]["veredito"] == "constante"


def test_varying_columns_without_duplicates(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert rows(keys.varying_columns(df, ["k"]))[0]["max_valores_distintos"] == 0


def test_hot_key_holding_most_rows(spark):
    """One key with nine tenths of the rows gives the same figures as counting by hand."""
    rnd = random.Random(5)
    data = [("hot" if rnd.random() < 0.9 else f"k{rnd.randrange(50)}", rnd.randrange(40)) for _ in range(5000)]
    df = spark.createDataFrame(data, "k string, v int").repartition(8)
    per = {}
    for k, v in data:
        per.setdefault(k, []).append(v)
    r = rows(keys.pure_vs_version(df, ["k"]))[0]
    assert r["chaves"] == len(per)
    assert r["linhas_duplicata_pura"] == sum(len(v) - len(set(v)) for v in per.values())
    worst = rows(keys.varying_columns(df, ["k"]))[0]["max_valores_distintos"]
    assert worst == max(len(set(v)) for v in per.values() if len(v) > 1)


# --- columns ---------------------------------------------------------------


@pytest.mark.parametrize("table", [itens, pedidos])
def test_fill_classes_add_up(spark, sf, table):
    df = table(spark, sf)
    n = df.count()
    for r in rows(columns.fill_scan(df)):
        assert r["nulos"] + r["vazios"] + r["zeros"] + r["uteis"] == n
    for r in rows(columns.fill_scan(df, mode="dev2")):
        assert r["nulos"] + r["zeros"] + r["uteis"] == n


def test_fill_verdict_ladder(spark):
    data = [(None, "", "0", "x" if i == 0 else " ", "v") for i in range(200)]
    df = spark.createDataFrame(data, "a string, b string, c string, d string, e string")
    v = {c: r["veredito"] for c, r in by(columns.fill_scan(df), "coluna").items()}
    assert v == {
        "a": "1. 100% NULO", "b": "2. SEM VALOR UTIL", "c": "2. SEM VALOR UTIL", "d": "3. QUASE VAZIO (<1%)", "e": "9. ok",
    }


def test_exact_cardinality_never_exceeds_rows_and_ignores_zero_sign(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (1.0,), (None,)], "x double")
    r = rows(columns.cardinality(df, exact=True))[0]
    assert r["distintos"] == 2


def test_long_texts_are_counted_whole(spark):
    base = "x" * 5000
    data = [(1, base + "a"), (1, base + "b"), (1, base + "a"), (1, " " * 90), (1, ""), (1, None), (2, base)]
    df = spark.createDataFrame(data, "k int, t string")
    assert by(columns.cardinality(df, exact=True), "coluna")["t"]["distintos"] == 5
    r = by(columns.fill_scan(df, mode="dev2"), "coluna")["t"]
    assert (r["nulos"], r["uteis"], r["distintos"]) == (3, 4, 5)
    assert rows(keys.varying_columns(df, ["k"]))[0]["max_valores_distintos"] == 4


def test_top_k_of_any_size(spark):
    df = spark.range(5000).select((F.col("id") > 1000).alias("g"), F.col("id").alias("n"))
    k = 1200
    got = S.top_k_per_group(df, ["g"], [F.desc("n")], k).groupBy("g").agg(F.count("*").alias("c"), F.min("n").alias("m"))
    assert {r.g: (r.c, r.m) for r in got.collect()} == {True: (k, 5000 - k), False: (1001, 0)}


def test_dedup_total(spark):
    df = spark.createDataFrame([("a", 10.0), ("a", 10.0), ("b", 5.0)], "k string, v double")
    r = rows(columns.dedup_total(df, ["k"], ["v"]))[0]
    assert (r["soma_ingenua"], r["soma_dedup"], r["diferenca"]) == (25.0, 15.0, 10.0)


def test_masked_distribution_keeps_people_apart(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    out = rules.masked_distribution(c, "c_name", None)
    assert out.count() == c.select("c_name").distinct().count()
    assert "c_name" not in out.columns


# --- codes and dates -----------------------------------------------------------


def test_code_collisions_and_alerts(spark):
    df = spark.createDataFrame([("01", 1), ("1", 2), (" 7", 3), (None, 4), ("", 5)], "c string, n int")
    r = by(codes.code_format(df, ["c", "n"]), "coluna")
    assert r["c"]["colisoes_ao_remover_zeros"] == 1 and r["c"]["vazios"] == 2
    assert "COLISAO" in r["c"]["alertas"] and "tem espacos" in r["c"]["alertas"]
    assert r["n"]["alertas"] == "TIPO NUMERICO - zeros a esquerda JA perdidos"


def test_mixed_date_formats_alert(spark):
    df = spark.createDataFrame([("20240101",), ("2024-01-01",), ("00000000",), ("0",), (None,)], "d string")
    r = rows(dates.string_date_profile(df, ["d"]))[0]
    assert r["veredito"].startswith("ALERTA") and r["data_zero"] == 2 and r["nao_reconhecido"] == 1
    assert rows(dates.valid_date_range(df, ["d"]))[0]["invalida"] == 2


def _walk(data, tol):
    """Continuity of the series by hand."""
    series = {}
    for k, d, ini, end in data:
        series.setdefault(k, []).append((d, ini, end))
    moved = good = gaps = 0
    longest = None
    for s in series.values():
        s.sort()
        for (d0, _, e0), (d1, i1, _) in zip(s, s[1:]):
            gap = (d1 - d0).days
            longest = gap if longest is None else max(longest, gap)
            gaps += gap > 1
            if e0 is not None:
                moved += 1
                good += abs(i1 - e0) <= tol
    return moved, good, moved - good, gaps, longest


@pytest.mark.parametrize("bucket", ["week", "month", "year"])
def test_series_continuity_is_the_same_for_any_bucket(spark, bucket):
    rnd = random.Random(11)
    data, level = [], {}
    for k in "abc":
        day = dt.date(2024, 1, 1)
        for _ in range(3 if k == "c" else 120):
            day += dt.timedelta(days=rnd.choice([1, 1, 1, 2, 40]))
            ini = level.get(k, 0.0) + (5.0 if rnd.random() < 0.2 else 0.0)
            end = None if rnd.random() < 0.05 else ini + rnd.randrange(9)
            level[k] = end if end is not None else ini
            data.append((k, day, ini, end))
    data.append(("single", dt.date(2024, 5, 5), 1.0, 1.0))
    df = spark.createDataFrame(data, "k string, d date, i double, e double")
    r = rows(dates.series_continuity(df, ["k"], "d", "i", "e", bucket=bucket))[0]
    assert (r["transicoes"], r["continuas"], r["quebradas"], r["com_lacuna_de_dias"], r["maior_lacuna_dias"], r["sem_data"]) == (*_walk(data, 0.001), 0)


def test_snapshot_and_history(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-01",)], "d string").select(F.col("d").cast("date"))
    assert rows(dates.snapshot_or_history(df, "d"))[0]["veredito"].startswith("SNAPSHOT")
    more = df.unionByName(spark.createDataFrame([(dt.date(2024, 1, 2),)], "d date"))
    assert rows(dates.snapshot_or_history(more, "d"))[0]["veredito"] == (
        "HISTORICO - acumula; a chave DEVE incluir d"
    )


def test_open_end_date_is_left_out_of_the_range(spark):
    df = spark.createDataFrame([("9999-12-31",), ("2024-01-01",), (None,)], "d string").select(F.col("d").cast("date"))
    r = rows(dates.sentinel_share(df, "d"))[0]
    assert r["sem_prazo_definido"] == 1 and r["mais_recente"] == dt.date(2024, 1, 1)


# --- rules and coverage ------------------------------------------------------------


def test_equation_needs_no_verdict_for_nulls(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, 2.0, 3.5), (None, 1.0, 1.0)], "a double, b double, c double")
    r = rows(rules.equation_check(df, df.a + df.b, "c", 0.001, ["a", "b", "c"]))[0]
    assert (r["equacao_ok"], r["divergentes"], r["com_campo_nulo"], r["maior_diferenca"]) == (1, 1, 1, 0.5)


def test_header_replication_by_hand(spark):
    rnd = random.Random(9)
    data = [(f"p{rnd.randrange(30)}", rnd.choice(["a", "b", "", None]), rnd.choice([1, 2, None])) for _ in range(200)]
    df = spark.createDataFrame(data, "p string, t string, n int")
    got = by(rules.header_replication(df, "p", ["t", "n"]), "campo")
    for i, c in ((1, "t"), (2, "n")):
        per = {}
        for r in data:
            if r[i] not in (None, ""):
                per.setdefault(r[0], set()).add(r[i])
        assert got[c]["pais_com_valor"] == len(per)
        assert got[c]["pais_com_mais_de_um_valor"] == sum(len(v) > 1 for v in per.values())


def test_funnel_is_monotone(spark, sf):
    p = pedidos(spark, sf)
    r = rows(volume.funnel(p, {"1": F.lit(True), "2": p.ind_aberto == "X", "3": p.vl_total > 1}, "cod_cliente"))
    assert [x["linhas"] for x in r] == sorted((x["linhas"] for x in r), reverse=True)
    assert [x["entidades"] for x in r] == sorted((x["entidades"] for x in r), reverse=True)


def test_key_list_parsing(spark):
    text = "num_remessa\r\n000123\n\n 77.0 \n412A\n77\nx y"
    lines = keylist.parse_text(spark, text)
    head = ("num_remessa",)
    assert [r["numero_linha"] for r in rows(lines.orderBy("numero_linha"))] == list(range(1, 8))
    got = {(r["chave_original"], r["chave"]) for r in rows(keylist.accepted_keys(lines, head))}
    assert got == {("000123", "123"), ("77.0", "77"), ("77", "77")}
    assert {(r["numero_linha"], r["valor_original"]) for r in rows(keylist.rejected_lines(lines, head))} == {
        (5, "412A"), (7, "x y"),
    }
    assert rows(keylist.input_control(lines, head))[0] == {
        "linhas_lidas": 7, "chaves_validas_distintas": 3, "linhas_rejeitadas": 2,
    }


def test_coverage_of_a_table_with_names_of_its_own(spark):
    table = spark.createDataFrame(
        [("0007", 3, "x"), ("7", None, "y"), ("9.0", 1, "z"), (None, 5, "w")], "c string, q int, chave string")
    listed = spark.createDataFrame([("7", "7"), ("007", "7"), ("9", "9"), ("11", "11")], "o string, chave string")
    r = rows(coverage.coverage(listed, table, "c"))[0]
    assert r["encontradas"] + r["ausentes"] == r["chaves_lista"] == 4
    assert (r["encontradas"], r["linhas_tabela"], r["chaves_repetidas"], r["max_linhas_por_chave"]) == (3, 5, 2, 2)
    s = rows(coverage.coverage_summary(listed, table, "c", "q", {"ultima": "q"}))[0]
    assert s["itens_adicionais"] == 2 and s["ultima"] == 3 and s["linhas_tabela"] == 5
    kept = rows(coverage.restrict_to_list(table, listed, "c"))
    assert sorted((k["chave"], k["chave_"]) for k in kept) == [("x", "7"), ("y", "7"), ("z", "9")]


def test_missing_keys_and_challenge(spark):
    table = spark.createDataFrame([("7",), ("8",)], "c string")
    listed = spark.createDataFrame([("7", "7"), ("5", "5")], "o string, chave string")
    gone = coverage.missing_keys(listed, table, "c")
    assert [r["o"] for r in rows(gone)] == ["5"]
    verdict = rows(coverage.challenge_missing(gone, "o", table, "c"))[0]["resultado_teste_direto"]
    assert verdict == "AUSENTE_MESMO_NA_COMPARACAO_DIRETA"


def test_agreement_counts_version_pairs(spark):
    """Counted pairs equal the pairs of a real join."""
    rnd = random.Random(3)
    make = lambda: spark.createDataFrame(
        [(rnd.randrange(6), rnd.choice("xyz"), rnd.choice(["p", None])) for _ in range(60)], "k int, f string, s string"
    )
    a, b = make(), make()
    got = by(coverage.attribute_agreement(a, b, ["k"], ["f", "s"]), "coluna")
    da, db = {tuple(r) for r in a.collect()}, {tuple(r) for r in b.collect()}
    pairs = [(x, y) for x in da for y in db if x[0] == y[0]]
    for i, c in ((1, "f"), (2, "s")):
        assert got[c]["em_comum"] == len(pairs)
        assert got[c]["diverge"] == sum((x[i] or "") != (y[i] or "") for x, y in pairs)


def test_orphans(spark):
    a = spark.createDataFrame([("001",), ("2",), ("",), (None,)], "c string")
    b = spark.createDataFrame([(1,)], "c int")
    assert rows(coverage.referential_integrity(a, "c", b, "c"))[0] == {
        "codigos_distintos_aqui": 2, "sem_correspondencia": 1, "pct_orfao": 50.0,
    }
    assert [r["codigo"] for r in rows(coverage.orphan_codes(a, "c", b, "c"))] == ["2"]


def test_reconcile_states_and_cells(spark):
    a = spark.createDataFrame(
        [("001", "20240101", 1.0, "x"), ("2", "20240102", 2.0, None), ("3", "", 3.0, "z"), ("5", "20240105", 5.0, "w"),
         ("6", None, None, None), ("6", None, None, None)],
        "k string, d string, v double, t string",
    )
    b = spark.createDataFrame(
        [("1", "01/01/2024", 1.005, " x"), ("02", "2024-01-03 00:00:00", 2.006, ""), ("3", "00000000", 3.0, "z"),
         ("3", "00000000", 3.0, "q"), ("4", "", 4.0, "y"), ("6", "", None, " ")],
        "k string, d string, v double, t string",
    )
    spec = reconcile.CompareSpec(["k"], ["d", "v", "t"], {"d": "date"})
    state = by(reconcile.reconcile_keys(a, b, spec), "situacao")
    assert {s: r["chaves"] for s, r in state.items()} == {
        "EM AMBAS": 3, "CHAVE COM VERSOES": 1, "SOMENTE A": 1, "SOMENTE B": 1,
    }
    assert state["EM AMBAS"]["repeticoes_a"] == 1
    cells = {(r["k"], r["coluna"]) for r in rows(reconcile.reconcile_cells(a, b, spec))}
    assert cells == {("2", "d"), ("2", "v")}
    c = by(reconcile.reconcile_columns(a, b, spec), "coluna")
    assert c["v"]["dentro_da_tolerancia"] == 1 and c["v"]["divergentes"] == 1 and c["t"]["identicas"] == 3
    assert {r["k"] for r in rows(reconcile.reconcile_unmatched(a, b, spec))} == {"3", "4", "5"}


# --- plan shape ------------------------------------------------------------------


def scans(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_one_scan_per_report(spark, sf):
    li, p = spark.read.parquet(f"{sf}/lineitem.parquet"), pedidos(spark, sf)
    for df in (
        columns.fill_scan(li), columns.cardinality(li), columns.cardinality(li, exact=True),
        keys.grain(li, [["l_orderkey"], ["l_orderkey", "l_linenumber"], ["l_partkey"]]),
        keys.duplicate_summary(li, [["l_orderkey"], ["l_partkey"]]), codes.code_format(p, ["num_pedido", "cod_cliente"]),
        dates.series_continuity(li, ["l_orderkey"], "l_shipdate", "l_quantity", "l_quantity"),
        rules.header_replication(p, "num_pedido", ["cod_cliente", "st_pedido"]),
        keys.pure_vs_version(li, ["l_orderkey"]),
    ):
        assert scans(df) == 1


def test_filters_and_columns_reach_the_scan(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    plan = columns.totals(c.where(c.c_mktsegment == "BUILDING"), ["c_acctbal"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan
    assert "ReadSchema: struct<c_acctbal:double,c_mktsegment:string>" in plan


def test_top_k_is_pruned_before_the_shuffle(spark, sf):
    p = pedidos(spark, sf)
    plan = columns.domain(p, ["cod_cliente", "st_pedido"], k=8)._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan


# --- reconciliation of hard cells, wide tables, odd names, large sums ------------


def test_reconcile_reads_no_agreement_into_unreadable_cells(spark):
    a = spark.createDataFrame([("1", "abc", "5,50"), ("2", "7", "n/d"), ("3", None, "x"), ("4", "1.5", "2")], "k string, v string, w string")
    b = spark.createDataFrame([("1", "xyz", "9,99"), ("2", "7.004", "n/d"), ("3", "y", "x"), ("4", "1.5", "dois")], "k string, v string, w string")
    spec = reconcile.CompareSpec(["k"], ["v", "w"], {"v": "double", "w": "double"})
    c = by(reconcile.reconcile_columns(a, b, spec), "coluna")
    assert [c["v"][x] for x in ("identicas", "dentro_da_tolerancia", "divergentes", "vazio_so_em_a", "ilegiveis")] == [1, 1, 1, 1, 2]
    assert [c["w"][x] for x in ("identicas", "divergentes", "ilegiveis")] == [2, 2, 4]
    cells = {(r["k"], r["coluna"], r["valor_a"], r["valor_b"]) for r in rows(reconcile.reconcile_cells(a, b, spec))}
    assert ("1", "v", "abc", "xyz") in cells and ("4", "w", "2.0", "dois") in cells


def test_reconcile_keeps_every_decimal_place_and_nan(spark):
    a = spark.sql("SELECT '1' AS k, CAST(1.00000011 AS DECIMAL(18, 8)) AS e, double('NaN') AS d, array(1, 2) AS l")
    b = spark.sql("SELECT '1' AS k, CAST(1.0000002200 AS DECIMAL(20, 10)) AS e, double('NaN') AS d, array(1, 3) AS l")
    c = by(reconcile.reconcile_columns(a, b, reconcile.CompareSpec(["k"], ["e", "d", "l"], {"e": "exact"})), "coluna")
    assert (c["e"]["divergentes"], c["d"]["identicas"], c["d"]["divergentes"], c["l"]["divergentes"]) == (1, 1, 0, 1)


def test_reconcile_pairs_equal_versions(spark):
    a = spark.createDataFrame([("1", 1.0), ("1", 2.0), ("2", 1.0), ("2", 2.0), ("3", 1.0), ("3", 2.0)], "k string, v double")
    b = spark.createDataFrame([("1", 2.0), ("1", 1.0), ("1", 1.0), ("2", 1.0), ("2", 5.0), ("3", 8.0), ("3", 9.0)], "k string, v double")
    spec = reconcile.CompareSpec(["k"], ["v"])
    state = by(reconcile.reconcile_keys(a, b, spec), "situacao")
    assert (state["EM AMBAS"]["chaves"], state["CHAVE COM VERSOES"]["chaves"]) == (2, 1)
    c = rows(reconcile.reconcile_columns(a, b, spec))[0]
    assert (c["comparadas"], c["identicas"], c["divergentes"]) == (4, 3, 1)
    assert [(r["k"], r["valor_a"], r["valor_b"]) for r in rows(reconcile.reconcile_cells(a, b, spec))] == [("2", "2.0", "5.0")]


def test_sums_beyond_the_range_of_bigint(spark):
    df = spark.createDataFrame([(2**62,), (2**62,), (2**62,)], "n long")
    assert rows(columns.totals(df))[0]["total_numerico"] == float(3 * 2**62)
    assert rows(columns.totals(df, by=[F.lit(1).alias("g")]))[0]["soma_n"] == float(3 * 2**62)
    assert rows(columns.totals(df, scopes={"t": F.lit(True)}))[0]["total_t"] == float(3 * 2**62)
    assert rows(columns.numeric_profile(df, mode="sum"))[0]["soma"] == float(3 * 2**62)
    assert rows(columns.dedup_total(df, ["n"], ["n"]))[0]["soma_ingenua"] == float(3 * 2**62)


@pytest.mark.parametrize("width", [93, 300])
def test_wide_tables_are_profiled_in_batches(spark, width):
    df = spark.range(50).select(*[F.concat(F.lit("v"), F.col("id") % (i + 1)).alias(f"st_{i}") for i in range(width)])
    got = by(columns.fill_scan(df), "coluna")
    assert len(got) == width and all(r["uteis"] == 50 for r in got.values())
    plan = columns.fill_scan(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == -(-width // S.BATCH_ROWS)


def test_contents_of_two_extracts_are_counted_once(spark):
    side = lambda n: spark.range(300).select(F.col("id").cast("string").alias("k"), (F.col("id") % n).cast("string").alias("v"))
    spec = reconcile.CompareSpec(["k"], ["v"], {"v": "exact"})
    for report in (reconcile.reconcile_columns, reconcile.reconcile_cells):
        df = report(side(7), side(8), spec)
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert final.count("Range (") <= 4, report.__name__  # each side for the contents, and for the cells that are left


@pytest.mark.parametrize("n", ["0", "-0", "+0.0", ".5", "5.", "-.50", "007", "-007.0700", "100", "100.", "0.10", "00.00", "1" * 300 + ".0", " 12.50 ", "-0.000"])
def test_plain_numbers_read_as_those_with_an_exponent(spark, n):
    short, long = spark.range(1).select(*[N.canonical_number(F.lit(x)) for x in (n, n.strip() + "e0")]).first()
    assert short == long is not None


def test_wide_tables_are_profiled_in_compiled_code(spark, capsys):
    cell = lambda i: F.when(F.col("id") % 7 == i % 7, None).when(F.col("id") % (i + 2) == 0, "").otherwise(F.concat(F.lit("v"), F.col("id") % (i + 1)))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # shows the code before the plan has run
    try:
        columns.fill_scan(spark.range(50).select(*[cell(i).alias(f"st_{i}") for i in range(32)])).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000  # longer methods are interpreted


def test_names_of_any_kind(spark):
    df = spark.createDataFrame([("a", "1", "x"), ("b", None, "x")], "classe_0 string, `a.b` string, formato_0 string")
    got = by(columns.fill_scan(df), "coluna")
    assert set(got) == {"classe_0", "a.b", "formato_0"} and got["a.b"]["nulos"] == 1
    assert rows(keys.grain(df, [["a.b"], ["classe_0"]]))[0]["linhas"] == 2
    assert {r["coluna"] for r in rows(columns.cardinality(df, exact=True))} == {"classe_0", "a.b", "formato_0"}
    dates.string_date_profile(df, ["classe_0", "formato_0"]).collect()


def test_undated_rows_are_counted_apart(spark):
    df = spark.createDataFrame([("k", "20240101", 0.0, 1.0), ("k", "20240102", 1.0, 2.0), ("k", None, 9.0, 9.0), ("k", "???", 9.0, 9.0)],
                               "k string, d string, i double, f double")
    r = rows(dates.series_continuity(df, ["k"], "d", "i", "f"))[0]
    assert (r["transicoes"], r["continuas"], r["sem_data"]) == (1, 1, 2)


def test_list_reports_start_no_job_before_they_are_read(spark):
    table = spark.createDataFrame([("7", 1)], "c string, q int")
    listed = spark.createDataFrame([("7", "7")], "o string, chave string")
    spark.sparkContext.setJobGroup("lazy", "lazy")
    coverage.coverage(listed, table, "c")
    coverage.restrict_to_list(table, listed, "c")
    coverage.coverage_summary(listed, table, "c", "q", {"u": "q"})
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")) == []


NAMES = ["a.b", "classe_0", "chave"]


def _named(spark):
    rows = [("001", "x", 1.0), ("001", "x", 1.0), ("2", None, 3.5), (None, "y", None), ("1", "y", 0.0), (None, "y", 2.0)]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {t}" for n, t in zip(NAMES, ("string", "string", "double"))))


def test_names_of_any_kind(spark):
    """Columns with a dot, and with names that operators use themselves, in every operator that takes names."""
    from crivo import TableSpec, plans
    from crivo.operators import codes, columns, coverage, keys, volume
    from crivo.sources import sink

    df, plain = _named(spark), _named(spark).toDF("c1", "c2", "c3")
    back = dict(zip(("c1", "c2", "c3"), NAMES))
    listed = spark.createDataFrame([("1",), ("2",)], "chave string")
    calls = {
        "duplicate_keys": lambda d, k: keys.duplicate_keys(d, k[:1]), "duplicate_rows": lambda d, k: keys.duplicate_rows(d, k[:1]),
        "duplicate_rows_using": lambda d, k: keys.duplicate_rows(d, k[:1], null_keys=False),
        "varying": lambda d, k: keys.varying_columns(d, k[:1]), "distribution": lambda d, k: columns.distribution(d, k[:2]),
        "checksum": lambda d, k: keys.row_checksum(d), "checksum_json": lambda d, k: keys.row_checksum(d, mode="json"), "versions": lambda d, k: keys.pure_vs_version(d, k[:2]),
        "grain": lambda d, k: keys.grain(d, [k[:1], k]), "multiplicity": lambda d, k: keys.multiplicity(d, k[:2]), "attributes": lambda d, k: keys.attribute_versions(d, k[:1], k[1:]),
        "split": lambda d, k: keys.split_dimensions(d, k[:1], k[1:2]), "items": lambda d, k: keys.items_per_parent(d, k[:1], k[1]),
        "members": lambda d, k: keys.collapse_members(d, k[:1], k[1]), "repeated": lambda d, k: keys.repeated_child(d, k[:1], k[1], k[2]), "dedup": lambda d, k: columns.dedup_total(d, k[:1], k[2:]),
        "restrict": lambda d, k: coverage.restrict_to_list(d, listed, k[0]).select(F.col("`" + k[1] + "`")), "covered": lambda d, k: coverage.coverage(listed, d, k[0]),
        "candidates": lambda d, k: volume.scenario_candidates(d, k[1]), "gate": lambda d, k: volume.scenario_gate(d, k[1]), "share": lambda d, k: volume.scenario_share(d, k[1], "x"),
        "extract": lambda d, k: sink.extract(d, order=k[:1], pii=k[1:2]), "fill": lambda d, k: columns.fill_scan(d, mode="dev2"), "normalized": lambda d, k: codes.normalized_keys(d, k[:1]),
    }
    for name, call in calls.items():
        mine, theirs = call(df, NAMES).collect(), call(plain, list(back)).collect()
        renamed = [re.sub("c[123]", lambda m: back[m[0]], repr(tuple(r))) for r in theirs]
        assert sorted(map(repr, map(tuple, mine))) == sorted(renamed), name
    spec = TableSpec("t", keys=[NAMES[:1], NAMES[:2]], dimensions=["classe_0"], roles={"a.b": "code", "classe_0": "category", "chave": "measure"}, pii=[])
    for name, report in plans.explore(df, spec).items():
        report.collect()
    assert plans.long_report(plans.explore_profile(df, spec).run()).count() > 50
