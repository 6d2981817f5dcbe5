"""Scans, sinks, metadata and whole profiles."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from crivo import TableSpec, plans, role_of
from crivo.operators import volume
from crivo.sources import keylist, metadata, scan, sink
from workload.base import eventos, itens, pedidos


def test_empty_parameters_add_no_predicate(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    assert scan.optional_filters(o, {"o_orderstatus": "", "o_custkey": None}).count() == o.count()
    scan.base_view(o, {"o_orderstatus": "F"}, "base_teste")
    assert spark.table("base_teste").where("o_orderstatus <> 'F'").count() == 0
    assert scan.parameters(spark, {"a": "1", "b": None}).collect()[0].asDict() == {"a": "1", "b": ""}


def test_safe_base_gives_null_for_unreadable_values(spark):
    df = spark.createDataFrame([("12", "20240101"), ("412A", "20241399"), (None, "00000000")], "n string, d string")
    got = [tuple(r) for r in scan.safe_base(df, {"n": "bigint"}, {"d": "yyyyMMdd"}).collect()]
    assert got == [(12, dt.date(2024, 1, 1)), (None, None), (None, None)]


def test_text_file_lines_are_numbered_over_all_splits(spark, tmp_path):
    path = tmp_path / "lista.txt"
    path.write_text("".join(f"{i}\r\n" for i in range(1, 5001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        lines = keylist.read_lines(spark, str(path))
        assert lines.where("numero_linha <> cast(valor_original as bigint)").count() == 0
        assert lines.select("numero_linha").distinct().count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_extract_masks_orders_and_writes(spark, sf, tmp_path):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    out = sink.extract(c, pii=["c_name"], order=["c_custkey"])
    assert "c_name" not in out.columns and "c_name_hash" in out.columns
    assert "c_name_hash" not in sink.extract(c, pii=["c_name"], drop_pii=True).columns
    sink.write_csv(out, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == c.count() and set(back.columns) == set(out.columns)
    sink.write_parquet(c, str(tmp_path / "pq"), ["c_mktsegment"])
    assert spark.read.parquet(str(tmp_path / "pq")).count() == c.count()


def test_extract_in_key_order(spark):
    df = spark.range(200).select(F.lit("k").alias("k"), (199 - F.col("id")).alias("v"))
    two = df.unionByName(df.withColumn("k", F.lit("a")))
    got = [r.k for r in sink.extract(two, order=["k"]).collect()]
    assert got == ["a"] * 200 + ["k"] * 200


def test_save_table_with_buckets(spark, sf, tmp_path):
    o = spark.read.parquet(f"{sf}/orders.parquet").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    spark.sql(f"CREATE DATABASE IF NOT EXISTS t_extr LOCATION '{tmp_path}/t_extr'")
    try:
        sink.save_table(o, "t_extr.extracao", ["o_orderkey"], 4)
        t = scan.read_table(spark, "t_extr.extracao")
        assert t.count() == o.count()
        assert metadata.describe_extended(spark, "t_extr.extracao").where("col_name = 'Num Buckets'").count() == 1
        assert "o_orderkey" in metadata.show_create(spark, "t_extr.extracao").collect()[0][0]
    finally:
        spark.sql("DROP DATABASE t_extr CASCADE")


def test_metadata_reports(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    assert [r.coluna for r in metadata.describe_columns(o).collect()] == o.columns
    assert metadata.column_count(o, "orders").collect()[0].colunas == 6
    d = metadata.describe_detail(o).collect()[0]
    assert d.arquivos == 1 and d.linhas == o.count() and d.bytes > 0
    assert metadata.write_history(o).collect()[0].linhas == o.count()


def test_scenario_predicates(spark, sf):
    p = pedidos(spark, sf)
    n = p.where(scan.trimmed_equals(p, "ind_aberto", "")).count()
    assert n == p.where("trim(ind_aberto) = ''").count() > 0
    assert p.where(scan.prefixed(p, "tp_prioridade", "1")).count() == p.where("tp_prioridade like '1%'").count()
    assert p.where(scan.in_list(p, "st_pedido", ["F"])).count() == p.where(scan.equals(p, "st_pedido", "F")).count()
    gate = volume.scenario_gate(p.where(scan.equals(p, "st_pedido", "F")), "st_pedido").collect()[0]
    assert gate.valores_distintos == 1


def test_roles_follow_prefixes_then_types():
    assert [role_of(c) for c in ("cod_x", "vl_y", "dt_z", "ind_a", "nm_b", "tp_c", "other")] == [
        "code", "measure", "time", "flag", "text", "category", "other",
    ]


SPEC = TableSpec(
    name="pedidos", keys=[["num_pedido"], ["cod_cliente", "dt_pedido"]], pii=["cod_cliente"],
    ingest="dt_carga", dimensions=["st_pedido"], entities={"clientes": "cod_cliente"},
    declared_empty=["cod_obsoleto"], date_rules={"pedido <= carga": ("dt_pedido", "dt_carga")}, expected_rows=1500,
    clustering=["num_pedido"],
)


@pytest.mark.parametrize("build", ["explore", "scenario", "canary"])
def test_every_section_of_a_profile_runs(spark, sf, build):
    df = pedidos(spark, sf)
    spec = SPEC.with_scenario("st_pedido", "F") if build == "scenario" else SPEC
    sections = getattr(plans, build)(df, spec, as_of="2002-01-01")
    assert len(sections) >= 15
    for name, report in sections.items():
        assert report.columns, name
        report.write.format("noop").mode("overwrite").save()
    # personal columns never leave in clear
    for name in ("sample", "wide_sample", "random_sample", "extraction"):
        if name in sections:
            assert "cod_cliente" not in sections[name].columns


def test_key_list_profile(spark, sf, tmp_path):
    df = itens(spark, sf)
    lines = keylist.parse_text(spark, "chave\n0000000001\n2.0\nabc\n99999999")
    out = plans.validate_key_list(
        lines, df.withColumn("qt_itens", F.lit(2)), "num_pedido", items="qt_itens", latest={"ultima": "dt_remessa"}
    )
    cov = out["coverage"].collect()[0]
    assert cov.encontradas + cov.ausentes == cov.chaves_lista == 3
    assert out["summary"].collect()[0].chaves_lista == 3
    assert out["input_control"].collect()[0].linhas_rejeitadas == 1
    sink.write_reports({k: out[k] for k in ("coverage", "missing", "rejected_lines")}, str(tmp_path))
    assert spark.read.option("header", True).csv(f"{tmp_path}/missing").count() == cov.ausentes
    for name, report in out.items():
        report.write.format("noop").mode("overwrite").save()


def test_fused_profile_agrees_with_the_lazy_one(spark, sf, tmp_path):
    """Few shared passes give the reports the separate sections give."""
    from dataclasses import replace

    df = pedidos(spark, sf)
    spec = replace(SPEC, rules={"aberto": F.col("ind_aberto") == "X"}, keys=[["st_pedido", "dt_pedido"], ["num_pedido"]])
    lazy = plans.explore(df, spec, as_of="2002-01-01")
    done = plans.fused(df, spec, work_dir=str(tmp_path), as_of="2002-01-01")
    assert set(lazy) <= set(done)
    assert done["random_sample"].count() == lazy["random_sample"].count()
    for name in sorted(set(lazy) - {"sample", "random_sample"}):
        a, b = lazy[name].collect(), done[name].collect()
        assert sorted(map(repr, a)) == sorted(map(repr, b)), name
    from crivo.operators import keys

    assert done["checksum"].collect() == keys.row_checksum(df).collect()
    assert done["versions"].collect() == keys.pure_vs_version(df, spec.key).collect()


def test_fused_profile_of_times_and_instants(spark, sf, tmp_path):
    df = eventos(spark, sf)
    spec = TableSpec("eventos", keys=[["event_id"], ["user_id", "ts"]], ingest="ts", dimensions=["event_type", "user_id"], pii=["user_id"])
    lazy, done = plans.explore(df, spec, as_of="2024-03-01"), plans.fused(df, spec, work_dir=str(tmp_path), as_of="2024-03-01")
    assert {"times", "timestamps", "snapshot", "freshness", "distribution_event_type", "distribution_user_id", "pii", "duplicate_keys"} <= set(lazy) <= set(done)
    for name in sorted(set(lazy) - {"sample", "random_sample"}):
        assert sorted(map(repr, lazy[name].collect())) == sorted(map(repr, done[name].collect())), name


def test_shared_dir_follows_the_cluster_setting(tmp_path):
    from types import SimpleNamespace

    from crivo.session import shared_dir

    def session(master, folder):
        conf = SimpleNamespace(get=lambda key, default=None: folder if key == "spark.checkpoint.dir" else default)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    assert shared_dir(session("spark://host:7077", str(tmp_path)), "x").startswith(f"{tmp_path}/x-")
    for master in ("local[2]", "spark://host:7077"):
        with pytest.raises(ValueError):
            shared_dir(session(master, None), "x")


def test_reports_are_written_by_all_their_tasks(spark, tmp_path):
    from crivo.operators import columns

    big = spark.range(0, 1000, 1, 6)
    sink.write_reports({"extracao": big}, str(tmp_path))
    assert len([f for f in (tmp_path / "extracao").iterdir() if f.suffix == ".csv"]) == 6
    first = plans.fused(big.toDF("num_x"), TableSpec("t", keys=[["num_x"]]), work_dir=str(tmp_path))
    plans.fused(big.where("id < 10").toDF("num_x"), TableSpec("t", keys=[["num_x"]]), work_dir=str(tmp_path))
    assert first["grain"].first().linhas == 1000 and first["fill"].count() == len(columns.fill_scan(big).collect())


@pytest.mark.parametrize("build", ["explore", "scenario", "canary"])
def test_planned_profiles_make_few_passes(spark, sf, build):
    """Passes over the table, counted in their plans: those of aggregates, and at most six besides."""
    path = f"{sf}/orders.parquet"
    df = pedidos(spark, sf)
    spec = SPEC.with_scenario("st_pedido", "F") if build == "scenario" else SPEC
    profile = getattr(plans, f"{build}_profile")(df, spec, as_of="2002-01-01")
    passes = profile.passes()
    scans = {n: p._jdf.queryExecution().optimizedPlan().toString().count("Relation ") for n, p in passes.items()}
    rows = sum(len(s.rows) for s in profile.row_sections.values())
    batches = [n for n in scans if n.startswith("linha_")]
    assert len(batches) == -(-rows // 30) and all(scans[n] == 1 for n in batches), path
    others = {n: k for n, k in scans.items() if n not in batches}
    # what varies in repeated keys reads the keys and then their rows; all others read once
    assert others.pop("variacao") == 2 and all(k == 1 for k in others.values())
    extra = {"explore": {"pessoais"}, "scenario": {"pessoais", "valores_do_filtro", "chaves_normalizadas"}, "canary": {"pessoais", "entidades", "distintos", "codigos_numericos"}}
    assert set(others) - extra[build] == {"frequencias", "chaves", "versoes", "repetidas"}


def test_planned_profiles_agree_with_the_lazy_ones(spark, sf, tmp_path):
    df = pedidos(spark, sf)
    for build, spec in (("scenario", SPEC.with_scenario("st_pedido", "F")), ("canary", SPEC)):
        lazy = getattr(plans, build)(df, spec, as_of="2002-01-01")
        done = getattr(plans, f"{build}_profile")(df, spec, as_of="2002-01-01").run(str(tmp_path))
        for name in sorted(set(lazy) & set(done) - {"sample", "random_sample", "extraction", "checksum", "distribution_st_pedido", "codes"}):
            assert sorted(map(repr, lazy[name].collect())) == sorted(map(repr, done[name].collect())), name


def test_long_report_of_all_sections(spark, sf):
    out = plans.long_report(plans.canary_profile(pedidos(spark, sf), SPEC, as_of="2002-01-01").run())
    assert out.columns == ["secao", "item", "medida", "valor", "veredito"]
    rows = {(r.secao, r.item, r.medida): r.valor for r in out.collect()}
    assert rows[("volume_check", "", "diferenca")] == "0" and rows[("grain", "num_pedido", "linhas_por_chave")] == "1.0000"
    assert not [k for k in rows if k[0] in ("sample", "metadata")]
