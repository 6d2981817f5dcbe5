"""States per day, bucketed joins, footers, numbered files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from crivo.operators import coverage, history
from crivo.sources import keylist, metadata, sink

def day():
    return F.col("dia_carga")


@pytest.fixture(scope="module")
def loads(spark):
    rows = spark.range(20_000).select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 20).cast("int")).alias("dia_carga"), (F.col("id") % 3000).alias("a.b"),
        F.when(F.col("id") % 10 != 0, F.col("id").cast("double")).alias("valor"), F.lit(None).cast("string").alias("vazio"))
    return rows


def test_states_merge_to_what_all_rows_give(spark, loads, tmp_path):
    path, cols = str(tmp_path / "estado"), ["a.b", "valor", "vazio"]
    history.extend(path, loads.where(day() < "2024-01-11"), day(), cols)
    state = history.extend(path, loads, day(), cols)
    got = {r.coluna: r for r in history.merged(state).collect()}
    assert {c: (r.dias, r.linhas, r.preenchidos) for c, r in got.items()} == {"a.b": (20, 20_000, 20_000), "valor": (20, 20_000, 18_000), "vazio": (20, 20_000, 0)}
    assert abs(got["a.b"].distintos - 3000) < 150 and abs(got["valor"].distintos - 18_000) < 900 and got["vazio"].distintos == 0
    assert got["vazio"].percentis is None and abs(got["valor"].percentis[0] - 10_000) < 400 and abs(got["valor"].percentis[1] - 19_000) < 400
    part = {r.coluna: r.linhas for r in history.merged(state, "2024-01-05", "2024-01-06").collect()}
    assert part["valor"] == 2000


def test_a_new_day_is_the_only_one_read(spark, loads, tmp_path):
    """Once their state is kept, the files of older days may be gone."""
    import shutil

    table, path = str(tmp_path / "tabela"), str(tmp_path / "estado")
    loads.where(day() < "2024-01-11").write.partitionBy("dia_carga").parquet(table)
    history.extend(path, spark.read.parquet(table), day(), ["valor"])
    loads.where(day() == "2024-01-11").write.mode("append").partitionBy("dia_carga").parquet(table)
    grown = spark.read.parquet(table)
    for i in range(1, 11):
        for f in (tmp_path / "tabela" / f"dia_carga=2024-01-{i:02d}").iterdir():
            f.unlink()
    state = history.extend(path, grown, day(), ["valor"])
    assert [(r.dia, r.versao) for r in state.where("versao = 2").collect()] == [(dt.date(2024, 1, 11), 2)]
    assert history.merged(state).first().linhas == 11_000
    shutil.rmtree(tmp_path / "tabela")


def test_a_day_that_comes_again_counts_once(spark, loads, tmp_path):
    path = str(tmp_path / "estado")
    history.extend(path, loads, day(), ["valor"])
    late = loads.unionByName(loads.where(day() == "2024-01-03"))
    state = history.extend(path, late, day(), ["valor"], again=["2024-01-03"])
    assert history.merged(state, "2024-01-03", "2024-01-03").first().linhas == 2000
    assert history.merged(state).first().linhas == 21_000
    assert history.merged(history.read_state(spark, str(tmp_path / "nichts"))).collect() == []


def test_bucketed_tables_join_without_a_shuffle(spark, sf):
    from workload.history import bucketed_sides

    a, b = bucketed_sides(spark, sf)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = coverage.compare_bucketed(a, b, ["num"], "preco")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    below = plan[plan.index("SortMergeJoin"):]
    assert "Exchange" not in below and below.count("Bucketed: true") == 2


def test_footers_answer_without_reading_pages(spark, sf):
    path = f"{sf}/lineitem.parquet"
    before = {k: spark.conf.get(k, None) for k in metadata.FOOTERS}
    try:
        for k, v in metadata.FOOTERS.items():
            spark.conf.set(k, v)
        plan = metadata.footer_query(spark, path, ["l_partkey"])._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "PushedAggregation: [COUNT(*), COUNT(l_partkey), MIN(l_partkey), MAX(l_partkey)]" in plan
    metadata.footer_volumes(spark, path, ["l_partkey"])
    assert {k: spark.conf.get(k, None) for k in metadata.FOOTERS} == before


def test_lines_of_several_files_are_numbered_in_file_order(spark, tmp_path):
    sizes = (3, 4000, 1, 900, 20_000)
    n, want = 0, []
    for i, size in enumerate(sizes):
        lines = [f"{i}-{j}" for j in range(size)]
        (tmp_path / f"lista_{i}.txt").write_text("\n".join(lines) + "\n")
        want += lines
        n += size
    for limit in ("128m", "8192"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            got = [r.valor_original for r in keylist.read_lines(spark, str(tmp_path)).orderBy("numero_linha").collect()]
            numbers = keylist.read_lines(spark, str(tmp_path)).agg(F.min("numero_linha"), F.max("numero_linha"), F.countDistinct("numero_linha")).first()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert got == want and tuple(numbers) == (1, n, n)
    assert sink.save_bucketed
