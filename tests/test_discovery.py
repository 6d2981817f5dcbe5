"""Discovery against enumeration of all column sets, dependencies and references on small tables."""

import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from crivo.operators import discovery


def frame(spark, rows, names):
    return spark.createDataFrame(rows, ", ".join(f"`{n}` int" for n in names))


def table(seed, n, widths):
    r = random.Random(seed)
    return [tuple(None if r.random() < 0.05 else r.randrange(w) for w in widths) for _ in range(n)]


def test_minimal_keys_are_all_and_minimal(spark, monkeypatch):
    monkeypatch.setattr(discovery, "SETS_PER_PASS", 3)
    for seed, n in ((1, 12), (2, 40), (3, 1)):
        names = ["a.b", "chave", "n", "x0"]
        rows = table(seed, n, (6, 12, 9, 30))
        unique = [s for k in range(1, 5) for s in combinations(range(4), k) if len({tuple(r[i] for i in s) for r in rows}) == n]
        want = {" + ".join(names[i] for i in s) for s in unique if not any(set(u) < set(s) for u in unique)}
        got = discovery.minimal_keys(frame(spark, rows, names), most=4).collect()
        assert {r.chave for r in got} == want and all(r.linhas == n for r in got)


def test_an_empty_table_has_no_keys_and_repeated_rows_none(spark):
    assert discovery.minimal_keys(frame(spark, [], ["a", "b"])).collect() == []
    assert discovery.minimal_keys(frame(spark, [(1, 2), (1, 2), (None, None)], ["a", "b"])).collect() == []


def test_nulls_on_either_side_are_different_rows(spark):
    got = discovery.minimal_keys(frame(spark, [(1, None), (None, 1), (1, 1), (None, None)], ["a", "b"])).collect()
    assert [r.chave for r in got] == ["a + b"]


def test_errors_of_dependencies(spark):
    names, rows = ["a.b", "b", "c"], table(5, 60, (4, 3, 3))
    got = {(r.esquerda, r.direita): r.erro for r in discovery.dependencies(frame(spark, rows, names)).collect()}

    def error(left, right):
        groups = {}
        for r in rows:
            groups.setdefault(tuple(r[i] for i in left), Counter())[r[right]] += 1
        return sum(sum(g.values()) - max(g.values()) for g in groups.values())

    want = {(" + ".join(names[i] for i in left), names[right]): error(left, right)
            for k in (1, 2) for left in combinations(range(3), k) for right in range(3) if right not in left}
    assert got == want


def test_what_a_part_determines_is_not_repeated(spark):
    df = spark.createDataFrame([(i, i % 7, i % 7 * 2, i % 3) for i in range(100)], "id int, a int, twice int, c int")
    got = {(r.esquerda, r.direita) for r in discovery.dependencies(df, most_error=0.0).collect()}
    assert got == {("id", "a"), ("id", "twice"), ("id", "c"), ("a", "twice"), ("twice", "a")}
    assert discovery.dependencies(df.where("id < 0")).where("erro <> 0").count() == 0


def test_references_and_orphans(spark):
    left = spark.createDataFrame([("001",), ("2",), ("2",), (None,), ("9",)], "cod string")
    right = spark.createDataFrame([(1, "x"), (2, "2"), (3, None)], "`a.b` int, nome string")
    got = {(r.coluna, r.em): (r.distintos, r.em_comum, r.orfaos, r.linhas_orfas) for r in discovery.inclusions({"l": left, "r": right}, codes=True).collect()}
    assert got[("l.cod", "r.a.b")] == (3, 2, 1, 1) and got[("r.nome", "l.cod")] == (2, 1, 1, 1) and got[("r.nome", "r.a.b")] == (2, 1, 1, 1)
    plain = {(r.coluna, r.em): r.em_comum for r in discovery.inclusions({"l": left, "r": right}).collect()}
    assert plain[("l.cod", "r.a.b")] == 1
    assert discovery.inclusions({"l": left.where("false")}).collect() == []


def test_sets_of_one_anchor_share_a_shuffle_of_rows(spark, monkeypatch):
    """Every set of columns that may be a key is counted, of all types, with values that repeat within one task only."""
    monkeypatch.setattr(discovery, "ENTRIES_PER_TASK", 300)
    df = spark.range(600).select(
        (F.col("id") % 300).alias("a"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("t"), F.col("id") % 4)).alias("b"), (F.col("id") >= 300).alias("c"),
        F.when(F.col("id") % 2 == 0, -0.0).otherwise(0.0).alias("d"), (F.col("id") % 200).cast("decimal(20,1)").alias("e"))
    dealt = []
    deal = discovery._dealt
    monkeypatch.setattr(discovery, "_dealt", lambda *x: dealt.append(x) or deal(*x))
    rows = [tuple(r) for r in df.collect()]
    unique = [s for k in range(1, 5) for s in combinations(range(5), k) if len({tuple(r[i] for i in s) for r in rows}) == 600]
    want = {" + ".join("abcde"[i] for i in s) for s in unique if not any(set(u) < set(s) for u in unique)}
    assert {r.chave for r in discovery.minimal_keys(df, most=4).collect()} == want and dealt
    assert all(x[4] > 1 for x in dealt)


def test_errors_are_counted_where_the_rows_lie(spark, monkeypatch):
    """Left sides with a column of many values are dealt by it; none of theirs is shuffled set by set."""
    df = spark.range(90).select((F.col("id") % 45).alias("a"), F.concat(F.lit("t"), F.col("id") % 4).alias("b"), (F.col("id") % 7).alias("c"))
    shuffled = []
    errors = discovery._errors
    monkeypatch.setattr(discovery, "_errors", lambda cells, wanted: shuffled.extend(wanted) or errors(cells, wanted))
    rows = [tuple(r) for r in df.collect()]
    got = {(r.esquerda, r.direita): r.erro for r in discovery.dependencies(df, most=1).collect()}
    want = {}
    for left in range(3):
        for right in range(3):
            if left != right:
                n = Counter((r[left], r[right]) for r in rows)
                want["abc"[left], "abc"[right]] = len(rows) - sum(max(k for (x, _), k in n.items() if x == v) for v in {r[left] for r in rows})
    assert got == want and not shuffled
