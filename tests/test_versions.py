"""Canonical numbers against exact arithmetic, and the pairing of versions against a greedy search over all pairs."""

import hashlib
import random
from decimal import Decimal, localcontext

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crivo.functions import normalize as N
from crivo.operators import reconcile, versions
from crivo.operators.versions import pair_versions


def plain(text):
    """What the canonical text must be, by decimals of unlimited precision."""
    with localcontext() as c:
        c.prec = 2000
        d = Decimal(text)
        if d == 0:
            return "0"
        shown = format(d, "f")
        return (shown.rstrip("0").rstrip(".") if "." in shown else shown).lstrip("+")


NUMBERS = st.from_regex(r"[+-]?([0-9]{1,40}(\.[0-9]{0,40})?|\.[0-9]{1,40})([eE][+-]?[0-9]{1,2})?", fullmatch=True)


@settings(max_examples=5, deadline=None)
@given(st.lists(NUMBERS, min_size=40, max_size=80))
def test_canonical_numbers(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", N.canonical_number(F.col("t")).alias("c")).collect()
    assert [r.c for r in rows] == [plain(r.t) for r in rows]


@pytest.mark.parametrize("text", ["", " ", "1,5", "abc", "1e", "--1", "1.2.3", "NaN", "Infinity", ".", "1e99999999999", "0x1f", "1_000"])
def test_what_is_no_number(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(N.canonical_number(F.col("t"))).first()[0] is None


def test_far_exponents_stay_short(spark):
    rows = spark.createDataFrame([("1e999999",), ("10e999998",), ("-1e-999999",)], "t string").select(N.canonical_number(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["0.1e1000000", "0.1e1000000", "-0.1e-999998"]


def frame(spark, contents):
    """(chave, lado, id, celulas) of (key, side, cells)."""
    rows = [(k, side, hashlib.md5(repr((k, side, cells)).encode()).hexdigest(), [hash((i, c)) % 2**62 for i, c in enumerate(cells)]) for k, side, cells in contents]
    return rows, spark.createDataFrame(rows, "chave string, lado int, id string, celulas array<bigint>")


def test_pairs_are_the_cheapest_that_are_left(spark):
    r = random.Random(9)
    contents = set()
    for key in range(60):
        for side in (0, 1):
            for _ in range(r.randrange(1, 6)):
                contents.add((f"k{key}", side, tuple(r.randrange(3) for _ in range(4))))
    both = {(k, c) for k, s, c in contents if s == 0} & {(k, c) for k, s, c in contents if s == 1}
    contents = sorted(x for x in contents if (x[0], x[2]) not in both)
    rows, df = frame(spark, contents)
    want = set()
    for key in {x[0] for x in rows}:
        pairs = sorted(
            (sum(x != y for x, y in zip(a[3], b[3])), hashlib.md5((a[2] + b[2]).encode()).hexdigest(), a[2], b[2])
            for a in rows if a[0] == key and a[1] == 0 for b in rows if b[0] == key and b[1] == 1)
        used = set()
        for n, _, a, b in pairs:
            if n < 4 and not {a, b} & used:
                used |= {a, b}
                want.add((a, b, n))
    assert {tuple(x) for x in pair_versions(df, 4).select("a", "b", "diferentes").collect()} == want


def test_a_key_of_very_many_versions(spark):
    n = 5000
    side = lambda s: spark.range(n).select(
        F.lit("x").alias("chave"), F.lit(s).alias("lado"), F.md5(F.concat(F.lit(f"{s}:"), F.col("id").cast("string"))).alias("id"),
        F.array(F.xxhash64(F.lit(s), "id"), F.lit(7).cast("long"), F.lit(8).cast("long"), F.col("id") % 50).alias("celulas"))
    out = pair_versions(side(0).unionByName(side(1)), 4).agg(
        F.count("*"), F.countDistinct("a"), F.countDistinct("b"), F.max("diferentes")).first()
    assert out[:3] == (n, n, n) and out[3] <= 2


def test_exact_cells_of_different_types(spark):
    a = spark.sql("SELECT 'k' AS k, CAST(1 AS DECIMAL(38,0)) AS x UNION ALL SELECT 'm', CAST(2 AS DECIMAL(38,0))")
    b = spark.sql("SELECT 'k' AS k, '1.4' AS x UNION ALL SELECT 'm', '2.000'")
    spec = reconcile.CompareSpec(["k"], ["x"], {"x": "exact"})
    r = reconcile.reconcile_columns(a, b, spec).first()
    assert (r.comparadas, r.identicas, r.divergentes) == (2, 1, 1)
    assert [tuple(x) for x in reconcile.reconcile_cells(a, b, spec).collect()] == [("k", "x", "1", "1.4")]


def test_pairs_are_kept_without_what_can_be_worked_out_again(spark, monkeypatch):
    kept = {}
    store = versions.stored
    monkeypatch.setattr(versions, "stored", lambda df, name: kept.setdefault(name, df.dtypes) and store(df, name))
    _, df = frame(spark, [("k", 0, (1, 2, 3)), ("k", 0, (1, 5, 3)), ("k", 1, (1, 2, 4)), ("k", 1, (7, 5, 3))])
    assert pair_versions(df, 3).count() == 2
    assert kept["candidatos"] == [("a", "binary"), ("b", "binary"), ("diferentes", "int")]


def cheapest(rows, columns):
    """The pairs of (key, side, id, cells), by a walk over all of them."""
    want = set()
    for key in {x[0] for x in rows}:
        pairs = sorted(
            (sum(x != y for x, y in zip(a[3], b[3])), hashlib.md5((a[2] + b[2]).encode()).hexdigest(), a[2], b[2])
            for a in rows if a[0] == key and a[1] == 0 for b in rows if b[0] == key and b[1] == 1)
        used = set()
        for n, _, a, b in pairs:
            if n < columns and not {a, b} & used:
                used |= {a, b}
                want.add((a, b, n))
    return want


@pytest.mark.parametrize("sliced", [False, True])
def test_large_blocks_give_all_their_pairs(spark, monkeypatch, sliced):
    """100 contents against 90 that share a cell, and a smaller key; sliced: few pairs at once, blocks in several parts."""
    if sliced:
        monkeypatch.setattr(versions, "SLICE", 16)
        monkeypatch.setattr(versions, "PER_CONTENT", 2)
        monkeypatch.setattr(versions, "FEW_PAIRS", 1)
    r = random.Random(4)
    contents = {("large", s, (7, r.randrange(30), 1000 * s + r.randrange(300), r.randrange(40))) for s, n in ((0, 100), (1, 90)) for _ in range(n)}
    contents |= {("small", s, (r.randrange(3), r.randrange(3), s, r.randrange(3))) for s in (0, 1) for _ in range(12)}
    rows, df = frame(spark, sorted(contents))
    assert {tuple(x) for x in pair_versions(df, 4).select("a", "b", "diferentes").collect()} == cheapest(rows, 4)


def test_pairs_in_place_are_the_cheapest(spark):
    r = random.Random(5)
    contents = {(f"k{k}", s, (r.randrange(3), s if k % 2 else 0, r.randrange(4))) for k in range(30) for s in (0, 1) for _ in range(r.randrange(7))}
    rows, df = frame(spark, sorted(contents))
    keys = df.groupBy("chave").agg(F.collect_list(F.struct("lado", "id", "celulas")).alias("c")).select("c", versions.pairs_in_place(F.col("c"), F.lit(3)).alias("p"))
    got = {(x.c[p.a].id, x.c[p.b].id, p.diferentes) for x in keys.collect() for p in x.p}
    assert got == cheapest(rows, 3)


def test_versions_are_compared_alike_however_keys_meet(spark, monkeypatch):
    """Pairs found where a key's rows meet, by blocks, and in keys of large buckets; with repeated rows and null keys."""
    r = random.Random(6)
    side = lambda s: [
        (None if k == 0 else f"00{k}", f"{r.randrange(4)}{'.0' if s else ''}", r.choice(["x", "y", " x ", None]), r.choice([1.0, 1.001, 2.5, None]), s if k % 3 else 0)
        for k in range(12) for _ in range(1 if k == 5 else r.randrange(6)) for _ in range(1 + r.randrange(2))]
    a, b = (spark.createDataFrame(side(s), "k string, e string, t string, d double, u int") for s in (0, 1))
    spec = reconcile.CompareSpec(["k"], ["e", "t", "d", "u"], {"e": "exact"}, versions=True)
    found = lambda: [sorted(map(repr, f(a, b, spec).collect())) for f in (reconcile.reconcile_versions, reconcile.reconcile_columns)]
    want = found()
    assert all(want)
    monkeypatch.setattr(reconcile, "KEY_PAIRS", 1)
    monkeypatch.setattr(reconcile, "BUCKET_ROWS", 8)
    assert found() == want
