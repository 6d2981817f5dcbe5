"""Value classes the missing-value, code and date dialects must tell apart."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from crivo.functions import dates as D
from crivo.functions import missing as M
from crivo.functions import normalize as N
from crivo.functions.hashing import fingerprint, row_hash
from crivo.functions.ratios import pct, ratio

BLANKS = [None, "", "  ", "null", "NaN", "None", "#", "-", "NA", "n/a"]
ZEROS = ["0", "000", "0,00", "0.0", " 00 "]


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_value_classes(spark):
    got = column(spark, [*BLANKS, *ZEROS, "10", "0a", "1.0"], lambda c: M.value_class(c, T.StringType()))
    assert got == [M.NULL] + [M.BLANK] * 9 + [M.ZERO] * 5 + [M.USEFUL] * 3


def test_six_token_dialect_keeps_na(spark):
    got = column(spark, BLANKS, lambda c: M.value_class(c, T.StringType(), M.BLANK_TOKENS_6))
    assert got == [M.NULL] + [M.BLANK] * 7 + [M.USEFUL] * 2


def test_numeric_and_other_types(spark):
    assert column(spark, [0.0, -0.0, 1.5, None], lambda c: M.value_class(c, T.DoubleType()), "double") == [2, 2, 3, 0]
    assert column(spark, [True, None], lambda c: M.value_class(c, T.BooleanType()), "boolean") == [3, 0]


def test_text_class_counts_null_and_blank_together(spark):
    assert column(spark, [None, " ", "n/a", "0.00", "00", "x"], M.text_class) == [0, 0, 3, 2, 3, 3]


def test_display_bucket(spark):
    assert column(spark, [None, " ", " a "], M.display_bucket) == ["(vazio)", "(vazio)", "a"]


def test_zero_stripping_dialects(spark):
    codes = ["000000000000425263", " 425263", "000", "0", "1012248445.0", "412A", "00A", None]
    assert column(spark, codes, N.strip_zeros) == ["425263", "425263", "", "", "1012248445.0", "412A", "A", None]
    keep = column(spark, codes, lambda c: N.strip_zeros(c, "keep_last"))
    assert keep == ["425263", "425263", "0", "0", "1012248445.0", "412A", "0A", None]
    listed = column(spark, codes, lambda c: N.strip_zeros(c, "list"))
    assert listed == ["425263", "425263", "0", "0", "1012248445", "412A", "A", "0"]


def test_numeric_code_never_fails(spark):
    assert column(spark, ["007", "412A", None], N.numeric_code) == [7, None, None]


def test_dates(spark):
    texts = ["20240223", "2024-02-23 00:00:00", "23/02/2024", "00000000", "0000-00-00", "20241399", "x", "", None]
    day = dt.date(2024, 2, 23)
    assert column(spark, texts, D.parse_date) == [day, day, day, None, None, None, None, None, None]
    key = "20240223"
    assert column(spark, texts, D.date_key) == [key, key, key, None, None, "20241399", "x", None, None]
    assert column(spark, texts, D.date_format_of) == ["AAAAMMDD", "ISO", "BR", "AAAAMMDD", "ISO", "AAAAMMDD", None, None, None]
    assert column(spark, texts, D.compact_date)[:1] == [day]
    assert column(spark, [day], lambda c: D.date_key(c, T.DateType()), "date") == [key]


def test_hash_modes_see_null_and_blank_differently(spark):
    df = spark.createDataFrame([("a", None), ("a", "")], "x string, y string")
    distinct = lambda mode: df.select(row_hash(["x", "y"], mode)).distinct().count()
    assert (distinct("json"), distinct("concat"), distinct("sha256")) == (2, 1, 2)


def test_fingerprint_tells_nulls_apart(spark):
    data = [("a", None, [None, 1]), (None, "a", [None, 1]), ("a", "", [None, 1]), ("a", None, [1, None]), ("a", None, [1]),
            ("a", None, [None, 1])]
    df = spark.createDataFrame(data, "x string, y string, z array<int>")
    for mode in ("pair", "json"):
        assert df.select(fingerprint(df, df.columns, mode).alias("f")).distinct().count() == 5


def test_mask_is_short_and_stable(spark):
    a, b = column(spark, ["Ana", "Ana"], N.mask)
    assert a == b and len(a) == 8 and "Ana" not in a


def test_ratios_round_half_up_and_survive_zero(spark):
    df = spark.createDataFrame([(1, 800), (1, 8), (1, 0), (2, 3)], "n bigint, d bigint")
    rows = df.select(pct(F.col("n"), F.col("d")), ratio(F.col("n"), F.col("d"))).collect()
    assert [tuple(r) for r in rows] == [(0.13, 0.0013), (12.5, 0.125), (None, None), (66.67, 0.6667)]
