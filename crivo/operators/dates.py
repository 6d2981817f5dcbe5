"""Dates, times, freshness, coverage and series continuity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import labels as L
from ..functions import dates as D
from ..functions import missing as M
from ..functions.ratios import count_if, pct
from ._shape import Section, private_names, quoted, value_counts


def _date(df: DataFrame, c: str) -> Column:
    return D.parse_date(df[quoted(c)], df.schema[c].dataType)


def string_date_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Formats in use in text dates; more than one format in a column alerts."""
    return string_date_section(df, columns).report(df)


def string_date_section(df: DataFrame, columns: Sequence[str]) -> Section:
    # the format is worked out once per cell, then only counted
    formats = private_names(df, *[f"formato_{i}" for i in range(len(columns))])
    cells = [D.date_format_of(df[quoted(c)]).alias(f) for c, f in zip(columns, formats)]
    rows = []
    for i, c in enumerate(columns):
        t, f = F.trim(df[quoted(c)]), F.col(formats[i])
        dated = F.when(~t.isin("", "00000000"), df[quoted(c)])
        rows.append({
            "coluna": F.lit(c),
            "total": F.count("*"),
            "vazios": count_if(t.isNull() | (t == "")),
            "fmt_aaaammdd": count_if(f == D.COMPACT),
            "fmt_iso": count_if(f == D.ISO),
            "fmt_br": count_if(f == D.BR),
            "data_zero": count_if(t.isin(*D.ZERO_DATES)),
            "minimo": F.min(dated),
            "maximo": F.max(dated),
        })
    used = [F.when(F.col(x) > 0, 1).otherwise(0) for x in ("fmt_aaaammdd", "fmt_iso", "fmt_br")]
    unknown = F.col("total") - F.col("vazios") - F.col("fmt_aaaammdd") - F.col("fmt_iso") - F.col("fmt_br")
    verdict = F.when(used[0] + used[1] + used[2] > 1, L.DATE_MIXED).otherwise(L.DATE_SINGLE)
    return Section(rows, lambda out: out.select(
        "coluna", "vazios", "fmt_aaaammdd", "fmt_iso", "fmt_br", "data_zero",
        unknown.alias("nao_reconhecido"), "minimo", "maximo", verdict.alias("veredito"),
    ).orderBy("coluna"), cells)


def date_format_classes(df: DataFrame, column: str) -> DataFrame:
    """Rows per text format of one date column, with the literal extremes."""
    v = F.col("valor")
    kind = (
        F.when(M.no_value(v), L.DATE_CLASS_BLANK)
        .when(v == "00000000", "00000000")
        .when(v == D.OPEN_END, D.OPEN_END)
        .when(v.rlike(D.FMT_COMPACT), "AAAAMMDD")
        .when(v.rlike(D.FMT_ISO_ONLY), "AAAA-MM-DD")
        .otherwise(L.DATE_CLASS_OTHER)
    )
    # the formats are tested once per distinct literal
    freq = df.groupBy(df[quoted(column)].cast("string").alias("valor")).agg(F.count("*").alias("n"))
    return (
        freq.groupBy(kind.alias("formato"))
        .agg(F.sum("n").alias("linhas"), F.min(v).alias("exemplo_min"), F.max(v).alias("exemplo_max"))
        .orderBy(F.desc("linhas"), "formato")
    )


def valid_date_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Real date range of text dates, empty or zero ones and impossible ones."""
    return valid_range_section(df, columns).report(df)


def valid_range_section(df: DataFrame, columns: Sequence[str]) -> Section:
    names = private_names(df, *[f"data_{i}" for i in range(len(columns))])
    cells = [D.compact_date(df[quoted(c)]).alias(n) for c, n in zip(columns, names)]
    rows = []
    for i, c in enumerate(columns):
        t, d = F.trim(df[quoted(c)].cast("string")), F.col(names[i])
        empty = t.isNull() | t.isin("", "00000000")
        rows.append({
            "coluna": F.lit(c),
            "minima_valida": F.min(d),
            "maxima_valida": F.max(d),
            "vazia_ou_zerada": count_if(empty),
            "invalida": count_if(~empty & d.isNull()),
        })
    return Section(rows, lambda out: out.orderBy("coluna"), cells)


def _day_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Frequencies of days, as day numbers: their extremes stay in a hash aggregate."""
    return value_counts(df, {c: F.unix_date(df[quoted(c)].cast("date")) for c in columns})


def native_date_profile(df: DataFrame, columns: Sequence[str], as_of: str | None = None) -> DataFrame:
    """Nulls, range, distinct and future values of native dates.

    The reference day is a parameter so that a run can be repeated.
    """
    return native_date_profile_of(_day_counts(df, columns), as_of)


def native_date_profile_of(days: DataFrame, as_of: str | None = None) -> DataFrame:
    """``native_date_profile`` from day-number frequencies already at hand."""
    today = F.unix_date(F.current_date() if as_of is None else F.lit(as_of).cast("date"))
    v, n = F.col("valor"), F.col("linhas")
    return (
        days.groupBy("coluna")
        .agg(
            F.sum(F.when(v.isNull(), n).otherwise(0)).alias("nulos"),
            F.date_from_unix_date(F.min(v)).cast("string").alias("minimo"),
            F.date_from_unix_date(F.max(v)).cast("string").alias("maximo"),
            F.count(v).alias("distintas"),
            F.sum(F.when(v > today, n).otherwise(0)).alias("futuras"),
        )
        .orderBy("coluna")
    )


def timestamp_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls, range and distinct instants of timestamp columns."""
    return timestamp_profile_of(value_counts(df, {c: F.unix_micros(df[quoted(c)].cast("timestamp")) for c in columns}))


def timestamp_profile_of(micros: DataFrame) -> DataFrame:
    """``timestamp_profile`` from frequencies of microseconds already at hand."""
    v, n = F.col("valor"), F.col("linhas")
    shown = lambda x: F.date_format(F.timestamp_micros(x), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return (
        micros.groupBy("coluna")
        .agg(
            F.sum(F.when(v.isNull(), n).otherwise(0)).alias("nulos"),
            shown(F.min(v)).alias("minimo"),
            shown(F.max(v)).alias("maximo"),
            F.count(v).alias("distintos"),
        )
        .orderBy("coluna")
    )


def time_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Time-of-day texts: blank, HHMMSS, HH:MM, distinct."""
    return time_profile_of(value_counts(df, columns))


def time_profile_of(freq: DataFrame) -> DataFrame:
    """``time_profile`` from value frequencies already at hand."""
    v, n = F.col("valor"), F.col("linhas")
    t = F.trim(v)
    return (
        freq.groupBy("coluna")
        .agg(
            F.sum(F.when(M.no_value(v), n).otherwise(0)).alias("vazios"),
            F.sum(F.when(t.rlike(D.TIME_COMPACT), n).otherwise(0)).alias("fmt_hhmmss"),
            F.sum(F.when(t.rlike(D.TIME_COLON), n).otherwise(0)).alias("fmt_hh_mm"),
            F.count(v).alias("distintos"),
        )
        .orderBy("coluna")
    )


def freshness(df: DataFrame, columns: Sequence[str], as_of: str | None = None) -> DataFrame:
    """Latest load, days since and distinct load days of each audit column."""
    return freshness_of(_day_counts(df, columns), as_of)


def freshness_of(days: DataFrame, as_of: str | None = None) -> DataFrame:
    """``freshness`` from day-number frequencies already at hand."""
    now = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    v = F.col("valor")
    last = F.date_from_unix_date(F.max(v))
    return (
        days.groupBy("coluna")
        .agg(
            F.sum("linhas").alias("linhas"),
            F.date_from_unix_date(F.min(v)).alias("primeira_carga"),
            last.alias("ultima_carga"),
            F.datediff(now, last).alias("dias_desde_carga"),
            F.count(v).alias("dias_distintos_carga"),
        )
        .orderBy("coluna")
    )


def freshness_by_day(
    df: DataFrame, column: str, metrics: Mapping[str, Column] | None = None, k: int | None = None
) -> DataFrame:
    """Rows per load day, latest first."""
    aggs = [a.alias(n) for n, a in (metrics or {}).items()]
    out = (
        df.groupBy(df[quoted(column)].cast("date").alias("data_carga"))
        .agg(F.count("*").alias("linhas"), *aggs)
        .orderBy(F.desc("data_carga"))
    )
    return out if k is None else out.limit(k)


def freshness_as_of(df: DataFrame, as_of: str | None = None) -> DataFrame:
    """Row count stamped with the moment of the query, for tables with no audit column."""
    now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    return df.agg(F.count("*").alias("linhas")).select(now.alias("instante"), "linhas")


def snapshot_or_history(df: DataFrame, column: str) -> DataFrame:
    """One load date means the table is replaced; several mean it accumulates."""
    return snapshot_of(df.groupBy(df[quoted(column)].cast("date").alias("d")).agg(F.count("*").alias("n")), column)


def snapshot_of(per: DataFrame, column: str) -> DataFrame:
    """``snapshot_or_history`` from the load days ``d`` already at hand."""
    out = per.agg(
        F.min("d").alias("primeira_carga"), F.max("d").alias("ultima_carga"),
        F.count("d").alias("cargas_distintas"),
    )
    verdict = F.when(F.col("cargas_distintas") == 1, L.SNAPSHOT).otherwise(L.HISTORY.format(column))
    return out.withColumn("veredito", verdict)


def temporal_coverage(df: DataFrame, column: str) -> DataFrame:
    """Days with data against days of the period."""
    days = df.select(_date(df, column).alias("dt")).groupBy("dt").agg(F.count("*").alias("n"))
    span = F.datediff(F.max("dt"), F.min("dt")) + 1
    return days.agg(
        F.min("dt").alias("primeira_data"),
        F.max("dt").alias("ultima_data"),
        F.count("dt").alias("dias_com_dado"),
        span.alias("dias_do_periodo"),
        (span - F.count("dt")).alias("dias_sem_dado"),
    )


def date_order(df: DataFrame, rules: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Rules of the form "first date is not after the second", all in one pass."""
    return date_order_section(df, rules).report(df)


def date_order_section(df: DataFrame, rules: Mapping[str, tuple[str, str]]) -> Section:
    cols = list(dict.fromkeys(c for pair in rules.values() for c in pair))
    name = dict(zip(cols, private_names(df, *[f"ordem_{i}" for i in range(len(cols))])))
    rows = []
    for rule, (a, b) in rules.items():
        x, y = F.col(name[a]), F.col(name[b])
        rows.append({
            "regra": F.lit(rule),
            "avaliadas": count_if(x.isNotNull() & y.isNotNull()),
            "violacoes": count_if(x > y),
        })
    cells = [_date(df, c).alias(name[c]) for c in cols]
    return Section(rows, lambda out: out.orderBy(F.desc("violacoes"), "regra"), cells)


def day_lag(
    df: DataFrame, start: str, end: str, accuracy: int = 10000, places: int = 1
) -> DataFrame:
    """Days between two dates: missing ends, inversions, mean and percentiles."""
    d = df.select(_date(df, start).alias("a"), _date(df, end).alias("b")).withColumn("lag", F.datediff("b", "a"))
    ok = F.when(F.col("lag") >= 0, F.col("lag"))
    q = F.percentile_approx(ok, [0.5, 0.95], accuracy)
    return d.agg(
        F.count("*").alias("linhas"),
        count_if(F.col("a").isNull()).alias("sem_inicio"),
        count_if(F.col("b").isNull()).alias("sem_fim"),
        count_if(F.col("lag") < 0).alias("fim_antes_do_inicio"),
        F.round(F.avg("lag"), places).alias("media_dias"),
        F.min("lag").alias("menor_dias"),
        F.max("lag").alias("maior_dias"),
        q[0].alias("mediana_dias"),
        q[1].alias("p95_dias"),
    )


def sentinel_share(df: DataFrame, column: str, start: str | None = None, sentinel: str = D.OPEN_END) -> DataFrame:
    """Share of the open-end date, and the real range without it."""
    cols = {"d": _date(df, column)}
    if start is not None:
        cols["s"] = _date(df, start)
    x = df.select(*[c.alias(n) for n, c in cols.items()])
    d, mark = F.col("d"), F.lit(sentinel).cast("date")
    real = F.when(d != mark, d)
    t, open_end = F.count("*"), count_if(d == mark)
    aggs = [
        t.alias("linhas"), open_end.alias("sem_prazo_definido"), pct(open_end, t, 4).alias("pct_sem_prazo"),
        count_if(d.isNull()).alias("data_nula"), F.min(real).alias("mais_antiga"), F.max(real).alias("mais_recente"),
    ]
    if start is not None:
        aggs.append(count_if(d < F.col("s")).alias("antes_do_inicio"))
    return x.agg(*aggs)


def period_windows(
    df: DataFrame, period: str | Column, entity: str, date: str, k: int | None = None
) -> DataFrame:
    """Rows, entities and date range per period, latest period first."""
    p = df[period] if isinstance(period, str) else period
    out = (
        df.groupBy(p.alias("periodo"))
        .agg(
            F.count("*").alias("linhas"), F.countDistinct(entity).alias("entidades"),
            F.min(date).alias("data_min"), F.max(date).alias("data_max"),
        )
        .orderBy(F.desc("periodo"))
    )
    return out if k is None else out.limit(k)


def series_continuity(
    df: DataFrame,
    keys: Sequence[str],
    date: str,
    start: str,
    end: str,
    tolerance: float = 0.001,
    order: Sequence[str] = (),
    bucket: str | None = None,
) -> DataFrame:
    """Does each row start where the previous row of its series ended?

    Rows are compared inside time buckets of a series, so one very long series
    is walked by many tasks. The seam between two buckets needs only the last
    row of one and the first row of the next; those edge rows, one per bucket,
    are then compared along the series. ``order`` breaks ties between rows of
    the same instant; ``bucket`` is any unit of ``date_trunc``. Rows without a
    readable date have no place in a series; they are counted, not compared.
    """
    dtype = df.schema[date].dataType
    stamp = isinstance(dtype, (T.TimestampType, T.TimestampNTZType))
    when = df[date] if stamp else _date(df, date)
    unit = bucket or ("hour" if stamp else "month")
    ties = [f"o{i}" for i in range(len(order))]
    rows = df.select(
        *[df[quoted(k)].alias(f"k{i}") for i, k in enumerate(keys)],
        *[df[o].alias(a) for o, a in zip(order, ties)],
        when.alias("em"), when.cast("date").alias("dt"),
        F.date_trunc(unit, when).alias("faixa"),
        df[start].alias("ini"), df[end].alias("fim"),
    )
    ks = [f"k{i}" for i in range(len(keys))]
    # undated rows belong to no series: they stay in groups of their own task, and nothing precedes them
    dated = F.col("em").isNotNull()
    rows = rows.withColumns({
        **{k: F.when(dated, F.col(k)) for k in ks}, "parte": F.when(~dated, F.spark_partition_id()), "fim": F.when(dated, F.col("fim")),
    })
    pos = F.struct("em", *ties)
    inner = Window.partitionBy(*ks, "faixa", "parte").orderBy("em", *ties)
    walked = rows.select(
        "*", F.lag("fim").over(inner).alias("fim_ant"), F.lag("dt").over(inner).alias("dt_ant")
    )

    def measures(prev_end: Column, cur_start: Column, gap: Column) -> list[Column]:
        moved, diff = prev_end.isNotNull(), F.abs(cur_start - prev_end)
        return [
            count_if(moved).alias("transicoes"),
            count_if(moved & (diff <= tolerance)).alias("continuas"),
            count_if(moved & (diff > tolerance)).alias("quebradas"),
            count_if(gap > 1).alias("com_lacuna_de_dias"),
            F.max(gap).alias("maior_lacuna_dias"),
        ]

    edges = walked.groupBy(*ks, "faixa", "parte").agg(
        count_if(~dated).alias("sem_data"),
        *measures(F.col("fim_ant"), F.col("ini"), F.datediff("dt", "dt_ant")),
        F.min_by(F.struct("ini", "dt"), pos).alias("primeira"),
        F.max_by(F.struct("fim", "dt"), pos).alias("ultima"),
    )
    outer = Window.partitionBy(*ks).orderBy("faixa")
    seams = edges.withColumn("anterior", F.lag("ultima").over(outer))
    gap = F.datediff("primeira.dt", "anterior.dt")
    prev, cur = F.col("anterior.fim"), F.col("primeira.ini")
    moved, diff = prev.isNotNull(), F.abs(cur - prev)
    as_int = lambda p: F.when(p, 1).otherwise(0)
    both = seams.select(
        (F.col("transicoes") + as_int(moved)).alias("transicoes"),
        (F.col("continuas") + as_int(moved & (diff <= tolerance))).alias("continuas"),
        (F.col("quebradas") + as_int(moved & (diff > tolerance))).alias("quebradas"),
        (F.col("com_lacuna_de_dias") + as_int(gap > 1)).alias("com_lacuna_de_dias"),
        "sem_data", F.greatest("maior_lacuna_dias", gap).alias("maior_lacuna_dias"),
    )
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in both.columns[:-1]]
    return both.agg(*sums, F.max("maior_lacuna_dias").alias("maior_lacuna_dias"))
