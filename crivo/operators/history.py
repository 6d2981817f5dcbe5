"""State of a growing table per load day, kept and merged, so that a new day is the only one read.

A day and column leave their row counts, a HyperLogLog sketch of distinct values and,
for numbers, a KLL sketch of the values. Sketches of days merge into one of any period
with the error of one: ``LG_K`` = 12 stands for about 1.6 % of a distinct count (one
standard error), ``KLL_K`` = 400 for about 0.7 % of the rows in the rank of a percentile.
A sketch has a few KB at most, whatever the day holds.

The state is a table of its own. A day that comes again, as late rows do, is worked
out anew and put beside the old one under a higher version; the latest counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shape import as_text, batches, numeric_columns, quoted

LG_K, KLL_K = 12, 400
SCHEMA = "dia date, coluna string, linhas bigint, preenchidos bigint, distintos binary, valores binary, versao int"


def day_states(df: DataFrame, day: Column, columns: Sequence[str], numbers: Sequence[str] | None = None) -> DataFrame:
    """(dia, coluna, linhas, preenchidos, distintos, valores) of every day of ``df``; rows without a day are a day of their own, null.

    ``numbers`` are the columns that get percentiles, by default all numeric ones. NaN has no rank and is left out there.
    """
    numbers = [c for c in (numeric_columns(df) if numbers is None else numbers) if c in columns]
    out = None
    for part in batches(list(columns)):
        cells = [as_text(df, c).alias(f"t{i}") for i, c in enumerate(part)]
        cells += [F.nanvl(df[quoted(c)].cast("double"), F.lit(None).cast("double")).alias(f"v{i}") for i, c in enumerate(part) if c in numbers]
        rows = []
        for i, c in enumerate(part):
            kll = F.kll_sketch_agg_double(f"v{i}", F.lit(KLL_K)) if c in numbers else F.lit(None).cast("binary")
            rows.append(F.struct(F.lit(c).alias("coluna"), F.count("*").alias("linhas"), F.count(f"t{i}").alias("preenchidos"),
                                 F.hll_sketch_agg(f"t{i}", F.lit(LG_K)).alias("distintos"), kll.alias("valores")))
        days = df.select(day.cast("date").alias("dia"), *cells).groupBy("dia").agg(F.array(*rows).alias("linhas_"))
        found = days.select("dia", F.inline("linhas_"))
        out = found if out is None else out.unionByName(found)
    return out


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The stored state; one that was never written is empty."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def extend(path: str, df: DataFrame, day: Column, columns: Sequence[str], numbers: Sequence[str] | None = None,
           again: Sequence[str] = ()) -> DataFrame:
    """Adds to the state at ``path`` the days of ``df`` after its last one, and those named in ``again``; the state thereafter.

    The days are a comparison with a constant, which a table cut by day answers by leaving out all others.
    """
    state = read_state(df.sparkSession, path)
    last, version = state.agg(F.max("dia"), F.coalesce(F.max("versao"), F.lit(0))).first()
    wanted = F.lit(True)
    if last is not None:
        wanted = day.cast("date") > F.lit(last)
        if again:
            wanted = wanted | day.cast("date").isin(*[F.lit(d).cast("date") for d in again])
    new = day_states(df.where(wanted), day, columns, numbers)
    new.withColumn("versao", F.lit(version + 1).cast("int")).write.mode("append").parquet(path)
    return read_state(df.sparkSession, path)


def merged(state: DataFrame, first: str | None = None, last: str | None = None, ranks: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """(coluna, dias, linhas, preenchidos, distintos, percentis) of a period, from the state alone.

    ``percentis`` are the values at ``ranks``, null for columns that are no numbers or have no value.
    """
    if first is not None:
        state = state.where(F.col("dia") >= F.lit(first).cast("date"))
    if last is not None:
        state = state.where(F.col("dia") <= F.lit(last).cast("date"))
    fields = [f.name for f in state.schema.fields if f.name not in ("dia", "coluna", "versao")]
    latest = state.groupBy("dia", "coluna").agg(F.max_by(F.struct(*fields), "versao").alias("s")).select("dia", "coluna", "s.*")
    total = latest.groupBy("coluna").agg(
        F.count("*").alias("dias"), F.sum("linhas").alias("linhas"), F.sum("preenchidos").alias("preenchidos"),
        F.hll_sketch_estimate(F.hll_union_agg("distintos")).alias("distintos"), F.kll_merge_agg_double("valores").alias("valores"))
    filled = F.col("valores").isNotNull() & (F.coalesce(F.kll_sketch_get_n_double("valores"), F.lit(0)) > 0)
    cut = F.when(filled, F.array(*[F.kll_sketch_get_quantile_double("valores", F.lit(float(r))) for r in ranks]))
    return total.select("coluna", "dias", "linhas", "preenchidos", "distintos", cut.cast(T.ArrayType(T.DoubleType())).alias("percentis")).orderBy("coluna")
