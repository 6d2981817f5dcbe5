"""Mixing sources to target weights by systematic sampling, with DataFrame operations alone.

Sources, ordered by code point with null last, weigh 1, 2, 3 and so on in turn
and share all words. A source's target stops at ``most`` times its words; what
is left over is shared again by weight among the others until none is above.

Within a source every document is expected as often as target / words. Documents
stand in order of size, so that a prefix sum of expected copies, moved by one
random offset, crosses integers evenly at every size: a document is emitted once
for each integer crossed. The prefix sum is a rank times that number, and the
rank is put together from counts by size and by slices of a digest of the id,
taken before any shuffle; a source of any share is spread over its sizes and slices.

Null or empty texts have size 0 and stand first. A null source is a source of
its own, the last. Rows that repeat are separate documents; of rows with equal
id, source and size it is open which one is taken. A null id is ordered as an
empty text. With no rows, or no words, nothing is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Hexadecimal digits of the slices of one size; 4096 slices keep a size with billions of rows apart.
SLICE_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def targets(by_source: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``by_source`` (source, source_size) with ``target``; a row for each source, so the ordering of them is one small task."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = by_source.withColumn("weight", weight.cast("long")).withColumn("most", most * F.col("source_size"))
    # sources reach their limit in order of limit / weight: those before one in that order are full if it is full
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("left", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("most").over(before), F.lit(0)))
    s = s.withColumn("weights", F.sum("weight").over(onward))
    share = (F.col("left") * F.col("weight")).cast("double") / F.col("weights")
    s = s.withColumn("full", share >= F.col("most"))
    # the first that isn't full sets the words for a weight of one, for it and all after it
    first = F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("left"), F.col("weights")))).over(Window.partitionBy())
    s = s.withColumn("first", first)
    rest = (F.col("first.left") * F.col("weight")).cast("double") / F.col("first.weights")
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(rest)
    return s.select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: int) -> Column:
    """A fixed number from 0 to 1 for each source, in steps of 2**-20 that keep sums with ranks exact."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\0"))))
    return F.conv(F.substring(digest, 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))


def mix(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3),
        most: int = 3, seed: int = 1) -> tuple[DataFrame, dict[str, str]]:
    """All rows of ``df`` with private columns, and the names of these: size, source_size, target, copies."""
    size, src, order, cut, rank, base, source_size, target, copies = (
        common.private(df, "size_", "src_", "order_", "cut_", "rank_", "base_", "source_size_", "target_", "copies_"))
    rows = df.withColumns({
        size: word_count(common.col(text)), src: F.struct(F.col(f"`{source}`").isNull().alias("none"), F.coalesce(common.col(source).cast("string"), F.lit("")).alias("name")),
        order: F.md5(F.coalesce(common.col(id).cast("string"), F.lit(""))),
    }).withColumn(cut, F.substring(order, 1, SLICE_DIGITS))
    cells = common.stored(rows.groupBy(src, size, cut).agg(F.count("*").alias("n")), "cells")
    sizes = cells.groupBy(src, size).agg(F.sum("n").alias("n"))
    named = sizes.groupBy(src).agg(F.sum(F.col(size) * F.col("n")).alias("source_size")).select(
        F.when(~F.col(src)["none"], F.col(src)["name"]).alias("source"), "source_size")
    goals = targets(named, weights, most).select(
        F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias(src),
        F.col("source_size").alias(source_size), F.col("target").alias(target),
        offset(F.col("source"), seed).alias("offset"),
    )
    by_size = Window.partitionBy(src).orderBy(size).rowsBetween(Window.unboundedPreceding, -1)
    by_cut = Window.partitionBy(src, size).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(src, size, F.coalesce(F.sum("n").over(by_size), F.lit(0)).alias("smaller")).join(goals, src)
    starts = cells.select(src, size, cut, F.coalesce(F.sum("n").over(by_cut), F.lit(0)).alias("earlier")).join(before, [src, size]).select(
        src, size, cut, (F.col("smaller") + F.col("earlier")).alias(base), source_size, target, F.col("offset").alias("offset_"))
    ranked = rows.withColumn(rank, F.row_number().over(Window.partitionBy(src, size, cut).orderBy(order)))
    each = F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(F.lit(0.0))
    crossed = lambda r: F.floor(each * r + F.col("offset_"))
    at = F.col(base) + F.col(rank)
    out = ranked.join(starts, [src, size, cut]).withColumn(copies, F.least(crossed(at) - crossed(at - 1), F.lit(most)))
    names = {"size": size, "source_size": source_size, "target": target, "copies": copies}
    return out.select(*[common.col(c) for c in df.columns], *names.values()), names


def mixed_documents(df: DataFrame, **options) -> DataFrame:
    """The mix itself: every document of ``df`` as often as it is taken, with the columns of ``df``."""
    out, names = mix(df, **options)
    times, = common.private(out, "time_")
    return out.filter(F.col(names["copies"]) > 0).withColumn(
        times, F.explode(F.sequence(F.lit(1), F.col(names["copies"]).cast("int")))).select(*[common.col(c) for c in df.columns])
