"""Rows of equal value as one class, and packed blocks of them, for searches that go through shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Partitions for each part, so that few parts meet in one.
SPREAD = 4


def classes(rows: DataFrame, members: int, asks: int) -> DataFrame:
    """(value, class, ids, asks): a row for each value of ``rows`` (id, value), to be stored before it is used.

    ``ids`` are the ``members`` smallest, which are all that an answer can hold, an id as often as it has rows.
    ``class`` numbers the classes in the order of their smallest id, since one id may be the smallest of several;
    ``asks`` tells whether some id of the class is a query, one divisible by ``asks``. Ids of a value are cut
    before the shuffle, however many there are.
    """
    nth = F.row_number().over(Window.partitionBy("value").orderBy("id"))
    few = rows.withColumn("nth", nth).filter(F.col("nth") <= members)
    asking = rows.filter(F.col("id") % asks == 0).select("value").distinct().withColumn("asks", F.lit(True))
    held = few.groupBy("value").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    known = held.join(asking, "value", "left").select("value", "ids", F.coalesce("asks", F.lit(False)).alias("asks"))
    return known.orderBy(F.col("ids")[0], "value").select("value", F.monotonically_increasing_id().alias("class"), "ids", "asks")


def ranked(found: DataFrame, known: DataFrame, rows: DataFrame, k: int, asks: int, best) -> DataFrame:
    """(query_id, rank, vec_id, score): the answers of each query row, from what was found for its class.

    ``found`` holds (asking, class, score) of the nearest k + 1 classes of each shard at least, ``best`` orders by
    score, nearest first. The k + 1 nearest rows of a class are those of its queries; each leaves out one row of
    its id in its class, its own. Rows of one id and value can't be told apart, so it doesn't matter which.
    """
    near = F.row_number().over(Window.partitionBy("asking").orderBy(best, "class"))
    top = found.withColumn("near", near).filter(F.col("near") <= k + 1).drop("near")
    top = top.join(known.select("class", "ids"), "class").select("asking", "score", (F.col("class") == F.col("asking")).alias("home"), F.explode("ids").alias("vec_id"))
    nth = F.row_number().over(Window.partitionBy("asking").orderBy(best, "vec_id"))
    top = top.withColumn("nth", nth).filter(F.col("nth") <= k + 1)
    lists = top.groupBy("asking").agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score", "home"))).alias("answers"))
    queries = rows.filter(F.col("id") % asks == 0).join(known.filter("asks").select("value", F.col("class").alias("asking")), "value")
    own = queries.select(F.col("id").alias("query_id"), "asking").join(lists, "asking")
    # the place of the query's own row, 0 if k + 1 others come before it
    at = F.array_position(F.transform("answers", lambda a: a["home"] & (a["vec_id"] == F.col("query_id"))), True)
    own = own.withColumn("own", at).select(
        "query_id", F.slice(F.filter("answers", lambda a, i: i + 1 != F.col("own")), 1, k).alias("answers"))
    return own.select("query_id", F.posexplode("answers").alias("at", "a")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "a.vec_id", "a.score")


def pairs(index: DataFrame, queries: DataFrame, by: str | None = None) -> DataFrame:
    """Each packed shard of ``index`` (shard, …) with each packed block of ``queries`` (block, …), of the same ``by`` if given."""
    if by is None:
        spread = queries.withColumn("last", index.agg(F.max("shard")).scalar())
    else:
        spread = queries.join(index.groupBy(by).agg(F.max("shard").alias("last")), by)
    keys = [by] if by else []
    spread = spread.filter(F.col("last").isNotNull()).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("last")
    # a number of its own, which is not joined to fewer however small the rows are: the work is in the tasks
    return index.join(spread, [*keys, "shard"]).repartition(SPREAD * max(1, index.count()), *keys, "shard", "block")


def grouped(parts: DataFrame, rows: int, size: int, *keys: str):
    """``parts`` of about ``size`` of ``rows`` rows each, grouped by their keys for one task a part, nearly."""
    return parts.repartition(SPREAD * max(1, -(-rows // size)), *keys).groupBy(*keys)


def dealt(rows: DataFrame, size: int, name: str, by: str | None = None) -> DataFrame:
    """``rows`` (class, value, …) with a part number under ``name``, so that parts have ``size`` rows on average, apart by ``by`` if given."""
    parts = F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("int")
    if by is None:
        counted = rows.withColumn("parts", rows.agg(parts).scalar())
    else:
        counted = rows.join(rows.groupBy(by).agg(parts.alias("parts")), by)
    return counted.withColumn(name, F.pmod(F.xxhash64("value"), F.col("parts")).cast("int")).drop("parts")
