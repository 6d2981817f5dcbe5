"""Counterparts among several versions of a key.

A key may hold several contents on each side that the other side doesn't have.
They are paired at the least number of differing cells: of all pairs of a key that
share a cell, the one with the fewest differences comes first, ties by a digest of
both contents, then the next among the contents that are left, and so on.

Where the contents of a key lie together, ``pairs_in_place`` walks its pairs in that
order. ``pair_versions`` does the same for keys of any size without gathering one: it
goes by the number of differing cells. Contents that differ in at most n cells share
at least one of n + 1 groups of columns, so that all their pairs are found in blocks,
contents of a key that agree in a group. Blocks meet slice by slice. Where they have
many pairs, those whose digests come first are settled first, with which most of the
contents leave; none is left out, and only a few pairs per content are ever kept.
Among these a pair is taken as soon as each of the two is the other's best, so many
are taken at once, and a few rounds are enough.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

#: Contents of a block's side that meet those of the other in one place.
SLICE = 1024

#: Pairs per content that are looked for at once, where blocks have more; those that are kept without counting them so.
PER_CONTENT, FEW_PAIRS = 8, 1 << 20

#: By how much the share of digests grows at least. What is left then has few pairs in the next share, as it had none in the last.
GROWTH = 16


def pairs_in_place(contents: Column, columns: Column) -> Column:
    """(a, b, diferentes) of the pairs of one key, whose contents are an array of (lado, id, celulas); by their places in it.

    Only pairs of less than ``columns`` differing cells count.
    """
    placed = F.transform(contents, lambda c, i: F.struct(c["lado"].alias("lado"), c["id"].alias("id"), c["celulas"].alias("celulas"), i.alias("lugar")))
    side = lambda n: F.filter(placed, lambda c: c["lado"] == n)
    pair = lambda x, y: F.struct(
        _differing(x["celulas"], y["celulas"]).alias("diferentes"), F.md5(F.concat(x["id"], y["id"])).alias("ordem"), x["lugar"].alias("a"), y["lugar"].alias("b"))
    # the contents of one side are listed once, not for each of the other
    pairs = F.flatten(F.flatten(F.transform(F.array(side(1)), lambda others: F.transform(side(0), lambda x: F.transform(others, lambda y: pair(x, y))))))
    used = lambda taken, p: F.exists(taken, lambda t: (t["a"] == p["a"]) | (t["b"] == p["b"]))
    return F.aggregate(
        F.sort_array(F.filter(pairs, lambda p: p["diferentes"] < columns)), F.array().cast("array<struct<a:int,b:int,diferentes:int>>"),
        lambda taken, p: F.when(used(taken, p), taken).otherwise(F.concat(taken, F.array(F.struct(p["a"].alias("a"), p["b"].alias("b"), p["diferentes"].alias("diferentes"))))))


def _differing(x: Column, y: Column) -> Column:
    return F.size(F.filter(F.zip_with(x, y, lambda c, d: c != d), lambda d: d))


def pair_versions(contents: DataFrame, columns: int) -> DataFrame:
    """(a, b, diferentes): the pairs of ``contents`` (chave, lado, id, celulas), by id, with the number of differing cells.

    ``lado`` is 0 or 1, ``id``, an md5 in lower-case hex, tells a content of a key and side from all others, ``celulas``
    holds a hash of each cell. Within, ids are bytes, and what can be worked out again from a pair isn't kept beside it.
    """
    left, found = stored(contents.select("chave", "lado", F.unhex("id").alias("id"), "celulas"), "sobras"), []
    for differing in range(columns):
        share = 0.0
        while share < 1:
            blocks = _blocks(left, columns, differing)
            sizes = stored(_sizes(blocks), "blocos")
            size = sizes.agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("pares"), F.sum(F.col("na") + F.col("nb")).alias("conteudos")).first()
            if not size.pares:
                break
            share = min(1.0, max(share * GROWTH, max(PER_CONTENT * size.conteudos, FEW_PAIRS) / size.pares))
            taken = _settled(stored(_candidates(blocks, sizes, columns, differing, share), "candidatos"))
            if taken:
                found += taken
                gone = reduce(DataFrame.unionByName, taken).select(F.explode(F.array("a", "b")).alias("id"))
                left = stored(left.join(gone, "id", "left_anti"), "sobras")
    if not found:
        found = [left.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0).alias("diferentes")).where("false")]
    return reduce(DataFrame.unionByName, found).select(_text("a").alias("a"), _text("b").alias("b"), F.col("diferentes").cast("long"))


def _text(name: str) -> Column:
    """An id as it was given."""
    return F.lower(F.hex(name))


def _blocks(left: DataFrame, columns: int, differing: int) -> DataFrame:
    """Contents by groups of columns, of which any two that differ in at most ``differing`` cells share one."""
    groups = [F.xxhash64(F.lit(g), *[F.get("celulas", F.lit(i)) for i in range(g, columns, differing + 1)]) for g in range(differing + 1)]
    return left.select("chave", "lado", "id", "celulas", F.explode(F.array(*groups)).alias("bloco"))


def _sizes(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("chave", "bloco").agg(F.sum(1 - F.col("lado")).alias("na"), F.sum("lado").alias("nb")).where("na > 0 AND nb > 0")


def _candidates(blocks: DataFrame, sizes: DataFrame, columns: int, differing: int, share: float) -> DataFrame:
    """(a, b, diferentes): pairs of blocks that differ in so many cells, and whose digests are in the first ``share`` of all."""
    of = {n: F.ceil(F.col(n) / SLICE).cast("int") for n in ("na", "nb")}
    own = {n: F.pmod(F.xxhash64(_text("id")), of[n]).cast("int") for n in of}
    every = {n: F.explode(F.sequence(F.lit(0), of[n] - 1)) for n in of}
    sized, on = blocks.join(sizes, ["chave", "bloco"]), ["chave", "bloco", "fatia_a", "fatia_b"]
    a = sized.where("lado = 0").select("chave", "bloco", own["na"].alias("fatia_a"), every["nb"].alias("fatia_b"), F.col("id").alias("a"), F.col("celulas").alias("ca"))
    b = sized.where("lado = 1").select("chave", "bloco", every["na"].alias("fatia_a"), own["nb"].alias("fatia_b"), F.col("id").alias("b"), F.col("celulas").alias("cb"))
    # one after the other: an array of them would be interpreted
    pairs = a.join(b, on).where(reduce(add, [(F.get("ca", F.lit(i)) != F.get("cb", F.lit(i))).cast("int") for i in range(columns)]) == differing)
    if share < 1:
        pairs = pairs.where(_order() < F.lit(f"{int(share * 16 ** 13):013x}"))
    return pairs.select("a", "b", F.lit(differing).alias("diferentes")).distinct()


def _settled(pairs: DataFrame) -> list[DataFrame]:
    """The pairs that are taken, best first, until none is left, in parts."""
    taken = []
    while True:
        best = stored(_mutual(pairs), "pares")
        if best.isEmpty():
            return taken
        taken.append(best)
        for side in ("a", "b"):
            pairs = pairs.join(best.select(side), side, "left_anti")
        pairs = stored(pairs, "candidatos")


def _order() -> Column:
    """What ties of pairs go by."""
    return F.md5(F.concat(_text("a"), _text("b")))


def _mutual(pairs: DataFrame) -> DataFrame:
    """Pairs that are the best of both their contents."""
    best = F.struct("diferentes", F.unhex(_order()).alias("ordem"), "a", "b")
    of_a = pairs.groupBy("a").agg(F.min(best).alias("p")).select("p.*")
    of_b = pairs.groupBy("b").agg(F.min(best).alias("p")).select("p.a", "p.b")
    return of_a.join(of_b, ["a", "b"]).select("a", "b", "diferentes")
