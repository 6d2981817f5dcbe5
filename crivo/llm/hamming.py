"""Exact nearest binary codes by an index over segments of the code, with radii that grow until the answer is proved.

Codes of 64 bits are cut into SEGMENTS segments, each with a table from its
value to the codes that have it. A query looks up all values of a segment within
radius 0, then of the next one, and so on, then within radius 1: once a code
differs in at most ``SEGMENTS * radius + segment`` bits, some segment searched so
far has led to it. As soon as that bound reaches the distance of the k-th nearest
code verified, no code unseen can be nearer or as near, and the query is done.

Equal codes are one class. Classes are dealt into shards, each packed with its
tables into one row; each query is answered exactly in every shard, and the
answers are put together. Null codes and ids take no part. Ties go to the smaller
id; with fewer candidates than asked for, all of them are answers.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .classes import classes, dealt, grouped, pairs, ranked

SEGMENTS, BITS = 4, 16
SHARD_ROWS, BLOCK_ROWS = 32_768, 2048
#: Values looked up at once.
PROBES = 1 << 21


def sign_code(vector: Column) -> Column:
    """Bit i is one if component i, of 64, is positive; null for vectors of another dimension or with nulls."""
    bits = F.transform(vector, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).when(x.isNotNull(), F.lit(0).cast("long")))
    code = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return F.when(F.size(vector) == SEGMENTS * BITS, code)


class SegmentIndex:
    """The tables of one shard of codes (distinct, unsigned)."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.orders, self.starts = [], []
        for s in range(SEGMENTS):
            value = self.segment(codes, s)
            self.orders.append(np.argsort(value, kind="stable").astype(np.int32))
            self.starts.append(np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << BITS))]).astype(np.int32))

    @staticmethod
    def segment(codes: np.ndarray, s: int) -> np.ndarray:
        return ((codes >> np.uint64(s * BITS)) & np.uint64((1 << BITS) - 1)).astype(np.int64)

    def lookup(self, queries: np.ndarray, s: int, radius: int):
        """Yields (query, code) places of codes whose segment s differs from the query's in exactly ``radius`` bits."""
        masks = np.array([sum(1 << b for b in c) for c in combinations(range(BITS), radius)], np.int64)
        start, order = self.starts[s], self.orders[s]
        step = max(1, PROBES // len(masks))
        for at in range(0, len(queries), step):
            value = self.segment(queries[at:at + step], s)[:, None] ^ masks
            q, m = np.nonzero(start[value + 1] > start[value])
            first, count = start[value[q, m]], (start[value + 1] - start[value])[q, m]
            which = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            yield np.repeat(q, count) + at, order[which]

    def nearest(self, queries: np.ndarray, k: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, code, distance): the k nearest codes of each query, ties to the smaller id."""
        k = min(k, len(self.codes))
        q = c = np.zeros(0, np.int64)
        d = np.zeros(0, np.int64)
        answers, open_ = [], np.arange(len(queries))
        for radius in range(BITS + 1):
            for s in range(SEGMENTS):
                if not len(open_):
                    break
                for lq, lc in self.lookup(queries[open_], s, radius):
                    q, c = np.append(q, open_[lq]), np.append(c, lc)
                    d = np.append(d, np.bitwise_count(queries[open_[lq]] ^ self.codes[lc]).astype(np.int64))
                # the k best of each query, each code once
                by = np.lexsort((ids[c], d, q))
                q, c, d = q[by], c[by], d[by]
                new = np.ones(len(q), bool)
                new[1:] = (q[1:] != q[:-1]) | (c[1:] != c[:-1])
                q, c, d = q[new], c[new], d[new]
                first = np.searchsorted(q, q)
                nth = np.arange(len(q)) - first
                q, c, d, nth = (x[nth < k] for x in (q, c, d, nth))
                last = np.full(len(queries), SEGMENTS * BITS + 1)
                last[q[nth == k - 1]] = d[nth == k - 1]
                proved = last[open_] <= SEGMENTS * radius + s
                if radius == BITS and s == SEGMENTS - 1:
                    proved[:] = True
                if proved.any():
                    ready = np.isin(q, open_[proved])
                    answers.append((q[ready], c[ready], d[ready]))
                    q, c, d = q[~ready], c[~ready], d[~ready]
                    open_ = open_[~proved]
        return tuple(np.concatenate(x) for x in zip(*answers)) if answers else (q, c, d)


def index(known: DataFrame) -> DataFrame:
    """A row for each shard: (shard, ids, codes), packed; the tables follow from the codes in one pass."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "ids": [pdf["class"].to_numpy(np.int64).tobytes()],
                             "codes": [pdf["value"].to_numpy(np.int64).tobytes()]})

    shards = dealt(known.select("class", "value"), SHARD_ROWS, "shard")
    return grouped(shards, known.count(), SHARD_ROWS, "shard").applyInPandas(pack, "shard int, ids binary, codes binary")


def blocks(known: DataFrame) -> DataFrame:
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "asking": [pdf["class"].to_numpy(np.int64).tobytes()],
                             "wanted": [pdf["value"].to_numpy(np.int64).tobytes()]})

    queries = dealt(known.filter("asks").select("class", "value"), BLOCK_ROWS, "block")
    return queries.groupBy("block").applyInPandas(pack, "block int, asking binary, wanted binary")


def search(shards: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(asking, class, score): the k nearest classes of each shard; score is the distance."""
    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                ids, asking = np.frombuffer(row.ids, np.int64), np.frombuffer(row.asking, np.int64)
                q, c, d = SegmentIndex(np.frombuffer(row.codes, np.uint64)).nearest(np.frombuffer(row.wanted, np.uint64), k, ids)
                yield pd.DataFrame({"asking": asking[q], "class": ids[c], "score": d})

    return pairs(shards, queries).mapInPandas(run, "asking long, class long, score long")


def nearest_codes(df: DataFrame, code: Column, k: int = 10, id: str = "vec_id", asks: int = 100) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each row whose id is divisible by ``asks``, itself left out; score is the distance."""
    rows = df.select(common.col(id).cast("long").alias("id"), code.alias("value")).dropna()
    known = common.stored(classes(rows, k + 1, asks), "classes")
    found = search(common.stored(index(known), "index"), blocks(known), k + 1)
    return ranked(found, known, rows, k, asks, F.asc("score"))
