"""SimHash fingerprints of whole texts, and the pairs among them that differ in few bits, by a binary trie joined with itself.

The trie of all fingerprints is cut into parts that can be joined alone: two
fingerprints that differ in at most two bits agree in one of three blocks of
bits, so each is sent to the part of its value in every block. A part that is
too large is cut again by the bits left in the same way; after three cuts at
most 20 bits are left, so that no part, whatever the data, has over 2**20 members.
Inside a part, pairs of trie nodes are walked down together, level by level:
each pair carries the bits that differ so far and is dropped as soon as these
exceed the budget. A part returns links to the smallest member reached, not all
pairs, and equal fingerprints are one member from the start.

Null and empty texts, and texts of white space, have fingerprint zero and are
linked like any other. Repeated rows, also of one id, are rows of one
fingerprint. A null id keeps its row; ids name components, so a component
without any id has null.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components

BITS, SEED = 64, 42
#: The parts are cut three times by blocks of these widths: three blocks of all 64 bits, of the 43 left, of the 29 left.
CUTS = ((22, 21, 21), (15, 14, 14), (10, 10, 9))
#: Node pairs walked at once.
FRONT = 1 << 18
#: Rows in one group of parts, about; a part adds at most the size over which it is cut again.
GROUP_ROWS = 50_000


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash over the word shingles of a text: a bit is set if it is in over half the hashes."""
    w = (text or "").encode().lower().split()  # ASCII only, as bytes
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words))))
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text: str = "text", words: int = 3, name: str = "fingerprint") -> DataFrame:
    """``df`` without its text, with the fingerprint as a (signed) long under ``name``."""
    keep = [f for f in df.schema.fields if f.name != text]
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            got = np.array([fingerprint(x, words) for x in batch.column(at).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(batch.num_columns) if i != at] + [pa.array(got.view(np.int64))],
                names=[n for n in batch.schema.names if n != text] + [name],
            )

    return df.mapInArrow(run, T.StructType([*keep, T.StructField(name, T.LongType())]))


def trie_pairs(sorted_keys: np.ndarray, budget: int, tries: np.ndarray | None = None):
    """Yields arrays (i, j), i < j, of the keys (unsigned 64-bit) that differ in at most ``budget`` bits.

    ``tries`` holds the first place of each trie, ascending (default: all keys are one); inside a
    trie, keys are distinct and ascend, so that a node is a range whose halves meet where the next
    bit turns to one.
    """
    n = len(sorted_keys)
    if n < 2:
        return
    first = np.zeros(1, np.int32) if tries is None else tries.astype(np.int32)
    last = np.append(first[1:], n).astype(np.int32)
    first, last = first[last - first > 1], last[last - first > 1]
    ones = np.zeros((BITS, n + 1), np.int32)
    for d in range(BITS):
        np.cumsum((sorted_keys >> np.uint64(BITS - 1 - d)) & np.uint64(1), out=ones[d, 1:])
    # columns: start and end of one node, start and end of the other, level, differing bits so far
    none = np.zeros_like(first)
    stack = [np.stack([first, last, first, last, none, none], 1)] if len(first) else []
    while stack:
        front = stack.pop()
        if len(front) > FRONT:
            stack += np.array_split(front, -(-len(front) // FRONT))
            continue
        a0, a1, b0, b1, level, cost = front.T
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            i, j = a0[single], b0[single]
            near = (i != j) & (np.bitwise_count(sorted_keys[i] ^ sorted_keys[j]) <= budget)
            if near.any():
                yield i[near], j[near]
            front = front[~single]
            if not len(front):
                continue
            a0, a1, b0, b1, level, cost = front.T
        same = a0 == b0
        am = a1 - (ones[level, a1] - ones[level, a0])
        bm = b1 - (ones[level, b1] - ones[level, b0])
        deeper = level + 1
        zero = np.stack([a0, am, b0, bm, deeper, cost], 1)
        one = np.stack([am, a1, bm, b1, deeper, cost], 1)
        cross = np.stack([a0, am, bm, b1, deeper, cost + 1], 1)
        back = np.stack([am, a1, b0, bm, deeper, cost + 1], 1)[~same]  # of a node with itself the cross pairs are the same
        after = np.concatenate([zero, one, cross, back])
        alive = (after[:, 0] < after[:, 1]) & (after[:, 2] < after[:, 3]) & (after[:, 5] <= budget)
        alive &= ~((after[:, 0] == after[:, 2]) & (after[:, 1] - after[:, 0] == 1))  # a leaf with itself
        after = after[alive]
        if len(after):
            stack.append(after)


def roots(n: int, pairs) -> np.ndarray:
    """For members 0..n-1, the smallest member that the pairs connect each to."""
    root = np.arange(n)
    kept = []
    for i, j in pairs:
        kept.append((i, j))
        while True:
            ri, rj = root[i], root[j]
            if (ri == rj).all():
                break
            low = np.minimum(ri, rj)
            np.minimum.at(root, ri, low)
            np.minimum.at(root, rj, low)
            while (root[root] != root).any():
                root = root[root]
        kept.clear()
    return root


def links(prints: DataFrame, budget: int = 2, part_size: int = 20_000) -> DataFrame:
    """(a, b): links that connect the distinct longs of column ``p`` that differ in at most ``budget`` (at most 2) bits.

    ``part_size`` is the size over which a part is cut again; it changes the work, not the result.
    """
    if not 0 <= budget <= 2:
        raise ValueError("three blocks cover at most two differing bits")
    parts = prints.select("p", F.lit(0).alias("path"))
    done = None
    for cut in range(len(CUTS)):
        parts = _cut(parts, cut)
        if cut == len(CUTS) - 1:
            ready = parts
        else:
            parts = common.stored(parts, "parts")
            sizes = parts.groupBy("path", "value").agg(F.count("*").alias("n"))
            large = sizes.filter(F.col("n") > part_size)
            many = large.limit(1).count()
            ready = parts if not many else parts.join(large, ["path", "value"], "left_anti")
            parts = parts.join(large, ["path", "value"], "left_semi") if many else None
        done = ready if done is None else done.unionByName(ready)
        if parts is None:
            break

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        value, p = pdf["value"].to_numpy(), pdf["p"].to_numpy().view(np.uint64)
        order = np.lexsort((p, value))
        value, keys = value[order], p[order]
        starts = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        root = roots(len(keys), trie_pairs(keys, budget, starts))
        hung = root != np.arange(len(keys))
        signed = keys.view(np.int64)
        return pd.DataFrame({"a": signed[hung], "b": signed[root[hung]]})

    # small parts share a task's group, a part is never split between groups
    groups = max(16, -(-3 * prints.count() // GROUP_ROWS))
    slot = F.pmod(F.xxhash64("path", "value"), F.lit(groups)).alias("slot")
    return done.select("path", "value", "p", slot).groupBy("path", "slot").applyInPandas(join, "a long, b long")


def _masks(cut: int) -> dict[int, list[tuple[int, int]]]:
    """For each way of choosing blocks so far: the three ways on, each with the mask of all bits chosen."""
    ways = {0: 0}
    for c in range(cut + 1):
        after = {}
        for path, mask in ways.items():
            free = [i for i in range(BITS) if not mask >> i & 1]
            start, on = 0, []
            for k, width in enumerate(CUTS[c]):
                on.append((path * 4 + k + 1, mask | sum(1 << i for i in free[start:start + width])))
                start += width
            after[path] = on
        ways = {p: m for on in after.values() for p, m in on}
    return after


def _cut(parts: DataFrame, cut: int) -> DataFrame:
    """Each row three times, once for each block of its free bits; rows of one part agree in all bits chosen so far."""
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    ways = F.create_map(*[
        x for path, on in _masks(cut).items()
        for x in (F.lit(path), F.array(*[F.struct(F.lit(p).alias("path"), F.lit(signed(m)).cast("long").alias("mask")) for p, m in on]))
    ])
    spread = parts.select("p", F.explode(ways[F.col("path")]).alias("way"))
    return spread.select("p", "way.path", F.col("p").bitwiseAND(F.col("way.mask")).alias("value"))


def grouped(df: DataFrame, id: str, text: str, words: int, budget: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, k, p) and, for each fingerprint p, its group c; k is a hash of id and text."""
    i, t = common.col(id).cast("long"), common.col(text)
    rows = df.select(i.alias("id"), F.xxhash64(i, t).alias("k"), t.alias("text"))
    prints = common.stored(fingerprints(rows, "text", words, "p"), "prints")
    distinct = prints.select("p").distinct()
    joined = components(links(distinct, budget))
    return prints, distinct.join(joined.select(F.col("id").alias("p"), "component"), "p", "left").select(
        "p", F.coalesce("component", "p").alias("c"))


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3, budget: int = 2) -> DataFrame:
    """(id, fingerprint, component_id) for each row: component_id is the smallest id that links reach, its own included."""
    prints, groups = grouped(df, id, text, words, budget)
    named = groups.join(prints.groupBy("p").agg(F.min("id").alias("first")), "p")
    of = named.join(named.groupBy("c").agg(F.min("first").alias("component_id")), "c").select("p", "component_id")
    return prints.join(of, "p").select(
        F.col("id").alias(id), F.lower(F.lpad(F.hex("p"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3, budget: int = 2) -> DataFrame:
    """The rows of ``df`` with one document of each group: that of the smallest id, one without id only where none has any."""
    prints, groups = grouped(df, id, text, words, budget)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "k")
    best = prints.groupBy("p").agg(F.min(order).alias("best")).join(groups, "p").groupBy("c").agg(F.min("best").alias("best"))
    key, own = common.private(df, "key_", "own_")
    kept = best.select(F.col("best.k").alias(key), F.col("best.id").alias("kept_id"))
    keyed = df.withColumns({key: F.xxhash64(common.col(id).cast("long"), common.col(text)), own: common.col(id).cast("long")})
    same = (keyed[key] == kept[key]) & keyed[own].eqNullSafe(kept["kept_id"])
    return keyed.join(kept, same, "left_semi").dropDuplicates([key, own]).drop(key, own)
