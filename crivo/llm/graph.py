"""Nearest neighbours by cosine, from directed graphs with robustly pruned edges, one graph for each shard.

Equal vectors are one class and stand in the graph once. A shard's graph grows
by batches: a beam search from the middle of the shard proposes neighbours for
each new vector; of these an edge to the nearest is kept and all others that lie
closer to it, relaxed by ``ALPHA``, than to the new vector go; so short edges and
a few far ones stay. Edges back are added, and pruned in the same way where a
vector has too many. Every query runs a beam search in every shard, which is
packed into one row; answers are compared over all shards by their cosine in
double precision.

Vectors that are null or empty, hold nulls or non-finite numbers, or have length
zero take no part, neither do null ids. Ids that repeat are rows of their own.
Vectors of other dimensions are never compared. Ties go to the smaller id; with
fewer candidates than asked for, all of them are answers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .classes import classes, dealt, grouped, pairs, ranked

#: Edges of a vector, width of the beam while building and while searching, how far pruning is relaxed.
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 32, 64, 128, 1.2
#: Vectors in a shard and queries in a block, on average; vectors expanded in one step of a beam.
SHARD_ROWS, BLOCK_ROWS, STEP = 8192, 2048, 4


def beam(unit: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, cosines) of the nearest ``width`` found for each of the queries, nearest first; -1 where there are fewer."""
    q, n = len(queries), len(unit)
    ids = np.full((q, width), -1, np.int32)
    near = np.full((q, width), -np.inf, np.float32)
    done = np.zeros((q, width), bool)
    seen = np.zeros((q, n), bool)
    ids[:, 0], near[:, 0] = start, queries @ unit[start]
    seen[:, start] = True
    rows = np.arange(q)
    while True:
        open_ = ~done & (ids >= 0)
        active = np.flatnonzero(open_.any(1))
        if not len(active):
            return ids, near
        # the nearest STEP that aren't expanded, of each query that has one
        order = np.argsort(~open_[active], axis=1, kind="stable")[:, :STEP]
        chosen = np.where(np.take_along_axis(open_[active], order, 1), np.take_along_axis(ids[active], order, 1), -1)
        r = rows[active][:, None]
        done[r, order] = True
        new = np.where(chosen[:, :, None] >= 0, edges[chosen], -1).reshape(len(active), -1)
        new.sort(axis=1)
        fresh = (new >= 0) & ~seen[r, new]
        fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
        seen[r, np.where(fresh, new, start)] = True
        score = np.full(new.shape, -np.inf, np.float32)
        at, col = np.nonzero(fresh)
        score[at, col] = np.einsum("ij,ij->i", unit[new[at, col]], queries[active[at]])
        all_near = np.concatenate([near[active], score], 1)
        best = np.argsort(-all_near, axis=1, kind="stable")[:, :width]
        all_ids = np.concatenate([ids[active], np.where(fresh, new, -1)], 1)
        all_done = np.concatenate([done[active], np.zeros(new.shape, bool)], 1)
        near[active] = np.take_along_axis(all_near, best, 1)
        ids[active] = np.take_along_axis(all_ids, best, 1)
        done[active] = np.take_along_axis(all_done, best, 1)


def prune(unit: np.ndarray, points: np.ndarray, offered: np.ndarray, degree: int) -> np.ndarray:
    """At most ``degree`` of the offered neighbours (-1: none) of each point, nearest first, such that none is much nearer to a kept one."""
    distance = lambda cosines: np.sqrt(np.maximum(0, 2 - 2 * cosines))
    valid = (offered >= 0) & (offered != points[:, None])
    vectors = unit[offered]
    far = np.where(valid, distance(np.einsum("icd,id->ic", vectors, unit[points])), np.inf)
    order = np.argsort(far, axis=1, kind="stable")
    offered, far = np.take_along_axis(offered, order, 1), np.take_along_axis(far, order, 1)
    vectors = np.take_along_axis(vectors, order[:, :, None], 1)
    alive = np.isfinite(far)
    alive[:, 1:] &= offered[:, 1:] != offered[:, :-1]
    kept = np.full((len(points), degree), -1, np.int32)
    rows = np.arange(len(points))
    for j in range(degree):
        first = alive.argmax(1)
        has = alive[rows, first]
        if not has.any():
            break
        kept[has, j] = offered[rows, first][has]
        between = distance(np.einsum("icd,id->ic", vectors, vectors[rows, first]))
        alive &= ~(has[:, None] & (ALPHA * between <= far))
        alive[rows, first] = False
    return kept


def build(unit: np.ndarray, degree: int = DEGREE, width: int = BUILD_BEAM, seed: int = 1) -> tuple[np.ndarray, int]:
    """(edges, start) of the graph over unit vectors; edges has a row of ids for each, -1 where there are fewer."""
    n = len(unit)
    middle = unit.mean(0)
    start = int(np.argmax(unit @ middle))
    edges = np.full((n, degree), -1, np.int32)
    order = np.random.default_rng(seed).permutation(n).astype(np.int32)
    order = np.concatenate([[start], order[order != start]]).astype(np.int32)
    for again in range(2):  # a second pass finds the neighbours that were not there yet in the first
        at = 0 if again else 1
        while at < n:
            batch = order[at:at + min(512, max(1, n if again else at))]
            at += len(batch)
            found, _ = beam(unit, edges, start, unit[batch], width)
            offered = np.concatenate([found, edges[batch]], 1)
            edges[batch] = prune(unit, batch, offered, degree)
            # edges back, of all targets at once: those with room take them, the others are pruned
            source = np.repeat(batch, degree)
            target = edges[batch].ravel()
            source, target = source[target >= 0], target[target >= 0]
            by = np.lexsort((source, target))
            source, target = source[by], target[by]
            points, first, count = np.unique(target, return_index=True, return_counts=True)
            back = np.full((len(points), count.max() if len(count) else 0), -1, np.int32)
            back[np.repeat(np.arange(len(points)), count), np.arange(len(target)) - np.repeat(first, count)] = source
            for part in np.array_split(np.arange(len(points)), -(-len(points) // 1024) or 1):
                edges[points[part]] = prune(unit, points[part], np.concatenate([edges[points[part]], back[part]], 1), degree)
    return edges, start


def usable(df: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, value) of the rows that take part; value is the vector in double precision."""
    value = F.transform(common.col(vector), lambda x: x.cast("double"))
    rows = df.select(common.col(id).cast("long").alias("id"), value.alias("value"))
    fine = F.forall("value", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("value", lambda x: x != 0)
    return rows.filter(F.col("id").isNotNull() & F.col("value").isNotNull() & F.coalesce(fine, F.lit(False)))


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)  # so that no square over- or underflows
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def index(known: DataFrame) -> DataFrame:
    """A row for each shard: (kind, shard, ids, vectors, edges, start), packed."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("class")
        vectors = np.array(pdf["value"].tolist(), np.float64)
        edges, start = build(_unit(vectors))
        return pd.DataFrame({"kind": pdf["kind"].iloc[:1], "shard": pdf["shard"].iloc[:1], "ids": [pdf["class"].to_numpy(np.int64).tobytes()],
                             "vectors": [vectors.tobytes()], "edges": [edges.tobytes()], "start": [start]})

    shards = dealt(known.select(F.size("value").alias("kind"), "class", "value"), SHARD_ROWS, "shard", "kind")
    return grouped(shards, known.count(), SHARD_ROWS, "kind", "shard").applyInPandas(pack, "kind int, shard int, ids binary, vectors binary, edges binary, start int")


def blocks(known: DataFrame) -> DataFrame:
    """A row for each block of asking classes: (kind, block, asking, wanted), packed."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"kind": pdf["kind"].iloc[:1], "block": pdf["block"].iloc[:1], "asking": [pdf["class"].to_numpy(np.int64).tobytes()],
                             "wanted": [np.array(pdf["value"].tolist(), np.float64).tobytes()]})

    queries = dealt(known.filter("asks").select(F.size("value").alias("kind"), "class", "value"), BLOCK_ROWS, "block", "kind")
    return queries.groupBy("kind", "block").applyInPandas(pack, "kind int, block int, asking binary, wanted binary")


def search(shards: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(asking, class, score) of the k nearest classes that a beam finds in each shard, score in double precision."""
    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                ids, asking = np.frombuffer(row.ids, np.int64), np.frombuffer(row.asking, np.int64)
                vectors, wanted = (np.frombuffer(x, np.float64).reshape(-1, row.kind) for x in (row.vectors, row.wanted))
                edges, unit = np.frombuffer(row.edges, np.int32).reshape(len(ids), -1), _unit(vectors)
                for at in range(0, len(asking), 256):
                    part = wanted[at:at + 256]
                    found, _ = beam(unit, edges, row.start, _unit(part), max(SEARCH_BEAM, 2 * k))
                    q, c = np.nonzero(found >= 0)
                    v, w = vectors[found[q, c]], part[q]
                    score = np.einsum("ij,ij->i", v, w) / (np.linalg.norm(v, axis=1) * np.linalg.norm(w, axis=1))
                    out = pd.DataFrame({"asking": asking[at:at + 256][q], "class": ids[found[q, c]], "score": score})
                    out = out.sort_values(["asking", "score", "class"], ascending=[True, False, True])
                    yield out.groupby("asking", sort=False).head(k)

    return pairs(shards, queries, "kind").mapInPandas(run, "asking long, class long, score double")


def nearest(df: DataFrame, k: int = 5, id: str = "vec_id", vector: str = "embedding", asks: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row whose id is divisible by ``asks``, all rows but itself being candidates."""
    rows = usable(df, id, vector)
    known = common.stored(classes(rows, k + 1, asks), "classes")
    shards = common.stored(index(known), "index")
    found = search(shards, blocks(known), k + 1)
    return ranked(found, known, rows, k, asks, F.desc("score"))
