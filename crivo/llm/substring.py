"""Repeated passages: every word that some window of consecutive words covers, if that window's words also start anywhere else.

Positions of a document are anchors where their number modulo PERIOD lies in
COVER, a difference cover: for any two positions there is a shift below PERIOD
that makes both of them anchors. So two equal windows share an anchor, with the
words from it to the end of the window at the least: only the hashes of the
``window - PERIOD + 1`` words at anchors, a quarter of all positions, are compared
across documents. An anchor found twice is extended: its surroundings, as wide
as every window that holds the anchor, are compared too, and where they are equal
all these windows are repeated. For the other anchors, those near the ends of a
repeated passage, each window is hashed and compared itself, with those of one
anchor of each of the surroundings that its words have elsewhere.

Hashes are of 128 bits where they decide. In front of each comparison a task
keeps one row of each hash it has seen more than once, and marks the others as
known to be repeated, so a passage in any share of all documents doesn't meet in
one task. Texts are shuffled once, compressed, and only those with a repeated anchor go on.

A null text has no words. Documents shorter than a window lose nothing. Equal
rows, and rows of one id, are separate documents, and repeat each other; so does
a window that starts twice in one document. A null id keeps its row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: A perfect difference set: every difference modulo 21 but 0 occurs exactly once.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
#: Odd multipliers of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Words hashed at once before a task looks for what it has seen twice.
BLOCK_WORDS = 1_500_000
#: Of one hash of an anchor's words, at most so many rows of a block meet others by that hash alone.
LOCALLY_COMMON = 4


def words_of(text: str | bytes | None) -> list[bytes]:
    """The words of a text, or of one that ``packed`` has packed."""
    if isinstance(text, bytes):
        return zstandard.ZstdDecompressor().decompress(text).split()
    return (text or "").encode().split()


def packed(rows: DataFrame) -> DataFrame:
    """``rows`` (k, id, text) with the texts compressed, as they go through the shuffle that brings anchors to them."""
    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for whole in batches:
            for at in range(0, whole.num_rows, 256):  # few texts at a time are held twice
                batch = whole.slice(at, 256)
                texts = pa.array([pack(memoryview(x.as_buffer())) if x.is_valid else None for x in batch.column(2)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["k", "id", "text"])

    return rows.mapInArrow(run, "k long, id long, text binary")


class Rolling:
    """Hash of any run of words of one document, from prefix sums modulo 2**64."""

    powers: dict[int, np.ndarray] = {}

    def __init__(self, words: list[bytes], base: int, seed: int):
        self.base = base
        h = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))
        self.prefix = np.zeros(len(words) + 1, np.uint64)
        up = self._powers(base, len(words) + 1)
        np.cumsum(h * up[:len(words)], out=self.prefix[1:])

    @classmethod
    def _powers(cls, base: int, n: int) -> np.ndarray:
        known = cls.powers.get(base)
        if known is None or len(known) < n:
            size = max(1024, 1 << (n - 1).bit_length())
            known = np.full(size, base, np.uint64)
            known[0] = 1
            np.multiply.accumulate(known, out=known)
            cls.powers[base] = known
        return known

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        down = self._powers(pow(self.base, -1, 1 << 64), len(self.prefix))
        value = (self.prefix[stop] - self.prefix[start]) * down[start]
        value ^= value >> np.uint64(32)  # the lowest bits of a sum of products are poorly mixed
        return value * np.uint64(0xD6E8FEB86659FD93)


def anchors_of(n: int, window: int) -> np.ndarray:
    """Anchor positions of a document of n words whose anchor words lie inside it; none if no window fits."""
    if n < window:
        return np.zeros(0, np.int64)
    length = window - PERIOD + 1
    every = (np.arange(0, n, PERIOD)[:, None] + np.array(COVER)).ravel()
    return every[every + length <= n]


def _first_of_each(*hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with hashes: whether each is the first of its hash, and whether its hash occurs again."""
    order = np.lexsort(hashes)
    same = np.ones(len(order) - 1, bool) if len(order) else np.zeros(0, bool)
    for h in hashes:
        same &= h[order[1:]] == h[order[:-1]]
    first, again = np.ones(len(order), bool), np.zeros(len(order), bool)
    first[order[1:][same]] = False
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return first, again


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))


def _signed(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a, np.uint64).view(np.int64)


def keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(k, id, text); k is a hash of id and text: rows equal in both are told apart by nothing, and need not be."""
    i, t = common.col(id).cast("long"), common.col(text)
    return docs.select(F.xxhash64(i, F.coalesce(t, F.lit("")), F.lit(5)).alias("k"), i.alias("id"), t.alias("text"))


def _anchor_rows(window: int):
    """(h, c, k, tag): hash of the anchor's words, of its surroundings, the document; its position and two marks in one number.

    The tag is 8 * position + 2 * known + dealt. known: 0 if only other tasks can tell, 1 if the anchor is repeated within these documents, 2 if its
    surroundings are as well. Rows of 2 that aren't the first of their surroundings get a hash of their own place instead.
    dealt: 1 if it's dealt by its surroundings. Rows with a negative tag only tell others that a hash is known to be repeated.
    """
    length = window - PERIOD + 1

    def flush(parts):
        h, c, k, at = (np.concatenate(x) for x in zip(*parts))
        _, again = _first_of_each(h)
        first_c, again_c = _first_of_each(c, h)
        known = again.astype(np.int8) + again_c
        # what no other document needs to hear of once more is dealt by its own place
        away = again_c & ~first_c
        h, c = h.copy(), c.copy()
        own = (k.view(np.uint64) + np.uint64(1)) * np.uint64(BASES[0]) + at.astype(np.uint64)
        # words before many different surroundings: one row tells other tasks of them, the others are dealt by their surroundings
        _, of, times = np.unique(h[~away], return_inverse=True, return_counts=True)
        common = np.zeros(len(h), bool)
        common[~away] = times[of] > LOCALLY_COMMON
        told = np.unique(h[common])
        h[common] = h[common] * np.uint64(BASES[1]) ^ c[common]
        h[away] = c[away] = own[away]
        none = np.zeros(len(told), np.int64)
        return _batch({
            "h": _signed(np.append(h, told)), "c": _signed(np.append(c, told * np.uint64(BASES[0]) + np.uint64(len(h)) + own[:1].sum())),
            "k": np.append(k, none), "tag": np.append(8 * at + 2 * known + common, none - 6)})

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                at = anchors_of(len(words), window)
                held += len(words)
                if len(at):
                    one, two = Rolling(words, BASES[0], 1), Rolling(words, BASES[1], 2)
                    low, high = np.maximum(0, at - PERIOD + 1), np.minimum(len(words), at + window)
                    place = ((at - low) * 64 + (high - at)).astype(np.uint64)  # surroundings cut short at other sides differ
                    parts.append((one.of(at, at + length), two.of(low, high) + place * np.uint64(BASES[1]), np.full(len(at), k, np.int64), at))
                if held >= BLOCK_WORDS and parts:
                    yield flush(parts)
                    parts, held = [], 0
        if parts:
            yield flush(parts)

    return run


def _window_rows(window: int):
    """(a, b, k, at, known): both hashes of each window that holds an anchor of ``open``."""
    def flush(parts):
        a, b, k, at = (np.concatenate(x) for x in zip(*parts))
        first, again = _first_of_each(a, b)
        away = again & ~first
        a, b = a.copy(), b.copy()
        a[away] = (k[away].view(np.uint64) + np.uint64(1)) * np.uint64(BASES[0]) + at[away].astype(np.uint64)
        b[away] = a[away]
        return _batch({"a": _signed(a), "b": _signed(b), "k": k, "at": at.astype(np.int32), "known": again})

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for k, text, open_ in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = words_of(text)
                starts = covered(len(words), [(p - PERIOD + 1, p + 1) for p in open_])
                at = np.flatnonzero(starts[:max(0, len(words) - window + 1)])
                if len(at):
                    held += len(words)
                    parts.append((Rolling(words, BASES[0], 3).of(at, at + window), Rolling(words, BASES[1], 4).of(at, at + window), np.full(len(at), k, np.int64), at))
                if held >= BLOCK_WORDS and parts:
                    yield flush(parts)
                    parts, held = [], 0
        if parts:
            yield flush(parts)

    return run


def covered(n: int, spans) -> np.ndarray:
    """Which of n places lie in some span (start, stop); spans may reach over the ends."""
    steps = np.zeros(n + 1, np.int64)
    if len(spans):
        s = np.clip(np.asarray(spans, np.int64), 0, n)
        np.add.at(steps, s[:, 0], 1)
        np.add.at(steps, s[:, 1], -1)
    return np.cumsum(steps[:n]) > 0


def repeated_anchors(docs: DataFrame, window: int) -> DataFrame:
    """(k, sure, open): positions of repeated anchors of each document, with equal surroundings elsewhere and without."""
    rows = docs.select("k", "text").mapInArrow(_anchor_rows(window), "h long, c long, k long, tag long")
    by_surroundings, by_words = Window.partitionBy("h", "c"), Window.partitionBy("h")
    seen = rows.repartition("h").withColumns({
        "cn": F.count("*").over(by_surroundings), "least": F.min(F.struct("k", "tag")).over(by_surroundings),
    })
    known = F.shiftright(F.col("tag"), 1).bitwiseAND(3)
    seen = seen.withColumns({"hn": F.count("*").over(by_words), "alone": F.min(F.greatest(F.col("cn"), known)).over(by_words)})
    sure = (known == 2) | (F.col("cn") > 1)
    # a window near the end of a passage may be equal to one in the midst of a longer one: where surroundings differ
    # behind equal words, one anchor of each surroundings has its windows compared, too
    dealt = F.col("tag").bitwiseAND(1) == 1
    shows = (F.col("least") == F.struct("k", "tag")) & (dealt | (F.col("alone") < 2))
    found = seen.filter((F.col("tag") >= 0) & (sure | (known == 1) | (F.col("hn") > 1))).select(
        "k", F.shiftright(F.col("tag"), 3).cast("int").alias("at"), sure.alias("sure"), (~sure | shows).alias("open"))
    return found.groupBy("k").agg(
        F.collect_set(F.when(F.col("sure"), F.col("at"))).alias("sure"), F.collect_set(F.when(F.col("open"), F.col("at"))).alias("open"))


def repeated_passages(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = 35) -> DataFrame:
    """For each document with something to remove: (k, id, n_words, spans, kept).

    ``k`` is the document's key as ``keyed`` gives it, ``spans`` the removed runs of words (start, stop),
    ``kept`` the words that stay, joined by one space.
    """
    if window < PERIOD:
        raise ValueError(f"windows of less than {PERIOD} words share no anchor")
    rows = keyed(docs, id, text)
    # equal rows stand once: all their windows are repeated, which their anchors have shown already
    joined = packed(rows).join(repeated_anchors(rows, window), "k").groupBy("k", "id").agg(*[F.first(c).alias(c) for c in ("text", "sure", "open")])
    touched = common.stored(joined, "touched")
    windows = touched.filter(F.size("open") > 0).select("k", "text", "open").mapInArrow(
        _window_rows(window), "a long, b long, k long, at int, known boolean")
    again = F.count("*").over(Window.partitionBy("a", "b")) > 1
    found = windows.withColumn("again", again).filter("again or known").groupBy("k").agg(F.collect_set("at").alias("starts"))

    def cut(batches):
        for batch in batches:
            out = {"n_words": [], "spans": [], "kept": []}
            for text_, sure, starts in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "sure", "starts"))):
                words = words_of(text_)
                gone = covered(len(words), [(p - PERIOD + 1, p + window) for p in sure] + [(p, p + window) for p in starts or ()])
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                out["n_words"].append(len(words))
                out["spans"].append([{"start": int(s), "stop": int(e)} for s, e in edges.reshape(-1, 2)])
                out["kept"].append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g).decode())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(out["n_words"], pa.int64()),
                pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.array(out["kept"], pa.string()),
            ], names=["k", "id", "n_words", "spans", "kept"])

    cuts = touched.join(found, "k", "left").select("k", "id", "text", "sure", "starts").mapInArrow(
        cut, "k long, id long, n_words long, spans array<struct<start:int,stop:int>>, kept string")
    return cuts.filter(F.size("spans") > 0)


def whole_words(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, id, n_words, words_sha256) of each row: the digest of all its words, joined by one space."""
    def run(batches):
        for batch in batches:
            split = [words_of(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(map(len, split), pa.int64()),
                pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in split])], names=["k", "id", "n_words", "words_sha256"])

    return keyed(docs, id, text).mapInArrow(run, "k long, id long, n_words long, words_sha256 string")
