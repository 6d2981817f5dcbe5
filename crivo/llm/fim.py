"""Fill-in-the-middle over a piece table.

A document is a list of descriptors (buffer, start, length) over two buffers that
never change: the bytes of its text as they lie in the Arrow batch, and the
sentinels. Cutting splits the descriptor that holds the place, an arrangement
permutes descriptors and puts sentinels between, and digests are fed descriptor
by descriptor; bytes are copied once, when an output is written. Restoring reads
the output's sentinels back into descriptors over the output, and takes the
inverse permutation.

Units are maximal runs of ASCII letters and single other characters. Every unit
begins at a byte that starts a character and isn't a letter after a letter, so
that no unit is ever made into a string of its own.

A null text is an empty one, and empty texts, texts that hold a sentinel and the
share of texts outside ``rate`` stay plain. Which form a document gets and where
it is cut depends on its id and the seed alone: rows that repeat come out alike,
also in a task that runs again; a null id counts as an empty one. Texts of any
length take time and memory in proportion to their bytes. Other columns pass
through untouched, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SENTINELS = b"<P><S><M>"
PREFIX, SUFFIX, MIDDLE = (1, 0, 3), (1, 3, 3), (1, 6, 3)
#: Form -> what stands in the output, in order: a sentinel and the number of the part (prefix, middle, suffix) after it.
ARRANGEMENTS = {
    "psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)),
    "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1)),
}
#: Bytes of text after which a batch of results is given out.
BATCH_BYTES = 8 << 20

_LETTER = np.zeros(256, bool)
_LETTER[ord("A"):ord("Z") + 1] = _LETTER[ord("a"):ord("z") + 1] = True


class PieceTable:
    """Descriptors over the bytes of a text and over the sentinels."""

    __slots__ = ("buffers", "pieces")

    def __init__(self, text: memoryview, pieces: Iterable[tuple[int, int, int]] | None = None):
        self.buffers = (text, memoryview(SENTINELS))
        self.pieces = [(0, 0, len(text))] if pieces is None else list(pieces)

    def cut(self, *places: int) -> PieceTable:
        """Split at byte offsets of the document, in rising order; a cut at an end or at another cut leaves an empty piece."""
        out, left, before = [], list(places), 0
        for i, (buffer, start, length) in enumerate(self.pieces):
            last = i == len(self.pieces) - 1
            while left and (left[0] < before + length or (last and left[0] == before + length)):
                here = left.pop(0) - before
                out.append((buffer, start, here))
                buffer, start, length, before = buffer, start + here, length - here, before + here
            out.append((buffer, start, length))
            before += length
        return PieceTable(self.buffers[0], out)

    def arranged(self, form: str) -> PieceTable:
        """Prefix, middle and suffix in the order of a form, each behind its sentinel."""
        out = []
        for sentinel, part in ARRANGEMENTS[form]:
            out += [sentinel, self.pieces[part]]
        return PieceTable(self.buffers[0], out)

    def original(self, form: str) -> PieceTable:
        """The inverse of ``arranged``: sentinels out, parts back in the order of the text."""
        parts = [None] * len(ARRANGEMENTS[form])
        for i, (_, part) in enumerate(ARRANGEMENTS[form]):
            parts[part] = self.pieces[2 * i + 1]
        return PieceTable(self.buffers[0], parts)

    def slices(self) -> Iterable[memoryview]:
        for buffer, start, length in self.pieces:
            if length:
                yield self.buffers[buffer][start:start + length]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for piece in self.slices():
            digest.update(piece)
        return digest.hexdigest()

    def text(self) -> bytes:
        return b"".join(self.slices())


def unit_bounds(data: np.ndarray) -> np.ndarray:
    """Byte offsets at which units begin, and the end."""
    letter = _LETTER[data]
    inside = letter.copy()
    inside[1:] &= letter[:-1]
    inside[:1] = False
    return np.append(np.flatnonzero(((data & 0xC0) != 0x80) & ~inside), len(data))


def characters(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def holds_sentinel(data: bytes) -> bool:
    return any(SENTINELS[start:start + length] in data for _, start, length in (PREFIX, SUFFIX, MIDDLE))


def drawn(text: memoryview, digest: str, rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, PieceTable]:
    """(units, form, characters of the prefix and of the middle, output) of one text, by the digest of its id."""
    data = np.frombuffer(text, np.uint8)
    bounds = unit_bounds(data)
    n = len(bounds) - 1
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    table = PieceTable(text)
    if not n or h3 % 100 >= rate or holds_sentinel(bytes(text)):
        return n, "plain", None, None, table
    form = "spm" if h4 % 100 < spm_rate else "psm"
    first, second = (int(bounds[i]) for i in sorted((h1 % (n + 1), h2 % (n + 1))))
    return n, form, characters(data[:first]), characters(data[first:second]), table.cut(first, second).arranged(form)


def read_back(output: memoryview, form: str) -> PieceTable:
    """The text that an output was made of, from the output and its form alone."""
    table = PieceTable(output)
    if form == "plain":
        return table
    data, places, at = bytes(output), [], 0
    for (_, start, length), _part in ARRANGEMENTS[form]:
        # a text that holds a sentinel is plain, and none can arise across a border: it would have to begin in a text
        # and end in a sentinel, whose first character no sentinel has further on
        at = data.index(SENTINELS[start:start + length], at)
        places += [at, at + length]
        at += length
    cut = table.cut(*places)
    return PieceTable(output, cut.pieces[1:]).original(form)


def _mapped(df: DataFrame, column: str, helpers: tuple[str, ...], fields: list[T.StructField], row) -> DataFrame:
    """``df`` without ``column`` and ``helpers`` and with what ``row`` makes of their values, given out in bounded batches."""
    gone = {column, *helpers}
    keep = [f for f in df.schema.fields if f.name not in gone]
    names = common.private(df.select(*[common.col(f.name) for f in keep]), *[f.name for f in fields])
    schema = T.StructType(keep + [T.StructField(n, f.dataType) for n, f in zip(names, fields)])
    types = [pa.string() if f.dataType == T.StringType() else pa.int64() for f in fields]

    def run(batches):
        empty = memoryview(b"")
        for batch in batches:
            kept = [i for i, n in enumerate(batch.schema.names) if n not in gone]
            texts, others = batch.column(batch.schema.get_field_index(column)), [
                batch.column(batch.schema.get_field_index(h)) for h in helpers]
            made, begun, size = [], 0, 0
            for i in range(batch.num_rows):
                value = texts[i].as_buffer()
                text = empty if value is None else memoryview(value)
                made.append(row(text, *[o[i].as_py() for o in others]))
                size += len(text)
                if size >= BATCH_BYTES or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(k).slice(begun, len(made)) for k in kept]
                        + [pa.array(c, t) for c, t in zip(zip(*made), types)], names=[batch.schema.names[k] for k in kept] + names)
                    made, begun, size = [], i + 1, 0

    return df.mapInArrow(run, schema)


def id_digest(id: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256)


def transform(df: DataFrame, id: str = "doc_id", text: str = "text", rate: int = 90, spm_rate: int = 20, seed: int = 1) -> DataFrame:
    """The column ``text`` replaced by units, form, prefix_chars, middle_chars (null if plain), output and output_sha256.

    ``rate`` of 100 documents are taken apart, ``spm_rate`` of 100 of those with the suffix first.
    """
    digest, = common.private(df, "digest_")

    def row(value, drawn_by):
        n, form, prefix, middle, table = drawn(value, drawn_by, rate, spm_rate)
        return n, form, prefix, middle, table.text(), table.sha256()

    fields = [T.StructField("units", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
              T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()), T.StructField("output_sha256", T.StringType())]
    return _mapped(df.withColumn(digest, id_digest(common.col(id), seed)), text, (digest,), fields, row)


def restore(df: DataFrame, output: str = "output", form: str = "form", digest_only: bool = False) -> DataFrame:
    """The columns ``output`` and ``form`` replaced by the text they were made of, and its digest; or by the digest alone."""
    def row(value, of):
        table = read_back(value, of or "plain")
        return (table.sha256(),) if digest_only else (table.text(), table.sha256())

    fields = [T.StructField("text", T.StringType()), T.StructField("text_sha256", T.StringType())]
    copy, = common.private(df, "form_")
    return _mapped(df.withColumn(copy, common.col(form)), output, (copy,), fields[digest_only:], row)
