"""Byte-level BPE as a finite-state transducer that is made deterministic while it runs.

The merges of a rank file are compiled into a byte trie of the tokens and a
relation on neighbouring tokens: (a, b) may stand side by side if merging the
bytes of both gives a and b again. A token sequence is the one that merging by
rank gives exactly if all its neighbours may stand side by side, so that every
prefix of a piece has one last token.

A state of the transducer is what later bytes can still change: the starts from
which some token may yet be completed, each with the tokens between the last
one emitted and that start. Tokens on which all those starts agree are emitted
at once, so output lags behind by less than the longest token. States and arcs
are made when first met and kept in a table of bounded size.

Null texts are encoded as empty ones: no ids. Texts of any length, and long runs
of one character, take time in proportion to their bytes. Rows repeat as they
are; columns besides the text pass through untouched.
"""

from __future__ import annotations

import array
import base64
import functools
import gc
import hashlib
import string
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

#: Bounds of the tables that a Python worker keeps: of each a new one and the one before it, from which what is used again moves over.
MAX_ARCS, MAX_PIECES, MAX_PIECE_CHARS = 50_000, 200_000, 48
#: Bytes of text, or of four for each id, after which a batch of results is given out.
BATCH_BYTES = 4 << 20
#: The branch of a pattern that makes one piece of a space and the letters after it.
SPACED_LETTERS = r" ?\p{L}+"
#: Up to so many bytes from the first missing arc of a piece on are walked without making arcs:
#: what comes once leaves a mark, what comes again is compiled step by step.
SHORT = 32

FOREVER = 1 << 62


class _State:
    __slots__ = ("id", "last", "live")

    def __init__(self, id: int, last: int, live: tuple):
        self.id, self.last, self.live = id << 8, last, live


class Transducer:
    """Encodes pieces of bytes by a table of ranks; decodes ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        # the trie: node << 8 | byte -> node, node -> token that ends there
        self.goto: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        inner = {0}
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                inner.add(node)
                node = self.goto.setdefault(node << 8 | byte, len(self.goto) + 1)
            self.token_at[node] = rank
        self.inner = inner  # nodes from which a longer token may come
        self.right_edge = functools.cache(lambda token: self._edge(token, 1))
        self.left_edge = functools.cache(lambda token: self._edge(token, 0))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.states: dict[tuple, _State] = {}
        self.arcs: dict[int, tuple[_State, tuple]] = {}  # state and byte -> state, tokens emitted
        self.made = 0
        self.forget()
        self.start = self._state(-1, ((0, ()),))

    def forget(self) -> None:
        """States and arcs that aren't met again before the next time are gone then."""
        self.older_states, self.older_arcs = self.states, self.arcs
        self.states, self.arcs = {}, {}
        self.asked: set[int] = set()

    def merged(self, piece: bytes, down_to: int = 1) -> list[bytes]:
        """Merging by rank, step by step, until nothing merges or ``down_to`` parts are left: what defines the encoding."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > down_to:
            best = min(
                ((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None),
                default=None,
            )
            if best is None:
                break
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """The parts that stand at one end of a token while it is merged, each with the rank of the merge that ends it."""
        out, part, until = [], self.bytes_of[token], FOREVER
        while True:
            out.append((part, until))
            if len(part) == 1:
                return out
            until = self.ranks[part]
            part = self.merged(part, 2)[-1 if side else 0]

    def side_by_side(self, a: int, b: int) -> bool:
        """False if some part at a's end merges with one at b's start before both are taken by their own tokens.

        Of two merges of one rank the left one comes first.
        """
        known = self.pairs.get((a, b))
        if known is None:
            known = True
            for x, x_until in self.right_edge(a):
                for y, y_until in self.left_edge(b):
                    rank = self.ranks.get(x + y)
                    if rank is not None and rank < x_until and rank <= y_until:
                        known = False
            if len(self.pairs) >= 4 * MAX_ARCS:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def _state(self, last: int, live: tuple) -> _State:
        key = (last, live)
        if (state := self.states.get(key)) is None:
            if (state := self.older_states.get(key)) is None:
                state = _State(self.made, last, live)
                self.made += 1
            self.states[key] = state
        return state

    def _step(self, live, last: int, byte: int) -> list:
        """The live starts after one more byte; the newest, at the end, has all tokens up to here."""
        out, reached = [], None
        for node, tail in live:
            node = self.goto.get(node << 8 | byte)
            if node is None:
                continue
            if reached is None and (token := self.token_at.get(node)) is not None:
                before = tail[-1] if tail else last
                known = before < 0 or self.pairs.get((before, token))
                if known is None:
                    known = self.side_by_side(before, token)
                if known:
                    reached = (*tail, token)
            if node in self.inner:
                out.append((node, tail))
        out.append((0, reached))
        return out

    def _arc(self, state: _State, byte: int) -> tuple[_State, tuple]:
        live = self._step(state.live, state.last, byte)
        reached = live[-1][1]
        sure = len(reached)  # tokens on which all live starts agree
        for _, tail in live[:-1]:
            sure = min(sure, len(tail))
            while tail[:sure] != reached[:sure]:
                sure -= 1
            if not sure:
                break
        out = reached[:sure]
        after = self._state(out[-1], tuple([(n, t[sure:]) for n, t in live])) if sure else self._state(state.last, tuple(live))
        self.arcs[state.id | byte] = arc = after, out
        return arc

    def _last(self, state: _State, rest: bytes) -> tuple:
        """The tokens not yet emitted after ``rest``, walked through without making states."""
        goto, token_at, pairs, inner = self.goto.get, self.token_at.get, self.pairs.get, self.inner
        live, last, reached = state.live, state.last, ()
        for byte in rest:
            out, reached = [], None
            for node, tail in live:
                node = goto(node << 8 | byte)
                if node is None:
                    continue
                if reached is None and (token := token_at(node)) is not None:
                    before = tail[-1] if tail else last
                    known = before < 0 or pairs((before, token))
                    if known is None:
                        known = self.side_by_side(before, token)
                    if known:
                        reached = (*tail, token)
                if node in inner:
                    out.append((node, tail))
            out.append((0, reached))
            live = out
        return reached

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece, as merging by rank gives them.

        An arc is made when it is asked for the second time; the first time, a rest that is short is walked through,
        so that what comes once leaves only its mark.
        """
        if len(self.arcs) > MAX_ARCS or len(self.asked) > 2 * MAX_ARCS:
            self.forget()
        state, ids, known, older, asked = self.start, [], self.arcs.get, self.older_arcs.get, self.asked
        for i, byte in enumerate(piece):
            key = state.id | byte
            arc = known(key)
            if arc is None:
                if (arc := older(key)) is not None:
                    self.arcs[key] = arc
                elif key not in asked and len(piece) - i <= SHORT:
                    asked.add(key)
                    ids += self._last(state, piece[i:])
                    return ids
                else:
                    arc = self._arc(state, byte)
            state = arc[0]
            if arc[1]:
                ids += arc[1]
        ids += state.live[-1][1]
        return ids


class _Known(dict):
    """Text -> its ids as little-endian 32-bit integers, made when first asked for; what isn't asked for long is forgotten."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, text: str) -> bytes:
        packed = self.older.get(text)
        if packed is None:
            packed = self.make(text)
        if len(text) <= MAX_PIECE_CHARS:
            if len(self) >= MAX_PIECES:
                self.older = dict(self)
                self.clear()
            self[text] = packed
        return packed


def _packed(ids: list[int]) -> bytes:
    out = array.array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Codec:
    """Whole texts to ids and back.

    The pattern splits a text into pieces. Where a single space stands between
    two characters that aren't white space, a piece begins with it, whatever
    stands around; so the words between such spaces can be looked up as wholes.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.split = regex.compile(pattern).findall
        self.wide_space = regex.compile(r"\s\s|^\s|\s$").search
        self.words_may_stand_alone = [" a", "\n", " b"] == self.split(" a\n b")
        # with this branch and none before it that begins with a letter or a space, a space and letters are one piece
        self.letters_are_one = self.words_may_stand_alone and SPACED_LETTERS in (branches := pattern.split("|")) and all(
            b.startswith("'") for b in branches[:branches.index(SPACED_LETTERS)])
        self.pieces = _Known(self._piece)
        self.words = _Known(self._word)
        # all tokens one after the other, and where each begins and ends
        parts = [self.transducer.bytes_of.get(i, b"") for i in range(max(ranks.values()) + 1)]
        self.lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.joined = np.frombuffer(b"".join(parts), np.uint8)

    def _piece(self, piece: str) -> bytes:
        return _packed(self.transducer.encode_piece(piece.encode()))

    def _word(self, word: str) -> bytes:
        """The ids of a space and what stands up to the next one."""
        if self.letters_are_one:
            if word.isalpha():
                return self._piece(" " + word)
            base, sign = word[:-1], word[-1:]
            # letters and one sign are the piece of the letters, which is often known, and that of the sign
            if sign in string.punctuation and base.isalpha():
                return self.words[base] + self.pieces[sign]
        return self._pieces(" " + word)

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        if not self.words_may_stand_alone or self.wide_space(text):
            return self._pieces(text)
        words = text.split(" ")
        return self._pieces(words[0]) + b"".join(map(self.words.__getitem__, words[1:]))

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, gathered from the joined tokens at once."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[ids] - ends + lengths, lengths)
        at += np.arange(len(at))
        return self.joined[at].tobytes()


class Utf8Stream:
    """Incremental UTF-8 decoder: text as far as it is complete, an unfinished last character is held back.

    Bytes that are no UTF-8 become U+FFFD, as ``bytes.decode(errors="replace")`` gives for the whole.
    """

    #: First byte of a sequence -> its length, and the bounds of its second byte.
    LEADS = (
        (0xC2, 0xDF, 2, 0x80, 0xBF), (0xE0, 0xE0, 3, 0xA0, 0xBF), (0xE1, 0xEC, 3, 0x80, 0xBF), (0xED, 0xED, 3, 0x80, 0x9F),
        (0xEE, 0xEF, 3, 0x80, 0xBF), (0xF0, 0xF0, 4, 0x90, 0xBF), (0xF1, 0xF3, 4, 0x80, 0xBF), (0xF4, 0xF4, 4, 0x80, 0x8F),
    )

    def __init__(self):
        self.held = b""

    def _unfinished(self, data: bytes) -> int:
        """How many of the last bytes start a character that later bytes can complete."""
        for back in range(1, min(3, len(data)) + 1):
            first = data[-back]
            if 0x80 <= first <= 0xBF:
                continue
            for low, high, length, second_low, second_high in self.LEADS:
                if low <= first <= high:
                    fits = back == 1 or second_low <= data[1 - back] <= second_high
                    return back if fits and back < length else 0
            return 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        cut = len(data) - self._unfinished(data)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


@functools.lru_cache(maxsize=4)
def codec(rank_file: str, pattern: str) -> Codec:
    """The codec of a rank file, one for each Python worker."""
    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    made = Codec(ranks, pattern)
    # millions of small lasting objects, no garbage in cycles: full collections would only cost time
    gc.collect()
    gc.freeze()
    gc.set_threshold(500_000, 50, 100)
    return made


def decode_stream(c: Codec, ids: np.ndarray, step: int = 65_536) -> Iterator[tuple[bytes, str]]:
    """Bytes and text of ids, ``step`` ids at a time."""
    stream = Utf8Stream()
    for i in range(0, len(ids), step):
        data = c.decode_bytes(ids[i:i + step])
        yield data, stream.feed(data)
    if tail := stream.close():
        yield b"", tail


def _with(df: DataFrame, text: str, fields: list[T.StructField], row) -> DataFrame:
    """``df`` without its column ``text`` and with what ``row`` makes of each value of it, in batches of bounded size."""
    keep = [f for f in df.schema.fields if f.name != text]
    names = common.private(df.select(*[common.col(f.name) for f in keep]), *[f.name for f in fields])
    schema = T.StructType(keep + [T.StructField(n, f.dataType, f.nullable) for n, f in zip(names, fields)])
    types = [t.type for t in _arrow(T.StructType(fields))]

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            values, begun, size, rows = batch.column(at), 0, 0, []
            kept = [i for i in range(batch.num_columns) if i != at]
            for i in range(batch.num_rows):
                value = values[i]
                size += _bytes_in(value)
                rows.append(row(value))
                if size >= BATCH_BYTES or i == batch.num_rows - 1:
                    made = [_column(c, t) for c, t in zip(zip(*rows), types)]
                    yield pa.RecordBatch.from_arrays([batch.column(k).slice(begun, len(rows)) for k in kept] + made,
                                                     names=[batch.schema.names[k] for k in kept] + names)
                    begun, size, rows = i + 1, 0, []

    return df.mapInArrow(run, schema)


def _bytes_in(value: pa.Scalar) -> int:
    if not value.is_valid:
        return 0
    return 4 * len(value) if pa.types.is_list(value.type) else value.as_buffer().size


def _column(values: tuple, kind: pa.DataType) -> pa.Array:
    """Arrow column of what rows gave; lists of ids come packed, and are put into one buffer."""
    if not pa.types.is_list(kind):
        return pa.array(values, kind)
    ends = np.cumsum([0, *(len(v) // 4 for v in values)], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(values), "<i4"), kind.value_type)).cast(kind)


def _arrow(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text") -> DataFrame:
    """The column ``text`` replaced by ``ids`` (array of int)."""
    def row(value):
        return (codec(rank_file, pattern).encode(value.as_py() or ""),)

    return _with(df, text, [T.StructField("ids", T.ArrayType(T.IntegerType()))], row)


def decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids") -> DataFrame:
    """The column ``ids`` replaced by ``text``; null ids are no ids."""
    def row(value):
        known = np.asarray(value.as_py() or (), np.int64)
        return ("".join(part for _, part in decode_stream(codec(rank_file, pattern), known)),)

    return _with(df, ids, [T.StructField("text", T.StringType())], row)


def round_trip(df: DataFrame, rank_file: str, pattern: str, text: str = "text") -> DataFrame:
    """Encodes and decodes in one pass: ``text`` replaced by n_tokens, the ids and the decoded bytes, both as binary digests.

    One pass keeps the ids of a text inside the task that made them.
    """
    def row(value):
        c = codec(rank_file, pattern)
        packed = c.encode(value.as_py() or "")
        back = hashlib.sha256()
        for data, _ in decode_stream(c, np.frombuffer(packed, "<u4")):
            back.update(data)
        return len(packed) // 4, hashlib.sha256(packed).hexdigest(), back.hexdigest()

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _with(df, text, fields, row)
