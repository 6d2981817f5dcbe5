"""Repair of conversation structure by iterative-deepening A*.

Rows of a conversation, in order, are edited until the initials of the roles read
``(s?(ua)+)?``: Keep (K) costs 0, Rerole to user or assistant (R) 1, Delete (D) 2,
Insert of an empty user or assistant turn (I) 5. Blank and duplicate rows must go;
a truncated row that stays costs 5 more. The answer is the cheapest list of edits,
of equally cheap ones the ASCII-least.

The search goes depth first through the edits in ASCII order under a bound on the
cost; a bound that fails is followed by the least cost that went beyond it. The
heuristic is the cost that the rows ahead force in any case. A table of failed
states keeps, for (row, last role), how much the rest costs at least, learnt from
every search that came back from there; so no state is searched twice with too
little left to spend. The first accepting path under the first bound that has one
is the answer: no path is cheaper, and none before it in ASCII order is as cheap.

A conversation of any length is cut into runs of at most ``RUN`` rows by their
place in the sorted table, and a run is searched between every two roles that it
may begin and end with. Two paths between the same roles over the same rows differ
in cost if one begins the other, so the cheapest and least paths of neighbouring
runs join to those of both, whatever the cut. Runs are searched in parallel and
joined in two levels; texts pass through in sorted streams and are never gathered.
What must fit into a row is the list of edits of one conversation, a letter a row.

Rows stand by turn, nulls first, then by a digest of role and text; equal rows are
repeats, of which all but the first are duplicates. Null roles and texts are one space each, so
such texts are blank. A null id is a conversation of its own. An empty table gives
an empty result; other columns are left behind.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Rows of a run, as a power of two, and runs that are joined at a time.
RUN_BITS, JOIN_BITS = 6, 8
RUN = 1 << RUN_BITS

DELETE, INSERT, REROLE = 2, 5, 1
#: What a truncated row that stays costs.
TRUNCATED = 5

#: Last role -> the role that may be inserted or given next, and all that may come next. "0": none yet.
GIVEN = {"0": "u", "s": "u", "u": "a", "a": "u"}
NEXT = {"0": "su", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}
#: Where a path that begins after a role may end.
ENDS = {"0": "0sua", "s": "sua", "u": "ua", "a": "ua"}

#: A row as one letter: its role's initial (s, u, a, or o for all others), upper case if truncated; two letters for rows that must go.
BLANK, DUPLICATE = "b", "d"
FOREVER = 1 << 60

_WHITE = r"\x20\x09-\x0D"


def damaged(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, turn, role, text) with faults put in by a checksum of conversation and turn, for trials.

    Of 20 remainders 0 drops the row, 1 empties its text, 2 takes out its sentence ends, 3 repeats it, 4 gives it to the user.
    """
    spaced = lambda name: F.coalesce(common.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced(conversation), F.lit(":"), spaced(turn))) % 20
    rows = df.select(common.col(conversation), common.col(turn), spaced(role).alias(role), spaced(text).alias(text), kind.alias("kind_"))
    rows = rows.filter("kind_ <> 0").withColumn("again_", F.explode(F.sequence(F.lit(1), F.when(F.col("kind_") == 3, 2).otherwise(1))))
    x, r = common.col(text), common.col(role)
    x = F.when(F.col("kind_") == 1, "").when(F.col("kind_") == 2, F.regexp_replace(x, "[.!?]", "")).otherwise(x)
    return rows.select(common.col(conversation), common.col(turn), F.when(F.col("kind_") == 4, "user").otherwise(r).alias(role), x.alias(text))


def _in_order(df: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, at, t, k, r, x), stored in order: ``at`` rises with conversation, turn and ``k``, the digest of role and text.

    A conversation of any share is spread over ranges of its turns and digests; no text is among the sampled bounds.
    """
    spaced = lambda name: F.coalesce(common.col(name).cast("string"), F.lit(" "))
    rows = df.select(common.col(conversation).alias("c"), common.col(turn).cast("long").alias("t"), spaced(role).alias("r"), spaced(text).alias("x"))
    rows = rows.withColumn("k", F.sha2(F.concat(F.length("r").cast("string"), F.lit(":"), "r", "x"), 256))
    order = [F.col("c").asc_nulls_first(), F.col("t").asc_nulls_first(), F.col("k").asc()]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return common.stored(ordered.select("c", F.monotonically_increasing_id().alias("at"), "t", F.unhex("k").alias("k"), "r", "x"), "turns")


def _letters(rows: DataFrame) -> DataFrame:
    """(c, at, letter, initial): the first fault of each row, and its role.

    The first of equal rows is the one with the least place, found by an aggregate and met again at its place,
    a key without repeats: no content is so frequent that its rows would meet.
    """
    first = rows.groupBy("c", "k").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    initial = F.substring("r", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    kind = F.when(~F.col("x").rlike(f"[^{_WHITE}]"), BLANK).when(~F.col("x").rlike(rf"[.!?][{_WHITE}]*\z"), "t").otherwise("")
    seen = rows.select("c", "at", initial.alias("initial"), kind.alias("kind")).join(first, "at", "left")
    letter = F.when(F.col("kind") == BLANK, BLANK).when(F.col("first").isNull(), DUPLICATE).when(
        F.col("kind") == "t", F.upper("initial")).otherwise(F.col("initial"))
    return seen.select("c", "at", letter.alias("letter"), "initial")


@functools.lru_cache(maxsize=20_000)
def forced(letters: str) -> tuple[int, ...]:
    """For each row, what it and all after it cost at least: deletion where it must go or is truncated."""
    out = [0]
    for letter in reversed(letters):
        out.append(out[-1] + (DELETE if letter in (BLANK, DUPLICATE) or letter.isupper() else 0))
    return tuple(reversed(out))


def search(letters: str, begin: str, ends: str, failed: dict | None = None) -> tuple[int, str] | None:
    """(cost, edits) of the cheapest and ASCII-least way from role ``begin`` through all rows to one of ``ends``; None if there is none.

    ``failed`` holds what is known of states (row, last role) on the way to the same ends: what the rest costs at least.
    """
    ahead, failed, n, path = forced(letters), {} if failed is None else failed, len(letters), []

    def at_least(i: int, last: str) -> int:
        return failed.get((i, last), ahead[i])

    def go(i: int, last: str, left: int, inserted: str) -> bool:
        if at_least(i, last) > left:
            return False
        if i == n and last in ends:
            return True
        given, moves = GIVEN[last], []
        if i < n:
            moves.append(("D", DELETE, i + 1, last))
        moves.append(("I", INSERT, i, given))
        if i < n and (letter := letters[i]) not in (BLANK, DUPLICATE):
            role, more = letter.lower(), TRUNCATED if letter.isupper() else 0
            if role in NEXT[last]:
                moves.append(("K", more, i + 1, role))
            if role != given:
                moves.append(("R", REROLE + more, i + 1, given))
        least = FOREVER
        for edit, cost, then, role in moves:
            if not any(end in ENDS[role] for end in ends):
                continue
            # a role that was inserted here before is not inserted again: the way round only costs
            if cost <= left and not (edit == "I" and role in inserted):
                path.append(edit)
                if go(then, role, left - cost, inserted + role if edit == "I" else role):
                    return True
                path.pop()
            least = min(least, cost + at_least(then, role))
        # behind an insertion the ways that lead back were left out, so that only their bounds count there
        failed[i, last] = max(least, at_least(i, last) if len(inserted) > 1 else left + 1)
        return False

    bound = at_least(0, begin)
    while bound < FOREVER:
        if go(0, begin, bound, begin):
            return bound, "".join(path)
        bound = at_least(0, begin)
    return None


@functools.lru_cache(maxsize=20_000)
def paths_of_run(letters: str) -> tuple[tuple[str, str, int, str], ...]:
    """(begin, end, cost, edits) between all roles that a run may stand between."""
    failed: dict[str, dict] = {end: {} for end in ENDS}
    found = [(begin, end, search(letters, begin, end, failed[end])) for begin, ends in ENDS.items() for end in ends]
    return tuple((begin, end, *best) for begin, end, best in found if best)


def joined(left: list, right: list) -> list:
    """Paths through two neighbouring runs."""
    best: dict = {}
    by_begin: dict = {}
    for begin, end, cost, edits in right:
        by_begin.setdefault(begin, []).append((end, cost, edits))
    for begin, middle, cost, edits in left:
        for end, more, rest in by_begin.get(middle, ()):
            known = best.get((begin, end))
            if known is None or cost + more < known[0] or (cost + more == known[0] and edits + rest < known[1]):
                best[begin, end] = (cost + more, edits + rest)
    return [(*ends, *found) for ends, found in best.items()]


def join_all(runs: list[list]) -> list:
    """Paths through all runs, joined in pairs so that letters are copied as often as the pairs are halved."""
    while len(runs) > 1:
        runs = [joined(*runs[i:i + 2]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return runs[0]


_PATHS = T.ArrayType(T.StructType([T.StructField("begin", T.StringType()), T.StructField("end", T.StringType()),
                                   T.StructField("cost", T.LongType()), T.StructField("edits", T.StringType())]))


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = batch.drop_columns(["letters"])
        paths = [[dict(zip(("begin", "end", "cost", "edits"), p)) for p in paths_of_run(x)] for x in batch.column("letters").to_pylist()]
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(paths, _arrow_paths())], names=[*kept.schema.names, "paths"])


def _arrow_paths() -> pa.DataType:
    return pa.list_(pa.struct([("begin", pa.string()), ("end", pa.string()), ("cost", pa.int64()), ("edits", pa.string())]))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with ``parts``, the paths of neighbouring runs in order, to rows with the paths through all of them."""
    for batch in batches:
        kept, out = batch.drop_columns(["parts"]), []
        for parts in batch.column("parts"):
            runs = [[tuple(p.values()) for p in run["paths"]] for run in parts.as_py()]
            out.append([dict(zip(("begin", "end", "cost", "edits"), p)) for p in join_all(runs)])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out, _arrow_paths())], names=[*kept.schema.names, "paths"])


def _join_level(runs: DataFrame, keys: list) -> DataFrame:
    """``runs`` (c, at, faults, initials, paths) put together by ``keys``."""
    parts = F.sort_array(F.collect_list(F.struct("at", "paths", "head", "tail")))
    sums = [F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated", "illegal")]
    grouped = runs.groupBy(*keys).agg(F.min("at").alias("at"), parts.alias("parts"), *sums)
    inner = F.aggregate(
        F.zip_with(F.slice("parts", 1, F.size("parts") - 1), F.slice("parts", 2, F.size("parts")), lambda a, b: _illegal(F.concat(a["tail"], b["head"]))),
        F.lit(0).cast("long"), lambda n, x: n + x)
    grouped = grouped.withColumn("illegal", F.col("illegal") + F.when(F.size("parts") > 1, inner).otherwise(0))
    cut = grouped.select("c", "at", "blank", "duplicate", "truncated", "illegal", F.col("parts")[0]["head"].alias("head"),
                         F.element_at("parts", -1)["tail"].alias("tail"), F.transform("parts", lambda p: F.struct(p["paths"].alias("paths"))).alias("parts"))
    schema = T.StructType([f for f in cut.schema.fields if f.name != "parts"]).add("paths", _PATHS)
    return cut.mapInArrow(_joined, schema)


def _illegal(pair: Column) -> Column:
    return F.when(pair.isin("su", "ua", "au"), 0).otherwise(1).cast("long")


def plans(rows: DataFrame) -> DataFrame:
    """(c, blank, duplicate, truncated, illegal, cost, audit) of each conversation of the stored rows."""
    place = F.struct("at", "letter", "initial")
    runs = _letters(rows).groupBy("c", F.shiftright("at", RUN_BITS).alias("run")).agg(
        F.min("at").alias("at"), F.sort_array(F.collect_list(place)).alias("rows"))
    letters = F.array_join(F.transform("rows", lambda r: r["letter"]), "")
    roles = F.array_join(F.transform("rows", lambda r: r["initial"]), "")
    runs = runs.select("c", "at", letters.alias("letters"), roles.alias("roles"))
    pairs = F.when(F.length("roles") > 1, F.transform(F.sequence(F.lit(1), F.length("roles") - 1), lambda i: _illegal(F.substr("roles", i, F.lit(2)))))
    count = lambda signs: (F.length("letters") - F.length(F.translate("letters", signs, ""))).cast("long")
    runs = runs.select(
        "c", "at", "letters", count(BLANK).alias("blank"), count(DUPLICATE).alias("duplicate"), count("SUAO").alias("truncated"),
        F.coalesce(F.aggregate(pairs, F.lit(0).cast("long"), lambda n, x: n + x), F.lit(0)).alias("illegal"),
        F.substring("roles", 1, 1).alias("head"), F.substring("roles", -1, 1).alias("tail"))
    schema = T.StructType([f for f in runs.schema.fields if f.name != "letters"]).add("paths", _PATHS)
    searched = runs.mapInArrow(_searched, schema)
    whole = _join_level(_join_level(searched, ["c", F.shiftright("at", RUN_BITS + JOIN_BITS)]), ["c"])
    # a conversation begins with no role and ends with none or with the assistant
    ends = F.filter("paths", lambda p: (p["begin"] == "0") & p["end"].isin("0", "a"))
    best = F.array_min(F.transform(ends, lambda p: F.struct(p["cost"].alias("cost"), p["edits"].alias("audit"))))
    return whole.select("c", "blank", "duplicate", "truncated", "illegal", best["cost"].alias("cost"), best["audit"].alias("audit"))


class _Repair:
    """One conversation while its rows stream past."""

    def __init__(self, audit: str):
        self.edits, self.last, self.at = audit, "0", 0

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.edits[self.at:self.at + 1] == "I":
            self.at += 1
            self.last = GIVEN[self.last]
            yield "I", NAMES[self.last], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """The turns up to and with this row, each with its edit."""
        yield from self.inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "K":
            self.last = role[0]
            yield edit, role, text
        elif edit == "R":
            self.last = GIVEN[self.last]
            yield edit, NAMES[self.last], text


def _streamed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Plans and rows of a conversation together and in order: the plan, then its rows."""
    both = plan.select("c", F.lit(-1).cast("long").alias("at"), F.col("audit").alias("r"), F.lit(None).cast("string").alias("x")).unionByName(
        rows.select("c", "at", "r", "x"))
    return both.repartition("c").sortWithinPartitions(F.col("c").asc_nulls_first(), "at")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, digest, who, empty = None, None, None, True
    done: list[tuple] = []

    def add(turns):
        nonlocal empty
        for _, role, text in turns:
            digest.update(f"{role}:{text}".encode() if empty else f"\n{role}:{text}".encode())
            empty = False

    def close():
        if now is not None:
            add(now.inserted())
            done.append((who, digest.hexdigest()))

    kind = None
    for batch in batches:
        kind = batch.schema.field("c").type
        for who_next, at, r, x in zip(*(batch.column(n).to_pylist() for n in ("c", "at", "r", "x"))):
            if at == -1:
                close()
                now, digest, who, empty = _Repair(r), hashlib.sha256(), who_next, True
            else:
                add(now.row(r, x))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done])], names=["c", "repaired_sha256"])
            done.clear()
    close()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done])], names=["c", "repaired_sha256"])


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, who, n = None, None, 0
    out: list[tuple] = []

    def add(turns):
        nonlocal n
        for edit, role, text in turns:
            n += 1
            out.append((who, n, role, text, edit))

    kind = None
    for batch in batches:
        kind = batch.schema.field("c").type
        for who_next, at, r, x in zip(*(batch.column(c).to_pylist() for c in ("c", "at", "r", "x"))):
            if at == -1:
                if now is not None:
                    add(now.inserted())
                now, who, n = _Repair(r), who_next, 0
            else:
                add(now.row(r, x))
        yield _turns(out, kind)
        out.clear()
    if now is not None:
        add(now.inserted())
        yield _turns(out, kind)


def _turns(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*out)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.string(), pa.string(), pa.string()))],
                                      names=["c", "n", "role", "text", "edit"])


def repair(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations: (conversation, n, role, text, edit), n from 1; edit tells kept (K), reroled (R) and inserted (I) turns."""
    rows = _in_order(df, conversation, turn, role, text)
    plan = common.stored(plans(rows), "plans")
    schema = T.StructType([T.StructField("c", rows.schema["c"].dataType), T.StructField("n", T.LongType()), T.StructField("role", T.StringType()),
                           T.StructField("text", T.StringType()), T.StructField("edit", T.StringType())])
    return _streamed(rows, plan).mapInArrow(_written, schema).withColumnRenamed("c", conversation)


def report(df: DataFrame, all_of: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation of ``all_of``: gaps, faults, the cheapest edits of its rows in ``df``, and a digest of what they leave.

    Conversations without rows in ``df`` have zeros, no edits and the digest of nothing.
    """
    rows = _in_order(df, conversation, turn, role, text)
    plan = common.stored(plans(rows), "plans")
    schema = T.StructType([T.StructField("c", rows.schema["c"].dataType), T.StructField("repaired_sha256", T.StringType())])
    digests = _streamed(rows, plan).mapInArrow(_digested, schema)
    turns = rows.groupBy("c", "t").agg(F.lit(1).alias("one")).groupBy("c").agg(
        F.coalesce(F.max("t") - F.min("t") + 1 - F.count("t"), F.lit(0)).alias("gaps"))
    every = all_of.select(common.col(conversation).alias("c")).distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    # one row a conversation on every side: put together by an aggregate, in which null ids meet too
    wide = every.select("c", *[F.lit(None).cast("long").alias(n) for n in counts], F.lit(None).cast("string").alias("audit"),
                        F.lit(None).cast("string").alias("repaired_sha256"), F.lit(True).alias("asked"))
    for part in (plan, turns, digests):
        wide = wide.unionByName(part, allowMissingColumns=True)
    out = wide.groupBy("c").agg(*[F.coalesce(F.max(n), F.lit(0)).alias(n) for n in counts], F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
                                F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"), F.max("asked").alias("asked"))
    return out.filter("asked").select(F.col("c").alias(conversation), *counts, "audit", "repaired_sha256")
