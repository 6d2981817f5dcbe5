"""Conversation repair: the search against dynamic programming, cuts anywhere, whole conversations against a plain version."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import types as T

from crivo.llm import repair

INSERTS = {("0", "u"): "I", ("0", "a"): "II", ("s", "u"): "I", ("s", "a"): "II", ("u", "a"): "I", ("a", "u"): "I"}


def cheapest(letters):
    """(cost, edits) by going through the rows once, keeping the best way to each last role."""
    def better(out, role, way):
        if role not in out or way < out[role]:
            out[role] = way

    def inserted(best):
        out = dict(best)
        for (a, b), edits in INSERTS.items():
            if a in best:
                better(out, b, (best[a][0] + 5 * len(edits), best[a][1] + edits))
        return out

    best = {"0": (0, "")}
    for letter in letters:
        out = {}
        for last, (cost, edits) in inserted(best).items():
            better(out, last, (cost + 2, edits + "D"))
            if letter in "bd":
                continue
            more = 5 if letter.isupper() else 0
            if letter.lower() in repair.NEXT[last]:
                better(out, letter.lower(), (cost + more, edits + "K"))
            better(out, repair.GIVEN[last], (cost + more + 1, edits + "R"))
        best = out
    return min(way for last, way in inserted(best).items() if last in "0a")


def test_search_finds_the_least_of_the_cheapest():
    r = random.Random(1)
    for i in range(1200):
        kinds = "sssuuuuuaaaaaoSUAObd" if i % 2 else "uauauauauauauUAb"
        letters = "".join(r.choice(kinds) for _ in range(r.randrange(9 if i < 1000 else 64)))
        assert repair.search(letters, "0", "0a") == cheapest(letters)


def test_cuts_do_not_matter():
    r = random.Random(2)
    for _ in range(300):
        letters = "".join(r.choice("suuuaaaoSUAbd") for _ in range(r.randrange(1, 30)))
        cuts = [0, *sorted(r.sample(range(1, len(letters)), min(len(letters) - 1, 3))), len(letters)]
        paths = repair.join_all([list(repair.paths_of_run(letters[a:b])) for a, b in zip(cuts, cuts[1:])])
        assert min((c, e) for begin, end, c, e in paths if begin == "0" and end in "0a") == cheapest(letters)


def test_no_way_to_a_system_turn_without_one():
    assert repair.search("ua", "0", "s") is None
    assert repair.search("ub", "0", "0") == (4, "DD")


def plain_report(rows):
    """The columns of the report for rows (turn, role, text) in order."""
    seen, letters, counts = set(), "", collections.Counter()
    for _, role, text in rows:
        words = text.split(" ") if text is None else None
        solid = [c for c in text if c not in " \t\n\x0b\x0c\r"]
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        if not solid:
            letter, fault = "b", "blank"
        elif (role, text) in seen:
            letter, fault = "d", "duplicate"
        elif solid[-1] not in ".!?":
            letter, fault = initial.upper(), "truncated"
        else:
            letter, fault = initial, None
        assert words is None
        seen.add((role, text))
        letters += letter
        counts[fault] += 1
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = cheapest(letters)
    lines, last, left = [], "0", list(rows)
    for edit in audit:
        if edit == "I":
            last = repair.GIVEN[last]
            lines.append((repair.NAMES[last], ""))
            continue
        _, role, text = left.pop(0)
        if edit == "K":
            last = role[0]
            lines.append((role, text))
        elif edit == "R":
            last = repair.GIVEN[last]
            lines.append((repair.NAMES[last], text))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest, lines


SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                       T.StructField("text", T.StringType()), T.StructField("c", T.StringType()), T.StructField("at", T.StringType())])


@pytest.fixture(scope="module")
def talks(spark):
    r = random.Random(4)
    rows = [(1, None, "user", "Hi."), (1, None, "user", "Hi."), (1, None, None, "what?"), (2, 0, None, None), (None, 0, "user", "no id."), (None, 1, "assistant", "none."),
            (3, 5, "system", "Be kind."), (3, 9, "assistant", "Yes!"), (4, 0, "user", "x" * 100_000), (4, 1, "assistant", "ends with a line.\n"), (5, 0, "", "no role."),
            (6, 0, "user", "odd end. "), (7, 0, "user", " \t\n"), (8, 0, "aide", "Hello. "), (8, 1, "umpire", "Out!")]
    for conv in range(20, 60):
        for turn in range(r.randrange(1, 7)):
            rows.append((conv, turn if r.random() < 0.9 else None, r.choice(["user", "assistant", "system", "tool", "user"]),
                         r.choice(["Yes.", "No!", "So", "", "Why?", "And then it was told at length, and", "Once more."])))
    # one conversation of most rows, with many ties and repeats
    rows += [(77, i // 3, r.choice(["user", "assistant"]), r.choice(["Yes.", "No!", f"line {i}.", f"cut {i}"])) for i in range(1500)]
    return spark.createDataFrame([(*x, "c", "at") for x in rows], SCHEMA).repartition(5)


def test_report_and_repair(talks):
    def spaced(x):
        return " " if x is None else x

    conversations = collections.defaultdict(list)
    for r in talks.collect():
        role, text = spaced(r.role), spaced(r.text)
        digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
        conversations[r.conv_id].append(((r.turn is not None, r.turn or 0), digest, (r.turn, role, text)))
    want = {c: plain_report([x[2] for x in sorted(rows, key=lambda x: x[:2])]) for c, rows in conversations.items()}
    got = {r[0]: tuple(r)[1:] for r in repair.report(talks, talks).collect()}
    assert got == {c: w[:8] for c, w in want.items()}
    made = collections.defaultdict(list)
    for r in repair.repair(talks).collect():
        made[r.conv_id].append((r.n, r.role, r.text))
    assert {c: [(a, b) for _, a, b in sorted(x)] for c, x in made.items()} == {c: w[8] for c, w in want.items() if w[8]}


def test_conversations_that_lost_all_rows(spark, talks):
    lost = repair.report(talks.filter("conv_id = 3"), talks.filter("conv_id in (2, 3) or conv_id is null")).collect()
    by_id = {r.conv_id: tuple(r)[1:] for r in lost}
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert by_id[2] == by_id[None] == empty and by_id[3] != empty and len(by_id) == 3
    assert repair.report(talks.filter("false"), talks.filter("false")).collect() == []
    assert repair.repair(talks.filter("false")).collect() == []
