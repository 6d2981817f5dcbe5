"""Fill-in-the-middle: units, forms, piece tables, the way back."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from crivo.llm import fim

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def plain_way(doc_id, text, rate=90, spm_rate=20, seed=1):
    """What the operator must give, by strings."""
    text = text or ""
    units = UNIT.findall(text)
    n, h = len(units), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not n or h3 % 100 >= rate or any(s in text for s in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


HARD = ["", "a", "é", "ab1cd", "日本語 text\n\nmore", "<P", "x<S>y", "<", "<M", ">P>S>M>", "a" * 100_000, " " * 1000, "😀a😀b",
        "\x00\x01", "ß<", "Z[`{@A", "word " * 30_000]


def test_units_are_those_of_the_pattern():
    for text in HARD:
        bounds = fim.unit_bounds(np.frombuffer(text.encode(), np.uint8))
        starts, at = [], 0
        for u in UNIT.findall(text):
            starts.append(at)
            at += len(u.encode())
        assert bounds.tolist() == starts + [at]


def test_tables_cut_anywhere_and_go_back():
    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choice("ab é<P>S") for _ in range(r.randrange(12))).encode()
        places = sorted(r.randrange(len(text) + 1) for _ in range(2))
        table = fim.PieceTable(memoryview(text)).cut(*places)
        assert [bytes(table.buffers[b][s:s + n]) for b, s, n in table.pieces] == [text[:places[0]], text[places[0]:places[1]], text[places[1]:]]
        for form in fim.ARRANGEMENTS:
            out = table.arranged(form)
            assert out.original(form).text() == text
            assert out.sha256() == hashlib.sha256(out.text()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(5)
    rows = [(i, t) for i, t in enumerate(HARD)] + [(7, "same id, other text"), (7, "same id, other text"), (None, "no id"), (None, None), (99, None)]
    rows += [(1000 + i, "".join(r.choice(["word", " ", "é", "<", "P>", ".", "Ab"]) for _ in range(r.randrange(30)))) for i in range(300)]
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
    extra = [T.StructField(c, T.StringType()) for c in ("form", "units", "output", "digest_", "form_")]
    return spark.createDataFrame([(*x, "f", "u", "o", "d", "g") for x in rows], T.StructType(fields + extra)).repartition(4)


def test_forms_of_hard_texts(docs):
    out = fim.transform(docs)
    assert out.columns[:6] == ["doc_id", "form", "units", "output", "digest_", "form_"]
    names = out.columns[6:]
    got = [(r["doc_id"], *(r[n] for n in names)) for r in out.collect()]
    want = []
    for r in docs.collect():
        n, form, p, m, shown = plain_way(r.doc_id, r.text)
        want.append((r.doc_id, n, form, p, m, shown, hashlib.sha256(shown.encode()).hexdigest()))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    assert all(r["form"] == "f" and r["output"] == "o" for r in out.collect())


def test_texts_come_back(docs):
    made = fim.transform(docs.select("doc_id", "text"))
    back = fim.restore(made)
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=repr) == sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=repr)
    digests = fim.restore(made, digest_only=True)
    assert "text" not in digests.columns and sorted(r.text_sha256 for r in digests.collect()) == sorted(r.text_sha256 for r in back.collect())


def test_no_rows(docs):
    assert fim.restore(fim.transform(docs.select("doc_id", "text").filter("false"))).collect() == []
