"""License scan: base places, rules against a plain version, suppression, edges."""

import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crivo.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_scan(text):
    """(n_words, n_base, first, last, base labels, labels, score) by loops over words and intervals."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    places = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    spaced = " " + "  ".join(words) + " " if words else ""
    starts, at = {}, 0
    for i, w in enumerate(words):
        starts[at] = i
        at += len(w) + 2
    found = []
    for n, (priority, label, key, pattern) in enumerate(licenses.rules()):
        if set(key.split("|")) & set(words):
            for m in re.finditer(pattern, spaced, re.A):
                start = starts[m.start()]
                stop = starts.get(m.end(), len(words))
                found.append((start, -stop, priority, n, stop, label))
    kept, held = [], None
    for d in sorted(found):
        if held and d[0] < held[4]:
            if d[4] > held[4] and d[2] < held[2]:
                held = d
            continue
        kept += [held] if held else []
        held = d
    kept += [held] if held else []
    kept = [d for d in kept if d[5]]
    base = sorted({label for _, label in places})
    score = max([0.0] + [licenses.SCORES[d[2]] for d in kept] + [licenses.BASE_SCORE] * bool(places))
    return (len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), base,
            sorted(set(base) | {d[5] for d in kept}), score)


TEXTS = [
    None, "", " \n", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0 (the License)", "Licensed under CC BY-NC 4.0.",
    "under the mit license under the mit license", "UNDER THE MİT LICENSE", "under the mité license", "Under\x00the—MIT license", "cc by nc cc by nc-sa cc-by-nc",
    "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: Apache-2.0", "GNU General Public License v3.0 or later", "the gnu lesser general public license version 2.1",
    "This is not licensed under the MIT License.", "It is not released under the GPL v3, but under the BSD 3-Clause License", "bring your driver's licence", "GPL compatible",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License", "Copyright (c) 2019 A. All rights reserved.",
    "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0", "https://www.apache.org/licenses/LICENSE-2.0",
    "licensed under the unlicense", "do what the fuck you want to public license", "neither the name of the copyright holder nor the names of its contributors may be used to endorse",
    "apache license version 2 0 apache license version 1 1 apache license", "dual-licensed: MIT license / Apache-2.0", "ms windows items", "日本語 under the mit license 日本語",
]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(8)
    parts = [t for t in TEXTS if t] + ["the", "license", "gpl", "and", "under", "mit", "or later", "v2", "public", "."]
    texts = TEXTS + [" ".join(r.choice(parts) for _ in range(r.randrange(1, 25))) for _ in range(150)]
    texts += ["Released under the MIT License. " * 3000, "x" * 100_000]
    rows = [(i % 170, t, "w", "l", "s") for i, t in enumerate(texts)] + [(3, TEXTS[3], "w", "l", "s")] * 2 + [(None, "gpl v3", "w", "l", "s")]
    schema = T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(c, T.StringType()) for c in ("text", "n_words", "labels", "spaced_words_")])
    return spark.createDataFrame(rows, schema).repartition(4)


def test_scan_is_what_loops_give(docs):
    out, name = licenses.scan(docs)
    wanted = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert [name[w] for w in wanted[:2]] == ["n_words_", "n_base"]
    for r in out.collect():
        assert tuple(r[name[w]] for w in wanted) == plain_scan(r.text), r.text
        assert (r.n_words, r.labels, r.spaced_words_) == ("w", "l", "s")
    assert out.count() == docs.count()


def labels_of(spark, text):
    out, name = licenses.scan(spark.createDataFrame([(text,)], "text string"))
    return out.first()[name["labels"]]


def test_suppression(spark):
    assert labels_of(spark, "This is not licensed under the terms of the zlib license") == []
    assert labels_of(spark, "GNU General Public License v2 or any later version") == ["gpl-2-or-later"]
    assert labels_of(spark, "not released under the mit license") == ["mit"]  # a base phrase is never suppressed
    assert labels_of(spark, "CC BY-NC-SA 4.0") == ["cc-by-nc", "cc-by-nc-sa"]


def test_rules_are_many_and_gated():
    keys = licenses.keywords()
    assert len(licenses.rules()) > 300 and len(keys) < 130
    assert {w for phrase, _ in licenses.BASE for w in phrase.split()} & set(keys) >= {"mit", "apache", "cc"}


def test_keywords_stand_in_every_match():
    """What a rule finds in texts made of its own words holds a word of its keyword."""
    r = random.Random(6)
    for _, _, key, pattern in licenses.rules():
        words = re.findall(r"[a-z0-9]+", re.sub(r"\[cs\]", "c", pattern)) + ["licence", "license", "x"]
        text = " " + "  ".join(r.choice(words) for _ in range(3000)) + " "
        for m in list(re.finditer(pattern, text))[:50]:
            assert set(key.split("|")) & set(m.group().split()), (pattern, m.group())


def test_no_python_on_the_way_and_no_rows(docs):
    out, _ = licenses.scan(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.split("Scan")[0].replace("Exchange RoundRobinPartitioning", "")
    assert licenses.scan(docs.filter(F.lit(False)))[0].collect() == []
