"""Each stage of the pipeline against a plain version over the rows it was given."""

import base64
import collections
import hashlib
import math

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from crivo.llm import common, pii, quality
from crivo.llm.simhash import fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, sf):
    """Name of the stage -> rows it was given; ``end`` -> the last one's result."""
    docs, out = common.read(spark, sf, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = docs.collect()
        docs = common.stored(stage(spark, docs, sf), name)
        assert name == "bpe" or docs.columns == COLUMNS
    out["end"] = docs.collect()
    return out


def after(tables, name):
    names = [*[n for n, _ in corpus_pipeline.STAGES], "end"]
    return tables[name], tables[names[names.index(name) + 1]]


def plain_statistics(text):
    words, lines, n = text.encode().split(), text.split("\n"), len(text)
    share = lambda p: 1 - len(regex.sub(p, "", text)) / n if n else 0.0
    return {
        "log_words": math.log1p(len(words)), "word_length": n / len(words) if words else 0.0,
        "distinct_words": len(set(words)) / len(words) if words else 0.0,
        "distinct_lines": len(set(lines)) / len(lines) if n else 0.0, "words_a_line": len(words) / len(lines),
        "capitals": share(r"\p{Lu}"), "digits": share("[0-9]"), "stops": share("[.,;:?]"), "shouts": share("[!¡]"),
        "bars": share(r"[|/\\\[\]{}<>()_=~^]"), "signs": share("[#$%&*@+]"), "spaces": share("[ \t\n\x0b\f\r]"),
    }


def test_quality(spark, sf, tables):
    given, kept = after(tables, "quality")
    labels = common.read(spark, sf, "labels").filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    model = quality.fit(common.read(spark, sf, "documents"), labels)
    want = []
    for r in given:
        stats = plain_statistics(r.text or "")
        odds = model.base + sum(w for rule, w in model.rules if all(
            (low is None or stats[n] > low) and (high is None or stats[n] <= high) for n, low, high in rule.bounds))
        if 1 / (1 + math.exp(-odds)) >= corpus_pipeline.LEAST_QUALITY:
            want.append(r)
    assert sorted(want) == sorted(kept) and 0.5 * len(given) < len(kept) < len(given)


def test_near_dedup(tables):
    given, kept = after(tables, "near_dedup")
    prints = np.array([fingerprint(r.text) for r in given], np.uint64)
    group = np.arange(len(given))
    while True:
        before = group.copy()
        for i in range(len(prints)):
            near = np.bitwise_count(prints ^ prints[i]) <= 2
            group[near] = group[near].min()
        if (before == group).all():
            break
    first = {}
    for r, g in zip(given, group):
        first[g] = min(first.get(g, r), r, key=lambda x: x.doc_id)
    assert sorted(kept) == sorted(first.values())


def test_pii(tables):
    given, changed = after(tables, "pii")
    new, names = {r.doc_id: r for r in changed}, collections.defaultdict(set)
    assert len(changed) == len(given)
    for r in given:
        text, at = new[r.doc_id].text, 0
        for s, e, kind, norm in pii.detect(r.text):
            between = r.text[at:s] if not at else r.text[at:s]
            assert r.text[s:e] not in text and between in text
            at = e
            names[kind, norm].add(r.text[s:e])
        assert (text == r.text) == (at == 0) and new[r.doc_id].n_chars == len(text)
    assert names
    left = {(k, n) for r in changed for _, _, k, n in pii.detect(r.text)}
    assert not left & set(names) and len(left) >= 0.95 * len(names)


def test_mix(tables):
    given, mixed = after(tables, "mix")
    size = lambda r: len((r.text or "").encode().split())
    sizes = collections.Counter()
    for r in given:
        sizes[r.source] += size(r)
    order = sorted(sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    left, open_, target = sum(sizes.values()), set(order), {}
    while True:
        part = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if part * weight[s] >= 3 * sizes[s]}
        if not full:
            break
        target.update({s: 3 * sizes[s] for s in full})
        left, open_ = left - sum(3 * sizes[s] for s in full), open_ - full
    target.update({s: part * weight[s] for s in open_})
    want = collections.Counter()
    for s in order:
        rows = sorted((r for r in given if r.source == s), key=lambda r: (size(r), hashlib.md5(str(r.doc_id).encode()).hexdigest()))
        moved = int(hashlib.md5(f"1:{s}".encode()).hexdigest()[:5], 16) / 2**20
        each = target[s] / sizes[s]
        for n, r in enumerate(rows, 1):
            want[r] = min(3, math.floor(each * n + moved) - math.floor(each * (n - 1) + moved))
    assert collections.Counter(mixed) == +want


def test_bpe(tables):
    given, end = after(tables, "bpe")
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter((r.doc_id, tuple(enc.encode_ordinary(r.text or ""))) for r in given)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in end) == want
    assert all(r.n_tokens == len(r.ids) for r in end)
