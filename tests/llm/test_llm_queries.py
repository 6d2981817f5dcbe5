"""The registered queries: against their SQL where there is some, else against brute force on whole small tables."""

import base64
import collections
import hashlib
import zlib

import numpy as np
import oracle
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken

from crivo.llm.queries import ORACLE, QUERIES
from crivo.llm.simhash import fingerprint


@pytest.fixture(scope="module")
def docs(sf):
    return pq.read_table(f"{sf}/documents.parquet").to_pandas()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline") == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, sf, name):
    assert oracle.compare(spark, con, QUERIES[name], ORACLE[name], sf) is None


def test_op1_leaves_no_private_data(spark, sf, docs):
    from crivo.llm import pii

    out = {r.doc_id: r for r in QUERIES["op1_pii_surrogates"](spark, sf).collect()}
    assert len(out) == len(docs)
    for i, text in zip(docs.doc_id, docs.text):
        found = pii.detect(text)
        assert out[i].n_replaced == len(found)
        assert all(text[s:e] not in out[i].text for s, e, _, _ in found)
        assert found or out[i].text == text


def test_op2_is_what_the_library_gives(spark, sf, docs):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = {r.doc_id: r for r in QUERIES["op2_byte_bpe"](spark, sf).collect()}
    for i, text in zip(docs.doc_id, docs.text):
        ids = enc.encode_ordinary(text or "")
        assert (out[i].n_tokens, out[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert out[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_op3_tells_held_out_documents_apart(spark, sf):
    sf = sf.replace("0.001", "0.01")
    labels = pq.read_table(f"{sf}/labels.parquet").to_pandas().set_index("doc_id").quality
    rows = QUERIES["op3_quality_rules"](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels.index]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.93


def test_op4_is_what_all_pairs_give(spark, sf, docs):
    prints = np.array([fingerprint(t) for t in docs.text], np.uint64)
    least = docs.doc_id.to_numpy().copy()
    while True:
        before = least.copy()
        for i in range(len(prints)):
            near = np.bitwise_count(prints ^ prints[i]) <= 2
            least[near] = least[near].min()
        if (before == least).all():
            break
    want = {i: (f"{p:016x}", c) for i, p, c in zip(docs.doc_id, prints, least)}
    got = QUERIES["op4_simhash_trie"](spark, sf).collect()
    assert len(got) == len(docs) and {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want


def test_op5_is_what_all_windows_give(spark, sf, docs):
    words = {i: (t or "").encode().split() for i, t in zip(docs.doc_id, docs.text)}
    windows = collections.Counter(tuple(w[k:k + 35]) for w in words.values() for k in range(len(w) - 34))
    got = {r.doc_id: r for r in QUERIES["op5_cover_anchors"](spark, sf).collect()}
    assert len(got) == len(docs)
    for i, w in words.items():
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 34):
            if windows[tuple(w[k:k + 35])] > 1:
                gone[k:k + 35] = True
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), gone.sum(), hashlib.sha256(kept).hexdigest())


def test_op6_gives_the_article(spark, sf):
    import html
    import re

    for r in QUERIES["op6_html_blocks"](spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1|br)>", article))
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_op8_finds_the_nearest(spark, sf):
    t = pq.read_table(f"{sf}/embeddings.parquet").to_pandas()
    unit = np.array(t.embedding.tolist(), float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    got = collections.defaultdict(list)
    for r in sorted(QUERIES["op8_pruned_graph"](spark, sf).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r)
    hit = total = 0
    for q in np.flatnonzero(t.vec_id % 50 == 0):
        near = unit @ unit[q]
        near[q] = -9
        want = set(t.vec_id.iloc[np.argsort(-near, kind="stable")[:5]])
        mine = got[t.vec_id[q]]
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5] and t.vec_id[q] not in {r.vec_id for r in mine}
        hit, total = hit + len(want & {r.vec_id for r in mine}), total + 5
    assert hit >= 0.9 * total


def test_pipeline(spark, sf, docs):
    rows = QUERIES["pipeline"](spark, sf).collect()
    assert rows and {r.doc_id for r in rows} <= set(docs.doc_id)
    assert all(r.n_tokens == len(r.ids) for r in rows)
