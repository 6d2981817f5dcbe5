"""One query per operator, over the whole of its table."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, fim, graph, hamming, html, licenses, mixing, pii, quality, repair, simhash, substring
from .common import read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


#: For these queries alone; a real corpus takes a key of its own.
PII_KEY = b"surrogates of the registered queries"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace(docs, PII_KEY, count="n_replaced")


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    labels = read(spark, sf_dir, "labels").filter(~held_out)
    model = quality.fit(docs, labels)
    return model.score(docs).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op4_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op5_cover_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    cut = substring.repeated_passages(docs).select(
        "k", F.col("id").alias("id_"), F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]).alias("removed"),
        F.sha2("kept", 256).alias("kept_sha256"))
    same = F.col("id").eqNullSafe(F.col("id_"))
    return substring.whole_words(docs).join(cut.withColumnRenamed("k", "k_"), (F.col("k") == F.col("k_")) & same, "left").select(
        F.col("id").alias("doc_id"), "n_words", F.coalesce("removed", F.lit(0)).alias("n_removed"),
        F.coalesce("kept_sha256", "words_sha256").alias("kept_sha256"))


@query
def op6_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract(pages, html.fit(spark)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op7_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return hamming.nearest_codes(vectors, hamming.sign_code(F.col("embedding"))).withColumnRenamed("score", "distance")


ORACLE["op7_hamming_topk"] = """
    WITH codes AS (
        SELECT vec_id, list_reduce(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN 1::UBIGINT << (i - 1) ELSE 0::UBIGINT END), lambda a, b: a | b) AS code
        FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL)) = 0 AND vec_id IS NOT NULL),
    near AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(bit_count(xor(q.code, c.code)) AS BIGINT) AS distance,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY bit_count(xor(q.code, c.code)), c.vec_id) AS rank
        FROM codes q JOIN codes c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance FROM near WHERE rank <= 10"""


@query
def op8_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nearest(read(spark, sf_dir, "embeddings"))


@query
def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, name = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    size = F.col(name["size"])
    return out.select("doc_id", size.alias("size"), F.col(name["source_size"]).alias("source_size"),
                      F.col(name["target"]).alias("target"), (size * F.col(name["copies"])).alias("taken"))


ORACLE["op9_source_mix"] = r"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(3 * sum(size) AS BIGINT) AS most FROM d GROUP BY source),
    w AS (SELECT *, [1, 2, 3][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight FROM s),
    l AS (SELECT *, sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source IS NULL, source
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                 sum(weight) OVER (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM w),
    f AS (SELECT *, CAST(rest * weight AS DOUBLE) / weights >= most AS at_most FROM l),
    first AS (SELECT rest AS first_rest, weights AS first_weights FROM f WHERE NOT at_most ORDER BY most / weight, source IS NULL, source LIMIT 1),
    goals AS (SELECT source, source_size,
                     CASE WHEN at_most THEN CAST(most AS DOUBLE) ELSE CAST(first_rest * weight AS DOUBLE) / first_weights END AS target,
                     CAST(('0x' || substr(md5('1:' || coalesce(source, chr(0))), 1, 5)) AS INTEGER) / 1048576.0 AS moved
              FROM f LEFT JOIN first ON true),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, md5(coalesce(CAST(doc_id AS VARCHAR), ''))) AS n FROM d),
    each AS (SELECT r.doc_id, r.size, g.source_size, g.target, r.n, g.moved, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS times
             FROM ranked r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source)
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
           CAST(size * least(floor(times * n + moved) - floor(times * (n - 1) + moved), 3) AS BIGINT) AS taken FROM each"""


@query
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    return chat.digests(chat.format_conversations(rows))


ORACLE["op10_chat_format"] = r"""
    WITH said AS (
        SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
    shown AS (
        SELECT *, regexp_replace(regexp_replace(x, '<(\\*)/turn>', '<\\\1/turn>', 'g'), '(\\*)###', '\\\1###', 'g') AS text_shown,
               regexp_replace(regexp_replace(regexp_replace(r, '<(\\*)/turn>', '<\\\1/turn>', 'g'), '(\\*)###', '\\\1###', 'g'), ':(\\*) ', ':\\\1 ', 'g') AS role_shown
        FROM said)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256,
           CAST(sum(CASE WHEN r = 'assistant' THEN length(x) ELSE 0 END) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (r = 'assistant'), '')) AS loss_sha256,
           CAST(sum(4 + length(role_shown) + 2 + length(text_shown) + 8) AS BIGINT) AS formatted_chars
    FROM shown GROUP BY conv_id"""


@query
def op11_fim_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(read(spark, sf_dir, "documents").select("doc_id", "text"))
    made = made.select("doc_id", F.col("units").alias("n"), "form", "prefix_chars", "middle_chars", "output_sha256", "output", F.col("form").alias("by"))
    return fim.restore(made, form="by", digest_only=True).withColumnRenamed("text_sha256", "restored_sha256").drop("by")


ORACLE["op11_fim_pieces"] = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                      sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    drawn AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) AS h1, CAST(('0x' || substr(h, 9, 8)) AS BIGINT) AS h2,
                     CAST(('0x' || substr(h, 17, 8)) AS BIGINT) AS h3, CAST(('0x' || substr(h, 25, 8)) AS BIGINT) AS h4 FROM d),
    cut AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                   CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                        WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
    parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cut),
    shown AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                             ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS output FROM parts),
    back AS (SELECT *, string_split_regex(output, '<P>|<S>|<M>') AS x FROM shown)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
           sha256(output) AS output_sha256,
           sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN x[2] || x[4] || x[3] ELSE x[3] || x[4] || x[2] END) AS restored_sha256 FROM back"""


@query
def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.report(repair.damaged(rows), rows)


ORACLE["op12_turn_repair"] = r"""
    WITH RECURSIVE given AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x,
               xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: ord(c)::BIGINT),
                   lambda crc, c: list_reduce(range(8), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(crc, c)), 4294967295::BIGINT),
                   4294967295::BIGINT) % 20 AS kind FROM conversations),
    rows AS (
        SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE r END AS r, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(x, '[.!?]', '', 'g') ELSE x END AS x
        FROM (SELECT *, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) FROM given WHERE kind <> 0)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(r) || ':' || r || x)) AS pos FROM rows),
    fault AS (
        SELECT *, left(r, 1) AS i, CASE WHEN NOT regexp_matches(x, '[^\x20\x09-\x0D]') THEN 'b'
                                        WHEN row_number() OVER (PARTITION BY conv_id, r, x ORDER BY pos) > 1 THEN 'd'
                                        WHEN NOT regexp_matches(x, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS f FROM placed),
    pairs AS (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i AS pair FROM fault),
    counted AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank,
               count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
               count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM pairs GROUP BY conv_id),
    ins(s, t, more, edits, lines) AS (VALUES ('0', '0', 0, '', []::VARCHAR[]), ('s', 's', 0, '', []), ('u', 'u', 0, '', []), ('a', 'a', 0, '', []), ('0', 'u', 5, 'I', ['user:']),
        ('0', 'a', 10, 'II', ['user:', 'assistant:']), ('s', 'u', 5, 'I', ['user:']), ('s', 'a', 10, 'II', ['user:', 'assistant:']),
        ('u', 'a', 5, 'I', ['assistant:']), ('a', 'u', 5, 'I', ['user:'])),
    target(s, t) AS (VALUES ('0', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
    walk AS (
        SELECT conv_id, 0::BIGINT AS pos, '0' AS s, {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]} AS best FROM counted
        UNION ALL
        SELECT conv_id, pos, s, min({'cost': cost, 'audit': audit, 'lines': lines}) FROM (
            SELECT w.conv_id, f.pos, unnest([
                {'s': i.t, 'cost': w.best.cost + i.more + 2, 'audit': w.best.audit || i.edits || 'D', 'lines': w.best.lines || i.lines},
                CASE WHEN f.f NOT IN ('b', 'd') AND ((f.i = 's' AND i.t = '0') OR (f.i = g.t))
                     THEN {'s': f.i, 'cost': w.best.cost + i.more + CASE f.f WHEN 't' THEN 5 ELSE 0 END, 'audit': w.best.audit || i.edits || 'K',
                           'lines': w.best.lines || i.lines || [f.r || ':' || f.x]} END,
                CASE WHEN f.f NOT IN ('b', 'd')
                     THEN {'s': g.t, 'cost': w.best.cost + i.more + 1 + CASE f.f WHEN 't' THEN 5 ELSE 0 END, 'audit': w.best.audit || i.edits || 'R',
                           'lines': w.best.lines || i.lines || [CASE g.t WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.x]} END], recursive := true)
            FROM walk w JOIN fault f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos + 1 JOIN ins i ON i.s = w.s JOIN target g ON g.s = i.t)
        WHERE s IS NOT NULL GROUP BY conv_id, pos, s),
    ended AS (
        SELECT c.conv_id, min({'cost': w.best.cost + i.more, 'audit': w.best.audit || i.edits, 'lines': w.best.lines || i.lines}) AS best
        FROM counted c JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.pos = c.n JOIN ins i ON i.s = w.s AND i.t IN ('0', 'a') GROUP BY c.conv_id)
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, CAST(coalesce(e.best.cost, 0) AS BIGINT) AS cost, coalesce(e.best.audit, '') AS audit,
           sha256(coalesce(array_to_string(e.best.lines, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
         LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""


@query
def op13_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, name = licenses.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    text = lambda n: F.array_join(F.col(name[n]), ",").alias(n)
    return out.select("doc_id", *[F.col(name[n]).alias(n) for n in ("n_words", "n_base", "first_word", "last_word")],
                      text("base_labels"), text("labels"), F.col(name["score"]).alias("score"))


def _quoted(value) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def _values(rows) -> str:
    return ",\n        ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in rows)


ORACLE["op13_license_rules"] = rf"""
    WITH RECURSIVE rules(rule, priority, label, keyword, pattern) AS (VALUES
        {_values((i, *r) for i, r in enumerate(licenses.rules()))}),
    phrases(phrase, label) AS (VALUES {_values(licenses.BASE)}),
    scores(priority, score) AS (VALUES {_values(enumerate(licenses.SCORES))}),
    d AS (SELECT row_number() OVER () AS rid, doc_id,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    t AS (SELECT *, CASE WHEN len(w) > 0 THEN ' ' || array_to_string(w, '  ') || ' ' ELSE '' END AS s FROM d),
    spots AS (SELECT rid, p.label, i FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM t) x JOIN (SELECT *, string_split(phrase, ' ') AS ws FROM phrases) p
           ON x.w[i:i + len(p.ws) - 1] = p.ws),
    base AS (SELECT rid, count(*) AS n, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list_sort(list(DISTINCT label)) AS labels FROM spots GROUP BY rid),
    hit AS (SELECT rid, rule, priority, label, string_split(trim(regexp_replace(s, pattern, chr(32) || chr(1) || '\1' || chr(2) || chr(32), 'g'), ' '), '  ') AS m
            FROM t JOIN rules ON list_has_any(w, string_split(keyword, '|')) AND regexp_matches(s, pattern)),
    places AS (SELECT rid, rule, priority, label, list_filter(range(len(m)), lambda i: starts_with(m[i + 1], chr(1))) AS a,
                      list_filter(range(len(m)), lambda i: ends_with(m[i + 1], chr(2))) AS b FROM hit),
    found AS (SELECT rid, rule, priority, label, unnest(a) AS start, unnest(b) + 1 AS stop FROM places),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY start, stop DESC, priority, rule) AS n, count(*) OVER (PARTITION BY rid) AS all_of FROM found),
    walk AS (
        SELECT rid, n, all_of, start, stop, priority, label, [] :: STRUCT(p INTEGER, l VARCHAR)[] AS kept FROM ordered WHERE n = 1
        UNION ALL
        SELECT w.rid, o.n, o.all_of, CASE WHEN x.take THEN o.start ELSE w.start END, CASE WHEN x.take THEN o.stop ELSE w.stop END,
               CASE WHEN x.take THEN o.priority ELSE w.priority END, CASE WHEN x.take THEN o.label ELSE w.label END,
               CASE WHEN o.start >= w.stop THEN w.kept || [{{'p': w.priority, 'l': w.label}}] ELSE w.kept END
        FROM walk w JOIN ordered o ON o.rid = w.rid AND o.n = w.n + 1,
             LATERAL (SELECT o.start >= w.stop OR (o.stop > w.stop AND o.priority < w.priority) AS take) x),
    ended AS (SELECT rid, unnest(kept || [{{'p': priority, 'l': label}}]) AS k FROM walk WHERE n = all_of),
    own AS (SELECT rid, list(DISTINCT k.l) AS labels, max(score) AS score FROM ended JOIN scores ON scores.priority = k.p WHERE k.l <> '' GROUP BY rid)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, b.first_word, b.last_word, coalesce(array_to_string(b.labels, ','), '') AS base_labels,
           coalesce(array_to_string(list_sort(list_distinct(coalesce(b.labels, []) || coalesce(o.labels, []))), ','), '') AS labels,
           CAST(greatest(CASE WHEN b.n > 0 THEN {licenses.BASE_SCORE} ELSE 0 END, coalesce(o.score, 0)) AS DOUBLE) AS score
    FROM t LEFT JOIN base b USING (rid) LEFT JOIN own o USING (rid)"""


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
