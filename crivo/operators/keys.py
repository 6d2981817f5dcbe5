"""Grain discovery, duplicates, versions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import labels as L
from ..functions.hashing import fingerprint
from ..functions.ratios import count_if, pct, ratio
from ._shape import NULL_HASH, hash_pair, join_names, quoted, semi_null_safe, stack_rows


def key_ids(keys: Sequence[Sequence[str]]) -> list[int]:
    """Grouping id of each candidate key within ``key_histogram``."""
    cols = list(dict.fromkeys(c for k in keys for c in k))
    return [sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in k) for k in keys]


#: Rows of one value of the columns that all candidates share; a value with more is not dealt to a single task.
HOT_ROWS = 10_000


def key_histogram(df: DataFrame, keys: Sequence[Sequence[str]]) -> DataFrame:
    """(gid, qtd, chaves): how many keys of each candidate occur ``qtd`` times.

    Nulls are ordinary key values here: the grouping id tells a null of the data
    from a column outside the candidate. The result is tiny and answers every
    question about grain and repetition.

    Candidates that share columns are counted one by one where rows lie that are
    dealt by these, so that no task keeps the keys of all candidates, or keys it
    can't count yet. Rows of a value with more than ``HOT_ROWS``, and candidates
    that share nothing, go through ``_grouping_sets``.
    """
    cols = list(dict.fromkeys(c for k in keys for c in k))
    names = {c: f"c{i}" for i, c in enumerate(cols)}
    sets = {frozenset(names[c] for c in k): gid for k, gid in zip(keys, key_ids(keys))}
    shared = sorted(frozenset.intersection(*sets))
    rows = df.select(*[F.col(quoted(c)).alias(n) for c, n in names.items()])
    if len(sets) == 1 or not shared:
        return _sizes(_grouping_sets(rows, sets))
    per = rows.groupBy(*shared).agg(F.count("*").alias("qtd"))
    hot = F.broadcast(per.where(F.col("qtd") > HOT_ROWS).select(*shared))
    parts, wider = [], [s for s in sets if s != set(shared)]
    for s in wider:
        dealt = semi_null_safe(rows.select(*sorted(s)), hot, shared, "left_anti").repartition(*shared)
        parts.append(_sizes(dealt.groupBy(*sorted(s)).agg(F.count("*").alias("qtd")).withColumn("gid", F.lit(sets[s]).cast("bigint"))))
    if len(wider) < len(sets):
        parts.append(_sizes(per.withColumn("gid", F.lit(sets[frozenset(shared)]).cast("bigint"))))
    parts.append(_sizes(_grouping_sets(semi_null_safe(rows, hot, shared), wider)))
    return reduce(DataFrame.unionByName, parts).groupBy("gid", "qtd").agg(F.sum("chaves").alias("chaves"))


def _sizes(groups: DataFrame) -> DataFrame:
    return groups.groupBy("gid", "qtd").agg(F.count("*").alias("chaves"))


def _grouping_sets(rows: DataFrame, sets: Iterable[frozenset[str]]) -> DataFrame:
    """(gid, qtd): one row per key of each set, all from one read and one shuffle with map-side counts."""
    each = [[F.col(c) for c in rows.columns if c in s] for s in sets]
    groups = rows.groupingSets(each, *map(F.col, rows.columns)).agg(F.grouping_id().alias("gid"), F.count("*").alias("qtd"))
    return groups.select("gid", "qtd")


def _sum_where(p: Column, x: Column) -> Column:
    return F.coalesce(F.sum(F.when(p, x)), F.lit(0))


def key_sizes(gid: int) -> tuple[Column, Column]:
    """Rows and distinct keys of one candidate, as aggregates over the histogram."""
    mine = F.col("gid") == gid
    return _sum_where(mine, F.col("qtd") * F.col("chaves")), _sum_where(mine, F.col("chaves"))


def grain(df: DataFrame, keys: Sequence[Sequence[str]]) -> DataFrame:
    """Rows per distinct key of every candidate; 1.0 means the key is unique."""
    return grain_of(key_histogram(df, keys), keys)


def grain_of(hist: DataFrame, keys: Sequence[Sequence[str]]) -> DataFrame:
    """``grain`` from a key histogram already at hand."""
    rows = []
    for key, gid in zip(keys, key_ids(keys)):
        n, d = key_sizes(gid)
        rows.append({"chave": F.lit(join_names(key)), "linhas": n, "combinacoes_distintas": d})
    n, d = F.col("linhas"), F.col("combinacoes_distintas")
    return (
        stack_rows(hist, rows)
        .withColumn("linhas_por_chave", ratio(n, d))
        .withColumn("veredito", F.when(n == d, L.KEY_UNIQUE).otherwise(L.KEY_NOT_UNIQUE))
        .orderBy("linhas_por_chave", "chave")
    )


def suggest_key(df: DataFrame, keys: Sequence[Sequence[str]]) -> DataFrame:
    """First unique candidate by name, or the text that asks to investigate."""
    g = grain(df, keys)
    first = F.min(F.when(F.col("veredito") == L.KEY_UNIQUE, F.col("chave")))
    return g.agg(F.coalesce(first, F.lit(L.KEY_NONE)).alias("sugerida"))


def duplicate_summary(df: DataFrame, keys: Sequence[Sequence[str]]) -> DataFrame:
    """Repeated combinations, excess rows and worst case of every candidate."""
    return duplicate_summary_of(key_histogram(df, keys), keys)


def duplicate_summary_of(hist: DataFrame, keys: Sequence[Sequence[str]]) -> DataFrame:
    """``duplicate_summary`` from a key histogram already at hand."""
    n, k = F.col("qtd"), F.col("chaves")
    rows = []
    for key, gid in zip(keys, key_ids(keys)):
        dup = (F.col("gid") == gid) & (n > 1)
        rows.append({
            "chave": F.lit(join_names(key)),
            "chaves_repetidas": _sum_where(dup, k),
            "linhas_excedentes": F.sum(F.when(dup, (n - 1) * k)),
            "pior_caso": F.max(F.when(dup, n)),
        })
    return stack_rows(hist, rows).orderBy(F.desc("chaves_repetidas"), "chave")


def duplicate_keys(df: DataFrame, key: Sequence[str], k: int | None = None) -> DataFrame:
    """Most repeated combinations of one key."""
    out = (
        df.groupBy(*map(quoted, key)).agg(F.count("*").alias("qtd")).where("qtd > 1").orderBy(F.desc("qtd"), *map(quoted, key))
    )
    return out if k is None else out.limit(k)


def duplicate_rows(df: DataFrame, key: Sequence[str], null_keys: bool = True) -> DataFrame:
    """Whole rows of the repeated keys.

    ``null_keys=False`` drops keys with a null, as an inner join USING does.
    """
    dup = df.groupBy(*map(quoted, key)).agg(F.count("*").alias("qtd")).where("qtd > 1").select(*map(quoted, key))
    if null_keys:
        return semi_null_safe(df, dup, key)
    return df.join(dup, list(key), "left_semi")


def varying_columns(df: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """What differs inside the repeated keys: worst distinct count per column.

    The cells of the duplicate rows are made distinct by (key, column, value), all
    of fixed width as hashes, before they are counted per key, so a key holding
    very many rows is counted by many tasks.
    """
    names = [c for c in (columns or df.columns) if c not in key]
    if not names:  # the key is the whole row
        return df.sparkSession.createDataFrame([], "coluna string, max_valores_distintos bigint, veredito string")
    dup = duplicate_rows(df.select(*map(quoted, dict.fromkeys([*key, *names]))), key)
    parts = [[F.coalesce(h, F.lit(NULL_HASH)) for h in hash_pair(dup, k)] for k in key]
    ids = [F.xxhash64(F.lit(seed), *[p[seed] for p in parts]).alias(f"k{seed}") for seed in (0, 1)]
    each = [F.struct(F.lit(i).alias("i"), *[h.alias(f"h{j}") for j, h in enumerate(hash_pair(dup, c))]) for i, c in enumerate(names)]
    cells = dup.select(*ids, F.inline(F.array(*each))).where(F.col("h0").isNotNull()).distinct()
    per_key = cells.groupBy("k0", "k1", "i").agg(F.count("*").alias("n"))
    worst = per_key.groupBy("i").agg(F.max("n").alias("n"))
    rows = [
        {
            "coluna": F.lit(c),
            "max_valores_distintos": F.coalesce(F.max(F.when(F.col("i") == i, F.col("n"))), F.lit(0)),
        }
        for i, c in enumerate(names)
    ]
    n = F.col("max_valores_distintos")
    return (
        stack_rows(worst, rows)
        .withColumn("veredito", F.when(n > 1, L.VARIES).otherwise(L.CONSTANT))
        .orderBy(F.desc("max_valores_distintos"), "coluna")
    )


def version_histogram(
    df: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None, mode: str = "pair"
) -> DataFrame:
    """(linhas, versoes, chaves): keys by row count and number of differing contents.

    Rows are counted per (key, content) first, so a hot key spreads over tasks
    by its contents before its versions are counted.
    """
    h = df.select(*map(quoted, key), fingerprint(df, columns or df.columns, mode).alias("hash_linha"))
    content = h.groupBy(*map(quoted, key), "hash_linha").agg(F.count("*").alias("n"))
    per_key = content.groupBy(*map(quoted, key)).agg(F.sum("n").alias("linhas"), F.count("*").alias("versoes"))
    return per_key.groupBy("linhas", "versoes").agg(F.count("*").alias("chaves"))


def pure_vs_version(
    df: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None, mode: str = "pair"
) -> DataFrame:
    """Splits repeated keys into identical rows and differing versions."""
    return pure_vs_version_of(version_histogram(df, key, columns, mode))


def pure_vs_version_of(hist: DataFrame) -> DataFrame:
    """``pure_vs_version`` from a version histogram already at hand."""
    n, v, k = F.col("linhas"), F.col("versoes"), F.col("chaves")
    every = F.lit(True)
    return hist.agg(
        _sum_where(every, k).alias("chaves"),
        _sum_where(every, n * k).alias("linhas"),
        _sum_where(n > 1, k).alias("chaves_duplicadas"),
        _sum_where(every, (n - v) * k).alias("linhas_duplicata_pura"),
        _sum_where(v > 1, k).alias("chaves_com_mais_de_uma_versao"),
        _sum_where(v > 1, (v - 1) * k).alias("linhas_versao_excedente"),
    )


def repeated_versions(
    df: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None, mode: str = "pair"
) -> DataFrame:
    """The short form: repeated keys, identical repetitions, keys with versions."""
    return repeated_versions_of(version_histogram(df, key, columns, mode))


def repeated_versions_of(hist: DataFrame) -> DataFrame:
    """``repeated_versions`` from a version histogram already at hand."""
    n, v, k = F.col("linhas"), F.col("versoes"), F.col("chaves")
    return hist.agg(
        _sum_where(n > 1, k).alias("chaves_repetidas"),
        _sum_where(n > 1, (n - v) * k).alias("repeticoes_identicas"),
        _sum_where(v > 1, k).alias("chaves_com_versoes"),
    )


def row_checksum(df: DataFrame, columns: Sequence[str] | None = None, mode: str = "pair") -> DataFrame:
    """Rows, distinct fingerprints and fully identical rows of a table."""
    h = df.select(fingerprint(df, columns or df.columns, mode).alias("hash_linha"))
    per = h.groupBy("hash_linha").agg(F.count("*").alias("n"))
    return _checksum(per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("linhas"), F.count("*").alias("linhas_unicas")))


def row_checksum_of(hist: DataFrame) -> DataFrame:
    """``row_checksum`` from a version histogram whose contents include the key."""
    n, v, k = F.col("linhas"), F.col("versoes"), F.col("chaves")
    every = F.lit(True)
    return _checksum(hist.agg(_sum_where(every, n * k).alias("linhas"), _sum_where(every, v * k).alias("linhas_unicas")))


def _checksum(totals: DataFrame) -> DataFrame:
    same = F.col("linhas") - F.col("linhas_unicas")
    verdict = F.when(F.col("linhas_identicas") == 0, L.ROWS_DISTINCT).otherwise(L.ROWS_IDENTICAL)
    return totals.withColumn("linhas_identicas", same).withColumn("veredito", verdict)


def content_hash_check(df: DataFrame, column: str) -> DataFrame:
    """A stored content hash: rows, distinct, null, repeated."""
    per = df.groupBy(quoted(column)).agg(F.count("*").alias("n"))
    c, n = F.col(quoted(column)), F.col("n")
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("linhas"),
        F.count(c).alias("hashes_distintos"),
        F.coalesce(F.sum(F.when(c.isNull(), n)), F.lit(0)).alias("hash_nulo"),
        F.coalesce(F.sum(F.when(c.isNotNull(), n - 1)), F.lit(0)).alias("linhas_com_hash_repetido"),
    )


def items_per_parent(
    df: DataFrame, parent: Sequence[str], child: str | None = None, k: int | None = None
) -> DataFrame:
    """Histogram of children per parent (rows, or distinct children)."""
    size = F.count("*") if child is None else F.countDistinct(quoted(child))
    out = (
        df.groupBy(*map(quoted, parent))
        .agg(size.alias("itens"), F.count("*").alias("linhas"))
        .groupBy("itens")
        .agg(F.count("*").alias("pais"), F.sum(F.col("linhas") - 1).alias("linhas_excedentes"))
        .orderBy("itens")
    )
    return out if k is None else out.limit(k)


def collapse_measure(df: DataFrame, parent: Sequence[str], child: str) -> DataFrame:
    """Does the parent key hold, or does ``child`` belong to the real key?"""
    n = F.col("itens")
    verdict = F.when(n > 1, L.COLLAPSE_YES.format(child)).otherwise(L.COLLAPSE_NO)
    return items_per_parent(df, parent, child).withColumn("veredito", verdict)


def collapse_members(
    df: DataFrame, parent: Sequence[str], child: str, k: int | None = None, as_list: bool = False
) -> DataFrame:
    """Parents with several children and who the children are.

    Pairs are made distinct first, and only the reported parents get members.
    Every member is a row, whatever its parent's size; ``as_list`` gives one
    sorted text per parent instead, meant for categories.
    """
    pairs = df.select(*map(quoted, parent), quoted(child)).distinct()
    sizes = pairs.groupBy(*map(quoted, parent)).agg(F.count(quoted(child)).alias("itens")).where("itens > 1")
    sizes = sizes.orderBy(F.desc("itens"), *map(quoted, parent))
    if k is not None:
        sizes = sizes.limit(k)
    members = semi_null_safe(pairs, sizes, parent)
    if not as_list:
        return members.where(F.col(quoted(child)).isNotNull()).orderBy(*map(quoted, parent), quoted(child))
    return (
        members.groupBy(*map(quoted, parent))
        .agg(
            F.count(quoted(child)).alias("itens"),
            F.concat_ws(", ", F.sort_array(F.collect_set(F.col(quoted(child)).cast("string")))).alias("tipos"),
        )
        .orderBy(F.desc("itens"), *map(quoted, parent))
    )


def repeated_child(df: DataFrame, parent: Sequence[str], child: str, item: str, k: int | None = None) -> DataFrame:
    """The same child more than once inside one parent."""
    out = (
        df.groupBy(*map(quoted, parent), quoted(child))
        .agg(F.countDistinct(quoted(item)).alias("itens"))
        .where("itens > 1")
        .orderBy(F.desc("itens"), *map(quoted, parent), quoted(child))
    )
    return out if k is None else out.limit(k)


def multiplicity(df: DataFrame, key: Sequence[str], buckets: Sequence[int] = (1, 2, 5, 10)) -> DataFrame:
    """How often keys repeat: keys, repeated keys, rows in them, worst, size bands."""
    per = df.groupBy(*map(quoted, key)).agg(F.count("*").alias("n"))
    n = F.col("n")
    bands = []
    for lo, hi in zip(buckets, [*buckets[1:], None]):
        name = f"chaves_com_{lo}" if hi == lo + 1 else f"chaves_com_{lo}_a_{hi - 1}" if hi else f"chaves_com_{lo}_ou_mais"
        cond = (n >= lo) & (n < hi) if hi else n >= lo
        bands.append(count_if(cond).alias(name))
    return per.agg(
        F.count("*").alias("chaves"),
        F.coalesce(F.sum(n), F.lit(0)).alias("linhas"),
        count_if(n > 1).alias("chaves_repetidas"),
        F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("linhas_em_chaves_repetidas"),
        F.max(n).alias("maximo_linhas_por_chave"),
        *bands,
    )


def attribute_versions(df: DataFrame, entity: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """Entities that carry more than one set of attribute values."""
    pairs = df.select(*map(quoted, entity), *map(quoted, attributes)).distinct()
    per = pairs.groupBy(*map(quoted, entity)).agg(F.count("*").alias("versoes"))
    v = F.col("versoes")
    return per.agg(
        F.count("*").alias("entidades"),
        count_if(v > 1).alias("entidades_com_mais_de_uma_versao"),
        F.max(v).alias("maximo_versoes"),
        pct(count_if(v > 1), F.count("*")).alias("pct_com_versoes"),
    )


def split_dimensions(df: DataFrame, key: Sequence[str], dims: Sequence[str], k: int | None = None) -> DataFrame:
    """Keys no longer one-to-one, with the distinct count of each suspect dimension.

    Rows are counted per (key, dimension, value), the value as hashes of fixed width, before they meet per key. Every row
    is in the counts of the first dimension, which also give the rows of a key.
    """
    ids = [f"k{i}" for i in range(len(key))]
    pairs = [hash_pair(df, d) for d in dims] or [[F.lit(None).cast("bigint")] * 2]
    each = [F.struct(F.lit(i).alias("i"), one.alias("h1"), two.alias("h2")) for i, (one, two) in enumerate(pairs)]
    cells = df.select(*[F.col(quoted(c)).alias(i) for i, c in zip(ids, key)], F.inline(F.array(*each)))
    values = cells.groupBy(*ids, "i", "h1", "h2").agg(F.count("*").alias("n"))
    distinct = lambda i: count_if((F.col("i") == i) & F.col("h1").isNotNull())
    per = values.groupBy(*ids).agg(F.sum(F.when(F.col("i") == 0, F.col("n"))).alias("n"), *[distinct(i).alias(f"d{i}") for i in range(len(dims))])
    out = per.where("n > 1").orderBy(F.desc("n"), *ids).select(
        *[F.col(i).alias(c) for i, c in zip(ids, key)], F.col("n").alias("linhas"), *[F.col(f"d{i}").alias(f"distintos_{d}") for i, d in enumerate(dims)])
    return out if k is None else out.limit(k)


def largest_document(df: DataFrame, document: str) -> DataFrame:
    """Whole rows of the document with most rows (the smallest name on a tie).

    The side that is broadcast is one row by construction.
    """
    top = (
        df.where(F.col(document).isNotNull())
        .groupBy(document)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), document)
        .limit(1)
        .select(document)
    )
    return df.join(F.broadcast(top), document, "left_semi")


def legacy_concat_distinct(df: DataFrame, columns: Sequence[str], sep: str = "|") -> Column:
    """Distinct count over a plain concatenation: a null anywhere drops the tuple.

    Kept only to reproduce older figures; ``grain`` counts null keys as keys.
    """
    parts: list[Column] = []
    for c in columns:
        parts += [df[quoted(c)].cast("string"), F.lit(sep)]
    return F.countDistinct(F.concat(*parts[:-1]))
