"""What holds in a table without being asked for: minimal keys, dependencies between columns, references between tables.

Cells enter as two 64-bit hashes, so that every group key has a fixed width
whatever the columns hold; a null is a value of its own. Column sets are counted
many at a time from one read: each row gives a small array of (set, hashes), which
is combined before it is shuffled, so a frequent value loads no task. The driver
holds names and counts of column sets, never rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import labels as L
from ..functions import normalize as N
from ..functions.ratios import pct
from ._shape import NULL_HASH, batches, hash_pair, join_names, quoted

#: Column sets counted in one pass, and the share of all values (one in so many) that is looked at first.
SETS_PER_PASS, SLICES = 24, 64

#: Values of column sets that a task keeps at once where rows are dealt by a column.
ENTRIES_PER_TASK = 2_000_000

#: Types that are shuffled as they are; any other value is wider, or may be, than two hashes.
PLAIN = (T.IntegralType, T.DoubleType, T.FloatType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _hashed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One pair of columns ``x{i}``, ``y{i}`` for each column."""
    out = []
    for i, c in enumerate(columns):
        for name, h in zip("xy", hash_pair(df, c)):
            out.append(F.coalesce(h, F.lit(NULL_HASH)).alias(f"{name}{i}"))
    return df.select(*out)


def _set_hash(members: Sequence[int], seed: str) -> Column:
    return F.xxhash64(F.lit(ord(seed)), *[F.col(f"{seed}{i}") for i in members])


def _repeated(cells: DataFrame, sets: Sequence[tuple[int, ...]]) -> dict[tuple[int, ...], tuple[int, int]]:
    """Distinct values and largest group of each set."""
    found = {}
    for part in batches(sets, SETS_PER_PASS):
        each = F.array(*[F.struct(F.lit(n).alias("n"), _set_hash(s, "x").alias("x"), _set_hash(s, "y").alias("y")) for n, s in enumerate(part)])
        groups = cells.select(F.inline(each)).groupBy("n", "x", "y").agg(F.count("*").alias("linhas"))
        for r in groups.groupBy("n").agg(F.count("*").alias("d"), F.max("linhas").alias("m")).collect():
            found[part[r.n]] = (r.d, r.m)
        for s in part:
            found.setdefault(s, (0, 0))
    return found


def _slice_repeats(cells: DataFrame, sets: Mapping[tuple[int, ...], int]) -> set[tuple[int, ...]]:
    """Those of ``sets`` that repeat among the rows whose value in their anchor, a column of theirs, falls into one slice of ``SLICES``.

    Rows of no slice are left out before anything else is hashed. Nulls are in no slice, so that a mostly empty column gives no large one.
    """
    found = set()
    for part in batches(sorted(sets, key=lambda s: (sets[s], s)), SETS_PER_PASS):
        within = {a: (F.col(f"y{a}") != NULL_HASH) & (F.pmod(f"y{a}", F.lit(SLICES)) == 0) for a in {sets[s] for s in part}}
        each = [F.when(within[sets[s]], F.struct(F.lit(n).alias("n"), _set_hash(s, "x").alias("x"), _set_hash(s, "y").alias("y"))) for n, s in enumerate(part)]
        rows = cells.where(reduce(or_, within.values())).select(F.inline(F.array_compact(F.array(*each))))
        groups = rows.groupBy("n", "x", "y").agg(F.count("*").alias("linhas")).where("linhas > 1")
        found |= {part[r.n] for r in groups.select("n").distinct().collect()}
    return found


def _even(anchors: set[int], largest: Mapping[int, int], total: int) -> set[int]:
    """Columns by which rows may be dealt to tasks: no value of theirs fills a share of the table."""
    return {a for a in anchors if largest[a] * SLICES <= max(total, ENTRIES_PER_TASK)}


def _repeats(
    df: DataFrame, names: Sequence[str], cells: DataFrame, sets: Mapping[tuple[int, ...], int], largest: Mapping[int, int], total: int
) -> set[tuple[int, ...]]:
    """Those of ``sets`` that repeat anywhere. Rows are dealt by an anchor, once for all of its sets, which are counted where the rows lie.

    An anchor with a value that fills a share of the table would load one task; its sets are shuffled by their own values.
    """
    even = _even(set(sets.values()), largest, total)
    found = {s for s, (_, m) in _repeated(cells, [s for s in sets if sets[s] not in even]).items() if m > 1}
    for a in sorted(even):
        for part in batches([s for s in sets if sets[s] == a], SETS_PER_PASS):
            dealt = _dealt(df, names, a, {c for s in part for c in s}, 1 + total * len(part) // ENTRIES_PER_TASK)
            each = F.array(*[F.struct(F.lit(n).alias("n"), _set_hash(s, "x").alias("x"), _set_hash(s, "y").alias("y")) for n, s in enumerate(part)])
            place = [c for c in dealt.columns if c.startswith("p")]
            groups = dealt.select(*place, F.inline(each)).groupBy(*place, "n", "x", "y").agg(F.count("*").alias("linhas")).where("linhas > 1")
            found |= {part[r.n] for r in groups.select("n").distinct().collect()}
    return found


def _dealt(df: DataFrame, names: Sequence[str], anchor: int, wanted: set[int], tasks: int) -> DataFrame:
    """The cells of the wanted columns, as in ``_hashed``, dealt to so many tasks by the anchor, whose value is ``p{i}``.

    Numbers and dates are shuffled as they are, anything else as its two hashes.
    """
    sent: dict[int, list[Column]] = {}
    for i in wanted:
        c, dtype = df[quoted(names[i])], df.schema[names[i]].dataType
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            c = c + F.lit(0.0)
        sent[i] = [c.alias(f"v{i}")] if isinstance(dtype, PLAIN) else [h.alias(f"{n}{i}") for n, h in zip("vw", hash_pair(df, names[i]))]
    by = [f"{n}{anchor}" for n, _ in zip("vw", sent[anchor])]
    there = df.select(*[c for columns in sent.values() for c in columns]).repartition(tasks, *by)
    out = [F.col(n).alias(f"p{j}") for j, n in enumerate(by)]
    for i, columns in sent.items():
        pair = hash_pair(there, f"v{i}") if len(columns) == 1 else [F.col(f"v{i}"), F.col(f"w{i}")]
        out += [F.coalesce(h, F.lit(NULL_HASH)).alias(f"{n}{i}") for n, h in zip("xy", pair)]
    return there.select(*out)


def minimal_keys(df: DataFrame, columns: Sequence[str] | None = None, most: int = 3) -> DataFrame:
    """(chave, colunas, linhas): every set of up to ``most`` columns that is unique and has no unique part.

    Sets are gone through by size. Out go those that hold a key, and those whose distinct counts multiply to less than
    the rows. Each set that is left is anchored at its column of most values. It is first looked at in a slice of that
    column's values, one in ``SLICES``, whose groups are whole: a repetition there disproves the key. Only sets without
    one are looked for over all rows. An empty table has no keys.
    """
    names = list(columns or df.columns)
    cells = _hashed(df, names)
    total = cells.count()
    keys: list[tuple[int, ...]] = []
    if total:
        singles = _repeated(cells, [(i,) for i in range(len(names))])
        distinct = {s[0]: d for s, (d, _) in singles.items()}
        largest = {s[0]: m for s, (_, m) in singles.items()}
        keys += [s for s, (d, _) in singles.items() if d == total]
        for size in range(2, most + 1):
            open_ = [s for s in combinations(range(len(names)), size) if not any(set(k) <= set(s) for k in keys) and _enough(s, distinct, total)]
            anchors = {s: max(s, key=lambda c: (distinct[c], -c)) for s in open_}
            sliced = _slice_repeats(cells, anchors) if len(open_) > 1 else set()
            hopeful = {s: anchors[s] for s in open_ if s not in sliced}
            repeated = _repeats(df, names, cells, hopeful, largest, total)
            keys += [s for s in hopeful if s not in repeated]
    rows = [(join_names([names[i] for i in k]), len(k), total) for k in keys]
    return df.sparkSession.createDataFrame(rows, "chave string, colunas bigint, linhas bigint").orderBy("colunas", "chave")


def _enough(columns: Sequence[int], distinct: Mapping[int, int], total: int) -> bool:
    product = 1
    for c in columns:
        product *= distinct[c]
    return product >= total


def dependencies(df: DataFrame, columns: Sequence[str] | None = None, most: int = 2, most_error: float = 1.0) -> DataFrame:
    """(esquerda, direita, linhas, erro, pct_erro, veredito): how far the left columns determine the right one.

    ``erro`` counts the rows outside the most frequent value of the right column within each group of the left ones: rows
    that would have to change for the dependency to hold. A left side is left out where a part of it determines the
    right column already, or another column of itself. ``most_error`` is the largest share that is reported.

    Rows are dealt by the column of a left side that has most values, once for all left sides with that one, and errors
    are counted where the rows lie. Where that column has a value that fills a share of the table, the groups of a set of
    columns are refined from one count: those of {a, b, c} give the errors of ab -> c, ac -> b and bc -> a. Groups of
    one row can't err and are stripped.
    """
    names = list(columns or df.columns)
    cells = _hashed(df, names)
    total = cells.count()
    singles = _repeated(cells, [(i,) for i in range(len(names))]) if total else {}
    distinct, largest = ({s[0]: dm[k] for s, dm in singles.items()} for k in (0, 1))
    even = _even(set(distinct), largest, total)
    errors: dict[tuple[tuple[int, ...], int], int] = {}
    for size in range(1, most + 1):
        wanted: dict[tuple[int, ...], list[int]] = {}
        dealt: dict[int, list[tuple[tuple[int, ...], int]]] = {}
        for left in combinations(range(len(names)), size):
            if any(errors.get((part, c)) == 0 for k in range(1, size) for part in combinations(left, k) for c in left if c not in part):
                continue
            for right in range(len(names)):
                if right not in left and not any(errors.get((part, right)) == 0 for k in range(1, size) for part in combinations(left, k)):
                    anchor = max(left, key=lambda c: (distinct.get(c, 0), -c))
                    if anchor in even:
                        dealt.setdefault(anchor, []).append((left, right))
                    else:
                        wanted.setdefault(tuple(sorted((*left, right))), []).append(right)
        errors.update(_errors(cells, wanted))
        for anchor, pairs in dealt.items():
            errors.update(_errors_dealt(df, names, anchor, pairs, total))
    rows = [(join_names([names[i] for i in left]), names[right], total, e) for (left, right), e in errors.items() if e <= most_error * total]
    out = df.sparkSession.createDataFrame(rows, "esquerda string, direita string, linhas bigint, erro bigint")
    verdict = F.when(F.col("erro") == 0, L.DEPENDENCY_HOLDS).otherwise(L.DEPENDENCY_FAILS)
    return out.withColumn("pct_erro", pct(F.col("erro"), F.col("linhas"))).withColumn("veredito", verdict).orderBy("erro", "esquerda", "direita")


def _errors(cells: DataFrame, wanted: Mapping[tuple[int, ...], Sequence[int]]) -> dict[tuple[tuple[int, ...], int], int]:
    """Error of each dependency that ``wanted`` names, as a set of columns and which of them are right sides."""
    found = {}
    for part in batches(list(wanted), SETS_PER_PASS):
        width = len(part[0])
        each = [F.struct(F.lit(n).alias("n"), *[F.col(f"{h}{c}").alias(f"{h}_{j}") for j, c in enumerate(s) for h in "xy"]) for n, s in enumerate(part)]
        members = [f"{h}_{j}" for j in range(width) for h in "xy"]
        groups = cells.select(F.inline(F.array(*each))).groupBy("n", *members).agg(F.count("*").alias("linhas"))
        sides = []
        for j in range(width):
            left = [f for f in members if not f.endswith(f"_{j}")]
            asked = [n for n, s in enumerate(part) if s[j] in wanted[s]]
            if asked:
                sides.append(F.when(F.col("n").isin(asked), F.struct(
                    F.lit(j).alias("j"), *[F.xxhash64(F.lit(k), *left).alias(f"g{k}") for k in (1, 2)])))
        by_left = groups.select("n", "linhas", F.inline(F.array_compact(F.array(*sides)))).groupBy("n", "j", "g1", "g2").agg(
            F.sum("linhas").alias("linhas"), F.max("linhas").alias("maior")).where("linhas > 1")
        for r in by_left.groupBy("n", "j").agg(F.sum(F.col("linhas") - F.col("maior")).alias("e")).collect():
            found[part[r.n], r.j] = r.e
        for n, s in enumerate(part):
            for j, c in enumerate(s):
                if c in wanted[s]:
                    found.setdefault((s, j), 0)
    return {(tuple(c for c in s if c != s[j]), s[j]): e for (s, j), e in found.items()}


def _errors_dealt(
    df: DataFrame, names: Sequence[str], anchor: int, pairs: Sequence[tuple[tuple[int, ...], int]], total: int
) -> dict[tuple[tuple[int, ...], int], int]:
    """Error of each (left, right), all with the anchor on the left, from rows that are dealt by it."""
    found = {}
    for part in batches(pairs, SETS_PER_PASS):
        rows = _dealt(df, names, anchor, {c for left, right in part for c in (*left, right)}, 1 + 2 * total * len(part) // ENTRIES_PER_TASK)
        each = F.array(*[
            F.struct(F.lit(n).alias("n"), _set_hash(left, "x").alias("x"), _set_hash(left, "y").alias("y"), F.col(f"x{right}").alias("rx"), F.col(f"y{right}").alias("ry"))
            for n, (left, right) in enumerate(part)])
        by_left = [*(c for c in rows.columns if c.startswith("p")), "n", "x", "y"]
        groups = rows.select(*by_left[:-3], F.inline(each)).groupBy(*by_left, "rx", "ry").agg(F.count("*").alias("linhas"))
        sides = groups.groupBy(*by_left).agg(F.sum("linhas").alias("linhas"), F.max("linhas").alias("maior")).where("linhas > 1")
        found.update(dict.fromkeys(part, 0))
        for r in sides.groupBy("n").agg(F.sum(F.col("linhas") - F.col("maior")).alias("e")).collect():
            found[part[r.n]] = r.e
    return found


#: Columns of these types may refer to others; amounts are no references.
REFERRING = (T.IntegralType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)


def inclusions(tables: Mapping[str, DataFrame], codes: bool = False) -> DataFrame:
    """(coluna, em, distintos, em_comum, orfaos, linhas_orfas, pct_orfaos, veredito) for all columns with a value in common.

    ``coluna`` refers to ``em`` if none of its values is an orphan. All columns of all tables are counted by (value,
    column), then a value knows the set of columns that hold it, and equal sets are added up; pairs of columns are made
    of sets, of which there are few. Values are compared as texts; ``codes`` leaves leading zeros out. Nulls refer to nothing.
    """
    names, parts = [], []
    for table, df in tables.items():
        cells = []
        for f in df.schema.fields:
            if isinstance(f.dataType, REFERRING):
                text = df[quoted(f.name)].cast("string")
                cells.append(F.struct(F.lit(len(names)).alias("c"), (N.strip_zeros(text) if codes else text).alias("valor")))
                names.append(f"{table}.{f.name}")
        if cells:
            parts.append(df.select(F.inline(F.array(*cells))).where("valor IS NOT NULL").groupBy("c", "valor").agg(F.count("*").alias("linhas")))
    spark = next(iter(tables.values())).sparkSession
    if not parts:
        return spark.createDataFrame([], "coluna string, em string, distintos bigint, em_comum bigint, orfaos bigint, linhas_orfas bigint, pct_orfaos double, veredito string")
    values = parts[0]
    for p in parts[1:]:
        values = values.unionByName(p)
    holders = values.groupBy(F.xxhash64(F.lit(1), "valor").alias("h1"), F.xxhash64(F.lit(2), "valor").alias("h2")).agg(
        F.sort_array(F.collect_list(F.struct("c", "linhas"))).alias("quem"))
    sets = holders.select(F.transform("quem", lambda q: q["c"]).alias("conjunto"), F.inline("quem")).groupBy("conjunto", "c").agg(
        F.count("*").alias("valores"), F.sum("linhas").alias("linhas"))
    of_all = sets.groupBy("c").agg(F.sum("valores").alias("distintos"), F.sum("linhas").alias("todas"))
    common = sets.select("c", F.explode("conjunto").alias("d"), "valores", "linhas").where("c <> d").groupBy("c", "d").agg(
        F.sum("valores").alias("em_comum"), F.sum("linhas").alias("linhas_comuns"))
    name = lambda c: F.element_at(F.array(*map(F.lit, names)), F.col(c) + 1)
    orphans = F.col("distintos") - F.col("em_comum")
    out = common.join(of_all, "c").select(
        name("c").alias("coluna"), name("d").alias("em"), "distintos", "em_comum", orphans.alias("orfaos"),
        (F.col("todas") - F.col("linhas_comuns")).alias("linhas_orfas"), pct(orphans, F.col("distintos")).alias("pct_orfaos"))
    return out.withColumn("veredito", F.when(F.col("orfaos") == 0, L.REFERS).otherwise(L.REFERS_NOT)).orderBy("orfaos", "coluna", "em")
