"""Cell-level comparison of two extracts of the same data.

Both extracts are brought to comparable cells (codes without leading zeros,
dates as AAAAMMDD, numbers, trimmed text), stacked with a side mark and counted
per key and row content, of which only two hashes are shuffled. Nothing is
joined, so repeated keys cannot multiply rows. Contents of a key that occur on
both sides are each other's counterpart, however often they repeat. If one
content is left on each side, those two are compared cell by cell; the cells of
contents that are left are read in a second pass. Anything else that is left are
versions: the key is reported as such, and with ``versions`` in the spec they are
paired at the least number of differing cells and compared like the others. For
these, rows meet by key, once and whole, and a key's versions are paired on the
spot. Rows are counted in buckets of keys before, and those of buckets too large for
that go the way of the others, by hashes; so do the versions of keys with many pairs.

A cell that does not read as a number keeps its text, and is compared by it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates as D
from ..functions import normalize as N
from ..functions.ratios import count_if, pct
from ..session import stored
from ._shape import quoted, stack_rows
from .versions import pair_versions, pairs_in_place

# States of a key.
BOTH = "EM AMBAS"
ONLY_A = "SOMENTE A"
ONLY_B = "SOMENTE B"
VERSIONS = "CHAVE COM VERSOES"

KINDS = ("code", "date", "double", "exact", "text")

#: Buckets of keys in which rows are counted, the rows of one up to which its keys' contents are gathered by key, and the
#: pairs of a key up to which they are walked one by one.
BUCKETS, BUCKET_ROWS, KEY_PAIRS = 65_536, 65_536, 1024


@dataclass(frozen=True)
class CompareSpec:
    """Keys and columns to compare.

    ``kinds`` names the comparison of a column: ``code``, ``date``, ``double``
    (within ``tolerance``), ``exact`` or ``text``; the default comes from the
    column type of the first extract. ``exact`` keeps every decimal place of
    both extracts, whatever their types; what is no number is compared as text.
    ``versions`` compares what is left of keys with several versions too.
    """

    keys: Sequence[str]
    columns: Sequence[str]
    kinds: Mapping[str, str] = field(default_factory=dict)
    tolerance: float = 0.005
    zero_mode: str = "all"
    versions: bool = False

    def kind(self, df: DataFrame, c: str) -> str:
        if c in self.kinds:
            return self.kinds[c]
        t = df.schema[c].dataType
        if isinstance(t, (T.DoubleType, T.FloatType)):
            return "double"
        if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return "date"
        return "text" if isinstance(t, T.StringType) else "exact"


def _places(a: T.DataType, b: T.DataType) -> int:
    """Decimal places with which exact numbers of both types are shown; none where a text or a double leaves them open."""
    types = (a, b)
    if not all(isinstance(t, (T.DecimalType, T.IntegralType)) for t in types):
        return 0
    return max(t.scale if isinstance(t, T.DecimalType) else 0 for t in types)


def _plain(c: Column, dtype: T.DataType) -> Column:
    text = F.to_json(c) if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)) else c.cast("string")
    return F.nullif(F.trim(text), F.lit(""))


def _cell(df: DataFrame, c: str, kind: str) -> Column:
    """``v`` is what the cell says, ``t`` its text where it does not read as a number; both null for an empty one."""
    x, dtype = df[quoted(c)], df.schema[c].dataType
    text = _plain(x, dtype)
    if kind == "exact":
        number = text if isinstance(dtype, T.IntegralType) else N.canonical_number(text)
        if isinstance(dtype, T.DecimalType):  # plain digits but for the smallest ones: only closing zeros may go
            short = F.when(F.contains(text, F.lit(".")), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)
            number = F.when(F.contains(text, F.lit("E")), number).otherwise(short)
        # what a number is made of need not be worked out again to see whether there is one
        rest = F.lit(None).cast("string") if isinstance(dtype, (T.DecimalType, T.IntegralType)) else F.when(~N.is_number(text), text)
        return F.struct(number.alias("v"), rest.alias("t"))
    if kind == "double":
        number = text.try_cast("double") if isinstance(dtype, T.StringType) else x.try_cast("double") if isinstance(dtype, T.NumericType) else F.lit(None).cast("double")
        return F.struct((number + F.lit(0.0)).alias("v"), F.when(number.isNull(), text).alias("t"))
    if kind == "code":
        value = F.nullif(N.strip_zeros(x), F.lit(""))
    else:
        value = D.date_key(x, dtype) if kind == "date" else text
    return F.struct(value.alias("v"), F.lit(None).cast("string").alias("t"))


@dataclass(frozen=True)
class _Rows:
    """Both extracts stacked: keys, the side and the cells."""

    rows: DataFrame
    kinds: Mapping[str, str]

    @property
    def numbers(self) -> list[int]:
        return [i for i, k in enumerate(self.kinds.values()) if k in ("double", "exact")]


def _rows(a: DataFrame, b: DataFrame, spec: CompareSpec) -> _Rows:
    kinds = {c: spec.kind(a, c) for c in spec.columns}
    parts = []
    for df, side in ((a, 0), (b, 1)):
        cells = [_cell(df, c, k).alias(f"c{i}") for i, (c, k) in enumerate(kinds.items())]
        keys = [N.strip_zeros(df[quoted(k)], spec.zero_mode).alias(k) for k in spec.keys]
        parts.append(df.select(*keys, F.struct(*cells).alias("linha"), F.lit(side).alias("lado")))
    return _Rows(parts[0].unionByName(parts[1]), kinds)


def _key(spec: CompareSpec) -> Column:
    return F.md5(F.concat(*[F.coalesce(F.concat(F.lit("="), quoted(k), F.lit("\x1f")), F.lit("\x1f")) for k in spec.keys]))


@dataclass(frozen=True)
class _Sides:
    """Both extracts stacked, and what is counted of their contents."""

    rows: DataFrame
    contents: DataFrame
    per: DataFrame
    kinds: Mapping[str, str]


def _stacked(stack: _Rows, spec: CompareSpec) -> _Sides:
    """Per key: rows of each side, contents found on both, contents left on each side, and the state.

    ``ilegiveis_i`` counts the contents found on both whose i-th cell is no number.
    """
    kinds, numbers = stack.kinds, stack.numbers
    names = [quoted(k) for k in spec.keys]
    unread = F.concat(F.lit(""), *[F.when(F.col(f"linha.c{i}.t").isNotNull(), "1").otherwise("0") for i in numbers])
    rows = stack.rows.select("*", _key(spec).alias("chave"))
    rows = rows.select("*", unread.alias("ilegivel"), *[F.xxhash64(F.lit(seed), "chave", "linha").alias(f"h{seed}") for seed in (1, 2)])
    contents = rows.groupBy("chave", *names, "h1", "h2", "ilegivel").agg(
        F.sum(1 - F.col("lado")).alias("na"), F.sum("lado").alias("nb"))
    na, nb = F.col("na"), F.col("nb")
    only_a, only_b, common = nb == 0, na == 0, (na > 0) & (nb > 0)
    per = contents.groupBy("chave", *names).agg(
        F.sum("na").alias("linhas_a"), F.sum("nb").alias("linhas_b"), count_if(common).alias("iguais"),
        # in the order of na and nb: otherwise Spark turns them round below and shuffles the contents once more
        count_if(only_b).alias("sobra_b"), count_if(only_a).alias("sobra_a"),
        *[count_if(common & (F.substring("ilegivel", n + 1, 1) == "1")).alias(f"ilegiveis_{i}") for n, i in enumerate(numbers)],
    )
    one = (F.col("sobra_a") == 1) & (F.col("sobra_b") == 1)
    state = (
        F.when(F.col("linhas_b") == 0, ONLY_A)
        .when(F.col("linhas_a") == 0, ONLY_B)
        .when(one | (F.col("sobra_a") + F.col("sobra_b") == 0), BOTH)
        .otherwise(VERSIONS)
    )
    return _Sides(rows, contents, per.withColumn("situacao", state), kinds)


def _left_over(sides: _Sides, spec: CompareSpec, wanted: Column) -> DataFrame:
    """(chave, keys…, lado, h1, h2, linha): contents without an equal on the other side, of the keys that are wanted."""
    keys = sides.per.where(wanted).select("chave")
    left = sides.contents.where("na = 0 OR nb = 0").join(keys, "chave").select("h1", "h2")
    found = sides.rows.join(left, ["h1", "h2"], "left_semi")
    return found.groupBy("chave", *[quoted(k) for k in spec.keys], "lado", "h1", "h2").agg(F.first("linha").alias("linha"))


def _ones(sides: _Sides, spec: CompareSpec) -> DataFrame:
    """(keys…, a, b): the two contents that are left, of keys with one on each side."""
    names = [quoted(k) for k in spec.keys]
    side = lambda n: F.max(F.when(F.col("lado") == n, F.col("linha")))
    ones = _left_over(sides, spec, F.expr("sobra_a = 1 AND sobra_b = 1")).groupBy("chave", *names).agg(side(0).alias("a"), side(1).alias("b"))
    return ones.select(*names, "a", "b")


def _compared(a: DataFrame, b: DataFrame, spec: CompareSpec) -> tuple[Mapping[str, str], DataFrame, DataFrame]:
    """Kinds; (iguais, ilegiveis_i…) of the keys that are compared; (keys…, a, b), the contents with their counterparts."""
    stack = _rows(a, b, spec)
    if not spec.versions:
        sides = _stacked(stack, spec)
        return stack.kinds, _equal(sides.per.where(F.col("situacao") == BOTH), stack), _ones(sides, spec)
    found = _versions(stack, spec)
    names = [quoted(k) for k in spec.keys]
    place = lambda p, n: F.get("sobras", p["ab"[n]])["linha"].alias("ab"[n])
    pairs = found.near.select(*names, F.inline(F.transform("pares", lambda p: F.struct(place(p, 0), place(p, 1)))))
    equal = _equal(found.near, stack)
    if found.far:
        equal = equal.unionByName(_equal(found.far.per.where(F.col("situacao").isin(BOTH, VERSIONS)), stack))
        pairs = pairs.unionByName(_ones(found.far, spec))
    if found.contents:
        cells = lambda n: found.contents.where(F.col("lado") == n).select(F.col("id").alias("ab"[n]), F.col("linha").alias(f"linha_{n}"), *(names if n == 0 else []))
        paired = found.pairs.join(cells(0), "a").join(cells(1), "b")
        pairs = pairs.unionByName(paired.select(*names, F.col("linha_0").alias("a"), F.col("linha_1").alias("b")))
    return stack.kinds, equal, pairs


def _equal(per: DataFrame, stack: _Rows) -> DataFrame:
    return per.select("iguais", *[f"ilegiveis_{i}" for i in stack.numbers])


def _cell_text(c: Column) -> Column:
    return F.coalesce(c["v"].cast("string"), c["t"])


def _id(linha: Column, kinds: Mapping[str, str], spec: CompareSpec) -> Column:
    """Digest of a content, with its key."""
    cells = [_cell_text(linha[f"c{i}"]) for i in range(len(kinds))]
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for c in [*[F.col(quoted(k)) for k in spec.keys], *cells]]))


def _cell_hashes(linha: Column, kinds: Mapping[str, str]) -> Column:
    return F.array(*[F.xxhash64(F.lit(i), linha[f"c{i}"]["v"], linha[f"c{i}"]["t"]) for i in range(len(kinds))])


@dataclass(frozen=True)
class _Versions:
    """What is left of keys with rows on both sides.

    ``near``: keys whose rows met, with the contents that are left and their pairs by place, those of one content on each
    side included; no pairs (null) if there are too many. ``far``: the keys of large buckets, if any. ``contents`` and
    ``pairs``: the versions of both that are not paired in ``near``, if any.
    """

    near: DataFrame
    far: _Sides | None
    contents: DataFrame | None
    pairs: DataFrame | None


def _versions(stack: _Rows, spec: CompareSpec) -> _Versions:
    names, kinds = [quoted(k) for k in spec.keys], stack.kinds
    bucket = F.pmod(F.xxhash64(*names), F.lit(BUCKETS)).cast("int")
    counts = stack.rows.groupBy(bucket.alias("balde")).count().where(F.col("count") > BUCKET_ROWS)
    large = [r.balde for r in counts.select("balde").collect()]
    rows = stack.rows.where(~bucket.isin(large)) if large else stack.rows
    near = stored(_near(_Rows(rows, kinds), spec), "chaves")
    # lists of contents aside: only to see whether there are such keys
    many = [near.where("pares IS NULL").select(*names, F.inline("sobras"))] if not near.where("pares IS NULL").select("pares").isEmpty() else []
    far = None
    if large:
        far = _stacked(_Rows(stack.rows.where(bucket.isin(large)), kinds), spec)
        left = _left_over(far, spec, F.expr(f"situacao = '{VERSIONS}' AND sobra_a > 0 AND sobra_b > 0"))
        many.append(left.select(*names, "lado", "linha"))
    if not many:
        return _Versions(near, far, None, None)
    linha = F.col("linha")
    contents = reduce(DataFrame.unionByName, many).select(
        *names, "lado", "linha", _key(spec).alias("chave"), _id(linha, kinds, spec).alias("id"), _cell_hashes(linha, kinds).alias("celulas"))
    contents = stored(contents, "versoes")
    return _Versions(near, far, contents, pair_versions(contents, len(kinds)))


def _near(stack: _Rows, spec: CompareSpec) -> DataFrame:
    """``_Versions.near``: (keys…, iguais, ilegiveis_i…, sobras, pares), in one shuffle of rows by key."""
    names, kinds, numbers = [quoted(k) for k in spec.keys], stack.kinds, stack.numbers
    # cells go one by one, without the texts that only numbers have: less to shuffle than structs
    cells = {f"linha_{x}{i}": F.col(f"linha.c{i}.{x}") for i in range(len(kinds)) for x in ("vt" if i in numbers else "v")}
    rows = stack.rows.select(*names, F.col("lado").cast("byte").alias("lado"), *[c.alias(n) for n, c in cells.items()]).repartition(*names)
    contents = rows.groupBy(*names, *cells).agg(F.sum(1 - F.col("lado")).alias("na"), F.sum("lado").alias("nb"))
    text = lambda i: F.col(f"linha_t{i}") if i in numbers else F.lit(None).cast("string")
    linha = F.struct(*[F.struct(F.col(f"linha_v{i}").alias("v"), text(i).alias("t")).alias(f"c{i}") for i in range(len(kinds))])
    contents = contents.select(*names, "na", "nb", linha.alias("linha"))
    na, nb, row = F.col("na"), F.col("nb"), F.col("linha")
    common = (na > 0) & (nb > 0)
    content = F.struct(F.when(nb > 0, 1).otherwise(0).alias("lado"), _id(row, kinds, spec).alias("id"), _cell_hashes(row, kinds).alias("celulas"), "linha")
    keys = contents.groupBy(*names).agg(
        F.sum("na").alias("linhas_a"), F.sum("nb").alias("linhas_b"), count_if(common).alias("iguais"),
        *[count_if(common & F.col(f"linha.c{i}.t").isNotNull()).alias(f"ilegiveis_{i}") for i in numbers],
        F.collect_list(F.when(~common, content)).alias("achados"),
    ).where("linhas_a > 0 AND linhas_b > 0")
    of = lambda n: F.size(F.filter("achados", lambda c: c["lado"] == n))
    both, total = of(0).cast("long") * of(1), F.size("achados")
    # two that are left are each other's counterpart even if they share no cell
    limit = F.when(total == 2, len(kinds) + 1).otherwise(len(kinds))
    some = F.when(both > 0, F.col("achados")).otherwise(F.slice("achados", 1, 0))
    none = F.array().cast("array<struct<a:int,b:int,diferentes:int>>")
    pairs = F.when(both == 0, none).when(both <= KEY_PAIRS, pairs_in_place(F.col("achados"), limit))
    return keys.select(
        *names, "iguais", *[f"ilegiveis_{i}" for i in numbers],
        F.transform(some, lambda c: F.struct(c["lado"].alias("lado"), c["linha"].alias("linha"))).alias("sobras"), pairs.alias("pares"))


def reconcile_keys(a: DataFrame, b: DataFrame, spec: CompareSpec) -> DataFrame:
    """Keys and rows per state: both, only one side, several versions."""
    per = _stacked(_rows(a, b, spec), spec).per
    dup = lambda s: F.sum(F.when(F.col(s) > 1, F.col(s) - 1).otherwise(0))
    return (
        per.groupBy("situacao")
        .agg(
            F.count("*").alias("chaves"), F.sum("linhas_a").alias("linhas_a"), F.sum("linhas_b").alias("linhas_b"),
            dup("linhas_a").alias("repeticoes_a"), dup("linhas_b").alias("repeticoes_b"),
        )
        .orderBy("situacao")
    )


def _judged(i: int, kind: str, tolerance: float) -> dict[str, Column]:
    """How the i-th cells of the compared pair relate; exactly one of same, near, bad and the two one-sided ones holds."""
    x, y = F.col(f"a.c{i}"), F.col(f"b.c{i}")
    empty_x, empty_y = (c["v"].isNull() & c["t"].isNull() for c in (x, y))
    same = x["v"].eqNullSafe(y["v"]) & x["t"].eqNullSafe(y["t"])
    close = F.lit(False)
    if kind == "double":
        # the slack absorbs the binary representation of the two amounts
        close = F.coalesce(F.abs(x["v"] - y["v"]) <= tolerance + 1e-9, F.lit(False))
    near = ~same & close
    return {
        "same": same, "near": near, "bad": ~same & ~near & ~empty_x & ~empty_y, "only_b": empty_x & ~empty_y, "only_a": ~empty_x & empty_y,
        "unread": x["t"].isNotNull() | y["t"].isNotNull(),
    }


def reconcile_columns(a: DataFrame, b: DataFrame, spec: CompareSpec) -> DataFrame:
    """Per column: compared cells, equal, within tolerance, divergent, one-sided, not readable as numbers."""
    kinds, equal_rows, pairs = _compared(a, b, spec)
    both = equal_rows.unionByName(pairs.select("a", "b"), allowMissingColumns=True)
    pair, equal = F.col("a").isNotNull(), F.coalesce(F.sum("iguais"), F.lit(0))
    rows = []
    for i, (c, kind) in enumerate(kinds.items()):
        j = _judged(i, kind, spec.tolerance)
        unread = F.coalesce(F.sum(f"ilegiveis_{i}"), F.lit(0)) if kind in ("double", "exact") else F.lit(0)
        rows.append({
            "coluna": F.lit(c),
            "regra": F.lit(kind),
            "comparadas": equal + count_if(pair),
            "identicas": equal + count_if(pair & j["same"]),
            "dentro_da_tolerancia": count_if(pair & j["near"]),
            "divergentes": count_if(pair & j["bad"]),
            "vazio_so_em_a": count_if(pair & j["only_b"]),
            "vazio_so_em_b": count_if(pair & j["only_a"]),
            "ilegiveis": unread + count_if(pair & j["unread"]),
        })
    out = stack_rows(both, rows)
    same = F.col("identicas") + F.col("dentro_da_tolerancia")
    return out.withColumn("pct_conforme", pct(same, F.col("comparadas"))).orderBy("coluna")


def reconcile_cells(a: DataFrame, b: DataFrame, spec: CompareSpec) -> DataFrame:
    """Every divergent cell: key, column and the two values."""
    kinds, _, pairs = _compared(a, b, spec)
    cells = []
    for i, (c, kind) in enumerate(kinds.items()):
        j = _judged(i, kind, spec.tolerance)
        places = _places(a.schema[c].dataType, b.schema[c].dataType) if kind == "exact" else 0
        shown = [F.coalesce(N.with_places(x["v"].cast("string"), places), x["t"]) for x in (F.col(f"a.c{i}"), F.col(f"b.c{i}"))]
        cells.append(F.when(
            ~j["same"] & ~j["near"], F.struct(F.lit(c).alias("coluna"), shown[0].alias("valor_a"), shown[1].alias("valor_b")),
        ))
    bad = F.filter(F.array(*cells), lambda s: s.isNotNull())
    return pairs.select(*[quoted(k) for k in spec.keys], F.inline(bad))


def reconcile_versions(a: DataFrame, b: DataFrame, spec: CompareSpec) -> DataFrame:
    """Contents left in keys with versions on both sides: each pair with what differs, and those without a counterpart.

    ``conteudo_a`` and ``conteudo_b`` are digests of key and cells, null for what is missing.
    """
    stack = _rows(a, b, spec)
    found, names = _versions(stack, spec), [quoted(k) for k in spec.keys]
    place = lambda p, n: F.get("sobras", p["ab"[n]])["linha"].alias("ab"[n])
    none = F.lit(None).cast(found.near.schema["sobras"].dataType.elementType["linha"].dataType)
    alone = lambda n: F.transform(
        F.filter("sobras", lambda c, i: (c["lado"] == n) & ~F.exists("pares", lambda p: p["ab"[n]] == i)),
        lambda c: F.struct((c["linha"] if n == 0 else none).alias("a"), (c["linha"] if n == 1 else none).alias("b"), F.lit(None).cast("int").alias("diferentes")))
    paired = F.transform("pares", lambda p: F.struct(place(p, 0), place(p, 1), p["diferentes"].alias("diferentes")))
    out = found.near.where("size(sobras) > 2 AND pares IS NOT NULL").select(*names, F.inline(F.concat(paired, alone(0), alone(1))))
    if found.contents:
        mine = lambda n: found.contents.where(F.col("lado") == n).select(
            F.col("id").alias("ab"[n]), F.col("linha").alias(f"linha_{n}"), *[F.col(k).alias(f"chave_{n}_{i}") for i, k in enumerate(names)])
        rest = mine(0).join(found.pairs, "a", "left").join(mine(1), "b", "full")
        key = [F.coalesce(f"chave_0_{i}", f"chave_1_{i}").alias(k) for i, k in enumerate(spec.keys)]
        out = out.unionByName(rest.select(*key, F.col("linha_0").alias("a"), F.col("linha_1").alias("b"), F.col("diferentes").cast("int")))
    digest = lambda x: F.when(F.col(x).isNotNull(), _id(F.col(x), stack.kinds, spec))
    differing = [F.when(~F.col(f"a.c{i}").eqNullSafe(F.col(f"b.c{i}")), c) for i, c in enumerate(stack.kinds)]
    return out.select(*names, digest("a").alias("conteudo_a"), digest("b").alias("conteudo_b"), F.col("diferentes").cast("long"),
                      F.when(F.col("diferentes").isNotNull(), F.concat_ws(", ", *differing)).alias("colunas"))


def reconcile_unmatched(a: DataFrame, b: DataFrame, spec: CompareSpec) -> DataFrame:
    """Keys without a counterpart, and keys with versions, with their row counts."""
    per = _stacked(_rows(a, b, spec), spec).per
    return per.where(F.col("situacao") != BOTH).select(*spec.keys, "situacao", "linhas_a", "linhas_b")
