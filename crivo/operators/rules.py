"""Business rules. A rule is a name and a boolean Column; the rules of a report share one scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import labels as L
from ..functions import missing as M
from ..functions import normalize as N
from ..functions.ratios import count_if, pct
from ._shape import Section, extremes, semi_null_safe, stack_rows, total_of, type_name, quoted


def rule_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that satisfy each named predicate (suspicious combinations)."""
    return rule_section(rules).report(df)


def rule_section(rules: Mapping[str, Column]) -> Section:
    rows = [{"situacao": F.lit(n), "linhas": count_if(p)} for n, p in rules.items()]
    return Section(rows, lambda out: out.orderBy(F.desc("linhas"), "situacao"))


suspicious_combinations = rule_counts


def comparison_counts(
    df: DataFrame, checks: Mapping[str, Column], sums: Mapping[str, str] | None = None, places: int = 2
) -> DataFrame:
    """One wide row: rows, one count per check, one rounded sum per measure.

    Serves the quantity triple, gross against net, debit and credit signs and
    the paired-field cycles, which differ only in their predicates.
    """
    return df.agg(
        F.count("*").alias("linhas"),
        *[count_if(p).alias(n) for n, p in checks.items()],
        *[F.round(F.sum(df[quoted(c)]).cast("double"), places).alias(n) for n, c in (sums or {}).items()],
    )


def _difference(df: DataFrame, expr: Column, target: str | Column) -> Column:
    y = df[target] if isinstance(target, str) else target
    return F.abs(expr - y)


def equation_check(
    df: DataFrame, expr: Column, target: str | Column, tolerance: float = 0.001,
    inputs: Sequence[str] = (), places: int = 6,
) -> DataFrame:
    """Does ``expr`` give ``target`` on every row, within a tolerance?"""
    x = df.select(
        _difference(df, expr, target).alias("dif"),
        F.greatest(F.lit(False), *[df[quoted(c)].isNull() for c in inputs]).alias("falta")
        if inputs else F.lit(False).alias("falta"),
    )
    bad = count_if(F.col("dif") > tolerance)
    out = x.agg(
        F.count("*").alias("linhas"),
        count_if(F.col("dif") <= tolerance).alias("equacao_ok"),
        bad.alias("divergentes"),
        pct(bad, F.count("*"), 4).alias("pct_divergente"),
        F.round(F.max("dif").cast("double"), places).alias("maior_diferenca"),
        count_if(F.col("falta") | F.col("dif").isNull()).alias("com_campo_nulo"),
    )
    verdict = F.when(F.col("divergentes") == 0, L.EQUATION_OK).otherwise(L.EQUATION_ERROR)
    return out.withColumn("veredito", verdict)


def worst_divergences(
    df: DataFrame, expr: Column, target: str, keys: Sequence[str], tolerance: float = 0.001,
    k: int | None = None, places: int = 6,
) -> DataFrame:
    """Rows where the equation fails most."""
    diff = F.round(_difference(df, expr, target).cast("double"), places)
    out = (
        df.select(
            *keys, F.round(expr.cast("double"), places).alias("calculado"), df[target].alias("informado"),
            diff.alias("diferenca"), _difference(df, expr, target).alias("dif"),
        )
        .where(F.col("dif") > tolerance)
        .drop("dif")
        .orderBy(F.desc("diferenca"), *keys)
    )
    return out if k is None else out.limit(k)


def tax_check(
    df: DataFrame, taxes: Mapping[str, tuple[Column, Column, Column]], tolerance: float = 0.05
) -> DataFrame:
    """Base, value and rate of each tax: value without base, value off the formula.

    A tax is (base, rate in percent, value).
    """
    rows = []
    for name, (base, rate, value) in taxes.items():
        b, r, v = (F.coalesce(x, F.lit(0)) for x in (base, rate, value))
        rows.append({
            "tributo": F.lit(name),
            "com_base": count_if(b != 0),
            "com_valor": count_if(v != 0),
            "valor_sem_base": count_if((b == 0) & (v != 0)),
            "formula_diverge": count_if(F.abs(v - b * r / 100) > tolerance),
        })
    return stack_rows(df, rows).orderBy("tributo")


def redundant_columns(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Do two columns always say the same? Null and blank text are the same."""

    def same(a: str, b: str) -> Column:
        x, y = df[a], df[b]
        if isinstance(df.schema[a].dataType, T.StringType):
            x, y = F.coalesce(x, F.lit("")), F.coalesce(y.cast("string"), F.lit(""))
        return x.eqNullSafe(y)

    rows = [
        {
            "par": F.lit(f"{a} vs {b}"), "linhas": F.count("*"),
            "identicos": count_if(same(a, b)), "divergentes": count_if(~same(a, b)),
        }
        for a, b in pairs
    ]
    verdict = F.when(F.col("divergentes") == 0, L.REDUNDANT).otherwise(L.NOT_REDUNDANT)
    return stack_rows(df, rows).withColumn("veredito", verdict).orderBy("par")


def declared_constant(
    df: DataFrame, all_null: Sequence[str] = (), blank_or_zero: Sequence[str] = (),
    null_together: Sequence[str] = (),
) -> DataFrame:
    """Columns documented as never carrying information: is that so?"""
    rows = []
    for c in all_null:
        rows.append((c, df[quoted(c)].isNull(), L.DECLARED_ALL_NULL))
    for c in blank_or_zero:
        rows.append((c, F.trim(F.coalesce(df[quoted(c)].cast("string"), F.lit(""))).isin("", "0"), L.DECLARED_ALL_BLANK))
    if null_together:
        n = sum((F.when(df[quoted(c)].isNull(), 1).otherwise(0) for c in null_together), F.lit(0))
        rows.append((" + ".join(null_together), n.isin(0, len(null_together)), L.DECLARED_ALL_NULL))
    return (
        stack_rows(df, [
            {
                "coluna": F.lit(c), "nulos": count_if(p), "total": F.count("*"), "confirmado": F.lit(text),
            }
            for c, p, text in rows
        ])
        .withColumn(
            "veredito", F.when(F.col("nulos") == F.col("total"), F.col("confirmado")).otherwise(L.DECLARED_DIVERGES)
        )
        .drop("confirmado")
        .orderBy("coluna")
    )


def declared_domain(
    df: DataFrame, column: str, allowed: Sequence[str] | None = None, pattern: str | None = None
) -> DataFrame:
    """Values of a column with a verdict: in the declared set, or of the declared form."""
    bucket = M.display_bucket(df[quoted(column)])
    freq = df.groupBy(bucket.alias(column)).agg(F.count("*").alias("linhas"))
    v = F.col(column)
    inside = v.isin(*allowed) if allowed is not None else v.rlike(pattern)
    return freq.withColumn(
        "veredito", F.when(inside, L.DOMAIN_DECLARED).otherwise(L.DOMAIN_OUTSIDE)
    ).orderBy(F.desc("linhas"), column)


def code_description_map(df: DataFrame, code: str, description: str, as_list: bool = False) -> DataFrame:
    """Codes with more than one description.

    Descriptions are counted per (code, description) first. The pairs of the
    ambiguous codes come as rows, whatever number a code has. ``as_list`` gives
    all codes with a verdict and one text per code, put together for the
    ambiguous ones only; it is meant for codes with few descriptions each.
    """
    pairs = df.groupBy(df[code], df[description].cast("string").alias("descricao")).agg(F.count("*").alias("n"))
    if not as_list:
        bad = pairs.groupBy(code).agg(F.count("descricao").alias("q")).where("q > 1")
        return semi_null_safe(pairs, bad, [code]).withColumnRenamed("n", "linhas").orderBy(code, "descricao")
    per = pairs.groupBy(code).agg(
        F.count("descricao").alias("qtd_descricoes"), F.coalesce(F.min("descricao"), F.lit("")).alias("unica"), F.sum("n").alias("linhas"),
    )
    listed = semi_null_safe(pairs, per.where("qtd_descricoes > 1"), [code]).groupBy(F.col(code).alias("codigo_lista")).agg(
        F.concat_ws(" | ", F.sort_array(F.collect_set("descricao"))).alias("lista"))
    return (
        per.join(listed, F.col(code).eqNullSafe(F.col("codigo_lista")), "left")
        .select(code, "qtd_descricoes", F.coalesce("lista", "unica").alias("descricoes"), "linhas")
        .withColumn("veredito", F.when(F.col("qtd_descricoes") > 1, L.DESCRIPTION_ERROR).otherwise(L.OK))
        .orderBy(F.desc("qtd_descricoes"), F.desc("linhas"), code)
    )


def missing_description(df: DataFrame, code: str, description: str, k: int | None = None) -> DataFrame:
    """Codes whose description is blank on some rows."""
    gone = count_if(M.no_value(df[description]))
    out = (
        df.groupBy(code)
        .agg(F.count("*").alias("linhas"), gone.alias("sem_descricao"))
        .where("sem_descricao > 0")
        .orderBy(F.desc("sem_descricao"), code)
    )
    return out if k is None else out.limit(k)


def derived_column(df: DataFrame, columns: Sequence[str], rule: Column) -> DataFrame:
    """Each combination of the columns with its rows and whether the rule holds.

    The rule is evaluated on the combinations, so it may use only ``columns``,
    named with ``F.col``.
    """
    combos = df.groupBy(*columns).agg(F.count("*").alias("linhas"))
    ok = F.coalesce(rule, F.lit(False))
    return combos.withColumn("veredito", F.when(ok, L.OK).otherwise(L.DERIVED_DIVERGES)).orderBy(
        F.desc("linhas"), *columns
    )


def key_projection(
    df: DataFrame, composite: str, length: int, parts: Mapping[str, tuple[int, int]]
) -> DataFrame:
    """Do slices of a composite key equal the columns projected from it?

    ``parts`` maps a column to (first position, length), 1-based.
    """
    t = F.trim(df[composite])
    aggs = [
        F.count("*").alias("linhas"),
        count_if(F.length(t) == length).alias("chave_com_tamanho_esperado"),
        count_if(F.length(t) != length).alias("chave_com_tamanho_diferente"),
    ]
    for c, (pos, n) in parts.items():
        cut, own = N.strip_zeros(F.substring(t, pos, n)), N.text(df[quoted(c)])
        aggs += [count_if(cut == own).alias(f"{c}_ok"), count_if(cut != own).alias(f"{c}_divergente")]
    return df.agg(*aggs)


def key_projection_examples(
    df: DataFrame, composite: str, parts: Mapping[str, tuple[int, int]], k: int | None = None
) -> DataFrame:
    """Rows where a slice of the key differs from its column."""
    t = F.trim(df[composite])
    bad = F.lit(False)
    cols = [df[composite], F.length(t).alias("tamanho")]
    for c, (pos, n) in parts.items():
        raw = F.substring(t, pos, n)
        bad = bad | (N.strip_zeros(raw) != N.text(df[quoted(c)]))
        cols += [raw.alias(f"{c}_bruto"), N.strip_zeros(raw).alias(f"{c}_sem_zeros"), df[quoted(c)]]
    out = df.where(bad).select(*cols).orderBy(composite, *parts)
    return out if k is None else out.limit(k)


def quantity_value_coherence(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Quantity and value of a pair should be zero together and never negative."""
    rows = []
    for q, v in pairs:
        x, y = df[q], df[v]
        rows.append({
            "par": F.lit(f"{q} / {v}"),
            "linhas_com_estoque": count_if((x != 0) | (y != 0)),
            "qtd_zero_valor_nao": count_if((x == 0) & (y != 0)),
            "qtd_nao_valor_zero": count_if((x != 0) & (y == 0)),
            "qtd_negativa": count_if(x < 0),
        })
    return stack_rows(df, rows).orderBy("par")


def link_completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with and without each link column."""
    rows = []
    for c in columns:
        gone = count_if(M.no_value(df[quoted(c)]))
        rows.append({
            "vinculo": F.lit(c), "sem_vinculo": gone, "com_vinculo": F.count("*") - gone,
            "pct_sem_vinculo": pct(gone, F.count("*")),
        })
    return stack_rows(df, rows).orderBy(F.desc("pct_sem_vinculo"), "vinculo")


def flattening_loss(df: DataFrame, stored_items: str) -> DataFrame:
    """Rows kept against the number of items the row says it stands for."""
    n = df[stored_items]
    kept, items = F.count("*"), F.sum(F.coalesce(n, F.lit(0)))
    lost = items - kept
    return df.agg(
        kept.alias("linhas_na_view"),
        items.cast("bigint").alias("itens_na_origem"),
        lost.cast("bigint").alias("itens_descartados"),
        F.sum(F.greatest(F.coalesce(n, F.lit(0)) - 1, F.lit(0))).cast("bigint").alias("itens_adicionais"),
        pct(lost, items).alias("pct_descartado"),
        count_if(n > 1).alias("com_varios_itens"),
        count_if(n == 1).alias("com_item_unico"),
        F.max(n).cast("bigint").alias("maior_qtd_itens"),
    )


def flattening_histogram(df: DataFrame, stored_items: str, k: int | None = None) -> DataFrame:
    """Rows and lost items per stored item count."""
    n = F.col("itens")
    out = (
        df.groupBy(df[stored_items].cast("bigint").alias("itens"))
        .agg(F.count("*").alias("linhas"))
        .withColumn("itens_perdidos", n * F.col("linhas") - F.col("linhas"))
        .orderBy("itens")
    )
    return out if k is None else out.limit(k)


def header_replication(df: DataFrame, parent: str, fields: Sequence[str]) -> DataFrame:
    """Header fields repeated on items: is there one value per parent?

    Only "one value or more" is asked, so the smallest and largest value of each
    parent decide, and items are combined per parent before the shuffle.
    """
    per = df.groupBy(parent).agg(*[
        x.alias(f"f{i}_{j}")
        for i, c in enumerate(fields)
        for j, x in enumerate(extremes(F.when(M.has_value(df[quoted(c)]), df[quoted(c)]), df.schema[c].dataType))
    ])
    rows = []
    for i, c in enumerate(fields):
        pairs = [F.col(x) for x in per.columns if x.startswith(f"f{i}_")]
        several = F.lit(False)
        for lo, hi in zip(pairs[::2], pairs[1::2]):
            several = several | (lo != hi)
        rows.append({
            "campo": F.lit(c),
            "pais_com_valor": F.count(pairs[0]),
            "pais_com_mais_de_um_valor": count_if(several),
        })
    verdict = F.when(F.col("pais_com_mais_de_um_valor") == 0, L.REPLICATED).otherwise(L.NOT_REPLICATED)
    return stack_rows(per, rows).withColumn("veredito", verdict).orderBy("campo")


def orphan_items(df: DataFrame, header: Sequence[str], parent: str, also: str | None = None) -> DataFrame:
    """Items whose header fields are all null."""
    bare = F.lit(True)
    for c in header:
        bare = bare & df[quoted(c)].isNull()
    gone = count_if(bare)
    aggs = [
        F.count("*").alias("linhas"), gone.alias("sem_cabecalho"), pct(gone, F.count("*")).alias("pct_sem_cabecalho"),
        F.countDistinct(F.when(bare, df[parent])).alias("pais_sem_cabecalho"),
    ]
    if also is not None:
        aggs.append(count_if(bare & df[also].isNull()).alias(f"sem_cabecalho_e_sem_{also}"))
    return df.agg(*aggs)


def filter_impact(df: DataFrame, column: str, value: str) -> DataFrame:
    """Rows a filter loses because its column is blank."""
    blank, mine, t = M.no_value(df[quoted(column)]), df[quoted(column)] == value, F.count("*")
    return df.agg(
        t.alias("total_tabela"),
        count_if(blank).alias("sem_valor"),
        pct(count_if(blank), t).alias("pct_sem_valor"),
        count_if(mine).alias("linhas_do_cenario"),
        pct(count_if(mine), t).alias("pct_do_total"),
        count_if(~blank).alias("total_com_valor"),
    )


def filter_impact_profile(
    df: DataFrame, column: str, dim: str, filled: Sequence[str], k: int | None = None
) -> DataFrame:
    """What the rows with a blank filter column have in common."""
    out = (
        df.where(M.no_value(df[quoted(column)]))
        .groupBy(M.display_bucket(df[dim]).alias(dim))
        .agg(
            F.count("*").alias("linhas_sem_valor"),
            *[count_if(M.has_value(df[quoted(c)])).alias(f"com_{c}") for c in filled],
        )
        .orderBy(F.desc("linhas_sem_valor"), dim)
    )
    return out if k is None else out.limit(k)


def conversion(df: DataFrame, link: str, done: str, asked: str) -> DataFrame:
    """Share of requests turned into a document, and how quantities compare."""
    has = count_if(M.has_value(df[link]))
    d, a = df[done], df[asked]
    return df.agg(
        F.count("*").alias("linhas"),
        has.alias("convertidas"),
        (F.count("*") - has).alias("nao_convertidas"),
        pct(has, F.count("*")).alias("pct_convertido"),
        count_if(d > a).alias("maior_que_solicitado"),
        count_if(d == a).alias("quantidades_iguais"),
        count_if(d < a).alias("menor_que_solicitado"),
        count_if(d.isNull()).alias("sem_quantidade"),
    )


def fulfilment(df: DataFrame, by: Sequence[str], done: str, asked: str) -> DataFrame:
    """Fulfilment of quantities by status."""
    d, a = df[done], df[asked]
    return (
        df.groupBy(*[M.display_bucket(df[quoted(c)]).alias(c) for c in by])
        .agg(
            F.count("*").alias("linhas"),
            count_if(d == 0).alias("nada_retirado"),
            count_if((d > 0) & (d < a)).alias("parcial"),
            count_if(d == a).alias("total"),
            count_if(d > a).alias("a_maior"),
        )
        .orderBy(F.desc("linhas"), *by)
    )


def classify_first_match(df: DataFrame, classes: Mapping[str, str | Column]) -> DataFrame:
    """Class of each row by the first column (or predicate) that applies."""
    first = F.coalesce(*[
        F.when(M.has_value(df[quoted(c)]) if isinstance(c, str) else c, F.lit(name)) for name, c in classes.items()
    ], F.lit(L.UNCLASSIFIED))
    groups = df.groupBy(first.alias("classificacao")).agg(F.count("*").alias("linhas"))
    return groups.withColumn("pct", pct(F.col("linhas"), total_of(groups))).orderBy(F.desc("linhas"), "classificacao")


def status_matrix(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Rows and share of every combination of states."""
    groups = df.groupBy(*dims).agg(F.count("*").alias("linhas"))
    return groups.withColumn("pct", pct(F.col("linhas"), total_of(groups))).orderBy(F.desc("linhas"), *dims)


def decimal_precision_use(df: DataFrame, column: str, places: int = 2, shown: int = 6) -> DataFrame:
    """Would fewer decimal places have held every value?"""
    x = df[quoted(column)]
    fits = x == F.round(x, places)
    out = df.agg(
        F.count("*").alias("linhas"),
        count_if(x.isNull()).alias("nulos"),
        count_if(x == 0).alias("zerados"),
        count_if(x < 0).alias("negativos"),
        count_if(fits).alias("cabem"),
        count_if(~fits).alias("usam_mais_casas"),
        F.round(F.max(x).cast("double"), shown).alias("maximo"),
    )
    over = L.PRECISION_OVERSIZED.format(type_name(df, column), places)
    return out.withColumn("veredito", F.when(F.col("usam_mais_casas") == 0, over).otherwise(L.PRECISION_USED))


def sign_share(df: DataFrame, column: str, places: int = 3) -> DataFrame:
    """Zero, positive, negative and null shares of a balance."""
    x, t = df[quoted(column)], F.count("*")
    aggs = [t.alias("linhas")]
    for name, p in {"zero": x == 0, "positivo": x > 0, "negativo": x < 0, "nulo": x.isNull()}.items():
        aggs += [count_if(p).alias(name), pct(count_if(p), t).alias(f"pct_{name}")]
    return df.agg(*aggs, F.round(F.min(x).cast("double"), places).alias("menor"))


def enrichment_coverage(df: DataFrame, name: str, code: str) -> DataFrame:
    """How much of a joined-in description is there, in rows and in codes."""
    has = M.has_value(df[name])
    return df.agg(
        F.count("*").alias("linhas"),
        count_if(has).alias("com_nome"),
        count_if(~has).alias("sem_nome"),
        pct(count_if(has), F.count("*")).alias("pct_cobertura"),
        F.countDistinct(df[code]).alias("codigos_distintos"),
        F.countDistinct(F.when(~has, df[code])).alias("codigos_sem_nome"),
    )


def pii_aggregate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Personal columns as counts only: distinct and missing."""
    aggs = []
    for c in columns:
        aggs += [F.countDistinct(df[quoted(c)]).alias(f"{c}_distintos"), count_if(M.no_value(df[quoted(c)])).alias(f"sem_{c}")]
    return df.agg(*aggs)


def masked_distribution(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Rows per person under a short hash.

    Grouping is by the person, not by the hash, so two people whose short
    hashes agree stay two rows.
    """
    groups = df.groupBy(df[quoted(column)].alias("pessoa")).agg(F.count("*").alias("linhas"))
    share = pct(F.col("linhas"), total_of(groups)).alias("pct")
    out = groups.select(N.mask(F.col("pessoa")).alias(f"{column}_hash"), "linhas", share)
    out = out.orderBy(F.desc("linhas"), f"{column}_hash")
    return out if k is None else out.limit(k)


def rows_per_person(df: DataFrame, column: str, places: int = 2) -> DataFrame:
    """People and mean rows per person, nothing that identifies one."""
    per = df.groupBy(df[quoted(column)].alias("p")).agg(F.count("*").alias("n"))
    p, n = F.col("p"), F.col("n")
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("linhas"),
        F.count("p").alias("pessoas"),
        F.round(F.avg(F.when(p.isNotNull(), n)), places).alias("media_linhas_por_pessoa"),
        F.max(F.when(p.isNotNull(), n)).alias("maximo_linhas_por_pessoa"),
    )


def price_profile(
    df: DataFrame, by: str, price: str, accuracy: int = 10000, places: int = 2
) -> DataFrame:
    """Price levels per control code, with missing and non-positive prices."""
    x = df[price]
    return (
        df.groupBy(M.display_bucket(df[by]).alias(by))
        .agg(
            F.count("*").alias("linhas"),
            count_if(x.isNull() | (x == 0)).alias("sem_preco"),
            count_if(x < 0).alias("preco_negativo"),
            F.round(F.avg(x).cast("double"), places).alias("preco_medio"),
            F.round(F.percentile_approx(x, 0.5, accuracy).cast("double"), places).alias("mediana"),
            F.round(F.max(x).cast("double"), places).alias("maximo"),
        )
        .orderBy(F.desc("linhas"), by)
    )


def formula_profile(
    df: DataFrame, value: str, divisor: str, accuracy: int = 10000, places: int = 4
) -> DataFrame:
    """Profile of a computed ratio, with the rows whose divisor is zero or null."""
    x, d = df[value], df[divisor]
    return df.agg(
        F.count("*").alias("linhas"),
        count_if(x.isNull()).alias("nulos"),
        count_if(x == 0).alias("zerados"),
        count_if(x < 0).alias("negativos"),
        F.round(F.min(x).cast("double"), places).alias("minimo"),
        F.round(F.max(x).cast("double"), places).alias("maximo"),
        F.round(F.avg(x).cast("double"), places).alias("media"),
        F.round(F.percentile_approx(x, 0.5, accuracy).cast("double"), places).alias("mediana"),
        count_if(d.isNull() | (d == 0)).alias("divisor_zero_ou_nulo"),
    )


def split_by_period(
    df: DataFrame, by: Sequence[str], value: str, natures: Mapping[str, Column], places: int = 2
) -> DataFrame:
    """Sum of a measure by the nature of its period (carry-forward, regular, other)."""
    aggs = [F.count("*").alias("linhas")]
    for name, p in natures.items():
        aggs.append(F.round(F.sum(F.when(p, df[value]).otherwise(0)).cast("double"), places).alias(name))
    return df.groupBy(*by).agg(*aggs).orderBy(*by)


def null_share_by(df: DataFrame, by: str, columns: Sequence[str], places: int = 1) -> DataFrame:
    """Null count and share of columns per group (inbound against outbound)."""
    aggs = [F.count("*").alias("linhas")]
    for c in columns:
        gone = count_if(df[quoted(c)].isNull())
        aggs += [gone.alias(f"sem_{c}"), pct(gone, F.count("*"), places).alias(f"pct_sem_{c}")]
    return df.groupBy(by).agg(*aggs).orderBy(F.desc("linhas"), by)


def dimension_ranking(
    df: DataFrame, dim: str, document: str, value: str, k: int | None = None, places: int = 2
) -> DataFrame:
    """Largest values of a dimension with documents, amount and share."""
    out = (
        df.groupBy(M.display_bucket(df[dim]).alias(dim))
        .agg(
            F.count("*").alias("linhas"),
            F.countDistinct(document).alias("documentos"),
            F.round(F.sum(F.coalesce(df[value], F.lit(0))).cast("double"), places).alias("valor_total"),
        )
    )
    out = out.withColumn("pct", pct(F.col("linhas"), total_of(out))).orderBy(F.desc("linhas"), dim)
    return out if k is None else out.limit(k)


def required_keys(
    df: DataFrame, required: Sequence[str], patterns: Mapping[str, str] | None = None
) -> DataFrame:
    """Rows missing a required key, and rows whose text breaks its format."""
    aggs = [F.count("*").alias("linhas")]
    aggs += [count_if(M.no_value(df[quoted(c)])).alias(f"{c}_ausente") for c in required]
    for c, p in (patterns or {}).items():
        aggs.append(count_if(M.has_value(df[quoted(c)]) & ~N.text(df[quoted(c)]).rlike(p)).alias(f"{c}_formato_invalido"))
    return df.agg(*aggs)
