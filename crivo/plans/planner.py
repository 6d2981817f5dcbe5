"""Whole profiles whose sections name the pass they read.

A section is a report over one of a few kinds of pass: aggregates of rows, value
frequencies, the key histogram, the version histogram of a key, or one of its own.
Sections are added one by one; equal passes are made once, aggregates of all
sections share passes of a bounded width, and value frequencies share one. ``run``
writes each pass to the shared folder and reads it back, so that reports never
repeat it, and a lost executor repeats a part of one pass at most.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import missing as M
from ..operators import codes, columns, dates, keys, report, rules, volume
from ..operators._shape import Section, as_text, hashed_counts, quoted, section_report, shared_passes, type_name, value_counts
from ..session import stored
from ..sources import metadata, scan, sink
from ..spec import TableSpec
from .explore import _typed

Build = Callable[[DataFrame], DataFrame]


class Profile:
    """Sections over one base, in the order they were added."""

    def __init__(self, base: DataFrame, spec: TableSpec, as_of: str | None = None):
        self.base, self.spec, self.as_of = base, spec, as_of
        self.typed = _typed(base, spec)
        self.order: list[str] = []
        self.lazy: dict[str, DataFrame] = {}
        self.row_sections: dict[str, Section] = {}
        self.counted: dict[str, tuple[dict, Build]] = {}
        self.own: dict[str, tuple[str, Build]] = {}
        self.makers: dict[str, Callable[[], DataFrame]] = {}

    # --- sections by the pass they name ---

    def direct(self, name: str, df: DataFrame) -> None:
        """A section that needs no pass, or whose rows are the report."""
        self.order.append(name)
        self.lazy[name] = df

    def rows(self, name: str, section: Section) -> None:
        """A section of aggregates over the rows."""
        self.order.append(name)
        self.row_sections[name] = section

    def values(self, name: str, cells: Mapping[str, object], build: Build) -> None:
        """A section over the frequencies of some cells; ``build`` gets those alone, as (coluna, valor, linhas)."""
        self.order.append(name)
        self.counted[name] = (dict(cells), build)

    def over(self, name: str, pass_name: str, make: Callable[[], DataFrame], build: Build = lambda x: x) -> None:
        """A section over a pass of another kind; sections that name the same pass share it."""
        self.order.append(name)
        self.makers.setdefault(pass_name, make)
        self.own[name] = (pass_name, build)

    # --- passes ---

    def passes(self) -> dict[str, DataFrame]:
        """What ``run`` makes, by name, not yet made."""
        out = {f"linha_{i}": p for i, p in enumerate(shared_passes(self.base, self.row_sections))} if self.row_sections else {}
        cells: dict = {}
        for wanted, _ in self.counted.values():
            cells |= wanted
        if cells:
            out["frequencias"] = value_counts(self.base, cells)
        return out | {name: make() for name, make in self.makers.items()}

    def run(self, work_dir: str | None = None) -> dict[str, DataFrame]:
        """Section -> report. The passes are made here; reports read their results."""
        folder = f"{work_dir.rstrip('/')}/perfil-{uuid.uuid4().hex}" if work_dir else None

        def keep(name: str, df: DataFrame) -> DataFrame:
            if folder is None:
                return stored(df, name)
            df.write.parquet(f"{folder}/{name}")
            return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

        made = {name: keep(name, p) for name, p in self.passes().items()}
        aggregates = [p for n, p in made.items() if n.startswith("linha_")]
        out = {}
        for name in self.order:
            if name in self.lazy:
                out[name] = self.lazy[name]
            elif name in self.row_sections:
                out[name] = section_report(aggregates, name, self.row_sections[name])
            elif name in self.counted:
                cells, build = self.counted[name]
                out[name] = build(made["frequencias"].where(F.col("coluna").isin(*cells)))
            else:
                pass_name, build = self.own[name]
                out[name] = build(made[pass_name])
        return out

    # --- the sections that profiles have in common ---

    def _texts(self, names: Sequence[str]) -> dict:
        return {n: as_text(self.base, n) for n in names}

    def _numbered(self, kind: str, names: Sequence[str]) -> dict:
        """Cells of days or instants as whole numbers, under names of their own beside the texts of the same columns."""
        number = F.unix_date if kind == "dia" else F.unix_micros
        dtype = "date" if kind == "dia" else "timestamp"
        return {f"{kind}:{n}": number(self.base[quoted(n)].cast(dtype)).cast("string") for n in names}

    @staticmethod
    def _as_numbers(freq: DataFrame, kind: str, dtype: str) -> DataFrame:
        name = F.substr("coluna", F.lit(len(kind) + 2))
        return freq.withColumns({"coluna": name, "valor": F.col("valor").cast(dtype)})

    def add_keys(self) -> None:
        if self.spec.keys:
            hist = lambda: keys.key_histogram(self.base, self.spec.keys)
            self.over("grain", "chaves", hist, lambda h: keys.grain_of(h, self.spec.keys))
            self.over("duplicates", "chaves", hist, lambda h: keys.duplicate_summary_of(h, self.spec.keys))

    def add_versions(self, short: bool = False) -> None:
        if self.spec.keys:
            hist = lambda: keys.version_histogram(self.base, self.spec.key)
            self.over("versions", "versoes", hist, keys.repeated_versions_of if short else keys.pure_vs_version_of)
            self.over("checksum", "versoes", hist, keys.row_checksum_of)

    def add_repeated(self) -> None:
        if self.spec.keys:
            safe = [c for c in self.base.columns if c not in self.spec.pii]
            self.over("varying_columns", "variacao", lambda: keys.varying_columns(self.base, self.spec.key, safe))
            self.over("duplicate_keys", "repetidas", lambda: keys.duplicate_keys(self.base, self.spec.key))

    def add_fill(self, mode: str = "f1", exact: bool = False, names: Sequence[str] | None = None) -> None:
        """Fill of all columns; distinct counts of ``names``, by sketch with the fill or exactly in a pass of their own."""
        self.rows("fill", columns.fill_section(self.base, self.base.columns, mode))
        names = list(names if names is not None else self.base.columns)
        if exact and names:
            self.over("cardinality", "distintos", lambda: columns.distinct_counts(self.base, names), lambda d: columns.cardinality_of(d, mode))
        elif names:
            self.rows("cardinality", columns.cardinality_section(self.base, names, mode))

    def add_columns(self, totals: bool = True) -> None:
        """The sections that depend on column roles only."""
        c, base = self.typed, self.base
        if c["categories"]:
            self.values("domain", self._texts(c["categories"]), columns.domain_of)
        if c["flags"]:
            self.rows("flags", columns.flag_section(base, c["flags"]))
        if c["numbers"]:
            self.rows("numeric_profile", columns.numeric_section(base, c["numbers"]))
            if totals:
                self.rows("totals", columns.totals_section(base, c["numbers"]))
        if c["text_dates"]:
            self.rows("string_dates", dates.string_date_section(base, c["text_dates"]))
            self.rows("valid_date_range", dates.valid_range_section(base, c["text_dates"]))
        if c["text_times"]:
            self.values("times", self._texts(c["text_times"]), dates.time_profile_of)
        if c["native_dates"]:
            self.values("native_dates", self._numbered("dia", c["native_dates"]), lambda f: dates.native_date_profile_of(self._as_numbers(f, "dia", "int"), self.as_of))
        if c["stamps"]:
            self.values("timestamps", self._numbered("instante", c["stamps"]), lambda f: dates.timestamp_profile_of(self._as_numbers(f, "instante", "bigint")))
        if c["codes"]:
            self.values("codes", self._texts(c["codes"]), lambda f: codes.code_format_of(f, {x: type_name(base, x) for x in c["codes"]}))

    def add_dimensions(self) -> None:
        for d in self.spec.dimensions:
            def build(freq: DataFrame, d: str = d) -> DataFrame:
                groups = freq.groupBy(M.display_bucket(F.col("valor")).alias(d)).agg(F.sum("linhas").alias("linhas"))
                return volume.scenario_candidates_of(groups, d)

            self.values(f"distribution_{d}", self._texts([d]), build)

    def add_freshness(self) -> None:
        ingest = self.spec.ingest
        if ingest:
            days = self._numbered("dia", [ingest])
            self.values("freshness", days, lambda f: dates.freshness_of(self._as_numbers(f, "dia", "int"), self.as_of))
            self.values("snapshot", days, lambda f: dates.snapshot_of(self._as_numbers(f, "dia", "int").select(F.date_from_unix_date("valor").alias("d")), ingest))

    def add_rules(self) -> None:
        if self.spec.declared_empty:
            self.rows("declared_empty", columns.declared_empty_section(self.base, self.spec.declared_empty))
        if self.spec.rules:
            self.rows("rules", rules.rule_section(self.spec.rules))
        if self.spec.date_rules:
            self.rows("date_order", dates.date_order_section(self.base, self.spec.date_rules))
        if self.spec.pii:
            self.over("pii", "pessoais", lambda: rules.pii_aggregate(self.base, self.spec.pii))

    def add_samples(self) -> None:
        self.direct("sample", sink.extract(self.base, pii=self.spec.pii).limit(20))
        self.direct("random_sample", scan.sample_random(sink.extract(self.base, pii=self.spec.pii)))


def explore_profile(df: DataFrame, spec: TableSpec, params: Mapping[str, object | None] | None = None, as_of: str | None = None, exact: bool = False) -> Profile:
    """The exploratory profile of a table or a filtered base."""
    p = Profile(scan.base_view(spec.apply(df), params or {}), spec, as_of)
    p.direct("metadata", metadata.describe_columns(p.base))
    p.add_keys()
    p.add_fill(exact=exact)
    p.add_columns()
    p.add_dimensions()
    p.add_versions()
    p.add_repeated()
    p.add_freshness()
    p.add_rules()
    p.add_samples()
    if spec.keys:
        p.over("summary", "chaves", lambda: keys.key_histogram(p.base, spec.keys), lambda h: report.summary_of(h, spec.keys, len(p.base.columns), spec.clustering))
    return p


def scenario_profile(df: DataFrame, spec: TableSpec, as_of: str | None = None, exact: bool = False) -> Profile:
    """The profile of ``spec.scenario_column = spec.scenario_value``; what the filter does to the table comes from one pass over its values."""
    if spec.scenario_column is None or spec.scenario_value is None:
        raise ValueError("a scenario needs scenario_column and scenario_value")
    col, value = spec.scenario_column, spec.scenario_value
    p = Profile(spec.apply(df), spec, as_of)
    p.direct("metadata", metadata.describe_columns(df))
    per_value = lambda: df.groupBy(df[quoted(col)].alias("v")).agg(F.count("*").alias("n"))
    p.over("volume", "valores_do_filtro", per_value, lambda v: volume.scenario_share_of(v, value))
    p.over("filter_impact_forms", "valores_do_filtro", per_value, lambda v: volume.filter_completeness_of(v, value))
    p.over("gate", "valores_do_filtro", per_value, lambda v: volume.scenario_gate_of(v.where(F.col("v") == value)))
    p.add_keys()
    p.add_versions()
    p.add_repeated()
    p.add_fill(exact=exact)
    p.add_columns()
    if spec.keys:
        p.over("normalized_keys", "chaves_normalizadas", lambda: codes.normalized_keys(p.base, spec.key))
    p.add_dimensions()
    p.add_freshness()
    p.add_rules()
    p.direct("sample", sink.extract(p.base, pii=spec.pii).limit(20))
    p.direct("extraction", sink.extract(p.base, order=spec.key, pii=spec.pii))
    if spec.keys:
        facts = {"tabela": spec.name, "filtro": f"{col} = {value}"}
        p.over("summary", "chaves", lambda: keys.key_histogram(p.base, spec.keys), lambda h: report.scenario_summary_of(h, spec.keys, len(p.base.columns), facts))
    return p


def canary_profile(df: DataFrame, spec: TableSpec, as_of: str | None = None) -> Profile:
    """The short profile: masked personal columns, an expected volume, exact distinct counts of codes and categories."""
    p = Profile(spec.apply(df), spec, as_of)
    c = p.typed
    p.direct("metadata", metadata.describe_columns(p.base))
    if spec.entities:
        p.over("volume", "entidades", lambda: volume.volumetry(p.base, spec.entities))
    p.add_dimensions()
    p.add_keys()
    p.add_versions(short=True)
    p.add_repeated()
    p.add_fill("f3", exact=True, names=[*c["codes"], *c["categories"]])
    p.add_columns()
    text_codes = [x for x in c["codes"] if dict(p.base.dtypes)[x] == "string"]
    if text_codes:
        p.over("numeric_codes", "codigos_numericos", lambda: codes.numeric_code_format(p.base, text_codes))
    p.add_freshness()
    p.add_rules()
    p.add_samples()
    if spec.expected_rows is not None:
        p.rows("volume_check", volume.volume_check_section(spec.expected_rows))
    return p


#: Columns that name what a row of a report speaks of, in this order, and those that judge it.
#: Sections of rows of the table, or of all its keys, which are no report.
ROWS = ("metadata", "sample", "random_sample", "extraction", "normalized_keys")

ITEMS = ("bloco", "item", "entidade", "filtro", "chave", "coluna", "regra", "par", "flag", "valor", "valor_bruto", "literal", "secao_item", "posicao")
VERDICTS = ("veredito", "classificacao", "perfil", "situacao", "sugestao", "alerta")


def long_report(sections: Mapping[str, DataFrame], leave_out: Sequence[str] = ROWS) -> DataFrame:
    """(secao, item, medida, valor, veredito): all sections as one report, a row for each measure of each of their rows.

    Numbers that aren't whole are written with four places; a measure without a value is null.
    """
    parts = []
    for name, df in sections.items():
        if name in leave_out:
            continue
        types = {f.name: f.dataType for f in df.schema.fields}
        item = [c for c in ITEMS if c in types] or [c for c in df.columns[:1] if isinstance(types[c], T.StringType) and c not in VERDICTS]
        verdict = [c for c in VERDICTS if c in types and c not in item][:1]
        measures = [c for c in df.columns if c not in item and c not in verdict]
        if not measures:  # the last of what names a row is what it says
            item, measures = item[:-1], item[-1:]
        written = F.array(*[F.struct(F.lit(c).alias("medida"), _written(df, c).alias("valor")) for c in measures])
        shown = F.concat_ws(" | ", *[F.coalesce(df[quoted(c)].cast("string"), F.lit("(nulo)")) for c in item])
        judged = df[quoted(verdict[0])] if verdict else F.lit(None).cast("string")
        parts.append(df.select(F.lit(name).alias("secao"), shown.alias("item"), judged.alias("veredito"), F.inline(written)).select(
            "secao", "item", "medida", "valor", "veredito"))
    return reduce(DataFrame.unionByName, parts)


def _written(df: DataFrame, c: str):
    if isinstance(df.schema[c].dataType, (T.FractionalType, T.DecimalType)):
        return df[quoted(c)].cast("decimal(38,4)").cast("string")
    return df[quoted(c)].cast("string")
