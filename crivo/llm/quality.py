"""Quality as a sparse ensemble of rules over statistics of a text.

Trees of a random forest are taken apart into their paths: conjunctions of
bounds on statistics. A logistic regression with lasso weighs these rules and
leaves few of them; those, as a sum of CASE expressions, are the score. Both
fits run in Spark over the labelled rows' statistics, of which a sample of
bounded size is taken by a digest of the id.

Null and empty texts have all statistics zero and get the score these earn. An
id labelled more than once counts with its lowest label; null labels and ids
count for nothing; of several rows of a labelled id one is learnt from. With no labelled row the score is 0.5, with labels of one
kind only it is their smoothed share. Rows repeat as they are.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Most labelled rows that a fit uses.
MAX_FIT_ROWS = 20_000
TREES, DEPTH, LASSO = 10, 3, 0.001


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text as columns; shares are of its characters, words or lines."""
    t = F.coalesce(text, F.lit(""))
    chars = F.length(t)
    words = F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "")
    lines = F.split(t, "\n")
    n = F.size(words)
    share = lambda pattern: F.when(chars > 0, 1 - F.length(F.regexp_replace(t, pattern, "")) / chars).otherwise(0.0)
    of = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return {
        "log_words": F.log1p(n),
        "word_length": of(chars, n),
        "distinct_words": of(F.size(F.array_distinct(words)), n),
        "distinct_lines": of(F.size(F.array_distinct(lines)), F.when(chars > 0, F.size(lines)).otherwise(0)),
        "words_a_line": of(n, F.size(lines)),
        "capitals": share(r"\p{Lu}"),
        "digits": share(r"\d"),
        "stops": share(r"[.,;:?]"),
        "shouts": share(r"[!¡]"),
        "bars": share(r"[|/\\\\\[\]{}<>()_=~^]"),
        "signs": share(r"[#$%&*@+]"),
        "spaces": share(r"\s"),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of bounds: (statistic, lower bound exclusive or None, upper bound inclusive or None)."""

    bounds: tuple[tuple[str, float | None, float | None], ...]

    def column(self) -> Column:
        out = None
        for name, low, high in self.bounds:
            for c in ([] if low is None else [F.col(name) > low]) + ([] if high is None else [F.col(name) <= high]):
                out = c if out is None else out & c
        return out


@dataclass(frozen=True)
class RuleEnsemble:
    """Rules with their weights, and what a text scores (as log odds) if none holds."""

    base: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, df: DataFrame, text: str = "text", name: str = "score") -> DataFrame:
        """``df`` with the score (0 to 1) under ``name``."""
        stats = statistics(common.col(text))
        used = [n for n in stats if any(n == b for rule, _ in self.rules for b, _, _ in rule.bounds)]
        together, *names = common.private(df, "statistics_", *used)
        taken = dict(zip(used, names))
        odds = F.lit(self.base)
        for rule, weight in self.rules:
            renamed = Rule(tuple((taken[n], low, high) for n, low, high in rule.bounds))
            odds = odds + F.when(renamed.column(), weight).otherwise(0.0)
        if used:
            # worked out once per text: a filter on the score must not be pushed to where it would work them out for every rule
            df_stats = df.withColumn(together, F.struct(*[stats[n].alias(taken[n]) for n in used]))
            scored = df_stats.select(*[common.col(c) for c in df.columns], F.inline(F.array(together)))
        else:
            scored = df
        return scored.select(*[common.col(c) for c in df.columns], (1 / (1 + F.exp(-odds))).alias(name))


def tree_rules(text: str, names: list[str]) -> list[Rule]:
    """The paths of a tree, given as Spark prints it: one rule for every node below the root."""
    out, path = [], []
    for line in text.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-0-9.eE]+)\)", line)
        if not m:
            continue
        depth = sum(1 for indent, *_ in path if indent < len(m[1]))
        path = path[:depth] + [(len(m[1]), names[int(m[2])], m[3], float(m[4]))]
        bounds: dict[str, list] = {}
        for _, name, side, at in path:
            low, high = bounds.setdefault(name, [None, None])
            if side == ">":
                bounds[name][0] = at if low is None else max(low, at)
            else:
                bounds[name][1] = at if high is None else min(high, at)
        out.append(Rule(tuple(sorted((n, *b) for n, b in bounds.items()))))
    return out


def training_rows(labels: DataFrame, fit_rows: int = MAX_FIT_ROWS, id: str = "doc_id", label: str = "quality") -> DataFrame:
    """(id_, label_) of at most ``fit_rows`` labelled ids, the first by a digest of the id."""
    known = labels.select(common.col(id).alias("id_"), common.col(label).cast("double").alias("label_")).dropna()
    return known.groupBy("id_").agg(F.min("label_").alias("label_")).orderBy(F.xxhash64("id_"), "id_").limit(fit_rows)


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
        fit_rows: int = MAX_FIT_ROWS, seed: int = 7) -> RuleEnsemble:
    """Learns from the labelled rows among ``docs``; at most ``fit_rows`` ids, so that they may be broadcast."""
    chosen = training_rows(labels, fit_rows, id, label)
    rows = docs.select(common.col(id).alias("id_"), common.col(text).alias("text_")).join(F.broadcast(chosen), "id_")
    stats = statistics(F.col("text_"))
    names = list(stats)
    # one row for each id, of the text with the smallest digest: an id that many rows share weighs as one
    rows = rows.select("id_", "label_", F.struct(F.xxhash64("text_").alias("digest_"), *[c.alias(n) for n, c in stats.items()]).alias("row_"))
    rows = rows.groupBy("id_", "label_").agg(F.min("row_").alias("row_")).select("id_", "label_", *[F.col(f"row_.{n}").alias(n) for n in names])
    # few rows of numbers: in a fixed order, so that the fit is the same each time
    rows = common.stored(rows.orderBy("id_", *names).coalesce(1), "statistics").cache()
    try:
        n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("label_"), F.lit(0.0))).first()
        share = (positive + 1) / (n + 2)
        alike = RuleEnsemble(float(math.log(share / (1 - share))), ())
        if not 0 < positive < n:
            return alike
        vectors = VectorAssembler(inputCols=names, outputCol="vector").transform(rows).select("label_", *names, "vector")
        forest = RandomForestClassifier(labelCol="label_", featuresCol="vector", numTrees=TREES, maxDepth=DEPTH, bootstrap=False,
                                        featureSubsetStrategy="0.5", minInstancesPerNode=5, seed=seed).fit(vectors)
        rules = list(dict.fromkeys(r for tree in forest.trees for r in tree_rules(tree.toDebugString, names)))
        if not rules:  # no statistic parts the labels: few rows, or rows that are all alike
            return alike
        held = rows.select("label_", *[F.when(r.column(), 1.0).otherwise(0.0).alias(f"r{i}") for i, r in enumerate(rules)])
        held = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="vector").transform(held).select("label_", "vector")
        model = LogisticRegression(labelCol="label_", featuresCol="vector", elasticNetParam=1.0, regParam=LASSO, maxIter=50,
                                   standardization=False).fit(held)
    finally:
        rows.unpersist()
    weights = [float(w) for w in model.coefficients]
    return RuleEnsemble(float(model.intercept), tuple((r, w) for r, w in zip(rules, weights) if abs(w) > 1e-6))
