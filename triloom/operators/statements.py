"""Operators on statements: provenance, graphs, bulk presence, fused views, and proofs.

All take and give quads (s, p, o, g, st).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.graphs import AXIOM, EXPLICIT, HISTORY, INFERRED
from ..terms import RDF, Term
from .inference import RESOURCE, SAME, Rule, is_
from .ordering import spaced

KEY = ["s", "p", "o"]


def explicit_only(quads: DataFrame) -> DataFrame:
    return quads.where(F.col("st") == EXPLICIT)


def inferred_only(quads: DataFrame) -> DataFrame:
    return quads.where(F.col("st") == INFERRED)


def without_axioms(quads: DataFrame) -> DataFrame:
    return quads.where(F.col("st") != AXIOM)


def without_history(quads: DataFrame) -> DataFrame:
    return quads.where(F.col("st") != HISTORY)


def distinct_statements(quads: DataFrame) -> DataFrame:
    """Each (s, p, o) once, told before axiom before inferred, without its graph."""
    return quads.groupBy(*KEY).agg(F.min("st").alias("st"))


def in_graphs(quads: DataFrame, graphs: list[Term]) -> DataFrame:
    return quads.where(F.col("g.lex").isin([g.lex for g in graphs]))


def strip_graph(quads: DataFrame) -> DataFrame:
    return quads.drop("g")


def fused_view(focus: DataFrame, base: DataFrame) -> DataFrame:
    """Statements of either of two stores, each once; the focus store's type counts."""
    marked = focus.select(*KEY, "st").withColumn("from", F.lit(0)).union(base.select(*KEY, "st").withColumn("from", F.lit(1)))
    return marked.groupBy(*KEY).agg(F.min_by("st", "from").alias("st"))


def present(statements: DataFrame, quads: DataFrame, there: bool = True) -> DataFrame:
    """Statements that are (or are not) in a store."""
    return statements.join(quads.select(*KEY), KEY, "left_semi" if there else "left_anti")


def complete(statements: DataFrame, quads: DataFrame) -> DataFrame:
    """Statements with the type that a store has for them, NULL where it has none."""
    return statements.select(*KEY).join(distinct_statements(quads), KEY, "left")


def star(quads: DataFrame, predicates: list[str]) -> DataFrame:
    """Subjects that have all of some predicates: one row of lists for each, in one pass."""
    kept = quads.where(F.col("p.lex").isin(predicates))
    lists = [F.collect_set(F.when(F.col("p.lex") == p, F.col("o"))).alias(f"o{k}") for k, p in enumerate(predicates)]
    rows = kept.groupBy("s").agg(*lists)
    for k in range(len(predicates)):
        rows = rows.where(F.size(f"o{k}") > 0)
    return rows


def without_trivial(quads: DataFrame) -> DataFrame:
    """Without (x type Resource) and (x sameAs x)."""
    resource = is_("p", Term(3, RDF + "type")) & is_("o", RESOURCE)
    same = is_("p", SAME) & (F.col("s") == F.col("o"))
    return quads.where(~resource & ~same)


def supported(closed: DataFrame, told: DataFrame, rules: list[tuple[str, Rule]]) -> DataFrame:
    """Justifications: for each conclusion of a closure the names of rules that make it in one step."""
    out = None
    for name, rule in rules:
        made = rule(closed.select(*KEY)).distinct().withColumn("rule", F.lit(name))
        out = made if out is None else out.union(made)
    derived = out.join(told.select(*KEY), KEY, "left_anti")
    return derived.groupBy(*KEY).agg(F.array_sort(F.collect_set("rule")).alias("rules"))


def sample(quads: DataFrame, limit: int, seed: int = 1, even: bool = False) -> DataFrame:
    """Some statements: at random, or evenly over the order of subjects."""
    if not even:
        return quads.orderBy(F.rand(seed)).limit(limit)
    return spaced(quads, limit, *(F.col(f"{c}.{f}") for c in KEY for f in ("kind", "lex", "dt", "lang")))


def changes_between(changes: DataFrame, begin: float, end: float) -> DataFrame:
    """The change log of a stretch of time."""
    return changes.where((F.col("ts") >= begin) & (F.col("ts") < end))


def as_of(changes: DataFrame, when: float) -> DataFrame:
    """The told statements at a moment, from the change log alone; one update removes before it adds."""
    before = changes.where(F.col("ts") <= when)
    order = F.struct("ts", F.col("action") == "added")
    last = before.groupBy("s", "p", "o", F.to_json("g").alias("k")).agg(F.max_by("action", order).alias("action"), F.max_by("g", order).alias("g"))
    return last.where("action = 'added'").select("s", "p", "o", "g")
