"""DESCRIBE in its four modes."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.algebra import Query, Triple, Var
from ..sources.graphs import Solutions
from ..store import written
from ..terms import BNODE, TERM_DDL, Term, constant

FORWARD, SYMMETRIC, CBD, SCBD = "ForwardOneStep", "SymmetricOneStep", "CBD", "SCBD"


def statements(graph, g: object = None) -> DataFrame:
    """All statements as terms."""
    found = graph.star([Triple(Var("s"), Var("p"), Var("o"))], g)
    return found.df.select(*(found.val(n).term().alias(n) for n in "spo"))


def resources(compiler, q: Query) -> DataFrame:
    """The terms to describe, as ``x``."""
    fixed = [t for t in q.describe if isinstance(t, Term)]
    rows = [compiler.spark.range(1).select(constant(t).alias("x")) for t in fixed]
    names = [v.name for v in q.describe if isinstance(v, Var)]
    if names or not q.describe:
        inner = Query("select", q.where, [(Var(n), None) for n in names] or None, True, default_graphs=q.default_graphs, named_graphs=q.named_graphs, group_by=q.group_by, having=q.having, order_by=q.order_by, limit=q.limit, offset=q.offset, values=q.values, named=q.named, hints=q.hints)
        found: Solutions = compiler.select(inner)
        rows += [found.df.select(v.term().alias("x")) for v in found.variables.values()]
    every = reduce(DataFrame.union, rows) if rows else compiler.spark.range(0).select(F.lit(None).cast(TERM_DDL).alias("x"))
    return every.where("x is not null and x.kind < 4").distinct()


def describe(compiler, q: Query) -> DataFrame:
    """Statements (s, p, o) about resources.

    Forward takes statements of which they are the subject, symmetric also the
    object; the bounded descriptions go on through blank nodes, within the limits
    on iterations and statements that hints set.
    """
    mode = q.hints.get("describeMode", SYMMETRIC)
    most = int(q.hints.get("describeIterationLimit", 0))
    limit = int(q.hints.get("describeStatementLimit", 0))
    every = statements(compiler.graph.using(q.default_graphs, q.named_graphs) if q.default_graphs or q.named_graphs else compiler.graph)
    both = mode in (SYMMETRIC, SCBD)

    def about(x: DataFrame) -> DataFrame:
        forward = every.join(x.select(F.col("x").alias("s")), "s", "left_semi").select("s", "p", "o")
        if not both:
            return forward
        return forward.union(every.join(x.select(F.col("x").alias("o")), "o", "left_semi").select("s", "p", "o")).distinct()

    x = resources(compiler, q)
    found = about(x)
    if mode in (CBD, SCBD):
        seen = x = written(x)
        found = written(found)
        for _ in range(most) if most else count():
            ends = found.select(F.col("o").alias("x"))
            if both:
                ends = ends.union(found.select("s"))
            x = written(ends.where(F.col("x.kind") == BNODE).distinct().join(seen, "x", "left_anti"))
            if x.isEmpty() or limit and found.count() >= limit:
                break
            seen = seen.union(x)
            found = written(found.union(about(x)).distinct())
    return found.limit(limit) if limit else found
