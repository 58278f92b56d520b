"""Asking queries: the entry point for users."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.expressions import n3
from .operators import services as _services  # noqa: F401  they register themselves
from .operators.describe import describe
from .plans.algebra import Query, Triple, Var
from .plans.compiler import Compiler
from .plans.parser import parse_query
from .sources.graphs import Graph, QuadGraph, Solutions
from .terms import Term, Val


def native(v: Val) -> Column:
    """A value as an ordinary column: typed literals as they are, other terms by their lexical form."""
    return v.col if v.form == "literal" else v.lex()


def shaped(s: Solutions, form: str = "native") -> DataFrame:
    """Solutions as a DataFrame: ``native`` columns, ``terms`` (structs) or ``n3`` (strings)."""
    how = {"native": native, "terms": lambda v: v.term(), "n3": n3}[form]
    return s.df.select(*(how(v).alias(n) for n, v in s.variables.items()))


@dataclass
class Prepared:
    """A parsed query that can be bound and run again."""

    engine: Engine
    query: Query

    def bind(self, **values: Term) -> Prepared:
        """The query with some variables bound beforehand."""
        from .plans.algebra import Group, Values

        q = Query(**vars(self.query))
        names = [Var(n) for n in values]
        q.where = Group([Values(names, [list(values.values())]), *q.where.parts], q.where.hints)
        return Prepared(self.engine, q)

    def run(self, form: str = "native") -> DataFrame | bool:
        return self.engine.evaluate(self.query, form)


class Engine:
    """Queries over one graph."""

    def __init__(self, spark: SparkSession, graph: Graph, solution_sets: dict[str, DataFrame] | None = None, prefixes: dict[str, str] | None = None, remote=None):
        self.spark, self.graph = spark, graph
        self.solution_sets = solution_sets if solution_sets is not None else {}
        self.prefixes = prefixes or {}
        self.remote = remote

    def compiler(self) -> Compiler:
        return Compiler(self.spark, self.graph, self.solution_sets, self.remote)

    def prepare(self, text: str) -> Prepared:
        return Prepared(self, parse_query(text, self.prefixes))

    def query(self, text: str, form: str = "native") -> DataFrame | bool:
        """SELECT gives solutions, CONSTRUCT and DESCRIBE triples (s, p, o terms), ASK a truth value."""
        return self.prepare(text).run(form)

    def evaluate(self, q: Query, form: str = "native") -> DataFrame | bool:
        if job := q.hints.get("queryId"):
            self.spark.sparkContext.setJobGroup(job, job, True)
        if q.form == "ask":
            return self.compiler().ask(q)
        if q.form == "construct":
            return self.compiler().construct(q)
        if q.form == "describe":
            return describe(self.compiler(), q)
        return shaped(self.compiler().select(q), form)

    def explain(self, text: str) -> str:
        """Spark's formatted plan, and warnings of variables that are used where nothing binds them."""
        q = parse_query(text, self.prefixes)
        df = shaped(self.compiler().select(q)) if q.form == "select" else self.evaluate(q)
        plan = df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))  # noqa: SLF001
        return "".join(f"Warning: {w}\n" for w in unscoped(q)) + plan

    def cancel(self, query_id: str) -> None:
        self.spark.sparkContext.cancelJobGroup(query_id)

    # --- statements, as the REST interface has them

    def match(self, s: Term | None = None, p: Term | None = None, o: Term | None = None, g: Term | None = None) -> DataFrame:
        """Statements of a pattern as terms (s, p, o)."""
        at = [x or Var(n) for x, n in ((s, "s"), (p, "p"), (o, "o"))]
        found = self.graph.star([Triple(*at)], g)
        from .terms import constant

        return found.df.select(*((found.val(n).term() if isinstance(x, Var) else constant(x)).alias(n) for x, n in zip(at, "spo", strict=True)))

    def has(self, *pattern: Term | None) -> bool:
        return not self.match(*pattern).limit(1).isEmpty()

    def cardinality(self, *pattern: Term | None) -> int:
        return self.match(*pattern).count()

    def contexts(self) -> DataFrame:
        """The named graphs."""
        if not isinstance(self.graph, QuadGraph):
            return self.spark.createDataFrame([], "g string")
        return self.graph.quads.where("g is not null").where(F.col("st").isin(*self.graph.types)).select(F.col("g.lex").alias("g")).distinct()


def unscoped(q: Query) -> list[str]:
    """Variables that filters of a nested group use though only an outer group binds them."""
    from .plans.algebra import Filter, Group
    from .plans.compiler import variables

    out: list[str] = []

    def walk(g: Group, outer: set[str]) -> None:
        own = variables([p for p in g.parts if not isinstance(p, Filter)])
        used = variables([p.expr for p in g.parts if isinstance(p, Filter)])
        out.extend(f"?{n} is bound outside the group whose filter uses it" for n in sorted((used - own) & outer))
        for p in g.parts:
            for inner in [p] if isinstance(p, Group) else getattr(p, "groups", []):
                walk(inner, outer | own)

    walk(q.where, set())
    return out
