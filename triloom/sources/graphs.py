"""Graphs that triple patterns scan: quad tables, and ordinary tables seen as a graph.

A scan takes triples that share a subject (a star) and gives a DataFrame with a
column for each variable.  Table graphs read a star from one table in one scan of
just the columns it names, with filters that reach the Parquet reader; quad
graphs join one scan for each triple on the subject.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.algebra import Quoted, Triple, Var
from ..terms import BOOLEAN, DATE, DATETIME, IRI, RDF, STRING, TERM_DDL, XSD, Term, Val, constant, iri, of_constant

QUADS_DDL = f"s {TERM_DDL}, p {TERM_DDL}, o {TERM_DDL}, g {TERM_DDL}, st tinyint"
#: Statement types.
EXPLICIT, AXIOM, INFERRED, HISTORY = 0, 1, 2, 3


@dataclass
class Solutions:
    """Solutions of a pattern: a DataFrame with a column ``v_name`` for each variable.

    ``maybe`` are the variables that may be unbound.
    """

    df: DataFrame
    variables: dict[str, Val]
    maybe: set[str] = field(default_factory=set)

    @classmethod
    def of(cls, df: DataFrame, values: dict[str, Val], maybe: set[str] | None = None) -> Solutions:
        """Names the columns of some values of ``df``."""
        named = df.select(*(v.col.alias(f"v_{n}") for n, v in values.items())) if values else df.select(F.lit(1).alias("v_"))
        return cls(named, {n: v.on(F.col(f"`v_{n}`")) for n, v in values.items()}, set(maybe or ()))

    def val(self, name: str) -> Val:
        return self.variables[name]


class Graph(Protocol):
    """What patterns are matched against."""

    def star(self, triples: list[Triple], graph: object) -> Solutions: ...

    def estimate(self, triple: Triple) -> float: ...


def _same(a: Val, b: Val) -> Column:
    return a.col == b.col if a.type_key() == b.type_key() else a.term() == b.term()


def _matches(v: Val, want: Term) -> Column:
    """A filter for a constant, in a form that reaches the reader."""
    if v.form == "term":
        out = (v.col["kind"] == want.kind) & (v.col["lex"] == want.lex)
        if want.kind == 4:
            out &= F.coalesce(v.col["dt"], F.lit(STRING)) == (want.dt or STRING)
            if want.lang:
                out &= F.lower(v.col["lang"]) == want.lang.lower()
        return out
    if v.form == "iri":
        if want.kind != IRI:
            return F.lit(False)
        if v.prefix is None:
            return v.col == want.lex
        if not want.lex.startswith(v.prefix):
            return F.lit(False)
        return v.col == F.lit(want.lex[len(v.prefix) :]).try_cast(v.dt or "string")
    w = of_constant(want)
    if w.form != "literal" or w.dt != v.dt and not (w.rank and v.rank):
        return F.lit(False)
    return v.col == w.col


class QuadGraph:
    """A table of quads (s, p, o, g terms; st the statement type).

    Without a graph, patterns see the RDF merge of the default graphs: all quads
    if none are named, each triple once.
    """

    def __init__(self, quads: DataFrame, default: list[Term] | None = None, named: list[Term] | None = None, distinct: bool | None = None, types: tuple[int, ...] = (EXPLICIT, AXIOM, INFERRED), counts: dict[str, int] | None = None):
        self.quads = quads
        self.default, self.named = default, named
        self.distinct, self.types = distinct, types
        self.counts = counts or {}

    def using(self, default: list[Term], named: list[Term]) -> QuadGraph:
        """This graph under a dataset clause."""
        return QuadGraph(self.quads, default, named, self.distinct, self.types, self.counts)

    def hinted(self, hints: dict[str, str]) -> QuadGraph:
        out = QuadGraph(self.quads, self.default, self.named, self.distinct, self.types, self.counts)
        if hints.get("defaultGraphDistinctFilter", "").lower() == "false":
            out.distinct = False
        if hints.get("history", "").lower() == "true":
            out.types = (*self.types, HISTORY)
        return out

    def estimate(self, triple: Triple) -> float:
        """Rows of a pattern, from the counts of predicates where they are known."""
        n = float(self.counts.get(triple.p.lex, 10_000)) if isinstance(triple.p, Term) else 1e7
        if isinstance(triple.s, Term):
            n /= 1e5
        if isinstance(triple.o, Term):
            n /= 1e3
        return n

    def _rows(self, triple: Triple, graph: object) -> DataFrame:
        rows = self.quads.where(F.col("st").isin(*self.types))
        if graph is None:
            if self.default is not None:
                names = [g.lex for g in self.default]
                rows = rows.where(F.col("g.lex").isin(names)) if names else rows.where(F.lit(False))
        else:
            rows = rows.where(F.col("g").isNotNull())
            if isinstance(graph, Term):
                rows = rows.where(F.col("g.lex") == graph.lex)
            if self.named is not None:
                rows = rows.where(F.col("g.lex").isin([g.lex for g in self.named]) if self.named else F.lit(False))
        for at, x in zip("spo", (triple.s, triple.p, triple.o), strict=True):
            if isinstance(x, Term):
                rows = rows.where(_matches(Val(F.col(at)), x))
        return rows

    def triple(self, triple: Triple, graph: object = None) -> Solutions:
        """The matches of one pattern."""
        rows = self._rows(triple, graph)
        wanted: dict[str, Val] = {}
        for at, x in zip(("s", "p", "o", "g"), (triple.s, triple.p, triple.o, graph), strict=True):
            if isinstance(x, Quoted):
                text = F.regexp_extract_all(F.col(f"{at}.lex"), F.lit(r'<[^<>]*>|_:[^\s>]+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z-]+|\^\^<[^>]*>)?'), F.lit(0))
                rows = rows.where(F.col(f"{at}.kind") == 2)
                for k, y in enumerate((x.s, x.p, x.o)):
                    part = parse_n3(F.get(text, F.lit(k)))
                    if isinstance(y, Var):
                        if y.name in wanted:
                            rows = rows.where(wanted[y.name].col == part)
                        else:
                            wanted[y.name] = Val(part)
                    else:
                        rows = rows.where(_matches(Val(part), y))
            elif isinstance(x, Var):
                if x.name in wanted:
                    rows = rows.where(wanted[x.name].col == F.col(at))
                else:
                    wanted[x.name] = Val(F.col(at))
        if graph is None and self.distinct is not False and (self.distinct or self.default is None or len(self.default) != 1):
            rows = rows.dropDuplicates(["s", "p", "o"])
        return Solutions.of(rows, wanted)

    def star(self, triples: list[Triple], graph: object = None) -> Solutions:
        from ..operators.joins import inner

        return reduce(inner, (self.triple(t, graph) for t in triples))

    def nodes(self, graph: object = None) -> Solutions:
        """All subjects and objects, each once, as ``x``."""
        rows = self._rows(Triple(Var("s"), Var("p"), Var("o")), graph)
        return Solutions.of(rows.select(F.col("s").alias("x")).union(rows.select("o")).distinct(), {"x": Val(F.col("x"))})


def parse_n3(text: Column) -> Column:
    """A term from its N-Triples form, as a struct."""
    inner = F.regexp_extract(text, r'^"((?:[^"\\]|\\.)*)"', 1)
    for a, b in (("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ('\\"', '"'), ("\\\\", "\\")):
        inner = F.replace(inner, F.lit(a), F.lit(b))
    lang = F.nullif(F.regexp_extract(text, r'"@([A-Za-z0-9-]+)$', 1), F.lit(""))
    dt = F.nullif(F.regexp_extract(text, r'"\^\^<([^>]*)>$', 1), F.lit(""))
    make = lambda kind, lex, d=None, g=None: F.struct(F.lit(kind).cast("tinyint").alias("kind"), lex.alias("lex"), (F.lit(None).cast("string") if d is None else d).alias("dt"), (F.lit(None).cast("string") if g is None else g).alias("lang"))
    kind = F.when(lang.isNotNull(), F.lit(RDF + "langString")).otherwise(F.coalesce(dt, F.lit(STRING)))
    return (
        F.when(text.startswith("<<"), make(2, text))
        .when(text.startswith("<"), make(3, F.substring(text, F.lit(2), F.length(text) - 2)))
        .when(text.startswith("_:"), make(1, F.substring(text, F.lit(3), F.length(text))))
        .when(text.startswith('"'), make(4, inner, kind, lang))
    )


_DATATYPES = {T.LongType: XSD + "integer", T.IntegerType: XSD + "integer", T.ShortType: XSD + "integer", T.DoubleType: XSD + "double", T.FloatType: XSD + "float", T.StringType: STRING, T.BooleanType: BOOLEAN, T.TimestampType: DATETIME, T.TimestampNTZType: DATETIME, T.DateType: DATE}


@dataclass
class TableMap:
    """How rows of a table are a star: subject ``prefix`` + key, a class, and a predicate for each column.

    A predicate's column becomes a literal of the column's type, or an IRI with
    the prefix given in ``links``.  A NULL cell is no triple.  ``unique`` says
    that no key has several rows, so that one scan serves several predicates.
    """

    df: DataFrame
    prefix: str
    key: str | Column
    predicates: dict[str, str]
    links: dict[str, str] = field(default_factory=dict)
    type_iri: str | None = None
    unique: bool = True
    rows: float = 1e6

    def subject(self) -> Val:
        key = F.col(self.key) if isinstance(self.key, str) else self.key
        return Val(key, "iri", prefix=self.prefix)

    def value(self, predicate: str) -> Val:
        if predicate == RDF + "type":
            return Val(F.lit(self.type_iri), "iri")
        column = self.predicates[predicate]
        if column in self.links:
            return Val(F.col(column), "iri", prefix=self.links[column])
        kind = type(self.df.schema[column].dataType)
        if isinstance(self.df.schema[column].dataType, T.DecimalType):
            return Val(F.col(column), "literal", XSD + "decimal")
        return Val(F.col(column), "literal", _DATATYPES[kind])

    def has(self, predicate: str) -> bool:
        return predicate in self.predicates or predicate == RDF + "type" and self.type_iri is not None

    def known(self) -> list[str]:
        return [*self.predicates, *([RDF + "type"] if self.type_iri else [])]


class TableGraph:
    """Tables seen as one graph."""

    def __init__(self, spark: SparkSession, maps: list[TableMap]):
        self.spark, self.maps = spark, maps

    def using(self, default: list[Term], named: list[Term]) -> TableGraph:
        return self

    def hinted(self, hints: dict[str, str]) -> TableGraph:
        return self

    def estimate(self, triple: Triple) -> float:
        """Rows of a pattern: of the tables that have its predicate, less for constants."""
        n = sum(m.rows for m in self.maps if not isinstance(triple.p, Term) or m.has(triple.p.lex))
        if isinstance(triple.s, Term):
            n /= 1e6
        if isinstance(triple.o, Term) and not (isinstance(triple.p, Term) and triple.p.lex == RDF + "type"):
            n /= 1e2
        return n

    def _scan(self, m: TableMap, triples: list[Triple]) -> Solutions | None:
        """A star from one row of a table; None where a constant can't match."""
        rows, wanted = m.df, {}

        def put(x: object, v: Val) -> bool:
            nonlocal rows
            if isinstance(x, Var):
                if x.name in wanted:
                    rows = rows.where(_same(wanted[x.name], v))
                else:
                    wanted[x.name] = v
                return True
            if v.form == "iri" and v.prefix is not None and (x.kind != IRI or not x.lex.startswith(v.prefix)):
                return False
            if v.form == "iri" and v.prefix is not None:
                kind = m.df.select(v.col).schema[0].dataType
                rows = rows.where(v.col == F.lit(x.lex[len(v.prefix) :]).try_cast(kind))
            else:
                rows = rows.where(_matches(v, x))
            return True

        if not put(triples[0].s, m.subject()):
            return None
        needed = []
        for t in triples:
            v = m.value(t.p.lex)
            if t.p.lex == RDF + "type":
                if isinstance(t.o, Term):
                    if t.o != iri(m.type_iri):
                        return None
                    continue
            else:
                needed.append(m.predicates[t.p.lex])
            if not put(t.o, v):
                return None
        for column in dict.fromkeys(needed):
            rows = rows.where(F.col(column).isNotNull())
        return Solutions.of(rows, wanted)

    def triple(self, triple: Triple, graph: object = None) -> Solutions:
        return self.star([triple], graph)

    def star(self, triples: list[Triple], graph: object = None) -> Solutions:
        from ..operators.joins import inner, union

        if graph is not None or any(isinstance(t.s, Quoted) or isinstance(t.o, Quoted) for t in triples):
            return self._nothing(triples, graph)
        fixed = [t for t in triples if isinstance(t.p, Term)]
        found = None
        if fixed:
            whole = [m for m in self.maps if all(m.has(t.p.lex) for t in fixed)]
            split = [m for m in self.maps if any(m.has(t.p.lex) for t in fixed)]
            if len(fixed) == 1 or len(whole) == len(split) and all(m.unique for m in whole):
                scans = [s for m in whole if (s := self._scan(m, fixed))]
                found = reduce(union, scans) if scans else self._nothing(fixed)
            else:
                found = reduce(inner, (self.star([t]) for t in fixed))
        for t in triples:
            if not isinstance(t.p, Term):
                found = inner(found, self._any(t)) if found else self._any(t)
        return found

    def _any(self, t: Triple) -> Solutions:
        """A pattern with a variable predicate: every predicate of every table."""
        from ..operators.joins import union

        scans = []
        for m in self.maps:
            for p in m.known():
                scan = self._scan(m, [Triple(t.s, iri(p), t.o)])
                if scan is None:
                    continue
                name = t.p.name
                if name in scan.variables:
                    continue
                scans.append(Solutions.of(scan.df, {**scan.variables, name: Val(F.lit(p), "iri")}))
        return reduce(union, scans) if scans else self._nothing([t])

    def _nothing(self, triples: list[Triple], graph: object = None) -> Solutions:
        names = dict.fromkeys(x.name for t in triples for x in (t.s, t.p, t.o, graph) if isinstance(x, Var))
        return Solutions.of(self.spark.range(0).toDF("x"), {n: Val(F.lit(None).cast(TERM_DDL)) for n in names})

    def nodes(self, graph: object = None) -> Solutions:
        every = self._any(Triple(Var("s"), Var("p"), Var("o")))
        s, o = every.val("s"), every.val("o")
        rows = every.df.select(s.term().alias("x")).union(every.df.select(o.term())).distinct()
        return Solutions.of(rows, {"x": Val(F.col("x"))})


def constants(spark: SparkSession, names: list[str], rows: list[list[Term | None]]) -> Solutions:
    """Inline solutions; None is unbound."""
    if not names:
        return Solutions(spark.range(len(rows)).select(F.lit(1).alias("v_")), {})
    typed: dict[str, Val] = {}
    data, schema, maybe = [], [], set()
    for k, n in enumerate(names):
        column = [r[k] for r in rows]
        if None in column:
            maybe.add(n)
        bound = [of_constant(t) for t in column if t is not None]
        kinds = {v.type_key() for v in bound}
        if len(kinds) == 1 and bound[0].form != "term":
            typed[n] = bound[0]
    for r in rows:
        data.append(F.struct(*((_cell(typed.get(n), t)).alias(f"v_{n}") for n, t in zip(names, r, strict=True))))
    if not data:
        empty = spark.range(0)
        return Solutions.of(empty, {n: Val(F.lit(None).cast(TERM_DDL)) for n in names})
    df = spark.range(1).select(F.inline(F.array(*data)))
    return Solutions(df, {n: (typed[n].on(F.col(f"`v_{n}`")) if n in typed else Val(F.col(f"`v_{n}`"))) for n in names}, maybe)


def _cell(typed: Val | None, t: Term | None) -> Column:
    if typed is not None:
        return of_constant(t).col if t is not None else F.lit(None)
    return constant(t) if t is not None else F.lit(None).cast(TERM_DDL)
