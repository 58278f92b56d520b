"""Property paths.

A path is a relation of (start, end) pairs.  Sequences, alternatives and
inverses are joins, unions and swapped columns; repetitions are semi-naive
fixpoints over distinct pairs, grown from a constant end if there is one, with
each round's new pairs written so that plans stay small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.algebra import Path, Triple, Var
from ..sources.graphs import Graph, Solutions
from ..store import written
from ..terms import Term, Val, iri
from .joins import distinct, inner, union

_S, _O = "path s", "path o"
#: Graphs that a path with a variable graph is matched in, one after the other.
GRAPHS = 64


def _pairs(s: Solutions, start: str, end: str) -> Solutions:
    """Solutions as (path s, path o)."""
    return Solutions.of(s.df, {_S: s.val(start), _O: s.val(end)}, {n for n, m in ((_S, start), (_O, end)) if m in s.maybe})


def relation(graph: Graph, path: object, g: object, start: Term | None = None, end: Term | None = None, fresh: list[int] | None = None) -> Solutions:
    """The (path s, path o) pairs of a path; with a constant start or end only those."""
    fresh = fresh if fresh is not None else [0]
    if isinstance(path, Term):
        return _pairs(graph.triple(Triple(Var(_S), path, Var(_O)), g), _S, _O)
    if path.op == "^":
        inner_pairs = relation(graph, path.parts[0], g, end, start, fresh)
        return _pairs(inner_pairs, _O, _S)
    if path.op == "|":
        return reduce(union, (relation(graph, p, g, start, end, fresh) for p in path.parts))
    if path.op == "/":
        found = relation(graph, path.parts[0], g, start, None, fresh)
        for p in path.parts[1:]:
            fresh[0] += 1
            mid = f"path {fresh[0]}"
            step = relation(graph, p, g, None, None, fresh)
            a = Solutions.of(found.df, {_S: found.val(_S), mid: found.val(_O)})
            b = Solutions.of(step.df, {mid: step.val(_S), _O: step.val(_O)})
            found = _pairs(inner(a, b), _S, _O)
        return found
    if path.op == "!":
        return _negated(graph, path, g)
    return repeated(graph, path, g, start, end, fresh)


def _negated(graph: Graph, path: Path, g: object) -> Solutions:
    """Any predicate but those of the set; inverse members stand for inverse steps."""
    found = []
    for inverse in (False, True):
        names = [t for t, i in path.parts if i == inverse]
        if not names and (inverse or path.parts):
            continue
        every = graph.triple(Triple(Var(_S), Var("path p"), Var(_O)), g)
        p = every.val("path p")
        kept = Solutions(every.df.where(~p.lex().isin([t.lex for t in names])), every.variables, every.maybe)
        found.append(_pairs(kept, _O, _S) if inverse else _pairs(kept, _S, _O))
    return reduce(union, found)


def _terms(s: Solutions) -> DataFrame:
    return s.df.select(s.val(_S).term().alias("s"), s.val(_O).term().alias("o"))


def repeated(graph: Graph, path: Path, g: object, start: Term | None, end: Term | None, fresh: list[int]) -> Solutions:
    """``p?``, ``p*``, ``p+`` and ``p{low,high}``: distinct pairs."""
    step = relation(graph, path.parts[0], g, None, None, fresh)
    s, o = step.val(_S), step.val(_O)
    native = s.type_key() == o.type_key() and s.form != "term"
    edges = (step.df.select(s.col.alias("s"), o.col.alias("o")) if native else _terms(step)).where("s is not null and o is not null").distinct()
    back = start is None and end is not None
    if back:
        edges = edges.select(F.col("o").alias("s"), F.col("s").alias("o"))
    anchor = end if back else start
    kind = s if native else Val(F.col("s"))
    edges = written(edges)
    whole = closure(edges, path.low, path.high, _anchored(edges, kind, anchor), _node_frame(graph, g, kind, native) if path.low == 0 else None)
    if back:
        whole = whole.select(F.col("o").alias("s"), F.col("s").alias("o"))
    return Solutions.of(whole, {_S: kind.on(F.col("s")), _O: kind.on(F.col("o"))})


def _anchored(edges: DataFrame, kind: Val, anchor: Term | None) -> DataFrame | None:
    """The one start of a path that begins at a constant, as a column ``s``."""
    if anchor is None:
        return None
    spark = edges.sparkSession
    if kind.form == "term":
        from ..terms import constant

        return spark.range(1).select(constant(anchor).alias("s"))
    lex = anchor.lex
    if kind.prefix is not None:
        lex = lex.removeprefix(kind.prefix) if lex.startswith(kind.prefix) else None
    if anchor.kind != {"iri": 3, "bnode": 1, "literal": 4}[kind.form]:
        lex = None
    return spark.range(1).select(F.lit(lex).try_cast(edges.schema["s"].dataType).alias("s")).where("s is not null")


def _node_frame(graph: Graph, g: object, kind: Val, native: bool) -> DataFrame:
    """All nodes, for paths of no step between variables, in the columns' type."""
    nodes = graph.nodes(g)
    x = nodes.val("x")
    if not native:
        return nodes.df.select(x.term().alias("s"))
    term = x.term()
    wanted = {"iri": 3, "bnode": 1, "literal": 4}[kind.form]
    rows = nodes.df.where(term["kind"] == wanted)
    lex = term["lex"]
    if kind.prefix is not None:
        rows = rows.where(lex.startswith(kind.prefix))
        lex = F.substring(lex, F.lit(len(kind.prefix) + 1), F.length(lex))
    return rows.select(lex.alias("s"))


def closure(edges: DataFrame, low: int, high: int | None, starts: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """Distinct (s, o) with o between ``low`` and ``high`` steps from s.

    ``starts`` limits s; ``nodes`` are those that are no step from themselves.
    Beyond ``low`` steps only pairs that are new go on, so cycles end.
    """
    kind = edges.schema["s"].dataType
    if low == 0:
        zero = starts if starts is not None else nodes.select(F.col("s").try_cast(kind).alias("s") if nodes.schema["s"].dataType != kind else F.col("s")).where("s is not null")
        if starts is None:
            zero = zero.union(edges.select("s")).union(edges.select("o")).distinct()
        now = zero.select("s", F.col("s").alias("o"))
    else:
        now = edges if starts is None else edges.join(starts, "s", "left_semi")
        for _ in range(low - 1):
            now = _step(now, edges).distinct()
    found = now = written(now)
    steps = max(low, 1)
    if low == 0:
        steps = 0
    while high is None or steps < high:
        fresh = written(_step(now, edges).distinct().join(found, ["s", "o"], "left_anti"))
        if fresh.isEmpty():
            break
        found = found.union(fresh)
        steps += 1
        now = fresh
        if steps % 8 == 0:
            found = written(found)
    return found


def _step(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    return pairs.select("s", F.col("o").alias("m")).join(edges.select(F.col("s").alias("m"), "o"), "m").select("s", "o")


def match(graph: Graph, triple: Triple, g: object, fresh: list[int]) -> Solutions:
    """Solutions of a triple whose predicate is a path; a walk stays in one graph."""
    if isinstance(g, Var) and hasattr(graph, "quads"):
        return _in_each_graph(graph, triple, g, fresh)
    start = triple.s if isinstance(triple.s, Term) else None
    end = triple.o if isinstance(triple.o, Term) else None
    found = relation(graph, triple.p, g, start, end, fresh)
    rows, values = found.df, {}
    for at, x in ((_S, triple.s), (_O, triple.o)):
        v = found.val(at)
        if isinstance(x, Var):
            if x.name in values:
                w = values[x.name]
                rows = rows.where(w.col == v.col if w.type_key() == v.type_key() else w.term() == v.term())
            else:
                values[x.name] = v
        else:
            term = v.term()
            rows = rows.where((term["kind"] == x.kind) & (term["lex"] == x.lex) & (F.coalesce(term["dt"], F.lit("")) == (x.dt or "")))
    return Solutions.of(rows, values)


def _in_each_graph(graph: Graph, triple: Triple, g: Var, fresh: list[int]) -> Solutions:
    """The matches in each named graph, up to ``GRAPHS`` of them."""
    names = [r[0] for r in graph.quads.where("g is not null").select("g.lex").distinct().limit(GRAPHS + 1).collect()]
    if len(names) > GRAPHS:
        raise ValueError(f"a path over a variable graph is for {GRAPHS} graphs at most; name the graph")
    parts = []
    for name in sorted(names) or ["urn:none"]:
        found = match(graph, triple, iri(name), fresh)
        parts.append(Solutions.of(found.df, {**found.variables, g.name: Val(F.lit(name), "iri")}, found.maybe))
    return reduce(union, parts)


def between(graph: Graph, predicate: str, low: int, high: int | None, g: object = None) -> Solutions:
    """The pairs that are ``low`` to ``high`` steps of one predicate apart."""
    return distinct(relation(graph, Path("rep", (iri(predicate),), low, high), g))
