"""Queries as DataFrames.

A group is compiled bottom up.  Runs of triples are ordered by estimated rows
and by shared variables, stars on one subject first become one scan; OPTIONAL,
MINUS, UNION and the like keep their places, as order matters to them.  Filters
see the whole group and go where their variables are bound; EXISTS filters
become semi or anti joins.  Physical choices are left to Spark, but for hints.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import CUSTOM_AGGREGATES, Evaluator, aggregate, boolean
from ..operators import joins, paths
from ..sources.graphs import Graph, Solutions, constants
from ..terms import BNODE, IRI, LITERAL, TERM_DDL, Term, Val, of_constant
from .algebra import Bind, Call, Exists, Filter, GraphPattern, Group, Include, Minus, Optional, Path, Query, Quoted, Service, SubSelect, Triple, Union, Values, Var
from .parser import AGGREGATES

#: Table functions by IRI or its ending: (compiler, group of the call, solutions so far) -> Solutions.
SERVICES: dict[str, Callable[..., Solutions]] = {}


def register_service(name: str, build: Callable[..., Solutions]) -> None:
    """Makes a table function callable as SERVICE; ``name`` is an IRI or what it ends in."""
    SERVICES[name] = build


def find_service(name: str) -> Callable[..., Solutions] | None:
    return SERVICES.get(name) or next((f for n, f in SERVICES.items() if n[:1] in "#/" and name.endswith(n)), None)


def variables(x: object) -> set[str]:
    """Variables that occur anywhere in a node."""
    if isinstance(x, Var):
        return {x.name}
    if isinstance(x, (list, tuple)):
        return set().union(*map(variables, x)) if x else set()
    if isinstance(x, (Term, str, int, type(None), bool)):
        return set()
    if isinstance(x, SubSelect):
        return {v.name for v, _ in x.query.select} if x.query.select is not None else variables(x.query.where)
    if isinstance(x, dict):
        return variables(list(x.values()))
    return set().union(*(variables(v) for v in vars(x).values())) if hasattr(x, "__dict__") else set()


@dataclass
class Scope:
    """What a group is compiled under."""

    graph: object = None
    named: dict[str, Solutions] = field(default_factory=dict)
    hints: dict[str, str] = field(default_factory=dict)


class Compiler:
    """Compiles queries over one graph."""

    def __init__(self, spark: SparkSession, graph: Graph, solution_sets: dict[str, DataFrame] | None = None, remote: Callable | None = None):
        self.spark, self.graph = spark, graph
        self.solution_sets = solution_sets or {}
        self.remote = remote
        self.fresh = [0]

    # --- queries

    def select(self, q: Query, scope: Scope | None = None) -> Solutions:
        """The solutions of a SELECT, in order if it has one."""
        outer = scope or Scope()
        scope = Scope(outer.graph, dict(outer.named), {**outer.hints, **q.hints})
        graph = self.graph
        if q.default_graphs or q.named_graphs:
            self.graph = self.graph.using(q.default_graphs, q.named_graphs)
        if q.hints:
            self.graph = self.graph.hinted(q.hints)
        try:
            for name, sub in q.named.items():
                scope.named[name] = self.select(sub, scope)
            found = self.group(q.where, scope)
            if q.values:
                found = self.with_values(found, q.values)
            return self.modified(q, found, scope)
        finally:
            self.graph = graph

    def modified(self, q: Query, found: Solutions, scope: Scope) -> Solutions:
        """Grouping, projection and the solution modifiers."""
        chosen = q.select
        order = list(q.order_by)
        having = list(q.having)
        computed: dict[int, Val] = {}
        calls = [c for e in [*(e for _, e in chosen or []), *having, *(e for e, _ in order)] for c in _aggregates(e)]
        if q.group_by or calls:
            found, computed = self.grouped(q, found, calls, scope)
        for _, e in chosen or []:
            if e is not None and _exists(e):
                names = found.variables
                found, computed[id(e)] = self.with_exists(found, e, scope)
                found = Solutions(found.df, {**names, **found.variables}, found.maybe)
        maker = lambda s: Evaluator(s.variables, None, computed, scope.hints)
        values, maybe = dict(found.variables), set(found.maybe)
        names = []
        for var, e in chosen or []:
            names.append(var.name)
            if e is not None:
                at = Solutions(found.df, values, maybe)
                values[var.name] = maker(at).val(e)
                maybe.add(var.name)
            elif var.name not in values:
                values[var.name] = Val(F.lit(None).cast(TERM_DDL))
                maybe.add(var.name)
        if chosen is None:
            names = [n for n in values if not n.startswith(" ") and not n.startswith("path ")]
        whole = Solutions(found.df, values, maybe)
        rows = found.df
        for e in having:
            rows = rows.where(maker(whole).ebv(e))
        keys = []
        for e, up in order:
            for k in maker(whole).val(e).order_keys():
                keys.append((k, up))
        picked = {n: values[n] for n in names}
        if not (q.distinct and keys):
            kept = {**picked, **{f" key{k}": Val(c, "literal") for k, (c, _) in enumerate(keys)}}
            out = Solutions.of(rows, kept, maybe & set(kept))
        else:
            # Keys of the projected variables sort after DISTINCT.
            out = Solutions.of(rows, picked, maybe & set(picked))
        if q.distinct or q.reduced and not keys:
            out = Solutions(out.df.distinct(), out.variables, out.maybe)
            if keys:
                again = Evaluator(out.variables, None, {}, scope.hints)
                keys = [(k, up) for e, up in order for k in again.val(e).order_keys()]
        elif keys:
            keys = [(F.col(f"`v_ key{k}`"), up) for k, (_, up) in enumerate(keys)]
        df = out.df
        if keys:
            df = df.orderBy(*(k.asc_nulls_first() if up else k.desc_nulls_last() for k, up in keys))
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Solutions(df.select(*(f"`v_{n}`" for n in names)) if names else df.select(F.lit(1).alias("v_")), {n: out.variables[n] for n in names}, out.maybe & set(names))

    def grouped(self, q: Query, found: Solutions, calls: list[Call], scope: Scope) -> tuple[Solutions, dict[int, Val]]:
        """One solution for each group, with its keys and aggregates."""
        maker = Evaluator(found.variables, None, {}, scope.hints)
        keys: dict[str, Val] = {}
        computed: dict[int, Val] = {}
        for k, (e, var) in enumerate(q.group_by):
            name = var.name if var else e.name if isinstance(e, Var) else f" group{k}"
            keys[name] = maker.val(e)
            computed[id(e)] = Val(F.lit(None)).on(F.col(f"`v_{name}`")) if not isinstance(e, Var) else computed.get(id(e))
        computed = {k: v for k, v in computed.items() if v is not None}
        aggregates: dict[str, Val] = {}
        inputs = dict(keys)
        arguments: dict[int, Val | None] = {}
        for c in calls:
            if c.args:
                v = maker.val(c.args[0])
                name = f" arg{len(inputs)}"
                inputs[name] = v
                arguments[id(c)] = name
            else:
                arguments[id(c)] = None
        distinct_rows = any(c.name == "COUNT" and not c.args and c.distinct for c in calls)
        if distinct_rows:
            visible = [v.col for n, v in found.variables.items() if not n.startswith(" ")]
            inputs[" whole"] = Val(F.struct(*visible), "literal")
        base = Solutions.of(found.df, inputs, found.maybe)
        for k, c in enumerate(calls):
            name = arguments[id(c)]
            arg = base.val(name) if name else None
            if c.name == "COUNT" and arg is None and c.distinct:
                made = Val(F.count_distinct(F.col("`v_ whole`")), "literal", "http://www.w3.org/2001/XMLSchema#integer")
            else:
                made = aggregate(c, arg)
            aggregates[f" agg{k}"] = made
        made = [v.col.alias(f"v_{n}") for n, v in aggregates.items()]
        if not made:
            made = [F.count(F.lit(1)).alias("v_ n")]
        rows = base.df.groupBy(*(F.col(f"`v_{n}`") for n in keys)).agg(*made)
        out = {n: base.val(n) for n in keys}
        for k, c in enumerate(calls):
            computed[id(c)] = aggregates[f" agg{k}"].on(F.col(f"`v_ agg{k}`"))
        for k, (e, var) in enumerate(q.group_by):
            name = var.name if var else e.name if isinstance(e, Var) else f" group{k}"
            if not isinstance(e, Var):
                computed[id(e)] = out[name]
        return Solutions(rows, out, found.maybe & set(keys)), computed

    # --- groups

    def group(self, g: Group, scope: Scope, seed: Solutions | None = None) -> Solutions:
        """The solutions of a group graph pattern."""
        hints = {**scope.hints, **g.hints}
        scope = Scope(scope.graph, scope.named, hints)
        found, run, filters = seed, [], []
        fixed = hints.get("optimizer", "").lower() == "none"

        def flush() -> None:
            nonlocal found, run
            if run:
                found = self.triples(run, scope, found, fixed)
                run = []

        for part in g.parts:
            if isinstance(part, Triple):
                run.append(part)
                continue
            if isinstance(part, Filter):
                filters.append(part.expr)
                continue
            flush()
            found = self.part(part, found, scope)
        flush()
        if found is None:
            found = Solutions(self.spark.range(1).select(F.lit(1).alias("v_")), {})
        for e in filters:
            found = self.filtered(found, e, scope)
        return found

    def part(self, part: object, found: Solutions | None, scope: Scope) -> Solutions:
        """The group so far, joined with another pattern."""
        if isinstance(part, Optional):
            return self.optional(found, part.group, scope)
        if isinstance(part, Minus):
            return found if found is None else joins.semi(found, self.group(part.group, scope), anti=True, minus=True)
        if isinstance(part, Bind):
            base = found or Solutions(self.spark.range(1).select(F.lit(1).alias("v_")), {})
            if part.var.name in base.variables:
                v = self.evaluator(base, scope).val(part.expr)
                old = base.val(part.var.name)
                same = old.col == v.col if old.type_key() == v.type_key() else old.term() == v.term()
                return Solutions(base.df.where(same), base.variables, base.maybe)
            base, expr = self.with_exists(base, part.expr, scope)
            v = expr
            return Solutions.of(base.df, {**base.variables, part.var.name: v}, base.maybe | {part.var.name})
        if isinstance(part, Service):
            return self.service(part, found, scope)
        if isinstance(part, Union):
            inner = reduce(joins.union, (self.group(g, scope) for g in part.groups))
        elif isinstance(part, Group):
            inner = self.group(part, scope)
        elif isinstance(part, GraphPattern):
            inner = self.group(part.group, Scope(part.graph, scope.named, scope.hints))
        elif isinstance(part, SubSelect):
            inner = self.select(part.query, scope)
            if part.query.hints.get("runOnce", "").lower() == "true":
                inner = Solutions(inner.df.cache(), inner.variables, inner.maybe)
        elif isinstance(part, Values):
            return self.with_values(found, part)
        elif isinstance(part, Include):
            inner = self.included(part.name, scope)
        else:
            raise TypeError(f"unknown pattern {part!r}")
        return inner if found is None else joins.inner(found, inner)

    def included(self, name: str, scope: Scope) -> Solutions:
        """A named subquery's or a stored set's solutions."""
        if name in scope.named:
            return scope.named[name]
        if name not in self.solution_sets:
            raise ValueError(f"unknown solution set {name}")
        df = self.solution_sets[name]
        return Solutions.of(df, {c: Val(F.col(f"`{c}`")) for c in df.columns}, set(df.columns))

    def values(self, v: Values) -> Solutions:
        return constants(self.spark, [n.name for n in v.names], v.rows)

    def with_values(self, found: Solutions | None, v: Values) -> Solutions:
        """Inline rows joined: those with the same variables bound together, so that each join is one of equality."""
        if found is None or not any(None in row for row in v.rows):
            return self.values(v) if found is None else joins.inner(found, self.values(v))
        by: dict[tuple[bool, ...], list] = {}
        for row in v.rows:
            by.setdefault(tuple(t is not None for t in row), []).append(row)
        parts = []
        for bound, rows in by.items():
            names = [n for n, b in zip(v.names, bound, strict=True) if b]
            parts.append(joins.inner(found, self.values(Values(names, [[t for t in row if t is not None] for row in rows]))))
        return reduce(joins.union, parts)

    def triples(self, run: list[Triple], scope: Scope, found: Solutions | None, fixed: bool) -> Solutions:
        """A run of triples joined in a good order (or, if fixed, as written)."""
        stars: list[list[Triple]] = []
        for t in run:
            mates = next((s for s in stars if not fixed and s[0].s == t.s and not isinstance(t.p, Path) and not isinstance(s[0].p, Path) and not s[0].hints and not t.hints), None)
            if mates is not None and isinstance(t.p, Term) and isinstance(mates[0].p, Term):
                mates.append(t)
            else:
                stars.append([t])
        size = lambda s: min(self.estimate(t) for t in s)
        waiting = list(stars)
        if not fixed:
            first = [s for s in waiting if s[0].hints.get("runFirst", "").lower() == "true"]
            last = [s for s in waiting if s[0].hints.get("runLast", "").lower() == "true"]
            middle = [s for s in waiting if s not in first and s not in last]
            waiting = []
            bound = set(found.variables) if found else set()
            for batch in (first, middle, last):
                rest = list(batch)
                while rest:
                    linked = [s for s in rest if variables(s) & bound] or rest
                    best = min(linked, key=size)
                    rest.remove(best)
                    waiting.append(best)
                    bound |= variables(best)
        for s in waiting:
            one = paths.match(self.graph, s[0], scope.graph, self.fresh) if isinstance(s[0].p, Path) else self.graph.star(s, scope.graph)
            if (limit := s[0].hints.get("cutoffLimit", "")).isdigit():
                one = Solutions(one.df.limit(int(limit)), one.variables, one.maybe)
            how = "shuffle_hash" if s[0].hints.get("hashJoin", "").lower() == "true" else "merge" if scope.hints.get("mergeJoin", "").lower() == "true" else None
            found = one if found is None else joins.inner(found, one, how)
        return found

    def estimate(self, t: Triple) -> float:
        """Guessed rows of a pattern."""
        if isinstance(t.p, Path):
            return 1e8 if isinstance(t.s, Var) and isinstance(t.o, Var) else 1e5
        return self.graph.estimate(t)

    # --- filters

    def evaluator(self, s: Solutions, scope: Scope, exists: Callable | None = None) -> Evaluator:
        return Evaluator(s.variables, exists, None, scope.hints)

    def filtered(self, s: Solutions, e: object, scope: Scope) -> Solutions:
        """Solutions for which an expression is true."""
        if isinstance(e, Call) and e.name == "&&":
            return self.filtered(self.filtered(s, e.args[0], scope), e.args[1], scope)
        if isinstance(e, Call) and e.name == "!" and isinstance(e.args[0], Exists):
            e = Exists(e.args[0].group, not e.args[0].negated)
        if isinstance(e, Exists):
            return joins.semi(s, self.exists_group(e, s, scope), anti=e.negated)
        base, v = self.with_exists(s, e, scope)
        return Solutions(base.df.where(v.ebv()).select(*(f"`{c}`" for c in s.df.columns)), s.variables, s.maybe)

    def exists_group(self, e: Exists, s: Solutions, scope: Scope) -> Solutions:
        """The pattern of EXISTS; filters that need outer variables see them by a join."""
        outer = variables([p for p in e.group.parts if isinstance(p, Filter)]) - variables([p for p in e.group.parts if not isinstance(p, Filter)])
        if not outer & set(s.variables):
            return self.group(e.group, scope)
        seed = Solutions(s.df.distinct(), s.variables, s.maybe)
        return self.group(e.group, scope, seed)

    def with_exists(self, s: Solutions, e: object, scope: Scope) -> tuple[Solutions, Val]:
        """The value of an expression; EXISTS inside it are flags that are joined first."""
        flags: dict[int, str] = {}
        base = s
        for x in _exists(e):
            base, hit = joins.flag(base, self.exists_group(x, s, scope))
            name = f" flag{self.fresh[0]}"
            self.fresh[0] += 1
            df = base.df.withColumn(f"v_{name}", ~hit if x.negated else hit).drop("v_ hit")
            # A hidden variable, so that later joins keep it.
            base = Solutions(df, {**base.variables, name: boolean(F.col(f"`v_{name}`"))}, base.maybe)
            flags[id(x)] = name
        return base, self.evaluator(base, scope, lambda x: base.val(flags[id(x)]).col).val(e)

    def optional(self, found: Solutions | None, g: Group, scope: Scope) -> Solutions:
        """A left join; the group's own filters hold for solutions that join, and see both sides."""
        base = found or Solutions(self.spark.range(1).select(F.lit(1).alias("v_")), {})
        filters = [p.expr for p in g.parts if isinstance(p, Filter) and not _exists(p.expr)]
        inside = Group([p for p in g.parts if not (isinstance(p, Filter) and not _exists(p.expr))], g.hints)
        other = self.group(inside, scope)
        if not filters:
            return joins.left_outer(base, other)

        def condition(values: dict[str, Val]) -> Column:
            return reduce(lambda a, b: a & b, (Evaluator(values, None, None, scope.hints).ebv(e) for e in filters))

        return joins.left_outer(base, other, condition)

    def service(self, part: Service, found: Solutions | None, scope: Scope) -> Solutions:
        """A registered table function, or a remote endpoint."""
        name = part.name.lex if isinstance(part.name, Term) else None
        build = find_service(name) if name else None
        try:
            if build:
                inner = build(self, part.group, scope, found)
            elif self.remote and name:
                inner = self.remote(self, name, part.group, found)
            else:
                raise ValueError(f"unknown service {name}")
        except Exception:
            if not part.silent:
                raise
            return found or Solutions(self.spark.range(1).select(F.lit(1).alias("v_")), {})
        return inner if found is None else joins.inner(found, inner)

    # --- other forms

    def ask(self, q: Query) -> bool:
        q.limit = 1
        q.select = []
        return not self.select(q).df.isEmpty()

    def construct(self, q: Query) -> DataFrame:
        """Triples (s, p, o) of a template, each once; blank nodes are new for each solution."""
        inner = Query("select", q.where, None, default_graphs=q.default_graphs, named_graphs=q.named_graphs, order_by=q.order_by, limit=q.limit, offset=q.offset, values=q.values, named=q.named, hints=q.hints)
        found = self.select(inner)
        out = instantiate(found, [(t.s, t.p, t.o, None) for t in q.template]).select("s", "p", "o")
        return out if q.hints.get("constructDistinctSPO", "").lower() == "false" else out.distinct()


def instantiate(found: Solutions, template: list[tuple]) -> DataFrame:
    """Quads of a template over solutions, without those that lack a part or aren't legal."""
    blanks = {x.name for t in template for x in t if isinstance(x, Var) and x.name.startswith(" ")} | {f"_{x.lex}" for t in template for x in t if isinstance(x, Term) and x.kind == BNODE}
    row = F.xxhash64(*(v.lex() for v in found.variables.values())) if found.variables else F.lit(0).cast("long")
    df = found.df.withColumn("row id", F.concat(F.hex(row), F.lit("x"), F.hex(F.monotonically_increasing_id()))) if blanks else found.df

    def place(x: object) -> Column:
        if x is None:
            return F.lit(None).cast(TERM_DDL)
        label = x.name.strip() if isinstance(x, Var) and x.name.startswith(" ") else x.lex if isinstance(x, Term) and x.kind == BNODE else None
        if label is not None and not (isinstance(x, Var) and x.name in found.variables):
            return Val(F.concat(F.lit(f"{label}x"), F.col("`row id`")), "bnode").term()
        if isinstance(x, Var):
            return found.variables[x.name].term() if x.name in found.variables else F.lit(None).cast(TERM_DDL)
        if isinstance(x, Quoted):
            return Evaluator(found.variables).val(x).term()
        return of_constant(x).term() if x.kind != LITERAL else Val(_literal(x)).col

    quads = F.array(*(F.struct(*(place(x).cast(TERM_DDL).alias(n) for n, x in zip("spog", t, strict=True)), F.lit(t[3] is not None).alias("in_graph")) for t in template))
    if not template:
        return df.select(*(F.lit(None).cast(TERM_DDL).alias(n) for n in "spog")).where(F.lit(False))
    out = df.select(F.inline(quads))
    legal = F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull() & (F.col("s.kind") != LITERAL) & (F.col("p.kind") == IRI) & (F.col("g").isNotNull() | ~F.col("in_graph"))
    return out.where(legal).select("s", "p", "o", "g")


def _literal(t: Term) -> Column:
    from ..terms import constant

    return constant(t)


def _aggregates(e: object) -> list[Call]:
    """Aggregates within an expression, outermost only."""
    if isinstance(e, Call):
        if e.name in AGGREGATES or e.name in CUSTOM_AGGREGATES:
            return [e]
        return [c for a in e.args for c in _aggregates(a)]
    return []


def _exists(e: object) -> list[Exists]:
    if isinstance(e, Exists):
        return [e]
    return [x for a in e.args for x in _exists(a)] if isinstance(e, Call) else []
