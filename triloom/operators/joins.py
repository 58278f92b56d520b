"""Joins and unions of solutions.

Variables that are bound on both sides are joined by equality, natively where
their types agree.  A variable that may be unbound is compatible with anything:
if other variables are always bound they are the join's keys and the rest is a
condition; if none is, the sides are split by which variables are unbound, so
that each part is an equality join.  Outer and semi joins of such sides number the
rows of the first, find those that match part by part, and come back by number.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.graphs import Solutions
from ..store import written
from ..terms import TERM_DDL, Val


def _sides(a: Solutions, b: Solutions) -> tuple[DataFrame, DataFrame, dict[str, Val], dict[str, Val]]:
    """Both sides with columns of names of their own, and the values of their variables."""
    left = a.df.select(*(F.col(f"`{c}`").alias(f"l{k}") for k, c in enumerate(a.df.columns)))
    right = b.df.select(*(F.col(f"`{c}`").alias(f"r{k}") for k, c in enumerate(b.df.columns)))
    here = {n: v.on(F.col(f"l{a.df.columns.index(f'v_{n}')}")) for n, v in a.variables.items()}
    there = {n: v.on(F.col(f"r{b.df.columns.index(f'v_{n}')}")) for n, v in b.variables.items()}
    return left, right, here, there


def _same(x: Val, y: Val) -> Column:
    return x.col == y.col if x.type_key() == y.type_key() else x.term() == y.term()


def _both(x: Val, y: Val) -> Val:
    """A variable that either side may bind."""
    if x.type_key() == y.type_key():
        return x.on(F.coalesce(x.col, y.col))
    return Val(F.coalesce(x.term(), y.term()))


def _every(conditions: list[Column]) -> Column:
    return reduce(lambda p, q: p & q, conditions) if conditions else F.lit(True)


def _condition(a: Solutions, b: Solutions, here: dict[str, Val], there: dict[str, Val]) -> Column:
    out = []
    for n in sorted(set(here) & set(there)):
        same = _same(here[n], there[n])
        if n in a.maybe:
            same = same | here[n].col.isNull()
        if n in b.maybe:
            same = same | there[n].col.isNull()
        out.append(same)
    return _every(out)


def _merge(a: Solutions, b: Solutions, here: dict[str, Val], there: dict[str, Val], optional: bool = False) -> tuple[dict[str, Val], set[str]]:
    values: dict[str, Val] = {}
    for n in [*here, *(n for n in there if n not in here)]:
        if n in here and n in there:
            values[n] = _both(here[n], there[n]) if n in a.maybe else here[n]
        else:
            values[n] = here[n] if n in here else there[n]
    maybe = {n for n in values if (n not in a.variables or n in a.maybe) and (n not in b.variables or n in b.maybe or optional)}
    return values, maybe


def _loose(a: Solutions, b: Solutions) -> list[str] | None:
    """The shared variables, if there are any and all of them may be unbound."""
    shared = set(a.variables) & set(b.variables)
    return sorted(shared) if shared and shared <= (a.maybe | b.maybe) else None


def inner(a: Solutions, b: Solutions, how: str | None = None) -> Solutions:
    """Compatible solutions of both sides; ``how`` is a join hint for the right one."""
    shared = set(a.variables) & set(b.variables)
    loose = shared & (a.maybe | b.maybe)
    if loose and loose == shared:
        return _split(a, b, sorted(shared))
    left, right, here, there = _sides(a, b)
    if how:
        right = right.hint(how)
    joined = left.join(right, _condition(a, b, here, there)) if shared else left.crossJoin(right)
    values, maybe = _merge(a, b, here, there)
    return Solutions.of(joined, values, maybe)


def _split(a: Solutions, b: Solutions, names: list[str], minus: bool = False, once: bool = False) -> Solutions | None:
    """A join all of whose shared variables may be unbound, part by part.

    For MINUS (``minus``) parts that share no bound variable are left out.  Where
    only it matters whether there is a match (``once``), one row of the second
    side stands for all that are compatible with everything.
    """
    parts = []
    for pattern in product((True, False), repeat=2 * len(names)):
        mine, other = pattern[: len(names)], pattern[len(names) :]
        if any(x and n not in a.maybe for n, x in zip(names, mine, strict=True)) or any(x and n not in b.maybe for n, x in zip(names, other, strict=True)):
            continue
        none = all(x or y for x, y in zip(mine, other, strict=True))
        if minus and none:
            continue
        left = _where(a, names, mine)
        right = _where(b, names, other)
        if once and none:
            right = Solutions(right.df.limit(1), right.variables, right.maybe)
        for n, x in zip(names, mine, strict=True):
            if x:
                left = Solutions(left.df, {k: v for k, v in left.variables.items() if k != n}, left.maybe - {n})
        for n, x in zip(names, other, strict=True):
            if x:
                right = Solutions(right.df, {k: v for k, v in right.variables.items() if k != n}, right.maybe - {n})
        parts.append(inner(left, right))
    return reduce(union, parts) if parts else None


_ROW = "v_ row"


def _rowed(a: Solutions) -> Solutions:
    """With numbers of rows, written, so that they stay the same whenever the rows are read."""
    df = written(a.df.withColumn(_ROW, F.monotonically_increasing_id()))
    return Solutions(df, {**a.variables, " row": Val(F.col(f"`{_ROW}`"), "literal")}, a.maybe)


def _hits(rowed: Solutions, b: Solutions, names: list[str], minus: bool = False) -> DataFrame:
    """Numbers of the rows that have a compatible one on the second side."""
    right = Solutions.of(b.df, {n: b.val(n) for n in names}, b.maybe & set(names))
    met = _split(rowed, Solutions(right.df.distinct(), right.variables, right.maybe), names, minus, True)
    return rowed.df.select(_ROW).limit(0) if met is None else met.df.select(f"`{_ROW}`").distinct()


def _where(s: Solutions, names: list[str], unbound: tuple[bool, ...]) -> Solutions:
    keep = _every([s.val(n).col.isNull() if x else s.val(n).col.isNotNull() for n, x in zip(names, unbound, strict=True)])
    return Solutions(s.df.where(keep), s.variables, {m for m in s.maybe if m not in names or unbound[names.index(m)]})


def left_outer(a: Solutions, b: Solutions, condition=None) -> Solutions:
    """OPTIONAL; ``condition`` gets the values of both sides and holds for rows that join only."""
    if (names := _loose(a, b)) is not None:
        rowed = _rowed(a)
        met = _split(rowed, b, names)
        if condition is not None:
            met = Solutions(met.df.where(condition({n: v for n, v in met.variables.items() if n != " row"})), met.variables, met.maybe)
        met = Solutions(written(met.df), met.variables, met.maybe)
        rest = Solutions(rowed.df.join(met.df.select(f"`{_ROW}`").distinct(), _ROW, "left_anti"), rowed.variables, rowed.maybe)
        out = union(met, rest)
        return Solutions(out.df.drop(_ROW), {n: v for n, v in out.variables.items() if n != " row"}, out.maybe)
    left, right, here, there = _sides(a, b)
    on = _condition(a, b, here, there)
    if condition is not None:
        seen, _ = _merge(a, b, here, there)
        on = on & condition(seen)
    joined = left.join(right, on, "left")
    values, maybe = _merge(a, b, here, there, optional=True)
    return Solutions.of(joined, values, maybe)


def semi(a: Solutions, b: Solutions, anti: bool = False, minus: bool = False) -> Solutions:
    """Solutions of the first side with (or without) a compatible one; for MINUS one that shares a bound variable."""
    shared = set(a.variables) & set(b.variables)
    if minus and not shared:
        return a
    if (names := _loose(a, b)) is not None:
        rowed = _rowed(a)
        kept = rowed.df.join(_hits(rowed, b, names, minus), _ROW, "left_anti" if anti else "left_semi")
        return Solutions(kept.drop(_ROW), a.variables, a.maybe)
    left, right, here, there = _sides(a, b)
    on = _condition(a, b, here, there)
    if minus and shared <= (a.maybe | b.maybe):
        on = on & reduce(lambda p, q: p | q, (here[n].col.isNotNull() & there[n].col.isNotNull() for n in sorted(shared)))
    kept = left.join(right, on, "left_anti" if anti else "left_semi")
    return Solutions.of(kept, here, a.maybe)


def flag(a: Solutions, b: Solutions) -> tuple[Solutions, Column]:
    """All solutions of the first side, and whether there is a compatible one on the second."""
    names = sorted(set(a.variables) & set(b.variables))
    if set(names) & (a.maybe | b.maybe):
        rowed = _rowed(a)
        if _loose(a, b) is not None:
            hits = _hits(rowed, b, names)
        else:
            hits = semi(rowed, b).df.select(f"`{_ROW}`")
        out = Solutions(rowed.df.join(hits.withColumn("v_ hit", F.lit(True)), _ROW, "left"), a.variables, a.maybe)
    else:
        right = Solutions.of(b.df, {n: b.val(n) for n in names}, b.maybe & set(names))
        right = Solutions(right.df.distinct().withColumn("v_ hit", F.lit(True)), {**right.variables, " hit": Val(F.col("`v_ hit`"), "literal")}, right.maybe)
        out = left_outer(a, right) if names else left_outer(a, Solutions(right.df.limit(1), right.variables, right.maybe))
    hit = F.coalesce(F.col("`v_ hit`"), F.lit(False))
    return Solutions(out.df, {n: v for n, v in out.variables.items() if n in a.variables}, out.maybe & set(a.variables)), hit


def union(a: Solutions, b: Solutions) -> Solutions:
    """All solutions of both; variables of one side only are unbound on the other."""
    names = [*a.variables, *(n for n in b.variables if n not in a.variables)]
    values: list[list[Column]] = [[], []]
    kinds: dict[str, Val] = {}
    for n in names:
        x, y = a.variables.get(n), b.variables.get(n)
        if x is not None and y is not None and x.type_key() != y.type_key():
            x, y = Val(x.term()), Val(y.term())
        kind = x if x is not None else y
        kinds[n] = kind
        for side, v in ((0, x), (1, y)):
            none = F.lit(None).cast(TERM_DDL) if kind.form == "term" else F.lit(None)
            values[side].append((v.col if v is not None else none).alias(f"v_{n}"))
    if not names:
        return Solutions(a.df.select(F.lit(1).alias("v_")).union(b.df.select(F.lit(1).alias("v_"))), {})
    df = a.df.select(*values[0]).union(b.df.select(*values[1]))
    maybe = {n for n in names if n not in a.variables or n not in b.variables} | a.maybe | b.maybe
    return Solutions(df, {n: v.on(F.col(f"`v_{n}`")) for n, v in kinds.items()}, maybe)


def distinct(s: Solutions) -> Solutions:
    return Solutions(s.df.distinct(), s.variables, s.maybe)
