"""Compatible joins against brute force, with every pattern of bound and unbound join variables."""

from itertools import product

import pytest

from triloom.operators import joins
from triloom.sources.graphs import constants
from triloom.terms import literal

VALUES = [None, 1, 2]


def side(spark, own, rows):
    return constants(spark, ["x", "y", own], [[None if v is None else literal(v) for v in r] for r in rows])


def plain(s):
    rows = s.df.select(*(s.val(n).lex().alias(n) for n in s.variables)).collect()
    return sorted((tuple(sorted((k, v) for k, v in r.asDict().items() if v is not None)) for r in rows), key=repr)


def bindings(names, rows):
    return [{n: str(v) for n, v in zip(names, r, strict=True) if v is not None} for r in rows]


def agree(a, b):
    return all(a[k] == b[k] for k in a.keys() & b.keys())


def frozen(rows):
    return sorted((tuple(sorted(r.items())) for r in rows), key=repr)


@pytest.fixture(scope="module")
def sides(spark):
    left = [(x, y, 10 + k) for k, (x, y) in enumerate(product(VALUES, VALUES))]
    right = [(x, y, 20 + k) for k, (x, y) in enumerate(product(VALUES, VALUES))]
    return left, right, side(spark, "a", left), side(spark, "b", right), bindings("xya", left), bindings("xyb", right)


def test_inner(sides):
    _, _, a, b, p, q = sides
    assert plain(joins.inner(a, b)) == frozen([l | r for l in p for r in q if agree(l, r)])


def test_left_outer(sides):
    _, _, a, b, p, q = sides
    want = [m for l in p for m in ([l | r for r in q if agree(l, r)] or [l])]
    assert plain(joins.left_outer(a, b)) == frozen(want)


def test_minus(sides):
    _, _, a, b, p, q = sides
    want = [l for l in p if not any(agree(l, r) and (l.keys() & r.keys()) for r in q)]
    assert plain(joins.semi(a, b, anti=True, minus=True)) == frozen(want)


def test_semi_and_flag(spark, sides):
    left, right, a, _, p, _ = sides
    few = [r for r in right if r[0] == 1 and r[1] is not None]
    b, q = side(spark, "b", few), bindings("xyb", few)
    assert plain(joins.semi(a, b)) == frozen([l for l in p if any(agree(l, r) for r in q)])
    flagged, hit = joins.flag(a, b)
    got = flagged.df.select(flagged.val("a").lex().alias("a"), hit.alias("h")).collect()
    assert {r.a: r.h for r in got} == {l["a"]: any(agree(l, r) for r in q) for l in p}


def test_union_pads(spark, sides):
    _, _, a, b, p, q = sides
    assert plain(joins.union(a, b)) == frozen(p + q)
