"""Forward-chaining inference: RDFS, and OWL rules, as fixpoints of joins.

Triples are (s, p, o) structs.  A rule is a function from the triples that are
known, and those of them that are new, to the conclusions that need a new one; a
round applies all rules to what the last round added.  Rules that take the known
triples only are applied to all of them.  The fast program closes the
schema first, which is small, and then makes one pass over the data for each
kind of entailment.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from inspect import signature

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.graphs import AXIOM, EXPLICIT, INFERRED
from ..store import written
from ..terms import LITERAL, OWL, RDF, RDFS, TERM_DDL, Term, constant, iri
from .paths import closure

TYPE, SUBCLASS, SUBPROPERTY, DOMAIN, RANGE = (iri(x) for x in (RDF + "type", RDFS + "subClassOf", RDFS + "subPropertyOf", RDFS + "domain", RDFS + "range"))
RESOURCE, PROPERTY, CLASS, DATATYPE, LITERALS, MEMBER, CONTAINER = (iri(x) for x in (RDFS + "Resource", RDF + "Property", RDFS + "Class", RDFS + "Datatype", RDFS + "Literal", RDFS + "member", RDFS + "ContainerMembershipProperty"))
SAME, EQUIVALENT_CLASS, EQUIVALENT_PROPERTY, INVERSE, SYMMETRIC, TRANSITIVE, FUNCTIONAL, INVERSE_FUNCTIONAL, ON_PROPERTY, HAS_VALUE = (
    iri(OWL + x) for x in ("sameAs", "equivalentClass", "equivalentProperty", "inverseOf", "SymmetricProperty", "TransitiveProperty", "FunctionalProperty", "InverseFunctionalProperty", "onProperty", "hasValue")
)

Rule = Callable[..., DataFrame]


def is_(column: str, term: Term) -> Column:
    return (F.col(f"{column}.kind") == term.kind) & (F.col(f"{column}.lex") == term.lex)


def _of(t: DataFrame, p: Term, o: Term | None = None) -> DataFrame:
    rows = t.where(is_("p", p))
    return rows.where(is_("o", o)) if o else rows


def _make(df: DataFrame, s: Column | Term, p: Column | Term, o: Column | Term) -> DataFrame:
    put = lambda x: constant(x) if isinstance(x, Term) else x
    return df.select(put(s).alias("s"), put(p).alias("p"), put(o).alias("o"))


def _chain(a: DataFrame, b: DataFrame, p: Term) -> DataFrame:
    """a (x to y) then b (y to z), as x p z."""
    return _make(a.select("s", F.col("o").alias("m")).join(b.select(F.col("s").alias("m"), "o"), "m"), F.col("s"), p, F.col("o"))


def _either(t: DataFrame, d: DataFrame | None, left: Callable[[DataFrame], DataFrame], right: Callable[[DataFrame], DataFrame], join: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """A rule of two premises over all triples, or (with ``d``) where one of them is new."""
    if d is None:
        return join(left(t), right(t))
    return join(left(d), right(t)).union(join(left(t), right(d)))


# --- RDFS, by the names of the specification


def rdf1(t: DataFrame, d: DataFrame | None = None) -> DataFrame:
    t = t if d is None else d
    return _make(t.select("p").distinct(), F.col("p"), TYPE, PROPERTY)


def rdfs2(t: DataFrame, d: DataFrame | None = None) -> DataFrame:
    of = lambda x: _of(x, DOMAIN).select(F.col("s").alias("p"), F.col("o").alias("c"))
    return _either(t, d, lambda x: x.select("s", "p"), of, lambda a, b: _make(a.join(b, "p"), F.col("s"), TYPE, F.col("c")))


def rdfs3(t: DataFrame, d: DataFrame | None = None) -> DataFrame:
    of = lambda x: _of(x, RANGE).select(F.col("s").alias("p"), F.col("o").alias("c"))
    return _either(t, d, lambda x: x.where(F.col("o.kind") != LITERAL).select("o", "p"), of, lambda a, b: _make(a.join(b, "p"), F.col("o"), TYPE, F.col("c")))


def rdfs4a(t: DataFrame, d: DataFrame | None = None) -> DataFrame:
    t = t if d is None else d
    return _make(t.select("s").distinct(), F.col("s"), TYPE, RESOURCE)


def rdfs4b(t: DataFrame, d: DataFrame | None = None) -> DataFrame:
    t = t if d is None else d
    return _make(t.where(F.col("o.kind") != LITERAL).select("o").distinct(), F.col("o"), TYPE, RESOURCE)


def rdfs5(t: DataFrame, d: DataFrame | None = None) -> DataFrame:
    of = lambda x: _of(x, SUBPROPERTY)
    return _either(t, d, of, of, lambda a, b: _chain(a, b, SUBPROPERTY))


def rdfs6(t: DataFrame, d: DataFrame | None = None) -> DataFrame:
    t = t if d is None else d
    return _make(_of(t, TYPE, PROPERTY), F.col("s"), SUBPROPERTY, F.col("s"))


def rdfs7(t: DataFrame, d: DataFrame | None = None) -> DataFrame:
    of = lambda x: _of(x, SUBPROPERTY).select(F.col("s").alias("p"), F.col("o").alias("q")).where("p <> q")
    return _either(t, d, lambda x: x, of, lambda a, b: _make(a.join(b, "p"), F.col("s"), F.col("q"), F.col("o")))


def rdfs8(t: DataFrame, d: DataFrame | None = None) -> DataFrame:
    t = t if d is None else d
    return _make(_of(t, TYPE, CLASS), F.col("s"), SUBCLASS, RESOURCE)


def rdfs9(t: DataFrame, d: DataFrame | None = None) -> DataFrame:
    return _either(t, d, lambda x: _of(x, TYPE), lambda x: _of(x, SUBCLASS), lambda a, b: _chain(a, b, TYPE))


def rdfs10(t: DataFrame, d: DataFrame | None = None) -> DataFrame:
    t = t if d is None else d
    return _make(_of(t, TYPE, CLASS), F.col("s"), SUBCLASS, F.col("s"))


def rdfs11(t: DataFrame, d: DataFrame | None = None) -> DataFrame:
    of = lambda x: _of(x, SUBCLASS)
    return _either(t, d, of, of, lambda a, b: _chain(a, b, SUBCLASS))


def rdfs12(t: DataFrame, d: DataFrame | None = None) -> DataFrame:
    t = t if d is None else d
    return _make(_of(t, TYPE, CONTAINER), F.col("s"), SUBPROPERTY, MEMBER)


def rdfs13(t: DataFrame, d: DataFrame | None = None) -> DataFrame:
    t = t if d is None else d
    return _make(_of(t, TYPE, DATATYPE), F.col("s"), SUBCLASS, LITERALS)


# --- OWL


def same_symmetric(t: DataFrame, d: DataFrame | None = None) -> DataFrame:
    t = t if d is None else d
    return _make(_of(t, SAME), F.col("o"), SAME, F.col("s"))


def same_transitive(t: DataFrame, d: DataFrame | None = None) -> DataFrame:
    of = lambda x: _of(x, SAME)
    return _either(t, d, of, of, lambda a, b: _chain(a, b, SAME).where("s <> o"))


def same_subject(t: DataFrame, d: DataFrame | None = None) -> DataFrame:
    of = lambda x: _of(x, SAME).select("s", F.col("o").alias("x")).where("s <> x")
    return _either(t, d, lambda x: x.where(~is_("p", SAME)), of, lambda a, b: _make(a.join(b, "s"), F.col("x"), F.col("p"), F.col("o")))


def same_object(t: DataFrame, d: DataFrame | None = None) -> DataFrame:
    of = lambda x: _of(x, SAME).select(F.col("s").alias("o"), F.col("o").alias("x")).where("o <> x")
    return _either(t, d, lambda x: x.where(~is_("p", SAME)), of, lambda a, b: _make(a.join(b, "o"), F.col("s"), F.col("p"), F.col("x")))


def _equivalent(p: Term, sub: Term) -> Rule:
    def rule(t: DataFrame, d: DataFrame | None = None) -> DataFrame:
        a = _of(t if d is None else d, p)
        return _make(a, F.col("s"), sub, F.col("o")).union(_make(a, F.col("o"), sub, F.col("s"))).union(_make(a, F.col("o"), p, F.col("s")))

    return rule


def inverse(t: DataFrame, d: DataFrame | None = None) -> DataFrame:
    def both(x: DataFrame) -> DataFrame:
        a = _of(x, INVERSE)
        return a.select(F.col("s").alias("p"), F.col("o").alias("q")).union(a.select("o", "s"))

    return _either(t, d, lambda x: x.where(F.col("o.kind") != LITERAL), both, lambda a, b: _make(a.join(b, "p"), F.col("o"), F.col("q"), F.col("s")))


def _typed(t: DataFrame, kind: Term) -> DataFrame:
    return t.join(_of(t, TYPE, kind).select(F.col("s").alias("p")).distinct(), "p", "left_semi").select("s", "p", "o")


def symmetric(t: DataFrame, d: DataFrame | None = None) -> DataFrame:
    of = lambda x: _of(x, TYPE, SYMMETRIC).select(F.col("s").alias("p")).distinct()
    return _either(t, d, lambda x: x.where(F.col("o.kind") != LITERAL), of, lambda a, b: _make(a.join(b, "p", "left_semi"), F.col("o"), F.col("p"), F.col("s")))


def transitive(t: DataFrame) -> DataFrame:
    a = _typed(t, TRANSITIVE)
    two = a.select("s", "p", F.col("o").alias("m")).join(a.select(F.col("s").alias("m"), "p", "o"), ["m", "p"])
    return _make(two, F.col("s"), F.col("p"), F.col("o"))


def has_value(t: DataFrame) -> DataFrame:
    wanted = _of(t, ON_PROPERTY).select("s", F.col("o").alias("q")).join(_of(t, HAS_VALUE).select("s", F.col("o").alias("v")), "s").withColumnRenamed("s", "c")
    have = t.select("s", F.col("p").alias("q"), F.col("o").alias("v")).join(wanted, ["q", "v"])
    members = _of(t, TYPE).select("s", F.col("o").alias("c")).join(wanted, "c")
    return _make(have, F.col("s"), TYPE, F.col("c")).union(_make(members, F.col("s"), F.col("q"), F.col("v")))


def functional(t: DataFrame) -> DataFrame:
    a = _typed(t, FUNCTIONAL).where(F.col("o.kind") != LITERAL)
    first = a.groupBy("s", "p").agg(F.min("o").alias("m"))
    return _make(a.join(first, ["s", "p"]).where("o <> m"), F.col("m"), SAME, F.col("o"))


def inverse_functional(t: DataFrame) -> DataFrame:
    a = _typed(t, INVERSE_FUNCTIONAL)
    first = a.groupBy("o", "p").agg(F.min("s").alias("m"))
    return _make(a.join(first, ["o", "p"]).where("s <> m"), F.col("m"), SAME, F.col("s"))


RDFS_RULES: list[Rule] = [rdf1, rdfs2, rdfs3, rdfs4a, rdfs4b, rdfs5, rdfs6, rdfs7, rdfs8, rdfs9, rdfs10, rdfs11, rdfs12, rdfs13]
OWL_RULES: list[Rule] = [same_symmetric, same_transitive, same_subject, same_object, _equivalent(EQUIVALENT_CLASS, SUBCLASS), _equivalent(EQUIVALENT_PROPERTY, SUBPROPERTY), inverse, symmetric, transitive, has_value, functional, inverse_functional]
#: Rules that applications add to the full program.
CUSTOM_RULES: list[Rule] = []

#: What holds in every RDFS graph.
AXIOMS: list[tuple[Term, Term, Term]] = [
    *((p, TYPE, PROPERTY) for p in (TYPE, SUBCLASS, SUBPROPERTY, DOMAIN, RANGE, MEMBER)),
    *((c, TYPE, CLASS) for c in (RESOURCE, PROPERTY, CLASS, DATATYPE, LITERALS, CONTAINER)),
    (SUBCLASS, DOMAIN, CLASS), (SUBCLASS, RANGE, CLASS), (SUBPROPERTY, DOMAIN, PROPERTY), (SUBPROPERTY, RANGE, PROPERTY), (DOMAIN, DOMAIN, PROPERTY), (DOMAIN, RANGE, CLASS), (RANGE, DOMAIN, PROPERTY), (RANGE, RANGE, CLASS), (TYPE, RANGE, CLASS), (DATATYPE, SUBCLASS, CLASS), (CONTAINER, SUBCLASS, PROPERTY),
]


def axioms(spark) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*(F.struct(*(constant(x).alias(n) for n, x in zip("spo", a, strict=True))) for a in AXIOMS))))


#: Parts of the known triples before they are written as one.
PARTS = 8


def _apply(rules: list[Rule], known: DataFrame, new: DataFrame | None) -> DataFrame:
    """Conclusions of some rules; with ``new``, of those that need a new triple where rules can tell."""
    made = [r(known, new) if new is not None and len(signature(r).parameters) > 1 else r(known) for r in rules]
    return reduce(DataFrame.union, made).where(F.col("s.kind") != LITERAL)


def fixpoint(triples: DataFrame, rules: list[Rule], new: DataFrame | None = None) -> DataFrame:
    """Triples with all conclusions of some rules, each once.

    With ``new`` the others are closed already: only what follows from the new
    ones is looked for.  Each round writes what it adds.
    """
    known, parts = written(triples.select("s", "p", "o").distinct()), 1
    if new is not None:
        new = written(new.select("s", "p", "o").distinct().join(known, ["s", "p", "o"], "left_anti"))
        known, parts = known.union(new), 2
    while new is None or not new.isEmpty():
        new = written(_apply(rules, known, new).distinct().join(known, ["s", "p", "o"], "left_anti"))
        known, parts = known.union(new), parts + 1
        if parts >= PARTS:
            known, parts = written(known), 1
    return known


def full_closure(triples: DataFrame, owl: bool = True, with_axioms: bool = True) -> DataFrame:
    """All RDFS (and OWL) entailments by rounds of all rules."""
    base = triples.select("s", "p", "o")
    if with_axioms:
        base = base.union(axioms(triples.sparkSession))
    return fixpoint(base, _rules(owl))


def _rules(owl: bool) -> list[Rule]:
    return RDFS_RULES + (OWL_RULES if owl else []) + CUSTOM_RULES


def _pairs(t: DataFrame, p: Term) -> DataFrame:
    return _of(t, p).select("s", "o").where("s <> o").distinct()


def _rows(pairs: DataFrame, p: Term) -> DataFrame:
    return _make(pairs, F.col("s"), p, F.col("o"))


def fast_closure(triples: DataFrame, with_axioms: bool = True) -> DataFrame:
    """All RDFS entailments in a fixed order of steps; the same triples as the full program without OWL."""
    t = triples.select("s", "p", "o").distinct()
    if with_axioms:
        t = t.union(axioms(triples.sparkSession)).distinct()
    t = written(t)
    while True:
        schema = _schema(t)
        done = written(_data(t, schema))
        # Data can say more about the schema, through subproperties of its predicates.
        if done.join(t, ["s", "p", "o"], "left_anti").where(reduce(lambda a, b: a | b, (is_("p", p) for p in (SUBCLASS, SUBPROPERTY, DOMAIN, RANGE))) | (is_("p", TYPE) & reduce(lambda a, b: a | b, (is_("o", c) for c in (CLASS, PROPERTY, DATATYPE, CONTAINER))))).isEmpty():
            return done
        t = done


def _schema(t: DataFrame) -> dict[str, DataFrame]:
    properties = written(closure(written(_pairs(t, SUBPROPERTY)), 1, None))
    classes = written(closure(written(_pairs(t, SUBCLASS)), 1, None))
    return {"properties": properties, "classes": classes}


def _data(t: DataFrame, schema: dict[str, DataFrame]) -> DataFrame:
    """One pass for each kind of entailment over data under a closed schema."""
    up = schema["properties"].select(F.col("s").alias("p"), F.col("o").alias("q"))
    t = t.union(_rows(schema["properties"], SUBPROPERTY)).union(_rows(schema["classes"], SUBCLASS))
    t = t.union(_make(t.join(up, "p"), F.col("s"), F.col("q"), F.col("o")))
    t = written(t.distinct())
    t = t.union(rdf1(t)).union(rdfs2(t)).union(rdfs3(t)).union(rdfs4a(t)).union(rdfs4b(t))
    t = written(t.where(F.col("s.kind") != LITERAL).distinct())
    lift = schema["classes"].select(F.col("s").alias("o"), F.col("o").alias("c"))
    t = t.union(_make(_of(t, TYPE).join(lift, "o"), F.col("s"), TYPE, F.col("c"))).distinct()
    t = t.union(rdfs6(t)).union(rdfs8(t)).union(rdfs10(t)).union(rdfs12(t)).union(rdfs13(t))
    return t.where(F.col("s.kind") != LITERAL).distinct()


def closed_quads(quads: DataFrame, close: Callable[[DataFrame], DataFrame] = full_closure) -> DataFrame:
    """Quads with inferred statements: told ones keep their type, axioms and conclusions get theirs."""
    told = quads.where(F.col("st") == EXPLICIT)
    known = told.select("s", "p", "o").distinct()
    base = axioms(quads.sparkSession)
    fresh = close(known).join(known, ["s", "p", "o"], "left_anti")
    kind = F.when(F.col("is_axiom"), AXIOM).otherwise(INFERRED).cast("tinyint")
    flagged = fresh.join(base.withColumn("is_axiom", F.lit(True)), ["s", "p", "o"], "left").withColumn("is_axiom", F.coalesce("is_axiom", F.lit(False)))
    return told.unionByName(flagged.select("s", "p", "o", F.lit(None).cast(TERM_DDL).alias("g"), kind.alias("st")))


def assert_delta(closed: DataFrame, new: DataFrame, owl: bool = True) -> DataFrame:
    """The closure after triples are added to closed ones: only what follows from the new ones is made."""
    return fixpoint(closed, _rules(owl), new)


def retract(told: DataFrame, gone: DataFrame, closed: DataFrame | None = None, owl: bool = True, with_axioms: bool = True) -> DataFrame:
    """The closure after told triples are removed: conclusions that nothing else supports go too.

    All that follows from the removed triples is taken out of the closure first
    (``closed``, made here if it isn't given); what still follows from the rest
    is put back.
    """
    key, rules = ["s", "p", "o"], _rules(owl)
    closed = full_closure(told, owl, with_axioms) if closed is None else closed.select(*key)
    left = told.select(*key).join(gone.select(*key), key, "left_anti").distinct()
    safe = written(left.union(axioms(told.sparkSession)).distinct() if with_axioms else left)
    out = new = written(closed.join(gone.select(*key), key, "left_semi").join(safe, key, "left_anti").distinct())
    while not new.isEmpty():
        made = _apply(rules, closed, new).distinct().join(closed, key, "left_semi")
        new = written(made.join(safe, key, "left_anti").join(out, key, "left_anti"))
        out = written(out.union(new))
    rest = written(closed.join(out, key, "left_anti"))
    back = _apply(rules, rest, None).distinct().join(out, key, "left_semi")
    return fixpoint(rest, rules, back)


def same_as_expanded(triples: DataFrame) -> DataFrame:
    """Statements seen through owl:sameAs at query time: by canonical ids, not by copies for each pair."""
    from .gas import connected_components

    same = _pairs(triples, SAME).select(F.col("s.lex").alias("src"), F.col("o.lex").alias("dst"))
    ids = written(connected_components(same))
    out = triples
    for at in ("s", "o"):
        named = ids.select(F.col("id").alias("lex"), "component")
        kept = out.join(named, F.col(f"{at}.lex") == named.lex, "left")
        new = F.when(F.col("component").isNotNull() & (F.col(f"{at}.kind") < LITERAL), F.struct(F.col(f"{at}.kind").alias("kind"), F.col("component").alias("lex"), F.col(f"{at}.dt").alias("dt"), F.col(f"{at}.lang").alias("lang"))).otherwise(F.col(at))
        out = kept.withColumn(at, new).select("s", "p", "o")
    return out.distinct()
