"""Vertex programs: gather from neighbours, sum, apply, scatter to a frontier.

Graphs are edges (src, dst and, where needed, weight).  A program's state is a
table with one row for each vertex, written after each round.  Edges are read
once and dealt by their source into parts of about ``ROWS`` edges, where all
rounds meet them, so that only states and sums move; sums are combined before
the shuffle.  Edges of a hot vertex are dealt over several parts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import written

IN, OUT, ALL = "in", "out", "all"
#: Rows of a part, about; parts grow in number, not in size.
ROWS = 1 << 18


def directed(edges: DataFrame, way: str) -> DataFrame:
    """Edges (src, dst, ...) read along, against, or both ways."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)
    return {OUT: edges, IN: back, ALL: edges.unionByName(back)}[way]


def vertices(edges: DataFrame) -> DataFrame:
    """All ends of edges, as ``id``."""
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def parts(rows: int) -> int:
    """The number of parts for so many rows."""
    return max(1, -(-rows // ROWS))


def distinct_edges(rows: DataFrame) -> DataFrame:
    """Distinct rows of a cheap scan, in as many parts as its rows need."""
    return rows.repartition(parts(rows.count()), *rows.columns).distinct()


@dataclass
class Program:
    """A vertex program over state columns.

    ``init`` gives a vertex's state from ``id``; ``message`` what goes along an
    edge from a frontier vertex (state columns, ``degree``, which is the number
    of edges that leave the vertex, and edge columns such as ``weight``); ``sum``
    combines messages; ``apply`` the new state from the old one, ``sum`` and
    ``round``; ``changed`` says which vertices are the next frontier, from new
    columns and ``old_`` ones.
    """

    init: dict[str, Column]
    message: Column
    sum: Callable[[Column], Column]
    apply: dict[str, Column]
    changed: Column
    way: str = OUT
    start: Column | None = None
    whole: bool = False


def run(program: Program, edges: DataFrame, nodes: DataFrame | None = None, rounds: int | None = None) -> DataFrame:
    """State after no vertex changes, or after ``rounds`` if they are given.

    ``whole`` programs gather over all vertices in each round; others from the
    frontier only.  A ``whole`` program's new state must follow from its sum
    alone: when no vertex that sends has another state than before, later rounds
    would repeat the last one and are left out.
    """
    names = list(program.init)
    links = directed(written(edges), program.way)
    n = parts(links.count())
    dealt = _dealt(links, n)
    try:
        state = _ends(dealt, nodes).select("id", *(c.alias(m) for m, c in program.init.items()), "degree")
        state = written(state.withColumn("active", program.start if program.start is not None else F.lit(True)))
        # At most n of them, as each has more links than a part.
        hot = state.where(F.col("degree") > ROWS).select(F.col("id").alias("src"), F.ceil(F.col("degree") / ROWS).cast("int").alias("salts"))
        hot = None if n == 1 or hot.isEmpty() else written(hot)
        if hot is not None:
            dealt.unpersist()
            dealt = _dealt(links, n, hot)
        for k in count(1) if rounds is None else range(1, rounds + 1):
            from_ = state if program.whole else state.where("active")
            from_ = from_.where("degree > 0").select(F.col("id").alias("src"), *names, "degree")
            keys = ["src"]
            if hot is not None:
                from_ = from_.join(F.broadcast(hot), "src", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
                keys = ["src", "salt"]
            sent = dealt.join(from_, keys).select(F.col("dst").alias("id"), program.message.alias("m"))
            sums = sent.groupBy("id").agg(program.sum(F.col("m")).alias("sum"))
            met = state.select("id", *(F.col(m).alias(f"old_{m}") for m in names), "degree", F.lit(k).alias("round")).join(sums, "id", "left")
            now = met.select("id", *(f"old_{m}" for m in names), "degree", *(program.apply[m].alias(m) for m in names))
            moved = reduce(Column.__or__, (~F.col(m).eqNullSafe(F.col(f"old_{m}")) for m in names)) & (F.col("degree") > 0)
            state = written(now.select("id", *names, "degree", F.coalesce(program.changed, F.lit(False)).alias("active"), moved.alias("moved")))
            if state.where("active").isEmpty() or program.whole and state.where("moved").isEmpty():
                break
    finally:
        dealt.unpersist()
    return state.select("id", *names)


def _dealt(links: DataFrame, n: int, hot: DataFrame | None = None) -> DataFrame:
    """Links kept on disk in ``n`` parts by source; those of hot sources (src, salts) by ``salt`` too."""
    keys = ["src"]
    if hot is not None:
        links = links.join(F.broadcast(hot), "src", "left").withColumn("salt", F.pmod(F.xxhash64("dst"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
        keys = ["src", "salt"]
    return links.repartition(n, *keys).sortWithinPartitions(*keys).persist(StorageLevel.DISK_ONLY)


def _ends(links: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """Vertices (id, degree), those of ``nodes`` if they are given."""
    both = F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("out")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("out")))
    ends = links.select(F.inline(both)).groupBy("id").agg(F.sum("out").alias("degree"))
    return ends if nodes is None else nodes.select("id").distinct().join(ends, "id", "left").fillna(0, ["degree"])


def bfs(edges: DataFrame, source: object, way: str = OUT, rounds: int | None = None) -> DataFrame:
    """(id, depth, predecessor): depth 0 at the source, -1 and no predecessor where not reached."""
    none = F.lit(None).cast(edges.schema["src"].dataType)
    found = run(
        Program(
            {"depth": F.when(F.col("id") == F.lit(source), 0), "predecessor": none},
            F.col("src"),
            F.min,
            {"depth": F.coalesce("old_depth", F.when(F.col("sum").isNotNull(), F.col("round"))), "predecessor": F.when(F.col("old_depth").isNull(), F.col("sum")).otherwise(F.col("old_predecessor"))},
            F.col("old_depth").isNull() & F.col("depth").isNotNull(),
            way,
            F.col("id") == F.lit(source),
        ),
        edges,
        rounds=rounds,
    )
    return found.select("id", F.coalesce("depth", F.lit(-1)).alias("depth"), "predecessor")


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component): the smallest id that is connected, whatever the direction.

    Links are contracted to stars: in turns all larger and all smaller neighbours
    of a vertex are linked to the smallest.  The rounds grow with the logarithm
    of the vertices, not with the diameter.
    """
    links = written(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b").distinct())
    every = vertices(edges) if nodes is None else nodes.select("id").distinct()
    seen = None
    while True:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        larger = written(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        down = larger.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        smaller = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        links = written(smaller.where("a <> b").distinct())
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
    roots = links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    return every.join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85, epsilon: float | None = None) -> DataFrame:
    """(id, rank): 0.15 + 0.85 times the sum of rank over out-degree; vertices without in-edges keep their start, 0.15.

    With ``epsilon`` it ends when no rank grows by more than that.
    """
    base = F.lit(1 - damping)
    grown = F.col("rank") - F.col("old_rank") > epsilon if epsilon is not None else F.lit(True)
    return run(
        Program({"rank": base}, F.col("rank") / F.col("degree"), F.sum, {"rank": F.when(F.col("sum").isNull(), F.col("old_rank")).otherwise(base + F.lit(damping) * F.col("sum"))}, grown, whole=True),
        edges.select("src", "dst"),
        rounds=rounds,
    )


def sssp(edges: DataFrame, source: object, way: str = OUT, rounds: int | None = None) -> DataFrame:
    """(id, distance): the least sum of weights from the source, NULL where there is no way."""
    return run(
        Program(
            {"distance": F.when(F.col("id") == F.lit(source), F.lit(0.0))},
            F.col("distance") + F.col("weight"),
            F.min,
            {"distance": F.least("old_distance", "sum")},
            F.col("distance").isNotNull() & (F.col("old_distance").isNull() | (F.col("distance") < F.col("old_distance"))),
            way,
            F.col("id") == F.lit(source),
        ),
        edges,
        rounds=rounds,
    )


def fuzzy_sssp(edges: DataFrame, sources: list, targets: list, hops: int = 1) -> DataFrame:
    """Vertices on shortest unweighted ways between sources and targets, and those within ``hops`` of them."""
    edges = written(edges)
    ends = {t: written(bfs(edges, t, IN).where("depth >= 0").select("id", F.col("depth").alias("back"))) for t in targets}
    ways = []
    for s in sources:
        ahead = written(bfs(edges, s).where("depth >= 0"))
        long = dict(ahead.where(F.col("id").isin(targets)).select("id", "depth").collect()) if targets else {}
        ways += [ahead.join(ends[t], "id").where(F.col("depth") + F.col("back") == long[t]).select("id") for t in targets if t in long]
    found = reduce(DataFrame.union, ways) if ways else None
    if found is None:
        return vertices(edges).limit(0)
    near = found = written(found.distinct())
    both = directed(edges, ALL).select("src", "dst")
    for _ in range(hops):
        near = both.join(near.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        found = written(found.union(near).distinct())
    return found


def sample_vertices(edges: DataFrame, n: int, by: str = "uniform", seed: int = 1) -> DataFrame:
    """``n`` vertices drawn without repeats, uniformly or with the chance of their in-, out- or all edges."""
    if by == "uniform":
        weighted = vertices(edges).withColumn("w", F.lit(1.0))
    else:
        weighted = directed(edges.select("src", "dst"), by).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    key = F.log(F.rand(seed) + 1e-300) / F.col("w")
    return weighted.orderBy(key.desc(), "id").limit(n).select("id")


def edges_of(graph, predicate: str | None = None, g: object = None) -> DataFrame:
    """Edges (src, dst) of a graph by lexical form: links between resources, of one predicate or of all."""
    from ..plans.algebra import Triple, Var
    from ..terms import iri

    found = graph.triple(Triple(Var("s"), iri(predicate) if predicate else Var("p"), Var("o")), g)
    s, o = found.val("s"), found.val("o")
    return found.df.where(o.kind() < 4).select(s.lex().alias("src"), o.lex().alias("dst"))


def weights_of(graph, edges: DataFrame, weight, predicate: str | None = None, g: object = None) -> DataFrame:
    """Edges with the weight that a statement about the quoted edge gives; 1 where there is none."""
    from ..plans.algebra import Triple, Var

    found = graph.triple(Triple(Var("s"), weight, Var("o")), g)
    part = lambda n: F.regexp_extract(found.val("s").lex(), r"^<<\s*<([^>]*)>\s+<([^>]*)>\s+<([^>]*)>\s*>>$", n)
    rows = found.df.select(part(1).alias("src"), part(2).alias("p"), part(3).alias("dst"), found.val("o").lex().try_cast("double").alias("weight"))
    rows = rows.where(F.col("p") == predicate if predicate else F.col("p") != "").select("src", "dst", "weight")
    return edges.join(rows, ["src", "dst"], "left").fillna(1.0, ["weight"])
