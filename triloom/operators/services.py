"""Table functions of queries: search, geospatial, sampling and stored queries.

Each is a SERVICE whose group sets parameters as triples.  Services are named by
the end of their IRI, so any namespace that ends so will do.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.algebra import Group, Triple, Values, Var
from ..plans.compiler import SERVICES, find_service, register_service
from ..plans.parser import parse_query
from ..sources.graphs import Solutions, constants
from ..terms import Term, Val
from .ordering import numbered, spaced

#: The usual English stop words.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with"]


def _parameters(group: Group) -> dict[str, object]:
    """Local names of predicates, and their objects."""
    return {t.p.lex.rsplit("#", 1)[-1].rsplit("/", 1)[-1]: t.o for t in group.parts if isinstance(t, Triple) and isinstance(t.p, Term)}


def _text(x: object, default: str | None = None) -> str | None:
    return x.lex if isinstance(x, Term) else default


# --- full text


#: Analyzers by language tag: from a text to its tokens.
ANALYZERS: dict[str, Callable[[Column], Column]] = {}


def tokens(text: Column, stop: bool = True, pattern: str = r"[\p{L}\p{N}]+", language: str | None = None) -> Column:
    """Lower-case tokens of a text, without stop words if wanted; a language's own analyzer goes first."""
    if language in ANALYZERS:
        return ANALYZERS[language](text)
    found = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(STOP_WORDS)) if stop else found


def completions(text: Column, least: int = 1) -> Column:
    """The beginnings of a text's tokens, for completing what is typed."""
    return F.array_distinct(F.flatten(F.transform(tokens(text, False), lambda w: F.transform(F.sequence(F.lit(least), F.greatest(F.length(w), F.lit(least))), lambda n: F.substring(w, F.lit(1), n)))))


def text_index(texts: DataFrame, id_col: str, text_col: str, stop: bool = True) -> DataFrame:
    """(id, token, weight): a token's weight is its count over the root of the sum of squared counts in the text."""
    counts = texts.select(F.col(id_col).alias("id"), F.explode(tokens(F.col(text_col), stop)).alias("token")).groupBy("id", "token").agg(F.count(F.lit(1)).alias("n"))
    norms = counts.groupBy("id").agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("norm"))
    return counts.join(norms, "id").select("id", "token", (F.col("n") / F.col("norm")).alias("weight"))


def search(index: DataFrame, query: str, all_terms: bool = False, prefix: bool = False, least: float = 0.0, most: float | None = None, min_rank: int = 1, max_rank: int | None = None) -> DataFrame:
    """(id, relevance, rank): the sum of query weight times token weight, ties in order of id.

    A query token that ends in ``*`` (or, with ``prefix``, every one) matches
    tokens that begin so.  ``all_terms`` keeps texts that have all of them.
    """
    words: dict[str, int] = {}
    for w in query.lower().split():
        bare = w.strip('"')
        if bare.rstrip("*") and bare not in STOP_WORDS:
            words[bare] = words.get(bare, 0) + 1
    norm = sum(n * n for n in words.values()) ** 0.5 or 1.0
    matches = []
    for k, (w, n) in enumerate(sorted(words.items())):
        bare = w.rstrip("*")
        match = F.col("token").startswith(bare) if prefix or w.endswith("*") else F.col("token") == bare
        matches.append((match, F.struct(F.lit(k).alias("term"), (F.lit(n / norm) * F.col("weight")).alias("score"))))
    if not matches:
        return index.select("id").limit(0).select("id", F.lit(0.0).alias("relevance"), F.lit(0).alias("rank"))
    # Tokens are filtered first, so that a written index is read only where they are.
    wanted = index.where(reduce(Column.__or__, (m for m, _ in matches)))
    hit = F.filter(F.array(*(F.when(m, x) for m, x in matches)), lambda x: x.isNotNull())
    hits = wanted.select("id", F.explode(hit).alias("h")).groupBy("id").agg(F.sum("h.score").alias("relevance"), F.count_distinct("h.term").alias("terms"))
    if all_terms:
        hits = hits.where(F.col("terms") == len(words))
    hits = hits.where(F.col("relevance") >= least)
    if most is not None:
        hits = hits.where(F.col("relevance") <= most)
    if max_rank is not None:
        # A bounded top list; ranks over it need no shuffle of all hits.
        hits = hits.orderBy(F.desc("relevance"), "id").limit(max_rank)
        ranked = hits.select("id", "relevance", F.row_number().over(Window.orderBy(F.desc("relevance"), "id")).cast("long").alias("rank"))
    else:
        ranked = numbered(hits.select("id", "relevance"), "rank", F.desc("relevance"), F.asc("id"))
    return ranked.where(F.col("rank") >= min_rank)


def _search_service(compiler, group: Group, scope, found) -> Solutions:
    """``?lit x:search "words" ; x:relevance ?r ; x:rank ?k ...``; ``subjectSearch`` takes all literals of a subject as one text."""
    p = _parameters(group)
    if not isinstance(p.get("search"), Term):
        raise ValueError("search needs a query text")
    target = next(t.s for t in group.parts if isinstance(t, Triple) and t.p.lex.endswith("search"))
    every = compiler.graph.triple(Triple(Var("s"), Var("p"), Var("o")), scope.graph)
    o = every.val("o")
    term = o.term()
    literals = every.df.select(every.val("s").term().alias("s"), term.alias("o")).where(F.col("o.kind") == 4)
    if _text(p.get("subjectSearch"), "false") == "true":
        texts = literals.groupBy(F.col("s").alias("t")).agg(F.array_join(F.array_sort(F.collect_list("o.lex")), " ").alias("text"))
    else:
        texts = literals.select(F.col("o").alias("t")).distinct().withColumn("text", F.col("t.lex"))
    number = lambda n, d=None: float(_text(p[n])) if isinstance(p.get(n), Term) else d
    query = p["search"].lex
    if regex := _text(p.get("matchRegex")):
        texts = texts.where(F.col("text").rlike(regex))
    if _text(p.get("matchExact"), "false") == "true":
        texts = texts.where(F.lower("text").contains(query.lower().strip('"')))
    top = number("maxRank")
    hits = search(text_index(texts, "t", "text"), query, _text(p.get("matchAllTerms"), "false") == "true", _text(p.get("prefixMatch"), "false") == "true", number("minRelevance", 0.0), number("maxRelevance"), int(number("minRank", 1)), int(top) if top else None)
    if isinstance(p.get("rangeCount"), Var):
        return Solutions.of(hits.agg(F.count(F.lit(1)).alias("n")), {p["rangeCount"].name: Val(F.col("n"), "literal", "http://www.w3.org/2001/XMLSchema#integer")})
    values = {target.name: Val(F.col("id"))}
    if isinstance(p.get("relevance"), Var):
        values[p["relevance"].name] = Val(F.col("relevance"), "literal", "http://www.w3.org/2001/XMLSchema#double")
    if isinstance(p.get("rank"), Var):
        values[p["rank"].name] = Val(F.col("rank").cast("long"), "literal", "http://www.w3.org/2001/XMLSchema#integer")
    return Solutions.of(hits, values)


# --- geospatial

#: Metres in a unit.
UNITS = {"meters": 1.0, "kilometers": 1000.0, "feet": 0.3048, "miles": 1609.344, "nauticalmiles": 1852.0}


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, unit: str = "Meters") -> Column:
    """The great-circle distance by the spherical law of cosines, in a unit."""
    a, b = F.radians(lat1), F.radians(lat2)
    inner = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(lon1 - lon2))
    # A degree of arc is 60 nautical miles of 1.1515 statute miles of 1609.344 m.
    metres = F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), inner)))) * F.lit(60 * 1.1515 * 1609.344)
    return F.when((lat1 == lat2) & (lon1 == lon2), 0.0).otherwise(metres / F.lit(UNITS[unit.lower()]))


def in_rectangle(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def in_circle(lat: Column, lon: Column, centre_lat: float, centre_lon: float, radius: float, unit: str = "Kilometers") -> Column:
    """Within a circle; a box that holds it comes first, so that readers can skip rows."""
    metres = radius * UNITS[unit.lower()]
    reach = metres / (60 * 1.1515 * 1609.344) * 1.000001
    box = lat.between(centre_lat - reach, centre_lat + reach)
    return box & (distance(lat, lon, F.lit(float(centre_lat)), F.lit(float(centre_lon)), unit) <= radius)


def z_order(*parts: Column, bits: int = 16) -> Column:
    """Interleaved bits of whole numbers, for clustering a table by several columns."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        for k, p in enumerate(parts):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(p.cast("long"), b).bitwiseAND(F.lit(1).cast("long")), b * len(parts) + k))
    return out


def degrees_of(text: Column) -> Column:
    """Decimal degrees of ``48 12.5 N`` (degrees, decimal minutes, and a side)."""
    part = lambda n: F.regexp_extract(text, r"(\d+)[°\s]+([\d.]+)['\s]*([NSEW])", n)
    value = part(1).try_cast("double") + part(2).try_cast("double") / 60
    return F.when(part(3).isin("S", "W"), -value).otherwise(value)


def _geo_service(compiler, group: Group, scope, found) -> Solutions:
    """``?s x:search "inCircle" ; x:predicate :p ; x:spatialCircleCenter "lat#lon" ; x:spatialCircleRadius "1" ...`` over literals lat#lon[#time[#coord]]."""
    p = _parameters(group)
    subject = next(t.s for t in group.parts if isinstance(t, Triple))
    every = compiler.graph.triple(Triple(Var("s"), p["predicate"], Var("o")), scope.graph)
    o = every.val("o")
    fields = F.split(o.lex(), "#")
    at = lambda k: F.get(fields, F.lit(k)).try_cast("double")
    rows = every.df.select(every.val("s").term().alias("s"), o.term().alias("o"), at(0).alias("lat"), at(1).alias("lon"), at(2).alias("time"), F.get(fields, F.lit(3)).alias("coord"))
    rows = rows.where("lat is not null and lon is not null")
    unit = _text(p.get("spatialUnit"), "Kilometers")
    away = F.lit(None).cast("double")
    if _text(p.get("search")) == "inCircle":
        lat, lon = map(float, _text(p["spatialCircleCenter"]).split("#")[:2])
        rows = rows.where(in_circle(F.col("lat"), F.col("lon"), lat, lon, float(_text(p["spatialCircleRadius"])), unit))
        away = distance(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon), unit)
    else:
        south, west = map(float, _text(p["spatialRectangleSouthWest"]).split("#")[:2])
        north, east = map(float, _text(p["spatialRectangleNorthEast"]).split("#")[:2])
        rows = rows.where(in_rectangle(F.col("lat"), F.col("lon"), south, west, north, east))
    if "timeStart" in p:
        rows = rows.where(F.col("time") >= float(_text(p["timeStart"])))
    if "timeEnd" in p:
        rows = rows.where(F.col("time") <= float(_text(p["timeEnd"])))
    if isinstance(p.get("coordSystem"), Term):
        rows = rows.where(F.col("coord") == p["coordSystem"].lex)
    double, text = "http://www.w3.org/2001/XMLSchema#double", "http://www.w3.org/2001/XMLSchema#string"
    made = {"locationValue": Val(F.col("o")), "latValue": Val(F.col("lat"), "literal", double), "lonValue": Val(F.col("lon"), "literal", double), "timeValue": Val(F.col("time"), "literal", double), "coordSystemValue": Val(F.col("coord"), "literal", text), "distanceValue": Val(away, "literal", double)}
    values = {subject.name: Val(F.col("s"))}
    values |= {p[n].name: v for n, v in made.items() if isinstance(p.get(n), Var)}
    return Solutions.of(rows, values, {n for n in values if n != subject.name})


# --- others


def _sample_service(compiler, group: Group, scope, found) -> Solutions:
    """A sample of a pattern's solutions: ``limit``, ``seed`` and ``sampleType`` (even or random) by hint-like triples."""
    p = _parameters(Group([t for t in group.parts if isinstance(t, Triple) and t.p.lex.rsplit(".", 1)[-1].rsplit("#", 1)[-1] in ("limit", "seed", "sampleType")]))
    pattern = Group([t for t in group.parts if not (isinstance(t, Triple) and isinstance(t.p, Term) and t.p.lex.rsplit("#", 1)[-1] in ("limit", "seed", "sampleType"))])
    rows = compiler.group(pattern, scope)
    n, seed = int(_text(p.get("limit"), "100")), int(_text(p.get("seed"), "1"))
    kind = (_text(p.get("sampleType")) or "random").rsplit("#", 1)[-1].lower()
    if kind not in ("even", "random"):
        raise ValueError(f"unknown type of sample {kind}")
    if kind == "even":
        drawn = spaced(rows.df, n, *(k.asc_nulls_first() for v in sorted(rows.variables) for k in rows.val(v).order_keys()))
    else:
        drawn = rows.df.orderBy(F.rand(seed)).limit(n)
    return Solutions(drawn, rows.variables, rows.maybe)


def _values_service(compiler, group: Group, scope, found) -> Solutions:
    """Inline values."""
    v = next(p for p in group.parts if isinstance(p, Values))
    return constants(compiler.spark, [n.name for n in v.names], v.rows)


def _path_service(compiler, group: Group, scope, found) -> Solutions:
    """A bounded walk along one pattern's edges: min and max length, and direction (forward, reverse, undirected)."""
    from .gas import directed
    from .paths import closure

    from ..store import written

    p = _parameters(group)
    edge = next(t for t in group.parts if isinstance(t, Triple) and t.p.lex.rsplit("#", 1)[-1] not in ("minLength", "maxLength", "direction"))
    step = compiler.graph.triple(Triple(Var("s"), edge.p, Var("o")), scope.graph)
    edges = step.df.select(step.val("s").term().alias("src"), step.val("o").term().alias("dst")).distinct()
    way = {"forward": "out", "reverse": "in", "undirected": "all"}[_text(p.get("direction"), "forward")]
    low, high = int(_text(p.get("minLength"), "1")), _text(p.get("maxLength"))
    links = written(directed(edges, way).select(F.col("src").alias("s"), F.col("dst").alias("o")).distinct())
    nodes = links.select("s")
    pairs = closure(links, low, int(high) if high else None, None, nodes)
    values, rows = {}, pairs
    for at, x in (("s", edge.s), ("o", edge.o)):
        if isinstance(x, Var):
            values[x.name] = Val(F.col(at))
        else:
            rows = rows.where((F.col(f"{at}.kind") == x.kind) & (F.col(f"{at}.lex") == x.lex))
    return Solutions.of(rows, values)


def _walk_service(compiler, group: Group, scope, found) -> Solutions:
    """A vertex program as a table function.

    ``gasClass`` is BFS, CC, PR, SSSP or FuzzySSSP; ``linkType`` names the
    predicate of edges, ``linkAttrType`` that of their weights, said of the
    quoted edge; ``traversalDirection`` is Forward, Reverse or Undirected; ``in``
    is a start and ``target`` an end (each any number of times), ``maxIterations``
    a limit on rounds; ``out`` and ``out1`` (BFS: ``out2`` the predecessor) take
    vertices and states.
    """
    from . import gas

    p = _parameters(group)
    many = lambda n: sorted({t.o.lex for t in group.parts if isinstance(t, Triple) and isinstance(t.p, Term) and t.p.lex.rsplit("#", 1)[-1] == n and isinstance(t.o, Term)})
    name = (_text(p.get("gasClass")) or "").rsplit(".", 1)[-1].rsplit("#", 1)[-1].upper()
    way = {"forward": gas.OUT, "reverse": gas.IN, "undirected": gas.ALL}[(_text(p.get("traversalDirection")) or "Forward").lower()]
    edges = gas.edges_of(compiler.graph, _text(p.get("linkType")), scope.graph)
    start = _text(p.get("in"))
    rounds = int(_text(p["maxIterations"])) if "maxIterations" in p else None
    xsd = "http://www.w3.org/2001/XMLSchema#"
    columns = {}
    if name == "BFS":
        rows = gas.bfs(edges, start, way, rounds).where("depth >= 0")
        columns = {"out1": Val(F.col("depth").cast("long"), "literal", xsd + "integer"), "out2": Val(F.col("predecessor"), "iri")}
    elif name == "CC":
        rows, columns = gas.connected_components(edges), {"out1": Val(F.col("component"), "iri")}
    elif name == "PR":
        rows, columns = gas.pagerank(gas.directed(edges, way), rounds or 20), {"out1": Val(F.col("rank"), "literal", xsd + "double")}
    elif name == "SSSP":
        weighted = gas.weights_of(compiler.graph, edges, p["linkAttrType"], _text(p.get("linkType")), scope.graph) if "linkAttrType" in p else edges.withColumn("weight", F.lit(1.0))
        rows, columns = gas.sssp(weighted, start, way, rounds).where("distance is not null"), {"out1": Val(F.col("distance"), "literal", xsd + "double")}
    elif name == "FUZZYSSSP":
        rows = gas.fuzzy_sssp(gas.directed(edges, way), many("in"), many("target"), 0)
    else:
        raise ValueError(f"unknown vertex program {name}")
    values = {p["out"].name: Val(F.col("id"), "iri")} if isinstance(p.get("out"), Var) else {}
    values |= {p[n].name: v for n, v in columns.items() if isinstance(p.get(n), Var)}
    return Solutions.of(rows, values, {p["out2"].name} if isinstance(p.get("out2"), Var) else set())


def _slice_service(compiler, group: Group, scope, found) -> Solutions:
    """A range of a pattern's solutions in the order of its variables: ``offset`` and ``limit``."""
    names = ("offset", "limit")
    local = lambda t: t.p.lex.rsplit("#", 1)[-1] if isinstance(t, Triple) and isinstance(t.p, Term) else ""
    p = _parameters(Group([t for t in group.parts if local(t) in names]))
    rows = compiler.group(Group([t for t in group.parts if local(t) not in names]), scope)
    ordered = rows.df.orderBy(*(k.asc_nulls_first() for n in sorted(rows.variables) for k in rows.val(n).order_keys()))
    ordered = ordered.offset(int(_text(p.get("offset"), "0")))
    return Solutions(ordered.limit(int(_text(p["limit"]))) if "limit" in p else ordered, rows.variables, rows.maybe)


def _null_service(compiler, group: Group, scope, found) -> Solutions:
    """One solution that binds nothing."""
    return constants(compiler.spark, [], [[]])


def stored_query(name: str, text: str) -> None:
    """Makes a query callable as SERVICE; the group's VALUES or other patterns join its solutions."""

    def build(compiler, group: Group, scope, found) -> Solutions:
        from ..operators.joins import inner

        own = compiler.select(parse_query(text), scope)
        return inner(own, compiler.group(group, scope)) if group.parts else own

    register_service(name, build)


def native_service(name: str, build: Callable[[Group], DataFrame]) -> None:
    """Makes a function that gives a DataFrame callable as SERVICE; its columns are variables."""
    from ..terms import STRING

    def wrapped(compiler, group: Group, scope, found) -> Solutions:
        df = build(group)
        kinds = {"bigint": "integer", "int": "integer", "double": "double", "boolean": "boolean", "timestamp": "dateTime"}
        xsd = STRING.removesuffix("string")
        return Solutions.of(df, {c: Val(F.col(c), "literal", xsd + kinds.get(t, "string")) if t in kinds or t == "string" else Val(F.col(c)) for c, t in df.dtypes}, set(df.columns))

    register_service(name, wrapped)


for _name, _build in (("/search", _search_service), ("#search", _search_service), ("/geospatial", _geo_service), ("#geospatial", _geo_service), ("#sample", _sample_service), ("#values", _values_service), ("#slice", _slice_service), ("#null", _null_service), ("#alp", _path_service), ("#gas", _walk_service), ("/gas", _walk_service), ("#service", _walk_service)):
    register_service(_name, _build)

__all__ = ["SERVICES", "distance", "find_service", "in_circle", "in_rectangle", "native_service", "search", "stored_query", "text_index", "tokens", "z_order"]
