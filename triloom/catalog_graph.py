"""Graph analytics, paths, search, geospatial, inference, updates and formats over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import add, engine
from .engine import Engine
from .operators import gas, inference, services
from .operators.paths import closure
from .operators.property_graph import PropertyGraph
from .plans.algebra import Triple, Var
from .sources import rdf
from .sources.driver_tables import ID, NS, table_graph
from .sources.graphs import EXPLICIT, QuadGraph
from .store import written
from .store_quads import QuadStore
from .terms import RDFS, TERM_DDL, iri


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def quads(spark: SparkSession, d: str, *tables: str) -> DataFrame:
    """Some tables' graph as quads, one named graph for each table."""
    out = None
    for name in tables:
        found = table_graph(spark, d, [name]).star([Triple(Var("s"), Var("p"), Var("o"))])
        graph = F.struct(F.lit(3).cast("tinyint").alias("kind"), F.lit(f"{ID}{name}").alias("lex"), F.lit(None).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang"))
        rows = found.df.select(*(found.val(n).term().alias(n) for n in "spo"), graph.cast(TERM_DDL).alias("g"), F.lit(EXPLICIT).cast("tinyint").alias("st"))
        out = rows if out is None else out.union(rows)
    return out


def _over_quads(spark: SparkSession, d: str, text: str, *tables: str) -> DataFrame:
    return Engine(spark, QuadGraph(quads(spark, d, *tables)), prefixes={"": NS, "id": ID}).query(text)


def event_edges(spark: SparkSession, d: str) -> DataFrame:
    """Distinct steps from one type of event to the user's next."""
    from pyspark.sql import Window

    e = _table(spark, d, "events").select("user_id", "event_type", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("then"))
    return e.where("then is not null").select(F.col("event_type").alias("src"), F.col("then").alias("dst")).distinct()


def trade_edges(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and the parts that they ship, as edges between numbers (parts are even, suppliers odd)."""
    return gas.distinct_edges(_table(spark, d, "lineitem").select((F.col("l_suppkey") * 2 + 1).alias("src"), (F.col("l_partkey") * 2).alias("dst")))


_TRADE = "e AS (SELECT DISTINCT l_suppkey * 2 + 1 AS src, l_partkey * 2 AS dst FROM lineitem)"

add("quads_scan", lambda s, d: _over_quads(s, d, 'SELECT ?n WHERE { ?x :n_name ?n ; :n_region ?r . ?r :r_name "ASIA" }', "nation", "region"), "SELECT n_name AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
add("quads_named_graph", lambda s, d: _over_quads(s, d, "SELECT ?g (COUNT(*) AS ?n) WHERE { GRAPH ?g { ?s ?p ?o } } GROUP BY ?g", "nation", "region"), "SELECT 'urn:triloom:nation' AS g, 5 * count(*) AS n FROM nation UNION ALL SELECT 'urn:triloom:region', 3 * count(*) FROM region")
add("quads_from_merge", lambda s, d: _over_quads(s, d, "SELECT (COUNT(*) AS ?n) FROM id:nation FROM id:region WHERE { ?s ?p ?o }", "nation", "region", "nation"), "SELECT (SELECT 5 * count(*) FROM nation) + (SELECT 3 * count(*) FROM region) AS n")
add("quads_minus", lambda s, d: _over_quads(s, d, "SELECT ?c WHERE { ?c :c_mktsegment ?s MINUS { ?c :c_mktsegment 'BUILDING' } }", "customer"), "SELECT 'urn:triloom:customer/' || c_custkey AS c FROM customer WHERE c_mktsegment <> 'BUILDING'")
add("quads_typed_aggregate", lambda s, d: _over_quads(s, d, "SELECT ?s (COUNT(?b) AS ?n) (MAX(?k) AS ?most) WHERE { ?c :c_mktsegment ?s ; :c_acctbal ?b ; :c_custkey ?k FILTER(?b > 0) } GROUP BY ?s", "customer"), "SELECT c_mktsegment AS s, count(*) AS n, max(c_custkey)::VARCHAR AS most FROM customer WHERE c_acctbal > 0 GROUP BY 1")
add("quads_order", lambda s, d: _over_quads(s, d, "SELECT ?o WHERE { ?x :n_nationkey|:n_name ?o } ORDER BY ?o LIMIT 10", "nation"), "SELECT n_name AS o FROM nation ORDER BY n_name LIMIT 10")

add("path_event_closure", lambda s, d: closure(written(event_edges(s, d).select(F.col("src").alias("s"), F.col("dst").alias("o"))), 1, None), "WITH RECURSIVE n AS (SELECT user_id, event_type AS s, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS o FROM events), e AS (SELECT DISTINCT s, o FROM n WHERE o IS NOT NULL), r AS (SELECT s, o FROM e UNION SELECT r.s, e.o FROM r JOIN e ON r.o = e.s) SELECT s, o FROM r")
add("gas_bfs", lambda s, d: gas.bfs(trade_edges(s, d), 3, gas.ALL).select("id", "depth"), f"WITH RECURSIVE {_TRADE}, b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), r AS (SELECT 3::BIGINT AS id, 0 AS depth UNION SELECT b.dst, r.depth + 1 FROM r JOIN b ON b.src = r.id WHERE r.depth < 8) SELECT v.id, coalesce(min(r.depth), -1) AS depth FROM v LEFT JOIN r USING (id) GROUP BY 1")

def _spread_components(rounds: int) -> str:
    """SQL that gives each vertex the smallest number within so many steps; these graphs are four steps wide."""
    steps = [f"c{k + 1} AS (SELECT c.id, least(any_value(c.component), min(coalesce(o.component, c.component))) AS component FROM c{k} c LEFT JOIN b ON b.src = c.id LEFT JOIN c{k} o ON o.id = b.dst GROUP BY 1)" for k in range(rounds)]
    return f"WITH {_TRADE}, b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), c0 AS (SELECT DISTINCT src AS id, src AS component FROM b), {', '.join(steps)} SELECT id, component FROM c{rounds}"


def _ranked(rounds: int) -> str:
    steps = [f"r{k + 1} AS (SELECT v.id, CASE WHEN count(e.src) = 0 THEN any_value(v.rank) ELSE 0.15::DOUBLE + 0.85::DOUBLE * sum(f.rank / o.n) END AS rank FROM r{k} v LEFT JOIN e ON e.dst = v.id LEFT JOIN o ON o.src = e.src LEFT JOIN r{k} f ON f.id = e.src GROUP BY 1)" for k in range(rounds)]
    return f"WITH {_TRADE}, o AS (SELECT src, count(*) AS n FROM e GROUP BY 1), r0 AS (SELECT id, 0.15::DOUBLE AS rank FROM (SELECT src AS id FROM e UNION SELECT dst FROM e)), {', '.join(steps)} SELECT id, round(rank, 9) AS rank FROM r{rounds}"


add("gas_connected_components", lambda s, d: gas.connected_components(trade_edges(s, d)), _spread_components(8))
add("gas_pagerank", lambda s, d: gas.pagerank(trade_edges(s, d)).select("id", F.round("rank", 9).alias("rank")), _ranked(20))
add("gas_shortest_paths", lambda s, d: gas.sssp(_table(s, d, "nation").select(F.lit(-1).alias("src"), F.col("n_regionkey").alias("dst"), F.lit(1.0).alias("weight")).distinct().union(_table(s, d, "nation").select("n_regionkey", F.col("n_nationkey") + 100, F.col("n_nationkey").cast("double"))), -1), "SELECT -1 AS id, 0.0::DOUBLE AS distance UNION ALL SELECT DISTINCT n_regionkey, 1.0 FROM nation UNION ALL SELECT n_nationkey + 100, 1.0 + n_nationkey FROM nation")
add("gas_fuzzy_paths", lambda s, d: gas.fuzzy_sssp(event_edges(s, d), ["click"], ["purchase"], 0), "WITH n AS (SELECT event_type AS s, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS o FROM events), e AS (SELECT DISTINCT s, o FROM n WHERE o IS NOT NULL) SELECT unnest(['click', 'purchase']) AS id FROM e WHERE s = 'click' AND o = 'purchase' UNION SELECT unnest(['click', 'purchase', b.s]) FROM e a JOIN e b ON a.o = b.s AND a.s = 'click' AND b.o = 'purchase' WHERE NOT EXISTS (SELECT 1 FROM e WHERE s = 'click' AND o = 'purchase')")


_STOP = ", ".join(f"'{w}'" for w in services.STOP_WORDS)
add("search_ranked", lambda s, d: services.search(services.text_index(_table(s, d, "benchmark"), "item_id", "text"), "andthe of thin erst").select(F.col("id").alias("item_id"), F.round("relevance", 9).alias("relevance")), f"""
WITH t AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS token FROM benchmark
), c AS (SELECT item_id, token, count(*) AS n FROM t WHERE token NOT IN ({_STOP}) GROUP BY 1, 2
), w AS (SELECT item_id, token, n / sqrt(sum(n * n) OVER (PARTITION BY item_id)) AS weight FROM c)
SELECT item_id, round(sum(weight / sqrt(3)), 9) AS relevance FROM w WHERE token IN ('andthe', 'thin', 'erst') GROUP BY 1""")
add("search_prefix", lambda s, d: services.search(services.text_index(_table(s, d, "nation"), "n_nationkey", "n_name"), "nat* 12").select("id"), "SELECT n_nationkey AS id FROM nation")


def _places(spark: SparkSession, d: str) -> DataFrame:
    """Customers put on the map by their keys."""
    k = F.col("c_custkey")
    return _table(spark, d, "customer").select("c_custkey", (k % 120 - 60).cast("double").alias("lat"), (k * 7 % 300 - 150).cast("double").alias("lon"))


_PLACES = "p AS (SELECT c_custkey, (c_custkey % 120 - 60)::DOUBLE AS lat, (c_custkey * 7 % 300 - 150)::DOUBLE AS lon FROM customer)"
add("geo_rectangle", lambda s, d: _places(s, d).where(services.in_rectangle(F.col("lat"), F.col("lon"), 10, -20, 50, 40)).select("c_custkey"), f"WITH {_PLACES} SELECT c_custkey FROM p WHERE lat BETWEEN 10 AND 50 AND lon BETWEEN -20 AND 40")
add("geo_circle", lambda s, d: _places(s, d).where(services.in_circle(F.col("lat"), F.col("lon"), 10.0, 20.0, 2500.0)).select("c_custkey"), f"WITH {_PLACES} SELECT c_custkey FROM p WHERE degrees(acos(least(1, greatest(-1, sin(radians(lat)) * sin(radians(10)) + cos(radians(lat)) * cos(radians(10)) * cos(radians(lon - 20)))))) * 60 * 1.1515 * 1609.344 / 1000 <= 2500")
add("geo_distance", lambda s, d: _places(s, d).select("c_custkey", F.round(services.distance(F.col("lat"), F.col("lon"), F.lit(10.0), F.lit(20.0), "Miles"), 4).alias("miles")), f"WITH {_PLACES} SELECT c_custkey, CASE WHEN lat = 10 AND lon = 20 THEN 0.0 ELSE round(degrees(acos(least(1, greatest(-1, sin(radians(lat)) * sin(radians(10)) + cos(radians(lat)) * cos(radians(10)) * cos(radians(lon - 20)))))) * 60 * 1.1515, 4) END AS miles FROM p")
add("geo_z_order", lambda s, d: _places(s, d).select("c_custkey", services.z_order(F.col("lat") + 60, F.col("lon") + 150).alias("z")), f"WITH {_PLACES}, q AS (SELECT c_custkey, (lat + 60)::BIGINT AS a, (lon + 150)::BIGINT AS b FROM p) SELECT c_custkey, {' | '.join(f'(((a >> {k}) & 1) << {2 * k}) | (((b >> {k}) & 1) << {2 * k + 1})' for k in range(16))} AS z FROM q")


def _typed(spark: SparkSession, d: str) -> DataFrame:
    """Nations and regions with a small schema: subclasses, and a domain and range for the link."""
    from .store_quads import quad_rows

    schema = [(iri(NS + "Nation"), iri(RDFS + "subClassOf"), iri(NS + "Place")), (iri(NS + "Region"), iri(RDFS + "subClassOf"), iri(NS + "Place")), (iri(NS + "Place"), iri(RDFS + "subClassOf"), iri(NS + "Thing")), (iri(NS + "n_region"), iri(RDFS + "range"), iri(NS + "Area")), (iri(NS + "n_region"), iri(RDFS + "subPropertyOf"), iri(NS + "within"))]
    return quads(spark, d, "nation", "region").union(quad_rows(spark, schema)).select("s", "p", "o")


def _entailed(spark: SparkSession, d: str, close) -> DataFrame:
    t = close(_typed(spark, d)).where((F.col("p.lex") == NS + "within") | F.col("o.lex").isin(NS + "Thing", NS + "Area") & inference.is_("p", inference.TYPE))
    return t.select(F.col("s.lex").alias("s"), F.col("p.lex").alias("p"), F.col("o.lex").alias("o"))


_ENTAILED = f"SELECT '{ID}nation/' || n_nationkey AS s, '{NS}within' AS p, '{ID}region/' || n_regionkey AS o FROM nation UNION SELECT '{ID}region/' || n_regionkey, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '{NS}Area' FROM nation UNION SELECT '{ID}nation/' || n_nationkey, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '{NS}Thing' FROM nation UNION SELECT '{ID}region/' || r_regionkey, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', '{NS}Thing' FROM region"
add("inference_fast", lambda s, d: _entailed(s, d, inference.fast_closure), _ENTAILED)
add("inference_full", lambda s, d: _entailed(s, d, lambda t: inference.full_closure(t, owl=False)), _ENTAILED)


def _updated(spark: SparkSession, d: str) -> DataFrame:
    store = QuadStore(spark, quads(spark, d, "nation"), prefixes={"": NS, "id": ID})
    store.update("DELETE { GRAPH id:nation { ?x :n_name ?n } } INSERT { GRAPH id:new { ?x :label ?n } } WHERE { ?x :n_name ?n ; :n_nationkey ?k FILTER(?k < 10) }")
    return store.quads.groupBy(F.col("g.lex").alias("g"), F.col("p.lex").alias("p")).agg(F.count(F.lit(1)).alias("n"))


add("update_modify", _updated, f"SELECT '{ID}nation' AS g, p, n FROM (SELECT '{NS}n_nationkey' AS p, count(*) AS n FROM nation UNION ALL SELECT '{NS}n_regionkey', count(*) FROM nation UNION ALL SELECT '{NS}n_region', count(*) FROM nation UNION ALL SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', count(*) FROM nation UNION ALL SELECT '{NS}n_name', count(*) FROM nation WHERE n_nationkey >= 10) UNION ALL SELECT '{ID}new', '{NS}label', count(*) FROM nation WHERE n_nationkey < 10")


def _logged(spark: SparkSession, d: str) -> DataFrame:
    store = QuadStore(spark, quads(spark, d, "region"), history=True, prefixes={"": NS, "id": ID})
    store.update("INSERT DATA { id:x :p 1 . id:x :p 2 }; DELETE DATA { id:x :p 2 }; DROP GRAPH id:region")
    return store.changes.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


add("update_change_log", _logged, "SELECT 'added' AS action, 2 AS n UNION ALL SELECT 'removed', 1 + 3 * count(*) FROM region")
add("format_ntriples", lambda s, d: rdf.statement_lines(quads(s, d, "region").drop("g")), f"SELECT '<{ID}region/' || r_regionkey || '> <{NS}r_name> \"' || r_name || '\" .' AS value FROM region UNION ALL SELECT '<{ID}region/' || r_regionkey || '> <{NS}r_regionkey> \"' || r_regionkey || '\"^^<http://www.w3.org/2001/XMLSchema#integer> .' FROM region UNION ALL SELECT '<{ID}region/' || r_regionkey || '> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <{NS}Region> .' FROM region")
add("format_result_csv", lambda s, d: rdf.result_table(engine(s, d).query("SELECT ?n ?k WHERE { ?x :n_name ?n ; :n_nationkey ?k }", "terms")), "SELECT n_name || ',' || n_nationkey AS value FROM nation")
add("format_result_json", lambda s, d: rdf.result_json(engine(s, d).query("SELECT ?n WHERE { ?x :n_name ?n }", "terms")), """SELECT '{"n":{"type":"literal","value":"' || n_name || '"}}' AS value FROM nation""")


def _property_graph(spark: SparkSession, d: str) -> DataFrame:
    n = _table(spark, d, "nation")
    vertices = n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.create_map(F.lit("name"), F.col("n_name")).alias("properties")).union(_table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey"), F.create_map(F.lit("name"), F.col("r_name"))))
    edges = n.select(F.concat(F.lit("e"), "n_nationkey").alias("id"), F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"), F.lit("in").alias("label"), F.expr("cast(map() as map<string,string>)").alias("properties"))
    again = PropertyGraph.from_quads(PropertyGraph(vertices, edges).quads())
    return again.neighbours("r2", "in").select("id", F.col("properties")["name"].alias("name"))


add("property_graph_neighbours", _property_graph, "SELECT 'n' || n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey = 2")
add("service_sample", lambda s, d: engine(s, d).query("SELECT ?x WHERE { SERVICE <urn:x#sample> { ?x :n_name ?n . hint:Sample <urn:x#limit> 5 ; <urn:x#seed> 7 } }"))
add("fn_random", lambda s, d: engine(s, d).query("SELECT ?x (UUID() AS ?u) (STRUUID() AS ?v) (RAND() AS ?r) (NOW() AS ?t) (BNODE() AS ?b) WHERE { ?x a :Region }"))

_NATION = lambda s, d, text: Engine(s, table_graph(s, d, ["nation"]), prefixes={"": NS, "id": ID}).query(text)
add("service_search", lambda s, d: _NATION(s, d, "SELECT ?x ?k WHERE { SERVICE <urn:x/search> { ?t <urn:x/search#search> '12' ; <urn:x/search#rank> ?k } ?x :n_name ?t }"), f"SELECT '{ID}nation/' || n_nationkey AS x, 2 AS k FROM nation WHERE n_name = 'NATION_12'")
add("service_walk", lambda s, d: _NATION(s, d, "SELECT ?x ?d WHERE { SERVICE <urn:x/gas> { <urn:p> <urn:x/gas#gasClass> 'BFS' ; <urn:x/gas#in> <urn:triloom:nation/3> ; <urn:x/gas#linkType> :n_region ; <urn:x/gas#out> ?x ; <urn:x/gas#out1> ?d } }"), f"SELECT '{ID}nation/3' AS x, 0 AS d UNION ALL SELECT '{ID}region/' || n_regionkey, 1 FROM nation WHERE n_nationkey = 3")
add("service_path", lambda s, d: _NATION(s, d, "SELECT ?x ?y WHERE { SERVICE <urn:x#alp> { ?x :n_region ?y . hint:SubQuery <urn:x#minLength> 1 ; <urn:x#maxLength> 3 } }"), f"SELECT '{ID}nation/' || n_nationkey AS x, '{ID}region/' || n_regionkey AS y FROM nation")
add("service_slice", lambda s, d: _NATION(s, d, "SELECT ?k WHERE { SERVICE <urn:x#slice> { ?x :n_nationkey ?k . hint:SubQuery <urn:x#offset> 5 ; <urn:x#limit> 10 } }"), "SELECT n_nationkey AS k FROM nation ORDER BY 1 LIMIT 10 OFFSET 5")
add("form_construct_graph", lambda s, d: rdf.statement_lines(_NATION(s, d, "CONSTRUCT { ?x :key ?k } WHERE { ?x :n_nationkey ?k FILTER(?k < 3) }")), f"SELECT '<{ID}nation/' || n_nationkey || '> <{NS}key> \"' || n_nationkey || '\"^^<http://www.w3.org/2001/XMLSchema#integer> .' AS value FROM nation WHERE n_nationkey < 3")
