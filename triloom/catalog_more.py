"""Statement operators, formats, updates, inference, services and functions, each with a query of its own."""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import add, ask
from .catalog_graph import _ENTAILED, _entailed, _over_quads, _places, _table, _typed, event_edges, quads
from .engine import Engine
from .functions.expressions import register, register_aggregate, string
from .operators import gas, inference, services
from .operators import statements as st
from .operators.property_graph import PropertyGraph
from .server import Server, match_keyword, solution_statistics
from .sources import rdf
from .sources.driver_tables import ID, NS, table_graph
from .sources.graphs import QuadGraph
from .store import shared_dir
from .store_quads import QuadStore, quad_rows
from .terms import OWL, RDF, RDFS, TERM_DDL, Val, iri, literal

XSD = "http://www.w3.org/2001/XMLSchema#"


def _lex() -> list[Column]:
    """The three terms by their lexical forms."""
    return [F.col(f"{x}.lex").alias(x) for x in "spo"]


def _scratch(spark: SparkSession, ending: str) -> str:
    """A place for a file of our own in the shared folder."""
    return f"{shared_dir(spark)}/triloom-{uuid.uuid4().hex}.{ending}"


def _count(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*(F.col(f"{c}.lex").alias(c) for c in by)).agg(F.count(F.lit(1)).alias("n"))


def _store(spark: SparkSession, d: str, *tables: str) -> QuadStore:
    return QuadStore(spark, quads(spark, d, *tables), prefixes={"": NS, "id": ID})


# --- joins whose shared variable may be unbound

_LEFT = "{ { ?x :n_name ?c ; :n_nationkey ?k FILTER(?k < 3) } UNION { ?x :n_name ?c ; :n_nationkey 7 } }"
_LEFT_SQL = "l AS (SELECT n_name AS c, n_nationkey AS k FROM nation WHERE n_nationkey < 3 UNION ALL SELECT n_name, NULL FROM nation WHERE n_nationkey = 7)"
_SIDE = "{ ?r :r_regionkey ?k ; :r_name ?g FILTER(?k > 0) }"
ask("join_optional_unbound", f"SELECT ?c ?g WHERE {{ {_LEFT} OPTIONAL {_SIDE} }}", f"WITH {_LEFT_SQL} SELECT c, r_name AS g FROM l LEFT JOIN (SELECT * FROM region WHERE r_regionkey > 0) r ON k IS NULL OR k = r_regionkey")
ask("join_optional_unbound_filter", f"SELECT ?c ?g WHERE {{ {_LEFT} OPTIONAL {{ ?r :r_regionkey ?k ; :r_name ?g FILTER(?c != 'NATION_1') }} }}", f"WITH {_LEFT_SQL} SELECT c, r_name AS g FROM l LEFT JOIN region r ON (k IS NULL OR k = r_regionkey) AND c <> 'NATION_1'")
ask("join_minus_unbound", f"SELECT ?c WHERE {{ {_LEFT} MINUS {_SIDE} }}", f"WITH {_LEFT_SQL} SELECT c FROM l WHERE k IS NULL OR k NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 0)")
ask("join_exists_unbound", f"SELECT ?c WHERE {{ {_LEFT} FILTER EXISTS {_SIDE} }}", f"WITH {_LEFT_SQL} SELECT c FROM l WHERE k IS NULL OR k IN (SELECT r_regionkey FROM region WHERE r_regionkey > 0)")
ask("join_not_exists_unbound", f"SELECT ?c WHERE {{ {_LEFT} FILTER NOT EXISTS {_SIDE} }}", f"WITH {_LEFT_SQL} SELECT c FROM l WHERE k IS NOT NULL AND k NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 0)")
ask("join_exists_value_unbound", f"SELECT ?c (EXISTS {_SIDE} AS ?e) WHERE {_LEFT}", f"WITH {_LEFT_SQL} SELECT c, k IS NULL OR k IN (SELECT r_regionkey FROM region WHERE r_regionkey > 0) AS e FROM l")

# --- statements

add("statements_fused_view", lambda s, d: _count(st.fused_view(quads(s, d, "nation"), quads(s, d, "nation", "region")), "p"), f"SELECT p, count(*) AS n FROM (SELECT unnest(['{NS}n_nationkey', '{NS}n_name', '{NS}n_regionkey', '{NS}n_region', '{RDF}type']) AS p FROM nation UNION ALL SELECT unnest(['{NS}r_regionkey', '{NS}r_name', '{RDF}type']) FROM region) GROUP BY 1")
add("statements_without_graph", lambda s, d: st.strip_graph(quads(s, d, "region", "region")).distinct().select(*_lex()).where(F.col("p") == NS + "r_name"), f"SELECT '{ID}region/' || r_regionkey AS s, '{NS}r_name' AS p, r_name AS o FROM region")
add("statements_distinct", lambda s, d: _count(st.distinct_statements(quads(s, d, "region").union(quads(s, d, "region").withColumn("g", F.lit(None)))), "p"), f"SELECT p, count(*) AS n FROM (SELECT unnest(['{NS}r_regionkey', '{NS}r_name', '{RDF}type']) AS p FROM region) GROUP BY 1")


def _provenance(spark: SparkSession, d: str) -> DataFrame:
    closed = inference.closed_quads(_typed(spark, d).select("s", "p", "o", F.lit(None).cast(TERM_DDL).alias("g"), F.lit(0).cast("tinyint").alias("st")), inference.fast_closure)
    mine = closed.where(F.col("p.lex").isin(NS + "n_region", NS + "within"))
    parts = {"told": st.explicit_only(mine), "inferred": st.inferred_only(mine), "no axioms": st.without_axioms(mine), "no history": st.without_history(mine)}
    return reduce(DataFrame.union, (x.select(F.lit(k).alias("part")).groupBy("part").count().withColumnRenamed("count", "n") for k, x in parts.items()))


add("statements_provenance", _provenance, "SELECT part, f * count(*) AS n FROM nation, (VALUES ('told', 1), ('inferred', 1), ('no axioms', 2), ('no history', 2)) v(part, f) GROUP BY part, f")
add("statements_present", lambda s, d: _count(st.present(quads(s, d, "nation", "region"), quads(s, d, "region")), "p"), f"SELECT p, count(*) AS n FROM (SELECT unnest(['{NS}r_regionkey', '{NS}r_name', '{RDF}type']) AS p FROM region) GROUP BY 1")
add("statements_absent", lambda s, d: _count(st.present(quads(s, d, "nation", "region"), quads(s, d, "nation"), False), "p"), f"SELECT p, count(*) AS n FROM (SELECT unnest(['{NS}r_regionkey', '{NS}r_name', '{RDF}type']) AS p FROM region) GROUP BY 1")
add("statements_complete", lambda s, d: st.complete(quads(s, d, "nation", "region"), quads(s, d, "region")).groupBy(F.col("st").isNotNull().alias("known")).agg(F.count(F.lit(1)).alias("n")), "SELECT true AS known, 3 * count(*) AS n FROM region UNION ALL SELECT false, 5 * count(*) FROM nation")
add("statements_star", lambda s, d: st.star(quads(s, d, "nation", "region"), [NS + "n_name", NS + "n_nationkey"]).select(F.col("s.lex").alias("s"), F.col("o0")[0]["lex"].alias("name"), F.col("o1")[0]["lex"].cast("long").alias("k")), f"SELECT '{ID}nation/' || n_nationkey AS s, n_name AS name, n_nationkey AS k FROM nation")
add("statements_sample_even", lambda s, d: st.sample(quads(s, d, "nation").where(F.col("p.lex") == NS + "n_name"), 7, even=True).select(*_lex()), f"SELECT s, p, o FROM (SELECT '{ID}nation/' || n_nationkey AS s, '{NS}n_name' AS p, n_name AS o, row_number() OVER (ORDER BY '{ID}nation/' || n_nationkey) AS i, count(*) OVER () AS w FROM nation) WHERE floor(i * 7 / w) <> floor((i - 1) * 7 / w)")
add("statements_without_trivial", lambda s, d: _count(st.without_trivial(quads(s, d, "region").select("s", "p", "o").union(quad_rows(s, [(iri("urn:a"), iri(OWL + "sameAs"), iri("urn:a")), (iri("urn:a"), iri(OWL + "sameAs"), iri("urn:b")), (iri("urn:a"), iri(RDF + "type"), iri(RDFS + "Resource"))]).select("s", "p", "o"))), "p"), f"SELECT p, count(*) AS n FROM (SELECT unnest(['{NS}r_regionkey', '{NS}r_name', '{RDF}type']) AS p FROM region UNION ALL SELECT '{OWL}sameAs') GROUP BY 1")


def _proofs(spark: SparkSession, d: str) -> DataFrame:
    told = _typed(spark, d)
    found = st.supported(inference.fast_closure(told), told, [("rdfs7", inference.rdfs7), ("rdfs9", inference.rdfs9), ("rdfs3", inference.rdfs3)])
    return found.where((F.col("p.lex") == NS + "within") | (F.col("o.lex") == NS + "Thing") & (F.col("p.lex") == RDF + "type")).select(*_lex(), F.array_join("rules", ",").alias("rules"))


add("statements_proofs", _proofs, f"SELECT '{ID}nation/' || n_nationkey AS s, '{NS}within' AS p, '{ID}region/' || n_regionkey AS o, 'rdfs7' AS rules FROM nation UNION ALL SELECT '{ID}nation/' || n_nationkey, '{RDF}type', '{NS}Thing', 'rdfs9' FROM nation UNION ALL SELECT '{ID}region/' || r_regionkey, '{RDF}type', '{NS}Thing', 'rdfs9' FROM region")

# --- formats: written, read again, and written as lines

_NAMES = f"SELECT '<{ID}region/' || r_regionkey || '> <{NS}r_name> \"' || r_name || '\" .' AS value FROM region UNION ALL SELECT '<{ID}region/' || r_regionkey || '> <{NS}r_regionkey> \"' || r_regionkey || '\"^^<{XSD}integer> .' FROM region UNION ALL SELECT '<{ID}region/' || r_regionkey || '> <{RDF}type> <{NS}Region> .' FROM region"


def _again(kind: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        path = _scratch(spark, kind)
        rows = quads(spark, d, "region").withColumn("g", F.lit(None).cast(TERM_DDL))
        if kind in ("rdf", "trix", "rj"):
            # One document with a frame around its lines.
            text = rdf.wrapped(kind, [r.value for r in rdf.WRITERS[kind](rows).collect()])
            spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
        else:
            rdf.write_rdf(rows.coalesce(1), path, kind)
        return rdf.statement_lines(rdf.read_rdf(spark, path, kind).drop("g"))

    return run


for _kind in ("nt", "nq", "ttl", "trig", "rdf", "trix", "rj"):
    add(f"format_{_kind}_again", _again(_kind), _NAMES)


def _results_again(spark: SparkSession, d: str, kind: str) -> DataFrame:
    df = Engine(spark, table_graph(spark, d, ["region"]), prefixes={"": NS}).query("SELECT ?n ?k WHERE { ?x :r_name ?n ; :r_regionkey ?k }", "terms")
    if kind == "json":
        text = '{"head":{"vars":["n","k"]},"results":{"bindings":[' + ",".join(r.value for r in rdf.result_json(df).collect()) + "]}}"
        back = rdf.read_result_json(spark, text)
    else:
        text = '<sparql><head><variable name="n"/><variable name="k"/></head><results>' + "".join(r.value for r in rdf.result_xml(df).collect()) + "</results></sparql>"
        back = rdf.read_result_xml(spark, text)
    return back.select(F.col("n.lex").alias("n"), F.col("k.lex").cast("long").alias("k"))


for _kind in ("json", "xml"):
    add(f"format_result_{_kind}_again", lambda s, d, kind=_kind: _results_again(s, d, kind), "SELECT r_name AS n, r_regionkey AS k FROM region")
add("format_result_tsv", lambda s, d: rdf.result_table(Engine(s, table_graph(s, d, ["region"]), prefixes={"": NS}).query("SELECT ?n ?k WHERE { ?x :r_name ?n ; :r_regionkey ?k }", "terms"), "\t"), f"""SELECT '"' || r_name || '"' || chr(9) || '"' || r_regionkey || '"^^<{XSD}integer>' AS value FROM region""")
add("format_boolean", lambda s, d: s.createDataFrame([(k, rdf.boolean_result(_over_quads(s, d, "ASK { ?x :r_name 'ASIA' }", "region"), k)) for k in ("json", "text")], "kind string, value string"), """SELECT 'json' AS kind, '{"head":{},"boolean":' || (count(*) > 0)::VARCHAR || '}' AS value FROM region WHERE r_name = 'ASIA' UNION ALL SELECT 'text', (count(*) > 0)::VARCHAR FROM region WHERE r_name = 'ASIA'""")


def _graphml(spark: SparkSession, d: str) -> DataFrame:
    n = _table(spark, d, "nation")
    nodes = n.select(F.format_string('<node id="%s"><data key="n">%s</data></node>', F.concat(F.lit("n"), "n_nationkey"), "n_name").alias("x")).union(_table(spark, d, "region").select(F.format_string('<node id="r%s"/>', F.col("r_regionkey").cast("string"))))
    edges = n.select(F.format_string('<edge id="e%s" source="n%s" target="r%s" label="in"/>', *(F.col(c).cast("string") for c in ("n_nationkey", "n_nationkey", "n_regionkey"))))
    path = _scratch(spark, "graphml")
    text = nodes.union(edges).agg(F.concat(F.lit('<graphml><key id="n" attr.name="name"/><graph>'), F.array_join(F.array_sort(F.collect_list("x")), ""), F.lit("</graph></graphml>")).alias("value"))
    text.coalesce(1).write.text(path)
    g = PropertyGraph.from_quads(rdf.read_rdf(spark, path, "graphml"))
    return g.neighbours("urn:x-graph:r1", "in", ["in"]).select(F.col("properties")["name"].alias("name"))


add("format_graphml", _graphml, "SELECT n_name AS name FROM nation WHERE n_regionkey = 1")

# --- updates


def _loaded(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark, "nt")
    rdf.write_rdf(quads(spark, d, "region").drop("g"), path, "nt")
    store = _store(spark, d, "nation")
    store.update(f"LOAD <{path}> INTO GRAPH id:loaded")
    return _count(store.quads, "g")


add("update_load", _loaded, f"SELECT '{ID}nation' AS g, 5 * count(*) AS n FROM nation UNION ALL SELECT '{ID}loaded', 3 * count(*) FROM region")


def _dumped(spark: SparkSession, d: str) -> DataFrame:
    store, path = QuadStore(spark), _scratch(spark, "parquet")
    store.load(quads(spark, d, "nation", "region"))
    store.save(path)
    return _count(spark.read.parquet(path), "g")


add("update_bulk_load_and_dump", _dumped, f"SELECT '{ID}nation' AS g, 5 * count(*) AS n FROM nation UNION ALL SELECT '{ID}region', 3 * count(*) FROM region")


def _updated(text: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        store = _store(spark, d, "nation", "region")
        store.update(text)
        return _count(store.quads, "g")

    return run


_N, _R = "SELECT 5 * count(*) FROM nation", "SELECT 3 * count(*) FROM region"
add("update_add", _updated("ADD GRAPH id:nation TO GRAPH id:region"), f"SELECT '{ID}nation' AS g, ({_N}) AS n UNION ALL SELECT '{ID}region', ({_N}) + ({_R})")
add("update_copy", _updated("COPY GRAPH id:nation TO GRAPH id:region"), f"SELECT '{ID}nation' AS g, ({_N}) AS n UNION ALL SELECT '{ID}region', ({_N})")
add("update_move", _updated("MOVE GRAPH id:nation TO GRAPH id:other"), f"SELECT '{ID}other' AS g, ({_N}) AS n UNION ALL SELECT '{ID}region', ({_R})")
add("update_clear", _updated("CLEAR GRAPH id:nation; CREATE GRAPH id:empty; DROP SILENT GRAPH id:none"), f"SELECT '{ID}region' AS g, ({_R}) AS n")


def _sets(spark: SparkSession, d: str) -> DataFrame:
    store = _store(spark, d, "nation")
    store.update("INSERT INTO %low SELECT ?n ?k WHERE { ?x :n_name ?n ; :n_nationkey ?k FILTER(?k < 9) }; DELETE FROM %low SELECT ?n ?k WHERE { ?x :n_name ?n ; :n_nationkey ?k FILTER(?k > 5) }")
    return store.engine().query("SELECT ?n ?r WHERE { INCLUDE %low ?x :n_name ?n ; :n_regionkey ?r }").withColumn("r", F.col("r").cast("long"))


add("update_solution_sets", _sets, "SELECT n_name AS n, n_regionkey AS r FROM nation WHERE n_nationkey < 6")


def _entailments(spark: SparkSession, d: str) -> DataFrame:
    store = QuadStore(spark, quads(spark, d, "nation").union(quad_rows(spark, [(iri(NS + "n_region"), iri(RDFS + "range"), iri(NS + "Area"), None)])), entailments=inference.fast_closure, prefixes={"": NS, "id": ID})
    out = []
    for text in ("DISABLE ENTAILMENTS", "CREATE ENTAILMENTS", "DROP ENTAILMENTS"):
        store.update(text)
        out.append(store.engine().query("SELECT (COUNT(DISTINCT ?x) AS ?n) WHERE { ?x a :Area }").select(F.lit(text.split()[0]).alias("op"), F.col("n").cast("long").alias("n")))
    return reduce(DataFrame.union, out)


add("update_entailments", _entailments, "SELECT 'DISABLE' AS op, 0 AS n UNION ALL SELECT 'CREATE', count(DISTINCT n_regionkey) FROM nation UNION ALL SELECT 'DROP', 0")


def _history(spark: SparkSession, d: str) -> DataFrame:
    store = QuadStore(spark, history=True, prefixes={"": NS})
    store.load(quads(spark, d, "region"))
    store.update("DELETE WHERE { GRAPH ?g { ?x :r_regionkey ?k } }; INSERT DATA { :x :p 1 }; DELETE { :x :p 1 } INSERT { :x :p 1 } WHERE {}")
    return _count(st.as_of(store.changes, 1e12), "p")


add("update_as_of", _history, f"SELECT p, count(*) AS n FROM (SELECT unnest(['{NS}r_name', '{RDF}type']) AS p FROM region UNION ALL SELECT '{NS}p') GROUP BY 1")

# --- inference


def _owl(spark: SparkSession, d: str) -> DataFrame:
    a, p = iri(RDF + "type"), lambda x: iri(NS + x)
    owl = lambda x: iri(OWL + x)
    schema = [(p("n_region"), owl("inverseOf"), p("holds")), (p("n_region"), owl("equivalentProperty"), p("lies")), (p("near"), a, owl("SymmetricProperty")), (p("part"), a, owl("TransitiveProperty")), (p("Asian"), owl("onProperty"), p("r_name")), (p("Asian"), owl("hasValue"), literal("ASIA")), (p("Nation"), owl("equivalentClass"), p("Land")), (p("one"), a, owl("FunctionalProperty")), (p("key"), a, owl("InverseFunctionalProperty")), (p("x1"), p("near"), p("x2")), (p("x1"), p("part"), p("x2")), (p("x2"), p("part"), p("x3")), (p("x1"), p("one"), p("y1")), (p("x1"), p("one"), p("y2")), (p("z1"), p("key"), p("y1")), (p("z2"), p("key"), p("y1")), (iri(ID + "region/0"), owl("sameAs"), p("zero"))]
    t = quads(spark, d, "nation", "region").select("s", "p", "o").union(quad_rows(spark, [(*q, None) for q in schema]).select("s", "p", "o"))
    closed = inference.fixpoint(t, [*inference.OWL_RULES, inference.rdfs7, inference.rdfs9])
    wanted = F.col("p.lex").isin(*(NS + x for x in ("holds", "lies", "near", "part"))) | (F.col("o.lex").isin(NS + "Asian", NS + "Land") & (F.col("p.lex") == RDF + "type")) | ((F.col("p.lex") == OWL + "sameAs") & F.col("s.lex").startswith(NS))
    return closed.where(wanted).select(*_lex())


add("inference_owl", _owl, f"""
WITH r AS (SELECT '{ID}region/' || r_regionkey AS id, r_name FROM region UNION ALL SELECT '{NS}zero', r_name FROM region WHERE r_regionkey = 0
), n AS (SELECT '{ID}nation/' || n_nationkey AS s, '{ID}region/' || n_regionkey AS o FROM nation UNION ALL SELECT '{ID}nation/' || n_nationkey, '{NS}zero' FROM nation WHERE n_regionkey = 0)
SELECT o AS s, '{NS}holds' AS p, s AS o FROM n UNION SELECT s, '{NS}lies', o FROM n UNION SELECT id, '{RDF}type', '{NS}Asian' FROM r WHERE r_name = 'ASIA'
UNION SELECT s, '{RDF}type', '{NS}Land' FROM n
UNION SELECT '{NS}' || a, '{NS}' || b, '{NS}' || c FROM (VALUES ('x1', 'near', 'x2'), ('x2', 'near', 'x1'), ('x1', 'part', 'x2'), ('x2', 'part', 'x3'), ('x1', 'part', 'x3')) v(a, b, c)
UNION SELECT '{NS}' || a, '{OWL}sameAs', '{NS}' || b FROM (VALUES ('y1', 'y2'), ('y2', 'y1'), ('z1', 'z2'), ('z2', 'z1')) w(a, b) UNION SELECT '{NS}zero', '{OWL}sameAs', '{ID}region/0'""")


def _asserted(spark: SparkSession, d: str) -> DataFrame:
    def close(t: DataFrame) -> DataFrame:
        late = F.col("s.lex") == NS + "n_region"
        return inference.assert_delta(inference.full_closure(t.where(~late), owl=False), t.where(late), owl=False)

    return _entailed(spark, d, close)


def _retracted(spark: SparkSession, d: str) -> DataFrame:
    def close(t: DataFrame) -> DataFrame:
        extra = quad_rows(spark, [(iri(NS + "Region"), iri(RDFS + "subClassOf"), iri(NS + "Wrong"), None), (iri(NS + "Wrong"), iri(RDFS + "subClassOf"), iri(NS + "Thing"), None), (iri(ID + "region/9999"), iri(RDF + "type"), iri(NS + "Place"), None)]).select("s", "p", "o")
        told = t.select("s", "p", "o").union(extra)
        return inference.retract(told, extra, owl=False)

    return _entailed(spark, d, close)


add("inference_assert", _asserted, _ENTAILED)
add("inference_retract", _retracted, _ENTAILED)


def _same_as(spark: SparkSession, d: str) -> DataFrame:
    same = quad_rows(spark, [(iri(ID + f"region/{k}"), iri(OWL + "sameAs"), iri(f"urn:aa:region/{k}"), None) for k in range(3)]).select("s", "p", "o")
    seen = inference.same_as_expanded(quads(spark, d, "nation").select("s", "p", "o").union(same))
    return seen.where(F.col("p.lex") == NS + "n_region").select(*_lex())


add("inference_same_as_at_query", _same_as, f"SELECT '{ID}nation/' || n_nationkey AS s, '{NS}n_region' AS p, CASE WHEN n_regionkey < 3 THEN 'urn:aa:region/' ELSE '{ID}region/' END || n_regionkey AS o FROM nation")


def _custom_rule(spark: SparkSession, d: str) -> DataFrame:
    def rule(t: DataFrame) -> DataFrame:
        a = t.where(F.col("p.lex") == NS + "n_region").select("s", F.col("o").alias("m"))
        return a.join(t.where(F.col("p.lex") == NS + "r_name").select(F.col("s").alias("m"), "o"), "m").select("s", F.struct(F.lit(3).cast("tinyint").alias("kind"), F.lit(NS + "region_name").alias("lex"), F.lit(None).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang")).alias("p"), "o")

    return inference.fixpoint(quads(spark, d, "nation", "region"), [rule]).where(F.col("p.lex") == NS + "region_name").select(*_lex())


add("inference_custom_rule", _custom_rule, f"SELECT '{ID}nation/' || n_nationkey AS s, '{NS}region_name' AS p, r_name AS o FROM nation JOIN region ON n_regionkey = r_regionkey")

# --- services


def _nation(text: str):
    return lambda s, d: Engine(s, table_graph(s, d, ["nation"]), prefixes={"": NS, "id": ID}).query(text)


add("service_sample_even", _nation("SELECT ?k WHERE { SERVICE <urn:x#sample> { ?x :n_nationkey ?k . hint:Sample <urn:x#limit> 5 ; <urn:x#sampleType> 'even' } }"), "SELECT n_nationkey AS k FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS i, count(*) OVER () AS w FROM nation) WHERE floor(i * 5 / w) <> floor((i - 1) * 5 / w)")
add("service_values", _nation("SELECT ?n WHERE { SERVICE <urn:x#values> { VALUES ?n { 'NATION_3' 'NATION_4' 'none' } } ?x :n_name ?n }"), "SELECT n_name AS n FROM nation WHERE n_name IN ('NATION_3', 'NATION_4')")
add("service_null", _nation("SELECT ?n WHERE { SERVICE <urn:x#null> { } ?x :n_name ?n ; :n_nationkey 3 }"), "SELECT n_name AS n FROM nation WHERE n_nationkey = 3")


def _stored(spark: SparkSession, d: str) -> DataFrame:
    services.stored_query("urn:q#low", f"PREFIX : <{NS}> SELECT ?x ?k WHERE {{ ?x :n_nationkey ?k FILTER(?k < 4) }}")
    return _nation("SELECT ?n ?k WHERE { SERVICE <urn:q#low> {} ?x :n_name ?n }")(spark, d)


add("service_stored_query", _stored, "SELECT n_name AS n, n_nationkey AS k FROM nation WHERE n_nationkey < 4")


def _native(spark: SparkSession, d: str) -> DataFrame:
    services.native_service("urn:q#regions", lambda group: _table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")))
    return _nation("SELECT ?n ?name WHERE { SERVICE <urn:q#regions> {} ?x :n_name ?n ; :n_regionkey ?k }")(spark, d)


add("service_native", _native, "SELECT n_name AS n, r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey")
add("service_search_subject", _nation("SELECT ?x WHERE { SERVICE <urn:x/search> { ?x <urn:x/search#search> 'nation 12' ; <urn:x/search#subjectSearch> true ; <urn:x/search#matchAllTerms> true } }"), f"SELECT '{ID}nation/' || n_nationkey AS x FROM nation WHERE n_nationkey = 12")
add("service_search_regex", _nation("SELECT ?x WHERE { SERVICE <urn:x/search> { ?t <urn:x/search#search> 'nation*' ; <urn:x/search#matchRegex> '_1[0-4]$' } ?x :n_name ?t }"), f"SELECT '{ID}nation/' || n_nationkey AS x FROM nation WHERE regexp_matches(n_name, '_1[0-4]$') AND starts_with(lower(n_name), 'nation')")


def _geo(text: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        places = _places(spark, d).select(F.col("c_custkey").alias("k"), F.concat_ws("#", "lat", "lon").alias("at"))
        term = lambda kind, c: F.struct(F.lit(kind).cast("tinyint").alias("kind"), c.alias("lex"), (F.lit(XSD + "string") if kind == 4 else F.lit(None).cast("string")).alias("dt"), F.lit(None).cast("string").alias("lang"))
        rows = places.select(term(3, F.concat(F.lit("urn:c:"), F.col("k").cast("string"))).alias("s"), term(3, F.lit(NS + "at")).alias("p"), term(4, F.col("at")).alias("o"), F.lit(None).cast(TERM_DDL).alias("g"), F.lit(0).cast("tinyint").alias("st"))
        return Engine(spark, QuadGraph(rows), prefixes={"": NS}).query(text)

    return run


_GEO = "SELECT ?x WHERE {{ SERVICE <urn:t/geospatial> {{ ?x <urn:t/geospatial#search> '{}' ; <urn:t/geospatial#predicate> :at ; {} }} }}"
_AT = "p AS (SELECT c_custkey, (c_custkey % 120 - 60)::DOUBLE AS lat, (c_custkey * 7 % 300 - 150)::DOUBLE AS lon FROM customer)"
add("service_geo_rectangle", _geo(_GEO.format("inRectangle", "<urn:t/geospatial#spatialRectangleSouthWest> '10#-20' ; <urn:t/geospatial#spatialRectangleNorthEast> '50#40'")), f"WITH {_AT} SELECT 'urn:c:' || c_custkey AS x FROM p WHERE lat BETWEEN 10 AND 50 AND lon BETWEEN -20 AND 40")
add("service_geo_circle", _geo(_GEO.format("inCircle", "<urn:t/geospatial#spatialCircleCenter> '10#20' ; <urn:t/geospatial#spatialCircleRadius> '2500'")), f"WITH {_AT} SELECT 'urn:c:' || c_custkey AS x FROM p WHERE degrees(acos(least(1, greatest(-1, sin(radians(lat)) * sin(radians(10)) + cos(radians(lat)) * cos(radians(10)) * cos(radians(lon - 20)))))) * 60 * 1.1515 * 1.609344 <= 2500")


def _walk(options: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = event_edges(spark, d)
        term = lambda c: F.struct(F.lit(3).cast("tinyint").alias("kind"), F.concat(F.lit("urn:e:"), c).alias("lex"), F.lit(None).cast("string").alias("dt"), F.lit(None).cast("string").alias("lang"))
        rows = e.select(term(F.col("src")).alias("s"), term(F.lit("then")).alias("p"), term(F.col("dst")).alias("o"), F.lit(None).cast(TERM_DDL).alias("g"), F.lit(0).cast("tinyint").alias("st"))
        return Engine(spark, QuadGraph(rows)).query(f"SELECT ?x WHERE {{ SERVICE <urn:t/gas> {{ <urn:p> <urn:t/gas#linkType> <urn:e:then> ; {options} ; <urn:t/gas#out> ?x }} }}")

    return run


_STEPS = "WITH n AS (SELECT event_type AS s, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS o FROM events), e AS (SELECT DISTINCT s, o FROM n WHERE o IS NOT NULL)"
add("service_walk_reverse", _walk("<urn:t/gas#gasClass> 'BFS' ; <urn:t/gas#in> <urn:e:click> ; <urn:t/gas#traversalDirection> 'Reverse' ; <urn:t/gas#maxIterations> 1"), f"{_STEPS} SELECT DISTINCT 'urn:e:' || s AS x FROM e WHERE o = 'click' UNION SELECT 'urn:e:click'")
add("service_walk_fuzzy", _walk("<urn:t/gas#gasClass> 'FuzzySSSP' ; <urn:t/gas#in> <urn:e:click> ; <urn:t/gas#target> <urn:e:purchase>"), f"{_STEPS} SELECT unnest(['urn:e:click', 'urn:e:purchase']) AS x FROM e WHERE s = 'click' AND o = 'purchase'")
add("gas_vertex_sample", lambda s, d: gas.sample_vertices(event_edges(s, d), 3).agg(F.count_distinct("id").alias("n")), f"{_STEPS} SELECT least(3, count(*)) AS n FROM (SELECT s FROM e UNION SELECT o FROM e)")

# --- functions and aggregates

ask("agg_sample", "SELECT ?n (SAMPLE(?g) AS ?s) WHERE { ?x :n_name ?n ; :n_region ?r . ?r :r_name ?g } GROUP BY ?n", "SELECT n_name AS n, r_name AS s FROM nation JOIN region ON n_regionkey = r_regionkey")
ask("fn_languages", "SELECT ?n (LANG(STRLANG(?n, 'en-GB')) AS ?l) (LANGMATCHES(LANG(STRLANG(?n, 'en-GB')), 'en') AS ?m) (LANGMATCHES(LANG(?n), '*') AS ?z) WHERE { ?x :n_name ?n }", "SELECT n_name AS n, 'en-GB' AS l, true AS m, false AS z FROM nation")
ask("fn_made_literals", "SELECT ?k (STRDT(STR(?k), xsd:integer) + 1 AS ?i) (STR(DATATYPE(STRDT('x', <urn:t>))) AS ?d) WHERE { ?x :n_nationkey ?k }", "SELECT n_nationkey AS k, n_nationkey + 1 AS i, 'urn:t' AS d FROM nation")
ask("fn_long_casts", "SELECT ?k (xsd:long(STR(?k)) AS ?a) (xsd:unsignedLong(?k) AS ?b) (xsd:int('12') AS ?c) WHERE { ?x :n_nationkey ?k }", "SELECT n_nationkey AS k, n_nationkey AS a, n_nationkey AS b, 12 AS c FROM nation")
_DIGESTS = ", ".join(f"('NATION_{k}', '{hashlib.sha224(f'NATION_{k}'.encode()).hexdigest()}', '{hashlib.sha384(f'NATION_{k}'.encode()).hexdigest()}', '{hashlib.sha512(f'NATION_{k}'.encode()).hexdigest()}')" for k in range(25))
ask("fn_long_digests", "SELECT ?n (SHA224(?n) AS ?a) (SHA384(?n) AS ?b) (SHA512(?n) AS ?c) WHERE { ?x :n_name ?n }", f"SELECT n, a, b, c FROM nation JOIN (VALUES {_DIGESTS}) v(n, a, b, c) ON n = n_name")
ask("fn_times", "SELECT ?k (xsd:double(SECONDS('2011-01-10T14:45:13.5-05:00'^^xsd:dateTime)) AS ?s) (TZ('2011-01-10T14:45:13-05:00'^^xsd:dateTime) AS ?t) (STR(TIMEZONE('2011-01-10T14:45:13-05:00'^^xsd:dateTime)) AS ?z) WHERE { ?x :r_regionkey ?k }", "SELECT r_regionkey AS k, 13.5::DOUBLE AS s, '-05:00' AS t, '-PT5H' AS z FROM region")
ask("fn_logic_with_errors", "SELECT ?k (COALESCE(1/0, ?k) AS ?a) (?k >= 0 || 1/0 = 1 AS ?b) (?k < 0 && 1/0 = 1 AS ?c) (BOUND(?u) AS ?d) WHERE { ?x :r_regionkey ?k OPTIONAL { ?x :r_none ?u } }", "SELECT r_regionkey AS k, r_regionkey AS a, true AS b, false AS c, false AS d FROM region")


def _custom(spark: SparkSession, d: str) -> DataFrame:
    register("urn:f#reverse", lambda a: string(F.reverse(a.text())))
    register_aggregate("urn:f#longest", lambda a: Val(F.max(F.length(a.text())).cast("long"), "literal", XSD + "integer"))
    return _nation("SELECT ?r (<urn:f#longest>(<urn:f#reverse>(?n)) AS ?m) WHERE { ?x :n_name ?n ; :n_regionkey ?r } GROUP BY ?r")(spark, d)


add("fn_custom", _custom, "SELECT n_regionkey AS r, max(length(n_name)) AS m FROM nation GROUP BY 1")

# --- calls


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    e = Engine(spark, table_graph(spark, d, ["nation"]), prefixes={"": NS})
    return e.prepare("SELECT ?n WHERE { ?x :n_name ?n }").bind(x=iri(ID + "nation/7")).run()


add("api_prepared", _prepared, "SELECT n_name AS n FROM nation WHERE n_nationkey = 7")


def _served(spark: SparkSession, d: str) -> DataFrame:
    server = Server(spark)
    server.create("kb", prefixes={"": NS, "id": ID}).load(quads(spark, d, "region"))
    pattern = (None, iri(NS + "r_name"), None)
    found = [("estimate", server.estimate("kb", *pattern)), ("has", int(server.has("kb", *pattern))), ("contexts", server.contexts("kb").count()), ("statements", server.statements("kb", *pattern).count()), ("changed", server.update("kb", "INSERT DATA { :x :p 1 }"))]
    server.delete("kb", *pattern)
    return spark.createDataFrame([*found, ("left", server.stores["kb"].quads.count())], "call string, n long")


add("api_server", _served, "SELECT call, n FROM (SELECT count(*) AS c FROM region), LATERAL (VALUES ('estimate', c), ('has', 1), ('contexts', 1), ('statements', c), ('changed', 1), ('left', 2 * c + 1)) v(call, n)")
add("api_match_keyword", lambda s, d: match_keyword(quads(s, d, "nation", "region"), "nation_1", [NS + "Nation"], [NS + "n_name"]).select(F.col("s.lex").alias("s"), F.col("o.lex").alias("o")), f"SELECT '{ID}nation/' || n_nationkey AS s, n_name AS o FROM nation WHERE lower(n_name) LIKE 'nation!_1%' ESCAPE '!'")


def _statistics(spark: SparkSession, d: str) -> DataFrame:
    found = solution_statistics(_nation("SELECT ?n ?u WHERE { ?x :n_name ?n OPTIONAL { ?x :n_nationkey ?u FILTER(?u < 5) } }")(spark, d))
    return spark.createDataFrame([(k, v["rows"], v["bound"]) for k, v in found.items()], "variable string, rows long, bound long")


add("api_statistics", _statistics, "SELECT 'n' AS variable, count(*) AS rows, count(*) AS bound FROM nation UNION ALL SELECT 'u', count(*), count(*) FILTER (n_nationkey < 5) FROM nation")
