"""Namespaces, transactions, federation, and bulk helpers."""

import json

import pytest

from triloom.server import Server, Transaction, match_keyword, solution_statistics
from triloom.sources.remote import Endpoint, external_search, remote, request_text
from triloom.store_quads import quad_rows
from triloom.terms import RDF, Term, iri, literal


def answers(url, query, headers):
    """A stand-in endpoint that knows ages; it runs on executors, so it takes and gives text only."""
    ages = {"urn:x#a": "31", "urn:x#b": "25"}
    found = [(s, n) for s, n in ages.items() if "VALUES" not in query or f"<{s}>" in query]
    return json.dumps({"head": {"vars": ["o", "s"]}, "results": {"bindings": [{"s": {"type": "uri", "value": s}, "o": {"type": "literal", "value": n, "datatype": "http://www.w3.org/2001/XMLSchema#integer"}} for s, n in found]}})


def test_server(spark):
    server = Server(spark)
    server.create("kb")
    assert server.update("kb", "INSERT DATA { <urn:x#a> <urn:x#p> 1, 2 . <urn:x#b> <urn:x#p> 3 }") == 3
    assert server.namespaces() == ["kb"] and server.estimate("kb", iri("urn:x#a")) == 2 and server.has("kb", None, iri("urn:x#p"))
    lines = server.query("kb", "SELECT ?o WHERE { <urn:x#b> ?p ?o }").collect()
    assert json.loads(lines[0].value)["o"]["value"] == "3"
    assert server.query("kb", "ASK { ?s ?p 3 }") == '{"head":{},"boolean":true}'
    assert server.query("kb", "CONSTRUCT WHERE { ?s ?p 3 }", "application/n-triples").collect()[0].value.startswith("<urn:x#b> <urn:x#p>")
    server.delete("kb", iri("urn:x#a"))
    assert server.statements("kb").count() == 1
    server.destroy("kb")
    assert server.namespaces() == []


def test_transactions(spark):
    store = Server(spark).create("t")
    tx = Transaction(store)
    tx.update("INSERT DATA { <urn:a> <urn:p> 1 }")
    assert store.query("ASK { ?s ?p ?o }") is False and tx.query("ASK { ?s ?p ?o }") is True
    other = Transaction(store)
    tx.commit()
    assert store.query("ASK { ?s ?p ?o }") is True
    other.update("INSERT DATA { <urn:b> <urn:p> 1 }")
    with pytest.raises(RuntimeError):
        other.commit()


def test_federation(spark):
    store = Server(spark).create("f")
    store.update("INSERT DATA { <urn:x#a> <urn:x#name> 'Anna' . <urn:x#c> <urn:x#name> 'Carl' }")
    engine = store.engine()
    engine.remote = remote({"urn:there": Endpoint()}, answers)
    got = engine.query("SELECT ?n ?o WHERE { ?s <urn:x#name> ?n SERVICE <urn:there> { ?s <urn:x#age> ?o } }").collect()
    assert [tuple(r) for r in got] == [("Anna", "31")]
    assert engine.query("SELECT ?n WHERE { ?s <urn:x#name> ?n SERVICE SILENT <urn:there> { FILTER(?n = 1) } }").count() == 2


def test_requests_in_all_dialects():
    rows = [["<urn:a>", None], ["<urn:b>", "1"]]
    assert request_text("P", ["x"], ["x", "y"], rows, "values") == "SELECT ?x WHERE { VALUES (?x ?y) { (<urn:a> UNDEF) (<urn:b> 1) } P }"
    assert request_text("P", ["x"], ["x", "y"], rows, "bindings").endswith("BINDINGS ?x ?y { (<urn:a> UNDEF) (<urn:b> 1) }")
    assert request_text("P", ["x"], ["x"], [["<urn:a>"]], "union") == "SELECT ?x WHERE { { P FILTER(sameTerm(?x, <urn:a>)) } }"


def test_external_search(spark):
    from triloom.plans.compiler import register_service

    register_service("urn:e#search", external_search("http://none", lambda url, q: {"response": {"docs": [{"id": "urn:d1", "score": 2.5}]}}))
    engine = Server(spark).create("e").engine()
    got = engine.query("SELECT ?d ?s WHERE { SERVICE <urn:e#search> { ?d <urn:e#search> 'word' ; <urn:e#score> ?s } }").collect()
    assert [tuple(r) for r in got] == [("urn:d1", 2.5)]


def test_match_keyword_and_statistics(spark):
    t = iri(RDF + "type")
    rows = quad_rows(spark, [(iri("urn:a"), t, iri("urn:T")), (iri("urn:a"), iri("urn:label"), literal("Red Bus")), (iri("urn:b"), iri("urn:label"), literal("red car")), (Term(1, "x"), t, iri("urn:T"))])
    assert [r.s.lex for r in match_keyword(rows, "red", ["urn:T"], ["urn:label"]).collect()] == ["urn:a"]
    assert solution_statistics(rows.select("s", "g"))["g"]["bound"] == 0
