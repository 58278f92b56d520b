"""Federation: remote SPARQL endpoints and external text search, asked in batches by the executors.

Bound values of the join variables travel with each request, as a VALUES block,
so an endpoint returns what joins and not its whole graph.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlencode
from urllib.request import Request, urlopen

import pyarrow as pa

from ..plans.algebra import Group, Quoted, Triple, Var
from ..plans.compiler import variables
from ..terms import TERM_DDL, Term, Val
from .graphs import Solutions
from .rdf import json_term

Fetch = Callable[[str, str, dict[str, str]], str]


@dataclass
class Endpoint:
    """How an endpoint is asked: dialect of bound values (values, bindings or union), method, headers."""

    dialect: str = "values"
    method: str = "POST"
    headers: dict[str, str] = field(default_factory=dict)
    timeout: float = 60.0
    rows: int = 200


def fetch(url: str, query: str, headers: dict[str, str], method: str = "POST", timeout: float = 60.0) -> str:
    """One request; the answer in the JSON result format."""
    data = urlencode({"query": query})
    headers = {"Accept": "application/sparql-results+json", **headers}
    if method == "GET":
        request = Request(f"{url}?{data}", headers=headers)
    else:
        request = Request(url, data.encode(), headers={"Content-Type": "application/x-www-form-urlencoded", **headers})
    with urlopen(request, timeout=timeout) as answer:
        return answer.read().decode()


def _text(x: object) -> str:
    if isinstance(x, Var):
        return "?" + x.name.strip()
    if isinstance(x, Quoted):
        return f"<<{_text(x.s)} {_text(x.p)} {_text(x.o)}>>"
    return x.n3()


def pattern_text(g: Group) -> str:
    """The triples of a group as SPARQL; other patterns can't be sent."""
    if not all(isinstance(t, Triple) and isinstance(t.p, (Term, Var)) for t in g.parts):
        raise ValueError("only triple patterns can be sent to a remote service")
    return " ".join(f"{_text(t.s)} {_text(t.p)} {_text(t.o)} ." for t in g.parts)


def request_text(pattern: str, names: list[str], bound: list[str], rows: list[list[str | None]], dialect: str) -> str:
    """A query for solutions that join the given rows of N-Triples terms."""
    head = f"SELECT {' '.join('?' + n for n in names)} WHERE {{ "
    if not bound or not rows:
        return f"{head}{pattern} }}"
    if dialect == "union":
        parts = [" ".join(f"FILTER(sameTerm(?{n}, {v}))" for n, v in zip(bound, row, strict=True) if v) for row in rows]
        return head + " UNION ".join(f"{{ {pattern} {p} }}" for p in parts) + " }"
    block = " ".join(f"({' '.join(v or 'UNDEF' for v in row)})" for row in rows)
    variables_ = " ".join("?" + n for n in bound)
    if dialect == "bindings":
        return f"{head}{pattern} }} BINDINGS {variables_} {{ {block} }}"
    return f"{head}VALUES ({variables_}) {{ {block} }} {pattern} }}"


def remote(endpoints: dict[str, Endpoint] | None = None, get: Fetch | None = None) -> Callable:
    """What an engine's ``remote`` can be: SERVICE calls to endpoints over HTTP."""
    known = endpoints or {}

    def call(compiler, url: str, group: Group, found: Solutions | None) -> Solutions:
        endpoint = known.get(url, Endpoint())
        ask = get or (lambda u, q, h: fetch(u, q, h, endpoint.method, endpoint.timeout))
        pattern, names = pattern_text(group), sorted(n for n in variables(group) if not n.startswith(" "))
        bound = sorted(set(names) & set(found.variables)) if found else []
        if bound:
            from ..functions.expressions import n3

            keys = found.df.select(*(n3(found.val(n)).alias(n) for n in bound)).distinct()
        else:
            keys = compiler.spark.range(1).selectExpr("cast(null as string) as x")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            term = pa.struct([("kind", pa.int8()), ("lex", pa.string()), ("dt", pa.string()), ("lang", pa.string())])
            schema = pa.schema([(f"v_{n}", term) for n in names])
            for batch in batches:
                for low in range(0, batch.num_rows, endpoint.rows):
                    part = batch.slice(low, endpoint.rows)
                    rows = [list(r.values()) for r in part.to_pylist()] if bound else []
                    answer = json.loads(ask(url, request_text(pattern, names, bound, rows, endpoint.dialect), endpoint.headers))
                    out = []
                    for b in answer["results"]["bindings"]:
                        terms = {n: json_term(v) for n, v in b.items()}
                        out.append({f"v_{n}": vars(terms[n]) if n in terms else None for n in names})
                    yield pa.RecordBatch.from_pylist(out, schema)

        df = keys.mapInArrow(run, ", ".join(f"`v_{n}` {TERM_DDL}" for n in names)).distinct()
        return Solutions.of(df, {n: Val(df[f"v_{n}"]) for n in names})

    return call


def external_search(url: str, fetch_json: Callable[[str, dict[str, str]], dict] | None = None) -> Callable:
    """A service that asks an external text index: parameters by triples, hits as ?res ?score ?snippet."""

    def build(compiler, group: Group, scope, found) -> Solutions:
        p = {t.p.lex.rsplit("#", 1)[-1]: t.o for t in group.parts if isinstance(t, Triple)}
        subject = next(t.s for t in group.parts if isinstance(t, Triple))
        wanted = {k: v.lex for k, v in p.items() if isinstance(v, Term)}
        ask = fetch_json or (lambda u, q: json.loads(urlopen(f"{u}?{urlencode(q)}", timeout=60).read()))
        docs = ask(p["endpoint"].lex if isinstance(p.get("endpoint"), Term) else url, {"q": wanted.get("search", ""), "wt": "json", **({"fl": wanted["fieldToSearch"]} if "fieldToSearch" in wanted else {})})["response"]["docs"]
        rows = [(str(d.get(wanted.get("searchField", "id"), "")), float(d.get(wanted.get("scoreField", "score"), 0.0)), str(d.get(wanted.get("snippetField", "snippet"), ""))) for d in docs]
        df = compiler.spark.createDataFrame(rows, "res string, score double, snippet string")
        values = {subject.name: Val(df["res"], "iri")}
        xsd = "http://www.w3.org/2001/XMLSchema#"
        if isinstance(p.get("score"), Var):
            values[p["score"].name] = Val(df["score"], "literal", xsd + "double")
        if isinstance(p.get("snippet"), Var):
            values[p["snippet"].name] = Val(df["snippet"], "literal", xsd + "string")
        return Solutions.of(df, values)

    return build
