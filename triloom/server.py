"""Namespaces of stores, and requests as an HTTP layer would hand them over."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.parser import parse_query
from .sources import rdf
from .store_quads import QUADS, QuadStore
from .terms import Term

FORMATS = {"application/sparql-results+json": "json", "application/sparql-results+xml": "xml", "text/csv": "csv", "text/tab-separated-values": "tsv"}
GRAPH_FORMATS = {"application/n-triples": "nt", "application/n-quads": "nq", "text/turtle": "ttl", "application/trig": "trig", "application/rdf+xml": "rdf", "application/trix": "trix", "application/rdf+json": "rj", "application/ld+json": "jsonld"}


@dataclass
class Server:
    """Several named stores in one session."""

    spark: SparkSession
    stores: dict[str, QuadStore] = field(default_factory=dict)

    def create(self, name: str, mode: str = QUADS, **options: Any) -> QuadStore:
        if name in self.stores:
            raise ValueError(f"namespace {name} exists")
        self.stores[name] = QuadStore(self.spark, mode=mode, **options)
        return self.stores[name]

    def destroy(self, name: str) -> None:
        del self.stores[name]

    def namespaces(self) -> list[str]:
        return sorted(self.stores)

    def query(self, name: str, text: str, accept: str = "application/sparql-results+json") -> DataFrame | str:
        """Lines of the result in the format asked for; ASK gives the whole text."""
        store, form = self.stores[name], parse_query(text, self.stores[name].prefixes).form
        if form == "ask":
            return rdf.boolean_result(store.query(text), FORMATS.get(accept, "text"))
        if form in ("construct", "describe"):
            return rdf.WRITERS[GRAPH_FORMATS.get(accept, "nt")](store.query(text).withColumn("g", F.lit(None).cast("struct<kind:tinyint,lex:string,dt:string,lang:string>")))
        found = store.query(text, "terms")
        kind = FORMATS.get(accept, "json")
        return {"json": rdf.result_json, "xml": rdf.result_xml, "csv": rdf.result_table, "tsv": lambda d: rdf.result_table(d, "\t")}[kind](found)

    def update(self, name: str, text: str) -> int:
        """Runs updates; the number of statements that changed."""
        store = self.stores[name]
        before = store.changes.count()
        store.update(text)
        return store.changes.count() - before

    def insert(self, name: str, path: str, graph: Term | None = None) -> None:
        """Loads a file, like a POST of its content."""
        from .plans.algebra import Update
        from .terms import iri

        self.stores[name].apply(Update("load", source=iri(path), target=graph))

    def delete(self, name: str, s: Term | None = None, p: Term | None = None, o: Term | None = None, g: Term | None = None) -> None:
        """Removes statements of a pattern."""
        store = self.stores[name]
        rows = store.quads.where(F.col("st") == 0)
        for at, x in zip("spog", (s, p, o, g), strict=True):
            if x is not None:
                rows = rows.where((F.col(f"{at}.kind") == x.kind) & (F.col(f"{at}.lex") == x.lex))
        store._commit(None, rows.select("s", "p", "o", "g"))  # noqa: SLF001

    def estimate(self, name: str, *pattern: Term | None) -> int:
        return self.stores[name].engine().cardinality(*pattern)

    def has(self, name: str, *pattern: Term | None) -> bool:
        return self.stores[name].engine().has(*pattern)

    def statements(self, name: str, *pattern: Term | None) -> DataFrame:
        return rdf.statement_lines(self.stores[name].engine().match(*pattern))

    def contexts(self, name: str) -> DataFrame:
        return self.stores[name].engine().contexts()


class Transaction:
    """A read-write view of one version; commit fails if another came between."""

    def __init__(self, store: QuadStore):
        self.store, self.version = store, store.version
        self.own = QuadStore(store.spark, mode=store.mode, history=store.history, prefixes=store.prefixes)
        self.own.quads = store.quads
        self.pending: list[str] = []

    def query(self, text: str, form: str = "n3") -> DataFrame | bool:
        return self.own.query(text, form)

    def update(self, text: str) -> None:
        self.own.update(text)
        self.pending.append(text)

    def commit(self) -> None:
        if self.store.version != self.version:
            raise RuntimeError("the store has changed since the transaction began")
        for text in self.pending:
            self.store.update(text)
        self.version = self.store.version

    def abort(self) -> None:
        self.own.quads, self.pending = self.store.quads, []


def match_keyword(quads: DataFrame, keyword: str, types: list[str], properties: list[str]) -> DataFrame:
    """Subjects of given types one of whose given properties has a literal with a keyword: (s, o)."""
    typed = quads.where((F.col("p.lex") == "http://www.w3.org/1999/02/22-rdf-syntax-ns#type") & F.col("o.lex").isin(types)).select("s").distinct()
    named = quads.where(F.col("p.lex").isin(properties) & (F.col("o.kind") == 4) & F.lower("o.lex").contains(keyword.lower()))
    return named.select("s", "o").join(typed, "s", "left_semi").distinct()


def solution_statistics(df: DataFrame) -> dict[str, dict[str, int]]:
    """For each variable how often it is bound and about how many values it has."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(c).alias(f"b_{c}") for c in df.columns), *(F.approx_count_distinct(F.to_json(F.struct(c))).alias(f"d_{c}") for c in df.columns)).first()
    return {c: {"rows": row["n"], "bound": row[f"b_{c}"], "distinct": row[f"d_{c}"]} for c in df.columns}
