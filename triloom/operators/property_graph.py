"""Property graphs as vertices and edges.

Vertices are (id, properties), edges (id, src, dst, label, properties); both come
from quads or go there, so a property graph and its statements are one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.graphs import EXPLICIT, QUADS_DDL
from ..terms import IRI, LITERAL, RDF, STRING, TERM_DDL, Val, make_term

BASE = "urn:x-graph:"


@dataclass
class PropertyGraph:
    """Vertices and edges; properties are maps of strings."""

    vertices: DataFrame
    edges: DataFrame

    @classmethod
    def from_quads(cls, quads: DataFrame, base: str = BASE) -> PropertyGraph:
        """Resources typed Vertex and Edge, with their literals."""
        typed = lambda name: quads.where((F.col("p.lex") == RDF + "type") & (F.col("o.lex") == base + name)).select(F.col("s.lex").alias("id")).distinct()
        literals = quads.where(F.col("o.kind") == LITERAL).groupBy(F.col("s.lex").alias("id")).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.replace(F.col("p.lex"), F.lit(base), F.lit("")).alias("k"), F.col("o.lex").alias("v"))))).alias("properties"))
        links = lambda name: quads.where(F.col("p.lex") == base + name).select(F.col("s.lex").alias("id"), F.col("o.lex").alias(name))
        edges = typed("Edge").join(links("from"), "id").join(links("to"), "id").join(links("label"), "id", "left").join(literals, "id", "left")
        return cls(typed("Vertex").join(literals, "id", "left"), edges.select("id", F.col("from").alias("src"), F.col("to").alias("dst"), "label", "properties"))

    def vertex(self, vertex_id: str) -> DataFrame:
        return self.vertices.where(F.col("id") == vertex_id)

    def edge(self, edge_id: str) -> DataFrame:
        return self.edges.where(F.col("id") == edge_id)

    def where_vertices(self, key: str, value: str) -> DataFrame:
        return self.vertices.where(F.col("properties")[key] == value)

    def where_edges(self, key: str, value: str) -> DataFrame:
        return self.edges.where(F.col("properties")[key] == value)

    def incident(self, vertex_id: str, way: str = "both", labels: list[str] | None = None) -> DataFrame:
        """Edges of a vertex: out, in or both, of some labels."""
        at: dict[str, Column] = {"out": F.col("src") == vertex_id, "in": F.col("dst") == vertex_id}
        at["both"] = at["out"] | at["in"]
        rows = self.edges.where(at[way])
        return rows.where(F.col("label").isin(labels)) if labels else rows

    def neighbours(self, vertex_id: str, way: str = "both", labels: list[str] | None = None) -> DataFrame:
        """Vertices at the other ends of a vertex's edges."""
        other = F.when(F.col("src") == vertex_id, F.col("dst")).otherwise(F.col("src"))
        return self.incident(vertex_id, way, labels).select(other.alias("id")).distinct().join(self.vertices, "id", "left")

    def quads(self, base: str = BASE) -> DataFrame:
        """The graph's statements."""
        ref = lambda c: make_term(IRI, c)
        name = lambda n: make_term(IRI, F.lit(n))

        def rows(df: DataFrame, s: Column, p: Column, o: Column) -> DataFrame:
            return df.select(s.alias("s"), p.alias("p"), o.alias("o"), F.lit(None).cast(TERM_DDL).alias("g"), F.lit(EXPLICIT).cast("tinyint").alias("st"))

        def literals(df: DataFrame) -> DataFrame:
            each = df.select("id", F.explode("properties").alias("k", "v"))
            return rows(each, ref(F.col("id")), ref(F.concat(F.lit(base), "k")), Val(F.col("v"), "literal", STRING).term())

        e = self.edges
        parts = [
            rows(self.vertices, ref(F.col("id")), name(RDF + "type"), name(base + "Vertex")), literals(self.vertices),
            rows(e, ref(F.col("id")), name(RDF + "type"), name(base + "Edge")), rows(e, ref(F.col("id")), name(base + "from"), ref(F.col("src"))), rows(e, ref(F.col("id")), name(base + "to"), ref(F.col("dst"))),
            rows(e.where("label is not null"), ref(F.col("id")), name(base + "label"), Val(F.col("label"), "literal", STRING).term()), rows(e, ref(F.col("src")), ref(F.concat(F.lit(base), F.coalesce("label", F.lit("edge")))), ref(F.col("dst"))), literals(e),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.distinct()


__all__ = ["BASE", "PropertyGraph", "QUADS_DDL"]
