"""RDF files as quads, and quads as RDF files.

N-Triples and N-Quads are read and written line by line in DataFrame functions,
so files of any size are shared out.  Other formats are documents that can't be
split; each file is parsed by one task, and many files by many.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import n3
from ..plans.algebra import Quoted, Triple
from ..plans.parser import Parser
from ..terms import BNODE, IRI, LITERAL, RDF, STATEMENT, STRING, TERM_DDL, XSD, Term, Val, iri, literal
from .graphs import EXPLICIT, parse_n3

_NODE = r'(<<.*?>>|<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)'
LINE = rf"^\s*{_NODE}\s*(<[^>]*>)\s*{_NODE}\s*(<[^>]*>|_:\S+)?\s*\.\s*(?:#.*)?$"
Statement = tuple[Term, Term, Term, Term | None]
_XML = "http://www.w3.org/XML/1998/namespace"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples (also with quoted statements) or N-Quads; lines that are not statements are left out."""
    lines = spark.read.text(path)
    part = lambda k: F.regexp_extract("value", LINE, k)
    rows = lines.where(F.col("value").rlike(LINE)).select(*(parse_n3(unescaped(part(k))).alias(n) for k, n in ((1, "s"), (2, "p"), (3, "o"))), F.when(part(4) != "", parse_n3(part(4))).alias("g"))
    return rows.select("s", "p", "o", F.col("g").cast(TERM_DDL).alias("g"), F.lit(EXPLICIT).cast("tinyint").alias("st"))


def unescaped(text: Column) -> Column:
    r"""\u escapes resolved, where there are any."""
    parts = F.split(text, r"\\u")
    one = lambda x: F.concat(F.decode(F.unhex(F.substring(x, 1, 4)), "UTF-16BE"), F.substring(x, 5, 1 << 30))
    joined = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, 1 << 20), one), ""))
    return F.when(text.contains("\\u"), joined).otherwise(text)


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither statements, nor empty, nor comments."""
    lines = spark.read.text(path)
    return lines.where(~F.col("value").rlike(LINE) & ~F.col("value").rlike(r"^\s*(#.*)?$"))


# --- parsers of whole documents


class _Documents(Parser):
    """Turtle, TriG and N3 documents by the term grammar of queries."""

    def __init__(self, text: str, base: str = ""):
        # @prefix and @base read like PREFIX and BASE.
        super().__init__(text, base=base)
        self.prefixes = {}
        self.blank_terms = True

    def statements(self) -> Iterator[Statement]:
        graph: Term | None = None
        while self.kind != "end":
            if self.kind == "lang" and self.text in ("@prefix", "@base"):
                self.tokens[self.at] = ("word", self.text[1:])
                self.prologue()
                self.take(".")
            elif self.is_word("PREFIX", "BASE"):
                self.prologue()
            elif self.take("}"):
                graph = None
                self.take(".")
            elif self.is_op("{"):
                self.next()
            elif self.word("GRAPH"):
                graph = self.term()
                self.need("{")
            elif graph is None and self.tokens[self.at + 1][1] == "{" and self.kind in ("iri", "name", "blank"):
                graph = self.term()
                self.need("{")
            else:
                for t in self.triples():
                    yield self._ground(t.s), self._ground(t.p), self._ground(t.o), graph
                self.take(".")

    def properties(self, subject: object) -> None:
        if self.is_op("="):
            self.next()
            self.extra.append(Triple(subject, iri("http://www.w3.org/2002/07/owl#sameAs"), self.node()))
            return
        super().properties(subject)

    def _ground(self, x: object) -> Term:
        if isinstance(x, Quoted):
            return Term(STATEMENT, f"<<{' '.join(self._ground(y).n3() for y in (x.s, x.p, x.o))}>>")
        if not isinstance(x, Term):
            raise ValueError(f"not a term: {x!r}")
        return x


def turtle(text: str, base: str = "") -> Iterator[Statement]:
    """Turtle, TriG and N3 without formulas."""
    return _Documents(text, base).statements()


def rdf_xml(text: str, base: str = "") -> Iterator[Statement]:
    """RDF/XML."""
    count = [0]

    def blank(name: str | None = None) -> Term:
        count[0] += 1
        return Term(BNODE, name or f"x{count[0]}")

    name = lambda tag: tag[1:].replace("}", "", 1)
    rdf = lambda n: f"{{{RDF}}}{n}"

    def node(e: ET.Element, base: str, lang: str | None) -> Iterator:
        base, lang = e.get(f"{{{_XML}}}base", base), e.get(f"{{{_XML}}}lang", lang)
        if (about := e.get(rdf("about"))) is not None:
            s = iri(urljoin(base, about))
        elif (ident := e.get(rdf("ID"))) is not None:
            s = iri(f"{base}#{ident}")
        else:
            s = blank(e.get(rdf("nodeID")))
        yield s
        if e.tag != rdf("Description"):
            yield s, iri(RDF + "type"), iri(name(e.tag)), None
        for k, v in e.attrib.items():
            if not k.startswith((f"{{{RDF}}}", f"{{{_XML}}}")) or k == rdf("type"):
                yield s, iri(name(k)), iri(v) if k == rdf("type") else literal(v, lang=lang), None
        place = 0
        for child in e:
            if child.tag == rdf("li"):
                place += 1
            p = iri(f"{RDF}_{place}" if child.tag == rdf("li") else name(child.tag))
            yield from arc(s, p, child, base, lang)

    def arc(s: Term, p: Term, e: ET.Element, base: str, lang: str | None) -> Iterator:
        lang = e.get(f"{{{_XML}}}lang", lang)
        kind = e.get(rdf("parseType"))
        if (target := e.get(rdf("resource"))) is not None:
            yield s, p, iri(urljoin(base, target)), None
        elif (target := e.get(rdf("nodeID"))) is not None:
            yield s, p, blank(target), None
        elif kind == "Resource":
            o = blank()
            yield s, p, o, None
            for child in e:
                yield from arc(o, iri(name(child.tag)), child, base, lang)
        elif kind == "Collection":
            heads = []
            for child in e:
                made = node(child, base, lang)
                heads.append(next(made))
                yield from made
            o: Term = iri(RDF + "nil")
            for head in reversed(heads):
                cell = blank()
                yield cell, iri(RDF + "first"), head, None
                yield cell, iri(RDF + "rest"), o, None
                o = cell
            yield s, p, o, None
        elif kind == "Literal":
            yield s, p, literal("".join(ET.tostring(c, encoding="unicode") for c in e) or e.text or "", RDF + "XMLLiteral"), None
        elif len(e):
            made = node(e[0], base, lang)
            yield s, p, next(made), None
            yield from made
        else:
            dt = e.get(rdf("datatype"))
            yield s, p, literal(e.text or "", dt, None if dt else lang), None

    root = ET.fromstring(text)
    base = root.get(f"{{{_XML}}}base", base)
    lang = root.get(f"{{{_XML}}}lang")
    for e in root if root.tag == rdf("RDF") else [root]:
        made = node(e, base, lang)
        next(made)
        yield from made


def trix(text: str, base: str = "") -> Iterator[Statement]:
    """TriX."""
    bare = lambda e: e.tag.rsplit("}", 1)[-1]

    def term(e: ET.Element) -> Term:
        value = e.text or ""
        if bare(e) == "uri":
            return iri(value.strip())
        if bare(e) == "id":
            return Term(BNODE, value.strip())
        return literal(value, e.get("datatype"), e.get(f"{{{_XML}}}lang"))

    for graph in ET.fromstring(text):
        name = next((term(e) for e in graph if bare(e) in ("uri", "id")), None)
        for e in graph:
            if bare(e) == "triple":
                s, p, o = map(term, e)
                yield s, p, o, name


def _resource(text: str) -> Term:
    return Term(BNODE, text[2:]) if text.startswith("_:") else iri(text)


def rdf_json(text: str, base: str = "") -> Iterator[Statement]:
    """RDF/JSON."""
    for s, properties in json.loads(text).items():
        for p, values in properties.items():
            for v in values:
                o = literal(v["value"], v.get("datatype"), v.get("lang")) if v["type"] == "literal" else _resource(v["value"])
                yield _resource(s), iri(p), o, None


def construct_json(text: str, base: str = "") -> Iterator[Statement]:
    """Constructed statements as query results in JSON (variables subject, predicate, object, context)."""
    for row in json.loads(text)["results"]["bindings"]:
        terms = {k: json_term(v) for k, v in row.items()}
        yield terms["subject"], terms["predicate"], terms["object"], terms.get("context")


def json_term(v: dict) -> Term:
    """A term of the JSON result format."""
    if v["type"] in ("uri", "bnode"):
        return Term(IRI if v["type"] == "uri" else BNODE, v["value"])
    return literal(v["value"], v.get("datatype"), v.get("xml:lang"))


PARSERS: dict[str, Callable[[str, str], Iterator[Statement]]] = {"ttl": turtle, "ttlx": turtle, "n3": turtle, "trig": turtle, "rdf": rdf_xml, "xml": rdf_xml, "owl": rdf_xml, "trix": trix, "rj": rdf_json, "srj": construct_json}


def _parse(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term = pa.struct([("kind", pa.int8()), ("lex", pa.string()), ("dt", pa.string()), ("lang", pa.string())])
        schema = pa.schema([*((n, term) for n in "spog"), ("st", pa.int8())])
        cell = lambda t: None if t is None else {"kind": t.kind, "lex": t.lex, "dt": t.dt, "lang": t.lang}
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                # The names of a GraphML file are its own, not relative to its place.
                text = content.decode()
                for q in PARSERS[kind](text) if kind == "graphml" else PARSERS[kind](text, path):
                    rows.append({n: cell(t) for n, t in zip("spog", q, strict=True)} | {"st": EXPLICIT})
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_rdf(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Quads of a file, or of a folder or pattern of files, of the format its ending says."""
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("nt", "nq", "ntx"):
        return read_lines(spark, path)
    if kind not in PARSERS:
        raise ValueError(f"unknown format {kind}")
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_parse(kind), f"s {TERM_DDL}, p {TERM_DDL}, o {TERM_DDL}, g {TERM_DDL}, st tinyint")


# --- writers

_term = lambda c: Val(F.col(c))


def statement_lines(quads: DataFrame) -> DataFrame:
    """One N-Quads line (N-Triples where there is no graph) for each statement, as ``value``."""
    graph = F.when(F.col("g").isNotNull(), F.concat(F.lit(" "), n3(_term("g")))).otherwise("") if "g" in quads.columns else F.lit("")
    return quads.select(F.concat(n3(_term("s")), F.lit(" "), n3(_term("p")), F.lit(" "), n3(_term("o")), graph, F.lit(" .")).alias("value"))


def _xml(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def _json(v: Val, bnode_prefix: bool = False) -> Column:
    """A term of the JSON formats."""
    c = v.term()
    prefix = F.when(c["kind"] == BNODE, "_:").otherwise("") if bnode_prefix else F.lit("")
    kind = F.when(c["kind"] == IRI, "uri").when(c["kind"] == BNODE, "bnode").when(c["kind"] == STATEMENT, "sid").otherwise("literal")
    plain = (c["kind"] != LITERAL) | c["lang"].isNotNull() | F.coalesce(c["dt"], F.lit(STRING)).isin(STRING)
    return F.struct(kind.alias("type"), F.concat(prefix, c["lex"]).alias("value"), F.when(~plain, c["dt"]).alias("datatype"), c["lang"].alias("lang"))


def turtle_lines(quads: DataFrame) -> DataFrame:
    """Turtle: a block for each subject."""
    pair = F.concat(n3(_term("p")), F.lit(" "), n3(_term("o")))
    blocks = quads.groupBy(n3(_term("s")).alias("s")).agg(F.array_join(F.array_sort(F.collect_set(pair)), " ;\n    ").alias("body"))
    return blocks.select(F.concat("s", F.lit("\n    "), "body", F.lit(" .")).alias("value"))


def trig_lines(quads: DataFrame) -> DataFrame:
    """TriG: a line for each statement, in its graph."""
    body = F.concat(n3(_term("s")), F.lit(" "), n3(_term("p")), F.lit(" "), n3(_term("o")), F.lit(" ."))
    return quads.select(F.when(F.col("g").isNull(), body).otherwise(F.concat(n3(_term("g")), F.lit(" { "), body, F.lit(" }"))).alias("value"))


def rdf_xml_lines(quads: DataFrame) -> DataFrame:
    """RDF/XML descriptions, one for each statement (the root element goes around them)."""
    p = F.col("p.lex")
    local = F.regexp_extract(p, r"([A-Za-z_][\w.-]*)$", 1)
    space = F.substring(p, F.lit(1), F.length(p) - F.length(local))
    subject = F.when(F.col("s.kind") == BNODE, F.concat(F.lit('rdf:nodeID="'), F.col("s.lex"))).otherwise(F.concat(F.lit('rdf:about="'), _xml(F.col("s.lex"))))
    o = F.col("o")
    value = (
        F.when(o["kind"] == IRI, F.concat(F.lit(' rdf:resource="'), _xml(o["lex"]), F.lit('"/>')))
        .when(o["kind"] == BNODE, F.concat(F.lit(' rdf:nodeID="'), o["lex"], F.lit('"/>')))
        .otherwise(F.concat(F.when(o["lang"].isNotNull(), F.concat(F.lit(' xml:lang="'), o["lang"], F.lit('"'))).when(o["dt"] != STRING, F.concat(F.lit(' rdf:datatype="'), _xml(o["dt"]), F.lit('"'))).otherwise(""), F.lit(">"), _xml(o["lex"]), F.lit("</p:"), local, F.lit(">")))
    )
    return quads.select(F.concat(F.lit("<rdf:Description "), subject, F.lit('"><p:'), local, F.lit(' xmlns:p="'), _xml(space), F.lit('"'), value, F.lit("</rdf:Description>")).alias("value"))


def trix_lines(quads: DataFrame) -> DataFrame:
    """TriX graphs, one for each statement (the root element goes around them)."""

    def term(c: str) -> Column:
        t = F.col(c)
        typed = F.concat(F.lit('<typedLiteral datatype="'), _xml(F.coalesce(t["dt"], F.lit(STRING))), F.lit('">'), _xml(t["lex"]), F.lit("</typedLiteral>"))
        tagged = F.concat(F.lit('<plainLiteral xml:lang="'), t["lang"], F.lit('">'), _xml(t["lex"]), F.lit("</plainLiteral>"))
        return F.when(t["kind"] == IRI, F.concat(F.lit("<uri>"), _xml(t["lex"]), F.lit("</uri>"))).when(t["kind"] == BNODE, F.concat(F.lit("<id>"), t["lex"], F.lit("</id>"))).when(t["lang"].isNotNull(), tagged).otherwise(typed)

    graph = F.coalesce(term("g"), F.lit("")) if "g" in quads.columns else F.lit("")
    return quads.select(F.concat(F.lit("<graph>"), graph, F.lit("<triple>"), term("s"), term("p"), term("o"), F.lit("</triple></graph>")).alias("value"))


def json_lines(quads: DataFrame) -> DataFrame:
    """RDF/JSON members, one for each subject: a key, a colon and its object."""
    s = F.concat(F.when(F.col("s.kind") == BNODE, "_:").otherwise(""), F.col("s.lex"))
    values = quads.groupBy(s.alias("s"), F.col("p.lex").alias("p")).agg(F.array_sort(F.collect_set(_json(_term("o"), True))).alias("v"))
    whole = values.groupBy("s").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "v")))).alias("m"))
    return whole.select(F.to_json(F.map_from_arrays(F.array("s"), F.array("m"))).alias("value"))


def json_ld_lines(quads: DataFrame) -> DataFrame:
    """Expanded JSON-LD node objects, one for each subject and predicate."""
    name = lambda c: F.concat(F.when(F.col(f"{c}.kind") == BNODE, "_:").otherwise(""), F.col(f"{c}.lex"))
    o = F.col("o")
    value = F.when(o["kind"] == LITERAL, F.struct(F.lit(None).cast("string").alias("@id"), o["lex"].alias("@value"), F.when(o["lang"].isNull() & (o["dt"] != STRING), o["dt"]).alias("@type"), o["lang"].alias("@language"))).otherwise(F.struct(name("o").alias("@id"), F.lit(None).cast("string").alias("@value"), F.lit(None).cast("string").alias("@type"), F.lit(None).cast("string").alias("@language")))
    rows = quads.groupBy(name("s").alias("s"), F.col("p.lex").alias("p")).agg(F.array_sort(F.collect_set(value)).alias("v"))
    inner = F.to_json(F.map_from_arrays(F.array("p"), F.array("v")))
    return rows.select(F.concat(F.lit('{"@id":'), F.get(F.split(F.to_json(F.array("s")), r"^\["), F.lit(1)).substr(F.lit(1), F.length(F.to_json(F.array("s"))) - 2), F.lit(","), F.substring(inner, F.lit(2), F.length(inner))).alias("value"))


def construct_json_lines(quads: DataFrame) -> DataFrame:
    """Statements as bindings of the JSON result format (subject, predicate, object, context)."""
    names = [("s", "subject"), ("p", "predicate"), ("o", "object"), *([("g", "context")] if "g" in quads.columns else [])]
    return result_json(quads.select(*(F.col(c).alias(n) for c, n in names)))


WRITERS: dict[str, Callable[[DataFrame], DataFrame]] = {"nt": statement_lines, "nq": statement_lines, "ttl": turtle_lines, "n3": turtle_lines, "trig": trig_lines, "rdf": rdf_xml_lines, "trix": trix_lines, "rj": json_lines, "jsonld": json_ld_lines, "srj": construct_json_lines}


def write_rdf(quads: DataFrame, path: str, kind: str) -> None:
    """Writes quads as text files of a format; XML and JSON parts are lines to be wrapped by ``wrapped``."""
    WRITERS[kind](quads).write.mode("overwrite").text(path)


def wrapped(kind: str, lines: list[str]) -> str:
    """A whole document of some lines of a format that has a frame."""
    body = "\n".join(lines)
    if kind == "rdf":
        return f'<?xml version="1.0"?>\n<rdf:RDF xmlns:rdf="{RDF}">\n{body}\n</rdf:RDF>'
    if kind == "trix":
        return f'<?xml version="1.0"?>\n<TriX xmlns="http://www.w3.org/2004/03/trix/trix-1/">\n{body}\n</TriX>'
    if kind == "srj":
        return '{"head":{"vars":["subject","predicate","object","context"]},"results":{"bindings":[' + ",".join(lines) + "]}}"
    if kind == "rj":
        return "{" + ",".join(x[1:-1] for x in lines) + "}"
    return "[" + ",\n".join(lines) + "]" if kind == "jsonld" else body


# --- results


def result_json(df: DataFrame) -> DataFrame:
    """A JSON binding for each solution of term columns."""
    entries = [F.struct(F.lit(c).alias("key"), _json(Val(F.col(f"`{c}`"))).alias("value")) for c in df.columns]
    bound = F.filter(F.array(*entries), lambda e: e["value"]["value"].isNotNull())
    return df.select(F.regexp_replace(F.to_json(F.map_from_entries(bound)), '"lang":', '"xml:lang":').alias("value"))


def result_xml(df: DataFrame) -> DataFrame:
    """An XML result for each solution of term columns."""

    def one(c: str) -> Column:
        t = F.col(f"`{c}`")
        lit = F.concat(F.lit("<literal"), F.when(t["lang"].isNotNull(), F.concat(F.lit(' xml:lang="'), t["lang"], F.lit('"'))).when(t["dt"] != STRING, F.concat(F.lit(' datatype="'), _xml(t["dt"]), F.lit('"'))).otherwise(""), F.lit(">"), _xml(t["lex"]), F.lit("</literal>"))
        term = F.when(t["kind"] == IRI, F.concat(F.lit("<uri>"), _xml(t["lex"]), F.lit("</uri>"))).when(t["kind"] == BNODE, F.concat(F.lit("<bnode>"), t["lex"], F.lit("</bnode>"))).otherwise(lit)
        return F.coalesce(F.concat(F.lit(f'<binding name="{c}">'), term, F.lit("</binding>")), F.lit(""))

    return df.select(F.concat(F.lit("<result>"), *(one(c) for c in df.columns), F.lit("</result>")).alias("value"))


def result_table(df: DataFrame, separator: str = ",") -> DataFrame:
    """A CSV or TSV line for each solution of term columns; TSV has full terms, CSV lexical forms."""

    def one(c: str) -> Column:
        v = Val(F.col(f"`{c}`"))
        if separator == "\t":
            return F.coalesce(n3(v), F.lit(""))
        lex = F.concat(F.when(v.kind() == BNODE, "_:").otherwise(""), v.lex())
        quoted = F.concat(F.lit('"'), F.replace(lex, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.coalesce(F.when(lex.rlike('[",\r\n]'), quoted).otherwise(lex), F.lit(""))

    return df.select(F.concat_ws(separator, *(one(c) for c in df.columns)).alias("value"))


def boolean_result(value: bool, kind: str = "json") -> str:
    """A truth value as a JSON, XML or text result."""
    text = str(value).lower()
    return {"json": f'{{"head":{{}},"boolean":{text}}}', "xml": f'<?xml version="1.0"?>\n<sparql xmlns="http://www.w3.org/2005/sparql-results#"><head/><boolean>{text}</boolean></sparql>', "text": text}[kind]


def read_result_json(spark: SparkSession, text: str) -> DataFrame:
    """Solutions of a JSON result, as terms."""
    from .graphs import constants

    found = json.loads(text)
    names = found["head"]["vars"]
    rows = [[json_term(b[n]) if n in b else None for n in names] for b in found["results"]["bindings"]]
    s = constants(spark, names, rows)
    return s.df.select(*(s.val(n).term().alias(n) for n in names))


def read_result_xml(spark: SparkSession, text: str) -> DataFrame:
    """Solutions of an XML result, as terms."""
    from .graphs import constants

    bare = lambda e: e.tag.rsplit("}", 1)[-1]
    root = ET.fromstring(text)
    names = [e.get("name") for e in root.iter() if bare(e) == "variable"]
    rows = []
    for e in root.iter():
        if bare(e) == "result":
            row: dict[str, Term] = {}
            for b in e:
                t = b[0]
                value = t.text or ""
                row[b.get("name")] = iri(value) if bare(t) == "uri" else Term(BNODE, value) if bare(t) == "bnode" else literal(value, t.get("datatype"), t.get(f"{{{_XML}}}lang"))
            rows.append([row.get(n) for n in names])
    s = constants(spark, names, rows)
    return s.df.select(*(s.val(n).term().alias(n) for n in names))


# --- property graphs


def graphml(text: str, base: str = "urn:x-graph:") -> Iterator[Statement]:
    """GraphML: nodes and edges as resources, edges also as statements between nodes, data as literals."""
    bare = lambda e: e.tag.rsplit("}", 1)[-1]
    root = ET.fromstring(text)
    kinds = {e.get("id"): (e.get("attr.name"), e.get("attr.type", "string")) for e in root.iter() if bare(e) == "key"}
    to_xsd = {"int": "int", "long": "long", "float": "float", "double": "double", "boolean": "boolean"}

    def data(s: Term, e: ET.Element) -> Iterator[Statement]:
        for d in e:
            if bare(d) == "data":
                name, kind = kinds.get(d.get("key"), (d.get("key"), "string"))
                yield s, iri(base + name), literal(d.text or "", XSD + to_xsd[kind] if kind in to_xsd else None), None

    for e in root.iter():
        s = iri(base + (e.get("id") or ""))
        if bare(e) == "node":
            yield s, iri(RDF + "type"), iri(base + "Vertex"), None
            yield from data(s, e)
        elif bare(e) == "edge":
            a, b = iri(base + e.get("source")), iri(base + e.get("target"))
            label = iri(base + (e.get("label") or "edge"))
            yield a, label, b, None
            if e.get("id"):
                yield s, iri(RDF + "type"), iri(base + "Edge"), None
                yield s, iri(base + "from"), a, None
                yield s, iri(base + "to"), b, None
                yield s, iri(base + "label"), literal(label.lex.removeprefix(base)), None
                yield from data(s, e)


PARSERS["graphml"] = graphml
