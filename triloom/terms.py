"""RDF terms: in Python, as Spark structs, and as statically typed columns.

A solution's variable is one column.  Where its type is known when the query is
planned (it comes from a table column, or a function's result), the column is a
native Spark column and comparisons, joins and aggregates stay native.  Where it
is not, the column is a term struct (kind, lex, dt, lang).  Unbound is NULL, and
so is the error of an expression.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"

#: Kinds, in the order that ORDER BY gives them; unbound (NULL) comes first.
BNODE, STATEMENT, IRI, LITERAL = 1, 2, 3, 4

TERM = T.StructType([T.StructField("kind", T.ByteType()), T.StructField("lex", T.StringType()), T.StructField("dt", T.StringType()), T.StructField("lang", T.StringType())])
TERM_DDL = "struct<kind:tinyint,lex:string,dt:string,lang:string>"

INTEGERS = ["integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte"]
#: Promotion ranks of numeric datatypes.
RANK = {XSD + n: 1 for n in INTEGERS} | {XSD + "decimal": 2, XSD + "float": 3, XSD + "double": 4}
OF_RANK = {1: XSD + "integer", 2: XSD + "decimal", 3: XSD + "float", 4: XSD + "double"}
STRING, BOOLEAN, DATETIME, DATE, LANGSTRING = XSD + "string", XSD + "boolean", XSD + "dateTime", XSD + "date", RDF + "langString"
DECIMAL = "decimal(38,12)"


@dataclass(frozen=True, order=True)
class Term:
    """A constant RDF term."""

    kind: int
    lex: str
    dt: str | None = None
    lang: str | None = None

    def n3(self) -> str:
        """As N-Triples."""
        if self.kind == IRI:
            return f"<{self.lex}>"
        if self.kind == BNODE:
            return f"_:{self.lex}"
        if self.kind == STATEMENT:
            return self.lex
        quoted = '"' + self.lex.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'
        if self.lang:
            return f"{quoted}@{self.lang}"
        return quoted if self.dt in (None, STRING) else f"{quoted}^^<{self.dt}>"


def iri(lex: str) -> Term:
    return Term(IRI, lex)


def literal(lex: object, dt: str | None = None, lang: str | None = None) -> Term:
    """A literal from a Python value."""
    if dt is None and lang is None:
        if isinstance(lex, bool):
            return Term(LITERAL, str(lex).lower(), BOOLEAN)
        if isinstance(lex, int):
            return Term(LITERAL, str(lex), XSD + "integer")
        if isinstance(lex, float):
            return Term(LITERAL, repr(lex), XSD + "double")
    return Term(LITERAL, str(lex), LANGSTRING if lang else dt or STRING, lang)


def null_term() -> Column:
    return F.lit(None).cast(TERM_DDL)


def make_term(kind: Column | int, lex: Column, dt: Column | str | None = None, lang: Column | str | None = None) -> Column:
    """A term struct; NULL where lex is NULL."""
    put = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
    made = F.struct(put(kind, "tinyint").alias("kind"), lex.cast("string").alias("lex"), put(dt, "string").alias("dt"), put(lang, "string").alias("lang"))
    return F.when(lex.isNotNull(), made)


def constant(term: Term) -> Column:
    return make_term(term.kind, F.lit(term.lex), term.dt, term.lang)


def plain_number(x: Column) -> Column:
    """A decimal without needless zeros."""
    text = x.cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


@dataclass(frozen=True)
class Val:
    """A column with what is known of its type.

    form: ``term`` (a struct), ``iri``, ``bnode`` or ``literal``.  An IRI column
    may hold a key that ``prefix`` goes before.  dt is a literal's datatype.
    """

    col: Column
    form: str = "term"
    dt: str | None = None
    prefix: str | None = None
    lang: str | None = None

    def type_key(self) -> tuple:
        """Equal for values whose native columns can be compared for identity."""
        return (self.form, self.dt, self.prefix, self.lang)

    def on(self, col: Column) -> Val:
        return replace(self, col=col)

    @property
    def rank(self) -> int | None:
        return RANK.get(self.dt) if self.form == "literal" else None

    @property
    def is_string(self) -> bool:
        return self.form == "literal" and self.dt in (STRING, LANGSTRING)

    # --- accessors; each is NULL where the value is unbound or of another sort

    def lex(self) -> Column:
        """The lexical form of any term."""
        if self.form == "term":
            return self.col["lex"]
        if self.prefix is not None:
            return F.concat(F.lit(self.prefix), self.col.cast("string"))
        if self.dt == DATETIME:
            return F.date_format(self.col, "yyyy-MM-dd'T'HH:mm:ss")
        if self.rank == 2:
            return plain_number(self.col)
        return self.col.cast("string")

    def term(self) -> Column:
        """As a term struct."""
        if self.form == "term":
            return self.col
        kind = {"iri": IRI, "bnode": BNODE, "literal": LITERAL}[self.form]
        return make_term(kind, self.lex(), self.dt, self.lang)

    def kind(self) -> Column:
        if self.form == "term":
            return self.col["kind"].cast("int")
        return F.when(self.col.isNotNull(), F.lit({"iri": IRI, "bnode": BNODE, "literal": LITERAL}[self.form]))

    def datatype(self) -> Column:
        """The datatype IRI of a literal."""
        if self.form == "term":
            return F.when(self.col["kind"] == LITERAL, F.coalesce(self.col["dt"], F.lit(STRING)))
        return F.when(self.col.isNotNull(), F.lit(self.dt)) if self.form == "literal" else F.lit(None).cast("string")

    def language(self) -> Column:
        if self.form == "term":
            return F.when(self.col["kind"] == LITERAL, F.coalesce(self.col["lang"], F.lit("")))
        return F.when(self.col.isNotNull(), F.lit(self.lang or "")) if self.form == "literal" else F.lit(None).cast("string")

    def rank_col(self) -> Column:
        """The numeric rank, NULL where not numeric."""
        if self.form != "term":
            return F.when(self.col.isNotNull(), F.lit(self.rank))
        dt = self.col["dt"]
        return F.when(dt.isin([d for d, r in RANK.items() if r == 1]), 1).when(dt == XSD + "decimal", 2).when(dt == XSD + "float", 3).when(dt == XSD + "double", 4)

    def number(self) -> Column:
        """As a double, NULL where not numeric."""
        if self.form == "term":
            return F.when(self.rank_col().isNotNull(), self.col["lex"].try_cast("double"))
        return self.col.cast("double") if self.rank else F.lit(None).cast("double")

    def exact(self) -> Column:
        """As a decimal, NULL where not integer or decimal."""
        if self.form == "term":
            return F.when(self.rank_col() <= 2, self.col["lex"].try_cast(DECIMAL))
        return self.col.try_cast(DECIMAL) if self.rank else F.lit(None).cast(DECIMAL)

    def text(self) -> Column:
        """The text of a plain, string or language-tagged literal; NULL for others."""
        if self.form == "term":
            return F.when((self.col["kind"] == LITERAL) & F.coalesce(self.col["dt"], F.lit(STRING)).isin(STRING, LANGSTRING), self.col["lex"])
        return self.col if self.is_string else F.lit(None).cast("string")

    def timestamp(self) -> Column:
        if self.form == "term":
            return F.when(self.col["dt"].isin(DATETIME, DATE), F.try_to_timestamp(self.col["lex"]))
        return self.col.cast("timestamp") if self.dt in (DATETIME, DATE) else F.lit(None).cast("timestamp")

    def boolean(self) -> Column:
        if self.form == "term":
            return F.when(self.col["dt"] == BOOLEAN, F.when(self.col["lex"].isin("true", "1"), True).when(self.col["lex"].isin("false", "0"), False))
        return self.col if self.dt == BOOLEAN else F.lit(None).cast("boolean")

    def ebv(self) -> Column:
        """The effective boolean value; NULL where there is none."""
        if self.form == "literal":
            if self.dt == BOOLEAN:
                return self.col
            if self.is_string:
                return F.length(self.col) > 0
            if self.rank:
                return (self.col != 0) & ~F.isnan(self.col.cast("double"))
        if self.form != "term":
            return F.lit(None).cast("boolean")
        n = self.number()
        return F.coalesce(self.boolean(), F.length(self.text()) > 0, (n != 0) & ~F.isnan(n), F.when(self.rank_col().isNotNull() | (self.col["dt"] == BOOLEAN), False))

    def order_keys(self) -> list[Column]:
        """Columns whose ascending order, nulls first, is the SPARQL order."""
        if self.form != "term":
            return [self.col]
        dt = self.datatype()
        numeric, stamp, flag = self.number(), self.timestamp(), self.boolean()
        group = F.when(self.text().isNotNull(), 0).when(flag.isNotNull(), 1).when(numeric.isNotNull(), 2).when(stamp.isNotNull(), 3).otherwise(4)
        return [self.kind(), F.when(self.kind() == LITERAL, group), flag, numeric, stamp, F.when(group == 4, dt), self.col["lex"], self.col["lang"]]

    def order_key(self) -> Column:
        """One column with the order of ``order_keys``."""
        keys = self.order_keys()
        return keys[0] if len(keys) == 1 else F.struct(*(k.alias(f"k{n}") for n, k in enumerate(keys)))


def of_constant(term: Term) -> Val:
    """A constant as a typed value."""
    if term.kind == IRI:
        return Val(F.lit(term.lex), "iri")
    if term.kind != LITERAL:
        return Val(constant(term))
    dt = term.dt or STRING
    if term.lang:
        return Val(F.lit(term.lex), "literal", LANGSTRING, lang=term.lang)
    try:
        if dt == BOOLEAN and term.lex in ("true", "false", "0", "1"):
            return Val(F.lit(term.lex in ("true", "1")), "literal", dt)
        if RANK.get(dt) == 1 and abs(int(term.lex)) < 2**63:
            return Val(F.lit(int(term.lex)).cast("long"), "literal", dt)
        if RANK.get(dt) == 2:
            return Val(F.lit(term.lex).cast(DECIMAL), "literal", dt)
        if RANK.get(dt) in (3, 4):
            return Val(F.lit(float(term.lex.replace("INF", "inf"))), "literal", dt)
    except ValueError:
        return Val(constant(term))
    if dt == STRING:
        return Val(F.lit(term.lex), "literal", dt)
    if dt == DATETIME:
        return Val(F.try_to_timestamp(F.lit(term.lex)), "literal", dt)
    if dt == DATE:
        return Val(F.lit(term.lex).try_cast("date"), "literal", dt)
    return Val(constant(term))
