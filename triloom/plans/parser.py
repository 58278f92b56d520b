"""SPARQL 1.1 queries and updates, with the engine's extensions, as algebra.

Extensions: named subqueries (``WITH { ... } AS %name``, ``INCLUDE %name``),
quoted statements (``<< s p o >>``), ``LET (?v := expr)``, query hints
(triples whose predicate is in the hint namespace), solution-set targets
(``INSERT INTO %name``), and the entailment commands.
"""

from __future__ import annotations

import re
from urllib.parse import urljoin

from ..terms import BNODE, RDF, XSD, Term, iri, literal
from .algebra import Bind, Call, Exists, Filter, GraphPattern, Group, Include, Minus, Optional, Path, Quad, Query, Quoted, Service, SubSelect, Triple, Union, Update, Values, Var

#: Namespace of query hints; a declared namespace that ends in ``queryHints#`` counts as well.
HINTS = "urn:triloom:queryHints#"
_HINT = re.compile(r"^.*[/:]queryHints#")
_TOKEN = re.compile(
    r"""
    (?P<space>\s+|\#[^\n\r]*)
  | (?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
  | (?P<var>[?$][\w·À-￿]+)
  | (?P<set>%[\w-]+)
  | (?P<string>\"\"\"(?:(?:"|"")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*'''|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
  | (?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<number>(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|\d*\.\d+|\d+)
  | (?P<blank>_:[\w·À-￿]+(?:[\w·À-￿.-]*[\w·À-￿-])?)
  | (?P<name>(?:[A-Za-zÀ-￿][\wÀ-￿]*(?:[\w.·À-￿-]*[\w·À-￿-])?)?:(?:(?:[\w:À-￿]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])(?:(?:[\w.:·À-￿-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%])*(?:[\w:·À-￿-]|%[0-9A-Fa-f]{2}|\\[_~.\-!$&'()*+,;=/?\#@%]))?)?)
  | (?P<word>[A-Za-z_][A-Za-z0-9_]*)
  | (?P<op>\^\^|&&|\|\||!=|<=|>=|<<|>>|:=|[{}()\[\].,;=<>!+\-*/|^?])
    """,
    re.X | re.S,
)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}

#: Built-in functions by name; the value is the least and greatest number of arguments.
BUILTINS = {
    "STR": (1, 1), "LANG": (1, 1), "LANGMATCHES": (2, 2), "DATATYPE": (1, 1), "BOUND": (1, 1), "IRI": (1, 1), "URI": (1, 1), "BNODE": (0, 1), "RAND": (0, 0), "ABS": (1, 1), "CEIL": (1, 1), "FLOOR": (1, 1), "ROUND": (1, 1),
    "CONCAT": (0, 99), "STRLEN": (1, 1), "UCASE": (1, 1), "LCASE": (1, 1), "ENCODE_FOR_URI": (1, 1), "CONTAINS": (2, 2), "STRSTARTS": (2, 2), "STRENDS": (2, 2), "STRBEFORE": (2, 2), "STRAFTER": (2, 2), "YEAR": (1, 1), "MONTH": (1, 1), "DAY": (1, 1),
    "HOURS": (1, 1), "MINUTES": (1, 1), "SECONDS": (1, 1), "TIMEZONE": (1, 1), "TZ": (1, 1), "DATE": (1, 1), "NOW": (0, 0), "UUID": (0, 0), "STRUUID": (0, 0), "MD5": (1, 1), "SHA1": (1, 1), "SHA224": (1, 1), "SHA256": (1, 1), "SHA384": (1, 1), "SHA512": (1, 1),
    "COALESCE": (1, 99), "IF": (3, 3), "STRLANG": (2, 2), "STRDT": (2, 2), "SAMETERM": (2, 2), "ISIRI": (1, 1), "ISURI": (1, 1), "ISBLANK": (1, 1), "ISLITERAL": (1, 1), "ISNUMERIC": (1, 1), "REGEX": (2, 3), "SUBSTR": (2, 3), "REPLACE": (3, 4),
}
AGGREGATES = {"COUNT", "SUM", "MIN", "MAX", "AVG", "SAMPLE", "GROUP_CONCAT"}


class SyntaxFault(ValueError):
    """A query that can't be parsed."""


def unescape(text: str) -> str:
    """String escapes resolved."""

    def one(m: re.Match) -> str:
        if m[1]:
            return chr(int(m[1][1:], 16))
        if m[2] not in _ESCAPES:
            raise SyntaxFault(f"bad escape \\{m[2]}")
        return _ESCAPES[m[2]]

    return re.sub(r"\\(?:(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})|(.))", one, text, flags=re.S)


class Parser:
    """A recursive-descent parser over the tokens of one text."""

    def __init__(self, text: str, prefixes: dict[str, str] | None = None, base: str = ""):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SyntaxFault(f"unexpected {text[at : at + 20]!r}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at = 0
        self.prefixes = {"rdf": RDF, "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "xsd": XSD, "owl": "http://www.w3.org/2002/07/owl#", "hint": HINTS, **(prefixes or {})}
        self.base = base
        self.fresh = 0
        self.blank_terms = False
        self.extra: list[Triple] = []

    # --- tokens

    @property
    def kind(self) -> str:
        return self.tokens[self.at][0]

    @property
    def text(self) -> str:
        return self.tokens[self.at][1]

    def next(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1][1]

    def is_op(self, *ops: str) -> bool:
        return self.kind == "op" and self.text in ops

    def take(self, *ops: str) -> str | None:
        return self.next() if self.is_op(*ops) else None

    def need(self, op: str) -> None:
        # << and >> are one token; as comparison or IRI ends they never stand where a single one is needed.
        if not self.take(op):
            raise SyntaxFault(f"{op!r} expected, not {self.text!r}")

    def is_word(self, *words: str) -> bool:
        return self.kind == "word" and self.text.upper() in words

    def word(self, *words: str) -> str | None:
        return self.next().upper() if self.is_word(*words) else None

    def need_word(self, *words: str) -> str:
        found = self.word(*words)
        if not found:
            raise SyntaxFault(f"{' or '.join(words)} expected, not {self.text!r}")
        return found

    # --- terms

    def prologue(self) -> None:
        while True:
            if self.word("BASE"):
                self.base = urljoin(self.base, self.next()[1:-1])
            elif self.word("PREFIX"):
                name = self.next()
                self.prefixes[name.removesuffix(":")] = self.iri_ref()
            else:
                return

    def iri_ref(self) -> str:
        if self.kind != "iri":
            raise SyntaxFault(f"IRI expected, not {self.text!r}")
        lex = unescape(self.next()[1:-1])
        return urljoin(self.base, lex) if self.base and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", lex) else lex

    def iri(self) -> Term:
        if self.kind == "iri":
            return iri(self.iri_ref())
        if self.kind != "name":
            raise SyntaxFault(f"IRI expected, not {self.text!r}")
        prefix, _, local = self.next().partition(":")
        if prefix not in self.prefixes:
            raise SyntaxFault(f"unknown prefix {prefix!r}")
        return iri(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))

    def blank(self, label: str | None = None) -> object:
        if label is None:
            self.fresh += 1
            label = f"anon{self.fresh}"
        return Term(BNODE, label) if self.blank_terms else Var(f" {label}")

    def literal(self) -> Term:
        if self.kind == "number":
            lex = self.next()
            return Term(4, lex, XSD + ("double" if "e" in lex.lower() else "decimal" if "." in lex else "integer"))
        raw = self.next()
        width = 3 if raw[:3] in ('"""', "'''") else 1
        lex = unescape(raw[width:-width])
        if self.kind == "lang":
            return literal(lex, lang=self.next()[1:])
        if self.take("^^"):
            return literal(lex, self.iri().lex)
        return literal(lex)

    def signed(self) -> Term | None:
        if self.is_op("+", "-") and self.tokens[self.at + 1][0] == "number":
            sign = self.next()
            n = self.literal()
            return Term(4, n.lex if sign == "+" else "-" + n.lex, n.dt)
        return None

    def term(self) -> object:
        """A variable or term, without property lists."""
        if self.kind == "var":
            return Var(self.next()[1:])
        if self.kind in ("iri", "name"):
            return self.iri()
        if self.kind in ("string", "number"):
            return self.literal()
        if self.is_word("TRUE", "FALSE"):
            return literal(self.next().lower(), XSD + "boolean")
        if self.kind == "blank":
            return self.blank(self.next()[2:])
        if found := self.signed():
            return found
        if self.take("<<"):
            s, p, o = self.term(), self.verb_term(), self.term()
            self.need(">>")
            return Quoted(s, p, o)
        if self.is_op("[") and self.tokens[self.at + 1][1] == "]":
            self.at += 2
            return self.blank()
        raise SyntaxFault(f"term expected, not {self.text!r}")

    def verb_term(self) -> object:
        if self.kind == "word" and self.text == "a":
            self.next()
            return iri(RDF + "type")
        return self.term()

    # --- triples

    def node(self) -> object:
        """A subject or object; triples of its property list or collection go to ``extra``."""
        if self.take("["):
            if self.take("]"):
                return self.blank()
            node = self.blank()
            self.properties(node)
            self.need("]")
            return node
        if self.take("("):
            items = []
            while not self.take(")"):
                items.append(self.node())
            rest: object = iri(RDF + "nil")
            for item in reversed(items):
                cell = self.blank()
                self.extra += [Triple(cell, iri(RDF + "first"), item), Triple(cell, iri(RDF + "rest"), rest)]
                rest = cell
            return rest
        return self.term()

    def properties(self, subject: object) -> None:
        while True:
            if self.is_op(".", "]", "}", ";") or self.kind == "end":
                pass
            else:
                verb = self.path() if not (self.kind == "var") else self.term()
                while True:
                    self.extra.append(Triple(subject, verb, self.node()))
                    if not self.take(","):
                        break
            if not self.take(";"):
                return

    def triples(self) -> list[Triple]:
        """One subject with its properties."""
        outer, self.extra = self.extra, []
        begun = self.is_op("[", "(")
        subject = self.node()
        if not (begun and (self.is_op(".", "}") or self.kind == "end")):
            self.properties(subject)
        found, self.extra = self.extra, outer
        return found

    # --- paths

    def path(self) -> object:
        parts = [self.path_sequence()]
        while self.take("|"):
            parts.append(self.path_sequence())
        return parts[0] if len(parts) == 1 else Path("|", tuple(parts))

    def path_sequence(self) -> object:
        parts = [self.path_element()]
        while self.take("/"):
            parts.append(self.path_element())
        return parts[0] if len(parts) == 1 else Path("/", tuple(parts))

    def path_element(self) -> object:
        if self.take("^"):
            return Path("^", (self.path_element(),))
        if self.take("("):
            inner = self.path()
            self.need(")")
        elif self.take("!"):
            inner = self.negated()
        elif self.kind == "word" and self.text == "a":
            self.next()
            inner = iri(RDF + "type")
        else:
            inner = self.iri()
        if op := self.take("*", "+", "?"):
            low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}[op]
            return Path("rep", (inner,), low, high)
        if self.is_op("{") and self.tokens[self.at + 1][0] in ("number",) or self.is_op("{") and self.tokens[self.at + 1][1] == ",":
            self.next()
            low = int(self.next()) if self.kind == "number" else 0
            high: int | None = low
            if self.take(","):
                high = int(self.next()) if self.kind == "number" else None
            self.need("}")
            return Path("rep", (inner,), low, high)
        return inner

    def negated(self) -> Path:
        def one() -> tuple[Term, bool]:
            inverse = bool(self.take("^"))
            if self.kind == "word" and self.text == "a":
                self.next()
                return iri(RDF + "type"), inverse
            return self.iri(), inverse

        if not self.take("("):
            return Path("!", (one(),))
        parts = []
        while not self.take(")"):
            parts.append(one())
            self.take("|")
        return Path("!", tuple(parts))

    # --- groups

    def group(self) -> Group:
        self.need("{")
        out = Group()
        if self.is_word("SELECT"):
            out.parts.append(SubSelect(self.select()))
            self.need("}")
            return out
        while not self.take("}"):
            if self.take("."):
                continue
            if self.word("OPTIONAL"):
                out.parts.append(Optional(self.group()))
            elif self.word("MINUS"):
                out.parts.append(Minus(self.group()))
            elif self.word("FILTER"):
                out.parts.append(Filter(self.constraint()))
            elif self.is_word("BIND", "LET"):
                out.parts.append(self.bind())
            elif self.word("VALUES", "BINDINGS"):
                out.parts.append(self.values())
            elif self.word("GRAPH"):
                name = self.term()
                out.parts.append(GraphPattern(name, self.group()))
            elif self.word("SERVICE"):
                silent = bool(self.word("SILENT"))
                name = self.term()
                out.parts.append(Service(name, self.group(), silent))
            elif self.word("INCLUDE"):
                out.parts.append(Include(self.next()))
            elif self.is_op("{"):
                groups = [self.group()]
                while self.word("UNION"):
                    groups.append(self.group())
                out.parts.append(Union(groups) if len(groups) > 1 else groups[0])
            else:
                self.add_triples(out)
        return out

    def add_triples(self, out: Group) -> None:
        for t in self.triples():
            if isinstance(t.p, Term) and _HINT.match(t.p.lex):
                name, value = _HINT.sub("", t.p.lex), t.o.lex if isinstance(t.o, Term) else ""
                last = next((x for x in reversed(out.parts) if isinstance(x, Triple)), None)
                if isinstance(t.s, Term) and t.s.lex.endswith("#Prior") and last:
                    last.hints[name] = value
                else:
                    out.hints[name] = value
            else:
                out.parts.append(t)

    def bind(self) -> Bind:
        let = self.need_word("BIND", "LET") == "LET"
        self.need("(")
        if let:
            var = Var(self.next()[1:])
            self.need(":=")
            found = Bind(self.expression(), var)
        else:
            expr = self.expression()
            self.need_word("AS")
            found = Bind(expr, Var(self.next()[1:]))
        self.need(")")
        return found

    def values(self) -> Values:
        names, one = [], self.kind == "var"
        if one:
            names.append(Var(self.next()[1:]))
        else:
            self.need("(")
            while not self.take(")"):
                names.append(Var(self.next()[1:]))
        rows = []
        self.need("{")
        while not self.take("}"):
            if one:
                rows.append([self.value()])
                continue
            self.need("(")
            row = []
            while not self.take(")"):
                row.append(self.value())
            if len(row) != len(names):
                raise SyntaxFault("as many values as variables expected")
            rows.append(row)
        return Values(names, rows)

    def value(self) -> Term | None:
        return None if self.word("UNDEF") else self.term()

    # --- expressions

    def constraint(self) -> object:
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        return self.primary()

    def expression(self) -> object:
        e = self.conjunction()
        while self.take("||"):
            e = Call("||", [e, self.conjunction()])
        return e

    def conjunction(self) -> object:
        e = self.relation()
        while self.take("&&"):
            e = Call("&&", [e, self.relation()])
        return e

    def relation(self) -> object:
        e = self.sum()
        if op := self.take("=", "!=", "<", ">", "<=", ">="):
            return Call(op, [e, self.sum()])
        negated = self.is_word("NOT") and self.tokens[self.at + 1][1].upper() == "IN"
        if negated:
            self.next()
        if self.word("IN"):
            return Call("NOT IN" if negated else "IN", [e, *self.arguments()])
        return e

    def sum(self) -> object:
        e = self.product()
        while True:
            if op := self.take("+", "-"):
                e = Call(op, [e, self.product()])
            else:
                return e

    def product(self) -> object:
        e = self.unary()
        while op := self.take("*", "/"):
            e = Call(op, [e, self.unary()])
        return e

    def unary(self) -> object:
        if self.take("!"):
            return Call("!", [self.unary()])
        if found := self.signed():
            return found
        if self.take("-"):
            return Call("neg", [self.unary()])
        self.take("+")
        return self.primary()

    def arguments(self) -> list:
        self.need("(")
        out = []
        while not self.take(")"):
            out.append(self.expression())
            self.take(",")
        return out

    def primary(self) -> object:
        if self.take("("):
            e = self.expression()
            self.need(")")
            return e
        if self.is_word("NOT") and self.tokens[self.at + 1][1].upper() == "EXISTS":
            self.at += 2
            return Exists(self.group(), True)
        if self.word("EXISTS"):
            return Exists(self.group())
        if self.kind == "word" and self.text.upper() in AGGREGATES and self.tokens[self.at + 1][1] == "(":
            return self.aggregate()
        if self.kind == "word" and self.text.upper() in BUILTINS:
            name = self.next().upper()
            args = self.arguments()
            low, high = BUILTINS[name]
            if not low <= len(args) <= high:
                raise SyntaxFault(f"{name} with {len(args)} arguments")
            return Call({"URI": "IRI", "ISURI": "ISIRI"}.get(name, name), args)
        if self.kind in ("iri", "name"):
            name = self.iri()
            if self.is_op("("):
                distinct = self.tokens[self.at + 1][1].upper() == "DISTINCT"
                if distinct:
                    self.tokens.pop(self.at + 1)
                return Call(name.lex, self.arguments(), distinct)
            return name
        return self.term()

    def aggregate(self) -> Call:
        name = self.next().upper()
        self.need("(")
        distinct = bool(self.word("DISTINCT"))
        args = [] if self.take("*") else [self.expression()]
        separator = None
        if self.take(";"):
            self.need_word("SEPARATOR")
            self.need("=")
            separator = self.literal().lex
        self.need(")")
        return Call(name, args, distinct, separator)

    # --- queries

    def query(self) -> Query:
        self.prologue()
        if self.is_word("SELECT"):
            found = self.select(top=True)
        elif self.word("ASK"):
            found = Query("ask", Group())
            self.body(found)
        elif self.word("CONSTRUCT"):
            found = Query("construct", Group())
            template = Group()
            if self.is_op("{"):
                template = self.template()
                found.template = template.parts
                self.body(found)
            else:
                self.datasets(found)
                self.need_word("WHERE")
                found.where = self.group()
                found.template = [t for t in found.where.parts if isinstance(t, Triple)]
                self.modifiers(found)
        elif self.word("DESCRIBE"):
            found = Query("describe", Group())
            while self.kind in ("var", "iri", "name"):
                found.describe.append(self.term())
            if self.take("*"):
                found.describe = []
            self.body(found, optional=True)
        else:
            raise SyntaxFault(f"query expected, not {self.text!r}")
        if self.kind != "end":
            raise SyntaxFault(f"end expected, not {self.text!r}")
        return found

    def template(self) -> Group:
        self.need("{")
        out = Group()
        while not self.take("}"):
            if not self.take("."):
                out.parts += self.triples()
        return out

    def datasets(self, q: Query) -> None:
        while self.word("FROM"):
            (q.named_graphs if self.word("NAMED") else q.default_graphs).append(self.iri())

    def body(self, q: Query, optional: bool = False) -> None:
        self.datasets(q)
        while self.word("WITH"):
            inner = self.group()
            self.need_word("AS")
            sub = inner.parts[0].query if len(inner.parts) == 1 and isinstance(inner.parts[0], SubSelect) else Query("select", inner)
            q.named[self.next()] = sub
        self.word("WHERE")
        if self.is_op("{") or not optional:
            q.where = self.group()
        q.hints |= q.where.hints
        self.modifiers(q)

    def select(self, top: bool = False) -> Query:
        self.need_word("SELECT")
        q = Query("select", Group())
        q.distinct, q.reduced = bool(self.word("DISTINCT")), bool(self.word("REDUCED"))
        if not self.take("*"):
            q.select = []
            while self.kind == "var" or self.is_op("("):
                if self.kind == "var":
                    q.select.append((Var(self.next()[1:]), None))
                else:
                    self.need("(")
                    e = self.expression()
                    self.need_word("AS")
                    q.select.append((Var(self.next()[1:]), e))
                    self.need(")")
                self.take(",")
            if not q.select:
                raise SyntaxFault(f"variables expected, not {self.text!r}")
        if not top:
            self.word("WHERE")
            q.where = self.group()
            q.hints |= q.where.hints
            self.modifiers(q)
        else:
            self.body(q)
        return q

    def modifiers(self, q: Query) -> None:
        if self.word("GROUP"):
            self.need_word("BY")
            while self.kind in ("var", "iri", "name") or self.is_op("(") or self.kind == "word" and self.text.upper() in BUILTINS:
                if self.take("("):
                    e = self.expression()
                    var = Var(self.next()[1:]) if self.word("AS") else None
                    self.need(")")
                    q.group_by.append((e, var))
                else:
                    q.group_by.append((self.primary(), None))
        if self.word("HAVING"):
            while self.is_op("(") or self.kind in ("iri", "name") or self.kind == "word" and self.text.upper() in BUILTINS | dict.fromkeys(AGGREGATES):
                q.having.append(self.constraint())
        if self.word("ORDER"):
            self.need_word("BY")
            while True:
                if way := self.word("ASC", "DESC"):
                    q.order_by.append((self.constraint(), way == "ASC"))
                elif self.kind == "var" or self.is_op("(") or self.kind in ("iri", "name") or self.kind == "word" and self.text.upper() in BUILTINS | dict.fromkeys(AGGREGATES):
                    q.order_by.append((self.constraint(), True))
                else:
                    break
        while way := self.word("LIMIT", "OFFSET"):
            n = int(self.next())
            if way == "LIMIT":
                q.limit = n
            else:
                q.offset = n
        if self.word("VALUES", "BINDINGS"):
            q.values = self.values()

    # --- updates

    def updates(self) -> list[Update]:
        out = []
        while True:
            self.prologue()
            if self.kind == "end":
                return out
            out.append(self.update())
            if not self.take(";") and self.kind != "end":
                raise SyntaxFault(f"; expected, not {self.text!r}")

    def graph_ref(self) -> object:
        if found := self.word("DEFAULT", "NAMED", "ALL"):
            return found
        if self.kind == "set":
            return self.next()
        self.word("GRAPH")
        return self.iri()

    def update(self) -> Update:
        if self.word("LOAD"):
            out = Update("load", silent=bool(self.word("SILENT")), source=self.iri())
            if self.word("INTO"):
                out.target = self.graph_ref()
            return out
        if op := self.word("CLEAR", "DROP", "CREATE"):
            silent = bool(self.word("SILENT"))
            if self.word("ENTAILMENTS"):
                return Update("entailments", source=op)
            return Update(op.lower(), silent=silent, target=self.graph_ref())
        if op := self.word("ENABLE", "DISABLE"):
            self.need_word("ENTAILMENTS")
            return Update("entailments", source=op)
        if op := self.word("ADD", "MOVE", "COPY"):
            silent = bool(self.word("SILENT"))
            source = self.graph_ref()
            self.need_word("TO")
            return Update(op.lower(), source=source, target=self.graph_ref(), silent=silent)
        out = Update("modify")
        if self.word("WITH"):
            out.with_graph = self.iri()
        if self.word("DELETE"):
            if self.word("DATA"):
                return Update("delete-data", delete=self.quads(terms=True))
            if self.is_word("WHERE"):
                self.next()
                at = self.at
                out.delete = self.quads()
                self.at = at
                out.where = self.group()
                return out
            if self.word("FROM"):
                out.into = self.next()
                return self.solution_update(out, "delete-set")
            out.delete = self.quads()
        if self.word("INSERT"):
            if self.word("DATA"):
                return Update("insert-data", insert=self.quads(terms=True))
            if self.word("INTO"):
                out.into = self.next()
                return self.solution_update(out, "insert-set")
            out.insert = self.quads(terms=True, variables=True)
        while self.word("USING"):
            (out.using_named if self.word("NAMED") else out.using).append(self.iri())
        self.need_word("WHERE")
        out.where = self.group()
        return out

    def solution_update(self, out: Update, op: str) -> Update:
        out.op = op
        out.query = self.select(top=True)
        return out

    def quads(self, terms: bool = False, variables: bool = True) -> list[Quad]:
        """Quad data or a quad template."""
        was, self.blank_terms = self.blank_terms, terms
        out: list[Quad] = []
        self.need("{")
        while not self.take("}"):
            if self.take("."):
                continue
            if self.word("GRAPH"):
                g = self.term()
                out += [Quad(t.s, t.p, t.o, g) for t in self.template().parts]
            else:
                out += [Quad(t.s, t.p, t.o) for t in self.triples()]
        self.blank_terms = was
        return out


def parse_query(text: str, prefixes: dict[str, str] | None = None, base: str = "") -> Query:
    return Parser(text, prefixes, base).query()


def parse_update(text: str, prefixes: dict[str, str] | None = None, base: str = "") -> list[Update]:
    return Parser(text, prefixes, base).updates()
