"""Expressions as Spark columns.

An error is NULL, as an unbound variable is; SQL's AND and OR with NULL then
follow the three-valued table, and a filter keeps rows that are true.  Casts and
arithmetic use the forms that give NULL instead of failing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.algebra import Call, Exists, Quoted, Var
from ..terms import BNODE, BOOLEAN, DATE, DATETIME, DECIMAL, IRI, LANGSTRING, LITERAL, OF_RANK, RANK, STATEMENT, STRING, XSD, Term, Val, constant, make_term, null_term, of_constant, plain_number

Builder = Callable[..., Val]
#: Functions by IRI, added with ``register``.
CUSTOM: dict[str, Builder] = {}
#: Aggregates by IRI: a function of (Val) that gives a Val over a group.
CUSTOM_AGGREGATES: dict[str, Builder] = {}


def register(name: str, build: Builder) -> None:
    """Makes a function of values callable by its IRI; a scalar Spark UDF can be wrapped so."""
    CUSTOM[name] = build


def register_aggregate(name: str, build: Builder) -> None:
    CUSTOM_AGGREGATES[name] = build


def boolean(col: Column) -> Val:
    return Val(col, "literal", BOOLEAN)


def integer(col: Column) -> Val:
    return Val(col.cast("long"), "literal", XSD + "integer")


def string(col: Column) -> Val:
    return Val(col, "literal", STRING)


def unbound() -> Val:
    return Val(null_term())


class Evaluator:
    """Builds columns for expressions over the variables of one row."""

    def __init__(self, variables: dict[str, Val], exists: Callable[[Exists], Column] | None = None, computed: dict[int, Val] | None = None, hints: dict[str, str] | None = None):
        self.variables = variables
        self.exists = exists
        self.computed = computed or {}
        self.hints = hints or {}

    def val(self, e: object) -> Val:
        """The value of an expression."""
        if id(e) in self.computed:
            return self.computed[id(e)]
        if isinstance(e, Var):
            return self.variables.get(e.name) or unbound()
        if isinstance(e, Term):
            return of_constant(e)
        if isinstance(e, Quoted):
            return self.quoted(*(self.val(x) for x in (e.s, e.p, e.o)))
        if isinstance(e, Exists):
            if self.exists is None:
                raise ValueError("EXISTS is only known in filters")
            return boolean(self.exists(e))
        if not isinstance(e, Call):
            raise TypeError(f"not an expression: {e!r}")
        if e.name in CUSTOM:
            return CUSTOM[e.name](*(self.val(a) for a in e.args))
        if e.name.startswith(XSD):
            return cast(self.val(e.args[0]), e.name)
        special = {"&&": self.both, "||": self.either, "BOUND": self.bound, "COALESCE": self.coalesce, "IF": self.choose, "IN": self.member, "NOT IN": self.not_member, "REGEX": self.regex}.get(e.name)
        if special:
            return special(e.args)
        if e.name not in FUNCTIONS:
            raise ValueError(f"unknown function {e.name}")
        if e.name in ("TZ", "TIMEZONE", "STR"):
            # A constant keeps its zone in its lexical form only.
            return FUNCTIONS[e.name](*(Val(constant(a)) if isinstance(a, Term) and a.dt == DATETIME else self.val(a) for a in e.args))
        return FUNCTIONS[e.name](*(self.val(a) for a in e.args))

    def ebv(self, e: object) -> Column:
        return self.val(e).ebv()

    def quoted(self, s: Val, p: Val, o: Val) -> Val:
        return Val(make_term(STATEMENT, F.concat(F.lit("<<"), n3(s), F.lit(" "), n3(p), F.lit(" "), n3(o), F.lit(">>"))))

    def both(self, args: list) -> Val:
        return boolean(self.ebv(args[0]) & self.ebv(args[1]))

    def either(self, args: list) -> Val:
        return boolean(self.ebv(args[0]) | self.ebv(args[1]))

    def bound(self, args: list) -> Val:
        return boolean(self.val(args[0]).col.isNotNull())

    def coalesce(self, args: list) -> Val:
        known = [a for a in args if not (isinstance(a, Var) and a.name not in self.variables)]
        return merged([self.val(a) for a in known or args], lambda cols: F.coalesce(*cols))

    def choose(self, args: list) -> Val:
        test = self.ebv(args[0])
        return merged([self.val(a) for a in args[1:]], lambda cols: F.when(test, cols[0]).when(~test, cols[1]))

    def member(self, args: list) -> Val:
        first = self.val(args[0])
        return boolean(reduce(lambda a, b: a | b, (equal(first, self.val(a)) for a in args[1:]), F.lit(False)))

    def not_member(self, args: list) -> Val:
        return boolean(~self.member(args).col)

    def regex(self, args: list) -> Val:
        value = self.val(args[0])
        loose = self.hints.get("regexMatchNonString", "").lower() == "true"
        text = F.when(value.kind() == LITERAL, value.lex()) if loose else value.text()
        return boolean(F.regexp(text, flagged(self.val(args[1]).text(), self.val(args[2]).text() if len(args) > 2 else None)))


def merged(values: list[Val], pick: Callable[[list[Column]], Column]) -> Val:
    """One of several values, typed if all have one type."""
    if values[0].form != "term" and all(v.type_key() == values[0].type_key() for v in values):
        return values[0].on(pick([v.col for v in values]))
    return Val(pick([v.term() for v in values]))


def n3(v: Val) -> Column:
    """The N-Triples form of a value."""
    lex = v.lex()
    quoted = F.concat(F.lit('"'), reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")), lex), F.lit('"'))
    tail = F.when(v.language() != "", F.concat(F.lit("@"), v.language())).when(v.datatype() != STRING, F.concat(F.lit("^^<"), v.datatype(), F.lit(">"))).otherwise("")
    return F.when(v.kind() == IRI, F.concat(F.lit("<"), lex, F.lit(">"))).when(v.kind() == BNODE, F.concat(F.lit("_:"), lex)).when(v.kind() == STATEMENT, lex).otherwise(F.concat(quoted, tail))


def flagged(pattern: Column, flags: Column | None) -> Column:
    """A regular expression with flags s, m, i (of all cases), x and q put in front."""
    if flags is None:
        return pattern
    java = F.regexp_replace(F.regexp_replace(flags, "[^smix]", ""), "i", "iu")
    quoted = F.concat(F.lit("\\Q"), pattern, F.lit("\\E"))
    body = F.when(flags.contains("q"), quoted).otherwise(pattern)
    return F.when(F.length(java) > 0, F.concat(F.lit("(?"), java, F.lit(")"), body)).otherwise(body)


# --- comparison


def same_term(a: Val, b: Val) -> Column:
    """Identity of terms."""
    if a.type_key() == b.type_key():
        return a.col == b.col
    return (a.kind() == b.kind()) & (a.lex() == b.lex()) & (F.coalesce(a.datatype(), F.lit("")) == F.coalesce(b.datatype(), F.lit(""))) & (F.lower(F.coalesce(a.language(), F.lit(""))) == F.lower(F.coalesce(b.language(), F.lit(""))))


def equal(a: Val, b: Val) -> Column:
    """Equality of values; terms that aren't literals by identity, literals of unlike unknown types an error."""
    if a.rank and b.rank:
        return a.col == b.col
    if a.form == b.form != "term" and (a.form != "literal" or a.type_key() == b.type_key()):
        return a.col == b.col if a.prefix == b.prefix else a.lex() == b.lex()
    if a.form != "term" and b.form != "term" and a.form != b.form:
        return F.when(a.col.isNotNull() & b.col.isNotNull(), False)
    numbers = F.coalesce(a.exact() == b.exact(), a.number() == b.number())
    same = same_term(a, b)
    literals = (a.kind() == LITERAL) & (b.kind() == LITERAL)
    known = lambda v: F.coalesce(v.text().isNotNull(), F.lit(False)) | v.number().isNotNull() | v.boolean().isNotNull() | v.timestamp().isNotNull()
    # Unlike literals: false where both are of known types, else an error.
    return F.coalesce(numbers, a.boolean() == b.boolean(), a.timestamp() == b.timestamp(), F.when(same, True).when(~literals, False).when(known(a) & known(b), False))


def _compare(op: str) -> Builder:
    apply: dict[str, Callable[[Column, Column], Column]] = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}
    how = apply[op]

    def build(a: Val, b: Val) -> Val:
        if a.rank and b.rank or a.form == b.form == "literal" and a.type_key() == b.type_key():
            return boolean(how(a.col, b.col))
        if a.form == "literal" and a.rank or b.form == "literal" and b.rank:
            return boolean(how(a.number(), b.number()))
        return boolean(F.coalesce(how(a.exact(), b.exact()), how(a.number(), b.number()), how(a.text(), b.text()), how(a.timestamp(), b.timestamp()), how(a.boolean(), b.boolean())))

    return build


# --- arithmetic


def number_val(rank: Column, exact: Column, double: Column) -> Val:
    """A number whose datatype is known at run time only."""
    lex = F.when(rank == 1, exact.cast("decimal(38,0)").cast("string")).when(rank == 2, plain_number(exact)).when(rank == 3, double.cast("float").cast("string")).otherwise(double.cast("string"))
    dt = F.when(rank == 1, OF_RANK[1]).when(rank == 2, OF_RANK[2]).when(rank == 3, OF_RANK[3]).otherwise(OF_RANK[4])
    return Val(F.when(rank.isNotNull(), make_term(LITERAL, lex, dt)))


def _arithmetic(op: str) -> Builder:
    how = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[op]

    def build(a: Val, b: Val) -> Val:
        if op == "-" and a.dt == b.dt == DATETIME:
            return Val(F.timestamp_diff("SECOND", b.col, a.col), "literal", XSD + "integer")
        if a.rank and b.rank:
            rank = max(a.rank, b.rank, 2 if op == "/" else 1)
            kind = {1: "long", 2: DECIMAL, 3: "float", 4: "double"}[rank]
            return Val(how(a.col.cast(kind), b.col.cast(kind)).cast(kind), "literal", OF_RANK[rank])
        rank = F.when(a.rank_col().isNotNull() & b.rank_col().isNotNull(), F.greatest(a.rank_col(), b.rank_col(), F.lit(2 if op == "/" else 1)))
        return number_val(rank, F.when(rank <= 2, how(a.exact(), b.exact()).cast(DECIMAL)), how(a.number(), b.number()))

    return build


def _rounding(how: Callable[[Column], Column]) -> Builder:
    """Whole numbers stay as they are; others keep their datatype."""

    def build(a: Val) -> Val:
        if a.rank == 1:
            return a
        if a.rank:
            return a.on(how(a.col).cast({2: DECIMAL, 3: "float", 4: "double"}[a.rank]))
        return number_val(a.rank_col(), F.when(a.rank_col() == 1, a.exact()).otherwise(how(a.exact())).cast(DECIMAL), how(a.number()))

    return build


def _abs(a: Val) -> Val:
    return a.on(F.abs(a.col)) if a.rank else number_val(a.rank_col(), F.abs(a.exact()), F.abs(a.number()))


def _negated(a: Val) -> Val:
    return a.on(-a.col) if a.rank else number_val(a.rank_col(), -a.exact(), -a.number())


# --- strings


def like(a: Val, text: Column) -> Val:
    """A text with the language or datatype of another."""
    if a.form != "term":
        return a.on(text) if a.is_string else string(text)
    return Val(make_term(LITERAL, text, a.datatype(), a.col["lang"]))


def _paired(how: Callable[[Column, Column], Column]) -> Builder:
    """A test of two texts whose languages agree (the second may have none)."""

    def build(a: Val, b: Val) -> Val:
        found = how(a.text(), b.text())
        if a.form == b.form == "literal" and (b.lang is None or a.lang == b.lang):
            return boolean(found)
        return boolean(F.when((b.language() == "") | (a.language() == b.language()), found))

    return build


def _substr(a: Val, start: Val, length: Val | None = None) -> Val:
    """One-based; start and length are rounded, and a start before the first character is the first."""
    first = F.floor(start.number() + 0.5)
    begin = F.greatest(first, F.lit(1)).cast("int")
    if length is None:
        return like(a, F.substring(a.text(), begin, F.length(a.text())))
    size = F.greatest(F.floor(length.number() + 0.5), F.lit(0)).cast("int")
    return like(a, F.substring(a.text(), begin, size))


def _position(a: Val, b: Val) -> Column:
    return F.position(b.text(), a.text())


def _str_before(a: Val, b: Val) -> Val:
    at = _position(a, b)
    return _found(a, at, F.substring(a.text(), F.lit(1), at - 1))


def _str_after(a: Val, b: Val) -> Val:
    at = _position(a, b)
    return _found(a, at, F.substring(a.text(), at + F.length(b.text()), F.length(a.text())))


def _found(a: Val, at: Column, text: Column) -> Val:
    if a.form == "literal" and not a.lang:
        return string(F.when(at > 0, text).otherwise(F.when(at.isNotNull(), "")))
    return Val(F.when(at > 0, like(a, text).term()).when(at == 0, string(F.lit("")).term()))


def _concat(*args: Val) -> Val:
    if not args:
        return string(F.lit(""))
    text = F.concat(*(a.text() for a in args))
    if all(a.form == "literal" and a.lang == args[0].lang and a.is_string for a in args):
        return args[0].on(text)
    if all(a.form == "literal" for a in args):
        return string(text)
    lang = reduce(lambda x, y: F.when(x == y, x).otherwise(""), (a.language() for a in args))
    return Val(make_term(LITERAL, text, F.when(lang == "", STRING).otherwise(LANGSTRING), F.when(lang != "", lang)))


def _replace(a: Val, pattern: Val, by: Val, flags: Val | None = None) -> Val:
    return like(a, F.regexp_replace(a.text(), flagged(pattern.text(), flags.text() if flags else None), by.text()))


def _encode(a: Val) -> Val:
    return string(F.replace(F.replace(F.replace(F.url_encode(a.text()), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")))


def _str(a: Val) -> Val:
    return string(F.when(a.kind() != BNODE, a.lex()) if a.form == "term" else a.lex())


def _langmatches(a: Val, b: Val) -> Val:
    tag, want = F.lower(a.text()), F.lower(b.text())
    return boolean(F.when(want == "*", tag != "").otherwise((tag == want) | tag.startswith(F.concat(want, F.lit("-")))))


def _digest(bits: int) -> Builder:
    return lambda a: string(F.sha2(a.text(), bits))


def _iri(a: Val) -> Val:
    if a.form == "iri":
        return a
    return Val(F.when(a.kind() == IRI, a.lex()).otherwise(a.text()), "iri")


def _strdt(a: Val, b: Val) -> Val:
    return Val(make_term(LITERAL, a.text(), b.lex()))


def _strlang(a: Val, b: Val) -> Val:
    return Val(make_term(LITERAL, a.text(), LANGSTRING, b.text()))


def _bnode(a: Val | None = None) -> Val:
    return Val(F.uuid() if a is None else F.md5(a.text()), "bnode")


def _datatype(a: Val) -> Val:
    return Val(a.datatype(), "iri")


# --- dates


def _part(how: Callable[[Column], Column]) -> Builder:
    return lambda a: integer(how(a.timestamp()))


_ZONE = r"(Z|[+-][0-9]{2}:[0-9]{2})$"


def _tz(a: Val) -> Val:
    if a.form != "term":
        return string(F.when(a.timestamp().isNotNull(), ""))
    return string(F.when(a.timestamp().isNotNull(), F.regexp_extract(a.lex(), _ZONE, 1)))


def _timezone(a: Val) -> Val:
    zone = _tz(a).col
    hour, minute = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 5, 2).try_cast("int")
    text = F.concat(F.when(zone.startswith("-"), "-").otherwise(""), F.lit("PT"), F.when(hour > 0, F.concat(hour.cast("string"), F.lit("H"))).otherwise(""), F.when(minute > 0, F.concat(minute.cast("string"), F.lit("M"))).otherwise(""))
    return Val(F.when(zone == "Z", "PT0S").when(zone.isin("+00:00", "-00:00"), "PT0S").when(zone != "", text), "literal", XSD + "dayTimeDuration")


def _seconds(a: Val) -> Val:
    stamp = a.timestamp()
    return Val((F.unix_micros(stamp) % 60_000_000 / F.lit(1_000_000)).cast(DECIMAL), "literal", XSD + "decimal")


# --- casts


def cast(a: Val, dt: str) -> Val:
    """A cast; NULL where it fails."""
    lex = F.when(a.kind() != BNODE, F.trim(a.lex())) if a.form == "term" else a.lex()
    flag = a.boolean()
    if dt == STRING:
        return string(F.when(a.kind() != BNODE, a.lex()) if a.form == "term" else a.lex())
    if dt == BOOLEAN:
        n = a.number()
        return boolean(F.coalesce(flag, (n != 0) & ~F.isnan(n), F.when(lex.isin("true", "1"), True).when(lex.isin("false", "0"), False)))
    if dt in RANK:
        kind = {1: "long", 2: DECIMAL, 3: "float", 4: "double"}[RANK[dt]]
        if dt == XSD + "unsignedLong":
            kind = "decimal(20,0)"
        if a.rank:
            return Val(a.col.try_cast(kind), "literal", dt)
        if RANK[dt] == 1:
            number = F.coalesce(F.when(lex.rlike(r"^[+-]?[0-9]+$"), lex.try_cast(kind)), F.when(a.rank_col().isNotNull(), a.number().try_cast(kind)))
        else:
            number = lex.try_cast(kind)
        return Val(F.coalesce(flag.cast("int").cast(kind), number), "literal", dt)
    if dt == DATETIME:
        return Val(a.col.cast("timestamp"), "literal", dt) if a.dt in (DATE, DATETIME) else Val(F.try_to_timestamp(lex), "literal", dt)
    if dt == DATE:
        return Val(a.timestamp().cast("date"), "literal", dt) if a.dt in (DATE, DATETIME) else Val(F.try_to_timestamp(lex).cast("date"), "literal", dt)
    return Val(make_term(LITERAL, lex, dt))


def _is(*kinds: int) -> Builder:
    def build(a: Val) -> Val:
        return boolean(a.kind().isin(*kinds))

    return build


FUNCTIONS: dict[str, Builder] = {
    "!": lambda a: boolean(~a.ebv()), "=": lambda a, b: boolean(equal(a, b)), "!=": lambda a, b: boolean(~equal(a, b)), "<": _compare("<"), ">": _compare(">"), "<=": _compare("<="), ">=": _compare(">="),
    "+": _arithmetic("+"), "-": _arithmetic("-"), "*": _arithmetic("*"), "/": _arithmetic("/"), "neg": _negated,
    "SAMETERM": lambda a, b: boolean(same_term(a, b)), "ISIRI": _is(IRI), "ISBLANK": _is(BNODE), "ISLITERAL": _is(LITERAL), "ISNUMERIC": lambda a: boolean(F.when(a.col.isNotNull(), a.number().isNotNull())),
    "STR": _str, "LANG": lambda a: string(a.language()), "LANGMATCHES": _langmatches, "DATATYPE": _datatype, "IRI": _iri, "BNODE": _bnode, "STRDT": _strdt, "STRLANG": _strlang,
    "UUID": lambda: Val(F.concat(F.lit("urn:uuid:"), F.uuid()), "iri"), "STRUUID": lambda: string(F.uuid()),
    "STRLEN": lambda a: integer(F.length(a.text())), "UCASE": lambda a: like(a, F.upper(a.text())), "LCASE": lambda a: like(a, F.lower(a.text())), "CONCAT": _concat, "SUBSTR": _substr, "REPLACE": _replace, "ENCODE_FOR_URI": _encode,
    "CONTAINS": _paired(lambda a, b: a.contains(b)), "STRSTARTS": _paired(lambda a, b: a.startswith(b)), "STRENDS": _paired(lambda a, b: a.endswith(b)), "STRBEFORE": _str_before, "STRAFTER": _str_after,
    "MD5": lambda a: string(F.md5(a.text())), "SHA1": lambda a: string(F.sha1(a.text())), "SHA224": _digest(224), "SHA256": _digest(256), "SHA384": _digest(384), "SHA512": _digest(512),
    "ABS": _abs, "CEIL": _rounding(F.ceil), "FLOOR": _rounding(F.floor), "ROUND": _rounding(lambda x: F.floor(x + F.lit(0.5))), "RAND": lambda: Val(F.rand(), "literal", XSD + "double"), "NOW": lambda: Val(F.current_timestamp(), "literal", DATETIME),
    "YEAR": _part(F.year), "MONTH": _part(F.month), "DAY": _part(F.dayofmonth), "HOURS": _part(F.hour), "MINUTES": _part(F.minute), "SECONDS": _seconds, "TZ": _tz, "TIMEZONE": _timezone, "DATE": lambda a: Val(a.timestamp().cast("date"), "literal", DATE),
}


# --- aggregates


def aggregate(call: Call, arg: Val | None) -> Val:
    """An aggregate over a group; errors among inputs void SUM and AVG, unbound inputs are left out."""
    if call.name in CUSTOM_AGGREGATES:
        return CUSTOM_AGGREGATES[call.name](arg)
    if call.name == "COUNT":
        if arg is None:
            return integer(F.count(F.lit(1)))
        return integer(F.count_distinct(arg.col) if call.distinct else F.count(arg.col))
    if call.name in ("SUM", "AVG"):
        return _total(call, arg)
    if call.name in ("MIN", "MAX"):
        if arg.form != "term":
            return arg.on(F.min(arg.col) if call.name == "MIN" else F.max(arg.col))
        return Val((F.min_by if call.name == "MIN" else F.max_by)(arg.col, F.when(arg.col.isNotNull(), arg.order_key())))
    if call.name == "SAMPLE":
        return arg.on(F.any_value(arg.col, True))
    if call.name == "GROUP_CONCAT":
        text = arg.lex()
        gathered = F.collect_set(text) if call.distinct else F.collect_list(text)
        return string(F.array_join(F.array_sort(gathered), " " if call.separator is None else call.separator))
    raise ValueError(f"unknown aggregate {call.name}")


def _total(call: Call, arg: Val) -> Val:
    mean = call.name == "AVG"
    if arg.rank:
        if call.distinct:
            total, n = F.sum_distinct(arg.col), F.count_distinct(arg.col)
        else:
            total, n = F.sum(arg.col), F.count(arg.col)
        if not mean:
            kind = {1: "long", 2: DECIMAL, 3: "double", 4: "double"}[arg.rank]
            return Val(F.coalesce(total.cast(kind), F.lit(0).cast(kind)), "literal", XSD + "integer" if arg.rank == 1 else arg.dt)
        value = F.coalesce(F.try_divide(total.cast("double"), n), F.lit(0.0))
        return Val(value, "literal", XSD + ("decimal" if arg.rank <= 2 else "double"))
    number, exact = arg.number(), arg.exact()
    if call.distinct:
        distinct = F.collect_set(F.struct(arg.col["lex"], number.alias("n"), exact.alias("e")))
        number = F.aggregate(F.transform(distinct, lambda x: x["n"]), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
        exact, n = number.cast(DECIMAL), F.size(distinct)
    else:
        number, exact, n = F.sum(number), F.sum(exact), F.count(number)
    broken = F.max(F.when(arg.col.isNotNull(), F.when(arg.number().isNull(), 1).otherwise(0)))
    rank = F.coalesce(F.max(arg.rank_col()), F.lit(1))
    if mean:
        rank = F.greatest(rank, F.lit(2))
        number, exact = F.try_divide(number, n), F.try_divide(exact, n)
    zero = number_val(F.lit(1), F.lit(0).cast(DECIMAL), F.lit(0.0)).col
    value = number_val(rank, F.coalesce(exact, F.lit(0)).cast(DECIMAL), F.coalesce(number, F.lit(0.0))).col
    return Val(F.when(F.coalesce(broken, F.lit(0)) == 0, F.when(n > 0, value).otherwise(zero)))
