"""Personal data by weak supervision, in DataFrame functions only.

Candidate spans come from regular expressions.  Labelers vote on each: the
regular expression's own validation, gazetteers (top-level domains, card issuer
prefixes, reserved networks, dialling and area codes, names of secrets), context words
before the span, and the span's shape and neighbours.  Expectation-maximisation
over the counts of vote patterns estimates how reliable each labeler is and how
likely each pattern is personal data.  These soft labels train a logistic
classifier of spans, which sees more than the labelers do: length, shares of
digits, the characters on both sides and the word before.  Valid spans of the
four base kinds always stay; the classifier adds others.

What leaves the executors is one count for each vote pattern, and one slope for
each feature and round; both are bounded by kinds and classes, not by the input.
Training runs over distinct combinations of features, which are bounded as well.

Texts are searched once.  Places of matches are found without user code:
``split`` gives the text between matches, whose lengths add up to starts in a
window over the matches of a text, so long texts cost no more than others.
Patterns are possessive and begin only where a run begins or the last match
ended, so they are linear in the text and need no stack, and match as the greedy
forms do.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

_LOCAL = "[A-Za-z0-9._%+-]"
#: Kind, a text that every match holds or None, and the pattern; base kinds first.
PATTERNS = [
    ("email", "@", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", ".", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", None, r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9]){11,}+"),
    ("phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("secret", None, r"(?i)(?<![A-Za-z0-9_])(?:password|passwd|pwd|token|secret|api_?key|access_?key)[\x20]{0,2}[=:][\x20]{0,2}[\x22\x27]?[A-Za-z0-9_/+-]{8,}+[\x22\x27]?"),
    ("local_phone", "-", r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20-][0-9]{3}-[0-9]{4}(?![0-9-])"),
]
KINDS = [k for k, _, _ in PATTERNS]
BASE = 4

#: Gazetteers, in lower case.
DOMAINS = r"^(?:[a-z]{2}|com|org|net|edu|gov|mil|int|info|biz|name|pro|app|dev|cloud|online|example)$"
RESERVED = r"^(?:0|10|127|255)\.|^192\.168\.|^169\.254\.|^172\.(?:1[6-9]|2[0-9]|3[01])\."
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
DIALLING = r"^\+(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
SECRETS = r"(?i)^(?:password|passwd|token|api_?key|secret)"
#: Area codes and exchanges of ten-digit numbers begin with 2 to 9.
AREAS = r"^[2-9][0-9]{2}[2-9]"
#: Words that speak for or against personal data before a span.
FOR = r"(?i)(?:mail|contact|kontakt|correo|courriel|tel|phone|call|anruf|fax|mobil|card|visa|karte|tarjeta|carte|address|adresse|login|user|password|token|ip)[\x20:.=]*$"
AGAINST = r"(?i)(?:version|isbn|issn|order|page|seite|article|section|build|release|doi|no|nr)[\x20:.#=]*$"

LABELERS = ["valid", "gazetteer", "context", "shape"]
#: Chances of the votes +, - and 0 at first, given personal data and given none; how many candidates that counts for, and what share of all: where all candidates look alike, votes alone tell nothing; and the share of personal data among candidates.
START = {
    "valid": {True: (0.75, 0.05, 0.2), False: (0.05, 0.75, 0.2)},
    "gazetteer": {True: (0.7, 0.1, 0.2), False: (0.3, 0.5, 0.2)},
    "context": {True: (0.3, 0.02, 0.68), False: (0.05, 0.3, 0.65)},
    "shape": {True: (0.7, 0.1, 0.2), False: (0.5, 0.3, 0.2)},
}
HELD, SHARE, BALANCE = 20.0, 0.3, 0.5
#: Classes of the word before a span; rounds of training, step size and decay.
WORDS, ROUNDS, RATE, DECAY = 32, 30, 1.0, 1e-3
#: Code points of a block of text that pieces are taken from.
BLOCK = 1024


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    """Whether a match of a base kind counts."""
    count = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind == "card":
        return F.when(count.between(12, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return count.between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit("+")).when(no, F.lit("-")).otherwise(F.lit("0"))


def _votes(kind: str, value: Column, before: Column, after: Column) -> Column:
    """The labelers' votes on a candidate, a sign for each."""
    never = F.lit(False)
    good = _valid(kind, value) if kind in KINDS[:BASE] else None
    valid = F.lit("0") if good is None else _vote(good, ~good)
    known = {
        "email": F.lower(F.substring_index(value, ".", -1)).rlike(DOMAINS),
        "ip": ~value.rlike(RESERVED),
        "card": _digits(value).rlike(ISSUERS),
        "phone": F.regexp_replace(value, r"[\x20().-]", "").rlike(DIALLING),
        "secret": value.rlike(SECRETS),
        "local_phone": _digits(value).rlike(AREAS),
    }.get(kind)
    gazetteer = F.lit("0") if known is None else _vote(known, ~known)
    context = _vote(before.rlike(FOR), before.rlike(AGAINST))
    embedded = before.rlike("[A-Za-z0-9_]$") | after.rlike("^[A-Za-z0-9_]")
    plain = _digits(value).rlike(r"^([0-9])\1*$") if kind not in ("email", "secret") else never
    rich = value.rlike("[0-9].*[0-9].*[0-9]")
    return F.concat(valid, gazetteer, context, _vote(rich & ~embedded & ~plain, embedded | plain))


def _by_kind(make) -> Column:
    """A value that depends on the column ``order``, the number of a kind."""
    out = None
    for n, kind in enumerate(KINDS):
        out = (F if out is None else out).when(F.col("order") == n, make(kind))
    return out


def _character(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", "none").when(c.rlike(r"\s"), "space").when(c.rlike("[0-9]"), "digit").when(c.rlike(r"\p{L}"), "letter").otherwise("sign")


def _features(value: Column, before: Column, after: Column) -> Column:
    """Names of what the classifier sees of a candidate, in places of their own."""
    digits = F.length(_digits(value))
    word = F.lower(F.regexp_extract(before, r"([\p{L}]+)[^\p{L}]*$", 1))
    seen = {
        "long": F.least(F.lit(7), F.floor(F.log2(F.length(value)))),
        "digits": F.floor(digits * 4 / F.length(value)),
        "few": F.least(F.lit(5), F.array_size(F.array_distinct(F.split(_digits(value), "")))),
        "left": _character(F.right(before, F.lit(1))),
        "right": _character(after),
        "word": F.when(word == "", -1).otherwise(F.pmod(F.xxhash64(word), F.lit(WORDS))),
    }
    kind = _by_kind(F.lit)
    votes = [F.concat(kind, F.lit(f" {name} "), F.substring("votes", k + 1, 1)) for k, name in enumerate(LABELERS)]
    return F.array(F.lit("always"), kind, *votes, *(F.concat(F.lit(f"{n} "), x.cast("string")) for n, x in seen.items()), F.concat(kind, F.lit(" left "), seen["left"]), F.concat(kind, F.lit(" right "), seen["right"]))


def _matches(text: Column, order: int, holds: str | None, pattern: str) -> Column:
    """The matches of a kind in order: each with the gap before it and what stands on both sides; null where there is none."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.when(F.contains(text, F.lit(holds)), found) if holds else found

    def one(value: Column, i: Column, pieces: Column) -> Column:
        before, after = F.right(F.get(pieces, i), F.lit(40)), F.left(F.get(pieces, i + 1), F.lit(1))
        return F.struct(F.lit(order).alias("order"), i.alias("i"), value.alias("value"), F.length(F.get(pieces, i)).alias("gap"), before.alias("before"), after.alias("after"))

    # The matches, and the pieces between them, are arrays of one, so that they are made once.
    with_pieces = lambda f: F.flatten(F.transform(F.array(F.split(text, pattern, -1)), lambda pieces: F.transform(f, lambda v, i: one(v, i, pieces))))
    return F.get(F.transform(F.array(found), lambda f: F.when(F.size(f) > 0, with_pieces(f))), F.lit(0))


def candidates(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] | None = None) -> tuple[DataFrame, DataFrame]:
    """Written tables: rows (place, row, some), and candidate spans (place, start, order, kind, end, base, votes, features).

    ``row`` is a struct of the ``keep`` columns, by default all; ``some`` says
    whether the row has candidates.  Of the candidates that aren't valid base
    spans only those are there that overlap none of these.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("place"), F.struct(*(keep or docs.columns)).alias("row"), text.alias("text"))
    found = [_matches(F.col("text"), n, h, p).alias(f"m{n}") for n, (_, h, p) in enumerate(PATTERNS)]
    rows = rows.select("place", "row", *found)
    none = "cast(array() as array<struct<order:int,i:int,value:string,gap:int,before:string,after:string>>)"
    every = F.flatten(F.array(*(F.coalesce(f"m{n}", F.expr(none)) for n in range(len(PATTERNS)))))
    rows = written(rows.select("place", "row", every.alias("every")))
    spans = rows.where(F.size("every") > 0).select("place", F.explode("every").alias("x")).select("place", "x.*").repartition("place")
    before = Window.partitionBy("place", "order").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("value")).over(before).cast("int")
    value, left, right = F.col("value"), F.col("before"), F.col("after")
    valid = F.when(F.col("order") < BASE, _by_kind(lambda k: _valid(k, value))).otherwise(False)
    spans = spans.select("place", (end - F.length("value")).alias("start"), "order", _by_kind(F.lit).alias("kind"), end.alias("end"), valid.alias("base"), _by_kind(lambda k: _votes(k, value, left, right)).alias("votes"), "value", "before", "after")
    # Both frames grow by a row at a time; one that shrinks would cost the square of the spans of a text.
    onward = Window.partitionBy("place").orderBy("start", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    backward = Window.partitionBy("place").orderBy(F.desc("start"), F.desc("order")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(onward)
    ahead = F.min(F.when(F.col("base"), F.col("start"))).over(backward)
    met = (F.coalesce(reach, F.lit(-1)) > F.col("start")) | (F.coalesce(ahead, F.col("end")) < F.col("end"))
    spans = spans.withColumn("met", met).where("base or not met")
    spans = spans.select("place", "start", "order", "kind", "end", "base", F.concat("kind", F.lit(":"), "votes").alias("votes"), _features(value, left, right).alias("features"))
    return rows.select("place", "row", (F.size("every") > 0).alias("some")), written(spans)


class LabelModel:
    """Reliabilities of labelers by expectation-maximisation over counts of vote patterns.

    The balance of the classes is given, as few labelers don't tell it and the
    reliabilities apart.
    """

    def __init__(self, counts: dict[str, int], rounds: int = 50):
        self.counts = counts
        #: For each kind and labeler the chance of each vote given personal data or not.
        self.chance = {(k, j): {t: dict(zip("+-0", START[name][t], strict=True)) for t in (True, False)} for k in KINDS for j, name in enumerate(LABELERS)}
        for _ in range(rounds):
            self._step()

    def posterior(self, pattern: str) -> float:
        """The chance that a candidate with these votes is personal data."""
        kind, votes = pattern.split(":")
        odds = math.log(BALANCE / (1 - BALANCE))
        for j, v in enumerate(votes):
            yes, no = (self.chance[kind, j][truth][v] for truth in (True, False))
            odds += math.log(yes / no)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))

    def _step(self) -> None:
        soft = {p: self.posterior(p) for p in self.counts}
        for kind in KINDS:
            own = {p: n for p, n in self.counts.items() if p.startswith(f"{kind}:")}
            total = sum(own.values())
            for j, name in enumerate(LABELERS):
                for truth in (True, False):
                    held = {v: c * (HELD + SHARE * total) for v, c in zip("+-0", START[name][truth], strict=True)}
                    for p, n in own.items():
                        held[p[len(kind) + 1 + j]] += n * (soft[p] if truth else 1 - soft[p])
                    whole = sum(held.values())
                    self.chance[kind, j][truth] = {v: c / whole for v, c in held.items()}


def _lookup(key: Column, values: dict[str, float]) -> Column:
    """The value of a key; 0 where it isn't known."""
    if not values:
        return F.lit(0.0)
    return F.coalesce(F.create_map(*(F.lit(x) for kv in sorted(values.items()) for x in kv))[key], F.lit(0.0))


def _chance(weights: dict[str, float]) -> Column:
    """What the classifier says of the column ``features``."""
    odds = F.aggregate(F.transform("features", lambda f: _lookup(f, weights)), F.lit(0.0), lambda a, x: a + x)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def train(spans: DataFrame, labels: dict[str, float], rounds: int = ROUNDS) -> dict[str, float]:
    """Weights of features: logistic regression on soft labels of vote patterns, by descent with a step size for each weight.

    Slopes are summed over all candidates; equal ones are one row with a count.
    """
    table = written(spans.groupBy("features", "votes").agg(F.count(F.lit(1)).cast("double").alias("n")).withColumn("label", _lookup(F.col("votes"), labels)).drop("votes"))
    whole = table.agg(F.sum("n")).first()[0]
    weights: dict[str, float] = {}
    speed: dict[str, float] = {}
    for _ in range(rounds if whole else 0):
        error = (F.col("n") * (_chance(weights) - F.col("label"))).cast("decimal(30,9)")
        slopes = table.select(F.explode("features").alias("feature"), error.alias("error")).groupBy("feature").agg(F.sum("error").cast("double").alias("slope")).collect()
        for name, slope in slopes:
            slope = slope / whole + DECAY * weights.get(name, 0.0)
            speed[name] = speed.get(name, 0.0) + slope * slope
            weights[name] = weights.get(name, 0.0) - RATE * slope / (math.sqrt(speed[name]) + 1e-9)
    return weights


def classified(spans: DataFrame, least: float = 0.5) -> DataFrame:
    """The spans that are base spans or that the trained classifier takes for personal data."""
    counts = {r[0]: r[1] for r in spans.groupBy("votes").count().orderBy("votes").collect()}
    model = LabelModel(counts)
    weights = train(spans, {p: model.posterior(p) for p in counts})
    return spans.where(F.col("base") | (_chance(weights) >= least))


def tag(docs: DataFrame, text_col: str = "text", least: float = 0.5, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``row`` (a struct of the ``keep`` columns of ``docs``, by default all) and spans: base spans and those the method adds.

    Spans are structs (start, order, kind, end, base, free) in order of start
    and then kind, in code points, end exclusive; base says that a valid match of
    a base kind was found, and free where the text before the span begins that no
    earlier span covers, null if one overlaps it.  A null text reads as empty and
    has no spans.  All rows take part in the votes, and repeated rows each get
    their spans; an empty table gives an empty table.
    """
    rows, spans = candidates(docs, text_col, keep)
    line = Window.partitionBy("place").orderBy("start", "order").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(line), F.lit(0))
    good = classified(spans, least).withColumn("free", F.when(reach <= F.col("start"), reach))
    lists = good.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("start", "order", "kind", "end", "base", "free"))).alias("spans"))
    kind = lists.schema["spans"].dataType.simpleString()
    none = F.expr(f"cast(array() as {kind})")
    with_spans = rows.where("some").join(lists, "place", "left").select("row", F.coalesce("spans", none).alias("spans"))
    return rows.where("not some").select("row", none.alias("spans")).union(with_spans)


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind; of overlapping spans the first counts, and covers both."""

    def piece(blocks: Column, low: Column, high: Column) -> Column:
        first, last = F.floor(low / BLOCK).cast("int"), F.floor((high - 1) / BLOCK).cast("int")

        def part(k: Column) -> Column:
            begin = F.greatest(low - k * BLOCK, F.lit(0))
            return F.substring(F.get(blocks, k), begin + 1, F.least(high - k * BLOCK, F.lit(BLOCK)) - begin)

        return F.when(high > low, F.array_join(F.transform(F.sequence(first, last), part), "")).otherwise("")

    def whole(blocks: Column) -> Column:
        marks = F.transform(F.filter(spans, lambda x: x["free"].isNotNull()), lambda x: F.concat(piece(blocks, x["free"], x["start"]), F.lit("<"), x["kind"], F.lit(">")))
        return F.concat(F.array_join(marks, ""), piece(blocks, F.array_max(F.transform(spans, lambda x: x["end"])), F.length(text)))

    # Places count from the begin of a block, not of the text, so long texts take no longer.
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.get(F.transform(F.array(blocks), whole), F.lit(0))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the same columns, personal data in the text replaced by ``<kind>``.

    Texts without any are untouched, null ones too; rows keep their number, and
    an empty table gives an empty table.
    """
    found = tag(docs, text_col)
    own = F.col("row")[text_col]
    text = F.when(F.size("spans") > 0, masked(own.cast("string"), F.col("spans"))).otherwise(own)
    return found.select(*(text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
