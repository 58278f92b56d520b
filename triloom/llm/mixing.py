"""Mixing sources to target weights, in DataFrame functions only.

Documents count as tokens of a cell: source, language and topic.  Iterative
proportional fitting rakes the cells' weights to target marginals of all three.
Each document is then kept with a probability calibrated so that the expected
tokens are a given part of all: the raked weight of its cell over the tokens
there, scaled, and never over one.  The draw is a hash of the id, so it is the
same whenever and wherever it is made.

Only cells go through the rounds, one row for each combination that occurs; they
stay a distributed table, written after each round.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

#: Topics by the first pattern that a text matches.
TOPICS = [
    ("legal", "(?i)all rights reserved|copyright|licen[sc]e"),
    ("contact", r"[A-Za-z0-9]@[A-Za-z0-9]|\+[0-9][0-9 ().-]{7}"),
    ("table", r" \| |\t"),
    ("noise", r"!!|\?\?|\*\*\*|###|\$\$\$|%%%"),
]
OTHER, NONE = "prose", "(none)"
DIMENSIONS = ("source", "lang", "topic")
#: Cells that may be broadcast; their number is checked.
SMALL = 20_000
WORD = r"[^\x20\x09-\x0D]++"


@dataclass
class Mixture:
    """Targets are shares proportional to tokens to the power ``tempers[dimension]``; or as given in ``targets``."""

    tempers: dict[str, float] = field(default_factory=lambda: {"source": 0.5, "lang": 0.7, "topic": 0.8})
    targets: dict[str, dict[str, float]] = field(default_factory=dict)
    #: Expected part of all tokens.
    part: float = 0.5
    rounds: int = 12
    calibrations: int = 12
    seed: str = "mix"


def topic_of(text: Column) -> Column:
    """The first topic whose pattern occurs."""
    out = F.lit(OTHER)
    for name, pattern in reversed(TOPICS):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the hash of a key."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2**48))


def measured(docs: DataFrame, id_col: str, text_col: str, topic_col: str | None, keep: list[str]) -> DataFrame:
    """``row`` (a struct of the ``keep`` columns) with key, cell and n_tokens of each document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    topic = named(topic_col) if topic_col else topic_of(text)
    count = F.regexp_count(text, F.lit(WORD)).cast("long")
    return docs.select(F.struct(*keep).alias("row"), F.col(id_col).alias("key"), named("source").alias("source"), named("lang").alias("lang"), topic.alias("topic"), count.alias("n_tokens"))


def _targets(cells: DataFrame, mixture: Mixture, dimension: str) -> DataFrame:
    given = mixture.targets.get(dimension)
    if given:
        rows = cells.sparkSession.createDataFrame(list(given.items()), f"{dimension} string, target double")
        rows = cells.select(dimension).distinct().join(rows, dimension, "left").fillna(0.0, ["target"])
    else:
        rows = cells.groupBy(dimension).agg(F.pow(F.sum("tokens"), F.lit(mixture.tempers[dimension])).alias("target"))
    rows = written(rows)
    whole = rows.agg(F.sum("target")).first()[0] or 1.0
    return rows.select(dimension, (F.col("target") / F.lit(whole)).alias("target"))


def raked(cells: DataFrame, mixture: Mixture) -> DataFrame:
    """(source, lang, topic, tokens) with weight: shares whose marginals are the targets.

    After the last round the topic marginal is exact and the others as near as
    the rounds brought them; cells without tokens have no weight.  A step sums the
    weights of each value of a dimension in a window over cells: one row for each
    combination, however many documents are in it.
    """
    cells = cells.where("tokens > 0")
    whole = cells.agg(F.sum("tokens")).first()[0] or 1
    now = cells.withColumn("weight", F.col("tokens") / F.lit(whole))
    for d in DIMENSIONS:
        now = now.join(_targets(cells, mixture, d).withColumnRenamed("target", f"{d}_target"), d)
    now = written(now)
    for k in range(mixture.rounds):
        for d in DIMENSIONS:
            own = F.sum("weight").over(Window.partitionBy(d))
            now = now.withColumn("weight", F.col("weight") * F.col(f"{d}_target") / own)
        if k % 4 == 3:
            now = written(now)
    return now.select(*DIMENSIONS, "tokens", "weight")


def calibrated(cells: DataFrame, mixture: Mixture) -> DataFrame:
    """Raked cells with probability: proportional to weight over tokens, at most one, expecting the part wanted."""
    rate = F.col("weight") / F.col("tokens")
    cells = written(cells.withColumn("rate", rate))
    tokens = cells.agg(F.sum("tokens")).first()[0] or 0
    scale, capped = 0.0, -1
    for _ in range(mixture.calibrations):
        over = F.col("rate") * F.lit(scale) >= 1
        full, free, count = cells.agg(F.sum(F.when(over, F.col("tokens")).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.sum(F.when(over, 1).otherwise(0))).first()
        if not free or count == capped:
            break
        scale, capped = max(0.0, mixture.part * tokens - full) / free, count
    return cells.withColumn("probability", F.least(F.lit(1.0), F.col("rate") * F.lit(scale))).drop("rate")


def _drawn(rows: DataFrame, mixture: Mixture) -> DataFrame:
    """Measured rows, written, with probability and kept."""
    cells = written(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")))
    odds = written(calibrated(raked(cells, mixture), mixture).select(*DIMENSIONS, "probability"))
    if odds.count() <= SMALL:
        odds = F.broadcast(odds)
    chance = F.when(F.col("n_tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(F.lit(0.0))
    return rows.join(odds, list(DIMENSIONS), "left").select("row", *DIMENSIONS, "n_tokens", chance.alias("probability"), (uniform(F.col("key"), mixture.seed) < chance).alias("kept"))


def probabilities(docs: DataFrame, mixture: Mixture | None = None, id_col: str = "doc_id", text_col: str = "text", topic_col: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``row`` (a struct of the id and the ``keep`` columns), source, lang, topic, n_tokens, probability and kept.

    Tokens are runs of non-white-space.  The topic is a column, or the first of
    ``TOPICS`` whose pattern matches.  A null source, language or topic is
    the class ``(none)`` of its own; a null or empty text has no tokens and is
    never kept.  Rows that share an id share their draw.  An empty table gives an
    empty table.  Texts are read once.
    """
    return _drawn(written(measured(docs, id_col, text_col, topic_col, [id_col, *(c for c in keep if c != id_col)])), mixture or Mixture())


def mixed(docs: DataFrame, mixture: Mixture | None = None, id_col: str = "doc_id", text_col: str = "text", topic_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` that are kept, with the same columns.

    Nulls, empty texts, rows that share an id and empty tables are treated as
    in ``probabilities``; repeated rows stay or go together.  Texts are read once:
    rows are written with their measures, and those drawn are taken from there.
    """
    return _drawn(written(measured(docs, id_col, text_col, topic_col, docs.columns)), mixture or Mixture()).where("kept").select("row.*")
