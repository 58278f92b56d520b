"""A store of quads that can be changed: updates, versions, change log, entailments."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .operators import inference
from .plans.algebra import Quad, Query, Update
from .plans.compiler import instantiate
from .plans.parser import parse_update
from .sources.graphs import EXPLICIT, HISTORY, INFERRED, QUADS_DDL, QuadGraph
from .store import written
from .terms import TERM_DDL, Term, constant

TRIPLES, PROVENANCE, QUADS = "triples", "provenance", "quads"
CHANGES_DDL = f"ts double, action string, s {TERM_DDL}, p {TERM_DDL}, o {TERM_DDL}, g {TERM_DDL}"
_KEY = ["s", "p", "o", "g"]
#: Written parts of a version before they are written as one.
PARTS = 16


def quad_rows(spark: SparkSession, quads: list[tuple[Term, Term, Term, Term | None]]) -> DataFrame:
    """Told quads from constants."""
    if not quads:
        return spark.createDataFrame([], QUADS_DDL)
    rows = [F.struct(*((constant(x) if x else F.lit(None).cast(TERM_DDL)).alias(n) for n, x in zip("spog", (*q, None)[:4], strict=True)), F.lit(EXPLICIT).cast("tinyint").alias("st")) for q in quads]
    return spark.range(1).select(F.inline(F.array(*rows)))


class QuadStore:
    """Quads in versions; each update writes a new version and swaps it in.

    Readers that hold an older version keep it.  With ``history`` removed
    statements stay as history.  Modes: triples (one graph), provenance
    (statements about statements) and quads.
    """

    def __init__(self, spark: SparkSession, quads: DataFrame | None = None, mode: str = QUADS, history: bool = False, entailments: Callable[[DataFrame], DataFrame] | None = None, prefixes: dict[str, str] | None = None):
        self.spark, self.mode, self.history = spark, mode, history
        self.quads = written(quads.select("s", "p", "o", "g", "st")) if quads is not None else spark.createDataFrame([], QUADS_DDL)
        self.changes = spark.createDataFrame([], CHANGES_DDL)
        self.solution_sets: dict[str, DataFrame] = {}
        self.close, self.entailing = entailments or inference.full_closure, False
        self.listeners: list[Callable[[DataFrame], None]] = []
        self.prefixes = prefixes or {}
        self.version, self.parts, self.logged = 0, 1, 0
        self.counts: dict[str, int] = {}
        self._described: tuple[int, dict[Term, DataFrame]] = (0, {})

    # --- reading

    def graph(self) -> QuadGraph:
        return QuadGraph(self.quads, distinct=None if self.mode == QUADS else False, counts=self.counts)

    def engine(self) -> Engine:
        return Engine(self.spark, self.graph(), self.solution_sets, self.prefixes)

    def query(self, text: str, form: str = "n3") -> DataFrame | bool:
        return self.engine().query(text, form)

    def describe(self, resource: Term) -> DataFrame:
        """A resource's description, kept until the next change."""
        if self._described[0] != self.version:
            self._described = (self.version, {})
        kept = self._described[1]
        if resource not in kept:
            kept[resource] = written(self.query(f"DESCRIBE {resource.n3()}"))
        return kept[resource]

    def analyze(self, most: int = 10_000) -> dict[str, int]:
        """Counts the statements of the most frequent predicates; queries order their joins by them from now on."""
        counts = self.quads.groupBy(F.col("p.lex").alias("p")).count().orderBy(F.desc("count"), "p").limit(most)
        self.counts = {r[0]: r[1] for r in counts.collect()}
        return self.counts

    # --- changing

    def update(self, text: str) -> None:
        """Operations one after the other, each on what the last one left."""
        for u in parse_update(text, self.prefixes):
            self.apply(u)

    def apply(self, u: Update) -> None:
        run = getattr(self, "_" + u.op.replace("-", "_"))
        try:
            run(u)
        except Exception:
            if not u.silent:
                raise

    def _commit(self, added: DataFrame | None, removed: DataFrame | None) -> None:
        """Removes, then adds; logs statements that really changed."""
        now = self.quads
        told = now.where(F.col("st").isin(EXPLICIT))
        log = []
        if removed is not None:
            gone = self._keyed(removed).distinct()
            hit = written(self._keyed(told).join(gone, "k", "left_semi").drop("k"))
            log.append(hit.select(F.lit("removed").alias("action"), *_KEY))
            kept = self._keyed(now).join(self._keyed(hit).select("k"), "k", "left_anti").drop("k")
            if self.history:
                kept = kept.union(hit.select(*_KEY, F.lit(HISTORY).cast("tinyint").alias("st")))
            now = kept
        if added is not None:
            fresh = written(self._keyed(added.select(*_KEY)).dropDuplicates(["k"]))
            # The store is scanned past the (usually small) addition, not shuffled for it.
            have = self._keyed(now.where(F.col("st") == EXPLICIT)).join(fresh.select("k"), "k", "left_semi").select("k").distinct()
            fresh = written(fresh.join(have, "k", "left_anti").drop("k"))
            log.append(fresh.select(F.lit("added").alias("action"), *_KEY))
            now = now.union(fresh.select(*_KEY, F.lit(EXPLICIT).cast("tinyint").alias("st")))
        self._swap(now, log, removed is not None)

    def _swap(self, now: DataFrame, log: list[DataFrame], rewrite: bool = True) -> None:
        """Makes a new version: what was only added becomes a part of its own, else (or with many parts) all is written anew."""
        if self.entailing:
            told = now.where(F.col("st").isin(EXPLICIT, HISTORY))
            now = inference.closed_quads(told.where(F.col("st") == EXPLICIT), self.close).union(told.where(F.col("st") == HISTORY))
        self.parts = 1 if rewrite or self.entailing or self.parts >= PARTS else self.parts + 1
        self.quads = written(now) if self.parts == 1 else now
        self.version += 1
        stamp = F.lit(time.time()).alias("ts")
        for part in log:
            rows = written(part.select(stamp, "action", *_KEY))
            # The log grows by parts; many of them become one.
            self.logged = self.logged % PARTS + 1
            self.changes = self.changes.union(rows) if self.logged < PARTS else written(self.changes.union(rows))
            for listener in self.listeners:
                listener(rows)

    @staticmethod
    def _keyed(df: DataFrame) -> DataFrame:
        """With one key column; a NULL graph is a key like others."""
        return df.withColumn("k", F.to_json(F.struct(*_KEY)))

    def _insert_data(self, u: Update) -> None:
        self._commit(self._constants(u.insert), None)

    def _delete_data(self, u: Update) -> None:
        self._commit(None, self._constants(u.delete))

    def _constants(self, quads: list[Quad]) -> DataFrame:
        from .sources.graphs import Solutions

        one = Solutions(self.spark.range(1).select(F.lit(1).alias("v_")), {})
        return instantiate(one, [(q.s, q.p, q.o, q.g) for q in quads])

    def _modify(self, u: Update) -> None:
        where = u.where
        graph = self.graph()
        if u.using or u.using_named:
            graph = graph.using(u.using, u.using_named)
        elif u.with_graph:
            graph = graph.using([u.with_graph], [])
            graph.named = None
        compiler = Engine(self.spark, graph, self.solution_sets, self.prefixes).compiler()
        found = compiler.select(Query("select", where))
        found.df = written(found.df)

        def filled(quads: list[Quad]) -> DataFrame | None:
            if not quads:
                return None
            rows = instantiate(found, [(q.s, q.p, q.o, q.g or u.with_graph) for q in quads])
            return rows.distinct()

        removed = filled(u.delete)
        if removed is not None and not u.with_graph and self.mode == QUADS and any(q.g is None for q in u.delete):
            # Without a graph a statement goes from every graph of the merge.
            open_ = removed.where("g is null").select("s", "p", "o")
            removed = removed.union(self.quads.where(F.col("st") == EXPLICIT).join(open_, ["s", "p", "o"], "left_semi").select(*_KEY)).distinct()
        self._commit(filled(u.insert), removed)

    def _target(self, target: object):
        """A condition for the quads of a graph reference."""
        if target == "ALL":
            return F.lit(True)
        if target == "DEFAULT":
            return F.col("g").isNull()
        if target == "NAMED":
            return F.col("g").isNotNull()
        return F.col("g.lex") == target.lex

    def _clear(self, u: Update) -> None:
        if isinstance(u.target, str) and u.target.startswith("%"):
            self.solution_sets.pop(u.target, None)
            return
        self._commit(None, self.quads.where(F.coalesce(self._target(u.target), F.lit(False)) & (F.col("st") == EXPLICIT)).select(*_KEY))

    _drop = _clear

    def _create(self, u: Update) -> None:
        """Graphs come with their statements; solution sets start empty."""
        if isinstance(u.target, str) and u.target.startswith("%"):
            self.solution_sets.setdefault(u.target, self.spark.createDataFrame([], "x string").select())

    def _relabelled(self, u: Update) -> DataFrame:
        rows = self.quads.where(F.coalesce(self._target(u.source), F.lit(False)) & (F.col("st") == EXPLICIT))
        g = constant(u.target) if isinstance(u.target, Term) else F.lit(None).cast(TERM_DDL)
        return rows.select("s", "p", "o", g.alias("g"))

    def _add(self, u: Update) -> None:
        self._commit(written(self._relabelled(u)), None)

    def _copy(self, u: Update) -> None:
        if u.source == u.target:
            return
        rows = written(self._relabelled(u))
        self._clear(Update("clear", target=u.target))
        self._commit(rows, None)

    def _move(self, u: Update) -> None:
        if u.source == u.target:
            return
        self._copy(u)
        self._clear(Update("clear", target=u.source))

    def _load(self, u: Update) -> None:
        from .sources.rdf import read_rdf

        path = u.source.lex.removeprefix("file://")
        rows = read_rdf(self.spark, path)
        if isinstance(u.target, Term):
            rows = rows.withColumn("g", constant(u.target))
        self._commit(rows, None)

    def _insert_set(self, u: Update) -> None:
        rows = self._solutions(u)
        old = self.solution_sets.get(u.into)
        self.solution_sets[u.into] = written(rows if old is None or not old.columns else old.unionByName(rows, allowMissingColumns=True))

    def _delete_set(self, u: Update) -> None:
        old, rows = self.solution_sets[u.into], self._solutions(u)
        key = lambda df: df.withColumn("k", F.to_json(F.struct(*sorted(df.columns))))
        self.solution_sets[u.into] = written(key(old).join(key(rows).select("k"), "k", "left_anti").drop("k"))

    def _solutions(self, u: Update) -> DataFrame:
        found = self.engine().compiler().select(u.query)
        return found.df.select(*(v.term().alias(n) for n, v in found.variables.items()))

    def _entailments(self, u: Update) -> None:
        """CREATE runs the closure, DROP removes what it made, ENABLE keeps it after each update, DISABLE ends that."""
        if u.source in ("ENABLE", "DISABLE"):
            self.entailing = u.source == "ENABLE"
        told = self.quads.where(F.col("st").isin(EXPLICIT, HISTORY))
        if u.source in ("CREATE", "ENABLE"):
            now = inference.closed_quads(told.where(F.col("st") == EXPLICIT), self.close).union(told.where(F.col("st") == HISTORY))
            self.quads = written(now)
        elif u.source == "DROP":
            self.quads = written(told)
        self.version += 1

    def load(self, quads: DataFrame) -> None:
        """Adds told quads in bulk, clustered by predicate for reading."""
        rows = quads.select("s", "p", "o", "g")
        self._commit(rows, None)

    def save(self, path: str) -> None:
        """Writes the current version clustered by predicate, so that scans of one read few files."""
        self.quads.repartitionByRange(F.col("p.lex"), F.col("s.lex")).sortWithinPartitions(F.col("p.lex"), F.col("s.lex")).write.mode("overwrite").parquet(path)

    def inferred(self) -> DataFrame:
        return self.quads.where(F.col("st") == INFERRED)
