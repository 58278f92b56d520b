"""URL rules by a sort-merge range join.

A host is written with its labels reversed, each ended by a dot, so that a rule's
host and all its subdomains are one interval of keys (those that start with the
rule's).  Urls are dealt out by ranges of (key, path); a rule goes to every range
that its interval meets.  Rules and urls of a range are sorted together and swept
once as one stream: a rule comes before all urls in its interval and opens it on
a stack, intervals that end are popped, and a url looks at the open hosts only,
from the innermost outwards, for the longest fitting rule.  So no more rules are
held than those of the open hosts.

The range limits come from a bounded sample of urls.  Where one url is so
frequent that it is several limits at once, its rows are dealt over the ranges
between; so neither a hot host nor a hot url stays in one task.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import some_rows

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sampled urls for each range.
SAMPLED = 10
_LAST = "\U0010ffff"


def parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host and path of a url: both empty for null or where there is no ``://``.

    The host goes up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path
    from there up to ``?``, ``#`` or the end.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    bare = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    host = F.substring_index(bare, "/", 1)
    return F.translate(host, UPPER, LOWER), F.substring(bare, F.length(host) + 1, F.length(bare))


def host_key(host: F.Column) -> F.Column:
    """``www.example.org`` as ``org.example.www.``."""
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit("."))


class PathRules:
    """The rules of one host: the longest path that a path starts with."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        best: dict[str, tuple[str, str]] = {}
        for path, rule, verdict in rules:
            if path not in best or verdict > best[path][1]:
                best[path] = (rule, verdict)
        self.paths = sorted(best)
        self.rules = [best[p] for p in self.paths]
        self.shorter: list[int] = []
        for k, path in enumerate(self.paths):
            up = k - 1
            while up >= 0 and not path.startswith(self.paths[up]):
                up = self.shorter[up]
            self.shorter.append(up)

    def longest(self, path: str) -> tuple[int, str, str] | None:
        """(length of the rule's path, rule, verdict)."""
        k = bisect_right(self.paths, path) - 1
        while k >= 0 and not path.startswith(self.paths[k]):
            k = self.shorter[k]
        return (len(self.paths[k]), *self.rules[k]) if k >= 0 else None


class Sweep:
    """A sweep over rules and urls in the order of their keys, with a stack of the open hosts."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, list[tuple[str, str, str]], list[PathRules]]] = []

    def _close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def open(self, key: str, path: str, rule: str, verdict: str) -> None:
        """A rule for a host and all its subdomains; it comes before their urls."""
        self._close(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, [], []))
        self.stack[-1][1].append((path, rule, verdict))

    def judge(self, key: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits a url."""
        self._close(key)
        found, length = None, -1
        for host, rules, sorted_ in reversed(self.stack):
            if not sorted_:
                sorted_.append(PathRules(rules))
            if (fit := sorted_[0].longest(path)) and len(host) - 1 + fit[0] > length:
                found, length = fit[1:], len(host) - 1 + fit[0]
        return found


def _deal(limits: list[tuple[str, str]]):
    """Adds the number of its range to each (row, key, path, spread)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, path, spread in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                low = bisect_left(limits, (key, path))
                high = bisect_right(limits, (key, path))
                out.append(low + spread % (high - low + 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.int32())], names=["row", "key", "path", "part"])

    return run


def _rule_parts(limits: list[tuple[str, str]]):
    """Each rule once for every range that its interval meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [bisect_left(limits, (k, "")) for k in batch.column(0).to_pylist()]
            high = [bisect_right(limits, (k + _LAST, "")) for k in batch.column(0).to_pylist()]
            times = np.array(high) - np.array(low) + 1
            at = np.repeat(np.arange(len(low)), times)
            part = np.concatenate([np.arange(a, b + 1) for a, b in zip(low, high, strict=True)]) if len(low) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in batch.columns), pa.array(part, pa.int32())], names=["key", "path", "rule", "verdict", "part"])

    return run


def _sweep(default: str):
    """Rows (part, is_url, key, path, rule, verdict, row) in the order of part, key, and rules before urls: the urls judged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sweep = None, Sweep()
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(6)]
            at, names, verdicts = [], [], []
            for k, (p, is_url, key, path, rule, verdict) in enumerate(zip(*columns, strict=True)):
                if p != part:
                    part, sweep = p, Sweep()
                if not is_url:
                    sweep.open(key, path, rule, verdict)
                    continue
                found = sweep.judge(key, path) or (None, default)
                at.append(k)
                names.append(found[0])
                verdicts.append(found[1])
            yield pa.RecordBatch.from_arrays([batch.column(6).take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(verdicts, pa.string())], names=["row", "rule", "verdict"])

    return run


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """The ``keep`` columns of each row, with host, path, rule and verdict.

    ``rules`` has (rule, verdict): a rule is a host and a path, like
    ``example.org/es/``, and a verdict ``allow`` or ``block``.  A rule fits a url
    if the url's host is the rule's or a subdomain of it, and the url's path
    starts with the rule's.  The longest rule wins; of equally long ones that
    with the longer host; of one rule listed with both verdicts, ``block``.
    Where none fits, rule is null and the verdict is ``default``.

    Null urls and urls without ``://`` have an empty host and path and fit no
    rule.  Null rules and rules with an empty host are left out.  Repeated rows
    are judged one by one; an empty table gives an empty table.  Columns to keep
    may not be called host, path, rule or verdict.
    """
    if clash := {"host", "path", "rule", "verdict"} & set(keep):
        raise ValueError(f"columns to keep are named as results are: {sorted(clash)}")
    spark = pages.sparkSession
    host, path = parts(F.col(url_col).cast("string"))
    urls = pages.select(F.struct(*keep, host.alias("host"), path.alias("path")).alias("row"))
    salt = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    keyed = urls.select("row", host_key(F.col("row.host")).alias("key"), F.col("row.path").alias("path"), F.xxhash64(salt, "row").bitwiseAND(F.lit((1 << 31) - 1)).alias("spread"))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = sorted((r[0], r[1]) for r in some_rows(keyed.select("key", "path", "spread"), SAMPLED * ranges, F.struct("key", "path", "spread")).collect())
    limits = [sample[k * len(sample) // ranges] for k in range(1, ranges)] if sample else []

    rule_host, rule_path = F.substring_index("rule", "/", 1), F.col("rule")
    rule_path = F.substring(rule_path, F.length(rule_host) + 1, F.length("rule"))
    wanted = rules.where("rule is not null and verdict is not null").select(F.translate(rule_host, UPPER, LOWER).alias("h"), rule_path.alias("path"), "rule", "verdict")
    wanted = wanted.where("h <> ''").select(host_key(F.col("h")).alias("key"), "path", "rule", "verdict")
    spread_rules = wanted.mapInArrow(_rule_parts(limits), "key string, path string, rule string, verdict string, part int")
    row = keyed.schema["row"].dataType.simpleString()
    dealt = keyed.mapInArrow(_deal(limits), f"row {row}, key string, path string, part int")
    nothing = F.lit(None)
    both = dealt.select("part", F.lit(True).alias("is_url"), "key", "path", nothing.cast("string").alias("rule"), nothing.cast("string").alias("verdict"), "row").union(
        spread_rules.select("part", F.lit(False), "key", "path", "rule", "verdict", nothing.cast(row))
    )
    done = both.repartition("part").sortWithinPartitions("part", "key", "is_url", "path").mapInArrow(_sweep(default), f"row {row}, rule string, verdict string")
    return done.select("row.*", "rule", "verdict")
