"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton is built over the words of all items.  Texts stream through it;
at each word it gives the longest run that ends there and occurs in an item.
Where that run covers a window (``window`` words, or a whole shorter item) the
words of the window are hit.  Stretches whose consecutive word pairs occur in no
item cannot hold a window and are passed over in one vector operation.

Item texts travel to the executors in shards of at most ``SHARD_BYTES`` and each
worker builds the automaton of a shard once; more shards are more stages of one
scan, so a benchmark of any size is matched in full without a shuffle.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import small_batches
from .text import ALNUM, Words, grams, scan, slices

#: Item bytes that one broadcast holds; a single longer item stands alone.
SHARD_BYTES = 1 << 19


class SuffixAutomaton:
    """Suffix automaton of several word sequences, with the items of each state."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        self.window = window
        self.names = [name for name, _ in items]
        self.sizes = [len(h) for _, h in items]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        words = [h.tolist() for _, h in items]
        for sequence in words:
            last = 0
            for w in sequence:
                last = self._extend(last, w)
        self.items: list[set[int]] = [set() for _ in self.next]
        self.whole: list[set[int]] = [set() for _ in self.next]
        for k, sequence in enumerate(words):
            state = 0
            for w in sequence:
                state = self.next[state][w]
                up = state
                while up > 0 and k not in self.items[up]:
                    self.items[up].add(k)
                    up = self.link[up]
            if 0 < len(sequence) < window:
                while self.length[self.link[state]] >= len(sequence):
                    state = self.link[state]
                self.whole[state].add(len(sequence))
        used = [h for _, h in items if len(h)]
        self.vocabulary = np.unique(np.concatenate(used)) if used else np.zeros(0, np.uint64)
        self.pairs = np.unique(np.concatenate([grams(h, 2) for h in used])) if used else np.zeros(0, np.uint64)
        self.shortest = min([window, *map(len, used)])
        self._short: dict[int, list[tuple[int, int]]] = {}

    def _new(self, length: int, link: int, to: dict[int, int]) -> int:
        self.next.append(to)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """The state of the runs of q that are no longer than p's run and w."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, self.next[last][w], w)
        new = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][w], w)
        return new

    def _shorts(self, state: int) -> list[tuple[int, int]]:
        """(length, state) of the short items that end runs of this state."""
        if state not in self._short:
            found, up = [], state
            while up > 0:
                found += [(n, up) for n in self.whole[up]]
                up = self.link[up]
            self._short[state] = found
        return self._short[state]

    def stretches(self, h: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of words that may hold a window."""
        n = len(h)
        if not n or not len(self.vocabulary):
            return
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == h
        joined = np.zeros(n + 1, bool)
        if n > 1 and len(self.pairs):
            both = np.flatnonzero(known[1:] & known[:-1])
            g = grams(h, 2)[both]
            at = np.minimum(np.searchsorted(self.pairs, g), len(self.pairs) - 1)
            joined[both[self.pairs[at] == g] + 1] = True
        begins = np.flatnonzero(known & ~joined[:n])
        ends = np.flatnonzero(known & ~joined[1:]) + 1
        fit = ends - begins >= self.shortest
        yield from zip(begins[fit].tolist(), ends[fit].tolist(), strict=True)

    def match(self, h: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged ranges of hit words, and the items with windows that occur."""
        spans: list[tuple[int, int]] = []
        states: set[int] = set()
        for low, high in self.stretches(h):
            state = size = 0
            for at, w in enumerate(h[low:high].tolist(), low):
                while state and w not in self.next[state]:
                    state = self.link[state]
                    size = self.length[state]
                if w not in self.next[state]:
                    continue
                state = self.next[state][w]
                size += 1
                reach = 0
                if size >= self.window:
                    reach, up = self.window, state
                    while self.length[self.link[up]] >= self.window:
                        up = self.link[up]
                    states.add(up)
                for n, up in self._shorts(state):
                    if size >= n:
                        reach = max(reach, n)
                        states.add(up)
                if reach:
                    begin = at + 1 - reach
                    while spans and spans[-1][1] >= begin:
                        begin = min(begin, spans.pop()[0])
                    spans.append((begin, at + 1))
        return spans, {k for s in states for k in self._complete(s)}

    def _complete(self, state: int) -> set[int]:
        """Items of a state whose window is one of its runs."""
        if self.length[state] >= self.window:
            return self.items[state]
        return {k for k in self.items[state] if self.sizes[k] in self.whole[state]}

    @classmethod
    def of(cls, items: list[tuple[str, str]], window: int) -> SuffixAutomaton:
        return cls([(name, scan(pa.array([text]), ALNUM).hash) for name, text in items], window)


_built: dict[tuple[str, int], SuffixAutomaton] = {}


def _automaton(shard: Broadcast, window: int) -> SuffixAutomaton:
    """The automaton of a shard (its name and items), made once in a worker."""
    name, items = shard.value
    if (name, window) not in _built:
        _built.clear()
        _built[name, window] = SuffixAutomaton.of(items, window)
    return _built[name, window]


def _merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(a + b):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _cut(found: Words, text: bytes, first: int, origin: int, spans: list[tuple[int, int]]) -> str:
    """The text without the bytes from the first to the last word of each span."""
    kept, at = [], 0
    for low, high in spans:
        kept.append(text[at : int(found.start[first + low]) - origin])
        at = int(found.end[first + high - 1]) - origin
    kept.append(text[at:])
    return b"".join(kept).decode()


def _stage(shard: Broadcast, window: int, last: bool, cut_from: int):
    """Adds one shard's spans and items; the last stage also counts and cuts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shard, window)
        for batch in batches:
            texts = batch.column(1)
            for low, high in slices(texts):
                part = batch.slice(low, high - low)
                found = scan(part.column(1), ALNUM)
                bounds = found.bounds()
                spans, items = part.column(2).to_pylist(), part.column(3).to_pylist()
                total, hit, clean = [], [], []
                for k in range(part.num_rows):
                    own, names = automaton.match(found.hash[bounds[k] : bounds[k + 1]])
                    before = list(zip(spans[k][::2], spans[k][1::2], strict=True))
                    own = _merge(before, own)
                    spans[k] = [x for s in own for x in s]
                    items[k] = sorted({*items[k], *(automaton.names[i] for i in names)})
                    if last:
                        total.append(int(bounds[k + 1] - bounds[k]))
                        hit.append(sum(b - a for a, b in own))
                        origin = int(found.offsets[k])
                        text = found.data[origin : int(found.offsets[k + 1])].tobytes() if own else b""
                        long = [s for s in own if s[1] - s[0] >= cut_from]
                        clean.append(_cut(found, text, int(bounds[k]), origin, long) if long else None)
                columns = [part.column(0), part.column(1), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
                names = ["row", "text", "spans", "items"]
                if last:
                    digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
                    columns = [columns[0], *columns[2:], pa.array(total, pa.int64()), pa.array(hit, pa.int64()), pa.array(digest), pa.array(clean, pa.string())]
                    names = ["row", "spans", "items", "n_words", "n_hit", "items_sha256", "cut"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", cut_from: int = 1) -> DataFrame:
    """Each row of ``docs`` as ``row`` (a struct of all its columns), with what it shares with the items.

    Adds spans (word ranges, flat), items (ids as strings, sorted), n_words,
    n_hit, items_sha256, and cut: the text without hit spans of ``cut_from``
    words or more, null where there is none.

    Words are runs of ASCII letters and digits and of all other non-ASCII
    characters, A-Z lower-cased; null and empty texts have none and match
    nothing.  Items without words never occur; repeated item ids count once and
    null ids are left out.  With an empty item table nothing is hit.
    """
    spark = docs.sparkSession
    wanted = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("string").alias("id"), F.col(item_text).cast("string").alias("text"))
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // SHARD_BYTES))
    shard_of = F.pmod(F.xxhash64("id", "text"), F.lit(count))
    rows = small_batches(docs).select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text"), F.expr("cast(array() as array<int>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    kind = T.StructType([rows.schema["row"], rows.schema["text"], rows.schema["spans"], rows.schema["items"]])
    done = T.StructType([rows.schema["row"], rows.schema["spans"], rows.schema["items"], *(T.StructField(n, t) for n, t in (("n_words", T.LongType()), ("n_hit", T.LongType()), ("items_sha256", T.StringType()), ("cut", T.StringType())))])
    for k in range(count):
        held = wanted.where(shard_of == k).orderBy("id", "text").collect()
        shard = spark.sparkContext.broadcast((uuid.uuid4().hex, [(r[0], r[1]) for r in held]))
        last = k == count - 1
        rows = rows.mapInArrow(_stage(shard, window, last, cut_from), done if last else kind)
    return rows


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5, cut_from: int = 1, text_col: str = "text") -> DataFrame:
    """``docs`` with the same columns, without hit spans.

    Spans of ``cut_from`` hit words or more are cut out of the text; a row whose
    hit words are more than ``max_coverage`` of its words is dropped.  Rows that
    share no window are returned as they are.
    """
    found = contamination(docs, items, window, text_col, cut_from=cut_from).where(F.col("n_hit") <= max_coverage * F.col("n_words"))
    return found.select(*(F.coalesce("cut", F.col("row")[c]).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
