"""Masked pseudo-likelihood of texts under a bidirectional window network.

The network reads the words around a masked one, ``REACH`` on either side:
their embeddings, scaled by place, are summed and squashed to ``h``.  Words, by
falling frequency, are the leaves of a tree of ``LEVELS`` levels, and the masked
word's probability is the product of a softmax at each node on its path.  All of
them see ``h``: a branch's vector is the product of a vector of the node and one of
the branch's number, and its bias is the corpus frequency of the branch.
The log-probabilities of all words, each given both sides, add up to the
text's pseudo-log-likelihood.

Words outside the network's vocabulary, which grows as the root of the corpus up
to what a broadcast may hold, share buckets there; within its bucket each has its
own corpus frequency.  These are looked up where the table of all counts lies:
batches of texts send their distinct words to the ranges of hashes of that table
and get counts back, so the table is never in one place.

Training covers every position of every text once, in ``ROUNDS`` rounds.  Rows
are dealt to shards by a hash of their columns and put in the order of that hash,
so a shard trains on the same stream of words however the input is cut into files
or partitions.  After each round the shards' parameters are averaged, weighted by
positions, in a shuffle by parameter block, and the next round starts from there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches, written
from .text import NON_SPACE, Words, scan, slices

#: Words of the network's vocabulary at least and at most, buckets of other words, levels of the tree, width, words seen on either side.
WORDS, MOST, BUCKETS, LEVELS, WIDTH, REACH = 8192, 65_000, 64, 3, 20, 2
#: Rounds of averaging; words of a shard at least, and shards at most; blocks of parameters.
ROUNDS, SHARD, SHARDS, BLOCKS = 4, 1 << 22, 4096, 64
#: Positions taken up at once, the segments that they are cut into, and positions of each that a step reads.
CHUNK, SEGMENTS, STRIP = 1 << 16, 64, 32
#: Step sizes: at first, and what sums of squared slopes begin with.
RATE, CALM = 0.1, 1e-4
#: Bytes of texts whose words are looked up together, and words of a range of the table of counts.
LOOKUP, RANGE = 1 << 24, 1 << 20
_STEPS = 1 << 40
_PLACES = [d for d in range(-REACH, REACH + 1) if d]
_NEVER = np.float32(-1e30)
#: Logits up to this size need no maximum taken off.
_SAFE = 80.0


@dataclass
class Vocabulary:
    """Words by hash, their numbers and those of buckets, log-frequencies of branches at the nodes of each level, and logs of the buckets' masses.

    Numbers run by falling frequency; written to the base ``side`` their digits
    are the branches from the root on.
    """

    hashes: np.ndarray
    number: np.ndarray
    bucket: np.ndarray
    base: list[np.ndarray]
    masses: np.ndarray

    @classmethod
    def of_counts(cls, hashes: np.ndarray, counts: np.ndarray, other: int | np.ndarray) -> Vocabulary:
        """From the frequent words, and the number of all other words, whole or by bucket."""
        n = len(hashes)
        other = np.full(BUCKETS, max(other, 1) / BUCKETS) if np.ndim(other) == 0 else other
        weight = np.concatenate([counts, other]).astype(np.float64)
        order = np.argsort(-weight, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        side = 2
        while side**LEVELS < len(order):
            side += 1
        leaves = np.zeros(side**LEVELS)
        leaves[: len(order)] = weight[order]
        base = []
        for k in range(LEVELS):
            branch = leaves.reshape(side ** (k + 1), -1).sum(1).reshape(-1, side)
            with np.errstate(divide="ignore", invalid="ignore"):
                base.append(np.where(branch > 0, np.log(branch / branch.sum(1, keepdims=True)), _NEVER).astype(np.float32))
        by_hash = np.argsort(hashes)
        return cls(hashes[by_hash], place[:n][by_hash], place[n:], base, np.log(other).astype(np.float64))

    @property
    def side(self) -> int:
        return self.base[0].shape[1]

    @property
    def edge(self) -> int:
        """The number that stands beyond the ends of a text."""
        return len(self.hashes) + BUCKETS

    def tokens(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of word hashes, and which of them aren't in the vocabulary and have the number of their bucket."""
        far = np.ones(len(h), bool)
        out = np.empty(len(h), np.int32)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            far = self.hashes[at] != h
            out = self.number[at]
        out[far] = self.bucket[_bucket(h[far])]
        return out, far


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(58)).astype(np.int64) % BUCKETS


class Network:
    """Embeddings (the last row is the edge of a text), scales of places, and for each level the vectors of nodes and of branches."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 11):
        r, side = np.random.default_rng(seed), vocabulary.side
        draw = lambda *shape: r.standard_normal(shape).astype(np.float32)
        self.side, self.edge, self.base = side, vocabulary.edge, vocabulary.base
        self.embed = draw(vocabulary.edge + 1, WIDTH) * np.float32(0.1)
        self.node = [1 + draw(side**k, WIDTH) * np.float32(0.3) for k in range(LEVELS)]
        self.scale = 1 + draw(len(_PLACES), WIDTH) * np.float32(0.3)
        self.branch = [draw(WIDTH, side) * np.float32(0.1) for _ in range(LEVELS)]
        #: Sums of squared slopes: one for each row of embeddings and nodes, one for each other parameter.
        self.speed = [np.full((len(p), 1) if k <= LEVELS else p.shape, CALM, np.float32) for k, p in enumerate(self.parameters())]

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.node, self.scale, *self.branch]

    def flat(self) -> np.ndarray:
        """All that training changes, as one vector."""
        return np.concatenate([p.ravel() for p in [*self.parameters(), *self.speed]])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for p in [*self.parameters(), *self.speed]:
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        return self

    def _hidden(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings of strips of tokens, and hidden layers of their inner positions."""
        inner = tokens.shape[1] - 2 * REACH
        around = self.embed[tokens]
        total = np.zeros((len(tokens), inner, WIDTH), np.float32)
        for k, d in enumerate(_PLACES):
            total += around[:, REACH + d : REACH + d + inner] * self.scale[k]
        return around, np.tanh(total, out=total).reshape(-1, WIDTH)

    def _path(self, target: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The node and the branch of each target at each level."""
        target = np.minimum(target, self.edge - 1)
        out = []
        for k in range(LEVELS):
            node = target // self.side ** (LEVELS - k)
            out.append((node, target // self.side ** (LEVELS - k - 1) - node * self.side))
        return out

    def _logits(self, k: int, gated: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Logits of the branches, small enough for exponentials."""
        z = gated @ self.branch[k]
        z += self.base[k][node]
        # No part of h is over one, and some branch has a frequency of over exp(-6).
        if not np.abs(self.branch[k]).sum(0).max() * np.abs(self.node[k]).max() < _SAFE:
            z -= z.max(1, keepdims=True)
        return z

    def log_probability(self, tokens: np.ndarray) -> np.ndarray:
        """For strips of tokens the log-probability of each inner one given those around it."""
        _, hidden = self._hidden(tokens)
        out = np.zeros(len(hidden), np.float32)
        at = np.arange(len(hidden))
        for k, (node, branch) in enumerate(self._path(tokens[:, REACH:-REACH].ravel())):
            z = self._logits(k, hidden * self.node[k][node], node)
            out += z[at, branch]
            out -= np.log(np.exp(z, out=z).sum(1))
        return out

    def step(self, tokens: np.ndarray, skip: np.ndarray | bool = False, rate: float = RATE) -> int:
        """One step of descent over the inner positions of strips of tokens; how many of them are words and not skipped."""
        rows, inner = len(tokens), tokens.shape[1] - 2 * REACH
        target = tokens[:, REACH:-REACH].ravel()
        none = np.flatnonzero((target == self.edge) | skip)
        n = len(target) - len(none)
        if not n:
            return 0
        at, share = np.arange(len(target)), np.float32(1 / n)
        around, hidden = self._hidden(tokens)
        back, moves = np.zeros_like(hidden), []
        for k, (node, branch) in enumerate(self._path(target)):
            gate = self.node[k][node]
            gated = hidden * gate
            error = self._logits(k, gated, node)
            np.exp(error, out=error)
            error *= (share / error.sum(1))[:, None]
            error[at, branch] -= share
            error[none] = 0
            own = error @ self.branch[k].T
            moves.append((gated.T @ error, node, own * hidden))
            own *= gate
            back += own
        hidden *= hidden
        back *= 1 - hidden
        back = back.reshape(rows, inner, WIDTH)
        to_embed, to_scale = np.zeros_like(around), np.empty_like(self.scale)
        for k, d in enumerate(_PLACES):
            part = slice(REACH + d, REACH + d + inner)
            to_scale[k] = np.einsum("ijk,ijk->k", around[:, part], back)
            to_embed[:, part] += back * self.scale[k]
        self._move_rows(0, tokens.ravel(), to_embed.reshape(-1, WIDTH), rate, n)
        self._move(LEVELS + 1, to_scale, rate)
        for k, (slope, node, slopes) in enumerate(moves):
            self._move(LEVELS + 2 + k, slope, rate)
            self._move_rows(1 + k, node, slopes, rate, n)
        return n

    def _move(self, k: int, slope: np.ndarray, rate: float) -> None:
        self.speed[k] += slope * slope
        self.parameters()[k][...] -= rate * slope / np.sqrt(self.speed[k])

    def _move_rows(self, k: int, rows: np.ndarray, slopes: np.ndarray, rate: float, n: int) -> None:
        """Moves those rows of a parameter that took part, by the sum of their slopes."""
        order = np.argsort(rows.astype(np.uint16) if self.edge < 1 << 16 else rows, kind="stable")
        ordered = rows[order]
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        used, summed = ordered[first], np.add.reduceat(slopes[order], first)
        self.speed[k][used] += np.square(summed).mean(1, keepdims=True) * np.float32(n)
        self.parameters()[k][used] -= rate * math.sqrt(n) * summed / np.sqrt(self.speed[k][used])


def stream(found: Words, tokens: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of several texts one after the other, ``REACH`` edges before, between and behind them; and where each word stands."""
    at = np.arange(len(tokens)) + REACH * (found.row + 1)
    out = np.full(len(tokens) + REACH * (found.rows + 1), edge, np.int32)
    out[at] = tokens
    return out, at


def strips(before: np.ndarray, chunk: np.ndarray, after: np.ndarray, edge: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A chunk of a stream as matrices of tokens for steps, and which inner positions stand behind the chunk.

    Each position of the chunk is an inner one once.  A step reads a strip from
    each of several segments, so that it meets many texts; strips hold ``REACH``
    more tokens on either side.
    """
    segments = max(1, min(SEGMENTS, len(chunk) // STRIP))
    length = -(-len(chunk) // segments)
    padded = np.full(segments * length + 2 * REACH, edge, np.int32)
    whole = np.concatenate([before, chunk, after])[: len(padded)]
    padded[: len(whole)] = whole
    base = np.arange(segments)[:, None] * length
    for low in range(0, length, STRIP):
        at = base + low + np.arange(min(STRIP, length - low) + 2 * REACH)
        yield padded[at], (at[:, : -2 * REACH] >= len(chunk)).ravel()


class Trainer:
    """Trains a network on a stream of texts, in chunks that don't depend on how the texts arrive."""

    def __init__(self, network: Network):
        self.network, self.positions = network, 0
        self._before = np.full(REACH, network.edge, np.int32)
        self._held: list[np.ndarray] = []
        self._size = 0

    def take(self, tokens: np.ndarray) -> None:
        """The words of one text."""
        self._held += [tokens, np.full(REACH, self.network.edge, np.int32)]
        self._size += len(tokens) + REACH
        if self._size >= CHUNK + REACH:
            whole = np.concatenate(self._held)
            low = 0
            while len(whole) - low >= CHUNK + REACH:
                self._learn(whole[low : low + CHUNK], whole[low + CHUNK : low + CHUNK + REACH])
                low += CHUNK
            self._held, self._size = [whole[low:]], len(whole) - low

    def finish(self) -> None:
        if self._size:
            self._learn(np.concatenate(self._held), np.zeros(0, np.int32))
        self._held, self._size = [], 0

    def _learn(self, chunk: np.ndarray, after: np.ndarray) -> None:
        for part in strips(self._before, chunk, after, self.network.edge):
            self.positions += self.network.step(*part)
        self._before = np.concatenate([self._before, chunk])[-REACH:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = [scan(batch.column(0).slice(a, b - a), NON_SPACE).hash for a, b in slices(batch.column(0))]
        if held:
            words, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])


def _tokenise(held):
    """Rows (shard, key, text): the numbers of the words in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = held.value
        for batch in batches:
            for low, high in slices(batch.column(2)):
                found = scan(batch.column(2).slice(low, high - low), NON_SPACE)
                tokens = vocabulary.tokens(found.hash)[0]
                bounds = found.bounds() * tokens.itemsize
                raw = pa.Array.from_buffers(pa.large_binary(), found.rows, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(tokens)])
                yield pa.RecordBatch.from_arrays([*(c.slice(low, high - low) for c in batch.columns[:2]), raw.cast(pa.binary())], names=["shard", "key", "tokens"])

    return run


def _train(held, flat):
    """Rows (shard, key, tokens) in order: for each shard the parameters after training, as blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, trainer = None, None

        def close() -> Iterator[pa.RecordBatch]:
            if trainer is not None:
                trainer.finish()
                if trainer.positions:
                    blocks = np.array_split(trainer.network.flat(), BLOCKS)
                    columns = [pa.array(range(BLOCKS), pa.int32()), pa.array([shard] * BLOCKS, pa.int32()), pa.array([trainer.positions] * BLOCKS, pa.int64()), pa.array([b.tobytes() for b in blocks], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["block", "shard", "n", "part"])

        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if name != shard:
                    yield from close()
                    network = Network(held.value)
                    shard, trainer = name, Trainer(network.load(flat.value) if flat else network)
                trainer.take(np.frombuffer(raw.as_buffer(), np.int32))
        yield from close()

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of shards, in order of block and shard: their weighted sums, one for each block."""
    total: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for block, n, raw in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
            was = total.get(block, (0, 0.0))
            total[block] = (was[0] + n, was[1] + np.frombuffer(raw, np.float32).astype(np.float64) * n)
    if total:
        names = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([(total[k][1] / total[k][0]).astype(np.float32).tobytes() for k in names], pa.binary())], names=["block", "part"])


def _frequent(counts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """About ``size`` most frequent words and their counts, most frequent first.

    The number of words by count says where to cut; words of the last count are
    chosen by hash, so no task holds a top list.
    """
    left, least, share = size, 0, 0
    for n, words in counts.groupBy("n").agg(F.count(F.lit(1))).orderBy(F.desc("n")).collect():
        if words > left:
            least, share = n, left * _STEPS // words
            break
        left -= words
    last = (F.col("n") == least) & (F.pmod(F.xxhash64("word"), F.lit(_STEPS)) < share)
    found = counts.where((F.col("n") > least) | last).toArrow()
    words, n = found.column("word").to_numpy(), found.column("n").to_numpy()
    order = np.lexsort((words, -n))
    return words[order].view(np.uint64), n[order]


def fit(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS) -> tuple[Vocabulary, np.ndarray | None, DataFrame]:
    """Vocabulary, parameters (None without words) and the counts of all words (word, n) from all rows.

    Every word of every text is a target once, in one of the rounds.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string").alias("text")
    counts = written(small_batches(docs).select(text).mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    masses = np.zeros(BUCKETS, np.int64)
    for bucket, n in counts.groupBy(F.shiftrightunsigned("word", 58)).agg(F.sum("n")).collect():
        masses[bucket % BUCKETS] += n
    whole = int(masses.sum())
    hashes, n = _frequent(counts, min(MOST, max(WORDS, math.isqrt(whole))))
    np.subtract.at(masses, _bucket(hashes), n)
    # One more for words that were never seen.
    vocabulary = Vocabulary.of_counts(hashes, n, masses + 1)
    held = spark.sparkContext.broadcast(vocabulary)
    shards = min(SHARDS, max(1, whole // SHARD))
    key = F.xxhash64(*docs.columns)
    rows = docs.select(F.pmod(F.shiftright(key, 8), F.lit(shards)).cast("int").alias("shard"), key.alias("key"), text).where("text is not null")
    flat = None
    for k in range(rounds if whole else 0):
        now = rows.where(F.pmod("key", F.lit(rounds)) == k).mapInArrow(_tokenise(held), "shard int, key long, tokens binary")
        start = spark.sparkContext.broadcast(flat) if flat is not None else None
        trained = now.repartition("shard").sortWithinPartitions("shard", "key", "tokens").mapInArrow(_train(held, start), "block int, shard int, n long, part binary")
        blocks = trained.repartition("block").sortWithinPartitions("block", "shard").mapInArrow(_average, "block int, part binary").orderBy("block").collect()
        if blocks:
            flat = np.concatenate([np.frombuffer(bytes(b[1]), np.float32) for b in blocks])
    return vocabulary, flat, counts


class _Lookup:
    """Rows that wait for the counts of their words outside the vocabulary, and these words."""

    def __init__(self, shift: int):
        self.shift, self.name, self.bytes = shift, None, 0
        self.rows: list[tuple] = []
        self.far: list[np.ndarray] = []

    def close(self) -> Iterator[pa.RecordBatch]:
        """The rows with places in the list of their distinct words, and that list by range of hashes."""
        if self.name is None:
            return
        words, back = np.unique(np.concatenate(self.far), return_inverse=True)
        back, at = back.astype(np.int32), 0
        kind = None
        for row, n, log, ends in self.rows:
            raw = [back[at + a : at + b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            at += int(ends[-1])
            kind = row.type
            yield _records(row, self.name, pa.nulls(len(row), pa.int32()), pa.array(n, pa.int64()), pa.array(log), raw)
        part = (words >> np.uint64(self.shift)).astype(np.int64) if self.shift < 64 else np.zeros(len(words), np.int64)
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
        raw = [w.tobytes() for w in np.split(words, first[1:])] if len(words) else []
        n = len(raw)
        yield _records(pa.nulls(n, kind), self.name, pa.array(part[first], pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), raw)
        self.__init__(self.shift)


def _records(row, batch: int, part, n, log, raw: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([row, pa.array([batch] * len(row), pa.int64()), part, n, log, pa.array(raw, pa.binary())], names=["row", "batch", "part", "n_words", "log", "words"])


def _score(held, shift: int, together: int):
    """Rows (row, text, place): scores with all words of a bucket taken for one, and the words to look up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, flat = held.value
        network = Network(vocabulary)
        if flat is not None:
            network.load(flat)
        masses = vocabulary.masses
        lookup = _Lookup(shift)
        for batch in batches:
            for low, high in slices(batch.column(1)):
                part = batch.slice(low, high - low)
                found = scan(part.column(1), NON_SPACE)
                tokens, far = vocabulary.tokens(found.hash)
                log = score_words(network, found, tokens)
                far = np.flatnonzero(far)
                log[far] -= masses[_bucket(found.hash[far])]
                n = np.bincount(found.row, minlength=found.rows)
                if lookup.name is None:
                    lookup.name = part.column(2)[0].as_py()
                lookup.rows.append((part.column(0), n, np.bincount(found.row, log, found.rows), np.searchsorted(found.row[far], np.arange(found.rows + 1))))
                lookup.far.append(found.hash[far])
                lookup.bytes += len(found.data) + 64 * found.rows
                if lookup.bytes > together:
                    yield from lookup.close()
        yield from lookup.close()

    return run


def score_words(network: Network, found: Words, tokens: np.ndarray, size: int = 1 << 13) -> np.ndarray:
    """The log-probability of each word's number given the words around it."""
    line, at = stream(found, tokens, network.edge)
    out = np.empty(len(line) - 2 * REACH)
    for low in range(0, len(out), size):
        out[low : low + size] = network.log_probability(line[None, low : low + size + 2 * REACH])
    return out[at - REACH]


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, batch, word, n, words), the counts of a range before its questions: counts for each question."""
    part, words, times, sealed = None, [], [], False
    for batch in batches:
        parts, asks = batch.column(0).to_numpy(), batch.column(1)
        low = 0
        edges = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]][: len(parts)]).tolist()
        for low, high in zip(edges, [*edges[1:], len(parts)], strict=True):
            if parts[low] != part:
                part, words, times, sealed = parts[low], [], [], False
            split = low + asks.slice(low, high - low).null_count
            if split > low:
                words.append(batch.column(2).slice(low, split - low).to_numpy().view(np.uint64))
                times.append(batch.column(3).slice(low, split - low).to_numpy())
            if split == high:
                continue
            if not sealed:
                h, t = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((words, np.uint64), (times, np.int64)))
                order = np.argsort(h)
                h, t, sealed = h[order], t[order], True
            out = []
            for raw in batch.column(4).slice(split, high - split):
                asked = np.frombuffer(raw.as_buffer(), np.uint64)
                got = np.zeros(len(asked), np.int64)
                if len(h):
                    at = np.minimum(np.searchsorted(h, asked), len(h) - 1)
                    got = np.where(h[at] == asked, t[at], 0)
                out.append(got.tobytes())
            yield pa.RecordBatch.from_arrays([asks.slice(split, high - split), pa.array([int(part)] * len(out), pa.int32()), pa.array(out, pa.binary())], names=["batch", "part", "words"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (batch, part, row, n_words, log, words), the answers of a batch before its rows: rows with their sums."""
    name, held, logs = None, [], np.zeros(0)
    for batch in batches:
        names = batch.column(0).to_numpy()
        edges = np.flatnonzero(np.r_[True, names[1:] != names[:-1]][: len(names)]).tolist()
        for low, high in zip(edges, [*edges[1:], len(names)], strict=True):
            if names[low] != name:
                name, held, logs = names[low], [], np.zeros(0)
            part = batch.slice(low, high - low)
            answers = high - low - part.column(1).null_count
            held += [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(5).slice(0, answers)]
            if answers == high - low:
                continue
            if held:
                logs, held = np.log(np.maximum(np.concatenate(held), 1)), []
            rows = part.slice(answers)
            n, own = rows.column(3), np.array([logs[np.frombuffer(x.as_buffer(), np.int32)].sum() for x in rows.column(5)])
            log = rows.column(4).to_numpy() + own
            words = n.to_numpy()
            mean = pa.array(log / np.maximum(words, 1), mask=words == 0)
            yield pa.RecordBatch.from_arrays([rows.column(2), n, pa.array(log), mean], names=["row", "n_words", "log_likelihood", "mean"])


def score(docs: DataFrame, text_col: str = "text", learn: DataFrame | None = None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """``row`` (a struct of the ``keep`` columns, by default all), n_words, log_likelihood (0 without words) and mean (null without words).

    The network is trained on the texts of ``learn``, by default of ``docs``.
    Words are runs of non-white-space, A-Z lower-cased.  Null and empty texts
    have no words.  Under an empty training table all words are unknown; an unknown
    word counts as one that was seen once.  Rows that are equal in all columns
    of ``learn`` are trained on in one shard.  Scores don't depend on files,
    partitions or the order of rows.  An empty table gives an empty table.
    """
    vocabulary, flat, counts = fit(docs if learn is None else learn, text_col)
    held = docs.sparkSession.sparkContext.broadcast((vocabulary, flat))
    parts = max(1, counts.count() // RANGE)
    bits = (parts - 1).bit_length()
    rows = small_batches(docs).select(F.struct(*(keep or docs.columns)).alias("row"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("place"))
    kind = rows.schema["row"].dataType.simpleString()
    found = written(rows.mapInArrow(_score(held, 64 - bits, LOOKUP), f"row {kind}, batch long, part int, n_words long, log double, words binary"))
    range_of = F.shiftrightunsigned("word", 64 - bits).cast("int") if bits else F.lit(0)
    asked = found.where("part is not null").select("part", "batch", F.lit(None).cast("long").alias("word"), F.lit(None).cast("long").alias("n"), "words")
    known = counts.select(range_of.alias("part"), F.lit(None).cast("long").alias("batch"), "word", "n", F.lit(None).cast("binary").alias("words"))
    both = known.union(asked).repartition("part").sortWithinPartitions("part", F.asc_nulls_first("batch"))
    answers = both.mapInArrow(_answer, "batch long, part int, words binary")
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("row", kind), ("n_words", "long"), ("log", "double"))]
    back = answers.select("batch", "part", *nothing, "words").union(found.where("part is null").select("batch", "part", "row", "n_words", "log", "words"))
    done = back.repartition("batch").sortWithinPartitions("batch", F.asc_nulls_last("part"))
    return done.mapInArrow(_finish, f"row {kind}, n_words long, log_likelihood double, mean double")
