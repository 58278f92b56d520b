"""Token counts by a finite-state transducer compiled from a BPE vocabulary.

The transducer reads characters.  Its state holds the characters that may still
grow into a piece and, for the places between them, the last token of the
encoding so far and the count there; a transition says how far the count of
tokens moves (down when characters merge).  For BPE the encoding of a prefix
extends by exactly one token whose pair with its predecessor no merge crosses,
so the next state is a function of state and character: the machine is
deterministic.  It is compiled lazily, transition by transition, and kept.

A space before which no space stands resets the machine, as no piece has a
space after another character.  Texts are cut there into units; the units of a
batch run through the machine side by side.

A text of over ``CHUNK`` characters becomes rows, one for each chunk, cut at any
place.  All chunks run at once: each gives its state map, from every state that
the characters before it may leave the machine in to the state at its end and the
tokens counted between.  Maps compose associatively, so those of neighbours are
joined by state, two by two, until one is left for each text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches, written
from .text import _power_tables, mix, slices

SPACE = 0x2581
#: Characters in a batch or chunk.
CHUNK = 1 << 20
#: Characters before a chunk that say which states it may begin in.
BEFORE = 64
#: Units that a worker remembers, and states that its machine keeps.
REMEMBERED, STATES = 1 << 21, 150_000


class Transducer:
    """A lazily compiled deterministic transducer that counts the tokens of a BPE model."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.growing = {p[:k] for p in scores for k in range(1, len(p))}
        self.forget()

    def forget(self) -> None:
        """Back to the start state alone; transitions are compiled again as they are met."""
        self._fits: dict[tuple[str, str], bool] = {}
        #: (characters, last tokens and counts at each place between them, whether a space came last)
        self._states: list[tuple] = [("", (None,), (0,), False)]
        self._number = {self._states[0]: 0}
        self._moves: dict[int, tuple[int, int]] = {}
        self._keys = np.zeros(0, np.int64)
        self._to = self._delta = np.zeros(0, np.int64)
        self._settled = 0

    @property
    def states(self) -> int:
        return len(self._states)

    @classmethod
    def from_sentencepiece(cls, path: str) -> Transducer:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        skip = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i)
        return cls({model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not skip(i)})

    def merged(self, text: str) -> list[str]:
        """The tokens of a text by repeated merging, for compiling (short strings) and tests."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, before: str | None, token: str) -> bool:
        """Whether no merge crosses from one token into the next, and each stands for itself."""
        key = (before or "", token)
        if key not in self._fits:
            self._fits[key] = self.merged(key[0] + token) == ([before, token] if before else [token])
        return self._fits[key]

    def _cost(self, token: str) -> int:
        return 1 if token in self.scores else len(token.encode())

    def move(self, state: int, char: int) -> tuple[int, int]:
        """The next state, and by how much the count of tokens moves."""
        key = state << 21 | char
        if key in self._moves:
            return self._moves[key]
        held, lasts, counts, after_space = self._states[state]
        if char == SPACE and not after_space:
            held, lasts, counts = "", (None,), (0,)
        grown = held + chr(char)
        for size in range(min(len(grown), self.longest), 0, -1):
            token = grown[-size:]
            if (size == 1 or token in self.scores) and self.fits(lasts[-size], token):
                break
        else:
            raise AssertionError(f"no encoding of {grown!r}")
        delta = counts[-size] + self._cost(token)
        lasts, counts = (*lasts, token), (*(c - delta for c in counts), 0)
        keep = len(grown)
        while keep and grown[-keep:] not in self.growing:
            keep -= 1
        new = (grown[-keep:] if keep else "", lasts[-keep - 1 :], counts[-keep - 1 :], char == SPACE)
        if new not in self._number:
            self._number[new] = len(self._states)
            self._states.append(new)
        self._moves[key] = (self._number[new], delta)
        return self._moves[key]

    def run(self, chars: np.ndarray, state: int = 0) -> tuple[int, int]:
        """The state after some characters, and the tokens counted."""
        total = 0
        moves, move = self._moves, self.move
        for char in chars.tolist():
            state, delta = moves.get(state << 21 | char) or move(state, char)
            total += delta
        return state, total

    def name(self, state: int) -> str:
        """What a state is, in words that mean the same in every worker."""
        return json.dumps(self._states[state], ensure_ascii=False, separators=(",", ":"))

    def entries(self, before: np.ndarray) -> list[int]:
        """States that the machine may be in after some characters, whatever came before them."""
        return sorted({self.run(before[k:])[0] for k in range(len(before) + 1)})

    def run_many(self, chars: np.ndarray, states: list[int]) -> dict[int, tuple[int, int]]:
        """For each state the state after some characters and the tokens counted; runs that meet go on as one."""
        ends = {s: (s, 0) for s in states}
        for low in range(0, len(chars), 256):
            part = chars[low : low + 256]
            moved = {s: self.run(part, s) for s in {e for e, _ in ends.values()}}
            ends = {s: (moved[e][0], n + moved[e][1]) for s, (e, n) in ends.items()}
        return ends

    def _settle(self) -> None:
        """Known transitions as sorted arrays, for many units at once."""
        if len(self._moves) > 1.1 * self._settled:
            keys = np.fromiter(self._moves, np.int64, len(self._moves))
            both = np.array(list(self._moves.values()), np.int64).reshape(-1, 2)
            order = np.argsort(keys)
            self._keys, self._to, self._delta = keys[order], both[order, 0], both[order, 1]
            self._settled = len(keys)

    def run_units(self, chars: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Token counts of many units, each from the start state."""
        total = np.zeros(len(start), np.int64)
        long = np.flatnonzero(size > 64)
        for k in long.tolist():
            total[k] = self.run(chars[start[k] : start[k] + size[k]])[1]
        at = np.flatnonzero(size <= 64)
        at = at[np.argsort(-size[at], kind="stable")]
        state = np.zeros(len(at), np.int64)
        for step in range(int(size[at].max(initial=0))):
            alive = int(np.searchsorted(-size[at], -step, "left"))
            at, state = at[:alive], state[:alive]
            key = state << 21 | chars[start[at] + step]
            self._settle()
            place = np.minimum(np.searchsorted(self._keys, key), max(len(self._keys) - 1, 0))
            known = self._keys[place] == key if len(self._keys) else np.zeros(len(key), bool)
            delta = np.zeros(len(key), np.int64)
            state = np.zeros(len(key), np.int64)
            state[known], delta[known] = self._to[place[known]], self._delta[place[known]]
            if not known.all():
                fresh, back = np.unique(key[~known], return_inverse=True)
                made = np.array([self.move(k >> 21, k & 0x1FFFFF) for k in fresh.tolist()], np.int64)
                state[~known], delta[~known] = made[back, 0], made[back, 1]
            total[at] += delta
        return total


class Counter:
    """Counts tokens of texts by units, remembering units it has seen."""

    def __init__(self, machine: Transducer):
        self.machine = machine
        self._hashes = np.zeros(0, np.uint64)
        self._counts = np.zeros(0, np.int32)

    def units(self, chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The token count of each unit."""
        power, inverse = _power_tables(len(chars))
        total = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum(mix(chars.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
        h = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
        unique, first, back = np.unique(h, return_index=True, return_inverse=True)
        counts = np.zeros(len(unique), np.int32)
        fresh = np.ones(len(unique), bool)
        if len(self._hashes):
            at = np.minimum(np.searchsorted(self._hashes, unique), len(self._hashes) - 1)
            fresh = self._hashes[at] != unique
            counts[~fresh] = self._counts[at[~fresh]]
        if fresh.any():
            begin = start[first[fresh]]
            counts[fresh] = self.machine.run_units(chars, begin, end[first[fresh]] - begin)
            if len(self._hashes) > REMEMBERED:
                self._hashes, self._counts = unique, counts
            else:
                both = np.concatenate([self._hashes, unique[fresh]])
                order = np.argsort(both, kind="stable")
                self._hashes, self._counts = both[order], np.concatenate([self._counts, counts[fresh]])[order]
        return counts[back]

    def texts(self, texts: list[str]) -> np.ndarray:
        """The token count of each text."""
        chars, lengths = _characters(texts)
        edges = np.concatenate([[0], np.cumsum(lengths)])
        starts = _resets(chars)
        starts[edges[:-1][lengths > 0]] = True
        start = np.flatnonzero(starts)
        end = np.append(start[1:], len(chars))
        counts = self.units(chars, start, end)
        summed = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        bounds = np.searchsorted(start, edges)
        return summed[bounds[1:]] - summed[bounds[:-1]]

    def state_map(self, chars: np.ndarray, before: np.ndarray) -> list[tuple[str, str, int]]:
        """The state map of a chunk that follows some characters (none: it begins the text): (state, state at the end, tokens)."""
        machine = self.machine
        states = machine.entries(before) if len(before) else [0]
        starts = _resets(chars)
        if len(before) and len(chars):
            starts[0] &= before[-1] != SPACE
        start = np.flatnonzero(starts)
        if not len(start):
            return [(machine.name(s), machine.name(e), n) for s, (e, n) in machine.run_many(chars, states).items()]
        # From the first reset on nothing depends on what came in.
        count = int(self.units(chars, start[:-1], start[1:]).sum()) if len(start) > 1 else 0
        end, more = machine.run(chars[start[-1] :])
        heads = machine.run_many(chars[: start[0]], states)
        return [(machine.name(s), machine.name(end), n + count + more) for s, (_, n) in heads.items()]

    def long_text(self, text: str, chunk: int = CHUNK) -> int:
        """The token count of one text, chunk after chunk."""
        state, total = 0, 0
        for low in range(0, len(text), chunk):
            chars = _characters([text[low : low + chunk]])[0]
            state, n = self.machine.run(chars[1:] if low else chars, state)
            total += n
        return total


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts, each with a space put before it unless empty, spaces as the model writes them."""
    spaced = [" " + t if t else "" for t in texts]
    chars = np.frombuffer("".join(spaced).encode("utf-32-le"), np.uint32).astype(np.int64)
    chars[chars == 0x20] = SPACE
    return chars, np.fromiter(map(len, spaced), np.int64, len(spaced))


def _resets(chars: np.ndarray) -> np.ndarray:
    space = chars == SPACE
    out = space.copy()
    out[1:] &= ~space[:-1]
    return out


_counters: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(Transducer.from_sentencepiece(path))
    counter = _counters[path]
    if counter.machine.states > STATES:
        counter.machine.forget()
    return counter


def _count(path: str, whole: bool):
    """Rows (row, place, text): bytes and tokens; ``whole`` says to count each text by itself, chunk after chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2).fill_null("")
            for low, high in slices(column, CHUNK):
                texts = column.slice(low, high - low).to_pylist()
                counter = _counter(path)
                tokens = [counter.long_text(t) for t in texts] if whole else counter.texts(texts)
                size = [len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([*(c.slice(low, high - low) for c in batch.columns[:2]), pa.array(size, pa.int64()), pa.array(tokens, pa.int64())], names=["row", "place", "n_bytes", "n_tokens"])

    return run


def _chunks(size: int, context: int):
    """Rows (place, text): (place, chunk, before, text), with the last characters before each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, low in enumerate(range(0, len(text), size)):
                    yield pa.RecordBatch.from_pydict({"place": [place], "chunk": pa.array([k], pa.int32()), "before": [text[max(0, low - context) : low]], "text": [text[low : low + size]]})

    return run


def _maps(path: str, size: int):
    """Rows (place, chunk, before, text): the state map of each chunk, an entry a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, chunk, before, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                chars = _characters([before + text])[0]
                if before:
                    # The space put before a text belongs to its begin only.
                    own = chars[1:] if chunk * size > len(before) else chars
                    head, chars = own[: len(own) - len(text)], own[len(own) - len(text) :]
                else:
                    head = chars[:0]
                found = _counter(path).state_map(chars, head)
                columns = [pa.array([place] * len(found)), pa.array([chunk] * len(found), pa.int32()), *(pa.array([x[k] for x in found]) for k in range(3))]
                yield pa.RecordBatch.from_arrays(columns, names=["place", "chunk", "begin", "end", "n"])

    return run


def composed(maps: DataFrame) -> DataFrame:
    """State maps (place, chunk, begin, end, n) of texts as one map for each text, in rounds that halve the chunks."""
    while (maps.agg(F.max("chunk")).first()[0] or 0) > 0:
        pair = maps.withColumn("half", F.floor(F.col("chunk") / 2).cast("int"))
        left = pair.where("chunk % 2 = 0").select("place", "half", "begin", F.col("end").alias("state"), F.col("n").alias("first"))
        right = pair.where("chunk % 2 = 1").select("place", "half", F.col("begin").alias("state"), "end", "n")
        # The last chunk of a text of odd length goes on alone.
        last = pair.groupBy("place").agg(F.max("chunk").alias("chunk")).where("chunk % 2 = 0")
        alone = pair.join(last, ["place", "chunk"], "left_semi").select("place", F.col("half").alias("chunk"), "begin", "end", "n")
        both = left.join(right, ["place", "half", "state"]).select("place", F.col("half").alias("chunk"), "begin", "end", (F.col("first") + F.col("n")).alias("n"))
        maps = written(both.union(alone))
    return maps


def token_counts(docs: DataFrame, model: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 4096) -> DataFrame:
    """The ``keep`` columns of each row, with n_bytes (UTF-8), n_tokens and over_limit.

    ``model`` is the path of a BPE vocabulary file that every executor has.
    Counts are those of its library without begin, end or other added tokens;
    strings of special tokens are ordinary text.  Null reads as empty, and an
    empty text has no tokens.  Texts of any length are counted whole; where the
    maps of a long text's chunks don't meet, as none of its last characters tells
    the state, it is counted chunk after chunk.  Columns to keep may not be
    called n_bytes, n_tokens or over_limit.  Repeated rows are counted one by
    one; an empty table gives an empty table.
    """
    if clash := {"n_bytes", "n_tokens", "over_limit"} & set(keep):
        raise ValueError(f"columns to keep are named as results are: {sorted(clash)}")
    text = F.col(text_col).cast("string")
    rows = small_batches(docs).select(F.struct(*keep).alias("row"), F.lit(0).cast("long").alias("place"), text.alias("text"))
    done = f"row {rows.schema['row'].dataType.simpleString()}, place long, n_bytes long, n_tokens long"
    is_long = F.octet_length("text") > CHUNK
    counted = rows.where(~F.coalesce(is_long, F.lit(False))).mapInArrow(_count(model, False), done).select("row", "n_bytes", "n_tokens")
    long = written(rows.where(is_long).withColumn("place", F.monotonically_increasing_id()))
    if not long.isEmpty():
        chunks = long.select("place", "text").mapInArrow(_chunks(CHUNK, BEFORE), "place long, chunk int, before string, text string").repartition("place", "chunk")
        maps = composed(written(chunks.mapInArrow(_maps(model, CHUNK), "place long, chunk int, begin string, end string, n long")))
        whole = long.join(maps.select("place", F.col("n").alias("n_tokens")), "place", "left")
        met = whole.where("n_tokens is not null").select("row", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens")
        rest = whole.where("n_tokens is null").select("row", "place", "text").mapInArrow(_count(model, True), done).select("row", "n_bytes", "n_tokens")
        counted = counted.union(met).union(rest)
    return counted.select("row.*", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
