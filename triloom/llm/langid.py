"""Language identification by segmentation-marginalised unigram models.

The pieces of a fixed public vocabulary (its letter pieces, lower-cased) get a
probability for each language.  A word is scored by the forward algorithm: the
sum, over all ways to cut it into pieces, of the products of their
probabilities.  The models are learned by expectation-maximisation with
forward-backward counts, from a prior that falls with a piece's rank.

A text is the sequence of its words (runs of letters, each with the mark of a
word's begin); equal words of a batch are scored once, all of a batch side by
side.  A word of over ``LONGEST`` letters goes through the same sums by itself, in
logarithms, so that words of any length are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches
from .text import _power_tables, mix, slices

MARK = 0x2581
#: Letters of the words that are scored side by side; sums over longer ones would underflow.
LONGEST = 40
#: Letters of a batch, and words a worker remembers (times languages).
CHUNK, REMEMBERED = 1 << 20, 1 << 22
UNKNOWN = 1e-6

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _hashes(chars: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``_span`` takes the hash of any range."""
    power, _ = _power_tables(len(chars))
    total = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(mix(chars.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
    return total


def _span(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inverse = _power_tables(len(total))
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


class Pieces:
    """The letter pieces of a vocabulary, found by hash."""

    def __init__(self, pieces: list[str]):
        seen: dict[str, None] = {}
        for p in pieces:
            bare = p.removeprefix(chr(MARK))
            if (bare or p == chr(MARK)) and (not bare or bare.isalpha()):
                seen.setdefault(p.lower(), None)
        self.pieces = list(seen)
        self.longest = max(map(len, self.pieces), default=1)
        chars = np.frombuffer("".join(self.pieces).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, self.pieces), np.int64, len(self.pieces))
        end = np.cumsum(size)
        h = _span(_hashes(chars), end - size, end)
        self._order = np.argsort(h)
        self._sorted = h[self._order]
        self._maybe = np.zeros(1 << 22, bool)
        self._maybe[(h >> np.uint64(42)).astype(np.int64)] = True

    @classmethod
    def from_sentencepiece(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return cls([model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of pieces by hash; the number after the last where there is none."""
        out = np.full(len(h), len(self.pieces), np.int64)
        at = np.flatnonzero(self._maybe[(h >> np.uint64(42)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self._sorted, h[at]), len(self._sorted) - 1)
        hit = self._sorted[place] == h[at]
        out[at[hit]] = self._order[place[hit]]
        return out

    def prior(self) -> np.ndarray:
        """Probabilities that fall with the rank, one column."""
        p = 1.0 / (np.arange(len(self.pieces)) + 20.0)
        return (p / p.sum())[:, None]


class Lattice:
    """All segmentations of many words into pieces."""

    def __init__(self, pieces: Pieces, chars: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.order = np.argsort(-size, kind="stable")
        self.size = size[self.order]
        start = start[self.order]
        self.most = int(size.max(initial=0))
        self.alive = [int(np.searchsorted(-self.size, -i, "right")) for i in range(self.most + 1)]
        total = _hashes(chars)
        none = len(pieces.pieces)
        #: (end, begin, piece numbers of the words that reach the end)
        self.arcs: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(self.most + 1)]
        for i in range(1, self.most + 1):
            begin = start[: self.alive[i]]
            for s in range(i - 1, max(-1, i - pieces.longest - 1), -1):
                found = pieces.find(_span(total, begin + s, begin + i))
                if s == i - 1:
                    found[found == none] = none + 1
                if (found != none).any():
                    self.arcs[i].append((s, found))

    def forward(self, table: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Sums over segmentations up to each place, and of whole words (in the given order)."""
        alpha = [np.ones((len(self.size), table.shape[1]))]
        for i in range(1, self.most + 1):
            now = np.zeros((self.alive[i], table.shape[1]))
            for s, found in self.arcs[i]:
                now += alpha[s][: self.alive[i]] * table[found]
            alpha.append(now)
        whole = np.ones((len(self.size), table.shape[1]))
        for i in range(1, self.most + 1):
            ends = slice(self.alive[i + 1] if i < self.most else 0, self.alive[i])
            whole[ends] = alpha[i][ends]
        out = np.empty_like(whole)
        out[self.order] = whole
        return alpha, out

    def expected(self, table: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected counts of pieces, words weighted by ``times``; table has one column."""
        alpha, whole = self.forward(table)
        weight = (times / np.maximum(whole[:, 0], 1e-300))[self.order]
        beta = [np.zeros(a) for a in self.alive]
        counts = np.zeros(len(table))
        for i in range(self.most, 0, -1):
            ends = slice(self.alive[i + 1] if i < self.most else 0, self.alive[i])
            beta[i][ends] = 1.0
            n = self.alive[i]
            for s, found in self.arcs[i]:
                arc = table[found, 0] * beta[i]
                beta[s][:n] += arc
                counts += np.bincount(found, alpha[s][:n, 0] * arc * weight[:n], len(table))
        return counts


class LongWord:
    """All segmentations of one word of any length, in logarithms."""

    def __init__(self, pieces: Pieces, chars: np.ndarray):
        n, none = len(chars), len(pieces.pieces)
        total = _hashes(chars)
        #: For each end, and each length of a last piece, the number of the piece.
        self.found = np.full((n + 1, pieces.longest), none, np.int64)
        for size in range(1, min(pieces.longest, n) + 1):
            begin = np.arange(n - size + 1)
            self.found[size:, size - 1] = pieces.find(_span(total, begin, begin + size))
        self.found[1:, 0][self.found[1:, 0] == none] = none + 1
        self.longest = pieces.longest

    def _sums(self, log: np.ndarray) -> np.ndarray:
        """Logarithms of the sums over segmentations up to each place; ``log`` has one row for each piece."""
        out = np.full((len(self.found), log.shape[1]), -np.inf)
        out[0] = 0.0
        for i in range(1, len(out)):
            size = min(i, self.longest)
            out[i] = np.logaddexp.reduce(out[i - size : i][::-1] + log[self.found[i, :size]])
        return out

    def score(self, table: np.ndarray) -> np.ndarray:
        """The logarithm of the sum over all segmentations, for each language."""
        with np.errstate(divide="ignore"):
            return self._sums(np.log(table))[-1]

    def expected(self, table: np.ndarray, times: float) -> np.ndarray:
        """Expected counts of pieces; table has one column."""
        with np.errstate(divide="ignore"):
            log = np.log(table)
        ahead = self._sums(log)[:, 0]
        n = len(ahead) - 1
        behind = np.full(n + 1, -np.inf)
        behind[n] = 0.0
        counts = np.zeros(len(table))
        for i in range(n, 0, -1):
            size = min(i, self.longest)
            found = self.found[i, :size]
            begin = np.arange(i - 1, i - 1 - size, -1)
            arc = log[found, 0] + behind[i]
            behind[begin] = np.logaddexp(behind[begin], arc)
            np.add.at(counts, found, times * np.exp(ahead[begin] + arc - ahead[n]))
        return counts


@dataclass
class Model:
    """Probabilities of pieces by language; the two last rows are no piece and unknown letters."""

    languages: list[str]
    table: np.ndarray


def _table(p: np.ndarray) -> np.ndarray:
    columns = p.shape[1]
    return np.concatenate([p, np.zeros((1, columns)), np.full((1, columns), UNKNOWN)])


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts; begin, end and text of each word."""
    low = [t.lower() for t in texts]
    chars = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32).astype(np.int64)
    edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, low), np.int64, len(low)))])
    inside = np.zeros(len(chars) + 2, bool)
    inside[1:-1] = letters()[chars]
    edge = np.zeros(len(chars) + 1, bool)
    edge[edges] = True
    start = np.flatnonzero((inside[1:] & (~inside[:-1] | edge))[:-1])
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return chars, start, end, np.searchsorted(edges, start, "right") - 1


def _marked(chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Some words one after the other, each with the mark of a word's begin."""
    size = end - start
    first = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
    out = np.full(int((size + 1).sum()), MARK, np.int64)
    at = np.repeat(start - (first + 1), size) + _runs(first + 1, size)
    out[_runs(first + 1, size)] = chars[at]
    return out, first, size + 1


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    before = np.concatenate([[0], np.cumsum(size)])[:-1]
    return np.arange(int(size.sum())) + np.repeat(first - before, size)


_pieces: dict[str, Pieces] = {}


def _vocabulary(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces.from_sentencepiece(path)
    return _pieces[path]


def _learn(path: str, model: Model | None, languages: list[str]):
    """Rows (lang, text): expected counts (lang, piece, n) of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _vocabulary(path)
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for low, high in slices(batch.column(1), CHUNK):
                langs = batch.column(0).slice(low, high - low).to_pylist()
                chars, start, end, text = _words(batch.column(1).slice(low, high - low).to_pylist())
                if not len(start):
                    continue
                h = _span(_hashes(chars), start, end)
                for lang in sorted(set(langs)):
                    mine = np.flatnonzero(np.array([x == lang for x in langs])[text])
                    if not len(mine):
                        continue
                    _, first, times = np.unique(h[mine], return_index=True, return_counts=True)
                    held, long = mine[first], (end - start)[mine[first]] > LONGEST
                    lattice = Lattice(pieces, *_marked(chars, start[held[~long]], end[held[~long]]))
                    table = _table(pieces.prior()) if model is None else model.table[:, [languages.index(lang)]]
                    counts[lang] = counts.get(lang, 0) + lattice.expected(table, times[~long])
                    for k, n in zip(held[long], times[long], strict=True):
                        counts[lang] += LongWord(pieces, _marked(chars, start[[k]], end[[k]])[0]).expected(table, n)
        for lang, n in counts.items():
            at = np.flatnonzero(n[: len(pieces.pieces)] > 0)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(n[at])], names=["lang", "piece", "n"])

    return run


def fit(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 3000, rounds: int = 2) -> Model:
    """Piece probabilities of every language of the labelled rows given.

    A language with more than about ``per_language`` rows is learned from that
    many, chosen by a hash of the id; languages with fewer from all of theirs.
    Rows with a null text or language are left out.  What comes to the driver is
    one number for each language and piece of the fixed vocabulary.
    """
    named = small_batches(docs).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    found = {r[0]: r[1] for r in named.groupBy("lang").count().collect()}
    languages = sorted(found)
    if not languages:
        return Model([], np.zeros((0, 0)))
    steps = 1 << 20
    share = F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(steps, -(-per_language * steps // found[lang])))))
    some = named.where(F.pmod(F.xxhash64("id"), F.lit(steps)) < share[F.col("lang")]).select("lang", "text")
    pieces = _vocabulary(vocabulary)
    model = None
    for _ in range(rounds):
        counts = np.zeros((len(pieces.pieces), len(languages)))
        gathered = some.mapInArrow(_learn(vocabulary, model, languages), "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        for lang, piece, n in gathered.collect():
            counts[piece, languages.index(lang)] = n
        shared = pieces.prior() * 0.5 + 0.5 * (counts.sum(1) / max(counts.sum(), 1e-9))[:, None]
        p = (counts + 50.0 * shared) / (counts.sum(0) + 50.0)
        model = Model(languages, _table(p))
    return model


class Scorer:
    """Log-likelihoods of texts by language, remembering words it has seen."""

    def __init__(self, pieces: Pieces, model: Model):
        self.pieces, self.model = pieces, model
        self._hash = np.zeros(0, np.uint64)
        self._score = np.zeros((0, len(model.languages)), np.float32)

    def words(self, chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the distinct words, and which of them each word is."""
        h = _span(_hashes(chars), start, end)
        unique, first, back = np.unique(h, return_index=True, return_inverse=True)
        scores = np.zeros((len(unique), len(self.model.languages)), np.float32)
        fresh = np.ones(len(unique), bool)
        if len(self._hash):
            at = np.minimum(np.searchsorted(self._hash, unique), len(self._hash) - 1)
            fresh = self._hash[at] != unique
            scores[~fresh] = self._score[at[~fresh]]
        if fresh.any():
            held = first[fresh]
            long = end[held] - start[held] > LONGEST
            lattice = Lattice(self.pieces, *_marked(chars, start[held[~long]], end[held[~long]]))
            made = np.empty((len(held), scores.shape[1]))
            made[~long] = np.log(np.maximum(lattice.forward(self.model.table)[1], 1e-300))
            for k in np.flatnonzero(long):
                made[k] = LongWord(self.pieces, _marked(chars, start[held[[k]]], end[held[[k]]])[0]).score(self.model.table)
            scores[fresh] = made
            if len(self._hash) * max(1, scores.shape[1]) > REMEMBERED:
                self._hash, self._score = unique, scores
            else:
                both = np.concatenate([self._hash, unique[fresh]])
                order = np.argsort(both, kind="stable")
                self._hash, self._score = both[order], np.concatenate([self._score, scores[fresh]])[order]
        return scores, back

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods (text by language), and how many words each text has."""
        chars, start, end, text = _words(texts)
        total = np.zeros((len(texts), len(self.model.languages)))
        if len(start) and total.shape[1]:
            scores, back = self.words(chars, start, end)
            for k in range(total.shape[1]):
                total[:, k] = np.bincount(text, scores[back, k], len(texts))
        return total, np.bincount(text, minlength=len(texts))


def _predict(path: str, held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        scorer = Scorer(_vocabulary(path), model)
        for batch in batches:
            column = batch.column(1).fill_null("")
            for low, high in slices(column, CHUNK):
                total, words = scorer.texts(column.slice(low, high - low).to_pylist())
                if model.languages:
                    best = total.argmax(1)
                    score = 1.0 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                else:
                    best, score, words = words, words * 0.0, words * 0
                names = [model.languages[b] if n else "und" for b, n in zip(best, words, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(names, pa.string()), pa.array(np.where(words > 0, score, 0.0))], names=["row", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, vocabulary: str, text_col: str = "text") -> DataFrame:
    """Each row of ``docs`` as ``row`` (a struct of all its columns), with lang_pred and score.

    lang_pred is the likeliest language of the model, the first by name of equal
    ones, and score its probability if all languages are equally likely before.
    A text that is null, empty or without a letter gets ``und`` and 0, and so
    does every text under a model without languages.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = small_batches(docs).select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_predict(vocabulary, held), f"row {kind}, lang_pred string, score double")


def keep_known(docs: DataFrame, vocabulary: str, least: float = 0.5, per_language: int = 3000) -> DataFrame:
    """``docs`` without rows whose language is undetermined or less likely than ``least``.

    Null and empty texts, and texts without letters, are undetermined.  Repeated
    rows go or stay together, other columns are left as they are, and an empty
    table gives an empty table.  Without any labelled row all rows go.
    """
    found = predict(docs, fit(docs, vocabulary, per_language=per_language), vocabulary)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")
