"""The whole job: nothing of the input is sampled, capped or lost."""

import math
import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm.test_operators import brute_groups, brute_vectors
from triloom.llm import jaccard, lm, vectors
from triloom.llm.text import NON_SPACE, scan


def table(spark, rows, kind="doc_id long, text string"):
    return spark.createDataFrame(rows, kind)


# --- 4


def traversed(monkeypatch):
    """The members of each round of blocks, as they are counted."""
    seen, real = [], jaccard._traverse

    def watched(members, *rest):
        seen.append(members.groupBy("block").count().collect())
        return real(members, *rest)

    monkeypatch.setattr(jaccard, "_traverse", watched)
    return seen


def test_texts_with_a_common_line_do_not_meet_for_it(spark, monkeypatch):
    line = lambda k: " ".join(f"line{k}x{j}" for j in range(8))
    texts = [" ".join([*(f"w{i}x{j}" for j in range(12)), line(i % 400)]) for i in range(6000)]
    texts += [f"{texts[i]} more" for i in range(0, 6000, 1000)]
    seen = traversed(monkeypatch)
    got = {r.doc_id: r.component_id for r in jaccard.similar_groups(table(spark, list(enumerate(texts))), words=4, percent=85).collect()}
    assert got == {i: i if i < 6000 else (i - 6000) * 1000 for i in range(len(texts))}
    assert sum(r["count"] for r in seen[0]) < 100


def test_few_members_outside_a_large_component_meet_it_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 64)
    base = [f"w{j}" for j in range(200)]
    near = [" ".join([*base, f"end{i}"]) for i in range(600)]
    # One word of 29 is another: similarities of about 0.75.
    far = [" ".join(f"far{i}x{j}" if j % 29 == 0 else w for j, w in enumerate(base)) for i in range(12)]
    texts = [*near, *far, far[0].replace("w5 ", "other ")]
    monkeypatch.setattr(jaccard, "LEAST", 1 << 30)
    seen = traversed(monkeypatch)
    docs = table(spark, list(enumerate(texts)))
    got = {r.doc_id: r.component_id for r in jaccard.similar_groups(docs, words=4, percent=85).collect()}
    assert got == brute_groups(texts, 4, 85)[1]
    assert len(seen) == 2 and sum(r["count"] for r in seen[1]) < 4 * len(texts)
    assert max(r["count"] for r in seen[1]) <= 2 * jaccard.BLOCK


# --- 9


def test_most_pivots_take_little_memory():
    points = np.random.default_rng(3).standard_normal((4096, 64))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    raw = [p.tobytes() for p in points[:512]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(512), pa.int64()), pa.array([1] * 512, pa.int64()), pa.array(raw, pa.binary())], names=["id", "times", "vec"])
    run = vectors._assign({64: points}, math.acos(0.95), np.float64)
    tracemalloc.start()
    (got,) = run(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == 512 and peak < 200e6


def test_points_are_sent_to_few_cells():
    points = np.random.default_rng(4).standard_normal((4000, 64))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    eps = math.acos(0.95)
    pivots = vectors.best_pivots(points, 600_000, eps)
    reached = vectors._reach(points @ pivots.T, vectors._apart(pivots), eps)[1]
    assert reached.sum() <= 5 * len(points)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_large_cells_in_several_broadcasts(spark, monkeypatch, kind):
    for name, value in {"BLOCK": 30, "SHARD": 3, "TILE": 7, "BATCH": 11, "CELLS": (40, 120), "COPIES": 100}.items():
        monkeypatch.setattr(vectors, name, value)
    r = np.random.default_rng(8)
    centres = r.standard_normal((6, 16))
    rows = (centres[r.choice(6, 400, p=[0.5, 0.2, 0.2, 0.05, 0.03, 0.02])] + r.standard_normal((400, 16)) * r.choice([0.05, 0.2, 1], (400, 1))).astype(np.float32).tolist()
    rows = list(enumerate([*rows, *rows[:20], None, [0.0] * 16, *r.standard_normal((80, 3)).astype(np.float32).tolist()]))
    shards, real = [], vectors._pass
    monkeypatch.setattr(vectors, "_pass", lambda shard, *rest: shards.append(len(shard.value)) or real(shard, *rest))
    got = {x.vec_id: x for x in vectors.near_duplicates(table(spark, rows, f"vec_id long, embedding array<{kind}>")).collect()}
    n, want = brute_vectors(rows)
    assert {i: (x.n_links, x.component_id, x.kept) for i, x in got.items()} == {i: (n[i], want[i], want[i] == i) for i in n}
    assert len(shards) > 2 and max(shards) == 3


# --- 10


def test_words_outside_the_vocabulary_have_their_own_frequency(spark, monkeypatch):
    monkeypatch.setattr(lm, "WORDS", 1)
    words = [f"x{k}" for k in range(2000)]
    bucket = (scan(pa.array(words), NON_SPACE).hash >> np.uint64(58)).tolist()
    some, rare, unseen = [w for w, b in zip(words, bucket, strict=True) if b == bucket[0]][:3]
    # The root of 409 words is 20: the others share buckets in the network.
    learn = table(spark, [(0, " ".join([f"often{k}" for k in range(20)] * 20)), (1, " ".join([some] * 8 + [rare]))])
    docs = table(spark, [(0, some), (1, rare), (2, unseen), (3, f"{rare} {rare}"), (4, f"{some} {rare}")])
    got = {r.row.doc_id: r for r in lm.score(docs, learn=learn).collect()}
    score = lambda k: got[k].log_likelihood
    assert math.isclose(score(0) - score(1), math.log(8), rel_tol=1e-5)
    assert math.isclose(score(1), score(2), rel_tol=1e-6)
    assert math.isclose(score(4) - score(3), math.log(8), rel_tol=1e-5) and math.isclose(got[4]["mean"], score(4) / 2)


def test_vocabulary_grows_with_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(lm, "WORDS", 4)
    texts = [(k, " ".join(f"w{j}" for j in range(k % 90 + 1))) for k in range(180)]
    vocabulary, _, counts = lm.fit(table(spark, texts))
    n = Counter(w for _, t in texts for w in t.split())
    assert len(vocabulary.hashes) >= 0.8 * math.isqrt(n.total()) > 4
    assert sorted(r.n for r in counts.collect()) == sorted(n.values())


@pytest.mark.parametrize("chunk", [1 << 16, 70])
def test_every_word_of_every_text_is_trained_on(monkeypatch, chunk):
    monkeypatch.setattr(lm, "CHUNK", chunk)
    texts = pa.array(["one two three", "four", None, "", "five six seven eight nine ten", "w " * 3000])
    found = scan(texts, NON_SPACE)
    vocabulary = lm.Vocabulary.of_counts(np.unique(found.hash), np.arange(1, len(set(found.hash.tolist())) + 1), 1)
    seen = Counter()
    step = lm.Network.step

    def watched(self, tokens, skip=False, rate=lm.RATE):
        inner = tokens[:, lm.REACH : -lm.REACH].ravel()
        for k in np.flatnonzero((inner != self.edge) & ~skip):
            row, at = divmod(int(k), tokens.shape[1] - 2 * lm.REACH)
            seen[tuple(tokens[row, at : at + 2 * lm.REACH + 1].tolist())] += 1
        return step(self, tokens, skip, rate)

    monkeypatch.setattr(lm.Network, "step", watched)
    (made,) = lm._tokenise(SimpleNamespace(value=vocabulary))(iter([pa.RecordBatch.from_arrays([pa.array([0] * 6, pa.int32()), pa.array(range(6), pa.int64()), texts], names=["shard", "key", "text"])]))
    out = list(lm._train(SimpleNamespace(value=vocabulary), None)(iter([made])))
    tokens, bounds = vocabulary.tokens(found.hash)[0], found.bounds()
    want = Counter()
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        line = [vocabulary.edge] * lm.REACH + tokens[low:high].tolist() + [vocabulary.edge] * lm.REACH
        want.update(tuple(line[k : k + 2 * lm.REACH + 1]) for k in range(high - low))
    assert seen == want
    assert set(out[0].column("n").to_pylist()) == {len(tokens)}


def plain_scores(network, vocabulary, n, texts):
    """Scores by loops over words."""
    embed, *node, scale = (p.astype(float) for p in network.parameters()[: lm.LEVELS + 2])
    branch = [p.astype(float) for p in network.branch]

    def soft(z):
        z = np.exp(z - z.max())
        return z / z.sum()

    out = []
    for text in texts:
        h = scan(pa.array([text or ""]), NON_SPACE).hash
        tokens, far = vocabulary.tokens(h)
        total = 0.0
        for k, t in enumerate(tokens.tolist()):
            near = [tokens[k + d] if 0 <= k + d < len(tokens) else vocabulary.edge for d in (-2, -1, 1, 2)]
            hidden = np.tanh(sum(embed[x] * scale[j] for j, x in enumerate(near)))
            for level in range(lm.LEVELS):
                up, digit = divmod(t // vocabulary.side ** (lm.LEVELS - 1 - level), vocabulary.side)
                total += math.log(soft((hidden * node[level][up]) @ branch[level] + vocabulary.base[level][up])[digit])
            if far[k]:
                total += math.log(max(1, n.get(int(h[k].astype(np.int64)), 0))) - vocabulary.masses[int(h[k]) >> 58]
        out.append((len(tokens), total))
    return out


def test_scores_are_those_of_plain_loops_however_rows_are_dealt(spark, monkeypatch):
    for name, value in {"WORDS": 60, "SHARD": 3000, "CHUNK": 700, "LOOKUP": 2000, "RANGE": 64}.items():
        monkeypatch.setattr(lm, name, value)
    rnd = random.Random(10)
    texts = [" ".join(rnd.choice([f"a{rnd.randrange(40)}", f"b{rnd.randrange(900)}"]) for _ in range(rnd.randrange(70))) for _ in range(300)] + [None, "", " ", "A1 a1", "never seen", "b7 " * 3000]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(0, texts[0], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mean string").coalesce(1)
    vocabulary, flat, counts = lm.fit(docs)
    assert vocabulary.edge < 200 and counts.count() > 400
    n = {r.word: r.n for r in counts.collect()}
    want = plain_scores(lm.Network(vocabulary).load(flat), vocabulary, n, texts)
    for dealt in (docs, docs.repartition(64)):
        got = lm.score(dealt).collect()
        assert len(got) == len(rows)
        for r in got:
            words, log = want[r.row.doc_id]
            assert r.n_words == words and math.isclose(r.log_likelihood, log, rel_tol=2e-4, abs_tol=1e-6), r
            assert (r["mean"] is None) == (words == 0)
    few = lm.score(docs, keep=("doc_id",))
    assert few.schema["row"].dataType.names == ["doc_id"] and few.count() == len(rows)


# --- pipeline


def test_one_row_of_each_group_whatever_the_ids(spark):
    text = lambda w: " ".join(f"{w}{k}" for k in range(40))
    rows = [
        *[(1, text("a"), "en")] * 3,  # a file read twice
        (None, text("a"), "en"),
        (None, text("b"), "en"),
        (None, text("b") + " more", "en"),
        (5, text("a"), "de"),  # an id on two texts
        (5, text("c"), None),
        (None, text("d"), None),
        (None, text("e"), None),
        (8, None, None),
        (8, None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(((r.doc_id, (r.text or "-")[0]) for r in got), key=str) == sorted([(1, "a"), (None, "b"), (5, "c"), (None, "d"), (None, "e"), (8, "-"), (8, "-")], key=str)
