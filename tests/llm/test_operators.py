"""Each operator against brute force, with odd rows: nulls, empty and long texts, ties, repeats, empty tables."""

import hashlib
import json
import math
import random
import re
import time
from fractions import Fraction
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from triloom.llm import chat, decontaminate, jaccard, langid, lm, mixing, pii, tokencount, urlfilter, vectors
from triloom.llm.components import components

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def table(spark, rows, kind="doc_id long, text string"):
    return spark.createDataFrame(rows, kind)


def words_of(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (text or "").translate(UP))


def roots(links, ids):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# --- components


def test_components(spark):
    rnd = random.Random(1)
    links = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    got = {r.id: r.component for r in components(table(spark, links, "a long, b long"), "a", "b").collect()}
    ids = {x for p in links if p[0] != p[1] for x in p}
    assert got == {i: c for i, c in roots(links, ids).items()}
    assert components(table(spark, [], "a long, b long"), "a", "b").count() == 0


# --- 1


def judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    bare = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, _, tail = bare.partition("/")
    path = "/" + tail if "/" in bare else ""
    host = host.translate(UP)
    best = None
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        p = "/" + p if "/" in rule else ""
        if h and (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (-1,), (len(rule), len(h), verdict == "block", rule, verdict))
    return host, path, best[3] if best else None, best[4] if best else "allow"


URLS = [None, "", "nothing", "http://", "HTTP://A.Example.ORG/es/1?x#y", "https://example.org", "https://example.org/", "http://example.org:80/es/", "http://xexample.org/es/", "http://b.a.example.org/en/12", "http://c.com/fr/a/b", "http://c.com/de/", "http://org/", "http://..org/x", "http://é.com/fr/é", "http://u?q/p", "a://b://c/d"]


def test_url_rules(spark):
    rules = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"), ("a.example.org/", "block"), ("com/fr/a/", "block"), ("com/fr/a/b", "allow"), ("com/fr/a/b", "block"), ("/x", "block")]
    urls = URLS * 40 + [f"http://h{i % 7}.s{i % 3}.com/{'fr' if i % 2 else 'de'}/a/{i}" for i in range(500)]
    pages = table(spark, [(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(pages, table(spark, rules, "rule string, verdict string")).collect()}
    assert got == {i: judge(u, rules) for i, u in enumerate(urls)}
    assert urlfilter.judge_urls(pages.limit(0), table(spark, rules, "rule string, verdict string")).count() == 0
    assert {r.verdict for r in urlfilter.judge_urls(pages, table(spark, [], "rule string, verdict string"), default="block").collect()} == {"block"}


def test_rules_are_swept_as_one_stream():
    """No more rules are held than those of the open hosts; names of results can't be kept."""
    sweep = urlfilter.Sweep()
    for k in range(1000):
        sweep.open(f"com.h{k:04}.", "/", f"h{k:04}.com/", "block")
        assert len(sweep.stack) == 1
    assert sweep.judge("com.h0999.a.", "/x") == ("h0999.com/", "block") and sweep.judge("com.z.", "/") is None
    with pytest.raises(ValueError):
        urlfilter.judge_urls(SimpleNamespace(), None, keep=("page_id", "host"))


# --- 2


def docs_for_mixing(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(3000):
        source = "hot" if i % 3 == 0 else f"s{rnd.randrange(8)}"
        rows.append((i, " ".join(["w"] * rnd.randrange(1, 40)) + (" All rights reserved" if i % 5 == 0 else ""), rnd.choice(["en", "en", "de", None]), source))
    return table(spark, [*rows, (9001, None, "en", "s1"), (9002, "", None, None)], "doc_id long, text string, lang string, source string")


def test_mixing(spark):
    docs = docs_for_mixing(spark)
    mixture = mixing.Mixture(targets={"lang": {"en": 0.4, "de": 0.4, "(none)": 0.2}})
    got = mixing.probabilities(docs, mixture).toPandas()
    n, p = got.n_tokens.to_numpy(float), got.probability.to_numpy(float)
    assert len(got) == 3002 and not got[got.n_tokens == 0].kept.any()
    assert (n * p).sum() == pytest.approx(mixture.part * n.sum(), rel=1e-3)
    # Raking by plain loops.
    cells = got.groupby(["source", "lang", "topic"]).n_tokens.sum()
    cells = cells[cells > 0].astype(float)
    w = cells / cells.sum()
    for _ in range(mixture.rounds):
        for d in mixing.DIMENSIONS:
            own = cells.groupby(level=d).sum()
            target = pd.Series(mixture.targets["lang"]) if d == "lang" else own ** mixture.tempers[d]
            target = target / target.sum()
            w = w * (target / w.groupby(level=d).sum()).reindex(w.index.get_level_values(d)).to_numpy()
    rate = w / cells
    low, high = 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (cells * np.minimum(1, rate * mid)).sum() < mixture.part * cells.sum() else (low, mid)
    want = np.minimum(1, rate * low)
    both = got[got.n_tokens > 0].apply(lambda r: (r.probability, want[r.source, r.lang, r.topic]), axis=1)
    assert all(abs(a - b) < 2e-6 for a, b in both)
    again = mixing.mixed(docs, mixture)
    assert again.columns == docs.columns
    assert {r.doc_id for r in again.collect()} == set(got[got.kept].row.map(lambda r: r.doc_id))
    assert mixing.probabilities(docs.limit(0)).count() == 0


def test_small_parts_and_clashing_names(spark):
    docs = docs_for_mixing(spark).withColumn("topic", F.lit("own")).withColumn("row", F.lit(1)).withColumn("probability", F.lit("x"))
    docs = docs.union(docs.where("doc_id = 7"))
    got = mixing.probabilities(docs, mixing.Mixture(part=4e-7), keep=("doc_id", "source", "topic", "probability")).toPandas()
    n, p = got.n_tokens.to_numpy(float), got.probability.to_numpy(float)
    assert (p[n > 0] > 0).all() and (n * p).sum() == pytest.approx(4e-7 * n.sum(), rel=1e-6)
    assert got.row[0].topic == "own" and len(got) == 3003
    long = docs.limit(1).withColumn("text", F.repeat(F.lit("word "), 400_000))
    kept = mixing.mixed(docs.union(long), mixing.Mixture(part=1.0))
    assert kept.columns == docs.columns and kept.count() == 3002


# --- 3


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces(["▁a", "▁ab", "b", "a", "ab", "c", "▁", "bc"])
    table_ = langid._table(np.random.default_rng(0).random((len(pieces.pieces), 2)) / 4)
    p = {x: table_[k] for k, x in enumerate(pieces.pieces)}

    def whole(text):
        if not text:
            return np.ones(2)
        total = np.zeros(2)
        for k in range(1, len(text) + 1):
            piece = text[:k]
            if piece in p:
                total = total + p[piece] * whole(text[k:])
            elif k == 1:
                total = total + langid.UNKNOWN * whole(text[k:])
        return total

    texts = ["▁ab", "▁abc", "▁zab", "▁abab", "▁c"]
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    size = np.array([len(t) for t in texts])
    lattice = langid.Lattice(pieces, chars, np.cumsum(size) - size, size)
    got = lattice.forward(table_)[1]
    assert np.allclose(got, [whole(t) for t in texts])
    counts = lattice.expected(table_[:, [0]], np.ones(len(texts)))
    eps = 1e-6
    for k, x in enumerate(pieces.pieces):
        moved = table_[:, [0]].copy()
        moved[k] *= 1 + eps
        slope = (np.log(lattice.forward(moved)[1]).sum() - np.log(lattice.forward(table_[:, [0]])[1]).sum()) / eps
        assert counts[k] == pytest.approx(slope, abs=1e-4), x


def plain_score(word, pieces, table_):
    """The log of the sum over all segmentations of a marked word, by a loop with exact numbers."""
    number = {x: k for k, x in enumerate(pieces.pieces)}
    out = []
    for lang in range(table_.shape[1]):
        sums = [Fraction(1)]
        for i in range(1, len(word) + 1):
            total = Fraction(0)
            for size in range(1, min(i, pieces.longest) + 1):
                k = number.get(word[i - size : i], len(number) + 1 if size == 1 else None)
                if k is not None:
                    total += sums[i - size] * Fraction(float(table_[k, lang]))
            sums.append(total)
        out.append(math.log(sums[-1].numerator) - math.log(sums[-1].denominator))
    return out


@pytest.mark.parametrize("size", [41, 90, 10_000])
def test_words_of_any_length_are_scored_whole(size):
    pieces = langid.Pieces(["▁a", "▁ab", "b", "a", "ab", "c", "▁", "bc", "abcab"])
    table_ = langid._table(np.round(np.random.default_rng(0).random((len(pieces.pieces), 2)) * 1024) / 4096)
    table_[-1] = 2.0**-20
    rnd = random.Random(3)
    word = "".join(rnd.choice("abcabcz") for _ in range(size))
    scorer = langid.Scorer(pieces, langid.Model(["x", "y"], table_))
    got, words = scorer.texts([word, "ab", word + "1"])
    assert words.tolist() == [1, 1, 1]
    if size > 1000:
        # In floating point with a scale, place by place.
        number = {x: k for k, x in enumerate(pieces.pieces)}
        want = []
        for lang in range(2):
            sums, scale = [1.0], 0.0
            marked = "▁" + word
            for i in range(1, len(marked) + 1):
                total = 0.0
                for n in range(1, min(i, pieces.longest) + 1):
                    k = number.get(marked[i - n : i], len(number) + 1 if n == 1 else None)
                    if k is not None:
                        total += sums[-n] * table_[k, lang]
                sums = [*sums[-pieces.longest :], total]
                if total < 1e-100:
                    sums, scale = [x * 1e100 for x in sums], scale - 100 * math.log(10)
            want.append(math.log(sums[-1]) + scale)
    else:
        want = plain_score("▁" + word, pieces, table_)
    assert np.allclose(got[0], want, rtol=1e-5) and np.allclose(got[2], want, rtol=1e-5)
    one = langid.LongWord(pieces, np.array([ord(c) for c in "▁" + word[:60]]))
    many = langid.Lattice(pieces, np.array([ord(c) for c in "▁" + word[:60]]), np.array([0]), np.array([len(word[:60]) + 1]))
    assert np.allclose(one.expected(table_[:, [0]], 3.0), many.expected(table_[:, [0]], np.array([3.0])))


def test_predictions_are_those_of_plain_sums(spark):
    pieces = langid._vocabulary(MODEL)
    r = np.random.default_rng(4)
    model = langid.Model(["de", "en", "fr"], langid._table(r.dirichlet(np.full(len(pieces.pieces), 0.5), 3).T))
    texts = ["Hello wörld", "one two, Two", "x" * 60 + " y", "", None, "123", "日本 語"]
    docs = table(spark, [(i, t, "en", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string, score double")
    got = {x.row.doc_id: x for x in langid.predict(docs, model, MODEL).select("row", F.col("lang_pred"), F.col("score")).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\W\d_]+", (t or "").lower())
        if not words:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        total = np.sum([plain_score("▁" + w, pieces, model.table) for w in words], 0)
        assert got[i].lang_pred == model.languages[int(total.argmax())]
        assert got[i].score == pytest.approx(1 / np.exp(total - total.max()).sum(), rel=1e-3)


def test_language_accuracy_and_odd_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = langid.fit(docs.where(~held), MODEL)
    got = langid.predict(docs.where(held), model, MODEL).select("row.lang", "lang_pred", "score").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98 and got.score.between(0, 1).all()
    odd = table(spark, [(1, None), (2, ""), (3, " 12 !?"), (4, "x" * 100_000), (5, "the " * 50_000), (5, "the " * 50_000)])
    found = {r.row.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, model, MODEL).collect()}
    assert found[1] == found[2] == found[3] == ("und", 0.0) and found[5][0] == "en"
    assert langid.keep_known(docs.limit(0), MODEL).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.Model([], np.zeros((0, 0))), MODEL).collect()} == {"und"}


# --- 4


def near_texts(seed=4, groups=12):
    rnd = random.Random(seed)
    out, word = [], lambda: rnd.choice("abcdefgh") + str(rnd.randrange(500))
    passage = [word() for _ in range(30)]
    for _ in range(groups):
        base = [word() for _ in range(rnd.choice([3, 8, 40, 120, 400]))]
        for _ in range(rnd.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 3, 8])):
                copy[rnd.randrange(len(copy))] = word()
            out.append(" ".join(copy + (passage if rnd.random() < 0.3 else [])))
    return [None, "", "  \t", "one", "One", "one two three", "ONE two\nthree", *out, " ".join(f"q{i}" for i in range(20_000)), " ".join(f"q{i}" for i in range(20_050))]


def brute_groups(texts, words, percent):
    sets = {}
    for i, t in enumerate(texts):
        w = words_of(t)
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    links = [(a, b) for a in sets for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, roots(links, sets)


@pytest.mark.parametrize(("words", "percent", "block"), [(4, 85, 1024), (5, 80, 6), (2, 60, 4)])
def test_jaccard_is_exact(spark, monkeypatch, words, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = near_texts()
    docs = table(spark, [(i, t) for i, t in enumerate(texts)])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs, words=words, percent=percent).collect()}
    sizes, want = brute_groups(texts, words, percent)
    assert got == {i: (sizes[i], want[i]) for i in want}


def test_jaccard_empty_and_repeated(spark):
    assert jaccard.similar_groups(table(spark, [])).count() == 0
    got = jaccard.similar_groups(table(spark, [(7, "a b c d e f"), (7, "a b c d e f"), (3, "a b c d e f"), (None, "x")])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (3, 3), (7, 3), (7, 3)]


def test_tree_bounds_lose_nothing():
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 2**63, 300, dtype=np.uint64))]
    for _ in range(60):
        base = sets[r.integers(len(sets))].copy()
        base[r.integers(0, len(base), r.integers(0, 60))] = r.integers(0, 2**63, dtype=np.uint64)
        sets.append(np.unique(base))
    sizes = np.array([len(s) for s in sets])
    want = {i for i in range(len(sets)) for j in range(len(sets)) if i != j and 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    assert want <= set(jaccard.hopeful(sizes, [jaccard.signature(s) for s in sets], 85).tolist())


# --- 5


def test_schema_validation():
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"type": "array", "items": {"type": "string", "pattern": "^x"}}, "c": {"enum": [1, "2"]}}, "additionalProperties": False}
    assert chat.violations({"a": 1, "b": ["xy"], "c": "2"}, schema) == []
    assert chat.violations({"b": ["y", 3], "d": 0, "c": 2}, schema) == ["$.a: missing", "$.b[0]: pattern", "$.b[1]: not string", "$.c: not in enum", "$.d: not allowed"]
    assert chat.violations({"a": True}, schema) == ["$.a: not integer"]
    assert chat.violations([], schema) == ["$: not object"]


def test_tool_calls_are_linked_and_ordered(spark):
    call = lambda **x: f"<tool_call>{json.dumps(x)}</tool_call>"
    result = lambda i, c: f"<tool_result>{json.dumps({'id': i, 'content': c})}</tool_result>"
    rows = [
        (1, 0, "user", "hi é"),
        (1, 1, "assistant", "ok " + call(id="b", name="f", arguments={"n": 1}, after=["a"]) + call(id="a", name="f", arguments={"n": "x"}) + call(id="c", name="g", arguments={})),
        (1, 2, "tool", result("a", {"z": 1, "y": 2}) + result("b", "later") + result("b", "again") + result("zz", 0)),
        (1, 600, "user", None),
        (2, 0, "user", "<tool_call>not json</tool_call>"),
        (None, None, None, None),
    ]
    turns = table(spark, rows, "conv_id long, turn long, role string, text string")
    made = chat.format_chats(turns, {"f": {"type": "object", "properties": {"n": {"type": "integer"}}}})
    got = {r.conv_id: r for r in made.collect()}
    first = got[1]
    assert (first.n_messages, first.n_calls, first.n_linked, first.n_unanswered, first.n_orphans, first.n_repeats, first.n_invalid) == (4, 3, 2, 1, 1, 1, 2)
    made = json.loads(first.chat)
    assert [c["id"] for c in made["tool_calls"]] == ["a", "b", "c"]
    assert made["tool_calls"][0]["result"] == {"y": 2, "z": 1} and made["tool_calls"][1]["result"] == "later"
    assert made["repeats"] == [{"id": "b", "content": "again", "turn": 2}]
    assert made["messages"][0]["content"] == "hi é" and first.chat == chat.canonical(made)
    assert json.loads(got[2].chat)["messages"][0]["content"] == "<tool_call>not json</tool_call>"
    assert got[None].n_messages == 1
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_a_long_conversation_is_one_ordered_row(spark):
    call = lambda **x: f"<tool_call>{json.dumps(x)}</tool_call>"
    rows = [(1, t, "assistant", call(id=f"c{t}", name="respond", arguments={}, after=[f"c{t + 1}"] if t < 599 else [])) for t in range(600)]
    rows += [(1, 0, "tool", "<tool_result>" + json.dumps({"id": "c300", "content": "x" * 200_000}) + "</tool_result>")] * 3
    rows += [(None, 1, "user", "alone")] * 2 + [(2, None, None, "word " * 100_000)]
    turns = table(spark, [(*r, "k", "z") for r in rows], "conv_id long, turn long, role string, text string, id string, body string").repartition(5)
    got = chat.format_chats(turns).collect()
    assert sorted((r.conv_id or 0, r.n_messages) for r in got) == [(0, 1), (0, 1), (1, 603), (2, 1)]
    (one,) = [r for r in got if r.conv_id == 1]
    made = json.loads(one.chat)
    assert [c["id"] for c in made["tool_calls"]] == [f"c{t}" for t in range(599, -1, -1)]
    assert (one.n_calls, one.n_linked, one.n_repeats, one.n_orphans, len(made["repeats"])) == (600, 1, 2, 0, 2)
    assert [m["turn"] for m in made["messages"]] == sorted(m["turn"] for m in made["messages"])


def test_cycles_keep_their_order():
    calls = [{"id": "x", "after": ["y"]}, {"id": "y", "after": ["x"]}, {"id": "z", "after": []}]
    assert [c["id"] for c in chat.topological(calls)] == ["z", "x", "y"]


# --- 6


def odd_texts():
    rnd = random.Random(6)
    letters = " \n\tabcdeéß日本𠮷▁<>/s0123.,-  e"
    return [None, "", " ", "   ", "▁", "<s></s><unk>", "\x00", "a" * 30_000, " " * 5000, "é" * 3000, *("".join(rnd.choice(letters) for _ in range(rnd.randrange(80))) for _ in range(400))]


def test_token_counts_are_the_library_s(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = odd_texts()
    got = {r.doc_id: r for r in tokencount.token_counts(table(spark, [(i, t) for i, t in enumerate(texts)]), MODEL).collect()}
    for i, t in enumerate(texts):
        n = len(model.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 4096), repr(t)[:60]
    assert tokencount.token_counts(table(spark, []), MODEL).count() == 0


def test_state_maps_compose_in_any_order():
    counter = tokencount.Counter(tokencount.Transducer.from_sentencepiece(MODEL))
    for text in [t for t in odd_texts() if t and len(t) < 200][:60]:
        whole = counter.texts([text])[0]
        assert all(counter.long_text(text, k) == whole for k in (1, 2, 5, 50))
        chars = tokencount._characters([text])[0]
        maps = [{s: (e, n) for s, e, n in counter.state_map(chars[k : k + 3], chars[max(0, k - 64) : k])} for k in range(0, len(chars), 3)]
        while len(maps) > 1:
            join = lambda a, b: {s: (b[e][0], n + b[e][1]) for s, (e, n) in a.items() if e in b}
            maps = [join(maps[k], maps[k + 1]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        assert [n for _, n in maps[0].values()] == [whole]


@pytest.mark.parametrize("before", [64, 1])
def test_long_texts_are_counted_in_chunks(spark, monkeypatch, before):
    import sentencepiece

    monkeypatch.setattr(tokencount, "CHUNK", 500)
    monkeypatch.setattr(tokencount, "BEFORE", before)
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rnd = random.Random(66)
    texts = ["a" * 1700, "ab" * 1300, " " * 1200, "the words of it " * 200, "".join(rnd.choice("etaoinsé日 ") for _ in range(4000)), "".join(rnd.choice("etaoins") for _ in range(4001)), "x" * 499 + " " + "y" * 501, None, "short"]
    docs = table(spark, [(i, t, 1) for i, t in [*enumerate(texts), (3, texts[3])]], "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in tokencount.token_counts(docs, MODEL).collect())
    assert got == sorted((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in [*enumerate(texts), (3, texts[3])])
    with pytest.raises(ValueError):
        tokencount.token_counts(docs, MODEL, keep=("doc_id", "n_tokens"))


# --- 7

CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute_hits(text, items, window=10):
    w, hit, found = words_of(text, CLASS), set(), set()
    for name, t in items:
        own = words_of(t, CLASS)
        n = min(window, len(own))
        runs = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if n and tuple(w[k : k + n]) in runs:
                hit |= set(range(k, k + n))
                found.add(str(name))
    return len(w), len(hit), sorted(found)


def test_decontamination(spark, monkeypatch):
    rnd = random.Random(7)
    word = lambda: rnd.choice(["the", "of", "ab", "Ba", "é", "x1"]) + rnd.choice(["", "q"])
    items = [(i, " ".join(word() for _ in range(rnd.choice([1, 2, 5, 9, 10, 11, 40])))) for i in range(1, 30)] + [(30, None), (31, ""), (32, "!!"), (5, "shared id text")]
    texts = [None, "", "...", *(" ".join(word() for _ in range(rnd.randrange(60))) for _ in range(60))]
    texts += [f"pre {items[3][1].upper()}, {items[7][1]} post", "zz " * 20_000 + (items[9][1] or ""), (items[9][1] + " ") * 500]
    docs = table(spark, [(i, t, 1, "z") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, spans string")
    for shard in (1 << 21, 200):
        monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
        got = {r.row.doc_id: r for r in decontaminate.contamination(docs, table(spark, items, "item_id long, text string")).collect()}
        for i, t in enumerate(texts):
            n, hit, names = brute_hits(t, items)
            assert (got[i].n_words, got[i].n_hit, got[i].items) == (n, hit, names), i
            assert got[i].items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
    assert decontaminate.contamination(docs.limit(0), table(spark, items, "item_id long, text string")).count() == 0
    none = decontaminate.contamination(docs, table(spark, [], "item_id long, text string")).collect()
    assert {r.n_hit for r in none} == {0}


def test_spans_are_cut(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = table(spark, [(1, f"Before, <{item.upper()}>! after it all there is more é text left"), (2, item), (3, "clean  text "), (4, None)])
    got = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, table(spark, [(1, item)], "item_id long, text string"), max_coverage=0.8).collect()}
    assert got == {1: "Before, <>! after it all there is more é text left", 3: "clean  text ", 4: None}


# --- 8

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), order, kind, m.end()))
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_base_spans(spark):
    rnd = random.Random(8)
    letters = "aZ9 @.-+()_%012345 \n日𠮷é"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(90))) for _ in range(1500)]
    texts += [None, "", "0.0.0.0", "0.1.2.3 00.1.2.3 000.0.00.255 0256.1.1.1", "a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8", "256.1.1.1 001.2.3.4", "4111 1111 1111 1111, 4111-1111-1111-1112", "+1 (555) 555-1234", "9" * 30_000, "a" * 30_000 + "@", "a@b" + ".c" * 9000, "1 " * 9000, "𠮷 a@b.co token=abcdefgh12345"]
    docs = table(spark, [(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, found int")
    got = pii.tag(docs).select("row.doc_id", pii.listed(F.filter("spans", lambda x: x["base"])).alias("base"), pii.listed(F.col("spans")).alias("every")).collect()
    for r in got:
        assert r.base == brute_spans(texts[r.doc_id]), repr(texts[r.doc_id])[:80]
        assert set(filter(None, r.base.split(","))) <= set(r.every.split(","))
    assert pii.tag(docs.limit(0)).count() == 0


def test_redaction(spark):
    docs = table(spark, [(1, "mail a.b@c.de, 𠮷 +1 (555) 555-1234."), (2, "clean 12 text"), (3, None)])
    assert {r.doc_id: r.text for r in pii.redact(docs).collect()} == {1: "mail <email>, 𠮷 <phone>.", 2: "clean 12 text", 3: None}


def test_label_model_trusts_agreement():
    counts = {"card:+++0": 100, "card:++0+": 300, "card:---0": 200, "card:-0-0": 300, "card:-+00": 10}
    model = pii.LabelModel(counts)
    assert model.posterior("card:++0+") > 0.5 > model.posterior("card:-0-0")


def test_added_spans_on_planted_data(spark):
    """Recall and precision of what the method adds to the base kinds."""
    rnd = random.Random(88)
    word = lambda: "".join(rnd.choice("abcdefghiklmnoprstu") for _ in range(rnd.randrange(3, 9)))
    number = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    texts, want = [], []
    for i in range(1500):
        before, after = " ".join(word() for _ in range(12)), " ".join(word() for _ in range(6))
        case = i % 5
        if case == 0:
            key = rnd.choice(["password", "token", "api_key", "secret"])
            plant = f"{key}={number(3)}{word()}{number(4)}{word()}"
        elif case == 1:
            plant = rnd.choice(["call ", "phone ", "tel ", ""]) + f"{rnd.randrange(2, 10)}{number(2)}-{rnd.randrange(2, 10)}{number(2)}-{number(4)}"
        elif case == 2:
            plant = rnd.choice(["order no. ", "version ", "page "]) + rnd.choice([f"{number(3)}-{number(3)}-{number(4)}", f"999.{number(3)}.300.{number(3)}"])
        elif case == 3:
            plant = f"isbn {number(1)}{number(12)}"
        else:
            plant = word()
        texts.append(f"{before} {plant} {after}")
        want.append({0: "secret", 1: "local_phone"}.get(case))
    found = pii.tag(table(spark, list(enumerate(texts)))).collect()
    added = {r.row.doc_id: {x.kind for x in r.spans if not x.base} for r in found}
    right = sum(kind in added[i] for i, kind in enumerate(want) if kind)
    wrong = sum(bool(added[i]) for i, kind in enumerate(want) if not kind)
    recall, precision = right / sum(map(bool, want)), right / max(1, right + wrong)
    print(f"added spans: recall {recall:.3f}, precision {precision:.3f}")
    assert recall > 0.95 and precision > 0.85


def test_many_spans_in_one_text(spark):
    text = "a@b.co " * 100_000 + "𠮷 end"
    docs = table(spark, [(1, text), (2, None), (2, None)])
    began = time.time()
    (r,) = [r for r in pii.tag(docs).collect() if r.row.doc_id == 1]
    assert len(r.spans) == 100_000 and [(x.start, x.end) for x in r.spans[-2:]] == [(7 * 99_998, 7 * 99_998 + 6), (7 * 99_999, 7 * 99_999 + 6)]
    got = {x.doc_id: x.text for x in pii.redact(docs).collect()}
    assert got[1] == text.replace("a@b.co", "<email>") and got[2] is None
    assert time.time() - began < 60


def test_overlapping_spans_are_masked_once(spark):
    text = F.lit("0123456789" * 300)
    spans = [(5, 2, "card", 1030, True, 0), (7, 3, "phone", 9, True, None), (1030, 3, "phone", 1031, True, 1030), (2998, 0, "email", 3000, True, 1031)]
    row = spark.createDataFrame([(spans,)], "spans array<struct<start:int,order:int,kind:string,end:int,base:boolean,free:int>>")
    whole = "0123456789" * 300
    assert row.select(pii.masked(text, F.col("spans"))).first()[0] == whole[:5] + "<card>" + "<phone>" + whole[1031:2998] + "<email>"


# --- 9


def brute_vectors(rows, least=0.95):
    good = {k: np.array(v, float) for k, (_, v) in enumerate(rows) if v is not None and len(v) and None not in v and np.isfinite(v).all() and any(v)}
    links, n = [], dict.fromkeys(range(len(rows)), 0)
    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= least:
                links.append((a, b))
                n[a] += 1
                n[b] += 1
    return n, roots(links, n)


@pytest.mark.parametrize("block", [2048, 20])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "CELLS", (block // 4, block))
    monkeypatch.setattr(vectors, "BATCH", 16)
    r = np.random.default_rng(9)
    rows = [v.tolist() for v in r.standard_normal((120, 8))]
    rows += [(np.array(rows[k]) * 3 + r.standard_normal(8) * s).tolist() for k, s in zip(r.integers(0, 120, 80), r.choice([0, 0.1, 0.4, 0.6], 80), strict=True)]
    rows += [rows[0]] * 30 + [None, [], [0.0] * 8, [float("nan")] * 8, [None] * 8, [float("inf")] * 8, [1.0, 2.0], [2.0, 4.0], [-0.0] * 7 + [1.0], [0.0] * 7 + [1.0]]
    rows = list(enumerate(rows))
    got = {x.vec_id: x for x in vectors.near_duplicates(table(spark, [(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, n_links int")).collect()}
    n, want = brute_vectors(rows)
    assert {i: (x.n_links, x.component_id, x.kept) for i, x in got.items()} == {i: (n[i], want[i], want[i] == i) for i in n}
    assert vectors.near_duplicates(table(spark, [], "vec_id long, embedding array<double>")).count() == 0


def test_clustered_vectors_meet_few_others():
    """Copies of points to cells grow with the points, not with their square, where they lie in clusters."""
    eps, copies = np.arccos(0.95), []
    for n in (4000, 16_000):
        r = np.random.default_rng(1)
        centres = r.standard_normal((n // 250, 64))
        points = centres[r.integers(0, len(centres), n)] + r.standard_normal((n, 64)) * 0.1
        points /= np.linalg.norm(points, axis=1, keepdims=True)
        pivots = vectors.best_pivots(points[: vectors.SAMPLE], n, eps)
        copies.append(vectors._reach(points @ pivots.T, vectors._apart(pivots), eps)[1].sum())
    assert np.log(copies[1] / copies[0]) / np.log(4) < 1.3


# --- 10


def test_network_learns_and_scores_whole_texts(spark):
    rnd = random.Random(10)
    texts = []
    for _ in range(400):
        a = rnd.randrange(20)
        texts.append(" ".join(f"w{(a + k) % 20}" for k in range(60)))
    shuffled = [" ".join(rnd.sample(t.split(), 60)) for t in texts[:50]]
    odd = [None, "", "  ", "unseen", "w1 " * 30_000]
    learn = table(spark, list(enumerate(texts)))
    docs = table(spark, list(enumerate([*texts[:50], *shuffled, *odd])))
    got = {r.row.doc_id: r for r in lm.score(docs, learn=learn).collect()}
    mean = lambda ids: sum(got[i]["mean"] for i in ids) / len(ids)
    assert mean(range(50)) > mean(range(50, 100)) + 0.5
    assert [(got[i].n_words, got[i].log_likelihood, got[i]["mean"]) for i in (100, 101, 102)] == [(0, 0.0, None)] * 3
    assert got[103].n_words == 1 and got[104].n_words == 30_000
    assert lm.score(docs.limit(0)).count() == 0
    assert {r.row.doc_id: r.log_likelihood for r in lm.score(docs, learn=learn).collect()} == {i: r.log_likelihood for i, r in got.items()}


def test_scores_are_conditional_probabilities():
    vocabulary = lm.Vocabulary.of_counts(np.arange(1, 400, dtype=np.uint64) << np.uint64(40), np.arange(400, 1, -1), 50)
    network = lm.Network(vocabulary)
    for around in ([1, 2, 3, 4], [463, 463, 7, 8]):
        every = np.array([[*around[:2], t, *around[2:]] for t in range(vocabulary.edge)], np.int32)
        assert np.exp(network.log_probability(every)).sum() == pytest.approx(1, abs=1e-4)
        network.branch[0] *= 400  # logits so large that the maximum has to be taken off
        assert np.exp(network.log_probability(every)).sum() == pytest.approx(1, abs=1e-3)


def test_gradient_of_the_network(monkeypatch):
    vocabulary = lm.Vocabulary.of_counts(np.arange(1, 30, dtype=np.uint64), np.arange(30, 1, -1), 50)
    network = lm.Network(vocabulary, seed=1)
    tokens = np.random.default_rng(2).integers(0, vocabulary.edge + 1, (16, 12)).astype(np.int32)
    words = (tokens[:, 2:-2] != vocabulary.edge).ravel()
    loss = lambda: -network.log_probability(tokens)[words].astype(float).mean()
    before = loss()
    slopes = []
    for k, p in enumerate(network.parameters()):
        at = (min(3, len(p) - 1), 0)
        was = p[at]
        p[at] = was + 0.01
        up = loss()
        p[at] = was - 0.01
        slopes.append((k, at, (up - loss()) / 0.02, was.copy()))
        p[at] = was
    network.step(tokens, rate=1e-4)
    for k, at, slope, was in slopes:
        assert np.sign(was - network.parameters()[k][at]) == np.sign(slope) or abs(slope) < 2e-4, (k, slope)
    for _ in range(100):
        network.step(tokens)
    assert loss() < before - 1
