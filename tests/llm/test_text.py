"""Words found by numpy are those of the regular expressions, however windows cut."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from triloom.llm import text

CLASSES = {"space": (text.NON_SPACE, rb"[^\x20\x09-\x0D]+"), "alnum": (text.ALNUM, rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")}
ALPHABET = st.text(alphabet=" \n\taAbB1é日-_@\x00", max_size=60)


def words(rows, pattern):
    return [(k, m.start(), m[0].lower() if m[0].isascii() else bytes(c | 32 if 65 <= c <= 90 else c for c in m[0])) for k, t in enumerate(rows) for m in re.finditer(pattern, (t or "").encode())]


@pytest.mark.parametrize("kind", CLASSES)
@pytest.mark.parametrize("window", [3, 7, 1 << 20])
@settings(max_examples=60, deadline=None)
@given(rows=st.lists(st.one_of(st.none(), ALPHABET), max_size=8))
def test_scan(kind, window, rows):
    table, pattern = CLASSES[kind]
    was, text.WINDOW = text.WINDOW, window
    try:
        found = text.scan(pa.array(rows, pa.string()), table)
    finally:
        text.WINDOW = was
    want = words(rows, pattern)
    lower = bytes(c | 32 if 65 <= c <= 90 else c for c in range(256))
    got = [(int(r), int(s - found.offsets[r]), found.data[s:e].tobytes().translate(lower)) for r, s, e in zip(found.row, found.start, found.end, strict=True)]
    assert got == want
    by: dict[bytes, set[int]] = {}
    for (_, _, w), h in zip(want, found.hash.tolist(), strict=True):
        by.setdefault(w, set()).add(h)
    assert all(len(h) == 1 for h in by.values()) and len({next(iter(h)) for h in by.values()}) == len(by)


@settings(max_examples=40, deadline=None)
@given(sizes=st.lists(st.integers(0, 50), max_size=20), limit=st.integers(1, 60))
def test_slices_cover_all_rows(sizes, limit):
    column = pa.array(["x" * n for n in sizes], pa.string())
    parts = list(text.slices(column, limit))
    assert [k for a, b in parts for k in range(a, b)] == list(range(len(sizes)))
    assert all(b - a == 1 or sum(sizes[a:b]) <= limit for a, b in parts)


def test_grams_tell_orders_apart():
    h = np.arange(1, 50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for n in (1, 2, 4, 10, 70):
        g = text.grams(h, n) if n <= len(h) else text.grams(h, len(h))
        assert len(set(g.tolist())) == len(g)
    assert text.grams(h[[0, 1]], 2)[0] != text.grams(h[[1, 0]], 2)[0]
    assert len(text.grams(h, 70)) == 0
