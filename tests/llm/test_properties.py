"""Properties of the vectorised helpers, on generated inputs; no Spark."""

import math
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from heddle.llm import ngram_join, quality_rules, substring_dedup
from heddle.llm import words as w
from tests.llm.cases import words

TEXTS = st.lists(st.text(alphabet="ab é漢\n\t \x0b\x1c", max_size=30), max_size=8)
settings.register_profile("quick", max_examples=60, deadline=None)
settings.load_profile("quick")


@given(TEXTS, st.integers(1, 60))
def test_word_hashes_agree_with_words(texts, segment):
    kept, w._SEGMENT = w._SEGMENT, segment
    try:
        (first, second), counts = w.word_hashes([t.encode() for t in texts], (0, 1))
    finally:
        w._SEGMENT = kept
    flat = [x for t in texts for x in words(t)]
    assert counts.tolist() == [len(words(t)) for t in texts]
    for hashes in (first, second):
        assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))


@given(TEXTS, st.integers(1, 6))
def test_windows_agree_with_words(texts, size):
    (hashes,), counts = w.word_hashes([t.encode() for t in texts])
    starts = w.window_starts(counts, size)
    windows = w.window_hashes(hashes, size)[starts] if len(starts) else np.zeros(0, np.uint64)
    want = [tuple(ws[i : i + size]) for ws in map(words, texts) for i in range(len(ws) - size + 1)]
    assert len(windows) == len(want)
    assert len(set(zip(want, windows.tolist()))) == len(set(want)) == len(set(windows.tolist()))


@given(st.lists(st.lists(st.integers(0, 9), max_size=140), max_size=6))
def test_block_entropies(texts):
    sizes = np.array([len(t) for t in texts], np.int64)
    got = quality_rules.block_entropies(np.array([i for t in texts for i in t], np.int64), sizes)
    for t, value in zip(texts, got):
        starts = [min(k, len(t) - 50) for k in range(0, len(t), 50)] if len(t) >= 50 else [0]
        parts = [Counter(t[s : s + 50]) for s in starts] if t else []
        want = [-sum(c / min(50, len(t)) * math.log2(c / min(50, len(t))) for c in p.values()) for p in parts]
        assert math.isclose(value, sum(want) / len(want) if want else 0.0, abs_tol=1e-9)


@given(st.lists(st.sets(st.integers(0, 25), max_size=20), min_size=2, max_size=9), st.sampled_from([0.5, 0.8, 1.0]), st.integers(1, 7))
def test_jaccard_links(sets, threshold, tile):
    kept, ngram_join._TILE_COLUMNS = ngram_join._TILE_COLUMNS, tile
    try:
        arrays = [np.array(sorted(s), np.uint64) for s in sets]
        half = len(sets) // 2
        left, right = np.arange(half), np.arange(half, len(sets))
        got = ngram_join.jaccard_links(arrays, left, right, threshold)
    finally:
        ngram_join._TILE_COLUMNS = kept
    for i in left:
        for j in right:
            common, both = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            assert got[i, j - half] == (common > 0 and common >= threshold * both - 1e-12)


@given(st.lists(st.integers(0, 2**32 - 1), max_size=50), st.lists(st.booleans(), max_size=50))
def test_messages_keep_what_they_carry(numbers, flags):
    packed = substring_dedup._pack(np.array(numbers, np.uint32))
    assert substring_dedup._unpack(packed, np.uint32).tolist() == numbers
    assert substring_dedup._mask(substring_dedup._bits(np.array(flags, bool)), len(flags)).tolist() == flags


@given(st.lists(st.lists(st.integers(0, 2**63), min_size=1, max_size=20), min_size=1, max_size=6))
def test_minima(sets):
    n = np.array([len(s) for s in sets])
    hashes = np.array([x for s in sets for x in s], np.uint64)
    whole = ngram_join.minima(hashes, n, 6)
    for k, s in enumerate(sets):
        assert (ngram_join.minima(np.array(s, np.uint64), np.array([len(s)]), 6)[0] == whole[k]).all()
        assert (ngram_join.minima(np.array(s[::-1] * 2, np.uint64), np.array([2 * len(s)]), 6)[0] == whole[k]).all()
