"""Properties of the pure parts, on generated inputs."""

import numpy as np
from hypothesis import given, settings, strategies as st

from looseleaf.llm.contamination import FMIndex, letters_of, phrases, suffix_array
from looseleaf.llm.encoding import Model, decode
from looseleaf.llm.packing import _best_fit, fit_patterns
from looseleaf.llm.personal import mentions

symbols = st.lists(st.integers(0, 3), min_size=1, max_size=60)


@settings(max_examples=60, deadline=None)
@given(symbols, symbols)
def test_backward_search_counts(text, pattern):
    s = np.array(text, np.uint16)
    assert list(suffix_array(s)) == sorted(range(len(text)), key=lambda i: text[i:])
    index, lo, hi = FMIndex(s), np.array([0]), np.array([len(text) + 1])
    for c in pattern[:4][::-1]:
        lo, hi = index.step(np.array([c], np.uint16), lo, hi)
    p = pattern[:4]
    assert max(0, hi[0] - lo[0]) == sum(text[i : i + len(p)] == p for i in range(len(text)))


@settings(max_examples=60, deadline=None)
@given(st.text(), st.text())
def test_phrases_forget_case_and_markup(a, b):
    one, two = letters_of(a + b)[0], letters_of(a + " ** " + b)[0]
    assert list(one) == list(two)
    s, starts = phrases(one, np.zeros(1, np.int64))
    assert len(s) == len(starts) and (len(one) == 0 or starts[0] == 0)


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=200))
def test_any_text_is_parsed(text):
    end = 0
    for _, s, e in mentions(text):
        assert end <= s < e <= len(text)
        end = e
    garbled, restored = decode(text, Model({}, {}))
    assert garbled or restored == text


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 30), min_size=1, max_size=12))
def test_patterns_use_what_there_is(counts):
    used = {}
    for p, times in fit_patterns(counts, 64):
        assert sum(p) <= 64
        for c in p:
            used[c] = used.get(c, 0) + times
    assert all(n <= counts[c] for c, n in used.items())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=40))
def test_best_fit_never_overflows(sizes):
    load = {}
    for (s, _), c in zip([(s, i) for i, s in enumerate(sizes)], _best_fit([(s, i) for i, s in enumerate(sizes)], 50)):
        load[c] = load.get(c, 0) + s
    assert all(v <= 50 for v in load.values())
