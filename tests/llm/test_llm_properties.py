"""Properties of the planning parts for any input."""

from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import mixing, overlap, packing, sketch


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=200))
def test_every_item_has_one_place_and_no_container_overflows(units):
    histogram = np.bincount(np.array(units, dtype=int), minlength=17)
    plan = packing.plan(histogram)
    fill, keys = Counter(), plan.unit * (1 << 44) + plan.start
    for unit, n in enumerate(histogram):
        for k in range(n):
            at = int(np.searchsorted(keys, unit * (1 << 44) + k, side="right")) - 1
            assert plan.unit[at] == unit
            fill[int(plan.base[at] + (k - plan.start[at]) // plan.per[at])] += unit
    assert all(v <= 16 for v in fill.values()) and sorted(fill) == list(range(plan.containers))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 10**6), st.integers(1, 50), st.integers(1, 6)), min_size=1, max_size=8))
def test_weights_respect_the_limits(sources):
    tokens, targets, repeats = (np.array(v, dtype=float) for v in zip(*sources))
    weights, exponent = mixing.target_weights(tokens, targets / targets.sum(), repeats, tokens.sum())
    assert (weights >= -1e-12).all() and (weights <= repeats * tokens / tokens.sum() + 1e-9).all()
    assert 0 <= exponent <= 1 and weights.sum() <= 1 + 1e-9


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(0.015625, 1e6, width=32), min_size=1, max_size=300), st.sampled_from([1, 25, 50, 90, 100]))
def test_small_sketches_are_nearly_exact(values, q):
    x = np.sort(np.array(values, dtype=np.float32))
    vector = sketch.build(sketch.encode(x), np.ones(len(x), np.int64))
    rank = max(1, int(np.ceil(q * len(x) / 100)))
    code, exact = sketch.quantile(vector, rank)
    value = float(sketch.decode(np.array([code]))[0])
    low, high = np.searchsorted(x, value * (1 - 2.0**-9)), np.searchsorted(x, value * (1 + 2.0**-9), side="right")
    assert low - min(exact, sketch.rank_error(vector)) <= rank <= high + min(exact, sketch.rank_error(vector)) + 1


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=300), st.integers(1, 5))
def test_terms_of_any_text(text, size):
    terms = overlap.Terms().of(text, size)
    assert len(terms) == max(1, len(overlap.words(text)) - size + 1) and len(set(terms.tolist())) == len(terms)
    assert (terms == overlap.Terms().of(f"  {text} \n", size)).all()
