import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from qspark.llm import esa


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.integers(1, 4))
def test_against_brute_force(text, least):
    t = np.array([*text, 9])
    n = len(t)
    suffix = [tuple(t[i:]) for i in range(n)]
    sa, levels = esa.build(t)
    assert sa.tolist() == sorted(range(n), key=lambda i: suffix[i])
    lcp = esa.lcp_array(sa, levels)

    def common(a, b):
        k = 0
        while a + k < n and b + k < n and t[a + k] == t[b + k]:
            k += 1
        return k

    assert lcp.tolist() == [0] + [common(sa[i - 1], sa[i]) for i in range(1, n)]
    places: dict = {}
    for i in range(n):
        for j in range(i + least, n + 1):
            places.setdefault(tuple(t[i:j]), []).append(i)
    want = set()
    for w, own in places.items():
        right = {t[i + len(w)] if i + len(w) < n else -1 for i in own}
        left = {t[i - 1] if i else -1 for i in own}
        if len(own) > 1 and len(right) > 1 and len(left) > 1:
            want.add((len(w), tuple(own)))
    lo, hi, length = esa.maximal_repeats(t, sa, lcp, least)
    assert {(int(length[k]), tuple(sorted(sa[lo[k] : hi[k] + 1].tolist()))) for k in range(len(lo))} == want


def test_covered():
    assert esa.covered(np.array([1, 2]), np.array([2, 9]), 5).tolist() == [False, True, True, True, True]
