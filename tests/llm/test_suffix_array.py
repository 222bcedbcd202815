import numpy as np
import pytest

from gradelake.llm import suffix_array as S
from gradelake.llm.suffix_dedup import _BASE, window_keys


def check(t, k):
    t = np.append(np.asarray(t, int) + 1, 0)
    sa, text = S.suffix_array(t, k + 1), t.tolist()
    want = sorted(range(len(text)), key=lambda i: text[i:])
    assert sa.tolist() == want
    shared = S.common_prefixes(t, sa)
    for before, at in zip(want, want[1:]):
        n = 0
        while max(at, before) + n < len(text) and text[at + n] == text[before + n]:
            n += 1
        assert shared[at] == n


@pytest.mark.parametrize("few", [1024, 1])
def test_suffix_array_and_prefixes(few, monkeypatch):
    monkeypatch.setattr(S, "_FEW", few)
    rng = np.random.default_rng(0)
    for _ in range(150):
        k = rng.integers(1, 5)
        check(rng.integers(0, k, rng.integers(0, 60)), k)
    check([0] * 200, 1)
    check([0, 1] * 100, 2)
    check(np.tile(rng.integers(0, 3, 30), 8), 3)


@pytest.mark.parametrize("n", [0, 49, 50, 51, 200])
def test_window_keys(n):
    x = np.random.default_rng(n).integers(97, 100, n).astype(np.uint8)
    grams = []
    for i in range(n - 19):
        v = 0
        for b in x[i : i + 20].tolist():
            v = (v * int(_BASE) + b + 1) % 2**64
        v ^= v >> 31
        v = v * 0xBF58476D1CE4E5B9 % 2**64
        grams.append((v ^ v >> 29) >> 24)
    assert window_keys(x, 50).tolist() == [min(grams[i : i + 31]) for i in range(max(0, n - 49))]
