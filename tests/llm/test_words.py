import random

import numpy as np

from fiberlake.llm.anchors import gram_hashes, runs, sliding_min
from fiberlake.llm.words import laid


def test_words_and_codes():
    rng = random.Random(0)
    texts = [b"", b" ", "é\x1c\u2003 z".encode()] + ["".join(rng.choice("ab \n\t\x0bé") for _ in range(rng.randrange(200))).encode() for _ in range(300)]
    seen = {}
    for chunk in (50, 1 << 20):
        at = 0
        for lay in laid(texts, chunk):
            begins = [0, *lay.ends[:-1]]
            for row, a, b in zip(lay.rows, begins, lay.ends, strict=True):
                words = texts[row].split()
                assert row == at and len(words) == b - a
                at += 1
                for i, w in enumerate(words):
                    assert lay.data[lay.starts[a + i] : lay.stops[a + i]] == w
                    assert seen.setdefault(w, int(lay.codes[a + i])) == lay.codes[a + i]
                if words:
                    assert lay.words(a, b) == b" ".join(words)
        assert at == len(texts)
    assert len(set(seen.values())) == len(seen) > 300


def test_runs_cover_every_window_once():
    rng = np.random.default_rng(3)
    for width, k in ((7, 3), (5, 5), (35, 10)):
        sizes = rng.integers(0, 90, 40)
        ends = np.cumsum(sizes)
        codes = rng.integers(0, 3, ends[-1]).astype(np.uint64)
        windows = {s for e, n in zip(ends, sizes, strict=True) for s in range(e - n, e - width + 1)}
        by_content = {}
        for first, last, place, seed in runs(codes, ends, width, k):
            for a, b, p, h in zip(first, last, place, seed, strict=True):
                for s in range(a, b + 1):
                    windows.remove(s)
                    assert s <= p <= s + width - k
                    assert by_content.setdefault(codes[s : s + width].tobytes(), (p - s, h)) == (p - s, h)
        assert not windows


def test_kernels():
    x = np.random.default_rng(1).integers(0, 1 << 60, 300).astype(np.uint64)
    for w in range(1, 40):
        assert sliding_min(x, w).tolist() == [min(x[i : i + w]) for i in range(300 - w + 1)]
        g = gram_hashes(np.tile(x[:50], 4), w)
        assert len(g) == 200 - w + 1 and (g[:50] == g[50:100]).all() and len(set(g[:50])) == 50
