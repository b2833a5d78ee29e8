import random

import numpy as np
import pytest

from fiberlake.llm import suffix_sort as ss


def texts(rng):
    yield [0]
    yield [1, 0]
    yield [5] * 40 + [0]
    yield [1, 2] * 30 + [0]
    for n in (5, 30, 200, 1200):
        for k in (1, 2, 4, 50):
            yield [rng.randrange(1, k + 1) for _ in range(n)] + [0]
    block = [rng.randrange(1, 9) for _ in range(70)]
    yield block + [9, 3] + block[:50] + [4] + block * 3 + [0]


@pytest.mark.parametrize("memory", [7, 64, 1 << 20])
def test_order_and_common_prefixes(tmp_path, memory):
    for t in texts(random.Random(3)):
        depth = len(t) + 1
        text = np.array(t, np.uint16)
        places, common = [], []
        for p, c in ss._induced(text, depth, ss.Scratch(str(tmp_path)), memory, True):
            places += p.tolist()
            common += c.tolist()
        want = sorted(range(len(t) - 1), key=lambda i: t[i:], reverse=True)
        assert places == want
        for i in range(1, len(want)):
            a, b, n = want[i - 1], want[i], 0
            while max(a, b) + n < len(t) and t[a + n] == t[b + n]:
                n += 1
            assert common[i] == n, (t, i)


@pytest.mark.parametrize("memory", [13, 1 << 20])
@pytest.mark.parametrize("depth", [1, 4, 17])
def test_repeats_to_a_depth(tmp_path, memory, depth):
    rng = random.Random(depth)
    for t in texts(rng):
        text, found = np.array(t, np.uint16), set()
        ss.repeated(text, depth, ss.Scratch(str(tmp_path)), memory, lambda p: found.update(p.tolist()))
        seen = {}
        for i in range(len(t) - depth + 1):
            seen.setdefault(tuple(t[i : i + depth]), []).append(i)
        assert found == {i for v in seen.values() if len(v) > 1 for i in v}, t


def test_scratch_is_left_empty_of_runs(tmp_path):
    rng = random.Random(1)
    t = np.array([rng.randrange(1, 5) for _ in range(3000)] + [0], np.uint16)
    ss.repeated(t, 10, ss.Scratch(str(tmp_path)), 100, lambda p: None)
    assert sum(f.stat().st_size for f in tmp_path.iterdir()) < 200_000
