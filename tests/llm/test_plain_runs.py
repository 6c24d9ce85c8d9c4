"""Pairs of a batch decided at once, as one by one."""

from __future__ import annotations

import numpy as np

from tickloom.llm import substring_dedup


def _plain(own, other, first, last, there):
    """The rule for one pair, token by token; None: not decided by it."""
    edit = substring_dedup._EDIT
    back, ahead = min(first, there), min(len(own) - first, len(other) - there)
    if ahead <= last - first or any(own[first + k] != other[there + k] for k in range(last - first + 1)):
        return None
    low = 0
    while low < back and own[first - low - 1] == other[there - low - 1]:
        low += 1
    high = 0
    while high < ahead and own[first + high] == other[there + high]:
        high += 1
    a, b, c, d = first - low, first + high, there - low, there + high
    if set(own[max(0, a - edit) : a]) & set(other[max(0, c - edit - 2) : c + 2]) or set(own[b : b + edit]) & set(other[max(0, d - 2) : d + edit + 2]):
        return None
    return a, b


def test_pairs_of_a_batch_as_one_by_one():
    rng = np.random.default_rng(5)
    own, other, places = [], [], []
    for _ in range(2000):
        run = rng.integers(0, 1 << 30, rng.integers(0, 40), dtype=np.uint32)
        sides = [rng.integers(0, 1 << (6 if rng.random() < 0.3 else 30), rng.integers(0, 25), dtype=np.uint32) for _ in range(4)]
        x, y = np.concatenate([sides[0], run, sides[1]]), np.concatenate([sides[2], run, sides[3]])
        if len(run) > 5 and rng.random() < 0.3:
            y[len(sides[2]) + rng.integers(len(run))] += 1
        first = len(sides[0]) + int(rng.integers(0, max(1, len(run))))
        own.append(x)
        other.append(y)
        places.append((first, first + int(rng.integers(0, 6)), len(sides[2]) + first - len(sides[0])))
    first, last, there = (np.array(v, np.int64) for v in zip(*places, strict=True))
    ok, low, high = substring_dedup.plain_runs(own, other, first, last, there)
    wanted = [_plain(x.tolist(), y.tolist(), *p) for x, y, p in zip(own, other, places, strict=True)]
    assert [(int(a), int(b)) if k else None for k, a, b in zip(ok, low, high, strict=True)] == wanted
    assert 200 < sum(w is None for w in wanted) < 1800
