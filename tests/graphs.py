"""Small graphs and plain-Python oracles."""

from __future__ import annotations

import heapq
import random


def both(pairs):
    return sorted({(a, b) for x, y in pairs for a, b in ((x, y), (y, x))})


TINY = (7, both([(0, 1), (0, 2), (1, 2), (2, 3), (4, 5)]))
PATH = (6, both([(i, i + 1) for i in range(5)]))
STAR = (9, both([(0, i) for i in range(1, 9)]))
COMPLETE = (6, both([(i, j) for i in range(6) for j in range(i)]))
EMPTY = (5, [])
SINGLE = (1, [])
GRID = (12, both([(r * 4 + c, r * 4 + c + 1) for r in range(3) for c in range(3)] + [(r * 4 + c, r * 4 + c + 4) for r in range(2) for c in range(4)]))


def random_graph(n, p, seed):
    rng = random.Random(seed)
    return n, both([(i, j) for i in range(n) for j in range(i) if rng.random() < p])


RANDOM = random_graph(40, 0.06, 1)
GRAPHS = {"tiny": TINY, "path": PATH, "star": STAR, "complete": COMPLETE, "empty": EMPTY, "single": SINGLE, "grid": GRID, "random": RANDOM}


def wrap(x):
    return (x + 2**31) % 2**32 - 2**31


def weight(a, b, n):
    p = wrap(a * b)
    r = abs(p) % n * (1 if p >= 0 else -1)
    return abs(1 + r)


def distances(n, arcs, source, weighted):
    out = {i: None for i in range(n)}
    near, heap = {}, [(0, source)]
    for a, b in arcs:
        near.setdefault(a, []).append((b, weight(a, b, n) if weighted else 1))
    while heap:
        d, v = heapq.heappop(heap)
        if out[v] is not None:
            continue
        out[v] = d
        for b, w in near.get(v, ()):
            heapq.heappush(heap, (d + w, b))
    return out


def labels(n, arcs):
    out = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in arcs:
            if out[a] > out[b]:
                out[a], changed = out[b], True
    return dict(enumerate(out))


def hashed(v, signed=False):
    x = (v + 712313887) & 0xFFFFFFFF
    for _ in range(2):
        x = ((x >> 16) ^ x) * 0x45D9F3B & 0xFFFFFFFF
    x = (x >> 16) ^ x
    return wrap(x) if signed else x


def greedy(n, arcs, signed=False):
    near = {}
    for a, b in arcs:
        near.setdefault(a, set()).add(b)
    out = {}
    for v in sorted(range(n), key=lambda v: -hashed(v, signed)):
        out[v] = 2 if any(out.get(u) == 1 for u in near.get(v, ())) else 1
    return out


def ranks(n, arcs):
    degree = [0] * n
    for a, _ in arcs:
        degree[a] += 1
    score, rounds = [1 / n] * n, 0
    while rounds < 100:
        incoming = [0.0] * n
        for a, b in arcs:
            incoming[b] += score[a] / degree[a]
        new = [0.15 / n + 0.85 * x for x in incoming]
        change = sum(abs(x - y) for x, y in zip(new, score))
        score, rounds = new, rounds + 1
        if change < 1e-4:
            break
    return dict(enumerate(score)), rounds


def triangle_count(n, arcs):
    near = {}
    for a, b in arcs:
        near.setdefault(a, set()).add(b)
    return sum(1 for a, b in arcs if a < b for c in near[a] & near[b] if c > b)
