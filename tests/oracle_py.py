"""A sequential model of the neighbourhood graphs over a dense array, for small cubes only."""

from __future__ import annotations

import itertools

import numpy as np


def quadrant(dt: int, dh: int, dw: int) -> int:
    a, b, c = abs(dt), abs(dh), abs(dw)
    if dt and a >= b and a >= c:
        return 1 if dt < 0 else 2
    ge, gt = (lambda x, y: x >= y), (lambda x, y: x > y)
    for n, own, on, pairs in (
        (3, b, dh < 0, ((a, dt > 0), (c, dw > 0))), (4, b, dh > 0, ((a, dt <= 0), (c, dw <= 0))),
        (5, c, dw < 0, ((a, dt <= 0), (b, dh <= 0))), (6, c, dw > 0, ((a, dt > 0), (b, dh > 0))),
    ):
        if on and all((ge if loose else gt)(own, other) for other, loose in pairs):
            return n
    return 0


def walk(start: tuple[int, int, int]) -> list[tuple[int, ...]]:
    """Cells strictly between start and the origin, by error accumulation along the driving axis."""
    size, sign = [abs(v) for v in start], [int(np.sign(v)) for v in start]
    n, at, error, out = max(size), list(start), [0, 0, 0], []
    for _ in range(n - 1):
        for i in range(3):
            error[i] += 2 * size[i]
            if error[i] >= n:
                at[i] -= sign[i]
                error[i] -= 2 * n
        out.append(tuple(at))
    return out


def graph(cube: np.ndarray, center: tuple[int, int, int], n: int, ext: int, most: int):
    """(radius, nodes, edges) by growing the cube and taking quadrants in turn; None if that fails. NaN is missing."""
    limits = {q: n // 6 + (q <= n % 6) for q in range(1, 7)}
    for r in range(ext, ext + most + 1):
        cells = []
        for d in itertools.product(range(-r, r + 1), repeat=3):
            p = tuple(c + x for c, x in zip(center, d, strict=True))
            if any(d) and all(0 <= x < s for x, s in zip(p, cube.shape, strict=True)) and not np.isnan(cube[p]):
                cells.append((sum(x * x for x in d), *d))
        by = {q: sorted(c for c in cells if quadrant(*c[1:]) == q) for q in limits}
        if all(len(by[q]) >= limits[q] for q in limits):
            break
    else:
        return None
    if any(c - r < 0 or c + r >= s for c, s in zip(center, cube.shape, strict=True)):
        return None
    nodes, edges = [(0, 0, 0)], []
    for turn in range(n):
        q = turn % 6 + 1
        d = by[q].pop(0)[1:]
        nodes.append(d)
        me = len(nodes) - 1
        hit = next((nodes.index(p) for p in walk(d) if p in nodes[1:me]), 0)
        edges.append((me, hit, "A"))
        d2 = lambda x: sum(v * v for v in x)
        for j, o in enumerate(nodes[:me]):
            same = [x == y for x, y in zip(d, o, strict=True)]
            shared = not (same[1] and same[2]) if same[0] else same[1] or same[2]
            if shared and d2(d) > d2(o) and j != hit:
                edges.append((me, j, "B"))
        edges.append((me, me, "C"))
    return r, nodes, edges
