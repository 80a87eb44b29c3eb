"""Plain-Python answers for small inputs: ranges are (seqnames, start, end, strand), places count from 1."""

from __future__ import annotations

import random
from collections import defaultdict


def random_ranges(rng: random.Random, n: int, empty: bool = True, span: int = 60) -> list[tuple]:
    out = []
    for _ in range(n):
        s = rng.randrange(1, span)
        out.append((rng.choice(["a", "b", "c"]), s, s + rng.randrange(-1 if empty else 0, 12), rng.choice("+-*")))
    return out


def meets(a: str, b: str) -> bool:
    return a == b or "*" in (a, b)


def overlap_pairs(q, s, maxgap=-1, minoverlap=0, ignore=False):
    g = maxgap + 1
    return {
        (i, j)
        for i, x in enumerate(q, 1)
        for j, y in enumerate(s, 1)
        if x[0] == y[0] and (ignore or meets(x[3], y[3])) and x[1] - g <= y[2] and x[2] + g >= y[1] and (minoverlap <= 1 or min(x[2], y[2]) - max(x[1], y[1]) + 1 >= minoverlap)
    }


def reduced(x, gap=1, ignore=False):
    groups = defaultdict(list)
    for n, s, e, t in x:
        groups[n, "*" if ignore else t].append((s, e))
    out = []
    for (n, t), rows in groups.items():
        now = None
        for s, e in sorted(rows):
            if now is None or s > now[1] + gap:
                now = [s, e]
                out.append((n, now, t))
            else:
                now[1] = max(now[1], e)
    return sorted((n, s, e, t) for n, (s, e), t in out)


def bases(x, ignore=False):
    out = defaultdict(lambda: defaultdict(int))
    for n, s, e, t in x:
        for p in range(s, e + 1):
            out[n, "*" if ignore else t][p] += 1
    return out


def stretches(positions):
    out = []
    for p in sorted(positions):
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [tuple(r) for r in out]


def set_operation(x, y, fn, ignore=False):
    a, b = bases(x, ignore), bases(y, ignore)
    return sorted((n, s, e, t) for n, t in a.keys() | b.keys() for s, e in stretches(fn(set(a.get((n, t), ())), set(b.get((n, t), ())))))


def precede(x, y, ignore=False, forward=True):
    """{query: (distance, all subjects at it)} of the directed search."""
    out = {}
    for i, (n, s, e, t) in enumerate(x, 1):
        best = []
        for j, (m, a, b, u) in enumerate(y, 1):
            if n != m or not (ignore or meets(t, u)):
                continue
            minus = not ignore and (t == "-" or t == "*" and u == "-")
            right = minus != forward
            if right and a > e:
                best.append((a - e, j))
            if not right and b < s:
                best.append((s - b, j))
        if best:
            d = min(best)[0]
            out[i] = (d, sorted(j for k, j in best if k == d))
    return out


def nearest(x, y, ignore=False, own=False):
    out = {}
    for i, (n, s, e, t) in enumerate(x, 1):
        near = [(max(a - e - 1, s - b - 1, 0), j) for j, (m, a, b, u) in enumerate(y, 1) if n == m and (ignore or meets(t, u)) and not (own and i == j)]
        if near:
            d = min(near)[0]
            out[i] = (d, sorted(j for k, j in near if k == d))
    return out
