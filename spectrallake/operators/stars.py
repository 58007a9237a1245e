"""Delaunay tetrahedra at chosen points of a small set in space, many faces at once.

A tetrahedron lies on each side of each face: the point whose sphere through the face reaches least far to that side. Faces
are asked in waves, thousands at a time, from a first face at each chosen point. Whatever is decided is decided beyond
rounding: a tetrahedron counts if every other point lies outside its sphere by more than an error bound.
"""

from __future__ import annotations

import numpy as np

#: Neighbours of a point that are looked at first; numbers that are worked on at once.
NEAR, AT_ONCE = 64, 1 << 17
EPS = 2.0**-53


def _cross(a: list, b: list) -> list:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _dot(a: list, b: list) -> np.ndarray:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _mates(p: np.ndarray, face: np.ndarray, way: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mate, r2, sure): of candidates near, the point that makes a tetrahedron with each face on its side `way`, or -1; its
    squared radius, or infinity; and whether no candidate is within rounding of another answer."""
    at = p[face[:, 0]]
    u, v = (p[face[:, 1]] - at).T, (p[face[:, 2]] - at).T
    uu, vv, n = _dot(u, u), _dot(v, v), _cross(u, v)
    nn, rows = _dot(n, n), np.arange(len(face))
    with np.errstate(all="ignore"):
        # A sphere's middle is that of the face's circle, m, and a way along its normal: half of num / den.
        m = [c / (2 * nn) for c in _cross([uu * b - vv * a for a, b in zip(u, v, strict=True)], n)]
        w = [p[:, k][near] - at[:, k, None] for k in range(3)]
        ww, mm, area = _dot(w, w), np.sqrt(_dot(m, m))[:, None], np.sqrt(uu * vv)[:, None]
        num, den = ww - 2 * _dot(w, [c[:, None] for c in m]), _dot(w, [(c * way)[:, None] for c in n])
        far = np.sqrt(ww)
        slack = 32 * EPS * area * far
        corner = (near == face[:, :1]) | (near == face[:, 1:2]) | (near == face[:, 2:])
        best = np.where((den > slack) & ~corner, num / den, np.inf).argmin(1)
        num_b, den_b, far_b = (c[rows, best, None] for c in (num, den, far))
        found = (den_b > slack[rows, best, None])[:, 0] & ~corner[rows, best]
        outside = num * den_b - num_b * den
        bound = 64 * EPS * (area * area / np.sqrt(nn)[:, None]) * far * far_b * (far + far_b + 4 * mm)
        corner[rows[found], best[found]] = True
        sure = (corner | np.where(found[:, None], outside > bound, den < -slack)).all(1)
        r2 = np.where(found, mm[:, 0] ** 2 + (num_b / den_b / 2)[:, 0] ** 2 * nn, np.inf)
    return np.where(found, near[rows, best], -1), r2, sure


def _thirds(p: np.ndarray, i: np.ndarray, j: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, r2): of candidates near, the point of the smallest circle through i, j and it. Where j is nearest to i, that is a Delaunay face."""
    u, v = [(p[j, c] - p[i, c])[:, None] for c in range(3)], [p[:, c][near] - p[i, c, None] for c in range(3)]
    e, x = [b - a for a, b in zip(u, v, strict=True)], _cross(u, v)
    with np.errstate(all="ignore"):
        r2 = _dot(u, u) * _dot(v, v) * _dot(e, e) / (4 * _dot(x, x))
    r2 = np.where((near == i[:, None]) | (near == j[:, None]) | np.isnan(r2), np.inf, r2)
    return near[np.arange(len(i)), r2.argmin(1)], r2.min(1)


def _once(*keys: np.ndarray) -> np.ndarray:
    """Rows with different keys, each once."""
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys)
    first = np.ones(len(order), bool)
    first[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], 0)
    return order[first]


def _among(some: np.ndarray, sorted_ones: np.ndarray) -> np.ndarray:
    if not len(sorted_ones):
        return np.zeros(len(some), bool)
    return sorted_ones[np.minimum(np.searchsorted(sorted_ones, some), len(sorted_ones) - 1)] == some


def tetrahedra_at(p: np.ndarray, own: np.ndarray) -> np.ndarray | None:
    """Delaunay tetrahedra (sorted indices) of distinct points p with a corner that is own; None if rounding leaves any in doubt."""
    n, mine = len(p), np.flatnonzero(own)
    if n < 4:
        return np.empty((0, 4), int)
    p = np.ldexp(p, -int(np.frexp(np.ptp(p, 0).max())[1]))
    k, everyone = min(NEAR, n), np.arange(n)
    near, ball, place = np.empty((len(mine), k), int), np.full(n, -1.0), np.cumsum(own) - 1
    seeds = np.empty((len(mine), 3), int)
    # A sphere through a point lies within twice its radius of it: with that in the ball of its neighbours, these decide.
    step = max(1, 4 * AT_ONCE // n)
    for a in range(0, len(mine), step):
        some = mine[a : a + step]
        d = sum((p[some, c, None] - p[:, c]) ** 2 for c in range(3))
        part = np.argpartition(d, k - 1, 1)[:, :k] if k < n else np.broadcast_to(everyone, d.shape)
        d = np.take_along_axis(d, part, 1)
        near[a : a + step], ball[some] = part, d.max(1) if k < n else np.inf
        first = part[np.arange(len(some)), np.where(part == some[:, None], np.inf, d).argmin(1)]
        last, r2 = _thirds(p, some, first, part)
        for b in np.flatnonzero(~(4 * (1 + 1e-9) * r2 < ball[some])):
            last[b] = _thirds(p, some[b : b + 1], first[b : b + 1], everyone[None])[0][0]
        seeds[a : a + step] = np.column_stack([some, first, last])

    def keys(face: np.ndarray, way: np.ndarray) -> np.ndarray:
        return ((face[:, 0] * n + face[:, 1]) * n + face[:, 2]) * 2 + (way > 0)

    def unknown(face: np.ndarray, way: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key = keys(face, way)
        new = np.flatnonzero(~_among(key, known))
        new = new[_once(key[new])]
        return face[new], way[new], key[new]

    # Sides of faces: those asked, those with a tetrahedron, those with none.
    known, filled, open_sides, made = np.empty(0, int), [], [], []
    seeds = np.sort(seeds, 1)
    face, way, key = unknown(np.concatenate([seeds, seeds]), np.repeat([1, -1], len(seeds)), known)
    while len(face):
        mate = np.empty(len(face), int)
        for a in range(0, len(face), step := max(1, AT_ONCE // k)):
            f, s = face[a : a + step], way[a : a + step]
            anchor = f[np.arange(len(f)), ball[f].argmax(1)]
            got, r2, sure = _mates(p, f, s, near[place[anchor]])
            wide = np.flatnonzero(~(4 * (1 + 1e-9) * r2 < ball[anchor]))
            for b in range(0, len(wide), most := max(1, AT_ONCE // n)):
                some = wide[b : b + most]
                got[some], _, sure[some] = _mates(p, f[some], s[some], np.broadcast_to(everyone, (len(some), n)))
            if not sure.all():
                return None
            mate[a : a + step] = got
        found = mate >= 0
        open_sides.append(key[~found])
        t = np.sort(np.column_stack([face[found], mate[found]]), 1)
        t = t[_once(t[:, 3], keys(t, np.zeros(len(t))))]
        made.append(t)
        e = (p[t[:, 1:]] - p[t[:, :1]]).transpose(1, 2, 0)
        turn = np.sign(_dot(e[2], _cross(e[0], e[1]))).astype(int)
        faces, ways = np.concatenate([np.delete(t, c, 1) for c in range(4)]), np.concatenate([turn if c % 2 else -turn for c in range(4)])
        touched = own[faces].any(1)
        faces, ways = faces[touched], ways[touched]
        inner = keys(faces, ways)
        if not _among(key[found], np.sort(inner)).all():
            return None
        filled.append(inner)
        known = np.sort(np.concatenate([known, key, inner]))
        face, way, key = unknown(faces, -ways, known)
    if not made:
        return np.empty((0, 4), int)
    # No side has two tetrahedra, or one and none.
    sides = np.sort(np.concatenate(filled))
    if (sides[1:] == sides[:-1]).any() or _among(np.concatenate(open_sides), sides).any():
        return None
    return np.concatenate(made)
