"""Rounds of the comparators for links that fit one task, in numpy, with the same results as the DataFrame rounds."""

from __future__ import annotations

import numpy as np

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _P2
    x = (x ^ (x >> np.uint64(29))) * _P3
    return x ^ (x >> np.uint64(32))


def hashed(columns: list[np.ndarray], number: int) -> np.ndarray:
    """Spark's xxhash64 of LONG columns and an INT literal after them."""
    h = np.full(columns[0].shape, 42, np.uint64)
    for c in columns:
        h = h + _P5 + np.uint64(8)
        h = _mixed(_rotated(h ^ (_rotated(c.astype(np.int64).view(np.uint64) * _P2, 31) * _P1), 27) * _P1 + _P4)
    h = h + _P5 + np.uint64(4)
    with np.errstate(over="ignore"):
        h = h ^ (np.uint64(number) * _P1)
    return _mixed(_rotated(h, 23) * _P2 + _P3).view(np.int64)


def quantised(gain: np.ndarray) -> np.ndarray:
    return np.rint(gain * 1e9) / 1e9


def _summed(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """w summed for each pair (a, b) of numbers below n, in order. The w are whole numbers, so sums are the same in any order."""
    key = a * n + b
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if key.size else np.empty(0, np.int64)
    return key[first] // n, key[first] % n, np.add.reduceat(w[order], first) if key.size else w


class _Near:
    """Weights of each vertex's links to the communities around it, and to its own (0 if it has none there), kept up as vertices move.

    Entries stand in order of vertex and community. Those that have come to 0 stay until entries are next cleared.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, w: np.ndarray, c: np.ndarray):
        """Links (a, b, w) in both directions and in order of a, none from a vertex to itself."""
        self.b, self.w, self.n = b, w, c.size
        self.ends = np.searchsorted(a, np.arange(c.size + 1))
        self._all(a, c)

    def _all(self, a: np.ndarray, c: np.ndarray) -> None:
        v, to, self.weight = _summed(np.r_[a, np.arange(self.n)], np.r_[c[self.b], c], np.r_[self.w, np.zeros(self.n)], self.n)
        self._numbered(v * self.n + to)
        self.least = self.key.size

    def _numbered(self, key: np.ndarray) -> None:
        self.key, self.v, self.to = key, key // self.n, key % self.n
        self.first = np.flatnonzero(np.r_[True, self.v[1:] != self.v[:-1]])

    def links(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of all links of vertices u, and how many each has."""
        many = self.ends[u + 1] - self.ends[u]
        return np.repeat(self.ends[u] - np.cumsum(many) + many, many) + np.arange(many.sum()), many

    def moved(self, u: np.ndarray, c: np.ndarray, after: np.ndarray) -> None:
        """Vertices u go from communities c to after."""
        at, many = self.links(u)
        if at.size > self.b.size // 4:
            return self._all(np.repeat(np.arange(self.n), np.diff(self.ends)), after)
        x, w, none = self.b[at], self.w[at], np.zeros(at.size, np.int64)
        key = np.r_[x * self.n + np.repeat(c[u], many), x * self.n + np.repeat(after[u], many)]
        key, _, change = _summed(key, np.r_[none, none], np.r_[-w, w], 1)
        at = np.searchsorted(self.key, key)
        new = self.key[np.minimum(at, self.key.size - 1)] != key
        self.weight[at[~new]] += change[~new]
        if new.any():
            self.weight = np.insert(self.weight, at[new], change[new])
            key = np.insert(self.key, at[new], key[new])
            if key.size > 1.25 * self.least:
                stays = (self.weight > 0) | (key % self.n == after[key // self.n])
                key, self.weight = key[stays], self.weight[stays]
                self.least = key.size
            self._numbered(key)


def moved(a: np.ndarray, b: np.ndarray, w: np.ndarray, k: np.ndarray, c: np.ndarray, names: np.ndarray, penalty: float, tiny: float) -> np.ndarray:
    """Communities after all moves; see comparators._moves. Vertices are numbered in order of their names; so are communities."""
    n = k.size
    inside = a == b
    loops = float(w[inside].sum())
    order = np.flatnonzero(~inside)
    order = order[np.argsort(a[order], kind="stable")]
    near = _Near(a[order], b[order], w[order], c)
    value, bold, i = None, True, 0
    while True:
        size = np.bincount(c, k, n)
        own = near.to == c[near.v]
        mass = k[near.v]
        gain = quantised(near.weight - penalty * mass * (size[near.to] - np.where(own, mass, 0.0)))
        gain[(near.weight == 0) & ~own] = -np.inf
        mine = np.flatnonzero(own)
        was = gain[mine]
        most = np.maximum.reduceat(gain, near.first)
        # Of the best: its own, else the lowest, which comes first.
        more = most - was
        wants = np.flatnonzero(more > tiny)
        if not wants.size:
            return c
        top = np.flatnonzero(gain == most[near.v])
        goal = near.to[top[np.r_[True, near.v[top][1:] != near.v[top][:-1]]]]
        if bold:
            turn = wants[hashed([names[wants]], i) & 1 == 0]
            after, i = c.copy(), i + 1
            after[turn] = goal[turn]
            if value is None:
                inner = float(near.weight[mine].sum())
                value = loops + inner - penalty * float((size * size).sum())
            at, many = near.links(turn)
            x, went = near.b[at], after != c
            change = near.w[at] * ((np.repeat(after[turn], many) == after[x]) * 1.0 - (np.repeat(c[turn], many) == c[x]))
            then, size = inner + float((change * np.where(went[x], 1.0, 2.0)).sum()), np.bincount(after, k, n)
            now = loops + then - penalty * float((size * size).sum())
            if now > value + tiny:
                near.moved(turn, c, after)
                c, value, inner = after, now, then
                continue
        # Those that gain most for both communities they touch.
        touched, who = np.r_[c[wants], goal[wants]], np.r_[wants, wants]
        order = np.lexsort((who, -more[who], touched))
        first = order[np.r_[True, touched[order][1:] != touched[order][:-1]]]
        chosen = np.flatnonzero(np.bincount(who[first], minlength=n) == 2)
        after = c.copy()
        after[chosen] = goal[chosen]
        near.moved(chosen, c, after)
        c, value, bold = after, None, wants.size > 4 * chosen.size


def levelled(a: np.ndarray, b: np.ndarray, w: np.ndarray, k: np.ndarray, c: np.ndarray, names: np.ndarray, penalty: float, tiny: float) -> np.ndarray:
    """The community of each vertex after moves of vertices, then of the communities so far, until none moves; see comparators._levels."""
    place, found = np.arange(k.size), np.arange(k.size)  # of the communities so far among all vertices, and of each vertex among those communities
    while True:
        c = moved(a, b, w, k, c, names, penalty, tiny)
        if (c == np.arange(c.size)).all():
            return place[found]
        heads, c = np.unique(c, return_inverse=True)
        place, found = place[heads], c[found]
        a, b, w = _summed(c[a], c[b], w, heads.size)
        k, names, c = np.bincount(c, k, heads.size), names[heads], np.arange(heads.size)


def merged_greedily(a: np.ndarray, b: np.ndarray, w: np.ndarray, k: np.ndarray, names: np.ndarray, total: float, tiny: float, i: int) -> np.ndarray:
    """The community of each vertex after all merges, by the lowest vertex; see comparators.fast_greedy. Links: a < b; i: rounds so far."""
    n, found, k = k.size, np.arange(k.size), k.copy()
    gain = quantised(w - k[a] * k[b] / total)
    while True:
        good = np.flatnonzero(gain > tiny)
        if not good.size:
            return found
        most = np.full(n, -np.inf)
        np.maximum.at(most, a[good], gain[good])
        np.maximum.at(most, b[good], gain[good])
        # Only a link that is the best, by gain, of both its ends can be chosen; ties go by hash.
        best = good[(gain[good] == most[a[good]]) | (gain[good] == most[b[good]])]
        tie = hashed([names[a[best]], names[b[best]]], i)
        link, end = np.r_[best, best], np.r_[a[best], b[best]]
        rank = np.r_[tie, tie]
        mine = np.flatnonzero(gain[link] == most[end])
        link, end, rank = link[mine], end[mine], rank[mine]
        order = np.lexsort((b[link], a[link], ~rank, end))
        first = order[np.r_[True, end[order][1:] != end[order][:-1]]]
        chosen, ends = np.unique(link[first], return_counts=True)
        chosen = chosen[ends == 2]
        low, high = a[chosen], b[chosen]
        k[low] += k[high]
        into, new = np.arange(n), np.zeros(n, bool)
        into[high], new[low], new[high] = low, True, True
        found, i = into[found], i + 1
        other = new[a] | new[b]
        x, y = into[a[other]], into[b[other]]
        x, y, z = _summed(np.minimum(x, y), np.maximum(x, y), w[other], n)
        x, y, z = x[x != y], y[x != y], z[x != y]
        a, b, w, gain = np.r_[a[~other], x], np.r_[b[~other], y], np.r_[w[~other], z], np.r_[gain[~other], quantised(z - k[x] * k[y] / total)]
