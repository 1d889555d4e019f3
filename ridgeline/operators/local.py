"""What fits one task, in numpy: all levels of a segment, and the affinity rounds of a small rest."""

from __future__ import annotations

import numpy as np

from ..functions.scores import DIGITS

WEAK, BORDER, STRONG = 0, 1, 2


SCALE = 10.0**DIGITS


def strong_runs(lw: np.ndarray, threshold: float, min_size: int) -> np.ndarray:
    """Borders of the strong runs of sorted scores that are not too short, a row each."""
    d = np.diff(lw)
    strong = np.r_[d[:1], d] > threshold
    border = np.flatnonzero(np.r_[True, strong[1:] != strong[:-1], True])
    return np.stack([border[:-1], border[1:]], axis=1)[strong[border[:-1]] & (np.diff(border) >= min_size)]


def cut(lw: np.ndarray, threshold: float, min_size: int) -> list[tuple[int, int, bool]]:
    """Runs (start, end, strong) of sorted scores, short strong ones demoted and put together with their neighbours."""
    out, done = [], 0
    for a, b in strong_runs(lw, threshold, min_size).tolist():
        out += [(done, a, False)] * (a > done) + [(a, b, True)]
        done = b
    return out + [(done, lw.size, False)] * (lw.size > done)


def _neighbours(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the neighbours of each vertex begin, and all neighbours; an edge makes its ends neighbours of each other."""
    both = np.empty(2 * src.size, np.int64)
    both[: src.size], both[src.size :] = src, dst
    first = np.r_[0, np.cumsum(np.bincount(both, minlength=n))]
    both <<= 32
    both[: src.size] |= dst
    both[src.size :] |= src
    both.sort()
    both &= (1 << 32) - 1
    return first, both.astype(np.int32)


class _Levels:
    """All levels of a graph's segments, depth first.

    The order of a segment's vertices is kept on a tape, from `base` on: vertex v stands at tape[key[v]], other places hold
    what has moved away. Those that score go before base in their new order, which leaves the others' order as it is. So a
    step costs what the edges of the vertices in reach cost, however large the segment.
    """

    def __init__(self, src: np.ndarray, dst: np.ndarray, n: int, factor: float, steps: int, threshold: float, min_size: int):
        self.first, self.near = _neighbours(src, dst, n)
        self.steps, self.threshold, self.min_size = steps, threshold, min_size
        decay = np.exp(-factor * np.arange(n, dtype=float))
        self.reach = n - int(np.count_nonzero(decay == 0))
        self.decay = np.r_[decay[: self.reach], 0.0]
        self.final, self.found = np.arange(n), []
        # Of each vertex: its segment, its place on the tape, its position if in reach, its number among the scoring, and whether its edges are at hand.
        self.home, self.key, self.pos = np.zeros(n, np.int32), np.zeros(n, np.int64), np.full(n, self.reach, np.int32)
        self.number, self.at_hand = np.full(n, -1, np.int32), np.zeros(n, bool)

    def emit(self, start: int, vertices: np.ndarray, kind: int) -> None:
        if vertices.size:
            self.final[start : start + vertices.size] = vertices
            self.found.append((start, start + vertices.size, kind))

    def run(self) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        waiting, segment = [(0, np.arange(self.final.size))], 0
        while waiting:
            segment += 1
            waiting += self.chain(segment, *waiting.pop())
        return self.final, sorted(self.found)

    def chain(self, segment: int, start: int, vertices: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """The levels of a segment and of what remains of it each time; the strong runs to be worked on by themselves."""
        again: list[tuple[int, np.ndarray]] = []
        self.home[vertices] = segment
        self.size, self.base = vertices.size, 4 * vertices.size
        self.tape = np.r_[np.empty(self.base, np.int32), vertices.astype(np.int32)]
        self.key[vertices] = self.base + np.arange(self.size)
        # The vertices whose edges are at hand, the number of each one's edges, their other ends by number, and the vertices so numbered.
        self.rows, self.counts, self.ends, self.numbered = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
        self.front = vertices[:0]
        self.look(vertices)
        while True:
            connected = 0
            if self.size > self.min_size:
                for _ in range(self.steps):
                    head, lw = self.step(segment)
                    connected = head.size
                    if connected <= self.min_size:
                        break
            if connected <= self.min_size:
                self.emit(start, self.rest(), WEAK)
                break
            strong = strong_runs(lw, self.threshold, self.min_size)
            k = len(strong)
            low, high = strong[0].tolist() if k else (connected, connected)
            self.emit(start, head[:low], BORDER)
            if k > 1:
                again.append((start + low, head[low:high].copy()))
            else:
                self.emit(start + low, head[low:high], STRONG)
            if connected == self.size and k <= 1:
                self.emit(start + high, head[high:], BORDER)
                break
            self.home[head[:high]] = 0
            start, self.size, self.base = start + high, self.size - high, self.base + high
            self.look(head[high:])
        self.pos[self.front] = self.reach
        self.at_hand[self.rows] = False
        self.number[self.numbered] = -1
        return again

    def rest(self) -> np.ndarray:
        """The segment's vertices in order."""
        on = self.tape[self.base :]
        return on[self.key[on] == np.arange(self.base, self.tape.size)]

    def look(self, head: np.ndarray) -> None:
        """Sets the vertices in reach and their positions. head: the first vertices of the order, or all of them."""
        most, parts, have, at, width = min(self.reach, self.size), [head], head.size, self.base + head.size, 4096
        while have < most:
            on = self.tape[at : at + width]
            parts.append(on[self.key[on] == np.arange(at, at + on.size)])
            have, at, width = have + parts[-1].size, at + width, 2 * width
        self.pos[self.front] = self.reach
        self.front = np.concatenate(parts)[:most]
        self.pos[self.front] = np.arange(most)

    def fetch(self, segment: int) -> None:
        """Gets the edges of vertices that have come into reach; those of others go where they are the greater part."""
        new = self.front[~self.at_hand[self.front]]
        if not new.size:
            return
        used = self.pos[self.rows] < self.reach
        if self.ends.size > 2 * self.counts[used].sum() + 20_000:
            self.at_hand[self.rows[~used]] = False
            ends, row = self.numbered[self.ends[np.repeat(used, self.counts)]], np.repeat(np.arange(used.sum()), self.counts[used])
            live = self.home[ends] == segment
            self.rows, self.counts = self.rows[used], np.bincount(row[live], minlength=int(used.sum()))
            self.number[self.numbered] = -1
            self.numbered = np.unique(ends[live])
            self.number[self.numbered] = np.arange(self.numbered.size)
            self.ends = self.number[ends[live]]
        self.at_hand[new] = True
        counts = self.first[new + 1] - self.first[new]
        row, until = np.repeat(np.arange(new.size), counts), np.cumsum(counts)
        ends = self.near[np.arange(row.size) + (self.first[new] + counts - until)[row]]
        live = self.home[ends] == segment
        ends = ends[live]
        fresh = np.unique(ends[self.number[ends] < 0])
        self.number[fresh] = np.arange(self.numbered.size, self.numbered.size + fresh.size)
        self.numbered = np.r_[self.numbered, fresh]
        self.rows, self.counts = np.r_[self.rows, new], np.r_[self.counts, np.bincount(row[live], minlength=new.size)]
        self.ends = np.r_[self.ends, self.number[ends]]

    def step(self, segment: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores the segment and sorts it: the vertices with a score in their new order, and their quantised binary logarithms."""
        self.fetch(segment)
        weight = np.bincount(self.ends, np.repeat(self.decay[self.pos[self.rows]], self.counts), self.numbered.size)
        some = np.flatnonzero(weight)
        some = some[self.home[self.numbered[some]] == segment]
        head, lw = self.numbered[some], np.rint(np.log2(weight[some]) * SCALE)
        if head.size:
            bits, down = int(self.tape.size).bit_length(), lw.max() - lw
            if np.isfinite(down).all() and int(down.max()).bit_length() + bits <= 64:
                # Score and place in one number, which sorts faster than two.
                both = (down.astype(np.uint64) << np.uint64(bits)) | self.key[head].astype(np.uint64)
                both.sort()
                head, lw = self.tape[(both & np.uint64((1 << bits) - 1)).astype(np.int64)], lw.max() - (both >> np.uint64(bits)).astype(float)
            else:
                order = np.lexsort((self.key[head], -lw))
                head, lw = head[order], lw[order]
        if self.base < head.size:
            on = self.rest()
            self.base = self.tape.size - on.size
            self.tape[self.base :] = on
            self.key[on] = np.arange(self.base, self.tape.size)
        self.base -= head.size
        self.tape[self.base : self.base + head.size] = head
        self.key[head] = np.arange(self.base, self.base + head.size)
        self.look(head)
        return head, lw / SCALE


def segmented(src: np.ndarray, dst: np.ndarray, n: int, factor: float, steps: int, threshold: float, min_size: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Vertices 0..n-1, placed as numbered: their final order, and (start, end, kind) of what they fall into."""
    return _Levels(src, dst, n, factor, steps, threshold, min_size).run()


def attached(cluster: np.ndarray, src: np.ndarray, dst: np.ndarray, clusters: int) -> np.ndarray:
    """Clusters of vertices in order of position, -1 filled in: round by round the one most edges lead to (ties: the lowest).

    When a round places none, the first vertex left founds a cluster. cluster: before; edges: between positions.
    """
    cluster = cluster.copy()
    open_ = (cluster[src] < 0) | (cluster[dst] < 0)
    a, b = np.r_[src[open_], dst[open_]], np.r_[dst[open_], src[open_]]
    left = int((cluster < 0).sum())
    first = 0
    while left:
        useful = (cluster[a] < 0) & (cluster[b] >= 0)
        if useful.any():
            key, count = np.unique(a[useful].astype(np.int64) * clusters + cluster[b[useful]], return_counts=True)
            vertex, of = key // clusters, key % clusters
            best = np.lexsort((of, -count, vertex))
            vertex, at = np.unique(vertex[best], return_index=True)
            cluster[vertex] = of[best][at]
            left -= vertex.size
            keep = cluster[a] < 0
            a, b = a[keep], b[keep]
        else:
            while cluster[first] >= 0:
                first += 1
            cluster[first] = clusters
            clusters += 1
            left -= 1
    return cluster
