"""Bounds of a formula's robustness at the samples of one series while more of them may still come.

``settled`` is a time up to which every sample is there. A window that ends later has one known side: what was
seen bounds its minimum from above and its maximum from below. Bounds hold whatever comes, and meet once the
formula's windows are complete; they are then the robustness of the whole trace. Values are arrays of samples by
members (the noisy copies of a series; one without noise), and every window is read from tables of doubled lengths.

Past operators without an end carry one value: what they make of the samples that are no longer kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from sparktl.operators.formula import INF, UNARY, Formula
from sparktl.operators.temporal import SLACK

PAST = ("historically", "once", "since")


@dataclass(frozen=True)
class Node:
    """A formula without columns: leaves are numbers of margins, and past operators without an end have a place."""

    kind: str
    low: float = 0.0
    high: float = 0.0
    parts: tuple[Node, ...] = ()
    leaf: int = -1
    carry: int = -1

    def horizon(self) -> float:
        """The least time after a sample at which it can be settled; next adds none."""
        own = self.high if self.kind in ("always", "eventually", "until") else 0.0
        return own + max((p.horizon() for p in self.parts), default=0.0)

    def empty(self) -> float:
        return INF if self.kind == "historically" else -INF


def compiled(f: Formula, leaves: list[Formula], carried: list[Node]) -> Node:
    """The formula as nodes; adds its leaves, and the nodes that carry a value."""
    if f.kind == "atom":
        if f not in leaves:
            leaves.append(f)
        return Node("atom", leaf=leaves.index(f))
    if f.kind in ("always", "eventually", "until") and f.high == INF:
        raise ValueError(f"{f.kind} without an end is never settled")
    parts = tuple(compiled(p, leaves, carried) for p in f.parts)
    node = Node(f.kind, f.low, f.high, parts, carry=len(carried) if f.kind in PAST and f.high == INF else -1)
    if node.carry >= 0:
        carried.append(node)
    return node


@dataclass
class Seen:
    t: np.ndarray
    margins: np.ndarray  # samples, leaves, members
    settled: float
    until: list[float]  # of each carried value: the samples before this time are in it
    values: list[np.ndarray]  # by member


Bounds = tuple[np.ndarray, np.ndarray, np.ndarray]


def ranged(x: np.ndarray, first: np.ndarray, last: np.ndarray, pick, empty: float) -> np.ndarray:
    """pick of x[first:last] for every pair, NaN passed over."""
    table, out = np.where(np.isnan(x), empty, x), np.full((len(first), x.shape[1]), empty)
    count = last - first
    level = np.where(count > 0, np.frexp(np.maximum(count, 1))[1] - 1, -1)
    for k in range(level.max(initial=-1) + 1):
        at = level == k
        out[at] = pick(table[first[at]], table[last[at] - (1 << k)])
        table = pick(table[: -(1 << k)], table[1 << k :])
    return out


def reached(phi: np.ndarray, psi: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The greatest, over j in [first, last), of min(psi at j, the least phi of [first, j))."""
    count = np.maximum(last - first, 0)
    best, way, tables, k = psi, phi, [], 1
    while k <= count.max(initial=0):
        tables.append((best, way))
        best, way, k = np.maximum(best[:-k], np.minimum(way[:-k], best[k:])), np.minimum(way[:-k], way[k:]), 2 * k
    out, sofar, at = np.full((len(first), phi.shape[1]), -INF), np.full((len(first), phi.shape[1]), INF), first.copy()
    for level in reversed(range(len(tables))):
        rows = np.flatnonzero((count >> level) & 1)
        best, way = tables[level]
        out[rows] = np.maximum(out[rows], np.minimum(sofar[rows], best[at[rows]]))
        sofar[rows] = np.minimum(sofar[rows], way[at[rows]])
        at[rows] += 1 << level
    return out


def throughout(known: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    missing = np.append(0, np.cumsum(~known))
    return missing[np.maximum(last, first)] == missing[first]


def bounds(node: Node, seen: Seen) -> Bounds:
    """(least, greatest, whether settled) of the node at every sample."""
    if node.kind == "atom":
        x = seen.margins[:, node.leaf]
        return x, x, np.ones(len(x), bool)
    x = [bounds(p, seen) for p in node.parts]
    if node.kind == "not":
        return -x[0][1], -x[0][0], x[0][2]
    if node.kind in ("and", "or"):
        pick = np.fmin if node.kind == "and" else np.fmax  # NaN is passed over, as in temporal
        return pick(x[0][0], x[1][0]), pick(x[0][1], x[1][1]), x[0][2] & x[1][2]
    if node.kind == "implies":
        return np.fmax(-x[0][1], x[1][0]), np.fmax(-x[0][0], x[1][1]), x[0][2] & x[1][2]
    if node.kind == "next":
        known = np.append(x[0][2][1:] & (seen.t[1:] <= seen.settled), False)[: len(seen.t)]
        after = [np.concatenate([v[1:], v[:1]]) for v in x[0][:2]]
        return np.where(known[:, None], after[0], -INF), np.where(known[:, None], after[1], INF), known
    return windowed(node, seen, x[0]) if node.kind in UNARY else chained(node, seen, *x)


def span(node: Node, seen: Seen) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first and the end of each sample's window among the samples, and whether nothing more can come into it."""
    t, low, high = seen.t, node.low - SLACK, node.high + SLACK
    if node.kind in PAST:
        begin, end = t - high, t - low
        first = np.maximum(np.searchsorted(t, begin, "left"), np.searchsorted(t, seen.until[node.carry], "left") if node.carry >= 0 else 0)
    else:
        begin, end = t + low, t + high
        first = np.searchsorted(t, begin, "left")
    last = np.searchsorted(t, end, "right")
    return first, np.maximum(last, first), end <= seen.settled


def windowed(node: Node, seen: Seen, x: Bounds) -> Bounds:
    least = node.kind in ("always", "historically")
    pick, empty = (np.minimum, INF) if least else (np.maximum, -INF)
    first, last, whole = span(node, seen)
    low, high = (ranged(v, first, last, pick, empty) for v in x[:2])
    if node.carry >= 0:
        low, high = pick(low, seen.values[node.carry]), pick(high, seen.values[node.carry])
    if least:
        low = np.where(whole[:, None], low, -INF)
    else:
        high = np.where(whole[:, None], high, INF)
    return low, high, whole & throughout(x[2], first, last)


def operands(node: Node, phi: np.ndarray, psi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without NaN, which bounds nothing (see temporal)."""
    return np.where(np.isnan(phi), INF, phi), np.where(np.isnan(psi), INF, psi)


def chained(node: Node, seen: Seen, phi: Bounds, psi: Bounds) -> Bounds:
    """until, and since as until in reversed order."""
    n, own = len(seen.t), np.arange(len(seen.t))
    first, last, whole = span(node, seen)
    here = node.low == 0
    pairs = [operands(node, p, q) for p, q in zip(phi[:2], psi[:2])]
    if node.kind == "until":
        first, there = np.maximum(first, own), np.searchsorted(seen.t, seen.settled, "right")
        last = np.maximum(last, first)

        def best(p, q, end):
            return np.minimum(ranged(p, own, first, np.minimum, INF), reached(p, q, first, end))

        low, high = best(*pairs[0], np.minimum(last, there)), best(*pairs[1], last)
        unseen = ranged(pairs[1][0], own, np.maximum(own, there), np.minimum, INF)
        high = np.where(whole[:, None], high, np.maximum(high, unseen))
        known = whole & throughout(phi[2] & psi[2], own, last)
    else:
        last = np.minimum(last, own + 1)
        back, begin, end = n - 1 - own, n - np.maximum(last, first), n - first

        def best(p, q):
            p, q = p[::-1], q[::-1]
            out = np.minimum(ranged(p, back, np.maximum(begin, back), np.minimum, INF), reached(p, q, np.maximum(begin, back), end))
            if node.carry >= 0:
                kept = n - np.searchsorted(seen.t, seen.until[node.carry], "left")
                out = np.maximum(out, np.minimum(ranged(p, back, np.maximum(back, kept), np.minimum, INF), seen.values[node.carry]))
            return out

        low, high = best(*pairs[0]), best(*pairs[1])
        past = seen.t <= seen.settled
        low = np.where(past[:, None], low, -INF)
        high = np.where((past | whole)[:, None], high, np.maximum(high, pairs[1][0]))
        known = past & throughout(phi[2] & psi[2], first, own + 1)
    if here:  # a sample is its own witness, whatever comes
        low = np.maximum(low, pairs[0][1])
    return low, high, known


def fold(node: Node, seen: Seen, reach: float) -> float:
    """Take what no sample from time reach on needs singly into the carried values; gives the time from which rows are needed."""
    own = (node.low if node.carry >= 0 else node.high) + 2 * SLACK if node.kind in PAST else 0.0
    reach -= own
    if node.carry >= 0:
        x = [bounds(p, seen) for p in node.parts]
        for _, _, known in x:
            if not known.all():
                reach = min(reach, seen.t[np.argmin(known)])
        k, a = node.carry, np.searchsorted(seen.t, seen.until[node.carry], "left")
        b = np.searchsorted(seen.t, reach, "left")
        if b > a:
            if node.kind == "since":
                phi, psi = operands(node, x[0][0][a:b][::-1], x[1][0][a:b][::-1])
                all_of, zero = np.array([b - a]), np.array([0])
                seen.values[k] = np.maximum(reached(phi, psi, zero, all_of)[0], np.minimum(phi.min(0), seen.values[k]))
            else:
                pick = np.fmin if node.kind == "historically" else np.fmax
                seen.values[k] = pick(seen.values[k], pick.reduce(x[0][0][a:b], axis=0))
            seen.until[k] = reach
        reach = max(reach, seen.until[k]) if seen.until[k] > -INF else reach
    return min((fold(p, seen, reach) for p in node.parts), default=reach)
