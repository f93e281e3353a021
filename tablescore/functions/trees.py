"""Distance of two ordered trees of any shape, by lines of forests.

For every node that has a left sibling (and the root) there is a table of distances between the forests
of its subtree and those of such a node of the other tree. For one node of the first tree the tables with
all nodes of the second are filled together: a line holds the distances of one forest to all forests of
all those subtrees, side by side, and takes a handful of array operations. Subtrees of the second tree are
grouped by how deep others are nested in them, as those inside come first, and by size. Small trees are filled in
place by place.
"""

from __future__ import annotations

import numpy as np

#: Places in all tables of two trees up to which they are filled in one by one.
FEW_PLACES = 20_000


def roots_of(left: list[int]) -> list[int]:
    """The nodes that have a left sibling, and the root."""
    return sorted({l: k for k, l in enumerate(left)}.values())


class Side:
    """The second tree's subtrees with a left sibling above them, in groups that are filled at once."""

    def __init__(self, left: list[int]):
        roots = roots_of(left)
        # How many subtrees of the list are nested in one another at most, below each.
        height = [0] * len(roots)
        open_: list[int] = []  # roots of which none is inside a later one so far
        for k, j in enumerate(roots):
            while open_ and roots[open_[-1]] >= left[j]:
                height[k] = max(height[k], height[open_.pop()] + 1)
            open_.append(k)
        groups: dict[tuple[int, int], list[int]] = {}
        for k, j in enumerate(roots):
            groups.setdefault((height[k], (j - left[j]).bit_length()), []).append(j)
        self.groups = []
        at = np.array(left)
        for _, js in sorted(groups.items()):
            first, last = at[js], np.array(js)
            width = int((last - first).max()) + 1
            y = first[:, None] + np.arange(width)[None]
            there = y <= last[:, None]
            y = np.where(there, y, last[:, None])
            edge = (at[y] == first[:, None]) & there
            self.groups.append((y, np.maximum(at[y] - first[:, None], 0), edge, ~edge & there, np.arange(width + 1, dtype=float)))


def tree_distance(left_a: list[int], left_b: list[int], renames: np.ndarray) -> float:
    """Least cost of turning the first tree into the second: insertions and deletions at 1, renames (0 to 1) by
    node of the first and of the second. Trees are given by the leftmost leaf of each node in post-order."""
    n, m = len(left_a), len(left_b)
    if not n or not m:
        return float(max(n, m))
    size = lambda left: sum(k - left[k] + 2 for k in roots_of(left))
    if size(left_a) * size(left_b) <= FEW_PLACES:
        return by_place(left_a, left_b, renames.tolist())
    groups = Side(left_b).groups
    whole = np.zeros((n, m))
    last_use = {l: k for k, l in enumerate(left_a)}  # the last node with this leftmost leaf
    for i in sorted(last_use.values()):
        li = left_a[i]
        # Lines of each group before the leftmost leaf of a subtree that is not finished.
        lines = [np.tile(g[4], (len(g[0]), 1)) for g in groups]
        kept = {li: lines}
        for x in range(li, i + 1):
            lx = left_a[x]
            if lx == x:
                kept[x] = lines
            apart = kept[lx]
            if last_use[lx] == x:
                del kept[lx]
            new = []
            for (y, before, edge, inner, steps), line, start in zip(groups, lines, apart, strict=True):
                best = np.empty_like(line)
                best[:, 0] = line[:, 0] + 1.0
                below = line[:, 1:] + 1.0
                other = np.take_along_axis(start, before, axis=1) + whole[x][y]
                if lx == li:
                    # Whole subtrees on both sides: a rename, after what stands before them.
                    other = np.where(inner, other, line[:, :-1] + renames[x][y])
                best[:, 1:] = np.minimum(below, other)
                best = np.minimum.accumulate(best - steps, axis=1) + steps
                if lx == li:
                    whole[x][y[edge]] = best[:, 1:][edge]
                new.append(best)
            lines = new
    return float(whole[n - 1, m - 1])


def by_place(left_a: list[int], left_b: list[int], renames: list[list[float]]) -> float:
    """tree_distance() with a step for each place."""
    whole = [[0.0] * len(left_b) for _ in left_a]
    for i in roots_of(left_a):
        li = left_a[i]
        for j in roots_of(left_b):
            lj = left_b[j]
            last = [float(k) for k in range(j - lj + 2)]
            lines = [last]
            for x in range(li, i + 1):
                on_edge, apart, done, cost = left_a[x] == li, lines[left_a[x] - li], whole[x], renames[x]
                before = last[0] + 1.0
                line = [before]
                for y in range(lj, j + 1):
                    k = y - lj
                    edge = on_edge and left_b[y] == lj
                    before = min(last[k + 1] + 1.0, before + 1.0, last[k] + cost[y] if edge else apart[left_b[y] - lj] + done[y])
                    if edge:
                        done[y] = before
                    line.append(before)
                lines.append(line)
                last = line
    return whole[-1][-1]
