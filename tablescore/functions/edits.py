"""Edit distances of sequences, a line of the table at a time in the bits of one integer.

A line is kept as two bit vectors: where it steps up by one from the place before, and where it steps
down. A token of the other sequence turns them into the next line with some fifteen operations on whole
integers, so a distance takes time in proportion to the product of the lengths over the word size. Any
number of sequences share one integer, each in a field of its own with one bit between them that stops
the carry.
"""

from __future__ import annotations

from collections.abc import Hashable, Sequence

import numpy as np

#: Bits of one integer: what a first-level cache holds of the vectors at work.
MOST_BITS = 1 << 16
#: Sequences up to so many tokens are marked token by token.
FEW_TOKENS = 256
#: Steps between two looks at what the distance can still become.
LOOK = 64


def marks(tokens: Sequence[Hashable], at: list[int] | None = None) -> dict[Hashable, int]:
    """For each token the bits at which it stands."""
    found: dict[Hashable, int] = {}
    if len(tokens) <= FEW_TOKENS:
        for k, t in enumerate(tokens) if at is None else zip(at, tokens, strict=True):
            found[t] = found.get(t, 0) | 1 << k
        return found
    number: dict[Hashable, int] = {}
    coded = np.fromiter((number.setdefault(t, len(number)) for t in tokens), dtype=np.int32, count=len(tokens))
    place = np.arange(len(tokens)) if at is None else np.array(at)
    order = np.argsort(coded, kind="stable")
    ends = np.cumsum(np.bincount(coded, minlength=len(number)))
    size = int(place[-1]) // 8 + 1
    for t, k in number.items():
        some = place[order[ends[k - 1] if k else 0 : ends[k]]]
        bits = np.zeros(size, dtype=np.uint8)
        np.bitwise_or.at(bits, some >> 3, (1 << (some & 7)).astype(np.uint8))
        found[t] = int.from_bytes(bits.tobytes(), "little")
    return found


def edit_distance(a: Sequence[Hashable], b: Sequence[Hashable], most: int | None = None) -> int:
    """Insertions, deletions and replacements between two sequences; most + 1 if they are more than most."""
    lo, least = 0, min(len(a), len(b))
    while lo < least and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < least - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if most is None or most > n:
        most = n
    if n - m > most:
        return most + 1
    if not m:
        return n
    of, full = marks(a).get, (1 << n) - 1
    up, down = full, 0
    for k, t in enumerate(b, 1):
        same = of(t, 0)
        level = ((((same & up) + up) ^ up) | same | down) & full
        right = ((down | (full ^ (level | up))) << 1 | 1) & full
        left = (level & up) << 1
        up = (left | (full ^ (level | right))) & full
        down = right & level
        if k % LOOK == 0 and k + up.bit_count() - down.bit_count() - (m - k) > most:
            return most + 1
    return min(m + up.bit_count() - down.bit_count(), most + 1)


def edit_distances(a: Sequence[Sequence[Hashable]], b: Sequence[Sequence[Hashable]]) -> np.ndarray:
    """edit_distance() of each sequence of a to each of b."""
    out = np.empty((len(a), len(b)), dtype=np.int64)
    start = 0
    while start < len(b):
        end, bits = start, 0
        while end < len(b) and (end == start or bits + len(b[end]) < MOST_BITS):
            bits += len(b[end]) + 1
            end += 1
        out[:, start:end] = to_fields(a, b[start:end])
        start = end
    return out


def to_fields(a: Sequence[Sequence[Hashable]], b: Sequence[Sequence[Hashable]]) -> np.ndarray:
    sizes, starts, at, tokens = [len(y) for y in b], [], [], []
    first = total = full = 0
    for y, n in zip(b, sizes, strict=True):
        starts.append(total)
        if n:
            first |= 1 << total
            full |= ((1 << n) - 1) << total
        at += range(total, total + n)
        tokens += y
        total += n + 1
    of = marks(tokens, at).get
    few = len(b) <= 32
    fields = [(s, (1 << n) - 1) for s, n in zip(starts, sizes, strict=True)] if few else None
    edges, width = np.array([starts, np.add(starts, sizes)]), total // 8 + 1
    out = np.empty((len(a), len(b)), dtype=np.int64)
    known: dict = {}
    for i, x in enumerate(a):
        if (j := known.setdefault(x if isinstance(x, (str, tuple)) else tuple(x), i)) != i:
            out[i] = out[j]
            continue
        up, down = full, 0
        for t in x:
            same = of(t, 0)
            level = ((((same & up) + up) ^ up) | same | down) & full
            right = ((down | (full ^ (level | up))) << 1 & full) | first
            left = (level & up) << 1
            up = (left | (full ^ (level | right))) & full
            down = right & level
        if few:
            out[i] = [len(x) + (up >> s & m).bit_count() - (down >> s & m).bit_count() for s, m in fields]
        else:
            steps = [np.concatenate([[0], np.cumsum(np.unpackbits(np.frombuffer(v.to_bytes(width, "little"), dtype=np.uint8), bitorder="little"), dtype=np.int64)]) for v in (up, down)]
            change = steps[0] - steps[1]
            out[i] = len(x) + change[edges[1]] - change[edges[0]]
    return out
