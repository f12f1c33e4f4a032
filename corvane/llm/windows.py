"""Hashes of all windows of many texts at once, in numpy.

Texts are laid end to end as code points. With S[i] = sum of mixed code points times B^j (mod 2^64, B odd), the hash of any
stretch [a, b) is (S[b] - S[a]) * B^-a, so a hash of any length costs one subtraction and one product. Minimisers are
found with a 32-bit order hash above a 32-bit position: ties go to the leftmost, which depends on the window's content alone.
"""

from __future__ import annotations

import numpy as np

#: Code points per block; longer texts are cut by cut_long().
BLOCK = 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Stretch:
    """Hashes of stretches of a block of code points."""

    def __init__(self, codes: np.ndarray, base: int = 0):
        b = _BASES[base]
        n = len(codes)
        power = np.full(n + 1, b, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        back = np.full(n + 1, pow(b, -1, 1 << 64), np.uint64)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        self.back = back
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(codes.astype(np.uint64) + np.uint64(base + 1)) * power[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts])


def cut_long(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(text, offset, piece): texts longer than a block in pieces that overlap by k - 1, so that no window is lost."""
    whole, at, parts = [], [], []
    for i, t in enumerate(texts):
        for o in range(0, max(1, len(t) - k + 1), BLOCK) if len(t) > BLOCK else (0,):
            whole.append(i)
            at.append(o)
            parts.append(t[o : o + BLOCK + k - 1] if len(t) > BLOCK else t)
    return np.array(whole, np.int64), np.array(at, np.int64), parts


def blocks(texts: list[str]):
    """(index of the first text, code points of a block, start of each of its texts and the end)."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        if held and size + len(t) > BLOCK:
            yield first, _codes(held), _edges(held)
            first, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield first, _codes(held), _edges(held)


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _edges(texts: list[str]) -> np.ndarray:
    return np.cumsum([0, *map(len, texts)])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """out[i] = min(x[i : i + w]); len(x) - w + 1 values."""
    step = 1
    while step * 2 <= w:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (w - step)], x[w - step :]) if w > step else x


def minimised(codes: np.ndarray, edges: np.ndarray, m: int, w: int):
    """Runs of windows of m + w - 1 code points with the same minimiser: (text, start, windows, place of the minimiser), places
    in the block; and the block's Stretch."""
    k, n = m + w - 1, len(codes)
    none = np.zeros(0, np.int64)
    if n < k:
        return none, none, none, none, None
    s = Stretch(codes)
    at = np.arange(n - m + 1)
    order = (s.of(at, at + m) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    place = (sliding_min(order, w) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges))[: n - k + 1]
    fits = np.arange(n - k + 1) + k <= edges[1:][owner]
    new = np.empty(n - k + 1, bool)
    new[:1] = True
    new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    idx = np.flatnonzero(fits)
    if not len(idx):
        return none, none, none, none, s
    begins = new[idx] | np.r_[True, np.diff(idx) > 1]
    starts = idx[begins]
    runs = np.diff(np.r_[np.flatnonzero(begins), len(idx)])
    return owner[starts], starts, runs, place[starts], s


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)
