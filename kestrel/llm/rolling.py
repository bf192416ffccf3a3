"""Vectorised hashes of runs of words, in bounded memory for texts of any length."""

from __future__ import annotations

import numpy as np

#: Odd multipliers of the two independent polynomial hashes (fixed values).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BLOCK = 1 << 18

U64 = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(base: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _TABLES:
        _TABLES[base] = _powers(base, BLOCK), _powers(pow(base, -1, 1 << 64), BLOCK)
    return _TABLES[base]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of ``values[s:e]`` for each (s, e); both ascending.  It depends on the values alone."""
    up, down = _tables(base)
    n = len(starts)
    low, high = np.empty(n, U64), np.empty(n, U64)
    back = np.empty(n, U64)
    carry, scale, unscale = U64(0), 1, 1
    inverse = pow(base, -1, 1 << 64)
    i = j = 0
    for at in range(0, len(values) + 1, BLOCK):
        v = values[at : at + BLOCK].astype(U64) + U64(1)
        sums = np.zeros(len(v) + 1, U64)
        np.cumsum(v * up[: len(v)], out=sums[1:])
        sums = sums * U64(scale) + carry
        to = np.searchsorted(starts, at + BLOCK, side="left")
        own = starts[i:to] - at
        low[i:to] = sums[own]
        back[i:to] = down[own] * U64(unscale)
        i = to
        to = np.searchsorted(ends, at + BLOCK, side="left")
        high[j:to] = sums[ends[j:to] - at]
        j = to
        carry = sums[-1]
        scale = scale * pow(base, BLOCK, 1 << 64) % (1 << 64)
        unscale = unscale * pow(inverse, BLOCK, 1 << 64) % (1 << 64)
    return _mix((high - low) * back)


class Words:
    """Words of a batch of texts, concatenated; ``first[k]`` is where text k's words begin."""

    def __init__(self, texts: list[bytes | None]):
        split = [(t or b"").split() for t in texts]
        self.count = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        joined = b" ".join(b" ".join(w) for w in split if w)
        lengths = np.fromiter((len(x) for w in split for x in w), dtype=np.int64, count=int(self.first[-1]))
        ends = np.cumsum(lengths + 1) - 1
        self._bytes, self._starts, self._ends = np.frombuffer(joined, dtype=np.uint8), ends - lengths, ends
        self._hash: dict[int, np.ndarray] = {}

    def __len__(self) -> int:
        return int(self.first[-1])

    def windows(self, length: int, base: int = BASES[0], at: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the windows of ``length`` words at ``at`` (default: every start, over text ends too)."""
        if base not in self._hash:
            self._hash[base] = runs(self._bytes, self._starts, self._ends, base)
        at = np.arange(max(0, len(self) - length + 1)) if at is None else at
        return runs(self._hash[base], at, at + length, base)

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1

    def inside(self, at: np.ndarray, length: int) -> np.ndarray:
        """Whether the windows at ``at`` lie in one text."""
        ok = (at >= 0) & (at + length <= len(self))
        k = self.owner(np.where(ok, at, 0))
        return ok & (at + length <= self.first[k + 1])


def slide(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of every ``width`` neighbours, by doubling."""
    pick, have, out = (np.minimum if least else np.maximum), 1, values
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions that are the least of some ``width`` neighbours (all ties)."""
    if len(hashes) < width:
        return np.flatnonzero(hashes == hashes.min()) if len(hashes) else np.empty(0, np.int64)
    low = slide(hashes, width, True)
    pad = np.zeros(width - 1, dtype=hashes.dtype)
    return np.flatnonzero(slide(np.concatenate((pad, low, pad)), width, False) == hashes)
