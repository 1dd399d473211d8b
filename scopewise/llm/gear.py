"""Content-defined chunking with a gear rolling hash, in NumPy.

The gear hash of a position is a shifted sum of table values of the last 32 bytes: each step doubles the hash and
adds the table value of the next byte, in 32 bits, so older bytes fall off the top. It is computed for all
positions at once by doubling: the sum over 2n bytes is the sum over the last n plus the shifted sum over the n
before.
"""

from __future__ import annotations

import numpy as np

#: One random 32-bit value for each byte.
TABLE = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)
#: Bytes hashed at once; bounds the memory for one long text.
BLOCK = 1 << 20
WINDOW = 32


def _hashes(data: np.ndarray) -> np.ndarray:
    out, n = TABLE[data], 1
    while n < WINDOW:
        step = out.copy()
        step[n:] += out[:-n] << np.uint32(n)
        out, n = step, 2 * n
    return out


def cuts(data: np.ndarray, bits: int, least: int, most: int) -> np.ndarray:
    """Ends of the chunks of a byte array: positions, ascending, the last being its length.

    A position is a cut if the top bits of its hash are zero and no such position lies within the ``least`` bytes
    before it, so cuts depend on nearby bytes only and come back after an insertion. Stretches of over ``most`` bytes
    without a cut are cut at their least hash, and then every ``most`` bytes. No cut falls inside a UTF-8 character. On average chunks are 2**bits bytes and a
    little more.
    """
    found = []
    for low in range(0, len(data), BLOCK):
        start = max(0, low - WINDOW)
        hashes = _hashes(data[start : low + BLOCK])[low - start :]
        found.append(np.flatnonzero(hashes >> np.uint32(32 - bits) == 0) + low + 1)
    ends = np.concatenate(found) if found else np.zeros(0, np.int64)
    ends = ends[ends < len(data)]
    ends = ends[data[ends] & 0xC0 != 0x80]
    ends = ends[np.diff(ends, prepend=-least) >= least] if len(ends) else ends
    edges = np.concatenate([[0], ends, [len(data)]])
    wide = np.flatnonzero(np.diff(edges) > most)
    if len(wide):
        ends = np.union1d(ends, np.concatenate([_least_cuts(data, int(edges[i]), int(edges[i + 1]), least, most) for i in wide]))
    return np.append(ends, len(data)) if len(data) else ends


def _least_cuts(data: np.ndarray, start: int, stop: int, least: int, most: int) -> np.ndarray:
    """Cuts within a stretch that has none: wherever the hash is the stretch's least, so that periods are cut alike."""
    found = [start]
    for low in range(start, stop, BLOCK):
        first = max(0, low - WINDOW)
        hashes = _hashes(data[first : min(low + BLOCK, stop)])[low - first :]
        spots = np.arange(low + 1, low + 1 + len(hashes))
        inside = spots < stop
        inside[inside] = data[spots[inside]] & 0xC0 != 0x80
        if inside.any():
            for at in spots[inside & (hashes == hashes[inside].min())].tolist():
                if at - found[-1] >= least:
                    found.append(at)
    edges = np.array([*found, stop])
    forced = np.concatenate([np.arange(a + most, b, most) for a, b in zip(edges[:-1], edges[1:], strict=True)])
    for _ in range(3):
        forced = np.where(data[forced] & 0xC0 == 0x80, forced - 1, forced)
    return np.union1d(found[1:], forced).astype(np.int64)
