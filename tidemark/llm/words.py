"""Words of whole texts as 64-bit hashes, for many texts at once in numpy.

Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. A word's hash is a polynomial over its bytes, each
byte first mapped to a fixed random number, modulo 2**64, then mixed. Positions' powers are divided
out, which works as the base is odd.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MAP = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MAP[65:91] = _MAP[97:123]
_BASE = 0x9E3779B97F4A7C15
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int):
    if len(_POWERS["up"]) < n + 1:
        n = 1 << (n + 1).bit_length()
        for name, x in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            step = np.full(n, x, np.uint64)
            step[0] = 1
            _POWERS[name] = np.cumprod(step, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and n + 1 offsets of the texts. No nulls."""
    texts = texts if texts.type == pa.large_binary() else texts.cast(pa.large_string())
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offs[-1] == offs[0]:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offs[0] : offs[-1]]
    offs = offs - offs[0]
    n = len(data)
    inside = ~_SPACE[data]
    edge = np.empty(n, bool)
    edge[0], edge[1:] = True, ~inside[:-1]
    edge[offs[:-1][offs[:-1] < n]] = True
    starts = np.flatnonzero(inside & edge)
    edge[-1], edge[:-1] = True, ~inside[1:]
    last = offs[1:] - 1
    edge[last[last >= 0]] = True
    ends = np.flatnonzero(inside & edge) + 1
    up, down = _powers(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_MAP[data] * up[:n], out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(starts, offs)
