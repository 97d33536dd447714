"""Simple-8b: each 64-bit word holds a 4-bit selector and as many equally wide values as fit 60 bits."""

from __future__ import annotations

import numpy as np

#: Values per word and bits per value of selectors 1 to 14. Selector 15 is an escape: its word carries
#: how many raw 64-bit words follow (values of over 60 bits).
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0])
WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0])
ESCAPE = 15
#: Values in a block; a block starts at a word of its own, so blocks decode one without the others.
BLOCK = 8192


#: Bits of the values that token ids mostly are.
_SMALL = np.concatenate([[1], np.floor(np.log2(np.arange(1, 1 << 17))).astype(np.int8) + 1]).astype(np.int8)


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs, at least one."""
    if len(values) and values.max() < len(_SMALL):
        return _SMALL[values.astype(np.int64)]
    v = values.copy()
    n = np.ones(len(v), np.int8)
    for s in (32, 16, 8, 4, 2, 1):
        high = v >> np.uint64(s)
        wide = high > 0
        n += wide * s
        v = np.where(wide, high, v)
    return n


def _windows(bits: np.ndarray):
    """(selector, most bits in the window from each place), the window as long as the selector's count;
    a longer window is the union of two shorter ones."""
    most = {1: bits}
    for s, (a, b) in ((13, (1, 1)), (12, (2, 1)), (11, (2, 2)), (10, (4, 1)), (9, (4, 2)), (8, (4, 3)), (7, (4, 4)), (6, (8, 2)), (5, (8, 4)), (4, (8, 7)), (3, (12, 8)), (2, (20, 10)), (1, (30, 30))):
        n = len(bits) - a - b + 1
        if n <= 0:
            return
        most[a + b] = np.maximum(most[a][:n], most[b][a : a + n])
        if most[a + b].min() <= WIDTHS[s]:
            yield s, most[a + b]


def _encode_block(values: np.ndarray) -> np.ndarray:
    """The words of one block. At each place the selector that packs most values wins."""
    n, bits = len(values), _bits(values)
    if n and bits.max() > 60:
        return _encode_wide(values, bits)
    best = np.full(n, 14, np.int8)
    for s, most in _windows(bits.astype(np.int8)):
        best[: len(most)] = np.minimum(best[: len(most)], np.where(most <= WIDTHS[s], np.int8(s), np.int8(14)))
    jumps = COUNTS[best].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += jumps[i]
    at = np.array(starts, np.int64)
    chosen = best[at].astype(np.int64)
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        own = np.flatnonzero(chosen == s)
        for k in range(int(COUNTS[s])):
            words[own] |= values[at[own] + k] << np.uint64(k * int(WIDTHS[s]))
    return words


def _encode_wide(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """A block with values of over 60 bits: runs of them go raw behind an escape word."""
    edges = np.flatnonzero(np.diff((bits > 60).astype(np.int8))) + 1
    out = []
    for part, wide in zip(np.split(values, edges), np.split(bits > 60, edges), strict=True):
        out += [np.array([ESCAPE << 60 | len(part)], np.uint64), part] if wide[0] else [_encode_block(part)]
    return np.concatenate(out)


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): block i of the values is words[offsets[i]:offsets[i + 1]]."""
    values = np.ascontiguousarray(values, np.uint64)
    parts = [_encode_block(values[i : i + block]) for i in range(0, len(values), block)]
    offsets = np.cumsum([0, *map(len, parts)])
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), offsets.astype(np.int64)


def decode_block(words: np.ndarray) -> np.ndarray:
    """The values of one block's words."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    if (selectors == ESCAPE).any():
        return _decode_wide(words)
    counts = COUNTS[selectors]
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in np.unique(selectors):
        own = np.flatnonzero(selectors == s)
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for k in range(int(COUNTS[s])):
            out[ends[own] - counts[own] + k] = (words[own] >> np.uint64(k * int(WIDTHS[s]))) & mask
    return out


def _decode_wide(words: np.ndarray) -> np.ndarray:
    out, i = [], 0
    while i < len(words):  # raw words may look like any selector, so escapes are met in order
        if int(words[i]) >> 60 == ESCAPE:
            n = int(words[i]) & (1 << 60) - 1
            out.append(words[i + 1 : i + 1 + n])
            i += 1 + n
        else:
            s = int(words[i]) >> 60
            shifts = np.arange(int(COUNTS[s]), dtype=np.uint64) * np.uint64(WIDTHS[s])
            out.append((words[i] >> shifts) & np.uint64((1 << int(WIDTHS[s])) - 1))
            i += 1
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def decode(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """All values; the inverse of encode. Blocks without an escape are unpacked together."""
    if not ((words >> np.uint64(60)) == ESCAPE).any():
        return decode_block(words)
    parts = [decode_block(words[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)
