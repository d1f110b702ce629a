"""Simple-8b coding of ids in 64-bit words, all blocks of a file at a time.

A word has a selector in its top four bits and 60 bits of payload: COUNTS[s] values of WIDTHS[s] bits each, lowest first.
A value of more than 60 bits is escaped: a word with selector ESCAPE, then the value itself. Blocks of BLOCK values are
coded on their own, so a reader needs only a block's offset.
"""

from __future__ import annotations

import numpy as np

# How many values a word holds under each selector, and their widths in bits.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15
BLOCK = 1024


def _widest(bits: np.ndarray, count: int) -> np.ndarray:
    """Largest of each ``count`` neighbours along the last axis; past the end counts as 255."""
    out, have = bits, 1
    while have < count:
        step = min(have, count - have)
        moved = np.full_like(out, 255)
        moved[:, :-step] = out[:, step:]
        out, have = np.maximum(out, moved), have + step
    return out


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    if not values.size or values.max() < 1 << 53:  # as floating point numbers these are exact
        return np.frexp(values.astype(np.float64))[1].astype(np.uint8)
    bits, rest = np.zeros(values.shape, np.uint8), values.copy()
    for step in (32, 16, 8, 4, 2, 1):
        high = rest >= np.uint64(1) << np.uint64(step)
        bits[high] += step
        rest[high] >>= np.uint64(step)
    return bits + (rest > 0)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offset of each block in words, one more than blocks) of unsigned 64-bit values."""
    blocks = -(-len(values) // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, BLOCK)
    bits = _bit_lengths(grid)
    size = np.full(blocks, BLOCK)
    if blocks:
        size[-1] = len(values) - (blocks - 1) * BLOCK
    bits[np.arange(BLOCK)[None, :] >= size[:, None]] = 255
    selector = np.full(grid.shape, ESCAPE, np.uint8)
    for s in range(len(COUNTS) - 1, -1, -1):  # more values a word is better, so later fits replace earlier ones
        if s == len(COUNTS) - 1 or (bits <= WIDTHS[s]).any():
            selector[_widest(bits, COUNTS[s]) <= WIDTHS[s]] = s
    counts = np.array([*COUNTS, 0, 1])
    step = counts[selector].ravel()
    at, ends = np.arange(blocks) * BLOCK, np.arange(blocks) * BLOCK + size
    found: list[np.ndarray] = []
    while len(at):  # where the next word of every unfinished block begins
        found.append(at)
        at = at + step[at]
        live = at < ends
        at, ends = at[live], ends[live]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    firsts = np.sort(np.concatenate(found))  # blocks follow each other, so this is the order of the words too
    chosen = selector.ravel()[firsts]
    raw = chosen == ESCAPE
    place = np.arange(len(firsts)) + np.cumsum(raw) - raw  # an escaped value takes the word after its own
    made = np.zeros(len(firsts) + int(raw.sum()), np.uint64)
    made[place] = chosen.astype(np.uint64) << np.uint64(60)
    made[place[raw] + 1] = padded[firsts[raw]]
    for s, (count, width) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        own = np.flatnonzero(chosen == s)
        for k in range(count if len(own) else 0):
            made[place[own]] |= padded[firsts[own] + k] << np.uint64(k * width)
    words = np.bincount(firsts // BLOCK, 1 + raw, blocks).astype(np.int64)
    return made, np.concatenate([[0], np.cumsum(words)])


def decode(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Values of whole blocks; ``offsets`` as from ``encode``."""
    if not len(words):
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    is_raw = np.zeros(len(words), bool)
    suspects = np.flatnonzero(selector == ESCAPE)
    starts = set(offsets[:-1].tolist())
    for i in suspects.tolist():  # a raw value may look like an escape itself
        if not is_raw[i] or i in starts:
            is_raw[i + 1 : i + 2] = True
    counts = np.array([*COUNTS, 0, 0])[selector]
    counts[is_raw] = 1
    until = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(until[-1], np.uint64)
    for s, (count, width) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        own = np.flatnonzero((selector == s) & ~is_raw)
        if len(own):
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(width)
            values = (words[own][:, None] >> shifts[None, :]) & np.uint64((1 << width) - 1)
            out[until[own][:, None] + np.arange(count)[None, :]] = values
    out[until[:-1][is_raw]] = words[is_raw]
    return out
