"""Words of many texts at once: positions and 64-bit hashes, computed on whole byte arrays.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return.
Its hash is a polynomial over a random byte table modulo 2**64, finished by a bit mixer, so equal words
have equal hashes everywhere and in every run; two different words collide with a chance of about 2**-64.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from descria.llm.common import flat_text, sums_between

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A second table, for a second hash of the same bytes.
CHECK_BYTE = np.random.default_rng(20240612).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UNPUNCTUATED = np.arange(256, dtype=np.uint8)
_UNPUNCTUATED[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64; kept between calls up to 4 million entries."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    made = []
    for factor in (_BASE, pow(_BASE, -1, 2**64)):
        powers = np.full(n, factor, np.uint64)
        powers[0] = 1
        made.append(np.cumprod(powers))
    if n <= 1 << 22:
        _powers = tuple(made)
    return tuple(made)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def plain_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of lower-cased texts in which ASCII punctuation is blank; null counts as empty."""
    raw, offsets = flat_text(pc.utf8_lower(column.fill_null("")))
    return _UNPUNCTUATED[raw], offsets


def is_blank(raw: np.ndarray) -> np.ndarray:
    return _BLANK[raw]


def prefix_hash(raw: np.ndarray, numbers: np.ndarray = _BYTE) -> np.ndarray:
    """Running polynomial hash over a table of byte numbers; see ``span_hash``."""
    powers, _ = _power_tables(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(numbers[raw] * powers[: len(raw)], out=out[1:])
    return out


def span_hash(running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes in each ``starts[i] : ends[i]``, wherever they stand."""
    _, inverse = _power_tables(len(running))
    lengths = (ends - starts).astype(np.uint64)
    return mix((running[ends] - running[starts]) * inverse[starts] + lengths * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    #: Words of text i are first[i] : first[i + 1].
    first: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def split_words(raw: np.ndarray, offsets: np.ndarray, running: np.ndarray | None = None) -> Words:
    inside = ~_BLANK[raw]
    n = len(raw)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | cut[1:n]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | cut[1:n]
    starts = np.flatnonzero(opens)
    ends = np.flatnonzero(closes) + 1
    running = prefix_hash(raw) if running is None else running
    return Words(starts, ends, span_hash(running, starts, ends), np.searchsorted(starts, offsets))


def hash_words(words: list[str]) -> np.ndarray:
    """Hashes of single words, as ``split_words`` gives them."""
    raw, offsets = flat_text(pa.array(words, pa.string()))
    return span_hash(prefix_hash(raw), offsets[:-1], offsets[1:])


def word_grams(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside a text, and the ends by text (as in ``Words.first``)."""
    lengths = np.diff(words.first)
    counts = np.maximum(lengths - size + 1, 0)
    ends = np.concatenate([[0], np.cumsum(counts)])
    n = len(words.hashes)
    if n < size:
        return np.zeros(0, np.uint64), ends
    total = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        total = (total + words.hashes[k : n - size + 1 + k]) * np.uint64(0x9FB21C651E98DF25)
        total ^= total >> np.uint64(29)
    fits = np.arange(n - size + 1) + size <= np.repeat(words.first[1:], lengths)[: n - size + 1]
    return mix(total[fits]), ends


def count_per_text(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return sums_between(flags.astype(np.int64), ends)
