"""Token ids of whole texts, with what was encoded before kept for later words.

A text is cut before every single blank that stands between two other characters, on both sides of such a line end, and between
a letter and a sign that ends a clause. No token of the two vocabularies used
here crosses such a cut, and what follows it is encoded alike after any words, so the ids of a piece may be
kept and used again, found by two 64-bit hashes of its bytes. Of a vocabulary of lower-case text pieces are kept in lower case. A text with other runs of white space, with white space at an
end, or with the literal text of a special token is encoded as it is.
Pieces of plain letters and signs are joined by a mark that is an id of its own, so that one call encodes many of them.
"""

from __future__ import annotations

import os
import re
from string import ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from descria.llm.common import flat_text
from descria.llm.words import CHECK_BYTE, prefix_hash, span_hash

#: Pieces kept for each process; about 50 bytes each.
KEPT_PIECES = 1_500_000
#: Bytes of text whose pieces are looked up together.
SLICE = 1 << 20

_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_SIGNS = r"!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~'"
#: Pieces that may be joined by a mark: letters and signs, with or without the blank before them.
_PLAIN = rf"\A ?[{_LETTERS}{_SIGNS}]+\z"
#: Texts that are not cut: white space at an end, next to other white space, or of a rarer kind.
_WHOLE = (
    r"\A[\t-\r ]|[\t-\r ]\z|[\t-\r ][\t-\r ]|"
    r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
_CLAUSE_ENDS = np.isin(np.arange(256), list(b".,;:!?"))
#: Pieces joined in one text for the tokenizer.
_GROUP = 500


class KeptPieces:
    """Ids of pieces by two hashes: a few sorted runs of hashes, and one array with all ids.

    A full store goes on with those pieces that were asked for again, at most half of what it may hold.
    """

    def __init__(self):
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.used = 0, 0
        self.starts, self.counts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, "<u4")
        self.asked = np.zeros(0, np.uint8)

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Number of each piece, -1 if it isn't kept."""
        found = np.full(len(keys), -1, np.int64)
        for own, own_checks, numbers in self.runs:
            at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
            same = (own[at] == keys) & (own_checks[at] == checks)
            found[same] = numbers[at[same]]
        known = found[found >= 0]
        self.asked[known] = np.minimum(self.asked[known], 254) + 1
        return found

    def add(self, keys: np.ndarray, checks: np.ndarray, ids: list[bytes]) -> None:
        """Keeps pieces with distinct, ascending keys that aren't kept yet."""
        if self.size + len(keys) > KEPT_PIECES:
            self._shrink()
        counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self._append(keys, checks, counts, np.frombuffer(b"".join(ids), "<u4"))

    def _shrink(self) -> None:
        keys, checks, numbers = (np.concatenate(x) for x in zip(*self.runs, strict=True))
        good = np.flatnonzero(self.asked[numbers] > 0)
        if len(good) > KEPT_PIECES // 2:
            good = good[np.argsort(-self.asked[numbers[good]].astype(np.int64), kind="stable")[: KEPT_PIECES // 2]]
        good = good[np.argsort(keys[good])]
        keys, checks, numbers = keys[good], checks[good], numbers[good]
        starts, counts = self.starts[numbers], self.counts[numbers].astype(np.int64)
        ids = self.ids[_spread(starts, counts)]
        self.__init__()
        if len(keys):
            self._append(keys, checks, counts, ids)

    def _append(self, keys: np.ndarray, checks: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        run = (keys, checks, np.arange(self.size, self.size + len(keys)))
        starts = self.used + np.concatenate([[0], np.cumsum(counts)])
        self.starts = _grown(self.starts, self.size, starts[:-1])
        self.counts = _grown(self.counts, self.size, counts)
        self.ids = _grown(self.ids, self.used, ids)
        self.asked = _grown(self.asked, self.size, np.zeros(len(keys), np.uint8))
        self.size, self.used = self.size + len(keys), int(starts[-1])
        while self.runs and len(self.runs[-1][0]) < 4 * len(run[0]):
            merged = [np.concatenate(x) for x in zip(self.runs.pop(), run, strict=True)]
            order = np.argsort(merged[0], kind="stable")
            run = tuple(x[order] for x in merged)
        self.runs.append(run)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places ``starts[i]`` to ``starts[i] + counts[i]`` of all i one after another."""
    until = np.cumsum(counts)
    return np.repeat(starts - until + counts, counts) + np.arange(until[-1] if len(until) else 0)


def _cuts(raw: np.ndarray) -> np.ndarray:
    """Where a piece may begin: at a blank, at and after a line end, and at a sign that ends a clause and follows a letter."""
    line_end = raw == 10
    letter = ((raw | 32) - np.uint8(97)) < 26
    cut = (raw == 32) | line_end
    cut[1:] |= line_end[:-1] | (_CLAUSE_ENDS[raw[1:]] & letter[:-1])
    return cut


def _folded(raw: np.ndarray) -> np.ndarray:
    """``raw`` with A-Z in lower case, but for those before a byte beyond ASCII, which may be a mark that joins the letter."""
    upper = (raw - np.uint8(65)) < 26
    upper[:-1] &= raw[1:] < 128
    return raw | (upper.astype(np.uint8) << 5)


def _grown(held: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``held`` with ``more`` after its first ``used`` entries; room grows by a quarter."""
    if used + len(more) > len(held):
        room = np.zeros((used + len(more)) * 5 // 4, held.dtype)
        room[:used] = held[:used]
        held = room
    held[used : used + len(more)] = more
    return held


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, as the library gives them with its own settings."""

    def __init__(self, path: str):
        # Tasks share the cores already: the library's own threads would only take them from each other, and memory too.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        # The library would keep words too, but only distinct pieces are sent to it; its store then costs more than it saves.
        self.tokenizer.model._resize_cache(0)
        self.pieces = KeptPieces()
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([_WHOLE, *(f"(?i:{x})" for x in special)])
        # A mark between pieces: encoded alone, it must come out as one id that no plain piece contains.
        self.mark = next((m for m in ("\n", " 0") if self._separates(m)), None)
        # Where the vocabulary is one of lower-case text, pieces that differ in case are one.
        capitals = " ".join([ascii_uppercase, *ascii_uppercase])
        self.folds = self._ids([capitals]) == self._ids([capitals.lower()])
        self.mark_id = int(np.frombuffer(self._ids([self.mark])[0], "<u4")[0]) if self.mark else None

    def _separates(self, mark: str) -> bool:
        pieces = [" b", " a,", "a'", "b.", " ,", "-a", " 's", "c"]
        apart = self._ids([mark, *pieces])
        return len(apart[0]) == 4 and self._ids([mark.join(pieces)]) == [apart[0].join(apart[1:])]

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _piece_ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces that aren't kept: plain ones many at a time, the others each."""
        plain = np.zeros(len(pieces), bool)
        if self.mark is not None:
            plain = pc.match_substring_regex(pa.array(pieces, pa.large_string()), _PLAIN).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(plain).tolist()
        groups = [[pieces[i] for i in at[k : k + _GROUP]] for k in range(0, len(at), _GROUP)]
        joined: list[bytes] = []
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([self.mark.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark_id).tolist()
            if len(cuts) != len(group) - 1:
                joined += self._ids(group)
                continue
            data = ids.tobytes()
            joined += [data[4 * a : 4 * b] for a, b in zip([0, *[c + 1 for c in cuts]], [*cuts, len(ids)], strict=True)]
        if len(at) == len(pieces):
            return joined
        some, others = iter(joined), iter(self._ids([pieces[i] for i in np.flatnonzero(~plain).tolist()]))
        return [next(some) if one else next(others) for one in plain.tolist()]

    def _slice_ids(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, ids of all of them); pieces begin at ``starts`` and fill ``raw``."""
        ends = np.append(starts[1:], len(raw))
        keys, place, which = np.unique(span_hash(prefix_hash(raw), starts, ends), return_index=True, return_inverse=True)
        checks = span_hash(prefix_hash(raw, CHECK_BYTE), starts[place], ends[place])
        number = self.pieces.find(keys, checks)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            at, data = place[missing], raw.tobytes()
            ids = self._piece_ids([data[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            before = self.pieces.size
            self.pieces.add(keys[missing], checks[missing], ids)
            if self.pieces.size != before + len(missing):  # it was full, so earlier numbers are void
                return self._slice_ids(raw, starts)
            number[missing] = np.arange(before, self.pieces.size)
        number = number[which]
        counts = self.pieces.counts[number].astype(np.int64)
        return counts, self.pieces.ids[_spread(self.pieces.starts[number], counts)]

    def _cut_ids(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts that may be cut at every place of ``_cuts``."""
        raw, offsets = flat_text(texts)
        cut = _cuts(raw)
        cut[offsets[:-1]] = True
        starts = np.flatnonzero(cut)
        if self.folds:
            raw = _folded(raw)
        counts, ids, first = [], [], 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(starts, starts[first] + SLICE)))
            stop = starts[last] if last < len(starts) else len(raw)
            n, own = self._slice_ids(raw[starts[first] : stop], starts[first:last] - starts[first])
            counts.append(n), ids.append(own)
            first = last
        until = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        data = np.concatenate(ids).tobytes()
        bounds = (4 * until[np.searchsorted(starts, offsets)]).tolist()
        return [data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text; null counts as empty."""
        texts = texts.fill_null("").cast(pa.large_string())
        whole = pc.or_(pc.match_substring_regex(texts, self.whole), pc.equal(pc.binary_length(texts), 0))
        kept = iter(self._ids(texts.filter(whole).to_pylist()))
        rest = texts.filter(pc.invert(whole))
        cut = iter(self._cut_ids(rest) if len(rest) else [])
        return [next(kept) if one else next(cut) for one in whole.to_pylist()]

    def forget(self) -> None:
        """Gives the memory of kept pieces back, for example at the end of a task."""
        self.pieces = KeptPieces()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this process for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
