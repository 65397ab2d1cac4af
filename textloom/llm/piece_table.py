"""Ids of pieces of text, looked up many at a time: a table in numpy of a fixed size, where a new piece takes an old one's place."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

U = np.uint64
#: Slots, as a power of two; bytes of the longest piece that goes into a slot; pieces that are looked up together.
SLOT_BITS, LONGEST, TOGETHER = 21, 23, 1 << 16
#: Ids, and bytes of pieces that are in no slot, with which a table is full.
IDS_HELD, BYTES_HELD = 1 << 24, 1 << 25
#: A row is three words of the piece, of which the highest byte is its length and kind, and where its ids are.
ROW = np.dtype("V32")
MASKS = [np.array([(1 << 8 * min(8, max(0, n - s))) - 1 for n in range(LONGEST + 1)], U) for s in (0, 8, 16)]


class PieceTable:
    """``learn(pieces)`` gives the ids of distinct pieces, as bytes of uint16.

    A piece's place is the start of its ids in ``ids`` times 2^32, plus their number. A space that a piece begins with
    is kept as its kind, 1, and not among its bytes.
    """

    def __init__(self, learn: Callable[[list[bytes]], list[bytes]]):
        self.learn = learn
        self.ids = np.empty(1 << 20, np.uint16)
        self.clear()

    def clear(self) -> None:
        self.rows = np.full((1 << SLOT_BITS, 4), U(0xFF << 56), U)  # no piece has that length
        self.longer, self.used, self.longer_bytes = {}, 0, 0

    def clear_if_full(self) -> None:
        if self.used > IDS_HELD or self.longer_bytes > BYTES_HELD:
            self.clear()

    def _keep(self, raw: list[bytes]) -> np.ndarray:
        """The places of new ids."""
        new, n = np.frombuffer(b"".join(raw), np.uint16), np.array([len(x) // 2 for x in raw], np.int64)
        if self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(self.used + len(new), np.uint16)])
        self.ids[self.used : self.used + len(new)] = new
        places = ((self.used + np.cumsum(n) - n) << 32) + n
        self.used += len(new)
        return places

    def places(self, text: bytes, start: np.ndarray, size: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The places of the pieces of ``text`` that begin at ``start`` and have ``size`` bytes; of kind 1, behind a space there."""
        words, slices = np.frombuffer(text + bytes(40 - len(text) % 8), "<u8"), range(0, max(len(start), 1), TOGETHER)
        return np.concatenate([self._places(text, words, *(x[s : s + TOGETHER] for x in (start, size, kind))) for s in slices])

    def _places(self, text: bytes, words: np.ndarray, start: np.ndarray, size: np.ndarray, kind: np.ndarray) -> np.ndarray:
        at, right = start >> 3, ((start & 7) << 3).astype(U)
        left, short = U(64) - right, np.minimum(size, LONGEST)
        w = [words.take(at + i) for i in range(4)]
        key = [((w[i] >> right) | (w[i + 1] << left)) & MASKS[i].take(short) for i in range(3)]  # a shift by 64 gives 0
        key[2] |= (short + 32 * kind).astype(U) << U(56)
        h = key[0] * U(0x9E3779B97F4A7C15) + key[1] * U(0xC2B2AE3D27D4EB4F) + key[2] * U(0x165667B19E3779F9)
        h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
        slot = (h >> U(64 - SLOT_BITS)).astype(np.int64)
        row = self.rows.reshape(-1).view(ROW).take(slot).view(U).reshape(-1, 4)
        places = row[:, 3].astype(np.int64)
        fits = size <= LONGEST
        lost = np.flatnonzero(~((row[:, 0] == key[0]) & (row[:, 1] == key[1]) & (row[:, 2] == key[2]) & fits))
        if len(lost):
            named = [text[a:b] for a, b in zip((start - kind)[lost].tolist(), (start + size)[lost].tolist(), strict=True)]
            found = dict.fromkeys(named)
            if self.longer:
                found.update((x, self.longer[x]) for x in found.keys() & self.longer.keys())
            new = [x for x, place in found.items() if place is None]
            if new:
                found.update(zip(new, self._keep(self.learn(new)).tolist(), strict=True))
                longer = {x: found[x] for x in new if len(x) > LONGEST}
                self.longer.update(longer)
                self.longer_bytes += sum(map(len, longer))
            places[lost] = list(map(found.__getitem__, named))
            lost = lost[fits[lost]]
            self.rows[slot[lost]] = np.stack([key[0][lost], key[1][lost], key[2][lost], places[lost].astype(U)], axis=1)
        return places

    def places_of(self, pieces: list[bytes]) -> np.ndarray:
        text, size = b"".join(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        start = np.cumsum(size) - size
        kind = ((np.frombuffer(text + b"x", np.uint8).take(start) == 32) & (size > 0)).astype(np.int64)
        return self.places(text, start + kind, size - kind, kind)

    def gather(self, places: np.ndarray) -> np.ndarray:
        """The ids of all ``places``, one behind the other."""
        n = places & 0xFFFFFFFF
        ends = np.cumsum(n)
        return self.ids.take(np.repeat((places >> 32) - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0))
