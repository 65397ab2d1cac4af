"""Adaptive context-mixing range coder for token ids, in independently reset, checksummed blocks.

Each block starts with an empty model. Tables of order 2 and order 1 predict the next id from the two ids before it;
one decision asks which prediction holds, at probabilities that mix both orders' records in the logistic domain with
weights learned as it goes. If neither holds, the id is coded by order-0 frequencies, which don't change within a
block: those that the caller gives for all blocks (see ``Order0``), or even ones. All arithmetic is on integers, so
that any machine decodes what another has written.

numpy steps through the blocks of a batch side by side: a lane is a block, and a step codes one id of every lane.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

MAGIC = b"TLRC"
#: Ids a block holds; blocks that are coded side by side at most.
BLOCK, LANES = 2048, 4096
SLOTS2, SLOTS1 = 1024, 512
U = np.uint64
#: A range under this moves out a word of 32 bits. An id narrows it by 30 bits to a seventh at most, so one word is enough.
BOTTOM, WORD, LOW = U(1 << 32), U(32), U((1 << 32) - 1)

# Logistic domain in 8 fraction bits: squash maps -2047..2047 to 1..4095, stretch is its inverse.
SQUASH = np.array([min(4095, max(1, round(4096 / (1 + math.exp(-(x - 2048) / 256))))) for x in range(4096)], np.int32)
STRETCH = (np.searchsorted(SQUASH, np.arange(4096)) - 2048).clip(-2047, 2047).astype(np.int32)

#: Ids that can be coded; what order-0 frequencies sum up to, and the bits of that and of the decision.
IDS, TOTAL, BITS0, BITS = 1 << 16, 1 << 17, U(17), U(15)


class Order0:
    """Order-0 frequencies of ids, from their counts: whole numbers that sum to ``TOTAL``, at least 1 for an id that has a count."""

    def __init__(self, counts: np.ndarray | None = None):
        counts = np.ones(IDS, np.int64) if counts is None else np.asarray(counts, np.int64)
        if len(counts) != IDS or counts.min() < 0 or not counts.any():
            raise ValueError("counts must be one for each of 65536 ids, and not all 0")
        seen = counts > 0
        self.size = np.where(seen, 1 + counts * (TOTAL - int(seen.sum())) // int(counts.sum()), 0)
        self.size[counts.argmax()] += TOTAL - int(self.size.sum())
        self._place()

    def _place(self) -> None:
        self.at = np.repeat(np.arange(IDS, dtype=np.int32), self.size)
        # What lies below an id in the high half, its own frequency in the low one.
        self.span = (((np.cumsum(self.size) - self.size) << 32) + self.size).astype(U)

    def pack(self) -> bytes:
        return zlib.compress(self.size.astype("<u4").tobytes(), 1)  # zlib adds a checksum

    @classmethod
    def unpack(cls, blob: bytes) -> Order0:
        own = cls.__new__(cls)
        own.size = np.frombuffer(zlib.decompress(blob), "<u4").astype(np.int64)
        if len(own.size) != IDS or own.size.sum() != TOTAL:
            raise ValueError("no order-0 frequencies")
        own._place()
        return own


EVEN = Order0()


class Coder:
    """The lanes' range coder state and models. ``words`` is what to decode, or None to encode.

    An encoder's interval is [low, low + range), whose carries go into the words that were moved out; a decoder keeps
    the distance of what it reads from ``low``.
    """

    def __init__(self, lanes: int, steps: int, order0: Order0, words: np.ndarray | None = None):
        self.range = np.full(lanes, (1 << 64) - 1, U)
        self.order0, self.steps = order0, 0
        if words is None:
            self.low, self.at = np.zeros(lanes, U), np.zeros(lanes, np.int64)
            self.out = np.empty((lanes, steps + 2), np.uint32)  # a word an id at most
        else:
            self.flat, self.at = words.reshape(-1), np.arange(lanes) * words.shape[1] + 2
            self.code = (words[:, 0].astype(U) << WORD) | words[:, 1]
        # A lane's predictions by two ids and, behind them, by one: predicted id times 8 plus how sure it is; -8 is none.
        self.base, self.base_r = np.arange(lanes) * (SLOTS2 + SLOTS1) + [[0], [SLOTS2]], np.arange(lanes) * 128
        self.table = np.full(lanes * (SLOTS2 + SLOTS1), -8, np.int32)
        # How often a prediction held, by what is known of both orders (order 2's record is in the high half); weights
        # by decision and order, where a decision's own order has the weight 1 at first as the other has.
        self.records = np.full(lanes * 128, (1024 << 16) + 1024, np.int32)
        self.weight = np.full((2, 2, lanes), 1 << 15, np.int32)

    def _carry(self, lanes: np.ndarray) -> None:
        """Add one to what ``lanes`` have moved out."""
        at = self.at[lanes] - 1
        while len(lanes):
            self.out[lanes, at] += np.uint32(1)
            on = self.out[lanes, at] == 0
            lanes, at = lanes[on], at[on] - 1

    def step(self, n: int, before: np.ndarray, before2: np.ndarray, ids: np.ndarray | None) -> np.ndarray:
        """Code the next id of the first ``n`` lanes after the two before it; gives the ids."""
        rng, slot = self.range[:n], np.empty((2, n), np.int64)
        h = before * np.int32(0x9E3B)
        slot[0] = ((h ^ (before2 * np.int32(0x85EB))) >> 3) & (SLOTS2 - 1)
        slot[1] = (h >> 4) & (SLOTS1 - 1)
        slot += self.base[:, :n]
        old = self.table.take(slot)
        p, c = old >> 3, old & 7
        p2, p1 = p
        own = self.base_r[:n] + ((c[0] << 3) + c[1] + ((p2 == p1) << np.int32(6)))
        both, r = self.records.take(own), np.empty((2, n), np.int32)
        np.right_shift(both, 16, out=r[0])
        np.bitwise_and(both, 0xFFFF, out=r[1])
        x, w = STRETCH.take(r), self.weight[:, :, :n]
        wx = w * x
        mixed = SQUASH.take(((wx[:, 0] + wx[:, 1]) >> 16) + 2048, mode="clip")
        f2 = mixed[0] << 3
        f1 = np.maximum(1, ((32760 - f2) * mixed[1]) >> 12)
        f12 = f2 + f1
        # The interval's part for the decision; of that, if neither prediction holds, the part for the id.
        unit = rng >> BITS
        if ids is None:
            code = self.code[:n]
            value = (code // unit).astype(np.int64)  # a broken block may give anything
            hit2 = value < f2
            hit1 = (value < f12) & ~hit2
        else:
            hit2 = p2 == ids
            hit1 = (p1 == ids) & ~hit2
        plain = ~(hit2 | hit1)
        below = unit * np.where(hit2, 0, np.where(hit1, f2, f12)).astype(U)
        part = unit * np.where(hit2, f2, np.where(hit1, f1, 32768 - f12)).astype(U)
        unit = part >> BITS0
        if ids is None:
            code -= below
            q = np.flatnonzero(plain)
            got = np.where(hit2, p2, p1)
            unit = unit.take(q)
            rest = code.take(q)
            found = self.order0.at.take(np.minimum(rest // unit, U(TOTAL - 1)).astype(np.int64))
            got[q] = found
            span = self.order0.span.take(found)
            code[q] = rest - unit * (span >> WORD)
            part[q] = unit * (span & LOW)
            rng[:] = part
            move = np.flatnonzero(part < BOTTOM)
            at = self.at.take(move)
            code[move] = (code.take(move) << WORD) | self.flat.take(at, mode="clip")
        else:
            got = ids
            q = np.flatnonzero(plain)
            unit, found = unit.take(q), ids.take(q)
            span = self.order0.span.take(found)
            below[q] += unit * (span >> WORD)
            part[q] = unit * (span & LOW)
            low = self.low[:n]
            low += below
            over = low < below
            if over.any():
                self._carry(np.flatnonzero(over))
            rng[:] = part
            move = np.flatnonzero(part < BOTTOM)
            at, l = self.at.take(move), low.take(move)
            self.out[move, at] = l >> WORD
            low[move] = l << WORD
        rng[move] = part.take(move) << WORD
        self.at[move] = at + 1
        # Learn: weights and records of the two decisions; the second is only asked if the first doesn't hold.
        to = np.empty((2, n), np.int32)
        np.multiply(hit2, np.int32(4095), out=to[0])
        np.multiply(hit1, np.int32(4095), out=to[1])
        e = to - mixed
        e[1] *= ~hit2
        w += (x * e[:, None]) >> 10
        self.steps += 1
        if self.steps % 16 == 0:  # a step moves a weight by 8,186 at most, so that sums stay in 32 bits
            np.clip(w, -(1 << 18), 1 << 18, out=w)
        to -= r
        to >>= 4
        to[1] *= ~hit2
        r += to
        self.records[own] = (r[0] << 16) + r[1]
        # A right prediction gets surer, a wrong one less so, and gives way when it is hardly sure any more.
        wrong = np.where(c > 3, old - c + (c >> 1), got << 3)
        self.table[slot] = np.where(p == got, np.minimum(old + 1, old | 7), wrong)
        return got

    def finish(self) -> list[bytes]:
        for s in (WORD, U(0)):
            self.out[np.arange(len(self.at)), self.at] = (self.low >> s).astype(np.uint32)
            self.at += 1
        return [self.out[i, :n].astype("<u4").tobytes() for i, n in enumerate(self.at)]


def _side_by_side(sizes: list[int], words: np.ndarray | None, ids: np.ndarray | None, order0: Order0) -> tuple[Coder, np.ndarray]:
    steps = max(sizes)
    coder, got = Coder(len(sizes), steps, order0, words), np.zeros((steps, len(sizes)), np.int32) if ids is None else ids
    before = before2 = np.zeros(len(sizes), np.int32)
    for t in range(steps):  # all blocks but the last are full, so the lanes still at work are the first ones
        n = len(sizes) - (t >= sizes[-1])
        now = coder.step(n, before[:n], before2[:n], None if ids is None else ids[t, :n])
        if ids is None:
            got[t, :n] = now
        before2, before = before, now
    return coder, np.ascontiguousarray(got.T) if ids is None else got


def encode(ids: np.ndarray, block: int = BLOCK, lanes: int = LANES, order0: Order0 = EVEN) -> bytes:
    """``ids`` (0 to 65,535) as a sequence of blocks: magic, ids, bytes, crc32 of the ids as little-endian uint32, code.

    Every id must have a frequency in ``order0``, which ``decode`` needs again.
    """
    out = []
    for s in range(0, len(ids), block * lanes):
        part = np.asarray(ids[s : s + block * lanes])
        if len(part) and not 0 <= part.min() <= part.max() < IDS:
            raise ValueError("ids must be in 0 to 65535")
        if not order0.size.take(part).all():
            raise ValueError("an id has no frequency")
        sizes = [min(block, len(part) - i) for i in range(0, len(part), block)]
        table = np.zeros((max(sizes), len(sizes)), np.int32)
        for i, n in enumerate(sizes):
            table[:n, i] = part[i * block : i * block + n]
        coder, _ = _side_by_side(sizes, None, table, order0)
        for i, (n, code) in enumerate(zip(sizes, coder.finish(), strict=True)):
            out.append(struct.pack("<4sIII", MAGIC, n, len(code), zlib.crc32(part[i * block : i * block + n].astype("<u4").tobytes())) + code)
    return b"".join(out)


def decode(blob: bytes, lanes: int = LANES, order0: Order0 = EVEN) -> np.ndarray:
    """The ids of all blocks of ``blob``; a block with a wrong checksum raises ValueError."""
    blocks, at = [], 0
    while at < len(blob):
        magic, n, size, crc = struct.unpack_from("<4sIII", blob, at)
        if magic != MAGIC:
            raise ValueError(f"no block at byte {at}")
        blocks.append((n, crc, np.frombuffer(blob, "<u4", size // 4, at + 16)))
        at += 16 + size
    out = []
    for s in range(0, len(blocks), lanes):
        part = blocks[s : s + lanes]
        words = np.zeros((len(part), max(len(w) for _, _, w in part) + 2), np.uint32)
        for i, (_, _, w) in enumerate(part):
            words[i, : len(w)] = w
        _, got = _side_by_side([n for n, _, _ in part], words, None, order0)
        for i, (n, crc, _) in enumerate(part):
            ids = got[i, :n].astype("<u4")
            if zlib.crc32(ids.tobytes()) != crc:
                raise ValueError(f"checksum of block {s + i} differs")
            out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, "<u4")
