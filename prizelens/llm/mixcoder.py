"""An adaptive context-mixing range coder for token ids, in independent blocks.

An id is predicted by the id that last followed the two ids before it (order 2) and the
one before it (order 1), each with a confidence that grows with every hit, and by adaptive
frequencies (order 0). The joint state of the two predictions, their confidences and
whether they agree, selects adaptive odds of an order-2 hit, an order-1 hit or neither:
that is how their evidence is mixed. What neither predicts is coded by its eight leading
bits with adaptive order-0 frequencies and its remaining bits as they are. One range coder
step per id holds all three, with odds of 12 bits each.

Counts are taken with every id; the odds follow from them by whole-number arithmetic after
16, 32, 64, ... and then every ``RENEW`` ids, so every machine agrees. A block starts from
nothing, so blocks are independent; many blocks are coded side by side, one array element
each, which is what makes numpy fast enough here.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK_IDS = 8_192
LANES = 1_024  # blocks coded side by side at most
SLOTS2, SLOTS1 = 2_048, 1_024
RENEW = 256
CONFIDENT = 3
STATES = 2 * (CONFIDENT + 1) ** 2
ODDS = 12  # bits of a choice and of an order-0 frequency
SURE = np.int32(1 << 24)
ID = np.int32((1 << 24) - 1)
U = np.uint64


def renewals(t: int) -> bool:
    return t >= 16 and (t & (t - 1) == 0 if t < RENEW else t % RENEW == 0)


class Model:
    """The predictions of ``n`` blocks; encoder and decoder drive it alike."""

    def __init__(self, n: int, bits: int, inverse: bool):
        if not 8 <= bits <= 24:
            raise ValueError("ids need 8 to 24 bits")
        self.shift, self.inverse = bits - 8, inverse
        rows = np.arange(n, dtype=np.int32)
        self.table2 = np.full(n * SLOTS2, ID, np.int32)
        self.table1 = np.full(n * SLOTS1, ID, np.int32)
        self.base2, self.base1 = rows * SLOTS2, rows * SLOTS1
        self.base_s, self.base_t, self.base_o = rows * STATES, rows * 257, rows * 256
        self.base_i = rows.astype(np.int64) << ODDS
        self.last1, self.last2 = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.counts = np.tile(np.array([1, 1, 6, 0], np.int32), n * STATES)
        self.order0 = np.ones(n * 256, np.int32)
        self.renew(0)

    def renew(self, t: int) -> None:
        c = self.counts.reshape(-1, 4)
        total = c.sum(1)
        self.hit2_odds = (1 + c[:, 0] * 4090 // total).astype(U)
        self.hit1_odds = (1 + c[:, 1] * 4090 // total).astype(U)
        o = self.order0.reshape(-1, 256)
        freq = 1 + o * ((1 << ODDS) - 256) // o.sum(1, keepdims=True)
        freq[np.arange(len(o)), o.argmax(1)] += (1 << ODDS) - freq.sum(1)
        starts = np.zeros((len(o), 257), np.int64)
        np.cumsum(freq, axis=1, out=starts[:, 1:])
        self.starts = starts.reshape(-1).astype(U)
        if self.inverse:
            symbols = np.tile(np.arange(256, dtype=np.uint8), len(o))
            self.symbol = np.repeat(symbols, freq.ravel())
        if t and t % (4 * RENEW) == 0:  # older counts lose weight
            self.counts -= self.counts >> 1 & ~(self.counts == 1)
            self.order0 -= self.order0 >> 1

    def narrow(self, n: int) -> None:
        """Go on with the first ``n`` blocks."""
        for name, per in (
            ("table2", SLOTS2), ("table1", SLOTS1), ("base2", 1), ("base1", 1), ("base_s", 1),
            ("base_t", 1), ("base_o", 1), ("base_i", 1), ("last1", 1), ("last2", 1),
            ("counts", 4 * STATES), ("order0", 256), ("hit2_odds", STATES), ("hit1_odds", STATES),
            ("starts", 257),
        ):
            setattr(self, name, getattr(self, name)[: n * per])
        if self.inverse:
            self.symbol = self.symbol[: n << ODDS]

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """Odds of an order-2 and of an order-1 hit."""
        mixed = self.last1 * np.int32(40_503) + self.last2 * np.int32(10_007)
        self.at2 = self.base2 + ((mixed ^ (mixed >> 7)) & (SLOTS2 - 1))
        self.at1 = self.base1 + ((self.last1 ^ (self.last1 >> 7)) & (SLOTS1 - 1))
        self.entry2, self.entry1 = self.table2[self.at2], self.table1[self.at1]
        self.id2, self.id1 = self.entry2 & ID, self.entry1 & ID
        self.sure2, self.sure1 = self.entry2 >> 24, self.entry1 >> 24
        joint = (self.sure2 << 3) + (self.sure1 << 1) + (self.id2 == self.id1)
        self.state = self.base_s + joint
        return self.hit2_odds[self.state], self.hit1_odds[self.state]

    def update(self, ids, hit2, hit1, top) -> None:
        self.counts[(self.state << 2) + 2 - 2 * hit2 - hit1] += 1
        self.order0[self.base_o + top] += 8
        fresh = ids | SURE
        for table, at, entry, sure, hit in (
            (self.table2, self.at2, self.entry2, self.sure2, hit2),
            (self.table1, self.at1, self.entry1, self.sure1, self.id1 == ids),
        ):
            more = entry + SURE * (sure < CONFIDENT)
            table[at] = np.where(hit, more, np.where(sure > 1, entry - SURE, fresh))
        self.last2, self.last1 = self.last1, ids


FULL, LOW = U(1 << 56), U(1 << 40)
WORD, MASK, STEP = U(16), U((1 << 40) - 1), U(32)


def encode_blocks(blocks: list[np.ndarray], bits: int) -> list[bytes]:
    """Code blocks of ids below ``1 << bits``; longest first, at most ``LANES``."""
    n, most = len(blocks), len(blocks[0])
    lengths = np.array([len(b) for b in blocks])
    ids = np.zeros((most, n), np.int32)
    for i, b in enumerate(blocks):
        ids[: len(b), i] = b
    model = Model(n, bits, inverse=False)
    shift = model.shift
    plain, rest = min(8, shift), max(0, shift - 8)
    words = np.zeros((n, most * (4 if rest else 3) + 8), np.uint32)
    flat, pos = words.reshape(-1), np.arange(n) * words.shape[1]
    low, size = np.zeros(n, U), np.full(n, FULL - U(1))
    one = U(1 << ODDS)

    def settle() -> None:
        nonlocal low, size
        small = np.flatnonzero(size < LOW)
        while len(small):
            flat[pos[small]] = low[small] >> U(40)
            pos[small] += 1
            low[small] = (low[small] & MASK) << WORD
            size[small] <<= WORD
            small = small[size[small] < LOW]

    ends: list = [None] * n
    width = n
    for t in range(most):
        live = int(np.searchsorted(-lengths, -t))  # blocks longer than t
        if live < width:
            for i in range(live, width):
                ends[i] = (low[i], pos[i])
            model.narrow(live)
            low, size, pos, width = low[:live].copy(), size[:live].copy(), pos[:live].copy(), live
        if renewals(t):
            model.renew(t)
        x = ids[t, :live]
        f2, f1 = model.predict()
        hit2 = model.id2 == x
        hit1 = (model.id1 == x) > hit2
        top = x >> shift
        at = model.base_t + top
        start0 = model.starts[at]
        freq0 = model.starts[at + 1] - start0
        raw = ((x >> rest) & ((1 << plain) - 1)).astype(U)
        base = f2 + f1
        miss = one - base
        scale = U(ODDS + plain)
        start = (base << scale) + miss * ((start0 << U(plain)) + raw * freq0)
        freq = miss * freq0
        start = np.where(hit2, U(0), np.where(hit1, f2 << scale, start))
        freq = np.where(hit2, f2 << scale, np.where(hit1, f1 << scale, freq))
        part = size >> (scale + U(ODDS))
        low = low + start * part
        size = freq * part
        settle()
        if rest:
            missed = ~(hit2 | hit1)
            part = np.where(missed, size >> U(rest), size)
            low = low + np.where(missed, (x & ((1 << rest) - 1)).astype(U) * part, U(0))
            size = part
            settle()
        model.update(x, hit2, hit1, top)
    for i in range(width):
        ends[i] = (low[i], pos[i])
    out = []
    for i, (last, at) in enumerate(ends):
        last = int(last)
        digits = flat[i * words.shape[1] : int(at) + 4]
        digits[-4:] = [last >> 40, last >> 24 & 0xFFFF, last >> 8 & 0xFFFF, (last & 0xFF) << 8]
        out.append(carried(digits))
    return out


def carried(digits: np.ndarray) -> bytes:
    """16-bit digits with their carries carried on, as bytes."""
    digits = digits.copy()
    while True:
        over = np.flatnonzero(digits >> 16)
        if not len(over):
            return digits.astype(">u2").tobytes()
        carry = digits[over] >> 16
        digits[over] &= 0xFFFF
        digits[over - 1] += carry


def decode_blocks(codes: list[bytes], lengths: np.ndarray, bits: int) -> list[np.ndarray]:
    """The ids of coded blocks; longest first."""
    n, most = len(codes), int(lengths[0])
    width = max(len(c) // 2 for c in codes) + 8
    words = np.zeros((n, width), U)
    for i, c in enumerate(codes):
        words[i, : len(c) // 2] = np.frombuffer(c, ">u2")
    flat, pos = words.reshape(-1), np.arange(n) * width
    # 56 bits: three words and the upper half of a fourth, whose lower half waits.
    code = (flat[pos] << U(40)) | (flat[pos + 1] << U(24)) | (flat[pos + 2] << U(8)) | (flat[pos + 3] >> U(8))
    half = flat[pos + 3] & U(0xFF)
    pos = pos + 4
    size = np.full(n, FULL - U(1))
    model = Model(n, bits, inverse=True)
    shift = model.shift
    plain, rest = min(8, shift), max(0, shift - 8)
    ids = np.zeros((most, n), np.int32)
    one, scale = U(1 << ODDS), U(ODDS + plain)
    most_at = U((1 << (int(scale) + ODDS)) - 1)

    def settle() -> None:
        nonlocal code, size
        small = np.flatnonzero(size < LOW)
        while len(small):
            word = flat[pos[small]]
            code[small] = (code[small] << WORD) | (half[small] << U(8)) | (word >> U(8))
            half[small] = word & U(0xFF)
            pos[small] += 1
            size[small] <<= WORD
            small = small[size[small] < LOW]

    before = n
    for t in range(most):
        live = int(np.searchsorted(-lengths, -t))
        if live < before:
            model.narrow(live)
            code, half, size, pos = code[:live].copy(), half[:live].copy(), size[:live].copy(), pos[:live].copy()
            before = live
        if renewals(t):
            model.renew(t)
        f2, f1 = model.predict()
        base = f2 + f1
        miss = one - base
        part = size >> (scale + U(ODDS))
        at = np.minimum(code // part, most_at)
        choice = at >> scale
        hit2 = choice < f2
        hit1 = (choice < base) > hit2
        hit = hit2 | hit1
        # Where a prediction holds, the rest is worked out on a harmless value.
        u = np.where(hit, U(0), at - (base << scale)) // miss
        top = model.symbol[model.base_i + (u >> U(plain)).astype(np.int64)].astype(np.int32)
        place = model.base_t + top
        start0 = model.starts[place]
        freq0 = model.starts[place + 1] - start0
        raw = (u - (start0 << U(plain))) // freq0
        start = (base << scale) + miss * ((start0 << U(plain)) + raw * freq0)
        start = np.where(hit2, U(0), np.where(hit1, f2 << scale, start))
        freq = np.where(hit2, f2 << scale, np.where(hit1, f1 << scale, miss * freq0))
        code = code - start * part
        size = freq * part
        settle()
        x = (top << shift) | (raw.astype(np.int32) << rest)
        if rest:
            part = np.where(hit, size, size >> U(rest))
            low = np.where(hit, U(0), np.minimum(code // part, U((1 << rest) - 1)))
            code = code - low * part
            size = part
            settle()
            x |= low.astype(np.int32)
        x = np.where(hit2, model.id2, np.where(hit1, model.id1, x))
        model.update(x, hit2, hit1, x >> shift)
        ids[t, :live] = x
    return [ids[:k, i].astype("<u4") for i, k in enumerate(lengths.tolist())]


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
