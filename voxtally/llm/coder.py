"""Adaptive context-mixing range coder for token ids, in whole-number arithmetic.

A block starts from nothing and can be read alone. Three orders predict the next id: order 2 and order 1 each hold one candidate per hashed
context with a confidence, order 0 holds adaptive counts of id classes. The chance that the order-2 candidate is right is a logistic mix of
what the orders have seen at their confidences, with weights that learn; then comes the order-1 candidate, then a class and the bits inside.
Blocks are coded side by side: one numpy step advances every block of a batch by one id.
"""

from __future__ import annotations

import zlib

import numpy as np

_U = np.uint64
#: Code range kept between 2^40 and 2^56; words of 16 bits.
_TOP, _CARRY = 56, _U((1 << 56) - 1)
_ONE = 4096  # probabilities are twelve bits
_NONE = 0xFFFFF  # candidate of a context not met yet
_CLASSES = 40
_REFRESH = 32
_SLOTS1, _SLOTS2 = 1 << 10, 1 << 11


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Squash and its inverse in twelve bits, from a whole-number interpolation so that every machine has the same."""
    knots = np.array([1, 2, 3, 6, 10, 16, 27, 45, 73, 120, 194, 310, 488, 747, 1101, 1546, 2047, 2549, 2994, 3348, 3607, 3785, 3901, 3975, 4022, 4050, 4068, 4079, 4085, 4089, 4092, 4093, 4094])
    d = np.arange(-2047, 2048)
    part, at = (d + 2048) & 127, (d + 2048) >> 7
    squash = (knots[at] * (128 - part) + knots[np.minimum(at + 1, 32)] * part + 64) >> 7
    stretch = np.searchsorted(squash, np.arange(_ONE), "left").clip(0, len(d) - 1) - 2047
    return squash.astype(np.int32), stretch.astype(np.int32)


_SQUASH, _STRETCH = _tables()


def classes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, how many bits are left inside it, and these bits: two classes for each bit length from the second on."""
    length = np.frexp(ids.astype(np.float32))[1] if ids.max(initial=0) < 1 << 24 else np.frexp(ids.astype(np.float64))[1]
    left = np.maximum(length - 2, 0)
    return 2 * length + ((ids >> left) & (length > 1)), left, ids & ((1 << left) - 1)


class _Model:
    """State of all blocks of a batch; ``n`` is how many are still running. Blocks come longest first."""

    def __init__(self, blocks: int):
        self.one = np.full(blocks * _SLOTS1, _NONE << 4 | 8, np.int32)
        self.two = np.full(blocks * _SLOTS2, _NONE << 4 | 8, np.int32)
        self.base1, self.base2 = np.arange(blocks) * _SLOTS1, np.arange(blocks) * _SLOTS2
        self.base16 = np.arange(blocks) * 16
        start = np.tile(np.array([1400, 2000, 2500, 2900, 3200, 3400, 3600, 3800, 40] + [40] * 7, np.int32), blocks)
        self.hit1, self.hit2, self.next1 = start.copy(), start.copy(), start.copy() // 2
        self.rate = np.full(blocks * 2, 800, np.int32)
        self.weights = np.tile(np.array([[26_000], [9_000], [4_000]], np.int32), (1, 2 * blocks))
        self.counts = np.ones((blocks, _CLASSES), np.int32)
        self.base_class = np.arange(blocks) * _CLASSES
        self.base2_bit = np.arange(blocks) * 2
        self.last = np.zeros(blocks, np.int64)
        self.before = np.zeros(blocks, np.int64)
        self.step = 0

    def predict(self, n: int) -> None:
        """Candidates c2 and c1 and the frequencies of both for the first n blocks."""
        last, before = self.last[:n], self.before[:n]
        self.at1 = self.base1[:n] + ((last * 40_503 >> 5) & (_SLOTS1 - 1))
        self.at2 = self.base2[:n] + (((last * 40_503) + (before * 30_011) >> 5) & (_SLOTS2 - 1))
        slot1, slot2 = self.one[self.at1], self.two[self.at2]
        self.c1, self.c2 = slot1 >> 4, slot2 >> 4
        self.s1, self.s2 = slot1 & 15, slot2 & 15
        self.agree = self.c1 == self.c2
        self.i1, self.i2 = self.base16[:n] + self.s1, self.base16[:n] + self.s2
        self.ib = self.base2_bit[:n] + self.agree
        self.p2, self.p1, self.p0 = self.hit2[self.i2], self.hit1[self.i1], self.rate[self.ib]
        self.x2, self.x1, self.x0 = _STRETCH[self.p2], _STRETCH[self.p1], _STRETCH[self.p0]
        w = self.weights[:, self.ib]
        mixed = (w[0] * self.x2 + w[1] * self.x1 + w[2] * self.x0) >> 15
        self.w = w
        self.pa = _SQUASH[mixed.clip(-2047, 2047) + 2047].clip(1, _ONE - 16)
        self.pb = np.where(self.agree, 0, ((_ONE - self.pa) * self.next1[self.i1] >> 12).clip(1, _ONE))
        self.pb = np.minimum(self.pb, _ONE - 8 - self.pa)
        if self.step % _REFRESH == 0:
            total = self.counts[:n].sum(axis=1, keepdims=True)
            share = 1 + self.counts[:n] * np.int64(_ONE - _CLASSES) // total
            self.cum = np.zeros((n, _CLASSES + 1), np.int64)
            np.cumsum(share, axis=1, out=self.cum[:, 1:])
            self.cum[:, -1] = _ONE
            self.flat_cum = self.cum.ravel()
            self.base_cum = np.arange(n) * (_CLASSES + 1)

    def learn(self, ids: np.ndarray, of_class: np.ndarray, n: int) -> None:
        is2, is1 = self.c2 == ids, self.c1 == ids
        error = (is2.astype(np.int32) << 12) - self.pa
        self.weights[0, self.ib] = self.w[0] + (self.x2 * error >> 10)
        self.weights[1, self.ib] = self.w[1] + (self.x1 * error >> 10)
        self.weights[2, self.ib] = self.w[2] + (self.x0 * error >> 10)
        self.hit2[self.i2] = self.p2 + (((is2.astype(np.int32) * 4095) - self.p2) >> 4)
        self.hit1[self.i1] = self.p1 + (((is1.astype(np.int32) * 4095) - self.p1) >> 4)
        self.rate[self.ib] = self.p0 + (((is2.astype(np.int32) * 4095) - self.p0) >> 5)
        b = self.next1[self.i1]
        self.next1[self.i1] = np.where(is2 | self.agree, b, b + (((is1.astype(np.int32) * 4095) - b) >> 4))
        ids32 = ids.astype(np.int32) << 4
        # a hit is more sure, a miss less; a candidate that isn't sure gives way
        self.two[self.at2] = np.where(is2, np.minimum(self.s2 + 1, 7) | ids32, np.where((self.s2 & 7) > 1, self.c2 << 4 | self.s2 >> 1, ids32))
        self.one[self.at1] = np.where(is1, np.minimum(self.s1 + 1, 7) | ids32, np.where((self.s1 & 7) > 1, self.c1 << 4 | self.s1 >> 1, ids32))
        self.counts.ravel()[self.base_class[:n] + of_class] += 24
        self.before[:n] = self.last[:n]
        self.last[:n] = ids
        self.step += 1


def _running(lengths: np.ndarray) -> np.ndarray:
    """How many blocks, longest first, have an id at each step."""
    return len(lengths) - np.searchsorted(lengths[::-1], np.arange(int(lengths[0]) if len(lengths) else 0), "right")


def encode_blocks(ids: np.ndarray, block: int) -> tuple[list[bytes], list[int]]:
    """Payload and crc32 of the ids of each block of ``block`` ids (the last may be shorter)."""
    if not len(ids):
        return [], []
    if ids.min() < 0 or ids.max() >= _NONE:
        raise ValueError(f"token ids are from 0 to {_NONE - 1}")
    many = -(-len(ids) // block)
    lengths = np.full(many, block, np.int64)
    lengths[-1] = len(ids) - block * (many - 1)
    padded = np.zeros(many * block, np.int32)
    padded[: len(ids)] = ids
    grid = np.ascontiguousarray(padded.reshape(many, block).T)
    model = _Model(many)
    room = 3 * int(lengths[0]) + 8
    out = np.zeros((many, room), np.int32)
    flat, pos = out.ravel(), np.arange(many) * room + 1
    low, rng = np.zeros(many, _U), np.full(many, 1 << _TOP, _U)
    for t, n in enumerate(_running(lengths).tolist()):
        x = grid[t, :n]
        of_class, bits, inside = classes(x)
        model.predict(n)
        is2 = model.c2 == x
        is1 = (model.c1 == x) & ~is2
        plain = ~(is2 | is1)
        pab = model.pa + model.pb
        start = np.where(is2, 0, np.where(is1, model.pa, pab)).astype(_U)
        size = np.where(is2, model.pa, np.where(is1, model.pb, _ONE - pab)).astype(_U)
        low_, rng_ = low[:n], rng[:n]
        unit = rng_ >> _U(12)
        low_ += unit * start
        rng_[:] = unit * size
        cell = model.base_cum[:n] + of_class
        c = model.flat_cum[cell]
        unit = rng_ >> _U(12)
        low_ += unit * np.where(plain, c, 0).astype(_U)
        rng_[:] = unit * np.where(plain, model.flat_cum[cell + 1] - c, _ONE).astype(_U)
        rng_ >>= np.where(plain, bits, 0).astype(_U)
        low_ += rng_ * np.where(plain, inside, 0).astype(_U)
        _emit(flat, pos[:n], low_, rng_)
        model.learn(x, of_class, n)
    for _ in range(4):  # the rest of the code
        flat[pos - 1] += (low >> _U(_TOP)).astype(np.int32)
        low &= _CARRY
        flat[pos] = (low >> _U(40)).astype(np.int32)
        low = (low << _U(16)) & _CARRY
        pos += 1
    words = _carried(out)
    ends = (pos - np.arange(many) * room).tolist()
    payloads = [words[k, 1 : ends[k]].astype("<u2").tobytes() for k in range(many)]
    raw = memoryview(ids.astype("<u4").tobytes())
    return payloads, [zlib.crc32(raw[4 * block * k : 4 * block * (k + 1)]) for k in range(many)]


def _emit(flat: np.ndarray, pos: np.ndarray, low: np.ndarray, rng: np.ndarray) -> None:
    """Write the leading words of the code until the range is above 2^40 again; three are written, as many as are due are kept."""
    flat[pos - 1] += (low >> _U(_TOP)).astype(np.int32)
    low &= _CARRY
    flat[pos] = (low >> _U(40)).astype(np.int32)
    flat[pos + 1] = ((low >> _U(24)) & _U(0xFFFF)).astype(np.int32)
    flat[pos + 2] = ((low >> _U(8)) & _U(0xFFFF)).astype(np.int32)
    due = _due(rng)
    shift = (due << 4).astype(_U)
    low[:] = (low << shift) & _CARRY
    rng <<= shift
    pos += due


def _due(rng: np.ndarray) -> np.ndarray:
    return (rng < _U(1 << 40)).astype(np.int64) + (rng < _U(1 << 24)) + (rng < _U(1 << 8))


def _carried(words: np.ndarray) -> np.ndarray:
    """Words of 16 bits after all carries have gone left."""
    while (words > 0xFFFF).any():
        over = words >> 16
        words &= 0xFFFF
        words[:, :-1] += over[:, 1:]
    return words


def decode_blocks(payloads: list[bytes], lengths: list[int], crcs: list[int]) -> np.ndarray:
    """All ids in order; a block whose ids don't fit its crc32 raises ValueError."""
    if not payloads:
        return np.zeros(0, np.int64)
    lengths = np.asarray(lengths, np.int64)
    order = np.argsort(-lengths, kind="stable")
    sizes = np.array([len(payloads[k]) // 2 + 8 for k in order])
    ends = np.cumsum(sizes)
    stream = np.zeros(int(ends[-1]), np.uint64)
    for k, end, size in zip(order.tolist(), ends.tolist(), sizes.tolist()):
        stream[end - size : end - 8] = np.frombuffer(payloads[k], "<u2")
    many, own = len(order), lengths[order]
    model = _Model(many)
    pos, last = ends - sizes, ends - 7  # only a damaged block reads on
    # three and a half words are read ahead
    x = (stream[pos] << _U(40)) | (stream[pos + 1] << _U(24)) | (stream[pos + 2] << _U(8)) | (stream[pos + 3] >> _U(8))
    rng = np.full(many, 1 << _TOP, _U)
    grid = np.zeros((int(own[0]), many), np.int32)
    for t, n in enumerate(_running(own).tolist()):
        model.predict(n)
        x_, rng_, at = x[:n], rng[:n], pos[:n]
        unit = rng_ >> _U(12)
        v = np.minimum(x_ // unit, _U(_ONE - 1)).astype(np.int32)
        pab = model.pa + model.pb
        is2, plain = v < model.pa, v >= pab
        is1 = ~(is2 | plain)
        x_ -= unit * np.where(is2, 0, np.where(is1, model.pa, pab)).astype(_U)
        rng_[:] = unit * np.where(is2, model.pa, np.where(is1, model.pb, _ONE - pab)).astype(_U)
        unit = rng_ >> _U(12)
        v = np.minimum(x_ // unit, _U(_ONE - 1)).astype(np.int64)
        of_class = (model.cum[:n, 1:] <= v[:, None]).sum(axis=1)
        cell = model.base_cum[:n] + of_class
        c = model.flat_cum[cell]
        x_ -= unit * np.where(plain, c, 0).astype(_U)
        rng_[:] = unit * np.where(plain, model.flat_cum[cell + 1] - c, _ONE).astype(_U)
        length = of_class >> 1
        bits = np.maximum(length - 2, 0)
        rng_ >>= np.where(plain, bits, 0).astype(_U)
        inside = (x_ // rng_).astype(np.int64)
        x_ -= rng_ * np.where(plain, inside, 0).astype(_U)
        high = np.where(length > 1, 2 + (of_class & 1), length) << bits
        ids = np.where(is2, model.c2, np.where(is1, model.c1, high + inside)).astype(np.int64)
        due = _due(rng_)
        shift = (due << 4).astype(_U)
        # bits that follow those already read: eight of word 3, then words 4, 5, 6
        ahead = ((stream[at + 3] & _U(0xFF)) << _U(48)) | (stream[at + 4] << _U(32)) | (stream[at + 5] << _U(16)) | stream[at + 6]
        x_[:] = (x_ << shift) | (ahead >> _U(8)) >> (_U(48) - shift)
        rng_ <<= shift
        np.minimum(at + due, last[:n], out=at)
        grid[t, :n] = ids
        of_hit = np.where(plain, of_class, np.minimum(classes(ids)[0], _CLASSES - 1))
        model.learn(ids, of_hit, n)
    starts = np.cumsum(lengths) - lengths
    out = np.empty(int(lengths.sum()), np.int64)
    for k, row in enumerate(order.tolist()):
        out[starts[row] : starts[row] + lengths[row]] = grid[: lengths[row], k]
    raw = memoryview(out.astype("<u4").tobytes())
    for start, length, crc in zip(starts.tolist(), lengths.tolist(), crcs):
        if zlib.crc32(raw[4 * start : 4 * (start + length)]) != crc:
            raise ValueError("a block of token ids doesn't fit its checksum")
    return out
