"""Progressive JPEG columns: a decoder in numpy, and a lossless store of byte payloads as coefficients.

The decoder reads any 8-bit Huffman-coded progressive file: spectral-selection and successive-
approximation scans accumulate in coefficient arrays, which are inverse-transformed, chroma is
upsampled, and the result is a full-resolution RGB tensor. It works on many files at once: each
restart interval is a lane, and all lanes decode their next symbol in one step of numpy.

A payload is stored losslessly in the format's unit, the quantised coefficient: byte b is the
coefficient 256 + b, in zigzag order. The offset makes every coefficient significant in its first
scan (bits 8 to 4), so the refinement scans (bits 3 to 0) hold correction bits alone.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

R = 8  # blocks, or units of several blocks, in a restart interval that is written
SHIFT, OFFSET, TOP = 4, 256, 4095  # bits left to refinement scans; added to a byte; most units in a row
TAG = b"payload-bytes:"


def _zigzag() -> np.ndarray:
    """Row-major place of each coefficient in zigzag order."""
    return np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))


ZIGZAG = _zigzag()
#: The cosine basis in units of 2**-13: all products and sums in 64-bit floats are then exact integers.
BASIS = np.round(np.array([[math.cos((2 * x + 1) * u * math.pi / 16) * (math.sqrt(1 / 8) if u == 0 else 0.5) for x in range(8)] for u in range(8)]) * 8192)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


# ---- writing


def _join(data: np.ndarray, lengths: np.ndarray, last: np.ndarray) -> list[bytes]:
    """Entropy-coded segments from the bytes of all intervals; last marks the final interval of a scan."""
    n_in_scan = np.diff(np.concatenate([[0], np.flatnonzero(last) + 1]))
    index = np.arange(len(lengths)) - np.repeat(np.flatnonzero(last) + 1 - n_in_scan, n_in_scan)
    ends = np.cumsum(lengths)
    stuffed = np.flatnonzero(data == 255)
    per = np.bincount(np.searchsorted(ends, stuffed, "right"), minlength=len(lengths))
    at = ends[~last]
    where = np.concatenate([stuffed + 1, at, at])
    what = np.concatenate([np.zeros(len(stuffed), np.uint8), np.full(len(at), 255, np.uint8), (0xD0 + index[~last] % 8).astype(np.uint8)])
    rank = np.concatenate([np.zeros(len(stuffed), np.int8), np.ones(len(at), np.int8), np.full(len(at), 2, np.int8)])
    by = np.lexsort((rank, where))
    flat = np.insert(data, where[by], what[by]).tobytes()
    stops = np.cumsum(lengths + per + 2 * ~last)[last].tolist()
    return [flat[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]


def _rows(bits: np.ndarray, used: np.ndarray, last: np.ndarray) -> list[bytes]:
    """As _join, from one row of bits for each interval, of which the first used ones count."""
    bits[np.arange(bits.shape[1]) >= used[:, None]] = 1
    packed = np.packbits(bits, axis=1)
    n = (used + 7) // 8
    return _join(packed[np.arange(packed.shape[1]) < n[:, None]], n, last)


def _lanes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For runs of so many units: the units of each interval, whether it is a run's last, and each unit's row."""
    per = -(-counts // R)
    last = np.zeros(int(per.sum()), bool)
    last[np.cumsum(per) - 1] = True
    size = np.full(len(last), R)
    size[last] = counts - (per - 1) * R
    start = np.repeat((np.cumsum(per) - per) * R, counts)
    within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return size, last, start + within


#: EOB-run symbols of up to 8 blocks in code words that take 4 bits with their extra bits.
EOB_BITS = np.array([0, 14, 12, 13, 8, 9, 10, 11, 0])
HEAD = (
    segment(0xDB, bytes([0]) + bytes([1]) * 64)
    + segment(0xC4, bytes([0x00, 0, 0, 6, *[0] * 13, 0, 1, 2, 3, 4, 5]))  # differences of 0 to 5 bits: 3 bits each
    + segment(0xC4, bytes([0x10, 1, *[0] * 15, 0x05]))  # a coefficient of 5 bits after no zeros: 1 bit
    + segment(0xC4, bytes([0x11, 1, 1, 1, 1, *[0] * 12, 0x30, 0x20, 0x10, 0x00]))
    + segment(0xDD, struct.pack(">H", R))
)


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A progressive 4:2:0 file for each payload, whose length is a positive multiple of 64."""
    if not payloads:
        return []
    shapes = []
    for p in payloads:
        units = -(-len(p) // 384)
        high = -(-units // TOP)
        shapes.append((-(-units // high), high))
    units = np.array([w * h for w, h in shapes])
    blocks = np.zeros((int(units.sum()) * 6, 64), np.uint8)
    at = 0
    for p, n in zip(payloads, units.tolist(), strict=True):
        blocks[at : at + len(p) // 64] = np.frombuffer(p, np.uint8).reshape(-1, 64)
        at += 6 * n
    planes = (units[:, None] * [4, 1, 1]).ravel()  # blocks of Y, Cb, Cr
    size, last, row = _lanes(planes)
    lanes = np.zeros((len(size) * R, 64), np.uint8)
    lanes[row] = blocks
    lanes = lanes.reshape(-1, R, 64)
    scans: dict[tuple, list[bytes]] = {}
    for a, b in ((1, 5), (6, 63)):  # code word 0, then bits 8 to 4 of which the first is 1
        bits = np.zeros((len(size), R, b - a + 1, 6), np.uint8)
        bits[..., 1] = 1
        for k in range(4):
            bits[..., 2 + k] = lanes[:, :, a : b + 1] >> (7 - k) & 1
        scans[a, b, 0, SHIFT] = _rows(bits.reshape(len(size), -1), size * 6 * (b - a + 1), last)
    head = (EOB_BITS[size][:, None] >> np.arange(3, -1, -1) & 1).astype(np.uint8)
    for low in range(SHIFT - 1, -1, -1):
        bits = np.concatenate([head, (lanes[:, :, 1:] >> low & 1).reshape(len(size), -1)], axis=1)
        scans[1, 63, low + 1, low] = _rows(bits, 4 + 63 * size, last)
    # the first coefficients, interleaved: four of Y, one of Cb, one of Cr in each unit
    order, base = [], 0
    for w, h in shapes:
        order.append(base + _unit_order(w, h).ravel())
        base += 6 * w * h
    first = blocks[np.concatenate(order), 0].astype(np.int64).reshape(-1, 6) + OFFSET
    size, last, row = _lanes(units)
    grid = np.zeros((len(size) * R, 6), np.int64)
    grid[row] = first
    grid = grid.reshape(-1, R, 6)
    there = np.arange(R) < size[:, None]
    high = grid >> SHIFT
    diff = high.copy()
    diff[:, :, 1:4] -= high[:, :, 0:3]
    diff[:, 1:, 0] -= high[:, :-1, 3]
    diff[:, 1:, 4:] -= high[:, :-1, 4:]
    category = np.frexp(np.abs(diff).astype(np.float64))[1]
    code = (category << category) | np.where(diff < 0, diff + (1 << category) - 1, diff)
    width = np.where(there[:, :, None], 3 + category, 0).reshape(len(size), -1)
    bits = np.zeros((len(size), R * 6 * 8), np.uint8)
    until = np.cumsum(width, axis=1)
    n = width.ravel()
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    bits[np.repeat(np.repeat(np.arange(len(size)), R * 6), n), np.repeat((until - width).ravel(), n) + step] = np.repeat(code.ravel(), n) >> (np.repeat(n, n) - 1 - step) & 1
    scans[0, 0, 0, SHIFT] = _rows(bits, until[:, -1], last)
    for low in range(SHIFT - 1, -1, -1):
        scans[0, 0, low + 1, low] = _rows((grid >> low & 1).astype(np.uint8).reshape(len(size), -1), size * 6, last)
    out = []
    for i, (p, (w, h)) in enumerate(zip(payloads, shapes, strict=True)):
        parts = [b"\xff\xd8", segment(0xFE, TAG + str(len(p)).encode()), HEAD]
        parts.append(segment(0xC2, struct.pack(">BHHB", 8, 16 * h, 16 * w, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
        for (a, b, ah, al), data in scans.items():
            table = 1 if ah and a else 0
            if a == 0:
                parts += [segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, a, b, ah << 4 | al])), data[i]]
            else:
                for c in range(3):
                    parts += [segment(0xDA, bytes([1, c + 1, table, a, b, ah << 4 | al])), data[3 * i + c]]
        out.append(b"".join([*parts, b"\xff\xd9"]))
    return out


def _unit_order(w: int, h: int) -> np.ndarray:
    """Blocks of Y, Cb, Cr planes (one after the other, row by row) in the order of 4:2:0 units."""
    r, c = np.divmod(np.arange(w * h), w)
    y = [(2 * r + a) * 2 * w + 2 * c + b for a in (0, 1) for b in (0, 1)]
    return np.stack([*y, 4 * w * h + r * w + c, 5 * w * h + r * w + c], axis=1)


# ---- reading

MARK = re.compile(rb"\xff+([^\x00\xd0-\xd7\xff])", re.S)
_luts: dict[bytes, np.ndarray] = {}


def _lut(table: bytes) -> np.ndarray:
    """Length << 8 | symbol of the code word at the start of each 16 bits; 0 where there is none."""
    if table not in _luts:
        out, code, k = np.zeros(65536, np.int32), 0, 16
        for length in range(1, 17):
            for _ in range(table[length - 1]):
                a = code << (16 - length)
                out[a : a + (1 << (16 - length))] = length << 8 | table[k]
                code, k = code + 1, k + 1
            code <<= 1
        if len(_luts) > 256:
            _luts.clear()
        _luts[table] = out
    return _luts[table]


class Image:
    """Headers and scans of one file."""

    def __init__(self, data: bytes) -> None:
        self.comments, self.quant, self.scans = [], {}, []
        tables: dict[int, bytes] = {}
        interval, at = 0, 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG file")
        while True:
            m = MARK.search(data, at)
            if not m:
                raise ValueError("the file ends without an end marker")
            kind, at = m[1][0], m.end()
            if kind == 0xD9:
                break
            if kind == 0x01 or kind == 0xD8:
                continue
            n = int.from_bytes(data[at : at + 2], "big")
            body, at = data[at + 2 : at + n], at + n
            if kind == 0xC2:
                self._frame(body)
            elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a Huffman-coded progressive file")
            elif kind == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    tables[body[0]], body = body[1:n], body[n:]
            elif kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    n = 65 + 64 * wide
                    self.quant[body[0] & 15], body = np.frombuffer(body[1:n], ">u2" if wide else "u1").astype(np.float64), body[n:]
            elif kind == 0xDD:
                interval = int.from_bytes(body[:2], "big")
            elif kind == 0xFE:
                self.comments.append(body)
            elif kind == 0xDA:
                n = body[0]
                parts = [(self.ids[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(n)]
                a, b, ahl = body[1 + 2 * n : 4 + 2 * n]
                end = MARK.search(data, at)
                stop = end.start() if end else len(data)
                need = [None if a == 0 and ahl >> 4 else tables[t >> 4] if a == 0 else tables[0x10 | t & 15] for _, t in parts]
                self.scans.append((tuple(c for c, _ in parts), a, b, ahl >> 4, ahl & 15, tuple(need), interval, data[at:stop]))
                at = stop

    def _frame(self, body: bytes) -> None:
        depth, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if depth != 8 or n not in (1, 3):
            raise ValueError("only 8-bit files of one or three components are read")
        self.sampling, self.ids, self.tq = [], {}, []
        for i in range(n):
            c, hv, q = body[6 + 3 * i : 9 + 3 * i]
            self.ids[c] = i
            self.sampling.append((hv >> 4, hv & 15) if n == 3 else (1, 1))
            self.tq.append(q)
        self.hmax, self.vmax = max(h for h, _ in self.sampling), max(v for _, v in self.sampling)
        self.across, self.down = -(-self.width // (8 * self.hmax)), -(-self.height // (8 * self.vmax))
        self.padded = [(self.across * h, self.down * v) for h, v in self.sampling]
        self.base = np.cumsum([0, *(w * h for w, h in self.padded)])

    def order(self, comps: tuple[int, ...]) -> tuple[np.ndarray, tuple[int, ...]]:
        """Blocks in the order of a scan over comps, counted from the image's first, and the component of each block of a unit."""
        if len(comps) == 1:
            (h, v), w = self.sampling[comps[0]], self.padded[comps[0]][0]
            wide, high = -(--(-self.width * h // self.hmax) // 8), -(--(-self.height * v // self.vmax) // 8)
            return (self.base[comps[0]] + np.arange(high)[:, None] * w + np.arange(wide)).ravel(), comps
        r, c = np.divmod(np.arange(self.across * self.down), self.across)
        parts = [(i, self.base[i] + (r * v + y) * self.padded[i][0] + c * h + x) for i in comps for h, v in (self.sampling[i],) for y in range(v) for x in range(h)]
        return np.stack([p for _, p in parts], axis=1).ravel(), tuple(i for i, _ in parts)


class _Bits:
    """The intervals of many scans, without stuffing and markers."""

    def __init__(self, parts: list[bytes]) -> None:
        a = np.frombuffer(b"".join(x for p in parts for x in (p, b"\xff\xd0")), np.uint8)
        ff = np.flatnonzero(a[:-1] == 255)
        after = a[ff + 1]
        rst = ff[(after >= 0xD0) & (after <= 0xD7)]
        keep = np.ones(len(a), bool)
        keep[ff[after == 0] + 1] = False
        keep[rst] = keep[rst + 1] = False
        kept = np.cumsum(keep)
        self.starts = np.concatenate([[0], kept[rst[:-1] + 1]]) * 8
        self.data = np.concatenate([a[keep], np.full(8, 255, np.uint8)])
        d = self.data.astype(np.uint32)
        self.words = d[:-3] << 24 | d[1:-2] << 16 | d[2:-1] << 8 | d[3:]

    def peek(self, at: np.ndarray) -> np.ndarray:
        """25 bits or more from each place on, at the top of 32."""
        return self.words[at >> 3] << (at & 7).astype(np.uint32)

    def take(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.peek(at).astype(np.int64)) >> (32 - n)


def _symbol(bits: _Bits, at: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    entry = lut[bits.peek(at) >> np.uint32(16)]
    if not entry.all():
        raise ValueError("a code word that is in no table")
    return at + (entry >> 8), entry & 255


def _extend(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(v < (1 << n >> 1), v - (1 << n) + 1, v)


def _dc_first(bits: _Bits, coef: np.ndarray, order: np.ndarray, begin: np.ndarray, size: np.ndarray, unit: tuple, tables: dict, low: int) -> None:
    at, before = bits.starts.copy(), np.zeros((max(unit) + 1, len(begin)), np.int64)
    lane = np.arange(len(begin))
    for j in range(int(size.max(initial=0))):
        lane = lane[size[lane] > j]
        c = unit[j % len(unit)]
        p, n = _symbol(bits, at[lane], _lut(tables[c]))
        diff = _extend(bits.take(p, n), n)
        at[lane] = p + n
        before[c, lane] += diff
        coef[order[begin[lane] + j], 0] = before[c, lane] << low


def _dc_refine(bits: _Bits, coef: np.ndarray, order: np.ndarray, begin: np.ndarray, size: np.ndarray, low: int) -> None:
    at = np.repeat(bits.starts - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    where = order[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
    coef[where, 0] |= (bits.data[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(coef.dtype) << low


def _ac_first(bits: _Bits, coef: np.ndarray, order: np.ndarray, begin: np.ndarray, size: np.ndarray, a: int, b: int, low: int, lut: np.ndarray) -> None:
    flat, at, block, end, k = coef.reshape(-1), bits.starts.copy(), begin.copy(), begin + size, np.full(len(begin), a)
    while len(at):
        at, symbol = _symbol(bits, at, lut)
        n, run = symbol & 15, symbol >> 4
        if n.all():
            k += run
            flat[order[block] * 64 + k] = _extend(bits.take(at, n), n) << low
            at += n
            k += 1
        else:
            value = n > 0
            k += np.where(value | (run == 15), run, 0)
            i = np.flatnonzero(value)
            flat[order[block[i]] * 64 + k[i]] = _extend(bits.take(at[i], n[i]), n[i]) << low
            at += n
            k += value | (run == 15)
            eob = ~value & (run < 15)
            i = np.flatnonzero(eob)
            extra = bits.take(at[i], run[i])
            at[i] += run[i]
            block[i] += (1 << run[i]) + extra - 1
            k[i] = b + 1
        full = k > b
        if full.any():
            k[full] = a
            block += full
            if (block >= end).any():
                on = block < end
                at, block, end, k = at[on], block[on], end[on], k[on]


def _ac_refine(bits: _Bits, coef: np.ndarray, order: np.ndarray, begin: np.ndarray, size: np.ndarray, a: int, b: int, low: int, lut: np.ndarray) -> None:
    one = np.unpackbits(bits.data)
    band = b - a + 1
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([one, np.zeros(64, np.uint8)]), band)
    at, block, end = bits.starts.copy(), begin.copy(), begin + size
    while len(at):
        p, symbol = _symbol(bits, at, lut)
        run = symbol >> 4
        ends = ((symbol & 15) == 0) & (run < 15)
        for i in np.flatnonzero(~ends):  # new coefficients: one lane after the other
            _refine_lane(one, coef, order[block[i] : end[i]], int(at[i]), a, b, low, lut)
        p, run, block, end = p[ends], run[ends], block[ends], end[ends]
        if not len(p):
            return
        many = np.minimum((1 << run) + bits.take(p, run), end - block)
        p = p + run
        total = int(many.sum())
        where = order[np.repeat(block - np.cumsum(many) + many, many) + np.arange(total)]
        was = coef[where, a : b + 1]
        there = was != 0
        of = np.repeat(np.arange(len(many)), many)
        if there.all():
            first = np.repeat(p, many) + band * (np.arange(total) - np.repeat(np.cumsum(many) - many, many))
            got = windows[first].astype(coef.dtype) << low
            counts = many * band
        else:
            per = there.sum(1)
            counts = np.bincount(of, per, len(many)).astype(np.int64)
            ahead = np.cumsum(per) - per
            lead = ahead - np.repeat(ahead[np.cumsum(many) - many], many)
            rank = np.cumsum(there, axis=1) - 1
            got = np.where(there, one[(np.repeat(p, many) + lead)[:, None] + np.maximum(rank, 0)], 0).astype(coef.dtype) << low
        coef[where, a : b + 1] = was + np.where(was < 0, -got, got)
        at, block = p + counts, block + many
        on = block < end
        at, block, end = at[on], block[on], end[on]


def _refine_lane(one: np.ndarray, coef: np.ndarray, blocks: np.ndarray, at: int, a: int, b: int, low: int, lut: np.ndarray) -> None:
    """The rest of one interval of a refinement scan, symbol by symbol."""
    run, bit = 0, 1 << low

    def number(n: int) -> int:
        nonlocal at
        at += n
        return int("".join(map(str, one[at - n : at])) or "0", 2)

    def correct(row: np.ndarray, k: int) -> None:
        if number(1):
            row[k] += bit if row[k] > 0 else -bit

    for block in blocks.tolist():
        row, k = coef[block], a
        while k <= b and not run:
            word = one[at : at + 16]
            entry = int(lut[int("".join(map(str, word)).ljust(16, "1"), 2)])
            at += entry >> 8
            zeros, n = (entry & 255) >> 4, entry & 15
            if n == 0 and zeros < 15:
                run = (1 << zeros) + number(zeros)
                break
            value = (bit if number(1) else -bit) if n else 0
            while k <= b:
                if row[k]:
                    correct(row, k)
                elif zeros == 0:
                    row[k] = value
                    k += 1
                    break
                else:
                    zeros -= 1
                k += 1
        if run:
            for j in range(k, b + 1):
                if row[j]:
                    correct(row, j)
            run -= 1


def decode_coefficients(images: list[Image]) -> list[np.ndarray]:
    """Coefficients of each image: a row of 64 in zigzag order for each block, component after component."""
    base = np.cumsum([0, *(int(i.base[-1]) for i in images)])
    coef = np.zeros((int(base[-1]), 64), np.int16)
    waves: dict[tuple, list] = defaultdict(list)
    for image, shift in zip(images, base[:-1].tolist(), strict=True):
        turn, orders = [0] * len(image.sampling), {}
        for comps, a, b, ah, al, tables, interval, data in image.scans:
            now = 1 + max(turn[c] for c in comps)
            for c in comps:
                turn[c] = now
            if comps not in orders:
                own, unit = image.order(comps)
                orders[comps] = own + shift, unit
            own, unit = orders[comps]
            by = dict(zip(comps, tables, strict=True)) if a == 0 and not ah else {}
            key = (now, a, b, ah, al, tables[0] if a else None, unit if a == 0 else None, tuple(sorted(by.items())))
            n = len(own) if not interval else interval * (len(unit) if len(comps) > 1 else 1)
            waves[key].append((own, n, data))
    for (_, a, b, ah, al, table, unit, by), parts in sorted(waves.items(), key=lambda x: x[0][0]):
        bits = _Bits([p[2] for p in parts])
        order = np.concatenate([p[0] for p in parts])
        lengths, most = np.array([len(p[0]) for p in parts]), np.array([p[1] for p in parts])
        per = -(-lengths // most)
        if int(per.sum()) != len(bits.starts):
            raise ValueError("restart intervals are missing")
        nth = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
        begin = np.repeat(np.cumsum(lengths) - lengths, per) + nth * np.repeat(most, per)
        size = np.minimum(np.repeat(most, per), np.repeat(lengths, per) - nth * np.repeat(most, per))
        if a == 0:
            _dc_refine(bits, coef, order, begin, size, al) if ah else _dc_first(bits, coef, order, begin, size, unit, dict(by), al)
        else:
            (_ac_refine if ah else _ac_first)(bits, coef, order, begin, size, a, b, al, _lut(table))
    return [coef[x:y] for x, y in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def inverse_transform(coef: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Samples (blocks, 8, 8) of coefficients in zigzag order."""
    out = np.empty((len(coef), 8, 8), np.uint8)
    for i in range(0, len(coef), 4096):
        part = np.zeros((len(coef[i : i + 4096]), 64))
        part[:, ZIGZAG] = coef[i : i + 4096] * quant
        rows = (part.reshape(-1, 8) @ BASIS).reshape(-1, 8, 8)
        both = (rows.transpose(0, 2, 1).reshape(-1, 8) @ BASIS).reshape(-1, 8, 8).transpose(0, 2, 1)
        out[i : i + 4096] = np.clip(np.floor(both / 2.0**26 + 128.5), 0, 255)
    return out


def rgb(image: Image, samples: np.ndarray) -> np.ndarray:
    """The full-resolution tensor (height, width, 3)."""
    planes = []
    for i, (h, v) in enumerate(image.sampling):
        w, n = image.padded[i]
        plane = samples[image.base[i] : image.base[i + 1]].reshape(n, w, 8, 8).transpose(0, 2, 1, 3).reshape(8 * n, 8 * w)
        plane = plane.repeat(image.vmax // v, 0) if image.vmax != v else plane
        plane = plane.repeat(image.hmax // h, 1) if image.hmax != h else plane
        planes.append(plane[: image.height, : image.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, 2)
    y, cb, cr = planes[0].astype(np.int32) << 16, planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
    half = 1 << 15
    out = np.empty((image.height, image.width, 3), np.uint8)
    out[:, :, 0] = np.clip(y + 91881 * cr + half >> 16, 0, 255)  # 1.402, 0.344136, 0.714136, 1.772 in units of 2**-16
    out[:, :, 1] = np.clip(y - 22554 * cb - 46802 * cr + half >> 16, 0, 255)
    out[:, :, 2] = np.clip(y + 116130 * cb + half >> 16, 0, 255)
    return out


def payload(image: Image, coef: np.ndarray) -> bytes | None:
    """What encode_payloads stored, if the file holds a payload."""
    n = next((int(c[len(TAG) :]) for c in image.comments if c.startswith(TAG)), None)
    return None if n is None else (coef.reshape(-1)[:n] - OFFSET).astype(np.uint8).tobytes()


def decode(files: list[bytes]) -> Iterator[tuple[np.ndarray, bytes | None]]:
    """The RGB tensor of each file, and the payload that it stores, if any."""
    images = [Image(f) for f in files]
    for image, coef in zip(images, decode_coefficients(images), strict=True):
        quant = np.concatenate([np.broadcast_to(image.quant[q], (int(n), 64)) for q, n in zip(image.tq, np.diff(image.base), strict=True)]) if len({*image.tq}) > 1 else image.quant[image.tq[0]]
        yield rgb(image, inverse_transform(coef, quant)), payload(image, coef)


# ---- columns


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes (null: none), padded by bytes 0 to a positive multiple of 64, as a file.

    docs: doc_id, text; other columns are not read. Equal texts give equal files. Nothing is dropped;
    an empty table gives no rows.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, most_bytes=2 << 20):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            files = encode_payloads([r + bytes(max(64, -(-len(r) // 64) * 64) - len(r)) for r in raw])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return common.bounded(docs.select("doc_id", "text")).mapInArrow(store, "doc_id long, n_bytes long, media binary")


def read_tensors(files: DataFrame) -> DataFrame:
    """height, width and rgb (row-major 8-bit samples) of each media file of (doc_id, media); null for a null file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "media", 2 << 20):
            media = batch.column(1).to_pylist()
            found = decode([m for m in media if m is not None])
            rows = [None if m is None else next(found)[0] for m in media]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([None if t is None else t.shape[i] for t in rows], pa.int32()) for i in (0, 1)), pa.array([None if t is None else t.tobytes() for t in rows], pa.binary())], ["doc_id", "height", "width", "rgb"])

    return common.bounded(files.select("doc_id", "media")).mapInArrow(read, "doc_id long, height int, width int, rgb binary")


def feature(tensor: np.ndarray) -> str:
    """Size, and the mean of each channel over the four quarters of the picture, in hundredths."""
    h, w, _ = tensor.shape
    parts = [tensor[a, b].reshape(-1, 3) for a in (slice(0, (h + 1) // 2), slice(h // 2, h)) for b in (slice(0, (w + 1) // 2), slice(w // 2, w))]
    return f"{w}x{h}:" + ",".join(str(int(s) * 100 // len(p)) for p in parts for s in p.sum(0, dtype=np.int64))


def digests(stored: DataFrame) -> DataFrame:
    """What the files of store_texts hold, read back: checksums of payload and file, a feature of the picture, and its RGB tensor (height, width, rgb: row-major 8-bit samples).

    A null file, or one that stores no payload, has nulls in their place. Repeated rows give repeated results, an empty table none.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "media", 1 << 20):
            media = batch.column(2).to_pylist()
            found, rows = decode([m for m in media if m is not None]), []
            for m in media:
                if m is None:
                    rows.append((None,) * 9)
                    continue
                tensor, data = next(found)
                own = (None,) * 3 if data is None else (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
                rows.append((*own, len(m), hashlib.sha256(m).hexdigest(), feature(tensor), tensor.shape[0], tensor.shape[1], tensor.tobytes()))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_bytes", *DIGESTS])

    return common.bounded(stored.select("doc_id", "n_bytes", "media")).mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height int, width int, rgb binary")


DIGESTS = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "height", "width", "rgb"]
