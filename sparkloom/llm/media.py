"""Media columns of progressive JPEG images.

Payload bytes are stored losslessly as DCT coefficients, 64 to a block, in an image of three components with halved
chroma. Scans select bands of the spectrum and approximate coefficients successively; each block is a restart interval,
so that all blocks of a slice of documents are coded and decoded side by side in numpy. Decoding accumulates the scans in
coefficient arrays, transforms them back, upsamples chroma and gives full-resolution RGB tensors.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, string_buffers, written

# Fixed values of the format: the zigzag order of a block's frequencies.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
#: Scans: first and last frequency, bits already sent are above `high`, this scan sends down to bit `low`.
SCANS = ((0, 0, 0, 1), (1, 5, 0, 1), (6, 63, 0, 1), (0, 0, 1, 0), (1, 63, 1, 0))
#: Added to a byte, so that every coefficient has been met before the last bit is refined.
SHIFT = 2
#: Blocks of luma, and of each chroma component, in 16 x 16 pixels; such squares side by side at most.
LUMA, WIDEST = 4, 4095


def _direct(symbols: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """By the next 16 bits: a coefficient without a run before it, times 32, and how many bits it takes in all; 0 for others."""
    ahead, size = np.arange(1 << 16), symbols & 15
    some = (symbols >> 4 == 0) & (size > 0) & (widths > 0) & (widths + size <= 16)
    value = Bits.extend((ahead << widths & 0xFFFF) << 8, size)
    return np.where(some, value << 5 | widths + size, 0).astype(np.int32)


def _table(lengths: dict[int, int]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of code lengths by symbol: the segment's bytes, codes and lengths by symbol, symbols and lengths by the next 16 bits,
    and coefficients by them."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = bytes(sum(lengths[s] == n for s in order) for n in range(1, 17))
    codes, sizes = np.zeros(256, np.int64), np.zeros(256, np.int64)
    symbols, widths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code = last = 0
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s], sizes[s] = code, last
        symbols[code << (16 - last) : (code + 1) << (16 - last)] = s
        widths[code << (16 - last) : (code + 1) << (16 - last)] = last
        code += 1
    return counts + bytes(order), codes, sizes, symbols, widths, _direct(symbols, widths)


def bit_size(v: np.ndarray) -> np.ndarray:
    return np.where(v == 0, 0, np.frexp(np.abs(v).astype(np.float64))[1]).astype(np.int64)


def packed(values: np.ndarray, lengths: np.ndarray, block: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit strings of 1 to 56 bits, in order and given by block, as bytes; each block is filled up with ones. Also each
    block's end."""
    bits = np.bincount(block, lengths, n_blocks).astype(np.int64)
    n_bytes = (bits + 7) // 8
    stops = np.cumsum(n_bytes)
    if not len(values):
        return np.zeros(0, np.uint8), stops
    at = np.cumsum(lengths) - lengths
    at += (8 * (stops - n_bytes) - np.cumsum(bits) + bits)[block]
    word, inside = at >> 6, (at & 63).astype(np.uint64)
    left = values.astype(np.uint64) << (64 - lengths).astype(np.uint64)
    begins = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])  # each word has a begin: gaps are short
    out = np.zeros(len(begins) + 1, np.uint64)
    out[:-1] = np.bitwise_or.reduceat(left >> inside, begins)
    last = np.append(begins[1:], len(at)) - 1  # what of a word's last string goes into the next word
    out[1:] |= left[last] << (np.uint64(63) - inside[last]) << np.uint64(1)
    data = out.astype(">u8").view(np.uint8)[: int(stops[-1])]
    some = n_bytes > 0
    data[stops[some] - 1] |= ((1 << (8 * n_bytes - bits)[some]) - 1).astype(np.uint8)
    return data, stops


def dc_bits(coefs: np.ndarray, high: int, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each block is an interval, so its first coefficient is sent as it is."""
    v, block = coefs[:, 0] >> low, np.arange(len(coefs))
    if high:
        return v & 1, np.ones(len(v), np.int64), block
    size = bit_size(v)
    return DC[1][size] << size | np.where(v < 0, v + (1 << size) - 1, v), DC[2][size] + size, block


def ac_bits(coefs: np.ndarray, start: int, stop: int, high: int, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A band's bit strings: symbols with the magnitude or sign of a new coefficient, and corrections of known ones.

    Events are the new coefficients, every 16th zero before the last of them, and the end of a band that has something
    left; each correction follows the event that comes next.
    """
    band = coefs[:, start : stop + 1]
    width, n = band.shape[1], len(band)
    if not high and n and 0 < (band.min() >> low) and (band.max() >> low) < 256:  # every coefficient is new: no runs, no ends
        fours = np.zeros((n, -(-width // 4) * 4), np.uint8)
        fours[:, :width] = band >> low
        two = PAIRS[fours.view("<u2")]
        one, two = two[:, ::2], two[:, 1::2]
        more = two & 31
        return ((one >> 5).astype(np.uint64) << more | two >> 5).ravel(), ((one & 31) + more).astype(np.int64).ravel(), np.repeat(np.arange(n), fours.shape[1] // 4)
    size_now = np.abs(band) >> low
    known = (np.abs(band) >> high > 0) if high else np.zeros(band.shape, bool)
    new = (size_now > 0) & ~known
    block, k = np.nonzero(new)
    last = np.full(n, -1)
    last[block] = k
    zero = ~new & ~known
    zeros = np.cumsum(zero, axis=1)
    since = np.zeros(len(block), np.int64)  # zeros up to the previous new one of the block
    same = np.zeros(len(block), bool)
    same[1:] = block[1:] == block[:-1]
    since[same] = zeros[block[:-1], k[:-1]][same[1:]]
    run = zeros[block, k] - since
    skips = run // 16
    which = np.repeat(np.arange(len(block)), skips)
    skip_number = np.arange(len(which)) - np.repeat(np.cumsum(skips) - skips, skips)
    target = since[which] + 16 * (skip_number + 1)
    skip_at = np.argmax(zeros[block[which]] >= target[:, None], axis=1) if len(which) else np.zeros(0, np.int64)
    open_end = np.flatnonzero(last < width - 1)
    m = np.sign(band[block, k]) * size_now[block, k]
    size = bit_size(m)
    symbol = (run % 16) << 4 | size
    extra = np.where(m > 0, m, m + (1 << size) - 1)
    e_block = np.concatenate([block, block[which], open_end])
    e_at = np.concatenate([k, skip_at, np.full(len(open_end), width)])
    e_symbol = np.concatenate([symbol, np.full(len(which), 0xF0), np.zeros(len(open_end), np.int64)])
    e_size = np.concatenate([size, np.zeros(len(which) + len(open_end), np.int64)])
    e_extra = np.concatenate([extra, np.zeros(len(which) + len(open_end), np.int64)])
    order = np.argsort(e_block * (width + 1) + e_at, kind="stable")
    e_block, e_at, e_symbol, e_size, e_extra = (x[order] for x in (e_block, e_at, e_symbol, e_size, e_extra))
    value, length = AC[1][e_symbol] << e_size | e_extra, AC[2][e_symbol] + e_size
    if not high:
        return value, length, e_block
    h_block, h_at = np.nonzero(known)
    owner = np.searchsorted(e_block * (width + 1) + e_at, h_block * (width + 1) + h_at)
    before = np.searchsorted(owner, np.arange(len(e_block)))  # corrections of earlier events
    total = len(e_block) + len(h_block)
    out = [np.zeros(total, np.int64) for _ in range(3)]
    for place, values in ((np.arange(len(e_block)) + before, (value, length, e_block)), (np.arange(len(h_block)) + owner + 1, (size_now[h_block, h_at] & 1, np.ones(len(h_block), np.int64), h_block))):
        for o, v in zip(out, values, strict=True):
            o[place] = v
    return tuple(out)


def packed_scan(coefs: np.ndarray, start: int, stop: int, high: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    """A scan's bytes, block by block. Where a refinement knows all coefficients it is an end symbol and a bit for each."""
    if not start:
        return packed(*dc_bits(coefs, high, low), len(coefs))
    if high and len(coefs) and (np.abs(coefs[:, start : stop + 1]).min() >> high) > 0:
        width, code = stop - start + 1, int(AC[2][0])
        bits = np.ones((len(coefs), -(-(code + width) // 8) * 8), np.uint8)
        bits[:, :code] = [int(AC[1][0]) >> (code - 1 - i) & 1 for i in range(code)]
        bits[:, code : code + width] = np.abs(coefs[:, start : stop + 1]) >> low & 1
        data = np.packbits(bits, axis=1)
        return data.ravel(), np.arange(1, len(coefs) + 1) * data.shape[1]
    return packed(*ac_bits(coefs, start, stop, high, low), len(coefs))


def stuffed(data: np.ndarray, stops: np.ndarray, restart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """With a zero after each 255, and after each block its restart marker (restart: 0 to 7, or -1 for none)."""
    full = np.flatnonzero(data == 255)
    marks = restart >= 0
    before = np.cumsum(marks) - marks
    ends = stops + np.searchsorted(full, stops) + 2 * (before + marks)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    kept = np.ones(len(out), bool)
    kept[full + np.arange(1, len(full) + 1) + 2 * before[np.searchsorted(stops, full, "right")]] = False
    place = ends[marks]
    kept[place - 2] = kept[place - 1] = False
    out[kept] = data
    out[place - 2] = 255
    out[place - 1] = 0xD0 + restart[marks]
    return out, ends


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def encode_images(payloads: list[bytes]) -> list[bytes]:
    """Each payload, of a positive multiple of 64 bytes, as a progressive JPEG image."""
    squares = [-(-len(p) // 64 // 6) for p in payloads]
    across = [min(s, WIDEST) for s in squares]
    down = [-(-s // a) for s, a in zip(squares, across, strict=True)]
    blocks = np.array([6 * a * d for a, d in zip(across, down, strict=True)])
    begins = np.cumsum(blocks) - blocks
    coefs = np.zeros((int(blocks.sum()), 64), np.int16)
    flat = coefs.reshape(-1)
    for p, b in zip(payloads, begins, strict=True):
        flat[b * 64 : b * 64 + len(p)] = np.frombuffer(p, np.uint8)
    flat += SHIFT
    # parts: the components of each image, luma first
    parts = np.stack([begins, begins + blocks * 4 // 6, begins + blocks * 5 // 6], axis=1)
    ends = np.append(parts.ravel()[1:], len(coefs)).reshape(parts.shape)
    sizes = (ends - parts).ravel()
    inner = np.arange(len(coefs)) - np.repeat(parts.ravel(), sizes)
    restart = np.where(inner == np.repeat(sizes, sizes) - 1, -1, inner % 8)
    coded = []
    for start, stop, high, low in SCANS:
        data, upto = stuffed(*packed_scan(coefs, start, stop, high, low), restart)
        coded.append((data.tobytes(), np.append(0, upto)))
    tables = _segment(0xDB, bytes(1) + bytes([1] * 64)), _segment(0xC4, b"\x00" + DC[0]) + _segment(0xC4, b"\x10" + AC[0]) + _segment(0xDD, struct.pack(">H", 1))
    heads = [[_segment(0xDA, bytes([1, c + 1, 0, start, stop, high << 4 | low])) for c in range(3)] for start, stop, high, low in SCANS]
    out = []
    for i, p in enumerate(payloads):
        frame = struct.pack(">BHHB", 8, 16 * down[i], 16 * across[i], 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
        pieces = [b"\xff\xd8", _segment(0xFE, struct.pack(">Q", len(p))), tables[0], _segment(0xC2, frame), tables[1]]
        for (data, upto), head in zip(coded, heads, strict=True):
            for c in range(3):
                pieces += [head[c], data[upto[parts[i, c]] : upto[ends[i, c]]]]
        out.append(b"".join([*pieces, b"\xff\xd9"]))
    return out


class Image:
    """What an image's segments say, with the places of its scans' data in the slice's bytes."""

    def __init__(self, raw: bytes, base: int, markers: list[int]):
        self.scans, self.payload, self.restart = [], 0, 0
        tables: dict[int, tuple] = {}
        at = 2
        while raw[at + 1] != 0xD9:
            marker, size = raw[at + 1], raw[at + 2] << 8 | raw[at + 3]
            body = raw[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDA:
                n, part, which, start, stop, level = body[:6]
                if n != 1:
                    raise ValueError("scans of several components are not supported")
                end = markers[bisect_left(markers, base + at)] - base
                table = tables.get(0x10 | which & 15 if start else which >> 4)
                self.scans.append((numbers[part], start, stop, level >> 4, level & 15, table, base + at, base + end))
                at = end
            elif marker == 0xFE:
                self.payload = struct.unpack(">Q", body)[0]
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xC2:
                self.height, self.width = struct.unpack_from(">HH", body, 1)
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(body[5])]
                numbers = {p[0]: i for i, p in enumerate(self.parts)}
            elif marker == 0xC4:
                tables[body[0]] = _known(body[1:])
            elif marker == 0xDB:
                self.quant = body[1:65]
        most = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        across, down = -(-self.width // (8 * most[0])), -(-self.height // (8 * most[1]))
        self.grid = [(across * p[1], down * p[2]) for p in self.parts]
        self.blocks = [a * d for a, d in self.grid]


_TABLES: dict[bytes, tuple] = {}


def _known(body: bytes) -> tuple:
    if body not in _TABLES:
        counts, lengths, at = body[:16], {}, 16
        for n, c in enumerate(counts, 1):
            lengths |= dict.fromkeys(body[at : at + c], n)
            at += c
        _TABLES[body] = _table(lengths)
        if _TABLES[body][0] != body:  # its symbols of one length aren't in ascending order
            code, last = 0, 0
            out = [body, *(np.zeros(n, np.int64) for n in (256, 256, 1 << 16, 1 << 16))]
            for s in body[16:]:
                code, last = code << (lengths[s] - last), lengths[s]
                out[3][code << (16 - last) : (code + 1) << (16 - last)] = s
                out[4][code << (16 - last) : (code + 1) << (16 - last)] = last
                code += 1
            _TABLES[body] = (*out, _direct(*out[3:]))
    return _TABLES[body]


class Bits:
    """Bits of the data without stuffing, read at many places at once."""

    def __init__(self, data: np.ndarray):
        self.data = np.append(data, np.zeros(16 + -len(data) % 4, np.uint8))
        self.words = np.empty(len(self.data) - 4, np.int64)  # 32 bits from each byte on
        for i in range(4):
            self.words[i::4] = self.data[i : len(self.data) - 4 + i].view(">u4")

    def peek(self, at: np.ndarray) -> np.ndarray:
        """The next 24 bits."""
        return (self.words[at >> 3] << (at & 7) & 0xFFFFFFFF) >> 8

    def one(self, at: np.ndarray) -> np.ndarray:
        return self.words[at >> 3] >> (31 - (at & 7)) & 1

    def symbols(self, table: tuple, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol, place after it, and the bits that follow (24 less the symbol's own) with their number."""
        ahead = self.peek(at)
        symbol, width = table[3][ahead >> 8], table[4][ahead >> 8]
        if (width == 0).any():
            raise ValueError("a code without a symbol")
        return symbol, at + width, ahead << width & 0xFFFFFF

    @staticmethod
    def extend(ahead: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The signed number of `size` bits at the head of 24."""
        v = ahead >> (24 - size)
        return np.where(size == 0, 0, np.where(v >> np.maximum(size - 1, 0), v, v - (1 << size) + 1))


DC = _table(dict.fromkeys(range(12), 4))
AC = _table({s: 4 if s == 0 or s >> 4 == 0 and s <= 8 else 6 if s >> 4 == 1 and s & 15 <= 4 else 9 for s in [*(r << 4 | n for r in range(16) for n in range(1, 11)), *(r << 4 for r in range(16))]})
_TABLES |= {DC[0]: DC, AC[0]: AC}


def _pairs() -> np.ndarray:
    """By two positive coefficients below 256, the first in the low byte: their bit string, times 32, and its length; a
    zero stands for none."""
    v = np.arange(256)
    size = bit_size(v)
    code, length = np.where(v > 0, AC[1][size] << size | v, 0), np.where(v > 0, AC[2][size] + size, 0)
    return ((code[None, :] << length[:, None] | code[:, None]) << 5 | length[:, None] + length[None, :]).ravel().astype(np.uint32)


PAIRS = _pairs()


def scan_dc(bits: Bits, at: np.ndarray, block: np.ndarray, left: np.ndarray, coefs: np.ndarray, high: int, low: int, table: tuple) -> None:
    """Lanes are restart intervals: `left` blocks from `block`, with bits from `at`."""
    last = np.zeros(len(at), np.int64)
    while len(at):
        if high:
            coefs[block, 0] |= bits.one(at) << low
            at = at + 1
        else:
            size, at, ahead = bits.symbols(table, at)
            last = last + Bits.extend(ahead, size)
            coefs[block, 0] = last << low
            at = at + size
        on = left > 1
        at, block, left, last = at[on], block[on] + 1, left[on] - 1, last[on]


def scan_ac(bits: Bits, at: np.ndarray, block: np.ndarray, left: np.ndarray, coefs: np.ndarray, start: int, stop: int, low: int, table: tuple) -> None:
    k = start
    if (left == 1).all():  # as long as no run and no end comes, all lanes are at the same coefficient
        found = np.empty((stop - start + 1, len(at)), coefs.dtype)
        for row in found:
            now = table[5][bits.words[at >> 3] >> 16 - (at & 7) & 0xFFFF]
            length = now & 31
            if not length.all():
                break
            row[:] = now >> 5
            at = at + length
            k += 1
        coefs[block, start:k] = found[: k - start].T << low
        if k > stop:
            return
    k = np.full(len(at), k)
    flat = coefs.reshape(-1)
    while len(at):
        symbol, at, ahead = bits.symbols(table, at)
        run, size = symbol >> 4, symbol & 15
        some = size > 0
        if some.all():
            k = k + run
            flat[block * 64 + k] = Bits.extend(ahead, size) << low
            at, k = at + size, k + 1
            done = (k > stop).astype(np.int64)
        else:
            k = k + np.where(some, run, 0)
            flat[block[some] * 64 + k[some]] = Bits.extend(ahead[some], size[some]) << low
            skip = ~some & (run == 15)
            k = k + some + 16 * skip
            end = ~some & ~skip
            extra = np.where(end, (1 << run) + (ahead >> (24 - run)), 0)
            at = at + size + np.where(end, run, 0)
            done = np.where(end, extra, k > stop)
        k = np.where(done > 0, start, k)
        block, left = block + done, left - done
        on = left > 0
        if not on.all():
            at, block, left, k = at[on], block[on], left[on], k[on]


def scan_refine(bits: Bits, at: np.ndarray, block: np.ndarray, left: np.ndarray, coefs: np.ndarray, start: int, stop: int, low: int, table: tuple) -> None:
    flat = coefs.reshape(-1)
    width = stop - start + 1
    n = len(at)
    k, run, new, ends = np.full(n, start), np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
    while len(at):
        need = np.flatnonzero((run < 0) & (ends == 0))
        if len(need):
            symbol, after, ahead = bits.symbols(table, at[need])
            r, s = symbol >> 4, symbol & 15
            end = (s == 0) & (r < 15)
            ends[need] = np.where(end, (1 << r) + (ahead >> (24 - r)), 0)
            run[need] = np.where(end, -1, r)
            new[need] = np.where(s == 0, 0, np.where(ahead >> 23, 1, -1) << low)
            at[need] = after + np.where(end, r, s > 0)
        whole = np.flatnonzero((ends > 0) & (k == start))
        if len(whole):  # corrections alone: read a block's together where all its coefficients are known
            some = coefs[block[whole], start : stop + 1]
            known = (some != 0).all(axis=1)
            if not known.all():
                whole, some = whole[known], some[known]
        if len(whole):
            fix = np.unpackbits(bits.data[(at[whole] >> 3)[:, None] + np.arange((width + 14) // 8)], axis=1)
            inside = at[whole] & 7
            fix = fix[:, inside[0] : inside[0] + width] if (inside == inside[0]).all() else np.take_along_axis(fix, inside[:, None] + np.arange(width), 1)
            coefs[block[whole], start : stop + 1] = some + np.sign(some) * (fix.astype(coefs.dtype) << low)
            at[whole] += width
            k[whole] = stop + 1
        rest = np.flatnonzero(k <= stop)
        if len(rest):
            spot = block[rest] * 64 + k[rest]
            now = flat[spot]
            known = now != 0
            fix = np.where(known, bits.one(at[rest]), 0)
            now = now + np.sign(now) * (fix << low)
            at[rest] += known
            free = ~known & (ends[rest] == 0)
            hit = free & (run[rest] == 0)
            flat[spot] = np.where(hit, new[rest], now)
            run[rest] -= free
            k[rest] += 1
        done = k > stop
        if done.any():
            ends[done] = np.maximum(ends[done] - 1, 0)
            run[done] = np.where(ends[done] > 0, -1, run[done])
            k[done], block[done], left[done] = start, block[done] + 1, left[done] - 1
            on = left > 0
            if not on.all():
                at, block, left, k, run, new, ends = (x[on] for x in (at, block, left, k, run, new, ends))


def decode_coefficients(images: list[bytes]) -> tuple[list[Image], np.ndarray, np.ndarray]:
    """The images' headers, all coefficients in zigzag order, and where each image's blocks begin (one more at the end)."""
    joined = b"".join(images)
    data = np.frombuffer(joined, np.uint8)
    bases = np.cumsum([0, *map(len, images)])
    full = np.flatnonzero(data[:-1] == 255)
    following = data[full + 1]
    real = full[(following != 0) & ((following < 0xD0) | (following > 0xD7)) & (following != 255)].tolist()
    marks = full[(following >= 0xD0) & (following <= 0xD7)]
    zeros = full[following == 0] + 1
    bits = Bits(np.frombuffer(joined.replace(b"\xff\x00", b"\xff"), np.uint8))
    found = [Image(raw, b, real) for raw, b in zip(images, bases.tolist(), strict=False)]
    begins = np.cumsum([0, *(sum(x.blocks) for x in found)])
    coefs = np.zeros((int(begins[-1]), 64), np.int16)  # as wide as coefficients of 8-bit and 12-bit images get
    groups: dict[tuple, list] = {}  # the first scans of all components, the second ones, and so on, by what they hold
    for image, begin in zip(found, begins.tolist(), strict=False):
        firsts = [begin + sum(image.blocks[:i]) for i in range(len(image.blocks))]
        turns = [0] * len(firsts)
        for part, start, stop, high, low, table, a, _ in image.scans:
            groups.setdefault((turns[part], start, stop, high, low, id(table)), []).append((firsts[part], image.blocks[part], image.restart or image.blocks[part], a, table))
            turns[part] += 1
    for (_, start, stop, high, low, _), scans in sorted(groups.items(), key=lambda g: g[0][0]):
        first, count, every, a = (np.array(x) for x in list(zip(*scans, strict=True))[:4])
        lanes = -(-count // every)
        which = np.repeat(np.arange(len(scans)), lanes)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        later = inner > 0
        at = a[which]
        at[later] = marks[(np.searchsorted(marks, a)[which] + inner - 1)[later]] + 2
        done = inner * every[which]
        block, left = first[which] + done, np.minimum(every[which], count[which] - done)
        args = (bits, (at - np.searchsorted(zeros, at)) * 8, block, left, coefs)
        if stop == 0:
            scan_dc(*args, high, low, scans[0][4])
        elif high:
            scan_refine(*args, start, stop, low, scans[0][4])
        else:
            scan_ac(*args, start, stop, low, scans[0][4])
    return found, coefs, begins


#: The inverse transform of a block in zigzag order as a matrix, in whole 2 ** -12ths so that sums are exact.
_WAVE = np.array([[np.sqrt((1 if u else 0.5) / 4) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
INVERSE = np.rint(np.einsum("ux,vy->uvxy", _WAVE, _WAVE).reshape(64, 64)[ZIGZAG] * 4096)
#: What a chroma sample adds to its pixels: to red, by cr, and to blue, by cb.
RED, BLUE = ((factor * (np.arange(256) - 128) + 32768 >> 16).astype(np.int16) for factor in (91881, 116130))


def samples_of(coefs: np.ndarray) -> np.ndarray:
    """Blocks of samples. Single precision where all sums of 2 ** -12ths stay below its 24 bits, which it holds exactly."""
    most = max(int(coefs.max(initial=0)), -int(coefs.min(initial=0))) * np.abs(INVERSE).sum(axis=0).max() + (1 << 20)
    inverse = (INVERSE / 4096).astype(np.float32 if most < 1 << 24 else np.float64)
    samples = np.empty(coefs.shape, np.uint8)
    for begin in range(0, len(coefs), 2048):
        wave = coefs[begin : begin + 2048].astype(inverse.dtype) @ inverse
        wave += 128.5
        samples[begin : begin + 2048] = np.clip(wave, 0, 255, out=wave)
    return samples


def halved_chroma(image: Image) -> bool:
    return [p[1:] for p in image.parts] == [(2, 2), (1, 1), (1, 1)]


def rgb_squares(images: list[Image], begins: np.ndarray, samples: np.ndarray) -> np.ndarray:
    """Of images with halved chroma, given where their blocks begin: all squares of 16 x 16 pixels, row by row."""
    across, down = np.array([x.grid[1] for x in images], np.int64).reshape(-1, 2).T
    count = across * down
    which = np.repeat(np.arange(len(images)), count)
    number = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    cb = (begins + 4 * count)[which] + number
    cr = cb + count[which]
    out = np.empty((len(which), 8, 2, 8, 2, 3), np.uint8)
    for some in (slice(i, i + 512) for i in range(0, len(which), 512)):
        wide = across[which[some]]
        row, column = np.divmod(number[some], wide)
        first = begins[which[some]] + 4 * row * wide + 2 * column
        y = samples[first[:, None, None] + np.array([0, 1]) + 2 * wide[:, None, None] * np.array([[0], [1]])]
        y = y.reshape(-1, 2, 2, 8, 8).swapaxes(2, 3).reshape(-1, 8, 2, 8, 2).astype(np.int16)
        blue, red = samples[cb[some]], samples[cr[some]]
        green = 22554 * (blue.astype(np.int32) - 128) + 46802 * (red.astype(np.int32) - 128) - 32768 >> 16
        for c, add in enumerate((RED[red], -green.astype(np.int16), BLUE[blue])):
            pixels = y + add.reshape(-1, 8, 1, 8, 1)
            out[some, ..., c] = np.clip(pixels, 0, 255, out=pixels)
    return out.reshape(-1, 16, 16, 3)


def rgb_of(image: Image, samples: np.ndarray) -> np.ndarray:
    """The image's tensor (height, width, 3) from its blocks of samples: planes, chroma repeated, colours converted."""
    planes, at = [], 0
    most = max(p[1] for p in image.parts), max(p[2] for p in image.parts)
    for (across, down), n, (_, h, v) in zip(image.grid, image.blocks, image.parts, strict=True):
        plane = samples[at : at + n].reshape(down, across, 8, 8).swapaxes(1, 2).reshape(8 * down, 8 * across)
        planes.append(plane.repeat(most[1] // v, axis=0).repeat(most[0] // h, axis=1)[: image.height, : image.width].astype(np.int32))
        at += n
    if len(planes) == 1:
        return np.repeat(planes[0].astype(np.uint8)[:, :, None], 3, axis=2)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.stack([y + (91881 * cr + 32768 >> 16), y - (22554 * cb + 46802 * cr - 32768 >> 16), y + (116130 * cb + 32768 >> 16)], axis=2)
    return np.clip(rgb, 0, 255).astype(np.uint8)


def decode_images(images: list[bytes]) -> Iterator[tuple[bytes, np.ndarray]]:
    """The payload and the RGB tensor of each image."""
    found, coefs, begins = decode_coefficients(images)
    stored = (coefs - SHIFT).astype(np.uint8).tobytes()
    if any(x.quant != bytes([1] * 64) for x in found):
        coefs = coefs.astype(np.int32)
        for image, a, b in zip(found, begins[:-1], begins[1:], strict=True):
            coefs[a:b] *= np.frombuffer(image.quant, np.uint8)
    samples = samples_of(coefs)
    usual = [halved_chroma(x) for x in found]
    squares = rgb_squares([x for x, u in zip(found, usual, strict=True) if u], begins[:-1][usual], samples)
    at = 0
    for image, u, a, b in zip(found, usual, begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if u:
            across, down = image.grid[1]
            rgb = squares[at : at + across * down].reshape(down, across, 16, 16, 3).swapaxes(1, 2).reshape(16 * down, 16 * across, 3)[: image.height, : image.width]
            at += across * down
        else:
            rgb = rgb_of(image, samples[a:b])
        yield stored[a * 64 : a * 64 + image.payload], rgb


#: How a table of images is packed: codes of whole bits leave little to other codecs.
PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9"}


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def channel_sums(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sums of squares of a tensor's channels, by pieces whose sums fit into 32 bits."""
    pixels, total, square = rgb.reshape(-1, 3), np.zeros(3, np.int64), np.zeros(3, np.int64)
    for begin in range(0, len(pixels), 1 << 15):
        some = np.ascontiguousarray(pixels[begin : begin + (1 << 15)].T).astype(np.uint32)
        total += some.sum(axis=1, dtype=np.int64)
        square += np.einsum("ij,ij->i", some, some)
    return total, square


def with_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """`docs` with the binary column `media`: the text's UTF-8 bytes, filled up with zeros to a positive multiple of 64,
    as a progressive JPEG image. Null texts count as empty; equal texts give equal images."""
    schema = docs.drop(media).withColumn(media, F.lit(None).cast("binary")).schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, text, 1 << 20)):
            data, offs = string_buffers(batch.column(text))
            images = encode_images([padded(data[a:b].tobytes()) for a, b in zip(offs[:-1], offs[1:], strict=True)])
            kept = [n for n in batch.schema.names if n != media]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(images, pa.binary())], names=[*kept, media])

    return docs.mapInArrow(rows, schema)


def decoded_media(docs: DataFrame, media: str = "media", tensors: bool = True) -> DataFrame:
    """`docs` with payload, and of the image's full-resolution RGB tensor: height, width, feature (means and deviations
    of its channels), and rgb, its bytes row by row, if asked for. A null image gives nulls; columns of `docs` with these
    names are replaced."""
    extra = {"payload": "binary", "height": "int", "width": "int", "feature": "string"} | ({"rgb": "binary"} if tensors else {})
    out = docs.drop(*extra)
    kept = out.columns
    for name, kind in extra.items():
        out = out.withColumn(name, F.lit(None).cast(kind))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b, media, 2 << 20)):
            images = batch.column(media).to_pylist()
            found = iter(decode_images([x for x in images if x is not None]))
            columns: dict[str, list] = {n: [] for n in extra}
            for x in images:
                if x is None:
                    for c in columns.values():
                        c.append(None)
                    continue
                payload, rgb = next(found)
                n = rgb.shape[0] * rgb.shape[1]
                total, square = channel_sums(rgb)
                values = [f"{int(t) / n:.3f}/{np.sqrt(int(n * int(q) - int(t) ** 2)) / n:.3f}" for t, q in zip(total, square, strict=True)]
                for name, value in zip(columns, (payload, rgb.shape[0], rgb.shape[1], ",".join(values), rgb.tobytes() if tensors else None), strict=False):
                    columns[name].append(value)
            arrays = [pa.array(c, {"binary": pa.binary(), "int": pa.int32(), "string": pa.string()}[extra[name]]) for name, c in columns.items()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *arrays], names=[*kept, *extra])

    return docs.mapInArrow(rows, out.schema)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and height, width, rgb_bytes and rgb_sha256 of each image's full-resolution RGB tensor.

    The images are written as a table and read back before they are decoded. Null texts count as empty, an empty one is
    one block of zeros; equal rows are independent; an empty table gives an empty one.
    """
    docs = documents(spark, sf_dir, "doc_id", "text").withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    stored = written(with_media(docs).drop("text"), spark, **PACKED)
    back = decoded_media(stored)
    return back.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -64, 64)")).cast("long").alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
        "height", "width", F.octet_length("rgb").cast("long").alias("rgb_bytes"), F.sha2("rgb", 256).alias("rgb_sha256"),
    )

