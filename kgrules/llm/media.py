"""Progressive JPEG columns: bytes stored as DCT coefficients, decoded scan by scan to coefficient arrays and RGB tensors.

Storing. The format's unit is the quantised coefficient. A payload byte b becomes the coefficient b - 130 (b <= 128) or b - 127,
which is never 0 after a shift by one bit; 384 bytes fill one unit of a 4:2:0 image (four luma blocks, one of each chroma),
in zigzag order. The scans are: DC first pass; for each component two spectral bands, first pass; DC refinement; for each
component AC refinement. Every block of an AC scan and every unit of a DC scan is a restart interval. A comment segment
holds the payload's length. Units beyond the payload hold spaces.

Reading. The decoder takes any 8-bit progressive Huffman file of up to four components, with or without restarts, with runs of
blocks ended at once, zero runs and refinements that place new coefficients. It decodes all restart intervals of all files of
a batch in lock step: one numpy operation moves every interval on by one symbol. Scans accumulate in coefficient arrays;
the inverse transform is done in integers (so equal files give equal pixels in any batch), chroma is upsampled by
repetition, and the full-resolution RGB tensor has the shape (height, width, 3).

Cases: a null or empty text has 0 bytes and a payload of 192 spaces. Rows are independent of their ids, so null and repeated
ids give a row each. Long texts only make larger images. Other columns are ignored. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT, MCU, MOST_WIDE, BATCH = 192, 384, 4095, 600_000
#: A file beyond this is not read back: height and width are 16-bit numbers.
LAYOUT = ((1, 2, 2, 4), (2, 1, 1, 1), (3, 1, 1, 1))  # id, horizontal and vertical sampling, blocks in a unit
BANDS = ((1, 5), (6, 63))


@lru_cache(1)
def zigzag() -> np.ndarray:
    """Natural position of each zigzag index."""
    at = sorted(((r + c, (r if (r + c) % 2 else c), r, c) for r in range(8) for c in range(8)))
    return np.array([r * 8 + c for _, _, r, c in at])


# -- Huffman codes ---------------------------------------------------------------------------------------------------


def table_spec(kind: int) -> tuple[list[int], list[int]]:
    """(codes of each length 1..16, symbols): sizes 1 to 7 without a zero run get 3 bits, all other symbols 11 (DC: 4)."""
    if kind == 0:
        return [0, 0, 0, 12] + [0] * 12, list(range(12))
    short = list(range(1, 8))
    rest = [s for s in range(256) if s not in short and ((s & 15) <= 10)]
    return [0, 0, 7] + [0] * 7 + [len(rest)] + [0] * 5, short + rest


def codes(counts: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Canonical (code, length) by symbol; length 0: none."""
    code, k = 0, 0
    out, size = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for n, c in enumerate(counts, 1):
        for _ in range(c):
            out[symbols[k]], size[symbols[k]] = code, n
            code, k = code + 1, k + 1
        code <<= 1
    return out, size


@lru_cache(64)
def lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 bits ahead, symbol * 32 + length; 0 where no code begins so."""
    code, size = codes(list(counts), list(symbols))
    out = np.zeros(1 << 16, np.int32)
    for s in symbols:
        lo = int(code[s]) << (16 - int(size[s]))
        out[lo : lo + (1 << (16 - int(size[s])))] = s * 32 + int(size[s])
    return out


# -- encoding --------------------------------------------------------------------------------------------------------


@lru_cache(1)
def _categories() -> np.ndarray:
    return np.array([n.bit_length() for n in range(2048)], np.int32)


def _items(v: np.ndarray, code: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, bits) of each number: the code of its size, then its sign and magnitude."""
    size = _categories()[np.abs(v)]
    low = v + (v >> 31) & (1 << size) - 1
    return (code.astype(np.int32)[size] << size) | low, length.astype(np.int32)[size] + size


def _pack(value: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bytes of each row): the rows' bit strings of at most 13 bits an item, each row filled up with ones."""
    for _ in range(2):  # four items to a word
        if value.shape[1] % 2:
            value, bits = (np.concatenate([x, np.zeros((len(x), 1), x.dtype)], axis=1) for x in (value, bits))
        value = (value[:, 0::2].astype(np.int64) << bits[:, 1::2]) | value[:, 1::2]
        bits = bits[:, 0::2] + bits[:, 1::2]
    end = np.cumsum(bits, axis=1, dtype=np.int64)
    total = end[:, -1]
    sizes = (total + 7) >> 3
    base = np.cumsum(sizes) - sizes
    at = (base[:, None] << 3) + end - bits
    across = (int(bits.max()) + 14) >> 3
    out = np.zeros(int(sizes.sum()) + across)
    word = (value << (8 * across - bits - (at & 7))).ravel()
    at = (at >> 3).ravel()
    for k in range(across):
        out += np.bincount(at + k, weights=(word >> (8 * (across - 1 - k))) & 255, minlength=len(out))[: len(out)]
    out = out[:-across].astype(np.uint8)
    out[base + sizes - 1] |= ((1 << ((sizes << 3) - total)) - 1).astype(np.uint8)
    return out, sizes


def _stuffed(data: np.ndarray, sizes: np.ndarray, lanes: np.ndarray) -> list[bytes]:
    """Each file's entropy-coded data: FF bytes stuffed, restart markers between its lanes."""
    full = data == 0xFF
    starts = np.cumsum(sizes) - sizes
    last = np.cumsum(lanes) - 1
    first = last - lanes + 1
    marked = np.full(len(sizes), 2)
    marked[last] = 0
    grown = sizes + np.add.reduceat(full, starts).astype(np.int64) + marked
    lane_at = np.cumsum(grown) - grown
    before = np.cumsum(full) - full
    lane = np.repeat(np.arange(len(sizes)), sizes)
    at = lane_at[lane] + (np.arange(len(data)) - starts[lane]) + before - before[starts][lane]
    out = np.zeros(int(grown.sum()), np.uint8)
    out[at] = data
    m = np.flatnonzero(marked)
    end = lane_at[m] + grown[m]
    out[end - 2], out[end - 1] = 0xFF, 0xD0 + ((m - np.repeat(first, lanes)[m]) & 7)
    whole, cuts = out.tobytes(), np.append(lane_at[first], len(out)).tolist()
    return [whole[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode(payloads: list[bytes]) -> list[bytes]:
    """One progressive JPEG for each payload, whose length is a positive multiple of 192."""
    units = [-(-len(p) // MCU) for p in payloads]
    wide = [min(u, MOST_WIDE) for u in units]
    high = [-(-u // w) for u, w in zip(units, wide, strict=True)]
    full = np.array([w * h for w, h in zip(wide, high, strict=True)])
    flat = np.frombuffer(b"".join(p.ljust(n * MCU) for p, n in zip(payloads, full.tolist(), strict=True)), np.uint8)
    v = flat.astype(np.int32)
    v = np.where(v <= 128, v - 130, v - 127).reshape(-1, 6, 64)
    (dc_code, dc_size), (ac_code, ac_size) = codes(*table_spec(0)), codes(*table_spec(1))
    order = [_block_order(w, h) for w, h in zip(wide, high, strict=True)]
    base = np.cumsum(full) - full
    luma = v[:, :4].reshape(-1, 64)[np.concatenate([o + b * 4 for o, b in zip(order, base.tolist(), strict=True)])]
    by_component = [luma, v[:, 4], v[:, 5]]
    dc = v[:, :, 0] >> 1
    diff = dc.copy()
    diff[:, 1:4] -= dc[:, 0:3]
    scans = [(b"\x03\x01\x00\x02\x00\x03\x00\x00\x00\x01", 1, _pack(*_items(diff, dc_code, dc_size)))]
    for i, c in enumerate(by_component):
        for lo, hi in BANDS:
            x = c[:, lo : hi + 1]
            x = np.sign(x) * (np.abs(x) >> 1)
            scans.append((bytes([1, i + 1, 0, lo, hi, 0x01]), LAYOUT[i][3], _pack(*_items(x, ac_code, ac_size))))
    raw = lambda x: (lambda p: (p.ravel(), np.full(len(p), p.shape[1])))(np.packbits(np.concatenate([x, np.ones((len(x), -x.shape[1] % 8), x.dtype)], axis=1), axis=1))
    scans.append((b"\x03\x01\x00\x02\x00\x03\x00\x00\x00\x10", 1, raw((v[:, :, 0] & 1).astype(np.uint8))))
    ended = np.array([int(b) for b in f"{ac_code[0]:0{ac_size[0]}b}"], np.uint8)
    for i, c in enumerate(by_component):
        bits = (np.abs(c[:, 1:]) & 1).astype(np.uint8)
        scans.append((bytes([1, i + 1, 0, 1, 63, 0x10]), LAYOUT[i][3], raw(np.concatenate([np.broadcast_to(ended, (len(bits), len(ended))), bits], axis=1))))
    parts = [_stuffed(data, np.asarray(sizes), full * per) for _, per, (data, sizes) in scans]
    heads = [_segment(0xDA, head) for head, _, _ in scans]
    (c0, s0), (c1, s1) = table_spec(0), table_spec(1)
    tables = _segment(0xDB, b"\x00" + b"\x01" * 64) + _segment(0xC4, bytes([0, *c0, *s0])) + _segment(0xC4, bytes([0x10, *c1, *s1])) + _segment(0xDD, b"\x00\x01")
    out = []
    for k, p in enumerate(payloads):
        size = struct.pack(">BHHB", 8, high[k] * 16, wide[k] * 16, 3) + b"".join(bytes([i, h << 4 | w, 0]) for i, h, w, _ in LAYOUT)
        out.append(b"\xff\xd8" + _segment(0xFE, str(len(p)).encode()) + tables + _segment(0xC2, size) + b"".join(h + part[k] for h, part in zip(heads, parts, strict=True)) + b"\xff\xd9")
    return out


@lru_cache(4096)
def _block_order(wide: int, high: int) -> np.ndarray:
    """Luma blocks, numbered by unit and place in it, in the raster order of the component."""
    u = np.arange(wide * high * 4).reshape(high, wide, 2, 2)
    return u.transpose(0, 2, 1, 3).ravel()


# -- decoding --------------------------------------------------------------------------------------------------------


@dataclass
class Scan:
    head: bytes
    tables: dict[tuple[int, int], tuple[bytes, bytes]]
    restart: int
    data: bytes


@dataclass
class File:
    height: int = 0
    width: int = 0
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    comment: bytes = b""

    @property
    def units(self) -> tuple[int, int]:
        h, v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    @property
    def key(self) -> tuple:
        return (tuple(self.parts), tuple((s.head, s.restart, tuple(sorted(s.tables.items()))) for s in self.scans))


_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.DOTALL)


def parse(data: bytes) -> File:
    """The segments of a file. Raises ValueError on what the decoder doesn't take."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    out, at, restart, tables = File(), 2, 0, {}
    while at < len(data):
        marker = data[at + 1]
        if data[at] != 0xFF:
            raise ValueError("marker expected")
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            return out
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            out.comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                out.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[1 + n :]
        elif marker == 0xC4:
            tables = dict(tables)
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC2:
            precision, out.height, out.width, n = struct.unpack(">BHHB", body[:6])
            if precision != 8 or not out.height or not out.width:
                raise ValueError("only 8-bit files with known dimensions")
            out.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError("not a progressive Huffman file")
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xDA:
            end = _END.search(data, at)
            stop = end.start() if end else len(data)
            out.scans.append(Scan(body, tables, restart, data[at:stop]))
            at = stop
    return out


class Lanes:
    """Restart intervals of many scans of one structure, read in lock step."""

    def __init__(self, scans: list[bytes]):
        size = np.array([len(s) for s in scans])
        kind = np.int32 if size.sum() < 1 << 27 else np.int64
        raw = np.frombuffer(b"".join(scans) + b"\x01", np.uint8)
        ff = raw[:-1] == 0xFF
        after = raw[1:]
        mark = ff & (after >= 0xD0) & (after <= 0xD7)
        drop = mark.copy()
        drop[1:] |= mark[:-1] | (ff[:-1] & (raw[1:-1] == 0))
        kept = raw[:-1][~drop].astype(np.int32)
        place = np.concatenate([[0], np.cumsum(~drop)])
        file_at = np.cumsum(size) - size
        cut = np.flatnonzero(mark)
        start = np.concatenate([file_at, cut + 2])
        order = np.argsort(start, kind="stable")
        self.file = np.concatenate([np.arange(len(scans)), np.searchsorted(file_at, cut, side="right") - 1])[order]
        self.bit = (place[start[order]] << 3).astype(kind)
        pad = np.concatenate([kept, np.full(8, 255, np.int32)])
        self.ahead = pad[:-2] << 16 | pad[1:-1] << 8 | pad[2:]
        self.last = (len(self.ahead) - 1) << 3

    def peek(self, at: np.ndarray) -> np.ndarray:
        """The 16 bits from each position."""
        at = np.minimum(at, self.last)
        return (self.ahead[at >> 3] >> (8 - (at & 7))) & 0xFFFF

    def symbols(self, lanes: np.ndarray, table: np.ndarray) -> np.ndarray:
        at = self.bit[lanes]
        found = table[self.peek(at)]
        if not found.all():
            raise ValueError("invalid Huffman code")
        self.bit[lanes] = at + (found & 31)
        return found >> 5

    def bits(self, lanes: np.ndarray, n: np.ndarray) -> np.ndarray:
        at = self.bit[lanes]
        self.bit[lanes] = at + n
        return self.peek(at) >> (16 - n)


def _extend(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    top = np.int32(1) << n
    return v - np.where(v * 2 < top, top - 1, 0)


def _coefficients(files: list[File]) -> list[np.ndarray]:
    """For each component the coefficients of all files' blocks in zigzag order, file after file in raster order."""
    parts = files[0].parts
    units = np.array([f.units for f in files])
    counts = [units[:, 0] * h * units[:, 1] * v for _, h, v, _ in parts]
    bases = [np.cumsum(c) - c for c in counts]
    coef = [np.zeros((int(c.sum()), 64), np.int32) for c in counts]
    hmax, vmax = max(p[1] for p in parts), max(p[2] for p in parts)
    for k, scan in enumerate(files[0].scans):
        n = scan.head[0]
        chosen = [(next(i for i, p in enumerate(parts) if p[0] == scan.head[1 + 2 * j]), scan.head[2 + 2 * j]) for j in range(n)]
        lo, hi, high, low = scan.head[1 + 2 * n], scan.head[2 + 2 * n], scan.head[3 + 2 * n] >> 4, scan.head[3 + 2 * n] & 15
        lanes = Lanes([f.scans[k].data for f in files])
        index = np.arange(len(lanes.file))
        nth = index - np.searchsorted(lanes.file, lanes.file)
        if n == 1:
            c, _ = chosen[0]
            wide = np.array([-(-(-(-f.width * parts[c][1] // hmax)) // 8) for f in files])
            tall = np.array([-(-(-(-f.height * parts[c][2] // vmax)) // 8) for f in files])
            total, stride = wide * tall, units[:, 0] * parts[c][1]
            step = scan.restart or int(total.max())
            where = lambda lane, i: [(c, (lambda b: bases[c][lanes.file[lane]] + b // wide[lanes.file[lane]] * stride[lanes.file[lane]] + b % wide[lanes.file[lane]])(nth[lane] * step + i))]  # noqa: E731, B023
        else:
            total = units[:, 0] * units[:, 1]
            step = scan.restart or int(total.max())

            def where(lane, i, chosen=chosen, lanes=lanes, nth=nth, step=step):
                f = lanes.file[lane]
                u = nth[lane] * step + i
                x, y = u % units[f, 0], u // units[f, 0]
                return [(c, bases[c][f] + (y * parts[c][2] + dy) * units[f, 0] * parts[c][1] + x * parts[c][1] + dx) for c, _ in chosen for dy in range(parts[c][2]) for dx in range(parts[c][1])]

        of = {c: [lookup(*scan.tables[kind, t >> 4 if kind == 0 else t & 15]) if (kind, t >> 4 if kind == 0 else t & 15) in scan.tables else None for kind in (0, 1)] for c, t in chosen}
        left = np.minimum(total[lanes.file] - nth * step, step)
        before = {c: np.zeros(len(index), np.int32) for c, _ in chosen}
        ending = np.zeros(len(index), np.int32)
        for i in range(int(left.max())):
            lane = index if (left > i).all() else np.flatnonzero(left > i)
            for c, block in where(lane, i):
                if lo == 0:
                    _dc(lanes, lane, coef[c], block, before[c], of[c][0], high, low)
                elif high == 0:
                    _ac_first(lanes, lane, coef[c], block, ending, of[c][1], lo, hi, low)
                else:
                    _ac_refine(lanes, lane, coef[c], block, ending, of[c][1], lo, hi, low)
    return coef


def _dc(lanes, lane, coef, block, before, table, high, low) -> None:
    if high:
        coef[block, 0] |= (lanes.bits(lane, np.int32(1)) << low).astype(np.int32)
    else:
        n = lanes.symbols(lane, table)
        before[lane] += _extend(lanes.bits(lane, n), n)
        coef[block, 0] = before[lane] << low


def _ac_first(lanes, lane, coef, block, ending, table, lo, hi, low) -> None:
    skip = ending[lane] > 0
    if skip.any():
        ending[lane[skip]] -= 1
        lane, block = lane[~skip], block[~skip]
    k = np.full(len(lane), lo)
    flat = coef.reshape(-1)
    while len(lane):
        s = lanes.symbols(lane, table)
        run, n = s >> 4, s & 15
        k += run
        if n.all():
            flat[block * 64 + np.minimum(k, 63)] = _extend(lanes.bits(lane, n), n) << low
            k += 1
            more = k <= hi
        else:
            some = n > 0
            flat[block[some] * 64 + np.minimum(k[some], 63)] = _extend(lanes.bits(lane[some], n[some]), n[some]) << low
            end = ~some & (run < 15)
            ending[lane[end]] = (1 << run[end]) - 1 + lanes.bits(lane[end], run[end])
            k += 1
            more = (k <= hi) & ~end
        if not more.all():
            lane, block, k = lane[more], block[more], k[more]


def _ac_refine(lanes, lane, coef, block, ending, table, lo, hi, low) -> None:
    one = np.int32(1 << low)
    run, value = np.full(len(lane), -1), np.zeros(len(lane), np.int32)
    over = ending[lane]
    for k in range(lo, hi + 1):
        need = (over == 0) & (run < 0)
        if need.any():
            at = np.flatnonzero(need)
            s = lanes.symbols(lane[at], table)
            r, n = s >> 4, s & 15
            new = n > 0
            sign = lanes.bits(lane[at[new]], np.int32(1))
            value[at] = 0
            value[at[new]] = np.where(sign > 0, one, -one)
            end = ~new & (r < 15)
            run[at] = np.where(end, -1, r)
            over[at[end]] = (1 << r[end]) + lanes.bits(lane[at[end]], r[end])
        c = coef[block, k]
        old = c != 0
        if old.all():
            bit = lanes.bits(lane, np.int32(1))
            coef[block, k] = c + np.where((bit > 0) & ((np.abs(c) & one) == 0), np.sign(c) * one, 0)
            continue
        if old.any():
            at = np.flatnonzero(old)
            bit = lanes.bits(lane[at], np.int32(1))
            coef[block[at], k] = c[at] + np.where((bit > 0) & ((np.abs(c[at]) & one) == 0), np.sign(c[at]) * one, 0)
        at = np.flatnonzero(~old & (over == 0))
        put = at[run[at] == 0]
        coef[block[put], k] = value[put]
        run[at] -= 1
    ending[lane] = np.maximum(over - 1, 0)


@lru_cache(1)
def _basis() -> np.ndarray:
    """8 x 8 cosines in units of 2^-11, by frequency and place."""
    u, x = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.round(np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5) * 2048).astype(np.int32)


def inverse(coef: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """(n, 8, 8) samples, 0 to 255, of coefficients in zigzag order."""
    natural = np.zeros(coef.shape)
    natural[:, zigzag()] = np.clip(coef * quant, -32768, 32767)
    # whole numbers below 2**53 in floating point: exact in any order of summation
    b = _basis().astype(np.float64)
    rows = np.floor((natural.reshape(-1, 8) @ b + 128) / 256).reshape(-1, 8, 8)
    out = (rows.transpose(0, 2, 1).reshape(-1, 8) @ b).astype(np.int64).reshape(-1, 8, 8).transpose(0, 2, 1)
    return np.clip(((out + (1 << 13)) >> 14) + 128, 0, 255).astype(np.uint8)


def _rgb(planes: list[np.ndarray]) -> np.ndarray:
    if len(planes) != 3:
        return np.repeat(planes[0][:, :, None], 3, axis=2)
    y, cb, cr = (p.astype(np.int32) for p in planes)
    cb, cr, y = cb - 128, cr - 128, (y << 16) + (1 << 15)
    return np.clip(np.stack([y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb], axis=2) >> 16, 0, 255).astype(np.uint8)


def decode(data: list[bytes]) -> list[tuple[list[np.ndarray], np.ndarray, bytes]]:
    """For each file: the components' coefficients (blocks in raster order, zigzag), the RGB tensor, the comment."""
    files = [parse(d) for d in data]
    groups: dict[tuple, list[int]] = {}
    for i, f in enumerate(files):
        groups.setdefault(f.key, []).append(i)
    out: list = [None] * len(files)
    for members in groups.values():
        group = [files[i] for i in members]
        parts = group[0].parts
        coef = _coefficients(group)
        same = all((g.quant[q] == group[0].quant[q]).all() for g in group for q in g.quant)
        pixels = [inverse(c, group[0].quant[p[3]]) for c, p in zip(coef, parts, strict=True)] if same else None
        hmax, vmax = max(p[1] for p in parts), max(p[2] for p in parts)
        at = [0] * len(parts)
        for i, f in zip(members, group, strict=True):
            ux, uy = f.units
            own, planes = [], []
            for j, (_, h, v, q) in enumerate(parts):
                n = ux * h * uy * v
                c = coef[j][at[j] : at[j] + n]
                p = pixels[j][at[j] : at[j] + n] if same else inverse(c, f.quant[q])
                p = p.reshape(uy * v, ux * h, 8, 8).transpose(0, 2, 1, 3).reshape(uy * v * 8, ux * h * 8)
                if (h, v) != (hmax, vmax):
                    p = p.repeat(vmax // v, axis=0).repeat(hmax // h, axis=1)
                planes.append(p[: f.height, : f.width])
                own.append(c)
                at[j] += n
            out[i] = (own, _rgb(planes), f.comment)
    return out


def payload(coef: list[np.ndarray], tensor: np.ndarray, comment: bytes) -> bytes:
    """The stored bytes of a file that ``encode`` made."""
    high, wide = tensor.shape[0] // 16, tensor.shape[1] // 16
    v = np.empty((wide * high, 6, 64), np.int32)
    v[:, :4].reshape(-1, 64)[:] = 0
    luma = np.empty((wide * high * 4, 64), np.int32)
    luma[_block_order(wide, high)] = coef[0]
    v[:, :4], v[:, 4], v[:, 5] = luma.reshape(-1, 4, 64), coef[1], coef[2]
    return np.where(v < 0, v + 130, v + 127).astype(np.uint8).tobytes()[: int(comment)]


def feature(tensor: np.ndarray) -> str:
    """Size, mean of each channel and mean step between neighbouring columns, in thousandths."""
    n = tensor.shape[0] * tensor.shape[1]
    means = tensor.reshape(-1, 3).sum(axis=0, dtype=np.int64) * 1000 // n
    steps = np.abs(np.diff(tensor[:, :, 1].astype(np.int16), axis=1)).sum(dtype=np.int64) * 1000 // n
    return f"{tensor.shape[1]}x{tensor.shape[0]};{','.join(map(str, means))};{steps}"


def _padded(text: str | None) -> tuple[int, bytes]:
    b = (text or "").encode("utf-8", "surrogatepass")
    return len(b), b.ljust(max(1, -(-len(b) // UNIT)) * UNIT)


def _batches(texts: list[str | None]) -> Iterator[list[tuple[int, bytes]]]:
    group, size = [], 0
    for t in texts:
        group.append(_padded(t))
        size += len(group[-1][1])
        if size >= BATCH:
            yield group
            group, size = [], 0
    if group:
        yield group


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, media binary, height, width, rgb binary): each text's file, and its full-resolution tensor read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            media, shapes, pixels = [], [], []
            for group in _batches(x.column("text").to_pylist()):
                made = encode([p for _, p in group])
                media += made
                for _, tensor, _ in decode(made):
                    shapes.append(tensor.shape)
                    pixels.append(tensor.tobytes())
            yield pa.RecordBatch.from_arrays(
                [x.column("doc_id"), pa.array(media, pa.large_binary()).cast(pa.binary()), pa.array([s[0] for s in shapes], pa.int32()), pa.array([s[1] for s in shapes], pa.int32()), pa.array(pixels, pa.binary())], ["doc_id", "media", "height", "width", "rgb"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, media binary, height int, width int, rgb binary")


def digest(docs: DataFrame) -> DataFrame:
    """The stored form and what is read back, as sizes and digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows: list[tuple] = []
            for group in _batches(x.column("text").to_pylist()):
                made = encode([p for _, p in group])
                for (n, p), m, (coef, tensor, comment) in zip(group, made, decode(made), strict=True):
                    back = payload(coef, tensor, comment)
                    if back != p:
                        raise ValueError("a payload does not come back from its file")
                    rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(tensor)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
