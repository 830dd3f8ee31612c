"""Baseline JPEG in NumPy; only the decoder's bit stream is read in Python.

The encoder counts its symbols first and writes Huffman tables made for them. The decoder reads baseline files with any
sampling and restart intervals; progressive ones go to Pillow.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

#: The example quantisation tables of the standard (luminance, chrominance), row by row.
LUMINANCE = np.asarray([
    [16, 11, 10, 16, 24, 40, 51, 61], [12, 12, 14, 19, 26, 58, 60, 55], [14, 13, 16, 24, 40, 57, 69, 56], [14, 17, 22, 29, 51, 87, 80, 62],
    [18, 22, 37, 56, 68, 109, 103, 77], [24, 35, 55, 64, 81, 104, 113, 92], [49, 64, 78, 87, 103, 121, 120, 101], [72, 92, 95, 98, 112, 100, 103, 99],
])
CHROMINANCE = np.full((8, 8), 99)
CHROMINANCE[:4, :4] = [[17, 18, 24, 47], [18, 21, 26, 66], [24, 26, 56, 99], [47, 66, 99, 99]]


def _zigzag() -> np.ndarray:
    """Places of an 8 x 8 block along its anti-diagonals, up and down in turn."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda rc: (sum(rc), rc[0] if sum(rc) % 2 else rc[1]))
    return np.asarray([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()
_K = np.arange(8)
DCT = np.cos(np.pi * _K[:, None] * (2 * _K[None, :] + 1) / 16) / 2
DCT[0] /= np.sqrt(2)


def tables(quality: int) -> list[np.ndarray]:
    """Quantisation for a quality of 1 to 100, by the reference software's scale."""
    q = min(100, max(1, int(quality)))
    s = 5000 // q if q < 50 else 200 - 2 * q
    return [np.clip((t * s + 50) // 100, 1, 255) for t in (LUMINANCE, CHROMINANCE)]


def _lengths(counts: dict[int, int]) -> dict[int, int]:
    """Huffman code lengths of at most 16 bits; no code is all ones."""
    heap = [(n, s, [s]) for s, n in counts.items()] + [(0, 999, [999])]  # the longest code stays unused
    heapq.heapify(heap)
    size = dict.fromkeys([*counts, 999], 0)
    if len(heap) == 1:
        return {}
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            size[s] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    while max(size.values()) > 16:  # too deep: flatten the counts
        return _lengths({s: (n + 1) // 2 + 1 for s, n in counts.items()})
    del size[999]
    return size


def _codes(size: dict[int, int]) -> tuple[list[int], list[int], dict[int, tuple[int, int]]]:
    """Counts by length, symbols in order, and each symbol's code and length."""
    symbols = sorted(size, key=lambda s: (size[s], s))
    counts = [sum(size[s] == n for s in symbols) for n in range(1, 17)]
    out, code, last = {}, 0, 0
    for s in symbols:
        code <<= size[s] - last
        last = size[s]
        out[s] = (code, last)
        code += 1
    return counts, symbols, out


def _blocks(plane: np.ndarray, q: np.ndarray) -> np.ndarray:
    """[rows, cols, 64] quantised coefficients in zigzag order."""
    h, w = plane.shape
    p = np.pad(plane, ((0, -h % 8), (0, -w % 8)), mode="edge").astype(float) - 128
    b = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).transpose(0, 2, 1, 3)
    f = DCT @ b @ DCT.T
    return np.rint(f / q).astype(np.int64).reshape(*f.shape[:2], 64)[:, :, ZIGZAG]


def _bits_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bits a coefficient has, and those bits (negative ones below their power of two)."""
    n = np.frexp(np.abs(v).astype(float))[1].astype(np.int64)
    return n, np.where(v >= 0, v, v + (1 << n) - 1)


def _entropy(blocks: np.ndarray, c: int) -> tuple[list, bytes]:
    """Huffman tables made for the blocks [n, 64] (components in turn), and the bit stream."""
    n = len(blocks)
    row = np.arange(n)
    table = 2 * np.minimum(row % c, 1)  # DC of luminance, its AC, DC of chrominance, its AC
    steps = blocks[:, 0].copy()
    steps[c:] -= blocks[:-c, 0]
    size, bits = _bits_of(steps)
    r, k = np.nonzero(blocks[:, 1:])
    k = k + 1
    first = np.concatenate(([True], r[1:] != r[:-1])) if len(r) else np.zeros(0, bool)
    gap = k - np.where(first, 0, np.concatenate(([0], k[:-1]))) - 1 if len(r) else k
    ac_size, ac_bits = _bits_of(blocks[r, k])
    far = np.repeat(np.arange(len(r)), gap // 16)  # sixteen zeros have a symbol of their own
    last = np.zeros(n, np.int64)
    last[r] = k  # the last one of a block stays
    short = np.flatnonzero(last < 63)
    # (order in the stream, table, symbol, further bits, their number)
    order = np.concatenate((row * 256, r[far] * 256 + 2 * k[far], r * 256 + 2 * k + 1, short * 256 + 255))
    which = np.concatenate((table, table[r[far]] + 1, table[r] + 1, table[short] + 1))
    symbol = np.concatenate((size, np.full(len(far), 0xF0), (gap % 16) << 4 | ac_size, np.zeros(len(short), np.int64)))
    more = np.concatenate((bits, np.zeros(len(far), np.int64), ac_bits, np.zeros(len(short), np.int64)))
    count = np.concatenate((size, np.zeros(len(far), np.int64), ac_size, np.zeros(len(short), np.int64)))
    by = np.argsort(order, kind="stable")
    which, symbol, more, count = which[by], symbol[by], more[by], count[by]
    made, code, length = [], np.zeros(1024, np.int64), np.zeros(1024, np.int64)
    for t in range(2 if c == 1 else 4):
        seen, times = np.unique(symbol[which == t], return_counts=True)
        made.append(_codes(_lengths(dict(zip(seen.tolist(), times.tolist(), strict=True)))))
        for v, (word, size_) in made[-1][2].items():
            code[t * 256 + v], length[t * 256 + v] = word, size_
    at = which * 256 + symbol
    value, total = code[at] << count | more, length[at] + count
    end = np.cumsum(total)
    left = np.repeat(end, total) - np.arange(end[-1] if len(end) else 0) - 1  # bits of the value that follow
    stream = (np.repeat(value, total) >> left & 1).astype(np.uint8)
    stream = np.concatenate((stream, np.ones(-len(stream) % 8, np.uint8)))
    return made, np.packbits(stream).tobytes().replace(b"\xff", b"\xff\0")


def encode_jpeg(x: np.ndarray, quality: int = 85) -> bytes:
    """u8 with one or three channels, colour at full resolution."""
    y = x[:, :, None] if x.ndim == 2 else x
    if y.dtype != np.uint8 or y.ndim != 3 or y.shape[2] not in (1, 3):
        raise ValueError(f"jpeg: u8 with 1 or 3 channels is needed, not {y.dtype} of shape {list(x.shape)}")
    h, w, c = y.shape
    q = tables(quality)[: 1 if c == 1 else 2]
    if c == 3:
        v = y.astype(float)
        r, g, b = v[:, :, 0], v[:, :, 1], v[:, :, 2]
        planes = [0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b]
    else:
        planes = [y[:, :, 0]]
    coefs = [_blocks(p, q[min(i, 1) if c == 3 else 0]) for i, p in enumerate(planes)]
    made, body = _entropy(np.stack([f.reshape(-1, 64) for f in coefs], 1).reshape(-1, 64), c)
    part = lambda mark, data: struct.pack(">HH", mark, len(data) + 2) + data
    out = b"\xff\xd8" + part(0xFFE0, b"JFIF\0" + struct.pack(">HBHHBB", 0x0101, 0, 1, 1, 0, 0))
    for i, t in enumerate(q):
        out += part(0xFFDB, bytes([i]) + bytes(t.ravel()[ZIGZAG].tolist()))
    out += part(0xFFC0, struct.pack(">BHHB", 8, h, w, c) + b"".join(bytes([k + 1, 0x11, min(k, 1)]) for k in range(c)))
    for t, (counts, symbols, _) in enumerate(made):
        out += part(0xFFC4, bytes([(t & 1) << 4 | t >> 1]) + bytes(counts) + bytes(symbols))
    out += part(0xFFDA, bytes([c]) + b"".join(bytes([k + 1, 0x11 * min(k, 1)]) for k in range(c)) + b"\0\x3f\0")
    return out + body + b"\xff\xd9"


def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """For every 16 bits the symbol they begin with and its length, as symbol << 5 | length; -1 where no code fits."""
    out = np.full(1 << 16, -1, np.int64)
    code, at = 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = symbols[at] << 5 | n
            code, at = code + 1, at + 1
        code <<= 1
    return out.tolist()


def decode_jpeg(b: bytes) -> np.ndarray:
    q, huff, comps, every, at, size = {}, {}, {}, 0, 2, None
    while True:
        if at + 4 > len(b):
            raise ValueError("a JPEG ends before its picture")
        mark, n = struct.unpack_from(">HH", b, at)
        body = b[at + 4 : at + 2 + n]
        at += 2 + n
        if mark == 0xFFDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                t = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else np.uint8).astype(np.int64)
                q[k] = np.zeros(64, np.int64)
                q[k][ZIGZAG] = t
                body = body[1 + 64 * (1 + wide) :]
        elif mark == 0xFFC4:
            while body:
                total = sum(body[1:17])
                huff[body[0]] = _lookup(body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif mark in (0xFFC0, 0xFFC1):
            depth, h, w, c = struct.unpack_from(">BHHB", body)
            if depth != 8:
                raise ValueError("a JPEG of more than 8 bits")
            size = h, w
            comps = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(c)}
        elif 0xFFC2 <= mark <= 0xFFCF and mark != 0xFFC8 and mark != 0xFFCC:
            from .codecs import _with_pillow

            return _with_pillow(b, "progressive JPEG")
        elif mark == 0xFFDD:
            every = struct.unpack(">H", body)[0]
        elif mark == 0xFFDA:
            scan = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            break
    if size is None or len(scan) != len(comps):
        raise ValueError("a JPEG without a frame, or with more than one scan")
    h, w = size
    hm, vm = max(s[0] for s in comps.values()), max(s[1] for s in comps.values())
    mx, my = -(-w // (8 * hm)), -(-h // (8 * vm))
    coefs = {k: np.zeros((my * s[1], mx * s[0], 64), np.int64) for k, s in comps.items()}
    end = b.find(b"\xff\xd9", at)
    raw = b[at : end if end >= 0 else len(b)]
    if every:
        import re

        pieces = re.split(rb"\xff[\xd0-\xd7]", raw)
    else:
        pieces = [raw]
    mcu = 0
    for piece in pieces:
        data = piece.replace(b"\xff\0", b"\xff") + b"\0\0\0\0"
        bits = int.from_bytes(data[:0], "big")
        acc, held, pos, last = bits, 0, 0, dict.fromkeys(comps, 0)
        limit = min(mx * my, mcu + every) if every else mx * my
        while mcu < limit:
            y0, x0 = divmod(mcu, mx)
            for k, t in scan:
                hs, vs, _ = comps[k]
                dc, ac = huff[t >> 4], huff[16 | t & 15]
                for v in range(vs):
                    for u in range(hs):
                        block = coefs[k][y0 * vs + v, x0 * hs + u]
                        j = 0
                        while j < 64:
                            while held < 32:
                                acc = (acc << 32 | int.from_bytes(data[pos : pos + 4].ljust(4, b"\0"), "big")) & 0xFFFFFFFFFFFFFFFF
                                pos += 4
                                held += 32
                            e = (ac if j else dc)[acc >> (held - 16) & 0xFFFF]
                            if e < 0 or pos > len(data) + 16:
                                raise ValueError("a JPEG's bit stream is damaged")
                            held -= e & 31
                            symbol = e >> 5
                            n = symbol & 15
                            if j:
                                if n == 0:
                                    if symbol != 0xF0:
                                        break
                                    j += 16
                                    continue
                                j += symbol >> 4
                                if j > 63:
                                    raise ValueError("a JPEG's block is too long")
                            else:
                                n = symbol
                            value = acc >> (held - n) & ((1 << n) - 1) if n else 0
                            held -= n
                            if n and value < 1 << (n - 1):
                                value -= (1 << n) - 1
                            if j == 0:
                                last[k] += value
                                value = last[k]
                            block[ZIGZAG_LIST[j]] = value
                            j += 1
            mcu += 1
    planes = []
    for k, (hs, vs, t) in comps.items():
        f = (coefs[k] * q[t]).reshape(my * vs, mx * hs, 8, 8).astype(float)
        p = (DCT.T @ f @ DCT + 128).transpose(0, 2, 1, 3).reshape(my * vs * 8, mx * hs * 8)
        planes.append(p.repeat(vm // vs, 0).repeat(hm // hs, 1)[:h, :w])
    if len(planes) == 1:
        return np.clip(np.rint(planes[0]), 0, 255).astype(np.uint8)[:, :, None]
    if len(planes) != 3:
        raise ValueError(f"a JPEG of {len(planes)} components")
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    return np.clip(np.rint(np.stack((y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb), 2)), 0, 255).astype(np.uint8)


ZIGZAG_LIST = ZIGZAG.tolist()
