"""Image files to buffers and back, with NumPy and zlib: PNG, JPEG (baseline), GIF (first frame), BMP, ICO, PNM, QOI,
farbfeld, Radiance HDR and TIFF; of WebP the header.

Pillow, where it is installed, decodes what is left.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

PNG_MAGIC = b"\x89PNG\r\n\x1a\n"


def sniff(b: bytes) -> str:
    """The first bytes of each format."""
    if b[:8] == PNG_MAGIC:
        return "png"
    if b[:3] == b"\xff\xd8\xff":
        return "jpeg"
    if b[:6] in (b"GIF87a", b"GIF89a"):
        return "gif"
    if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
        return "webp"
    if b[:4] in (b"II*\x00", b"MM\x00*"):
        return "tiff"
    if b[:2] == b"BM":
        return "bmp"
    if b[:4] == b"qoif":
        return "qoi"
    if b[:8] == b"farbfeld":
        return "farbfeld"
    if b[:10] == b"#?RADIANCE" or b[:6] == b"#?RGBE":
        return "hdr"
    if b[:4] == b"\0\0\1\0":
        return "ico"
    if len(b) > 2 and b[:1] == b"P" and b[1:2] in b"123456" and b[2:3].isspace():
        return "pnm"
    raise ValueError("the bytes are no image of a known format")


def _png_chunks(b: bytes):
    at = 8
    while at + 8 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, at)
        if at + 12 + n > len(b):
            raise ValueError("a PNG ends inside a chunk")
        yield kind, b[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IEND":
            return


#: Samples a pixel of each colour type.
PNG_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _unfilter(raw: np.ndarray, h: int, row: int, step: int) -> np.ndarray:
    """Rows of a PNG without their prediction."""
    lines = raw[: h * (row + 1)].reshape(h, row + 1)
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if h and (kinds[1:] == 2).all() and kinds[0] in (0, 2):
        return np.cumsum(out, 0, dtype=np.uint8)
    last = np.zeros(row, np.uint8)
    for i in range(h):
        k, cur = int(kinds[i]), out[i]
        if k == 1:
            pad = -row % step
            cells = np.concatenate((cur, np.zeros(pad, np.uint8))).reshape(-1, step)
            cur[:] = np.cumsum(cells, 0, dtype=np.uint8).ravel()[:row]
        elif k == 2:
            cur += last
        elif k in (3, 4):
            a, c = [0] * step, [0] * step
            line, up = cur.tolist(), last.tolist()
            for x in range(row):
                j = x % step
                if k == 3:
                    v = (line[x] + (a[j] + up[x]) // 2) & 255
                else:
                    p = a[j] + up[x] - c[j]
                    pa, pb, pc = abs(p - a[j]), abs(p - up[x]), abs(p - c[j])
                    v = (line[x] + (a[j] if pa <= pb and pa <= pc else up[x] if pb <= pc else c[j])) & 255
                    c[j] = up[x]
                line[x] = a[j] = v
            cur[:] = line
        elif k:
            raise ValueError(f"a PNG row has the unknown filter {k}")
        last = cur
    return out


def _samples(rows: np.ndarray, width: int, depth: int, samples: int) -> np.ndarray:
    h = len(rows)
    if depth == 16:
        return rows.reshape(h, width, samples, 2).view(">u2")[..., 0].astype(np.uint16)
    if depth == 8:
        return rows.reshape(h, width, samples)
    bits = np.unpackbits(rows, axis=1)[:, : width * samples * depth].reshape(h, width * samples, depth)
    return (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8).reshape(h, width, samples)


def decode_png(b: bytes) -> np.ndarray:
    head, data, palette, clear = None, [], None, None
    for kind, body in _png_chunks(b):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
    if head is None or not data:
        raise ValueError("a PNG without header or data")
    w, h, depth, colour, _, _, lace = head
    samples = PNG_SAMPLES[colour]
    step = max(1, samples * depth // 8)
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if not lace:
        x = _samples(_unfilter(raw, h, (w * samples * depth + 7) // 8, step), w, depth, samples)
    else:  # seven passes, each a smaller image
        x, at = np.zeros((h, w, samples), np.uint16 if depth == 16 else np.uint8), 0
        for y0, x0, dy, dx in ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)):
            ph, pw = len(range(y0, h, dy)), len(range(x0, w, dx))
            if ph and pw:
                row = (pw * samples * depth + 7) // 8
                x[y0::dy, x0::dx] = _samples(_unfilter(raw[at:], ph, row, step), pw, depth, samples)
                at += ph * (row + 1)
    if colour == 3:
        if palette is None or int(x.max(initial=0)) >= len(palette):
            raise ValueError("a PNG pixel is not in the palette")
        out = palette[x[:, :, 0]]
        if clear is not None:
            alpha = np.full(len(palette), 255, np.uint8)
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(palette)]
            out = np.concatenate((out, alpha[x[:, :, 0]][:, :, None]), 2)
        return out
    full = x
    if depth < 8:
        full = (x * (255 // ((1 << depth) - 1))).astype(np.uint8)
    if clear is not None and colour in (0, 2):
        key = np.frombuffer(clear, ">u2")[:samples]
        top = 65535 if depth == 16 else 255
        full = np.concatenate((full, np.where((x == key).all(2, keepdims=True), 0, top).astype(full.dtype)), 2)
    return full


def encode_png(x: np.ndarray, level: int = 6) -> bytes:
    """u8 or u16 with 1 to 4 channels; rows by the difference to the one above."""
    y = x[:, :, None] if x.ndim == 2 else x
    if y.ndim != 3 or y.shape[2] not in (1, 2, 3, 4) or y.dtype not in (np.uint8, np.uint16):
        raise ValueError(f"png: no {y.dtype} of shape {list(x.shape)}")
    h, w, c = y.shape
    rows = np.ascontiguousarray(y.astype(">u2") if y.dtype == np.uint16 else y).view(np.uint8).reshape(h, -1)
    body = np.empty((h, rows.shape[1] + 1), np.uint8)
    body[:, 0] = 2
    body[0, 1:] = rows[:1]
    body[1:, 1:] = rows[1:] - rows[:-1]
    chunk = lambda kind, d: struct.pack(">I", len(d)) + kind + d + struct.pack(">I", zlib.crc32(kind + d))
    head = struct.pack(">IIBBBBB", w, h, 8 * y.dtype.itemsize, {1: 0, 2: 4, 3: 2, 4: 6}[c], 0, 0, 0)
    return PNG_MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body.tobytes(), level)) + chunk(b"IEND", b"")


def _words(b: bytes, n: int, at: int) -> tuple[list[bytes], int]:
    """n words from `at`, comments left out, and where the byte after the last one's blank is."""
    out = []
    while len(out) < n:
        while b[at : at + 1].isspace():
            at += 1
        if b[at : at + 1] == b"#":
            at = b.find(b"\n", at) + 1 or len(b)
            continue
        end = at
        while end < len(b) and not b[end : end + 1].isspace():
            end += 1
        if end == at:
            raise ValueError("a PNM ends inside its header")
        out.append(b[at:end])
        at = end
    return out, at + 1


def decode_pnm(b: bytes) -> np.ndarray:
    kind = int(b[1:2])
    words, at = _words(b, 2 if kind in (1, 4) else 3, 2)
    w, h = int(words[0]), int(words[1])
    top = 1 if kind in (1, 4) else int(words[2])
    c = 3 if kind in (3, 6) else 1
    n = w * h * c
    if kind == 1:
        bits = [v - 48 for v in b[at - 1 :] if v in b"01"][:n]
        return (255 - 255 * np.asarray(bits, np.uint8)).reshape(h, w, 1)
    if kind == 4:
        rows = np.frombuffer(b, np.uint8, h * ((w + 7) // 8), at).reshape(h, -1)
        return (255 - 255 * np.unpackbits(rows, axis=1)[:, :w]).astype(np.uint8)[:, :, None]
    if kind in (2, 3):
        v = np.asarray([int(t) for t in b[at - 1 :].split()[:n]])
    else:
        v = np.frombuffer(b, ">u2" if top > 255 else np.uint8, n, at)
    full = 65535 if top > 255 else 255
    out = v.astype(np.int64) if top == full else (v.astype(np.int64) * full + top // 2) // top
    return out.astype(np.uint16 if top > 255 else np.uint8).reshape(h, w, c)


def decode_bmp(b: bytes) -> np.ndarray:
    start, size, w, h, _, bits, packing = struct.unpack_from("<I I i i H H I", b, 10)
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32):
        raise ValueError(f"a BMP of {bits} bits with packing {packing} is not read")
    rows = np.frombuffer(b, np.uint8, (w * bits + 31) // 32 * 4 * abs(h), start).reshape(abs(h), -1)
    if h > 0:
        rows = rows[::-1]
    if bits <= 8:
        used = struct.unpack_from("<I", b, 46)[0] or 1 << bits
        table = np.frombuffer(b, np.uint8, 4 * used, 14 + size).reshape(-1, 4)[:, 2::-1]
        return table[_samples(np.ascontiguousarray(rows), w, bits, 1)[:, :, 0]] if bits == 8 else table[_samples(np.ascontiguousarray(rows[:, : (w * bits + 7) // 8]), w, bits, 1)[:, :, 0]]
    x = rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)
    return x[:, :, [2, 1, 0, 3]] if bits == 32 and size >= 56 else x[:, :, 2::-1]


def decode_farbfeld(b: bytes) -> np.ndarray:
    w, h = struct.unpack_from(">II", b, 8)
    return np.frombuffer(b, ">u2", w * h * 4, 16).reshape(h, w, 4).astype(np.uint16)


def decode_qoi(b: bytes) -> np.ndarray:
    w, h, c = struct.unpack_from(">IIB", b, 4)
    out = np.empty((w * h, 4), np.uint8)
    seen, px, at, n = {}, (0, 0, 0, 255), 14, 0
    while n < w * h:
        t = b[at]
        at += 1
        run = 1
        if t == 254:
            px, at = (*b[at : at + 3], px[3]), at + 3
        elif t == 255:
            px, at = tuple(b[at : at + 4]), at + 4
        elif t < 64:
            px = seen.get(t, (0, 0, 0, 0))
        elif t < 128:
            px = ((px[0] + (t >> 4 & 3) - 2) & 255, (px[1] + (t >> 2 & 3) - 2) & 255, (px[2] + (t & 3) - 2) & 255, px[3])
        elif t < 192:
            g = (t & 63) - 32
            r, bl = (b[at] >> 4) - 8 + g, (b[at] & 15) - 8 + g
            px, at = ((px[0] + r) & 255, (px[1] + g) & 255, (px[2] + bl) & 255, px[3]), at + 1
        else:
            run = (t & 63) + 1
        seen[(px[0] * 3 + px[1] * 5 + px[2] * 7 + px[3] * 11) % 64] = px
        out[n : n + run] = px
        n += run
    return out.reshape(h, w, 4)[:, :, :c]


def decode_gif(b: bytes) -> np.ndarray:
    """The first frame on its canvas, in four channels."""
    w, h, flags, ground = struct.unpack_from("<HHBB", b, 6)
    at = 13
    table = None
    if flags & 128:
        n = 3 << (flags & 7) + 1
        table, at = np.frombuffer(b, np.uint8, n, at).reshape(-1, 3), at + n
    clear = None
    while True:
        mark = b[at]
        if mark == 0x21:
            if b[at + 1] == 0xF9 and b[at + 3] & 1:
                clear = b[at + 6]
            at += 2
            while b[at]:
                at += b[at] + 1
            at += 1
        elif mark == 0x2C:
            break
        else:
            raise ValueError("a GIF without a frame")
    x0, y0, fw, fh, own = struct.unpack_from("<HHHHB", b, at + 1)
    at += 10
    if own & 128:
        n = 3 << (own & 7) + 1
        table, at = np.frombuffer(b, np.uint8, n, at).reshape(-1, 3), at + n
    start = b[at]
    at += 1
    data = bytearray()
    while b[at]:
        data += b[at + 1 : at + 1 + b[at]]
        at += b[at] + 1
    px = np.frombuffer(_lzw(bytes(data), start, fw * fh), np.uint8).reshape(fh, fw)
    if own & 64:  # rows in four passes
        rows = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, fh, step)]
        straight = np.empty_like(px)
        straight[rows] = px
        px = straight
    if table is None or int(px.max(initial=0)) >= len(table):
        raise ValueError("a GIF pixel is not in the palette")
    out = np.zeros((h, w, 4), np.uint8)
    alpha = np.where(px == clear, 0, 255).astype(np.uint8) if clear is not None else np.full(px.shape, 255, np.uint8)
    out[y0 : y0 + fh, x0 : x0 + fw] = np.concatenate((table[px], alpha[:, :, None]), 2)[: h - y0, : w - x0]
    return out


def _lzw(data: bytes, bits: int, n: int) -> bytes:
    """n indices of a stream of growing codes."""
    clear, stop = 1 << bits, (1 << bits) + 1
    words = [bytes([i]) for i in range(clear)] + [b"", b""]
    size, last, out, acc, held = bits + 1, None, bytearray(), 0, 0
    for byte in data:
        acc |= byte << held
        held += 8
        while held >= size:
            code, acc, held = acc & ((1 << size) - 1), acc >> size, held - size
            if code == clear:
                del words[stop + 1 :]
                size, last = bits + 1, None
                continue
            if code == stop or len(out) >= n:
                return bytes(out[:n]).ljust(n, b"\0")
            if code > len(words) or (last is None and code >= clear):
                raise ValueError("a GIF's codes are damaged")
            word = words[code] if code < len(words) else last + last[:1]
            if last is not None and len(words) < 4096:
                words.append(last + word[:1])
                if len(words) == 1 << size and size < 12:
                    size += 1
            out += word
            last = word
    return bytes(out[:n]).ljust(n, b"\0")


def decode_ico(b: bytes) -> np.ndarray:
    """The largest picture of the file: a PNG, or a bitmap with its mask."""
    entries = [struct.unpack_from("<BBBBHHII", b, 6 + 16 * i) for i in range(struct.unpack_from("<H", b, 4)[0])]
    _, _, _, _, _, _, size, at = max(entries, key=lambda e: ((e[0] or 256) * (e[1] or 256), e[5]))
    body = b[at : at + size]
    if body[:8] == PNG_MAGIC:
        return decode_png(body)
    head, w, twice, _, bits, packing, *_ = struct.unpack_from("<IiiHHIIiiII", body)
    h = twice // 2
    used = (struct.unpack_from("<I", body, 32)[0] or 1 << bits) * 4 if bits <= 8 else 0
    start = head + used
    row = (w * bits + 31) // 32 * 4
    half = struct.pack("<IiiHHI", head, w, h, 1, bits, packing) + body[20:]
    out = decode_bmp(b"BM" + struct.pack("<IHHI", 0, 0, 0, 14 + start) + half)
    if bits == 32:
        x = np.frombuffer(body, np.uint8, row * h, start).reshape(h, w, 4)[::-1]
        return x[:, :, [2, 1, 0, 3]]
    mask = np.frombuffer(body, np.uint8, (w + 31) // 32 * 4 * h, start + row * h).reshape(h, -1)[::-1]
    hidden = np.unpackbits(mask, axis=1)[:, :w]
    return np.concatenate((out[:, :, :3], np.where(hidden, 0, 255).astype(np.uint8)[:, :, None]), 2)


def decode_hdr(b: bytes) -> np.ndarray:
    """[H, W, 3] in f32 from shared exponents, plain or in runs."""
    end = b.index(b"\n\n") + 2
    line = b[end : b.index(b"\n", end)]
    words = line.split()
    if len(words) != 4 or words[0] != b"-Y" or words[2] != b"+X":
        raise ValueError("an HDR with turned axes is not read")
    h, w, at = int(words[1]), int(words[3]), end + len(line) + 1
    out = np.empty((h, w, 4), np.uint8)
    for y in range(h):
        if w < 8 or w > 32767 or b[at : at + 2] != b"\2\2":
            out[y] = np.frombuffer(b, np.uint8, 4 * w, at).reshape(w, 4)
            at += 4 * w
            continue
        at += 4
        for c in range(4):
            x = 0
            while x < w:
                n = b[at]
                if n > 128:
                    out[y, x : x + n - 128, c] = b[at + 1]
                    x, at = x + n - 128, at + 2
                else:
                    out[y, x : x + n, c] = np.frombuffer(b, np.uint8, n, at + 1)
                    x, at = x + n, at + 1 + n
    e = out[:, :, 3:].astype(np.int32)
    return np.where(e == 0, 0, np.ldexp(out[:, :, :3].astype(np.float32), e - 136)).astype(np.float32)


def _tiff_tags(b: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the values of the first directory."""
    o = "<" if b[:2] == b"II" else ">"
    at = struct.unpack_from(o + "I", b, 4)[0]
    tags = {}
    for i in range(struct.unpack_from(o + "H", b, at)[0]):
        tag, kind, n = struct.unpack_from(o + "HHI", b, at + 2 + 12 * i)
        form = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}.get(kind)
        if form:
            size = struct.calcsize(form) * n
            place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(o + "I", b, at + 10 + 12 * i)[0]
            tags[tag] = struct.unpack_from(f"{o}{n}{form}", b, place)
    return o, tags


def decode_tiff(b: bytes) -> np.ndarray:
    """Strips, plain or deflated, of unsigned, signed or float samples."""
    o, t = _tiff_tags(b)
    w, h, c = t[256][0], t[257][0], t.get(277, (1,))[0]
    depth, form, pack = t.get(258, (8,))[0], t.get(339, (1,))[0], t.get(259, (1,))[0]
    if pack not in (1, 8, 32946) or depth not in (8, 16, 32, 64) or t.get(284, (1,))[0] != 1 or 322 in t:
        raise ValueError("a TIFF with tiles, planes or this packing is not read")
    strips = [b[s : s + n] for s, n in zip(t[273], t[279], strict=True)]
    raw = b"".join(zlib.decompress(s) if pack != 1 else s for s in strips)
    d = np.dtype(o + {1: "u", 2: "i", 3: "f"}[form] + str(depth // 8))
    x = np.frombuffer(raw, d, w * h * c).reshape(h, w, c).astype(d.newbyteorder("="))
    if t.get(317, (1,))[0] == 2:
        x = np.cumsum(x, 1, dtype=x.dtype)
    return (np.iinfo(x.dtype).max - x) if t.get(262, (1,))[0] == 0 and x.dtype.kind == "u" else x


def encode_tiff(x: np.ndarray) -> bytes:
    """One plain strip, little-endian."""
    y = x[:, :, None] if x.ndim == 2 else x
    if y.ndim != 3:
        raise ValueError(f"tiff: no image of shape {list(x.shape)}")
    h, w, c = y.shape
    data = np.ascontiguousarray(y.astype(y.dtype.newbyteorder("<"))).tobytes()
    tags = [
        (256, 4, [w]), (257, 4, [h]), (258, 3, [8 * y.dtype.itemsize] * c), (259, 3, [1]), (262, 3, [2 if c >= 3 else 1]), (273, 4, [8]),
        (277, 3, [c]), (278, 4, [h]), (279, 4, [len(data)]), *([(338, 3, [2])] if c in (2, 4) else []), (339, 3, [{"u": 1, "i": 2, "f": 3}[y.dtype.kind]] * c),
    ]
    at = 8 + len(data)
    extra_at = at + 2 + 12 * len(tags) + 4
    body, extra = b"", b""
    for tag, kind, values in tags:
        v = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(v) > 4:
            place, extra = struct.pack("<I", extra_at + len(extra)), extra + v
        else:
            place = v.ljust(4, b"\0")
        body += struct.pack("<HHI", tag, kind, len(values)) + place
    return b"II*\0" + struct.pack("<I", at) + data + struct.pack("<H", len(tags)) + body + struct.pack("<I", 0) + extra


def _with_pillow(b: bytes, kind: str) -> np.ndarray:
    try:
        import io

        from PIL import Image
    except ImportError:
        raise ValueError(f"{kind} is decoded by Pillow, which is not installed") from None
    x = np.asarray(Image.open(io.BytesIO(b)))
    return x[:, :, None] if x.ndim == 2 else x


def _decode_jpeg(b: bytes) -> np.ndarray:
    from .jpeg import decode_jpeg

    return decode_jpeg(b)


def _encode_jpeg(x: np.ndarray, quality: int = 85) -> bytes:
    from .jpeg import encode_jpeg

    return encode_jpeg(x, quality)


DECODERS = {"png": decode_png, "pnm": decode_pnm, "bmp": decode_bmp, "farbfeld": decode_farbfeld, "qoi": decode_qoi, "tiff": decode_tiff, "jpeg": _decode_jpeg, "gif": decode_gif, "ico": decode_ico, "hdr": decode_hdr}
ENCODERS = {"png": encode_png, "tiff": encode_tiff, "jpeg": _encode_jpeg}


def decode(b: bytes, orientation: str = "stored", max_size: int | None = None) -> np.ndarray:
    """[H, W, C]. Orientation exif turns the image as its tag says; max_size shrinks the longer side to it."""
    kind = sniff(b)
    try:
        x = DECODERS[kind](b) if kind in DECODERS else _with_pillow(b, kind)
    except (zlib.error, struct.error, IndexError, KeyError, TypeError) as e:
        raise ValueError(f"a damaged {kind}: {e}") from None
    if orientation == "exif":
        x = oriented(x, info(b)["orientation"])
    elif orientation != "stored":
        raise ValueError(f"orientation {orientation!r} is neither stored nor exif")
    if max_size and max(x.shape[:2]) > max_size:
        from ..operators.resample import resample

        s = max_size / max(x.shape[:2])
        x = resample(x, max(1, round(x.shape[0] * s)), max(1, round(x.shape[1] * s)), "area")
    return x


def oriented(x: np.ndarray, tag: int) -> np.ndarray:
    """Tags 2 to 8: mirrored, half turn, upside down, transposed, quarter turn, transverse, three quarter turns."""
    if tag in (5, 6, 7, 8):
        x = x.swapaxes(0, 1)
    if tag in (2, 3, 6, 7):
        x = x[:, ::-1]
    return x[::-1] if tag in (3, 4, 7, 8) else x


def _exif(b: bytes) -> int:
    try:
        v = int(_tiff_tags(b)[1].get(274, (1,))[0])
    except (struct.error, ValueError, TypeError):
        return 1
    return v if 1 <= v <= 8 else 1


def info(b: bytes) -> dict:
    """width, height, channels, dtype and orientation from the header alone."""
    kind = sniff(b)
    depth, tag = "u8", 1
    try:
        if kind == "png":
            w, h, bits, colour = struct.unpack_from(">IIBB", b, 16)
            c, depth = 3 if colour == 3 else PNG_SAMPLES[colour], "u16" if bits == 16 else "u8"
            for name, body in _png_chunks(b):
                if name == b"tRNS":
                    c += c in (1, 3)
                elif name == b"eXIf":
                    tag = _exif(body)
                elif name == b"IDAT":
                    break
        elif kind == "jpeg":
            at, w = 2, None
            while w is None:
                mark, n = struct.unpack_from(">HH", b, at)
                if 0xFFC0 <= mark <= 0xFFCF and mark not in (0xFFC4, 0xFFC8, 0xFFCC):
                    _, h, w, c = struct.unpack_from(">BHHB", b, at + 4)
                elif mark == 0xFFE1 and b[at + 4 : at + 10] == b"Exif\0\0":
                    tag = _exif(b[at + 10 : at + 2 + n])
                at += 2 + n
        elif kind == "gif":
            (w, h), c = struct.unpack_from("<HH", b, 6), 4
        elif kind == "bmp":
            w, h, bits = struct.unpack_from("<ii2xH", b, 18)
            h, c = abs(h), 4 if bits == 32 and struct.unpack_from("<I", b, 14)[0] >= 56 else 3
        elif kind == "qoi":
            w, h, c = struct.unpack_from(">IIB", b, 4)
        elif kind == "farbfeld":
            (w, h), c, depth = struct.unpack_from(">II", b, 8), 4, "u16"
        elif kind == "tiff":
            _, t = _tiff_tags(b)
            w, h, c, tag = t[256][0], t[257][0], t.get(277, (1,))[0], int(t.get(274, (1,))[0])
            depth = {1: "u", 2: "i", 3: "f"}[t.get(339, (1,))[0]] + str(t.get(258, (8,))[0])
        elif kind == "ico":
            size = [(e[0] or 256, e[1] or 256) for e in (struct.unpack_from("<BB", b, 6 + 16 * i) for i in range(struct.unpack_from("<H", b, 4)[0]))]
            (w, h), c = max(size, key=lambda v: v[0] * v[1]), 4
        elif kind == "hdr":
            words = b[b.index(b"\n\n") + 2 :].split(b"\n", 1)[0].split()
            h, w, c, depth = int(words[1]), int(words[3]), 3, "f32"
        elif kind == "webp":
            c = 3
            if b[12:16] == b"VP8X":
                w, h = (1 + int.from_bytes(b[i : i + 3], "little") for i in (24, 27))
                c = 4 if b[20] & 16 else 3
            elif b[12:16] == b"VP8L":
                v = int.from_bytes(b[21:25], "little")
                w, h, c = 1 + (v & 0x3FFF), 1 + (v >> 14 & 0x3FFF), 4 if v >> 28 & 1 else 3
            else:
                w, h = (v & 0x3FFF for v in struct.unpack_from("<HH", b, 26))
        else:
            words, _ = _words(b, 2 if b[1:2] in b"14" else 3, 2)
            w, h, c = int(words[0]), int(words[1]), 3 if b[1:2] in b"36" else 1
            depth = "u16" if len(words) > 2 and int(words[2]) > 255 else "u8"
    except (struct.error, IndexError, KeyError, ValueError) as e:
        raise ValueError(f"a damaged {kind}: {e}") from None
    return {"width": int(w), "height": int(h), "channels": int(c), "dtype": depth, "orientation": tag}
