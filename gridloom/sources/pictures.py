"""Gray and colour file formats: the web's, home computers', instruments', video and text.

Decoders give (samples, maxval) and encoders take them, as in formats.  Decoders of files
that may hold several images give a list of such pairs.  Colours beyond what a format can
hold are an error, not a silent change: quantise first.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable

import numpy as np

from gridloom.sources.bitmaps import pack_runs, unpack_runs

Image = tuple[np.ndarray, int]


def scaled(m: np.ndarray, maxval: int, to: int) -> np.ndarray:
    """Samples at another maxval, rounded."""
    return m if maxval == to else (m * to + maxval // 2) // maxval


def as_rgb(m: np.ndarray) -> np.ndarray:
    return np.repeat(m[:, :, :1], 3, axis=2) if m.shape[2] < 3 else m[:, :, :3]


def palette_of(m: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct colours in order, and each cell's number among them."""
    table, which = np.unique(m.reshape(-1, m.shape[2]), axis=0, return_inverse=True)
    if len(table) > most:
        raise ValueError(f"{len(table)} colours where {most} are possible")
    return table, which.reshape(m.shape[:2])


def _samples(raw: bytes, kind: str, *shape: int, at: int = 0) -> np.ndarray:
    n = int(np.prod(shape))
    if len(raw) < at + n * np.dtype(kind).itemsize:
        raise ValueError("the raster ends early")
    return np.frombuffer(raw, kind, n, at).reshape(shape).astype(np.int64)


def _fields(data: np.ndarray, depth: int, width: int) -> np.ndarray:
    """Numbers of 1, 2, 4 or 8 bits in lines of bytes (height x line), the highest bits first; height x width."""
    per = 8 // depth
    return np.stack([data >> (8 - depth * (k + 1)) & ((1 << depth) - 1) for k in range(per)], axis=2).reshape(len(data), -1)[:, :width].astype(np.int64)


def _pack_fields(k: np.ndarray, depth: int) -> np.ndarray:
    per = 8 // depth
    full = np.pad(k, ((0, 0), (0, -k.shape[1] % per))).reshape(len(k), -1, per)
    return (full << (depth * np.arange(per - 1, -1, -1))).sum(axis=2).astype(np.uint8)


# ---- PNG

PNG = b"\x89PNG\r\n\x1a\n"
#: First row, first column, row step and column step of each pass of an interlaced file.
PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))
#: Planes of each colour type.
PNG_PLANES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _unfilter(raw: bytes, height: int, line: int, step: int) -> np.ndarray:
    """Lines without their filters; step is the number of bytes of a cell."""
    m = np.frombuffer(raw, np.uint8, height * (line + 1)).reshape(height, line + 1)
    out = np.zeros((height + 1, line + step), np.int64)
    for r in range(height):
        kind, x, up, now = m[r, 0], m[r, 1:].astype(np.int64), out[r], out[r + 1]
        if kind == 0:
            now[step:] = x
        elif kind == 1:
            cells = np.pad(x, (0, -line % step)).reshape(-1, step)
            now[step:] = (np.cumsum(cells, axis=0) & 255).ravel()[:line]
        elif kind == 2:
            now[step:] = x + up[step:] & 255
        elif kind == 3:
            for k in range(line):
                now[k + step] = x[k] + (now[k] + up[k + step]) // 2 & 255
        elif kind == 4:
            for k in range(line):
                a, b, c = int(now[k]), int(up[k + step]), int(up[k])
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                now[k + step] = x[k] + near & 255
        else:
            raise ValueError("an unknown filter")
    return out[1:, step:]


def png_decode(raw: bytes, alpha: bool = False) -> Image:
    """PNG of any colour type and depth, interlaced or not.  Transparency is left out unless alpha."""
    if raw[:8] != PNG:
        raise ValueError("no PNG")
    at, parts, data, table, clear = 8, {}, [], None, None
    while at + 8 <= len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", raw, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise ValueError("a damaged chunk")
        if kind == b"IDAT":
            data.append(body)
        elif kind == b"PLTE":
            table = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int64)
        elif kind == b"tRNS":
            clear = body
        parts.setdefault(kind, body)
        at += size + 12
        if kind == b"IEND":
            break
    width, height, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    planes, body = PNG_PLANES[colour], zlib.decompress(b"".join(data))
    out, at = np.zeros((height, width, planes), np.int64), 0
    for r0, c0, dr, dc in PASSES if interlace else ((0, 0, 1, 1),):
        h, w = -(-(height - r0) // dr), -(-(width - c0) // dc)
        if h <= 0 or w <= 0:
            continue
        line = -(-w * planes * depth // 8)
        m = _unfilter(body[at:], h, line, max(1, planes * depth // 8))
        at += h * (line + 1)
        if depth == 16:
            m = m[:, ::2] << 8 | m[:, 1::2]
        elif depth < 8:
            m = _fields(m, depth, w * planes)
        out[r0::dr, c0::dc] = m.reshape(h, w, planes)
    maxval = (1 << depth) - 1
    opaque = None
    if colour == 3:
        if clear is not None:
            opaque = np.frombuffer(clear.ljust(len(table), b"\xff"), np.uint8).astype(np.int64)[out[:, :, 0]]
        out, maxval = table[out[:, :, 0]], 255
    elif colour >= 4:
        out, opaque = out[:, :, :-1], out[:, :, -1]
    elif clear is not None:
        key = np.array(struct.unpack(f">{planes}H", clear))
        opaque = np.where((out == key).all(axis=2), 0, maxval)
    if alpha:
        opaque = np.full(out.shape[:2], maxval) if opaque is None else opaque
        out = np.concatenate([out, opaque[:, :, None]], axis=2)
    return out, maxval


def png_encode(m: np.ndarray, maxval: int) -> bytes:
    """Gray of 1, 2, 4, 8 or 16 bits, gray with alpha, colour, or colour with alpha; each line with the filter that leaves the least sum."""
    height, width, planes = m.shape
    depth = {1: 1, 3: 2, 15: 4}.get(maxval) if planes == 1 else None
    depth = depth or (8 if maxval <= 255 else 16)
    m = scaled(m, maxval, (1 << depth) - 1)
    lines = m.reshape(height, -1)
    lines = _pack_fields(lines, depth) if depth < 8 else np.frombuffer(lines.astype("u1" if depth == 8 else ">u2").tobytes(), np.uint8).reshape(height, -1)
    step, lines = max(1, planes * depth // 8), lines.astype(np.int64)
    up = np.vstack([np.zeros((1, lines.shape[1]), np.int64), lines[:-1]])
    left = np.pad(lines, ((0, 0), (step, 0)))[:, : lines.shape[1]]
    corner = np.pad(up, ((0, 0), (step, 0)))[:, : lines.shape[1]]
    p = left + up - corner
    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
    paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
    tries = np.stack([lines, lines - left, lines - up, lines - (left + up) // 2, lines - paeth]) & 255
    best = np.minimum(tries, 256 - tries).sum(axis=2).argmin(axis=0)
    rows = np.concatenate([best[:, None], tries[best, np.arange(height)]], axis=1).astype(np.uint8)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, depth, {1: 0, 2: 4, 3: 2, 4: 6}[planes], 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


# ---- GIF


def _lzw_decode(data: bytes, bits: int) -> bytes:
    """GIF's LZW: codes from the lowest bit, growing to twelve."""
    clear, end = 1 << bits, (1 << bits) + 1
    table: list[bytes] = []
    size, held, have, at, before, out = bits + 1, 0, 0, 0, None, bytearray()
    while True:
        while have < size:
            if at >= len(data):
                return bytes(out)
            held |= data[at] << have
            have, at = have + 8, at + 1
        code, held, have = held & ((1 << size) - 1), held >> size, have - size
        if code == clear:
            table, size, before = [bytes([k]) for k in range(clear)] + [b"", b""], bits + 1, None
            continue
        if code == end:
            return bytes(out)
        if not table:
            table = [bytes([k]) for k in range(clear)] + [b"", b""]
        if before is None:
            own = table[code]
        else:
            if code > len(table):
                raise ValueError("a damaged code")
            own = table[code] if code < len(table) else before + before[:1]
            if len(table) < 4096:
                table.append(before + own[:1])
                if len(table) == 1 << size and size < 12:
                    size += 1
        out += own
        before = own


def _lzw_encode(data: bytes, bits: int) -> bytes:
    clear = 1 << bits
    out, held, have = bytearray(), 0, 0
    fresh = lambda: {bytes([k]): k for k in range(clear)}
    table, size, codes = fresh(), bits + 1, clear + 2

    def put(code: int) -> None:
        nonlocal held, have
        held |= code << have
        have += size
        while have >= 8:
            out.append(held & 255)
            held, have = held >> 8, have - 8

    put(clear)
    now = b""
    for b in data:
        more = now + bytes([b])
        if more in table:
            now = more
            continue
        put(table[now])
        if codes < 4096:
            table[more] = codes
            codes += 1
            if codes > 1 << size and size < 12:
                size += 1
        else:
            put(clear)
            table, size, codes = fresh(), bits + 1, clear + 2
        now = bytes([b])
    if now:
        put(table[now])
        codes += 1
        if codes > 1 << size and size < 12:
            size += 1
    put(clear + 1)
    if have:
        out.append(held & 255)
    return bytes(out)


def gif_decode(raw: bytes, alpha: bool = False) -> list[Image]:
    """Every image of a GIF file, each of its own size; with alpha a plane that is 0 where it's transparent."""
    if raw[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF")
    flags, at, clear, out = raw[10], 13, None, []

    def colours(flags: int, at: int) -> tuple[np.ndarray | None, int]:
        n = 2 << (flags & 7) if flags & 0x80 else 0
        return (np.frombuffer(raw, np.uint8, 3 * n, at).reshape(n, 3).astype(np.int64) if n else None), at + 3 * n

    def blocks(at: int) -> tuple[bytes, int]:
        body = bytearray()
        while n := raw[at]:
            body += raw[at + 1 : at + 1 + n]
            at += n + 1
        return bytes(body), at + 1

    shared, at = colours(flags, at)
    while at < len(raw) and raw[at] != 0x3B:
        if raw[at] == 0x21:
            kind, (body, at) = raw[at + 1], blocks(at + 2)
            if kind == 0xF9:
                clear = body[3] if body[0] & 1 else None
        elif raw[at] == 0x2C:
            width, height, own = struct.unpack_from("<HHB", raw, at + 5)
            table, at = colours(own, at + 10)
            bits, (body, at) = raw[at], blocks(at + 1)
            k = np.frombuffer(_lzw_decode(body, bits), np.uint8)
            if len(k) < width * height:
                raise ValueError("the raster ends early")
            k = k[: width * height].reshape(height, width)
            if own & 0x40:
                order = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, height, step)]
                k = k[np.argsort(order)]
            m = (shared if table is None else table)[k]
            if alpha:
                m = np.concatenate([m, np.where(k == clear, 0, 255)[:, :, None] if clear is not None else np.full((height, width, 1), 255)], axis=2)
            out.append((m, 255))
            clear = None
        else:
            raise ValueError("an unknown block")
    return out


def gif_encode(m: np.ndarray, maxval: int, interlace: bool = False) -> bytes:
    """One image of at most 256 colours."""
    table, k = palette_of(as_rgb(scaled(m, maxval, 255)), 256)
    height, width = k.shape
    bits = max(1, (len(table) - 1).bit_length())
    full = np.zeros((1 << bits, 3), np.uint8)
    full[: len(table)] = table
    if interlace:
        k = k[[r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, height, step)]]
    body = _lzw_encode(k.astype(np.uint8).tobytes(), max(2, bits))
    cut = b"".join(bytes([len(body[j : j + 255])]) + body[j : j + 255] for j in range(0, len(body), 255))
    head = b"GIF87a" + struct.pack("<HHBBB", width, height, 0x80 | 0x70 | bits - 1, 0, 0) + full.tobytes()
    return head + b"\x2c" + struct.pack("<HHHHB", 0, 0, width, height, 0x40 * interlace) + bytes([max(2, bits)]) + cut + b"\0\x3b"


# ---- TIFF


def _tiff_lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes from the highest bit, growing one code early."""
    bits, at, size, before, out = int.from_bytes(data, "big"), 8 * len(data), 9, None, bytearray()
    table: list[bytes] = []
    while at >= size:
        at -= size
        code = bits >> at & ((1 << size) - 1)
        if code == 257:
            break
        if code == 256:
            table, size, before = [bytes([k]) for k in range(256)] + [b"", b""], 9, None
            continue
        own = table[code] if code < len(table) else before + before[:1]
        if before is not None and len(table) < 4096:
            table.append(before + own[:1])
        size = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
        out += own
        before = own
    return bytes(out)


def _packbits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while len(out) < size and at < len(data):
        n = data[at]
        if n == 128:
            at += 1
        elif n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


def tiff_decode(raw: bytes) -> list[Image]:
    """Every image of a TIFF file in strips: bilevel, gray, palette, RGB or CMYK of 1 to 16 bits; plain, PackBits, LZW or deflate."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(raw[:4])
    if not order:
        raise ValueError("no TIFF")
    sizes = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 16: "Q"}
    at, out = struct.unpack_from(order + "I", raw, 4)[0], []
    while at:
        n, tags = struct.unpack_from(order + "H", raw, at)[0], {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * k)
            form = order + str(count * len(sizes.get(kind, "B"))) + sizes.get(kind, "B")[0]
            place = at + 10 + 12 * k
            if struct.calcsize(form) > 4:
                place = struct.unpack_from(order + "I", raw, place)[0]
            tags[tag] = struct.unpack_from(form, raw, place)
        at = struct.unpack_from(order + "I", raw, at + 2 + 12 * n)[0]
        get = lambda tag, value: tags.get(tag, (value,))[0]  # noqa: B023, E731
        width, height, packing, meaning = get(256, 0), get(257, 0), get(259, 1), get(262, 1)
        depth, planes, apart = get(258, 1), get(277, 1), get(284, 1) == 2
        if 322 in tags:
            raise ValueError("tiles")
        rows, per, bodies = min(get(278, height), height), 1 if apart else planes, []
        line = -(-width * per * depth // 8)
        for j, (start, size) in enumerate(zip(tags[273], tags.get(279, (len(raw),)), strict=False)):
            body = raw[start : start + size]
            lines = min(rows, height - j % -(-height // rows) * rows)
            if packing == 32773:
                body = _packbits(body, lines * line)
            elif packing == 5:
                body = _tiff_lzw(body)
            elif packing in (8, 32946):
                body = zlib.decompress(body)
            elif packing != 1:
                raise ValueError(f"compression {packing}")
            m = np.frombuffer(body, np.uint8, lines * line).reshape(lines, line)
            if get(266, 1) == 2:
                m = np.packbits(np.unpackbits(m, axis=1, bitorder="little"), axis=1)
            m = np.frombuffer(m.tobytes(), order + "u2").reshape(lines, -1).astype(np.int64) if depth == 16 else _fields(m, depth, width * per)
            m = m.reshape(lines, width, per)
            if get(317, 1) == 2:
                m = np.cumsum(m, axis=1) & ((1 << depth) - 1)
            bodies.append(m)
        if apart:
            each = len(bodies) // planes
            m = np.concatenate([np.concatenate(bodies[p * each : (p + 1) * each]) for p in range(planes)], axis=2)
        else:
            m = np.concatenate(bodies)
        maxval = (1 << depth) - 1
        if meaning == 0:
            m = maxval - m
        elif meaning == 3:
            table = np.array(tags[320]).reshape(3, -1).T >> 8
            m, maxval = table[m[:, :, 0]].astype(np.int64), 255
        elif meaning == 5:
            m = (maxval - m[:, :, :3]) * (maxval - m[:, :, 3:4]) // maxval
        elif meaning == 2:
            m = m[:, :, :3]
        out.append((m, maxval))
    return out


def _tiff(m: np.ndarray, depth: int, meaning: int, packing: str) -> bytes:
    height, width, planes = m.shape
    data = m.reshape(height, -1)
    lines = _pack_fields(data, depth) if depth < 8 else data.astype("u1" if depth == 8 else "<u2")
    raw = lines.tobytes()
    each = len(raw) // height if height else 0
    rows = max(1, 8192 // max(1, each))
    strips = [raw[k : k + rows * each] for k in range(0, len(raw), max(1, rows * each))]
    if packing == "packbits":
        strips = [b"".join(pack_runs(s[k : k + each]) for k in range(0, len(s), each)) for s in strips]
    elif packing == "deflate":
        strips = [zlib.compress(s) for s in strips]
    starts = np.cumsum([8, *map(len, strips)]).tolist()
    entries = [
        (256, 4, [width]), (257, 4, [height]), (258, 3, [depth] * planes), (259, 3, [{"none": 1, "packbits": 32773, "deflate": 8}[packing]]), (262, 3, [meaning]),
        (273, 4, starts[:-1]), (277, 3, [planes]), (278, 4, [rows]), (279, 4, list(map(len, strips))), (284, 3, [1]),
    ]
    if meaning == 5:
        entries.append((332, 3, [1]))
    at = starts[-1] + starts[-1] % 2
    more, head, place = b"", b"", at + 2 + 12 * len(entries) + 4
    for tag, kind, values in entries:
        body = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(body) > 4:
            head += struct.pack("<HHII", tag, kind, len(values), place + len(more))
            more += body
        else:
            head += struct.pack("<HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", at) + b"".join(strips) + b"\0" * (starts[-1] % 2) + struct.pack("<H", len(entries)) + head + b"\0\0\0\0" + more


def tiff_encode(m: np.ndarray, maxval: int, packing: str = "none") -> bytes:
    """Bilevel, gray or RGB; packing is none, packbits or deflate."""
    depth = 1 if maxval == 1 and m.shape[2] == 1 else 8 if maxval <= 255 else 16
    return _tiff(scaled(m, maxval, (1 << depth) - 1), depth, 2 if m.shape[2] >= 3 else 1, packing)


def tiffcmyk_encode(m: np.ndarray, maxval: int, packing: str = "none") -> bytes:
    """Cyan, magenta, yellow and black of eight bits; black takes what the three have in common."""
    inks = 255 - as_rgb(scaled(m, maxval, 255))
    black = inks.min(axis=2, keepdims=True)
    left = np.where(black < 255, (inks - black) * 255 // np.maximum(1, 255 - black), 0)
    return _tiff(np.concatenate([left, black], axis=2), 8, 5, packing)


# ---- floats


def pfm_decode(raw: bytes, maxval: int = 65535) -> Image:
    """Float map: 32-bit samples from the bottom line up; a negative scale says that they are little-endian."""
    head = re.match(rb"P([Ff])\s(\d+)\s+(\d+)\s(\S+)\s", raw)
    if not head or float(head[4]) == 0:
        raise ValueError("no float map")
    width, height, scale, planes = int(head[2]), int(head[3]), float(head[4]), 3 if head[1] == b"F" else 1
    m = np.frombuffer(raw, "<f4" if scale < 0 else ">f4", height * width * planes, head.end()).reshape(height, width, planes)[::-1] / abs(scale)
    return np.clip(np.floor(m.astype(np.float64) * maxval + 0.5), 0, maxval).astype(np.int64), maxval


def pfm_encode(m: np.ndarray, maxval: int, scale: float = 1.0, little: bool = True) -> bytes:
    m = m[:, :, :3] if m.shape[2] >= 3 else m[:, :, :1]
    head = f"P{'F' if m.shape[2] == 3 else 'f'}\n{m.shape[1]} {m.shape[0]}\n{-scale if little else scale:f}\n"
    return head.encode() + (m[::-1] / maxval * scale).astype("<f4" if little else ">f4").tobytes()


# ---- home computers


def _chunky(words: np.ndarray) -> np.ndarray:
    """Atari screen of four interleaved planes (200 x 80 words) to 200 x 320 numbers."""
    bits = np.unpackbits(words.astype(">u2").view(np.uint8).reshape(200, 20, 4, 2), axis=3).reshape(200, 20, 4, 16)
    return (bits.astype(np.int64) << np.arange(4)[None, None, :, None]).sum(axis=2).reshape(200, 320)


def _planes4(k: np.ndarray) -> bytes:
    bits = (k.reshape(200, 20, 1, 16) >> np.arange(4)[None, None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=3).tobytes()


def _atari_colours(words: np.ndarray) -> np.ndarray:
    w = words.astype(np.int64)
    return np.stack([w >> 8 & 7, w >> 4 & 7, w & 7], axis=-1)


def _atari(raw: bytes, colours: int, at: int) -> Image:
    table = _atari_colours(_samples(raw, ">u2", 16, at=colours))
    return table[_chunky(_samples(raw, ">u2", 200, 80, at=at))], 7


def _atari_encode(m: np.ndarray, maxval: int, head: bytes, start: int) -> bytes:
    if m.shape[0] > 200 or m.shape[1] > 320:
        raise ValueError("at most 320 x 200")
    table, k = palette_of(as_rgb(scaled(m, maxval, 7)), 16)
    full = np.zeros((200, 320), np.int64)
    full[: m.shape[0], : m.shape[1]] = k
    words = np.zeros(16, np.int64)
    words[: len(table)] = table @ np.array([256, 16, 1])
    return (head + words.astype(">u2").tobytes()).ljust(start, b"\0") + _planes4(full)


def pi1_decode(raw: bytes) -> Image:
    """Atari Degas of 320 x 200 and 16 colours of three bits a plane."""
    if raw[:2] != b"\0\0":
        raise ValueError("no Degas file of 16 colours")
    return _atari(raw, 2, 34)


def pi1_encode(m: np.ndarray, maxval: int) -> bytes:
    return _atari_encode(m, maxval, b"\0\0", 34)


def pc1_decode(raw: bytes) -> Image:
    """Degas Elite: as Degas, every line run-length coded, its planes one after the other."""
    if raw[:2] != b"\x80\0":
        raise ValueError("no packed Degas file of 16 colours")
    body, _ = unpack_runs(raw, 32000, 34)
    words = np.frombuffer(body, ">u2").reshape(200, 4, 20).transpose(0, 2, 1).reshape(200, 80)
    return _atari_colours(_samples(raw, ">u2", 16, at=2))[_chunky(words)], 7


def neo_decode(raw: bytes) -> Image:
    """Atari Neochrome: as Degas, with a header of 128 bytes."""
    if raw[:4] != b"\0\0\0\0":
        raise ValueError("no Neochrome file")
    return _atari(raw, 4, 128)


def neo_encode(m: np.ndarray, maxval: int) -> bytes:
    return _atari_encode(m, maxval, b"\0\0\0\0", 128)


def _spectrum(words: np.ndarray, tables: np.ndarray) -> Image:
    """Atari Spectrum: 48 colours a line, of which a column sees 16."""
    k = _chunky(words)
    x, col = 10 * k - 5 * (k & 1) + 1, np.arange(320)
    k = k + 16 * ((col >= x) & (col < x + 160)) + 32 * (col >= x + 160)
    return tables[np.arange(200)[:, None], k], 7


def spu_decode(raw: bytes) -> Image:
    tables = np.zeros((200, 48, 3), np.int64)
    tables[1:] = _atari_colours(_samples(raw, ">u2", 199, 48, at=32000))
    return _spectrum(_samples(raw, ">u2", 200, 80), tables)


def spc_decode(raw: bytes) -> Image:
    """Spectrum, packed: runs over the four planes in turn, then only the colours that are used."""
    if raw[:2] != b"SP":
        raise ValueError("no packed Spectrum file")
    size = struct.unpack_from(">I", raw, 4)[0]
    at, stop, body = 12, 12 + size, bytearray()
    while at < stop:
        n = raw[at]
        if n < 128:
            body += raw[at + 1 : at + 2 + n]
            at += n + 2
        else:
            body += raw[at + 1 : at + 2] * (258 - n)
            at += 2
    screen, n = np.zeros(32000, np.uint8), np.arange(min(len(body), 31840))
    screen[160 + 2 * (n // 7960) + 8 * (n % 7960 // 2) + (n & 1)] = np.frombuffer(bytes(body[: len(n)]), np.uint8)
    tables, at = np.zeros((200, 48, 3), np.int64), stop
    for line in range(1, 200):
        for j in range(3):
            mask, at = struct.unpack_from(">H", raw, at)[0], at + 2
            for b in range(15):
                if mask >> b & 1:
                    tables[line, 16 * j + b], at = _atari_colours(_samples(raw, ">u2", 1, at=at))[0], at + 2
    return _spectrum(screen.view(">u2").reshape(200, 80).astype(np.int64), tables)


def ilbm_decode(raw: bytes) -> Image:
    """Amiga ILBM: up to 8 planes with a palette, half-brite, hold-and-modify, or 24 planes; plain or run-length."""
    if raw[:4] != b"FORM" or raw[8:12] != b"ILBM":
        raise ValueError("no ILBM")
    at, parts = 12, {}
    while at + 8 <= len(raw):
        kind, size = struct.unpack_from(">4sI", raw, at)
        parts.setdefault(kind, raw[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    width, height, _, _, planes, masking, packing = struct.unpack_from(">HHhhBBB", parts[b"BMHD"])
    line, rows = -(-width // 16) * 2, planes + (masking == 1)
    body, size = parts[b"BODY"], height * rows * line
    body = unpack_runs(body, size)[0] if packing else body
    bits = np.unpackbits(_samples(body, "u1", height, rows, line).astype(np.uint8), axis=2)[:, :planes, :width].astype(np.int64)
    mode = struct.unpack(">I", parts[b"CAMG"])[0] if b"CAMG" in parts else 0
    if planes == 24:
        return np.stack([(bits[:, 8 * p : 8 * p + 8] << np.arange(8)[None, :, None]).sum(axis=1) for p in range(3)], axis=2), 255
    k = (bits << np.arange(planes)[None, :, None]).sum(axis=1)
    table = np.frombuffer(parts[b"CMAP"], np.uint8).reshape(-1, 3).astype(np.int64) if b"CMAP" in parts else None
    if mode & 0x800:
        low, out = planes - 2, np.zeros((height, width, 3), np.int64)
        now = np.repeat(table[:1], height, axis=0) if table is not None else np.zeros((height, 3), np.int64)
        for c in range(width):
            code, value = k[:, c] >> low, k[:, c] & ((1 << low) - 1)
            full = scaled(value, (1 << low) - 1, 255)
            for tag, plane in ((1, 2), (2, 0), (3, 1)):
                now[code == tag, plane] = full[code == tag]
            now[code == 0] = table[value[code == 0]]
            out[:, c] = now
        return out, 255
    if table is None:
        return k[:, :, None], (1 << planes) - 1
    if mode & 0x80 and planes == 6:
        table = np.concatenate([table[:32], table[:32] // 2])
    return table[k], 255


def ilbm_encode(m: np.ndarray, maxval: int) -> bytes:
    """A palette of up to 256 colours if they do, else 24 planes; run-length coded by plane and line."""
    rgb = as_rgb(scaled(m, maxval, 255))
    height, width = rgb.shape[:2]
    try:
        table, k = palette_of(rgb, 256)
        planes = max(1, (len(table) - 1).bit_length())
        bits = k[:, None, :] >> np.arange(planes)[None, :, None] & 1
    except ValueError:
        table, planes = None, 24
        bits = np.concatenate([rgb[:, None, :, p] >> np.arange(8)[None, :, None] & 1 for p in range(3)], axis=1)
    bits = np.pad(bits, ((0, 0), (0, 0), (0, -width % 16)))
    rows = np.packbits(bits.astype(np.uint8), axis=2).reshape(height * planes, -1)
    chunk = lambda kind, body: kind + struct.pack(">I", len(body)) + body + b"\0" * (len(body) % 2)
    body = chunk(b"BMHD", struct.pack(">HHhhBBBBHBBhh", width, height, 0, 0, planes, 0, 1, 0, 0, 10, 10, width, height))
    if table is not None:
        body += chunk(b"CMAP", table.astype(np.uint8).tobytes())
    body += chunk(b"BODY", b"".join(pack_runs(r.tobytes()) for r in rows))
    return b"FORM" + struct.pack(">I", 4 + len(body)) + b"ILBM" + body


# ---- icons


def ico_decode(raw: bytes, alpha: bool = False) -> list[Image]:
    """Every icon or cursor of a Windows file, of 1, 4, 8, 24 or 32 bits; with alpha a plane from its mask."""
    zero, kind, n = struct.unpack_from("<HHH", raw)
    if zero or kind not in (1, 2):
        raise ValueError("no icons")
    out = []
    for k in range(n):
        size, at = struct.unpack_from("<II", raw, 6 + 16 * k + 8)
        if raw[at : at + 8] == PNG:
            out.append(png_decode(raw[at : at + size], alpha))
            continue
        head, width, height, _, depth, _, _, _, _, used = struct.unpack_from("<IiiHHIIiiI", raw, at)
        height //= 2
        entries = (used or 1 << depth) if depth <= 8 else 0
        table = np.frombuffer(raw, np.uint8, 4 * entries, at + head).reshape(-1, 4)[:, 2::-1].astype(np.int64)
        at += head + 4 * entries
        line = -(-width * depth // 32) * 4
        m = _samples(raw, "u1", height, line, at=at)
        at += height * line
        if depth <= 8:
            m = table[_fields(m, depth, width)]
        else:
            cells = m[:, : width * depth // 8].reshape(height, width, depth // 8)
            m = cells[:, :, 2::-1]
        mask = np.unpackbits(_samples(raw, "u1", height, -(-width // 32) * 4, at=at).astype(np.uint8), axis=1)[:, :width]
        m = m[::-1]
        if alpha:
            m = np.concatenate([m, 255 * (1 - mask[::-1, :, None].astype(np.int64))], axis=2)
        out.append((m, 255))
    return out


def ico_encode(m: np.ndarray, maxval: int) -> bytes:
    """One icon of at most 256 x 256 and 256 colours; a fourth plane of 0 is its mask."""
    height, width = m.shape[:2]
    if height > 256 or width > 256:
        raise ValueError("at most 256 cells each way")
    table, k = palette_of(as_rgb(scaled(m, maxval, 255)), 256)
    depth = 1 if len(table) <= 2 else 4 if len(table) <= 16 else 8
    pad = lambda rows: np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4)))[::-1].tobytes()
    clear = (m[:, :, 3] == 0).astype(np.uint8) if m.shape[2] > 3 else np.zeros((height, width), np.uint8)
    colours = np.zeros((1 << depth, 4), np.uint8)
    colours[: len(table), :3] = table[:, ::-1]
    body = struct.pack("<IiiHHIIiiII", 40, width, 2 * height, 1, depth, 0, 0, 0, 0, 0, 0) + colours.tobytes() + pad(_pack_fields(k, depth)) + pad(np.packbits(clear, axis=1))
    return struct.pack("<HHH", 0, 1, 1) + struct.pack("<BBBBHHII", width & 255, height & 255, (1 << depth) & 255, 0, 1, depth, len(body), 22) + body


# ---- instruments and text


def fs_decode(raw: bytes) -> Image:
    """Usenix FaceSaver: lines of names, then hexadecimal samples from the bottom line up."""
    head, _, body = raw.decode("latin-1").partition("\n\n")
    width, height, depth = map(int, re.search(r"PicData:\s*(\d+)\s+(\d+)\s+(\d+)", head).groups())
    if depth != 8:
        raise ValueError("eight bits only")
    return _samples(bytes.fromhex(re.sub(r"[^0-9A-Fa-f]", "", body)[: 2 * width * height]), "u1", height, width, 1)[::-1], 255


def fs_encode(m: np.ndarray, maxval: int) -> bytes:
    height, width = m.shape[:2]
    bits = max(1, maxval.bit_length())
    bits = bits if bits <= 2 else 4 if bits <= 4 else 8
    k = m[::-1, :, 0] * ((1 << bits) - 1) // maxval
    digits = _pack_fields(k, bits).tobytes().hex()
    names = "".join(f"{n}: \n" for n in ("FirstName", "LastName", "E-mail", "Telephone", "Company", "Address1", "Address2", "CityStateZip", "Date"))
    lines = "".join(digits[k : k + 60] + "\n" for k in range(0, len(digits), 60))
    return f"{names}PicData: {width} {height} {bits}\nImage: {width} {height} {bits}\n\n{lines}".encode()


def _lispm_size(depth: int) -> int:
    return next(n for n in (1, 2, 4, 8, 16, 32) if depth <= n)


def lispm_decode(raw: bytes) -> Image:
    """Lisp machine bitmap: inverted words of 32 bits, samples from the lowest."""
    magic = b"This is a BitMap file"
    if not raw.startswith(magic):
        raise ValueError("no Lisp machine bitmap")
    width, height, wide, depth = struct.unpack_from("<HHHB", raw, len(magic))
    depth = depth or 1
    size = _lispm_size(depth)
    words = 0xFFFFFFFF - _samples(raw, "<u4", height, wide * size // 32, at=len(magic) + 16)
    k = words[:, :, None] >> (size * np.arange(32 // size)) & ((1 << size) - 1)
    return k.reshape(height, -1)[:, :width, None], 1 << depth


def lispm_encode(m: np.ndarray, maxval: int) -> bytes:
    height, width = m.shape[:2]
    depth = max(1, maxval.bit_length())
    size, wide = _lispm_size(depth), -(-width // 32) * 32
    k = np.pad(m[:, :, 0], ((0, 0), (0, wide - width))).reshape(height, -1, 32 // size)
    words = 0xFFFFFFFF - (k << (size * np.arange(32 // size))).sum(axis=2)
    return b"This is a BitMap file" + struct.pack("<HHHB", width, height, wide, depth) + bytes(9) + words.astype("<u4").tobytes()


def biorad_decode(raw: bytes) -> list[Image]:
    """Every slice of a Bio-Rad confocal file, of one byte or two."""
    width, height, n = struct.unpack_from("<HHH", raw)
    if struct.unpack_from("<H", raw, 54)[0] != 12345:
        raise ValueError("no Bio-Rad file")
    byte = struct.unpack_from("<H", raw, 14)[0] != 0
    m = _samples(raw, "u1" if byte else "<u2", n, height, width, 1, at=76)
    return [(x, 255 if byte else 65535) for x in m]


def hips_decode(raw: bytes) -> Image:
    """HIPS of bytes: lines of header up to a lone dot; frames one below the other."""
    lines, at = [], 0
    while True:
        end = raw.index(b"\n", at) + 1
        lines.append(raw[at:end].strip())
        at = end
        if lines[-1] == b"." and len(lines) > 9:
            break
    n, height, width, depth, packed, kind = (int(lines[k] or 0) for k in (2, 4, 5, 6, 7, 8))
    if kind or depth != 8 or packed:
        raise ValueError("bytes only")
    return _samples(raw, "u1", n * height, width, 1, at=at), 255


def psid_decode(raw: bytes, height: int, width: int, bits: int) -> Image:
    """The hexadecimal data of a PostScript image, without its program."""
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw)
    line = -(-width * bits // 8)
    data = _samples(bytes.fromhex(digits[: 2 * line * height].decode()), "u1", height, line)
    return _fields(data, bits, width)[:, :, None], (1 << bits) - 1


def sbig_decode(raw: bytes) -> Image:
    """SBIG camera: 2048 bytes of text, then 16-bit samples, or differences of them line by line."""
    text, packed, value = raw[:2048].decode("latin-1"), None, {}
    for line in re.split(r"\n\r?|\r", text):
        line = re.sub(r"\s", "", line).lower()
        if line.startswith("st-"):
            packed = "compressed" in line and "uncompressed" not in line
        elif line == "end":
            break
        elif "=" in line:
            name, _, number = line.partition("=")
            value[name] = number
    width, height, maxval = int(value["width"]), int(value["height"]), int(value.get("sat_level", 65535))
    if not packed:
        return _samples(raw, "<u2", height, width, 1, at=2048), maxval
    out, at = np.zeros((height, width, 1), np.int64), 2048
    for r in range(height):
        size, at = struct.unpack_from("<H", raw, at)[0], at + 2
        if size == 2 * width:
            out[r, :, 0], at = _samples(raw, "<u2", width, at=at), at + size
            continue
        now, at = struct.unpack_from("<H", raw, at)[0], at + 2
        out[r, 0] = now
        for c in range(1, width):
            d, at = raw[at], at + 1
            if d == 0x80:
                now, at = struct.unpack_from("<H", raw, at)[0], at + 2
            else:
                now = now + (d - 256 if d > 127 else d) & 0xFFFF
            out[r, c] = now
    return out, maxval


#: How dark the characters from the blank on are.
INK = (
    0, 33, 27, 127, 112, 37, 32, 10, 17, 17, 42, 43, 11, 19, 4, 16, 48, 40, 50, 104, 57, 53, 57, 22, 56, 57, 20, 21, 17, 28, 17, 63,
    64, 73, 82, 24, 68, 60, 56, 56, 85, 40, 42, 112, 22, 127, 112, 20, 96, 32, 98, 83, 26, 85, 54, 87, 80, 76, 90, 36, 16, 36, 94, 19,
    96, 97, 98, 99, 100, 101, 102, 103, 104, 105, 106, 107, 108, 109, 110, 42, 112, 113, 114, 115, 116, 117, 118, 119, 120, 121, 122, 123, 124, 125, 126, 127,
)


def asciigray_decode(raw: bytes, height: int, width: int, divisor: int = 1) -> Image:
    """Text as an image: a character a cell, as dark as its ink; lines that begin with + are printed over the one before."""
    out, row, col = np.zeros((height, width), np.int64), -1, 0
    for line in raw.split(b"\n"):
        over = line.startswith(b"+") and row >= 0
        if not over:
            row += 1
        if row >= height:
            break
        for col, c in enumerate(line[over:][:width]):
            c &= 0x7F
            out[row, col] += INK[c - 32] if c >= 32 else 0
    return np.maximum(0, 127 - out // divisor)[:, :, None], 127


def mtv_decode(raw: bytes) -> Image:
    """The MTV and PRT ray tracers: a line with the size, then RGB."""
    head, _, body = raw.partition(b"\n")
    width, height = map(int, head.split()[:2])
    return _samples(body, "u1", height, width, 3), 255


def qrt_decode(raw: bytes) -> Image:
    """The QRT ray tracer: each line a number, then its red, green and blue."""
    width, height = struct.unpack_from("<HH", raw)
    lines = _samples(raw, "u1", height, 2 + 3 * width, at=4)
    return np.moveaxis(lines[:, 2:].reshape(height, 3, width), 1, 2), 255


def puzz_encode(m: np.ndarray, maxval: int) -> bytes:
    """X11 puzzle: size, palette, a byte a cell."""
    table, k = palette_of(as_rgb(m), 256)
    return struct.pack(">IIB", m.shape[1], m.shape[0], len(table) & 255) + scaled(table, maxval, 255).astype(np.uint8).tobytes() + k.astype(np.uint8).tobytes()


def xvmini_decode(raw: bytes) -> Image:
    """Thumbnail of the xv viewer: three, three and two bits."""
    found = re.match(rb"P7 332[^\n]*\n(?:[^\n]*\n)*?#END_OF_COMMENTS[^\n]*\n\s*(\d+)\s+(\d+)\s+(\d+)[^\n]*\n", raw)
    if not found or b"\n#BUILTIN" in found[0]:
        raise ValueError("no thumbnail")
    k = _samples(raw, "u1", int(found[2]), int(found[1]), at=found.end())
    return np.stack([(k >> 5) * 255 // 7, (k >> 2 & 7) * 255 // 7, (k & 3) * 255 // 3], axis=2), 255


def gould_decode(raw: bytes) -> Image:
    """Gould scanner: blocks of 512 bytes of header, then one to three bytes a cell."""
    rows, line, bits, blocks = struct.unpack_from("<HHHH", raw, 2)
    new_rows, new_line, kind = struct.unpack_from("<III", raw, 12)
    rows, line = rows or new_rows, line or new_line
    width, kind = 8 * line // bits, bits // 8 or kind
    n = 1 if kind <= 1 else min(kind, 3)
    m = _samples(raw, "u1", rows, width, n, at=512 * max(1, blocks))
    return m[:, :, (0, 0, 0) if n == 1 else (0, 1, 1) if n == 2 else (0, 1, 2)], 255


def img_decode(raw: bytes) -> Image:
    """Img-whatnot: sections AT (size), CM (palette) and PD (a byte a cell)."""
    at, table, size = 8, None, None
    while at + 10 <= len(raw):
        kind, n = raw[at : at + 2], int(raw[at + 2 : at + 10])
        body = raw[at + 10 : at + 10 + n]
        if kind == b"AT":
            size = int(body[:4]), int(body[4:8]), int(body[8:12])
        elif kind == b"CM":
            n_used = min(size[2], len(body) // 3)
            table = np.frombuffer(body, np.uint8, 3 * n_used).reshape(-1, 3).astype(np.int64)
        elif kind == b"PD":
            k = _samples(body, "u1", size[1], size[0])
            return (np.repeat(k[:, :, None], 3, axis=2) if table is None else table[k]), 255
        at += 10 + n
    raise ValueError("no picture")


def sir_decode(raw: bytes) -> Image:
    """Solitaire film recorder: 1536 words of header and tables, gray or one plane after the other."""
    magic, _, kind, width, height = struct.unpack_from("<5H", raw)
    if magic != 0x3A4F or kind not in (11, 17):
        raise ValueError("no Solitaire file")
    planes = 3 if kind == 11 else 1
    return np.moveaxis(_samples(raw, "u1", planes, height, width, at=3072), 0, 2), 255


def sir_encode(m: np.ndarray, maxval: int) -> bytes:
    head = np.zeros(1536, "<u2")
    head[:8] = 0x3A4F, 0, 11 if m.shape[2] >= 3 else 17, m.shape[1], m.shape[0], 0, 1, 6
    head[256:261] = 0x1524, 0, 5, 256, 256
    for n in range(3):
        head[512 + n : 1536 : 4] = np.arange(256) << 8
    m = m[:, :, :3] if m.shape[2] >= 3 else m[:, :, :1]
    return head.tobytes() + (np.moveaxis(m, 2, 0) * (255 // maxval)).astype(np.uint8).tobytes()


def leaf_decode(raw: bytes) -> Image:
    """Interleaf: bits, bytes with or without a palette, or 24 bits in planes of each line."""
    magic, version = struct.unpack_from(">IH", raw)
    if magic != 0x894F5053:
        raise ValueError("no Interleaf image")
    width, height, depth, packed = struct.unpack_from(">HHHB", raw, 18)
    if packed:
        raise ValueError("compressed")
    at, table = 25, None
    if depth in (1, 8) and version < 4:
        at += 1
    else:
        kind, n = struct.unpack_from(">IH", raw, at)
        at += 6
        if kind == 0x29000000 and n:
            table = _samples(raw, "u1", 3, 256, at=at).T[:n]
            at += 768
    if depth == 1:
        line = -(-width // 16) * 2
        bits = np.unpackbits(_samples(raw, "u1", height, line, at=at).astype(np.uint8), axis=1)[:, :width]
        return 1 - bits[:, :, None].astype(np.int64), 1
    wide = width + width % 2
    if depth == 24:
        return np.moveaxis(_samples(raw, "u1", height, 3, wide, at=at)[:, :, :width], 1, 2), 255
    k = _samples(raw, "u1", height, wide, at=at)[:, :width]
    return (k[:, :, None] if table is None else table[k]), 255


def leaf_encode(m: np.ndarray, maxval: int) -> bytes:
    """A palette if there are at most 256 colours, else 24 bits."""
    rgb = as_rgb(scaled(m, maxval, 255))
    height, width = rgb.shape[:2]
    head = lambda depth: struct.pack(">IH12xHHHB", 0x894F5053, 4, width, height, depth, 0)
    pad = ((0, 0), (0, width % 2))
    try:
        table, k = palette_of(rgb, 256)
    except ValueError:
        lines = np.moveaxis(np.pad(rgb, (*pad, (0, 0))), 2, 1)
        return head(24) + struct.pack(">IH", 0x29000000, 0) + lines.astype(np.uint8).tobytes()
    full = np.zeros((3, 256), np.uint8)
    full[:, : len(table)] = table.T
    return head(8) + struct.pack(">IH", 0x29000000, len(table)) + full.tobytes() + np.pad(k, pad).astype(np.uint8).tobytes()


def zeiss_decode(raw: bytes) -> Image:
    """Zeiss confocal: cells first, 1024 bytes with palette and size behind; gray if the palette is."""
    at = len(raw) - 1024
    blue, red, green = (np.frombuffer(raw, np.uint8, 256, at + 256 * k).astype(np.int64) for k in range(3))
    width, height = struct.unpack_from("<HH", raw, at + 768 + 8)
    if width * height != at:
        raise ValueError("no Zeiss file")
    k, plain = _samples(raw, "u1", height, width), np.arange(256)
    if (red == plain).all() and (green == plain).all() and (blue == plain).all():
        return k[:, :, None], 255
    return np.stack([red[k], green[k], blue[k]], axis=2), 255


# ---- video


def _from_studio(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Studio-range samples to RGB in 16-bit fixed point."""
    y, u, v = 76310 * (y - 16), u - 128, v - 128
    return np.clip(np.stack([y + 104635 * v, y - 25690 * u - 53294 * v, y + 132278 * u], axis=2) >> 16, 0, 255)


def eyuv_decode(raw: bytes, height: int, width: int) -> list[Image]:
    """Encoder's YUV: for each frame Y, then U and V of half the size."""
    size, out = height * width + 2 * (height // 2) * (width // 2), []
    for at in range(0, len(raw), size):
        y = _samples(raw, "u1", height, width, at=at)
        u, v = (_samples(raw, "u1", height // 2, width // 2, at=at + height * width + k * (height // 2) * (width // 2)) for k in (0, 1))
        u, v = (x.repeat(2, axis=0).repeat(2, axis=1) for x in (u, v))
        out.append((_from_studio(y, u, v), 255))
    return out


def eyuv_encode(m: np.ndarray, maxval: int) -> bytes:
    """Y by single-precision weights, U and V as means of four cells; an odd last row or column is dropped."""
    m = scaled(as_rgb(m), maxval, 255)[: m.shape[0] // 2 * 2, : m.shape[1] // 2 * 2].astype(np.float32)
    w = lambda *c: sum((np.float32(k) * m[:, :, p] for p, k in enumerate(c)), np.float32(0))
    four = lambda x: (x[::2, ::2] + x[1::2, ::2] + x[::2, 1::2] + x[1::2, 1::2]) / np.float32(4) + 128
    y, u, v = w(0.299, 0.587, 0.114), four(w(-0.16874, -0.33126, 0.5)), four(w(0.5, -0.41869, -0.08131))
    return b"".join(np.clip(x, 0, 255).astype(np.uint8).tobytes() for x in (y, u, v))


def yuvsplit_encode(m: np.ndarray, maxval: int) -> tuple[bytes, bytes, bytes]:
    """Three files, Y, U and V, by CCIR 601 in 16-bit fixed point; U and V of half the size."""
    m = scaled(as_rgb(m), maxval, 255)[: m.shape[0] // 2 * 2, : m.shape[1] // 2 * 2]
    r, g, b = (m[:, :, k] for k in range(3))
    y = (19595 * r + 38469 * g + 7471 * b) * 219 // 255 + (16 << 16)
    four = lambda x: x[::2, ::2] + x[::2, 1::2] + x[1::2, ::2] + x[1::2, 1::2] >> 2
    u, v = (np.trunc(x * 224 / 255).astype(np.int64) for x in (four(-11056 * r - 21712 * g + 32768 * b), four(32768 * r - 27440 * g - 5328 * b)))
    return tuple(x.astype(np.uint8).tobytes() for x in (y >> 16, (u >> 16) + 128, (v >> 16) + 128))


def yuvsplit_decode(raw: tuple[bytes, bytes, bytes] | bytes, height: int, width: int, ccir601: bool = True) -> Image:
    """RGB of three files, or of their bytes one after the other."""
    n = height * width
    y_raw, u_raw, v_raw = raw if isinstance(raw, tuple) else (raw[:n], raw[n : n + n // 4], raw[n + n // 4 :])
    y = _samples(y_raw, "u1", height, width)
    u, v = (_samples(x, "u1", height // 2, width // 2).repeat(2, axis=0).repeat(2, axis=1) - 128 for x in (u_raw, v_raw))
    if ccir601:
        y, u, v = (np.trunc(x / d).astype(np.int64) for x, d in (((y - 16) * 255, 219), (u * 255, 224), (v * 255, 224)))
    rgb = np.stack([65536 * y + 91880 * v, 65536 * y - 22580 * u - 46799 * v, 65536 * y + 116128 * u], axis=2)
    return np.clip(rgb >> 16, 0, 255), 255


def yuv411_decode(raw: bytes, height: int, width: int) -> Image:
    """Sony digital camera: four Y, one U and one V for four cells of a line."""
    m = _samples(raw, "u1", height, width // 4, 6)
    return _from_studio(m[:, :, :4].reshape(height, -1), *(m[:, :, k].repeat(4, axis=1) for k in (4, 5))), 255


# ---- for display


def sixel_encode(m: np.ndarray, maxval: int, raw: bool = False) -> bytes:
    """DEC sixels, a line at a time: a palette of per cents, runs counted unless raw."""
    table, k = palette_of(as_rgb(m), 256)
    out = [b"\x900;0;8q\"1;1\n", b"".join(b"#%d;2;%d;%d;%d" % (n, *map(int, c)) for n, c in enumerate(scaled(table, maxval, 100))) + b"\n"]
    for r, row in enumerate(k.tolist()):
        mark, at = bytes([63 + (1 << r % 6)]), 0
        while at < len(row):
            n = 1
            while not raw and at + n < len(row) and row[at + n] == row[at]:
                n += 1
            out.append(b"#%d" % row[at] + (b"!%d" % n if n > 1 else b"") + mark)
            at += n
        out.append(b"$\n" + (b"-\n" if r % 6 == 5 else b""))
    return b"".join(out) + b"\x9c\n"


def term_encode(m: np.ndarray, maxval: int) -> bytes:
    """Half-tone blocks in the nearest of a terminal's 128 pairs of colours."""
    pairs = [(b, c, d) for d in range(8) for b in range(2) for c in range(8)]
    bit = lambda v, k: v >> k & 1
    rgb = np.array([[bit(c, k) * (255 if b else 192) | bit(d, k) * 128 for k in range(3)] for b, c, d in pairs])
    cells = as_rgb(m) * 255 // maxval
    names = [b"\x1b[%dm\x1b[3%dm\x1b[4%dm\xb1" % p for p in pairs]
    lines = (b"".join(names[int(((rgb - c) ** 2).sum(axis=1).argmin())] for c in row) for row in cells)
    return b"".join(line + b"\x1b[0m\n" for line in lines) + b"\x1b[0m"


def html_encode(m: np.ndarray, maxval: int) -> bytes:
    """A table of coloured cells, those of one colour in a rectangle as one."""
    rgb = as_rgb(scaled(m, maxval, 255))
    height, width = rgb.shape[:2]
    done, out = np.zeros((height, width), bool), [f"<TABLE WIDTH={width} HEIGHT={height} BORDER=0 CELLSPACING=0 CELLPADDING=0>"]
    for r in range(height):
        out.append("<TR>")
        for c in range(width):
            if done[r, c]:
                continue
            same = (rgb[r:, c:] == rgb[r, c]).all(axis=2) & ~done[r:, c:]
            w = h = 1
            if c:  # the first column stays single, so every row of the table has a cell
                while True:  # a square that grows, then the side that still can
                    right, down = c + w < width and same[:h, w].all(), r + h < height and same[h, :w].all()
                    if right and down and not same[h, w]:
                        down = False
                    if not (right or down):
                        break
                    w, h = w + bool(right), h + bool(down)
            done[r : r + h, c : c + w] = True
            spans = (f" COLSPAN={w}" if w > 1 else "") + (f" ROWSPAN={h}" if h > 1 else "")
            out.append(f"<TD VALIGN=CENTER ALIGN=CENTER{spans} BGCOLOR=#{rgb[r, c, 0]:02X}{rgb[r, c, 1]:02X}{rgb[r, c, 2]:02X}>\n<TABLE BORDER=0 CELLSPACING=0 CELLPADDING=0><TR><TD WIDTH={w} HEIGHT={h}></TD></TR></TABLE></TD>")
        out.append("</TR>")
    return ("\n".join([*out, "</TABLE>"]) + "\n").encode()


def ps_encode(m: np.ndarray, maxval: int, scale: float = 1.0, dpi: int = 300, page: tuple[float, float] = (8.5, 11.0), name: str = "noname") -> bytes:
    """PostScript that shows the image in the middle of a page; gray of 1, 2, 4 or 8 bits, or colour."""
    height, width, planes = m.shape
    bits = next(n for n in (1, 2, 4, 8) if maxval < 1 << n or n == 8)
    m = scaled(m, maxval, (1 << bits) - 1)
    high, wide = height * scale * 72 / dpi, width * scale * 72 / dpi
    left, low = (page[0] * 72 - wide) / 2, (page[1] * 72 - high) / 2
    colour = planes >= 3
    data = _pack_fields(m[:, :, :3].reshape(height, -1) if colour else m[:, :, 0], bits)
    lines = "\n".join(row.tobytes().hex()[k : k + 60] for row in data for k in range(0, 2 * data.shape[1], 60))
    show = "false 3 colorimage" if colour else "image"
    text = (
        f"%!PS-Adobe-2.0 EPSF-2.0\n%%Title: {name}\n%%BoundingBox: {int(left)} {int(low)} {int(left + wide + 0.999)} {int(low + high + 0.999)}\n%%Pages: 1\n%%EndComments\n"
        f"/picstr {data.shape[1]} string def\ngsave\n{left:.2f} {low:.2f} translate\n{wide:.2f} {high:.2f} scale\n"
        f"{width} {height} {bits} [ {width} 0 0 -{height} 0 {height} ]\n{{ currentfile picstr readhexstring pop }}\n{show}\n{lines}\ngrestore\nshowpage\n%%Trailer\n"
    )
    return text.encode()


def epsi_encode(m: np.ndarray, maxval: int) -> bytes:
    """Encapsulated PostScript with nothing but a preview of a bitmap, cut to its ink."""
    ink = 1 - m[:, :, 0]
    rows, cols = np.flatnonzero(ink.any(axis=1)), np.flatnonzero(ink.any(axis=0))
    top, bottom, left, right = (rows[0], rows[-1] + 1, cols[0], cols[-1] + 1) if len(rows) else (0, 0, 0, 0)
    part, height = ink[top:bottom, left:right], m.shape[0]
    lines = [row.tobytes().hex().upper() for row in _pack_fields(part, 1)] if part.size else []
    body = [f"% {line[k : k + 72]}" for line in lines for k in range(0, len(line), 72)]
    head = ["%!PS-Adobe-2.0 EPSF-1.2", f"%%BoundingBox: {left} {height - bottom} {right} {height - top}", f"%%BeginPreview: {right - left} {bottom - top} 1 {len(body)}"]
    return ("\n".join([*head, *body, "%%EndImage", "%%EndPreview"]) + "\n").encode()


def xwd_encode(m: np.ndarray, maxval: int) -> bytes:
    """X11 window dump: gray of eight bits, or colour of 24 in words of 32."""
    height, width, planes = m.shape
    m, name, colour = scaled(m, maxval, 255), b"xwddump\0", planes >= 3
    line = width * 4 if colour else -(-width // 4) * 4
    fields = [
        100 + len(name), 7, 2, 24 if colour else 8, width, height, 0, 1, 32, 1, 32, 32 if colour else 8, line, 4 if colour else 0,
        0xFF0000 * colour, 0xFF00 * colour, 0xFF * colour, 8, 256, 0 if colour else 256, width, height, 0, 0, 0,
    ]
    table = b"" if colour else b"".join(struct.pack(">IHHHBB", k, k * 257, k * 257, k * 257, 7, 0) for k in range(256))
    if colour:
        cells = (m[:, :, 0] << 16 | m[:, :, 1] << 8 | m[:, :, 2]).astype(">u4").tobytes()
    else:
        cells = np.pad(m[:, :, 0], ((0, 0), (0, line - width))).astype(np.uint8).tobytes()
    return struct.pack(">25I", *fields) + name + table + cells


def xwd_decode(raw: bytes) -> Image:
    """Window dumps of eight bits with a palette, or of 24 and 32."""
    f = struct.unpack_from(">25I", raw)
    head, version, _, depth, width, height = f[:6]
    bits, line, masks, n = f[11], f[12], f[14:17], f[19]
    if version != 7 or bits not in (8, 24, 32):
        raise ValueError("another kind of window dump")
    table = [struct.unpack_from(">IHHHBB", raw, head + 12 * k) for k in range(n)]
    m = _samples(raw, "u1", height, line, at=head + 12 * n)
    if bits == 8:
        colours = np.zeros((256, 3), np.int64)
        for pixel, r, g, b, _, _ in table:
            colours[pixel] = r >> 8, g >> 8, b >> 8
        gray = (colours[:, 0] == colours[:, 1]).all() and (colours[:, 0] == colours[:, 2]).all()
        out = colours[m[:, :width]]
        return (out[:, :, :1] if gray else out), 255
    size = bits // 8
    cells = m[:, : width * size].reshape(height, width, size)
    cells = cells if f[7] else cells[:, :, ::-1]
    word = sum(cells[:, :, k] << 8 * (size - 1 - k) for k in range(size))
    shift = [(mask & -mask).bit_length() - 1 for mask in masks]
    return np.stack([(word & mask) >> s for mask, s in zip(masks, shift, strict=True)], axis=2), 255


FORMATS: dict[str, tuple[Callable[..., Image | list[Image]] | None, Callable[..., bytes] | None]] = {
    "png": (png_decode, png_encode), "gif": (gif_decode, gif_encode), "tiff": (tiff_decode, tiff_encode), "tiffcmyk": (tiff_decode, tiffcmyk_encode), "pfm": (pfm_decode, pfm_encode),
    "pi1": (pi1_decode, pi1_encode), "pc1": (pc1_decode, None), "neo": (neo_decode, neo_encode), "spu": (spu_decode, None), "spc": (spc_decode, None), "ilbm": (ilbm_decode, ilbm_encode),
    "ico": (ico_decode, ico_encode), "fs": (fs_decode, fs_encode), "lispm": (lispm_decode, lispm_encode), "biorad": (biorad_decode, None), "hips": (hips_decode, None), "psid": (psid_decode, None),
    "sbig": (sbig_decode, None), "asciigray": (asciigray_decode, None), "mtv": (mtv_decode, None), "qrt": (qrt_decode, None), "puzz": (None, puzz_encode), "xvmini": (xvmini_decode, None),
    "gould": (gould_decode, None), "img": (img_decode, None), "sir": (sir_decode, sir_encode), "leaf": (leaf_decode, leaf_encode), "zeiss": (zeiss_decode, None), "eyuv": (eyuv_decode, eyuv_encode),
    "yuvsplit": (yuvsplit_decode, lambda m, maxval: b"".join(yuvsplit_encode(m, maxval))), "yuv411": (yuv411_decode, None), "sixel": (None, sixel_encode), "term": (None, term_encode),
    "html": (None, html_encode), "ps": (None, ps_encode), "epsi": (None, epsi_encode), "xwd": (xwd_decode, xwd_encode),
}
#: How files of each format begin.
MAGIC = {
    PNG: "png", b"GIF8": "gif", b"II*\0": "tiff", b"MM\0*": "tiff", b"PF": "pfm", b"Pf": "pfm", b"P7 332": "xvmini", b"FORM": "ilbm", b"FirstName:": "fs", b"This is a BitMap": "lispm",
    b"\x89OPS": "leaf", b"\x4f\x3a": "sir", b"ST-": "sbig", b"\0\0\1\0": "ico", b"\0\0\2\0": "ico",
}
