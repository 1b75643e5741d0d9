"""Other image file formats, decoded and encoded with numpy by the task that holds the file.

Each entry of FORMATS has a decoder from bytes to (samples, maxval), or to a list of them
where a file may hold several images, and an encoder back, where there is one.  Samples are height x width x planes; in bitmaps 1 is white.  All are
published layouts without lossy or licensed compression.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.raster import Raster
from gridloom.sources import anymap, bitmaps, pictures

Image = tuple[np.ndarray, int]


def _bits(raw: bytes, height: int, width: int, line: int, low_first: bool = False) -> np.ndarray:
    packed = np.frombuffer(raw[: line * height], np.uint8)
    if len(packed) < line * height:
        raise ValueError("the raster ends early")
    order = "little" if low_first else "big"
    return np.unpackbits(packed.reshape(height, line), axis=1, bitorder=order)[:, :width, None].astype(np.int64)


def _pack(bits: np.ndarray, multiple: int = 1, low_first: bool = False) -> bytes:
    line = -(-bits.shape[1] // (8 * multiple)) * multiple
    full = np.zeros((bits.shape[0], line * 8), np.uint8)
    full[:, : bits.shape[1]] = bits
    return np.packbits(full, axis=1, bitorder="little" if low_first else "big").tobytes()


# ---- bitmaps


def xbm_decode(raw: bytes) -> Image:
    """C source of an X11 bitmap; set bits are black."""
    text = raw.decode("latin-1")
    width, height = (int(re.search(rf"#define\s+\S*{n}\s+(\d+)", text)[1]) for n in ("width", "height"))
    data = bytes(int(v, 16) for v in re.findall(r"0[xX]([0-9a-fA-F]{1,2})\b", text[text.index("{") :]))
    return 1 - _bits(data, height, width, -(-width // 8), True), 1


def xbm_encode(m: np.ndarray, maxval: int, name: str = "image") -> bytes:
    data = _pack(1 - m[:, :, 0], low_first=True)
    lines = [", ".join(f"0x{b:02x}" for b in data[k : k + 12]) for k in range(0, len(data), 12)]
    return (f"#define {name}_width {m.shape[1]}\n#define {name}_height {m.shape[0]}\nstatic char {name}_bits[] = {{\n " + ",\n ".join(lines) + "};\n").encode()


def _multibyte(raw: bytes, at: int) -> tuple[int, int]:
    value = 0
    while True:
        value = value << 7 | raw[at] & 0x7F
        at += 1
        if raw[at - 1] < 0x80:
            return value, at


def wbmp_decode(raw: bytes) -> Image:
    """Wireless bitmap, type 0; set bits are white."""
    kind, at = _multibyte(raw, 0)
    if kind:
        raise ValueError("only type 0")
    width, at = _multibyte(raw, at + 1)
    height, at = _multibyte(raw, at)
    return _bits(raw[at:], height, width, -(-width // 8)), 1


def wbmp_encode(m: np.ndarray, maxval: int) -> bytes:
    def number(n: int) -> bytes:
        out = [n & 0x7F]
        while n := n >> 7:
            out.append(n & 0x7F | 0x80)
        return bytes(reversed(out))

    return b"\0\0" + number(m.shape[1]) + number(m.shape[0]) + _pack(m[:, :, 0])


def ascii_art(m: np.ndarray, maxval: int) -> bytes:
    """One character for two rows of a bitmap."""
    black = 1 - m[:, :, 0]
    black = np.concatenate([black, np.zeros((len(black) % 2, black.shape[1]), black.dtype)])
    return b"".join("".join(" \"o$"[int(a) + 2 * int(b)] if (a, b) != (0, 0) else " " for a, b in zip(x, y, strict=True)).rstrip().encode() + b"\n" for x, y in zip(black[::2], black[1::2], strict=True))


# ---- raw samples


def raw_decode(raw: bytes, height: int, width: int, planes: int = 1, order: str = "pixel") -> Image:
    """Bytes without a header: by pixel, by plane, or bottom up."""
    m = np.frombuffer(raw[: height * width * planes], np.uint8)
    if len(m) < height * width * planes:
        raise ValueError("the raster ends early")
    if order == "plane":
        return np.moveaxis(m.reshape(planes, height, width), 0, 2).astype(np.int64), 255
    m = m.reshape(height, width, planes).astype(np.int64)
    return (m[::-1] if order == "bottomup" else m), 255


def raw_encode(m: np.ndarray, maxval: int, order: str = "pixel") -> bytes:
    m = m if order != "plane" else np.moveaxis(m, 2, 0)
    return (m[::-1] if order == "bottomup" else m).astype(np.uint8).tobytes()


def yuv_decode(raw: bytes, height: int, width: int) -> Image:
    """Interleaved U Y V Y, two pixels in four bytes, to RGB."""
    m = np.frombuffer(raw[: height * width * 2], np.uint8).reshape(height, width // 2, 4).astype(float)
    y = m[:, :, 1::2].reshape(height, width)
    u, v = (np.repeat(m[:, :, k], 2, axis=1) - 128 for k in (0, 2))
    y = 1.164 * (y - 16)
    rgb = np.stack([y + 1.596 * v, y - 0.813 * v - 0.391 * u, y + 2.018 * u], axis=2)
    return np.clip(np.floor(rgb + 0.5), 0, 255).astype(np.int64), 255


def yuv_encode(m: np.ndarray, maxval: int) -> bytes:
    r, g, b = (m[:, :, k] * 255.0 / maxval for k in range(3))
    y = 16 + 0.257 * r + 0.504 * g + 0.098 * b
    u, v = 128 - 0.148 * r - 0.291 * g + 0.439 * b, 128 + 0.439 * r - 0.368 * g - 0.071 * b
    u, v = ((x[:, ::2] + x[:, 1::2]) / 2 for x in (u, v))
    return np.clip(np.floor(np.stack([u, y[:, ::2], v, y[:, 1::2]], axis=2) + 0.5), 0, 255).astype(np.uint8).tobytes()


# ---- palettes and true colour


def bmp_decode(raw: bytes) -> Image:
    """Windows bitmap of 1, 4, 8, 24 or 32 bits, not compressed."""
    if raw[:2] != b"BM":
        raise ValueError("no BM")
    at, size = struct.unpack_from("<I", raw, 10)[0], struct.unpack_from("<I", raw, 14)[0]
    if size == 12:
        width, height, _, depth = struct.unpack_from("<HHHH", raw, 18)
        packing, used = 0, 0
    else:
        width, height, _, depth, packing = struct.unpack_from("<iiHHI", raw, 18)
        used = struct.unpack_from("<I", raw, 46)[0]
    if packing:
        raise ValueError("compressed")
    top_down, height = height < 0, abs(height)
    line = -(-width * depth // 32) * 4
    body = np.frombuffer(raw[at : at + line * height], np.uint8).reshape(height, line)
    if depth >= 24:
        m = body[:, : width * depth // 8].reshape(height, width, depth // 8)[:, :, 2::-1].astype(np.int64)
    else:
        per = 8 // depth
        k = np.stack([body >> (8 - depth * (j + 1)) & ((1 << depth) - 1) for j in range(per)], axis=2).reshape(height, -1)[:, :width]
        entry = 3 if size == 12 else 4
        table = np.frombuffer(raw[14 + size : 14 + size + entry * (used or 1 << depth)], np.uint8).reshape(-1, entry)[:, 2::-1]
        m = table[k].astype(np.int64)
    return (m if top_down else m[::-1]), 255


def _rgb8(m: np.ndarray, maxval: int) -> np.ndarray:
    m = (m * 255 + maxval // 2) // maxval
    return np.repeat(m, 3, axis=2).astype(np.uint8) if m.shape[2] == 1 else m[:, :, :3].astype(np.uint8)


def bmp_encode(m: np.ndarray, maxval: int) -> bytes:
    """24 bits, bottom up, lines to a multiple of four bytes."""
    m = _rgb8(m, maxval)
    height, width, _ = m.shape
    line = -(-width * 3 // 4) * 4
    body = np.zeros((height, line), np.uint8)
    body[:, : width * 3] = m[::-1, :, ::-1].reshape(height, -1)
    return b"BM" + struct.pack("<IHHI", 54 + body.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


def tga_decode(raw: bytes) -> Image:
    """Targa: mapped, true colour or gray, plain or run-length."""
    ident, mapped, kind = raw[0], raw[1], raw[2]
    first, length, entry = struct.unpack_from("<HHB", raw, 3)
    width, height, depth, flags = struct.unpack_from("<HHBB", raw, 12)
    at = 18 + ident
    table = np.frombuffer(raw[at : at + length * entry // 8], np.uint8).reshape(length, -1) if mapped else None
    at += length * entry // 8 if mapped else 0
    size, n = depth // 8, width * height
    if kind & 8:
        out = bytearray()
        while len(out) < n * size:
            head, at = raw[at], at + 1
            count = (head & 0x7F) + 1
            if head & 0x80:
                out += raw[at : at + size] * count
                at += size
            else:
                out += raw[at : at + size * count]
                at += size * count
        body = bytes(out[: n * size])
    else:
        body = raw[at : at + n * size]
    m = np.frombuffer(body, np.uint8).reshape(height, width, size)
    if kind & 7 == 1:
        m = table[m[:, :, 0].astype(int) - first]
    if m.shape[2] >= 3:
        m = m[:, :, 2::-1]
    return (m if flags & 0x20 else m[::-1]).astype(np.int64), 255


def tga_encode(m: np.ndarray, maxval: int) -> bytes:
    m = _rgb8(m, maxval)
    return struct.pack("<BBBHHBHHHHBB", 0, 0, 2, 0, 0, 0, 0, 0, m.shape[1], m.shape[0], 24, 0x20) + m[:, :, ::-1].tobytes()


def pcx_decode(raw: bytes) -> Image:
    """PCX of 8 bits with a palette, 24 bits in planes, or 1 to 4 planes of bits."""
    depth, (x0, y0, x1, y1), planes, line = raw[3], struct.unpack_from("<4H", raw, 4), raw[65], struct.unpack_from("<H", raw, 66)[0]
    width, height, at, out = x1 - x0 + 1, y1 - y0 + 1, 128, bytearray()
    while len(out) < height * planes * line:
        b, at = raw[at], at + 1
        if b >= 0xC0:
            out += bytes([raw[at]]) * (b & 0x3F)
            at += 1
        else:
            out.append(b)
    m = np.frombuffer(bytes(out[: height * planes * line]), np.uint8).reshape(height, planes, line)
    if depth == 8 and planes == 3:
        return np.moveaxis(m[:, :, :width], 1, 2).astype(np.int64), 255
    if depth == 8:
        return np.frombuffer(raw[-768:], np.uint8).reshape(256, 3)[m[:, 0, :width]].astype(np.int64), 255
    bits = np.unpackbits(m, axis=2)[:, :, :width].astype(int)
    k = sum(bits[:, p] << p for p in range(planes))
    return np.frombuffer(raw[16:64], np.uint8).reshape(16, 3)[k].astype(np.int64), 255


def pcx_encode(m: np.ndarray, maxval: int) -> bytes:
    """24 bits in three planes."""
    m = _rgb8(m, maxval)
    height, width, _ = m.shape
    line = width + width % 2
    head = struct.pack("<BBBB4H2H48sBBHH", 10, 5, 1, 8, 0, 0, width - 1, height - 1, 72, 72, bytes(48), 0, 3, line, 1).ljust(128, b"\0")
    out = bytearray()
    for row in np.moveaxis(np.pad(m, ((0, 0), (0, line - width), (0, 0))), 2, 1).reshape(-1, line):
        k = 0
        while k < line:
            n = 1
            while n < 63 and k + n < line and row[k + n] == row[k]:
                n += 1
            out += bytes([0xC0 | n, row[k]]) if n > 1 or row[k] >= 0xC0 else bytes([row[k]])
            k += n
    return head + bytes(out)


def sun_decode(raw: bytes) -> Image:
    """Sun raster of 1, 8, 24 or 32 bits, plain or byte-encoded."""
    magic, width, height, depth, size, kind, map_kind, map_size = struct.unpack_from(">8I", raw)
    if magic != 0x59A66A95:
        raise ValueError("no Sun raster")
    table = np.frombuffer(raw[32 : 32 + map_size], np.uint8).reshape(3, -1).T if map_size else None
    body = raw[32 + map_size :]
    line = -(-width * depth // 16) * 2
    if kind == 2:
        out, at = bytearray(), 0
        while len(out) < line * height:
            b, at = body[at], at + 1
            if b != 0x80:
                out.append(b)
            elif body[at] == 0:
                out.append(0x80)
                at += 1
            else:
                out += bytes([body[at + 1]]) * (body[at] + 1)
                at += 2
        body = bytes(out)
    if depth == 1:
        m = 1 - _bits(body, height, width, line)
        return (table[1 - m[:, :, 0]].astype(np.int64), 255) if table is not None else (m, 1)
    m = np.frombuffer(body[: line * height], np.uint8).reshape(height, line)[:, : width * depth // 8].reshape(height, width, depth // 8)
    if depth == 8:
        return (table[m[:, :, 0]] if table is not None else m).astype(np.int64), 255
    return (m[:, :, -3:] if kind == 3 else m[:, :, :-4:-1]).astype(np.int64), 255


def sun_encode(m: np.ndarray, maxval: int) -> bytes:
    m = _rgb8(m, maxval)
    height, width, _ = m.shape
    body = np.zeros((height, width * 3 + width % 2), np.uint8)
    body[:, : width * 3] = m[:, :, ::-1].reshape(height, -1)
    return struct.pack(">8I", 0x59A66A95, width, height, 24, body.size, 1, 0, 0) + body.tobytes()


def sgi_decode(raw: bytes) -> Image:
    """SGI image of one or two bytes, plain or run-length; rows from the bottom."""
    magic, packed, bpc, dims, width, height, planes = struct.unpack_from(">HBBHHHH", raw)
    if magic != 474:
        raise ValueError("no SGI image")
    height, planes = (height if dims > 1 else 1), (planes if dims > 2 else 1)
    kind = np.dtype("u1" if bpc == 1 else ">u2")
    if not packed:
        m = np.frombuffer(raw, kind, width * height * planes, 512).reshape(planes, height, width)
    else:
        starts = np.frombuffer(raw, ">u4", height * planes, 512)
        m = np.zeros((planes * height, width), np.int64)
        for k, at in enumerate(starts.tolist()):
            line: list[int] = []
            while True:
                head = int.from_bytes(raw[at : at + bpc], "big")
                at, n = at + bpc, head & 0x7F
                if not n:
                    break
                take = n if head & 0x80 else 1
                got = [int.from_bytes(raw[at + j * bpc : at + (j + 1) * bpc], "big") for j in range(take)]
                line += got if head & 0x80 else got * n
                at += take * bpc
            m[k] = line[:width]
        m = m.reshape(planes, height, width)
    return np.moveaxis(m, 0, 2)[::-1].astype(np.int64), 255 if bpc == 1 else 65535


def sgi_encode(m: np.ndarray, maxval: int) -> bytes:
    size = 1 if maxval < 256 else 2
    head = struct.pack(">HBBHHHHII", 474, 0, size, 3 if m.shape[2] > 1 else 2, m.shape[1], m.shape[0], m.shape[2], 0, maxval).ljust(512, b"\0")
    return head + np.moveaxis(m[::-1], 2, 0).astype("u1" if size == 1 else ">u2").tobytes()


def fits_decode(raw: bytes, maxval: int = 255) -> Image:
    """FITS of 8, 16 or 32 bits or floats, two or three axes, stretched from the least to the largest value; rows from the bottom."""
    cards, at = {}, 0
    while True:
        card = raw[at : at + 80].decode("ascii", "replace")
        at += 80
        if card.startswith("END"):
            break
        if card[8:9] == "=":
            cards[card[:8].strip()] = card[10:].split("/")[0].strip().strip("'").strip()
    at = -(-at // 2880) * 2880
    kind = np.dtype({"8": "u1", "16": ">i2", "32": ">i4", "-32": ">f4", "-64": ">f8"}[cards["BITPIX"]])
    shape = [int(cards[f"NAXIS{k}"]) for k in range(int(cards["NAXIS"]), 0, -1)]
    m = np.frombuffer(raw, kind, int(np.prod(shape)), at).reshape(shape).astype(float)
    m = m * float(cards.get("BSCALE", 1)) + float(cards.get("BZERO", 0))
    m = m[None] if m.ndim == 2 else m
    low, high = (float(cards.get(n, f)) for n, f in (("DATAMIN", m.min()), ("DATAMAX", m.max())))
    m = np.clip(np.floor((m - low) * (maxval / (high - low) if high > low else 0) + 0.5), 0, maxval)
    return np.moveaxis(m, 0, 2)[::-1].astype(np.int64), maxval


def fits_encode(m: np.ndarray, maxval: int) -> bytes:
    size = 8 if maxval < 256 else 32
    cards = ["SIMPLE  =                    T", f"BITPIX  = {size:20d}", f"NAXIS   = {3 if m.shape[2] > 1 else 2:20d}", f"NAXIS1  = {m.shape[1]:20d}", f"NAXIS2  = {m.shape[0]:20d}"]
    cards += [f"NAXIS3  = {m.shape[2]:20d}"] * (m.shape[2] > 1) + [f"DATAMIN = {0:20d}", f"DATAMAX = {maxval:20d}", "END"]
    head = "".join(c.ljust(80) for c in cards)
    body = np.moveaxis(m[::-1], 2, 0).astype("u1" if size == 8 else ">i4").tobytes()
    return head.ljust(-(-len(head) // 2880) * 2880).encode() + body + bytes(-len(body) % 2880)


def xpm_decode(raw: bytes) -> Image:
    """XPM 3, colours by # or by name."""
    from gridloom.functions.color import parse

    strings = re.findall(r'"((?:[^"\\]|\\.)*)"', raw.decode("latin-1"))
    width, height, n, size = map(int, strings[0].split()[:4])
    table = {}
    for s in strings[1 : n + 1]:
        value = re.search(r"\bc\s+(\S+)", s[size:])[1]
        table[s[:size]] = (0, 0, 0) if value.lower() == "none" else parse(value)
    return np.array([[table[line[k * size : (k + 1) * size]] for k in range(width)] for line in strings[n + 1 : n + 1 + height]], np.int64), 255


def xpm_encode(m: np.ndarray, maxval: int) -> bytes:
    m = _rgb8(m, maxval)
    found = sorted({tuple(map(int, c)) for c in m.reshape(-1, 3)})
    letters = [chr(c) for c in range(35, 127) if chr(c) not in '"\\']
    size = 1
    while len(letters) ** size < len(found):
        size += 1
    name = {c: "".join(letters[k // len(letters) ** p % len(letters)] for p in range(size)) for k, c in enumerate(found)}
    lines = [f"{m.shape[1]} {m.shape[0]} {len(found)} {size}", *(f"{name[c]} c #{c[0]:02X}{c[1]:02X}{c[2]:02X}" for c in found), *("".join(name[tuple(map(int, c))] for c in row) for row in m)]
    return ("/* XPM */\nstatic char *image[] = {\n" + ",\n".join(f'"{s}"' for s in lines) + "\n};\n").encode()


FORMATS: dict[str, tuple[Callable[..., Image] | None, Callable[..., bytes] | None]] = {
    "xbm": (xbm_decode, xbm_encode), "wbmp": (wbmp_decode, wbmp_encode), "ascii": (None, ascii_art), "raw": (raw_decode, raw_encode), "yuv": (yuv_decode, yuv_encode),
    "bmp": (bmp_decode, bmp_encode), "tga": (tga_decode, tga_encode), "pcx": (pcx_decode, pcx_encode), "sun": (sun_decode, sun_encode), "sgi": (sgi_decode, sgi_encode),
    "fits": (fits_decode, fits_encode), "xpm": (xpm_decode, xpm_encode),
}
#: How files of each format begin.
MAGIC = {b"BM": "bmp", b"\x59\xa6\x6a\x95": "sun", b"\x01\xda": "sgi", b"SIMPLE": "fits", b"/* XPM": "xpm", b"#define": "xbm", b"\x0a\x05": "pcx", b"P": "anymap"}

FORMATS |= bitmaps.FORMATS | pictures.FORMATS
MAGIC |= bitmaps.MAGIC | pictures.MAGIC


def sniff(raw: bytes) -> str | None:
    """The format of a file by its first bytes; the longest beginning that fits counts."""
    return next((MAGIC[magic] for magic in sorted(MAGIC, key=len, reverse=True) if raw.startswith(magic)), None)


def decode_all(raw: bytes, format: str | None = None, **options) -> list[Image]:
    """Every image of a file."""
    name = format or sniff(raw)
    if name == "anymap":
        return [(m, h.maxval) for h, m in anymap.decode_all(raw)]
    if name not in FORMATS or not FORMATS[name][0]:
        raise ValueError("no known format")
    got = FORMATS[name][0](raw, **options)
    return got if isinstance(got, list) else [got]


CELLS = "image string, height int, width int, maxval bigint, row bigint, col bigint, s array<bigint>"


#: Cells that leave a task at a time, about.
AT_ONCE = 1 << 16


def decoded(files: DataFrame, format: str | None = None, **options) -> DataFrame:
    """One row for each cell of the files (image, content): CELLS.  The second image of a file is named image#1, and so on.

    Files of bands of an image have the number of their first line in a column top; rows are then the image's.
    """
    kinds = pa.schema([("image", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("maxval", pa.int64()), ("row", pa.int64()), ("col", pa.int64()), ("s", pa.list_(pa.int64()))])

    def cells(name: str, top: int, m: np.ndarray, maxval: int) -> Iterator[pa.RecordBatch]:
        height, width, depth = m.shape
        step = max(1, AT_ONCE // max(1, width))
        for first in range(0, height, step):
            part = np.ascontiguousarray(m[first : first + step], np.int64)
            row, col = np.indices(part.shape[:2])
            n = row.size
            s = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * depth, pa.int32()), pa.array(part.ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * n, pa.string()), pa.array(np.full(n, height), pa.int32()), pa.array(np.full(n, width), pa.int32()), pa.array(np.full(n, maxval), pa.int64()), pa.array(row.ravel() + first + top, pa.int64()), pa.array(col.ravel(), pa.int64()), s],
                schema=kinds,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, top, raw in zip(*(batch.column(k) for k in range(3)), strict=True):
                try:
                    found = decode_all(raw.as_py(), format, **options)
                except ValueError as e:
                    raise ValueError(f"{p}: {e}") from e
                for k, (m, maxval) in enumerate(found):
                    yield from cells(f"{p}#{k}" if k else str(p), top.as_py(), m, maxval)

    top = F.col("top").cast("bigint") if "top" in files.columns else F.lit(0).cast("bigint")
    return files.select("image", top.alias("top"), "content").mapInArrow(run, CELLS)


def read(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """One row for each cell of every image of the files: CELLS.  Without a format each file is read as its first bytes say."""
    return decoded(spark.read.format("binaryFile").load(path).withColumnRenamed("path", "image"), format, **options)


def band_rows(r: Raster) -> int:
    """Lines of a file that holds a band of an image: some FILE_CELLS samples, and few enough for the sizes that formats can name."""
    return min(MOST_ROWS, max(1, FILE_CELLS // max(1, r.width * r.depth) // WHOLE_ROWS) * WHOLE_ROWS)


#: Samples of a band's file; lines of one are a multiple of the blocks that formats cut images into, and at most what the narrowest size field holds (4,095).
FILE_CELLS, WHOLE_ROWS, MOST_ROWS = 1 << 18, 192, 4032


def encoded(r: Raster, format: str, rows: int | None = None, **options) -> DataFrame:
    """image and the bytes of its file in a format.  With rows, images of more lines are several files, by bands with their first lines in a column top."""
    encoder = FORMATS[format][1]
    files = anymap.gathered(r, lambda m, maxval: encoder(m, maxval, **options), rows)
    return files if rows else files.drop("top")
