"""Bitmap file formats of window systems, home computers, printers and plotters.

Decoders give (samples, 1) with 1 for white, encoders take such samples.  Where a printer
or terminal only takes images there is no decoder.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable

import numpy as np

Image = tuple[np.ndarray, int]


def unpack(raw: bytes, height: int, width: int, line: int, low_first: bool = False, set_is_white: bool = False) -> np.ndarray:
    """Samples from packed lines of ``line`` bytes; set bits are black unless set_is_white."""
    packed = np.frombuffer(raw[: line * height], np.uint8)
    if len(packed) < line * height:
        raise ValueError("the raster ends early")
    bits = np.unpackbits(packed.reshape(height, line), axis=1, bitorder="little" if low_first else "big")[:, :width, None].astype(np.int64)
    return bits if set_is_white else 1 - bits


def pack(m: np.ndarray, multiple: int = 1, low_first: bool = False, set_is_white: bool = False, fill: int = 0) -> bytes:
    """Packed lines, each filled up to a multiple of so many bytes."""
    bits = m[:, :, 0] if set_is_white else 1 - m[:, :, 0]
    full = np.full((len(bits), -(-bits.shape[1] // (8 * multiple)) * multiple * 8), fill, np.uint8)
    full[:, : bits.shape[1]] = bits
    return np.packbits(full, axis=1, bitorder="little" if low_first else "big").tobytes()


def unpack_runs(raw: bytes, size: int, at: int = 0, literal: int = 128) -> tuple[bytes, int]:
    """Run-length code of counts: below ``literal`` n + 1 bytes as they are, else 257 - n times the next one.  The bytes and where they end."""
    out = bytearray()
    while len(out) < size:
        n = raw[at]
        if n < literal:
            out += raw[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += raw[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out[:size]), at


def pack_runs(raw: bytes) -> bytes:
    """What unpack_runs reads: runs of three bytes and more, others as they are."""
    out, at, plain = bytearray(), 0, 0

    def flush(to: int) -> None:
        for k in range(plain, to, 128):
            part = raw[k : min(to, k + 128)]
            out.extend([len(part) - 1, *part])

    while at < len(raw):
        n = 1
        while n < 128 and at + n < len(raw) and raw[at + n] == raw[at]:
            n += 1
        if n >= 3:
            flush(at)
            out.extend([257 - n, raw[at]])
            plain = at + n
        at += n
    flush(len(raw))
    return bytes(out)


# ---- window systems


def cmuwm_decode(raw: bytes) -> Image:
    """Bitmap of the Andrew window manager; set bits are white."""
    magic, width, height, depth = struct.unpack_from(">IIIH", raw)
    if magic != 0xF10040BB or depth != 1:
        raise ValueError("no window manager bitmap of one bit")
    return unpack(raw[14:], height, width, -(-width // 8), set_is_white=True), 1


def cmuwm_encode(m: np.ndarray, maxval: int) -> bytes:
    return struct.pack(">IIIH", 0xF10040BB, m.shape[1], m.shape[0], 1) + pack(m, set_is_white=True)


def mgr_decode(raw: bytes) -> Image:
    """Bitmap of the MGR window manager, old and new kinds of one bit."""
    pad = {b"yz": 8, b"xz": 32, b"zz": 16}.get(raw[:2])
    if not pad:
        raise ValueError("no MGR bitmap of one bit")
    width, height = ((raw[k] - 32 << 6) + raw[k + 1] - 32 for k in (2, 4))
    new = raw[:2] == b"yz"
    if new and raw[6] - 32 != 1:
        raise ValueError("more than one bit")
    return unpack(raw[8 if new else 6 :], height, width, -(-width // pad) * pad // 8), 1


def mgr_encode(m: np.ndarray, maxval: int) -> bytes:
    height, width = m.shape[:2]
    size = [(width >> 6 & 63) + 32, (width & 63) + 32, (height >> 6 & 63) + 32, (height & 63) + 32]
    return b"yz" + bytes([*size, 33, 32]) + pack(m)


def icon_decode(raw: bytes) -> Image:
    """Sun icon: a comment with the size, then words of 16 bits as C source."""
    head, _, body = raw.decode("latin-1").partition("*/")
    value = {k: int(v) for k, v in re.findall(r"(\w+)\s*=\s*(\d+)", head)}
    if value.get("Depth", 1) != 1 or value.get("Valid_bits_per_item", 16) != 16:
        raise ValueError("one bit and words of 16 only")
    width, height = value["Width"], value["Height"]
    words = [int(w, 16) for w in re.findall(r"0[xX]([0-9a-fA-F]{1,4})", body)]
    return unpack(struct.pack(f">{len(words)}H", *words), height, width, -(-width // 16) * 2), 1


def icon_encode(m: np.ndarray, maxval: int) -> bytes:
    """Lines filled up to whole words, half of the filling on the left."""
    height, width = m.shape[:2]
    pad = -width % 16
    m = np.pad(m, ((0, 0), (pad // 2, pad - pad // 2), (0, 0)), constant_values=1)
    words = np.frombuffer(pack(m), ">u2").tolist()
    lines = ["\t" + ",".join(f"0x{w:04x}" for w in words[k : k + 8]) for k in range(0, len(words), 8)]
    head = f"/* Format_version=1, Width={width + pad}, Height={height}, Depth=1, Valid_bits_per_item=16\n */\n"
    return (head + ",\n".join(lines) + "\n").encode()


def ybm_decode(raw: bytes) -> Image:
    """Bitmap of the Bennet Yee "face" program: words whose first byte is the low one, from their lowest bit."""
    if raw[:2] != b"!!":
        raise ValueError("no face bitmap")
    width, height = struct.unpack_from(">HH", raw, 2)
    return unpack(raw[6:], height, width, -(-width // 16) * 2, low_first=True), 1


def ybm_encode(m: np.ndarray, maxval: int) -> bytes:
    """Words from their lowest bit, their high byte first, as the face program itself has them."""
    words = np.frombuffer(pack(m, 2, low_first=True), "<u2").astype(">u2").tobytes()
    return b"!!" + struct.pack(">HH", m.shape[1], m.shape[0]) + words


def x10bm_encode(m: np.ndarray, maxval: int, name: str = "noname") -> bytes:
    """C source of an X10 bitmap: words of 16 bits from their lowest."""
    words = np.frombuffer(pack(m, 2, low_first=True), "<u2").tolist()
    lines = [" " + ",".join(f"0x{w:04x}" for w in words[k : k + 11]) for k in range(0, len(words), 11)]
    return (f"#define {name}_width {m.shape[1]}\n#define {name}_height {m.shape[0]}\nstatic short {name}_bits[] = {{\n" + ",\n".join(lines) + "};\n").encode()


def zinc_encode(m: np.ndarray, maxval: int, name: str = "noname") -> bytes:
    """C source of a Zinc bitmap: words as for X10, their hexadecimal digits from the lowest."""
    words = np.frombuffer(pack(m, 2, low_first=True), "<u2").tolist()
    lines = [" " + ",".join(f"0x{f'{w:04x}'[::-1]}" for w in words[k : k + 11]) for k in range(0, len(words), 11)]
    return (f"USHORT {name}[] = {{\n  {m.shape[1]}\n  {m.shape[0]}\n" + ",\n".join(lines) + "};\n").encode()


def brush_decode(raw: bytes) -> Image:
    """Doodle brush: 16 bytes of header, lines of whole words, set bits are white."""
    if raw[:2] != b"\1\0":
        raise ValueError("no brush")
    width, height = struct.unpack_from(">HH", raw, 2)
    return unpack(raw[16:], height, width, -(-width // 16) * 2, set_is_white=True), 1


def atk_decode(raw: bytes) -> Image:
    """Andrew toolkit raster: letters for runs of white and black bytes, hexadecimal digits for others."""
    found = re.search(rb"bits\s+\d+\s+(\d+)\s+(\d+)\s", raw)
    width, height = int(found[1]), int(found[2])
    line, at, out = -(-width // 8), found.end(), bytearray()
    for _ in range(height):
        row, repeat, digits = bytearray(), 1, ""
        while at < len(raw):
            c, at = raw[at], at + 1
            if c == ord("|") or c == ord("\\"):
                at -= c == ord("\\")
                break
            if 0x21 <= c <= 0x2F:
                repeat = c - 0x1F
            elif chr(c) in "0123456789abcdefABCDEF":
                digits += chr(c)
                if len(digits) == 2:
                    row += bytes([int(digits, 16)]) * repeat
                    repeat, digits = 1, ""
            elif ord("g") <= c <= ord("z"):
                row += b"\0" * (c - ord("f"))
            elif ord("G") <= c <= ord("Z"):
                row += b"\xff" * (c - ord("F"))
        out += bytes(row[:line]).ljust(line, b"\0")
    return unpack(bytes(out), height, width, line), 1


def atk_encode(m: np.ndarray, maxval: int) -> bytes:
    height, width = m.shape[:2]
    out = [f"\\begindata{{raster,1}}\n2 0 65536 65536 0 0 {width} {height}\nbits 1 {width} {height}\n"]

    def run(b: int, n: int) -> str:
        if b in (0, 255):
            first, most = ("f", "z") if b == 0 else ("F", "Z")
            return most * ((n - 1) // 20) + chr(ord(first) + (n - 1) % 20 + 1)
        full, rest = divmod(n - 1, 16)
        rest += 1
        return ("/" + f"{b:02x}") * full + (chr(0x1F + rest) if rest > 1 else "") + f"{b:02x}"

    for row in np.frombuffer(pack(m), np.uint8).reshape(height, -1):
        cuts = [0, *(np.flatnonzero(np.diff(row.astype(int))) + 1).tolist(), len(row)]
        out.append("".join(run(int(row[a]), b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)) + " |\n")
    return ("".join(out) + "\\enddata{raster, 1}\n").encode()


# ---- home computers


def pi3_decode(raw: bytes) -> Image:
    """Atari Degas of 640 x 400; the first palette entry says what a clear bit is."""
    kind, first = struct.unpack_from(">HH", raw)
    if kind != 2:
        raise ValueError("no Degas file of two colours")
    return unpack(raw[34:], 400, 640, 80, set_is_white=first == 0), 1


def pi3_encode(m: np.ndarray, maxval: int) -> bytes:
    """Cut or filled up to 640 x 400."""
    full = np.ones((400, 640, 1), np.int64)
    m = m[:400, :640]
    full[: m.shape[0], : m.shape[1]] = m
    return struct.pack(">HH", 2, 0x777) + bytes(30) + pack(full)


def macp_decode(raw: bytes, skip: int = 0) -> Image:
    """MacPaint: a header of 512 bytes, then 720 lines of 72 bytes, run-length coded as one."""
    body, _ = unpack_runs(raw, 720 * 72, 512 + skip)
    return unpack(body, 720, 576, 72), 1


def macp_encode(m: np.ndarray, maxval: int) -> bytes:
    """Cut or filled up to 576 x 720, line by line."""
    full = np.ones((720, 576, 1), np.int64)
    m = m[:720, :576]
    full[: m.shape[0], : m.shape[1]] = m
    packed = pack(full)
    return b"\0\0\0\2" + bytes(508) + b"".join(pack_runs(packed[k : k + 72]) for k in range(0, len(packed), 72))


def mda_decode(raw: bytes, invert: bool = False) -> Image:
    """MicroDesign area, kinds 2 and 3."""
    if raw[:4] not in (b".MDA", b".MDP"):
        raise ValueError("no MicroDesign file")
    (height, line), at = struct.unpack_from("<HH", raw, 128), 132
    if raw[21:22] == b"0":
        body = bytearray()
        while len(body) < height * line:
            b, at = raw[at], at + 1
            n = 1
            if b in (0, 255):
                n, at = raw[at] or 256, at + 1
            body += bytes([b]) * n
    else:
        row, body = np.zeros(line, np.uint8), bytearray()
        for _ in range(height):
            kind, at = raw[at], at + 1
            if kind == 0:
                row, at = np.full(line, raw[at], np.uint8), at + 1
            elif kind in (1, 2):
                own, at = unpack_runs(raw, line, at, 129)
                own = np.frombuffer(own, np.uint8)
                row = own.copy() if kind == 1 else row ^ own
            body += row.tobytes()
    return unpack(bytes(body), height, line * 8, line, set_is_white=not invert), 1


def mda_encode(m: np.ndarray, maxval: int) -> bytes:
    """Kind 2: whole bytes of the width only, the height filled up to a multiple of four with white."""
    height, line = -(-m.shape[0] // 4) * 4, m.shape[1] // 8
    m = np.pad(m[:, : line * 8], ((0, height - m.shape[0]), (0, 0), (0, 0)), constant_values=0)
    head = b".MDAMicroDesignPCWv1.00\r\npbm2mda\r\n".ljust(128, b"\0") + struct.pack("<HH", height, line)
    out = bytearray()
    for row in np.frombuffer(pack(m, set_is_white=True), np.uint8).reshape(height, line).tolist():
        k = 0
        while k < line:
            b, n = row[k], 1
            if b in (0, 255):
                while n < 256 and k + n < line and row[k + n] == b:
                    n += 1
                out += bytes([b, n & 255])
            else:
                out.append(b)
            k += n
    return head + bytes(out)


def _corner(bits: list[int], image: np.ndarray, y: int, x: int, size: int) -> None:
    part = image[y : y + size, x : x + size]
    total = int(part.sum())
    if total in (0, size * size):
        bits += [1] * (size != 1) + [int(total > 0)]
        return
    bits.append(0)
    half = size // 2
    for a, b in ((0, 0), (0, half), (half, 0), (half, half)):
        _corner(bits, image, y + a, x + b, half)


def mrf_encode(m: np.ndarray, maxval: int) -> bytes:
    """Monochrome recursive format: squares of 64 cells, halved until they are of one colour; cells beyond an edge are white if most of that edge is."""
    height, width = m.shape[:2]
    full = np.zeros((-(-height // 64) * 64, -(-width // 64) * 64), np.int64)
    full[:height, :width] = m[:, :, 0]
    right, bottom = (width % 64 and 2 * full[:height, width - 1].sum() > height), (height % 64 and 2 * full[height - 1, :width].sum() > width)
    if right:
        full[:height, width:] = 1
    if bottom:
        full[height:, :width] = 1
    if right and bottom:
        full[height:, width:] = 1
    bits: list[int] = []
    for y in range(0, len(full), 64):
        for x in range(0, full.shape[1], 64):
            _corner(bits, full, y, x, 64)
    return b"MRF1" + struct.pack(">II", width, height) + b"\0" + np.packbits(np.array(bits, np.uint8)).tobytes()


def mrf_decode(raw: bytes) -> Image:
    if raw[:4] != b"MRF1" or raw[12]:
        raise ValueError("no file of this format")
    width, height = struct.unpack_from(">II", raw, 4)
    full = np.zeros((-(-height // 64) * 64, -(-width // 64) * 64), np.int64)
    bits, at = np.unpackbits(np.frombuffer(raw, np.uint8, offset=13)).tolist(), 0
    for y0 in range(0, len(full), 64):
        for x0 in range(0, full.shape[1], 64):
            todo = [(y0, x0, 64)]
            while todo:
                y, x, size = todo.pop()
                whole = size == 1
                if not whole:
                    whole, at = bits[at], at + 1
                if whole:
                    full[y : y + size, x : x + size], at = bits[at], at + 1
                else:
                    half = size // 2
                    todo += [(y + a, x + b, half) for a, b in ((half, half), (half, 0), (0, half), (0, 0))]
    return full[:height, :width, None], 1


# ---- fax

#: Codes of runs in ITU-T T.4, white and black, for 0 to 63 and then for 64, 128, ... 1728.
WHITE_CODES = """00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101
101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010
00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010
00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100
11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101
011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011""".split()
BLACK_CODES = """0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000
0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001
000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111
000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111
0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 0000001110100
0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101""".split()
#: Codes for 1792, 1856, ... 2560, for both colours, and the end of a line.
LONG_CODES = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111".split()
END_OF_LINE = "000000000001"


def _run_of(k: int) -> int:
    return k if k < 64 else 64 * (k - 63)


def _fax_codes(black: int) -> list[str]:
    return (BLACK_CODES if black else WHITE_CODES) + LONG_CODES


def g3_encode(m: np.ndarray, maxval: int) -> bytes:
    """Fax group 3, one-dimensional: an end-of-line code before each line, six behind the last."""
    bits = []
    for row in 1 - m[:, :, 0]:
        bits.append(END_OF_LINE)
        cuts = [0, *(np.flatnonzero(np.diff(row)) + 1).tolist(), len(row)]
        colour = 0
        if len(row) and row[0]:
            bits.append(WHITE_CODES[0])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            colour, n, codes = int(row[a]), b - a, _fax_codes(int(row[a]))
            while n >= 2560 + 64:
                bits.append(codes[-1])
                n -= 2560
            if n >= 64:
                bits.append(codes[63 + n // 64])
                n %= 64
            bits.append(codes[n])
    text = "".join(bits) + END_OF_LINE * 6
    return np.packbits(np.frombuffer(text.encode(), np.uint8) - 48).tobytes()


def g3_decode(raw: bytes, width: int | None = None) -> Image:
    """Lines of one-dimensional group 3 fax; all are as wide as the widest, or as width says."""
    text = "".join(f"{b:08b}" for b in raw)
    table = [{c: _run_of(k) for k, c in enumerate(_fax_codes(b))} for b in (0, 1)]
    rows, at = [], text.find(END_OF_LINE)
    while at >= 0:
        at += len(END_OF_LINE)
        row, black, total = [], 0, 0
        while at < len(text):
            end = text.find("1", at)
            if end < 0 or end - at >= 11:
                break
            n = next((k for k in range(2, 14) if text[at : at + k] in table[black]), None)
            if n is None:
                break  # a damaged line ends here
            run, at = table[black][text[at : at + n]], at + n
            total += run
            if run < 64:
                row += [black] * total
                black, total = 1 - black, 0
        if not row:
            break  # two ends of line: no more
        rows.append(row)
        at = text.find(END_OF_LINE, at)
    width = width or max(map(len, rows), default=0)
    out = np.ones((len(rows), width, 1), np.int64)
    for k, row in enumerate(rows):
        out[k, : min(width, len(row)), 0] -= np.array(row[:width], np.int64)
    return out, 1


# ---- printers, plotters and terminals


def ptx_encode(m: np.ndarray, maxval: int) -> bytes:
    """Printronix: six cells a character, the lowest bit first."""
    bits = np.pad(1 - m[:, :, 0], ((0, 0), (0, -m.shape[1] % 6)))
    items = 64 + (bits.reshape(len(bits), -1, 6) << np.arange(6)).sum(axis=2)
    return b"".join(bytes(row.tolist()) + b"\5\n" for row in items)


def plot_encode(m: np.ndarray, maxval: int) -> bytes:
    """Unix plot file: a point or a horizontal line for each run of black cells."""
    height, width = m.shape[:2]
    two = lambda *v: struct.pack(f"<{len(v)}H", *v)
    out = [b"s" + two(0, 0, height - 1, width - 1)]
    for r, row in enumerate(1 - m[:, :, 0]):
        edge = np.diff(row, prepend=0, append=0)
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True):
            out.append(b"p" + two(b, height - 1 - r) if a == b else b"l" + two(a, height - 1 - r, b, height - 1 - r))
    return b"".join(out)


def matrixorbital_encode(m: np.ndarray, maxval: int) -> bytes:
    """Matrix Orbital display: columns of bytes, the uppermost cell in the lowest bit."""
    height, width = m.shape[:2]
    if height > 255 or width > 255:
        raise ValueError("at most 255 cells each way")
    return bytes([width, height]) + pack(np.swapaxes(m, 0, 1), low_first=True)


def djvurle_encode(m: np.ndarray, maxval: int) -> bytes:
    """DjVu bitmap: runs of each line, white first; one byte below 192, else two."""
    out = bytearray(f"R4\n{m.shape[1]} {m.shape[0]}\n".encode())
    for row in 1 - m[:, :, 0]:
        cuts = [0, *(np.flatnonzero(np.diff(row)) + 1).tolist(), len(row)]
        runs = [0] * int(row[0]) + [b - a for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for n in runs:
            while True:
                if n < 192:
                    out.append(n)
                    break
                out += bytes([(n >> 8 & 0x3F) + 0xC0, n & 0xFF])
                n >>= 14
                if not n:
                    break
                out.append(0)
    return bytes(out)


def bbnbg_encode(m: np.ndarray, maxval: int, op: int = 3) -> bytes:
    """BBN BitGraph terminal: words of 16 cells as signed numbers of up to three characters."""
    out, used = [f"\033P:{op};{m.shape[1]};{m.shape[0]}s\n"], 0
    for word in np.frombuffer(pack(m, 2), ">u2").tolist():
        if used > 75:
            out.append("\n")
            used = 0
        sign = "0"
        if word > 0x7FFF:
            word, sign = 0x10000 - word, " "
        high, mid, low = chr((word >> 10) + 64), chr((word >> 4 & 63) + 64), chr((word & 15) + ord(sign))
        text = high + mid + low if high != "@" else mid + low if mid != "@" else low
        out.append(text)
        used += len(text)
    return ("".join(out) + "\033\\\n").encode("latin-1")


def escp2_encode(m: np.ndarray, maxval: int, resolution: int = 360) -> bytes:
    """Epson ESC/P2 printer: bands of 24 lines, run-length coded."""
    height, width = m.shape[:2]
    step, line = 3600 // resolution, -(-width // 8)
    raw, out = pack(m), [b"\033(G\1\0\1", bytes([27, ord("+"), 24 * step // 10])]
    for row in range(0, height, 24):
        n = min(24, height - row)
        out.append(bytes([27, ord("."), 1, step, step, n, width % 256, width // 256]) + pack_runs(raw[row * line : (row + n) * line]))
        if height - row >= 24:
            out.append(b"\n")
    return b"".join(out) + b"\033@"


def escp2_decode(raw: bytes) -> Image:
    """The bands of an ESC/P2 file, plain or run-length coded, one below the other."""
    at, out, width, height = 0, [], 0, 0
    while 0 <= (at := raw.find(b"\033.", at)):
        kind, n, width = raw[at + 2], raw[at + 5], raw[at + 6] + 256 * raw[at + 7]
        size = n * -(-width // 8)
        if kind > 1:
            raise ValueError("another compression")
        body, at = (raw[at + 8 : at + 8 + size], at + 8 + size) if kind == 0 else unpack_runs(raw, size, at + 8)
        out.append(body)
        height += n
    return unpack(b"".join(out), height, width, -(-width // 8)), 1


def _stripe(bits: np.ndarray) -> bytes:
    """Eight lines as one byte a column, the uppermost in the highest bit, up to the last column with ink."""
    full = np.zeros((8, bits.shape[1]), np.uint8)
    full[: len(bits)] = bits
    return np.packbits(full, axis=0)[0].tobytes().rstrip(b"\0")


def epson_encode(m: np.ndarray, maxval: int, mode: int = 5) -> bytes:
    """Epson printer of nine pins: stripes of eight lines."""
    out = [b"\033A\x08"]
    for row in range(0, m.shape[0], 8):
        if own := _stripe(1 - m[row : row + 8, :, 0]):
            out.append(bytes([27, ord("*"), mode, len(own) % 256, len(own) // 256]) + own)
        out.append(b"\n")
    return b"".join(out) + b"\f\033@"


def gemini10x_encode(m: np.ndarray, maxval: int, high: bool = False) -> bytes:
    """Gemini 10X printer: stripes of eight lines, or of sixteen in two passes."""
    head, out = (b"\0333\1", []) if high else (b"\033A\x08", [])
    for row in range(0, m.shape[0], 16 if high else 8):
        bits = 1 - m[row : row + (16 if high else 8), :, 0]
        for part in (bits[::2], bits[1::2]) if high else (bits,):
            own = _stripe(part)
            out.append((b"\033" + (b"L" if high else b"K") + bytes([len(own) % 256, len(own) // 256]) + own if own else b"") + b"\n")
        if high:
            out.append(b"\033J\x0e")
    return head + b"".join(out) + b"\033@"


def lps_encode(m: np.ndarray, maxval: int, dpi: float = 300.0, name: str = "noname") -> bytes:
    """PostScript that draws every run of black as a line."""
    height, width = m.shape[:2]
    high, wide = height / dpi * 72, width / dpi * 72
    out = [
        "%!PS-Adobe-2.0 EPSF-2.0", f"%%Title: {name}", f"%%BoundingBox: {int(305.5 - wide / 2)} {int(395.5 - high / 2)} {int(306.5 + wide / 2)} {int(396.5 + high / 2)}",
        "%%EndComments", "%%EndProlog", "gsave", f"{306 - wide / 2:f} {396 + high / 2:f} translate", f"72 {dpi:f} div dup neg scale",
        "/a { 0 rmoveto 0 rlineto } def", "/b { 0 row 1 add dup /row exch def moveto } def", "/m { currentpoint stroke newpath moveto a } def", "/row 0 def", "newpath 0 0 moveto",
    ]
    points = 2
    for row in 1 - m[:, :, 0]:
        edge, at, line = np.diff(row, prepend=0, append=0), 0, []
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            points += 2
            line.append(f"{b - a} {a - at} {'a' if points <= 1000 else 'm'}")
            points = points if points <= 1000 else 2
            at = b
        out.append(" ".join([*line, "b"]))
    return ("\n".join([*out, "stroke grestore showpage", "%%Trailer"]) + "\n").encode()


FORMATS: dict[str, tuple[Callable[..., Image] | None, Callable[..., bytes] | None]] = {
    "cmuwm": (cmuwm_decode, cmuwm_encode), "mgr": (mgr_decode, mgr_encode), "icon": (icon_decode, icon_encode), "ybm": (ybm_decode, ybm_encode), "x10bm": (None, x10bm_encode),
    "zinc": (None, zinc_encode), "brush": (brush_decode, None), "atk": (atk_decode, atk_encode), "pi3": (pi3_decode, pi3_encode), "macp": (macp_decode, macp_encode), "mda": (mda_decode, mda_encode),
    "mrf": (mrf_decode, mrf_encode), "g3": (g3_decode, g3_encode), "ptx": (None, ptx_encode), "plot": (None, plot_encode), "matrixorbital": (None, matrixorbital_encode),
    "djvurle": (None, djvurle_encode), "bbnbg": (None, bbnbg_encode), "escp2": (escp2_decode, escp2_encode), "epson": (None, epson_encode), "10x": (None, gemini10x_encode), "lps": (None, lps_encode),
}
#: How files of each format begin.
MAGIC = {b"\xf1\x00\x40\xbb": "cmuwm", b"yz": "mgr", b"!!": "ybm", b"\\begindata{raster": "atk", b".MD": "mda", b"MRF1": "mrf", b"/* Format_version": "icon"}
