"""File formats: exact round trips, hand-made files, and drawing by cells."""

import struct

import numpy as np
import pytest

from gridloom.operators import draw, generate
from gridloom.sources import formats


@pytest.mark.parametrize("name, planes, maxval", [("xbm", 1, 1), ("wbmp", 1, 1), ("bmp", 3, 255), ("tga", 3, 255), ("pcx", 3, 255), ("sun", 3, 255), ("sgi", 3, 255), ("sgi", 1, 65535), ("fits", 1, 255), ("fits", 3, 255), ("xpm", 3, 255)])
@pytest.mark.parametrize("height, width", [(1, 1), (5, 11), (9, 200)])
def test_round_trip(name, planes, maxval, height, width):
    m = np.random.default_rng(height).integers(0, maxval + 1, (height, width, planes))
    decode, encode = formats.FORMATS[name]
    got, top = decode(encode(m, maxval))
    assert top == maxval and (got == m).all()
    if name in ("bmp", "sun", "sgi", "fits", "xpm", "xbm", "pcx"):
        assert formats.sniff(encode(m, maxval)) == name


@pytest.mark.parametrize("order", ["pixel", "plane", "bottomup"])
def test_raw(order):
    m = np.random.default_rng(0).integers(0, 256, (4, 6, 3))
    got, _ = formats.raw_decode(formats.raw_encode(m, 255, order), 4, 6, 3, order)
    assert (got == m).all()
    with pytest.raises(ValueError):
        formats.raw_decode(b"123", 2, 2)


def test_yuv_is_near():
    m = np.repeat(np.random.default_rng(0).integers(0, 256, (4, 3, 3)), 2, axis=1)
    got, _ = formats.yuv_decode(formats.yuv_encode(m, 255), 4, 6)
    assert abs(got - m).max() <= 3


def test_mapped_and_packed_files():
    rle = struct.pack("<BBBHHBHHHHBB", 0, 1, 9, 0, 2, 24, 0, 0, 3, 2, 8, 0x20) + bytes([1, 2, 3, 4, 5, 6]) + bytes([0x82, 1, 0x02, 0, 1, 0])
    assert formats.tga_decode(rle)[0].tolist() == [[[6, 5, 4]] * 3, [[3, 2, 1], [6, 5, 4], [3, 2, 1]]]
    bits = b"BM" + struct.pack("<IHHI", 66, 0, 0, 62) + struct.pack("<IiiHHIIiiII", 40, 3, 2, 1, 1, 0, 8, 0, 0, 2, 0) + bytes([9, 8, 7, 0, 3, 2, 1, 0]) + bytes([0b10100000, 0, 0, 0, 0b01000000, 0, 0, 0])
    assert formats.bmp_decode(bits)[0].tolist() == [[[7, 8, 9], [1, 2, 3], [7, 8, 9]], [[1, 2, 3], [7, 8, 9], [1, 2, 3]]]
    sun = struct.pack(">8I", 0x59A66A95, 4, 1, 8, 4, 2, 0, 0) + bytes([0x80, 2, 5, 0x80, 0])
    assert formats.sun_decode(sun)[0].ravel().tolist() == [5, 5, 5, 128]
    with pytest.raises(ValueError):
        formats.bmp_decode(b"no")


def test_ascii():
    assert formats.ascii_art(np.array([[[0], [1], [0]], [[0], [0], [1]], [[1], [1], [1]]]), 1).splitlines() == [b'$o"', b""]


def test_read_and_write_through_spark(spark, tmp_path):
    r = generate.constant(spark, 2, 3, (1, 2, 3))
    raw = bytes(formats.encoded(r, "bmp").collect()[0]["content"])
    (tmp_path / "a.bmp").write_bytes(raw)
    (tmp_path / "b.sgi").write_bytes(formats.sgi_encode(np.full((1, 1, 1), 9), 255))
    (tmp_path / "c.pgm").write_bytes(b"P5\n1 1\n255\n\x07")
    got = formats.read(spark, str(tmp_path)).collect()
    assert len(got) == 8 and {tuple(x["s"]) for x in got} == {(1, 2, 3), (9,), (7,)}


def test_shapes():
    assert draw.line((0, 0), (2, 4)) == [(0, 0), (1, 1), (1, 2), (2, 3), (2, 4)] and draw.line((1, 1), (1, 1)) == [(1, 1)]
    ring = draw.circle((0, 0), 5)
    assert all(abs((r * r + c * c) ** 0.5 - 5) < 0.75 for r, c in ring) and len(set(ring)) == len(ring)
    assert set(draw.polygon([(0, 0), (0, 4), (4, 4), (4, 0)])) == set(draw.rectangle(0, 0, 5, 5))
    curve = draw.spline([(0, 0), (5, 10), (10, 0)])
    assert curve[0] == (0, 0) and curve[-1] == (10, 0) and all(max(abs(a - c), abs(b - d)) <= 1 for (a, b), (c, d) in zip(curve, curve[1:], strict=False))
    assert len(draw.text("I", 0, 0)) == 9 and draw.text("~") == []


def test_drawing(spark):
    r = draw.label(generate.bitmap(spark, 7, 12, "white"), "hi", 1, 1, (0,))
    black = {(x["row"], x["col"]) for x in r.px.collect() if x["s"] == [0]}
    assert black == set(draw.text("HI", 1, 1))
    assert draw.draw(r, [(100, 100)], (0,)).px.count() == 84


def one(got):
    return (got[0] if isinstance(got, list) else got)[0]


def bit_image(height, width, seed=0):
    m = np.random.default_rng(seed).integers(0, 2, (height, width, 1))
    m[:, width // 2 :] = m[:1, width // 2 : width // 2 + 1]  # some long runs
    return m


@pytest.mark.parametrize("name", ["cmuwm", "mgr", "atk", "mrf", "g3", "escp2"])
@pytest.mark.parametrize("height, width", [(1, 1), (5, 11), (70, 130), (9, 2700)])
def test_bitmaps_round_trip(name, height, width):
    decode, encode = formats.FORMATS[name]
    for m in (bit_image(height, width), np.ones((height, width, 1), np.int64), np.zeros((height, width, 1), np.int64)):
        assert (one(decode(encode(m, 1))) == m).all()


def test_bitmaps_of_fixed_sizes():
    m = bit_image(9, 30)
    for name, height, width in (("pi3", 400, 640), ("macp", 720, 576)):
        decode, encode = formats.FORMATS[name]
        got = one(decode(encode(m, 1)))
        assert got.shape == (height, width, 1) and (got[:9, :30] == m).all() and got[9:].all() and got[:, 30:].all()
    got = one(formats.FORMATS["icon"][0](formats.FORMATS["icon"][1](m, 1)))
    assert got.shape == (9, 32, 1) and (got[:, 1:31] == m).all()
    got = one(formats.FORMATS["mda"][0](formats.FORMATS["mda"][1](m, 1)))
    assert got.shape == (12, 24, 1) and (got[:9] == m[:, :24]).all() and not got[9:].any()


def test_bitmaps_by_hand():
    m = np.array([[[0], [1], [0], [0], [1], [1], [1], [1], [1]], [[1]] * 9])  # .x..xxxxx of white
    enc = lambda name, *a: formats.FORMATS[name][1](m, 1, *a)
    assert enc("ptx") == bytes([64 + 0b001101, 64]) + b"\5\n" + bytes([64, 64]) + b"\5\n"
    assert enc("plot") == b"s" + bytes([0, 0, 0, 0, 1, 0, 8, 0]) + b"p" + bytes([0, 0, 1, 0]) + b"l" + bytes([2, 0, 1, 0, 3, 0, 1, 0])
    assert enc("matrixorbital") == bytes([9, 2, 1, 0, 1, 1, 0, 0, 0, 0, 0])
    assert enc("djvurle") == b"R4\n9 2\n" + bytes([0, 1, 1, 2, 5, 9])
    assert enc("zinc").splitlines()[3] == b" 0xd000,0x0000};" and enc("x10bm").splitlines()[3] == b" 0x000d,0x0000};"
    assert enc("ybm") == b"!!" + bytes([0, 9, 0, 2, 0, 0x0D, 0, 0])
    assert formats.FORMATS["ybm"][0](b"!!" + bytes([0, 9, 0, 2, 0x0D, 0, 0, 0]))[0].tolist() == m.tolist()
    assert enc("epson") == b"\x1bA\x08\x1b*\x05\x04\x00" + bytes([0x80, 0, 0x80, 0x80]) + b"\n\x0c\x1b@"
    assert enc("10x") == b"\x1bA\x08\x1bK\x04\x00" + bytes([0x80, 0, 0x80, 0x80]) + b"\n\x1b@"
    assert enc("bbnbg") == b"\x1bP:3;9;2s\nT@ 0\x1b\\\n"  # -0x5000, 0
    assert b"1 0 a 2 1 a b\nb\n" in enc("lps")
    brush = b"\1\0" + bytes([0, 9, 0, 1]) + bytes(10) + bytes([0b01001111, 0x80])
    assert formats.FORMATS["brush"][0](brush)[0].tolist() == m[:1].tolist()
    # two lines of a fax: white 1, black 2, white 3; a made-up long run of 64 + 1
    line = "000000000001" + "000111" + "11" + "1000" + "000000000001" + "11011" + "000111"
    raw = np.packbits(np.array([int(c) for c in line.ljust(-(-len(line) // 8) * 8, "0")], np.uint8)).tobytes()
    got = formats.FORMATS["g3"][0](raw, 6)[0]
    assert got[:, :, 0].tolist() == [[1, 0, 0, 1, 1, 1], [1] * 6]


def test_fax_codes_are_prefix_free():
    from gridloom.sources import bitmaps

    for black in (0, 1):
        codes = bitmaps._fax_codes(black) + [bitmaps.END_OF_LINE]
        assert len(codes) == 64 + 27 + 13 + 1
        assert not any(a != b and b.startswith(a) for a in codes for b in codes)


@pytest.mark.parametrize("planes", [1, 3])
@pytest.mark.parametrize("height, width", [(1, 1), (5, 11), (33, 70)])
def test_pictures_round_trip(planes, height, width):
    rng = np.random.default_rng(height)
    many, few = rng.integers(0, 256, (height, width, planes)), rng.integers(0, 3, (height, width, planes)) * 100
    rgb = lambda m: np.repeat(m[:, :, :1], 3, axis=2) if m.shape[2] == 1 else m
    trip = lambda name, m, maxval=255, **options: one(formats.FORMATS[name][0](formats.FORMATS[name][1](m, maxval, **options)))
    for m in (many, few):
        for name in ("png", "xwd", "sir"):
            assert (trip(name, m) == m).all()
        for packing in ("none", "packbits", "deflate"):
            assert (trip("tiff", m, packing=packing) == m).all()
        for name in ("ilbm", "leaf"):
            assert (trip(name, m) == rgb(m)).all()
    for name in ("gif", "ico", "tiffcmyk"):
        assert (trip(name, few) == rgb(few)).all()
    assert (trip("gif", few, interlace=True) == rgb(few)).all()
    assert (trip("tiff", many * 257, 65535) == many * 257).all() and (trip("png", many * 257, 65535) == many * 257).all()
    assert (trip("pfm", many, little=False, scale=2.0) == np.floor(many / 255 * 65535 + 0.5)).all()
    if planes == 1:
        for maxval in (1, 3, 15):
            m = many % (maxval + 1)
            assert (trip("png", m, maxval) == m).all()
        assert (trip("fs", many) == many).all() and (trip("lispm", many) == many).all()
        assert (trip("tiff", many % 2, 1) == many % 2).all()
        eight = rgb(many % 8)
        for name in ("pi1", "neo"):
            assert (trip(name, eight, 7)[:height, :width] == eight).all()
        with pytest.raises(ValueError):
            formats.FORMATS["pi1"][1](np.zeros((201, 1, 1), np.int64), 7)
    if (height, width) == (33, 70):
        with pytest.raises(ValueError):
            formats.FORMATS["gif"][1](rng.integers(0, 256, (height, width, 3)), 255)


def test_pictures_by_hand():
    import base64
    import zlib

    gif = base64.b64decode("R0lGODlhAQABAIAAAP///wAAACwAAAAAAQABAAACAkQBADs=")
    assert one(formats.FORMATS["gif"][0](gif)).tolist() == [[[255, 255, 255]]]
    # every filter of PNG, once: 3 x 5 gray; the lines are the same without them
    lines = [[10, 20, 30], [11, 21, 31], [12, 22, 32], [13, 23, 33], [14, 24, 34]]
    filtered = [[0, 10, 20, 30], [1, 11, 10, 10], [2, 1, 1, 1], [3, 13 - 6, 23 - (13 + 22) // 2, 33 - (23 + 32) // 2], [4, 1, 1, 1]]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 5, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(b & 255 for row in filtered for b in row))) + chunk(b"IEND", b"")
    assert formats.FORMATS["png"][0](png)[0][:, :, 0].tolist() == lines
    with pytest.raises(ValueError):
        formats.FORMATS["png"][0](png[:30] + b"x" + png[31:])
    # interlaced 2 x 2 of one byte: passes 1, 6 and 7 have cells
    raw = bytes([0, 1, 0, 2, 0, 3, 4])
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 0, 0, 0, 1)) + chunk(b"tRNS", b"\0\4") + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert formats.FORMATS["png"][0](png)[0][:, :, 0].tolist() == [[1, 2], [3, 4]]
    assert formats.FORMATS["png"][0](png, alpha=True)[0][:, :, 1].tolist() == [[255, 255], [255, 0]]
    get = lambda name, raw, *a: one(formats.FORMATS[name][0](raw, *a)).tolist()
    assert get("mtv", b"2 1\n\1\2\3\4\5\6") == [[[1, 2, 3], [4, 5, 6]]]
    assert get("qrt", bytes([2, 0, 1, 0, 9, 9, 1, 4, 2, 5, 3, 6])) == [[[1, 2, 3], [4, 5, 6]]]
    assert get("psid", b"<0f a5>", 2, 4, 2) == [[[0], [0], [3], [3]], [[2], [2], [1], [1]]]
    assert get("xvmini", b"P7 332\n#XVVERSION\n#END_OF_COMMENTS\n2 1 255\n" + bytes([0b11100000, 0b00011111])) == [[[255, 0, 0], [0, 255, 255]]]
    assert get("asciigray", b" M\n+ M\n", 1, 2) == [[[127], [0]]]
    gould = struct.pack("<HHHHHHIII", 0, 1, 2, 8, 1, 0, 0, 0, 0).ljust(512, b"\0") + bytes([5, 6])
    assert get("gould", gould) == [[[5, 5, 5], [6, 6, 6]]]
    img = b"12345678" + b"AT00000012" + b"   2   1   1" + b"CM00000003" + bytes([7, 8, 9]) + b"PD00000002" + bytes([0, 0])
    assert get("img", img) == [[[7, 8, 9], [7, 8, 9]]]
    zeiss = bytes([0, 1]) + bytes([9, 8]).ljust(256, b"\0") + bytes([7, 6]).ljust(256, b"\0") + bytes([5, 4]).ljust(256, b"\0") + (bytes(8) + struct.pack("<HH", 2, 1)).ljust(256, b"\0")
    assert get("zeiss", zeiss) == [[[7, 5, 9], [6, 4, 8]]]
    biorad = bytearray(struct.pack("<HHH", 2, 1, 2).ljust(76, b"\0"))
    struct.pack_into("<H", biorad, 14, 1)
    struct.pack_into("<H", biorad, 54, 12345)
    assert [m.tolist() for m, _ in formats.FORMATS["biorad"][0](bytes(biorad) + bytes([1, 2, 3, 4]))] == [[[[1], [2]]], [[[3], [4]]]]
    hips = b"a\nb\n1\nd\n1\n2\n8\n0\n0\nhistory\n.\n" + bytes([3, 4])
    assert get("hips", hips) == [[[3], [4]]]
    sbig = b"ST-7 Compressed Image\nHeight = 1\nWidth = 3\nSat_level = 100\nEnd\n".ljust(2048, b"\0") + struct.pack("<HHbb", 4, 50, 2, -3)
    assert get("sbig", sbig) == [[[50], [52], [49]]]
    # ham: hold and modify, six planes: set from the palette, then change blue, red and green
    codes = np.array([[1, 0b010000 | 15, 0b100000, 0b110000 | 15]])
    planes = np.packbits(np.pad(codes[:, None, :] >> np.arange(6)[None, :, None] & 1, ((0, 0), (0, 0), (0, 12))).astype(np.uint8), axis=2).tobytes()
    part = lambda kind, body: kind + struct.pack(">I", len(body)) + body
    body = part(b"BMHD", struct.pack(">HHhhBBBBHBBhh", 4, 1, 0, 0, 6, 0, 0, 0, 0, 1, 1, 4, 1)) + part(b"CAMG", struct.pack(">I", 0x800)) + part(b"CMAP", bytes([0, 0, 0, 10, 20, 30])) + part(b"BODY", planes)
    assert get("ilbm", b"FORM" + struct.pack(">I", len(body) + 4) + b"ILBM" + body) == [[[10, 20, 30], [10, 20, 255], [0, 20, 255], [0, 255, 255]]]
    # spectrum: colour 0 of the first palette up to column 0, the second from there on
    screen, tables = np.zeros((200, 80), ">u2"), np.zeros((199, 48), ">u2")
    tables[0, 0], tables[0, 16], tables[0, 32] = 0x700, 0x070, 0x007
    got = formats.FORMATS["spu"][0](screen.tobytes() + tables.tobytes())[0]
    assert got[1, 0].tolist() == [7, 0, 0] and got[1, 1].tolist() == [0, 7, 0] and got[1, 161].tolist() == [0, 0, 7] and not got[0].any()
    assert get("yuv411", bytes([16, 235, 16, 235, 128, 128]), 1, 4) == [[[0] * 3, [255] * 3, [0] * 3, [255] * 3]]


def test_video_halves():
    m = np.repeat(np.repeat(np.random.default_rng(1).integers(0, 256, (4, 6, 3)), 2, axis=0), 2, axis=1)
    got = formats.FORMATS["yuvsplit"][0](formats.FORMATS["yuvsplit"][1](m, 255), 8, 12)[0]
    assert abs(got - m).max() <= 6
    gray = np.full((4, 4, 3), 100)
    raw = formats.FORMATS["eyuv"][1](gray, 255)
    assert raw[:16] in (bytes([100]) * 16, bytes([99]) * 16) and set(raw[16:]) <= {127, 128}
    assert len(formats.FORMATS["eyuv"][0](raw * 3, 4, 4)) == 3


def test_display_formats():
    m = np.array([[[255, 0, 0], [255, 0, 0], [0, 0, 255]]])
    assert formats.FORMATS["sixel"][1](m, 255) == b'\x900;0;8q"1;1\n#0;2;0;0;100#1;2;100;0;0\n#1!2@#0@$\n\x9c\n'
    html = formats.FORMATS["html"][1](np.array([[[1], [2], [2]], [[1], [2], [2]]]), 255).decode()
    assert html.count("<TD VALIGN") == 3 and "COLSPAN=2 ROWSPAN=2 BGCOLOR=#020202" in html
    ps = formats.FORMATS["ps"][1](np.array([[[0], [1]], [[1], [0]]]), 1).decode()
    assert "2 2 1 [ 2 0 0 -2 0 2 ]" in ps and "\n40\n80\n" in ps
    epsi = formats.FORMATS["epsi"][1](np.array([[[1], [1]], [[1], [0]]]), 1).decode()
    assert "%%BoundingBox: 1 0 2 1" in epsi and "% 80" in epsi
    assert formats.FORMATS["puzz"][1](m, 255) == struct.pack(">IIB", 3, 1, 2) + bytes([0, 0, 255, 255, 0, 0, 1, 1, 0])
    assert b"\x1b[0m\x1b[31m\x1b[40m" in formats.FORMATS["term"][1](np.array([[[192, 0, 0]]]), 255)


def test_files_of_several_images(spark, tmp_path):
    (tmp_path / "two.pgm").write_bytes(b"P5\n1 1\n255\n\x07P5\n2 1\n255\n\x08\x09")
    got = {(r["image"].rsplit("/", 1)[-1], r["col"], r["s"][0]) for r in formats.read(spark, str(tmp_path)).collect()}
    assert got == {("two.pgm", 0, 7), ("two.pgm#1", 0, 8), ("two.pgm#1", 1, 9)}
