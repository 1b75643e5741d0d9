"""Portable anymap files: PBM, PGM, PPM (plain and raw) and PAM, read and written.

Reading starts from Spark's binaryFile source, so any store that Spark reads will do; a
file is decoded by the task that holds it, with numpy.  A file may hold several images.
Writing gathers the rows of an image in order in one task and gives the bytes as a column,
or as files through ``write``.  In memory white is 1 in bitmaps, as in PAM; PBM's own
polarity is turned at the border.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.raster import Raster, images

IMAGES = "image string, image_seq int, format string, height int, width int, depth int, maxval bigint, tuple_type string"
PX = "image string, image_seq int, row bigint, col bigint, s array<bigint>"
#: Planes of each magic number.
PLANES = {b"P1": 1, b"P2": 1, b"P3": 3, b"P4": 1, b"P5": 1, b"P6": 3}


@dataclass
class Header:
    magic: bytes
    height: int
    width: int
    depth: int
    maxval: int
    tuple_type: str
    at: int


def _token(raw: bytes, at: int) -> tuple[bytes, int]:
    while at < len(raw):
        if raw[at : at + 1].isspace():
            at += 1
        elif raw[at : at + 1] == b"#":
            while at < len(raw) and raw[at] != 10:
                at += 1
        else:
            break
    end = at
    while end < len(raw) and not raw[end : end + 1].isspace() and raw[end] != 35:
        end += 1
    if end == at:
        raise ValueError("the header ends early")
    return raw[at:end], end


def header(raw: bytes, at: int = 0) -> Header:
    """The header of the image at a place."""
    magic = raw[at : at + 2]
    if magic == b"P7":
        fields, pos, kinds = {}, raw.index(b"\n", at) + 1, []
        while True:
            end = raw.index(b"\n", pos)
            line = raw[pos:end].strip()
            pos = end + 1
            if line == b"ENDHDR":
                break
            if line and not line.startswith(b"#"):
                name, _, value = line.partition(b" ")
                if name == b"TUPLTYPE":
                    kinds.append(value.strip().decode())
                else:
                    fields[name] = int(value)
        return Header(magic, fields[b"HEIGHT"], fields[b"WIDTH"], fields[b"DEPTH"], fields[b"MAXVAL"], " ".join(kinds), pos)
    if magic not in PLANES:
        raise ValueError(f"no image begins with {magic!r}")
    width, pos = _token(raw, at + 2)
    height, pos = _token(raw, pos)
    maxval = b"1"
    if magic not in (b"P1", b"P4"):
        maxval, pos = _token(raw, pos)
    kind = {1: "GRAYSCALE", 3: "RGB"}[PLANES[magic]] if int(maxval) > 1 or magic not in (b"P1", b"P4") else "BLACKANDWHITE"
    return Header(magic, int(height), int(width), PLANES[magic], int(maxval), kind, pos + 1)


def decode(raw: bytes, at: int = 0) -> tuple[Header, np.ndarray, int]:
    """An image's header, its samples (height x width x depth), and where it ends.  A short file is an error."""
    h = header(raw, at)
    n = h.height * h.width * h.depth
    if h.magic == b"P1":
        bits, pos = [], h.at - 1
        while len(bits) < n:
            if pos >= len(raw):
                raise ValueError("the raster ends early")
            c = raw[pos]
            if c == 35:
                pos = raw.find(b"\n", pos) if raw.find(b"\n", pos) >= 0 else len(raw)
            elif c in b"01":
                bits.append(c == 48)
            pos += 1
        samples, end = np.array(bits, np.int64), pos
    elif h.magic in (b"P2", b"P3"):
        values, pos = [], h.at - 1
        while len(values) < n:
            value, pos = _token(raw, pos)
            values.append(int(value))
        samples, end = np.array(values, np.int64), pos
    elif h.magic == b"P4":
        line = -(-h.width // 8)
        end = h.at + line * h.height
        packed = np.frombuffer(raw[h.at : end], np.uint8)
        if len(packed) < line * h.height:
            raise ValueError("the raster ends early")
        samples = 1 - np.unpackbits(packed.reshape(h.height, line), axis=1)[:, : h.width].astype(np.int64)
    else:
        kind = np.dtype("u1" if h.maxval < 256 else ">u2")
        end = h.at + n * kind.itemsize
        if len(raw) < end:
            raise ValueError("the raster ends early")
        samples = np.frombuffer(raw[h.at : end], kind).astype(np.int64)
    return h, samples.reshape(h.height, h.width, h.depth), end


def decode_all(raw: bytes) -> Iterator[tuple[Header, np.ndarray]]:
    """Every image of a file, one after the other, white space between."""
    at = 0
    while at < len(raw):
        h, samples, at = decode(raw, at)
        yield h, samples
        while at < len(raw) and raw[at : at + 1].isspace():
            at += 1


def encode(samples: np.ndarray, maxval: int, format: str = "P6", tuple_type: str = "") -> bytes:
    """The bytes of an image: P1 to P6, or P7."""
    height, width, depth = samples.shape
    if format == "P7":
        kind = tuple_type or {1: "BLACKANDWHITE" if maxval == 1 else "GRAYSCALE", 2: "GRAYSCALE_ALPHA", 3: "RGB", 4: "RGB_ALPHA"}.get(depth, "")
        head = f"P7\nWIDTH {width}\nHEIGHT {height}\nDEPTH {depth}\nMAXVAL {maxval}\n" + (f"TUPLTYPE {kind}\n" if kind else "") + "ENDHDR\n"
        return head.encode() + samples.astype("u1" if maxval < 256 else ">u2").tobytes()
    head = f"{format}\n{width} {height}\n" + ("" if format in ("P1", "P4") else f"{maxval}\n")
    flat = samples.reshape(height, width * depth)
    if format == "P4":
        return head.encode() + np.packbits(1 - flat.astype(np.uint8), axis=1).tobytes()
    if format in ("P5", "P6"):
        return head.encode() + flat.astype("u1" if maxval < 256 else ">u2").tobytes()
    if format == "P1":
        return head.encode() + b"".join("".join(map(str, 1 - line[k : k + 70])).encode() + b"\n" for line in flat for k in range(0, max(1, width), 70))
    return head.encode() + b"".join(" ".join(map(str, line[k : k + 12])).encode() + b"\n" for line in flat for k in range(0, max(1, len(line)), 12))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def headers(spark: SparkSession, path: str) -> DataFrame:
    """One row for each image of the files: IMAGES."""

    def run(batches):
        for pdf in batches:
            out = [(p, k, h.magic.decode(), h.height, h.width, h.depth, h.maxval, h.tuple_type) for p, raw in zip(pdf.path, pdf.content, strict=True) for k, (h, _) in enumerate(decode_all(bytes(raw)))]
            yield pd.DataFrame(out, columns=["image", "image_seq", "format", "height", "width", "depth", "maxval", "tuple_type"])

    return _files(spark, path).mapInPandas(run, IMAGES)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each cell of every image: PX.  A batch is an image."""

    def run(batches):
        for pdf in batches:
            for p, raw in zip(pdf.path, pdf.content, strict=True):
                for k, (_, samples) in enumerate(decode_all(bytes(raw))):
                    row, col = np.indices(samples.shape[:2])
                    yield pd.DataFrame({"image": p, "image_seq": k, "row": row.ravel(), "col": col.ravel(), "s": list(samples.reshape(-1, samples.shape[2]))})

    return _files(spark, path).mapInPandas(run, PX)


def read_raster(spark: SparkSession, path: str) -> Raster:
    """Files whose images all have one size and maxval."""
    shapes = headers(spark, path).select("height", "width", "depth", "maxval").distinct().limit(2).collect()
    if len(shapes) != 1:
        raise ValueError("the images differ in size or scale; use read")
    px = read(spark, path).select(F.when(F.col("image_seq") == 0, F.col("image")).otherwise(F.concat_ws("#", "image", "image_seq")).alias("image"), "row", "col", "s")
    return Raster(px, shapes[0]["height"], shapes[0]["width"], shapes[0]["maxval"], shapes[0]["depth"])


def gathered(r: Raster, encoder: Callable[[np.ndarray, int], bytes], rows: int | None = None) -> DataFrame:
    """image, top and the bytes that encoder makes of samples and maxval.

    An image is gathered in one task, its rows as arrays; with rows, one of more lines than
    that is made into several files, each of a band of its lines and gathered in a task of its
    own, of which top is the first line.
    """
    height, width, depth, maxval = r.height, r.width, r.depth, r.maxval
    rows = rows or max(1, height)
    px = r.px.select("image", "row", F.struct("col", "s").alias("cell"))
    if rows < height:  # bands without a cell have a file too
        tops = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(height - 1).cast("bigint"), F.lit(rows).cast("bigint")))
        px = px.unionByName(images(r).select("image", tops.alias("row")), allowMissingColumns=True)
    px = px.withColumn("top", F.expr(f"row div {rows} * {rows}L")).repartition("image", "top")
    lines = px.groupBy("image", "top", "row").agg(F.collect_list("cell").alias("line"))
    lines = lines.select("image", "top", "row", F.col("line.col").alias("cols"), F.flatten("line.s").alias("samples"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        top = int(pdf.top.iloc[0])
        out = np.zeros((min(rows, height - top), width, depth), np.int64)
        for row, cols, samples in zip(pdf.row, pdf.cols, pdf.samples, strict=True):
            if len(cols):
                out[row - top, cols] = np.reshape(samples, (len(cols), -1))
        return pd.DataFrame({"image": [pdf.image.iloc[0]], "top": [top], "content": [encoder(out, maxval)]})

    return lines.groupBy("image", "top").applyInPandas(one, "image string, top bigint, content binary")


def encoded(r: Raster, format: str = "P7") -> DataFrame:
    """image and the bytes of its file.  An image is gathered in one task."""
    return gathered(r, lambda m, maxval: encode(m, maxval, format)).drop("top")


def write(r: Raster, folder: str, format: str = "P7") -> None:
    """A file for each image, named by it, through pyarrow's file systems; a task that runs twice replaces its file by the same."""
    end = {"P1": "pbm", "P4": "pbm", "P2": "pgm", "P5": "pgm", "P3": "ppm", "P6": "ppm", "P7": "pam"}[format]

    def put(pdf: pd.DataFrame) -> None:
        import uuid

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(base, recursive=True)
        for name, content in zip(pdf.image, pdf.content, strict=True):
            safe = "".join(c if c.isalnum() or c in "-_." else "_" for c in name)
            own = f"{base}/.{safe}.{uuid.uuid4().hex}"
            with store.open_output_stream(own) as file:
                file.write(bytes(content))
            store.move(own, f"{base}/{safe}.{end}")

    def run(batches):
        for pdf in batches:
            put(pdf)
            yield pdf[["image"]]

    encoded(r, format).mapInPandas(run, "image string").count()


def checksum(raw: bytes) -> tuple[int, int]:
    """The POSIX cksum of bytes: a CRC that takes in the length, and the length."""
    crc = 0
    size, tail = len(raw), b""
    while size:
        tail += bytes([size & 255])
        size >>= 8
    for b in raw + tail:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if crc & 0x80000000 else crc << 1
    return crc ^ 0xFFFFFFFF, len(raw)
