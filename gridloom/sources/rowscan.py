"""Raw anymap files by rows: a data source whose tasks read, and write, parts of one image.

Reading.  A header says where each row's bytes lie, so an image is cut into ranges of whole
rows of about ``bytes`` bytes and each is read by a task of its own, with one seek.  Filters
on ``row`` and ``image`` are pushed down: ranges without a wanted row aren't planned, others
are narrowed.  Columns are those of the schema that is asked for.  A file may hold several
images, one after the other.  Plain files have no fixed rows and are for ``anymap.read``.

Writing.  Cells come in any number of tasks, all of a row in one.  Rows have known places, so
every task writes its own into one staged file for each image, at their offsets; a task that
runs twice writes the same bytes there.  On commit the driver puts the headers in and renames
the files; if the job fails it deletes what was staged, so there is never a file without all of
its rows.  ``repeat`` writes every row that often.  Cells that aren't given are 0.

Files are reached as files: the folder has to be one that all executors mount.
"""

from __future__ import annotations

import glob
import os
import shutil
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (as pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from gridloom.raster import Raster
from gridloom.sources.anymap import Header, header

SCHEMA = "image string, row bigint, col bigint, s array<bigint>"
ENDS = {"P4": "pbm", "P5": "pgm", "P6": "ppm", "P7": "pam"}
#: Bytes of a file that one task reads, and bytes that hold a header with its comments.
BYTES, HEAD = 16 << 20, 1 << 16


def local(path: str) -> str:
    """The path of a file: without its scheme."""
    if "://" in path or path.startswith("file:"):
        scheme, _, rest = path.partition(":")
        if scheme != "file":
            raise ValueError(f"not a folder that is mounted: {path}")
        return "/" + rest.lstrip("/")
    return path


def stride(width: int, depth: int, maxval: int, format: str) -> int:
    """Bytes of a row."""
    return -(-width // 8) if format == "P4" else width * depth * (1 if maxval < 256 else 2)


def unpacked(raw: bytes, width: int, depth: int, maxval: int, format: str) -> np.ndarray:
    """Whole rows of bytes as rows x width x depth samples."""
    if format == "P4":
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, -(-width // 8)), axis=1)[:, :width]
        return (1 - bits.astype(np.int64))[:, :, None]
    return np.frombuffer(raw, "u1" if maxval < 256 else ">u2").astype(np.int64).reshape(-1, width, depth)


def packed(rows: np.ndarray, maxval: int, format: str) -> bytes:
    if format == "P4":
        return np.packbits(1 - rows[:, :, 0].astype(np.uint8), axis=1).tobytes()
    return rows.astype("u1" if maxval < 256 else ">u2").tobytes()


@dataclass
class Rows(InputPartition):
    """Rows first..last (not included) of an image whose samples start at a place of a file."""

    path: str
    image: str
    first: int
    last: int
    at: int
    width: int
    depth: int
    maxval: int
    format: str

    @property
    def stride(self) -> int:
        return stride(self.width, self.depth, self.maxval, self.format)

    @property
    def bytes(self) -> int:
        return (self.last - self.first) * self.stride


def images(path: str) -> Iterator[tuple[str, Header]]:
    """The images of a raw file by their headers: only these are read."""
    with open(path, "rb") as file:
        size, at, k = os.fstat(file.fileno()).st_size, 0, 0
        while at < size:
            file.seek(at)
            raw = file.read(HEAD)
            blank = len(raw) - len(raw.lstrip())
            if blank:
                at += blank
                continue
            h = header(raw)
            kind = h.magic.decode()
            if kind not in ENDS:
                raise ValueError(f"{path}: {kind} has no rows of one length; use anymap.read")
            h.at += at
            at = h.at + h.height * stride(h.width, h.depth, h.maxval, kind)
            if at > size:
                raise ValueError(f"{path}: the raster ends early")
            yield (path if k == 0 else f"{path}#{k}"), h
            k += 1


class Reader(DataSourceReader):
    def __init__(self, path: str, names: list[str], bytes: int) -> None:
        self.path, self.names, self.bytes = local(path), names, bytes
        self.low, self.high, self.only = 0, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of row and image with constants; gives back what it doesn't take."""
        for f in filters:
            name, value = ".".join(getattr(f, "attribute", ())), getattr(f, "value", None)
            if name == "row" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    top = value + (not isinstance(f, LessThan))
                    self.high = top if self.high is None else min(self.high, top)
            elif name == "image" and isinstance(f, (EqualTo, In)):
                some = set(value if isinstance(f, In) else [value])
                self.only = some if self.only is None else self.only & some
            else:
                yield f

    def partitions(self) -> list[Rows]:
        paths = [self.path] if os.path.isfile(self.path) else sorted(p for p in glob.glob(f"{self.path}/*" if os.path.isdir(self.path) else self.path) if os.path.isfile(p))
        out = []
        for path in paths:
            for name, h in images(path):
                if self.only is not None and name not in self.only:
                    continue
                whole = Rows(path, name, max(0, self.low), h.height if self.high is None else min(h.height, self.high), h.at, h.width, h.depth, h.maxval, h.magic.decode())
                each = max(1, self.bytes // max(1, whole.stride))
                out += [replace(whole, first=k, last=min(whole.last, k + each)) for k in range(whole.first, whole.last, each)]
        return out or [Rows("", "", 0, 0, 0, 1, 1, 1, "P5")]  # Spark wants a partition

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        p = partition
        if p.first >= p.last:
            return
        with open(p.path, "rb") as file:
            file.seek(p.at + p.first * p.stride)
            some = max(1, (1 << 16) // max(1, p.width))  # rows of a batch
            for row in range(p.first, p.last, some):
                m = unpacked(file.read(min(some, p.last - row) * p.stride), p.width, p.depth, p.maxval, p.format)
                n = m.shape[0] * p.width
                columns = {
                    "image": lambda n=n: pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([p.image])).cast(pa.string()),
                    "row": lambda m=m, row=row: pa.array(np.repeat(np.arange(row, row + m.shape[0]), p.width)),
                    "col": lambda m=m: pa.array(np.tile(np.arange(p.width), m.shape[0])),
                    "s": lambda m=m, n=n: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * p.depth), pa.array(m.ravel())),
                }
                yield pa.RecordBatch.from_arrays([columns[c]() for c in self.names], names=self.names)


@dataclass
class Written(WriterCommitMessage):
    images: tuple[str, ...]


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.folder, self.overwrite = local(options["path"]), overwrite
        self.format = options.get("kind", "P7")
        self.height, self.width, self.depth, self.maxval = (int(options[k]) for k in ("height", "width", "depth", "maxval"))
        self.repeat = int(options.get("repeat", 1))
        self.staged = f"{self.folder}/.staged-{uuid.uuid4().hex}"
        if {"P4": 1, "P5": 1, "P6": 3}.get(self.format, self.depth) != self.depth or self.format not in ENDS:
            raise ValueError(f"{self.format} doesn't hold {self.depth} planes")

    @property
    def head(self) -> bytes:
        height = self.height * self.repeat
        if self.format == "P7":
            kind = {1: "BLACKANDWHITE" if self.maxval == 1 else "GRAYSCALE", 2: "GRAYSCALE_ALPHA", 3: "RGB", 4: "RGB_ALPHA"}.get(self.depth)
            return f"P7\nWIDTH {self.width}\nHEIGHT {height}\nDEPTH {self.depth}\nMAXVAL {self.maxval}\n{f'TUPLTYPE {kind}' + chr(10) if kind else ''}ENDHDR\n".encode()
        return f"{self.format}\n{self.width} {height}\n{'' if self.format == 'P4' else str(self.maxval) + chr(10)}".encode()

    def _put(self, cells: pa.Table) -> set[str]:
        """Write whole rows of cells, in order, to their places."""
        size, blank = stride(self.width, self.depth, self.maxval, self.format), len(self.head)
        names = cells.column("image").combine_chunks().dictionary_encode()
        image, row, col = names.indices.to_numpy(), cells.column("row").to_numpy(), cells.column("col").to_numpy()
        s = cells.column("s").combine_chunks().flatten().to_numpy().reshape(len(row), self.depth)
        cuts = np.flatnonzero(np.concatenate([[True], (image[1:] != image[:-1]) | (row[1:] - row[:-1] > 1)])) if len(row) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(row)], strict=False):
            first, last = int(row[lo]), int(row[hi - 1]) + 1
            if first < 0 or last > self.height or col[lo:hi].min() < 0 or col[lo:hi].max() >= self.width:
                raise ValueError("a cell lies outside the image")
            m = np.zeros((last - first, self.width, self.depth), np.int64)
            m[row[lo:hi] - first, col[lo:hi]] = s[lo:hi]
            raw = packed(np.repeat(m, self.repeat, axis=0), self.maxval, self.format)
            file = os.open(f"{self.staged}/{file_name(names.dictionary[int(image[lo])].as_py(), self.format)}", os.O_WRONLY | os.O_CREAT)
            try:
                at, raw = blank + first * self.repeat * size, memoryview(raw)
                while len(raw):
                    done = os.pwrite(file, raw, at)
                    at, raw = at + done, raw[done:]
            finally:
                os.close(file)
        return set(names.dictionary.to_pylist())

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.staged, exist_ok=True)
        rest, seen = None, set()
        for batch in iterator:
            if not batch.num_rows:
                continue
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            image, row = rest.column("image"), rest.column("row").to_numpy()
            last = (row == row[-1]) & np.asarray(pa.compute.equal(image, image[-1]))
            cut = int(np.argmax(last))  # the row that ends here may go on in the next batch
            seen |= self._put(rest.slice(0, cut))
            rest = rest.slice(cut)
        if rest is not None:
            seen |= self._put(rest)
        return Written(tuple(sorted(seen)))

    def commit(self, messages: list[Written | None]) -> None:
        size = stride(self.width, self.depth, self.maxval, self.format) * self.height * self.repeat
        names = sorted({file_name(n, self.format) for m in messages if m for n in m.images})
        taken = [n for n in names if os.path.exists(f"{self.folder}/{n}")]
        if taken and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"there is a file {taken[0]} already")
        for name in names:
            with open(f"{self.staged}/{name}", "r+b") as file:
                file.write(self.head)
                file.truncate(len(self.head) + size)
            os.replace(f"{self.staged}/{name}", f"{self.folder}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staged, ignore_errors=True)


def file_name(image: str, format: str) -> str:
    return "".join(c if c.isalnum() or c in "-_." else "_" for c in image) + "." + ENDS[format]


class AnymapRows(DataSource):
    """Format ``anymap_rows``.  Options to read: path (a file, a folder or a pattern) and bytes; to write: path (a folder), kind (P4 to P7), height, width, depth, maxval, repeat."""

    @classmethod
    def name(cls) -> str:
        return "anymap_rows"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], schema.fieldNames(), int(self.options.get("bytes", BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(dict(self.options), overwrite)


def scan(spark: SparkSession, path: str, columns: tuple[str, ...] = ("image", "row", "col", "s"), bytes: int = BYTES) -> DataFrame:
    """The cells of raw files, read by ranges of rows; filters on row and image reach the files."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AnymapRows)
    kinds = dict(f.split(" ") for f in SCHEMA.split(", "))
    return spark.read.format("anymap_rows").schema(", ".join(f"{c} {kinds[c]}" for c in columns)).option("bytes", bytes).load(path)


def read_rows(spark: SparkSession, path: str, bytes: int = BYTES) -> Raster:
    """Raw files whose images all have one size and scale."""
    found = {(h.height, h.width, h.maxval, h.depth) for p in Reader(path, [], bytes).partitions() if p.path for _, h in images(p.path)}
    if len(found) != 1:
        raise ValueError("the images differ in size or scale; use scan")
    return Raster(scan(spark, path, bytes=bytes), *found.pop())


def write_rows(r: Raster, folder: str, format: str = "P7", tasks: int | None = None, repeat: int = 1) -> None:
    """A raw file for each image, named by it, each written by as many tasks as its rows are dealt to; what is there is replaced."""
    spark = r.px.sparkSession
    spark.dataSource.register(AnymapRows)
    dealt = r.px.select("image", F.col("row").cast("bigint"), F.col("col").cast("bigint"), "s")
    dealt = (dealt.repartitionByRange(tasks, "image", "row") if tasks else dealt.repartitionByRange("image", "row")).sortWithinPartitions("image", "row", "col")
    options = {"kind": format, "height": r.height, "width": r.width, "depth": r.depth, "maxval": r.maxval, "repeat": repeat}
    os.makedirs(local(folder), exist_ok=True)
    dealt.write.format("anymap_rows").mode("overwrite").options(**options).save(folder)
