"""Arrays read range by range: headers while the query is planned, values where they are needed, no file as a whole.

A row is a packed piece of one plane: path, item (sample, page or frame), the place (y, x) and size (height, width,
channels) of the piece, the kind of its values and their bytes. Files may be larger than a row can be: an item is cut
into pieces of whole rows, or of the strips and tiles in which its file has it. Consecutive pieces share a partition.

Kinds of files: npy; npz (one member by ``key``, by ranges where it is stored, as a stream where it is packed); tif with
any number of pages, classic or big; raw 16 bit frames whose sidecar tells their shape. Paths are read through the file
system of their address, so they need not be local.

``item`` bounds are options (``first``, ``end``) and, where the session allows pushing filters to Python sources, follow
from filters on ``item`` and ``path``. Either way, ranges outside are neither planned nor read.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from fnmatch import fnmatch
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "path string, item long, y int, x int, height int, width int, channels int, kind string, data binary"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: Bytes of values in a piece and in a partition, about.
PIECE, PARTITION = 1 << 22, 1 << 26


@dataclass(frozen=True)
class Plain:
    """Values in a row from an offset on: items of rows, columns and channels; ``start`` is the first item that is kept."""

    offset: int
    shape: tuple[int, int, int, int]
    kind: str
    start: int = 0

    @property
    def rows(self) -> int:
        return max(1, min(self.shape[1], PIECE // max(1, self.line)))

    @property
    def line(self) -> int:
        return self.shape[2] * self.shape[3] * np.dtype(self.kind).itemsize

    @property
    def each(self) -> int:
        return -(-self.shape[1] // self.rows)

    def pieces(self) -> int:
        return (self.shape[0] - self.start) * self.each if self.line else 0

    def size(self) -> int:
        return self.rows * self.line

    def within(self, first: int, end: int | None) -> Plain:
        items = self.shape[0] if end is None else max(self.start, min(self.shape[0], end))
        return replace(self, shape=(items, *self.shape[1:]), start=min(items, max(first, self.start)))

    def part(self, lo: int, hi: int) -> Plain:
        return self

    def read(self, f: pa.NativeFile, n: int) -> tuple:
        item, k = divmod(n, self.each)
        item, y = item + self.start, k * self.rows
        height = min(self.rows, self.shape[1] - y)
        f.seek(self.offset + (item * self.shape[1] + y) * self.line)
        data = f.read(height * self.line)
        if len(data) < height * self.line:
            raise ValueError("the file ends before its values do")
        return item, y, 0, height, self.shape[2], self.shape[3], self.kind, data


@dataclass(frozen=True)
class Packed:
    """One member of an archive that holds an npy file, to be unpacked from its start: a single partition."""

    member: str
    plain: Plain

    def pieces(self) -> int:
        return self.plain.pieces() and 1

    def size(self) -> int:
        return PARTITION

    def within(self, first: int, end: int | None) -> Packed:
        return replace(self, plain=self.plain.within(first, end))

    def part(self, lo: int, hi: int) -> Packed:
        return self

    def stream(self, f: pa.NativeFile) -> Iterator[tuple]:
        p = self.plain
        with zipfile.ZipFile(f) as archive, archive.open(self.member) as body:
            body.read(p.offset)
            for n in range(p.shape[0] * p.each):
                item, k = divmod(n, p.each)
                height = min(p.rows, p.shape[1] - k * p.rows)
                data = body.read(height * p.line)
                if item >= p.start:
                    yield item, k * p.rows, 0, height, p.shape[2], p.shape[3], p.kind, data


@dataclass(frozen=True)
class Page:
    """A page of a tif file: its size, how its values are kept, and where its strips or tiles lie."""

    item: int
    height: int
    width: int
    channels: int
    kind: str
    packing: int
    predictor: int
    planar: bool
    block: tuple[int, int]
    places: tuple[tuple[int, int], ...]

    @property
    def across(self) -> int:
        return -(-self.width // self.block[1])

    @property
    def layers(self) -> int:
        return self.channels if self.planar else 1

    @property
    def down(self) -> int:
        return -(-self.height // self.block[0])


@dataclass(frozen=True)
class Pages:
    """The pages of a tif file; a piece is a strip or tile with all of its channels."""

    pages: tuple[Page, ...]
    ends: tuple[int, ...] = field(default=())

    @staticmethod
    def of(pages: Iterable[Page]) -> Pages:
        pages = tuple(pages)
        return Pages(pages, tuple(accumulate(p.across * p.down for p in pages)))

    def pieces(self) -> int:
        return self.ends[-1] if self.ends else 0

    def size(self) -> int:
        return max((p.block[0] * p.block[1] * p.channels * np.dtype(p.kind).itemsize for p in self.pages), default=1)

    def within(self, first: int, end: int | None) -> Pages:
        return Pages.of(p for p in self.pages if p.item >= first and (end is None or p.item < end))

    def part(self, lo: int, hi: int) -> Pages:
        """Only the pages of these pieces travel to the partition; the places before them count as nothing."""
        kept = [k for k, e in enumerate(self.ends) if e > lo and (k == 0 or self.ends[k - 1] < hi)]
        return Pages(tuple(self.pages[k] for k in kept), tuple(self.ends[k] for k in kept))

    def read(self, f: pa.NativeFile, n: int) -> tuple:
        k = bisect_right(self.ends, n)
        page = self.pages[k]
        at = n - (self.ends[k] - page.across * page.down)
        y, x = at // page.across * page.block[0], at % page.across * page.block[1]
        layers = []
        for layer in range(page.layers):
            offset, size = page.places[at + layer * page.across * page.down]
            f.seek(offset)
            layers.append(_unpacked(f.read(size), page, min(page.block[0], page.height - y)))
        block = np.concatenate(layers, 2)[: page.height - y, : page.width - x]
        return page.item, y, x, block.shape[0], block.shape[1], page.channels, page.kind, block.astype(page.kind).tobytes()


Layout = Plain | Packed | Pages


def _unpacked(data: bytes, page: Page, rows: int) -> np.ndarray:
    """The values of a strip or tile: rows, columns, channels."""
    channels, dtype = 1 if page.planar else page.channels, np.dtype(page.kind)
    raw = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}[page.packing](data)
    tall = len(raw) // max(1, page.block[1] * channels * dtype.itemsize)
    if tall < rows:
        raise ValueError("a strip or tile ends before its values do")
    raw = raw[: tall * page.block[1] * channels * dtype.itemsize]
    if page.predictor == 3:  # differences of bytes, the bytes of one place side by side, highest first
        lines = np.cumsum(np.frombuffer(raw, np.uint8).reshape(tall, -1, channels), axis=1, dtype=np.uint8).reshape(tall, dtype.itemsize, page.block[1] * channels)
        return np.ascontiguousarray(lines.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(tall, page.block[1], channels).astype(dtype)
    out = np.frombuffer(raw, dtype).reshape(tall, page.block[1], channels)
    return np.cumsum(out, axis=1, dtype=dtype.newbyteorder("=")).astype(dtype) if page.predictor == 2 else out


def unpack_bits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; 256 starts a new table and 257 ends."""
    out, table, width, bits, held, last = bytearray(), [], 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


#: Numbers of tif fields that are read (fixed values).
WIDTH, HEIGHT, BITS, PACKING, MEANING, STRIPS, CHANNELS, ROWS, STRIP_SIZES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
#: Types of values in tif fields (fixed values).
FIELD_TYPES = {1: "B", 3: "H", 4: "I", 13: "I", 16: "Q"}


def tiff_pages(f: pa.NativeFile | io.BytesIO) -> Iterator[Page]:
    """The pages of a file, from its chain of directories; what is not known is an error that names it."""
    head = f.read(16)
    end = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(end + "H", head[2:4])[0] if end else 0
    if version not in (42, 43):
        raise ValueError("no tif file")
    big = version == 43
    offset, count, entry = ("Q", "Q", "HHQ8s") if big else ("I", "H", "HHI4s")
    at, item, seen = struct.unpack(end + offset, head[8:16] if big else head[4:8])[0], 0, set()
    while at:
        if at in seen:
            raise ValueError("its directories form a ring")
        seen.add(at)
        f.seek(at)
        many = struct.unpack(end + count, f.read(struct.calcsize(end + count)))[0]
        raw = f.read(many * struct.calcsize(end + entry))
        at = struct.unpack(end + offset, f.read(struct.calcsize(end + offset)))[0]
        tags: dict[int, tuple] = {}
        for tag, kind, n, value in struct.iter_unpack(end + entry, raw):
            if kind in FIELD_TYPES:
                code = f"{end}{n}{FIELD_TYPES[kind]}"
                size = struct.calcsize(code)
                if size > len(value):
                    f.seek(struct.unpack(end + offset, value)[0])
                    value = f.read(size)
                tags[tag] = struct.unpack(code, value[:size])
        yield _page(tags, item, end)
        item += 1


def _page(tags: dict[int, tuple], item: int, end: str) -> Page:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    bits, kind, packing, predictor = set(tags.get(BITS, (1,))), one(FORMAT, 1), one(PACKING, 1), one(PREDICTOR, 1)
    if len(bits) > 1 or min(bits) not in (8, 16, 32, 64) or kind not in (1, 2, 3):
        raise ValueError(f"values of {sorted(bits)} bits in format {kind} are not read")
    if packing not in (1, 5, 8, 32946, 32773):
        raise ValueError(f"packing {packing} is not read")
    if predictor not in (1, 2, 3) or predictor == 3 and kind != 3:
        raise ValueError(f"predictor {predictor} is not read")
    tiled = TILES in tags
    block = (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(ROWS, tags[HEIGHT][0]), tags[HEIGHT][0]), tags[WIDTH][0])
    places = tuple(zip(tags[TILES if tiled else STRIPS], tags[TILE_SIZES if tiled else STRIP_SIZES], strict=True))
    page = Page(item, tags[HEIGHT][0], tags[WIDTH][0], one(CHANNELS, 1), f"{end}{'uif'[kind - 1]}{min(bits) // 8}", packing, predictor, one(PLANAR, 1) == 2, block, places)
    if len(places) != page.across * page.down * page.layers:
        raise ValueError(f"page {item} has {len(places)} strips or tiles in place of {page.across * page.down * page.layers}")
    return page


def npy_header(f: pa.NativeFile | io.BytesIO) -> tuple[tuple[int, ...], str, int]:
    """(shape, kind, offset) of an npy file that ``f`` is at the start of."""
    version = np.lib.format.read_magic(f)
    shape, fortran, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if fortran and len(shape) > 1:
        raise ValueError("columns before rows are not read by ranges")
    if dtype.hasobject:
        raise ValueError("objects are not read")
    return shape, dtype.str, f.tell()


def _plain(shape: tuple[int, ...], kind: str, offset: int) -> Plain:
    """Items, rows, columns, channels: two axes are one item, and a fourth has the channels."""
    if not 2 <= len(shape) <= 4:
        raise ValueError(f"arrays of {len(shape)} axes are not read")
    shape = (1, *shape) if len(shape) == 2 else shape
    return Plain(offset, (*shape, 1)[:4], kind)


def layout(files: fs.FileSystem, path: str, key: str) -> Layout:
    """How the values of a file lie in it, from its header."""
    ending = path.rsplit(".", 1)[-1].lower()
    with files.open_input_file(path) as f:
        if ending in ("tif", "tiff"):
            return Pages.of(tiff_pages(f))
        if ending == "npy":
            return _plain(*npy_header(f))
        if ending == "npz":
            with zipfile.ZipFile(f) as archive:
                member = archive.getinfo(f"{key}.npy")
                with archive.open(member) as body:
                    plain = _plain(*npy_header(io.BytesIO(body.read(1 << 16))))
            if member.compress_type != zipfile.ZIP_STORED:
                return Packed(member.filename, plain)
            f.seek(member.header_offset + 26)
            name, extra = struct.unpack("<HH", f.read(4))
            return replace(plain, offset=member.header_offset + 30 + name + extra + plain.offset)
        if ending == "dax":
            with files.open_input_stream(re.sub(r"\.dax$", ".inf", path)) as note:
                text = note.read().decode("utf-8", "replace")
            found = re.search(r"frame dimensions = (\d+) x (\d+)", text)
            if found is None:
                raise ValueError("its sidecar has no frame dimensions")
            height, width = map(int, found.groups())
            return Plain(0, (f.size() // (2 * height * width), height, width, 1), "<u2" if "little endian" in text else ">u2")
    raise ValueError(f"unknown kind of array: {path}")


@dataclass
class Range(InputPartition):
    """Pieces lo to hi of a file."""

    path: str
    layout: Layout
    lo: int
    hi: int


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.first, self.end, self.paths = int(options.get("first", 0)), int(options["end"]) if "end" in options else None, None

    def _files(self) -> tuple[fs.FileSystem, str, list[str]]:
        at = self.options["path"]
        files, path = fs.FileSystem.from_uri(at) if re.match(r"\w+:", at) else (fs.LocalFileSystem(), at)
        prefix = at[: len(at) - len(path)] if at.endswith(path) else ""
        info = files.get_file_info(path)
        if info.type == fs.FileType.File:
            return files, prefix, [path]
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(at)
        listed = files.get_file_info(fs.FileSelector(path, recursive=True))
        return files, prefix, sorted(f.path for f in listed if f.is_file and fnmatch(f.base_name, self.options.get("glob", "*")))

    def partitions(self) -> list[Range]:
        files, prefix, paths = self._files()
        out, most = [], int(self.options.get("partition", PARTITION))
        for path in paths:
            if self.paths is not None and prefix + path not in self.paths:
                continue
            try:
                found = layout(files, path, self.options.get("key", "masks")).within(self.first, self.end)
            except Exception as e:
                raise ValueError(f"{prefix + path}: {e}") from e
            step = max(1, most // max(1, found.size()))
            out += [Range(prefix + path, found.part(lo, min(lo + step, found.pieces())), lo, min(lo + step, found.pieces())) for lo in range(0, found.pieces(), step)]
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing was planned
            return
        at = partition.path
        files, path = fs.FileSystem.from_uri(at) if re.match(r"\w+:", at) else (fs.LocalFileSystem(), at)
        with files.open_input_file(path) as f:
            if isinstance(partition.layout, Packed):
                found = partition.layout.stream(f)
            else:
                found = (partition.layout.read(f, n) for n in range(partition.lo, partition.hi))
            for row in found:
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((at, *row), TYPES, strict=True)], NAMES)


TYPES = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary()]


class PushingReader(ArrayReader):
    """Takes bounds of items and names of paths from the filters of the query; Spark checks all filters again."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            match f:
                case EqualTo(("item",), v):
                    self._bound(v, v + 1)
                case GreaterThan(("item",), v):
                    self._bound(v + 1, None)
                case GreaterThanOrEqual(("item",), v):
                    self._bound(v, None)
                case LessThan(("item",), v):
                    self._bound(0, v)
                case LessThanOrEqual(("item",), v):
                    self._bound(0, v + 1)
                case EqualTo(("path",), v):
                    self._named({v})
                case In(("path",), many):
                    self._named(set(many))
            yield f

    def _bound(self, first: int, end: int | None) -> None:
        self.first = max(self.first, first)
        if end is not None:
            self.end = end if self.end is None else min(self.end, end)

    def _named(self, paths: set[str]) -> None:
        self.paths = paths if self.paths is None else self.paths & paths


class ArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessella_arrays"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return (PushingReader if self.options.get("push") == "true" else ArrayReader)(dict(self.options))


def read_arrays(spark: SparkSession, path: str, glob: str = "*", key: str = "masks", first: int = 0, end: int | None = None, partition: int = PARTITION) -> DataFrame:
    """Packed pieces of the arrays in a file, or in the files of a folder and below, that ``glob`` names; items from ``first`` to before ``end``.

    A file without an item gives no rows; one whose header is not understood is an error that names it. Headers are read
    while the query is planned, which suits large files; many small images are better read by ``images.read_images``.
    """
    try:
        spark.dataSource.register(ArraySource)
    except AnalysisException as e:  # by another session of this application
        if e.getCondition() != "DATA_SOURCE_ALREADY_EXISTS":
            raise
    reader = spark.read.format(ArraySource.name()).option("path", path).option("glob", glob).option("key", key).option("first", first).option("partition", partition)
    if end is not None:
        reader = reader.option("end", end)
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true":
        reader = reader.option("push", "true")
    return reader.load()


def unpacked(pieces: DataFrame, keys: tuple[str, ...] = ("path", "item")) -> DataFrame:
    """Rows (keys, y, x, c, v) of packed pieces, each unpacked where it is read."""
    schema = pieces.select(*keys).schema
    for name, kind in (("y", "integer"), ("x", "integer"), ("c", "integer"), ("v", "double")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                y0, x0, height, width, channels, kind = (batch.column(c)[row].as_py() for c in ("y", "x", "height", "width", "channels", "kind"))
                values = np.frombuffer(batch.column("data")[row].as_buffer(), kind).astype(np.float64)
                step = max(1, (1 << 20) // max(1, width * channels))
                for lo in range(0, height, step):
                    tall = min(step, height - lo)
                    y, x, c = (a.ravel().astype(np.int32) for a in np.indices((tall, width, channels)))
                    part = values[lo * width * channels : (lo + tall) * width * channels]
                    taken = pa.array(np.full(len(part), row))
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(taken) for k in keys), pa.array(y + y0 + lo), pa.array(x + x0), pa.array(c), pa.array(part)], schema.names)

    return pieces.select(*keys, *[c for c in ("y", "x", "height", "width", "channels", "kind", "data") if c not in keys]).mapInArrow(run, schema)


def read_planes(spark: SparkSession, path: str, glob: str = "*", key: str = "masks", first: int = 0, end: int | None = None) -> DataFrame:
    """Rows (path, z, y, x, c, v) of the planes of arrays, stacks and frames."""
    return unpacked(read_arrays(spark, path, glob, key, first, end)).withColumn("z", F.col("item").cast("int")).select("path", "z", "y", "x", "c", "v")


def whole(f: io.BytesIO) -> np.ndarray:
    """All pages of a small tif file: rows, columns and any channels of one page, or pages of one size in a stack."""
    found = Pages.of(tiff_pages(f))
    planes = [np.zeros((p.height, p.width, p.channels), p.kind) for p in found.pages]
    for n in range(found.pieces()):
        item, y, x, height, width, channels, kind, data = found.read(f, n)
        planes[item][y : y + height, x : x + width] = np.frombuffer(data, kind).reshape(height, width, channels)
    planes = [p[:, :, 0] if p.shape[2] == 1 else p for p in planes]
    if len({p.shape for p in planes}) > 1:
        raise ValueError("its pages differ in size: read them by read_planes")
    return planes[0] if len(planes) == 1 else np.stack(planes)

