"""Image files as pixel rows: one binary scan, decoded by numpy where the file is read."""

from __future__ import annotations

import gzip
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import is_image, natural_key, stem
from tessella.operators.kernels import by_group
from tessella.sources import arrays


def decode(name: str, data: bytes, key: str = "masks") -> np.ndarray:
    """The array of a file by its ending: npy, npz and mat (by key), png, bmp, pgm or ppm, tif (several pages as planes), nrrd
    (volumes as planes, rows, columns). An unknown ending is an error."""
    kind = name.rsplit(".", 1)[-1].lower()
    if kind == "npy":
        out = np.load(io.BytesIO(data), allow_pickle=False)
        return out
    if kind == "npz":
        return np.load(io.BytesIO(data), allow_pickle=False)[key]
    if kind == "png":
        return _png(data)
    if kind == "bmp":
        return _bmp(data)
    if kind in ("pgm", "ppm"):
        return _netpbm(data)
    if kind in ("tif", "tiff"):
        return arrays.whole(io.BytesIO(data))
    if kind == "nrrd":
        return _nrrd(data)
    if kind == "mat":
        return _mat(data, key)
    raise ValueError(f"unknown kind of image: {name}")


def _png(data: bytes) -> np.ndarray:
    """Grey of any depth (less than eight bits stretched to a byte), colours, and palettes as their colours; not interlaced."""
    at, parts, head, palette = 8, [], None, None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        if kind == b"PLTE":
            palette = np.frombuffer(data[at + 8 : at + 8 + n], np.uint8).reshape(-1, 3)
        if kind == b"IDAT":
            parts.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    width, height, depth, colour, _, _, interlaced = head
    if interlaced:
        raise ValueError("interlaced images are not read")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    step, stride = max(1, channels * depth // 8), -(-width * channels * depth // 8)
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8)[: height * (stride + 1)].reshape(height, stride + 1)
    out = _unfiltered(raw[:, 0], raw[:, 1:].reshape(height, stride // step, step)).reshape(height, stride)
    if depth == 16:
        out = out.view(">u2").astype(np.uint16)
    elif depth < 8:
        bits = np.unpackbits(out, axis=1).reshape(height, -1, depth)
        out = (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8)[:, :width]
        out = out if colour == 3 else out * np.uint8(255 // ((1 << depth) - 1))
    if colour == 3:
        colours = palette[out]
        return colours[:, :, 0] if (palette == palette[:, :1]).all() else colours
    return out.reshape(height, width, channels) if channels > 1 else out


def _unfiltered(kinds: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Rows of bytes (rows, places, bytes of a place) as they were before each was stored as differences.

    Rows that look left only, or up only, are sums. The other two kinds look at three neighbours each; all places on a
    diagonal have theirs on the two diagonals before, so an image is done diagonal by diagonal.
    """
    height, width, size = raw.shape
    if not np.isin(kinds, (3, 4)).any():
        out = np.zeros((height + 1, width, size), np.uint8)
        for y, kind in enumerate(kinds.tolist()):
            line = np.cumsum(raw[y], axis=0, dtype=np.uint8) if kind == 1 else raw[y]
            out[y + 1] = line + out[y] if kind == 2 else line
        return out[1:]
    # a row for each diagonal, a column for each row of the image, with a border of zeros to look back at
    y, x = np.indices((height, width))
    skew = np.zeros((height + width + 1, height + 1, size), np.int16)
    skew[y + x + 2, y + 1] = raw
    left_too, up_too, mean, nearest = ((kinds == k)[:, None] for k in (1, 2, 3, 4))
    for d in range(height + width - 1):
        lo, hi = max(0, d - width + 1), min(height, d + 1)
        now = skew[d + 2, lo + 1 : hi + 1]
        left, up, corner = skew[d + 1, lo + 1 : hi + 1], skew[d + 1, lo:hi], skew[d, lo:hi]
        guess = left + up - corner
        far = [np.abs(guess - v) for v in (left, up, corner)]
        pick = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], up, corner))
        rows = slice(lo, hi)
        now += left * left_too[rows] + up * up_too[rows] + (left + up >> 1) * mean[rows] + pick * nearest[rows]
        now &= 255
    return skew[y + x + 2, y + 1].astype(np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    """Plain rows of 8 bit grey or coloured palettes, or of 24 or 32 bits; bottom up unless the height is negative."""
    start, size = struct.unpack("<I", data[10:14])[0], struct.unpack("<I", data[14:18])[0]
    width, height, _, depth, packed = struct.unpack("<iiHHI", data[18:34])
    if packed not in (0, 3) or depth not in (8, 24, 32):
        raise ValueError("only plain rows of 8, 24 and 32 bits are read")
    stride = (width * depth // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * depth // 8]
    rows = rows[::-1] if height > 0 else rows
    if depth > 8:
        return rows.reshape(abs(height), width, depth // 8)[:, :, 2::-1]
    palette = np.frombuffer(data[14 + size : start], np.uint8).reshape(-1, 4)[:, 2::-1]
    out = palette[rows]
    return out[:, :, 0] if (palette == palette[:, :1]).all() else out


def _netpbm(data: bytes) -> np.ndarray:
    words, at = [], 0
    while len(words) < 4:
        end = at
        while data[end : end + 1].strip():
            end += 1
        words.append(data[at:end])
        at = end + 1
        while data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
    width, height, most = map(int, words[1:])
    values = np.frombuffer(data[at:], ">u2" if most > 255 else np.uint8)
    return values.reshape(height, width, 3) if words[0] == b"P6" else values.reshape(height, width)


#: Types of values by their names in nrrd headers and by their numbers in mat files (fixed values).
NRRD_TYPES = {"int8": "i1", "signed char": "i1", "uint8": "u1", "uchar": "u1", "unsigned char": "u1", "int16": "i2", "short": "i2", "uint16": "u2", "ushort": "u2", "unsigned short": "u2", "int32": "i4", "int": "i4", "uint32": "u4", "uint": "u4", "unsigned int": "u4", "int64": "i8", "uint64": "u8", "float": "f4", "double": "f8"}
MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MAT_MATRIX, MAT_COMPRESSED = 14, 15


def _nrrd(data: bytes) -> np.ndarray:
    """An attached file of raw or gzip values; the first axis of the file counts rows, the second columns, a third planes."""
    head, _, body = data.partition(b"\n\n")
    lines = [x.split(": ", 1) for x in head.decode("ascii", "replace").replace("\r", "").split("\n")[1:] if ": " in x and not x.startswith("#")]
    field = {k.strip().lower(): v.strip() for k, v in lines}
    if field.get("encoding", "raw") not in ("raw", "gzip", "gz") or "data file" in field:
        raise ValueError("only attached raw and gzip values are read")
    order = ">" if field.get("endian") == "big" else "<"
    values = np.frombuffer(body if field.get("encoding", "raw") == "raw" else gzip.decompress(body), order + NRRD_TYPES[field["type"]])
    sizes = [int(n) for n in field["sizes"].split()]
    out = values[: int(np.prod(sizes))].reshape(sizes, order="F")
    return np.moveaxis(out, 2, 0) if out.ndim == 3 else out


def _mat(data: bytes, key: str) -> np.ndarray:
    """The numeric array of that name in a file of version 5."""
    order = "<" if data[126:128] == b"IM" else ">"

    def elements(part: bytes) -> Iterator[tuple[int, bytes]]:
        at = 0
        while at + 8 <= len(part):
            kind, n = struct.unpack(order + "II", part[at : at + 8])
            if kind >> 16:  # up to four bytes lie in the tag itself
                yield kind & 0xFFFF, part[at + 4 : at + 4 + (kind >> 16)]
                at += 8
            else:
                yield kind, part[at + 8 : at + 8 + n]
                at += 8 + n + (-n % 8 if kind != MAT_COMPRESSED else 0)

    def matrices(part: bytes) -> Iterator[bytes]:
        for kind, body in elements(part):
            if kind == MAT_COMPRESSED:
                yield from matrices(zlib.decompress(body))
            elif kind == MAT_MATRIX:
                yield body

    for body in matrices(data[128:]):
        (_, _), (_, sizes), (_, name), *values = elements(body)
        if name.decode("ascii") == key and values and values[0][0] in MAT_TYPES:
            return np.frombuffer(values[0][1], order + MAT_TYPES[values[0][0]]).reshape(np.frombuffer(sizes, order + "i4"), order="F")
    raise KeyError(key)


def archive_members(spark: SparkSession, path: str, glob: str = "*.zip") -> DataFrame:
    """(path, member, content) of the files in zip archives, one row per file; ``decode`` reads them by their names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as archive:
                    for member in archive.infolist():
                        if not member.is_dir():
                            yield pd.DataFrame({"path": [name], "member": [member.filename], "content": [archive.read(member)]})

    return files.mapInPandas(run, "path string, member string, content binary")


def read_volumes(spark: SparkSession, path: str, key: str = "masks", glob: str = "*") -> DataFrame:
    """Voxel rows (path, z, y, x, v) of files that hold planes, rows and columns; a single plane has z 0."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                a = decode(name, bytes(data), key)
                for z, plane in enumerate(a[None] if a.ndim == 2 else a):  # a plane at a time
                    y, x = np.indices(plane.shape)
                    yield pd.DataFrame({"path": name, "z": np.int32(z), "y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32), "v": plane.ravel().astype(np.float64)})

    return files.mapInPandas(run, "path string, z int, y int, x int, v double")


def image_files(spark: SparkSession, path: str, recurse: bool = False) -> DataFrame:
    """Files that are images and not results, with their natural sort key; only names are read, no contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recurse).lower()).load(path).select("path", "length")
    return files.where(is_image(F.col("path"))).withColumns({"key": natural_key(F.col("path")), "stem": stem(F.col("path"))})


def read_images(spark: SparkSession, path: str, key: str = "masks", glob: str = "*", recurse: bool = False) -> DataFrame:
    """Pixel rows (path, y, x, c, v) of image files; a file that cannot be decoded fails its task with its name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recurse).lower()).load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    a = decode(name, bytes(data), key)
                except Exception as e:
                    raise ValueError(f"{name}: {e}") from e
                if a.ndim > 3 or a.ndim == 3 and a.shape[2] > 4:
                    raise ValueError(f"{name}: {a.shape} are no channels but planes: read them by read_volumes or read_planes")
                a = a[:, :, None] if a.ndim == 2 else a
                y, x, c = np.indices(a.shape)
                yield pd.DataFrame({"path": name, "y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32), "c": c.ravel().astype(np.int32), "v": a.ravel().astype(np.float64)})

    return files.mapInPandas(run, "path string, y int, x int, c int, v double")


#: Endings of label files, in the order in which they are tried (fixed values).
LABEL_ENDINGS = ("tif", "tiff", "png", "npy")


def pair_by_stem(images: DataFrame, labels: DataFrame, suffix: str = "_masks", required: bool = True) -> DataFrame:
    """Images with the label file of the same stem and suffix, the first of ``LABEL_ENDINGS``; in one pass over the names.

    Images without one are dropped, or have a null if not ``required``.
    """
    ending = F.regexp_extract("path", r"\.([^./]+)$", 1)
    rank = F.array_position(F.array(*[F.lit(e) for e in LABEL_ENDINGS]), ending)
    named = labels.select(F.regexp_replace(stem(F.col("path")), f"{suffix}$", "").alias("stem"), F.col("path").alias("label_path"), rank.alias("rank")).where(F.endswith(stem(F.col("label_path")), F.lit(suffix)) & (F.col("rank") > 0))
    return images.join(named.groupBy("stem").agg(F.min_by("label_path", "rank").alias("label_path")), "stem", "inner" if required else "left")


def catalogue(annotated: DataFrame, images: DataFrame, order: tuple[str, ...] = ("healthy", "severe")) -> DataFrame:
    """(category, stem, at): annotated files (category, stem) that have an image, by category in the given order, then by stem."""
    place = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("category"))
    return annotated.join(images, ["category", "stem"], "left_semi").where(place > 0).select("category", "stem", place.alias("at"))


def read_label_maps(spark: SparkSession, path: str, key: str = "masks", glob: str = "*") -> DataFrame:
    """Label rows (path, y, x, label): one channel, rounded half to even; more channels are an error."""
    rows = read_images(spark, path, key, glob)
    checked = F.when(F.col("c") > 0, F.raise_error(F.lit("a label map has one channel"))).otherwise(F.rint("v").cast("long"))
    return rows.select("path", "y", "x", checked.alias("label"))


def write_png(labels: np.ndarray) -> bytes:
    """A 16 bit grey image of labels, for maps of fewer than 65536 labels."""
    if labels.max(initial=0) > 65535:
        raise ValueError("too many labels for this format")
    rows = b"".join(b"\0" + r.astype(">u2").tobytes() for r in labels)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", labels.shape[1], labels.shape[0], 16, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def write_tiff(labels: np.ndarray) -> bytes:
    """A 32 bit grey image of labels in one deflated strip, for maps of any number of labels."""
    body = zlib.compress(labels.astype("<u4").tobytes())
    # width, height, bits, packing, meaning of values, place, channels, rows, length and kind of the strip (fixed numbers)
    tags = ((256, labels.shape[1]), (257, labels.shape[0]), (258, 32), (259, 8), (262, 1), (273, 8), (277, 1), (278, labels.shape[0]), (279, len(body)), (339, 1))
    entries = b"".join(struct.pack("<HHII", tag, 4, 1, value) for tag, value in tags)
    return b"II*\0" + struct.pack("<I", 8 + len(body)) + body + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0"


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Voxel rows (path, z, y, x, v) of raw 16 bit frame files whose sidecar of the same stem tells their shape and byte order.

    Files are read by ranges of frames, whatever their size; one whose sidecar is missing or has no shape is an error.
    """
    return arrays.read_planes(spark, path, "*.dax").drop("c")


def ready(files: DataFrame) -> DataFrame:
    """Files that are there and not empty."""
    return files.where(F.col("length") > 0)


def encode_label_maps(labels: DataFrame, img: str = "img", label: str = "label") -> DataFrame:
    """(img, n_labels, kind, content) of label rows: one image per group, as a column that any sink can hold.

    kind is png up to 65,535 labels, tif beyond.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1), np.int64)
        grid[pdf["y"], pdf["x"]] = pdf[label]
        kind, write = ("png", write_png) if grid.max(initial=0) < 65536 else ("tif", write_tiff)
        return pd.DataFrame({img: [pdf[img].iloc[0]], "n_labels": [int((np.unique(grid) > 0).sum())], "kind": [kind], "content": [write(grid)]})

    return by_group(labels.select(img, "y", "x", label), [img], run, f"`{img}` {dict(labels.dtypes)[img]}, n_labels long, kind string, content binary")


def rgb_of_shape(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Pixel rows (path, y, x, c, v) as three bytes per pixel of one shape: other depths are stretched from their smallest
    to their largest value, grey becomes three equal channels, sizes change to the nearest pixel."""
    size = pixels.groupBy("path").agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"), F.max("c").alias("_c"), F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    rows = pixels.join(size, "path").where("c < 3")
    share = F.when(F.col("_hi") > F.col("_lo"), (F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    byte = F.when((F.col("_hi") <= 255) & (F.col("_lo") >= 0), F.col("v")).otherwise(255 * share)
    # target y takes source floor(y * h / height): the targets of a source are a range
    ends = lambda c, n, m: F.sequence(F.ceil(F.col(c) * m / F.col(n)).cast("int"), (F.ceil((F.col(c) + 1) * m / F.col(n)) - 1).cast("int"))
    some = lambda c, n, m: F.ceil((F.col(c) + 1) * m / F.col(n)) > F.ceil(F.col(c) * m / F.col(n))
    kept = rows.where(some("y", "_h", height) & some("x", "_w", width))
    spread = kept.withColumn("_y", F.explode(ends("y", "_h", height))).withColumn("_x", F.explode(ends("x", "_w", width)))
    channels = F.explode(F.when(F.col("_c") == 0, F.array(*[F.lit(k) for k in range(3)])).otherwise(F.array(F.col("c"))))
    return spread.select("path", F.col("_y").alias("y"), F.col("_x").alias("x"), channels.alias("c"), F.floor(byte).cast("int").alias("v"))
