"""Arrays read by ranges, tif and png files of every kind that is read, and what is refused."""

from __future__ import annotations

import io
import os
import struct
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.sources import arrays, datasets, images


def tif(pages, packing=1, predictor=1, tile=None, rows=None, planar=False, big=False, end="<"):
    """A tif file of pages (rows, columns, channels), as strips of ``rows`` or tiles of ``tile``."""
    offset, count, entry = ("Q", "Q", "HHQQ") if big else ("I", "H", "HHII")
    out = bytearray((b"II" if end == "<" else b"MM") + struct.pack(end + "H", 43 if big else 42) + (struct.pack(end + "HHQ", 8, 0, 0) if big else struct.pack(end + "I", 0)))
    link = 8 if big else 4
    for page in pages:
        page = page[:, :, None] if page.ndim == 2 else page
        height, width, channels = page.shape
        tall, wide = tile or (rows or height, width)
        layers = [page[:, :, k : k + 1] for k in range(channels)] if planar else [page]
        places, sizes = [], []
        for layer in layers:
            for y in range(0, height, tall):
                for x in range(0, width, wide):
                    part = layer[y : y + tall, x : x + wide]
                    if tile:
                        part = np.pad(part, ((0, tall - part.shape[0]), (0, wide - part.shape[1]), (0, 0)))
                    if predictor == 2:
                        part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], 1)
                    raw = np.ascontiguousarray(part).astype(part.dtype.newbyteorder(end)).tobytes()
                    if predictor == 3:
                        split = np.ascontiguousarray(part.astype(part.dtype.newbyteorder(">"))).view(np.uint8).reshape(part.shape[0], -1, part.dtype.itemsize)
                        line = split.transpose(0, 2, 1).reshape(part.shape[0], -1, part.shape[2])
                        raw = np.concatenate([line[:, :1], line[:, 1:] - line[:, :-1]], 1).tobytes()
                    raw = {1: lambda b: b, 8: zlib.compress, 32773: pack_bits, 5: pack_lzw}[packing](raw)
                    places.append(len(out))
                    sizes.append(len(raw))
                    out += raw
        kind = {"u": 1, "i": 2, "f": 3}[page.dtype.kind]
        fields = [(256, [width]), (257, [height]), (258, [8 * page.dtype.itemsize] * channels), (259, [packing]), (277, [channels]), (284, [2 if planar else 1]), (317, [predictor]), (339, [kind] * channels)]
        fields += [(322, [wide]), (323, [tall]), (324, places), (325, sizes)] if tile else [(278, [tall]), (273, places), (279, sizes)]
        entries = b""
        for tag, values in sorted(fields):
            data = struct.pack(f"{end}{len(values)}I", *values)
            if len(data) > struct.calcsize(offset):
                entries += struct.pack(end + entry, tag, 4, len(values), len(out))
                out += data
            else:
                entries += struct.pack(end + entry[:3], tag, 4, len(values)) + data.ljust(struct.calcsize(offset), b"\0")
        out[link : link + struct.calcsize(end + offset)] = struct.pack(end + offset, len(out))
        out += struct.pack(end + count, len(fields)) + entries
        link = len(out)
        out += struct.pack(end + offset, 0)
    return bytes(out)


def pack_bits(raw):
    return b"".join(bytes([len(raw[i : i + 100]) - 1]) + raw[i : i + 100] for i in range(0, len(raw), 100))


def pack_lzw(raw):
    """Codes of a growing table, as written by the format's own rule."""
    bits, table, word = [], {bytes([k]): k for k in range(256)}, b""

    def put(code):
        size = len(table) + 2  # two codes are reserved
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        bits.append(f"{code:0{width}b}")

    put(256)
    for b in raw:
        if word + bytes([b]) in table:
            word += bytes([b])
            continue
        put(table[word])
        table[word + bytes([b])] = len(table) + 2
        word = bytes([b])
        if len(table) + 2 >= 4094:
            put(table[word])
            put(256)
            table, word = {bytes([k]): k for k in range(256)}, b""
    if word:
        put(table[word])
    put(257)
    text = "".join(bits)
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


@pytest.mark.parametrize("dtype", ["u1", "u2", "i4", "f4", "f8"])
@pytest.mark.parametrize("how", [{}, {"packing": 8}, {"packing": 8, "predictor": 2}, {"packing": 32773, "rows": 7}, {"packing": 5, "rows": 16, "predictor": 2}, {"tile": (16, 16), "packing": 8}, {"tile": (16, 32), "planar": True}, {"big": True, "rows": 5}, {"end": ">", "packing": 8, "predictor": 2}, {"packing": 8, "predictor": 3, "rows": 9}])
def test_tif_of_every_kind(dtype, how):
    if (how.get("predictor") == 3) != (dtype[0] == "f") and how.get("predictor", 1) != 1:
        pytest.skip("a predictor of other values")
    rng = np.random.default_rng(1)
    for channels in (1, 3):
        pages = [(rng.random((37, 45, channels)) * 200).astype(dtype) for _ in range(3)]
        got = images.decode("x.tif", tif(pages, **how))
        want = np.stack(pages)
        assert got.shape == (want[..., 0] if channels == 1 else want).shape
        assert (got == (want[..., 0] if channels == 1 else want)).all()


def test_tif_refuses_what_it_does_not_know():
    a = np.zeros((4, 4), np.uint8)
    data = tif([a])
    for tag, value, message in ((259, 7, "packing 7"), (317, 9, "predictor 9"), (258, 1, "values of"), (339, 6, "values of")):
        at = data.index(struct.pack("<HHI", tag, 4, 1)) + 8
        with pytest.raises(ValueError, match=message):
            images.decode("x.tif", data[:at] + struct.pack("<I", value) + data[at + 4 :])
    at = data.index(struct.pack("<HHI", 279, 4, 1)) + 8
    with pytest.raises(ValueError, match="ends before"):
        images.decode("x.tif", data[:at] + struct.pack("<I", 3) + data[at + 4 :])
    with pytest.raises(ValueError, match="differ in size"):
        images.decode("x.tif", tif([a, np.zeros((5, 4), np.uint8)]))


def test_stacks_by_pages(spark, tmp_path):
    rng = np.random.default_rng(2)
    stack = [rng.integers(0, 1000, (20, 30)).astype(np.uint16) for _ in range(11)]
    (tmp_path / "s.tif").write_bytes(tif(stack, packing=8, predictor=2, rows=6))
    rows = images.read_volumes(spark, str(tmp_path)).toPandas().sort_values(["z", "y", "x"])
    assert (rows["v"].to_numpy().reshape(11, 20, 30) == np.stack(stack)).all()
    part = arrays.read_arrays(spark, str(tmp_path), first=3, end=5, partition=1)
    assert part.rdd.getNumPartitions() == 2 * 4  # four strips to a page, each a partition of its own
    got = arrays.unpacked(part).toPandas().sort_values(["item", "y", "x"])
    assert (got["v"].to_numpy().reshape(2, 20, 30) == np.stack(stack[3:5])).all()
    with pytest.raises(Exception, match="read them by read_volumes"):
        images.read_images(spark, str(tmp_path)).count()


def test_pages_of_different_sizes(spark, tmp_path):
    a, b = np.arange(12, dtype=np.uint8).reshape(3, 4), np.arange(10, dtype=np.uint8).reshape(5, 2)
    (tmp_path / "s.tif").write_bytes(tif([a, b]))
    got = arrays.read_planes(spark, str(tmp_path)).toPandas().sort_values(["z", "y", "x"])
    assert got["v"].tolist() == [*a.ravel(), *b.ravel()]


def test_folds_beyond_two_gigabytes(spark, tmp_path):
    """A sparse file of 2,800 samples of 256 x 256 x 3 halves of doubles: 2.2 GB, of which ten samples hold something."""
    shape, path = (2800, 256, 256, 3), tmp_path / "fold2.npy"
    with open(path, "wb") as f:
        np.lib.format.write_array_header_1_0(f, {"descr": "<f4", "fortran_order": False, "shape": shape})
        begin, each = f.tell(), 4 * 256 * 256 * 3
        for k in range(0, 2800, 280):
            f.seek(begin + k * each)
            f.write(np.full(256 * 256 * 3, k + 1, "<f4").tobytes())
        f.truncate(begin + 2800 * each)
    assert os.path.getsize(path) > 1 << 31
    pieces = arrays.read_arrays(spark, str(tmp_path))
    assert pieces.rdd.getNumPartitions() > 20
    first = pieces.select("item", F.conv(F.hex(F.substring("data", 1, 4)), 16, 10).cast("long").alias("bits")).where("bits > 0")
    assert sorted(r["item"] for r in first.collect()) == list(range(0, 2800, 280))
    began = time.time()
    last = datasets.fold_samples(spark, str(tmp_path), first=2520, end=2521).agg(F.min("v"), F.max("v"), F.count("*"), F.min("sample_id")).first()
    assert tuple(last) == (2521.0, 2521.0, 256 * 256 * 3, "fold2_02520")
    assert time.time() - began < 30


def test_filters_prune_ranges(spark, tmp_path):
    for name in ("a", "b"):
        np.save(tmp_path / f"{name}.npy", np.arange(600, dtype=np.int16).reshape(100, 2, 3))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = arrays.read_arrays(spark, str(tmp_path), partition=120).where(f"item >= 90 and item < 93 and path = '{tmp_path}/b.npy'")
        assert [(r["item"], r["path"][-5:]) for r in rows.collect()] == [(90, "b.npy"), (91, "b.npy"), (92, "b.npy")]
        assert rows.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert arrays.read_arrays(spark, str(tmp_path), partition=120).rdd.getNumPartitions() == 20


def test_members_and_frames(spark, tmp_path):
    a = np.arange(60, dtype=np.uint32).reshape(5, 3, 4)
    np.savez(tmp_path / "stored.npz", other=a + 1, masks=a)
    np.savez_compressed(tmp_path / "packed.npz", masks=a)
    for name in ("stored", "packed"):
        got = arrays.read_planes(spark, str(tmp_path), glob=f"{name}.npz", first=1, end=4).toPandas().sort_values(["z", "y", "x"])
        assert got["v"].tolist() == a[1:4].ravel().tolist() and sorted(set(got["z"])) == [1, 2, 3]
    (tmp_path / "f.dax").write_bytes(a.astype(">u2").tobytes())
    (tmp_path / "f.inf").write_text("frame dimensions = 3 x 4\n")
    assert images.read_frames(spark, str(tmp_path)).toPandas().sort_values(["z", "y", "x"])["v"].tolist() == a.ravel().tolist()


def test_empty_and_odd_arrays(spark, tmp_path):
    np.save(tmp_path / "none.npy", np.empty((0, 2, 3)))
    assert arrays.read_planes(spark, str(tmp_path)).count() == 0
    np.save(tmp_path / "none.npy", np.empty(7))
    with pytest.raises(Exception, match="1 axes"):
        arrays.read_planes(spark, str(tmp_path)).count()
    np.save(tmp_path / "none.npy", np.asfortranarray(np.ones((3, 4))))
    with pytest.raises(Exception, match="columns before rows"):
        arrays.read_planes(spark, str(tmp_path)).count()


def png(raw_rows, width, height, depth, colour, extra=b""):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + b"\0\0\0\0"
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(raw_rows)) + chunk(b"IEND", b"")


def filtered(a, kinds):
    """Rows of bytes with the filter of each, by the definition of the format, byte by byte."""
    height, width, size = a.shape
    out = b""
    for y in range(height):
        line = []
        for i in range(width * size):
            x, c = divmod(i, size)
            left, up, corner = int(a[y, x - 1, c]) if x else 0, int(a[y - 1, x, c]) if y else 0, int(a[y - 1, x - 1, c]) if x and y else 0
            nearest = min((left, up, corner), key=lambda v: abs(left + up - corner - v))
            line.append(int(a[y, x, c]) - (0, left, up, (left + up) // 2, nearest)[kinds[y]] & 255)
        out += bytes([kinds[y], *line])
    return out


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.sampled_from([1, 2, 3, 4]), st.data())
def test_png_filters_of_all_kinds(height, width, channels, data):
    a = np.array(data.draw(st.lists(st.integers(0, 255), min_size=height * width * channels, max_size=height * width * channels)), np.uint8).reshape(height, width, channels)
    kinds = data.draw(st.lists(st.integers(0, 4), min_size=height, max_size=height))
    got = images.decode("x.png", png(filtered(a, kinds), width, height, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels]))
    assert (got.reshape(a.shape) == a).all()


@pytest.mark.parametrize("kind", [1, 2, 3, 4])
def test_png_speed(kind):
    rng = np.random.default_rng(3)
    raw = np.concatenate([np.full((512, 1), kind, np.uint8), rng.integers(0, 256, (512, 512 * 3)).astype(np.uint8)], 1).tobytes()
    data = png(raw, 512, 512, 8, 2)
    images.decode("x.png", data)
    began = time.process_time()
    images.decode("x.png", data)
    assert time.process_time() - began < 0.5


@pytest.mark.parametrize("depth", [1, 2, 4, 8])
def test_png_palettes_and_few_bits(depth):
    rng = np.random.default_rng(4)
    values = rng.integers(0, 1 << depth, (5, 11))
    bits = (values[:, :, None] >> np.arange(depth - 1, -1, -1) & 1).astype(np.uint8).reshape(5, -1)
    packed = np.packbits(bits, axis=1)
    raw = filtered(packed[:, :, None], [0, 1, 2, 3, 4])
    colours = rng.integers(0, 256, (1 << depth, 3)).astype(np.uint8)
    body = colours.tobytes()
    palette = struct.pack(">I", len(body)) + b"PLTE" + body + b"\0\0\0\0"
    assert (images.decode("x.png", png(raw, 11, 5, depth, 3, palette)) == colours[values]).all()
    assert (images.decode("x.png", png(raw, 11, 5, depth, 0)) == values * (255 // ((1 << depth) - 1))).all()


def test_codes_round_trip():
    rng = np.random.default_rng(5)
    for n in (0, 1, 300, 20_000):
        raw = rng.integers(0, 4, n).astype(np.uint8).tobytes()
        assert arrays.unpack_lzw(pack_lzw(raw)) == raw and arrays.unpack_bits(pack_bits(raw)) == raw
    assert arrays.unpack_bits(bytes([254, 7, 128, 1, 5, 6])) == b"\7\7\7\5\6"
    assert io.BytesIO(b"").read() == b""
