"""Images as packed tiles: a row holds the values of a square as bytes, and neighbours exchange strips, not pixels.

A tile is (keys, by, bx, top, left, height, width, full_height, full_width, kind, data): its number, its place and size,
the size of the image it is part of, and its values row by row, of one numpy kind. An operator that looks at neighbours
widens each tile by a halo of their strips in a single shuffle, in which a tile travels packed and each strip once; then
numpy works on the widened array, and what is left is the tile itself. Steps that follow each other share one exchange
of a wider halo. A task holds a tile and its strips, whatever the size of the image.

Defined results: tiles at the edge of an image are smaller; what lies beyond the edge has the value that the operator
names; a tile whose neighbour is missing sees that value there; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructType

from tessella.operators.labels import LABEL_BITS, components, settle

PLACE = ("by", "bx", "top", "left", "height", "width", "full_height", "full_width")
SIDES = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
Kernel = Callable[[np.ndarray], np.ndarray]


def _schema(rows: DataFrame, keys: Sequence[str], *more: tuple[str, str]) -> StructType:
    out = rows.select(*keys).schema
    for name, kind in (*((c, "integer") for c in PLACE), *more):
        out = out.add(name, kind)
    return out


def _packed(rows: DataFrame, keys: Sequence[str]) -> StructType:
    return _schema(rows, keys, ("kind", "string"), ("data", "binary"))


def _array(batch: pa.RecordBatch | pa.Table, k: int) -> np.ndarray:
    row = {c: batch.column(c)[k].as_py() for c in ("height", "width", "kind")}
    return np.frombuffer(batch.column("data")[k].as_buffer(), row["kind"]).reshape(row["height"], row["width"])


def _batch(batch: pa.RecordBatch | pa.Table, at: Sequence[int], keys: Sequence[str], arrays: Sequence[np.ndarray], **places: Sequence[int]) -> pa.RecordBatch:
    """Tiles in the places of rows of a batch, or in those that are named."""
    taken = pa.array(list(at), pa.int64())
    columns = [batch.column(c).take(taken) for c in keys]
    columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    for c in PLACE:
        given = places.get(c)
        column = pa.array(list(given), pa.int32()) if given is not None else batch.column(c).take(taken)
        columns.append(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    columns += [pa.array([a.dtype.str for a in arrays], pa.string()), pa.array([np.ascontiguousarray(a).tobytes() for a in arrays], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, [*keys, *PLACE, "kind", "data"])


def of_arrays(rows: DataFrame, values: str, height: int, width: int, size: int, keys: Sequence[str] = ("img",), kind: str = "<f8") -> DataFrame:
    """Tiles of images that are arrays of a row each, cut where they are read: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, parts, place = [], [], {c: [] for c in PLACE}
            for k in range(batch.num_rows):
                image = batch.column(values)[k].values.to_numpy(zero_copy_only=False).astype(kind).reshape(height, width)
                for top in range(0, height, size):
                    for left in range(0, width, size):
                        part = image[top : top + size, left : left + size]
                        at.append(k)
                        parts.append(part)
                        for c, v in zip(PLACE, (top // size, left // size, top, left, *part.shape, height, width), strict=True):
                            place[c].append(v)
            yield _batch(batch, at, keys, parts, **place)

    return rows.select(*keys, values).mapInArrow(run, _packed(rows, keys))


def of_pixels(rows: DataFrame, v: str, height: int, width: int, size: int, keys: Sequence[str] = ("img",), kind: str = "<i8") -> DataFrame:
    """Tiles of pixel rows (keys, y, x, v); a pixel without a row is 0. One shuffle of the pixels, by tile."""
    named = rows.select(*keys, F.floor(F.col("y") / size).cast("int").alias("by"), F.floor(F.col("x") / size).cast("int").alias("bx"), "y", "x", F.col(v).alias("v"))

    def run(table: pa.Table) -> pa.Table:
        by, bx = table["by"][0].as_py(), table["bx"][0].as_py()
        top, left = by * size, bx * size
        part = np.zeros((min(size, height - top), min(size, width - left)), kind)
        part[table["y"].to_numpy() - top, table["x"].to_numpy() - left] = table["v"].to_numpy()
        place = dict(zip(PLACE, ([v] for v in (by, bx, top, left, *part.shape, height, width)), strict=True))
        return pa.Table.from_batches([_batch(table, [0], keys, [part], **place)])

    return named.groupBy(*keys, "by", "bx").applyInArrow(run, _packed(rows, keys))


def pixels(tiles: DataFrame, v: str = "v", kind: str = "double", keys: Sequence[str] = ("img",)) -> DataFrame:
    """Pixel rows (keys, y, x, v) of tiles, unpacked where they are."""
    out = tiles.select(*keys).schema
    for name, k in (("y", "integer"), ("x", "integer"), (v, kind)):
        out = out.add(name, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a = _array(batch, k)
                y, x = (i.ravel().astype(np.int32) for i in np.indices(a.shape))
                taken = pa.array(np.full(a.size, k))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(taken) for c in keys), pa.array(y + batch.column("top")[k].as_py()), pa.array(x + batch.column("left")[k].as_py()), pa.array(a.ravel()).cast(types[kind])], [*keys, "y", "x", v])

    types = {"double": pa.float64(), "long": pa.int64(), "integer": pa.int32(), "boolean": pa.bool_()}
    return tiles.mapInArrow(run, out)


def mapped(tiles: DataFrame, step: Kernel, keys: Sequence[str] = ("img",)) -> DataFrame:
    """Tiles with each value changed on its own; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch(batch, range(batch.num_rows), keys, [np.asarray(step(_array(batch, k))) for k in range(batch.num_rows)])

    return tiles.mapInArrow(run, _packed(tiles, keys))


def _cut(a: np.ndarray, dy: int, dx: int, halo: int) -> np.ndarray:
    """The part of a tile next to its neighbour on that side."""
    rows = slice(None) if not dy else slice(0, halo) if dy < 0 else slice(max(0, a.shape[0] - halo), None)
    columns = slice(None) if not dx else slice(0, halo) if dx < 0 else slice(max(0, a.shape[1] - halo), None)
    return a[rows, columns]


def _with_strips(tiles: DataFrame, halo: int, keys: Sequence[str]) -> DataFrame:
    """Tiles (``own``), and the strips that they send to their neighbours, under the neighbour's number and in their own place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a = _array(batch, k)
                by, bx, top, left, high, wide = (batch.column(c)[k].as_py() for c in ("by", "bx", "top", "left", "full_height", "full_width"))
                if (a.shape[0] < halo and top + a.shape[0] < high) or (a.shape[1] < halo and left + a.shape[1] < wide):
                    raise ValueError(f"a halo of {halo} is wider than a tile")
                parts, place = [a], [(by, bx, top, left)]
                for dy, dx in SIDES:
                    if (dy < 0 and top == 0) or (dx < 0 and left == 0) or (dy > 0 and top + a.shape[0] >= high) or (dx > 0 and left + a.shape[1] >= wide):
                        continue
                    part = _cut(a, dy, dx, halo)
                    parts.append(part)
                    place.append((by + dy, bx + dx, top + (a.shape[0] - part.shape[0] if dy > 0 else 0), left + (a.shape[1] - part.shape[1] if dx > 0 else 0)))
                sent = _batch(batch, [k] * len(parts), keys, parts, by=[p[0] for p in place], bx=[p[1] for p in place], top=[p[2] for p in place], left=[p[3] for p in place], height=[p.shape[0] for p in parts], width=[p.shape[1] for p in parts])
                yield sent.append_column("own", pa.array([n == 0 for n in range(len(parts))]))

    return tiles.mapInArrow(run, _packed(tiles, keys).add("own", "boolean"))


def over(tiles: DataFrame, halo: int, step: Callable[..., np.ndarray], keys: Sequence[str] = ("img",), outside: float | None = 0, placed: bool = False) -> DataFrame:
    """Tiles after a step on each with its halo; the step returns an array of the widened shape, of which the tile is kept.

    Beyond the edge of an image lies ``outside``, or with None nothing: the widened array ends there. With ``placed`` the
    step is also given the place (y, x) of the array's first value. One shuffle, of tiles and strips.
    """

    def run(table: pa.Table) -> pa.Table:
        own = np.flatnonzero(table["own"].to_numpy(zero_copy_only=False))
        if not len(own):  # strips for a tile that is not there
            return pa.Table.from_batches([], schema=empty)
        k = int(own[0])
        a = _array(table, k)
        top, left, high, wide = (table[c][k].as_py() for c in ("top", "left", "full_height", "full_width"))
        y0, x0 = top - halo, left - halo
        grid = np.full((a.shape[0] + 2 * halo, a.shape[1] + 2 * halo), 0 if outside is None else outside, a.dtype)
        for n in range(table.num_rows):
            part = _array(table, n)
            y, x = table["top"][n].as_py() - y0, table["left"][n].as_py() - x0
            grid[y : y + part.shape[0], x : x + part.shape[1]] = part
        up, before = halo, halo
        if outside is None:
            up, before = min(halo, top), min(halo, left)
            grid = grid[halo - up : a.shape[0] + halo + min(halo, high - top - a.shape[0]), halo - before : a.shape[1] + halo + min(halo, wide - left - a.shape[1])]
        out = np.asarray(step(grid, (top - up, left - before)) if placed else step(grid))
        return pa.Table.from_batches([_batch(table, [k], keys, [out[up : up + a.shape[0], before : before + a.shape[1]]])])

    schema = _packed(tiles, keys)
    empty = to_arrow_schema(schema)
    return _with_strips(tiles, halo, keys).groupBy(*keys, "by", "bx").applyInArrow(run, schema)


def shifted(a: np.ndarray, dy: int, dx: int, outside: float = 0) -> np.ndarray:
    """The value of each place's neighbour at (dy, dx)."""
    out = np.full(a.shape, outside, a.dtype)
    out[max(0, -dy) : a.shape[0] - max(0, dy), max(0, -dx) : a.shape[1] - max(0, dx)] = a[max(0, dy) : a.shape[0] - max(0, -dy), max(0, dx) : a.shape[1] - max(0, -dx)]
    return out


CROSS = ((-1, 0), (0, -1), (0, 1), (1, 0))


def inner(tiles: DataFrame, keys: Sequence[str] = ("img",)) -> DataFrame:
    """Labels whose four neighbours have the same label; all else, and what lies at the edge of the image, is 0."""
    return over(tiles, 1, lambda a: np.where(np.logical_and.reduce([shifted(a, dy, dx, -1) == a for dy, dx in CROSS]), a, 0), keys, outside=-1)


def bordered(tiles: DataFrame, keys: Sequence[str] = ("img",)) -> DataFrame:
    """1 where a neighbour within the image, of four, has another label."""

    def step(a: np.ndarray, at: tuple[int, int]) -> np.ndarray:
        out = np.zeros(a.shape, bool)
        out[:-1] |= a[:-1] != a[1:]
        out[1:] |= a[1:] != a[:-1]
        out[:, :-1] |= a[:, :-1] != a[:, 1:]
        out[:, 1:] |= a[:, 1:] != a[:, :-1]
        return out.astype("<i8")

    return over(tiles, 1, step, keys, outside=None, placed=True)


def dilated(tiles: DataFrame, steps: int = 1, keys: Sequence[str] = ("img",)) -> DataFrame:
    """Steps of a 3 x 3 dilation that overwrite background only, the larger label first; one exchange for all steps."""

    def step(a: np.ndarray) -> np.ndarray:
        for _ in range(steps):
            most = np.maximum.reduce([shifted(a, dy, dx) for dy, dx in SIDES])
            a = np.where(a > 0, a, most)
        return a

    return over(tiles, steps, step, keys, outside=None)


def pooled(tiles: DataFrame, reach: int, keys: Sequence[str] = ("img",)) -> DataFrame:
    """The largest value within ``reach`` rows and columns: two passes of one axis, in the image only."""

    def step(a: np.ndarray) -> np.ndarray:
        low = -np.inf if a.dtype.kind == "f" else np.iinfo(a.dtype).min
        for move in ((1, 0), (0, 1)):
            a = np.maximum.reduce([shifted(a, k * move[0], k * move[1], low) for k in range(-reach, reach + 1)])
        return a

    return over(tiles, reach, step, keys, outside=None)


def smoothed(tiles: DataFrame, reach: int, keys: Sequence[str] = ("img",)) -> DataFrame:
    """The mean over ``reach`` rows and columns on each side, over what lies in the image."""

    def step(a: np.ndarray) -> np.ndarray:
        out = []
        for b in (a.astype(float), np.ones(a.shape)):
            for move in ((1, 0), (0, 1)):
                b = np.add.reduce([shifted(b, k * move[0], k * move[1]) for k in range(-reach, reach + 1)])
            out.append(b)
        return out[0] / out[1]

    return over(tiles, reach, step, keys, outside=None)


def gradient(tiles: DataFrame, keys: Sequence[str] = ("img",)) -> DataFrame:
    """The length of the gradient by the usual 3 x 3 weights; the image is mirrored at its edge, without repeating it."""

    def step(a: np.ndarray) -> np.ndarray:
        p = np.pad(a.astype(float), 1, mode="reflect")
        across = p[:, 2:] - p[:, :-2]
        along = p[:, 2:] + 2 * p[:, 1:-1] + p[:, :-2]
        return np.hypot(across[2:] + 2 * across[1:-1] + across[:-2], along[2:] - along[:-2])

    return over(tiles, 1, step, keys, outside=None)


def run_blocks(tiles: DataFrame, kernel: Kernel, halo: int = 0, keys: Sequence[str] = ("img",), steps: Sequence[Kernel] = ()) -> DataFrame:
    """Tiles of the labels that a kernel gives each tile with its halo, after the steps in turn."""

    def run(a: np.ndarray) -> np.ndarray:
        for step in steps:
            a = step(a)
        return np.asarray(kernel(a)).astype("<i8")

    return over(tiles, halo, run, keys, outside=None) if halo else mapped(tiles, run, keys)


def global_labels(tiles: DataFrame, down: int, across: int, keys: Sequence[str] = ("img",)) -> DataFrame:
    """Labels of tiles as ids that no two tiles share: the number of the tile over all images, then 32 bits of label; 0 stays 0.

    ``down`` and ``across`` are the most rows and columns of tiles of any image; the first key is the number of the image.
    Ids are ordered by image, row and column of the tile. A label, or the number of a tile, that does not fit is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                a = _array(batch, k).astype("<i8")
                img, by, bx = (batch.column(c)[k].as_py() for c in (keys[0], "by", "bx"))
                block = (img * down + by) * across + bx
                if a.max(initial=0) >= 1 << LABEL_BITS or a.min(initial=0) < 0 or not 0 <= block < 1 << 63 - LABEL_BITS:
                    raise ValueError(f"image {img}, tile {by}, {bx}: a label or the number of the tile does not fit an id")
                out.append(np.where(a > 0, (block << LABEL_BITS) | a, 0))
            yield _batch(batch, range(batch.num_rows), keys, out)

    return tiles.mapInArrow(run, _packed(tiles, keys))


def faces(tiles: DataFrame, keys: Sequence[str] = ("img",)) -> DataFrame:
    """Different pairs (keys, a, b) of ids that touch across the right or lower face of a tile; only faces are shuffled."""
    schema = tiles.select(*keys).schema
    for name, kind in (("way", "integer"), ("by", "integer"), ("bx", "integer"), ("near", "boolean"), ("line", ArrayType(LongType()))):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, way, by, bx, near, line = [], [], [], [], [], []
            for k in range(batch.num_rows):
                a = _array(batch, k)
                y, x = batch.column("by")[k].as_py(), batch.column("bx")[k].as_py()
                for w, first, place, values in ((0, True, (y, x + 1), a[:, -1]), (0, False, (y, x), a[:, 0]), (1, True, (y + 1, x), a[-1]), (1, False, (y, x), a[0])):
                    if values.any():
                        at.append(k), way.append(w), by.append(place[0]), bx.append(place[1]), near.append(first), line.append(values)
            taken, ends = pa.array(at, pa.int64()), pa.array(np.cumsum([0, *map(len, line)]).astype(np.int32))
            lines = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int64), *line]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(taken) for c in keys), pa.array(way, pa.int32()), pa.array(by, pa.int32()), pa.array(bx, pa.int32()), pa.array(near, pa.bool_()), lines], schema.names)

    lines = tiles.mapInArrow(run, schema)
    met = lines.groupBy(*keys, "way", "by", "bx").agg(F.max_by("line", "near").alias("first"), F.min_by("line", "near").alias("second"), F.count("*").alias("n")).where("n = 2")
    pairs = met.select(*keys, F.explode(F.array_distinct(F.arrays_zip(F.col("first").alias("a"), F.col("second").alias("b")))).alias("p"))
    return pairs.select(*keys, F.col("p.a").alias("a"), F.col("p.b").alias("b")).where("a > 0 and b > 0").distinct()


def relabelled(tiles: DataFrame, roots: DataFrame, keys: Sequence[str] = ("img",)) -> DataFrame:
    """Tiles whose ids are replaced by the roots of those that have one: (node, root), sent to the tile that holds the node.

    Only nodes at faces have roots other than themselves, so few rows travel; tiles travel packed.
    """
    block = F.shiftright("node", LABEL_BITS)
    listed = roots.where("node <> root").groupBy(block.alias("_block")).agg(F.collect_list(F.struct("node", "root")).alias("_roots"))
    numbered = tiles.mapInArrow(_numbered(keys), _packed(tiles, keys).add("_block", "long"))
    joined = numbered.join(listed, "_block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                a, pairs = _array(batch, k), batch.column("_roots")[k].values
                if pairs is not None:
                    node, root = pairs.field("node").to_numpy(), pairs.field("root").to_numpy()
                    order = np.argsort(node)
                    node, root = node[order], root[order]
                    at = np.minimum(np.searchsorted(node, a), len(node) - 1)
                    a = np.where(node[at] == a, root[at], a)
                out.append(a)
            yield _batch(batch, range(batch.num_rows), keys, out)

    return joined.mapInArrow(run, _packed(tiles, keys))


def _numbered(keys: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the number of the tile, read from any id in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [int(_array(batch, k).max(initial=0)) >> LABEL_BITS for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*keys, *PLACE, "kind", "data"]), pa.array(blocks, pa.int64())], [*keys, *PLACE, "kind", "data", "_block"])

    return run


def measured(tiles: DataFrame, keys: Sequence[str] = ("img",)) -> DataFrame:
    """(keys, label, area, r0, r1, c0, c1) of each label over all tiles; a row for each tile and label is shuffled."""
    out = tiles.select(*keys).schema
    for c in ("label", "area", "r0", "r1", "c0", "c1"):
        out = out.add(c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a = _array(batch, k)
                y, x = np.nonzero(a)
                names, at, n = np.unique(a[y, x], return_inverse=True, return_counts=True)
                r0, c0 = np.full(len(names), a.shape[0]), np.full(len(names), a.shape[1])
                r1, c1 = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
                np.minimum.at(r0, at, y), np.minimum.at(c0, at, x), np.maximum.at(r1, at, y + 1), np.maximum.at(c1, at, x + 1)
                top, left = batch.column("top")[k].as_py(), batch.column("left")[k].as_py()
                taken = pa.array(np.full(len(names), k))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(taken) for c in keys), *(pa.array(v.astype(np.int64)) for v in (names, n, r0 + top, r1 + top, c0 + left, c1 + left))], out.names)

    parts = tiles.mapInArrow(run, out)
    return parts.groupBy(*keys, "label").agg(F.sum("area").alias("area"), F.min("r0").alias("r0"), F.max("r1").alias("r1"), F.min("c0").alias("c0"), F.max("c1").alias("c1"))


def joined(tiles: DataFrame, keys: Sequence[str] = ("img",)) -> DataFrame:
    """Labels of tiles joined where they touch across faces; a joined label is the smallest id of its parts.

    The graph has the labels that touch a face and no others; tiles are computed once, into the checkpoint folder.
    """
    kept = settle(tiles)
    down, across = kept.agg(F.max("by"), F.max("bx")).first()
    ids = global_labels(kept, 1 + (down or 0), 1 + (across or 0), keys)
    edges = settle(faces(ids, keys).select("a", "b"))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    return relabelled(ids, components(edges, nodes), keys)
