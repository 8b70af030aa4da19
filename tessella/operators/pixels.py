"""Pixel expressions and neighbourhoods over rows (img, y, x, v)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.percentiles import percentiles


def sigmoid(v: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), v))))


def to_byte(share: Column) -> Column:
    """0 to 255 of a share of 1, cut off rather than rounded."""
    return F.floor(255 * share).cast("int")


def threshold(byte: Column, share: float) -> Column:
    """0 below the share of 255, rounded half to even."""
    return F.when(byte < F.rint(F.lit(255 * share)), 0).otherwise(byte)


def stretch(rows: DataFrame, v: str, keys: Sequence[str] = ("img",), where: Column | None = None) -> Column:
    """Linear stretch of each group to 0..255, by the smallest and largest value where ``where`` holds (else of all), 0 outside and if flat."""
    w = Window.partitionBy(*keys)
    seen = F.when(where, F.col(v)) if where is not None else F.col(v)
    lo, hi = F.coalesce(F.min(seen).over(w), F.min(v).over(w)), F.coalesce(F.max(seen).over(w), F.max(v).over(w))
    out = F.when(hi > lo + 1e-8, F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col(v) - lo) / (hi - lo) * 255).cast("int")))).otherwise(0)
    return F.when(where, out).otherwise(0) if where is not None else out


def normalise(rows: DataFrame, v: str = "v", lower: float = 0.01, upper: float = 0.99, keys: Sequence[str] = ("img",)) -> DataFrame:
    """Percentile stretch of each group with interpolated percentiles; a flat group becomes 0."""
    ends = percentiles(rows, v, (lower, upper), keys)
    joined = rows.join(ends, list(keys))
    lo, hi = F.col("p")[0], F.col("p")[1]
    return joined.withColumn("norm", F.when(hi - lo > 1e-3, (F.col(v) - lo) / (hi - lo)).otherwise(0.0)).drop("p")


def otsu(rows: DataFrame, byte: str, keys: Sequence[str] = ("img",)) -> DataFrame:
    """The threshold of each group with the largest variance between its classes, the smallest of equal ones.

    Works on the histogram of at most 256 rows per group, not on the pixels.
    """
    hist = rows.groupBy(*keys, byte).agg(F.count("*").alias("n"))
    upto, every = Window.partitionBy(*keys).orderBy(byte).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    sums = hist.withColumns({"w": F.sum("n").over(upto), "m": F.sum(F.col("n") * F.col(byte)).over(upto), "total": F.sum("n").over(every), "mean": F.sum(F.col("n") * F.col(byte)).over(every)})
    w, rest = F.col("w"), F.col("total") - F.col("w")
    gap = F.col("m") / w - (F.col("mean") - F.col("m")) / F.nullif(rest, F.lit(0))
    return sums.withColumn("between", F.coalesce(F.round(w * rest * gap * gap, 6), F.lit(0.0))).groupBy(*keys).agg(F.max_by(byte, F.struct("between", -F.col(byte))).alias("t"))


def max_pool(rows: DataFrame, v: str, radius: int, keys: Sequence[str] = ("img",)) -> DataFrame:
    """Largest value of the square around each pixel, in two separable passes; the image edge cuts the square."""
    row, column = Window.partitionBy(*keys, "y").orderBy("x").rangeBetween(-radius, radius), Window.partitionBy(*keys, "x").orderBy("y").rangeBetween(-radius, radius)
    return rows.withColumn("pool", F.max(v).over(row)).withColumn("pool", F.max("pool").over(column))


def smooth(rows: DataFrame, v: str, weights: Sequence[float], keys: Sequence[str] = ("img",)) -> DataFrame:
    """Separable weighted mean with an odd kernel; pixels outside the image have no weight."""
    half = len(weights) // 2
    out = rows
    for name, w, source in (("across", Window.partitionBy(*keys, "y").orderBy("x"), v), ("smooth", Window.partitionBy(*keys, "x").orderBy("y"), "across")):
        near = [(F.lead(source, k).over(w) if k else F.col(source), weights[half + k]) for k in range(-half, half + 1)]
        top, bottom = F.lit(0.0), F.lit(0.0)
        for n, weight in near:
            top, bottom = top + F.coalesce(n, F.lit(0.0)) * weight, bottom + F.when(n.isNotNull(), weight).otherwise(0.0)
        out = out.withColumn(name, top / bottom)
    return out.drop("across")


def gradient(rows: DataFrame, v: str, keys: Sequence[str] = ("img",)) -> DataFrame:
    """Magnitude of the 3x3 Sobel gradient, with mirrored edges (the edge pixel itself is not repeated)."""
    def at(name: str, w: Window, k: int) -> Column:
        return F.coalesce(F.lead(name, k).over(w), F.lead(name, -k).over(w))

    row, column = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    out = rows.withColumns({"dx_": at(v, row, 1) - at(v, row, -1), "sx_": at(v, row, 1) + 2 * F.col(v) + at(v, row, -1)})
    gx = at("dx_", column, 1) + 2 * F.col("dx_") + at("dx_", column, -1)
    gy = at("sx_", column, 1) - at("sx_", column, -1)
    return out.withColumns({"gx": gx, "gy": gy}).withColumn("grad", F.hypot("gx", "gy")).drop("dx_", "sx_")


def _targets(c: str, n: int, m: int) -> Column:
    """The targets k of m whose source floor(k n / m) is this place of n: a range, which may be empty."""
    first, last = F.ceil(F.col(c) * m / n).cast("int"), (F.ceil((F.col(c) + 1) * m / n) - 1).cast("int")
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def resize_nearest(rows: DataFrame, height: int, width: int, to_height: int, to_width: int) -> DataFrame:
    """Nearest-neighbour resize: every target pixel takes the source pixel floor(y * height / to_height)."""
    return rows.withColumn("ty", F.explode(_targets("y", height, to_height))).withColumn("tx", F.explode(_targets("x", width, to_width)))


def resize_bilinear(rows: DataFrame, v: str, height: int, width: int, to_height: int, to_width: int, keys: Sequence[str] = ("img",)) -> DataFrame:
    """Bilinear resize with pixel centres: two passes, columns and then rows; a target is the weighted sum of the two sources around it.

    The targets that a source reaches are those whose centre falls within one source of it: a range. The first pass is
    summed where rows are before it is shuffled, and the axis that shrinks more goes first.
    """

    def one(df: DataFrame, c: str, out: str, n: int, m: int, rest: Sequence[str]) -> DataFrame:
        scale = n / m
        target = lambda k: F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), (k + 0.5) * scale - 0.5))
        # a little wider than what reaches: weights of zero are dropped; the ends also serve what lies beyond them
        first = F.when(F.col(c) == 0, 0).otherwise(F.greatest(F.lit(0), F.floor((F.col(c) - 0.5) / scale - 0.5).cast("int") - 1))
        last = F.when(F.col(c) == n - 1, m - 1).otherwise(F.least(F.lit(m - 1), F.ceil((F.col(c) + 1.5) / scale - 0.5).cast("int") + 1))
        reached = F.filter(F.transform(F.sequence(first, last), lambda k: F.struct(k.alias("at"), (1 - F.abs(target(k) - F.col(c))).alias("w"))), lambda s: s["w"] > 0)
        return df.withColumn("_s", F.explode(reached)).groupBy(*keys, *rest, F.col("_s.at").alias(out)).agg(F.sum(F.col(v) * F.col("_s.w")).alias(v))

    if to_height * width <= height * to_width:
        return one(one(rows, "y", "ty", height, to_height, ["x"]), "x", "tx", width, to_width, ["ty"]).select(*keys, "ty", "tx", v)
    return one(one(rows, "x", "tx", width, to_width, ["y"]), "y", "ty", height, to_height, ["tx"]).select(*keys, "ty", "tx", v)


def taper(i: Column, n: int, sigma: float, half: float) -> Column:
    """Weight of place i of a tile side of n: near 1 inside, falling at ``half`` from the middle."""
    return 1 / (1 + F.exp((F.abs(i - (n - 1) / 2) - half) / sigma))


def tiles(rows: DataFrame, size: int, step: int, height: int, width: int) -> DataFrame:
    """Each pixel once for every tile (ty, tx) of ``size`` at multiples of ``step`` that covers it, with its place (ly, lx)."""

    def starts(c: str, n: int) -> Column:
        first, last = F.greatest(F.lit(0), F.ceil((F.col(c) - size + 1) / step).cast("int")), F.least(F.floor(F.col(c) / step).cast("int"), F.lit((n - size) // step))
        return F.explode(F.when(first <= last, F.transform(F.sequence(first, last), lambda k: k * step)).otherwise(F.array().cast("array<int>")))

    out = rows.withColumn("ty", starts("y", height)).withColumn("tx", starts("x", width))
    return out.withColumns({"ly": F.col("y") - F.col("ty"), "lx": F.col("x") - F.col("tx")})


def average_tiles(tiled: DataFrame, v: str, weight: Column, keys: Sequence[str] = ("img",)) -> DataFrame:
    return tiled.groupBy(*keys, "y", "x").agg((F.sum(F.col(v) * weight) / F.sum(weight)).alias(v))


def run_lengths(foreground: DataFrame, position: str, keys: Sequence[str] = ("img",)) -> DataFrame:
    """Runs (start, length) of foreground positions: positions minus their rank are equal within a run."""
    island = F.col(position) - F.row_number().over(Window.partitionBy(*keys).orderBy(position))
    return foreground.withColumn("island", island).groupBy(*keys, "island").agg(F.min(position).alias("start"), F.count("*").alias("length")).drop("island")


def from_runs(runs: DataFrame, keys: Sequence[str] = ("img",)) -> DataFrame:
    return runs.select(*keys, F.explode(F.sequence(F.col("start"), (F.col("start") + F.col("length") - 1).cast("int"))).alias("pos"))


def evenly(rows: DataFrame, most: int, order: Sequence[str], keys: Sequence[str] = ("img",)) -> DataFrame:
    """At most ``most`` rows of each group, evenly spaced by order, both ends included."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    ranked = rows.withColumns({"rank": rank, "n": F.count("*").over(Window.partitionBy(*keys))})
    # place k of ``most`` is floor(k * (n - 1) / (most - 1)); a rank is one if some k lands on it
    k = F.ceil(F.col("rank") * (most - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    return ranked.where((F.col("n") <= most) | (F.floor(k * (F.col("n") - 1) / (most - 1)) == F.col("rank"))).drop("rank", "n")


def adaptive_seeds(area: Column, height: Column, width: Column, n0: int, nf: int, reference: float = 1500.0) -> dict[str, Column]:
    """Seeds scaled with the root of the area, and final segments by area class, both clamped."""
    most = F.greatest(F.lit(4), height * width - 1)
    scaled = F.rint(n0 * F.sqrt(F.greatest(area, F.lit(64)) / max(reference, 1.0)))
    first = F.greatest(F.lit(30), F.least(scaled, most - 1)).cast("int")
    last = F.when(area < 600, 2).when(area < 2500, nf).otherwise(max(nf, 3))
    return {"n0": first, "nf": F.greatest(F.lit(2), F.least(last, first - 1)).cast("int")}


def pad(n: Column, multiple: int = 16, extra: int = 1) -> dict[str, Column]:
    """Padding before and after a side so that it becomes a multiple: half an extra multiple on both ends, the odd pixel after."""
    short = multiple * F.ceil(n / multiple) - n
    half = extra * multiple // 2
    return {"before": (half + F.floor(short / 2)).cast("int"), "after": (half + short - F.floor(short / 2)).cast("int")}


def to_hsv(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """Hue, saturation and value of shares of 1."""
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    span = hi - lo
    hue = F.when(span == 0, 0.0).when(hi == r, F.pmod((g - b) / span, F.lit(6.0))).when(hi == g, (b - r) / span + 2).otherwise((r - g) / span + 4) / 6
    return {"h": hue, "s": F.when(hi > 0, span / hi).otherwise(0.0), "v": hi}


def to_rgb(h: Column, s: Column, v: Column) -> dict[str, Column]:
    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + h * 6, F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))

    return {"r": channel(5), "g": channel(3), "b": channel(1)}


def cyclic_colours(dy: Column, dx: Column, magnitude: Column) -> dict[str, Column]:
    """Three channels of a flow: half the clipped magnitude times the raised cosine of its angle, a third of a turn apart.

    A channel is rounded to six places before its fraction is cut, as cosines differ in their last bit between machines;
    it is null where the flow is.
    """
    angle = F.atan2(dx, dy) + 3.141592653589793
    half = 127.5 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), magnitude))
    return {k: F.floor(F.round(half * (F.cos(angle + i * 2.0943951023931953) + 1), 6)).cast("int") for i, k in enumerate(("r", "g", "b"))}


def reduce_channels(values: Column, mode: str) -> Column:
    """One number of an array of channels: l2, mean_abs or max_abs."""
    absolute = F.transform(values, F.abs)
    if mode == "max_abs":
        return F.array_max(absolute)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x * x if mode == "l2" else F.abs(x)))
    return F.sqrt(total) if mode == "l2" else total / F.size(values)


def neutralise(rows: DataFrame, v: str, where: Column, background: Column, empty: float = 128.0, keys: Sequence[str] = ("img",)) -> DataFrame:
    """Pixels that hold ``where`` get the mean of the background, else of all others, else a fixed value; one grouped pass."""
    fill = rows.groupBy(*keys).agg(F.coalesce(F.avg(F.when(background, F.col(v))), F.avg(F.when(~where, F.col(v))), F.lit(empty)).alias("fill"))
    return rows.join(fill, list(keys)).withColumn(v, F.when(where, F.col("fill")).otherwise(F.col(v))).drop("fill")


def normalise_tiles(rows: DataFrame, v: str, size: int, height: int, width: int, lower: float = 0.01, upper: float = 0.99, flat: float = 1e-3, keys: Sequence[str] = ("img",)) -> DataFrame:
    """Percentile stretch by tile, with percentiles that go over from tile to tile.

    Each tile of ``size`` has its own percentiles; flat tiles take those of the nearest tile of the image that is not (the
    first of equal ones), and none if all are. At a pixel the ends of up to four tiles are mixed by its distance to their
    middles. What is joined to pixels are tiles; ``norm`` is 0 where every tile is flat.
    """
    tiles_ = percentiles(rows.withColumns({"ty": F.floor(F.col("y") / size).cast("int"), "tx": F.floor(F.col("x") / size).cast("int")}), v, (lower, upper), [*keys, "ty", "tx"])
    tiles_ = tiles_.select(*keys, "ty", "tx", F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"), (F.col("p")[1] - F.col("p")[0] > flat).alias("sound"))
    sound = tiles_.where("sound").groupBy(*keys).agg(F.collect_list(F.struct("ty", "tx", "lo", "hi")).alias("all"))  # the tiles of one image
    far = lambda t: (t["ty"] - F.col("ty")) * (t["ty"] - F.col("ty")) + (t["tx"] - F.col("tx")) * (t["tx"] - F.col("tx"))
    near = F.array_min(F.transform("all", lambda t: F.struct(far(t).alias("far"), t["ty"].alias("y"), t["tx"].alias("x"), t["lo"].alias("lo"), t["hi"].alias("hi"))))
    filled = tiles_.join(sound, list(keys)).withColumn("n", near).select(*keys, "ty", "tx", "n.lo", "n.hi")
    last = {"y": -(-height // size) - 1, "x": -(-width // size) - 1}

    def parts(c: str) -> Column:
        """The two tiles around a pixel and their weights; at the edges of the image both are one."""
        at = (F.col(c) + 0.5) / size - 0.5
        low, share = F.floor(at).cast("int"), at - F.floor(at)
        held = lambda k: F.greatest(F.lit(0), F.least(F.lit(last[c]), k))
        return F.explode(F.array(F.struct(held(low).alias("t"), (1 - share).alias("w")), F.struct(held(low + 1).alias("t"), share.alias("w"))))

    spread = rows.withColumn("py", parts("y")).withColumn("px", parts("x")).withColumns({"ty": F.col("py.t"), "tx": F.col("px.t"), "w": F.col("py.w") * F.col("px.w")})
    ends = spread.join(filled, [*keys, "ty", "tx"]).groupBy(*keys, "y", "x").agg(F.sum(F.col("w") * F.col("lo")).alias("lo"), F.sum(F.col("w") * F.col("hi")).alias("hi"))
    return rows.join(ends, [*keys, "y", "x"], "left").withColumn("norm", F.coalesce((F.col(v) - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0))).drop("lo", "hi")


def axes_moved(rows: DataFrame, axes: Sequence[str], source: str, last: bool = True) -> DataFrame:
    """Rows whose coordinate ``source`` becomes the last (or first) of the axes; the others follow in their order."""
    rest = [a for a in axes if a != source]
    order = [*rest, source] if last else [source, *rest]
    return rows.select(*[c for c in rows.columns if c not in axes], *[F.col(a).alias(b) for a, b in zip(order, axes, strict=True)])


def three_channels(rows: DataFrame, channels: Column, c: str = "c", v: str = "v") -> DataFrame:
    """Pixels (…, c, v) with exactly three channels: further ones are dropped, missing ones are 0; no channel at all is an error.

    ``channels`` is the number that the image has.
    """
    checked = F.when(channels < 1, F.raise_error(F.lit("an image has at least one channel"))).otherwise(channels)
    extra = F.explode(F.when(F.col(c) == 0, F.concat(F.array(F.lit(0)), F.filter(F.sequence(F.lit(1), F.lit(2)), lambda k: k >= checked))).otherwise(F.array(F.col(c))))
    return rows.where(F.col(c) < 3).withColumn("_c", extra).withColumn(v, F.when(F.col("_c") == F.col(c), F.col(v)).otherwise(0.0)).withColumn(c, F.col("_c")).drop("_c")
