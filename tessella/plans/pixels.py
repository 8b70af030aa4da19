"""Queries on pixels: scalar maps, neighbourhoods, tiles, codecs, and kernels run by image."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import choices, holes, neighbours, overlaps, tiles, volumes
from tessella.operators import kernels as k
from tessella.operators import metrics as m
from tessella.operators import pixels as p
from tessella.operators.labels import contingency, iou_pairs, relabel
from tessella.plans.fixtures import SIDE, grid, lab, pix, sql
from tessella.plans.registry import register
from tessella.sources import tables

SIGMOID = "1 / (1 + exp(-greatest(-50.0, least(50.0, v))))"


@register("sigmoid_u8", sql("pix", f"SELECT img, pos, b, CASE WHEN b < round_even(255 * 0.5, 0) THEN 0 ELSE b END AS cut, CASE WHEN pos % 2 = 0 THEN b ELSE 0 END AS inside FROM (SELECT img, pos, CAST(floor(255 * ({SIGMOID})) AS INTEGER) AS b FROM pix)"))
def sigmoid_u8(spark, d):
    byte = p.to_byte(p.sigmoid(F.col("v")))
    return pix(spark, d).withColumn("b", byte).select("img", "pos", "b", p.threshold(F.col("b"), 0.5).alias("cut"), F.when(F.col("pos") % 2 == 0, F.col("b")).otherwise(0).alias("inside"))


@register("modified_probability", sql("pix", f"SELECT img, pos, round((2.0 * ({SIGMOID}) + 0.1) * (1 + pos / 64), 6) AS v FROM pix"))
def modified_probability(spark, d):
    return pix(spark, d).select("img", "pos", F.round((2.0 * p.sigmoid(F.col("v")) + 0.1) * (1 + F.col("pos") / 64), 6).alias("v"))


@register("stretch_u8", sql("pix", "SELECT img, pos, CASE WHEN hi > lo + 1e-8 THEN CAST(floor((v - lo) / (hi - lo) * 255) AS INTEGER) ELSE 0 END AS b FROM (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM pix WINDOW w AS (PARTITION BY img))"))
def stretch_u8(spark, d):
    rows = pix(spark, d)
    return rows.select("img", "pos", p.stretch(rows, "v").alias("b"))


FLOWS = "SELECT img, pos, y, x, v AS dy, lag(v, 1, 0.0) OVER (PARTITION BY img ORDER BY pos) AS dx FROM pix"


def flows(spark, d):
    from pyspark.sql import Window

    return pix(spark, d).withColumnRenamed("v", "dy").withColumn("dx", F.lag("dy", 1, 0.0).over(Window.partitionBy("img").orderBy("pos")))


@register("flow_magnitude_u8", sql("pix", "SELECT img, pos, CASE WHEN hi > lo + 1e-8 THEN CAST(floor(round((m - lo) / (hi - lo) * 255, 6)) AS INTEGER) ELSE 0 END AS b FROM (SELECT *, min(m) OVER w AS lo, max(m) OVER w AS hi FROM (SELECT *, sqrt(dy * dy + dx * dx) AS m FROM f) WINDOW w AS (PARTITION BY img))", f=FLOWS))
def flow_magnitude_u8(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("img")
    rows = flows(spark, d).withColumn("m", F.sqrt(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx"))).withColumns({"lo": F.min("m").over(w), "hi": F.max("m").over(w)})
    return rows.select("img", "pos", F.when(F.col("hi") > F.col("lo") + 1e-8, F.floor(F.round((F.col("m") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255, 6)).cast("int")).otherwise(0).alias("b"))


@register("normalize99", sql("pix", "SELECT img, pos, round(CASE WHEN hi - lo > 1e-3 THEN (v - lo) / (hi - lo) ELSE 0 END, 6) AS norm FROM pix JOIN (SELECT img, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM pix GROUP BY img) USING (img)"))
def normalize99(spark, d):
    return p.normalise(pix(spark, d)).select("img", "pos", F.round("norm", 6).alias("norm"))


OTSU = """SELECT img, arg_max(b, struct_pack(v := v, k := -b)) AS t FROM (SELECT img, b, round(coalesce(w * (total - w) * (m / w - (mean - m) / nullif(total - w, 0)) * (m / w - (mean - m) / nullif(total - w, 0)), 0), 6) AS v FROM (
    SELECT img, b, CAST(sum(n) OVER u AS DOUBLE) AS w, sum(n * b) OVER u AS m, sum(n) OVER e AS total, sum(n * b) OVER e AS mean FROM (SELECT img, b, count(*) AS n FROM bytes GROUP BY ALL)
    WINDOW u AS (PARTITION BY img ORDER BY b ROWS UNBOUNDED PRECEDING), e AS (PARTITION BY img))) GROUP BY img"""


@register("otsu", sql("pix", OTSU, bytes=f"SELECT img, CAST(floor(255 * ({SIGMOID})) AS INTEGER) AS b FROM pix"))
def otsu(spark, d):
    return p.otsu(pix(spark, d).select("img", p.to_byte(p.sigmoid(F.col("v"))).alias("b")), "b")


@register("maxpool2d", sql("pix", "SELECT a.img, a.pos, max(b.v) AS pool FROM pix a JOIN pix b ON a.img = b.img AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY ALL"))
def maxpool2d(spark, d):
    return p.max_pool(pix(spark, d), "v", 2).select("img", "pos", "pool")


KERNEL = (0.25, 0.5, 0.25)


@register("smooth2d", sql("pix", "SELECT a.img, a.pos, round(sum(b.v * (2 - abs(a.y - b.y)) * (2 - abs(a.x - b.x))) / sum((2 - abs(a.y - b.y)) * (2 - abs(a.x - b.x))), 6) AS s FROM pix a JOIN pix b ON a.img = b.img AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL"))
def smooth2d(spark, d):
    return p.smooth(pix(spark, d), "v", KERNEL).select("img", "pos", F.round("smooth", 6).alias("s"))


@register("gradient2d", sql("pix", """SELECT img, pos, round(sqrt(gx * gx + gy * gy), 6) AS g FROM (SELECT a.img, a.pos, sum(b.v * ex * CASE WHEN ey = 0 THEN 2 ELSE 1 END) AS gx, sum(b.v * ey * CASE WHEN ex = 0 THEN 2 ELSE 1 END) AS gy
    FROM pix a, range(-1, 2) r(ey), range(-1, 2) c(ex), pix b WHERE b.img = a.img AND b.y = CASE WHEN a.y + ey < 0 THEN 1 WHEN a.y + ey > 7 THEN 6 ELSE a.y + ey END AND b.x = CASE WHEN a.x + ex < 0 THEN 1 WHEN a.x + ex > 7 THEN 6 ELSE a.x + ex END GROUP BY ALL)"""))  # fmt: skip
def gradient2d(spark, d):
    return p.gradient(pix(spark, d), "v").select("img", "pos", F.round("grad", 6).alias("g"))


@register("resize_nearest", sql("pix", "SELECT img, CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, v FROM pix, range(12) a(ty), range(5) b(tx) WHERE y = ty * 8 // 12 AND x = tx * 8 // 5"))
def resize_nearest(spark, d):
    return p.resize_nearest(pix(spark, d), SIDE, SIDE, 12, 5).select("img", "ty", "tx", "v")


@register("resize_bilinear", sql("pix", """SELECT img, CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, round(sum(v * wy * wx), 6) AS v FROM (SELECT *, 1 - abs(greatest(0, least(7, (ty + 0.5) * (8 / 12) - 0.5)) - y) AS wy, 1 - abs(greatest(0, least(7, (tx + 0.5) * (8 / 5) - 0.5)) - x) AS wx
    FROM pix, range(12) a(ty), range(5) b(tx)) WHERE wy > 0 AND wx > 0 GROUP BY ALL"""))  # fmt: skip
def resize_bilinear(spark, d):
    return p.resize_bilinear(pix(spark, d), "v", SIDE, SIDE, 12, 5).select("img", "ty", "tx", F.round("v", 6).alias("v"))


TAPER = "(1 / (1 + exp((abs(ly - 1.5) - 1.0) / 0.5))) * (1 / (1 + exp((abs(lx - 1.5) - 1.0) / 0.5)))"


@register("tile_average", sql("pix", f"""SELECT img, y, x, tiles, round(sv / sw, 6) AS v FROM (SELECT img, y, x, count(*) AS tiles, sum((v + ty + tx) * {TAPER}) AS sv, sum({TAPER}) AS sw FROM (SELECT *, y - ty AS ly, x - tx AS lx FROM pix, range(0, 5, 2) a(ty), range(0, 5, 2) b(tx)
    WHERE y >= ty AND y < ty + 4 AND x >= tx AND x < tx + 4) GROUP BY ALL)"""))  # fmt: skip
def tile_average(spark, d):
    tiled = p.tiles(pix(spark, d), 4, 2, SIDE, SIDE).withColumn("v", F.col("v") + F.col("ty") + F.col("tx"))
    weight = p.taper(F.col("ly"), 4, 0.5, 1.0) * p.taper(F.col("lx"), 4, 0.5, 1.0)
    n = tiled.groupBy("img", "y", "x").agg(F.count("*").alias("tiles"), (F.sum(F.col("v") * weight) / F.sum(weight)).alias("v"))
    return n.select("img", "y", "x", "tiles", F.round("v", 6).alias("v"))


RUNS = "SELECT img, min(cm) AS start, count(*) AS length FROM (SELECT img, cm, cm - row_number() OVER (PARTITION BY img ORDER BY cm) AS island FROM (SELECT img, x * 8 + y AS cm FROM pix WHERE v > 0)) GROUP BY img, island"


def column_major(spark, d):
    return pix(spark, d).where("v > 0").select("img", (F.col("x") * SIDE + F.col("y")).alias("at"))


@register("rle_encode", sql("pix", f"SELECT img, string_agg((start + 1) || ' ' || length, ' ' ORDER BY start) AS rle FROM ({RUNS}) GROUP BY img"))
def rle_encode(spark, d):
    runs = p.run_lengths(column_major(spark, d), "at")
    pairs = F.array_sort(F.collect_list(F.struct("start", "length")))
    return runs.groupBy("img").agg(F.concat_ws(" ", F.transform(pairs, lambda r: F.concat_ws(" ", r["start"] + 1, r["length"]))).alias("rle"))


@register("rle_decode", sql("pix", "SELECT img, x * 8 + y AS pos FROM pix WHERE v > 0"))
def rle_decode(spark, d):
    return p.from_runs(p.run_lengths(column_major(spark, d), "at"))


@register("evenly_spaced_seeds", sql("pix", """SELECT img, pos FROM (SELECT img, pos, row_number() OVER (PARTITION BY img ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY img) AS n FROM pix WHERE v > 0) q
    WHERE n <= 10 OR EXISTS (SELECT 1 FROM range(10) r(i) WHERE (i * (n - 1)) // 9 = k)"""))  # fmt: skip
def evenly_spaced_seeds(spark, d):
    return p.evenly(pix(spark, d).where("v > 0"), 10, ["pos"]).select("img", "pos")


@register("margin_band", sql("pix", "SELECT img, count(*) FILTER (y < 2 OR y >= 6 OR x < 2 OR x >= 6) AS band FROM pix GROUP BY img"))
def margin_band(spark, d):
    return pix(spark, d).groupBy("img").agg(F.count_if((F.col("y") < 2) | (F.col("y") >= 6) | (F.col("x") < 2) | (F.col("x") >= 6)).alias("band"))


@register("conquest_roi", """SELECT p_partkey, p_size IN (0, 7) AS roi, p_size <> 0 AND p_size <> 7 AS ignored, CASE WHEN p_size <> 0 AND p_size <> 7 THEN 2 ELSE p_size END AS forced FROM part""")
def conquest_roi(spark, d):
    size = F.col("p_size")
    other = (size != 0) & (size != 7)
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", size.isin(0, 7).alias("roi"), other.alias("ignored"), F.when(other, 2).otherwise(size).alias("forced"))


@register("adaptive_seeds", """SELECT p_partkey, n0, greatest(2, least(CASE WHEN a < 600 THEN 2 WHEN a < 2500 THEN 2 ELSE 3 END, n0 - 1)) AS nf FROM (SELECT p_partkey, a, CAST(greatest(30, least(round_even(200 * sqrt(greatest(a, 64) / 1500.0), 0), greatest(4, p_size * p_size - 1) - 1)) AS INTEGER) AS n0
    FROM (SELECT *, p_size * p_size * 2 AS a FROM part))""")  # fmt: skip
def adaptive_seeds(spark, d):
    size = F.col("p_size")
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", *[c.alias(n) for n, c in p.adaptive_seeds(size * size * 2, size, size, 200, 2).items()])


@register("pad_to_multiple", "SELECT p_partkey, CAST(8 + short // 2 AS INTEGER) AS before, CAST(8 + short - short // 2 AS INTEGER) AS after FROM (SELECT p_partkey, (16 - p_size % 16) % 16 AS short FROM part)")
def pad_to_multiple(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", *[c.alias(n) for n, c in p.pad(F.col("p_size")).items()])


RGB = "SELECT p_partkey, (p_partkey * 37 % 256) / 255 AS r, (p_partkey * 91 % 256) / 255 AS g, (p_size * 53 % 256) / 255 AS b FROM part"


@register("hsv_round_trip", f"WITH c AS ({RGB}) SELECT p_partkey, round(greatest(r, g, b), 6) AS v, round(CASE WHEN greatest(r, g, b) > 0 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0 END, 6) AS s, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM c")
def hsv_round_trip(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", (F.col("p_partkey") * 37 % 256 / 255).alias("r"), (F.col("p_partkey") * 91 % 256 / 255).alias("g"), (F.col("p_size") * 53 % 256 / 255).alias("b"))
    hsv = rows.select("p_partkey", *[c.alias(n) for n, c in p.to_hsv(F.col("r"), F.col("g"), F.col("b")).items()])
    back = p.to_rgb(F.col("h"), F.col("s"), F.col("v"))
    return hsv.select("p_partkey", F.round("v", 6).alias("v"), F.round("s", 6).alias("s"), *[F.round(c, 6).alias(n) for n, c in back.items()])


@register("cyclic_colours", sql("pix", """SELECT img, pos, CAST(floor(round(h * (cos(a) + 1), 6)) AS INTEGER) AS r, CAST(floor(round(h * (cos(a + 2.0943951023931953) + 1), 6)) AS INTEGER) AS g, CAST(floor(round(h * (cos(a + 4.1887902047863905) + 1), 6)) AS INTEGER) AS b
    FROM (SELECT *, atan2(dx, dy) + 3.141592653589793 AS a, 127.5 * greatest(0.0, least(1.0, sqrt(dy * dy + dx * dx))) AS h FROM f)""", f=FLOWS))  # fmt: skip
def cyclic_colours(spark, d):
    rows = flows(spark, d)
    return rows.select("img", "pos", *[c.alias(n) for n, c in p.cyclic_colours(F.col("dy"), F.col("dx"), F.sqrt(F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx"))).items()])


@register("channel_reduction", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 5) AS l2, round(list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) / len(embedding), 5) AS mean_abs, round(list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))), 5) AS max_abs FROM embeddings")
def channel_reduction(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return rows.select("vec_id", *[F.round(p.reduce_channels(F.col("e"), mode), 5).alias(mode) for mode in ("l2", "mean_abs", "max_abs")])


@register("colour_labels", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, CAST(dense_rank() OVER (PARTITION BY l_returnflag ORDER BY r, g, b) AS INTEGER) AS label FROM (SELECT *, l_suppkey % 5 AS r, l_partkey % 3 AS g, l_linenumber % 2 AS b FROM lineitem) WHERE greatest(r, g, b) > 0")
def colour_labels(spark, d):
    from pyspark.sql import Window

    rows = spark.read.parquet(f"{d}/lineitem.parquet").withColumns({"r": F.col("l_suppkey") % 5, "g": F.col("l_partkey") % 3, "b": F.col("l_linenumber") % 2})
    seen = rows.where("greatest(r, g, b) > 0")
    # ranks are taken over the distinct colours of an image, then joined back
    ranks = seen.select("l_returnflag", "r", "g", "b").distinct().withColumn("label", F.row_number().over(Window.partitionBy("l_returnflag").orderBy("r", "g", "b")))
    return seen.join(ranks, ["l_returnflag", "r", "g", "b"]).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "label")


@register("histogram_seeds", sql("pix", """SELECT a.img, a.y, a.x, a.h FROM (SELECT img, y2 AS y, x2 AS x, count(*) AS h FROM m GROUP BY ALL) a WHERE h > 1 AND h >= (SELECT max(b.h) FROM (SELECT img, y2 AS y, x2 AS x, count(*) AS h FROM m GROUP BY ALL) b WHERE b.img = a.img AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2)""",
    m="SELECT img, CAST(greatest(0, least(7, y + floor(v * 20))) AS INTEGER) AS y2, CAST(greatest(0, least(7, x - floor(v * 20))) AS INTEGER) AS x2 FROM pix"))
def histogram_seeds(spark, d):
    step = F.floor(F.col("v") * 20)
    ends = pix(spark, d).select("img", F.greatest(F.lit(0), F.least(F.lit(7), F.col("y") + step)).cast("int").alias("y"), F.greatest(F.lit(0), F.least(F.lit(7), F.col("x") - step)).cast("int").alias("x"))
    h = ends.groupBy("img", "y", "x").agg(F.count("*").alias("h"))
    every = h.select("img").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(7))))
    dense = every.join(h, ["img", "y", "x"], "left").fillna(0, ["h"])  # both passes need the rows between
    return p.max_pool(dense, "h", 2).where("h > 1 and h >= pool").select("img", "y", "x", "h")


@register("flow_error", sql("pix lab", "SELECT l.img, l.gt, round(avg((f.dy - f.dx / 5) * (f.dy - f.dx / 5)), 6) AS err FROM lab l JOIN f USING (img, y, x) WHERE l.gt > 0 GROUP BY ALL HAVING avg((f.dy - f.dx / 5) * (f.dy - f.dx / 5)) <= 0.4", f=FLOWS))
def flow_error(spark, d):
    both = lab(spark, d).where("gt > 0").join(flows(spark, d), ["img", "y", "x"])
    e = F.col("dy") - F.col("dx") / 5
    return both.groupBy("img", "gt").agg(F.avg(e * e).alias("err")).where("err <= 0.4").select("img", "gt", F.round("err", 6).alias("err"))


@register("centrality", sql("lab", "SELECT img, gt, round(sqrt((avg(y) - 4) * (avg(y) - 4) + (avg(x) - 4) * (avg(x) - 4)) / (sqrt(128) / 2), 6) AS c FROM lab WHERE gt > 0 GROUP BY ALL"))
def centrality(spark, d):
    """How far each label lies from the middle of its image."""
    return choices.centrality(lab(spark, d), "gt", SIDE, SIDE).withColumn("c", F.round("c", 6))


# Kernels: no SQL expresses them in reasonable room; tests hold them against plain versions.


@register("optimal_matching", sql("pairs", """SELECT img, CAST(coalesce(tp, 0) AS BIGINT) AS tp, round(coalesce(s, 0), 6) AS iou_sum, round(CASE WHEN u > 0 THEN coalesce(o, 0) / u ELSE 1 END, 6) AS aji_fused
    FROM (SELECT img, coalesce(sum(n) FILTER (gt > 0 OR pr > 0), 0) AS u FROM cont GROUP BY img) LEFT JOIN (SELECT img, count(*) FILTER (iou >= 0.5) AS tp, sum(iou) AS s, sum(n) AS o FROM pairs GROUP BY img) USING (img)"""))  # fmt: skip
def optimal_matching(spark, d):
    """An assignment over all overlapping pairs. In these maps no label overlaps with two, so SQL needs no assignment; ``assignments`` is the case in which it does."""
    return m.optimal(contingency(lab(spark, d))).select("img", "tp", F.round("iou_sum", 6).alias("iou_sum"), F.round("aji_fused", 6).alias("aji_fused"))


LOW = (0.1, 0.2, 0.3, 0.5)
#: Every way to give the labels of one map in turn a free label of the other: ``used`` has a bit for each that is taken.
WAYS = {
    "crossed": "SELECT g.img, g.label AS gt, l.gt AS pr, count(*) AS n FROM grid g JOIN lab l USING (img, y, x) GROUP BY ALL",
    "met": "SELECT img, gt, pr, n / (ga + pa - n) AS iou FROM (SELECT *, sum(n) OVER (PARTITION BY img, gt) AS ga, sum(n) OVER (PARTITION BY img, pr) AS pa FROM crossed) WHERE gt > 0 AND pr > 0",
    "low": f"SELECT t, img, gt, pr FROM met, (SELECT unnest({list(LOW)}) AS t) WHERE iou >= t",
    "ways": "SELECT t, img, 0 AS g, 0 AS used, 0 AS tp FROM (SELECT DISTINCT t, img FROM low) UNION SELECT w.t, w.img, w.g + 1, w.used | coalesce(b.bit, 0), w.tp + (b.bit IS NOT NULL)::INT FROM ways w LEFT JOIN (SELECT t, img, gt, (1 << (pr - 1))::INT AS bit FROM low UNION ALL SELECT DISTINCT t, img, gt, NULL FROM low) b ON b.t = w.t AND b.img = w.img AND b.gt = w.g + 1 AND coalesce(w.used & b.bit, 0) = 0 WHERE w.g < 9",
}


@register("assignments", sql("grid lab", "SELECT img, t, CAST(max(tp) AS BIGINT) AS tp FROM ways GROUP BY ALL", recursive=True, **WAYS))
def assignments(spark, d):
    """Largest matchings below a half, where labels compete: a raster of nine against quadrants."""
    both = grid(spark, d).join(lab(spark, d).select("img", "y", "x", F.col("gt").alias("pr")), ["img", "y", "x"]).withColumnRenamed("label", "gt")
    return m.matched(iou_pairs(contingency(both)), LOW).groupBy("img", "t").agg(F.count("*").alias("tp"))


@register("fill_holes_and_small", sql("grid", "SELECT g.img, g.y, g.x, CAST(coalesce(k.new, 0) AS BIGINT) AS label FROM (SELECT grid.img, grid.y, grid.x, coalesce(h.label, grid.label) AS label FROM grid LEFT JOIN holes h USING (img, y, x)) g LEFT JOIN kept k ON k.img = g.img AND k.label = g.label",
    kept="SELECT img, label, row_number() OVER (PARTITION BY img ORDER BY label) AS new FROM grid WHERE label > 0 GROUP BY img, label HAVING count(*) >= 3",
    holes="SELECT c.img, c.y, c.x, min(n.label) AS label FROM grid c JOIN grid n ON n.img = c.img AND abs(n.y - c.y) + abs(n.x - c.x) = 1 WHERE c.label = 0 AND n.label > 0 AND c.y % 3 = 1 AND c.x % 3 = 1 GROUP BY ALL HAVING count(*) = 4 AND min(n.label) = max(n.label)"))
def fill_holes_and_small(spark, d):
    """Labels of three pixels or more, their holes filled across tiles of five pixels, numbered anew; background stays."""
    rows = grid(spark, d)
    found = holes.cleaned(tiles.of_pixels(rows, "label", SIDE, SIDE, 5), 3)
    return rows.select("img", "y", "x").join(found, ["img", "y", "x"], "left").withColumn("label", F.coalesce("label", F.lit(0).cast("long")))


@register("image_components", sql("pix", "SELECT img, count(DISTINCT root) AS n, CAST(sum(area) AS BIGINT) AS area FROM (SELECT n.img, r.root, count(*) AS area FROM (SELECT node, min(root) AS root FROM reach GROUP BY node) r JOIN nodes n USING (node) GROUP BY ALL) GROUP BY img", recursive=True,
    nodes="SELECT img * 64 + pos AS node, img, y, x FROM pix WHERE v > 0", reach="SELECT node, node AS root FROM nodes UNION SELECT n.node, r.root FROM reach r JOIN nodes m ON m.node = r.node JOIN nodes n ON n.img = m.img AND abs(n.y - m.y) <= 1 AND abs(n.x - m.x) <= 1"))
def image_components(spark, d):
    found = k.per_image(pix(spark, d), lambda a: k.components(a > 0), "v", "label", SIDE, SIDE)
    return found.where("label > 0").groupBy("img").agg(F.count_distinct("label").alias("n"), F.count("*").alias("area"))


# Priority floods and flows: no SQL expresses them; tests hold them against plain versions.


@register("watershed")
def watershed(spark, d):
    return k.per_image(pix(spark, d), k.classical, "v", "label", SIDE, SIDE)


@register("flows_and_back")
def flows_and_back(spark, d):
    def there(stack: np.ndarray) -> np.ndarray:
        ends = k.follow(k.each_to_flows(stack), stack > 0, 60, apart=1)
        return k.gather(ends, stack > 0, seed_count=3, grow_count=1, apart=1)

    return k.per_image(grid(spark, d), there, "label", "label", SIDE, SIDE, stacked=True)


WEIGHTS = "SELECT dy, dx, exp(-d / 0.5) / sum(exp(-d / 0.5)) OVER () - exp(-d / 8.0) / sum(exp(-d / 8.0)) OVER () AS w FROM (SELECT CAST(a AS INTEGER) AS dy, CAST(b AS INTEGER) AS dx, least(a, 8 - a) * least(a, 8 - a) + least(b, 8 - b) * least(b, 8 - b) AS d FROM range(0, 8) u(a), range(0, 8) v(b))"


@register("sharpened", sql("pix", "SELECT p.img, p.y, p.x, round(sum(q.v * w), 6) AS v FROM pix p JOIN pix q ON q.img = p.img JOIN weights ON dy = (p.y - q.y + 8) % 8 AND dx = (p.x - q.x + 8) % 8 GROUP BY p.img, p.y, p.x", weights=WEIGHTS))
def sharpened(spark, d):
    """Images less their own blur, after a little smoothing."""
    return k.per_image(pix(spark, d), lambda a: k.band_passed(a, 0.5, 2.0), "v", "v", SIDE, SIDE, kind="double").select("img", "y", "x", F.round("v", 6).alias("v"))


@register("traced_outlines")
def traced_outlines(spark, d):
    """The outer border of each label as points in order, as text, with its padded number."""
    return tables.traced(grid(spark, d).where("label > 0"))


CROSS = "abs(a.y - b.y) + abs(a.x - b.x) <= 1"


@register("cleaned_objects", sql("pix", "SELECT p.img, p.y, p.x, w.root IS NOT NULL AS object FROM pix p LEFT JOIN parts t ON t.img = p.img AND t.y = p.y AND t.x = p.x LEFT JOIN won w ON w.img = t.img AND w.root = t.root", recursive=True,
    fg="SELECT img, y, x FROM pix WHERE v > 0", wide="SELECT img, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM (SELECT DISTINCT img FROM pix), range(-1, 9) u(y), range(-1, 9) v(x)",
    grown=f"SELECT DISTINCT a.img, a.y, a.x FROM wide a JOIN fg b ON a.img = b.img AND {CROSS}", shut=f"SELECT a.img, a.y, a.x FROM grown a JOIN grown b ON a.img = b.img AND {CROSS} GROUP BY ALL HAVING count(*) = 5",
    open_="SELECT w.* FROM wide w ANTI JOIN shut s ON s.img = w.img AND s.y = w.y AND s.x = w.x", outside=f"SELECT img, y, x FROM open_ WHERE y = -1 AND x = -1 UNION SELECT a.img, a.y, a.x FROM open_ a JOIN outside b ON a.img = b.img AND {CROSS}",
    whole="SELECT p.img, p.y, p.x, p.pos FROM pix p ANTI JOIN outside o ON o.img = p.img AND o.y = p.y AND o.x = p.x", reach="SELECT img, pos, y, x, pos AS root FROM whole UNION SELECT a.img, a.pos, a.y, a.x, b.root FROM whole a JOIN reach b ON a.img = b.img AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1",
    parts="SELECT img, y, x, min(root) AS root FROM reach GROUP BY img, y, x", won="SELECT img, root FROM parts GROUP BY img, root QUALIFY row_number() OVER (PARTITION BY img ORDER BY count(*) DESC, root) = 1"))
def cleaned_objects(spark, d):
    """Foregrounds with gaps closed and holes filled, and of that the largest component."""
    return k.per_image(pix(spark, d), lambda a: k.clean_object(a > 0, 1), "v", "object", SIDE, SIDE, kind="boolean")


QUADRANTS = "(SELECT unnest([1, 2, 3, 4]) AS q)"
VOLUMES = {
    "planes": f"SELECT CAST(img // 10 AS BIGINT) AS vol, CAST(img % 10 AS INTEGER) AS z, q, bool_or(gt = q) AS has FROM lab, {QUADRANTS} GROUP BY ALL",
    "shared": "SELECT a.img // 10 AS vol, CAST(a.img % 10 AS INTEGER) AS z, a.gt AS q, count(*) AS n FROM lab a JOIN lab b ON b.img = a.img - 1 AND a.img // 10 = b.img // 10 AND a.y = b.y AND a.x = b.x AND a.gt = b.gt WHERE a.gt > 0 GROUP BY ALL",
    "sizes": "SELECT img // 10 AS vol, CAST(img % 10 AS INTEGER) AS z, gt AS q, count(*) AS n FROM lab WHERE gt > 0 GROUP BY ALL",
    "carried": "SELECT s.vol, s.z, s.q FROM shared s JOIN sizes a USING (vol, z, q) JOIN sizes b ON b.vol = s.vol AND b.z = s.z - 1 AND b.q = s.q WHERE s.n / (a.n + b.n - s.n) >= 0.25",
    "steps": "SELECT p.vol, p.z, list(CASE WHEN NOT has THEN 0 WHEN c.q IS NOT NULL THEN 2 ELSE 1 END ORDER BY p.q) AS kind FROM planes p LEFT JOIN carried c USING (vol, z, q) GROUP BY ALL",  # absent, new, carried
    "walk": """SELECT vol, z, list_transform(kind, lambda x, i: CASE WHEN x > 0 THEN i ELSE 0 END) AS ids, list_max(list_transform(kind, lambda x, i: CASE WHEN x > 0 THEN i ELSE 0 END)) AS top FROM steps WHERE z = 0
        UNION ALL SELECT s.vol, s.z, list_transform(s.kind, lambda x, i: CASE x WHEN 0 THEN 0 WHEN 2 THEN w.ids[i] ELSE w.top + len(list_filter(s.kind[1:i], lambda y: y = 1)) END), w.top + len(list_filter(s.kind, lambda y: y = 1)) FROM walk w JOIN steps s ON s.vol = w.vol AND s.z = w.z + 1""",
}


@register("stitched_planes", sql("lab", "SELECT w.vol AS img, CAST(w.z * 8 + l.y AS INTEGER) AS y, l.x, CAST(CASE WHEN l.gt > 0 THEN w.ids[l.gt] ELSE 0 END AS BIGINT) AS label FROM lab l JOIN walk w ON w.vol = l.img // 10 AND w.z = l.img % 10", recursive=True, **VOLUMES))
def stitched_planes(spark, d):
    """Labels of the planes of a volume (ten images in turn) carried from plane to plane."""
    rows = lab(spark, d).select((F.floor(F.col("img") / 10)).cast("long").alias("img"), (F.col("img") % 10).cast("int").alias("z"), "y", "x", "gt")
    done = volumes.stitched(rows, "gt", vol="img")
    return done.select("img", (F.col("z") * SIDE + F.col("y")).cast("int").alias("y"), "x", F.col("gt").alias("label"))


@register("shape_descriptors", sql("lab", """SELECT i.img, coalesce(a.area, 0) AS area, CAST(coalesce(a.edge, 0) AS DOUBLE) AS perimeter, round(coalesce(least(1.0, 4 * pi() * a.area / (a.edge * a.edge)), 0), 6) AS compactness, round(coalesce(a.area / h.whole, 0), 6) AS solidity
    FROM (SELECT DISTINCT img FROM lab) i LEFT JOIN (SELECT f.img, count(*) AS area, sum(4 - coalesce(n, 0)) AS edge FROM fg f LEFT JOIN near USING (img, y, x) GROUP BY f.img) a USING (img) LEFT JOIN (SELECT img, abs(sum(turn)) / 2 AS whole FROM rim GROUP BY img) h USING (img)""",
    fg="SELECT img, y, x FROM lab WHERE gt > 0", near="SELECT a.img, a.y, a.x, count(*) AS n FROM fg a JOIN fg b ON a.img = b.img AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY ALL",
    corners="SELECT img, y + v AS y, min(x) AS lo, max(x) + 1 AS hi FROM fg, (SELECT unnest([0, 1]) AS v) GROUP BY ALL", ends="SELECT img, y, lo AS x FROM corners UNION SELECT img, y, hi FROM corners",
    rim="""SELECT a.img, a.x * b.y - b.x * a.y AS turn FROM ends a JOIN ends b ON a.img = b.img AND (a.x <> b.x OR a.y <> b.y) JOIN ends c ON c.img = a.img GROUP BY a.img, a.x, a.y, b.x, b.y
        HAVING bool_and((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) > 0 OR ((b.x - a.x) * (c.y - a.y) = (b.y - a.y) * (c.x - a.x) AND c.x BETWEEN least(a.x, b.x) AND greatest(a.x, b.x) AND c.y BETWEEN least(a.y, b.y) AND greatest(a.y, b.y)))"""))  # fmt: skip
def shape_descriptors(spark, d):
    """Area, perimeter, compactness and solidity of each foreground; in SQL, hull edges are those that have all other ends on one side."""
    found = k.per_pair(lab(spark, d), lambda g, _: k.shape_statistics(g > 0), "area long, perimeter double, compactness double, solidity double", SIDE, SIDE)
    return found.select("img", "area", "perimeter", F.round("compactness", 6).alias("compactness"), F.round("solidity", 6).alias("solidity"))


@register("overlap_removal", sql("lab", """SELECT l.img, l.y, l.x, CAST(coalesce(m.place, 0) AS BIGINT) AS label FROM lab l LEFT JOIN (SELECT p.img, p.y, p.x, arg_min(place, struct_pack(f := (p.y - my) * (p.y - my) + (p.x - mx) * (p.x - mx), k := m.k)) AS place FROM px p JOIN masks m USING (img, k) JOIN live USING (img, k) GROUP BY ALL) m USING (img, y, x)""",
    px="SELECT img, gt AS k, y, x FROM lab WHERE gt > 0 UNION ALL SELECT img, pr + 4, y, x FROM lab WHERE pr > 0",
    masks="SELECT img, k, count(*) AS n, median(y) AS my, median(x) AS mx, row_number() OVER (PARTITION BY img ORDER BY k) AS place FROM px GROUP BY img, k",
    shared="SELECT img, gt, count(*) AS n FROM lab WHERE gt > 0 AND gt = pr GROUP BY ALL",
    dropped="SELECT s.img, CASE WHEN a.n <= b.n THEN a.k ELSE b.k END AS k FROM shared s JOIN masks a ON a.img = s.img AND a.k = s.gt JOIN masks b ON b.img = s.img AND b.k = s.gt + 4 WHERE s.n / least(a.n, b.n) >= 0.75",
    live="SELECT img, k FROM masks EXCEPT SELECT img, k FROM dropped"))
def overlap_removal(spark, d):
    """The labels of both maps as masks that overlap, made one map; masks are numbered from 1 in each image."""
    rows = lab(spark, d)
    masks = rows.where("gt > 0").select("img", F.col("gt").alias("mask"), "y", "x").unionByName(rows.where("pr > 0").select("img", (F.col("pr") + 4).alias("mask"), "y", "x"))
    names = relabel(masks.select("img", "mask").distinct(), "mask").select("img", F.col("mask").alias("label"), "new")
    found = overlaps.without_covered(masks).join(names, ["img", "label"])
    return rows.select("img", "y", "x").join(found, ["img", "y", "x"], "left").select("img", "y", "x", F.coalesce("new", F.lit(0)).cast("long").alias("label"))


@register("flipped_tiles", sql("pix", "SELECT img, ty, tx, flip, ly, lx, v FROM (SELECT img, CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, (ty // 4 % 2) * 2 + tx // 4 % 2 AS flip, CAST(CASE WHEN ty // 4 % 2 = 1 THEN 3 - (y - ty) ELSE y - ty END AS INTEGER) AS ly, CAST(CASE WHEN tx // 4 % 2 = 1 THEN 3 - (x - tx) ELSE x - tx END AS INTEGER) AS lx, v FROM pix, range(0, 5, 4) a(ty), range(0, 5, 4) b(tx) WHERE y >= ty AND y < ty + 4 AND x >= tx AND x < tx + 4)"))
def flipped_tiles(spark, d):
    """Tiles of which every second row and column is mirrored: coordinates are turned, pixels stay."""
    t = p.tiles(pix(spark, d), 4, 4, SIDE, SIDE)
    down, across = F.floor(F.col("ty") / 4) % 2, F.floor(F.col("tx") / 4) % 2
    return t.select("img", "ty", "tx", (down * 2 + across).alias("flip"), F.when(down == 1, 3 - F.col("ly")).otherwise(F.col("ly")).alias("ly"), F.when(across == 1, 3 - F.col("lx")).otherwise(F.col("lx")).alias("lx"), "v")


@register("percentile_scribbles", sql("pix", "SELECT img, pos, v >= hi AS object FROM pix JOIN (SELECT img, quantile_cont(v, 0.66) AS hi, quantile_cont(v, 0.35) AS lo FROM pix GROUP BY img) USING (img) WHERE v >= hi OR v <= lo"))
def percentile_scribbles(spark, d):
    """Seeds of the object above the 66th percentile of an image, of the background below the 35th."""
    rows = pix(spark, d)
    ends = rows.groupBy("img").agg(F.percentile("v", F.array(F.lit(0.66), F.lit(0.35))).alias("q"))
    return rows.join(ends, "img").where("v >= q[0] or v <= q[1]").select("img", "pos", (F.col("v") >= F.col("q")[0]).alias("object"))


@register("training_filter", sql("lab", "SELECT img, n, round(greatest(5, d), 6) AS diameter, round(n / sum(n) OVER (), 9) AS p FROM (SELECT img, count(*) AS n, quantile_cont(sqrt(area), 0.5) / (sqrt(pi()) / 2) AS d FROM (SELECT img, gt, count(*) AS area FROM lab WHERE gt > 0 GROUP BY ALL) GROUP BY img) WHERE n >= 4"))
def training_filter(spark, d):
    """Images with enough instances, their diameter with a floor, and sampling weights that sum to one."""
    areas = lab(spark, d).where("gt > 0").groupBy("img", "gt").agg(F.count("*").alias("area"))
    rows = areas.groupBy("img").agg(F.count("*").alias("n"), (F.percentile(F.sqrt("area"), 0.5) / (F.sqrt(F.pi()) / 2)).alias("d")).where("n >= 4")
    total = rows.agg(F.sum("n").alias("total"))  # one row
    return rows.crossJoin(F.broadcast(total)).select("img", "n", F.round(F.greatest(F.lit(5.0), F.col("d")), 6).alias("diameter"), F.round(F.col("n") / F.col("total"), 9).alias("p"))


#: All pairs of vectors: fit for tables of a few thousand rows.
NEAREST = "SELECT vec_id, id, label, k, d FROM (SELECT q.vec_id, r.vec_id AS id, r.label, round(list_sum(list_transform(list_zip(q.embedding, r.embedding), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2]))), 9) AS d, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_sum(list_transform(list_zip(q.embedding, r.embedding), lambda z: (CAST(z[1] AS DOUBLE) - z[2]) * (CAST(z[1] AS DOUBLE) - z[2]))), 9), r.vec_id) AS INTEGER) AS k FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id) WHERE k <= 5"


@register("style_neighbours", f"SELECT vec_id, k, id, round(d, 6) AS d FROM ({NEAREST})")
def style_neighbours(spark, d):
    """The five nearest of every vector among all others, with squared distances."""
    near = neighbours.nearest(spark.read.parquet(f"{d}/embeddings.parquet"))
    return near.select("vec_id", "k", "id", F.round("d", 6).alias("d"))


@register("style_labels", f"SELECT vec_id, label AS predicted FROM (SELECT vec_id, label, count(*) AS c FROM ({NEAREST}) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, label) = 1")
def style_labels(spark, d):
    """Labels of all vectors by the majority of their five nearest among all others."""
    return neighbours.nearest_labels(spark.read.parquet(f"{d}/embeddings.parquet"))


@register("style_components")
def style_components(spark, d):
    """Every vector in the three directions of largest variance."""
    found = neighbours.principal(spark.read.parquet(f"{d}/embeddings.parquet"), 3)
    return found.select("vec_id", "label", *[F.round(c, 6).alias(c) for c in ("pc1", "pc2", "pc3")])


@register("block_index_parse", "SELECT p_partkey, CAST(p_size AS INTEGER) AS bz, CAST(p_partkey % 7 AS INTEGER) AS \"by\", CAST(p_partkey % 3 AS INTEGER) AS bx FROM part")
def block_index_parse(spark, d):
    """Block indices out of file names, for folders that hold one file per block."""
    s = lambda c: c.cast("string")
    name = F.concat(F.lit("vol_Z"), s(F.col("p_size")), F.lit("Y"), s(F.col("p_partkey") % 7), F.lit("X"), s(F.col("p_partkey") % 3), F.lit(".tif"))
    pattern = r"_Z(\d+)Y(\d+)X(\d+)"
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", name.alias("name")).select("p_partkey", *[F.regexp_extract("name", pattern, j).cast("int").alias(n) for j, n in ((1, "bz"), (2, "by"), (3, "bx"))])
