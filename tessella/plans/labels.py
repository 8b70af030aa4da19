"""Queries on label maps: overlap, matching, boundary metrics, set operations, blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import blocks as blocks_
from tessella.operators import boundary as b
from tessella.operators import choices, distance, kernels
from tessella.operators import labels as l
from tessella.operators import metrics as m
from tessella.plans.fixtures import LARGE, SIDE, SQL, grid, lab, lab_big, mosaic, on_mosaic, pix, sql
from tessella.plans.registry import register


def r6(c: str, name: str | None = None) -> F.Column:
    return F.round(c, 6).alias(name or c)


def table(spark: SparkSession, d: str) -> DataFrame:
    return l.contingency(lab(spark, d))


def settled(spark: SparkSession, d: str) -> DataFrame:
    """The contingency, computed once for plans that read it in several branches."""
    return l.settle(table(spark, d))


@register("iou_pairs", sql("pairs", "SELECT img, gt, pr, n, CAST(ga AS BIGINT) AS ga, CAST(pa AS BIGINT) AS pa, round(iou, 6) AS iou FROM pairs"))
def iou_pairs(spark, d):
    return l.iou_pairs(table(spark, d)).select("img", "gt", "pr", "n", "ga", "pa", r6("iou"))


@register("label_overlap", sql("cont", "SELECT * FROM cont"))
def label_overlap(spark, d):
    return table(spark, d)


@register("label_overlap_large", sql("lab_big", "SELECT img, gt, pr, count(*) AS n FROM lab_big GROUP BY ALL"))
def label_overlap_large(spark, d):
    return l.contingency(lab_big(spark, d))


@register("iou_with_background", sql("area", "SELECT img, gt, pr, round(n / (ga + pa - n), 6) AS iou FROM area"))
def iou_with_background(spark, d):
    return l.iou_pairs(table(spark, d), background=True).select("img", "gt", "pr", r6("iou"))


@register("pixel_dice", sql("cont", """SELECT img, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 1 END, 6) AS dice,
    round(CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 1 END, 6) AS iou FROM s""",
    s="SELECT img, coalesce(sum(n) FILTER (gt > 0 AND pr > 0), 0) AS tp, coalesce(sum(n) FILTER (gt = 0 AND pr > 0), 0) AS fp, coalesce(sum(n) FILTER (gt > 0 AND pr = 0), 0) AS fn FROM cont GROUP BY img"))
def pixel_dice(spark, d):
    return m.foreground(table(spark, d)).select("img", "tp", "fp", "fn", r6("dice"), r6("iou"))


@register("region_f_area", sql("cont", """SELECT img, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM (
    SELECT img, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) WHEN fn = 0 THEN 1 ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1 END AS r FROM s)""",
    s="SELECT img, coalesce(sum(n) FILTER (gt > 0 AND pr > 0), 0) AS tp, coalesce(sum(n) FILTER (gt = 0 AND pr > 0), 0) AS fp, coalesce(sum(n) FILTER (gt > 0 AND pr = 0), 0) AS fn FROM cont GROUP BY img"))
def region_f_area(spark, d):
    rows = m.foreground(table(spark, d))
    return rows.select("img", *[F.round(c, 6).alias(k) for k, c in m.region_f(F.col("tp"), F.col("fp"), F.col("fn")).items()])


TWO = "SELECT unnest([0.5::DOUBLE, 0.75::DOUBLE]) AS t"


@register("detection_f1", sql("det", """SELECT img, t, tp, n_pr - tp AS fp, n_gt - tp AS fn, round(CASE WHEN n_gt + n_pr = 0 THEN 1 WHEN n_pr = 0 THEN 0 ELSE tp / n_pr END, 6) AS precision,
    round(CASE WHEN n_gt + n_pr = 0 THEN 1 WHEN n_gt = 0 THEN 0 ELSE tp / n_gt END, 6) AS recall, round(CASE WHEN n_gt + n_pr = 0 THEN 1 ELSE 2 * tp / (n_gt + n_pr) END, 6) AS f1 FROM det""", ts=TWO))  # fmt: skip
def detection_f1(spark, d):
    rows = m.detection(settled(spark, d), (0.5, 0.75))
    return rows.select("img", "t", "tp", "fp", "fn", r6("precision"), r6("recall"), r6("f1"))


@register("average_precision", sql("det", """SELECT img, t, round(tp / nullif(n_gt + n_pr - tp, 0), 6) AS ap, round((n_gt + n_pr - 2 * tp) / nullif(n_gt, 0), 6) AS error_rate FROM det""", ts=SQL["steps"]))
def average_precision(spark, d):
    return m.detection(settled(spark, d), m.STEPS).select("img", "t", r6("ap"), r6("error_rate"))


PQ = "SELECT c.img, n_gt, n_pr, count(p.img) AS tp, coalesce(sum(p.iou), 0) AS s FROM counts c LEFT JOIN pairs p ON p.img = c.img AND p.iou > 0.5 GROUP BY ALL"
PQ_OUT = "CASE WHEN n_gt + n_pr = 0 THEN 1 WHEN tp = 0 THEN 0 ELSE s / tp END AS sq, CASE WHEN n_gt + n_pr = 0 THEN 1 ELSE 2 * tp / (n_gt + n_pr) END AS rq"


@register("panoptic_quality", sql("counts pairs", f"SELECT img, n_gt, n_pr, tp, round(sq, 6) AS sq, round(rq, 6) AS rq, round(sq * rq, 6) AS pq FROM (SELECT *, {PQ_OUT} FROM q)", q=PQ))
def panoptic_quality(spark, d):
    return m.panoptic(settled(spark, d)).select("img", "n_gt", "n_pr", "tp", r6("sq"), r6("rq"), r6("pq"))


AJI = """SELECT c.img, CASE WHEN n_gt + n_pr = 0 THEN 1 WHEN n_gt = 0 OR n_pr = 0 THEN 0 ELSE (SELECT coalesce(sum(n), 0) FROM best b WHERE b.img = c.img) / (
    coalesce((SELECT sum(ga + pa - n) FROM best b WHERE b.img = c.img), 0)
    + coalesce((SELECT sum(ga) FROM (SELECT DISTINCT img, gt, ga FROM area WHERE gt > 0) g WHERE g.img = c.img AND NOT EXISTS (SELECT 1 FROM best b WHERE b.img = g.img AND b.gt = g.gt)), 0)
    + coalesce((SELECT sum(pa) FROM (SELECT DISTINCT img, pr, pa FROM area WHERE pr > 0) p WHERE p.img = c.img AND NOT EXISTS (SELECT 1 FROM best b WHERE b.img = p.img AND b.pr = p.pr)), 0)) END AS aji FROM counts c"""


@register("aji", sql("counts best", "SELECT img, round(aji, 6) AS aji FROM a", a=AJI))
def aji(spark, d):
    return m.aggregated_jaccard(settled(spark, d)).select("img", r6("aji"))


MAP = "SELECT img, avg(CASE WHEN n_gt > 0 AND n_pr > 0 THEN tp / (n_gt + n_pr - tp) ELSE 0 END) AS map FROM det GROUP BY img"


@register("dsb_map", sql("det", "SELECT img, round(map, 6) AS map FROM mp", ts=SQL["steps"], mp=MAP))
def dsb_map(spark, d):
    return m.mean_precision(settled(spark, d)).select("img", r6("map"))


@register("evaluate_macro", sql("det best", """SELECT count(*) AS images, round(avg(pq), 6) AS pq, round(avg(aji), 6) AS aji, round(avg(map), 6) AS map, count(*) FILTER (n_gt >= 4) AS dense,
    round(avg(pq) FILTER (n_gt >= 4), 6) AS dense_pq FROM (SELECT img, n_gt, sq * rq AS pq FROM (SELECT *, """ + PQ_OUT + " FROM q)) JOIN a USING (img) JOIN mp USING (img)", ts=SQL["steps"], q=PQ, a=AJI, mp=MAP))  # fmt: skip
def evaluate_macro(spark, d):
    rows, dense = m.evaluate(settled(spark, d)), F.col("n_gt") >= 4
    return rows.agg(F.count("*").alias("images"), *[F.round(F.avg(k), 6).alias(k) for k in ("pq", "aji", "map")], F.count_if(dense).alias("dense"), F.round(F.avg(F.when(dense, F.col("pq"))), 6).alias("dense_pq"))


@register("best_match_per_gt", sql("area best", """SELECT g.img, g.gt, CAST(g.ga AS BIGINT) AS ga, coalesce(b.pr, 0) AS pr, round(coalesce(b.iou, 0), 6) AS iou, round(coalesce(2 * b.n / (b.ga + b.pa), 0), 6) AS dice
    FROM (SELECT DISTINCT img, gt, ga FROM area WHERE gt > 0) g LEFT JOIN best b ON b.img = g.img AND b.gt = g.gt"""))  # fmt: skip
def best_match_per_gt(spark, d):
    t = settled(spark, d)
    areas = t.groupBy("img", "gt").agg(F.sum("n").alias("ga"))
    return l.best_match(l.iou_pairs(t), areas).select("img", "gt", "ga", "pr", r6("iou"), r6("dice"))


@register("largest_overlap", sql("pairs", "SELECT img, gt, pr FROM pairs QUALIFY row_number() OVER (PARTITION BY img, gt ORDER BY n DESC, pr) = 1"))
def largest_overlap(spark, d):
    return l.largest_overlap(table(spark, d))


@register("class_aware_counts", sql("pairs", """SELECT g.class, coalesce(tp, 0) AS tp, n_pr - coalesce(tp, 0) AS fp, n_gt - coalesce(tp, 0) AS fn
    FROM (SELECT gt % 2 AS class, count(*) AS n_gt FROM (SELECT DISTINCT img, gt FROM cont WHERE gt > 0) GROUP BY 1) g JOIN (SELECT pr % 2 AS class, count(*) AS n_pr FROM (SELECT DISTINCT img, pr FROM cont WHERE pr > 0) GROUP BY 1) p USING (class)
    LEFT JOIN (SELECT gt % 2 AS class, count(*) AS tp FROM pairs WHERE iou > 0.5 AND gt % 2 = pr % 2 GROUP BY 1) USING (class)"""))  # fmt: skip
def class_aware_counts(spark, d):
    t = settled(spark, d)
    kinds = [t.where(F.col(k) > 0).select("img", k, (F.col(k) % 2).alias(f"{k}_class")).distinct() for k in ("gt", "pr")]
    return m.class_aware(t, *kinds)


SHAPES = "SELECT img, gt, count(*) AS area, min(y) AS r0, max(y) + 1 AS r1, min(x) AS c0, max(x) + 1 AS c1, avg(y) AS cy, avg(x) AS cx FROM lab WHERE gt > 0 GROUP BY ALL"


@register("instance_shapes", sql("lab", "SELECT img, gt, area, r0, r1, c0, c1, round(cy, 6) AS cy, round(cx, 6) AS cx, CAST(trunc(cy) AS INTEGER) AS iy, CAST(trunc(cx) AS INTEGER) AS ix FROM s", s=SHAPES))
def instance_shapes(spark, d):
    rows = l.shapes(lab(spark, d), "gt")
    return rows.select("img", "gt", "area", "r0", "r1", "c0", "c1", r6("cy"), r6("cx"), F.col("cy").cast("int").alias("iy"), F.col("cx").cast("int").alias("ix"))


@register("crop_boxes", sql("lab", "SELECT img, gt, greatest(0, r0 - 2) AS r0, least(8, r1 + 2) AS r1, greatest(0, c0 - 2) AS c0, least(8, c1 + 2) AS c1 FROM s", s=SHAPES))
def crop_boxes(spark, d):
    rows = l.shapes(lab(spark, d), "gt")
    return rows.select("img", "gt", *[c.alias(k) for k, c in l.crop({k: k for k in ("r0", "r1", "c0", "c1")}, 2, SIDE, SIDE).items()])


@register("dense_relabel", sql("grid", "SELECT img, y, x, label, CAST(CASE WHEN label = 0 THEN 0 ELSE dense_rank() OVER (PARTITION BY img, label > 0 ORDER BY label) END AS INTEGER) AS new FROM grid"))
def dense_relabel(spark, d):
    return l.relabel(grid(spark, d), "label").select("img", "y", "x", "label", "new")


@register("small_filter", sql("grid", "SELECT img, y, x, CASE WHEN label > 0 AND count(*) OVER (PARTITION BY img, label) < 4 THEN 0 ELSE label END AS label FROM grid"))
def small_filter(spark, d):
    return l.drop_small(grid(spark, d), "label", 4).select("img", "y", "x", "label")


@register("edge_filter", sql("grid", """SELECT img, y, x, label, CAST(dense_rank() OVER (PARTITION BY img ORDER BY label) AS INTEGER) AS new FROM grid g WHERE label > 0
    AND NOT EXISTS (SELECT 1 FROM grid e WHERE e.img = g.img AND e.label = g.label AND (e.y IN (0, 7) OR e.x IN (0, 7)))"""))  # fmt: skip
def edge_filter(spark, d):
    return l.drop_at_edge(grid(spark, d), "label", SIDE, SIDE).select("img", "y", "x", "label", "new")


@register("seed_union", sql("pairs", """SELECT img, pr, CAST(coalesce(top, 0) + row_number() OVER (PARTITION BY img ORDER BY pr) AS INTEGER) AS new FROM (SELECT img, pr, sum(n) AS pa FROM cont WHERE pr > 0 GROUP BY ALL HAVING sum(n) >= 5) p
    LEFT JOIN (SELECT img, max(gt) AS top FROM cont GROUP BY img) USING (img) WHERE NOT EXISTS (SELECT 1 FROM pairs q WHERE q.img = p.img AND q.pr = p.pr AND q.iou >= 0.3)"""))  # fmt: skip
def seed_union(spark, d):
    t = settled(spark, d)
    areas = t.groupBy("img", "pr").agg(F.sum("n").alias("pa")).withColumn("saliency", F.lit(1.0))
    return l.union_seeds(l.iou_pairs(t), t.groupBy("img", "gt").agg(F.sum("n").alias("ga")), areas, 0.3, 5)


@register("novel_seeds", sql("cont", """SELECT img, pr, CAST(row_number() OVER (PARTITION BY img ORDER BY pr) AS INTEGER) AS new FROM (SELECT DISTINCT img, pr FROM cont WHERE pr > 0) p
    WHERE NOT EXISTS (SELECT 1 FROM cont q WHERE q.img = p.img AND q.pr = p.pr AND q.gt > 0)"""))  # fmt: skip
def novel_seeds(spark, d):
    return l.novel(settled(spark, d))


@register("fill_merge", sql("lab", """SELECT img, y, x, CAST(CASE WHEN gt > 0 THEN gt ELSE coalesce(fresh, 0) END AS INTEGER) AS merged FROM lab LEFT JOIN (SELECT img, pr, top + row_number() OVER (PARTITION BY img ORDER BY pr) AS fresh
    FROM (SELECT DISTINCT img, pr FROM lab WHERE gt = 0 AND pr > 0) JOIN (SELECT img, max(gt) AS top FROM lab GROUP BY img) USING (img)) USING (img, pr)"""))  # fmt: skip
def fill_merge(spark, d):
    return l.fill_merge(lab(spark, d)).select("img", "y", "x", "merged")


@register("merge_layers", sql("lab", """SELECT img, y, x, CAST(dense_rank() OVER (PARTITION BY img ORDER BY id) AS INTEGER) AS new FROM (SELECT img, y, x, CASE WHEN pr > 0 THEN pr + top ELSE gt END AS id
    FROM lab JOIN (SELECT img, max(gt) AS top FROM lab GROUP BY img) USING (img)) WHERE id > 0"""))  # fmt: skip
def merge_layers(spark, d):
    rows = lab(spark, d)
    layers = rows.select("img", "y", "x", F.explode(F.array(F.struct(F.lit(0).alias("layer"), F.col("gt").alias("label")), F.struct(F.lit(1).alias("layer"), F.col("pr").alias("label")))).alias("s"))
    return l.merge_layers(layers.select("img", "y", "x", "s.layer", "s.label")).select("img", "y", "x", "new")


@register("merge_channels", sql("lab", "SELECT img, y, x, CASE WHEN pr > 0 THEN pr + max(gt) OVER (PARTITION BY img) ELSE gt END AS label FROM lab"))
def merge_channels(spark, d):
    return l.merge_channels(lab(spark, d), "gt", "pr").select("img", "y", "x", "label")


CLAIMS = "SELECT img, y, x, unnest([gt, pr]) AS label FROM lab"


def claims(spark, d):
    return lab(spark, d).select("img", "y", "x", F.explode(F.array("gt", "pr")).alias("label")).where("label > 0")


@register("overlap_last_wins", sql("lab", "SELECT img, y, x, max(label) AS label FROM c WHERE label > 0 GROUP BY ALL", c=CLAIMS))
def overlap_last_wins(spark, d):
    return l.resolve_overlap(claims(spark, d), last=True)


@register("overlap_first_wins", sql("lab", "SELECT img, y, x, min(label) AS label FROM c WHERE label > 0 GROUP BY ALL", c=CLAIMS))
def overlap_first_wins(spark, d):
    return l.resolve_overlap(claims(spark, d), last=False)


@register("majority_vote", sql("lab", "SELECT img, y, x, 2 * count(*) FILTER (label > 0) >= count(*) AS object FROM c GROUP BY ALL", c=CLAIMS))
def majority_vote(spark, d):
    return l.majority(lab(spark, d).select("img", "y", "x", F.explode(F.array(F.col("gt") > 0, F.col("pr") > 0)).alias("object")))


@register("diff_map_counts", sql("lab", """SELECT img, count(*) FILTER (gt = pr) AS same, count(*) FILTER (gt <> pr) AS differ, count(*) FILTER (gt > 0 AND pr = 0) AS only_gt,
    count(*) FILTER (gt = 0 AND pr > 0) AS only_pr, count(*) FILTER (gt > 0 AND pr > 0 AND gt <> pr) AS both FROM lab GROUP BY img"""))  # fmt: skip
def diff_map_counts(spark, d):
    return l.difference_counts(lab(spark, d))


NODES = "SELECT img * 64 + pos AS node, img, y, x FROM pix WHERE v > 0"
REACH = "SELECT node, node AS root FROM nodes UNION SELECT n.node, r.root FROM reach r JOIN nodes m ON m.node = r.node JOIN nodes n ON n.img = m.img AND abs(n.y - m.y) <= 1 AND abs(n.x - m.x) <= 1"


def neighbours(rows: DataFrame, offsets) -> DataFrame:
    step = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets]))
    moved = rows.withColumn("s", step).select("img", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), F.col("node").alias("a"))
    return moved.join(rows.withColumnRenamed("node", "b"), ["img", "y", "x"]).select("a", "b")


def band() -> F.Column:
    """Pixels whose numbers share all but the last 14 bits are joined together first."""
    return F.shiftright("a", 14)


@register("pixel_components", sql("pix", "SELECT node, min(root) AS root FROM reach GROUP BY node", recursive=True, nodes=NODES, reach=REACH))
def pixel_components(spark, d):
    rows = pix(spark, d).where("v > 0").select((F.col("img") * 64 + F.col("pos")).alias("node"), "img", "y", "x")
    return l.components(neighbours(rows, [(0, 1), (1, -1), (1, 0), (1, 1)]), rows, near=band())


BLOCKS = "SELECT img, y, x, (img * 4 + (y // 4) * 2 + x // 4) * 4294967296 + 1 AS id FROM pix WHERE v > 0"
TOUCH = "SELECT DISTINCT a.id AS a, b.id AS b FROM ids a JOIN ids b ON a.img = b.img AND ((a.y = b.y AND a.x % 4 = 3 AND b.x = a.x + 1) OR (a.x = b.x AND a.y % 4 = 3 AND b.y = a.y + 1))"


def blocks(spark, d):
    block = F.col("img") * 4 + F.floor(F.col("y") / 4) * 2 + F.floor(F.col("x") / 4)
    return pix(spark, d).select("img", "y", "x", l.global_ids(block, (F.col("v") > 0).cast("int")).alias("id"))


@register("block_faces", sql("pix", "SELECT * FROM touch", ids=BLOCKS, touch=TOUCH))
def block_faces(spark, d):
    return l.block_faces(blocks(spark, d), 4).select("a", "b")


@register("block_merge", sql("pix", "SELECT img, root, count(DISTINCT id) AS parts, min(y) AS r0, max(y) + 1 AS r1, min(x) AS c0, max(x) + 1 AS c1 FROM ids JOIN (SELECT node, min(root) AS root FROM reach GROUP BY node) ON node = id GROUP BY ALL",
    recursive=True, ids=BLOCKS, touch=TOUCH, ends="SELECT a, b FROM touch UNION SELECT b, a FROM touch", reach="SELECT DISTINCT id AS node, id AS root FROM ids UNION SELECT t.b, r.root FROM reach r JOIN ends t ON t.a = r.node"))
def block_merge(spark, d):
    ids = blocks(spark, d).where("id > 0")
    roots = l.components(l.block_faces(ids, 4), ids.select(F.col("id").alias("node")).distinct())
    boxes = ids.groupBy("img", "id").agg(F.min("y").alias("r0"), (F.max("y") + 1).alias("r1"), F.min("x").alias("c0"), (F.max("x") + 1).alias("c1")).join(roots, F.col("id") == F.col("node"))
    parts = boxes.groupBy("root").agg(F.first("img").alias("img"), F.count("*").alias("parts"))
    return parts.join(l.merge_boxes(boxes, "root"), "root").select("img", "root", "parts", "r0", "r1", "c0", "c1")


@register("label_dilation", sql("grid", """SELECT img, y, x, label FROM (SELECT g.img, CAST(g.y + dy AS INTEGER) AS y, CAST(g.x + dx AS INTEGER) AS x, label, dy = 0 AND dx = 0 AS own FROM grid g, range(-1, 2) a(dy), range(-1, 2) b(dx) WHERE label > 0)
    WHERE y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7 QUALIFY row_number() OVER (PARTITION BY img, y, x ORDER BY own DESC, label DESC) = 1"""))  # fmt: skip
def label_dilation(spark, d):
    return l.dilate(grid(spark, d), "label", SIDE, SIDE)


@register("label_erosion", sql("grid", """SELECT g.img, g.y, g.x, g.label FROM grid g WHERE label > 0 AND 4 = (SELECT count(*) FROM grid n WHERE n.img = g.img AND n.label = g.label AND abs(n.y - g.y) + abs(n.x - g.x) = 1)"""))
def label_erosion(spark, d):
    return l.erode(grid(spark, d), "label").where("inner").select("img", "y", "x", "label")


THICK = "SELECT a.img, a.y, a.x, bool_or(a.gt <> b.gt) AS bg, bool_or(a.pr <> b.pr) AS bp FROM lab a JOIN lab b ON a.img = b.img AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY ALL"
NEAR = "(o.y - s.y) * (o.y - s.y) + (o.x - s.x) * (o.x - s.x) <= 4"


@register("thick_boundary_pixels", sql("lab", "SELECT img, count(*) FILTER (bg) AS n_gt, count(*) FILTER (bp) AS n_pr FROM th GROUP BY img", th=THICK))
def thick_boundary_pixels(spark, d):
    rows = lab(spark, d)
    return b.bordered(rows, {"bg": "gt", "bp": "pr"}, b.CROSS).groupBy("img").agg(F.count_if("bg").alias("n_gt"), F.count_if("bp").alias("n_pr"))


@register("br_pooled", sql("lab", f"""SELECT round(r, 6) AS recall, round(p, 6) AS precision, round(2 * r * p / (r + p), 6) AS f FROM (SELECT
    (SELECT avg(CASE WHEN EXISTS (SELECT 1 FROM th o WHERE o.img = s.img AND o.bp AND {NEAR}) THEN 1 ELSE 0 END) FROM th s WHERE bg) AS r,
    (SELECT avg(CASE WHEN EXISTS (SELECT 1 FROM th o WHERE o.img = s.img AND o.bg AND {NEAR}) THEN 1 ELSE 0 END) FROM th s WHERE bp) AS p)""", th=THICK))  # fmt: skip
def br_pooled(spark, d):
    return b.pooled(lab(spark, d)).select(r6("recall"), r6("precision"), r6("f"))


CROPS = """SELECT l.img, s.gt AS cell, l.y, l.x, CAST(l.gt = s.gt AS INTEGER) AS g, CAST(coalesce(l.pr = t.pr, false) AS INTEGER) AS p, least(8, r1 + 1) - greatest(0, r0 - 1) AS h, least(8, c1 + 1) - greatest(0, c0 - 1) AS w
    FROM s LEFT JOIN (SELECT img, gt, pr FROM pairs QUALIFY row_number() OVER (PARTITION BY img, gt ORDER BY n DESC, pr) = 1) t ON t.img = s.img AND t.gt = s.gt
    JOIN lab l ON l.img = s.img AND l.y >= r0 - 1 AND l.y < r1 + 1 AND l.x >= c0 - 1 AND l.x < c1 + 1"""


def crops(spark, d):
    rows = lab(spark, d)
    return b.cells(rows, l.contingency(rows), 1, SIDE, SIDE)


@register("br_macro", sql("pairs", f"""SELECT img, count(*) AS cells, round(avg(br), 6) AS br FROM (SELECT s.img, s.cell, avg(CASE WHEN s.bg THEN CAST(EXISTS (SELECT 1 FROM cb o WHERE o.img = s.img AND o.cell = s.cell AND o.bp AND {NEAR}) AS INTEGER) END) AS br
    FROM cb s GROUP BY ALL) GROUP BY img""", s=SHAPES, cr=CROPS, cb="SELECT a.img, a.cell, a.y, a.x, bool_or(a.g <> b.g) AS bg, bool_or(a.p <> b.p) AS bp FROM cr a JOIN cr b ON a.img = b.img AND a.cell = b.cell AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY ALL"))  # fmt: skip
def br_macro(spark, d):
    return b.recall_by_cell(crops(spark, d)).groupBy("img").agg(F.count("*").alias("cells"), F.round(F.avg("br"), 6).alias("br"))


CONTOUR = """SELECT a.img, a.cell, a.y, a.x, CAST(ceil(0.0075 * sqrt(a.h * a.h + a.w * a.w)) AS INTEGER) AS r, bool_or(b.y IS NOT NULL AND a.g <> b.g) AS bg, bool_or(b.y IS NOT NULL AND a.p <> b.p) AS bp
    FROM cr a LEFT JOIN cr b ON a.img = b.img AND a.cell = b.cell AND b.y - a.y IN (0, 1) AND b.x - a.x IN (0, 1) AND (b.y, b.x) <> (a.y, a.x) GROUP BY ALL"""


@register("fb_macro", sql("pairs", """SELECT img, count(*) AS cells, round(avg(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END), 6) AS fb FROM (
    SELECT img, cell, CASE WHEN np = 0 THEN 1 WHEN ng = 0 THEN 0 ELSE hp / np END AS pr, CASE WHEN ng = 0 THEN 1 WHEN np = 0 THEN 0 ELSE hg / ng END AS rc FROM (
    SELECT s.img, s.cell, count(*) FILTER (s.bg) AS ng, count(*) FILTER (s.bp) AS np,
    count(*) FILTER (s.bg AND EXISTS (SELECT 1 FROM cb o WHERE o.img = s.img AND o.cell = s.cell AND o.bp AND (o.y - s.y) * (o.y - s.y) + (o.x - s.x) * (o.x - s.x) <= greatest(1, s.r * s.r))) AS hg,
    count(*) FILTER (s.bp AND EXISTS (SELECT 1 FROM cb o WHERE o.img = s.img AND o.cell = s.cell AND o.bg AND (o.y - s.y) * (o.y - s.y) + (o.x - s.x) * (o.x - s.x) <= greatest(1, s.r * s.r))) AS hp
    FROM cb s GROUP BY ALL)) GROUP BY img""", s=SHAPES, cr=CROPS, cb=CONTOUR))  # fmt: skip
def fb_macro(spark, d):
    return b.contour_f_by_cell(crops(spark, d)).groupBy("img").agg(F.count("*").alias("cells"), F.round(F.avg("f"), 6).alias("fb"))


@register("fa_macro", sql("pairs", """SELECT img, count(*) AS cells, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS fa FROM (SELECT img, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) WHEN fn = 0 THEN 1 ELSE 0 END AS p,
    CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1 END AS r FROM (SELECT img, cell, sum(g * p) AS tp, sum((1 - g) * p) AS fp, sum(g * (1 - p)) AS fn FROM cr GROUP BY ALL)) GROUP BY img""", s=SHAPES, cr=CROPS))  # fmt: skip
def fa_macro(spark, d):
    return b.region_f_by_cell(crops(spark, d)).groupBy("img").agg(F.count("*").alias("cells"), F.round(F.avg("f1"), 6).alias("fa"))


@register("br_window", sql("lab", """SELECT img, round(CASE WHEN count(*) FILTER (bg) > 0 THEN count(*) FILTER (bg AND bp) / count(*) FILTER (bg) ELSE 1 END, 6) AS br FROM (
    SELECT a.img, a.y, a.x, bool_or(a.gt <> b.gt) AS bg, bool_or(a.pr <> b.pr) AS bp FROM lab a JOIN lab b ON a.img = b.img AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL) GROUP BY img"""))  # fmt: skip
def br_window(spark, d):
    return b.window_recall(lab(spark, d), 1).select("img", r6("br"))


@register("per_cell_winner_rollup", sql("pairs", """SELECT coalesce(CAST(img % 5 AS VARCHAR), 'ALL') AS slice, count(*) AS cells, count(*) FILTER (d > 0.02) AS a, count(*) FILTER (d < -0.02) AS b, count(*) FILTER (abs(d) <= 0.02) AS tie
    FROM (SELECT img, gt, max(iou) - max(n / ga) AS d FROM pairs GROUP BY ALL) GROUP BY ROLLUP (img % 5)"""))  # fmt: skip
def per_cell_winner_rollup(spark, d):
    from tessella.operators.compare import cell_winner

    cells = l.iou_pairs(table(spark, d)).groupBy("img", "gt").agg(F.max("iou").alias("a"), F.max(F.col("n") / F.col("ga")).alias("b"))
    won = cells.select((F.col("img") % 5).cast("string").alias("s"), cell_winner(F.col("a"), F.col("b")).alias("w"))
    out = won.rollup("s").agg(F.count("*").alias("cells"), *[F.count_if(F.col("w") == k).alias(k) for k in ("a", "b", "tie")])
    return out.select(F.coalesce("s", F.lit("ALL")).alias("slice"), "cells", "a", "b", "tie")


@register("nearest_centroid", sql("lab", """SELECT l.img, l.y, l.x, arg_min(s.gt, struct_pack(d := round((l.y - cy) * (l.y - cy) + (l.x - cx) * (l.x - cx), 6), g := s.gt)) AS nearest FROM lab l JOIN s ON s.img = l.img AND s.gt IN (l.gt, l.pr) WHERE l.gt > 0 AND l.pr > 0 GROUP BY ALL""", s=SHAPES))
def nearest_centroid(spark, d):
    rows = lab(spark, d)
    middle = l.shapes(rows, "gt").select("img", F.col("gt").alias("c"), "cy", "cx")
    asked = rows.where("gt > 0 and pr > 0").select("img", "y", "x", F.explode(F.array_distinct(F.array("gt", "pr"))).alias("c")).join(middle, ["img", "c"])
    d2 = F.round((F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")) + (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")), 6)
    return asked.groupBy("img", "y", "x").agg(F.min_by("c", F.struct(d2.alias("d"), "c")).alias("nearest"))


@register("size_statistics", sql("lab", """SELECT img, count(*) AS n, round(quantile_cont(sqrt(area), 0.5) / (sqrt(pi()) / 2), 6) AS diameter, round(quantile_cont(sqrt(area) / 2, 0.5) / (sqrt(pi()) / 2), 6) AS radius,
    round(quantile_cont(area, 0.25) / quantile_cont(area, 0.75), 6) AS spread FROM s GROUP BY img""", s=SHAPES))  # fmt: skip
def size_statistics(spark, d):
    rows = l.shapes(lab(spark, d), "gt")
    root = F.sqrt("area")
    half = F.sqrt(F.pi()) / 2
    return rows.groupBy("img").agg(F.count("*").alias("n"), F.round(F.percentile(root, 0.5) / half, 6).alias("diameter"), F.round(F.percentile(root / 2, 0.5) / half, 6).alias("radius"), F.round(F.percentile("area", 0.25) / F.percentile("area", 0.75), 6).alias("spread"))


@register("radius_histogram", sql("lab", "SELECT img, bin, round(k / sum(k) OVER (PARTITION BY img), 6) AS share FROM (SELECT img, CAST(floor(sqrt(area) / 2 / 0.5) AS INTEGER) AS bin, count(*) AS k FROM s GROUP BY ALL)", s=SHAPES))
def radius_histogram(spark, d):
    from pyspark.sql import Window

    rows = l.shapes(lab(spark, d), "gt").groupBy("img", F.floor(F.sqrt("area") / 2 / 0.5).cast("int").alias("bin")).agg(F.count("*").alias("k"))
    return rows.select("img", "bin", F.round(F.col("k") / F.sum("k").over(Window.partitionBy("img")), 6).alias("share"))


@register("clip_to_dilated", sql("lab", "SELECT img, y, x, gt AS label FROM lab l WHERE gt > 0 AND EXISTS (SELECT 1 FROM lab o WHERE o.img = l.img AND o.pr = l.gt AND abs(o.y - l.y) <= 1 AND abs(o.x - l.x) <= 1)"))
def clip_to_dilated(spark, d):
    """Pixels of a label that lie on the other map's same label, dilated once."""
    return choices.clipped_to_dilated(lab(spark, d))


@register("distance_to_boundary", sql("lab", """SELECT l.img, l.y, l.x, min((l.y - b.y) * (l.y - b.y) + (l.x - b.x) * (l.x - b.x)) AS d2, min((l.y - b.y) * (l.y - b.y) + (l.x - b.x) * (l.x - b.x)) < 1 AS edge FROM lab l JOIN
    (SELECT img, y, x, gt FROM lab a WHERE gt > 0 AND (y IN (0, 7) OR x IN (0, 7) OR 4 > (SELECT count(*) FROM lab n WHERE n.img = a.img AND n.gt = a.gt AND abs(n.y - a.y) + abs(n.x - a.x) = 1))) b ON b.img = l.img AND b.gt = l.gt WHERE l.gt > 0 GROUP BY ALL"""))  # fmt: skip
def distance_to_boundary(spark, d):
    """Squared distance of each pixel to its label's own border, exact, by two passes of one axis each."""
    near = distance.to_own_border(lab(spark, d), "gt")
    return near.withColumn("edge", F.col("d2") < 1)


@register("outline_pixels", sql("lab", "SELECT img, gt, count(*) AS n FROM lab a WHERE gt > 0 AND 4 > (SELECT count(*) FROM lab n WHERE n.img = a.img AND n.gt = a.gt AND abs(n.y - a.y) + abs(n.x - a.x) = 1) GROUP BY ALL"))
def outline_pixels(spark, d):
    """Border pixels by label; the image's edge is border too."""
    return l.erode(lab(spark, d), "gt").where("gt > 0 and not inner").groupBy("img", "gt").agg(F.count("*").alias("n"))


@register("log_area_join", sql("lab", """SELECT s.img, s.gt, s.area, coalesce(p.n, 0) AS in_box, round(coalesce(p.n, 0) / s.area, 6) AS ratio, coalesce(p.n, 0) = s.area AS agrees FROM s LEFT JOIN
    (SELECT s.img, s.gt, count(*) AS n FROM s JOIN lab l ON l.img = s.img AND l.pr = s.gt AND l.y >= s.r0 AND l.y < s.r1 AND l.x >= s.c0 AND l.x < s.c1 GROUP BY ALL) p ON p.img = s.img AND p.gt = s.gt""", s=SHAPES))  # fmt: skip
def log_area_join(spark, d):
    """Area of a label and of the other map's same label within its box, with ratio and agreement."""
    return choices.area_in_box(lab(spark, d)).withColumn("ratio", F.round("ratio", 6))


@register("merged_by_winner", sql("area best", """SELECT l.img, l.y, l.x, max(CASE WHEN b.iou > 0.5 THEN CASE WHEN l.pr = b.pr THEN b.gt END ELSE CASE WHEN l.gt = b.gt THEN b.gt END END) AS label FROM lab l JOIN best b ON b.img = l.img AND (l.gt = b.gt OR l.pr = b.pr) GROUP BY ALL HAVING label IS NOT NULL"""))
def merged_by_winner(spark, d):
    """Each label's region from the map that does better on it, else its own; later labels overwrite."""
    return choices.merged_by_winner(lab(spark, d))


@register("largest_component", sql("pix", """SELECT img, root, n FROM (SELECT n.img, c.root, count(*) AS n FROM (SELECT node, min(root) AS root FROM reach GROUP BY node) c JOIN nodes n USING (node) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY img ORDER BY n DESC, root) = 1""", recursive=True, nodes=NODES, reach=REACH))
def largest_component(spark, d):
    """The largest component of each image, the first of equal ones."""
    rows = pix(spark, d).where("v > 0").select((F.col("img") * 64 + F.col("pos")).alias("node"), "img", "y", "x")
    return choices.largest_component(neighbours(rows, [(0, 1), (1, -1), (1, 0), (1, 1)]), rows, near=band())


@register("boundary_scales", sql("lab", """SELECT img, factor, round(CASE WHEN np > 0 THEN hp / np ELSE 0 END, 6) AS precision, round(CASE WHEN ng > 0 THEN hg / ng ELSE 0 END, 6) AS recall FROM (SELECT s.img, factor, count(*) FILTER (bg) AS ng, count(*) FILTER (bp) AS np,
    count(*) FILTER (bg AND EXISTS (SELECT 1 FROM th o WHERE o.img = s.img AND o.bp AND (o.y - s.y) * (o.y - s.y) + (o.x - s.x) * (o.x - s.x) <= r * r)) AS hg, count(*) FILTER (bp AND EXISTS (SELECT 1 FROM th o WHERE o.img = s.img AND o.bg AND (o.y - s.y) * (o.y - s.y) + (o.x - s.x) * (o.x - s.x) <= r * r)) AS hp
    FROM th s JOIN (SELECT img, factor, greatest(1, CAST(ceil(factor * d) AS INTEGER)) AS r FROM (SELECT img, quantile_cont(sqrt(area), 0.5) / (sqrt(pi()) / 2) AS d FROM s GROUP BY img), (SELECT unnest([0.25::DOUBLE, 0.5::DOUBLE]) AS factor)) q ON q.img = s.img GROUP BY ALL)""", th=THICK, s=SHAPES))  # fmt: skip
def boundary_scales(spark, d):
    rows = lab(spark, d)
    return b.scales(rows, l.contingency(rows), (0.25, 0.5)).select("img", "factor", r6("precision"), r6("recall"))


# Images of real size: the same SQL over a mosaic of 400 images, with up to 1,600 labels each.


@register("mosaic_detection", on_mosaic(sql("det", "SELECT img, t, n_gt, n_pr, tp FROM det", ts="SELECT unnest([0.5::DOUBLE, 0.75::DOUBLE]) AS t")))
def mosaic_detection(spark, d):
    return m.detection(l.contingency(mosaic(spark, d)), (0.5, 0.75)).select("img", "t", "n_gt", "n_pr", "tp")


@register("mosaic_matching", on_mosaic(sql("pairs", "SELECT img, CAST(coalesce(count(*) FILTER (iou >= 0.5), 0) AS BIGINT) AS tp, round(coalesce(sum(iou), 0), 6) AS iou_sum FROM pairs GROUP BY img")))
def mosaic_matching(spark, d):
    return m.optimal(l.contingency(mosaic(spark, d))).select("img", "tp", r6("iou_sum"))


@register("mosaic_recall", on_mosaic(sql("lab pairs", f"""SELECT m.img, m.cell, round(sum(CASE WHEN bg AND EXISTS (SELECT 1 FROM marked o WHERE o.img = m.img AND o.cell = m.cell AND o.bp AND (o.y - m.y) * (o.y - m.y) + (o.x - m.x) * (o.x - m.x) <= 4) THEN 1 ELSE 0 END) / nullif(count(*) FILTER (bg), 0), 6) AS br FROM marked m GROUP BY ALL""",
    s="SELECT img, gt, min(y) AS r0, max(y) + 1 AS r1, min(x) AS c0, max(x) + 1 AS c1 FROM lab WHERE gt > 0 GROUP BY ALL",
    crops="""SELECT l.img, s.gt AS cell, l.y, l.x, CAST(l.gt = s.gt AS INTEGER) AS g, CAST(coalesce(l.pr = t.pr, false) AS INTEGER) AS p FROM s LEFT JOIN (SELECT img, gt, pr FROM pairs QUALIFY row_number() OVER (PARTITION BY img, gt ORDER BY n DESC, pr) = 1) t ON t.img = s.img AND t.gt = s.gt
    JOIN lab l ON l.img = s.img AND l.y BETWEEN r0 - 1 AND r1 AND l.x BETWEEN c0 - 1 AND c1""",
    marked="SELECT a.img, a.cell, a.y, a.x, bool_or(a.g <> b.g) AS bg, bool_or(a.p <> b.p) AS bp FROM crops a JOIN crops b ON a.img = b.img AND a.cell = b.cell AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY ALL")))
def mosaic_recall(spark, d):
    rows = mosaic(spark, d)
    crops_ = l.settle(b.cells(rows, l.contingency(rows), 1, LARGE, LARGE))
    return b.recall_by_cell(crops_).select("img", "cell", r6("br"))


@register("mosaic_components", on_mosaic(sql("lab", "SELECT img, count(*) AS n, CAST(sum(area) AS BIGINT) AS area, max(area) AS largest FROM (SELECT img, root, count(*) AS area FROM (SELECT node, img, min(root) AS root FROM reach GROUP BY ALL) GROUP BY ALL) GROUP BY img", recursive=True,
    nodes="SELECT img, y * 160 + x AS node, y, x, gt FROM lab WHERE gt > 0", reach="SELECT img, node, node AS root FROM nodes UNION SELECT n.img, n.node, r.root FROM reach r JOIN nodes m ON m.img = r.img AND m.node = r.node JOIN nodes n ON n.img = m.img AND n.gt = m.gt AND abs(n.y - m.y) <= 1 AND abs(n.x - m.x) <= 1")))
def mosaic_components(spark, d):
    """Eight-neighbour components within each label of a large image."""
    def parts(a: np.ndarray) -> np.ndarray:
        out, top = np.zeros(a.shape, np.int64), 0
        for k, box in zip(*kernels.boxes(a), strict=True):
            found = kernels.components(a[box] == k)
            out[box] += np.where(found > 0, found + top, 0)
            top += int(found.max())
        return out

    found = kernels.per_image(mosaic(spark, d), parts, "gt", "part", LARGE, LARGE).where("part > 0").groupBy("img", "part").agg(F.count("*").alias("area"))
    return found.groupBy("img").agg(F.count("*").alias("n"), F.sum("area").alias("area"), F.max("area").alias("largest"))


@register("label_opening", sql("pix", "SELECT p.img, p.y, p.x, CASE WHEN d.img IS NULL THEN 2 ELSE 1 END AS label FROM pix p LEFT JOIN grown d USING (img, y, x)",
    fg="SELECT img, y, x FROM pix WHERE v > 0", eroded="SELECT a.img, a.y, a.x FROM fg a JOIN fg b ON a.img = b.img AND abs(a.y - b.y) + abs(a.x - b.x) <= 1 GROUP BY ALL HAVING count(*) = 5",
    grown="SELECT DISTINCT p.img, p.y, p.x FROM pix p JOIN eroded e ON p.img = e.img AND abs(p.y - e.y) + abs(p.x - e.x) <= 1"))
def label_opening(spark, d):
    rows = pix(spark, d).select("img", "y", "x", F.when(F.col("v") > 0, 1).otherwise(2).alias("label"))
    return l.opening(rows, "label", 1, SIDE, SIDE)


@register("label_borders", sql("pix", "SELECT a.img, a.y, a.x FROM fg a LEFT JOIN fg b ON a.img = b.img AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY ALL HAVING count(b.img) < 4", fg="SELECT img, y, x FROM pix WHERE v > 0"))
def label_borders(spark, d):
    """Pixels of the object with a four-neighbour that is not; the outside of the image is not."""
    rows = pix(spark, d).select("img", "y", "x", (F.col("v") > 0).cast("int").alias("object"))
    return l.erode(rows, "object").where("object = 1 and not inner").select("img", "y", "x")


@register("block_faces_shrunk", sql("pix", """SELECT DISTINCT a.id AS a, b.id AS b FROM kept a JOIN kept b ON a.img = b.img AND a.way = b.way AND a.along = b.along AND b.across = a.across + 1 AND a.across % 4 = 3""",
    ids=BLOCKS, every="SELECT p.img, p.y, p.x, coalesce(i.id, 0) AS id FROM pix p LEFT JOIN ids i USING (img, y, x)",
    lines="SELECT 'x' AS way, img, x AS across, y AS along, y // 4 AS block, id FROM every WHERE x % 4 IN (0, 3) UNION ALL SELECT 'y', img, y, x, x // 4, id FROM every WHERE y % 4 IN (0, 3)",
    flat="SELECT *, CASE WHEN coalesce(lag(id) OVER w, id) = coalesce(lead(id) OVER w, id) THEN id ELSE 0 END AS f FROM lines WINDOW w AS (PARTITION BY way, img, across, block ORDER BY along)",
    kept="SELECT way, img, across, along, id FROM flat WINDOW w AS (PARTITION BY way, img, across, block ORDER BY along) QUALIFY f <> 0 AND coalesce(lag(f) OVER w, f) <> 0 AND coalesce(lead(f) OVER w, f) <> 0"))
def block_faces_shrunk(spark, d):
    """Labels that touch across faces after they are shrunk along them."""
    return l.shrunk_faces(blocks(spark, d), 4).select("a", "b")


@register("block_segmentation", sql("pix", "SELECT img, count(*) AS n, CAST(sum(area) AS BIGINT) AS area, CAST(sum(r1 - r0) AS BIGINT) AS heights, CAST(sum(c1 - c0) AS BIGINT) AS widths FROM (SELECT n.img, r.root, count(*) AS area, min(y) AS r0, max(y) + 1 AS r1, min(x) AS c0, max(x) + 1 AS c1 FROM (SELECT node, min(root) AS root FROM reach GROUP BY node) r JOIN nodes n USING (node) GROUP BY ALL) GROUP BY img", recursive=True,
    nodes=NODES, reach="SELECT node, node AS root FROM nodes UNION SELECT n.node, r.root FROM reach r JOIN nodes m ON m.node = r.node JOIN nodes n ON n.img = m.img AND abs(n.y - m.y) + abs(n.x - m.x) <= 1"))
def block_segmentation(spark, d):
    """Components found block by block and joined across faces are those of the whole images: many blocks of few pixels, which packed tiles do not suit."""
    parts = blocks_.run_blocks(pix(spark, d), lambda stack: kernels.each_components(stack > 0, kernels.FOUR), "v", 4, 0, SIDE, SIDE, stacked=True)
    joined, boxes = blocks_.join_blocks(parts, 4, 2)
    areas = joined.where("label > 0").groupBy("label").agg(F.first("img").alias("img"), F.count("*").alias("area")).join(boxes, "label")
    return areas.groupBy("img").agg(F.count("*").alias("n"), F.sum("area").alias("area"), F.sum(F.col("r1") - F.col("r0")).alias("heights"), F.sum(F.col("c1") - F.col("c0")).alias("widths"))
