"""Queries on runs: catalogues, pairing of files, benchmark runs, choices among candidates, and small per-image rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import text as t
from tessella.operators import choices, methods
from tessella.operators import pixels as p
from tessella.operators.compare import numbered
from tessella.operators.labels import contingency, iou_pairs
from tessella.operators.metrics import counts
from tessella.plans.fixtures import SIDE, grid, lab, pix, scores, sql, table
from tessella.plans.registry import register
from tessella.sources import images, tables


def files(spark, d, ending: str, below: int, suffix: str = "") -> DataFrame:
    """Paths of files of the parts below a size."""
    return table(spark, d, "part").where(F.col("p_size") < below).select(F.concat(F.lit("d/img"), F.col("p_partkey"), F.lit(f"{suffix}.{ending}")).alias("path"))


@register("label_pairing", "SELECT 'd/img' || p_partkey AS stem, CASE WHEN p_size < 10 THEN 'd/img' || p_partkey || '_masks.tif' WHEN p_size < 25 THEN 'd/img' || p_partkey || '_masks.tiff' WHEN p_size < 40 THEN 'd/img' || p_partkey || '_masks.png' END AS label_path FROM part")
def label_pairing(spark, d):
    """Each image with its label file, by an order of endings; one pass over the names of all label files."""
    every = table(spark, d, "part").select(F.concat(F.lit("d/img"), F.col("p_partkey")).alias("stem"))
    labels = files(spark, d, "tif", 10, "_masks").union(files(spark, d, "tiff", 25, "_masks")).union(files(spark, d, "png", 40, "_masks")).union(files(spark, d, "txt", 60, "_masks"))
    return images.pair_by_stem(every, labels, required=False).select("stem", "label_path")


@register("roi_catalogue", "SELECT category, p_name AS stem, CAST(row_number() OVER (ORDER BY category, p_name, p_partkey) AS BIGINT) AS place FROM (SELECT DISTINCT CASE WHEN p_size <= 25 THEN 'healthy' ELSE 'severe' END AS category, p_name, p_partkey FROM part WHERE p_size < 45 AND p_retailprice > 910)")
def roi_catalogue(spark, d):
    """Annotated regions that have an image, healthy ones first, then by name, numbered."""
    parts = table(spark, d, "part").withColumns({"category": F.when(F.col("p_size") <= 25, "healthy").otherwise("severe"), "stem": F.struct("p_name", "p_partkey")})
    found = images.catalogue(parts.where("p_size < 45"), parts.where("p_retailprice > 910").select("category", "stem"))
    return numbered(found.withColumnRenamed("at", "first"), ["first", "stem"], "place").select("category", F.col("stem.p_name").alias("stem"), (F.col("place") + 1).alias("place"))


#: Methods of the benchmark as expressions of a pixel's value.
METHODS = {"low": "v > -0.02", "zero": "v > 0", "high": "v > 0.05"}


@register("benchmark_run", sql("pix lab", """SELECT method, round(avg(dice), 6) AS dice, round(avg(iou), 6) AS iou, count(*) AS n, count(*) FILTER (fresh) AS fresh FROM (SELECT img, method, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 1 END AS dice, CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 1 END AS iou, true AS fresh
    FROM (SELECT img, method, count(*) FILTER (gt > 0 AND pr) AS tp, count(*) FILTER (gt = 0 AND pr) AS fp, count(*) FILTER (gt > 0 AND NOT pr) AS fn FROM made GROUP BY ALL) WHERE NOT (method = 'low' AND img IN (SELECT vec_id FROM embeddings WHERE label < 3))
    UNION ALL SELECT vec_id, 'low', 0.5, 0.25, false FROM embeddings WHERE label < 3) GROUP BY method""",
    made="SELECT p.img, m.method, l.pr AS gt, p.v > m.t AS pr FROM pix p JOIN lab l USING (img, y, x), (VALUES ('low', -0.02), ('zero', 0.0), ('high', 0.05)) m(method, t)"))
def benchmark_run(spark, d):
    """All samples with all methods, but for what is done; scores of both summed up by method."""
    rows = pix(spark, d).join(lab(spark, d).select("img", "y", "x", F.col("pr").alias("gt")), ["img", "y", "x"]).withColumnRenamed("img", "sample_id")
    samples = table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), "label")
    done = samples.where("label < 3").select("sample_id", F.lit("low").alias("method"), F.lit(0.5).alias("dice"), F.lit(0.25).alias("iou"))  # what an earlier run left
    made = methods.benchmark(samples, rows, {k: F.expr(v) for k, v in METHODS.items()}, done)
    return made.groupBy("method").agg(F.round(F.avg("dice"), 6).alias("dice"), F.round(F.avg("iou"), 6).alias("iou"), F.count("*").alias("n"), F.count_if("fresh").alias("fresh"))


@register("ablation_best", sql("scores", "SELECT category, arg_max(method || '-' || conn, struct_pack(s := s, o := -o)) AS config, round(max(s), 6) AS score, CAST(sum(n) AS BIGINT) AS n FROM (SELECT category, method, conn, o, round(avg(br_mean_strict * f), 9) AS s, count(*) AS n FROM scores, (VALUES ('minsc', 1.0, 1), ('maxsc', 0.96, 2), ('size', 0.9, 3)) v(conn, f, k), (SELECT 0) z, LATERAL (SELECT k * 10 + CAST(method[1] AS INTEGER) AS o) GROUP BY ALL) GROUP BY category"))
def ablation_best(spark, d):
    """Each method with each criterion on every sample, and by category the best of these configurations; of equal ones the first."""
    criteria = F.explode(F.array(*[F.struct(F.lit(c).alias("conn"), F.lit(f).alias("f"), F.lit(k).alias("k")) for k, (c, f) in enumerate((("minsc", 1.0), ("maxsc", 0.96), ("size", 0.9)), 1)]))
    rows = scores(spark, d).withColumn("c", criteria).withColumn("o", F.col("c.k") * 10 + F.substr("method", F.lit(1), F.lit(1)).cast("int"))
    means = rows.groupBy("category", "o", F.concat_ws("-", "method", "c.conn").alias("config")).agg(F.round(F.avg(F.col("br_mean_strict") * F.col("c.f")), 9).alias("s"), F.count("*").alias("n"))
    return means.groupBy("category").agg(F.max_by("config", F.struct("s", -F.col("o"))).alias("config"), F.round(F.max("s"), 6).alias("score"), F.sum("n").alias("n"))


@register("best_scale", sql("pairs counts", "SELECT c.img, coalesce(b.scale, 4) AS scale, round(coalesce(b.s, -1), 6) AS score FROM counts c LEFT JOIN (SELECT img, arg_max(gt, struct_pack(s := s, k := -gt)) AS scale, max(s) AS s FROM (SELECT img, gt, round(n / 16 * (0.35 + 0.65 * iou), 9) AS s FROM pairs WHERE n / 16 >= 0.3) GROUP BY img) b ON b.img = c.img"))
def best_scale(spark, d):
    """The candidate of the best score by solidity and overlap, of equal ones the first; without any the last of all."""
    known = contingency(lab(spark, d))
    candidates = iou_pairs(known).select("img", F.col("gt").alias("scale"), (F.col("n") / 16).alias("solidity"), "iou")
    return choices.best_scale(candidates, counts(known), 4).withColumn("score", F.round("score", 6))


@register("seed_label", sql("lab", "SELECT i.img, s.label FROM (SELECT DISTINCT img FROM lab) i LEFT JOIN (SELECT img, pr AS label FROM (SELECT img, pr, count(*) AS n FROM lab WHERE gt > 0 AND pr > 0 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY img ORDER BY n DESC, pr) = 1) s USING (img)"))
def seed_label(spark, d):
    """The label that covers most of an image's seeds, the smaller id of equal ones; none where no seed lies on a label."""
    return choices.seed_label(lab(spark, d))


@register("model_names", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '2D_versatile_fluo' WHEN s_suppkey % 3 = 1 THEN '2D_versatile_fluo' ELSE '2D_versatile_he' END AS model FROM supplier")
def model_names(spark, d):
    names = F.element_at(F.array(F.lit("dsb2018"), F.lit("ihc_tma"), F.lit("monuseg")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return table(spark, d, "supplier").select("s_suppkey", t.model_of(names).alias("model"))


@register("neutral_fill", sql("pix lab", "SELECT p.img, p.y, p.x, round(CASE WHEN gt = 1 THEN coalesce(b, o, 128) ELSE v END, 6) AS v FROM pix p JOIN lab USING (img, y, x) JOIN (SELECT img, avg(v) FILTER (pr = 0) AS b, avg(v) FILTER (gt <> 1) AS o FROM pix JOIN lab USING (img, y, x) GROUP BY img) f ON f.img = p.img"))
def neutral_fill(spark, d):
    """Pixels that are not to be conquered take the mean of the background."""
    rows = pix(spark, d).join(lab(spark, d), ["img", "y", "x"])
    return p.neutralise(rows, "v", F.col("gt") == 1, F.col("pr") == 0).select("img", "y", "x", F.round("v", 6).alias("v"))


ENDS = "SELECT img, y // 4 AS ty, x // 4 AS tx, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM pix GROUP BY ALL"


@register("normalised_tiles", sql("pix", """SELECT p.img, p.y, p.x, round((any_value(v) - sum(w * lo)) / (sum(w * hi) - sum(w * lo)), 6) AS norm FROM pix p, LATERAL (SELECT (p.y + 0.5) / 4 - 0.5 AS ay, (p.x + 0.5) / 4 - 0.5 AS ax) a, (VALUES (0), (1)) i(dy), (VALUES (0), (1)) j(dx),
    LATERAL (SELECT greatest(0, least(1, floor(ay) + dy)) AS ty, greatest(0, least(1, floor(ax) + dx)) AS tx, abs(1 - dy - (ay - floor(ay))) * abs(1 - dx - (ax - floor(ax))) AS w) t JOIN ends e ON e.img = p.img AND e.ty = t.ty AND e.tx = t.tx GROUP BY p.img, p.y, p.x""", ends=ENDS))  # fmt: skip
def normalised_tiles(spark, d):
    """A percentile stretch whose ends go over from tile to tile."""
    return p.normalise_tiles(pix(spark, d), "v", 4, SIDE, SIDE).select("img", "y", "x", F.round("norm", 6).alias("norm"))


@register("axes_and_channels", sql("pix", "SELECT img, x AS y, y AS x, c, CASE WHEN c = 0 THEN round(v, 6) ELSE 0 END AS v FROM pix, (VALUES (0), (1), (2)) n(c)"))
def axes_and_channels(spark, d):
    """Rows and columns swapped, and one channel made three."""
    rows = p.axes_moved(pix(spark, d).select("img", "y", "x", F.lit(0).alias("c"), F.round("v", 6).alias("v")), ("y", "x"), "y")
    return p.three_channels(rows, F.lit(1)).select("img", "y", "x", "c", "v")


@register("training_crops", sql("grid", "SELECT img, part, y, x, label FROM (SELECT img, 'half' AS part, y, x, label FROM grid WHERE y < 4 UNION ALL SELECT img, 'quarter', y, x, label FROM grid WHERE y < 4 AND x < 4) WHERE label > 0"))
def training_crops(spark, d):
    """The upper half and the upper left quarter of label maps."""
    rows = grid(spark, d).where("y < 4 and label > 0")
    parts = F.explode(F.when(F.col("x") < 4, F.array(F.lit("half"), F.lit("quarter"))).otherwise(F.array(F.lit("half"))))
    return rows.select("img", parts.alias("part"), "y", "x", "label")


@register("seeded_subset", "SELECT p_type, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY md5(p_partkey || '-7'), p_partkey) <= 5")
def seeded_subset(spark, d):
    """A sample of five of each type, drawn by a seeded hash: the same at each run. The limit is what the query is for."""
    rows = table(spark, d, "part").select("p_type", "p_partkey", F.md5(F.concat_ws("-", "p_partkey", F.lit(7))).alias("draw"))
    at = F.row_number().over(Window.partitionBy("p_type").orderBy("draw", "p_partkey"))
    return rows.withColumn("at", at).where("at <= 5").select("p_type", "p_partkey")


@register("footprint", "SELECT p_type AS kind, CAST(sum(p_size * CASE WHEN p_partkey % 4 = 0 THEN 8 WHEN p_partkey % 4 = 1 THEN 4 WHEN p_partkey % 4 = 2 THEN 2 ELSE 1 END) AS BIGINT) AS bytes, count(*) AS n FROM part GROUP BY p_type")
def footprint(spark, d):
    """Bytes by kind: elements times the size of their type, as a model's parameters are summed."""
    size = F.element_at(F.array(F.lit(8), F.lit(4), F.lit(2), F.lit(1)), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").groupBy(F.col("p_type").alias("kind")).agg(F.sum(F.col("p_size") * size).alias("bytes"), F.count("*").alias("n"))


@register("dataset_counts", "SELECT coalesce(source, 'ALL') AS dataset, coalesce(lang, 'ALL') AS split, count(*) AS n, count(DISTINCT doc_id) AS samples FROM documents GROUP BY GROUPING SETS ((source, lang), (source), ())")
def dataset_counts(spark, d):
    """Samples by data set and split, by data set, and in all, by one pass of grouping sets."""
    rows = table(spark, d, "documents").groupingSets([["source", "lang"], ["source"], []], "source", "lang").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("samples"))
    return rows.select(F.coalesce("source", F.lit("ALL")).alias("dataset"), F.coalesce("lang", F.lit("ALL")).alias("split"), "n", "samples")


@register("sample_names", "SELECT o_orderkey, format('fold{:d}_{:05d}', o_orderkey % 3 + 1, o_orderkey) AS sample_id FROM orders")
def sample_names(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.format_string("fold%d_%05d", F.col("o_orderkey") % 3 + 1, F.col("o_orderkey")).alias("sample_id"))


@register("instance_numbers", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY 'm' || o_orderkey || '.png') AS INTEGER) AS instance FROM orders")
def instance_numbers(spark, d):
    """Instance files of each case numbered in the order of their names."""
    name = F.concat(F.lit("m"), F.col("o_orderkey"), F.lit(".png"))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(name)).alias("instance"))


@register("overlay_index", sql("grid", "SELECT img, count(DISTINCT label) FILTER (label > 0) AS instances, CAST(max(x) + 1 AS INTEGER) AS width, CAST(max(y) + 1 AS INTEGER) AS height, 'overlays/' || img || '.png' AS path FROM grid GROUP BY img"))
def overlay_index(spark, d):
    """An index of overlays: instances and size of each image, and where its overlay lies."""
    rows = grid(spark, d).groupBy("img").agg(F.count_distinct(F.when(F.col("label") > 0, F.col("label"))).alias("instances"), (F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height"))
    return rows.withColumn("path", F.concat(F.lit("overlays/"), F.col("img"), F.lit(".png")))


@register("segmentation_records", sql("grid", "SELECT img, 8 AS height, 8 AS width, count(DISTINCT label) FILTER (label > 0) AS n_labels, md5(string_agg(CAST(label AS VARCHAR), ',' ORDER BY y, x)) AS masks_md5 FROM grid GROUP BY img"))
def segmentation_records(spark, d):
    """One nested record per image: size, labels in reading order and traced outlines; the labels as their digest."""
    rows = grid(spark, d)
    made = tables.records(rows, tables.traced(rows))
    return made.select("img", "height", "width", "n_labels", F.md5(F.array_join(F.col("masks").cast("array<string>"), ",")).alias("masks_md5"))
