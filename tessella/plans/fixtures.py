"""Views over the test tables that stand for label maps and scores, in Spark and as SQL with the same rows.

Every embedding has 64 elements and is read as an image of 8 by 8 pixels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, pos, y, x, v)"""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img"), F.posexplode("embedding").alias("pos", "v"))
    return rows.select("img", "pos", F.floor(F.col("pos") / SIDE).cast("int").alias("y"), (F.col("pos") % SIDE).alias("x"), F.col("v").cast("double").alias("v"))


def lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, y, x, gt, pr): quadrant numbers where the value, or that of the pixel to the left, is positive; no shuffle."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img"), "embedding", F.posexplode("embedding").alias("pos", "v"))
    y, x = F.floor(F.col("pos") / SIDE).cast("int"), F.col("pos") % SIDE
    quadrant = 1 + F.floor(y / 4).cast("int") * 2 + F.floor(x / 4).cast("int")
    left = F.when(x > 0, F.get("embedding", F.col("pos") - 1)).otherwise(F.lit(0.0))
    return rows.select("img", y.alias("y"), x.alias("x"), F.when(F.col("v") > 0, quadrant).otherwise(0).alias("gt"), F.when(left > 0, quadrant).otherwise(0).alias("pr"))


#: Tiles in a row of a mosaic, and its side.
TILES = 20
LARGE = TILES * SIDE


def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, y, x, gt, pr): 400 images of ``lab`` as one of 160 by 160 pixels, with up to 1,600 labels; no shuffle."""
    at = F.col("img") % (TILES * TILES)
    place = lambda c, k: (k.cast("int") * SIDE + F.col(c)).cast("int").alias(c)
    named = lambda c: F.when(F.col(c) > 0, at.cast("int") * 4 + F.col(c)).otherwise(0).alias(c)
    return lab(spark, sf_dir).select(F.floor(F.col("img") / (TILES * TILES)).alias("img"), place("y", F.floor(at / TILES)), place("x", at % TILES), named("gt"), named("pr"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, y, x, label): labels 1 to 9 in a raster of three pixels; only label 5 is off the edge."""
    cell = 1 + F.floor(F.col("y") / 3).cast("int") * 3 + F.floor(F.col("x") / 3).cast("int")
    return pix(spark, sf_dir).select("img", "y", "x", F.when(F.col("v") > 0, cell).otherwise(0).alias("label"))


def lab_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, gt, pr) without places, for metrics that need only the contingency."""
    return table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("img"), (F.col("l_suppkey") % 11).cast("int").alias("gt"), (F.col("l_partkey") % 13).cast("int").alias("pr"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, category, sample_id, method, br_mean_strict, fb_mean_strict, f_area_mean_strict, pixel_dice, n)"""
    line, orders, customer, nation, region = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    place = customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    rows = line.join(orders, line.l_orderkey == orders.o_orderkey).join(place, orders.o_custkey == place.c_custkey)
    return rows.groupBy(F.col("c_mktsegment").alias("dataset"), F.col("r_name").alias("category"), F.col("n_name").alias("sample_id"), F.col("o_orderpriority").alias("method")).agg(
        F.round(F.avg("l_quantity") / 50, 9).alias("br_mean_strict"),
        F.round(F.avg(1 - 10 * F.col("l_discount")), 9).alias("fb_mean_strict"),
        F.round(F.avg(1 - 10 * F.col("l_tax")), 9).alias("f_area_mean_strict"),
        F.round(F.avg("l_extendedprice") / F.max("l_extendedprice"), 9).alias("pixel_dice"),
        F.count("*").alias("n"),
    )


SQL = {
    "pix": "SELECT vec_id AS img, CAST(p - 1 AS INTEGER) AS pos, CAST((p - 1) // 8 AS INTEGER) AS y, CAST((p - 1) % 8 AS INTEGER) AS x, CAST(embedding[p] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(p)",
    "lab": "SELECT img, y, x, CASE WHEN v > 0 THEN 1 + (y // 4) * 2 + x // 4 ELSE 0 END AS gt, CASE WHEN lag(v, 1, 0.0) OVER (PARTITION BY img, y ORDER BY x) > 0 THEN 1 + (y // 4) * 2 + x // 4 ELSE 0 END AS pr FROM pix",
    "mosaic": "SELECT img // 400 AS img, CAST(img % 400 // 20 * 8 + y AS INTEGER) AS y, CAST(img % 20 * 8 + x AS INTEGER) AS x, CAST(CASE WHEN gt > 0 THEN img % 400 * 4 + gt ELSE 0 END AS INTEGER) AS gt, CAST(CASE WHEN pr > 0 THEN img % 400 * 4 + pr ELSE 0 END AS INTEGER) AS pr FROM lab",
    "grid": "SELECT img, y, x, CASE WHEN v > 0 THEN 1 + (y // 3) * 3 + x // 3 ELSE 0 END AS label FROM pix",
    "lab_big": "SELECT l_returnflag || l_linestatus AS img, CAST(l_suppkey % 11 AS INTEGER) AS gt, CAST(l_partkey % 13 AS INTEGER) AS pr FROM lineitem",
    "scores": """SELECT c_mktsegment AS dataset, r_name AS category, n_name AS sample_id, o_orderpriority AS method, round(avg(l_quantity) / 50, 9) AS br_mean_strict,
        round(avg(1 - 10 * l_discount), 9) AS fb_mean_strict, round(avg(1 - 10 * l_tax), 9) AS f_area_mean_strict, round(avg(l_extendedprice) / max(l_extendedprice), 9) AS pixel_dice, count(*) AS n
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
    "cont": "SELECT img, gt, pr, count(*) AS n FROM lab GROUP BY ALL",
    "area": "SELECT *, sum(n) OVER (PARTITION BY img, gt) AS ga, sum(n) OVER (PARTITION BY img, pr) AS pa FROM cont",
    "pairs": "SELECT *, n / (ga + pa - n) AS iou FROM area WHERE gt > 0 AND pr > 0",
    "counts": "SELECT img, count(DISTINCT CASE WHEN gt > 0 THEN gt END) AS n_gt, count(DISTINCT CASE WHEN pr > 0 THEN pr END) AS n_pr FROM cont GROUP BY img",
    "steps": "SELECT unnest([0.5::DOUBLE, 0.55::DOUBLE, 0.6000000000000001::DOUBLE, 0.6500000000000001::DOUBLE, 0.7000000000000002::DOUBLE, 0.7500000000000002::DOUBLE, 0.8000000000000003::DOUBLE, 0.8500000000000003::DOUBLE, 0.9000000000000004::DOUBLE, 0.9500000000000004::DOUBLE]) AS t",
    "hits": "SELECT img, t, count(*) AS tp FROM (SELECT img, t, gt, pr, iou FROM pairs, ts WHERE iou >= t QUALIFY row_number() OVER (PARTITION BY img, t, gt ORDER BY iou DESC, pr) = 1) GROUP BY img, t",
    "det": "SELECT c.img, ts.t, n_gt, n_pr, coalesce(tp, 0) AS tp FROM counts c CROSS JOIN ts LEFT JOIN hits h ON h.img = c.img AND h.t = ts.t",
    "best": "SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY img, gt ORDER BY iou DESC, pr) = 1",
}
#: What each view is made from.
NEEDS = {"lab": ["pix"], "mosaic": ["lab"], "grid": ["pix"], "cont": ["lab"], "area": ["cont"], "pairs": ["area"], "counts": ["cont"], "hits": ["pairs"], "det": ["counts", "hits"], "best": ["pairs"]}


def sql(views: str, body: str, recursive: bool = False, **more: str) -> str:
    """A query over views, each defined once and before its use; ``more`` adds views of the query's own."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    first = [n for n in ("ts",) if n in more]
    for name in views.split():
        add(name)
    parts = [f"{n} AS ({more[n]})" for n in first] + [f"{n} AS ({SQL[n]})" for n in order] + [f"{n} AS ({q})" for n, q in more.items() if n not in first]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + body


def on_mosaic(text: str) -> str:
    """SQL over the view ``lab`` as SQL over the mosaic in its place."""
    return text.replace(f"lab AS ({SQL['lab']})", f"plain AS ({SQL['lab']}),\nlab AS ({SQL['mosaic'].replace('FROM lab', 'FROM plain')})")
