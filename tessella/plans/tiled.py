"""Queries on packed tiles, polygons by scan lines and faces of volumes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import percell, sampling, scan, tiles, volumes
from tessella.operators.labels import global_ids
from tessella.operators.percentiles import percentiles
from tessella.plans.fixtures import LARGE, SIDE, lab, mosaic, on_mosaic, pix, sql, table
from tessella.plans.registry import register
from tessella.sources.tables import polygons

TILE = 64
#: The neighbours of a pixel of a mosaic by windows; none beyond its edge.
AROUND = "SELECT img, y, x, gt, lag(gt) OVER r AS w, lead(gt) OVER r AS e, lag(gt) OVER c AS n, lead(gt) OVER c AS s FROM whole WINDOW r AS (PARTITION BY img, y ORDER BY x), c AS (PARTITION BY img, x ORDER BY y)"


#: The last mosaic may end early: its tiles that hold a pixel are there, and 0 where a pixel has no row.
WHOLE = "SELECT i.img, CAST(a.y AS INTEGER) AS y, CAST(b.x AS INTEGER) AS x, coalesce(l.gt, 0) AS gt FROM (SELECT DISTINCT img FROM lab) i CROSS JOIN range(160) a(y) CROSS JOIN range(160) b(x) LEFT JOIN lab l ON l.img = i.img AND l.y = a.y AND l.x = b.x"
THERE = "SELECT DISTINCT img, y // 64 AS ty, x // 64 AS tx FROM lab"


def on_tiles(body: str) -> str:
    return on_mosaic(sql("lab", f"SELECT q.* FROM ({body}) q JOIN there t ON t.img = q.img AND t.ty = q.y // 64 AND t.tx = q.x // 64", whole=WHOLE, there=THERE, around=AROUND))


def large(spark, d) -> DataFrame:
    """The true labels of all mosaics as tiles."""
    return tiles.of_pixels(mosaic(spark, d), "gt", LARGE, LARGE, TILE)


@register("tiled_erosion", on_tiles("SELECT img, y, x, CAST(gt AS BIGINT) AS label FROM around WHERE gt > 0 AND w = gt AND e = gt AND n = gt AND s = gt"))
def tiled_erosion(spark, d):
    """Inner pixels of labels of mosaics, on tiles that exchange strips of a pixel."""
    return tiles.pixels(tiles.inner(large(spark, d)), "label", "long").where("label > 0")


@register("tiled_borders", on_tiles("SELECT img, y, x FROM around WHERE coalesce(w <> gt, false) OR coalesce(e <> gt, false) OR coalesce(n <> gt, false) OR coalesce(s <> gt, false)"))
def tiled_borders(spark, d):
    """Pixels of mosaics next to one of another label."""
    return tiles.pixels(tiles.bordered(large(spark, d)), "m", "long").where("m > 0").select("img", "y", "x")


@register("tiled_pooling", on_tiles("SELECT img, y, x, CAST(max(m) OVER (PARTITION BY img, x ORDER BY y RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS BIGINT) AS v FROM (SELECT img, y, x, max(gt) OVER (PARTITION BY img, y ORDER BY x RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM whole)"))
def tiled_pooling(spark, d):
    """The largest label of the square around each pixel."""
    return tiles.pixels(tiles.pooled(large(spark, d), 3), "v", "long")


@register("tiled_means", on_tiles("SELECT img, y, x, round(sum(m) OVER q / sum(n) OVER q, 6) AS v FROM (SELECT img, y, x, sum(gt) OVER r AS m, count(*) OVER r AS n FROM whole WINDOW r AS (PARTITION BY img, y ORDER BY x RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)) WINDOW q AS (PARTITION BY img, x ORDER BY y RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)"))
def tiled_means(spark, d):
    """The mean label of the square around each pixel, of what lies in the mosaic."""
    return tiles.pixels(tiles.smoothed(large(spark, d), 2), "v").withColumn("v", F.round("v", 6))


@register("tiled_gradient", on_tiles("""SELECT img, y, x, round(sqrt(gx * gx + gy * gy), 6) AS v FROM (SELECT img, y, x, coalesce(lead(dx) OVER c, lag(dx) OVER c) + 2 * dx + coalesce(lag(dx) OVER c, lead(dx) OVER c) AS gx, coalesce(lead(sx) OVER c, lag(sx) OVER c) - coalesce(lag(sx) OVER c, lead(sx) OVER c) AS gy
    FROM (SELECT img, y, x, coalesce(lead(gt) OVER r, lag(gt) OVER r) - coalesce(lag(gt) OVER r, lead(gt) OVER r) AS dx, coalesce(lead(gt) OVER r, lag(gt) OVER r) + 2 * gt + coalesce(lag(gt) OVER r, lead(gt) OVER r) AS sx FROM whole WINDOW r AS (PARTITION BY img, y ORDER BY x)) WINDOW c AS (PARTITION BY img, x ORDER BY y))"""))  # fmt: skip
def tiled_gradient(spark, d):
    """The length of the gradient of the labels as values, mirrored at the edge."""
    return tiles.pixels(tiles.gradient(large(spark, d)), "v").withColumn("v", F.round("v", 6))


#: Two polygons of eight points for each embedding, around the middle of a field of 16 by 16, as numbers of thousandths.
POINTS = "SELECT vec_id AS img, p + 1 AS polygon, k + 1 AS vertex, floor((7.5 + 3 * CAST(embedding[16 * p + 2 * k + 1] AS DOUBLE)) * 1000) / 1000 AS x, floor((7.5 + 3 * CAST(embedding[16 * p + 2 * k + 2] AS DOUBLE)) * 1000) / 1000 AS y FROM embeddings, range(2) a(p), range(8) b(k)"
#: The parity of edges that cross a row right of a centre, for every centre.
INSIDE = "SELECT e.img, e.polygon, CAST(py AS INTEGER) AS y, CAST(px AS INTEGER) AS x FROM edges e, range(16) a(py), range(16) b(px) WHERE (ya > py) <> (yb > py) AND px < (xb - xa) * (py - ya) / (yb - ya) + xa GROUP BY ALL HAVING count(*) % 2 = 1"
EDGES = "SELECT a.img, a.polygon, a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb FROM points a JOIN points b ON b.img = a.img AND b.polygon = a.polygon AND b.vertex = a.vertex % 8 + 1"


def outlined(spark, d) -> DataFrame:
    """The polygons as annotations in XML, read as points again."""
    number = lambda k: F.format_string("%.3f", F.floor((7.5 + 3 * F.get("embedding", k).cast("double")) * 1000) / 1000)
    vertex = lambda p, k: F.concat(F.lit('<Vertex X="'), number(16 * p + 2 * k), F.lit('" Y="'), number(16 * p + 2 * k + 1), F.lit('"/>'))
    region = lambda p: F.concat(F.lit("<Region><Vertices>"), *[vertex(p, k) for k in range(8)], F.lit("</Vertices></Region>"))
    notes = table(spark, d, "embeddings").select(F.col("vec_id").alias("img"), F.concat(F.lit("<Annotation>"), region(0), region(1), F.lit("</Annotation>")).alias("xml"))
    return polygons(notes).withColumnRenamed("region", "polygon")


@register("polygons_first", sql("", "SELECT img, y, x, CAST(min(polygon) AS INTEGER) AS label FROM inside GROUP BY img, y, x", points=POINTS, edges=EDGES, inside=INSIDE))
def polygons_first(spark, d):
    """Labels of the pixels in annotated polygons; the first polygon wins."""
    return scan.rasterised(outlined(spark, d), 16, 16)


@register("polygons_last", sql("", "SELECT img, y, x, CAST(max(polygon) AS INTEGER) AS label FROM inside GROUP BY img, y, x", points=POINTS, edges=EDGES, inside=INSIDE))
def polygons_last(spark, d):
    """Labels of the pixels in annotated polygons; the last polygon wins."""
    return scan.rasterised(outlined(spark, d), 16, 16, last=True)


VOXELS = "SELECT img // 8 AS vol, CAST(img % 8 AS INTEGER) AS z, y, x, CASE WHEN v > -1.2 THEN ((((img // 8) * 2 + img % 8 // 4) * 2 + y // 4) * 2 + x // 4) * 4294967296 + 1 ELSE 0 END AS id FROM pix"


def faces_sql(shrink: bool) -> dict[str, str]:
    """Views of the faces along each axis, of what is left of them when they are shrunk, and of the pairs that touch."""
    parts, views = [], {"voxels": VOXELS}
    for axis, u, v in (("z", "y", "x"), ("y", "z", "x"), ("x", "z", "y")):
        views[f"face_{axis}"] = f"SELECT *, {u} // 4 AS bu, {v} // 4 AS bv FROM voxels WHERE {axis} % 4 IN (0, 3)"
        ends = f"WINDOW a AS (PARTITION BY vol, {axis}, bu, bv, {v} ORDER BY {u}), b AS (PARTITION BY vol, {axis}, bu, bv, {u} ORDER BY {v})"
        near = lambda c, w: f"coalesce(lag({c}) OVER {w}, {c}), coalesce(lead({c}) OVER {w}, {c})"
        level = lambda c, w: f"coalesce(lag({c}) OVER {w}, {c}) = coalesce(lead({c}) OVER {w}, {c})"
        views[f"flat_{axis}"] = f"SELECT *, CASE WHEN {level('id', 'a')} AND {level('id', 'b')} THEN id ELSE 0 END AS f FROM face_{axis} {ends}"
        views[f"kept_{axis}"] = f"SELECT vol, z, y, x, f AS id FROM (SELECT *, least(f, {near('f', 'a')}, {near('f', 'b')}) AS rim FROM flat_{axis} {ends}) WHERE rim > 0" if shrink else f"SELECT vol, z, y, x, id FROM face_{axis} WHERE id > 0"
        parts.append(f"SELECT a.vol, a.id AS a, b.id AS b FROM kept_{axis} a JOIN kept_{axis} b ON b.vol = a.vol AND b.{u} = a.{u} AND b.{v} = a.{v} AND b.{axis} = a.{axis} + 1 AND a.{axis} % 4 = 3")
    return views | {"pairs_": " UNION ".join(parts)}


def voxels(spark, d) -> DataFrame:
    """Eight images in turn as a volume; what is foreground has the id of its block of four voxels a side."""
    rows = pix(spark, d).select(F.floor(F.col("img") / 8).alias("vol"), (F.col("img") % 8).cast("int").alias("z"), "y", "x", (F.col("v") > -1.2).cast("int").alias("label"))
    return rows.select("vol", "z", "y", "x", global_ids(volumes.block_number(4, SIDE // 4, SIDE // 4, 2), F.col("label")).alias("id"))


@register("volume_faces", sql("pix", "SELECT DISTINCT vol, a, b FROM pairs_", **faces_sql(True)))
def volume_faces(spark, d):
    """Labels of blocks of volumes that touch across faces, shrunk within them."""
    return volumes.block_faces(voxels(spark, d), 4)


@register("volume_faces_whole", sql("pix", "SELECT DISTINCT vol, a, b FROM pairs_", **faces_sql(False)))
def volume_faces_whole(spark, d):
    """Labels of blocks of volumes that touch across faces."""
    return volumes.block_faces(voxels(spark, d), 4, shrink=False)


@register("line_percentiles", "SELECT l_returnflag AS img, round(unnest(quantile_cont(CAST(l_extendedprice AS DOUBLE), [0.01, 0.5, 0.99])), 6) AS p, unnest([0, 1, 2]) AS n FROM lineitem GROUP BY l_returnflag")
def line_percentiles(spark, d):
    """Percentiles of groups that are too large to be sorted whole: histograms, refined where the ranks lie."""
    found = percentiles(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "img"), "l_extendedprice", (0.01, 0.5, 0.99))
    return found.select("img", F.posexplode("p").alias("n", "p")).withColumn("p", F.round("p", 6))


UNIFORM = "((CAST('0x' || substr(md5({}), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"


@register("weighted_epochs", f"""SELECT epoch, CAST(row_number() OVER (PARTITION BY epoch ORDER BY t, o_orderkey) AS INTEGER) AS place, o_orderkey FROM (SELECT CAST(epoch AS INTEGER) AS epoch, o_orderkey, -ln({UNIFORM.format("'7:' || epoch || ':' || o_orderkey")}) / CAST(o_totalprice AS DOUBLE) AS t FROM orders, range(3) e(epoch)) QUALIFY place <= 100""")
def weighted_epochs(spark, d):
    """A hundred different orders for each of three epochs, drawn by price."""
    return sampling.drawn(table(spark, d, "orders"), "o_orderkey", "o_totalprice", 3, 100, seed=7)


@register("weighted_draws", f"""WITH line AS (SELECT o_orderkey, CAST(sum(w) OVER (ORDER BY o_orderkey) AS BIGINT) AS hi, w FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS w FROM orders)),
draws AS (SELECT CAST(epoch AS INTEGER) AS epoch, draw, CAST(floor({UNIFORM.format("'7:' || epoch || ':' || draw")} * (SELECT max(hi) FROM line)::DOUBLE) AS BIGINT) AS place FROM range(2) e(epoch), range(500) n(draw))
SELECT epoch, draw, o_orderkey FROM draws d ASOF JOIN line l ON d.place >= l.hi - l.w""")
def weighted_draws(spark, d):
    """Five hundred draws for each of two epochs with replacement, by price in whole units."""
    rows = table(spark, d, "orders").withColumn("w", F.floor("o_totalprice"))
    return sampling.drawn_again(rows, "o_orderkey", "w", 2, 500, seed=7)


def bright(values: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """What is above a half in the cell; an error where nothing is."""
    out = mask & (values > 0.5)
    if not out.any():
        raise ValueError("nothing bright")
    return out


def cells(spark, d) -> DataFrame:
    """The true labels of all images, run cell by cell."""
    rows = lab(spark, d).select("img", F.struct("y", "x", "gt").alias("p")).groupBy("img").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["gt"].cast("long")).alias("labels"))  # an image of 64 pixels
    values = table(spark, d, "embeddings").select(F.col("vec_id").alias("img"), F.col("embedding").cast("array<double>").alias("values"))
    images = values.join(rows, "img").withColumns({"height": F.lit(SIDE), "width": F.lit(SIDE)})
    return percell.run(percell.crops(images, 1), bright, least=4, erosion=1, check=lambda result, mask: 3 * result.sum() >= mask.sum())


CELLS = {
    "each": "SELECT l.img, l.y, l.x, l.gt AS label, v FROM lab l JOIN pix p ON p.img = l.img AND p.y = l.y AND p.x = l.x WHERE l.gt > 0",
    "inner_": "SELECT a.img, a.y, a.x, a.label FROM each a JOIN each b ON b.img = a.img AND b.label = a.label AND abs(b.y - a.y) + abs(b.x - a.x) = 1 GROUP BY ALL HAVING count(*) = 4",
    "sums": "SELECT e.img, e.label, count(*) AS area, count(i.y) AS seeds, count(*) FILTER (v > 0.5) AS bright FROM each e LEFT JOIN inner_ i ON i.img = e.img AND i.y = e.y AND i.x = e.x GROUP BY e.img, e.label",
    "states": "SELECT *, CASE WHEN area < 4 THEN 'small' WHEN seeds = 0 THEN 'unseeded' WHEN bright = 0 THEN 'failed' WHEN 3 * bright < area THEN 'ragged' ELSE 'placed' END AS status FROM sums",
}


@register("percell_status", sql("lab", "SELECT status, count(*) AS n FROM states GROUP BY status", **CELLS))
def percell_status(spark, d):
    """How many cells came to each end."""
    return cells(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@register("percell_labels", sql("lab", "SELECT e.img, e.y, e.x, CAST(e.label AS BIGINT) AS label FROM each e JOIN states s ON s.img = e.img AND s.label = e.label WHERE status <> 'placed' OR v > 0.5", **CELLS))
def percell_labels(spark, d):
    """The label map that the cells make together."""
    return percell.merged(cells(spark, d))
