"""Volumes as voxel rows: labels carried from plane to plane, and joined across the faces of blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.labels import settle


def stitched(rows: DataFrame, label: str, threshold: float = 0.25, vol: str = "vol", rounds: int = 64) -> DataFrame:
    """rows (vol, z, y, x, label) with the label that is carried through the planes of each volume.

    A label goes on as the one of the plane before with which it has the largest IoU, if that is at least the threshold
    and no other label of its plane has a larger one with it; of equal ones, as the smallest. All else is new: numbers go
    on from the largest of the first plane, by plane and then by label. Planes that are missing break the chain.

    Neighbouring planes meet in one equi-join of pixels; what follows works on a row for each label of each plane, and
    chains are resolved by pointer jumping, so rounds grow with the logarithm of their length.
    """
    at = rows.where(F.col(label) > 0)
    sizes = settle(at.groupBy(vol, "z", label).agg(F.count("*").alias("n")))
    before = at.select(vol, (F.col("z") + 1).alias("z"), "y", "x", F.col(label).alias("was"))
    both = at.select(vol, "z", "y", "x", label).join(before, [vol, "z", "y", "x"]).groupBy(vol, "z", label, "was").agg(F.count("*").alias("shared"))
    earlier = sizes.select(vol, (F.col("z") + 1).alias("z"), F.col(label).alias("was"), F.col("n").alias("m"))
    iou = both.join(sizes, [vol, "z", label]).join(earlier, [vol, "z", "was"]).withColumn("iou", F.col("shared") / (F.col("n") + F.col("m") - F.col("shared")))
    best = iou.where(F.col("iou") >= threshold).withColumn("most", F.max("iou").over(Window.partitionBy(vol, "z", "was"))).where("iou = most")
    parent = best.groupBy(vol, "z", label).agg(F.min_by("was", F.struct(-F.col("iou"), "was")).alias("was"))
    # each label points to the one before it, chains to their first one
    node = F.struct("z", F.col(label).alias("label"))
    links = sizes.select(vol, "z", label).join(parent, [vol, "z", label], "left")
    links = settle(links.select(vol, node.alias("node"), F.when(F.col("was").isNull(), node).otherwise(F.struct((F.col("z") - 1).alias("z"), F.col("was").alias("label"))).alias("root")))
    for _ in range(rounds):
        further = links.select(vol, F.col("node").alias("root"), F.col("root").alias("next"))
        step = settle(links.join(further, [vol, "root"]).select(vol, "node", "next", (F.col("next") != F.col("root")).alias("moved")))
        links = step.select(vol, "node", F.col("next").alias("root"))
        if step.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"chains did not settle in {rounds} rounds")
    # the new labels of a plane count on from all planes before: sums over planes, places within a plane
    begun = links.where("node = root").select(vol, F.col("node.z").alias("z"), F.col("node.label").alias("label"))
    start = rows.groupBy(vol).agg(F.min("z").alias("z0"))
    begun = begun.join(start, vol)
    top = begun.where("z = z0").groupBy(vol).agg(F.max("label").alias("top"))
    counts = begun.where("z > z0").groupBy(vol, "z").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.coalesce(F.sum("n").over(Window.partitionBy(vol).orderBy("z").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")  # a row for each plane
    later = begun.where("z > z0").join(upto, [vol, "z"]).join(top, vol, "left")
    place = F.row_number().over(Window.partitionBy(vol, "z").orderBy("label"))
    named = begun.where("z = z0").select(vol, "z", "label", F.col("label").cast("long").alias("new")).unionByName(later.select(vol, "z", "label", (F.coalesce("top", F.lit(0)) + F.col("upto") + place).cast("long").alias("new")))
    ids = links.join(named.select(vol, F.struct("z", "label").alias("root"), "new"), [vol, "root"]).select(vol, F.col("node.z").alias("z"), F.col("node.label").alias(label), "new")
    return rows.join(ids, [vol, "z", label], "left").select(*[c for c in rows.columns if c != label], F.coalesce("new", F.lit(0).cast("long")).alias(label))


def block_faces(rows: DataFrame, size: int, vol: str = "vol", shrink: bool = True) -> DataFrame:
    """Different pairs (vol, a, b) of ids of voxels (vol, z, y, x, id) that touch across a face of blocks of ``size``.

    With ``shrink``, labels are shrunk within their face first, in both of its directions: a voxel counts where the ids
    have no slope along either, and all four neighbours in the face are such voxels or its rim. Only the voxels of faces
    are shuffled; a task holds a line of a face.
    """
    axes, found = ("z", "y", "x"), []
    for axis in axes:
        u, v = (a for a in axes if a != axis)
        place = F.pmod(F.col(axis), F.lit(size))
        face = rows.where((place == size - 1) | (place == 0))
        if shrink:
            face = face.withColumns({"_bu": F.floor(F.col(u) / size), "_bv": F.floor(F.col(v) / size)})
            lines = [Window.partitionBy(vol, axis, "_bu", "_bv", other).orderBy(along) for along, other in ((u, v), (v, u))]
            near = lambda c, k, w: F.coalesce(F.lead(c, k).over(w), F.col(c))
            level = [near("id", 1, w) == near("id", -1, w) for w in lines]
            flat = face.withColumn("_l0", level[0]).withColumn("_l1", level[1]).withColumn("_flat", F.when(F.col("_l0") & F.col("_l1"), F.col("id")).otherwise(0))
            for n, w in enumerate(lines):
                flat = flat.withColumn(f"_n{n}", (near("_flat", 1, w) != 0) & (near("_flat", -1, w) != 0))
            face = flat.where("_n0 and _n1").drop("id").withColumnRenamed("_flat", "id")
        face = face.where("id > 0").select(vol, *axes, "id")
        first = face.where(F.pmod(F.col(axis), F.lit(size)) == size - 1).select(vol, (F.col(axis) + 1).alias(axis), u, v, F.col("id").alias("a"))
        found.append(first.join(face.select(vol, *axes, F.col("id").alias("b")), [vol, *axes]).select(vol, "a", "b").distinct())
    return found[0].unionByName(found[1]).unionByName(found[2]).distinct()


def block_number(size: int, down: int, across: int, deep: int, vol: str = "vol") -> F.Column:
    """The number of the block of a voxel, over volumes of at most so many blocks in each direction."""
    b = {a: F.floor(F.col(a) / size).cast("long") for a in ("z", "y", "x")}
    return ((F.col(vol).cast("long") * deep + b["z"]) * down + b["y"]) * across + b["x"]


def joined(voxels: DataFrame, size: int, keys: Sequence[str] = ("vol",), shrink: bool = True) -> DataFrame:
    """voxels (vol, z, y, x, id) with ids joined across faces, each to the smallest of those it is linked with."""
    from tessella.operators.labels import components

    edges = settle(block_faces(voxels, size, keys[0], shrink).select("a", "b"))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    roots = components(edges, nodes).where("node <> root")
    return voxels.join(roots, voxels["id"] == roots["node"], "left").select(*keys, "z", "y", "x", F.coalesce("root", "id").alias("id"))
