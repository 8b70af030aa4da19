"""Label-map algebra. A label map is rows (img, y, x, label), label 0 is background; a pair of maps has gt and pr.

Group keys are passed as ``img`` columns, so the same operators work per image, per block or per volume slice.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.durable import checkpoint
from tessella.operators.kernels import _roots


def contingency(pair: DataFrame, img: Sequence[str] = ("img",)) -> DataFrame:
    """Pixels by (img, gt, pr), background included: the shared input of all overlap metrics, partly summed before the shuffle."""
    return pair.groupBy(*img, "gt", "pr").agg(F.count("*").alias("n"))


def pair_maps(gt: DataFrame, pr: DataFrame, img: Sequence[str] = ("img",), label: str = "label") -> DataFrame:
    """(img, y, x, gt, pr) of two maps of the same images; a pixel that only one has, as where shapes differ, is an error."""
    both = gt.select(*img, "y", "x", F.col(label).alias("gt")).join(pr.select(*img, "y", "x", F.col(label).alias("pr")), [*img, "y", "x"], "full")
    same = F.col("gt").isNotNull() & F.col("pr").isNotNull()
    failed = F.raise_error(F.concat(F.lit("the maps differ in shape: "), F.concat_ws(", ", *[F.col(c).cast("string") for c in img]))).cast("int")
    return both.withColumn("gt", F.when(same, F.col("gt")).otherwise(failed))


def settle(df: DataFrame) -> DataFrame:
    """df computed once, in the shared folder: for a contingency that several branches of a plan read, as it is far smaller
    than the pixels it comes from."""
    return checkpoint(df)


def with_areas(table: DataFrame, img: Sequence[str] = ("img",)) -> DataFrame:
    """The contingency with areas ga and pa of both labels, summed from its own few rows rather than from pixels."""
    return table.withColumns({"ga": F.sum("n").over(Window.partitionBy(*img, "gt")), "pa": F.sum("n").over(Window.partitionBy(*img, "pr"))})


def iou_pairs(table: DataFrame, img: Sequence[str] = ("img",), background: bool = False) -> DataFrame:
    """Intersection over union of every overlapping pair; pairs without overlap are absent and count as 0."""
    pairs = with_areas(table, img)
    if not background:
        pairs = pairs.where("gt > 0 and pr > 0")
    return pairs.withColumn("iou", F.col("n") / (F.col("ga") + F.col("pa") - F.col("n")))


def best_match(pairs: DataFrame, areas: DataFrame, img: Sequence[str] = ("img",)) -> DataFrame:
    """Every ground-truth label with its prediction of the largest IoU, the smaller id of equal ones; 0 without overlap."""
    best = pairs.groupBy(*img, "gt").agg(F.max_by(F.struct("pr", "n", "pa", "iou"), F.struct("iou", -F.col("pr"))).alias("b"))
    joined = areas.where("gt > 0").join(best, [*img, "gt"], "left")
    zero = F.lit(0)
    return joined.select(*img, "gt", "ga", F.coalesce("b.pr", zero).alias("pr"), F.coalesce("b.iou", F.lit(0.0)).alias("iou"), F.coalesce(2 * F.col("b.n") / (F.col("ga") + F.col("b.pa")), F.lit(0.0)).alias("dice"))


def largest_overlap(table: DataFrame, img: Sequence[str] = ("img",)) -> DataFrame:
    """The prediction that covers most of each ground-truth label, the smaller id of equal ones."""
    return table.where("gt > 0 and pr > 0").groupBy(*img, "gt").agg(F.max_by("pr", F.struct("n", -F.col("pr"))).alias("pr"))


def shapes(labels: DataFrame, label: str, img: Sequence[str] = ("img",)) -> DataFrame:
    """Area, half-open box and centroid of each label."""
    return labels.where(F.col(label) > 0).groupBy(*img, label).agg(
        F.count("*").alias("area"), F.min("y").alias("r0"), (F.max("y") + 1).alias("r1"), F.min("x").alias("c0"), (F.max("x") + 1).alias("c1"), F.avg("y").alias("cy"), F.avg("x").alias("cx")
    )


def crop(box: dict[str, str], margin: int, height: int, width: int) -> dict[str, Column]:
    """A half-open box widened by a margin and clipped to the image; box maps r0, r1, c0, c1 to columns."""
    return {
        "r0": F.greatest(F.lit(0), F.col(box["r0"]) - margin),
        "r1": F.least(F.lit(height), F.col(box["r1"]) + margin),
        "c0": F.greatest(F.lit(0), F.col(box["c0"]) - margin),
        "c1": F.least(F.lit(width), F.col(box["c1"]) + margin),
    }


def relabel(labels: DataFrame, label: str, out: str = "new", img: Sequence[str] = ("img",)) -> DataFrame:
    """Labels 1 to N by ascending id, background 0; ranks are taken over the distinct labels, then joined back."""
    names = labels.where(F.col(label) > 0).select(*img, label).distinct()
    ranked = names.withColumn(out, F.row_number().over(Window.partitionBy(*img).orderBy(label)))
    return labels.join(ranked, [*img, label], "left").withColumn(out, F.coalesce(out, F.lit(0)))


def drop_small(labels: DataFrame, label: str, least: int, img: Sequence[str] = ("img",)) -> DataFrame:
    """The map without labels of fewer than ``least`` pixels, which become background."""
    small = labels.where(F.col(label) > 0).groupBy(*img, label).count().where(F.col("count") < least).select(*img, label, F.lit(True).alias("small"))
    return labels.join(small, [*img, label], "left").withColumn(label, F.when(F.col("small"), 0).otherwise(F.col(label))).drop("small")


def drop_at_edge(labels: DataFrame, label: str, height: int, width: int, img: Sequence[str] = ("img",)) -> DataFrame:
    """The foreground rows of labels that do not touch the image edge, relabelled 1 to N as ``new``."""
    edge = labels.where((F.col(label) > 0) & ((F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == height - 1) | (F.col("x") == width - 1))).select(*img, label).distinct()
    return relabel(labels.where(F.col(label) > 0).join(edge, [*img, label], "left_anti"), label, img=img)


def union_seeds(pairs: DataFrame, gt_areas: DataFrame, pr_areas: DataFrame, most_iou: float, least_area: int, least_saliency: float = 0.0, img: Sequence[str] = ("img",)) -> DataFrame:
    """New ids of the second map's instances that join the first: large and salient enough, and IoU with all of the first below a bound.

    pr_areas has pr, pa and saliency. Ids go on from the largest of the first map.
    """
    taken = pairs.where(F.col("iou") >= most_iou).select(*img, "pr").distinct()
    fresh = pr_areas.where((F.col("pr") > 0) & (F.col("pa") >= least_area) & (F.col("saliency") >= least_saliency)).join(taken, [*img, "pr"], "left_anti")
    top = gt_areas.groupBy(*img).agg(F.max("gt").alias("top"))
    rank = F.row_number().over(Window.partitionBy(*img).orderBy("pr"))
    return fresh.join(top, list(img), "left").select(*img, "pr", (F.coalesce("top", F.lit(0)) + rank).alias("new"))


def novel(pair: DataFrame, img: Sequence[str] = ("img",)) -> DataFrame:
    """Labels of pr without any pixel on a label of gt, renumbered from 1."""
    hit = pair.where("gt > 0 and pr > 0").select(*img, "pr").distinct()
    rest = pair.where("pr > 0").select(*img, "pr").distinct().join(hit, [*img, "pr"], "left_anti")
    return rest.withColumn("new", F.row_number().over(Window.partitionBy(*img).orderBy("pr")))


def fill_merge(pair: DataFrame, img: Sequence[str] = ("img",)) -> DataFrame:
    """gt where it has a label, else pr with ids of its own after gt's largest, one for each pr label that fills a pixel."""
    fills = pair.where("gt = 0 and pr > 0").select(*img, "pr").distinct().withColumn("rank", F.row_number().over(Window.partitionBy(*img).orderBy("pr")))
    top = pair.groupBy(*img).agg(F.max("gt").alias("top"))
    ids = fills.join(top, list(img)).select(*img, "pr", (F.col("top") + F.col("rank")).alias("fresh"))
    return pair.join(ids, [*img, "pr"], "left").withColumn("merged", F.when(F.col("gt") > 0, F.col("gt")).otherwise(F.coalesce("fresh", F.lit(0))))


def merge_layers(layers: DataFrame, img: Sequence[str] = ("img",)) -> DataFrame:
    """Rows (img, layer, y, x, label) merged: ids of a layer follow the largest of all before it, later layers overwrite, then 1 to N."""
    tops = layers.groupBy(*img, "layer").agg(F.max("label").alias("top"))
    before = F.coalesce(F.sum("top").over(Window.partitionBy(*img).orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = layers.join(tops.withColumn("before", before).drop("top"), [*img, "layer"]).where("label > 0")
    top = placed.groupBy(*img, "y", "x").agg(F.max_by(F.col("label") + F.col("before"), "layer").alias("label"))
    return relabel(top, "label", img=img)


def merge_channels(rows: DataFrame, first: str, second: str, img: Sequence[str] = ("img",)) -> DataFrame:
    """Two label channels in one: the second's ids go on from the first's largest (absent ids leave gaps) and overwrite."""
    top = rows.groupBy(*img).agg(F.max(first).alias("top"))
    return rows.join(top, list(img)).withColumn("label", F.when(F.col(second) > 0, F.col(second) + F.col("top")).otherwise(F.col(first))).drop("top")


def resolve_overlap(rows: DataFrame, last: bool, img: Sequence[str] = ("img",)) -> DataFrame:
    """One label for each pixel that several (img, y, x, label) rows claim: the largest id if last wins, else the smallest."""
    return rows.groupBy(*img, "y", "x").agg((F.max("label") if last else F.min("label")).alias("label"))


def majority(votes: DataFrame, img: Sequence[str] = ("img",)) -> DataFrame:
    """Object or background by the majority of rows (img, y, x, object); a tie is the object."""
    yes = F.count_if("object")
    return votes.groupBy(*img, "y", "x").agg((2 * yes >= F.count("*")).alias("object"))


def difference_counts(pair: DataFrame, img: Sequence[str] = ("img",)) -> DataFrame:
    """Pixels where the maps agree, differ, only one has a label, or both have different ones."""
    gt, pr = F.col("gt"), F.col("pr")
    return pair.groupBy(*img).agg(
        F.count_if(gt == pr).alias("same"), F.count_if(gt != pr).alias("differ"), F.count_if((gt > 0) & (pr == 0)).alias("only_gt"), F.count_if((gt == 0) & (pr > 0)).alias("only_pr"), F.count_if((gt > 0) & (pr > 0) & (gt != pr)).alias("both")
    )


#: Bits of a global id that hold the label; those above hold the number of the block.
LABEL_BITS = 32


def global_ids(block: Column, label: Column) -> Column:
    """An id that no label of another block has: the block's number, then 32 bits of label; background stays 0.

    A label or a number of a block that does not fit is an error, never another id.
    """
    block, label = block.cast("long"), label.cast("long")
    fits = label.between(0, (1 << LABEL_BITS) - 1) & block.between(0, (1 << 63 - LABEL_BITS) - 1)
    failed = F.raise_error(F.concat(F.lit("no id holds label "), label.cast("string"), F.lit(" of block "), block.cast("string"))).cast("long")
    return F.when(label == 0, F.lit(0).cast("long")).when(fits, F.shiftleft(block, LABEL_BITS).bitwiseOR(label)).otherwise(failed)


def block_faces(rows: DataFrame, size: int, img: Sequence[str] = ("img",)) -> DataFrame:
    """Pairs of global ids (a, b) that touch across the right or lower face of a block of ``size``: equi-joins on the next pixel."""
    at = rows.where("id > 0")
    keys = [*img, "y", "x"]
    right = at.where(F.col("x") % size == size - 1).select(*img, "y", (F.col("x") + 1).alias("x"), F.col("id").alias("a"))
    below = at.where(F.col("y") % size == size - 1).select(*img, (F.col("y") + 1).alias("y"), "x", F.col("id").alias("a"))
    return right.unionByName(below).join(at.select(*keys, F.col("id").alias("b")), keys).select(*img, "a", "b").distinct()


#: Edges that a task joins at a time before any are shuffled by their ends.
EDGES = 1 << 20


def _stars(edges: DataFrame, near: Column) -> DataFrame:
    """(node, root): edges that ``near`` deals to one task, joined there EDGES at a time; root is the least node linked within those."""

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("a", "b"))
        names, of = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = _roots(len(names), of[: len(a)], of[len(a) :])
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[root])], ["node", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= EDGES:
                yield joined(held)
                held, n = [], 0
        if n:
            yield joined(held)

    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = edges.select(F.col("a").cast("long"), F.col("b").cast("long"), near.alias("_near")).repartition(parts, "_near").sortWithinPartitions("_near")
    return dealt.select("a", "b").mapInArrow(run, "node long, root long")


def components(edges: DataFrame, nodes: DataFrame, rounds: int = 100, near: Column | None = None) -> DataFrame:
    """(node, root): the smallest node that each node is linked with.

    With ``near``, a value of edges (a, b) that is often the same for edges of one component, such as a range of a, edges
    are first joined where that deals them, and only nodes that several such parts hold link those parts' roots further.
    The value decides how much is left for the rounds, never the result.
    """
    if near is None:
        return _in_rounds(edges, nodes, rounds)
    stars = settle(_stars(edges, near))
    met = settle(stars.groupBy("node").agg(F.min("root").alias("root"), F.max("root").alias("other")))
    shared = met.where("root <> other").select("node", F.col("root").alias("a"))
    if not shared.isEmpty():
        links = settle(shared.join(stars.withColumnRenamed("root", "b"), "node").where("a <> b").select("a", "b").distinct())
        tops = _in_rounds(links, links.select(F.col("a").alias("node")).union(links.select("b")).distinct(), rounds)
        met = met.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return nodes.select("node").join(met.select("node", "root"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _in_rounds(edges: DataFrame, nodes: DataFrame, rounds: int) -> DataFrame:
    """Components by a grouped minimum along edges, then along roots.

    After each step the roots' own roots are taken (pointer jumping), so rounds grow with the logarithm of a chain. Each
    round is checkpointed in the session's checkpoint folder.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = settle(both)
    roots = settle(nodes.select("node", F.col("node").alias("root")))
    for _ in range(rounds):
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = roots.join(near, "node", "left").select("node", F.least("root", F.coalesce("near", "root")).alias("root"), F.col("root").alias("old"))
        jump = step.join(roots.select(F.col("node").alias("root"), F.col("root").alias("further")), "root", "left").select("node", F.least("root", F.coalesce("further", "root")).alias("root"), "old")
        done = settle(jump)
        if done.where("root <> old").isEmpty():
            return done.select("node", "root")
        roots = done.select("node", "root")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def merge_boxes(boxes: DataFrame, by: str) -> DataFrame:
    """The box around all boxes of each merged id."""
    return boxes.groupBy(by).agg(F.min("r0").alias("r0"), F.max("r1").alias("r1"), F.min("c0").alias("c0"), F.max("c1").alias("c1"))


def dilate(labels: DataFrame, label: str, height: int, width: int, img: Sequence[str] = ("img",)) -> DataFrame:
    """One 3x3 dilation step that overwrites background only; the larger of competing labels wins."""
    at = labels.where(F.col(label) > 0)
    step = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
    moved = at.withColumn("s", step).select(*img, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), F.col(label).alias("l"), ((F.col("s.dy") == 0) & (F.col("s.dx") == 0)).alias("own"))
    inside = moved.where(f"y between 0 and {height - 1} and x between 0 and {width - 1}")
    return inside.groupBy(*img, "y", "x").agg(F.max_by("l", F.struct("own", "l")).alias(label))


def erode(labels: DataFrame, label: str, img: Sequence[str] = ("img",)) -> DataFrame:
    """Pixels whose four neighbours all lie in the image and have the same label: one grouped pass over what neighbours tell."""
    rest = [c for c in labels.columns if c not in (*img, "y", "x")]
    step = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 0), (-1, 0), (0, -1), (0, 1), (1, 0))]))
    told = labels.withColumn("_s", step).withColumn("_own", (F.col("_s.dy") == 0) & (F.col("_s.dx") == 0))
    told = told.select(*img, (F.col("y") + F.col("_s.dy")).alias("y"), (F.col("x") + F.col("_s.dx")).alias("x"), "_own", *rest)
    met = told.groupBy(*img, "y", "x").agg(*[F.max(F.when(F.col("_own"), F.col(c))).alias(c) for c in rest], F.min(label).alias("_lo"), F.max(label).alias("_hi"), F.count("*").alias("_n"), F.count_if("_own").alias("_here"))
    inner = (F.col(label) > 0) & (F.col("_n") == 5) & (F.col("_lo") == F.col("_hi"))
    return met.where("_here > 0").withColumn("inner", inner).select(*labels.columns, "inner")


def opening(labels: DataFrame, label: str, steps: int, height: int, width: int, wanted: int = 1, background: int = 2, img: Sequence[str] = ("img",)) -> DataFrame:
    """The map with one label opened by a cross, step by step, and everything else background.

    A step is one grouped count: a pixel stays if it and its four neighbours vote for it, and grows where any does.
    What is outside the image is background.
    """
    cross = [(0, 0), (-1, 0), (0, -1), (0, 1), (1, 0)]
    spread = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in cross]))
    at = labels.where(F.col(label) == wanted).select(*img, "y", "x")
    for least in [5] * steps + [1] * steps:
        moved = at.withColumn("s", spread).select(*img, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
        at = moved.where(f"y between 0 and {height - 1} and x between 0 and {width - 1}").groupBy(*img, "y", "x").agg(F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
    kept = labels.join(at.withColumn("kept", F.lit(True)), [*img, "y", "x"], "left")
    return kept.withColumn(label, F.when(F.col("kept"), wanted).otherwise(background)).drop("kept")


def shrunk(faces: DataFrame, label: str, along: str, keys: Sequence[str]) -> Column:
    """The label along a line of a block's face, 0 where it changes (by the slope over both neighbours) or next to that."""
    w = Window.partitionBy(*keys).orderBy(along)
    before, after = (F.coalesce(f(label, 1).over(w), F.col(label)) for f in (F.lag, F.lead))
    return F.when(before == after, F.col(label)).otherwise(0)


def shrunk_faces(rows: DataFrame, size: int, img: Sequence[str] = ("img",)) -> DataFrame:
    """Pairs of global ids (a, b) across faces of blocks, as ``block_faces``, of labels shrunk by a pixel along the face first."""
    at = rows.withColumns({"by": F.floor(F.col("y") / size), "bx": F.floor(F.col("x") / size)})
    found = []
    for across, along, face, other in (("x", "y", F.col("x") % size, "by"), ("y", "x", F.col("y") % size, "bx")):
        lines = at.where((face == size - 1) | (face == 0))
        keys = [*img, across, other]
        flat = lines.withColumn("flat", shrunk(lines, "id", along, keys))
        w = Window.partitionBy(*keys).orderBy(along)
        inner = (F.coalesce(F.lag("flat", 1).over(w), F.col("flat")) != 0) & (F.coalesce(F.lead("flat", 1).over(w), F.col("flat")) != 0)
        kept = flat.withColumn("inner", inner).where("inner and flat <> 0")
        left = kept.where(F.col(across) % size == size - 1).select(*img, (F.col(across) + 1).alias(across), along, F.col("id").alias("a"))
        right = kept.where(F.col(across) % size == 0).select(*img, across, along, F.col("id").alias("b"))
        found.append(left.join(right, [*img, across, along]).select(*img, "a", "b"))
    return found[0].unionByName(found[1]).distinct()
