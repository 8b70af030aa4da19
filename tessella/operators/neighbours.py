"""Labels by the majority of the nearest vectors, over all pairs of vectors, block by block.

Rows are dealt to blocks of equal size. Blocks of asked vectors form the rows, blocks of labelled ones the columns of a
grid of cells, and each pair of blocks meets in one cell. Distances of a pair of blocks come from one matrix product;
what they leave within their rounding error of the k-th best is measured exactly, so ties are exact.

Defined results: vectors that are null or empty, hold a null or non-finite component or have a null id take no part;
vectors without a label are labelled, but do not vote; vectors are compared with those of their own length; no row of a
vector's own id votes for it; ties of distance go to the smaller id, ties of votes to the smaller label. A vector
without any neighbour has no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block.
ROWS = 2048
#: Groups of columns whose minima bound the k-th smallest distance, for each neighbour asked for.
SPREAD = 16
#: Pairs whose vectors are gathered at once.
STEP = 1 << 14


def _few_copies(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In order of ids, without the rows that ``most`` earlier rows of the same vector precede: they can't be among the nearest."""
    order = np.lexsort((labels, ids))
    ids, labels, x = ids[order], labels[order], x[order]
    _, kind = np.unique(x, axis=0, return_inverse=True)
    kind = kind.ravel()
    by = np.argsort(kind, kind="stable")
    first = np.concatenate(([0], np.flatnonzero(np.diff(kind[by])) + 1))
    rank = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
    keep = np.sort(by[rank < most])
    return ids[keep], labels[keep], x[keep]


def nearest_block(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, label: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(row of q, id, label, squared distance rounded to 9 places) of the k nearest rows of c of another id."""
    own_times = int(np.unique(cid, return_counts=True)[1].max(initial=0))
    cid, label, c = _few_copies(cid, label, c, k + own_times)
    nq, nc = (q * q).sum(1), (c * c).sum(1)
    about = q @ c.T
    about *= -2
    about += nc
    about += nq[:, None]
    lo, hi = np.searchsorted(cid, qid, "left"), np.searchsorted(cid, qid, "right")
    for r in np.flatnonzero(hi > lo):
        about[r, lo[r] : hi[r]] = np.inf
    if about.shape[1] > k:
        width = max(1, about.shape[1] // (SPREAD * k))
        low = np.minimum.reduceat(about, np.arange(0, about.shape[1], width), axis=1)
        limit = np.partition(low, k - 1, axis=1)[:, k - 1]  # k groups hold as small a distance, so the k-th smallest is no larger
        limit += 4e-9 + 1e-12 * (nq + nc.max())
        i, j = np.nonzero(~(about > limit[:, None]))
    else:
        i, j = (a.ravel() for a in np.indices(about.shape))
    other = qid[i] != cid[j]
    i, j = i[other], j[other]
    d = np.concatenate([((q[i[s : s + STEP]] - c[j[s : s + STEP]]) ** 2).sum(1) for s in range(0, len(i), STEP)] or [np.zeros(0)]).round(9)
    order = np.lexsort((label[j], cid[j], d, i))
    i, j, d = i[order], j[order], d[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], cid[j[keep]], label[j[keep]], d[keep]


def _found(vectors: DataFrame, k: int, row_id: str, label: str, vector: str, rows: int) -> DataFrame:
    """(row, query_id, id, label, d, k): the k nearest labelled rows of every row."""
    v = F.col(vector)
    sound = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), F.lit(False))
    used = vectors.where(sound & F.col(row_id).isNotNull())
    blocks = max(1, -(-used.count() // rows))
    side = min(blocks, int(np.ceil(np.sqrt(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))))
    dealt = used.select(F.col(row_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), v.cast("array<double>").alias("v"), F.size(v).alias("dim"), F.monotonically_increasing_id().alias("row"))

    def block(key: tuple, many: pd.DataFrame) -> pd.DataFrame:
        voting = many["label"].notna().to_numpy()
        whole = lambda c: c.fillna(0).to_numpy(np.int64).tobytes()
        return pd.DataFrame({"dim": [key[0]], "block": [key[1]], "rows": [whole(many["row"])], "ids": [whole(many["id"])], "labels": [whole(many["label"])], "voting": [voting.tobytes()], "vs": [np.stack(many["v"].to_numpy()).astype(np.float64).tobytes()]})

    packed = dealt.withColumn("block", (F.col("row") % blocks).cast("int")).groupBy("dim", "block").applyInPandas(block, "dim int, block int, rows binary, ids binary, labels binary, voting binary, vs binary")
    every = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    asked = packed.select("dim", F.col("block").alias("qblock"), F.col("rows").alias("qrows"), F.col("ids").alias("qids"), F.col("vs").alias("qvs"), every.alias("across")).withColumn("down", F.col("qblock") % side)
    known = packed.select("dim", "ids", "labels", "voting", "vs", every.alias("down"), (F.col("block") % side).alias("across"))
    pairs = asked.join(known, ["dim", "down", "across"]).select("dim", "down", "across", "qblock", "qrows", "qids", "qvs", "ids", "labels", "voting", "vs")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["row", "query_id", "id", "label", "d"]
        at, best = None, pd.DataFrame(columns=names)
        for batch in batches:
            for dim, down, across, qblock, qrows, qids, qvs, ids, labels, voting, vs in batch.itertuples(index=False):
                if at != (dim, down, across, qblock):  # pairs of a block of asked vectors mostly follow one another
                    if len(best):
                        yield best
                    at, best = (dim, down, across, qblock), pd.DataFrame(columns=names)
                votes = np.frombuffer(voting, bool)
                if not votes.any():
                    continue
                qrow, qid = np.frombuffer(qrows, np.int64), np.frombuffer(qids, np.int64)
                cs = (np.frombuffer(ids, np.int64)[votes], np.frombuffer(labels, np.int64)[votes], np.frombuffer(vs).reshape(-1, dim)[votes])
                i, cid, lab, d = nearest_block(qid, np.frombuffer(qvs).reshape(-1, dim), *cs, k)
                found = pd.DataFrame(dict(zip(names, (qrow[i], qid[i], cid, lab, d), strict=True)))
                if len(best):
                    found = pd.concat([best, found], ignore_index=True).sort_values(["row", "d", "id", "label"], ignore_index=True)
                    found = found[found.groupby("row").cumcount() < k]
                best = found
        if len(best):
            yield best

    near = pairs.mapInPandas(run, "row long, query_id long, id long, label long, d double")
    return near.withColumn("k", F.row_number().over(Window.partitionBy("row").orderBy("d", "id", "label"))).where(F.col("k") <= k)


def nearest(vectors: DataFrame, k: int = 5, row_id: str = "vec_id", label: str = "label", vector: str = "embedding", rows: int = ROWS) -> DataFrame:
    """(vec_id, k, id, d): the k nearest labelled others of every vector, with squared distances."""
    return _found(vectors, k, row_id, label, vector, rows).select(F.col("query_id").alias(row_id), "k", "id", "d")


def nearest_labels(vectors: DataFrame, k: int = 5, row_id: str = "vec_id", label: str = "label", vector: str = "embedding", rows: int = ROWS) -> DataFrame:
    """(vec_id, predicted) of every vector: the label that most of its k nearest other vectors have."""
    chosen = _found(vectors, k, row_id, label, vector, rows)
    votes = chosen.groupBy("row", "query_id", "label").agg(F.count("*").alias("n"))
    out = votes.groupBy("row", "query_id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("predicted"))
    return out.select(F.col("query_id").alias(row_id), F.col("predicted").cast(vectors.schema[label].dataType).alias("predicted"))


def principal(vectors: DataFrame, count: int, row_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(vec_id, label, pc1, pc2, ...): vectors in the directions of largest variance of all of them.

    Directions come from one covariance matrix, summed where the rows are; each points to where its largest part is
    positive. Null or unsound vectors have no row; all others are of one length.
    """
    sound = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.where(F.coalesce((F.size(vector) > 0) & sound, F.lit(False))).select(row_id, label, F.col(vector).cast("array<double>").alias("v"))
    axes = PCA(k=count, inputCol="v", outputCol="place").fit(rows.select(array_to_vector("v").alias("v"))).pc.toArray()
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    parts = [F.aggregate(F.zip_with("v", F.lit([float(x) for x in axis]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for axis in axes.T]
    return rows.select(row_id, label, *[p.alias(f"pc{i}") for i, p in enumerate(parts, 1)])
