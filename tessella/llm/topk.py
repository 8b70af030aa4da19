"""Exact top-k inner products, with bounds from multi-resolution segment statistics.

A vector is cut into 1, 2, 4, ... segments; of each segment its mean m and deviation s are known. The squared distance
of two vectors is at least the sum over the segments of width * ((m - m')**2 + (s - s')**2), hence their inner product
at most the sum of width * (m m' + s s'): distance and product differ by the norms, which are known exactly. The bounds
get tighter as segments get finer. A block of queries meets a block of candidates: the rows with the best coarse bounds
are scored exactly and set the score to beat, then coarse to fine bounds remove what can't reach it, and the survivors
are scored exactly. Of a block only the k best go on, and the best of all blocks are chosen by a window.

Scores are integers, added without rounding. Bounds carry a slack above their rounding error, and rows whose bound
equals the score to beat survive, so ties are exact.

Defined results: vectors that are null or empty, hold a null or non-finite component or have a null id take no part; queries are
compared with vectors of their own length; a query never finds rows of its own id; ties go to the smaller id; repeated
rows are found each; queries that share an id share one list, the best of what each finds; an empty table gives no rows.
Components and scores beyond a long count as its nearest end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of queries and of a block of candidates.
QUERY_ROWS, ROWS = 512, 4096
#: Segments of the levels, coarse to fine.
LEVELS = (1, 4, 16)
#: Survivors' share up to which they are bounded pair by pair rather than as a whole block.
SPARSE = 0.1
#: Pairs whose vectors are gathered at once.
STEP = 1 << 14
#: The largest score.
LONG = (1 << 63) - 1


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component x as double, as longs; null if the vector takes no part."""
    sound = (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.when(F.coalesce(sound, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _summary(x: np.ndarray, segments: int) -> np.ndarray:
    """Per row: means, then deviations, of the segments, times the root of their widths, so that bounds are products."""
    edges = np.linspace(0, x.shape[1], segments + 1).astype(int)
    width = np.maximum(np.diff(edges), 1)
    s = np.stack([x[:, a:b].sum(1) for a, b in zip(edges[:-1], edges[1:], strict=True)], 1)
    q = np.stack([(x[:, a:b] ** 2).sum(1) for a, b in zip(edges[:-1], edges[1:], strict=True)], 1)
    mean = s / width
    return np.concatenate([mean * np.sqrt(width), np.sqrt(np.maximum(q / width - mean**2, 0)) * np.sqrt(width)], 1)


def _distinct(ids: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Without the rows that ``most`` rows of smaller id and the same vector precede: they can't be among the best."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    _, kind = np.unique(x, axis=0, return_inverse=True)
    kind = kind.ravel()
    by = np.argsort(kind, kind="stable")
    first = np.concatenate(([0], np.flatnonzero(np.diff(kind[by])) + 1))
    rank = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
    keep = np.sort(by[rank < most])
    return ids[keep], x[keep]


def _products(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The inner products of the rows i of a and j of b; exact for sums below 2**53 and for objects (Python numbers), whose ends are those of a long."""
    out = np.empty(len(i), a.dtype)
    for lo in range(0, len(i), STEP):
        at = slice(lo, lo + STEP)
        out[at] = [min(max(s, -LONG - 1), LONG) for s in (a[i[at]] * b[j[at]]).sum(1)] if a.dtype == object else np.einsum("nd,nd->n", a[i[at]], b[j[at]])
    return out


def search_block(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score) of the k best candidates of each query, exactly; q and c hold integers."""
    fq, fc = q.astype(np.float64), c.astype(np.float64)
    big = np.abs(fq).max(initial=0) * np.abs(fc).max(initial=0) * q.shape[1] >= 2.0**52
    own_times = int(np.unique(cid, return_counts=True)[1].max(initial=0))
    cid, c = _distinct(cid, c, k + own_times)
    fc = c.astype(np.float64)
    xq, xc = (q.astype(object), c.astype(object)) if big else (fq, fc)
    levels = [s for s in LEVELS if s <= q.shape[1]]
    own = qid[:, None] == cid[None, :]
    slack = 1e-9 * (1 + np.sqrt((fq**2).sum(1)) * np.sqrt((fc**2).sum(1).max(initial=0)))[:, None]
    known = {s: (_summary(fq, s), _summary(fc, s)) for s in levels}
    probe = levels[min(1, len(levels) - 1)]
    bound = np.where(own, -np.inf, known[probe][0] @ known[probe][1].T + slack)
    top = min(k, bound.shape[1])
    first = np.argpartition(-bound, top - 1, axis=1)[:, :top]
    seen = _products(xq, np.repeat(np.arange(len(q)), top), xc, first.ravel()).reshape(len(q), top)
    usable = ~np.take_along_axis(own, first, 1)
    beat = np.array([min(s[u]) if u.sum() == k else -np.inf for s, u in zip(seen, usable, strict=True)], object if big else float)[:, None]
    alive = ~own
    for s, (a, b) in known.items():
        if s == probe:
            alive &= bound >= beat
        elif alive.mean() > SPARSE:
            alive &= a @ b.T + slack >= beat
        else:
            i, j = np.nonzero(alive)
            alive[i, j] = _products(a, i, b, j) + slack[i, 0] >= beat[i, 0]
    if not big and alive.mean() > SPARSE:  # little could be excluded: score as a whole, and keep what reaches the k-th best
        product = np.where(alive, fq @ fc.T, -np.inf)
        alive &= product >= np.partition(product, -top, axis=1)[:, -top:].min(1)[:, None]
        i, j = np.nonzero(alive)
        score = product[i, j]
    else:
        i, j = np.nonzero(alive)
        score = _products(xq, i, xc, j)
    order = np.array(sorted(range(len(i)), key=lambda t: (i[t], -score[t], cid[j[t]])), np.int64) if big else np.lexsort((cid[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    start = np.searchsorted(i, np.arange(len(q)))
    keep = np.arange(len(i)) - start[i] < k if len(i) else np.zeros(0, bool)
    return qid[i[keep]], cid[j[keep]], score[keep].astype(np.int64)


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, v) as blocks (dim, ids, vs) of at most ``size`` rows, packed where they are, without a shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def block(dim: int) -> pd.DataFrame:
            many = held.pop(dim)
            return pd.DataFrame({"dim": [dim], "ids": [np.array([i for i, _ in many], np.int64).tobytes()], "vs": [np.stack([v for _, v in many]).astype(np.int64).tobytes()]})

        for batch in batches:
            for i, v in zip(batch["id"].tolist(), batch["v"], strict=True):
                held.setdefault(len(v), []).append((i, np.asarray(v, np.int64)))
                if len(held[len(v)]) >= size:
                    yield block(len(v))
        for dim in list(held):
            yield block(dim)

    return rows.mapInPandas(run, "dim int, ids binary, vs binary")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, row_id: str = "vec_id", vector: str = "embedding", query_rows: int = QUERY_ROWS, rows: int = ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that holds ``is_query`` the k other rows of the largest products.

    Blocks of queries are dealt to as many groups as blocks of candidates are, and the two meet on the group and the
    dimension: the stated queries against all rows, in blocks. A pair of blocks is one row, handled as it streams by.
    """
    sound = vectors.select(F.col(row_id).cast("long").alias("id"), quantised(F.col(vector)).alias("v"), is_query.alias("q")).where(F.col("v").isNotNull() & F.col("id").isNotNull())
    # no more groups than there are blocks of candidates to fill them
    lanes = max(1, min(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * -(-vectors.count() // rows)))
    candidates = _blocks(sound.select("id", "v"), rows).withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int"))
    asked = _blocks(sound.where("q").select("id", "v"), query_rows).select("dim", F.col("ids").alias("qids"), F.col("vs").alias("qvs"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"))
    pairs = candidates.join(asked, ["lane", "dim"]).select("dim", "qids", "qvs", "ids", "vs")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, qids, qvs, ids, vs in batch.itertuples(index=False):
                parts = search_block(np.frombuffer(qids, np.int64), np.frombuffer(qvs, np.int64).reshape(-1, dim), np.frombuffer(ids, np.int64), np.frombuffer(vs, np.int64).reshape(-1, dim), k)
                yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), parts, strict=True)))

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = pairs.mapInPandas(run, "query_id long, vec_id long, score long")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
