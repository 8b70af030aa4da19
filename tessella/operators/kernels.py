"""Numerical kernels on the arrays of one image, numpy only, and the grouped operator that runs them.

``per_image`` gathers one image (or block) per group, whose size is that of the image, not of the table.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

EIGHT = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
FOUR = [(-1, 0), (0, -1), (0, 1), (1, 0)]


#: Values that stacks of arrays hold at most, unless a single array is larger.
CELLS = 1 << 20


def by_groups(rows: DataFrame, keys: Sequence[str], run: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str | StructType) -> DataFrame:
    """run on the rows of many whole groups at once, with the number of each row's group among them: they come sorted, in large batches.

    What a task holds is a batch and the group that goes on after it. Null keys form a group of their own.
    """
    names = list(keys)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # kernels take time that the size of rows does not tell

    def begins(on: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(on), bool)
        for c in names:
            codes = pd.factorize(on[c])[0]
            new[1:] |= codes[1:] != codes[:-1]
        return new

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        for batch in batches:
            if not len(batch):
                continue
            on = batch[names]
            new = begins(on)
            key = [None if pd.isna(v) else v for v in on.iloc[0]]
            new[0] = bool(held) and key != last
            at = np.flatnonzero(new)
            last = [None if pd.isna(v) else v for v in on.iloc[-1]]
            if not len(at):
                held.append(batch)
                continue
            whole = pd.concat([*held, batch.iloc[: at[-1]]], ignore_index=True) if held else batch.iloc[: at[-1]]
            first = begins(whole[names])
            held = [batch.iloc[at[-1] :]]
            yield run(whole, np.cumsum(first))
        if held:
            whole = pd.concat(held, ignore_index=True)
            yield run(whole, np.zeros(len(whole), np.int64))

    return rows.repartition(parts, *names).sortWithinPartitions(*names).mapInPandas(work, schema)


def by_group(rows: DataFrame, keys: Sequence[str], run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """run on the rows of each group, as a grouped map does, for many small groups."""

    def each(pdf: pd.DataFrame, of: np.ndarray) -> pd.DataFrame:
        at = [*np.flatnonzero(np.diff(of, prepend=-1)), len(of)]
        return pd.concat([run(pdf.iloc[i:j].reset_index(drop=True)) for i, j in zip(at[:-1], at[1:], strict=True)], ignore_index=True)

    return by_groups(rows, keys, each, schema)


def stacks(of: np.ndarray, y: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray], tuple[int, int, int], np.ndarray]]:
    """Groups of pixels as stacks of arrays of one shape: rows, their places in the stack, its shape and the groups in it.

    An array is the box of its group's pixels; ``of`` numbers groups from 0, row by row.
    """
    first = np.flatnonzero(np.diff(of, prepend=-1))
    top, left = np.minimum.reduceat(y, first), np.minimum.reduceat(x, first)
    tall, wide = np.maximum.reduceat(y, first) - top + 1, np.maximum.reduceat(x, first) - left + 1
    ends = np.append(first[1:], len(of))
    for h, w in np.unique(np.stack([tall, wide], 1), axis=0).tolist():
        every = np.flatnonzero((tall == h) & (wide == w))
        step = max(1, CELLS // (h * w))
        for lo in range(0, len(every), step):
            these = every[lo : lo + step]
            count = ends[these] - first[these]
            at = np.repeat(first[these] - np.cumsum(count) + count, count) + np.arange(count.sum())
            yield at, (np.repeat(np.arange(len(these)), count), y[at] - top[of[at]], x[at] - left[of[at]]), (len(these), h, w), these


def per_image(rows: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], v: str, out: str, height: int, width: int, keys: Sequence[str] = ("img",), kind: str = "long", stacked: bool = False) -> DataFrame:
    """(keys, y, x, out) of a kernel from array to array; pixels that have no row are 0. A stacked kernel takes a stack of images."""
    names = list(keys)
    step = max(1, CELLS // (height * width))

    def run(pdf: pd.DataFrame, of: np.ndarray) -> pd.DataFrame:
        first = np.flatnonzero(np.diff(of, prepend=-1))
        values, y, x = (pdf[c].to_numpy() for c in (v, "y", "x"))
        found = []
        for lo in range(0, len(first), step):
            at = slice(first[lo], first[lo + step] if lo + step < len(first) else len(of))
            stack = np.zeros((len(first[lo : lo + step]), height, width), values.dtype)
            stack[of[at] - lo, y[at], x[at]] = values[at]
            found += list(kernel(stack)) if stacked else [np.asarray(kernel(a)) for a in stack]
        shapes = {a.shape: [i.ravel() for i in np.indices(a.shape)] for a in found}
        n = np.array([a.size for a in found])
        own = {k: pdf[k].iloc[np.repeat(first, n)].to_numpy() for k in names}
        return pd.DataFrame({**own, "y": np.concatenate([shapes[a.shape][0] for a in found]), "x": np.concatenate([shapes[a.shape][1] for a in found]), out: np.concatenate([a.ravel() for a in found])})

    fields = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in names) + f", y int, x int, {out} {kind}"
    return by_groups(rows.select(*names, "y", "x", v), names, run, schema)


def per_pair(pair: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], dict[str, float]], schema: str, height: int, width: int, keys: Sequence[str] = ("img",)) -> DataFrame:
    """One row per image of a kernel on the arrays gt and pr; ``schema`` names what it returns."""
    names = list(keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grids = []
        for v in ("gt", "pr"):
            grid = np.zeros((height, width), np.int64)
            grid[pdf["y"].to_numpy(), pdf["x"].to_numpy()] = pdf[v].to_numpy()
            grids.append(grid)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in names}, **kernel(*grids)}])

    fields = {f.name: f.dataType.simpleString() for f in pair.schema}
    return by_group(pair.select(*names, "y", "x", "gt", "pr"), names, run, ", ".join(f"`{k}` {fields[k]}" for k in names) + ", " + schema)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n nodes' components, by minima along the links (a, b) and pointer jumping."""
    root = np.arange(n)
    while True:
        lo, hi = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (lo == hi).all():
            return root
        np.minimum.at(root, hi, lo)
        while not np.array_equal(further := root[root], root):
            root = further


def components(mask: np.ndarray, near: Sequence[tuple[int, int]] = EIGHT) -> np.ndarray:
    """Components of a mask numbered 1 to N in reading order: runs of rows are nodes, linked where they touch in the next row."""
    h, w = mask.shape
    turns = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    y, lo = np.nonzero(turns == 1)
    hi = np.nonzero(turns == -1)[1]
    reach, stride = int(len(near) == 8), w + 3
    # rows follow one another in the keys, so the runs of the next row that a run touches are a range
    first = np.searchsorted(y * stride + hi, (y + 1) * stride + lo - reach, "right")
    count = np.maximum(np.searchsorted(y * stride + lo, (y + 1) * stride + hi + reach, "left") - first, 0)
    a = np.repeat(np.arange(len(y)), count)
    b = np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(a))
    _, number = np.unique(_roots(len(y), a, b), return_inverse=True)
    out = np.zeros((h, w + 1), np.int64)
    np.add.at(out, (y, lo), number.ravel() + 1)
    np.add.at(out, (y, hi), -number.ravel() - 1)
    return np.cumsum(out, axis=1)[:, :w]


def _tall(stack: np.ndarray) -> np.ndarray:
    """A stack of images as one, a row of zeros after each."""
    n, h, w = stack.shape
    out = np.zeros((n, h + 1, w), stack.dtype)
    out[:, :h] = stack
    return out.reshape(n * (h + 1), w)


def each_components(masks: np.ndarray, near: Sequence[tuple[int, int]] = EIGHT) -> np.ndarray:
    """``components`` of each of a stack of masks, numbered from 1 in each."""
    n, h, w = masks.shape
    out = components(_tall(masks), near).reshape(n, h + 1, w)[:, :h]
    # numbers follow the order of reading, so those of an image go on from those of the images before
    top = np.maximum.accumulate(out.max((1, 2), initial=0))
    return np.where(out > 0, out - np.append(0, top[:-1])[:, None, None], 0)


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """The mask with all background that no path of four-neighbours joins with the edge."""
    outside = components(~np.pad(mask, 1), FOUR)
    return ~(outside == outside[0, 0])[1:-1, 1:-1]


def boxes(labels: np.ndarray) -> tuple[np.ndarray, list[tuple[slice, ...]]]:
    """The labels above 0, ascending, and the box of each, from one pass over the pixels."""
    at = np.argwhere(labels > 0)
    names, which = np.unique(labels[tuple(at.T)], return_inverse=True)
    lo = np.full((len(names), labels.ndim), max(labels.shape, default=0))
    hi = np.zeros((len(names), labels.ndim), np.int64)
    np.minimum.at(lo, which.ravel(), at)
    np.maximum.at(hi, which.ravel(), at + 1)
    return names, [tuple(slice(*x) for x in zip(l, h, strict=True)) for l, h in zip(lo.tolist(), hi.tolist(), strict=True)]


def renumber(labels: np.ndarray) -> np.ndarray:
    """Labels 1 to N by ascending id, background 0."""
    names, at = np.unique(labels, return_inverse=True)
    return (at.reshape(labels.shape) + int(len(names) > 0 and names[0] != 0)).astype(np.int64)


def clean(labels: np.ndarray, least: int) -> np.ndarray:
    """Small labels dropped, holes of each label filled in ascending order, labels numbered anew, small ones dropped again."""

    def without_small(a: np.ndarray) -> np.ndarray:
        names, n = np.unique(a, return_counts=True)
        return renumber(np.where(np.isin(a, names[(n < least) & (names > 0)]), 0, a)) if least > 0 else a

    out = without_small(labels).copy()
    for k, box in zip(*boxes(out), strict=True):
        part = out[box]
        part[fill_holes(part == k)] = k
    return without_small(out)


def _moved(mask: np.ndarray, near: Sequence[tuple[int, int]]) -> list[np.ndarray]:
    p = np.pad(mask, 1)
    return [p[1 + dy : 1 + dy + mask.shape[0], 1 + dx : 1 + dx + mask.shape[1]] for dy, dx in [(0, 0), *near]]


def opened(mask: np.ndarray, steps: int) -> np.ndarray:
    """The mask eroded, then dilated so many steps by four-neighbours; what is outside the image is background."""
    for _ in range(steps):
        mask = np.logical_and.reduce(_moved(mask, FOUR))
    for _ in range(steps):
        mask = np.logical_or.reduce(_moved(mask, FOUR))
    return mask


def closed(mask: np.ndarray, radius: int) -> np.ndarray:
    """The mask dilated, then eroded, by a disk, as if nothing ended at the edge of the image."""
    if not radius or not mask.any():
        return mask
    inner = tuple(slice(2 * radius, 2 * radius + n) for n in mask.shape)
    return (distance(distance(~np.pad(mask, 2 * radius)) <= radius) > radius)[inner]


def clean_object(mask: np.ndarray, radius: int = 1) -> np.ndarray:
    """One object: gaps closed, holes filled, then the largest of its eight-neighbour components (the first of equal ones)."""
    parts = components(fill_holes(closed(mask, radius)))
    sizes = np.bincount(parts.ravel())[1:]
    return parts == 1 + int(sizes.argmax()) if len(sizes) else mask


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """The assignment of rows to columns of the smallest total cost, by shortest augmenting paths with potentials."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, taken = np.zeros(n), np.zeros(m + 1), np.full(m + 1, -1)
    for i in range(n):
        taken[m], j, low, back, seen = i, m, np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while taken[j] >= 0:
            seen[j], row = True, taken[j]
            slack = c[row] - u[row] - v[:m]
            better = ~seen[:m] & (slack < low)
            low[better], back[better] = slack[better], j
            k = int(np.where(seen[:m], np.inf, low).argmin())
            step = low[k]
            u[taken[seen]] += step
            v[seen] -= step
            low[~seen[:m]] -= step
            j = k
        while j != m:
            taken[j] = taken[back[j]]
            j = back[j]
    pairs = [(int(taken[j]), j) for j in range(m) if taken[j] >= 0]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def iou_matrix(gt: np.ndarray, pr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The labels of both maps and the IoU of each pair."""
    g, p = np.unique(gt[gt > 0]), np.unique(pr[pr > 0])
    both = (gt > 0) & (pr > 0)
    at = np.searchsorted(g, gt[both]) * len(p) + np.searchsorted(p, pr[both])
    n = np.bincount(at, minlength=len(g) * len(p)).reshape(len(g), len(p))
    ga, pa = (np.bincount(np.searchsorted(names, v[v > 0]), minlength=len(names)) for names, v in ((g, gt), (p, pr)))
    return g, p, n / np.maximum(ga[:, None] + pa[None, :] - n, 1)


def best_pairs(gt: np.ndarray, pr: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """Which of the pairs (gt, pr) of positive worth are in an assignment of the largest total worth.

    Pairs fall into components that share no label, each assigned on its own; one of a single pair needs no assignment.
    """
    g, i = np.unique(gt, return_inverse=True)
    p, j = np.unique(pr, return_inverse=True)
    root = _roots(len(g) + len(p), i.ravel(), j.ravel() + len(g))[i.ravel()]
    taken, order = np.zeros(len(gt), bool), np.argsort(root, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(root[order])) + 1) if len(order) else []:
        if len(part) == 1:
            taken[part] = True
            continue
        a, r = np.unique(gt[part], return_inverse=True)
        b, c = np.unique(pr[part], return_inverse=True)
        cost, at = np.zeros((len(a), len(b))), np.full((len(a), len(b)), -1)
        cost[r.ravel(), c.ravel()], at[r.ravel(), c.ravel()] = -worth[part], part
        chosen = np.array([at[x] for x in assign(cost)])
        taken[chosen[chosen >= 0]] = True
    return taken


def matching_scores(gt: np.ndarray, pr: np.ndarray, n: np.ndarray, iou: np.ndarray, fewest: int, threshold: float = 0.5) -> tuple[int, float, int]:
    """(tp, iou_sum, overlap) of the overlapping pairs of an image, ``fewest`` being the smaller number of labels.

    tp and iou_sum: of an assignment that first maximises how many pairs reach the threshold, then the sum of IoU.
    overlap: pixels shared by the pairs of an assignment that maximises the sum of IoU alone.
    """
    first = best_pairs(gt, pr, (iou >= threshold) + iou / (2 * max(fewest, 1)))
    return int((iou[first] >= threshold).sum()), float(iou[first].sum()), int(n[best_pairs(gt, pr, iou)].sum())


def optimal_matching(gt: np.ndarray, pr: np.ndarray, threshold: float = 0.5) -> dict[str, float]:
    """``matching_scores`` of two maps, with the shared pixels as a share of both foregrounds together."""
    g, p, iou = iou_matrix(gt, pr)
    i, j = np.nonzero(iou)
    both, union = (gt > 0) & (pr > 0), int(((gt > 0) | (pr > 0)).sum())
    _, n = np.unique(np.stack([gt[both], pr[both]], 1), axis=0, return_counts=True)  # in the order of the pairs (i, j)
    tp, total, overlap = matching_scores(g[i], p[j], n, iou[i, j], min(len(g), len(p)), threshold)
    return {"tp": tp, "iou_sum": total, "aji_fused": overlap / union if union else 1.0}


def distance(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of each mask pixel to the nearest pixel outside it; infinite if there is none.

    Distances along columns come from running maxima and minima of rows; then columns are tried from near to far, until
    no distance can become smaller.
    """
    if mask.all():
        return np.where(mask, np.inf, 0.0)
    h, w = mask.shape
    rows = np.arange(h)[:, None]
    above = np.maximum.accumulate(np.where(mask, -np.inf, rows), axis=0)
    below = np.minimum.accumulate(np.where(mask, np.inf, rows)[::-1], axis=0)[::-1]
    column = np.minimum(rows - above, below - rows) ** 2
    out = column.copy()
    for k in range(1, w):
        if k * k >= out.max():
            break
        np.minimum(out[:, k:], column[:, :-k] + k * k, out=out[:, k:])
        np.minimum(out[:, :-k], column[:, k:] + k * k, out=out[:, :-k])
    return np.sqrt(out)


def peaks(values: np.ndarray, apart: int) -> list[tuple[int, int]]:
    """Local maxima above zero, highest first, none within ``apart`` rows and columns of a higher one."""
    top = values
    for axis in (0, 1):
        pads = [(0, 0), (0, 0)]
        pads[axis] = (apart, apart)
        top = np.lib.stride_tricks.sliding_window_view(np.pad(top, pads, constant_values=-np.inf), 2 * apart + 1, axis).max(-1)
    y, x = np.nonzero((values > 0) & (values >= top))
    taken, found = np.zeros(values.shape, bool), []
    for k in np.argsort(-values[y, x], kind="stable").tolist():
        if not taken[y[k], x[k]]:
            found.append((int(y[k]), int(x[k])))
            taken[max(0, y[k] - apart) : y[k] + apart + 1, max(0, x[k] - apart) : x[k] + apart + 1] = True
    return found


def watershed(height: np.ndarray, markers: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Floods from the markers within the mask in the order of height, then of arrival; each pixel is queued once."""
    w = mask.shape[1] + 2
    level = np.pad(height.astype(float), 1).ravel().tolist()
    out = np.pad(np.where(mask, markers, -1), 1, constant_values=-1).ravel().tolist()  # -1: not to be flooded
    heap = [(level[i], k, i) for k, i in enumerate(np.flatnonzero(np.pad(np.where(mask, markers, 0), 1).ravel() > 0).tolist())]
    heapq.heapify(heap)
    n, pop, push = len(heap), heapq.heappop, heapq.heappush
    while heap:
        _, _, i = pop(heap)
        for j in (i - w, i - 1, i + 1, i + w):
            if out[j] == 0:
                out[j] = out[i]
                push(heap, (level[j], n, j))
                n += 1
    return np.maximum(np.array(out).reshape(-1, w)[1:-1, 1:-1], 0)


def classical(values: np.ndarray, apart: int = 1) -> np.ndarray:
    """Marker-controlled watershed: foreground above the mean class threshold, markers at peaks of the distance."""
    lo, hi = values.min(), values.max()
    if hi <= lo:
        return np.zeros(values.shape, np.int64)
    byte = np.floor((values - lo) / (hi - lo) * 255).astype(int)
    n = np.bincount(byte.ravel(), minlength=256)
    w, m = np.cumsum(n), np.cumsum(n * np.arange(256))
    rest = w[-1] - w
    with np.errstate(all="ignore"):
        between = np.nan_to_num(w * rest * (m / w - (m[-1] - m) / rest) ** 2)
    mask = byte > int(between.argmax())
    deep = distance(np.pad(mask, 1))[1:-1, 1:-1]
    markers = np.zeros(values.shape, np.int64)
    for k, (y, x) in enumerate(peaks(deep, apart), 1):
        markers[y, x] = k
    return watershed(-deep, markers, mask)


def centres(labels: np.ndarray) -> np.ndarray:
    """Of each label, ascending, the flat place of its pixel nearest to the mean of all, the first in reading order of equal ones."""
    at = np.flatnonzero(labels > 0)
    _, which, n = np.unique(labels.ravel()[at], return_inverse=True, return_counts=True)
    which = which.ravel()
    far = np.zeros(len(at))
    for c in np.unravel_index(at, labels.shape):
        low = np.full(len(n), max(labels.shape))  # from the label's corner on, so its place in the array rounds nothing
        np.minimum.at(low, which, c)
        c = c - low[which]
        far += (c - (np.bincount(which, c) / n)[which]) ** 2
    order = np.lexsort((at, far.round(9), which))
    return at[order[np.concatenate(([0], np.cumsum(n)[:-1]))]] if len(n) else at


def to_flows(labels: np.ndarray) -> np.ndarray:
    """Unit vectors, an array for each axis, towards each label's centre, along the gradient of heat that spreads from there
    within the label; for planes and volumes. All labels spread at once, each as many rounds as its box is wide."""
    dims = labels.ndim
    steps = [(0, 0), *EIGHT] if dims == 2 else [(0,) * dims, *[tuple(int(k == a) * d for k in range(dims)) for a in range(dims) for d in (-1, 1)]]
    wide = np.pad(labels, 1)
    at = np.flatnonzero(wide.ravel() > 0)
    flows = np.zeros((dims, *labels.shape))
    if not len(at):
        return flows
    names, where = boxes(wide)
    which = np.searchsorted(names, wide.ravel()[at])
    rounds = np.array([2 * sum(x.stop - x.start + 2 for x in box) for box in where])[which]
    order = np.argsort(-rounds, kind="stable")  # what still spreads is a beginning of the list
    at, which, rounds = at[order], which[order], rounds[order]
    place = np.full(wide.size, len(at))
    place[at] = np.arange(len(at))
    shift = lambda step: int(np.dot(step, [int(np.prod(wide.shape[k + 1 :])) for k in range(dims)]))
    own = wide.ravel()[at]
    near = [np.where(wide.ravel()[at + shift(s)] == own, place[at + shift(s)], len(at)) for s in steps]
    sources = np.sort(place[centres(wide)])
    heat = np.zeros(len(at) + 1)
    for k in range(int(rounds[0])):
        m = int(np.searchsorted(-rounds, -k, "left"))
        heat[sources[: np.searchsorted(sources, m)]] += 1
        heat[:m] = sum(heat[x[:m]] for x in near) / len(steps)
    logs = np.log1p(heat)
    slope = []
    for axis in range(dims):
        up, down = (shift([int(k == axis) * d for k in range(dims)]) for d in (1, -1))
        a, b = (np.where(wide.ravel()[at + d] == own, place[at + d], len(at)) for d in (up, down))
        slope.append(logs[a] - logs[b])
    size = np.sqrt(sum(v * v for v in slope)) + 1e-60
    inner = tuple(c - 1 for c in np.unravel_index(at, wide.shape))
    for axis, v in enumerate(slope):
        flows[axis][inner] = v / size
    return flows


def each_to_flows(labels: np.ndarray) -> np.ndarray:
    """``to_flows`` of each of a stack of images, an array for each axis."""
    n, h, w = labels.shape
    apart = np.where(labels > 0, labels + np.arange(n)[:, None, None] * (int(labels.max(initial=0)) + 1), 0)
    return to_flows(_tall(apart)).reshape(2, n, h + 1, w)[:, :, :h]


def follow(flows: np.ndarray, mask: np.ndarray, steps: int = 200, apart: int = 0) -> np.ndarray:
    """Where the mask's pixels (in reading order) are after steps along the flow, interpolated and kept inside; in any number of dimensions.

    The first ``apart`` axes do not belong to the image, but number the images of a stack.
    """
    every = np.argwhere(mask)
    of, at = tuple(every[:, :apart].T), every[:, apart:].astype(float)
    top = np.array(mask.shape[apart:]) - 1.0
    last = np.maximum(top.astype(int) - 1, 0)
    for _ in range(steps):
        lo = np.clip(np.floor(at).astype(int), 0, last)
        hi = np.minimum(lo + 1, top.astype(int))
        part = at - lo
        move = np.zeros_like(at)
        for corner in product((0, 1), repeat=mask.ndim - apart):
            weight = np.prod([part[:, k] if c else 1 - part[:, k] for k, c in enumerate(corner)], axis=0)
            place = (*of, *(hi[:, k] if c else lo[:, k] for k, c in enumerate(corner)))
            move += weight[:, None] * np.stack([f[place] for f in flows], 1)
        at = np.clip(at + move, 0, top)
    return at


#: How ends of flows become labels (fixed values): margin of the histogram, reach of a peak, steps and reach that a seed grows.
MARGIN, PEAK, GROWTH = 20, 2, 5


def _reach(a: np.ndarray, n: int) -> np.ndarray:
    """Maxima within n places along every axis but the first, one axis after the other."""
    for axis in range(1, a.ndim):
        pads = [(n * (k == axis),) * 2 for k in range(a.ndim)]
        a = np.lib.stride_tricks.sliding_window_view(np.pad(a, pads), 2 * n + 1, axis).max(-1)
    return a


def _grown(part: np.ndarray) -> np.ndarray:
    """Masks, numbered by the first axis, and what touches them, corners included."""
    for axis in range(1, part.ndim):
        wide = part.copy()
        low, high = ((slice(None),) * axis + (x,) for x in (slice(1, None), slice(None, -1)))
        wide[low] |= part[high]
        wide[high] |= part[low]
        part = wide
    return part


def gather(ends: np.ndarray, mask: np.ndarray, seed_count: int = 10, grow_count: int = 2, most: float = 0.4, apart: int = 0) -> np.ndarray:
    """Labels of the mask's pixels by where they end: peaks of the histogram of ends seed regions, which grow some steps.

    The first ``apart`` axes number the images of a stack.
    """
    stack = mask.reshape(-1, *mask.shape[apart:])
    size, dims = int(np.prod(stack.shape[1:])), stack.ndim - 1
    which = np.nonzero(stack)[0]
    h = np.zeros((len(stack), *np.array(stack.shape[1:]) + 2 * MARGIN), np.int64)
    at = (which, *(np.floor(ends).astype(int) + MARGIN).T)
    np.add.at(h, at, 1)
    seeds = np.argwhere((h >= _reach(h, PEAK)) & (h > seed_count))
    seeds = seeds[np.lexsort((h[tuple(seeds.T)], seeds[:, 0]))]
    number = np.arange(len(seeds)) - np.searchsorted(seeds[:, 0], seeds[:, 0]) + 1
    box = [seeds[:, 0].reshape(-1, *(1,) * dims)]
    for k in range(dims):
        side = np.arange(-GROWTH, GROWTH + 1).reshape(*(-1 if k == j else 1 for j in range(dims)))
        box.append(seeds[:, k + 1].reshape(-1, *(1,) * dims) + side)
    near = h[tuple(box)] > grow_count
    part = np.zeros(near.shape, bool)
    part[(slice(None), *(GROWTH,) * dims)] = True
    for _ in range(GROWTH):
        part = _grown(part) & near
    region = np.zeros(h.shape, np.int64)
    np.maximum.at(region, tuple(b[part] for b in np.broadcast_arrays(*box)), np.broadcast_to(number.reshape(box[0].shape), part.shape)[part])  # later seeds overwrite
    out = np.zeros(stack.shape, np.int64)
    out[stack] = region[at]
    top = int(out.max(initial=0)) + 1
    of = np.arange(len(stack)).reshape(box[0].shape[:0] + (-1, *(1,) * dims))
    n = np.bincount((of * top + out).ravel(), minlength=len(stack) * top).reshape(len(stack), top)
    kept = (n > 0) & (n <= most * size)
    kept[:, 0] = False
    return np.where(kept, np.cumsum(kept, 1), 0)[of, out].reshape(mask.shape)


def stitch(planes: Sequence[np.ndarray], threshold: float = 0.25) -> list[np.ndarray]:
    """Labels carried from plane to plane by the best IoU of at least the threshold; others get new numbers."""
    out = [planes[0]]
    top = int(planes[0].max(initial=0))
    for plane in planes[1:]:
        names, before, iou = iou_matrix(plane, out[-1])
        iou = np.where((iou >= threshold) & (iou >= iou.max(0, initial=0)), iou, 0)
        carried = iou.max(1, initial=0) > 0
        new = np.zeros(len(names) + 1, np.int64)
        new[1:][carried] = before[iou[carried].argmax(1)] if len(before) else 0
        new[1:][~carried] = top + 1 + np.arange((~carried).sum())
        top += int((~carried).sum())
        out.append(new[np.where(plane > 0, np.searchsorted(names, plane) + 1, 0)])
    return out


def rasterise(polygons: Sequence[Sequence[tuple[float, float]]], height: int, width: int, last: bool = False) -> np.ndarray:
    """Labels 1 to N of the pixels whose centres lie in polygons of (x, y) points, by crossings; the first or the last polygon wins.

    Each polygon is tried on the pixels of its own box.
    """
    out = np.zeros((height, width), np.int64)
    for k, points in enumerate(polygons, 1):
        xs, ys = np.array(points, float).reshape(-1, 2).T
        if not len(xs):
            continue
        y0, y1 = int(np.clip(np.floor(ys.min()), 0, height)), int(np.clip(np.ceil(ys.max()) + 1, 0, height))
        x0, x1 = int(np.clip(np.floor(xs.min()), 0, width)), int(np.clip(np.ceil(xs.max()) + 1, 0, width))
        y, x = np.arange(y0, y1)[:, None], np.arange(x0, x1)[None, :]
        inside = np.zeros((y1 - y0, x1 - x0), bool)
        for xa, ya, xb, yb in zip(xs, ys, np.roll(xs, -1), np.roll(ys, -1), strict=True):
            if ya != yb:
                inside ^= ((ya > y) != (yb > y)) & (x < (xb - xa) * (y - ya) / (yb - ya) + xa)
        part = out[y0:y1, x0:x1]
        part[inside & ((part == 0) | last)] = k
    return out


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of (x, y) points, by a monotone chain."""
    at = sorted(map(tuple, points))
    if len(at) < 3:
        return np.array(at)

    def half(order: list) -> list:
        out: list = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(at) + half(at[::-1]))


def shape_statistics(mask: np.ndarray) -> dict[str, float]:
    """Area, perimeter (length of the pixels' outer edges), compactness and solidity (area over that of the pixels' hull)."""
    p = np.pad(mask, 1).astype(int)
    perimeter = int(np.abs(np.diff(p, axis=0)).sum() + np.abs(np.diff(p, axis=1)).sum())
    area = int(mask.sum())
    corners = np.unique(np.concatenate([np.argwhere(mask) + d for d in ((0, 0), (0, 1), (1, 0), (1, 1))]), axis=0) if area else np.zeros((0, 2))
    h = hull(corners)
    full = abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(h, np.roll(h, -1, axis=0), strict=True))) / 2 if len(h) > 2 else 0.0
    return {"area": area, "perimeter": float(perimeter), "compactness": min(1.0, 4 * np.pi * area / perimeter**2) if perimeter else 0.0, "solidity": area / full if full else 0.0}


def without_covered(masks: Sequence[np.ndarray], threshold: float = 0.75) -> np.ndarray:
    """Overlapping masks made one map: small to large, those covered to the threshold by the rest go; shared pixels to the nearest centre."""
    shape = masks[0].shape
    places = [np.flatnonzero(m) for m in masks]
    cover = np.bincount(np.concatenate(places), minlength=masks[0].size)  # masks that hold a pixel
    live = []
    for k in sorted(range(len(masks)), key=lambda i: (len(places[i]), i)):
        own = places[k]
        if len(own) and (cover[own] > 1).mean() >= threshold:
            cover[own] -= 1
        elif len(own):
            live.append(k)
    if not live:
        return np.zeros(shape, np.int64)
    at, which = np.concatenate([places[k] for k in live]), np.repeat(live, [len(places[k]) for k in live])
    yx = {k: np.stack(np.divmod(places[k], shape[1])) for k in live}
    far = np.concatenate([((yx[k] - np.median(yx[k], axis=1, keepdims=True)) ** 2).sum(0) for k in live])
    order = np.lexsort((which, far, at))
    pixel, first = np.unique(at[order], return_index=True)
    out = np.zeros(masks[0].size, np.int64)
    out[pixel] = 1 + which[order][first]
    return out.reshape(shape)


def outline(mask: np.ndarray) -> np.ndarray:
    """The points (x, y) along the outer border of a mask's largest eight-neighbour component, in order, clockwise from its first pixel.

    Neighbours are tried clockwise from the one after where the walk came from, until it leaves the first pixel as it did first.
    """
    parts = components(mask)
    if not parts.any():
        return np.zeros((0, 2), np.int64)
    p = np.pad(parts == 1 + int(np.bincount(parts.ravel())[1:].argmax()), 1)
    y, x = (int(v) for v in np.argwhere(p)[0])
    around = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]  # clockwise from the left
    start, points, came = (y, x), [(x - 1, y - 1)], 0
    first = None
    while True:
        for turn in range(1, 9):
            k = (came + turn) % 8
            if p[y + around[k][0], x + around[k][1]]:
                break
        else:
            break  # a single pixel
        if (y, x) == start and first == k:
            break
        first = k if first is None else first
        y, x = y + around[k][0], x + around[k][1]
        came = (k + 4) % 8
        points.append((x - 1, y - 1))
    return np.array(points[:-1] if len(points) > 1 else points)


def band_passed(values: np.ndarray, smooth: float = 0.0, sharpen: float = 0.0) -> np.ndarray:
    """An image smoothed by a Gaussian of one radius, less itself smoothed by another; edges go over to the other side."""
    far = sum(g.astype(float) ** 2 for g in np.meshgrid(*[np.minimum(np.arange(n), n - np.arange(n)) for n in values.shape], indexing="ij"))

    def blur(radius: float) -> np.ndarray:
        weights = np.exp(-far / (2 * radius * radius))
        return np.fft.fftn(weights / weights.sum())

    weight = blur(smooth) if smooth > 0 else np.ones(values.shape)
    return np.real(np.fft.ifftn(np.fft.fftn(values) * (weight - blur(sharpen) if sharpen > 0 else weight)))
