"""Quality classifier: a generalised additive model with pairwise interactions, by cyclic boosting of shallow trees.

Every feature is cut into quantile bins. Boosting visits the features in turn; each visit fits one tree of a few leaves
to the gradients summed by bin and adds a small step of it to the feature's lookup table. When the main effects stand,
the pairs of features are ranked by how much a four-quadrant split gains on what is left, and the best get tables of
their own, boosted in turn the same way. A score is the logistic function of one table value per feature and pair, so
scoring is a binary search per feature and additions of table values, for a whole batch at once.

Defined results: without labelled rows every score is 0.5, with labels of one kind alone all scores are near that one;
null features, as of null and empty texts, count as 0 and are scored like any other; equal rows get equal scores; an
empty table gives no rows. Ties between cuts, or between pairs, go to the first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Additive:
    """Edges and tables by feature, tables by pair, and the intercept; without labelled rows it scores 0.5."""

    names: list[str]
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        if self.tables:
            x = np.nan_to_num(x)
            for j, table in enumerate(self.tables):
                total += table[np.searchsorted(self.edges[j], x[:, j], "right")]
            for (i, j), table in self.pairs.items():
                total += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="higher"))


def _value(g: np.ndarray | float, h: np.ndarray | float) -> np.ndarray | float:
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """The leaf values, by bin, of a tree over ordered bins that always splits where the gain is largest."""
    parts = [(0, len(g))]

    def best(lo: int, hi: int) -> tuple[float, int]:
        a, b = np.cumsum(g[lo : hi - 1]), np.cumsum(h[lo : hi - 1])
        if not len(a):
            return 0.0, lo
        sg, sh = g[lo:hi].sum(), h[lo:hi].sum()
        gain = a * a / (b + 1) + (sg - a) ** 2 / (sh - b + 1) - sg * sg / (sh + 1)
        k = int(gain.argmax())
        return float(gain[k]), lo + k + 1

    while len(parts) < leaves:
        (gain, at), p = max((best(*p), p) for p in parts)
        if gain <= 1e-9:
            break
        parts.remove(p)
        parts += [(p[0], at), (at, p[1])]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = _value(g[lo:hi].sum(), h[lo:hi].sum())
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a table of bins into four quadrants: its gain and its values by bin."""
    a, b = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    gain, parts = 0.0, []
    for s, t in ((a[:-1, :-1], b[:-1, :-1]), (a[:-1, -1:] - a[:-1, :-1], b[:-1, -1:] - b[:-1, :-1]), (a[-1:, :-1] - a[:-1, :-1], b[-1:, :-1] - b[:-1, :-1]), (a[-1, -1] - a[:-1, -1:] - a[-1:, :-1] + a[:-1, :-1], b[-1, -1] - b[:-1, -1:] - b[-1:, :-1] + b[:-1, :-1])):
        gain = gain + s * s / (t + 1)
        parts.append(_value(s, t))
    r, c = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty_like(g)
    out[: r + 1, : c + 1], out[: r + 1, c + 1 :], out[r + 1 :, : c + 1], out[r + 1 :, c + 1 :] = (p[r, c] for p in parts)
    return float(gain[r, c] - a[-1, -1] ** 2 / (b[-1, -1] + 1)), out


def fit(x: np.ndarray, y: np.ndarray, names: Sequence[str], bins: int = 48, coarse: int = 8, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 6, leaves: int = 3, rate: float = 0.15) -> Additive:
    """Learn from features x (rows, features) and labels y in (0, 1); the same input gives the same model."""
    out = Additive(list(names))
    if not len(y):
        return out
    x = np.nan_to_num(x)
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    out.intercept = float(np.log(prior / (1 - prior)))
    f = np.full(len(y), out.intercept)
    out.edges, out.coarse = [_cuts(v, bins) for v in x.T], [_cuts(v, coarse) for v in x.T]
    at = [np.searchsorted(e, v, "right") for e, v in zip(out.edges, x.T, strict=True)]
    wide = [np.searchsorted(e, v, "right") for e, v in zip(out.coarse, x.T, strict=True)]
    out.tables = [np.zeros(len(e) + 1) for e in out.edges]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(out.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(at[j], g, len(table)), np.bincount(at[j], h, len(table)), leaves)
            table += step
            f += step[at[j]]
    g, h = slopes()

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = len(out.coarse[i]) + 1, len(out.coarse[j]) + 1
        flat = wide[i] * shape[1] + wide[j]
        return np.bincount(flat, g, shape[0] * shape[1]).reshape(shape), np.bincount(flat, h, shape[0] * shape[1]).reshape(shape)

    ranked = sorted(((_quadrants(*sums(*p))[0], p) for p in combinations(range(x.shape[1]), 2)), key=lambda v: (-v[0], v[1]))
    out.pairs = {p: np.zeros((len(out.coarse[p[0]]) + 1, len(out.coarse[p[1]]) + 1)) for gain, p in ranked[:n_pairs] if gain > 0}
    for _ in range(pair_rounds):
        for (i, j), table in out.pairs.items():
            g, h = slopes()
            step = rate * _quadrants(*sums(i, j))[1]
            table += step
            f += step[wide[i], wide[j]]
    return out


def score(model: Additive, features: dict[str, Column]) -> Column:
    """The score of feature columns, by name; a feature that is null counts as 0."""

    @F.pandas_udf("double")
    def udf(row: pd.DataFrame) -> pd.Series:
        return pd.Series(model.score(row[model.names].to_numpy(np.float64)))

    return udf(F.struct(*[features[n].alias(n) for n in model.names]))
