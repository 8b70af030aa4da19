"""Quality rules as a learned decision list.

Sequential covering learns what is rejected: a rule is grown on part of the labelled rows, one threshold condition after
the other by information gain, then pruned from its end on the rest, where it must stay precise; the rows it covers
leave, and the next rule is grown, until no rule is precise enough. The ordered list becomes one conditional expression.

Defined results: without labelled rows there are no rules and everything that passes the base rule is kept; null and
empty texts have no words and fail the base rule; a condition on a null feature does not hold; equal rows get equal
verdicts; an empty table gives no rows. Ties between conditions go to the first feature, then the smaller cut.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shortest text in words, and largest percentage of words in repeated 3-word windows, of the fixed base rule.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


@dataclass(frozen=True)
class Condition:
    """``feature > cut`` if above, else ``feature <= cut``."""

    feature: str
    above: bool
    cut: float

    def holds(self, rows: pd.DataFrame) -> np.ndarray:
        v = rows[self.feature].to_numpy(np.float64)
        return v > self.cut if self.above else v <= self.cut

    def column(self, features: dict[str, Column]) -> Column:
        v = features[self.feature]
        return v > F.lit(self.cut) if self.above else v <= F.lit(self.cut)


Rule = tuple[Condition, ...]


def _grow(x: np.ndarray, y: np.ndarray, names: list[str], cuts: list[np.ndarray], most: int) -> Rule:
    live, rule = np.ones(len(y), bool), []
    while len(rule) < most and (~y[live]).any():
        p, n = y[live].sum(), (~y[live]).sum()
        old, top = np.log2(p / (p + n)), (0.0, None)
        for j, name in enumerate(names):
            at = np.searchsorted(cuts[j], x[live, j], "left")  # value <= cuts[k] as of k = at
            good, bad = np.cumsum(np.bincount(at, y[live], len(cuts[j]) + 1))[:-1], np.cumsum(np.bincount(at, ~y[live], len(cuts[j]) + 1))[:-1]
            for above, a, b in ((False, good, bad), (True, p - good, n - bad)):
                gain = np.where(a > 0, a * (np.log2(np.maximum(a, 1e-9) / np.maximum(a + b, 1e-9)) - old), 0)
                if len(gain) and gain.max() > top[0] + 1e-12:
                    k = int(gain.argmax())
                    # halfway to the next value seen, so that new values near the cut fall to the nearer side
                    next_ = x[x[:, j] > cuts[j][k], j].min(initial=np.inf)
                    top = (float(gain[k]), Condition(name, above, float(cuts[j][k] if np.isinf(next_) else (cuts[j][k] + next_) / 2)))
        if top[1] is None:
            break
        rule.append(top[1])
        v = x[:, names.index(top[1].feature)]
        live &= v > top[1].cut if top[1].above else v <= top[1].cut
    return tuple(rule)


def _covered(rule: Rule, rows: pd.DataFrame) -> np.ndarray:
    return np.logical_and.reduce([c.holds(rows) for c in rule]) if rule else np.ones(len(rows), bool)


def learn(rows: pd.DataFrame, names: list[str], precision: float = 0.97, least: int = 8, most_conditions: int = 4, most_rules: int = 24, quantiles: int = 64) -> list[Rule]:
    """Ordered rules that reject, from columns ``names``, ``label`` (0: reject) and ``doc_id``; none without labelled rows.

    Every third row (by a hash of its id) prunes, the rest grow. A rule stays if, pruned, at least ``precision`` of
    the rows that it covers are labelled 0 (both in growing and pruning rows) and it covers ``least`` rows.
    """
    out: list[Rule] = []
    rest, side = rows.reset_index(drop=True), (rows["doc_id"].to_numpy(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(3) == 0
    while len(out) < most_rules:
        y = rest["label"].to_numpy() == 0
        if y[~side].sum() < 2:
            break
        x = rest.loc[~side, names].to_numpy(np.float64)
        cuts = [np.unique(np.quantile(v, np.linspace(0, 1, quantiles + 1)[:-1], method="lower")) for v in x.T]
        rule = _grow(x, y[~side], names, cuts, most_conditions)
        if not rule:
            break
        prune, yp = rest[side], y[side]

        def worth(r: Rule, prune: pd.DataFrame = prune, yp: np.ndarray = yp) -> float:
            c = _covered(r, prune)
            return (yp[c].sum() - (~yp[c]).sum()) / max(c.sum(), 1)

        def precise(r: Rule, rest: pd.DataFrame = rest, y: np.ndarray = y, side: np.ndarray = side) -> bool:
            c = _covered(r, rest)
            return c.sum() >= least and y[c].mean() >= precision and (not (c & side).any() or y[c & side].mean() >= precision)

        shorter = [rule[:k] for k in range(1, len(rule) + 1) if precise(rule[:k])]
        if not shorter:
            break
        rule = max(shorter, key=lambda r: (worth(r), -len(r)))
        covered = _covered(rule, rest)
        out.append(rule)
        rest, side = rest[~covered].reset_index(drop=True), side[~covered]
    return out


def base_failed(col: Callable[[str], Column] = F.col) -> Column:
    return (col("n_words") < MIN_WORDS) | (100 * col("n_repeat_words") > MAX_REPEAT_PERCENT * col("n_words"))


def kept(rules: list[Rule], features: dict[str, Column]) -> Column:
    """False where the first rule that holds rejects, true where none holds: one CASE expression in the list's order."""
    out: Column | None = None
    for rule in rules:
        test = F.lit(True)
        for c in rule:
            test = test & c.column(features)
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def describe(rules: list[Rule]) -> list[str]:
    return [" and ".join(f"{c.feature} {'>' if c.above else '<='} {c.cut:.6g}" for c in rule) for rule in rules]
