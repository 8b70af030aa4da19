"""Language identification with language-bitmask n-gram filters.

Learning counts the letter trigrams (with word edges) of a bounded sample of each language and puts the most frequent
ones that are its own (not only quoted in it) into a bit-sliced Bloom filter: every position holds one bit per language, so the AND over the positions of an
n-gram is the mask of *all* languages that contain it. A text is scored by the popcount of each language over its
n-grams; the popcounts are corrected for the false positives that the filter's fill implies, and the largest decides.

Defined results: a null text and a text without letters are ``und`` with score 0; without any learned language (such as
from an empty table) every text is ``und``. Equal corrected counts go to the language with more learned documents, then
to the smaller name. Repeated rows are counted and predicted each; very long texts are read whole, a piece at a time,
with the same result as in one piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import CHUNK_CHARS, checkpoint, groups, share

UNDETERMINED = "und"
#: Bounds of the learning: documents of one language, and n-grams of one language in the filter.
SAMPLE_DOCS, GRAMS = 10_000, 2048
#: Share of an n-gram's largest relative frequency that it must have in a language to count as one of that language's:
#: passages in a foreign language put the n-grams of one language into the documents of another.
OWN_SHARE = 0.05
#: Positions of the filter (a power of two) and positions of one n-gram.
POSITIONS_LOG2, HASHES = 15, 3
#: Odd multipliers of the hash positions.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def lowered(text: str) -> str:
    """The text in lower case, a character for each character, whatever stands beside it."""
    # the only characters whose lower case is longer, or depends on the end of a word
    return text.replace("\u0130", "i").replace("\u03a3", "\u03c3").lower()


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The trigram codes of a text around each letter, and the place of each; what is no letter counts as an edge."""
    cp = np.frombuffer(("\n" + lowered(text) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    cp = np.where(_letters()[cp], cp, 0).astype(np.uint64)
    at = np.flatnonzero(cp[1:-1])
    return (cp[at] << np.uint64(42)) | (cp[at + 1] << np.uint64(21)) | cp[at + 2], at


def pieces(text: str, limit: int = CHUNK_CHARS) -> Iterator[np.ndarray]:
    """The trigram codes of a text of any length, a bounded piece at a time; pieces overlap by the context of one letter."""
    if len(text) <= limit:
        yield grams(text)[0]
        return
    for lo in range(0, len(text), limit):
        part = text[max(0, lo - 1) : lo + limit + 1]
        codes, at = grams(part)
        first, last = int(lo > 0), len(part) - int(lo + limit < len(text))
        yield codes[(at >= first) & (at < last)]


@dataclass
class Filters:
    """Bit-sliced Bloom filters: ``words[w][p]`` has a bit for each of 64 languages at position p."""

    languages: list[str]
    words: list[np.ndarray] = field(default_factory=list)
    rates: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @classmethod
    def build(cls, grams_by_language: dict[str, np.ndarray], order: list[str]) -> Filters:
        out = cls(order)
        fills = []
        for base in range(0, len(order), 64):
            block = order[base : base + 64]
            bits = next(b for b in (8, 16, 32, 64) if len(block) <= b)
            word = np.zeros(1 << POSITIONS_LOG2, f"uint{bits}")
            for j, name in enumerate(block):
                for p in positions(grams_by_language[name]):
                    word[p] |= word.dtype.type(1 << j)
                fills.append(np.count_nonzero(word & word.dtype.type(1 << j)) / word.size)
            out.words.append(word)
        out.rates = np.array(fills) ** HASHES
        return out

    def popcounts(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Hits of each language (columns) for each text (rows); starts: where the codes of each text begin."""
        at = positions(codes)
        columns = []
        for w, word in enumerate(self.words):
            mask = word[at[0]]
            for p in at[1:]:
                mask &= word[p]
            for j in range(min(64, len(self.languages) - 64 * w)):
                hit = np.concatenate(([0], np.cumsum((mask >> word.dtype.type(j)) & word.dtype.type(1), dtype=np.int64)))
                columns.append(hit[starts[1:]] - hit[starts[:-1]])
        return np.stack(columns, 1) if columns else np.zeros((len(starts) - 1, 0), np.int64)

    def corrected(self, hits: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Expected true hits: of the n-grams that are not in a language, the share ``rates`` hits by chance."""
        return np.clip((hits - n[:, None] * self.rates) / np.maximum(1 - self.rates, 1e-9), 0, n[:, None])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        for lo, hi in groups((len(t or "") for t in texts)):
            parts = [np.concatenate(list(pieces(t))) if t else np.zeros(0, np.uint64) for t in texts[lo:hi]] if hi - lo > 1 or len(texts[lo] or "") <= CHUNK_CHARS else None
            if parts is None:  # one very long text, a piece at a time
                hits, n = np.zeros((1, len(self.languages)), np.int64), np.zeros(1, np.int64)
                for codes in pieces(texts[lo]):
                    hits += self.popcounts(codes, np.array([0, len(codes)]))
                    n += len(codes)
            else:
                n = np.array([len(p) for p in parts])
                hits = self.popcounts(np.concatenate(parts), np.concatenate(([0], np.cumsum(n))))
            true = self.corrected(hits, n)
            best = true.argmax(1)
            for i in np.flatnonzero(n):
                names[lo + i], scores[lo + i] = self.languages[best[i]], true[i, best[i]] / n[i]
        return names, scores


def positions(codes: np.ndarray) -> list[np.ndarray]:
    mixed = codes ^ (codes >> np.uint64(29))
    return [(mixed * np.uint64(m)) >> np.uint64(64 - POSITIONS_LOG2) for m in MULTIPLIERS[:HASHES]]


def learn(docs: DataFrame, where: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS, top: int = GRAMS) -> Filters:
    """Filters from the rows that hold ``where``; about ``sample_docs`` documents of each language are counted, whole."""
    rows = docs.where(where & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    order = sorted(sizes, key=lambda x: (-sizes[x], x))
    if not order:
        return Filters([])
    part = F.create_map(*[F.lit(x) for name in order for x in (name, min(1.0, sample_docs / sizes[name]))])
    counted = rows.where(share(F.element_at(part, F.col("lang")), F.col("id"), F.col("text"))).select("lang", "text").mapInPandas(_count, "lang string, gram long, n long")
    sums = checkpoint(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = sums.groupBy("lang").agg(F.sum("n").alias("total"))  # a row per language
    shares = sums.join(totals, "lang").withColumn("share", F.col("n") / F.col("total"))
    own = shares.withColumn("largest", F.max("share").over(Window.partitionBy("gram"))).where(F.col("share") >= OWN_SHARE * F.col("largest"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    kept = own.withColumn("at", F.row_number().over(first)).where(F.col("at") <= top).select("lang", "gram").toPandas()
    by = {name: kept.loc[kept["lang"] == name, "gram"].to_numpy(np.int64).astype(np.uint64) for name in order}
    return Filters.build(by, order)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of each batch; a batch is bounded, and so is what it yields."""
    for batch in batches:
        for name, texts in batch.groupby("lang")["text"]:
            values = texts.tolist()
            sums: dict[int, int] = {}
            for lo, hi in groups(map(len, values)):
                for codes in (c for t in values[lo:hi] for c in pieces(t)) if hi - lo == 1 else [np.concatenate([c for t in values[lo:hi] for c in pieces(t)])]:
                    found, n = np.unique(codes, return_counts=True)
                    for g, k in zip(found.tolist(), n.tolist(), strict=True):
                        sums[g] = sums.get(g, 0) + k
            yield pd.DataFrame({"lang": name, "gram": np.fromiter(sums, np.int64, len(sums)), "n": np.fromiter(sums.values(), np.int64, len(sums))})


def predict(text: Column, filters: Filters) -> Column:
    """A struct (lang_pred, score) of a text column."""

    @F.pandas_udf("lang_pred string, score double")
    def udf(texts: pd.Series) -> pd.DataFrame:
        names, scores = filters.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return udf(text)
