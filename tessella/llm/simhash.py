"""Near duplicates by SimHash, with candidates from pigeonring chains.

A fingerprint has 64 bits, cut into a ring of four segments of 16. If two fingerprints differ in at most three bits,
there is a segment from which every chain of consecutive segments keeps a proportional budget: 1 segment at most 3/4,
2 at most 6/4, 3 at most 9/4, all four at most 3 differing bits. So the first segment of the chain is equal and the
second differs in one bit at most, hence one half of it is equal: the eight keys (start, first segment, equal half of
the second) find every pair, with 24 selective bits each. The rest of the chain is checked before the full distance.

Only *different* fingerprints are compared, so exact copies cost one row. Within a key the members are linked by a
breadth-first search that removes what it reaches: it yields a spanning forest, never all pairs. A key with more than
``BLOCK`` fingerprints is dealt out as pairs of blocks, each a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tessella.llm.common import checkpoint

SEED, SHINGLE, DISTANCE, SEGMENTS, WIDTH = 42, 3, 3, 4, 16
#: Fingerprints of one key that are compared in one group.
BLOCK = 4096
#: Shingles whose bits are counted at once.
STEP = 1 << 16


def fingerprint(text: str | None) -> int:
    """The SimHash of one text as an unsigned number; zero without words and for null."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n, counts, digest = len(words) - SHINGLE + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for lo in range(0, n, STEP):
        part = words[lo : lo + STEP + SHINGLE - 1]
        hashes = np.array([digest(b"%b %b %b" % t, SEED) for t in zip(part, part[1:], part[2:], strict=False)], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def fingerprints(text: Column) -> Column:
    """The fingerprint of a text column as a long with the same 64 bits."""
    return _fingerprints(text)


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _keys(fp: Column) -> Column:
    """The eight chain starts of a fingerprint, as (start and half, segment and half) numbers."""
    out = []
    for i in range(SEGMENTS):
        first = F.shiftrightunsigned(fp, WIDTH * i).bitwiseAND(F.lit(0xFFFF))
        second = F.shiftrightunsigned(fp, WIDTH * ((i + 1) % SEGMENTS)).bitwiseAND(F.lit(0xFFFF))
        for j in range(2):
            half = F.shiftrightunsigned(second, 8 * j).bitwiseAND(F.lit(0xFF))
            out.append(F.lit((2 * i + j) << 24).cast("long") + first * 256 + half)
    return F.array(*out)


def _chain(x: np.ndarray, start: int) -> np.ndarray:
    """Which of the differences x keep every budget of the chain from segment ``start``; checked shortest chain first."""
    at, mask = np.arange(len(x)), 0
    for length in range(1, SEGMENTS + 1):
        mask |= 0xFFFF << (WIDTH * ((start + length - 1) % SEGMENTS))
        at = at[np.bitwise_count(x[at] & np.uint64(mask)) <= length * DISTANCE // SEGMENTS]
    return at


def link(fps: np.ndarray, start: int) -> list[tuple[int, int]]:
    """A spanning forest of the fingerprints that the chain from ``start`` links, by breadth-first search."""
    rest, edges = np.unique(fps), []
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            hit = _chain(rest ^ x, start)
            if len(hit):
                found = rest[hit]
                edges += [(int(x), int(y)) for y in found]
                front += list(found)
                rest = np.delete(rest, hit)
    return edges


def _link_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of groups (key, lo, hi) that arrive sorted; what is held is one batch and the group that goes on after it."""
    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        new = np.flatnonzero((rows[["key", "lo", "hi"]].to_numpy()[1:] != rows[["key", "lo", "hi"]].to_numpy()[:-1]).any(1)) + 1
        if not len(new):
            held = rows
            continue
        held = rows.iloc[new[-1] :]
        yield _link_groups(rows["key"].to_numpy(np.int64), rows["fp"].to_numpy(np.int64).view(np.uint64), np.concatenate(([0], new)))
    if held is not None and len(held):
        yield _link_groups(held["key"].to_numpy(np.int64), held["fp"].to_numpy(np.int64).view(np.uint64), np.array([0, len(held)]))


def _link_groups(keys: np.ndarray, fps: np.ndarray, bounds: np.ndarray) -> pd.DataFrame:
    lo, hi = bounds[:-1], bounds[1:]
    found = []
    for start in range(SEGMENTS):  # groups of two, all at once
        two = lo[(hi - lo == 2) & (keys[lo] >> 25 == start)]
        hit = two[_chain(fps[two] ^ fps[two + 1], start)]
        found.append(np.stack([fps[hit], fps[hit + 1]], 1))
    for i, j in zip(lo[hi - lo > 2].tolist(), hi[hi - lo > 2].tolist(), strict=True):
        found.append(np.array(link(fps[i:j], int(keys[i]) >> 25), np.uint64).reshape(-1, 2))
    pairs = np.concatenate(found).view(np.int64)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) that link all fingerprints ``fp`` (distinct longs) which differ in 1 to 3 bits, not every such pair.

    The pairs of a key span its components; fingerprints of one component stay connected, none else become so.
    """
    keyed = checkpoint(distinct.select("fp", F.explode(_keys(F.col("fp"))).alias("key")))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = keyed.join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") / block))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    dealt = (
        members.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .where((F.col("blocks") == 1) | (F.col("own") != F.col("other")))
        .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    )
    by = ["key", "lo", "hi"]
    return dealt.repartition(*by).sortWithinPartitions(*by).mapInPandas(_link_sorted, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of the nodes of the edges (a, b), by alternating large-star and small-star steps.

    Each step is a grouped minimum (pre-aggregated) joined back to the edges; the edge set shrinks towards stars whose
    centre is the smallest node. Every round is checkpointed; the number of rounds grows with the logarithm of the size.
    """
    current, before = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()), None
    for _ in range(rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        current = checkpoint(small.select("e.a", "e.b").where("a <> b").distinct())
        if current.isEmpty():
            break
        mark = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 999_983)).first())
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of docs as (doc_id, fp long, component_id): the smallest doc_id that is reachable over links.

    Null and empty texts have fingerprint zero and are linked like any other; repeated rows stay repeated; a null
    doc_id takes part and never is a component_id unless all ids of its component are null.
    """
    rows = checkpoint(docs.select(F.col(doc_id).cast("long").alias("doc_id"), fingerprints(F.col(text)).alias("fp")))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(nodes.select("fp")))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # a table of its own, so that a root with very many fingerprints can be split when it is joined
    least = checkpoint(named.groupBy("root").agg(F.min("first").alias("component_id")))
    by_print = named.join(least, "root").select("fp", "component_id")
    return rows.join(by_print, "fp", "left").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, n): of each component its first row by doc_id, then xxhash64 of the text, and how many rows have both.

    Rows are told apart by these two, so repeated and null ids keep their own components; null ids come last.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), fingerprints(F.col(text)).alias("fp"), F.xxhash64(F.col(text)).alias("text_hash"))
    alike = rows.groupBy("fp", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "n")).alias("first")
    nodes = checkpoint(alike.groupBy("fp").agg(first))
    roots = components(links(nodes.select("fp")))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(F.coalesce("root", "fp").alias("root"), "first.*")
    return named.groupBy("root").agg(first).select("first.doc_id", "first.text_hash", "first.n")
