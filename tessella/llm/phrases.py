"""Phrases that hold together: counted by suffix automata of shards, scored by their weakest cut.

Texts are packed into shards, each with its own vocabulary. A first exchange counts words over all shards and tells each
shard which of its words are frequent: a phrase cannot be frequent if one of its words is not. A second one adds up what
the automata of the shards have counted.

The automaton of a shard holds all its pieces of text, generalised to many strings, and is bounded in depth. Its states
are contexts that end at some word, from one word up to the bound; the suffix link of a state drops its first word. The
links are the suffix tree of the reversed text, so sorting reversed contexts builds them, depth by depth. Each word is an
end position of its longest context, and counts of end positions run along the links from the deepest states up.

Over the corpus, a phrase that is frequent has a frequent suffix (its link) and a frequent prefix (its stem). The longer
phrase that holds another one most often is therefore longer by one word, and has that one as its link or its stem.

Defined results: a null language is ``und``; null and empty texts have no words; repeated rows count each; a language
without a frequent phrase has no rows, nor has an empty table; very long texts are shards of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import Stored, groups
from tessella.operators.compare import before

#: Bytes of text in a shard, unless a single text is longer.
SHARD = 1 << 23
#: Words of the corpus for each bucket of phrases that is added up.
BUCKET = 100_000
#: What ends a piece of text, and what stands between words.
MARKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)], _KIND[list(MARKS)] = 1, 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words(NamedTuple):
    """The words of many texts: the number of each in a vocabulary, whether a piece begins with it, and its text."""

    code: np.ndarray
    begins: np.ndarray
    text: np.ndarray
    vocabulary: pa.Array


def words(texts: list[str]) -> Words:
    """All words of the texts in a row, with A-Z in lower case."""
    data = [t.encode() for t in texts]
    body = _LOWER[np.frombuffer(b"\n".join([*data, b""]), np.uint8)]
    kind = _KIND[body]
    letter = kind == 0
    edge = np.diff(letter.view(np.int8), prepend=0)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # a mark ends every text
    marks = np.cumsum(kind == 2, dtype=np.int64)[starts]
    offsets = np.concatenate([[0], np.cumsum(stops - starts)])
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body[letter])]).dictionary_encode()
    text = np.searchsorted(np.cumsum([len(d) + 1 for d in data]), starts, "right")
    return Words(found.indices.to_numpy().astype(np.int64), np.diff(marks, prepend=-1) != 0, text, found.dictionary.cast(pa.large_string()))


class States(NamedTuple):
    """The states of one depth: the place of a word where each ends, its end positions counted, and its suffix link."""

    end: np.ndarray
    count: np.ndarray
    link: np.ndarray


def suffix_automaton(ids: np.ndarray, begins: np.ndarray, depth: int) -> list[States]:
    """The states of each depth, from one word on, for pieces of words; negative ids are in no phrase."""
    n = len(ids)
    inside = ids >= 0
    fresh = begins | ~inside | np.concatenate([[True], ~inside[:-1]]) if n else np.zeros(0, bool)
    place = np.arange(n)
    reach = np.where(inside, place - np.maximum.accumulate(np.where(fresh, place, 0)) + 1, 0) if n else place
    at, built, last = np.zeros(n, np.int64), [], np.zeros(n, np.int64)
    for d in range(1, depth + 1):
        here = np.flatnonzero(reach >= d)
        # a context of depth d: its last word, and the context of depth d - 1 that ends before it
        key = ids[here] if d == 1 else at[here] * (1 + int(last.max(initial=0))) + last[here - 1]
        _, first, state = np.unique(key, return_index=True, return_inverse=True)
        end = here[first]
        link = last[end] if d > 1 else np.full(len(end), -1)
        now = np.zeros(n, np.int64)
        now[here] = state
        if d == 1:
            at = now
        last = now
        longest = np.minimum(reach[here], depth) == d
        built.append(States(end, np.bincount(state[longest], minlength=len(end)), link))
    for d in range(depth - 1, 0, -1):
        np.add.at(built[d - 1].count, built[d].link, built[d].count)
    return built


def _shards(docs: DataFrame, lang: str, text: str, size: int) -> Stored:
    """A row for each shard: its number, its vocabulary with counts, and its words, the bits turned where a piece begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).tolist()
            for lo, hi in groups(lengths, size):
                part = batch.slice(lo, hi - lo)
                found = words([t or "" for t in part.column("text").to_pylist()])
                of = part.column("lang").dictionary_encode()
                key = of.indices.to_numpy()[found.text].astype(np.int64) * max(1, len(found.vocabulary)) + found.code
                known, code, n = np.unique(key, return_inverse=True, return_counts=True)
                langs, texts = of.dictionary.take(pa.array(known // max(1, len(found.vocabulary)))), found.vocabulary.take(pa.array(known % max(1, len(found.vocabulary)))).cast(pa.string())
                listed = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (langs, texts, pa.array(n), pa.array(np.where(found.begins, ~code, code).astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(listed, ["langs", "words", "counts", "sequence"])

    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    made = rows.mapInArrow(run, "langs array<string>, words array<string>, counts array<long>, sequence array<int>")
    return Stored(made.withColumn("shard", F.monotonically_increasing_id()))


def _phrases(shards: DataFrame, depth: int, buckets: int) -> DataFrame:
    """What the automata count, dealt by phrase: (bucket, width, ids, counts), packed by shard. shards has ``known``: (code, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sequence, known = (batch.column(c)[k].values for c in ("sequence", "known"))
                sequence = sequence.to_numpy(zero_copy_only=False)
                begins = sequence < 0
                code = np.where(begins, ~sequence, sequence)
                ids = np.full(int(code.max(initial=-1)) + 1, -1, np.int64)
                ids[known.field("code").to_numpy()] = known.field("id").to_numpy()
                ids = ids[code]
                for width, states in enumerate(suffix_automaton(ids, begins, depth), 1):
                    if width > 1 and len(states.end):
                        spelled = np.stack([ids[states.end - width + 1 + j] for j in range(width)], 1)
                        yield _dealt(spelled, states.count, buckets)

    return shards.select("sequence", "known").mapInArrow(run, "bucket int, width int, ids binary, counts binary")


def _dealt(ids: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Phrases and counts by bucket, ids as 32 bits where they fit."""
    mixed = np.zeros(len(ids), np.uint64)
    for j in range(ids.shape[1]):
        mixed = (mixed ^ ids[:, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
    bucket = (mixed % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ids, counts, bucket = ids[order], counts[order], bucket[order]
    kind = np.uint32 if ids.max(initial=0) < 1 << 32 else np.uint64
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    spans = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(ids)], strict=True))
    packed = [np.ascontiguousarray(ids[lo:hi].T.astype(kind)).tobytes() for lo, hi in spans]  # column by column, which packs well
    columns = [pa.array(bucket[cuts].astype(np.int32)), pa.array([ids.shape[1]] * len(spans), pa.int32()), pa.array(packed, pa.binary()), pa.array([counts[lo:hi].astype(np.uint32).tobytes() for lo, hi in spans], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "width", "ids", "counts"])


def _summed(table: pa.Table, least: int) -> pa.Table:
    """The phrases of a bucket and width that are frequent over all shards: (ids, f)."""
    width, parts, counts = table["width"][0].as_py(), [], []
    for data, n in zip(table["ids"], table["counts"], strict=True):
        n = np.frombuffer(n.as_buffer(), np.uint32)
        data = np.frombuffer(data.as_buffer(), np.uint8)
        kind = np.uint32 if len(data) == 4 * width * len(n) else np.uint64
        parts.append(data.view(kind).reshape(width, len(n)).astype(np.int64))
        counts.append(n)
    ids, counts = np.concatenate(parts, 1), np.concatenate(counts).astype(np.int64)
    order = np.lexsort(ids[::-1])
    ids, counts = ids[:, order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], (ids[:, 1:] != ids[:, :-1]).any(0)]))
    f = np.add.reduceat(counts, first)
    kept = f >= least
    flat = pa.array(np.ascontiguousarray(ids[:, first[kept]].T).ravel())
    return pa.table({"ids": pa.ListArray.from_arrays(pa.array(np.arange(0, width * kept.sum() + 1, width, dtype=np.int32)), flat), "f": pa.array(f[kept])})


def _spelled(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """rows with their language and phrase."""
    each = rows.select("*", F.posexplode("ids").alias("at", "id")).join(vocabulary.select("id", "lang", "word"), "id")
    keys = rows.columns
    listed = each.groupBy(*keys).agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("listed"))
    return listed.withColumn("phrase", F.array_join(F.transform("listed", lambda x: x["word"]), " ")).drop("listed")


def _best(rows: DataFrame, top: int) -> DataFrame:
    """The first rows of each language; those of a part of the rows first, then of some parts, so that no task ranks a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    within = rows.withColumn("_part", F.spark_partition_id())
    for keys in (["lang", "_part"], ["lang", F.col("_part") % 256], ["lang", F.col("_part") % 16], ["lang"]):
        within = within.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return within.drop("_part")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1,000,000 a a / (left right)), exact: numbers of up to 38 digits."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = 10, most_words: int = 3, top: int = 2000, share: int = 50, shard: int = SHARD) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Phrases have 2 to ``most_words`` words and are found ``least`` times or more. They are scored at their weakest cut,
    and dropped where a longer phrase that holds them is found in ``share`` percent of their places or more.
    """
    stored = _shards(docs, lang, text, shard)
    listed = stored.rows.select("shard", F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("code", "x")).select("shard", "code", F.col("x.langs").alias("lang"), F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    totals = Stored(listed.groupBy("lang", "word").agg(F.sum("n").alias("f")))
    sizes = totals.rows.groupBy("lang").agg(F.sum("f").alias("n"))
    # numbers without gaps: those of each part of the rows follow those of the parts before
    numbered = Stored(totals.rows.where(F.col("f") >= least).withColumn("_id", F.monotonically_increasing_id()))
    parts = numbered.rows.select("lang", "word", "f", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    vocabulary = parts.join(F.broadcast(before(parts, F.lit(1))), "_part").select("lang", "word", "f", (F.col("_before") + F.col("_at")).alias("id"))  # as many sums as parts

    own = listed.join(vocabulary.select("lang", "word", "id"), ["lang", "word"]).groupBy("shard").agg(F.collect_list(F.struct("code", "id")).alias("known"))
    buckets = 16 + (sizes.agg(F.sum("n")).first()[0] or 0) // BUCKET
    dealt = _phrases(stored.rows.select("shard", "sequence").join(own, "shard"), most_words, buckets)
    frequent = Stored(dealt.groupBy("bucket", "width").applyInArrow(lambda t: _summed(t, least), "ids array<long>, f long"))

    parts_of = vocabulary.select(F.array("id").alias("ids"), "f").unionByName(frequent.rows)
    cuts = frequent.rows.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.slice("ids", 1, F.col("k")).alias("left"), F.slice("ids", F.col("k") + 1, F.size("ids")).alias("right"))
    cuts = cuts.join(parts_of.select(F.col("ids").alias("left"), F.col("f").alias("l")), "left").join(parts_of.select(F.col("ids").alias("right"), F.col("f").alias("r")), "right")
    weakest = cuts.groupBy("ids", "a").agg(F.min(F.struct(score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("w"))

    longer = frequent.rows.where(F.size("ids") > 2)
    link, stem = F.slice("ids", 2, F.size("ids")), F.slice("ids", 1, F.size("ids") - 1)
    held = longer.select(F.explode(F.array(link, stem)).alias("ids"), "f").groupBy("ids").agg(F.max("f").alias("held"))
    free = weakest.join(held, "ids", "left").where(F.coalesce(100 * F.col("held") < share * F.col("a"), F.lit(True)))
    ranked = _best(_spelled(free.select("ids", "a", "w.l", "w.r", "w.score"), vocabulary).drop("ids"), top)
    out = Stored(ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
    for done in (stored, totals, numbered, frequent):
        done.drop()
    return out.rows
