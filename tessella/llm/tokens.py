"""Byte-level BPE encoding and decoding, exact, with overlapping chunks for long texts.

A text is split into pre-tokens, and each is merged by the ranks on its own; decoding concatenates the tokens' bytes.
Long texts are cut into chunks that overlap. Every chunk is pre-tokenised from its own start, wherever in a word that
falls; where a pre-token boundary of a chunk is one of the next chunk too, the two are in step from there on, because
pre-tokens depend only on what follows. The chunks are stitched at the first such boundary, encoded piece by piece in
different tasks, and put together by text. Where two chunks never get in step (a run without any boundary, longer than
the overlap), or hold characters that the encoder and this module's patterns may take for different kinds, the text is
encoded whole.

Defined results: null and empty texts have no ids; repeated rows are encoded each; ids outside the ranks are an error on
decoding; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import checkpoint, free_name, groups

CHUNK, OVERLAP = 1 << 16, 1 << 11
#: Characters of texts, and ids, that a Python worker turns over at once, unless one text has more: ids take more room than text.
STEP = 1 << 20


@lru_cache(4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file, kept by each Python worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(4)
def _compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def encode_column(text: Column, path: str, pattern: str) -> Column:
    """The ids (array<int>) of a text column, each text encoded whole."""

    @F.arrow_udf("array<int>")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoding(path, pattern)
        for texts in batches:
            # a list of Python numbers takes ten times the room of an array, so there is never more than one text's
            for lo, hi in groups(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).tolist(), STEP):
                values, ends = array("i"), [0]
                for t in texts[lo:hi]:
                    values.fromlist(enc.encode_ordinary(t.as_py() or ""))
                    ends.append(len(values))
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(values, np.int32)))

    return udf(text)


def decode_column(ids: Column, path: str, pattern: str) -> Column:
    """The bytes (binary) of a column of ids."""

    @F.arrow_udf("binary")
    def udf(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoding(path, pattern)
        for many in batches:
            ends, values = many.offsets.to_numpy(), many.values.to_numpy()
            for lo, hi in groups(np.diff(ends).tolist(), STEP):
                yield pa.array([enc.decode_bytes(values[a:b].tolist()) for a, b in zip(ends[lo:hi], ends[lo + 1 : hi + 1], strict=True)], pa.binary())

    return udf(ids)


@lru_cache(1)
def _unsure() -> np.ndarray:
    """Which code points have become or ceased to be letters, marks, numbers or spaces since an old Unicode version.

    On the rest, engines of any version agree.
    """
    old, new = unicodedata.ucd_3_2_0.category, unicodedata.category
    return np.fromiter((old(c) != new(c) and bool({old(c)[0], new(c)[0]} & set("LMNZ")) for c in map(chr, range(0x110000))), bool, 0x110000)


def boundaries(text: str, pattern: str, final: bool) -> list[int]:
    """Starts of the pre-tokens of a text, and its end; unless final, without those that more text could move; none if the
    text holds a character on whose kind the encoder may differ."""
    if _unsure()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any():
        return []
    ends = [m.end() for m in _compiled(pattern).finditer(text)]
    # A run of white space gives its last character away to a word that follows it, so the last two ends are open.
    return [0, *ends] if final else [0, *ends[:-2]]


def _long(rows: DataFrame, key: str, text: str, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(key, ids) of long texts, chunk by chunk."""
    n = F.length(text)
    cut = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int"))))
    cut = cut.select(key, "i", F.substr(F.col(text), F.col("i") * chunk + 1, F.lit(chunk + overlap)).alias("part"), (F.col("i") == F.floor((n - 1) / chunk)).alias("last"))

    @F.pandas_udf("head array<int>, tail array<int>")
    def edges(parts: pd.Series, last: pd.Series) -> pd.DataFrame:
        """Boundaries within the first ``overlap`` characters, and those from ``chunk`` on as counted from there."""
        found = [boundaries(p, pattern, bool(z)) for p, z in zip(parts, last, strict=True)]
        return pd.DataFrame({"head": [[b for b in f if b <= overlap] for f in found], "tail": [[b - chunk for b in f if b >= chunk] for f in found]})

    # dealt out evenly: the chunks of one text are pre-tokenised by many tasks
    marked = cut.repartition(key, "i").withColumn("e", edges("part", "last")).select(key, "i", "part", "last", "e.head", "e.tail")
    along = Window.partitionBy(key).orderBy("i")
    met = marked.withColumn("stop", F.when(~F.col("last"), F.array_min(F.array_intersect("tail", F.lead("head").over(along)))))
    met = met.withColumn("begin", F.when(F.col("i") == 0, F.lit(0)).otherwise(F.lag("stop").over(along)))
    piece = F.when(F.col("last"), F.substr("part", F.col("begin") + 1)).otherwise(F.substr(F.col("part"), F.col("begin") + 1, F.lit(chunk) + F.col("stop") - F.col("begin")))
    lost = F.col("begin").isNull() | (F.col("stop").isNull() & ~F.col("last")) | (F.size("head") == 0)
    encoded = met.select(key, "i", lost.alias("lost"), encode_column(F.when(~lost, piece), path, pattern).alias("ids"))
    joined = encoded.groupBy(key).agg(F.max("lost").alias("lost"), F.array_sort(F.collect_list(F.struct("i", "ids"))).alias("all"))
    return joined.select(key, "lost", F.flatten(F.transform("all", lambda x: x["ids"])).alias("ids"))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs with a column of ids (array<int>), the same as the encoding of each whole text.

    Long texts are numbered and checkpointed before they are cut, so that their pieces find them whatever is repeated.
    """
    short = docs.where(F.col(text).isNull() | (F.length(text) <= chunk)).withColumn(ids, encode_column(F.col(text), path, pattern))
    key = free_name(docs, "_row")  # of this run only
    long = checkpoint(docs.where(F.length(text) > chunk).withColumn(key, F.monotonically_increasing_id()))
    pieces = _long(long.select(key, F.col(text).alias("_text")), key, "_text", path, pattern, chunk, overlap)
    lost, found = free_name(docs, "_lost"), free_name(docs, "_ids")
    both = long.join(pieces.withColumnsRenamed({"lost": lost, "ids": found}), key)
    whole = both.withColumn(ids, F.when(F.col(lost), encode_column(F.when(F.col(lost), F.col(text)), path, pattern)).otherwise(F.col(found)))
    return short.unionByName(whole.select(*docs.columns, ids))


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with the bytes that the ids stand for; none for null."""
    # what stands between keeps the planner from encoding a second time inside the decoding function
    given = F.coalesce(F.col(ids), F.array().cast("array<int>"))
    return rows.withColumn(out, decode_column(given, path, pattern))


def digest(ids: list[int]) -> str:
    """The digest of ids as the query gives it, for tests."""
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
