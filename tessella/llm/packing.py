"""Best-fit packing of token sequences by the sum of squares.

Documents become token ids with an end id. Longer ones than a sequence are cut into full pieces, the first piece being
what is left over. Pieces are packed with the sum-of-squares rule: N(g) is the number of open sequences with a gap of
g tokens, and each piece goes where the sum of all N(g) squared becomes smallest, be it a new sequence. That keeps the
gaps spread over many sizes, so that later pieces find gaps which they fill exactly.

Sequences that this fills to the last token are closed. On lengths as they come (few hundred pieces of each length in a
shard) the rule alone leaves about 4 % of the space open, so the pieces of all other sequences are packed anew, largest
first, each into the smallest gap that holds it, which leaves about 1 %.

Pieces are packed in shards of bounded size, in parallel; a shard costs a few sequences at most.

Defined results: null and empty texts are the end id alone; repeated documents, and rows without an id, are packed
each; very long texts are cut into as many pieces as they need; an empty table gives no pieces.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm.common import checkpoint, groups

CAPACITY, END_ID = 1024, 2
#: Pieces of a shard, about.
SHARD = 40_000
#: The pattern of byte-level pre-tokens (a fixed value of such vocabularies).
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters that every Unicode version takes for the same kinds; texts with others go through the tokenizer itself.
_PLAIN = re.compile(r"[^\n\r\t\x20-\x7e\xa1-ɏ‐-‧‰-⁞]")


class Encoder:
    """The ids of a tokenizer file. Where its merges are ranks in the order of their ids, the faster rank engine does it.

    Texts that hold an added token, such as an end mark, go through the tokenizer itself, which gives that token's id.
    """

    def __init__(self, path: str):
        self.slow = Tokenizer.from_file(path)
        self.slow.no_padding(), self.slow.no_truncation()
        self.fast = None
        added = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model.get("merges", [])]
        vocab = model.get("vocab", {})
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not spec.get("normalizer")
        if model.get("type") == "BPE" and plain and not model.get("ignore_merges") and len(vocab) == 256 + len(merges) and all(vocab[a + b] == 256 + i for i, (a, b) in enumerate(merges)):
            shown = _shown_bytes()
            ranks = {bytes(shown[c] for c in token): i for token, i in vocab.items()}
            self.fast = tiktoken.Encoding("vocabulary", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is not None and not _PLAIN.search(text) and not (self.added and self.added.search(text)):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


def _shown_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if printable, else shifted past 255."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % capacity or capacity
    return [(0, first), *((lo, capacity) for lo in range(first, n, capacity))]


def tokenise(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """The pieces of all documents: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (array<int>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in groups((len(t or "") for t in texts)):
                rows, kept = [], []
                for k in range(lo, hi):
                    ids = np.array([*enc.encode(texts[k] or ""), end_id], "<u4")
                    data = memoryview(ids.tobytes())
                    for piece, (a, n) in enumerate(cut(len(ids), capacity)):
                        rows.append((k, piece, a, n, zlib.crc32(data[4 * a : 4 * (a + n)])))
                        if with_ids:
                            kept.append(pa.array(ids[a : a + n].view(np.int32)))
                table = np.array(rows, np.int64)
                columns = [batch.column("doc_id").take(pa.array(table[:, 0])), pa.array(table[:, 1].astype(np.int32)), *(pa.array(table[:, j]) for j in (2, 3, 4))]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, kept)], dtype=np.int32)), pa.concat_arrays(kept)))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of the pieces, placed in the given order."""
    n, open_at = np.zeros(capacity + 1, np.int64), [[] for _ in range(capacity + 1)]
    where, offset, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    far = np.int64(1) << 60
    for k, size in enumerate(lengths.tolist()):
        if size == capacity:
            where[k], offset[k], made = made, 0, made + 1
            continue
        # Taking a gap g for one of g - size changes the sum by 2 (N(g - size) - N(g) + 1), an exact fit by 1 - 2 N(g).
        change = 2 * (n[: capacity - size] - n[size:capacity] + 1)
        change[0] = 1 - 2 * n[size]
        change[n[size:capacity] == 0] = far
        g = size + int(change.argmin())
        if change[g - size] <= 2 * n[capacity - size] + 1:
            b = open_at[g].pop()
            n[g] -= 1
        else:
            g, b, made = capacity, made, made + 1
        where[k], offset[k] = b, capacity - g
        if g > size:
            open_at[g - size].append(b)
            n[g - size] += 1
    return where, offset


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of the pieces, each in the given order placed into the smallest gap that holds it."""
    gaps: list[tuple[int, int]] = []
    where, offset, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for k, size in enumerate(lengths.tolist()):
        i = bisect.bisect_left(gaps, (size, -1))
        if i < len(gaps):
            gap, b = gaps.pop(i)
        else:
            gap, b, made = capacity, made, made + 1
        where[k], offset[k] = b, capacity - gap
        if gap > size:
            bisect.insort(gaps, (gap - size, b))
    return where, offset


def place(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces in decreasing order: by the sum of squares, what that leaves unfilled by best fit."""
    where, offset = sum_of_squares(lengths, capacity)
    if len(lengths):
        open_ = np.bincount(where, lengths)[where] < capacity
        again, at = best_fit(lengths[open_], capacity)
        where[open_], offset[open_] = again + where.max() + 1, at
    return where, offset


def _pack_table(table: pa.Table, capacity: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A shard in packing order with (sequence, offset): larger pieces first, then by row, so that a repeated task gives the same."""
    length, row = (table.column(c).to_numpy() for c in ("length", "row"))
    order = np.lexsort((row, -length))
    return table.take(pa.array(order)), *place(length[order], capacity)


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """pieces (as of ``tokenise``, computed once) with sequence_id and offset; full pieces are sequences of their own.

    Pieces are numbered before they are checkpointed, so that the numbers last, and dealt to shards in turn, from another
    one in each partition: repeated documents spread over all shards, and shards are of equal size.
    """
    given = checkpoint(pieces.withColumn("row", F.monotonically_increasing_id()))
    alone = given.where(F.col("length") >= capacity).withColumns({"offset": F.lit(0).cast("long"), "sequence_id": -1 - F.col("row")})
    rest = given.where(F.col("length") < capacity)
    shards = max(1, -(-rest.count() // shard))
    dealt = rest.withColumn("shard", F.pmod(F.pmod("row", F.lit(shards)) + F.pmod(F.xxhash64(F.shiftright("row", 33)), F.lit(shards)), F.lit(shards)).cast("int"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table, where, offset = _pack_table(table.drop_columns(["shard"]), capacity)
        return table.append_column("offset", pa.array(offset)).append_column("sequence_id", pa.array(where + (key[0].as_py() << 36)))

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    part = dealt.groupBy("shard").applyInArrow(run, f"{shape}, offset long, sequence_id long")
    return part.unionByName(alone).select(*pieces.columns, "sequence_id", "offset")
