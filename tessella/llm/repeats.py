"""Removal of passages that stand in an earlier document too, byte by byte, by a suffix sort with hashed comparisons.

A window is a string of WIDTH bytes. Each has an anchor: the string of GRAM bytes within it whose hash is smallest, the
first of equal ones. Equal windows have equal anchors at the same place, so only windows with one anchor can be equal,
and neighbours share theirs: there is one anchor for some 17 bytes.

* Texts are packed into blocks, which are written once, bucketed by their number, so that what is told to them comes to
  where they are and they never travel. Whole copies of a text (by SHA-256) with a smaller id lose everything and take no
  further part: what they hold, the smaller one holds.
* Blocks send the hashes of their anchors to buckets, each once, and learn which of them stand in another document too.
  What has no such anchor is unique. In a large corpus many strings of GRAM bytes come twice by chance; so for the
  others they send the hashes of both sides, from HALF bytes before the anchor to its end and from its begin to HALF
  bytes after it less one. Each window holds one of these whole, and only where that is shared can the window be.
* Blocks send the stretches of text that are left, each different one once, with its smallest document and place; where
  else a block shows it stays with the block.
* A bucket sorts the suffixes that begin at the anchors of its stretches, anchor by anchor, in a mergesort whose
  comparisons find the common extension of two suffixes by binary search over hashes of their prefixes (polynomials
  modulo 2 ** 64), and what stands before the anchors likewise, read backwards. Then it compares all neighbours byte by
  byte; were hashes ever to mislead a sort, it is done by bytes instead. Windows are equal where both what precedes the
  anchor and what follows are common as far as the window reaches. Of equal windows, all but those of the smallest
  document are marked, and the places of the marks go back to the blocks.
* Anchors of very many different stretches would fill a bucket; of these the two sides go out apart, dealt by their own
  hashes, and the windows of a side of very many stretches one by one.

Defined results: null and empty texts have nothing to remove; a null id is larger than all others; rows with one id are
one document to each other, so repeated rows keep what they share; very long texts are blocks of their own, hashed piece
by piece; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Bucketed, Stored, groups

#: Bytes of a window and of an anchor; a window holds REACH strings that could be its anchor.
WIDTH, GRAM = 50, 18
REACH = WIDTH - GRAM + 1
#: A window that begins at least so many bytes before its anchor holds these; any other holds as many after it, less one.
HALF = REACH // 2 + 1
#: Bytes of text in a block, unless a single text is longer, and places that are hashed at a time.
BLOCK, SLICE = 1 << 21, 1 << 19
#: Bytes of the corpus for each bucket.
BUCKET = 1 << 19
#: Blocks ask buckets, each of them nearly every one. Up to FEW bytes of corpus they are as small as above; beyond, both
#: grow with the root of messages that this would take, WIDER times at most, which a task still holds with ease.
FEW, WIDER = 1 << 28, 8
#: Stretches that blocks may have of an anchor before its sides are dealt apart, and of a side before its windows are dealt one by one.
HOT = 1000
#: Buckets of the table of blocks at most.
MOST = 50_000
LAST = np.int64((1 << 63) - 1)
_BASE = 0x9E3779B97F4A7C15


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    both = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        each = np.full(n, base, np.uint64)
        each[0] = 1
        both.append(np.multiply.accumulate(each))
    return both[0], both[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def prefixes(data: np.ndarray) -> np.ndarray:
    """Sums of bytes times powers: the hash of data[i:j] is (out[j] - out[i]) times the inverse power i."""
    power = _powers(1 << max(20, len(data).bit_length()))[0]
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=out[1:])
    return out


def _hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return (prefix[stop] - prefix[start]) * _powers(1 << max(20, (len(prefix) - 1).bit_length()))[1][start]


class Runs(NamedTuple):
    """Windows in a row with one anchor: the first, how many, the anchor's hash and place after the first, the hashes of all their text and of the anchor's sides (zero where no window needs the side)."""

    start: np.ndarray
    count: np.ndarray
    anchor: np.ndarray
    place: np.ndarray
    text: np.ndarray
    before: np.ndarray
    after: np.ndarray


def runs(body: np.ndarray, ends: np.ndarray) -> Runs:
    """The runs of all texts of a block, which end at ``ends``; windows never reach over an end."""
    found = [_runs(body[lo : lo + SLICE + WIDTH - 1], ends[np.searchsorted(ends, lo, "right") : np.searchsorted(ends, lo + SLICE + WIDTH) + 1] - lo, lo) for lo in range(0, max(1, len(body)), SLICE)]
    return Runs(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _runs(data: np.ndarray, ends: np.ndarray, lo: int) -> Runs:
    n = len(data) - WIDTH + 1
    if n <= 0:
        return Runs(*(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.int64, np.uint64, np.uint64, np.uint64)))
    prefix = prefixes(data)
    gram = _mixed((prefix[GRAM:] - prefix[:-GRAM]) * _powers(1 << max(20, len(data).bit_length()))[1][: len(data) - GRAM + 1])
    least, wide = gram, 1
    while 2 * wide <= REACH:
        least, wide = np.minimum(least[:-wide], least[wide:]), 2 * wide
    least = np.minimum(least[:n], least[REACH - wide : REACH - wide + n])
    over = np.zeros(len(data) + WIDTH + 1, np.int64)  # windows that reach over an end
    np.add.at(over, np.clip(ends - WIDTH + 1, 0, n), 1)
    np.add.at(over, np.clip(ends, 0, n), -1)
    sound = np.cumsum(over)[:n] == 0
    fresh, falls = sound.copy(), np.zeros(n, bool)
    falls[1:] = least[1:] < least[:-1]
    fresh[1:] &= ~sound[:-1] | falls[1:] | (gram[: n - 1] == least[:-1])
    start = np.flatnonzero(fresh)
    breaks = np.append(np.flatnonzero(fresh | ~sound), n)
    count = breaks[np.searchsorted(breaks, start) + 1] - start
    place = np.full(len(start), REACH - 1)
    sought = np.flatnonzero(~falls[start])
    place[sought] = np.lib.stride_tricks.sliding_window_view(gram, REACH)[start[sought]].argmin(1)
    at, sides = start + place, np.zeros((2, len(start)), np.uint64)
    for side, has, first, n in zip(sides, _has_sides(count, place), (at - HALF, at), (HALF + GRAM, HALF + GRAM - 1), strict=True):
        side[has] = _mixed(_hash(prefix, first[has], first[has] + n))
    return Runs(start + lo, count, least[start], place, _hash(prefix, start, start + count + WIDTH - 1), *sides)


def _has_sides(count: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a run has windows that hold the side before its anchor, and windows that hold the one after."""
    return place >= HALF, place - count + 1 < HALF


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[k], starts[k] + 1, ... (counts[k] of them) for each k in turn."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


class Block(NamedTuple):
    """Texts in a row, where each ends, and the ids of their documents."""

    body: np.ndarray
    ends: np.ndarray
    ids: np.ndarray


def _blocks(docs: DataFrame, doc_id: str, text: str, size: int, parts: int) -> Bucketed:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi in groups(lengths.tolist(), size):
                data = b"".join(t or b"" for t in batch.column("text").slice(lo, hi - lo).cast(pa.binary()).to_pylist())
                listed = [pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), v) for v in (batch.column("doc_id").slice(lo, hi - lo), pa.array(np.cumsum(lengths[lo:hi])), batch.column("digest").slice(lo, hi - lo))]
                yield pa.RecordBatch.from_arrays([*listed, pa.array([zstandard.compress(data, 3)], pa.binary())], ["ids", "ends", "digests", "body"])

    digest = F.when(F.octet_length(text) >= WIDTH, F.unhex(F.sha2(F.col(text).cast("binary"), 256)))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), digest.alias("digest"))
    return Bucketed(rows.mapInArrow(run, "ids array<long>, ends array<long>, digests array<binary>, body binary").withColumn("block", F.monotonically_increasing_id()), "block", parts)


def _whole_copies(blocks: DataFrame) -> list[Stored]:
    """Of each block that has some, the places of documents whose whole text a smaller one has; and the smallest id of each such text, stored so that the copies of one need not meet in one task."""
    docs = blocks.select("block", F.posexplode(F.arrays_zip("ids", "digests")).alias("at", "doc")).select("block", "at", F.coalesce("doc.ids", F.lit(int(LAST))).alias("id"), F.col("doc.digests").alias("digest"))
    docs = docs.where("digest is not null")
    firsts = Stored(docs.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("digest", "least"))
    return [Stored(docs.join(firsts.rows, "digest").where("id > least").groupBy("block").agg(F.collect_list("at").alias("whole"))), firsts]


def _read(batch: pa.RecordBatch, k: int) -> Block:
    """A block without the texts of its whole copies."""
    ids = pc.fill_null(batch.column("ids")[k].values, LAST).to_numpy()
    body, ends = np.frombuffer(zstandard.decompress(batch.column("body")[k].as_buffer()), np.uint8), batch.column("ends")[k].values.to_numpy()
    whole = _whole(batch, k)
    if not len(whole):
        return Block(body, ends, ids)
    sizes, stays = np.diff(ends, prepend=0), np.ones(len(ids), bool)
    stays[whole] = False
    return Block(body[np.repeat(stays, sizes)], np.cumsum(sizes * stays), ids)


def _whole(batch: pa.RecordBatch, k: int) -> np.ndarray:
    whole = batch.column("whole")[k].values
    return np.empty(0, np.int64) if whole is None else whole.to_numpy().astype(np.int64)


def _replies(batch: pa.RecordBatch, k: int, name: str) -> np.ndarray:
    """What the buckets have answered to a block, in the order of the buckets."""
    said = batch.column(name)[k].values
    if said is None or not len(said):
        return np.empty(0, np.uint8)
    order = np.argsort(said.field("bucket").to_numpy())
    return np.frombuffer(b"".join(said.field("reply").take(pa.array(order)).to_pylist()), np.uint8)


def _answered(blocks: DataFrame, parts: int, **replies: DataFrame) -> DataFrame:
    """blocks with the replies of all buckets, which are dealt as the blocks are."""
    for name, rows in replies.items():
        blocks = blocks.join(rows.repartition(parts, "block").groupBy("block").agg(F.collect_list(F.struct("bucket", "reply")).alias(name)), "block", "left")
    return blocks


def _by_bucket(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) in an ascending array."""
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    return list(zip(bucket[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(bucket)][: len(cuts)], strict=True))


class Asked(NamedTuple):
    """Hashes that a block asks about: which of them each of its runs has, the different ones by bucket, and their buckets."""

    of: np.ndarray
    hashes: np.ndarray
    bucket: np.ndarray


def _asked(hashes: np.ndarray, buckets: int) -> Asked:
    found, of = np.unique(hashes, return_inverse=True)
    bucket = ((found >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return Asked(rank[of], found[order], bucket[order].astype(np.int64))


def _held(asked: Asked, doc: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each hash, whether several documents of the block hold it, and how many different texts its runs have."""
    any_, several = np.zeros(len(asked.hashes), np.int64), np.zeros(len(asked.hashes), bool)
    any_[asked.of] = doc
    several[asked.of[doc != any_[asked.of]]] = True
    first = np.unique(_mixed(asked.hashes[asked.of] ^ _mixed(text)), return_index=True)[1]
    return several, np.bincount(asked.of[first], minlength=len(asked.hashes))


def _holders(block: Block, start: np.ndarray) -> np.ndarray:
    return block.ids[np.searchsorted(block.ends, start, "right")] if len(start) else start


def _anchors(block: Block, buckets: int) -> tuple[Runs, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of a block, and what it asks about their anchors."""
    all_ = runs(block.body, block.ends)
    return all_, *_asked(all_.anchor, buckets)


def _sides(all_: Runs, told: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, Asked]:
    """The runs whose anchors are shared and that have windows for the side before, those that have some for the side after, and what the block asks about the sides of the first and then of the others."""
    before, after = (np.flatnonzero(has & (told > 0)) for has in _has_sides(all_.count, all_.place))
    return before, after, _asked(np.concatenate([all_.before[before], all_.after[after]]), buckets)


def _ask(blocks: DataFrame, ask: Callable[[pa.RecordBatch, int], tuple[Asked, np.ndarray, np.ndarray]]) -> DataFrame:
    """What blocks ask the buckets: how many hashes, four bytes of each, how many texts they have, and a bit for those of several documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                asked, doc, text = ask(batch, k)
                several, texts = _held(asked, doc, text)
                spans = _by_bucket(asked.bucket)
                packed = [asked.hashes[lo:hi].astype("<u4").tobytes() + texts[lo:hi].astype("<u4").tobytes() + np.packbits(several[lo:hi]).tobytes() for _, lo, hi in spans]
                columns = [pa.array([b for b, _, _ in spans], pa.int32()), pa.array([batch.column("block")[k].as_py()] * len(spans), pa.int64()), pa.array([hi - lo for _, lo, hi in spans], pa.int32()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "block", "n", "asked"])

    return blocks.mapInArrow(run, "bucket int, block long, n int, asked binary")


def _ask_anchors(blocks: DataFrame, buckets: int) -> DataFrame:
    def ask(batch: pa.RecordBatch, k: int) -> tuple[Asked, np.ndarray, np.ndarray]:
        block = _read(batch, k)
        all_, *asked = _anchors(block, buckets)
        return Asked(*asked), _holders(block, all_.start), all_.text

    return _ask(blocks, ask)


def _ask_sides(blocks: DataFrame, buckets: int) -> DataFrame:
    def ask(batch: pa.RecordBatch, k: int) -> tuple[Asked, np.ndarray, np.ndarray]:
        block = _read(batch, k)
        all_, of, *_ = _anchors(block, buckets)
        before, after, asked = _sides(all_, _replies(batch, k, "anchors")[of], buckets)
        both = np.concatenate([before, after])
        return asked, _holders(block, all_.start[both]), all_.text[both]

    return _ask(blocks, ask)


def _answer_anchors(table: pa.Table, hot: int) -> pa.Table:
    """For each anchor (or side) of each block: 0 if no other document holds it, 1 if one does, 2 if blocks have very many stretches of it, too."""
    sizes, hashes, texts, several = table["n"].to_numpy(), [], [], []
    for n, asked in zip(sizes.tolist(), table["asked"], strict=True):
        raw = np.frombuffer(asked.as_buffer(), np.uint8)
        hashes.append(raw[: 4 * n].view("<u4"))
        texts.append(raw[4 * n : 8 * n].view("<u4"))
        several.append(np.unpackbits(raw[8 * n :], count=n))
    _, of, count = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    # a hash of several blocks counts as shared; if they hold one and the same document, that costs a comparison
    shared = count > 1
    shared[of[np.concatenate(several).astype(bool)]] = True
    state = (shared * (1 + (np.bincount(of, np.concatenate(texts)) > hot))).astype(np.uint8)[of]
    return pa.table({"bucket": table["bucket"], "block": table["block"], "reply": pa.array([x.tobytes() for x in np.split(state, np.cumsum(sizes)[:-1])], pa.binary())})


HEAD = np.dtype([("order", "<i8"), ("start", "<u4"), ("place", "u1"), ("count", "u1")])
COPY = np.dtype([("start", "<u4"), ("like", "<u4"), ("count", "u1"), ("later", "u1")])
MARK = np.dtype([("start", "<u4"), ("count", "u1")])


class Stretches(NamedTuple):
    """Different stretches of text of a block, by bucket: smallest document, first byte, place of the anchor, windows; and the other places that show one: where, like which one, and whether a larger document holds it there."""

    bucket: np.ndarray
    heads: np.ndarray
    copies: np.ndarray


def stretches(block: Block, state: np.ndarray, buckets: int, sides: np.ndarray | None = None) -> Stretches:
    """The stretches of a block around shared anchors; state has the replies for its anchors, sides those for their sides (without them, all are taken as shared)."""
    all_, of, *_ = _anchors(block, buckets)
    told = state[of] if len(of) else np.empty(0, np.uint8)
    before, after, asked = _sides(all_, told, buckets)
    said = np.ones(len(asked.of), np.uint8) if sides is None else sides[asked.of]
    # of each run, the windows before those that hold the side after its anchor, and these
    parted = np.clip(all_.place - HALF + 1, 0, all_.count)
    has = np.zeros((2, len(told)), np.uint8)
    has[0, before], has[1, after] = said[: len(before)], said[len(before) :]
    kept = np.flatnonzero((told == 1) & has.any(0))
    skip, stop = np.where(has[0, kept] > 0, 0, parted[kept]), np.where(has[1, kept] > 0, all_.count[kept], parted[kept])
    first, last = (np.flatnonzero((told == 2) & (x == 1)) for x in has)
    run = np.concatenate([kept, first, last])
    skip, stop = np.concatenate([skip, np.zeros(len(first), np.int64), parted[last]]), np.concatenate([stop, parted[first], all_.count[last]])
    key = np.concatenate([all_.anchor[kept], all_.before[first], all_.after[last]])
    hot = [np.flatnonzero((told == 2) & (x == 2)) for x in has]
    single = np.concatenate([_ragged(all_.start[hot[0]], parted[hot[0]]), _ragged((all_.start + parted)[hot[1]], (all_.count - parted)[hot[1]])])
    own = np.concatenate([np.empty(0, np.uint64), *(_mixed((block.body[x[:, None] + np.arange(WIDTH)].astype(np.uint64) + np.uint64(1)) @ _powers(1 << 20)[0][:WIDTH]) for x in np.split(single, range(1 << 16, len(single), 1 << 16)))])
    start, count, text = all_.start[run] + skip, stop - skip, all_.text[run]
    part = np.flatnonzero(count < all_.count[run])
    text[part] = _texts(block.body, start[part], count[part] + WIDTH - 1)
    start, count = np.concatenate([start, single]), np.concatenate([count, np.ones(len(single), np.int64)])
    place = np.concatenate([all_.place[run] - skip, np.zeros(len(single), np.int64)])
    key, text = np.concatenate([key, own]), np.concatenate([text, own])
    doc = _holders(block, start)
    which, rep = _classes(block.body, start, count, key, place, text, doc)
    bucket = (key[rep] >> np.uint64(20)) % np.uint64(buckets)
    like = rep[which]
    other = np.flatnonzero(like != np.arange(len(like)))
    like = like[other]
    copies = np.rec.fromarrays([start[other], start[like], count[other], doc[other] > doc[like]], dtype=COPY)
    order = np.lexsort((rep, bucket))
    rep = rep[order]
    heads = np.rec.fromarrays([x[rep] for x in (doc, start, place, count)], dtype=HEAD)
    return Stretches(bucket[order].astype(np.int64), heads, copies)


def _texts(body: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The hashes of strings of a block."""
    out = np.empty(len(start), np.uint64)
    for lo in range(0, len(start), 1 << 13):
        some = slice(lo, lo + (1 << 13))
        stop = np.cumsum(n[some])
        out[some] = _hash(prefixes(body[_ragged(start[some], n[some])]), stop - n[some], stop)
    return out


def _classes(body: np.ndarray, start: np.ndarray, count: np.ndarray, key: np.ndarray, place: np.ndarray, text: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each stretch, and for each class of equal ones the stretch with the smallest order."""
    same = _mixed(key ^ _mixed(text ^ (place << 8 | count).astype(np.uint64)))
    by = np.lexsort((order, same))
    first = np.flatnonzero(np.diff(same[by], prepend=same[by[:1]] + np.uint64(1)) != 0)
    which = np.empty(len(by), np.int64)
    which[by] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(by))))
    rep = by[first]
    if _alike(body, start, rep[which], count):
        return which, rep
    return np.arange(len(start)), np.arange(len(start))  # two texts with one hash: tell none of them apart by it


def _alike(body: np.ndarray, start: np.ndarray, rep: np.ndarray, count: np.ndarray) -> bool:
    """Whether each stretch has the bytes of the one that stands for it."""
    if (count != count[rep]).any():
        return False
    others = np.flatnonzero(rep != np.arange(len(rep)))
    for lo in range(0, len(others), 1 << 14):
        at = others[lo : lo + (1 << 14)]
        n = count[at] + WIDTH - 1
        if (body[_ragged(start[at], n)] != body[_ragged(start[rep[at]], n)]).any():
            return False
    return True


def _messages(block: Block, number: int, s: Stretches) -> pa.RecordBatch:
    """What a block tells the buckets; its copies come back to it as they are, by a bucket below zero."""
    spans, packer = _by_bucket(s.bucket), zstandard.ZstdCompressor(3)
    heads = [s.heads[lo:hi].view(np.uint8).reshape(-1, HEAD.itemsize).T.tobytes() for _, lo, hi in spans]
    begin, size = s.heads["start"].astype(np.int64), s.heads["count"].astype(np.int64) + WIDTH - 1
    told = [packer.compress(head + block.body[_ragged(begin[lo:hi], size[lo:hi])].tobytes()) for head, (_, lo, hi) in zip(heads, spans, strict=True)]
    buckets, many = [b for b, _, _ in spans], [hi - lo for _, lo, hi in spans]
    if len(s.copies):
        buckets, many, told = [*buckets, -1 - (number ^ number >> 33) % (1 << 31)], [*many, len(s.copies)], [*told, s.copies.tobytes()]
    columns = [pa.array(buckets, pa.int32()), pa.array([number] * len(buckets), pa.int64()), pa.array(many, pa.int32()), pa.array(told, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "block", "n", "told"])


def _ask_stretches(blocks: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = _read(batch, k)
                yield _messages(block, batch.column("block")[k].as_py(), stretches(block, _replies(batch, k, "anchors"), buckets, _replies(batch, k, "sides")))

    return blocks.mapInArrow(run, "bucket int, block long, n int, told binary")


def _common(prefix: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bytes two suffixes have in common, WIDTH at most: binary search over the hashes of their prefixes."""
    n = np.where(_hash(prefix, x, x + WIDTH) == _hash(prefix, y, y + WIDTH), WIDTH, 0)
    open_ = np.flatnonzero(n == 0)
    x, y, got = x[open_], y[open_], np.zeros(len(open_), np.int64)
    step = 1 << (WIDTH.bit_length() - 1)
    while step:
        fits = got + step < WIDTH
        more = np.minimum(got + step, WIDTH)
        got = np.where(fits & (_hash(prefix, x, x + more) == _hash(prefix, y, y + more)), more, got)
        step >>= 1
    n[open_] = got
    return n


def suffix_sort(data: np.ndarray, prefix: np.ndarray, start: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of suffixes by group and their first WIDTH bytes: a mergesort of all groups at once.

    Runs of one length are merged in pairs; each suffix finds its place among the other run of its pair by binary
    search, and each of those comparisons finds the common extension by another one.
    """
    order = np.argsort(group, kind="stable")
    lo = np.searchsorted(group[order], group[order])
    hi = np.searchsorted(group[order], group[order], "right")
    wide = 1
    while True:
        at = np.arange(len(order))
        mine = lo + (at - lo) // wide * wide  # where the own run begins, and the other one of the pair
        left = (at - lo) // wide % 2 == 0
        other = np.where(left, mine + wide, mine - wide)
        many = np.minimum(wide, np.maximum(hi - other, 0))
        active = np.flatnonzero(many > 0)
        if not len(active):
            if (hi - lo).max(initial=0) <= wide:
                return order
            wide *= 2
            continue
        own, a, b = order[active], np.zeros(len(active), np.int64), many[active].copy()
        while (going := np.flatnonzero(a < b)).size:
            mid = (a[going] + b[going]) // 2
            x, y = start[own[going]], start[order[other[active[going]] + mid]]
            n = _common(prefix, x, y)
            at_end = np.minimum(n, WIDTH - 1)
            before = np.where(n == WIDTH, ~left[active[going]], data[y + at_end] < data[x + at_end])  # the other's suffix stands first
            a[going], b[going] = np.where(before, mid + 1, a[going]), np.where(before, b[going], mid)
        pair = np.minimum(mine[active], other[active])
        merged = order.copy()
        merged[pair + (active - mine[active]) + a] = own
        order, wide = merged, 2 * wide


def repeated(data: np.ndarray, start: np.ndarray, group: np.ndarray, order: np.ndarray, count: np.ndarray | None = None, place: np.ndarray | None = None) -> np.ndarray:
    """Which windows stand in a smaller document too; group: equal windows are in one.

    Of stretches of ``count`` windows, all of them in turn; equal ones have the string ``place`` after the first at the
    same distance. Of two stretches, the windows that reach so far before it and after it as both have in common are equal.
    """
    count = np.ones(len(start), np.int64) if count is None else count
    place = np.zeros(len(start), np.int64) if place is None else place
    out = np.zeros(count.sum(), bool)
    _, group, size = np.unique(group, return_inverse=True, return_counts=True)
    some = np.flatnonzero(size[group] > 1)
    if not len(some):
        return out
    first = (np.cumsum(count) - count)[some]
    start, group, order, count, place = (x[some] for x in (start, group, order, count, place))
    # a suffix may run on into the next stretch: what lies beyond the windows is never asked for
    edge = np.zeros(WIDTH, np.uint8)
    text, at = np.concatenate([edge, data, edge]), WIDTH + start + place
    (after, follows), (before, precedes) = _extensions(text, at, group), _extensions(text[::-1], len(text) - at, group)
    for reach in range(int(place.max()) + 1):
        has = np.flatnonzero((reach <= place) & (place < reach + count))
        alike = _depth(after, follows, WIDTH - reach)[has] * len(some) + _depth(before, precedes, reach)[has]
        by = np.argsort(alike)
        fresh = np.diff(alike[by], prepend=-1) != 0
        if fresh.all():
            continue
        least = np.minimum.reduceat(order[has][by], np.flatnonzero(fresh))
        has = has[by]
        out[first[has] + place[has] - reach] = order[has] > least[np.cumsum(fresh) - 1]
    return out


def _depth(by: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """For sorted suffixes, a number that those have in common whose first ``depth`` bytes are equal."""
    out = np.empty(len(by), np.int64)
    out[by] = np.cumsum(common < depth) - 1
    return out


def _extensions(data: np.ndarray, start: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes, and how many bytes each has in common with the one before it in its group; -1 if none is."""
    by = suffix_sort(data, prefixes(data), start, group)
    fine, common = _checked(data, start[by], group[by])
    if not fine:  # hashes have misled the sort
        words = np.stack([data[start + k] for k in range(WIDTH - 1, -1, -1)])
        by = np.lexsort([*words, group])
        common = _checked(data, start[by], group[by])[1]
    return by, common


def _checked(data: np.ndarray, start: np.ndarray, group: np.ndarray) -> tuple[bool, np.ndarray]:
    """Whether neighbours are in order, byte by byte, and what each has in common with the one before."""
    common, fine = np.full(len(start), -1), True
    for lo in range(1, len(start), 1 << 16):
        at = np.arange(lo, min(len(start), lo + (1 << 16)))
        at = at[group[at] == group[at - 1]]
        x, y = (data[start[k][:, None] + np.arange(WIDTH)] for k in (at - 1, at))
        differ = x != y
        first, row = differ.argmax(1), np.arange(len(at))
        same = ~differ[row, first]
        common[at] = np.where(same, WIDTH, first)
        fine &= bool((same | (x[row, first] < y[row, first])).all())
    return fine, common


def _answer_stretches(table: pa.Table) -> pa.Table:
    """For each block, the windows that stand in a smaller document too: the first of a row of them, and how many."""
    if table["bucket"][0].as_py() < 0:
        return table.select(["bucket", "block", "told"]).rename_columns(["bucket", "block", "reply"])
    many, unpacker, heads, data = table["n"].to_numpy(), zstandard.ZstdDecompressor(), [], []
    for n, told in zip(many.tolist(), table["told"], strict=True):
        raw = np.frombuffer(unpacker.decompress(told.as_buffer()), np.uint8)
        heads.append(raw[: n * HEAD.itemsize].reshape(HEAD.itemsize, -1).T.tobytes())
        data.append(raw[n * HEAD.itemsize :])
    data, head = np.concatenate(data), np.frombuffer(b"".join(heads), HEAD)
    order, start, place, count = (head[c].astype(np.int64) for c in HEAD.names)
    begins = np.cumsum(count + WIDTH - 1) - (count + WIDTH - 1)
    prefix = prefixes(data)
    text = _hash(prefix, begins, begins + count + WIDTH - 1)
    key = _mixed(_hash(prefix, begins + place, begins + place + GRAM))
    which, rep = _classes(data, begins, count, key, place, text, order)
    # equal stretches of several blocks are sorted once, with the smallest of their documents
    once = repeated(data, begins[rep], key[rep], order[rep], count[rep], place[rep])
    marks = once[_ragged((np.cumsum(count[rep]) - count[rep])[which], count)] | np.repeat(order > order[rep][which], count)
    window, at = _ragged(start, count)[marks], np.repeat(np.arange(len(head)), count)[marks]
    cuts = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(window, prepend=-1) != 1))
    found = np.rec.fromarrays([window[cuts], np.diff(np.append(cuts, len(window)))], dtype=MARK)
    ends = np.searchsorted(at[cuts], np.cumsum(many)).tolist()
    told = [(k, found[lo:hi].tobytes()) for k, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if lo < hi]
    asked = table.select(["bucket", "block"]).take(pa.array([k for k, _ in told], pa.int64()))
    return asked.append_column("reply", pa.array([x for _, x in told], pa.binary()))


def _windows(rows: np.ndarray, at: str) -> np.ndarray:
    return _ragged(rows[at].astype(np.int64), rows["count"].astype(np.int64))


def _results(blocks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block, whole, ends = _read(batch, k), _whole(batch, k), batch.column("ends")[k].values.to_numpy()
                marks, copies = _replies(batch, k, "marks").view(MARK), _replies(batch, k, "copies").view(COPY)
                marked = np.zeros(len(block.body), bool)
                marked[_windows(marks, "start")] = True
                alike, later = copies[copies["later"] == 0], copies[copies["later"] == 1]
                marked[_windows(alike, "start")] = marked[_windows(alike, "like")]
                marked[_windows(later, "start")] = True
                window = np.flatnonzero(marked)
                change = np.zeros(len(block.body) + 1, np.int32)
                change[window] += 1
                change[window + WIDTH] -= 1
                gone = np.cumsum(change[:-1]) > 0
                first = gone & ~np.concatenate([[False], gone[:-1]])
                begin = np.concatenate([[0], block.ends[:-1]]).astype(np.int64)
                inner = begin[block.ends > begin]
                first[inner] = gone[inner]
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (gone, first)]
                n = [np.diff(ends, prepend=0), *(x[block.ends] - x[begin] for x in sums)]
                n[1][whole], n[2][whole] = n[0][whole], 1
                kept = [block.body[lo:hi][~gone[lo:hi]].tobytes() for lo, hi in zip(begin.tolist(), block.ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[k].values, *(pa.array(x.astype(np.int64)) for x in n), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return blocks.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def spread(total: int, hot: int = HOT, size: int = BLOCK) -> tuple[int, int, int]:
    """For a corpus of that many bytes: bytes of a block, number of buckets, stretches from which on an anchor is hot.

    Messages are blocks times buckets. As both are wider for a larger corpus, messages grow with it rather than with its
    square, and an anchor is hot from the same share of a bucket on.
    """
    wide = min(WIDER, max(1.0, (total / FEW) ** 0.5))
    return int(size * wide), 16 + int(total / (BUCKET * wide)), int(hot * wide)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT, size: int = BLOCK) -> tuple[DataFrame, list[Stored]]:
    """doc_id, n_bytes, n_removed, n_spans and the bytes kept of each row, and what to drop when they have been read."""
    total, least = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size, buckets, hot = spread(total, hot, size)
    parts = max(least, min(MOST, total // max(size, BLOCK) + 1))  # fewer than shuffles have, and a join would deal the blocks anew
    stored = _blocks(docs, doc_id, text, size, parts)
    whole, firsts = _whole_copies(stored.rows)
    blocks = stored.rows.drop("digests").join(whole.rows.repartition(parts, "block"), "block", "left")

    def answers(asked: DataFrame) -> Stored:
        return Stored(asked.groupBy("bucket").applyInArrow(lambda t: _answer_anchors(t, hot), "bucket int, block long, reply binary"))

    anchors = answers(_ask_anchors(blocks, buckets))
    sides = answers(_ask_sides(_answered(blocks, parts, anchors=anchors.rows), buckets))
    marks = Stored(_ask_stretches(_answered(blocks, parts, anchors=anchors.rows, sides=sides.rows), buckets).groupBy("bucket").applyInArrow(_answer_stretches, "bucket int, block long, reply binary"))
    return _results(_answered(blocks, parts, marks=marks.rows.where("bucket >= 0"), copies=marks.rows.where("bucket < 0"))), [stored, whole, firsts, anchors, sides, marks]


def digest(kept: bytes) -> str:
    """The digest of what is kept, as the query gives it, for tests."""
    return hashlib.sha256(kept).hexdigest()
