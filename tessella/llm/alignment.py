"""Alignment of two tokenisations of the same texts: where their tokens end together, and which tokens do.

Both tokenisers encode a space and the text, and each token covers an interval of its bytes. Within a partition, DuckDB
joins the two tables of intervals: an ASOF join finds for each token of A the token of B that holds its last byte; where
both end there, they are linked and the text is cut. A window sum over the cuts numbers the groups of tokens between
them, and a range join puts the tokens of B into those groups.

A cut is sure before a single space between two other characters: no token of either side reaches over it. So texts are
taken apart there, and what repeats within a batch is encoded and joined once. Tokenisers without that property get
their texts whole.

A pair of ids can only be linked if the bytes of one end with those of the other. There are fewer such pairs than the
bytes of both vocabularies, however large the corpus: links are numbers of such pairs, each task counts its own, Spark
adds them up, and the sums go back to every task.

Defined results: null and empty texts, and those whose tokens do not spell them on either side, have no tokens; repeated
rows and rows without an id are aligned and counted each; very long texts are aligned whole; an empty table gives none.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import free_name, groups
from tessella.llm.packing import Encoder, _shown_bytes

#: Characters of texts that one step takes apart, joins and puts together, unless a single text is longer.
STEP = 2 << 20
#: Rows that are handed on at a time.
ROWS = 64
#: First bytes of characters some of which are white space.
_MAYBE_SPACE = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
_SPACE = "▁"


class Sides:
    """Both tokenisers: ids of a piece of text after a space, the bytes of each id, and the pairs that can be linked."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = Encoder(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.slow.encode_special_tokens, self.a.added = True, None  # their strings are plain text here
        shown = _shown_bytes()
        with open(path_a, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.bytes_a = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(shown[c] for c in token) if all(c in shown for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.apart = self.a.fast is not None and not any(_SPACE in p.lstrip(_SPACE) for i, p in enumerate(pieces) if not self.b.is_byte(i))
        self.size_a, self.size_b = (np.array([len(x) for x in of], np.int64) for of in (self.bytes_a, self.bytes_b))
        self.pairs = self._linkable()

    def _linkable(self) -> np.ndarray:
        """The pairs of which one's bytes end with the other's, as a << 32 | b, ascending."""
        by_a, by_b = {}, {}
        for of, by in ((self.bytes_a, by_a), (self.bytes_b, by_b)):
            for i, data in enumerate(of):
                if data:
                    by.setdefault(data, []).append(i)
        found = {i << 32 | j for data, many in by_a.items() for k in range(len(data)) for j in by_b.get(data[k:], ()) for i in many}
        found |= {i << 32 | j for data, many in by_b.items() for k in range(1, len(data)) for i in by_a.get(data[k:], ()) for j in many}
        return np.sort(np.fromiter(found, np.int64, len(found)))

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all parts in a row and how many each has, for both sides; none on both where the bytes of a side are not those of a space and the part."""
        many_a, many_b = self._encode_a(parts), self.b.encode(parts, num_threads=1)
        if not (self._spells(parts, many_a, self.bytes_a) and self._spells(parts, many_b, self.bytes_b)):
            for k, p in enumerate(parts):
                if not (self._spells([p], [many_a[k]], self.bytes_a) and self._spells([p], [many_b[k]], self.bytes_b)):
                    many_a[k], many_b[k] = [], []
        return tuple(x for many in (many_a, many_b) for x in (np.fromiter(chain.from_iterable(many), np.int64), np.fromiter(map(len, many), np.int64, len(many))))

    def _encode_a(self, parts: list[str]) -> list[list[int]]:
        return [self.a.encode(" " + p) for p in parts]

    @staticmethod
    def _spells(parts: list[str], many: list[list[int]], of: list[bytes]) -> bool:
        return b"".join(map(of.__getitem__, chain.from_iterable(many))) == "".join([f" {p}" for p in parts]).encode() and all(map(len, many))


@lru_cache(2)
def sides(path_a: str, path_b: str) -> Sides:
    return Sides(path_a, path_b)


@lru_cache(1)
def _connection() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute("SET memory_limit = '600MB'")
    return con


#: a: tokens as (id, s, e), their byte intervals over all texts in a row. Each meets the token of b that holds its last
#: byte, is cut from what follows if both end there, and has the number of its group.
GROUPS = """
WITH met AS (SELECT a.id, a.s, a.e, b.id AS b_id, a.e = b.e AS cut FROM a ASOF JOIN b ON b.s < a.e)
SELECT *, coalesce(sum(cut::INT) OVER (ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS g FROM met ORDER BY e
"""
#: The group of each token of b: the one whose interval holds its own. They meet within cells of 64 bytes, so no token is
#: compared with groups far from it.
MEMBERS = """
WITH spans AS (SELECT g, min(s) AS s, max(e) AS e FROM numbered GROUP BY g), celled AS (SELECT *, unnest(range(s // 64, (e - 1) // 64 + 1)) AS cell FROM spans)
SELECT b.id, x.g FROM b JOIN celled x ON (b.e - 1) // 64 = x.cell AND b.s >= x.s AND b.e <= x.e ORDER BY b.e
"""


def joints(body: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of single spaces that join two characters which are surely no white space, within texts that end at ``ends``."""
    inner = np.ones(len(body) + 1, bool)
    inner[ends] = inner[0] = inner[-1] = False  # no text starts with a joint
    inner[ends[ends > 0] - 1] = False  # or ends with one
    at = np.flatnonzero((body == 32) & inner[:-1])
    before, after = body[at - 1], body[at + 1]
    # a character of white space beyond ASCII has two or three bytes
    blank = (before >= 0x80) & (_MAYBE_SPACE[body[np.maximum(at - 2, 0)]] | _MAYBE_SPACE[body[np.maximum(at - 3, 0)]])
    return at[(before > 32) & ~blank & (after > 32) & ~_MAYBE_SPACE[after]]


def taken_apart(texts: pa.Array, apart: bool) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The number of parts of each text, the parts of all texts in a row as numbers, and the different parts."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    body = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8)
    at = joints(body, ends) if apart else np.empty(0, np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    counts = np.searchsorted(at, ends) - np.searchsorted(at, begins) + (ends > begins)
    kept = np.ones(len(body), bool)
    kept[at] = False
    stops = np.sort(np.concatenate([at, ends[ends > begins]]))
    offsets = np.concatenate([[0], stops - np.searchsorted(at, stops)]).astype(np.int32)
    parts = pa.Array.from_buffers(pa.string(), len(stops), [None, pa.py_buffer(offsets), pa.py_buffer(body[kept])]).dictionary_encode()
    return counts, parts.indices.to_numpy(), parts.dictionary.to_pylist()


def _shown(a: np.ndarray, g_a: np.ndarray, b: np.ndarray, g_b: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The tokens of both sides as text, group by group, each with the mark that follows it; where each group ends."""
    sizes_a, sizes_b = np.bincount(g_a), np.bincount(g_b)
    place_a, place_b = np.arange(len(a)) + (np.cumsum(sizes_b) - sizes_b)[g_a], np.arange(len(b)) + np.cumsum(sizes_a)[g_b]
    out = np.empty(len(a) + len(b), object)
    for ids, g, place, end in ((a, g_a, place_a, "|"), (b, g_b, place_b, ";")):
        known, at = np.unique(ids, return_inverse=True)
        inner, last = (np.array([f"{i}{mark}" for i in known.tolist()], object) for mark in (",", end))
        out[place] = np.where(np.diff(g, append=-1) != 0, last[at], inner[at])
    return out.tolist(), np.cumsum(sizes_a + sizes_b)


def _parts(parts: list[str], both: Sides) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """n_a, n_b, n_groups and groups of each part, and the numbers of the linked pairs of all in a row."""
    flat_a, n_a, flat_b, n_b = both.encode(parts)
    if not len(flat_a):
        return n_a, n_b, n_a, pa.array([""] * len(parts), pa.string()), np.empty(0, np.int32)
    con = _connection()
    for name, flat, size in (("a", flat_a, both.size_a[flat_a]), ("b", flat_b, both.size_b[flat_b])):
        end = np.cumsum(size)
        con.register(name, pa.table({"id": flat, "s": end - size, "e": end}))
    con.register("numbered", numbered := con.sql(GROUPS).to_arrow_table())
    g_a, cut, b_id = (numbered[c].to_numpy() for c in ("g", "cut", "b_id"))
    g_b = con.sql(MEMBERS).to_arrow_table()["g"].to_numpy()
    links = np.searchsorted(both.pairs, flat_a[cut] << 32 | b_id[cut]).astype(np.int32)
    # a part ends with a cut, as both sides spell it whole
    ends = np.concatenate([[0], np.cumsum(cut)])[np.concatenate([[0], np.cumsum(n_a)])]
    shown, group_ends = _shown(flat_a, g_a, flat_b, g_b)
    text_ends = np.concatenate([[0], group_ends])[ends].tolist()
    return n_a, n_b, np.diff(ends), pa.array(["".join(shown[lo:hi])[:-1] for lo, hi in pairwise(text_ends)], pa.string()), links


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[k], starts[k] + 1, ... (counts[k] of them) for each k in turn."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def pack(numbers: np.ndarray) -> bytes:
    """Numbers in any order as their differences when sorted, packed: a fifth of the room."""
    return zstandard.compress(np.diff(np.sort(numbers), prepend=0).astype("<u4").tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(data), "<u4"), dtype=np.int64)


def _aligned(texts: pa.Array, both: Sides) -> list[pa.Array]:
    """n_a, n_b, n_groups, groups and the packed numbers of the linked pairs of texts without nulls."""
    counts, of, parts = taken_apart(texts, both.apart)
    n_a, n_b, n_groups, shown, links = _parts(parts, both)
    text = np.repeat(np.arange(len(texts)), counts)
    bad = np.zeros(len(texts), bool)
    bad[text[n_groups[of] == 0]] = True
    counts[bad] = 0
    of, text = of[~bad[text]], text[~bad[text]]
    totals = [pa.array(np.bincount(text, n[of], len(texts)).astype(np.int64)) for n in (n_a, n_b, n_groups)]
    row_ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    groups_ = pc.binary_join(pa.ListArray.from_arrays(row_ends, shown.take(pa.array(of))), ";")
    own = links[_ragged((np.cumsum(n_groups) - n_groups)[of], n_groups[of])]
    return [*totals, groups_, pa.array([pack(x) for x in np.split(own, np.cumsum(totals[2].to_numpy())[:-1])], pa.binary())]


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with n_a, n_b, n_groups, groups (``a1,a2|b1;...``) and links (the numbers of the linked ``Sides.pairs``, for ``unpack``)."""
    out = docs.select(*keep).schema
    for name, kind in (("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("groups", "string"), ("links", "binary")):
        out = out.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(len(keep)), "")
            for lo, hi in groups(pc.binary_length(texts).to_numpy(zero_copy_only=False).tolist(), STEP):
                made = _aligned(texts.slice(lo, hi - lo), sides(path_a, path_b))
                done = pa.RecordBatch.from_arrays([c.slice(lo, hi - lo) for c in batch.columns[: len(keep)]] + made, out.names)
                for at in range(0, hi - lo, ROWS):  # the ids as text take several times the room of the text
                    yield done.slice(at, ROWS)
                del made, done
                pa.default_memory_pool().release_unused()

    return docs.select(*keep, F.col(text).alias(free_name(docs, "text"))).mapInArrow(run, out)


def pair_counts(aligned: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(a, b, n): how many links hold each pair of ids; summed within tasks before the shuffle."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = sides(path_a, path_b).pairs
        total = np.zeros(len(pairs), np.int64)
        for batch in batches:
            for links in batch.column("links"):
                np.add.at(total, unpack(links.as_buffer()), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (pairs[at] >> 32, pairs[at] & 0xFFFFFFFF, total[at])], ["a", "b", "n"])

    return aligned.select("links").mapInArrow(partial, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def weigh(aligned: DataFrame, counts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """aligned with n_links, n_best (links whose pair is the most frequent of its b) and count_sum instead of links.

    counts has at most as many rows as there are pairs that can be linked, which the vocabularies bound (about half a
    million here), so all tasks get them.
    """
    both, known = sides(path_a, path_b), counts.toPandas()
    total = np.zeros(len(both.pairs), np.int64)
    total[np.searchsorted(both.pairs, known["a"].to_numpy(np.int64) << 32 | known["b"].to_numpy(np.int64))] = known["n"]
    b = both.pairs & 0xFFFFFFFF
    most = np.zeros(len(both.bytes_b), np.int64)
    np.maximum.at(most, b, total)
    shared = aligned.sparkSession.sparkContext.broadcast((total, total == most[b]))

    def step(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, best = shared.value
        for batch in rows:
            found = [unpack(x.as_buffer()) for x in batch.column("links")]
            made = [np.array(x, np.int64) for x in ([len(f) for f in found], [best[f].sum() for f in found], [total[f].sum() for f in found])]
            names = [c for c in batch.schema.names if c != "links"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(x.astype(np.int64)) for x in made], [*names, "n_links", "n_best", "count_sum"])

    out = aligned.drop("links").schema
    for name in ("n_links", "n_best", "count_sum"):
        out = out.add(name, "long")
    return aligned.mapInArrow(step, out)
