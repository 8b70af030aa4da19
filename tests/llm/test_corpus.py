"""Phrases, repeats and alignment against brute force, on whole tables and odd rows."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import alignment, packing, phrases, queries, repeats
from tests.conftest import MIDDLE, SMALL
from tests.llm.test_operators import documents, odd_docs

AT = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def by_sql(name, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    return con.execute(queries.oracle_sql()[name]).df()


def same(got, want, keys):
    got, want = (f[sorted(want.columns)].sort_values(keys).reset_index(drop=True) for f in (got, want))
    assert len(got) == len(want) > 0
    assert (got.astype(str) == want.astype(str)).all().all()


# phrases


def brute_phrases(rows, least=10, most=3, top=2000, share=50):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        found = [p for p, a in count.items() if len(p) > 1 and a >= least]
        held = defaultdict(int)
        for p in found:
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    held[p[i : i + k]] = max(held[p[i : i + k]], count[p])
        rows = []
        for p in found:
            a = count[p]
            if 100 * held[p] >= share * a and held[p]:
                continue
            s, _, left, right = min((1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            rows.append((-s, -a, " ".join(p).encode(), left, right))
        out += [(lang, r, t.decode(), -a, left, right, n[lang], -s) for r, (s, a, t, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def listed(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_phrases_equal_sql(spark):
    same(queries.op11_collocations(spark, MIDDLE).toPandas(), by_sql("op11_collocations", MIDDLE), ["lang", "rank"])


@pytest.mark.parametrize(("least", "most", "top", "shard"), [(10, 3, 2000, 1 << 23), (2, 4, 50, 4000), (3, 2, 7, 100)])
def test_phrases_equal_brute_force(spark, least, most, top, shard):
    rows = [(r.lang, r.text) for r in documents(SMALL).itertuples()]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert listed(phrases.collocations(docs, least=least, most_words=most, top=top, shard=shard)) == brute_phrases(rows, least, most, top)


def test_phrases_of_odd_rows(spark):
    rows = [(r["lang"], r["text"]) for r in odd_docs(spark).collect()] + [(None, "A b c. a B\tc d\n\na b, É é É é"), ("x", None), ("x", "only once here"), ("en", "no id no id no id")] * 2
    docs = spark.createDataFrame([(lang, text, 1) for lang, text in rows], "lang string, text string, shard int")
    assert listed(phrases.collocations(docs, least=2)) == brute_phrases(rows, least=2)
    assert phrases.collocations(docs.where("false")).count() == 0
    assert phrases.collocations(docs.where("lang = 'x'").limit(2), least=9).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-1, 3), max_size=12), max_size=6), st.integers(1, 4))
def test_automaton_counts_end_positions(pieces, depth):
    ids = np.array([w for p in pieces for w in p], np.int64)
    begins = np.array([k == 0 for p in pieces for k in range(len(p))], bool)
    states = phrases.suffix_automaton(ids, begins, depth)
    want = Counter()
    for p in pieces:
        for i in range(len(p)):
            for k in range(1, depth + 1):
                if i + k <= len(p) and min(p[i : i + k]) >= 0:
                    want[tuple(p[i : i + k])] += 1
    got = {tuple(ids[e - d + 1 : e + 1].tolist()): int(n) for d, s in enumerate(states, 1) for e, n in zip(s.end, s.count, strict=True)}
    assert got == dict(want)
    for d in range(1, len(states)):  # a link drops the first word
        for e, link in zip(states[d].end, states[d].link, strict=True):
            shorter = states[d - 1].end[link]
            assert ids[shorter - d + 1 : shorter + 1].tolist() == ids[e - d + 1 : e + 1].tolist()


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 999_999_999_989, 10**13 - 27, 10**12 + 39
    got = spark.range(1).select(phrases.score(F.lit(a), F.lit(left), F.lit(right)).alias("s")).first()["s"]
    assert got == 1_000_000 * a * a // (left * right)


# repeats


def brute_repeats(rows):
    order = [repeats.LAST.item() if d is None else d for d, _ in rows]
    least = {}
    data = [(t or "").encode() for _, t in rows]
    for d, t in zip(order, data, strict=True):
        for i in range(len(t) - 49):
            w = t[i : i + 50]
            least[w] = min(least.get(w, d), d)
    out = []
    for d, t in zip(order, data, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 49):
            if least[t[i : i + 50]] < d:
                gone[i : i + 50] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def removed(docs, **how):
    found, used = repeats.without_repeats(docs, **how)
    rows = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], repeats.digest(bytes(r["kept"]))) for r in found.collect()]
    for u in used:
        u.drop()
    return rows


def key(row):
    return tuple((x is None, x) for x in row)


def test_repeats_equal_brute_force_on_the_table(spark):
    docs = documents(SMALL)
    rows = list(zip(docs["doc_id"], docs["text"], strict=True))
    got = [tuple(r) for r in queries.op12_suffix_dedup(spark, SMALL).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got) == sorted((d, *x) for (d, _), x in zip(rows, brute_repeats(rows), strict=True))
    assert sum(r[2] for r in got) > 1000


def planted():
    rng = np.random.default_rng(0)
    words = lambda n: "".join(rng.choice(list("abcdé \n"), n))
    shared, long = words(120), words(3000)
    rows = [(5, words(60) + shared + words(70)), (3, shared), (9, shared[:49]), (8, shared[:50]), (2, None), (2, ""), (1, "x" * 400), (4, "x" * 60 + "y"), (7, "x" * 51)]
    rows += [(k, long[:1500] + words(5) + long[1500:]) for k in (20, 21, 22)] + [(30, long), (30, long), (31, long), (None, long), (None, long[100:400]), (40, shared[60:] + shared[:60])]
    return [*rows, (3, "another text with the id of an earlier row, which is no smaller than itself: " + shared)]


@pytest.mark.parametrize("how", [{}, {"size": 1}, {"size": 700}, {"hot": 1, "size": 300}, {"hot": 0}])
def test_repeats_of_planted_passages(spark, how):
    rows = planted()
    want = sorted([(d, *x) for (d, _), x in zip(rows, brute_repeats(rows), strict=True)], key=key)
    docs = spark.createDataFrame([(t, "x", d) for d, t in rows], "text string, block string, doc_id long").repartition(4)
    assert sorted(removed(docs, **how), key=key) == want


def test_messages_of_repeats_grow_with_the_corpus():
    def messages(total):
        size, buckets, _ = repeats.spread(total)
        return total / size * buckets

    assert repeats.spread(10**8) == (repeats.BLOCK, 16 + 10**8 // repeats.BUCKET, repeats.HOT)
    assert messages(6 * 10**9) < 7 * messages(10**9)
    assert messages(15 * 10**9) < 16 * messages(10**9)


def test_repeats_in_wide_blocks_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(repeats, "FEW", 100)
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted([(d, *x) for (d, _), x in zip(rows, brute_repeats(rows), strict=True)], key=key)
    assert sorted(removed(docs, size=300, hot=20), key=key) == want


def test_repeats_of_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"] or "") < 10_000]
    want = sorted([(d, *x) for (d, _), x in zip(rows, brute_repeats(rows), strict=True)], key=key)
    assert sorted(removed(docs.where("text is null or length(text) < 10000")), key=key) == want
    assert removed(docs.where("false")) == []
    twice = [(1, "ab" * 400_000), (2, "ab" * 400_000 + "c")]  # longer than what is hashed at a time
    assert sorted(r[:4] for r in removed(spark.createDataFrame(twice, "doc_id long, text string"))) == [(1, 800_000, 0, 0), (2, 800_001, 800_000, 1)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=160), min_size=1, max_size=4), st.binary(min_size=50, max_size=90))
def test_equal_windows_have_equal_anchors(parts, common):
    texts = [p + common + p[:7] for p in parts]
    body, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    r = repeats.runs(body, ends)
    seen, covered = {}, set()
    for s, n, a, p in zip(r.start.tolist(), r.count.tolist(), r.anchor.tolist(), r.place.tolist(), strict=True):
        for j in range(n):
            window = body[s + j : s + j + 50].tobytes()
            assert seen.setdefault(window, (a, p - j)) == (a, p - j)
            covered.add(s + j)
    begin = np.concatenate([[0], ends[:-1]])
    assert covered == {i for b, e in zip(begin.tolist(), ends.tolist(), strict=True) for i in range(b, e - 49)}


def test_suffix_sort_and_misleading_hashes(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 700).astype(np.uint8)
    data[300:420], data[500:620] = data[100:220], data[100:220]
    start = rng.permutation(651)
    group = rng.integers(0, 5, 651).astype(np.uint64)
    by = repeats.suffix_sort(data, repeats.prefixes(data), start, group)
    assert [(g, data[s : s + 50].tobytes()) for g, s in zip(group[by], start[by], strict=True)] == sorted((g, data[s : s + 50].tobytes()) for g, s in zip(group, start, strict=True))
    order = rng.integers(0, 9, 651)
    want = repeats.repeated(data, start, np.zeros(651, np.uint64), order)
    least = {}
    for s, o in zip(start, order, strict=True):
        w = data[s : s + 50].tobytes()
        least[w] = min(least.get(w, o), o)
    assert want.tolist() == [bool(o > least[data[s : s + 50].tobytes()]) for s, o in zip(start, order, strict=True)] and want.any()
    monkeypatch.setattr(repeats, "_hash", lambda prefix, start, stop: np.zeros(len(start), np.uint64))  # all hashes clash
    assert (repeats.repeated(data, start, np.zeros(651, np.uint64), order) == want).all()
    which, rep = repeats._classes(data, np.array([0, 100, 300]), np.array([1, 71, 71]), np.zeros(3, np.uint64), np.zeros(3, np.int64), np.zeros(3, np.uint64), np.array([1, 2, 3]))
    assert rep[which].tolist() == [0, 1, 1]
    which, rep = repeats._classes(data, np.array([0, 100, 301]), np.array([71, 71, 71]), np.zeros(3, np.uint64), np.zeros(3, np.int64), np.zeros(3, np.uint64), np.array([1, 2, 3]))
    assert which.tolist() == rep.tolist() == [0, 1, 2]  # texts that differ under one hash stay apart


@pytest.mark.parametrize("clash", [False, True])
def test_windows_of_stretches_are_equal_as_far_as_both_extend(monkeypatch, clash):
    rng = np.random.default_rng(2)
    n = 60
    place, count = rng.integers(0, 33, n), np.zeros(n, np.int64)
    for k in range(n):
        count[k] = rng.integers(1, 34 if place[k] == 32 else place[k] + 2)
    anchor = [b"anchor of 18 bytes", b"another of 18 byte"]
    group = rng.integers(0, 2, n)
    sides = [rng.integers(97, 99, 40).astype(np.uint8).tobytes() for _ in range(4)]
    texts = []
    for k in range(n):
        before, after = bytearray(sides[rng.integers(4)]), bytearray(sides[rng.integers(4)])
        before[rng.integers(40)] ^= rng.integers(0, 2)
        after[rng.integers(40)] ^= rng.integers(0, 2)
        whole = bytes(before)[len(before) - place[k] :] + anchor[group[k]] + bytes(after)
        texts.append(whole[: count[k] + 49].ljust(count[k] + 49, b"~"))
    data, start = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts[:-1])])
    order = rng.integers(0, 20, n)
    windows = [(place[k] - j, texts[k][j : j + 50], order[k]) for k in range(n) for j in range(count[k])]
    least = {}
    for at, w, o in windows:
        least[at, w] = min(least.get((at, w), o), o)
    if clash:
        monkeypatch.setattr(repeats, "_hash", lambda prefix, start, stop: np.zeros(len(start), np.uint64))
    got = repeats.repeated(data, start, group.astype(np.uint64), order, count, place)
    assert got.tolist() == [bool(o > least[at, w]) for at, w, o in windows] and got.any() and not got.all()


def test_a_frequent_line_costs_two_suffixes_for_each_stretch(monkeypatch):
    rng = np.random.default_rng(3)
    line = rng.integers(97, 123, 70).astype(np.uint8).tobytes()
    texts = [rng.integers(97, 123, 45).astype(np.uint8).tobytes() + line for _ in range(300)]
    messages, stretches = [], 0
    for k, text in enumerate(texts):
        block = repeats.Block(np.frombuffer(text, np.uint8), np.array([len(text)]), np.array([k]))
        s = repeats.stretches(block, np.ones(len(repeats._anchors(block, 1)[2]), np.uint8), 1)
        messages.append(repeats._messages(block, k, s))
        stretches += len(s.heads)
    sorted_, sort = [], repeats.suffix_sort
    monkeypatch.setattr(repeats, "suffix_sort", lambda data, prefix, start, group: sorted_.append(len(start)) or sort(data, prefix, start, group))
    told = repeats._answer_stretches(pa.Table.from_batches(messages))
    assert 300 < sum(sorted_) <= 2 * stretches
    got = {k: repeats._windows(np.frombuffer(r, repeats.MARK), "start").tolist() for k, r in zip(told["block"].to_pylist(), told["reply"].to_pylist(), strict=True)}
    least = {}
    for k, text in enumerate(texts):
        for i in range(66):
            least.setdefault(text[i : i + 50], k)
    want = {k: [i for i in range(66) if least[text[i : i + 50]] < k] for k, text in enumerate(texts)}
    assert {k: sorted(x) for k, x in got.items()} == {k: x for k, x in want.items() if x} and len(got) == 299


@pytest.mark.parametrize("size", [1, 400, 1 << 21])
def test_repeats_of_a_passage_that_one_document_holds_several_times(spark, size):
    rng = np.random.default_rng(4)
    p, q, r = ("".join(rng.choice(list("abcdefgh"), n)) for n in (130, 90, 20))
    rows = [(6, q + p + r + p + q), (2, p), (7, p + p + p), (5, q + q + r + q), (5, r + q), (9, q + p + r + p + q)]
    want = sorted([(d, *x) for (d, _), x in zip(rows, brute_repeats(rows), strict=True)], key=key)
    assert sorted(removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(1), size=size), key=key) == want


def sent(monkeypatch):
    """A list that gets the bytes of the stretches which blocks send."""
    sizes, ask = [], repeats._ask_stretches

    def measured(*args):
        told = ask(*args)
        size = sum((F.octet_length(c) for c, kind in told.dtypes if kind == "binary"), F.lit(0))
        sizes.append(told.agg(F.sum(size)).first()[0] or 0)
        return told

    monkeypatch.setattr(repeats, "_ask_stretches", measured)
    return sizes


@pytest.mark.parametrize("hot", [1, 30, 1000])
def test_text_that_comes_twice_by_chance_does_not_travel(spark, monkeypatch, hot):
    rng = np.random.default_rng(5)
    words = np.array(["".join(rng.choice(list("abcdefgh"), rng.integers(4, 8))) for _ in range(25)])
    rows = [(k, " ".join(rng.choice(words, 400))) for k in range(120)]
    rows += [(200, rows[0][1][100:400] + rows[1][1]), (201, rows[7][1][:1000] + "and" + rows[7][1][1000:])]
    want = sorted([(d, *x) for (d, _), x in zip(rows, brute_repeats(rows), strict=True)], key=key)
    sizes = sent(monkeypatch)
    assert sorted(removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size=20_000, hot=hot), key=key) == want
    assert 0 < sizes[0] < sum(len(t) for _, t in rows)


def test_whole_copies_do_not_travel(spark, monkeypatch):
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abcdé \n"), n)) for n in (49, 50, 3000, 700)]
    rows = [(k, t) for k in (1, 2, 3, 4, 5, 5, None, None) for t in texts[:3]] + [(9, texts[3]), (9, texts[3]), (8, texts[2] + "z")]
    want = sorted([(d, *x) for (d, _), x in zip(rows, brute_repeats(rows), strict=True)], key=key)
    sizes = sent(monkeypatch)
    assert sorted(removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size=6000), key=key) == want
    assert sizes[0] < 4 * 3000 * 4


# alignment


def brute_alignment(rows):
    a, b = Tokenizer.from_file(AT[0]), sentencepiece.SentencePieceProcessor(model_file=AT[1])
    a.encode_special_tokens = True
    shown, out, count = packing._shown_bytes(), [], Counter()
    for d, text in rows:
        ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        spelled = [bytes(shown[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
        if not text or any(b"".join(s) != (" " + text).encode() for s in spelled):
            out.append((d, 0, 0, 0, [], ""))
            continue
        ends = [dict(zip(np.cumsum([len(x) for x in s]).tolist(), range(len(s)), strict=True)) for s in spelled]
        cuts, at, shown_groups, links = sorted(set(ends[0]) & set(ends[1])), [0, 0], [], []
        for c in cuts:
            to = [e[c] + 1 for e in ends]
            shown_groups.append("|".join(",".join(map(str, ids[k][at[k] : to[k]])) for k in (0, 1)))
            links.append((ids[0][ends[0][c]], ids[1][ends[1][c]]))
            at = to
        count.update(links)
        out.append((d, len(ids[0]), len(ids[1]), len(cuts), links, hashlib.sha256(";".join(shown_groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (_, t), n in count.items():
        best[t] = max(best[t], n)
    return [(d, na, nb, ng, len(x), sum(count[i] == best[i[1]] for i in x), sum(count[i] for i in x), h) for d, na, nb, ng, x, h in out]


def aligned(df):
    return [tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]


def test_alignment_equals_brute_force_on_the_table(spark):
    docs = documents(SMALL)
    rows = list(zip(docs["doc_id"], docs["text"], strict=True))
    assert sorted(aligned(queries.op13_alignment(spark, SMALL))) == sorted(brute_alignment(rows))


def test_alignment_of_odd_rows(spark, tmp_path):
    odd = [" ", "  two  spaces ", "end ", "<|endoftext|> <s> </s> <unk>", "a▁b c", "ﬁ ½ ②", "tab\tand space   x", "x　y z", "emoji 👩‍👩‍👧 é", "don't we'll 12345 -- ...", "a\x00b c", "日本語 テキスト です", "क्ष त्र", "﻿bom here", "x y" * 400]
    rows = [(r["doc_id"], r["text"]) for r in odd_docs(spark).collect() if len(r["text"] or "") < 10_000] + [(100 + k, t) for k, t in enumerate(odd)]
    spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, links int").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(aligned(queries.op13_alignment(spark, str(tmp_path))), key=key) == sorted(brute_alignment(rows), key=key)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert queries.op13_alignment(spark, str(tmp_path / "none")).count() == 0


def test_texts_are_taken_apart_where_both_sides_cut():
    import pyarrow as pa

    both = alignment.sides(*AT)
    assert both.apart and len(both.pairs) < sum(map(len, both.bytes_a)) + sum(map(len, both.bytes_b))
    texts = ["one two", " lead", "trail ", "a  b", "", "x y é z", "n\n o p", "q  r s", "ends. Begins"]
    counts, of, parts = alignment.taken_apart(pa.array(texts), True)
    whole = np.split(of, np.cumsum(counts)[:-1])
    assert [" ".join(parts[k] for k in w) for w in whole] == texts
    a = both.a
    for t, w in zip(texts, whole, strict=True):
        assert [i for k in w for i in a.encode(" " + parts[k])] == (a.encode(" " + t) if t else [])
        assert [i for k in w for i in both.b.encode(parts[k])] == (both.b.encode(t) if t else [])
