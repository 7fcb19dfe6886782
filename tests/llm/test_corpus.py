"""Corpus operators against plain versions on small tables, with the odd rows that real tables hold."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from environs.llm import chat, common, decontam, hostrules, importance, jaccard, langid, linededup, mixing, suffixdedup, urlfilter
from environs.llm.suffixarray import permuted_lcp, suffix_array

from plain import linked_components, mix_plain, tiles_plain, water

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, verdict2 string"


def docs_of(spark, rows):
    """(doc_id, text[, source[, lang]]) with clashing further columns."""
    full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", "y") for r in rows]
    return spark.createDataFrame(full, DOCS)


def words(rng, n, k=40):
    return [f"w{rng.randrange(k)}" for _ in range(n)]


def corpus(seed=3, n=60):
    """Random texts with copies, near copies, shared passages, nulls and blanks."""
    rng = random.Random(seed)
    passage = " ".join(words(rng, 30, 1000))
    rows = []
    for i in range(n):
        w = words(rng, rng.choice([3, 12, 60, 200]), 500)
        if i % 4 == 0:
            w += passage.split()
        if i % 7 == 3 and rows:
            w = (rows[rng.randrange(len(rows))][1] or "").split()
            if w:
                w[rng.randrange(len(w))] = "edit"
        rows.append((i * 3, " ".join(w)))
    rows += [(1001, rows[0][1]), (1002, rows[0][1]), (1003, None), (1004, ""), (1005, " \n\t "), (1006, "é" * 100 + "ß" * 60), (1007, "ab" * 90), (1008, "ab" * 95)]
    return rows


# ------------------------------------------------------------------------------------------------ suffix arrays


@pytest.mark.parametrize("seed", range(40))
def test_suffix_array_and_plcp(seed):
    rng = random.Random(seed)
    b = bytes(rng.randrange(rng.choice([1, 2, 3, 200])) for _ in range(rng.randint(1, 150)))
    if seed % 4 == 0:
        b = (b[: rng.randint(1, 9)] * 60)[:150]
    t = np.frombuffer(b, np.uint8)
    want = sorted(range(len(b)), key=lambda i: b[i:])
    sa = suffix_array(t)
    assert sa.tolist() == want
    plcp = permuted_lcp(t, sa)
    for before, i in zip(want, want[1:]):
        n = 0
        while n < len(b) - max(i, before) and b[i + n] == b[before + n]:
            n += 1
        assert plcp[i] == n


def removed(rows, length=50):
    first, out = {}, {}
    for i, text in sorted((r for r in rows), key=lambda r: r[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first.setdefault(b[p : p + length], i) < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, kept)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup(spark, seed, monkeypatch):
    monkeypatch.setattr(suffixdedup, "MERGE_BYTES", 3_000)
    monkeypatch.setattr(suffixdedup, "CHUNK_BYTES", 700)
    monkeypatch.setattr(suffixdedup, "SHARD_BYTES", 900)
    rows = corpus(seed)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixdedup.remove_repeats(docs_of(spark, rows)).collect()}
    assert got == removed(rows)


def test_suffix_dedup_odd_rows(spark):
    a, b = "0123456789" * 12, "abcdefghij" * 12
    got = suffixdedup.remove_repeats(docs_of(spark, [(1, a), (2, a), (2, b), (3, b), (None, a), (4, b)])).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in got) == [(-1, 0), (1, 0), (2, 0), (2, 120), (3, 120), (4, 120)]
    assert suffixdedup.remove_repeats(docs_of(spark, [])).collect() == []


def removed_by_row(rows, length=50):
    """As removed, for rows that may share a doc_id: each row by its own text against the smaller ids."""
    first = {}
    for i, text in sorted(((i, t) for i, t in rows if i is not None), key=lambda r: r[0]):
        b = (text or "").encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    out = []
    for i, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1) if i is not None else ():
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        out.append((i if i is not None else -1, sum(gone), bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out)


def test_suffix_dedup_repeated_ids_long_texts_and_common_anchors(spark, monkeypatch):
    """Rows share ids; texts are longer than a slice; an anchor that all texts have is dealt by whole strings."""
    monkeypatch.setattr(suffixdedup, "SLICE_BYTES", 400)
    monkeypatch.setattr(suffixdedup, "MERGE_BYTES", 2_500)
    monkeypatch.setattr(suffixdedup, "SHARD_BYTES", 700)
    monkeypatch.setattr(suffixdedup, "BUCKET_BYTES", 2_000)
    rng = random.Random(5)
    blank, passage = " " * 40, "".join(rng.choice("abcdefgh ") for _ in range(900))
    rows = []
    for i in range(40):
        t = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(700))) + blank + rng.choice("xyz") * rng.randrange(30)
        at = rng.randrange(800)
        rows.append((rng.randrange(15) if i % 9 else None, t + passage[at : at + rng.randrange(300)] + blank + passage[:60]))
    rows += [(3, rows[0][1]), (3, rows[0][1]), (0, None), (0, ""), (20, passage * 2), (21, passage[100:] + passage)]
    seen = []
    listed = suffixdedup.common_anchors
    monkeypatch.setattr(suffixdedup, "SAMPLE", 1)

    def all_common(docs, n_buckets):
        seen.append(listed(docs, n_buckets))
        texts = [(t or "").encode() for _, t in rows]
        return np.unique(np.concatenate([suffixdedup.stretches([t], t)[3] for t in texts])[::3])

    monkeypatch.setattr(suffixdedup, "common_anchors", all_common)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed, bytes(r.kept)) for r in suffixdedup.remove_repeats(docs_of(spark, rows)).collect())
    assert got == removed_by_row(rows) and len(seen) == 1


def test_intermediate_tables_go(spark):
    """What an operator leaves in the shared folder is the table its result reads, and clear() takes that as well."""
    from environs.storage import clear

    held = vars(spark.sparkContext).setdefault("_environs_tables", set())
    clear(spark)
    assert not held
    rows = corpus(4, 40)
    for run in (lambda: suffixdedup.remove_repeats(docs_of(spark, rows)), lambda: jaccard.join_components(docs_of(spark, rows)), lambda: mixing.mix(docs_of(spark, rows)), lambda: linededup.dedup_lines(docs_of(spark, rows))):
        assert run().count() == len(rows)
        assert len(held) <= 2
        clear(spark)
    assert not held


# ------------------------------------------------------------------------------------------------ n-gram join


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 4, 85), (2, 5, 80), (5, 1, 80)])
def test_ngram_join(spark, seed, k, percent):
    rows = corpus(seed, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_components(docs_of(spark, rows), shingle=k, percent=percent).collect()}
    assert got == linked_components(rows, k, percent)


def test_ngram_join_chain_and_empty(spark):
    """A chain of near copies is one component though its ends don't link; the largest open group takes few comparisons."""
    rng = random.Random(9)
    w = words(rng, 120, 10_000)
    rows = []
    for i in range(30):
        rows.append((i, " ".join(w)))
        w[(i * 4) % 120] = f"new{i}"
    got = {r.doc_id: r.component_id for r in jaccard.join_components(docs_of(spark, rows), shingle=1, percent=85).collect()}
    assert got == {i: c for i, (_, c) in linked_components(rows, 1, 85).items()}
    assert jaccard.join_components(docs_of(spark, [])).collect() == []


def test_one_of_each(spark):
    rows = [(5, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (9, "other words are here now too"), (11, None)]
    kept = jaccard.one_of_each(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 2, 9, 11]


def test_one_of_each_without_or_with_shared_ids(spark):
    """Copies without a doc_id go, also where none of the group has one; other texts without one stay; so with a doc_id used twice."""
    w = [f"w{i}" for i in range(60)]
    near = " ".join([*w[:-1], "edit"])
    alone, other, third = "no copy of this text is here at all", " ".join(f"x{i}" for i in range(60)), " ".join(f"y{i}" for i in range(60))
    rows = [(5, " ".join(w)), (None, " ".join(w)), (None, near), (None, alone), (None, other), (None, other + " more"), (7, third), (7, third + " more"), (None, None)]
    got = jaccard.one_of_each(docs_of(spark, rows)).collect()
    assert sum(r.doc_id is None for r in got) == 3 and sorted(r.doc_id for r in got if r.doc_id is not None) == [5, 7]
    assert alone in {r.text for r in got} and sum((r.text or "").startswith("x0 ") for r in got) == 1


def test_ngram_join_in_blocks(spark, monkeypatch):
    """Small blocks, heavy keys spread over parts, long bitmaps: the same components."""
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 3)
    monkeypatch.setattr(jaccard, "BRIEF_BITS", 64)
    monkeypatch.setattr(common, "PART_ROWS", 3)
    rng = random.Random(21)
    base = words(rng, 120, 10_000)
    rows = corpus(6, 50)
    for i in range(45):
        w = list(base)
        for _ in range(rng.randrange(1, 12)):
            w[rng.randrange(120)] = f"e{rng.randrange(9)}"
        rows.append((2_000 + i, " ".join(w)))
    rows += [(3_000 + i, rows[-1][1]) for i in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_components(docs_of(spark, rows), shingle=2, percent=80).collect()}
    assert got == linked_components(rows, 2, 80)


def test_sets_with_one_name_are_told_apart(spark, monkeypatch):
    """Two sets whose 64-bit names agree stay two."""
    real = jaccard.node_of
    monkeypatch.setattr(jaccard, "node_of", lambda s: (7, real(s)[1]))
    rows = [(1, "a b c d e f"), (2, "g h i j k l"), (3, "a b c d e f"), (4, None), (5, "x")]
    members = jaccard.named_apart(spark.createDataFrame([(i, len(jaccard.shingle_set((t or "").encode(), 5, jaccard.WordHashes())), *jaccard.node_of(jaccard.shingle_set((t or "").encode(), 5, jaccard.WordHashes()))) for i, t in rows], "doc_id long, n long, node long, node2 long"))
    got = {r.doc_id: r.node for r in members.collect()}
    assert got[1] == got[3] != got[2] and got[5] not in (got[1], got[2])


@pytest.mark.parametrize("n", [3, 700, 5_000])
def test_folded_bitmaps_bound_the_overlap(n):
    rng = np.random.default_rng(n)
    a = np.unique(rng.integers(0, 2**64 - 1, n, dtype=np.uint64))
    b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 2**64 - 1, n, dtype=np.uint64)]))
    x, y = jaccard.signature(a), jaccard.signature(b)
    small = min(len(x), len(y))
    differ = int(np.bitwise_count(jaccard.folded(x, small) ^ jaccard.folded(y, small)).sum())
    assert len(np.intersect1d(a, b)) <= (len(a) + len(b) - differ) // 2
    assert (jaccard.folded(x, 16) == jaccard.folded(jaccard.folded(x, 2 * 16), 16)).all()


def test_tiles_cover_pairs():
    """Two sizes that may link share a tile, and a full-size set leaves few parts empty."""
    for percent in (80, 85):
        for n in [*range(1, 200), 600, 5_000]:
            for m in range(n, 100 * n // percent + 1):
                assert set(jaccard.tiles_of(n, percent)) & set(jaccard.tiles_of(m, percent)), (n, m)


# ------------------------------------------------------------------------------------------------ line dedup


def test_line_dedup(spark):
    rng = random.Random(4)
    common = [f"This is a common line number {i} of some length" for i in range(6)]
    rows = []
    for i in range(40):
        lines = [" ".join(words(rng, 9, 1000)) for _ in range(3)]
        lines += [rng.choice(["", " ", "\t"]) + (c.upper() if rng.random() < 0.3 else c) + " " * rng.randrange(3) for c in common if rng.random() < 0.2]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, common[0] + "\n" + common[0]), (104, "short"), (105, "ü" * 40), (106, "ü" * 39)]
    where = collections.defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                where[key(x)].add(i)
    got = {r.doc_id: r for r in linededup.dedup_lines(docs_of(spark, rows)).collect()}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(where.get(key(x), ())) < 5 or max(where[key(x)]) == i]
        r = got[i]
        assert (r.lines.n_lines, r.lines.n_dropped, bytes(r.lines.text).decode()) == (len(lines), len(lines) - len(kept), "\n".join(kept))
    clean = linededup.without_repeats(docs_of(spark, rows))
    assert clean.columns == docs_of(spark, rows).columns
    assert all(r.n_chars == len(r.text or "") for r in clean.collect())
    assert linededup.dedup_lines(docs_of(spark, [])).collect() == []


def test_line_dedup_spreads_heavy_lines(spark, monkeypatch):
    monkeypatch.setattr(common, "PART_ROWS", 2)
    monkeypatch.setattr(linededup, "KNOWN", 0)
    test_line_dedup(spark)


def test_line_dedup_with_many_common_lines(spark, monkeypatch):
    """Beyond the lines that are sent to all tasks, the lines that go are joined: the same result."""
    monkeypatch.setattr(linededup, "KNOWN", 0)
    test_line_dedup(spark)
    test_line_dedup_repeated_rows(spark)


def test_keepers_tell_digests_apart():
    """Digests that begin alike, and none at all."""
    a, b, c = bytes(16), bytes(8) + b"x" * 8, b"z" * 16
    k = linededup.Keepers([c, b, a], [3, 2, 1])
    assert k.gone(1, sorted([a, b, c])) == {b, c} and k.gone(9, [a]) == {a} and k.gone(2, [b, bytes(8) + b"y" * 8]) == set()
    assert linededup.Keepers([], []).gone(1, [a]) == set()


def test_line_dedup_repeated_rows(spark):
    """Rows with one doc_id are one document when they are counted."""
    line = "the very same line of more than forty characters"
    got = linededup.dedup_lines(docs_of(spark, [(1, line)] * 5 + [(None, line)])).collect()
    assert {r.lines.n_dropped for r in got} == {0}
    got = linededup.dedup_lines(docs_of(spark, [(i, line) for i in (1, 2, 3, 4, None)] + [(1, line)])).collect()
    assert sorted((r.doc_id or 0, r.lines.n_dropped) for r in got) == [(0, 1), (1, 1), (1, 1), (2, 1), (3, 1), (4, 0)]


# ------------------------------------------------------------------------------------------------ decontamination


def test_decontamination(spark):
    rng = random.Random(8)
    items = [(i, " ".join(words(rng, 30, 100_000))) for i in range(12)] + [(50, "too short item"), (51, None), (52, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    a = items[0][1].split()
    reordered = " ".join([*a[20:], "filler", *a[:10], "more filler", *a[10:20]])
    rows = [
        (1, " ".join(words(rng, 50, 1000)) + " " + items[3][1].upper() + ". " + "x " * 9), (2, reordered), (3, " ".join(a[:15])), (4, " ".join(words(rng, 300, 1000))), (5, None), (6, ""), (7, "too short item"),
        (8, " ".join(a[i] for i in range(29, -1, -1))), (9, " ".join(f"{x}," for x in a)),
    ]
    got = {r.doc_id: r.leak for r in decontam.measure(docs_of(spark, rows), bench).collect()}
    assert {i for i, leak in got.items() if leak.n_items} == {1, 2, 7, 9}
    assert (got[7].item_id, got[7].coverage) == (50, 1.0)
    assert got[1].item_id == 3 and got[2].item_id == 0 and got[3].coverage == 0.5
    kept = decontam.clean(docs_of(spark, rows), bench)
    assert kept.columns == docs_of(spark, rows).columns and {r.doc_id for r in kept.collect()} == {3, 4, 5, 6, 8}
    assert decontam.clean(docs_of(spark, rows), bench.limit(0)).count() == len(rows)


def test_short_items_are_found_whole(spark):
    bench = spark.createDataFrame([(1, "One two"), (2, "word"), (3, "a b c d"), (4, "..."), (5, "two one")], "item_id long, text string")
    rows = [(1, "zero one, two three"), (2, "one x two"), (3, "a b c"), (4, "x a b c d"), (5, "words"), (6, "Word!"), (7, "...")]
    got = {r.doc_id: (r.leak.n_items, r.leak.item_id) for r in decontam.measure(docs_of(spark, rows), bench).collect()}
    assert got == {1: (1, 1), 2: (0, None), 3: (0, None), 4: (1, 3), 5: (0, None), 6: (1, 2), 7: (0, None)}


def test_decontamination_in_blocks(spark, monkeypatch):
    """A benchmark larger than a block gives the same result."""
    rng = random.Random(1)
    items = [(i, " ".join(words(rng, 20, 10_000))) for i in range(9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(spark, [(i, "before " + items[i][1] + " and " + items[(i + 4) % 9][1]) for i in range(9)] + [(20, "none of it")])
    whole = {r.doc_id: tuple(r.leak) for r in decontam.measure(docs, bench).collect()}
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 200)
    assert {r.doc_id: tuple(r.leak) for r in decontam.measure(docs, bench).collect()} == whole
    assert whole[0] == (2, 0, 1.0) and whole[20] == (0, None, 0.0)


@pytest.mark.parametrize("seed", range(12))
def test_tiling(seed):
    rng = random.Random(seed)
    a = np.array([rng.randrange(3) for _ in range(25)], np.uint64)
    b = np.array([rng.randrange(3) for _ in range(40)], np.uint64)
    k = decontam.MIN_MATCH
    seeds = [(i, j) for i in range(len(a) - k + 1) for j in range(len(b) - k + 1) if (a[i : i + k] == b[j : j + k]).all()]
    i, j = (np.array(x, np.int64) for x in zip(*seeds)) if seeds else (np.empty(0, np.int64),) * 2
    got, want = (decontam.tiled(i, j, a, b) if seeds else 0), tiles_plain(a.tolist(), b.tolist(), k)
    assert abs(got - want) <= k  # ties between tiles of one length may be broken either way


@pytest.mark.parametrize("seed", range(40))
def test_tiling_is_exact(seed):
    """Both ways of tiling mark what trying all pairs of places marks, ties included."""
    rng = random.Random(seed)
    n = rng.choice([2, 3, 5])
    a = np.array([rng.randrange(n) for _ in range(rng.randrange(5, 30))], np.uint64)
    b = np.array([rng.randrange(n) for _ in range(rng.randrange(5, 45))], np.uint64)
    k = decontam.MIN_MATCH
    seeds = [(i, j) for i in range(len(a) - k + 1) for j in range(len(b) - k + 1) if (a[i : i + k] == b[j : j + k]).all()]
    want = tiles_plain(a.tolist(), b.tolist(), k)
    if seeds:
        assert decontam.tiled(*(np.array(x, np.int64) for x in zip(*seeds)), a, b) == want
    assert decontam.scanned(a, b) == want


@pytest.mark.parametrize("limit", [0, 40, 10**6])
def test_decontamination_of_repetitive_texts(limit, monkeypatch):
    """Whatever way a document is judged by, its coverage is the same; a million equal words take little memory."""
    monkeypatch.setattr(decontam, "SEEDS_AT_ONCE", limit)
    rng = random.Random(2)
    items = [(i, " ".join(words(rng, 25, 4)).encode()) for i in range(8)] + [(9, b"a " * 100)]
    block = decontam.Block(items)
    for text in (" ".join(words(rng, 300, 4)).encode(), b"a " * 500 + items[0][1], b"none"):
        h = decontam.hashed_words(decontam.words_of(text), decontam.WordHashes())
        got = dict(block.coverage(h))
        for (i, _), own in zip(items, block.hashes):
            assert got.get(i, 0.0) == tiles_plain(own.tolist(), h.tolist(), decontam.MIN_MATCH) / len(own)
    h = decontam.hashed_words([b"a"] * 1_000_000, decontam.WordHashes())
    if limit:
        assert dict(block.coverage(h)) == {9: 1.0}


# ------------------------------------------------------------------------------------------------ rules, urls, chat


def test_host_rules(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, good, "fine") for i in range(20)] + [(100 + i, "bad text", "farm") for i in range(30)] + [(200, good, "farm"), (201, good, None), (202, None, None), (203, "x y z " * 30, "fine"), (204, "# a $\nline one\n line one\nline one\n\n", "fine")]
    got = {r.doc_id: r for r in hostrules.judge(docs_of(spark, rows)).collect()}
    assert got[0].verdict.kept and not got[100].verdict.kept
    assert not got[200].verdict.base_failed and not got[200].verdict.kept  # its host takes it with it
    assert got[201].verdict.kept and got[202].verdict.base_failed
    assert tuple(got[203].measured) == (90, 90, 0, 0, 90) and got[203].verdict.base_failed
    assert tuple(got[204].measured)[2:4] == (2, 1)
    kept = hostrules.keep(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, rows).columns and kept.count() == 21
    assert hostrules.keep(docs_of(spark, [])).count() == 0


def test_url_filter(spark):
    rows = [
        (1, "http://a.com/x"), (2, "http://EXAMPLE.com/en/1?q"), (3, "https://www.example.com/en/"), (4, "http://a.example.com/fr/"), (5, "http://b.net/es/2#x"), (6, "http://b.net/de/"), (7, None), (8, "no scheme"), (9, "http://notexample.com/en/x"),
        (10, "http://com"), (11, "x://sub.www.example.com/en/z"), (11, "x://sub.www.example.com/en/z"), (12, ""), (13, "http:///en/"), (14, "http://example.com/EN/1"),
    ]
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()]
    by = {r[0]: r[1:] for r in got}
    assert len(got) == len(rows)
    assert by[1] == ("a.com", "/x", "com/", "allow") and by[2] == ("example.com", "/en/1", "example.com/en/", "block") and by[3][2:] == ("www.example.com/en/", "allow") and by[4][2:] == ("com/", "allow")
    assert by[5] == ("b.net", "/es/2", "net/es/", "block") and by[6][2:] == (None, "allow") and by[7] == by[8] == by[12] == ("", "", None, "allow")
    assert by[9][2:] == ("com/", "allow") and by[10][2:] == (None, "allow") and by[11][2:] == ("www.example.com/en/", "allow") and by[13][2:] == (None, "allow") and by[14][2:] == ("com/", "allow")


def test_url_rules_from_a_table(spark, tmp_path):
    """A table of rules gives the file that the list gives; a rule with both verdicts blocks."""
    rules = [("block" if i % 3 else "allow", f"host{i}.com/{'x' * (i % 4)}") for i in range(200)]
    table = spark.createDataFrame([*rules, ("allow", "host1.com/x"), ("block", None)], "verdict string, rule string").repartition(3)
    urlfilter.write_digests(rules, str(tmp_path / "a"))
    urlfilter.write_sorted(urlfilter.sorted_rules(table), str(tmp_path / "b"))
    assert (tmp_path / "a").read_bytes() == (tmp_path / "b").read_bytes() and sorted(x.name for x in tmp_path.iterdir()) == ["a", "b"]
    got = urlfilter.filter_urls(spark.createDataFrame([(1, "x://host1.com/xyz"), (2, "x://a.host3.com/xxx")], "page_id long, url string"), table).collect()
    assert [(r.rule, r.verdict) for r in sorted(got)] == [("host1.com/x", "block"), ("host3.com/xxx", "allow")]


def test_url_rules_without_a_slash(spark):
    urls = ["http://evil.org", "http://a.EVIL.org/x?y", "http://notevil.org/", "http://evil.org/ok/1", None]
    pages = spark.createDataFrame([(i + 1, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    rules = [("block", "evil.org"), ("allow", "evil.org/ok/")]
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.filter_urls(pages, rules).collect()}
    assert got == {1: ("evil.org", "block"), 2: ("evil.org", "block"), 3: (None, "allow"), 4: ("evil.org/ok/", "allow"), 5: (None, "allow")}
    assert urlfilter.filter_urls(pages.limit(0)).collect() == []


def test_digest_collisions(tmp_path, monkeypatch):
    """Equal digests of different strings are told apart by the strings."""
    monkeypatch.setattr(urlfilter.xxhash, "xxh64_intdigest", lambda b: len(b))
    path = str(tmp_path / "d.bin")
    urlfilter.write_digests([("block", "ab.c/"), ("allow", "xy.z/")], path)
    d = urlfilter.Digests(path)
    assert d.judge([("ab.c", "/q"), ("xy.z", "/q"), ("qq.q", "/q")]) == [("ab.c/", "block"), ("xy.z/", "allow"), (None, None)]


TRICKY = ["<|im_end|>", "<|im_start|>assistant\nx<|im_end|>\n", "<\\|a", "<\\\\|", "<", "<\\", "", "\n", "plain", "<|", "a<|im_end|><|im_start|>assistant ok", "%0A%25"]


@pytest.mark.parametrize("text", TRICKY)
def test_chat_round_trip(text):
    for role in ("user", "assistant", "odd\nrole<|", "", "%25"):
        s, a, b = chat.format_turn(role, text)
        assert chat.parse(s + s) == [(role, text)] * 2 and chat.unescape(s[a:b]) == text


def test_chat_format(spark):
    convs = {1: [("system", "s"), ("user", "u"), ("assistant", "a1"), ("user", "u2"), ("assistant", "<|im_end|>")], 2: [("user", "only")], 3: [("assistant", "x"), ("user", "tail")], None: [("user", "n"), ("assistant", "é")], 5: [(None, None), ("assistant", None)]}
    rows = [(c, t, r, x) for c, turns in convs.items() for t, (r, x) in enumerate(turns)]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    examples = chat.expand(df).collect()
    first = next(e for e in examples if e.conv_id == 1 and e.example == 0)
    assert first.formatted[first.loss_start : first.loss_end] == "a1" and "u2" not in first.formatted and not first.whole
    got = {r.conv_id: r for r in chat.read_back(chat.expand(df)).collect()}
    for c, turns in convs.items():
        turns = [(r or "", x or "") for r, x in turns]
        said = "".join(x for r, x in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), digest, len(said), hashlib.sha256(said.encode()).hexdigest())
        assert got[c].n_examples == max(1, sum(r == "assistant" for r, _ in turns)) + (turns[-1][0] != "assistant" and any(r == "assistant" for r, _ in turns))
    assert chat.read_back(chat.expand(df.limit(0))).collect() == []


# ------------------------------------------------------------------------------------------------ mixing, importance, language


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    rng = random.Random(2)
    names = ["b", "a", None, "a10", "a2", "é"]
    rows = [(i, " ".join(["w"] * rng.choice([1, 5, 50])), rng.choice(names + ["b"] * 6)) for i in range(300)] + [(900, None, "a"), (901, "", "zero"), (902, " ", "zero"), (5, "w w", "b"), (5, "w w", "b")]
    got = mixing.mix(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted(map(tuple, mixing.mix(docs_of(spark, rows[::-1])).collect())) == sorted(map(tuple, got))
    source = collections.defaultdict(list)
    for i, t, s in rows:
        source[s].append(len((t or "").split()))
    order = sorted((s for s in source if s is not None)) + [None]
    sizes = [sum(source[s]) for s in order]
    want = dict(zip(order, water(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5, 2)))
    of = {i: s for i, _, s in rows}
    taken = collections.Counter()
    for r in got:
        taken[of[r.doc_id]] += r.taken
        assert r.target == pytest.approx(want[of[r.doc_id]], abs=1e-5) and 0 <= r.taken <= 2 * r.size and r.source_size == sum(source[of[r.doc_id]])
    for s in order:
        assert abs(taken[s] - want[s]) <= 1
    assert mixing.mix(docs_of(spark, [])).collect() == []


def test_mixing_prefers_quality(spark):
    """With one source at half its size, better documents are drawn more often."""
    rows = [(i, "w w w w", "s") for i in range(2000)]
    got = mixing.mix(docs_of(spark, rows), share=0.5, quality=F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0)).collect()
    even = sum(r.taken for r in got if r.doc_id % 2 == 0)
    assert even > 0.7 * sum(r.taken for r in got)


def test_importance(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["good", "fine", "text", "here"]) + str(rng.randrange(5)) for _ in range(40))) for i in range(150)]
    rows += [(1000 + i, " ".join(rng.choice(["junk", "spam"]) + str(rng.randrange(5)) for _ in range(40))) for i in range(50)] + [(2000, None), (2001, "")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 150, 3)] + [(1000 + i, 0, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    got = importance.resample(docs_of(spark, rows), labels, share=0.7).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == int(len(rows) * 0.7)
    assert all(r.doc_id < 150 for r in got if r.kept)
    assert {r.doc_id: r.log_weight for r in got}[2000] is None
    docs = {i: t for i, t in rows}
    ratio = importance.fit(docs_of(spark, rows), [i for i in range(0, 150, 3)])
    known = importance.WordHashes()
    for r in got[:20]:
        k = importance.buckets((docs[r.doc_id] or "").encode(), known)
        if len(k):
            assert r.log_weight == pytest.approx(float(ratio[k].mean()) * importance.SHARPNESS)
    assert importance.resample(docs_of(spark, []), labels).collect() == []


def test_importance_against_plain_version(spark):
    """Models, log ratios and the choice, worked out without the operator's own functions."""
    import math

    import xxhash as xx

    rng = random.Random(16)
    rows = [(i, " ".join(rng.choice(["good", "Fine", "text", "junk", "spam"]) + str(rng.randrange(4)) for _ in range(rng.randrange(0, 40)))) for i in range(90)] + [(500, None), (501, "x"), (501, "x")]
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(0, 60)], "doc_id long, quality int, toxic int")
    m = (1 << 64) - 1

    def mix(x):
        x = (x + 0x9E3779B97F4A7C15) & m
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
        return x ^ (x >> 31)

    def grams(text):
        h = [xx.xxh64_intdigest(w.lower()) for w in (text or "").encode().split()]
        return [mix(x) % importance.BUCKETS for x in h] + [mix((a * 3 + mix(b)) & m) % importance.BUCKETS for a, b in zip(h, h[1:])]

    raw, target = collections.Counter(), collections.Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i < 60 and i % 2 == 0:
            target.update(grams(t))
    n_raw, n_target = sum(raw.values()) + importance.BUCKETS, sum(target.values()) + importance.BUCKETS
    ratio = lambda t: sum(math.log((target[k] + 1) / n_target) - math.log((raw[k] + 1) / n_raw) for k in grams(t))
    got = importance.resample(docs_of(spark, rows), labels, share=0.5).collect()
    noise = {r.doc_id: r.gumbel_key - r.log_ratio for r in got if r.log_ratio is not None}
    want = []
    for i, t in rows:
        want.append((i, ratio(t) if grams(t) else None))
    assert sorted((r.doc_id, r.log_ratio is None) for r in got) == sorted((i, w is None) for i, w in want)
    for r in got:
        if r.log_ratio is not None:
            assert r.log_ratio == pytest.approx(dict(want)[r.doc_id], abs=1e-9)
    order = sorted(want, key=lambda w: (w[1] is None, -((w[1] or 0) + noise.get(w[0], 0)), w[0]))
    assert collections.Counter(r.doc_id for r in got if r.kept) == collections.Counter(i for i, _ in order[: len(rows) // 2])


def test_importance_leaves_toxic_out(spark):
    """Unlabelled good prose with three toxic words goes, though the share has room for all of it; clean prose stays."""
    rng = random.Random(12)
    prose = lambda: [rng.choice(["good", "fine", "text", "here"]) + str(rng.randrange(50)) for _ in range(80)]
    bad = lambda: prose() + [rng.choice(["vile1", "vile2"]) + rng.choice([".", ",", ""]) for _ in range(3)]
    rows = [(i, " ".join(prose())) for i in range(300)] + [(1000 + i, " ".join(bad())) for i in range(100)] + [(2000, None)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 2)] + [(1000 + i, 1, 1) for i in range(0, 100, 2)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in importance.resample(docs_of(spark, rows), labels, share=1.0).collect()}
    assert len(got) == len(rows) and got[2000]
    assert not any(got[1000 + i] for i in range(1, 100, 2))
    assert sum(got[i] for i in range(1, 300, 2)) >= 148
    model = importance.toxic_model(docs_of(spark, rows), labels)
    assert model.words.keys() == {b"vile1", b"vile2"} and model.caught == 1.0 and model.spared >= importance.CLEAN_SHARE


def test_largest_is_exact(spark):
    rng = random.Random(0)
    rows = [(i, rng.choice([None, rng.gauss(0, 1), 0.001])) for i in range(400)]
    got = importance.largest(spark.createDataFrame(rows, "doc_id long, k double"), 0.3, "k").collect()
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))[:120]
    assert sorted(r.doc_id for r in got if r.kept) == sorted(r[0] for r in want)


def phrases_plain(train, text):
    n, i = 0, 0
    while i < len(text):
        j = i
        while j < len(text) and text[i : j + 1] in train:
            j += 1
        n += 1
        i = max(j, i + 1) if j < len(text) and text[j] in train else j + 1
    return n


def test_language(spark):
    rng = random.Random(7)
    syllables = {"aa": ["ba", "be", "bi", "tion "], "bb": ["ko", "ku", "kä", "ung "], "cc": ["zu", "zo", "za ", "çe"]}
    make = lambda lang, n: "".join(rng.choice(syllables[lang]) for _ in range(n))
    rows = [(i, make(lang, rng.choice([30, 400])), "s", lang) for i, lang in enumerate(["aa", "bb", "cc"] * 40)] + [(900, None, "s", "aa"), (901, "123 !", "s", "bb"), (902, "", "s", None), (903, make("bb", 3000), "s", None)]
    docs = docs_of(spark, rows)
    model = langid.learn(docs, sample_docs=8, sample_chars=600)
    assert model.languages == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, _, lang in rows[:120]) and got[903].lang_pred == "bb"
    assert got[900].lang_pred == got[901].lang_pred == got[902].lang_pred == "und" and got[900].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    m = langid.Model({"x": "abracadabra banana", "y": "cab and nab"})
    for _ in range(60):
        t = "".join(rng.choice("abcdnr q") for _ in range(rng.randrange(1, 60)))
        assert m.phrases([m.encode(t)])[0].tolist() == [phrases_plain("abracadabra banana", t), phrases_plain("cab and nab", t)]
    none = langid.predict(docs, langid.learn(docs.where("lang = 'none'"))).collect()
    assert {r.lang_pred for r in none} == {"und"}


@pytest.mark.parametrize("dense", [1 << 26, 0])
def test_language_many_characters(dense, monkeypatch):
    """Two languages of 1,000 characters each, more than any small alphabet: phrases are exact and tell them apart."""
    rng = random.Random(4)
    monkeypatch.setattr(langid, "DENSE", dense, raising=False)
    word = {"hh": [chr(0x4E00 + rng.randrange(1000)) + chr(0x4E00 + rng.randrange(1000)) for _ in range(1500)], "kk": [chr(0xAC00 + rng.randrange(1000)) + chr(0xAC00 + rng.randrange(1000)) for _ in range(1500)]}
    make = lambda lang, n: "".join(rng.choice(word[lang]) for _ in range(n))
    texts = {"aa": "plain latin letters " * 40, "hh": make("hh", 1500), "kk": make("kk", 1500)}
    m = langid.Model(texts)
    for lang in ("hh", "kk"):
        for _ in range(10):
            t = make(lang, 30)
            got = m.phrases([m.encode(t)])[0].tolist()
            assert got == [phrases_plain(texts[x], t) for x in m.languages]
            assert m.languages[int((np.array(got) * m.bits).argmin())] == lang


def test_language_learns_from_all_sampled_documents(spark, monkeypatch):
    """One long document doesn't fill the sample."""
    rows = [(i, f"{chr(0x430 + i)}" * (5000 if i % 2 else 40), "s", "ru") for i in range(30)]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    seen = []
    monkeypatch.setattr(langid, "Model", seen.append)
    langid.learn(docs_of(spark, rows), sample_chars=1500)
    assert {c for _, t, _, _ in rows for c in t} == set(seen[0]["ru"]) - {"\n"} and len(seen[0]["ru"]) <= 1501


@pytest.mark.parametrize("block", [1, 3, 512])
def test_phrases_cross_blocks(block, monkeypatch):
    """Long texts, with phrases over several blocks and among texts of other lengths, are parsed as wholes."""
    rng = random.Random(block)
    monkeypatch.setattr(langid, "BLOCK", block)
    train = {"x": "abracadabra banana " + "abcd" * 30, "y": "cab and nab " + "ab" * 70}
    m = langid.Model(train)
    texts = ["".join(rng.choice(["abcd" * 25, "ab" * 40, "q", "cab ", "banana"]) for _ in range(rng.randrange(60))) for _ in range(12)] + ["", "abcd" * 600]
    assert m.phrases([m.encode(t) for t in texts]).tolist() == [[phrases_plain(train[x], t) for x in "xy"] for t in texts]


def test_numerals_are_no_letters(spark):
    docs = docs_of(spark, [(i, f"der hund und die katze {i}", "s", "de") for i in range(20)])
    model = langid.learn(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs_of(spark, [(1, "½ ② ² 12 _"), (2, "ª"), (3, "² hund"), (4, None)]), model).collect()}
    assert got[1] == ("und", 0.0) and got[4] == ("und", 0.0) and got[2][0] == got[3][0] == "de"
    assert langid.predict(docs.limit(0), model).collect() == []


def test_any_number_of_languages(spark):
    docs = docs_of(spark, [(i, f"wort{i} " * 9, "s", f"l{i:03}") for i in range(400)])
    assert len(langid.learn(docs, sample_chars=60).languages) > 256


def test_held_out(spark):
    import zlib

    got = spark.range(200).withColumnRenamed("id", "doc_id").withColumn("h", langid.held_out()).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_mixing_order_against_plain_version(spark, monkeypatch):
    """The documents with the smallest exponential keys are taken, over bins that are binned again."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 2)
    monkeypatch.setattr(mixing, "BINS", 2)
    rng = random.Random(31)
    rows = [(i, " ".join(rng.choice(["word", "WORD", "漢字", "12"]) for _ in range(rng.choice([0, 1, 4, 30]))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    docs = docs_of(spark, rows)
    keys = {r.doc_id: r.place for r in mixing.measured(docs, None, 17, None).select("place.doc_id", "place").collect()}
    want = mix_plain(rows, lambda n: tuple(keys[rows[n][0]]))
    got = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    assert got == {rows[n][0]: t for n, t in want.items()}
    carried = mixing.mix(docs, carry=docs.columns).select("row.doc_id", "taken").collect()
    assert {r.doc_id: r.taken for r in carried} == got


def test_mixing_repeated_rows_at_the_edge(spark):
    """Rows that are equal in all share what is left at the edge; texts of letters without case weigh as much as others."""
    rows = [(1, "w w w", "s")] * 30 + [(2, "v v", "s")] * 20
    got = mixing.mix(docs_of(spark, rows), share=0.5).collect()
    assert sum(r.taken for r in got) == 65 and all(r.taken <= r.size for r in got)
    weights = spark.createDataFrame([("漢字 日本",), ("abc de",), ("123",)], "text string").select(mixing.letter_share(F.col("text"))).collect()
    assert [r[0] for r in weights] == [1.0, 1.0, 0.25]


CLASH = ["lines", "measured", "verdict", "leak", "gone", "utf8", "row", "id", "host", "rate", "taken", "target", "size", "epochs", "source_size", "__id", "__rate", "__utf8", "__drop", "__part"]


def clashing(spark, rows):
    """doc_id, text, source and columns named like those that operators make."""
    full = [(i, t, s, *[f"{c}-{i}" for c in CLASH]) for i, t, s in rows]
    return spark.createDataFrame(full, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASH))


def test_clashing_names(spark):
    """Columns named like ours come through with their values."""
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"{good} {i}\nthis is one line that many documents have in common {'' if i else 'x'}", "s") for i in range(8)] + [(9, None, None), (9, None, None), (None, "", "s")]
    docs = clashing(spark, rows)
    bench = spark.createDataFrame([(1, "some item that no document has in it at all")], "item_id long, text string")
    for out in (hostrules.keep(docs), linededup.without_repeats(docs), jaccard.one_of_each(docs), decontam.clean(docs, bench), mixing.mix(docs, carry=docs.columns).select("row.*")):
        assert out.columns == docs.columns
        for r in out.collect():
            assert all(r[c] == f"{c}-{r.doc_id}" for c in CLASH)
    assert linededup.dedup_lines(docs).columns[-1] == "lines_1" and decontam.measure(docs, bench).columns[-1] == "leak_1"
    assert hostrules.judge(docs).columns[-2:] == ["measured_1", "verdict_1"] and hostrules.judge(docs).count() == len(rows)
    import corpus_pipeline

    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    assert mixed.columns == docs.columns and {r.taken for r in mixed.collect()} <= {f"taken-{i}" for i, _, _ in rows}


# ------------------------------------------------------------------------------------------------ plans and shapes


def test_mixing_is_native(spark):
    """No Python runs in the mix, and no task orders a whole source."""
    rows = [(i, "w w", "s") for i in range(50)]
    plan = mixing.mix(docs_of(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct"))


def test_largest_group_gives_few_pairs(spark):
    """Near copies that all link meet in pairs in proportion to their number."""
    rng = random.Random(12)
    base = words(rng, 300, 100_000)
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(w)))
    members = jaccard.nodes(docs_of(spark, rows).select("doc_id", "text"), 4).cache()
    buckets = jaccard.shared_buckets(jaccard.keyed(members, 85)).cache()
    info = members.where("bits is not null").select("node", "n", "bits")
    alone = members.select("node", F.col("node").alias("root"))
    assert jaccard.open_pairs(buckets, alone, info, 85, True).where("key is null").count() <= 4 * 150  # a forest for each of four tasks at most
    assert {r.component_id for r in jaccard.join_components(docs_of(spark, rows), shingle=4, percent=85).collect()} == {0}


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_meet(percent):
    """Whatever differs between two sets that link, they have a bucket in common."""
    rng = np.random.default_rng(percent)
    for n in (7, 8, 20, 50, 130, 700):
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**64 - 1, n, dtype=np.uint64) & jaccard.KEPT)
            gone = rng.integers(0, (100 - percent) * n // 100 + 1)
            b = a[rng.permutation(len(a))[gone:]]
            new = rng.integers(0, 2**64 - 1, max(0, (100 - percent) * n // (100 + percent) - gone), dtype=np.uint64) & jaccard.KEPT
            b = np.unique(np.concatenate([b, new]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both) and both < max(len(a), len(b)):
                assert len(np.intersect1d(jaccard.bucket_keys(a, percent), jaccard.bucket_keys(b, percent)))
