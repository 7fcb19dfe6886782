"""Operators 11 to 13 against plain versions, with odd rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from environs.llm import divergence, runs, vectorjoin

LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, weight string, rank string, value string"


def docs_of(spark, rows):
    """(doc_id, text[, lang[, source]]) with clashing further columns."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", "x", "y", "z") for r in rows]
    return spark.createDataFrame(full, DOCS)


# ------------------------------------------------------------------------------------------------ 11


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % runs.BUCKETS for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resampled(rows, target):
    found = [(i, *features(t)) for i, t in rows]
    s = collections.Counter(b for _, _, f in found for b in f)
    t = collections.Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in range(10_000)]
    out = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    eligible = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(eligible[: 5 * len(eligible) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def texts(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = [rng.choice(["Wort", "É", "straße", "x9", "l'eau", "a-b", "日本", "Zz"]) + str(rng.randrange(30)) for _ in range(rng.choice([0, 1, 2, 3, 19, 20, 21, 60]))]
        out.append((i, rng.choice([" ", ", ", "\n"]).join(w)))
    return out


def test_target_resampling(spark):
    rows = texts(1, 400) + [(1000, None), (1001, ""), (1002, " ... "), (1003, "ab " * 3000), (None, "w " * 30), (7, "same row " * 20), (7, "same row " * 20), (7, "same row " * 20)]
    target = [t for _, t in texts(2, 15)] + [None, ""]
    got = runs.resample(docs_of(spark, rows), spark.createDataFrame([(t, "x") for t in target], "text string, doc_id string"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == resampled(rows, target)


def test_target_resampling_of_empty_tables(spark):
    none, some = docs_of(spark, []), docs_of(spark, texts(3, 60))
    assert runs.resample(none, some).collect() == []
    assert sorted((tuple(r) for r in runs.resample(some, none).collect()), key=str) == resampled(texts(3, 60), [])


@pytest.mark.parametrize("block", [4, 7, 1 << 19])
def test_texts_longer_than_a_block(block, monkeypatch):
    monkeypatch.setattr(runs, "BLOCK_WORDS", block)
    lists = [runs.words_of(t.encode()) for _, t in texts(4, 40)]
    gain, zeros = np.arange(runs.BUCKETS) * 7 - 5000, runs.Zeros()
    found, counts = np.zeros((2, len(lists)), np.int64), np.zeros(runs.BUCKETS, np.int64)
    for at, b in runs.blocks(iter(lists), zeros):
        for side, x in zip(found, b.sums(gain)):
            np.add.at(side, at, x)
        counts += b.counts()
    want = [features(t)[1] for _, t in texts(4, 40)]
    assert found[0].tolist() == [len(f) for f in want]
    assert found[1].tolist() == [sum(int(gain[b]) for b in f) for f in want]
    assert counts.tolist() == [n for n in np.bincount([b for f in want for b in f], minlength=runs.BUCKETS)]


def test_joined_crc():
    rng, zeros = random.Random(5), runs.Zeros()
    pairs = [(rng.randbytes(rng.randrange(40)), rng.randbytes(rng.choice([0, 1, 7, 200, 5000]))) for _ in range(200)]
    crc = lambda k: np.array([zlib.crc32(p[k]) for p in pairs], np.uint32)
    joined = zeros(crc(0), np.array([len(b) for _, b in pairs])) ^ crc(1)
    assert joined.tolist() == [zlib.crc32(a + b) for a, b in pairs]


# ------------------------------------------------------------------------------------------------ 12


def near_plain(rows, cosine=0.9):
    up, count, by_length = list(range(len(rows))), [0] * len(rows), {}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            by_length.setdefault(len(v), []).append((i, x / np.linalg.norm(x)))
    for group in by_length.values():
        u = np.stack([x for _, x in group])
        for a, b in zip(*np.nonzero(u @ u.T >= cosine)):
            if a != b:
                count[group[a][0]] += 1
                p, q = sorted((find(group[a][0]), find(group[b][0])))
                up[q] = p
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    out = [(k, count[i], least.get(find(i))) for i, (k, _) in enumerate(rows)]
    return sorted(((k, n, c, k == c) for k, n, c in out), key=str)


def clouds(seed, n, width=8):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, width))
    return [(i, [float(x) for x in base[i % 12 if i % 3 else 0] + rng.normal(size=width) * rng.choice([0, 0.05, 0.3, 1])]) for i in range(n)]


ODD = [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [float("nan")] + [1.0] * 7), (2004, [None] + [1.0] * 7), (2005, [1.0] * 3), (2006, [2.0] * 3), (2007, [float("inf")] * 8), (2008, [3e38] * 8), (2009, [1e-40] * 8)]
VECTORS = "vec_id long, embedding array<float>, label int, row string, component_id string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(k, v, 1, "r", "c") for k, v in rows], VECTORS)


@pytest.mark.parametrize("seed", [1, 2])
def test_embedding_dedup(spark, seed, monkeypatch):
    monkeypatch.setattr(vectorjoin, "INTERVAL", 32)
    monkeypatch.setattr(vectorjoin, "FAN", 3)
    rows = clouds(seed, 300) + ODD + [(5, clouds(seed, 6)[5][1]), (None, clouds(seed, 1)[0][1]), (None, None)]
    got = vectorjoin.near_duplicates(vectors_of(spark, rows))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == near_plain(rows)


def test_equal_vectors_are_settled_as_wholes(spark, monkeypatch):
    monkeypatch.setattr(vectorjoin, "INTERVAL", 16)
    seen = []
    plain_meetings = vectorjoin.meetings

    def meetings(levels, eps2):
        pairs, settled = plain_meetings(levels, eps2)
        seen.append((pairs.count(), sum(s.count() for s in settled)))
        return pairs, settled

    monkeypatch.setattr(vectorjoin, "meetings", meetings)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(256)]
    got = vectorjoin.near_duplicates(vectors_of(spark, rows)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(255, 0)}
    assert seen == [(0, 1)]  # one pair of intervals, the top with itself


def test_embedding_dedup_without_vectors(spark):
    assert vectorjoin.near_duplicates(vectors_of(spark, [])).collect() == []
    got = vectorjoin.near_duplicates(vectors_of(spark, [(3, None), (4, [0.0, 0.0])])).collect()
    assert sorted(tuple(r) for r in got) == [(3, 0, 3, True), (4, 0, 4, True)]


@pytest.mark.parametrize("tile", [4, 33])
def test_meeting_of_intervals(tile, monkeypatch):
    monkeypatch.setattr(vectorjoin, "TILE", tile)
    x = np.array([v for _, v in clouds(3, 150)])
    dims = np.array([8] * 75 + [7] * 75)  # as if the second half had other lengths
    x[75:, 7] = 0
    u = vectorjoin.units(x)
    order = np.lexsort(np.floor(u / 0.4).T)
    order = order[np.argsort(dims[order], kind="stable")]
    u, dims, x = u[order], dims[order], x[order]
    near = (u @ u.T >= 0.9) & (dims[:, None] == dims[None, :]) & ~np.eye(150, dtype=bool)
    side = lambda lo, hi: {"rows": np.arange(lo, hi), "dims": dims[lo:hi], "x": x[lo:hi]}
    within = vectorjoin.compared(side(0, 150), None, 0.9, np.zeros(8), np.eye(8))
    assert within.count.tolist() == near.sum(axis=1).tolist()
    two = vectorjoin.compared(side(0, 50), side(50, 150), 0.9, np.zeros(8), np.eye(8))
    assert two.count.tolist() == np.concatenate([near[:50, 50:].sum(axis=1), near[:50, 50:].sum(axis=0)]).tolist()
    for i, j in zip(*np.nonzero(near[:50, 50:])):
        assert two.root[i] == two.root[50 + j]


# ------------------------------------------------------------------------------------------------ 13


def audit_plain(rows, min_docs, top=50):
    groups, df, out = {}, {}, []
    for r in rows:
        lang, source = (r[2] if len(r) > 2 else "en") or "", (r[3] if len(r) > 3 else "s") or ""
        w = [x.translate(LOWER) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r[1] or "")]
        groups.setdefault(lang, {}).setdefault(source, collections.Counter()).update(w)
        df.setdefault(lang, collections.Counter()).update(set(w))
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q, p = share(sum(sources.values(), collections.Counter())), {s: share(c) for s, c in sources.items()}
        for s in sources:
            parts = {"pair": [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s], "term": [(t, p[s][t] - q[t]) for t in kept if sources[s][t] and p[s][t] > q[t]]}
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def spoken(seed, n, sources=7):
    rng = random.Random(seed)
    vocabulary = ["Maison", "été", "x", "Ünder", "don't", "日本", "a1b2"] + [f"{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)]
    return [(i, " ".join(rng.choice(vocabulary[: 20 + 15 * (i % sources)]) for _ in range(rng.randrange(60))), rng.choice(["en", "fr"]), f"s{i % sources}") for i in range(n)]


@pytest.mark.parametrize("sources", [1, 2, 7, 12])
def test_source_divergence(spark, sources, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 16)
    monkeypatch.setattr(divergence, "ROUNDS_AT_ONCE", 3)
    rows = spoken(sources, 260, sources) + [(900, None, "de", "s1"), (901, "", "de", "s2"), (902, "Wort " * 50, "de", None), (903, None, None, None), (904, "hey", "", "s"), (1, "x y " * 400, "en", "s0"), (1, "x y " * 400, "en", "s0")]
    got = divergence.audit(docs_of(spark, rows), min_docs=5, top=10)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == audit_plain(rows, 5, 10)


def test_source_divergence_of_no_rows(spark):
    assert divergence.audit(docs_of(spark, [])).collect() == []


@pytest.mark.parametrize("n", [2, 4, 8, 20, 38])
def test_tournament(spark, n):
    grid = spark.range(n).select(F.col("id").alias("i")).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n - 2))))
    met = grid.select("i", "r", divergence.opponent(F.col("i"), F.col("r").cast("long"), F.lit(n).cast("long")).alias("j")).collect()
    back = {(x.r, x.i): x.j for x in met}
    assert all(back[x.r, x.j] == x.i and x.i != x.j for x in met)
    assert len({(x.i, x.j) for x in met}) == n * (n - 1)


def test_shares_are_exact():
    rng = random.Random(9)
    for total, terms in ((10, 3), (10**9, 1000), (5 * 10**9, 10**6), (7 * 10**14, 10**7), (0, 1)):
        counts = np.array([0, 1, total // 2, total] + [rng.randrange(total + 1) for _ in range(50)], np.int64)
        want = [1 + 10**9 * (int(c) + 5) // (total + 5 * terms) for c in counts]
        assert divergence.parts_per_billion(counts, total, terms).tolist() == want


def test_vectors_round_trip():
    for at, n in (([], []), ([0], [1]), ([0, 5, 70_000], [1, 2**31, 3]), ([3, 9], [2**40, 1])):
        a, b = divergence.unpacked(divergence.packed(np.array(at, np.int64), np.array(n, np.int64)))
        assert a.tolist() == at and b.tolist() == n


# ------------------------------------------------------------------------------------------------ queries


@pytest.mark.parametrize("name", ["op12_embedding_dedup", "op13_source_divergence"])
def test_query_and_its_sql(spark, name):
    """The registered query and its SQL on the smallest tables, and for vectors on a table with links."""
    import duckdb

    from environs.llm import queries

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())
    if name == "op12_embedding_dedup":
        rows = clouds(4, 120) + ODD
        con.sql("drop view embeddings")
        con.execute("create table embeddings (vec_id bigint, embedding float[])")
        con.executemany("insert into embeddings values (?, ?)", [[k, v] for k, v in rows])
        found = con.sql(queries.ORACLE_SQL[name])
        mine = vectorjoin.near_duplicates(vectors_of(spark, rows))
        assert sorted(tuple(r[c] for c in found.columns) for r in mine.collect()) == sorted(found.fetchall())
        assert any(r[found.columns.index("n_links")] for r in found.fetchall())
