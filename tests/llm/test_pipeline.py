"""The pipeline: each stage does its part, the whole equals its stages."""

from __future__ import annotations

import collections
import re
import statistics

import corpus_pipeline
from environs.llm import decontam, hostrules, linededup, mixing, queries

from plain import linked_components, mix_plain, tiles_plain

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        docs = spark.createDataFrame(out.collect(), out.schema)
        sizes.append(docs.count())
        assert docs.columns[: len(columns)] == columns, name
    assert sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[3] < sizes[2] and sizes[4] < sizes[3]
    whole = corpus_pipeline.run(spark, FOLDER)
    assert sorted(r.doc_id for r in whole.collect()) == sorted(r.doc_id for r in docs.collect())


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


SPACE = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def repeated(words):
    """Words in three-word windows that are found twice or more."""
    n = collections.Counter(zip(words, words[1:], words[2:]))
    return len({i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if n[w] > 1 for k in range(3)})


def kept_by_rules(docs):
    words = {i: re.findall(rf"[^{SPACE}]+", d["text"] or "") for i, d in docs.items()}
    failed = {i: len(w) < hostrules.MIN_WORDS or 100 * repeated(w) > hostrules.MAX_REPEAT_PERCENT * len(w) for i, w in words.items()}
    hosts = collections.defaultdict(list)
    for i, d in docs.items():
        hosts[d["source"]].append(failed[i])
    rates = [sum(f) / len(f) for f in hosts.values()]
    mean, var = statistics.fmean(rates), statistics.pvariance(rates)
    strength = min(1e6, max(1.0, mean * (1 - mean) / var - 1))
    rate = {h: (sum(f) + mean * strength) / (len(f) + strength) for h, f in hosts.items()}
    return {i: d for i, d in docs.items() if not failed[i] and rate[d["source"]] <= hostrules.MAX_HOST_RATE}


def without_common_lines(docs):
    key = lambda x: x.strip(SPACE).translate(LOWER)
    where = collections.defaultdict(set)
    for i, d in docs.items():
        for x in (d["text"] or "").split("\n"):
            if len(key(x)) >= linededup.MIN_CHARS:
                where[key(x)].add(i)
    gone = lambda i, x: len(where.get(key(x), ())) >= linededup.MIN_DOCS and max(where[key(x)]) != i
    return {i: d | {"text": "\n".join(x for x in d["text"].split("\n") if not gone(i, x)) if d["text"] is not None else None} for i, d in docs.items()}


def uncontaminated(docs, items):
    plain = lambda t: [w for w in re.sub(r"[\x00-\x7f]", lambda c: c[0].lower() if c[0].isalnum() else " ", t or "").split(" ") if w]
    grams = lambda w: set(zip(*[w[k:] for k in range(decontam.MIN_MATCH)]))
    parts = [(w, grams(w)) for w in map(plain, items)]
    out = {}
    for i, d in docs.items():
        w = plain(d["text"])
        g = grams(w)
        if not any(a and own & g and tiles_plain(a, w, decontam.MIN_MATCH) / len(a) >= decontam.COVERAGE for a, own in parts):
            out[i] = d
    return out


def test_pipeline_against_plain_version(spark):
    """Each stage, worked out by trying everything, on what the plain stage before kept."""
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = {r.doc_id: r.asDict() for r in rows.collect()}
    docs = without_common_lines(kept_by_rules(docs))
    component = linked_components([(i, d["text"]) for i, d in docs.items()], 5, 80)
    docs = {i: d for i, d in docs.items() if component[i][1] == i}
    docs = uncontaminated(docs, [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()])
    listed = [(i, d["text"], d["source"]) for i, d in docs.items()]
    df = spark.createDataFrame(listed, "doc_id long, text string, source string")
    place = {r.doc_id: tuple(r.place) for r in mixing.measured(df, None, 17, None).select("place.doc_id", "place").collect()}
    taken = {listed[n][0]: t for n, t in mix_plain(listed, lambda n: place[listed[n][0]]).items() if t}
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id: r.taken for r in got} == taken
    assert all(r.text == docs[r.doc_id]["text"] for r in got)
