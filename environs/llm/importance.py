"""Quality selection by importance resampling (Xie et al., 2023).

Word unigrams and bigrams are hashed into BUCKETS counters. One generative model is the distribution of target text, a
bounded sample of labelled good documents; the other that of the raw corpus, counted over every document. A document's
log ratio is that of its likelihoods under the two, the sum over its n-grams; adding Gumbel noise and taking the k largest draws
k documents without replacement in proportion to the ratios. Beside it stands log_weight, the mean over the n-grams times
``sharpness``, which a text's length doesn't scale; ``tempered`` draws by it instead.

A mean over all n-grams hides a few toxic words in good prose. So words that labelled toxic documents use clearly more
often than other labelled ones are learned as well; a document's toxic score is the sum of their log odds, and none above
the score that CLEAN_SHARE of the labelled clean documents stay under is kept, whatever its weight and whatever room is left.

Counts leave a task as one vector; the model is two vectors of BUCKETS numbers, whatever the corpus. The k-th largest key
is found from a histogram, and only the histogram bin that holds it is ordered.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, WordHashes, hashed_words, mix64, ship, stash, utf8, worker

BUCKETS = 1 << 16
#: Labelled rows that the target model is fitted on, at most.
SAMPLE_ROWS = 5_000
SHARPNESS = 20.0
#: Least likelihood ratio statistic (G squared) of a toxic word, and the clean documents whose scores lie under the verdict's edge.
LEAST_G2, CLEAN_SHARE = 16.0, 0.99
#: What is cut from the ends of a word before it is looked up as a toxic word.
EDGES = b".,;:!?\"'()[]{}|*_-"
#: Words counted in a worker before their counts are handed on.
WORDS_AT_ONCE = 100_000


def buckets(text: bytes | None, known: WordHashes) -> np.ndarray:
    """The bucket of each unigram and bigram of the A-Z lower-cased words."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.int64)
    h = hashed_words(words, known)
    with np.errstate(over="ignore"):
        both = np.concatenate([mix64(h), mix64(h[:-1] * U64(3) + mix64(h[1:]))])
    return (both & U64(BUCKETS - 1)).astype(np.int64)


def fit(docs: DataFrame, target_ids: list) -> np.ndarray:
    """log of target over raw frequency by bucket, smoothed by one count each."""
    wanted = docs.sparkSession.sparkContext.broadcast(set(target_ids))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        known, ids = WordHashes(), wanted.value
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                k = buckets(text.as_py(), known)
                np.add.at(raw, k, 1)
                if i in ids:
                    np.add.at(target, k, 1)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    counts = docs.select("doc_id", utf8("text").alias("text")).mapInArrow(worker(count), "bucket long, raw long, target long")
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def target_sample(labels: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 11) -> list:
    """Ids of at most ``rows`` labelled good documents that aren't toxic, those with the smallest hashes."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    return [r.doc_id for r in good.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(rows).collect()]


class Toxic(NamedTuple):
    """Log odds by word, the score above which a document is toxic, and how the labelled sample fared out of its fold."""

    words: dict[bytes, float]
    edge: float
    caught: float
    spared: float

    def score(self, text: bytes | None) -> float:
        return score(text, self.words)


def bare_words(text: bytes | None) -> set[bytes]:
    """The distinct A-Z lower-cased words without punctuation around them."""
    return {w.strip(EDGES) for w in set(text.lower().split())} - {b""} if text else set()


def score(text: bytes | None, odds: dict[bytes, float]) -> float:
    return float(sum(sorted(odds[w] for w in bare_words(text) & odds.keys()))) if odds else 0.0


def log_odds(words: list[bytes], toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> dict[bytes, float]:
    """The words found in clearly more of the toxic than of the clean documents, from the documents that hold each."""
    if not n_toxic or not n_clean or not words:
        return {}
    p = (toxic + clean) / (n_toxic + n_clean)
    parts = [(toxic, n_toxic * p), (n_toxic - toxic, n_toxic * (1 - p)), (clean, n_clean * p), (n_clean - clean, n_clean * (1 - p))]
    g2 = 2 * sum(np.where(o > 0, o * np.log(np.maximum(o, 1) / np.maximum(e, 1e-12)), 0.0) for o, e in parts)
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return {words[i]: float(odds[i]) for i in np.flatnonzero((odds > 0) & (g2 >= LEAST_G2))}


def toxic_model(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 31) -> Toxic:
    """From at most ``rows`` labelled toxic and as many other labelled documents. The edge is set on halves that the words weren't learned from."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    ids: dict = {}
    for flag in (0, 1):  # a document with both labels is toxic
        found = marked.where(F.col("toxic") == flag).select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(rows)
        ids |= {r.doc_id: flag for r in found.collect()}
    if not any(ids.values()):
        return Toxic({}, 0.0, 0.0, 1.0)
    sample = spark.createDataFrame(list(ids.items()), f"doc_id {kind}, toxic int").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(2)).cast("int"))
    held = stash(docs.select("doc_id", utf8("text").alias("text")).join(F.broadcast(sample), "doc_id"), "labelled").select("text", "toxic", "fold")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed(seen: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in seen], pa.binary()), pa.array([g for _, g in seen], pa.int32()), pa.array(seen.values(), pa.int64())], ["word", "grp", "n"])

        seen: Counter = Counter()
        for b in batches:
            for text, toxic, fold in zip(*b.columns):
                seen.update((w, 2 * fold.as_py() + toxic.as_py()) for w in bare_words(text.as_py()))
                if len(seen) >= WORDS_AT_ONCE:
                    yield handed(seen)
                    seen = Counter()
        yield handed(seen)

    n = Counter({2 * r.fold + r.toxic: r["count"] for r in held.groupBy("fold", "toxic").count().collect()})
    of = [F.sum(F.when(F.col("grp") == g, F.col("n")).otherwise(0)).alias(f"n{g}") for g in range(4)]
    found = held.mapInArrow(worker(count), "word binary, grp int, n long").groupBy("word").agg(*of).where("n1 + n3 >= 2").collect()
    words = [bytes(r.word) for r in found]
    c = np.array([[r.n0, r.n1, r.n2, r.n3] for r in found], np.float64).reshape(-1, 4)
    folds = [log_odds(words, c[:, 2 * f + 1], c[:, 2 * f], n[2 * f + 1], n[2 * f]) for f in (1, 0)]  # those for fold 0 come from fold 1
    shared = spark.sparkContext.broadcast(folds)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [score(text.as_py(), shared.value[fold.as_py()]) for text, _, fold in zip(*b.columns)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out, pa.float64())], ["toxic", "score"])

    scores = held.mapInArrow(worker(judge), "toxic int, score double").collect()
    clean, toxic = (np.array([r.score for r in scores if r.toxic == flag]) for flag in (0, 1))
    edge = float(np.quantile(clean, CLEAN_SHARE, method="higher")) if len(clean) else 0.0
    caught = float((toxic > edge).mean()) if len(toxic) else 0.0
    spared = float((clean <= edge).mean()) if len(clean) else 1.0
    return Toxic(log_odds(words, c[:, 1] + c[:, 3], c[:, 0] + c[:, 2], n[1] + n[3], n[0] + n[2]), edge, caught, spared)


def weigh(docs: DataFrame, ratio: np.ndarray, sharpness: float = SHARPNESS, toxic: Toxic | None = None) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_grams, log_ratio, log_weight, toxic; texts without a word have neither (null)."""
    shared = docs.sparkSession.sparkContext.broadcast((ratio, toxic))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (r, model) = WordHashes(), shared.value
        for b in batches:
            n, total, w, bad = [], [], [], []
            for text in b.column(1):
                t = text.as_py()
                k = buckets(t, known)
                n.append(len(k))
                total.append(float(r[k].sum()) if len(k) else None)
                w.append(float(r[k].mean() * sharpness) if len(k) else None)
                bad.append(model is not None and model.score(t) > model.edge)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(total, pa.float64()), pa.array(w, pa.float64()), pa.array(bad, pa.bool_())], ["doc_id", "n_grams", "log_ratio", "log_weight", "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", utf8("text").alias("text")).mapInArrow(worker(run), f"doc_id {kind}, n_grams long, log_ratio double, log_weight double, toxic boolean")


#: Bins in each doubling of a key's size.
BINS = 512


def largest(rows: DataFrame, share: float, key: str) -> DataFrame:
    """rows with a boolean ``kept``: the floor(share * n) rows with the largest keys (null keys last; ties by doc_id).

    Only the bin that holds the last of them is ordered: bins are equal steps of the logarithm of 1 + the key's size, on either side of 0.
    """
    size = F.floor(F.log2(F.lit(1.0) + F.least(F.abs(F.col(key)), F.lit(1e15))) * BINS)
    bin_of = F.when(F.col(key).isNull(), F.lit(-1_000_000)).when(F.col(key) < 0, -1 - size).otherwise(size).cast("long")
    rows = rows.withColumn("__bin", bin_of)
    bins = sorted(rows.groupBy("__bin").count().collect(), key=lambda r: -r[0])  # at most 2 * 50 * BINS bins
    left = int(sum(r[1] for r in bins) * share)
    edge, room = None, 0
    for b, n in bins:
        if n > left:
            edge, room = b, left
            break
        left -= n
    if edge is None:
        return rows.withColumn("kept", F.lit(True)).drop("__bin")
    rest = rows.where(F.col("__bin") != edge).withColumn("kept", F.col("__bin") > edge)
    at = rows.where(F.col("__bin") == edge).withColumn("kept", F.row_number().over(Window.partitionBy("__bin").orderBy(F.desc(key), "doc_id")) <= room)
    return rest.union(at).drop("__bin")


def resample(docs: DataFrame, labels: DataFrame, *, share: float = 0.75, sharpness: float = SHARPNESS, tempered: bool = False, seed: int = 23) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, quality, toxic) -> doc_id, n_grams, log_ratio, log_weight, gumbel_key, kept.

    share of the documents is drawn, of those that aren't judged toxic; where too few are left, fewer are kept. Null and
    empty texts have a null ratio and come after all others that may be kept. Equal rows share their noise
    and are drawn next to each other. Without labelled good documents all ratios are near 0, up to smoothing. Other columns aren't looked at.
    """
    ship(docs.sparkSession)
    ratio = fit(docs, target_sample(labels))
    scored = stash(weigh(docs, ratio, sharpness, toxic_model(docs, labels)), "importance")
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    keyed = scored.withColumn("gumbel_key", F.col("log_weight" if tempered else "log_ratio") - F.log(-F.log(u)))
    place = F.when(~F.col("toxic"), F.coalesce("gumbel_key", F.lit(-1e15)))  # the toxic ones have none
    drawn = largest(keyed.withColumn("__place", place), share, "__place")
    return drawn.select("doc_id", "n_grams", "log_ratio", "log_weight", "gumbel_key", (F.col("kept") & ~F.col("toxic")).alias("kept"))
