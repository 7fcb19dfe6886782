"""The corpus pipeline: five stages, each one operator over all documents that the stage before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from environs.llm import decontam, hostrules, jaccard, linededup, mixing
from environs.llm.common import drop, prepare, read, stash

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail their own rules, or whose host does, go."""
    prepare(spark)
    return hostrules.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that several documents have stay in one of them; n_chars follows the text."""
    prepare(spark)
    return linededup.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (shingles of 5 words, similarity 0.8) the document with the smallest doc_id stays."""
    prepare(spark)
    return jaccard.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark, even in pieces, go."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words from, with size, source_size, target, taken and epochs beside their columns,
    as far as these have no such names."""
    prepare(spark)
    taken = mixing.mix(docs, carry=docs.columns).where("taken > 0")
    own = {c.lower() for c in docs.columns}
    return taken.select("row.*", *[c for c in ("size", "source_size", "target", "taken", "epochs") if c not in own])


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder, read by the next, and deleted after that."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stash(stage(spark, docs, sf_dir), name)
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The mix draws by a hash that other databases lack.
ORACLE_SQL: str | None = None
