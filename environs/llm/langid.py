"""Language identification by cross-parsing entropy (Ziv and Merhav, 1993).

For each language a suffix automaton of labelled text is built on the driver. A text is parsed against each automaton
into longest matches: a phrase ends where no continuation occurs in the labelled text, and a character that never occurs
there ends one as well. The language with the fewest phrases, each weighted by log2 of its training length, wins.

Training text is a bounded sample, of ``sample_chars`` characters a language shared by ``sample_docs`` documents; prediction
reads every text whole. Texts are cut into blocks of ``BLOCK`` characters and all blocks step through the transitions
together; a block that doesn't begin where the one before it ends is mended, so the phrases are those of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, worker

BLOCK = 512
#: Entries of dense transition tables, for one language and in all; larger alphabets have sorted transitions.
DENSE, DENSE_ALL = 1 << 22, 1 << 24
SAMPLE_DOCS, SAMPLE_CHARS = 64, 8_000
#: Characters parsed at a time in a worker.
AT_ONCE = 3_000_000
_LETTER = regex.compile(r"\p{L}")


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions by state (0 is the start) of the automaton that reads exactly the factors of the sequence."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nexts


class Model:
    """Languages, a code for each character of the training text (0: never seen), and for each language its transitions.

    A language has symbols for its own characters only. Its transitions are a flat table by state and symbol or, where that
    would be large, the sorted keys state * width + symbol with the states they lead to and the states that each symbol
    leads to from the start. States are held as ``state * scale``, with the scale width in a table and 1 otherwise.
    """

    def __init__(self, texts: dict[str, str]):
        chars = sorted({c for t in texts.values() for c in t})
        self.codes = np.zeros(0x110000, np.min_scalar_type(len(chars)))
        for i, c in enumerate(chars, 1):
            self.codes[ord(c)] = i
        self.languages = sorted(texts)
        self.symbols, self.tables, self.bits, room = [], [], [], DENSE_ALL
        for name in self.languages:
            mine, sequence = np.unique(self.encode(texts[name]), return_inverse=True)
            symbols = np.zeros(len(chars) + 1, np.int32)
            symbols[mine] = np.arange(1, len(mine) + 1)
            nexts, width = suffix_automaton((sequence + 1).tolist()), len(mine) + 1
            restart = np.zeros(width, np.int64)
            restart[list(nexts[0])] = list(nexts[0].values())
            if len(nexts) * width <= min(DENSE, room):
                room -= len(nexts) * width
                table = np.repeat(~(restart * width)[None, :], len(nexts), 0)
                for state, to in enumerate(nexts):
                    for c, t in to.items():
                        table[state, c] = t * width
                self.tables.append((table.astype(np.int32).ravel(),))
            else:
                key, to = np.array(sorted((state * width + c, t) for state, row in enumerate(nexts) for c, t in row.items()), np.int64).T
                self.tables.append((np.ascontiguousarray(key), to.astype(np.int32), restart.astype(np.int32), width))
            self.symbols.append(symbols)
            self.bits.append(float(np.log2(max(2, len(texts[name])))))

    def encode(self, text: str) -> np.ndarray:
        return self.codes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    @staticmethod
    def step(table: tuple, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next states or, where the phrase ends, the bitwise complements of the states of the next phrases after the symbols."""
        if len(table) == 1:
            return table[0][state + symbol]
        keys, to, restart, width = table
        key = state.astype(np.int64) * width + symbol
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, to[at], ~restart[symbol])

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (row) in each language (column); none for an empty text.

        All blocks are parsed from the start state first. Then those whose predecessor ends elsewhere are parsed again from
        there, as far as the state differs from the one held, until every block begins where the one before it ends.
        """
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        owner = np.repeat(np.arange(len(texts)), -(-sizes // BLOCK))
        if not len(owner):
            return out
        starts = np.concatenate([np.arange(0, s, BLOCK) for s in sizes if s])
        lengths = np.minimum(BLOCK, sizes[owner] - starts)
        follows = starts > 0
        final = np.r_[~follows[1:], True]
        starts += (np.cumsum(sizes) - sizes)[owner]
        ends = starts + lengths
        order = np.argsort(-lengths, kind="stable")
        flat = np.concatenate(texts)
        active = np.searchsorted(-lengths[order], -np.arange(BLOCK), side="left")  # blocks longer than each offset
        first = starts[order]
        for k, table in enumerate(self.tables):
            symbols = self.symbols[k][flat]
            held, state = np.empty(len(flat), np.int32), np.zeros(len(owner), np.int32)  # what each step gave
            for t in range(int(lengths[order[0]])):
                at = first[: active[t]] + t
                to = self.step(table, state[: len(at)], symbols[at])
                held[at] = to
                state[: len(at)] = to ^ (to >> 31)
            begun, todo = np.zeros(len(owner), np.int32), np.flatnonzero(follows)
            while len(todo):
                to = held[ends[todo - 1] - 1]
                state = to ^ (to >> 31)
                wrong = state != begun[todo]
                todo, state = todo[wrong], state[wrong]
                begun[todo] = state
                block, place = todo, starts[todo]
                changed = []
                while len(block):
                    to, was = self.step(table, state, symbols[place]), held[place]
                    held[place] = to
                    state, old = to ^ (to >> 31), was ^ (was >> 31)
                    place = place + 1
                    over = place == ends[block]
                    changed.append(block[over & (state != old)])
                    on = (state != old) & ~over
                    block, place, state = block[on], place[on], state[on]
                todo = np.concatenate([*changed, np.empty(0, np.int64)]) + 1
                todo = todo[todo < len(owner)]
                todo = todo[follows[todo]]
            last = held[ends[final] - 1]
            ended = np.concatenate([[0], np.cumsum(held < 0)])
            whole = ended[ends[final]] - ended[(np.cumsum(sizes) - sizes)[owner[final]]]
            out[owner[final], k] = whole + ((last ^ (last >> 31)) > 0)
        return out


def held_out(key: str = "doc_id") -> Column:
    """The documents that nothing is learned from: crc32 of the id as text, mod 4, is 2. A null id isn't held out."""
    return F.coalesce(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def level(lengths: list[int], total: int) -> int:
    """The largest bound on each length under which they sum to total at most."""
    left, bound = total, 0
    for i, n in enumerate(sorted(lengths)):
        bound = left // (len(lengths) - i)
        if n > bound:
            return bound
        left -= n
    return max([bound, *lengths])


def learn(docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, seed: int = 5) -> Model:
    """From docs(doc_id, text, lang): the sample_docs documents of each language with the smallest hash of their ids.

    Each gives an equal share of sample_chars, or all it has, from a place that its hash says. There may be any number of languages; the
    sample is sample_chars for each.
    """
    from pyspark.sql import Window

    usable = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("doc_id", F.lit(seed)))
    by_hash = Window.partitionBy("lang").orderBy("h", "doc_id")
    picked = usable.select("doc_id", "lang", "h").withColumn("rank", F.row_number().over(by_hash))
    rows = picked.where(F.col("rank") <= sample_docs).collect()
    wanted = {(r.lang, r.doc_id) for r in rows if r.doc_id is not None}
    start = F.pmod(F.col("h"), F.greatest(F.length("text") - sample_chars, F.lit(0)) + 1) + 1
    part = F.substring("text", start.cast("int"), F.lit(sample_chars))  # a text of more characters isn't read from its beginning
    found = usable.where(F.col("doc_id").isin(sorted({i for _, i in wanted}))).groupBy("lang", "doc_id").agg(F.min("h").alias("h"), F.min(part).alias("text"))
    parts: dict[str, list] = {}
    for r in found.collect():
        if (r.lang, r.doc_id) in wanted:
            parts.setdefault(r.lang, []).append((r.h, r.text.lower()))
    texts: dict[str, str] = {}
    for lang, own in parts.items():
        most = level([len(t) + 1 for _, t in own], sample_chars) - 1
        at = [(h % max(1, len(t) - most + 1), t) for h, t in sorted(own)]
        texts[lang] = "\n".join(t[i : i + most] for i, t in at)
    return Model(texts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text) -> doc_id, lang_pred, score, one row for each row.

    score is (second - best) / second of the weighted phrase counts, 0 for ``und`` and 1 with a single language. Null
    texts, texts without a letter, and all texts under an empty model are ``und``. Ties go to the language that sorts
    first. Equal rows get equal results; other columns are not looked at.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        weight = np.array(m.bits)

        def judged(ids: list[pa.Scalar], codes: list[np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
            names, scores = ["und"] * len(ids), np.zeros(len(ids))
            if m.languages:
                cost = m.phrases(codes) * weight
                best = cost.argmin(1)
                rest = np.sort(cost, 1)
                for i, c in enumerate(codes):
                    if len(c):
                        names[i] = m.languages[best[i]]
                        scores[i] = 1.0 if len(weight) == 1 else (rest[i, 1] - rest[i, 0]) / max(rest[i, 1], 1.0)
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(names), pa.array(scores)], ["doc_id", "lang_pred", "score"])

        none = np.empty(0, m.codes.dtype)
        for b in batches:
            ids, codes, size = [], [], 0
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                t = text.as_py()
                c = m.encode(t.lower()) if t and _LETTER.search(t) else none
                ids.append(i)
                codes.append(c)
                size += len(c)
                if size >= AT_ONCE:
                    yield judged(ids, codes, b.schema.field(0).type)
                    ids, codes, size = [], [], 0
            if ids:
                yield judged(ids, codes, b.schema.field(0).type)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(worker(run), f"doc_id {kind}, lang_pred string, score double")
