"""Vector functions over arrays of numbers."""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from hashlib import md5, sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut
from .text import canonical

THRESHOLD = 0.92
DISJOINT_ANSWERS = 0.97
# Words that do not count as shared between two answers.
ANSWER_STOP = ["the", "a", "an", "of", "and", "in", "on", "at", "to", "for", "is", "by", "or"]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for null, empty or unequally long vectors and for zero vectors."""
    ok = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    n = norm(a) * norm(b)
    return F.when(ok & (n > 0), dot(a, b) / n).otherwise(F.lit(0.0))


def normalised(a: Column, dims: int | None = None) -> Column:
    """Unit length after truncation to ``dims``; null if the vector is shorter or zero."""
    cut = a if dims is None else F.when(F.size(a) >= dims, F.slice(a, 1, dims))
    n = norm(cut)
    return F.when(n > 0, F.transform(cut, lambda x: x.cast("double") / n))


def from_text(c: Column) -> Column:
    """A vector stored as JSON text; empty if it cannot be read."""
    return F.coalesce(F.from_json(c, "array<float>"), F.array().cast("array<float>"))


def to_text(v: Column) -> Column:
    return F.to_json(v)


def rrf(dense: Column, sparse: Column, overlap: Column | None = None, k: float = 60.0) -> Column:
    """Reciprocal rank fusion of two 1-based ranks, lifted by tag overlap."""
    base = 1 / (F.lit(k) + dense) + 1 / (F.lit(k) + sparse)
    return base if overlap is None else base * (1 + F.lit(0.5) * overlap)


def plausible(question: Column, answer: Column, other_question: Column, other_answer: Column, sim: Column, threshold: float = THRESHOLD) -> Column:
    """Whether a near pair can be one question asked twice.

    The similarity must reach the threshold and the other text must not be empty. A short or
    symbolic text must be equal but for punctuation. Where both have an answer, the answers
    must meet: one within the other, a shared word, one in the other's question - or the
    similarity be near-exact.
    """
    q, o = F.trim(F.coalesce(question, F.lit(""))), F.trim(F.coalesce(other_question, F.lit("")))
    a, b = F.trim(F.coalesce(answer, F.lit(""))), F.trim(F.coalesce(other_answer, F.lit("")))
    cq, co, ca, cb = canonical(q), canonical(o), canonical(a), canonical(b)
    thin = (F.length(q) < 15) | (F.regexp_count(q, F.lit("[a-zA-Z]{3,}")) < 3)
    words = lambda c: F.filter(F.split(c, " "), lambda w: (w != "") & ~w.isin(ANSWER_STOP))
    within = lambda x, y: (x != "") & y.contains(x)
    meet = cb.contains(ca) | ca.contains(cb) | F.arrays_overlap(words(ca), words(cb)) | within(ca, co) | within(cb, cq)
    answers = (a == "") | (b == "") | meet | (sim >= DISJOINT_ANSWERS)
    return (sim >= threshold) & (o != "") & (~thin | (cq == co)) & answers


def rounded(x: Column, places: int) -> Column:
    """``x`` to so many places as binary numbers have it, halves away from zero: 41 / 640 times a million is below a half, though its decimal digits are not."""
    return F.round(x * float(10**places)) / float(10**places)


#: Weights of a word's first and second hash, and of each of its runs of three characters, in quarters; sums of these are exact in any order.
WORD, AGAIN, RUN, QUARTER = 4, 2, 1, 0.25
#: Words, and runs of three characters, whose places a task keeps; words that are summed at once.
KNOWN, AT_ONCE = 500_000, 200_000


def hash_embeddings(rows: DataFrame, key: str, text: Column, dims: int = 768) -> DataFrame:
    """(key, embedding) of every row: its words and their runs of three characters, hashed into ``dims`` places, at unit length to six places; a stand-in for a model.

    A text becomes its vector where it lies, and a task hashes a word once for all its rows. A null or empty text is all zeros. Rows of one ``key`` have
    the vector of all their words, and rows without a key, which no key joins, are all zeros; only the keys, and sums of rows whose key is repeated, are shuffled.
    """
    kind = rows.schema[key].dataType.simpleString()
    each = rows.select(F.col(key), F.when(F.col(key).isNotNull(), F.lower(F.coalesce(text, F.lit("")))).otherwise("").alias("t"))
    summed, unit = (lambda batches: _summed(batches, dims, False)), (lambda batches: _summed(batches, dims, True))
    repeated = cut(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNotNull() & (F.col("n") > 1)).select(key))
    if repeated.isEmpty():
        return each.mapInArrow(unit, f"`{key}` {kind}, embedding array<double>")
    sums = each.join(repeated, key, "left_semi").mapInArrow(summed, f"`{key}` {kind}, v array<double>")
    sums = sums.select(key, F.posexplode("v").alias("at", "v")).groupBy(key, "at").agg(F.sum("v").alias("v"))
    merged = sums.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("v"))
    length = norm(F.col("v"))
    merged = merged.select(key, F.transform("v", lambda x: F.when(length > 0, rounded(x / length, 6)).otherwise(0.0)).alias("embedding"))
    alone = each.join(repeated, key, "left_anti").mapInArrow(unit, f"`{key}` {kind}, embedding array<double>")
    return alone.unionByName(rows.select(key).join(merged, key))


class _Runs(dict):
    """Places of runs of three characters."""

    def __init__(self, dims: int):
        self.dims = dims

    def __missing__(self, run: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[run] = place = int.from_bytes(md5(run.encode()).digest()[:4], "big") % self.dims
        return place


class _Places(dict):
    """Words by number, and the places and weights of each in two long lists."""

    def __init__(self, dims: int):
        self.dims, self.runs = dims, _Runs(dims)
        self.ends, self.at, self.weight = array("q", [0]), array("i"), array("d")

    def __missing__(self, w: str) -> int:
        digest, runs = sha256(w.encode()).digest(), self.runs
        at = [runs[w[k: k + 3]] for k in range(len(w) - 2)]
        weight = [RUN] * len(at)
        if len(at) > self.dims:
            # A very long word has no more entries than there are places.
            n = Counter(at)
            at, weight = list(n), [RUN * x for x in n.values()]
        self.at.extend(at)
        self.at.extend((int.from_bytes(digest[:4], "big") % self.dims, int.from_bytes(digest[4:8], "big") % self.dims))
        self.weight.extend(weight)
        self.weight.extend((WORD, AGAIN))
        self.ends.append(len(self.at))
        self[w] = n = len(self)
        return n

    def sums(self, row: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        """The sum of the words of each of ``n`` rows."""
        ends, at, weight = np.frombuffer(self.ends, np.int64), np.frombuffer(self.at, np.int32), np.frombuffer(self.weight)
        k = ends[word + 1] - ends[word]
        entry = np.repeat(ends[word + 1] - np.cumsum(k), k) + np.arange(k.sum())
        return np.bincount(np.repeat(row * self.dims, k) + at[entry], weight[entry], n * self.dims)


def _summed(batches: Iterator[pa.RecordBatch], dims: int, unit: bool) -> Iterator[pa.RecordBatch]:
    """(key, vector) of rows (key, text): sums of weights, or these at unit length to six places."""
    places = _Places(dims)
    for b in batches:
        total = np.zeros(b.num_rows * dims)
        first, rows, words = 0, [], []

        def added(upto: int) -> None:
            """Adds the words so far, of rows ``first`` to ``upto``."""
            nonlocal places, first, rows, words
            if words:
                row = np.repeat(np.array(rows) - first, [len(w) for w in words])
                total[first * dims: (upto + 1) * dims] += places.sums(row, np.fromiter(chain.from_iterable(words), np.int64, len(row)), upto + 1 - first)  # noqa: B023
            first, rows, words = upto, [], []
            if len(places) > KNOWN:
                places = _Places(dims)

        held = 0
        for i, t in enumerate(b.column(1)):
            each = t.as_py().split()
            for at in range(0, len(each), AT_ONCE):
                rows.append(i)
                words.append(list(map(places.__getitem__, each[at: at + AT_ONCE])))
                held += len(words[-1])
                if held >= AT_ONCE:
                    added(i)
                    held = 0
        added(b.num_rows - 1)
        v = total.reshape(-1, dims) * QUARTER
        if unit:
            length = np.sqrt((v * v).sum(1, keepdims=True))
            x = v / np.where(length > 0, length, 1.0) * 1e6
            whole = np.floor(x)
            v = (whole + (x - whole >= 0.5)) / 1e6
        ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * dims)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(v.ravel()))], names=[b.schema.names[0], "embedding" if unit else "v"])
