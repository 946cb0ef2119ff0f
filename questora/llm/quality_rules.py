"""Quality rules: per-text counts, and lines that too many documents of a host share.

``text_stats`` counts within a text, in Arrow batches. The cross-document part is DataFrame
functions: hashes of normalised lines, made distinct within a document, are counted per
host with map-side sums; the lines above the limit - few per host, as their number is bounded
by a document's lines over the share - come back to the documents as one list per host.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, with_lists
from .site_lines import frequent_lines, line_keys

WINDOW = 5
#: A line is removed if more documents of its host have it than this share, and than this number.
LINE_SHARE = 0.1
LINE_DOCS = 20
#: A document with less than this share of its words left, or fewer words, is depleted.
LEFT_SHARE = 0.3
LEFT_WORDS = 10
_SYMBOL = re.compile(r"[#*$%&|<>]+")
_SPLIT = re.compile("[^\x20\x09-\x0d]+")
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def _repeats(ids: np.ndarray, doc: np.ndarray, n_docs: int, window: int) -> np.ndarray:
    """Per document, words that lie in a window of words found twice or more in it.

    ``ids`` are word numbers and ``doc`` the document of each word, both in text order. Runs of
    2, 4, ... words are numbered pair by pair, so equal numbers mean equal words.
    """
    n = len(ids)
    out = np.zeros(n_docs, np.int64)
    if n < window:
        return out

    def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]

    base = pairs(doc, ids)  # a word in a document
    run, length = base, 1
    while length * 2 <= window:
        run = pairs(run[:-length], run[length:])
        length *= 2
    for k in range(length, window):
        m = len(run) - 1
        run = pairs(run[:m], base[k: k + m])
    inside = doc[: len(run)] == doc[window - 1: window - 1 + len(run)]
    counts = np.bincount(run[inside], minlength=int(run.max()) + 1)
    again = inside & (counts[run] > 1)
    cover = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return np.bincount(doc[np.cumsum(cover[:n]) > 0], minlength=n_docs)


def _stats(texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
    words, numbers, sizes, rows = [], {}, [], []
    for text in texts:
        text = text or ""
        ws = _SPLIT.findall(text)
        sizes.append(len(ws))
        words.extend([numbers.setdefault(w, len(numbers)) for w in ws])
        seen, dup = set(), 0
        for line in text.split("\n") if "\n" in text else ():
            if line.strip(_SPACE):
                if line in seen:
                    dup += 1
                else:
                    seen.add(line)
        rows.append((len(ws), sum(map(len, ws)), sum(map(len, _SYMBOL.findall(text))), dup))
    doc = np.repeat(np.arange(len(texts)), sizes)
    again = _repeats(np.array(words, np.int64), doc, len(texts), WINDOW)
    return [(*r, int(a)) for r, a in zip(rows, again)]


def text_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` columns but the text, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    A null text counts as empty. Texts are worked on in groups of about a million characters;
    a longer text is a group of its own.
    """
    rest = [c for c in docs.columns if c != text_col]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    src = docs.select(F.col(text_col).cast("string").alias("__text"), *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [r for group in by_size(b.column(0).to_pylist(), 1_000_000) for r in _stats(group)]
            cols = [pa.array([r[i] for r in found], pa.int64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *cols], names=[*rest, *names])

    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[1:]] + [f"{n} long" for n in names])
    return src.mapInArrow(run, out)


def apply_rules(docs: DataFrame, share: float = LINE_SHARE, least: int = LINE_DOCS) -> DataFrame:
    """(doc_id, the counts, n_lines_removed, n_words_left, base_failed, kept).

    ``base_failed``: fewer than 10 words, or over 20 in 100 words repeat. A line is removed if
    more than ``least`` documents and more than ``share`` of the documents of its source have
    it; a document is depleted, and not kept, if removal took a line and leaves fewer than
    ``LEFT_WORDS`` words or less than ``LEFT_SHARE`` of them. Rows count as documents each for
    itself, null sources form one host, a null text has no words.
    """
    src = docs.select("doc_id", "source", F.col("text").cast("string").alias("text"))
    often = frequent_lines(src.select(F.col("source").alias("host"), line_keys(F.col("text")).alias("keys")), share, least).withColumnRenamed("host", "source")
    joined = with_lists(src, "source", often, "lines").withColumn("__keys", F.when(F.col("lines").isNotNull(), line_keys(F.col("text"))))
    own = joined.withColumn("__own", F.array_intersect("__keys", "lines"))
    gone = F.filter(F.split(F.col("text"), "\n", -1), lambda _, i: F.coalesce(F.array_contains("__own", F.get("__keys", i)), F.lit(False)))
    # Nothing is removed where the text has no frequent line, so most texts are not split again.
    marked = own.withColumn("__gone", F.when(F.size("__own") > 0, gone))
    slim = marked.select(
        "doc_id", "text", F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_lines_removed"),
        F.when(F.size("__gone") > 0, F.regexp_count(F.array_join("__gone", "\n"), F.lit(r"[^\x20\x09-\x0D]+"))).otherwise(0).cast("long").alias("__removed"),
    )
    s = text_stats(slim)
    left = F.col("n_words") - F.col("__removed")
    base = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    depleted = (F.col("n_lines_removed") > 0) & ((left < LEFT_WORDS) | (left < F.col("n_words") * F.lit(LEFT_SHARE)))
    return s.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_removed", left.alias("n_words_left"),
        base.alias("base_failed"), (~base & ~depleted).alias("kept"),
    )
