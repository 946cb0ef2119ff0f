"""Quality classifier: hashed word n-gram logistic regression, trained follow-the-regularised-leader.

Words, combining marks included, and runs of symbols are tokens, in their own case. A text is the mean of its hashed
uni- and bigrams; its score is the sigmoid of a sparse dot product, taken for a whole batch at
once from the batch's token numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, training_rows
from .letters import Words

DIMS = 1 << 18
#: Bound of the training sample: so many rows of each class, none longer than so many characters.
PER_CLASS = 2000
MAX_CHARS = 20_000
EPOCHS = 3
#: Features are counts over length times this, so that one text's features sum to it.
SCALE = 20.0
_TOKEN = Words(r"[\w{own}]+|[^\w\s{own}]+", "M")
_hash: dict[str, int] = {}


def _numbers(tokens: list[str]) -> np.ndarray:
    known = _hash
    if len(known) > 500_000:
        known.clear()
    out = []
    for t in tokens:
        h = known.get(t)
        if h is None:
            # All capitals and repeated symbols are kinds of their own, whatever the word.
            kind = "A" if len(t) > 1 and t.isupper() else t[0] * min(len(t), 3) if not t[0].isalnum() else ""
            h = known[t] = (zlib.crc32(t.lower().encode("utf-8", "replace")) << 8) | (zlib.crc32(kind.encode("utf-8", "replace")) & 255)
        out.append(h)
    return np.array(out, np.int64)


def features(texts: list[str | None], dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, counts per text): unigrams, kinds and bigrams of kinds and words."""
    idx, sizes = [], []
    for text in texts:
        h = _numbers(_TOKEN.findall(text or ""))
        word, kind = h >> 8, h & 255
        same = word[1:] == word[:-1]
        bigram = np.where(same, 77, word[:-1] * 1_000_003 + word[1:] + 13)
        f = np.concatenate([word * 2 + 1, kind * 7919 + 5, bigram, kind[:-1] * 65_537 + kind[1:] * 257 + 3])
        idx.append(((f * 0x9E3779B97F4A7C1) >> 20) % dims)
        sizes.append(len(f))
    return (np.concatenate(idx) if idx else np.empty(0, np.int64)), np.array(sizes, np.int64)


@dataclass
class Ftrl:
    """Per-coordinate follow-the-regularised-leader for logistic loss."""

    dims: int = DIMS
    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5

    def fit(self, rows: list[tuple[str, int]], epochs: int = EPOCHS) -> np.ndarray:
        """Weights, the last of which is the bias. Rows are taken in their order, again per epoch."""
        z, n = np.zeros(self.dims + 1), np.zeros(self.dims + 1)
        seen = []
        for text, y in rows:
            idx, _ = features([text], self.dims)
            u, c = np.unique(idx, return_counts=True)
            seen.append((np.append(u, self.dims), np.append(c * (SCALE / max(1, len(idx))), 1.0), y))
        share = sum(y for *_, y in seen) / max(1, len(seen))
        cost = {1: 1.0, 0: 1.0} if share in (0.0, 1.0) else {1: 0.5 / share, 0: 0.5 / (1 - share)}
        for _ in range(epochs):
            for u, x, y in seen:
                w = self.weights(z[u], n[u])
                p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
                g = (p - y) * x * cost[y]
                sigma = (np.sqrt(n[u] + g * g) - np.sqrt(n[u])) / self.alpha
                z[u] += g - sigma * w
                n[u] += g * g
        return self.weights(z, n).astype(np.float32)

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)


def score_batch(texts: list[str | None], w: np.ndarray) -> np.ndarray:
    idx, sizes = features(texts, len(w) - 1)
    total = np.concatenate([[0.0], np.cumsum(w[idx], dtype=np.float64)])
    end = np.cumsum(sizes)
    mean = (total[end] - total[end - sizes]) * SCALE / np.maximum(sizes, 1)
    return 1 / (1 + np.exp(-np.clip(mean + w[-1], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> np.ndarray | None:
    """Weights from a bounded sample of the labelled rows outside the held-out fold; None if there are none."""
    rows = training_rows(docs, labels, "quality", folds, held, PER_CLASS, MAX_CHARS)
    return Ftrl().fit(rows) if rows else None


def score(docs: DataFrame, w: np.ndarray | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): the chance, 0 to 1, that a text is of quality; whole texts, every row.

    A null or empty text scores by the bias alone; without a model every score is 0.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if w is None:
        return src.select("doc_id", F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [score_batch(part, w) for part in by_size(b.column(1).to_pylist(), 500_000)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out) if out else np.empty(0))], names=["doc_id", "score"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double")
