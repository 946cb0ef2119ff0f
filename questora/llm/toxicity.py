"""Toxicity: a convolutional text classifier trained in numpy.

A word is the sum of two rows of one hashed embedding table, its own and its stem's (first
letters), so inflected forms of a known stem are known. Filters of several widths slide over the whole text, the best
place of each filter counts (max pooling), and a logistic layer scores the pooled values.
Verdicts use a threshold per language, calibrated on all labelled rows outside the held-out fold,
each scored by a network that did not learn from it; scores never see the language.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_remainder, small_batches, stored, training_rows
from .letters import Words as Pattern

ROWS = 1 << 16
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 16
STEM = 4
#: Bound of the training sample: so many rows of each class, none longer than so many characters.
PER_CLASS = 2000
MAX_CHARS = 20_000
EPOCHS = 8
#: A word or stem is learnt if so many training texts have it.
MIN_TEXTS = 3
#: Parts of the training sample; each is scored for calibration by a network that learnt from the others.
PARTS = 3
#: Bins of calibration scores to one unit of the logit, which lies within 30 of 0.
BINS = 50
_WORD = Pattern(r"[\w{own}]+", "M")


def _row(s: str, salt: int) -> int:
    return 1 + zlib.crc32(s.encode("utf-8", "replace"), salt) % (ROWS - 1)


def word_rows(word: str) -> tuple[int, int]:
    return _row(word, 1), _row(word[:STEM], 2) if len(word) > STEM else _row(word, 1)


class Words:
    """Numbers for words with their two table rows; number 0 is the gap between texts."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.whole, self.stem = array("i", [0]), array("i", [0])

    def __len__(self) -> int:
        return len(self.whole)

    def rows(self, begin: int = 0) -> np.ndarray:
        """The two table rows of each word from number ``begin`` on."""
        return np.stack([np.frombuffer(self.whole[begin:], np.int32), np.frombuffer(self.stem[begin:], np.int32)], 1).astype(np.int64)

    def __call__(self, text: str | None) -> list[int]:
        out, number = [], self.number
        for w in _WORD.findall((text or "").lower()):
            i = number.get(w)
            if i is None:
                i = number[w] = len(self.whole)
                a, b = word_rows(w)
                self.whole.append(a)
                self.stem.append(b)
            out.append(i)
        return out


@dataclass
class Cnn:
    emb: np.ndarray
    conv: list[np.ndarray]  # per width: (width, DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float

    def pooled(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest response of each filter in each text; ``x`` are word vectors, each text followed by gaps."""
        best, acts = [], []
        for w, k, b in zip(WIDTHS, self.conv, self.bias):
            r = x @ k[0]
            for j in range(1, w):
                r[:-j] += x[j:] @ k[j]
            r += b
            acts.append(r)
            best.append(np.maximum.reduceat(r, starts, axis=0))
        return np.maximum(np.concatenate(best, axis=1), 0), acts

    def logits(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self.pooled(x, starts)[0] @ self.out + self.out_bias


def _laid_out(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts in one array, each text followed by gaps as wide as the widest filter less one."""
    gap = [0] * max(1, max(WIDTHS) - 1)
    flat, starts = [], []
    for ids in lists:
        starts.append(len(flat))
        flat += ids
        flat += gap
    return np.array(flat, np.int64), np.array(starts, np.int64)


def train(rows: list[tuple[str, int]], epochs: int = EPOCHS, seed: int = 3) -> Cnn:
    """Adam on weighted log loss; only the winning place of a filter passes a gradient back."""
    rng = np.random.default_rng(seed)
    words = Words()
    lists = [words(t) for t, _ in rows]
    y = np.array([c for _, c in rows], np.float32)
    pairs = words.rows()
    texts_with = np.zeros(ROWS, np.int64)
    for ids in lists:
        texts_with[np.unique(pairs[ids])] += 1 if ids else 0
    known = texts_with >= MIN_TEXTS
    known[0] = False
    emb = (rng.standard_normal((ROWS, DIM)) * 0.1 * known[:, None]).astype(np.float32)
    conv = [(rng.standard_normal((w, DIM, FILTERS)) * np.sqrt(1 / (w * DIM))).astype(np.float32) for w in WIDTHS]
    net = Cnn(emb, conv, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], (rng.standard_normal(len(WIDTHS) * FILTERS) * 0.1).astype(np.float32), 0.0)
    share = float(y.mean())
    cost = np.where(y > 0, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6)) if 0 < share < 1 else np.ones_like(y)
    state: dict = {}
    step = 0

    def adam(key, value, grad, lr=0.01):
        m, v = state.setdefault(key, (np.zeros_like(value), np.zeros_like(value)))
        m *= 0.9
        m += 0.1 * grad
        v *= 0.999
        v += 0.001 * grad * grad
        value -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    second = np.zeros(ROWS, np.float32)  # AdaGrad per table row keeps the update as sparse as the batch
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 32):
            pick = order[at: at + 32]
            flat, starts = _laid_out([lists[i] for i in pick])
            two = pairs[flat]
            x = net.emb[two[:, 0]] + net.emb[two[:, 1]]
            best, acts = net.pooled(x, starts)
            keep = (rng.random(best.shape) < 0.8).astype(np.float32) / 0.8
            p = 1 / (1 + np.exp(-np.clip((best * keep) @ net.out + net.out_bias, -30, 30)))
            g = ((p - y[pick]) * cost[pick] / len(pick)).astype(np.float32)
            step += 1
            g_best = g[:, None] * net.out[None] * keep * (best > 0)
            g_out = (best * keep).T @ g + 1e-4 * net.out
            ends = np.append(starts[1:], len(flat))
            g_x = np.zeros_like(x)
            for n, w in enumerate(WIDTHS):
                gb = g_best[:, n * FILTERS: (n + 1) * FILTERS]
                won = np.stack([s + np.argmax(acts[n][s:e], axis=0) for s, e in zip(starts, ends)])
                g_k = np.zeros_like(net.conv[n])
                for j in range(w):
                    pos = np.minimum(won + j, len(flat) - 1)
                    inside = (won + j < len(flat))[:, :, None]
                    seen = x[pos] * inside
                    g_k[j] = np.einsum("bfd,bf->df", seen, gb)
                    np.add.at(g_x, pos.ravel(), ((gb[:, :, None] * net.conv[n][j].T[None]) * inside).reshape(-1, DIM))
                adam(("k", n), net.conv[n], g_k + 1e-4 * net.conv[n])
                adam(("b", n), net.bias[n], gb.sum(0))
            adam("out", net.out, g_out)
            net.out_bias -= 0.05 * float(g.sum())
            hit = np.flatnonzero(np.abs(g_x).sum(1))
            table = np.concatenate([two[hit, 0], two[hit, 1]])
            u, inv = np.unique(table, return_inverse=True)
            g_e = np.zeros((len(u), DIM), np.float32)
            np.add.at(g_e, inv, np.concatenate([g_x[hit], g_x[hit]]))
            second[u] += (g_e * g_e).mean(1)
            net.emb[u] -= 0.05 * g_e / (np.sqrt(second[u])[:, None] + 1e-6) * known[u][:, None]
    return net


#: Words that a task knows before it begins anew; per worker process, their numbers and vectors by the model that was last used.
KNOWN = 200_000
_cache: dict = {}


def score_batch(net: Cnn, texts: list[str | None], key: int = 0) -> np.ndarray:
    if _cache.get("key") != key or len(_cache["words"]) > KNOWN:
        _cache.update(key=key, words=Words(), vectors=np.zeros((0, DIM), np.float32))
    words = _cache["words"]
    out, lists, size = [], [], 0

    def flush() -> None:
        done = len(_cache["vectors"])
        if len(words) > done:
            two = words.rows(done)
            _cache["vectors"] = np.concatenate([_cache["vectors"], net.emb[two[:, 0]] + net.emb[two[:, 1]]])
        flat, starts = _laid_out(lists)
        out.append(net.logits(_cache["vectors"][flat], starts))

    for text in texts:
        lists.append(words(text))
        size += len(lists[-1])
        if size > 50_000:
            flush()
            lists, size = [], 0
    if lists:
        flush()
    z = np.concatenate(out) if out else np.empty(0)
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def learnt(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> tuple[Cnn | None, list[tuple]]:
    """A network without thresholds, and the sample (text, y, doc_id, lang) it learnt from; None if no row is labelled."""
    rows = training_rows(docs, labels, "toxic", folds, held, PER_CLASS, MAX_CHARS, ("doc_id", "lang"))
    return (train([r[:2] for r in rows]) if rows else None), rows


def calibrate(sample: list[tuple], scored: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> dict[str, float]:
    """Threshold per language: of the cuts between bins of scores, the one of least balanced error.

    All labelled rows outside the held-out fold count. Those outside the training ``sample`` count with their
    score in ``scored(doc_id, lang, score)``, those of the sample with that of a network that learnt from its
    other parts, so no row is judged by a network that saw it. Only counts per language, class and bin reach
    the driver. A language without rows of both classes keeps 0.5.
    """
    kind = scored.schema["doc_id"].dataType.simpleString()
    seen = F.broadcast(scored.sparkSession.createDataFrame([(i,) for i in sorted({r[2] for r in sample})], f"doc_id {kind}"))
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold_remainder(F.col("doc_id"), folds) != held))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")).join(seen, "doc_id", "left_anti")
    )
    found = scored.where("lang IS NOT NULL").select("doc_id", "lang", score_bin(F.col("score")).alias("bin"))
    counts = found.join(known.hint("merge"), "doc_id").groupBy("lang", "y", "bin").agg(F.count("*").alias("n"))
    by: dict[str, dict[int, list[int]]] = {}

    def add(lang: str, y: int, at: int, n: int) -> None:
        by.setdefault(lang, {}).setdefault(at, [0, 0])[y] += n

    for r in counts.collect():
        add(r["lang"], r["y"], r["bin"], r["n"])
    for r, p in zip(*crossed(sample)):
        if r[3] is not None:
            add(r[3], r[1], math.floor(math.log(p / (1 - p)) * BINS), 1)
    return {lang: best_threshold(v) for lang, v in by.items()}


def score_bin(p: Column) -> Column:
    return F.floor(F.log(p / (1 - p)) * BINS).cast("int")


def crossed(sample: list[tuple], parts: int = PARTS) -> tuple[list[tuple], list[float]]:
    """The rows of the sample, and each one's score by a network that learnt from the other parts; a document lies in one part."""
    part = [zlib.crc32(f"part {r[2]}".encode()) % parts for r in sample]
    rows, scores = [], []
    for k in range(parts):
        own, rest = [r for r, x in zip(sample, part) if x == k], [r[:2] for r, x in zip(sample, part) if x != k]
        if own and rest:
            net = train(rest)
            rows += own
            scores += score_batch(net, [r[0] for r in own], zlib.crc32(net.out.tobytes())).tolist()
    _cache.clear()
    return rows, scores


def best_threshold(bins: dict[int, list[int]]) -> float:
    """The cut with the least sum of both error rates, from (clean, toxic) counts per bin; among equals, the one nearest to 0.5."""
    at = sorted(bins)
    clean, toxic = np.array([bins[b] for b in at], np.int64).T
    if not clean.sum() or not toxic.sum():
        return 0.5
    # A cut below each bin and one above all, halfway through the gap to the bin before; and 0.5 itself.
    edges = np.array([at[0], *[(a + 1 + b) / 2 for a, b in zip(at, at[1:])], at[-1] + 1, 0.0])
    below = np.searchsorted(at, edges)
    miss = np.append(0, np.cumsum(toxic))[below] / toxic.sum()
    false = 1 - np.append(0, np.cumsum(clean))[below] / clean.sum()
    cuts = 1 / (1 + np.exp(-edges / BINS))
    return float(min(zip(np.round(miss + false, 6), np.abs(cuts - 0.5), cuts))[2])


def score(docs: DataFrame, net: Cnn | None, extra: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, *extra, score): the chance, 0 to 1, that a text is toxic; whole texts, every row.

    A null or empty text is one gap, scored like any other; without a model every score is 0.
    """
    src = docs.select(F.col(text_col).cast("string").alias("__text"), F.col(id_col).alias("doc_id"), *extra)
    if net is None:
        return src.select("doc_id", *extra, F.lit(0.0).alias("score"))
    return with_score(src, net, "__text", "score", keep_text=False)


def threshold(limits: dict[str, float], lang: Column) -> Column:
    """The calibrated threshold of a language; 0.5 for one that had none, and for null."""
    if not limits:
        return F.lit(0.5)
    pairs = [x for k, v in sorted(limits.items()) for x in (F.lit(k), F.lit(float(v)))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), lang), F.lit(0.5))


def clean(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """``docs`` without the rows that a network learnt from ``labels`` rejects; columns stay.

    Every text is scored once: the scores are written with the rows, calibrate the thresholds and decide.
    Without labelled rows every row stays.
    """
    net, sample = learnt(docs, labels, folds, held)
    if net is None:
        return docs
    with small_batches(docs.sparkSession):
        scored = stored(with_score(docs, net), "scored")
    limits = calibrate(sample, scored.select("doc_id", "lang", F.col("__score").alias("score")), labels, folds, held)
    return scored.where(F.col("__score") < threshold(limits, F.col("lang"))).drop("__score")


def with_score(docs: DataFrame, net: Cnn, text_col: str = "text", name: str = "__score", keep_text: bool = True) -> DataFrame:
    """``docs`` with the chance of its texts to be toxic, and with or without the texts; a null or empty text is one gap."""
    key = zlib.crc32(net.out.tobytes())
    stay = [c for c in docs.columns if keep_text or c != text_col]
    schema = docs.select(*[F.col(f"`{c}`") for c in stay], F.lit(0.0).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [score_batch(net, b.column(text_col).slice(i, 512).to_pylist(), key) for i in range(0, b.num_rows, 512)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in stay), pa.array(np.concatenate(out) if out else np.empty(0))], names=[*stay, name])
        _cache.clear()  # the worker process goes on to other work

    return docs.mapInArrow(run, schema)
