"""Language identification word by word with a linear-chain conditional random field.

Each word has features: itself if it is in the learnt lexicon, prefixes and suffixes, and
character n-grams. A chain's score adds feature weights and learned transition weights
between neighbouring languages; forward-backward gives every word's chance of each language,
so text that switches language is labelled where it switches. A document's language is the
one with the largest mean chance over its words.

A word is a run of letters and combining marks, so vowel signs and tone marks belong to it. A run of over ``PIECE``
characters, as in scripts written without spaces, counts as several words, so every letter and mark of a text has its say.

Training labels are those of whole documents. Chains are sewn together from stretches of
different documents, so that the transitions learn what a switch costs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_size, cut, fold_remainder
from .letters import Words

#: Rows of the weight table; fewer where it would have over ``CELLS`` cells, but ``LEAST_FEATURES`` at any rate.
FEATURES, CELLS, LEAST_FEATURES = 1 << 17, 1 << 24, 1 << 12
#: Words of a chain; a text is a row of chains, none of it left out.
CHAIN = 64
#: Letters of a word; a longer run is cut into successive words.
PIECE = 24
#: Bound of the training sample: so many documents per language, fewer if there are so many languages that ``SAMPLE`` documents
#: would not do, but ``LEAST`` at any rate; of each a stretch of at most ``MAX_CHARS`` characters, less where
#: the sample would have over ``SAMPLE * MAX_CHARS``. The ``LANGS`` languages of most documents are learnt: a column with more values than that is not
#: one of languages, and the model grows with their square.
PER_LANG, SAMPLE, LEAST, LANGS = 300, 20_000, 20, 2_000
MAX_CHARS = 6_000
EPOCHS = 3
#: A word is in the lexicon if so many training documents have it.
LEXICON_DOCS = 5
#: Numbers in a table of chances that is worked on at once.
ROOM = 4_000_000
_WORD = Words("[{own}]{1,%d}" % PIECE, "LM")


class Hashed(dict):
    """Feature numbers of one kind of string, each string hashed once; forgotten when there are too many."""

    def __init__(self, kind: str) -> None:
        super().__init__()
        self.seed = zlib.crc32(kind.encode())

    def __missing__(self, s: str) -> int:
        if len(self) > 300_000:
            self.clear()
        f = self[s] = zlib.crc32(s.encode("utf-8", "replace"), self.seed) % FEATURES
        return f


_three, _one, _prefix, _suffix, _whole = (Hashed(kind) for kind in "31psw")


def word_features(w: str, lexicon: frozenset) -> list[int]:
    marked = f"^{w}$"
    out = [_three[marked[i: i + 3]] for i in range(len(marked) - 2)]
    out += [_one[c] for c in dict.fromkeys(w)]
    out += [_prefix[w[:2]], _prefix[w[:3]], _suffix[w[-2:]], _suffix[w[-3:]]]
    if w in lexicon:
        out.append(_whole[w])
    return out


@dataclass
class Crf:
    langs: list[str]
    weights: np.ndarray  # (rows, languages); the rows are a power of two, and a feature's row its number modulo that
    moves: np.ndarray  # (languages, languages)
    lexicon: frozenset

    def emissions(self, words: list[str]) -> np.ndarray:
        feats = [word_features(w, self.lexicon) for w in words]
        sizes = np.array([len(f) for f in feats])
        flat = np.concatenate([np.array(f) for f in feats]) % len(self.weights)
        return np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes, axis=0)


def chances(e: np.ndarray, length: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each word's chance of each language (chains, time, languages), for chains padded at the
    end, by forward-backward; and the forward, backward and emission factors."""
    t_max = e.shape[1]
    x = np.exp(e - e.max(2, keepdims=True))
    a = np.exp(moves)
    alpha, beta = np.empty_like(x), np.ones_like(x)
    alpha[:, 0] = x[:, 0]
    for t in range(1, t_max):
        v = (alpha[:, t - 1] @ a) * x[:, t]
        alpha[:, t] = v / v.sum(1, keepdims=True)
    for t in range(t_max - 2, -1, -1):
        v = (x[:, t + 1] * beta[:, t + 1]) @ a.T
        v /= v.sum(1, keepdims=True)
        beta[:, t] = np.where((t + 1 < length)[:, None], v, 1.0)
    post = alpha * beta
    post /= post.sum(2, keepdims=True)
    return post, alpha, beta, x


def expected_moves(alpha: np.ndarray, beta: np.ndarray, x: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """How often full chains are expected to go from one language to the next."""
    after, a = x[:, 1:] * beta[:, 1:], np.exp(moves)
    before = alpha[:, :-1] / (((alpha[:, :-1] @ a) * after).sum(2, keepdims=True))
    k = len(moves)
    return a * (before.reshape(-1, k).T @ after.reshape(-1, k))


def table_rows(langs: int) -> int:
    """Rows of the weight table for so many languages."""
    rows = FEATURES
    while rows * langs > CELLS and rows > LEAST_FEATURES:
        rows //= 2
    return rows


def train(rows: list[tuple[str, str]], epochs: int = EPOCHS, seed: int = 5) -> Crf | None:
    """Gradient ascent (AdaGrad) on the chains' log likelihood."""
    rng = np.random.default_rng(seed)
    texts = [(_WORD.findall(t.lower()), lang) for t, lang in rows]
    texts = [(w, lang) for w, lang in texts if w]
    if not texts:
        return None
    langs = sorted({lang for _, lang in texts})
    seen: dict[str, int] = {}
    for w, _ in texts:
        for x in set(w):
            seen[x] = seen.get(x, 0) + 1
    lexicon = frozenset(x for x, n in seen.items() if n >= LEXICON_DOCS)
    number: dict[str, int] = {}
    docs = [(np.array([number.setdefault(x, len(number)) for x in w]), langs.index(lang)) for w, lang in texts]
    k = len(langs)
    n_rows = table_rows(k)
    feats = [np.array(word_features(x, lexicon)) % n_rows for x in number]
    # Stretches of 4 to 40 words, in random order: neighbours are of the same language or of another.
    pieces = []
    for ids, lang in docs:
        at = 0
        while at < len(ids):
            n = int(rng.integers(4, 41))
            pieces.append((ids[at: at + n], lang))
            at += n
    # Each stretch goes among those of its own language, or now and then of another, in random order.
    own = np.array([lang for _, lang in pieces])
    home = np.where(rng.random(len(own)) < 0.3, rng.integers(k, size=len(own)), own)
    stay = np.lexsort((rng.random(len(own)), home))
    ids = np.concatenate([pieces[i][0] for i in stay])
    gold = np.concatenate([np.full(len(pieces[i][0]), pieces[i][1]) for i in stay])
    # The last chain is filled up from the front, so no word is left out.
    n_chains = -(-len(ids) // CHAIN)
    ids, gold = np.resize(ids, (n_chains, CHAIN)), np.resize(gold, (n_chains, CHAIN))
    w, moves = np.zeros((n_rows, k), np.float32), np.zeros((k, k))
    w2, m2 = np.full((n_rows, k), 1e-3, np.float32), np.full((k, k), 1e-2)
    for _ in range(epochs):
        for pick in np.array_split(rng.permutation(n_chains), max(1, n_chains // 32)):
            batch, y = ids[pick], gold[pick]
            words, inv = np.unique(batch, return_inverse=True)
            fl = [feats[i] for i in words]
            sizes = np.array([len(f) for f in fl])
            flat = np.concatenate(fl)
            e = np.add.reduceat(w[flat], np.cumsum(sizes) - sizes, axis=0)[inv.reshape(batch.shape)]
            post, alpha, beta, x = chances(e, np.full(len(batch), batch.shape[1]), moves)
            pair = expected_moves(alpha, beta, x, moves)
            g_tok = post.reshape(-1, k).copy()
            g_tok[np.arange(y.size), y.ravel()] -= 1
            g_word = np.zeros((len(words), k))
            np.add.at(g_word, inv.ravel(), g_tok)
            u, where = np.unique(flat, return_inverse=True)
            g_f = np.zeros((len(u), k), np.float32)
            np.add.at(g_f, where, np.repeat(g_word, sizes, axis=0))
            g_f /= len(batch)
            w2[u] += g_f * g_f
            w[u] -= 0.3 * g_f / np.sqrt(w2[u])
            np.subtract.at(pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            g_m = pair / len(batch)
            m2 += g_m * g_m
            moves -= 0.1 * g_m / np.sqrt(m2)
    return Crf(langs, w, moves, lexicon)


_cache: dict = {}


def label_words(crf: Crf, texts: list[str | None], key: int = 0) -> list[np.ndarray]:
    """For each text the chances (words, languages) of its words, by forward-backward over its chains."""
    if _cache.get("key") != key or len(_cache["number"]) > max(20_000, min(400_000, 4 * ROOM // len(crf.langs))):
        _cache.update(key=key, number={}, table=np.zeros((0, len(crf.langs)), np.float32))
    number = _cache["number"]
    lists, fresh = [], []
    for text in texts:
        ids = []
        found = _WORD.findall((text or "").lower())
        # Marks alone are no letters.
        if found and not found[0].isalpha() and not any(c.isalpha() for w in found for c in w):
            found = []
        for w in found:
            i = number.get(w)
            if i is None:
                i = number[w] = len(number)
                fresh.append(w)
            ids.append(i)
        lists.append(ids)
    if fresh:
        _cache["table"] = np.concatenate([_cache["table"], crf.emissions(fresh)])
    sizes = [len(ids) for ids in lists]
    total = sum(sizes)
    if not total:
        return [np.empty((0, len(crf.langs))) for _ in lists]
    flat = np.fromiter((i for ids in lists for i in ids), np.int64, total)
    # Chains: each text cut every CHAIN words. Those of like length are worked on together, so many at a time that a table of chances stays small.
    starts = np.array([begin + at for begin, n in zip(np.cumsum([0, *sizes[:-1]]).tolist(), sizes) for at in range(0, n, CHAIN)])
    lengths = np.array([min(CHAIN, n - at) for n in sizes for at in range(0, n, CHAIN)])
    order, k = np.argsort(lengths, kind="stable"), len(crf.langs)
    out, at = np.empty((total, k)), 0
    while at < len(order):
        some = order[at: at + max(1, ROOM // (CHAIN * k))]
        at += len(some)
        width = int(lengths[some].max())
        slot = np.arange(width)[None] < lengths[some][:, None]
        words = (starts[some][:, None] + np.arange(width)[None])[slot]
        e = np.zeros((len(some), width, k))
        e[slot] = _cache["table"][flat[words]]
        out[words] = chances(e, lengths[some], crf.moves)[0][slot]
    return np.split(out, np.cumsum(sizes)[:-1])


def fit(docs: DataFrame, folds: int = 3, held: int = 1) -> Crf | None:
    """A model from a bounded sample of the rows with a language outside the held-out fold.

    At most ``PER_LANG`` documents of each language, those whose ids hash lowest, of whichever length: of a long text a stretch
    from a place that its id's hash says. Rows that repeat a doc_id and a language are one document.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (fold_remainder(F.col("doc_id"), folds) != held))
    known = known.select("doc_id", "lang", F.xxhash64("doc_id", F.lit(17)).alias("h"))
    counts = cut(known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS))
    k = counts.count()
    if not k:
        return None
    most = max(LEAST, min(PER_LANG, SAMPLE // k))
    chars = min(MAX_CHARS, SAMPLE * MAX_CHARS // (k * most))
    # Some four times as many as are wanted are let through by the hash alone, so that ranking a language, however large, sees few rows.
    among = F.col("n") * (F.col("h") / F.lit(float(2**64)) + 0.5)
    few = known.join(F.broadcast(counts), "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    picked = few.where(among < 4 * most + 100).select("doc_id", "lang", "h").distinct().withColumn("r", rank).where(F.col("r") <= most).select("doc_id", "lang").withColumnRenamed("lang", "__lang")
    rows = docs.select("doc_id", "lang", F.col("text").cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL").join(F.broadcast(picked), "doc_id").where("lang = __lang")
    begin = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.greatest(F.length("text") - chars, F.lit(0)) + 1).cast("int") + 1
    one = rows.select("doc_id", "lang", F.substring(F.col("text"), begin, F.lit(chars)).alias("text")).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    got = sorted((r["doc_id"], r["lang"], r["text"]) for r in one.collect())
    return train([(t, lang) for _, lang, t in got])


def predict(docs: DataFrame, crf: Crf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, n_words, n_switches): the language of each whole text.

    ``score`` is the mean chance of that language over the words, ``n_switches`` how often
    neighbouring words' likeliest languages differ. A text that is null or has no letter, and any text when there is no model,
    is ``und`` with score 0.
    """
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if crf is None:
        return src.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_switches"))
    key = zlib.crc32(crf.moves.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, n, switches = [], [], [], []
            for part in by_size(b.column(1).to_pylist(), max(20_000, min(500_000, ROOM // len(crf.langs)))):
                for p in label_words(crf, part, key):
                    if len(p):
                        mean, best = p.mean(0), p.argmax(1)
                        i = int(mean.argmax())
                        lang.append(crf.langs[i])
                        score.append(float(min(1.0, mean[i])))
                        switches.append(int((best[1:] != best[:-1]).sum()))
                    else:
                        lang.append("und")
                        score.append(0.0)
                        switches.append(0)
                    n.append(len(p))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(n, pa.int64()), pa.array(switches, pa.int64())], names=["doc_id", "lang_pred", "score", "n_words", "n_switches"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, n_words long, n_switches long")
