"""Spelling variants: the words of a corpus grouped with the word that they are most likely a slip of.

Two words are near if they differ by one inserted, deleted or replaced code point. They are found by a
self-join of the vocabulary's trie with active nodes: going down the trie, each node carries the nodes whose
strings are at distance one of its own, and where a word ends, the words that end at its active nodes are near.

The trie is dealt out by prefix. Of two near words of at most ``L`` code points either the first ``L // 2`` agree or all
behind them, so each word goes to the subtrie below its prefix and, for a change in the prefix, to the
subtrie of the prefixes in front of one shared rest. A subtrie of over ``SPLIT`` words is dealt out again, by
half of what its words do not share yet, until it is small; of words with two free code points there are
no more than the alphabet allows. Every pair is found in one subtrie, and a subtrie returns one row a word, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A run of letters; of A-Z only the lower case is left when it is looked for.
RUN = r"[a-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_COUNT = 5, 3
#: One run in so many loses a code point, so that the corpus has slips to find.
SLIP = 97
#: A form is at least so many times as frequent as its variant.
TIMES = 2
#: Words of a subtrie beyond which it is dealt out again; over an alphabet of 90 letters two free code points make 8,190.
SPLIT = 10_000
#: Words and code points whose subtries one task works on at once.
ROWS, CHARS = 40_000, 4_000_000
#: Subtries to split up to which their numbers are broadcast, 8 bytes each.
MANY = 1_000_000
#: More than the largest code point.
K = 1 << 21


def slipped(doc_id: Column, run: Column) -> Column:
    """``run`` without one code point where the hash of document and run says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    rest = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % SLIP == 0, rest).otherwise(run)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of whole texts with at least ``MIN_CHARS`` code points and ``MIN_COUNT`` occurrences."""
    lower = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    # A shorter run cannot become a word of MIN_CHARS.
    runs = docs.select(F.col("doc_id"), F.explode(F.regexp_extract_all(lower, F.lit(RUN + "{%d,}" % MIN_CHARS), F.lit(0))).alias("run"))
    words = runs.select(slipped(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= MIN_CHARS)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def _dealt(rows: DataFrame) -> DataFrame:
    """Each word of a subtrie to the two subtries below it: half of the free code points in front agree, or all behind them."""
    free = F.col("size") - F.col("lo") - F.col("hi")
    half = F.floor(free / 2).cast("int")
    below = F.struct((F.col("lo") + half).alias("lo"), F.col("hi").alias("hi"))
    front = F.struct(F.col("lo").alias("lo"), (F.col("hi") + free - half).alias("hi"))
    return _numbered(rows.select("word", "n", "size", F.explode(F.array(below, front)).alias("s")).select("word", "n", "size", "s.*"))


def _numbered(rows: DataFrame) -> DataFrame:
    """With ``g``, a hash of what the words of a subtrie share: largest length, the first ``lo`` and the last ``hi`` code points."""
    word = F.col("word")
    behind = F.substring(word, F.length(word) - F.col("hi") + 1, F.col("hi"))
    return rows.withColumn("g", F.xxhash64("size", "lo", "hi", F.substring(word, F.lit(1), F.col("lo")), behind))


def subtries(words: DataFrame, split: int = SPLIT) -> DataFrame:
    """(word, n, size, lo, hi, g): each word once for each subtrie it is in, as a word of ``size`` code points or one fewer."""
    sized = words.select("word", "n", F.length("word").alias("c"))
    both = sized.select("word", "n", F.explode(F.array(F.col("c"), F.col("c") + 1)).alias("size"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    rows = _dealt(both)
    done = None
    while True:
        large = cut(rows.where(F.col("size") - F.col("lo") - F.col("hi") > 2).groupBy("g").agg(F.count("*").alias("k")).where(F.col("k") > split).select("g"))
        n = large.count()
        if not n:
            return rows if done is None else done.unionByName(rows)
        large = F.broadcast(large) if n <= MANY else large
        small = rows.join(large, "g", "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = cut(_dealt(rows.join(large, "g", "left_semi")))


def near_pairs(group: np.ndarray, parts: list[str], full: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group whose free parts are at distance one: two ``full`` ones, or a full one and one that is a code point shorter.

    ``parts`` are the free parts of the words, ``behind`` the first code point of the shared rest behind them, -1 if there is none.
    Where a code point can be deleted at several places, the last one counts; if that is in the rest, another subtrie has the pair.
    Goes down the tries of all groups level by level. ``same`` holds active nodes of a node's own level, ``less`` those one level up.
    """
    size = np.array([len(p) for p in parts])
    flat, start = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.int64), np.cumsum(size) - size
    node, short = group.copy(), ~full
    level = np.unique(group)  # the keys of this level's nodes: parent * K + code point
    node = np.searchsorted(level, group)
    has_short = np.zeros(len(level), bool)
    has_short[node[short]] = True
    empty = np.empty(0, np.int64)
    same, less, out_a, out_b = (empty, empty), (empty, empty), [], []
    rows = np.arange(len(parts))
    ended = np.full(len(level), -1)
    ended[node[short & (size == 0)]] = rows[short & (size == 0)]
    d = 0
    while len(rows := rows[size[rows] > d]):
        keys, inv = np.unique(node[rows] * K + flat[start[rows] + d], return_inverse=True)
        parent, char = keys // K, keys % K
        n = len(keys)
        first = np.searchsorted(parent, np.arange(len(level) + 1))
        to_full, to_short = np.zeros(n, bool), np.zeros(n, bool)
        to_full[inv[full[rows]]] = True
        to_short[inv[short[rows]]] = True

        def down(pairs: tuple[np.ndarray, np.ndarray], under: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Both nodes one code point further, the same one; the second's children are the nodes with the keys ``under``."""
            u, v = pairs
            many = first[u + 1] - first[u]
            child = np.repeat(first[u] - np.cumsum(many) + many, many) + np.arange(many.sum())
            want = np.repeat(v, many) * K + char[child]
            at = np.minimum(np.searchsorted(under, want), len(under) - 1)
            ok = (under[at] == want) & to_full[child] & goal[at]
            return child[ok], at[ok]

        a, b = [], []
        for step in range(1, int(np.diff(first).max())):  # children of one node, each with each: at most the alphabet's square
            i = np.flatnonzero((parent[step:] == parent[:-step]) & to_full[step:] & to_full[:-step])
            a.append(i)
            b.append(i + step)
        u, v = down(same, keys, to_full) if len(same[0]) else (empty, empty)
        same = np.concatenate([*a, u]), np.concatenate([*b, v])
        u, v = down(less, level, has_short) if len(less[0]) else (empty, empty)
        own = np.flatnonzero(to_full & has_short[parent])
        both = np.unique(np.concatenate([u, own]) * len(level) + np.concatenate([v, parent[own]]))
        less = both // len(level), both % len(level)

        last = rows[size[rows] == d + 1]
        at = inv[size[rows] == d + 1]
        whole, stub = np.full(n, -1), np.full(n, -1)
        whole[at[full[last]]], stub[at[short[last]]] = last[full[last]], last[short[last]]
        for (u, v), ends in ((same, whole), (less, ended)):
            x, y = whole[u], ends[v]
            ok = (x >= 0) & (y >= 0)
            if ends is ended:
                ok &= (parent[u] != v) | (char[u] != behind[x])
            out_a.append(x[ok])
            out_b.append(y[ok])
        node[rows] = inv
        level, has_short, ended = keys, to_short, stub
        d += 1
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (empty, empty)


def _best(rows: list[tuple]) -> pa.RecordBatch:
    """(word, n_near, form_n, form) of the words of some whole subtries that have near words there."""
    number: dict[tuple, int] = {}
    group = np.array([number.setdefault((size, lo, hi, w[:lo], w[len(w) - hi:]), len(number)) for w, _, size, lo, hi in rows])
    alone = np.bincount(group)[group] < 2
    keep = np.flatnonzero(~alone).tolist()
    rows, group = [rows[i] for i in keep], group[keep]
    words, n = [r[0] for r in rows], np.array([r[1] for r in rows], np.int64)
    parts = [w[lo: len(w) - hi] for w, _, _, lo, hi in rows]
    full = np.array([len(w) == size for w, _, size, _, _ in rows], bool)
    behind = np.array([ord(w[len(w) - hi]) if hi else -1 for w, _, _, _, hi in rows], np.int64)
    a, b = near_pairs(group, parts, full, behind) if rows else (np.empty(0, np.int64),) * 2
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    place = np.empty(len(words), np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((place[b], -n[b], a))
    u, at, many = np.unique(a[order], return_index=True, return_counts=True)
    best = b[order][at]
    pick = lambda ids: pa.array([words[i] for i in ids.tolist()], pa.string())
    return pa.RecordBatch.from_arrays([pick(u), pa.array(many, pa.int64()), pa.array(n[best], pa.int64()), pick(best)], names=["word", "n_near", "form_n", "form"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs over rows sorted by ``g``, whole subtries at a time."""
    rows, chars, last = [], 0, None
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("g", "word", "n", "size", "lo", "hi")]
        for g, *row in zip(*cols):
            if g != last and (len(rows) >= ROWS or chars >= CHARS):
                yield _best(rows)
                rows, chars = [], 0
            last = g
            rows.append(row)
            chars += len(row[0])
    if rows:
        yield _best(rows)


def near_words(words: DataFrame, split: int = SPLIT) -> DataFrame:
    """(word, n_near, form_n, form): for each word with near words how many, and of them the most frequent one, ties by code points."""
    rows = subtries(words, split).repartition("g").sortWithinPartitions("g").select("g", "word", "n", "size", "lo", "hi")
    found = rows.mapInArrow(_joined, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form", "form_n"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.form_n", "b.form")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form: what the forms lead to at last. Each round doubles the steps; forms grow in frequency, so there is no ring."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        more = cut(now.join(ahead, "root"))
        if more.isEmpty():
            return now
        now = cut(now.join(more.select("word", "further"), "word", "left").select("word", F.coalesce("further", "root").alias("root")))


def group_variants(docs: DataFrame, split: int = SPLIT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs`` (doc_id, text; other columns are not read).

    ``form`` is the near word of largest n if that is at least ``TIMES`` the word's own, else null; ``root`` is where
    forms lead to, the word itself if it has none. Null and empty texts, and texts without a long run, have no words; a null doc_id
    counts as the text ``null`` in the hash; rows that are repeated count as often. An empty table has no words.
    """
    words = cut(vocabulary(docs))
    near = near_words(words, split)
    good = F.col("form_n") >= TIMES * F.col("n")
    rows = cut(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n")
    ))
    end = roots(rows.where("form IS NOT NULL"))
    return rows.join(end, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
