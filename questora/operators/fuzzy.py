"""Nearest names by Ratcliff-Obershelp ratio, without comparing all with all: fuzzy search keys and topics snapped to a vocabulary."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .lineage import cut

KEY_RATIO, NAME_RATIO = 0.75, 0.82
#: Weights in a bag of words: of a key that a misspelt word stands for, beside its count, and of a key's related words.
MATCHED, RELATED = 0.8, 0.4
#: A shorter word is taken as it is.
LEAST = 4
#: Keys of several words up to which they are looked for in requests.
PHRASES = 2_000


def least_matches(a: int, b: int, ratio: float) -> int:
    """Characters that strings of these lengths match at least if their ratio is ``ratio`` or more."""
    n, m = a + b, int(ratio * (a + b) / 2)
    while 2.0 * m / n < ratio:
        m += 1
    return m


#: Tokens whose frequency decides their order; the others come first, as if no key had them.
ORDERED = 200_000


def tokens(s: str, k: int) -> list[int]:
    """Numbers for the runs of ``k`` characters of a string; the second of a kind has another number than the first."""
    seen: Counter = Counter()
    out = []
    for i in range(len(s) - k + 1):
        x = s[i: i + k]
        seen[x] += 1
        out.append(zlib.crc32(f"{x}\x00{seen[x]}".encode("utf-8", "replace")))
    return out


def signatures(s: str, lengths: list[int], ratio: float, often: dict[int, int] | None = None) -> Iterator[tuple[int, int, list[int]]]:
    """(other length, matches needed, tokens) such that two strings of at least this ratio have one of the tokens in common.

    Matched characters lie in blocks, and between two blocks a character of one string or the other is unmatched, so ``m`` matches of strings
    of ``n`` characters together leave at least ``m - (n - 2 m) - 1`` pairs of neighbours that both have. Where that is
    none, the characters themselves are counted. Of tokens in one order, two strings that share so many have one of the first in common; the order
    is that of ``often``, so the first are rare.
    """
    own, known = len(s), often or {}
    numbered = {k: sorted(tokens(s, k), key=lambda t: (known.get(t, 0), t)) for k in (1, 2)}
    for other in lengths:
        m = least_matches(own, other, ratio)
        if m > min(own, other):
            continue
        shared = 3 * m - own - other - 1
        k = 2 if shared > 0 else 1
        yield other, m, numbered[k][: len(numbered[k]) - (shared if k == 2 else m) + 1]


def bits(s: str, k: int) -> int:
    """A bit for each token of a string, some for several: a bit that another string has not is a token that it has not."""
    return sum({1 << t % 63 for t in tokens(s, k)})


def candidates(terms: DataFrame, keys: DataFrame, ratio: float) -> DataFrame:
    """(term, key): pairs of distinct strings of either table that may be of this ratio, each pair once unless numbers of tokens coincide.

    Both tables are cut into signatures and joined on these. A pair counts where the first token that both have meets; rows bring their earlier tokens along to tell,
    so pairs are never dealt out again to find those that meet twice. Pairs go that have too few characters or pairs of neighbours in common by their ``bits``.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = Counter(t for s in b.column(0).to_pylist() for k in (1, 2) for t in tokens(s, k))
            yield pa.RecordBatch.from_arrays([pa.array(own.keys(), pa.int64()), pa.array(own.values(), pa.int64())], names=["t", "n"])

    often = {r.t: r.n for r in keys.mapInArrow(counted, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "t").limit(ORDERED).collect()}
    lengths = {name: sorted(r[0] for r in df.select(F.length(name)).distinct().collect()) for name, df in (("term", terms), ("key", keys))}

    def signed(df: DataFrame, name: str, other: str) -> DataFrame:
        far = lengths[other]
        names = [name, f"{name}_n", f"{other}_n", "token", f"{name}_m", f"{name}_before", f"{name}_1", f"{name}_2"]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int64()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for s in b.column(0).to_pylist():
                    ones, twos = bits(s, 1), bits(s, 2)
                    rows += [(s, len(s), o, t, m, first[:i], ones, twos) for o, m, first in signatures(s, far, ratio, often) for i, t in enumerate(first)]
                cols = list(zip(*rows)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        return df.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, ["string", "int", "int", "long", "int", "array<long>", "long", "long"])))

    met = signed(terms, "term", "key").join(signed(keys, "key", "term"), ["term_n", "key_n", "token"])
    in_both = lambda a, b, k: F.col(f"{a}_n") - (k - 1) - F.bit_count(F.col(f"{a}_{k}").bitwiseAND(F.bitwise_not(F.col(f"{b}_{k}"))))
    ones, twos = (F.least(in_both("term", "key", k), in_both("key", "term", k)) for k in (1, 2))
    enough = (ones >= F.col("term_m")) & (twos >= 3 * F.col("term_m") - F.col("term_n") - F.col("key_n") - 1)
    return met.where(enough & ~F.arrays_overlap("term_before", "key_before")).select("term", "key")


def closest(terms: DataFrame, keys: DataFrame, ratio: float = KEY_RATIO) -> DataFrame:
    """(term, key, score): for each distinct ``term`` the ``key`` of the highest ratio, ties to the larger key in code-point order; terms without one are left out.

    Only strings that may be near meet, and every pair that is near does. Null and empty strings are near to nothing.
    """

    def one(df: DataFrame, name: str) -> DataFrame:
        return cut(df.select(F.col(name).cast("string").alias(name)).where(F.length(name) > 0).distinct())

    pairs = candidates(one(terms, "term"), one(keys, "key"), ratio)

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, last, at, full, whole = SequenceMatcher(), None, {}, 0, None
        for b in batches:
            out = []
            for t, k in zip(*(c.to_pylist() for c in b.columns)):
                if t != last:
                    last, at, full = t, {}, (1 << len(t)) - 1
                    for i, c in enumerate(t):
                        at[c] = at.get(c, 0) | 1 << i
                # What blocks match is a common subsequence, and the longest one takes a few steps a character, all characters of the term at once.
                left = full
                for c in k:
                    hit = left & at.get(c, 0)
                    left = ((left + hit) | (left - hit)) & full
                if 2.0 * (len(t) - left.bit_count()) / (len(t) + len(k)) < ratio:
                    continue
                if t != whole:
                    m.set_seq2(t)
                    whole = t
                m.set_seq1(k)
                if (score := m.ratio()) >= ratio:
                    out.append((t, k, score))
            cols = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.float64()))], names=["term", "key", "score"])

    near = pairs.mapInArrow(rated, "term string, key string, score double")
    return near.groupBy("term").agg(F.max(F.struct("score", "key")).alias("b")).select("term", "b.key", "b.score")


def bags(requests: DataFrame, request: str, text: Column, related: DataFrame, ratio: float = KEY_RATIO) -> DataFrame:
    """(request, term, weight): the weighted words of every row of a table of requests.

    A word counts once each time it is there. A word of ``LEAST`` letters or more that is no key of ``related(key, words)``, the words that each key
    brings with it, stands for the nearest key besides itself, if that is not in the request already. Words that go with the keys of a
    request weigh ``RELATED`` at least; a key of several words counts if the request's words, one after another, hold it. Requests
    without a word have no rows; requests are told apart by ``request``, which no two rows share.
    """
    known = related.where(F.col("key").isNotNull()).select(F.lower("key").alias("key"), "words").groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"))
    known = cut(known)
    said = cut(requests.select(F.col(request).alias("request"), tx.tokens(text).alias("said")).where(F.size("said") > 0))
    each = said.select("request", F.posexplode("said").alias("pos", "term"))
    odd = each.where(F.length("term") >= LEAST).select("term").distinct().join(known.select(F.col("key").alias("term")), "term", "left_anti")
    means = cut(closest(odd, known.select("key"), ratio).select("term", "key"))
    meant = each.join(means, "term").groupBy("request", "key").agg(F.min("pos").alias("pos"))
    new = meant.groupBy("request").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "key"))), lambda s: s["key"]).alias("meant"))
    more = cut(said.join(new, "request", "left").select("request", "said", F.array_except(F.coalesce("meant", F.array().cast("array<string>")), "said").alias("more")))
    words = more.select("request", F.explode("said").alias("term"), F.lit(1.0).alias("w")).unionByName(more.select("request", F.explode("more").alias("term"), F.lit(1.0 + MATCHED).alias("w")))
    counts = words.groupBy("request", "term").agg(F.sum("w").alias("w"))
    keys = counts.select("request", F.col("term").alias("key"))
    phrases = [r.key for r in known.where(F.instr("key", " ") > 0).select("key").orderBy("key").limit(PHRASES + 1).collect()]
    if len(phrases) > PHRASES:
        raise ValueError(f"over {PHRASES} keys of several words")
    if phrases:
        whole = F.array_join(F.concat("said", "more"), " ")
        keys = keys.unionByName(more.select("request", F.explode(F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(whole, p))).alias("key")))
    extra = keys.join(known, "key").select("request", F.explode("words").alias("words")).select("request", F.explode(tx.tokens(F.col("words"))).alias("term")).select("request", "term", F.lit(RELATED).alias("w"))
    return counts.unionByName(extra).groupBy("request", "term").agg(F.max("w").alias("weight"))


def snapped(values: DataFrame, value: str, names: DataFrame, name: str, ratio: float = NAME_RATIO) -> DataFrame:
    """``values`` with ``snapped``: the known name that ``value`` is, but for case and outer spaces, or else the nearest one; null if there is none.

    Of names that differ in case alone the last in code-point order counts.
    """
    known = cut(names.where(F.length(F.col(name)) > 0).groupBy(F.lower(name).alias("key")).agg(F.max(name).alias("name")))
    low = F.lower(F.trim(F.col(value)))
    terms = values.select(low.alias("term")).distinct()
    odd = terms.join(known.select(F.col("key").alias("term")), "term", "left_anti")
    means = closest(odd, known.select("key"), ratio).select("term", "key").unionByName(known.select(F.col("key").alias("term"), "key"))
    found = cut(means.join(known, "key").select(F.col("term").alias("__term"), F.col("name").alias("snapped")))
    return values.join(found, low == F.col("__term"), "left").drop("__term")


def topics(answers: DataFrame, key: str, l1s: str, l2s: str, taxonomy: DataFrame, ratio: float = NAME_RATIO) -> DataFrame:
    """(key, l1s, l2s, dropped): a model's lists of topics as known names of ``taxonomy(l1, l2)``.

    Each name once, in the order of the answers; a subtopic brings its topic along, after those that were named. What is near to
    no known name is in ``dropped`` as it was said, subtopics first. Null lists are empty, null and blank names are dropped ones. ``key`` tells rows apart.
    """
    name = lambda c, kind: answers.select(key, F.lit(kind).alias("kind"), F.posexplode(F.col(c)).alias("pos", "value"))
    each = {kind: snapped(name(c, kind), "value", taxonomy, f"l{kind}", ratio) for kind, c in ((2, l2s), (1, l1s))}
    parents = taxonomy.where("l1 IS NOT NULL AND l2 IS NOT NULL").groupBy(F.col("l2").alias("snapped")).agg(F.max("l1").alias("parent"))
    both = each[2].join(parents, "snapped", "left").unionByName(each[1].withColumn("parent", F.lit(None).cast("string")))
    grouped = both.groupBy(key).agg(F.sort_array(F.collect_list(F.struct((-F.col("kind")).alias("kind"), "pos", "value", "snapped", "parent"))).alias("a"))
    of = lambda test, field: F.transform(F.filter("a", test), lambda s: s[field])
    own = of(lambda s: (s["kind"] == -1) & s["snapped"].isNotNull(), "snapped")
    l2 = F.array_distinct(of(lambda s: (s["kind"] == -2) & s["snapped"].isNotNull(), "snapped"))
    above = of(lambda s: (s["kind"] == -2) & s["parent"].isNotNull(), "parent")
    lost = of(lambda s: s["snapped"].isNull(), "value")
    out = grouped.select(key, F.array_distinct(F.concat(own, above)).alias("l1s"), l2.alias("l2s"), lost.alias("dropped"))
    none = F.array().cast("array<string>")
    return answers.select(key).join(out, key, "left").select(key, *[F.coalesce(c, none).alias(c) for c in ("l1s", "l2s", "dropped")])
