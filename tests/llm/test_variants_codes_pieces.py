"""Spelling variants, vector codes and pieces against plain loops, and their edge cases."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import SF
from pyspark.sql import functions as F

from questora.llm import codes, pieces, queries, variants

LETTERS = str.maketrans(variants.UPPER, variants.LOWER)


def near(a, b):
    """One code point inserted, deleted or replaced."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_words(rows):
    seen = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LETTERS)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            k = h % len(run)
            seen[run[:k] + run[k + 1:] if h % 97 == 0 else run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def plain_groups(words):
    """By deletions instead of a trie: near words share a word left when one code point goes."""
    left = collections.defaultdict(set)
    for w in words:
        for v in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            left[v].add(w)
    links = collections.defaultdict(set)
    for own in left.values():
        for a, b in itertools.combinations(own, 2):
            if near(a, b):
                links[a].add(b)
                links[b].add(a)
    form = {}
    for w, n in words.items():
        best = min(links[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(links[w]), words[form[w]] if form[w] else None))
    return out


def groups(df, **how):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.group_variants(df, **how).collect()}


def test_variants_of_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = plain_groups(plain_words([tuple(r) for r in docs.collect()]))
    assert len(want) > 10_000 and groups(docs) == want


@pytest.mark.parametrize("split", [10_000, 20])
def test_variants_below_hot_prefixes_and_rests(spark, split):
    rng = random.Random(4)
    tail = lambda k, n: "".join(rng.choice("abc"[:k]) for _ in range(n))
    # A third of the words begin alike, a third end alike, some are runs of one letter; and a chain of forms.
    words = {"prefixprefix" + tail(3, rng.randrange(0, 7)) for _ in range(700)} | {tail(3, rng.randrange(0, 7)) + "endendend" for _ in range(700)}
    words |= {tail(2, rng.randrange(5, 10)) for _ in range(400)} | {"a" * n for n in range(5, 14)} | {"é" * 5 + "ÿ", "é" * 6, "x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1499}
    text = [" ".join([w] * rng.choice([3, 4, 7, 12, 30, 90])) for w in sorted(words)]
    chain = ["chainaaaa"] * 3 + ["chainaaab"] * 6 + ["chainaabb"] * 12 + ["chainabbb"] * 24 + ["chainbbbb"] * 48
    rows = [(i, t) for i, t in enumerate(text)] + [(None, " ".join(chain)), (7, text[7]), (7, text[7]), (-1, None), (-2, ""), (-3, "12 ab !?"), (-4, "ÀÉÎÕÜ " * 3)]
    df = spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id long, text string, n int, word string")
    assert groups(df, split=split) == plain_groups(plain_words(rows))
    assert groups(df.limit(0)) == set() and groups(df.where("text IS NULL")) == set()


def test_subtries_hold_every_word_and_stay_small(spark):
    words = spark.range(3000).select(F.concat(F.lit("samesame"), F.lpad(F.conv(F.col("id"), 10, 3), 8, "0")).alias("word"), F.lit(3).cast("long").alias("n"))
    rows = variants.subtries(words, 100)
    assert rows.groupBy("g").count().agg(F.max("count")).first()[0] <= 100 and rows.select("word").distinct().count() == 3000


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """rows (id, vector): (codes, errors, books), one part and entry at a time."""
    vec = [[int(np.floor(4096 * x)) for x in v] for _, v in rows]
    m = len(vec[0]) // parts
    cut = [[v[p * m: (p + 1) * m] for p in range(parts)] for v in vec]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    firsts = [i for n, i in enumerate(first) if n == 0 or rows[i][0] != rows[first[n - 1]][0]][:entries]
    books = [[list(cut[i][p]) for i in firsts] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = collections.defaultdict(list)
            for c in cut:
                own[nearest(c[p], books[p])[1]].append(c[p])
            for e, xs in own.items():
                books[p][e] = [sum(col) // len(xs) for col in zip(*xs)]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    return [[e for _, e in f] for f in found], [sum(d for d, _ in f) for f in found], books


def test_codes_equal_a_loop(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.normal(size=24).round(3).tolist(), int(i) % 3 or None) for i in range(60)]
    rows += [(3, rows[3][1], 1), (3, rows[5][1], 1), (None, rows[9][1], 2), (70, rows[9][1], None), (71, [1e4] * 24, 2)]
    odd = [(80, None, 1), (81, [], 1), (82, [1.0] * 23 + [None], 1), (83, [float("nan")] * 24, 1), (84, [float("inf")] * 24, None), (85, [1.0] * 16, 1), (86, [1.0] * 25, 1)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows + odd], "vec_id long, embedding array<double>, label int, code string, error int").repartition(5)
    got, books = codes.compress(df)
    want, errors, want_books = plain_codes([r[:2] for r in rows])
    assert books.tolist() == want_books
    sums = collections.Counter()
    for r, e in zip(rows, errors):
        sums[r[2]] += e
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([(r.id, r.codes, r.error, r.label, r.label_error) for r in got.collect()], key=key) == sorted([(r[0], c, e, r[2], sums[r[2]]) for r, c, e in zip(rows, want, errors)], key=key)
    few, few_books = codes.compress(df.where("vec_id IN (1, 2, 71)"))
    assert few_books.shape == (8, 3, 3) and {r.error for r in few.collect()} == {0}
    none, no_books = codes.compress(df.where("vec_id = 80"))
    assert no_books is None and none.count() == 0


def test_codes_of_huge_components(spark):
    rows = [(i, [1e30 * (i % 3 - 1), 3e11 * i, 1.0, -1e15] * 4) for i in range(20)]
    got, _ = codes.compress(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int"))
    assert got.count() == 20 and all(0 <= r.error <= codes.LONG and r.label_error <= codes.LONG for r in got.collect())


def test_bounds_are_below_distances_and_spare_work():
    rng = np.random.default_rng(6)
    for m, scale in ((8, 2000), (8, 3), (6, 500), (1, 50)):
        x, book = rng.integers(-scale, scale, (300, m)), rng.integers(-scale, scale, (16, m))
        book[7] = book[2]
        x[:30] = book[rng.integers(0, 16, 30)]
        d = ((x[:, None] - book[None]) ** 2).sum(2)
        rows, entries = np.repeat(np.arange(300), 16), np.tile(np.arange(16), 300)
        for k in (k for k in codes.BLOCKS if k <= m):
            assert (codes.bounds(x, book, k, rows, entries, codes._blocks(x, k), codes._blocks(book, k)) <= d.ravel()).all()
        e, least, worked = codes.nearest(x, book)
        assert (e == d.argmin(1)).all() and (least == d.min(1)).all() and worked < d.size


MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_equal_the_library(spark):
    of = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(7)
    bits = ["a", "the", "ing", " ", "  ", "▁", "\n", "\t", "é", "é", "😀", "\x00", "<s>", "<0x41>", "日本語", "½", "　", "�", "Zz9"]
    texts = [None, "", " ", "   ", "▁", "a ", " a", "x" * 40_000, "long " * 30_000, "▁" * 500 + "b"] + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    rows = [(i, t, 1, "z") for i, t in enumerate(texts)] + [(12, texts[12], 1, "z"), (None, "a b", 1, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, chunk string").repartition(4)
    with open(MODEL, "rb") as f:
        model = f.read()
    for most in (pieces.TABLE, 3, 0):
        got = collections.Counter((r.doc_id, tuple(r.ids), r.text) for r in pieces.encode(df, model, most).collect())
        assert got == collections.Counter((r[0], tuple(of.encode(r[1] or "")), of.decode(of.encode(r[1] or ""))) for r in rows)
    assert pieces.encode(df.limit(0), model).count() == 0
    assert 0 < pieces.chunk_table(df, model, 20).count() <= 20


def test_pieces_of_the_corpus(spark):
    import hashlib

    of = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = of.encode(r.text or "")
        want.add((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(of.decode(ids))))
    assert {tuple(r) for r in queries.op13_pieces(spark, SF).collect()} == want


def test_a_table_that_lets_go_still_gives_all_ids(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 50)
    with open(MODEL, "rb") as f:
        table = pieces.Table(f.read(), {"first": b"\x01\x00\x00\x00"})
    for i in range(100):
        table.learn({f"word{i}", "first", ""})
        assert table[f"word{i}"] and table[""] and table["first"] == b"\x01\x00\x00\x00"
    assert len(table) < 20
