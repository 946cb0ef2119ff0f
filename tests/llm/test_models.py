"""The trained models against plain versions of what they compute."""

import itertools
import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from questora.llm import langid, quality, topk, toxicity


def test_forward_backward_equals_all_label_paths():
    rng = np.random.default_rng(1)
    k, lengths = 3, [5, 1, 4]
    e, moves = rng.normal(size=(3, 5, k)), rng.normal(size=(k, k))
    post, alpha, beta, x = langid.chances(e, np.array(lengths), moves)
    for c, n in enumerate(lengths):
        want, pairs, total = np.zeros((n, k)), np.zeros((k, k)), 0.0
        for path in itertools.product(range(k), repeat=n):
            p = math.exp(sum(e[c, t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            total += p
            for t, y in enumerate(path):
                want[t, y] += p
            for a, b in zip(path, path[1:]):
                pairs[a, b] += p
        assert np.allclose(post[c, :n], want / total)
        if n == 5:
            assert np.allclose(langid.expected_moves(alpha[c:c + 1], beta[c:c + 1], x[c:c + 1], moves), pairs / total)


def test_every_character_and_every_language_counts(spark):
    rng = np.random.default_rng(2)
    word = lambda letters: "".join(rng.choice(list(letters), 6))
    # Seventy languages, each with letters of its own, and one without spaces.
    rows, alphabets = [], [[chr(0x4E00 + 10 * n + i) for i in range(10)] for n in range(70)]
    for n, letters in enumerate(alphabets):
        rows += [(100 * n + i, " ".join(word(letters) for _ in range(8)), f"l{n:02d}", 1.0) for i in range(12)]
    crf = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, score double"))
    assert len(crf.langs) == 70
    long = lambda a, b, n: (word(alphabets[a]) * 4)[:24] + "".join(rng.choice(alphabets[b], n))
    asked = [(1, long(3, 40, 10_000)), (2, long(40, 3, 10_000)), (3, " ".join(word(alphabets[69]) for _ in range(5))), (4, None), (5, "12 ½ !")] + [(10 + i, word(alphabets[i % 70])) for i in range(300)]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(asked, "doc_id long, text string"), crf).collect()}
    assert (got[1].lang_pred, got[2].lang_pred, got[3].lang_pred) == ("l40", "l03", "l69") and got[1].n_words == 418
    assert got[4].lang_pred == got[5].lang_pred == "und" and got[4].score == 0
    assert np.mean([got[10 + i].lang_pred == f"l{i % 70:02d}" for i in range(300)]) > 0.95


def test_marks_belong_to_words(spark):
    rng = np.random.default_rng(8)
    assert [langid._WORD.findall(t) for t in ("हिन्दी की", "தமிழ்", "ภาษาไทยที่", "é")] == [["हिन्दी", "की"], ["தமிழ்"], ["ภาษาไทยที่"], ["é"]]
    for pattern in (toxicity._WORD, quality._TOKEN):
        assert pattern.findall("हिन्दी é1, ok") == ["हिन्दी", "é1", *([","] if pattern is quality._TOKEN else []), "ok"]
    # Two languages of the same letters: one has one kind of vowel sign, the other another.
    word = lambda signs: "".join(rng.choice(list("कखगघ")) + rng.choice(list(signs)) for _ in range(4))
    rows = [(2 * i + n, " ".join(word(signs) for _ in range(12)), lang) for i in range(60) for n, (signs, lang) in enumerate((("ाि", "x"), ("ुू", "y")))]
    rows += [(1000 + i, " ".join(rng.choice(["lang", "wort", "satz"], 4000)), "long") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    crf = langid.fit(df)
    assert crf.langs == ["long", "x", "y"]
    got = {r.doc_id: r.lang_pred for r in langid.predict(df, crf).collect()}
    assert np.mean([got[i] == lang for i, _, lang in rows]) > 0.99
    marks = langid.predict(spark.createDataFrame([(1, "\u0301\u0308 ́")], "doc_id long, text string"), crf).first()
    assert marks.lang_pred == "und"


def test_five_hundred_languages_take_little_memory(spark):
    import resource

    rng = np.random.default_rng(9)
    rows = [(10 * n + i, " ".join("".join(chr(0x4E00 + 20 * n + int(c)) for c in rng.integers(0, 20, 5)) for _ in range(6)), f"l{n:03d}") for n in range(500) for i in range(10)]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    crf = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(crf.langs) == 500 and crf.weights.nbytes <= 4 * langid.CELLS
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000
    got = langid.label_words(crf, [t for _, t, _ in rows[::100]])
    assert np.mean([crf.langs[int(p.mean(0).argmax())] == r[2] for p, r in zip(got, rows[::100])]) > 0.9


def test_scores_of_words_do_not_depend_on_the_batch():
    rows = [("ab cd ef " * 5, "x"), ("gh ij kl " * 5, "y")] * 10
    crf = langid.train(rows)
    texts = ["ab", "gh ij " * 100, None, "ab gh", "kl"]
    alone = [langid.label_words(crf, [t], n + 1)[0] for n, t in enumerate(texts)]
    for a, b in zip(alone, langid.label_words(crf, texts, 99)):
        assert np.allclose(a, b)


def test_network_equals_a_loop_over_windows():
    rows = [(f"good word{i % 7} fine day", 0) for i in range(30)] + [(f"bad word{i % 7} awful day", 1) for i in range(30)]
    net = toxicity.train(rows, epochs=2)
    for text in ("bad awful", "good", "", "unseen words here bad word1 fine " * 3, None):
        vec = [net.emb[a] + net.emb[b] for a, b in map(toxicity.word_rows, toxicity._WORD.findall((text or "").lower()))]
        vec += [np.zeros(toxicity.DIM, np.float32)] * max(1, max(toxicity.WIDTHS) - 1)
        best = []
        for w, k, b in zip(toxicity.WIDTHS, net.conv, net.bias):
            seen = [sum((vec[i + j] @ k[j] for j in range(w) if i + j < len(vec)), np.zeros(toxicity.FILTERS)) + b for i in range(len(vec))]
            best += [max(0.0, max(s[f] for s in seen)) for f in range(toxicity.FILTERS)]
        want = 1 / (1 + math.exp(-(float(np.dot(best, net.out)) + net.out_bias)))
        assert abs(toxicity.score_batch(net, ["other text", text], key=7)[1] - want) < 1e-4


def test_ftrl_equals_one_coordinate_at_a_time():
    rows = [("alpha beta", 1), ("beta gamma delta", 0), ("alpha alpha", 1), ("gamma", 0)]
    dims = 64
    model = quality.Ftrl(dims=dims)
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= model.l1:
            return 0.0
        return -(z[i] - math.copysign(model.l1, z[i])) / ((model.beta + math.sqrt(n[i])) / model.alpha + model.l2)

    for _ in range(2):
        for text, y in rows:
            idx = quality.features([text], dims)[0].tolist()
            x = {i: idx.count(i) * quality.SCALE / len(idx) for i in idx} | {dims: 1.0}
            p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in x.items())))
            for i, v in x.items():
                g, before, w = (p - y) * v, n.get(i, 0.0), weight(i)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / model.alpha * w
                n[i] = before + g * g
    got = model.fit(rows, epochs=2)
    assert np.allclose(got, [weight(i) for i in range(dims + 1)], atol=1e-5)
    idx = quality.features(["beta alpha"], dims)[0].tolist()
    want = 1 / (1 + math.exp(-(sum(got[i] for i in idx) * quality.SCALE / len(idx) + got[dims])))
    assert abs(quality.score_batch(["gamma", "beta alpha", ""], got)[1] - want) < 1e-6


def test_search_stops_early_where_few_dimensions_decide(spark):
    rng = np.random.default_rng(3)
    rows = rng.integers(-3, 4, (2000, 16))
    rows[:, 0] = np.floor(rng.pareto(1.0, 2000) * 50)
    ids, queries = np.arange(2000), rows[::200].copy()
    queries[:, 0] = 9
    got = topk.nra(queries, rows, 5, ids, ids[::200])
    for q, own, (which, score, read) in zip(queries, ids[::200], got):
        want = sorted(((-int(r @ q), i) for i, r in enumerate(rows) if i != own))[:5]
        assert [(-int(s), int(i)) for i, s in zip(which, score)] == want and read < 0.5
    # Components that are all alike leave no room: everything is read, and the result is the same.
    flat = rng.integers(-100, 100, (300, 32))
    for q, (which, score, read) in zip(flat[:4], topk.nra(flat[:4], flat, 5, ids[:300], ids[:4])):
        assert sorted(score.tolist(), reverse=True) == score.tolist() and read == 1.0
    ties = spark.createDataFrame([(i, [1.0, 0.5], i) for i in range(60)], "vec_id long, embedding array<double>, rank int")
    found = topk.search(ties, F.col("vec_id") % 50 == 0, 5, block=16, chunk=1).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in found] == [(q, v) for q, vs in ((0, [1, 2, 3, 4, 5]), (50, [0, 1, 2, 3, 4])) for v in vs]


def test_folds_follow_the_crc_of_the_id(spark):
    from questora.llm.common import fold_remainder

    got = spark.range(50).select("id", fold_remainder(F.col("id"), 3).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 3 for r in got)
