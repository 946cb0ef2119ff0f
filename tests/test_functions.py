"""Parsers, decks and likeness of texts against plain Python and small cases."""

import hashlib
import math

import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from questora.functions import decks, parsing, rules, vectors
from questora.operators import bank, dedup, evaluate, sequence


def test_question_and_answer_slides(spark):
    slides = [
        "QUESTION 3\n*13.\nCREATIVITY\nWhich city is this?\n(A) Rome\n(B) Paris\nfoot note", "Q7. What is gold? 11.*", "Which is it?\nA. x", "PROBLEM - SOLVING\nHow so HISTORY", "", None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(slides)], "i int, t string").select("i", parsing.question_parts(F.col("t")).alias("p")).orderBy("i")
    got = [(r.p["question"], r.p["options"], r.p["theme"], r.p["number"]) for r in df.collect()]
    assert got[0] == ("Which city is this?", ["(A) Rome", "(B) Paris"], "Creativity", 13)
    assert got[1] == ("What is gold?", None, None, 11) and got[3] == ("How so", None, "Problem-Solving", None)
    assert got[2][1] is None and got[4][0] in ("", None) and got[5][1:] == (None, None, None)
    answers = ["ANSWER: Answer: Rome\nExplanation: built long ago", "1.\nParis\ncapital of France", "", None, "Ans - The Nile \nmore"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(answers)], "i int, t string").select("i", parsing.answer_parts(F.col("t")).alias("p")).orderBy("i")
    assert [tuple(r.p) for r in df.collect()] == [("Rome", "built long ago"), ("Paris", "capital of France"), ("", ""), ("", ""), ("The Nile", "more")]
    words = spark.sql("SELECT 'engineering technology Technology, Science engineering' AS q").select(parsing.distinct_words(F.col("q")).alias("w")).first().w
    assert words == "engineering technology Science"


def test_deck_names(spark):
    names = {
        "uploads/Lake College of Engineering Bengaluru Prelims City Business Quiz 15-03-2024 English.pptx":
            ("City Business Quiz", "Lake College of Engineering", "Bengaluru", "Prelims", "2024-03-15", 2024, "English", "College", False),
        "DPS School - Navi Mumbai - Finals - Junior Quiz (Hindi) 2023.pdf": ("Junior Quiz", "DPS School", "Navi Mumbai", "Finals", "None", 2023, "Hindi", "School", False),
        "ZVQ_bangalore_semis_2024-13-40.pptx": ("2024-13-40", None, "Bengaluru", "Semi-finals", "None", 2024, None, None, True),
        "just a name v2.pptx": ("just a name", None, None, None, "None", None, None, None, False),
        "Quiz March 2022 w answers.pptx": ("Quiz", None, None, None, "None", 2022, None, None, False),
        "": (None, None, None, None, "None", None, None, None, False),
    }
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", decks.deck_info(F.col("n")).alias("d"))
    for r in df.collect():
        d = r.d
        got = (d["quiz_name"], d["college"], d["city"], d["round_stage"], str(d["deck_date"]), d["deck_year"], d["language"], d["primary_audience"], d["is_varsity"])
        if r.n.startswith("ZVQ"):
            assert got[2:] == names[r.n][2:]
        else:
            assert got == names[r.n], r.n


def plain_fold(deck):
    """The kinds of one deck's slides, (kind, section, board, question, asks, divides, bare, text) each, one slide after another."""
    n, kinds = len(deck), [s[0] for s in deck]
    if n >= 6:
        cut = next((i for i in range(4, min(n - 2, int(n * 0.85))) if deck[i][5]), None)
        if cut is not None and sum(s[4] for s in deck[:cut]) >= 2 and sum(s[4] for s in deck[cut:]) >= 2:
            kinds = ["QUESTION_PREVIEW" if i < cut and k == "QUESTION" else k for i, k in enumerate(kinds)]
    first = list(kinds)
    for i, (_, section, board, question, _, _, _, text) in enumerate(deck):
        here, before = first[i], kinds[i - 1] if i else None
        if i + 1 < n and (first[i + 1] == "ANSWER_TRANSITION" or deck[i + 1][6]) and here != "SECTION_MARKER":
            kinds[i] = "QUESTION"
        elif here == "ANSWER" and "?" in (text or "") and question >= 0.5:
            kinds[i] = "QUESTION"
        elif here in ("CONTENT", "TITLE") and before == "QUESTION" and section < 0.5 and board < 0.5:
            kinds[i] = "ANSWER"
        elif here in ("CONTENT", "TITLE", "QUESTION") and before == "ANSWER_TRANSITION" and section < 0.6:
            kinds[i] = "ANSWER"
    return kinds


def test_decks_are_folded_as_a_loop_does(spark):
    texts = ["Which city is this?", "ANSWER", "Rome it was", "answers follow", "Round 2", "scoreboard", "1. Name the river?", "Solution: Nile", None, "plain words here", "is it so? answer: yes, question"]
    rng = np.random.default_rng(4)
    rows = [(d, int(i), [None, "Question", "Round 1", "Welcome"][rng.integers(4)], texts[rng.integers(len(texts))], None) for d in range(40) for i in range(rng.integers(1, 16))]
    two = ["Which one?", "2. What river?", "Why so?", "Who is it?", "answers follow", "Which one?", "Rome", "2. What river?", "Nile"]
    rows += [(99, i, None, t, None) for i, t in enumerate(two)] + [(98, None, None, None, None)]
    slides = spark.createDataFrame(rows, "document_id int, slide_number int, title string, extracted_text string, speaker_notes string")
    s = sequence.slide_scores(F.col("title"), F.col("extracted_text"), F.col("speaker_notes"), F.col("slide_number"))
    title, text = (F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "extracted_text"))
    seen = slides.select(
        "document_id", "slide_number", sequence.slide_kind(s), s["SECTION_MARKER"], s["SCOREBOARD"], s["QUESTION"], F.concat(text, title).rlike(r"^\s*\d+[.)]|\?"),
        F.concat_ws(" ", title, text).rlike(sequence.DIVIDER), text.rlike(sequence.TRANSITION), "extracted_text",
    ).collect()
    by = {}
    for r in sorted(seen, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        by.setdefault(r[0], []).append(tuple(r)[2:])
    want = {(d, i): k for d, deck in by.items() for i, k in enumerate(plain_fold(deck))}
    got = {(r.document_id, r.slide_number or 0): r.slide_type for r in sequence.classify_decks(slides).collect()}
    assert got == want and [got[99, i] for i in range(4)] == ["QUESTION_PREVIEW"] * 4 and len(got) == len(rows)
    assert sequence.classify_decks(slides.limit(0)).count() == 0


def test_nine_patterns_of_slides(spark):
    q, a, t, c, m = "QUESTION", "ANSWER", "ANSWER_TRANSITION", "CONTENT", "SECTION_MARKER"
    decks_ = {
        1: [(m, "Round 3: Portfolio Builder"), (c, "Set one"), (c, "red"), (c, "green"), (c, "blue"), (t, "ANSWER"), (c, "Answer: Colours\nall of them")],
        2: [(c, "Bumper"), (q, "Arrange from lowest to highest"), (c, "answer"), (c, "A B C")],
        3: [(m, "Market Indicators\nRound 4"), (c, "go"), (c, "four pictures"), (t, "ANS"), (c, "Rivers")],
        4: [(c, "Question 7"), (q, "Who is it?\n(A) Ann\n(B) Bob"), (t, "ANSWER"), (c, "Ann")],
        5: [(q, "Q1. Which city?"), (t, "ANSWER"), (c, "Rome"), (c, "Did you know? It is old"), (q, "Next?"), (a, "Yes")],
        6: [(q, "What river?"), (c, "a map"), (t, "ANSWER"), (c, "Nile")],
        7: [(q, "Whose logo?"), (a, "https://x.y"), (q, "Why so?"), (a, "Because")],
        8: [(q, "Name it?"), (c, "solution"), (a, "Gold\nshiny")],
        9: [(q, "In notes?"), (q, "In text?\nAns: here"), (q, "Nowhere?"), ("QUESTION_PREVIEW", "Seen?"), (a, "x"), (c, "buffer")],
        10: [(c, "Audience Question time"), (q, "From you?"), (a, "Me")],
    }
    rows = [(d, n, k, None, text, "Ans: noted" if text == "In notes?" else None) for d, deck in decks_.items() for n, (k, text) in enumerate(deck, 1)]
    df = spark.createDataFrame(rows, "document_id int, slide_number int, slide_type string, title string, extracted_text string, speaker_notes string")
    got = sorted((r.document_id, r.first_slide, r.last_slide, r.pattern, r.question, r.answer, r.round_number, r.subtopic) for r in sequence.extract_questions(df).collect())
    assert [g[:6] for g in got] == [
        (1, 3, 7, "STEPPED", "Clue 1 (+20/-15): red\n\nClue 2 (+15/-10): green\n\nClue 3 (+10/-5): blue", "Colours"), (2, 2, 4, "ARRANGE", "Arrange from lowest to highest", "A B C"),
        (3, 3, 5, "CONNECT", sequence.CONNECT_TEXT, "Rivers"), (4, 2, 4, "BUMPER", "Who is it?", "Ann"), (5, 1, 3, "DIVIDED", "Which city?", "Rome"), (5, 5, 6, "PLAIN", "Next?", "Yes"),
        (6, 1, 4, "CLUED", "What river?", "Nile"), (7, 3, 4, "PLAIN", "Why so?", "Because"), (8, 1, 3, "MIDDLE", "Name it?", "Gold"), (9, 1, 1, "ALONE", "In notes?", "noted"), (9, 2, 2, "ALONE", "In text? Ans: here", "here"),
        (9, 3, 5, "MIDDLE", "Nowhere?", "x"),
        (10, 2, 3, "PLAIN", "From you?", "Me"),
    ]
    assert [g[6:] for g in got][:3] == [(3, "Portfolio Builder"), (None, "Ticker Tangle"), (4, "Market Indicators")] and got[-1][6:] == (99, "Audience Questions")
    more = {r.document_id: r.explanation for r in sequence.extract_questions(df).where("pattern IN ('DIVIDED', 'CLUED', 'MIDDLE', 'STEPPED')").collect()}
    assert more == {1: "all of them", 5: "Did you know? It is old", 6: "Clue: a map", 8: "shiny", 9: "Clue: Seen?"}
    assert sequence.extract_questions(df.limit(0)).count() == 0


def test_hash_embedding_word_by_word(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(20).collect()] + ["", None, "Ab ab"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = vectors.hash_embeddings(got, "i", F.col("t"), 16).withColumnRenamed("embedding", "v").orderBy("i").collect()
    for r, t in zip(got, texts):
        v = [0.0] * 16
        for w in (t or "").lower().split():
            h = hashlib.sha256(w.encode()).hexdigest()
            v[int(h[:8], 16) % 16] += 1
            v[int(h[8:16], 16) % 16] += 0.5
            for k in range(len(w) - 2):
                v[int(hashlib.md5(w[k:k + 3].encode()).hexdigest()[:8], 16) % 16] += 0.25
        n = math.sqrt(sum(x * x for x in v)) or 1
        assert np.allclose(r.v, [x / n for x in v], atol=2e-6)


def test_nearest_vectors_and_flags(spark):
    rng = np.random.default_rng(6)
    vec = rng.normal(size=(60, 5))
    vec[30:45] = vec[:15] + rng.normal(size=(15, 5)) * 0.05
    rows = [(i, f"question number {'abcdefghij'[i % 10]} about some things", "same", v.tolist()) for i, v in enumerate(vec)] + [(60, "x", "y", None), (61, "x", "y", [0.0] * 5), (62, "x", "y", [1.0])]
    df = spark.createDataFrame(rows, "id long, question string, answer string, embedding array<double>")
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    sim = unit @ unit.T
    got = {}
    for r in dedup.neighbours(df.where("id % 20 = 0"), df, -2.0, 5).collect():
        got.setdefault(r.id, []).append((r["rank"], r.other, round(r.sim, 9)))
    for q in (0, 20, 40):
        want = sorted(((-sim[q, j], j) for j in range(60) if j != q))[:5]
        assert sorted(got[q]) == [(n + 1, j, round(-s, 9)) for n, (s, j) in enumerate(want)]
    flags = {r.id: r for r in dedup.flagged(df.where("id >= 30"), df.where("id < 30"), threshold=0.95).collect()}
    for i in range(30, 60):
        near = sorted(((-sim[i, j], j) for j in range(30) if sim[i, j] >= 0.95))[:5] or sorted(((-sim[i, j], j) for j in range(30, i) if sim[i, j] >= 0.95))
        assert (flags[i].duplicate_status == "POSSIBLE_DUPLICATE") == bool(near) and (not near or flags[i].duplicate_of_id == near[0][1])
    assert flags[60].duplicate_status == "UNIQUE" and dedup.neighbours(df.limit(0), df, 0.0, 5).count() == 0


def test_far_clusters_never_meet_and_no_near_pair_is_lost(spark, monkeypatch):
    rng = np.random.default_rng(7)
    homes = rng.normal(size=(20, 16))
    vec = np.concatenate([h + rng.normal(size=(60, 16)) * s for h, s in zip(homes, np.linspace(0.02, 0.2, 20))] + [rng.normal(size=(200, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)], "id long, embedding array<double>")
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    sim = unit @ unit.T
    want = {(i, j) for i, j in zip(*np.nonzero(sim >= 0.92)) if j < i}
    monkeypatch.setattr(dedup, "BLOCK", 25)
    monkeypatch.setattr(dedup, "CHUNK", 25)
    assert {(r.id, r.other) for r in dedup.neighbours(df, df, 0.92, None, True).collect()} == want and len(want) > 10_000
    _, _, meets, nq, nb = dedup._near_clusters(df, df, 0.92)
    assert len(meets) > 5 and sum(nq[i] * nb[j] for i, js in meets.items() for j in js) < 0.5 * len(vec) ** 2
    _, _, meets, nq, _ = dedup._near_clusters(df, df, -2.0)
    assert meets == {0: [0]} and nq == {0: len(vec)}
    # The nearest few are implausible, a further one is not: the row is widened until it is found.
    turned = lambda t: [float(np.cos(t)), float(np.sin(t))]
    rows = [(i, "some other question entirely", f"x{i}y", turned(0.5 + 0.001 * i)) for i in range(40)] + [(100, "question one about a thing", "gold", turned(0.6)), (101, "question one about a thing", "gold", turned(0.0))]
    batch = spark.createDataFrame(rows, "id long, question string, answer string, embedding array<double>")
    got = {r.id: r for r in dedup.flagged(batch, batch.limit(0), threshold=0.5, top=2).collect()}
    assert got[101].duplicate_of_id == 100


def test_no_like_pair_is_left_out(spark):
    rng = np.random.default_rng(3)
    letters = list("abcdef")
    word = lambda n: "".join(rng.choice(letters, n))
    base = [" ".join(word(int(rng.integers(1, k))) for _ in range(int(rng.integers(1, 9)))) for k in (2, 3, 6, 12, 16) for _ in range(12)]
    texts = list(base)
    for t in base:
        c = list(t)
        for _ in range(int(rng.integers(1, 4))):
            c[rng.integers(len(c))] = str(rng.choice(letters))
        texts += ["".join(c), " ".join(rng.permutation(t.split())), t + " " + word(3), " ".join(t.split()[:-1])]
    texts += ["abcdefghijklmnopqrst", "abcdefghijklmnopqrsu", "", None, "!!"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    sets = df.select("id", bank.word_set(F.col("t")).alias("words"))
    pairs = df.join(df.select(F.col("id").alias("id2"), F.col("t").alias("t2"))).where("id < id2")
    want = {(r.id, r.id2) for r in pairs.where(bank.token_set_ratio(F.col("t"), F.col("t2")) > 90).collect()}
    found = {(r.a, r.b) for r in bank.may_be_alike(sets, sets).collect()}
    assert want <= found and len(want) > 150 and (texts.index("abcdefghijklmnopqrst"), texts.index("abcdefghijklmnopqrsu")) in want


def test_likeness_of_word_sets(spark):
    pairs = [("the cat sat", "sat the CAT"), ("fuzzy was a bear", "fuzzy fuzzy was a bear"), ("abc", "xyz"), ("", "a"), ("new york mets", "new york meats now"), (None, "x")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").select("i", bank.token_set_ratio(F.col("a"), F.col("b")).alias("s")).orderBy("i")
    got = [r.s for r in df.collect()]
    assert got[:4] == [100.0, 100.0, 0.0, 0.0] and 80 < got[4] < 100 and got[5] == 0
    assert bank._common("kitten", "sitting") == 4 and bank._common("", "x") == 0
    rows = [(1, "alpha beta gamma"), (2, "gamma beta alpha"), (3, "delta beta"), (4, "delta beta x1"), (5, "eta theta"), (6, None), (7, "kappa lambda mu")]
    df, gold = spark.createDataFrame(rows, "id int, text string"), spark.createDataFrame([(1, "mu lambda kappa")], "id int, text string")
    assert {r.id for r in bank.greedy_distinct(df, gold, "id", "text").collect()} == {1, 3, 5, 6}
    assert bank.greedy_distinct(df.limit(0), gold, "id", "text").count() == 0


def test_high_values_and_bigrams(spark):
    rng = np.random.default_rng(1)
    rows = [(g, int(v)) for g in "ab" for v in rng.integers(0, 30, 101)] + [("a", None), ("c", 5)]
    got = {r.g: r.p95 for r in evaluate.p95(spark.createDataFrame(rows, "g string, v int"), "g", "v").collect()}
    for g in "abc":
        vs = sorted(v for x, v in rows if x == g and v is not None)
        assert got[g] == vs[math.floor(0.95 * (len(vs) - 1))]
    w = spark.range(1).select(evaluate.with_bigrams(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("x"), evaluate.with_bigrams(F.array(F.lit("a"))).alias("y")).first()
    assert w.x == ["a", "b", "c", "a b", "b c"] and w.y == ["a"]


def test_first_theme_rule_wins(spark):
    texts = ["Central bank of stock", "a gold loan", "tata motors", "nothing at all", None, "EQUITIES", "the s&p index", "5g phone", "sydney harbour"]
    import re

    def plain(t):
        return next(((a, b) for p, a, b in rules.TAXONOMY_RULES if re.search(rf"\b(?:{p})\b", (t or "").lower())), ("General Knowledge", "General Trivia"))

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", rules.taxonomy(F.col("t")).alias("x")).orderBy("i").collect()
    assert [tuple(r.x) for r in got] == [plain(t) for t in texts]


def test_payloads_and_merged_json(spark):
    from questora.functions import formats

    df = spark.createDataFrame([
        ("STEPPED_CLUE", "1st clue: a 2nd clue: b 3rd clue: c", "x", ["i"]), ("CONNECT_4", "What links these?", "Rivers", ["p", "q"]), ("ARRANGE_ORDER", "Arrange:\nA. one\nB. two", "B A", []), ("STANDARD_QA", None, "y", None),
    ], "f string, q string, a string, i array<string>")
    got = [r.p for r in df.select(formats.payload(F.col("f"), F.col("q"), F.col("a"), F.col("i")).alias("p")).collect()]
    assert got[0] == '{"type":"STEPPED_CLUE","answer":"x","clues":["a","b","c"]}' and got[1] == '{"type":"CONNECT_4","answer":"Rivers","clues":["p","q"]}'
    assert got[2] == '{"type":"ARRANGE_ORDER","answer":"B A","items":["A. one","B. two"]}' and got[3] == '{"type":"STANDARD_QA","answer":"y"}'
    merged = spark.createDataFrame([('{"a":"1","b":"2"}', '{"b":"3","c":null}'), (None, '{"x":"1"}'), ("no json", None)], "o string, n string").select(formats.merged_json(F.col("o"), F.col("n")).alias("m")).collect()
    assert [r.m for r in merged] == ['{"a":"1","b":"3"}', '{"x":"1"}', "{}"]


def test_rounding_of_halves_is_that_of_the_sql(spark):
    import duckdb

    given = [(float(k), float(m)) for m in (128, 384, 640, 1152, 3200) for k in range(1, m, 2)]
    rows = spark.createDataFrame(given, "k double, m double").select(F.array_agg(vectors.rounded(F.col("k") / F.col("m"), 6)).alias("v"))
    con = duckdb.connect()
    con.execute("CREATE TABLE g (k DOUBLE, m DOUBLE)")
    con.executemany("INSERT INTO g VALUES (?, ?)", given)
    assert sorted(rows.first()["v"]) == sorted(r[0] for r in con.execute("SELECT round(k / m, 6) FROM g").fetchall())


def test_nearest_rows_by_blocks_parts_and_common_terms(monkeypatch):
    """Each row is read once for a whole chunk of asking rows, in small blocks and parts, with ties to the smaller id."""
    import pyarrow as pa

    for name, value in (("BLOCK", 7), ("COMMON", 3), ("PRODUCTS", 40)):
        monkeypatch.setattr(evaluate, name, value)
    draw = np.random.default_rng(5)
    dense = (draw.random((60, 25)) < np.r_[np.full(5, 0.7), np.full(20, 0.1)]) * draw.integers(1, 4, (60, 25)) * 1.0
    dense[41] = dense[17]
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
    ids = draw.permutation(60)

    def batch(rows):
        terms = [np.flatnonzero(dense[i]) for i in rows]
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([t.tolist() for t in terms], pa.list_(pa.int64())), pa.array([dense[i][t].tolist() for i, t in zip(rows, terms)], pa.list_(pa.float64()))], names=["id", "t", "w"])

    asking = list(range(0, 60, 4)) + [17, 41]
    got = next(evaluate._nearest(iter([batch(ids[:33].tolist()), batch(ids[33:].tolist())]), evaluate._flat(batch(asking)))).to_pydict()
    sim = np.round(dense @ dense.T, 9)
    np.fill_diagonal(sim, -1)
    want = {i: (int(sim[i].argmax()), float(sim[i].max())) for i in asking if sim[i].max() > 0}
    assert {i: o for i, o in zip(got["id"], got["other"])} == {i: o for i, (o, _) in want.items()} and np.allclose(got["sim"], [want[i][1] for i in got["id"]])


def test_near_pairs_meet_by_three_tokens(spark):
    draw = np.random.default_rng(9)
    base = [sorted(draw.choice(40, int(draw.integers(1, 15)), replace=False).tolist()) for _ in range(60)]
    sets = [set(base[i % 60]) ^ {int(x) for x in draw.choice(40, i // 60 % 3)} for i in range(240)]
    rows = spark.createDataFrame([(i, [f"w{x}" for x in s]) for i, s in enumerate(sets)], "id long, t array<string>")
    assert rows.limit(1).select(F.size(dedup._combined(F.array(*[F.lit(str(x)) for x in range(7)]), dedup.SHARED))).first()[0] == 35
    got = {(r.a, r.b) for r in dedup.near_pairs(rows, "id", F.col("t"), 0.7).collect()}
    first = {frozenset(s): i for i, s in reversed(list(enumerate(sets))) if s}
    want = {(first[frozenset(s)], i) for i, s in enumerate(sets) if s and first[frozenset(s)] != i}
    want |= {(a, b) for s, a in first.items() for t, b in first.items() if a < b and len(s & t) / len(s | t) > 0.7}
    assert got == want


def test_places_and_brands_take_one_pass_and_agree_with_a_pattern_for_each_name(spark):
    texts = [
        "new delhi", "a newdelhi, delhi_ delhi", "Google Pay, IPL", "google payé axis banks", "hdfc bank sbi-upi", "world bank goan GOA", "san  francisco san francisco", "metanvidia", "naïve nse", "silicon valley new york", "hong kong1 hong kong",
        "nsé paris", "", None, "apple pay google pay", "\U0001F600pune\U0001F600",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    made = df.select("i", rules.city(F.col("t")).alias("c"), rules.brand_themes(F.col("t")).alias("b"))
    low = F.lower("t")
    cities = [*rules.CITIES_IN, *rules.CITIES_INTL]
    plain = df.select("i", F.array(*[F.when(low.rlike(rf"\b(?:{c})\b"), c.title()) for c in cities]).alias("c"), F.array(*[F.when(low.rlike(rf"\b(?:{'|'.join(n)})\b"), t) for t, n in rules.BRAND_THEMES.items()]).alias("b"))
    want = {r.i: (next((c for c in r.c if c), None), [b for b in r.b if b]) for r in plain.collect()}
    assert {r.i: (r.c and r.c.city, r.b) for r in made.collect()} == want
    assert want[0][0] == "Delhi" and want[2][1] == ["Finance", "Technology", "Sports"] and want[13] == (None, [])
    plan = made._jdf.queryExecution().analyzed().toString().lower()
    assert plan.count("rlike") == 0 and plan.count("regexp_extract_all") == 2


def test_vectors_are_dealt_out_as_they_are_and_a_chunk_is_compared_in_steps(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((60, 5)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    found = dedup.neighbours(df, df, 0.3, 4)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    sim = unit @ unit.T
    want = {(i, int(j)) for i in range(60) for j in sorted((j for j in range(60) if j != i and sim[i, j] >= 0.3), key=lambda j: -sim[i, j])[:4]}
    assert {(r.id, r.other) for r in found.collect()} == want
    leaves = found._jdf.queryExecution().analyzed().collectLeaves()
    kinds = [leaves.apply(k).schema().catalogString() for k in range(leaves.size())]
    assert any("array<float>" in k for k in kinds) and not any("array<double>" in k for k in kinds)
    monkeypatch.setattr(dedup, "AT_ONCE", 7)
    pdf = df.toPandas()
    both = dedup.pd.concat([pdf.assign(asks=True), pdf.assign(asks=False)])
    got = dedup._block(both, 0.3, 4, False)
    assert {(int(a), int(b)) for a, b in zip(got["id"], got["other"])} == want and len(want) > 100
