"""From pools to sets, changes of a set, and decisions of reviewers."""

from pyspark.sql import functions as F

from questora.operators import curate, requests, review


def pool(spark, rows):
    schema = "id int, subtopic_l2 string, difficulty_score double, rank_score double, fp array<string>, pool string, score double"
    return spark.createDataFrame([(i, s, d, r, fp, p, r) for i, s, d, r, fp, p in rows], schema)


def test_a_whole_pool_is_read_as_a_list_would_be(spark):
    rows = [(i, f"s{i % 2}", (i * 37 % 100) / 100, 1000.0 - i, [f"w{i}", f"v{i}"], "on") for i in range(1000)]
    rows[5] = (5, "s1", 0.5, 995.0, ["w1", "v1"], "on")  # nearly the words of row 1
    rows += [(2000, "late", 0.1, 0.5, ["z"], "on"), (2001, "late", 0.2, 0.4, ["y"], "on")]
    df = pool(spark, rows)
    ranked = [{"id": i, "subtopic_l2": s, "difficulty_score": d, "fp": fp} for i, s, d, _, fp, _ in rows]
    for count in (10, 14):
        want = [r["id"] for r in curate.edit(curate.guard(ranked), count)]
        assert [r["id"] for r in curate.compiled(df, count)] == want and 5 not in want
    few = pool(spark, [(i, "s1", 0.5, 1000.0 - i, ["same", "words"], "on") for i in range(900)] + [(901, "s1", 0.5, 1.0, ["other"], "on")])
    assert [r["id"] for r in curate.compiled(few, 3)] == [0, 901]  # alike rows are read past
    # Two subtopics of at most five: two places go to a subtopic that comes after a thousand rows.
    assert {2000, 2001} <= {r["id"] for r in curate.compiled(df, 14)}


def test_short_sets_are_padded_only_where_asked(spark):
    df = pool(spark, [(1, "a", 0.5, 3.0, ["x"], "on"), (2, "b", 0.2, 2.0, ["y"], "adjacent"), (3, "c", 0.9, 1.0, ["z"], "adjacent")])
    brief = curate.Brief("q", count=3)
    assert ([r["id"] for r in curate.draft(df, brief)[0]], curate.draft(df, brief)[1]) == ([1], 0)
    brief.padding = True
    rows, n = curate.draft(df, brief)
    assert [r["id"] for r in rows] == [1, 2, 3] and n == 2
    assert curate.swapped(df, 1, {2})["id"] == 3 and curate.swapped(df, 1, {2, 3}) is None


def test_requests_for_changes(spark):
    df = pool(spark, [(i, f"s{i}", i / 10, 10.0 - i, [f"w{i}"], "on") for i in range(8)])
    asked = []
    pools = lambda topic: (asked.append(topic), df)[1]

    def refined(current, prompt, **how):
        row = requests.parsed(spark.createDataFrame([(prompt,)], "p string"), F.col("p")).first()
        return curate.refined(current, row, pools, **how)

    assert refined([3, 4, 5], "replace question 2 with gold") == [3, 0, 5] and asked == ["gold"]
    assert refined([3, 4, 5], "remove question 1") == [4, 5] and refined([3], "0 questions") == []
    assert refined([3, 4], "add 2 more") == [3, 4, 1, 0]
    assert refined([3, 4, 5], "make it harder", locked={4}) == [1, 4, 0]
    assert refined([3, 4, 5], "change 2 questions to opera and keep the rest", locked={4}) == [1, 4, 0] and asked[-1] == "opera"
    assert refined([3, 4], "replace question 9 with gold") == [1, 0]


def test_audience_changes_the_rank(spark):
    none = F.array().cast("array<string>")
    df = spark.createDataFrame([(1, "a", "IN", "school"), (2, "b", "INTL", "corporate")], "id int, question_text string, geography string, primary_audience string").select(
        "*", F.lit("").alias("answer"), F.lit("x").alias("topic_l1"), F.lit("y").alias("subtopic_l2"), F.lit("").alias("geo_region"), none.alias("question_images"), none.alias("answer_images"), F.lit("STANDARD_QA").alias("question_format"),
        F.lit(True).alias("tagged"), F.lit("NONE").alias("sensitivity"), F.lit("").alias("shelf_life"), F.lit("Easy").alias("difficulty"), F.lit(0.2).alias("difficulty_score"), F.lit(2.0).alias("score"),
    )
    got = {r.id: r.rank_score for r in curate.split_pools(df, curate.Brief("q", filters={"india_focused": True}, audience="school")).collect()}
    assert abs(got[1] - (2 + 0.5 + 0.8)) < 1e-9 and abs(got[2] - (2 - 0.4 - 1.5)) < 1e-9


def test_reviews_keep_their_rules(spark):
    tags = spark.createDataFrame([(["a", "B "],), ([],), (None,)], "t array<string>")
    assert [r.x for r in tags.select(review.patched_tags(F.col("t"), ["b", "C", "c"], ["A"]).alias("x")).collect()] == [["B ", "C"], ["b", "C"], ["b", "C"]]
    tables = {"q": spark.createDataFrame([(1, "d"), (2, "e")], "id int, doc string"), "tag": spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "question_id int, v string")}
    left = review.deleted(tables, "q", "doc", ["d"])
    assert [r.id for r in left["q"].collect()] == [2] and sorted(r.v for r in left["tag"].collect()) == ["y", "z"]
    try:
        review.deleted(tables, "q", "doc", [])
        raise AssertionError("unscoped deletion went through")
    except ValueError:
        assert review.deleted(tables, "q", "doc", None, everything=True)["q"].count() == 0
    paths = spark.sql("SELECT array(named_struct('l1', 'A', 'l2', 'x', 'keywords', array('k')), named_struct('l1', 'B', 'l2', 'Y', 'keywords', array('m')), named_struct('l1', 'B', 'l2', 'y', 'keywords', array('n'))) AS p")
    lead = paths.select(review.with_first_path(F.col("p"), F.lit("C"), F.lit("x")).alias("r")).first().r
    assert [(p.l1, p.l2, p.keywords) for p in lead] == [("C", "x", ["k"]), ("B", "Y", ["m"])]
    repeats = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "q int, r int")
    rest, counts = review.repeats_without(repeats, spark.createDataFrame([(11,), (12,)], "r int"), "q", "r")
    assert rest.count() == 1 and {r.q: r.occurrence_count for r in counts.collect()} == {1: 2, 2: 1}
    done = spark.createDataFrame([("confirmed", None), ("draft", None), (None, "x")], "status string, error string")
    assert tuple(review.batch_counters(done).first()) == (3, 1, 1, 1)


def test_sets_by_difficulty_and_replacements(spark):
    assert curate.shares(10, {"Easy": 0.3, "Medium": 0.5, "Hard": 0.2}) == {"Easy": 3, "Medium": 5, "Hard": 2} and curate.shares(2, {"a": 1, "b": 1, "c": 1}) == {"a": 1, "b": 1, "c": 0}
    df = spark.createDataFrame([(i, "ab"[i % 2], ["Easy", "Medium", "Hard"][min(2, i % 5)], 100 - i) for i in range(30)], "id int, topic_l1 string, difficulty string, score int")
    got = curate.by_difficulty(df, 10, {"Easy": 0.4, "Medium": 0.4, "Hard": 0.2}, ["id"]).collect()
    assert sorted(r.pos for r in got) == list(range(1, 11)) and sorted(r.difficulty for r in got) == ["Easy"] * 4 + ["Hard"] * 2 + ["Medium"] * 4
    short = curate.by_difficulty(df.where("difficulty <> 'Easy' OR id = 0"), 6, {"Easy": 1.0}, ["id"]).collect()
    assert len(short) == 6 and short[0].id == 0
    assert curate.instead_of(df, 0, "harder", ["id"]).first().id == 6 and curate.instead_of(df, 0, "easier", ["id"]).first().id == 10 and curate.instead_of(df, 0, "similar", ["id"]).first().difficulty == "Easy"
    assert curate.instead_of(df, 999, "harder", ["id"]).count() == 0


def test_merges_run_twice_change_nothing_more(spark):
    meta = spark.createDataFrame([(1, "A", None, ["city"]), (2, "B", "x", None)], "q int, city string, fmt string, manual_fields array<string>")
    fresh = spark.createDataFrame([(1, "Z", "f"), (2, None, "g"), (3, "C", "h")], "q int, city string, fmt string")
    once = review.ensured_meta(meta, fresh, "q", ["city", "fmt"])
    assert sorted((r.q, r.city, r.fmt) for r in once.collect()) == [(1, "A", "f"), (2, "B", "g"), (3, "C", "h")]
    assert sorted(map(str, review.ensured_meta(once, fresh, "q", ["city", "fmt"]).collect())) == sorted(map(str, once.collect()))
    assert [r.q for r in review.backfilled(fresh, meta, "q").collect()] == [3] and review.backfilled(fresh, fresh, "q").count() == 0
    slides = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "doc int, n int, t string")
    assert sorted(r.t for r in review.rebuilt(slides, spark.createDataFrame([(1, 1, "new")], "doc int, n int, t string"), "doc").collect()) == ["c", "new"]
    assert sorted(r.t for r in review.replaced_paths(slides, slides.where("n = 2"), "doc").collect()) == ["b", "c"]


def test_views_and_filters_of_the_bank(spark):
    from questora.operators import bank, search

    rows = spark.createDataFrame([(1, None, "a", None, None, None, None, None, [], ["x.MP4", "y.png"]), (2, "q", None, "e", "T", "Hard", ["o"], ["i"], ["v.mov"], ["z.mp4"])], "id int, question_text string, answer string, explanation string, topic string, difficulty string, options array<string>, image_refs array<string>, video_refs array<string>, raw_media_refs array<string>")
    got = {r.id: r for r in bank.api_view(rows).collect()}
    assert (got[1].question_text, got[1].topic, got[1].difficulty, got[1].options, got[1].video_refs) == ("", "General Knowledge", "Medium", [], ["x.MP4"]) and got[2].video_refs == ["v.mov"]
    meta = spark.createDataFrame([(2, "CONNECT_4")], "id int, question_format string")
    assert [r.id for r in bank.with_format(rows, meta, "id", "CONNECT_4").collect()] == [2] and [r.id for r in bank.with_format(rows, meta, "id", "STANDARD_QA").collect()] == [1] and bank.with_format(rows, meta, "id", None) is rows
    d = spark.createDataFrame([(1, "en", ["a", "b"], 1.0), (2, "en", ["B"], 9.0), (3, "fr", ["a", "b"], 5.0)], "id int, lang string, tags array<string>, r double")
    pick = lambda want: [r.id for r in bank.by_filters(d, "id", want, F.col("tags"), ["A", "b"], F.col("r"), 2).collect()]
    assert pick({"lang": "en"}) == [1, 2] and pick({"lang": "xx"}) == [3, 1]
    images = spark.createDataFrame([("a.gif", 9000, 100, 100, False), ("b.png", 100, 100, 100, False), ("c.png", 9000, 79, 100, False), ("d.png", 9000, 80, 80, None), ("e.png", 9000, 80, 80, True)], "name string, bytes int, width int, height int, is_video_icon boolean")
    assert [r.name for r in bank.valid_images(images).collect()] == ["d.png"]
    asked = spark.createDataFrame([("Gold loans!",), (None,), ("",)], "q string")
    known = {"gold": ["silver"], "loans and credit": ["emi"], "sport": ["ball"]}
    assert [r.x for r in asked.select(search.expanded_terms(F.col("q"), known).alias("x")).collect()] == [["emi", "gold", "loans", "silver"], [], []]
    assert asked.select(search.expanded_terms(F.col("q"), {}).alias("x")).first().x == ["gold", "loans"]


def test_a_draft_equals_lists_from_end_to_end(spark):
    import math
    import re

    from conftest import SF

    from questora.functions.text import STOP_WORDS
    from questora.plans import bank

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    tokens = {r.doc_id: [w for w in re.findall("[a-z0-9]{2,}", (r.text or "").lower()) if w not in STOP_WORDS] for r in docs}
    weight, n, mean = {"erandst": 1.0, "thtion": 1.0, "rerer": 0.4, "oren": 0.4}, len(docs), sum(map(len, tokens.values())) / len(docs)
    df = {w: sum(w in t for t in tokens.values()) for w in weight}
    pool = []
    for r in docs:
        t = tokens[r.doc_id]
        hits = {w: t.count(w) for w in weight if w in t}
        score = sum(weight[w] * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * k * 2.5 / (k + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w, k in hits.items())
        hard = min(r.n_chars, 10_000) / 10_000
        if hits and score >= curate.FLOOR:
            pool.append({"id": r.doc_id, "subtopic_l2": r.source, "difficulty_score": hard, "rank_score": score - curate.PENALTY * min(1.0, max(0.0, 0.65 - hard) / 0.35), "fp": set(t[:14])})
    kept = []
    for r in sorted(pool, key=lambda r: (-r["rank_score"], r["id"])):
        if all(len(r["fp"] & k["fp"]) <= 0.7 * len(r["fp"] | k["fp"]) for k in kept):
            kept.append(r)
    first, later = [], []
    for r in kept:
        (first if sum(x["subtopic_l2"] == r["subtopic_l2"] for x in first) < 4 else later).append(r)
    want = sorted((first + later)[:10], key=lambda r: r["difficulty_score"])
    got = bank.draft_quiz(spark, SF).orderBy("position").collect()
    assert [(r.id, r.subtopic_l2, round(r.rank_score, 6)) for r in got] == [(r["id"], r["subtopic_l2"], round(r["rank_score"], 6)) for r in want] and len(got) == 10
