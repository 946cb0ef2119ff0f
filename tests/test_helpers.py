"""Small column and table functions, each against values worked out by hand, and reports against loops."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from questora.functions import formats, providers, text, vectors
from questora.operators import curate, evaluate, history, relational, search
from questora.sources import files


def column(spark, rows, schema, made):
    return [r.x for r in spark.createDataFrame(rows, schema).select(made.alias("x")).collect()]


def test_grades_and_media(spark):
    low, high = F.col("a"), F.col("b")
    rows = [(1, 3), (4, 6), (7, 9), (None, None), (0, 0)]
    get = lambda made: column(spark, rows, "a int, b int", F.coalesce(made, F.lit(None).cast("boolean")))
    assert get(relational.grade_overlap(low, high, 5, 5)) == [False, True, False, None, False] and get(relational.grade_overlap(low, high, 4, 4)) == [True, True, False, None, False] and get(relational.grade_overlap(low, high, None, 5)) == [True] * 5
    assert get(relational.grade_within(low, high, 1, 6)) == [True, True, False, None, False] and get(relational.grade_within(low, high, None, None)) == [True] * 5
    assert get(relational.grade_not_disjoint(low, high, 5, 6)) == [False, True, False, True, True] and get(relational.grade_not_disjoint(low, high, None, None)) == [True] * 5
    media = [("", [], None), ("x", [], []), (None, ["p"], None), (" ", None, None)]
    has = lambda want: column(spark, media, "t string, i array<string>, v array<string>", relational.has_media(F.col("t"), [F.col("i"), F.col("v")], want))
    assert has(True) == [False, True, True, False] and has(False) == [True, False, False, True] and has(None) == [True] * 4
    paths = [(["a/Placeholder.PNG", "b/c.png", "missing.png"],), ([],), (None,)]
    assert column(spark, paths, "p array<string>", relational.real_media(F.col("p"))) == [["b/c.png"], [], None]


def test_formats_and_uses(spark):
    rows = [("CONNECT", None), (None, "CONNECT_4"), ("QA", "X"), (None, None)]
    get = lambda want: column(spark, rows, "a string, b string", relational.format_is([F.col("a"), F.col("b")], want))
    assert get("CONNECT_4") == [True, True, False, False] and get("SLIDE_QA") == [False, False, True, False] and get("X") == [False, False, True, False]
    used = [([("Q1", "school", 2020)],), ([("Q2", "college", 2024), ("Q3", None, None)],), ([],), (None,)]
    free = lambda *a: column(spark, used, "u array<struct<quiz:string,audience:string,year:int>>", relational.unused_by(F.col("u"), *a))
    assert free(["Q1"], []) == [False, True, True, True] and free([], ["college"], 2025) == [True] * 4 and free([], ["college"], 2024) == [True, False, True, True]


def test_texts(spark):
    get = lambda rows, made: column(spark, [(r,) for r in rows], "c string", made)
    c = F.col("c")
    assert get(["Sir C. V. Raman / Raman", "The Beatles, England", "Mooghee", None], text.answer_entity(c)) == ["c v raman", "beatles", "mughi", ""]
    assert get(["12. Who?", "Q3) What", "Q 7 - x", "1984 was a year", " 5: y "], text.strip_leading_number(c)) == ["Who?", "What", "x", "1984 was a year", "y"]
    assert get(["★ Who?", "x (starred)", "plain", "a*"], text.strip_star(c)) == ["Who?", "x", "plain", "a"] and get(["★ Who?", "x (starred)", "plain", "a*", "a*b"], text.has_star(c)) == [True, True, False, True, False]
    assert get(["1999", "999", "2027", "2028", "x", None], text.clean_year(c, 2025)) == [1999, None, 2027, None, None, None]
    assert get(["please create a 10 question quiz on gold loans", "", None], text.clean_title(c, F.lit("sport"))) == ["Gold Loans", "Sport Quiz", "Sport Quiz"]
    words = [(["#Gold", " gold ", "Silver", "", "#", "b"],), ([f"w{i}" for i in range(20)],)]
    assert column(spark, words, "w array<string>", text.clean_keywords(F.col("w"))) == [["Gold", "Silver", "b"], [f"w{i}" for i in range(12)]]
    labels = [(5, 2, 3), (5, None, 3), (None, None, None)]
    assert column(spark, labels, "n int, r int, i int", text.question_label(F.col("n"), F.col("r"), F.col("i"))) == ["Round 2 Q3", "Q5", None]
    assert get(["a?api_key=abc&x=1", "Authorization: Bearer abc.def"], text.redact_secrets(c)) == ["a?api_key=***&x=1", "Authorization: Bearer ***"]


def test_vectors_and_providers(spark):
    assert column(spark, [("[1, 2.5]",), ("no",), (None,)], "c string", vectors.from_text(F.col("c"))) == [[1.0, 2.5], [], []]
    got = column(spark, [([3.0, 4.0, 9.0],), ([0.0, 0.0],), ([1.0],)], "v array<double>", vectors.normalised(F.col("v"), 2))
    assert np.allclose(got[0], [0.6, 0.8]) and got[1:] == [None, None]
    out = column(spark, [("ab",), (None,), ("bad",), ("c",)], "c string", providers.embedded(F.col("c"), lambda texts: [None if t == "bad" else [float(len(t)), 1.0] for t in texts], size=2))
    assert out == [[2.0, 1.0], None, None, [1.0, 1.0]]


def test_tables(spark):
    deck = spark.createDataFrame([("d", "Delhi", 2024), ("e", None, 2023)], "deck string, city string, year int")
    rows = spark.createDataFrame([(1, "d", "Pune", 2000, ["city"]), (2, "d", "Pune", 2000, None), (3, "e", "Goa", 1, []), (4, "x", "y", 2, None)], "id int, deck string, city string, year int, manual_fields array<string>")
    assert sorted((r.id, r.city, r.year) for r in relational.propagate(deck, rows, "deck", ["city", "year"]).collect()) == [(1, "Pune", 2024), (2, "Delhi", 2024), (3, "Goa", 2023), (4, "y", 2)]
    kept = history.scoped_delete(rows, {"deck": "d", "city": "Pune"}).collect()
    assert sorted(r.id for r in kept) == [3, 4] and history.scoped_delete(rows, None, everything=True).count() == 0
    with pytest.raises(ValueError):
        history.scoped_delete(rows, {})
    a = spark.createDataFrame([(1, "x", None), (2, "y", "b"), (3, "z", "c")], "id int, l string, g string")
    b = spark.createDataFrame([(1, "x", None), (2, "q", "b"), (4, "z", "c")], "id int, l string, g string")
    assert tuple(evaluate.agreement(a, b, "id", ["l", "g"]).first()) == (2, 50.0, 100.0)
    gold = spark.createDataFrame([(1, "x", "y | z"), (2, "x", None), (3, "x", "y")], "id int, label string, alt string")
    pred = spark.createDataFrame([(1, "z"), (2, "x"), (3, "w")], "id int, p string")
    assert {r.id: (r.strict, r.lenient) for r in evaluate.accepted(gold, pred, "id", "label", "alt", "p").collect()} == {1: (False, True), 2: (True, True), 3: (False, False)}
    slots = spark.createDataFrame([(1, "a", True), (2, "b", False), (3, "c", False), (4, "d", True), (5, "e", False)], "slot int, id string, locked boolean")
    fills = spark.createDataFrame([(1, "X"), (2, "Y")], "pos int, id string")
    assert [(r.slot, r.id) for r in curate.refill(slots, fills).orderBy("slot").collect()] == [(1, "a"), (2, "X"), (3, "Y"), (4, "d"), (5, None)]
    items = spark.createDataFrame([(2, "B", "two"), (1, "A", "one")], "n int, t string, x string")
    assert search.prompt_context(items, "n", "t", "x").first().context == "[SRC-1] A\none\n\n[SRC-2] B\ntwo"
    docs = spark.createDataFrame([(1, "h", "COMPLETED", 5), (2, "h", "COMPLETED", 3), (3, "h", "FAILED", 1), (4, "i", "COMPLETED", 1), (5, None, "COMPLETED", 1)], "id int, sha string, status string, at int")
    assert {r.id: r.twin for r in files.identical(docs, "id", "sha", "status", "at").collect()} == {1: 2, 2: 1, 3: 2}


def test_labels_from_csv(spark, tmp_path):
    (tmp_path / "g.csv").write_text('﻿id,text\n1,"a ""quoted"" one,\nover two lines"\n2,\n', encoding="utf-8")
    got = files.gold_csv(spark, str(tmp_path / "g.csv"))
    assert got.columns == ["id", "text"] and [tuple(r) for r in got.collect()] == [("1", 'a "quoted" one,\nover two lines'), ("2", None)]


PAYLOADS = [
    (("1st clue: a\n2nd clue: b\n3rd clue: c portfolio builder", "x", None, ["p", "q"], None, None, "", ""), "STEPPED_CLUE"), (("No clues", "x", None, None, None, None, "", "THREE_CLUE"), "STEPPED_CLUE"), (("Any clue?", "x", None, None, None, None, "", "BUZZER"), "STEPPED_CLUE"),
    (("Arrange these", "B", ["o1", "o2", "o3", "o4", "o5"], ["p"], None, None, "", ""), "ARRANGE_ORDER"), (("In order of size\n1. ant\n2. bee\nC) cat\n4 - dog", "B", None, None, None, None, "", ""), "ARRANGE_ORDER"), (("Ticker tangle", None, [], ["a", "b", "c", "d"], None, None, "", ""), "ARRANGE_ORDER"),
    (("", "link", None, ["a", "b", "c", "d"], None, None, "", ""), "CONNECT_4"), (("Pick", "o", ["x"], ["a", "b", "c", "d"], None, None, "", ""), "VISUAL_CLUE"), (("Quick one", "o", None, None, None, None, "", "RAPID_FIRE"), "BUZZER"), (("Name all", "o", None, ["i"], None, None, "", "LIST_IT"), "LIST_IT"),
    (("Hear", "o", None, ["i"], ["s"], None, "", ""), "AUDIO_CLUE"), (("See", "o", None, ["i"], ["s"], ["v"], "", ""), "VIDEO_CLUE"), ((None, None, None, None, None, None, None, None), "QA"),
]


def test_payloads_of_eleven_formats(spark):
    schema = "q string, a string, o array<string>, i array<string>, s array<string>, v array<string>, x string, r string, n int"
    made = formats.structured(*[F.col(c) for c in "qaoisvxr"])
    got = {r.n: (r.s.format, json.loads(r.s.payload)) for r in spark.createDataFrame([(*p, n) for n, (p, _) in enumerate(PAYLOADS)], schema).select("n", made.alias("s")).collect()}
    assert [got[n][0] for n in range(len(PAYLOADS))] == [f for _, f in PAYLOADS] and all(p["type"] == f for f, p in got.values())
    assert [(c["text"], c["points"], c["points_wrong"], c["image"]) for c in got[0][1]["clues"]] == [("a", "+20/-15", 15, "p"), ("b", "+15/-10", 10, "q"), ("c portfolio builder", "+10/-5", 5, None)] and got[0][1]["answer"] == "x"
    assert [c["text"] for c in got[1][1]["clues"]] == ["No clues", "Additional context clue", "Direct giveaway clue"] and got[1][1]["clues"][0]["points_correct"] is None
    assert [(i["key"], i["text"], i["image"]) for i in got[3][1]["items"]] == [("A", "o1", "p"), ("B", "o2", None), ("C", "o3", None), ("D", "o4", None)] and got[3][1]["time_limit_seconds"] == 60
    assert [i["text"] for i in got[4][1]["items"]] == ["In order of size", "ant", "bee", "cat"] and [i["image"] for i in got[5][1]["items"]] == list("abcd") and got[5][1]["items"][1]["text"] == "Item B"
    assert got[6][1]["prompt"] == formats.CONNECT_PROMPT and [e["image_url"] for e in got[6][1]["elements"]] == list("abcd") and got[6][1]["common_link"] == "link"
    assert got[7][1] == {"type": "VISUAL_CLUE", "image_url": "a"} and got[11][1]["video_url"] == "v" and got[10][1]["audio_url"] == "s" and got[12][1] == {"type": "QA"} and got[9][1]["badge"] == "List It"


def test_reports_of_what_a_set_fell_short_of(spark):
    none = F.array().cast("array<string>")
    rows = [(i, "Easy" if i % 2 else "Hard", ["img"] if i == 1 else [], "TIME_SENSITIVE" if i in (2, 3) else "", "on" if i < 5 else "adjacent") for i in range(8)]
    pool = spark.createDataFrame(rows, "id int, difficulty string, question_images array<string>, shelf_life string, pool string").select(
        "*", F.lit("q").alias("question_text"), F.lit("a").alias("answer"), F.lit("t").alias("topic_l1"), F.lit("s").alias("subtopic_l2"), F.lit("").alias("geo_region"), F.lit("IN").alias("geography"), none.alias("answer_images"),
        F.lit("STANDARD_QA").alias("question_format"), F.lit(True).alias("tagged"), F.lit("NONE").alias("sensitivity"), F.lit(None).cast("double").alias("difficulty_score"),
    )
    brief = curate.Brief("q", count=4, filters={"no_images": True, "evergreen": True}, hard_bias="hard")
    got = curate.fulfilment_report(pool, brief, pool.where("id IN (0, 4)"), 0).first()
    assert (got.requested, got.delivered, got.short, got.padded, got.off_difficulty) == (4, 2, True, 0, 0)
    assert [tuple(s) for s in got.suggestions] == [("add_adjacent", None, 2), ("relax", "no_images", 1), ("relax", "evergreen", 2)]
    assert got.note == "Found 2 of 4 that fit. I can add 2 from adjacent topics if you want."
    brief.padding = True
    got = curate.fulfilment_report(pool, brief, pool.where("id IN (0, 4, 5)"), 1).first()
    assert got.note == "Found 3 of 4 that fit. 1 are from adjacent topics. 1 sit outside the difficulty you asked for." and [s.action for s in got.suggestions] == ["relax", "relax"]
    brief.count = 2
    got = curate.fulfilment_report(pool, brief, pool.where("id IN (0, 4)"), 0).first()
    assert (got.note, got.short, got.suggestions) == ("Here are 2 questions.", False, [])
    fine = curate.Brief("q", count=9)
    assert curate.fulfilment_report(pool.where("pool = 'on'"), fine, pool.where("pool = 'on'"), 0).first().note == "Found 5 of 9 that fit. That is everything the bank has for this request."
