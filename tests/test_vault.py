"""The vault's columns on small rows with nulls, ties and empty lists."""

from pyspark.sql import functions as F

from questora.functions import formats, keywords
from questora.operators import vault


def one(spark, *columns, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(*columns).first()


def test_topics_and_entities(spark):
    s = keywords.topic_scores({"question": F.col("q"), "answer": F.col("a")})
    r = one(spark, s.alias("s"), keywords.chosen_topics(s).alias("c"), keywords.confident(s, 4.0).alias("sure"), q="Which river and which river cross the desert? A movie, too.", a="The Nile river")
    assert [(x["topic"], x["score"]) for x in r["s"]] == [("World Geography", 7.0), ("Movies & Entertainment", 2.5)]
    assert (r["c"]["primary"], r["c"]["topics"], r["c"]["subtopic"], r["sure"]) == ("World Geography", ["World Geography", "Movies & Entertainment"], "Movies & Entertainment", True)
    none = one(spark, keywords.chosen_topics(s).alias("c"), keywords.confident(s, 4.0).alias("sure"), q=None, a="")
    assert (none["c"]["primary"], none["c"]["topics"], none["c"]["subtopic"], none["sure"]) == ("General Knowledge", ["General Knowledge"], None, False)
    e = one(spark, keywords.entities(F.col("q")).alias("e"), q="which Sir Edmund Barton saw 'red tape' in Paris and the Great Barrier Reef? What is Edmund to Rome")["e"]
    assert e == ["Great Barrier Reef", "Sir Edmund Barton", "red tape", "Paris", "Rome"]


def test_formats(spark):
    f = formats.question_format(F.col("q"), F.col("a"), F.col("i"), F.col("r"))
    case = lambda q, a="", i=(), r=None: one(spark, f.alias("f"), q=q, a=a, i=list(i), r=r)["f"]
    assert case(None) == "STANDARD_QA"
    assert case("Clue 1: a") == "STEPPED_CLUE"
    assert case("x", "short", "abc") == "CONNECT_4"
    assert case("y" * 200, "short", "abc") == "STANDARD_QA"
    assert case("Arrange these") == "ARRANGE_ORDER"
    assert case("x", r="Ticker Tangle") == "ARRANGE_ORDER"
    assert case("x", "B -> A").startswith("STANDARD") and case("x", "B > A > C") == "ARRANGE_ORDER"
    d = one(spark, formats.connect_data(F.lit("CONNECT_4"), F.col("i"), F.col("a")).alias("d"), i=list("abcde"), a="x")["d"]
    assert [e["image_url"] for e in d["elements"]] == list("abcd") and d["common_link"] == "x"
    assert one(spark, formats.kept_format(F.col("a"), F.lit("STANDARD_QA")).alias("k"), a="ARRANGE_ORDER")["k"] == "ARRANGE_ORDER"


def test_answer_types(spark):
    t = formats.answer_type(F.col("a"), F.col("i"), F.col("s"), F.col("v"))
    assert one(spark, t.alias("t"), a="See the image.", i=["x"], s=[], v=[])["t"] == "IMAGE"
    assert one(spark, t.alias("t"), a="Nile", i=["x"], s=["y"], v=["z"])["t"] == "TEXT_VIDEO"
    assert one(spark, t.alias("t"), a=None, i=[], s=[], v=[])["t"] == "TEXT"


def test_validation(spark):
    v = vault.validated(F.col("q"), F.col("a"), F.col("o"), F.col("s"), F.col("d"), F.lit(None).cast("string"), F.lit(False), F.lit("Easy"), "easy", grade_max=5)
    ok = one(spark, v.alias("v"), q="Who saw it?", a="B) Rome", o=["Rome", "Paris", "Oslo", "Bonn"], s="a quote of some length", d="1")["v"]
    assert ok["status"] == "PASSED" and all(ok[k] for k in ok.asDict() if k != "status")
    assert one(spark, v.alias("v"), q="Who?", a="Rome", o=["Paris", "Paris", "Oslo", "Bonn"], s="", d=None)["v"]["status"] == "FAILED"
    thin = one(spark, v.alias("v"), q="Unquestionablyoverlongwords", a="Rome", o=[], s=None, d=None)["v"]
    assert (thin["status"], thin["grade_ok"], thin["grounded"], thin["sourced"]) == ("WARNING", False, False, False)


def test_paths_keep_order_and_first_spelling(spark):
    p = spark.createDataFrame(
        [("q", 0, "Art", "Music", ["#Piano", " x "]), ("q", 1, "Sport", None, []), ("q", 2, "art", "MUSIC", ["piano", "Lute", ""])], "id string, at int, l1 string, l2 string, keywords array<string>"
    )
    merged = vault.merged_paths(p, "id", "at")
    assert [(r["position"], r["l1"], r["l2"], r["keywords"]) for r in merged.orderBy("position").collect()] == [(0, "Art", "Music", ["Piano", "x", "Lute"]), (1, "Sport", None, [])]
    flat = vault.flat_tags(merged, "id").first()
    assert (flat["topic"], flat["subtopic"], flat["topics"], flat["tags"]) == ("Art", "Music", ["Art", "Sport"], ["Piano", "x", "Lute"])
    assert one(spark, vault.hashtags(F.col("t"), F.col("k")).alias("h"), t=["PIANO", "fun"], k=["Piano"])["h"] == ["fun"]


def test_hooks_begin_and_end_at_ascii_words(spark):
    hook, life = keywords.hook(F.col("q")).alias("h"), keywords.temporal_nature(F.col("q"), F.lit("")).alias("n")
    case = lambda q: tuple(one(spark, hook, life, q=q))
    assert case("éèon sur 59.2") == ("HISTORICAL_CONTEXT", "EVERGREEN") and case("mapé nowé") == ("VISUAL_CLUE", "TIME_SENSITIVE")
    assert case("maps xnow now_ 9map _map") == ("DIRECT_TRIVIA", "EVERGREEN")
    assert one(spark, keywords.curiosity(F.col("q"), F.col("q"), F.lit("DIRECT_TRIVIA")).alias("c"), q="ésecret")["c"] == 7


def test_names_and_phrases_are_read_once(spark):
    """Each regular expression stands in the expression once: none is worked out anew for each use of what it found."""
    from questora.functions import decks

    read = lambda c, what: spark.range(1).select(F.lit("x").alias("x")).select(c.alias("r"))._jdf.queryExecution().analyzed().expressions().apply(0).sql().count(what)
    assert read(keywords.entities(F.col("x")), "regexp_extract_all(") <= 3
    assert read(decks.deck_info(F.col("x")), "regexp_extract(") <= 8 * len(decks.DATES)
