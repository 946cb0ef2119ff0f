"""Ordered decks: slide kinds, carried headers, numbering, question and answer pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parsing

# Kinds of a slide in order of precedence on equal scores.
KINDS = ["TITLE", "SECTION_MARKER", "SCOREBOARD", "RULES", "AV_TEST", "TEAM_INTRO", "ANNOUNCEMENT", "ANSWER_TRANSITION", "QUESTION", "ANSWER", "CONTENT"]
# Signs of each kind.
TRANSITION = r"(?i)^\s*(answer|answers|ans|solution|solutions|the\s+answer|let['’]?s\s+see\s+the\s+answer)\s*[.:\-]?\s*$"
SECTION = r"\b(round\s*\d+|section\s*\d+|part\s*\d+|theme\s*\d+|finals|prelims|tie\s*breaker|topicator|potpourri|rapid\s*fire|list\s*it|buzzer|intermission|break)\b"
TITLE = r"\b(welcome|guidelines|quiz master|instructions|thank you|prizes|prize|structure of the quiz)\b"
RULES = r"\b(rules|instructions for prelims|marking scheme|scoring system|\+20 for direct|\+10 for a pass)\b"
AV = r"\b(av test|audio video test|sound check|mic check)\b"
TEAM = r"\b(presenting the finalists|finalists|team \d+|meet the teams)\b"
NOTICE = r"\b(social media|follow @|hand in your sheets)\b|^\s*announcement\s*[:\-]?\s*$"
SCORES = r"scoreboard|scores|leaderboard|points"
ANSWER_PREFIX = r"(?m)^\s*(ans|answer|solution)\s*[:\-]"
ANSWER = r"\b(ans|answer|correct answer|solution|explanation|did you know|trivia|it is|the answer is|this was)\b"
NUMBERED = r"^[0-9]+[.)]\s+"
QUESTION_SIGNS = [
    r"\?", r"\b(who|what|where|when|why|which|how|identify|name the)\b", r"\b(q\d+|question\s*\d*)\b", NUMBERED, r"\(a\).*\(b\)", r"clue\s*\d*",
    r"lowest to highest|highest to lowest|earliest to latest|from 1st to last|chronological order|arrange|ticker tangle", r"\bconnect\b",
]


def slide_scores(title: Column, text: Column, notes: Column, number: Column) -> dict[str, Column]:
    """A score per kind of slide from its own text."""
    t, x, n = (F.trim(F.coalesce(c, F.lit(""))) for c in (title, text, notes))
    full, lt, lx = F.lower(F.concat_ws("\n", t, x, n)), F.lower(t), F.lower(x)
    words = F.regexp_count(x, F.lit(r"\S+"))
    hits = sum((full.rlike(p).cast("int") for p in QUESTION_SIGNS), F.lit(0))
    section = F.when(lt.rlike(SECTION), 0.85).when(lx.rlike(SECTION) & (words < 10), 0.75).otherwise(0.0)
    one = F.when(full.contains("?") | full.rlike(r"\b(q\d+|question|name the|identify)\b"), 0.60).when(lx.rlike(NUMBERED) | lt.rlike(r"^[0-9]+[.)]\s*$"), 0.65).otherwise(0.35)
    bare = t.rlike(TRANSITION) | x.rlike(TRANSITION) | F.trim(F.concat_ws(" ", t, x)).rlike(TRANSITION)
    when = lambda cond, v: F.when(cond, v).otherwise(0.0)
    scores = {
        "TITLE": F.lit(0.1) + when(number == 1, 0.7) + when(lt.rlike(TITLE), 0.65), "SECTION_MARKER": section, "SCOREBOARD": when(full.rlike(SCORES), 0.85), "RULES": when(full.rlike(RULES), 0.85),
        "AV_TEST": when(full.rlike(AV), 0.90), "TEAM_INTRO": when(full.rlike(TEAM), 0.85), "ANNOUNCEMENT": when(full.rlike(NOTICE) & ~full.contains("?") & ~lx.rlike(NUMBERED), 0.80),
        "QUESTION": F.when(hits >= 2, 0.80).when(hits == 1, one).otherwise(0.0),
        "ANSWER": F.when(section >= 0.5, 0.0).when(lx.rlike(ANSWER_PREFIX), 0.90).when(full.rlike(ANSWER), 0.60).otherwise(0.0), "CONTENT": F.lit(0.3),
    }
    plain = {"TITLE": 0.1, "CONTENT": 0.3}
    out = {k: F.when(bare, F.lit(plain.get(k, 0.0))).otherwise(v) for k, v in scores.items()}
    out["ANSWER_TRANSITION"] = when(bare, 0.98)
    return out


def slide_kind(scores: dict[str, Column]) -> Column:
    """The kind of the largest score, the first in ``KINDS`` on a tie."""
    ranked = F.array(*[F.struct(scores[k].alias("s"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, k in enumerate(KINDS)])
    return F.array_max(ranked)["k"]


#: Wordings of a slide between a round of questions and their answers.
DIVIDER = (
    r"(?i)\b(please\s+hand\s+in\s+your\s+sheets|answers\s+follow|let['’]?s\s+discuss\s+(the\s+)?answers|preliminary\s+round\s+answers|prelim\s+answers"
    r"|time\s+for\s+(the\s+)?answers|now\s+for\s+(the\s+)?answers)\b|^\s*(answers|solutions)\s*$"
)


def classify_decks(slides: DataFrame) -> DataFrame:
    """``slides`` with ``slide_type``: own kind, then one pass in order that sees the kinds already settled.

    In a deck of two sections, questions before the divider are QUESTION_PREVIEW. The pass depends on the
    kind it gave the slide before, so it is a fold over a deck's slides as one ordered array; a deck is a bounded
    group. Rows whose document or number repeats stay rows of their own; slides without a number come first.
    """
    title, text = (F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "extracted_text"))
    s = slide_scores(F.col("title"), F.col("extracted_text"), F.col("speaker_notes"), F.col("slide_number"))
    asks = F.concat(text, title).rlike(r"^\s*\d+[.)]|\?")
    own = slides.withColumns({
        "__kind": slide_kind(s), "__section": s["SECTION_MARKER"], "__board": s["SCOREBOARD"], "__question": s["QUESTION"], "__asks": asks,
        "__divides": F.concat_ws(" ", title, text).rlike(DIVIDER), "__bare": text.rlike(TRANSITION),
    })
    payload = F.struct(F.col("slide_number").alias("__at"), *[F.col(c) for c in slides.columns if c != "document_id"], *[F.col(c) for c in own.columns if c.startswith("__")])
    decks = own.groupBy("document_id").agg(F.sort_array(F.collect_list(payload)).alias("deck"))
    n, at = F.size("deck"), lambda f: F.transform("deck", f)
    # The first divider in the middle of the deck, with two questions on either side of it.
    places = F.filter(F.transform("deck", lambda x, i: F.when(x["__divides"] & (i >= 4) & (i < F.least(n - 2, F.floor(n * 0.85))), i)), lambda i: i.isNotNull())
    start = F.when(n >= 6, F.get(places, 0))
    asked = F.col("asked")
    count = lambda a: F.aggregate(a, F.lit(0), lambda t, x: t + x)
    marked = decks.withColumns({"start": start, "asked": at(lambda x: x["__asks"].cast("int"))})
    two = F.col("start").isNotNull() & (count(F.slice(asked, F.lit(1), F.greatest(F.col("start"), F.lit(0)))) >= 2) & (count(F.slice(asked, F.col("start") + 1, n)) >= 2)
    preview = lambda x, i: F.when(two & (i < F.col("start")) & (x["__kind"] == "QUESTION"), "QUESTION_PREVIEW").otherwise(x["__kind"])
    first = marked.withColumn("first", F.transform("deck", preview))

    def settle(state: Column, i: Column) -> Column:
        x, here, before = F.get("deck", i), F.get("first", i), state["last"]
        after = F.get("first", i + 1)
        shown = (after == "ANSWER_TRANSITION") | F.coalesce(F.get("deck", i + 1)["__bare"], F.lit(False))
        answer = ((before == "ANSWER_TRANSITION") & here.isin("CONTENT", "TITLE", "QUESTION") & (x["__section"] < 0.6)) | (
            (before == "QUESTION") & here.isin("CONTENT", "TITLE") & (x["__section"] < 0.5) & (x["__board"] < 0.5)
        )
        recheck = (here == "ANSWER") & F.coalesce(x["extracted_text"].contains("?"), F.lit(False)) & (x["__question"] >= 0.5)
        kind = F.when(F.coalesce(shown, F.lit(False)) & (here != "SECTION_MARKER"), "QUESTION").when(recheck, "QUESTION").when(F.coalesce(answer, F.lit(False)), "ANSWER").otherwise(here)
        return F.struct(kind.alias("last"), F.array_append(state["kinds"], kind).alias("kinds"))

    begin = F.struct(F.lit(None).cast("string").alias("last"), F.array().cast("array<string>").alias("kinds"))
    kinds = F.aggregate(F.sequence(F.lit(0), n - 1), begin, settle, lambda state: state["kinds"])
    each = first.select("document_id", F.explode(F.arrays_zip("deck", kinds.alias("kinds"))).alias("s"))
    return each.select(*[F.col("document_id") if c == "document_id" else F.col(f"s.deck.{c}").alias(c) for c in slides.columns], F.col("s.kinds").alias("slide_type"))


#: A deck has a layout from so many slides on; its divider comes after the first few and before the last part.
LAYOUT_SLIDES, FIRST_SLIDES, LAST_PART = 6, 4, 0.85
# Signs of a question on a slide, and of an answer in its notes.
NUMBERED_OR_ASKS, NOTES_ANSWER = r"^\s*\d+[.)]|\?", r"(?i)\b(ans|answer|correct|solution|http)\b"


def layouts(slides: DataFrame) -> DataFrame:
    """(document_id, layout, answers_start) of decks (document_id, slide_number, title, extracted_text, speaker_notes).

    TWO_SECTION: a divider in the middle with two questions or more on either side, at the 0-based ``answers_start``. NOTES_BASED: answers in the notes of five slides
    and of 35 percent of all. Otherwise, and for short decks, INTERLEAVED.
    """
    w = Window.partitionBy("document_id")
    text, title, notes = (F.coalesce(c, F.lit("")) for c in ("extracted_text", "title", "speaker_notes"))
    rows = slides.select(
        "document_id", (F.row_number().over(w.orderBy("slide_number")) - 1).alias("at"), F.count("*").over(w).alias("n"), F.concat(text, title).rlike(NUMBERED_OR_ASKS).cast("int").alias("q"),
        F.concat_ws(" ", F.lower(F.trim(title)), F.lower(F.trim(text))).rlike(DIVIDER).alias("d"), ((F.length(F.trim(notes)) > 10) & notes.rlike(NOTES_ANSWER)).cast("int").alias("a"),
    )
    inside = (F.col("at") >= FIRST_SLIDES) & (F.col("at") < F.least(F.col("n") - 2, F.floor(F.col("n") * F.lit(LAST_PART))))
    placed = rows.withColumn("s", F.min(F.when(F.col("d") & inside, F.col("at"))).over(w))
    before = F.sum(F.when(F.col("at") < F.col("s"), F.col("q")))
    g = placed.groupBy("document_id").agg(F.max("n").alias("n"), F.max("s").alias("s"), before.alias("before"), F.sum("q").alias("q"), F.sum("a").alias("a"))
    two = F.col("s").isNotNull() & (F.col("before") >= 2) & (F.col("q") - F.col("before") >= 2)
    noted = F.col("a") >= F.greatest(F.lit(5), F.floor(F.col("n") * F.lit(0.35)))
    kind = F.when(F.col("n") < LAYOUT_SLIDES, "INTERLEAVED").when(two, "TWO_SECTION").when(noted, "NOTES_BASED").otherwise("INTERLEAVED")
    return g.select("document_id", kind.alias("layout"), F.when(kind == "TWO_SECTION", F.col("s")).alias("answers_start"))


def carried(df: DataFrame, deck: str, at: str, header: Column, name: str) -> DataFrame:
    """``df`` with the last non-null header at or before each row."""
    w = Window.partitionBy(deck).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(header, ignorenulls=True).over(w))


def carried_with_reset(df: DataFrame, deck: str, at: str, value: Column, reset: Column, name: str) -> DataFrame:
    """As ``carried``, but a row where ``reset`` holds carries null onwards."""
    mark = F.when(reset, F.struct(F.lit(None).cast("long").alias("v"))).when(value.isNotNull(), F.struct(value.cast("long").alias("v")))
    w = Window.partitionBy(deck).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(mark, ignorenulls=True).over(w)["v"])


def numbered(df: DataFrame, deck: str, at: str, part: str) -> DataFrame:
    """``question_number`` in the deck and ``question_in_round`` in the part."""
    w = Window.partitionBy(deck)
    return df.withColumns({"question_number": F.row_number().over(w.orderBy(at)), "question_in_round": F.row_number().over(Window.partitionBy(deck, part).orderBy(at))})


def adjacent_pairs(df: DataFrame, deck: str, at: str, kind: str, first: str, second: str, text: str) -> DataFrame:
    """A question and the answer on the next slide."""
    w = Window.partitionBy(deck).orderBy(at)
    nxt = df.withColumns({"__k": F.lead(kind).over(w), "__t": F.lead(text).over(w), "__a": F.lead(at).over(w)})
    return nxt.where((F.col(kind) == first) & (F.col("__k") == second)).select(deck, F.col(at).alias("question_at"), F.col("__a").alias("answer_at"), F.col(text).alias("question"), F.col("__t").alias("answer"))


# Kinds of slides that start no question, and wordings of rounds, bumpers and orders to arrange.
NO_START = ["TITLE", "RULES", "AV_TEST", "TEAM_INTRO", "SCOREBOARD", "ANNOUNCEMENT", "QUESTION_PREVIEW", "ANSWER_TRANSITION"]
BUFFER = ["buffer", "buffer question", "buffer questions"]
ROUND = r"(?i)Round\s*(\d+)(?:\s*[:\-]?\s*(.*))?"
BUMPER = r"(?i)^\s*Question\s*\d*\s*$"
ARRANGE = r"(?i)lowest\s+to\s+highest|highest\s+to\s+lowest|earliest\s+to\s+latest|from\s+1st\s+to\s+last|chronological\s+order|ticker\s+tangle|arrange"
MORE = r"(?i)explanation|trivia|did you know|context"
NO_ANSWER = ["see explanation", "answer indicated on slide"]
CONNECT_TEXT = "What connects all these clues and images?"


def _headers(slides: DataFrame) -> DataFrame:
    """``slides`` with ``__header`` and the round and subtopic that hold from each slide on: those of the last header before it."""
    both = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("extracted_text", F.lit("")))
    starts = ~F.coalesce(F.col("slide_type").isin(NO_START), F.lit(False))
    audience = starts & F.lower(both).contains("audience question")
    header = starts & ~audience & ((F.col("slide_type") == "SECTION_MARKER") | both.rlike(r"(?i)\bround\s*\d+"))
    number = F.regexp_extract(both, ROUND, 1)
    after, before = F.trim(F.regexp_extract(both, ROUND, 2)), F.regexp_extract(both, r"(?i)([A-Za-z\s–-]+?)\s*\n?\s*Round\s*\d+", 1)
    before = F.trim(F.regexp_replace(before, r"^[–\-:\t ]+", ""))
    raw = F.when(F.length(after) > 2, after).when((before != "") & ~F.lower(before).isin("structure of the quiz", "quiz", "structure"), before).otherwise(after)
    first = F.trim(F.get(F.split(F.regexp_replace(raw, r"^[–\-:\t ]+", ""), r"(?i)\n|\d+\s*questions"), 0))
    clean = F.regexp_replace(F.regexp_replace(first, r"(?i)^(?:Round\s*\d+\s*[-–—:]*\s*)+", ""), r"^[–—\-: \t]+|[–—\-: \t]+$", "")
    named = header & (number != "")
    subtopic = F.when(audience, "Audience Questions").when(named & (F.length(raw) > 2), F.when(clean != "", clean).otherwise(F.concat(F.lit("Round "), number)))
    w = Window.partitionBy("document_id").orderBy("slide_number").rowsBetween(Window.unboundedPreceding, 0)
    return slides.withColumns({
        "__header": F.coalesce(header | audience | ~starts | F.lower(F.trim("extracted_text")).isin(BUFFER), F.lit(False)),
        "__round": F.last(F.when(audience, 99).when(named, number.try_cast("int")), ignorenulls=True).over(w), "__topic": F.last(subtopic, ignorenulls=True).over(w),
    })


def extract_questions(slides: DataFrame) -> DataFrame:
    """(document_id, pattern, question, options, answer, explanation, round_number, subtopic, first_slide, last_slide).

    Nine patterns are tried at a slide, in order: in rounds of stepped clues, of orders to arrange and of connections, and
    after a bumper, an announcing slide is followed by clues or prompt, a transition and the reveal; else a question by
    transition and reveal (and a slide that explains), by a clue, transition and reveal, by an answer, by a clue and an answer, or it has its
    answer in its notes or text. Answers that are empty or a bare URL do not count, and the next pattern is tried. A
    match moves on past its slides, each of which is used once; which matches hold is a fold over a deck's slides as one array, a deck being a bounded
    group. Headers, previews and buffers start nothing. Missing columns for title or notes count as empty.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in slides.columns else F.lit("")
    src = _headers(slides.select("document_id", "slide_number", "slide_type", text("title").alias("title"), text("extracted_text").alias("extracted_text"), text("speaker_notes").alias("speaker_notes")))
    body = F.trim("extracted_text")
    here = F.struct(
        F.col("slide_type").alias("kind"), F.col("extracted_text").alias("text"), "title", F.col("slide_number").alias("at"), parsing.answer_parts(F.col("extracted_text")).alias("said"),
        parsing.answer_parts(F.col("speaker_notes")).alias("noted"), parsing.question_parts(F.col("extracted_text")).alias("asked"),
        ((F.col("slide_type") == "ANSWER_TRANSITION") | body.rlike(r"(?i)^(answer|answers|ans)$")).alias("turns"),
    )
    deck = Window.partitionBy("document_id").orderBy("slide_number")
    rows = src.withColumn("s0", here)
    rows = rows.withColumns({f"s{k}": F.lead("s0", k).over(deck) for k in range(1, 6)})
    s = [F.col(f"s{k}") for k in range(6)]
    topic, number = F.lower(F.coalesce("__topic", F.lit(""))), F.coalesce("__round", F.lit(0))
    no = F.lit(None).cast("array<string>")

    def fits(answer: Column) -> Column:
        return (answer != "") & ~F.lower(answer).rlike("^https?://") & ~F.lower(answer).isin(NO_ANSWER)

    def match(name: str, cond: Column, question: Column, options: Column, answer: Column, more: Column, first: Column, last: Column, step: Column | int, default: str | None, badge: Column | None = None) -> Column:
        made = F.struct(
            F.lit(name).alias("pattern"), question.alias("question"), options.alias("options"), answer.alias("answer"), F.btrim(more, F.lit(" \t\r\n")).alias("explanation"), F.coalesce("__round", F.lit(None) if badge is None else badge["number"]).alias("round_number"),
            F.coalesce("__topic", F.lit(default) if badge is None else badge["theme"]).alias("subtopic"), first["at"].cast("long").alias("first_slide"), last["at"].cast("long").alias("last_slide"), (F.lit(step) if isinstance(step, int) else step).alias("step"),
        )
        return F.when(F.coalesce(cond & fits(answer), F.lit(False)), made)

    tell = lambda x: F.when(x["said"]["explanation"] != "", x["said"]["explanation"]).otherwise(x["text"])
    clue = lambda n, points: F.concat(F.lit(f"Clue {n} ({points}): "), F.trim(s[n]["text"]))
    stepped = match("STEPPED", ((number == 3) | topic.contains("portfolio builder")) & s[4]["turns"], F.concat_ws("\n\n", clue(1, "+20/-15"), clue(2, "+15/-10"), clue(3, "+10/-5")), no, s[5]["said"]["answer"], tell(s[5]), s[1], s[5], 6, "Portfolio Builder")
    prompt = F.trim(s[1]["text"])
    arrange = match("ARRANGE", ((number == 2) | topic.contains("ticker tangle") | s[1]["text"].rlike(ARRANGE)) & s[2]["turns"], prompt, no, s[3]["said"]["answer"], tell(s[3]), s[1], s[3], 4, "Ticker Tangle")
    connect = match("CONNECT", ((number == 4) | topic.contains("market indicators")) & s[2]["turns"], F.when(F.length(prompt) > 25, prompt).otherwise(CONNECT_TEXT), no, s[3]["said"]["answer"], tell(s[3]), s[1], s[3], 4, "Market Indicators")
    bumper = s[0]["text"].rlike(BUMPER) | ((F.length(body) <= 15) & F.lower(body).contains("question"))
    announced = match("BUMPER", bumper & s[2]["turns"], s[1]["asked"]["question"], s[1]["asked"]["options"], s[3]["said"]["answer"], tell(s[3]), s[1], s[3], 4, None, s[1]["asked"])
    asks, mine = s[0]["kind"] == "QUESTION", s[0]["asked"]
    named = lambda x: F.when((x["title"] != "") & (x["title"] != "NO_TITLE"), x["title"])
    some = lambda c: F.when(c != "", c)
    revealed = F.coalesce(some(s[2]["said"]["answer"]), named(s[2]), some(s[2]["noted"]["answer"]), F.lit(""))
    extra = F.coalesce(s[3]["title"].rlike(MORE) | s[3]["text"].rlike(MORE), F.lit(False))
    divided = match("DIVIDED", asks & (s[1]["kind"] == "ANSWER_TRANSITION"), mine["question"], mine["options"], revealed, F.concat_ws("\n", s[2]["said"]["explanation"], F.when(extra, s[3]["text"])), s[0], s[2], F.when(extra, 4).otherwise(3), None, mine)
    late = F.coalesce(some(s[3]["said"]["answer"]), named(s[3]), F.lit(""))
    hint = lambda x: F.when((F.trim(x["text"]) != "") & ~F.lower(F.trim(x["text"])).isin("answer", "answers", "the answer", "solution", "solutions"), F.concat(F.lit("Clue: "), F.trim(x["text"])))
    clued = match("CLUED", asks & (s[2]["kind"] == "ANSWER_TRANSITION"), mine["question"], mine["options"], late, F.concat_ws("\n", s[3]["said"]["explanation"], hint(s[1])), s[0], s[3], 4, None, mine)
    plain = match("PLAIN", asks & (s[1]["kind"] == "ANSWER"), mine["question"], mine["options"], F.coalesce(some(s[1]["said"]["answer"]), s[1]["noted"]["answer"]), s[1]["said"]["explanation"], s[0], s[1], 2, None, mine)
    middle = match("MIDDLE", asks & (s[2]["kind"] == "ANSWER"), mine["question"], mine["options"], F.coalesce(some(s[2]["said"]["answer"]), F.lit("")), F.concat_ws("\n", s[2]["said"]["explanation"], hint(s[1])), s[0], s[2], 3, None, mine)
    own = F.coalesce(some(F.when(~F.lower(F.trim("speaker_notes")).rlike("^https?://"), s[0]["noted"]["answer"])), F.when(s[0]["text"].rlike(parsing.ANSWER_LINE), s[0]["said"]["answer"]), F.lit(""))
    alone = match("ALONE", asks, mine["question"], mine["options"], own, F.lit(""), s[0], s[0], 1, None, mine)
    found = F.when(~F.col("__header"), F.coalesce(stepped, arrange, connect, announced, divided, clued, plain, middle, alone))
    decks = rows.select("document_id", F.struct("slide_number", found.alias("m")).alias("x")).groupBy("document_id").agg(F.sort_array(F.collect_list("x")).alias("deck"))

    def walk(state: Column, i: Column) -> Column:
        m = F.get("deck", i)["m"]
        free = i >= state["next"]
        return F.struct(
            F.when(free, i + F.coalesce(m["step"], F.lit(1))).otherwise(state["next"]).alias("next"), F.when(free & m.isNotNull(), F.array_append(state["picks"], i)).otherwise(state["picks"]).alias("picks")
        )

    begin = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("picks"))
    picks = F.aggregate(F.sequence(F.lit(0), F.size("deck") - 1), begin, walk, lambda state: state["picks"])
    taken = decks.select("document_id", F.explode(F.transform(picks, lambda i: F.get("deck", i)["m"])).alias("m"))
    return taken.select("document_id", "m.*").drop("step")


def consolidated(questions: DataFrame, deck: str, text: Column, order: str, answer: str, media: str) -> DataFrame:
    """One row per deck and first ten words: first row, best (longest, then first) answer, union of media."""
    words = F.array_join(F.slice(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), 1, 10), " ")
    a = F.coalesce(F.col(answer), F.lit(""))
    return questions.withColumn("key10", words).groupBy(deck, "key10").agg(
        F.min(order).alias("first_at"), F.max_by(a, F.struct(F.length(a), -F.col(order))).alias("best_answer"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(media)))).alias("media"), F.count("*").alias("n")
    )
