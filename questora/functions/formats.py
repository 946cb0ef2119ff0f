"""Formats of a question: by structure, wording and round; what its clues and answers are made of; whom it is for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import first_of
from .parsing import OPTION, lines
from .text import any_match, stepped_clues

# Wordings of the formats, in questions (Q), answers (A) and names of rounds (R).
STEPPED_QA = [r"(?i)clue\s*[#]?\s*[123]", r"\+\s*20\s*/\s*-\s*15", r"\+\s*15\s*/\s*-\s*10", r"\+\s*10\s*/\s*-\s*5", r"(?i)\b(decreasing\s+value|progressive\s+clue|buzzer\s+round)\b", r"(?i)\b(portfolio\s+builder)\b"]
STEPPED_PART = r"(?i)(?:^|\n)\s*(?:clue|step|hint)\s*\d"
CONNECT_A = [r"(?i)\b(common\s+(link|thread|connection|factor))\b", r"(?i)\b(connects?\s+(them|these|all))\b", r"(?i)\b(they\s+are\s+all)\b", r"(?i)\b(the\s+link\s+is)\b", r"(?i)\b(what\s+(connects|links))\b"]
CONNECT_Q = [r"(?i)\b(connect|common\s+link|what\s+links|what\s+connects)\b", r"(?i)\b(what\s+do\s+.{3,60}\s+have\s+in\s+common)\b", r"(?i)connect\s*[-–]?\s*4"]
ARRANGE_Q = [r"(?i)\b(arrange|rearrange)\b", r"(?i)\b(chronological\s+order)\b", r"(?i)\b(correct\s+(order|sequence))\b", r"(?i)\b(oldest\s+to\s+newest|earliest\s+to\s+latest)\b", r"(?i)\b(ticker\s+tangle)\b", r"(?i)\b(lowest\s+to\s+highest|highest\s+to\s+lowest)\b"]
ARRANGE_A = [r"(?i)[A-D]\s*[→➔➜>]\s*[A-D]\s*[→➔➜>]\s*[A-D]", r"(?i)\b(correct\s+order|the\s+sequence)\b"]
STEPPED_R, CONNECT_R, ARRANGE_R = r"(?i)\b(portfolio\s+builder|stepped|decreasing|buzzer\s+clue)\b", r"(?i)\b(connect|common\s*link|market\s*indicators)\b", r"(?i)\b(ticker\s+tangle|arrange|chronolog|sequence)\b"
# Words of the audiences.
COLLEGE = (
    r"(?i)\b(college|university|universities|institute|institution|iit|iim|nit|iiit|bits|iisc|campus|b-?school|engineering|management|polytechnic|academy|mba|btech|bba|pes|vit|srm"
    r"|manipal|christ|symbiosis)\b"
)
SCHOOL = r"(?i)\b(school|schools|junior|senior\s+secondary|high\s+school|k-?12)\b"
CORPORATE = r"(?i)\b(corporate|company|companies|employees?|office|workplace|enterprise|offsite)\b"
#: Answers that only point to a medium.
POINTER = r"(?i)^(see\s+)?(the\s+)?(image|picture|video|audio|clip)\.?$"


def question_format(question: Column, answer: Column, images: Column, round_name: Column) -> Column:
    """STEPPED_CLUE, CONNECT_4, ARRANGE_ORDER or STANDARD_QA: structure and wording decide before the round's name."""
    q, a, r = (F.coalesce(c, F.lit("")) for c in (question, answer, round_name))
    n = F.coalesce(F.size(images), F.lit(0))
    pictures = n.between(3, 5) & (F.length(F.trim(a)) < 80) & ((F.length(F.trim(q)) < 100) | (n >= 4))
    return first_of(
        [
            (any_match(q, STEPPED_QA) | any_match(a, STEPPED_QA) | (F.regexp_count(q, F.lit(STEPPED_PART)) >= 2), F.lit("STEPPED_CLUE")),
            (pictures | any_match(a, CONNECT_A) | any_match(q, CONNECT_Q), F.lit("CONNECT_4")),
            (any_match(q, ARRANGE_Q) | any_match(a, ARRANGE_A), F.lit("ARRANGE_ORDER")),
            (r.rlike(STEPPED_R), F.lit("STEPPED_CLUE")), (r.rlike(CONNECT_R), F.lit("CONNECT_4")), (r.rlike(ARRANGE_R), F.lit("ARRANGE_ORDER")),
        ],
        F.lit("STANDARD_QA"),
    )


def connect_data(format_name: Column, images: Column, answer: Column) -> Column:
    """The elements of a CONNECT_4 question, from its first four pictures; null for others."""
    element = lambda url, i: F.struct(F.format_string("Clue %d", i + 1).alias("label"), url.alias("image_url"), F.lit("").alias("explanation"))
    made = F.struct(
        F.lit("CONNECT_4").alias("type"), F.lit("What connects these elements?").alias("prompt"),
        F.transform(F.slice(images, 1, 4), element).alias("elements"), F.coalesce(answer, F.lit("")).alias("common_link"),
    )
    return F.when((format_name == "CONNECT_4") & (F.size(images) >= 3), made)


def kept_format(old: Column, new: Column) -> Column:
    """The format after a new pass: an earlier special format outlives a plain result."""
    return F.when((new == "STANDARD_QA") & old.isin("ARRANGE_ORDER", "STEPPED_CLUE"), old).otherwise(new)


def _some(c: Column) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def answer_type(answer: Column, images: Column, audio: Column, videos: Column) -> Column:
    """TEXT, or the medium of the answer, with TEXT_ before it where the answer also says something."""
    plain = F.trim(F.coalesce(answer, F.lit("")))
    prefix = F.when((plain != "") & ~plain.rlike(POINTER), "TEXT_").otherwise("")
    return first_of([(_some(c), F.concat(prefix, F.lit(name))) for c, name in ((videos, "VIDEO"), (images, "IMAGE"), (audio, "AUDIO"))], F.lit("TEXT"))


def clue_media(images: Column, audio: Column, videos: Column) -> Column:
    return first_of([(_some(c), F.lit(name)) for c, name in ((videos, "VIDEO"), (audio, "AUDIO"), (images, "IMAGE"))], F.lit("NONE"))


def audience(*texts: Column) -> Column:
    """School or Corporate where no word of colleges is there, College where one is; null without any."""
    blob = F.concat_ws(" ", *texts)
    college = blob.rlike(COLLEGE)
    return F.when(blob.rlike(SCHOOL) & ~college, "School").when(blob.rlike(CORPORATE) & ~college, "Corporate").when(college, "College")


def payload(format_: Column, question: Column, answer: Column, images: Column) -> Column:
    """The parts of a question as JSON, by its format: its clues, its pictures or the items to arrange; else the answer alone."""
    items = F.filter(lines(question), lambda x: x.rlike(OPTION))
    clues = F.when(format_ == "STEPPED_CLUE", stepped_clues(question)).when(format_ == "CONNECT_4", images)
    return F.to_json(F.struct(format_.alias("type"), answer.alias("answer"), clues.alias("clues"), F.when((format_ == "ARRANGE_ORDER") & (F.size(items) > 0), items).alias("items")))


def merged_json(old: Column, new: Column) -> Column:
    """Two JSON objects in one: new values win, of whatever kind and depth, and nulls change nothing; what is no object counts as empty."""
    empty = F.from_json(F.lit("{}"), "map<string,variant>")
    read = lambda c: F.map_filter(F.coalesce(F.from_json(c, "map<string,variant>"), empty), lambda k, v: v.isNotNull() & ~F.is_variant_null(v))
    a, b = read(old), read(new)
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b))


# Wordings of the special formats, rounds that stand for a format, badges, and points of the clues.
STEPPED_WORDS = r"(?i)clue\s*1\s*:\s*\+?20\s*/\s*-?15|clue\s*2\s*:\s*\+?15\s*/\s*-?10|clue\s*3\s*:\s*\+?10\s*/\s*-?5|portfolio\s*builder|3\s*parts/clues?\s*to\s*each\s*question"
ARRANGE_WORDS = (
    r"(?i)\barrange\b|ticker\s*tangle|chronological(?:\s*order)?|lowest\s+to\s+highest|highest\s+to\s+lowest|earliest\s+to\s+latest|from\s+1st\s+to\s+last|correct\s+order|in\s+(?:the\s+)?order\s+of"
)
CONNECT_WORDS = r"(?i)\bmarket\s*indicators\b|\bconnect(?:ion|ions|s)?\b|what\s+connects|common\s*(?:theme|link|thread)|find\s+the\s+link|4\s*pics\s*1\s*word|four\s*images|connect\s*4"
ROUNDS = {
    "STEPPED_CLUE": ["STEPPED_CLUE", "THREE_CLUE", "PORTFOLIO_BUILDER"], "ARRANGE_ORDER": ["ARRANGE_ORDER", "TICKER_TANGLE"], "CONNECT_4": ["CONNECT_4", "CONNECT", "MARKET_INDICATORS"],
    "BUZZER": ["BUZZER", "CLOSING_BELL", "RAPID_FIRE"], "POTPOURRI": ["POTPOURRI"], "IMAGE_REVEAL": ["IMAGE_REVEAL"], "LIST_IT": ["LIST_IT"],
}
BADGES = {
    "STEPPED_CLUE": "Portfolio Builder • Stepped Clues", "ARRANGE_ORDER": "Ticker Tangle • Arrange Order", "CONNECT_4": "Connect 4 • Common Link", "BUZZER": "Buzzer / Rapid Fire",
    "POTPOURRI": "Potpourri", "IMAGE_REVEAL": "Image Reveal", "LIST_IT": "List It",
}
POINTS = [(20, 15, "Hard Clue"), (15, 10, "Medium Clue"), (10, 5, "Giveaway Clue")]
NO_CLUES = [None, "Additional context clue", "Direct giveaway clue"]
CLUE_RULES = "All on buzzer • 1 attempt per clue • Clue 1: +20/-15, Clue 2: +15/-10, Clue 3: +10/-5"
CONNECT_PROMPT = "What common thread or concept connects all four clues and images?"


def structured(question: Column, answer: Column, options: Column, images: Column, audio: Column, videos: Column, context: Column, round_code: Column) -> Column:
    """(format, payload): one of eleven formats, and its parts as JSON with nulls for what is not there.

    Wording comes before the round, the round before the media. Null texts and lists are empty. A stepped clue has its three clues where the text
    marks them, an arrangement its first four options, pictures or lines.
    """
    none = F.array().cast("array<string>")
    given = F.struct(
        *[F.coalesce(c, F.lit("")).alias(n) for n, c in (("q", question), ("x", context), ("r", round_code))], answer.alias("a"), *[F.coalesce(c, none).alias(n) for n, c in (("o", options), ("i", images), ("s", audio), ("v", videos))],
        stepped_clues(F.coalesce(question, F.lit(""))).alias("c"),
    )
    write = lambda **parts: F.to_json(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in parts.items()]), {"ignoreNullFields": "false"})

    def made(g: Column) -> Column:
        both = F.trim(F.concat_ws(" ", g["q"], g["x"], g["r"]))
        low, image = F.lower(g["q"]), lambda n: F.get(g["i"], n)
        said = F.size(F.coalesce(g["c"], none)) == 3
        clues = []
        for n, (plus, minus, hard) in enumerate(POINTS):
            full = F.struct(
                F.lit(n + 1).alias("step"), F.lit(f"+{plus}/-{minus}").alias("points"), F.when(said, plus).alias("points_correct"), F.when(said, minus).alias("points_wrong"), F.when(said, f"+{plus} / -{minus}").alias("points_label"),
                F.when(said, hard).alias("difficulty_label"), F.when(said, F.get(g["c"], F.lit(n))).otherwise(g["q"] if n == 0 else F.lit(NO_CLUES[n])).alias("text"), image(n).alias("image"), image(n).alias("image_url"),
            )
            clues.append(full)
        rows = F.transform(F.filter(F.split(g["q"], "\n"), lambda x: F.trim(x) != ""), lambda x: F.regexp_replace(x, r"^[ 1234.ABCD)\-]+|[ 1234.ABCD)\-]+$", ""))
        by = F.when(F.size(g["o"]) >= 4, "o").when(F.size(g["i"]) >= 4, "i").when(F.size(rows) >= 4, "l").otherwise("e")
        items = F.array(*[
            F.struct(F.lit(k).alias("key"), F.when(by == "o", F.get(g["o"], F.lit(n))).when(by == "i", f"Item {k}").when(by == "l", F.get(rows, F.lit(n))).otherwise(f"Element {k}").alias("text"), image(n).alias("image"))
            for n, k in enumerate("ABCD")
        ])
        elements = F.array(*[
            F.struct(F.lit(n + 1).alias("index"), F.lit(f"Clue {n + 1}").alias("label"), F.lit(f"Clue {n + 1}").alias("text"), image(n).alias("image"), image(n).alias("image_url"), F.lit("").alias("explanation")) for n in range(4)
        ])
        scoring = F.struct(F.lit("+20").alias("all_correct"), F.lit("+10").alias("two_correct"), F.lit("+5").alias("one_correct"))
        payloads = {
            "STEPPED_CLUE": write(type="STEPPED_CLUE", badge=BADGES["STEPPED_CLUE"], clues=F.array(*clues), rules=CLUE_RULES, answer=g["a"]),
            "ARRANGE_ORDER": write(type="ARRANGE_ORDER", badge=BADGES["ARRANGE_ORDER"], instruction=g["q"], items=items, scoring=scoring, time_limit_seconds=60),
            "CONNECT_4": write(type="CONNECT_4", badge=BADGES["CONNECT_4"], prompt=F.when(g["q"] != "", g["q"]).otherwise(CONNECT_PROMPT), elements=elements, common_link=g["a"], connection_reveal=g["a"]),
            **{f: write(type=f, badge=BADGES[f]) for f in ("BUZZER", "POTPOURRI", "IMAGE_REVEAL", "LIST_IT")},
            "VIDEO_CLUE": write(type="VIDEO_CLUE", video_url=F.get(g["v"], F.lit(0))), "AUDIO_CLUE": write(type="AUDIO_CLUE", audio_url=F.get(g["s"], F.lit(0))),
            "VISUAL_CLUE": write(type="VISUAL_CLUE", image_url=F.get(g["i"], F.lit(0))), "QA": write(type="QA"),
        }
        named = lambda f: g["r"].isin(ROUNDS[f])
        tests = {
            "STEPPED_CLUE": both.rlike(STEPPED_WORDS) | named("STEPPED_CLUE") | ((g["r"] == "BUZZER") & (F.contains(low, F.lit("clue")) | F.contains(F.lower(both), F.lit("clue 1")))),
            "ARRANGE_ORDER": both.rlike(ARRANGE_WORDS) | named("ARRANGE_ORDER"), "CONNECT_4": both.rlike(CONNECT_WORDS) | named("CONNECT_4") | ((F.size(g["i"]) >= 4) & (F.size(g["o"]) == 0)),
            **{f: named(f) for f in ("BUZZER", "POTPOURRI", "IMAGE_REVEAL", "LIST_IT")}, "VIDEO_CLUE": F.size(g["v"]) > 0, "AUDIO_CLUE": F.size(g["s"]) > 0, "VISUAL_CLUE": F.size(g["i"]) > 0,
        }
        pick = lambda f: F.struct(F.lit(f).alias("format"), payloads[f].alias("payload"))
        return first_of([(cond, pick(f)) for f, cond in tests.items()], pick("QA"))

    return F.transform(F.array(given), made)[0]
