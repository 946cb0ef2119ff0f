"""Text functions: Column in, Column out."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a search.
STOP_WORDS = [
    "the", "a", "an", "of", "to", "in", "on", "for", "and", "or", "is", "are", "was", "were", "be", "been", "being", "by", "with", "as", "at", "from",
    "this", "that", "it", "its", "their", "his", "her", "they", "them", "he", "she", "we", "you", "i", "which", "what", "who", "whom", "whose",
    "when", "where", "why", "how", "name", "named", "called", "known", "used", "also", "only", "not", "no", "than", "into", "over", "under", "after",
    "before", "during", "about", "more", "most", "new", "first", "world", "which", "these", "those", "there", "here", "had", "has", "have", "has",
    "does", "did", "do", "your", "my", "our",
]

# Numbers as words in a request.
WORD_NUMBERS = {
    "zero": 0, "a couple of": 2, "a couple": 2, "couple": 2, "a few": 3, "few": 3, "one": 1, "two": 2, "three": 3, "four": 4,
    "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13,
    "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20,
    "twenty-five": 25, "thirty": 30, "forty": 40, "fifty": 50,
}

# Styles of a question, tried in this order.
STYLE_PATTERNS = [
    ("FILL_BLANK", r"(?i)_{3,}|\bblanked?\b|fill in the blank"),
    ("ODD_ONE_OUT", r"(?i)odd one out|does ?n.?t belong|which does not"),
    ("CONNECT", r"(?i)\bconnect\b|what links|have in common|common (?:link|thread|factor)|identify the connect"),
    ("MCQ", r"(?i)(?:^|\n)\s*[a-d][.)]\s|\bwhich of the following\b|\boptions?\b"),
]
VISUAL_PATTERN = r"(?i)identify|whose logo|which (?:brand|company).{0,20}(?:logo|ad)|which logo|name the"
NUMERIC_QUESTION = r"(?i)\bhow (?:many|much)\b|\bwhat (?:percentage|number|value|year|price)\b|\bestimate\b"
NUMERIC_ANSWER = r"^[\s\d,.%₹$+\-]+$"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once a row however often it is named; also inside of lambdas, where no optimiser shares anything."""
    return F.transform(F.array(value), use)[0]


def canonical(c: Column) -> Column:
    """Lower case, punctuation as spaces, runs of space as one; letters and digits of any script stay."""
    flat = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(flat, r"\s+", " "))


def content_hash(question: Column, answer: Column) -> Column:
    return F.sha2(F.concat(canonical(question), F.lit("|||"), canonical(answer)), 256)


def tokens(c: Column) -> Column:
    """ASCII words of two characters or more that are no stop words, repeats included."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS))


def fingerprint(c: Column, n: int = 14) -> Column:
    """The distinct tokens among the first ``n``."""
    return F.array_distinct(F.slice(tokens(c), 1, n))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def any_match(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda x, y: x | y, [c.rlike(p) for p in patterns])


def question_style(text: Column, answer: Column, image_dependent: Column | None = None) -> Column:
    text, answer = F.coalesce(text, F.lit("")), F.coalesce(answer, F.lit(""))
    out = F.when((F.lit(False) if image_dependent is None else image_dependent) & text.rlike(VISUAL_PATTERN), "VISUAL_ID")
    for name, pattern in STYLE_PATTERNS:
        out = out.when(text.rlike(pattern), name)
    return out.when(text.rlike(NUMERIC_QUESTION) | F.trim(answer).rlike(NUMERIC_ANSWER), "NUMERIC").otherwise("STANDARD")


def answer_entity(answer: Column) -> Column:
    """The first part of an answer, lower case, without honorifics and spelling variants of names."""
    head = F.element_at(F.split(F.lower(F.coalesce(answer, F.lit(""))), r"\s*(?:[/|;(]|\bor\b|,| - )\s*"), 1)
    plain = F.regexp_replace(head, r"\b(?:mr|mrs|ms|dr|sir|shri|smt|prof|the)\b\.?", " ")
    return F.trim(F.regexp_replace(F.replace(F.replace(F.regexp_replace(plain, "[^a-z0-9]+", " "), F.lit("oo"), F.lit("u")), F.lit("ee"), F.lit("i")), r"\s+", " "))


def clean_keywords(words: Column, most: int = 12) -> Column:
    """Without '#', trimmed, distinct whatever the case (first spelling stays), at most ``most``."""
    plain = F.filter(F.transform(words, lambda w: F.trim(F.regexp_replace(w, "^#+", ""))), lambda w: w != "")
    lower = F.transform(plain, F.lower)
    first = F.filter(F.transform(plain, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda s: F.array_position(lower, F.lower(s["w"])) == s["i"] + 1)
    return F.slice(F.transform(first, lambda s: s["w"]), 1, most)


def question_label(number: Column, round_number: Column, in_round: Column) -> Column:
    return F.when(round_number.isNotNull() & in_round.isNotNull(), F.format_string("Round %d Q%d", round_number, in_round)).when(number.isNotNull(), F.format_string("Q%d", number))


def strip_leading_number(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"^\s*(?:[Qq]\s*)?\d+\s*[.):\-]\s*", ""))


def strip_star(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[★☆⭐*]+|\(\s*(?i:star(?:red)?)\s*\)", ""))


def has_star(c: Column) -> Column:
    return c.rlike(r"[★☆⭐]|^\s*\*|\*\s*$|\(\s*(?i:star(?:red)?)\s*\)")


def redact_secrets(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?i)((?:api[_-]?key|key|token|secret|password)=)[^&\s]+", "$1***")
    return F.regexp_replace(c, r"(?i)(bearer\s+)[A-Za-z0-9._\-]+", "$1***")


def script_language(c: Column, default: str = "English", share: float = 0.3) -> Column:
    """A language by script: that of at least ``share`` of the letters, else the default."""
    # Scripts and their languages.
    scripts = [("Hindi", "IsDevanagari"), ("Kannada", "IsKannada"), ("Tamil", "IsTamil"), ("Telugu", "IsTelugu"), ("Malayalam", "IsMalayalam"), ("Bengali", "IsBengali"), ("Gujarati", "IsGujarati")]
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    out = None
    for name, cls in scripts:
        hit = (letters > 0) & (F.regexp_count(c, F.lit(rf"[\p{{{cls}}}&&\p{{L}}]")) >= letters * share)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


# Forms of a full date in a title, and which of their groups are the year, the month and the day.
DATES = [
    (r"(?<!\d)(20\d{2})[-_./](\d{1,2})[-_./](\d{1,2})(?!\d)", (1, 2, 3)), (r"(?<!\d)(\d{1,2})[-_./](\d{1,2})[-_./](20\d{2}|\d{2})(?!\d)", (3, 2, 1)), (r"(?<!\d)(20\d{2})(\d{2})(\d{2})(?!\d)", (1, 2, 3)),
    (r"(?<![\dA-Za-z])(\d{1,2})(?:st|nd|rd|th)?[\s\-]+([A-Za-z]{3,9})\.?,?[\s\-]*(20\d{2}|\d{2})(?!\d)", (3, 2, 1)), (r"(?<![A-Za-z])([A-Za-z]{3,9})\.?[\s\-]+(\d{1,2})(?:st|nd|rd|th)?,?[\s\-]+(20\d{2})(?!\d)", (3, 1, 2)),
]
MONTH_NAMES = "jan feb mar apr may jun jul aug sep oct nov dec"


def _month(m: Column) -> Column:
    """1 to 12 of a number or of a name's first three letters; null for other words."""
    at = F.instr(F.lit(f" {MONTH_NAMES} "), F.concat(F.lit(" "), F.lower(F.substring(m, 1, 3)), F.lit(" ")))
    return F.when(m.rlike(r"^\d+$"), m.try_cast("int")).when(at > 0, ((at + 3) / 4).cast("int"))


def title_date(c: Column) -> Column:
    """(date, year) of a title: the first full date, of 2000 to 2100, by the forms in their order; else the year of a month with a year, or a bare year. A day comes before its month."""
    def dates(text: Column, p: str, y: int, m: int, d: int) -> Column:
        def made(x: Column) -> Column:
            year = F.regexp_extract(x, p, y).try_cast("int")
            return F.to_date(F.try_make_timestamp(F.when(year < 100, year + 2000).otherwise(year), _month(F.regexp_extract(x, p, m)), F.regexp_extract(x, p, d).try_cast("int"), F.lit(0), F.lit(0), F.lit(0.0)))

        return F.filter(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), made), lambda x: x.isNotNull() & F.year(x).between(2000, 2100))

    def first(text: Column) -> Column:
        date = F.coalesce(*[F.get(dates(text, p, *groups), 0) for p, groups in DATES])
        named = r"(?i)(?<![A-Za-z])(?:%s)[A-Za-z]{0,6}\.?[\s\-]+(20\d{2})(?!\d)" % MONTH_NAMES.replace(" ", "|")
        bare = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit("")).try_cast("int")
        return F.struct(date.alias("date"), F.coalesce(F.year(date), bare(named), bare(r"(?<!\d)(20\d{2})(?!\d)")).alias("year"))

    return F.transform(F.array(F.coalesce(c, F.lit(""))), first)[0]


def extract_date(c: Column) -> Column:
    """The full date of a title, as ``title_date`` finds it."""
    return title_date(c)["date"]


def clean_year(c: Column, this_year: int) -> Column:
    y = c.try_cast("int")
    return F.when(y.between(1000, this_year + 2), y)


def soft_match(expected: Column, primary: Column, secondary: Column) -> Column:
    """Whether a label equals the primary one or any secondary one, whatever the case."""
    e = F.lower(F.trim(expected))
    return F.coalesce(e == F.lower(F.trim(primary)), F.lit(False)) | F.coalesce(F.exists(secondary, lambda s: F.lower(F.trim(s)) == e), F.lit(False))


def rewrite_urls(json_text: Column, old: str, new: str) -> tuple[Column, Column]:
    """(text with ``old`` replaced in values, number of replacements), for nested JSON kept as text.

    Only texts that are values change, however deep; keys and everything else stay as they were written. A slash of ``old`` may be
    escaped in the text; ``new`` is written as a JSON writer would. Null stays null.
    """
    old, new = old.rstrip("/"), new.rstrip("/")
    literal = "".join(r"\\?/" if c == "/" else re.escape(c) for c in old)
    # Behind the rest of the text it stands in there is no colon, so that text is no key.
    found = literal + r'(?=(?:[^"\\]|\\.)*+"\s*+(?!:|\s))'
    put = json.dumps(new)[1:-1].replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(json_text, found, put), F.regexp_count(json_text, F.lit(found)).cast("long")


def clean_title(raw: Column, topic: Column) -> Column:
    t = F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"(?i)^(?:please\s+)?(?:create|make|generate|build|give me)\s+(?:an?\s+)?(?:\d+\s+)?(?:questions?\s+)?(?:quiz\s+)?(?:on|about|for)?\s*", "")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.when(t == "", F.concat(F.initcap(F.coalesce(topic, F.lit("General"))), F.lit(" Quiz"))).otherwise(F.initcap(t))


def stepped_clues(c: Column) -> Column:
    """The three clues of a text marked 1st, 2nd and 3rd clue; null if they are not all there in order."""
    p = r"(?is)(?:1st clue|clue\s*1)\s*[:.\-]?\s*(.*?)\s*(?:2nd clue|clue\s*2)\s*[:.\-]?\s*(.*?)\s*(?:3rd clue|clue\s*3)\s*[:.\-]?\s*(.*)$"
    return F.when(c.rlike(p), F.array(*[F.trim(F.regexp_extract(c, p, i)) for i in (1, 2, 3)]))
