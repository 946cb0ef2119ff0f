"""Parsers of slide texts: options, answers, themes, numbers and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Badges on slides that name a theme.
THEMES = [
    "CREATIVITY", "LEADERSHIP", "SUSTAINABILITY", "ENTREPRENEURSHIP", "TECHNOLOGY", "PROBLEM -SOLVING", "PROBLEM-SOLVING", "PROBLEM SOLVING", "INNOVATION", "FINANCE",
    "BUSINESS", "SCIENCE", "NATURE", "CULTURE", "HISTORY", "GEOGRAPHY", "SPORTS", "ENTERTAINMENT", "LITERATURE", "GENERAL KNOWLEDGE",
]
# Lines of a slide and what marks an answer.
OPTION = r"(?i)^(\([A-D1-4]\)|\[[A-D1-4]\]|[A-D1-4][.)])\s+"
NUMBER_BADGE = r"^\*?\s*(\d+)[.*)]*$"
ANSWER_LINE = r"(?i)(?:^|\n)\s*(?:Correct\s+Answer|Solution|Answer|Ans)\s*[:\-]\s*(.+?)(?:\n|$)"
# Formats by wording, the first that matches decides.
FORMATS = [
    ("STEPPED_CLUE", r"(?i)\b(?:portfolio\s*builder|stepped\s*clues?|(?:3|three)[\s\-]*clues?|3\s*parts/clues|\+20\s*/\s*-15)\b"),
    ("CONNECT_4", r"(?i)\b(?:market\s*indicators|connect\s*4|4\s*pics\s*1\s*word|four\s*images|common\s*(?:theme|link|thread)|what\s*connects|connect(?:ion|ions|s)?\b|\bfind\s+the\s+link\b)"),
    ("ARRANGE_ORDER", r"(?i)\b(?:ticker\s*tangle|arrange\b|\bin\s+(?:the\s+)?(?:right|correct)\s+order\b|\border\s+(?:the|them)\b|\bsequenc|chronolog|lowest\s+to\s+highest|earliest\s+to\s+latest)"),
    ("POTPOURRI", r"(?i)\bpotpourri\b"),
    ("IMAGE_REVEAL", r"(?i)\bimage\s*reveal\b|\breveal\s*round\b|\bpixelat"),
    ("LIST_IT", r"(?i)\blist[\s\-]*it\b"),
    ("BUZZER", r"(?i)\b(?:closing\s*bell|buzzer\s*round|rapid\s*fire|buzzers?!)\b"),
    ("QA", r"(?i)\b(?:opening\s*bell|direct\s*questions?|q\s*&\s*a\b|\bqa\b|\bquestion[\s\-]*answer\b)"),
]


def lines(text: Column) -> Column:
    """The trimmed lines of a text that are not blank."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")


def format_in(text: Column) -> Column:
    """The format that a text's wording names; null if none."""
    return F.coalesce(*[F.when(F.coalesce(text, F.lit("")).rlike(p), F.lit(name)) for name, p in FORMATS])


def _theme(line: Column) -> Column:
    """The theme that a line is the badge of, in title case; null if it is none. Spaces and hyphens are one."""
    names: dict[str, str] = {}
    for t in THEMES:
        names.setdefault(" ".join(t.replace("-", " ").split()), t.replace(" -", "-").title())
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.try_element_at(known, F.trim(F.regexp_replace(F.upper(line), r"[\s\-]+", " ")))


def question_parts(text: Column) -> Column:
    """(question, options, theme, number) of a question slide's text.

    Headings, number badges and theme badges are taken out of the question; options are lines marked as such, null
    if there are fewer than two. Lines after the first option that are no options belong to nothing.
    """
    all_lines = lines(text)
    body = F.filter(all_lines, lambda x: ~x.rlike(r"(?i)^QUESTION\s*\d*[:.\-]?$"))
    numbers = F.filter(body, lambda x: x.rlike(NUMBER_BADGE))
    plain = F.filter(body, lambda x: ~x.rlike(NUMBER_BADGE))
    themes = F.filter(F.transform(plain, _theme), lambda t: t.isNotNull())
    rest = F.filter(plain, lambda x: _theme(x).isNull())
    options = F.filter(rest, lambda x: x.rlike(OPTION))
    is_option = F.transform(rest, lambda x: x.rlike(OPTION))
    until = F.coalesce(F.array_position(is_option, True), F.lit(0))
    asked = F.when(until > 0, F.slice(rest, F.lit(1), (until - 1).cast("int"))).otherwise(rest)
    joined = F.when(F.size(asked) > 0, F.array_join(asked, " ")).otherwise(F.coalesce(F.get(all_lines, 0), text))
    stripped = F.regexp_replace(joined, r"(?i)^(?:QUESTION\s*\d*[:.\-]?|Q\d*[:.\-]?|\*?\d+[.*)]\s*)\s*", "")
    tail = r"(?i)\s+(?:\*?\d+[.*]*\s*)?(" + "|".join(THEMES) + r")\s*$"
    leaked = F.regexp_extract(stripped, tail, 1)
    bare = F.trim(F.regexp_replace(stripped, tail, ""))
    end = r"\s+\*?(\d+)[.*]+\s*$"
    number = F.coalesce(F.regexp_extract(F.element_at(F.when(F.size(numbers) > 0, numbers), -1), NUMBER_BADGE, 1).try_cast("int"), F.regexp_extract(bare, end, 1).try_cast("int"))
    theme = F.coalesce(F.element_at(F.when(F.size(themes) > 0, themes), -1), F.when(leaked != "", _theme(leaked)))
    return F.struct(F.trim(F.regexp_replace(bare, end, "")).alias("question"), F.when(F.size(options) >= 2, options).alias("options"), theme.alias("theme"), number.alias("number"))


def answer_parts(text: Column) -> Column:
    """(answer, explanation) of an answer slide's text: the marked line, else the first line that is no label."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)^ANSWER\s*\d*[:.\-]?\s*", ""))
    marked = t.rlike(ANSWER_LINE)
    after = F.trim(F.regexp_replace(F.trim(F.replace(t, F.regexp_extract(t, ANSWER_LINE, 0), F.lit(""))), r"(?i)^(?:Explanation\s*(?:&\s*Context)?|Context)\s*[:\-]?\s*", ""))
    ls = F.filter(lines(t), lambda x: ~x.rlike(r"(?i)^(?:Q\d*[:.\-]?|\d+[.*)]\s*|QUESTION\s*\d*[:.\-]?)$"))
    answer = F.when(marked, F.trim(F.regexp_extract(t, ANSWER_LINE, 1))).otherwise(F.coalesce(F.get(ls, 0), F.lit("")))
    rest = F.when(marked, after).otherwise(F.array_join(F.slice(ls, F.lit(2), F.greatest(F.size(ls) - 1, F.lit(0))), " "))
    return F.struct(answer.alias("answer"), rest.alias("explanation"))


def distinct_words(query: Column) -> Column:
    """A query without words said before, whatever the case and closing marks; first spellings stay, in order."""
    words = F.filter(F.split(F.trim(F.coalesce(query, F.lit(""))), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,;:!?]+|[.,;:!?]+$", "") != "")
    bare = F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"^[.,;:!?]+|[.,;:!?]+$", "")))
    return F.array_join(F.filter(words, lambda w, i: F.array_position(bare, F.get(bare, i)) == i + 1), " ")
