"""Names of deck files taken apart: date, year, language, stage, city, college, quiz name and audience."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .formats import audience
from .rules import CITIES_IN, CITIES_INTL
from .text import bound

# Words of stages, languages and cities, and other names of a city.
STAGES = {
    "prelim": "Prelims", "prelims": "Prelims", "preliminary": "Prelims", "preliminaries": "Prelims", "final": "Finals", "finals": "Finals",
    "semi": "Semi-finals", "semis": "Semi-finals", "semifinal": "Semi-finals", "semifinals": "Semi-finals",
    "quarterfinal": "Quarter-finals", "quarterfinals": "Quarter-finals", "wildcard": "Wildcard", "qualifier": "Qualifiers", "qualifiers": "Qualifiers",
}
LANGUAGES = {
    "english": "English", "hindi": "Hindi", "kannada": "Kannada", "tamil": "Tamil", "telugu": "Telugu", "malayalam": "Malayalam", "marathi": "Marathi",
    "bengali": "Bengali", "gujarati": "Gujarati", "punjabi": "Punjabi", "bilingual": "Bilingual",
}
MORE_CITIES = [
    "vellore", "manipal", "tiruchirappalli", "trichy", "madurai", "visakhapatnam", "vijayawada", "varanasi", "dehradun", "shimla", "amritsar", "ludhiana", "kanpur",
    "agra", "vadodara", "rajkot", "thane", "navi mumbai", "pilani", "kharagpur", "dharwad", "hubli", "belagavi", "belgaum", "udupi", "warangal", "tirupati", "thrissur",
    "kozhikode", "calicut", "jodhpur", "udaipur", "faridabad", "ghaziabad", "bhilai", "jamshedpur", "cuttack", "siliguri", "imphal", "shillong", "gangtok",
    "puducherry", "pondicherry", "trivandrum", "cochin", "vizag", "banaras", "bombay", "madras", "calcutta",
]
CITY_NAMES = {
    "bangalore": "Bengaluru", "mysore": "Mysuru", "gurgaon": "Gurugram", "bombay": "Mumbai", "madras": "Chennai", "calcutta": "Kolkata",
    "trivandrum": "Thiruvananthapuram", "vizag": "Visakhapatnam", "banaras": "Varanasi", "cochin": "Kochi",
}
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
# Dates in a name in order of precedence: (pattern, groups of year, month and day).
DATES = [
    (r"(?<!\d)(20\d{2})[-_./](\d{1,2})[-_./](\d{1,2})(?!\d)", (1, 2, 3)),
    (r"(?<!\d)(\d{1,2})[-_./](\d{1,2})[-_./](20\d{2}|\d{2})(?!\d)", (3, 2, 1)),
    (r"(?<!\d)(20\d{2})(\d{2})(\d{2})(?!\d)", (1, 2, 3)),
    (r"(?<![\dA-Za-z])(\d{1,2})(?:st|nd|rd|th)?[\s\-]+([A-Za-z]{3,9})\.?,?[\s\-]*(20\d{2}|\d{2})(?!\d)", (3, 2, 1)),
    (r"(?<![A-Za-z])([A-Za-z]{3,9})\.?[\s\-]+(\d{1,2})(?:st|nd|rd|th)?,?[\s\-]+(20\d{2})(?!\d)", (3, 1, 2)),
]
MONTH_YEAR = rf"(?i)(?<![A-Za-z])(?:{MONTHS})[a-z]{{0,6}}\.?[\s\-]+(20\d{{2}})(?!\d)"
NOISE = r"(?i)\b(?:w(?:ith)?\.?\s+answers?|answers?|copy(?:\s+of)?|final\s+version|v\d+)\b|\(\d+\)"
EDGE = r"^[\s\-–—|.]+|[\s\-–—|.]+$"


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _date(name: Column, pattern: str, at: tuple[int, int, int]) -> Column:
    """(day, text) of the first match that is a date from 2000 to 2100; null without one."""
    def dated(x: Column) -> Column:
        place = F.position(F.lower(F.substring(x["m"], 1, 3)), F.lit(MONTHS))
        month = F.coalesce(x["m"].try_cast("int"), F.when((place > 0) & (place % 4 == 1), ((place + 3) / 4).cast("int")))
        year = F.when(F.length(x["y"]) == 4, x["y"].try_cast("int")).otherwise(2000 + x["y"].try_cast("int"))
        day = F.to_date(F.try_make_timestamp(year, month, x["d"].try_cast("int"), F.lit(0), F.lit(0), F.lit(0.0)))
        return bound(day, lambda v: F.when(v.isNotNull() & F.year(v).between(2000, 2100), F.struct(v.alias("day"), x["text"].alias("text"))))

    return bound(F.struct(*[F.regexp_extract(name, pattern, i).alias(c) for c, i in zip(("y", "m", "d", "text"), (*at, 0))]), dated)


def deck_info(filename: Column, title: Column | None = None) -> Column:
    """(quiz_name, college, city, round_stage, deck_date, deck_year, language, primary_audience, is_varsity, parsed_ok) of a deck's
    file name, or of its title where there is none. Names run college, city, stage, quiz; parts that are not found are null."""
    title = F.lit(None).cast("string") if title is None else title
    base = F.regexp_replace(F.substring_index(F.coalesce(F.when(filename != "", filename), title, F.lit("")), "/", -1), r"(?i)\.(pptx|ppt|pdf)$", "")
    stem = F.trim(F.regexp_replace(F.regexp_replace(base, "_", " "), r"\s+", " "))
    varsity = F.concat_ws(" ", stem, title).rlike(r"(?i)(?<![A-Za-z])zvq(?![A-Za-z])|zerodha\s+varsity")
    plain = F.trim(F.regexp_replace(F.regexp_replace(stem, NOISE, " "), r"\s+", " "))

    def parts(name: Column) -> Column:
        """(name, date, year, tokens) once the date is out."""
        def without(x: Column) -> Column:
            place = F.position(x["gone"], name)
            rest = F.when(x["gone"].isNotNull(), F.concat(F.substring(name, F.lit(1), place - 1), F.lit(" "), F.substring(name, place + F.length(x["gone"]), F.length(name)))).otherwise(name)
            cleaned = F.regexp_replace(F.regexp_replace(rest, r"\s+[-–—|]+\s+", " "), r"[(),\[\]]", " ")
            tokens = F.filter(F.split(F.trim(cleaned), r"\s+"), lambda t: F.regexp_replace(t, r"[-–—|.]", "") != "")
            norm = lambda v: F.transform(v, lambda t: F.regexp_replace(F.lower(t), "[^a-z0-9]", ""))
            return bound(tokens, lambda v: F.struct(x["day"].alias("day"), x["year"].alias("year"), v.alias("tokens"), norm(v).alias("norm")))

        def dated(found: Column) -> Column:
            by_month, bare = F.regexp_extract(name, MONTH_YEAR, 0), F.regexp_extract(name, r"(?<!\d)(20\d{2})(?!\d)", 0)
            year = F.coalesce(F.year(found["day"]), F.regexp_extract(by_month, r"(20\d{2})", 1).try_cast("int"), bare.try_cast("int"))
            gone = F.coalesce(found["text"], F.when(by_month != "", by_month), F.when(bare != "", bare))
            return bound(F.struct(found["day"].alias("day"), year.alias("year"), gone.alias("gone")), without)

        return bound(F.coalesce(*[_date(name, p, at) for p, at in DATES]), dated)

    def places(p: Column) -> Column:
        """``p`` with the places of language, stage and city."""
        norm, n = p["norm"], F.size(p["norm"])
        index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        lang = F.array_max(F.filter(index, lambda i: F.get(norm, i).isin(list(LANGUAGES))))
        stage = F.array_min(F.filter(index, lambda i: F.get(norm, i).isin(list(STAGES))))
        cities = sorted({*CITIES_IN, *CITIES_INTL, *MORE_CITIES, *CITY_NAMES})

        def spans(width: int) -> Column:
            """Where a city of so many words stands, as (end, width, start)."""
            known = [c for c in cities if len(c.split()) == width]
            hit = F.filter(index, lambda i: F.concat_ws(" ", *[F.get(norm, i + k) for k in range(width)]).isin(known))
            return F.transform(hit, lambda i: F.struct((i + width).alias("end"), F.lit(width).alias("width"), i.alias("start")))

        every = F.concat(spans(2), spans(1))
        before = F.array_max(F.filter(every, lambda s: stage.isNull() | (s["end"] <= stage)))
        first = F.array_min(F.transform(every, lambda s: F.struct(s["start"].alias("start"), (-s["width"]).alias("less"), s["end"].alias("end"), s["width"].alias("width"))))
        city = F.coalesce(F.when(before.isNotNull(), F.struct(before["start"].alias("start"), before["end"].alias("end"))), F.when(first.isNotNull(), F.struct(first["start"].alias("start"), first["end"].alias("end"))))
        return F.struct(p["day"].alias("day"), p["year"].alias("year"), p["tokens"].alias("tokens"), norm.alias("norm"), lang.alias("lang"), stage.alias("stage"), city.alias("city"))

    def named(p: Column) -> Column:
        tokens, stage, city = p["tokens"], p["stage"], p["city"]
        trim = lambda c: F.regexp_replace(c, EDGE, "")
        some = lambda c: F.when(c != "", c)
        end = F.least(city["start"], stage)
        college = some(trim(F.array_join(F.slice(tokens, F.lit(1), F.greatest(F.coalesce(end, F.lit(0)), F.lit(0))), " ")))
        raw = F.array_join(F.slice(p["norm"], city["start"] + 1, city["end"] - city["start"]), " ")
        place = F.when(city.isNotNull(), F.coalesce(F.try_element_at(_map(CITY_NAMES), raw), F.initcap(raw)))
        others = F.filter(tokens, lambda t, i: ~F.coalesce(i == p["lang"], F.lit(False)))
        after = F.filter(tokens, lambda t, i: F.coalesce(i > stage, F.lit(False)) & ~F.coalesce(i == p["lang"], F.lit(False)))
        quiz = F.coalesce(some(trim(F.array_join(after, " "))), some(trim(F.array_join(others, " "))), some(plain))
        return F.struct(
            quiz.alias("quiz_name"), college.alias("college"), place.alias("city"), F.try_element_at(_map(STAGES), F.get(p["norm"], stage)).alias("round_stage"), p["day"].alias("deck_date"), p["year"].alias("deck_year"),
            F.try_element_at(_map(LANGUAGES), F.get(p["norm"], p["lang"])).alias("language"), audience(college, plain).alias("primary_audience"), varsity.alias("is_varsity"),
            (place.isNotNull() | college.isNotNull() | stage.isNotNull()).alias("parsed_ok"),
        )

    # Each step is worked out once: a step's result is the lambda's variable of the next.
    one = F.transform(F.array(plain), parts)
    return F.transform(F.transform(one, places), named)[0]
