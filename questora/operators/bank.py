"""The question bank: assembled from its tables, gated, boosted, ordered and shown in detail."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import rules, text
from . import search
from .lineage import cut


# Audiences for which a question without a tag counts as harmless.
YOUNG = ["primary", "middle_school", "high_school", "general"]


def bank_rows(questions: DataFrame, tags: DataFrame, meta: DataFrame, documents: DataFrame) -> DataFrame:
    """The bank: questions with their tag, metadata and deck; the tag's values come before the question's own.

    ``tags`` and ``meta`` have one row per question_id, ``documents`` one per id. Left out are confirmed duplicates and
    rows of fewer than 8 characters without a picture. A sensitivity of NONE is assumed only for tagged rows and, where questions say whom they suit, for those of ``YOUNG``. Of the columns that
    not every bank has, those that are there come along: keywords (the tag's, else the question's tags), difficulty (Medium, 0.5 where unknown), city and region (the tag's, else the metadata's), primary_audience; without
    a shelf life a question whose ``temporal_nature`` passes is TIME_SENSITIVE, and any other EVERGREEN.
    """
    some = lambda df, c, kind="string": F.col(c) if c in df.columns else F.lit(None).cast(kind)
    usable = (F.length(F.trim(F.coalesce("question_text", F.lit("")))) >= 8) | F.coalesce(F.size("question_images") > 0, F.lit(False))
    q = questions.where(usable & ~F.coalesce(F.col("duplicate_status") == "CONFIRMED_DUPLICATE", F.lit(False)))
    t = tags.select(
        F.col("question_id").alias("id"), F.lit(True).alias("tagged"), *[F.col(c).alias(f"__{c}") for c in ("topic_l1", "subtopic_l2", "geography", "sensitivity", "shelf_life")],
        some(tags, "keywords", "array<string>").alias("__keywords"), some(tags, "city_name").alias("__city"), some(tags, "geo_region").alias("__region"),
    )
    m = meta.select(F.col("question_id").alias("id"), "year", "question_format", some(meta, "city_name").alias("__m_city"), some(meta, "geo_region").alias("__m_region"), some(meta, "primary_audience").alias("primary_audience"))
    d = documents.select(F.col("id").alias("document_id"), F.col("title").alias("deck"))
    joined = q.join(t, "id", "left").join(m, "id", "left").join(d, "document_id", "left")
    tagged = F.coalesce("tagged", F.lit(False))
    young = F.coalesce(F.arrays_overlap(some(questions, "audience_suitability", "array<string>"), F.array(*[F.lit(a) for a in YOUNG])), F.lit(False))
    passing = F.when(some(questions, "temporal_nature") == "TIME_SENSITIVE", "TIME_SENSITIVE").otherwise("EVERGREEN")
    life = F.coalesce("__shelf_life", passing) if "temporal_nature" in questions.columns else F.col("__shelf_life")
    return joined.select(
        "id", "question_text", "answer", "deck", "year", F.coalesce("question_format", F.lit("STANDARD_QA")).alias("question_format"), tagged.alias("tagged"),
        F.coalesce("__topic_l1", "topic").alias("topic_l1"), F.coalesce("__subtopic_l2", "subtopic").alias("subtopic_l2"), F.col("__geography").alias("geography"),
        F.coalesce("__sensitivity", F.when(tagged | young, "NONE")).alias("sensitivity"), life.alias("shelf_life"),
        F.coalesce(F.when(F.size("__keywords") > 0, F.col("__keywords")), some(questions, "tags", "array<string>"), F.array().cast("array<string>")).alias("keywords"),
        F.coalesce(some(questions, "difficulty"), F.lit("Medium")).alias("difficulty"), F.coalesce(some(questions, "difficulty_score", "double"), F.lit(0.5)).alias("difficulty_score"),
        F.coalesce("__city", "__m_city").alias("city_name"), F.coalesce("__region", "__m_region").alias("geo_region"), "primary_audience",
    )


def tag_filter(wanted: dict[str, str], needle: str | None, texts: list[Column]) -> Column:
    """Rows whose tag attributes equal the wanted values and one of whose texts holds the needle; an empty wish filters nothing."""
    tests = [F.coalesce(F.col(c) == v, F.lit(False)) for c, v in wanted.items() if v]
    if needle and needle.strip():
        tests.append(reduce(lambda a, b: a | b, [F.coalesce(c.ilike(f"%{needle.strip()}%"), F.lit(False)) for c in texts]))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def gates(filters: dict, style: Column | None = None) -> Column:
    """Whether a row passes a search's hard gates, which no score outweighs: pictures, geography, shelf life, safety, topic and style."""
    ok = F.lit(True)
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    if filters.get("exclude_image"):
        ok = ok & ~F.coalesce("image_dependent", F.lit(False))
    geo = filters.get("india_international")
    if geo:
        fits = none("india_international").isin(geo, "MIXED")
        if geo == "IN":
            fits = fits | rules.indian(F.concat_ws(" ", "question_text", "answer", "topic_l1", "subtopic_l2", "geo_region"))
        ok = ok & fits
    if filters.get("evergreen_only"):
        ok = ok & (none("shelf_life") != "TIME_SENSITIVE")
    if filters.get("school_safe"):
        ok = ok & ~none("sensitivity").isin("POLITICAL", "MATURE_REFERENCE")
    if filters.get("topic_l1"):
        ok = ok & (none("topic_l1") == filters["topic_l1"])
    if filters.get("question_style") and style is not None:
        ok = ok & style.isin(list(filters["question_style"]))
    return ok


def boosted(score: Column, bag: list[str], topic_tokens: Column, image_dependent: Column, exclude_image: bool = False) -> Column:
    """A score above zero plus 0.5 if a word of the bag names the topic, and 15 % more for a question that needs its picture."""
    named = F.arrays_overlap(topic_tokens, F.array(*[F.lit(w) for w in bag])) if bag else F.lit(False)
    s = score + F.when(F.coalesce(named, F.lit(False)), 0.5).otherwise(0.0)
    s = s if exclude_image else s * F.when(F.coalesce(image_dependent, F.lit(False)), 1.15).otherwise(1.0)
    return F.when(score > 0, s).otherwise(score)


def searched(rows: DataFrame, key: str, query: dict[str, float], filters: dict, limit: int) -> DataFrame:
    """(key, score) of the best rows for a weighted query bag: BM25 with the statistics of all rows, then gates and boosts; without words the broad order.

    ``rows`` have question_text, topic_l1, subtopic_l2, image_dependent, tagged and the columns that the filters name.
    """
    passed = rows.where(gates(filters))
    if not query:
        return broad_order(passed, key, F.col("tagged"), limit).select(key, "score")
    found = search.scores(rows, key, text.tokens(F.col("question_text")), query).withColumnRenamed("score", "__s")
    topic = text.tokens(F.concat_ws(" ", "topic_l1", "subtopic_l2"))
    score = boosted(F.col("__s"), list(query), topic, F.col("image_dependent"), bool(filters.get("exclude_image")))
    return passed.join(found, key).select(key, F.round(score, 3).alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(limit)


def broad_order(rows: DataFrame, key: str, tagged: Column, limit: int, seed: int = 7) -> DataFrame:
    """Rows for a request without words: 1, half more if tagged, and up to 0.3 drawn by a seeded hash of the key, best first."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed))), 1, 6), 16, 10).cast("double") / float(16**6)
    return rows.withColumn("score", F.round(1.0 + F.when(F.coalesce(tagged, F.lit(False)), 0.5).otherwise(0.0) + drawn * 0.3, 3)).orderBy(F.desc("score"), key).limit(limit)


def by_tag_overlap(rows: DataFrame, key: str, tags: Column, wanted: list[str], relevance: Column, limit: int) -> DataFrame:
    """Rows by the number of wanted tags they have, then by relevance; ``overlap`` is that number."""
    low = F.array_distinct(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(F.trim(t))))
    n = F.size(F.array_intersect(low, F.array(*[F.lit(w.strip().lower()) for w in wanted]).cast("array<string>")))
    return rows.withColumns({"overlap": n, "relevance": relevance}).orderBy(F.desc("overlap"), F.desc("relevance"), key).limit(limit)


def by_filters(rows: DataFrame, key: str, wanted: dict[str, str], tags: Column, wanted_tags: list[str], relevance: Column, limit: int) -> DataFrame:
    """A set compiled by filters alone: rows whose attributes match, those with more of the wanted tags first. If no row has all attributes, all rows count."""
    strict = tag_filter(wanted, None, [])
    known = rows.withColumn("__strict", strict)
    some = known.agg(F.max(F.col("__strict").cast("int")).alias("__some"))
    fits = known.join(F.broadcast(some)).where((F.col("__some") == 0) | F.col("__strict")).drop("__some", "__strict")
    return by_tag_overlap(fits, key, tags, wanted_tags, relevance, limit)


def with_format(questions: DataFrame, meta: DataFrame, key: str, wanted: str | None) -> DataFrame:
    """``questions`` of the wanted format; metadata is joined only where a format is asked for, and a question without any is STANDARD_QA."""
    if not wanted:
        return questions
    m = meta.select(key, F.col("question_format").alias("__f"))
    return questions.join(m, key, "left").where(F.coalesce("__f", F.lit("STANDARD_QA")) == wanted).drop("__f")


def api_view(rows: DataFrame) -> DataFrame:
    """Rows as a client sees them: texts never null, lists never null, a default difficulty and topic, and videos found among the raw media where none are listed."""
    filled = lambda c, d="": F.coalesce(F.col(c), F.lit(d)).alias(c)
    many = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    by_name = F.filter(many("raw_media_refs"), lambda p: F.lower(p).rlike(r"\.(mp4|mov|avi|webm|mkv|m4v|wmv)$"))
    return rows.select(
        "id", filled("question_text"), filled("answer"), filled("explanation"), filled("topic", "General Knowledge"), filled("difficulty", "Medium"), many("options").alias("options"), many("image_refs").alias("image_refs"),
        F.when(F.size(many("video_refs")) > 0, many("video_refs")).otherwise(by_name).alias("video_refs"),
    )


def exemplars(questions: DataFrame, tags: DataFrame, key: str, at: str, limit: int = 8) -> DataFrame:
    """The newest questions that a person tagged and confirmed, newest first."""
    mine = tags.where("source = 'HUMAN' AND status = 'confirmed'").select(key, at, "topic_l1", "subtopic_l2").orderBy(F.desc(at), key).limit(limit)
    return questions.join(F.broadcast(mine), key).orderBy(F.desc(at), key)


def custom_counts(paths: DataFrame) -> DataFrame:
    """(l1, l2, n) of custom paths."""
    return paths.where("is_custom").groupBy("l1", "l2").agg(F.count("*").alias("n"))


def top_subtopics(rows: DataFrame, subtopic: str, top: int = 3) -> DataFrame:
    """The subtopics with most rows, ties by name."""
    return rows.where(F.col(subtopic).isNotNull()).groupBy(subtopic).agg(F.count("*").alias("n")).orderBy(F.desc("n"), subtopic).limit(top)


def baseline(rows: DataFrame, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row: per field the percentage of rows whose rule equals the gold value; a null never does."""
    return rows.agg(F.count("*").alias("n"), *[F.round(100 * F.avg(F.coalesce(rule == gold, F.lit(False)).cast("int")), 4).alias(name) for name, (rule, gold) in pairs.items()])


def candidates(rows: DataFrame, key: str, status: str, similarity: str, limit: int, offset: int) -> DataFrame:
    """A page of possible duplicates, most similar first, unknown similarities last."""
    return rows.where(F.col(status) == "POSSIBLE_DUPLICATE").orderBy(F.col(similarity).desc_nulls_last(), key).offset(offset).limit(limit)


def detail(questions: DataFrame, meta: DataFrame, documents: DataFrame, many: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Questions with metadata and deck as structs, and each of ``many`` (rows with question_id, order) as one ordered array."""
    m = meta.select(F.col("question_id").alias("id"), F.struct(*[c for c in meta.columns if c != "question_id"]).alias("meta"))
    d = documents.select(F.col("id").alias("document_id"), F.struct(*[c for c in documents.columns if c != "id"]).alias("deck"))
    out = questions.join(m, "id", "left").join(d, "document_id", "left")
    for name, (side, order) in many.items():
        rest = [c for c in side.columns if c not in ("question_id", *order)]
        folded = side.groupBy(F.col("question_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias(name))
        out = out.join(folded, "id", "left")
    return out


def valid_image(name: Column, size: Column, width: Column, height: Column) -> Column:
    """No GIF, at least 2 KB, and at least 80 pixels either way as far as that is known."""
    wide = lambda c: F.coalesce(c, F.lit(80)) >= 80
    return ~F.lower(F.coalesce(name, F.lit(""))).endswith(".gif") & (size >= 2048) & wide(width) & wide(height)


def valid_images(images: DataFrame) -> DataFrame:
    """Pictures worth keeping, by ``valid_image``, that are no icon of a video player."""
    return images.where(valid_image(F.col("name"), F.col("bytes"), F.col("width"), F.col("height")) & ~F.coalesce("is_video_icon", F.lit(False)))


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit per letter of ``a``."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = open_ = (1 << len(a)) - 1
    for c in b:
        hit = open_ & at.get(c, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(a) - open_.bit_count()


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """0 to 100: twice the longest common subsequence over the summed lengths; 100 for two empty texts."""
    return pd.Series([200.0 * _common(x, y) / (len(x) + len(y)) if x or y else 100.0 for x, y in zip(a.fillna(""), b.fillna(""))])


def word_set(c: Column) -> Column:
    """The distinct words of a text in lower case, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != "")))


def token_set_ratio(a: Column, b: Column) -> Column:
    """0 to 100: the best likeness of two texts as sets of words - the shared words, and those with either text's own words."""
    wa, wb = word_set(a), word_set(b)
    both = F.array_sort(F.array_intersect(wa, wb))
    join = lambda *parts: F.trim(F.concat_ws(" ", *[F.array_join(p, " ") for p in parts]))
    shared, one, two = join(both), join(both, F.array_except(wa, wb)), join(both, F.array_except(wb, wa))
    # The shared words begin either longer text, so they are all that the two have in common.
    head = lambda x: 200.0 * F.length(shared) / (F.length(shared) + F.length(x))
    best = F.greatest(F.when(F.size(both) > 0, F.greatest(head(one), head(two))).otherwise(0.0), ratio(one, two))
    return F.when((F.size(wa) == 0) | (F.size(wb) == 0), 0.0).otherwise(best)


def may_be_alike(a: DataFrame, b: DataFrame, limit: float = 90.0) -> DataFrame:
    """(a, b): among the pairs of ``a(id, words)`` and ``b(id, words)`` all whose ``token_set_ratio`` is over ``limit``; others too, the more the shorter the words.

    A ratio can come from shared words that make up most of one text, or from words that are nearly the same. In the first case the two share one of the rarest words of
    that text, which hold the rest of its length. In the second, most pairs of neighbouring letters are left in both, and by the same argument they share one
    of the rarest of these; texts of such short words that this says nothing share one of the rarest letters. Rare means in few of all texts.
    """
    m = limit / 200
    tables = {"a": a.where(F.size("words") > 0), "b": b.where(F.size("words") > 0)}

    def ordered(made: Column) -> dict[str, DataFrame]:
        """(id, words, t, r, before): the tokens of each text, the rarest first, their place and the length of those before."""
        each = {k: df.select("id", "words", F.explode(made).alias("t")) for k, df in tables.items()}
        # The same token twice in a text is two tokens.
        each = {k: df.groupBy("id", "words", "t").agg(F.count("*").alias("n")).select("id", "words", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k"), "t") for k, df in each.items()}
        each = {k: df.select("id", "words", F.concat_ws("\x00", "t", "k").alias("t"), (F.length("t") + 1).alias("w")) for k, df in each.items()}
        df = each["a"].select("t").unionByName(each["b"].select("t")).groupBy("t").agg(F.count("*").alias("df"))
        w = Window.partitionBy("id").orderBy("df", "t")
        return {k: cut(x.join(df, "t").withColumns({"r": F.row_number().over(w), "before": F.sum("w").over(w) - F.col("w")}).drop("df")) for k, x in each.items()}

    length = F.length(F.array_join("words", " "))

    def met(x: DataFrame, y: DataFrame, near: bool = False) -> DataFrame:
        """Texts that share a token; ``near`` ones are of like length."""
        both = x.select(F.col("id").alias("a"), "t", length.alias("na")).join(y.select(F.col("id").alias("b"), "t", length.alias("nb")), "t")
        like = (F.col("na") * (1 - m) >= F.col("nb") * m) & (F.col("nb") * (1 - m) >= F.col("na") * m)
        return (both.where(like) if near else both).select("a", "b")

    whole = ordered(F.col("words"))
    firsts = {k: x.where(F.col("before") < (1 - m / (1 - m)) * (length + 1)) for k, x in whole.items()}
    grams = F.flatten(F.transform(F.filter("words", lambda x: F.length(x) > 1), lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2)))))
    pairs, n_words = ordered(grams), F.size("words")
    kept = F.floor((3 * m - 1) / (1 - m) * length - 2 * n_words + 1 + 1e-9) + 1  # pairs of neighbours that must be left
    heads = {k: x.where((kept >= 1) & (F.col("r") <= length - 2 * n_words + 1 - kept + 1)) for k, x in pairs.items()}
    out = met(firsts["a"], whole["b"]).unionByName(met(whole["a"], firsts["b"])).unionByName(met(heads["a"], heads["b"], near=True))
    short = {k: df.where(kept < 1) for k, df in tables.items()}
    if not (short["a"].isEmpty() and short["b"].isEmpty()):
        letters = ordered(F.split(F.array_join("words", ""), ""))
        left = F.ceil(m * length / (1 - m) - 1e-9) - (n_words - 1)  # letters that must be left
        few = {k: x.where((kept < 1) & (F.col("r") <= F.length(F.array_join("words", "")) - F.greatest(left, F.lit(1)) + 1)) for k, x in letters.items()}
        out = out.unionByName(met(few["a"], letters["b"], near=True)).unionByName(met(letters["a"], few["b"], near=True))
    return out.distinct()


def greedy_distinct(rows: DataFrame, gold: DataFrame, key: str, text: str, limit: float = 90.0) -> DataFrame:
    """``rows`` unlike all ``gold`` texts and unlike any row kept before them, in the order of ``key``.

    Only texts that ``may_be_alike`` are compared, and that leaves out none that is. The rows that stay come from rounds: a row
    with no undecided like row before it is kept, and rows like a kept one go. Texts without a word are like nothing.
    """
    def alike(a: DataFrame, b: DataFrame, cond: Column) -> DataFrame:
        sets = lambda df: cut(df.select(F.col(key).alias("id"), word_set(F.col(text)).alias("words")))
        one = sets(a)
        pairs = may_be_alike(one, one if b is a else sets(b), limit).where(cond)
        both = pairs.join(a.select(F.col(key).alias("a"), F.col(text).alias("__ta")), "a").join(b.select(F.col(key).alias("b"), F.col(text).alias("__tb")), "b")
        return both.where(token_set_ratio(F.col("__ta"), F.col("__tb")) > limit).select("a", "b")

    left = rows.join(alike(rows, gold, F.lit(True)).select(F.col("a").alias(key)).distinct(), key, "left_anti")
    links = cut(alike(left, left, F.col("a") > F.col("b")))  # a goes if b stays
    undecided, kept = cut(left.select(key)), None
    while not undecided.isEmpty():
        open_ = links.join(undecided.select(F.col(key).alias("b")), "b", "left_semi")
        now = cut(undecided.join(open_.select(F.col("a").alias(key)).distinct(), key, "left_anti"))
        gone = links.join(now.select(F.col(key).alias("b")), "b", "left_semi").select(F.col("a").alias(key)).distinct()
        undecided = cut(undecided.join(now, key, "left_anti").join(gone, key, "left_anti"))
        kept = now if kept is None else kept.unionByName(now)
    return rows.limit(0) if kept is None else rows.join(kept, key, "left_semi")
