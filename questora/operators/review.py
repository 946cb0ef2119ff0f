"""The next state of questions, tags, paths and quizzes after a person's or a job's decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vault import NO_TOPIC


def accepted(tags: DataFrame, questions: DataFrame, ids: DataFrame, key: str, at: str, order: str, now: Column, actor: str) -> DataFrame:
    """``tags`` after the questions in ``ids(key)`` were accepted from review.

    The newest tag of an accepted question is confirmed and mended: a missing or empty subtopic comes from the question
    or its topic, a weak fit turns good, a confidence below 0.7 turns 0.9; confirmed tags before it are superseded. A
    question without a tag gets a confirmed one of its own topic. Repeated ids count once.
    """
    one = ids.select(key).distinct()
    q = questions.select(key, F.col("topic").alias("__t"), F.col("subtopic").alias("__s"))
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc(order)))
    taken = tags.join(one, key, "left_semi").withColumn("__r", newest).join(q, key, "left")
    top = F.col("__r") == 1
    empty = F.col("subtopic_l2").isNull() | F.col("subtopic_l2").isin("", "General Knowledge", *NO_TOPIC)
    made = {
        "status": F.when(top, "confirmed").when(F.col("status") == "confirmed", "superseded").otherwise(F.col("status")),
        "verified_by": F.when(top, F.lit(actor)).otherwise(F.col("verified_by")),
        "verified_at": F.when(top, now).otherwise(F.col("verified_at")),
        "subtopic_l2": F.when(top & empty, F.coalesce("__s", "topic_l1", "__t", F.lit("General Knowledge"))).otherwise(F.col("subtopic_l2")),
        "fit": F.when(top & F.coalesce(F.col("fit").isin("weak", "none"), F.lit(True)), "good").otherwise(F.col("fit")),
        "confidence": F.when(top & (F.coalesce("confidence", F.lit(0.0)) < 0.7), 0.9).otherwise(F.col("confidence")),
    }
    mended = taken.select(*[made[c].alias(c) if c in made else F.col(c) for c in tags.columns])
    topic = F.coalesce("__t", F.lit("General Knowledge"))
    new = {
        key: F.col(key), "topic_l1": topic, "subtopic_l2": F.coalesce("__s", topic), "fit": F.lit("good"), "confidence": F.lit(0.9), "status": F.lit("confirmed"),
        "source": F.lit("HUMAN"), "verified_by": F.lit(actor), "verified_at": now, at: now,
    }
    bare = q.join(one, key, "left_semi").join(tags.select(key).distinct(), key, "left_anti")
    fresh = bare.select(*[new.get(c, F.lit(None)).cast(tags.schema[c].dataType).alias(c) for c in tags.columns])
    return tags.join(one, key, "left_anti").unionByName(mended).unionByName(fresh)


def decided(tags: DataFrame, actions: DataFrame, tag_id: str, question: str) -> DataFrame:
    """``tags`` after ``actions(tag_id, action)``: confirm supersedes the question's other confirmed tags, reject marks the tag rejected.

    One action counts per tag, confirm before reject.
    """
    a = actions.groupBy(tag_id).agg(F.min(F.lower(F.trim("action"))).alias("__a"))
    t = tags.join(a, tag_id, "left")
    won = t.where("__a = 'confirm'").groupBy(question).agg(F.max(tag_id).alias("__won"))
    both = t.join(won, question, "left")
    status = (
        F.when((F.col("__a") == "confirm") & (F.col(tag_id) == F.col("__won")), "confirmed").when(F.col("__a") == "reject", "rejected")
        .when(F.col("__won").isNotNull() & ((F.col("status") == "confirmed") | (F.col("__a") == "confirm")), "superseded").otherwise(F.col("status"))
    )
    return both.withColumn("status", status).select(*tags.columns)


def tag_to_meta(meta: DataFrame, tags: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """``meta`` with columns from a question's tag, {meta column: tag column}; a null or NA tag value and a field edited by hand change nothing."""
    t = tags.select(key, *[F.col(c).alias(f"__{m}") for m, c in columns.items()])
    out = meta.join(t, key, "left")

    def taken(m: str) -> Column:
        by_hand = F.coalesce(F.array_contains("manual_fields", m), F.lit(False))
        return F.when(by_hand | F.col(f"__{m}").isNull() | (F.col(f"__{m}").cast("string") == "NA"), F.col(m)).otherwise(F.col(f"__{m}")).alias(m)

    return out.select(*[taken(c) if c in columns else F.col(c) for c in meta.columns])


# Fields that may be edited, of numbers and of truths among them, and the values of some.
EDITABLE = [
    "question_number", "round_number", "question_in_round", "question_format", "star_marked", "answer_type", "quiz_name", "college_institution", "city_name", "round_stage", "deck_year", "language",
    "primary_audience", "secondary_audience", "is_varsity", "relevant_year", "geo_region", "india_international", "source_presentation",
]
NUMBERS, TRUTHS = ["question_number", "round_number", "question_in_round", "deck_year", "relevant_year"], ["star_marked", "is_varsity"]
ENUMS = {"answer_type": ["TEXT", "TEXT_IMAGE", "IMAGE", "TEXT_VIDEO", "VIDEO", "TEXT_AUDIO", "AUDIO"], "india_international": ["IN", "INTL", "NA"]}


def checked_edits(edits: DataFrame, formats: list[str]) -> DataFrame:
    """(..., value, problem): ``edits(field, raw)`` as they may be written; ``problem`` says why one may not.

    Blank is null, texts are trimmed, numbers are whole, truths are true or false, names of formats and answers are in capitals with underscores, and a language that is
    taken away is English. Edits of other fields go.
    """
    plain = F.nullif(F.trim("raw"), F.lit(""))
    code = F.replace(F.upper(plain), F.lit(" "), F.lit("_"))
    field = F.col("field")
    value = (
        F.when(field.isin(NUMBERS), plain.try_cast("int").cast("string")).when(field.isin(TRUTHS) & plain.isNotNull(), F.lower(plain).isin("1", "true", "yes", "y").cast("string"))
        .when(field.isin("question_format", "answer_type"), code).when(field == "india_international", F.upper(plain)).when(field == "language", F.coalesce(plain, F.lit("English"))).otherwise(plain)
    )
    known = {"question_format": formats, **ENUMS}
    wrong = [F.when((field == f) & value.isNotNull() & ~value.isin(v), F.concat(F.lit(f"unknown {f.replace('_', ' ')}: "), "raw")) for f, v in known.items()]
    number = F.when(field.isin(NUMBERS) & plain.isNotNull() & value.isNull(), F.concat(F.lit("no whole number: "), "raw"))
    return edits.where(field.isin(EDITABLE)).withColumns({"problem": F.coalesce(number, *wrong), "value": value}).withColumn("value", F.when(F.col("problem").isNull(), F.col("value")))


def normalised_paths(paths: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``paths`` with l1, l2 in the spelling of ``taxonomy(l1, l2)`` and ``is_custom``.

    A known subtopic gets its real theme. Any other theme or subtopic stays as it is and is custom; a path without
    either, or with an unknown subtopic and no theme, goes.
    """
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    l2s = taxonomy.groupBy(F.lower(F.trim("l2")).alias("__k2")).agg(F.min(F.struct("l2", "l1")).alias("__2"))
    l1s = taxonomy.groupBy(F.lower(F.trim("l1")).alias("__k1")).agg(F.min("l1").alias("__1"))
    p = paths.withColumns({"__k1": low(F.col("l1")), "__k2": low(F.col("l2"))}).join(l2s, "__k2", "left").join(l1s, "__k1", "left")
    known = F.col("__2").isNotNull()
    l1 = F.when(known, F.col("__2.l1")).otherwise(F.coalesce("__1", F.when(F.col("__k1") != "", F.trim("l1"))))
    l2 = F.when(known, F.col("__2.l2")).otherwise(F.when(F.col("__k2") != "", F.trim("l2")))
    custom = ~known & ((F.col("__k2") != "") | (F.col("__1").isNull() & (F.col("__k1") != "")))
    made = {"l1": l1, "l2": l2}
    return p.select(*[made[c].alias(c) if c in made else F.col(c) for c in paths.columns], custom.alias("is_custom")).where("l1 IS NOT NULL")


def with_first_path(paths: Column, l1: Column, l2: Column) -> Column:
    """An array of (l1, l2, keywords) led by the ruled path, which takes the first one's keywords; the others follow, each l2 once. A null l2 changes nothing."""
    words = F.coalesce(F.get(paths, 0)["keywords"], F.array().cast("array<string>"))
    lead = F.struct(l1.alias("l1"), l2.alias("l2"), words.alias("keywords"))
    low = F.transform(paths, lambda p: F.lower(F.coalesce(p["l2"], F.lit(""))))
    rest = F.filter(paths, lambda p, i: (F.get(low, i) != "") & (F.get(low, i) != F.lower(l2)) & (F.array_position(low, F.get(low, i)) == i + 1))
    return F.when(l2.isNotNull(), F.concat(F.array(lead), F.transform(rest, lambda p: F.struct(p["l1"].alias("l1"), p["l2"].alias("l2"), p["keywords"].alias("keywords"))))).otherwise(paths)


def path_changes(old: DataFrame, new: DataFrame, key: str, source: str, actor: str | None) -> DataFrame:
    """(key, field, old_value, new_value, kind, actor): one row per question of ``new`` whose paths (key, position, l1, l2) differ from ``old``.

    A question that had none makes history only if a person gave it some.
    """
    def flat(df: DataFrame, name: str) -> DataFrame:
        label = F.concat_ws(" > ", "l1", "l2")
        return df.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", label.alias("p")))), lambda s: s["p"]), "; ").alias(name))

    both = flat(new, "new_value").join(flat(old, "old_value"), key, "left")
    kind = "EDIT" if source == "HUMAN" else "RETAG"
    changed = both.where(~F.col("new_value").eqNullSafe(F.col("old_value")) & (F.lit(source == "HUMAN") | F.col("old_value").isNotNull()))
    return changed.select(key, F.lit("topic_paths").alias("field"), "old_value", "new_value", F.lit(kind).alias("kind"), F.lit(actor or ("system" if source != "HUMAN" else None)).cast("string").alias("actor"))


def patched_questions(rows: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """``rows`` after patches (key, and columns of the same names): a null changes nothing, texts are trimmed.

    Tags lose a leading '#', tags and topics blanks and repeats whatever the case; the first topic becomes the question's where none is given. Blank visual clues go. Keys are patched once.
    """
    has = [c for c in patches.columns if c != key]
    p = patches.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in has])

    def once(c: Column) -> Column:
        plain = F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")
        low = F.transform(plain, lambda x: F.lower(x))
        return F.filter(plain, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)

    lists = {c: once(F.transform(F.col(f"__{c}"), lambda x: F.regexp_replace(F.trim(x), "^#", "")) if c == "tags" else F.col(f"__{c}")) for c in ("tags", "topics") if c in has}

    def value(c: str) -> Column:
        if c not in has and not (c == "topic" and "topics" in has):
            return F.col(c)
        if c in lists:
            return F.when(F.col(f"__{c}").isNotNull(), lists[c]).otherwise(F.col(c)).alias(c)
        said = F.trim(F.col(f"__{c}")) if c in has else F.lit(None).cast("string")
        if c == "topic" and "topics" in has:
            said = F.coalesce(said, F.get(lists["topics"], F.lit(0)))
        if c == "visual_clues":
            return F.when(F.col(f"__{c}").isNotNull(), F.nullif(said, F.lit(""))).otherwise(F.col(c)).alias(c)
        return F.coalesce(said, F.col(c)).alias(c)

    return rows.join(p, F.col(key) == F.col("__k"), "left").select(*[value(c) for c in rows.columns])


def patched_tags(tags: Column, add: list[str], remove: list[str]) -> Column:
    """Tags without those removed, then those added that are not there yet, whatever the case."""
    gone = [t.strip().lower() for t in remove]
    kept = F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: ~F.lower(F.trim(t)).isin(gone)) if gone else F.coalesce(tags, F.array().cast("array<string>"))
    low = F.transform(kept, lambda t: F.lower(F.trim(t)))
    fresh = list({t.strip().lower(): t.strip() for t in reversed(add) if t.strip()}.values())[::-1]
    return F.concat(kept, F.filter(F.array(*[F.lit(t) for t in fresh]).cast("array<string>"), lambda t: ~F.array_contains(low, F.lower(t))))


def deleted(tables: dict[str, DataFrame], questions: str, document: str, ids: list | None, everything: bool = False) -> dict[str, DataFrame]:
    """All tables after the questions of the documents in ``ids`` went with the rows that point to them by question_id.

    Neither a list of documents nor the word ``everything`` is an error, so nothing goes by mistake.
    """
    if not ids and not everything:
        raise ValueError("name the documents, or say that everything goes")
    q = tables[questions]
    gone = q if everything else q.where(F.col(document).isin(ids))
    keys = gone.select(F.col("id").alias("question_id"))
    left = {questions: q.join(gone.select("id"), "id", "left_anti").select(*q.columns)}
    return left | {n: df.join(keys, "question_id", "left_anti").select(*df.columns) for n, df in tables.items() if n != questions}


def missing_tags(questions: DataFrame, tags: DataFrame, key: str, l1: Column, l2: Column) -> DataFrame:
    """A confirmed rule tag (key, topic_l1, subtopic_l2, status, confidence, source) of each question without any tag."""
    bare = questions.join(tags.select(key).distinct(), key, "left_anti")
    return bare.select(key, l1.alias("topic_l1"), l2.alias("subtopic_l2"), F.lit("confirmed").alias("status"), F.lit(0.95).alias("confidence"), F.lit("RULE").alias("source"))


def seeded_tags(questions: DataFrame, labelled: DataFrame, tags: DataFrame, key: str, rule_l1: Column, rule_l2: Column) -> DataFrame:
    """(key, topic_l1, subtopic_l2, origin) of each question without a tag: from its labelled row, else its own fields, else the rules."""
    lab = labelled.groupBy(key).agg(F.min(F.struct("l1", "l2")).alias("__l"))
    bare = questions.join(tags.select(key).distinct(), key, "left_anti").join(lab, key, "left")
    own = F.coalesce(F.trim("topic"), F.lit("")) != ""
    origin = F.when(F.col("__l").isNotNull(), "LABEL").when(own, "FIELD").otherwise("RULE")
    pick = lambda a, b, c: F.when(F.col("__l").isNotNull(), a).when(own, b).otherwise(c)
    return bare.select(key, pick(F.col("__l.l1"), F.col("topic"), rule_l1).alias("topic_l1"), pick(F.col("__l.l2"), F.coalesce("subtopic", "topic"), rule_l2).alias("subtopic_l2"), origin.alias("origin"))


def saved_quiz(bank: DataFrame, ids: list, key: str = "id") -> DataFrame:
    """Rows of a saved quiz: the bank's rows with ``order_index``, in the order of ``ids``; unknown ids are skipped and leave no gap, a repeated id is a row each time."""
    spark = bank.sparkSession
    wanted = spark.createDataFrame([(i, n) for n, i in enumerate(ids)], f"{key} {bank.schema[key].dataType.simpleString()}, __n int")
    found = bank.join(F.broadcast(wanted), key)
    return found.withColumn("order_index", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__n")) - 1).drop("__n")


def repeats_without(repeats: DataFrame, gone: DataFrame, key: str, repeat: str) -> tuple[DataFrame, DataFrame]:
    """(repeats, counts): the repeats without those in ``gone(repeat)``, and every touched question's new occurrence_count."""
    left = repeats.join(gone.select(repeat), repeat, "left_anti").select(*repeats.columns)
    touched = repeats.join(gone.select(repeat), repeat, "left_semi").select(key).distinct()
    n = left.groupBy(key).agg(F.count("*").alias("__n"))
    return left, touched.join(n, key, "left").select(key, (F.coalesce("__n", F.lit(0)) + 1).alias("occurrence_count"))


def batch_counters(results: DataFrame) -> DataFrame:
    """One row of a tagging job's results (status, error): processed, confirmed, draft, failed."""
    failed = F.col("error").isNotNull()
    return results.agg(F.count("*").alias("processed"), F.count_if(~failed & (F.col("status") == "confirmed")).alias("confirmed"), F.count_if(~failed & (F.col("status") == "draft")).alias("draft"), F.count_if(failed).alias("failed"))


def replaced_paths(paths: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``paths`` with all paths of the questions in ``new`` replaced by those."""
    return paths.join(new.select(key).distinct(), key, "left_anti").select(*paths.columns).unionByName(new.select(*paths.columns))


def ensured_meta(meta: DataFrame, fresh: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``meta`` with a row for every question of ``fresh``, whose columns are filled in where they are null and refreshed where no person edited them.

    A fresh null changes nothing. Rows of questions that ``fresh`` has not stay as they are; running it again changes nothing.
    """
    f = fresh.select(F.col(key), F.lit(True).alias("__new"), *[F.col(c).alias(f"__{c}") for c in columns])
    both = meta.join(f, key, "full")
    by_hand = lambda c: F.coalesce(F.array_contains("manual_fields", c), F.lit(False)) & F.col(c).isNotNull()
    return both.select(*[F.when(by_hand(c), F.col(c)).otherwise(F.coalesce(f"__{c}", c)).alias(c) if c in columns else F.col(c) for c in meta.columns])


def backfilled(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows of a backfill that are still to do; a second run over its own result has none."""
    return rows.join(done.select(key).distinct(), key, "left_anti").select(*rows.columns)


def rebuilt(table: DataFrame, fresh: DataFrame, document: str) -> DataFrame:
    """``table`` with all rows of the documents in ``fresh`` replaced by those: a deck that was read again, or half of one."""
    return table.join(fresh.select(document).distinct(), document, "left_anti").select(*table.columns).unionByName(fresh.select(*table.columns))
