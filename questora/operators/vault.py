"""The question vault: searching it, reviewing it, and the next state of its rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Wordings that need a picture, and labels that are no subtopic.
VISUAL = ["in the picture", "in the photo", "in the image", "seen here", "on the screen", "this logo", "whose logo", "identify the logo", "this photo", "this image"]
NO_TOPIC = ["Uncategorized", "None", "Unknown"]
#: Rows from which a quiz is better compiled from the vault than written anew.
ENOUGH = 5
MAX_PATHS, MAX_KEYWORDS = 6, 12


def says(needle: str, texts: list[Column], lists: list[Column] = ()) -> Column:
    """Whether a text, or a list written as JSON, holds the needle whatever the case; % and _ are wild cards."""
    term = f"%{needle.strip()}%"
    return reduce(lambda a, b: a | b, [F.coalesce(c.ilike(term), F.lit(False)) for c in [*texts, *[F.to_json(x) for x in lists]]])


def without_visuals(question: Column, lists: list[Column]) -> Column:
    """Whether a question needs no picture: no media, and none of the wordings that point to one."""
    empty = [F.coalesce(F.size(x) == 0, F.lit(True)) for x in lists]
    wording = [~F.coalesce(question.ilike(f"%{p}%"), F.lit(False)) for p in VISUAL]
    return reduce(lambda a, b: a & b, empty + wording)


def well_tagged(status: Column, source: Column, verified_by: Column, l2: Column, fit: Column, confidence: Column, notes: Column) -> Column:
    """Whether a tag needs no review: confirmed by a person, or of a real subtopic and confirmed or sure."""
    human = (status == "confirmed") & ((source == "HUMAN") | verified_by.isNotNull())
    n = F.coalesce(notes, F.lit(""))
    sure = (fit == "good") & (confidence >= 0.65) & ~n.contains("mismatch") & ~n.contains("failed")
    real = l2.isNotNull() & (l2 != "") & ~l2.isin(NO_TOPIC)
    return F.coalesce(human, F.lit(False)) | F.coalesce(real & (F.coalesce(status == "confirmed", F.lit(False)) | F.coalesce(sure, F.lit(False))), F.lit(False))


def to_review(questions: DataFrame, tags: DataFrame, key: str, good: Column) -> DataFrame:
    """Questions without a single tag that is ``good``."""
    return questions.join(tags.where(good).select(key), key, "left_anti")


def _bare(tag: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.trim(tag), "^#+", "")))


def tag_preview(rows: DataFrame, topic: Column, tags: Column, difficulty: Column, wanted_topic: str | None, wanted_tags: list[str]) -> DataFrame:
    """One row: how many questions match topic and tags, tags alone or the topic alone; difficulties of the pool; HISTORICAL or NEW.

    A tag matches if one of the two holds the other. Without wanted tags the pool is the topic's.
    """
    wanted = F.array(*[F.lit(t.strip().lstrip("#").strip().lower()) for t in wanted_tags]).cast("array<string>")
    by_topic = F.coalesce(F.contains(F.lower(topic), F.lit(wanted_topic.lower())), F.lit(False)) if wanted_topic else F.lit(False)
    by_tag = F.coalesce(F.exists(tags, lambda t: F.exists(wanted, lambda w: F.contains(_bare(t), w) | F.contains(w, _bare(t)))), F.lit(False))
    one = rows.select(by_topic.alias("t"), by_tag.alias("g"), F.coalesce(difficulty, F.lit("Medium")).alias("d"))
    pool = F.col("g") if wanted_tags else F.col("t") & ~F.col("g")
    out = one.agg(
        F.count_if(F.col("t") & F.col("g")).alias("exact"), F.count_if(F.col("g") & ~F.col("t")).alias("cross_topic"), F.count_if(F.col("t") & ~F.col("g")).alias("topic_only"),
        F.count_if(pool).alias("total"), *[F.count_if(pool & (F.col("d") == d)).alias(f"n_{d.lower()}") for d in ("Easy", "Medium", "Hard")],
    )
    return out.withColumn("mode", F.when(F.col("total") >= ENOUGH, "HISTORICAL").otherwise("NEW"))


def hashtags(tags: Column, keywords: Column) -> Column:
    """Tags that are no keyword of a path, whatever the case."""
    low = F.transform(keywords, F.lower)
    return F.filter(tags, lambda t: ~F.array_contains(low, F.lower(t)))


def merged_paths(paths: DataFrame, key: str, at: str) -> DataFrame:
    """Paths (key, at, l1, l2, keywords) that are one but for case, merged: first place and spelling, keywords of all
    in order and once each; at most ``MAX_PATHS`` a question and ``MAX_KEYWORDS`` a path, as a question's tags are few by design."""
    p = paths.withColumn("__1", F.lower("l1")).withColumn("__2", F.lower(F.coalesce("l2", F.lit(""))))
    words = p.select(key, "__1", "__2", at, F.posexplode("keywords").alias("j", "raw"))
    words = words.withColumn("w", F.trim(F.regexp_replace(F.trim("raw"), "^#+", ""))).where("w <> ''")
    once = words.groupBy(key, "__1", "__2", F.lower("w").alias("low")).agg(F.min(F.struct(at, "j", "w")).alias("f"))
    kept = once.groupBy(key, "__1", "__2").agg(F.slice(F.transform(F.sort_array(F.collect_list("f")), lambda s: s["w"]), 1, MAX_KEYWORDS).alias("keywords"))
    first = p.groupBy(key, "__1", "__2").agg(F.min(F.struct(at, "l1", "l2")).alias("p"))
    both = first.join(kept, [key, "__1", "__2"], "left").select(key, F.struct(F.col(f"p.{at}").alias("at"), F.col("p.l1").alias("l1"), F.col("p.l2").alias("l2"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords")).alias("s"))
    ranked = both.groupBy(key).agg(F.slice(F.sort_array(F.collect_list("s")), 1, MAX_PATHS).alias("s"))
    return ranked.select(key, F.posexplode("s").alias("position", "s")).select(key, "position", "s.l1", "s.l2", "s.keywords")


def flat_tags(paths: DataFrame, key: str) -> DataFrame:
    """Paths mirrored into (topic, subtopic, topics, tags) of a question; the first path is the primary one."""
    g = paths.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("position", "l1", "l2", "keywords"))).alias("s"))
    words = F.array_distinct(F.flatten(F.col("s.keywords")))
    low = F.transform(words, F.lower)
    tags = F.filter(words, lambda w, i: F.array_position(low, F.lower(w)) == i + 1)
    return g.select(key, F.col("s")[0]["l1"].alias("topic"), F.col("s")[0]["l2"].alias("subtopic"), F.array_distinct(F.col("s.l1")).alias("topics"), F.slice(tags, 1, 3 * MAX_KEYWORDS).alias("tags"))


def with_repeats(vault: DataFrame, found: DataFrame, key: str, deck: str) -> DataFrame:
    """``vault`` after exact repeats ``found`` (key, deck, number): occurrence_count grows with each new (deck, number),
    provenance with each new deck. Repeats within a question's own deck change nothing."""
    own = vault.select(key, F.col(deck).alias("__own"))
    new = found.select(key, deck, "number").distinct().join(own, key).where(~F.col(deck).eqNullSafe(F.col("__own")))
    n = new.groupBy(key).agg(F.count("*").alias("__n"), F.sort_array(F.collect_set(deck)).alias("__decks"))
    return vault.join(n, key, "left").select(
        *[c for c in vault.columns if c not in ("occurrence_count", "provenance")],
        (F.coalesce("occurrence_count", F.lit(1)) + F.coalesce("__n", F.lit(0))).alias("occurrence_count"),
        F.array_union(F.coalesce("provenance", F.array()), F.coalesce("__decks", F.array())).alias("provenance"),
    )


def resolved(questions: DataFrame, decisions: DataFrame, key: str, original: str, deck: str) -> DataFrame:
    """Flagged rows after review (key, action): a confirmed copy from another deck goes, one from the same deck stays marked, a dismissed one is RESOLVED."""
    o = questions.select(F.col(key).alias("__o"), F.col(deck).alias("__od"))
    q = questions.join(decisions.select(key, F.upper("action").alias("__a")), key, "left").join(o, F.col(original) == F.col("__o"), "left")
    confirm = F.coalesce(F.col("__a").isin("CONFIRM_DUPLICATE", "MERGE"), F.lit(False))
    gone = confirm & F.col("__o").isNotNull() & ~F.col(deck).eqNullSafe(F.col("__od"))
    status = F.when(confirm, "CONFIRMED_DUPLICATE").when(F.col("__a").isin("DISMISS_UNIQUE", "RESOLVE"), "RESOLVED").otherwise(F.col("duplicate_status"))
    return q.where(~gone).withColumn("duplicate_status", status).select(*questions.columns)


def resolved_vault(questions: DataFrame, decisions: DataFrame, key: str, original: str, deck: str, place: str) -> tuple[DataFrame, DataFrame]:
    """(questions, repeats) after review: ``resolved``, and what the confirmed copies leave with their originals.

    An original's occurrence_count (1 where unknown) grows by each confirmed copy that is a repeat of its own: by a copy of its own deck always, by one of another
    deck once for each deck and place. ``provenance`` gets each new deck once, after those that are there. ``repeats`` has (key, deck, place) of those of other decks.
    """
    o = questions.select(F.col(key).alias("__o"), F.col(deck).alias("__od"))
    d = decisions.select(F.col(key).alias("__k"), F.upper("action").alias("__a")).where(F.col("__a").isin("CONFIRM_DUPLICATE", "MERGE")).distinct()
    copies = questions.join(d, F.col(key) == F.col("__k")).join(o, F.col(original) == F.col("__o")).select(F.col("__o").alias("__q"), F.col(deck).alias("__d"), F.col(place).alias("__p"), (~F.col(deck).eqNullSafe(F.col("__od"))).alias("__far"))
    repeats = copies.where("__far").select(F.col("__q").alias(key), F.col("__d").alias(deck), F.col("__p").alias(place)).distinct()
    more = repeats.groupBy(F.col(key).alias("__q")).agg(F.count("*").alias("__n"), F.array_sort(F.collect_set(deck)).alias("__decks"))
    own = copies.where("NOT __far").groupBy("__q").agg(F.count("*").alias("__m"))
    left = resolved(questions, decisions, key, original, deck)
    out = left.join(more.withColumnRenamed("__q", "__q1"), F.col(key) == F.col("__q1"), "left").join(own.withColumnRenamed("__q", "__q2"), F.col(key) == F.col("__q2"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    none = F.array().cast(questions.schema["provenance"].dataType)
    return out.withColumns({
        "occurrence_count": F.when(zero("__n") + zero("__m") > 0, F.coalesce("occurrence_count", F.lit(1)) + zero("__n") + zero("__m")).otherwise(F.col("occurrence_count")),
        "provenance": F.when(zero("__n") > 0, F.array_union(F.coalesce("provenance", none), F.coalesce("__decks", none))).otherwise(F.col("provenance")),
    }).select(*questions.columns), repeats


def reviewed_gold(gold: DataFrame, decisions: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Gold labels (key, gold_l1, gold_l2, alt_l2) after decisions (key, decision, predicted) that UPDATE_GOLD, ADD_ALT or KEEP_GOLD.

    ``parents`` gives l1 of each l2. ``changed_from`` is the old label of a row that a decision touched, else null.
    """
    d = decisions.select(key, F.upper(F.trim("decision")).alias("__d"), F.col("predicted").alias("__p"))
    g = gold.join(d, key, "left").join(parents.select(F.col("l2").alias("__p"), F.col("l1").alias("__l1")), "__p", "left")
    known = F.coalesce(F.col("__d").isin("UPDATE_GOLD", "ADD_ALT", "KEEP_GOLD"), F.lit(False))
    update, add = F.coalesce(F.col("__d") == "UPDATE_GOLD", F.lit(False)), F.coalesce(F.col("__d") == "ADD_ALT", F.lit(False))
    alts = F.filter(F.transform(F.split(F.coalesce("alt_l2", F.lit("")), r"\|"), lambda a: F.trim(a)), lambda a: a != "")
    return g.select(
        key, F.when(update, F.coalesce("__l1", "gold_l1")).otherwise(F.col("gold_l1")).alias("gold_l1"), F.when(update, F.col("__p")).otherwise(F.col("gold_l2")).alias("gold_l2"),
        F.when(add, F.array_join(F.when(F.array_contains(alts, F.col("__p")), alts).otherwise(F.array_append(alts, F.col("__p"))), "|")).otherwise(F.col("alt_l2")).alias("alt_l2"),
        F.when(known, "VERIFIED").otherwise("OPEN").alias("label_status"), F.when(known, F.col("gold_l2")).alias("changed_from"),
    )


def validated(question: Column, answer: Column, options: Column, quote: Column, document: Column, evidence: Column, is_duplicate: Column, difficulty: Column, wanted: str, grade_max: int | None = None) -> Column:
    """Seven checks of a question, and FAILED (answer, options or uniqueness), PASSED (five of seven) or WARNING."""
    q, a, quoted, said = (F.trim(F.coalesce(c, F.lit(""))) for c in (question, answer, quote, evidence))
    bare = lambda o: F.lower(F.trim(F.regexp_replace(o, r"^[A-D1-4][.)]\s*", "")))
    given = F.coalesce(F.size(options) > 0, F.lit(False))
    fits = F.exists(options, lambda o: F.contains(bare(o), bare(a)) | F.contains(bare(a), bare(o)))
    words = F.filter(F.split(F.regexp_replace(F.lower(q), r"[^\p{L}\p{N}_\s]", ""), r"\s+"), lambda w: F.length(w) > 4)
    all_words = F.filter(F.split(q, r"\s+"), lambda w: w != "")
    dense = (F.length(F.regexp_replace(q, r"\s+", "")) / F.greatest(F.size(all_words), F.lit(1)) > 8.0) | (F.size(all_words) > 35)
    checks = {
        "answer_ok": (F.length(a) > 1) & (~given | F.coalesce(fits, F.lit(False))),
        "grounded": (F.length(quoted) > 10) | ((said != "") & F.exists(words, lambda w: F.contains(F.lower(said), w))),
        "grade_ok": ~dense if grade_max is not None and grade_max <= 5 else F.lit(True),
        "unique": ~F.coalesce(is_duplicate, F.lit(False)),
        "options_ok": ~given | ((F.size(options) == 4) & (F.size(F.array_distinct(options)) == F.size(options))),
        "difficulty_ok": F.lower(F.coalesce(difficulty, F.lit("Medium"))) == wanted.lower(),
        "sourced": (quoted != "") | F.coalesce(document.cast("string") != "", F.lit(False)),
    }
    n = reduce(lambda x, y: x + y, [c.cast("int") for c in checks.values()])
    status = F.when(~(checks["answer_ok"] & checks["options_ok"] & checks["unique"]), "FAILED").when(n >= 5, "PASSED").otherwise("WARNING")
    return F.struct(status.alias("status"), *[c.alias(name) for name, c in checks.items()])


def batch_status(items: DataFrame, jobs: DataFrame, key: str) -> DataFrame:
    """Registered files of a batch beside their jobs: REGISTERED without one, CANCELLING while a cancelled job still runs."""
    j = jobs.select(key, F.col("status").alias("__s"), F.col("step").alias("__t"))
    status = F.when(F.col("__s").isNull(), "REGISTERED").when((F.col("__t") == "CANCELLING") & ~F.col("__s").isin("COMPLETED", "FAILED"), "CANCELLING").otherwise(F.col("__s"))
    return items.join(j, key, "left").withColumn("status", status).drop("__s", "__t")
