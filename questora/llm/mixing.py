"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Sizes are summed per (source, hash bin) before anything is shuffled, so neither a source
with most of the rows nor a long document lands in one task. What reaches the driver is one
row of sums per round of filling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, word_count

#: Bins that the documents of a source are dealt into by hash; one of them is cut to fit.
BINS = 1024
EPOCHS = 3
WEIGHTS = (5, 2, 1)
#: Ranges of sources that are ranked side by side.
RANGES = 64


def hash_bin(doc_id: Column, seed: int) -> Column:
    """A document's bin, from the md5 of its id and a seed, so any engine can repeat it."""
    key = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(key, 1, 4), 16, 10).cast("int") % BINS


def ranked(sources: DataFrame) -> DataFrame:
    """``sources(source, size)`` with ``pos``, the place of the source by code point, null last.

    Sources are range-partitioned and each range counts for itself; only the ``RANGES``
    counts are summed up in one place, so the number of sources is free to grow.
    """
    by = F.col("source").asc_nulls_last()
    parts = cut(sources.repartitionByRange(RANGES, by).withColumn("range", F.spark_partition_id()))
    counts = parts.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select("range", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("range")) - F.col("n")).alias("before"))
    here = F.row_number().over(Window.partitionBy("range").orderBy(by)) - 1
    return parts.withColumn("here", here).join(F.broadcast(before), "range").select("source", "size", (F.col("before") + F.col("here")).alias("pos"))


def water_fill(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """``sources(source, size, weight)`` with ``target``: shares of all sizes by weight, capped.

    A source that its share would lift above ``epochs`` times its size is clamped there, and
    what is left is shared anew among the others, until none is above. Each round clamps
    every source above the level at once, so rounds are few; each brings the driver three sums.
    """
    cap = F.col("size") * epochs
    level = None
    while True:
        clamped = F.lit(False) if level is None else cap <= F.lit(level) * F.col("weight")
        got = sources.agg(
            F.sum("size").alias("all"), F.sum(F.when(clamped, cap)).alias("full"), F.sum(F.when(~clamped, F.col("weight"))).alias("open"), F.count(F.when(clamped, 1)).alias("n")
        ).first()
        if not got["open"]:
            break
        new = (got["all"] - (got["full"] or 0)) / got["open"]
        if new == level:
            break
        level = new
    if level is None:
        return sources.withColumn("target", F.lit(0.0))
    share = F.lit(level) * F.col("weight")
    return sources.withColumn("target", F.when(cap <= share, cap.cast("double")).otherwise(share))


def _planned(docs: DataFrame, weights: tuple[float, ...], epochs: int, seed: int, size: Column | None) -> DataFrame:
    """``docs`` with ``__size, __source_size, __target, __whole, __part, __cut``."""
    size = word_count(F.col("text")) if size is None else size
    base = docs.select("*", size.alias("__size"), hash_bin(F.col("doc_id"), seed).alias("__bin"))
    bins = cut(base.groupBy("source", "__bin").agg(F.sum("__size").alias("bin_size")))
    sources = ranked(bins.groupBy("source").agg(F.sum("bin_size").alias("size")))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    targets = water_fill(cut(sources.withColumn("weight", F.get(listed, (F.col("pos") % len(weights)).cast("int")))), epochs)
    size_of = F.col("size")
    t = targets.select(
        F.col("source").alias("__s"), size_of.alias("__source_size"), F.col("target").alias("__target"),
        F.when(size_of > 0, F.least(F.floor(F.col("target") / size_of), F.lit(epochs))).otherwise(0).cast("long").alias("__times"),
    )
    # How far the fractional repetition reaches: all of the bins before, a part of one, none after.
    before = F.coalesce(F.sum("bin_size").over(Window.partitionBy("source").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.col("__target") - F.col("__times") * F.col("__source_size")
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (rest - F.col("before")) / F.col("bin_size")))
    reach = F.when((F.col("bin_size") > 0) & (F.col("__times") < epochs), share).otherwise(F.lit(0.0))
    plan = bins.withColumn("before", before).join(t, F.col("source").eqNullSafe(F.col("__s"))).select(
        "__s", F.col("__bin").alias("__b"), "__source_size", "__target", "__times", reach.alias("__reach")
    )
    joined = base.join(plan, base["source"].eqNullSafe(plan["__s"]) & (base["__bin"] == plan["__b"]))
    part = F.when(F.col("__reach") < 1, F.col("__reach")).otherwise(F.lit(0.0))
    return joined.withColumns({
        "__whole": (F.col("__times") + F.when(F.col("__reach") >= 1, 1).otherwise(0)).cast("long"), "__part": part,
        "__cut": F.floor(part * F.col("__size") + F.lit(0.5)).cast("long"),
    }).drop("__s", "__b", "__times", "__reach", "__bin")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = 7, size: Column | None = None) -> DataFrame:
    """``docs`` with ``size, source_size, target, taken, whole, part``.

    ``size`` counts the words of a text (null: 0) and sources weigh ``weights``, repeating,
    by code point, null last. A source of target/size = r is taken floor(r) times whole. The
    fraction that is left takes whole documents bin after bin of a seeded hash of doc_id; the
    one bin in which the target lies is taken in part, each of its documents by the same
    fraction. ``whole`` and ``part`` are a document's repetitions, ``taken`` their words. The
    words taken of a source thus miss its target by rounding alone, and reruns agree. Rows of
    equal doc_id share a bin. Sources without words have target 0. An empty table gives no rows.
    Columns of these names in ``docs`` are replaced.
    """
    own = ("size", "source_size", "target", "taken", "whole", "part")
    taken = (F.col("__whole") * F.col("__size") + F.col("__cut")).alias("taken")
    named = [taken if c == "taken" else F.col(f"__{c}").alias(c) for c in own]
    return _planned(docs, weights, epochs, seed, size).select(*[c for c in docs.columns if c not in own], *named)


def repeated(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = 7) -> DataFrame:
    """The mix itself: each document once per whole repetition, and for a part its text up to the last word taken.

    The columns are those of ``docs``; ``n_chars``, if there is one, follows the text. A null
    text has no words and is repeated as it stands; an empty table gives no rows.
    """
    copies = F.array_repeat(F.lit(False), F.col("__whole").cast("int"))
    partly = F.when(F.col("__cut") > 0, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>"))
    rows = _planned(docs, weights, epochs, seed, None).withColumn("__partly", F.explode(F.concat(copies, partly)))
    # Each word with the white space before it, so that lines stay lines.
    spaced = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    head = F.array_join(F.slice(spaced, F.lit(1), F.greatest(F.col("__cut").cast("int"), F.lit(1))), "")
    text = F.when(F.col("__partly"), head).otherwise(F.col("text"))

    def column(name: str) -> Column:
        if name == "text":
            return text.alias(name)
        if name == "n_chars":
            return F.when(F.col("__partly"), F.length(head)).otherwise(F.col(name)).cast(docs.schema[name].dataType).alias(name)
        return F.col(name)

    return rows.select(*[column(c) for c in docs.columns])
