"""Filters, joins, aggregates and set operations over a question bank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Filters ---------------------------------------------------------------------------------
def contains_any(columns: list[Column], needle: str) -> Column:
    """Substring in any column, whatever the case; % and _ in the needle keep their SQL meaning."""
    return reduce(lambda a, b: a | b, [F.coalesce(c.ilike(f"%{needle}%"), F.lit(False)) for c in columns])


def grade_overlap(low: Column, high: Column, lo: int | None, hi: int | None) -> Column:
    """Grade ranges that overlap the wanted one widened by a year; everything unless both ends are given."""
    return F.lit(True) if lo is None or hi is None else (low <= hi + 1) & (high >= lo - 1)


def grade_within(low: Column, high: Column, lo: int | None, hi: int | None) -> Column:
    return (F.lit(True) if lo is None else low >= lo) & (F.lit(True) if hi is None else high <= hi)


def grade_not_disjoint(low: Column, high: Column, lo: int | None, hi: int | None) -> Column:
    """Excludes a row only if a bound and the row's own bound are both given and miss each other."""
    ok = F.lit(True)
    if lo:
        ok = ok & (F.coalesce(high, F.lit(0)).isin(0) | (high >= lo))
    if hi:
        ok = ok & (F.coalesce(low, F.lit(0)).isin(0) | (low <= hi))
    return ok


def has_media(text: Column, arrays: list[Column], wanted: bool | None) -> Column:
    if wanted is None:
        return F.lit(True)
    some = reduce(lambda a, b: a | b, [F.coalesce(F.size(a) > 0, F.lit(False)) for a in arrays], F.coalesce(F.trim(text) != "", F.lit(False)))
    return some if wanted else ~some


# Names of one format.
FORMAT_TWINS = [{"CONNECT", "CONNECT_4"}, {"THREE_CLUE", "STEPPED_CLUE"}, {"QA", "STANDARD_QA", "SLIDE_QA"}]


def format_is(columns: list[Column], wanted: str) -> Column:
    names = sorted(next((t for t in FORMAT_TWINS if wanted in t), {wanted}))
    return reduce(lambda a, b: a | b, [F.coalesce(c.isin(names), F.lit(False)) for c in columns])


def unused_by(used_in: Column, quizzes: list[str], audiences: list[str], since_year: int | None = None) -> Column:
    """Rows not used before in a listed quiz or for a listed audience, optionally since a year."""
    def hit(u: Column) -> Column:
        named = u["quiz"].isin(quizzes) | u["audience"].isin(audiences)
        return F.coalesce(named & (F.lit(True) if since_year is None else u["year"] >= since_year), F.lit(False))

    return ~F.coalesce(F.exists(used_in, hit), F.lit(False))


# File names of stand-in media.
PLACEHOLDERS = ["placeholder.png", "placeholder.jpg", "no-image.png", "missing.png"]


def real_media(paths: Column) -> Column:
    return F.filter(paths, lambda p: ~F.lower(F.substring_index(p, "/", -1)).isin(PLACEHOLDERS))


def sorted_page(df: DataFrame, column: str, allowed: list[str], descending: bool, limit: int, offset: int, key: str, fallback: str) -> DataFrame:
    """One page by one column of an allow-list, ties by key; nulls last."""
    c = column if column in allowed else fallback
    order = F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last()
    return df.orderBy(order, F.col(key)).offset(offset).limit(max(1, min(200, limit)))


# Joins -----------------------------------------------------------------------------------
def enriched(rows: DataFrame, key: str, one: DataFrame, many: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """``rows`` with a 1:1 side and 1:n sides, each folded to one ordered array before it joins."""
    out = rows.join(one, key, "left")
    for name, (side, order) in many.items():
        folded = side.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in side.columns if c != key and c not in order]))).alias(name))
        out = out.join(folded, key, "left")
    return out


def with_original(rows: DataFrame, key: str, of: str, columns: list[str]) -> DataFrame:
    """``rows`` with ``original``, a struct of some columns of the row that ``of`` points to; null where it points to none that is there."""
    other = rows.select(F.col(key).alias("__k"), F.struct(*columns).alias("original"))
    return rows.join(other, F.col(of) == F.col("__k"), "left").drop("__k")


def between_join(left: DataFrame, right: DataFrame, key: str, at: str, low: str, high: str) -> DataFrame:
    """Rows of one document whose position lies in the other row's range; an equi-join with a bound."""
    return left.join(right, (left[key] == right[key]) & (left[at] >= right[low]) & (left[at] <= right[high])).drop(right[key])


def propagate(fields: DataFrame, target: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``target`` with columns taken from its deck, except those listed in ``manual_fields``."""
    side = fields.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    kept = lambda c: F.coalesce(F.array_contains("manual_fields", c), F.lit(False)) | F.col(f"__{c}").isNull()
    out = target.join(side, key, "left")
    return out.select(*[F.when(kept(c), F.col(c)).otherwise(F.col(f"__{c}")).alias(c) if c in columns else F.col(c) for c in target.columns])


# Aggregates ------------------------------------------------------------------------------
def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def topic_summary(df: DataFrame, by: str, label: str, levels: list[str], default: str, low: str, high: str, sub: str) -> DataFrame:
    """Total, a histogram with a column per level (null counts as ``default``), range and distinct parts of each topic."""
    level = F.coalesce(F.col(label), F.lit(default))
    return df.groupBy(by).agg(
        F.count("*").alias("total"), *[F.count_if(level == v).alias(f"n_{v.lower()}") for v in levels],
        F.min(F.when(F.col(low) > 0, F.col(low))).alias("lowest"), F.max(F.when(F.col(high) > 0, F.col(high))).alias("highest"), F.sort_array(F.collect_set(sub)).alias("parts"),
    )


def co_occurrence(tags: DataFrame, key: str, tag: str, top: int = 3) -> DataFrame:
    """For each tag the ``top`` tags most often on the same row; ``tags(key, tag)``.

    Tags differ whatever the case; ties go to the smaller tag. Rows with many tags pair them, as asked.
    """
    t = tags.select(key, tag).distinct()
    other = t.select(key, F.col(tag).alias("other"))
    pairs = t.join(other, key).where(F.lower(tag) != F.lower("other")).groupBy(tag, "other").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(tag).orderBy(F.desc("n"), "other"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= top)


def blocked_only_by(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: how many rows pass all rules, and per rule how many fail that one alone."""
    ok = {n: F.coalesce(c, F.lit(False)) for n, c in rules.items()}
    every = reduce(lambda a, b: a & b, ok.values())
    alone = {n: reduce(lambda a, b: a & b, [c for m, c in ok.items() if m != n], F.lit(True)) & ~ok[n] for n in ok}
    return df.agg(F.count("*").alias("total"), F.count_if(every).alias("passing"), *[F.count_if(c).alias(f"only_{n}") for n, c in alone.items()])


# Sets and samples ------------------------------------------------------------------------
def priority_union(parts: list[DataFrame], key: str, order: str, limit: int) -> DataFrame:
    """Rows of the parts in the parts' order, each key once, cut to ``limit``."""
    all_rows = reduce(DataFrame.unionByName, [p.withColumn("priority", F.lit(i)) for i, p in enumerate(parts)])
    once = all_rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy("priority", order))).where("__r = 1").drop("__r")
    return once.orderBy("priority", order, key).limit(limit)


def relaxed(df: DataFrame, strict: Column) -> DataFrame:
    """The strict rows, or all rows if there is none, decided in one plan by a one-row side."""
    any_strict = df.agg(F.max(F.coalesce(strict, F.lit(False)).cast("int")).alias("__any"))
    return df.join(F.broadcast(any_strict)).where((F.col("__any") == 0) | strict).drop("__any")


def capped(df: DataFrame, group: str, order: list, cap: int, limit: int) -> DataFrame:
    """At most ``cap`` rows of a group in the first pass; leftovers fill up in order. ``pos`` numbers the result.

    Only the first ``limit`` rows of a group can be picked, so the global ranking sees no more.
    """
    in_group = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    few = df.withColumn("__g", in_group).where(F.col("__g") <= limit).withColumn("later", (F.col("__g") > cap).cast("int"))
    first = few.orderBy("later", *order).limit(limit)
    return first.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("later", *order))).drop("__g")


def quotas(df: DataFrame, tier: str, order: list, wanted: dict[str, int]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(tier).orderBy(*order))
    limit = F.create_map(*[x for k, v in wanted.items() for x in (F.lit(k), F.lit(v))])
    return df.where(F.col(tier).isin(list(wanted))).withColumn("pos", rank).where(F.col("pos") <= F.element_at(limit, F.col(tier)))


def stratified_to(df: DataFrame, stratum: str, key: str, each: int, small: int, total: int, seed: int = 7) -> DataFrame:
    """``stratified``, filled up to ``total`` rows with others by the same hash; ``first`` tells the two apart. More than ``total`` first rows all stay."""
    h = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed)))
    first = stratified(df, stratum, key, each, small, seed).drop("pos")
    counted = first.agg(F.greatest(F.lit(total) - F.count("*"), F.lit(0)).alias("__room"))
    others = df.join(first.select(key), key, "left_anti").orderBy(h, key).limit(total)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(h, key))
    fill = others.withColumn("__r", place).join(F.broadcast(counted)).where(F.col("__r") <= F.col("__room")).select(*df.columns)
    return first.select(*df.columns, F.lit(True).alias("first")).unionByName(fill.withColumn("first", F.lit(False)))


def stratified(df: DataFrame, stratum: str, key: str, each: int, small: int, seed: int = 7) -> DataFrame:
    """``each`` rows of a stratum by seeded hash, ``small`` of one that has fewer rows than ``each``."""
    h = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(seed)))
    # A literal limit on the rank lets each partition pass on only its first rows.
    few = df.withColumn("pos", F.row_number().over(Window.partitionBy(stratum).orderBy(h, key))).where(F.col("pos") <= max(each, small))
    counts = df.groupBy(F.col(stratum).alias("__s")).agg(F.count("*").alias("__n"))
    ranked = few.join(counts, F.col(stratum).eqNullSafe(F.col("__s")))
    return ranked.where(F.col("pos") <= F.when(F.col("__n") >= each, each).otherwise(small)).drop("__n", "__s")
