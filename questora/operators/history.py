"""Append-only histories: current values, and next states in place of updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current(rows: DataFrame, key: str, status: str, at: str, tie: str) -> DataFrame:
    """The current row per key: confirmed first, then newest, then largest tie-break; superseded rows never."""
    first = F.row_number().over(Window.partitionBy(key).orderBy((F.col(status) == "confirmed").desc(), F.desc(at), F.desc(tie)))
    return rows.where(F.col(status) != "superseded").withColumn("__r", first).where("__r = 1").drop("__r")


def newest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The newest rows per key whatever their status; rows of one time all stay."""
    return rows.withColumn("__r", F.rank().over(Window.partitionBy(key).orderBy(F.desc(at)))).where("__r = 1").drop("__r")


def superseded(rows: DataFrame, key: str, status: str, at: str, tie: str) -> DataFrame:
    """The next state after promotions: all confirmed rows of a key but the newest become superseded.

    A confirmed row of source HUMAN outranks any machine's.
    """
    human = (F.col("source") == "HUMAN") if "source" in rows.columns else F.lit(False)
    order = Window.partitionBy(key, F.col(status) == "confirmed").orderBy(human.desc(), F.desc(at), F.desc(tie))
    old = (F.col(status) == "confirmed") & (F.row_number().over(order) > 1)
    return rows.withColumn(status, F.when(old, "superseded").otherwise(F.col(status)))


def overridden(rows: DataFrame, decisions: DataFrame, key: str, at: str, tie: str, taxonomy: DataFrame, now: Column, actor: str) -> DataFrame:
    """``rows`` after people's own tags ``decisions`` (key, subtopic_l2, and any other columns of ``rows``): one new row each, confirmed, of source HUMAN and confidence 1.

    Its theme is the subtopic's in ``taxonomy(l1, l2)``, null for an unknown one. The newest confirmed row of its key is superseded, the others stay. A key that was decided
    more than once gets a row for each. New rows have no ``tie`` yet.
    """
    asked = decisions.select(F.col(key).alias("__k")).distinct()
    place = F.row_number().over(Window.partitionBy(key).orderBy((F.col("status") == "confirmed").desc(), F.desc(at), F.desc(tie)))
    old = F.col("__k").isNotNull() & (F.col("status") == "confirmed") & (F.col("__r") == 1)
    kept = rows.withColumn("__r", place).join(asked, F.col(key) == F.col("__k"), "left").withColumn("status", F.when(old, "superseded").otherwise(F.col("status"))).select(*rows.columns)
    parents = taxonomy.groupBy(F.col("l2").alias("__l2")).agg(F.max("l1").alias("__l1"))
    new = decisions.join(parents, F.col("subtopic_l2") == F.col("__l2"), "left")
    fixed = {"status": F.lit("confirmed"), "source": F.lit("HUMAN"), "confidence": F.lit(1.0), "topic_l1": F.col("__l1"), "verified_by": F.lit(actor), "verified_at": now, at: now, tie: F.lit(None)}

    def value(c: str) -> Column:
        made = fixed.get(c, F.col(c) if c in decisions.columns else F.lit("good") if c == "fit" else F.lit(None))
        return made.cast(rows.schema[c].dataType).alias(c)

    return kept.unionByName(new.select(*[value(c) for c in rows.columns]))


def changes(before: DataFrame, after: DataFrame, tie: str, status: str, actor: str) -> DataFrame:
    """Audit rows of what differs between two states of a history."""
    b = before.select(F.col(tie), F.col(status).alias("from_status"))
    joined = after.select(F.col(tie), F.col(status).alias("to_status")).join(b, tie, "left").where(~F.col("from_status").eqNullSafe(F.col("to_status")))
    kind = F.when(F.col("to_status") == "superseded", "SUPERSEDE").when(F.col("to_status") == "confirmed", "PROMOTE").otherwise("CHANGE")
    return joined.select(F.col(tie), "from_status", "to_status", kind.alias("change_type"), F.lit(actor).alias("actor"))


def merged(base: DataFrame, updates: DataFrame, key: str, columns: list[str], manual: str = "manual_fields") -> DataFrame:
    """Upsert of ``columns`` by key: new keys are added, null updates and manual fields change nothing."""
    u = updates.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in columns])
    both = base.join(u, base[key] == F.col("__k"), "full")
    def value(c: str) -> Column:
        if c == key:
            return F.coalesce(F.col(key), F.col("__k")).alias(c)
        if c not in columns:
            return F.col(c)
        held = F.coalesce(F.array_contains(manual, c), F.lit(False)) if manual in base.columns else F.lit(False)
        return F.when(held, F.col(c)).otherwise(F.coalesce(f"__{c}", c)).alias(c)

    return both.select(*[value(c) for c in base.columns])


def appended_once(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with those new rows whose keys it has not; equal new rows once."""
    fresh = new.dropDuplicates(keys)
    cond = [base[k].eqNullSafe(fresh[k]) for k in keys]
    return base.unionByName(fresh.join(base, cond, "left_anti"), allowMissingColumns=True)


def deleted(base: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return base.join(gone.select(key).distinct(), key, "left_anti")


def scoped_delete(base: DataFrame, scope: dict | None, everything: bool = False) -> DataFrame:
    """Rows outside the scope; refuses to delete without one unless told to."""
    if not scope and not everything:
        raise ValueError("a delete needs a scope, or everything=True")
    if everything:
        return base.limit(0)
    hit = F.lit(True)
    for k, v in scope.items():
        hit = hit & F.col(k).eqNullSafe(F.lit(v))
    return base.where(~hit)


def repeat_counts(questions: DataFrame, repeats: DataFrame, key: str) -> DataFrame:
    """``questions`` with occurrence_count = 1 + its repeats."""
    n = repeats.groupBy(key).agg(F.count("*").alias("__n"))
    return questions.drop("occurrence_count").join(n, key, "left").withColumn("occurrence_count", F.coalesce("__n", F.lit(0)) + 1).drop("__n")


def latest_status(events: DataFrame, key: str, at: str, status: str) -> DataFrame:
    return events.groupBy(key).agg(F.max_by(status, F.struct(at, status)).alias(status), F.max(at).alias(at), F.count("*").alias("n_events"))
