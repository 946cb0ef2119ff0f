"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    One is made up only where the session names none and runs on one machine, as in tests; on a
    cluster executors could not read it, so there an unset ``spark.checkpoint.dir`` is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="questora-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df``, a slim table, in the shared checkpoint folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared checkpoint folder and read again: for tables with texts."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Rows of ids and hashes that one task reads.
TASK_ROWS = 50_000


def few(df: DataFrame, rows: int = 0) -> DataFrame:
    """``df``, a slim table of about so many rows, in as many partitions as they need, one for each core at least.

    The driver keeps a record of each task, so a shuffle's partitions should not all become tasks where rows are few.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


#: Rows of an Arrow batch where rows hold whole texts.
BATCH_ROWS = 1024


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """What runs inside hands Python at most so many rows at once: a batch of texts lies in an executor several times over, in the JVM and in Python.

    Only what is executed inside counts, such as ``stored`` and ``cut``; the session's setting comes back afterwards.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def word_count(text: Column) -> Column:
    """Number of words as a long; null and blank texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold_remainder(doc_id: Column, n: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo ``n``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def smallest_by_hash(df: DataFrame, key: str, bound: int, seed: int = 11) -> DataFrame:
    """At most ``bound`` rows, those whose key hashes lowest: a seeded sample of fixed size."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(bound)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, per_class: int, max_chars: int, extra: tuple[str, ...] = ()) -> list:
    """A bounded sample of labelled documents, as rows (text, y, *extra) ordered by a seeded hash.

    At most ``per_class`` rows of each class (0 and 1), none longer than ``max_chars`` and
    none of the held-out fold. The driver receives one row of each document drawn, a quarter
    more than are used: at most ``2.5 * per_class * max_chars`` characters whatever the size of
    the corpus and however often a document is repeated.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold_remainder(F.col("doc_id"), folds) != held))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    # Drawn with a margin, as long documents drop out after the join.
    picked = None
    for y in (0, 1):
        part = smallest_by_hash(known.where(F.col("y") == y), "doc_id", per_class + per_class // 4)
        picked = part if picked is None else picked.unionByName(part)
    texts = (
        docs.select(*dict.fromkeys(["doc_id", "text", *extra]))
        .where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
        .join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id").agg(F.min(F.struct(*dict.fromkeys(["text", "y", *[c for c in extra if c != "doc_id"]]))).alias("r"))
        .select("doc_id", "r.*", F.xxhash64("doc_id", F.lit(5)).alias("o"))
    )
    rows = sorted(texts.collect(), key=lambda r: (r.o, r.doc_id))
    out, n = [], {0: 0, 1: 0}
    for r in rows:
        if n[r.y] < per_class:
            n[r.y] += 1
            out.append((r.text, r.y, *(r[c] for c in extra)))
    return out


def by_size(texts: list, most: int) -> Iterator[list]:
    """``texts`` in successive parts of about ``most`` characters; a longer text is a part of its own."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t or "") > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t or "") + 16
    if part:
        yield part


#: A key with this share of the rows is hot; so few keys can be that a table of them is small whatever the data.
HOT_SHARE = 1000


def looked_up(rows: DataFrame, key: str, found: DataFrame, total: int) -> DataFrame:
    """``rows`` joined with ``found(key, n, ...)``, where ``n`` says how many rows have the key; rows without a match go.

    Keys of at least one in ``HOT_SHARE`` of the ``total`` rows, of which there are at most
    ``HOT_SHARE``, meet their rows by broadcast, so that no task gets all rows of a hot key; the others join by key.
    """
    found = cut(found)
    hot = found.where(F.col("n") * HOT_SHARE >= F.lit(total))
    cold = found.where(F.col("n") * HOT_SHARE < F.lit(total)).drop("n").hint("merge")
    if hot.isEmpty():
        return rows.join(cold, key)
    few = F.broadcast(hot.drop("n"))
    return rows.join(few, key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


#: Items up to which lists per key are broadcast, some 8 MB of hashes; beyond it they join by salted key.
BROADCAST_ITEMS = 1_000_000
SALTS = 32


def with_lists(rows: DataFrame, key: str, lists: DataFrame, name: str, most: int = BROADCAST_ITEMS) -> DataFrame:
    """``rows`` with column ``name``: the array of its key in ``lists(key, items)``, null where there is none.

    The lists are materialised and counted first. Few enough, they are broadcast and no row
    moves. Otherwise each list is repeated for ``SALTS`` salts and rows join by key and salt, so
    a key with a third of the rows is spread over as many tasks. Null keys match.
    """
    known = cut(lists.select(F.col(key).alias("__key"), F.col("items").alias(name)))
    n = known.agg(F.sum(F.size(name) + 1)).first()[0] or 0
    if n <= most:
        return rows.join(F.broadcast(known), rows[key].eqNullSafe(F.col("__key")), "left").drop("__key")
    salted = known.select("__key", name, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt2"))
    dealt = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    same = dealt[key].eqNullSafe(F.col("__key")) & (F.col("__salt") == F.col("__salt2"))
    return dealt.join(salted, same, "left").drop("__key", "__salt", "__salt2")
