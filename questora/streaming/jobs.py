"""Incremental state over event streams; every function takes a batch or a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Seconds to wait before each retry.
BACKOFF = [0, 15, 30, 60, 120, 300]
STALE_MINUTES, ABANDONED_MINUTES = 8, 5


def parquet_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A folder of Parquet files as a stream; the schema is that of the files there are."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def new_versions(listing: DataFrame, at: str, delay: str = "1 day") -> DataFrame:
    """Each (id, etag) of a listing once, in bounded state."""
    return listing.withWatermark(at, delay).dropDuplicatesWithinWatermark(["id", "etag"])


def windowed(events: DataFrame, at: str, by: list[str], length: str, slide: str | None = None, delay: str = "10 minutes", value: str | None = None) -> DataFrame:
    """Counts (and sums) per tumbling or sliding window; rows later than ``delay`` are left out of a stream."""
    src = events.withWatermark(at, delay) if events.isStreaming else events
    aggs = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    return src.groupBy(F.window(at, length, slide) if slide else F.window(at, length), *by).agg(*aggs)


def sessions(events: DataFrame, key: str, at: str, gap: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Stretches of activity per key, ended by a gap; a key silent for the gap counts as abandoned."""
    src = events.withWatermark(at, delay) if events.isStreaming else events
    return src.groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))


def claimable(jobs: DataFrame, now: Column, at: str = "updated_at") -> DataFrame:
    """Pending jobs whose backoff has passed, oldest first."""
    wait = F.get(F.array(*[F.lit(s) for s in BACKOFF]), F.least("retry_count", F.lit(len(BACKOFF) - 1)))
    return jobs.where((F.col("status") == "PENDING") & (F.unix_timestamp(now) - F.unix_timestamp(at) >= wait)).orderBy("created_at", "id")


def stale(jobs: DataFrame, now: Column, at: str = "updated_at", minutes: int = STALE_MINUTES) -> DataFrame:
    """Running jobs without a sign of life, with their next state: retried, or failed when retries are used up."""
    quiet = (F.col("status") == "RUNNING") & (F.unix_timestamp(now) - F.unix_timestamp(at) > 60 * minutes)
    return jobs.where(quiet).withColumn("next_status", F.when(F.col("retry_count") < F.col("max_retries"), "PENDING").otherwise("FAILED"))


#: Steps of a deck's job, in order.
STEPS = ["DOWNLOAD", "PARSE", "CLASSIFY", "EXTRACT", "DESCRIBE", "TAG", "EMBED", "FINISH"]


def advanced(jobs: DataFrame, outcomes: DataFrame, steps: list[str] = STEPS) -> DataFrame:
    """``jobs`` (id, step, status, retry_count, max_retries, cursor) after ``outcomes`` (id, outcome, cursor) of one micro-batch.

    ok goes on to the next step, or completes the last; yield keeps the step and the cursor it got to; error tries the step
    again, or fails the job once its retries are used up. Jobs without an outcome, and finished ones, stay. One outcome counts per job.
    """
    o = outcomes.groupBy("id").agg(F.max_by(F.struct("outcome", F.col("cursor").alias("at")), "outcome").alias("o"))
    order = F.array(*[F.lit(x) for x in steps])
    place = F.array_position(order, F.col("step")).cast("int")
    live, said = ~F.col("status").isin("COMPLETED", "FAILED"), F.col("o.outcome")
    spent = F.col("retry_count") >= F.col("max_retries")
    nxt = {
        "step": F.when(live & (said == "ok") & (place < len(steps)), F.get(order, place)).otherwise(F.col("step")),
        "status": F.when(live & (said == "ok"), F.when(place >= len(steps), "COMPLETED").otherwise("PENDING")).when(live & (said == "yield"), "PENDING").when(live & (said == "error"), F.when(spent, "FAILED").otherwise("PENDING")).otherwise(F.col("status")),
        "retry_count": F.when(live & (said == "error") & ~spent, F.col("retry_count") + 1).when(live & (said == "ok"), 0).otherwise(F.col("retry_count")),
        "cursor": F.when(live & (said == "yield"), F.col("o.at")).when(live & (said == "ok"), F.lit(None)).otherwise(F.col("cursor")),
    }
    return jobs.join(o, "id", "left").select(*[nxt[c].cast(jobs.schema[c].dataType).alias(c) if c in nxt else F.col(c) for c in jobs.columns])


def queue_positions(jobs: DataFrame) -> DataFrame:
    """(id, position): how many pending jobs were created before, counted through per-minute sums so no task sorts the queue."""
    from pyspark.sql import Window

    p = jobs.where("status = 'PENDING'").withColumn("slot", F.date_trunc("minute", "created_at"))
    per = p.groupBy("slot").agg(F.count("*").alias("n"))
    before = per.select("slot", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("slot")) - F.col("n")).alias("before"))
    here = F.row_number().over(Window.partitionBy("slot").orderBy("created_at", "id")) - 1
    return p.withColumn("here", here).join(before, "slot").select("id", (F.col("before") + F.col("here")).alias("position"))


def ring_buffer(events: DataFrame, key: str, at: str, message: str, size: int = 60) -> DataFrame:
    """The newest ``size`` messages per key, oldest first."""
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc(message)))
    last = events.withColumn("__r", r).where(F.col("__r") <= size)
    return last.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(at, message))), lambda s: s[message]).alias("messages"))


def quiet_workers(beats: DataFrame, key: str, at: str, timeout: str = "8 minutes") -> DataFrame:
    """(key, beats): emitted once a worker's event-time timeout passes without another beat."""
    minutes = int(timeout.split()[0])

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (n,) = state.get
            state.remove()
            yield pd.DataFrame({key: [k[0]], "beats": [n]})
            return
        n, last = (state.get[0] if state.exists else 0), None
        for b in batches:
            n += len(b)
            last = b[at].max() if last is None else max(last, b[at].max())
        state.update((n,))
        due = int(last.timestamp() * 1000) + minutes * 60_000
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    kind = beats.schema[key].dataType.simpleString()
    return beats.withWatermark(at, "1 minute").groupBy(key).applyInPandasWithState(run, f"{key} {kind}, beats long", "n long", "append", GroupStateTimeout.EventTimeTimeout)


#: Parts of a table of newest rows; a batch rewrites those that it touches. Versions of a part that stay: the last, and the one that its batch began from.
PARTS, KEPT = 64, 2


def latest_into(table_path: str, key: str, at: str, parts: int = PARTS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the newest row per key; read it with ``newest_of``.

    Keys are dealt into ``parts``. A batch writes a new version of the parts that it touches and of no others. A batch
    that runs again starts from the versions before it and writes the same one, so restarts change nothing. Older versions of the parts that it touched go.
    """
    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        touched = [r["part"] for r in rows.select("part").distinct().collect()]  # at most ``parts``
        if not touched:
            return
        before = _versions(spark, table_path)
        if before is not None:
            rows = _latest(before.where((F.col("v") < n) & F.col("part").isin(touched))).drop("v").unionByName(rows, allowMissingColumns=True)
        cols = [c for c in rows.columns if c not in (key, "part")]
        newest = rows.groupBy("part", key).agg(F.max_by(F.struct(*cols), at).alias("r")).select("part", key, "r.*")
        newest.write.mode("overwrite").partitionBy("part").parquet(f"{table_path}/v={n}")
        _drop_old(spark, table_path, set(touched))

    return write


def _drop_old(spark: SparkSession, path: str, parts: set[int], keep: int = KEPT) -> None:
    """Deletes all but the last ``keep`` versions of some parts, wherever the table lies."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v=*/part=*")
    store = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    by: dict[int, list] = {}
    for f in store.globStatus(pattern) or []:
        v, part = (int(x.partition("=")[2]) for x in (f.getPath().getParent().getName(), f.getPath().getName()))
        if part in parts:
            by.setdefault(part, []).append((v, f.getPath()))
    for own in by.values():
        for _, old in sorted(own, key=lambda x: -x[0])[keep:]:
            store.delete(old, True)


def _versions(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.option("basePath", path).parquet(f"{path}/v=*")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def _latest(versions: DataFrame) -> DataFrame:
    """The rows of each part's last version; the table of versions has a row per part and version."""
    last = versions.groupBy("part").agg(F.max("v").alias("v"))
    return versions.join(F.broadcast(last), ["part", "v"])


def newest_of(spark: SparkSession, table_path: str) -> DataFrame:
    """The newest row per key that ``latest_into`` has kept."""
    return _latest(_versions(spark, table_path)).drop("part", "v")
