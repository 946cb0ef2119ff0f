"""Pluggable model calls: the caller's function runs in Arrow batches on the executors.

A provider is any function from a list of texts to a list of results of the same length, None
where a call failed. Without a network the deterministic local functions stand in.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH, RETRIES = 96, 1


def batched(call: Callable[[list[str]], list], size: int = BATCH, retries: int = RETRIES) -> Callable[[list[str | None]], list]:
    """``call`` over batches of ``size``, in order; what failed is asked again, then left None."""
    def run(texts: list[str | None]) -> list:
        out: list = [None] * len(texts)
        todo = [i for i, t in enumerate(texts) if t]
        for _ in range(retries + 1):
            for at in range(0, len(todo), size):
                part = todo[at: at + size]
                try:
                    for i, v in zip(part, call([texts[i] for i in part])):
                        out[i] = v
                except Exception:  # the provider's failure: asked again, else None
                    continue
            todo = [i for i in todo if out[i] is None]
        return out

    return run


def embedded(c: Column, call: Callable[[list[str]], list], size: int = BATCH) -> Column:
    """Embeddings by a provider; null where it has none, never a zero vector."""
    @F.pandas_udf("array<double>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ask = batched(call, size)
        for s in it:
            yield pd.Series(ask([None if pd.isna(x) else x for x in s]))

    return run(c)


def answered(c: Column, call: Callable[[list[str]], list], size: int = 20) -> Column:
    """A model's JSON answers as text; null where it failed or is no JSON."""
    @F.pandas_udf("string")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ask = batched(call, size)
        for s in it:
            out = []
            for v in ask([None if pd.isna(x) else x for x in s]):
                try:
                    out.append(None if v is None else json.dumps(json.loads(v) if isinstance(v, str) else v))
                except ValueError:
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return run(c)


#: Rows of one call, calls in flight for a task, times a row is asked, and seconds that a call may take.
CHUNK, FLIGHTS, TRIES, TIMEOUT = 20, 8, 3, 90.0


def waits(error: Exception, attempt: int) -> float:
    """Seconds until the next try: what a refusal asks for in ``retry_after``, else longer each time."""
    return float(getattr(error, "retry_after", None) or min(60.0, 1.5 * 2**attempt))


def in_time(call: Callable, args: tuple, seconds: float):
    """The result of a call, or TimeoutError once ``seconds`` are over; the call itself is left to end by itself."""
    out: list = []

    def run() -> None:
        try:
            out.append((call(*args), None))
        except Exception as e:  # handed on to the caller
            out.append((None, e))

    t = threading.Thread(target=run, daemon=True)
    t.start()
    t.join(seconds)
    if not out:
        raise TimeoutError(f"no answer in {seconds:g} s")
    value, error = out[0]
    if error is not None:
        raise error
    return value


def ask_chunk(call: Callable[[str, list[dict]], list[dict]], system: str, items: list[dict], tries: int, timeout: float, wait: Callable[[Exception, int], float]) -> tuple[dict[int, dict], str]:
    """({n: result}, why the others have none): a chunk asked up to ``tries`` times, each time only for what is missing."""
    got: dict[int, dict] = {}
    note = "no answer"
    for attempt in range(tries):
        todo = [i for i in items if i["n"] not in got]
        if not todo:
            break
        try:
            asked = {i["n"] for i in todo}
            for r in in_time(call, (system, todo), timeout) or []:
                if isinstance(r, dict) and r.get("n") in asked:
                    got[r["n"]] = {k: v for k, v in r.items() if k != "n"}
        except Exception as e:  # the provider's failure, which a later try may mend
            note = f"{type(e).__name__}: {e}"[:200]
            if attempt + 1 < tries:
                time.sleep(wait(e, attempt))
    return got, note


def asked(
    df: DataFrame, key: str, text: Column, call: Callable[[str, list[dict]], list[dict]], system: str = "", size: int = CHUNK, flights: int = FLIGHTS, tries: int = TRIES,
    timeout: float = TIMEOUT, wait: Callable[[Exception, int], float] = waits,
) -> DataFrame:
    """(key, answer, status, note) of every row: a model's JSON answer, or a draft that says why there is none.

    Within an Arrow batch the texts go out in chunks of ``size``, ``flights`` of them at a time; the rows keep their order. ``call(system, items)`` gets items (n, text)
    and returns results that name their n; what it leaves out is asked again, alone. A null or blank text is not asked. A call that fails, takes too
    long or answers something else costs its rows nothing but the answer.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = [{"n": n, "text": t} for n, t in enumerate(b.column(1).to_pylist()) if t and t.strip()]
            chunks = [items[i: i + size] for i in range(0, len(items), size)]
            with ThreadPoolExecutor(max_workers=flights) as pool:
                done = list(pool.map(lambda c: ask_chunk(call, system, c, tries, timeout, wait), chunks))
            answer, note = [None] * b.num_rows, ["nothing to ask"] * b.num_rows
            for c, (got, why) in zip(chunks, done):
                for i in c:
                    n = i["n"]
                    try:
                        answer[n], note[n] = (json.dumps(got[n], sort_keys=True), None) if n in got else (None, why)
                    except (TypeError, ValueError) as e:
                        note[n] = f"{type(e).__name__}: {e}"[:200]
            status = ["draft" if a is None else "answered" for a in answer]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string()) for c in (answer, status, note))], names=[key, "answer", "status", "note"])

    return df.select(F.col(key), text.alias("__text")).mapInArrow(run, f"`{key}` {kind}, answer string, status string, note string")


#: Subtopics that a prompt may name.
NAMED = 2_000


def vocabulary_prompt(taxonomy: DataFrame, intro: str, most: int = NAMED) -> str:
    """A system prompt with the live topics and their subtopics; more than ``most`` of these are an error, as no prompt holds them."""
    rows = taxonomy.where("l1 IS NOT NULL AND l2 IS NOT NULL").select("l1", "l2").distinct().orderBy("l1", "l2").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} subtopics")
    by: dict[str, list[str]] = {}
    for r in rows:
        by.setdefault(r.l1, []).append(r.l2)
    return "\n".join([intro, *(f"{a}: {', '.join(b)}" for a, b in by.items())])


def provider(config: dict, known: dict[str, Callable[[dict], Callable[[list[str]], list]]]) -> Callable[[list[str]], list]:
    """The provider that a configuration names, made from it; the local stand-in where it names none or says offline."""
    name = str(config.get("provider") or "local").lower()
    if name == "local" or config.get("offline"):
        return local_tag
    if name not in known:
        raise ValueError(f"no provider {name!r}; known are {', '.join(sorted(known))}")
    return known[name](config)


def once_per(df: DataFrame, column: str, call: Callable[[list[str]], list], name: str) -> DataFrame:
    """``df`` with ``name``: each distinct value is asked once, however many rows have it."""
    asked = df.where(F.col(column).isNotNull()).select(column).distinct().withColumn(name, answered(F.col(column), call))
    return df.join(asked, column, "left")


def local_tag(texts: list[str]) -> list[dict]:
    """The offline stand-in for a tagging model: the theme of the rules, and a weak fit."""
    return [{"fit": "weak", "words": len(t.split())} for t in texts]


def curated(pool: DataFrame, ids: list, key: str, want: int) -> DataFrame:
    """A model's picks that are in the pool, in its order, filled up from the pool by rank; ``pool(key, rank)``."""
    order = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col(key)) if ids else F.lit(0)
    picked = F.when(order > 0, order)
    return pool.withColumn("picked", picked).orderBy(F.col("picked").asc_nulls_last(), "rank").limit(want)
