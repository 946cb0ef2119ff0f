"""Exact top-k search by no-random-access aggregation over sorted lists.

Vectors are dealt into blocks. A block has one list per dimension, sorted by value. A query
with weight q_i reads list i from the end that helps it most, from there on in order, in growing
steps, the lists that the queries weigh most the deepest. A row's partial sum holds what was
read of it. Its lower bound adds the worst that each unread value can be, its upper bound what
the lists stand at. Reading stops once nobody outside the k best lower bounds can reach the
k-th; rows that are out for every query leave the sums. The rows still in question are resolved
to final scores and the block's k best per query go on.

Where few dimensions carry the scores the bounds stop early. Vectors whose components are all
alike leave no room between the bounds, and their lists are read to the end.

Query chunks meet row blocks in pairs, each pair one unit of work, so no task or driver holds
all queries or all rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block and queries of a chunk, on average.
BLOCK = 2048
CHUNK = 512


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, x): components as floor(scale * component), without unusable vectors.

    A vector that is null or empty, or holds a null or non-finite component, takes no part.
    """
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    ok = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.coalesce(bad, F.lit(True)) & F.col("vec_id").isNotNull()
    return vectors.where(ok).select("vec_id", F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("x"))


def nra(queries: np.ndarray, rows: np.ndarray, k: int, ids: np.ndarray, own: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each query its k best rows, by score, then id: (row numbers, scores, share of the lists' entries that was read).

    ``own`` ids are left out. The queries of a chunk read together, a step at a time, so a step is a few matrix
    products over the entries read in it: positive weights read lists from the top, negative ones from the bottom.
    """
    n, dims = rows.shape
    order = np.argsort(rows, axis=0, kind="stable")
    lists = np.take_along_axis(rows, order, axis=0)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(n)[:, None], axis=0)
    # The narrowest type that holds these sums exactly.
    most = 2 * dims * int(np.abs(rows).max()) * int(np.abs(queries).max())
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    never = np.iinfo(np.int64).min // 2 if kind is np.int64 else -np.inf
    values, best, worst = rows.astype(kind), lists[-1].astype(kind), lists[0].astype(kind)
    weight = np.abs(queries).sum(0) * (lists[-1] - lists[0])
    weight = weight / max(weight.max(), 1)
    out: list = [None] * len(queries)
    still, rest = np.arange(len(queries)), np.arange(n)
    up, down = np.maximum(queries, 0).astype(kind), np.minimum(queries, 0).astype(kind)
    live = ids[None] != own[:, None]
    known = np.zeros((len(queries), n), kind)  # partial sums of what was read
    low = (up @ worst + down @ best)[:, None] + known
    depth, base = np.zeros(dims, np.int64), max(4 * k, n // 16)
    while len(still):
        to = np.maximum(depth, np.minimum(n, np.ceil(base * np.maximum(weight, 0.25)).astype(np.int64)) if base < n else n)
        x, at = values[rest], place[rest]
        new_top, new_bottom = (at >= n - to) & (at < n - depth), (at < to) & (at >= depth)
        known += up @ np.where(new_top, x, 0).T + down @ np.where(new_bottom, x, 0).T
        low += up @ np.where(new_top, x - worst, 0).T + down @ np.where(new_bottom, x - best, 0).T
        depth, line = to, np.arange(dims)
        head, foot = lists[np.maximum(n - depth, 0), line].astype(kind), lists[np.maximum(depth - 1, 0), line].astype(kind)
        # An unread value is no better than where its list stands.
        high = known + up @ np.where(at < n - depth, head, 0).T + down @ np.where(at >= depth, foot, 0).T
        bound = np.where(live, low, never)
        if len(rest) > k:
            # A row whose upper bound is below the k-th lower bound is out for good.
            live &= high >= np.partition(bound, len(rest) - k, axis=1)[:, len(rest) - k][:, None]
        done = (live.sum(1) <= 4 * k) | (depth >= n).all()
        for i in np.flatnonzero(done):
            left, q = rest[live[i]], still[i]
            score = rows[left] @ queries[q]
            first = np.lexsort((ids[left], -score))[:k]
            out[q] = (left[first], score[first], float(depth.sum() / (n * dims)))
        stay = ~done
        still, up, down = still[stay], up[stay], down[stay]
        wanted = live[stay].any(0)
        live, known, low, rest = live[stay][:, wanted], known[stay][:, wanted], low[stay][:, wanted], rest[wanted]
        base *= 4
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 5, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score, read): the k highest integer inner products of each query.

    ``read`` is the share of its block's list entries that was read before the row's place was certain.

    Queries are the rows where ``is_query`` holds, candidates every row but the query's own id;
    ties go to the smaller vec_id. Vectors of another length than the query's are no candidates.
    Rows of one vec_id are candidates each, in no fixed order among themselves. Fewer than k
    candidates give fewer rows, an empty table none.
    """
    usable = quantised(vectors).withColumn("dims", F.size("x"))
    n, m = usable.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    blocks, chunks = max(1, round(n / block)), max(1, round(m / chunk))
    numbers = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    h = F.xxhash64("vec_id")
    side = usable.select("dims", "vec_id", "x", F.lit(False).alias("asks"), F.pmod(h, F.lit(blocks)).cast("int").alias("b"), numbers(chunks).alias("c"))
    asks = usable.where(is_query).select("dims", "vec_id", "x", F.lit(True).alias("asks"), numbers(blocks).alias("b"), F.pmod(h, F.lit(chunks)).cast("int").alias("c"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        q, r = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        if not len(q) or not len(r):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64").assign(read=0.0)
        ids = r["vec_id"].to_numpy()
        found = nra(np.stack(q["x"].to_numpy()).astype(np.int64), np.stack(r["x"].to_numpy()).astype(np.int64), k, ids, q["vec_id"].to_numpy())
        return pd.DataFrame({
            "query_id": np.repeat(q["vec_id"].to_numpy(), [len(f[0]) for f in found]),
            "vec_id": ids[np.concatenate([f[0] for f in found])], "score": np.concatenate([f[1] for f in found]),
            "read": np.repeat([f[2] for f in found], [len(f[0]) for f in found]),
        })

    part = asks.unionByName(side).groupBy("dims", "b", "c").applyInPandas(work, "query_id long, vec_id long, score long, read double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "read")
