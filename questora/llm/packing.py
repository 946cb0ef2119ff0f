"""Packing into optimal length buckets.

One histogram of lengths, at most ``max_len`` rows however large the corpus, goes to the
driver; dynamic programming over it chooses the bucket boundaries of least padding. Batches
of one token budget then form inside each bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, word_count

MAX_LEN = 2048
BUCKETS = 8
TOKEN_BUDGET = 16_384
#: Shards of a bucket that are numbered side by side, more where there would be over so many rows in each.
SHARDS, SHARD_ROWS = 256, 100_000


def boundaries(hist: dict[int, int], buckets: int) -> list[int]:
    """At most ``buckets`` upper lengths, the last the longest, of least total padding.

    Each length pads up to the next boundary. best[k][j] is the least padding of the first j
    distinct lengths in k buckets; the last bucket covers the lengths from i to j.
    """
    lengths = np.array(sorted(hist), np.int64)
    if not len(lengths):
        return []
    count = np.array([hist[int(n)] for n in lengths], np.float64)
    rows = np.concatenate([[0], np.cumsum(count)])
    tokens = np.concatenate([[0], np.cumsum(count * lengths)])
    n, k_max = len(lengths), min(buckets, len(lengths))
    best = np.full(n + 1, np.inf)
    best[0] = 0
    back = np.zeros((k_max, n + 1), np.int64)
    for k in range(k_max):
        new = np.full(n + 1, np.inf)
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            back[k, j] = np.argmin(cost)
            new[j] = cost[back[k, j]]
        best = new
    out, j = [], n
    for k in reversed(range(k_max)):
        out.append(int(lengths[j - 1]))
        j = back[k, j]
        if j == 0:
            break
    return out[::-1]


def sequences(docs: DataFrame, max_len: int = MAX_LEN, n_tokens: Column | None = None) -> DataFrame:
    """(doc_id, seq, start, n_tokens): every document in pieces of at most ``max_len`` tokens.

    A document longer than the model's context is cut into full pieces and a rest, none of it
    dropped; one without tokens, or of a null count, is a piece of none. Tokens are words unless counted otherwise.
    """
    total = word_count(F.col("text")) if n_tokens is None else n_tokens
    base = docs.select("doc_id", F.coalesce(total, F.lit(0)).alias("n_all"))
    pieces = F.greatest(F.ceil(F.col("n_all") / max_len), F.lit(1)).cast("int")
    each = base.select("doc_id", "n_all", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("seq"))
    start = F.col("seq").cast("long") * max_len
    return each.select("doc_id", "seq", start.alias("start"), F.least(F.col("n_all") - start, F.lit(max_len)).cast("long").alias("n_tokens"))


def pack(docs: DataFrame, max_len: int = MAX_LEN, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, n_tokens: Column | None = None) -> DataFrame:
    """(doc_id, seq, start, n_tokens, bucket_len, batch_id, slot), one row per piece.

    ``bucket_len`` is the length a piece is padded to; a batch holds
    floor(token_budget / bucket_len) pieces, at least one, of one bucket, so only the last
    batch of a bucket can be short. Pieces are numbered in the order of a hash, in shards whose
    offsets are sums of one count each; there are ``SHARDS``, and more where a shard would have over ``SHARD_ROWS`` rows. Rows of equal doc_id each get a slot. An
    empty table gives no rows.
    """
    seqs = cut(sequences(docs, max_len, n_tokens))
    hist = {r["n_tokens"]: r["n"] for r in seqs.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # at most max_len + 1 rows
    bounds = boundaries(hist, buckets)
    if not bounds:
        return seqs.select("*", F.lit(0).cast("long").alias("bucket_len"), F.lit("").alias("batch_id"), F.lit(0).alias("slot"))
    bucket = F.array_min(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b >= F.col("n_tokens")))
    shards = max(SHARDS, sum(hist.values()) // SHARD_ROWS)
    dealt = seqs.withColumn("bucket_len", bucket).withColumn("h", F.xxhash64("doc_id", "seq")).withColumn("shard", F.pmod(F.col("h"), F.lit(shards)))
    sums = dealt.groupBy("bucket_len", "shard").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("bucket_len").orderBy("shard")
    offsets = sums.select("bucket_len", "shard", (F.sum("n").over(upto) - F.col("n")).alias("before"))
    here = F.row_number().over(Window.partitionBy("bucket_len", "shard").orderBy("h", "doc_id", "seq")) - 1
    at = F.col("before") + F.col("here")
    room = F.greatest(F.floor(F.lit(token_budget) / F.greatest("bucket_len", F.lit(1))), F.lit(1))
    return dealt.withColumn("here", here).join(F.broadcast(offsets), ["bucket_len", "shard"]).select(
        "doc_id", "seq", "start", "n_tokens", "bucket_len",
        F.concat_ws("-", F.col("bucket_len"), F.floor(at / room)).alias("batch_id"), (at % room).cast("int").alias("slot"),
    )
