"""Exact and vector duplicates of a batch of questions against a vault and itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from . import sets
from .lineage import cut


def exact_repeats(batch: DataFrame, key: Column, order: str, vault: DataFrame | None = None) -> DataFrame:
    """``batch`` with ``key_hash``, ``first_id`` and ``is_repeat``: a repeat has an equal key before it or in the vault.

    The key is hashed once: its hash and ``order`` alone are kept, in the shared folder, and the shared hashes come from these. First ids are aggregated
    map-side. Keys of one in a thousand rows or more - a thousand at most - come back by broadcast, so the rows of a hot key, such as all empty texts, stay where they are.
    """
    h = batch.withColumn("key_hash", key)
    slim = cut(h.select("key_hash", order))
    h = slim if set(h.columns) == {"key_hash", order} else h
    shared = cut(slim.groupBy("key_hash").agg(F.min(order).alias("first_id"), F.count("*").alias("__n")).where("__n > 1"))
    total = slim.count()
    hot = shared.where(F.col("__n") * 1000 >= total).select("key_hash", F.col("first_id").alias("__hot"))
    cold = shared.where(F.col("__n") * 1000 < total).select("key_hash", F.col("first_id").alias("__cold"))
    out = h.join(F.broadcast(hot), "key_hash", "left").join(cold, "key_hash", "left")
    out = out.withColumn("first_id", F.coalesce("__hot", "__cold", F.col(order))).drop("__hot", "__cold")
    repeat = F.col("first_id") != F.col(order)
    if vault is not None:
        seen = vault.select(F.col("key_hash"), F.lit(True).alias("__seen")).distinct()
        out = out.join(seen, "key_hash", "left")
        repeat = repeat | F.coalesce("__seen", F.lit(False))
    return out.withColumn("is_repeat", repeat).drop("__seen")


#: Rows of a block and queries of a chunk of a vector search, on average; clusters of either side at most. Every row goes to each chunk, so chunks are large;
#: so many queries of one are compared at once.
BLOCK, CHUNK, CLUSTERS, AT_ONCE = 4096, 16384, 1024, 1024
#: What rounding may take from an angle.
SLACK = 1e-6


def _units(lists) -> np.ndarray:
    x = np.stack(lists).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


#: Rings round a pivot at most; a row's cluster is its nearest pivot and the ring that its angle to it lies in.
RINGS = 64


def _clustered(df: DataFrame, pivots: np.ndarray, width: float) -> DataFrame:
    """``df`` with ``k``, the nearest pivot and the ring of that ``width`` of each vector, and ``far``, the angle to the pivot."""
    kind, vector = (df.schema[c].dataType.simpleString() for c in ("id", "embedding"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                sim = _units(pdf["embedding"].to_numpy()) @ pivots.T
                k = sim.argmax(1)
                far = np.arccos(np.clip(sim[np.arange(len(k)), k], -1, 1))
                yield pdf.assign(k=(k * RINGS + np.minimum(far // width, RINGS - 1)).astype(np.int32), far=far)

    return df.mapInPandas(run, f"id {kind}, embedding {vector}, k int, far double")


def _near_clusters(queries: DataFrame, base: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, dict[int, list[int]], dict[int, int], dict[int, int]]:
    """Both sides with their clusters, the base clusters that a query cluster must meet, and the rows of the clusters of either side.

    Pivots are rows of the base drawn by hash. The angles of two vectors to their pivots and that between the pivots bound their own angle from
    below (triangle inequality), so rings that leave no pair at the threshold never meet.
    """
    n = base.count()
    some = base.orderBy(F.xxhash64("id", F.lit(29)), "id").limit(int(min(CLUSTERS, max(1, round(n / BLOCK)) if threshold <= -1 else max(1, round(n / 16)))))
    picked = [r.embedding for r in some.select("embedding").collect()]
    if not picked:
        return queries.limit(0).withColumns({"k": F.lit(0), "far": F.lit(0.0)}), base.withColumns({"k": F.lit(0), "far": F.lit(0.0)}), {}, {}, {}
    pivots = _units(picked)
    most = np.pi if threshold <= -1 else float(np.arccos(min(1.0, threshold)))
    width = max(most, np.pi / RINGS)
    q, b = cut(_clustered(queries, pivots, width)), cut(_clustered(base, pivots, width))
    of = lambda df: {r.k: (r.lo, r.hi, r.n) for r in df.groupBy("k").agg(F.min("far").alias("lo"), F.max("far").alias("hi"), F.count("*").alias("n")).collect()}
    rq, rb = of(q), of(b)
    angle = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
    keys = np.array(sorted(rb), np.int64)
    low, high = (np.array([rb[k][x] for k in keys.tolist()]) for x in (0, 1))
    meets = {}
    for i, (lo, hi, _) in rq.items():
        between = angle[i // RINGS, keys // RINGS]
        least = np.maximum(np.maximum(between - hi - high, lo - between - high), low - between - hi)
        meets[i] = keys[least <= most + SLACK].tolist()
    nq, nb = ({k: n for k, (_, _, n) in r.items()} for r in (rq, rb))
    if sum(nq[i] * nb[j] for i, js in meets.items() for j in js) > 0.5 * sum(nq.values()) * sum(nb.values()):
        return q.withColumn("k", F.lit(0)), b.withColumn("k", F.lit(0)), {0: [0]}, {0: sum(nq.values())}, {0: sum(nb.values())}  # little is pruned: one cluster, dealt out evenly
    return q, b, meets, nq, nb


def neighbours(queries: DataFrame, base: DataFrame, threshold: float, top: int | None, earlier_only: bool = False) -> DataFrame:
    """(id, other, sim, rank): the ``top`` nearest base vectors of each query, or all of them, at a cosine of ``threshold`` or more.

    Both sides are clustered round pivots, large clusters are dealt into chunks of queries and blocks of rows, and each chunk meets the blocks of the clusters
    that can hold a row near enough: one unit of work, one matrix product, of which the ``top`` of each query go on. ``earlier_only`` compares a row
    with those of smaller id. Vectors that are null, empty, zero or of another length take no part. Without a threshold every chunk meets every block.
    """
    # Floats are dealt out as floats, in half the bytes, and compared as doubles.
    single = all(df.schema["embedding"].dataType.simpleString() == "array<float>" for df in (queries, base))
    vector = F.col("embedding") if single else F.col("embedding").cast("array<double>").alias("embedding")
    usable = lambda df: df.where(F.col("embedding").isNotNull() & (vectors.norm(F.col("embedding")) > 0)).select("id", vector)
    q_all, r_all, found = usable(queries), usable(base), None
    sizes = [r[0] for r in q_all.select(F.size("embedding")).distinct().collect()]
    for dims in sizes:
        own = lambda df: df.where(F.size("embedding") == dims)  # noqa: B023, E731
        q, r, meets, nq, nb = _near_clusters(own(q_all), own(r_all), threshold)
        parts = lambda n, most: max(1, round(n / most))
        # A cluster's blocks and chunks are numbered, and only pairs of clusters are listed.
        pairs = [(k, j, parts(nq[k], CHUNK), parts(nb[j], BLOCK)) for k, js in meets.items() for j in js]
        if not pairs:
            continue
        met = base.sparkSession.createDataFrame(pairs, "ck int, bk int, chunks int, blocks int")
        listed = lambda by: F.broadcast(met.groupBy(by).agg(F.collect_list(F.struct("ck", "bk", "chunks", "blocks")).alias("m")))
        deal = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
        numbers = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        asks = q.join(listed("ck"), F.col("k") == F.col("ck")).select("id", "embedding", F.explode("m").alias("m")).select("id", "embedding", "m.*")
        asks = asks.select("id", "embedding", F.lit(True).alias("asks"), "ck", "bk", deal(F.col("chunks")).alias("c"), numbers(F.col("blocks")).alias("b"))
        rows = r.join(listed("bk"), F.col("k") == F.col("bk")).select("id", "embedding", F.explode("m").alias("m")).select("id", "embedding", "m.*")
        rows = rows.select("id", "embedding", F.lit(False).alias("asks"), "ck", "bk", numbers(F.col("chunks")).alias("c"), deal(F.col("blocks")).alias("b"))
        both = asks.unionByName(rows)
        out = both.groupBy("ck", "bk", "c", "b").applyInPandas(lambda pdf: _block(pdf, threshold, top, earlier_only), "id long, other long, sim double")
        found = out if found is None else found.unionByName(out)
    if found is None:
        found = base.sparkSession.createDataFrame([], "id long, other long, sim double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "other")))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def _block(pdf: pd.DataFrame, threshold: float, top: int | None, earlier_only: bool) -> pd.DataFrame:
    a, b = pdf[pdf["asks"]], pdf[~pdf["asks"]]
    if not len(a) or not len(b):
        return pd.DataFrame({"id": [], "other": [], "sim": []}).astype({"id": "int64", "other": "int64", "sim": "float64"})
    left, right, ids, others = _units(a["embedding"].to_numpy()), _units(b["embedding"].to_numpy()).T, a["id"].to_numpy(), b["id"].to_numpy()
    out = []
    for at in range(0, len(ids), AT_ONCE):
        own, sim = ids[at: at + AT_ONCE], left[at: at + AT_ONCE] @ right
        ok = (sim >= threshold) & ((others[None] < own[:, None]) if earlier_only else (others[None] != own[:, None]))
        if top is not None and len(others) > top:
            kth = np.partition(np.where(ok, sim, -np.inf), -top, axis=1)[:, -top]
            ok &= sim >= kth[:, None]
        i, j = np.nonzero(ok)
        out.append(pd.DataFrame({"id": own[i], "other": others[j], "sim": sim[i, j]}))
    return pd.concat(out, ignore_index=True)


def flagged(batch: DataFrame, vault: DataFrame, threshold: float = vectors.THRESHOLD, top: int = 5) -> DataFrame:
    """(id, duplicate_status, duplicate_of_id, duplicate_similarity) of each row of ``batch``.

    A row meets its ``top`` nearest vault rows first, and only without a plausible one there
    the earlier rows of its batch; the most similar plausible row counts. Of these it gets the nearest few, and more only
    if all of them were implausible. Flagged rows stay, and stay comparable. Both sides have id, question, answer, embedding.
    """
    def plausible(near: DataFrame, base: DataFrame) -> DataFrame:
        q = batch.select("id", F.col("question").alias("q"), F.col("answer").alias("a"))
        o = base.select(F.col("id").alias("other"), F.col("question").alias("oq"), F.col("answer").alias("oa"))
        ok = near.join(q, "id").join(o, "other").where(vectors.plausible(F.col("q"), F.col("a"), F.col("oq"), F.col("oa"), F.col("sim"), threshold))
        return cut(ok.groupBy("id").agg(F.min_by(F.struct("other", "sim"), "rank").alias("hit")))

    done = plausible(neighbours(batch, vault, threshold, top), vault)
    open_, few = batch.join(done.select("id"), "id", "left_anti"), top
    while True:
        near = cut(neighbours(open_, batch, threshold, few, True))
        hits = plausible(near, batch)
        done = done.unionByName(hits)
        more = cut(near.where(F.col("rank") == few).select("id").join(hits.select("id"), "id", "left_anti"))
        if more.isEmpty():
            break
        open_, few = batch.join(more, "id", "left_semi"), 8 * few
    out = batch.select("id").join(done, "id", "left")
    hit = F.col("hit")
    return out.select("id", F.when(hit.isNotNull(), "POSSIBLE_DUPLICATE").otherwise("UNIQUE").alias("duplicate_status"), hit["other"].alias("duplicate_of_id"), F.round(hit["sim"], 3).alias("duplicate_similarity"))


#: Tokens that short sets meet by, and the tokens of a short set at most.
SHARED, SHORT = 3, 14


def _combined(items: Column, k: int) -> Column:
    """The lists of ``k`` of the items in their order; none where there are fewer."""
    if k == 1:
        return F.transform(items, lambda x: F.array(x))
    return F.flatten(F.transform(items, lambda x, i: F.transform(_combined(F.slice(items, i + 2, F.size(items)), k - 1), lambda rest: F.concat(F.array(x), rest))))


def near_pairs(docs: DataFrame, key: str, tokens: Column, threshold: float) -> DataFrame:
    """(a, b, sim): links of rows whose token sets have a Jaccard similarity above ``threshold``, by prefix filtering; ``key`` is an integer that tells rows apart.

    Equal sets fold into one class first, named by its smallest key: links run between classes, and from each class
    to its further rows with similarity 1, so n copies are n - 1 rows. Tokens are 64-bit hashes, ordered from rare to frequent. Sets
    above the threshold have ceil(t |x|) tokens in common or more, and of so many the first ``SHARED`` are among the first |x| - ceil(t |x|) + ``SHARED`` of
    either. So short sets join on ``SHARED`` tokens at once, which few sets share however often each token is there; those that may link with fewer in common
    meet by one of the first |x| - ceil(t |x|) + 1, among themselves. Pairs of larger sets come from ``sets.met``. The sets come in afterwards to be compared.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.sort_array(F.array_distinct(F.transform(tokens, lambda t: F.xxhash64(t)))).alias("toks"))
    rows = cut(rows.select("id", F.xxhash64("toks").alias("h1"), F.xxhash64("toks", F.lit(1)).alias("h2"), "toks")).where(F.size("toks") > 0)  # below it, the tokens would be made twice
    classes = rows.groupBy("h1", "h2").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = cut(rows.select(F.col("id").alias("b"), "h1", "h2").join(classes, ["h1", "h2"]).where("a <> b").select("a", "b"))
    short = rows.where(F.size("toks") <= int(SHORT / threshold)).groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("toks").alias("toks"))
    df = short.select(F.explode("toks").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    ordered = short.select("id", F.explode("toks").alias("t")).join(df, "t").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("s"))
    n = F.size("s")
    least = F.ceil(n * F.lit(threshold)).cast("int")
    first = lambda k: F.transform(F.slice("s", F.lit(1), n - least + k), lambda x: x["t"])
    prefix = ordered.select("id", n.alias("n"), F.explode(_combined(first(SHARED), SHARED)).alias("t")).where(F.size("t") == SHARED).select("id", "n", F.xxhash64("t").alias("t"))
    small = ordered.where(least < SHARED).select("id", n.alias("n"), F.explode(first(1)).alias("t"))

    def met(rows: DataFrame) -> DataFrame:
        a, b = (rows.select("t", F.col("id").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
        fits = (F.col("na") >= F.col("nb") * threshold) & (F.col("nb") >= F.col("na") * threshold) & (F.least("na", "nb") <= SHORT)
        return a.join(b, "t").where((F.col("a") < F.col("b")) & fits).select("a", "b")

    slim = rows.select("id", "toks")
    pairs = met(prefix).unionByName(met(small)).distinct().unionByName(sets.met(slim, sets.sorted_ids(copies.select("b")), threshold, SHORT))
    near = sets.compared(pairs, slim, threshold)
    kind = docs.schema[key].dataType
    return near.unionByName(copies.select("a", "b", F.lit(1.0).alias("sim"))).select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "sim")
