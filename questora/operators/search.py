"""Retrieval: a BM25 index as tables, hybrid search by reciprocal rank fusion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from .relational import relaxed

K1, B = 1.5, 0.75


@dataclass
class Index:
    """postings(doc, term, tf, dl), terms(term, df, idf) and the one-row stats(n, avgdl)."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame


def build(docs: DataFrame, key: str, bag: Column) -> Index:
    """Index of the token array ``bag``; statistics cover all rows, before any filter."""
    each = docs.select(F.col(key).alias("doc"), bag.alias("bag"))
    stats = each.agg(F.count("*").alias("n"), F.avg(F.size("bag")).alias("avgdl"))
    postings = each.select("doc", F.size("bag").alias("dl"), F.explode("bag").alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    terms = df.join(F.broadcast(stats)).select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    return Index(postings, terms, stats)


def bm25(index: Index, query: dict[str, float], k1: float = K1, b: float = B) -> DataFrame:
    """(doc, score) of all documents that share a term with the weighted query bag.

    The bag's few terms are pushed into both tables, so only their postings move.
    """
    if not query:
        return index.postings.select("doc", F.lit(0.0).alias("score")).limit(0)
    words = list(query)
    weight = F.element_at(F.create_map(*[x for k, v in query.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("term"))
    hits = index.postings.where(F.col("term").isin(words)).join(F.broadcast(index.terms.where(F.col("term").isin(words))), "term").join(F.broadcast(index.stats))
    tf, dl = F.col("tf"), F.col("dl")
    part = weight * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.col("avgdl")))
    return hits.groupBy("doc").agg(F.sum(part).alias("score"))


def scores(docs: DataFrame, key: str, bag: Column, query: dict[str, float], k1: float = K1, b: float = B) -> DataFrame:
    """(key, score) as ``bm25`` has it, without an index: for one query over a table that has none.

    Each row keeps its length and the counts of the query's words alone; only one row of sums is shuffled, and
    it comes back by broadcast. Rows that share no word are left out.
    """
    words = list(query)
    if not words:
        return docs.select(key, F.lit(0.0).alias("score")).limit(0)
    each = docs.select(key, bag.alias("__bag"))
    # The hits are bound once, so that no optimiser works them out anew for each word.
    hits = F.filter("__bag", lambda t: t.isin(words))
    counts = F.transform(F.array(hits), lambda h: F.transform(F.array(*[F.lit(w) for w in words]), lambda w: F.size(F.filter(h, lambda t: t == w))))[0]
    slim = each.select(key, F.size("__bag").alias("__dl"), counts.alias("__tf"))
    sums = slim.agg(F.count("*").alias("__n"), F.avg("__dl").alias("__avg"), *[F.count_if(F.col("__tf")[i] > 0).alias(f"__df{i}") for i in range(len(words))])
    rows = slim.where(F.exists("__tf", lambda n: n > 0)).join(F.broadcast(sums))
    score = F.lit(0.0)
    for i, (w, weight) in enumerate(query.items()):
        tf, df = F.col("__tf")[i], F.col(f"__df{i}")
        idf = F.log(1 + (F.col("__n") - df + 0.5) / (df + 0.5))
        score = score + F.lit(float(weight)) * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("__dl") / F.col("__avg")))
    return rows.select(key, score.alias("score"))


def expand(tokens: list[str], synonyms: dict[str, list[str]], weight: float = 0.4) -> dict[str, float]:
    """A query bag: words of the query weigh 1 each time, synonyms' words at most ``weight``."""
    bag: dict[str, float] = {}
    for t in tokens:
        bag[t] = bag.get(t, 0.0) + 1.0
    for t in tokens:
        for s in synonyms.get(t, []):
            for w in s.split():
                if w not in tokens:
                    bag[w] = max(bag.get(w, 0.0), weight)
    return bag


def lexical_score(text: Column, terms: list[str], difficulty: Column | None = None, wanted: str | None = None, overlap: Column | None = None) -> Column:
    """One per term in the text, half for the wanted difficulty, five per shared tag."""
    low = F.lower(F.coalesce(text, F.lit("")))
    s = sum((low.contains(t.lower()).cast("double") for t in terms), F.lit(0.0))
    if difficulty is not None and wanted:
        s = s + F.when(F.lower(difficulty) == wanted.lower(), 0.5).otherwise(0.0)
    return s if overlap is None else s + 5 * overlap


def hybrid(candidates: DataFrame, key: str, query_vector: list[float], lexical: Column, pool: int = 60, limit: int = 10, overlap: Column | None = None) -> DataFrame:
    """(key, sim, lex, rank_dense, rank_sparse, score): fusion of vector and lexical ranks over the ``pool`` nearest rows.

    The pool is a top-k of the scan, so both rankings see ``pool`` rows whatever the table.
    """
    q = F.array(*[F.lit(float(x)) for x in query_vector])
    extra = F.lit(0) if overlap is None else overlap
    near = candidates.select(key, vectors.cosine(F.col("embedding"), q).alias("sim"), lexical.alias("lex"), extra.alias("overlap")).orderBy(F.desc("sim"), key).limit(pool)
    rank = lambda c: F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(c), key))
    r = near.withColumns({"rank_dense": rank("sim"), "rank_sparse": rank("lex")})
    return r.withColumn("score", vectors.rrf(F.col("rank_dense"), F.col("rank_sparse"), F.col("overlap"))).orderBy(F.desc("score"), key).limit(limit).drop("overlap")


def hybrid_within(candidates: DataFrame, strict: Column, key: str, query_vector: list[float], lexical: Column, pool: int = 60, limit: int = 10, overlap: Column | None = None) -> DataFrame:
    """``hybrid`` over the candidates that meet a filter, or over all of them if none does; ``overlap`` counts the wanted tags that a row has."""
    return hybrid(relaxed(candidates, strict), key, query_vector, lexical, pool, limit, overlap)


def prompt_context(items: DataFrame, at: str, title: str, text: str) -> DataFrame:
    """One row: numbered source blocks of the items in order."""
    block = F.format_string("[SRC-%d] %s\n%s", F.col(at), F.col(title), F.col(text))
    return items.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(at).alias("p"), block.alias("b")))), lambda s: s["b"]), "\n\n").alias("context"))


def expanded_terms(query: Column, expansions: dict[str, list[str]]) -> Column:
    """The words of a query and of every expansion that it names, or whose name holds one of its words; sorted. A null query has no words."""
    low = F.lower(F.coalesce(query, F.lit("")))
    words = F.filter(F.split(F.regexp_replace(low, r"[^\p{L}\p{N}_\s]", " "), r"\s+"), lambda w: w != "")
    known = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*[F.lit(x) for x in v]).cast("array<string>").alias("v")) for k, v in expansions.items()]) if expansions else None
    if known is None:
        return F.array_sort(F.array_distinct(words))
    named = F.filter(known, lambda e: F.contains(low, e["k"]) | F.exists(words, lambda w: F.contains(e["k"], w)))
    return F.array_sort(F.array_distinct(F.concat(words, F.flatten(F.transform(named, lambda e: e["v"])))))
