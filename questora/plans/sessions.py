"""Queries over requests: conversations and events as what users ask for, one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import providers, text
from ..operators import fuzzy, requests
from .registry import query, table


@query(None)
def request_bags(spark: SparkSession, sf: str) -> DataFrame:
    """Bags of every user turn; benchmark words are keys that bring the word behind them along, and parts' names are keys of two words."""
    turns = table(spark, sf, "conversations").where("role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("request"), "text")
    words = table(spark, sf, "benchmark").select(text.tokens(F.col("text")).alias("w"))
    pairs = words.select(F.explode(F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("key"), b.alias("next")))).alias("p"))
    related = pairs.select("p.key", F.array("p.next").alias("words"))
    names = table(spark, sf, "part").select(F.col("p_name").alias("key"), F.split("p_name", " ").alias("words")).distinct()
    return fuzzy.bags(turns, "request", F.col("text"), related.unionByName(names))


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as a model's answers: its names with a letter too few, too many or in another case, and some that nobody knows."""
    k = F.col("p_partkey")
    at = (k % F.length("p_name")).cast("int")
    short = F.concat(F.substring(F.col("p_name"), F.lit(1), at), F.substring(F.col("p_name"), at + 2, F.length("p_name")))
    l2 = F.when(k % 4 == 0, short).when(k % 4 == 1, F.concat(F.lit(" "), F.upper("p_name"))).when(k % 4 == 2, F.concat("p_name", F.lit("s"))).otherwise(F.reverse("p_name"))
    l1 = F.when(k % 3 == 0, F.concat(F.lower("p_type"), F.lit("x"))).when(k % 3 == 1, F.substring("p_type", 2, 20)).otherwise("Nowhere")
    return table(spark, sf, "part").select("p_partkey", F.array(l1).alias("l1s"), F.when(k % 11 > 0, F.array(l2, F.col("p_name"), F.reverse("p_type"))).alias("l2s"))


def taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(F.initcap("p_type").alias("l1"), F.initcap("p_name").alias("l2")).where("l2 IS NOT NULL").groupBy("l2").agg(F.max("l1").alias("l1"))


@query(None)
def snapped_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Topics and subtopics of answers as known names, and what was dropped."""
    out = fuzzy.topics(answers(spark, sf), "p_partkey", "l1s", "l2s", taxonomy(spark, sf))
    return out.select("p_partkey", *[F.array_join(c, "|").alias(c) for c in ("l1s", "l2s", "dropped")])


#: Requests that events stand for, by their id; {n} is a number and {t} a topic.
PROMPTS = [
    "{n} questions about {t}", "{n} more", "double it", "halve it", "make it harder", "cut it down to {n}", "{n} fewer please", "for school", "quiz on {t} in mumbai", "no images",
    "replace question {n} with {t}", "change {n} questions to {t} and keep the rest", "replace {t} with gold", "add two {t} questions", "remove slot {n}", "evergreen", "delhi and whatever you have", "0 questions",
    "three indian questions for a corporate offsite", "text only, easy",
]


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a request of its user, in the order of time."""
    e = table(spark, sf, "events")
    said = F.get(F.array(*[F.lit(p) for p in PROMPTS]), (F.pmod(F.xxhash64("event_id"), F.lit(len(PROMPTS)))).cast("int"))
    return e.select("user_id", "event_id", F.replace(F.replace(said, F.lit("{n}"), (1 + F.floor("value") % 12).cast("string")), F.lit("{t}"), F.col("event_type")).alias("prompt"))


@query(None)
def session_briefs(spark: SparkSession, sf: str) -> DataFrame:
    """What every request of every session comes to, after those before it."""
    return requests.briefs(prompts(spark, sf), "user_id", ["event_id"], F.col("prompt"))


@query("""WITH s AS (SELECT o_custkey AS q, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS slot, o_orderstatus = 'F' AS locked, o_orderpriority LIKE '1%' AS excluded FROM orders),
    t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY CASE WHEN locked THEN 2 WHEN excluded THEN 0 ELSE 1 END, CASE WHEN NOT locked AND NOT excluded THEN -slot ELSE slot END) <= q % 5 AND q % 3 > 0 AS go FROM s),
    n AS (SELECT *, CASE WHEN go THEN sum(go::INT) OVER (PARTITION BY q ORDER BY slot) END AS nth FROM t) SELECT q, slot, CASE WHEN nth <= 2 THEN -nth ELSE id END::BIGINT AS id, locked, coalesce(nth <= 2, false) AS replaced FROM n""")
def parts_replaced(spark: SparkSession, sf: str) -> DataFrame:
    """Customers stand for sets, their orders for the slots; some slots of each are filled anew, two at most."""
    from pyspark.sql import Window

    o = table(spark, sf, "orders")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    slots = o.select(F.col("o_custkey").alias("q"), place.alias("slot"), F.col("o_orderkey").cast("long").alias("id"), (F.col("o_orderstatus") == "F").alias("locked"), F.col("o_orderpriority").startswith("1").alias("excluded"))
    sets = o.select(F.col("o_custkey").alias("q")).distinct()
    fills = sets.select("q", F.explode(F.array(F.lit(1), F.lit(2))).alias("pos")).withColumn("id", (-F.col("pos")).cast("long"))
    return requests.replaced_in_part(slots, sets.where("q % 3 > 0").withColumn("n", F.col("q") % 5), fills, "q")


def stand_in(system: str, items: list[dict]) -> list[dict]:
    """An offline model: the words of a text; it never answers for one with the word license, and for one at a time in a full chunk not at once."""
    busy = len(items) == providers.CHUNK
    return [{"n": i["n"], "words": len(i["text"].split()), "known": len(system.splitlines()) - 1} for k, i in enumerate(items) if "license" not in i["text"].lower() and not (busy and k == 3)]


@query(r"""WITH t AS (SELECT count(DISTINCT lang) AS k FROM documents WHERE trim(lang) <> '' AND trim(source) <> '') SELECT doc_id, CASE WHEN asks AND NOT hit THEN '{"known": ' || k || ', "words": ' || len(regexp_extract_all(text, '[^\s\x0B\x1C-\x1F\x{85}\x{A0}\p{Z}]+')) || '}' END AS answer,
    CASE WHEN asks AND NOT hit THEN 'answered' ELSE 'draft' END AS status, CASE WHEN NOT asks THEN 'nothing to ask' WHEN hit THEN 'no answer' END AS note
    FROM (SELECT *, regexp_matches(coalesce(text, ''), '\S') AS asks, contains(lower(coalesce(text, '')), 'license') AS hit FROM documents), t""")
def model_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Every text put to a model in chunks, several in flight; what it leaves out is asked again and ends as a draft."""
    d = table(spark, sf, "documents")
    live = d.select(F.trim("lang").alias("l1"), F.trim("source").alias("l2")).where("l1 <> '' AND l2 <> ''")
    return providers.asked(d, "doc_id", F.col("text"), stand_in, providers.vocabulary_prompt(live, "Topics and subtopics:"))
