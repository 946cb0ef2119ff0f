"""Queries over the vault: formats, keyword tags, reviews and the next state of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, keywords, text
from ..operators import vault
from .bank import TOKS
from .registry import query, table


def _any(column: str, patterns: list[str]) -> str:
    return " OR ".join(f"regexp_matches({column}, '{p}')" for p in patterns)


_FORMAT_SQL = f"""CASE WHEN {_any('q', formats.STEPPED_QA)} OR {_any('a', formats.STEPPED_QA)} OR len(regexp_extract_all(q, '{formats.STEPPED_PART}')) >= 2 THEN 'STEPPED_CLUE'
    WHEN (n BETWEEN 3 AND 5 AND length(trim(a)) < 80 AND (length(trim(q)) < 100 OR n >= 4)) OR {_any('a', formats.CONNECT_A)} OR {_any('q', formats.CONNECT_Q)} THEN 'CONNECT_4'
    WHEN {_any('q', formats.ARRANGE_Q)} OR {_any('a', formats.ARRANGE_A)} THEN 'ARRANGE_ORDER' WHEN regexp_matches(r, '{formats.STEPPED_R}') THEN 'STEPPED_CLUE'
    WHEN regexp_matches(r, '{formats.CONNECT_R}') THEN 'CONNECT_4' WHEN regexp_matches(r, '{formats.ARRANGE_R}') THEN 'ARRANGE_ORDER' ELSE 'STANDARD_QA' END"""


@query(f"SELECT doc_id, {_FORMAT_SQL} AS format FROM (SELECT doc_id, coalesce(text, '') AS q, source AS a, lang AS r, doc_id % 6 AS n FROM documents)")
def question_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Formats of documents as questions; doc_id mod 6 stands for the number of pictures."""
    images = F.array_repeat(F.lit("x"), (F.col("doc_id") % 6).cast("int"))
    return table(spark, sf, "documents").select("doc_id", formats.question_format(F.col("text"), F.col("source"), images, F.col("lang")).alias("format"))


@query(f"""SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN p || 'VIDEO' WHEN turn % 3 = 2 THEN p || 'IMAGE' WHEN turn % 2 = 1 THEN p || 'AUDIO' ELSE 'TEXT' END AS answer_type,
    CASE WHEN turn % 5 = 4 THEN 'VIDEO' WHEN turn % 2 = 1 THEN 'AUDIO' WHEN turn % 3 = 2 THEN 'IMAGE' ELSE 'NONE' END AS clue_media
    FROM (SELECT *, CASE WHEN trim(coalesce(text, '')) <> '' AND NOT regexp_matches(trim(text), '{formats.POINTER}') THEN 'TEXT_' ELSE '' END AS p FROM conversations)""")
def answer_types(spark: SparkSession, sf: str) -> DataFrame:
    some = lambda n: F.when(F.col("turn") % n == n - 1, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    media = some(3), some(2), some(5)
    return table(spark, sf, "conversations").select("conv_id", "turn", formats.answer_type(F.col("text"), *media).alias("answer_type"), formats.clue_media(*media).alias("clue_media"))


@query(f"""SELECT doc_id, CASE WHEN regexp_matches(text, '{formats.SCHOOL}') AND NOT regexp_matches(text, '{formats.COLLEGE}') THEN 'School' WHEN regexp_matches(text, '{formats.CORPORATE}') AND NOT regexp_matches(text, '{formats.COLLEGE}') THEN 'Corporate'
    WHEN regexp_matches(text, '{formats.COLLEGE}') THEN 'College' END AS audience FROM documents""")
def audience_class(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", formats.audience(F.col("text")).alias("audience"))


#: Keywords of the test tables' invented words, in place of real topics.
_TOPICS = {"Latin": ["le", "la", "de", "en", "el", "os"], "Germanic": ["the", "in", "on", "der", "an", "er"], "Legal": ["license", "terms", "rights", "use"], "Trade": ["email", "contact", "phone", "price"]}


def _topic_score(words: list[str]) -> str:
    has = lambda c, w: f"CASE WHEN regexp_matches(lower(coalesce({c}, '')), '(?:^|[^\\p{{L}}\\p{{N}}_])(?:{w})(?:$|[^\\p{{L}}\\p{{N}}_])') THEN 1 ELSE 0 END"
    count = lambda c: "(" + " + ".join(has(c, w) for w in words) + ")"
    return f"CAST({count('text')} * {keywords.POINTS['question']} + {count('source')} * {keywords.POINTS['title']} AS DOUBLE)"


_TOPIC_ROWS = " UNION ALL ".join(f"SELECT rid, {n} AS n, '{t}' AS topic, {_topic_score(w)} AS score FROM d" for n, (t, w) in enumerate(_TOPICS.items()))


@query(f"""WITH d AS (SELECT row_number() OVER () AS rid, * FROM documents), s AS ({_TOPIC_ROWS}),
    r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, n) AS k, max(score) OVER (PARTITION BY rid) AS best FROM s WHERE score > 0),
    g AS (SELECT rid, max(topic) FILTER (k = 1) AS prim, string_agg(topic, '|' ORDER BY k) FILTER (score >= {keywords.KEEP} OR score >= best * {keywords.KEEP_SHARE}::DOUBLE) AS topics, max(topic) FILTER (k = 2 AND score >= {keywords.SECOND}) AS subtopic,
        max(best) >= 5 AND coalesce(max(score) FILTER (k = 2) / max(best) <= 0.65::DOUBLE, true) AS confident FROM r GROUP BY rid)
    SELECT doc_id, coalesce(prim, 'General Knowledge') AS "primary", coalesce(topics, 'General Knowledge') AS topics, subtopic, coalesce(confident, false) AS confident FROM d LEFT JOIN g USING (rid)""")
def keyword_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Topics, subtopic and sureness by weighted keywords."""
    s = table(spark, sf, "documents").select("doc_id", keywords.topic_scores({"question": F.col("text"), "title": F.col("source")}, _TOPICS).alias("s"))
    out = s.select("doc_id", keywords.chosen_topics(F.col("s")).alias("c"), keywords.confident(F.col("s"), 5.0).alias("confident"))
    return out.select("doc_id", "c.primary", F.array_join("c.topics", "|").alias("topics"), "c.subtopic", "confident")


_HOOK_SQL = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{name}'" for name, p in keywords.HOOKS) + " ELSE 'DIRECT_TRIVIA' END"


@query(f"""WITH h AS (SELECT doc_id, t, text, {_HOOK_SQL} AS hook FROM (SELECT doc_id, coalesce(text, '') AS text, lower(coalesce(text, '')) AS t FROM documents))
    SELECT doc_id, hook, CAST(least(10, 6 + CASE hook WHEN 'DIRECT_TRIVIA' THEN 0 WHEN 'VISUAL_CLUE' THEN 1 ELSE 2 END + CASE WHEN len(regexp_extract_all(text, '[^\\t\\n\\x0B\\f\\r ]+')) > 25 THEN 1 ELSE 0 END
    + CASE WHEN regexp_matches(t, '{keywords.CURIOUS}') THEN 1 ELSE 0 END) AS INTEGER) AS curiosity, CASE WHEN regexp_matches(t, '{keywords.PASSING}') THEN 'TIME_SENSITIVE' ELSE 'EVERGREEN' END AS nature FROM h""")
def hook_and_curiosity(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    d = table(spark, sf, "documents").withColumn("hook", keywords.hook(t))
    return d.select("doc_id", "hook", keywords.curiosity(t, t, F.col("hook")).alias("curiosity"), keywords.temporal_nature(t, F.lit("")).alias("nature"))


_PHRASE = r"\b([A-Z][a-zA-Z]+(?:\s+(?:(?:of|the|and|de|von|la)\s+)?[A-Z][a-zA-Z]+)+)\b"


@query(f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F\\P{{L}}]', '_', 'g') AS a FROM documents),
    f AS (SELECT doc_id, regexp_extract_all(a, '{_PHRASE}', 1) AS ph, list_filter(list_transform(regexp_extract_all(x, '[''"]([^''"]{{3,40}})[''"]', 1), lambda q: trim(q)), lambda q: NOT regexp_matches(lower(q), 'click here|read more')) AS qu,
      regexp_extract_all(a, '\\b([A-Z][a-z]{{3,}})\\b', 1) AS si FROM t),
    u AS (SELECT doc_id, list_distinct(list_concat(list_filter(ph, lambda p: length(p) > 4), qu, list_filter(si, lambda s: NOT list_contains([{', '.join(f"'{w}'" for w in keywords.NO_ENTITY)}], lower(s)) AND len(list_filter(ph, lambda p: contains(p, s))) = 0))) AS e FROM f),
    w AS (SELECT doc_id, list_sort(list_transform(e, lambda x: {{'w': -len(regexp_split_to_array(trim(x), '\\s+')), 'l': -length(x), 'e': x}})) AS r FROM u)
    SELECT doc_id, array_to_string(list_transform(list_filter(r, lambda x: x.w >= -5)[:6], lambda x: x.e), '|') AS entities FROM w""")
def named_entities(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(keywords.entities(F.coalesce("text", F.lit(""))), "|").alias("entities"))


@query(f"""SELECT doc_id, source FROM documents WHERE (coalesce(text, '') ILIKE '%license%' OR coalesce(source, '') ILIKE '%license%' OR coalesce(lang, '') ILIKE '%license%')
    AND NOT ({' OR '.join(f"coalesce(text, '') ILIKE '%{p}%'" for p in vault.VISUAL)})""")
def vault_search(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.where(vault.says("license", [F.col("text"), F.col("source")], [F.array("lang")]) & vault.without_visuals(F.col("text"), [])).select("doc_id", "source")


_GOOD = "(event_type = 'purchase' AND (user_id % 7 = 0 OR value > 90)) OR (user_id % 11 <> 0 AND (event_type = 'purchase' OR (event_type = 'view' AND value / 100 >= 0.65)))"


@query(f"SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND ({_GOOD}))")
def tag_review_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Customers stand for questions, events for their tags."""
    e, u = table(spark, sf, "events").withColumn("c_custkey", F.col("user_id")), F.col("user_id")
    good = vault.well_tagged(
        F.when(F.col("event_type") == "purchase", "confirmed").otherwise("draft"), F.when(u % 7 == 0, "HUMAN").otherwise("LLM"), F.when(F.col("value") > 90, "x"),
        F.when(u % 11 == 0, "Unknown").otherwise("x"), F.when(F.col("event_type") == "view", "good").otherwise("weak"), F.col("value") / 100, F.lit(None).cast("string"),
    )
    return vault.to_review(table(spark, sf, "customer").select("c_custkey"), e, "c_custkey", good)


@query(f"""WITH r AS (SELECT coalesce(contains(lower(source), 'src1'), false) AS t, len(list_filter(list_distinct({TOKS}), lambda w: contains(w, 'tion') OR contains('tion', w) OR contains(w, 'eru') OR contains('eru', w))) > 0 AS g,
    CASE WHEN n_chars > 3000 THEN 'Hard' WHEN n_chars < 1000 THEN 'Easy' ELSE 'Medium' END AS d FROM documents)
    SELECT count(*) FILTER (t AND g) AS exact, count(*) FILTER (g AND NOT t) AS cross_topic, count(*) FILTER (t AND NOT g) AS topic_only, count(*) FILTER (g) AS total, count(*) FILTER (g AND d = 'Easy') AS n_easy,
    count(*) FILTER (g AND d = 'Medium') AS n_medium, count(*) FILTER (g AND d = 'Hard') AS n_hard, CASE WHEN count(*) FILTER (g) >= 5 THEN 'HISTORICAL' ELSE 'NEW' END AS mode
    FROM (SELECT r.t, coalesce(g, false) AS g, d FROM r)""")
def tag_preview(spark: SparkSession, sf: str) -> DataFrame:
    level = F.when(F.col("n_chars") > 3000, "Hard").when(F.col("n_chars") < 1000, "Easy")
    return vault.tag_preview(table(spark, sf, "documents"), F.col("source"), F.array_distinct(text.tokens(F.col("text"))), level, "src1", ["#tion", " Eru "])


_PATHS_SQL = """WITH p AS (SELECT p_size AS q, p_partkey AS pos, p_type AS l1, CASE WHEN p_partkey % 3 > 0 THEN substr(p_brand, 1, 7) END AS l2, p_name FROM part),
    f AS (SELECT q, l1, l2, min(pos) AS pos FROM p GROUP BY q, l1, l2),
    w AS (SELECT q, l1, l2, w, min(pos * 100 + j) AS pos FROM (SELECT q, l1, l2, pos, unnest(string_split(p_name, ' ')) AS w, unnest(range(0, len(string_split(p_name, ' ')))) AS j FROM p) GROUP BY q, l1, l2, w),
    k AS (SELECT q, l1, l2, array_to_string((list(w ORDER BY pos))[:12], '|') AS keywords FROM w GROUP BY q, l1, l2),
    r AS (SELECT f.*, keywords, row_number() OVER (PARTITION BY f.q ORDER BY pos) - 1 AS position FROM f JOIN k ON f.q = k.q AND f.l1 = k.l1 AND f.l2 IS NOT DISTINCT FROM k.l2)
    SELECT q, CAST(position AS INTEGER) AS position, l1, l2, keywords FROM r WHERE position < 6"""


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    l2 = F.when(F.col("p_partkey") % 3 > 0, F.substring("p_brand", 1, 7))
    spelled = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("#"), "p_name")).otherwise(F.col("p_name"))
    return vault.merged_paths(p.select(F.col("p_size").alias("q"), F.col("p_partkey").alias("at"), F.col("p_type").alias("l1"), l2.alias("l2"), F.split(spelled, " ").alias("keywords")), "q", "at")


@query(_PATHS_SQL)
def topic_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of one size stand for the paths of one question."""
    return _paths(spark, sf).withColumn("keywords", F.array_join("keywords", "|"))


@query(f"""SELECT q, arg_min(l1, position) AS topic, arg_min({{'x': l2}}, position)['x'] AS subtopic, count(DISTINCT l1) AS n_topics FROM ({_PATHS_SQL}) GROUP BY q""")
def flat_tags(spark: SparkSession, sf: str) -> DataFrame:
    return vault.flat_tags(_paths(spark, sf), "q").select("q", "topic", "subtopic", F.size("topics").cast("long").alias("n_topics"))


@query("""WITH v AS (SELECT o_orderkey, o_orderpriority AS deck FROM orders), f AS (SELECT DISTINCT l_orderkey AS o_orderkey, l_shipmode AS deck, l_linenumber FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN '1-URGENT' ELSE '5-LOW' END AS l_shipmode FROM lineitem)),
    n AS (SELECT v.o_orderkey, count(*) AS n, array_to_string(list_sort(list(DISTINCT f.deck)), '|') AS decks FROM v JOIN f ON v.o_orderkey = f.o_orderkey AND v.deck <> f.deck GROUP BY 1)
    SELECT o_orderkey, CAST(1 + coalesce(n, 0) AS BIGINT) AS occurrence_count, coalesce(decks, '') AS provenance FROM v LEFT JOIN n USING (o_orderkey)""")
def repeats_found_again(spark: SparkSession, sf: str) -> DataFrame:
    """Orders stand for questions, lines for their finds in decks."""
    v = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("deck"), F.lit(1).cast("long").alias("occurrence_count"), F.array().cast("array<string>").alias("provenance"))
    deck = F.when(F.col("l_returnflag") == "R", "1-URGENT").otherwise("5-LOW")
    f = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), deck.alias("deck"), F.col("l_linenumber").alias("number"))
    return vault.with_repeats(v, f, "o_orderkey", "deck").select("o_orderkey", "occurrence_count", F.array_join("provenance", "|").alias("provenance"))


@query("""WITH q AS (SELECT o_orderkey AS id, o_orderkey - 1 AS original, o_orderpriority AS deck, CASE o_orderstatus WHEN 'F' THEN 'MERGE' WHEN 'O' THEN 'RESOLVE' END AS action FROM orders)
    SELECT q.id, CASE WHEN q.action = 'MERGE' THEN 'CONFIRMED_DUPLICATE' WHEN q.action = 'RESOLVE' THEN 'RESOLVED' ELSE 'POSSIBLE_DUPLICATE' END AS duplicate_status FROM q LEFT JOIN q o ON q.original = o.id
    WHERE NOT (coalesce(q.action = 'MERGE', false) AND o.id IS NOT NULL AND q.deck <> o.deck)""")
def duplicates_resolved(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") - 1).alias("original"), F.col("o_orderpriority").alias("deck"), F.lit("POSSIBLE_DUPLICATE").alias("duplicate_status"), "o_orderstatus")
    d = o.select("id", F.when(F.col("o_orderstatus") == "F", "merge").when(F.col("o_orderstatus") == "O", "resolve").alias("action"))
    return vault.resolved(o, d, "id", "original", "deck").select("id", "duplicate_status")


@query("""WITH g AS (SELECT p_partkey, p_type, p_brand, split_part(p_name, ' ', 1) AS alt, CASE p_partkey % 4 WHEN 0 THEN 'UPDATE_GOLD' WHEN 1 THEN 'ADD_ALT' WHEN 2 THEN 'KEEP_GOLD' END AS d, split_part(p_name, ' ', 1 + p_partkey % 2) AS p FROM part)
    SELECT p_partkey, CASE WHEN d = 'UPDATE_GOLD' AND p IN ('red', 'blue') THEN 'Colour' ELSE p_type END AS gold_l1, CASE WHEN d = 'UPDATE_GOLD' THEN p ELSE p_brand END AS gold_l2,
    CASE WHEN d = 'ADD_ALT' AND p <> alt THEN alt || '|' || p ELSE alt END AS alt_l2, CASE WHEN d IS NULL THEN 'OPEN' ELSE 'VERIFIED' END AS label_status, CASE WHEN d IS NOT NULL THEN p_brand END AS changed_from FROM g""")
def gold_decisions(spark: SparkSession, sf: str) -> DataFrame:
    p, k, name = table(spark, sf, "part"), F.col("p_partkey"), F.split("p_name", " ")
    gold = p.select("p_partkey", F.col("p_type").alias("gold_l1"), F.col("p_brand").alias("gold_l2"), name[0].alias("alt_l2"))
    decision = F.when(k % 4 == 0, "update_gold").when(k % 4 == 1, "add_alt ").when(k % 4 == 2, "keep_gold")
    known = spark.createDataFrame([("red", "Colour"), ("blue", "Colour")], "l2 string, l1 string")
    return vault.reviewed_gold(gold, p.select("p_partkey", decision.alias("decision"), F.when(k % 2 == 0, name[0]).otherwise(name[1]).alias("predicted")), known, "p_partkey")


@query(r"""WITH c AS (SELECT p_partkey, length(p_brand) > 1 AS a, length(p_type) > 10 OR contains(lower(p_type || ' ' || split_part(p_name, ' ', 2)), split_part(p_name, ' ', 2)) AND length(split_part(p_name, ' ', 2)) > 4 OR (length(split_part(p_name, ' ', 1)) > 4 AND contains(lower(p_type || ' ' || split_part(p_name, ' ', 2)), split_part(p_name, ' ', 1))) AS g,
    p_partkey % 9 <> 0 AS u, p_size % 2 = 0 AS d FROM part)
    SELECT p_partkey, CASE WHEN NOT (a AND u) THEN 'FAILED' WHEN a::INT + g::INT + 1 + u::INT + 1 + d::INT + 1 >= 5 THEN 'PASSED' ELSE 'WARNING' END AS status FROM c""")
def validation_status(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    v = vault.validated(
        F.col("p_name"), F.col("p_brand"), F.array().cast("array<string>"), F.col("p_type"), k, F.concat_ws(" ", "p_type", F.split("p_name", " ")[1]), k % 9 == 0,
        F.when(F.col("p_size") % 2 == 0, "medium").otherwise("Hard"), "Medium",
    )
    return table(spark, sf, "part").select("p_partkey", v["status"].alias("status"))


@query("""SELECT p_partkey, CASE WHEN s_suppkey IS NULL THEN 'REGISTERED' WHEN s_nationkey % 2 = 0 AND NOT s_nationkey % 3 = 0 THEN 'CANCELLING' WHEN s_nationkey % 3 = 0 THEN 'COMPLETED' ELSE 'RUNNING' END AS status FROM part LEFT JOIN supplier ON s_suppkey = p_partkey""")
def upload_batch_status(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("s_nationkey")
    jobs = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.when(n % 3 == 0, "COMPLETED").otherwise("RUNNING").alias("status"), F.when(n % 2 == 0, "CANCELLING").alias("step"))
    return vault.batch_status(table(spark, sf, "part").select("p_partkey"), jobs, "p_partkey")
