"""Queries over the assembled bank and over decisions: ``documents`` as questions, ``labels`` and ``events`` as tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decks, disambiguate, parsing, rules, text
from ..operators import bank, curate, review, search
from .bank import _COS, _QV, TOKS, taxonomy_sql
from .registry import query, table


def _none() -> Column:
    return F.array().cast("array<string>")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as tags of users as questions."""
    kind = F.when(F.col("event_type") == "purchase", "confirmed").when(F.col("event_type") == "view", "draft").otherwise("superseded")
    e = table(spark, sf, "events")
    return e.select(
        "event_id", "user_id", "ts", kind.alias("status"), F.when(F.col("event_id") % 3 == 0, "HUMAN").otherwise("LLM").alias("source"), F.col("event_type").alias("topic_l1"),
        F.when(F.col("event_id") % 4 == 0, "Unknown").when(F.col("event_id") % 5 > 0, F.col("event_type")).alias("subtopic_l2"), F.when(F.col("event_id") % 2 == 0, "good").otherwise("weak").alias("fit"),
        (F.col("value") / 100).alias("confidence"), F.lit(None).cast("string").alias("verified_by"), F.lit(None).cast("timestamp").alias("verified_at"),
    )


_EVENTS_SQL = """SELECT event_id, user_id, ts, CASE event_type WHEN 'purchase' THEN 'confirmed' WHEN 'view' THEN 'draft' ELSE 'superseded' END AS status, CASE WHEN event_id % 3 = 0 THEN 'HUMAN' ELSE 'LLM' END AS source,
    event_type AS topic_l1, CASE WHEN event_id % 4 = 0 THEN 'Unknown' WHEN event_id % 5 > 0 THEN event_type END AS subtopic_l2, CASE WHEN event_id % 2 = 0 THEN 'good' ELSE 'weak' END AS fit, value / 100 AS confidence FROM events"""


@query("""SELECT d.doc_id AS id, l.doc_id IS NOT NULL AS tagged, coalesce(CASE WHEN quality = 1 THEN 'Good' END, lang) AS topic_l1, source AS subtopic_l2, 'STANDARD_QA' AS question_format, 'Deck ' || source AS deck,
    coalesce(CASE WHEN toxic = 1 THEN 'MATURE_REFERENCE' END, CASE WHEN l.doc_id IS NOT NULL OR d.doc_id % 6 = 0 THEN 'NONE' END) AS sensitivity, CASE WHEN quality = 1 THEN 'IN' END AS geography,
    CASE WHEN l.doc_id IS NOT NULL AND d.doc_id % 4 > 0 THEN '' WHEN d.doc_id % 5 = 0 THEN 'TIME_SENSITIVE' ELSE 'EVERGREEN' END AS shelf_life, CASE WHEN l.doc_id IS NOT NULL AND quality = 1 THEN 'k' ELSE coalesce(lang, '') END AS keywords,
    CASE WHEN d.doc_id % 3 = 0 THEN 'Hard' ELSE 'Medium' END AS difficulty, CASE WHEN l.doc_id IS NOT NULL AND toxic = 0 THEN 'Pune' ELSE 'Goa' END AS city_name
    FROM documents d LEFT JOIN labels l USING (doc_id) WHERE length(trim(coalesce(text, ''))) >= 8 AND NOT coalesce(lang = 'fr' AND d.doc_id % 2 = 0, false)""")
def bank_rows(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    dup = F.when((F.col("lang") == "fr") & (F.col("doc_id") % 2 == 0), "CONFIRMED_DUPLICATE")
    q = d.select(F.col("doc_id").alias("id"), F.col("text").alias("question_text"), F.lit("").alias("answer"), F.col("lang").alias("topic"), F.col("source").alias("subtopic"), F.col("source").alias("document_id"), _none().alias("question_images"), dup.alias("duplicate_status"),
        F.when(F.col("doc_id") % 6 == 0, F.array(F.lit("corporate"), F.lit("general"))).alias("audience_suitability"), F.when(F.col("doc_id") % 5 == 0, "TIME_SENSITIVE").alias("temporal_nature"), F.array(F.coalesce("lang", F.lit(""))).alias("tags"),
        F.when(F.col("doc_id") % 3 == 0, "Hard").alias("difficulty"))
    fine = F.col("quality") == 1
    t = table(spark, sf, "labels").select(F.col("doc_id").alias("question_id"), F.when(fine, "Good").alias("topic_l1"), F.lit(None).cast("string").alias("subtopic_l2"), F.when(fine, "IN").alias("geography"), F.when(F.col("toxic") == 1, "MATURE_REFERENCE").alias("sensitivity"), F.when(F.col("doc_id") % 4 > 0, "").alias("shelf_life"),
        F.when(fine, F.array(F.lit("k"))).otherwise(_none()).alias("keywords"), F.when(F.col("toxic") == 0, "Pune").alias("city_name"))
    meta = d.select(F.col("doc_id").alias("question_id"), F.lit(2024).alias("year"), F.lit(None).cast("string").alias("question_format"), F.lit("Goa").alias("city_name"))
    decks = d.select(F.col("source").alias("id")).distinct().withColumn("title", F.concat(F.lit("Deck "), "id"))
    return bank.bank_rows(q, t, meta, decks).select("id", "tagged", "topic_l1", "subtopic_l2", "question_format", "deck", "sensitivity", "geography", "shelf_life", F.array_join("keywords", ",").alias("keywords"), "difficulty", "city_name")


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND (coalesce(text, '') ILIKE '%license%' OR coalesce(source, '') ILIKE '%license%')")
def tag_attribute_search(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(bank.tag_filter({"lang": "en", "source": ""}, " license ", [F.col("text"), F.col("source")])).select("doc_id", "lang", "source")


_INDIAN = "(" + " OR ".join(f"contains(lower(concat_ws(' ', text, '', lang, source, '')), '{m}')" for m in rules.IN_MARKERS) + ")"


@query(f"""SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id % 3 <> 0 AND (CASE WHEN doc_id % 2 = 0 THEN 'IN' WHEN doc_id % 5 = 0 THEN 'MIXED' ELSE 'INTL' END IN ('IN', 'MIXED') OR {_INDIAN})
    AND coalesce(lang, '') <> 'de' AND coalesce(toxic, 0) = 0""")
def hard_gates(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id", F.col("text").alias("question_text"), F.lit("").alias("answer"), F.col("lang").alias("topic_l1"), F.col("source").alias("subtopic_l2"), F.lit("").alias("geo_region"), (k % 3 == 0).alias("image_dependent"),
        F.when(k % 2 == 0, "IN").when(k % 5 == 0, "MIXED").otherwise("INTL").alias("india_international"), F.when(F.col("lang") == "de", "TIME_SENSITIVE").alias("shelf_life"), F.when(F.col("toxic") == 1, "POLITICAL").alias("sensitivity"),
    )
    return d.where(bank.gates({"exclude_image": True, "india_international": "IN", "evergreen_only": True, "school_safe": True})).select("doc_id")


@query("""SELECT doc_id, round(1.0 + CASE WHEN quality IS NOT NULL THEN 0.5 ELSE 0.0 END + CAST(('0x' || substr(md5(doc_id || ':7'), 1, 6)) AS INTEGER) / 16777216.0::DOUBLE * 0.3::DOUBLE, 3) AS score
    FROM documents LEFT JOIN labels USING (doc_id) ORDER BY score DESC, doc_id LIMIT 50""")
def broad_pool(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return bank.broad_order(d, "doc_id", F.col("quality").isNotNull(), 50).select("doc_id", "score")


@query(f"""SELECT doc_id, CAST(len(list_intersect(list_distinct({TOKS}), ['tion', 'erandst', 'license', 'oren'])) AS INTEGER) AS overlap FROM documents ORDER BY overlap DESC, n_chars DESC NULLS LAST, doc_id LIMIT 40""")
def tag_overlap_order(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return bank.by_tag_overlap(d, "doc_id", text.tokens(F.col("text")), ["Tion ", "erandst", "license", "oren"], F.col("n_chars"), 40).select("doc_id", "overlap")


@query(f"SELECT event_id, user_id, topic_l1 FROM ({_EVENTS_SQL}) WHERE source = 'HUMAN' AND status = 'confirmed' ORDER BY ts DESC, user_id, event_id LIMIT 8")
def human_exemplars(spark: SparkSession, sf: str) -> DataFrame:
    t = _events(spark, sf).withColumn("user_id", F.struct("user_id", "event_id"))
    q = t.select("user_id").distinct()
    return bank.exemplars(q, t, "user_id", "ts").select("user_id.event_id", "user_id.user_id", "topic_l1")


@query("""WITH t AS (SELECT DISTINCT p_brand AS l2, 'Theme ' || (p_size % 5) AS l1 FROM part WHERE p_partkey % 2 = 0), k2 AS (SELECT lower(l2) AS k, min({'l2': l2, 'l1': l1}) AS v FROM t GROUP BY 1), k1 AS (SELECT lower(l1) AS k, min(l1) AS v FROM t GROUP BY 1),
    p AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 'theme ' || (p_size % 9) END AS l1, CASE WHEN p_partkey % 4 > 0 THEN upper(p_brand) END AS l2 FROM part)
    SELECT p_partkey, coalesce(k2.v.l1, k1.v, p.l1) AS l1, coalesce(k2.v.l2, p.l2) AS l2, k2.k IS NULL AND (p.l2 IS NOT NULL OR k1.k IS NULL) AS is_custom FROM p LEFT JOIN k2 ON k2.k = lower(p.l2) LEFT JOIN k1 ON k1.k = lower(p.l1) WHERE coalesce(k2.v.l1, k1.v, p.l1) IS NOT NULL""")
def normalised_paths(spark: SparkSession, sf: str) -> DataFrame:
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    tax = p.where(k % 2 == 0).select(F.col("p_brand").alias("l2"), F.concat(F.lit("Theme "), F.col("p_size") % 5).alias("l1")).distinct()
    paths = p.select("p_partkey", F.when(k % 7 != 0, F.concat(F.lit("theme "), F.col("p_size") % 9)).alias("l1"), F.when(k % 4 > 0, F.upper("p_brand")).alias("l2"))
    return review.normalised_paths(paths, tax)


@query("SELECT p_type AS l1, p_brand AS l2, count(*) AS n FROM part WHERE p_partkey % 3 = 0 GROUP BY 1, 2")
def custom_topic_counts(spark: SparkSession, sf: str) -> DataFrame:
    return bank.custom_counts(table(spark, sf, "part").select(F.col("p_type").alias("l1"), F.col("p_brand").alias("l2"), (F.col("p_partkey") % 3 == 0).alias("is_custom")))


@query("SELECT p_brand, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 3")
def host_subtopics(spark: SparkSession, sf: str) -> DataFrame:
    return bank.top_subtopics(table(spark, sf, "part"), "p_brand")


@query("""SELECT count(*) AS n, round(100 * avg(CASE WHEN coalesce((n_chars > 1000) = (quality = 1), false) THEN 1 ELSE 0 END), 4) AS quality, round(100 * avg(CASE WHEN coalesce((lang = 'en') = (toxic = 1), false) THEN 1 ELSE 0 END), 4) AS toxic
    FROM documents LEFT JOIN labels USING (doc_id)""")
def rule_baselines(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return bank.baseline(d, {"quality": (F.col("n_chars") > 1000, F.col("quality") == 1), "toxic": (F.col("lang") == "en", F.col("toxic") == 1)})


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 20")
def duplicate_candidates(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "O", "POSSIBLE_DUPLICATE"))
    return bank.candidates(o, "o_orderkey", "status", "o_totalprice", 20, 20).select("o_orderkey", "o_totalprice")


@query(f"""WITH t AS ({_EVENTS_SQL}), q AS (SELECT c_custkey AS user_id, c_mktsegment AS topic, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS subtopic FROM customer), ids AS (SELECT user_id FROM q WHERE user_id % 3 = 0),
    r AS (SELECT t.*, q.topic, q.subtopic, ids.user_id IS NOT NULL AS taken, row_number() OVER (PARTITION BY t.user_id ORDER BY ts DESC, event_id DESC) = 1 AS top FROM t LEFT JOIN ids USING (user_id) LEFT JOIN q USING (user_id))
    SELECT user_id, event_id, CASE WHEN taken AND top THEN 'confirmed' WHEN taken AND status = 'confirmed' THEN 'superseded' ELSE status END AS status, topic_l1,
    CASE WHEN taken AND top AND (subtopic_l2 IS NULL OR subtopic_l2 = 'Unknown') THEN coalesce(subtopic, topic_l1) ELSE subtopic_l2 END AS subtopic_l2, CASE WHEN taken AND top THEN 'good' ELSE fit END AS fit,
    CASE WHEN taken AND top AND confidence < 0.7 THEN 0.9 ELSE confidence END AS confidence, CASE WHEN taken AND top THEN 'reviewer' END AS verified_by FROM r
    UNION ALL SELECT user_id, NULL, 'confirmed', topic, coalesce(subtopic, topic), 'good', 0.9, 'reviewer' FROM q WHERE user_id % 3 = 0 AND user_id NOT IN (SELECT user_id FROM t)""")
def accepted_from_review(spark: SparkSession, sf: str) -> DataFrame:
    """Customers stand for questions, events for their tags; every third customer is accepted."""
    q = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("topic"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("subtopic"))
    out = review.accepted(_events(spark, sf), q, q.where("user_id % 3 = 0").select("user_id"), "user_id", "ts", "event_id", F.current_timestamp(), "reviewer")
    return out.select("user_id", "event_id", "status", "topic_l1", "subtopic_l2", "fit", "confidence", "verified_by")


@query(f"""WITH t AS ({_EVENTS_SQL}), a AS (SELECT *, CASE WHEN event_id % 10 = 1 THEN 'confirm' WHEN event_id % 10 = 2 THEN 'reject' END AS act FROM t), w AS (SELECT user_id, max(event_id) AS won FROM a WHERE act = 'confirm' GROUP BY 1)
    SELECT event_id, user_id, CASE WHEN act = 'confirm' AND event_id = won THEN 'confirmed' WHEN act = 'reject' THEN 'rejected' WHEN won IS NOT NULL AND (status = 'confirmed' OR act = 'confirm') THEN 'superseded' ELSE status END AS status FROM a LEFT JOIN w USING (user_id)""")
def bulk_decisions(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    acts = table(spark, sf, "events").where(e % 10 < 3).select("event_id", F.when(e % 10 == 1, " Confirm").when(e % 10 == 2, "REJECT").alias("action")).where("action IS NOT NULL")
    return review.decided(_events(spark, sf), acts, "event_id", "user_id").select("event_id", "user_id", "status")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 OR n_name IS NULL OR n_name = 'NA' THEN c_name ELSE n_name END AS geography FROM (SELECT c_custkey, c_name, CASE WHEN c_nationkey % 5 = 0 THEN 'NA' WHEN c_nationkey % 7 > 0 THEN n_name END AS n_name
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)""")
def tag_to_metadata(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    meta = c.select("c_custkey", F.col("c_name").alias("geography"), F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit("geography"))).alias("manual_fields"))
    n = c.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    tags = n.select("c_custkey", F.when(F.col("c_nationkey") % 5 == 0, "NA").when(F.col("c_nationkey") % 7 > 0, F.col("n_name")).alias("geo"))
    return review.tag_to_meta(meta, tags, "c_custkey", {"geography": "geo"}).select("c_custkey", "geography")


@query(f"SELECT doc_id, {taxonomy_sql(1)} AS topic_l1, {taxonomy_sql(2)} AS subtopic_l2, 'confirmed' AS status, 0.95::DOUBLE AS confidence, 'RULE' AS source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def rule_tags_for_untagged(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumn("t", rules.taxonomy(F.coalesce("text", F.lit(""))))
    return review.missing_tags(d, table(spark, sf, "labels"), "doc_id", F.col("t.l1"), F.col("t.l2"))


#: Formats and names that the invented texts lack, in front of them.
_HEADS = ["", "The Beatles, Apple and the RBI: ", "Tim Cook of apple sips Gold Loan ", "PAN card, zomato, Lays, monsoon and Crayola in "]
_CODES = ["QA", "CONNECT", "THREE_CLUE", "ODD", None]


@query(f"""WITH f AS (SELECT MAP {{{', '.join(f"'{k}': '{v}'" for k, v in rules.FORMAT_NAMES.items())}}} AS m, [{', '.join(f"'{e}'" for e in rules.ENTITIES)}] AS es),
    d AS (SELECT doc_id, [{', '.join(f"'{h}'" for h in _HEADS)}][1 + doc_id % {len(_HEADS)}] || coalesce(text, '') AS text, coalesce(['QA', 'CONNECT', 'THREE_CLUE', 'ODD', NULL][1 + doc_id % {len(_CODES)}], 'QA') AS c FROM documents)
    SELECT doc_id, {taxonomy_sql(1)} AS l1, {taxonomy_sql(2)} AS l2, array_to_string(list_concat([coalesce(m[c], c)], list_filter(es, lambda e: contains(lower(text), lower(e))))[:{rules.KEYWORDS}], '|') AS keywords FROM d, f""")
def taxonomy_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """Theme, subtopic and keywords of a question by rules alone."""
    k = F.col("doc_id")
    head = F.get(F.array(*[F.lit(h) for h in _HEADS]), (k % len(_HEADS)).cast("int"))
    code = F.get(F.array(*[F.lit(c) for c in _CODES]), (k % len(_CODES)).cast("int"))
    d = table(spark, sf, "documents").select("doc_id", F.concat(head, F.coalesce("text", F.lit(""))).alias("q"), code.alias("c"))
    return d.select("doc_id", rules.taxonomy(F.col("q")).alias("t"), F.array_join(rules.keywords(F.col("q"), F.col("c")), "|").alias("keywords")).select("doc_id", "t.*", "keywords")


@query("""SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 THEN 'L' ELSE coalesce(nullif(trim(lang), ''), 'R1') END AS topic_l1, CASE WHEN d.doc_id % 3 = 0 THEN 'L2' WHEN coalesce(trim(lang), '') <> '' THEN source ELSE 'R2' END AS subtopic_l2,
    CASE WHEN d.doc_id % 3 = 0 THEN 'LABEL' WHEN coalesce(trim(lang), '') <> '' THEN 'FIELD' ELSE 'RULE' END AS origin FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)""")
def seeded_tags(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("topic"), F.col("source").alias("subtopic"))
    lab = q.where("doc_id % 3 = 0").select("doc_id", F.lit("L").alias("l1"), F.lit("L2").alias("l2"))
    return review.seeded_tags(q, lab, table(spark, sf, "labels"), "doc_id", F.lit("R1"), F.lit("R2"))


@query("SELECT p_partkey AS id, p_name, CAST(row_number() OVER (ORDER BY n) - 1 AS INTEGER) AS order_index FROM part JOIN (SELECT unnest([7, 3, 150, 3]) AS id, unnest([1, 2, 3, 4]) AS n) ON id = p_partkey")
def saved_quiz(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name")
    return review.saved_quiz(b, [7, 3, -5, 150, 3])


_FORMATS_SQL = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{name}'" for name, p in parsing.FORMATS) + " END"


@query(f"SELECT doc_id, {_FORMATS_SQL} AS format FROM (SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN 'Three clues: ' WHEN 2 THEN 'arrange the lot: ' WHEN 3 THEN 'LIST-IT ' WHEN 4 THEN 'rapid fire ' ELSE '' END || coalesce(text, '') AS t FROM documents)")
def format_headers(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("doc_id") % 6
    head = F.when(m == 1, "Three clues: ").when(m == 2, "arrange the lot: ").when(m == 3, "LIST-IT ").when(m == 4, "rapid fire ").otherwise("")
    return table(spark, sf, "documents").select("doc_id", parsing.format_in(F.concat(head, F.coalesce("text", F.lit("")))).alias("format"))


@query("""WITH h AS (SELECT doc_id, n_chars / 5000.0::DOUBLE AS score FROM documents WHERE n_chars IS NOT NULL), r AS (SELECT * FROM h WHERE score >= 0.4), l AS (SELECT coalesce(min(score), 0.1) AS low FROM r)
    SELECT doc_id, score FROM r UNION ALL SELECT doc_id, round(least(least(greatest(low * 0.5, 0.05), 0.35) * 0.5, 0.2), 3)::DOUBLE FROM documents, l WHERE doc_id NOT IN (SELECT doc_id FROM r)""")
def hits_and_broad_pool(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    hits = d.where("n_chars IS NOT NULL").select("doc_id", (F.col("n_chars") / 5000.0).alias("score"))
    return curate.with_broad_pool(hits, d.select("doc_id"), "doc_id")


@query("""WITH b AS (SELECT doc_id AS id, lower(lang) AS l1, lower(source) AS l2, lang = 'fr' AND n_chars > 2000 AS strict, doc_id % 2 = 0 AS safe, coalesce(n_chars / 10000.0::DOUBLE, 0) AS s FROM documents),
    f AS (SELECT *, CASE WHEN s >= 0.4 AND coalesce(strict, false) THEN 1 WHEN s >= 0.4 AND safe THEN 2 END AS fs FROM b), t AS (SELECT l1 AS t FROM f WHERE fs IS NOT NULL UNION SELECT l2 FROM f WHERE fs IS NOT NULL),
    g AS (SELECT *, coalesce(fs, CASE WHEN safe AND (l1 IN (SELECT t FROM t WHERE t IS NOT NULL) OR l2 IN (SELECT t FROM t WHERE t IS NOT NULL)) THEN 3 END, CASE WHEN safe THEN 4 END) AS stage FROM f),
    c AS (SELECT count(*) FILTER (stage < 2) AS n2, count(*) FILTER (stage < 3) AS n3, count(*) FILTER (stage < 4) AS n4, coalesce(min(s) FILTER (stage < 3), 0.1) AS low FROM g)
    SELECT id, CASE WHEN stage < 3 THEN s WHEN stage = 3 THEN greatest(low * 0.5, 0.05) ELSE greatest(low * 0.5, 0.05) * 0.5 END::DOUBLE AS score, stage FROM g, c WHERE stage = 1 OR (stage = 2 AND n2 < 100) OR (stage = 3 AND n3 < 100) OR (stage = 4 AND n4 < 100)""")
def stages_of_relaxation(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    return curate.relaxed_in_stages(b, (F.col("lang") == "fr") & (F.col("n_chars") > 2000), F.col("id") % 2 == 0, F.col("n_chars") / 10000.0, ["lang", "source"], 100).select("id", "score", "stage")


@query("""SELECT c_custkey AS id, c_name, n_name AS deck, (SELECT string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS history FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
def question_detail(spark: SparkSession, sf: str) -> DataFrame:
    """Customers stand for questions, nations for decks, orders for history."""
    q = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_name", F.col("c_nationkey").alias("document_id"))
    meta = q.select(F.col("id").alias("question_id"), F.lit(2024).alias("year"))
    decks = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"))
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("question_id"), "o_orderdate", "o_orderkey")
    out = bank.detail(q, meta, decks, {"history": (orders, ["o_orderdate", "o_orderkey"])})
    return out.select("id", "c_name", F.col("deck.title").alias("deck"), F.array_join(F.transform("history", lambda h: h["o_orderkey"]), ",").alias("history"))


@query("""WITH old AS (SELECT p_size AS q, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS pos, p_type AS l1, p_brand AS l2 FROM part), new AS (SELECT q, pos, l1, CASE WHEN q % 2 = 0 THEN upper(l2) ELSE l2 END AS l2 FROM old UNION ALL SELECT 999, 1, 'A', 'B'),
    o AS (SELECT q, string_agg(l1 || ' > ' || l2, '; ' ORDER BY pos) AS v FROM old GROUP BY q), n AS (SELECT q, string_agg(l1 || ' > ' || l2, '; ' ORDER BY pos) AS v FROM new GROUP BY q)
    SELECT n.q, 'topic_paths' AS field, o.v AS old_value, n.v AS new_value, 'EDIT' AS kind, 'ann' AS actor FROM n LEFT JOIN o ON n.q = o.q WHERE n.v IS DISTINCT FROM o.v""")
def topic_path_history(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    p = table(spark, sf, "part")
    old = p.select(F.col("p_size").alias("q"), F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey")).alias("position"), F.col("p_type").alias("l1"), F.col("p_brand").alias("l2"))
    extra = spark.createDataFrame([(999, 1, "A", "B")], "q int, position int, l1 string, l2 string")
    new = old.withColumn("l2", F.when(F.col("q") % 2 == 0, F.upper("l2")).otherwise(F.col("l2"))).unionByName(extra)
    return review.path_changes(old, new, "q", "HUMAN", "ann")


@query("""SELECT doc_id AS id, round(n_chars / 10000.0::DOUBLE + CASE WHEN lang = 'en' THEN 0.5 WHEN lang = 'de' THEN 0.5 ELSE -0.4 END + CASE WHEN source = 'src1' THEN 1.2 WHEN source = 'src2' THEN -1.5 ELSE 0 END - 0.35 * CASE WHEN n_chars > 3000 THEN 1.0 ELSE 0.0 END, 6) AS rank_score,
    CASE WHEN n_chars / 10000.0::DOUBLE >= 0.4 THEN 'on' ELSE 'adjacent' END AS pool FROM documents""")
def ranked_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Relevance, audience and difficulty in one rank: a school quiz about the country, easy."""
    d = table(spark, sf, "documents")
    geo = F.when(F.col("lang") == "en", "IN").when(F.col("lang") == "de", "MIXED").otherwise("INTL")
    b = d.select(
        F.col("doc_id").alias("id"), F.col("text").alias("question_text"), F.lit("").alias("answer"), F.col("lang").alias("topic_l1"), F.col("source").alias("subtopic_l2"), F.lit("").alias("geo_region"), geo.alias("geography"),
        F.when(F.col("source") == "src1", F.array(F.lit("High_School"))).alias("audience_suitability"), F.when(F.col("source") == "src2", "corporate").alias("primary_audience"),
        _none().alias("question_images"), _none().alias("answer_images"), F.lit("STANDARD_QA").alias("question_format"), F.lit(True).alias("tagged"), F.lit("NONE").alias("sensitivity"), F.lit("").alias("shelf_life"),
        F.when(F.col("n_chars") > 3000, "Hard").otherwise("Easy").alias("difficulty"), F.when(F.col("n_chars") > 3000, 0.9).otherwise(0.2).alias("difficulty_score"), (F.col("n_chars") / 10000.0).alias("score"),
    )
    brief = curate.Brief("x", filters={"india_focused": True}, hard_bias="easy", audience="school")
    return curate.split_pools(b, brief).select("id", F.round("rank_score", 6).alias("rank_score"), "pool")


@query("""SELECT p_partkey, p_name AS quiz_name, 'Brand ' || p_size AS college, CASE p_partkey % 3 WHEN 0 THEN 'Bengaluru' WHEN 1 THEN 'New Delhi' END AS city, CASE WHEN p_partkey % 2 = 0 THEN 'Prelims' ELSE 'Finals' END AS round_stage,
    CASE WHEN p_partkey % 4 = 0 THEN DATE '2024-03-15' END AS deck_date, CASE WHEN p_partkey % 4 = 0 THEN 2024 END AS deck_year, 'Hindi' AS language, NULL::VARCHAR AS primary_audience, false AS is_varsity, true AS parsed_ok
    FROM part""")
def deck_names(spark: SparkSession, sf: str) -> DataFrame:
    """File names made of parts' names, taken apart again by all cores: the table is so small that a scan would be a task or two."""
    k = F.col("p_partkey")
    city = F.when(k % 3 == 0, "Bangalore").when(k % 3 == 1, "new delhi").otherwise("")
    day = F.when(k % 8 == 0, "15-03-2024 ").when(k % 4 == 0, "15th March, 2024 ").otherwise("")
    name = F.concat(F.lit("decks/Brand_"), F.col("p_size"), F.lit(" "), city, F.lit(" "), F.when(k % 2 == 0, "Prelims").otherwise("final"), F.lit(" - "), F.col("p_name"), F.lit(" "), day, F.lit("[Hindi] w answers (1).pptx"))
    parts = table(spark, sf, "part").repartition(4 * spark.sparkContext.defaultParallelism)
    return parts.select("p_partkey", decks.deck_info(name).alias("d")).select("p_partkey", "d.*")


#: Heads that bring signs of the rules into the invented texts.
_SIGNS = ["printing of money ", "the CEO steps down, ", "a jingle and the share price rose ", "head and shoulders ", "why is the ticker so ", "net-zero ", "price rise of $ ", "platform of the metro ", ""]


def _ruled_sql() -> str:
    cases = []
    for _, l2, _, taken_for, signs in disambiguate.RULES:
        known = ", ".join(f"'{m}'" for m in taken_for)
        here = " AND ".join(f"regexp_matches(t, '(?i){p}')" for p in signs)
        cases.append(f"WHEN (p = '' OR p IN ({known})) AND {here} THEN CASE WHEN p <> '{l2.lower()}' THEN '{l2}' END")
    return "CASE " + " ".join(cases) + " END"


@query(f"""WITH d AS (SELECT doc_id, CASE doc_id % 9 {' '.join(f"WHEN {n} THEN '{x}'" for n, x in enumerate(_SIGNS))} END || regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F\\P{{L}}]', 'q', 'g') || ' ' AS t,
    CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'stock markets' WHEN 2 THEN 'banks and banking' ELSE 'consumer brands' END AS p FROM documents) SELECT doc_id, {_ruled_sql()} AS l2 FROM d""")
def confused_subtopics(spark: SparkSession, sf: str) -> DataFrame:
    """Rules between subtopics over whole texts with a sign in front. Word boundaries know the letters of all scripts; where the SQL engine's know ASCII alone, it reads other letters as one of these."""
    k = F.col("doc_id")
    head = F.get(F.array(*[F.lit(x) for x in _SIGNS]), (k % 9).cast("int"))
    said = F.get(F.array(F.lit(""), F.lit("Stock Markets"), F.lit("Banks and Banking"), F.lit("Consumer Brands")), (k % 4).cast("int"))
    q = F.concat(head, F.coalesce("text", F.lit("")))
    return table(spark, sf, "documents").select("doc_id", disambiguate.ruled(q, F.lit(""), said)["l2"].alias("l2"))


_BAG = {"erandst": 1.0, "thtion": 1.0, "fr": 0.4}
_BAG_SQL = "(VALUES " + ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in _BAG.items()) + ") q(term, w)"


@query(f"""WITH d AS (SELECT doc_id, lang, {TOKS} AS bag FROM documents), st AS (SELECT count(*) AS n, avg(len(bag)) AS avgdl FROM d),
    p AS (SELECT doc_id, len(bag) AS dl, unnest(bag) AS term FROM d), tf AS (SELECT doc_id, term, any_value(dl) AS dl, count(*) AS tf FROM p GROUP BY 1, 2),
    idf AS (SELECT term, ln(1 + ((SELECT n FROM st) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY term),
    s AS (SELECT doc_id, sum(w * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM st)))) AS score FROM tf JOIN idf USING (term) JOIN {_BAG_SQL} USING (term) GROUP BY doc_id)
    SELECT doc_id, round((score + CASE WHEN lang = 'fr' THEN 0.5 ELSE 0 END) * CASE WHEN doc_id % 3 = 0 THEN 1.15::DOUBLE ELSE 1 END, 3) AS score FROM s JOIN d USING (doc_id) WHERE score > 0 AND coalesce(lang, '') <> 'de' ORDER BY 2 DESC, 1 LIMIT 60""")
def gated_search(spark: SparkSession, sf: str) -> DataFrame:
    """Words, gates and boosts together: French names the topic, every third question needs its picture, German ones pass with time."""
    d = table(spark, sf, "documents").select(
        "doc_id", F.col("text").alias("question_text"), F.col("lang").alias("topic_l1"), F.col("source").alias("subtopic_l2"), (F.col("doc_id") % 3 == 0).alias("image_dependent"), F.lit(True).alias("tagged"),
        F.when(F.col("lang") == "de", "TIME_SENSITIVE").alias("shelf_life"),
    )
    return bank.searched(d, "doc_id", _BAG, {"evergreen_only": True}, 60)


@query(f"""WITH c AS (SELECT doc_id, {_COS} AS sim, CAST(CASE WHEN contains(lower(text), 'ea') THEN 1 ELSE 0 END AS DOUBLE) AS lex FROM documents JOIN embeddings ON doc_id = vec_id, (SELECT {_QV} AS v) WHERE lang = 'fr'),
    p AS (SELECT * FROM c ORDER BY sim DESC, doc_id LIMIT 60), r AS (SELECT *, row_number() OVER (ORDER BY sim DESC, doc_id) AS rd, row_number() OVER (ORDER BY lex DESC, doc_id) AS rs FROM p)
    SELECT doc_id, CAST(rd AS INTEGER) AS rank_dense, CAST(rs AS INTEGER) AS rank_sparse, round(1.0 / (60 + rd) + 1.0 / (60 + rs), 8) AS score FROM r ORDER BY round(1.0 / (60 + rd) + 1.0 / (60 + rs), 8) DESC, doc_id LIMIT 10""")
def hybrid_within_filter(spark: SparkSession, sf: str) -> DataFrame:
    vec = table(spark, sf, "embeddings")
    v = vec.where("vec_id = 7").select("embedding").first()
    rows = table(spark, sf, "documents").join(vec, F.col("doc_id") == F.col("vec_id"))
    found = search.hybrid_within(rows, F.col("lang") == "fr", "doc_id", v[0] if v else [0.0], search.lexical_score(F.col("text"), ["ea"]))
    return found.select("doc_id", "rank_dense", "rank_sparse", F.round("score", 8).alias("score"))
