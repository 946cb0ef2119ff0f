"""Queries over histories and decks: ``events`` as an append-only log, ``conversations`` as decks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import history, relational, sequence
from ..streaming import jobs
from .registry import query, table

STATUS = "CASE event_type WHEN 'purchase' THEN 'confirmed' WHEN 'view' THEN 'draft' WHEN 'error' THEN 'superseded' ELSE event_type END"


def _tags(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "confirmed").when(F.col("event_type") == "view", "draft").when(F.col("event_type") == "error", "superseded").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", "user_id", kind.alias("status"), "ts", "value")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return relational.counts_by(table(spark, sf, "events"), "event_type")


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'view') AS view FROM events WHERE event_type IN ('click', 'error', 'view') GROUP BY user_id")
def status_pivot(spark: SparkSession, sf: str) -> DataFrame:
    kinds = ["click", "error", "view"]
    return table(spark, sf, "events").where(F.col("event_type").isin(kinds)).groupBy("user_id").pivot("event_type", kinds).count().fillna(0)


@query(f"""WITH t AS (SELECT event_id, user_id, {STATUS} AS status, ts, value FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY status = 'confirmed' DESC, ts DESC, event_id DESC) AS k FROM t WHERE status <> 'superseded')
    SELECT user_id, event_id, status FROM r WHERE k = 1""")
def latest_confirmed_first(spark: SparkSession, sf: str) -> DataFrame:
    return history.current(_tags(spark, sf), "user_id", "status", "ts", "event_id").select("user_id", "event_id", "status")


@query("SELECT user_id, event_id, event_type FROM events e WHERE ts = (SELECT max(ts) FROM events x WHERE x.user_id = e.user_id)")
def latest_any_status(spark: SparkSession, sf: str) -> DataFrame:
    return history.newest(table(spark, sf, "events"), "user_id", "ts").select("user_id", "event_id", "event_type")


@query(f"""WITH t AS (SELECT event_id, user_id, {STATUS} AS status, ts FROM events) SELECT event_id, user_id, CASE WHEN status = 'confirmed' AND row_number() OVER (PARTITION BY user_id, status = 'confirmed' ORDER BY ts DESC, event_id DESC) > 1 THEN 'superseded' ELSE status END AS status FROM t""")
def supersede_history(spark: SparkSession, sf: str) -> DataFrame:
    return history.superseded(_tags(spark, sf), "user_id", "status", "ts", "event_id").select("event_id", "user_id", "status")


@query(f"""WITH t AS (SELECT event_id, user_id, {STATUS} AS status, ts FROM events) SELECT event_id, status AS from_status, 'superseded' AS to_status, 'SUPERSEDE' AS change_type, 'batch' AS actor FROM
    (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM t WHERE status = 'confirmed') WHERE k > 1""")
def history_changes(spark: SparkSession, sf: str) -> DataFrame:
    before = _tags(spark, sf)
    return history.changes(before, history.superseded(before, "user_id", "status", "ts", "event_id"), "event_id", "status", "batch")


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'view' ORDER BY value, ts DESC, event_id LIMIT 50")
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    return _tags(spark, sf).where("status = 'draft'").orderBy("value", F.desc("ts"), "event_id").limit(50).select("event_id", "user_id", "value")


@query("""WITH u AS (SELECT user_id, max(event_type = 'purchase') AS c, max(event_type IN ('purchase', 'view')) AS a, sum(value) AS v FROM events GROUP BY user_id)
    SELECT user_id % 10 AS deck, count(*) FILTER (c) AS confirmed, count(*) FILTER (a AND NOT c) AS draft, count(*) FILTER (NOT a) AS untagged, round(sum(v), 2) AS total FROM u GROUP BY 1""")
def deck_tag_summary(spark: SparkSession, sf: str) -> DataFrame:
    u = table(spark, sf, "events").groupBy("user_id").agg(F.max(F.col("event_type") == "purchase").alias("c"), F.max(F.col("event_type").isin("purchase", "view")).alias("a"), F.sum("value").alias("v"))
    return u.groupBy((F.col("user_id") % 10).alias("deck")).agg(F.count_if("c").alias("confirmed"), F.count_if(F.col("a") & ~F.col("c")).alias("draft"), F.count_if(~F.col("a")).alias("untagged"), F.round(F.sum("v"), 2).alias("total"))


@query("SELECT event_type, round(sum(((event_id % 1000) - least(greatest(event_id % 300, 0), event_id % 1000)) * 0.075 + least(greatest(event_id % 300, 0), event_id % 1000) * 0.0075 + (event_id % 200 + 5) * 0.30) / 1e6, 8) AS cost FROM events GROUP BY event_type")
def token_cost(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    cost = rules.token_cost(e % 1000, e % 200, F.lit(5), e % 300)
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.sum(cost), 8).alias("cost"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 5 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g) SELECT user_id, count(*) AS n, floor(epoch(min(ts)))::BIGINT AS started FROM s GROUP BY user_id, n""")
def session_activity(spark: SparkSession, sf: str) -> DataFrame:
    s = jobs.sessions(table(spark, sf, "events"), "user_id", "ts")
    return s.select("user_id", "n", F.unix_timestamp(F.col("session_window.start").cast("timestamp")).alias("started"))


@query("""SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS started, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def hourly_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = jobs.windowed(table(spark, sf, "events"), "ts", ["event_type"], "1 hour")
    return w.select(F.unix_timestamp(F.col("window.start").cast("timestamp")).alias("started"), "event_type", "n")


@query("""SELECT user_id, arg_max(event_type, {'a': ts, 'b': event_type}) AS event_type, count(*) AS n_events FROM events GROUP BY user_id""")
def latest_status(spark: SparkSession, sf: str) -> DataFrame:
    return history.latest_status(table(spark, sf, "events"), "user_id", "ts", "event_type").select("user_id", "event_type", "n_events")


@query("SELECT event_id AS id, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS position FROM events WHERE event_type = 'view'")
def queue_positions(spark: SparkSession, sf: str) -> DataFrame:
    pending = table(spark, sf, "events").where("event_type = 'view'").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.lit("PENDING").alias("status"))
    return jobs.queue_positions(pending)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS k FROM events) SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_type) AS messages FROM r WHERE k <= 5 GROUP BY user_id""")
def progress_ring(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.ring_buffer(table(spark, sf, "events"), "user_id", "ts", "event_type", 5).withColumn("messages", F.array_join("messages", ","))


@query("""SELECT a.conv_id, a.turn AS question_at, b.turn AS answer_at, a.text AS question, b.text AS answer FROM (SELECT *, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nt FROM conversations) a
    JOIN conversations b ON a.conv_id = b.conv_id AND a.nt = b.turn WHERE a.role = 'user' AND b.role = 'assistant'""")
def qa_pairs_lead(spark: SparkSession, sf: str) -> DataFrame:
    return sequence.adjacent_pairs(table(spark, sf, "conversations"), "conv_id", "turn", "role", "user", "assistant", "text")


@query("SELECT conv_id, turn, last_value(CASE WHEN role IN ('user', 'system') THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM conversations")
def carry_forward_header(spark: SparkSession, sf: str) -> DataFrame:
    return sequence.carried(table(spark, sf, "conversations"), "conv_id", "turn", F.when(F.col("role").isin("user", "system"), F.col("turn")), "header").select("conv_id", "turn", "header")


@query("""WITH x AS (SELECT conv_id, turn, role, last_value(CASE WHEN role IN ('system', 'user') THEN turn END IGNORE NULLS) OVER w AS lst, last_value(CASE WHEN role IN ('system', 'user') THEN role END IGNORE NULLS) OVER w AS lr FROM conversations
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) SELECT conv_id, turn, CASE WHEN lr = 'user' THEN lst END AS round FROM x""")
def carry_with_reset(spark: SparkSession, sf: str) -> DataFrame:
    out = sequence.carried_with_reset(table(spark, sf, "conversations"), "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")), F.col("role") == "system", "round")
    return out.select("conv_id", "turn", "round")


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS question_number, CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS INTEGER) AS question_in_round FROM conversations")
def number_in_round(spark: SparkSession, sf: str) -> DataFrame:
    return sequence.numbered(table(spark, sf, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "question_number", "question_in_round")


@query("""SELECT m.conv_id, m.turn AS media_at, q.turn AS question_at FROM conversations m JOIN (SELECT conv_id, turn, turn + 1 AS upto FROM conversations WHERE role = 'user') q ON m.conv_id = q.conv_id AND m.turn BETWEEN q.turn AND q.upto""")
def range_media_join(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    q = c.where("role = 'user'").select("conv_id", F.col("turn").alias("question_at"), (F.col("turn") + 1).alias("upto"))
    m = c.select("conv_id", F.col("turn").alias("media_at"))
    return relational.between_join(m, q, "conv_id", "media_at", "question_at", "upto").select("conv_id", "media_at", "question_at")


def _slides(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("document_id"), (F.col("turn") + 1).alias("slide_number"), F.when(F.col("role") == "user", "Question").when(F.col("role") == "assistant", "Answer").alias("title"),
                    F.when(F.col("role") == "user", F.concat(F.col("text"), F.lit("?"))).otherwise(F.col("text")).alias("extracted_text"), F.lit(None).cast("string").alias("speaker_notes"))


@query(None)
def deck_fold(spark: SparkSession, sf: str) -> DataFrame:
    return sequence.classify_decks(_slides(spark, sf)).select("document_id", "slide_number", "slide_type")


@query(None)
def deck_questions(spark: SparkSession, sf: str) -> DataFrame:
    return sequence.extract_questions(sequence.classify_decks(_slides(spark, sf)))


@query("""WITH k AS (SELECT conv_id, turn, text, array_to_string((regexp_extract_all(lower(text), '[a-z0-9]+'))[:10], ' ') AS key10 FROM conversations)
    SELECT conv_id, key10, min(turn) AS first_at, arg_max(text, {'l': length(text), 't': -turn}) AS best_answer, count(*) AS n FROM k GROUP BY conv_id, key10""")
def consolidate_by_prefix(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").withColumn("media", F.array().cast("array<string>"))
    return sequence.consolidated(c, "conv_id", F.col("text"), "turn", "text", "media").select("conv_id", "key10", "first_at", "best_answer", "n")


@query("""SELECT c_custkey, n_name, count(o_orderkey) AS n_orders, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey) AS orders FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")
def left_join_enrich(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey").join(table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey", "left")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey")
    out = relational.enriched(c.select("c_custkey"), "c_custkey", c.select("c_custkey", "n_name"), {"o": (o, ["o_orderdate", "o_orderkey"])})
    n = F.when(F.col("o").isNull(), 0).otherwise(F.size("o")).cast("long")
    return out.select("c_custkey", "n_name", n.alias("n_orders"), F.array_join(F.transform("o", lambda s: s["o_orderkey"]), ",").alias("orders"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def untagged_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_acctbal")


@query("""WITH n AS (SELECT l_orderkey, count(*) AS k FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT o_orderkey, CAST(coalesce(k, 0) + 1 AS BIGINT) AS occurrence_count FROM orders LEFT JOIN n ON l_orderkey = o_orderkey""")
def occurrence_counts(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "orders").select("o_orderkey")
    r = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return history.repeat_counts(q, r, "o_orderkey")


@query(r"""SELECT p_partkey, trim(regexp_replace(p_name, '^\s*(?:[Qq]\s*)?[0-9]+\s*[.):\-]\s*', '')) AS name, 'Round ' || p_size || ' Q' || (p_partkey % 9) AS label, coalesce(lower(trim(p_type)) = lower(p_brand), false) AS soft FROM part""")
def labels_and_names(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select("p_partkey", text.strip_leading_number(F.col("p_name")).alias("name"), text.question_label(F.col("p_partkey"), F.col("p_size").cast("long"), F.col("p_partkey") % 9).alias("label"),
                    text.soft_match(F.col("p_type"), F.col("p_brand"), F.array().cast("array<string>")).alias("soft"))
