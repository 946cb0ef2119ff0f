"""Queries over checks and reports: labels and edits that are wrong, formats of questions, layouts of decks, lists of a dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, rules, text
from ..operators import evaluate, history, relational, review, search, sequence, vault
from .bank import _COS, _QV
from .curation import _EVENTS_SQL, _events
from .registry import query, table


@query("""SELECT 'topic' AS kind, CAST(pos AS INTEGER) AS pos, source AS name, n FROM (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS pos FROM documents WHERE source IS NOT NULL GROUP BY source) WHERE pos <= 6
    UNION ALL SELECT 'newest', pos::INTEGER, o_orderkey::VARCHAR, NULL FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS pos FROM orders) WHERE pos <= 5""")
def dashboard_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The six topics with most questions and the five newest sets, orders standing for these."""
    from pyspark.sql import Window

    place = lambda *by: F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*by))
    top = relational.counts_by(table(spark, sf, "documents"), "source").orderBy(F.desc("n"), "source").limit(6)
    new = table(spark, sf, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(5)
    a = top.select(F.lit("topic").alias("kind"), place(F.desc("n"), "source").alias("pos"), F.col("source").alias("name"), "n")
    return a.unionByName(new.select(F.lit("newest").alias("kind"), place(F.desc("o_orderdate"), "o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("name"), F.lit(None).cast("long").alias("n")))


@query("""WITH h AS (SELECT source, doc_id, md5(doc_id || ':7') AS h FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS pos, count(*) OVER (PARTITION BY source) AS n FROM h),
    f AS (SELECT *, pos <= CASE WHEN n >= 3 THEN 3 ELSE 1 END AS first FROM r), o AS (SELECT *, row_number() OVER (PARTITION BY first ORDER BY h, doc_id) AS k FROM f)
    SELECT source, doc_id, first FROM o WHERE first OR k <= 150 - (SELECT count(*) FROM f WHERE first)""")
def stratified_fill(spark: SparkSession, sf: str) -> DataFrame:
    return relational.stratified_to(table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id", 3, 1, 150)


@query("""SELECT a.c_custkey, a.c_custkey - a.c_custkey % 7 AS duplicate_of, CASE WHEN b.c_custkey IS NOT NULL THEN b.c_name || '|' || b.c_mktsegment END AS original FROM customer a
    LEFT JOIN customer b ON b.c_custkey = CASE WHEN a.c_custkey % 3 = 0 THEN a.c_custkey - a.c_custkey % 7 WHEN a.c_custkey % 3 = 1 THEN -1 END""")
def duplicates_with_originals(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").withColumn("of", F.when(k % 3 == 0, k - k % 7).when(k % 3 == 1, -1))
    out = relational.with_original(c, "c_custkey", "of", ["c_name", "c_mktsegment"])
    return out.select("c_custkey", (k - k % 7).alias("duplicate_of"), F.when(F.col("original").isNotNull(), F.concat_ws("|", "original.c_name", "original.c_mktsegment")).alias("original"))


def _slides(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    title = F.when(k % 211 == 7, "Now for the answers").when(k % 3 == 0, F.concat(k.cast("string"), F.lit(". Which?"))).otherwise("")
    notes = F.when((F.col("source") == "src3") & (k % 2 == 0), F.concat(F.lit("Answer: "), "source", F.lit(" of course")))
    return table(spark, sf, "documents").select(F.col("source").alias("document_id"), k.alias("slide_number"), title.alias("title"), F.col("text").alias("extracted_text"), notes.alias("speaker_notes"))


_DIVIDER = sequence.DIVIDER.replace("'", "''")


@query(f"""WITH s AS (SELECT source AS document_id, doc_id, CASE WHEN doc_id % 211 = 7 THEN 'Now for the answers' WHEN doc_id % 3 = 0 THEN doc_id || '. Which?' ELSE '' END AS title, coalesce(text, '') AS x, source = 'src3' AND doc_id % 2 = 0 AS noted FROM documents),
    p AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY document_id) AS n, (regexp_matches(x || title, '{sequence.NUMBERED_OR_ASKS}'))::INT AS q, regexp_matches(lower(trim(title)) || ' ' || lower(trim(x)), '{_DIVIDER}') AS d FROM s WINDOW w AS (PARTITION BY document_id ORDER BY doc_id)),
    m AS (SELECT *, min(CASE WHEN d AND pos >= 4 AND pos < least(n - 2, CAST(floor(n * 0.85) AS BIGINT)) THEN pos END) OVER (PARTITION BY document_id) AS s FROM p),
    g AS (SELECT document_id, max(n) AS n, max(s) AS s, sum(q) FILTER (pos < s) AS pre, sum(q) FILTER (pos >= s) AS post, count(*) FILTER (noted) AS a FROM m GROUP BY 1),
    k AS (SELECT *, CASE WHEN n < 6 THEN 'INTERLEAVED' WHEN s IS NOT NULL AND pre >= 2 AND post >= 2 THEN 'TWO_SECTION' WHEN a >= greatest(5, CAST(floor(n * 0.35) AS BIGINT)) THEN 'NOTES_BASED' ELSE 'INTERLEAVED' END AS layout FROM g)
    SELECT document_id, layout, CASE WHEN layout = 'TWO_SECTION' THEN s END AS answers_start FROM k""")
def deck_layouts(spark: SparkSession, sf: str) -> DataFrame:
    """Sources as decks, documents as their slides."""
    return sequence.layouts(_slides(spark, sf))


#: Wordings that the invented texts lack, in front of them.
_LEADS = ["", "Identify.", "In this image, ", "What is on the screen? ", "This logo is old: ", "who", "Arrange these: ", "What connects these: ", "Portfolio Builder. "]
_LEADS_SQL = "[" + ", ".join(f"'{x}'" for x in _LEADS) + "]"


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    lead = F.get(F.array(*[F.lit(x) for x in _LEADS]), (F.col("doc_id") % len(_LEADS)).cast("int"))
    body = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.coalesce("text", F.lit("")))
    return table(spark, sf, "documents").select("doc_id", "lang", "source", F.concat(lead, body).alias("q"))


_TEXTS_SQL = f"SELECT doc_id, lang, source, {_LEADS_SQL}[1 + doc_id % {len(_LEADS)}] || CASE WHEN doc_id % 5 = 0 THEN '' ELSE coalesce(text, '') END AS q FROM documents"


@query(f"""SELECT doc_id, {' OR '.join(f"regexp_matches(l, '{p}')" for p in rules.VISUAL_ONLY)} OR (len(regexp_extract_all(q, '[^\\s\\x0B]+')) <= 4 AND regexp_matches(l, 'identify|who|which')) AS visual
    FROM (SELECT doc_id, q, lower(regexp_replace(q, '[^\\x00-\\x7F\\P{{L}}]', 'q', 'g') || ' ' || coalesce(source, '')) AS l FROM ({_TEXTS_SQL}))""")
def visual_only_questions(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("doc_id", rules.visual_only(F.col("q"), F.col("source")).alias("visual"))


#: Media that documents get: none, one picture, four pictures, a sound, a film.
@query(f"""WITH t AS (SELECT doc_id, q, coalesce(source, '') AS s, doc_id % 7 AS m, CASE doc_id % 10 WHEN 1 THEN 'CLOSING_BELL' WHEN 2 THEN 'POTPOURRI' WHEN 3 THEN 'LIST_IT' WHEN 4 THEN 'IMAGE_REVEAL' WHEN 5 THEN 'TICKER_TANGLE' ELSE '' END AS r FROM ({_TEXTS_SQL})),
    b AS (SELECT *, trim(regexp_replace(q, '[^\\x00-\\x7F\\P{{L}}]', 'q', 'g') || ' ' || s || ' ' || r) AS x FROM t)
    SELECT doc_id, CASE WHEN regexp_matches(x, '{formats.STEPPED_WORDS}') THEN 'STEPPED_CLUE' WHEN regexp_matches(x, '{formats.ARRANGE_WORDS}') OR r = 'TICKER_TANGLE' THEN 'ARRANGE_ORDER' WHEN regexp_matches(x, '{formats.CONNECT_WORDS}') OR m = 2 THEN 'CONNECT_4'
        WHEN r = 'CLOSING_BELL' THEN 'BUZZER' WHEN r <> '' THEN r WHEN m = 4 THEN 'VIDEO_CLUE' WHEN m = 3 THEN 'AUDIO_CLUE' WHEN m = 1 THEN 'VISUAL_CLUE' ELSE 'QA' END AS format FROM b""")
def structured_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Formats by wording, round and media; the payload's own type must say the same."""
    m, r = F.col("doc_id") % 7, F.col("doc_id") % 10
    many = lambda n: F.array(*[F.concat(F.lit(f"f{i}-"), "doc_id") for i in range(n)]).cast("array<string>")
    code = F.when(r == 1, "CLOSING_BELL").when(r == 2, "POTPOURRI").when(r == 3, "LIST_IT").when(r == 4, "IMAGE_REVEAL").when(r == 5, "TICKER_TANGLE")
    some = formats.structured(F.col("q"), F.col("lang"), F.lit(None).cast("array<string>"), F.when(m == 1, many(1)).when(m == 2, many(4)), F.when(m == 3, many(1)), F.when(m == 4, many(2)), F.col("source"), code)
    out = _texts(spark, sf).select("doc_id", some.alias("s"))
    return out.where(F.get_json_object("s.payload", "$.type") == F.col("s.format")).select("doc_id", "s.format")


@query("""WITH e AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'deck_year' WHEN 1 THEN 'star_marked' WHEN 2 THEN 'question_format' WHEN 3 THEN 'answer_type' WHEN 4 THEN 'india_international' WHEN 5 THEN 'language' WHEN 6 THEN 'city_name' WHEN 7 THEN 'id' ELSE 'round_number' END AS field,
      CASE WHEN event_id % 4 = 0 THEN ' ' WHEN event_id % 9 IN (0, 8) THEN CASE WHEN event_id % 2 = 0 THEN ' ' || user_id || ' ' ELSE value::VARCHAR || 'x' END WHEN event_id % 9 = 1 THEN 'Yes' WHEN event_id % 9 = 2 THEN 'connect 4' WHEN event_id % 9 = 3 THEN 'text image' WHEN event_id % 9 = 4 THEN 'in' ELSE event_type END AS raw FROM events),
    p AS (SELECT *, nullif(trim(raw), '') AS v FROM e WHERE field <> 'id'),
    c AS (SELECT event_id, field, CASE WHEN field IN ('deck_year', 'round_number') THEN TRY_CAST(v AS INTEGER)::VARCHAR WHEN field = 'star_marked' AND v IS NOT NULL THEN (lower(v) IN ('1', 'true', 'yes', 'y'))::VARCHAR WHEN field IN ('question_format', 'answer_type') THEN replace(upper(v), ' ', '_')
      WHEN field = 'india_international' THEN upper(v) WHEN field = 'language' THEN coalesce(v, 'English') ELSE v END AS value, CASE WHEN field IN ('deck_year', 'round_number') AND v IS NOT NULL AND TRY_CAST(v AS INTEGER) IS NULL THEN 'no whole number: ' || raw WHEN field = 'question_format' AND v IS NOT NULL AND event_id % 9 = 2 THEN 'unknown question format: ' || raw END AS problem FROM p)
    SELECT event_id, field, CASE WHEN problem IS NULL THEN value END AS value, problem FROM c""")
def edits_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Events as edits of fields; connect 4 is no format of this bank."""
    k, n = F.col("event_id"), F.col("event_id") % 9
    fields = ["deck_year", "star_marked", "question_format", "answer_type", "india_international", "language", "city_name", "id", "round_number"]
    number = F.when(k % 2 == 0, F.concat(F.lit(" "), "user_id", F.lit(" "))).otherwise(F.concat(F.col("value").cast("string"), F.lit("x")))
    raw = F.when(k % 4 == 0, " ").when(n.isin(0, 8), number).when(n == 1, "Yes").when(n == 2, "connect 4").when(n == 3, "text image").when(n == 4, "in").otherwise(F.col("event_type"))
    e = table(spark, sf, "events").select("event_id", F.get(F.array(*[F.lit(f) for f in fields]), n.cast("int")).alias("field"), raw.alias("raw"))
    return review.checked_edits(e, ["QA", "STEPPED_CLUE"]).select("event_id", "field", "value", "problem")


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey % 9 AS deck, o_shippriority AS place, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey - o_orderkey % 5 END AS orig, CASE o_orderkey % 4 WHEN 1 THEN 'MERGE' WHEN 2 THEN 'CONFIRM_DUPLICATE' WHEN 3 THEN 'DISMISS_UNIQUE' END AS act FROM (SELECT o_orderkey, o_custkey, length(o_orderpriority) AS o_shippriority FROM orders)),
    c AS (SELECT b.k AS q, a.deck, a.place, a.deck IS DISTINCT FROM b.deck AS far, a.k AS copy FROM o a JOIN o b ON a.orig = b.k WHERE a.act IN ('MERGE', 'CONFIRM_DUPLICATE')),
    n AS (SELECT q, count(*) AS n FROM (SELECT DISTINCT q, deck, place FROM c WHERE far) GROUP BY q), d AS (SELECT q, array_to_string(list_sort(list(DISTINCT deck)), ',') AS decks FROM c WHERE far GROUP BY q), m AS (SELECT q, count(*) AS m FROM c WHERE NOT far GROUP BY q)
    SELECT k, CASE WHEN act IN ('MERGE', 'CONFIRM_DUPLICATE') THEN 'CONFIRMED_DUPLICATE' WHEN act IS NOT NULL THEN 'RESOLVED' END AS duplicate_status, CASE WHEN coalesce(n, 0) + coalesce(m, 0) > 0 THEN 1 + coalesce(n, 0) + coalesce(m, 0) END AS occurrence_count, decks AS provenance
    FROM o LEFT JOIN n ON n.q = k LEFT JOIN d ON d.q = k LEFT JOIN m ON m.q = k WHERE k NOT IN (SELECT copy FROM c WHERE far)""")
def copies_resolved(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as questions, of which some are copies of others: copies from other decks leave their deck and place behind."""
    k = F.col("o_orderkey")
    act = F.when(k % 4 == 1, "merge").when(k % 4 == 2, "CONFIRM_DUPLICATE").when(k % 4 == 3, "DISMISS_UNIQUE")
    o = table(spark, sf, "orders").select(
        k.alias("k"), (F.col("o_custkey") % 9).alias("deck"), F.length("o_orderpriority").alias("place"), F.when(k % 5 > 0, k - k % 5).alias("orig"), act.alias("action"), F.lit(None).cast("string").alias("duplicate_status"),
        F.lit(None).cast("long").alias("occurrence_count"), F.lit(None).cast("array<bigint>").alias("provenance"),
    ).withColumn("deck", F.col("deck").cast("long"))
    out, _ = vault.resolved_vault(o.drop("action"), o.where("action IS NOT NULL").select("k", "action"), "k", "orig", "deck", "place")
    return out.select("k", "duplicate_status", "occurrence_count", F.when(F.col("provenance").isNotNull(), F.array_join(F.col("provenance").cast("array<string>"), ",")).alias("provenance"))


def _labelled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Parts as labelled questions with something wrong in many, and a taxonomy of brands."""
    k = F.col("p_partkey")
    p = table(spark, sf, "part")
    tax = p.select(F.concat(F.lit("T"), F.length("p_brand")).alias("l1"), F.col("p_brand").alias("l2")).where("l2 <> 'Brand#7'").distinct()
    gold = p.select(
        (k - F.when(k % 50 == 1, 1).otherwise(0)).alias("id"), F.concat(F.lit("T"), F.when(k % 9 == 0, 1).otherwise(F.length("p_brand"))).alias("gold_l1"), F.col("p_brand").alias("gold_l2"),
        F.when(k % 6 == 0, F.concat_ws("|", "p_type", F.lit(" Brand#9 "))).alias("alt_l2"), F.when(k % 8 > 0, "IN").otherwise("MARS").alias("geography"), F.concat_ws(" ", "p_name", F.lit("!"), F.col("p_size").cast("string")).alias("question_text"),
    )
    return gold, tax


@query("""WITH g AS (SELECT p_partkey - CASE WHEN p_partkey % 50 = 1 THEN 1 ELSE 0 END AS id, 'T' || CASE WHEN p_partkey % 9 = 0 THEN 1 ELSE length(p_brand) END AS l1, p_brand AS l2, p_partkey % 6 = 0 AS alt, p_type, p_partkey % 8 = 0 AS mars, p_name || ' ' || p_size AS t FROM part),
    f AS (SELECT id, min(id) OVER (PARTITION BY t) AS first FROM g)
    SELECT id, 'unknown label' AS problem, l2 AS detail FROM g WHERE l2 = 'Brand#7' UNION ALL SELECT id, 'wrong theme', 'T' || length(l2) FROM g WHERE l2 <> 'Brand#7' AND l1 <> 'T' || length(l2) UNION ALL SELECT id, 'bad geography', 'MARS' FROM g WHERE mars
    UNION ALL SELECT id, 'unknown alternative', p_type FROM g WHERE alt UNION ALL SELECT id, 'repeated key', count(*)::VARCHAR FROM g GROUP BY id HAVING count(*) > 1 UNION ALL SELECT id, 'repeated text', first::VARCHAR FROM f WHERE id <> first""")
def label_problems(spark: SparkSession, sf: str) -> DataFrame:
    gold, tax = _labelled(spark, sf)
    return evaluate.gold_problems(gold, "id", tax, {"geography": ["IN", "INTL", "MIXED"]}, "question_text")


@query("""WITH r AS (SELECT p_partkey AS id, p_brand AS gold_l2, 'T' || length(p_brand) AS gold_l1, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN 'Brand#9' ELSE 'Brand#7' END AS pred_l2, p_partkey % 2 = 0 AS has_alt, p_size % 2 = 0 AS geo, p_partkey % 5 AS kw, p_name FROM part),
    s AS (SELECT *, pred_l2 <> 'Brand#7' AND pred_l2 IN (SELECT p_brand FROM part) AS valid FROM r)
    SELECT id, coalesce(valid AND 'T' || length(pred_l2) = gold_l1, false) AS l1_strict, valid AND pred_l2 = gold_l2 AS l2_strict, valid AND (pred_l2 = gold_l2 OR (has_alt AND pred_l2 = 'Brand#9')) AS l2_lenient, geo, kw IN (0, 1) AS kw_format, kw <> 2 AS kw_answer FROM s""")
def predictions_scored(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as predictions: every third is right, every second accepts another brand."""
    k, n = F.col("p_partkey"), F.col("p_partkey") % 5
    gold, tax = _labelled(spark, sf)
    said = F.when(k % 3 == 0, F.col("p_brand")).when(k % 3 == 1, "Brand#9").otherwise("Brand#7")
    name = lambda *more: F.array(F.col("p_name"), *[F.lit(x) for x in more])
    words = F.when(n == 0, name("one", "two", "six")).when(n == 1, name("a", "b", "c", "d", "e", "f")).when(n == 2, F.array(F.lit("x"))).when(n == 3, name("This!", "b", "c")).otherwise(name(*"abcdefgh"))
    rows = table(spark, sf, "part").select(
        k.alias("id"), F.col("p_brand").alias("gold_l2"), F.concat(F.lit("T"), F.length("p_brand")).alias("gold_l1"), said.alias("pred_l2"), F.when(k % 2 == 0, "x|Brand#9").alias("alt_l2"), F.concat("p_name", F.lit(" / other")).alias("answer"), words.alias("keywords"),
        F.lit("IN").alias("geography"), F.when(F.col("p_size") % 2 == 0, "IN").alias("pred_geo"),
    )
    return evaluate.scored(rows, "id", tax, {"geo": ("pred_geo", "geography")})


@query("""SELECT gold, pred, count(*) AS n, coalesce(arg_min(ok, o_orderkey), false) AS accepted FROM (SELECT o_orderkey, o_orderstatus AS gold, substr(o_orderpriority, 1, 1) AS pred, o_orderkey % 3 = 0 AS ok FROM orders) WHERE gold <> pred GROUP BY 1, 2 ORDER BY n DESC, gold, pred LIMIT 15""")
def confusion_accepted(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("gold"), F.substring("o_orderpriority", 1, 1).alias("pred"), (F.col("o_orderkey") % 3 == 0).alias("ok"))
    return evaluate.confusion(o, "gold", "pred", lenient="ok", at="o_orderkey")


@query(f"""WITH c AS (SELECT doc_id, {_COS} AS sim, (source IN ('src1', 'src2', 'src3'))::INT + (lang = 'fr')::INT AS ov,
      CAST(contains(lower(text), 'license') AS INT) + CAST(contains(lower(text), 'ea') AS INT) + CASE WHEN n_chars > 3000 THEN 0.5 ELSE 0 END::DOUBLE AS lex FROM documents JOIN embeddings ON doc_id = vec_id, (SELECT {_QV} AS v) WHERE lang <> 'en'),
    p AS (SELECT *, lex + 5 * ov AS sp FROM c ORDER BY sim DESC, doc_id LIMIT 60), r AS (SELECT *, row_number() OVER (ORDER BY sim DESC, doc_id) AS rd, row_number() OVER (ORDER BY sp DESC, doc_id) AS rs FROM p)
    SELECT doc_id, CAST(rd AS INTEGER) AS rank_dense, CAST(rs AS INTEGER) AS rank_sparse, round((1.0 / (60 + rd) + 1.0 / (60 + rs)) * (1 + 0.5 * ov), 8) AS score FROM r ORDER BY round((1.0 / (60 + rd) + 1.0 / (60 + rs)) * (1 + 0.5 * ov), 8) DESC, doc_id LIMIT 15""")
def tagged_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Fused search within a filter, with tags that lift a row, words, and a wanted difficulty."""
    vec = table(spark, sf, "embeddings")
    v = vec.where("vec_id = 7").select("embedding").first()
    rows = table(spark, sf, "documents").join(vec, F.col("doc_id") == F.col("vec_id")).withColumn("ov", F.col("source").isin("src1", "src2", "src3").cast("int") + (F.col("lang") == "fr").cast("int"))
    words = search.lexical_score(F.col("text"), ["license", "ea"], F.when(F.col("n_chars") > 3000, "Hard").otherwise("Easy"), "hard", F.col("ov"))
    found = search.hybrid_within(rows, F.col("lang") != "en", "doc_id", v[0] if v else [0.0], words, limit=15, overlap=F.col("ov"))
    return found.select("doc_id", "rank_dense", "rank_sparse", F.round("score", 8).alias("score"))


@query("""WITH p AS (SELECT p_partkey, p_partkey % 8 AS m, 1 + p_partkey % 28 AS d, 1 + p_partkey % 12 AS mo, 2000 + p_partkey % 60 AS y FROM part)
    SELECT p_partkey, CASE WHEN m < 4 THEN make_date(y, mo, d) END AS date, CASE WHEN m < 6 THEN y END AS year FROM p""")
def titles_dated(spark: SparkSession, sf: str) -> DataFrame:
    """Parts' names as titles with dates in many forms."""
    k = F.col("p_partkey")
    d, m, y = 1 + k % 28, 1 + k % 12, 2000 + k % 60
    month = F.get(F.split(F.lit("January Feb March Apr. May June Jul Aug. September Oct Nov December"), " "), (m - 1).cast("int"))
    said = F.when(k % 8 == 0, F.concat_ws("-", y, m, d)).when(k % 8 == 1, F.concat_ws(".", d, m, y % 100 + 100)).when(k % 8 == 2, F.format_string("%dth %s, %d", d, month, y)).when(k % 8 == 3, F.format_string("%s %d %d", month, d, y))
    said = F.when(k % 8 == 1, F.format_string("%d/%d/%02d", d, m, y % 100)).otherwise(said)
    said = F.coalesce(said, F.when(k % 8 == 4, F.format_string("%s %d", month, y)).when(k % 8 == 5, F.format_string("the %d cup", y)).when(k % 8 == 6, F.lit("31-02-20x4 1999")).otherwise(""))
    return table(spark, sf, "part").select("p_partkey", text.title_date(F.concat_ws(" ", "p_name", said, "p_type")).alias("t")).select("p_partkey", "t.*")


@query(f"""WITH t AS ({_EVENTS_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY status = 'confirmed' DESC, ts DESC, event_id DESC) AS k FROM t), d AS (SELECT c_custkey AS user_id, c_mktsegment AS l2 FROM customer WHERE c_custkey % 4 = 0)
    SELECT event_id, user_id, CASE WHEN k = 1 AND status = 'confirmed' AND user_id IN (SELECT user_id FROM d) THEN 'superseded' ELSE status END AS status, source, topic_l1, subtopic_l2, fit, confidence, NULL AS verified_by FROM r
    UNION ALL SELECT NULL, user_id, 'confirmed', 'HUMAN', CASE WHEN l2 <> 'MACHINERY' THEN 'Seg ' || substr(l2, 1, 1) END, l2, 'good', 1.0, 'ann' FROM d""")
def human_overrides(spark: SparkSession, sf: str) -> DataFrame:
    """Events as tags of users; every fourth customer is tagged anew by hand."""
    c = table(spark, sf, "customer")
    tax = c.where("c_mktsegment <> 'MACHINERY'").select(F.concat(F.lit("Seg "), F.substring("c_mktsegment", 1, 1)).alias("l1"), F.col("c_mktsegment").alias("l2")).distinct()
    said = c.where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("subtopic_l2"))
    out = history.overridden(_events(spark, sf), said, "user_id", "ts", "event_id", tax, F.current_timestamp(), "ann")
    return out.select("event_id", "user_id", "status", "source", "topic_l1", "subtopic_l2", "fit", "confidence", "verified_by")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN array_to_string(CASE WHEN p_type = p_brand THEN [p_type] ELSE [p_type, p_brand] END, ',') ELSE 'old' END AS tags, CASE WHEN p_partkey % 5 = 0 THEN p_type WHEN p_partkey % 4 = 0 THEN p_name ELSE 'was' END AS topic,
    CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE 'seen' END AS visual_clues FROM part""")
def questions_patched(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as questions: some get new tags, topics, or lose their clues."""
    k = F.col("p_partkey")
    p = table(spark, sf, "part")
    rows = p.select("p_partkey", F.array(F.lit("old")).alias("tags"), F.lit("was").alias("topic"), F.lit("seen").alias("visual_clues"))
    patches = p.select(
        "p_partkey", F.when(k % 3 == 0, F.array(F.concat(F.lit(" #"), "p_type"), F.lit(" "), F.lower("p_type"), F.col("p_brand"))).alias("tags"), F.when(k % 4 == 0, F.array(F.lit(""), F.concat(F.lit(" "), "p_name"), F.col("p_name"))).alias("topics"),
        F.when(k % 5 == 0, F.concat("p_type", F.lit(" "))).alias("topic"), F.when(k % 2 == 0, " ").alias("visual_clues"),
    )
    return review.patched_questions(rows, patches, "p_partkey").select("p_partkey", F.array_join("tags", ",").alias("tags"), "topic", "visual_clues")


_CITIES_SQL = "CASE " + " ".join(f"WHEN regexp_matches(l, '(?:^|[^a-z0-9_])(?:{c})(?:$|[^a-z0-9_])') THEN '{c.title()}|{r}|{g}'" for t, g in ((rules.CITIES_IN, "IN"), (rules.CITIES_INTL, "INTL")) for c, r in t.items()) + " END"
_THEMES_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(l, '(?:^|[^a-z0-9_])(?:{'|'.join(n)})(?:$|[^a-z0-9_])') THEN '{t}' END" for t, n in rules.BRAND_THEMES.items()) + "], lambda x: x IS NOT NULL)"


@query(f"""SELECT doc_id, {_CITIES_SQL} AS city, array_to_string({_THEMES_SQL}, ',') AS themes FROM (SELECT doc_id, lower(['', 'In New Delhi, RBI and the ipl; ', 'paris nseé Sebi, ', 'goan lic? san francisco '][1 + doc_id % 4] || regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F\\P{{L}}]', 'q', 'g')) AS l FROM documents)""")
def rule_places(spark: SparkSession, sf: str) -> DataFrame:
    """The first city that a text names, and the themes of the brands in it."""
    head = F.get(F.array(*[F.lit(x) for x in ("", "In New Delhi, RBI and the ipl; ", "paris nseé Sebi, ", "goan lic? san francisco ")]), (F.col("doc_id") % 4).cast("int"))
    t = F.concat(head, F.coalesce("text", F.lit("")))
    d = table(spark, sf, "documents").select("doc_id", rules.city(t).alias("c"), rules.brand_themes(t).alias("b"))
    return d.select("doc_id", F.when(F.col("c").isNotNull(), F.concat_ws("|", "c.city", "c.region", "c.geography")).alias("city"), F.array_join("b", ",").alias("themes"))
