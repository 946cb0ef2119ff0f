"""Queries over the question bank: here ``documents``, with ``source`` as topic and ``lang`` as language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules, text, vectors
from ..operators import curate, dedup, evaluate, relational, requests, search
from ..sources import files
from .registry import query, table

STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
#: SQL of the same tokens.
TOKS = f"list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({STOP}))"
CANON = r"trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
#: This year, as a parameter, so that results do not change with the calendar.
YEAR = 2025
SEARCH = {"erandst": 1.0, "thtion": 1.0, "on": 1.0, "oren": 0.4, "rerer": 0.4}
SEARCH_SQL = "(VALUES " + ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in SEARCH.items()) + ") q(term, w)"


@query("SELECT source, CAST(count(*) AS BIGINT) AS n FROM documents WHERE source IS NOT NULL GROUP BY source")
def topic_counts(spark: SparkSession, sf: str) -> DataFrame:
    return relational.counts_by(table(spark, sf, "documents"), "source")


@query("""SELECT count(*) AS docs, count(DISTINCT source) AS topics, (SELECT count(*) FROM labels) AS labels, (SELECT count(DISTINCT conv_id) FROM conversations) AS decks,
    count(*) FILTER (lang = 'en') AS english FROM documents""")
def dashboard_stats(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").agg(F.count("*").alias("labels"))
    decks = table(spark, sf, "conversations").agg(F.count_distinct("conv_id").alias("decks"))
    one = table(spark, sf, "documents").agg(F.count("*").alias("docs"), F.count_distinct("source").alias("topics"), F.count_if(F.col("lang") == "en").alias("english"))
    return one.join(labels).join(decks)


@query("""SELECT source, count(*) AS total, count(*) FILTER (coalesce(lang, 'en') = 'en') AS n_en, count(*) FILTER (lang = 'fr') AS n_fr, count(*) FILTER (lang = 'de') AS n_de, count(*) FILTER (lang = 'es') AS n_es,
    min(n_chars) FILTER (n_chars > 0) AS lowest, max(n_chars) FILTER (n_chars > 0) AS highest, array_to_string(list_sort(list(DISTINCT lang)), '|') AS parts FROM documents GROUP BY source""")
def topic_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = relational.topic_summary(table(spark, sf, "documents"), "source", "lang", ["en", "fr", "de", "es"], "en", "n_chars", "n_chars", "lang")
    return out.withColumn("parts", F.array_join("parts", "|"))


@query(f"SELECT tag, count(*) AS n, array_to_string(list_sort(list(DISTINCT source)), '|') AS topics FROM (SELECT DISTINCT doc_id, source, unnest(list_distinct({TOKS})) AS tag FROM documents) GROUP BY tag HAVING count(*) > 2")
def tag_index(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").select("doc_id", "source", F.explode(F.array_distinct(text.tokens(F.col("text")))).alias("tag"))
    return t.groupBy("tag").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("source")), "|").alias("topics")).where("n > 2")


@query("""WITH t AS (SELECT DISTINCT l_orderkey AS o, p_type AS tag FROM lineitem JOIN part ON l_partkey = p_partkey),
    c AS (SELECT a.tag, b.tag AS other, count(*) AS n FROM t a JOIN t b ON a.o = b.o AND lower(a.tag) <> lower(b.tag) GROUP BY 1, 2),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY tag ORDER BY n DESC, other) AS INTEGER) AS rank FROM c) SELECT * FROM r WHERE rank <= 3""")
def tag_cooccurrence_top3(spark: SparkSession, sf: str) -> DataFrame:
    tags = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.col("p_type").alias("tag"))
    return relational.co_occurrence(tags, "l_orderkey", "tag")


@query("""WITH d AS (SELECT d.*, toxic, quality FROM documents d LEFT JOIN labels USING (doc_id)), r AS (SELECT coalesce(lang = 'en', false) AS f, coalesce(toxic = 0, false) AS s, coalesce(quality = 1, false) AS q FROM d)
    SELECT count(*) AS total, count(*) FILTER (f AND s AND q) AS passing, count(*) FILTER (NOT f AND s AND q) AS only_format, count(*) FILTER (f AND NOT s AND q) AS only_safe, count(*) FILTER (f AND s AND NOT q) AS only_fit FROM r""")
def blocked_only_by(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return relational.blocked_only_by(d, {"format": F.col("lang") == "en", "safe": F.col("toxic") == 0, "fit": F.col("quality") == 1})


@query(f"SELECT term, CAST(count(*) AS BIGINT) AS df, round(ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM (SELECT DISTINCT doc_id, unnest({TOKS}) AS term FROM documents) GROUP BY term")
def bm25_stats(spark: SparkSession, sf: str) -> DataFrame:
    return search.build(table(spark, sf, "documents"), "doc_id", text.tokens(F.col("text"))).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"""WITH d AS (SELECT doc_id, {TOKS} AS bag FROM documents), st AS (SELECT count(*) AS n, avg(len(bag)) AS avgdl FROM d),
    p AS (SELECT doc_id, len(bag) AS dl, unnest(bag) AS term FROM d), tf AS (SELECT doc_id, term, any_value(dl) AS dl, count(*) AS tf FROM p GROUP BY 1, 2),
    idf AS (SELECT term, ln(1 + ((SELECT n FROM st) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY term),
    s AS (SELECT doc_id, sum(w * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM st)))) AS score FROM tf JOIN idf USING (term) JOIN {SEARCH_SQL} USING (term) GROUP BY doc_id)
    SELECT doc_id, round(score, 6) AS score FROM s ORDER BY round(score, 6) DESC, doc_id LIMIT 50""")
def bm25_search(spark: SparkSession, sf: str) -> DataFrame:
    found = search.scores(table(spark, sf, "documents"), "doc_id", text.tokens(F.col("text")), SEARCH)
    return found.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


_QV = "(SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) FROM embeddings WHERE vec_id = 7)"
_COS = "round(list_dot_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), v) / sqrt(list_dot_product(v, v) * list_dot_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), list_transform(embedding, lambda x: CAST(x AS DOUBLE)))), 6)"


@query(f"""WITH c AS (SELECT doc_id, {_COS} AS sim, CAST((CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(text), 'ea') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(text), 'unge') THEN 1 ELSE 0 END) AS DOUBLE) AS lex
    FROM documents JOIN embeddings ON doc_id = vec_id, (SELECT {_QV} AS v)),
    p AS (SELECT * FROM c ORDER BY sim DESC, doc_id LIMIT 60), r AS (SELECT *, row_number() OVER (ORDER BY sim DESC, doc_id) AS rd, row_number() OVER (ORDER BY lex DESC, doc_id) AS rs FROM p)
    SELECT doc_id, CAST(rd AS INTEGER) AS rank_dense, CAST(rs AS INTEGER) AS rank_sparse, round(1.0 / (60 + rd) + 1.0 / (60 + rs), 8) AS score FROM r ORDER BY round(1.0 / (60 + rd) + 1.0 / (60 + rs), 8) DESC, doc_id LIMIT 10""")
def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    vec = table(spark, sf, "embeddings")
    v = vec.where("vec_id = 7").select("embedding").first()
    rows = table(spark, sf, "documents").join(vec, F.col("doc_id") == F.col("vec_id"))
    found = search.hybrid(rows, "doc_id", v[0] if v else [0.0], search.lexical_score(F.col("text"), ["the", "ea", "unge"]))
    return found.select("doc_id", "rank_dense", "rank_sparse", F.round("score", 8).alias("score"))


_PAIR = "list_dot_product(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE)))"


@query(f"""WITH s AS (SELECT a.vec_id AS id, b.vec_id AS other, {_PAIR} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
    r AS (SELECT id, other, round(sim, 4) AS sim, CAST(row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 5""")
def knn_top5(spark: SparkSession, sf: str) -> DataFrame:
    vec = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return dedup.neighbours(vec.where("id % 20 = 0"), vec, -2.0, 5).withColumn("sim", F.round("sim", 4))


@query("""SELECT doc_id, sha256(c) AS key_hash, min(doc_id) OVER (PARTITION BY c) AS first_id, doc_id <> min(doc_id) OVER (PARTITION BY c) AS is_repeat
    FROM (SELECT doc_id, """ + CANON + """ || '|||' AS c FROM documents)""")
def exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", text.content_hash(F.col("text"), F.lit("")).alias("key_hash"))
    return dedup.exact_repeats(d, F.col("key_hash"), "doc_id").select("doc_id", "key_hash", "first_id", "is_repeat")


@query(f"""WITH s AS (SELECT doc_id, list_sort(list_distinct({TOKS})) AS t FROM documents), c AS (SELECT min(doc_id) AS doc_id, t FROM s WHERE len(t) > 0 GROUP BY t), e AS (SELECT doc_id, len(t) AS n, unnest(t) AS w FROM c),
    i AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM e a JOIN e b ON a.w = b.w AND a.doc_id < b.doc_id GROUP BY 1, 2)
    SELECT a, b, round(c / CAST(na + nb - c AS DOUBLE), 6) AS sim FROM i WHERE c / CAST(na + nb - c AS DOUBLE) > 0.7 UNION ALL SELECT c.doc_id, s.doc_id, 1.0 FROM s JOIN c ON s.t = c.t AND s.doc_id <> c.doc_id""")
def near_dup_jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Links between the first rows of equal token sets, and of each further row to the first of its set; sets of whole texts."""
    return dedup.near_pairs(table(spark, sf, "documents"), "doc_id", text.tokens(F.col("text")), 0.7).withColumn("sim", F.round("sim", 6))


def _canon(c: str) -> str:
    return CANON.replace("coalesce(text, '')", f"coalesce({c}, '')")


_UNIT = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
_ANSWER_STOP = ", ".join(f"'{w}'" for w in vectors.ANSWER_STOP)


@query(f"""WITH v AS (SELECT vec_id AS id, trim(coalesce(text, '')) AS q, trim(coalesce(lang, '')) AS a, {_UNIT} AS e FROM embeddings JOIN documents ON vec_id = doc_id WHERE embedding IS NOT NULL),
    c AS (SELECT id, q, a, {_canon('q')} AS cq, {_canon('a')} AS ca, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e, length(q) < 15 OR len(regexp_extract_all(q, '[a-zA-Z]{{3,}}')) < 3 AS thin FROM v),
    w AS (SELECT *, list_filter(string_split(ca, ' '), lambda x: x <> '' AND x NOT IN ({_ANSWER_STOP})) AS wa FROM c),
    p AS (SELECT x.id, y.id AS other, y.id % 10 <> 0 AS kept, list_dot_product(x.e, y.e) AS sim, x.q AS xq, y.q AS yq, x.a AS xa, y.a AS ya, x.cq AS xcq, y.cq AS ycq, x.ca AS xca, y.ca AS yca, x.wa AS xw, y.wa AS yw, x.thin
        FROM w x JOIN w y ON x.id % 10 = 0 AND x.id <> y.id AND (y.id % 10 <> 0 OR y.id < x.id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY id, kept ORDER BY sim DESC, other) AS rank FROM p WHERE sim >= 0.3::DOUBLE),
    ok AS (SELECT * FROM r WHERE (NOT kept OR rank <= 5) AND yq <> '' AND (NOT thin OR xcq = ycq)
        AND (xa = '' OR ya = '' OR contains(yca, xca) OR contains(xca, yca) OR list_has_any(xw, yw) OR (xca <> '' AND contains(ycq, xca)) OR (yca <> '' AND contains(xcq, yca)) OR sim >= 0.97::DOUBLE)),
    b AS (SELECT id, arg_min({{'o': other, 's': sim}}, rank + CASE WHEN kept THEN 0 ELSE 1000000 END) AS hit FROM ok GROUP BY id)
    SELECT v.vec_id AS id, CASE WHEN b.id IS NULL THEN 'UNIQUE' ELSE 'POSSIBLE_DUPLICATE' END AS duplicate_status, hit.o AS duplicate_of_id, round(hit.s, 3) AS duplicate_similarity
    FROM embeddings v JOIN documents ON vec_id = doc_id LEFT JOIN b ON b.id = v.vec_id WHERE v.vec_id % 10 = 0""")
def vault_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Duplicate flags of a batch (every tenth vector) against the others, with plausibility guards, at a threshold the vectors reach."""
    vec = table(spark, sf, "embeddings").join(table(spark, sf, "documents"), F.col("vec_id") == F.col("doc_id"))
    q = vec.select(F.col("vec_id").alias("id"), F.col("text").alias("question"), F.col("lang").alias("answer"), "embedding")
    return dedup.flagged(q.where("id % 10 = 0"), q.where("id % 10 <> 0"), threshold=0.3)


@query("""WITH w AS (SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE toxic = 0 AND (quality = 1))
    SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.doc_id = d.doc_id)""")
def needs_review(spark: SparkSession, sf: str) -> DataFrame:
    fine = table(spark, sf, "labels").where("toxic = 0 AND quality = 1").select("doc_id")
    return table(spark, sf, "documents").join(fine, "doc_id", "left_anti").select("doc_id", "lang")


@query("""WITH a AS (SELECT doc_id, source, 0 AS p FROM documents WHERE text ILIKE '%license%'), b AS (SELECT doc_id, source, 1 AS p FROM documents WHERE lang = 'fr'),
    u AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS r FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) SELECT doc_id, source, p AS priority FROM u WHERE r = 1 ORDER BY p, doc_id LIMIT 40""")
def priority_union(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    a = d.where(relational.contains_any([F.col("text")], "license")).select("doc_id", "source")
    return relational.priority_union([a, d.where("lang = 'fr'").select("doc_id", "source")], "doc_id", "doc_id", 40)


@query("""SELECT 'none' AS wish, doc_id, lang FROM documents WHERE lang = 'xx' OR NOT EXISTS (SELECT 1 FROM documents WHERE lang = 'xx')
    UNION ALL SELECT 'some', doc_id, lang FROM documents WHERE lang = 'fr' OR NOT EXISTS (SELECT 1 FROM documents WHERE lang = 'fr')""")
def relax_if_empty(spark: SparkSession, sf: str) -> DataFrame:
    """A wish that no row meets, which all rows answer, and one that some meet."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    wish = lambda name, lang: relational.relaxed(d, F.col("lang") == lang).select(F.lit(name).alias("wish"), "doc_id", "lang")
    return wish("none", "xx").unionByName(wish("some", "fr"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)_{3,}|\\bblanked?\\b|fill in the blank') THEN 'FILL_BLANK' WHEN regexp_matches(text, '(?i)odd one out|does ?n.?t belong|which does not') THEN 'ODD_ONE_OUT'
    WHEN regexp_matches(text, '(?i)\\bconnect\\b|what links|have in common|common (?:link|thread|factor)|identify the connect') THEN 'CONNECT'
    WHEN regexp_matches(text, '(?i)(?:^|\\n)\\s*[a-d][.)]\\s|\\bwhich of the following\\b|\\boptions?\\b') THEN 'MCQ'
    WHEN regexp_matches(text, '(?i)\\bhow (?:many|much)\\b|\\bwhat (?:percentage|number|value|year|price)\\b|\\bestimate\\b') THEN 'NUMERIC' ELSE 'STANDARD' END AS style FROM documents""")
def question_style(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.question_style(F.col("text"), F.lit("x")).alias("style"))


@query(f"""WITH d AS (SELECT doc_id, text, list_transform(regexp_extract_all(text, '\\b((?:19|20)[0-9]{{2}})\\b', 1), lambda y: CAST(y AS INTEGER)) AS ys FROM documents)
    SELECT doc_id, CASE WHEN len(list_filter(ys, lambda y: {YEAR} - y <= 3)) > 0 THEN 'TIME_SENSITIVE' WHEN len(ys) > 0 THEN 'REVIEW_YEARLY' END AS shelf_life,
    CASE WHEN regexp_matches(text, '{rules.MATURE}') THEN 'MATURE_REFERENCE' END AS sensitivity FROM d""")
def rule_signals(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", rules.shelf_life(t, YEAR).alias("shelf_life"), rules.sensitivity(t).alias("sensitivity"))


def taxonomy_sql(part: int) -> str:
    cases = " ".join(f"WHEN regexp_matches(lower(text), '(?:^|[^\\p{{L}}\\p{{N}}_])(?:{r[0]})(?:$|[^\\p{{L}}\\p{{N}}_])') THEN '{r[part]}'" for r in rules.TAXONOMY_RULES)
    return f"CASE {cases} ELSE '{('General Knowledge', 'General Trivia')[part - 1]}' END"


@query(f"SELECT doc_id, {taxonomy_sql(1)} AS l1, {taxonomy_sql(2)} AS l2 FROM documents")
def taxonomy_rules(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", rules.taxonomy(F.col("text")).alias("t")).select("doc_id", "t.*")


def _edged(pattern: str) -> str:
    """A pattern between word boundaries, for an engine whose boundaries know ASCII alone."""
    inner = pattern.removeprefix(r"\b").removesuffix(r"\b")
    return r"(?:^|[^\p{L}\p{N}_])(?:" + inner + r")(?:$|[^\p{L}\p{N}_])"


#: Rounds a decimal to two places, ties to even.
_HALF_EVEN = "lambda v: CAST(floor(v * 100) + CASE WHEN v * 100 - floor(v * 100) > 0.5 OR (v * 100 - floor(v * 100) = 0.5 AND floor(v * 100) % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / 100"
_NAMES = r"len(regexp_extract_all(q, '(?:^|[^\p{L}\p{N}_])[A-Z][a-z]+'))"
_WORDS = r"regexp_extract_all(q, '[^\t\n\x0B\f\r ]+')"
_UNITS = r"\b(\d+(\.\d+)?\s*(km|miles|meters|percent|%|feet|years|light-years))\b"


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS q, lower(coalesce(text, '')) AS l, lower(trim(coalesce(source, ''))) AS a,
        CASE doc_id % 3 WHEN 0 THEN 'Due to ' || lang WHEN 1 THEN 'overdue to' ELSE '' END AS e, CASE doc_id % 4 WHEN 0 THEN 'ask ' || source WHEN 1 THEN 'say it slowly' ELSE '' END AS nt FROM documents),
    t AS (SELECT *, regexp_extract_all(regexp_replace(a, '[^\\w\\s]', '', 'g'), '\\S+') AS toks, {_NAMES} AS names, {_WORDS} AS ws FROM d),
    o AS (SELECT *, len(list_filter(toks, lambda x: x IN ({', '.join(f"'{x}'" for x in rules.ANCHORS)}))) AS hits, len(regexp_extract_all(array_to_string(toks, ' '), '[aeiouy]+')) / greatest(len(toks), 1)::DOUBLE AS syl FROM t),
    s AS (SELECT doc_id, CASE WHEN regexp_matches(l, '{_edged(rules.LATERAL)}') THEN 0.85 WHEN regexp_matches(l, '{_edged(rules.MULTI_STEP)}') AND names >= 2 THEN 0.80 WHEN regexp_matches(l, '{_edged(rules.INFERENCE)}') THEN 0.58 WHEN regexp_matches(lower(coalesce(e, '')), '{_edged(rules.CAUSAL)}') THEN 0.50 ELSE 0.25 END::DOUBLE AS cognitive,
        CASE WHEN len(toks) = 0 THEN 0.40 WHEN hits > 0 THEN list_transform([CAST(CAST(greatest(0.12::DOUBLE, 0.35::DOUBLE - hits / len(toks)::DOUBLE * 0.20::DOUBLE) AS VARCHAR) AS DECIMAL(20,17))], {_HALF_EVEN})[1]
            ELSE greatest(0.10::DOUBLE, least(0.95::DOUBLE, list_transform([CAST(CAST(0.45::DOUBLE + CASE WHEN syl >= 3 THEN 0.22::DOUBLE WHEN syl <= 1.5 THEN -0.12::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(a, '{_edged(rules.OBSCURE_ANSWER)}') THEN 0.18::DOUBLE ELSE 0 END AS VARCHAR) AS DECIMAL(20,17))], {_HALF_EVEN})[1])) END::DOUBLE AS obscurity,
        least(1.0::DOUBLE, list_transform([CAST(CAST(0.28::DOUBLE + (regexp_matches(q, '{_edged(r"(1[0-9]{3}|20[0-9]{2})")}')::INT + (names >= 3)::INT + regexp_matches(q, '[''"][^''"]+[''"]')::INT + regexp_matches(q, '(?i){_UNITS}')::INT) * 0.18::DOUBLE AS VARCHAR) AS DECIMAL(20,17))], {_HALF_EVEN})[1]) AS specificity,
        CASE WHEN len(ws) = 0 THEN 0.30 ELSE greatest(0.10::DOUBLE, least(1.0::DOUBLE, list_transform([CAST(CAST(least(len(ws), 40) / 40.0::DOUBLE * 0.5 + len(list_filter(ws, lambda w: length(w) > 7)) / len(ws)::DOUBLE * 0.5 AS VARCHAR) AS DECIMAL(20,17))], {_HALF_EVEN})[1])) END::DOUBLE AS readability,
        least(1.0::DOUBLE, list_transform([CAST(CAST(CASE WHEN regexp_matches(l, '{_edged("(clue|hint|note|tip)")}') THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN length(trim(coalesce(nt, ''))) > 10 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(l, '\\(also known as|famously called|popularly known|nickname\\)') THEN 0.3::DOUBLE ELSE 0 END AS VARCHAR) AS DECIMAL(20,17))], {_HALF_EVEN})[1]) AS scaffolding FROM o),
    r AS (SELECT doc_id, greatest(0.08::DOUBLE, least(0.96::DOUBLE, list_transform([CAST(CAST(0.35::DOUBLE * cognitive + 0.25::DOUBLE * obscurity + 0.15::DOUBLE * specificity + 0.15::DOUBLE * readability + -0.10::DOUBLE * scaffolding AS VARCHAR) AS DECIMAL(20,17))], {_HALF_EVEN})[1])) AS score FROM s)
    SELECT doc_id, score, CASE WHEN score < 0.35::DOUBLE THEN 'Easy' WHEN score <= 0.65::DOUBLE THEN 'Medium' ELSE 'Hard' END AS band, CASE WHEN score < 0.35::DOUBLE THEN 1 WHEN score <= 0.65::DOUBLE THEN 5 ELSE 9 END AS grade_min,
    CASE WHEN score < 0.35::DOUBLE THEN 4 WHEN score <= 0.65::DOUBLE THEN 8 ELSE 12 END AS grade_max FROM r""")
def difficulty_index(spark: SparkSession, sf: str) -> DataFrame:
    """The index over whole texts; explanations and notes come from the other columns."""
    k = F.col("doc_id")
    why = F.when(k % 3 == 0, F.concat(F.lit("Due to "), "lang")).when(k % 3 == 1, "overdue to").otherwise("")
    notes = F.when(k % 4 == 0, F.concat(F.lit("ask "), "source")).when(k % 4 == 1, "say it slowly").otherwise("")
    return table(spark, sf, "documents").select("doc_id", rules.difficulty(F.col("text"), F.col("source"), why, notes).alias("d")).select("doc_id", "d.*")


@query("""SELECT doc_id, CASE WHEN coalesce(quality, 0) = 0 THEN 'draft' WHEN toxic = 1 THEN 'draft' WHEN lang = 'en' THEN 'confirmed' ELSE 'draft' END AS status,
    CASE WHEN coalesce(quality, 0) = 0 THEN 0.50 WHEN toxic = 1 THEN 0.60 WHEN lang = 'en' THEN 0.90 ELSE 0.70 END::DOUBLE AS confidence FROM documents LEFT JOIN labels USING (doc_id)""")
def tag_routing(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    geo = F.when(F.col("toxic") == 1, "IN")
    r = rules.route(F.when(F.col("quality") == 1, "good").otherwise("weak"), geo, F.when(geo.isNotNull(), "INTL"), F.array().cast("array<string>"), F.lit(None).cast("string"), F.col("lang") == "en")
    return d.select("doc_id", r.alias("r")).select("doc_id", "r.*")


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def contamination(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a benchmark passage whole; candidates share its longest word, then the text is searched."""
    words = lambda c: F.regexp_extract_all(c, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    b = table(spark, sf, "benchmark").withColumnRenamed("text", "passage")
    # Inner words of a passage are whole words of any text that holds it; its ends may be parts of words.
    inner = F.slice(words(F.col("passage")), F.lit(2), F.greatest(F.size(words(F.col("passage"))) - 2, F.lit(0)))
    longest = F.element_at(F.array_sort(inner, lambda x, y: F.when(F.length(x) != F.length(y), F.length(y) - F.length(x)).when(x < y, -1).when(x > y, 1).otherwise(0)), 1)
    keyed = b.withColumn("w", F.when(F.size(inner) > 0, longest))
    d = table(spark, sf, "documents").select("doc_id", "text")
    by_word = d.select("doc_id", F.explode(F.array_distinct(words(F.col("text")))).alias("w")).join(keyed.where("w IS NOT NULL").select("w", "item_id"), "w").select("doc_id", "item_id")
    short = keyed.where("w IS NULL").select("item_id", "passage")
    found = d.join(by_word, "doc_id").join(b, "item_id").where(F.col("text").contains(F.col("passage"))).select("doc_id", "item_id")
    return found.unionByName(_with_short(d, short))


#: Short passages up to which each text is searched for all of them.
SHORT = 1000


def _with_short(docs: DataFrame, short: DataFrame) -> DataFrame:
    """Documents that hold a passage of at most two words: few passages are broadcast, many meet the texts that have their first three characters. Every text holds an empty passage."""
    if short.limit(SHORT + 1).count() <= SHORT:
        return docs.join(F.broadcast(short), F.col("text").contains(F.col("passage"))).select("doc_id", "item_id")
    places = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)))
    grams = F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(*[F.substring(F.col("text"), i, F.lit(n)) for n in (1, 2, 3)]))))
    keyed = docs.where("text IS NOT NULL").select("doc_id", F.explode(grams).alias("g")).join(short.select("item_id", F.substring("passage", 1, 3).alias("g")), "g").select("doc_id", "item_id")
    return docs.join(keyed, "doc_id").join(short, "item_id").where(F.col("text").contains(F.col("passage"))).select("doc_id", "item_id")


@query(r"""SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, length(trim(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS n_text FROM pages""")
def html_title_text(spark: SparkSession, sf: str) -> DataFrame:
    body = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<[^>]+>", " ")
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"), F.length(F.trim(F.regexp_replace(body, r"\s+", " "))).cast("long").alias("n_text"))


@query("""WITH s AS (SELECT lang, toxic, quality FROM documents JOIN labels USING (doc_id)), e AS (SELECT 'all' AS slice, * FROM s UNION ALL SELECT 'english', * FROM s WHERE lang = 'en' UNION ALL SELECT 'clean', * FROM s WHERE toxic = 0),
    g AS (SELECT slice, count(*) AS n, count(*) FILTER (quality = 1) AS hits FROM e GROUP BY slice)
    SELECT slice, n, hits, round(100.0 * hits / n, 4) AS pct, round(100 * (hits / n::DOUBLE + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt((hits / n::DOUBLE * (1 - hits / n::DOUBLE) + 1.96 * 1.96 / (4 * n)) / n)) / (1 + 1.96 * 1.96 / n), 4) AS wilson FROM g""")
def wilson_slices(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    cut = evaluate.sliced(rows, {"all": F.lit(True), "english": F.col("lang") == "en", "clean": F.col("toxic") == 0})
    return evaluate.accuracy(cut, ["slice"], F.col("quality") == 1)


@query("SELECT o_orderstatus AS gold, substr(o_orderpriority, 1, 1) AS pred, count(*) AS n FROM orders WHERE o_orderstatus <> substr(o_orderpriority, 1, 1) GROUP BY 1, 2 ORDER BY n DESC, gold, pred LIMIT 15")
def confusion_top(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.confusion(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("gold"), F.substring("o_orderpriority", 1, 1).alias("pred")), "gold", "pred")


@query("SELECT source, avg(n_chars) AS mean_chars, median(n_chars) AS median_chars, list_sort(list(n_chars))[CAST(floor(0.95::DOUBLE * (count(*) - 1)) AS BIGINT) + 1] AS p95_chars FROM documents GROUP BY source")
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    means = d.groupBy("source").agg(F.avg("n_chars").alias("mean_chars"), F.median("n_chars").alias("median_chars"))
    high = evaluate.p95(d, "source", "n_chars").select(F.col("source").alias("__s"), F.col("p95").alias("p95_chars"))
    return means.join(high, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")


_GRAMS = "list_concat(bag, list_transform(range(1, len(bag)), lambda i: bag[i] || ' ' || bag[i + 1]))"


@query(f"""WITH d AS (SELECT doc_id, lang, {_GRAMS} AS bag FROM (SELECT doc_id, lang, {TOKS} AS bag FROM documents)), tf AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(bag) AS w FROM d) GROUP BY 1, 2),
    i AS (SELECT w, ln((SELECT count(*) FROM d) / CAST(count(*) AS DOUBLE)) AS idf FROM tf GROUP BY w HAVING count(*) < (SELECT count(*) FROM d)), x AS (SELECT doc_id, w, tf * idf AS v FROM tf JOIN i USING (w)),
    u AS (SELECT doc_id, w, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS v FROM x), s AS (SELECT a.doc_id, b.doc_id AS other, round(sum(a.v * b.v), 9) AS sim FROM u a JOIN u b ON a.w = b.w AND a.doc_id % 20 = 0 AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, other) AS k FROM s) SELECT r.doc_id, other, round(sim, 6) AS sim, d.lang FROM r JOIN d ON d.doc_id = r.other WHERE k = 1""")
def tfidf_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest other text by uni- and bigrams; rows whose id is divisible by 20 ask, all rows answer."""
    grams = evaluate.with_bigrams(text.tokens(F.col("text")))
    found = evaluate.nearest_text(table(spark, sf, "documents"), "doc_id", grams, ["lang"], F.col("doc_id") % 20 == 0)
    return found.withColumn("sim", F.round("sim", 6)).select("doc_id", "other", "sim", "lang")


@query("SELECT trim(lang) AS l1, array_to_string(list_sort(list(DISTINCT trim(source))), '|') AS l2s FROM documents WHERE trim(lang) <> '' AND trim(source) <> '' GROUP BY 1")
def live_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    return files.live_taxonomy(table(spark, sf, "documents"), "lang", "source")


@query("""WITH h AS (SELECT *, md5(doc_id || ':7') AS h FROM documents), r AS (SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS INTEGER) AS pos, count(*) OVER (PARTITION BY source) AS n FROM h)
    SELECT source, doc_id, pos FROM r WHERE pos <= CASE WHEN n >= 3 THEN 3 ELSE 1 END""")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return relational.stratified(table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id", 3, 1)


@query("""WITH t AS (SELECT doc_id, CASE WHEN n_chars > 3000 THEN 'Hard' WHEN n_chars > 1000 THEN 'Medium' ELSE 'Easy' END AS difficulty FROM documents)
    SELECT difficulty, doc_id, CAST(pos AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY difficulty ORDER BY doc_id) AS pos FROM t) WHERE pos <= CASE difficulty WHEN 'Easy' THEN 3 WHEN 'Medium' THEN 4 ELSE 2 END""")
def tier_quota(spark: SparkSession, sf: str) -> DataFrame:
    tier = F.when(F.col("n_chars") > 3000, "Hard").when(F.col("n_chars") > 1000, "Medium").otherwise("Easy")
    return relational.quotas(table(spark, sf, "documents").select("doc_id", tier.alias("difficulty")), "difficulty", ["doc_id"], {"Easy": 3, "Medium": 4, "Hard": 2})


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS g FROM orders),
    f AS (SELECT *, CASE WHEN g > 4 THEN 1 ELSE 0 END AS later FROM o WHERE g <= 12)
    SELECT o_orderkey, o_orderpriority, later, CAST(row_number() OVER (ORDER BY later, o_totalprice DESC, o_orderkey) AS INTEGER) AS pos FROM f ORDER BY pos LIMIT 12""")
def group_cap_backfill(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return relational.capped(o, "o_orderpriority", [F.desc("o_totalprice"), F.col("o_orderkey")], 4, 12).select("o_orderkey", "o_orderpriority", "later", "pos")


@query(None)
def draft_quiz(spark: SparkSession, sf: str) -> DataFrame:
    """A request over the bank, end to end: BM25 pool, hard rules, rank, guard, editor."""
    asked = spark.createDataFrame([("ten hard questions about erandst thtion",)], "prompt string")
    brief = curate.brief_of(requests.parsed(asked, F.col("prompt")).first())
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    hits = search.scores(docs, "doc_id", text.tokens(F.col("text")), search.expand(brief.query.split(), {"thtion": ["rerer oren"]}))
    none = F.array().cast("array<string>")
    bank = docs.join(hits, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("text").alias("question_text"), F.lit("").alias("answer"), F.col("lang").alias("topic_l1"), F.col("source").alias("subtopic_l2"), F.lit("").alias("geo_region"), F.lit(None).cast("string").alias("geography"),
        none.alias("question_images"), none.alias("answer_images"), F.lit("STANDARD_QA").alias("question_format"), F.col("toxic").isNotNull().alias("tagged"), F.when(F.col("toxic") == 0, "NONE").alias("sensitivity"),
        F.lit("").alias("shelf_life"), F.lit("Medium").alias("difficulty"), (F.least("n_chars", F.lit(10000)) / 10000.0).alias("difficulty_score"), "score",
    )
    pool = curate.split_pools(bank, brief).where("pool = 'on'").withColumn("fp", text.fingerprint(F.col("question_text")))
    picked = curate.compiled(pool.select("id", "subtopic_l2", "difficulty_score", "rank_score", "fp"), brief.count)
    return spark.createDataFrame([(r["id"], r["subtopic_l2"], float(r["rank_score"]), i) for i, r in enumerate(picked, 1)], "id long, subtopic_l2 string, rank_score double, position int")


@query(r"""WITH w AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[^\s\x0B\x1C-\x1F\x{85}\p{Z}]+')) AS w FROM documents) GROUP BY 1, 2),
    p AS (SELECT doc_id, CAST('0x' || substr(sha256(w), 1, 8) AS BIGINT) % 64 AS pos, n * 1.0::DOUBLE AS v FROM w UNION ALL SELECT doc_id, CAST('0x' || substr(sha256(w), 9, 8) AS BIGINT) % 64, n * 0.5::DOUBLE FROM w
      UNION ALL SELECT doc_id, CAST('0x' || substr(md5(w[k:k + 2]), 1, 8) AS BIGINT) % 64, n * 0.25::DOUBLE FROM (SELECT doc_id, w, n, unnest(range(1, length(w) - 1)) AS k FROM w)),
    s AS (SELECT doc_id, pos, sum(v) AS v FROM p GROUP BY 1, 2), m AS (SELECT doc_id, map_from_entries(list((pos, v))) AS m, sqrt(sum(v * v)) AS l FROM s GROUP BY 1)
    SELECT doc_id, list_transform(range(64), lambda i: CASE WHEN m IS NULL THEN 0 ELSE coalesce(round(m[i] / l, 6), 0) END::DOUBLE) AS embedding FROM documents LEFT JOIN m USING (doc_id)""")
def hash_embedding(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.hash_embeddings(table(spark, sf, "documents"), "doc_id", F.col("text"), 64)


@query("""SELECT doc_id, upper(lang) || ' ' || source AS label, CAST(len(regexp_extract_all(text, '[Tt]he')) AS BIGINT) AS n_hits FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 20 OFFSET 20""")
def paginate_sorted(spark: SparkSession, sf: str) -> DataFrame:
    page = relational.sorted_page(table(spark, sf, "documents"), "n_chars", ["n_chars", "doc_id"], True, 20, 20, "doc_id", "doc_id")
    return page.select("doc_id", F.concat_ws(" ", F.upper("lang"), "source").alias("label"), F.regexp_count("text", F.lit("[Tt]he")).cast("long").alias("n_hits"))


@query("""WITH k AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents) SELECT source, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (pos <= 3) AS samples FROM k GROUP BY source""")
def topic_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Only the first three ids of a source leave a partition."""
    d = table(spark, sf, "documents").select("source", "doc_id")
    r = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    few = d.withColumn("pos", r).where("pos <= 3").groupBy(F.col("source").alias("__s")).agg(F.array_join(F.sort_array(F.collect_list("doc_id")), ",").alias("samples"))
    return d.groupBy("source").agg(F.count("*").alias("n")).join(few, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
