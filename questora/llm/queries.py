"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codes, langid, mixing, packing, pieces, quality, quality_rules, secrets, simhash, site_lines, topk, toxicity, variants
from .common import cut, fold_remainder, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, bits=4)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold_remainder(F.col("doc_id"), 3) == 1
    return langid.predict(docs, langid.fit(docs, folds=3, held=1)).select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_words", "n_switches"
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)
    return found.select("query_id", "rank", "vec_id", "score")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", site_lines.page_host(F.col("url")).alias("host"), site_lines.page_text(F.col("html")).alias("text"))
    out = site_lines.dedup_lines(pages, F.col("host"), write=True)
    return out.select("page_id", "host", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    net, sample = toxicity.learnt(docs, labels, folds=5, held=0)
    scored = cut(toxicity.score(docs, net, extra=("lang",)))
    limits = toxicity.calibrate(sample, scored, labels, folds=5, held=0) if net is not None else {}
    held = fold_remainder(F.col("doc_id"), 5) == 0
    return scored.select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        (F.col("score") >= toxicity.threshold(limits, F.col("lang"))).alias("rejected"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    w = quality.fit(docs, table(spark, sf_dir, "labels"), folds=5, held=0)
    held = fold_remainder(F.col("doc_id"), 5) == 0
    return quality.score(docs, w).select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist() if books is not None else [])).encode()).hexdigest()
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return coded.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_pieces(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    with open(model, "rb") as f:
        encoded = pieces.encode(table(spark, sf_dir, "documents"), f.read())
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_simhash, op2_secrets, op3_langid, op4_mixing, op5_topk, op6_packing, op7_line_dedup, op8_toxicity, op9_quality, op10_quality_rules,
            op11_variants, op12_vector_codes, op13_pieces,
        )
    }


_WS = r"[^\x20\x09-\x0D]+"


def _secrets_sql() -> str:
    kinds = secrets.STRONG + secrets.WEAK

    def pat(p: str) -> str:
        return p.replace("'", "''")

    each = " UNION ALL ".join(
        f"SELECT rid, {n} AS ord, '{name}' AS kind, '{part}' AS part, unnest(regexp_extract_all(text, '{pat(p)}')) AS m, unnest(regexp_split_to_array(text, '{pat(p)}')[:len(regexp_extract_all(text, '{pat(p)}'))]) AS g, unnest(range(1, len(regexp_extract_all(text, '{pat(p)}')) + 1)) AS i FROM d WHERE regexp_matches(text, '{pat(p)}')"
        for n, (name, p, part) in enumerate(kinds)
    )
    strong, scope = len(secrets.STRONG), secrets.SCOPE
    assign = pat(secrets.ASSIGN)

    def near(part: str) -> str:
        return f"EXISTS (SELECT 1 FROM ok2 b WHERE b.rid = a.rid AND b.part = '{part}' AND (b.s, b.ord) <> (a.s, a.ord) AND CASE WHEN (b.s, b.ord) < (a.s, a.ord) THEN b.e >= a.s - {scope} ELSE b.s <= a.e + {scope} END)"

    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    raw AS ({each}),
    pos AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY rid, ord ORDER BY i) AS e FROM raw),
    ok1 AS (SELECT rid, ord, kind, part, CAST(e - length(m) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM pos
            WHERE kind <> 'assign' OR length(regexp_extract(m, '{assign}', 2)) >= {secrets.MIN_ASSIGN}),
    ok2 AS (SELECT * FROM ok1 a WHERE NOT (kind = 'blob' AND EXISTS (SELECT 1 FROM ok1 b WHERE b.rid = a.rid AND b.ord < {strong} AND b.s < a.e AND b.e > a.s))),
    fin AS (SELECT * FROM ok2 a WHERE ord < {strong}
            OR (kind = 'ident' AND {near('secret')}) OR (kind = 'blob' AND {near('identifier')})
            OR (kind = 'endpoint' AND {near('identifier')} AND {near('secret')})),
    agg AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
              coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (ord < {strong}), '') AS base,
              string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans FROM fin GROUP BY rid)
    SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN agg USING (rid)"""


_MIX_CTES = r"""
    sized AS (SELECT {cols}, CAST(len(regexp_extract_all(coalesce(text, ''), '{ws}')) AS BIGINT) AS size,
        CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':7'), 1, 4)) AS INTEGER) % 1024 AS bin FROM {docs}),
    src AS (SELECT source, CAST(sum(size) AS BIGINT) AS ssize, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM sized GROUP BY source),
    byratio AS (SELECT *, 3 * ssize AS cap, sum(3 * ssize) OVER (ORDER BY 3.0 * ssize / w, source NULLS LAST) AS caps,
        sum(w) OVER () - sum(w) OVER (ORDER BY 3.0 * ssize / w, source NULLS LAST) AS openw, sum(ssize) OVER () AS total, sum(w) OVER () AS allw FROM src),
    levels AS (SELECT total / CAST(allw AS DOUBLE) AS level FROM byratio WHERE allw > 0
        UNION ALL SELECT (total - caps) / CAST(openw AS DOUBLE) FROM byratio WHERE openw > 0),
    lvl AS (SELECT min(level) AS level FROM levels l WHERE abs((SELECT sum(least(CAST(cap AS DOUBLE), l.level * w)) - max(total) FROM byratio)) <= 1e-6 * (SELECT max(total) FROM byratio) + 1e-9),
    tgt AS (SELECT source, ssize, CASE WHEN cap <= level * w THEN CAST(cap AS DOUBLE) ELSE level * w END AS target FROM byratio, lvl),
    times AS (SELECT *, CASE WHEN ssize > 0 THEN CAST(least(floor(target / ssize), 3) AS BIGINT) ELSE 0 END AS times FROM tgt),
    bins AS (SELECT source, bin, sum(size) AS bsize, coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sized GROUP BY source, bin),
    plan AS (SELECT b.source, b.bin, ssize, target, times, CASE WHEN times >= 3 OR bsize = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (target - times * ssize - before) / CAST(bsize AS DOUBLE))) END AS reach
        FROM bins b JOIN times t ON b.source IS NOT DISTINCT FROM t.source),
    mixed AS (SELECT s.*, ssize AS source_size, target, times + CASE WHEN reach >= 1 THEN 1 ELSE 0 END AS whole, CASE WHEN reach < 1 THEN reach ELSE 0.0 END AS part
        FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source AND s.bin = p.bin)"""



def page_text_sql(html: str) -> str:
    for pattern, new in (
        (r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", ""),
        (r"(?i)<(/?(p|div|li|ul|ol|h[1-6]|nav|article|section|header|footer|table|tr|title|head|body|html)|br|!doctype)[^>]*>", "\n"),
        (r"<[^>]*>", ""),
        (r"&nbsp;", " "), (r"&lt;", "<"), (r"&gt;", ">"), (r"&quot;", '"'), (r"&amp;", "&"),
        (r"[\x20\x09\x0D]*\n[\x20\x09\x0D\n]*", "\n"), (r"^\n|\n$", ""),
    ):
        put = "chr(10)" if new == "\n" else "'" + new + "'"
        html = f"regexp_replace({html}, '{pattern}', {put}, 'g')"
    return html


def line_dedup_sql(docs: str, key: str, host: str, text: str, rest: str, ratio: float, min_pages: int) -> str:
    """Select ``rest``, n_lines, n_dropped and the kept text of ``docs`` (a table of ``key``, ``host`` and ``text``)."""
    norm = r"trim(regexp_replace(lower(line), '\s+', ' ', 'g'))"
    return f"""
    ld AS (SELECT row_number() OVER () AS rid, * FROM {docs}),
    ll AS (SELECT rid, host, i, line, {norm} AS n FROM (SELECT rid, {host} AS host, unnest(range(1, len(string_split({text}, chr(10))) + 1)) AS i, unnest(string_split({text}, chr(10))) AS line FROM ld WHERE {text} IS NOT NULL)),
    tot AS (SELECT {host} AS host, count(*) AS pages FROM ld GROUP BY 1),
    cnt AS (SELECT host, n, count(DISTINCT rid) AS c FROM ll WHERE n <> '' GROUP BY host, n),
    bad AS (SELECT cnt.host, n FROM cnt JOIN tot ON cnt.host IS NOT DISTINCT FROM tot.host WHERE c >= {min_pages} AND c > pages * CAST({ratio} AS DOUBLE)),
    mk AS (SELECT ll.*, bad.n IS NOT NULL AS gone FROM ll LEFT JOIN bad ON ll.host IS NOT DISTINCT FROM bad.host AND ll.n = bad.n),
    ag AS (SELECT rid, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM mk GROUP BY rid),
    deduped AS (SELECT {rest}, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, CASE WHEN {text} IS NULL THEN NULL ELSE kept END AS kept FROM ld LEFT JOIN ag USING (rid))"""


def _rules_sql() -> str:
    norm = r"trim(regexp_replace(lower(line), '\s+', ' ', 'g'))"
    words = f"regexp_extract_all(coalesce(text, ''), '{_WS}')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text, {words} AS ws FROM documents),
    ll AS (SELECT rid, source, i, line, {norm} AS n FROM (SELECT rid, source, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, unnest(string_split(text, chr(10))) AS line FROM d)),
    dup AS (SELECT rid, sum(c - 1) AS n_dup FROM (SELECT rid, line, count(*) AS c FROM ll WHERE regexp_matches(line, '{_WS}') GROUP BY rid, line) GROUP BY rid),
    win AS (SELECT rid, k, ws[k:k + 4] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS k FROM d)),
    rep AS (SELECT rid, k FROM (SELECT rid, k, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
    cov AS (SELECT rid, count(DISTINCT k + j) AS n_rep FROM rep, (SELECT unnest(range(0, 5)) AS j) GROUP BY rid),
    tot AS (SELECT source, count(*) AS docs FROM d GROUP BY source),
    bad AS (SELECT c.source, n FROM (SELECT source, n, count(DISTINCT rid) AS c FROM ll WHERE n <> '' GROUP BY source, n) c JOIN tot ON c.source IS NOT DISTINCT FROM tot.source
        WHERE c > {quality_rules.LINE_DOCS} AND c > docs * CAST({quality_rules.LINE_SHARE} AS DOUBLE)),
    gone AS (SELECT rid, count(*) AS n_lines, sum(len(regexp_extract_all(line, '{_WS}'))) AS n_words FROM ll JOIN bad ON ll.source IS NOT DISTINCT FROM bad.source AND ll.n = bad.n GROUP BY rid),
    s AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words,
        CAST(coalesce(gone.n_lines, 0) AS BIGINT) AS n_lines_removed, CAST(len(ws) - coalesce(gone.n_words, 0) AS BIGINT) AS n_words_left
        FROM d LEFT JOIN dup USING (rid) LEFT JOIN cov USING (rid) LEFT JOIN gone USING (rid))
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (n_lines_removed > 0 AND (n_words_left < {quality_rules.LEFT_WORDS} OR n_words_left < n_words * CAST({quality_rules.LEFT_SHARE} AS DOUBLE))) AS kept
    FROM s"""


def _codes_sql() -> str:
    """Every round spelt out: each part against every entry, then the floored means."""
    n, size = codes.PARTS, codes.ENTRIES
    steps, books = [], "b0"
    for r in range(codes.ROUNDS + 1):
        steps.append(f"""
    a{r} AS (SELECT rid, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
        SELECT p.rid, p.part, b.entry, CAST(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
        FROM p JOIN {books} b USING (part)) GROUP BY rid, part)""")
        if r < codes.ROUNDS:
            steps.append(f"""
    s{r} AS (SELECT part, entry, i, sum(v) AS t, count(*) AS c FROM (
        SELECT part, entry, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS i FROM a{r} JOIN p USING (rid, part)) GROUP BY part, entry, i),
    m{r} AS (SELECT part, entry, list(CAST((t - ((t % c) + c) % c) // c AS BIGINT) ORDER BY i) AS x FROM s{r} GROUP BY part, entry),
    b{r + 1} AS (SELECT part, entry, coalesce(m{r}.x, {books}.x) AS x FROM {books} LEFT JOIN m{r} USING (part, entry))""")
            books = f"b{r + 1}"
    return f"""
    WITH v AS (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS MATERIALIZED (SELECT rid, vec_id, part, x[1 + part * len(x) // {n}:(part + 1) * len(x) // {n}] AS x FROM v, (SELECT unnest(range({n})) AS part)),
    b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {size}),
    {",".join(s.replace(" AS (", " AS MATERIALIZED (", 1).strip() for s in steps)},
    e AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{codes.ROUNDS} GROUP BY rid),
    h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM {books})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN v USING (rid), h"""


def _variants_sql() -> str:
    """Near words by the words left when one code point goes; crc32 by its table of 256 bytes."""
    return f"""
    WITH RECURSIVE t AS MATERIALIZED (SELECT list(v ORDER BY k) AS t FROM (SELECT k, list_reduce(range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, k) AS v FROM (SELECT unnest(range(256)) AS k))),
    runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), 'null') AS i, unnest(regexp_extract_all(translate(coalesce(text, ''), '{variants.UPPER}', '{variants.LOWER}'), '{variants.RUN}+')) AS run FROM documents),
    each AS (SELECT i, run, count(*) AS c FROM runs WHERE length(run) >= {variants.MIN_CHARS} GROUP BY i, run),
    hx AS (SELECT *, hex(encode(i || ':' || run)) AS x FROM each),
    crc AS (SELECT run, c, xor(list_reduce(list_transform(range(0, length(x) // 2), lambda k: CAST('0x' || x[2 * k + 1:2 * k + 2] AS BIGINT)), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)]), 4294967295), 4294967295) AS h FROM hx, t),
    w0 AS (SELECT CASE WHEN h % {variants.SLIP} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, c FROM crc),
    w AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM w0 WHERE length(word) >= {variants.MIN_CHARS} GROUP BY word HAVING sum(c) >= {variants.MIN_COUNT}),
    cut AS MATERIALIZED (SELECT word, k, word[:k] || word[k + 2:] AS v FROM (SELECT word, unnest(range(0, length(word))) AS k FROM w)),
    pairs AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b USING (k, v) WHERE a.word <> b.word AND length(a.word) = length(b.word)
        UNION SELECT word, v FROM cut SEMI JOIN w ON w.word = cut.v UNION SELECT v, word FROM cut SEMI JOIN w ON w.word = cut.v),
    near AS (SELECT p.word, CAST(count(*) AS BIGINT) AS n_near, min((-o.n, other)) AS b FROM pairs p JOIN w o ON o.word = p.other GROUP BY p.word),
    f AS MATERIALIZED (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= {variants.TIMES} * n THEN b[2] END AS form, CASE WHEN -b[1] >= {variants.TIMES} * n THEN -b[1] END AS form_n FROM w LEFT JOIN near USING (word)),
    r AS (SELECT word, form AS goal FROM f WHERE form IS NOT NULL UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.goal WHERE f.form IS NOT NULL),
    ends AS (SELECT r.word, r.goal FROM r JOIN f ON f.word = r.goal WHERE f.form IS NULL)
    SELECT f.word, form, coalesce(goal, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN ends USING (word)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op11_variants": _variants_sql(),
        "op12_vector_codes": _codes_sql(),
        "op2_secrets": _secrets_sql(),
        "op4_mixing": "WITH " + _MIX_CTES.format(ws=_WS, docs="documents", cols="*").strip()
        + " SELECT doc_id, size, source_size, target, CAST(whole * size + floor(part * size + 0.5::DOUBLE) AS BIGINT) AS taken FROM mixed",
        "op5_topk": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
                WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
                FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)),
            r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
            SELECT * FROM r WHERE rank <= 5""",
        "op7_line_dedup": f"""
            WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS host, {page_text_sql('html')} AS text FROM pages),
            {line_dedup_sql('p', 'page_id', 'host', 'text', 'page_id, host', site_lines.RATIO, site_lines.MIN_PAGES)}
            SELECT page_id, host, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM deduped""",
        "op10_quality_rules": _rules_sql(),
    }
