"""Operators against SQL, brute force and held-out labels, and their edge cases."""

import collections
import re
import zlib

import numpy as np
import pytest
from conftest import SF
from oracle import spark_rows, sql_rows, views
from pyspark.sql import functions as F

import corpus_pipeline
from questora.llm import langid, mixing, packing, quality, queries, secrets, topk, toxicity

#: The size at which the held-out fold has some 100 toxic rows; a tenth of it has too few to tell.
BIG = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    assert spark_rows(queries.queries()[name](spark, SF)) == sql_rows(views(SF), queries.oracle_sql()[name])


def plain_secrets(text):
    out = []
    text = text or ""
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def test_secret_spans_and_links(spark):
    key, blob = "AKIA" + "B2" * 9, "Zq" * 20
    texts = [
        None, "", f"é😀 PassWord = 'hunter22' token:abc secret=\"{key}\"", f"user: bob then {blob}", f"{blob} alone", "user: bob alone",
        f"user: bob {'x ' * 200}{blob}", f"see https://h.org/x user=ann password=abcdef1", "see https://h.org/x", "api_key=" + "ab12" * 10, "AKIAAKIA" + "C" * 20, "0" * 60_000, "token=a" * 3000,
    ]
    rows = [(i, t, "c", 1) for i, t in enumerate(texts)] + [(3, texts[3], "c", 1), (None, "secret: abcdefg", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string, start int")
    got = collections.defaultdict(list)
    for r in secrets.digest(secrets.scan(df)).collect():
        got[r.doc_id].append(r.spans)
    assert sum(map(len, got.values())) == len(rows)
    base = lambda s: ",".join(x for x in s.split(",") if x.split(":")[0] in ("assign", "access", "hex"))
    assert all(base(got[i][0]) == plain_secrets(t) for i, t in enumerate(texts))
    kinds = [[x.split(":")[0] for x in got[i][0].split(",") if x] for i in range(len(texts))]
    assert kinds[3] == ["ident", "blob"] and kinds[4] == kinds[5] == kinds[6] == kinds[8] == [] and kinds[7] == ["endpoint", "ident", "assign"]
    assert secrets.scan(df.limit(0)).count() == 0


def test_mixing_meets_targets_and_caps(spark):
    rows = [(i, "w " * (1 + i % 13), "a") for i in range(600)] + [(1000 + i, "w w w", "b") for i in range(40)] + [(2000, "w " * 30_000, None), (2001, None, "c"), (2001, "", "c"), (None, "x y", "b")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, size int")
    a, b = (sorted(map(str, mixing.mix(df).collect())) for _ in range(2))
    assert a == b and len(a) == len(rows)
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in mixing.mix(df).collect():
        assert 0 <= r.taken <= 3 * r["size"]
        by[r.source][0] += r.taken
        by[r.source][1:] = r.source_size, r.target
    assert all(abs(t - x) <= max(3, 0.01 * x) and x <= 3 * n + 1e-6 for t, n, x in by.values())
    assert abs(sum(x for *_, x in by.values()) - sum(n for _, n, _ in by.values())) < 1e-3
    made = mixing.repeated(df.drop("size"))
    words = made.groupBy("source").agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))).alias("n")).collect()
    assert made.columns == ["doc_id", "text", "source"] and all(r.n == by[r.source][0] for r in words if r.n)
    assert mixing.mix(df.limit(0)).count() == 0


def test_packing_is_optimal_and_whole(spark):
    rng = np.random.default_rng(1)
    hist = {int(n): int(rng.integers(1, 9)) for n in rng.choice(40, 9, replace=False)}
    from itertools import combinations

    pad = lambda bounds: sum(c * (min(b for b in bounds if b >= n) - n) for n, c in hist.items())
    best = min(pad((*c, max(hist))) for k in range(3) for c in combinations(sorted(hist)[:-1], k))
    assert pad(packing.boundaries(hist, 3)) == best and packing.boundaries({}, 3) == []
    rows = [(int(i), "w " * int(n), 7) for i, n in enumerate(rng.integers(0, 90, 300))] + [(5, None, 7), (None, "w " * 5000, 7), (6, "", 7)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), max_len=64, buckets=4, token_budget=256).collect()
    assert sum(r.n_tokens for r in got) == sum(len((t or "").split()) for _, t, _ in rows)
    assert len({(r.batch_id, r.slot) for r in got}) == len(got) and all(r.n_tokens <= r.bucket_len for r in got)
    assert all((r.slot + 1) * r.bucket_len <= 256 for r in got)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_topk_edges(spark):
    rng = np.random.default_rng(2)
    vec = [(i, rng.normal(size=8).round(2).tolist(), "s") for i in range(300)]
    vec += [(300, None, "s"), (301, [1.0] * 7 + [None], "s"), (302, [float("inf")] * 8, "s"), (303, [1.0] * 3, "s"), (None, [1.0] * 8, "s"), (7, vec[7][1], "s"), (308, vec[8][1], "s")]
    df = spark.createDataFrame(vec, "vec_id long, embedding array<double>, score string")
    got = collections.defaultdict(list)
    for r in topk.search(df, F.col("vec_id") % 50 == 0, 5, block=64, chunk=3).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    ok = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v, _ in vec if i is not None and v and None not in v and len(v) == 8 and np.isfinite(v).all()]
    for q, x in ok:
        if q % 50 == 0:
            want = sorted(((-int(x @ y), i) for i, y in ok if i != q))[:5]
            assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


EDGES = [(1, None, None, None), (None, "some words here", "en", "s"), (2, "", "en", "s"), (2, "", "en", "s"), (3, "x" * 300_000, None, "s"), (4, "12 34 ½", "xx", None), (5, "word " * 60_000, "en", "s")]


def test_models_on_held_out_rows_and_edges(spark):
    read = lambda t: spark.read.parquet(f"{BIG}/{t}.parquet")
    docs, labels = read("documents"), read("labels")
    fold = lambda i, n: zlib.crc32(str(i).encode()) % n
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = [r for r in queries.op3_langid(spark, BIG).collect() if lang[r.doc_id] and r.lang_pred != "und"]
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98
    for query, name, least in ((queries.op8_toxicity, "toxic", 0.95), (queries.op9_quality, "quality", 0.95)):
        y = {r.doc_id: r[name] for r in labels.collect() if r[name] is not None}
        held = [r for r in query(spark, BIG).collect() if r.held_out and r.doc_id in y]
        pos, neg = [[r.score for r in held if y[r.doc_id] == c] for c in (1, 0)]
        auc = np.mean([[(p > n) + 0.5 * (p == n) for n in neg] for p in pos])
        assert auc > least, (name, auc)
    edges = spark.createDataFrame([(*e, 0.5, "z") for e in EDGES], "doc_id long, text string, lang string, source string, score double, y string")
    net, w, crf = toxicity.learnt(docs, labels)[0], quality.fit(docs, labels), langid.fit(docs)
    for got in (toxicity.score(edges, net), toxicity.score(edges, None), quality.score(edges, w), quality.score(edges, None)):
        assert got.count() == len(EDGES) and all(0 <= r.score <= 1 for r in got.collect())
    found = langid.predict(edges, crf).collect()
    assert sorted(r.lang_pred == "und" for r in found) == sorted([True, False, True, True, False, True, False])
    assert {r.lang_pred for r in langid.predict(edges, None).collect()} == {"und"}
    kept = toxicity.clean(edges, labels)
    assert kept.columns == edges.columns and kept.count() <= len(EDGES) and toxicity.clean(edges, labels.limit(0)).count() == len(EDGES)
    assert all(f.limit(0).count() == 0 for f in (toxicity.score(edges, net), quality.score(edges, w), langid.predict(edges, crf)))
    assert toxicity.learnt(docs.limit(0), labels)[0] is None and quality.fit(docs, labels.limit(0)) is None and langid.fit(docs.limit(0)) is None


def test_pipeline_keeps_its_promises(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9_000_001, None, None, None, 0), (9_000_002, "", "en", None, 0)], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    state = docs.unionByName(extra, allowMissingColumns=True)
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, state = state, stage(spark, state, SF)
        assert n == 4 or state.columns == docs.columns, name
        if name in ("toxicity", "simhash"):
            assert state.join(before, "doc_id", "left_anti").count() == 0
        if name == "line_dedup":
            assert state.count() == before.count()
        state = state.checkpoint()
    assert state.count() > 0 and state.where("n_tokens > bucket_len").count() == 0


def test_small_batches_hold_inside_alone(spark):
    from questora.llm.common import small_batches

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    sizes = lambda: spark.range(100).coalesce(1).mapInArrow(lambda it: (b for b in it), "id long").mapInPandas(lambda it: (p.assign(id=len(p)).head(1) for p in it), "id long").collect()
    with small_batches(spark, 30):
        assert sorted(r.id for r in sizes()) == [10, 30, 30, 30]
    assert spark.conf.get(key) == before
    with pytest.raises(KeyError), small_batches(spark, 30):
        raise KeyError
    assert spark.conf.get(key) == before
