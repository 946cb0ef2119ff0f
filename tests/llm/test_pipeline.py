"""Each stage of the pipeline against a plain loop over its own input, and odd rows through all of them."""

import collections
import re

import numpy as np
import pytest

import corpus_pipeline
from questora.llm import toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, y string, score double"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small corpus with labels: boilerplate, copies, toxic and odd rows."""
    rng = np.random.default_rng(12)
    rows, labels = [], []
    for i in range(260):
        bad = i % 4 == 0
        body = [f"w{rng.integers(400)}" for _ in range(int(rng.integers(15, 120)))]
        if bad:
            body[3:3] = ["vile", "slur", "hate"] * 4
        lines = [" ".join(body[k:k + 20]) for k in range(0, len(body), 20)]
        lines.insert(0, f"Header  of {'ab'[i % 2]}")
        rows.append((i, "\n".join(lines), ["en", "fr", None][i % 3], "ab"[i % 2] if i % 10 else None, len("\n".join(lines)), "t", 0.0))
        if i % 5:
            labels.append((i, int(rng.random() < 0.5), int(bad)))
    for i in range(40):  # near copies of clean rows
        text = rows[4 * i + 1][1].split(" ")
        text[len(text) // 2] = f"changed{i}"
        rows.append((1000 + i, " ".join(text), "en", "a", 10, "t", 0.0))
    rows += [(2000, None, None, None, None, "t", 0.0), (2001, "", "en", "b", 0, "t", 0.0), (None, "no id at all here", "en", "b", 17, "t", 0.0), (1, rows[1][1], "en", "b", 1, "t", 0.0), (2002, "long word " * 30_000, "en", None, 1, "t", 0.0)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def plain(df):
    return [r.asDict() for r in df.collect()]


def key(rows):
    return collections.Counter((r["doc_id"], r["text"]) for r in rows)


def test_toxicity_stage(spark, corpus):
    docs, labels = (spark.read.parquet(f"{corpus}/{t}.parquet") for t in ("documents", "labels"))
    net, sample = toxicity.learnt(docs, labels)
    limits = toxicity.calibrate(sample, toxicity.score(docs, net, extra=("lang",)), labels)
    want = [r for r in plain(docs) if toxicity.score_batch(net, [r["text"]], 1)[0] < limits.get(r["lang"], 0.5)]
    got = corpus_pipeline.toxic(spark, docs, corpus)
    assert got.columns == docs.columns and key(plain(got)) == key(want)
    bad = [r for r in plain(docs) if "slur" in (r["text"] or "")]
    assert sum(r["doc_id"] in {w["doc_id"] for w in want} for r in bad) <= 0.1 * len(bad) and len(want) > 200
    assert corpus_pipeline.toxic(spark, docs.limit(0), corpus).count() == 0


def test_line_stage(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    rows, seen = plain(docs), collections.defaultdict(collections.Counter)
    norm = lambda x: re.sub(r"[ \t\x0b\f\r]+", " ", x.lower()).strip(" ")
    for r in rows:
        seen[r["source"]].update({norm(x) for x in (r["text"] or "").split("\n")} if r["text"] is not None else ())
    pages = collections.Counter(r["source"] for r in rows)
    gone = {s: {x for x, n in c.items() if x and n >= 5 and n > corpus_pipeline.LINE_RATIO * pages[s]} for s, c in seen.items()}
    want = [{**r, "text": None if r["text"] is None else "\n".join(x for x in r["text"].split("\n") if norm(x) not in gone.get(r["source"], ()))} for r in rows]
    got = plain(corpus_pipeline.lines(spark, docs, corpus))
    assert key(got) == key(want) and any("Header" in (r["text"] or "") for r in rows) and sum("Header" in (r["text"] or "") for r in got) < 40
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)


def test_near_copy_stage(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    rows = plain(docs)
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for r in rows:
        w = WORD.findall((r["text"] or "").translate(fold))
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if not union or len(sets[i] & sets[j]) >= 0.8 * union or rows[i]["doc_id"] is not None and rows[i]["doc_id"] == rows[j]["doc_id"]:
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i]["doc_id"])
    want = {min(x for x in g if x is not None) for g in groups.values() if any(x is not None for x in g)}
    got = plain(corpus_pipeline.near_copies(spark, docs, corpus))
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == sorted(want) and sum(r["doc_id"] is None for r in got) == 1
    assert len(want) <= len(rows) - 20


def test_mixing_stage(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    rows = plain(docs)
    size = lambda t: len(WORD.findall(t or ""))
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(r["text"]) for r in rows if r["source"] == s) for s in sources}
    weight, target, open_ = {s: [5, 2, 1][n % 3] for n, s in enumerate(sources)}, {}, set(sources)
    while open_:
        left = sum(total.values()) - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 3 * total[s] < level * weight[s]}
        target |= {s: 3 * total[s] for s in full} or {s: level * weight[s] for s in open_}
        open_ = open_ - full if full else set()
    got, first = plain(corpus_pipeline.mix(spark, docs, corpus)), collections.defaultdict(set)
    for r in rows:
        first[r["doc_id"]].add(r["text"])
    for s in sources:
        assert abs(sum(size(r["text"]) for r in got if r["source"] == s) - target[s]) <= max(60, 0.01 * target[s])
    assert all(any(r["text"] == t or (t or "").startswith(r["text"]) for t in first[r["doc_id"]]) for r in got if r["text"] is not None)
    assert key(got) == key(plain(corpus_pipeline.mix(spark, docs, corpus)))


def test_packing_stage_and_whole_run(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    got = plain(corpus_pipeline.batches(spark, docs, corpus))
    n = collections.Counter()
    for r in got:
        n[r["doc_id"]] += r["n_tokens"]
    assert sum(n.values()) == sum(len(WORD.findall(r["text"] or "")) for r in plain(docs))
    batches = collections.defaultdict(list)
    for r in got:
        batches[r["bucket_len"], r["batch_id"]].append(r)
    room = lambda length: max(1, 16_384 // max(length, 1))
    short = collections.Counter(length for (length, _), rows in batches.items() if len(rows) < room(length))
    assert all(c <= 1 for c in short.values()) and all(len(rows) <= room(length) for (length, _), rows in batches.items())
    assert all(sorted(r["slot"] for r in rows) == list(range(len(rows))) for rows in batches.values())
    whole = plain(corpus_pipeline.run(spark, corpus))
    assert whole and set(r["doc_id"] for r in whole) <= set(n) and sum(r["n_tokens"] for r in whole) < 3 * sum(n.values())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "mixing", "packing"]
