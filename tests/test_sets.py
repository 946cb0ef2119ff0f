import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from oracle import spark_rows, sql_rows, views
from pyspark.sql import functions as F

import __spark_entry__
from questora.operators import dedup, sets


def drawn(n: int = 240) -> list[set[int]]:
    """Sets of 3 to 400 tokens, some frequent, in groups of near copies; a few equal ones."""
    draw = np.random.default_rng(11)
    base = [set(draw.choice(3000, int(k), replace=False).tolist()) | set(draw.choice(12, 8).tolist()) for k in draw.choice([3, 9, 14, 20, 60, 130, 250, 400], n // 6)]
    out = []
    for i in range(n):
        s = sorted(base[i % len(base)])
        gone = draw.choice(len(s), int(len(s) * draw.choice([0, 0.05, 0.1, 0.17, 0.25])), replace=False)
        out.append((set(s) - {s[g] for g in gone}) | set((5000 + draw.choice(500, len(gone) // 2)).tolist()))
    return out


def links(found: list[set[int]], least: float) -> set[tuple[int, int]]:
    first = {frozenset(s): i for i, s in reversed(list(enumerate(found))) if s}
    want = {(first[frozenset(s)], i) for i, s in enumerate(found) if s and first[frozenset(s)] != i}
    return want | {(a, b) for s, a in first.items() for t, b in first.items() if a < b and len(s & t) / len(s | t) > least}


def test_large_sets_are_linked_like_all_pairs(spark, monkeypatch):
    rows = drawn()
    df = spark.createDataFrame([(i, [f"w{x}" for x in s]) for i, s in enumerate(rows)], "id long, t array<string>")
    want = links(rows, 0.7)
    assert len(want) > 100
    assert {(r.a, r.b) for r in dedup.near_pairs(df, "id", F.col("t"), 0.7).collect()} == want
    # Sketches of a few sets at once, few known tokens and small groups change nothing.
    for name, value in (("HELD", 90), ("RANKED", 5), ("MEMBERS", 2)):
        monkeypatch.setattr(sets, name, value)
    got = dedup.near_pairs(df, "id", F.col("t"), 0.7).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    assert all(abs(r.sim - len(rows[r.a] & rows[r.b]) / len(rows[r.a] | rows[r.b])) < 1e-12 for r in got)


def test_frequent_tokens_are_dealt_out_and_steps_are_small(monkeypatch):
    for name, value in (("SPLIT", 2), ("PRODUCTS", 50), ("STEP", 5), ("CELLS", 50)):
        monkeypatch.setattr(sets, name, value)
    rows = list({frozenset(s): s for s in drawn(120) if len(s) > 14}.values())
    hashed = [sorted(int(x) * 7919 % (1 << 40) - (1 << 39) for x in s) for s in rows]
    token, often = np.unique(np.concatenate(hashed), return_counts=True)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(hashed, pa.list_(pa.int64()))], names=["id", "toks"])
    none = np.zeros(0, np.int64)
    (ids, sketch), = sets._sketches(iter([batch]), none)
    held = sets._held(pa.table({"id": ids, "s": sketch}))
    (cols,) = sets._prefixes(iter([batch]), (none, token, often), 0.7)
    table = pa.table(cols, names=["t", "id", "at", "before"])
    assert table.num_rows > sum(len(s) - int(np.ceil(0.7 * len(s) - 1e-9)) + 1 for s in rows)
    found = {(a, b) for x in sets._pairs(table.sort_by([("t", "ascending"), ("at", "ascending")]).to_batches(max_chunksize=3), held, 0.7) for a, b in zip(x[0].to_pylist(), x[1].to_pylist())}
    want = links(rows, 0.7)
    assert want and want <= found and len(found) < 2 * len(want)


def test_near_copies_are_those_of_whole_texts(spark, tmp_path):
    words = [f"w{i:03d}" for i in range(200)]
    texts = [" ".join(words[:100]), " ".join(words[:14] + words[100:]), " ".join(words[120:140] + words[:100]), " ".join(words[:15]), " ".join(words[:14]), None, "the", " ".join(words[:100]) + "!"]
    pq.write_table(pa.table({"doc_id": list(range(len(texts))), "text": texts}), f"{tmp_path}/documents.parquet")
    got = spark_rows(__spark_entry__.queries()["near_dup_jaccard_pairs"](spark, str(tmp_path)))
    assert got == sql_rows(views(str(tmp_path)), __spark_entry__.oracle_sql()["near_dup_jaccard_pairs"])
    assert [tuple(map(int, r[:2])) for r in got[1]] == [(0, 2), (0, 7), (3, 4)]
