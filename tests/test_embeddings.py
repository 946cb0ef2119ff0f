import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from oracle import spark_rows, sql_rows, views
from pyspark.sql import functions as F

import __spark_entry__
from questora.functions import vectors


def test_texts_become_vectors_where_they_lie(spark):
    """No row of a word or of a place is shuffled, and a repeated or missing key is as in the SQL."""
    df = spark.createDataFrame([(i, f"some words of row {i}") for i in range(50)], "i long, t string")
    made = vectors.hash_embeddings(df, "i", F.col("t"), 16)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and made.count() == 50


def test_repeated_and_missing_keys_are_as_in_the_sql(spark, tmp_path):
    texts = ["Ab ab abc", "xyz QRST uvw", None, "", "naïve Straße \U0001F600\U0001F601\U0001F602 x", "one two", "two three", "a" * 300, "abc abd", "  \x1c"]
    keys = [1, 2, 3, 4, 5, 6, 6, 7, None, 8]
    pq.write_table(pa.table({"doc_id": keys, "text": texts}), f"{tmp_path}/documents.parquet")
    q, sql = __spark_entry__.queries()["hash_embedding"], __spark_entry__.oracle_sql()["hash_embedding"]
    assert spark_rows(q(spark, str(tmp_path))) == sql_rows(views(str(tmp_path)), sql)


def test_words_are_summed_in_steps_and_forgotten(monkeypatch):
    draw = np.random.default_rng(3)
    texts = [" ".join("".join(chr(97 + c) for c in draw.integers(0, 26, draw.integers(1, 9))) for _ in range(draw.integers(0, 40))) for _ in range(30)] + ["", "ab " * 50 + "z" * 99]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, min(k + 7, 32)), pa.int64()), pa.array(texts[k: k + 7])], names=["i", "t"]) for k in range(0, 32, 7)]
    for known, step in ((500, 1000), (5, 3)):
        monkeypatch.setattr(vectors, "KNOWN", known)
        monkeypatch.setattr(vectors, "AT_ONCE", step)
        got = [v for b in vectors._summed(iter(batches), 8, False) for v in b.column(1).to_pylist()]
        for v, t in zip(got, texts, strict=True):
            want = [0.0] * 8
            for w in t.split():
                h = hashlib.sha256(w.encode()).hexdigest()
                for at, x in ((h[:8], 1), (h[8:16], 0.5), *((hashlib.md5(w[k: k + 3].encode()).hexdigest()[:8], 0.25) for k in range(len(w) - 2))):
                    want[int(at, 16) % 8] += x
            assert v == want
