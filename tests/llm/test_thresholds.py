import zlib

import numpy as np

from questora.llm import toxicity

DOCS = "doc_id long, text string, lang string"


def labelled(n=600):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 40, 12)) + (" vile" if i % 5 == 0 else ""), "ab"[i % 2]) for i in range(n)]
    rows[7] = (7, "w1 " * 10_000, "b")  # longer than texts to learn from may be
    return rows, [(i, int(i % 5 == 0)) for i in range(n)]


def test_thresholds_count_every_labelled_row_once_and_unseen(spark, monkeypatch):
    rows, y = labelled()
    seen, learnt, true_train = [], [], toxicity.train
    monkeypatch.setattr(toxicity, "PER_CLASS", 60)
    monkeypatch.setattr(toxicity, "best_threshold", lambda bins: seen.append(bins) or 0.5)
    monkeypatch.setattr(toxicity, "train", lambda r, **kw: learnt.append(r) or true_train(r, epochs=1))
    docs = spark.createDataFrame([*rows, (9000, "w1 w2", "a"), (9001, "w1 w2", None)], DOCS)
    labels = spark.createDataFrame([*y, (9001, 1), (None, 1)], "doc_id long, toxic int")
    net, sample = toxicity.learnt(docs, labels)
    toxicity.calibrate(sample, toxicity.score(docs, net, extra=("lang",)), labels)
    used = [c for i, c in y if zlib.crc32(str(i).encode()) % 5]
    got = np.array([v for bins in seen for v in bins.values()]).sum(0).tolist()
    assert len(seen) == 2 and got == [used.count(0), used.count(1)]
    assert len(learnt) == 1 + toxicity.PARTS and all(len(r) < len(learnt[0]) for r in learnt[1:])
    assert sum(len(learnt[0]) - len(r) for r in learnt[1:]) == len(learnt[0])


def test_best_threshold_is_that_of_all_cuts():
    rng = np.random.default_rng(1)
    for _ in range(50):
        at = np.unique(rng.integers(-200, 200, 12)).tolist()
        bins = {b: rng.integers(0, 4, 2).tolist() for b in at}
        neg, pos = (sum(v[c] for v in bins.values()) for c in (0, 1))
        if not neg or not pos:
            continue
        error = lambda e: sum(v[1] for b, v in bins.items() if b < e) / pos + sum(v[0] for b, v in bins.items() if b >= e) / neg  # noqa: B023, E731
        cut = toxicity.best_threshold(bins)
        assert abs(error(round(float(np.log(cut / (1 - cut))) * toxicity.BINS, 6)) - min(map(error, range(-202, 203)))) < 1e-5
    assert toxicity.best_threshold({3: [5, 0]}) == 0.5
