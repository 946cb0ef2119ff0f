import random
from collections import defaultdict

import numpy as np
import xxhash

from questora.llm import simhash

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_fingerprint(text, words):
    toks = [w for w in "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in (text or "").translate(LOW)).split(" ") if w]
    shingles = [" ".join(toks[i: i + words]) for i in range(max(1, len(toks) - words + 1))] if toks else []
    h = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(fps, bits):
    ids = list(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def corpus():
    rng = random.Random(4)
    vocab = [f"w{i}É" for i in range(300)]
    rows = []
    for g in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 8)):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append(rng.choice([" ", "\n", "  "]).join(w))
    rows += ["", None, " \t", "One", "one", "A b c d e " * 3000, "x" * 50000]
    return list(enumerate(rows))


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "fp", 1.0) for i, t in rows], "doc_id long, text string, fp string, component_id double")
    return simhash.near_duplicates(df, **kw).collect()


def test_against_all_pairs(spark):
    rows = corpus()
    got = run(spark, rows, words=4, bits=4)
    fps = {i: plain_fingerprint(t, 4) for i, t in rows}
    assert {r.doc_id: r.fp & (2**64 - 1) for r in got} == fps
    assert {r.doc_id: r.component_id for r in got} == plain_groups(fps, 4)


def test_large_nodes_are_dealt_out_without_losing_links(spark):
    rng = random.Random(9)
    base, fps = rng.getrandbits(64), {}
    for i in range(400):
        x = base if i % 2 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 7)):
            x ^= 1 << rng.randrange(64)
        fps[i] = x
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    nodes = spark.createDataFrame([(signed(x),) for x in set(fps.values())], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes, 4, simhash.block_masks(4, 6), leaf=16)).collect()}
    want = plain_groups(fps, 4)
    mine = defaultdict(set)
    for i, x in fps.items():
        mine[roots.get(signed(x), signed(x))].add(i)
    theirs = defaultdict(set)
    for i, g in want.items():
        theirs[g].add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_long_chain(spark):
    n = 500
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (7, 7)], "src long, dst long")
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert len({roots[i] for i in range(n + 1)}) == 1 and roots[1000] == roots[1001] != roots[0]


def test_few_links_take_few_tasks_however_many_partitions_a_shuffle_has(spark):
    sc, names = spark.sparkContext, ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)], "src long, dst long")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "64")
    spark.conf.set(names[1], "false")
    try:
        sc.setJobGroup("few-links", "tasks of components")
        roots = {r.node: r.root for r in simhash.components(edges).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for n, v in zip(names, before):
            spark.conf.set(n, v)
    told = sc.statusTracker()
    stages = {s for j in told.getJobIdsForGroup("few-links") for s in told.getJobInfo(j).stageIds}
    tasks = [info.numCompletedTasks for s in stages if (info := told.getStageInfo(s))]
    assert set(roots.values()) == {0} and len(roots) == 101
    # The first table is dealt out before its links are counted; the rounds' tables are not.
    assert sum(tasks) < 3000, (len(tasks), sum(tasks))


def counted(spark, name, work, partitions="64"):
    """What ``work`` returns, and how many stages and tasks it took with so many shuffle partitions that nothing coalesces."""
    sc, held = spark.sparkContext, {"spark.sql.shuffle.partitions": partitions, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {n: spark.conf.get(n) for n in held}
    for n, v in held.items():
        spark.conf.set(n, v)
    try:
        sc.setJobGroup(name, name)
        out = work()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for n, v in before.items():
            spark.conf.set(n, v)
    told = sc.statusTracker()
    stages = {s for j in told.getJobIdsForGroup(name) for s in told.getJobInfo(j).stageIds}
    tasks = [info.numCompletedTasks for s in stages if (info := told.getStageInfo(s)) and info.numCompletedTasks]
    return out, len(tasks), sum(tasks)


def test_links_of_one_task_take_no_rounds_and_more_take_rounds_with_the_same_roots(spark, monkeypatch):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, -3), (200, 201), (201, 200), (5, 5)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    got, stages, _ = counted(spark, "no-rounds", lambda: sorted(map(tuple, simhash.components(edges).collect())))
    assert got == sorted([(-3, -3), *[(i, -3) for i in range(61)], *[(100 + i, 100) for i in range(40)], (200, 200), (201, 200)])
    assert stages < 12, stages
    monkeypatch.setattr(simhash, "TASK_LINKS", 50)
    assert sorted(map(tuple, simhash.components(edges).collect())) == got
    assert simhash.components(edges.where("src > 900")).collect() == []


def test_slim_tables_of_near_copies_take_few_tasks_however_many_partitions_a_shuffle_has(spark):
    base = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{base} end{i}" if i < 30 else f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(60)], "doc_id long, text string")
    kept, _, tasks = counted(spark, "slim", lambda: sorted(r.doc_id for r in simhash.keep_one(docs).collect()))
    assert kept == [0, *range(30, 60)]
    assert tasks < 1300, tasks


def test_null_ids_repeated_rows_and_empty_table(spark):
    got = run(spark, [(None, "a b"), (3, "a b"), (3, "a b"), (None, "zz yy xx")])
    assert sorted(str(r.component_id) for r in got) == ["3", "3", "3", "None"]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    docs = spark.createDataFrame([(3, "a b", "x"), (3, "a b", "x"), (5, "A  b", "y"), (6, "other", None), (None, None, None)], "doc_id long, text string, source string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["3", "6", "None"]


def test_rows_of_one_id_with_unlike_texts_all_stay(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a, "z"), (1, b, "y"), (1, b, "x"), (1, b, "x"), (2, a + " more", "x"), (2, "quite another text of seven words", "x"), (0, b + " more", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = [(0, b + " more", "w"), (1, a, "z"), (2, "quite another text of seven words", "x")]
    for n in (1, 7):
        assert sorted(tuple(r) for r in simhash.keep_one(df.repartition(n)).collect()) == want
    again = spark.createDataFrame(rows[:4], "doc_id long, text string, source string")
    assert sorted(tuple(r) for r in simhash.keep_one(again).collect()) == sorted([(1, a, "z"), (1, b, "x")])


def test_bit_majorities_over_many_hashes():
    h = np.random.default_rng(0).integers(0, 2**63, 1000, dtype=np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > 1000)
    assert int(simhash.bit_majorities(np.concatenate([h, h[:3]]), np.array([0, 1000]))[0]) == want


def similar_texts():
    """Pairs whose shingle sets are 0.85 to 0.9 similar, and texts that share nothing."""
    rng, rows = random.Random(3), []
    for g in range(40):
        base = [f"a{g}x{rng.randrange(10**6)}" for _ in range(300)]
        near = list(base)
        for at in (50, 120, 180, 250):
            near[at] = f"new{g}at{at}"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(near))]
    return rows + [(1000 + i, " ".join(f"q{i}w{k}" for k in range(200))) for i in range(40)]


def test_keep_one_finds_copies_at_the_similarity_asked_for(spark):
    rows = [(i, t, "s") for i, t in similar_texts()]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {2 * g for g in range(40)} <= kept and {1000 + i for i in range(40)} <= kept
    assert len(kept & {2 * g + 1 for g in range(40)}) <= 2


def test_wide_large_nodes_give_the_same_groups(spark):
    df = spark.createDataFrame(similar_texts(), "doc_id long, text string")
    masks = simhash.drawn_masks(8, 2, 4)
    groups = [{r.doc_id: r.component_id for r in simhash.near_duplicates(df, 5, 42, masks, distinct=True, leaf=n).collect()} for n in (4096, 8)]
    assert groups[0] == groups[1]
    f = simhash.fingerprint_batch([t for _, t in similar_texts()], 5, 4, True)
    near = {(i, j) for i in range(len(f)) for j in range(i) if int(np.bitwise_count(f[i] ^ f[j]).sum()) <= 42}
    ids = [i for i, _ in similar_texts()]
    assert all(groups[0][ids[i]] == groups[0][ids[j]] for i, j in near) and len(near) >= 36


def around_the_limit():
    """Texts on both sides of a similarity of 0.8, many of them near it, and chains of such."""
    rng, rows = random.Random(8), []
    for g in range(60):
        text = [f"b{g}x{rng.randrange(10**6)}" for _ in range(rng.choice([6, 9, 12, 40, 200, 300]))]
        for _ in range(rng.randint(2, 5)):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            for _ in range(max(1, round(len(text) * rng.choice([0.012, 0.02, 0.022, 0.025, 0.04])))):
                text[rng.randrange(len(text))] = f"n{rng.randrange(10**6)}"
            text += [f"t{rng.randrange(10**6)}" for _ in range(rng.choice([0, 0, 1, 2]))]
    common = " ".join(f"common{i}" for i in range(60))
    return rows + [(len(rows) + i, f"{common} " + " ".join(f"own{i}w{k}" for k in range(i % 30))) for i in range(90)]


def test_groups_are_those_of_exact_similarity(spark):
    rows = around_the_limit()
    words = {i: t.split() for i, t in rows}
    sets = {i: {tuple(w[k: k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    like = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), s in like.items():
        if s >= 0.8:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert sum(0.8 <= s < 0.83 for s in like.values()) > 10 and sum(0.6 < s < 0.8 for s in like.values()) > 20
    df = spark.createDataFrame([*rows, (9000, ""), (9001, None)], "doc_id long, text string")
    want = {**{i: find(i) for i in sets}, 9000: 9000, 9001: 9000}
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == set(want.values())
    for part in (simhash.PART, 16):
        assert {r.doc_id: r.component_id for r in simhash.similar_groups(df, part=part).collect()} == want


def test_hot_shingles_come_last_and_lose_nothing():
    rng = np.random.default_rng(5)
    for n in range(1, 60):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.permutation(n)[: int(np.ceil(0.9 * n))]], rng.integers(0, 2**63, n // 10, dtype=np.uint64)]))
        hot = np.sort(a[rng.random(n) < 0.5])
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            assert len(np.intersect1d(simhash.set_prefix(a, 0.8, hot), simhash.set_prefix(b, 0.8, hot)))
