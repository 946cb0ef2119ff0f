"""SimHash near-duplicate groups over a Gray-order hierarchical index.

1. ``fingerprints`` reads every whole text once and keeps 8 bytes of it.
2. Documents of equal fingerprint fold into one node before anything is compared, so a
   group of exact copies costs one row however large it is.
3. The upper nodes of the index are *shared masked bit patterns*: each fingerprint hangs
   below every mask, at the node (mask, its bits under the mask). ``block_masks`` cuts 64 bits
   into blocks; two fingerprints that differ in at most ``bits`` bits agree on at least
   ``blocks - bits`` whole blocks, so those masks lose no link. For the far larger distances
   of a similarity of 0.8, ``drawn_masks`` draws bits of a fingerprint of several 64-bit lanes;
   ``similar_groups`` loses none of those either, with shared shingles for upper nodes, and
   confirms the links by the shingle sets.
4. Below an upper node the fingerprints lie in Gray-rank order, in twigs, and twigs in
   branches. A branch or twig knows the bits that all its members share. On the way down the
   differences accumulate: what two branches' shared bits differ in, then what their twigs'
   further shared bits add, then the rest of the bits of the fingerprints themselves; a pair
   of groups beyond ``bits`` is pruned as a whole at the level where it gets there.
5. An upper node of more than ``LEAF`` fingerprints is dealt out: its Gray-ordered leaves
   become rows of their own, leaves meet groups of leaves (limbs) first and single leaves only
   below a limb that is near enough, and each surviving pair of leaves is one unit of work, so
   no task holds a large node and none is capped.
6. A unit of work returns a spanning forest of its links, never all pairs. Rounds of stars,
   two joins each, turn the forests into components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SALTS, by_size, cut, few, looked_up, small_batches

#: Fingerprints that one task compares below an upper node; larger nodes are dealt out by leaf.
LEAF = 4096
#: Fingerprints of a twig, and twigs of a branch.
TWIG, BRANCH = 64, 8
#: One in so many fingerprints is counted to find the large nodes.
SEEN = 16
#: Pairs that are looked at in one step.
PAIRS = 1 << 17
#: A limb of a dealt-out node has 2 ** LIMB_BITS leaves.
LIMB_BITS = 6
#: Links that a task of a round of ``components`` reads; of no more links in all, one task makes the components.
TASK_LINKS = 50_000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of ``words`` words, in order, repeats included."""
    toks = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not toks:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(toks), xxhash.xxh64_intdigest
    if len(toks) <= words:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, toks), np.int64, len(toks)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(toks) - words + 1].tolist()
    stops = (ends[words - 1:] - 1).tolist()
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, len(starts))


def lane_hashes(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Hashes for another lane of the fingerprint, from those of lane 0."""
    if not lane:
        return hashes
    h = hashes * np.uint64((2 * lane * 0x5851F42D4C957F2D + 1) & (2**64 - 1))
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def lane_names(lanes: int) -> list[str]:
    return ["fp", *[f"fp{n}" for n in range(1, lanes)]]


def node_ids(f: np.ndarray) -> np.ndarray:
    """One number for each row of lanes; the fingerprint itself if it has one lane."""
    out = f[:, 0]
    for n in range(1, f.shape[1]):
        out = out * np.uint64(0x9E3779B97F4A7C15)
        out = (out ^ (out >> np.uint64(31))) + f[:, n]
    return out


def bit_majorities(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each run of hashes that starts at an offset, the bits set in over half of it."""
    # Runs are summed in steps of at most 255 so that eight counters fit into one word.
    counts = np.diff(np.append(offsets, len(hashes)))
    steps = [np.arange(o, o + c, 255) for o, c in zip(offsets.tolist(), counts.tolist())]
    owner = np.repeat(np.arange(len(offsets)), [len(s) for s in steps])
    cuts = np.concatenate(steps)
    first = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
    out = np.zeros(len(offsets), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, cuts)
        wide = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            out |= (2 * wide[:, byte] > counts).astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def fingerprint_batch(texts: list[str | None], words: int, lanes: int = 1, distinct: bool = False) -> np.ndarray:
    """Fingerprints (texts, lanes); ``distinct`` counts a repeated shingle once."""
    out = np.zeros((len(texts), lanes), np.uint64)
    hashes, who, n = [], [], 0

    def flush() -> None:
        if who:
            offsets, every = np.cumsum([0] + [len(h) for h in hashes[:-1]]), np.concatenate(hashes)
            for lane in range(lanes):
                out[who, lane] = bit_majorities(lane_hashes(every, lane), offsets)
            hashes.clear()
            who.clear()

    for i, text in enumerate(texts):
        h = shingle_hashes(text, words)
        if len(h):
            hashes.append(np.unique(h) if distinct else h)
            who.append(i)
            n += len(h)
            if n > 50_000:
                flush()
                n = 0
    flush()
    return out


def set_fingerprints(sets: list[np.ndarray], lanes: int) -> np.ndarray:
    """Fingerprints (sets, lanes) of sets of shingle hashes; zero for an empty set."""
    out = np.zeros((len(sets), lanes), np.uint64)
    who = [i for i, h in enumerate(sets) if len(h)]
    if who:
        offsets, every = np.cumsum([0, *[len(sets[i]) for i in who[:-1]]]), np.concatenate([sets[i] for i in who])
        for lane in range(lanes):
            out[who, lane] = bit_majorities(lane_hashes(every, lane), offsets)
    return out


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text", lanes: int = 1, distinct: bool = False) -> DataFrame:
    """(doc_id, fp): the 64-bit SimHash of each whole text, as a long; with ``lanes`` over 1
    also fp1, fp2, ... and ``node``, a number for all lanes together.

    A text without words, or null, has fingerprint zero; a text of fewer words than a
    shingle is one shingle. Only the two named columns are read.
    """
    names = ["doc_id", *lane_names(lanes), *(["node"] if lanes > 1 else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprint_batch(b.column(1).to_pylist(), words, lanes, distinct)
            cols = [*fp.T, *([node_ids(fp)] if lanes > 1 else [])]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.ascontiguousarray(c).view(np.int64)) for c in cols]], names=names)

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, ", ".join([f"doc_id {src.schema['doc_id'].dataType.simpleString()}", *[f"{n} long" for n in names[1:]]]))


def gray_rank(fp: Column) -> Column:
    """Position of a code word in the reflected Gray sequence, as a sortable long."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(2**63)))


def gray_order(f: np.ndarray) -> np.ndarray:
    """Row numbers of fingerprints (rows, lanes) in the order of the Gray rank, lane by lane."""
    ranks = f.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        ranks ^= ranks >> np.uint64(shift)
    return np.lexsort(ranks.T[::-1])


def _signed(m: int) -> int:
    return m - 2**64 if m >= 2**63 else m


def block_masks(bits: int, blocks: int) -> list[tuple[int, ...]]:
    """The masks of ``blocks - bits`` of the ``blocks`` blocks of 64 bits, as signed longs."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [(_signed(sum(block[i] for i in c)),) for c in combinations(range(blocks), blocks - bits)]


def drawn_masks(count: int, width: int, lanes: int, seed: int = 1) -> list[tuple[int, ...]]:
    """``count`` masks of ``width`` bits drawn from all lanes. Fingerprints that differ in a share d
    of their bits meet below at least one with probability 1 - (1 - (1 - d) ** width) ** count."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(count):
        bits = rng.choice(64 * lanes, width, replace=False).tolist()
        out.append(tuple(_signed(sum(1 << (b % 64) for b in bits if b // 64 == n)) for n in range(lanes)))
    return out


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) replaced by a forest (node, root) with the same components."""
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inv[: len(a)], inv[len(a):]
    lab = np.arange(len(ids))
    while True:
        low = np.minimum(lab[u], lab[v])
        new = lab.copy()
        np.minimum.at(new, lab[u], low)
        np.minimum.at(new, lab[v], low)
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    keep = lab != np.arange(len(ids))
    return ids[keep], ids[lab[keep]]


def _shared(f: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each run of ``size`` rows the bits' values (members' AND) and a mask of the bits that all members share."""
    at = np.arange(0, len(f), size)
    low, high = np.bitwise_and.reduceat(f, at), np.bitwise_or.reduceat(f, at)
    return low, ~(low ^ high)


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits, summed lane by lane."""
    out = np.bitwise_count(x[..., 0] ^ y[..., 0]).astype(np.int32)
    for n in range(1, x.shape[-1]):
        out += np.bitwise_count(x[..., n] ^ y[..., n])
    return out


def _tie(lab: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Joins, in place, the components that the links (x, y) connect; each node's label is the least node of its component."""
    while True:
        lx, ly = lab[x], lab[y]
        apart = lx != ly
        if not apart.any():
            return
        low = np.minimum(lx, ly)[apart]
        np.minimum.at(lab, lx[apart], low)
        np.minimum.at(lab, ly[apart], low)
        while (lab[lab] != lab).any():
            lab[:] = lab[lab]


def near_links(f: np.ndarray, g: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the components of the links of at most ``bits`` bits within Gray-ordered ``f`` (rows, lanes), or
    between ``f`` and ``g``; as row numbers, those of ``g`` after those of ``f``.

    Branches, twigs and rows are the levels. Each level adds the differences in the bits that
    its groups share and the level above did not, and keeps the pairs within ``bits``. Rows that
    are tied already are not compared.
    """
    same = g is None
    g, offset = (f, 0) if same else (g, len(f))
    levels = [TWIG * BRANCH, TWIG, 1]
    lab = np.arange(len(f) + (0 if same else len(g)))
    # Pairs of groups that are left, and the differences counted for them so far in the bits of ``done``.
    i, j = (x.ravel() for x in np.meshgrid(np.arange(-(-len(f) // levels[0])), np.arange(-(-len(g) // levels[0])), indexing="ij"))
    so_far, done = np.zeros(len(i), np.int32), None
    for n, size in enumerate(levels):
        (fv, fm), (gv, gm) = _shared(f, size), _shared(g, size)
        fan = 1 if n == 0 else levels[n - 1] // size
        kids, out, last = np.arange(fan), [], n == len(levels) - 1
        # Some pairs at a time: each has fan * fan pairs of children.
        step = max(1, PAIRS // (fan * fan))
        for at in range(0, len(i), step):
            a = (i[at: at + step, None, None] * fan + kids[:, None]).repeat(fan, 2)
            b = (j[at: at + step, None, None] * fan + kids[None, :]).repeat(fan, 1)
            ok = (a < len(fv)) & (b < len(gv))
            if same:
                ok &= a < b if last else a <= b
            which = np.nonzero(ok)
            a, b, up = a[which], b[which], at + which[0]
            if last:
                new = lab[a] != lab[offset + b]
                a, b, up = a[new], b[new], up[new]
            both = fm[a] & gm[b]
            fresh = both if done is None else both & ~done[up]
            d = so_far[up] + np.bitwise_count((fv[a] ^ gv[b]) & fresh).sum(1).astype(np.int32)
            near = d <= bits
            if last:
                _tie(lab, a[near], offset + b[near])
            else:
                out.append((a[near], b[near], d[near], both[near]))
        if not last:
            i, j, so_far, done = (np.concatenate([o[k] for o in out]) for k in range(4)) if out else (i[:0], j[:0], so_far[:0], np.zeros((0, f.shape[1]), np.uint64))
    rows = np.flatnonzero(lab != np.arange(len(lab)))
    return rows, lab[rows]


def _small_links(node: np.ndarray, f: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links, as row numbers, within runs of equal ``node``, all runs at once; for short runs."""
    out_a, out_b, d = [], [], 1
    rows = np.arange(len(node))
    while True:
        rows = rows[rows + d < len(node)]
        rows = rows[node[rows] == node[rows + d]]
        if not len(rows):
            break
        hit = rows[_distance(f[rows], f[rows + d]) <= bits]
        out_a.append(hit)
        out_b.append(hit + d)
        d += 1
    return tuple(np.concatenate(o) if o else np.empty(0, np.int64) for o in (out_a, out_b))


def _links_of_runs(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (mask number, pattern, lanes) sorted by node and Gray rank -> a forest of links."""
    held_a, held_b, held = [], [], 0
    rest: tuple | None = None

    def emit():
        nonlocal held_a, held_b, held
        if held:
            a, b = forest(np.concatenate(held_a), np.concatenate(held_b))
            held_a, held_b, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["src", "dst"])

    def work(mask, pat, f):
        nonlocal held
        new = np.concatenate([[True], (mask[1:] != mask[:-1]) | (pat[1:] != pat[:-1])])
        node = np.cumsum(new)
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(f)))
        short = (size > 1) & (size <= TWIG)
        pick = np.repeat(short, size)
        groups = [f[pick], *[f[s: s + n] for s, n in zip(at[size > TWIG], size[size > TWIG])]]
        for i, g in enumerate(groups):
            a, b = near_links(g, None, bits) if i else _small_links(node[pick], g, bits)
            if len(a):
                a, b = node_ids(g[a]), node_ids(g[b])
                held_a.append(a[a != b])
                held_b.append(b[a != b])
                held += len(held_a[-1])

    for batch in batches:
        cols = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.stack([c.to_numpy().view(np.uint64) for c in batch.columns[2:]], 1)]
        if rest is not None:
            cols = [np.concatenate([r, c]) for r, c in zip(rest, cols)]
        mask, pat, f = cols
        # The last node may go on in the next batch.
        last = np.flatnonzero((mask != mask[-1]) | (pat != pat[-1]))
        end = last[-1] + 1 if len(last) else 0
        if end:
            work(mask[:end], pat[:end], f[:end])
        rest = (mask[end:], pat[end:], f[end:])
        if held > 500_000:
            yield from emit()
    if rest is not None and len(rest[0]):
        work(*rest)
    yield from emit()


def links(nodes: DataFrame, bits: int, masks: list[tuple[int, ...]], leaf: int = LEAF) -> DataFrame:
    """(src, dst): forests that join the distinct fingerprints ``nodes`` (columns ``lane_names``) within ``bits`` bits."""
    lanes = lane_names(len(masks[0]))

    def pattern(mask: tuple[int, ...]) -> Column:
        under = [F.col(c).bitwiseAND(F.lit(m)) for c, m in zip(lanes, mask)]
        return under[0] if len(under) == 1 else F.xxhash64(*under)

    uppers = F.array(*[F.struct(F.lit(i).cast("short").alias("mask"), pattern(m).alias("pattern")) for i, m in enumerate(masks)])
    below = nodes.select(F.explode(uppers).alias("node"), *lanes).select("node.mask", "node.pattern", *lanes)
    return links_below(below, lanes, bits, leaf)


def links_below(below: DataFrame, lanes: list[str], bits: int, leaf: int = LEAF) -> DataFrame:
    """(src, dst): forests that join the fingerprints that hang below one upper node of ``below(mask, pattern, *lanes)`` within ``bits`` bits.

    Which nodes are large is told from one in ``SEEN`` of the fingerprints: it decides how a node is worked on, not what comes out.
    """
    share = SEEN if leaf >= 64 * SEEN else 1
    some = below.where(F.pmod(F.xxhash64("fp", F.lit(5)), F.lit(share)) == 0)
    large = cut(some.groupBy("mask", "pattern").agg(F.count("*").alias("n")).where(F.col("n") * share > leaf).select("mask", "pattern"))
    large = few(large)
    has_large = not large.isEmpty()
    small = below.join(large, ["mask", "pattern"], "left_anti") if has_large else below
    runs = small.repartition(F.col("mask"), F.col("pattern")).sortWithinPartitions("mask", "pattern", gray_rank(F.col("fp")))
    found = runs.mapInArrow(lambda it: _links_of_runs(it, bits), "src long, dst long")
    if not has_large:
        return found
    return found.unionByName(_links_of_large(below.join(large, ["mask", "pattern"], "left_semi"), lanes, bits, leaf))


def _links_of_large(members: DataFrame, lanes: list[str], bits: int, leaf: int) -> DataFrame:
    """Links below large upper nodes, by pairs of Gray-ordered leaves.

    Each leaf meets the limbs of its node, dealt by leaf so that no task gets a node whole, and
    then the leaves of those limbs whose shared bits leave a link possible.
    """

    def into_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # Rows of the node before this batch, its key, and the number of the leaf that is open.
        carry, key, n = 0, None, TaskContext.get().partitionId() << 32
        for b in batches:
            if not b.num_rows:
                continue
            node = np.stack([b.column(0).to_numpy().astype(np.int64), b.column(1).to_numpy()], 1)
            new = np.concatenate([[key is None or (node[0] != key).any()], (node[1:] != node[:-1]).any(1)])
            rows = np.arange(len(node))
            start = np.maximum.accumulate(np.where(new, rows, -carry))
            ids = n + np.cumsum((rows - start) % leaf == 0)
            carry, key, n = int(len(node) - start[-1]), node[-1], int(ids[-1])
            yield pa.RecordBatch.from_arrays([*b.columns[: 2 + len(lanes)], pa.array(ids, pa.int64())], names=["mask", "pattern", *lanes, "leaf"])

    ordered = members.withColumn("rank", gray_rank(F.col("fp"))).repartitionByRange("mask", "pattern", "rank").sortWithinPartitions("mask", "pattern", "rank")
    rows = cut(ordered.mapInArrow(into_leaves, ", ".join(["mask short, pattern long", *[f"{c} long" for c in lanes], "leaf long"])))
    leaves = cut(_shared_bits(rows, lanes, "leaf", "").withColumn("limb", F.shiftright("leaf", LIMB_BITS)))
    limbs = _shared_bits(rows.withColumn("limb", F.shiftright("leaf", LIMB_BITS)), lanes, "limb", "_up").withColumnRenamed("limb", "limb_up")
    salt = F.pmod(F.xxhash64("leaf"), F.lit(SALTS))
    dealt = limbs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    above = leaves.withColumn("salt", salt.cast("int")).join(dealt, ["mask", "pattern", "salt"]).where(F.col("limb") <= F.col("limb_up"))
    counted = [F.col(f"shared_{c}").bitwiseAND(F.col(f"shared_{c}_up")) for c in lanes]
    far = lambda other, among: sum((F.bit_count(F.col(f"low_{c}").bitwiseXOR(F.col(f"low_{c}{other}")).bitwiseAND(x)) for c, x in zip(lanes, among)), F.lit(0))
    near = above.withColumn("so_far", far("_up", counted)).where(F.col("so_far") <= bits)
    lower = leaves.select("mask", "pattern", F.col("limb").alias("limb_up"), F.col("leaf").alias("leaf_2"), *[F.col(f"{p}_{c}").alias(f"{p}_{c}_2") for c in lanes for p in ("low", "shared")])
    fresh = [F.col(f"shared_{c}").bitwiseAND(F.col(f"shared_{c}_2")).bitwiseAND(F.bitwise_not(x)) for c, x in zip(lanes, counted)]
    both = near.withColumn("salt", F.pmod(F.xxhash64("leaf", F.lit(1)), F.lit(SALTS)).cast("int")).join(lower.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["mask", "pattern", "limb_up", "salt"])
    pairs = both.where((F.col("leaf") <= F.col("leaf_2")) & (F.col("so_far") + far("_2", fresh) <= bits)).select("leaf", "leaf_2")
    sides = pairs.select("leaf", "leaf_2", F.explode(F.array_distinct(F.array("leaf", "leaf_2"))).alias("side"))
    work = sides.join(rows.select(F.col("leaf").alias("side"), *lanes), "side")

    def compare(key, pdf):
        import pandas as pd

        f = {}
        for s, part in pdf.groupby("side"):
            x = np.ascontiguousarray(part[lanes].to_numpy()).view(np.uint64)
            f[s] = x[gray_order(x)]
        left, right = f[key[0]], f[key[1]]
        one = key[0] == key[1]
        ids = node_ids(left if one else np.concatenate([left, right]))
        a, b = (ids[x] for x in near_links(left, None if one else right, bits))
        return pd.DataFrame({"src": a.view(np.int64), "dst": b.view(np.int64)})

    return work.groupBy("leaf", "leaf_2").applyInPandas(compare, "src long, dst long")


def _shared_bits(rows: DataFrame, lanes: list[str], group: str, suffix: str) -> DataFrame:
    """Per ``group`` of a node the lanes' AND, and a mask of the bits that all its fingerprints share."""
    shared = [F.bitwise_not(F.bit_and(c).bitwiseXOR(F.bit_or(c))).alias(f"shared_{c}{suffix}") for c in lanes]
    return rows.groupBy("mask", "pattern", group).agg(*[F.bit_and(c).alias(f"low_{c}{suffix}") for c in lanes], *shared)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(src, dst)``, where the root is the smallest node of its component.

    Stars in turn: every node links its larger neighbours to the least of its neighbours and itself, and then
    its smaller ones and itself to the least of those. A group that hangs on one node is done in one round and
    long paths shrink by a constant share. The rounds end when no link changes; the driver sees a count and a
    checksum of each. A node with very many links meets them by broadcast of its one row. A round has some ten exchanges, and
    the driver keeps a record of each of their tasks, so tables of a round have as many partitions as their links need;
    and up to ``TASK_LINKS`` links, the share of one task, take no rounds at all.
    """
    down = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    mark = lambda links: tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    now = mark(few(down))
    while now[0] > TASK_LINKS:
        parts = max(edges.sparkSession.sparkContext.defaultParallelism, -(-now[0] // TASK_LINKS))
        down = down.coalesce(parts)
        both = down.unionByName(down.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")).coalesce(parts)
        met = looked_up(both.where("b > a"), "a", least, 2 * now[0]).coalesce(parts)
        large = cut(met.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct().coalesce(parts))
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).coalesce(parts)
        tied = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        met = looked_up(large, "a", least, now[0]).coalesce(parts)
        down = cut(met.select(tied.alias("l")).select("l.*").where("a <> b").distinct().coalesce(parts))
        before, now = now, mark(down)
        if now == before:
            return down.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(down.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    return down.coalesce(1).mapInArrow(_rooted, "node long, root long")


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All links (a, b), few enough for one task -> (node, root) of each of their nodes."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if parts:
        a, b = (np.concatenate(x) for x in zip(*parts))
        ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
        lab = np.arange(len(ids))
        _tie(lab, inv[: len(a)], inv[len(a):])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[lab])], names=["node", "root"])


def near_duplicates(
    docs: DataFrame, words: int = 4, bits: int = 4, masks: list[tuple[int, ...]] | None = None, distinct: bool = False,
    id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF,
) -> DataFrame:
    """(doc_id, fp, component_id): one row per document with the group it belongs to.

    Documents link when their fingerprints differ in at most ``bits`` bits; the group's id is
    the smallest doc_id that links reach. ``masks`` are the index's, and their length is the
    number of lanes; by default one lane, and masks that lose no link. Repeated rows stay
    repeated. Null and blank texts share fingerprint zero and link like any other. A null
    doc_id takes part but is never the group's id unless all ids of the group are null. An
    empty table gives no rows.
    """
    masks = masks or block_masks(bits, bits + 2)
    lanes = lane_names(len(masks[0]))
    node = "node" if len(lanes) > 1 else "fp"
    fps = cut(fingerprints(docs, words, id_col, text_col, len(lanes), distinct))
    nodes = cut(fps.groupBy(*dict.fromkeys([node, *lanes])).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    roots = components(links(nodes.select(*lanes), bits, masks, leaf))
    return named(fps, nodes, roots, node).select("doc_id", "fp", "component_id")


def named(rows: DataFrame, nodes: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """``rows`` with ``component_id``: the smallest first_id of the nodes with the same root.

    ``nodes(node, first_id, n)`` says how many rows a node has, ``roots(node, root)`` has the
    linked nodes alone. Neither the nodes of a giant group nor the rows of a giant node meet in one task.
    """
    total = rows.count()
    linked = cut(few(nodes.select(node, "first_id").join(roots.withColumnRenamed("node", node).hint("merge"), node), total))
    n = linked.count()
    group = few(linked.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n")), n)
    of_node = few(looked_up(linked.select(node, "root"), "root", group, n).select(node, "component_id"), n)
    whole = few(nodes.select(node, "first_id", "n").join(of_node.hint("merge"), node, "left"), total)
    return few(looked_up(rows, node, whole.select(node, "n", F.coalesce("component_id", "first_id").alias("component_id")), total), total)


#: Least similarity (Jaccard, of the sets of five-word shingles) of near copies.
SIMILARITY = 0.8
#: Lanes and differing bits of a candidate. Sets of similarity 0.8 differ in 39 of 256 bits on average, 48 where they are smallest
#: (4 and 5 shingles), with a deviation of 6: 84 bits lie over five deviations away, so the limit only saves work.
WIDE_LANES, WIDE_BITS = 4, 84
#: A shingle in so many of the documents looked at (one in ``HOT_SHARE``) is hot; at most ``HOT_MOST`` are kept. Hot shingles come
#: last in the order of all shingles, which any order may be, so these numbers decide about work and not about results.
HOT, HOT_SHARE, HOT_MOST = 64, 16, 500_000
#: Shingles of the sets that one part of a candidate group holds; a task compares two parts exactly, larger groups are dealt out by pairs of parts.
PART = 1_000_000


def set_prefix(h: np.ndarray, least: float, hot: np.ndarray) -> np.ndarray:
    """The first shingles of the set ``h`` (sorted), hot ones last: two sets at least ``least`` similar share one of these."""
    n = len(h) - int(np.ceil(least * len(h) - 1e-9)) + 1 if len(h) else 0
    if len(hot) and len(h):
        known = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
        h = np.concatenate([h[~known], h[known]])
    return h[:n]


def hot_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles of many documents, sorted, from a part of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for texts in by_size(b.column(0).to_pylist(), 500_000):
                found = [np.unique(shingle_hashes(t, words)) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["t"])

    some = docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(HOT_SHARE)) == 0).select(F.col("text").cast("string").alias("text"))
    often = some.mapInArrow(run, "t long").groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") >= HOT).orderBy(F.desc("n"), "t").limit(HOT_MOST)
    return np.sort(often.select("t").toArrow().column(0).to_numpy().view(np.uint64))


def shingle_sets(docs: DataFrame, words: int, least: float, hot: np.ndarray) -> DataFrame:
    """(doc_id, text_key, set_id, n, lanes, node, prefix) of every row: a number for its set of shingles, the set's size,
    its fingerprint and the first of its shingles."""
    lanes = lane_names(WIDE_LANES)
    names = ["doc_id", "text_key", "set_id", "n", *lanes, "node", "prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                sets = [np.unique(shingle_hashes(t, words)) for t in b.column(2).to_pylist()]
                fp = set_fingerprints(sets, WIDE_LANES)
                firsts = [set_prefix(h, least, hot) for h in sets]
                ends = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
                cols = [np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], np.uint64), *fp.T, node_ids(fp)]
                cols = [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in cols]
                prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(firsts).view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), cols[0], pa.array([len(h) for h in sets], pa.int64()), *cols[1:], prefix], names=names)

    src = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    kinds = [src.schema["doc_id"].dataType.simpleString(), *["long"] * (len(names) - 2), "array<long>"]
    return src.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def similar_links(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links, as positions, that join all sets whose similarity is ``least`` or more, by exact counts.

    A search from set to set: what it reached once is not looked for again, so alike sets cost one comparison each.
    """
    size = np.array([len(h) for h in sets])
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ids = np.split(number, np.cumsum(size)[:-1])
    mark = np.zeros(len(number), bool)
    out_a, out_b, todo = [], [], []
    left = np.arange(len(sets))
    flat = None
    while len(left):
        if not todo:
            todo.append(left[0])
            left, flat = left[1:], None
            continue
        if flat is None:
            flat, starts = np.concatenate([ids[j] for j in left]), np.cumsum(size[left]) - size[left]
        i = todo.pop()
        mark[ids[i]] = True
        common = np.add.reduceat(mark[flat], starts, dtype=np.int64)
        mark[ids[i]] = False
        hit = common >= least * (size[i] + size[left] - common)
        if hit.any():
            out_a.append(np.full(hit.sum(), i))
            out_b.append(left[hit])
            todo += left[hit].tolist()
            left, flat = left[~hit], None
    return tuple(np.concatenate(o) if o else np.empty(0, np.int64) for o in (out_a, out_b))


def confirmed_links(docs: DataFrame, members: DataFrame, words: int, least: float, part: int = PART) -> DataFrame:
    """(src, dst): links of set_ids that are truly similar, within the candidate groups ``members(set_id, first_id, text_key, size, root)``.

    Each set's shingles are made again from one document that has them. A group of more than ``part`` shingles, set
    by set, is dealt into parts, and each pair of parts is one unit of work, so no task holds a large group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            # A document that is repeated brings its set once.
            fresh = [i for i, s in enumerate(whole.column("set_id").to_pylist()) if not (s in seen or seen.add(s))]
            whole, at = whole.take(pa.array(fresh, pa.int64())), 0
            for texts in by_size(whole.column("text").to_pylist(), 500_000):
                b = whole.slice(at, len(texts))
                at += len(texts)
                sets = [np.unique(shingle_hashes(t, words)).tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([b.column("root"), b.column("size"), b.column("set_id"), pa.array(sets, pa.binary())], names=["root", "size", "set_id", "shingles"])

    sizes = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).where("n > 1")
    total = members.count()
    wanted = few(looked_up(members.drop("size"), "root", few(sizes.withColumnRenamed("shingles", "size"), total), total), total).select(F.col("first_id").alias("__id"), F.col("text_key").alias("__key"), "root", "size", "set_id")
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    mine_of = texts.join(wanted.hint("merge"), texts["doc_id"].eqNullSafe(F.col("__id")) & (texts["text_key"] == F.col("__key")))
    rows = mine_of.select("root", "size", "set_id", "text").mapInArrow(run, "root long, size long, set_id long, shingles binary")
    parts = F.ceil(F.col("size") / F.lit(part)).cast("int")
    mine = F.pmod(F.xxhash64("set_id", F.lit(7)), parts).cast("int")
    others = F.filter(F.sequence(F.lit(0), parts - 1), lambda o: (o != F.col("part")) | (F.col("parts") == 1))
    dealt = rows.withColumns({"part": mine, "parts": parts}).withColumn("other", F.explode(others))
    units = dealt.select("root", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "set_id", "shingles")

    def compare(table: pa.Table) -> pa.Table:
        ids, at = np.unique(table.column("set_id").to_numpy(), return_index=True)
        every = table.column("shingles").to_pylist()
        a, b = similar_links([np.frombuffer(every[i], np.uint64) for i in at], least)
        return pa.table({"src": pa.array(ids[a], pa.int64()), "dst": pa.array(ids[b], pa.int64())})

    return units.groupBy("root", "one", "two").applyInArrow(compare, "src long, dst long")


def similar_groups(docs: DataFrame, words: int = 5, least: float = SIMILARITY, part: int = PART) -> DataFrame:
    """(doc_id, text_key, component_id, component_key) of every row: groups that links of an exact similarity of ``least`` or more reach, named by the
    smallest doc_id, or null if none has one, and by the smallest hash of a text with that doc_id.

    Upper nodes of the index are shingles: of each set the first in one order of all shingles, so many that
    two sets that similar share one. Fingerprints below one node within ``WIDE_BITS`` bits make candidate
    groups, and inside these every link is confirmed by the shingle sets themselves. Texts without a word
    are one group of exact copies.
    """
    lanes = lane_names(WIDE_LANES)
    rows = cut(shingle_sets(docs, words, least, hot_shingles(docs, words)))
    slim, total = rows.select("doc_id", "text_key", "set_id", "n", "node"), rows.count()
    below = rows.groupBy("set_id", *lanes).agg(F.first("prefix").alias("prefix")).select(F.lit(0).cast("short").alias("mask"), F.explode("prefix").alias("pattern"), *lanes)
    near = components(links_below(below, lanes, WIDE_BITS))
    sets = cut(few(slim.groupBy("set_id", "node").agg(F.min(F.struct("doc_id", "text_key")).alias("f"), F.max("n").alias("size"), F.count("*").alias("n")).select("set_id", "node", "f.*", "size", "n").withColumnRenamed("doc_id", "first_id"), total))
    members = cut(few(sets.where("size > 0").join(near.hint("merge"), "node", "left").select("set_id", "first_id", "text_key", "size", F.coalesce("root", "node").alias("root")), total))
    roots = components(confirmed_links(docs, members, words, least, part))
    # The row that names a group, one with a doc_id before one without.
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    smallest = slim.groupBy("set_id").agg(F.min(first).alias("first_id"), F.count("*").alias("n"))
    return named(slim.select("doc_id", "text_key", "set_id"), smallest, roots, "set_id").select(
        "doc_id", "text_key", F.col("component_id.doc_id").alias("component_id"), F.col("component_id.text_key").alias("component_key")
    )


def keep_one(docs: DataFrame, words: int = 5, least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one of smallest doc_id, then of smallest hash of its text.

    Documents link if the sets of their shingles are at least ``least`` similar. All columns stay as they are. A row goes only if its own text has a link
    to one that stays, so rows of one doc_id with texts that are not alike all stay; of rows of one doc_id and text the
    one whose columns are smallest stays. A row whose doc_id is null cannot be told apart and stays.
    """
    with small_batches(docs.sparkSession):
        groups = cut(similar_groups(docs, words, least).where("doc_id IS NOT NULL"))
    own = ["doc_id", "text_key"]
    other = (F.col("doc_id") != F.col("component_id")) | (F.col("text_key") != F.col("component_key"))
    gone = groups.where(other).select(*own).distinct().select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    same = (F.col("doc_id") == F.col("__id")) & (F.col("__text_key") == F.col("__key"))
    kept = docs.withColumn("__text_key", F.xxhash64("text")).join(gone, same, "left_anti")
    twice = groups.where(~other).groupBy(*own).agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    again = cut(few(twice, groups.count()))
    if again.isEmpty():
        return kept.select(docs.columns)
    one = kept.join(again, same, "left_semi").groupBy("doc_id", "__text_key").agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")
    return kept.join(again, same, "left_anti").select(docs.columns).unionByName(one)
