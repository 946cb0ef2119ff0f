"""Vector code compression: each part of a vector becomes the number of its codebook's nearest entry.

Codebooks are trained on all vectors, in integers, so a run's result does not depend on how the rows lie. The nearest entry
is found coarse to fine: cut into one, two, then four blocks, a part and an entry are at least as far apart as
their block means and the norms of what the blocks have beyond their means allow. An entry whose bound is
above an exact distance already known is out; what is left gets its exact distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: A component x is the integer floor(SCALE * x).
SCALE = 4096
#: Components whose integer lies beyond this are taken as it; errors beyond a long are the largest long.
MOST, LONG = 2**62, 2**63 - 1
#: Blocks of a part, coarse to fine.
BLOCKS = (1, 2, 4)
#: What rounding can take from a bound, as a share of the squared norms.
SLACK = 1e-9
#: Labels up to which their sums are broadcast, some 2 MB.
FEW = 100_000


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), as 64-bit integers."""
    with np.errstate(over="ignore"):
        x = np.floor(np.asarray(values, np.float64) * SCALE)
    far = np.abs(x) >= MOST
    return np.where(far, np.sign(x).astype(np.int64) * MOST, np.where(far, 0, x).astype(np.int64))


def _blocks(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, sums and the norms beyond the means of ``k`` blocks of each row."""
    at = np.arange(k) * x.shape[1] // k
    size = np.diff(np.append(at, x.shape[1]))
    total, square = np.add.reduceat(x, at, axis=1), np.add.reduceat(x * x, at, axis=1)
    return size, total, np.sqrt((size * square - total * total) / size)  # the difference is exact, and never negative


def bounds(x: np.ndarray, book: np.ndarray, k: int, rows: np.ndarray, entries: np.ndarray, of_x: tuple, of_book: tuple) -> np.ndarray:
    """Lower bounds of the squared distances of some pairs (row, entry), from ``k`` blocks; rounding never makes them too high."""
    size, sx, rx = of_x
    _, sb, rb = of_book
    gap = (sx[rows] - sb[entries]).astype(np.float64)
    low = (gap * gap / size + (rx[rows] - rb[entries]) ** 2).sum(1)
    return low - SLACK * ((x * x).sum(1)[rows] + (book * book).sum(1)[entries]).astype(np.float64) - 1e-6


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, squared distance) of each row of ``x``, ties to the lower entry; and how many distances were worked out."""
    n, m = x.shape
    peak = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if (2 * m * peak) ** 2 >= 2**61:  # sums would not fit: exact numbers of any size
        d = ((x.astype(object)[:, None] - book.astype(object)[None]) ** 2).sum(2)
        e = np.array([min(range(len(book)), key=r.__getitem__) for r in d], np.int64)
        return e, d[np.arange(n), e], d.size
    rows, entries = np.repeat(np.arange(n), len(book)), np.tile(np.arange(len(book)), n)
    best = None
    for k in (k for k in BLOCKS if k <= m):
        low = bounds(x, book, k, rows, entries, _blocks(x, k), _blocks(book, k))
        if best is None:
            likely = low.reshape(n, -1).argmin(1)
            best = ((x - book[likely]) ** 2).sum(1)
        left = low <= best[rows]
        rows, entries = rows[left], entries[left]
    out = np.full((n, len(book)), LONG)
    out[rows, entries] = ((x[rows] - book[entries]) ** 2).sum(1)
    e = out.argmin(1)
    return e, out[np.arange(n), e], len(rows) + n


def _vectors(column: pa.ListArray) -> np.ndarray:
    return whole(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), -1)


def kept(df: DataFrame, id_col: str, vec_col: str, parts: int = PARTS, extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, vec, *extra) of the rows whose vector takes part: no null, all components finite, and ``parts`` equal parts as long as the first row's."""
    v = F.col("vec")
    src = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), *[F.col(c).alias(f"x_{c}") for c in extra])
    good = src.where(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    head = good.orderBy(F.col("id").asc_nulls_last(), "vec").select(F.size("vec").alias("m")).first()
    return good.where(F.size("vec") == (head.m if head else 0))


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """(parts, entries, length): the parts of the ``entries`` smallest ids' vectors; of an id that is repeated the smallest vector; null ids come last."""
    ids = F.broadcast(rows.select("id").distinct().orderBy(F.col("id").asc_nulls_last()).limit(entries).withColumnRenamed("id", "__id"))
    few = rows.join(ids, F.col("id").eqNullSafe(F.col("__id"))).groupBy("id").agg(F.min("vec").alias("vec")).collect()
    if not few:
        return None
    few.sort(key=lambda r: (r.id is None, r.id or 0))
    x = whole(np.array([r.vec for r in few]))
    return x.reshape(len(few), parts, -1).transpose(1, 0, 2).copy()


def moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the floored mean of the parts nearest to it; an unused one stays. Tasks add up their own parts first."""
    parts, entries, m = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts, entries, m), object), np.zeros((parts, entries), np.int64)
        for b in batches:
            x = _vectors(b.column(0)).reshape(b.num_rows, parts, m)
            wide = b.num_rows and int(np.abs(x).max()) * b.num_rows >= LONG
            for p in range(parts if b.num_rows else 0):
                e = nearest(x[:, p], books[p])[0]
                own = np.zeros((entries, m), object if wide else np.int64)
                np.add.at(own, e, x[:, p].astype(own.dtype))
                total[p] += own.astype(object)
                n[p] += np.bincount(e, minlength=entries)
        p, e = np.nonzero(n)
        for i in range(m):
            yield pa.RecordBatch.from_arrays(
                [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array([i] * len(p), pa.int32()), pa.array([str(v) for v in total[p, e, i]], pa.string()), pa.array(n[p, e])],
                names=["part", "entry", "place", "total", "n"],
            )

    own = rows.select("vec").mapInArrow(run, "part int, entry int, place int, total string, n long")
    sums = own.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = books.copy()
    for r in sums.collect():  # as many rows as the codebooks have components
        out[r.part, r.entry, r.place] = int(r.total) // r.n
    return out


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    books = first_books(rows, parts, entries)
    for _ in range(rounds if books is not None else 0):
        books = moved(rows, books)
    return books


def assigned(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``rows`` with ``codes``, the entry of each part, and ``error``, the squared distances added up, instead of ``vec``."""
    parts, _, m = books.shape
    others = [c for c in rows.columns if c != "vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _vectors(b.column("vec")).reshape(b.num_rows, parts, m)
            codes, error = np.zeros((b.num_rows, parts), np.int32), np.zeros(b.num_rows, object)
            for p in range(parts if b.num_rows else 0):
                codes[:, p], d = nearest(x[:, p], books[p])[:2]
                error += d.astype(object)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * parts), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), lists, pa.array([min(int(v), LONG) for v in error], pa.int64())], names=[*others, "codes", "error"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.mapInArrow(run, f"{kinds}, codes array<int>, error long")


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """((id, codes, error, label, label_error), codebooks) of the rows whose vector takes part.

    A vector that is null or empty, holds a null or a component that is not finite, has no ``parts`` equal parts or another length than that of the smallest id takes
    no part. ``label_error`` adds up ``error`` over rows of an equal label, null being one; a sum beyond a long is the largest long. Rows are
    not told apart by their ids, so repeated ones come out as often. With fewer ids than ``entries`` there are as many entries as ids; without rows there are no codebooks.
    """
    rows = kept(df, id_col, vec_col, parts, (label_col,))
    books = train(rows, parts, entries, rounds)
    if books is None:
        return rows.select("id", F.lit(None).cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"), F.col(f"x_{label_col}").alias("label"), F.lit(0).cast("long").alias("label_error")), None
    coded = cut(assigned(rows, books).withColumnRenamed(f"x_{label_col}", "label"))
    sums = cut(coded.groupBy(F.col("label").alias("__label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long").alias("label_error")))
    side = F.broadcast(sums) if sums.count() <= FEW else sums
    return coded.join(side, F.col("label").eqNullSafe(F.col("__label"))).drop("__label"), books
