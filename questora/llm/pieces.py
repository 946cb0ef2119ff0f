"""SentencePiece encoding and decoding through a table of distinct chunks.

A chunk is a run of white-space markers with what follows them up to the next marker. Where no piece of the vocabulary has a
marker behind another character, no merge crosses from one chunk to the next, so a text's ids are those of its chunks,
one after the other. The corpus's chunks are counted and the commonest are segmented once for all tasks; a task segments
each other chunk once, when it meets it first. Ids are then joined back by position.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, cut

MARK = "▁"
#: Bounds of the table that all tasks get: chunks, and characters of each.
TABLE, LONG = 200_000, 32
#: Chunks that a task counts, and characters of chunks of its own that it keeps, before it lets go of them.
COUNTED, KEPT = 300_000, 8_000_000
#: Characters of texts worked on at once.
AT_ONCE = 500_000
#: Steps of the histogram of counts to a doubling.
STEPS = 4


def chunks(text: str | None) -> list[str]:
    """The chunks of a text, each without its first marker and with spaces for the others; a null or empty text has none.

    The encoder puts one marker in front of a text. A chunk is what, given to it alone, gets that
    marker back, but for a lone marker, which is the empty string here.
    """
    if not text:
        return []
    words = text.replace(MARK, " ").split(" ")
    if "" not in words:
        return words
    out, lead = [], ""
    for n, w in enumerate(words):
        if w or n == len(words) - 1:
            out.append(lead + w)
            lead = ""
        else:
            lead += " "
    return out


class Table(dict):
    """Ids of chunks, as the bytes of 32-bit integers; ``odd`` has the chunks that decode to something else than themselves."""

    def __init__(self, model: bytes, known: dict[str, bytes] | None = None, odd: dict[str, str] | None = None) -> None:
        super().__init__(known or {})
        self.of, self.odd, self.first, self.chars = sentencepiece.SentencePieceProcessor(model_proto=model), dict(odd or {}), known or {}, 0
        self.mark = self.of.piece_to_id(MARK)
        self.first_odd = dict(self.odd)

    def learn(self, found: set[str]) -> None:
        """Segments those of ``found`` that are not there, each once; forgets the task's own chunks before, where there are many."""
        if self.chars > KEPT:
            self.clear()
            self.update(self.first)
            self.odd, self.chars = dict(self.first_odd), 0
        fresh = [c for c in found if c not in self]
        ids = self.of.encode(fresh, num_threads=1) if fresh else []
        if "" in fresh:
            ids[fresh.index("")] = [self.mark]
        for chunk, own, back in zip(fresh, ids, self.of.decode(ids, num_threads=1) if ids else []):
            self[chunk] = array("i", own).tobytes()
            self.chars += len(chunk) + 8
            if back != chunk:
                self.odd[chunk] = back


def by_chunks(model: bytes) -> bool:
    """Whether the model is one whose chunks can be segmented alone: no piece crosses a marker, and white space is kept as it is."""
    of = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = [of.id_to_piece(i) for i in range(of.get_piece_size())]
    plain = all(of.decode(of.encode(t)) == t for t in ("a", " a", "a  b", "a ", "Ａ́ ½\n\tx"))
    return plain and not any(MARK in p.lstrip(MARK) for p in pieces) and of.piece_to_id(MARK) != of.unk_id()


def chunk_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(chunk, n) of all texts, for chunks of at most ``LONG`` characters; tasks add up before anything is shuffled.

    What a task has met but once when it adds up is rare and left out, so ``n`` may be a little low; it only says which chunks are common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            few = {c: n for c, n in seen.items() if n > 1 and len(c) <= LONG}
            return pa.RecordBatch.from_arrays([pa.array(few.keys(), pa.string()), pa.array(few.values(), pa.int64())], names=["chunk", "n"])

        seen: Counter = Counter()
        for b in batches:
            for texts in by_size(b.column(0).to_pylist(), AT_ONCE):
                for t in texts:
                    seen.update(chunks(t))
                if len(seen) > COUNTED:
                    yield rows()
                    seen = Counter()
        yield rows()

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


def chunk_table(docs: DataFrame, model: bytes, most: int = TABLE, text_col: str = "text") -> DataFrame:
    """(chunk, ids, back): the commonest chunks with the bytes of their ids and what these decode to; at most ``most`` rows.

    All chunks at least as common as some count are in it, so it depends on the corpus alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(model)
        for b in batches:
            names = b.column(0).to_pylist()
            table.learn(set(names))
            ids = [table[c] for c in names]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array([table.odd.get(c) for c in names], pa.string())], names=["chunk", "ids", "back"])

    step = F.floor(F.log2("n") * STEPS).cast("int")
    counts = cut(chunk_counts(docs, text_col).withColumn("step", step))
    least, total = None, 0
    for r in sorted(counts.groupBy("step").count().collect(), reverse=True):
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    common = counts.where(F.col("step") >= F.lit(least if least is not None else 1 << 30))
    return common.select("chunk").mapInArrow(run, "chunk string, ids binary, back string")


def encode(docs: DataFrame, model: bytes, most: int = TABLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, text): for every row the ids of its whole text and the text that they decode to.

    ``model`` is the content of a SentencePiece model of byte-pair merges that ``by_chunks`` holds for; another is a ValueError. A null or empty text has
    no ids and decodes to the empty text. Rows that are repeated come out as often; columns beyond id and text are not read.
    """
    if not by_chunks(model):
        raise ValueError("pieces of this model cross white space, so chunks cannot be segmented one by one")
    spark = docs.sparkSession
    rows = chunk_table(docs, model, most, text_col).collect()
    shared = spark.sparkContext.broadcast((model, {r.chunk: bytes(r.ids) for r in rows}, {r.chunk: r.back for r in rows if r.back is not None}))
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(*shared.value)
        for b in batches:
            at = 0
            for texts in by_size(b.column(1).to_pylist(), AT_ONCE):
                parts = [chunks(t) for t in texts]
                table.learn(set().union(*parts))
                ids = [b"".join(map(table.__getitem__, p)) for p in parts]
                back = [" ".join(map(table.odd.get, p, p) if table.odd else p) for p in parts]
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), lists, pa.array(back, pa.string())], names=["doc_id", "ids", "text"])
                at += len(texts)

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")
