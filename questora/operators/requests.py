"""Requests in plain words, row by row, and what the requests of a session come to one after another.

A request is a row of words. Each word has a class of one letter, so a request is also a short string of classes, and
what is asked for is a pattern of that string: ``RQN`` is "replace question 3", ``NM`` "five more". Where a pattern
matches, the words at the same places are the number, the slot or the topic.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, WORD_NUMBERS
from . import fuzzy
from .lineage import cut

#: Words of a class; other words are ``w``, numbers ``N``, places in a row such as 3rd ``O``.
CLASSES = {
    "A": ["add", "include", "append", "insert", "give"],
    "R": ["replace", "change", "swap", "make", "mix"],
    "D": ["remove", "delete", "drop"],
    "Q": ["question", "questions", "q", "qs"],
    "S": ["slot", "card", "#"],
    "M": ["more", "extra", "additional"],
    "F": ["fewer", "less"],
    "P": ["on", "about", "from", "in", "for", "of", "with", "to", "into", "based", "related"],
    "X": ["double"], "H": ["halve"], "C": ["cut"], "W": ["down"], "T": ["it", "them"], "K": ["keep"],
}
_CLASS = {word: letter for letter, words in CLASSES.items() for word in words}
_NUMBER = {w: n for w, n in WORD_NUMBERS.items() if " " not in w and "-" not in w}
#: What a request asks for: the first pattern that its classes hold, and which class of word there is the number.
KINDS = [
    ("replace", "R(?:[QS]+N|O[QS])", "[NO]"), ("remove", "D(?:[QS]+N|O[QS])", "[NO]"), ("part", "RN(?:PT|Q)*P*w", "N"), ("double", "XT", None), ("halve", "HT", None),
    ("cut", "CT*W*PN", "N"), ("fewer", "NF", "N"), ("more", "NM", "N"), ("add", "^[^RD]*[AM][^RD]*$", "N"), ("retopic", "Rw+Pw", None),
]
#: Kinds that change a count that is there.
RELATIVE = ["double", "halve", "cut", "fewer", "more"]
LARGEST, USUAL = 50, 10

# Words of places, listeners, difficulty, and of requests that only shift the one before.
CITIES = {
    "karnataka": "Karnataka", "bangalore": "Bengaluru", "bengaluru": "Bengaluru", "mumbai": "Mumbai", "bombay": "Mumbai", "delhi": "Delhi", "chennai": "Chennai",
    "madras": "Chennai", "kolkata": "Kolkata", "calcutta": "Kolkata", "pune": "Pune", "hyderabad": "Hyderabad",
}
AUDIENCES = [("school", r"\b(?:school|kids?|class\s*\d+|assembly|children)\b"), ("college", r"\b(?:college|fest|hostel|campus)\b"), ("corporate", r"\b(?:corporate|company|office|offsite)\b")]
BIASES = [("hard", r"\b(?:hard|harder|tough|tougher|difficult|spicy|spicier)\b"), ("easy", r"\b(?:easy|easier|simple|beginner|warmup)\b"), ("medium", r"\b(?:medium|moderate|balanced)\b")]
FLAGS = {
    "no_images": r"\b(?:no images?|text only|without images?)\b", "evergreen": r"\b(?:evergreen|timeless)\b", "padding": r"\b(?:related|adjacent|whatever you have|fill the rest)\b",
}
MODIFIERS = [
    "make", "it", "more", "harder", "easier", "tougher", "spicier", "tough", "spicy", "easy", "warmup", "balanced", "for", "school", "kids", "children", "college", "corporate",
    "no", "text", "only", "without", "with", "image", "images", "evergreen",
]
#: Words that say nothing about what is looked for.
PLAIN = ["quiz", "create", "hard", "medium", "difficult", "simple", "moderate", "beginner", "me", "another", "some", "please"]

FIELDS = ["query", "city", "audience", "bias", "no_images", "evergreen", "padding", "school_safe", "india_focused"]


def _lookup(table: dict, word: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), word)


def _first(pairs: list[tuple[str, str]], text: Column) -> Column:
    return F.coalesce(*[F.when(text.rlike(p), name) for name, p in pairs])


def parsed(requests: DataFrame, prompt: Column) -> DataFrame:
    """``requests`` with ``kind``, ``n`` (the number that goes with it), ``topic`` and the fields of a brief that the prompt names; the others are null.

    ``kind`` is one of ``KINDS``, ``none`` for a set of zero questions, or ``new``. ``n`` of a new request is its first number. ``query`` is what is to be looked
    for: the topic, or the words without those of the classes; null where the request only shifts the one before. A null prompt is an empty one.
    """
    low = F.lower(F.coalesce(prompt, F.lit("")))
    words = F.regexp_extract_all(low, F.lit(r"#|\d+(?:st|nd|rd|th)\b|[a-z0-9]+"), F.lit(0))
    letter = lambda w: F.coalesce(_lookup(_CLASS, w), F.when(w.isin(list(_NUMBER)) | w.rlike(r"^\d{1,3}$"), "N"), F.when(w.rlike(r"^\d+[snrt][tdh]$"), "O"), F.lit("w"))
    rows = requests.withColumns({"__low": low, "__w": words}).withColumn("__c", F.array_join(F.transform("__w", letter), ""))
    c, w = F.col("__c"), F.col("__w")
    number = lambda word: F.coalesce(_lookup(_NUMBER, word), F.try_to_number(F.regexp_extract(word, r"^\d{1,3}", 0), F.lit("999")).cast("int"))
    first_of = lambda pattern: F.regexp_instr(c, F.lit(pattern))
    zero = (first_of("NQ") > 0) & (number(F.get(w, first_of("NQ") - 1)) == 0)
    kind = F.coalesce(F.when(zero, "none"), *[F.when(first_of(p) > 0, name) for name, p, _ in KINDS], F.lit("new"))
    # The number is the first one of its class in what the kind's pattern matched.
    place = F.lit(0)
    for name, p, digit in KINDS:
        if digit:
            begin = first_of(p)
            inside = F.regexp_instr(F.regexp_extract(c, p, 0), F.lit(digit))
            place = F.when((F.col("kind") == name) & (inside > 0), begin + inside - 1).otherwise(place)
    place = F.when(F.col("kind").isin("new", "retopic"), first_of("N")).otherwise(place)
    rows = rows.withColumn("kind", kind).withColumn("n", F.when(place > 0, number(F.get(w, place - 1))))
    # A topic begins behind what the pattern matched up to it, and ends where the rest is to be kept.
    ends = F.coalesce(F.nullif(F.regexp_instr(c, F.lit("w?K")), F.lit(0)) - 1, F.size(w))
    def behind(pattern: str) -> Column:
        size = F.length(F.regexp_extract(c, pattern, 0))
        return F.when(size > 0, F.slice(w, size + 1, F.greatest(ends - size, F.lit(0))))

    said = F.coalesce(
        F.when(F.col("kind") == "part", behind("^.*?RN(?:PT|Q)*P*")), F.when(F.col("kind") == "retopic", behind("^.*?Rw+P+")), F.when(F.col("kind") == "replace", behind("^.*?R(?:[QS]+N|O[QS])P+")),
        F.when(F.col("kind") == "add", F.coalesce(behind("^.*?(?:[QM])P+"), F.filter(w, lambda x: ~x.isin([*_CLASS, *_NUMBER, *STOP_WORDS, *PLAIN]) & ~x.rlike(r"^\d")))),
    )
    topic = F.trim(F.array_join(F.filter(said, lambda x: ~x.isin(CLASSES["Q"])), " "))
    topic = F.when((F.length(topic) > 1) & ~topic.isin(STOP_WORDS), topic)
    rows = rows.withColumn("topic", F.when(F.col("kind") == "part", F.coalesce(topic, F.lit("general knowledge"))).otherwise(topic))
    own = F.array_join(F.array_distinct(F.filter(w, lambda x: ~x.isin([*_CLASS, *_NUMBER, *STOP_WORDS, *MODIFIERS, *PLAIN]) & ~x.rlike(r"^\d"))), " ")
    shifts = F.col("kind").isin("none", "remove", "replace", "add", *RELATIVE) | F.forall(w, lambda x: x.isin(MODIFIERS))
    text = F.col("__low")
    audience = _first(AUDIENCES, text)
    city = _lookup(CITIES, F.get(F.filter(w, lambda x: x.isin(list(CITIES))), F.lit(0)))
    yes = lambda test: F.when(test, True)
    return rows.withColumns({
        "query": F.when(~shifts, F.coalesce(F.when(F.col("kind").isin("part", "retopic"), F.col("topic")), F.nullif(own, F.lit("")))), "city": city, "audience": audience, "bias": _first(BIASES, text),
        **{name: yes(text.rlike(p)) for name, p in FLAGS.items()}, "school_safe": yes((audience == "school") | text.rlike(r"\b(?:family|safe)\b")),
        "india_focused": F.coalesce(yes(city.isNotNull() | text.rlike(r"\b(?:india|indian|desi)\b")), F.when(text.rlike(r"\b(?:international|world|global)\b"), False)),
    }).drop("__low", "__w", "__c")


#: What a model says about a request.
SAID = "query string, count int, topics array<string>, subtopics array<string>, filters map<string,string>, difficulty string, audience string, locality string, tone array<string>"


def interpreted(answers: DataFrame, key: str, said: str, taxonomy: DataFrame) -> DataFrame:
    """(key, query, count, l1s, l2s, dropped, filters, bias, audience, city, tone): briefs from a model's JSON answers, one row each.

    Words of the query count once whatever their case and the marks behind them; the count lies in 1 to ``LARGEST`` and is ``USUAL`` where none is said. Topics are known
    names of ``taxonomy(l1, l2)``, as ``fuzzy.topics`` has them. Rows whose answer is null or no JSON object of these kinds have a null query and no topics.
    """
    r = answers.select(key, F.from_json(F.col(said), SAID).alias("r")).select(key, "r.*")
    words = F.filter(F.split(F.coalesce("query", F.lit("")), r"\s+"), lambda w: F.regexp_replace(w, r"[.,;:!?]", "") != "")
    plain = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"^[.,;:!?]+|[.,;:!?]+$", ""))
    once = F.array_join(F.filter(words, lambda w, i: F.array_position(plain, F.get(plain, i)) == i + 1), " ")
    names = fuzzy.topics(r, key, "topics", "subtopics", taxonomy)
    out = r.select(
        F.col(key).alias("__key"), F.when(F.col("query").isNotNull(), once).alias("query"), F.least(F.greatest(F.coalesce("count", F.lit(USUAL)), F.lit(1)), F.lit(LARGEST)).alias("count"), "filters",
        F.col("difficulty").alias("bias"), "audience", F.col("locality").alias("city"), F.coalesce("tone", F.array().cast("array<string>")).alias("tone"),
    )
    return names.join(out, F.col(key) == F.col("__key")).drop("__key")


COUNTS = np.arange(LARGEST + 1)


def count_after(kind: str, n: int | None) -> np.ndarray:
    """The count of a set after a request, for each count before it; entry 0 stands for a session's first request, which has none before."""
    n = n or 0
    out = {
        "double": COUNTS * 2, "halve": COUNTS // 2, "cut": np.full(LARGEST + 1, n), "fewer": COUNTS - n, "more": COUNTS + n, "add": COUNTS + (n or 1), "remove": COUNTS - 1,
        "new": np.full(LARGEST + 1, n) if n else COUNTS, "retopic": np.full(LARGEST + 1, n) if n else COUNTS,
    }.get(kind, COUNTS).copy()
    out[0] = n if n and kind not in ("replace", "remove") else USUAL
    return np.clip(out, 1, LARGEST)


def _then(before: tuple, after: tuple) -> tuple:
    """Two requests, or runs of requests, as one: what the counts become, and of each field the last value that was named."""
    return after[0][before[0]], [b if b is not None else a for a, b in zip(before[1], after[1])]


def briefs(requests: DataFrame, session: str, order: list[str], prompt: Column, parts: int | None = None) -> DataFrame:
    """``requests`` with the brief that holds after each: ``count`` and the fields of ``FIELDS``, inherited from the session's requests before.

    The rows are dealt out by ranges of session and order, so that a long session lies in several tasks. Each task works out what its last session's rows
    come to; these, one for each of the tasks (``parts`` of them, or as many as Spark sees fit), are put together in the driver, and each task then begins where the one before it ended.
    Rows of a null session are one session; rows of equal order come in the order of their prompts.
    """
    rows = parsed(requests.withColumn("__prompt", prompt), F.col("__prompt"))
    keys = [session, *order, "__prompt"]
    sorted_rows = cut((rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()))
    effect = lambda r: (count_after(r["kind"], r["n"]), [r[f] for f in FIELDS])

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last, one, total = None, None, None, True, None
        for b in batches:
            for r in b.to_pylist():
                if part is None:
                    part, first = r["__part"], r[session]
                    total, last = effect(r), r[session]
                elif r[session] == last:
                    total = _then(total, effect(r))
                else:
                    total, last, one = effect(r), r[session], False
        if part is not None:
            text = [None if v is None else str(v) for v in total[1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([repr(first)]), pa.array([repr(last)]), pa.array([one]), pa.array([total[0].tolist()], pa.list_(pa.int64())), pa.array([text], pa.list_(pa.string()))],
                names=["part", "first", "last", "one", "counts", "fields"],
            )

    ends = sorted_rows.select("__part", session, "kind", "n", *FIELDS).mapInArrow(summary, "part int, first string, last string, one boolean, counts array<long>, fields array<string>").collect()
    known = {f: rows.schema[f].dataType.simpleString() for f in FIELDS}
    begin: dict[int, tuple] = {}
    before, at = None, None
    for e in sorted(ends):
        own = (np.array(e.counts), [v if v is None or known[f] != "boolean" else v == "True" for f, v in zip(FIELDS, e.fields)])
        if before is not None and e.first == at:
            begin[e.part] = before
            before = _then(before, own) if e.one else own
        else:
            before = own
        at = e.last
    names = [c for c in sorted_rows.columns if c not in ("__prompt", "__part", *FIELDS)]
    kinds = ", ".join(f"`{c}` {sorted_rows.schema[c].dataType.simpleString()}" for c in names) + ", count int, " + ", ".join(f"{f} {known[f]}" for f in FIELDS)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last, started = None, None, False
        for b in batches:
            counts, fields = [], []
            for r in b.select([session, "__part", "kind", "n", *FIELDS]).to_pylist():
                if not started:
                    state, last, started = begin.get(r["__part"]), r[session], True
                elif r[session] != last:
                    state, last = None, r[session]
                state = effect(r) if state is None else _then(state, effect(r))
                counts.append(int(state[0][0]))
                fields.append(state[1])
            cols = [pa.array(c, pa.bool_() if known[f] == "boolean" else pa.string()) for f, c in zip(FIELDS, zip(*fields) if fields else [[]] * len(FIELDS))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(counts, pa.int32()), *cols], names=[*names, "count", *FIELDS])

    return sorted_rows.mapInArrow(follow, kinds)


def replaced_in_part(slots: DataFrame, wanted: DataFrame, fills: DataFrame, session: str) -> DataFrame:
    """``slots(session, slot, id, locked, excluded)`` with ``n`` of each session's filled anew, as ``wanted(session, n)`` says.

    Slots whose row was excluded go first, then those from the end, locked ones last and from the front. ``fills(session, pos, id)`` are the new rows in order from 1; the
    lowest slot gets the first. A slot for which nothing is left, and a session without a wish, stay as they are.
    """
    open_first = F.when(F.col("locked"), 2).when(F.col("excluded"), 0).otherwise(1)
    turn = F.row_number().over(Window.partitionBy(session).orderBy(open_first, F.when(open_first == 1, -F.col("slot")).otherwise(F.col("slot"))))
    marked = slots.join(wanted.select(F.col(session).alias("__s"), F.col("n").alias("__n")), F.col(session) == F.col("__s"), "left").withColumn("__go", F.coalesce(turn <= F.col("__n"), F.lit(False))).drop("__s", "__n")
    nth = F.when(F.col("__go"), F.sum(F.col("__go").cast("int")).over(Window.partitionBy(session).orderBy("slot")))
    new = fills.select(F.col(session).alias("__s"), F.col("pos").alias("__p"), F.col("id").alias("__id"))
    found = marked.withColumn("__nth", nth).join(new, (F.col(session) == F.col("__s")) & (F.col("__nth") == F.col("__p")), "left")
    return found.select(session, "slot", F.coalesce("__id", "id").alias("id"), "locked", (F.col("__id").isNotNull()).alias("replaced"))
