"""Secret scans: spans by pattern, and weak candidates linked to their complement.

Everything is DataFrame functions. Spark gives no match positions, so each pattern is
applied twice, once for the matches and once to split the text between them; the running
sum of both lengths is the position, in code points. Only spans leave the scan, never text.

A credential comes in parts: an *identifier* (who), a *secret* (the proof) and an *endpoint*
(where). Strong kinds are reported as they stand. Weak kinds - user names, random-looking
tokens, plain URLs - mean nothing alone and are reported only if the parts that complete
them lie within ``scope`` code points of the same text: an identifier needs a secret, a
secret needs an identifier, an endpoint needs both. The interval join of parts within a
text is one sweep forwards and one backwards over spans sorted by start, so a text full of
parts costs its sorted length and never all pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
#: Strong kinds in the order that breaks ties of start: (name, pattern, part).
ASSIGN = rf"(?i)(password|passwd|secret|token|api_?key){_VALUE}([A-Za-z0-9+/_.=-]+)"
STRONG = [
    ("assign", ASSIGN, "secret"),
    ("access", r"AKIA[A-Z0-9]{16,}", "identifier"),
    ("hex", r"[0-9a-f]{24,}", "secret"),
]
#: Weak kinds. A user name or key id; a token of 32 or more base64 characters; a URL.
WEAK = [
    ("ident", rf"(?i)(user_?name|user|login|client_?id|access_?key_?id|account){_VALUE}([A-Za-z0-9+/_.@=-]+)", "identifier"),
    ("blob", r"[A-Za-z0-9+/_=-]{32,}", "secret"),
    ("endpoint", r"""https?://[^\x20\x09-\x0D"'<>]+""", "endpoint"),
]
#: Literals of which any match of a kind holds one; a text without them is not searched for that kind.
HOLDS = {"assign": (":", "="), "access": ("AKIA",), "ident": (":", "="), "endpoint": ("://",)}
MIN_ASSIGN = 6
SCOPE = 200


def _matches(text: Column, number: int, name: str, pattern: str, part: str) -> Column:
    """Array of (ord, kind, part, i, gap, len, ok), one per match of the pattern; null for a text that cannot have any."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))

    def one(z: Column, i: Column) -> Column:
        good = F.length(F.regexp_extract(z["m"], pattern, 2)) >= MIN_ASSIGN if name == "assign" else F.lit(True)
        return F.struct(
            F.lit(number).alias("ord"), F.lit(name).alias("kind"), F.lit(part).alias("part"), i.alias("i"),
            F.length(z["g"]).cast("long").alias("gap"), F.length(z["m"]).cast("long").alias("len"), good.alias("ok"),
        )

    every = F.transform(F.filter(found, lambda z: z["m"].isNotNull()), one)
    return F.when(reduce(lambda a, b: a | b, [text.contains(x) for x in HOLDS[name]]), every) if name in HOLDS else every


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, ord, kind, part, ok, start, end): each match of each kind, failing ones with ok false.

    A document without matches keeps one row of nulls. ``row`` tells apart rows of equal id.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    kinds = [_matches(F.col("text"), n, *k) for n, k in enumerate(STRONG + WEAK)]
    each = src.select("row", "doc_id", F.explode_outer(F.flatten(F.array_compact(F.array(*kinds)))).alias("s")).select("row", "doc_id", "s.*")
    w = Window.partitionBy("row", "ord").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("len")).over(w)
    return each.repartition("row").select("row", "doc_id", "ord", "kind", "part", "ok", (end - F.col("len")).alias("start"), end.alias("end"))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``found`` with weak spans kept only where their complement lies in scope.

    Failing matches, and weak secrets that lie on a strong span, turn into rows without a
    kind, which keep their document.
    """
    order = ["start", "ord"]
    before = Window.partitionBy("row").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    strong = F.col("ok") & (F.col("ord") < len(STRONG))
    start, end = F.col("start"), F.col("end")
    on_strong = F.coalesce(F.max(F.when(strong, end)).over(before) > start, F.lit(False)) | F.coalesce(F.min(F.when(strong, start)).over(after) < end, F.lit(False))
    marked = found.withColumn("ok", F.col("ok") & ~((F.col("kind") == "blob") & on_strong))

    def near(part: str) -> Column:
        has = F.col("ok") & (F.col("part") == part)
        left = F.max(F.when(has, end)).over(before) >= start - scope
        right = F.min(F.when(has, start)).over(after) <= end + scope
        return F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False))

    both = marked.withColumns({"by_id": near("identifier"), "by_secret": near("secret")})
    complete = (
        F.when(F.col("ord") < len(STRONG), True).when(F.col("kind") == "ident", F.col("by_secret"))
        .when(F.col("kind") == "blob", F.col("by_id")).otherwise(F.col("by_id") & F.col("by_secret"))
    )
    return both.withColumn("kind", F.when(F.col("ok") & complete, F.col("kind"))).drop("by_id", "by_secret", "ok")


def scan(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): each document with its array of (start, ord, kind, part, end), by start.

    Null and empty texts have an empty array; repeated rows are scanned each for itself.
    """
    keep = F.when(F.col("kind").isNotNull(), F.struct("start", "ord", "kind", "part", "end"))
    return (
        linked(spans(docs, id_col, text_col), scope).groupBy("row")
        .agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(keep)).alias("spans")).drop("row")
    )


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the strong kinds and the spans as text; a row without spans has counts of zero, the hash of the empty text and an empty text."""
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["ord"] < len(STRONG))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select("doc_id", *[count(k) for k, _, _ in STRONG], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
