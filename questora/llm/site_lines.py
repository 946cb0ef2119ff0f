"""Line dedup by site-relative frequency, with DataFrame functions only.

A line is boilerplate on a host if more than a given share of the host's pages contain it.
Counting is by (host, hash of the normalised line); lines are made distinct within a page
before the shuffle and counts are summed map-side, so neither a host with most of the pages
nor a line on all of them lands in one task.

The boilerplate of one host is short whatever its size: pages have L distinct lines on
average, so at most L / ratio lines can be on more than ``ratio`` of them. That list joins the
pages by host, and each page filters its own lines in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, with_lists

#: Share of a host's pages beyond which a line is boilerplate there.
RATIO = 0.2
#: Pages that must share a line before a share means anything.
MIN_PAGES = 5


def normal_lines(text: Column) -> Column:
    """Lines of a text in lower case, runs of white space as one space, trimmed; digits as they are.

    White space is normalised in the whole text at once, line ends apart.
    """
    return F.transform(F.split(F.regexp_replace(F.lower(text), r"[\x20\t\x0B\f\r]+", " "), "\n", -1), lambda x: F.trim(x))


def line_keys(text: Column) -> Column:
    """Hash of each line in order; null for lines without a word, and null for a null text."""
    return F.transform(normal_lines(text), lambda n: F.when(n != "", F.xxhash64(n)))


def frequent_lines(pages: DataFrame, share: float, above: int) -> DataFrame:
    """(host, items): per host the keys of lines on more than ``share`` of its pages and on more than ``above``; ``pages(host, keys)``.

    A null array of keys is a page without lines. Keys are made distinct within a page and counted map-side.
    """
    each = pages.select("host", F.explode(F.array_distinct(F.filter("keys", lambda k: k.isNotNull()))).alias("line"))
    counts = each.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > above)
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    over = counts.join(totals, counts["host"].eqNullSafe(totals["host"])).where(F.col("n") > F.col("pages") * F.lit(share))
    return over.groupBy(counts["host"]).agg(F.collect_list("line").alias("items"))


def _filtered(docs: DataFrame, host: Column, text_col: str, ratio: float, min_pages: int, write: bool) -> DataFrame:
    """``docs`` with ``__lines`` and ``__kept``, the lines of the text before and after."""
    src = docs.select("*", host.alias("__host"), line_keys(F.col(text_col)).alias("__keys"))
    if write:
        src = stored(src, "lines")
    drop = frequent_lines(src.select(F.col("__host").alias("host"), F.col("__keys").alias("keys")), ratio, min_pages - 1)
    joined = with_lists(src, "__host", drop.withColumnRenamed("host", "__host"), "__drop")
    # The page's own part of its host's list, found by hash, so that a long list is not searched line by line.
    own = joined.withColumn("__own", F.array_intersect("__keys", "__drop"))
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.coalesce(F.array_contains("__own", F.get("__keys", i)), F.lit(False)))
    return own.withColumn("__lines", lines).withColumn("__kept", F.when(F.size("__own") > 0, kept).otherwise(lines))


def dedup_lines(docs: DataFrame, host: Column, text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, write: bool = False) -> DataFrame:
    """``docs`` with its text rid of boilerplate lines, and ``n_lines``, ``n_dropped``.

    A line goes if it is on more than ``ratio`` of its host's pages and on at least
    ``min_pages`` of them; every occurrence goes. Lines without a word are never dropped. Rows
    count as pages each for itself; null hosts form one site; a null text stays null and has no
    lines; an empty one has one line. Columns of these two names in ``docs`` are replaced. An
    empty table gives no rows. ``write`` puts ``docs`` with the lines' hashes into the shared
    folder first: for a text that is costly to make, as that of a raw page, which is then made once.
    """
    rest = [F.array_join("__kept", "\n").alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size("__lines"))
    n_kept = F.when(F.col(text_col).isNull(), 0).otherwise(F.size("__kept"))
    return _filtered(docs, host, text_col, ratio, min_pages, write).select(*rest, n_lines.cast("long").alias("n_lines"), (n_lines - n_kept).cast("long").alias("n_dropped"))


def dedup_texts(docs: DataFrame, host: Column, text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """As ``dedup_lines``, with the columns of ``docs`` alone; ``n_chars`` follows the text."""
    text = F.array_join("__kept", "\n")

    def column(name: str) -> Column:
        if name == text_col:
            return text.alias(name)
        if name == "n_chars":
            return F.length(text).cast(docs.schema[name].dataType).alias(name)
        return F.col(name)

    return _filtered(docs, host, text_col, ratio, min_pages, False).select(*[column(c) for c in docs.columns])


def page_text(html: Column) -> Column:
    """The text of a raw page, a line per block: markup out, block ends as line ends."""
    for pattern, new in (
        (r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", ""),
        (r"(?i)<(/?(p|div|li|ul|ol|h[1-6]|nav|article|section|header|footer|table|tr|title|head|body|html)|br|!doctype)[^>]*>", "\n"),
        (r"<[^>]*>", ""),
    ):
        html = F.regexp_replace(html, pattern, new)
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        html = F.replace(html, F.lit(entity), F.lit(char))
    html = F.regexp_replace(html, r"[\x20\x09\x0D]*+\n[\x20\x09\x0D\n]*+", "\n")
    return F.btrim(html, F.lit("\n"))


def page_host(url: Column) -> Column:
    """The host of an absolute URL with its port, in lower case; empty without one, null for a null URL."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
