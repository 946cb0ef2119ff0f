import collections
import re

import pytest
from pyspark.sql import functions as F

from questora.llm import common, quality_rules, site_lines

WORD = re.compile("[^\x20\x09-\x0d]+")


def norm(line):
    return re.sub(r"\s+", " ", line.lower()).strip(" ")


def plain_dedup(rows, ratio, least):
    pages, hits = collections.Counter(), collections.Counter()
    for _, host, text in rows:
        pages[host] += 1
        for n in {norm(x) for x in (text or "").split("\n")} - {""}:
            hits[host, n] += 1
    out = []
    for i, host, text in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        lines = text.split("\n")
        keep = [x for x in lines if not norm(x) or not (hits[host, norm(x)] >= least and hits[host, norm(x)] > ratio * pages[host])]
        out.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return out


ROWS = [(i, "a", f"Menu  Home\nbody {i}\n\nmenu home\nshared {i % 7}") for i in range(20)]
ROWS += [(100 + i, None, "foot\nx" if i else "") for i in range(9)] + [(200, "b", None), (201, "b", "foot"), (202, "c", "x" * 40000 + "\nfoot"), (100, None, "foot\nx")]


@pytest.mark.parametrize("most", [10**6, 0])
def test_line_dedup_against_plain_counting(spark, monkeypatch, most):
    monkeypatch.setattr(common.with_lists, "__defaults__", (most,))
    df = spark.createDataFrame([(*r, "d", 1) for r in ROWS], "doc_id long, host string, text string, drop string, n_lines int")
    got = site_lines.dedup_lines(df, F.col("host"), ratio=0.2, min_pages=5)
    assert got.columns == ["doc_id", "host", "text", "drop", "n_lines", "n_dropped"]
    key = lambda r: (r[0], str(r[1]))
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=key) == sorted(plain_dedup(ROWS, 0.2, 5), key=key)


def test_dedup_texts_keeps_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(i, "s", "top\nb%d" % i, 99, "x") for i in range(8)], "doc_id long, source string, text string, n_chars long, items string")
    got = site_lines.dedup_texts(df, F.col("source"))
    assert got.schema == df.schema or got.columns == df.columns
    assert {(r.text, r.n_chars, r["items"]) for r in got.collect()} == {(f"b{i}", 2, "x") for i in range(8)}
    assert site_lines.dedup_lines(df.limit(0), F.col("source")).count() == 0


def test_page_text_and_host(spark):
    html = "<!DOCTYPE html><head><title>A &amp; B</title><style>p{}</style></head><body><!-- x --><p>One <b>two</b>\n<p> three&nbsp;4 <script>var t='</p>'</script></p></body>"
    r = spark.createDataFrame([(html, "HTTPS://Www.X.org/a?b"), (None, None)], "html string, url string").select(site_lines.page_text(F.col("html")).alias("t"), site_lines.page_host(F.col("url")).alias("h")).collect()
    assert tuple(r[0]) == ("A & B\nOne two\nthree 4", "www.x.org") and tuple(r[1]) == (None, None)


def plain_rules(text):
    ws = WORD.findall(text or "")
    seen = collections.Counter(tuple(ws[i: i + 5]) for i in range(len(ws) - 4))
    covered = {i + j for i in range(len(ws) - 4) if seen[tuple(ws[i: i + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_text_stats_against_plain_counts(spark):
    texts = [None, "", " \n\t", "a b c d e", "a b c d e a b c d e", "x x x x x x", "é #*$ <a>\né #*$ <a>\n\n b", "a\x0bb\x1cc d\x85e f", "w " * 5000, "z" * 100_000, "a b c d e f\n" * 3 + "q"]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(4, texts[4], "s"), (None, "lone words here", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = quality_rules.apply_rules(df).collect()
    want = sorted((str(i), *plain_rules(t)) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert quality_rules.apply_rules(df.limit(0)).count() == 0


def test_depleted_documents_go_and_others_stay(spark):
    words = " ".join(f"w{i}" for i in range(30))
    foot = "this very footer line is on every page of the site here"
    rows = [(i, f"{foot}\nown{i}", "h") for i in range(30)] + [(100 + i, f"{foot}\n{words} {i}", "h") for i in range(5)] + [(200 + i, f"{words} n{i}", "k") for i in range(3)]
    got = {r.doc_id: r for r in quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[i].kept for i in range(30)) and not any(got[i].base_failed for i in range(30))
    assert all(got[i].kept and got[i].n_lines_removed == 1 for i in range(100, 105)) and all(got[i].kept and got[i].n_lines_removed == 0 for i in range(200, 203))


def test_lines_are_trimmed_and_keep_their_digits(spark):
    lines = ["  Alpha\tbeta ", "alpha beta", "1 item", "11 item", "3x3", "x3", "", " \x0b "]
    df = spark.createDataFrame([("\n".join(lines),), (None,)], "t string")
    got = [r.n for r in df.select(site_lines.normal_lines(F.col("t")).alias("n")).collect()]
    assert got == [["alpha beta", "alpha beta", "1 item", "11 item", "3x3", "x3", "", ""], None]
    pages = spark.createDataFrame([(i, "h", f"{'  ' * (i % 2)}Same line \nown {i}\n1 of {i}") for i in range(10)], "page_id long, host string, text string")
    kept = site_lines.dedup_lines(pages, F.col("host"), ratio=0.5, min_pages=2).collect()
    assert all(r.n_dropped == 1 for r in kept)
