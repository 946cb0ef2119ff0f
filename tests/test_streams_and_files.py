"""Streams that run, stop and start again; files that are read, broken or exported; model calls that fail."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from questora.functions import providers
from questora.sources import files
from questora.streaming import jobs

T0 = dt.datetime(2024, 1, 1, 12)
SCHEMA = "id long, etag string, ts timestamp, value double"


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def drain(df, path, mode="append", sink=None):
    w = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    q = (w.foreachBatch(sink) if sink else w.format("parquet").option("path", f"{path}/out")).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_newest_rows_survive_restarts_and_rewrite_only_what_they_touch(spark, tmp_path):
    src, out = tmp_path / "in", f"{tmp_path}/table"
    put(spark, src, [(i, "a", T0, float(i)) for i in range(20)])
    sink = jobs.latest_into(out, "id", "ts", parts=8)
    stream = lambda: jobs.parquet_stream(spark, str(src))
    drain(stream(), tmp_path / "q", "update", sink)
    put(spark, src, [(3, "b", T0 + dt.timedelta(minutes=1), 33.0), (4, "old", T0 - dt.timedelta(minutes=1), 44.0), (50, "n", T0, 5.0)])
    drain(stream(), tmp_path / "q", "update", sink)
    got = {r.id: (r.etag, r.value) for r in jobs.newest_of(spark, out).collect()}
    assert len(got) == 21 and got[3] == ("b", 33.0) and got[4] == ("a", 4.0) and got[50] == ("n", 5.0)
    versions = spark.read.option("basePath", out).parquet(f"{out}/v=*").groupBy("v").agg(F.count_distinct("part").alias("n")).collect()
    assert min(r.n for r in versions) <= 3
    # The last batch once more, as after a lost acknowledgement.
    jobs.latest_into(out, "id", "ts", parts=8)(spark.createDataFrame([(3, "b", T0 + dt.timedelta(minutes=1), 33.0)], SCHEMA), max(r.v for r in versions))
    assert {r.id: r.value for r in jobs.newest_of(spark, out).collect()}[3] == 33.0
    # Of the parts that later batches touch, the last two versions stay.
    before = jobs.newest_of(spark, out).count()
    for n in range(10, 14):
        jobs.latest_into(out, "id", "ts", parts=8)(spark.createDataFrame([(3, f"c{n}", T0 + dt.timedelta(minutes=n), float(n))], SCHEMA), n)
    kept = spark.read.option("basePath", out).parquet(f"{out}/v=*").groupBy("part").agg(F.collect_set("v").alias("v")).collect()
    assert max(len(r.v) for r in kept) == 2 and any(sorted(r.v) == [12, 13] for r in kept)
    got = {r.id: r.value for r in jobs.newest_of(spark, out).collect()}
    assert len(got) == before and got[3] == 13.0 and got[4] == 4.0


def test_versions_once_and_windows_without_late_rows(spark, tmp_path):
    src = tmp_path / "in"
    put(spark, src, [(1, "a", T0, 1.0), (1, "a", T0, 1.0), (1, "b", T0, 1.0)])
    seen = jobs.new_versions(jobs.parquet_stream(spark, str(src)), "ts")
    drain(seen, tmp_path / "v")
    put(spark, src, [(1, "b", T0, 1.0), (2, "a", T0, 1.0)])
    drain(jobs.new_versions(jobs.parquet_stream(spark, str(src)), "ts"), tmp_path / "v")
    assert sorted((r.id, r.etag) for r in spark.read.parquet(f"{tmp_path}/v/out").collect()) == [(1, "a"), (1, "b"), (2, "a")]
    late = tmp_path / "late"
    windows = lambda: jobs.windowed(jobs.parquet_stream(spark, str(late)), "ts", ["etag"], "10 minutes", value="value").select("window.start", "etag", "n", "total")
    put(spark, late, [(1, "a", T0, 1.0), (2, "a", T0 + dt.timedelta(minutes=3), 2.0), (3, "a", T0 + dt.timedelta(hours=2), 4.0)])
    drain(windows(), tmp_path / "w")
    put(spark, late, [(4, "a", T0 + dt.timedelta(minutes=4), 100.0), (5, "a", T0 + dt.timedelta(hours=5), 8.0)])
    drain(windows(), tmp_path / "w")
    got = sorted((r.start, r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/w/out").collect())
    assert got[0][1:] == (2, 3.0) and all(r[2] < 100 for r in got)


def test_quiet_workers_are_told_once(spark, tmp_path):
    pytest.importorskip("pandas")
    src = tmp_path / "in"
    put(spark, src, [(1, "w1", T0, 0.0), (1, "w1", T0 + dt.timedelta(minutes=1), 0.0), (2, "w2", T0 + dt.timedelta(minutes=2), 0.0)])
    told = lambda: jobs.quiet_workers(jobs.parquet_stream(spark, str(src)), "etag", "ts")
    drain(told(), tmp_path / "q")
    put(spark, src, [(3, "w3", T0 + dt.timedelta(hours=1), 0.0)])
    drain(told(), tmp_path / "q")
    put(spark, src, [(3, "w3", T0 + dt.timedelta(hours=1, minutes=1), 0.0)])
    drain(told(), tmp_path / "q")
    assert sorted((r.etag, r.beats) for r in spark.read.parquet(f"{tmp_path}/q/out").collect()) == [("w1", 2), ("w2", 1)]


def test_jobs_wait_retry_and_give_up(spark):
    rows = [(1, "PENDING", 0, 3, T0, T0), (2, "PENDING", 2, 3, T0, T0), (3, "RUNNING", 1, 3, T0 - dt.timedelta(hours=1), T0), (4, "RUNNING", 3, 3, T0 - dt.timedelta(hours=1), T0)]
    df = spark.createDataFrame(rows, "id int, status string, retry_count int, max_retries int, updated_at timestamp, created_at timestamp")
    now = F.lit(T0 + dt.timedelta(seconds=10))
    assert [r.id for r in jobs.claimable(df, now).collect()] == [1]
    assert {r.id: r.next_status for r in jobs.stale(df, now).collect()} == {3: "PENDING", 4: "FAILED"}


def test_steps_of_a_job(spark):
    rows = [(1, "DOWNLOAD", "RUNNING", 2, 3, "c"), (2, "FINISH", "RUNNING", 0, 3, None), (3, "TAG", "RUNNING", 1, 3, None), (4, "TAG", "RUNNING", 3, 3, None), (5, "EXTRACT", "RUNNING", 0, 3, "a"), (6, "TAG", "COMPLETED", 0, 3, None), (7, "TAG", "PENDING", 0, 3, None)]
    df = spark.createDataFrame(rows, "id int, step string, status string, retry_count int, max_retries int, cursor string")
    out = spark.createDataFrame([(1, "ok", None), (2, "ok", None), (3, "error", None), (4, "error", None), (5, "yield", "b"), (6, "error", None)], "id int, outcome string, cursor string")
    got = {r.id: (r.step, r.status, r.retry_count, r.cursor) for r in jobs.advanced(df, out).collect()}
    assert got == {1: ("PARSE", "PENDING", 0, None), 2: ("FINISH", "COMPLETED", 0, None), 3: ("TAG", "PENDING", 2, None), 4: ("TAG", "FAILED", 3, None), 5: ("EXTRACT", "PENDING", 0, "b"), 6: ("TAG", "COMPLETED", 0, None), 7: ("TAG", "PENDING", 0, None)}


def test_reports_and_providers(spark, tmp_path):
    from questora.operators import evaluate

    rows = spark.createDataFrame([(1, "a", ["x"]), (2, "b", None)], "id int, gold string, alt array<string>")
    evaluate.write_report(rows, spark.createDataFrame([("all", 2, 50.0)], "slice string, n int, pct double"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/raw")).count() == 2 and spark.read.csv(str(tmp_path / "r/per_question"), header=True).columns == ["id", "gold", "alt"]
    assert [r.value for r in spark.read.text(str(tmp_path / "r/report")).collect()] == ["| slice | n | pct |", "|---|---|---|", "| all | 2 | 50.0 |"]
    assert providers.provider({}, {}) is providers.local_tag and providers.provider({"provider": "X", "size": 2}, {"x": lambda c: (lambda texts: [c["size"]] * len(texts))})(["a"]) == [2]
    with pytest.raises(ValueError):
        providers.provider({"provider": "nobody"}, {})


P, A = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"', 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def shape(text, name="Box", place="", form=""):
    body = "".join(f"<a:p><a:r><a:t>{x}</a:t></a:r></a:p>" for x in text.split("\n"))
    return f'<p:sp><p:nvSpPr><p:cNvPr id="1" name="{name}"/><p:nvPr>{place and f"""<p:ph type="{place}"/>"""}</p:nvPr></p:nvSpPr><p:spPr>{form and f"""<a:prstGeom prst="{form}"/>"""}</p:spPr><p:txBody>{body}</p:txBody></p:sp>'


def grid(*rows):
    cells = "".join("<a:tr>" + "".join(f"<a:tc><a:txBody><a:p><a:r><a:t>{c}</a:t></a:r></a:p></a:txBody></a:tc>" for c in r) + "</a:tr>" for r in rows)
    return f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="2" name="Table"/></p:nvGraphicFramePr><a:graphic><a:graphicData><a:tbl>{cells}</a:tbl></a:graphicData></a:graphic></p:graphicFrame>'


def png(w=100, h=90, size=3000, fill=b"x"):
    return b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + w.to_bytes(4, "big") + h.to_bytes(4, "big") + fill * size


def deck(slides, media=(), order=None, template=()):
    """Slides are (shapes, targets, notes)."""
    out = io.BytesIO()
    rel = lambda i, t, more="": f'<Relationship Id="rId{i}" Target="{t}"{more}/>'
    with zipfile.ZipFile(out, "w") as z:
        for n, (shapes, targets, notes) in enumerate(slides, 1):
            z.writestr(f"ppt/slides/slide{n}.xml", f"<p:sld {P} {A}><p:cSld><p:spTree>{''.join(shapes)}</p:spTree></p:cSld></p:sld>")
            links = [rel(i, f"../media/{t}") for i, t in enumerate(targets)] + ([rel(99, f"../notesSlides/notesSlide{n}.xml")] if notes else []) + [rel(98, "http://x.org/v.mp4", ' TargetMode="External"')]
            z.writestr(f"ppt/slides/_rels/slide{n}.xml.rels", f"<Relationships>{''.join(links)}</Relationships>")
            if notes:
                z.writestr(f"ppt/notesSlides/notesSlide{n}.xml", f"<p:notes {P} {A}><p:cSld><p:spTree>{shape('7', 'Slide number', 'sldNum')}{shape(notes, 'Notes', 'body')}</p:spTree></p:cSld></p:notes>")
        if order:
            ids = "".join(f'<p:sldId id="{i}" r:id="rId{i}"/>' for i in order)
            z.writestr("ppt/presentation.xml", f"<p:presentation {P} {A}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>")
            z.writestr("ppt/_rels/presentation.xml.rels", f"<Relationships>{''.join(rel(i, f'slides/slide{i}.xml') for i in order)}</Relationships>")
        if template:
            z.writestr("ppt/slideLayouts/slideLayout1.xml", f"<p:sldLayout {P}/>")
            z.writestr("ppt/slideLayouts/_rels/slideLayout1.xml.rels", f"<Relationships>{''.join(rel(i, f'../media/{t}') for i, t in enumerate(template))}</Relationships>")
        for name, content in media:
            z.writestr(f"ppt/media/{name}", content)
    return out.getvalue()


ONE = deck([([shape("Title"), shape("Which?")], [], "note 1"), ([], [], None)])


def test_decks_pages_and_broken_files(spark, tmp_path):
    (tmp_path / "a.pptx").write_bytes(ONE)
    (tmp_path / "b.pptx").write_bytes(b"no package")
    got = files.decks(files.files(spark, str(tmp_path), "*.pptx")).orderBy("path", "slide_number").collect()
    assert [(r.slide_number, r.title, r.extracted_text, r.speaker_notes, r.image_paths) for r in got[:2]] == [(1, "Title", "Title\n\nWhich?", "note 1", []), (2, "Slide 2", "", "", [])]
    assert got[2].error.startswith("BadZipFile") and got[2].slide_number is None
    (tmp_path / "c.pdf").write_bytes(b"one|two")
    pages = files.pages(files.files(spark, str(tmp_path), "*.pdf"), lambda c: [*c.decode().split("|"), ""]).orderBy("slide_number").collect()
    assert [(r.slide_number, r.title) for r in pages] == [(1, "one"), (2, "two"), (3, "Page 3")]
    broken, blank, last = lambda c: c["x"], lambda c: ["", " "], lambda c: ["text"]
    read = lambda *readers: [(r.slide_number, r.extracted_text, r.error and r.error.split(":")[0]) for r in files.pages(files.files(spark, str(tmp_path), "*.pdf"), *readers).orderBy("slide_number").collect()]
    assert read(broken, blank, last) == [(1, "text", None)] and read(broken, blank) == [(1, "", None), (2, " ", None)] and read(broken) == [(None, None, "TypeError")] and read() == [(None, None, "ValueError")]


def test_tables_groups_stars_timers_and_media(spark, tmp_path):
    group = f'<p:grpSp><p:nvGrpSpPr><p:cNvPr id="5" name="G"/></p:nvGrpSpPr>{shape("inner")}{shape("burst", form="star5")}</p:grpSp>'
    slides = [
        ([shape("Second"), grid(["a", "b"], ["c", ""]), shape("Second")], ["p1.png", "p2.png", "copy.png", "small.png", "g.gif", "s.mp3", "v.mp4"], "said\nhere"),
        ([shape("The title", place="title"), group, shape("text​ here", name="1min Timer")], ["v2.mp4", "v.mp4", "none.png"], None),
    ]
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x50\x00\x60" + b"x" * 4000
    media = [("p1.png", png()), ("p2.png", png(50)), ("copy.png", png()), ("small.png", png(size=10)), ("g.gif", b"GIF89a" + b"x" * 3000), ("s.mp3", b"s"), ("v.mp4", b"v"), ("v2.mp4", b"v"), ("loose.jpg", jpeg), ("art.png", png(300)), ("empty.png", b"")]
    (tmp_path / "d.pptx").write_bytes(deck(slides, media, order=[2, 1], template=["art.png"]))
    one, two = files.decks(files.files(spark, str(tmp_path))).orderBy("slide_number").collect()
    assert (one.title, one.extracted_text, one.has_timer, one.timer_seconds, one.has_star_shape, one.shape_count, one.video_paths) == ("The title", "The title\n\ninner\n\nburst\n\ntext here", True, 60, True, 3, [])
    assert (two.title, two.extracted_text, two.speaker_notes, two.has_timer, two.has_star_shape) == ("Second", "Second\n\na | b\nc |", "said\nhere", False, False)
    assert (two.image_paths, two.audio_paths, two.video_paths) == (["p1.png"], ["s.mp3"], ["v.mp4"])
    assert one.image_paths == ["loose.jpg"] and [(m.name, m.width, m.height, m.unmapped) for m in one.media] == [("loose.jpg", 96, 80, True)]


def test_archives_are_read_by_member(spark, tmp_path):
    from questora.sources import archives

    (tmp_path / "sub").mkdir()
    (tmp_path / "plain.pptx").write_bytes(ONE)
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "sub" / "many.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for n in range(6):
            z.writestr(f"in/{n}.PPTX", ONE)
        z.writestr("in/readme.txt", "no deck")
        z.writestr("in/large.pdf", b"x" * 100_000)
        z.writestr("in/._0.pptx", b"resource fork")
    with zipfile.ZipFile(tmp_path / "sub" / "none.zip", "w"):
        pass
    df = archives.archives(spark, str(tmp_path), together=2 * len(ONE), largest=50_000)
    got = {(r.path.rsplit("/", 1)[-1], r.member): (r.content and bytes(r.content), r.error) for r in df.collect()}
    assert got == {("plain.pptx", None): (ONE, None), ("bad.zip", None): (None, got["bad.zip", None][1]), ("many.zip", "in/large.pdf"): (None, "TooLarge: 100000 bytes"), **{("many.zip", f"in/{n}.PPTX"): (ONE, None) for n in range(6)}}
    assert got["bad.zip", None][1].startswith("BadZipFile") and df.rdd.getNumPartitions() == 6
    rows = files.decks(df).collect()
    assert sum(r.error is None for r in rows) == 14 and sum(r.error is not None for r in rows) == 2 and any(r.path.endswith("many.zip!/in/3.PPTX") for r in rows)
    assert archives.archives(spark, str(tmp_path / "plain.pptx")).count() == 1 and archives.archives(spark, str(tmp_path / "sub" / "none.zip")).count() == 0 and archives.archives(spark, str(tmp_path / "nowhere")).count() == 0


def test_a_listing_goes_on_from_its_token_and_begins_anew(spark, tmp_path):
    import json

    from questora.streaming import listing

    pages = tmp_path / "pages"
    pages.mkdir()
    put_page = lambda name, value, **link: (pages / f"{name}.json").write_text(json.dumps({"value": value, **link}))
    item = lambda i, tag, **more: {"id": i, "name": f"{i}.pptx", "eTag": tag, "size": 5, "file": {}, **more}
    put_page("root", [item("a", "1"), item("b", "1"), {"name": "no id"}], nextLink="p2")
    put_page("p2", [item("c", "1")], deltaLink="d1")

    def drained():
        drain(listing.listing(spark, str(pages)), tmp_path / "q")
        return sorted(((r.id, r.etag, r.removed, r.reset, r.page) for r in spark.read.schema(listing.ITEMS).parquet(f"{tmp_path}/q/out").collect()), key=str)

    first = [("a", "1", False, False, ""), ("b", "1", False, False, ""), ("c", "1", False, False, "p2")]
    assert drained() == sorted(first, key=str) and drained() == sorted(first, key=str)
    put_page("d1", [item("b", "2"), {"id": "a", "deleted": {"state": "deleted"}}], deltaLink="d2")
    second = sorted([*first, ("a", None, True, False, "d1"), ("b", "2", False, False, "d1")], key=str)
    assert drained() == second and drained() == second
    # The token has expired: the whole listing comes again and says so.
    (pages / "d2.json").write_text('{"error": 410}')
    put_page("root", [item("b", "2")], deltaLink="d3")
    assert drained() == sorted([*second, ("b", "2", False, True, "")], key=str)
    put_page("d3", [item("e", "1")], deltaLink="d4")
    assert len(drained()) == len(second) + 2


def test_chunks_in_flight_keep_their_order_and_ask_for_what_is_missing(spark):
    import threading
    import time

    seen, lock, flying, most = [], threading.Lock(), [0], [0]

    def model(system, items):
        with lock:
            flying[0] += 1
            most[0] = max(most[0], flying[0])
            seen.append([i["n"] for i in items])
        time.sleep(0.05 + 0.02 * (items[0]["n"] % 3))
        with lock:
            flying[0] -= 1
        if any(i["text"] == "slow" for i in items):
            time.sleep(2)
        return [{"n": i["n"], "got": i["text"]} for i in items if i["text"] != "never"][: 3] + [{"n": 999}, "x"]

    rows = [{"n": n, "text": t} for n, t in enumerate(["a", "b", "c", "d", "never"])]
    assert providers.ask_chunk(model, "", rows, 3, 5, lambda e, k: 0) == ({n: {"got": t} for n, t in enumerate("abcd")}, "no answer") and seen == [[0, 1, 2, 3, 4], [3, 4], [4]]
    got, why = providers.ask_chunk(model, "", [{"n": 0, "text": "slow"}], 2, 0.3, lambda e, k: 0)
    assert got == {} and why.startswith("TimeoutError")
    df = spark.createDataFrame([(i, None if i == 5 else " " if i == 6 else f"t{i}") for i in range(60)], "id long, text string").coalesce(1)
    out = providers.asked(df, "id", F.col("text"), lambda s, items: [{"n": i["n"], "t": i["text"]} for i in items if i["text"] != "t7"], size=4, tries=2).collect()
    assert [r.id for r in out] == list(range(60)) and all(r.answer == '{"t": "t%d"}' % r.id for r in out if r.id not in (5, 6, 7))
    assert [(r.status, r.note) for r in out[5:8]] == [("draft", "nothing to ask")] * 2 + [("draft", "no answer")]

    def broken(system, items):
        raise OSError("busy")

    assert {r.note for r in providers.asked(df, "id", F.col("text"), broken, tries=2, wait=lambda e, k: 0).where("id > 6").collect()} == {"OSError: busy"}
    began, slow = time.time(), lambda s, items: time.sleep(0.2) or [{"n": i["n"]} for i in items]
    providers.asked(df, "id", F.col("text"), slow, size=2).collect()
    assert time.time() - began < 4  # thirty calls of a fifth of a second, eight at a time
    refused = type("Refused", (Exception,), {"retry_after": 7})()
    assert providers.waits(refused, 0) == 7 and providers.waits(OSError(), 1) == 3
    live = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "z"), ("A", "x"), (None, "q")], "l1 string, l2 string")
    assert providers.vocabulary_prompt(live, "Pick:") == "Pick:\nA: x, y\nB: z"
    with pytest.raises(ValueError):
        providers.vocabulary_prompt(live, "Pick:", most=2)


def test_urls_in_nested_values_and_merged_objects(spark):
    import json

    from questora.functions import formats, text

    old, new = "https://old.example.com/", "https://new.example.com/x$1"
    docs = [
        {"a": f"{old}1.png", f"{old}key": [f"see {old}2 and {old}3", {"b": f"{old}", "n": 1.5, "t": True, "z": None}], "other": "https://old-example.com/"}, [f"{old[:-1]}"], {}, f"{old}\"q\" \\ é", 5,
    ]

    def walk(v):
        if isinstance(v, str):
            return v.replace(old[:-1], new), v.count(old[:-1])
        if isinstance(v, (list, dict)):
            parts = {k: walk(x) for k, x in (v.items() if isinstance(v, dict) else enumerate(v))}
            out = {k: x for k, (x, _) in parts.items()}
            return (out if isinstance(v, dict) else list(out.values())), sum(n for _, n in parts.values())
        return v, 0

    rows = [(i, json.dumps(d, ensure_ascii=i % 2 == 0, indent=i % 3 or None)) for i, d in enumerate(docs)] + [(50, json.dumps(docs[0]).replace("/", "\\/")), (51, None)]
    changed, n = text.rewrite_urls(F.col("j"), old, new)
    got = {r.i: r for r in spark.createDataFrame(rows, "i int, j string").select("i", changed.alias("c"), n.alias("n")).collect()}
    for i, d in [*enumerate(docs), (50, docs[0])]:
        assert (json.loads(got[i].c), got[i].n) == walk(d)
    assert got[51].c is None
    pairs = [('{"a": {"b": [1, 2]}, "k": 1, "s": "x"}', '{"k": {"deep": null}, "s": null, "new": 2.5}'), (None, '{"x": [true]}'), ("no json", None), ("[1]", '{"a": "b"}')]
    merged = spark.createDataFrame(pairs, "o string, n string").select(formats.merged_json(F.col("o"), F.col("n")).alias("m")).collect()
    assert [json.loads(r.m) for r in merged] == [{"a": {"b": [1, 2]}, "k": {"deep": None}, "s": "x", "new": 2.5}, {"x": [True]}, {}, {"a": "b"}]


def test_exports_and_listings(spark):
    rows = spark.sql("SELECT 'z' AS quiz, 1 AS position, 'q' AS question_text, array('a', 'b') AS options, 'a' AS answer, 'e' AS explanation, 't' AS topic, 'Easy' AS difficulty, array(named_struct('title', 'D', 'slide_number', 3)) AS sources, true AS approved, 3 AS grade_min, 5 AS grade_max")
    one = files.quiz_csv(rows).first()
    assert (one.options, one.source) == ("a | b", "D (Slide 3)") and '"grade_range":"3-5"' in files.quiz_json(rows, "quiz").first().questions
    listing = spark.createDataFrame([("1", "a.pptx", True, "e1", False), ("2", "b.txt", True, "e", False), ("3", "c.pdf", True, "new", False), ("4", "d.pdf", True, "e", True), ("5", "e.pdf", True, "e", False)], "id string, name string, is_file boolean, etag string, removed boolean")
    known = spark.createDataFrame([("3", "old", "DONE"), ("4", "e", "DONE"), ("5", "e", "FAILED")], "id string, etag string, sync_status string")
    assert {r.id: r.action for r in files.changed_files(listing, known).collect()} == {"1": "DISCOVERED", "3": "CHANGED", "4": "DELETED", "5": "RETRY"}


def test_model_calls_are_asked_again_and_once_per_value(spark):
    tries = []

    def shaky(texts):
        tries.append(list(texts))
        if len(tries) == 1:
            raise OSError("busy")
        return [t.upper() if t != "bad" else None for t in texts]

    assert providers.batched(shaky, size=2)(["a", None, "b", "bad"]) == ["A", None, "B", None] and len(tries) == 4
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "y")], "id int, k string")
    got = providers.once_per(df, "k", lambda texts: [{"n": len(t)} if t != "y" else "no json" for t in texts], "a")
    assert {r.id: r.a for r in got.collect()} == {1: '{"n": 1}', 2: '{"n": 1}', 3: None, 4: None}
    picked = providers.curated(spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id int, rank int"), [3, 9], "id", 2)
    assert [r.id for r in picked.collect()] == [3, 1]
