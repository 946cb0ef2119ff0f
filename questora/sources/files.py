"""File sources and sinks: decks, pages of documents, vocabularies, exports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bank import valid_image
from . import packages

SLIDES = (
    "path string, sha256 string, slide_number long, title string, extracted_text string, speaker_notes string, has_timer boolean, timer_seconds int, has_star_shape boolean, "
    f"shape_count int, media {packages.MEDIA_TYPE}, error string"
)


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, content, length, modificationTime) of a folder and those below it."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)


def _rows(parse: Callable[[bytes], list[dict]]) -> Callable:
    names = ["path", "sha256", "slide_number", "title", "extracted_text", "speaker_notes", "has_timer", "timer_seconds", "has_star_shape", "shape_count", "media", "error"]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, sha, content, error in zip(pdf["path"], pdf["sha256"], pdf["content"], pdf["error"]):
                try:
                    found = parse(content) if error is None else [{"slide_number": None, "error": error}]
                except Exception as e:  # a broken file becomes a row that says so
                    found = [{"slide_number": None, "error": f"{type(e).__name__}: {e}"[:300]}]
                made = [{**dict.fromkeys(names), "path": path, "sha256": sha, **r} for r in found]
                yield pd.DataFrame({n: pd.Series([r[n] for r in made], dtype=object) for n in names})

    return run


def _contents(files_df: DataFrame) -> DataFrame:
    """(path, sha256, content, error) of files or of members of archives, which are named behind their archive."""
    has = files_df.columns
    path = F.concat_ws("!/", "path", "member") if "member" in has else F.col("path")
    return files_df.select(path.alias("path"), F.sha2("content", 256).alias("sha256"), "content", (F.col("error") if "error" in has else F.lit(None).cast("string")).alias("error"))


def decks(files_df: DataFrame) -> DataFrame:
    """Slide rows of .pptx files, or of members of archives; what is no package gives one row with ``error``.

    ``media`` has all that belongs to a slide; ``image_paths``, ``audio_paths`` and ``video_paths`` name what is worth keeping, pictures of one content once a slide.
    """
    rows = _contents(files_df).mapInPandas(_rows(packages.slides), SLIDES)
    name = lambda kind: F.transform(F.filter("media", lambda m: m["kind"] == kind), lambda m: m["name"])
    fine = F.filter("media", lambda m: (m["kind"] == "image") & valid_image(m["name"], m["bytes"], m["width"], m["height"]))
    key = lambda m: F.struct(m["bytes"], m["crc"])
    once = F.filter(fine, lambda m, i: F.array_position(F.transform(fine, key), key(m)) == i + 1)
    return rows.withColumns({"image_paths": F.transform(once, lambda m: m["name"]), "audio_paths": name("audio"), "video_paths": name("video")})


def pages(files_df: DataFrame, *readers: Callable[[bytes], list[str]]) -> DataFrame:
    """A slide row per page of .pdf files; the title is the first line with text, or the page's number.

    The parsers are the caller's, tried in order: the first that finds text counts, else the first that does not fail; where all fail the row has the last one's error.
    """
    def read(content: bytes) -> list[str]:
        found, error = None, None
        for reader in readers:
            try:
                own = reader(content)
            except Exception as e:  # the next parser may manage
                error = e
                continue
            if any((t or "").strip() for t in own):
                return own
            found = own if found is None else found
        if found is None:
            raise error or ValueError("no parser")
        return found

    def parse(content: bytes) -> list[dict]:
        out = []
        for n, text in enumerate(read(content), 1):
            line = next((x.strip() for x in (text or "").split("\n") if x.strip()), f"Page {n}")
            out.append({"slide_number": n, "title": line, "extracted_text": text, "error": None})
        return out

    return _contents(files_df).mapInPandas(_rows(parse), SLIDES)


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(l1, l1_code, l2, l2_code) of a vocabulary file of nested levels."""
    raw = spark.read.option("multiLine", "true").json(path)
    one = raw.select(F.explode("level1").alias("a"))
    return one.select(F.col("a.name").alias("l1"), F.col("a.code").alias("l1_code"), F.explode("a.level2").alias("b")).select("l1", "l1_code", F.col("b.name").alias("l2"), F.col("b.code").alias("l2_code"))


def live_taxonomy(questions: DataFrame, l1: str, l2: str) -> DataFrame:
    """The subtopics in use per topic, trimmed and sorted."""
    a, b = F.trim(l1), F.trim(l2)
    return questions.where((a != "") & (b != "")).groupBy(a.alias("l1")).agg(F.array_join(F.sort_array(F.collect_set(b)), "|").alias("l2s"))


def gold_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of labels, all text, its byte order mark dropped."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def identical(documents: DataFrame, key: str, sha: str, status: str, at: str) -> DataFrame:
    """(key, twin): for each document the oldest other completed one of equal content."""
    other = documents.where(F.col(status) == "COMPLETED").select(F.col(key).alias("twin"), F.col(sha), F.col(at).alias("__at"))
    pairs = documents.select(key, sha).join(other, sha).where(F.col(key) != F.col("twin"))
    return pairs.groupBy(key).agg(F.min_by("twin", F.struct("__at", "twin")).alias("twin"))


def quiz_csv(rows: DataFrame) -> DataFrame:
    """Export columns of a quiz: options joined by a bar or N/A, the first source as 'Title (Slide n)'."""
    first = F.get("sources", 0)
    source = F.when(first.isNotNull(), F.format_string("%s (Slide %d)", first["title"], first["slide_number"])).otherwise("N/A")
    options = F.when(F.size("options") > 0, F.array_join("options", " | ")).otherwise("N/A")
    return rows.select("position", "question_text", options.alias("options"), "answer", "explanation", "topic", "difficulty", source.alias("source"))


def quiz_json(rows: DataFrame, quiz: str) -> DataFrame:
    """One JSON document per quiz of its approved questions in order; grades as 'a-b' or General."""
    grade = F.when(F.col("grade_min").isNotNull() & F.col("grade_max").isNotNull(), F.concat_ws("-", "grade_min", "grade_max")).otherwise("General")
    q = F.struct("position", "question_text", "answer", "options", grade.alias("grade_range"), "sources")
    return rows.where("approved").groupBy(quiz).agg(F.to_json(F.sort_array(F.collect_list(q))).alias("questions"))


def changed_files(listing: DataFrame, known: DataFrame) -> DataFrame:
    """(id, action): decks of a remote listing that are new, changed, to retry or gone.

    Only .pptx and .pdf files count; a file is taken again if its etag differs from the known
    one or if it failed before.
    """
    decks_only = listing.where(F.coalesce("removed", F.lit(False)) | (F.col("is_file") & F.lower("name").rlike(r"\.(pptx|pdf)$")))
    k = known.select("id", F.col("etag").alias("__e"), F.col("sync_status").alias("__s"))
    both = decks_only.join(k, "id", "left")
    action = (
        F.when(F.coalesce("removed", F.lit(False)), F.when(F.col("__s").isNotNull(), "DELETED")).when(F.col("__s").isNull(), "DISCOVERED")
        .when(F.col("__s") == "FAILED", "RETRY").when(~F.col("etag").eqNullSafe(F.col("__e")), "CHANGED")
    )
    return both.select("id", action.alias("action")).where("action IS NOT NULL")
