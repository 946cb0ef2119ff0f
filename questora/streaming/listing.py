"""A stream of a remote folder's changes whose offset is the listing's own token.

Only links to pages go through the driver: it walks from a token to the next one, as each page names the one
after it. The items are read from the pages by tasks. A token that the server no longer knows starts a full listing, whose rows say so.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..sources.archives import opened

ITEMS = "id string, name string, etag string, size long, modified string, web_url string, is_file boolean, removed boolean, reset boolean, page string"


class Expired(Exception):
    """The token is too old to go on from."""


def recorded(path: str, page: str) -> dict:
    """A page kept as a file named by its token, ``root`` for the first; one that is not there yet brings nothing new."""
    store, root = opened(path)
    try:
        with store.open_input_stream(f"{root}/{page or 'root'}.json") as f:
            said = json.loads(f.read())
    except FileNotFoundError:
        return {"value": [], "deltaLink": page}
    if said.get("error") == 410:
        raise Expired(page)
    return said


def fetcher(name: str) -> Callable[[str, str], dict]:
    """The function ``module:function`` that gets the page of a token: a dict of ``value`` and of ``nextLink`` or ``deltaLink``."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class PageReader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.fetch = options["path"], fetcher(options.get("fetch", "questora.streaming.listing:recorded"))

    def initialOffset(self) -> dict:
        return {"token": ""}

    def walk(self, token: str, until: str | None = None) -> tuple[list[tuple[str, bool]], str]:
        pages, reset, restarted = [], False, False
        while True:
            try:
                said = self.fetch(self.path, token)
            except Expired:
                if restarted:
                    raise
                pages, token, reset, restarted = [], "", True, True
                continue
            if said.get("value"):
                pages.append((token, reset))
            if not said.get("nextLink"):
                return pages, said.get("deltaLink") or token
            token = said["nextLink"]
            if until is not None and token == until:
                return pages, token

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        pages, end = self.walk(start["token"])
        return iter(pages), {"token": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self.walk(start["token"], end["token"])[0])


class PageLinks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "listing_pages"

    def schema(self) -> str:
        return "page string, reset boolean"

    def simpleStreamReader(self, schema) -> PageReader:
        return PageReader(self.options)


def listing(spark: SparkSession, path: str, fetch: str = "questora.streaming.listing:recorded") -> DataFrame:
    """Items of a remote folder as they change: new ones, changed ones and those that are gone (``removed``).

    A restart goes on from the token in the checkpoint. Rows of a listing that had to begin anew have ``reset``: it names all that there is, so what it
    does not name is gone. Items without an id are left out.
    """
    spark.dataSource.register(PageLinks)
    links = spark.readStream.format("listing_pages").option("path", path).option("fetch", fetch).load()

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = fetcher(fetch)
        names = [c.split(" ")[0] for c in ITEMS.split(", ")]
        kinds = [pa.int64() if c.endswith("long") else pa.bool_() if c.endswith("boolean") else pa.string() for c in ITEMS.split(", ")]
        for b in batches:
            for link in b.to_pylist():
                rows = []
                for i in get(path, link["page"]).get("value") or []:
                    if i.get("id"):
                        gone = "@removed" in i or bool(i.get("deleted"))
                        rows.append((i["id"], i.get("name"), i.get("eTag"), i.get("size"), i.get("lastModifiedDateTime"), i.get("webUrl"), "file" in i, gone, link["reset"], link["page"]))
                cols = list(zip(*rows)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return links.mapInArrow(items, ITEMS)
