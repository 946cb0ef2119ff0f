"""A batch source of decks: files of a folder and members of its ZIP archives, read by ranges, so that many tasks share one archive."""

from __future__ import annotations

import os
import posixpath
import zipfile
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Files that hold decks.
DECKS = (".pptx", ".ppt", ".pdf")
#: Bytes of decks that one task reads, and of one deck beyond which its row is an error instead.
TOGETHER, LARGEST = 64 << 20, 512 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


class Ranged:
    """A file that is read by ranges, whose seeks outside of it are the errors that readers of archives expect."""

    def __init__(self, file) -> None:
        self.file, self.read, self.tell = file, file.read, file.tell

    def seekable(self) -> bool:
        return True

    def seek(self, at: int, whence: int = 0) -> int:
        try:
            return self.file.seek(at, whence)
        except ValueError as e:
            raise OSError(str(e)) from e


class Members(InputPartition):
    """Some decks of one archive, or one deck that is a file: (member or None, size)."""

    def __init__(self, path: str, members: list[tuple[str | None, int]], error: str | None = None) -> None:
        self.path, self.members, self.error = path, members, error


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.together, self.largest = options["path"], int(options.get("together", TOGETHER)), int(options.get("largest", LARGEST))

    def partitions(self) -> list[Members]:
        """The driver reads names and the archives' directories, which stand at their ends, and nothing else."""
        store, root = opened(self.root)
        at = store.get_file_info(root)
        found = [at] if at.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        out = []
        for f in sorted((f for f in found if f.type == fs.FileType.File), key=lambda f: f.path):
            name = f.path.lower()
            if name.endswith(DECKS):
                out.append(Members(f.path, [(None, f.size)]))
            elif name.endswith(".zip"):
                out += self._archive(store, f.path)
        return out or [Members(root, [])]

    def _archive(self, store: fs.FileSystem, path: str) -> list[Members]:
        try:
            with store.open_input_file(path) as f, zipfile.ZipFile(Ranged(f)) as z:
                own = [(i.filename, i.file_size) for i in z.infolist() if not i.is_dir() and i.filename.lower().endswith(DECKS) and not posixpath.basename(i.filename).startswith(".")]
        except (zipfile.BadZipFile, OSError) as e:
            return [Members(path, [], f"{type(e).__name__}: {e}"[:300])]
        parts, held = [], 0
        for member in own:
            if not parts or held + member[1] > self.together:
                parts.append([])
                held = 0
            parts[-1].append(member)
            held += member[1]
        return [Members(path, p) for p in parts]

    def read(self, partition: Members) -> Iterator[tuple]:
        if partition.error:
            yield partition.path, None, None, partition.error
        if not partition.members:
            return
        store, _ = opened(self.root)
        with store.open_input_file(partition.path) as f:
            z = zipfile.ZipFile(Ranged(f)) if partition.members[0][0] is not None else None
            for member, size in partition.members:
                if size > self.largest:
                    yield partition.path, member, None, f"TooLarge: {size} bytes"
                    continue
                try:
                    yield partition.path, member, z.read(member) if z else f.read(), None
                except Exception as e:  # a broken member becomes a row that says so; the others are read
                    yield partition.path, member, None, f"{type(e).__name__}: {e}"[:300]


class DeckArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "deck_archives"

    def schema(self) -> str:
        return "path string, member string, content binary, error string"

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def archives(spark: SparkSession, path: str, **options) -> DataFrame:
    """(path, member, content, error) of the decks below a folder, of one file, or of one archive; ``member`` is null for a file."""
    spark.dataSource.register(DeckArchives)
    reader = spark.read.format("deck_archives")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)
