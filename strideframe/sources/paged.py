"""A source of records behind cursors, for batches and for streams.

The records of a service lie in pages. A page's cursor is ``stage:offset``; stages follow one another, and each page's head
names the cursor after it. The driver reads heads alone and follows them to the end or to the first page whose head is
broken; a task follows a run of pages and reads them, and a record that can't be read becomes a row with an error while the
others stay. A run is one page where there are few, and RUN_PAGES at most.

A page is a folder ``stage=<stage>/offset=<offset>`` of text files under ``path``. Its head is the line
``{"next": <cursor or null>, "size": <records>}``, any other line ``{"ref", "hint", "payload"}``.

Use: ``spark.dataSource.register(PagedSource)``, then ``spark.read.format("pages")`` or ``spark.readStream``, with the
options ``path`` and ``stages`` (comma-separated, in their order).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

if TYPE_CHECKING:
    from pyarrow import RecordBatch
    from pyarrow.fs import FileSystem

SCHEMA = "stage string, offset long, ref string, hint string, payload string, error string"


#: Runs of pages are joined in pairs while there are more than RUNS of them, up to RUN_PAGES pages each.
RUNS, RUN_PAGES = 128, 1024


@dataclass(frozen=True)
class Run(InputPartition):
    """A number of pages, one after the other, from a cursor on."""

    first: str
    pages: int


@lru_cache(maxsize=8)
def _store(path: str) -> tuple[FileSystem, str]:
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store, root.rstrip("/")


class Pages:
    """The pages under a path, by name; the path may be of any store that Arrow reads."""

    def __init__(self, path: str, stages: list[str]):
        self.path, self.stages = path, stages

    def lines(self, cursor: str) -> Iterator[str] | None:
        """The lines of a page, None if there is no such page."""
        from pyarrow import fs

        stage, offset = cursor.rsplit(":", 1)
        store, root = _store(self.path)
        files = store.get_file_info(fs.FileSelector(f"{root}/stage={stage}/offset={offset}", allow_not_found=True))
        parts = sorted(f.path for f in files if f.base_name.startswith("part-"))
        return (line for part in parts for line in store.open_input_stream(part).read().decode("utf-8", "replace").splitlines()) if parts else None

    @staticmethod
    def behind(cursor: str, record: object) -> str | None:
        """The cursor behind a page if the record is its head."""
        if not (isinstance(record, dict) and "next" in record and isinstance(record.get("size"), int)):
            return None
        stage, offset = cursor.rsplit(":", 1)
        # What is added behind the last page is found there by a later look.
        return record["next"] or f"{stage}:{int(offset) + record['size']}"

    def after(self, cursor: str) -> str | None:
        """The cursor behind a page; None if the page is broken or not there yet."""
        for line in self.lines(cursor) or ():
            try:
                following = self.behind(cursor, json.loads(line))
            except ValueError:
                continue
            if following is not None:
                return following
        return None

    def first(self) -> str:
        return f"{self.stages[0]}:0"

    def walk(self, cursor: str, end: str | None = None) -> Iterator[tuple[str, str]]:
        """Pages and the cursors behind them, from a cursor on, to ``end`` or as far as pages can be followed."""
        while cursor != end and (following := self.after(cursor)) is not None:
            yield cursor, following
            cursor = following

    def runs(self, cursor: str, end: str | None = None) -> tuple[list[InputPartition], str]:
        """The pages of a walk in runs, and the cursor behind them."""
        starts, size, n = [], 1, 0
        for at, following in self.walk(cursor, end):
            if n % size == 0:
                starts.append(at)
            if len(starts) > RUNS and size < RUN_PAGES:
                starts, size = starts[::2], 2 * size
            cursor, n = following, n + 1
        return [Run(at, min(size, n - i * size)) for i, at in enumerate(starts)], cursor

    def rows(self, run: Run | None) -> Iterator[tuple]:
        """The records of a run's pages; none for the one task that Spark makes where no page is planned."""
        following = None if run is None else run.first
        for left in range(0 if run is None else run.pages, 0, -1):
            cursor, following = following, None
            stage, offset = cursor.rsplit(":", 1)
            for line in self.lines(cursor) or ():
                try:
                    record = json.loads(line)
                    if "next" in record and "size" in record:
                        following = following or self.behind(cursor, record)
                        continue
                    yield stage, int(offset), record["ref"], record.get("hint"), json.dumps(record["payload"], sort_keys=True, separators=(",", ":")), None
                except (ValueError, KeyError, TypeError) as e:
                    yield stage, int(offset), None, None, None, f"{type(e).__name__}: {line[:60]}"
            if following is None and left > 1:
                raise ValueError(f"the page at {cursor} has lost its head since pages were planned")


class PagedReader(DataSourceReader):
    def __init__(self, pages: Pages):
        self.pages = pages

    def partitions(self) -> list[InputPartition]:
        return self.pages.runs(self.pages.first())[0]

    def read(self, partition: Run) -> Iterator[tuple]:
        return self.pages.rows(partition)


class PagedStreamReader(DataSourceStreamReader):
    """The offset is the cursor of the first page that hasn't been taken. A broken page holds the stream at its cursor until
    it is mended."""

    def __init__(self, pages: Pages):
        self.pages, self.known, self.planned = pages, None, {}

    def initialOffset(self) -> dict:
        return {"cursor": self.pages.first()}

    def latestOffset(self) -> dict:
        start = self.known or self.pages.first()
        runs, self.known = self.pages.runs(start)
        if runs:
            self.planned = {(start, self.known): runs}
        return {"cursor": self.known}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        ends = start["cursor"], end["cursor"]
        return self.planned[ends] if ends in self.planned else self.pages.runs(*ends)[0]

    def read(self, partition: Run) -> Iterator[tuple]:
        return self.pages.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def _pages(self) -> Pages:
        return Pages(self.options["path"], self.options["stages"].split(","))

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self._pages())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PagedStreamReader(self._pages())


def write_pages(paged: DataFrame, path: str, broken_page: Column, broken_record: Column, mode: str = "overwrite") -> None:
    """Records as pages for the source: ``paged(stage, offset, next_cursor, ref, hint, payload)``, a struct as payload. Heads
    and lines that the conditions name are cut off in the middle. Mode ``append`` keeps other pages than the given ones."""
    half = lambda line, broken: F.when(broken, F.substring(line, 1, 9)).otherwise(line)
    line = half(F.to_json(F.struct("ref", "hint", "payload"), {"ignoreNullFields": "false"}), broken_record)
    whole = paged.select("stage", "offset", "next_cursor", line.alias("line")).groupBy("stage", "offset").agg(F.max("next_cursor").alias("next"), F.count(F.lit(1)).alias("size"), F.collect_list("line").alias("lines"))
    head = half(F.to_json(F.struct("next", "size"), {"ignoreNullFields": "false"}), broken_page)
    texts = whole.select("stage", "offset", F.array_join(F.concat(F.array(head), "lines"), "\n").alias("text"))
    if mode == "overwrite":
        store, root = _store(path)
        store.delete_dir_contents(root, missing_dir_ok=True)

    def write(batches: Iterator[RecordBatch]) -> Iterator[RecordBatch]:
        # By Arrow as they are read: Spark's writer needs some 30 ms for a file, and a task that runs again writes the same ones.
        store, root = _store(path)
        for batch in batches:
            for stage, offset, text in zip(*(c.to_pylist() for c in batch.columns)):
                at = f"{root}/stage={stage}/offset={offset}"
                store.create_dir(at)
                with store.open_output_stream(f"{at}/part-0.txt") as out:
                    out.write(text.encode())
            yield batch.select(["offset"])

    texts.mapInArrow(write, "offset long").write.format("noop").mode("overwrite").save()
