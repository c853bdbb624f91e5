"""A Python data source over saved feed documents: batch and streaming, for adapters to build on.

Register with ``spark.dataSource.register(FeedSource)``, then ``spark.read.format("feed_documents")``
or ``spark.readStream``.  Each file is one partition, read in a task; the driver only lists the folder.

With the option ``pushdown`` (and ``spark.sql.python.filterPushdown.enabled``) a filter on ``source_name`` chooses
files before any is opened; a stream, to which Spark pushes no filters, takes the option ``sources``, names with
commas between.

A stream's offset is the listing of the folder, and a batch reads what the listing has gained, so each file is
read once, whatever its name and time, one that was finished long ago and is moved in late too.  The option
``archive`` names a folder to which files go once their batch is done, which keeps listings short; a listing
that only lost files makes a batch without rows.  Files are to be put there whole (written elsewhere and renamed)
and left as they are until then; one that is put there again after it went is read again.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType


class FilePartition(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


def _folder(options: dict) -> tuple:
    """(file system, folder) of the options; any store that Arrow knows."""
    from pyarrow import fs

    folder = options.get("path") or options.get("folder") or "."
    return fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))


def _rows(options: dict, name: str) -> Iterator[tuple]:
    from vicinity.sources.feeds import entries

    system, folder = _folder(options)
    with system.open_input_stream(f"{folder}/{name}") as f:
        body = f.read().decode("utf-8", "replace")
    for e in entries(body):
        link = e["links"][0]["href"] if e["links"] else None
        yield os.path.splitext(name)[0], e["id"] or link, e["title"], link, e["summary"] or e["content"], e["published"] or e["updated"], e["lat"], e["lon"]


def _files(options: dict, chosen: set[str] | None = None) -> list[str]:
    """Names of the folder's documents, those of the chosen sources only."""
    from pyarrow import fs

    system, folder = _folder(options)
    found = system.get_file_info(fs.FileSelector(folder))
    names = (x.base_name for x in found if x.is_file and x.base_name.endswith((".xml", ".json")))
    return sorted(n for n in names if chosen is None or os.path.splitext(n)[0] in chosen)


class FeedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.chosen: set[str] | None = None

    def partitions(self) -> list[InputPartition]:
        return [FilePartition(n) for n in _files(self.options, self.chosen)]

    def read(self, partition: FilePartition | None) -> Iterator[tuple]:
        return iter(()) if partition is None else _rows(self.options, partition.path)


class ChoosingFeedReader(FeedReader):
    """Takes filters on the source; Spark refuses such readers while their push-down is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("source_name",):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.chosen = names if self.chosen is None else self.chosen & names
            else:
                yield f


class FeedStream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        named = options.get("sources")
        self.chosen = None if named is None else {n.strip() for n in named.split(",")}

    def initialOffset(self) -> dict:
        return {"names": []}

    def latestOffset(self) -> dict:
        return {"names": _files(self.options, self.chosen)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        known = set(start["names"])
        return [FilePartition(n) for n in end["names"] if n not in known]

    def read(self, partition: FilePartition | None) -> Iterator[tuple]:
        return iter(()) if partition is None else _rows(self.options, partition.path)

    def commit(self, end: dict) -> None:
        """Called once all batches up to an offset are done; a file that is gone has been moved before."""
        place = self.options.get("archive")
        if not place:
            return
        system, folder = _folder(self.options)
        _, target = _folder({"path": place})
        system.create_dir(target, recursive=True)
        present = set(_files(self.options, self.chosen))
        for n in end["names"]:
            if n in present:
                system.move(f"{folder}/{n}", f"{target}/{n}")


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feed_documents"

    def schema(self) -> str:
        return "source_name string, guid string, title string, link string, description string, published string, lat double, lon double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return (ChoosingFeedReader if self.options.get("pushdown", "").lower() == "true" else FeedReader)(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FeedStream(self.options)
