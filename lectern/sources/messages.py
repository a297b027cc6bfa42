"""A message store as a Spark data source: ``spark.read.format("messages")`` and
``spark.readStream.format("messages")``.

The store is a Parquet file or a folder of them, on any file system that pyarrow
opens by its address. A page is a run of row groups in the order of their least
message id; its cursor is its place in that listing, and every page is one
partition. Planning reads the footers alone (eight at a time); bounds of the id
are held against them, so pages that cannot match are never opened, and inside a
page only rows within the bounds leave the reader. Bounds are options and not
pushed filters: Spark 4.1 keeps what a Python source was pushed with the loaded
relation, so a DataFrame that is used twice would answer its second filter with
the rows of its first.

The stream's offset is the last message id that was handed out. A micro-batch
takes the ids above it, up to ``limit_ids`` or the end of the store, so each
message comes once, also after a restart from the checkpoint, as long as ids only
grow. Messages that arrive under an id that was passed are not seen again.

Options: ``id`` (the id column, whole numbers), ``page_rows`` (row groups join one
page up to so many rows), ``after`` (ids above it only), ``until`` (ids up to it
only). Null ids have no place in the order: a batch read without bounds
returns them, a stream never does. An empty store has a schema and no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pfs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

PAGE_ROWS = 100_000
FOOTERS_AT_ONCE = 8
#: Rows of one record batch that a reader hands out.
BATCH_ROWS = 10_000


@dataclass(frozen=True)
class Group:
    """A row group: its file, place, rows and least and largest id (None: unknown)."""

    file: str
    at: int
    rows: int
    least: int | None
    most: int | None


@dataclass(frozen=True)
class Range:
    """Ids above ``after``, up to ``until``; None is open."""

    after: int | None = None
    until: int | None = None

    def meets(self, group: Group) -> bool:
        if group.least is None:
            return True
        return (self.after is None or group.most > self.after) and (self.until is None or group.least <= self.until)

    def mask(self, ids: pa.Array) -> pa.Array | None:
        """Which rows to keep; None: all."""
        above = None if self.after is None else pc.greater(ids, self.after)
        below = None if self.until is None else pc.less_equal(ids, self.until)
        return pc.and_(above, below) if above is not None and below is not None else below if above is None else above


@dataclass
class Page(InputPartition):
    """Row groups that one task reads."""

    groups: list[Group]
    ids: Range = field(default_factory=Range)

    def __post_init__(self) -> None:
        super().__init__(None)


class Store:
    """The listing of a message store."""

    def __init__(self, path: str, id_column: str) -> None:
        self.path, self.id_column = path, id_column

    def _open(self) -> tuple[pfs.FileSystem, str]:
        if "://" in self.path or self.path.startswith("file:"):
            return pfs.FileSystem.from_uri(self.path)
        return pfs.LocalFileSystem(), self.path

    def files(self) -> list[str]:
        system, path = self._open()
        if system.get_file_info(path).type == pfs.FileType.File:
            return [path]
        inside = system.get_file_info(pfs.FileSelector(path, recursive=True))
        names = [f.path for f in inside if f.type == pfs.FileType.File]
        hidden = lambda name: any(part[:1] in "._" for part in name[len(path) :].strip("/").split("/"))
        return sorted(n for n in names if not hidden(n) and n.endswith(".parquet"))

    def schema(self) -> StructType:
        system, _ = self._open()
        files = self.files()
        if not files:
            raise FileNotFoundError(f"no Parquet file at {self.path}")
        with system.open_input_file(files[0]) as f:
            return from_arrow_schema(pq.read_schema(f))

    def groups(self) -> list[Group]:
        """All row groups, by their least id."""
        system, _ = self._open()

        def footer(name: str) -> list[Group]:
            with system.open_input_file(name) as f:
                meta = pq.ParquetFile(f).metadata
            column = next(i for i in range(meta.num_columns) if meta.schema.column(i).path == self.id_column)
            found = []
            for at in range(meta.num_row_groups):
                stats = meta.row_group(at).column(column).statistics
                known = stats is not None and stats.has_min_max
                found.append(Group(name, at, meta.row_group(at).num_rows, stats.min if known else None, stats.max if known else None))
            return found

        with ThreadPoolExecutor(FOOTERS_AT_ONCE) as pool:
            every = [g for found in pool.map(footer, self.files()) for g in found if g.rows]
        return sorted(every, key=lambda g: (g.least is not None, g.least or 0, g.file, g.at))

    def pages(self, ids: Range, page_rows: int) -> list[Page]:
        pages, held = [], 0
        for group in self.groups():
            if not ids.meets(group):
                continue
            if not pages or held + group.rows > page_rows:
                pages.append(Page([], ids))
                held = 0
            pages[-1].groups.append(group)
            held += group.rows
        return pages

    def last_id(self) -> int | None:
        """The largest id, from the footers."""
        return max((g.most for g in self.groups() if g.most is not None), default=None)

    def read(self, page: Page | None, names: Sequence[str]) -> Iterator[pa.RecordBatch]:
        """The rows of a page; Spark asks for the page None where there is none."""
        if page is None:
            return
        system, _ = self._open()
        for name in dict.fromkeys(g.file for g in page.groups):
            with system.open_input_file(name) as f:
                reader = pq.ParquetFile(f)
                for batch in reader.iter_batches(BATCH_ROWS, [g.at for g in page.groups if g.file == name], list(names)):
                    batch = batch.select(list(names))
                    mask = page.ids.mask(batch.column(batch.schema.get_field_index(self.id_column)))
                    batch = batch if mask is None else batch.filter(mask)
                    if batch.num_rows:
                        yield batch


class _Reader(DataSourceReader):
    def __init__(self, store: Store, schema: StructType, ids: Range, page_rows: int) -> None:
        self.store, self.names, self.ids, self.page_rows = store, schema.names, ids, page_rows

    def partitions(self) -> Sequence[InputPartition]:
        return self.store.pages(self.ids, self.page_rows)

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        return self.store.read(partition, self.names)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, store: Store, schema: StructType, ids: Range, page_rows: int) -> None:
        self.store, self.names, self.ids, self.page_rows = store, schema.names, ids, page_rows

    def initialOffset(self) -> dict:
        return {"after": self.ids.after}

    def latestOffset(self) -> dict:
        last = self.store.last_id()
        if last is None:
            return self.initialOffset()
        return {"after": last if self.ids.until is None else min(last, self.ids.until)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        after, until = start["after"], end["after"]
        if until is None or (after is not None and until <= after):
            return []
        return self.store.pages(Range(after, until), self.page_rows)

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        return self.store.read(partition, self.names)


class Messages(DataSource):
    """The data source ``messages``."""

    @classmethod
    def name(cls) -> str:
        return "messages"

    def _store(self) -> Store:
        return Store(self.options["path"], self.options.get("id", "id"))

    def _settings(self) -> tuple[Range, int]:
        number = lambda key: None if self.options.get(key) in (None, "") else int(self.options[key])
        return Range(number("after"), number("until")), int(self.options.get("page_rows", PAGE_ROWS))

    def schema(self) -> StructType:
        return self._store().schema()

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._store(), schema, *self._settings())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self._store(), schema, *self._settings())


def register(spark: SparkSession) -> None:
    """Make ``messages`` known to the session."""
    spark.dataSource.register(Messages)


def read(spark: SparkSession, path: str, id_column: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("messages").options(id=id_column, **options).load(path)


def new_messages(spark: SparkSession, path: str, id_column: str, checkpoint: str, into: str, added: dict[str, Column] | None = None, **options) -> None:
    """Append to the Parquet folder ``into`` all messages that the stream behind
    ``checkpoint`` has not handed out yet, with the columns ``added``."""
    register(spark)
    stream = spark.readStream.format("messages").options(id=id_column, **options).load(path).withColumns(added or {})
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(into).awaitTermination()
