"""Table functions for SQL: Python UDTFs whose columns follow their arguments.

``register(spark)`` names them; each takes a table argument first. Without
``PARTITION BY`` a function reads rows one by one and rows of a partition come in
any order; ``chunk_units`` wants the units of a key together and in order:

    SELECT * FROM chunk_text(TABLE(SELECT doc_id, text FROM documents), 900)
    SELECT * FROM chunk_units(TABLE(SELECT conv_id, turn, kind, title, text FROM units)
                              PARTITION BY conv_id ORDER BY turn)

The rules are those of the DataFrame operators, and so are the results. A null text
counts as empty; a table of the wrong width or types is an analysis error; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BinaryType, DataType, DoubleType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators import chunking
from ..sources import feeds, readers


def _columns(rows: AnalyzeArgument, name: str, *types: type[DataType] | None) -> list:
    """The fields of a table argument; ``types``: what each must be (None: any)."""
    if not rows.isTable or not isinstance(rows.dataType, StructType):
        raise ValueError(f"{name}: the first argument is a table")
    fields = rows.dataType.fields
    if len(fields) != len(types) or any(t is not None and not isinstance(f.dataType, t) for f, t in zip(fields, types)):
        wanted = ", ".join("any" if t is None else t.__name__ for t in types)
        raise ValueError(f"{name}: the table has the columns ({wanted}), not {rows.dataType.simpleString()}")
    return fields


def _number(argument: AnalyzeArgument | None, name: str, least: int) -> None:
    if argument is not None and (not argument.isConstantExpression or argument.value is None or int(argument.value) < least):
        raise ValueError(f"{name}: sizes are whole constants, {least} at least")


class ChunkText:
    """chunk_text(TABLE (key, text) [, size [, overlap]]): the chunks of each text."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        key, _ = _columns(rows, "chunk_text", None, StringType)
        _number(size, "chunk_text", 1)
        _number(overlap, "chunk_text", 0)
        schema = StructType().add(key.name, key.dataType).add("ordinal", LongType()).add("line", LongType()).add("char_start", LongType()).add("char_end", LongType()).add("text", StringType())
        return AnalyzeResult(schema)

    def eval(self, row: Row, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP) -> Iterator[tuple]:
        body = row[1] or ""
        spans = chunking.without_short(chunking.pieces(body, size, overlap), min(chunking.LEAST_CHUNK, size // 2))
        for i, (a, b) in enumerate(spans):
            yield row[0], i, 1 + body.count("\n", 0, a), a, b, body[a:b].strip()


class ChunkUnits:
    """chunk_units(TABLE (key, order, kind, title, text) PARTITION BY key ORDER BY
    order): the chunks of a key's units, short units joined."""

    def __init__(self) -> None:
        self._key, self._units = None, []

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        key, *_ = _columns(rows, "chunk_units", None, None, StringType, StringType, StringType)
        schema = StructType().add(key.name, key.dataType).add("unit", LongType()).add("ordinal", LongType()).add("section", StringType())
        return AnalyzeResult(schema.add("char_start", LongType()).add("char_end", LongType()).add("text", StringType()))

    def eval(self, row: Row) -> None:
        self._key = row[0]
        self._units.append((row[2], row[3] or "", row[4] or ""))

    def terminate(self) -> Iterator[tuple]:
        ordinal = 0
        for unit, (title, text) in enumerate(chunking.joined_units(self._units)):
            for a, b in chunking.without_short(chunking.pieces(text), chunking.LEAST_CHUNK):
                yield self._key, unit, ordinal, title, a, b, text[a:b].strip()
                ordinal += 1


class Cues:
    """cues(TABLE (key, text)): the cues of subtitle texts."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        key, _ = _columns(rows, "cues", None, StringType)
        return AnalyzeResult(StructType().add(key.name, key.dataType).add("start", DoubleType()).add("stop", DoubleType()).add("text", StringType()))

    def eval(self, row: Row) -> Iterator[tuple]:
        for start, stop, said in feeds.cues(row[1] or ""):
            yield row[0], start, stop, said


class ReadUnits:
    """read_units(TABLE (path, kind, content)): the units of files, by the readers."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        _columns(rows, "read_units", StringType, StringType, BinaryType)
        schema = StructType().add("path", StringType()).add("unit_kind", StringType()).add("number", LongType()).add("title", StringType())
        return AnalyzeResult(schema.add("text", StringType()).add("line", LongType()).add("note", StringType()))

    def eval(self, row: Row) -> Iterator[tuple]:
        yield from readers.file_units(row[0], row[1], bytes(row[2] or b""))


FUNCTIONS = {"chunk_text": ChunkText, "chunk_units": ChunkUnits, "cues": Cues, "read_units": ReadUnits}


def register(spark: SparkSession) -> None:
    """Name all table functions in the session."""
    for name, cls in FUNCTIONS.items():
        spark.udtf.register(name, udtf(cls))
