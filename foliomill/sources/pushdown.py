"""Container files as data sources into which filters are pushed.

`spark.read.format("folio_cells")` and its kin plan tasks of whole files and keep simple filters on
the columns that name parts of a container (the sheet, the page, the table): a sheet's XML that no
filter wants is never inflated, a page's content is never interpreted.  Other filters stay with Spark.
Files are opened by the tasks through Arrow's file systems.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual)

from foliomill.sources import docx, pdf, xlsx
from foliomill.sources.containers import BROKEN, MODES, error_type

#: Tasks that a read is planned as, at most; beyond, a task has several files.
TASKS = 10_000
COMPARE: dict[type, Callable] = {
    EqualTo: lambda a, b: a == b, EqualNullSafe: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, IsNotNull: lambda a, b: True}


@dataclass
class Wanted:
    """What filters leave of each column's values."""

    tests: list[tuple[str, type, object]] = field(default_factory=list)

    def __call__(self, column: str, value) -> bool:
        return all(value is not None and COMPARE[kind](value, other) for name, kind, other in self.tests if name == column)

    def error_rows(self) -> bool:
        """Rows of broken files have nulls in all columns, which no test lets through."""
        return not self.tests

    def push(self, f: Filter, columns: tuple[str, ...]) -> bool:
        """Take a filter on one of the columns; False where Spark has to evaluate it."""
        name = f.attribute[0] if type(f) in COMPARE and len(f.attribute) == 1 else None
        other = getattr(f, "value", None)
        if name not in columns or (other is None and not isinstance(f, IsNotNull)) or isinstance(f, In) and None in other:
            return False
        self.tests.append((name, type(f), other))
        return True


@dataclass
class Files(InputPartition):
    paths: list[str]


class ContainerReader(DataSourceReader):
    def __init__(self, source: ContainerSource):
        self.source, self.mode = source, source.options.get("mode", "PERMISSIVE").upper()
        if self.mode not in MODES:
            raise ValueError(f"not a mode: {self.mode!r}")
        self.paths = json.loads(source.options["files"])
        self.wanted = Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.wanted.push(f, self.source.prunes):
                yield f

    def partitions(self) -> list[Files]:
        each = -(-len(self.paths) // TASKS) or 1
        return [Files(self.paths[i : i + each]) for i in range(0, len(self.paths), each)]

    def read(self, partition: Files) -> Iterator[tuple]:
        names = [f.split()[0] for f in self.source.ddl.split(", ")]
        places = [(i, n) for i, n in enumerate(names) if n in self.source.prunes]
        for path in partition.paths:
            system, place = fs.FileSystem.from_uri(path)
            try:
                with system.open_input_file(place) as f:
                    content = f.read()
                found = list(self.source.parse(content, self.wanted)) if content else []  # whole or not at all
            except BROKEN as e:
                if self.mode == "FAILFAST":
                    raise ValueError(f"{path}: {e}") from e
                if self.mode == "PERMISSIVE" and self.wanted.error_rows():
                    yield (path, *[None] * len(names), f"{type(e).__name__}: {e}", error_type(e))
            else:
                for row in found:
                    if all(self.wanted(n, row[i]) for i, n in places):
                        yield (path, *row, None, None)


class ContainerSource(DataSource):
    """One relation of one kind of container; `prunes` are the columns whose filters skip parts."""

    short: str
    glob: str
    ddl: str
    prunes: tuple[str, ...] = ()

    @classmethod
    def name(cls) -> str:
        return cls.short

    def schema(self) -> str:
        return f"path string, {self.ddl}, error string, error_type string"

    def reader(self, schema) -> ContainerReader:
        return ContainerReader(self)

    @staticmethod
    def parse(content: bytes, wanted: Wanted) -> Iterator[tuple]:
        raise NotImplementedError


class Cells(ContainerSource):
    short, glob, ddl, prunes = "folio_cells", "*.xlsx", xlsx.CELLS, ("sheet_ord", "sheet", "row", "col")
    parse = staticmethod(xlsx.cells)


class CellStyles(ContainerSource):
    short, glob, ddl, prunes = "folio_cell_styles", "*.xlsx", xlsx.STYLES, ("sheet_ord", "sheet", "row", "col")
    parse = staticmethod(xlsx.cell_styles)


class PageElements(ContainerSource):
    short, glob, ddl, prunes = "folio_page_elements", "*.pdf", pdf.ELEMENTS, ("page",)
    parse = staticmethod(pdf.elements)


class TableCells(ContainerSource):
    short, glob, ddl, prunes = "folio_table_cells", "*.docx", docx.TABLE_CELLS, ("table_idx", "row", "col")
    parse = staticmethod(docx.table_cells)


class Media(ContainerSource):
    short, glob, ddl, prunes = "folio_media", "*.docx", "name string, content binary", ("name",)
    parse = staticmethod(docx.media)


SOURCES = {c.short: c for c in (Cells, CellStyles, PageElements, TableCells, Media)}


def open_source(spark: SparkSession, name: str, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """A relation of the containers below `path`, with filters pushed into its reader.

    The file names are listed by Spark, as for any other source; no file is opened to plan the read.
    """
    source = SOURCES[name]
    spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    files = spark.read.format("binaryFile").option("pathGlobFilter", source.glob).load(path).inputFiles()
    return spark.read.format(name).option("files", json.dumps(sorted(files))).option("mode", mode).load()
