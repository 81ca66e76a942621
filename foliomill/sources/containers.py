"""Container files as relations.

A parser is a plain function from a file's bytes to tuples.  `scan` runs one over the files below
a path, a file at a time, with no state beside the file, so a lost executor costs its files only.
A file that a parser can't read gives one row with `error` and `error_type` set and the other columns null.  Files of no bytes give no row: Spark's
file listing passes over them.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ROWS_A_BATCH = 4096
MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")
BROKEN = (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, KeyError, ValueError, IndexError, TypeError, EOFError, RecursionError, NotImplementedError)


def error_type(error: Exception) -> str:
    """What kind of fault a file has: encrypted, missing_part, corrupted_document, xml_parse or unsupported."""
    if isinstance(error, ElementTree.ParseError):
        return "xml_parse"
    if "encrypted" in str(error).lower():
        return "encrypted"
    if isinstance(error, NotImplementedError):
        return "unsupported"
    return "missing_part" if isinstance(error, KeyError) else "corrupted_document"


def scan(spark: SparkSession, path: str, parse: Callable[[bytes], Iterable[tuple]], ddl: str, glob: str | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """`path`, the columns of `ddl`, `error` and `error_type` for each tuple that `parse` gives for a file.

    mode: PERMISSIVE gives an error row for a broken file, DROPMALFORMED nothing, FAILFAST ends the job.
    """
    if mode not in MODES:
        raise ValueError(f"not a mode: {mode!r}")
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path).select("path", "content")
    fields = T.StructType.fromDDL(ddl).fields
    schema = T.StructType([T.StructField("path", T.StringType()), *fields, T.StructField("error", T.StringType()), T.StructField("error_type", T.StringType())])
    arrow = to_arrow_schema(schema)

    def rows(name: str, content: bytes) -> Iterator[tuple]:
        try:
            found = list(parse(content))  # whole or not at all: a file that breaks midway gives its error only
        except BROKEN as e:
            if mode == "FAILFAST":
                raise ValueError(f"{name}: {e}") from e
            if mode == "PERMISSIVE":
                yield (name, *[None] * len(fields), f"{type(e).__name__}: {e}", error_type(e))
        else:
            yield from ((name, *r, None, None) for r in found)

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                held = []
                for row in rows(name, content.as_py() or b""):
                    held.append(row)
                    if len(held) == ROWS_A_BATCH:
                        yield _batch(held, arrow)
                        held = []
                if held:
                    yield _batch(held, arrow)

    return files.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class Package:
    """A zip container whose parts are inflated, and whose XML is parsed, once; `opened` counts how often each part was inflated."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.opened: Counter[str] = Counter()
        self.trees: dict[str, ElementTree.Element] = {}

    @classmethod
    def of(cls, content: bytes | Package) -> Package:
        return content if isinstance(content, Package) else cls(content)

    def names(self) -> list[str]:
        return self.zip.namelist()

    def has(self, name: str) -> bool:
        return name in self.zip.NameToInfo

    def read(self, name: str) -> bytes:
        self.opened[name] += 1
        return self.zip.read(name)

    def xml(self, name: str, clean: Callable[[bytes], bytes] = lambda raw: raw) -> ElementTree.Element:
        """The root of an XML part; KeyError where there is none."""
        if name not in self.trees:
            self.trees[name] = ElementTree.fromstring(clean(self.read(name)))
        return self.trees[name]


def everything(column: str, value) -> bool:
    """The filter that wants all rows."""
    return True
