"""Several relations of Word files from one parse.

`extract` reads and parses each file once and writes a table partitioned by the kind of relation; `relation`
reads one kind back, from its own partition and with its own columns.  `parts` is a relation
too: which parts of each container were inflated.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.sources import docx
from foliomill.sources.containers import Package, scan

KINDS = {
    "paragraphs": (docx.paragraphs, docx.PARAGRAPHS), "runs": (docx.runs, docx.RUNS), "table_cells": (docx.table_cells, docx.TABLE_CELLS), "styles": (docx.styles, docx.STYLE_ROWS),
    "images": (docx.images, docx.IMAGES), "relations": (docx.relations, docx.RELATION_ROWS), "summary": (docx.summary, docx.SUMMARY),
}
PARTS = "part string, times int"


def extract(spark: SparkSession, path: str, out: str, kinds: Iterable[str] = tuple(KINDS), mode: str = "PERMISSIVE") -> None:
    """Write the relations in `kinds` of all Word files below `path` to the table `out`, each file parsed once.

    A broken file gives one row of kind `errors`, by `mode`.
    """
    kinds = list(kinds)
    if unknown := [k for k in kinds if k not in KINDS]:
        raise ValueError(f"not relations: {unknown}")

    def parse(content: bytes) -> Iterator[tuple]:
        package = Package(content)
        none = [None] * (len(kinds) + 1)
        for i, kind in enumerate(kinds):
            for row in KINDS[kind][0](package):
                yield (kind, *none[:i], row, *none[i + 1 :])
        for name, times in sorted(package.opened.items()):
            yield ("parts", *none[:-1], (name, times))

    columns = [f"{k} struct<{KINDS[k][1].replace(' ', ':').replace(',:', ',')}>" for k in kinds] + [f"parts struct<{PARTS.replace(' ', ':').replace(',:', ',')}>"]
    found = scan(spark, path, parse, ", ".join(["kind string", *columns]), "*.docx", mode)
    found.withColumn("kind", F.coalesce("kind", F.lit("errors"))).write.partitionBy("kind").parquet(out)


def relation(spark: SparkSession, table: str, kind: str) -> DataFrame:
    """One relation of a table that `extract` wrote: (path, its columns); `errors` is (path, error, error_type)."""
    rows = spark.read.parquet(table).where(F.col("kind") == kind)
    return rows.select("path", "error", "error_type") if kind == "errors" else rows.select("path", f"{kind}.*")
