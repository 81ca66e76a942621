"""Files written on the executors: one CSV for each sheet, one JSON or Markdown file for each document.

`folio_files` is a data source writer.  Its rows (name, text) are pieces of files, the pieces of a file side by
side and in order in one task.  A task writes below a folder of its own; the driver moves whole
files into place when all tasks have ended, and removes the folders when one has failed, so
nobody sees half a file, and a task that runs twice writes a file once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from foliomill.functions import text as T

BOM = b"\xef\xbb\xbf"


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class FilesWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.bom, self.overwrite = options["path"], options.get("bom", "false").lower() == "true", overwrite
        self.stage = f"_staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        system, root = _system(self.path)
        folder, names, out, now = f"{root}/{self.stage}/{uuid.uuid4().hex}", [], None, None
        system.create_dir(folder, recursive=True)
        try:
            for row in rows:
                if row.name != now:
                    if out is not None:
                        out.close()
                    if not row.name or "/" in row.name or row.name in names:
                        raise ValueError(f"not a file's name, or its pieces lie apart: {row.name!r}")
                    now = row.name
                    names.append(now)
                    out = system.open_output_stream(f"{folder}/{now}")
                    if self.bom:
                        out.write(BOM)
                out.write((row.text or "").encode())
        finally:
            if out is not None:
                out.close()
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _system(self.path)
        moves = [(f"{m.folder}/{n}", f"{root}/{n}") for m in messages if m is not None for n in m.names]
        targets = [to for _, to in moves]
        if len(set(targets)) < len(targets):
            self.abort(messages)
            raise ValueError("the pieces of a file lie in several tasks")
        there = [] if self.overwrite or not targets else [i.path for i in system.get_file_info(targets) if i.type != fs.FileType.NotFound]
        if there:
            self.abort(messages)
            raise FileExistsError(there[0])
        for source, to in moves:
            system.move(source, to)
        system.delete_dir(f"{root}/{self.stage}") if messages else None

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _system(self.path)
        if system.get_file_info(f"{root}/{self.stage}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.stage}")


class FilesSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folio_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options, overwrite)


def write_files(pieces: DataFrame, path: str, order: list[str | Column] = (), bom: bool = False, overwrite: bool = False) -> None:
    """Write pieces (name, text, and what `order` needs) as the files of a folder, a file's pieces in order."""
    pieces.sparkSession.dataSource.register(FilesSink)
    dealt = pieces.repartition("name").sortWithinPartitions("name", *order).select("name", "text")
    dealt.write.format("folio_files").option("bom", str(bom).lower()).mode("overwrite" if overwrite else "append").save(path)


def write_csv(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write rows (sheet, row, vals) as one CSV for each sheet, with a byte order mark and no header.

    A null cell is empty; characters that no file's name may have are `_` in it.
    """
    line = T.csv_line(F.transform("vals", lambda v: F.coalesce(v, F.lit(""))))
    write_files(rows.select(_named("sheet", ".csv"), "row", line.alias("text")), path, ["row"], True, overwrite)


def write_json(docs: DataFrame, path: str, id_col: str = "doc_id", overwrite: bool = False) -> None:
    """Write each row as a JSON object in a file of its own, named by `id_col`; nulls are kept."""
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), {"ignoreNullFields": "false"})
    write_files(docs.select(_named(id_col, ".json"), F.concat(body, F.lit("\n")).alias("text")), path, [], False, overwrite)


def write_markdown(pages: DataFrame, path: str, id_col: str = "page_id", text_col: str = "content", overwrite: bool = False) -> None:
    """Write each row's Markdown to a file of its own, named by `id_col`."""
    write_files(pages.select(_named(id_col, ".md"), F.col(text_col).alias("text")), path, [], False, overwrite)


def _named(column: str, ending: str) -> Column:
    return F.concat(F.regexp_replace(F.col(f"`{column}`").cast("string"), r'[/\\:*?"<>|\x00-\x1F]', "_"), F.lit(ending)).alias("name")
