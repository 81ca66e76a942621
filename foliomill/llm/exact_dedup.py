"""Exact deduplication by a content sort.

Rows are range-partitioned by sampled splitters over (first bytes of the text, SHA-256 of the
whole text, identifier) and sorted externally inside each partition, so equal texts lie side
by side.  One pass compares each text in full with its neighbour and closes runs.  Because the
identifier is part of the splitter key, a run of any length may go over several partitions;
the first and the last run of each partition (two rows a partition) are then put together by
their SHA-256.  A text is held once a row, and with its neighbour, however long it is.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.llm.common import shuffle_partitions, text_or_empty, with_fields, written

#: Of the text, in the splitter key; the digest stands for the rest, and the whole text is compared.
SPLITTER_CHARS = 48


def _runs(n_cols: int, names: list[str], keep_text: bool):
    """For sorted batches with the columns [..., digest, text]: each row with its run, with the text if it is kept."""

    def run(batches):
        part = TaskContext.get().partitionId()
        last, run_no, at = None, -1, 0
        for batch in batches:
            digests, texts = batch.column(n_cols).to_pylist(), batch.column(n_cols + 1)
            runs, places = [], []
            for i, digest in enumerate(digests):
                same = last is not None and digest == last[0]
                text = None
                if same:
                    text = texts[i].as_buffer()
                    same = text.equals(last[1])  # the neighbouring full comparison
                if same:
                    at += 1
                else:
                    text = texts[i].as_buffer() if text is None else text
                    run_no, at, last = run_no + 1, 0, (digest, text)
                runs.append(run_no)
                places.append(at)
            if last is not None:
                last = (last[0], pa.py_buffer(last[1].to_pybytes()))  # lets go of the batch
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: n_cols + 1 + keep_text], pa.array([part] * k, pa.int32()), pa.array(runs, pa.int64()), pa.array(places, pa.int64())], names)

    return run


def _sorted_runs(df: DataFrame, id_col: str, text_col: str, keep: str, carry: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their runs, one row a run, and one row for each piece of a run that goes over partitions."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    order = F.col("_id").asc_nulls_last() if keep == "smallest" else F.col("_id").desc_nulls_last()
    text = text_or_empty(F.col(f"`{text_col}`"))
    # A carried text goes through the shuffle once, beside the struct, with a mark where it was null.
    keep_text = text_col in carry
    others = [F.col(f"`{c}`") for c in carry if c != text_col] + [F.col(f"`{text_col}`").isNull().alias("_no_text")] * keep_text
    source = df.select(F.struct(*others).alias("row"), F.col(f"`{id_col}`").alias("_id"), text.alias("_text"))
    source = source.withColumn("_digest", F.unhex(F.sha2(F.col("_text").cast("binary"), 256))).withColumn("_head", F.substring("_text", 1, SPLITTER_CHARS))
    parts = shuffle_partitions(df.sparkSession)
    ordered = source.repartitionByRange(parts, "_head", "_digest", order).sortWithinPartitions("_head", "_digest", "_text", order)
    marked = ordered.select("row", "_id", "_digest", "_text")
    schema = with_fields((marked if keep_text else marked.drop("_text")).schema, "_part int, _run long, _at long")
    rows = written(marked.mapInArrow(_runs(2, schema.names, keep_text), schema), "content-sort")
    runs = rows.groupBy("_part", "_run").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.when(F.col("_at") == 0, F.struct("_id"))).alias("_first"), F.first("_digest").alias("_run_digest"))
    last = rows.groupBy("_part").agg(F.max("_run").alias("_last"))
    # Only the first and the last run of a partition may go on next door: two rows a partition.
    edges = runs.join(F.broadcast(last), "_part").where((F.col("_run") == 0) | (F.col("_run") == F.col("_last"))).drop("_last")
    whole = edges.groupBy("_run_digest").agg(
        F.sum("_n").alias("_all"), F.min(F.struct("_part", "_first")).alias("_start"), F.count(F.lit(1)).alias("_pieces")).where("_pieces > 1")
    spans = edges.drop("_n", "_first").join(whole, "_run_digest").select(
        F.col("_part").alias("_p"), F.col("_run").alias("_r"), "_all", F.col("_start._part").alias("_home"), F.col("_start._first").alias("_home_first"))
    return rows, runs, spans


def _row(df: DataFrame, text_col: str, carry: list[str]) -> list[Column]:
    """The carried columns out of the struct and the text beside it."""
    text = F.when(~F.col("row._no_text"), F.col("_text")).cast(df.schema[text_col].dataType).alias(text_col) if text_col in carry else None
    return [text if c == text_col else F.col(f"row.`{c}`") for c in carry]


def content_sort(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", carry: list[str] | None = None) -> DataFrame:
    """Group rows with identical texts by sorting, and say which row of each group stays.

    keep: "smallest" or "largest" identifier stays; nulls come last in either order, and of
    rows that tie in text and identifier one stays.  A null text counts as the empty text.
    An empty table gives an empty result.  Columns of `df` may have any names.
    Returns the columns in `carry` (all of `df` by default) as one struct `row`, and keep_id,
    group_size (long), kept (boolean), text_sha256 (lower-case hex).  One row for each input row.
    """
    carry = df.columns if carry is None else carry
    rows, runs, spans = _sorted_runs(df, id_col, text_col, keep, carry)
    found = runs.join(F.broadcast(spans), (F.col("_part") == F.col("_p")) & (F.col("_run") == F.col("_r")), "left").select(
        F.col("_part").alias("_at_part"), F.col("_run").alias("_at_run"), F.coalesce("_all", "_n").cast("long").alias("group_size"),
        F.coalesce(F.col("_home_first"), F.col("_first"))["_id"].alias("keep_id"), F.coalesce("_home", "_part").alias("_home"))
    return rows.join(found, (F.col("_part") == F.col("_at_part")) & (F.col("_run") == F.col("_at_run"))).select(
        F.struct(*_row(df, text_col, carry)).alias("row"), "keep_id", "group_size", ((F.col("_at") == 0) & (F.col("_part") == F.col("_home"))).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of `df` that stay, with its columns; the rules are those of content_sort.

    A row stays if it opens a run that didn't begin in an earlier partition, so the rows
    themselves aren't shuffled again.
    """
    rows, _, spans = _sorted_runs(df, id_col, text_col, keep, df.columns)
    later = spans.where(F.col("_p") != F.col("_home"))
    first = rows.where(F.col("_at") == 0).join(F.broadcast(later), (F.col("_part") == F.col("_p")) & (F.col("_run") == F.col("_r")), "left_anti")
    return first.select(*_row(df, text_col, df.columns))
