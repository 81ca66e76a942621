"""WARC archives: written, normalised, indexed and read back.

Records leave Spark's writers as whole-file gzip streams.  The normaliser inflates such a stream
once from end to end, rewrites every record as a gzip member of its own, and writes a sidecar
index of offsets, so that any record can be read alone.  Archives are opened through Arrow's
file systems, so the shared folder may be local, HDFS or an object store.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm.common import new_folder, shuffle_partitions, written

END = "\r\n\r\n"
LEAST_REVISIT = 100
RECORDS_PER_FILE = 2_000
CHUNK = 1 << 18
DATE = "1970-01-01T00:00:00Z"
INDEX = "archive string, offset long, length long, record_type string, record_id string, target_uri string, payload_digest string"


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing for null; line breaks in a value are percent-encoded."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """One column `record`: the WARC record of each row, without the blank lines at its end.

    Of rows with equal payloads of at least `least` bytes, those with the smallest id are
    responses and the others revisits of it.  A null payload is empty; a null URL has no header;
    a row without id is never the one that others refer to.
    """
    base = pages.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).alias("payload"))
    base = base.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256)).withColumn("n", F.octet_length("payload").cast("long"))
    # Digests are summed up on the narrow columns first; only those held more than once are joined back.
    repeated = (base.where(F.col("n") >= least).groupBy(F.col("digest").alias("_digest"))
                .agg(F.min("id").alias("_first"), F.count(F.lit(1)).alias("_rows")).where("_rows > 1 and _first is not null").drop("_rows"))
    repeated = written(repeated, "repeated-payloads")
    typed = base.join(repeated, F.col("digest") == F.col("_digest"), "left").withColumn(
        "refers", F.when(F.col("id").isNull() | (F.col("id") != F.col("_first")), F.col("_first")))
    revisit = F.col("refers").isNotNull()
    record_id = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\n"),
        _header("WARC-Record-ID", F.coalesce(record_id(F.col("id")), F.lit("<urn:page:>"))), _header("WARC-Date", F.lit(DATE)),
        _header("WARC-Target-URI", F.col("url")), F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\n"),
        _header("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _header("WARC-Refers-To", record_id(F.col("refers"))), _header("X-Payload-Length", F.col("n")),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "))
    return typed.withColumn("block", block).select(F.concat(head, F.octet_length("block").cast("string"), F.lit(END), F.col("block")).alias("record"))


def write_monolithic(recs: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write records as whole-file gzip streams; the line separator ends each record as WARC asks."""
    recs.write.option("compression", "gzip").option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)


class Inflater:
    """Reads WARC records off a gzip stream (one member or many), a piece at a time."""

    def __init__(self, stream):
        self.stream, self.buffer, self.z, self.ended = stream, bytearray(), zlib.decompressobj(31), False

    def _more(self) -> bool:
        raw = self.z.unused_data
        if self.z.eof:
            self.z = zlib.decompressobj(31)
            while not raw:
                raw = self.stream.read(CHUNK)
                if not raw:
                    self.ended = True
                    return False
        else:
            raw = self.stream.read(CHUNK)
            if not raw:
                raise ValueError("the gzip stream ends early")
        self.buffer += self.z.decompress(raw)
        return True

    def record(self) -> tuple[dict[str, str], bytes, bytes] | None:
        """Headers (lower-case names), the whole record and its block; None at the end."""
        while (at := self.buffer.find(b"\r\n\r\n")) < 0:
            if self.ended or not self._more():
                if self.buffer.strip():
                    raise ValueError("the archive ends inside a header")
                return None
        headers = parse_headers(bytes(self.buffer[:at]))
        size = at + 4 + int(headers["content-length"])
        while len(self.buffer) < size + 4:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        whole = bytes(self.buffer[: size + 4])
        del self.buffer[: size + 4]
        return headers, whole, whole[at + 4 : size]


def parse_headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def _put(files: pafs.FileSystem, path: str, temporary: str) -> None:
    """Give a finished file its name; where an earlier attempt left one, that goes aside first and is deleted last."""
    try:
        files.move(temporary, path)
    except OSError:
        files.move(path, f"{temporary}.old")
        files.move(temporary, path)
        files.delete_file(f"{temporary}.old")


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite every archive below `source` with a gzip member for each record; return the index.

    Each archive is one stream, read once and held a record at a time.  `target` gets
    NAME.warc.gz and its sidecar NAME.warc.gz.idx (offset, length, type, id; tab-separated);
    both get their names when they are whole, so a task that is run again leaves the same files.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")  # the contents aren't read here
    dealt = listed.repartition(shuffle_partitions(spark), "path")

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield from one(path)

    def one(path):
        files, inside = pafs.FileSystem.from_uri(path)
        out_files, folder = pafs.FileSystem.from_uri(target)
        name = f"{folder}/{path.rsplit('/', 1)[1].split('.')[0]}.warc.gz"
        temporary, rows, at = f"{name}.{uuid.uuid4().hex}.tmp", [], 0
        out_files.create_dir(folder, recursive=True)
        with files.open_input_stream(inside, compression=None) as stream, out_files.open_output_stream(temporary, compression=None) as out:
            source_ = Inflater(stream)
            while (got := source_.record()) is not None:
                headers, whole, _ = got
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = z.compress(whole) + z.flush()
                out.write(member)
                rows.append((f"{target}/{name.rsplit('/', 1)[1]}", at, len(member), headers["warc-type"], headers["warc-record-id"],
                             headers.get("warc-target-uri"), headers.get("warc-payload-digest")))
                at += len(member)
        _put(out_files, name, temporary)
        side = f"{name}.idx"
        with out_files.open_output_stream(f"{temporary}.idx", compression=None) as out:
            out.write("".join(f"{r[1]}\t{r[2]}\t{r[3]}\t{r[4]}\n" for r in rows).encode())
        _put(out_files, side, f"{temporary}.idx")
        schema = [("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()),
                  ("record_id", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(schema)], [n for n, _ in schema])

    return written(dealt.mapInArrow(run, INDEX), "warc-index")


def read_records(index: DataFrame) -> DataFrame:
    """Read the indexed records, each from its own member at its offset.

    Returns record_id, record_type, refers_to, target_uri, payload (binary; null for revisits),
    payload_bytes and payload_digest; a payload that doesn't match its digest is an error.
    """
    parts = shuffle_partitions(index.sparkSession)
    dealt = index.select("archive", "offset", "length").repartition(parts, "archive").sortWithinPartitions("archive", "offset")
    schema = "record_id string, record_type string, refers_to string, target_uri string, payload binary, payload_bytes long, payload_digest string"
    names = [c.split()[0] for c in schema.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string()]

    def run(batches):
        opened, handle = None, None
        for batch in batches:
            rows, held = [], 0
            for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if archive != opened:
                    if handle is not None:
                        handle.close()
                    files, inside = pafs.FileSystem.from_uri(archive)
                    opened, handle = archive, files.open_input_file(inside)
                handle.seek(offset)
                rows.append(_read(handle.read(length)))
                held += len(rows[-1][4] or b"")
                if held > 8 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            yield _batch(rows)
        if handle is not None:
            handle.close()

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return dealt.mapInArrow(run, schema)


def _read(member: bytes):
    whole = zlib.decompress(member, 31)
    at = whole.index(b"\r\n\r\n")
    headers = parse_headers(whole[:at])
    block = whole[at + 4 : at + 4 + int(headers["content-length"])]
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    stated = headers["warc-payload-digest"].removeprefix("sha256:")
    if headers["warc-type"] == "revisit":
        return (headers["warc-record-id"], "revisit", headers["warc-refers-to"], headers.get("warc-target-uri"), None, int(headers["x-payload-length"]), stated)
    digest = hashlib.sha256(payload).hexdigest()
    if digest != stated:
        raise ValueError(f"{headers['warc-record-id']}: the payload doesn't match its digest")
    return headers["warc-record-id"], "response", None, headers.get("warc-target-uri"), payload, len(payload), digest


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write pages as monolithic archives, normalise them, and return the index of the result.

    Null payloads are empty, null urls give no target, and a null id is an empty name.  Of equal
    payloads, and of repeated rows, the smallest id is the response.  Payloads may have any length
    that fits a worker; an empty table gives an empty index.
    """
    spark = pages.sparkSession
    raw, final = new_folder(spark, "warc-raw"), new_folder(spark, "warc")
    write_monolithic(records(pages, id_col, url_col, payload_col), raw)
    return normalise(spark, raw, final)
