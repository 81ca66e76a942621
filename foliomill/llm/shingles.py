"""Sets of word shingles, an order of shingles by how frequent they are, and what similar sets can't avoid."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.common import sub_batches
from foliomill.llm.simhash import shingle_hashes

#: Counters of the sketch, in chunks, and the share of texts it counts; they set the order of shingles and so the time, not what is found.
SKETCH_BITS, CHUNKS, LOOK = 21, 64, 8
#: Bytes of text whose shingles a worker holds at a time.
SLICE = 1 << 20


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, and where each text's begin; texts without words share one of their own."""
    hashes, per = shingle_hashes(texts, shingle)
    doc = np.concatenate([np.repeat(np.arange(len(per)), per), np.flatnonzero(per == 0)])
    hashes = np.concatenate([hashes, np.zeros(int((per == 0).sum()), np.uint64)])
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[first], np.concatenate([[0], np.cumsum(np.bincount(doc[first], minlength=len(per)))])


def prefixes(values: np.ndarray, offsets: np.ndarray, rank: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each set, the values that come first by (rank, value), as many as a similar set can't avoid; and the set of each."""
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((values, rank, doc))
    at = np.arange(len(values)) - offsets[:-1][doc]
    taken = at < (sizes - np.ceil(least * sizes - 1e-9).astype(np.int64) + 1)[doc]
    return values[order][taken], doc[taken]


def sketch(texts: DataFrame, shingle: int) -> np.ndarray:
    """How many of the texts that are looked at have a shingle, by SKETCH_BITS bits of its hash."""
    width = (1 << SKETCH_BITS) // CHUNKS

    def run(batches):
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for whole in batches:
            for batch in sub_batches(whole, 1, SLICE):
                hashes, _ = shingle_sets(batch.column(1), shingle)
                np.add.at(total, bucket(hashes), 1)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([_packed(total[i * width : (i + 1) * width]) for i in range(CHUNKS)], pa.binary())], ["chunk", "counts"])

    def add(key, table):
        total = np.zeros(width, np.uint32)
        for counts in table.column("counts"):
            total += _unpacked(counts.as_py())
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([_packed(total)], pa.binary())})

    schema, out = "chunk int, counts binary", np.zeros(1 << SKETCH_BITS, np.uint32)
    looked = texts.where(F.pmod(F.xxhash64("_row"), F.lit(LOOK)) == 0).mapInArrow(run, schema)
    for row in looked.groupBy("chunk").applyInArrow(add, schema).collect():  # CHUNKS rows of a fixed size
        out[row["chunk"] * width : (row["chunk"] + 1) * width] = _unpacked(row["counts"])
    return out


def _packed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.tobytes(), 1)  # a partition's counters are nearly all 0 or 1


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), np.uint32)


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def pairs_of(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([a, b], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy(), pa.int64()), pa.array(pairs[:, 1].copy(), pa.int64())], ["a", "b"])
