"""Embedding whitening by TSQR.

Entries become whole numbers, whose sums are exact in any order.  Rows are centred with these
sums and every partition reduces its rows to the triangular factor R of a QR decomposition; factors
are stacked and decomposed again in a tree until one is left.  It has the singular values and right
singular vectors of all centred rows, so the covariance's eigenvectors come from an SVD of R, and
neither the covariance nor its squared condition number is ever formed.

Only the number of rows, sums, and the last R reach the driver; their size is that of the vector.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.llm.common import discard, with_fields, written

#: Fixed values of the contract: an entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries of this magnitude and more count as not finite, so that whole numbers stay exact.
TOO_LARGE = float(1 << 30)
#: Factors that are stacked and decomposed together.
FAN = 16
#: Numbers that a worker centres and decomposes at a time.
BLOCK = 1 << 19


@dataclass
class Whitening:
    """n rows with sums S per dimension; unit eigenvectors in columns, eigenvalues and their total."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    total: float

    @property
    def scales(self) -> np.ndarray:
        """What a projection is multiplied with; 0 where there is no variance."""
        out = np.zeros(len(self.values))
        out[self.values > 0] = 1 / np.sqrt(self.values[self.values > 0])
        return out

    def split(self) -> tuple[np.ndarray, np.ndarray]:
        """Quotients and remainders of S by n; x - S / n is (x - quotient) - remainder / n."""
        q, r = zip(*(divmod(s, self.n) for s in self.sums))
        return np.array(q, np.int64), np.array(r, np.int64)


def whole_numbers(df: DataFrame, vec_col: str) -> DataFrame:
    """The rows of `df` whose vector and entries are all there and finite, with `_x`, the entries as whole numbers."""
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    bad = F.exists(vec, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= TOO_LARGE))
    x = F.transform(vec, lambda c: F.floor(c * SCALE).cast("long") + F.lit(SHIFT).cast("long"))
    return df.where(vec.isNotNull() & (F.size(vec) > 0)).where(~bad).withColumn("_x", x)


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as rows."""
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1)


def _blocks(batches, index: int):
    for batch in batches:
        if batch.num_rows:
            width = len(batch.column(index)[0])
            step = max(BLOCK // width, 2 * width, 1)
            for a in range(0, batch.num_rows, step):
                yield batch.slice(a, step)


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows, and exact sums, of the length that most vectors have (of equals the longer)."""

    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            lengths = batch.column(0).value_lengths().to_numpy()
            for length in np.unique(lengths):
                mine = _matrix(batch.column(0).filter(pa.array(lengths == length)))
                had = found.setdefault(int(length), [0, [0] * int(length)])
                had[0] += len(mine)
                had[1] = [a + int(b) for a, b in zip(had[1], mine.sum(0))]
        for length, (n, sums) in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([length] * (length + 1), pa.int32()), pa.array(range(-1, length), pa.int32()), pa.array([str(v) for v in [n, *sums]])], ["length", "at", "value"])

    exact = rows.select("_x").mapInArrow(run, "length int, at int, value string")
    table = written(exact.groupBy("length", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")), "sums")  # at -1: how many
    most = table.where("at = -1").orderBy(F.desc("value"), F.desc("length")).select("length", "value").take(1)
    sums = table.where(F.col("length") == most[0][0]).where("at >= 0").orderBy("at").collect() if most else []  # one vector
    discard(table)
    return (int(most[0][1]), [int(r["value"]) for r in sums]) if most else (0, [])


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of a QR decomposition, with as many rows as columns at most."""
    return np.linalg.qr(rows, mode="r")


def _last_triangle(rows: DataFrame, n: int, quotient: np.ndarray, remainder: np.ndarray) -> np.ndarray:
    width = len(quotient)

    def factor(batches):
        r = np.zeros((0, width))
        for batch in _blocks(batches, 0):
            r = triangle(np.concatenate([r, (_matrix(batch.column(0)) - quotient) - remainder / n]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    def merge(batches):
        r = np.zeros((0, width))
        for batch in batches:
            for raw in batch.column(0):
                r = triangle(np.concatenate([r, np.frombuffer(raw.as_py()).reshape(-1, width)]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

    level = written(rows.select("_x").mapInArrow(factor, "r binary"), "triangles")
    while (count := level.count()) > 1:  # rows are dealt out in turn, FAN to a task
        above = written(level.repartition(max(1, count // FAN)).mapInArrow(merge, "r binary"), "triangles")
        discard(level)
        level = above
    r = np.frombuffer(level.collect()[0]["r"]).reshape(-1, width)
    discard(level)
    return r


def fit(rows: DataFrame) -> Whitening | None:
    """Eigenvectors of the covariance (divisor n) of `_x`, by falling eigenvalue; no rows: none.

    Vectors of another length than most take no part.  Eigenvalues that rounding can't tell from 0 are 0.
    """
    n, sums = _sums(rows)
    if not n:
        return None
    model = Whitening(n, sums, np.zeros((0, 0)), np.zeros(0), 0.0)
    r = _last_triangle(rows.where(F.size("_x") == len(sums)), n, *model.split())
    _, sigma, right = np.linalg.svd(r, full_matrices=True)
    sigma = np.concatenate([sigma, np.zeros(len(sums) - len(sigma))])
    model.total = float((sigma**2).sum() / n)
    sigma[sigma <= sigma[0] * np.finfo(float).eps * max(len(sums), 64)] = 0
    model.vectors, model.values = right.T, sigma**2 / n
    return model


def deviations(x: np.ndarray, n: int, quotient: np.ndarray, remainder: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; beyond a long: none."""
    d = x - quotient
    if len(d) and max(abs(int(d.min())), abs(int(d.max()))) >= 1 << 25 or x.shape[1] > 1 << 10 or n >= 1 << 50:
        d = d.astype(object)
        r = np.array([int(v) for v in remainder], object)
        squares, mixed = (d * d).sum(1).tolist(), (d * r).sum(1).tolist()
    else:
        squares = (d * d).sum(1).tolist()
        low, high = (d @ (remainder & (1 << 25) - 1)).tolist(), (d @ (remainder >> 25)).tolist()
        mixed = [a + (b << 25) for a, b in zip(low, high)]
    rest = sum(int(v) ** 2 for v in remainder)
    found = [n * n * a - 2 * n * b + rest for a, b in zip(squares, mixed)]
    return [v if v < 1 << 63 else None for v in found]


def identity_error(rows: DataFrame, model: Whitening, components: int) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    n, (quotient, remainder), project = model.n, model.split(), (model.vectors * model.scales)[:, :components]
    k = project.shape[1]

    def run(batches):
        total = np.zeros((k, k))
        for batch in _blocks(batches, 0):
            w = ((_matrix(batch.column(0)) - quotient) - remainder / n) @ project
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(total.reshape(-1))], ["at", "value"])

    summed = rows.select("_x").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    covariance = np.zeros(k * k)
    for r in summed.collect():  # k * k numbers
        covariance[r["at"]] = r["value"] / n
    return float(np.abs(covariance.reshape(k, k) - np.eye(k)).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 8) -> DataFrame:
    """For each row and component: id_col, `component` (from 1), `n`, `deviation`, `whitened`, `explained`, `identity_error`.

    Rows whose vector is null or empty, or has null, non-finite or too large entries (TOO_LARGE), and vectors of
    another length than most, give no rows.  Repeated rows and ids count each; ids may be null.  Of equal
    eigenvalues any basis may come.  A component without variance has whitened and explained 0, and then
    identity_error is 1.  A deviation beyond a long is null.  Vectors shorter than `components` give as many
    components as they have entries; other columns are ignored; an empty table gives no rows.
    """
    source = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{vec_col}`").alias("_vec"))
    rows = whole_numbers(source, "_vec").select("_id", "_x")
    names = ["_id", "n", "deviation", "component", "whitened", "explained", "identity_error"]
    schema = with_fields(source.select("_id").schema, "n long, deviation long, component int, whitened double, explained double, identity_error double")
    model = fit(rows)
    if model is None:
        empty = source.sparkSession.createDataFrame([], T.StructType(schema.fields))
        return empty.select(F.col("_id").alias(id_col), *names[1:])
    fitted = rows.where(F.size("_x") == len(model.sums))
    k = min(components, len(model.sums))
    error = identity_error(fitted, model, k)
    n, (quotient, remainder), project = model.n, model.split(), (model.vectors * model.scales)[:, :k]
    explained = model.values[:k] / model.total if model.total else np.zeros(k)

    def run(batches):
        for batch in _blocks(batches, 1):
            x = _matrix(batch.column(1))
            m = len(x)
            whitened = ((x - quotient) - remainder / n) @ project
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(each), pa.array(np.full(m * k, n)), pa.array(deviations(x, n, quotient, remainder), pa.int64()).take(each),
                 pa.array(np.tile(np.arange(1, k + 1), m).astype(np.int32)), pa.array(whitened.reshape(-1)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))], names)

    return fitted.mapInArrow(run, schema).select(F.col("_id").alias(id_col), *names[1:])
