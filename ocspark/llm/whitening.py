"""Whitening of embeddings: principal components of all vectors, by merging partitions' covariances.

Entries become integers, x = floor(1024 c) + 100000. Each partition computes the count, the
mean and the centred scatter of its vectors, batch by batch; two such summaries merge by the
formula of Chan, Golub and LeVeque, in a treeReduce, so the driver gets one summary (of the
size of the dimension squared, whatever the number of vectors) and takes its eigenvectors.
A second pass whitens all vectors and summarises the outcome the same way; the largest
difference of its covariance from the identity is returned with each row.

Vectors that are null or hold null or non-finite entries are dropped, so are those whose
dimension isn't the commonest one (of equally common ones the largest). Ids are never looked
at: null and repeated ones are rows as all others. No vectors left give no rows. Entries beyond 2 ** 52
in size count as 2 ** 52. A deviation beyond a long is null. A component without variance (fewer
distinct vectors than components, equal vectors) has whitened null and takes no part in the
identity check; a vector of fewer entries than components has as many as it has entries.
Equal eigenvalues leave their components' order to the eigensolver. Columns whose names
clash with results are replaced; the vector itself isn't returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries that are turned into numbers at once.
CHUNK = 1 << 21
_MOST = 2.0**52
_RESULTS = "component int, n long, deviation long, whitened double, explained double, identity_error double"

Summary = tuple[int, list[int], np.ndarray, np.ndarray]  # vectors, exact sums, mean, centred scatter


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and has finite entries alone, as doubles."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return df.withColumn(vector, F.col(vector).cast("array<double>")).where(F.col(vector).isNotNull() & ~F.exists(vector, bad))


def whole_numbers(column: pa.Array, d: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, x) of a column of vectors, some rows at a time."""
    entries = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    rows = max(1, CHUNK // d)
    for at in range(0, len(entries), rows):
        yield at, np.clip(np.floor(1024.0 * entries[at : at + rows]) + 100000, -_MOST, _MOST).astype(np.int64)


def summary(rows: np.ndarray, sums: list[int] | None = None) -> Summary:
    """Of some vectors, centred before multiplying."""
    n = len(rows)
    mean = rows.mean(axis=0)
    centred = rows - mean
    rest = centred.mean(axis=0)  # what rounding the mean has left
    centred -= rest
    return n, sums or [], mean + rest, centred.T @ centred


def merge(a: Summary, b: Summary) -> Summary:
    """The summary of both sets together."""
    if not a[0] or not b[0]:
        return a if a[0] else b
    n, apart = a[0] + b[0], b[2] - a[2]
    return n, [s + t for s, t in zip(a[1], b[1], strict=True)], a[2] + apart * (b[0] / n), a[3] + b[3] + np.outer(apart, apart) * (a[0] * b[0] / n)


_PARTIAL = "n long, sums array<string>, mean binary, scatter binary"


def summarise(df: DataFrame, vector: str, d: int, turn=None) -> Summary:
    """The summary of all rows' x, or of turn(x)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Summary | None = None
        for b in batches:
            for _, x in whole_numbers(b.column(0), d):
                if turn is None:
                    sums = [(int(h) << 26) + int(low) for h, low in zip((x >> 26).sum(axis=0), (x & (1 << 26) - 1).sum(axis=0), strict=True)]
                    more = summary(x.astype(np.float64), sums)
                else:
                    more = summary(turn(x))
                own = more if own is None else merge(own, more)
        if own is not None:
            yield pa.RecordBatch.from_pydict({"n": [own[0]], "sums": pa.array([[str(s) for s in own[1]]], pa.list_(pa.string())), "mean": [own[2].tobytes()], "scatter": [own[3].tobytes()]})

    def read(r) -> Summary:
        mean = np.frombuffer(r.mean)
        return r.n, [int(s) for s in r.sums], mean, np.frombuffer(r.scatter).reshape(len(mean), -1)

    return df.select(vector).mapInArrow(each, _PARTIAL).rdd.map(read).treeReduce(merge)


class Basis:
    """Principal components of integer vectors: n, exact sums, eigenvalues, eigenvectors, shares of variance."""

    def __init__(self, fitted: Summary, components: int) -> None:
        self.n, self.sums, _, scatter = fitted
        cov = scatter / self.n
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(values)[::-1][:components]
        self.values, self.total = values[order], float(np.trace(cov))
        self.live = self.values > self.total * len(cov) * np.finfo(float).eps
        self.vectors = vectors[:, order] / np.sqrt(np.where(self.live, self.values, 1.0))
        # S/n as a whole number and the rest, so that x - S/n loses nothing
        self.whole = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([(s % self.n) / self.n for s in self.sums])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.whole) - self.rest) @ self.vectors

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S) ** 2, exact."""
        off = x - self.whole
        low = np.array([s % self.n for s in self.sums], object)
        most = float(np.abs(off).max(initial=0) + 1) * self.n
        if most * most * x.shape[1] < 2**62:
            y = off * self.n - low.astype(np.int64)
            return (y * y).sum(axis=1).tolist()
        y = off.astype(object) * self.n - low
        return [int(v) if v < 2**63 else None for v in (y * y).sum(axis=1)]


def fit(df: DataFrame, vector: str = "embedding", components: int = 8) -> tuple[DataFrame, int, Basis] | None:
    """The rows to be whitened, their dimension and their components; None if there are no rows."""
    rows = usable(df, vector)
    sizes = rows.groupBy(F.size(vector).alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return None
    rows = rows.where(F.size(vector) == sizes.d)
    return rows, sizes.d, Basis(summarise(rows, vector, sizes.d), components)


def identity_error(rows: DataFrame, vector: str, d: int, basis: Basis) -> float:
    """The second pass: how far the covariance of the whitened vectors is from the identity."""
    live = basis.live
    if not live.any():
        return 0.0
    n, _, _, scatter = summarise(rows, vector, d, lambda x: basis.whiten(x)[:, live])
    return float(np.abs(scatter / n - np.eye(int(live.sum()))).max())


def whiten(df: DataFrame, vector: str = "embedding", components: int = 8) -> DataFrame:
    """A row for each usable vector and component: df's other columns, component (from 1 by falling variance), n, deviation, whitened, explained, identity_error."""
    new = [c.split()[0] for c in _RESULTS.split(", ")]
    others = [c for c in df.columns if c not in (vector, *new)]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in others] + [_RESULTS])
    fitted = fit(df, vector, components)
    if fitted is None:
        return df.sparkSession.createDataFrame([], schema)
    rows, d, basis = fitted
    error, k = identity_error(rows, vector, d, basis), len(basis.values)
    explained = basis.values / basis.total if basis.total > 0 else np.zeros(k)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in whole_numbers(b.column(len(others)), d):
                z = basis.whiten(x)
                picked = np.repeat(np.arange(at, at + len(x)), k)
                cols = {c: b.column(i).take(pa.array(picked)) for i, c in enumerate(others)}
                cols |= {
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    "n": pa.array(np.full(len(picked), basis.n, np.int64)),
                    "deviation": pa.array([v for v in basis.deviation(x) for _ in range(k)], pa.int64()),
                    "whitened": pa.array(z.ravel(), mask=np.tile(~basis.live, len(x))),
                    "explained": pa.array(np.tile(explained, len(x))),
                    "identity_error": pa.array(np.full(len(picked), error)),
                }
                yield pa.RecordBatch.from_pydict(cols)

    return rows.select(*others, vector).mapInArrow(each, schema)
