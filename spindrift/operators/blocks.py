"""Rows packed into blocks, and a stream of blocks that passes tasks which each hold some of another table.

What is compared with everything stays in its task, so only results leave it: nothing is copied for
pairs, and disk holds each side once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 2048


def met(stream: DataFrame, held: DataFrame) -> DataFrame:
    """Every row of ``stream`` with every row of ``held``: a task holds one partition of ``held`` and
    reads ``stream`` from end to end, so ``stream`` should be written already (a checkpoint or an exchange)."""
    return stream.coalesce(1).crossJoin(held.hint("shuffle_replicate_nl"))


def vector_bytes(x: np.ndarray) -> tuple[bytes, bool]:
    """Numbers as bytes, in four bytes each where that loses nothing, and whether they take eight."""
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    wide = not np.array_equal(small.astype(float), x, equal_nan=True)
    return (np.ascontiguousarray(x) if wide else small).tobytes(), wide


def vectors_of(data: bytes, wide: bool, rows: int) -> np.ndarray:
    return np.frombuffer(data, np.float64 if wide else np.float32).reshape(rows, -1)


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column, all of one length."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def runs(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``block``, the last one shorter."""
    held, rows = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, block - rows)
            held, rows, at = [*held, part], rows + part.num_rows, at + part.num_rows
            if rows == block:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def packed(df: DataFrame, id_col: str, vec_col: str, block: int, prefix: str) -> DataFrame:
    """Rows with a vector, ``block`` to a row at most: ids and vectors as bytes, whether numbers take eight
    bytes, and the block's number.  Partitions stay as they are."""

    def run(batches):
        for batch in runs(batches, block):
            m, wide = vector_bytes(matrix(batch.column("v")))
            ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([ids]), pa.array([m]), pa.array([wide])], names=["i", "m", "wide"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("v IS NOT NULL")
    b = rows.mapInArrow(run, "i binary, m binary, wide boolean")
    return b.select(F.monotonically_increasing_id().alias(f"{prefix}b"), *(F.col(c).alias(f"{prefix}{c}") for c in ("i", "m", "wide")))


class Nearest:
    """The ``k`` largest inner products of each query with all rows added so far, ties to the smaller id.

    Products in four-byte numbers find what may be among them, with a margin for their error; what they
    find is computed again in eight bytes and rounded to 12 digits.
    """

    TILE = 512

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, include_self: bool):
        self.ids, self.q, self.k, self.include_self = ids, vectors.astype(float), k, include_self
        with np.errstate(over="ignore"):
            self.q32 = self.q.astype(np.float32)
        self.norm = np.sqrt((self.q**2).sum(1))
        self.sim, self.dst = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None) -> None:
        """``rows``: the queries to compare, all by default."""
        rows = np.arange(len(self.ids)) if rows is None else rows
        b = vectors.astype(float)
        with np.errstate(over="ignore", invalid="ignore"):
            b32, most = b.astype(np.float32), np.sqrt((b**2).sum(1)).max(initial=0.0)
        for lo in range(0, len(rows), self.TILE):
            tile = rows[lo : lo + self.TILE]
            if most < 1e15 and self.norm[tile].max(initial=0.0) < 1e15:
                self._tile(tile, ids, b, b32, most)
            else:
                self._exact(tile, ids, b)

    def _tile(self, tile, ids, b, b32, most):
        s = self.q32[tile] @ b32.T
        err = 4 * (b.shape[1] + 8) * 6e-8 * self.norm[tile] * most + 1e-11
        bar = self.sim[tile, -1].copy()
        new, spare = ~np.isfinite(bar), self.k + (not self.include_self)
        if new.any() and len(ids) > spare:
            bar[new] = np.partition(s[new], len(ids) - spare, axis=1)[:, len(ids) - spare] - err[new]
        bar = np.nextafter((bar - err - 1e-7 * np.where(np.isfinite(bar), np.abs(bar), 0)).astype(np.float32), np.float32(-np.inf))
        at = np.flatnonzero((s >= bar[:, None]).ravel())
        r, c = np.divmod(at, len(ids))
        n = np.bincount(r, minlength=len(tile))
        if len(at) > 65_536 and (many := n > 8 * self.k + 64).any():  # equal vectors in numbers
            self._exact(tile[many], ids, b)
            keep = ~many[r]
            r, c = r[keep], c[keep]
        self._merge(tile[r], ids[c], np.round(np.einsum("ij,ij->i", self.q[tile[r]], b[c]), 12))

    def _exact(self, tile, ids, b):
        order = np.argsort(ids, kind="stable")
        with np.errstate(invalid="ignore", over="ignore"):
            s = np.round(self.q[tile] @ b[order].T, 12)
        if not self.include_self:
            s[self.ids[tile][:, None] == ids[order][None, :]] = -np.inf
        s[~np.isfinite(s)] = -np.inf
        best = np.argsort(-s, axis=1, kind="stable")[:, : self.k]
        self._merge(np.repeat(tile, best.shape[1]), ids[order][best].ravel(), np.take_along_axis(s, best, 1).ravel())

    def _merge(self, row, dst, sim):
        ok = np.isfinite(sim) if self.include_self else np.isfinite(sim) & (self.ids[row] != dst)
        row, dst, sim = row[ok], dst[ok], sim[ok]
        if not len(row):
            return
        own = np.unique(row)
        row = np.concatenate([np.repeat(own, self.k), row])
        dst, sim = np.concatenate([self.dst[own].ravel(), dst]), np.concatenate([self.sim[own].ravel(), sim])
        order = np.lexsort((dst, -sim, row))
        row, dst, sim = row[order], dst[order], sim[order]
        first = np.searchsorted(row, own)
        take = first[:, None] + np.arange(self.k)
        self.dst[own], self.sim[own] = dst[take], sim[take]

    def found(self) -> pa.RecordBatch:
        ok = np.isfinite(self.sim).ravel()
        src = np.repeat(self.ids, self.k)[ok]
        return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(self.dst.ravel()[ok], pa.int64()), pa.array(self.sim.ravel()[ok], pa.float64())], names=["src", "dst", "sim"])
