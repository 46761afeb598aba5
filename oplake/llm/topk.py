"""Exact top-k inner-product search by pivot-table elimination.

A table keeps each vector's distances to many pivots, the origin among them, in the form in which
they bound best: coordinates in the frame that the pivots span, and the height above it.  Two
vectors are no nearer than frame and heights say, which is the maximum of all lower bounds that
these distances allow, and so their inner product has an upper bound.  Candidates are evaluated
in the order of that bound until none left can enter the top k.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oplake.llm.common import scratch

#: Sums of products below this are whole in double precision.
_WHOLE = float(1 << 53)
#: Pivots, the origin aside, as a share of the vectors' width: bounds are loose until most directions are covered.
PIVOT_SHARE = 7 / 8
#: Bounds are held for so many pairs at a time.
PAIRS = 1 << 22


def integer_vectors(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, x as double.  Vectors that are null or hold
    null or non-finite components, and rows without an id, take no part; rows that share an id stay apart."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    whole = F.transform("x", lambda e: F.floor(e * scale).cast("long"))
    return rows.where(F.col("vec_id").isNotNull() & finite).select("vec_id", whole.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, shorter ones padded with zeros."""
    flat, offsets = np.asarray(column.flatten()), np.asarray(column.offsets)
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    if len(flat):
        out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(offsets[:-1], sizes)] = flat
    return out


class Frame:
    """The frame of some pivots: orthogonal axes that span them, in their order."""

    def __init__(self, pivots: np.ndarray):
        axes: list[np.ndarray] = []
        for p in pivots.astype(np.float64):
            size = np.linalg.norm(p)
            for _ in range(2):  # twice, against rounding
                for a in axes:
                    p = p - (p @ a) * a
            if np.linalg.norm(p) > 1e-6 * max(size, 1e-300):
                axes.append(p / np.linalg.norm(p))
        self.axes = np.array(axes).reshape(len(axes), pivots.shape[1])

    def table(self, v: np.ndarray) -> np.ndarray:
        """Coordinates and height of each vector; the distances to the pivots and the origin fix both."""
        v = v.astype(np.float64)
        c = v @ self.axes.T
        height = np.sqrt(np.maximum((v * v).sum(axis=1) - (c * c).sum(axis=1), 0.0))
        return np.concatenate([c, height[:, None]], axis=1)


def far_apart(vectors: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` places of vectors that lie far apart: each next one stands highest above the frame of those before."""
    rest, out = vectors.astype(np.float64), []
    for _ in range(min(n, len(vectors))):
        height = (rest * rest).sum(axis=1)
        at = int(np.argmax(height))
        if height[at] <= 1e-9:
            break
        out.append(at)
        axis = rest[at] / np.sqrt(height[at])
        rest = rest - np.outer(rest @ axis, axis)
    return np.array(out, dtype=np.int64)


class PivotTable:
    """The queries of one block with their rows of the pivot table."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, frame: Frame, k: int):
        self.rows, self.q, self.k = rows, vectors, k
        self.real = vectors.astype(np.float64)
        self.norm = np.sqrt((self.real**2).sum(axis=1))
        self.bound = frame.table(vectors)
        self.most = float(np.abs(vectors).max(initial=0))
        # queries are candidates of each other: k of them bound the k-th best score
        self.floor = np.full(len(rows), -np.inf)
        for a in range(0, len(rows), step := max(1, PAIRS // max(1, len(rows)))):
            inner = self.real[a : a + step] @ self.real.T
            inner[np.arange(len(inner)), a + np.arange(len(inner))] = -np.inf
            if len(rows) > k:
                self.floor[a : a + step] = np.partition(inner, -k, axis=1)[:, -k]
        self.floor -= 1e-9 * self.norm * self.norm.max(initial=0.0) + 1e-3

    def search(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, table: np.ndarray, best: list[tuple[np.ndarray, np.ndarray]], batch: int = 64) -> int:
        """Merges candidates into ``best`` ((scores, ids) of each query, best first); returns how many
        were evaluated.  ``table`` holds their rows of the pivot table."""
        real = x.astype(np.float64)
        norm = np.sqrt((real * real).sum(axis=1))
        big = float(np.abs(x).max(initial=0)) * self.most * max(1, x.shape[1]) >= _WHOLE
        done, step = 0, max(1, PAIRS // max(1, len(self.rows)))
        for a in range(0, len(x), step):
            part = slice(a, a + step)
            # the table carries rounding errors; a bound raised by them stays a bound
            bounds = self.bound @ table[part].T
            bounds += 1e-6 * self.norm[:, None] * norm[part][None, :] + 1e-3
            for i in range(len(self.rows)):
                scores, found = best[i]
                least = max(self.floor[i], float(scores[-1]) if len(scores) == self.k else -np.inf)
                at = np.flatnonzero(bounds[i] >= least)
                at = at[rows[a + at] != self.rows[i]]
                at = at[np.argsort(-bounds[i][at], kind="stable")]
                for b in range(0, len(at), batch):
                    some = at[b : b + batch]
                    if bounds[i][some[0]] < least:
                        break
                    some = some[bounds[i][some] >= least]
                    new = x[a + some] @ self.q[i] if big else (real[a + some] @ self.real[i]).astype(np.int64)
                    done += len(some)
                    scores, found = np.concatenate([scores, new]), np.concatenate([found, ids[a + some]])
                    order = np.lexsort((found, -scores))[: self.k]
                    scores, found = scores[order], found[order]
                    if len(scores) == self.k:
                        least = max(least, float(scores[-1]))
                best[i] = (scores, found)
        return done


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int | None = None, block: int = 16384, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` highest integer inner products of every query row against all other rows:
    query_id, rank, vec_id, score; ties go to the smaller vec_id.

    The pivot table is computed once, for all rows; ``pivots`` (default: 7/8 of the width) are rows
    of a sample that lie far apart.  Queries go out in blocks of about ``block`` vectors, so what is
    broadcast does not grow with the table; each task returns at most k rows of a query.  A shorter
    vector counts as padded with zeros.  Rows that share an id are queries and candidates each.  A
    table without queries, or with one row, gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    numbered = scratch(integer_vectors(vectors, scale, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()), "topk-vectors")
    width = numbered.agg(F.max(F.size("v")).alias("w")).first().w or 0
    pad = lambda rows: np.array([list(r.v) + [0] * (width - len(r.v)) for r in rows], dtype=np.int64).reshape(len(rows), width)
    wanted = max(1, int(PIVOT_SHARE * width)) if pivots is None else pivots
    some = pad(numbered.orderBy(F.xxhash64("row"), "row").limit(4 * wanted).collect())
    frame = Frame(some[far_apart(some, wanted)])

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = frame.table(_matrix(batch.column(2), width)).astype(np.float32)
            flat = pa.array(table.ravel(), pa.float32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]), flat)], names=["row", "vec_id", "v", "t"])

    whole = scratch(numbered.select("row", F.col("vec_id").cast("long").alias("vec_id"), "v").mapInArrow(described, "row long, vec_id long, v array<long>, t array<float>"), "topk-table")
    queries = numbered.where(is_query).select("row", "vec_id", "v")
    blocks = max(1, math.ceil(queries.count() / block))
    parts = []
    for b in range(blocks):
        rows = sorted(queries.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).collect(), key=lambda r: r.row)
        if not rows:
            continue
        shared = spark.sparkContext.broadcast((PivotTable(np.array([r.row for r in rows], dtype=np.int64), pad(rows), frame, k), np.array([r.vec_id for r in rows], dtype=np.int64)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, ids = shared.value
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]
            for batch in batches:
                if len(batch):
                    table = np.asarray(batch.column(3).flatten(), dtype=np.float64).reshape(len(batch), -1)
                    own.search(np.asarray(batch.column(0)), np.asarray(batch.column(1)), _matrix(batch.column(2), own.q.shape[1]), table, best)
            sizes = [len(s) for s, _ in best]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own.rows, sizes)), pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate([f for _, f in best])), pa.array(np.concatenate([s for s, _ in best]))], names=["row", "query_id", "vec_id", "score"])

        parts.append(whole.mapInArrow(run, "row long, query_id long, vec_id long, score long"))
        if len(parts) >= 16:  # keeps the plan short; only top rows are written
            parts = [scratch(_best(_union(parts), k), "topk-block")]
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return _best(_union(parts), k).select("query_id", "rank", "vec_id", "score")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0].select("row", "query_id", "vec_id", "score")
    for p in parts[1:]:
        out = out.unionByName(p.select("row", "query_id", "vec_id", "score"))
    return out


def _best(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)
