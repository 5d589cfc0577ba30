"""Approximate nearest neighbours by cross-polytope hashing.

Each of ``TABLES`` tables has two pseudo-random rotations (three rounds of random signs and a fast Hadamard transform); the
nearest of the signed axes in both are a unit vector's cell. Every vector lies in one cell of each table. A query looks into the
``PROBES`` cells of each table whose pairs of axes have the greatest sum; all vectors found there are ranked by the exact Euclidean
distance of the original vectors. Tables, cells and probes are the same for every number of vectors. Cells travel by themselves, or,
where they would hold under ``DENSE`` vectors over the axes each, all cells of one first axis together (``together``), of which a query still sees
those that it looks into alone. They are dealt out in salted blocks of about ``BLOCK`` rows by their counted
sizes, so a cell full of one vector is no single task's work; a block returns each query's nearest ``K`` alone. Queries that
found fewer than ``K`` look into every cell of the first table, which is exact.

Defined cases: vectors that are null, zero, or hold null or non-finite components, or whose length is not the
commonest, neither query nor answer; rows without ``vec_id`` neither; a repeated ``vec_id`` counts once, by the nearest of
its vectors, asks with the first of them by its bytes, and its rows do not answer its own query; ties go to the smaller
``vec_id``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profilekit.llm.common import materialize, pieces

TABLES, PROBES, K, EVERY, BLOCK, ROUNDS, SEED = 32, 256, 10, 100, 2048, 3, 20240501
#: Vectors of a first axis from which on its cells travel apart; results do not depend on it.
DENSE = 4096
#: Numbers of a table of differences.
NUMBERS = 1 << 20
#: Cells whose sizes are broadcast; more are joined by shuffle.
BOUND = 1 << 17


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast transform of each row; the number of columns is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotations(vectors: np.ndarray, tables: int = TABLES) -> Iterator[np.ndarray]:
    """For each table the projections on all signed axes; vectors are brought to unit length first."""
    n = 1 << max(1, (vectors.shape[1] - 1).bit_length())
    unit = np.zeros((len(vectors), n))
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit[:, : vectors.shape[1]] = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
    rng = np.random.default_rng(SEED)
    for _ in range(tables):
        y = unit
        for signs in rng.integers(0, 2, (ROUNDS, n)) * 2 - 1:
            y = hadamard(y * signs)
        yield np.concatenate([y, -y], axis=1)


def signed_axes(dimensions: int) -> int:
    return 2 << max(1, (dimensions - 1).bit_length())


def together(count: int, axes: int) -> int:
    """How many neighbouring cells of a table travel together: those of one first axis, or one."""
    return axes if count <= DENSE * axes else 1


def cells(vectors: np.ndarray, probes: int, tables: int = TABLES) -> Iterator[np.ndarray]:
    """For each table the ``probes`` best cells of each vector, best first."""
    both, axes = rotations(vectors, 2 * tables), signed_axes(vectors.shape[1])
    for first in both:
        other = next(both)
        a, b = (np.argsort(-x, axis=1, kind="stable")[:, :probes] for x in (first, other))
        total = np.take_along_axis(first, a, 1)[:, :, None] + np.take_along_axis(other, b, 1)[:, None]
        best = np.argsort(-total.reshape(len(first), -1), axis=1, kind="stable")[:, :probes]
        yield np.take_along_axis(a, best // b.shape[1], 1) * axes + np.take_along_axis(b, best % b.shape[1], 1)


def packing(vectors: DataFrame) -> str:
    """How vectors travel: single precision if that is what they are, so that nothing is lost."""
    kind = vectors.schema["embedding"].dataType
    return "<f4" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "<f8"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, vec (as ``packing`` says) of the rows that take part."""
    dtype = packing(vectors)
    v = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    top = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if top is None:
        return v.select("vec_id", F.lit(b"").alias("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([x.tobytes() for x in flat.astype(dtype)], pa.binary())], ["vec_id", "vec"])

    return v.where(F.size("v") == top["n"]).mapInArrow(run, "vec_id long, vec binary")


def _unpack(column: list[bytes], dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype).astype(np.float64).reshape(len(column), -1)


def index(vectors: DataFrame, dtype: str, width: int = 1) -> DataFrame:
    """Each vector's cell in each table; ``part`` is what travels together, ``width`` cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4096):
            if batch.num_rows:
                for t, best in enumerate(cells(_unpack(batch.column("vec").to_pylist(), dtype), 1)):
                    columns = [np.full(batch.num_rows, t), best[:, 0] // width, best[:, 0]]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in columns), batch.column("vec_id"), batch.column("vec")], ["t", "part", "cell", "vec_id", "vec"])

    return vectors.mapInArrow(run, "t int, part int, cell int, vec_id long, vec binary")


def probes(queries: DataFrame, dtype: str, width: int = 1, looks: int = PROBES) -> DataFrame:
    """A row for each query, table and part that holds cells it looks into, with these cells as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 64):
            if batch.num_rows:
                for t, best in enumerate(cells(_unpack(batch.column("vec").to_pylist(), dtype), looks)):
                    best = np.sort(best, axis=1)
                    part, row = (best // width).ravel(), np.repeat(np.arange(len(best)), best.shape[1])
                    starts = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (row[1:] != row[:-1])])
                    asked = [x.tobytes() for x in np.split(best.ravel().astype(np.int32), starts[1:])]
                    of = pa.array(row[starts])
                    columns = [np.full(len(starts), t), part[starts]]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in columns), pa.array(asked, pa.binary()), batch.column("vec_id").take(of), batch.column("vec").take(of)], ["t", "part", "cells", "query_id", "qvec"])

    return queries.mapInArrow(run, "t int, part int, cells binary, query_id long, qvec binary")


def _seen(asked: list[bytes], of_block: np.ndarray) -> np.ndarray:
    """For each query and vector of a block whether the query looks into the vector's cell; no cells are all cells."""
    known, at = np.unique(of_block, return_inverse=True)
    wanted, row = np.frombuffer(b"".join(asked), np.int32), np.repeat(np.arange(len(asked)), [len(x) // 4 for x in asked])
    place = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    there = known[place] == wanted
    seen = np.zeros((len(asked), len(known)), bool)
    seen[row[there], place[there]] = True
    seen[[not x for x in asked]] = True
    return seen[:, at]


def _nearest(queries: pd.DataFrame, block: pd.DataFrame, k: int, dtype: str) -> pd.DataFrame:
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if len(queries) and len(block):
        ids, x, of_block = block["vec_id"].to_numpy(), _unpack(block["vec"].tolist(), dtype), block["cell"].to_numpy()
        norms, (known, of_id, times) = (x * x).sum(axis=1), np.unique(ids, return_inverse=True, return_counts=True)
        enough = k * int(times.max())  # an id may have several vectors
        for at in range(0, len(queries), 256):
            part = queries.iloc[at : at + 256]
            q, own = _unpack(part["qvec"].tolist(), dtype), part["query_id"].to_numpy()
            near = norms[None] - 2 * (q @ x.T)
            near[(ids[None] == own[:, None]) | ~_seen(part["cells"].tolist(), of_block)] = np.inf
            limit = np.partition(near, enough - 1, axis=1)[:, enough - 1] if len(x) > enough else np.full(len(q), np.inf)
            a, b = np.nonzero((near <= (limit + 1e-9 * (1 + np.abs(limit) + (q * q).sum(axis=1)))[:, None]) & np.isfinite(near))
            size = max(1, NUMBERS // x.shape[1])
            exact = np.concatenate([np.zeros(0), *[np.sqrt(((x[b[i : i + size]] - q[a[i : i + size]]) ** 2).sum(axis=1)) for i in range(0, len(a), size)]])
            order = np.lexsort((ids[b], exact, a))
            order = order[np.sort(np.unique(a[order] * len(known) + of_id[b[order]], return_index=True)[1])]
            rank = np.arange(len(order)) - np.searchsorted(a[order], a[order])
            order = order[rank < k]
            out.append((own[a[order]], ids[b[order]], exact[order]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)]
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))


def _search(cells_: DataFrame, looks: DataFrame, sizes: DataFrame, k: int, dtype: str) -> DataFrame:
    """The nearest ``k`` of each query in each block of the cells it looks into."""
    parts = F.broadcast(sizes) if sizes.count() <= BOUND else sizes  # at most BOUND rows of three numbers
    blocks = cells_.join(parts, ["t", "part"]).withColumn("salt", F.pmod(F.xxhash64("vec_id", "vec"), F.col("salts")).cast("int")).drop("salts")
    asked = looks.join(parts, ["t", "part"]).withColumn("salt", F.explode(F.sequence(F.lit(0), (F.col("salts") - 1).cast("int")))).drop("salts")
    by = ("t", "part", "salt")
    return asked.groupBy(*by).cogroup(blocks.groupBy(*by)).applyInPandas(lambda q, b: _nearest(q, b, k, dtype), "query_id long, vec_id long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose ``vec_id`` is divisible by ``every``."""
    dtype, rows = packing(vectors), materialize(usable(vectors).dropDuplicates(["vec_id", "vec"]))
    count, width = rows.agg(F.count(F.lit(1)), F.max(F.octet_length("vec"))).first()
    width = together(count, signed_axes((width or 8) // np.dtype(dtype).itemsize))
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    dealt = index(rows, dtype, width)
    counts = materialize(dealt.groupBy("t", "part").count())
    sizes = counts.select("t", "part", F.ceil(F.col("count") / BLOCK).cast("long").alias("salts"))
    found = materialize(_top(_search(dealt, probes(queries, dtype, width), sizes, k, dtype), k))
    short = queries.join(found.where(F.col("rank") == k), queries["vec_id"] == found["query_id"], "left_anti")
    if not short.isEmpty():
        every_cell = short.select(F.lit(b"").alias("cells"), F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec"))
        every_cell = every_cell.crossJoin(sizes.where("t = 0").select("t", "part"))
        more = _search(dealt.where("t = 0"), every_cell, sizes, k, dtype)
        found = materialize(_top(found.select("query_id", "vec_id", "score").union(more), k))
    return found.select("query_id", "rank", "vec_id", "score")


def op3(vectors: DataFrame) -> DataFrame:
    return search(vectors)
