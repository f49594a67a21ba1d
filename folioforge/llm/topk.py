"""Exact top-k by inner product: columnar branch and bound over blocks of dimensions.

Candidates lie in blocks in vertical layout (one array per dimension). Scores accumulate block of dimensions by
block of dimensions; before each next one, what the remaining dimensions can still add is bounded by the product of
the remaining lengths of both vectors (Cauchy-Schwarz), and candidates whose bound stays under the k-th best score
so far are compacted away. Both sides are packed into blocks of bounded size; blocks of queries and of candidates meet
in the cells of a grid, each a task that holds its queries and takes candidates block by block. Nothing goes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cluster import map_arrow
from .common import materialize, table

#: Queries in a cell of the grid, about, and candidates in a block, at most.
QUERY_BLOCK = 8192
CANDIDATE_BLOCK = 8192
#: Bytes in a packed block, at most (one vector at least).
BLOCK_BYTES = 1 << 24
#: Queries whose first partial scores are made at a time.
TILE = 256
DIMS_BLOCK = 16
PACKED = "kind int, dim int, n int, ids binary, data binary"
LARGEST = np.iinfo(np.int64).max


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite


def _rows(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors of an Arrow list column by their length: (row numbers, matrix of doubles)."""
    sizes = np.diff(column.offsets.to_numpy())
    flat, starts, out = column.values.to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()[:-1], {}
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        out[int(n)] = (at, flat[starts[at][:, None] + np.arange(n)])
    return out


def _floor(m: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(scale * m)


def search_block(queries: np.ndarray, query_ids: np.ndarray, cands: np.ndarray, cand_ids: np.ndarray, k: int, best: list | None = None, dims: int = DIMS_BLOCK) -> list[tuple[np.ndarray, np.ndarray]]:
    """The best (scores, ids) of each query among `cands` and what `best` already has; both matrices hold integers.

    Ids equal to the query's own are left out. Scores are exact while they stay under 2^53 in absolute value;
    larger magnitudes go through Python integers, without pruning, and are held to the range of a long.
    """
    n, d = cands.shape
    best = best or [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
    if not n:
        return best
    if d and np.abs(cands).max(initial=0) * np.abs(queries).max(initial=0) * d >= 2.0**52:
        table_ = [[int(x) for x in row] for row in cands]
        out = []
        for q, qid, (s0, i0) in zip(queries, query_ids, best, strict=True):
            q = [int(x) for x in q]
            s = np.array([max(-LARGEST - 1, min(LARGEST, sum(a * b for a, b in zip(q, row, strict=True)))) for row in table_], np.int64)
            out.append(_merge(s0, i0, s[cand_ids != qid], cand_ids[cand_ids != qid], k))
        return out
    columns = np.ascontiguousarray(cands.T)
    edges = [*range(0, d, dims), d] if d else [0, 0]
    rest_c = [np.sqrt((columns[e:] ** 2).sum(0)) for e in edges]
    out = []
    for t in range(0, len(queries), TILE):
        tile, held = queries[t : t + TILE], best[t : t + TILE]
        near = np.arange(n)
        if all(len(s0) == k for s0, _ in held):  # what no query of the tile can use is left out before any product
            near = np.flatnonzero(np.sqrt((tile**2).sum(1)).max() * rest_c[0] * (1 + 1e-9) + 1e-3 >= min(s0[-1] for s0, _ in held))
        first = tile[:, : edges[1]] @ columns[: edges[1], near]
        for q, qid, (s0, i0), part in zip(tile, query_ids[t : t + TILE], held, first, strict=True):
            other = cand_ids[near] != qid
            alive, part = near[other], part[other]
            floor = s0[-1] if len(s0) == k else None
            for b in range(1, len(edges) - 1):
                left = np.sqrt((q[edges[b] :] ** 2).sum()) * rest_c[b][alive]
                if len(alive) > k:
                    low = np.partition(part - left, len(alive) - k)[len(alive) - k]
                    floor = low if floor is None else max(floor, low)
                if floor is not None:
                    stay = part + left * (1 + 1e-9) + 1e-3 >= floor
                    alive, part = alive[stay], part[stay]
                part = part + q[edges[b] : edges[b + 1]] @ columns[edges[b] : edges[b + 1], alive]
            out.append(_merge(s0, i0, part.astype(np.int64), cand_ids[alive], k))
    return out


def _merge(s0: np.ndarray, i0: np.ndarray, s: np.ndarray, i: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(s) > k:  # ties with the k-th stay for the ids to decide
        keep = s >= np.partition(s, len(s) - k)[len(s) - k]
        s, i = s[keep], i[keep]
    s, i = np.concatenate([s0, s]), np.concatenate([i0, i])
    order = np.lexsort((i, -s))[:k]
    return s[order], i[order]


def _pack(rows: DataFrame, kind: int, scale: int, most: int) -> DataFrame:
    """PACKED rows: blocks of vectors of one length, as integers in 32-bit floats where these hold them, else in 64-bit ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for n, (at, m) in _rows(b.column(1)).items():
                m = _floor(m, scale)
                size = max(1, min(most, BLOCK_BYTES // max(1, 8 * n)))
                for k in range(0, len(at), size):
                    part = m[k : k + size]
                    part = part.astype(np.float32) if np.abs(part).max(initial=0) < 2**24 else part
                    row = (kind, n, len(part), ids[at[k : k + size]].tobytes(), part.tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["kind", "dim", "n", "ids", "data"])

    return map_arrow(rows, run, PACKED)


def _unpack(dim: int, n: int, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    kind = np.float32 if len(data) == 4 * n * dim else np.float64
    return np.frombuffer(ids, np.int64), np.frombuffer(data, kind).astype(np.float64).reshape(n, dim)


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` its k best rows of `vectors` (all, if fewer).

    Components count as floor(scale * x); the score is the integer inner product; ties go to the smaller id. Scores
    beyond the range of a long are held to it, and so tie with each other. Rows whose id equals the query's are its own
    and no candidates. Rows with a null id, a null vector, or a null or non-finite component take no part; vectors of
    another length than the query's are no candidates of it. Rows repeated under one id are candidates each by itself;
    of queries repeated under one id the smallest vector is asked. Other columns are not read. No tables, no rows.
    """
    spark = vectors.sparkSession
    good = usable(F.col(vector_col)) & F.col(id_col).isNotNull()
    candidates = vectors.where(good).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    asked = queries.where(good).groupBy(F.col(id_col).cast("long").alias("vec_id")).agg(F.min(F.col(vector_col).cast("array<double>")).alias("v"))
    asked = materialize(_pack(asked, 0, scale, min(1024, query_block)), "queries")
    candidates = materialize(_pack(candidates, 1, scale, CANDIDATE_BLOCK), "candidates")
    count = F.coalesce(F.sum("n"), F.lit(0))
    down = max(1, -(-asked.agg(count).first()[0] // query_block))
    across = max(1, min(-(-candidates.agg(count).first()[0] // CANDIDATE_BLOCK), max(-(-2 * spark.sparkContext.defaultParallelism // down), 64)))

    def dealt(rows: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        rows = rows.withColumn(own, F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).select("down", "across", *candidates.columns)

    cells = dealt(asked, "down", down, "across", across).unionByName(dealt(candidates, "across", across, "down", down))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, best = None, {}, {}

        def out() -> Iterator[pa.RecordBatch]:
            for n, found in best.items():
                sizes = [len(s) for s, _ in found]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(held[n][0], sizes)), pa.array(np.concatenate([i for _, i in found])), pa.array(np.concatenate([s for s, _ in found]))], ["query_id", "vec_id", "score"])

        for b in batches:
            for i in range(len(b)):
                here, kind, dim, *packed = *((b.column(0)[i].as_py(), b.column(1)[i].as_py()),), *(b.column(c)[i].as_py() for c in range(2, 7))
                if here != cell:
                    yield from out()
                    cell, held, best = here, {}, {}
                ids, m = _unpack(dim, *packed)
                if kind == 0:
                    held[dim] = tuple(np.concatenate([x, y]) for x, y in zip(held[dim], (ids, m), strict=True)) if dim in held else (ids, m)
                elif dim in held:
                    best[dim] = search_block(held[dim][1], held[dim][0], m, ids, k, best.get(dim))
        yield from out()

    found = map_arrow(cells.repartition(down * across, "down", "across").sortWithinPartitions("down", "across", "kind"), run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


OP5_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(generate_series(1, len(a.q)), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 100 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
