"""Exact vector search, with what a reader wants to see of each match, and embeddings that are still missing."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from folioforge.cluster import ship
from folioforge.functions.vectors import dot, l2_normalize

#: Queries that go out to every task as they are; more meet the vectors in cells.
QUERIES_AT_ONCE = 256
#: Cells at least that vectors are dealt to by hash when there are many queries, vectors of a cell and queries of a block at most, about.
CELLS, CELL, BLOCK = 200, 50_000, 4096
#: Decimal places to which similarities are compared when ids of queries are given, so that equal vectors tie however they were summed.
PLACES = 9


def top_matches(query: DataFrame, vectors: DataFrame, *, id_col: str, vector_col: str, k: int, query_id: str | None = None, cells: int = CELLS) -> DataFrame:
    """(id, similarity, rank): the k nearest of `vectors` by cosine; ties by id.

    Without `query_id` the query is one vector, and more are an error; with it every row of `query` is asked, and the result
    has its id first, similarities to PLACES. Queries of the same id are one, the smallest vector; null and zero vectors match
    nothing. A few queries are broadcast; many are dealt to blocks and the vectors to cells, each block meets each cell once, and
    numpy multiplies them piece by piece. Every task keeps its k best of a query before anything else is shuffled.
    """
    if k < 1:
        raise ValueError("k has to be 1 at least")
    n = 1
    if query_id is None:
        if len(query.limit(2).collect()) > 1:
            raise ValueError("several queries need query_id")
        asked = query.select(F.lit(0).alias("_id"), l2_normalize(F.col(vector_col).cast("array<double>")).alias("_q"))
    else:
        asked = query.groupBy(F.col(query_id).alias("_id")).agg(l2_normalize(F.min(F.col(vector_col).cast("array<double>"))).alias("_q"))
        n = asked.count()
    held = vectors.select(F.col(id_col).alias("_vid"), l2_normalize(F.col(vector_col).cast("array<double>")).alias("_v"))  # norms once, not for each pair
    if n <= QUERIES_AT_ONCE:
        score = dot(F.col("_v"), F.col("_q"))
        scored = held.crossJoin(F.broadcast(asked)).select("_id", "_vid", F.when(F.size("_v") == F.size("_q"), score if query_id is None else F.round(score, PLACES)).alias("similarity")).where("similarity IS NOT NULL")
    else:
        ship(query.sparkSession)
        cells, blocks = max(cells, -(-vectors.count() // CELL)), -(-n // BLOCK)
        copies = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        place = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
        on = ("_cell", "_block", "_n")  # vectors of another length than the query's never meet it
        v = held.where("_v IS NOT NULL").select("_vid", "_v", F.size("_v").alias("_n"), place("_vid", cells).alias("_cell"), copies(blocks).alias("_block"))
        q = asked.where("_q IS NOT NULL").select("_id", "_q", F.size("_q").alias("_n"), place("_id", blocks).alias("_block"), copies(cells).alias("_cell"))
        kind = StructType([StructField("_id", asked.schema["_id"].dataType), StructField("_vid", held.schema["_vid"].dataType), StructField("similarity", DoubleType())])
        scored = v.groupBy(*on).cogroup(q.groupBy(*on)).applyInArrow(best_of_cell(k), kind)
    rank = F.row_number().over(Window.partitionBy("_id").orderBy(F.desc("similarity"), "_vid"))
    out = scored.withColumn("rank", rank).where(F.col("rank") <= k)
    best = (F.col("_vid").alias(id_col), "similarity", "rank")
    return out.select(*best) if query_id is None else out.select(F.col("_id").alias("query_id"), *best)


def best_of_cell(k: int):
    """A function of a cell's vectors (_vid, _v) and a block's queries (_id, _q), all of one length: (_id, _vid, similarity), k a query."""

    def firsts(r: np.ndarray, c: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((c, -s, r))
        r, c, s = r[order], c[order], s[order]
        kept = np.arange(len(r)) - np.searchsorted(r, r) < k
        return r[kept], c[kept], s[kept]

    def matrix(t: pa.Table, c: str) -> np.ndarray:
        return pa.concat_arrays(t[c].chunks).flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)

    def best(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found = [(np.array([], int), np.array([], int), np.array([]))]
        if vectors.num_rows and queries.num_rows:
            vectors = vectors.sort_by("_vid")  # so that a place stands for its id
            v, q = matrix(vectors, "_v"), matrix(queries, "_q")
            for i in range(0, len(q), 1024):
                part = []
                for j in range(0, len(v), 4096):
                    s = np.round(q[i : i + 1024] @ v[j : j + 4096].T, PLACES) + 0.0
                    least = np.partition(s, -k, axis=1)[:, -k:].min(axis=1) if s.shape[1] > k else np.full(len(s), -np.inf)
                    r, c = np.nonzero(s >= least[:, None])
                    part.append(firsts(r + i, c + j, s[r, c]))
                found.append(firsts(*(np.concatenate(x) for x in zip(*part, strict=True))))
        r, c, s = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"_id": queries["_id"].take(pa.array(r)), "_vid": vectors["_vid"].take(pa.array(c)), "similarity": pa.array(s)})

    return best


def without_embedding(docs: DataFrame, vectors: DataFrame, *, doc: str, vec: str) -> DataFrame:
    """`docs` that no row of `vectors` names; a null name has no vector, repeated rows stay, an empty table leaves all."""
    return docs.join(vectors.select(F.col(vec).alias(doc)), doc, "left_anti")


def backfilled(profiles: DataFrame, vectors: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(all vectors, new ones): those of `vectors` (doc_id, vector), and what `embed` makes of profiles that have none.

    `embed` takes profiles and gives (doc_id, vector); the new ones are the caller's to append to the stored table.
    """
    new = embed(without_embedding(profiles, vectors, doc="doc_id", vec="doc_id")).select("doc_id", "vector")
    return vectors.select("doc_id", "vector").unionByName(new), new


def search_results(query: DataFrame, profiles: DataFrame, vectors: DataFrame, *, k: int) -> DataFrame:
    """(rank, doc_id, candidate_name, similarity, top_skills) for the one vector of `query` (vector): unknown names said so, five skills."""
    best = top_matches(query, vectors, id_col="doc_id", vector_col="vector", k=k)
    name = F.coalesce(F.nullif("candidate_name", F.lit("")), F.lit("Unknown candidate"))
    shown = F.slice(F.transform("skills", lambda s: s["canonical_name"]), 1, 5)
    return F.broadcast(best).join(profiles.select("doc_id", name.alias("candidate_name"), shown.alias("top_skills")), "doc_id").select("rank", "doc_id", "candidate_name", "similarity", "top_skills")
