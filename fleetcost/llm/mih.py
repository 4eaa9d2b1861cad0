"""Exact top-k search over binary codes by incremental multi-index hashing."""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetcost.llm import blocks

SEGMENTS, BITS = 4, 16
CODE_ROWS = 1 << 20
LEAST = 6           # blocks, so that a small table still uses several tasks; fewer codes in a block mean larger search radii


@lru_cache(maxsize=None)
def _flips(radius: int) -> np.ndarray:
    """All segment patterns with `radius` bits set."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(BITS), radius)], np.int64)


class Index:
    """For each 16-bit segment, the codes in order of its value, and where each value begins."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.codes = ids[order], codes[order]
        parts = self.codes.view(np.uint16).reshape(-1, SEGMENTS)
        self.order = [np.argsort(parts[:, s], kind="stable") for s in range(SEGMENTS)]
        self.begin = [np.searchsorted(parts[o, s], np.arange((1 << BITS) + 1)) for s, o in enumerate(self.order)]

    def search(self, own_id, code: np.uint64, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest (ids, distances), ties by id, without the query's own id.

        Step by step the search radius of one segment grows by one bit. After segment s of round r every code at most
        SEGMENTS * r + s bits away has been met: one further away in each of the first s + 1 segments by over r bits and in the others by
        over r - 1 would differ in more. The search ends when the kth verified distance is not above that.
        """
        value = np.array([code], np.uint64).view(np.uint16).astype(np.int64)
        seen = np.zeros(len(self.codes), bool)
        rows, dist = np.array([], np.int64), np.array([], np.int64)
        for r in range(BITS + 1):
            for s in range(SEGMENTS):
                at = value[s] ^ _flips(r)
                lo, n = self.begin[s][at], self.begin[s][at + 1] - self.begin[s][at]
                lo, n = lo[n > 0], n[n > 0]
                if len(n):
                    found = self.order[s][np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
                    found = found[~seen[found]]
                    seen[found] = True
                    found = found[self.ids[found] != own_id]
                    rows = np.concatenate([rows, found])
                    dist = np.concatenate([dist, np.bitwise_count(self.codes[found] ^ code).astype(np.int64)])
                    if len(rows) > 4 * k:
                        best = np.lexsort((rows, dist))[:k]
                        rows, dist = rows[best], dist[best]
                if len(rows) >= k and np.partition(dist, k - 1)[k - 1] <= SEGMENTS * r + s:
                    break
            else:
                continue
            break
        best = np.lexsort((rows, dist))[:k]
        return self.ids[rows[best]], dist[best]


def sign_code(vector: str) -> F.Column:
    """64 sign bits of a vector column, its first component highest: 1 where it is not negative, 0 also where it is null; null for a null vector. Any other length than 64 is an error."""
    bits = F.aggregate(F.col(vector), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x >= 0, 1).otherwise(0).cast("long")))
    return F.when(F.col(vector).isNull(), None).when(F.size(vector) == SEGMENTS * BITS, bits).otherwise(F.raise_error(F.lit("a vector does not have 64 components")).cast("long"))


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10, code_rows: int = CODE_ROWS) -> DataFrame:
    """query_id, rank, id and distance of the k codes nearest to each query by Hamming distance, ties by id; the query's own id is left out.

    Both tables have id (long) and code (long), other columns are ignored; rows with a null in either are left out, repeated (id, code) rows count once.
    A query gets fewer than k rows only if there are fewer codes. Empty tables give no rows.

    Codes are dealt by a hash of their ids to blocks of about `code_rows` (LEAST blocks at least). A block is shuffled once and its index built once; the queries stream
    through it and are searched exactly, and the best k per query and block meet in one ranking. What a task holds is bounded by the block size, however common one code is.
    """
    codes, queries = (d.select(F.col("id").cast("long"), F.col("code").cast("long")).where("id IS NOT NULL AND code IS NOT NULL") for d in (codes, queries))

    def index(block: pa.Table) -> Index:
        own = block.select(["id", "code"]).to_pandas().drop_duplicates()
        return Index(own["id"].to_numpy(np.int64), own["code"].to_numpy(np.int64).view(np.uint64))

    def answer(built: Index, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = []
        for i, code in zip(part.column("id").to_numpy(), part.column("code").to_numpy()):
            ids, dist = built.search(i, np.int64(code).view(np.uint64), k)
            found.append((np.full(len(ids), i), np.full(len(ids), code), ids, dist))
        yield pa.record_batch({c: np.concatenate(x) for c, x in zip(("query_id", "code", "id", "distance"), zip(*found))})

    n = max(LEAST, -(-codes.count() // code_rows))
    best = blocks.against(codes, queries.distinct(), F.col("id"), n, index, answer, "query_id long, code long, id long, distance long")
    rank = F.row_number().over(Window.partitionBy("query_id", "code").orderBy("distance", "id"))
    return best.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def run(spark, sf_dir: str) -> DataFrame:
    from fleetcost.llm.common import table
    codes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code("embedding").alias("code"))
    return top_k(codes, codes.where("id % 20 = 0")).select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1 ELSE 0 END) AS b FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_sum(list_transform(q.b, lambda x, i: CASE WHEN x <> r.b[i] THEN 1 ELSE 0 END)) AS BIGINT) AS distance
      FROM e AS q JOIN e AS r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank, vec_id, distance FROM p) WHERE rank <= 10"""
