"""Centroid clustering: dimension blocks as codes into dictionaries of distinct subvectors, exact distances per dictionary entry and round."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcost.llm.common import table, written
from fleetcost.llm.vectors import complete, whole

WIDTH = 2           # components of a subvector
ROWS = 1 << 14      # vectors that share their dictionaries; codes have 16 bits, so at most 2**16


def _numbered(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a few columns, and the number of each row among them."""
    key = np.zeros(len(part), np.int64)
    for column in part.T:
        low = column.min()
        key = np.unique(key, return_inverse=True)[1] * (column.max() - low + 1) + (column - low)
    _, first, code = np.unique(key, return_index=True, return_inverse=True)
    return part[first], code.astype(np.uint16)


def encoded(vectors: DataFrame, scale: int, size: int, width: int = WIDTH, rows: int = ROWS) -> DataFrame:
    """A row per chunk of at most `rows` vectors (id, vector): ids; for each block of `width` dimensions its distinct subvectors (`entries`, of
    which `sizes` belong to each block) and one code per vector. Nothing is lost, no key is shuffled, and a vector that a third of all rows
    share costs one dictionary entry per block and chunk."""
    def pack(ids: list, found: list) -> pa.RecordBatch:
        x = np.concatenate(found)
        parts = [_numbered(x[:, b:b + width]) for b in range(0, size, width)]
        one = lambda values, kind: pa.array([values.tobytes()], kind)
        entries = np.concatenate([d.ravel() for d, _ in parts]).astype(np.int32)
        return pa.record_batch({"ids": pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.concat_arrays(ids)), "entries": one(entries, pa.binary()),
                                "sizes": one(np.array([len(d) for d, _ in parts], np.int32), pa.binary()), "codes": one(np.stack([c for _, c in parts]), pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, n = [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                if n + part.num_rows > rows:
                    yield pack(ids, found)
                    ids, found, n = [], [], 0
                if part.num_rows:
                    ids.append(part.column("id").cast(pa.int64()))
                    found.append(whole(part.column("vector"), scale, size))
                    n += part.num_rows
        if n:
            yield pack(ids, found)
    return vectors.select(F.col("id").cast("long"), "vector").mapInArrow(run, "ids array<long>, entries binary, sizes binary, codes binary")


def _chunks(batches: Iterator[pa.RecordBatch], size: int, width: int) -> Iterator[tuple[pa.Array, list[np.ndarray], np.ndarray]]:
    """ids, dictionaries and codes (a row per block) of each chunk."""
    for batch in batches:
        for n in range(batch.num_rows):
            of = lambda name, kind: np.frombuffer(batch.column(name)[n].as_py(), kind)  # noqa: E731, B023
            sizes, entries = of("sizes", np.int32), of("entries", np.int32).astype(np.int64)
            spans = [min(width, size - b) for b in range(0, size, width)]
            ends = np.cumsum(sizes * spans)
            books = [entries[e - k * w:e].reshape(k, w) for e, k, w in zip(ends, sizes, spans)]
            yield batch.column("ids")[n].values, books, of("codes", np.uint16).reshape(len(sizes), -1)


def _nearest(books: list[np.ndarray], codes: np.ndarray, centroids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Cluster (ties: the smaller number) and squared distance of each vector: each dictionary entry's distances to all centroids are
    computed once, a vector adds up those of its codes."""
    total = np.zeros((codes.shape[1], len(centroids)), np.int64)
    for b, (book, code) in enumerate(zip(books, codes)):
        far = book[:, None, :] - centroids[None, :, b * width:b * width + book.shape[1]]
        total += (far * far).sum(axis=2)[code]
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(total)), cluster]


def _sums(chunks: DataFrame, centroids: np.ndarray, width: int) -> dict[tuple[int, int], int]:
    """Sum of each component (place 0, 1, ...) and count (place -1) of each cluster's vectors: k * (size + 1) numbers per task, then in all."""
    size = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), size + 1), np.int64)
        for _, books, codes in _chunks(batches, size, width):
            cluster, _ = _nearest(books, codes, centroids, width)
            total[:, size] += np.bincount(cluster, minlength=len(centroids))
            for b, (book, code) in enumerate(zip(books, codes)):
                times = np.bincount(cluster * len(book) + code, minlength=len(centroids) * len(book)).reshape(len(centroids), -1)
                total[:, b * width:b * width + book.shape[1]] += times @ book
        c, p = np.nonzero(total)
        yield pa.record_batch({"cluster": c.astype(np.int32), "place": np.where(p == size, -1, p).astype(np.int32), "total": total[c, p]})
    rows = chunks.mapInArrow(run, "cluster int, place int, total long").groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect()
    return {(r["cluster"], r["place"]): r["total"] for r in rows}


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, size: int = 64, seed: int = 1, width: int = WIDTH, rows: int = ROWS) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector (id, vector) that is kept.

    Kept are vectors with exactly `size` components, none null or not finite; each component x becomes floor(scale * x), where 2**24 and
    more is an error. The first centroids are the k vectors with the smallest sha256 of `seed:id`, in that order (equal ids: by vector; a
    null id comes last); fewer vectors make fewer centroids. A round assigns every vector to the nearest centroid and moves each centroid
    that has vectors to their componentwise floored mean; others stay. Repeated rows are kept and count each time, also as first
    centroids. Other columns are ignored; an empty table gives no rows.

    Vectors are read once and written as coded chunks; each round is one pass over these and returns k * (size + 1) numbers to the driver.
    Only the centroids travel to the tasks. All arithmetic is in whole numbers, so results do not depend on the order of rows.
    """
    kept = vectors.select("id", "vector").where(complete(F.col("vector")) & (F.size("vector") == size))
    chunks = written(encoded(kept, scale, size, width, rows))
    first = kept.withColumn("draw", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)).orderBy(F.asc_nulls_last("draw"), "vector").limit(k).select("vector").collect()
    centroids = np.floor(np.array([r["vector"] for r in first], np.float64).reshape(-1, size) * scale).astype(np.int64)
    for _ in range(rounds if len(first) else 0):
        total = _sums(chunks, centroids, width)
        centroids = np.array([[total.get((c, p), 0) // total[c, -1] for p in range(size)] if (c, -1) in total else own for c, own in enumerate(centroids.tolist())], np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, books, codes in _chunks(batches, size, width):
            number, distance = _nearest(books, codes, centroids, width)
            yield pa.record_batch({"id": ids, "cluster": number.astype(np.int32), "distance": distance})
    assigned = written(chunks.mapInArrow(assign, "id long, cluster int, distance long"))
    inertia = {r["cluster"]: r["n"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()
    of = vectors.sparkSession.createDataFrame([(c, n, sum(inertia.values()), digest(c)) for c, n in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(of, "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def run(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return cluster(vectors).withColumnRenamed("id", "vec_id")


def _sql(k: int = 16, rounds: int = 3) -> str:
    def nearest(n: int) -> str:
        return f"""a{n} AS (SELECT vec_id, x, (arg_min({{'c': c, 'd': d}}, d * {k} + c)).c AS c, min(d) AS d
  FROM (SELECT v.vec_id, v.x, c.c, CAST(list_sum(list_transform(v.x, lambda a, i: (a - c.x[i]) * (a - c.x[i]))) AS BIGINT) AS d FROM v, c{n} AS c) GROUP BY vec_id, x)"""

    def moved(n: int) -> str:
        return f"""c{n + 1} AS (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{n} AS c LEFT JOIN (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x
  FROM (SELECT c, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{n}, range(1, 65) AS r(i) GROUP BY c, i) GROUP BY c) AS m USING (c))"""
    steps = [step for n in range(rounds) for step in (nearest(n), moved(n))] + [nearest(rounds)]
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: isfinite(e))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, x FROM v QUALIFY c < {k}),
{", ".join(steps)}
SELECT a.vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m.x, ',')) AS centroid_sha256 FROM a{rounds} AS a JOIN c{rounds} AS m USING (c)"""


SQL = _sql()
