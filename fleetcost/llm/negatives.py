"""Hard-negative mining: rotated one-bit codes with stored alignments, popcount estimates with sure bounds, whole-number scores of what is left."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetcost.llm import blocks
from fleetcost.llm.common import dropped, table, written
from fleetcost.llm.vectors import complete, whole

LEVELS = 6              # one-bit codes of a vector: each codes what the ones before have left
PLANES = 8              # bits of a query's rotated component
BLOCK_ROWS = 1 << 15


def rotated(x: np.ndarray) -> np.ndarray:
    """Rows of whole numbers, turned by fixed signs and a Hadamard matrix: products of rows grow by the length (a power of two) exactly."""
    size = x.shape[1]
    y = x * np.array([1.0 if xxhash.xxh64_intdigest(f"sign {i}") & 1 else -1.0 for i in range(size)])
    half = 1
    while half < size:
        y = y.reshape(len(x), -1, 2, half)
        y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2)
        half *= 2
    return y.reshape(len(x), size)


def _bits(yes: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    return np.packbits(yes, axis=1).view(np.uint64)


class Codes:
    """A block of rows in order of their labels. At each level a row has the signs of its rotated residual (`code`), the alignment of the
    residual with them (`align`: its projection on the signs), and the length of what that leaves (`rest`)."""

    def __init__(self, rows: pa.Table, size: int, scale: int, levels: int = LEVELS):
        ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
        x = whole(rows.column("vector").combine_chunks(), scale, size)
        _, once = np.unique(np.column_stack([labels, ids, x]), axis=0, return_index=True)       # equal rows count once; label, then id
        self.ids, self.labels, self.x = ids[once], labels[once], x[once]
        y = rotated(self.x)
        self.code, self.align, self.rest = [], [], []
        for _ in range(levels):
            yes = y >= 0
            a = np.abs(y).mean(axis=1)
            y -= np.where(yes, 1, -1) * a[:, None]
            self.code.append(_bits(yes))
            self.align.append(a)
            self.rest.append(np.sqrt((y * y).sum(axis=1)))


class Query:
    """A rotated query: its components in steps of a power of two as bit planes, the length, and what the steps leave at most."""

    def __init__(self, x: np.ndarray):
        self.x, y = x, rotated(x[None].astype(np.float64))[0]
        self.size = len(y)
        self.step = 2.0 ** max(0, int(np.ceil(np.log2(max(1.0, np.abs(y).max()) / (2 ** (PLANES - 1) - 1)))))
        u = np.round(y / self.step).astype(np.int64)
        self.left = np.abs(y - u * self.step).sum()
        self.length = np.sqrt((y * y).sum())
        self.sum = u.sum()
        self.planes = [_bits((u + 2 ** (PLANES - 1))[None] >> b & 1)[0] for b in range(PLANES)]
        self.base = 2 ** (PLANES - 1) * self.size

    def product(self, code: np.ndarray) -> np.ndarray:
        """Sum of the stepped components, each with its sign in the code, by popcounts alone."""
        total = np.zeros(len(code), np.int64)
        for b, plane in enumerate(self.planes):
            total += np.bitwise_count(code & plane).sum(axis=1, dtype=np.int64) << b
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        return 2 * (total - (ones << PLANES - 1)) - self.sum


def _bounds(codes: Codes, q: Query, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Lower and upper bounds of the scores of `rows`, tighter at each level; send() the places that stay before the next.

    A rotated row is the sum of its aligned codes and a rest that is at right angles to the last code. By Cauchy and Schwarz the rest adds
    at most its length times the length of the query's part at right angles to that code; the steps of the query add at most
    what they leave, once for each unit of alignment. The margin covers rounding.
    """
    estimate, loose = np.zeros(len(rows)), np.zeros(len(rows))
    for code, align, rest in zip(codes.code, codes.align, codes.rest):
        along = q.product(code[rows]) * q.step
        estimate += align[rows] * along
        loose += align[rows] * q.left
        across = np.sqrt(np.maximum(0, q.length ** 2 - np.maximum(0, np.abs(along) - q.left) ** 2 / q.size))
        far = loose + rest[rows] * across
        far += 1e-9 * (far + np.abs(estimate)) + 1e-3
        keep = yield (estimate - far) / q.size, (estimate + far) / q.size
        rows, estimate, loose = rows[keep], estimate[keep], loose[keep]


def _kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def _narrowed(codes: Codes, q: Query, rows: np.ndarray, stays) -> np.ndarray:
    """The rows that stays(lower, upper, last) leaves at every level."""
    steps = _bounds(codes, q, rows)
    low, high = next(steps)
    for level in range(len(codes.code)):
        keep = stays(low, high, level == len(codes.code) - 1)
        rows = rows[keep]
        if not len(rows):
            break
        try:
            low, high = steps.send(keep)
        except StopIteration:
            break
    return rows


def _first(codes: Codes, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k rows with the highest scores; ties by id, then in the block's order."""
    best = np.lexsort((rows, codes.ids[rows], -scores))[:k]
    return rows[best], scores[best]


def _label_rows(codes: Codes, label: int) -> tuple[int, int]:
    return np.searchsorted(codes.labels, label), np.searchsorted(codes.labels, label, "right")


def _positives(codes: Codes, q: Query, own: int, label: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = _label_rows(codes, label)
    rows = np.arange(a, b)
    rows = rows[codes.ids[rows] != own]
    if not len(rows):
        return rows, rows
    rows = _narrowed(codes, q, rows, lambda low, high, _: high >= _kth(low, k))
    return _first(codes, rows, codes.x[rows] @ q.x, k)


def _negatives(codes: Codes, q: Query, label: int, scores: list[int], k: int, least: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each positive score that can have some (by its number): the k first rows of other labels within its range."""
    a, b = _label_rows(codes, label)
    rows = np.r_[0:a, b:len(codes.ids)]
    ranges = [(least * s / 100, most * s / 100) for s in scores]
    if not len(rows) or not scores:
        return
    floor, roof = min(r[0] for r in ranges), max(r[1] for r in ranges)

    def stays(low, high, last):
        keep = (high >= floor) & (low <= roof)
        if not last and keep.sum() * 4 > len(keep):
            return keep
        out = np.zeros(len(keep), bool)
        for f, r in ranges:
            out |= (high >= f) & (low <= r) & (high >= _kth(low[(low >= f) & (high <= r)], k))
        return keep & out
    rows = _narrowed(codes, q, rows, stays)
    exact = codes.x[rows] @ q.x
    for n, s in enumerate(scores):
        fits = (least * s <= 100 * exact) & (100 * exact <= most * s)
        yield n, *_first(codes, rows[fits], exact[fits], k)


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, scale: int = 256, levels: int = LEVELS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of the hard negatives of each anchor and positive.

    `vectors` has id, label and vector; a row with a null in one of them, or with a component that is null or not finite, takes no part,
    nor do other columns. A component x becomes floor(scale * x), where 2**24 and more is an error; of vectors of different lengths the
    shorter ends in zeros. A row's score is its product with the anchor. Rows go by score, highest first, ties by id (rows that share both, by
    label and vector).
    An anchor (rows for which the condition `anchors` holds) has as positives its first `positives` rows of its label, and for each the
    first `negatives` rows of other labels between `least` and `most` per cent of the positive's score. Rows with the anchor's own id are
    never its positives; equal rows count once; without any such row there is no result row, as for an empty table.

    Rows go to blocks by a hash of their id, each block is indexed where it is gathered, and the anchors stream through all blocks: once for
    the positives, once, with these, for the negatives. A block answers with its first rows, which meet in one ranking per anchor.
    No row is left out by an estimate: only bounds decide, and what they leave is scored in whole numbers.
    """
    rows = vectors.select(F.col("id").cast("long"), F.col("label").cast("long"), "vector").where(F.col("id").isNotNull() & F.col("label").isNotNull() & complete(F.col("vector")))
    n, longest = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    size, count = 1 << max(6, ((longest or 0) - 1).bit_length()), blocks.number(n, block_rows)
    asked = rows.where(anchors).distinct().withColumn("anchor", F.xxhash64("id", "label", "vector"))

    def index(block: pa.Table) -> Codes:
        return Codes(block, size, scale, levels)

    def queries(part: pa.RecordBatch) -> Iterator[tuple[dict, Query]]:
        x = whole(part.column("vector"), scale, size)
        for n, row in enumerate(part.drop_columns(["vector"]).to_pylist()):
            yield row, Query(x[n])

    def near(codes: Codes, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row, q in queries(part):
            at, scores = _positives(codes, q, row["id"], row["label"], positives)
            yield pa.record_batch({"anchor": np.full(len(at), row["anchor"]), "positive_id": codes.ids[at], "score": scores})

    def hard(codes: Codes, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row, q in queries(part):
            for n, at, scores in _negatives(codes, q, row["label"], [p["score"] for p in row["near"]], negatives, least, most):
                p, m = row["near"][n], len(at)
                yield pa.record_batch({"anchor": np.full(m, row["anchor"]), "anchor_id": np.full(m, row["id"]), "place": np.full(m, n, np.int32), "positive_id": np.full(m, p["positive_id"]),
                                       "positive_score": np.full(m, p["score"]), "negative_id": codes.ids[at], "negative_score": scores})

    found = blocks.against(rows, asked, F.col("id"), count, index, near, "anchor long, positive_id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "positive_id"))
    best = found.withColumn("place", place).where(F.col("place") <= positives)
    best = written(best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "score"))).alias("near")))
    pairs = blocks.against(rows, asked.join(best, "anchor"), F.col("id"), count, index, hard,
                           "anchor long, anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long")
    pairs = written(pairs)
    dropped(best)
    rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def run(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector"))
    return mine(vectors, F.col("id") % 100 == 0)


SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, CAST(list_sum(list_transform(a.x, lambda c, i: c * r.x[i])) AS BIGINT) AS score
  FROM e AS a JOIN e AS r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id,
  p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score QUALIFY rank <= 5"""
