"""A stated set of queries against all rows, in blocks: each block of rows is gathered and indexed once, the queries stream through it."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 16          # blocks, so that a small table still uses several tasks


def number(rows: int, block_rows: int) -> int:
    """Blocks of about `block_rows` rows each."""
    return max(LEAST, -(-rows // block_rows))


def against(rows: DataFrame, queries: DataFrame, key: Column, blocks: int, index: Callable, answer: Callable, schema: str) -> DataFrame:
    """answer(index(block of rows), batch of queries) for each block and each batch of queries.

    Rows go to a block by a hash of `key`, so a row that occurs twice is in one block; every row is shuffled once and every query once per
    block. Both functions take Arrow record batches (index: a table) with the columns of `rows` and `queries`; a column that only one side
    has is null on the other. What a task holds is one block and one batch of queries. A block without queries is not indexed.
    """
    own = rows.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).withColumn("query", F.lit(False))
    asked = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("query", F.lit(True))
    both = own.unionByName(asked, allowMissingColumns=True).repartition(blocks, "block").sortWithinPartitions("block", "query")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block, built = [], None, None
        for batch in batches:
            for part in _runs(batch):
                at, asks = part.column("block")[0].as_py(), part.column("query")[0].as_py()
                if at != block:
                    held, block, built = [], at, None
                if not asks:
                    held.append(part)
                elif held or built is not None:
                    if built is None:
                        built, held = index(pa.Table.from_batches(held)), []
                    yield from answer(built, part)
    return both.mapInArrow(run, schema)


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The parts of a sorted batch that belong to one block and one side."""
    block, query = batch.column("block").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False)
    begin = 0
    for n in range(1, len(block) + 1):
        if n == len(block) or block[n] != block[begin] or query[n] != query[begin]:
            yield batch.slice(begin, n - begin)
            begin = n
