"""Suffix-array dedup: byte windows that also start elsewhere, from earlier matches in suffix order."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcost.llm.common import slices
from fleetcost.llm.windows import GROUP, LAST, Bytes, Kind, covered, extremes, merged_spans, prefix_ranks, rolling, window_starts


def previous_smaller(position: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each entry in suffix order: its longest common prefix with the nearest entry before it whose position is smaller, 0 without one. lcp[i] is that of i and i - 1.

    Every entry looks at the one before it and, while that is not smaller, jumps to where that one looks, all at once: whatever lies between is not smaller either. The
    prefix is the smallest on the way; an entry stops where that is 0. This is the stack of the linear algorithm, followed by all entries together."""
    best = lcp.copy()
    best[:1] = 0
    at = np.arange(-1, len(position) - 1)
    live = np.flatnonzero(best)
    live = live[position[live - 1] >= position[live]]
    while len(live):
        to = at[live]
        best[live], at[live] = np.minimum(best[live], best[to]), at[to]
        live = live[best[live] > 0]
        live = live[position[at[live]] >= position[live]]
    return best


def longest_previous(position: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Longest previous factor of each entry in suffix order: the longer of its common prefixes with the previous and the next entry of a smaller position."""
    back = np.concatenate([lcp[:1], lcp[:0:-1]])
    return np.maximum(previous_smaller(position, lcp), previous_smaller(position[::-1], back)[::-1])


class SuffixMatch:
    """Longest-previous-factor array over a suffix array of one shard.

    Windows are put in suffix order by their first `size` bytes. Of the common prefix of neighbours only matters whether it reaches `size`, so it is `size` or 0. Positions are
    numbered by (id, text, place). A window also starts earlier if its longest previous factor is `size`; those count with keep_first. Else all windows of a content count of
    which one also starts earlier, or whose unit occurs more than once.
    """

    def __init__(self, kind: Kind, keep_first: bool):
        self.kind, self.keep_first = kind, keep_first

    def whole(self, own: Column, first: Column, n: Column) -> Column:
        return own != first if self.keep_first else n > 1

    def length(self, ctx: str) -> Column:
        return F.length(ctx)

    def __call__(self, units: pd.DataFrame) -> pd.DataFrame:
        size = self.kind.size
        units = units.drop_duplicates(["g", "c"]).reset_index(drop=True)
        owner, _, place = window_starts(units, units["ctx"].str.len().to_numpy(np.int64), size)
        h = rolling(Bytes.values(b"".join(units["ctx"])), size)[place]      # units without a window like another's need no suffix array
        s = np.sort(h)
        again = s[1:][s[1:] == s[:-1]]
        hit = again[np.minimum(np.searchsorted(again, h), len(again) - 1)] == h if len(again) else np.zeros(len(h), bool)
        keep = np.zeros(len(units), bool)
        keep[owner[hit]] = True
        units = units[keep].reset_index(drop=True)
        if not len(units):
            return extremes(units, np.array([], int), *[np.array([], int)] * 2)
        text = np.frombuffer(b"".join(units["ctx"]), np.uint8).astype(np.uint64)
        padded = np.concatenate([text, np.zeros(4, np.uint64)])
        head = sum(padded[k:k + len(text)] << np.uint64(8 * (4 - k)) for k in range(5))
        *_, (_, rank) = prefix_ranks(head, 5, size)
        owner, start, place = window_starts(units, units["ctx"].str.len().to_numpy(np.int64), size)
        doc = units.groupby(["id", "th"]).ngroup().to_numpy(np.int64)
        position = doc[owner] << 32 | (units["pos"].to_numpy(np.int64)[owner] + start)
        order = (np.sort(rank[place] << np.uint64(21) | np.arange(len(place), dtype=np.uint64)) & np.uint64((1 << 21) - 1)).astype(np.int64)
        ranked = rank[place][order]
        lcp = np.where(np.r_[False, ranked[1:] == ranked[:-1]], np.int32(size), np.int32(0))
        found = longest_previous(position[order], lcp) >= size
        if not self.keep_first:
            run = np.flatnonzero(lcp < size)
            found |= (units["n"].to_numpy() > 1)[owner][order]
            found = np.repeat(np.maximum.reduceat(found, run), np.diff(np.r_[run, len(order)]))
        hit = np.empty(len(order), bool)
        hit[order] = found
        return extremes(units, owner[hit], start[hit], start[hit] + size)


def dedup(docs: DataFrame, size: int = 200, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """id, n_bytes, spans (start, end of the removed bytes, sorted, apart) and kept (the other bytes) of every document.

    Removed is each byte covered by a `size`-byte string of one document that also starts elsewhere, the same document included, judged
    on the input: with keep_first only if it starts earlier, in order of id, hash of the text and place, else wherever it starts. A cut
    can fall inside a UTF-8 character, so kept is binary. Texts are read whole; a null text is empty and keeps its row. A null id comes
    after all others. Equal rows are copies of each other; with keep_first the rows of one id and text count as one document, so they
    are treated alike. Other columns are ignored; an empty table gives no rows.
    """
    kind = Kind(Bytes, size, min(96, size // 2))
    texts, spans = covered(docs, kind, SuffixMatch(kind, keep_first), id_col, text_col, group)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for b in slices(batches):
            rows = []
            for i, z, s in zip(b["id"], b["z"], b["spans"]):
                data = unpack.decompress(z) if z else b""
                gone = merged_spans(s, len(data))
                ends = [0, *[e for _, e in gone]], [*[a for a, _ in gone], len(data)]
                rows.append((i, len(data), [{"start": a, "end": e} for a, e in gone], b"".join(data[a:e] for a, e in zip(*ends))))
            yield pd.DataFrame(rows, columns=["id", "n_bytes", "spans", "kept"])

    out = texts.join(spans, ["id", "th"], "left").mapInPandas(cut, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return out.select(F.when(F.col("id") != LAST, F.col("id")).alias(id_col), "n_bytes", "spans", "kept")


def run(spark, sf_dir: str) -> DataFrame:
    from fleetcost.llm.common import table
    out = dedup(table(spark, sf_dir, "documents"), keep_first=False)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
