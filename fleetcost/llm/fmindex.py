"""Substring dedup: a compressed FM-index per shard gives matching statistics of streamed documents against smaller ids."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcost.llm.common import slices
from fleetcost.llm.windows import GROUP, LAST, Kind, Words, carried, covered, extremes, merged_spans, prefix_ranks, rolling, window_starts

class Minimum:
    """Smallest value of any range, from a table of ranges of 1, 2, 4, ... values."""

    def __init__(self, values: np.ndarray):
        self.table = [values]
        while 2 << (len(self.table) - 1) <= len(values):
            t, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(t[:-half], t[half:]))
        self.flat = np.concatenate(self.table)
        ends = np.cumsum([len(t) for t in self.table])
        self.begin = ends - [len(t) for t in self.table]
        self.table = [self.flat[a:b] for a, b in zip(self.begin, ends)]

    def of(self, l: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Minimum over [l, r), which must not be empty."""
        k = np.frexp((r - l).astype(np.float64))[1] - 1
        return np.minimum(self.flat[self.begin[k] + l], self.flat[self.begin[k] + r - (1 << k)])


class Wavelet:
    """Wavelet matrix: a bit plane per bit of the symbols, packed, with a count before each 64 bits."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.planes = []
        for bit in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            one = (seq >> bit & 1).astype(bool)
            packed = np.packbits(np.concatenate([one, np.zeros(128 - len(one) % 64, bool)]), bitorder="little").view(np.uint64)
            count = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.planes.append((bit, packed, count, len(one) - int(one.sum())))
            seq = np.concatenate([seq[~one], seq[one]])

    def walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the prefix of length `at` ends among the symbol's occurrences, after the last plane."""
        for bit, packed, count, zeros in self.planes:
            word = at >> 6
            ones = count[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbol >> bit & 1, zeros + ones, at - ones)
        return at


class FMIndex:
    """Backward search over a text of symbols 0 <= x < symbols, with LCP values for the way back, and an owner per position. Suffixes are sorted by their first `depth`
    symbols, so no longer pattern may be searched."""

    def __init__(self, text: np.ndarray, symbols: int, owner: np.ndarray, depth: int):
        self.n = len(text)
        nxt = np.concatenate([text[1:], [0]]).astype(np.uint64)
        ranks = [(1, text.astype(np.uint64) + np.uint64(1)), *prefix_ranks(text.astype(np.uint64) << np.uint64(21) | nxt, 2, max(2, depth))]
        rank = ranks[-1][1]
        order = (np.sort(rank << np.uint64(21) | np.arange(self.n, dtype=np.uint64)) & np.uint64((1 << 21) - 1)).astype(np.int64)
        self.wavelet = Wavelet(text[order - 1], symbols)
        every = np.arange(symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])[:symbols] - self.wavelet.walk(every, np.zeros(symbols, np.int64))
        self.owner = Minimum(owner[order].astype(np.int32))
        limit = max(2, depth)
        a, b, lcp = order[:-1].copy(), order[1:].copy(), np.zeros(self.n - 1, np.int64)
        for depth, r in reversed(ranks):
            r = np.concatenate([r, np.zeros(limit * 2 + 2, np.uint64)])
            same = (r[a] == r[b]) & (r[a] > 0) & (np.maximum(a, b) + depth <= self.n) & (lcp + depth < 2 * limit)
            lcp[same] += depth
            a, b = a + same * depth, b + same * depth
        self.lcp = Minimum(np.minimum(np.concatenate([[0], lcp, [0]]), 2 * limit).astype(np.int32))     # lcp[x]: of rows x - 1 and x

    def extend(self, l: np.ndarray, r: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that begin with the symbol followed by what the rows [l, r) begin with."""
        both = self.wavelet.walk(np.concatenate([symbol, symbol]), np.concatenate([l, r])) + np.concatenate([self.before[symbol]] * 2)
        return both[:len(l)], both[len(l):]

    def shorten(self, l: np.ndarray, r: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows that share their first `depth` symbols with the rows [l, r)."""
        for k in range(len(self.lcp.table) - 1, -1, -1):
            t, step = self.lcp.table[k], 1 << k
            at = l - step + 1
            l = np.where((at >= 0) & (t[np.clip(at, 0, len(t) - 1)] >= depth), l - step, l)
            r = np.where((r + step <= self.n + 1) & (t[np.clip(r, 0, len(t) - 1)] >= depth), r + step, r)
        return l, r


class FMMatch:
    """Matching statistics of each unit against text of smaller ids, by backward search in the FM-index of the shard."""

    def __init__(self, kind: Kind):
        self.kind = kind

    def whole(self, own: Column, first: Column, n: Column) -> Column:
        return own.getField("id") > first.getField("id")

    def length(self, ctx: str) -> Column:
        return F.size(F.split(F.col(ctx).cast("string"), " "))

    def __call__(self, units: pd.DataFrame) -> pd.DataFrame:
        size = self.kind.size
        units = units.drop_duplicates(["g", "c"]).reset_index(drop=True)
        none = extremes(units, np.array([], int), *[np.array([], int)] * 2)
        split = [c.split(b" ") for c in units["ctx"]]
        ident = np.unique(units["id"], return_inverse=True)[1]
        owner, start, place = window_starts(units, np.fromiter(map(len, split), np.int64, len(split)), size)
        if not len(owner):
            return none
        h = rolling(Words.values([w for s in split for w in s]), size)[place]      # windows unlike all others are not searched
        order = np.argsort(h)
        run = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
        n = np.diff(np.r_[run, len(h)])
        least, most = (f.reduceat(ident[owner][order], run) for f in (np.minimum, np.maximum))
        shared, later = np.empty(len(h), bool), np.empty(len(h), bool)
        shared[order], later[order] = np.repeat(least != most, n), ident[owner][order] > np.repeat(least, n)
        keep = np.zeros(len(units), bool)
        keep[owner[shared]] = True
        if not later.any():
            return none
        left, right = np.full(len(units), np.iinfo(np.int64).max), np.full(len(units), -1)
        inside = start - units["base"].to_numpy(np.int64)[owner]
        np.minimum.at(left, owner[later], inside[later])
        np.maximum.at(right, owner[later], inside[later] + size)
        rows = np.flatnonzero(keep)
        names: dict[bytes, int] = {}
        ids = [np.fromiter((names.setdefault(w, len(names) + 2) for w in split[j]), np.int64, len(split[j])) for j in rows]
        text = np.concatenate([x for s in ids for x in (s, [1])] + [[0]]).astype(np.int64)      # 1 ends a unit, 0 ends the text
        length = np.fromiter(map(len, ids), np.int64, len(ids)) + 1
        begin = np.cumsum(length) - length
        index = FMIndex(text, len(names) + 2, np.append(np.repeat(ident[rows], length), len(units)), self.kind.size + self.kind.reach)
        some = np.flatnonzero(right[rows] >= 0)
        low, e = begin[some] + left[rows][some], begin[some] + right[rows][some]
        me = ident[rows][some]
        i, l, r = e.copy(), np.zeros(len(some), np.int64), np.full(len(some), index.n)
        best_a, best_b = np.full(len(some), np.iinfo(np.int64).max), np.full(len(some), -1)
        live = np.arange(len(some))
        while len(live):
            nl, nr = index.extend(l[live], r[live], text[i[live] - 1])
            ok = nr > nl
            ok[ok] = index.owner.of(nl[ok], nr[ok]) < me[live][ok]
            go = live[ok]
            i[go], l[go], r[go] = i[go] - 1, nl[ok], nr[ok]
            long = go[e[go] - i[go] >= size]
            best_a[long], best_b[long] = np.minimum(best_a[long], i[long]), np.maximum(best_b[long], e[long])
            stuck = live[~ok]
            empty = stuck[e[stuck] == i[stuck]]
            i[empty] -= 1
            e[stuck] -= 1
            fresh = stuck[e[stuck] <= i[stuck]]
            l[fresh], r[fresh] = 0, index.n
            cut = stuck[e[stuck] > i[stuck]]
            l[cut], r[cut] = index.shorten(l[cut], r[cut], e[cut] - i[cut])
            live = live[(i[live] > low[live]) & (e[live] - low[live] >= size)]
        done = best_b >= 0
        own = rows[some][done]
        shift = units["base"].to_numpy(np.int64)[own] - begin[some][done]
        return extremes(units, own, best_a[done] + shift, best_b[done] + shift)


def dedup(docs: DataFrame, size: int = 50, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, keep_form: bool = False,
          carry: tuple[str, ...] = ()) -> DataFrame:
    """id, n_words, spans (start, end in words of what is removed, sorted, apart), kept (the other words, joined by a space; with keep_form
    an uncut text as it is, null included) and the columns named in `carry` of every row.

    Removed is each word covered by a window of `size` consecutive words whose sequence also starts in a document with a smaller id,
    judged on the input. Words are runs of anything but space and the controls 9 to 13, unchanged, of the whole text; a null or empty
    text has none and keeps its row. A null id counts as larger than any other. Repeated rows are treated alike; what repeats within
    one id stays. Other columns are ignored; an empty table gives no rows.
    """
    kind = Kind(Words, size, max(1, size * 3 // 5), 1_500_000)
    texts, spans = covered(docs, kind, FMMatch(kind), id_col, text_col, group, carry)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for b in slices(batches):
            rows = []
            for z, s in zip(b["z"], b["spans"]):
                data = None if z is None else unpack.decompress(z)
                words = Words.symbols(data or b"")
                gone = merged_spans(s, len(words))
                ends = [0, *[e for _, e in gone]], [*[a for a, _ in gone], len(words)]
                kept = data if keep_form and not gone else b" ".join(w for a, e in zip(*ends) for w in words[a:e])
                rows.append((len(words), [{"start": a, "end": e} for a, e in gone], None if kept is None else kept.decode("utf-8", "replace")))
            yield b.drop(columns=["th", "z", "spans"]).join(pd.DataFrame(rows, columns=["n_words", "gone", "kept"], index=b.index))

    _, kinds = carried(docs, carry)
    out = texts.join(spans, ["id", "th"], "left").mapInPandas(cut, f"id long, n_words long, gone array<struct<start:long,end:long>>, kept string{kinds}")
    return out.select(F.when(F.col("id") != LAST, F.col("id")).alias(id_col), "n_words", F.col("gone").alias("spans"), "kept", *[F.col(f"k{n}").alias(c) for n, c in enumerate(carry)])


def run(spark, sf_dir: str) -> DataFrame:
    from fleetcost.llm.common import table
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x.end - x.start)
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS m FROM g) WHERE m < doc_id),
c AS (SELECT DISTINCT doc_id, i + o AS i FROM r, (SELECT unnest(range(0, 50)) AS o)),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
s AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept, count(*) AS n FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.i = c.i WHERE c.i IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s ON d.doc_id = s.doc_id"""
