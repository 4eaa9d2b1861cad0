"""Repeated windows across documents: sampled anchors say where windows of equal content can be, a matcher per shard says which are.

A window is `size` consecutive symbols (bytes or words) of one document. Among the `gram`-symbol strings in a window the one with the
smallest hash is its anchor, so equal windows have equal anchors at the same place, and only strings that are the smallest of some window
are listed. Around an anchor, the symbols that windows with this anchor can reach are its context. All windows of a context hold the
anchor, so what the repeated ones cover is one interval of it.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcost.llm.common import dropped, slices, written

BASE = 0x9E3779B97F4A7C15
LAST = (1 << 63) - 1        # stands for a null id: after all others
GROUP = 500                 # contexts of one anchor that a task takes at most
PIECE = 1 << 18             # window starts of a text whose hashes are held at once
SPLIT = 6                   # parts into which the window starts of a larger group are cut
_words: dict[bytes, int] = {}


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    def run(b):
        a = np.full(n, b, np.uint64)
        a[0] = 1
        return np.multiply.accumulate(a)
    return run(BASE), run(pow(BASE, -1, 1 << 64))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(bytes([b])) for b in range(256)], np.uint64)


def rolling(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n symbols."""
    if len(values) < n:
        return np.array([], np.uint64)
    power, inverse = _powers(1 << len(values).bit_length())
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[:len(values)], dtype=np.uint64)])
    h = (total[n:] - total[:-n]) * inverse[:len(values) - n + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def _sliding(a: np.ndarray, n: int, best) -> np.ndarray:
    """best over each run of n values, by doubling."""
    have = 1
    while 2 * have <= n:
        a, have = best(a[:-have], a[have:]), 2 * have
    return best(a[:len(a) - (n - have)], a[n - have:]) if have < n else a


def picked(h: np.ndarray, n: int) -> np.ndarray:
    """Positions that hold the smallest of some n consecutive hashes; all of them on a tie."""
    if len(h) < n:
        return np.array([], np.int64)
    a = (h >> np.uint64(32)).astype(np.uint32)
    least = _sliding(a, n, np.minimum)
    pad = np.zeros(n - 1, np.uint32)
    return np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), n, np.maximum) == a)


class Bytes:
    """A text as its UTF-8 bytes."""
    @staticmethod
    def symbols(data: bytes):
        return data

    @staticmethod
    def values(symbols: bytes) -> np.ndarray:
        return _byte_values()[np.frombuffer(symbols, np.uint8)]

    @staticmethod
    def part(symbols: bytes, a: int, b: int) -> bytes:
        return symbols[a:b]


class Words:
    """A text as its words: runs of anything but space and the controls 9 to 13."""
    @staticmethod
    def symbols(data: bytes) -> list[bytes]:
        return data.split()

    @staticmethod
    def values(symbols: list[bytes]) -> np.ndarray:
        if len(_words) > 500_000:
            _words.clear()
        for w in set(symbols).difference(_words):
            _words[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(_words.__getitem__, symbols), np.uint64, len(symbols))

    @staticmethod
    def part(symbols: list[bytes], a: int, b: int) -> bytes:
        return b" ".join(symbols[a:b])


@dataclass(frozen=True)
class Kind:
    """What a window is: the kind of symbol, its size, the length of an anchor; about how many bytes of contexts a matcher gets at once
    (more than 2**21 symbols are an error of prefix_ranks()); and how many bytes of a text's hash tell rows of one id, or without one, apart."""
    unit: type
    size: int
    gram: int
    chunk: int = 400_000
    row_bytes: int = 16

    @property
    def reach(self) -> int:
        """Symbols before an anchor that a window with it may begin."""
        return self.size - self.gram


def picks(symbols, kind: Kind, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of a text. A long text goes in pieces of `piece` window starts that overlap by a window, so its arrays stay small."""
    at, found = [], []
    for lo in range(0, max(0, len(symbols) - kind.size + 1), piece):
        h = rolling(kind.unit.values(symbols[lo:lo + piece + kind.size - 1]), kind.gram)
        p = picked(h, kind.reach + 1)
        at.append(p + lo)
        found.append(h[p])
    if len(at) < 2:
        return (at[0], found[0]) if at else (np.array([], np.int64), np.array([], np.uint64))
    position, first = np.unique(np.concatenate(at), return_index=True)
    return position, np.concatenate(found)[first]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def carried(docs: DataFrame, carry: tuple[str, ...]) -> tuple[list, str]:
    """Further columns that go along under names that clash with none (k0, k1, ...), and their part of a schema."""
    return ([F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(carry)],
            "".join(f", k{n} {docs.schema[c].dataType.simpleString()}" for n, c in enumerate(carry)))


def keyed(docs: DataFrame, kind: Kind, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """id (null: the largest), th (128-bit hash of the text, that tells rows of one id apart), z (the whole text, compressed, or null) and the carried columns."""
    def squeeze(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=1)
        for b in slices(batches):
            data = [None if t is None else t.encode("utf-8", "surrogatepass") for t in b["t"]]
            th = [xxhash.xxh3_128_digest(d or b"")[:kind.row_bytes] for d in data]
            yield b.drop(columns="t").assign(th=th, z=[None if d is None else pack.compress(d) for d in data])
    columns, kinds = carried(docs, carry)
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.col(text_col).alias("t"), *columns)
    return source.mapInPandas(squeeze, f"id long, th binary, z binary{kinds}")


def anchors(docs: DataFrame, kind: Kind, id_col: str, text_col: str) -> DataFrame:
    """id, th, pos, ah (hash of the anchor), ch (hash of the context and the anchor's place in it) of every anchor."""
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, size, reach = kind.unit, kind.size, kind.reach
        for b in slices(batches):
            docs, th, at, ah, ch = [], [], [], [], []
            for n, t in enumerate(b["t"]):
                data = (t or "").encode("utf-8", "surrogatepass")
                s = unit.symbols(data)
                if len(s) < size:
                    continue
                p, h = picks(s, kind)
                docs.append(np.full(len(p), n))
                th += [xxhash.xxh3_128_digest(data)[:kind.row_bytes]] * len(p)
                at.append(p)
                ah.append(h)
                for q in p.tolist():
                    lo = q - reach if q > reach else 0
                    ch.append(xxhash.xxh64_intdigest(unit.part(s, lo, q + size), q - lo))
            if docs:
                yield pd.DataFrame({"id": b["id"].to_numpy()[np.concatenate(docs)], "th": th, "pos": np.concatenate(at).astype(np.int32),
                                    "ah": np.concatenate(ah).view(np.int64), "ch": np.array(ch, np.uint64).view(np.int64)})
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.col(text_col).alias("t"))
    return source.mapInPandas(find, "id long, th binary, pos int, ah long, ch long")


#: A unit is what a matcher gets: a context (or the part of it that some window starts can reach) with its group key g and own key c,
#: how often it occurs, its first occurrence (id, th, pos of the anchor), its first symbol's place relative to the anchor, and the
#: starts of the windows that count.
UNIT = "g long, c long, n long, id long, th binary, pos int, base int, lo int, hi int, ctx binary"


def _contexts(texts: DataFrame, wanted: DataFrame, kind: Kind) -> DataFrame:
    """A unit for each wanted anchor (g, c, n, id, th, pos), read out of the whole texts; once more for each equal row."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for b in slices(batches, 100):
            rows = []
            for i, th, z, want in zip(b["id"], b["th"], b["z"], b["want"]):
                s = kind.unit.symbols(unpack.decompress(z))
                for w in want:
                    pos = w["pos"]
                    lo = max(0, pos - kind.reach)
                    rows.append((w["g"], w["c"], w["n"], i, th, pos, lo - pos, -kind.reach, 0, kind.unit.part(s, lo, pos + kind.size)))
            yield pd.DataFrame(rows, columns=["g", "c", "n", "id", "th", "pos", "base", "lo", "hi", "ctx"])
    by_doc = wanted.groupBy("id", "th").agg(F.collect_list(F.struct("g", "c", "n", "pos")).alias("want"))
    return texts.join(by_doc, ["id", "th"]).select("id", "th", "z", "want").mapInPandas(cut, UNIT)


def _split(kind: Kind):
    """Units of a large group, each cut into parts by the starts of the windows; the new group key is the hash of what all windows of a
    part hold in common, so a group falls apart by content."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches, 1000):
            rows = []
            for u in b.itertuples():
                s = kind.unit.symbols(u.ctx)
                step = -(-(u.hi - u.lo + 1) // SPLIT)
                for lo in range(u.lo, u.hi + 1, step):
                    hi = min(lo + step - 1, u.hi)
                    first, last = max(lo, u.base), min(hi, u.base + len(s) - kind.size)
                    if first > last:
                        continue
                    own = kind.unit.part(s, first - u.base, last + kind.size - u.base)
                    core = kind.unit.part(s, hi - u.base, lo + kind.size - u.base)
                    g = xxhash.xxh64_intdigest(core, (u.g ^ (lo * BASE)) & (1 << 64) - 1)
                    rows.append((u.g, u.c, _signed(g), _signed(xxhash.xxh64_intdigest(own, first - lo)), u.n, u.id, u.th, u.pos, first, lo, hi, own))
            yield pd.DataFrame(rows, columns=["pg", "pc", "g", "c", "n", "id", "th", "pos", "base", "lo", "hi", "ctx"])
    return cut


def _chunks(match: Callable[[pd.DataFrame], pd.DataFrame], chunk: int):
    """Feeds whole groups to the matcher, about `chunk` bytes at a time; rows come in order of g."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for part in slices(batches, 500):
            if held and sum(x["ctx"].str.len().sum() for x in held) >= chunk:
                rows = pd.concat(held)
                rest = rows["g"] == rows["g"].iloc[-1]
                if not rest.all():
                    yield match(rows[~rest].reset_index(drop=True))
                    held = [rows[rest]]
            held.append(part)
        if held:
            yield match(pd.concat(held).reset_index(drop=True))
    return run


def _matched(units: DataFrame, kind: Kind, match: Callable, group: int, depth: int = 0) -> DataFrame:
    """g, c, a, b: the interval of each unit, relative to its anchor, that its repeated windows cover; units without one are left out.

    Groups of up to `group` units are dealt out whole. Larger ones are split by window starts and content, equal parts are merged with
    their counts, and the parts are matched the same way; a part with a single start is equal within its group, so that ends.
    """
    count = units.groupBy("g").agg(F.count("*").alias("m"))
    large = written(count.where(F.col("m") > group).select("g"))
    fields = "g long, c long, a int, b int"
    if large.isEmpty():
        return units.repartition("g").sortWithinPartitions("g").mapInPandas(_chunks(match, kind.chunk), fields)
    small = units.join(large, "g", "left_anti").repartition("g").sortWithinPartitions("g").mapInPandas(_chunks(match, kind.chunk), fields)
    parts = written(units.join(large, "g", "left_semi").select(*[c.split()[0] for c in UNIT.split(", ")]).mapInPandas(_split(kind), "pg long, pc long, " + UNIT))
    merged = parts.groupBy("g", "c").agg(F.sum("n").alias("n"), F.min(F.struct("id", "th", "pos")).alias("first"), F.first("base").alias("base"),
                                         F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("ctx").alias("ctx"))
    merged = written(merged.select("g", "c", "n", "first.id", "first.th", "first.pos", "base", "lo", "hi", "ctx"))
    below = _matched(merged, kind, match, group, depth + 1)
    # what is decided for the first occurrence of merged parts holds for it alone; the others have it as an earlier copy
    decided = written(merged.join(below, ["g", "c"], "left").select("g", "c", F.col("n").alias("mn"), F.struct("id", "th", "pos").alias("first"), "a", "b"))
    found = parts.alias("p").join(decided.alias("r"), ["g", "c"])
    whole = match.whole(F.struct("p.id", "p.th", "p.pos"), F.col("r.first"), F.col("mn"))
    first, last = F.col("p.base"), F.col("p.base") + match.length("p.ctx")
    a, b = F.when(whole, first).otherwise(F.col("r.a")), F.when(whole, last).otherwise(F.col("r.b"))
    up = found.select(F.col("pg").alias("g"), F.col("pc").alias("c"), a.alias("a"), b.alias("b")).where("a IS NOT NULL")
    return small.unionByName(up.groupBy("g", "c").agg(F.min("a").alias("a"), F.max("b").alias("b")))


def covered(docs: DataFrame, kind: Kind, match, id_col: str, text_col: str, group: int = GROUP, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The keyed texts, and id, th, spans (start, end in symbols, unmerged, may reach beyond the text) of what repeated windows cover.

    match(units) -> (g, c, a, b) decides about the first occurrence of each unit; match.whole(own, first, n) is true for an occurrence all
    of whose windows are repeated because of another occurrence of the same unit; match.length gives the symbols of a ctx.
    """
    texts = keyed(docs, kind, id_col, text_col, carry)
    seen = written(anchors(docs, kind, id_col, text_col))
    groups = written(seen.groupBy("ah").agg(F.count("*").alias("n"), F.min("ch").alias("x"), F.max("ch").alias("y")).where("n > 1").select("ah", (F.col("x") < F.col("y")).alias("mixed")))
    rows = written(seen.join(groups, "ah"))
    dropped(seen, groups)
    first = rows.groupBy("ah", "ch").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "pos")).alias("first"), F.first("mixed").alias("mixed"))
    first = written(first)
    wanted = first.where("mixed").select(F.col("ah").alias("g"), F.col("ch").alias("c"), "n", "first.id", "first.th", "first.pos")
    units = written(_contexts(texts, wanted, kind))
    inside = _matched(units, kind, match, group).select(F.col("g").alias("ah"), F.col("c").alias("ch"), "a", "b")
    state = written(first.join(inside, ["ah", "ch"], "left").select(F.col("ah").alias("g"), F.col("ch").alias("c"), "n", "first", "a", "b"))
    dropped(first, units)
    found = rows.join(state, (F.col("ah") == F.col("g")) & (F.col("ch") == F.col("c")))
    whole = match.whole(F.struct("id", "th", "pos"), F.col("first"), F.col("n"))
    a = F.when(whole, F.lit(-kind.reach)).otherwise(F.col("a"))
    b = F.when(whole, F.lit(kind.size)).otherwise(F.col("b"))
    spans = found.select("id", "th", F.greatest(F.col("pos") + a, F.lit(0)).alias("start"), (F.col("pos") + b).alias("end")).where("start IS NOT NULL AND end IS NOT NULL")
    spans = written(spans.groupBy("id", "th").agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    dropped(rows, state)
    return texts, spans


def window_starts(units: pd.DataFrame, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows that count in units laid end to end: owner, start relative to the owner's anchor, place of the start in the whole."""
    base = units["base"].to_numpy(np.int64)
    first = np.maximum(units["lo"].to_numpy(np.int64), base)
    n = np.maximum(0, np.minimum(units["hi"].to_numpy(np.int64), base + lengths - size) - first + 1)
    owner = np.repeat(np.arange(len(units)), n)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + first[owner]
    return owner, start, (np.cumsum(lengths) - lengths)[owner] + start - base[owner]


def extremes(units: pd.DataFrame, owner: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pd.DataFrame:
    """g, c, a, b from the covered intervals, which come in order of their owner."""
    if not len(owner):
        return pd.DataFrame({"g": [], "c": [], "a": [], "b": []}, dtype="int64")
    at = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    own = units.iloc[owner[at]]
    return pd.DataFrame({"g": own["g"].to_numpy(), "c": own["c"].to_numpy(), "a": np.minimum.reduceat(begin, at).astype(np.int32), "b": np.maximum.reduceat(end, at).astype(np.int32)})


def prefix_ranks(first: np.ndarray, depth: int, until: int) -> Iterator[tuple[int, np.ndarray]]:
    """Dense ranks (from 1) of all suffixes by their first `depth`, 2 * `depth`, ... `until` symbols; `first` says the first `depth` in
    at most 42 bits. Sorted as one 64-bit number each, so more than 2**21 - 1 suffixes are an error."""
    n, low = len(first), np.uint64((1 << 21) - 1)
    if n > int(low):
        raise ValueError(f"{n} suffixes at once; {int(low)} fit: windows are too long, or a group's contexts too many, for one shard")
    at = np.arange(n, dtype=np.uint64)
    key = first.astype(np.uint64)
    while True:
        order = np.sort(key << np.uint64(21) | at)
        new = np.r_[True, (order[1:] >> np.uint64(21)) != (order[:-1] >> np.uint64(21))]
        rank = np.empty(n, np.uint64)
        rank[(order & low).astype(np.int64)] = np.cumsum(new)
        yield depth, rank
        if depth >= until:
            return
        step = min(depth, until - depth)
        key = rank << np.uint64(21)
        key[:max(0, n - step)] |= rank[step:]
        depth += step


def merged_spans(spans, length: int) -> list[tuple[int, int]]:
    """Sorted, disjoint, cut at the text's end; spans that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted((x["start"], min(x["end"], length)) for x in spans) if spans is not None else ():
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
