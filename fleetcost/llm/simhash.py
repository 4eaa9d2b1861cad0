"""SimHash near-dedup: 64-bit fingerprints, a byte-position inverted index with count filtering, verified links, components."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcost.llm.common import slices, written
from fleetcost.llm.graph import connected_components

BYTES = 8
RADIUS = 4
MATCHES = BYTES - RADIUS    # bytes that two linked fingerprints share by position at least


def _positions() -> list[tuple[int, ...]]:
    """Byte triples of which every four positions contain one: eight positions in three groups; a triple lies in one group, or has two
    positions in a group and the third in the next."""
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    def used(t):
        g = sorted(group[i] for i in t)
        return g[0] == g[2] or any(g.count(a) == 2 and g.count((a + 1) % 3) == 1 for a in range(3))
    return [t for t in combinations(range(BYTES), MATCHES - 1) if used(t)]


POSITIONS = _positions()
MASKS = np.array([sum(0xFF << 8 * i for i in t) for t in POSITIONS], np.uint64)
SMALL = 8           # a list of at most so many fingerprints is compared pair by pair
LARGE = 20_000      # a longer list goes another, equally exact way


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Signed 64-bit SimHash of the word shingles (A-Z lower-cased, repeats counted, joined by a space; fewer words: all of them; none: 0).
    A bit is set if it is set in over half of the XXH64 hashes (UTF-8, seed 42)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), min(shingle, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = end - size
    digest, spans = xxhash.xxh64_digest, zip(begin[:len(words) - n + 1].tolist(), end[n - 1:].tolist())
    return vote(np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in spans]), np.uint8).reshape(-1, 8))


def vote(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of hashes, each a row of eight bytes, the high one first; of none: 0."""
    votes = np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp of every document."""
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            yield pd.DataFrame({"id": b["id"], "fp": [fingerprint(t, shingle) for t in b["t"]]})
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return source.mapInPandas(of, f"id {source.schema['id'].dataType.simpleString()}, fp long")


def _linked(a: np.ndarray, b) -> np.ndarray:
    """Count filter, then check: positional bytes that a pair shares are tallied, pairs with MATCHES go on, and their bits are compared."""
    x = a ^ b
    shared = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    out = shared >= MATCHES
    out[out] = np.bitwise_count(x[out]) <= RADIUS
    return out


def _spanning(members: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected within one list, each member reached once."""
    rest = members
    while len(rest):
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            x = stack.pop()
            hit = _linked(rest, x)
            if hit.any():
                near, rest = rest[hit], rest[~hit]
                stack.extend(near)
                yield np.full(len(near), x), near


def _links(key: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
    """Links within the lists of whole keys; rows come ordered by key."""
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.array([], int)
    size = np.diff(np.r_[begin, len(key)])
    us, vs = [], []
    length = np.repeat(size, size)
    place = np.arange(len(key)) - np.repeat(begin, size)
    for off in range(1, SMALL):
        i = np.flatnonzero((length <= SMALL) & (place + off < length))
        i = i[_linked(fp[i], fp[i + off])] if len(i) else i
        us.append(fp[i])
        vs.append(fp[i + off])
    for b, n in zip(begin[size > SMALL], size[size > SMALL]):
        for u, v in _spanning(fp[b:b + n]):
            us.append(u)
            vs.append(v)
    u, v = (np.concatenate(x) if x else np.array([], np.uint64) for x in (us, vs))
    return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})


def _match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (k, value, fp) in order of k and value: a list may end in the next batch."""
    key, fp = np.array([], np.int64), np.array([], np.uint64)
    for b in batches:
        key = np.concatenate([key, b["value"].to_numpy() ^ (b["k"].to_numpy(np.int64) * 0x9E3779B97F4A7C1)])
        fp = np.concatenate([fp, b["fp"].to_numpy(np.int64).view(np.uint64)])
        cut = int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1])
        yield _links(key[:cut], fp[:cut])
        key, fp = key[cut:], fp[cut:]
    yield _links(key, fp)


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each fingerprint of a long list with each pattern at most RADIUS / 2 bits away outside the list's bytes. Two fingerprints of the
    list have a pattern in common exactly if they differ in at most RADIUS bits."""
    flips = []
    for mask in MASKS.tolist():
        bits = [1 << i for i in range(64) if not mask >> i & 1]
        flips.append(np.array([0, *bits, *(a | b for a, b in combinations(bits, 2))], np.uint64))
    for b in batches:
        fp = b["fp"].to_numpy(np.int64).view(np.uint64)
        for k, f in zip(b["k"], fp):
            near = (f ^ flips[k]).view(np.int64)
            yield pd.DataFrame({"k": np.int32(k), "near": near, "fp": np.full(len(near), f, np.uint64).view(np.int64)})


def links(prints: DataFrame, large: int = LARGE) -> DataFrame:
    """Links (u, v) that connect all fingerprints at most RADIUS bits apart; `prints` has distinct values fp.

    Inverted index: two fingerprints RADIUS bits apart share at least MATCHES bytes by position, hence all bytes of one of the 20 triples
    of POSITIONS, so each fingerprint is listed under its bytes at each triple. Lists give spanning links, never all pairs. A list of
    over `large` fingerprints is not gathered: its members meet in bit patterns half the radius away, spread over all tasks.
    """
    signed = [int(np.array(m, np.uint64).view(np.int64)) for m in MASKS]
    lists = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for k, m in enumerate(signed)])).alias("x")).select("x.k", "x.value", "fp")
    long = written(lists.groupBy("k", "value").agg(F.count("*").alias("n")).where(F.col("n") > large).select("k", "value"))
    if long.isEmpty():
        return lists.repartition("k", "value").sortWithinPartitions("k", "value").mapInPandas(_match, "u long, v long").distinct()
    short = lists.join(long, ["k", "value"], "left_anti").repartition("k", "value").sortWithinPartitions("k", "value").mapInPandas(_match, "u long, v long")
    meet = lists.join(long, ["k", "value"], "left_semi").mapInPandas(_meet, "k int, near long, fp long")
    hub = meet.groupBy("k", "near").agg(F.min("fp").alias("m"))
    met = meet.join(hub, ["k", "near"]).where("fp > m").select(F.col("fp").alias("u"), F.col("m").alias("v"))
    return short.unionByName(met).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, large: int = LARGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id (smallest id reachable over links of at most 4 differing bits) of every document.

    Null, empty and blank texts have fingerprint zero and are linked like any other. Equal fingerprints are one node, so copies cost one
    row each. Repeated rows are kept; a null id is never a component_id unless its component has no other. Other columns are ignored; an
    empty table gives no rows. Whole texts are read, once: ids and fingerprints are written to the shared folder.
    """
    prints = written(fingerprints(docs, shingle, id_col, text_col))
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("low")))
    comp = connected_components(links(nodes.select("fp"), large))
    linked = written(nodes.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root")))
    lowest = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    of = written(linked.join(lowest, "root").select(F.col("fp").alias("f"), "component_id"))
    return prints.join(of, F.col("fp") == F.col("f")).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def run(spark, sf_dir: str) -> DataFrame:
    from fleetcost.llm.common import table
    return near_duplicates(table(spark, sf_dir, "documents"))
