"""Documents whose sets of word shingles are similar: near SimHash fingerprints and prefix lists bring pairs together, each pair is
verified, links give components."""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcost.llm import simhash
from fleetcost.llm.common import dropped, slices, written
from fleetcost.llm.graph import connected_components

PART, WHOLE = 4, 5      # similar: shared shingles are at least PART / WHOLE of all shingles of a pair
SMALL = 16              # in a list of at most so many documents all pairs are looked at; a longer one first links to one member
COMMON = SMALL          # shingles in lists of more documents than this come last in the order
MOST = 100_000          # of those, so many at most from each of two counts
HOLD = 50_000           # entries of a list that a task keeps before it links them to the first one


def shingles(text: str | None, size: int) -> np.ndarray:
    """XXH64 hashes (UTF-8, seed 42) of the different word shingles (A-Z lower-cased, joined by a space; fewer words: all of them; none:
    no shingle), sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.array([], np.uint64)
    joined, n = b" ".join(words), min(size, len(words))
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    digest, spans = xxhash.xxh64_intdigest, zip((end - length)[:len(words) - n + 1].tolist(), end[n - 1:].tolist())
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, len(words) - n + 1))


def _is_common(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which shingles of a set are among the common ones (sorted)."""
    return common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s if len(common) else np.zeros(len(s), bool)


def prefix(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles in order (common ones last, then by hash) of which two similar sets share one."""
    if len(common) and len(s):
        last = _is_common(s, common)
        s = np.concatenate([s[~last], s[last]])
    return s[:len(s) - -(-PART * len(s) // WHOLE) + 1] if len(s) else s


def further(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles after the plain prefix that come into it when its common ones go last: as many as it takes to fill it if as large a
    share of them is common, and some more. None if no shingle of the plain prefix is common; all if four fifths are."""
    p = len(prefix(s, common[:0]))
    q = int(_is_common(s[:p], common).sum())
    if not q or PART * p <= WHOLE * q:
        return s[p:] if q else s[:0]
    return s[p:-(-p * p // (p - q)) + 2 * math.isqrt(p) + 8]


def sketch(s: np.ndarray) -> bytes:
    """How many shingles of a set fall into each of a power of two of classes by their first bits, about two to a class."""
    bits = min(16, max(5, (len(s) // 2).bit_length()))
    return np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint16).tobytes()


def may_be_similar(a: bytes, b: bytes) -> bool:
    """False only if two sets cannot be similar: they share at most the smaller count of each class. Of sketches of two sizes the larger is folded."""
    x, y = np.frombuffer(a, np.uint16).astype(np.int64), np.frombuffer(b, np.uint16).astype(np.int64)
    if len(x) != len(y):
        small = min(len(x), len(y))
        x, y = x.reshape(small, -1).sum(axis=1), y.reshape(small, -1).sum(axis=1)
    return (PART + WHOLE) * int(np.minimum(x, y).sum()) >= PART * int(x.sum() + y.sum())


def _signature(s: np.ndarray) -> int:
    """64-bit hash of a set of shingles, signed."""
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), 42)).view(np.int64))


def _often(source: DataFrame, size: int, common: int) -> np.ndarray:
    """The common shingles: those in the plain prefixes of over `common` documents, then those that come into a prefix in their place in
    over `common` documents; of each MOST at most, the most frequent first; not those of copies of one text. Only counts are shuffled,
    merged before that. The order decides how long lists are, never which pairs are found."""
    none = np.array([], np.uint64)
    first = _counted(source, size, common, lambda s: prefix(s, none))
    if not len(first):
        return first
    shared = source.sparkSession.sparkContext.broadcast(first)
    return np.union1d(first, _counted(source, size, common, lambda s: further(s, shared.value)))


def _counted(source: DataFrame, size: int, common: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            sets = [shingles(t, size) for t in b["t"]]
            parts = [part(s) for s in sets]
            owner = np.repeat(np.array([_signature(s) & 0x7FFFFFFF for s in sets], np.int32), [len(p) for p in parts])
            yield pd.DataFrame({"t": np.concatenate(parts).view(np.int64), "owner": owner})
    listed = source.select("t").mapInPandas(of, "t long, owner int").groupBy("t").agg(F.count("*").alias("n"), F.min("owner").alias("x"), F.max("owner").alias("y"))
    often = written(listed.where((F.col("n") > common) & (F.col("x") < F.col("y"))).orderBy(F.desc("n"), "t").limit(MOST).select("t"))
    out = np.sort(often.toPandas()["t"].to_numpy(np.int64).view(np.uint64))
    dropped(often)
    return out


def _prefixes(source: DataFrame, size: int, common: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """id, row, sig of every document, and sig, n, fp, prefix, sketch and low (smallest id and row) of every different set."""
    shared = source.sparkSession.sparkContext.broadcast(common)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            sets = [shingles(t, size) for t in b["t"]]
            yield b.drop(columns="t").assign(sig=[_signature(s) for s in sets], n=[len(s) for s in sets], fp=[simhash.vote(s.astype(">u8").view(np.uint8).reshape(-1, 8)) for s in sets], prefix=[prefix(s, shared.value).view(np.int64) for s in sets], sketch=[sketch(s) for s in sets])
    whole = written(source.mapInPandas(of, "id long, row long, sig long, n long, fp long, prefix array<long>, sketch binary"))
    nodes = written(whole.groupBy("sig").agg(F.min(F.struct("id", "row")).alias("low"), F.any_value("n").alias("n"), F.any_value("fp").alias("fp"), F.any_value("prefix").alias("prefix"), F.any_value("sketch").alias("sketch")))
    prints = written(whole.select("id", "row", "sig"))
    dropped(whole)
    return prints, nodes


def _near_prints(nodes: DataFrame) -> DataFrame:
    """Pairs u < v of sets whose fingerprints are at most simhash.RADIUS bits apart, as many as connect them: sets of one fingerprint pair with the smallest of them, those with the smallest of the next fingerprint."""
    prints = written(nodes.groupBy("fp").agg(F.min("sig").alias("m")))
    end = lambda u, m: prints.select(F.col("fp").alias(u), F.col("m").alias(m))
    near = simhash.links(prints.select("fp")).join(end("u", "a"), "u").join(end("v", "b"), "v").select("a", "b")
    near = near.unionByName(nodes.join(prints, "fp").where("sig <> m").select(F.col("sig").alias("a"), F.col("m").alias("b")))
    pairs = written(near.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")))
    dropped(prints)
    return pairs


def _fit(n: np.ndarray, pos: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the sizes and the places of a first common shingle leave room for similar sets."""
    least = -(-PART * (n[i] + n[j]) // (PART + WHOLE))
    return np.minimum(np.minimum(n[i] - pos[i], n[j] - pos[j]), np.minimum(n[i], n[j])) >= least


def _pairs(t: np.ndarray, sig: np.ndarray, n: np.ndarray, pos: np.ndarray, root: np.ndarray | None) -> pd.DataFrame:
    """Pairs to verify within whole lists; rows come ordered by t. Without roots: all pairs of a small list, in a longer one those with its
    first member. With roots: all pairs of the longer lists whose roots differ."""
    begin = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.array([], int)
    size = np.diff(np.r_[begin, len(t)])
    us, vs = [np.array([], np.int64)], [np.array([], np.int64)]
    def put(i, j):
        ok = _fit(n, pos, i, j)
        us.append(sig[i[ok]])
        vs.append(sig[j[ok]])
    if root is None:
        length, place = np.repeat(size, size), np.arange(len(t)) - np.repeat(begin, size)
        for off in range(1, SMALL):
            i = np.flatnonzero((length <= SMALL) & (place + off < length))
            put(i, i + off)
    for b, m in zip(begin[size > SMALL], size[size > SMALL]):
        rows = np.arange(b, b + m)
        if root is None:
            put(np.full(m, b), rows)
            continue
        names, number = np.unique(root[b:b + m], return_inverse=True)
        if len(names) > 1:
            for i in rows[number != np.bincount(number).argmax()]:
                j = rows[root[rows] != root[i]]
                put(np.full(len(j), i), j)
    u, v = np.concatenate(us), np.concatenate(vs)
    return pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v)})[u != v].drop_duplicates()


def _met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of lists in order of t, pos and sig: pairs (u < v) to verify, and the entries of long lists (t, sig, n, pos). The first entry has the fewest shingles that come before t, so of near
    copies it is the one with the fewest edits of its own, and most others are similar to it. A list may end in a later batch; of one that goes on for long only its first entry is kept."""
    names = ["t", "sig", "n", "pos"]
    held, hub = [np.array([], np.int64)] * 4, None

    def rows(part: list[np.ndarray], lead: list[np.ndarray] | None) -> pd.DataFrame:
        if lead is None:
            pairs = _pairs(*part, None)
            _, at, size = np.unique(part[0], return_inverse=True, return_counts=True)
            long = size[at] > SMALL
        else:
            both = [np.concatenate([h, x]) for h, x in zip(lead, part)]
            j = np.arange(1, len(both[0]))
            ok = _fit(both[2], both[3], np.zeros(len(j), int), j)
            u, v = np.full(ok.sum(), lead[1][0]), part[1][ok]
            pairs, long = pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v)}), np.ones(len(part[0]), bool)
        return pd.concat([pairs.astype("Int64"), pd.DataFrame({c: x[long] for c, x in zip(names, part)}).astype("Int64")])
    for b in batches:
        held = [np.concatenate([h, b[c].to_numpy(np.int64)]) for h, c in zip(held, names)]
        if hub is not None:
            k = int(np.searchsorted(held[0], hub[0][0], "right"))
            if k:
                yield rows([h[:k] for h in held], hub)
            held = [h[k:] for h in held]
        if len(held[0]):
            hub = None
            cut = int(np.searchsorted(held[0], held[0][-1]))
            yield rows([h[:cut] for h in held], None)
            held = [h[cut:] for h in held]
            if len(held[0]) > HOLD:
                hub = [h[:1] for h in held]
                yield rows([h[1:] for h in held], hub)
                yield pd.DataFrame({"u": pd.array([None], "Int64"), "v": pd.array([None], "Int64"), **{c: pd.array(h, "Int64") for c, h in zip(names, hub)}})
                held = [h[:0] for h in held]
    yield rows(held, None)


def _across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs within long lists, in order of t, whose roots differ."""
    names = ["t", "sig", "n", "pos", "root"]
    held = [np.array([], np.int64)] * len(names)
    for b in batches:
        held = [np.concatenate([h, b[c].to_numpy(np.int64)]) for h, c in zip(held, names)]
        cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
        yield _pairs(*(h[:cut] for h in held))
        held = [h[cut:] for h in held]
    yield _pairs(*held)


def _verified(source: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """The pairs whose sets are similar. Sketches rule out most others; only texts of the pairs that are left are cut into shingles again, and only their sets travel."""
    def rule_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = np.fromiter((may_be_similar(x, y) for x, y in zip(b["a"], b["b"])), bool, len(b))
            yield b.loc[ok, ["u", "v"]]

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            yield pd.DataFrame({"sig": b["sig"], "s": [shingles(t, size).tobytes() for t in b["t"]]})

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = np.zeros(len(b), bool)
            for k, (x, y) in enumerate(zip(b["a"], b["b"])):
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                ok[k] = WHOLE * shared >= PART * (len(both) - shared)
            yield b.loc[ok, ["u", "v"]]

    side = lambda table, u, a, c: table.select(F.col("sig").alias(u), F.col(c).alias(a))
    pairs = written(pairs.join(side(nodes, "u", "a", "sketch"), "u").join(side(nodes, "v", "b", "sketch"), "v").mapInPandas(rule_out, "u long, v long"))
    need = pairs.select(F.col("u").alias("sig")).unionByName(pairs.select(F.col("v").alias("sig"))).distinct()
    need = need.join(nodes, "sig").select("sig", "low.id", "low.row")
    s = written(source.join(need, ["id", "row"]).dropDuplicates(["sig"]).select("sig", "t").mapInPandas(sets, "sig long, s binary"))
    both = pairs.join(side(s, "u", "a", "s"), "u").join(side(s, "v", "b", "s"), "v")
    ok = written(both.mapInPandas(check, "u long, v long"))
    dropped(s, pairs)
    return ok


def similar(docs: DataFrame, size: int = 5, common: int = COMMON) -> DataFrame:
    """key and component_id (smallest key reachable over links of similar documents) of every row of `docs` (key: id, row; text).

    Two documents are linked if at least 0.8 of the word shingles that either has are in both, by 64-bit hash. Texts without words are
    linked to each other only. Repeated rows are kept. An empty table gives no rows.

    First, fingerprints of the sets are linked as in op7 (simhash.links); the pairs are verified with those of the lists. Fingerprints of many similar
    sets are further apart, so lists complete them. Shingles have one order for all documents. Two similar sets share one of the first fifth of each, so lists of the documents by such
    shingles bring all similar pairs together; sizes and places in the order rule out most others, and what is left is verified, so no
    pair is missed and none is wrong. The shingles with over `common` entries come last in the order, so a passage of many documents makes
    no long list. What stays long is mostly a large group of near copies: its list links to one member first, and then only lists whose members are not all
    connected are looked at again, for pairs that are not. Equal sets are one node. Texts are cut into shingles twice to count common ones, once to list
    them, and once more where they occur in a pair; entries of lists are shuffled once; tables are dropped when they have been read.
    """
    source = docs.select(F.col("key.id").alias("id"), F.col("key.row").alias("row"), F.col("text").alias("t"))
    prints, nodes = _prefixes(source, size, _often(source, size, common))
    near = _near_prints(nodes.select("sig", "fp"))
    post = nodes.select("sig", "n", F.posexplode("prefix").alias("pos", "t"))
    met = written(post.select("t", "sig", "n", F.col("pos").cast("long").alias("pos")).repartition("t").sortWithinPartitions("t", "pos", "sig").mapInPandas(_met, "u long, v long, t long, sig long, n long, pos long"))
    sets = written(nodes.select("sig", "low", "sketch"))
    dropped(nodes)
    pairs = written(met.where("u IS NOT NULL").select("u", "v").unionByName(near).distinct())
    links = _verified(source, sets, pairs, size)
    dropped(pairs, near)
    roots = connected_components(links)
    long = met.where("t IS NOT NULL").join(roots, F.col("sig") == F.col("node"), "left").select("t", "sig", "n", "pos", F.coalesce("root", "sig").alias("root"))
    long = written(long)
    mixed = long.groupBy("t").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("t")
    pairs = written(long.join(mixed, "t").repartition("t").sortWithinPartitions("t").mapInPandas(_across, "u long, v long").distinct())
    dropped(met, long)
    if not pairs.isEmpty():
        more = _verified(source, sets, pairs, size)
        both = written(links.unionByName(more))
        dropped(links, more)
        links, roots = both, connected_components(both)
    linked = written(sets.join(roots, F.col("sig") == F.col("node"), "left").select("sig", "low", F.coalesce("root", "sig").alias("root")))
    lowest = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    of = written(linked.join(lowest, "root").select(F.col("sig").alias("of"), "component_id"))
    dropped(pairs, links, linked, sets)
    return prints.join(of, F.col("sig") == F.col("of")).select(F.struct("id", "row").alias("key"), "component_id")
