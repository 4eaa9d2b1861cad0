"""Document fingerprints: SimHash of weighted words in 128 bits, and permuted block tables that find what lies within a Hamming radius."""
from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcost.llm.common import dropped, slices, table, written

BITS = 128
RADIUS = 3
TERMS = 4096        # different words whose bits are added up at once
UNIT = 64           # a word's vote is rounded to this part of one, so that sums are whole numbers, equal in any order
SMALL = 8           # a list of at most so many fingerprints is compared pair by pair
LARGE = 20_000      # a longer list is not gathered but goes another, equally exact way
LAST = (1 << 63) - 1        # stands for a null id: after all others


def fingerprint(text: str | None) -> bytes:
    """128-bit SimHash of a text's words (A-Z lower-cased; runs of anything but space and the controls 9 to 13). The bits of a word's XXH3
    hash vote for 1 or against it with weight 1 + ln(times the word occurs); a bit is 1 if the sum is above zero. No words: all 0."""
    times = Counter((text or "").encode("utf-8", "surrogatepass").lower().split())
    words, n = list(times), np.fromiter(times.values(), np.float64, len(times))
    weight = np.round(UNIT * (1 + np.log(n)))
    votes = np.zeros(BITS)
    for lo in range(0, len(words), TERMS):
        digests = b"".join(map(xxhash.xxh3_128_digest, words[lo:lo + TERMS]))
        votes += weight[lo:lo + TERMS] @ np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, BITS // 8), axis=1).astype(np.float64)
    return np.packbits(2 * votes > weight.sum()).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits."""
    return 1 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / BITS


def edited(text: str, after: str) -> str:
    """The text with the last half of its code points (rounded down) replaced by as many of the next document's first, or all of them."""
    n = len(text) // 2
    return text[:len(text) - n] + after[:n]


def with_next(docs: DataFrame) -> DataFrame:
    """id, n_chars, sha (of the edited text, SHA-256 in hex), fp, edited_fp, near_edited, near_next of every document (id, text).

    The next document is the one after it by falling id (null last; of equal ids by a hash of the text), after the last one the first; a
    single document is its own next one. A null text is an empty one; repeated rows are kept and follow each other.

    Texts are dealt out by ranges of that order and each task goes through its range; where a range ends, the text waits for the first one
    of the next range. Only these few texts, one per task, are shuffled again.
    """
    order = [F.desc_nulls_last("id"), F.asc("h")]
    source = docs.select("id", F.coalesce("id", F.lit(LAST)).alias("i"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    dealt = source.repartitionByRange(*order).sortWithinPartitions(*order).select("i", "text")
    schema = "part int, kind string, id long, text string, n_chars long, sha string, fp binary, edited_fp binary, near_edited double, near_next double"
    names = [c.split()[0] for c in schema.split(", ")]

    def judged(part, ident, text, fp, after, after_fp):
        new = edited(text, after)
        new_fp = fingerprint(new)
        return part, "done", ident, "", len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), fp, new_fp, likeness(fp, new_fp), likeness(fp, after_fp)

    def rows(out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=names)

    def held(part, kind, ident, text, fp):
        return part, kind, ident, text, 0, "", fp, b"", 0.0, 0.0

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, before = TaskContext.get().partitionId(), None
        for b in slices(batches):
            out = []
            for ident, text in zip(b["i"], b["text"]):
                fp = fingerprint(text)
                out.append(judged(part, *before, text, fp) if before else held(part, "first", ident, text, fp))
                before = ident, text, fp
            yield rows(out)
        if before:
            yield rows([held(part, "last", *before)])

    def end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches, 1):
            yield rows([judged(*x) for x in zip(b["part"], b["id"], b["text"], b["fp"], b["after"], b["after_fp"])])

    seen = written(dealt.mapInPandas(go, schema))
    parts = sorted(r["part"] for r in seen.where("kind = 'first'").select("part").collect())        # one for each task with rows
    following = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, follows int")
    first = seen.where("kind = 'first'").select(F.col("part").alias("follows"), F.col("text").alias("after"), F.col("fp").alias("after_fp"))
    last = seen.where("kind = 'last'").select("part", "id", "text", "fp").join(following, "part").join(first, "follows")
    ends = last.select("part", "id", "text", "fp", "after", "after_fp").mapInPandas(end, schema)
    return seen.where("kind = 'done'").unionByName(ends).withColumn("id", F.nullif("id", F.lit(LAST))).drop("part", "kind", "text")


def block_masks(radius: int) -> list[tuple[int, int]]:
    """For each table the bits (high word, low word) that lead its permutation. The bits are cut into radius + 2 blocks; at most `radius`
    blocks differ within the radius, so two at least are equal, and each pair of blocks leads one table."""
    cuts = [BITS * n // (radius + 2) for n in range(radius + 3)]
    block = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [(m >> 64, m & (1 << 64) - 1) for m in (a | b for a, b in combinations(block, 2))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def tables(prints: DataFrame, radius: int) -> DataFrame:
    """t, key (hash of the bits that lead table t) and the columns of `prints` (high, low: the fingerprint's words), once per table."""
    keys = [F.struct(F.lit(t).alias("t"), F.xxhash64(F.lit(t), F.col("high").bitwiseAND(F.lit(_signed(a))), F.col("low").bitwiseAND(F.lit(_signed(b)))).alias("key"))
            for t, (a, b) in enumerate(block_masks(radius))]
    return prints.withColumn("x", F.explode(F.array(*keys))).select("x.t", "x.key", *prints.columns)


def search(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """query_id, id and distance of all `prints` within the radius of each query (both: id, fp), itself included. Rows with a null fp are
    left out; repeated rows count each time. One join per table key, checked by popcounts; each pair is reported by the first table in
    which it meets."""
    words = lambda d: d.where("fp IS NOT NULL").select("id", F.conv(F.hex(F.substring("fp", 1, 8)), 16, -10).cast("long").alias("high"), F.conv(F.hex(F.substring("fp", 9, 8)), 16, -10).cast("long").alias("low"))
    a, b = tables(words(prints), radius), tables(words(queries), radius).select("t", "key", F.col("id").alias("query_id"), F.col("high").alias("h"), F.col("low").alias("l"))
    x, y = F.col("high").bitwiseXOR(F.col("h")), F.col("low").bitwiseXOR(F.col("l"))
    meets = [(x.bitwiseAND(F.lit(_signed(m))) == 0) & (y.bitwiseAND(F.lit(_signed(n))) == 0) for m, n in block_masks(radius)]
    first = F.coalesce(*[F.when(ok, F.lit(t)) for t, ok in enumerate(meets)])
    met = a.join(b, ["t", "key"]).withColumn("distance", (F.bit_count(x) + F.bit_count(y)).cast("int"))
    return met.where((F.col("distance") <= radius) & (first == F.col("t"))).select("query_id", "id", "distance")


def _apart(f: np.ndarray, g: np.ndarray) -> np.ndarray:
    return np.bitwise_count(f ^ g).sum(axis=-1)


def _lowest(key: np.ndarray, fp: np.ndarray, low: np.ndarray, radius: int) -> np.ndarray:
    """The lowest id within the radius in each fingerprint's list; rows come ordered by key, then by id.

    In a list, the members take turns by id: whoever is within the radius of one and has none yet takes its id. That ends when all have one, for a
    group of near copies after a turn or two."""
    best = low.copy()
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.array([], int)
    size = np.diff(np.r_[begin, len(key)])
    length, place = np.repeat(size, size), np.arange(len(key)) - np.repeat(begin, size)
    for off in range(1, SMALL):
        i = np.flatnonzero((length <= SMALL) & (place + off < length))
        i = i[_apart(fp[i], fp[i + off]) <= radius]
        np.minimum.at(best, i + off, low[i])
    for b, n in zip(begin[size > SMALL], size[size > SMALL]):
        rest = np.arange(b, b + n)
        for i in range(b, b + n):
            rest = rest[rest > i]
            if not len(rest):
                break
            near = _apart(fp[rest], fp[i]) <= radius
            best[rest[near]] = low[i]
            rest = rest[~near]
    return best


def _in_lists(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows (key, high, low, least) in order of key and id: a list may end in the next batch."""
        key, fp, low = np.array([], np.int64), np.zeros((0, 2), np.int64), np.array([], np.int64)

        def answer(n: int) -> pd.DataFrame:
            best = _lowest(key[:n], fp[:n].view(np.uint64), low[:n], radius)
            less = best < low[:n]
            return pd.DataFrame({"high": fp[:n, 0][less], "low": fp[:n, 1][less], "near": best[less]})
        for b in batches:
            key, fp, low = np.concatenate([key, b["key"].to_numpy()]), np.concatenate([fp, b[["high", "low"]].to_numpy(np.int64)]), np.concatenate([low, b["least"].to_numpy()])
            cut = int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1]) if len(key) else 0
            yield answer(cut)
            key, fp, low = key[cut:], fp[cut:], low[cut:]
        yield answer(len(key))
    return run


def _patterns(radius: int, flips: int):
    """Each fingerprint with all bit patterns at most `flips` bits away outside its table's leading blocks."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turned = []
        for masks in block_masks(radius):
            bits = [np.array([1 << b, 0] if w == 0 else [0, 1 << b], np.uint64) for w in range(2) for b in range(64) if not masks[w] >> b & 1]
            turned.append(np.array([sum(c, np.zeros(2, np.uint64)) for n in range(flips + 1) for c in combinations(bits, n)], np.uint64).reshape(-1, 2))
        for b in batches:
            for r in b.itertuples():
                p = (np.array([r.high, r.low], np.int64).view(np.uint64) ^ turned[r.t]).view(np.int64)
                yield pd.DataFrame({"t": np.int32(r.t), "key": np.int64(r.key), "p": p[:, 0], "q": p[:, 1], "high": np.int64(r.high), "low": np.int64(r.low), "least": np.int64(r.least)})
    return run


def lowest_near(prints: DataFrame, radius: int = RADIUS, large: int = LARGE) -> DataFrame:
    """high, low and near: the lowest id among all fingerprints within the radius of each of `prints` (high, low: distinct; least: the
    lowest id with it). Only those that have a lower one than their own are listed.

    Permuted block tables: two fingerprints within the radius have the leading blocks of one table in common, so each is listed there by
    them, and lists are searched. A list of over `large` is not gathered. Its member with the lowest id settles all within its radius; what is left
    meets all members in bit patterns half the radius away, spread over all tasks. Both are exact.
    """
    listed = tables(prints, radius)
    small = lambda d: d.select("key", "high", "low", "least").repartition("key").sortWithinPartitions("key", "least").mapInPandas(_in_lists(radius), "high long, low long, near long")
    least = lambda d: d.groupBy("high", "low").agg(F.min("near").alias("near"))
    long = written(listed.groupBy("t", "key").agg(F.count("*").alias("n"), F.min(F.struct("least", "high", "low")).alias("hub")).where(F.col("n") > large).select("t", "key", "hub"))
    if long.isEmpty():
        dropped(long)
        return least(small(listed))
    short = small(listed.join(long, ["t", "key"], "left_anti"))
    members = written(listed.join(long, ["t", "key"]))
    apart = F.bit_count(F.col("high").bitwiseXOR(F.col("hub.high"))) + F.bit_count(F.col("low").bitwiseXOR(F.col("hub.low")))
    settled = members.where(apart <= radius).select("high", "low", F.col("hub.least").alias("near"))
    pattern = lambda d, flips: d.select("t", "key", "high", "low", "least").mapInPandas(_patterns(radius, flips), "t int, key long, p long, q long, high long, low long, least long")
    gives = pattern(members, radius // 2).groupBy("t", "key", "p", "q").agg(F.min("least").alias("near"))
    takes = pattern(members.where(apart > radius), radius - radius // 2)
    met = takes.join(gives, ["t", "key", "p", "q"]).where("near < least").select("high", "low", "near")
    return least(short.unionByName(settled).unionByName(met))


def fingerprints(docs: DataFrame, radius: int = RADIUS, large: int = LARGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint (32 hex digits), near_edited, near_next (see with_next) and near_id of every
    document: the lowest id of a document whose fingerprint is within the radius, itself included.

    Null, empty and blank texts have fingerprint zero. Equal texts have equal fingerprints; repeated rows are kept; a null id is near_id
    only where no other is near. Other columns are ignored; an empty table gives no rows. Whole texts are read.
    """
    seen = written(with_next(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))))
    word = lambda n: F.conv(F.hex(F.substring("fp", n, 8)), 16, -10).cast("long")
    prints = written(seen.groupBy("fp").agg(F.min(F.coalesce("id", F.lit(LAST))).alias("least")).select(word(1).alias("high"), word(9).alias("low"), "least"))
    near = lowest_near(prints, radius, large)
    of = written(prints.join(near, ["high", "low"], "left").select(F.concat(F.lpad(F.hex("high"), 16, "0"), F.lpad(F.hex("low"), 16, "0")).alias("of"), F.coalesce("near", "least").alias("near")))
    dropped(prints)
    show = lambda c: F.lower(F.hex(c))
    return seen.join(of, F.hex("fp") == F.col("of")).select(F.col("id").alias(id_col), "n_chars", F.col("sha").alias("edited_sha256"), show("fp").alias("fingerprint"), show("edited_fp").alias("edited_fingerprint"),
                                                            "near_edited", "near_next", F.when(F.col("near") < LAST, F.col("near")).alias("near_id"))


def run(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
