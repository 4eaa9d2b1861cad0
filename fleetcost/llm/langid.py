"""Language ID: proportions of languages in each document by expectation maximisation over words, from character trigram likelihoods."""
from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcost.llm.common import slices
from fleetcost.llm.windows import carried

BUCKETS = 1 << 16
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts at once: bucket of each letter's trigram (the letter and its neighbours, anything but a letter counts as one blank),
    position of each word's first trigram, and each word's text number. A word is a run of letters; texts are lower-cased."""
    lower = [t.lower() for t in texts]
    sizes = np.fromiter(map(len, lower), np.int64, len(lower)) + 1
    points = np.frombuffer("\0".join(["", *lower, "\0"]).encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[points]
    c = np.where(letter, points, 0).astype(np.uint32)
    at = np.flatnonzero(letter)
    h = c[at - 1] * np.uint32(0x9E3779B1) ^ c[at] * np.uint32(0x85EBCA77) ^ (c[at + 1] * np.uint32(0xC2B2AE3D) >> np.uint32(3))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    first = np.flatnonzero(~letter[at - 1])
    return h >> np.uint32(16), first, np.searchsorted(np.cumsum(sizes), at[first], side="left")


class Model:
    """Log-likelihood of a trigram bucket in each language, from smoothed counts (rows: lang, bucket, n)."""

    def __init__(self, counts: pd.DataFrame, smoothing: float = 0.5):
        self.languages = sorted(counts["lang"].unique())
        table = np.full((BUCKETS, max(1, len(self.languages))), smoothing)
        column = {x: i for i, x in enumerate(self.languages)}
        np.add.at(table, (counts["bucket"].to_numpy(), counts["lang"].map(column).to_numpy(dtype=int)), counts["n"].to_numpy())
        self.log = np.log(table / table.sum(axis=0)).astype(np.float32)

    def mixtures(self, texts: list[str], penalty: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Proportions of the languages (a row per text, zeros without a letter), and the number of words."""
        grams, first, doc = trigrams(texts)
        theta, n = np.zeros((len(texts), len(self.languages))), np.bincount(doc, minlength=len(texts))
        if not len(first) or not self.languages:
            return theta, n
        ll = np.add.reduceat(self.log[grams], first, axis=0)
        top = ll.max(axis=1, keepdims=True)
        likelihood = np.exp(np.maximum(ll - top, -60))
        some = np.flatnonzero(n)
        begin = np.searchsorted(doc, some)
        no = np.searchsorted(some, doc)
        def em(weights: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
            for step in range(steps + 1):
                share = likelihood * weights[no]
                total = share.sum(axis=1)
                if step < steps:
                    share /= total[:, None]
                    weights = np.add.reduceat(share, begin, axis=0) / n[some][:, None]
            return weights, np.add.reduceat(np.log(np.maximum(total, 1e-300)), begin)
        k = len(self.languages)
        full, _ = em(np.full((len(some), k), 1 / k, np.float32), steps)
        order = np.argsort(-full, axis=1, kind="stable")
        rank = np.argsort(order, axis=1, kind="stable")
        best, best_score, grows = np.zeros((len(some), k)), np.full(len(some), -np.inf), np.ones(len(some), bool)
        for m in range(1, k + 1):       # the m likeliest languages, of each text for as long as one more pays for it
            w = np.where(rank < m, full + 1e-6, 0)
            w, fit = em((w / w.sum(axis=1, keepdims=True)).astype(np.float32), 0 if m == 1 else 4)
            score = fit - penalty * (m - 1) * np.log(n[some] + 1)
            grows &= score > best_score
            best = np.where(grows[:, None], w, best)
            best_score = np.where(grows, score, best_score)
            if not grows.any():
                break
        theta[some] = best
        return theta, n


def fit(labelled: DataFrame, per_language: int = 2000, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id") -> Model:
    """Trigram counts of about `per_language` rows of each label, drawn by a hash of key and text; rows without text or label don't count. Equal rows are drawn together.

    That is the documented bound of the training sample. The counts themselves are made on the executors; the driver gets at most
    2**16 numbers per label.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(key_col).alias("key")).where("text IS NOT NULL AND lang IS NOT NULL")
    totals = rows.groupBy("lang").count().collect()
    if not totals:
        return Model(pd.DataFrame({"lang": [], "bucket": np.array([], int), "n": []}))
    share = F.create_map(*[F.lit(x) for r in totals for x in (r["lang"], min(1.0, per_language / r["count"]))])
    drawn = rows.where(F.pmod(F.xxhash64("key", "text", F.lit("sample")), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20)).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in slices(batches):
            for lang, part in b.groupby("lang"):
                n = np.bincount(trigrams(part["text"].tolist())[0], minlength=BUCKETS)
                at = np.flatnonzero(n)
                yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": n[at]})

    counts = drawn.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return Model(counts.toPandas())


def identify(docs: DataFrame, model: Model, penalty: float = 3.0, steps: int = 6, id_col: str = "doc_id", text_col: str = "text",
             carry: tuple[str, ...] = ()) -> DataFrame:
    """id, lang_pred, score (its share of the words, 0 to 1), languages (of the chosen set), shares, and the columns named in `carry`.

    A word is drawn from one language, with the product of its trigram likelihoods; EM gives the proportions. The set of languages is
    grown in order of proportion while the log-likelihood gains more than `penalty * ln(words)` per language. A text that is null, empty
    or without a letter is `und` with score 0, as is every text when nothing was learned. Each text is judged by itself. Repeated rows and rows without an id are judged like
    any other and kept; an empty table gives no rows. Whole texts are read; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for part in slices(batches):
            theta, n = m.mixtures([t or "" for t in part["t"]], penalty, steps)
            known = (n > 0) & (len(m.languages) > 0)
            top = theta.argmax(axis=1) if m.languages else np.zeros(len(part), int)
            yield (part if text_col in carry else part.drop(columns="t")).assign(
                lang_pred=[m.languages[i] if k else UNKNOWN for i, k in zip(top, known)],
                score=np.where(known, np.clip(theta.max(axis=1, initial=0), 0, 1), 0.0),
                languages=[[m.languages[i] for i in np.flatnonzero(row > 0)] for row in theta],
                shares=[row[row > 0].tolist() for row in theta])

    others = tuple(c for c in carry if c != text_col)
    columns, kinds = carried(docs, others)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), *columns)
    schema = f"id {source.schema['id'].dataType.simpleString()}, lang_pred string, score double, languages array<string>, shares array<double>{kinds}"
    out = source.mapInPandas(predict, schema + ", t string" * (text_col in carry))
    back = {text_col: "t"} | {c: f"k{n}" for n, c in enumerate(others)}
    return out.select(F.col("id").alias(id_col), "lang_pred", "score", "languages", "shares", *[F.col(back[c]).alias(c) for c in carry])


def held_out(key) -> F.Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def learned(docs: DataFrame) -> Model:
    return fit(docs.where(~held_out("doc_id")))


def run(spark, sf_dir: str) -> DataFrame:
    from fleetcost.llm.common import table
    docs = table(spark, sf_dir, "documents")
    return identify(docs, learned(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
