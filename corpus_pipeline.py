"""The corpus pipeline: documents through five stages, each written as Parquet and read again before the next."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcost.llm import fmindex, langid, mixing, packing, similar
from fleetcost.llm.common import table, written
from fleetcost.llm.windows import LAST

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.5       # a document goes when no language has this share of its words


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents, in their types; one that is missing is null, further columns go."""
    kinds = {"doc_id": "long", "n_chars": "long"}
    return docs.select(*[(F.col(f"`{c}`") if c in docs.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS])


def _keyed(docs: DataFrame) -> DataFrame:
    """With a key in order of the id (null last) that only equal rows share."""
    return _columns(docs).withColumn("key", F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.xxhash64(*COLUMNS).alias("row")))


def _once(docs: DataFrame) -> DataFrame:
    """One row of each key. Only rows whose key occurs again are shuffled with their texts."""
    again = written(docs.groupBy("key").count().where("count > 1").select("key"))
    if again.isEmpty():
        return docs
    return docs.join(again, "key", "left_anti").unionByName(docs.join(again, "key", "left_semi").dropDuplicates(["key"]))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: a null or empty text, one without a letter, and one where no language has LEAST_SCORE go.

    The model is learned from the stage's own labelled rows. Repeated rows stay; a row without an id is judged like any other; without
    any label nothing is known and every document goes.
    """
    docs = _columns(docs)
    judged = langid.identify(docs, langid.learned(docs), carry=COLUMNS[1:])
    return judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id (null last; of equal ids the one with the smallest
    hash of its row). Near duplicates share 0.8 of their five-word shingles, directly or over others: pairs come from SimHash fingerprints,
    linked as in op7, and from lists of shared shingles for those whose fingerprints are further apart; each is verified. Of equal rows one stays."""
    docs = _keyed(docs)
    judged = similar.similar(docs)
    kept = judged.where("key = component_id").select("key").distinct()
    return _once(docs.join(kept, "key", "left_semi")).select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of 50 words and more that a document with a smaller id has too; the words left are joined by a space.

    An uncut text keeps its form, null included. A document of which nothing is left goes.
    """
    docs = _columns(docs)
    cut = fmindex.dedup(docs, keep_form=True, carry=("lang", "source", "n_chars")).withColumn("changed", F.size("spans") > 0)
    cut = cut.where(~F.col("changed") | (F.col("kept") != ""))
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.when(F.col("changed"), F.length("kept")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them; those it does not take go. Copies are equal rows."""
    docs = _keyed(docs)
    mixed = mixing.mix(docs, id_col="key").groupBy("key").agg(F.sum("copies").alias("copies")).where("copies > 0")
    taken = _once(docs).join(mixed, "key")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    return packing.pack(_columns(docs), public_tokenizers.path(packing.TOKENIZER))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mixture", mixture), ("packing", packed)]
ORACLE_SQL = None       # no SQL for the EM, the fingerprints, the knapsack or the tokenizer; tests/llm checks every stage by brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
