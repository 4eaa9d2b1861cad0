"""Quality rules: a threshold table compiled into one projection of built-in functions."""
from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetcost.llm.common import words

WINDOW = 5      # words of a window when repeated wording is counted

#: Frequent function words of the four languages of the corpus, lower case.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "on", "with", "as", "was", "be", "by", "at", "this", "are", "from", "or", "an", "have", "not",
    "der", "die", "das", "und", "ist", "ein", "eine", "nicht", "mit", "von", "zu", "den", "des", "dem", "auf", "sich", "für", "im",
    "le", "la", "les", "et", "un", "une", "du", "que", "qui", "dans", "pour", "pas", "par", "sur", "au", "aux", "avec", "ce", "il", "elle",
    "el", "los", "las", "y", "en", "una", "por", "con", "para", "del", "se", "no", "su", "al", "lo", "como", "más", "o",
    "de", "es", "a",
)


@dataclass(frozen=True)
class Rule:
    """A text passes when `low <= metric <= high`; None is no bound."""
    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The method's own rules, on the columns of metrics().
RULES = (
    Rule("mean_word_length", "mean_word_chars", 2, 20),
    Rule("symbols_per_word", "symbol_ratio", None, 0.1),
    Rule("shouting", "exclaim_ratio", None, 0.3),
    Rule("stop_words", "stop_ratio", 0.02, None),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
    Rule("bullet_lines", "bullet_line_ratio", None, 0.9),
    Rule("ellipsis_lines", "ellipsis_line_ratio", None, 0.3),
    Rule("distinct_words", "distinct_word_ratio", 0.04, None),
)

#: Both hold before any rule is looked at: enough words, and little wording said again.
BASE_RULES = (Rule("enough_words", "n_words", 10, None), Rule("repeated_wording", "repeat_percent", None, 20))


def compile_rules(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """One boolean column (all rules hold) and one array column (names of the rules that fail) for a threshold table."""
    def holds(r: Rule) -> Column:
        m = F.col(r.metric)
        bounds = [m >= r.low] * (r.low is not None) + [m <= r.high] * (r.high is not None)
        return F.coalesce(reduce(lambda a, b: a & b, bounds, F.lit(True)), F.lit(False))
    oks = [(r, holds(r)) for r in rules]
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(r.name)) for r, ok in oks])) if oks else F.array().cast("array<string>")
    return reduce(lambda a, b: a & b, [ok for _, ok in oks], F.lit(True)), failed


def metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Length, symbol, stop-word, line and repetition figures of each text, without user functions and without a shuffle.

    Windows are told apart by their 64-bit hash within one text. All work is linear in a text but for one sort, which only texts
    with a repeated window need.
    """
    text = F.coalesce(F.col("t"), F.lit(""))
    step = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    step = step.select("id", "t", words(F.col("t")).alias("w"), F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    n = F.size("w")
    window = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WINDOW)]))
    step = step.select(
        "id", n.cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size(F.split(text, r"[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
        (F.size(F.split(text, "!", -1)) - 1).cast("long").alias("n_exclaim"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
        F.when(n >= WINDOW, window).alias("h"))
    keep = [c for c in step.columns if c != "h"]
    again = F.size("h") > F.size(F.array_distinct("h"))
    step = step.select(*keep, F.when(again, F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("s"))
    at = F.filter("s", lambda x, j: (x.h == F.get("s", j + 1).h) | ((j > 0) & (x.h == F.get("s", F.greatest(j - 1, F.lit(0))).h)))
    step = step.select(*keep, F.array_sort(F.transform(at, lambda x: x.i)).alias("p"))
    covered = F.aggregate(F.zip_with("p", F.slice("p", 2, F.greatest(F.size("p"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW))),
                          F.lit(0).cast("long"), lambda acc, x: acc + x)
    return step.select(*keep, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Metrics, ratios, verdict and failed rules of every document; columns other than id and text are ignored.

    A null or empty text has zero words and fails the base rules. Ratios of a text without words or lines are 0. Repeated rows are
    judged each on its own; a null id is kept. An empty table gives no rows.
    """
    def per(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    m = metrics(docs, id_col, text_col).withColumns({
        "mean_word_chars": per("word_chars", "n_words"), "symbol_ratio": per("n_symbols", "n_words"), "exclaim_ratio": per("n_exclaim", "n_words"),
        "stop_ratio": per("n_stop", "n_words"), "distinct_word_ratio": per("n_distinct", "n_words"), "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "bullet_line_ratio": per("n_bullet_lines", "n_lines"), "ellipsis_line_ratio": per("n_ellipsis_lines", "n_lines"),
        "repeat_percent": F.when(F.col("n_words") > 0, 100 * F.col("n_repeat_words") / F.col("n_words")).otherwise(F.lit(0.0))})
    base, base_names = compile_rules(BASE_RULES)
    own, own_names = compile_rules(rules)
    return m.withColumns({"base_failed": ~base, "kept": base & own, "failed_rules": F.concat(base_names, own_names)}).withColumnRenamed("id", id_col)


def run(spark, sf_dir: str) -> DataFrame:
    from fleetcost.llm.common import table
    return quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_SEP = r"[\x20\x09-\x0D]+"
#: Written from the contract: windows are counted as rows, not with arrays.
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{_SEP}'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1),
n AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM r, (SELECT unnest(range(0, 5)) AS o) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(length(regexp_replace(t, '[^!]', '', 'g')) AS BIGINT) AS bangs,
        len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS stops, len(list_distinct(w)) AS kinds, len(l) AS lines,
        len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09]*[-*\x{{2022}}]'))) AS bullets,
        len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[\x20\x09\x0D]*$'))) AS dots
      FROM w LEFT JOIN n ON w.doc_id = n.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN base_failed THEN FALSE ELSE word_chars / n_words BETWEEN 2 AND 20 AND n_symbols / n_words <= 0.1 AND bangs / n_words <= 0.3
    AND stops / n_words >= 0.02 AND kinds / n_words >= 0.04 AND (lines = 0 OR (n_dup_lines / lines <= 0.5 AND bullets / lines <= 0.9 AND dots / lines <= 0.3)) END AS kept
FROM b"""
