"""URL filters: allow and block rules in a trie over reversed host labels and path segments, broadcast to the tasks."""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcost.llm.common import written

_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for a null url and for one without `://`."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    ends = [i for i in (rest.find("?"), rest.find("#")) if i >= 0]
    rest = rest[:min(ends)] if ends else rest
    cut = rest.find("/")
    return (rest.translate(_LOWER), "") if cut < 0 else (rest[:cut].translate(_LOWER), rest[cut:])


def add_rule(trie: dict, host: str, path: str, action: str) -> None:
    """Walk the host's labels from the right, then the whole segments of the path; the last segment may be the start of a longer one."""
    for label in reversed(host.split(".")):
        trie = trie.setdefault("labels", {}).setdefault(label, {})
    *whole, last = path.split("/")
    node = trie.setdefault("paths", {})
    for segment in whole:
        node = node.setdefault("segments", {}).setdefault(segment, {})
    old = node.setdefault("starts", {}).get(last)
    node["starts"][last] = (f"{host}{path}", "block" if old and old[1] == "block" else action)


def build_trie(rules: Iterable[tuple[str, str, str]]) -> dict:
    trie: dict = {}
    for host, path, action in rules:
        add_rule(trie, host, path, action)
    return trie


def longest_path(node: dict, path: str) -> tuple[str, str] | None:
    """The rule with the longest path that `path` starts with."""
    best = None
    for segment in path.split("/"):
        starts = node.get("starts", {})
        best = next((starts[segment[:n]] for n in range(len(segment), -1, -1) if segment[:n] in starts), best) if starts else best
        node = node.get("segments", {}).get(segment)
        if node is None:
            return best
    return best


def lookup(trie: dict, host: str, path: str) -> tuple[int, str | None, str | None]:
    """Labels matched, rule and action of the rule that wins: more host labels first, then the longer path; (0, None, None) if none fits."""
    best, depth = (0, None, None), 0
    for label in reversed(host.split(".")):
        trie = trie.get("labels", {}).get(label)
        if trie is None:
            break
        depth += 1
        if "paths" in trie and (hit := longest_path(trie["paths"], path)):
            best = (depth, *hit)
    return best


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_rules: int = 200_000) -> DataFrame:
    """id, host, path, rule and verdict of every url; rules has the columns host, path and action (`allow` or `block`).

    A rule fits its host and all subdomains if the path of the url starts with the rule's path. The rule with more host labels wins,
    then the longer path; of an allow and a block entry for one place the block entry wins. Without a rule the verdict is `default`.
    A rule with a null or empty host or an unknown action is ignored, a null path is empty. Null urls have an empty host and path.
    Other columns of `pages` are ignored; repeated rows are judged each; an empty table gives no rows.

    A trie holds at most `max_rules` rules, which bounds what is broadcast. Longer lists are cut into so many tries, one pass over the
    urls each, and the best match of all passes counts. There is no shuffle.
    """
    spark = pages.sparkSession
    tidy = rules.select(F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.lower("action").alias("action"))
    tidy = tidy.where((F.col("host") != "") & F.col("action").isin("allow", "block")).groupBy("host", "path").agg(F.max("action").alias("action"))
    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumns(
        {"host": F.lit(""), "path": F.lit(""), "depth": F.lit(0), "rule": F.lit(None).cast("string"), "action": F.lit(None).cast("string")})

    def search(rows: list[tuple[str, str, str]], df: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(build_trie(rows))
        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            trie = shared.value
            for b in batches:
                found = []
                for url, depth, rule, action in zip(b["url"], b["depth"], b["rule"], b["action"]):
                    host, path = split_url(url)
                    old = (depth, rule, action)
                    new = lookup(trie, host, path)
                    found.append((host, path, *(new if new[1] and (not rule or (new[0], len(new[1])) > (old[0], len(old[1]))) else old)))
                yield b[["id", "url"]].join(pd.DataFrame(found, columns=["host", "path", "depth", "rule", "action"], index=b.index))
        return df.mapInPandas(best, df.schema)

    block: list[tuple[str, str, str]] = []
    passes = 0
    for row in tidy.orderBy("host", "path").toLocalIterator():
        block.append(tuple(row))
        if len(block) == max_rules:
            out, block, passes = written(search(block, out)), [], passes + 1
    if block or not passes:
        out = search(block, out)
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))


RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def run(spark, sf_dir: str) -> DataFrame:
    from fleetcost.llm.common import table
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(list(RULES), "host string, path string, action string"))


_FITS = [(h, p, a, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')")
         for h, p, a in sorted(RULES, key=lambda r: (-r[0].count("."), -len(r[1])))]
SQL = rf"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
v AS (SELECT page_id, lower(regexp_extract(r, '^[^/?#]*')) AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS (SELECT *, CASE {' '.join(f"WHEN {c} THEN '{h}{p}'" for h, p, a, c in _FITS)} END AS rule FROM v)
SELECT page_id, host, path, rule, CASE {' '.join(f"WHEN rule = '{h}{p}' THEN '{a}'" for h, p, a, c in _FITS)} ELSE 'allow' END AS verdict FROM j"""
