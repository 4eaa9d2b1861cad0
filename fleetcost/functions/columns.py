"""Column expressions: token cleaning, keys, rounding, number text, scenario choice, name rules."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean "no value", and the four scenarios in order.
NULL_TOKENS = ("", "NULL", "NONE", "N/A")
SCENARIOS = ("LOW", "EXPECTED", "HIGH", "STRESS")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_token(c: str | Column) -> Column:
    """NULL for an empty or placeholder text, else the text unchanged."""
    c = col(c)
    return F.when(F.upper(F.trim(c)).isin(*NULL_TOKENS), None).otherwise(c)


def normalise_key(c: str | Column) -> Column:
    """Upper case, trimmed, runs of blanks or hyphens as one underscore."""
    return F.upper(F.regexp_replace(F.trim(col(c)), "[ -]+", "_"))


def round_half_up(c: str | Column, digits: int) -> Column:
    """Round on a decimal of eight digits, so a tie such as 1.005 rounds up on every engine; numbers beyond 1e29 stay as they are."""
    return F.coalesce(F.round(col(c).try_cast("decimal(38,8)"), digits).cast("double"), col(c).cast("double"))


def fmt_number(c: str | Column, digits: int = 4) -> Column:
    """Readable number text: thousands separators, at most `digits` decimals, no trailing zeros."""
    text = F.format_number(round_half_up(c, digits), digits)
    return F.rtrim(F.rtrim(text, F.lit("0")), F.lit(".")) if digits else text


def by_scenario(scenario: Column, low: Column, expected: Column, high: Column) -> Column:
    """Value of a low / expected / high triple for a scenario; STRESS uses high."""
    return (F.when(scenario == "LOW", low).when(scenario == "EXPECTED", expected)
            .when(scenario.isin("HIGH", "STRESS"), high))


def effective_at(start: Column, end: Column, t: Column) -> Column:
    """Half-open validity window [start, end); an open end never expires."""
    return (start <= t) & (end.isNull() | (end > t))


def classify(name: Column, rules: list[tuple[str, str]]) -> Column:
    """First rule whose pattern occurs in the lower-cased name, else NULL."""
    branches = reduce(lambda acc, r: acc.when(F.lower(name).rlike(r[0]), r[1]), rules[1:],
                      F.when(F.lower(name).rlike(rules[0][0]), rules[0][1]))
    return branches
