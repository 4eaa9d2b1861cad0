"""Helpers of the SQL checks: rounding and number text, and a registry of named subqueries."""
from __future__ import annotations

import re

from fleetcost.refdata import TABLES, values_sql
from fleetcost.sources.inputs import SQL as INPUTS
from fleetcost.sources.inputs import check_sql

CTES: dict[str, str] = {}


def rn(expr: str, digits: int = 6) -> str:
    """Round half up on a decimal, as a double."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38,8)), {digits}) AS DOUBLE)"


def r2(expr: str) -> str:
    return rn(expr, 2)


def rounded(columns: str, digits: int = 6, prefix: str = "") -> str:
    """`a b c` as rounded select items."""
    return ", ".join(f"{rn(prefix + c, digits)} AS {c}" for c in columns.split())


def fmt(expr: str, digits: int = 4) -> str:
    """Number text with thousands separators and no trailing zeros (non-negative numbers)."""
    d = f"round(CAST({expr} AS DECIMAL(38,8)), {digits})"
    whole = f"CAST(trunc({d}) AS BIGINT)"
    frac = f"lpad(CAST(CAST(round(({d} - trunc({d})) * {10 ** digits}) AS BIGINT) AS VARCHAR), {digits}, '0')"
    return f"(format('{{:,}}', {whole}) || rtrim(rtrim('.' || {frac}, '0'), '.'))"


def values(columns, rows) -> str:
    return values_sql(columns, rows)


def _named(name: str) -> str | None:
    if name in CTES:
        return CTES[name]
    if name.startswith("ref_") and name[4:] in TABLES:
        return values_sql(*TABLES[name[4:]])
    if name in INPUTS:
        return check_sql(name)
    return None


def derive(prefix: str, replaced: dict[str, str], *roots: str) -> None:
    """Register copies `<prefix><name>` of the subqueries that `roots` need and that use a replaced name, so the same SQL runs over other rows."""
    done = dict(replaced)

    def copy(name: str) -> str:
        body = _named(name)
        if name in done or body is None:
            return done.get(name, name)
        done[name] = name       # a name within its own text is a column
        parts = re.split(r"('[^']*')", body)
        new = "".join(x if n % 2 else re.sub(r"[a-z_][a-z0-9_]*", lambda m: copy(m[0]), x) for n, x in enumerate(parts))
        if new != body:
            done[name] = prefix + name
            CTES[prefix + name] = new
        return done[name]

    for root in roots:
        copy(root)


def compose(sql: str) -> str:
    """Prefix the named subqueries that `sql` uses, in dependency order."""
    order: list[str] = []

    def visit(text: str, path: tuple[str, ...]):
        for name in dict.fromkeys(re.findall(r"[a-z_][a-z0-9_]*", re.sub(r"'[^']*'", "''", text))):
            body = _named(name)
            if body is not None and name not in order and name not in path:
                visit(body, path + (name,))
                order.append(name)

    visit(sql, ())
    if not order:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({_named(n)})" for n in order) + "\n" + sql
