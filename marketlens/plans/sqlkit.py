"""Small helpers to assemble the oracle SQL texts.

The oracle is written in plain SQL for DuckDB over the driver's tables; the
stand-in silver tables and the shared views are common table expressions
that each query pulls in by name.
"""

from __future__ import annotations

import re


def avg6_sql(expr: str, scale: int = 0) -> str:
    """Exact AVG(expr) rounded half up to 6 digits, as DECIMAL(38,6).

    ``expr`` has at most ``scale`` fractional digits.  Summation is done on
    the unscaled integers, so the result is independent of row order and
    equal to Spark's decimal average.
    """
    u = f"CAST(({expr}) * {10 ** scale} AS BIGINT)" if scale else f"CAST(({expr}) AS BIGINT)"
    s, n = f"SUM({u})", f"COUNT({u})"
    f = 10 ** (6 - scale)
    return (f"(CAST(SIGN({s}) * ((2 * ABS({s}) * {f} + {n}) // NULLIF(2 * {n}, 0)) "
            f"AS DECIMAL(31,0)) * 0.000001)")


def avg15_sql(expr: str) -> str:
    """Exact AVG of a scale-15 decimal, rounded half up, as DECIMAL(38,15)."""
    u = f"CAST(({expr}) * 1000000000000000 AS BIGINT)"
    s, n = f"SUM({u})", f"COUNT({u})"
    return (f"(CAST(SIGN({s}) * ((2 * ABS({s}) + {n}) // NULLIF(2 * {n}, 0)) "
            f"AS DECIMAL(22,0)) * 0.000000000000001)")


def div_round_sql(num: str, den: str, scale: int, num_scale: int = 0, den_scale: int = 0) -> str:
    """Exact ROUND(num / den, scale) half away from zero for decimal inputs.

    ``num``/``den`` carry ``num_scale``/``den_scale`` fractional digits;
    both are turned into integers first.  NULL when den = 0.
    """
    a = f"CAST(({num}) * {10 ** num_scale} AS HUGEINT)"
    b = f"CAST(({den}) * {10 ** den_scale} AS HUGEINT)"
    # value * 10^scale = a * 10^(scale + den_scale - num_scale) / b
    e = scale + den_scale - num_scale
    if e >= 0:
        top, bot = f"ABS({a}) * {10 ** e}", f"ABS({b})"
    else:
        top, bot = f"ABS({a})", f"ABS({b}) * {10 ** (-e)}"
    q = f"((2 * {top} + {bot}) // NULLIF(2 * {bot}, 0))"
    unit = "1" if scale == 0 else "0." + "0" * (scale - 1) + "1"
    return f"(CAST(SIGN({a}) * SIGN({b}) * {q} AS DECIMAL({38 - scale - 1},0)) * {unit})"


class CteLibrary:
    """Named CTE bodies with automatic dependency inclusion."""

    def __init__(self):
        self.bodies: dict[str, str] = {}

    def add(self, name: str, body: str) -> None:
        self.bodies[name] = body

    def _deps(self, text: str) -> list[str]:
        return [n for n in self.bodies if re.search(rf"\b{re.escape(n)}\b", text)]

    def build(self, query: str) -> str:
        order: list[str] = []
        seen: set[str] = set()

        def visit(name: str) -> None:
            if name in seen:
                return
            seen.add(name)
            for d in self._deps(self.bodies[name]):
                if d != name:
                    visit(d)
            order.append(name)

        for d in self._deps(query):
            visit(d)
        if not order:
            return query.strip()
        ctes = ",\n".join(f"{n} AS (\n{self.bodies[n].strip()}\n)" for n in order)
        body = query.strip()
        if re.match(r"(?i)^WITH\s", body):
            return f"WITH {ctes},\n{body[5:].lstrip()}"
        return f"WITH {ctes}\n{body}"
