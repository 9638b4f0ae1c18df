"""The same results as SQL for a second engine, for tests and the driver."""

from __future__ import annotations

from ..functions.dialect import SPEC, DuckSql
from ..sources.tables import EVENT_BARS_SQL
from .planner import Request, layers

#: Finer than the digits of prices over any default length, so that no result lies on a rounding edge.
DIGITS = 7


BARS = f"bars AS ({EVENT_BARS_SQL}), s0 AS (SELECT *, CAST(row_number() OVER ({SPEC}) - 1 AS BIGINT) AS i FROM bars)"


def rounded(text: str, name: str, digits: int | str | None) -> str:
    """Without negative zeros; as it is if ``digits`` is None, to the precision of a float if it is "single"."""
    value = f"CAST({text} AS DOUBLE)"
    if digits == "single":
        value = f"CAST(CAST({value} AS FLOAT) AS DOUBLE)"
    elif digits is not None:
        value = f"round({value}, {digits})"
    return f'CASE WHEN {value} = 0 THEN CAST(0 AS DOUBLE) ELSE {value} END AS "{name}"'


def windowed_sql(wanted: Request, digits: int | str | None = DIGITS) -> str:
    steps, outputs = layers([wanted], DuckSql())
    parts, last = [BARS], "s0"
    for k, layer in enumerate(steps, 1):
        if layer:
            parts.append(f"l{k} AS (SELECT *, {', '.join(f'{text} AS {name}' for name, text in layer.items())} FROM {last})")
            last = f"l{k}"
    chosen = ", ".join(rounded(text, name, digits) for name, text in outputs.items())
    return f"WITH {', '.join(parts)} SELECT symbol, time, {chosen} FROM {last}"
