"""Formulas over ordered bars, as SQL text for Spark and, in tests, for a second engine.

A formula is a list of named steps and of outputs; each is an expression over the
bar columns, the bar's index ``i`` and earlier steps. All windows have one
partition and order, so that a plan has one exchange and one sort.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

SPEC = "PARTITION BY symbol ORDER BY time"


@dataclass
class Formula:
    outputs: dict[str, str]
    steps: list[tuple[str, str]] = field(default_factory=list)


class Dialect:
    """What the two engines write alike."""

    def taken(self) -> dict[str, str]:
        """Outputs besides those of a formula that its expressions need: none."""
        return {}

    def over(self, n: int) -> str:
        return f"OVER ({SPEC} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"

    @property
    def so_far(self) -> str:
        return f"OVER ({SPEC} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

    def lag(self, x: str, k: int = 1) -> str:
        return f"lag({x}, {k}) OVER ({SPEC})" if k else x

    def frame(self, call: str, n: int) -> str:
        """An aggregate over the last n bars, whatever is there."""
        return f"{call} {self.over(n)}"

    def full(self, call: str, x: str, n: int) -> str:
        """An aggregate over the last n bars if ``x`` is there in all of them."""
        return f"CASE WHEN count({x}) {self.over(n)} = {n} THEN {call} {self.over(n)} END"

    def before(self, x: str) -> str:
        """The last value there was on an earlier bar."""
        return f"last_value({self.known(x)}) OVER ({SPEC} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

    def first(self, x: str) -> str:
        """The first value there was, this bar's included."""
        return f"first_value({self.known(x)}) {self.so_far}"

    def among(self, call: str, where: str, n: int) -> str:
        """An aggregate over the last n bars that have the same value of column ``where`` as this one."""
        return f"{call} OVER (PARTITION BY symbol, {where} ORDER BY time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"

    def filled(self, call: str, x: str, where: str, n: int) -> str:
        """The same, if ``where`` is 1 here and ``x`` is there in all n of them."""
        return f"CASE WHEN {where} = 1 AND {self.among(f'count({x})', where, n)} = {n} THEN {self.among(call, where, n)} END"

    def earlier(self, x: str, where: str, k: int) -> str:
        """The value of ``x`` k bars ago, of bars with the same value of column ``where``."""
        return f"lag({x}, {k}) OVER (PARTITION BY symbol, {where} ORDER BY time)" if k else x

    def flag(self, test: str) -> str:
        return f"CASE WHEN {test} THEN 1 ELSE 0 END"

    def mean(self, x: str, n: int) -> str:
        return self.full(f"avg({x})", x, n)

    def total(self, x: str, n: int) -> str:
        return self.full(f"sum({x})", x, n)

    def forms(self, preview: str, commit: str) -> str:
        """``preview`` on a bar that is still forming, ``commit`` on a final one. All bars are final here."""
        return commit

    def high(self, x: str, n: int) -> str:
        """A forming bar comes on top of the last n, and takes no place of theirs."""
        return self.forms(self.full(f"max({x})", x, n + 1), self.full(f"max({x})", x, n))

    def low(self, x: str, n: int) -> str:
        return self.forms(self.full(f"min({x})", x, n + 1), self.full(f"min({x})", x, n))

    def deviation(self, x: str, n: int) -> str:
        """Population standard deviation; a flat window has exactly zero."""
        flat = f"max({x}) {self.over(n)} = min({x}) {self.over(n)}"
        spread = f"CASE WHEN {flat} THEN {self.number(0)} ELSE stddev_pop({x}) {self.over(n)} END"
        return f"CASE WHEN count({x}) {self.over(n)} = {n} THEN {spread} END"

    def cumulative(self, x: str) -> str:
        return f"sum({x}) {self.so_far}"

    def divide(self, a: str, b: str) -> str:
        return f"({a}) / nullif({b}, {self.number(0)})"

    def number(self, x: float) -> str:
        return f"CAST('{float(x)!r}' AS DOUBLE)"

    def clamp(self, x: str, low: float, high: float) -> str:
        """null stays null."""
        return f"CASE WHEN {x} IS NOT NULL THEN greatest({self.number(low)}, least({self.number(high)}, {x})) END"

    def both(self, *xs: str) -> str:
        return " AND ".join(f"{x} IS NOT NULL" for x in xs)

    def window(self, x: str, n: int) -> str:
        """The last n values as an array, null unless all are there."""
        return self.full(self.gather(x), x, n)

    def weighted(self, x: str, weights: list[float]) -> str:
        """Sum of an array times weights, oldest first."""
        return self.dot(x, self.array([self.number(w) for w in weights]))


class SparkSql(Dialect):
    def known(self, x: str) -> str:
        return f"{x}, true"

    def gather(self, x: str) -> str:
        return f"collect_list({x})"

    def array(self, items: list[str]) -> str:
        return f"array({', '.join(items)})"

    def at(self, a: str, k: int) -> str:
        """Item k, from 0."""
        return f"{a}[{k}]"

    def item(self, a: str, k: str) -> str:
        """Item k, from 1."""
        return f"element_at({a}, {k})"

    def map(self, a: str, var: str, body: str) -> str:
        return f"transform({a}, {var} -> {body})"

    def map_at(self, a: str, var: str, k: str, body: str) -> str:
        """``body`` of each item and its place, from 1."""
        return f"transform({a}, ({var}, at_) -> {re.sub(rf'\b{k}\b', '(at_ + 1)', body)})"

    def add_up(self, a: str) -> str:
        return f"aggregate({a}, {self.number(0)}, (acc_, x_) -> acc_ + x_)"

    def sorted(self, a: str) -> str:
        return f"array_sort({a})"

    def dot(self, a: str, b: str) -> str:
        return self.add_up(f"zip_with({a}, {b}, (x_, y_) -> x_ * y_)")

    def count_where(self, a: str, var: str, test: str) -> str:
        return f"size(filter({a}, {var} -> {test}))"


    def largest(self, a: str) -> str:
        return f"array_max({a})"

    def smallest(self, a: str) -> str:
        return f"array_min({a})"



class FormingSql(SparkSql):
    """For bars of which the last of a symbol may still be forming, as column ``forming`` tells.

    Only that bar's own value differs; windows of final bars never see it.
    """

    def forms(self, preview: str, commit: str) -> str:
        return f"CASE WHEN forming THEN {preview} ELSE {commit} END"


class ResumingSql(FormingSql):
    """For the last bars of a series, with what the bars before them have come to in an array ``carry``.

    Running totals, first and last values go on from there. What they have come to after
    each bar is in outputs ``carry_0``, ``carry_1``, .. of the formula, for the bars that
    follow once this one is let go. Outputs ``among_0``, .. tell which bars count where
    a window is over bars of one kind, and ``reach`` of how many.
    """

    def __init__(self) -> None:
        self.slots = 0
        self.kinds: list[int] = []
        self._made: dict[str, str] = {}

    def taken(self) -> dict[str, str]:
        """The outputs that the expressions since the last call need."""
        made, self._made = self._made, {}
        return made

    def _slot(self, after: str) -> str:
        name, self.slots = f"carry_{self.slots}", self.slots + 1
        self._made[name] = after.replace("@", f"carry[{self.slots - 1}]")
        return f"carry[{self.slots - 1}]"

    def _kind(self, where: str, n: int) -> None:
        self._made[f"among_{len(self.kinds)}"] = f"CAST({where} AS DOUBLE)"
        self.kinds.append(n + 1)

    def cumulative(self, x: str) -> str:
        here = f"CAST(sum({x}) {self.so_far} AS DOUBLE)"
        text = f"CASE WHEN @ IS NULL THEN {here} ELSE @ + coalesce({here}, {self.number(0)}) END"
        return f"({text})".replace("@", self._slot(text))

    def before(self, x: str) -> str:
        carried = self._slot(f"coalesce(CAST(last_value({self.known(x)}) {self.so_far} AS DOUBLE), @)")
        return f"coalesce({super().before(x)}, {carried})"

    def first(self, x: str) -> str:
        text = f"coalesce(@, CAST(first_value({self.known(x)}) {self.so_far} AS DOUBLE))"
        return text.replace("@", self._slot(text))

    def among(self, call: str, where: str, n: int) -> str:
        self._kind(where, n)
        return super().among(call, where, n)

    def earlier(self, x: str, where: str, k: int) -> str:
        self._kind(where, k)
        return super().earlier(x, where, k)


class DuckSql(Dialect):
    def known(self, x: str) -> str:
        return f"{x} IGNORE NULLS"

    def gather(self, x: str) -> str:
        return f"list({x})"

    def array(self, items: list[str]) -> str:
        return f"[{', '.join(items)}]"

    def at(self, a: str, k: int) -> str:
        return f"{a}[{k + 1}]"

    def item(self, a: str, k: str) -> str:
        return f"{a}[{k}]"

    def map(self, a: str, var: str, body: str) -> str:
        return f"list_transform({a}, lambda {var}: {body})"

    def map_at(self, a: str, var: str, k: str, body: str) -> str:
        return f"list_transform({a}, lambda {var}, {k}: {body})"

    def add_up(self, a: str) -> str:
        return f"list_sum({a})"

    def sorted(self, a: str) -> str:
        return f"list_sort({a})"

    def dot(self, a: str, b: str) -> str:
        return f"list_sum(list_transform(list_zip({a}, {b}), lambda z_: z_[1] * z_[2]))"

    def count_where(self, a: str, var: str, test: str) -> str:
        return f"len(list_filter({a}, lambda {var}: {test}))"


    def largest(self, a: str) -> str:
        return f"list_max({a})"

    def smallest(self, a: str) -> str:
        return f"list_min({a})"

