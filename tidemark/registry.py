"""Indicators of one's own beside those of the catalogue.

A window formula is a function of a dialect and parameters that gives a ``Formula``;
it joins others in one plan. A fold is a subclass of ``Fold`` (with ``base=True``, so
that it is no part of the catalogue by itself) with ``start(**parameters)`` and
``step(bar)``, which gives a value for each output. ``planner.request`` then knows
the id and the aliases.
"""

from __future__ import annotations

from collections.abc import Callable

from . import catalog
from .catalog import Definition, Parameter
from .functions.dialect import Dialect, Formula
from .operators.recursive import RECURSIVE, RELOCATED, Fold
from .operators.windowed import WINDOWED


def define(
    name: str, outputs: tuple[str, ...] = ("line",), parameters: tuple[Parameter, ...] = (), aliases: tuple[str, ...] = (), category: str = "Statistical", pane: str = "Separate"
) -> Definition:
    return Definition(name, category, aliases, parameters, outputs, pane, "MinusOnePlusOne", "", (), ())


def register(definition: Definition, formula: Callable[[Dialect, dict], Formula] | None = None, fold: type[Fold] | None = None) -> Callable[[], None]:
    """Add an indicator with a formula or a fold; what comes back takes it away again.

    An id that is there already, or a formula whose outputs are not those of the
    definition, is an error, and nothing is added.
    """
    if (formula is None) == (fold is None):
        raise ValueError("an indicator has a formula or a fold")
    if formula is not None:
        from .functions.dialect import SparkSql

        made = formula(SparkSql(), definition.resolve())
        if tuple(made.outputs) != definition.outputs(definition.resolve()):
            raise ValueError(f"the formula gives {', '.join(made.outputs)}")
    catalog.register(definition)
    if formula is not None:
        WINDOWED[definition.id] = formula
    else:
        RECURSIVE[definition.id] = fold
    return lambda: unregister(definition.id)


def unregister(name: str) -> None:
    """Take an indicator away by its id, one of the catalogue too."""
    catalog.unregister(name)
    for kind in (WINDOWED, RECURSIVE, RELOCATED):
        kind.pop(name, None)
