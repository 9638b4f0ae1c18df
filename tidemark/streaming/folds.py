"""Recursive indicators over a stream of bars.

A row is a bar with ``is_final``. Final bars in order of time are committed. A bar
that is not final is a preview, by the folds' preview arithmetic, and changes
nothing. A final bar for a time that has been committed is a correction: it is put
in its place and everything after it is computed again. Corrections reach back
``history`` bars; the folds' state before those is kept, so state does not grow
with a series.

``runtime`` does the same for all indicators, and more.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import PRICES
from ..operators.recursive import RECURSIVE, Bar
from ..plans.planner import Request

HISTORY = 256
VERSION = 1


class Series:
    """Folds of one symbol with their last bars."""

    def __init__(self, requests: list[Request], history: int = HISTORY) -> None:
        self.base = [RECURSIVE[r.definition.id](r.resolved) for r in requests]
        self.tail = pickle.loads(pickle.dumps(self.base))
        self.first, self.history, self.bars = 0, history, []
        self.values: list[tuple] = []

    def _step(self, folds: list, i: int, row: tuple) -> tuple:
        bar = Bar(i, *row)
        return tuple(x for f in folds for x in f.commit(bar))

    def commit(self, row: tuple) -> tuple:
        value = self._step(self.tail, self.first + len(self.bars), row)
        self.bars.append(row)
        self.values.append(value)
        while len(self.bars) > self.history:
            self._step(self.base, self.first, self.bars.pop(0))
            self.values.pop(0)
            self.first += 1
        return value

    def preview(self, row: tuple) -> tuple:
        bar = Bar(self.first + len(self.bars), *row)
        return tuple(x for f in self.tail for x in f.preview(bar))

    def correct(self, row: tuple) -> list[tuple[int, tuple]] | None:
        """(time, values) that changed; None if there is no such bar to correct."""
        place = next((k for k, b in enumerate(self.bars) if b[0] == row[0]), None)
        if place is None:
            return None
        self.bars[place] = row
        folds = pickle.loads(pickle.dumps(self.base))
        after = [self._step(folds, self.first + k, b) for k, b in enumerate(self.bars)]
        changed = [(b[0], new) for b, old, new in zip(self.bars, self.values, after) if new != old]
        self.values, self.tail = after, folds
        return changed

    @property
    def last(self) -> int | None:
        return self.bars[-1][0] if self.bars else None


def _clean(x):
    return None if x is None or x != x or x in (float("inf"), float("-inf")) else float(x)


def stream_folds(bars: DataFrame, requests: list[Request], history: int = HISTORY) -> DataFrame:
    """(symbol, time, kind, outputs) for a stream of (bar columns, is_final).

    ``kind`` is append, preview, correction, or rejected for bars that are too old
    to correct and for previews before the last final bar. Bars of a micro-batch
    are taken in order of time, final ones first among equals.
    """
    columns = [c for r in requests for c in r.columns]
    schema = ", ".join(["symbol string", "time bigint", "kind string", *(f"`{c}` double" for c in columns)])

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, blob = state.get if state.exists else (VERSION, None)
        if version != VERSION:
            raise ValueError(f"state of version {version}; this is {VERSION}")
        series = pickle.loads(blob) if blob is not None else Series(requests, history)
        rows = pd.concat(list(batches)).sort_values(["time", "is_final"], ascending=[True, False])
        out = []
        for time, final, *prices in rows[["time", "is_final", *PRICES]].itertuples(index=False):
            row = (int(time), *map(_clean, prices))
            late = series.last is not None and row[0] <= series.last
            if not final:
                found = [] if late else [(row[0], "preview", series.preview(row))]
            elif not late:
                found = [(row[0], "append", series.commit(row))]
            else:
                changed = series.correct(row)
                found = None if changed is None else [(t, "correction", v) for t, v in changed]
            if not found and (found is None or not final):
                found = [(row[0], "rejected", (None,) * len(columns))]
            out += [(str(key[0]), t, kind, *values) for t, kind, values in found]
        state.update((VERSION, pickle.dumps(series)))
        yield pd.DataFrame(out, columns=["symbol", "time", "kind", *columns])

    return bars.groupBy("symbol").applyInPandasWithState(run, schema, "version int, blob binary", "append", GroupStateTimeout.NoTimeout)
