"""Best-fit packing by linear grouping.

Lengths are whole numbers of at most the capacity, so all that packing needs to
know about any number of documents is a histogram of at most ``capacity`` rows.
The scheme runs on it: large lengths are split into groups of equal cardinality
and rounded up to the longest of their group; a linear program over the bin
configurations of these few sizes is solved by column generation; its whole
multiples become bins that actual lengths of each group are put in; what is left,
and everything small, is placed best-fit by falling length. Runs of equal bins are
handled as one, so the plan is a short list of placements ("lengths l, ranks r to
r+n, go to bins b to b+n at offset o"). Documents get their rank among those of
their length by bucketed counts, and look their placement up.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, cut, numbered
from .tokens import encoder, texts_of

CAPACITY = 4096
#: (groups, n): a length is large if at most n of it fit in a bin; the setting that needs fewest bins is used.
SETTINGS = ((8, 2), (16, 2), (48, 2), (24, 3), (8, 1))
BUCKET_ROWS = 1000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


@dataclass
class Plan:
    """Placements (length, first rank, rows, first bin, offset) and the number of bins."""

    placements: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    bins: int = 0


def best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int, most: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of at most ``most`` sizes that fits."""
    best = np.zeros(capacity + 1)
    picks: list[np.ndarray] = []
    for _ in range(most):
        new, pick = best.copy(), np.full(capacity + 1, -1)
        for j, size in enumerate(sizes.tolist()):
            shifted = best[: capacity + 1 - size] + values[j]
            better = shifted > new[size:] + 1e-12
            new[size:][better] = shifted[better]
            pick[size:][better] = j
        picks.append(pick)
        if np.array_equal(new, best):
            break
        best = new
    counts = np.zeros(len(sizes), int)
    room = capacity
    for pick in reversed(picks):
        j = int(pick[room])
        if j >= 0:
            counts[j] += 1
            room -= int(sizes[j])
    return float(best[capacity]), counts


def fractional_configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, most: int) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used, in an optimum of the linear program."""
    k = len(sizes)
    columns = [np.eye(k, dtype=int)[j] * max(1, capacity // int(sizes[j])) for j in range(k)]
    basis = np.array(columns, float).T
    amount = demand / np.diag(basis)
    for _ in range(60 * k):
        prices = np.linalg.solve(basis.T, np.ones(k))
        value, counts = best_configuration(sizes, np.maximum(prices, 0), capacity, most)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, counts.astype(float))
        usable = step > 1e-9
        if not usable.any():
            break
        ratio = np.where(usable, amount / np.where(usable, step, 1), np.inf)
        out = int(ratio.argmin())
        amount = np.maximum(amount - ratio[out] * step, 0)
        amount[out] = ratio[out]
        basis[:, out] = counts
        columns[out] = counts
    return [(columns[j], float(amount[j])) for j in range(k) if amount[j] > 1e-9]


class _Bins:
    """Runs of bins by the room they have left."""

    def __init__(self, capacity: int, plan: Plan) -> None:
        self.capacity, self.plan = capacity, plan
        self.runs: dict[int, list[list[int]]] = {}
        self.rooms: list[int] = []

    def put(self, room: int, start: int, n: int) -> None:
        if room <= 0:
            return
        if room not in self.runs:
            self.runs[room] = []
            insort(self.rooms, room)
        if self.runs[room] and sum(self.runs[room][-1]) == start:
            self.runs[room][-1][1] += n
        else:
            self.runs[room].append([start, n])

    def best_fit(self, length: int, rank: int, n: int) -> None:
        while n:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                fresh = -(-n // (self.capacity // length))
                self.put(self.capacity, self.plan.bins, fresh)
                self.plan.bins += fresh
                continue
            room = self.rooms[at]
            start, there = self.runs[room][-1]
            take = min(n, there)
            if take == there:
                self.runs[room].pop()
                if not self.runs[room]:
                    del self.runs[room], self.rooms[at]
            else:
                self.runs[room][-1] = [start + take, there - take]
            self.plan.placements.append((length, rank, take, start, self.capacity - room))
            self.put(room - length, start, take)
            rank, n = rank + take, n - take


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, settings: tuple = SETTINGS) -> Plan:
    """A packing of ``histogram[length]`` rows of each length; lengths are 1 to capacity."""
    return min((_grouped(histogram, capacity, groups, most) for groups, most in settings), key=lambda plan: plan.bins)


def _grouped(histogram: dict[int, int], capacity: int, groups: int, most: int) -> Plan:
    plan = Plan()
    bins = _Bins(capacity, plan)
    left = {length: [0, n] for length, n in sorted(histogram.items(), reverse=True) if n > 0}
    large = [length for length in left if length * (most + 1) > capacity and length < capacity]
    if large:
        total = sum(left[x][1] for x in large)
        members: list[list[int]] = [[]]
        seen = 0
        for length in large:
            if members[-1] and seen >= total * len(members) / groups:
                members.append([])
            members[-1].append(length)
            seen += left[length][1]
        sizes = np.array([m[0] for m in members])
        demand = np.array([sum(left[x][1] for x in m) for m in members], float)
        for counts, times in fractional_configurations(sizes, demand, capacity, most):
            n = int(times + 1e-6)
            if n:
                _fill(plan, bins, left, members, counts, n, capacity)
    for length in left:
        bins.best_fit(length, *left[length])
    return plan


def _fill(plan: Plan, bins: _Bins, left: dict, members: list[list[int]], counts: np.ndarray, n: int, capacity: int) -> None:
    """``n`` bins of one configuration, filled with actual lengths of each group, longest first."""
    slots = [j for j in range(len(counts)) for _ in range(counts[j])]
    if not any(left[x][1] for j in slots for x in members[j]):
        return
    runs = [(plan.bins, n, 0)]
    plan.bins += n
    for j in slots:
        after = []
        for start, many, used in runs:
            for length in members[j]:
                rank, there = left[length]
                take = min(many, there)
                if take:
                    plan.placements.append((length, rank, take, start, used))
                    left[length] = [rank + take, there - take]
                    after.append((start, take, used + length))
                    start, many = start + take, many - take
                if not many:
                    break
            if many:
                after.append((start, many, used))
        runs = after
    for start, many, used in runs:
        bins.put(capacity - used, start, many)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Each document's ids with the closing id 1, cut where longer than ``capacity``."""
    closing = np.array([1], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                ids = words.encode(text) + closing
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, i, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, PIECES)


def pack(rows: DataFrame, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """``rows`` with ``sequence_id`` and ``offset``; lengths are 1 to ``capacity``.

    Rows are told apart by all their columns; equal rows may swap places. A null
    length, or one out of bounds, is an error. An empty table gives no rows. Columns
    ``sequence_id`` and ``offset`` of ``rows`` are replaced; others keep their names
    and values. The plan that travels to the workers has a row for each
    run of equal placements; its size depends on the number of different lengths,
    not on the number of documents.
    """
    old_names = [c for c in rows.columns if c not in ("sequence_id", "offset")]
    inner = {c: f"c{i}" for i, c in enumerate(old_names)}  # no name of a column can meet one of those below
    rows = cut(rows.select(*[F.col(f"`{c}`").alias(inner[c]) for c in old_names]))
    length_col = inner[length_col]
    histogram = {r[0]: r[1] for r in rows.groupBy(F.expr(f"least({length_col}, {capacity + 1})")).count().collect()}  # at most ``capacity`` + 2 rows
    if any(x is None or not 1 <= x <= capacity for x in histogram):
        raise ValueError(f"lengths are 1 to {capacity}")
    plan = plan_packing(histogram, capacity)
    table = np.array(plan.placements, np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    place_key = (table[:, 0] << 44) + table[:, 1]
    widths = [buckets_for(histogram.get(i, 1), BUCKET_ROWS) for i in range(capacity + 1)]
    order = [F.col(c) for c in rows.columns]
    bucketed = rows.withColumn(
        "_bucket", F.pmod(F.xxhash64(*rows.columns), F.element_at(F.lit(widths), F.col(length_col).cast("int") + 1))
    )
    ranked = numbered(bucketed, [length_col], "_bucket", order, "_rank").drop("_bucket")
    length_at, rank_at = ranked.columns.index(length_col), ranked.columns.index("_rank")
    kept_at = [ranked.columns.index(inner[c]) for c in old_names]
    names = [*old_names, "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(length_at).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(rank_at).to_numpy(zero_copy_only=False).astype(np.int64) - 1
            at = np.searchsorted(place_key, (length << 44) + rank, side="right") - 1
            hit = table[at]
            kept = [batch.column(i) for i in kept_at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(hit[:, 3] + rank - hit[:, 1]), pa.array(hit[:, 4])], names)

    old = ", ".join(f"`{c}` {rows.schema[inner[c]].dataType.simpleString()}" for c in old_names)
    return ranked.mapInArrow(run, f"{old}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their places; null and empty texts are the closing id alone."""
    return pack(pieces(docs, tokenizer, id_col, text_col))
