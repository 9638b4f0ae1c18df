"""The quality model on a few rows against naive Bayes ratios and a hinge loss worked out with dictionaries."""

import math
import random
from collections import Counter

import numpy as np

from tidemark.llm import quality


def rows_of(n, seed):
    draw = random.Random(seed)
    good = [draw.random() < 0.6 for _ in range(n)]
    return [np.array(sorted({0, *draw.choices(range(1, 25) if g else range(10, 40), k=draw.randrange(3, 9))})) for g in good], np.array(good)


def plain_weights(rows, good, epochs, cost, seed):
    """Ratio of smoothed shares per feature; then one dual variable at a time, each to its own optimum."""
    counts = {side: Counter(f for r, g in zip(rows, good) if g == side for f in r.tolist()) for side in (True, False)}
    size = {side: quality.DIMENSIONS + sum(counts[side].values()) for side in counts}
    every = {f for r in rows for f in r.tolist()}
    ratio = {f: math.log((counts[True][f] + 1) / size[True]) - math.log((counts[False][f] + 1) / size[False]) for f in every}
    bound = {side: cost * len(rows) / (2 * sum(1 for g in good if g == side)) for side in (True, False)}
    weight, dual, order = dict.fromkeys(every, 0.0), [0.0] * len(rows), np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            x = {f: ratio[f] / math.sqrt(len(rows[i])) for f in rows[i].tolist()}
            sign = 1 if good[i] else -1
            gradient = sign * sum(weight[f] * v for f, v in x.items()) - 1
            best = min(max(dual[i] - gradient / sum(v * v for v in x.values()), 0), bound[bool(good[i])])
            for f, v in x.items():
                weight[f] += (best - dual[i]) * sign * v
            moved, dual[i] = max(moved, abs(best - dual[i])), best
        if moved < 1e-4:
            break
    used = [abs(w) for w in weight.values() if abs(w) > 1e-9]
    mean = sum(used) / len(used)
    mixed = {f: (1 - quality.MEAN_SHARE) * w + quality.MEAN_SHARE * mean * (1 if w > 0 else -1) if abs(w) > 1e-9 else 0.0 for f, w in weight.items()}
    return {f: w * ratio[f] for f, w in mixed.items()}, dual, weight, ratio


def test_weights_as_worked_out_with_dictionaries():
    for seed in range(4):
        rows, good = rows_of(30, seed)
        found = quality.fit_weights(rows, good, epochs=5)
        wanted, _, _, _ = plain_weights(rows, good, 5, quality.COST, 7)
        assert all(abs(found[f] - w) <= 1e-6 for f, w in wanted.items())
        assert set(np.flatnonzero(found)) <= set(wanted)


def test_descent_ends_where_no_row_can_better_its_dual():
    rows, good = rows_of(25, 11)
    _, dual, weight, ratio = plain_weights(rows, good, 4000, quality.COST, 7)
    bound = {side: quality.COST * len(rows) / (2 * sum(1 for g in good if g == side)) for side in (True, False)}
    for row, g, a in zip(rows, good, dual):
        margin = (1 if g else -1) * sum(weight[f] * ratio[f] for f in row.tolist()) / math.sqrt(len(row))
        if a <= 0:
            assert margin >= 1 - 1e-2
        elif a >= bound[bool(g)]:
            assert margin <= 1 + 1e-2
        else:
            assert abs(margin - 1) <= 1e-2


def test_the_score_is_a_logistic_of_the_margin():
    rows, good = rows_of(40, 3)
    model = quality.fit(rows, good, 0.6)
    for row in rows:
        margin = sum(model.weights[f] for f in row.tolist()) / math.sqrt(len(row))
        assert abs(model.score(row) - 1 / (1 + math.exp(-(model.slope * margin + model.shift)))) < 1e-12
    right = sum((model.score(r) >= 0.5) == g for r, g in zip(rows, good))
    assert right >= 36
