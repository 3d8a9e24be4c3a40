"""Optimal and greedy matching in numpy for the groups of a frame or a sequence."""

from __future__ import annotations

import numpy as np


def assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum-cost assignment of a rectangular matrix by shortest augmenting paths with potentials.

    Rows are added one at a time; of equal paths the lowest column is taken. NaN and infinite costs are
    edges that do not exist (J46): they count as more than all others together and are dropped at the end.
    """
    cost = np.asarray(cost, float)
    n, m = cost.shape
    if not n or not m:
        return np.zeros(0, int), np.zeros(0, int)
    if n > m:
        columns, rows = assign(cost.T)
        order = np.argsort(rows)
        return rows[order], columns[order]
    real = np.isfinite(cost)
    if not real.any():
        return np.zeros(0, int), np.zeros(0, int)
    top = np.abs(cost[real]).max() * 2 * m + 1
    full = np.where(real, cost, top)
    least = full.argmin(axis=1)
    if len(set(least.tolist())) == n:  # each row takes its lowest cost, no path is longer than one edge
        some = np.flatnonzero(real[np.arange(n), least])
        return some, least[some]
    row_price, column_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for i in range(n):
        least, before = np.full(m, np.inf), np.full(m, -1)
        done = np.zeros(m, bool)
        row, reached, column = i, 0.0, -1
        while True:
            reduced = reached + full[row] - row_price[row] - column_price
            better = ~done & (reduced < least)
            least[better], before[better] = reduced[better], column
            column = int(np.argmin(np.where(done, np.inf, least)))
            reached = least[column]
            done[column] = True
            if owner[column] < 0:
                break
            row = owner[column]
        for c in np.flatnonzero(done):
            if c != column:
                row_price[owner[c]] += reached - least[c]
                column_price[c] -= reached - least[c]
        row_price[i] += reached
        while column >= 0:
            previous = before[column]
            owner[column] = i if previous < 0 else owner[previous]
            column = previous
    columns = np.flatnonzero(owner >= 0)
    pairs = sorted((int(owner[c]), int(c)) for c in columns if real[owner[c], c])
    return np.array([r for r, _ in pairs], int), np.array([c for _, c in pairs], int)


def assign_sparse(rows: np.ndarray, columns: np.ndarray, worth: np.ndarray) -> np.ndarray:
    """Which pairs an assignment of largest summed worth takes, from a list of pairs; pairs that are not listed are worth nothing.

    Pairs that share no row and no column, directly or over others, cannot disturb each other: the pairs'
    graph is cut into its connected parts, and a matrix is made for one part at a time. A row and a column
    that meet no other are taken as they are. A pair comes once.
    """
    taken = np.zeros(len(worth), bool)
    some = np.flatnonzero(np.asarray(worth) > 0)
    if not len(some):
        return taken
    r, ri = np.unique(np.asarray(rows)[some], return_inverse=True)
    c, ci = np.unique(np.asarray(columns)[some], return_inverse=True)
    label = np.arange(len(r) + len(c))
    while True:  # the least label of a part spreads over its pairs, halving the way by jumps
        least = np.minimum(label[ri], label[len(r) + ci])
        following = label.copy()
        np.minimum.at(following, ri, least)
        np.minimum.at(following, len(r) + ci, least)
        following = following[following]
        if (following == label).all():
            break
        label = following
    part = label[ri]
    order = np.argsort(part, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        if len(group) == 1:
            taken[some[group]] = True
            continue
        a, ai = np.unique(ri[group], return_inverse=True)
        b, bi = np.unique(ci[group], return_inverse=True)
        cost, at = np.zeros((len(a), len(b))), np.full((len(a), len(b)), -1)
        cost[ai, bi], at[ai, bi] = -np.asarray(worth, float)[some[group]], group
        chosen = at[assign(cost)]
        taken[some[chosen[chosen >= 0]]] = True
    return taken


def assign_above(similarity: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs at or above a threshold; a threshold matrix that is one-to-one needs no solver."""
    over = similarity >= least
    if over.any() and over.sum(0).max() <= 1 and over.sum(1).max() <= 1:
        return np.nonzero(over)
    r, c = assign(-similarity)
    keep = similarity[r, c] >= least
    return r[keep], c[keep]


def greedy(similarity: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Predictions (rows) in order take their best unused truth at or above the threshold; the first of equals."""
    used, rows, columns = set(), [], []
    for i in range(similarity.shape[0]):
        best, at = -np.inf, -1
        for j in range(similarity.shape[1]):
            if j not in used and similarity[i, j] >= least and similarity[i, j] > best:
                best, at = similarity[i, j], j
        if at >= 0:
            used.add(at)
            rows.append(i)
            columns.append(at)
    return np.array(rows, int), np.array(columns, int)
