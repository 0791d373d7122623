"""Gaussian states on a line, drawn for many series at once.

Given their variances, all states of a series are one normal vector whose precision is a band.  Cut into
blocks of a few steps it is block tridiagonal, so a draw is a Cholesky factor block by block and a solve
back: some hundred small matrix products for thousands of steps, and the same products serve all series
of a batch.  Shorter series have blocks of ones behind their end, which nothing is coupled with.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

#: The precision of one variance beyond that of another from which a field's digits no longer suffice.
MOST_RATIO = 1e9


def lagged_rows(width: int, entries: Sequence[tuple[int, int, float]]) -> np.ndarray:
    """A row for each step of a block over (block before, block), two states a step, from (lag, state, factor)."""
    rows = np.zeros((width, 4 * width))
    for step in range(width):
        for lag, state, factor in entries:
            rows[step, 2 * (width + step - lag) + state] += factor
    return rows


@dataclass(frozen=True)
class Term:
    """Residuals ``rows @ (block before, block) - target`` of one variance, where ``active`` (block, series, step)."""

    rows: np.ndarray
    active: np.ndarray
    target: np.ndarray


class Field:
    """Draws of (block, series, state) from the terms' variances; ``base`` and ``pull`` are precision and
    precision times mean of what no variance changes."""

    def __init__(self, terms: Sequence[Term], base: np.ndarray, pull: np.ndarray):
        self.terms, self.pull, size = terms, pull, base.shape[-1]
        self.diagonals, self.crosses, self.pushes = [], [], []
        for term in terms:
            before, here = term.rows[:, :size], term.rows[:, size:]
            weighted = np.swapaxes(here * term.active[..., None], -1, -2)
            told = term.active * term.target
            diagonal, push = weighted @ here, told @ here
            if before.any():
                diagonal[:-1] += (np.swapaxes(before * term.active[..., None], -1, -2) @ before)[1:]
                push[:-1] += (told @ before)[1:]
            self.diagonals.append(diagonal)
            self.crosses.append(weighted @ before if before.any() else None)
            self.pushes.append(push)
        unused = np.einsum("kbii->kbi", base + sum(self.diagonals)) == 0
        self.base = base + np.eye(size) * unused[..., None]

    def draw(self, variances: np.ndarray, z: np.ndarray) -> np.ndarray:
        """States for variances (series, term) and standard normals (block, series, state)."""
        weights = 1 / variances.T
        d, h, c = self.base.copy(), self.pull.copy(), np.zeros_like(self.base)
        for w, diagonal, cross, push in zip(weights, self.diagonals, self.crosses, self.pushes):
            d += diagonal * w[:, None, None]
            h += push * w[:, None]
            if cross is not None:
                c += cross * w[:, None, None]
        h = h[..., None]
        # d keeps the inverted factors, c what couples a block with the factor before it, h the solution so far
        factor, here = None, None
        for k in range(len(d)):
            if k:
                c[k] = couple = c[k] @ factor.mT
                d[k] -= couple @ couple.mT
                h[k] -= couple @ here
            d[k] = factor = np.linalg.inv(np.linalg.cholesky(d[k]))
            h[k] = here = factor @ h[k]
        h += z[..., None]
        for k in range(len(d) - 1, -1, -1):
            if k + 1 < len(d):
                h[k] -= c[k + 1].mT @ here
            h[k] = here = d[k].mT @ h[k]
        return h[..., 0]

    def squares(self, x: np.ndarray) -> np.ndarray:
        """Sums of squared residuals (series, term)."""
        pairs = np.concatenate([np.concatenate([np.zeros_like(x[:1]), x[:-1]]), x], axis=-1)
        return np.stack([np.square((pairs @ t.rows.T - t.target) * t.active).sum((0, 2)) for t in self.terms], axis=1)


class Grid:
    """Where the steps of ragged series stand: step ``t`` from 0 (before the first observation) at place ``lead + t``."""

    def __init__(self, ys: Sequence[np.ndarray], width: int, lead: int):
        self.ys, self.width, self.lead, self.size = ys, width, lead, 2 * width
        self.blocks = [-(-(lead + len(y) + 1) // width) for y in ys]
        self.shape = (max(self.blocks), len(ys), width)
        values = np.full((len(ys), self.shape[0] * width), np.nan)
        moved = np.zeros_like(values)
        for i, y in enumerate(ys):
            values[i, lead + 1 : lead + 1 + len(y)] = y
            moved[i, lead + 1 : lead + 1 + len(y)] = 1
        self.moved, seen = self._blocked(moved), self._blocked(values)
        self.seen, self.values = (~np.isnan(seen)).astype(float), np.nan_to_num(seen)

    def _blocked(self, rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(rows.reshape(len(self.ys), -1, self.width).swapaxes(0, 1))

    def move(self, entries) -> Term:
        """Residuals of the states' moves: expected to be 0 at each step."""
        return Term(lagged_rows(self.width, entries), self.moved, np.zeros(self.shape))

    def observe(self, entries) -> Term:
        return Term(lagged_rows(self.width, entries), self.seen, self.values)

    def base(self, precision: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Precision and pull of the first places' states, alike for all series; the others have none."""
        first, n = np.zeros(self.size), len(mean)
        base = np.zeros((*self.shape[:2], self.size, self.size))
        base[0, :, :n, :n] = precision
        first[:n] = precision @ mean
        pull = np.zeros((*self.shape[:2], self.size))
        pull[0] = first
        return base, pull

    def normals(self, i: int, rng: np.random.Generator) -> np.ndarray:
        out = np.zeros((self.shape[0], self.size))
        out[: self.blocks[i]] = rng.standard_normal((self.blocks[i], self.size))
        return out

    def places(self, x: np.ndarray, i: int) -> np.ndarray:
        """The states of one series, (place, state)."""
        return x[:, i].reshape(-1, 2)[: self.lead + len(self.ys[i]) + 1]

    def put(self, x: np.ndarray, i: int, places: np.ndarray) -> None:
        flat = np.zeros((self.shape[0] * self.width, 2))
        flat[: len(places)] = places
        x[:, i] = flat.reshape(self.shape[0], self.size)
