"""NUTS and HMC over compiled models, in numpy.

For Gaussian likelihoods a chain gets sums instead of rows, so its cost doesn't depend on the number
of rows, and a task steps the chains of many datasets together, as arrays.  Random numbers come from
(seed, dataset, chain, iteration) and never from a partition or from the chains beside one.
"""

from __future__ import annotations

import json
import math
import os
import zlib
from collections.abc import Iterator
from multiprocessing.connection import Client, Listener

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.model import DISCRETE, PRIORS, InferenceError, Model

#: Values of a dataset (different rows times columns) that one task holds where the likelihood needs rows;
#: a larger dataset stays where its blocks are, and tasks exchange sums.
TASK_VALUES = 5_000_000
#: Blocks that rows are dealt into: sums are made in a block, then over blocks.
BLOCKS = 64
#: Rows times chains that are worked on at once.
AT_ONCE = 1 << 20
MOST_ENERGY = 1000.0
#: Chains that a task steps together, and numbers that their draws or sums may take.
TOGETHER, MOST_NUMBERS = 1024, 4_000_000


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, float)
    out = np.zeros_like(x)
    while (low := x < 8).any():
        out = np.where(low, out - 1 / np.where(low, x, 1), out)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Γ of positive numbers: Stirling's series from 8 on, steps down from there."""
    x = np.array(x, float)
    down = np.zeros_like(x)
    while (low := x < 8).any():
        down = np.where(low, down + np.log(np.where(low, x, 1)), down)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    series = (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y / 1188)))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series - down


def _softplus(x):
    return np.logaddexp(0, x)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(x)))


def _likelihood(kind: str, y, eta, scale):
    """Log density of each row (last axis) for each chain, and its derivatives by eta and by the scale (a column)."""
    if kind in ("normal", "log_normal"):
        v = np.log(np.maximum(y, 1e-300)) if kind == "log_normal" else y
        z = (v - eta) / scale
        base = -0.5 * z * z - (np.log(scale) + 0.5 * math.log(2 * math.pi)) - (v if kind == "log_normal" else 0)
        return base, z / scale, (z * z - 1) / scale
    if kind == "bernoulli":
        return y * eta - _softplus(eta), y - _sigmoid(eta), None
    mu = np.exp(np.minimum(eta, 700))
    if kind == "poisson":
        return y * eta - mu - _lgamma(y + 1), y - mu, None
    if kind == "exponential":
        return eta - y * mu, 1 - y * mu, None
    a = scale
    both = np.logaddexp(np.log(a), eta)  # log(a + mu) wherever mu itself would overflow
    value = _lgamma(y + a) - _lgamma(a) - _lgamma(y + 1) + a * (np.log(a) - both) + y * (eta - both)
    by_a = digamma(y + a) - digamma(a) + np.log(a) + 1 - both - (y + a) / (a + mu)
    return value, a * (y - mu) / (a + mu), by_a


def _centred(n, *sums) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n, means and centred products, a row for each dataset, from those or from plain sums with a first column of 1."""
    n = np.atleast_1d(np.asarray(n, float))
    if len(sums) == 1:
        gram = sums[0] if sums[0].ndim == 3 else sums[0][None]
        mean = gram[:, 0, 1:] / n[:, None]
        return n, mean, gram[:, 1:, 1:] - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    mean, cross = sums
    return n, np.atleast_2d(mean), cross if cross.ndim == 3 else cross[None]


class Target:
    """Log density and gradient of a model on the raw scale, a row of ``raw`` for each chain.

    ``rows`` are of one dataset, and ``weight`` tells how often each occurs (once without it); ``stats``
    (n, means and centred products for each likelihood, or n and plain sums) are of one dataset, or of one
    for each chain.  Rows may be in blocks that begin at ``starts``; where other tasks hold more of the
    dataset's blocks, ``gather`` turns the own blocks' sums into the sums of all."""

    def __init__(self, model: Model, rows: dict[str, np.ndarray] | None = None, stats: list | None = None, weight: np.ndarray | None = None, starts: np.ndarray | None = None, gather=None):
        self.model, self.rows = model, rows
        n = len(next(iter(rows.values()))) if rows else 0
        self.weight = np.ones(n) if weight is None else weight
        self.starts = np.zeros(1 if n else 0, int) if starts is None else starts
        self.gather = gather
        self.stats = stats and [_centred(*x) for x in stats]
        self.places = []
        for like in model.likelihoods if stats else []:
            at = {c: k for k, c in enumerate(model.design(like))}
            self.places.append([0 if kind in ("const", "param") else at[column, None, None] if kind == "coef" else [at[column, None, k] for k in range(model.matrix_keys[column])] for kind, _, column, _ in like.terms])

    def values(self, raw: np.ndarray) -> dict[str, np.ndarray]:
        out: dict = {}
        for p in self.model.priors:
            a, b = self.model.spans[p.name]
            z = raw[..., a:b] if p.size else raw[..., a]
            if p.centred_by:
                mu, sigma = (out[x] if isinstance(x, str) else x for x in p.args)
                out[p.name] = mu + sigma * z
                continue
            kind = PRIORS[p.kind][0]
            if kind == "exp":
                z = np.exp(np.minimum(z, 700))
            elif kind != "identity":
                z = _sigmoid(z)
                z = p.args[0] + (p.args[1] - p.args[0]) * z if kind == "bounded" else z
            out[p.name] = z
        return out

    def _prior(self, p, z, x):
        """Log density of the raw value with its Jacobian, up to nothing, and its gradient."""
        if p.centred_by:
            return -0.5 * z * z - 0.5 * math.log(2 * math.pi), -z
        a = p.args
        if p.kind == "normal":
            d = (x - a[0]) / a[1]
            return -0.5 * d * d - math.log(a[1]) - 0.5 * math.log(2 * math.pi), -d / a[1]
        if p.kind == "half_normal":
            d = x / a[0]
            return 0.5 * math.log(2 / math.pi) - math.log(a[0]) - 0.5 * d * d + z, 1 - d * d
        if p.kind == "exponential":
            return math.log(a[0]) - a[0] * x + z, 1 - a[0] * x
        if p.kind == "gamma":
            return a[0] * math.log(a[1]) - math.lgamma(a[0]) + a[0] * z - a[1] * x, a[0] - a[1] * x
        if p.kind == "log_normal":
            d = (z - a[0]) / a[1]
            return -0.5 * d * d - math.log(a[1]) - 0.5 * math.log(2 * math.pi), -d / a[1]
        if p.kind == "student_t":
            nu, mu, s = a
            d = (x - mu) / s
            const = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi) - math.log(s)
            return const - (nu + 1) / 2 * np.log1p(d * d / nu), -(nu + 1) * d / (s * (nu + d * d))
        s = _sigmoid(z)
        if p.kind == "uniform":
            return -_softplus(-z) - _softplus(z), 1 - 2 * s
        norm = math.lgamma(a[0] + a[1]) - math.lgamma(a[0]) - math.lgamma(a[1])
        return norm - a[0] * _softplus(-z) - a[1] * _softplus(z), a[0] - (a[0] + a[1]) * s

    def _from_sums(self, i: int, like, x: dict, scale: np.ndarray, at: np.ndarray | slice):
        n, mean, cross = (v[at] if len(v) > 1 else v for v in self.stats[i])
        coef, shift = np.zeros((len(scale), mean.shape[-1])), np.zeros(len(scale))
        for (kind, name, _, c), k in zip(like.terms, self.places[i]):
            if kind != "const":
                coef[:, k] += x[name]
            else:
                shift += c
        # residuals are their mean (constants go first, where they take the offset away) and deviations from it
        middle = (mean[:, -1] - shift) - coef[:, 0] - (coef[:, 1:] * mean[:, :-1]).sum(1)
        v = np.concatenate([-coef[:, 1:], np.ones((len(coef), 1))], 1)
        moved = np.matmul(cross, v[:, :, None])[:, :, 0]
        rss = n * middle**2 + np.maximum((v * moved).sum(1), 0.0)
        value = -0.5 * rss / scale**2 - n * (np.log(scale) + 0.5 * math.log(2 * math.pi))
        pull = (n * middle)[:, None]
        by_coef = np.concatenate([pull, pull * mean[:, :-1] + moved[:, :-1]], 1) / scale[:, None] ** 2
        return value, [by_coef[:, k] for k in self.places[i]], rss / scale**3 - n / scale

    def _from_rows(self, like, x: dict, scale: np.ndarray | None, chains: int):
        """Sums over the blocks' rows, then over blocks in their order: the same numbers however blocks are dealt."""
        width = 1 + sum(1 if kind != "matvec" else self.rows[column].shape[1] for kind, _, column, _ in like.terms if kind != "const") + (scale is not None)
        parts = np.zeros((len(self.starts), chains, width))
        bounds = [*self.starts.tolist(), len(self.weight)]
        first = 0
        while first < len(self.starts):  # as many blocks at a time as keep arrays small
            last = first + 1
            while last < len(self.starts) and (bounds[last + 1] - bounds[first]) * chains <= AT_ONCE:
                last += 1
            rows = slice(bounds[first], bounds[last])
            self._blocks(like, x, scale, chains, rows, self.starts[first:last] - bounds[first], parts[first:last])
            first = last
        total = parts.sum(0) if self.gather is None else self.gather(parts)
        pulls, k = [], 1
        for kind, _, column, _ in like.terms:
            if kind == "const":
                pulls.append(0.0)
                continue
            size = self.rows[column].shape[1] if kind == "matvec" else 1
            pulls.append(total[:, k : k + size] if kind == "matvec" else total[:, k])
            k += size
        return total[:, 0], pulls, total[:, -1] if scale is not None else np.zeros(chains)

    def _blocks(self, like, x: dict, scale, chains: int, rows: slice, starts: np.ndarray, out: np.ndarray) -> None:
        y, weight = self.rows[like.key][rows], self.weight[rows]
        eta = np.zeros((chains, len(y)))
        for kind, name, column, c in like.terms:
            if kind == "const":
                eta += c
            elif kind == "param":
                eta += x[name][:, None]
            elif kind == "matvec":
                eta += np.einsum("nk,ck->cn", self.rows[column][rows], x[name])
            else:
                eta += x[name][:, None] * self.rows[column][rows]
        value, by_eta, by_scale = _likelihood(like.kind, y, eta, None if scale is None else scale[:, None])
        summed = lambda v: np.add.reduceat(np.ascontiguousarray(v * weight), starts, 1).T  # noqa: E731  (block, chain)
        out[:, :, 0], k = summed(value), 1
        by_eta = by_eta * np.ones_like(eta)
        for kind, _, column, _ in like.terms:
            if kind == "param":
                out[:, :, k] = summed(by_eta)
                k += 1
            elif kind == "coef":
                out[:, :, k] = summed(by_eta * self.rows[column][rows])
                k += 1
            elif kind == "matvec":
                size = self.rows[column].shape[1]
                for j in range(size):
                    out[:, :, k + j] = summed(by_eta * self.rows[column][rows, j])
                k += size
        if scale is not None:
            out[:, :, -1] = summed(by_scale)

    def __call__(self, raw: np.ndarray, at: np.ndarray | slice = slice(None)) -> tuple:
        """Density and gradient of the chains ``at`` (all), of which ``raw`` has the rows; one row alone gives a number."""
        if raw.ndim == 1:
            value, grad = self(raw[None])
            return float(value[0]), grad[0]
        m, x, chains = self.model, self.values(raw), len(raw)
        total, bad = np.zeros(chains), np.zeros(chains, bool)
        by_value = {p.name: np.zeros((chains, p.size) if p.size else chains) for p in m.priors}
        for i, like in enumerate(m.likelihoods):
            scale = x[like.scale] if isinstance(like.scale, str) else None if like.scale is None else np.full(chains, float(like.scale))
            if scale is not None:
                bad |= ~((scale > 0) & np.isfinite(scale))
                scale = np.where(bad, 1.0, scale)
            value, pulls, by_scale = self._from_rows(like, x, scale, chains) if self.stats is None else self._from_sums(i, like, x, scale, at)
            total += value
            for (kind, name, _, _), pull in zip(like.terms, pulls):
                if kind != "const":
                    by_value[name] = by_value[name] + pull
            if isinstance(like.scale, str):
                by_value[like.scale] = by_value[like.scale] + by_scale
        grad = np.zeros_like(raw)
        for p in reversed(m.priors):
            a, b = m.spans[p.name]
            z = raw[:, a:b] if p.size else raw[:, a]
            value, by_raw = self._prior(p, z, x[p.name])
            total += value.sum(1) if p.size else value
            g = by_value[p.name]
            if p.centred_by:
                mu, sigma = p.args
                if isinstance(mu, str):
                    by_value[mu] = by_value[mu] + g
                if isinstance(sigma, str):
                    by_value[sigma] = by_value[sigma] + g * z
                step = x[sigma] if isinstance(sigma, str) else sigma
            else:
                kind = PRIORS[p.kind][0]
                s = _sigmoid(z)
                step = 1.0 if kind == "identity" else x[p.name] if kind == "exp" else s * (1 - s) * (p.args[1] - p.args[0] if kind == "bounded" else 1.0)
            grad[:, a:b] = (by_raw + g * step).reshape(chains, -1)
        bad |= ~(np.isfinite(total) & np.isfinite(grad).all(1))
        return np.where(bad, -math.inf, total), grad


# --- random numbers -------------------------------------------------------------------------------------

_U = np.uint64


def _mixed(z: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


class Streams:
    """Random numbers by (chain's key, iteration, place), the same whichever chains run together."""

    #: First places of leaves and of doublings; a momentum's come before.
    LEAF, LEVEL = 1 << 32, 1 << 40

    def __init__(self, seeds: list[tuple[int, int]]):
        numbers = np.array([[a & 0xFFFFFFFFFFFFFFFF, b] for a, b in seeds], _U)
        self.keys = _mixed(_mixed(numbers[:, 0] + _U(0x9E3779B97F4A7C15)) + numbers[:, 1])

    def uniform(self, iteration: int, place: int, n: int = 1, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = _mixed(self.keys[at] + np.array([iteration + 1], _U) * _U(0xD1B54A32D192ED03))[:, None]
        z = _mixed(z + np.arange(place + 1, place + n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
        return ((z >> _U(11)).astype(float) + 0.5) * 2.0**-53

    def normal(self, iteration: int, n: int) -> np.ndarray:
        u = self.uniform(iteration, 0, 2 * n)
        return np.sqrt(-2 * np.log(u[:, :n])) * np.cos(2 * math.pi * u[:, n:])


# --- adaptation -----------------------------------------------------------------------------------------


class DualAveraging:
    """Step sizes that bring each chain's acceptance to ``target``."""

    def __init__(self, step: np.ndarray, target: float):
        self.target = target
        self.restart(step)

    def restart(self, step: np.ndarray) -> None:
        self.mu, self.t, self.log_step = np.log(10 * step), 0, np.log(step)
        self.h, self.log_bar = np.zeros(len(step)), np.zeros(len(step))

    def update(self, accept: np.ndarray) -> None:
        self.t += 1
        share = 1 / (self.t + 10)
        self.h = (1 - share) * self.h + share * (self.target - accept)
        self.log_step = self.mu - math.sqrt(self.t) / 0.05 * self.h
        power = self.t**-0.75
        self.log_bar = power * self.log_step + (1 - power) * self.log_bar


class Metric:
    """Each chain's inverse mass: dense for few parameters, else diagonal, from draws in the adaptation windows."""

    DENSE = 512

    def __init__(self, chains: int, n: int):
        self.n, self.dense = n, n <= self.DENSE
        self.inverse = np.tile(np.eye(n), (chains, 1, 1)) if self.dense else np.ones((chains, n))
        self.root = self.inverse.copy()
        self.clear()

    def clear(self) -> None:
        self.count, self.mean, self.square = 0, np.zeros((len(self.root), self.n)), np.zeros_like(self.root)

    def add(self, q: np.ndarray) -> None:
        self.count += 1
        d = q - self.mean
        self.mean = self.mean + d / self.count
        e = q - self.mean
        self.square += d[:, :, None] * e[:, None, :] if self.dense else d * e

    def update(self) -> None:
        if self.count < 3:
            return
        n = self.count
        var = self.square / (n - 1)
        shrunk, floor = n / (n + 5), 1e-3 * 5 / (n + 5)
        if self.dense:
            self.inverse = shrunk * (var + var.transpose(0, 2, 1)) / 2 + 1.001 * floor * np.eye(self.n)
            self.root = np.linalg.inv(np.linalg.cholesky(self.inverse)).transpose(0, 2, 1)  # of the very matrix that energies use
        else:
            self.inverse = shrunk * var + floor
            self.root = 1 / np.sqrt(self.inverse)
        self.clear()

    def momentum(self, z: np.ndarray) -> np.ndarray:
        return np.matmul(self.root, z[:, :, None])[:, :, 0] if self.dense else self.root * z

    def velocity(self, p: np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        return np.matmul(self.inverse[at], p[:, :, None])[:, :, 0] if self.dense else self.inverse[at] * p

    def energy(self, p: np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        return 0.5 * (p * self.velocity(p, at)).sum(1)


def windows(warmup: int) -> tuple[int, set[int]]:
    """First iteration of the adaptation of the metric, and the last iterations of its windows: 25, 50, 100, ..."""
    first, final = min(75, warmup * 15 // 100), min(50, warmup // 10)
    ends, at, size = set(), first, 25
    while at < warmup - final:
        end = at + size
        if end + 2 * size > warmup - final:
            end = warmup - final
        ends.add(end - 1)
        at, size = end, 2 * size
    return first, ends


def leapfrog(target, metric: Metric, q, p, g, step: np.ndarray, at: np.ndarray | slice = slice(None)):
    half = 0.5 * step[:, None]
    p = p + half * g
    q = q + step[:, None] * metric.velocity(p, at)
    value, g = target(q, at)
    return q, p + half * g, value, g


def first_step(target, metric: Metric, q, value, g, streams: Streams, iteration: int) -> np.ndarray:
    """Doubled or halved from 1 until a step's acceptance crosses one half, for each chain."""
    step, direction, open_ = np.ones(len(q)), np.zeros(len(q), int), np.arange(len(q))
    for k in range(50):
        p = metric.momentum(streams.normal((iteration + 1 << 32) + k, metric.n))[open_]
        _, p2, v2, _ = leapfrog(target, metric, q[open_], p, g[open_], step[open_], open_)
        change = (v2 - metric.energy(p2, open_)) - (value[open_] - metric.energy(p, open_))
        up = np.isfinite(change) & (change > math.log(0.5))
        crossed = (direction[open_] != 0) & (up != (direction[open_] > 0))
        direction[open_] = np.where(direction[open_] == 0, np.where(up, 1, -1), direction[open_])
        open_ = open_[~crossed]
        if not len(open_):
            break
        step[open_] = np.clip(step[open_] * 2.0 ** direction[open_], 1e-10, 1e3)
    return step


def _turned(q0, p0, q1, p1) -> np.ndarray:
    d = q1 - q0
    return ((d * p0).sum(1) < 0) | ((d * p1).sum(1) < 0)


def nuts_transition(target, metric: Metric, q, value, g, step: np.ndarray, depth: int, streams: Streams, iteration: int) -> tuple:
    """One transition of every chain: trajectories double until an end turns back, draws are chosen by weight.

    A doubling's leaves are made one after another; of its even leaves those are held that begin a
    subtree still open, and an odd leaf is checked against the beginnings of the subtrees it ends.
    The energy error is that of the chosen point; a doubling that turned adds nothing to the depth."""
    n = len(q)
    p = metric.momentum(streams.normal(iteration, metric.n))
    start = metric.energy(p) - value
    ends = {sign: [q.copy(), p.copy(), g.copy()] for sign in (-1, 1)}
    pick, pick_change, weight = [q.copy(), value.copy(), g.copy()], np.zeros(n), np.zeros(n)
    leaves, accepted, reached = np.zeros(n, int), np.zeros(n), np.zeros(n, int)
    divergent, moved, active = np.zeros(n, bool), np.zeros(n, bool), np.arange(n)
    for level in range(depth):
        if not len(active):
            break
        forward = streams.uniform(iteration, streams.LEVEL + 2 * level, 1, active)[:, 0] < 0.5
        sign = np.where(forward, 1.0, -1.0)
        now = [np.where(forward[:, None], right[active], left[active]) for left, right in zip(ends[-1], ends[1])]
        new_weight, new_change = np.full(len(active), -math.inf), np.zeros(len(active))
        new_pick = [x[active] for x in pick]
        held = [[None, None] for _ in range(level + 1)]
        alive = np.arange(len(active))  # places in ``active``
        for leaf in range(1 << level):
            at = active[alive]
            q2, p2, v2, g2 = leapfrog(target, metric, *(x[alive] for x in now), sign[alive] * step[at], at)
            change = metric.energy(p2, at) - v2 - start[at]
            change = np.where(np.isfinite(change), change, math.inf)
            leaves[at] += 1
            accepted[at] += np.exp(-np.maximum(change, 0.0))
            for x, y in zip(now, (q2, p2, g2)):
                x[alive] = y
            wild = change > MOST_ENERGY
            divergent[at[wild]] = True
            total = np.logaddexp(new_weight[alive], -change)
            chosen = ~wild & (np.log(streams.uniform(iteration, streams.LEAF + (1 << level) + leaf, 1, at)[:, 0]) < -change - total)
            for x, y in zip(new_pick, (q2, v2, g2)):
                x[alive[chosen]] = y[chosen]
            new_change[alive[chosen]] = change[chosen]
            new_weight[alive] = total
            back = np.zeros(len(alive), bool)
            top = bin(leaf >> 1).count("1")
            if leaf % 2 == 0:
                for k in (0, 1):
                    if held[top][k] is None:
                        held[top][k] = np.empty_like(now[0])
                    held[top][k][alive] = (q2, p2)[k]
            else:
                ended = (leaf ^ (leaf + 1)).bit_length() - 1  # how many subtrees end here
                for k in range(top - ended + 1, top + 1):
                    first_q, first_p = (x[alive] for x in held[k])
                    lead = sign[alive, None]
                    back |= _turned(lead * first_q, first_p, lead * q2, p2)
            alive = alive[~(wild | back)]
            if not len(alive):
                break
        at = active[alive]
        better = np.log(streams.uniform(iteration, streams.LEVEL + 2 * level + 1, 1, at)[:, 0]) < new_weight[alive] - weight[at]
        for x, y in zip(pick, new_pick):
            x[at[better]] = y[alive[better]]
        pick_change[at[better]] = new_change[alive[better]]
        moved[at[better]] = True
        weight[at] = np.logaddexp(weight[at], new_weight[alive])
        for way in (-1, 1):
            to = alive[sign[alive] == way]
            for x, y in zip(ends[way], now):
                x[active[to]] = y[to]
        turned = _turned(ends[-1][0][at], ends[-1][1][at], ends[1][0][at], ends[1][1][at])
        active = at[~turned]
        reached[active] = level + 1
    return (*pick, accepted / np.maximum(1, leaves), pick_change, divergent, leaves, reached, moved)


def hmc_transition(target, metric: Metric, q, value, g, step: np.ndarray, n: int, streams: Streams, iteration: int) -> tuple:
    p = metric.momentum(streams.normal(iteration, metric.n))
    start, state, v = metric.energy(p) - value, (q, p, g), value
    for _ in range(n):
        q2, p2, v, g2 = leapfrog(target, metric, *state, step)
        state = (q2, p2, g2)
    change = metric.energy(state[1]) - v - start
    change = np.where(np.isfinite(change), change, math.inf)
    accept = np.exp(-np.maximum(change, 0.0))
    moved = streams.uniform(iteration, streams.LEVEL)[:, 0] < accept
    out = (np.where(moved[:, None], state[0], q), np.where(moved, v, value), np.where(moved[:, None], state[2], g))
    return (*out, accept, np.minimum(change, MOST_ENERGY * 10), change > MOST_ENERGY, np.full(len(q), n), None, moved)


def run_chains(target: Target, draws: int, warmup: int, seeds: list[tuple[int, int]], sampler="nuts", step_size=0.0, target_accept=0.8, max_tree_depth=10, num_leapfrog_steps=15):
    """Raw draws (chain, draw, parameter), and for each iteration the telemetry as arrays over chains."""
    with np.errstate(all="ignore"):  # overflow is a divergence, which is reported
        return _run_chains(target, draws, warmup, seeds, sampler, step_size, target_accept, max_tree_depth, num_leapfrog_steps)


def _run_chains(target, draws, warmup, seeds, sampler, step_size, target_accept, max_tree_depth, num_leapfrog_steps):
    streams, chains, n = Streams(seeds), len(seeds), target.model.n_params
    q = np.zeros((chains, n))
    value, g = target(q)
    if not np.isfinite(value).all():
        raise InferenceError("the log density and its gradient must be finite where all raw parameters are 0")
    metric = Metric(chains, n)
    step = np.full(chains, float(step_size)) if step_size else first_step(target, metric, q, value, g, streams, 0)
    tuning = DualAveraging(step, target_accept)
    first, ends = windows(warmup)
    kept, told = np.empty((chains, draws, n)), []
    for i in range(warmup + draws):
        go, size = (nuts_transition, max_tree_depth) if sampler == "nuts" else (hmc_transition, num_leapfrog_steps)
        q, value, g, accept, change, divergent, leaves, reached, moved = go(target, metric, q, value, g, step, size, streams, i)
        told.append((moved, accept, change, divergent, step, leaves, reached))
        if i >= warmup:
            kept[:, i - warmup] = q
            continue
        if not step_size:
            tuning.update(accept)
            step = np.exp(tuning.log_step)
        if i >= first:
            metric.add(q)
        if i in ends:
            metric.update()
            if not step_size:
                step = first_step(target, metric, q, value, g, streams, i + 1)
                tuning.restart(step)
        if i == warmup - 1 and not step_size and tuning.t:
            step = np.exp(tuning.log_bar)
    return kept, told


# --- over DataFrames -------------------------------------------------------------------------------------

DRAWS = "dataset_id string, chain int, draw int, param string, idx int, value double"
TRANSITIONS = "dataset_id string, chain int, iter int, is_warmup boolean, accepted boolean, accept_prob double, energy_error double, divergent boolean, step_size double, num_leapfrog_steps int, tree_depth int"


def check_options(chains, draws, warmup, step_size, target_accept, max_tree_depth, num_leapfrog_steps) -> None:
    for ok, what in (
        (min(chains, draws, warmup) >= 1, "chains, draws and warmup must be 1 or more"), (step_size >= 0, "step_size must be 0 or more"), (0 < target_accept < 1, "target_accept must lie between 0 and 1"),
        (1 <= max_tree_depth <= 63, "max_tree_depth must lie between 1 and 63"), (num_leapfrog_steps >= 1, "num_leapfrog_steps must be 1 or more"),
    ):
        if not ok:
            raise InferenceError(what)


def sample(model: Model, data: DataFrame | None, chains=4, draws=1000, warmup=500, seed=42, step_size=0.0, target_accept=0.8, sampler="nuts", max_tree_depth=10, num_leapfrog_steps=15, shared: DataFrame | None = None, what="draws", strict=False, task_values=TASK_VALUES, most_tasks: int | None = None) -> DataFrame:
    """Draws (or, with ``what="transitions"``, telemetry) of every dataset of ``data`` and chain.

    Gaussian models aggregate first.  Other likelihoods keep a dataset's different rows, with how often each
    occurs: up to ``task_values`` values they go to each of its chains; a larger dataset is dealt over the tasks
    of a barrier stage (``most_tasks`` at most, and no more than the cluster runs at once), which step all chains
    together and exchange the sums of their blocks at each step.  Both add up the same blocks in the same order,
    so draws depend neither on the way nor on the number of tasks.  A barrier stage that loses a task is run again.
    """
    check_options(chains, draws, warmup, step_size, target_accept, max_tree_depth, num_leapfrog_steps)
    if sampler not in ("nuts", "hmc"):
        raise InferenceError(f"sampler {sampler!r} is unknown")
    if any(p.kind in DISCRETE for p in model.priors):
        raise InferenceError("discrete priors serve prior predictive draws alone")
    names = [(p.name, k) for p in model.priors for k in ([None] if p.size is None else range(p.size))]
    options = {"sampler": sampler, "step_size": step_size, "target_accept": target_accept, "max_tree_depth": max_tree_depth, "num_leapfrog_steps": num_leapfrog_steps}

    def emit(datasets: list[str], of_chain: list[int], target: Target) -> pd.DataFrame:
        raw, told = run_chains(target, draws, warmup, [(seed + c, zlib.crc32(d.encode())) for d, c in zip(datasets, of_chain)], **options)
        if what == "transitions":
            n, it = len(told), np.arange(warmup + draws)
            moved, accept, change, divergent, step, leaves, reached = ([row[k] for row in told] for k in range(7))
            flat = lambda x: np.stack(x, 1).ravel()  # noqa: E731  chain by chain
            return pd.DataFrame({
                "dataset_id": np.repeat(datasets, n), "chain": np.repeat(of_chain, n), "iter": np.tile(it, len(datasets)), "is_warmup": np.tile(it < warmup, len(datasets)), "accepted": flat(moved), "accept_prob": flat(accept),
                "energy_error": flat(change), "divergent": flat(divergent), "step_size": flat(step), "num_leapfrog_steps": flat(leaves), "tree_depth": None if reached[0] is None else flat(reached),
            })
        values = np.concatenate([v if v.ndim == 3 else v[:, :, None] for v in target.values(raw).values()], 2)
        k = len(names)
        return pd.DataFrame({
            "dataset_id": np.repeat(datasets, draws * k), "chain": np.repeat(of_chain, draws * k), "draw": np.tile(np.repeat(np.arange(draws), k), len(datasets)),
            "param": [n if i is None else f"{n}[{i}]" for n, i in names] * (draws * len(datasets)), "idx": pd.array([i for _, i in names] * (draws * len(datasets)), dtype="Int32"), "value": values.ravel(),
        })

    schema = TRANSITIONS if what == "transitions" else DRAWS
    if data is None:
        from pyspark.sql import SparkSession

        one = SparkSession.active().range(chains).select(F.lit("0").alias("dataset_id"), F.col("id").cast("int").alias("chain"))
        return one.groupBy("dataset_id", "chain").applyInPandas(lambda pdf: emit(["0"], [int(pdf["chain"].iloc[0])], Target(model, {})), schema)
    bound = model.bind(data, shared, strict)
    chain = F.explode(F.sequence(F.lit(0), F.lit(chains - 1))).alias("chain")
    if model.gaussian:
        stats = model.gaussian_stats(bound).select("*", chain)
        sizes = [len(model.design(x)) for x in model.likelihoods]

        together = max(1, min(TOGETHER, MOST_NUMBERS // max(sum(k * k for k in sizes), (draws if what == "draws" else 1) * max(1, len(names)))))

        def from_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for start in range(0, len(whole), together):
                    pdf, held = whole.iloc[start : start + together], []
                    for i, k in enumerate(sizes):
                        cross, upper = np.zeros((len(pdf), k, k)), np.triu_indices(k)
                        cross[:, upper[0], upper[1]] = cross[:, upper[1], upper[0]] = np.stack(pdf[f"s{i}"].to_numpy())
                        held.append((pdf["n"].to_numpy(float), np.stack(pdf[f"m{i}"].to_numpy()), cross))
                    yield emit(pdf["dataset_id"].tolist(), pdf["chain"].tolist(), Target(model, stats=held))

        tasks = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return stats.repartition(tasks, "dataset_id", "chain").mapInPandas(from_sums, schema)
    keys = [k for k in model.required_keys]
    rows = bound.groupBy("dataset_id", *keys).agg(F.count("*").alias("rows$n")).withColumn("rows$block", F.pmod(F.xxhash64(*keys), F.lit(BLOCKS)).cast("int"))
    width = len(keys) - len(model.matrix_keys) + sum(model.matrix_keys.values())
    large = sorted(r["dataset_id"] for r in rows.groupBy("dataset_id").count().where(F.col("count") * width > task_values).collect())

    def from_rows(pdf: pd.DataFrame) -> pd.DataFrame:
        held, weight, _, starts = arranged(model, pdf)
        return emit([pdf["dataset_id"].iloc[0]], [int(pdf["chain"].iloc[0])], Target(model, held, weight=weight, starts=starts))

    small = rows.where(~F.coalesce(F.col("dataset_id").isin(large), F.lit(False))) if large else rows
    out = small.select("*", chain).groupBy("dataset_id", "chain").applyInPandas(from_rows, schema)
    if not large:
        return out

    def in_step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """All chains of each large dataset, in every task at once; a task gives the draws of its share of chains."""
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        mine, tasks = pd.concat([*batches, pd.DataFrame()]), len(context.getTaskInfos())
        sums = Gather(context)
        for dataset in large:
            own = mine[mine["dataset_id"] == dataset] if len(mine) else mine
            held, weight, blocks, starts = arranged(model, own)
            target = Target(model, held, weight=weight, starts=starts, gather=sums.of(blocks))
            got = emit([dataset] * chains, list(range(chains)), target)
            yield got[got["chain"] % tasks == context.partitionId()]
        sums.close()

    # a barrier stage needs all its tasks at once; blocks don't outnumber them
    tasks = max(1, min(BLOCKS, data.sparkSession.sparkContext.defaultParallelism, int(most_tasks or BLOCKS)))
    spread = rows.where(F.col("dataset_id").isin(large)).repartition(tasks, "rows$block")
    # draws are dealt out anew: a barrier stage can't be part of a union
    return out.unionByName(spread.mapInPandas(in_step, schema, barrier=True).repartition(tasks, "dataset_id", "chain"))


def arranged(model: Model, pdf: pd.DataFrame) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """A dataset's different rows in an order of their own (block, then values): columns, weights, blocks and where they begin."""
    if not len(pdf):
        none = {k: np.zeros((0, model.matrix_keys[k])) if k in model.matrix_keys else np.zeros(0) for k in model.required_keys}
        return none, np.zeros(0), np.zeros(0, int), np.zeros(0, int)
    rows = {k: np.stack(pdf[k].to_numpy()).astype(float) if k in model.matrix_keys else pdf[k].to_numpy(float) for k in model.required_keys}
    block = pdf["rows$block"].to_numpy(int)
    columns = [c for v in rows.values() for c in (v.T if v.ndim == 2 else [v])]
    order = np.lexsort([*columns, block])
    blocks, starts = np.unique(block[order], return_index=True)
    return {k: np.ascontiguousarray(v[order]) for k, v in rows.items()}, pdf["rows$n"].to_numpy(float)[order], blocks, starts


class Gather:
    """Adds up the sums of all tasks' blocks, in the order of the blocks, and gives them to each task.

    Tasks of a barrier stage tell each other where the first one listens and talk to it from then on: the
    barrier's own ``allGather`` waits for a second each time.  A lost task ends the connections, with them the
    other tasks, and Spark runs the stage again."""

    def __init__(self, context):
        self.first, others = context.partitionId() == 0, len(context.getTaskInfos()) - 1
        if not self.first:
            host, port, key = json.loads(context.allGather("")[0])
            self.links = [Client((host, port), authkey=bytes.fromhex(key))]
            return
        key = os.urandom(16)
        with Listener(("", 0), backlog=max(1, others), authkey=key) as listener:
            host = context.getTaskInfos()[0].address.rsplit(":", 1)[0]
            context.allGather(json.dumps([host, listener.address[1], key.hex()]))
            self.links = [listener.accept() for _ in range(others)]

    def of(self, blocks: np.ndarray):
        """What adds up the blocks of one dataset, of which this task holds ``blocks``."""

        def add(parts: np.ndarray) -> np.ndarray:
            if not self.first:
                self.links[0].send((blocks, parts))
                return self.links[0].recv()
            said = [(blocks, parts), *[link.recv() for link in self.links]]
            order = np.argsort(np.concatenate([b for b, _ in said]), kind="stable")
            total = np.concatenate([p for _, p in said])[order].sum(0)
            for link in self.links:
                link.send(total)
            return total

        return add

    def close(self) -> None:
        for link in self.links:
            link.close()


def sample_many(models: dict[str, tuple[Model, DataFrame]], **options) -> DataFrame:
    """Draws of different models, each over its own data, with model_id."""
    out = None
    for name, (model, data) in models.items():
        got = sample(model, data, **({"chains": 1, "draws": 500, "warmup": 300, "max_tree_depth": 8} | options)).withColumn("model_id", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out
