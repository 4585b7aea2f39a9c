"""Genome states in context spectra: what states are, and the elastic-net Poisson regression of their effects.

A state is the tuple of a locus' strand and label features, seen from the strand of the configuration. A component's log effect of a context in a
state is the context's own, plus effects of the state's features that all contexts share, plus those of the feature on this context alone. The
sufficient statistics are sums by (context, state) that Spark makes; the regression works on this table of contexts x states.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from genolith.operators.features import mesoscale_state

#: Classes that stand for "nothing": they have no effect of their own.
NULLS = (0, ".", "None", "none")


@dataclass
class States:
    """strands: columns with -1, 0 or 1; labels: columns and their classes."""

    strands: list[str] = field(default_factory=list)
    labels: dict[str, list[str]] = field(default_factory=dict)

    def _classes(self) -> list[tuple[str, list]]:
        return [*((s, [-1, 0, 1]) for s in self.strands), *self.labels.items()]

    def combinations(self) -> list[tuple]:
        """All states, the last feature fastest."""
        return list(itertools.product(*[c for _, c in self._classes()]))

    def _columns(self) -> list[tuple[int, str, object]]:
        return [(i, name, c) for i, (name, classes) in enumerate(self._classes()) for c in classes if c not in NULLS]

    def names(self) -> list[str]:
        return [f"{name}:{c}" for _, name, c in self._columns()]

    def design(self) -> np.ndarray:
        """States x features, 0 or 1: a state has one feature of each column at most."""
        return np.array([[float(combination[i] == c) for i, _, c in self._columns()] for combination in self.combinations()]).reshape(len(self.combinations()), -1)

    def index(self, minus: bool = False) -> Column:
        """The state's number for a locus, seen from the plus or the minus strand."""
        return mesoscale_state([F.col(s).cast("long") for s in self.strands], [(F.col(c), classes) for c, classes in self.labels.items()], minus).cast("int")


def log_effects(own: np.ndarray, shared: np.ndarray, interactions: np.ndarray, design: np.ndarray) -> np.ndarray:
    """Contexts x states."""
    return own[:, None] + (shared[None, :] + interactions) @ design.T


def _soft(x: np.ndarray, by: float) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - by, 0)


def objective(seen: np.ndarray, offset: np.ndarray, own: np.ndarray, shared: np.ndarray, interactions: np.ndarray, design: np.ndarray, alpha: float, l1: float, ridge: float = 1e-9) -> float:
    """Mean negative log likelihood (up to a constant) plus the penalty."""
    eta = log_effects(own, shared, interactions, design)
    live = offset > 0
    loss = np.where(live, offset * np.exp(eta) - seen * eta, 0).sum() / seen.sum()
    coefficients = np.concatenate((shared, interactions.ravel()))
    return float(loss + alpha * (l1 * np.abs(coefficients).sum() + (1 - l1) / 2 * (coefficients**2).sum()) + ridge / 2 * (own**2).sum())


def elastic_net(
    seen: np.ndarray, offset: np.ndarray, design: np.ndarray, start: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, alpha: float = 1e-4, l1: float = 0.5, ridge: float = 1e-9, keep_own: bool = False, tol: float = 1e-9, rounds: int = 200,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own, shared, interactions) that minimise `objective`: seen ~ Poisson(offset * exp(log effects)).

    seen, offset: contexts x states. Reweighted least squares outside, coordinate descent with soft thresholds inside; contexts don't meet in their own
    effects and interactions, so a step takes all of them at once. keep_own: the contexts' own effects stay but for a common constant.
    A step that raises the objective is halved.
    """
    c, r = len(seen), design.shape[1]
    total = seen.sum()
    live = offset > 0
    if start is None:
        level = np.log(max(total, 1e-12) / max(offset.sum(), 1e-300))
        start = np.full(c, level), np.zeros(r), np.zeros((c, r))
    own, shared, interactions = (np.array(x, float) for x in start)
    if total <= 0 or not live.any():
        return own, shared, interactions
    if keep_own:  # the constant's best value, in closed form
        own = own + np.log(total / np.where(live, offset * np.exp(log_effects(own, shared, interactions, design)), 0).sum())
    penalty, quadratic = alpha * l1 * total, alpha * (1 - l1) * total
    value = objective(seen, offset, own, shared, interactions, design, alpha, l1, ridge)
    for _ in range(rounds):
        eta = np.clip(log_effects(own, shared, interactions, design), -700, 700)
        w = np.where(live, offset * np.exp(eta), 0)
        left = np.where(w > 0, (seen - w) / np.maximum(w, 1e-300), 0)  # what the current effects leave over of the working response
        a, g, h = own.copy(), shared.copy(), interactions.copy()
        for _ in range(500):
            before = np.concatenate((a, g, h.ravel()))
            if keep_own:
                step = (w * left).sum() / w.sum()
                a, left = a + step, left - step
            else:
                step = ((w * left).sum(axis=1) - ridge * total * a) / np.maximum(w.sum(axis=1) + ridge * total, 1e-300)
                a, left = a + step, left - step[:, None]
            for j in range(r):
                x = design[:, j]
                curve = w @ x
                for shared_turn in (True, False):
                    if shared_turn:
                        new = _soft((w * left) @ x @ np.ones(c) + curve.sum() * g[j], penalty) / max(curve.sum() + quadratic, 1e-300)
                        left = left - (new - g[j]) * x[None, :]
                        g[j] = new
                    else:
                        new = _soft((w * left) @ x + curve * h[:, j], penalty) / np.maximum(curve + quadratic, 1e-300)
                        left = left - (new - h[:, j])[:, None] * x[None, :]
                        h[:, j] = new
            if np.abs(np.concatenate((a, g, h.ravel())) - before).max() < tol:
                break
        size = 1.0
        while True:
            tried = own + size * (a - own), shared + size * (g - shared), interactions + size * (h - interactions)
            new = objective(seen, offset, *tried, design, alpha, l1, ridge)
            if new <= value + 1e-15 or size < 1e-6:
                break
            size /= 2
        moved = max(np.abs(x - y).max(initial=0) for x, y in zip(tried, (own, shared, interactions), strict=True))
        (own, shared, interactions), value = tried, min(value, new)
        if moved < tol:
            break
    return own, shared, interactions


def state_summary(contexts: Sequence[str], own: np.ndarray, shared: np.ndarray, interactions: np.ndarray, names: Sequence[str]) -> list[tuple[str, str, float]]:
    """(context, state, log effect): the baseline and each feature by itself."""
    rows = [(c, "Baseline", float(own[i])) for i, c in enumerate(contexts)]
    return rows + [(c, n, float(own[i] + shared[j] + interactions[i, j])) for i, c in enumerate(contexts) for j, n in enumerate(names)]
