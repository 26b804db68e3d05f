"""Weak supervision: expectation-maximisation over counts of vote patterns, in numpy on the driver.

The counts are few however large the corpus is: at most 3 ** labellers for each group of candidates.
"""

from __future__ import annotations

import numpy as np

ABSTAIN, NO, YES = 0, 1, 2


def reliabilities(votes: np.ndarray, counts: np.ndarray, prior: float = 0.5, rounds: int = 60, belief: float = 0.9, strength: float = 5.0, one_sided: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of YES for each pattern, P(right | class, voted) of shape labellers x 2).

    votes: patterns x labellers of ABSTAIN, NO and YES. A labeller starts as right with probability `belief` when it
    votes; `strength` pseudo-counts keep it there where the data are few. To abstain says nothing: a labeller that
    finds one kind of fault does not fire on the others.

    one_sided: labellers that vote for one class alone, of which P(right | class, voted) would tell nothing. Each then
    has one reliability for both classes, that belief holds with twice the weight of its votes, or a labeller whose votes
    no other's meet would drift to the prior; and the prior, which such votes can't tell either, stays as given.
    """
    right = np.full((votes.shape[1], 2), belief)
    posterior = np.full(len(votes), prior)
    no, yes = (votes == NO).astype(float), (votes == YES).astype(float)
    for _ in range(rounds):
        low, high = np.log(right), np.log(1 - right)
        against = np.log(1 - prior) + no @ low[:, 0] + yes @ high[:, 0]
        favour = np.log(prior) + yes @ low[:, 1] + no @ high[:, 1]
        posterior = 1 / (1 + np.exp(np.clip(against - favour, -60, 60)))
        if one_sided:
            good = (counts * posterior) @ yes + (counts * (1 - posterior)) @ no
            cast = counts @ (yes + no)
            right[:] = np.clip((good + (strength + 2 * cast) * belief) / (strength + 3 * cast), 0.02, 0.98)[:, None]
            continue
        prior = float(np.clip((counts @ posterior + 1) / (counts.sum() + 2), 0.01, 0.99))
        for c, (weight, good, bad) in enumerate(((counts * (1 - posterior), no, yes), (counts * posterior, yes, no))):
            right[:, c] = np.clip((weight @ good + strength * belief) / (weight @ (good + bad) + strength), 0.02, 0.98)
    return posterior, right


def logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, l2: float = 1e-3, rounds: int = 300, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear scorer for soft targets, by full-batch Adam; the same input gives the same result."""
    weight = (weight / max(weight.sum(), 1e-12)).astype(x.dtype)
    w, b = np.zeros(x.shape[1], x.dtype), 0.0
    m1, m2 = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for i in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip((x @ w).astype(float) + b, -30, 30)))
        slope = (weight * (p - target)).astype(x.dtype)
        g = np.append(x.T @ slope + l2 * w, slope.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = rate * (m1 / (1 - 0.9**i)) / (np.sqrt(m2 / (1 - 0.999**i)) + 1e-8)
        w, b = (w - step[:-1]).astype(x.dtype), b - step[-1]
    return w, b
