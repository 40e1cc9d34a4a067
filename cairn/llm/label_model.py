"""A generative model of voting functions: learns their accuracies and correlations without labels.

Every candidate has a hidden state, match or not, and each function votes +1, -1 or 0 (abstains). Given
the state a vote depends on the state and on the vote of one other function, its parent in a tree that is
learnt from the conditional mutual information of the votes, so that functions which look at the same
evidence do not count twice. Parameters are fitted by expectation maximisation over vote patterns with
their counts; there are at most 3 to the number of functions patterns however many candidates there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class LabelModel:
    prior: float
    parents: list[int]  # -1 for a root
    tables: list[np.ndarray]  # [state, parent's vote + 1 (or 0 for a root), vote + 1]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of a match for each row of votes."""
        votes = np.asarray(votes, dtype=np.int64) + 1
        if len(votes) == 0:
            return np.zeros(0)
        scores = np.stack([np.full(len(votes), np.log(p)) for p in (1 - self.prior, self.prior)])
        for j, (parent, table) in enumerate(zip(self.parents, self.tables)):
            given = votes[:, parent] if parent >= 0 else np.zeros(len(votes), dtype=np.int64)
            scores += np.log(table[:, given, votes[:, j]])
        return 1 / (1 + np.exp(np.clip(scores[0] - scores[1], -500, 500)))


def _tables(votes: np.ndarray, weights: np.ndarray, parents: list[int], before: list[np.ndarray], denied: list[float]) -> list[np.ndarray]:
    """weights: [state, pattern]; before: [state, vote] pseudo-counts of each function; denied: bounds of P(no | match)."""
    out = []
    for j, parent in enumerate(parents):
        table = np.repeat(before[j][:, None, :], 3 if parent >= 0 else 1, axis=1)
        given = votes[:, parent] if parent >= 0 else np.zeros(len(votes), dtype=np.int64)
        for state in (0, 1):
            np.add.at(table[state], (given, votes[:, j]), weights[state])
        table /= table.sum(axis=2, keepdims=True)
        over = table[1, :, 0] > denied[j]
        table[1, over, 1:] *= (1 - denied[j]) / (1 - table[1, over, :1])
        table[1, over, 0] = denied[j]
        out.append(table)
    return out


def _tree(votes: np.ndarray, weights: np.ndarray, least: float) -> list[int]:
    """Parents in the maximum spanning forest of the votes' mutual information given the state; weak links are left out."""
    m = votes.shape[1]
    gain = np.zeros((m, m))
    for a in range(m):
        for b in range(a):
            for w in weights:
                joint = np.zeros((3, 3))
                np.add.at(joint, (votes[:, a], votes[:, b]), w)
                total = joint.sum()
                if total <= 0:
                    continue
                joint /= total
                apart = joint.sum(axis=1, keepdims=True) * joint.sum(axis=0, keepdims=True)
                some = joint > 0
                gain[a, b] += total / weights.sum() * (joint[some] * np.log(joint[some] / apart[some])).sum()
            gain[b, a] = gain[a, b]
    parents, inside = [-1] * m, set()
    while len(inside) < m:
        best = max(((gain[a, b], a, b) for a in inside for b in range(m) if b not in inside), default=(0.0, -1, -1))
        if best[0] >= least:
            parents[best[2]] = best[1]
            inside.add(best[2])
        else:
            inside.add(next(b for b in range(m) if b not in inside))
    return parents


def fit(votes: np.ndarray, counts: np.ndarray, prior: float = 0.2, accuracy: float | list[tuple[float, float]] = 0.85, rounds: int = 60, least_gain: float = 0.02, weight: float = 2.0, denied: list[float] | None = None, most: float = 0.9) -> LabelModel:
    """Fit to distinct vote patterns and their counts.

    accuracy says, for all functions or for each, how often its yes and its no are taken to be right before
    anything is learnt; this first guess counts like weight observations. denied is the most a function
    may come to deny true matches: how rarely it does is learnt below that bound, so that a contradiction
    seen a few times among many agreements is not explained away as noise. most bounds the share of matches
    for the same reason.
    """
    votes = np.asarray(votes, dtype=np.int64) + 1
    counts = np.asarray(counts, dtype=float)
    m = votes.shape[1]
    right = [(accuracy, accuracy)] * m if isinstance(accuracy, float) else accuracy
    guess = [np.array([[no, 1.0, 1 - yes], [1 - no, 1.0, yes]]) / 2 for yes, no in right]  # [state, vote]
    model = LabelModel(prior, [-1] * m, [g[:, None, :].copy() for g in guess])
    if len(votes) == 0:
        return model
    for step in range(rounds):
        p = model.posterior(votes - 1)
        weights = np.stack([(1 - p) * counts, p * counts])
        parents = model.parents
        if step in (0, rounds // 3):  # at once, before voters that copy each other pass for the truth, and again when accuracies are known
            parents = _tree(votes, weights, least_gain)
        share = float(np.clip(weights[1].sum() / counts.sum(), 1e-4, most))
        model = LabelModel(share, parents, _tables(votes, weights, parents, [weight * g for g in guess], denied or [1.0] * m))
    return model
