"""Logistic regression in numpy for the bounded training samples of this subpackage."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(z, -60, 60)))


def lbfgs(loss_grad, w: np.ndarray, rounds: int = 60, memory: int = 8) -> np.ndarray:
    """Minimise a smooth convex function; loss_grad(w) gives value and gradient."""
    value, grad = loss_grad(w)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        direction, alphas = -grad, []
        for s, y, rho in reversed(steps):
            alphas.append(rho * (s @ direction))
            direction = direction - alphas[-1] * y
        if steps:
            s, y, rho = steps[-1]
            direction = direction / (rho * (y @ y))
        else:
            direction = direction / max(1.0, float(np.abs(grad).max()))
        for (s, y, rho), a in zip(steps, reversed(alphas), strict=True):
            direction = direction + s * (a - rho * (y @ direction))
        slope, step = float(grad @ direction), 1.0
        if slope >= 0:
            break
        for _ in range(20):
            new = w + step * direction
            new_value, new_grad = loss_grad(new)
            if new_value <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = new - w, new_grad - grad
        if (curve := float(s @ y)) > 1e-12:
            steps = [*steps[1 - memory :], (s, y, 1 / curve)]
        done = abs(value - new_value) <= 1e-7 * max(1.0, abs(value))
        w, value, grad = new, new_value, new_grad
        if done:
            break
    return w


def fit_sparse(starts: np.ndarray, index: np.ndarray, values: np.ndarray, y: np.ndarray, width: int, l2: float) -> np.ndarray:
    """Weights and, last, the bias, of rows given as (starts, index, values); every row has an entry.

    Rows are taken in blocks, so that what is made on the way stays small beside the rows themselves.
    """
    sign = np.where(y > 0, 1.0, -1.0)
    blocks = [(a, min(a + 256, len(y))) for a in range(0, len(y), 256)]

    def loss_grad(w):
        loss, grad = 0.5 * l2 * float(w[:-1] @ w[:-1]), l2 * w
        grad[-1] = 0.0
        for a, b in blocks:
            part = slice(starts[a], starts[b])
            margin = sign[a:b] * (np.add.reduceat(values[part] * w[index[part]], starts[a:b] - starts[a]) + w[-1])
            pull = -sign[a:b] * sigmoid(-margin) / len(y)
            grad += np.bincount(index[part], np.repeat(pull, np.diff(starts[a : b + 1])) * values[part], minlength=width + 1)
            grad[-1] += pull.sum()
            loss += np.logaddexp(0, -margin).sum() / len(y)
        return loss, grad

    return lbfgs(loss_grad, np.zeros(width + 1))


def fit_dense(x: np.ndarray, y: np.ndarray, l2: float = 1e-4) -> np.ndarray:
    """Weights and, last, the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    sign = np.where(y > 0, 1.0, -1.0)

    def loss_grad(w):
        margin = sign * (x @ w)
        reg = np.append(w[:-1], 0.0)
        return np.logaddexp(0, -margin).mean() + 0.5 * l2 * float(reg @ reg), x.T @ (-sign * sigmoid(-margin)) / len(y) + l2 * reg

    return lbfgs(loss_grad, np.zeros(x.shape[1]), 200)


def platt(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn scores into probabilities; a slope of 0 for scores that tell nothing, or the wrong way."""
    if len(scores) < 2 or y.min() == y.max():
        return 1.0, 0.0
    scale = float(scores.std()) or 1.0
    a, b = fit_dense((scores / scale)[:, None], y, 1e-3)
    return max(float(a), 0.0) / scale, float(b)
