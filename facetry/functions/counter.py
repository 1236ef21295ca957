"""Random numbers as a function of (row key, slot, seed).

A task can draw any cell without having drawn the ones before it, so the data a generator
yields is the same for every partitioning and for every retry of a lost task.
The integer mixer is the public splitmix64 finaliser.
"""

from __future__ import annotations

import numpy as np

# The splitmix64 multipliers and three odd 64-bit keys.
MIX_A = 0xBF58476D1CE4E5B9
MIX_B = 0x94D049BB133111EB
KEY_ROW = 0x9E3779B97F4A7C15
KEY_SLOT = 0xD1B54A32D192ED03
KEY_SEED = 0x8CB92BA72F3D8DD7


def uniform(rows: np.ndarray, slots: np.ndarray, seed: int) -> np.ndarray:
    """U(0,1), never 0; ``rows`` and ``slots`` broadcast against each other."""
    with np.errstate(over="ignore"):
        z = (
            np.asarray(rows).astype(np.int64).view(np.uint64) * np.uint64(KEY_ROW)
            + np.asarray(slots).astype(np.uint64) * np.uint64(KEY_SLOT)
            + np.uint64((seed * KEY_SEED) % 2**64)
        )
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_A)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_B)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def normal(rows: np.ndarray, slots: np.ndarray, seed: int) -> np.ndarray:
    """N(0,1) by Box-Muller from slots 2s and 2s+1."""
    slots = np.asarray(slots)
    u = uniform(rows, 2 * slots, seed)
    v = uniform(rows, 2 * slots + 1, seed)
    return np.sqrt(-2.0 * np.log(u)) * np.cos(2.0 * np.pi * v)


def log_gamma_variates(rows: np.ndarray, slots: np.ndarray, alpha: np.ndarray, seed: int) -> np.ndarray:
    """Logs of Gamma(alpha, 1) draws (Marsaglia and Tsang 2000; alpha = 1 is -log U).

    Kept as logs because a Gamma(0.01) draw underflows easily.
    """
    rows, slots, alpha = np.broadcast_arrays(rows, slots, np.asarray(alpha, dtype=float))
    if np.all(alpha == 1.0):
        return np.log(-np.log(uniform(rows, slots, seed)))
    shape = np.where(alpha < 1.0, alpha + 1.0, alpha)
    d = shape - 1.0 / 3.0
    c = 1.0 / np.sqrt(9.0 * d)
    out = np.full(rows.shape, np.nan)
    todo = np.ones(rows.shape, dtype=bool)
    attempt = 0
    while todo.any():
        rk, sk = rows[todo], slots[todo]
        attempt += 1
        x = normal(rk, sk, seed + 7919 * attempt)
        u = uniform(rk, sk, seed + 7919 * attempt + 104729)
        v = (1.0 + c[todo] * x) ** 3
        with np.errstate(invalid="ignore", divide="ignore"):
            ok = (v > 0) & (np.log(u) < 0.5 * x * x + d[todo] * (1.0 - v + np.log(v)))
            drawn = np.log(d[todo]) + np.log(v)
        hit = np.zeros(rows.shape, dtype=bool)
        hit[todo] = ok
        out[hit] = drawn[ok]
        todo &= ~hit
    boost = np.log(uniform(rows, slots, seed + 15485863)) / alpha
    return np.where(alpha < 1.0, out + boost, out)


def dirichlet(rows: np.ndarray, alpha: np.ndarray, seed: int) -> np.ndarray:
    """One Dirichlet(alpha) draw per row key, shape (n, r)."""
    alpha = np.asarray(alpha, dtype=float)
    logs = log_gamma_variates(np.asarray(rows)[:, None], np.arange(alpha.size)[None, :], alpha[None, :], seed)
    weights = np.exp(logs - logs.max(axis=1, keepdims=True))
    return weights / weights.sum(axis=1, keepdims=True)
