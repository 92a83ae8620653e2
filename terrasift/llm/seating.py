"""Seating of one restaurant of a Pitman-Yor process: tables of dishes given their customers, and strengths.

The number of tables is drawn by generalised Stirling numbers up to 64 customers, and beyond by the law that it tends to
(its mean is within 4 % at 65 customers, 1 % at 300). Draws are hashes of a key and a number.
"""

from __future__ import annotations

import numpy as np

from .common import mixed

EXACT = 64
#: Stands for the end of a text among the hashes of words.
END = np.uint64(0x7B1D5A2C93E4F608)


def _stirling(discount: float) -> np.ndarray:
    """Logs of the generalised Stirling numbers S(c, t) for c up to ``EXACT``."""
    s = np.full((EXACT + 1, EXACT + 1), -np.inf)
    s[1, 1] = 0.0
    for c in range(1, EXACT):
        t = np.arange(1, c + 2)
        stay = np.where(t <= c, s[c, 1 : c + 2] + np.log(np.maximum(c - discount * t, 1e-12)), -np.inf)
        s[c + 1, 1 : c + 2] = np.logaddexp(s[c, 0 : c + 1], stay)
    return s


def _uniform(key: np.ndarray, salt: int) -> np.ndarray:
    h = mixed(key ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def sample_tables(customers: np.ndarray, mass: np.ndarray, discount: float, stirling: np.ndarray, key: np.ndarray, salt: int) -> np.ndarray:
    """Tables of each dish: t with probability in proportion to S(c, t) mass**t, for c customers."""
    tables = np.minimum(customers, 1)
    mass = np.maximum(mass, 1e-300)
    u = _uniform(key, salt)
    several = np.flatnonzero(customers > 1)
    start = np.minimum(customers[several], EXACT)
    order = np.argsort(start, kind="stable")
    several, start = several[order], start[order]
    first = np.flatnonzero(np.r_[True, start[1:] != start[:-1]]) if len(start) else several
    for at, c in zip(np.split(several, first[1:]), start[first].tolist(), strict=False):
        for part in np.array_split(at, max(1, len(at) * c >> 21)):
            logit = stirling[c, 1 : c + 1] + np.arange(1, c + 1) * np.log(mass[part])[:, None]
            p = np.exp(logit - logit.max(1, keepdims=True)).cumsum(1)
            tables[part] = 1 + (p < u[part, None] * p[:, -1:]).sum(1)
    at = np.flatnonzero(customers > EXACT)
    if len(at):
        more, variance = tables_beyond_one(customers[at].astype(np.float64), mass[at], discount)
        v, w = _uniform(key[at], salt + 1000), _uniform(key[at], salt + 1500)
        normal = np.rint(more + np.sqrt(variance) * np.sqrt(-2 * np.log(v)) * np.cos(2 * np.pi * w))
        few, term, below = np.zeros(len(at)), np.exp(-np.minimum(more, 30)), np.exp(-np.minimum(more, 30))
        for k in range(1, 32):  # inverse of a Poisson law for small means
            few += v > below
            term = term * more / k
            below = below + term
        tables[at] = 1 + np.clip(np.where(more < 8, few, normal), 0, customers[at] - 1).astype(np.int64)
    return tables


def tables_beyond_one(customers: np.ndarray, mass: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of the tables beyond the first, where P(t) is in proportion to S(c, t) mass**t and c is large.

    That law is one of t tables, Poisson in number with Sibuya sizes, given that their sizes add up to c. One
    table holds nearly all (hence the first one apart); the others follow the Poisson law tilted so that the
    expected sum is c. With few tables that is the limit 1 + Poisson(mass / discount).
    """
    u = np.log(mass) - np.log(customers + mass)  # ln(1 - z) for the tilt z, from above
    for _ in range(12):
        x = np.exp(u)
        g = np.log(mass) + np.log1p(-np.minimum(x, 1 - 1e-15)) - (1 - discount) * u - np.log(customers)
        u = np.minimum(u + g / (x / np.maximum(1 - x, 1e-15) + 1 - discount), -1e-15)
    x = np.maximum(np.exp(u), 1e-300)
    mean = mass / discount * -np.expm1(discount * u)
    with np.errstate(over="ignore"):
        spread = mass * (1 - x) * (x ** (discount - 1) + (1 - x) * (1 - discount) * x ** (discount - 2))
    return mean, np.maximum(mean - customers**2 / spread, 0)


def sample_strength(customers: np.ndarray, tables: np.ndarray, discount: float, strength: float, seed: int, rounds: int = 30) -> float:
    """The strength that restaurants of a level share, given their customers and tables: Gibbs with auxiliary variables.

    Each restaurant has a Beta variable for its customers and, for each table after the first, a coin that says whether
    the strength or the discount made it. The coins of the first tables are thrown, the sum of all later ones is drawn
    as a Poisson number of their mean. The prior is a Gamma law of shape 1 and mean 10,000, wide enough for contexts
    that say nothing, whose words are then nearly those of the family. A level without repeats keeps its strength.
    """
    on = customers > 1
    c, t = customers[on].astype(float), tables[on].astype(float)
    if not on.any():
        return strength
    rng = np.random.default_rng(seed)
    thrown = np.minimum(t - 1, 256).astype(np.int64)
    i = np.arange(int(thrown.sum())) - np.repeat(np.cumsum(thrown) - thrown, thrown) + 1
    for _ in range(rounds):
        made = float((rng.random(len(i)) < strength / (strength + discount * i)).sum())
        later = strength / discount * np.log((strength + discount * (t - 0.5)) / (strength + discount * 256.5))
        made += float(rng.poisson(later[t - 1 > 256].sum()))
        busy = -np.log(np.maximum(rng.beta(strength + 1, c - 1), 1e-300)).sum()
        strength = float(np.clip(rng.gamma(1 + made, 1 / (1e-4 + busy)), 1e-3, 1e7))
    return strength
