"""Scoring kernels as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1.0


def pmi(nab: Column, na: Column, nb: Column, n: Column, epsilon: float = EPSILON) -> Column:
    """ln((nab + e) n / ((na + e)(nb + e))); 0 for an empty corpus. Epsilons of 0 or less mean 1."""
    e = epsilon if epsilon > 0 else 1.0
    return F.when(n == 0, F.lit(0.0)).otherwise(F.ln(((nab + e) * n) / ((na + e) * (nb + e))))


def npmi(nab: Column, na: Column, nb: Column, n: Column, epsilon: float = EPSILON) -> Column:
    """pmi over -ln((nab + e) / n); 0 for an empty corpus, for no joint count and where that logarithm is 0."""
    e = epsilon if epsilon > 0 else 1.0
    width = F.ln((nab + e) / F.greatest(n, F.lit(1)))
    return F.when((n == 0) | (nab == 0) | (width == 0), F.lit(0.0)).otherwise(pmi(nab, na, nb, n, epsilon) / F.when(width == 0, None).otherwise(-width))


def weighted(score: Column, weight: Column) -> Column:
    return score * weight


def association(nab: Column, na: Column, nb: Column, n: Column, normal: bool = True, epsilon: float = EPSILON) -> Column:
    """NPMI or PMI; 0 where a token or the corpus has no document."""
    score = npmi if normal else pmi
    return F.when((na == 0) | (nb == 0) | (n == 0), F.lit(0.0)).otherwise(score(nab, na, nb, n, epsilon))


@dataclass(frozen=True)
class Damping:
    """A hub that neighbours more than low of the vocabulary is damped, down to least at high."""

    low: float = 0.3
    high: float = 0.6
    least: float = 0.1
    threshold: float = 0.05


def damping(ratio: Column, d: Damping = Damping()) -> Column:
    t = (ratio - d.low) / (d.high - d.low)
    return F.when(ratio <= d.low, F.lit(1.0)).when(ratio >= d.high, F.lit(d.least)).otherwise(1 - t * t * (3 - 2 * t) * (1 - d.least))


def damped_pair(score: Column, fa: Column, fb: Column) -> Column:
    return score * F.sqrt(fa * fb)


def recency(age_days: Column, scale_days: float) -> Column:
    """exp(-age / scale): 1/e, not 1/2, at the scale. A scale of 0 or less gives 0."""
    return F.exp(-age_days / scale_days) if scale_days > 0 else F.lit(0.0)


def authority(links: Column) -> Column:
    return F.ln(links + 1.0)


@dataclass(frozen=True)
class Weights:
    pmi: float = 1.0
    cats: float = 0.6
    recency: float = 0.8
    authority: float = 0.2
    length: float = 0.05
    scale_days: float = 14.0


def total(w: Weights, pmi_part: Column, cats: Column, rec: Column, auth: Column, length: Column) -> Column:
    return w.pmi * pmi_part + w.cats * cats + w.recency * rec + w.authority * auth - w.length * length


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def rule_confidence(score: Column, support: Column) -> Column:
    return 0.6 * sigmoid(score - 0.8) + 0.4 * sigmoid(support - 5.0)


def low_coverage_confidence(missed: Column, coverage: Column, min_missed: float = 10, bias: float = 0.2) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), bias + 0.5 * (1 - F.exp(-missed / min_missed)) + 0.5 * (1 - coverage)))


def orphan_confidence(share: Column, category: Column, bias: float = 0.2) -> Column:
    return F.least(F.lit(1.0), bias + 0.8 * (1 - F.exp(-share / 0.05)) + F.when(category != "", 0.1).otherwise(0.0))


def surprise(a: Column, b: Column, joint: Column) -> Column:
    return F.greatest(F.lit(0.0), 0.5 * F.sqrt(a * b) - joint)
