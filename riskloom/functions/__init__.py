"""Column expressions: safe arithmetic, ranks, vectors, text."""

from riskloom.functions.scalar import clip, div, epoch14, half_even, logistic, logit, r6, safe
from riskloom.functions.vectors import array_mean, cosine, dot, norm, scaled

__all__ = ["array_mean", "clip", "cosine", "div", "dot", "epoch14", "half_even", "logistic", "logit", "norm", "r6", "safe", "scaled"]
