"""Measures of sets and boolean positions, as columns and as plain functions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays taken as sets: 1 for two empty ones, 0 for one."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.when(union == 0, 1).otherwise(union))


def jaccard_counts(shared: Column, one: Column, other: Column) -> Column:
    """The same from the sizes of the intersection and of both sets."""
    union = one + other - shared
    return F.when(union == 0, 1.0).otherwise(shared / F.when(union == 0, 1).otherwise(union))


def clique_edges(n: Column) -> Column:
    """Links of a clique of n worlds, both ways, without loops."""
    return n * (n - 1)


def bools_distance(a: Column, b: Column) -> Column:
    """The root of the number of places at which two boolean arrays differ; an error for uneven lengths."""
    wrong = F.size(a) != F.size(b)
    differ = F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d))
    return F.when(wrong, F.raise_error(F.lit("positions of uneven length")).cast("double")).otherwise(F.sqrt(differ.cast("double")))


def bools_dist(a: Sequence[bool], b: Sequence[bool]) -> float:
    if len(a) != len(b):
        raise ValueError("positions of uneven length")
    return math.sqrt(sum(x != y for x, y in zip(a, b, strict=True)))


def entropy(bits: Sequence[bool]) -> float:
    """Shannon entropy of the share of true places, in bits."""
    if not bits:
        return 0.0
    p = sum(bits) / len(bits)
    return -sum(q * math.log2(q) for q in (p, 1 - p) if q > 0)


def centroid_quality(centroids: Sequence[Sequence[bool]], least_entropy: float = 0.3, least_ratio: float = 0.3) -> bool:
    """Whether centroids are far enough apart and each mixed enough."""
    for i, a in enumerate(centroids):
        true = sum(a)
        rare, often = min(true, len(a) - true), max(true, len(a) - true)
        if entropy(a) <= least_entropy or (often and rare / often < least_ratio):
            return False
        if any(bools_dist(a, b) < math.sqrt(len(a) // 2) for b in centroids[i + 1 :]):
            return False
    return True
