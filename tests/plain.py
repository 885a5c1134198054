"""Plain restatements of what operators compute, for comparison on random inputs."""

from __future__ import annotations

import math


def keep_first(vectors, kinds, threshold):
    """Positions kept by the greedy rule."""
    kept = []
    for i, v in enumerate(vectors):
        sims = [sum(a * b for a, b in zip(v, vectors[j])) / max(1e-12, math.hypot(*v)) / max(1e-12, math.hypot(*vectors[j])) for j in kept if kinds[j] == kinds[i]]
        if not any(round(s, 9) > threshold for s in sims):
            kept.append(i)
    return kept
