"""Shared bits of the corpus operators' tests."""

import random


def prose(rng: random.Random, n: int, vocabulary: int = 4000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng: random.Random, words: list[str], share: float) -> list[str]:
    return [f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def closure(ids, links):
    """Smallest id reachable, by plain union-find."""
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}
