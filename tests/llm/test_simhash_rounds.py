"""Rounds of the SimHash index."""

import random
from itertools import combinations

from leasebook.llm import components, simhash_dedup


def _expected(values: list[int], distance: int) -> dict[int, int]:
    label = {v: v for v in values}

    def root(v: int) -> int:
        while label[v] != v:
            v = label[v]
        return v

    for a, b in combinations(values, 2):
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance:
            p, q = root(a), root(b)
            label[max(p, q)] = min(p, q)
    return {v: root(v) for v in values}


def _found(spark, values: list[int]) -> dict[int, int]:
    found = simhash_dedup.links(spark.createDataFrame([(v,) for v in values], "fp long"))
    labels = {r["node"]: r["label"] for r in components.connected(found).collect()}
    return {v: labels.get(v, v) for v in values}


def _chains(seed: int) -> list[int]:
    draw = random.Random(seed)
    values = set()
    for _ in range(6):
        v = draw.getrandbits(63)
        for _ in range(40):
            values.add(v)
            v ^= sum(1 << b for b in draw.sample(range(63), draw.randint(1, 5)))
    return sorted(values)


def test_links_take_two_rounds_over_the_keys(spark, monkeypatch):
    """Nodes meet the extremes of their keys and then other groups: the index is labelled once, not after each of three rounds."""
    made = []
    labelled = simhash_dedup._labelled
    monkeypatch.setattr(simhash_dedup, "_labelled", lambda rows, found: made.append(1) or labelled(rows, found))
    values = _chains(1)
    assert _found(spark, values) == _expected(values, 4)
    assert len(made) == 1


def test_crowded_keys_give_the_same_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "CROWD", 3)
    values = sorted(set(_chains(2)) | {1 << a | 1 << b for a in range(12) for b in range(a)})
    assert _found(spark, values) == _expected(values, 4)
