"""Keys of the SimHash index."""

import random

from leasebook.llm import simhash_dedup


def test_every_four_bits_leave_a_key_equal():
    masks = simhash_dedup._masks(list(range(64)), 4)
    assert len(masks) == 35 and min(m.bit_count() for m in masks) >= 27
    draw = random.Random(1)
    for _ in range(2000):
        changed = sum(1 << b for b in draw.sample(range(64), 4))
        assert any(not m & changed for m in masks)
        # Inside any shared key the bits outside it are cut again, and some inner key is shared too.
        outer = next(m for m in masks if not m & changed)
        assert any(not m & changed for m in simhash_dedup._masks([b for b in range(64) if not outer >> b & 1], 4))


def test_labels_meet_nodes_and_not_the_rows_of_their_keys(spark, monkeypatch):
    """A group of near copies shares all its keys; joins by fingerprint stay as small as the nodes."""
    met = []
    labelled = simhash_dedup._labelled
    monkeypatch.setattr(simhash_dedup, "_labelled", lambda rows, found: met.append(labelled(rows, found).count()) or labelled(rows, found))
    values = [(1 << a | 1 << b,) for a in range(20) for b in range(a)]
    assert simhash_dedup.links(spark.createDataFrame(values, "fp long")).count() > 0
    assert met and max(met) <= len(values)
