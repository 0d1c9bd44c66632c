"""What the driver holds and keeps account of does not grow with features or with rounds over a few edges."""

import random
import tracemalloc

import numpy as np

from veridrift.llm import components, quality


def test_classifier_fit_copies_few_features_at_a_time(monkeypatch):
    monkeypatch.setattr(quality, "STEPS", 3)
    rng, rows = np.random.default_rng(3), []
    for k in range(400):
        idx = np.unique(rng.integers(0, 2 << quality.BITS, 12_000) // (1 + k % 2)).astype(np.int32)
        rows.append((k % 2, idx, np.full(len(idx), 1 / len(idx), np.float32)))
    tracemalloc.start()
    model = quality._fitted(rows, 0.5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.key and peak < sum(r[1].nbytes + r[2].nbytes for r in rows)


def test_classifier_fit_does_not_depend_on_blocks(monkeypatch):
    monkeypatch.setattr(quality, "STEPS", 20)
    rng, rows = np.random.default_rng(4), []
    for k in range(60):
        idx = np.unique(rng.integers(0, 2 << quality.BITS, 300 if k % 11 else 0) // (1 + k % 2)).astype(np.int32)
        rows.append((k % 2, idx, rng.random(len(idx)).astype(np.float32)))
    made = []
    for size in (1, 1000, 1 << 17):
        monkeypatch.setattr(quality, "_BLOCK", size)
        made.append(quality._fitted(rows, 0.5))
    for other in made[1:]:
        assert np.array_equal(made[0].words, other.words) and np.array_equal(made[0].chars, other.chars)
        assert (made[0].bias, made[0].scale, made[0].shift) == (other.bias, other.scale, other.shift)


def some_edges():
    r = random.Random(8)
    return [(i, i + 1) for i in range(-30, 30)] + [(100, k) for k in range(101, 140)] + [(r.randrange(1000, 1200), r.randrange(1000, 1200)) for _ in range(150)] + [(7, 7), (None, 3)]


def reached(spark):
    return {r.node: r.root for r in components.connected_components(spark.createDataFrame(some_edges(), "u long, v long").repartition(5)).collect()}


def test_few_edges_take_no_shuffled_rounds(spark, monkeypatch):
    by_rounds = []
    with monkeypatch.context() as m:
        m.setattr(components, "FEW_EDGES", 0)
        by_rounds.append(reached(spark))
    monkeypatch.setattr(components, "_linked_to_least", lambda edges: 1 / 0)
    assert reached(spark) == by_rounds[0]
    assert all(by_rounds[0][i] == -30 for i in range(-30, 31)) and by_rounds[0][139] == 100
