"""Rings of references against brute force, and the size of what is stored to find them."""

import random

import pytest

from evigrid.operators import pairing


def _returns(edges, start, limit):
    """Whether a walk of at most ``limit`` references meets an object again."""
    walks = [(start,)]
    for _ in range(limit):
        further = []
        for walk in walks:
            for parent in edges.get(walk[-1], ()):
                if parent in walk:
                    return True
                further.append((*walk, parent))
        walks = further
    return False


@pytest.mark.parametrize("seed", range(3))
def test_short_cycles_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    # references upwards, downwards, and either way with some to themselves
    pick = [lambda k: k - rng.randint(1, 9), lambda k: k + rng.randint(1, 9), lambda k: k + rng.randint(-4, 4)][seed]
    pairs = {(k, p) for k in range(60) for p in [pick(k)] if 0 <= p < 60}
    pairs |= {(rng.randrange(60), rng.randrange(60)) for _ in range(7)}
    edges = {}
    for child, parent in pairs:
        edges.setdefault(child, []).append(parent)
    nodes = spark.createDataFrame([(k,) for k in range(60)], "node bigint")
    got = pairing._short_cycles(nodes, spark.createDataFrame(sorted(pairs), "child bigint, parent bigint"), 6)
    assert sorted(r["node"] for r in got.collect()) == [k for k in range(60) if _returns(edges, k, 6)]


def test_nodes_above_a_ring_store_no_pairs(spark, monkeypatch):
    stored = []
    keep = pairing.materialise

    def counted(df):
        out = keep(df)
        stored.append(out.count())
        return out

    monkeypatch.setattr(pairing, "materialise", counted)
    pairs = [(k, k - 1) for k in range(1, 400)] + [(0, 1)]
    nodes = spark.createDataFrame([(k,) for k in range(400)], "node bigint")
    got = pairing._short_cycles(nodes, spark.createDataFrame(pairs, "child bigint, parent bigint"), 32)
    assert sorted(r["node"] for r in got.collect()) == list(range(32))
    assert sum(stored) < 3 * len(pairs)
