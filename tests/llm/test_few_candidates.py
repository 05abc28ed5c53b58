"""Sketches that sets share by chance are left out, links are not; a pair is found once."""

import numpy as np
import pytest

from flowloom.llm import jaccard


@pytest.mark.parametrize("num, den", [(8, 10), (9, 10)])
def test_sets_without_common_members_share_no_sketch(num, den):
    rng, bands = np.random.default_rng(5), jaccard.Bands(num, den)
    for n in (150, 211, 300, 393):
        keys = [bands.keys(np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))) for _ in range(200)]
        flat = np.concatenate(keys)
        assert len(np.unique(flat)) == len(flat)


@pytest.mark.parametrize("num, den", [(1, 2), (8, 10), (9, 10), (1, 1)])
def test_linked_sets_share_a_sketch(num, den):
    rng, bands = np.random.default_rng(6), jaccard.Bands(num, den)
    for n in [*range(1, 60), *range(60, 900, 17)]:
        for both in {-(-n * num // den), n}:  # the smallest intersection that links, and equal sets
            small = both
            while small + 1 <= n and den * both >= num * (small + 1 + n - both):
                small += 1  # the other set may have members of its own too
            members = rng.integers(0, 1 << 64, n + small, dtype=np.uint64)
            one, two = np.unique(members[:n]), np.unique(members[n - both : n + small - both])
            assert len(np.intersect1d(bands.keys(one), bands.keys(two)))


def test_pairs_of_many_shared_sketches_are_found_once(spark):
    nodes = [(key, 10, node, node, 100, bytes(32)) for key in range(7) for node in range(10)]
    nodes += [(9, 5, node, node, 100, bytes(32)) for node in (1, 3, 5, 12, 13)]
    members = spark.createDataFrame(nodes, "key long, c long, node long, root long, n long, bits binary")
    found = sorted(map(tuple, jaccard.near_in_tiles(members, 9, 10).collect()))
    own = {(a, b) for a in range(10) for b in range(a + 1, 10)} | {(1, 12), (1, 13), (3, 12), (3, 13), (5, 12), (5, 13), (12, 13)}
    assert found == sorted(own)
