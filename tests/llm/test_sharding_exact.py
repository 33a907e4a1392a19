"""Sizes are packed as they are, and rounded only where there are too many."""

from __future__ import annotations

from collections import defaultdict

from tallyfield.llm import sharding


def test_large_sizes_are_packed_exactly(spark):
    """Groups of some thousand bytes that differ by one: rounding to 12 bits would take most for equal."""
    sizes = [5000 + 7 * k % 40 + k for k in range(60)] + [20_001, 20_003, 41_234]
    groups = spark.createDataFrame([(str(k).encode(), s, 1) for k, s in enumerate(sizes)], "_group binary, bytes long, copies long")
    got = {int(bytes(r["_group"])): r["shard"] for r in sharding.place_groups(groups, 5).collect()}
    runs = defaultdict(list)
    for k, s in enumerate(sizes):
        runs[s].append(k)
    order = sorted(runs, reverse=True)
    loads = defaultdict(int)
    for s, placed in zip(order, sharding.even_runs([(s, len(runs[s])) for s in order], 5), strict=True):
        for b, n in placed:
            loads[b] += n * s
    have = defaultdict(int)
    for k, b in got.items():
        have[b] += sizes[k]
    assert len(got) == len(sizes) and dict(have) == dict(loads)


def test_bits_fall_only_with_many_sizes(spark):
    groups = spark.createDataFrame([(5000 + k,) for k in range(3000)], "bytes long")
    assert sharding.significant_bits(groups) == 63 and sharding.significant_bits(groups, 3000) == 63
    bits = sharding.significant_bits(groups, 1000)
    assert bits < 63 and groups.select(sharding._rounded(groups["bytes"], bits)).distinct().count() <= 3000
    assert sharding.significant_bits(groups, 5) == sharding.SIZE_BITS
