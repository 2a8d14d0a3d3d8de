"""Sharding against a plain loop of the same rounds, row by row."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import sharding

_UNSIGNED = (1 << 64) - 1


def _loop(rows, shards, rounds):
    """``rows``: row -> (group, hashes: start, of group and row, of row, of group and each shard). Returns row -> shard."""
    n = len(rows)
    quota = [n // shards + (k < n % shards) for k in range(shards)]
    sizes = Counter(g for g, *_ in rows.values())
    by_group, by_row = (lambda r: (rows[r][2], rows[r][0], r)), (lambda r: (rows[r][3], r))
    shard = {r: v[1] for r, v in rows.items()}
    linked = [r for r in rows if sizes[rows[r][0]] > 1]
    open_ = list(range(shards))

    def ranks(some, of, key):
        out, seen = {}, Counter()
        for r in sorted(some, key=key):
            out[r] = seen[of(r)]
            seen[of(r)] += 1
        return out

    for _ in range(rounds):
        held = defaultdict(Counter)
        for r in linked:
            held[rows[r][0]][shard[r]] += 1
        # The signed hash settles ties, as the engine compares it.
        best = {g: max(((c, HASHES[g][s], s) for s, c in counts.items() if s in open_), default=(0, 0, None))[2] for g, counts in held.items()}
        wish = {r: shard[r] if best[rows[r][0]] is None else best[rows[r][0]] for r in linked}
        movers = [r for r in linked if wish[r] != shard[r]]
        if not movers:
            break
        staying = Counter(shard[r] for r in linked if wish[r] == shard[r])
        place = ranks(movers, lambda r: wish[r], by_group)
        for r in movers:
            if place[r] < max(0, quota[wish[r]] - staying[wish[r]]):
                shard[r] = wish[r]
        full = Counter(shard[r] for r in linked)
        open_ = [k for k in range(shards) if full[k] < quota[k]] or open_
    place = ranks(linked, lambda r: shard[r], by_group)
    kept = {r for r in linked if place[r] < quota[shard[r]]}
    left = [quota[k] - sum(shard[r] == k for r in kept) for k in range(shards)]
    loose = [r for r in rows if r not in kept]
    place = ranks(loose, lambda r: shard[r], by_row)
    stays = [r for r in loose if place[r] < left[shard[r]]]
    gaps = np.cumsum([left[k] - sum(shard[r] == k for r in stays) for k in range(shards)])
    surplus = sorted(set(loose) - set(stays), key=by_row)
    for k, r in enumerate(surplus):
        shard[r] = int((gaps <= k).sum())
    return shard


HASHES: dict[str, list[int]] = {}


@pytest.mark.parametrize(("n", "shards", "groups"), [(200, 8, 30), (97, 5, 3), (60, 8, 1), (40, 8, 40), (3, 8, 2)])
def test_labels_against_a_loop(spark, n, shards, groups):
    """Many groups, a few, one that is larger than a shard, none at all, and fewer rows than shards."""
    rng = np.random.default_rng(n)
    of = [f"g{k}" if groups == n else f"g{int(groups * rng.random() ** 2)}" for k in range(n)]
    nodes = spark.createDataFrame([(k * 3, g) for k, g in enumerate(of)], "row long, group string")
    told = nodes.select("row", "group", F.pmod(F.xxhash64("row", F.lit("start")), F.lit(shards)).alias("s"), F.xxhash64("group", "row").alias("gr"), F.xxhash64("row").alias("r"), F.array(*[F.xxhash64("group", F.lit(k)) for k in range(shards)]).alias("gs")).collect()
    HASHES.clear()
    HASHES.update({t.group: t.gs for t in told})
    rows = {t.row: (t.group, t.s, t.gr & _UNSIGNED, t.r & _UNSIGNED) for t in told}
    got = {r.row: r.shard for r in sharding.balanced_labels(nodes, shards).collect()}
    assert got == _loop(rows, shards, sharding.ROUNDS)
