"""Every query of the catalogue against its SQL; those without SQL against loops."""

from __future__ import annotations

from collections import defaultdict

import pytest
from helpers import duck, same

import __spark_entry__ as entry
from lectern.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows(spark, sf, name):
    same(catalogue.QUERIES[name](spark, sf), sf, catalogue.ORACLES[name])


def test_entry(spark):
    assert entry.entry(spark).columns == ["user_id", "angle", "wrong", "mcqs"]
    assert set(catalogue.QUERIES) <= set(entry.queries())


def test_rate_windows_against_a_loop(spark, sf):
    events = defaultdict(list)
    for user, at in duck(sf, "SELECT user_id, epoch(ts) FROM events")[1]:
        events[user].append(at)
    want = {}
    for user, times in events.items():
        start, n, windows, refused = None, 0, 0, 0
        for t in sorted(times):
            if start is None or t >= start + 3600:
                start, n, windows = t, 0, windows + 1
            n += 1
            refused += n > 2
        want[user] = (windows, refused)
    assert {r.user_id: (r.windows, r.refused) for r in catalogue.QUERIES["rate_windows"](spark, sf).collect()} == want
