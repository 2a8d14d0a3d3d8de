"""Tables that are rebuilt together: readers see all of the old ones or all of the new ones."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lectern.sources import rebuild


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def _table(spark, rows):
    return spark.createDataFrame(rows, "edition string, id long, v string")


def test_a_failure_between_two_tables_leaves_the_old_state(spark, tmp_path):
    store = str(tmp_path / "store")
    one, two = _table(spark, [("a", 1, "old"), ("b", 2, "old")]), _table(spark, [("a", 10, "old")])
    assert rebuild.rebuild(store, {"units": one, "topics": two}, "edition") == 1
    new = _table(spark, [("a", 1, "new")])
    broken = new.withColumn("v", F.raise_error(F.lit("stopped")).cast("string"))
    with pytest.raises(Exception, match="stopped"):
        rebuild.rebuild(store, {"units": new, "topics": broken}, "edition")
    assert _rows(rebuild.read(spark, store, "units")) == _rows(one) and _rows(rebuild.read(spark, store, "topics")) == _rows(two)
    assert rebuild.vacuum(spark, store) == 2 and _rows(rebuild.read(spark, store, "units")) == _rows(one)
    assert rebuild.rebuild(store, {"units": new, "topics": new}, "edition") == 2
    assert _rows(rebuild.read(spark, store, "units")) == [("a", 1, "new"), ("b", 2, "old")] and _rows(rebuild.read(spark, store, "units", 1)) == _rows(one)


def test_partitions_are_replaced_alone_and_may_become_empty(spark, tmp_path):
    store = str(tmp_path / "store")
    rebuild.rebuild(store, {"t": _table(spark, [("a", 1, "x"), ("b", 2, "x"), (None, 3, "x"), ("c/d=e", 4, "x")])}, "edition")
    rebuild.rebuild(store, {"t": _table(spark, [(None, 3, "y"), ("c/d=e", 5, "y")])}, "edition", replaced=["a"])
    assert _rows(rebuild.read(spark, store, "t").na.fill("-")) == [("-", 3, "y"), ("b", 2, "x"), ("c/d=e", 5, "y")]
    rebuild.rebuild(store, {"t": _table(spark, []), "u": _table(spark, [("z", 1, "z")])})
    assert _rows(rebuild.read(spark, store, "t")) == [] and _rows(rebuild.read(spark, store, "u")) == [("z", 1, "z")]
    assert rebuild.vacuum(spark, store, 1) >= 2 and _rows(rebuild.read(spark, store, "u")) == [("z", 1, "z")]


def test_of_two_rebuilds_at_once_one_fails(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    rebuild.rebuild(store, {"t": _table(spark, [("a", 1, "x")])})
    seen = rebuild.manifest(spark, store)
    rebuild.rebuild(store, {"t": _table(spark, [("a", 2, "x")])})
    monkeypatch.setattr(rebuild, "manifest", lambda *_: seen)
    with pytest.raises(rebuild.Conflict):
        rebuild.rebuild(store, {"t": _table(spark, [("a", 3, "x")])})
    monkeypatch.undo()
    assert _rows(rebuild.read(spark, store, "t")) == [("a", 2, "x")]
