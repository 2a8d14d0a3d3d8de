"""Derived tables that are rebuilt together: all are staged first, then one manifest makes them the current ones.

A store is a folder. ``rebuild`` writes each table, or the partitions of it that are rebuilt, into a folder of its own and then publishes a manifest that
names the folders of every table of the store; readers follow the newest manifest. Until then, and if anything fails on the way, they see the
tables as they were, all of them. Manifests are numbered and never replaced: of two rebuilds at once the later one to publish fails, and may be tried
again on what the other made. What no kept manifest names is deleted by ``vacuum``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PART = "_part"


class Conflict(RuntimeError):
    """Another rebuild published first."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _versions(spark: SparkSession, store: str) -> list[int]:
    return [int(n[:-5]) for n in _names(spark, f"{store}/_manifests") if n.endswith(".json") and n[:-5].isdigit()]


def manifest(spark: SparkSession, store: str, version: int | None = None) -> dict:
    """version and tables: for each name its schema and the folders of its partitions ('' for a table without any)."""
    versions = _versions(spark, store)
    if not versions:
        return {"version": 0, "tables": {}}
    path = f"{store}/_manifests/{version or versions[-1]:012d}.json"
    return json.loads("\n".join(r.value for r in spark.read.option("wholetext", True).text(path).collect()))


def _publish(spark: SparkSession, store: str, version: int, tables: dict) -> None:
    fs, target = _fs(spark, f"{store}/_manifests/{version:012d}.json")
    staged = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/_manifests/.{uuid.uuid4().hex}")
    out = fs.create(staged, False)
    out.write(bytearray(json.dumps({"version": version, "tables": tables}).encode()))
    out.close()
    # A rename is all or nothing; where the number is taken, it fails or (on some file systems) is refused by the check before it.
    if fs.exists(target) or not fs.rename(staged, target):
        fs.delete(staged, False)
        raise Conflict(f"version {version} of {store} is there already")


def rebuild(store: str, tables: dict[str, DataFrame], partition: str | None = None, replaced: list | None = None) -> int:
    """Writes ``tables`` (name -> rows) and publishes them as the store's next version, which is returned. Tables not named stay.

    With ``partition`` (a column of every table), only the partitions that the rows have are replaced, and those of the values ``replaced``, which may
    have no rows any more; without it, whole tables are.
    """
    spark = next(iter(tables.values())).sparkSession
    before = manifest(spark, store)
    now = dict(before["tables"])
    for name, rows in tables.items():
        path = f"{store}/{name}/{uuid.uuid4().hex}"
        if partition is None:
            rows.write.parquet(path)
            parts = {"": path}
        else:
            value = F.coalesce(F.col(partition).cast("string"), F.lit("\0"))
            rows.withColumn(_PART, F.hex(value.cast("binary"))).write.partitionBy(_PART).parquet(path)
            parts = {n.partition("=")[2]: f"{path}/{n}" for n in _names(spark, path) if n.startswith(f"{_PART}=")}
            gone = {_key(v) for v in replaced or []}
            parts = {k: p for k, p in now.get(name, {}).get("parts", {}).items() if k not in gone and k != ""} | parts
        now[name] = {"schema": rows.schema.json(), "parts": parts}
    _publish(spark, store, before["version"] + 1, now)
    return before["version"] + 1


def _key(value) -> str:
    return ("\0" if value is None else str(value)).encode().hex().upper()


def read(spark: SparkSession, store: str, name: str, version: int | None = None) -> DataFrame:
    """The rows of a table in the newest, or in the given, version."""
    table = manifest(spark, store, version)["tables"][name]
    schema = T.StructType.fromJson(json.loads(table["schema"]))
    paths = list(table["parts"].values())
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def vacuum(spark: SparkSession, store: str, keep: int = 2) -> int:
    """Deletes all folders and manifests but those of the last ``keep`` versions; how many folders went. Not while a rebuild is under way."""
    versions = _versions(spark, store)
    used = {p for v in versions[-keep:] for t in manifest(spark, store, v)["tables"].values() for p in t["parts"].values()}
    gone = 0
    for name in _names(spark, store):
        for folder in _names(spark, f"{store}/{name}") if not name.startswith("_") else ():
            path = f"{store}/{name}/{folder}"
            if not any(p == path or p.startswith(f"{path}/") for p in used):
                fs, p = _fs(spark, path)
                fs.delete(p, True)
                gone += 1
    for v in versions[:-keep]:
        fs, p = _fs(spark, f"{store}/_manifests/{v:012d}.json")
        fs.delete(p, False)
    return gone
