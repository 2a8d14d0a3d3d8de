"""Streams whose rows come out of order, over several batches, against the batch replay."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import schedule
from lectern.streaming import ordered

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ordered.STORE)
    yield
    spark.conf.set(name, before)


def _streamed(spark, folder, schema, batches, transform):
    """All rows that come out; one micro-batch a file."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{k:03d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in").transform(transform)
    query = stream.writeStream.outputMode("update").foreachBatch(lambda df, _: df.write.mode("append").parquet(f"{folder}/out")).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    return spark.read.parquet(f"{folder}/out")


def test_boxes_of_attempts_that_come_out_of_order(spark, rocksdb, tmp_path):
    rng = random.Random(5)
    rows = [(u, m, T0 + datetime.timedelta(minutes=rng.randrange(600)), k, rng.random() < 0.7) for k, (u, m) in enumerate((rng.randrange(2), rng.randrange(2)) for _ in range(60))]
    schema = "user_id long, mcq long, ts timestamp, attempt_id long, ok boolean"
    shuffled = rng.sample(rows, len(rows))
    end = [(99, 99, T0 + datetime.timedelta(days=k), 1000 + k, True) for k in (5, 9)]
    out = _streamed(spark, tmp_path, schema, [shuffled[:20], shuffled[20:45], shuffled[45:], end[:1], end[1:]], lambda df: ordered.boxes_in_order(df, "2 days"))
    got = {(r.user_id, r.mcq): (r.reviews, r.m.box) for r in out.groupBy("user_id", "mcq").agg(F.max("reviews").alias("reviews"), F.max(F.struct("reviews", "box")).alias("m")).collect()}
    want = {(r.user_id, r.mcq): (r.reviews, r.box) for r in schedule.replayed(spark.createDataFrame(rows, schema)).collect()}
    assert {k: v for k, v in got.items() if k != (99, 99)} == want


def test_windows_begin_with_the_first_event_and_expire(spark, rocksdb, tmp_path):
    rng = random.Random(6)
    rows = [(u, T0 + datetime.timedelta(minutes=rng.randrange(900)), k) for k, u in enumerate(rng.randrange(3) for _ in range(80))]
    shuffled = rng.sample(rows, len(rows))
    end = [(99, T0 + datetime.timedelta(days=k), 1000 + k) for k in (5, 9)]
    out = _streamed(spark, tmp_path, "user_id long, ts timestamp, event_id long", [shuffled[:30], shuffled[30:], end[:1], end[1:]], lambda df: ordered.rate_windows_in_order(df, 3600, 2, "2 days"))
    got = {(r.user_id, r.s): (r.n, r.refused) for r in out.groupBy("user_id", F.unix_timestamp("start").alias("s")).agg(F.max("n").alias("n"), F.max("refused").alias("refused")).collect()}
    want = {}
    for u in range(3):
        start = None
        for ts in sorted(int(t.timestamp()) for v, t, _ in rows if v == u):
            if start is None or ts >= start + 3600:
                start = ts
            n = want.get((u, start), (0, 0))[0] + 1
            want[u, start] = (n, max(0, n - 2))
    assert {k: v for k, v in got.items() if k[0] != 99} == want
