"""Findings of round 4 on op1: each test fails on the code before it."""

from __future__ import annotations

from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lectern.llm import decontamination as D


def test_a_task_holds_few_segments_of_the_index_at_once(spark):
    words = F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda x: F.xxhash64(x, "doc_id").cast("string"))
    docs = spark.range(24, numPartitions=1).select(F.col("id").alias("doc_id")).withColumn("text", F.array_join(words, " "))
    index = D.build_index(docs)
    groups = [m.row_group(k) for f in Path(index.work_path.removeprefix("file:")).glob("*.parquet") for m in [pq.read_metadata(f)] for k in range(m.num_row_groups)]
    segments = sum(g.num_rows for g in groups)
    assert segments > 4 and max(g.num_rows for g in groups) < segments
    assert all(g.total_byte_size < 3 * D.GROUP_BYTES for g in groups)
    assert sum(len(r.doc_ids) for r in index.select("doc_ids").collect()) == 24
