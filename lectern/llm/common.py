"""What the operators share: working tables, connected components and exact ranks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W


def work_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where none is set and driver and executors are one process, as in tests."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))
        base = sc.getCheckpointDir()
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/lectern/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder; lineage ends there.

    ``group_bytes``: for rows of several MB. Row groups end after about so many bytes, looked at after each row: Parquet's own are of 128 MB,
    looked at after 100 rows, and are held whole by the task that writes or reads them.
    """
    path = table_path(df.sparkSession, name)
    options = {"parquet.block.size": str(group_bytes), "parquet.page.size.row.check.min": "1"} if group_bytes else {}
    df.write.options(compression="zstd", **options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


def removed(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing to come reads; a result that is still lazy must have been written itself."""
    for t in tables:
        jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(t.work_path)
        path.getFileSystem(conf).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for the small tables of iterations."""
    work_dir(df.sparkSession)
    return df.checkpoint()


def doc_texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text ('' for null) and the named columns alone, whatever else ``docs`` has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (src, dst) of an undirected graph -> (node, component), the component being its smallest node.

    Alternates large-star and small-star steps, which take about log(n) rounds; each
    step is an aggregate joined back to the edges, so a hub is a skewed join that can
    be split, not one group in one task. Loops, repeats and null ends are ignored.
    """
    e = cut(edges.filter("src <> dst").select(F.least("src", "dst").alias("v"), F.greatest("src", "dst").alias("u")).distinct())
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    seen = mark(e)
    while seen[0]:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        e = cut(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct())
        now = mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


#: A key with more than one in HOT of all rows does not go to a single task; fewer than HOT such keys can exist.
HOT = 1000


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], rows: int, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` (unique ``keys``, ``n``: how many rows of ``left`` have them, and other columns).

    Keys that hold more than one in HOT of ``rows``, of which there are fewer than HOT, are joined where they stand,
    by a broadcast; the others are shuffled. ``n`` goes.
    """
    more = [c for c in right.columns if c not in (*keys, "n")]
    common = F.col("n") * HOT > rows
    hot = right.filter(common).select(*keys, F.struct(*more, F.lit(1).alias("_")).alias("_hot"))
    dealt = left.join(F.broadcast(hot), keys, "left")
    first = dealt.filter("_hot is not null").select(*left.columns, *[F.col(f"_hot.{c}").alias(c) for c in more])
    rest = dealt.filter("_hot is null").drop("_hot").join(right.filter(~common).drop("n"), keys, how)
    return first.union(rest.select(first.columns))


def ranked(df: DataFrame, group: str, order: list[Column], name: str, bits: int = 12) -> DataFrame:
    """Exact zero-based rank of each row in its group in the order of a hash and then ``order``.

    A group is dealt into 2**bits hash ranges; ranks inside a range come from a window
    over that range alone, and the rows of the ranges before it from a table of
    (groups x ranges) counts. No window ever holds a whole group.
    """
    part = F.shiftrightunsigned(F.xxhash64(*order), 64 - bits).cast("int")
    df = df.withColumn("_part", part)
    before = F.sum("n").over(W.Window.partitionBy(group).orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1))
    offsets = df.groupBy(group, "_part").agg(F.count("*").alias("n")).select(F.col(group).alias("_g"), F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"))
    inside = W.Window.partitionBy(group, "_part").orderBy(F.xxhash64(*order), *order)
    out = df.withColumn("_rank", F.row_number().over(inside) - 1)
    return out.join(offsets, (out[group].eqNullSafe(offsets["_g"])) & (out["_part"] == offsets["_p"])).withColumn(name, (F.col("_rank") + F.col("_before")).cast("long")).drop("_part", "_rank", "_g", "_p", "_before")
