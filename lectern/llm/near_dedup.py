"""MinHash near-duplicates by HyperMinHash sketches.

A document's set is its distinct shingles of five words. Its sketch has REGISTERS buckets, each
the least of one hash function over the set, kept in 16 bits: the count of leading zeros and the first mantissa bits
after them. Bands of registers are hashed; documents that share a band, directly or through others, form a
candidate group. Inside a group, pairs are estimated from their sketches with a correction for registers that agree by
chance; those near enough form closer groups, and what is in none goes. Only then full sets are made, and the pairs near enough
are confirmed on them. Components of the confirmed links are the result.

* Equal sets are one class from the start: a class is one row in all that follows, however many copies it has.
* A group is dealt into blocks, of SKETCHES classes for estimates and of BLOCK classes and about BLOCK_BYTES of sets for confirmation, and each pair
  of blocks is a task of its own. A task returns a spanning forest of its links, never the pairs, so what leaves it is no more than it got.
  Texts that share a band by a common passage alone are parted by their sketches: their sets never travel.
* Bands are chosen so that a pair at the threshold is missed with a probability under 1e-5.

Null, empty and blank texts have no shingles and no links; a text of fewer than five words is one shingle.
Rows with equal doc_id are one node; a null doc_id is no node and its row is its own component (null). Other columns
are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lectern.llm.common import connected_components, doc_texts, join_hot, removed, written
from lectern.llm.tokens import SPACED, Words, lists, mix, pieces

SHINGLE = 5
REGISTERS = 252
MANTISSA = 11
#: Classes of a block of sketches; classes and bytes of sets of a block that is confirmed.
SKETCHES = 1024
BLOCK, BLOCK_BYTES = 256, 4 << 20
#: An estimate lower than the threshold by so many standard deviations rules a pair out.
DEVIATIONS = 5.0
PIECE_BYTES = 2 << 20


def bands_for(threshold: float) -> tuple[int, int]:
    """(rows, bands): as many rows a band as still find a pair at the threshold but for 1e-5."""
    best = (1, REGISTERS)
    for rows in range(1, 13):
        bands = REGISTERS // rows
        if (1 - threshold**rows) ** bands < 1e-5:
            best = (rows, bands)
    return best


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of all texts, and the bounds of each text's."""
    w = Words(texts, SPACED)
    n = np.diff(w.bounds)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(n.dtype))
    out, bounds = np.zeros(int(count.sum()), np.uint64), np.r_[0, np.cumsum(count)]
    h = w.hashes
    # All runs of five in one pass, those across texts being left out; short texts by themselves.
    if len(h) >= SHINGLE:
        run = np.zeros(len(h) - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            run = mix(run * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - SHINGLE + 1 + k])
        doc = np.repeat(np.arange(len(n)), n)
        inside = doc[: len(run)] == doc[SHINGLE - 1 :]
        where = np.repeat(bounds[:-1], n)[: len(run)] + np.arange(len(run)) - np.repeat(w.bounds[:-1], n)[: len(run)]
        out[where[inside]] = run[inside]
    for d in np.flatnonzero((n > 0) & (n < SHINGLE)):
        x = np.uint64(0)
        for v in h[w.bounds[d] : w.bounds[d + 1]]:
            x = mix(np.array([x], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + v)[0]
        out[bounds[d]] = x ^ np.uint64(n[d])
    # Sorted by text, then hash: texts are sorted one by one, as each fits the cache.
    sets = [np.unique(out[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return (np.concatenate(sets) if sets else out), np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int64)


_rng = np.random.default_rng(20240229)
_ODD = (_rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)


def _least(s: np.ndarray) -> np.ndarray:
    """The least value of each of REGISTERS hash functions over a set."""
    x = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
    best = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        v = x[at : at + 512, None] * _ODD + _ADD
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        v ^= v >> np.uint32(13)
        np.minimum(best, v.min(axis=0), out=best)
    return best


def registers(least: np.ndarray) -> np.ndarray:
    """Minima of 32 bits in 16: leading zeros times 2**MANTISSA plus the mantissa bits that follow the first one."""
    bits = np.frexp(least.astype(np.float64))[1]  # place of the highest one, 0 for 0
    zeros = np.minimum(32 - bits, (1 << (16 - MANTISSA)) - 1)
    mantissa = ((least.astype(np.uint64) << np.uint64(MANTISSA)) >> np.maximum(bits - 1, 0).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    return ((zeros << MANTISSA) | mantissa.astype(np.int64)).astype(np.uint16)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The probability that registers of disjoint sets of n and m agree.

    Their minima have densities n exp(-nx) and m exp(-mx), and a register is x / 2**MANTISSA wide, times
    1 / (2 ln 2) on average: the integral is nm / (n + m)**2 of that.
    """
    n, m = np.asarray(n, float), np.asarray(m, float)
    return n * m / (n + m) ** 2 / (2 * np.log(2)) / 2.0**MANTISSA


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, fp1, fp2 (the set's 128-bit hash), sketch."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE_BYTES):
            sets, bounds = shingle_sets(batch.column(1))
            total = np.r_[np.uint64(0), np.cumsum(mix(sets))]
            other = np.r_[np.uint64(0), np.cumsum(mix(sets ^ np.uint64(0xD1B54A32D192ED03)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(bounds)), pa.array((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)), pa.array((other[bounds[1:]] - other[bounds[:-1]]).view(np.int64)), _sketched(sets, bounds)],
                ["doc_id", "n_shingles", "fp1", "fp2", "sketch"],
            )

    return doc_texts(docs).mapInArrow(sketch, "doc_id long, n_shingles long, fp1 long, fp2 long, sketch binary")


def _sketched(sets: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.array([registers(_least(sets[a:b])).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())


def _registers_of(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.uint16) for x in column.to_pylist()])


def band_keys(regs: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """(sketches, bands): the hash of each band of ``rows`` registers."""
    keys = np.zeros((len(regs), bands), np.uint64)
    for k in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + regs[:, k : rows * bands : rows].astype(np.uint64) + np.uint64(1))
    return mix(keys ^ mix(np.arange(bands, dtype=np.uint64) + np.uint64(1)))


def stars(reps: DataFrame, rows: int, bands: int) -> DataFrame:
    """src, dst: each of ``reps`` (node, sketch) tied to the smallest one of every bucket that it shares with others.

    A batch ties its own members of a bucket and sends the smallest of them on, so that a bucket has one row a batch where all meet.
    """

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(_registers_of(batch.column(1)), rows, bands).ravel()
                nodes = np.repeat(batch.column(0).to_numpy(), bands)
                order = np.lexsort((nodes, keys))
                k, v = keys[order], nodes[order]
                new = np.r_[True, k[1:] != k[:-1]]
                lead = v[np.flatnonzero(new)][np.cumsum(new) - 1]
                late = ~new & (v != lead)
                keep = new | late
                yield pa.RecordBatch.from_arrays([pa.array(k[keep].view(np.int64)), pa.array(v[keep]), pa.array(lead[keep], mask=new[keep])], ["key", "node", "least"])

    d = reps.select("node", "sketch").mapInArrow(block, "key long, node long, least long")
    met = d.filter("least is null").withColumn("least", F.min("node").over(W.Window.partitionBy("key"))).filter("node <> least")
    return d.filter("least is not null").union(met).select(F.col("node").alias("src"), F.col("least").alias("dst")).distinct()


def _full_sets(docs: DataFrame) -> DataFrame:
    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE_BYTES):
            sets, bounds = shingle_sets(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(sets.view(np.int64), bounds), *batch.columns[2:], _sketched(sets, bounds)], ["node", "shingles", "grp", "blocks", "sketch"])

    return docs.mapInArrow(sets_of, "node long, shingles array<long>, grp long, blocks int, sketch binary")


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _near(regs: np.ndarray, n: np.ndarray, a: int, rest: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``rest`` that may be linked with ``a`` by their sketches and sizes, and the estimates."""
    percent = round(threshold * 100)
    fit = rest[100 * np.minimum(n[a], n[rest]) >= percent * np.maximum(n[a], n[rest])]
    agree = (regs[a] == regs[fit]).mean(axis=1)
    luck = chance(n[a], n[fit])
    estimate = (agree - luck) / (1 - luck)
    near = np.flatnonzero(estimate >= threshold - DEVIATIONS * np.sqrt(threshold * (1 - threshold) / REGISTERS))
    return fit[near], estimate[near]


def _sides(block: np.ndarray, i: int, j: int) -> list[tuple[int, np.ndarray]]:
    """(place, the places that it is compared with) within one block, or between two; ``block`` is sorted."""
    m, split = len(block), int(np.searchsorted(block, i, "right"))
    pairs = [(a, np.arange(a + 1 if i == j else split, m)) for a in range(m if i == j else split)]
    return [(a, rest) for a, rest in pairs if len(rest)]


def _estimator(threshold: float):
    """A spanning forest of the pairs of a block, or between two, that may be linked by their sketches."""

    def estimate(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, block, n = (table.column(c).to_numpy() for c in ("node", "block", "n_shingles"))
        order = np.lexsort((node, block))
        node, block, n = node[order], block[order], n[order]
        regs = _registers_of(table.column("sketch"))[order]
        label, src, dst = np.arange(len(node)), [], []
        for a, rest in _sides(block, table.column("i")[0].as_py(), table.column("j")[0].as_py()):
            near, _ = _near(regs, n, a, rest[label[rest] != label[a]], threshold)
            if len(near):
                # One edge to each tree that is not yet this one's.
                trees, first = np.unique(label[near], return_index=True)
                src += [a] * len(trees)
                dst += near[first].tolist()
                label[np.isin(label, trees)] = label[a]
        return pa.table({"src": pa.array(node[src] if src else [], pa.int64()), "dst": pa.array(node[dst] if dst else [], pa.int64())})

    return estimate


def _confirmer(threshold: float):
    """Confirms the links of a block, or between two, and returns a spanning forest of them."""
    percent = round(threshold * 100)

    def confirm(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, block = table.column("node").to_numpy(), table.column("block").to_numpy()
        order = np.lexsort((node, block))
        node, block = node[order], block[order]
        regs = _registers_of(table.column("sketch"))[order]
        lists_ = table.column("shingles").combine_chunks()
        values, offsets = lists_.values.to_numpy(zero_copy_only=False), lists_.offsets.to_numpy()
        sets = [values[offsets[k] : offsets[k + 1]].view(np.uint64) for k in order]
        n = np.array([len(s) for s in sets])
        forest, edges, pairs = _Forest(len(node)), [], []
        for a, rest in _sides(block, table.column("i")[0].as_py(), table.column("j")[0].as_py()):
            near, estimates = _near(regs, n, a, rest, threshold)
            pairs += zip((-estimates).tolist(), [a] * len(near), near.tolist(), strict=True)
        for _, a, b in sorted(pairs):
            if forest.root(a) != forest.root(b):
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if 100 * both >= percent * (n[a] + n[b] - both):
                    forest.join(a, b)
                    edges.append((node[a], node[b]))
        return pa.table({"src": pa.array([int(a) for a, _ in edges], pa.int64()), "dst": pa.array([int(b) for _, b in edges], pa.int64())})

    return confirm


def _paired(members: DataFrame) -> DataFrame:
    """``members`` (node, grp, blocks, ...) in a block each, once for every pair of blocks (i, j) of their group that theirs is in."""
    dealt = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")


def candidates(reps: DataFrame, threshold: float) -> DataFrame:
    """node, grp: of ``reps`` (node, n_shingles, sketch), those that others may be linked with by their sketches, and the group that they form with them."""
    rows, bands = bands_for(threshold)
    ties = written(stars(reps, rows, bands), "stars")
    groups = written(connected_components(ties), "groups")
    sizes = written(groups.groupBy("component").agg(F.count("*").alias("n"), F.ceil(F.count("*") / SKETCHES).cast("int").alias("blocks")), "group-sizes")
    members = join_hot(groups, sizes, ["component"], groups.count()).withColumnRenamed("component", "grp")
    # Members grow with the corpus, so they are never broadcast.
    sketched = reps.join(members.hint("merge"), "node").select("node", "n_shingles", "sketch", "grp", "blocks")
    near = written(_paired(sketched).groupBy("grp", "i", "j").applyInArrow(_estimator(threshold), "src long, dst long"), "near")
    out = written(connected_components(near).withColumnRenamed("component", "grp"), "candidates")
    removed(ties, groups, sizes, near)
    return out


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable over links of at least ``threshold``)."""
    s = written(sketches(docs), "sketches")
    total = s.count()
    has = s.filter("n_shingles > 0 and doc_id is not null")
    classes = written(has.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "classes")
    # One row a class: keys with the id are even, however many copies a class has.
    firsts = classes.select("fp1", "fp2", F.col("node").alias("doc_id"))
    reps = written(has.join(firsts, ["fp1", "fp2", "doc_id"], "left_semi").dropDuplicates(["fp1", "fp2", "doc_id"]).select(F.col("doc_id").alias("node"), "n_shingles", "sketch"), "representatives")
    groups = candidates(reps, threshold)
    sized = groups.join(reps.groupBy("node").agg(F.max("n_shingles").alias("n_shingles")).hint("merge"), "node")
    sizes = written(sized.groupBy("grp").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(8 * F.sum("n_shingles") / BLOCK_BYTES)).cast("int").alias("blocks")), "group-sizes")
    members = join_hot(groups, sizes, ["grp"], total)
    texts = doc_texts(docs).withColumnRenamed("doc_id", "node").join(members.hint("merge"), "node").select("node", "text", "grp", "blocks").distinct()
    links = written(_paired(_full_sets(texts)).groupBy("grp", "i", "j").applyInArrow(_confirmer(threshold), "src long, dst long"), "links")
    found = written(connected_components(links), "components")
    # Texts that share a doc_id are tied through it.
    tied = join_hot(has.select("doc_id", "fp1", "fp2"), classes, ["fp1", "fp2"], total).groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b")
    repeated_ids = written(tied, "repeated-ids")
    if not repeated_ids.isEmpty():
        extra = join_hot(has.join(repeated_ids.select("doc_id"), "doc_id", "left_semi").select("doc_id", "fp1", "fp2"), classes, ["fp1", "fp2"], total).select(F.col("doc_id").alias("src"), F.col("node").alias("dst"))
        found = written(connected_components(found.select(F.col("node").alias("src"), F.col("component").alias("dst")).union(extra)), "components")
    ends = classes.join(found, "node", "left").select("fp1", "fp2", F.coalesce("component", "node").alias("end"), "n")
    out = join_hot(s.select("doc_id", "n_shingles", "fp1", "fp2"), ends, ["fp1", "fp2"], total, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("end")).otherwise(F.col("doc_id"))
    result = written(out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")), "near-duplicates")
    removed(s, classes, reps, groups, sizes, links, found, repeated_ids)
    return result


def op9(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 0.85)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM w),
p AS (SELECT doc_id, k, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS g, count(*) OVER (PARTITION BY doc_id) AS n FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
s AS (SELECT DISTINCT doc_id, g FROM p WHERE k <= greatest(n - 4, 1)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(other) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id
"""
