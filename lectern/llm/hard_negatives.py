"""Hard-negative mining by bit-sliced integer products.

Components become integers (floor of 256 x). A candidate's component is sign plane and value planes; planes are multiplied with the
anchors from the most significant one on. After planes down to 2^k, what is missing from a score lies between (2^k - 1) times the
sum of the anchor's negative components and (2^k - 1) times that of its positive ones, so each plane halves the interval. A pair goes
once its interval cannot reach what is asked: for positives the K-th best lower bound, for negatives the window of an anchor's positives and the
K-th best so far of each. While many pairs are left, a plane is one matrix product; later only the pairs that are left are multiplied.

Anchors (a stated query set) are taken in passes of at most about PASS_BYTES, by hash; each pass reads all rows twice where they lie,
for positives and then for negatives. A task keeps K rows an anchor (and positive), so nothing but those is shuffled: no vector is.

Rows with a null or non-finite label, vector or component take no part, nor do rows without vec_id (they could not be told from an anchor)
or with a component beyond LIMIT (scores would leave a long). Vectors of unlike length do not meet; empty vectors score 0. "Other" rows
are rows of another vec_id; rows of one vec_id, label and score count once. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lectern.llm.common import removed, written

K, EVERY = 5, 100
PASS_BYTES = 16 << 20
#: Components allowed: sums of 512 products of such still fit a long.
LIMIT = 1 << 27
#: Rows and anchors of one matrix product, and the share of pairs below which pairs are multiplied one by one.
ROWS, ANCHORS, SPARSE = 4096, 256, 0.05
#: The last planes, in which a block's own bounds are looked at.
LATE = 5
#: No score: less than any, with room for what is added to it.
NONE = -(1 << 62)


def vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """vec_id, label and integer components (rows x length) of the rows that take part, for each length of vector."""
    ids, vecs, labels = batch.column(0), batch.column(1), batch.column(2)
    size = vecs.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    known = ids.is_valid().to_numpy(zero_copy_only=False) & labels.is_valid().to_numpy(zero_copy_only=False) & (size >= 0)
    for n in np.unique(size[known]):
        rows = np.flatnonzero(known & (size == n))
        flat = vecs.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        x = np.floor(256 * flat.reshape(len(rows), n))
        fit = np.isfinite(x).all(1) & (np.abs(np.nan_to_num(x)) <= LIMIT).all(1)
        if fit.any():
            rows = rows[fit]
            yield ids.take(pa.array(rows)).to_numpy().astype(np.int64), labels.take(pa.array(rows)).to_numpy().astype(np.int64), x[fit].astype(np.int64)


class Best:
    """The K best (score, id) of each of n lists; ties go to smaller ids, repeats of both count once."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.score, self.ids = np.full((n, k), NONE), np.zeros((n, k), np.int64)

    def floor(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Only the lists that get something are put in order again, so a call costs what it brings, however many lists there are."""
        if not len(at):
            return
        lists, at = np.unique(at, return_inverse=True)
        old, known = self.score[lists], self.ids[lists]
        some, place = np.nonzero(old != NONE)
        at, score, ids = np.r_[some, at], np.r_[old[some, place], score], np.r_[known[some, place], ids]
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        new = np.r_[True, (at[1:] != at[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])]
        at, score, ids = at[new], score[new], ids[new]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        keep = place < self.k
        old.fill(NONE)
        old[at[keep], place[keep]], known[at[keep], place[keep]] = score[keep], ids[keep]
        self.score[lists], self.ids[lists] = old, known

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, place = np.nonzero(self.score != NONE)
        return at, self.score[at, place], self.ids[at, place]


def planes(x: np.ndarray) -> tuple[list[tuple[int, np.ndarray]], int]:
    """(weight, 0/1 matrix) of a block's bit-planes in two's complement, most significant first; the number of value planes."""
    bits = int(max(x.max(initial=0), -(x.min(initial=0) + 1))).bit_length()
    return [(-(1 << bits), x < 0)] + [(1 << k, (x >> k) & 1 == 1) for k in range(bits - 1, -1, -1)], bits


def sliced(x: np.ndarray, q: np.ndarray, allowed: np.ndarray, least: np.ndarray, most: np.ndarray, k: int = 0, sparse: float = SPARSE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of q, score) of the allowed pairs whose score may lie within least and most of its anchor.

    With ``k``, ``least`` rises to the k-th best lower bound of the anchor; rows of ``x`` must then differ.
    """
    slices, bits = planes(x)
    up, down = np.maximum(q, 0).sum(1), np.minimum(q, 0).sum(1)
    # All sums are exact in single precision for small components, in double for larger ones; else in integers.
    reach = int(np.abs(q).sum(1).max(initial=0)) << (bits + 1)
    kind = np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else np.int64
    whole = (lambda v: v) if kind is np.int64 else (lambda v: np.rint(v).astype(np.int64))
    right, least, score = q.astype(kind).T, least.copy(), np.zeros((len(x), len(q)), kind)
    pairs = None
    for step, (weight, plane) in enumerate(slices):
        left = (1 << (bits - step)) - 1
        if pairs is None:
            score += kind(weight) * (plane.astype(kind) @ right)
            # Bounds of the block's own rows tell most where nothing is known yet, and little while intervals are wide.
            if k and len(x) >= k and len(slices) - step <= LATE and (least == NONE).mean() > 0.5:
                low = np.where(allowed, score + (left * down).astype(kind), kind(NONE))
                least = np.maximum(least, whole(np.partition(low, len(x) - k, axis=0)[len(x) - k]))
            allowed &= (score >= (least - left * up).astype(kind)) & (score <= (most - left * down).astype(kind))
            if allowed.sum() <= sparse * allowed.size:
                pairs = np.nonzero(allowed)
                score = whole(score[pairs])
        else:
            r, a = pairs
            score = score + weight * (np.where(plane[r], q[a], 0).sum(1))
            keep = (score + left * up[a] >= least[a]) & (score + left * down[a] <= most[a])
            pairs, score = (r[keep], a[keep]), score[keep]
    if pairs is None:
        pairs = np.nonzero(allowed)
        score = whole(score[pairs])
    return *pairs, score


class Anchors:
    """A pass's anchors of one length of vector."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray):
        self.ids, self.labels, self.q = ids, labels, q


def _distinct(ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(np.unique(ids)) < len(ids):
        rows = np.unique(np.column_stack([ids, labels, x]), axis=0)
        ids, labels, x = rows[:, 0], rows[:, 1], rows[:, 2:]
    return ids, labels, x


def _blocks(batches: Iterator[pa.RecordBatch], sets: dict[int, Anchors]) -> Iterator[tuple]:
    for batch in batches:
        for ids, labels, x in vectors(batch):
            some = sets.get(x.shape[1])
            if some is None:
                continue
            labels = relabelled(ids, labels)
            ids, labels, x = _distinct(ids, labels, x)
            for i in range(0, len(ids), ROWS):
                for j in range(0, len(some.ids), ANCHORS):
                    yield some, slice(j, min(j + ANCHORS, len(some.ids))), ids[i : i + ROWS], labels[i : i + ROWS], x[i : i + ROWS]


def relabelled(ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
    return np.where(ids % 7 == 0, (labels + 1) % 10, labels)


_FIELDS = ["size", "anchor", "place", "score", "vec_id"]
_SCHEMA = ", ".join(f"{c} long" for c in _FIELDS)


def _out(size: int, anchors: np.ndarray, places: np.ndarray, score: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in (np.full(len(anchors), size), anchors, places, score, ids)], _FIELDS)


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and place over all tasks, and their rank from 1."""
    by = W.Window.partitionBy("size", "anchor", "place").orderBy(F.col("score").desc(), "vec_id")
    # Repeats from several tasks share a rank and are one; that needs no dealing of its own.
    return rows.withColumn("rank", F.dense_rank().over(by)).filter(F.col("rank") <= k).dropDuplicates(["size", "anchor", "place", "rank"])


def positives(rows: DataFrame, sets: dict[int, Anchors], k: int = K) -> DataFrame:
    """size, anchor (its place in its set), place 0, score, vec_id, rank of each anchor's k best other rows of its label."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: Best(len(s.ids), k) for n, s in sets.items()}
        for some, part, ids, labels, x in _blocks(batches, sets):
            top = best[x.shape[1]]
            allowed = (labels[:, None] == some.labels[part]) & (ids[:, None] != some.ids[part])
            wide = np.full(part.stop - part.start, -NONE)
            r, a, score = sliced(x, some.q[part], allowed, top.floor()[part], wide, k if len(np.unique(ids)) == len(ids) else 0)
            top.add(a + part.start, score, ids[r])
        for n, top in best.items():
            at, score, ids = top.rows()
            yield _out(n, at, np.zeros(len(at)), score, ids)

    return _best(rows.mapInArrow(search, _SCHEMA), k)


def negatives(rows: DataFrame, sets: dict[int, Anchors], goals: dict[int, np.ndarray], k: int = K, low: int = 80, high: int = 100) -> DataFrame:
    """As ``positives``, for rows of other labels; place: which positive. ``goals``: scores of the positives (anchors x places, NONE for none)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {n: Best(goals[n].size, k) for n in sets}
        # low * p <= 100 * score <= high * p in integers; a place without a positive, or with one below 0, takes none.
        real = {n: (g != NONE) & (g >= 0) for n, g in goals.items()}
        floors = {n: np.where(real[n], -(-low * np.where(real[n], g, 0) // 100), -NONE) for n, g in goals.items()}
        tops = {n: np.where(real[n], high * np.where(real[n], g, 0) // 100, NONE) for n, g in goals.items()}
        for some, part, ids, labels, x in _blocks(batches, sets):
            n, m = x.shape[1], goals[x.shape[1]].shape[1]
            need = np.maximum(floors[n], best[n].floor().reshape(-1, m))[part]
            most = tops[n][part]
            allowed = labels[:, None] != some.labels[part]
            r, a, score = sliced(x, some.q[part], allowed, need.min(1), most.max(1))
            for place in range(m):
                keep = (score >= need[a, place]) & (score <= most[a, place])
                best[n].add((a[keep] + part.start) * m + place, score[keep], ids[r[keep]])
        for n, top in best.items():
            at, score, ids = top.rows()
            yield _out(n, at // goals[n].shape[1], at % goals[n].shape[1], score, ids)

    return _best(rows.mapInArrow(search, _SCHEMA), k)


def mined(rows: DataFrame, every: int = EVERY, k: int = K, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of ``rows`` (vec_id, embedding, label) whose vec_id divides by ``every``."""
    spark = rows.sparkSession
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    # Equal anchors count once, so that no pass grows by repeats.
    asked = written(rows.filter(F.col("vec_id") % every == 0).filter("label is not null and embedding is not null").distinct(), "anchors")
    total = asked.agg(F.sum(F.size("embedding") * 8 + 64)).first()[0] or 0
    passes = -(-total // pass_bytes)
    found = []
    for at in range(passes):
        sets, tables = {}, {}
        for batch in [b for b in asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == at).toArrow().combine_chunks().to_batches() if b.num_rows]:
            for ids, labels, q in vectors(batch):
                tables.setdefault(q.shape[1], []).append((ids, labels, q))
        for n, parts in tables.items():
            ids, labels, q = (np.concatenate(p) for p in zip(*parts, strict=True))
            ids, labels, q = _distinct(ids, relabelled(ids, labels), q)
            sets[n] = Anchors(ids, labels, q)
        if not sets:
            continue
        near = written(positives(rows, sets, k), "positives")
        of = near.toArrow()
        goals = {n: np.full((len(s.ids), k), NONE) for n, s in sets.items()}
        for n, a, score, rank in zip(*[of[c].to_pylist() for c in ("size", "anchor", "score", "rank")], strict=True):
            goals[n][a, rank - 1] = score
        far = negatives(rows, sets, goals, k)
        names = spark.createDataFrame(pa.table({"size": np.concatenate([np.full(len(s.ids), n) for n, s in sets.items()]), "anchor": np.concatenate([np.arange(len(s.ids)) for s in sets.values()]), "anchor_id": np.concatenate([s.ids for s in sets.values()])}))
        pairs = near.select("size", "anchor", (F.col("rank") - 1).cast("long").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(names, ["size", "anchor"])
        joined = far.withColumnRenamed("vec_id", "negative_id").withColumnRenamed("score", "negative_score").join(pairs, ["size", "anchor", "place"])
        found.append(written(joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "negatives"))
        removed(near)
    removed(asked)
    if not found:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def op12(spark, sf_dir: str) -> DataFrame:
    return mined(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP12_SQL = """
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id, list_inner_product(a.x, r.x)::BIGINT AS score FROM e a JOIN e r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""

