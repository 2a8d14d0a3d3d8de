"""Toxicity by a linear-chain conditional random field over words.

Tokens get two labels. A token's score for "toxic" is the sum of hashed feature weights: the word, its first 3, 4, 5 and 6
bytes, its last 3, and the word before it; transitions have a weight each. Labels are known for documents only, so tokens are
labelled first: in toxic documents, the tokens that have a feature which is much commoner there than in clean
ones; all others are not toxic. The field is fitted by gradient steps on the likelihood of those token labels.

Forward-backward marginals p give each token's probability; a document's score is a logistic function, fitted on the same rows, of the log of
sum(-log(1 - p)), which grows with each offending token, and of the highest p, which does not grow with length; tokens of 0.5 or more make the spans.

Fitting uses a bounded sample: SAMPLE labelled rows a class at most (least hash of the id, no more than SAMPLE_BYTES each), in one task. Everything else
covers all rows and whole texts. Null and empty texts have no tokens and the lowest score; unlabelled, null or conflicting labels
(a doc_id with both) are not learnt from; without labels of both classes every score is the share of toxic labels. Equal rows are scored each;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import doc_texts, written
from lectern.llm.packing import Packed
from lectern.llm.tokens import ALNUM, Words, mix, pieces

TABLE_BITS = 18
PREFIXES = (3, 4, 5, 6)
SAMPLE, SAMPLE_BYTES = 1000, 1 << 15
STEPS, RATE, DECAY = 50, 0.4, 1e-7
#: A feature marks tokens if its share of toxic documents is exp(MARK) times that of clean ones, in at least MARK_DOCS toxic documents and MARK_SHARE of them.
MARK, MARK_DOCS, MARK_SHARE = 1.9, 3, 0.01
#: Weights of steps before fitting: a label is rarely toxic.
MOVES = ((0.0, -5.0), (0.0, -3.0))
PIECE_BYTES = 4 << 20
FOLDS, HELD_OUT = 5, 0


def features(w: Words) -> np.ndarray:
    """(features, tokens): places in the weight table."""
    h = [w.hashes]
    for k in PREFIXES:
        h.append(w.range_hashes(w.starts, np.minimum(w.ends, w.starts + k)))
    h.append(w.range_hashes(np.maximum(w.starts, w.ends - 3), w.ends))
    before = np.r_[np.uint64(0), w.hashes[:-1]] if len(w.hashes) else w.hashes
    first = w.bounds[:-1][np.diff(w.bounds) > 0]
    before[first] = 0
    h.append(before)
    return np.stack([(mix(x + np.uint64(k + 1)) >> np.uint64(64 - TABLE_BITS)).astype(np.int32) for k, x in enumerate(h)])


class Field:
    """weight: of features for label 1; move[i, j]: of the step from label i to j."""

    def __init__(self, weight: np.ndarray, move: np.ndarray, theta: np.ndarray):
        self.weight, self.move, self.theta = weight, move, theta

    def scores(self, places: np.ndarray) -> np.ndarray:
        total = self.weight[places[0]].astype(np.float64)
        for row in places[1:]:
            total += self.weight[row]
        return np.clip(total, -30, 30)

    def marginals(self, score: np.ndarray, p: Packed) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Packed: P(label 1), forward ratios, emission ratios, emission times backward ratios. Ratios are of label 1 to label 0, so no scaling is needed."""
        t = np.exp(self.move)
        e = np.exp(p.pack(score))
        r, g = np.empty(len(e)), np.empty(len(e))
        for k, n in enumerate(p.active):
            at = slice(p.off[k], p.off[k] + n)
            if k == 0:
                r[at] = e[at]
            else:
                x = r[p.off[k - 1] : p.off[k - 1] + n]
                r[at] = np.clip(e[at] * (t[0, 1] + t[1, 1] * x) / (t[0, 0] + t[1, 0] * x), 1e-30, 1e30)
        b = np.ones(len(p.size))
        for k in range(len(p.active) - 1, -1, -1):
            n = p.active[k]
            at = slice(p.off[k], p.off[k] + n)
            g[at] = e[at] * b[:n]
            x = g[at]
            if k:
                back = (t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x)
                b = np.ones(p.active[k - 1])
                b[:n] = back
        odds = r * (g / e)
        return odds / (1 + odds), r, e, g

    def tagged(self, w: Words) -> np.ndarray:
        """P(toxic) of each token."""
        p = Packed(w.bounds)
        return self.marginals(self.scores(features(w)), p)[0][p.place] if len(w.hashes) else np.zeros(0)

    def document_scores(self, p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(document_features(p, bounds) @ self.theta, -40, 40)))


def document_features(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each document: log of sum(-log(1 - p)), log odds of the highest p, 1."""
    p = np.clip(p, 1e-9, 1 - 1e-9)
    total = np.r_[0, np.cumsum(-np.log1p(-p))]
    amount = np.log(np.maximum(total[bounds[1:]] - total[bounds[:-1]], 0) + 1e-4)
    high, some = np.full(len(bounds) - 1, 1e-9), np.diff(bounds) > 0
    if some.any():
        high[some] = np.maximum.reduceat(p, bounds[:-1][some])
    return np.stack([amount, np.log(high / (1 - high)) / 4, np.ones(len(high))], 1)


def token_labels(places: np.ndarray, bounds: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """1 for tokens of toxic documents that have a marking feature (of the word and its prefixes)."""
    doc, size = np.repeat(np.arange(len(toxic)), np.diff(bounds)), 1 << TABLE_BITS
    label = np.zeros(len(doc), bool)
    for row in places[: 1 + len(PREFIXES)]:
        once = np.unique(row.astype(np.int64) * len(toxic) + doc)
        here, of = once // len(toxic), toxic[once % len(toxic)]
        n1, n0 = np.bincount(here[of], minlength=size), np.bincount(here[~of], minlength=size)
        odds = np.log((n1 + 0.5) / (toxic.sum() + 1)) - np.log((n0 + 0.5) / ((~toxic).sum() + 1))
        label |= ((odds >= MARK) & (n1 >= max(MARK_DOCS, MARK_SHARE * toxic.sum())))[row]
    return label & toxic[doc]


def fit(texts: list[str], toxic: np.ndarray, prior: float) -> Field:
    """The field of a bounded list of labelled texts; ``prior``: share of toxic rows among all labelled ones."""
    field = Field(np.zeros(1 << TABLE_BITS), np.array(MOVES), np.array([0.0, 0.0, np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))]))
    if not toxic.any() or toxic.all():
        return field
    w = Words(pa.array(texts, pa.string()), ALNUM)
    places, p = features(w), Packed(w.bounds)
    y = token_labels(places, w.bounds, toxic)
    packed = p.pack(y.astype(np.float64))
    # Where the element before stands, for all but first ones.
    step = np.repeat(np.arange(len(p.active)), p.active)
    later = np.flatnonzero(step > 0)
    prev = p.off[step[later] - 1] + (later - p.off[step[later]])
    observed = np.zeros((2, 2))
    np.add.at(observed, (packed[prev].astype(int), packed[later].astype(int)), 1)
    seen, moved = np.full(1 << TABLE_BITS, 1e-8), np.full((2, 2), 1e-8)
    n = max(1, len(y))
    for _ in range(STEPS):
        prob, r, _, g = field.marginals(field.scores(places), p)
        a, b, t = r[prev], g[later], np.exp(field.move)
        pair = np.stack([np.full(len(a), t[0, 0]), t[0, 1] * b, t[1, 0] * a, t[1, 1] * a * b])
        pair = (pair / pair.sum(0)).sum(1).reshape(2, 2)
        gap = (y - prob[p.place]) / n
        slope = sum(np.bincount(row, gap, 1 << TABLE_BITS) for row in places) - DECAY * field.weight
        seen += slope**2
        field.weight += RATE * slope / np.sqrt(seen)
        slope = (observed - pair) / n
        slope[0, 0] = 0
        moved += slope**2
        field.move += RATE * slope / np.sqrt(moved)
    # Logistic regression of the documents, weighted to the prior.
    field.weight = field.weight.astype(np.float32)
    design, theta = document_features(field.marginals(field.scores(places), p)[0][p.place], w.bounds), np.zeros(3)
    weight = np.where(toxic, prior / toxic.mean(), (1 - prior) / (1 - toxic.mean()))
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        hessian = (design * (weight * q * (1 - q))[:, None]).T @ design + 1e-2 * np.eye(3)
        theta += np.clip(np.linalg.solve(hessian, design.T @ (weight * (toxic - q)) - 1e-2 * theta), -2, 2)
    field.theta = theta
    return field


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """text, toxic of at most SAMPLE labelled documents a class outside the held-out fold, one row an id; the share of toxic rows among all of those labelled.

    Ids and lengths meet the labels; texts are read once, against a broadcast of the chosen ids, and are never shuffled whole.
    """
    clear = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").select("doc_id", (F.col("toxic") > 0).alias("toxic"))
    clear = clear.filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) != HELD_OUT)
    fits = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length("text").alias("n")).filter(f"n between 1 and {SAMPLE_BYTES}").groupBy("doc_id").agg(F.max("n").alias("n"))
    known = written(clear.join(fits, "doc_id", "left").select("doc_id", "toxic", F.col("n").isNotNull().alias("fits"), F.xxhash64("doc_id").alias("h")), "labelled")
    count = {r.toxic: (r.n, r.fit) for r in known.groupBy("toxic").agg(F.count("*").alias("n"), F.count_if("fits").alias("fit")).collect()}
    ids = []
    for kind in (True, False):
        # About twice as many as are wanted have a hash under the bound, however many there are; the least of them are taken.
        bound = min((1 << 63) - 1, int((2 * SAMPLE / max(1, count.get(kind, (0, 0))[1]) * 2 - 1) * (1 << 63)))
        ids += [(r.doc_id, kind) for r in known.filter((F.col("toxic") == kind) & F.col("fits") & (F.col("h") <= bound)).select("doc_id", "h").orderBy("h", "doc_id").limit(SAMPLE).collect()]
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id long, toxic boolean")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(f"octet_length(text) between 1 and {SAMPLE_BYTES}").join(F.broadcast(chosen), "doc_id")
    total = sum(n for n, _ in count.values())
    return texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")), count.get(True, (0, 0))[0] / max(1, total)


def train(docs: DataFrame, labels: DataFrame) -> Field:
    """Fits a field to the labelled documents outside the held-out fold: one task over the bounded sample; the weights come to the driver."""
    rows, prior = sample(docs, labels)

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct: dict[tuple, None] = {}  # copies say nothing about words
        for batch in batches:
            distinct |= dict.fromkeys(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
        field = fit([t for t, _ in distinct], np.array([kind for _, kind in distinct], bool), prior)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (field.weight.astype(np.float32), field.move, field.theta)], ["weight", "move", "theta"])

    # Sorted, so that a second run of the task sees the same order.
    r = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").mapInArrow(fitted, "weight binary, move binary, theta binary").first()
    if r is None:  # no rows, no task
        return fit([], np.zeros(0, bool), prior)
    return Field(np.frombuffer(r.weight, np.float32), np.frombuffer(r.move).reshape(2, 2), np.frombuffer(r.theta))


def tag(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score, n_toxic, spans (start, end in bytes of the UTF-8 text) of each row of ``docs``."""

    def tags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in pieces(batches, PIECE_BYTES):
            w = Words(batch.column(1), ALNUM)
            p = field.tagged(w)
            bad = np.flatnonzero(p >= 0.5)
            doc = np.searchsorted(w.bounds, bad, "right") - 1
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            for k, d in zip(bad, doc, strict=True):
                a, b = int(w.starts[k] - w.offsets[d]), int(w.ends[k] - w.offsets[d])
                if spans[d] and k and bad[np.searchsorted(bad, k) - 1] == k - 1:
                    spans[d][-1]["end"] = b
                else:
                    spans[d].append({"start": a, "end": b})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(field.document_scores(p, w.bounds)), pa.array(np.bincount(doc, minlength=batch.num_rows)), pa.array(spans, kind)], ["doc_id", "score", "n_toxic", "spans"])

    return doc_texts(docs).mapInArrow(tags, "doc_id long, score double, n_toxic long, spans array<struct<start: int, end: int>>")


def op4(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = tag(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")))
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic", "spans")


def clean(docs: DataFrame, field: Field, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with all their columns."""
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts = batch.column(at).fill_null("")
                for b in pieces(iter([batch.set_column(at, "text", texts)]), PIECE_BYTES):
                    w = Words(b.column(at), ALNUM)
                    rows = np.flatnonzero(field.document_scores(field.tagged(w), w.bounds) < threshold)
                    start = b.column(at).offset - texts.offset
                    yield batch.take(pa.array(rows + start))

    return docs.mapInArrow(keep, docs.schema)
