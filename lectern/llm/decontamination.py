"""Benchmark decontamination by a distributed positional inverted index.

The training texts are indexed in segments of a few MB: a segment is a row of a written table that holds every term of its texts, in
order, with the ascending list of the term's word positions there, and its documents. The index does not depend on a benchmark: it is built once and serves
every search, and an executor that is lost loses no more than the segments it had. Phrases (windows of a
benchmark item) are searched in each segment, where the row stands, by taking the list of their rarest term
shifted back by its offset and intersecting it with the shifted lists of the others from
rare to common until it is empty or all agree. A proximity search takes the rarest term's positions that have all other terms
within ``slop`` words, in any order.

Terms are 64-bit hashes of lower-cased words. Null texts have no words; items without words
or without an id take no part; repeated item ids count once; repeated documents are
each reported. Columns other than doc_id/text (item_id/text) are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import doc_texts, removed, written
from lectern.llm.tokens import ALNUM, Words, lists, pieces

WINDOW = 10
SEGMENT_BYTES = 4 << 20
#: Bytes of the index that a row group holds, about: what a task decodes at once.
GROUP_BYTES = 8 << 20
#: Words between the positions of neighbouring documents, so that no phrase or neighbourhood spans two.
GAP = 1 << 12
#: Benchmark words, about, that a search takes at once: what it sends to the driver and each executor is bounded by it.
PASS_WORDS = 100_000
#: Words that the proximity search of op1 looks at before and after a rarest term.
SLOP = 15
INDEX = "segment long, terms array<long>, ends array<int>, positions array<int>, doc_ids array<long>, doc_words array<int>"
#: Fixed value: the word pattern of the contract, and the same for texts before lower-casing.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def build_index(docs: DataFrame) -> DataFrame:
    """A row a segment: its sorted terms, where the positions of each end, their word positions, and its documents with their numbers of words."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        whole = lambda x: lists(x, np.array([0, len(x)]))
        for batch in pieces(batches, SEGMENT_BYTES):
            w = Words(batch.column(1), ALNUM)
            counts = np.diff(w.bounds)
            positions = (np.arange(len(w.hashes)) + GAP * np.repeat(np.arange(len(counts)), counts)).astype(np.int32)
            order = np.argsort(w.hashes, kind="stable")
            h = w.hashes[order]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
            ids = pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64()))
            ends = np.r_[first[1:], len(h)][: len(first)].astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([segment]), whole(h[first].view(np.int64)), whole(ends), whole(positions[order]), ids, whole(counts.astype(np.int32))], ["segment", "terms", "ends", "positions", "doc_ids", "doc_words"])
            segment += 1

    return written(doc_texts(docs).mapInArrow(index, INDEX), "positions", GROUP_BYTES)


def _array(column: pa.Array, k: int) -> np.ndarray:
    return column[k].values.to_numpy(zero_copy_only=False)


def frequencies(index: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """Occurrences in the whole index of each of ``terms`` (sorted) that is there; only the columns of terms are read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                own, ends = _array(batch.column(0), k).view(np.uint64), _array(batch.column(1), k)
                at, sizes = np.searchsorted(own, terms), np.diff(ends, prepend=0)
                here = np.flatnonzero(at < len(own))
                here = here[own[at[here]] == terms[here]]
                total[here] += sizes[at[here]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["k", "n"])

    rows = index.select("terms", "ends").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect() if len(terms) else []
    return {r.k: r.n for r in rows}  # at most a row a term of this pass


def phrases(items: list[tuple[str, str]], window: int) -> list[tuple[str, np.ndarray]]:
    """The distinct windows of the items as (item, term hashes)."""
    out, texts = {}, [t for _, t in items]
    if texts:
        w = Words(pa.array(texts), ALNUM)
        for (item, _), a, b in zip(items, w.bounds[:-1], w.bounds[1:], strict=True):
            size = min(window, b - a)
            for k in range(a, b - size + 1) if size else ():
                out[item, w.hashes[k : k + size].tobytes()] = w.hashes[k : k + size]
    return [(item, terms) for (item, _), terms in out.items()]


class Plan:
    """The phrases of a pass, whose terms all occur in the corpus: a row of term numbers each, from rare to common, and of their offsets; shorter ones are filled up with -1."""

    def __init__(self, found: list[tuple[str, np.ndarray]], terms: np.ndarray, frequency: dict[int, int]):
        self.terms = terms
        n = np.zeros(len(terms) + 1, np.int64)  # the last is for filling
        n[list(frequency)] = list(frequency.values())
        rows = [np.searchsorted(terms, t) for _, t in found]
        keep = [k for k, r in enumerate(rows) if n[r].all()]
        width = max((len(rows[k]) for k in keep), default=1)
        self.items = [found[k][0] for k in keep]
        self.sizes = np.array([len(rows[k]) for k in keep], np.int32)
        self.numbers, self.offsets = np.full((len(keep), width), -1, np.int32), np.zeros((len(keep), width), np.int32)
        for i, k in enumerate(keep):
            order = np.lexsort((np.arange(len(rows[k])), n[rows[k]]))
            self.numbers[i, : len(order)], self.offsets[i, : len(order)] = rows[k][order], order

    def alive(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The phrases all of whose terms are among ``own`` (sorted), and where each term stands there."""
        at = np.searchsorted(own, self.terms)
        there = np.zeros(len(self.terms) + 1, bool)
        there[-1] = True
        here = np.flatnonzero(at < len(own))
        there[here] = own[at[here]] == self.terms[here]
        return np.flatnonzero(there[self.numbers].all(axis=1)), at


def _starts(found: list[np.ndarray], offsets: np.ndarray) -> np.ndarray:
    """Positions at which all terms stand at their offsets."""
    at = found[0].astype(np.int64) - offsets[0]
    for here, offset in zip(found[1:], offsets[1:], strict=True):
        if not len(at):
            break
        k = np.minimum(np.searchsorted(here, at + offset), len(here) - 1)
        at = at[here[k] == at + offset]
    return at


def _near(found: list[np.ndarray], slop: int) -> np.ndarray:
    """Positions of the rarest term with every other term within ``slop`` words of it."""
    at = found[0].astype(np.int64)
    for here in found[1:]:
        if not len(at):
            break
        at = at[np.searchsorted(here, at - slop) < np.searchsorted(here, at + slop, "right")]
    return at


def searched(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int | None = None, pass_words: int = PASS_WORDS) -> DataFrame:
    """Per document of the index: doc_id, n_words, hits (word places inside occurrences of windows), items, near_items.

    ``items`` (item, text) are searched in passes of about ``pass_words`` words each: more passes, not larger ones, serve a larger benchmark.
    """
    words = items.agg(F.sum(F.regexp_count("text", F.lit(ANY_CASE)))).first()[0] or 0
    passes = -(-words // pass_words) or 1
    results = None
    for k in range(passes):
        block = items.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == k)
        found = phrases([(r.item, r.text) for r in block.collect()], window)
        terms = np.unique(np.concatenate([t for _, t in found])) if found else np.zeros(0, np.uint64)
        plan = Plan(found, terms, frequencies(index, terms))
        result = index.mapInArrow(_searcher(plan, slop), "doc_id long, n_words long, hits array<int>, items array<string>, near_items array<string>, row int, segment long")
        results = result if results is None else results.union(result)
    if passes > 1:
        both = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        results = results.groupBy("segment", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), both("hits"), both("items"), both("near_items"))
    return results.select("doc_id", "n_words", "hits", "items", "near_items")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None, pass_words: int = PASS_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit (words inside occurrences of windows), hits, items (sorted ids), near_items.

    ``slop``: also report as near_items the items of which some window has all its
    words within so many words of its rarest one, in any order; at most GAP / 2.
    """
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), "text")
    index = build_index(docs)
    results = written(searched(index, items, window, slop, pass_words), "found")
    removed(index)
    return results.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), "hits", "items", "near_items")


def _searcher(plan: Plan, slop: int | None):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield one(batch, k)

    def one(batch: pa.RecordBatch, row: int) -> pa.RecordBatch:
        own, ends, positions = _array(batch.column(1), row).view(np.uint64), _array(batch.column(2), row), _array(batch.column(3), row)
        ids, sizes = batch.column(4)[row].as_py(), _array(batch.column(5), row).astype(np.int64)
        base = np.r_[0, np.cumsum(sizes + GAP)]
        items: dict[int, set] = {}
        near: dict[int, set] = {}
        hits: dict[int, set] = {}
        phrases_here, at_term = plan.alive(own)
        for i in phrases_here:
            size, item = int(plan.sizes[i]), plan.items[i]
            places = at_term[plan.numbers[i, :size]]
            found = [positions[ends[p - 1] if p else 0 : ends[p]] for p in places]
            at = _starts(found, plan.offsets[i, :size])
            for p, d in zip(at, np.searchsorted(base, at, "right") - 1, strict=True):
                items.setdefault(d, set()).add(item)
                hits.setdefault(d, set()).update(range(p - base[d], p - base[d] + size))
            if slop is not None:
                for d in np.unique(np.searchsorted(base, _near(found, slop), "right") - 1):
                    near.setdefault(d, set()).add(item)
        n = len(ids)
        columns = {
            "doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(sizes), "hits": pa.array([sorted(int(x) for x in hits.get(d, ())) for d in range(n)], pa.list_(pa.int32())),
            "items": pa.array([sorted(items.get(d, ())) for d in range(n)], pa.list_(pa.string())), "near_items": pa.array([sorted(near.get(d, ())) for d in range(n)], pa.list_(pa.string())),
            "row": pa.array(np.arange(n, dtype=np.int32)), "segment": pa.array(np.full(n, batch.column(0)[row].as_py())),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return search


def op1(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination(docs, benchmark, slop=SLOP)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "near_items")


def brute(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """The contract of op1 word by word, for tests."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: WORD.findall((t or "").translate(fold))
    spans: dict[tuple, set] = {}
    for i, t in items:
        w = words(t) if i is not None else []
        for k in range(max(1, len(w) - window + 1)) if w else ():
            spans.setdefault(tuple(w[k : k + min(window, len(w))]), set()).add(str(i))
    out = []
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for size in {len(s) for s in spans}:
            for k in range(len(w) - size + 1):
                if found := spans.get(tuple(w[k : k + size])):
                    ids |= found
                    hit |= set(range(k, k + size))
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out
