"""Substring deduplication by sliding sentence spans.

Every run of RUN consecutive sentences is hashed (96 bits) and joined globally; so are runs of fewer sentences that hold
LONG_WORDS words or are a whole document, so that passages of one or two long sentences take part at any place. A run that occurs
before, in document or position order, marks its sentences, and all marked sentences are removed. Sentences end at line ends and
at [.!?] before blanks.

1. Each block of texts keeps the first occurrence of a run and marks its others, which nothing outside the block can change.
2. First occurrences of all blocks meet by hash; all but the least are marks. A run has one row a block there, however common it is.
3. Marks are gathered by document, no more than its own runs, and cut from the text where it stands.

Every row of ``docs`` is returned. Null and empty texts have no sentences. Rows with equal doc_id are told apart by their text; equal rows
count once and are cut alike. Rows with a null id take no part and stay as they are. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lectern.llm.common import doc_texts, removed, written
from lectern.llm.tokens import hash_ranges, mix, pieces, text_bytes

RUN = 3
#: Runs of fewer than RUN sentences need so many words.
LONG_WORDS = 20
BLOCK_BYTES = 8 << 20
_SEED = 0x5851F42D


class Sentences:
    """starts, ends: byte ranges of all sentences; bounds[i]:bounds[i+1] are those of text i; words: of each sentence."""

    def __init__(self, texts: pa.Array):
        self.data, offsets = text_bytes(texts)
        data, n = self.data, len(self.data)
        blank, first = (data == 32) | (data == 9), np.zeros(n + 1, bool)
        first[offsets] = True
        # Blanks after a sentence's end are a line end; a run of blanks stays within its text.
        opens = np.flatnonzero(blank & np.r_[True, ~blank[:-1] | first[1:-1]]) if n else np.zeros(0, np.int64)
        closes = np.flatnonzero(blank & np.r_[~blank[1:] | first[1:-1], True]) if n else opens
        before = data[np.maximum(opens - 1, 0)]
        after_end = ((before == 46) | (before == 33) | (before == 63)) & ~first[opens] if n else np.zeros(0, bool)
        gap = np.zeros(n + 1, np.int32)
        np.add.at(gap, opens[after_end], 1)
        np.add.at(gap, closes[after_end] + 1, -1)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = (data != 10) & (np.cumsum(gap[:-1]) == 0)
        starts = np.flatnonzero((inside[1:] & (~inside[:-1] | first))[:-1])
        ends = np.flatnonzero(inside[:-1] & (~inside[1:] | first))
        full = np.flatnonzero(data != 32)
        left, right = np.searchsorted(full, starts), np.searchsorted(full, ends)
        some = left < right
        self.starts, self.ends = full[left[some]], full[right[some] - 1] + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        word = inside[1:-1] & ~blank
        begins = np.flatnonzero(word & np.r_[True, ~word[:-1] | first[1:-1]]) if n else np.zeros(0, np.int64)
        self.words = np.searchsorted(begins, self.ends) - np.searchsorted(begins, self.starts)
        self.offsets = offsets

    def hashes(self, seed: int) -> np.ndarray:
        padded = np.zeros(len(self.data) + 16, np.uint8)
        padded[8 : len(self.data) + 8] = self.data
        return hash_ranges(padded, self.starts, self.ends, seed)

    def text(self, k: int) -> str:
        return self.data[self.starts[k] : self.ends[k]].tobytes().decode()


def runs_of(s: Sentences, run: int = RUN, long_words: int = LONG_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, place (from 1), length, and two hashes of 64 and 32 bits of all runs, in the order of texts and places."""
    size = np.diff(s.bounds)
    doc, total = np.repeat(np.arange(len(size)), size), np.r_[0, np.cumsum(s.words)]
    at, left = np.arange(len(doc)), s.bounds[1:][doc] - np.arange(len(doc))
    a, b = s.hashes(0), s.hashes(_SEED)
    h, g, found = np.zeros(len(doc), np.uint64), np.zeros(len(doc), np.uint64), []
    for n in range(1, run + 1):
        fits = left >= n
        at, left, h, g = at[fits], left[fits], h[fits], g[fits]
        h, g = (mix(x * np.uint64(0x9E3779B97F4A7C15) + y[at + n - 1] + np.uint64(n)) for x, y in ((h, a), (g, b)))
        keep = np.ones(len(at), bool) if n == run else (total[at + n] - total[at] >= long_words) | (size[doc[at]] == n)
        k = at[keep]
        found.append((doc[k], k - s.bounds[doc[k]] + 1, np.full(len(k), n), h[keep], g[keep] >> np.uint64(32)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def marked(docs: DataFrame, run: int = RUN, long_words: int = LONG_WORDS) -> DataFrame:
    """doc_id, doc (hash of the text), marks: (place, length) of runs of which another occurrence comes first."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h1", "h2", "doc_id", "doc", "place", "length", "late"]
        for batch in pieces(batches, BLOCK_BYTES):
            ids, key = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            order = np.lexsort((key, ids))
            batch, ids, key = batch.take(pa.array(order)), ids[order], key[order]
            row, place, length, h1, h2 = runs_of(Sentences(batch.column(1)), run, long_words)
            by = np.lexsort((place, row, h2, h1))
            row, place, length, h1, h2 = (x[by] for x in (row, place, length, h1, h2))
            new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])] if len(row) else np.zeros(0, bool)
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            late = ~new & ~((ids[row] == ids[row[lead]]) & (key[row] == key[row[lead]]) & (place == place[lead]))
            keep = new | late
            row, place, length, h1, h2, late = (x[keep] for x in (row, place, length, h1, h2, late))
            columns = [pa.array(h1.view(np.int64)), pa.array(h2.astype(np.uint32).view(np.int32)), pa.array(ids[row]), pa.array(key[row]), pa.array(place.astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(late)]
            yield pa.RecordBatch.from_arrays(columns, names)

    keyed = doc_texts(docs.filter("doc_id is not null")).withColumn("doc", F.xxhash64("text"))
    runs = written(keyed.mapInArrow(block, "h1 long, h2 int, doc_id long, doc long, place int, length int, late boolean"), "runs")
    columns = ["doc_id", "doc", "place", "length"]
    order = F.rank().over(W.Window.partitionBy("h1", "h2").orderBy("doc_id", "doc", "place"))
    later = runs.filter("not late").withColumn("at", order).filter("at > 1").select(columns)
    marks = written(later.union(runs.filter("late").select(columns)).groupBy("doc_id", "doc").agg(F.collect_set(F.struct("place", "length")).alias("marks")), "marks")
    removed(runs)
    return marks


def _gone(marks: list[dict], words: np.ndarray, min_words: int) -> np.ndarray:
    """The covered sentences, but for adjoining ones of fewer than ``min_words`` words."""
    gone = np.zeros(len(words) + 2, bool)
    for m in marks:
        gone[m["place"] : m["place"] + m["length"]] = True
    starts, ends = np.flatnonzero(gone[1:] & ~gone[:-1]), np.flatnonzero(gone[:-1] & ~gone[1:])
    for a, b in zip(starts, ends, strict=True) if min_words else ():
        if words[a:b].sum() < min_words:
            gone[a + 1 : b + 1] = False
    return gone[1:-1]


def deduplicated(docs: DataFrame, run: int = RUN, min_words: int = 0, long_words: int = LONG_WORDS) -> DataFrame:
    """Every row of ``docs``: doc_id, n_sentences, n_removed, removed (places from 1), text as it stays: untouched, or the lines that are left joined by newlines."""
    marks = marked(docs, run, long_words)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_sentences", "n_removed", "removed", "text"]
        for batch in pieces(batches, BLOCK_BYTES):
            s, texts, removed = Sentences(batch.column(1)), batch.column(1).to_pylist(), []
            for k, of in enumerate(batch.column(2).to_pylist()):
                a, b = s.bounds[k : k + 2]
                gone = _gone(of, s.words[a:b], min_words) if of else np.zeros(0, bool)
                removed.append((np.flatnonzero(gone) + 1).tolist())
                if removed[-1]:
                    texts[k] = "\n".join(s.text(i) for i in a + np.flatnonzero(~gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(s.bounds)), pa.array([len(x) for x in removed], pa.int64()), pa.array(removed, pa.list_(pa.int32())), pa.array(texts, pa.string())], names)

    rows = doc_texts(docs).withColumn("doc", F.xxhash64("text"))
    known = rows.filter("doc_id is not null").join(marks, ["doc_id", "doc"], "left").select("doc_id", "text", "marks")
    both = known.union(rows.filter("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<struct<place: int, length: int>>").alias("marks")))
    return both.mapInArrow(cut, "doc_id long, n_sentences long, n_removed long, removed array<int>, text string")


def op10(spark, sf_dir: str) -> DataFrame:
    out = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, text, md5(text) AS t, list_filter(list_transform(lines, lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM d),
q AS (SELECT DISTINCT doc_id, t, s FROM l WHERE doc_id IS NOT NULL),
x AS (SELECT doc_id, t, len(s) AS n, unnest(s) AS s, generate_subscripts(s, 1) AS p FROM q),
y AS (SELECT *, len(list_filter(regexp_split_to_array(s, '[ \t]+'), lambda w: w <> '')) AS words FROM x),
z AS (SELECT *, lead(s, 1) OVER w AS s1, lead(s, 2) OVER w AS s2, words + lead(words, 1) OVER w AS words2 FROM y WINDOW w AS (PARTITION BY doc_id, t ORDER BY p)),
k AS (SELECT doc_id, t, p, 1 AS size, s AS run FROM z WHERE words >= 20 OR n = 1
      UNION ALL SELECT doc_id, t, p, 2, s || chr(10) || s1 FROM z WHERE s1 IS NOT NULL AND (words2 >= 20 OR n = 2)
      UNION ALL SELECT doc_id, t, p, 3, s || chr(10) || s1 || chr(10) || s2 FROM z WHERE s2 IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, t, p) AS place FROM k),
m AS (SELECT DISTINCT doc_id, t, unnest(generate_series(p, p + size - 1)) AS p FROM f WHERE place > 1),
a AS (SELECT doc_id, t, count(m.p) AS n_removed, string_agg(x.p::VARCHAR, ',' ORDER BY x.p) FILTER (m.p IS NOT NULL) AS removed, coalesce(string_agg(s, chr(10) ORDER BY x.p) FILTER (m.p IS NULL), '') AS text
      FROM x LEFT JOIN m USING (doc_id, t, p) GROUP BY doc_id, t)
SELECT l.doc_id, len(s)::BIGINT AS n_sentences, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed, CASE WHEN n_removed > 0 THEN a.text ELSE l.text END AS text
FROM l LEFT JOIN a ON l.doc_id = a.doc_id AND l.t = a.t
"""
