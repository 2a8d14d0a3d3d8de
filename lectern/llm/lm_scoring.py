"""LM scoring by a hidden Markov model over word classes.

Hidden states move from word to word; a state emits a word's class, and the class its word:
P(w | state) = P(class | state) * P(w | class). P(w | class) is (c + 0.5) over the sum of that for the class's words and one
unseen word, with the counts c of all training words. The FREQUENT commonest words of all training
texts have a class each, other words share one by their endings, the end of a text has its own.

1. Texts become ids of a dictionary a block of texts (a written table).
2. Dictionary entries of all blocks are summed by word, never tokens. Words that some blocks hold often, COMMON at most, are summed where they stand and
   broadcast; the others have one row a block in the task of their word.
3. Counts go back to their blocks, where texts become class sequences (a written table) and base scores.
4. Baum-Welch from a random model. The first pass takes the training texts in SLICES slices and moves the model after each by the slice's expected
   counts, weighed down from slice to slice (stepwise EM); ROUNDS passes over all of them follow. Each step runs forward-backward over whole sequences, and expected counts are
   summed by class in Spark. A sequence of more than TOKENS tokens is taken in pieces that hand the forward and backward state on.
5. The scaled forward recursion over whole sequences gives each text's likelihood exactly.

Words are 64-bit hashes. Null and empty texts are the end token alone; a null doc_id counts as training; equal rows are scored each;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lectern.llm.common import doc_texts, table_path, written
from lectern.llm.packing import Packed
from lectern.llm.tokens import SPACED, Words, mix, pieces

STATES = 8
FREQUENT = 4096
ENDINGS = 4096
#: The end token's class; classes are 0 to END.
END = FREQUENT + ENDINGS
#: Steps of the first pass, by the hash of the id; passes over all texts after it; how slowly the weight of a slice falls.
SLICES, ROUNDS, FALL = 8, 2, 0.6
#: Words summed and sent by a broadcast, at most, and what a block must hold of a word for it to be one of them.
COMMON, OFTEN = 1 << 16, 8
#: Forward-backward holds so many tokens at once, and sorts HELD of them by length.
TOKENS, HELD = 1 << 19, 1 << 23
BLOCK_BYTES = 8 << 20
FOLDS, HELD_OUT = 5, 1


class Model:
    """start (K), move (K x K), emit (classes x K)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def random(cls, states: int) -> Model:
        rng = np.random.default_rng(7)
        emit = rng.gamma(1.0, 1.0, (END + 1, states)) + 0.5
        move = rng.random((states, states)) * 0.2 / states + np.eye(states)
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    @classmethod
    def of_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        start, move, emit = start + 0.1, move + 0.1, emit + 0.01
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def forward(model: Model, classes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """log10 likelihood of each sequence, by the scaled forward recursion."""
    p = Packed(bounds)
    symbols, total, a = p.pack(classes), np.zeros(len(p.size)), None
    for t, n in enumerate(p.active):
        b = model.emit[symbols[p.off[t] : p.off[t] + n]]
        a = (model.start if t == 0 else a[:n] @ model.move) * b
        scale = a.sum(1)
        a /= scale[:, None]
        total[:n] += np.log10(scale)
    out = np.empty(len(total))
    out[p.order] = total
    return out


def _forward_backward(model: Model, classes: np.ndarray, bounds: np.ndarray, before: np.ndarray | None = None, later: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Expected starts, moves and emissions by state, and what is handed back to the piece before. ``before``, ``later``: state handed on where a single text goes on from, or to, another piece."""
    # States are rows, so that every step is an operation along the sequences.
    p, k = Packed(bounds), len(model.start)
    symbols, ones = p.pack(classes).astype(np.int64), np.ones(len(model.start))
    out_of, into, emission = np.ascontiguousarray(model.move), np.ascontiguousarray(model.move.T), np.ascontiguousarray(model.emit.T)
    b = np.empty((k, len(symbols)))
    for s in range(k):
        np.take(emission[s], symbols, out=b[s], mode="clip")
    alpha, scale = np.empty_like(b), np.empty(len(symbols))
    first = model.start[:, None] if before is None else into @ before
    for t, n in enumerate(p.active):
        at = slice(p.off[t], p.off[t] + n)
        a = (into @ alpha[:, p.off[t - 1] : p.off[t - 1] + n] if t else first) * b[:, at]
        scale[at] = ones @ a
        np.divide(a, scale[at], out=alpha[:, at])
    b /= scale
    start, move = np.zeros(k), np.zeros((k, k))
    for t in range(len(p.active) - 1, -1, -1):
        here, m = slice(p.off[t], p.off[t] + p.active[t]), 0 if later is None else later.shape[1]
        if m:
            a, beta = alpha[:, here][:, :m], out_of @ later
            move += a @ later.T
            a *= beta  # the state's posterior
            b[:, here][:, :m] *= beta
        later = b[:, here]
        if t == 0 and before is None:
            start = alpha[:, here].sum(1)
    emit = np.stack([np.bincount(symbols, alpha[s], END + 1) for s in range(k)], 1)
    return start, move * model.move, emit, later


def expected_counts(model: Model, classes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward: expected starts, moves and emissions by state."""
    return _forward_backward(model, classes, bounds)[:3]


def long_counts(model: Model, classes: np.ndarray, size: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The expected counts of one sequence, holding ``size`` tokens (TOKENS by default) at once."""
    cuts = np.arange(0, len(classes), size or TOKENS)
    before, a = [None], None
    for at, symbol in enumerate(classes[: cuts[-1]], 1):
        a = (model.start if a is None else a @ model.move) * model.emit[symbol]
        a /= a.sum()
        if at == cuts[len(before)]:
            before.append(a[:, None])
            if len(before) == len(cuts):
                break
    total, later = None, None
    for at, state in zip(cuts[::-1], before[::-1], strict=True):
        piece = classes[at : at + (size or TOKENS)]
        *part, later = _forward_backward(model, piece, np.array([0, len(piece)]), state, later)
        total = part if total is None else [x + y for x, y in zip(total, part, strict=True)]
    return tuple(total)


def all_counts(model: Model, classes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The expected counts of any number of sequences: those of like length together, at most TOKENS tokens at once."""
    k = len(model.start)
    total = [np.zeros(k), np.zeros((k, k)), np.zeros((END + 1, k))]
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    ends, at = np.r_[0, np.cumsum(sizes[order])], 0
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + TOKENS, "right")) - 1)
        some = order[at:to]
        flat = np.concatenate([classes[bounds[i] : bounds[i + 1]] for i in some])
        part = expected_counts(model, flat, ends[at : to + 1] - ends[at]) if len(flat) <= TOKENS else long_counts(model, flat)
        total = [x + y for x, y in zip(total, part, strict=True)]
        at = to
    return total


def endings_of(words: Words, at: np.ndarray) -> np.ndarray:
    """Classes by ending of the words number ``at``."""
    ending = words.range_hashes(np.maximum(words.starts[at], words.ends[at] - 3), words.ends[at])
    return FREQUENT + (mix(ending) % np.uint64(ENDINGS)).astype(np.int32)


def _blocks(docs: DataFrame) -> DataFrame:
    """Per text: block, doc_id, held_out, ids (its words as numbers of the block's dictionary). Per block: words, counts (in training texts) and classes by ending of the dictionary."""
    schema = "block long, doc_id long, held_out boolean, ids binary, words array<long>, counts array<int>, classes array<int>"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        names = ["block", "doc_id", "held_out", "ids", "words", "counts", "classes"]
        for batch in pieces(batches, BLOCK_BYTES):
            w = Words(batch.column(1), SPACED)
            found, first, ids = np.unique(w.hashes, return_index=True, return_inverse=True)
            held = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
            sizes, n = np.diff(w.bounds), batch.num_rows
            counts = np.bincount(ids[np.repeat(~held, sizes)], minlength=len(found))
            # Numbers from common to rare: small ones compress.
            order = np.argsort(-np.bincount(ids, minlength=len(found)), kind="stable")
            number = np.empty(len(found), np.uint32)
            number[order] = np.arange(len(found))
            ids = number[ids]
            rows = pa.array([ids[a:b].tobytes() for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), batch.column(0), batch.column(2), rows, pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int32()))], names)
            whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
            kinds = endings_of(w, first)[order]
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.binary()), whole(found[order].view(np.int64)), whole(counts[order].astype(np.int32)), whole(kinds)], names)
            block += 1

    return written(docs.select("doc_id", "text", "held_out").mapInArrow(encode, schema), "lm-blocks")


def _bit(table: DataFrame, column: str, most: int, reach: bool = False) -> int:
    """The least k such that at most ``most`` rows of ``table`` have 2**k or more in ``column``; with ``reach``, the first k by which there are more. A row a bit comes to the driver."""
    rows = table.groupBy(F.floor(F.log2(column)).cast("int").alias("bit")).agg(F.count("*").alias("n")).collect()
    k, n = 0 if reach else 64, 0
    for r in sorted(rows, key=lambda r: -r.bit):
        n += r.n
        if n > most:
            return r.bit if reach else k
        k = r.bit
    return k


def commonest(counted: DataFrame) -> DataFrame:
    """words, own: the FREQUENT commonest of all training words (``counted``: words, c) and their classes."""
    # Words under the bit that holds the last of them are not sorted, so that tasks send few others.
    top = counted.filter(F.col("c") >= F.lit(2.0) ** _bit(counted, "c", FREQUENT - 1, reach=True)).orderBy(F.desc("c"), "words").limit(FREQUENT).collect()
    return counted.sparkSession.createDataFrame([(r.words, i) for i, r in enumerate(top)], "words long, own int")


def counts_of(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """block, number, words, c, classes of all dictionary entries; words, c, classes of all training words, once each. c: the count in all training texts."""
    entries = blocks.filter("words is not null").select("block", F.posexplode(F.arrays_zip("words", "counts", "classes")).alias("number", "e")).select("block", "number", "e.words", "e.counts", "e.classes")
    often = written(entries.filter(F.col("counts") >= OFTEN).groupBy("words").agg(F.sum("counts").alias("least")), "lm-often")
    some = often.filter(F.col("least") >= F.lit(2.0) ** _bit(often, "least", COMMON)).select("words")
    common = written(entries.join(F.broadcast(some), "words").groupBy("words").agg(F.sum("counts").alias("c"), F.first("classes").alias("kind")), "lm-common")  # COMMON rows at most
    both = entries.join(F.broadcast(common), "words", "left")
    same = W.Window.partitionBy("words")
    columns = ["block", "number", "words", "c", "classes", "once"]
    rest = both.filter("c is null").withColumn("c", F.sum("counts").over(same)).withColumn("once", F.row_number().over(same.orderBy("block")) == 1).select(columns)
    counted = written(both.filter("c is not null").withColumn("once", F.lit(False)).select(columns).union(rest), "lm-counts")
    once = counted.filter("once and c > 0").select("words", "c", "classes").union(common.select("words", "c", F.col("kind").alias("classes")))
    return counted.drop("once"), once


def encoded(docs: DataFrame) -> tuple[DataFrame, int]:
    """Per text: doc_id, held_out, n_tokens, n_known, base_score, words_score (sum of log10 P(w | class)), classes, slice (SLICES for held-out texts); and the number of training tokens."""
    blocks = _blocks(docs)
    counted, once = counts_of(blocks)
    own = F.broadcast(commonest(once))
    counted = counted.join(own, "words", "left").withColumn("classes", F.coalesce("own", "classes"))
    by_class = once.join(own, "words", "left").groupBy(F.coalesce("own", "classes").alias("classes")).agg(F.count("*").alias("v"), F.sum("c").alias("n")).collect()  # at most END rows
    texts = blocks.filter("ids is not null")
    ends = texts.filter("not held_out").count()
    n = sum(r.n for r in by_class) + ends
    v = sum(r.v for r in by_class) + (ends > 0)
    total = np.full(END + 1, 0.5)
    for r in by_class:
        total[r.classes] += r.n + 0.5 * r.v
    log_total, log_base = np.log10(total), np.log10(n + 0.5 * (v + 1))
    end_base = np.log10(ends + 0.5) - log_base

    def encode(left: pa.Table, right: pa.Table) -> pa.Table:
        size = right.num_rows
        c, kinds = np.zeros(size, np.int64), np.zeros(size, np.uint16)
        at = right.column("number").to_numpy()
        c[at] = right.column("c").to_numpy()
        kinds[at] = right.column("classes").to_numpy()
        log_c = np.log10(c + 0.5)
        known, base, words = c > 0, log_c - log_base, log_c - log_total[kinds]
        rows = {k: [] for k in ("n_tokens", "n_known", "base_score", "words_score", "classes")}
        for ids in left.column("ids").to_pylist():
            k = np.frombuffer(ids, np.uint32)
            rows["n_tokens"].append(len(k) + 1)
            rows["n_known"].append(int(known[k].sum()) + (ends > 0))
            rows["base_score"].append(float(base[k].sum() + end_base))
            rows["words_score"].append(float(words[k].sum()))
            rows["classes"].append(np.append(kinds[k], np.uint16(END)).tobytes())
        return pa.table({"doc_id": left.column("doc_id"), "held_out": left.column("held_out"), **{k: pa.array(v, t) for (k, v), t in zip(rows.items(), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()), strict=True)}})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, words_score double, classes binary"
    both = texts.select("block", "doc_id", "held_out", "ids").groupBy("block").cogroup(counted.select("block", "number", "c", "classes").groupBy("block")).applyInArrow(encode, schema)
    path = table_path(docs.sparkSession, "lm-encoded")
    sliced = both.withColumn("slice", F.when(F.col("held_out"), SLICES).otherwise(F.pmod(F.xxhash64("doc_id", "classes"), F.lit(SLICES)).cast("int")))
    sliced.write.option("compression", "zstd").partitionBy("slice").parquet(path)
    return docs.sparkSession.read.schema(sliced.schema).parquet(path), n


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    rows = [np.frombuffer(x, np.uint16) for x in column.to_pylist()]
    return (np.concatenate(rows) if rows else np.zeros(0, np.uint16)), np.r_[0, np.cumsum([len(x) for x in rows])].astype(np.int64)


def corpus_counts(texts: DataFrame, model: Model) -> np.ndarray:
    """Expected emissions, moves and starts over all sequences (classes) of ``texts``; END + K + 2 rows of counts come to the driver."""
    k = len(model.start)
    names = [f"s{s}" for s in range(k)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((END + 1, k))
        held, size = [], 0

        def add() -> None:
            flat, bounds = _flat(pa.chunked_array(held, pa.binary()))
            for total, part in zip((start, move, emit), all_counts(model, flat, bounds), strict=True):
                total += part

        for batch in batches:
            held.append(batch.column(0))
            size += batch.column(0).nbytes // 2
            if size >= HELD:
                add()
                held, size = [], 0
        add()
        rows = np.concatenate([emit, move, start[None]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32)), *[pa.array(rows[:, s]) for s in range(k)]], ["row", *names])

    counts = texts.select("classes").mapInArrow(count, "row int, " + ", ".join(f"{x} double" for x in names))
    rows = np.zeros((END + 2 + k, k))
    for r in counts.groupBy("row").agg(*[F.sum(x).alias(x) for x in names]).collect():
        rows[r.row] = r[1:]
    return rows


def model_of(rows: np.ndarray) -> Model:
    return Model.of_counts(rows[-1], rows[END + 1 : -1], rows[: END + 1])


def trained(texts: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model of the training texts of ``encoded``: a stepwise pass over their slices, then ``rounds`` over all of them."""
    model, held, seen = Model.random(STATES), None, 0
    for k in range(SLICES):
        rows = corpus_counts(texts.filter(F.col("slice") == k), model) * SLICES
        if not rows[-1].sum():  # a slice without a text tells nothing: without counts all states would be alike, and stay so
            continue
        seen += 1
        weight = float(seen) ** -FALL
        held = rows if held is None else (1 - weight) * held + weight * rows
        model = model_of(held)
    for _ in range(rounds if seen else 0):
        model = model_of(corpus_counts(texts.filter(F.col("slice") < SLICES), model))
    return model


def scores(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The contract of op2."""
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))
    texts = doc_texts(docs).withColumn("held_out", fold == HELD_OUT)
    coded, n = encoded(texts)
    model = trained(coded, rounds)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                b = batch.slice(at, 4000)
                flat, bounds = _flat(b.column(6))
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(b.column(5).to_numpy() + forward(model, flat, bounds))], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    out = coded.drop("slice").mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op2(spark, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
