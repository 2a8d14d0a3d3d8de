"""Repair of conversation structure by a forward Viterbi search over a grammar of four states.

A conversation is legal if its roles read ``(s?(ua)+)?``: nothing, or pairs of user and assistant after at most one system row.
States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; 0 and 3 may end. Rows are taken by turn (nulls first, equal
turns by role and text). Each row is kept (K, 0), given the other role (R, 1) or deleted (D, 2); an empty row of either role may be
inserted (I, 5) before, between and after rows. Blank and repeated rows must go, truncated ones that stay add 5. Each state carries its least
(cost, audit string), and after each row the layer is closed by inserts: 2 from 0, 1 and 3, then 3 from 2; more never pay.

1. Rows are dealt by conversation and sorted where they are; repeats are numbered by a window of the same dealing, so there is one shuffle.
2. A task streams its rows through the search. What all states agree on is decided and leaves; only rows since then wait, without the
   texts that go on every path. So a conversation of any length is never gathered; it is read in order by one task, as the hash of its whole
   repaired text asks for as well.
3. Digests follow in the same stage over the edited rows.

Null roles and texts are one space (such a role cannot be kept); null turns stand first and count no gaps; rows without conv_id are one
conversation. Equal rows are repeats of the first. An empty table gives no rows; other columns are not read. Roles count by their first letter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: state -> initial -> state
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: What a rerole or an insert brings from each state.
BRINGS = ("user", "user", "assistant", "user")
#: Undecided rows (a power of two) after which what all states agree on is looked for; bounds of a batch that leaves.
WAIT, BATCH_ROWS, BATCH_CHARS = 32, 4096, 4 << 20
_EDITS = "conv_id {}, turn long, was string, role string, text string, fault string, edit string"


class Search:
    """The search over one conversation: ``add`` takes its rows in order, ``decided`` gives the edits that all states share, ``rest`` all others."""

    def __init__(self):
        self.states: list[tuple[int, str] | None] = self._closed([(0, ""), None, None, None])
        self.at, self.rows = 0, []

    @staticmethod
    def _closed(states: list) -> list:
        for to, sources in ((2, (0, 1, 3)), (3, (2,))):
            paths = [states[to], *[(states[s][0] + INSERT, states[s][1] + "I") for s in sources if states[s]]]
            states[to] = min([p for p in paths if p], default=None)
        return states

    def add(self, row: tuple) -> None:
        """``row``: (turn, role, text, fault)."""
        _, role, _, fault = row
        self.rows.append(row)
        found: list[list[tuple[int, str]]] = [[], [], [], []]
        more = TRUNCATED if fault == "truncated" else 0
        for s, path in enumerate(self.states):
            if not path:
                continue
            cost, audit = path
            found[s].append((cost + DELETE, audit + "D"))
            if fault in ("blank", "duplicate"):
                continue
            kept = NEXT[s].get(role[:1])
            if kept is not None:
                found[kept].append((cost + KEEP + more, audit + "K"))
            found[NEXT[s][BRINGS[s][0]]].append((cost + REROLE + more, audit + "R"))
        self.states = self._closed([min(x, default=None) for x in found])
        self._outdone(0, 3, DELETE), self._outdone(1, 3, 0), self._outdone(1, 0, 0), self._outdone(0, 1, 2 * INSERT)

    def _outdone(self, state: int, by: int, lead: int) -> None:
        """Drops ``state`` if ``by``, which can go on as it does for ``lead`` more, is cheaper all the same: what begins apart would never be decided."""
        if self.states[state] and self.states[by] and self.states[state][0] > self.states[by][0] + lead:
            self.states[state] = None

    def _applied(self, audit: str) -> Iterator[tuple]:
        """Edited rows for edits that follow those given out before: (turn, role before, role, text, fault, edit)."""
        rows = iter(self.rows)
        n = 0
        for edit in audit:
            if edit == "I":
                row = (None, None, BRINGS[self.at], "", None, "I")
            else:
                turn, role, text, fault = next(rows)
                n += 1
                row = (turn, role, role if edit == "K" else BRINGS[self.at] if edit == "R" else None, None if edit == "D" else text, fault, edit)
            if row[2] is not None:
                self.at = NEXT[self.at][row[2][:1]]
            yield row
        del self.rows[:n]

    def decided(self) -> Iterator[tuple]:
        paths = [p for p in self.states if p]
        same = commonprefix([audit for _, audit in paths])
        # Costs count from what is decided, too: only their differences matter.
        least = min(cost for cost, _ in paths)
        self.states = [p and (p[0] - least, p[1][len(same) :]) for p in self.states]
        yield from self._applied(same)
        # What is open may last (if hardly a row can stay); texts that go on every path need not wait.
        for k, edits in enumerate(zip(*[p[1].replace("I", "") for p in self.states if p], strict=True)):
            if set(edits) == {"D"}:
                turn, role, _, fault = self.rows[k]
                self.rows[k] = (turn, role, None, fault)

    def full(self) -> bool:
        """Whether to look for what is decided: at WAIT rows and whenever twice as many wait."""
        n = len(self.rows)
        return n >= WAIT and n & (n - 1) == 0

    def rest(self) -> Iterator[tuple]:
        return self._applied(min(p for p in (self.states[0], self.states[3]) if p)[1])


def _batches(rows: Iterator[tuple], schema: pa.Schema, chars: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    out, n = [], 0
    for row in rows:
        out.append(row)
        n += chars(row)
        if len(out) >= BATCH_ROWS or n >= BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out, n = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(0, batch.num_rows, 1024):
            yield from zip(*[c.to_pylist() for c in batch.slice(k, 1024).columns], strict=True)


def faulted(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (nulls: one space) and fault: blank, duplicate, truncated or null; dealt by conv_id and in order."""
    told = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    order = F.col("turn").asc_nulls_first()
    nth = F.row_number().over(W.Window.partitionBy("conv_id", "role", "text").orderBy(order))
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(F.col("nth") > 1, "duplicate").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    )
    dealt = told.repartition("conv_id").withColumn("nth", nth).withColumn("fault", fault)
    # Equal rows of one turn stand as they are numbered: the first is no repeat.
    return dealt.sortWithinPartitions("conv_id", order, "role", "text", "nth").drop("nth")


def repaired(rows: DataFrame) -> DataFrame:
    """The edits of every conversation of ``rows`` (conv_id, turn, role, text), in order.

    conv_id, turn and was (null for an inserted row), role and text (null for a deleted row), fault, edit (K, R, D or I).
    Rows with a role, in this order, are the repaired conversations.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edits() -> Iterator[tuple]:
            of, run = None, None
            for conv, *row in _rows(batches):
                if run is None or conv != of:
                    if run:
                        yield from ((of, *x) for x in run.rest())
                    of, run = conv, Search()
                run.add(tuple(row))
                if run.full():
                    yield from ((of, *x) for x in run.decided())
            if run:
                yield from ((of, *x) for x in run.rest())

        first = next(batches, None)
        if first is not None:
            key = first.schema.field(0).type
            schema = pa.schema([("conv_id", key), ("turn", pa.int64())] + [(c, pa.string()) for c in ("was", "role", "text", "fault", "edit")])
            head = first
            batches = (b for part in ([head], batches) for b in part)
            yield from _batches(edits(), schema, lambda x: len(x[4] or ""))

    return faulted(rows).mapInArrow(search, _EDITS.format(kind))


def digests(edits: DataFrame) -> DataFrame:
    """One row a conversation of ``repaired``: gaps, faults, illegal neighbours, cost, audit and the hash of the repaired text."""
    kind = edits.schema["conv_id"].dataType.simpleString()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def convs() -> Iterator[tuple]:
            of, run = None, None
            for conv, *row in _rows(batches):
                if run is None or conv != of:
                    if run:
                        yield of, *run.result()
                    of, run = conv, _Digest()
                run.add(*row)
            if run:
                yield of, *run.result()

        first = next(batches, None)
        if first is not None:
            schema = pa.schema([("conv_id", first.schema.field(0).type)] + [(c, pa.int64()) for c in names] + [("audit", pa.string()), ("repaired_sha256", pa.string())])
            head = first
            batches = (b for part in ([head], batches) for b in part)
            yield from _batches(convs(), schema, lambda x: len(x[-2]))

    return edits.mapInArrow(digest, f"conv_id {kind}, " + ", ".join(f"{c} long" for c in names) + ", audit string, repaired_sha256 string")


class _Digest:
    def __init__(self):
        self.low = self.high = self.before = None
        self.turns = self.illegal = self.cost = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.audit, self.hash, self.some = [], hashlib.sha256(), False

    def add(self, turn, was, role, text, fault, edit) -> None:
        self.audit.append(edit)
        self.cost += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
        if role is not None:
            self.hash.update(f"{chr(10) if self.some else ''}{role}:{text}".encode())
            self.some = True
            self.cost += TRUNCATED if fault == "truncated" else 0
        if edit == "I":
            return
        if fault:
            self.faults[fault] += 1
        if self.before is not None:
            self.illegal += self.before + was[:1] not in ("su", "ua", "au")
        self.before = was[:1]
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1

    def result(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with planted faults, by crc32(conv_id:turn) % 20: 0 drops a row, 1 empties its text, 2 removes its [.!?], 3 repeats it, 4 makes it user."""
    told = rows.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    at = told.withColumn("by", F.crc32(key.cast("binary")) % 20).filter("by <> 0")
    text = F.when(F.col("by") == 1, "").when(F.col("by") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("by") == 4, "user").otherwise(F.col("role"))
    return at.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("by") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def op11(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found = digests(repaired(damaged(rows)))
    ids = rows.select(F.col("conv_id").alias("id")).distinct()
    zeros = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256().hexdigest())
    return ids.join(found, ids["id"].eqNullSafe(found["conv_id"]), "left").select(F.col("id").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def _sql() -> str:
    """The same search as a recursion over the rows of a conversation, each state a struct of cost, audit and repaired text."""
    text = lambda s, piece: f"{s}.t" if piece is None else f"coalesce({s}.t || chr(10), '') || {piece}"
    path = lambda s, cost, edit, piece=None, only="true": f"CASE WHEN {s} IS NOT NULL AND {only} THEN {{'c': {s}.c + {cost}, 'a': {s}.a || '{edit}', 't': {text(s, piece)}}} END"
    least = lambda *paths: f"list_sort(list_filter([{', '.join(paths)}], lambda x: x IS NOT NULL))[1]"
    stays, more = "fault NOT IN ('blank', 'duplicate')", "CASE fault WHEN 'truncated' THEN 5 ELSE 0 END"
    keep = lambda s, letter: path(s, more, "K", "role || ':' || text", f"{stays} AND left(role, 1) = '{letter}'")
    rerole = lambda s: path(s, f"1 + {more}", "R", f"'{BRINGS[int(s[1])]}:' || text", stays)
    insert = lambda s, role: path(s, 5, "I", f"'{role}:'")
    key = "CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(k, i // 8 + 1, 1))::BIGINT) ELSE c END"
    state = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
    order = "PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth"
    return rf"""
WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
b AS (SELECT *, xor(list_reduce(range(8 * length(k)), lambda c, i: xor(({key}) >> 1, CASE WHEN ({key}) & 1 = 1 THEN 3988292384 ELSE 0 END), 4294967295::BIGINT), 4294967295) % 20 AS d FROM t),
dm AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM b),
r AS (SELECT *, row_number() OVER ({order}) AS k, lag(role) OVER ({order}) AS before FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM dm)),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM r),
s(conv_id, k, s0, s1, s2, s3) AS (SELECT DISTINCT conv_id, 0::BIGINT, {{'c': 0, 'a': '', 't': NULL}}::{state}, NULL::{state}, {{'c': 5, 'a': 'I', 't': 'user:'}}::{state}, {{'c': 10, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'}}::{state} FROM f
  UNION ALL SELECT conv_id, k, n0, n1, n2, {least("n3", insert("n2", "assistant"))} FROM (SELECT * REPLACE ({least("n2", insert("n0", "user"), insert("n1", "user"), insert("n3", "user"))} AS n2) FROM (
    SELECT s.conv_id, f.k, {path("s0", 2, "D")} AS n0, {least(path("s1", 2, "D"), keep("s0", "s"))} AS n1, {least(path("s2", 2, "D"), *[keep(x, "u") for x in ("s0", "s1", "s3")], *[rerole(x) for x in ("s0", "s1", "s3")])} AS n2, {least(path("s3", 2, "D"), keep("s2", "a"), rerole("s2"))} AS n3
    FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.k = s.k + 1))),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS k FROM f GROUP BY conv_id),
e AS (SELECT g.*, {least("s0", "s3")} AS best FROM g JOIN s ON s.conv_id IS NOT DISTINCT FROM g.conv_id AND s.k = g.k)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""


OP11_SQL = _sql()
