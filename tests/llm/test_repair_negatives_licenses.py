"""Conversation repair, hard negatives and license scans against loops, and at their edges."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from lectern.llm import conversations, hard_negatives, licenses, queries

TALK = "conv_id long, turn long, role string, text string"


def _faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def _brute(rows):
    """Cheapest edits by trying them all: up to two inserts before each row and at the end."""
    faults, best = _faults(rows), None
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for edits in itertools.product("DKR", repeat=len(rows)):
        if any(f in ("blank", "duplicate") and e != "D" for f, e in zip(faults, edits, strict=True)):
            continue
        for gaps in itertools.product(inserts, repeat=len(rows) + 1):
            for roles in itertools.product(*[("user", "assistant") if e == "R" else ("",) for e in edits]):
                cost, audit, kept = 0, "", []
                for k in range(len(rows) + 1):
                    for r in gaps[k]:
                        cost, audit = cost + 5, audit + "I"
                        kept.append((r, ""))
                    if k < len(rows):
                        e = edits[k]
                        cost += {"K": 0, "R": 1, "D": 2}[e] + (5 if e != "D" and faults[k] == "truncated" else 0)
                        audit += e
                        if e != "D":
                            kept.append((roles[k] or rows[k][1], rows[k][2]))
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in kept)) and (best is None or (cost, audit) < best[:2]):
                    best = (cost, audit, kept)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in best[2]).encode()).hexdigest()
    return gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, best[0], best[1], digest


def test_repairs_against_all_edits(spark):
    rng = np.random.default_rng(4)
    talks = {c: [(None if rng.random() < 0.1 else int(t * rng.integers(1, 3)), str(rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""])), str(rng.choice(["Good.", "Well!\n", "Cut", "", " \t", "é?", "More."]))) for t in range(rng.integers(1, 4))] for c in range(120)}
    talks = {c: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, rows in talks.items()}
    flat = [(c, *r) for c, rows in talks.items() for r in rows]
    got = {r.conv_id: tuple(r)[1:] for r in conversations.digests(conversations.repaired(spark.createDataFrame(flat, TALK))).collect()}
    assert got == {c: _brute(rows) for c, rows in talks.items()}


def _plain(rows):
    """The same search with whole audits of all states, without deciding anything early."""
    closed = lambda s: {**(t := {**s, 2: min([p for p in (s.get(2), *[(s[k][0] + 5, s[k][1] + "I") for k in (0, 1, 3) if k in s]) if p])}), 3: min(p for p in (s.get(3), (t[2][0] + 5, t[2][1] + "I")) if p)}
    state = closed({0: (0, "")})
    steps = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    for (_, role, _), fault in zip(rows, _faults(rows), strict=True):
        new = defaultdict(list)
        for s, (cost, audit) in state.items():
            new[s].append((cost + 2, audit + "D"))
            for letter, edit in [(role[:1], "K"), ("u", "R"), ("a", "R")] if fault not in ("blank", "duplicate") else []:
                if (s, letter) in steps:
                    new[steps[s, letter]].append((cost + (edit == "R") + 5 * (fault == "truncated"), audit + edit))
        state = closed({s: min(p) for s, p in new.items()})
    return min(p for s, p in state.items() if s in (0, 3))


def test_long_conversations_are_decided_as_they_pass(spark):
    rng = np.random.default_rng(9)
    rows = [(k, str(rng.choice(["user", "assistant", "system"], p=[0.5, 0.45, 0.05])), str(rng.choice(["One.", "Two", "Three?", ""])) + (f" {k}." if rng.random() < 0.7 else "")) for k in range(3000)]
    talk = spark.createDataFrame([(7, *r) for r in rows], TALK)
    edits = conversations.repaired(talk)
    got = conversations.digests(edits).collect()[0]
    cost, audit = _plain(rows)
    assert (got.cost, got.audit) == (cost, audit)
    kept = [(r.role, r.text) for r in edits.collect() if r.role is not None]
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in kept)) and got.repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    search, most = conversations.Search(), 0
    for row, fault in zip(rows, _faults(rows), strict=True):
        search.add((*row, fault))
        if search.full():
            list(search.decided())
        most = max(most, len(search.rows))
    assert most <= 4 * conversations.WAIT  # what waits does not grow with the conversation
    search = conversations.Search()
    for k in range(2000):  # nothing but one system row can stay: edits remain open, but no text waits
        search.add((k, "user" if k else "system", "text", "duplicate" if k else None))
        if search.full():
            list(search.decided())
    assert sum(r[2] is not None for r in search.rows) < 1000 and "".join(r[-1] for r in search.rest()) == "D" * 2000


def test_damage(spark, sf):
    rows = pq.read_table(f"{sf}/conversations.parquet").to_pylist()
    want = []
    for r in rows:
        by = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        text = "" if by == 1 else re.sub("[.!?]", "", r["text"]) if by == 2 else r["text"]
        want += [(r["conv_id"], r["turn"], "user" if by == 4 else r["role"], text)] * ((by != 0) + (by == 3))
    got = [tuple(r) for r in conversations.damaged(spark.read.parquet(f"{sf}/conversations.parquet")).collect()]
    assert sorted(got) == sorted(want)
    by_conv = defaultdict(list)
    for c, *r in sorted(want):
        by_conv[c].append(r)
    found = {r.conv_id: r for r in queries.QUERIES["op11_conversation_repair"](spark, sf).collect()}
    assert set(found) == {r["conv_id"] for r in rows}
    for c, r in found.items():
        assert (r.cost, r.audit) == (_plain(by_conv[c]) if by_conv[c] else (0, ""))


def test_of_equal_rows_the_first_is_no_repeat(spark):
    rows = [(c, t, role, text) for c in range(60) for t, role, text in [(0, "user", "One."), (0, "user", "One."), (0, "user", "One."), (1, "assistant", "Two.")]]
    edits = conversations.repaired(spark.createDataFrame(rows, TALK).repartition(5))
    assert {r.audit for r in conversations.digests(edits).collect()} == {"KDDK"}


def test_conversation_whose_rows_all_drop(spark, tmp_path):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "Bye.")], TALK).write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in queries.QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


@pytest.mark.parametrize("scale", [1, 700, 1 << 18])
def test_sliced_products_are_exact(scale):
    """Intervals drop no pair that qualifies, in single, double and integer arithmetic, and dense or pair by pair."""
    rng = np.random.default_rng(scale)
    x, q = (rng.integers(-150 * scale, 150 * scale, (n, 24)) for n in (300, 17))
    exact = x @ q.T
    least, most = np.quantile(exact, 0.9, axis=0).astype(np.int64), np.quantile(exact, 0.97, axis=0).astype(np.int64)
    allowed = rng.random(exact.shape) < 0.8
    want = {(r, a, exact[r, a]) for r, a in zip(*np.nonzero(allowed & (exact >= least) & (exact <= most)), strict=True)}
    for sparse in (0.0, 0.05, 1.0):
        assert set(zip(*hard_negatives.sliced(x, q, allowed.copy(), least, most, sparse=sparse), strict=True)) == want
        r, a, score = hard_negatives.sliced(x, q, allowed.copy(), np.full(17, hard_negatives.NONE), np.full(17, 1 << 62), 5, sparse)
        for k in range(17):
            best = sorted((-exact[i, k], i) for i in np.flatnonzero(allowed[:, k]))[:5]
            assert sorted((-s, i) for i, s in zip(r[a == k], score[a == k], strict=True))[:5] == best
    assert len(hard_negatives.sliced(x, q, allowed.copy(), least, most)[0]) < allowed.sum()


def test_negatives_in_passes_and_of_repeats(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = sorted(tuple(r) for r in hard_negatives.mined(rows, every=10).collect())
    assert want and sorted(tuple(r) for r in hard_negatives.mined(rows.union(rows).repartition(7), every=10, pass_bytes=2000).collect()) == want


def _scan_loop(text):
    """Matches by trying every rule at every word of the whole text, and suppression over all pairs."""
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text)) if w]
    found = []
    for k in range(len(words)):
        rest = " ".join(words[k:]) + " "
        for _first, _key, regex, label, priority, _confidence, base in licenses.RULES:
            if _first == words[k] and (m := re.match(f"(?:{regex}) ", rest)):
                found.append((label, priority, base, k, k + m.group().count(" ") - 1))
    kept = {f for f in found if not any(g[3] <= f[3] and g[4] >= f[4] and (g[1] > f[1] or (g[1] == f[1] and g[4] - g[3] > f[4] - f[3])) for g in found)}
    return len(words), sorted(set(found)), sorted(kept)


def test_scans_against_a_loop(spark):
    texts = [
        "Released under the terms of the GNU Lesser General Public License, version 2.1 or later. MIT License!", "Mit der Lizenz: MIT  license", "mit-license\tAPACHE LICENSE apache license 2.0", "CC BY-NC 4.0; cc0 1.0; Creative Commons Attribution-ShareAlike 3.0",
        "general public license general public license v3", "emit license, mit licenses, mit-licensee", "Apache License, Version 2.0 (the License); licensed under the Apache License, Version 2.0", "", "nothing here", "gpl " * 50 + "mit license " * 200, "ÉMIT LICENSE émit license mit license", "public domain, dedicated to the public-domain",
    ]
    got = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")).collect()}
    assert got[99].n_words == 0 and got[99]["all"] == []
    for k, text in enumerate(texts):
        n, every, kept = _scan_loop(text)
        of = lambda rows: sorted({(m.label, m.priority, m.base, m.first, m.last) for m in rows})
        assert (got[k].n_words, of(got[k]["all"]), of(got[k].kept)) == (n, every, kept), text
    labels = lambda k: {m.label for m in got[k].kept}
    assert labels(0) == {"lgpl-2.1", "mit"} and "gpl" not in labels(0) and labels(3) == {"cc-by-nc-4.0", "cc0", "cc-by-sa-3.0"}


def test_rules_are_gated_by_what_they_hold():
    assert len(licenses.RULES) > 200
    for first, key, regex, *_ in licenses.RULES:
        # The shortest text of a rule: optional parts left out, first alternatives.
        text = regex.replace("licen[cs]e", "license")
        while "(?:" in text:
            text = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)(\?)?", lambda m: "" if m.group(2) else m.group(1), text)
        text = re.sub(r" \?|\[([a-z0-9])[^\]]*\]|([a-z0-9])\?", lambda m: m.group(1) or "", text)
        if first.startswith("licenc") or first.startswith("unlicenc"):
            text = first + text[len(first) :]
        assert re.fullmatch(regex, text) and key in text and text.split()[0] == first, (regex, text)
        assert re.search(licenses.GATE, text) and re.search(licenses.GATE, text.upper().replace(" ", " - ")), text
        assert len(text.split()) <= licenses.SPAN
