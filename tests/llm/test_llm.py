"""The training-data operators on small tables: edge cases, SQL, brute force, round trips."""

from __future__ import annotations

import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from helpers import same

import corpus_pipeline
from lectern.llm import archive, decontamination, fingerprint, lm_scoring, mixing, near_dedup, queries, sharding, substring_dedup, toxicity, url_filter

LONG = " ".join(f"word{k % 977} and more." for k in range(30_000))
PASSAGE = " ".join(f"shared{k} term{k} here{k}." if k % 4 else f"shared{k} term{k} here{k}" for k in range(40))
DOCS = [
    (1, "One short text. It has two sentences.", "en", "a"), (2, "One short text. It has two sentences.", "en", "a"), (3, "", "en", "b"), (4, None, None, None), (5, "   \n\t ", "fr", "b"), (6, LONG, "en", "a"),
    (7, PASSAGE, "en", "c"), (8, "Start of it all. " + PASSAGE + " End of it.", "de", "c"), (9, "Übergröße ÀÉÎ straße. " * 3, "de", None), (10, "you stupid vile idiot, go away " * 3, "en", "a"), (11, "word", "en", "b"), (12, "alpha beta gamma delta", "en", "b"),
]
TYPES = {"documents": [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("row", pa.int64()), ("score", pa.float64()), ("segment", pa.string())], "labels": [("doc_id", pa.int64()), ("quality", pa.int64()), ("toxic", pa.int64())], "benchmark": [("item_id", pa.int64()), ("text", pa.string())], "pages": [("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("host", pa.string())], "conversations": [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string()), ("fault", pa.string())], "embeddings": [("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32()), ("score", pa.float64()), ("anchor", pa.int64())]}


def write(folder: Path, **tables) -> str:
    for name, columns in TYPES.items():
        rows = [list(r) + [None] * (len(columns) - len(r)) for r in tables.get(name, [])]
        pq.write_table(pa.Table.from_pylist([dict(zip([c for c, _ in columns], r, strict=True)) for r in rows], pa.schema(columns)), folder / f"{name}.parquet")
    return str(folder)


PAGES = [
    (1, "http://a.example.org/x", "<html>" + "same payload " * 20), (2, "https://b.example.com/de/1", "<html>" + "same payload " * 20), (3, None, None), (4, "no scheme", ""), (5, "http://EXAMPLE.org/en/12?q", '<link rel="canonical" href="http://other.net/page">'),
    (6, "http://other.net/page", "short"), (7, "http://third.net/q", '<meta http-equiv="refresh" content="0; url=http://other.net/page">'), (8, "http://x.example.com/fr/", "é" * 80), (9, "http://y.example.com/fr/2", "é" * 80), (10, "http://evilexample.org/es/", "a b\nc"),
]


TALKS = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hello there."), (1, 2, "assistant", "Yes. \n"), (1, 4, "user", LONG), (2, None, "user", "No turn."), (2, None, None, None), (2, 5, "assistant", "Cut"), (3, 1, "user", ""), (4, 1, "tool", "Result."), (None, 2, "user", "Of no one."), (None, 3, "assistant", "To no one."), (5, 1, "", "Who?")]
VECTORS = [
    (0, [1.0, 0.5], 0), (100, [0.25, -1.0], 1), (200, None, 1), (300, [0.0, float("nan")], 1), (400, [1.0, None], 1), (500, [1.0, 0.5], None), (1, [1.0, 0.5], 0), (2, [1.0, 0.5], 0), (3, [0.9, 0.4], 0), (4, [0.9, 0.5], 2),
    (5, [0.9, 0.45], 2), (6, [0.9, 0.45], 3), (8, [0.95, 0.5], 3), (9, [0.1, -0.9], 4), (10, [0.2, -0.9], 4), (14, [0.2, -0.95], 1), (15, [0.25, -0.95], 1), (600, [0.0, 0.0], 5), (16, [-1.0, -1.0], 5), (17, [0.0, 0.0], 6),
]


@pytest.fixture(scope="module")
def edge(tmp_path_factory):
    labels = [(10, 0, 1), (1, 1, 0), (2, 1, 0), (6, None, 0), (7, 1, 0), (9, 1, None), (None, 1, 1)]
    bench = [(1, PASSAGE), (2, "alpha beta gamma delta"), (3, None), (4, ""), (5, "short text it has"), (5, "short text it has")]
    return write(tmp_path_factory.mktemp("edge"), documents=DOCS, labels=labels, benchmark=bench, pages=PAGES, conversations=TALKS, embeddings=VECTORS)


@pytest.fixture(scope="module")
def nulls(tmp_path_factory):
    """Repeated rows and null ids as well."""
    docs = [*DOCS[:5], *DOCS[:5], (None, "text of no one. It has no id.", "en", "a"), (None, None, None, None), (1, "another text of the same id", "en", "z")]
    return write(tmp_path_factory.mktemp("nulls"), documents=docs, labels=[(None, None, None), (1, 0, 1), (1, 0, 0)], benchmark=[(None, "text of no one"), (None, None)], pages=[*PAGES[:3], *PAGES[:3], (None, None, None)], conversations=[*TALKS, *TALKS, (None, None, None, None)], embeddings=[*VECTORS, *VECTORS[:7], (None, [1.0, 1.0], 0), (700, [1.0, 1.0, 1.0], 0), (18, [], 0), (800, [], 0), (100, [3e38, 1.0], 1)])


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return write(tmp_path_factory.mktemp("empty"))


N_ROWS = {"op3_arc_to_warc": (10, 7), "op6_url_filter": (10, 7), "op11_conversation_repair": (6, 6), "op12_hard_negatives": (8, 8)}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_edge_cases(spark, edge, nulls, empty, name):
    """No crash; a row for each input row."""
    want = N_ROWS.get(name, (12, 13))
    for folder, n in ((edge, want[0]), (nulls, want[1]), (empty, 0)):
        rows = queries.QUERIES[name](spark, folder).collect()
        assert len(rows) == n, (name, folder)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, sf, edge, name):
    for folder in (edge, sf):
        same(queries.QUERIES[name](spark, folder), folder, queries.ORACLES[name])


def test_links_in_all_forms_and_queries_apart(spark):
    blocked, page = "http://example.org/es/a/b.html", "http://n.net/d/e/p.html"
    forms = {
        '<link href=x.html rel=canonical>': "n.net/d/e/x.html", '<link rel="canonical" href="../x?a=1&amp;b=2#f">': "n.net/d/x?a=1&b=2", '<link rel=canonical href="//Other.net/q/./r/..">': "other.net/q/", '<link rel=canonical href="?z=http://h/i">': "n.net/d/e/p.html?z=http://h/i",
        '<meta content="0; url=\'/x;y\'" http-equiv="refresh">': "n.net/x;y", "<meta http-equiv=refresh content='1; URL=\"z\"'>": "n.net/d/e/z", '<link rel=canonical href="mailto:a@b">': None, '<link rel=canonical href="../../../../x">': "n.net/x", '<link rel=icon href=/i.ico>': None,
    }
    for html, want in forms.items():
        got = url_filter.links_of(spark.createDataFrame([(1, page, html)], "page_id long, url string, html string")).collect()
        assert [(r.src, r.dst) for r in got] == ([("n.net/d/e/p.html", want)] if want else []), html
    rows = [(1, "http://n.net/item?id=1", f'<link rel="canonical" href="{blocked}">'), (2, "http://n.net/item?id=2", ""), (3, "http://example.org/es/a/c", ""), (4, "http://n.net/item?id=1#x", "")]
    verdicts = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), (("block", "example.org/es/"),)).collect()}
    assert verdicts == {1: "block", 2: "allow", 3: "block", 4: "block"}


def test_blocks_and_allows_travel_along_aliases(spark):
    """Chains, cycles and an allow beside a block, against a search from each page."""
    link = '<link rel="canonical" href="http://{}">'.format
    url = {k: f"n{k}.net/p" for k in range(12)} | {20: "example.org/es/x", 21: "sub.org/y", 22: "a.com/fr/z"}
    edges = [(0, 1), (1, 2), (2, 20), (3, 4), (4, 5), (5, 3), (5, 20), (6, 7), (7, 22), (7, 20), (8, 9), (10, 22), (21, 11), (11, 20)]
    rows = [(k, f"http://{u}", "".join(link(url[b]) for a, b in edges if a == k)) for k, u in url.items()]
    rules = (("allow", "org/"), ("block", "example.org/es/"), ("allow", "com/fr/"))
    own = {20: "block", 21: "allow", 22: "allow"}
    want = {}
    for k in url:
        seen, todo = {k}, [k]
        while todo:
            x = todo.pop()
            for y in [b for a, b in edges if a == x] + [a for a, b in edges if b == x]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        said = {own[x] for x in seen if x in own}
        want[k] = own.get(k) or ("allow" if "allow" in said else "block" if "block" in said else "allow")
    # 2 and 5 reach 20, 7 reaches an allowed page as well: all are one resource through 20, so the allow holds for the unmatched.
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert got == want and got[20] == "block" and got[8] == "allow"
    rows = [r for r in rows if r[0] not in (7, 11, 21, 22)]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    assert [got[k] for k in (0, 1, 2, 3, 4, 5, 6)] == ["block"] * 6 + ["allow"]


def test_a_search_in_passes_finds_the_same(spark, edge, sf):
    for folder in (edge, sf):
        docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
        rows = lambda n: sorted((tuple(map(str, r)) for r in decontamination.contamination(docs, items, slop=15, pass_words=n).collect()))  # noqa: E731, B023
        assert rows(100_000) == rows(40)


def test_near_items_against_a_loop(spark, edge):
    docs, items = (pq.read_table(f"{edge}/{t}.parquet").to_pylist() for t in ("documents", "benchmark"))
    words = lambda t: decontamination.WORD.findall((t or "").lower())
    places = {d["doc_id"]: defaultdict(list) for d in docs}
    total = Counter()
    for d in docs:
        for k, w in enumerate(words(d["text"])):
            places[d["doc_id"]][w].append(k)
            total[w] += 1
    want = {d["doc_id"]: set() for d in docs}
    for i in items:
        w = words(i["text"])
        for k in range(max(1, len(w) - 9)) if w else ():
            phrase = w[k : k + 10]
            first = min(range(len(phrase)), key=lambda j: (total[phrase[j]], j))  # noqa: B023
            for doc, at in places.items():
                if all(x in at for x in phrase) and any(all(any(abs(p - q) <= 15 for q in at[x]) for x in phrase) for p in at[phrase[first]]):
                    want[doc].add(str(i["item_id"]))
    got = {r.doc_id: set(r.near_items) for r in queries.QUERIES["op1_decontamination"](spark, edge).collect()}
    assert got == want and any(want.values())


def test_decontamination_against_brute_force(spark, edge, sf):
    for folder in (edge, sf):
        docs, items = (pq.read_table(f"{folder}/{t}.parquet").to_pylist() for t in ("documents", "benchmark"))
        want = decontamination.brute([(d["doc_id"], d["text"]) for d in docs], [(i["item_id"], i["text"]) for i in items])
        assert sorted(tuple(r)[:6] for r in queries.QUERIES["op1_decontamination"](spark, folder).collect()) == sorted(want)


def test_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "red one green two blue"), (2, "red green blue"), (3, "red " + "x " * 90 + "green blue")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "red green blue")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, list(r.near_items)) for r in decontamination.contamination(docs, items, slop=5).collect()}
    assert got == {1: (0, ["9"]), 2: (3, ["9"]), 3: (0, [])}


def _loop_forward(model, x):
    a, total = model.start * model.emit[x[0]], 0.0
    for k, c in enumerate(x):
        if k:
            a = (a @ model.move) * model.emit[c]
        total += np.log10(a.sum())
        a = a / a.sum()
    return total


def test_forward_and_counts_against_loops():
    rng = np.random.default_rng(1)
    model = lm_scoring.Model.random(4)
    seqs = [rng.integers(0, 50, n) for n in (1, 7, 3)]
    flat, bounds = np.concatenate(seqs), np.r_[0, np.cumsum([len(s) for s in seqs])]
    assert np.allclose(lm_scoring.forward(model, flat, bounds), [_loop_forward(model, s) for s in seqs])
    start, move, emit = lm_scoring.expected_counts(model, flat, bounds)
    assert np.isclose(start.sum(), 3) and np.isclose(move.sum(), 8) and np.isclose(emit.sum(), 11)


def test_long_sequences_hand_their_state_on():
    rng, model = np.random.default_rng(3), lm_scoring.Model.random(4)
    flat = rng.integers(0, lm_scoring.END + 1, 700).astype(np.uint16)
    bounds = np.array([0, 300, 310, 700])
    whole = lm_scoring.expected_counts(model, flat, bounds)
    assert np.isclose(whole[0].sum(), 3) and np.isclose(whole[1].sum(), 697)  # a start a text, not one a piece
    parts = [lm_scoring.long_counts(model, flat[a:b], 64) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    for got in (lm_scoring.all_counts(model, flat, bounds), [sum(x) for x in zip(*parts, strict=True)]):
        assert all(np.allclose(x, y) for x, y in zip(got, whole, strict=True))


def test_commonest_words_are_those_of_the_whole_corpus(spark):
    # One text of over 64 KB, and more short texts than a starting sample held.
    rows = [(1, "zebra " * 20_000)] + [(i, f"w{i} common") for i in range(2, 1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.lit(False))
    coded, n = lm_scoring.encoded(docs)
    got = {r.doc_id: np.frombuffer(r.classes, np.uint16) for r in coded.collect()}
    assert n == 20_000 + 2 * 1498 + 1499 and (got[1][:-1] == 0).all() and all(got[i][1] == 1 for i in range(2, 1500))
    assert len({got[i][0] for i in range(2, 1500)}) == 1498


def test_scores_against_whole_sequences(spark):
    """Every part of a score by loops: class probabilities from the counts, and the forward recursion of the trained model over whole texts."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 40)))) for i in range(80)] + [(None, "w1 w2 zzz"), (100, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lm_scoring.scores(docs, 1).collect()}
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1
    coded, n = lm_scoring.encoded(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), fold.alias("held_out")))
    model = lm_scoring.trained(coded, 1)
    counts, kinds = Counter(), {}
    seqs = {r.doc_id: np.frombuffer(r.classes, np.uint16).astype(int) for r in coded.collect()}
    for i, t in rows:
        for w, c in zip((t or "").split(), seqs[i], strict=False):
            kinds[w] = c
        if zlib.crc32(str(i if i is not None else "").encode()) % 5 != 1:
            counts.update([*(t or "").split(), None])
    assert n == sum(counts.values())
    of_class = defaultdict(lambda: 0.5)
    for w, c in kinds.items():
        of_class[c] += counts[w] + 0.5 * (counts[w] > 0)
    for i, t in rows:
        inside = sum(np.log10((counts[w] + 0.5) / of_class[kinds[w]]) for w in (t or "").split())
        assert abs(got[i].score - (inside + _loop_forward(model, seqs[i]))) < 1e-8 * (1 + len(seqs[i]))


@pytest.mark.parametrize("ids", [range(3), [None] * 40, [2]])
def test_states_differ_whatever_the_slices_hold(spark, ids):
    """Few texts, and texts without an id: slices that are empty do not make all states alike."""
    rows = [(i, " ".join(f"w{(k * (n + 2)) % 17}" for k in range(30 + n))) for n, i in enumerate(ids)]
    coded, _ = lm_scoring.encoded(spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.lit(False)))
    model = lm_scoring.trained(coded)
    apart = [np.abs(model.emit[:, a] - model.emit[:, b]).max() for a in range(len(model.start)) for b in range(a)]
    # So few texts need no more than some of the states; alike in all would be a model of words alone.
    assert max(apart) > 1e-3 and coded.select("slice").distinct().count() > (len(ids) > 10)


def test_mixing_rows_without_ids_each_have_a_coin(spark):
    rows = [(None, f"some text of {k}", "a") for k in range(400)] + [(k, "x", "b") for k in range(10)] + [(None, None, "c")]
    got = [r for r in mixing.mixture(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect() if r.doc.source == "a"]
    rate = got[0].target / got[0].source_size
    assert {r.copies for r in got} == {int(rate), int(rate) + 1} and abs(sum(r.size * r.copies for r in got) - got[0].target) < 0.1 * got[0].target


def test_language_model_beats_its_base_on_held_out_texts(spark, sf):
    rows = queries.QUERIES["op2_lm_scoring"](spark, sf).collect()
    held = [r for r in rows if r.held_out]
    texts = {d["doc_id"]: d["text"] or "" for d in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    split = lambda t: [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c.lower() if c.isascii() else c for c in t).split(" ") if w]
    counts = Counter()
    for d, t in texts.items():
        if zlib.crc32(str(d).encode()) % 5 != 1:
            counts.update([*split(t), None])
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        words = [*split(texts[r.doc_id]), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert abs(r.base_score - sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)) < 1e-6 * len(words) + 1e-6
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("version", [1, 2])
def test_archives_round_trip(spark, edge, version):
    pages = spark.read.parquet(f"{edge}/pages.parquet")
    got = {r.page_id: r for r in archive.archived(pages, version).filter("type in ('response', 'revisit')").collect()}
    assert {k: r.payload_bytes for k, r in got.items()} == {p[0]: len((p[2] or "").encode()) for p in PAGES}
    assert got[2].type == "revisit" and got[2].refers_to_id == got[1].record_id and all(r.date == "2024-01-01T00:00:00Z" for r in got.values())


def test_files_are_bounded_by_bytes(spark, tmp_path):
    """Pages of each size share files up to a bound; a larger one has a file of its own; all are read back."""
    sizes = ((100, 8), (1000, 3), (None, 1))
    pages = [(k, f"http://a/{k}", "x" * n) for k, n in enumerate([10] * 20 + [500] * 7 + [5000] * 3 + [0])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    folders = archive.write_arc(df, str(tmp_path / "arc"), sizes=sizes)
    assert [n for _, n in folders] == [8, 3, 1]
    for path, n in folders:
        for f in Path(path).glob("*.txt*"):
            assert len(list(archive.arc_records(f.read_bytes()))) - 1 <= n
    assert sorted(r.page_id for r in archive.convert_arc(archive._files(spark, str(tmp_path / "arc"))).filter("type = 'response'").collect()) == list(range(31))


def test_next_texts_of_rows_without_an_id(spark):
    """Every text is the next of one other, ids in order; rows without one are dealt over many ranges and come first."""
    rows = [(None, f"nameless {k}") for k in range(300)] + [(k * 700, f"named {k}") for k in range(50)]
    got = fingerprint.with_next(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    after = {r.text: r.next_text for r in got}
    assert len(got) == 350 and set(after) == set(after.values()) and all(after[f"named {k}"] == f"named {k + 1}" for k in range(49))
    at, seen = after["named 49"], []
    while at != "named 0":
        seen.append(at)
        at = after[at]
    assert len(seen) == 300


def test_arc_garbage_and_cut_files():
    record = b"http://x/a b 1.2.3.4 20240203 text/html 5\nhello\n"
    head = b"filedesc://f 0.0.0.0 20240101 text/plain 20\n1 0 t\nURL IP-addres\n\n"
    got = list(archive.arc_records(head + b"garbage\n" + record + record[:-4]))
    assert [(r[2].get("URL"), r[3]) for r in got[-1:]] == [("http://x/a b", b"hello")]
    assert archive.warc_date("2024") == "2024-01-01T00:00:00Z"


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    rows = [r for r in queries.QUERIES["op4_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in rows) >= 0.95 * len(rows)


def test_toxicity_scores_against_plain_forward_backward(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    field = toxicity.train(docs, labels)
    rows = [r for r in docs.select("doc_id", "text").orderBy("doc_id").limit(12).collect() if r.text]
    got = {r.doc_id: r for r in toxicity.tag(docs, field).collect()}
    t = np.exp(field.move)
    for r in rows:
        w = toxicity.Words(pa.array([r.text]), toxicity.ALNUM)
        e = np.exp(np.clip(field.weight[toxicity.features(w)].astype(float).sum(0), -30, 30))
        ahead, back = np.ones((len(e), 2)), np.ones((len(e), 2))
        for k in range(len(e)):
            a = np.array([1.0, e[k]]) if k == 0 else np.array([1.0, e[k]]) * (ahead[k - 1] @ t)
            ahead[k] = a / a.sum()
        for k in range(len(e) - 2, -1, -1):
            b = t @ (np.array([1.0, e[k + 1]]) * back[k + 1])
            back[k] = b / b.sum()
        p = (ahead * back)[:, 1] / (ahead * back).sum(1)
        q = np.clip(p, 1e-9, 1 - 1e-9)
        design = np.array([np.log(max(-np.log1p(-q).sum(), 0) + 1e-4), np.log(q.max() / (1 - q.max())) / 4, 1.0])
        assert abs(got[r.doc_id].score - 1 / (1 + np.exp(-design @ field.theta))) < 1e-6
        assert got[r.doc_id].n_toxic == (p >= 0.5).sum()
        assert all(0 <= s.start < s.end <= len(r.text.encode()) for s in got[r.doc_id].spans)


def test_field_marginals_against_all_labellings():
    field = toxicity.Field(np.zeros(1), np.array([[0.0, -1.0], [0.3, 0.7]]), np.zeros(3))
    score = np.array([0.2, -1.0, 1.5])
    p = toxicity.Packed(np.array([0, 3]))
    got = field.marginals(score, p)[0][p.place]
    total, want = 0.0, np.zeros(3)
    for k in range(8):
        y = [(k >> j) & 1 for j in range(3)]
        w = np.exp(sum(s * v for s, v in zip(score, y, strict=True)) + sum(field.move[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += w
        want += w * np.array(y)
    assert np.allclose(got, want / total)


def test_shards_are_even_and_groups_whole(spark, sf):
    rows = queries.QUERIES["op5_sharding"](spark, sf).collect()
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for k, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(n))
    groups = defaultdict(set)
    for r in rows:
        groups[r.text_crc32, r.size].add(r.shard)
    assert sum(len(g) > 1 for g in groups.values()) <= 8


def test_small_groups_are_never_cut(spark):
    df = spark.range(400).selectExpr("id as doc_id", "case when id % 2 = 0 then concat('g', id % 40) else concat('t', id) end as text", "'x' as shard", "1 as row")
    rows = sharding.shard_documents(df).collect()
    of = defaultdict(set)
    for r in rows:
        of[r.text_crc32].add(r.shard)
    assert len(of) == 220 and all(len(v) == 1 for v in of.values())
    text = lambda i: f"g{i % 40}" if i % 2 == 0 else f"t{i}"
    assert all((r.size, r.text_crc32) == (len(text(r.doc_id)) + 1, zlib.crc32(text(r.doc_id).encode())) for r in rows)


def test_one_group_larger_than_all_quotas(spark):
    df = spark.range(100).selectExpr("id as doc_id", "if(id < 70, 'same', concat('t', id)) as text")
    sizes = Counter(r.shard for r in sharding.shard_documents(df).collect())
    assert sorted(sizes.values()) == [12] * 4 + [13] * 4


def test_short_repeated_runs_go(spark):
    rows = [(1, "First here. Terms. Privacy. Contact."), (2, "Second one. Terms. Privacy. Contact. Last.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [(r.doc_id, r.removed, r.text) for r in substring_dedup.deduplicated(docs).orderBy("doc_id").collect()] == [(1, [], rows[0][1]), (2, [2, 3, 4], "Second one.\nLast.")]
    assert {tuple(r.removed) for r in substring_dedup.deduplicated(docs, min_words=20).collect()} == {()}


def test_fingerprints_are_homomorphic(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a b. c d. e f.", "e f. a b. c d.", "c d.", "a b. e f.")], "x string, y string, part string, rest string")
    f = {c: fingerprint.fingerprint(F.col(c)) for c in df.columns}
    r = df.select((fingerprint.text_form(f["x"]) == fingerprint.text_form(f["y"])).alias("order"), (fingerprint.combined(f["rest"], f["part"]) == f["x"]).alias("add"), (fingerprint.combined(f["x"], f["part"], -1) == f["rest"]).alias("take")).first()
    assert r.order and r.add and r.take


def test_edited_texts(spark, edge):
    import hashlib

    docs = sorted(pq.read_table(f"{edge}/documents.parquet").to_pylist(), key=lambda d: d["doc_id"])
    want = {}
    for k, d in enumerate(docs):
        t, nxt = d["text"] or "", docs[(k + 1) % len(docs)]["text"] or ""
        half = len(t) // 2
        want[d["doc_id"]] = (len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest())
    rows = queries.QUERIES["op8_fingerprint"](spark, edge).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows} == want
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == by[2].fingerprint != by[7].fingerprint and by[1].near_next > 0.99 and all(0 <= r.near_edited <= 1 for r in rows)


def test_fingerprints_and_likeness_against_loops(spark, edge):
    import re

    import xxhash

    def lanes(text):
        bits, wide, n = np.zeros(240, np.int64), np.zeros(8, np.int64), 0
        for part in re.sub(r"([.!?])[ \t]+", r"\1\n", text).split("\n"):
            if part:
                h = [xxhash.xxh64(part.encode(), seed=xxhash.xxh64(k.to_bytes(4, "little"), seed=42).intdigest()).intdigest() for k in range(8)]
                bits += [(h[k] >> (s + 20 * j)) & 1 for k in range(4) for s in range(20) for j in range(3)]
                wide = (wide + [y for x in h[4:] for y in (x >> 32, x & 0xFFFFFFFF)]) % (1 << 32)
                n += 1
        return bits % 65536, wide, n

    def form(v):
        bits, wide, n = v
        longs = [int(sum(int(b) << (20 * j) for j, b in enumerate(bits[k : k + 3]))) for k in range(0, 240, 3)] + [int(x) for x in wide] + [n]
        return "".join(f"{x:016X}" for x in longs)

    def like(a, b):
        x, y = (2.0 * v[0] - v[2] for v in (a, b))
        if not x.any() and not y.any():
            return 1.0
        scale = np.sqrt((x @ x) * (y @ y))
        return min(1.0, max(0.0, x @ y / scale)) if scale else 0.0

    docs = sorted(pq.read_table(f"{edge}/documents.parquet").to_pylist(), key=lambda d: d["doc_id"])
    got = {r.doc_id: r for r in queries.QUERIES["op8_fingerprint"](spark, edge).collect()}
    for k, d in enumerate(docs):
        t, nxt = d["text"] or "", docs[(k + 1) % len(docs)]["text"] or ""
        half = len(t) // 2
        own, edited, after = lanes(t), lanes(t[: len(t) - half] + nxt[:half]), lanes(nxt)
        r = got[d["doc_id"]]
        assert (r.fingerprint, r.edited_fingerprint) == (form(own), form(edited))
        assert abs(r.near_edited - like(own, edited)) < 1e-9 and abs(r.near_next - like(own, after)) < 1e-9


def test_next_rows_over_sparse_ids(spark):
    ids = [0, 5, 1 << 40, (1 << 40) + 1, 1 << 41, 1 << 50, -7]
    keys = spark.createDataFrame([(i,) for i in ids], "part long")
    want = dict(zip(sorted(ids), [*sorted(ids)[1:], min(ids)], strict=True))
    for most in (100, 2):
        assert {r.part: r.next for r in fingerprint.following(keys, 4, most).collect()} == want


def test_pairs_at_the_threshold_are_found(spark):
    """200 planted pairs with a similarity of 0.85 to 0.9: all links of the loop, and no others."""
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for k in range(200):
        words = [f"p{k}x{j}" for j in range(int(rng.integers(60, 300)))]
        other = list(words)
        shingles = lambda w: {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
        while True:
            trial = list(other)
            trial[int(rng.integers(len(trial)))] += "y"
            a, b = shingles(words), shingles(trial)
            if 100 * len(a & b) < 85 * len(a | b):
                break
            other = trial
            if 100 * len(a & b) <= 90 * len(a | b):
                break
        a, b = shingles(words), shingles(other)
        want[2 * k] = want[2 * k + 1] = 2 * k
        if 100 * len(a & b) < 85 * len(a | b):
            want[2 * k + 1] = 2 * k + 1
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 0.85).collect()}
    assert got == want and sum(k != v for k, v in want.items()) > 150


def test_registers_estimate_similarity():
    rng = np.random.default_rng(3)
    common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (900, 50, 50))
    ra, rb = (near_dedup.registers(near_dedup._least(np.concatenate([common, x]))) for x in (a, b))
    assert abs((ra == rb).mean() - 0.9) < 0.08


def test_mixture_takes_near_its_targets(spark):
    df = spark.range(6000).selectExpr("id as doc_id", "repeat('w ', cast(5 + id % 50 as int)) as text", "concat('s', id % 3) as source", "1 as _size", "2 as copies", "3 as target")
    mixed = corpus_pipeline.mixing.mixture(df)
    rows = mixed.groupBy("doc.source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) < 0.05 * r.target for r in rows)
    out = corpus_pipeline.mixing.emitted(mixed)
    assert out.columns == df.columns and out.filter("_size <> 1 or copies <> 2 or target <> 3").isEmpty()


def test_long_sentences_and_short_documents_take_part(spark):
    long = " ".join(f"w{k}" for k in range(30)) + "."
    rows = [(1, f"One. {long} Two."), (2, f"Three. Four. {long} Five. Six."), (3, long), (4, "Tiny."), (5, "A. Tiny. B."), (6, "Tiny.")]
    got = {r.doc_id: r.removed for r in substring_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [3], 3: [1], 4: [], 5: [], 6: [1]}


def test_pipeline(spark, edge, nulls, sf, empty):
    for folder in (sf, edge, nulls, empty):
        rows = corpus_pipeline.run(spark, folder).collect()
        sizes = Counter(r.shard for r in rows)
        assert not rows or max(sizes.values()) - min(sizes.values()) <= (1 if len(sizes) == 8 else len(rows))
    docs = spark.read.parquet(f"{edge}/documents.parquet")
    got = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, edge).collect()}
    assert 1 in got and 2 not in got and {3, 4, 5} <= got
    left = {r.doc_id for r in corpus_pipeline.decontamination_stage(spark, docs, edge).collect()}
    assert left == {3, 4, 5, 6, 9, 10, 11}
    docs = spark.read.parquet(f"{nulls}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, nulls)
        assert docs.columns == [c for c, _ in TYPES["documents"]], name
    left = corpus_pipeline.decontamination_stage(spark, spark.read.parquet(f"{nulls}/documents.parquet"), nulls).collect()
    assert len(left) == 13  # items without an id take no part


def test_stages_against_loops(spark, sf):
    """What each filtering stage keeps, by loops over whole texts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    items = pq.read_table(f"{sf}/benchmark.parquet").to_pylist()
    hit = {r[0] for r in decontamination.brute(list(texts.items()), [(i["item_id"], i["text"]) for i in items]) if r[2]}
    assert {r.doc_id for r in corpus_pipeline.decontamination_stage(spark, docs, sf).select("doc_id").collect()} == set(texts) - hit
    words = {d: "".join(" " if c in "\t\n\x0b\x0c\r" else c.lower() if c.isascii() else c for c in t).split(" ") for d, t in texts.items()}
    sets = {d: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for d, ws in words.items() if (w := [x for x in ws if x])}
    leader = {d: d for d in texts}

    def root(d):
        while leader[d] != d:
            d = leader[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                leader[max(x, y)] = min(x, y)
    assert {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, sf).select("doc_id").collect()} == {d for d in texts if root(d) == d}


def _chain(n: int, words: int = 300, step: int = 6) -> list[tuple[int, str]]:
    """Texts of which each shares most of its words with the next, and little with those farther on."""
    return [(k, " ".join(f"w{k * step + i}" for i in range(words))) for k in range(n)]


def test_long_chains_are_one_component(spark):
    """2,000 classes, each linked with the next ones alone, in blocks of sketches and of sets."""
    docs = spark.createDataFrame(_chain(2000), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, 0.85).collect()}
    assert len(got) == 2000 and set(got.values()) == {0}


def test_sets_of_texts_that_share_but_a_passage_do_not_travel(spark):
    """A passage common to all texts ties them in bands; their sketches part them again, but for the two that are alike."""
    passage = " ".join(f"common{k}" for k in range(60))
    rows = [(k, passage + " " + " ".join(f"own{k}x{i}" for i in range(90))) for k in range(400)] + [(1000, passage + " " + " ".join(f"own7x{i}" for i in range(88)))]
    reps = near_dedup.sketches(spark.createDataFrame(rows, "doc_id long, text string")).select(F.col("doc_id").alias("node"), "n_shingles", "sketch")
    tied = near_dedup.stars(reps, *near_dedup.bands_for(0.85))
    assert tied.count() > 5
    assert {r.node for r in near_dedup.candidates(reps, 0.85).collect()} == {7, 1000}
