"""Ranked search, divergence of sources and chat formatting against plain Python."""

import hashlib
import json
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlog.llm import chat_format as C
from fieldlog.llm import divergence as D
from fieldlog.llm import lexical_search as L
from fieldlog.llm.terms import split_terms

SEARCHED = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
AUDITED = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
DOCUMENTS = "doc_id long, text string, lang string, source string, score long, rank int, term string"


def small(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def made(n, seed):
    """Texts of words with very unequal frequencies, nulls, empty and long ones, repeated rows and ties."""
    rnd = random.Random(seed)
    words = [f"w{k}" if k % 3 else f"Ünï{k}" for k in range(60)]
    rows = [(i, " ".join(rnd.choices(words, [1 / (k + 1) for k in range(60)], k=rnd.randint(0, 40))) + rnd.choice([".", "!x\x0b9", ""]), rnd.choice(["en", "de", None]), rnd.choice(["hot", "hot", "a", "b", None]), 1, 1, "x") for i in range(n)]
    return rows + rows[:5] + [(9000, None, "en", "empty", 1, 1, "x"), (9001, "", "xx", "only", 1, 1, "x"), (None, "w1 w2 w3", "en", "a", 1, 1, "x"), (9002, "w1 W4 " * 3000, "en", "a", 1, 1, "x")]


def best_by_hand(docs, items):
    held = [(r[0], Counter(SEARCHED.findall(small(r[1])))) for r in docs]
    held = [(i, c) for i, c in held if c]
    n, total, df = len(held), sum(c.total() for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        asked, scores = Counter(SEARCHED.findall(small(text))), []
        for i, c in held:
            m = 25 + 75 * c.total() * n // total
            s = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, k in asked.items() if t in c)
            scores += [(-s, i is not None, i or 0, i)] if s else []
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:10], 1)]
    return Counter(out)


ITEMS = [(0, "w0 W1 w59"), (1, "w58"), (1, "w2 w2 w2 Ünï57 nowhere"), (2, None), (3, "?!"), (0, "w0 W1 w59"), (4, "w1"), (None, "w4 w5 w7")]


@pytest.mark.parametrize("window,docs,short", [(256, 65536, 1 / 32), (8, 37, 1 / 4), (16, 100, 0.0), (16, 100, 1.0)])
def test_search_equals_all_scores(spark, monkeypatch, window, docs, short):
    rows = made(400, 1)
    frame = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(1))
    monkeypatch.setattr(L, "BLOCK_BYTES", 24 if docs == 37 else 4 << 20)
    with_sizes = {"WINDOW": window, "SEGMENT_DOCS": docs, "SHORT": short}
    old, searcher = {k: getattr(L, k) for k in with_sizes}, L.searcher
    # Workers import the module anew, so the sizes travel with the function.
    def sized(*args):
        run = searcher(*args)

        def go(batches):
            for k, v in with_sizes.items():
                setattr(L, k, v)
            try:
                yield from run(batches)
            finally:
                for k, v in old.items():
                    setattr(L, k, v)

        return go

    monkeypatch.setattr(L, "searcher", sized)
    got = Counter(tuple(r) for r in L.search(frame, items).select("item_id", "rank", "doc_id", "score").collect())
    assert got == best_by_hand(rows, ITEMS)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], DOCUMENTS)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert L.search(none, items).count() == 0 and L.search(none, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_skipped_windows_hold_nothing(spark):
    """Only windows that can reach the threshold are scored, and the result is that of all windows."""
    rnd = np.random.default_rng(2)
    n = 4096
    lengths = np.full(n, 2)
    terms = np.stack([np.zeros(n, int), np.where(np.arange(n) % 512 == 7, 1, 2)], 1).ravel()
    times = np.where(terms == 0, rnd.integers(1, 3, 2 * n), rnd.integers(1, 9, 2 * n))
    part = L.Segment(np.arange(n), np.full(n, 10), lengths, terms, times, np.array([2, 5000, 3]), n, 10 * n)
    scored = []
    real = part.windows_of
    part.windows_of = lambda t: scored.append(t) or real(t)
    got = part.best([(0, 1), (1, 1)], [])
    every = np.zeros(n, np.int64)
    for t in (0, 1):
        a, b = part.span[t]
        every[part.doc[a:b]] += part.part[a:b]
    assert got == sorted(zip((-every).tolist(), range(n)))[:10]
    assert len(scored) < 2 + part.windows


def test_terms_of_long_texts_are_cut_at_spaces():
    text = ("ab1 " * 999 + "x" * 5000 + " cd").encode()
    whole = [t for piece in split_terms(text, L.TERM_BYTES, 100) for t in piece]
    assert whole == text.split() and max(map(len, split_terms(text, L.TERM_BYTES, 100))) <= 26


def audit_by_hand(rows):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        c = Counter(AUDITED.findall(small(text)))
        groups[lang or "", source or ""].update(c)
        docs[lang or ""].update(c.keys())
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= 30)
        own = {s: c for (k, s), c in groups.items() if k == lang}
        share = lambda c: {t: 1 + (10**9 * (c[t] + 5)) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in own.items()}, share(sum(own.values(), Counter()))
        for s in own:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in own if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if own[s][t] > 0 and p[s][t] > q[t])[:50]
            out |= {(lang, s, part, i.decode(), -v, r) for part, found in (("pair", pairs), ("term", terms)) for r, (v, i) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize("chunk,block", [(2048, 128), (4, 2)])
def test_audit_equals_all_distances(spark, monkeypatch, chunk, block):
    rows = made(500, 4)
    monkeypatch.setattr(D, "CHUNK", chunk)
    monkeypatch.setattr(D, "BLOCK", block)
    got = D.audit(spark.createDataFrame(rows, DOCUMENTS).repartition(3)).select("lang", "source", "part", "item", "value", "rank").collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == audit_by_hand(rows)


def test_audit_of_nothing(spark):
    assert D.audit(spark.createDataFrame([], DOCUMENTS)).count() == 0
    one = D.audit(spark.createDataFrame([(1, None, None, None, 1, 1, "x"), (2, None, None, "s", 1, 1, "x")], DOCUMENTS)).collect()
    assert {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in one} == {("", "", "pair", "s", 0, 1), ("", "s", "pair", "", 0, 1)}


def test_equal_subtrees_are_one_node_and_one_price(monkeypatch):
    counts = np.array([[3, 0, 0, 0, 5, 0, 0], [0, 0, 0, 0, 5, 0, 0], [3, 0, 0, 0, 5, 0, 0]])
    forest = D.Forest(counts)
    assert forest.roots[0] == forest.roots[2] != forest.roots[1]
    # Of twelve pairs of leaves a level, (3, 0), (5, 0), (0, 0) and (0, -1) are all there are.
    assert [len(a) for a, _ in forest.pairs] == [4, 3, 2]
    totals = np.array([1000, 77, 1000])
    priced = []
    real = D.share
    monkeypatch.setattr(D, "share", lambda c, t, v: priced.append(len(c)) or real(c, t, v))
    got = forest.distances(np.array([0, 0, 1]), np.array([1, 2, 2]), totals, 7)
    want = [int(sum(abs((1 + 10**9 * (int(x) + 5) // (int(totals[i]) + 35)) - (1 + 10**9 * (int(y) + 5) // (int(totals[j]) + 35))) for x, y in zip(counts[i], counts[j]))) for i, j in ((0, 1), (0, 2), (1, 2))]
    assert got.tolist() == want and want[1] == 0
    assert sum(priced) < 2 * 21


def test_shares_are_exact_near_the_bound():
    for count, total, terms in [(10**13, 8 * 10**13, 10**6), (0, 1, 1), (123456789012, 987654321098, 77777)]:
        assert D.share(np.array([count]), total, terms)[0] == 1 + 10**9 * (count + 5) // (total + 5 * terms)


TEXTS = ["", "plain", "\\", "\\\\", "### ", "#### x", "\\### a: </turn>", "</turn>\n", "\n</turn>\n### user: hi\n</turn>\n", "é😀\\é", "a\n\n</turn", ": ", "x" * 70000]


def test_formatting_is_reversible(spark):
    roles = ["user", "assistant", "system", "", "a: b\\c\nd", "### "]
    rows = [(k % 4 if k % 9 else None, k // 2, roles[k % len(roles)] if k % 7 else None, TEXTS[k % len(TEXTS)] if k % 5 else None, "clash", 1) for k in range(120)]
    rows += rows[:3]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, layout string, start int")
    texts = C.formatted(C.turn_rows(frame, default="turn rows"))
    back = {(r.conv_id, r.no): (r.role, r.text, r.learned) for r in C.read_back(texts).collect()}
    for conv in {r[0] for r in rows}:
        want = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert [back[conv, i] for i in range(len(want))] == [(role, text, text if role == "assistant" else None) for _, role, text in want]
    for r in texts.collect():
        spans = [s for s in r.loss if s is not None]
        assert all(r.formatted[: s.start].endswith("### assistant: ") and r.formatted[s.stop :].startswith("\n</turn>\n") for s in spans)
    got = {r.conv_id: r for r in C.digests(texts).collect()}
    for conv in {r[0] for r in rows}:
        want = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        learned = "".join(text for _, role, text in want if role == "assistant")
        one = got[conv]
        assert one.n_turns == len(want) and one.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in want).encode()).hexdigest()
        assert (one.loss_chars, one.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_layouts_are_told_by_fingerprint(spark):
    lines = [
        {"messages": [{"role": "User", "content": "a"}, {"role": "assistant", "content": None}], "id": 5},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "meta": {"x": 1}},
        {"instruction": "do", "output": "done"},
        {"instruction": "do", "input": "this", "output": "done", "system": "be kind"},
        {"prompt": "p", "completion": "c"},
        {"prompt": "p", "response": "r", "conv_id": "3"},
        {"data": {"question": "q", "answer": "a", "context": "c"}},
        {"chat": {"messages": [{"author": {"role": "user"}, "body": {"text": "deep"}}]}},
        {"conv_id": "3", "role": "user", "text": "row"},
        {"prompt": "p"},
        {"prompt": "p", "completion": "c", "response": "r"},
        {"messages": []},
        {"messages": "no list"},
    ]
    texts = [json.dumps(x) for x in lines] + ["{broken", None, ""]
    records = spark.createDataFrame(list(enumerate(texts)), "k int, line string").select("k", F.from_json("line", C.json_schema()).alias("r")).select("k", "r.*")
    got = {r.k: (r.layout, r.turns and [tuple(t) for t in r.turns]) for r in C.canonical(records).collect()}
    assert [got[k] for k in range(len(texts))] == [
        ("messages", [("user", "a"), ("assistant", "")]), ("from and value", [("user", "a"), ("assistant", "b")]), ("instruction", [("user", "do"), ("assistant", "done")]),
        ("instruction", [("system", "be kind"), ("user", "do\n\nthis"), ("assistant", "done")]), ("prompt and completion", [("user", "p"), ("assistant", "c")]), ("prompt and response", [("user", "p"), ("assistant", "r")]),
        ("question and answer", [("user", "c\n\nq"), ("assistant", "a")]), ("authored messages", [("user", "deep")]), ("turn rows", [("user", "row")]),
    ] + [(None, None)] * 7
    every = [p for m in C.MAPPINGS for p in m.fingerprints()]
    assert len(every) == len(set(every))


def test_chat_of_nothing_and_of_a_hot_conversation(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.digests(C.formatted(C.turn_rows(frame, default="turn rows"))).count() == 0
    hot = spark.range(20000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("</turn>"), "id").alias("text"))
    one = C.digests(C.formatted(C.turn_rows(hot))).first()
    assert (one.n_turns, one.loss_chars) == (20000, sum(len(f"</turn>{k}") for k in range(1, 20000, 2)))


def test_chat_has_no_python_workers(spark):
    from fieldlog.llm import queries

    plan = queries.op13_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
