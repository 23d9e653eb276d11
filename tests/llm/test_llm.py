"""The corpus operators against brute force, round trips and held-out rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldlog.llm import bpe, common, exact_dedup, id_store, language_id, lm_scoring, near_dedup, nearest, packing, pii, url_filter
from fieldlog.llm.words import default_tokenizer

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, body string, range int"
EDGES = [(1, None, "en"), (2, "", "en"), (3, "same words in a row here", "en"), (4, "same words in a row here", None), (None, "same words in a row here", "en"), (5, "é <|endoftext|> \x1c Σ 12", "fr"), (6, "word " * 6000, "de"), (6, "word " * 6000, "de"), (7, "x" * 30000, "de")]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing columns."""
    return spark.createDataFrame([(i, t, lang, None, 0, "b", 1) for i, t, lang in EDGES], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_tokenizer())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_exact_groups(docs):
    got = sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs, keep="max").collect())
    assert got == sorted([(0, 4, 3, False), (1, 2, 2, False), (2, 2, 2, True), (3, 4, 3, False), (4, 4, 3, True), (5, 5, 1, True), (6, 6, 2, False), (6, 6, 2, True), (7, 7, 1, True)])
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 3, 5, 6, 7]
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_hot_text_is_spread_over_ranges(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = exact_dedup.exact_groups(df, keep="max", ranges=16)
    assert got.where("kept").count() == 4000 - 1334 + 1
    assert {(r.keep_id, r.group_size) for r in got.where("doc_id % 3 = 0").select("keep_id", "group_size").distinct().collect()} == {(3999, 1334)}


def test_bpe_is_the_librarys(library):
    coder, random_ = bpe.bpe(default_tokenizer()), random.Random(3)
    parts = ["a", "B", " ", "\n", "é", "É", "'s", "1", "½", "!", "́", " ", "中", "😀", "\x1c", "<|", "endoftext", "|>", "Σ", "İ", "<|endoftext|>", "the,", "the"]
    for text in [t or "" for _, t, _ in EDGES] + ["".join(random_.choices(parts, k=random_.randint(0, 25))) for _ in range(1500)]:
        want = ids_of(library, text)
        assert coder.encode(text) == want
        assert coder.digest(text) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest())


def test_bpe_rows(docs):
    encoded = bpe.encode(docs)
    assert encoded.count() == docs.count() == bpe.digests(docs).count()
    assert bpe.decode(encoded).where("doc_id = 3").first().text == "same</w> words</w> in</w> a</w> row</w> here</w>"


def test_packing(docs, library):
    got = packing.pack(docs).toPandas()
    assert got.length.sum() == sum(len(ids_of(library, t)) + 1 for _, t, _ in EDGES)
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    assert got.groupby("sequence_id").length.sum().max() <= 4096
    assert packing.pack(docs.limit(0)).count() == 0


def test_plan_reaches_the_bound():
    random_ = random.Random(1)
    counts: dict = {}
    for _ in range(3000):
        n = min(4096, max(1, int(random_.lognormvariate(6, 1.2))))
        counts[n] = counts.get(n, 0) + 1
    used = max(r[4] + r[2] // r[3] for r in packing.plan(counts))
    assert used <= 1.01 * sum(n * k for n, k in counts.items()) / 4096 + 1


def test_id_store(docs, library, tmp_path):
    folder = str(tmp_path / "store")
    rows = id_store.stored_digests(docs, folder).collect()
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32, r.verified) for r in rows)
    ids = [(i or 0, np.array(ids_of(library, t) + [1], "<u4")) for i, t, _ in EDGES]
    assert got == sorted((i, len(x), zlib.crc32(x.tobytes()), True) for i, x in ids)
    # Gapless from 0, in the order of the ids, nulls first.
    ordered, at = sorted(rows, key=lambda r: r.start), 0
    assert [r.doc_id or 0 for r in ordered] == sorted(i for i, _ in ids)
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    assert id_store.stored_digests(docs.limit(0), str(tmp_path / "empty")).count() == 0
    back = sorted((r.doc_id or 0, list(r.ids)) for r in id_store.documents(docs.sparkSession, folder).collect())
    assert back == sorted((i, x.tolist()) for i, x in ids)


def test_crc_of_parts():
    parts = [b"abc", b"", b"x" * 1000, b"\0"]
    assert id_store.joined_crc([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_near_groups(spark, docs):
    words = [f"w{i}" for i in range(300)]
    more = [(100, " ".join(words), None, None, 0, "", 0), (101, " ".join(words[:290] + ["other"]), None, None, 0, "", 0), (102, " ".join(words[150:] + words[:150][::-1]), None, None, 0, "", 0)]
    got = {r.doc_id: (r.class_id, r.kept) for r in near_dedup.near_groups(docs.unionByName(spark.createDataFrame(more, SCHEMA))).collect()}
    assert got[100] == (100, True) and got[101] == (100, False) and got[102] == (102, True)
    assert got[1] == (1, True) and got[2] == (2, True) and got[4] == (3, False) and got[None] == (3, False)
    left = near_dedup.drop_near_copies(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} >= {1, 2, 3, 5, 6, 7}
    assert near_dedup.near_groups(docs.limit(0)).count() == 0


def test_pii(spark, docs):
    text = "write to a.b@c.org or (a@b.c+d@e.f) 1.2.3.4 300.1.1.1 and 4111 1111 1111 1111 call +1 (415) 555-0100!"
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(50, text), (51, "1" * 50000)], "doc_id long, text string"))
    got = {r.doc_id: r for r in pii.digests(df).collect()}
    assert (got[50].n_email, got[50].n_ip, got[50].n_card, got[50].n_phone) == (3, 1, 1, 1)
    assert got[1].spans == "" and got[51].n_card == 0 and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    cleared = pii.redact(df, length_col=None).where("doc_id = 50").first().text
    assert "[EMAIL]" in cleared and "555-0100" not in cleared and cleared.startswith("write to [EMAIL] or ([EMAIL][EMAIL])")


def test_language(spark, docs):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    got = language_id.identify(df).join(df, "doc_id").where("held_out")
    assert got.where("lang_pred = lang").count() >= 0.9 * got.count()
    edge = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert edge[1].lang_pred == edge[2].lang_pred == "und" and edge[1].score == 0
    assert language_id.identify(docs.limit(0)).count() == 0


def test_lm(docs):
    got = {r.doc_id: r for r in lm_scoring.score(docs).collect()}
    assert got[1].n_tokens == got[2].n_tokens == 1 and got[6].n_tokens == 6001


def test_nearest(spark):
    rng = np.random.default_rng(0)
    vectors = [rng.standard_normal(8).tolist() for _ in range(500)] + [[1.0] * 8] * 300
    rows = [(i, v) for i, v in enumerate(vectors)] + [(9000, None), (9100, [0.0] * 8), (9200, [float("nan")] * 8), (9300, [1.0])]
    got = nearest.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas()
    x = np.array(vectors, dtype=np.float32).astype(float)
    hits = 0
    for q in range(0, 800, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(800), d)) if i != q][:10]
        hits += len(set(order) & set(got[got.query_id == q].vec_id))
    assert hits >= 0.9 * 80 and not set(got.query_id) & {9000, 9100, 9200}


def test_nearest_of_several_shards(spark):
    """Ranks, ids and scores of five shards, merged, against brute force; equal vectors, spread over all shards, come by id."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.standard_normal((900, 8)), np.repeat(rng.standard_normal((2, 8)), 300, axis=0)]).astype(np.float32).astype(float)
    x = x[rng.permutation(len(x))]
    assert nearest.shards_of(1500, 300) == 5 and nearest.shards_of(4000) == 1 and nearest.shards_of(10**6) == 250 and nearest.shards_of(10**8) == 2500
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in nearest.nearest_neighbours(vectors, every=20, shard_rows=300).collect()}
    assert set(got) == {(q, k) for q in range(0, 1500, 20) for k in range(1, 11)}
    right = 0
    for q in range(0, 1500, 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        mine = [got[q, k] for k in range(1, 11)]
        assert all(s == d[i] for i, s in mine) and mine == sorted(mine, key=lambda m: (m[1], m[0])) and q not in [i for i, _ in mine]
        if d[order[-1]] == 0:  # ten or more copies
            assert [i for i, _ in mine] == order
        right += sum(a == b for (a, _), b in zip(mine, order))
    assert right >= 0.98 * 750


def test_urls(spark):
    urls = ["https://WWW.Example.org/es/1?a=b", "http://example.org/en/15", "x.org/", None, "http://a.org", "http://a.org/", "http://b.com/fr/x", "http://b.com/de/x#y", "http://c.net/q?u=http://d.org/"]
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert got[0] == ("www.example.org", "/es/1", "example.org/es/") and got[1][2] == "example.org/en/1"
    assert got[2] == got[3] == ("", "", None) and got[4] == ("a.org", "", None) and got[5][2] == "org/"
    assert got[6][2] == "com/fr/" and got[7] == ("b.com", "/de/x", "com/de/") and got[8] == ("c.net", "/q", None)


def test_bounds_hold():
    """No pair's probability Jaccard is above its bound, and the short cut decides as the whole sum does."""
    draw = random.Random(3)
    texts = []
    for _ in range(12):
        words = [f"w{draw.randrange(90)}" for _ in range(draw.choice([1, 5, 40, 120]))] * draw.choice([1, 2])
        for changes in (0, 1, 6):
            copy = list(words)
            for _ in range(changes):
                copy[draw.randrange(len(copy))] = "other"
            texts.append(" ".join(copy))
    held = [near_dedup.stored(*near_dedup.shingles(t)) for t in texts]
    bounds = near_dedup.upper_bounds(held, np.arange(len(held)))
    for i, a in enumerate(held):
        above = bounds(i)
        for j, b in enumerate(held):
            exact = near_dedup.probability_jaccard(a, b)
            assert exact <= above[j] + near_dedup.SLACK
            assert (exact >= 0.8) == (near_dedup.probability_jaccard(a, b, 0.8) >= 0.8)


def two_languages(spark):
    """Texts in words of one language each: frequent ones and 1500 others; and triples whose last word follows from the first alone."""
    draw, texts = random.Random(7), []
    for k in range(600):
        language = "ab"[k % 2]
        texts.append(" ".join(f"{language}often{draw.randrange(20)}" if draw.random() < 0.5 else f"{language}{draw.randrange(1500)}" for _ in range(30)))
    texts += ["p1 f q1", "p2 f q2"] * 60
    seen = {}
    for t in " ".join(texts).split():
        seen[t] = seen.get(t, 0) + 1
    rare = {x: sorted((t for t in seen if t[0] == x and seen[t] <= 2), key=lambda t: (seen[t], t))[:40] for x in "ab"}
    mixed = [rare["ab"[i % 2]][i] for i in range(40)], [rare["ba"[i % 2]][i] for i in range(40)]
    asked = [" ".join(rare["a"]), " ".join(rare["b"]), *map(" ".join, mixed), "p1 f q1", "p1 f q2", "unseen here a1"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10_000 + i, t) for i, t in enumerate(asked)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def scored(df, **more):
    return [r for r in sorted(lm_scoring.score(df, held=F.col("doc_id") >= 10_000, **more).collect(), key=lambda r: r.doc_id) if r.doc_id >= 10_000]


def test_lm_sees_rare_tokens_and_two_before(spark):
    df = two_languages(spark)
    whole = scored(df)
    a, b, ab, ba, right, wrong, _ = [r.score for r in whole]
    # The same rare tokens, in texts of one language and mixed.
    assert a + b > ab + ba + 2
    assert right > wrong + 0.2
    # Tokens that meet their counts and classes in a join.
    joined = scored(df, frequent=700)
    assert [(r.n_tokens, r.n_known) for r in joined] == [(r.n_tokens, r.n_known) for r in whole]
    assert np.allclose([r.base_score for r in joined], [r.base_score for r in whole])
    assert sum(r.score for r in joined[:2]) > sum(r.score for r in joined[2:4]) + 2


@pytest.mark.parametrize("frequent", [lm_scoring.FREQUENT, 3])
def test_lm_base_is_that_of_brute_force(spark, docs, frequent):
    """Counts, known tokens and the base score of real and edge texts, also where nearly all tokens meet their counts in a join."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(120).collect()] + [(i, t) for i, t, _ in EDGES]
    split = lambda t: re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    held = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 10 == 0
    counts = Counter(t for i, text in rows if not held(i) for t in split(text))
    n, v = sum(counts.values()), len(counts)
    want = [(i or 0, held(i), len(split(t)), sum(counts[x] > 0 for x in split(t)), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in split(t)), 5)) for i, t in rows]
    got = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), frequent=frequent).collect()
    assert sorted((r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == sorted(want)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_lm_without_rows_to_learn_from(spark, docs):
    assert lm_scoring.score(docs.limit(0)).count() == 0
    got = {r.doc_id: r for r in lm_scoring.score(docs, held=F.lit(True)).collect()}
    assert got[1].train_tokens == got[1].n_known == 0 and got[3].base_score == 0 and math.isfinite(got[3].score)


def test_lm_shares_sum_to_one():
    """For every pair of contexts, unseen tokens among them: the chances of all classes, without what an unseen token takes of the clusters, and that token's add up to one."""
    tables = [np.arange(25, dtype=np.float32).reshape(5, 5), np.arange(25, dtype=np.float32)[::-1].reshape(5, 5)]
    model = lm_scoring.fitted(lm_scoring.trained(tables), tables)
    unseen, average = np.array([0.25, 0.5]), np.array([0.4, 0.6])
    one, two, less, strange = lm_scoring.normalised(model, slice(2, 4), unseen, average)
    assert one.shape == two.shape == (6, 5) and less.shape == strange.shape == (6, 6)
    for a in range(6):
        for b in range(6):
            chances = 10.0 ** (one[a] + two[b] - less[a, b])
            assert np.isclose(chances @ np.array([1, 1, 0.75, 0.5, 1]) + 10.0 ** strange[a, b], 1, atol=1e-4)
    # One model: the representations of both contexts are added before the softmax.
    r = model.before[1] @ model.contexts[0] + model.before[3] @ model.contexts[1]
    s = (r @ model.after.T + model.bias).astype(np.float64)
    s = np.exp(s - s.max())
    assert np.allclose(10.0 ** (one[1] + two[3] - less[1, 3]), s / s.sum(), atol=1e-4)


def test_lm_gradient_is_that_of_the_likelihood():
    """Counts of pairs give the same gradient as all triples would."""
    rng = np.random.default_rng(4)
    texts, end = [rng.integers(0, 4, rng.integers(1, 9)).tolist() for _ in range(40)], 4
    triples = [(x[i - 1] if i else end, x[i - 2] if i > 1 else end, t) for x in texts for i, t in enumerate(x + [end])]
    tables = [np.zeros((5, 5), np.float32) for _ in range(2)]
    for a, b, t in triples:
        tables[0][a, t] += 1
        tables[1][b, t] += 1
    model = lm_scoring.trained(tables, dimensions=6, rounds=30)
    likelihood = lambda m: np.mean([(s := (m.before[a] @ m.contexts[0] + m.before[b] @ m.contexts[1]) @ m.after.T + m.bias)[t] - np.log(np.exp(s.astype(np.float64)).sum()) for a, b, t in triples])
    model.contexts = [k * np.float32(0.7) for k in model.contexts]
    before = likelihood(model)
    after = likelihood(lm_scoring.fitted(model, tables, 80))
    # Of the six parameters a class has the model finds nearly the best that counts allow.
    best = np.mean([math.log(sum(x == (a, b, t) for x in triples) / sum(x[:2] == (a, b) for x in triples)) for a, b, t in triples])
    assert before + 0.01 < after < best


def test_lm_beats_its_base_on_held_out_rows(spark):
    got = lm_scoring.score(spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    print("held out, log10 a token:", got[0] / got[2], "base", got[1] / got[2])
    assert got[0] / got[2] > got[1] / got[2] + 0.4


def test_pairs_of_one_band_are_compared(spark):
    """Near copies in a mixed bucket that share no second one are linked."""
    words = [f"w{i}" for i in range(300)]
    texts = {1: " ".join(words), 2: " ".join(words[:290] + ["other"]), 3: "quite another text of several words"}
    held = {k: near_dedup.shingles(t) for k, t in texts.items()}
    rows = [(k, near_dedup.stored(h, n), near_dedup.signature_bytes(near_dedup.signature(h, 1 + np.log(n))), [7, *range(100 * k, 100 * k + near_dedup.BANDS - 1)]) for k, (h, n) in held.items()]
    sets = spark.createDataFrame(rows, "node long, shingles binary, sig binary, bands array<long>").withColumn("bytes", F.length("shingles").cast("long"))
    held = spark.createDataFrame([(7, k, k, 3) for k in texts], "band long, node long, component long, members long")
    assert sorted(tuple(r) for r in near_dedup.agreeing(held, sets).collect()) == [(7, 1), (7, 2)]
    assert [tuple(r) for r in near_dedup.compared_in_full(held, sets, near_dedup.THRESHOLD).collect()] == [(1, 2)]


def test_id_store_misses_recipes(spark, tmp_path, monkeypatch):
    """A lost recipe makes its part unverified, a lost part is an error. With small nodes the tree has several levels."""
    monkeypatch.setattr(id_store, "LEAVES", 2)
    rows = spark.createDataFrame([(i, f"text number {i}") for i in range(40)], "doc_id long, text string")
    folder, less, none = (str(tmp_path / x) for x in ("store", "less", "none"))
    assert {r.verified for r in id_store.stored_digests(rows, folder).collect()} == {True}
    recipes = spark.read.parquet(f"{folder}/recipes")
    files = [r.part for r in recipes.select("part", F.input_file_name()).distinct().collect()]
    assert 1 < len(files) == len(set(files))
    part = recipes.where("doc_id = 7").first().part
    for copy, left in ((less, "doc_id <> 7"), (none, f"part <> {part}")):
        for name in ("chunks", "manifest"):
            spark.read.parquet(f"{folder}/{name}").write.parquet(f"{copy}/{name}")
        recipes.where(left).write.parquet(f"{copy}/recipes")
    inside = {r.doc_id for r in recipes.where(f"part = {part}").collect()} - {7}
    assert {r.doc_id for r in id_store.read_digests(spark, less).collect() if not r.verified} == inside
    with pytest.raises(ValueError, match="missing"):
        id_store.read_digests(spark, none)


def families(draw, many):
    """Texts with copies of all degrees, boilerplate that many share, and a family whose members are near each other in chains."""
    boiler = [f"b{i}" for i in range(60)]
    texts = []
    for f in range(many):
        words = [f"f{f}w{draw.randrange(400)}" for _ in range(draw.choice([12, 80, 250]))] + (boiler if f % 3 else [])
        for _ in range(draw.choice([1, 3, 6])):
            copy = list(words)
            for _ in range(draw.choice([0, 1, 2, 4, 9])):
                copy[draw.randrange(len(copy))] = f"x{draw.randrange(10**6)}"
            texts.append(" ".join(copy))
        for k in range(6 if f % 10 == 0 else 0):
            texts.append(" ".join([*words[3 * k :], *[f"c{f}n{i}" for i in range(3 * k)]]))
    return texts


def brute_classes(texts):
    """Whole probability Jaccard of all pairs, straight from its definition over shingles as words; classes of the links."""
    def weights(t):
        words = re.findall(r"\w+", t.lower())
        size = min(5, len(words))
        counts = Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if size else {}
        return {k: 1 + math.log(n) for k, n in counts.items()}

    sets, root = [weights(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            both = a.keys() & b.keys()
            if a and b and 3 * len(both) > len(a) and sum(1 / sum(max(a.get(k, 0) / a[d], b.get(k, 0) / b[d]) for k in a.keys() | b.keys()) for d in both) >= 0.8:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("wide", [16, 2])
def test_near_groups_are_those_of_all_pairs(spark, monkeypatch, wide):
    """Also with small blocks, and with drawn leaders in nearly all buckets."""
    monkeypatch.setattr(near_dedup, "WIDE", wide)
    if wide == 2:
        monkeypatch.setattr(near_dedup, "BLOCK", 3)
        monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 4000)
    texts = families(random.Random(wide), 40)
    want = brute_classes(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in near_dedup.near_groups(rows).collect()}
    assert [got[i].class_id for i in range(len(texts))] == want
    sizes = Counter(want)
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got.values())
    assert len(sizes) < len(texts)


def test_near_copies_go_either_way(spark, docs, monkeypatch):
    """The same rows stay where the dropped ones are too many to be sent to every task."""
    left = sorted(r.doc_id or 0 for r in near_dedup.drop_near_copies(docs).collect())
    monkeypatch.setattr(common, "SENT_ROWS", 0)
    assert sorted(r.doc_id or 0 for r in near_dedup.drop_near_copies(docs).collect()) == left


def test_copies_dropped_over_ranges(spark):
    """Texts that span ranges; other columns of any name and the difference of null and empty stay."""
    rows = [(i, None if i == 0 else "" if i % 3 == 1 else f"t{i % 50}", "c", 1.5, [i]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, body string, first double, carried array<int>")
    left = sorted(tuple(r) for r in exact_dedup.drop_exact_copies(df, ranges=16).collect())
    first = {}
    for r in rows:
        first.setdefault(r[1] or "", r)
    assert left == sorted(first.values())
    assert exact_dedup.drop_exact_copies(df.limit(0)).count() == 0


def test_packing_pieces_are_those_of_brute_force(docs, library):
    """Piece, start, length and checksum of every piece, by the library; sequences are gapless; as few as the bound allows."""
    got = packing.pack(docs).toPandas()
    want = []
    for i, text, _ in EDGES:
        ids = np.array(ids_of(library, text) + [1], "<u4")
        want += [(i or 0, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())) for k in range(0, len(ids), 4096)]
    assert sorted((int(r.doc_id) if r.doc_id == r.doc_id else 0, r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == sorted(want)
    assert got.sequence_id.nunique() == -(-sum(w[3] for w in want) // 4096)


@pytest.mark.parametrize("counts, best", [({3000: 50, 1500: 70}, 85), ({2049: 10, 2047: 10}, 10), ({4096: 3}, 3), ({1: 1}, 1), ({1366: 30}, 15), ({1365: 30, 1: 10}, 10)])
def test_plan_of_few_lengths(counts, best):
    rows = packing.plan(counts)
    assert max(r[4] + -(-r[2] // r[3]) for r in rows) == best


def test_program_meets_its_bound():
    """The total of the fractional fillings is within the gap of the dual bound, and every class is served."""
    rng = np.random.default_rng(5)
    size, demand = np.sort(rng.choice(np.arange(60, 300), 40, replace=False)), rng.integers(1, 500, 40).astype(float)
    fillings, bound = packing.configurations(size, demand, 1024)
    assert all((number * size).sum() <= 1024 for number, _ in fillings)
    assert (sum(number * times for number, times in fillings) >= demand * (1 - 1e-9)).all()
    assert (size * demand).sum() / 1024 <= bound * (1 + 1e-9) <= sum(t for _, t in fillings) <= packing.GAP * bound * (1 + 1e-9)


BRUTE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def base_spans(text):
    """The base spans by plain regular expressions."""
    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0

    def passes(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        return (12 <= len(d) <= 19 and luhn(d)) if kind == "card" else 9 <= len(d) <= 15 if kind == "phone" else True

    found = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(BRUTE) for m in re.finditer(p, text) if passes(kind, m[0])]
    return sorted(found)


def test_pii_base_is_that_of_brute_force(spark, docs):
    draw = random.Random(11)
    signs = ["a", "@", ".", "b-c", "1", "23", "255", "4111", " ", "+", "(", ")", "-", "x_y", "%", "\n", "é", "5500005555555559", "😀"]
    texts = {100 + k: "".join(draw.choices(signs, k=draw.randrange(40))) for k in range(1500)} | {1: None, 2: ""}
    real = {10_000 + r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = list((texts | real).items())
    got = {r.doc_id: r for r in pii.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        spans = base_spans(text or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{BRUTE[k][0]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest(), text
        assert [got[i][f"n_{kind}"] for kind, _ in BRUTE] == [sum(k == x for _, k, _ in spans) for x in range(4)]
        assert got[i].spans.count(":") // 2 == len(spans) + got[i].n_added
    assert pii.digests(docs.limit(0)).count() == 0


def test_pii_adds_what_the_labelers_agree_on(spark):
    """Precision and recall of added spans on texts whose answers are known; what fails its check is never added, whatever stands before it."""
    draw = random.Random(2)
    number = lambda first: f"{first}{draw.randrange(10)}{draw.randrange(10)}-{draw.randrange(100, 999)}-{draw.randrange(1000, 9999)}"
    rows, true = [], {}
    for i in range(400):
        kind = i % 4
        if kind == 0:
            text = f"please call {number(draw.choice('23456789'))} today"
        elif kind == 1:
            text = f"write to jo{i} [at] mail{i}.com soon"
        elif kind == 2:
            text = f"order {number('1')} has come, part{number('0')}x too"
        else:
            text = f"card 4111 1111 1111 1112 and ip {draw.randrange(256, 999)}.1.2.3 for version 1.2.3"
        true[i] = kind < 2
        rows.append((i, text))
    got = {r.doc_id: r for r in pii.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    added = [i for i in got if got[i].n_added]
    assert sum(true[i] for i in added) >= 0.95 * len(added) and sum(true[i] for i in added) >= 0.9 * sum(true.values())
    assert not any(got[i].n_added or got[i].n_card or got[i].n_ip for i in got if i % 4 == 3)


def test_redacted_columns(spark):
    df = spark.createDataFrame([(1, "mail a@b.org now", 99, "s", "t"), (2, None, None, "s", "t"), (3, "", 7, None, None)], "doc_id long, text string, n_chars long, __spans string, __text string")
    out = pii.redact(df)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == df.columns and out.schema["n_chars"].dataType == df.schema["n_chars"].dataType
    assert (got[1].text, got[1].n_chars) == ("mail [EMAIL] now", 16) and got[2].text is None and got[2].n_chars is None and got[3].n_chars == 7 and got[1]["__text"] == "t"


def test_language_edges(spark, docs):
    one = spark.createDataFrame([(i, f"word number {i}", "en") for i in range(30)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.identify(one).collect()} == {"en"}
    none = one.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in language_id.identify(none).collect()} == {("und", 0.0)}
    data = "a\0é" * 50
    windows = language_id.windows(data.encode())
    assert windows.shape == (-(-len(data.encode()) // language_id.STRIDE), language_id.WINDOW)
    back = windows[:, language_id.LAP : language_id.LAP + language_id.STRIDE].tobytes().rstrip(b"\0")
    assert back == data.replace("\0", " ").encode()


def test_nearest_edges(spark):
    schema = "vec_id long, embedding array<float>, query_id long, vector int"
    assert nearest.nearest_neighbours(spark.createDataFrame([], schema)).count() == 0
    rows = [(0, [1.0, 0.0], 1, 1), (0, [1.0, 0.0], 1, 1), (1, [1.0, 0.0], 2, 2), (2, [0.0, 1.0], 3, 3), (None, [1.0, 1.0], 4, 4)]
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in nearest.nearest_neighbours(spark.createDataFrame(rows, schema)).collect())
    assert got[:2] == [(0, 1, 1), (0, 2, 2)]


def test_url_verdicts(spark):
    """Rules decide; the trees decide the others as the rules' examples do, on urls that no rule saw."""
    draw = random.Random(4)
    word = lambda n: "".join(draw.choice("abcdefghij") for _ in range(n))
    good, bad = (lambda: f"https://{word(6)}.com/fr/{word(8)}"), (lambda: f"http://{word(6)}.com/de/{draw.randrange(10**9)}?{'&'.join(f'{word(2)}={draw.randrange(99)}' for _ in range(4))}")
    urls = [(i, good() if i % 2 else bad()) for i in range(600)]
    others = [(1000 + i, f"https://{word(6)}.net/{word(8)}" if i % 2 else f"http://{word(6)}.net/{draw.randrange(10**9)}?{'&'.join(f'{word(2)}={draw.randrange(99)}' for _ in range(4))}") for i in range(100)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(urls + others + others[:3], "page_id long, url string")).collect()}
    assert all(got[i].verdict == ("allow" if i % 2 else "block") and got[i].score is None for i, _ in urls)
    right = sum(got[i].verdict == ("allow" if i % 2 else "block") for i, _ in others)
    assert right >= 95 and all(0 <= got[i].score <= 1 for i, _ in others)
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_bpe_edges(docs):
    assert bpe.digests(docs.limit(0)).count() == 0


def test_batches_are_bounded_by_bytes(spark):
    common.small_batches(spark)

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    big = spark.range(12, numPartitions=1).select(F.repeat(F.lit("x"), 3_000_000).alias("t"))
    assert max(r.n for r in big.mapInArrow(sizes, "n long").collect()) <= common.BATCH_BYTES + 4_000_000


def test_no_folder_of_one_machine_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())


def test_pipeline_stages_are_those_of_brute_force(spark, tmp_path):
    """Each stage on what the one before kept, against plain versions; other columns of any name stay until the last stage."""
    import corpus_pipeline

    texts = [None, "", "123 !!", *families(random.Random(9), 12), "mail me at a.b@c.org or 1.2.3.4 please my friend " + " ".join(f"z{i}" for i in range(40))]
    texts += texts[5:9]
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t or ""), 1, "x") for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, range int, __spans string"
    docs = spark.createDataFrame(rows, schema)
    at = lambda k: str(tmp_path / f"stage{k}")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(at(k))
        out = spark.read.parquet(at(k))
        if k < 4:
            assert out.columns == docs.columns
        docs = out
        kept.append({r.doc_id: r for r in out.collect()} if k < 4 else out.toPandas())
    language, exact, near, private, packed = kept
    assert set(language) <= {i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))} and len(language) > 0.9 * len(texts) - 4
    first = {}
    for i in sorted(language):
        first.setdefault(texts[i], i)
    assert set(exact) == set(first.values())
    ids = sorted(exact)
    assert set(near) == {ids[c] for c in set(brute_classes([texts[i] for i in ids]))}
    assert set(private) == set(near)
    for i, r in private.items():
        if not base_spans(texts[i]):
            assert r.text == texts[i]
    assert any("[EMAIL]" in r.text and "[IP]" in r.text for r in private.values())
    assert set(packed.doc_id) == set(private) and packed.groupby("sequence_id").length.sum().max() <= 4096


def test_pii_of_very_many_matches_in_one_text(spark):
    """Work is linear in the matches: 30,000 of four kinds, in blocks of several sizes, with overlaps of kinds and letters of several bytes between."""
    parts = [("10.0.%d.7", "ip"), ("é +49 30 12345%03d ", "phone"), ("a%d@b.org", "email"), ("4111 1111 1111 1111 ü%d", "card"), ("nothing %d", None)]
    text = "".join(parts[i % 5][0] % (i % 250) + (";\n" if i % 3 else ", ") for i in range(30000))
    rows = [(1, text), (2, "x"), (3, text[:500])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digests(df).collect()}
    for i, t in rows:
        base = base_spans(t)
        counts, listed = [sum(k == x for _, k, _ in base) for x in range(4)], ",".join(f"{BRUTE[k][0]}:{s}:{e}" for s, k, e in base)
        assert ([got[i][f"n_{k}"] for k in pii.KINDS], got[i].base_sha256) == (counts, hashlib.sha256(listed.encode()).hexdigest())
        assert set(filter(None, listed.split(","))) <= set(got[i].spans.split(","))
    cleared = {r.doc_id: r.text for r in pii.redact(df, length_col=None).collect()}
    for i, t in rows:
        want, at = [], 0
        for kind, s, e in ((k, int(s), int(e)) for k, s, e in (x.split(":") for x in got[i].spans.split(",") if x)):
            want += [t[at:s] if s > at else "", f"[{kind.upper()}]" if e > at else ""]
            at = max(at, e)
        assert cleared[i] == "".join(want) + t[at:]
