"""Neighbours, URL models and language-model scores against brute force and held-out data."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import ann, gru, lm, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_hilbert_neighbours_touch():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        grid = np.stack(np.meshgrid(*[np.arange(side)] * n), -1).reshape(-1, n)
        keys = ann.hilbert_keys(grid, bits)
        assert sorted(keys) == list(range(side**n))
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_neighbours_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(1500, 24)).astype(np.float32)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    rows += [(2000, None), (2001, [0.0] * 24), (2002, [float("nan")] * 24), (2003, [None] * 24), (2004, [1.0, 2.0]), (2005, [float("inf")] + [0.0] * 23), (None, [1.0] * 24)]
    rows += [(3000 + i, [float(x) for x in v[50]]) for i in range(40)]  # copies of a query
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("key", F.lit("clash"))
    got = defaultdict(list)
    for r in ann.nearest(d, F.col("vec_id") % 50 == 0, block_rows=300).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ids = np.array([*range(1500), *range(3000, 3040)])
    x = np.vstack([v, np.repeat(v[50:51], 40, axis=0)]).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = all_ = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = np.round(x @ x[q], 12)
        order = [i for i in np.lexsort((ids, -s)) if i != q][:5]
        mine = got.pop(int(ids[q]))
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        for _, i, score in mine:
            assert score == pytest.approx(float(x[q] @ x[np.flatnonzero(ids == i)[0]]), abs=1e-12)
        hit += len({int(ids[i]) for i in order} & {m[1] for m in mine})
        all_ += 5
    assert list(got) == []  # 2000: null; 2004 has no candidate of its length, and is no multiple of 50
    assert hit / all_ >= 0.9


def test_few_vectors_and_empty(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 2.0]), (50, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(d, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (50, 1, 1), (50, 2, 2), (50, 3, 0)]
    assert ann.nearest(d.where("vec_id < 0"), F.lit(True)).count() == 0


def test_collinear_vectors_tie_by_id(spark):
    rows = [(i, [float(i + 1) * x for x in (3.0, -7.0, 2.0)]) for i in range(20)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.vec_id, r.score) for r in ann.nearest(d, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(i, 1.0) for i in (1, 2, 3, 4, 5)]


def test_nearest_has_no_tolerance(spark):
    # Cosines with (1, 0) differ in the last digits of a double; ids are against the order.
    from decimal import Decimal, localcontext

    apart = [1e-7, 5e-7, 7e-7, 9e-7, 1e-6, 0.0, 2e-8]
    rows = [(0, [1.0, 0.0]), *((i + 1, [1.0, x]) for i, x in enumerate(apart))]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with localcontext() as c:
        c.prec = 50
        cosine = {i: float(1 / (1 + Decimal(v[1]) ** 2).sqrt()) for i, v in rows}
    want = sorted((i for i in cosine if i), key=lambda i: (-cosine[i], i))[:5]
    got = ann.nearest(d, F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == want and got[0].vec_id == 6
    assert [r.score for r in got] == [cosine[i] for i in want]


def test_nearest_of_large_and_small_components(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(60, 6))
    scale = [1.0, 1e200, 1e-200, 1e300, 1e-300]
    rows = [(i, [float(x) * scale[i % 5] for x in r]) for i, r in enumerate(v)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.nearest(d, F.col("vec_id") % 20 == 0).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in (0, 20, 40):
        near = unit @ unit[q]
        order = [i for i in np.argsort(-near) if i != q][:5]
        assert [got[q, n + 1][0] for n in range(5)] == order
        assert [got[q, n + 1][1] for n in range(5)] == pytest.approx([near[i] for i in order], abs=1e-12)


def test_small_blocks_lose_no_row_of_a_window(spark, monkeypatch):
    rng = np.random.default_rng(3)
    d = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rng.normal(size=(400, 8)))], "vec_id long, embedding array<double>")
    of = lambda rows: {(r.query_id, r.rank): r.vec_id for r in ann.nearest(d, F.col("vec_id") % 50 == 0, curves=3, window=40, block_rows=rows).collect()}
    assert len(of(7)) == len(of(4096)) == 40
    whole = of(4096)
    monkeypatch.setattr(ann, "ASKED", 20)  # the queries of a block in several tasks
    assert of(4096) == whole
    exact = {(r.query_id, r.rank): r.vec_id for r in ann.nearest(d, F.col("vec_id") % 50 == 0, curves=3, window=400, block_rows=50).collect()}
    x = np.array([r.embedding for r in d.orderBy("vec_id").collect()])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 400, 50):
        order = [i for i in np.argsort(-(x @ x[q]), kind="stable") if i != q][:5]
        assert [exact[q, r] for r in range(1, 6)] == order


def test_clustered_vectors_need_few_comparisons(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(300, 16))
    x = (centres[rng.integers(0, 300, 6000)] + rng.normal(scale=0.05, size=(6000, 16))).astype(np.float32)
    d = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    v = d.select(F.col("vec_id").alias("first"), F.col("embedding").alias("v"), (F.col("vec_id") % 50 == 0).alias("asked"))
    half = ann.fit_window(v, ann.positions(v, 8), 5)
    assert 8 * (2 * half + 1) < 0.25 * 6000  # compared rows of a query on all eight curves
    got = defaultdict(set)
    for r in ann.nearest(d, F.col("vec_id") % 50 == 0, curves=8).collect():
        got[r.query_id].add(r.vec_id)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = sum(len(got[q] & {i for i in np.argsort(-(u @ u[q]))[:6] if i != q}) for q in range(0, 6000, 50))
    assert hit >= 0.9 * 600


def test_recall_on_the_given_vectors(spark):
    import os

    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no given vectors")
    got = defaultdict(set)
    for r in ann.op5_hilbert_neighbours(spark, folder).collect():
        got[r.query_id].add(r.vec_id)
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").where(ann.usable(F.col("embedding"))).select("vec_id", "embedding").collect()
    ids = np.array([r.vec_id for r in rows])
    u = np.array([r.embedding for r in rows], dtype=np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    asked = np.flatnonzero(ids % 50 == 0)
    hit = sum(len(got[ids[q]] & set(ids[[i for i in np.argsort(-(u @ u[q]))[:6] if i != q][:5]])) for q in asked)
    assert hit >= 0.9 * 5 * len(asked)


URLS = ["http://a.example.com/en/1", "https://www.example.com/en/2?x=1", "https://m.www.example.com/en/3", "http://shop.net/es/9#t", "http://x.net/fr", "http://x.net/fr/", "HTTP://UP.Example.COM", "ftp://b.com?q", None, "no scheme/com/", "http://example.org/de/7", "x://y://com/", "http://notexample.com/en/5", ""]


def brute_url(u):
    u = u or ""
    if "://" not in u:
        return "", "", None, None
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = max(((h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), key=lambda r: len(r[0]), default=(None, None))
    return host, path, *best


def test_url_rules(spark):
    d = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("score", F.lit("clash"))
    got = {r.page_id: r for r in urls.judge(d).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute_url(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert urls.judge(d.where("page_id < 0")).count() == 0


def brute_llr(train, every):
    """Witten-Bell models over all grams of `every`, by dictionaries."""
    k = urls.ORDER
    grams = lambda s: [s[i : i + k] for i in range(len(s) - k + 1)]
    out = {}
    for side in (True, False):
        counts = Counter(g[-n:] for s, acc, m in train if acc == side for g in grams(s) for n in range(1, k + 1) for _ in range(m))
        p = {"": 1 / urls.SYMBOLS}
        for n in range(1, k + 1):
            own = {g[-n:] for s in every for g in grams(s)}
            follow = defaultdict(dict)
            for g in own:
                follow[g[:-1]][g] = counts[g]
            for ctx, kids in follow.items():
                total, kinds = sum(kids.values()), sum(c > 0 for c in kids.values())
                for g, c in kids.items():
                    below = p[g[1:]]
                    p[g] = (c + kinds * below) / (total + kinds) if total else below
        out[side] = p
    return {g: math.log(out[True][g]) - math.log(out[False][g]) for s in every for g in grams(s)}


def test_url_models(spark):
    fold = lambda s: "^" * (urls.ORDER - 1) + re.sub(r"[^a-z0./_=&%~:+-]", "*", re.sub("[0-9]+", "0", s))
    train = [(fold(s), acc, n) for s, acc, n in [("news.com/a/12", True, 3), ("news.org/b", True, 1), ("spam.net/xx/1", False, 2), ("spam.net/yy", False, 1), ("other", False, 0)]]
    d = spark.createDataFrame([(s, acc, not acc, n) for s, acc, n in train], "folded string, accepted boolean, rejected boolean, n long")
    got = {r.gram: r.llr for r in urls.gram_table(d).collect()}
    want = brute_llr(train, [s for s, _, _ in train])
    assert set(got) == set(want)
    for g in want:
        assert got[g] == pytest.approx(want[g], abs=1e-9)
    scores = {r.folded: r.score for r in urls.scored(d.select("folded"), spark.createDataFrame(list(got.items()), "gram string, llr double")).collect()}
    assert scores[fold("news.com/a/12")] > 0 > scores[fold("spam.net/xx/1")]


def test_url_models_separate_held_out(spark):
    rng = np.random.default_rng(0)
    name = lambda stem: "".join(rng.choice(list(stem), 8))
    rows = [(i, f"http://{name('abcde')}.com/{name('abcde')}") for i in range(300)] + [(1000 + i, f"http://{name('vwxyz')}.net/es/{name('vwxyz')}") for i in range(300)]
    rows += [(5000 + i, f"http://{name('abcde')}.org/{name('abcde')}") for i in range(50)] + [(6000 + i, f"http://{name('vwxyz')}.org/{name('vwxyz')}") for i in range(50)]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert sum(got[5000 + i] == "allow" for i in range(50)) >= 45 and sum(got[6000 + i] == "block" for i in range(50)) >= 45


def test_gradients():
    rng = np.random.default_rng(0)
    w = {k: x.astype(np.float64) for k, x in gru.start(rng.integers(1, 50, 64).astype(float), 5, 8).items()}
    docs = [rng.integers(0, 64, n) for n in (9, 7, 3)]

    class Kept(gru.Adam):
        def step(self, g):
            self.g = {k: x.copy() for k, x in g.items()}

    a = Kept({k: x.copy() for k, x in w.items()}, 0.1)
    n = gru.train(a, docs, 1, width=32)
    loss = lambda: -gru.score(w, docs, 1).sum() / n
    for k in gru.NAMES:
        for _ in range(4):
            i = tuple(rng.integers(0, s) for s in w[k].shape)
            old = w[k][i]
            w[k][i] = old + 1e-4
            up = loss()
            w[k][i] = old - 1e-4
            down = loss()
            w[k][i] = old
            assert (up - down) / 2e-4 == pytest.approx(a.g[k][i], abs=1e-7)


def test_scores_are_probabilities_and_carry_state():
    rng = np.random.default_rng(2)
    w = gru.start(rng.integers(1, 50, 32).astype(float), 6, 8)
    docs = [rng.integers(0, 32, n) for n in (150, 150, 40, 1)]
    whole = gru.score(w, docs, 1, width=1000)
    assert whole == pytest.approx(gru.score(w, docs, 1, width=16), rel=1e-5)  # windows change nothing
    first = [gru.score(w, [np.array([i])], 1)[0] for i in range(32)]
    assert np.exp(first).sum() == pytest.approx(1.0, abs=1e-4)


def corpus():
    rng = np.random.default_rng(4)
    langs = [[f"{p}{i}" for i in range(60)] for p in "xyz"]
    rows = [(i, " ".join(rng.choice(langs[i % 3], int(rng.integers(20, 120))))) for i in range(1200)]
    return [*rows, (5000, None), (5001, ""), (5002, "Never SEEN words"), (5003, "x1 " * 500)]


def test_language_model(spark):
    rows = corpus()
    d = spark.createDataFrame(rows + rows[:2], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = lm.scored(d, head_size=50, hidden=8).toPandas()
    assert len(got) == len(rows) + 2
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    fold = lambda t: WORD.findall((t or "").lower()) + [" end"]
    c = Counter(w for i, t in rows + rows[:2] if not held(i) for w in fold(t))
    n, v = sum(c.values()), len(c)
    by_id = {i: t for i, t in rows}
    for r in got.itertuples():
        w = fold(by_id[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), abs=1e-6)
        assert r.score <= 1e-6
    out = got[got.held_out]
    assert len(out) > 10 and out.score.sum() > out.base_score.sum()  # better than unigrams on held-out texts


def test_end_is_counted_where_words_outnumber_it(spark):
    # Three words fill the head with greater counts than the end has.
    rows = [(i, " ".join(["aa", "bb", "cc"] * (40 + i) + [f"rare{i}"])) for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lm.scored(d, head_size=3, hidden=4).collect()}
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for t in train for w in [*t.split(), " end"])
    n, v = sum(c.values()), len(c)
    assert lm.END not in lm.head_of(lm.token_counts(d.select(F.col("text").alias("t"))), 3)
    for i, t in rows:
        w = [*t.split(), " end"]
        assert (got[i].n_known, got[i].train_tokens) == (sum(c[x] > 0 for x in w), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), abs=1e-6)


def test_stream_trains_every_token_with_its_state():
    rng = np.random.default_rng(6)
    w = gru.start(rng.integers(1, 50, 64).astype(float), 6, 8)
    docs = [rng.integers(0, 64, n) for n in (150, 90, 7)]
    a, b = (gru.Adam({k: x.copy() for k, x in w.items()}, 0.02) for _ in range(2))
    assert gru.train_stream(a, iter(docs), 1, least=1) == gru.train(b, docs, 1) == 247
    assert all(np.allclose(a.w[k], b.w[k], atol=1e-5) for k in gru.NAMES)
    # One lane: the next document begins from an empty state and the end, as it would alone.
    c = gru.Adam({k: x.copy() for k, x in w.items()}, 0.02)
    assert gru.train_stream(c, iter(docs), 1, lanes=1, least=1) == 247
    d = gru.Adam({k: x.copy() for k, x in w.items()}, 0.02)
    assert sum(gru.train(d, [x], 1) for x in docs) == 247
    assert all(np.allclose(c.w[k], d.w[k], atol=1e-5) for k in gru.NAMES)


def test_model_learns_from_whole_texts(spark):
    # Each word stands once in one long text: only the rows of words that training reads move.
    texts = [" ".join(f"q{i}x{j}" for j in range(300)) for i in range(3)]
    ids = {lm.END: 1} | {t.encode(): i + 2 for i, t in enumerate(" ".join(texts).split())}
    counts = np.ones(928)
    d = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    first, got = gru.start(counts, 4, lm.MEMBERS), lm.train_model(d, ids, counts, hidden=4)
    moved = np.abs(got["wx"] - first["wx"]).sum(1) > 0
    assert moved[1:902].all()


def test_language_model_keeps_large_ids_beside_null(spark):
    big = [2**53 + 1, 2**53 + 3, 2**62 + 5, None]
    d = spark.createDataFrame([(i, "a b c") for i in big], "doc_id long, text string").coalesce(1)
    assert sorted((r.doc_id for r in lm.scored(d, hidden=4).collect()), key=repr) == sorted(big, key=repr)


def test_weights_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 2_000)
    d = spark.createDataFrame(corpus(), "doc_id long, text string")
    one, many = ({r.doc_id: r.score for r in lm.scored(d.repartition(n), hidden=4).collect()} for n in (1, 7))
    assert one == pytest.approx(many, abs=1e-6)


def test_language_model_without_rows(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lm.scored(d.where("doc_id < 0")).count() == 0
    none = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    rows = lm.scored(none).collect()
    assert [r.held_out for r in rows] == [True, True] and all(math.isfinite(r.score) for r in rows)
